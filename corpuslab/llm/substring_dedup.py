"""Substring dedup: suffix automata of reference shards, passages streamed through them.

A window is ``window`` consecutive words (``[^\\x20\\x09-\\x0D]+``, unchanged). A word goes if a
window over it also starts in a document with a smaller id; windows are judged on the input.

A reference shard is cut by content (``passages``): its suffix automaton goes to just the passages
that can match it, not to every document. States carry the smallest document of their strings, so
the matching statistics of a streamed passage tell, word by word, whether the last ``window`` words
start in a smaller document. The maximal covered spans are removed.

Defined results: null or empty text, or fewer words than a window: nothing removed (no words: the
hash of the empty string). A null id counts as larger than every id. Rows that repeat an id: none is
smaller than the other. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import common as c
from corpuslab.llm.automaton import SuffixAutomaton
from corpuslab.llm.passages import BLOCK_CROWD, CROWD, Units, shared_windows

WINDOW, GRAM = 13, 5


def find_removed(docs: DataFrame, id_col="doc_id", text_col="text", window=WINDOW, gram=GRAM, with_text=False,
                 block_bytes=c.BLOCK_BYTES, crowd=CROWD, block_crowd=BLOCK_CROWD) -> DataFrame:
    """doc, n_words, n_removed, kept_sha256, removed_spans ("first:end" word numbers, comma-joined)
    and, on request, kept_text."""
    base, n_blocks = c.blocked(docs, id_col, text_col, block_bytes)

    def match(pdf: pd.DataFrame):
        number: dict[bytes, int] = {}
        streams = [[number.setdefault(w, len(number)) for w in x.split()] for x in pdf["bytes"]]
        ids = pdf["value"].tolist()
        shard = SuffixAutomaton()
        for s, d in zip(streams, ids):
            shard.add(s, d)
        shard.finish()
        for s, d, block, whole, off in zip(streams, ids, pdf["block"].tolist(), pdf["whole"].tolist(), pdf["off"].tolist()):
            for end, least in shard.matches(s, window):
                if least < d:
                    yield block, whole, off + end - window + 1

    def finish(texts, ids, starts) -> pd.DataFrame:
        out = []
        for i, t in enumerate(texts):
            words, spans, removed = t.split(), "", 0
            total = len(words)
            if i in starts:
                cover = c.covered(starts[i], window, total)
                removed = int(cover.sum())
                edge = np.flatnonzero(np.diff(cover.view(np.int8), prepend=0, append=0))
                spans = ",".join(f"{x}:{y}" for x, y in zip(edge[0::2], edge[1::2]))
                words = [w for w, gone in zip(words, cover.tolist()) if not gone]
            kept = b" ".join(words)
            row = (int(ids[i]), total, removed, hashlib.sha256(kept).hexdigest(), spans)
            out.append(row + (kept.decode("utf-8", "surrogatepass"),) if with_text else row)
        return pd.DataFrame(out, columns=["doc", "n_words", "n_removed", "kept_sha256", "removed_spans"] + ["kept_text"] * with_text)

    words = Units(window, gram, c.word_units, bytes.split, b" ".join)
    schema = "doc long, n_words long, n_removed long, kept_sha256 string, removed_spans string" + ", kept_text string" * with_text
    return shared_windows(base, n_blocks, words, True, match, finish, schema, crowd, block_crowd)


def remove_shared_substrings(docs: DataFrame, id_col="doc_id", text_col="text", window=WINDOW) -> DataFrame:
    """Documents (id, text) without the removed words; kept words are joined by one space."""
    out = find_removed(docs, id_col, text_col, window, with_text=True)
    return out.select(c.real_id().alias(id_col), F.col("kept_text").alias(text_col))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return find_removed(docs).select(c.real_id().alias("doc_id"), "n_words", "n_removed", "kept_sha256", "removed_spans")
