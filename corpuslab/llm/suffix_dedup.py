"""Suffix-array dedup: a logarithmic family of suffix arrays.

A string is ``length`` bytes of one document (UTF-8; null text: empty). Every byte goes that is
covered by a string which also starts anywhere else in the corpus, the same document included;
strings are judged on the input.

The index is cut by content (``passages``): a shard indexes the suffixes of the passages whose
anchor falls to it. Inside a shard, passages arrive in batches: a batch gets a suffix array (ordered
by the first ``length`` bytes), is scanned against the sorted arrays of all levels for matches of
``length`` bytes, and becomes a level; two levels of equal size merge into one of twice the size.

Defined results: null or empty text, or fewer bytes than a string: nothing removed. Rows that repeat
each other are copies and lose all strings. A null id is an id like others. An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import common as c
from corpuslab.llm.passages import BLOCK_CROWD, CROWD, Units, shared_windows

LENGTH, GRAM = 200, 64
BATCH = 1 << 14  # suffixes of a new batch


class IndexFamily:
    """Suffix arrays of doubling sizes over numbered suffixes of ``length`` bytes."""

    def __init__(self, length: int, total: int):
        self.length, self.levels = length, []  # a level: (doublings, text, suffix starts in order, their numbers)
        self.seen = np.zeros(total, dtype=bool)  # suffixes that occur at another place too

    def _keys(self, text, starts):
        rows = np.lib.stride_tricks.sliding_window_view(text, self.length)[starts]
        return np.ascontiguousarray(rows).view(f"S{self.length}").ravel()

    def add(self, text: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> None:
        keys = self._keys(text, starts)
        order = np.argsort(keys, kind="stable")
        keys, starts, numbers = keys[order], starts[order], numbers[order]
        twin = keys[1:] == keys[:-1]
        self.seen[numbers[1:][twin]] = True
        self.seen[numbers[:-1][twin]] = True
        for _, level_text, level_starts, level_numbers in self.levels:
            level_keys = self._keys(level_text, level_starts)
            place = np.minimum(np.searchsorted(level_keys, keys), len(level_keys) - 1)
            same = level_keys[place] == keys
            self.seen[numbers[same]] = True
            self.seen[level_numbers[place[same]]] = True  # its equals in the level met before
        self.levels.append((0, text, starts, numbers))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            rank, t2, s2, n2 = self.levels.pop()
            _, t1, s1, n1 = self.levels.pop()
            text, starts, numbers = np.r_[t1, t2], np.r_[s1, s2 + len(t1)], np.r_[n1, n2]
            order = np.argsort(self._keys(text, starts), kind="stable")  # two sorted runs: a merge
            self.levels.append((rank + 1, text, starts[order], numbers[order]))


def find_removed(docs: DataFrame, id_col="doc_id", text_col="text", length=LENGTH, gram=GRAM, batch=BATCH, with_text=False,
                 block_bytes=c.BLOCK_BYTES, crowd=CROWD, block_crowd=BLOCK_CROWD) -> DataFrame:
    """doc, n_bytes, n_removed, n_spans, kept_sha256, removed_spans ("first:end" byte offsets,
    comma-joined) and, on request, kept_text (the remaining bytes without characters that lost some)."""
    base, n_blocks = c.blocked(docs, id_col, text_col, block_bytes)

    def match(pdf: pd.DataFrame):
        if not len(pdf):
            return
        strings = [np.frombuffer(x, np.uint8) for x in pdf["bytes"]]
        windows = np.array([len(x) - length + 1 for x in strings])
        first = np.cumsum(windows) - windows  # number of a passage's first suffix
        family = IndexFamily(length, int(windows.sum()))
        at = 0
        while at < len(strings):
            end = at + 1
            while end < len(strings) and first[end] + windows[end] - first[at] <= batch:
                end += 1
            offsets = np.cumsum([0] + [len(x) for x in strings[at:end]])
            starts = np.concatenate([o + np.arange(w) for o, w in zip(offsets, windows[at:end])])
            family.add(np.concatenate(strings[at:end]), starts, np.arange(first[at], first[at] + windows[at:end].sum()))
            at = end
        blocks, whole, off, done = (pdf[x].tolist() for x in ("block", "whole", "off", "value"))
        found = np.flatnonzero(family.seen)
        owner = np.searchsorted(first, found, side="right") - 1
        for i, s in zip(owner.tolist(), (found - first[owner]).tolist()):
            if done[i] < 2:
                yield blocks[i], whole[i], off[i] + s

    def finish(texts, ids, starts) -> pd.DataFrame:
        out = []
        for i, t in enumerate(texts):
            kept, removed, spans = t, 0, ""
            edge = np.zeros(0)
            if i in starts:
                cover = c.covered(starts[i], length, len(t))
                removed = int(cover.sum())
                edge = np.flatnonzero(np.diff(cover.view(np.int8), prepend=0, append=0))
                spans = ",".join(f"{x}:{y}" for x, y in zip(edge[0::2], edge[1::2]))
                kept = np.frombuffer(t, np.uint8)[~cover].tobytes()
            row = (int(ids[i]), len(t), removed, len(edge) // 2, hashlib.sha256(kept).hexdigest(), spans)
            out.append(row + (kept.decode("utf-8", "ignore"),) if with_text else row)
        return pd.DataFrame(out, columns=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed_spans"] + ["kept_text"] * with_text)

    def hashes(texts):
        return c.byte_values(b"".join(texts)), np.cumsum([0] + [len(t) for t in texts])

    units = Units(length, gram, hashes, bytes, bytes)
    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed_spans string" + ", kept_text string" * with_text
    return shared_windows(base, n_blocks, units, False, match, finish, schema, crowd, block_crowd)


def remove_repeated_bytes(docs: DataFrame, id_col="doc_id", text_col="text", length=LENGTH) -> DataFrame:
    """Documents (id, text) without the repeated bytes; a character cut in two is dropped."""
    out = find_removed(docs, id_col, text_col, length, with_text=True)
    return out.select(c.real_id().alias(id_col), F.col("kept_text").alias(text_col))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return find_removed(docs).select(c.real_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed_spans")
