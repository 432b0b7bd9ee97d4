"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows.

Text is normalised (A-Z lower-cased; words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` joined by one
space) and scanned once; a match is mapped back to word numbers and to character offsets of the
original text. A window is ``window`` consecutive words of an item; an item of fewer words, but not
none, is one window. A document word inside any occurrence of a window is hit.

The benchmark is sent to all executors in blocks of at most ``block_bytes`` of text, whose size is
summed before anything is collected; a larger benchmark takes one scan for each block.

Defined results: null or empty text: no words, no hits, the hash of the empty string. Items with a
null text or id give no windows. Items of the same text are all counted; items that repeat an id
count once. Empty tables: no hits, or no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import common as c

WINDOW, BLOCK_BYTES = 10, 2 << 20
_PLAIN = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or 48 <= x <= 57 or x > 127 else 32 for x in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")  # before lower-casing


def words_of(text) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split() if isinstance(text, str) else []


def _line(words: list[bytes]) -> str:
    return f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "


def _automaton(items: list[tuple[str, str]], window: int):
    """Windows of all items: text with a space on each side -> (number of words, item ids)."""
    found: dict[str, tuple[int, set]] = {}
    for item, text in items:
        words = words_of(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            found.setdefault(_line(words[i : i + n]), (n, set()))[1].add(item)
    auto = ahocorasick.Automaton()
    for k, (n, ids) in found.items():
        auto.add_word(k, (n, tuple(sorted(ids))))
    if found:
        auto.make_automaton()
    return auto


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).dropna()
    total = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    n = max(1, math.ceil(2 * total / block_bytes)) if total > block_bytes else 1
    for i in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
        yield [(r["item"], r["text"]) for r in block.toLocalIterator()]


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col="text", item_col="item_id", item_text="text",
              window=WINDOW, block_bytes=BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, hit_words (packed numbers of hit words) and hit_items (ids) in three
    columns named ``_n_words, _hit_words, _hit_items``."""
    out = docs.withColumns({"_n_words": F.lit(0).cast("long"), "_hit_words": F.lit(b""), "_hit_items": F.array().cast("array<string>")})
    schema = out.schema
    spark = docs.sparkSession
    for i, items in enumerate(_item_blocks(benchmark, item_col, item_text, block_bytes)):
        sent = spark.sparkContext.broadcast(items)

        def scan(batches, sent=sent):
            auto = _automaton(sent.value, window)
            for pdf in batches:
                n_words, hit_words, hit_items = [], [], []
                for text, before, ids in zip(pdf[text_col], pdf["_hit_words"], pdf["_hit_items"]):
                    words = words_of(text)
                    n_words.append(len(words))
                    found = list(auto.iter(_line(words))) if words and len(auto) else []
                    if found:
                        # a match ends with the space after its last word
                        ends = np.cumsum([len(w.decode("utf-8", "surrogatepass")) + 1 for w in words])
                        last = np.searchsorted(ends, [e for e, _ in found])
                        hit = {int(x) - k for x, (_, (n, _)) in zip(last, found) for k in range(n)}
                        before = np.array(sorted(hit | set(np.frombuffer(before, np.int32).tolist())), np.int32).tobytes()
                        ids = sorted(set(ids) | {x for _, (_, y) in found for x in y})
                    hit_words.append(before)
                    hit_items.append(ids)
                yield pdf.assign(_n_words=n_words, _hit_words=hit_words, _hit_items=hit_items)

        out = (c.checkpointed(out) if i else out).mapInPandas(scan, schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans ("start:end" character
    offsets of the runs of hit words in the original text, comma-joined)."""
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    id_type = base.schema["_id"].dataType.simpleString()

    def digest(batches):
        for pdf in batches:
            rows = []
            for text, n, hit, ids in zip(pdf["text"], pdf["_n_words"], pdf["_hit_words"], pdf["_hit_items"]):
                hit = np.frombuffer(hit, np.int32)
                spans = ""
                if len(hit):
                    at = [m.span() for m in _WORD.finditer(text)]
                    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
                    spans = ",".join(f"{at[r[0]][0]}:{at[r[-1]][1]}" for r in runs)
                rows.append((n, len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0, spans))
            out = pd.DataFrame(rows, columns=["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"])
            out.insert(0, "_id", pdf["_id"].to_numpy() if len(pdf) else [])
            yield out

    schema = f"_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans string"
    return find_hits(base, benchmark, **options).mapInPandas(digest, schema).withColumnRenamed("_id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col="text", **options) -> DataFrame:
    """Documents without any hit, columns as they are, whatever their names."""
    rows, names = c.shielded(docs, (text_col,))
    clean = find_hits(rows, benchmark, text_col, **options).where(F.octet_length("_hit_words") == 0).select(*[f"`{x}`" for x in rows.columns])
    return clean.withColumnsRenamed(names)


def query(spark, sf_dir: str) -> DataFrame:
    sf = sf_dir.rstrip("/")
    return contamination(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
