"""Helpers shared by the operators of this subpackage.

* text units: words (``[^\\x20\\x09-\\x0D]+``) and bytes, hashed in numpy for a batch of texts;
* anchors: window minimizers, which send equal windows of any two documents to the same key;
* blocks: documents dealt by a hash into pieces of bounded size;
* connected components of a link table, by joins only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.session import ensure_checkpoint_dir

NULL_ID = 9223372036854775807  # stands for a null id inside an operator: later than every real id
CHUNK_BYTES = 1 << 18  # texts hashed together
BLOCK_BYTES = 8 << 20  # text of a block of documents

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _powers(n: int):
    if len(_POWERS[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        for i, b in enumerate((_BASE, _INV)):
            p = np.full(size, b, dtype=_U)
            p[0] = 1
            _POWERS[i] = np.cumprod(p)
    return _POWERS


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; ``span_hash`` reads the hash of any span from it."""
    power = _powers(len(values) + 1)[0]
    out = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * power[: len(values)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the unit sequences [start, end): equal sequences, equal hashes."""
    inverse = _powers(len(pre))[1]
    return mix((pre[end] - pre[start]) * inverse[start] + (end - start).astype(_U) * _U(0xA24BAED4963EE407))


def byte_values(buf: bytes) -> np.ndarray:
    return _BYTE[np.frombuffer(buf, dtype=np.uint8)]


def word_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in one array, and the bounds of each text in it."""
    buf = b"\n".join(texts) + b"\n"
    arr = np.frombuffer(buf, dtype=np.uint8)
    word = ~_SPACE[arr]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0))
    start, end = edge[0::2], edge[1::2]
    ends_at = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    bounds[1:] = np.searchsorted(start, ends_at)
    return span_hash(prefix(_BYTE[arr]), start, end), bounds


def chunks(texts: list[bytes], size: int = CHUNK_BYTES):
    """(first, last) positions of consecutive texts of about ``size`` bytes together."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t) + 1
        if total >= size:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def encode(texts) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def anchors(values: np.ndarray, bounds: np.ndarray, window: int, gram: int):
    """Runs of consecutive windows that choose the same minimizer.

    Each window of ``window`` units chooses its smallest hashed ``gram``-gram, the leftmost of
    equal ones. Equal windows choose the same gram at the same place, so they meet under its
    hash. Returns for each run: text number, first window (from the text's start), number of
    windows (at most window - gram + 1), gram hash and hash of the run's whole unit sequence."""
    n, width = len(values), window - gram + 1
    empty = np.zeros(0, dtype=np.int64)
    if n < window:
        return empty, empty, empty, empty.astype(_U), empty.astype(_U)
    pre = prefix(values)
    at = np.arange(n - gram + 1)
    hashed = span_hash(pre, at, at + gram)
    bits = _U(int(n).bit_length())
    low = ((hashed >> bits) << bits) | at.astype(_U)
    reach = 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    place = (low & ((_U(1) << bits) - _U(1))).astype(np.int64)
    lens = np.diff(bounds)
    text_end = np.repeat(bounds[1:], lens)[: n - window + 1]
    starts = np.flatnonzero(np.arange(n - window + 1) + window <= text_end)
    if not len(starts):
        return empty, empty, empty, empty.astype(_U), empty.astype(_U)
    place = place[starts]
    head = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    count = np.diff(np.r_[head, len(place)])
    first = starts[head]
    text = np.searchsorted(bounds, first, side="right") - 1
    whole = span_hash(pre, first, first + count - 1 + window)
    return text, first - bounds[text], count, hashed[place[head]], whole


def group_starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new key begins in arrays sorted together."""
    new = np.zeros(len(sorted_keys[0]), dtype=bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n units are covered by windows of a length at these starts."""
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, n), -1)
    return np.cumsum(step[:-1]) > 0


def pack(**columns) -> pd.DataFrame:
    return pd.DataFrame(columns)


def blocked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES):
    """(id, text, block) and the number of blocks: as many as the texts fill, so that a block stays
    of one size whatever the input. Rows are dealt by id and text: a null id is no hot block."""
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.col(text_col).cast("string").alias("text"))
    total = base.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    return base.withColumn("block", F.pmod(F.xxhash64("doc", F.octet_length("text"), F.crc32(F.coalesce("text", F.lit("")))), F.lit(n)).cast("int")), n


def real_id(column: str = "doc"):
    return F.when(F.col(column) != NULL_ID, F.col(column))


def checkpointed(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Checkpoints that are deleted once what was made from them is itself on disk."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.tables.append(checkpointed(df))
        return self.tables[-1]

    def release(self) -> None:
        for df in self.tables:
            file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
            if file.isDefined():
                path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
        self.tables = []


def fresh(taken, name: str) -> str:
    """``name``, or the first of name_1, name_2, ... that is no column yet."""
    taken, k, out = {x.lower() for x in taken}, 0, name
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def shielded(docs: DataFrame, own) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with every column that an operator doesn't name (``own``) under a name that no operator uses,
    and the names to go back to: columns of a user pass through, whatever they are called."""
    own = {x.lower() for x in own}
    prefix = "user column"
    while any(x.lower().startswith(prefix) for x in docs.columns):
        prefix = f"other {prefix}"
    away = {x: f"{prefix} {i}" for i, x in enumerate(docs.columns) if x.lower() not in own}
    return docs.withColumnsRenamed(away), {v: k for k, v in away.items()}


def components(links: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable over links (a, b); ids without a link don't appear.

    Every id holds the smallest id known to it, takes over the smallest one its neighbours hold and
    then the one that this id holds (which doubles the distance covered), until nothing moves. A
    grouped minimum and joins: no neighbour list is gathered, and a centre of millions of links is
    an ordinary skewed join between checkpointed tables."""
    edges, last = Scratch(), Scratch()
    e = links.where("a <> b").select("a", "b")
    e = edges(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    held = last(e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("held")).withColumnRenamed("a", "id"))
    while True:
        now, between = Scratch(), Scratch()
        near = e.join(held, e["b"] == held["id"]).groupBy("a").agg(F.min("held").alias("near"))
        step = between(held.join(near, F.col("id") == F.col("a")).select("id", F.col("held").alias("old"), F.least("held", "near").alias("held")))
        far = step.select(F.col("id").alias("far_id"), F.col("held").alias("far"))
        moved = now(step.join(far, F.col("held") == F.col("far_id")).select("id", F.col("far").alias("held"), (F.col("far") != F.col("old")).alias("moved")))
        held = moved.select("id", "held")
        between.release()
        last.release()
        last = now
        if not moved.where("moved").take(1):
            edges.release()
            return held.withColumnRenamed("held", "component")
