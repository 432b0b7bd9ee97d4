"""Which windows of a text occur elsewhere: the exchange under substring and suffix-array dedup.

Texts are sequences of units (words or bytes). Sending every index to every document would cost
documents x indexes, so the corpus is cut by content: windows that are equal choose the same anchor
(``common.anchors``), and only passages around one anchor have to be compared.

1. ``request``: a block of documents lists its passages: anchor hash, hash of the whole passage and
   one value (the smallest document, or the number of places up to 2). Thousands of copies in a
   block are one row. An anchor with more than ``crowd`` different passages sends one row in all.
2. ``settle``: anchors meet in buckets. Equal passages are settled at once; passages that share an
   anchor but differ are called for. An anchor with very many passages is a crowd.
3. ``cite``: blocks send the called passages, one instance of each, to the shard of their anchor;
   passages of a crowd are cut into single windows that go to the shard of their own hash, one
   instance a block, so that no anchor and no window gathers an unbounded group.
4. ``match``: the operator's own index (automaton, suffix arrays) of the shard answers which windows
   occur elsewhere.
5. ``finish``: blocks put the answers together and the operator rewrites its documents.

The text moves once: the exchange by block is the same in steps 1, 3 and 5 and Spark reuses it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import common as c

CROWD = 4096  # different passages of an anchor that one shard takes together
BLOCK_CROWD = 256  # the same in one block
ANSWER = "block int, kind int, whole binary, value binary"
SETTLED, CALLED, CALLED_ANCHOR, PARTLY = 0, 1, 2, 3
_NO = np.zeros(0, dtype=np.int64)


@dataclass(frozen=True)
class Units:
    """How texts are cut: unit hashes of a batch of texts, and the bytes of a span of units."""

    window: int
    gram: int
    hashes: Callable  # list of texts -> (unit hashes, bounds)
    cut: Callable  # text -> sequence of units
    join: Callable  # span of units -> bytes


def block_anchors(texts, u: Units):
    """Text number, first window, windows, anchor hash and passage hash of a block's anchors."""
    parts = []
    for first, last in c.chunks(texts):
        values, bounds = u.hashes(texts[first:last])
        text, a, n, h, whole = c.anchors(values, bounds, u.window, u.gram)
        parts.append((text + first, a, n, h, whole))
    if not parts:
        return _NO, _NO, _NO, _NO.astype(np.uint64), _NO.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _passages(texts, ids, u: Units, smaller: bool):
    """All anchors of a block, and its different passages: hash, anchor, value, one instance."""
    found = text, a, n, h, whole = block_anchors(texts, u)
    order = np.lexsort((ids[text], whole))
    head = c.group_starts(whole[order])
    value = ids[text[order[head]]] if smaller else np.minimum(np.diff(np.r_[head, len(order)]), 2)
    at = order[head]
    return found, whole[at], h[at], value, at


def _by(keys: np.ndarray, *columns):
    """(key, columns) for each key."""
    order = np.argsort(keys, kind="stable")
    if len(order):
        for i in np.split(order, c.group_starts(keys[order])[1:]):
            yield (int(keys[i[0]]), *(x[i].tobytes() for x in columns))


def _column(pdf, name, kind=np.uint64):
    return np.concatenate([np.frombuffer(x, kind) for x in pdf[name]]) if len(pdf) else np.zeros(0, kind)


def _in(values: np.ndarray, table: np.ndarray):
    """Place in a sorted table, and whether the value is there."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    place = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return place, table[place] == values


def shared_windows(base: DataFrame, n_blocks: int, u: Units, smaller: bool, match: Callable, finish: Callable, schema: str,
                   crowd: int = CROWD, block_crowd: int = BLOCK_CROWD) -> DataFrame:
    """``smaller``: a window counts if it also starts in a document with a smaller id; else if it
    also starts at any other place. ``match(rows)`` gets the passages of a shard (columns block,
    whole, value, off, bytes) and yields (block, whole, offset of a counting window).
    ``finish(texts, ids, {text number: counting window starts})`` makes the result rows."""

    def request(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["doc"].to_numpy()
        _, whole, h, value, _ = _passages(c.encode(pdf["text"]), ids, u, smaller)
        order = np.argsort(h, kind="stable")
        whole, h, value = whole[order], h[order], value[order]
        head = c.group_starts(h)
        size = np.diff(np.r_[head, len(h)])
        many = size > block_crowd
        lone = ~np.repeat(many, size)  # whole 0 stands for a crowd
        h2 = np.r_[h[lone], h[head[many]]]
        whole = np.r_[whole[lone], np.zeros(many.sum(), np.uint64)]
        value = np.r_[value[lone], np.zeros(many.sum(), np.int64)]
        bucket = ((h2 >> np.uint64(16)) % np.uint64(n_blocks)).astype(np.int64)
        rows = [(b, int(key[0]), x, y, z) for b, x, y, z in _by(bucket, h2, whole, value)]
        return pd.DataFrame(rows, columns=["bucket", "block", "h", "whole", "value"])

    def settle(key, pdf: pd.DataFrame) -> pd.DataFrame:
        h, whole, value = _column(pdf, "h"), _column(pdf, "whole"), _column(pdf, "value", np.int64)
        block = np.repeat(pdf["block"].to_numpy(), [len(x) // 8 for x in pdf["h"]])
        order = np.lexsort((value, whole, h))
        h, whole, value, block = h[order], whole[order], value[order], block[order]
        mark = whole == 0
        head = c.group_starts(h, whole)  # one for each passage, for "smaller" at its smallest document
        size = np.diff(np.r_[head, len(h)])
        anchor = c.group_starts(h[head])
        passages = np.diff(np.r_[anchor, len(head)])
        crowded = np.logical_or.reduceat(mark[head], anchor) | (passages > crowd)
        if smaller:
            done = np.repeat(size > 1, size) & ~mark
            told = np.repeat(value[head], size)
            open_ = np.ones(len(head), bool)
        else:
            total = np.add.reduceat(value, head)
            done = np.repeat(total > 1, size) & ~mark
            told = np.zeros(len(h), np.int64)
            open_ = total < 2
        wanted = np.repeat(((passages > 1) & np.logical_or.reduceat(open_, anchor)) | crowded, passages) & ~mark[head]
        called = head[wanted]
        flag = np.repeat(crowded, passages)[wanted].astype(np.int64) + 2 * (~open_[wanted]).astype(np.int64)
        rows = [(b, SETTLED, x, y) for b, x, y in _by(block[done], whole[done], told[done])]
        rows += [(b, CALLED, x, y) for b, x, y in _by(block[called], whole[called], flag)]
        rows += [(b, CALLED_ANCHOR, x, b"") for b, x in _by(block[mark], h[mark])]
        return pd.DataFrame(rows, columns=["block", "kind", "whole", "value"])

    def cite(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["shard", "block", "whole", "value", "off", "bytes"]
        calls, marks = right[right["kind"] == CALLED], right[right["kind"] == CALLED_ANCHOR]
        if not len(left) or not len(calls) and not len(marks):
            return pd.DataFrame({x: [] for x in columns})
        want, flag = _column(calls, "whole"), _column(calls, "value", np.int64)
        order = np.argsort(want)
        want, flag = want[order], flag[order]
        texts = c.encode(left["text"])
        (text, a, n, _, _), whole, h, value, at = _passages(texts, left["doc"].to_numpy(), u, smaller)
        place, called = _in(whole, want)
        marked = _in(h, np.sort(_column(marks, "whole")))[1]
        rows, seen, last, units = [], {}, -1, ()
        hit = np.flatnonzero(called | marked)
        hit = hit[np.lexsort((text[at[hit]], value[hit] if smaller else hit * 0))]
        for i in hit.tolist():
            k = at[i]
            if text[k] != last:
                last, units = text[k], u.cut(texts[text[k]])
            name, v, first = whole[i].astype(np.int64), int(value[i]), int(a[k])
            if not smaller:
                v = 2 if called[i] and flag[place[i]] & 2 else v
            if not marked[i] and not flag[place[i]] & 1:
                rows.append((h[i].astype(np.int64), int(key[0]), name, v, 0, u.join(units[first : first + int(n[k]) + u.window - 1])))
                continue
            for off in range(int(n[k])):
                one = u.join(units[first + off : first + off + u.window])
                shard = int.from_bytes(hashlib.blake2b(one, digest_size=8).digest(), "little", signed=True)
                if shard not in seen:
                    seen[shard] = len(rows)
                    rows.append((shard, int(key[0]), name, v, off, one))
                elif smaller:
                    less = rows[seen[shard]][3] < v  # then known here: no bytes, and any shard hands it back
                    rows.append((name if less else shard, int(key[0]), name, v, off, None if less else one))
                else:  # two places of one block: both count
                    rows.append((name, int(key[0]), name, v, off, None))
                    f = rows[seen[shard]]
                    if f[3] < 2:
                        rows.append((f[2], f[1], f[2], f[3], f[4], None))
                        rows[seen[shard]] = (*f[:3], 2, *f[4:])
        return pd.DataFrame(rows, columns=columns)

    def answer(key, pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf["bytes"].isna()
        got: dict[int, tuple[list, list]] = {}
        for b, whole, off in zip(pdf["block"][known].tolist(), pdf["whole"][known].tolist(), pdf["off"][known].tolist()):
            x = got.setdefault(b, ([], []))
            x[0].append(whole), x[1].append(off)
        for b, whole, off in match(pdf[~known]):
            x = got.setdefault(b, ([], []))
            x[0].append(whole), x[1].append(off)
        rows = [(b, PARTLY, np.array(x, np.int64).tobytes(), np.array(y, np.int64).tobytes()) for b, (x, y) in got.items()]
        return pd.DataFrame(rows, columns=["block", "kind", "whole", "value"])

    def conclude(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        texts, ids = c.encode(left["text"]), left["doc"].to_numpy()
        (text, a, n, _, full), whole, _, value, _ = _passages(texts, ids, u, smaller)
        _, inverse = np.unique(full, return_inverse=True)  # in the order of ``whole``
        value = value.copy()
        partly = []
        for kind, x, y in zip(right["kind"], right["whole"], right["value"]):
            place, there = _in(np.frombuffer(x, np.uint64), whole)
            place, y = place[there], np.frombuffer(y, np.int64)[there]
            if kind == SETTLED and smaller:
                np.minimum.at(value, place, y)
            elif kind == SETTLED:
                value[place] = 2
            else:
                partly.append((place, y))
        gone = value[inverse] < ids[text] if smaller else value[inverse] > 1
        starts = [np.zeros((2, 0), np.int64)]
        run = np.flatnonzero(gone)
        starts.append(np.stack([text[run].repeat(n[run]), a[run].repeat(n[run]) + _counting(n[run])]))
        if partly:
            place, off = (np.concatenate(x) for x in zip(*partly))
            order = np.argsort(place, kind="stable")
            place, off = place[order], off[order]
            rest = np.flatnonzero(~gone)
            low, high = np.searchsorted(place, inverse[rest]), np.searchsorted(place, inverse[rest], side="right")
            pick = low.repeat(high - low) + _counting(high - low)
            starts.append(np.stack([text[rest].repeat(high - low), a[rest].repeat(high - low) + off[pick]]))
        t, s = np.concatenate(starts, axis=1)
        order = np.argsort(t, kind="stable")
        t, s = t[order], s[order]
        head = c.group_starts(t)
        return finish(texts, ids, dict(zip(t[head].tolist(), np.split(s, head[1:]))))

    asked = base.groupBy("block").applyInPandas(request, "bucket long, block int, h binary, whole binary, value binary")
    settled = asked.groupBy("bucket").applyInPandas(settle, ANSWER)
    cited = base.groupBy("block").cogroup(settled.groupBy("block")).applyInPandas(
        cite, "shard long, block int, whole long, value long, off int, bytes binary")
    shards = cited.withColumn("shard", F.pmod(F.xxhash64("shard"), F.lit(4 * n_blocks)))
    told = settled.where(F.col("kind") == SETTLED).union(shards.groupBy("shard").applyInPandas(answer, ANSWER))
    return base.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(conclude, schema)


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... below each size, one after another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
