"""k-gram counts and held-out look-ups in packed slices: one exchange of packed grams an order.

Nearly every k-gram of a corpus is distinct, so counting them row by row exchanges about as many rows as the corpus
has tokens, three times over (counts, context totals, held-out joins). Here a task turns the id arrays of about
``CHUNK`` tokens into grams with numpy, adds equal ones up and deals them into slices by a hash of their context;
a slice of a chunk is one row, its columns packed as planes of bytes (which shuffle compression shrinks well).
A slice holds every training and held-out gram of its contexts, so counts, context totals, the argmax and the
held-out look-ups come from one sort of it. Grams dealt by the last ``by`` ids of their context serve all orders from
``by`` to ``k`` by the same exchange.

Models are orders ``k`` with variants: block sizes that a context doesn't reach across (None: whole documents). Grams of
all variants share a row with one count each. Null ids of documents stay null.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 1_000_000  # positions that a task adds up together
SLICE = 1_000_000  # grams of a slice on average
_NO_DOC = -(1 << 63)  # a null document id inside a slice
_U = np.uint64
_DEALT = "slice int, held boolean, n int, cols array<binary>"


def _planes(x: np.ndarray) -> bytes:
    x = np.ascontiguousarray(x)
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T), codec="zstd", asbytes=True)


def _values(parts, sizes, dtype) -> np.ndarray:
    size, out = np.dtype(dtype).itemsize, []
    for p, n in zip(parts, sizes):
        raw = pa.decompress(p, decompressed_size=int(n) * size, codec="zstd", asbytes=True)
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1))
    return np.concatenate(out) if out else np.zeros(0, dtype)


def _heads(cols) -> np.ndarray:
    new = np.zeros(len(cols[0]), bool)
    new[:1] = True
    for x in cols:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers (``np.unique`` hashes them, which takes twenty times as long)."""
    x = np.sort(x)
    return x[_heads([x])]


def _slice_of(ctx, slices: int) -> np.ndarray:
    h = np.zeros(len(ctx[0]), _U)
    for x in ctx:
        h = (h ^ x.astype(_U)) * _U(0x9E3779B97F4A7C15)
        h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(32)
    return (h % _U(slices)).astype(np.int32)


def _hot_at(ctx, hot) -> np.ndarray:
    """Place in ``hot`` of the last two ids of each context, -1 if they are not heavy."""
    code = (ctx[-2].astype(np.int64) << 32) | ctx[-1]
    at = np.minimum(np.searchsorted(hot[0], code), len(hot[0]) - 1)
    return np.where(hot[0][at] == code, at, -1)


def _packed(ctx, nxt, counts, doc, held: bool, slices: int, by: int, spread: bool = False, hot=None) -> pd.DataFrame:
    """Equal grams added up; one row a slice: contexts, next id, counts and (held-out grams) the document. ``spread``: slices
    are of whole grams, not of contexts."""
    if len(ctx) == 1 and not held:  # a pair is one number, which sorts several times as fast
        code = (ctx[0].astype(np.int64) << 32) | nxt
        order = np.argsort(code)
        head = _heads([code[order]])
        sums = [np.add.reduceat(n[order], head) if len(head) else n for n in counts]
        key = [x[order[head]] for x in (*ctx, nxt)]
        part = _slice_of(key if spread else key[:1], slices)
        order = np.argsort(part.astype(np.int16) if slices < 1 << 15 else part, kind="stable")
        key, sums = [part[order], *[x[order] for x in key]], [n[order] for n in sums]
        head = np.arange(len(order))
    else:
        part = _slice_of([*ctx, nxt] if spread else ctx[-by:], slices)
        if hot is not None and not spread:  # pieces of a heavy context by the whole context
            at = _hot_at(ctx, hot)
            part = np.where(at >= 0, (part + _slice_of(ctx, 1 << 30) % hot[1][at]) % slices, part).astype(np.int32)
        key = [part, *ctx, nxt] + ([doc] if held else [])
        order = np.lexsort(key[::-1])
        key = [x[order] for x in key]
        head = _heads(key) if len(order) else np.zeros(0, np.int64)
        sums = [np.add.reduceat(n[order], head) if len(head) else n for n in counts]
        key = [x[head] for x in key]
    cols = [*key[1 : len(ctx) + 2], *sums, *key[len(ctx) + 2 :]]
    at = np.flatnonzero(np.r_[True, key[0][1:] != key[0][:-1]]) if len(head) else np.zeros(0, np.int64)
    ends = np.r_[at[1:], len(head)]
    return pd.DataFrame({"slice": key[0][at], "held": held, "n": ends - at, "cols": [[_planes(x[a:b]) for x in cols] for a, b in zip(at, ends)]})


def _grams(ids: list[np.ndarray], k: int, block: int | None):
    """Positions that have a next id: contexts (nearest last), next ids and the number of the array of each."""
    lens = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate(ids).astype(np.int32)
    text = np.repeat(np.arange(len(ids)), lens)
    back = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)  # tokens before it in its document
    real = back < lens[text] - 1
    if block:
        real &= (back + 1) % block != 0
        back = back % block
    at = np.flatnonzero(real)
    ctx = [np.where(back[at] >= d, flat[np.maximum(at - d, 0)], np.int32(0)) for d in range(k - 1, -1, -1)]
    return ctx, flat[at + 1], text[at]


def slices_for(ids: DataFrame) -> int:
    total = ids.agg(F.sum(F.size("ids").cast("long"))).first()[0] or 0
    return max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / SLICE))


def deal(ids: DataFrame, k: int, slices: int, blocks: Sequence[int | None] = (None,), by_doc: bool = False, by: int | None = None, spread: bool = False, hot=None, only_hot: bool = False) -> DataFrame:
    """Packed grams of (doc_id, split, ids); ``split`` is 'val' for held-out documents. ``by_doc`` keeps the document
    of held-out grams. ``by`` is the shortest order that the slices serve (k if not given). ``spread`` grams are for ``merged``. Grams of the
    last two ids in ``hot`` (``heavy``) go into pieces; with ``only_hot`` there are no others."""

    def flush(rows):
        for held in (False, True):
            mine = [(d, x) for d, v, x in rows if v == held]
            if not mine:
                continue
            docs = np.array([d for d, _ in mine], np.int64)
            made = [_grams([x for _, x in mine], k, b) for b in blocks]
            size = [len(nxt) for _, nxt, _ in made]
            ctx = [np.concatenate([m[0][j] for m in made]) for j in range(k)]
            nxt = np.concatenate([m[1] for m in made])
            text = np.concatenate([m[2] for m in made])
            counts = [np.repeat(np.arange(len(blocks)) == w, size).astype(np.int64) for w in range(len(blocks))]
            of = docs[text] if by_doc else np.zeros(len(nxt), np.int64)
            if only_hot:
                mine = np.flatnonzero(_hot_at(ctx, hot) >= 0)
                ctx, nxt, counts, of = [x[mine] for x in ctx], nxt[mine], [n[mine] for n in counts], of[mine]
            if len(nxt):
                yield _packed(ctx, nxt, counts, of, held, slices, by or k, spread, hot)

    def run(batches):
        rows, total = [], 0
        for pdf in batches:
            for d, v, x in zip(pdf["doc"], pdf["held"], pdf["ids"]):
                rows.append((d, v, x))
                total += len(x) * len(blocks)
                if total >= CHUNK:
                    yield from flush(rows)
                    rows, total = [], 0
        yield from flush(rows)

    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_DOC)) if by_doc else F.lit(0).cast("long")
    return ids.where(F.size("ids") > 1).select(doc.alias("doc"), (F.col("split") == "val").alias("held"), "ids").mapInPandas(run, _DEALT)


def merged(dealt: DataFrame, k: int, slices: int, w: int = 1) -> DataFrame:
    """Grams that were dealt ``spread``, added up over all tasks and dealt by their context. A slice then holds each gram of
    its contexts once, as many as the vocabulary has at most after a hot one, and not once for each million positions."""

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for held in (False, True):
            mine = pdf[pdf["held"] == held]
            if len(mine):
                ctx, nxt, counted, doc, _ = _unpacked(mine, k, w)
                out.append(_packed(ctx, nxt, counted, doc if held else np.zeros(len(nxt), np.int64), held, slices, k))
        return pd.concat(out)

    return dealt.groupBy("slice").applyInPandas(add, _DEALT)


def pairs(ids: DataFrame, slices: int, blocks: Sequence[int | None] = (None,), by_doc: bool = False) -> DataFrame:
    """Packed grams of order 1, whose hot contexts follow a large share of all positions: dealt by the gram and merged. The
    merging groups are a third of the slices, as each of them makes a piece for each slice."""
    groups = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-slices // 3))
    return merged(deal(ids, 1, groups, blocks, by_doc, spread=True), 1, slices, len(blocks))


def heavy(merged_pairs: DataFrame, w: int, least: int | None = None):
    """Pairs of ids, as numbers in ascending order, that are the last two of more than ``least`` (half a slice's) training
    contexts, and the pieces that their grams go into: fewer than the positions fill. None if there are none."""
    least = least or SLICE // 2

    def run(batches):
        for pdf in batches:
            for i in range(len(pdf)):
                ctx, nxt, counted, _, _ = _unpacked(pdf.iloc[i : i + 1], 1, w)
                n = np.maximum.reduce(counted)
                there = n > least
                yield pd.DataFrame({"code": ((ctx[0].astype(np.int64) << 32) | nxt)[there], "n": n[there]})

    found = merged_pairs.where(~F.col("held")).select("held", "n", "cols").mapInPandas(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    rows = sorted((r["code"], 1 + r["n"] // least) for r in found.collect())
    return (np.array([c for c, _ in rows], np.int64), np.array([p for _, p in rows], np.int64)) if rows else None


def positions(ids: DataFrame, k: int, keep: Sequence[str] = ()) -> DataFrame:
    """(*keep, c0..c{k-1}, nxt): the k ids up to each position that has a next id (0 before the first), and that id."""

    def run(batches):
        for batch in batches:
            ends, start = np.cumsum(batch.column("ids").value_lengths().to_numpy(zero_copy_only=False)), 0
            while start < batch.num_rows:  # an eighth of CHUNK positions at once: they leave as one Arrow batch
                stop = min(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK // 8)) + 1, batch.num_rows)
                part = batch.slice(start, stop - start)
                lens = part.column("ids").value_lengths().to_numpy(zero_copy_only=False)
                ctx, nxt, text = _grams(np.split(part.column("ids").flatten().to_numpy(zero_copy_only=False), np.cumsum(lens)[:-1]), k, None)
                cols = [*[part.column(c).take(pa.array(text)) for c in keep], *[pa.array(x, pa.int32()) for x in (*ctx, nxt)]]
                yield pa.RecordBatch.from_arrays(cols, names)
                start = stop

    names = [*keep, *[f"c{j}" for j in range(k)], "nxt"]
    schema = T.StructType([*[T.StructField(c, ids.schema[c].dataType) for c in keep], *[T.StructField(c, T.IntegerType()) for c in names[len(keep) :]]])
    return ids.where(F.size("ids") > 1).select(*keep, "ids").mapInArrow(run, schema)


def deal_rows(rows: DataFrame, k: int, slices: int, held: bool = True, spread: bool = False) -> DataFrame:
    """Packed grams, held-out ones or (not ``held``) of training, from rows (c1..ck, nxt, m), such as those a longer context
    didn't find."""
    names = [f"c{j}" for j in range(1, k + 1)]

    def flush(parts):
        g = pd.concat(parts)
        if len(g):
            ctx = [g[c].to_numpy(np.int32) for c in names]
            yield _packed(ctx, g["nxt"].to_numpy(np.int32), [g["m"].to_numpy(np.int64)], np.zeros(len(g), np.int64), held, slices, k, spread)

    def run(batches):
        parts, total = [], 0
        for pdf in batches:
            parts.append(pdf)
            total += len(pdf)
            if total >= CHUNK:
                yield from flush(parts)
                parts, total = [], 0
        if parts:
            yield from flush(parts)

    return rows.select(*names, "nxt", "m").mapInPandas(run, _DEALT)


def _unpacked(pdf: pd.DataFrame, k: int, w: int):
    """Contexts, next ids, counts of a variant, documents of all grams of a slice; how many of them, at first, are of training."""
    pdf = pdf.sort_values("held")
    both, size = [*pdf["cols"]], [*pdf["n"]]
    n_train = int(pdf.loc[~pdf["held"], "n"].sum())
    last = int((~pdf["held"]).sum())
    ctx = [_values([c[j] for c in both], size, np.int32) for j in range(k)]
    counts = [_values([c[k + 1 + i] for c in both], size, np.int64) for i in range(w)]
    doc = _values([c[k + 1 + w] for c in both[last:]], size[last:], np.int64)
    return ctx, _values([c[k] for c in both], size, np.int32), counts, doc, n_train


def counts(dealt: DataFrame, k: int) -> DataFrame:
    """(c1..ck, nxt, n) of the training grams."""

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ctx, nxt, (n,), _, n_train = _unpacked(pdf[~pdf["held"]], k, 1)
        order = np.lexsort([nxt, *ctx[::-1]])
        cols = [x[order] for x in (*ctx, nxt)]
        head = _heads(cols) if n_train else order
        out = {f"c{j + 1}": cols[j][head] for j in range(k)}
        return pd.DataFrame({**out, "nxt": cols[k][head], "n": np.add.reduceat(n[order], head) if n_train else n})

    schema = ", ".join([f"c{j} int" for j in range(1, k + 1)] + ["nxt int", "n long"])
    return dealt.where(~F.col("held")).groupBy("slice").applyInPandas(add, schema)


def totals(dealt: DataFrame, k: int) -> DataFrame:
    """(c1..ck, nxt, n, C, pred) of the training grams: ``counts`` with what their context counts and what follows it
    most (ties: smallest id), from the same sort of the slice."""

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ctx, nxt, (n,), _, n_train = _unpacked(pdf[~pdf["held"]], k, 1)
        order = np.lexsort([nxt, *ctx[::-1]])
        cols = [x[order] for x in (*ctx, nxt)]
        head = _heads(cols)
        cols, n = [x[head] for x in cols], np.add.reduceat(n[order], head)
        first = _heads(cols[:k])
        size = np.diff(np.r_[first, len(n)])
        best = np.flatnonzero(n == np.repeat(np.maximum.reduceat(n, first), size))
        pred = cols[k][best[np.searchsorted(best, first)]]
        out = {f"c{j + 1}": cols[j] for j in range(k)}
        return pd.DataFrame({**out, "nxt": cols[k], "n": n, "C": np.repeat(np.add.reduceat(n, first), size), "pred": np.repeat(pred, size)})

    schema = ", ".join([f"c{j} int" for j in range(1, k + 1)] + ["nxt int", "n long", "C long", "pred int"])
    return dealt.where(~F.col("held")).groupBy("slice").applyInPandas(add, schema)


def held(dealt: DataFrame, k: int, blocks: Sequence[int | None] = (None,), orders: Sequence[int] | None = None, longest: bool = False, hot=None) -> DataFrame:
    """(k, block, doc_id, c1..ck, nxt, m, n, C, pred) of the held-out grams, for each of ``orders`` (k if not given; those the
    slices serve): how often they occur, how often in training, how
    often their context does (0: unseen) and what follows it most (ties: smallest id; null: unseen). A shorter order
    has 0 in place of the ids further back. ``longest``: a gram counts at the longest order whose context was seen, else at the last. Orders below k leave out the
    contexts in ``hot``, of which a slice has a piece only."""
    w, orders = len(blocks), list(orders or [k])

    def look(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ctx, nxt, counted, doc, n_train = _unpacked(pdf, k, w)
        out, open_ = [], [np.flatnonzero(m[n_train:] > 0) + n_train for m in counted]
        for o in orders:
            order = np.lexsort([nxt, *ctx[k - o :][::-1]])
            cols = [x[order] for x in (*ctx[k - o :], nxt)]
            gram, group = _heads(cols), _heads(cols[:o])
            gram_of, group_of = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            gram_of[order] = np.repeat(np.arange(len(gram)), np.diff(np.r_[gram, len(order)]))
            group_of[order] = np.repeat(np.arange(len(group)), np.diff(np.r_[group, len(order)]))
            first = np.searchsorted(gram, group)  # the first gram of each context
            for i, block in enumerate(blocks):
                n = np.add.reduceat(np.where(order < n_train, counted[i][order], 0), gram)
                total = np.add.reduceat(n, first)
                best = np.flatnonzero(n == np.repeat(np.maximum.reduceat(n, first), np.diff(np.r_[first, len(gram)])))
                pred = cols[o][gram[best[np.searchsorted(best, first)]]]
                take = open_[i]
                if hot is not None and o < k:
                    take = take[_hot_at([x[take] for x in ctx], hot) < 0]
                if longest and o != orders[-1]:
                    seen = total[group_of[take]] > 0
                    take, open_[i] = take[seen], take[~seen]
                of = group_of[take]
                row = {"k": o, "block": block or 0, "doc": doc[take - n_train], **{f"c{j + 1}": ctx[j][take] if j >= k - o else 0 for j in range(k)}, "nxt": nxt[take]}
                out.append(pd.DataFrame({**row, "m": counted[i][take], "n": n[gram_of[take]], "C": total[of], "pred": pred[of]}))
        return pd.concat(out)

    schema = ", ".join(["k int", "block int", "doc long", *[f"c{j} int" for j in range(1, k + 1)], "nxt int", "m long", "n long", "C long", "pred int"])
    found = dealt.groupBy("slice").applyInPandas(look, schema)
    ids = [f"c{j}" for j in range(1, k + 1)]
    return found.select("k", "block", F.when(F.col("doc") != _NO_DOC, F.col("doc")).alias("doc_id"), *ids, "nxt", "m", "n", "C", F.when(F.col("C") > 0, F.col("pred")).alias("pred"))
