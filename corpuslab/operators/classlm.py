"""k-gram network over the whole vocabulary: hashed context features and a class-factored output.

p(token | context) = p(class | context) * p(token | class, last token). Token ids run by falling frequency, so
a class is a range of ids: 1, 2, 3, 4-5, 6-7, 8-11, 12-15, ... Frequent tokens have a class of their own, rare
ones share one, and the number of classes grows with the logarithm of the vocabulary. The class comes from a
Spark ML network over the context ids, hashed by position into ``FEATURES`` columns; it is fitted on the
``SAMPLE`` training positions of smallest keyed hash, a bounded sample. The token in its class comes from the
counts of all training positions: its successors of the last token, smoothed by the class's own counts. No token is
mapped to another, every position is scored, and the probabilities of all tokens add up to one.

Positions are exchanged once to be scored, as packed grams (``grams``) in slices of their last token, where its training
successors meet them; a last token of more than a slice's positions is spread over several slices by its whole context.
The fitted network runs there on numpy batches: a row of Spark ML's ``transform`` takes 30 microseconds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.operators import grams
from corpuslab.operators.sampling import bounded_sample
from corpuslab.session import small_batches, written

FEATURES = 512
HIDDEN = 32
SAMPLE = 50_000  # training positions that fit the network
PRIOR = 1.0  # weight of the class's own counts beside those after the last token
FLOOR = 1e-3  # share of the class probability that is spread evenly
HEAD = 1 << 20  # ids whose counts go to every task (4 MB); slices ask for the counts of the rarer ones
SCORED = 1 << 18  # grams of a slice that are scored at once
NET_ROWS = 1 << 15  # contexts that go through the network at once


def token_class(token_id: Column) -> Column:
    """0 for id 1, then two classes per power of two: by the bit after the leading one."""
    bits = F.bin(token_id)
    high = F.length(bits) - 1
    return F.when(high == 0, 0).otherwise(2 * high - 1 + (F.substring(bits, 2, 1) == "1").cast("int")).cast("int")


def class_first(cls: Column) -> Column:
    """Smallest id of a class: its most frequent token."""
    high, bit = F.floor((cls + 1) / 2), (cls + 1) % 2
    return F.when(cls == 0, 1).otherwise(F.pow(F.lit(2.0), high) + bit * F.pow(F.lit(2.0), high - 1)).cast("int")


def class_size(cls: Column, vocab_size: int) -> Column:
    """Ids of the class that the vocabulary has."""
    width = F.when(cls == 0, 1).otherwise(F.pow(F.lit(2.0), F.floor((cls + 1) / 2) - 1)).cast("long")
    return F.least(width, F.lit(vocab_size + 1) - class_first(cls))


def _classes(ids: np.ndarray):
    """``token_class``, ``class_first`` and the width of ``class_size`` of an array of ids."""
    high = np.frexp(ids.astype(np.float64))[1].astype(np.int64) - 1
    half = np.int64(1) << np.maximum(high - 1, 0)
    upper = (high > 0) & ((ids & half) > 0)
    return np.where(high == 0, 0, 2 * high - 1 + upper), np.where(high == 0, 1, (np.int64(1) << high) + upper * half), half


def hashed(name: str, ids: np.ndarray, features: int) -> np.ndarray:
    """The column that FeatureHasher gives each id of the string column ``name``: Murmur3 of 'name=id', seed 42."""
    out = np.zeros(len(ids), np.int64)
    u = np.uint32

    def mix(k):
        k = k * u(0xCC9E2D51)
        return ((k << u(15)) | (k >> u(17))) * u(0x1B873593)

    for d in range(1, 11):
        rows = np.flatnonzero((ids < 10**d) & (ids >= (10 ** (d - 1) if d > 1 else 0)))
        value = ids[rows].astype(np.int64)
        text = [np.full(len(rows), b, u) for b in f"{name}=".encode()] + [(value // 10 ** (d - 1 - j) % 10 + 48).astype(u) for j in range(d)]
        h, whole = np.full(len(rows), 42, u), len(text) // 4 * 4
        for at in range(0, whole, 4):
            h ^= mix(text[at] | text[at + 1] << u(8) | text[at + 2] << u(16) | text[at + 3] << u(24))
            h = ((h << u(13)) | (h >> u(19))) * u(5) + u(0xE6546B64)
        rest = np.zeros(len(rows), u)
        for at in range(whole, len(text)):
            rest ^= text[at] << u(8 * (at - whole))
        h ^= mix(rest) ^ u(len(text))
        h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
        h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
        out[rows] = (h ^ (h >> u(16))).view(np.int32).astype(np.int64) % features
    return out


def class_probabilities(weights: np.ndarray, ctx: Sequence[np.ndarray], features: int, n_classes: int):
    """Batches of class probabilities of contexts (an array of ids per place) by the fitted network."""
    cut = np.cumsum([features * HIDDEN, HIDDEN, HIDDEN * n_classes])
    w1, b1, w2, b2 = np.split(weights, cut)
    w1, w2 = w1.reshape(features, HIDDEN), w2.reshape(HIDDEN, n_classes)
    place = []
    for i, x in enumerate(ctx):
        kinds, at = np.unique(x, return_inverse=True)
        place.append(hashed(f"c{i}", kinds, features)[at])
    for at in range(0, len(ctx[0]), NET_ROWS):
        hidden = 1 / (1 + np.exp(-(sum(w1[x[at : at + NET_ROWS]] for x in place) + b1)))
        raw = hidden @ w2 + b2
        p = np.exp(raw - raw.max(axis=1, keepdims=True))
        yield p / p.sum(axis=1, keepdims=True)


@dataclass
class ClassModel:
    net: object
    k: int
    vocab_size: int
    features: int
    pairs: DataFrame  # (last, nxt, n)
    tokens: DataFrame  # (nxt, c)
    classes: np.ndarray  # training positions of each class: at most two classes per bit of the vocabulary size


def _columns(rows: DataFrame, k: int, keep: Sequence[str]) -> DataFrame:
    ctx = [(F.col("ctx_arr")[i] if "ctx_arr" in rows.columns else F.col(f"c{i}")).cast("int").alias(f"c{i}") for i in range(k)]
    return rows.select(*keep, *ctx, F.col("nxt").cast("int").alias("nxt"))


def _slices(rows: DataFrame, positions: int) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(positions / grams.SLICE))


def fit(rows: DataFrame, k: int, vocab_size: int, max_iter: int = 30, seed: int = 42, sample: int = SAMPLE, features: int = FEATURES) -> ClassModel:
    """rows: training positions (the k ids before, as ctx_arr or c0.., and nxt: id from 1 to vocab_size)."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import FeatureHasher

    x, ctx = _columns(rows, k, ()), [f"c{i}" for i in range(k)]
    slices, one = _slices(rows, x.count()), F.lit(1).cast("long").alias("m")
    # after a hot token come as many pairs as the vocabulary has at most: merged before a slice holds them
    groups = max(_slices(rows, 0), -(-slices // 3))
    dealt = grams.deal_rows(x.select(F.col(ctx[-1]).alias("c1"), "nxt", one), 1, groups, held=False, spread=True)
    pairs = grams.counts(grams.merged(dealt, 1, slices), 1)
    with small_batches(rows.sparkSession):
        pairs = written(pairs.select(F.col("c1").alias("last"), "nxt", "n"))
    tokens = written(pairs.groupBy("nxt").agg(F.sum("n").alias("c")))
    n_classes = rows.sparkSession.range(1).select(token_class(F.lit(max(1, vocab_size)))).first()[0] + 1
    classes = np.zeros(max(2, n_classes), np.int64)
    for r in tokens.groupBy(token_class(F.col("nxt")).alias("cls")).agg(F.sum("c").alias("c")).collect():
        classes[r["cls"]] = r["c"]
    named = [F.col(c).alias(f"c{i + 1}") for i, c in enumerate(ctx)]
    counted = grams.counts(grams.deal_rows(x.select(*named, token_class(F.col("nxt")).alias("nxt"), one), k, slices, held=False), k)
    counted = counted.select(*[F.col(f"c{i + 1}").cast("string").alias(c) for i, c in enumerate(ctx)], F.col("nxt").alias("cls"), F.col("n").alias("m"))
    # positions of one context and class differ in their number only: dealt out by it, drawn by a hash
    dealt = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("m"), F.lit(sample).cast("long")))))
    with small_batches(rows.sparkSession):
        drawn = written(bounded_sample(dealt, sample, seed, [*ctx, "cls", "copy"]))
    hasher = FeatureHasher(inputCols=ctx, outputCol="features", numFeatures=features)
    data = hasher.transform(drawn.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "copy", "c0").withColumn("label", F.col("cls").cast("double")))
    net = MultilayerPerceptronClassifier(layers=[features, HIDDEN, len(classes)], maxIter=max_iter, seed=seed).fit(data)
    return ClassModel(net, k, vocab_size, features, pairs, tokens, classes)


def _collected(tokens: DataFrame):
    """(nxt, c) packed, a row for each batch: rows of their own would take hundreds of bytes each on the driver."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [len(pdf)], "nxt": [grams._planes(pdf["nxt"].to_numpy(np.int32))], "c": [grams._planes(pdf["c"].to_numpy(np.int64))]})

    return tokens.select("nxt", "c").mapInPandas(run, "n int, nxt binary, c binary").toLocalIterator()


def score(model: ClassModel, rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, c0.., nxt, m, p, hit): every distinct (context, next token) with its number of positions, the
    probability of the token, and whether it is the predicted one: the most frequent successor of the last token
    in the likeliest class, else that class's most frequent token."""
    spark, k, by = rows.sparkSession, model.k, list(by)
    ctx, x = [f"c{i}" for i in range(k)], _columns(rows, k, by)
    share = max(1, grams.SLICE // 2)  # positions of a slice: a network and its scores take several times what counts do
    per_last = x.groupBy(F.col(ctx[-1]).alias("last")).agg(F.count(F.lit(1)).alias("n"))
    r = per_last.agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("n") > share, F.struct("last", "n"))).alias("hot")).first()
    slices = _slices(rows, (r["n"] or 0) * grams.SLICE // share)
    spread = sorted((h["last"], -(-h["n"] // share)) for h in r["hot"])  # fewer than there are slices
    hot, pieces = (np.array([z[i] for z in spread], np.int64) for i in (0, 1))
    first = np.zeros(min(HEAD, model.vocab_size) + 1, np.int64)
    for r in _collected(model.tokens.where((F.col("nxt") <= HEAD) & (F.col("nxt") <= model.vocab_size))):
        first[grams._values([r["nxt"]], [r["n"]], np.int32)] = grams._values([r["c"]], [r["n"]], np.int64)
    shared = spark.sparkContext.broadcast((first, np.asarray(model.net.weights.toArray())))
    features, classes, vocab_size = model.features, model.classes, model.vocab_size

    def parts(last):
        """Pieces of a last token."""
        at = np.minimum(np.searchsorted(hot, last), max(len(hot) - 1, 0))
        return np.where(hot[at] == last, pieces[at], 1) if len(hot) else np.ones(len(last), np.int64)

    def place(pdf):
        cols = [pdf[c].to_numpy(np.int32) for c in ctx]
        return (grams._slice_of(cols[-1:], slices) + grams._slice_of(cols, 1 << 30) % parts(cols[-1])) % slices

    def gathered(batches):
        held, n = [], 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= grams.CHUNK:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
        if n:
            yield pd.concat(held, ignore_index=True)

    def packed(key, cols):
        """Rows of the same ``key`` packed; returns the keys too."""
        order = np.lexsort([*cols[::-1], key])
        key, cols = key[order], [c[order] for c in cols]
        at = grams._heads([key])
        ends = np.r_[at[1:], len(key)]
        return pd.DataFrame({"slice": key[at], "n": ends - at, "cols": [[grams._planes(c[i:j]) for c in cols] for i, j in zip(at, ends)]})

    def deal(batches):
        for pdf in gathered(batches):
            for values, g in pdf.groupby(by, dropna=False, sort=False) if by else [((), pdf)]:
                out = packed(place(g), [g[c].to_numpy(np.int32) for c in (*ctx, "nxt")])
                yield out.assign(**dict(zip(by, values)))[[*by, "slice", "n", "cols"]]

    def send(batches):
        for pdf in gathered(batches):
            last = pdf["last"].to_numpy(np.int32)
            times = parts(last)
            at = np.repeat(np.arange(len(last)), times)
            copy = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            out = packed((grams._slice_of([last], slices)[at] + copy) % slices, [last[at], pdf["nxt"].to_numpy(np.int32)[at], pdf["n"].to_numpy(np.int64)[at]])
            yield out.assign(nxt=None, c=None)

    def ask(batches):
        for pdf in gathered(batches):
            yield pd.DataFrame({"slice": place(pdf), "nxt": pdf["nxt"]}).drop_duplicates()

    def unpacked(pdf, types):
        return [grams._values([c[i] for c in pdf["cols"]], pdf["n"], t) for i, t in enumerate(types)]

    def look(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        counts, weights = shared.value
        rare = right[right["nxt"].notna()].astype({"nxt": np.int64, "c": np.int64}).sort_values("nxt")
        last, nxt, n = unpacked(right[right["nxt"].isna()], [np.int32, np.int32, np.int64])
        cls = _classes(nxt)[0]
        order = np.lexsort([nxt, -n, cls, last])  # a group's most frequent successor first, ties: smallest id
        last, nxt, n, cls = (z[order].astype(np.int64) for z in (last, nxt, n, cls))
        group = grams._heads([last, cls])
        group_key, total, best = (last[group] << 6) | cls[group], np.add.reduceat(n, group) if len(n) else n, nxt[group]
        pair = np.argsort((last << 32) | nxt)
        pair_key, n = ((last << 32) | nxt)[pair], n[pair]

        def found(keys, values, wanted):
            at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            return np.where(keys[at] == wanted, values[at], 0) if len(keys) else np.zeros(len(wanted), np.int64)

        def scored(values, cols, m):
            context = grams._heads(cols[:k])
            of = np.repeat(np.arange(len(context)), np.diff(np.r_[context, len(m)]))
            end, nx = cols[k - 1].astype(np.int64), cols[k].astype(np.int64)
            cls, low, half = _classes(nx)
            p_cls, top, start = np.empty(len(m)), np.empty(len(context), np.int64), 0
            for probs in class_probabilities(weights, [z[context] for z in cols[:k]], features, len(classes)):
                a, b = np.searchsorted(of, [start, start + len(probs)])
                p_cls[a:b] = probs[of[a:b] - start, cls[a:b]]
                top[start : start + len(probs)] = probs.argmax(axis=1)
                start += len(probs)
            c = found(rare["nxt"].to_numpy(), rare["c"].to_numpy(), nx)
            c = np.where(nx < len(counts), counts[np.minimum(nx, len(counts) - 1)], c)
            of_class = (end << 6) | cls
            base = (c + 1.0) / (classes[cls] + np.minimum(half, vocab_size + 1 - low))
            p_tok = (found(pair_key, n, (end << 32) | nx) + PRIOR * base) / (found(group_key, total, of_class) + PRIOR)
            guess = found(group_key, best, of_class)  # of the token's own class: only the likeliest class can hit
            hit = (top[of] == cls) & (np.where(guess > 0, guess, low) == nx)
            row = dict(zip(by, values)) | {name: z for name, z in zip((*ctx, "nxt"), cols)}
            return pd.DataFrame({**row, "m": m, "p": (p_cls * (1 - FLOOR) + FLOOR / len(classes)) * p_tok, "hit": hit.astype(np.float64)})

        out = []
        for values, g in left.groupby(by, dropna=False, sort=False) if by else [((), left)]:
            cols = unpacked(g, [np.int32] * (k + 1))
            order = np.lexsort(cols[::-1])
            cols = [z[order] for z in cols]
            head = grams._heads(cols)
            m = np.diff(np.r_[head, len(order)])
            cols = [z[head] for z in cols]
            heads = grams._heads(cols[:k])
            runs = heads[grams._heads([heads // SCORED])]  # whole contexts, about SCORED grams at once
            for a, b in zip(runs, np.r_[runs[1:], len(m)]):
                out.append(scored(values, [z[a:b] for z in cols], m[a:b]))
        # strings of several parts as objects: pandas would hand Spark a chunked column, which it refuses
        return pd.concat(out)[names].astype({c: object for c in by}) if out else pd.DataFrame(columns=names, dtype=object)

    names = [*by, *ctx, "nxt", "m", "p", "hit"]
    keep = [T.StructField(c, x.schema[c].dataType) for c in by]
    ints = [T.StructField(c, T.IntegerType()) for c in (*ctx, "nxt")]
    dealt = T.StructType([*keep, T.StructField("slice", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("cols", T.ArrayType(T.BinaryType()))])
    schema = T.StructType([*keep, *ints, T.StructField("m", T.LongType()), T.StructField("p", T.DoubleType()), T.StructField("hit", T.DoubleType())])
    asked = x.where(F.col("nxt") > HEAD).mapInPandas(ask, "slice int, nxt int").distinct().join(model.tokens.where(F.col("nxt") > HEAD), "nxt")
    right = model.pairs.mapInPandas(send, "slice int, n int, cols array<binary>, nxt int, c long")
    right = right.unionByName(asked.select("slice", "nxt", "c"), allowMissingColumns=True)
    return x.mapInPandas(deal, dealt).groupBy("slice").cogroup(right.groupBy("slice")).applyInPandas(look, schema)


def evaluate(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    return scored.groupBy(*by).agg(F.sum("m").cast("bigint").alias("n"), (F.sum(F.col("m") * F.col("hit")) / F.sum("m")).alias("accuracy"),
                                   (F.sum(-F.col("m") * F.log("p")) / F.sum("m")).alias("cross_entropy"))
