"""LM scoring: context-tree weighting over bytes.

A byte is coded as eight binary decisions; each decision has a binary context tree over the bits
of the two bytes before it (depths 0 to 16). Every node holds a Krichevsky-Trofimov estimate, and the
weighted probability mixes all depths: P_w = (P_kt + P_w(0) P_w(1)) / 2. With counts of the whole
training part fixed, the mixture gives one probability for each (context, byte): a table of 256^3
numbers at most (64 MB), whatever the corpus, which is broadcast.

Below it, every context of three bytes has a tree of its own, which branches by whole bytes down to
``REACH`` bytes before the coded one and grows with the corpus. It is weighted the same way, and at its
root against the table: half the prior weight is the table's, half the deep tree's, and what the
training bytes of that context are worth under each decides. A tree is gathered in one place and not
broadcast: a block of documents sends each of its grams (context and byte) once with its training
count to the bucket of the gram's three nearest bytes, and gets log probabilities back in the order
asked. A text's score is the sum over its bytes and a closing zero byte; the code length per byte
follows from it.

The base score needs the training count of every word of every document. Word counts meet in buckets
by hash: a block of documents sends each of its words once with its count, and gets the sums back in
the order asked. No word is gathered more often than there are blocks.

Defined results: null or empty text: no words, one end. A null id falls into fold 0, so it trains.
Repeated rows count each. With nothing to train on, every bit has probability 1/2 and base counts are
0. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import common as c
from corpuslab.llm.langid import fold
from corpuslab.session import written

FOLDS, HELD, DEPTH = 7, 2, 16
END = np.uint64(0x5BD1E9955BD1E995)  # the end token among word hashes
_COUNT_BYTES = 8 << 20
ROOT, REACH = 3, 5  # bytes of context at the root of a deep tree and at its leaves
_GRAM_BYTES = 1 << 20
_SMALL = 64  # counts whose estimates are looked up


def _log_gamma(x):
    """ln Gamma for x > 0: Stirling's series after eight steps up."""
    steps = np.ones_like(x)
    for k in range(8):
        steps = steps * (x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(steps)


def _estimates(a, b):
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones, and of the next one."""
    kt, one = np.zeros(len(a)), np.full(len(a), 0.5)
    seen = np.flatnonzero(a + b)
    x, y = a[seen], b[seen]
    kt[seen] = _log_gamma(x + 0.5) + _log_gamma(y + 0.5) - _log_gamma(x + y + 1) - math.log(math.pi)
    one[seen] = (y + 0.5) / (x + y + 1)
    return kt, one


def _decision(a, b, depth: int) -> np.ndarray:
    """Probability of a one in each of 2^depth contexts, all depths mixed."""
    if not a.any() and not b.any():
        return np.full(1 << depth, 0.5)
    nodes = []  # from the leaves to the root: weight of the node's own estimate, the estimate
    for d in range(depth, -1, -1):
        kt, one = _estimates(a, b)
        if d == depth:
            below, own = kt, np.ones(len(kt))
        else:
            split = below.reshape(-1, 2).sum(1)
            own = 1 / (1 + np.exp(np.clip(split - kt, -700, 700)))
            below = np.logaddexp(kt, split) - math.log(2)
        nodes.append((own, one))
        if d:
            a, b = a.reshape(-1, 2).sum(1), b.reshape(-1, 2).sum(1)
    p, rest = np.zeros(1), np.ones(1)
    for own, one in reversed(nodes):
        p, rest = p + rest * own * one, rest * (1 - own)
        if len(p) < 1 << depth:
            p, rest = p.repeat(2), rest.repeat(2)
    return p


def code_table(counts: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """log10 probability of each byte in each context, from counts (2^depth contexts, 256 bytes).
    A context's number starts with the bits of the nearest byte."""
    out = np.zeros((1 << depth, 256), dtype=np.float32)
    for level in range(8):
        span = 256 >> level
        for low in range(0, 256, span):
            mid, high = low + span // 2, low + span
            p = _decision(counts[:, low:mid].sum(1, dtype=np.float64), counts[:, mid:high].sum(1, dtype=np.float64), depth)
            out[:, low:mid] += np.log10(1 - p)[:, None].astype(np.float32)
            out[:, mid:high] += np.log10(p)[:, None].astype(np.float32)
    return out


def _coded(texts: list[bytes]):
    """Context and byte numbers of all texts (each closed by a zero byte), and where texts start."""
    buf = np.frombuffer(b"".join(b"\0\0" + t + b"\0" for t in texts), np.uint8)
    starts = np.cumsum([0] + [len(t) + 3 for t in texts])[:-1]
    code = np.zeros(len(buf), np.int32)
    code[2:] = (buf[1:-1].astype(np.int32) << 16) | (buf[:-2].astype(np.int32) << 8) | buf[2:]
    real = np.ones(len(buf), bool)
    real[starts] = real[starts + 1] = False
    return code, real, starts


def byte_counts(docs: DataFrame, text_col="text") -> DataFrame:
    """(code, n): how often each byte follows each two bytes."""

    def count(batches):
        total = None
        for pdf in batches:
            texts = c.encode(pdf[text_col])
            for first, last in c.chunks(texts, _COUNT_BYTES):
                code, real, _ = _coded(texts[first:last])
                one = np.bincount(code[real], minlength=1 << 24)
                total = one if total is None else np.add(total, one, out=total)
        if total is not None:
            seen = np.flatnonzero(total)
            for lo in range(0, len(seen), 1 << 16):
                yield pd.DataFrame({"code": seen[lo : lo + (1 << 16)].astype(np.int32), "n": total[seen[lo : lo + (1 << 16)]]})

    return docs.select(text_col).mapInPandas(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text_col="text") -> np.ndarray:
    """The table of log10 probabilities; at most 256^3 counts reach the driver."""
    got = byte_counts(docs, text_col).toPandas()
    counts = np.zeros(1 << 24, np.float64)
    counts[got["code"].to_numpy(np.int64)] = got["n"]
    return code_table(counts.reshape(1 << DEPTH, 256))


def gram_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every byte of all texts (each closed by a zero byte): the ``REACH`` bytes before it, nearest
    first, and the byte itself in the lowest place. Also where each text starts."""
    pad = b"\0" * REACH
    buf = np.frombuffer(b"".join(pad + t + b"\0" for t in texts), np.uint8)
    size = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(size) - size
    at = np.arange(size.sum()) + np.repeat(REACH * np.arange(1, len(texts) + 1), size)
    keys = buf[at].astype(np.uint64)
    for back in range(1, REACH + 1):
        keys |= buf[at - back].astype(np.uint64) << np.uint64(8 * (REACH + 1 - back))
    return keys, starts


def gram_counts(texts: list[bytes], train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a block's texts in order, and how often its training texts hold each."""
    parts = []
    for first, last in c.chunks(texts, _GRAM_BYTES):
        keys, starts = gram_keys(texts[first:last])
        size = np.diff(np.r_[starts, len(keys)])
        parts.append(np.unique((keys << np.uint64(1)) | np.repeat(train[first:last], size).astype(np.uint64), return_counts=True))
    keys, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys)
    keys, n = keys[order], n[order] * (keys[order] & np.uint64(1)).astype(np.int64)
    keys >>= np.uint64(1)
    head = c.group_starts(keys)
    return keys[head], np.add.reduceat(n, head)


def _small():
    a, b = (x.ravel().astype(np.float64) for x in np.mgrid[:_SMALL, :_SMALL])
    return _estimates(a, b)


_SMALL_KT, _SMALL_ONE = _small()


def _looked_up(a, b):
    """``_estimates``, mostly from a table."""
    at = np.minimum(a, _SMALL - 1).astype(np.int64) * _SMALL + np.minimum(b, _SMALL - 1).astype(np.int64)
    kt, one = _SMALL_KT[at], _SMALL_ONE[at]
    many = np.flatnonzero((a >= _SMALL) | (b >= _SMALL))
    kt[many], one[many] = _estimates(a[many], b[many])
    return kt, one


def deep_scores(keys: np.ndarray, n: np.ndarray, table: np.ndarray) -> np.ndarray:
    """log10 probability of each gram, from the training counts of all grams of their trees. ``keys`` are distinct
    and in order; ``table`` is that of ``code_table``."""
    context, byte = keys >> np.uint64(8), (keys & np.uint64(255)).astype(np.int64)
    near = (keys >> np.uint64(8 * (REACH - 1))).astype(np.int64)
    row, near = np.unique(near, return_inverse=True)
    shares = [np.power(10.0, table[row].astype(np.float64))]  # of each node of the decisions, from the bytes up
    for _ in range(8):
        shares.insert(0, shares[0].reshape(len(row), -1, 2).sum(2))
    out = np.zeros(len(keys))
    for level in range(8):
        prefix, bit = byte >> (8 - level), (byte >> (7 - level)) & 1
        node = (prefix.astype(np.uint64) << np.uint64(8 * REACH)) | context
        order = np.argsort(node, kind="stable")
        key, count = node[order], n[order].astype(np.float64)
        one_bit = bit[order] == 1
        head = c.group_starts(key)
        leaf = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(key)]))
        a, b = np.add.reduceat(np.where(one_bit, 0, count), head), np.add.reduceat(np.where(one_bit, count, 0), head)
        key, first = key[head], order[head]
        nodes, below = [], None  # from the leaves to the root: weight of the node's own estimate, the estimate, number of children
        for depth in range(REACH, ROOT - 1, -1):
            if depth < REACH:
                key = key >> np.uint64(8)
                head = c.group_starts(key)
                children = np.diff(np.r_[head, len(key)])
                a, b, split = np.add.reduceat(a, head), np.add.reduceat(b, head), np.add.reduceat(below, head)
                key, first = key[head], first[head]
                kt, one = _looked_up(a, b)
                own = 1 / (1 + np.exp(np.clip(split - kt, -700, 700)))
                below = np.logaddexp(kt, split) - math.log(2)
            else:
                kt, one = _looked_up(a, b)
                own, below, children = np.ones(len(kt)), kt, None
            nodes.append((own, one, children))
        shallow = shares[level + 1][near[first], 2 * prefix[first] + 1] / shares[level][near[first], prefix[first]]
        kept = a * np.log1p(-shallow) + b * np.log(shallow)
        rest = 1 / (1 + np.exp(np.clip(kept - below, -700, 700)))
        p = (1 - rest) * shallow
        for own, one, children in reversed(nodes):
            p, rest = p + rest * own * one, rest * (1 - own)
            if children is not None:
                p, rest = p.repeat(children), rest.repeat(children)
        out[order] += np.log10(np.where(one_bit, p[leaf], 1 - p[leaf]))
    return out


def _planes(x: np.ndarray) -> bytes:
    """An array's bytes by place: equal bytes lie together and compress."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _from_planes(x: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(size, -1).T).view(kind).ravel()


def gram_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (c.mix(keys >> np.uint64(8 * (REACH + 1 - ROOT))) % np.uint64(buckets)).astype(np.int64)


def score(docs: DataFrame, id_col="doc_id", text_col="text", folds=FOLDS, held=HELD, block_bytes=c.BLOCK_BYTES) -> DataFrame:
    """doc, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(fit(docs.where(fold(id_col, folds) != held), text_col))
    base, n_blocks = c.blocked(docs, id_col, text_col, block_bytes)
    base = base.withColumn("held", (F.col("doc") != c.NULL_ID) & (fold("doc", folds) == held))

    def words(texts):
        """Word hashes of a block's texts with the bounds of each text."""
        parts, sizes = [], []
        for first, last in c.chunks(texts):
            values, bounds = c.word_units([t.translate(c.LOWER) for t in texts[first:last]])
            parts.append(values)
            sizes.append(np.diff(bounds))
        values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        kinds, inverse = np.unique(np.r_[values, END], return_inverse=True)
        bucket = ((kinds >> np.uint64(16)) % np.uint64(n_blocks)).astype(np.int64)
        return kinds, inverse[:-1], int(inverse[-1]), sizes, bucket

    def request(key, pdf: pd.DataFrame) -> pd.DataFrame:
        texts = c.encode(pdf["text"])
        kinds, inverse, end, sizes, bucket = words(texts)
        train = ~pdf["held"].to_numpy(bool)
        n = np.bincount(inverse, weights=np.repeat(train, sizes), minlength=len(kinds)).astype(np.int64)
        n[end] += train.sum()
        order = np.argsort(bucket, kind="stable")
        rows = [(0, int(bucket[i[0]]), int(key[0]), kinds[i].tobytes(), n[i].tobytes()) for i in np.split(order, c.group_starts(bucket[order])[1:])]
        keys, n = gram_counts(texts, train)
        bucket = gram_bucket(keys, n_blocks)
        order = np.argsort(bucket, kind="stable")
        for i in np.split(order, c.group_starts(bucket[order])[1:]):
            rows.append((1, int(bucket[i[0]]), int(key[0]), _planes(np.diff(keys[i], prepend=np.uint64(0))), _planes(n[i])))
        return pd.DataFrame(rows, columns=["kind", "bucket", "block", "word", "n"])

    def settle_grams(bucket: int, pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [np.cumsum(_from_planes(x, np.uint64)) for x in pdf["word"]]
        cut = np.cumsum([len(x) for x in asked])[:-1]
        keys, place = np.unique(np.concatenate(asked), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate([_from_planes(x, np.int64) for x in pdf["n"]]), minlength=len(keys))
        got = deep_scores(keys, n, table.value).astype(np.float32)[place]
        return pd.DataFrame({"kind": 1, "block": pdf["block"], "bucket": bucket, "n": [_planes(x) for x in np.split(got, cut)], "tokens": 0, "kinds": 0})

    def settle(key, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] == 1:
            return settle_grams(int(key[1]), pdf)
        word = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["word"]])
        n = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["n"]])
        order = np.argsort(word, kind="stable")
        head = c.group_starts(word[order])
        total = np.add.reduceat(n[order], head)
        back = np.empty(len(word), np.int64)
        back[order] = np.repeat(total, np.diff(np.r_[head, len(word)]))
        cut = np.cumsum([len(x) // 8 for x in pdf["word"]])[:-1]
        out = pd.DataFrame({"kind": 0, "block": pdf["block"], "bucket": int(key[1]), "n": [x.tobytes() for x in np.split(back, cut)], "tokens": 0, "kinds": 0})
        out.loc[0, ["tokens", "kinds"]] = int(total.sum()), int((total > 0).sum())
        return out

    asked = base.groupBy("block").applyInPandas(request, "kind int, bucket long, block int, word binary, n binary")
    sums = written(asked.groupBy("kind", "bucket").applyInPandas(settle, "kind int, block int, bucket long, n binary, tokens long, kinds long"))
    total = sums.agg(F.sum("tokens").alias("n"), F.sum("kinds").alias("v")).first()
    n_train, room = int(total["n"] or 0), float((total["n"] or 0) + (total["v"] or 0) + 1)

    def conclude(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        texts = c.encode(left["text"])
        if not texts:
            return pd.DataFrame({x: [] for x in ("doc", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")})
        kinds, inverse, end, sizes, bucket = words(texts)
        count = np.zeros(len(kinds), np.int64)
        grams = right["kind"].to_numpy() == 1
        for b, n in zip(right["bucket"][~grams], right["n"][~grams]):
            count[bucket == b] = np.frombuffer(n, np.int64)
        log = np.log10((count + 1) / room)
        at = np.r_[0, np.cumsum(sizes)]
        known = np.r_[0, np.cumsum(count[inverse] > 0)]
        base_score = [math.fsum(log[inverse[x:y]]) + log[end] for x, y in zip(at[:-1], at[1:])]
        n_known = known[at[1:]] - known[at[:-1]] + (count[end] > 0)
        parts = []
        for first, last in c.chunks(texts, _GRAM_BYTES):
            keys, starts = gram_keys(texts[first:last])
            keys, place = np.unique(keys, return_inverse=True)
            parts.append((keys, place.astype(np.int32), starts))
        keys = np.unique(np.concatenate([x for x, _, _ in parts]))
        order = np.argsort(gram_bucket(keys, n_blocks), kind="stable")  # as asked: bucket by bucket
        value = np.empty(len(keys), np.float32)
        mine = right[grams].sort_values("bucket")
        value[order] = np.concatenate([_from_planes(x, np.float32) for x in mine["n"]])
        got = np.concatenate([np.add.reduceat(value[np.searchsorted(keys, x)][place].astype(np.float64), starts) for x, place, starts in parts])
        size = np.array([len(t) + 1 for t in texts])
        return pd.DataFrame({"doc": left["doc"].to_numpy(), "held_out": left["held"].to_numpy(bool), "n_tokens": sizes + 1, "n_known": n_known, "train_tokens": n_train,
                             "base_score": base_score, "score": got, "bits_per_byte": -got / math.log10(2) / size})

    schema = "doc long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return base.groupBy("block").cogroup(sums.groupBy("block")).applyInPandas(conclude, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return score(docs).select(c.real_id().alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
