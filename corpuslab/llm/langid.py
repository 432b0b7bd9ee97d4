"""Language identification: a byte convolutional network trained in numpy.

Text is cut into windows of ``WINDOW`` UTF-8 bytes (the last one padded with zero bytes); each byte
is embedded, filters of several widths slide over the window, the strongest answer of each filter
goes to a softmax. A text's distribution is the mean over all its windows by their length: whole
texts count, however long.

The network is fitted on a bounded, documented sample (``PER_CLASS`` documents for each language,
chosen by a hash of the id, ``PER_DOC`` windows of each) of the rows whose crc32(id) mod ``FOLDS``
is not 0. At prediction the filters are byte-pair lookup tables, so a batch of windows is a few
gathers and a maximum.

Defined results: ``und`` with score 0 for null texts and texts without a letter; also for all texts
if no row can be learned from. Null ids are held out; rows with a null language are not learned from.
Ties in the distribution: the language first in name order. An empty table gives an empty result.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import common as c

FOLDS, WINDOW, WIDTHS, FILTERS, EMBED = 5, 256, (2, 3, 4), 16, 8
AT_ONCE = 256  # windows through the network together
PER_CLASS, PER_DOC, STEPS, BATCH = 400, 4, 400, 64
MAX_CLASSES = 512  # languages the sample may have; more is an error, never a cut
_LETTER = regex.compile(r"\p{L}")


def fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % F.lit(folds)


class ByteCnn:
    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"E": rng.normal(0, 0.5, (256, EMBED)), "V": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))), "c": np.zeros(len(classes))}
        for w in WIDTHS:
            self.p[f"W{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)

    def step(self, x: np.ndarray, y: np.ndarray) -> dict:
        """Gradients of the mean cross-entropy of windows x (n, WINDOW) with classes y."""
        p, g, n = self.p, {}, len(x)
        emb = p["E"][x]
        pooled, taken = [], []
        for w in WIDTHS:
            patches = np.lib.stride_tricks.sliding_window_view(emb, w, axis=1).swapaxes(2, 3).reshape(n, -1, w * EMBED)
            act = patches @ p[f"W{w}"] + p[f"b{w}"]
            best = act.argmax(1)
            pooled.append(np.maximum(np.take_along_axis(act, best[:, None], 1)[:, 0], 0))
            taken.append((best, patches[np.arange(n)[:, None], best]))
        z = np.concatenate(pooled, 1)
        prob = _softmax(z @ p["V"] + p["c"])
        d = prob.copy()
        d[np.arange(n), y] -= 1
        d /= n
        g["V"], g["c"], g["E"] = z.T @ d, d.sum(0), np.zeros_like(p["E"])
        dz = d @ p["V"].T * (z > 0)
        for k, w in enumerate(WIDTHS):
            best, patch = taken[k]
            dk = dz[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"W{w}"] = np.einsum("nf,nfp->pf", dk, patch)
            g[f"b{w}"] = dk.sum(0)
            back = (dk[:, :, None] * p[f"W{w}"].T).reshape(n, FILTERS, w, EMBED)
            at = x[np.arange(n)[:, None, None], best[:, :, None] + np.arange(w)]
            np.add.at(g["E"], at, back)
        return g

    def fit(self, windows: np.ndarray, labels: np.ndarray, steps=STEPS, batch=BATCH, seed=11):
        rng = np.random.default_rng(seed)
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        by_class = [np.flatnonzero(labels == k) for k in range(len(self.classes))]
        for t in range(1, steps + 1):
            pick = np.array([rng.choice(by_class[k]) for k in rng.integers(0, len(by_class), batch)])
            x = windows[pick].copy()
            # short texts are windows with much padding: show the network such windows too
            cut = np.where(rng.random(batch) < 0.3, rng.integers(8, WINDOW, batch), WINDOW)
            x[np.arange(WINDOW) >= cut[:, None]] = 0
            for k, v in self.step(x, labels[pick]).items():
                a, b = m[k]
                a += 0.1 * (v - a)
                b += 0.001 * (v * v - b)
                self.p[k] -= 0.01 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        return self

    def tables(self) -> dict:
        """Filters as lookup tables over byte pairs (and the last byte of odd widths)."""
        out = {}
        for w in WIDTHS:
            by_byte = np.einsum("be,wef->wbf", self.p["E"], self.p[f"W{w}"].reshape(w, EMBED, FILTERS)).astype(np.float32)
            out[w] = [(j, (by_byte[j][:, None] + by_byte[j + 1][None]).reshape(65536, FILTERS)) for j in range(0, w - 1, 2)]
            if w % 2:
                out[w].append((w - 1, by_byte[w - 1]))
        return out

    def predict(self, windows: np.ndarray, tables: dict) -> np.ndarray:
        """Class distribution of each window (n, WINDOW) of bytes."""
        pairs = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        pooled = []
        for w, parts in tables.items():
            n = WINDOW - w + 1
            act = None
            for j, table in parts:
                got = table[(pairs if len(table) == 65536 else windows)[:, j : j + n]]
                act = got if act is None else np.add(act, got, out=act)
            pooled.append(np.maximum(act.max(1) + self.p[f"b{w}"], 0))
        return _softmax(np.concatenate(pooled, 1) @ self.p["V"] + self.p["c"])


def _softmax(a):
    e = np.exp(a - a.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _windows(texts: list[bytes]):
    """Windows of all texts, the text of each and its bytes without padding."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], dtype=np.int64)
    buf = b"".join(t + b"\0" * (n * WINDOW - len(t)) for t, n in zip(texts, counts.tolist()))
    owner = np.repeat(np.arange(len(texts)), counts)
    size = np.full(len(owner), WINDOW)
    ends = np.cumsum(counts)[counts > 0] - 1
    size[ends] -= np.array([int(n) * WINDOW - len(t) for t, n in zip(texts, counts.tolist()) if n], dtype=np.int64)
    return np.frombuffer(buf, np.uint8).reshape(-1, WINDOW), owner, size


def fit(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", folds=FOLDS, per_class=PER_CLASS) -> ByteCnn | None:
    known = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.where(fold("id", folds) != 0).where("lang is not null and octet_length(text) > 0")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().take(MAX_CLASSES + 1)}
    if not counts:
        return None
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} languages")
    classes = sorted(counts)
    # a hash threshold for each language: about per_class documents, without ordering a language
    share = F.create_map(*[x for k in classes for x in (F.lit(k), F.lit(min(1.0, per_class / counts[k])))])
    draw = F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.where(draw < F.element_at(share, F.col("lang")))
    # PER_DOC windows at places fixed by the id, anywhere in the text; only they reach the driver
    cut = F.transform(F.sequence(F.lit(1), F.lit(PER_DOC)), lambda k: F.substring(
        "text", (F.pmod(F.xxhash64("id", k), F.greatest(F.length("text") - WINDOW, F.lit(1))) + 1).cast("int"), F.lit(WINDOW)))
    got = sample.select("lang", F.explode(cut).alias("piece")).toPandas().sort_values(["lang", "piece"])
    pieces = [x[:WINDOW] for x in c.encode(got["piece"])]
    windows = np.frombuffer(b"".join(x.ljust(WINDOW, b"\0") for x in pieces), np.uint8).reshape(-1, WINDOW)
    labels = np.searchsorted(classes, got["lang"].to_numpy())
    return ByteCnn(classes).fit(windows, labels)


def identify(docs: DataFrame, model: ByteCnn | None, text_col="text") -> DataFrame:
    """``docs`` with lang_pred and score in columns ``_lang_pred, _score``."""
    schema = docs.withColumns({"_lang_pred": F.lit(""), "_score": F.lit(0.0)}).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        net = sent.value
        tables = net.tables() if net else None
        for pdf in batches:
            texts = c.encode(pdf[text_col])
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            lettered = [i for i, t in enumerate(pdf[text_col]) if net and isinstance(t, str) and _LETTER.search(t)]
            total = np.zeros((len(texts), len(net.classes) if net else 1))
            for first, last in c.chunks([texts[i] for i in lettered], 1 << 18):
                part = lettered[first:last]
                windows, owner, size = _windows([texts[i] for i in part])
                for lo in range(0, len(windows), AT_ONCE):
                    prob = net.predict(windows[lo : lo + AT_ONCE], tables)
                    np.add.at(total, np.array(part)[owner[lo : lo + AT_ONCE]], prob * size[lo : lo + AT_ONCE, None])
            for i in lettered:
                k = int(total[i].argmax())
                lang[i], score[i] = net.classes[k], float(min(1.0, total[i, k] / total[i].sum()))
            yield pdf.assign(_lang_pred=lang, _score=score)

    return docs.mapInPandas(predict, schema)


def reject_unknown(docs: DataFrame, model: ByteCnn | None = None, min_score=0.3, **columns) -> DataFrame:
    """Documents whose language is known: not ``und``, and of at least ``min_score``."""
    rows, names = c.shielded(docs, ("text",))
    found = identify(rows, model if model is not None else fit(docs, **columns))
    known = found.where((F.col("_lang_pred") != "und") & (F.col("_score") >= min_score)).select(*[f"`{x}`" for x in rows.columns])
    return known.withColumnsRenamed(names)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    model = fit(docs)
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))
