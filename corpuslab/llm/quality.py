"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics of a whole text (length, word shapes, character classes, repetition, line shapes) are
transformed to be nearly symmetric. Each class of ``labels.quality`` has a mean and a covariance
shrunk towards its diagonal and towards the pooled one; a score is the logistic of the difference of
log densities and log priors, with Mahalanobis distances by cached Cholesky factors.

Means and covariances are sums over all labelled rows of the training folds (crc32(id) mod ``FOLDS``
is not ``HELD``), added up by Spark; only the class sums reach the driver.

Defined results: a null text counts as empty and gets a score like others; without rows of both
classes every score is 0.5. Null ids are held in training only if labelled (a null matches no label,
so never). Labels repeated for an id count each; null labels don't count. Empty table: empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import common as c
from corpuslab.llm.langid import fold

FOLDS, HELD, SHRINK, CUT = 4, 2, 0.1, 0.7
_CLASS = np.zeros(256, dtype=np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 sentence mark, 7 beyond ASCII
for _name, _chars in ((1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"0123456789"), (4, b" \t"), (5, b"\n\r"), (6, b".,;:?'\"-")):
    _CLASS[list(_chars)] = _name
_CLASS[128:] = 7
NAMES = ("log_bytes", "log_words", "word_len", "word_sd", "upper", "digit", "blank", "line_end", "mark", "other", "beyond",
         "distinct", "top_word", "repeat_next", "edge_symbol", "symbol_word", "log_line", "line_repeat", "byte_entropy", "bang")


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text."""
    n = len(text)
    if not n:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kind = np.bincount(_CLASS, weights=counts, minlength=8) / n
    words = text.split()
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    seen: dict[bytes, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    again = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    p = counts[counts > 0] / n
    symbol = sum(x[-1] in b"#&$%*!|~^=<>" for x in words)
    alone = sum(len(x) == 1 and not x.isalnum() and x[0] < 128 for x in words)
    root = math.sqrt
    return [math.log1p(n), math.log1p(len(words)), math.log(max(1.0, sizes.mean())), math.log1p(sizes.std()),
            root(kind[2]), root(kind[3]), root(kind[4]), root(kind[5]), root(kind[6]), root(kind[0]), root(kind[7]),
            len(seen) / w / (1 + math.log1p(w)) * 5, root(max(seen.values(), default=0) / w), root(again / w), root(symbol / w), root(alone / w),
            math.log1p(n / max(1, len(lines))), root(1 - len(set(lines)) / max(1, len(lines))), float(-(p * np.log2(p)).sum()), root(counts[33] / n)]


class Discriminant:
    def __init__(self, sums: dict, shrink=SHRINK):
        """sums: class -> (rows, sum of x, sum of x x')."""
        n = sum(s[0] for s in sums.values())
        within = sum(s[2] - np.outer(s[1], s[1]) / s[0] for s in sums.values()) / n
        self.scale = np.sqrt(np.maximum(np.diag(within), 1e-6))
        self.parts = []
        pooled = within / np.outer(self.scale, self.scale)
        for label in (0, 1):
            rows, x, xx = sums[label]
            mean = x / rows
            cov = (xx / rows - np.outer(mean, mean)) / np.outer(self.scale, self.scale)
            few = shrink + (1 - shrink) * len(mean) / (len(mean) + rows)  # the fewer rows, the nearer to the pooled one
            cov = (1 - few) * cov + few * pooled
            cov = (1 - shrink) * cov + shrink * np.diag(np.maximum(np.diag(cov), 0.05))
            low = np.linalg.cholesky(cov + 1e-6 * np.eye(len(mean)))
            self.parts.append((mean, low, math.log(rows / n) - np.log(np.diag(low)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        density = []
        for mean, low, const in self.parts:
            z = np.linalg.solve(low, ((x - mean) / self.scale).T)
            density.append(const - 0.5 * (z * z).sum(0))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def features(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def measure(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "x": [np.array(statistics(t)).tobytes() for t in c.encode(pdf["text"])]})

    return base.mapInPandas(measure, "id long, x binary")


def fit(found: DataFrame, labels: DataFrame, id_col="doc_id", label_col="quality", folds=FOLDS, held=HELD) -> Discriminant | None:
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    rows = found.join(marked.where(fold("id", folds) != held), "id")

    def add(batches):
        sums = {}
        for pdf in batches:
            x = np.array([np.frombuffer(b) for b in pdf["x"]]).reshape(len(pdf), -1)
            for label in (0, 1):
                part = x[pdf["label"].to_numpy() == label]
                if len(part):
                    one = np.r_[len(part), part.sum(0), (part.T @ part).ravel()]
                    sums[label] = sums.get(label, 0) + one
        for label, v in sums.items():
            yield pd.DataFrame({"label": label, "k": np.arange(len(v)), "v": v})

    got = rows.mapInPandas(add, "label int, k int, v double").groupBy("label", "k").agg(F.sum("v").alias("v")).toPandas()
    d, sums = len(NAMES), {}
    for label, part in got.groupby("label"):
        v = part.sort_values("k")["v"].to_numpy()
        sums[label] = (v[0], v[1 : d + 1], v[d + 1 :].reshape(d, d))
    return Discriminant(sums) if len(sums) == 2 else None


def score(found: DataFrame, model: Discriminant | None) -> DataFrame:
    def apply(batches):
        for pdf in batches:
            x = np.array([np.frombuffer(b) for b in pdf["x"]]).reshape(len(pdf), -1)
            yield pd.DataFrame({"id": pdf["id"], "score": model.score(x) if model is not None and len(pdf) else np.full(len(pdf), 0.5)})

    return found.mapInPandas(apply, "id long, score double")


def classify(docs: DataFrame, labels: DataFrame, cut=CUT, **columns) -> DataFrame:
    """id, held_out, score, predicted for every document."""
    found = c.checkpointed(features(docs, **columns))
    out = score(found, fit(found, labels))
    return out.select("id", (fold("id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    sf = sf_dir.rstrip("/")
    out = classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    return out.withColumnRenamed("id", "doc_id")
