"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

1. A page becomes its leaf blocks (``html_blocks``), each with features of its ancestor elements, their
   names and its text, and its neighbours' length and links.
2. The field is trained in numpy on labelled pages: ``TRAIN_PAGES`` layouts whose parts are known
   (``html_layouts``), worded with the words of at most ``SAMPLE_PAGES`` pages of the table (those with the smallest
   hashes, ``SAMPLE_CHARS`` characters of each: a documented bound of the training sample alone). Labels
   are main, reader comment and other; transitions depend on whether two blocks lie in the same element.
   Log-likelihood with a quadratic penalty, by Adam on all pages at once.
3. Viterbi decodes every whole page in a task of its own partition; the main blocks are the text.

Defined results: null and empty pages, pages without text: empty text. A page without markup is one block.
Repeated rows and ids each keep their row; a null id or url stays null; extra columns are ignored. An
empty table has no rows (the model is then trained with words of its own). The pass over a page is linear
in its length; a page is one row."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.html_blocks import FEATURES, features, leaf_blocks
from corpuslab.llm.html_layouts import LABELS, labelled_pages

TRAIN_PAGES, STEPS, PENALTY, RATE = 500, 100, 0.4, 0.15
GROUP = 125  # training pages padded together
SAMPLE_PAGES, SAMPLE_CHARS = 200, 8000
MAIN = LABELS.index("main")
OWN_WORDS = "the of and to a in is it you that he was for on are as with his they be at one have this from or had by word but what some we can out other were all there when up use your how said an each she".split()


class Field(NamedTuple):
    """Weights: of features (features x labels), first labels, transitions (2 x labels x labels)."""

    emit: np.ndarray
    first: np.ndarray
    move: np.ndarray


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class _Pages:
    """Pages of similar length, padded to one: their features, transition kinds and labels."""

    def __init__(self, pages):
        self.n, lengths = len(pages), np.array([len(y) for _, y in pages])
        self.shape = (self.n, int(lengths.max()))
        self.inside = np.arange(self.shape[1])[None] < lengths[:, None]
        self.x = np.zeros((int(lengths.sum()), len(FEATURES)))
        self.same, truth = np.zeros(self.shape, int), np.zeros(self.shape, int)
        row, k = 0, len(LABELS)
        for i, ((on, inner), y) in enumerate(pages):
            for active in on:
                self.x[row, active] = 1
                row += 1
            self.same[i, : len(y)], truth[i, : len(y)] = inner, y
        self.seen = [self.x.T @ np.eye(k)[truth[self.inside]], np.bincount(truth[:, 0], minlength=k).astype(float), np.zeros((2, k, k))]
        later = self.inside[:, 1:]
        np.add.at(self.seen[2], (self.same[:, 1:][later], truth[:, :-1][later], truth[:, 1:][later]), 1)

    def slopes(self, emit, first, move):
        """Expected minus seen counts of features, first labels and transitions: forward and backward sums."""
        scores = np.zeros((*self.shape, len(LABELS)))
        scores[self.inside] = self.x @ emit
        fore, back = np.empty_like(scores), np.zeros_like(scores)
        steps, more = move[self.same], self.inside[..., None]
        fore[:, 0] = scores[:, 0] + first
        for t in range(1, self.shape[1]):
            fore[:, t] = np.where(more[:, t], _log_sum(fore[:, t - 1, :, None] + steps[:, t], 1) + scores[:, t], fore[:, t - 1])
        for t in range(self.shape[1] - 2, -1, -1):
            back[:, t] = np.where(more[:, t + 1], _log_sum(steps[:, t + 1] + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2), 0.0)
        total = _log_sum(fore[:, -1], 1)
        one = np.exp(fore + back - total[:, None, None])
        later = self.inside[:, 1:]
        two = (fore[:, :-1, :, None] + steps[:, 1:] + (scores + back)[:, 1:, None, :] - total[:, None, None, None])[later]
        two, kind = np.exp(two), self.same[:, 1:][later]
        moved = np.stack([two[kind == s].sum(0) for s in (0, 1)])
        return [a - b for a, b in zip((self.x.T @ one[self.inside], one[:, 0].sum(0), moved), self.seen)]


def train(pages, steps: int = STEPS, penalty: float = PENALTY) -> Field:
    """A field of (blocks, labels) pages."""
    kept = sorted(((features(b), y) for b, y in pages if b), key=lambda p: len(p[1]))
    groups = [_Pages(kept[i : i + GROUP]) for i in range(0, len(kept), GROUP)]
    k = len(LABELS)
    weights = [np.zeros((len(FEATURES), k)), np.zeros(k), np.zeros((2, k, k))]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        each = [g.slopes(*weights) for g in groups]
        for i, w in enumerate(weights):
            g = (sum(e[i] for e in each) + penalty * w) / len(kept)
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            w -= RATE * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)
    return Field(*weights)


def decode(field: Field, blocks: list) -> list[int]:
    """The likeliest labels of a page's blocks (Viterbi; of equal paths the one with lower labels)."""
    if not blocks:
        return []
    on, same = features(blocks)
    bounds = np.cumsum([0] + [len(a) for a in on])[:-1]
    scores = np.add.reduceat(field.emit[np.concatenate(on)], bounds, axis=0).tolist()
    best, move, back = [s + f for s, f in zip(scores[0], field.first.tolist())], field.move.tolist(), []
    for emit, s in zip(scores[1:], same[1:]):
        came, now = [], []
        for j in range(len(LABELS)):
            reach = [best[i] + move[s][i][j] for i in range(len(LABELS))]
            top = max(reach)
            came.append(reach.index(top))
            now.append(top + emit[j])
        back.append(came)
        best = now
    label = best.index(max(best))
    out = [label]
    for came in reversed(back):
        label = came[label]
        out.append(label)
    return out[::-1]


def sample_words(pages: DataFrame, html_col="html") -> list[str]:
    """Words of the text of a bounded sample of pages, for the wording of training pages."""
    page = F.col(html_col).cast("string")
    hashed = pages.where(F.length(page) > 0).select(F.xxhash64(page).alias("h"), F.substring(page, 1, SAMPLE_CHARS).alias("page"))
    low = [r["h"] for r in hashed.select("h").distinct().orderBy("h").take(SAMPLE_PAGES)]  # hashes first: no task sends pages that are not drawn
    if not low:
        return OWN_WORDS
    drawn = hashed.where(F.col("h") <= low[-1]).groupBy("h").agg(F.min("page").alias("page")).orderBy("h").collect()  # a page for each of these hashes
    words = [w for r in drawn for b in leaf_blocks(r["page"]) for w in re.findall(r"[^\W\d_]{1,20}", b.text)]
    return words if len(words) >= 500 else OWN_WORDS


def fit(pages: DataFrame, html_col="html") -> Field:
    return train(labelled_pages(sample_words(pages, html_col), TRAIN_PAGES))


def label_blocks(pages: DataFrame, field: Field, id_col="page_id", html_col="html") -> DataFrame:
    """page_id, block (its number), tag, label, text: every leaf block of every page."""

    def label(batches):
        for pdf in batches:
            rows = []
            for page, html in zip(pdf["id"], pdf["html"]):
                blocks = leaf_blocks(html) if isinstance(html, str) else []
                rows += [(page, i, b.tag, LABELS[y], b.text) for i, (b, y) in enumerate(zip(blocks, decode(field, blocks)))]
            yield pd.DataFrame(rows, columns=["page_id", "block", "tag", "label", "text"])

    return pages.select(F.col(id_col).cast("string").alias("id"), F.col(html_col).cast("string").alias("html")).mapInPandas(label, "page_id string, block int, tag string, label string, text string")


def extract(pages: DataFrame, field: Field, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def main_text(batches):
        for pdf in batches:
            texts = []
            for html in pdf["html"]:
                blocks = leaf_blocks(html) if isinstance(html, str) else []
                texts.append(" ".join(b.text for b, y in zip(blocks, decode(field, blocks)) if y == MAIN))
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return base.mapInPandas(main_text, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")
    return extract(pages, fit(pages))
