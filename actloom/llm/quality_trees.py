"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown level by level on binned statistics (logistic loss, second order) in numpy, on at most
MAX_TRAIN labelled rows, and flattened into arrays: trees x nodes of feature, threshold and value. A block of
documents walks all trees at once.

Scores depend on the text alone. Defined cases: null and empty texts have all statistics zero and get a score
like any other; labels other than 0 and 1 are left out; repeated rows get equal scores; without labels of both
kinds every score is the share of label 1 (0.5 without any); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actloom.llm.common import documents, id_remainder, labels, map_rows, narrow
from actloom.llm.text_stats import COUNTS, count_text

#: Labelled rows that are fitted on, drawn evenly by a hash of the id; all where there are fewer.
MAX_TRAIN = 20_000
TREES, DEPTH, BINS, RATE, LEAST_WEIGHT, RIDGE = 60, 4, 64, 0.2, 2.0, 1.0
FEATURES = (
    "words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "marks", "high",
    "shouts", "longest_word", "line_words", "longest_line",
)


def features(texts: list[str | None]) -> np.ndarray:
    """Statistics of each text that trees split on."""
    raw = np.array([count_text(t) for t in texts], float).reshape(-1, len(COUNTS))
    c = dict(zip(COUNTS, raw.T))
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / lines,
        c["n_repeat_words"] / words, c["n_distinct_words"] / words, c["n_upper"] / chars, c["n_digits"] / chars,
        c["n_marks"] / chars, c["n_high"] / chars, c["n_shouts"] / words, c["longest_word"], c["n_words"] / lines,
        np.log1p(c["longest_line"]),
    ], axis=1)


@dataclass
class Trees:
    """Complete binary trees; node i has children 2i+1 and 2i+2. A node that isn't split sends all left."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        row, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), np.int64)
        while node[0, 0] < inner if len(x) else False:
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        margin = self.base + self.value[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    share = np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999)
    base, inner = float(np.log(share / (1 - share))), 2**depth - 1
    out = Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if len(np.unique(y)) < 2:
        return out
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    binned = np.stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T)], axis=1)
    margin = np.full(len(y), base)
    grown = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.full(width, 1e-6)
            cut = np.full(width, -1)
            for f in range(x.shape[1]):
                cell = at * bins + binned[:, f]
                gs = np.bincount(cell, g, width * bins).reshape(width, bins)
                hs = np.bincount(cell, h, width * bins).reshape(width, bins)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                ga, ha = gs.sum(1)[:, None], hs.sum(1)[:, None]
                gain = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
                gain[(hl < LEAST_WEIGHT) | (ha - hl < LEAST_WEIGHT)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                best[better] = gain[np.arange(width), top][better]
                feature[first : first + width][better] = f
                cut[better] = top[better]
            for n in np.flatnonzero(cut >= 0):
                e = edges[feature[first + n]]
                threshold[first + n] = e[cut[n]] if cut[n] < len(e) else np.inf
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + RIDGE)
        margin += value[leaf]
        grown.append((feature, threshold, value))
    return Trees(base, *(np.stack(part) for part in zip(*grown)))


def training_rows(df: DataFrame, labelled: DataFrame, label: str, usable: Column, at_most: int) -> DataFrame:
    """doc_id, text and y of the labelled rows: at most so many, drawn by a hash of the id."""
    chosen = (
        labelled.filter(F.col(label).isin(0, 1) & usable).select("doc_id", F.col(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(at_most)
    )
    return narrow(df).join(F.broadcast(chosen), "doc_id")  # of at_most narrow rows


def fit(df: DataFrame, labelled: DataFrame, label: str, usable: Column, at_most: int = MAX_TRAIN) -> Trees:
    """Trees from labelled rows; only their statistics reach the driver, at_most x features numbers (repeated
    rows of an id come on top)."""

    def make():
        def work(cols: dict) -> dict:
            return {"doc_id": cols["doc_id"], "y": cols["y"], "x": list(features(cols["text"]))}

        return work

    rows = map_rows(training_rows(df, labelled, label, usable, at_most), "doc_id long, y int, x array<double>", make).collect()
    rows.sort(key=lambda r: (r.doc_id, r.y, r.x))
    x = np.array([r.x for r in rows], float).reshape(-1, len(FEATURES))
    return grow(x, np.array([r.y for r in rows], float))


def score_documents(df: DataFrame, trees: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every whole text."""

    def make():
        def work(cols: dict) -> dict:
            return {"doc_id": cols["doc_id"], "score": trees.score(features(cols["text"]))}

        return work

    return map_rows(narrow(df, key, text), "doc_id long, score double", make)


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    trees = fit(docs, labels(spark, sf_dir), "quality", id_remainder("doc_id", 5) != 0)
    return score_documents(docs, trees).select(
        "doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
