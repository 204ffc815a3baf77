"""Toxic passages by maximum-scoring segment search.

Training: how many toxic and clean labelled documents hold a token (a token repeated within one document counts
once) gives its log-odds under informative Dirichlet priors (prior mass in proportion to the token's total
count), with their variance. A token whose lower confidence bound is above a margin scores what lies above it;
every other token costs `drift`, so a random text drifts down. A linear-time scan (Ruzzo and Tompa) over whole texts yields all maximal-scoring segments.

Calibration: under the clean token mix, a text's best segment follows an extreme-value law
P(S >= x) = 1 - exp(-K n exp(-lambda x)); lambda solves sum p exp(lambda s) = 1 and K is fitted to clean
training documents. A segment is significant where its expected count is below `level`. The log-significances
of a text's segments add up, and a logistic curve over labelled rows turns the sum into a score.

Scores depend on the text alone. Defined cases: null and empty texts have no segment and get the lowest score;
labels other than 0 and 1 are left out; without labels of both kinds every score is the share of label 1 (0
without any); repeated rows get equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actloom.llm.common import documents, id_remainder, labels, map_rows, stage_table, narrow
from actloom.llm.quality_trees import training_rows

#: Labelled rows that are fitted on, drawn evenly by a hash of the id; all where there are fewer.
MAX_TRAIN = 20_000
#: Prior mass in documents, deviations below the estimate that count, cost of any other token, significance.
PRIOR, DEVIATIONS, DRIFT, LEVEL = 20.0, 2.5, 0.15, 0.05
#: A token must be at least twice as frequent in toxic documents to score.
MARGIN = float(np.log(2))
#: Distinct words that a worker keeps the gain of.
REMEMBER = 250_000
#: Lower-cases ASCII and makes its other characters but letters, digits and apostrophes blanks.
TOKENS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 or b == 39 else 32 for b in range(256)
)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TOKENS).split()


def pieces(word: bytes) -> list[bytes]:
    """A word's tokens: itself, and its beginnings of four to six bytes, marked with a star."""
    return [word, *[word[:n] + b"*" for n in (4, 5, 6) if len(word) >= n]]


def maximal_segments(places: list[int], gains: list[float], drift: float) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first, last token) of a text whose tokens at `places` gain
    `gains` while every other token costs drift. Only places are visited; a segment begins and ends at one."""
    found: list[tuple[float, float, int, int]] = []  # sum before it, sum after it, first, last
    total, behind = 0.0, -1
    for at, gain in zip(places, gains):
        before = total - drift * (at - behind - 1)
        total, behind = before + gain, at
        left, right, first, last = before, total, at, at
        while found:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j -= 1
            if j < 0 or found[j][1] >= right:
                break
            left, first = found[j][0], found[j][2]
            del found[j:]
        found.append((left, right, first, last))
    return [(r - l, a, b) for l, r, a, b in found]


@dataclass
class Toxicity:
    gains: dict[bytes, float] = field(default_factory=dict)
    drift: float = DRIFT
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    slope: float = 0.0
    offset: float = 0.0
    level: float = LEVEL
    known: dict[bytes, float] = field(default_factory=dict, repr=False)  # words met so far

    def segments(self, text: str | None) -> tuple[int, list[tuple[float, int, int]]]:
        """Number of tokens, and the maximal segments with their scores."""
        words = tokens(text)
        got = [self.known.get(w) for w in words]
        if None in got:
            if len(self.known) > REMEMBER:
                self.known.clear()
            for i, g in enumerate(got):
                if g is None:
                    w = words[i]
                    got[i] = self.known[w] = max([self.gains.get(p, 0.0) for p in pieces(w)])
        if not any(got):
            return len(words), []
        places = [i for i, g in enumerate(got) if g]
        return len(words), maximal_segments(places, [got[i] for i in places], self.drift)

    def significance(self, score: float, n: int) -> float:
        """-ln of the expected number of such segments in a clean text of n tokens."""
        return self.rate * score - np.log(max(self.scale * max(n, 1), 1e-12))

    def passages(self, text: str | None) -> list[tuple[int, int, float]]:
        """Significant toxic passages: first token, last token, -ln of the expected count."""
        n, found = self.segments(text)
        out = [(a, b, self.significance(s, n)) for s, a, b in found]
        return [x for x in out if x[2] >= -np.log(self.level)]

    def evidence(self, text: str | None) -> tuple[float, int]:
        got = self.passages(text)
        return float(sum(x[2] for x in got)), len(got)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.offset + self.slope * np.log1p(np.asarray(evidence, float)))))


def log_odds(counts: list[tuple[bytes, int, int]], n_toxic: int, n_clean: int) -> dict[bytes, float]:
    """Lower bounds of the tokens' log-odds above MARGIN, where there are any. counts: token, toxic documents,
    clean documents that hold it."""
    if not counts or not n_toxic or not n_clean:
        return {}
    t, c = np.array([x[1] for x in counts], float), np.array([x[2] for x in counts], float)
    prior = PRIOR * (t + c) / (n_toxic + n_clean)
    odds = np.log((t + prior) / (n_toxic + PRIOR - t - prior)) - np.log((c + prior) / (n_clean + PRIOR - c - prior))
    bound = odds - DEVIATIONS * np.sqrt(1 / (t + prior) + 1 / (c + prior))
    return {counts[i][0]: float(bound[i] - MARGIN) for i in np.flatnonzero(bound > MARGIN)}


def decay_rate(gains: np.ndarray, shares: np.ndarray, drift: float) -> float:
    """The positive root of sum p exp(lambda s) = 1, where all other tokens score -drift."""
    rest = max(0.0, 1 - shares.sum())
    excess = lambda r: float((shares * np.exp(np.minimum(r * gains, 700))).sum() + rest * np.exp(-r * drift) - 1)
    if not len(gains) or (shares * gains).sum() - rest * drift >= 0:
        return 0.01
    low, high = 0.0, 1.0
    while excess(high) < 0 and high < 1e4:
        low, high = high, 2 * high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return max(high, 0.01)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 0.05) -> tuple[float, float]:
    """Offset and slope by Newton steps."""
    if not len(y) or len(np.unique(y)) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
        return float(np.log(share / (1 - share))), 0.0
    design, w = np.stack([np.ones(len(x)), x], 1), np.zeros(2)
    penalty = np.diag([1e-6, ridge])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-design @ w))
        w = w + np.linalg.solve(design.T * (p * (1 - p)) @ design + penalty, design.T @ (y - p) - penalty @ w)
    return float(w[0]), float(max(w[1], 0.0))


def fit(df: DataFrame, labelled: DataFrame, usable, at_most: int = MAX_TRAIN) -> Toxicity:
    """Model from labelled rows. Token counts are summed by Spark; the driver gets the tokens that lean to
    toxic documents and three numbers per training row."""
    rows = stage_table(training_rows(df, labelled, "toxic", usable, at_most), "toxic-train")

    def make_counts():
        def work(cols: dict) -> dict:
            docs, uses = (Counter(), Counter()), Counter()
            for text, y in zip(cols["text"], cols["y"]):
                words = tokens(text)
                once = Counter(words)
                held = [(p, n) for w, n in once.items() for p in pieces(w)]
                docs[y].update({p for p, _ in held})
                if not y:
                    for p, n in held:
                        uses[p] += n
            words = list(docs[0].keys() | docs[1].keys())
            return {
                "token": words, "toxic": [docs[1][w] for w in words], "clean": [docs[0][w] for w in words],
                "uses": [uses[w] for w in words],
            }

        return work

    counts = map_rows(rows, "token binary, toxic long, clean long, uses long", make_counts, rows_at_once=2048)
    counts = counts.groupBy("token").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "uses")])
    counts = stage_table(counts, "toxic-tokens")
    by_label = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    n_toxic, n_clean = by_label.get(1, 0), by_label.get(0, 0)
    n_uses = counts.agg(F.sum("uses")).first()[0] or 1
    # Tokens of fewer than 5 toxic documents, or at less than twice the clean rate, can't pass the bound.
    leaning = counts.filter((F.col("toxic") >= 5) & (F.col("toxic") * n_clean > 2 * F.col("clean") * n_toxic))
    found = leaning.collect()
    seen = [(bytes(r.token), r.toxic, r.clean) for r in found]
    model = Toxicity(gains=log_odds(seen, n_toxic, n_clean))
    clean_uses = {bytes(r.token): r.uses for r in found}
    gains = np.array(list(model.gains.values()))
    shares = np.array([(clean_uses[w] + 0.5) / n_uses for w in model.gains])
    model.rate = decay_rate(gains, shares, model.drift)

    def score_rows(per_row, schema):
        def make():
            return lambda cols: per_row(cols)
        return map_rows(rows, schema, make)

    def best(cols: dict) -> dict:
        found = [model.segments(t) for t in cols["text"]]
        return {"y": cols["y"], "n": [n for n, _ in found], "s": [max((x[0] for x in f), default=0.0) for _, f in found]}

    got = score_rows(best, "y int, n long, s double").collect()
    # Median of S over clean texts that have a segment gives K: P(S >= x) = share, as the law says.
    tail = sorted((model.rate * r.s - np.log(max(r.n, 1)) for r in got if r.y == 0 and r.s > 0), reverse=True)
    clean = sum(1 for r in got if r.y == 0)
    if not tail and len(gains):  # as if one clean text more had the least segment
        tail = [model.rate * float(gains.min()) - np.log(max(np.mean([max(r.n, 1) for r in got]), 1))]
    at = len(tail) // 2
    share = min((at + 1) / (clean + 1), 0.999)
    model.scale = float(-np.log1p(-share) * np.exp(tail[at])) if tail else 1.0

    def evidence(cols: dict) -> dict:
        return {"y": cols["y"], "e": [model.evidence(t)[0] for t in cols["text"]]}

    got = sorted(score_rows(evidence, "y int, e double").collect())
    model.offset, model.slope = logistic(np.log1p(np.array([r.e for r in got])), np.array([r.y for r in got], float))
    return model


def score_documents(df: DataFrame, model: Toxicity, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, number of significant passages and the passages' token ranges first:last, comma-joined."""

    def make():
        def work(cols: dict) -> dict:
            found = [model.passages(t) for t in cols["text"]]
            return {
                "doc_id": cols["doc_id"], "score": model.score(np.array([sum(x[2] for x in f) for f in found], float)),
                "n_passages": [len(f) for f in found], "passages": [",".join(f"{a}:{b}" for a, b, _ in f) for f in found],
            }

        return work

    return map_rows(narrow(df, key, text), "doc_id long, score double, n_passages long, passages string", make)


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, labels(spark, sf_dir), id_remainder("doc_id", 4) != 2)
    return score_documents(docs, model).select(
        "doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_passages", "passages",
    )
