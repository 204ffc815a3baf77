"""Quality rules with risk-controlled thresholds.

Each rule rejects documents whose statistic exceeds a cutoff. Cutoffs come from labelled holdouts: per stratum
and rule, cutoffs are tested from the loosest on, and a cutoff counts as safe while the exact binomial
(Clopper-Pearson) bound on the share of good documents it rejects stays below that rule's part of the risk.
Testing in a fixed order costs no correction within a rule; over rules and strata the confidence is
divided (Bonferroni). Of the safe cutoffs, the one that gains most on the labelled bad documents is taken.
A stratum with too few labels gets no cutoff: nothing can be guaranteed, so nothing is rejected there.

Strata are bands of document length. The labels only count documents; text reaches the driver never.

Defined cases: null and empty texts have zero counts and fail the base rule; null labels are left out, a
document with several labels counts once for each; repeated rows get equal verdicts; an empty table gives no
rows; without labels only the base rule decides; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actloom.llm.common import documents, labels, stage_table
from actloom.llm.text_stats import count_documents

#: Share of good documents that all rules together may reject in a stratum, and the confidence of that.
RISK, CONFIDENCE = 0.02, 0.95
#: Cutoffs tried: so many steps from 1 down to 0.
STEPS = 200
BANDS = (200, 1000)


def _share(part: str, of: str) -> Column:
    return F.least(F.col(part) / F.greatest(F.col(of), F.lit(1)), F.lit(1.0))



def rule_values() -> dict[str, Column]:
    """Each rule's statistic, 0 to 1; higher is worse."""
    return {
        "symbols": _share("n_symbols", "word_chars"),
        "dup_lines": _share("n_dup_lines", "n_lines"),
        "repeats": _share("n_repeat_words", "n_words"),
        "upper": F.least(F.col("n_upper") / F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1)), F.lit(1.0)),
        "shouts": _share("n_shouts", "n_words"),
    }


def stratum() -> Column:
    out = F.when(F.col("n_words") < BANDS[0], 0)
    for i, edge in enumerate(BANDS[1:], 1):
        out = out.when(F.col("n_words") < edge, i)
    return out.otherwise(len(BANDS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def below_risk(bad: int, total: int, risk: float, doubt: float) -> bool:
    """Whether the exact upper bound on a rate, seen `bad` times in `total`, is at most risk:
    P(Binomial(total, risk) <= bad) <= doubt."""
    if total == 0:
        return False
    terms = [
        math.lgamma(total + 1) - math.lgamma(i + 1) - math.lgamma(total - i + 1)
        + i * math.log(risk) + (total - i) * math.log1p(-risk)
        for i in range(bad + 1)
    ]
    top = max(terms)
    return top + math.log(sum(math.exp(t - top) for t in terms)) <= math.log(doubt)


@dataclass(frozen=True)
class Cutoff:
    stratum: int
    rule: str
    cutoff: float
    good: int
    good_rejected: int
    bad_rejected: int


def choose(bins: dict[tuple[int, str], dict[int, tuple[int, int]]], risk: float, confidence: float) -> list[Cutoff]:
    """bins: per stratum and rule, step -> (good, bad) documents whose value lies above step / STEPS and not
    above the next."""
    rules, strata = {r for _, r in bins}, {s for s, _ in bins}
    if not bins:
        return []
    doubt = (1 - confidence) / (len(rules) * len(strata))
    out = []
    for (band, rule), by_step in sorted(bins.items()):
        good = sum(g for g, _ in by_step.values())
        best, kept, gone_good, gone_bad = 0.0, None, 0, 0
        for step in range(STEPS - 1, -1, -1):
            g, b = by_step.get(step, (0, 0))
            gone_good, gone_bad = gone_good + g, gone_bad + b
            if not below_risk(gone_good, good, risk / len(rules), doubt):
                break
            gain = gone_bad - 20 * gone_good
            if gain > best:
                best, kept = gain, Cutoff(band, rule, step / STEPS, good, gone_good, gone_bad)
        if kept:
            out.append(kept)
    return out


def fit(counts: DataFrame, labelled: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> list[Cutoff]:
    """Cutoffs from labelled rows (doc_id, quality) and the counts of all documents. At most
    strata x rules x steps rows reach the driver."""
    names = list(rule_values())
    rows = (
        counts.filter(~base_failed()).join(labelled.filter(F.col("quality").isNotNull()), "doc_id")
        .select(
            stratum().alias("band"), (F.col("quality") == 1).cast("int").alias("good"),
            F.explode(F.array(*[
                F.struct(F.lit(n).alias("rule"), (F.ceil(v * STEPS) - 1).cast("int").alias("step"))
                for n, v in rule_values().items()
            ])).alias("r"),
        )
        .groupBy("band", "r.rule", "r.step").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    )
    bins: dict[tuple[int, str], dict[int, tuple[int, int]]] = {}
    for x in rows.collect():
        bins.setdefault((x.band, x.rule), {})[x.step] = (x.good, x.bad)
    assert all(r in names for _, r in bins)
    return choose(bins, risk, confidence)


def rejected(cutoffs: list[Cutoff]) -> Column:
    values, out = rule_values(), F.lit(False)
    for c in cutoffs:
        out = out | ((stratum() == c.stratum) & (values[c.rule] > c.cutoff))
    return out


def judge(
    df: DataFrame, labelled: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, counts, base_failed and kept for every document."""
    counts = stage_table(count_documents(df, key, text), "counts")
    cutoffs = fit(counts, labelled.select("doc_id", F.col("quality").cast("int").alias("quality")), risk, confidence)
    failed = base_failed()
    return counts.withColumns({"base_failed": failed, "kept": ~failed & ~rejected(cutoffs)})


def query(spark, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), labels(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
