"""Context search against a plain restatement of its rules."""

from pyspark.sql import functions as F

from actloom.functions import similarity as SI
from actloom.operators import refill as RE

TEXTS = ["Заем выдан.", "Иное.", "Долг есть.", "Пусто.", "Пусто.", "Пусто.", "Пусто.", "Пусто.", "Договор подписан.", "Конец."]
KEYWORDS = ["договор", "заем", "долг"]


def _brute(anchors, max_windows=2, radius=3):
    def keyword(t):
        return next((k for k in KEYWORDS if k in t.lower()), None)

    hits = [(i, keyword(t)) for i, t in enumerate(TEXTS) if keyword(t)]
    staged = [(i, k, "near_card_coordinates") for i, k in hits if any(abs(i - a) <= radius for a in anchors)]
    staged += [(i, k, "global_keyword_search") for i, k in hits]
    out, seen_ids, seen_texts = [], set(), set()
    for i, k, stage in staged:
        span = range(max(0, i - 1), min(len(TEXTS), i + 2))
        ids, text = tuple(f"s{j:05d}" for j in span), "\n".join(TEXTS[j] for j in span)
        if ids in seen_ids or text.lower() in seen_texts:
            continue
        seen_ids.add(ids)
        seen_texts.add(text.lower())
        out.append((k, stage, list(ids), text))
    return out[:max_windows]


def test_contexts(spark):
    sentence = "struct<sentence_id:string,zone_type:string,zone_id:string,page_start:int,page_end:int,text:string>"
    rows = [(f"s{i:05d}", "court_reasoning", "z004", 1, 1, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([("d", rows), ("e", rows)], f"doc_id string, sentences array<{sentence}>")
    merged = spark.createDataFrame([("d", "claimAndDealCard", ["s00009"])], "doc_id string, card string, source_sentence_ids array<string>")
    tasks = RE.tasks_from_report(
        spark.createDataFrame(
            [("d", 0, "annotation.claim.claim_type", "r"), ("d", 1, "claim.unlisted", "r"), ("e", 0, "claim.claim_type", "r"), ("e", 1, "other.x", "r")],
            "doc_id string, seq int, path string, reason string",
        )
    )
    profiles = spark.createDataFrame(
        [("claim.claim_type", 0, ["claimAndDealCard"], ["court_reasoning"], KEYWORDS, 2)],
        "path string, seq int, cards array<string>, zones array<string>, keywords array<string>, max_windows int",
    )
    contexts = RE.refill_contexts(docs, merged, tasks, profiles, budget=60)
    got = {r.doc_id: r.contexts for r in contexts.collect()}

    def shown(c):
        return [(f.matched_keyword, f.search_stage, list(f.sentence_ids), f.text) for f in c.fragments]

    assert shown(got["d"][0]) == _brute([9]) and shown(got["e"][0]) == _brute([])
    assert [c.skipped for c in got["d"]] == [False, True]      # the section profile repeats the same context
    assert got["e"][1].fragments == [] and not got["e"][1].skipped
    routed = RE.route_contexts(contexts).select("doc_id", "extraction_type", F.size("contexts").alias("n")).collect()
    assert sorted(map(tuple, routed)) == [("d", "claimEconomics", 1), ("e", "claimEconomics", 1)]


def test_similarity_legs(spark):
    from difflib import SequenceMatcher

    pairs = [("абвг" * 30, "абвг" * 30 + "д"), ("долг признан", "долг не признан"), ("", "x"), ("один", "два")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(
        "a", "b", SI.sequence_ratio("a", "b").alias("r"), SI.ratio_possible(F.col("a"), F.col("b")).alias("p"),
        SI.contains_most(F.col("a"), F.col("b")).alias("c"),
    ).collect()
    for r in got:
        want = SequenceMatcher(None, r.a, r.b).ratio()
        assert abs(r.r - want) < 1e-9 and (r.p or want < 0.92)
    assert [r.c for r in got] == [True, False, False, False]


def test_rows_about_acts_are_spread_before_parsing(spark):
    """A small file of customers or orders is one task; the costly parsing behind it must not be."""
    from actloom.plans import corpus as CO

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for make in (CO.act_answers, CO.act_replies, CO.act_refinements):
        assert make(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toRdd().getNumPartitions() == n


def test_tasks_keep_their_place_when_they_get_profiles(spark):
    """No shuffle by path or section: their few values would gather the tasks of all documents."""
    tasks = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("claim.claim_type").alias("path"))
    out = RE.with_profiles(tasks, RE.default_profiles(spark))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(path" not in plan and "SortMergeJoin" not in plan
    assert out.filter(F.size("profile.keywords") > 0).count() == 100
