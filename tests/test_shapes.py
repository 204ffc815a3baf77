"""Merging of answers whose shapes vary, against values worked out by hand."""

import json

from pyspark.sql import functions as F

from actloom.operators import audit as AU
from actloom.operators import refill as RE


def feature(value, quote="цитата"):
    return {"value": value, "evidence_quote": quote, "evidence_source": "zone=x", "confidence": "high"}


def answers(spark, docs):
    rows = [(d, i, json.dumps(a, ensure_ascii=False)) for d, xs in docs.items() for i, a in enumerate(xs)]
    return spark.createDataFrame(rows, "doc_id string, extractor_seq bigint, answer_text string").select(
        "*", F.lit("x").alias("extractor"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("skipped")
    )


def test_shapes(spark):
    docs = {
        "deep": [{"claim": {"a": {"b": {"c": feature("x")}}}}, {"claim": {"a": {"b": {"d": feature("y"), "c": feature("z")}}}}],
        "leaf_first": [{"claim": {"a": feature("x")}}, {"claim": {"a": {"b": feature("y")}}}, {"claim": {"a": {"k": 1}}}],
        "object_first": [{"claim": {"a": {"k": "1"}}}, {"claim": {"a": feature("x")}}, {"claim": {"a": {"m": feature("w")}}}],
        "unknown_first": [{"claim": {"a": feature("unknown")}}, {"claim": {"a": {"b": feature("y")}}}],
        "no_evidence": [{"claim": {"a": feature("x", "")}}, {"claim": {"a": ["p"]}}],
        "lists": [{"claim": ["p", {"b": 2, "a": 1}]}, {"claim": ["q", {"a": 1, "b": 2}, "P"]}, {"claim": {"a": feature("x")}}],
        "plain": [{"claim": {"a": "one"}}, {"claim": {"a": "two"}}, {"claim": {"a": ["three"]}}],
        "nothing": [{"claim": {"a": None, "b": {}}}, {"claim": {}}],
        "text": [{"claim": {"a": "{not an object"}}, {"claim": {"b": "[1"}}],
    }
    a = AU.audit_responses(answers(spark, docs))
    won = {}
    for r in a.annotation.filter(F.col("accepted") & (F.col("path") != "economic_dispute.economic_dispute_basket")).collect():
        won.setdefault(r.doc_id, {})[r.path] = r.value
    assert won == {
        "deep": {"claim.a.b.c": "x", "claim.a.b.d": "y"},
        "leaf_first": {"claim.a": "x"},
        "object_first": {"claim.a.k": "1", "claim.a.m": "w"},
        "unknown_first": {"claim.a.b": "y"},
        "no_evidence": {"claim.a": '["p"]'},
        "lists": {"claim": '["p",{"a":1,"b":2},"q"]'},
        "plain": {"claim.a": "one"},
        "text": {"claim.a": "{not an object", "claim.b": "[1"},
    }
    merged = AU.merge_features(AU.features_from_sections(AU.section_rows(AU.read_answers(answers(spark, docs)))))
    conflicts = {(r.doc_id, r.path, r.left_value, r.right_value, r.reason) for r in merged.conflicts.collect()}
    accepted, plain = "conflicting_accepted_values", "conflicting_plain_values"
    assert conflicts == {
        ("deep", "claim.a.b.c", "x", "z", accepted), ("leaf_first", "claim.a", "x", '{"k":1}', accepted),
        ("object_first", "claim.a", '{"k":"1"}', "x", accepted),
        ("plain", "claim.a", "one", "two", plain), ("plain", "claim.a", "one", '["three"]', plain),
    }
    rejected = {(r.doc_id, r.path) for r in merged.rejected.collect()}
    assert rejected == {("no_evidence", "claim.a")}


def test_features_in_lists_are_counted_and_checked(spark):
    items = [feature("x"), feature("y", ""), {"in": {"control_found": feature("maybe")}}, "text"]
    a = AU.audit_responses(answers(spark, {"d": [{"claim": {"all": items, "one": feature("z"), "flat": "plain"}}]}))
    assert a.audit.first().accepted_fields_count == 3  # x, maybe and z; not the plain value, not the list
    warnings = {(r.path, r.reason) for r in a.issues.filter("kind = 'evidence_warning'").collect()}
    assert warnings == {
        ("annotation.claim.all[1]", "filled_value_without_evidence_quote"),
        ("annotation.claim.all[2].in.control_found", "unexpected_binary_value"),
    }


def test_inner_sections_and_warnings(spark):
    inner = {"annotation": {"annotation": {"claim": {"a": feature("x")}, "odd": {}, "economic_dispute": {"b": feature("y")}}, "more": {}, "audit": {}}}
    sections = AU.section_rows(AU.read_answers(answers(spark, {"d": [inner, {"annotation": "text"}]})))
    assert {(r.path, r.reason) for r in AU.structural_warnings(sections).collect()} == {
        ("annotation.odd", "unexpected_section_from_extractor"), ("more", "unexpected_top_level_section_from_extractor"),
        ("annotation", "unexpected_top_level_section_from_extractor"),
    }
    assert {r.path for r in AU.features_from_sections(sections).collect()} == {"claim.a", "economic_dispute.b"}


def test_category_outside_the_closed_list(spark):
    df = spark.createDataFrame([("mixed",), ("new",), (None,)], "b string")
    assert [tuple(r.c) for r in df.select(AU.checked_basket(F.col("b")).alias("c")).collect()] == [
        ("mixed", None), ("unknown", "value_not_in_allowed_baskets"), ("unknown", "value_not_in_allowed_baskets")]


def test_keywords_in_one_pass(spark):
    words = ["ab", "abc", "bc", "c d", "abcde", "x+", "b"]
    texts = ["abcd", "zabcdez", "ab c d", "xx+", "", None, "bcbc", "ABC  D"]
    df = spark.createDataFrame([(i, 0, "z", t) for i, t in enumerate(texts)], "doc_id int, pos int, zone_type string, text string")
    got = {(r.doc_id, r.key) for r in RE.keyword_hits(df, words).collect()}
    assert got == {(i, w) for i, t in enumerate(texts) for w in words if w in " ".join((t or "").lower().split())}


def test_limits_name_what_they_leave_out(spark):
    sentence = "struct<sentence_id:string,zone_type:string,zone_id:string,page_start:int,page_end:int,text:string>"
    rows = [(f"s{i}", "court_reasoning", "z", 1, 1, f"word number {i} here") for i in range(12)]
    docs = spark.createDataFrame([("d", rows)], f"doc_id string, sentences array<{sentence}>")
    merged = spark.createDataFrame([], "doc_id string, card string, source_sentence_ids array<string>")
    tasks = RE.tasks_from_report(spark.createDataFrame([("d", 0, "claim.a", "r"), ("d", 1, "claim.b", "r")], "doc_id string, seq int, path string, reason string"))
    profile = "path string, seq int, cards array<string>, zones array<string>, keywords array<string>, max_windows int"
    profiles = spark.createDataFrame([("claim.a", 0, [], [], ["number"], 3), ("claim.b", 1, [], [], ["word"], None)], profile)
    a, b = RE.refill_contexts(docs, merged, tasks, profiles, budget=300).first().contexts
    assert len(a.fragments) == 3 and len(a.left_out) == 9 and len(b.fragments) == 12 and b.left_out == [] and b.skipped
    routed = RE.route_contexts(RE.refill_contexts(docs, merged, tasks, profiles, budget=300)).first()
    assert [c.path for c in routed.contexts] == ["claim.a"] and routed.left_out == ["claim.b"]
    a, b = RE.refill_contexts(docs, merged, tasks, profiles, max_chars=50).first().contexts
    assert [len(f.text) for f in a.fragments] == [2 * 18 + 1] and len(a.left_out) == 11 and len(b.fragments) == 1
