"""Files in the shapes that users have: round trips, and what can't be read."""

import json

from pyspark.sql import functions as F

from actloom import schemas as S
from actloom.operators import cards as CA
from actloom.operators import refill as RE
from actloom.operators import requests as RQ
from actloom.plans.analyze import segmented
from actloom.sources import readers as RD
from actloom.sources import writers as WR


def _put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, value in files.items():
        (folder / f"{name}.json").write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")
    return str(folder)


def test_sentences_and_windows_round_trip(spark, tmp_path):
    rows = [("a", "s00001", 1, "Первое.", ["01.02.2020"]), ("a", "s00002", 2, 'Второе "в кавычках"\nи строка', []), ("b", "s00001", 1, "Иное.", None)]
    df = spark.createDataFrame(rows, "doc_id string, sentence_id string, global_index int, text string, dates array<string>")
    WR.write_document_files(WR.json_arrays(df, ["global_index"]), f"{tmp_path}/out")
    files = spark.read.text(f"{tmp_path}/out", wholetext=True)
    assert sorted(len(json.loads(r.value)) for r in files.collect()) == [1, 2]
    named = _put(tmp_path / "in", **{r.doc_id: r.value for r in WR.json_arrays(df.withColumn("place", F.col("global_index")), ["place"]).collect()})
    for read in (RD.read_sentences, RD.read_windows):
        found = read(spark, named)
        assert found.rejected.count() == 0 and found.rows.count() == 3
    got = sorted((r.doc_id, r.pos, r.sentence_id, r.global_index, r.text, r.dates) for r in RD.read_sentences(spark, named).rows.collect())
    assert got == [(d, g - 1, s, g, t, dates) for d, s, g, t, dates in rows]


def test_a_bad_file_or_record_costs_no_other(spark, tmp_path):
    folder = _put(
        tmp_path / "f", good=[{"sentence_id": "s1", "global_index": 1, "extra": {"x": 1}}, 5, {"global_index": "one"}, None, {}, [{}]],
        broken='[{"sentence_id": "s1"', other={"a": 1}, text='"[]"', empty=[], blank=" ", nothing="", trailing='[{"sentence_id": "s9"}] tail',
    )
    found = RD.read_sentences(spark, folder)
    assert {(r.doc_id, r.pos, r.sentence_id, r.global_index) for r in found.rows.filter("doc_id = 'good'").collect()} == {("good", 0, "s1", 1), ("good", 4, None, None)}
    bad = {(r.file.rsplit("/", 1)[1][:-5], r.pos, r.reason) for r in found.rejected.collect()}
    assert bad == {
        ("good", 1, "not_an_object"), ("good", 2, "wrong_type"), ("good", 3, "not_an_object"), ("good", 5, "not_an_object"),
        ("broken", None, "invalid_json"), ("other", None, "not_an_array"), ("text", None, "not_an_array"), ("blank", None, "invalid_json"),
        ("trailing", None, "invalid_json"),
    }


def test_annotations_cards_contexts_refinements(spark, tmp_path):
    item = {"window_id": "w1", "zone_type": "court_reasoning", "sentence_ids": ["s1"], "dates": ["01.02.2020"],
            "annotation_text": "CARD_BLOCKS:\n[send_to: claimAndDealCard]\n- Заем выдан."}
    bare = _put(tmp_path / "x", a=[item, item | {"window_id": "w2"}], b={"window_annotations": [item]})
    notes = RD.read_annotations(spark, bare).rows
    assert {(r.doc_id, r.annotation_seq, r.window_id) for r in notes.collect()} == {("a", 0, "w1"), ("a", 1, "w2"), ("b", 0, "w1")}
    merged = CA.merge_cards(CA.card_fragments(CA.parse_annotations(notes)))
    again = RD.read_merged_cards(spark, _put(tmp_path / "m", **{r.doc_id: r.value for r in WR.merged_card_files(merged).collect()}))
    shown = lambda df: sorted((r.doc_id, r.card, r.seq, r.text, r.source_window_ids) for r in df.collect())
    assert shown(again) == shown(merged) and len(shown(merged)) == 2
    context = {"path": "claim.claim_type", "reason": "r", "fragments": [{"source": "zone=x", "text": "t", "matched_keyword": "k"}], "context_chars": 1, "skipped": False}
    contexts = RD.read_contexts(spark, _put(tmp_path / "c", a={"refill_contexts": [context, context | {"path": "p2"}]}, b=[context]))
    assert {(r.doc_id, tuple(c.path for c in r.contexts)) for r in contexts.collect()} == {("a", ("claim.claim_type", "p2")), ("b", ("claim.claim_type",))}
    text = {r.doc_id: r.value for r in RE.contexts_text(contexts).collect()}["b"]
    assert text == "REFILL_TASK #1\nPATH: claim.claim_type\nREASON: r\nCONTEXT_FRAGMENTS:\n[1] source: zone=x\nmatched_keyword: k\nt"
    answers = [{"extraction_type": "claimEconomics", "target_paths": ["claim.claim_type"], "answer_text": "{}"}, {"extraction_type": "x", "error": "timeout"}]
    refined = RD.read_refinements(spark, _put(tmp_path / "r", a={"refinement_results": answers}, b=answers[:1])).rows
    assert {(r.doc_id, r.extractor_seq, r.extraction_type, r.error) for r in refined.collect()} == {
        ("a", 0, "claimEconomics", None), ("a", 1, "x", "timeout"), ("b", 0, "claimEconomics", None)}


def test_text_documents_become_acts(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "A40-1-2020__20200102.txt").write_text("Дело № А40-1/2020\nустановил:\nЗаем выдан 01.02.2020.", encoding="utf-8")
    pages = RD.read_text_documents(spark, f"{tmp_path}/t")
    docs = segmented(pages).collect()
    assert [d.doc_id for d in docs] == ["A40-1-2020__20200102"] and docs[0].main_case_number == "А40-1/2020"
    assert {f.name for f in S.parse(S.PAGES).fields} == set(pages.columns)


def test_replies_are_settled(spark):
    asked = spark.createDataFrame([("d", f"w{i}", i) for i in range(5)], "doc_id string, window_id string, annotation_seq int")
    replies = [("d", "w0", 1, "old", None), ("d", "w0", 2, "new", None), ("d", "w0", 3, None, "late error"), ("d", "w1", 1, None, "e1"), ("d", "w1", 2, None, "e2"),
               ("d", "w2", 1, "", None), ("d", "w3", 2, "same", None), ("d", "w3", 2, "same", None), ("d", "zz", 1, "nobody", None)]
    df = spark.createDataFrame(replies, "doc_id string, window_id string, attempt int, annotation_text string, error string")
    got = RQ.join_responses(asked, df, ("doc_id", "window_id"), "annotation_text").orderBy("annotation_seq").collect()
    assert [(r.window_id, r.annotation_text, r.error, r.attempts, r.failed_attempts) for r in got] == [
        ("w0", "new", None, 3, 1), ("w1", "", "e2", 2, 2), ("w2", "", "empty_reply", 1, 1), ("w3", "same", None, 2, 0), ("w4", "", "response_missing", 0, 0)]
