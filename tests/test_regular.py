"""Answers of the usual shape are read in one pass; whatever they hold, the rows are those of the way by levels."""

import json
import random

from pyspark.sql import functions as F

from actloom.functions import answers as A
from actloom.functions import text as T
from actloom.operators import audit as AU


def _answers(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, answer_text string").select(
        "doc_id", F.lit(0).cast("bigint").alias("extractor_seq"), F.lit("x").alias("extractor"), "answer_text",
        F.lit(None).cast("string").alias("error"), F.lit(False).alias("skipped"),
    )


def _texts():
    rng = random.Random(5)
    word = ["loan", "Да", "unknown", "", " x ", "5", "-1.50", "1. Суд", "[a", "{", "result", "annotation", "a\nb", "~end~", "\x01", "«к»", "é", "😀", "2.10e3", "~"]
    odd = [None, 5, 1.10, True, [1, 1.50], {"b": 1, "a": 2.0}, {}, []]
    names = ["claim", "proof", "audit", "odd", "economic_dispute", "annotation", "result"]

    def feature():
        keys = A.FEATURE_KEYS if rng.random() < 0.97 else rng.sample(A.FEATURE_KEYS, 2)
        return {k: rng.choice(word) if rng.random() < 0.99 else rng.choice(odd) for k in keys} | ({"more": 1.0} if rng.random() < 0.05 else {})

    out = []
    for _ in range(1500):
        body = {n: {f: feature() for f in rng.sample(["a", "b", "control_found"], rng.randint(0, 2))}
                for n in rng.sample(names[:5] if rng.random() < 0.9 else names, rng.randint(0, 3))}
        if rng.random() < 0.05 and body:
            body[rng.choice(list(body))] = rng.choice(odd)
        text = json.dumps(body, ensure_ascii=rng.random() < 0.1)
        if rng.random() < 0.05:
            text = text.replace('"b":', '"a":')
        shapes = ("%s", "%s", ' {"annotation" : %s }', '{"result":[%s]}', '{"result":%s}', "[%s]", '{"result":{"annotation":%s}}',
                  '{"annotation":%s,"x":{}}', "[%s}", "%s}", "%s,{}", '%s,{"\\u007eend~":{}}]', '[%s,{"claim":{}}]', "\n%s")
        out.append(rng.choice(shapes) % text)
    return out


def test_one_pass_equals_the_way_by_levels(spark, monkeypatch):
    df = _answers(spark, _texts())

    def rows():
        answers = AU.read_answers(df)
        sections = AU.section_rows(answers)
        return (
            [sorted(map(str, t.collect())) for t in (AU.judged(AU.features_from_sections(sections)), AU.structural_warnings(sections), AU.extractor_errors(answers))],
            answers.filter("regular IS NOT NULL").count(),
        )

    fast, read = rows()
    monkeypatch.setattr(A, "regular", lambda found: F.lit(None).cast(f"map<string,{A.FIELDS}>"))
    slow, none = rows()
    assert fast == slow and none == 0 and 200 < read < 1200


def test_usual_answers_are_read_in_one_pass(spark):
    f = '{"value":"loan","evidence_quote":"ц","evidence_source":"zone=x","confidence":"high"}'
    body = '{"claim":{"claim_type":%s}}' % f
    texts = [body, '{"annotation":%s}' % body, '{"result": [%s]}' % body, "[%s]" % body, body + "}", '{"claim":{"a":"plain"}}']
    got = AU.read_answers(_answers(spark, texts)).orderBy("doc_id").collect()
    assert [r.regular is not None for r in got] == [True] * 4 + [False] * 2
    assert got[0].regular["claim"]["claim_type"].value == "loan" and got[4].parse_error == "invalid_json"


def test_settled_values_are_their_own_keys(spark):
    texts = ["", " ", "abc", "a  b", " a", "a ", "A", "ё", "а б-в", "«a»", "a\tb", "a—b", "\xa0", " ", "\x1c", "​", None, "z~`{"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = df.select(
        (T.audit_key(t) == T.normalize(t, fold=True)).alias("key"), (T.is_blank(t) == (T.audit_text(t) == "")).alias("blank")
    ).collect()
    assert all(r.key and r.blank for r in got)


def test_refinements_by_shape_and_in_one_pass(spark, monkeypatch):
    f = '{"value":"%s","evidence_quote":"%s","evidence_source":"zone=x","confidence":"high"}'
    texts = ['{"claim":{"claim_type":%s}}' % (f % v) for v in (("loan", "ц"), ("unknown", "ц"), ("loan", ""), ("5", "ц"))]
    texts += ['{"claim":{"claim_type":"plain"}}', '{"claim":[]}', "[]", "[1]", "", "no", '{"annotation":%s}' % texts[0], '{"claim":{"other":%s}}' % (f % ("a", "b"))]
    r = _answers(spark, texts).withColumns({
        "extraction_type": F.lit("x"),
        "target_paths": F.array(*[F.lit(p) for p in ("annotation.claim.claim_type", "proof.a", "economic_dispute.b")]),
    })
    held = spark.createDataFrame([(0, "proof.a", True)], "doc_id int, path string, accepted boolean")

    def rows():
        return sorted(map(str, AU.apply_refinements(held, r).collect()))

    fast = rows()
    monkeypatch.setattr(A, "regular", lambda found: F.lit(None).cast(f"map<string,{A.FIELDS}>"))
    assert fast == rows() and sum("outcome='accepted'" in x for x in fast) == 3


def test_refinements_merge_the_annotation_once(spark):
    """Candidates are looked at twice; the merged answers behind them stand in a stage table."""
    from actloom.plans.queries_records import refinement_outcomes

    plan = refinement_outcomes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "lineitem" not in plan


def test_evidence_warnings_parse_the_answers_once(spark):
    from actloom.plans.queries_records import evidence_warnings

    plan = evidence_warnings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan
