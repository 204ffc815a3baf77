"""Registered queries over events, replies, answers and requests, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actloom.functions import answers as AN
from actloom.functions import text as T
from actloom.functions.arrays import stage
from actloom.lexicon import audit as LA
from actloom.operators import audit as AU
from actloom.operators import cards as CA
from actloom.operators import header as HE
from actloom.operators import refill as RE
from actloom.operators import requests as RQ
from actloom.operators import scan as SC
from actloom.plans import corpus as CO
from actloom.plans.analyze import segmented
from actloom.plans.corpus import table
from actloom.session import cut_lineage

# ------------------------------------------------------------------- events


def anchor_windows(spark, sf_dir):
    """Windows around error events of each user; chunks are days."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    out = SC.anchor_windows(
        e, ["user_id"], F.to_date("ts"), ["ts", "event_id"], F.col("event_type") == "error"
    )
    return out.select("user_id", "event_id", F.col("position").cast("bigint").alias("position"), "is_anchor",
                      F.col("window_no").cast("bigint").alias("window_no"))


def json_props(spark, sf_dir):
    """Tolerant answer parsing over event properties in four wrappers."""
    e = table(spark, sf_dir, "events")
    text = (
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"result":'), F.col("props"), F.lit("}")))
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit('{"result":['), F.col("props"), F.lit("]}")))
        .when(F.col("event_id") % 5 == 2, F.concat(F.lit("["), F.col("props"), F.lit("]")))
        .when(F.col("event_id") % 5 == 3, F.concat(F.col("props"), F.lit("}}")))
        .otherwise(F.col("props"))
    )
    p = stage(e.select("event_id", text.alias("t")), p=AN.parse_answer(F.col("t")))
    return p.select(
        "event_id", F.try_variant_get("p.answer", "$.k", "bigint").alias("k"), F.col("p.parse_error").alias("parse_error")
    )


def budget_skip(spark, sf_dir):
    """Budget of 100 quantity units per order; skipped lines use nothing."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.struct(CO.line_seq().alias("seq"), F.col("l_quantity").cast("int").alias("n")).alias("x")
    )
    per = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    skip = RE.spend_budget(F.transform("xs", lambda x: x["n"]), 100)
    return per.select(
        "l_orderkey", F.array_join(F.transform(skip, lambda b: F.when(b, "1").otherwise("0")), "").alias("skipped")
    )


def top_per_customer(spark, sf_dir):
    """First 8 orders per customer and status, like the contexts of an extractor."""
    o = table(spark, sf_dir, "orders")
    rows = o.select("o_custkey", "o_orderstatus", F.struct("o_orderdate", "o_orderkey").alias("x"))
    # Partial top-8 per block of orders first, so a hot customer never meets in one task.
    blocks = rows.groupBy("o_custkey", "o_orderstatus", (F.col("x.o_orderkey") % 64).alias("salt")).agg(
        F.slice(F.array_sort(F.collect_list("x")), 1, 8).alias("xs")
    )
    top = blocks.groupBy("o_custkey", "o_orderstatus").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("xs"))), 1, 8).alias("xs")
    )
    return top.select("o_custkey", "o_orderstatus", F.posexplode("xs").alias("rank", "x")).select(
        "o_custkey", "o_orderstatus", F.col("rank").cast("bigint").alias("rank"), "x.o_orderkey"
    )


# -------------------------------------------------------------------- cards


def _parsed(spark, sf_dir, *parts):
    """Replies parsed once: fragments and entities both start from the stage table; one of them alone where named."""
    parsed = CA.parse_reply(F.col("annotation_text"), F.col("window_id"), parts or ("entities", "cards"))
    replies = stage(CO.replies(spark, sf_dir), parsed=parsed)
    return cut_lineage(replies.drop("annotation_text"), "replies")


def card_fragments(spark, sf_dir):
    return CA.card_fragments(_parsed(spark, sf_dir, "cards")).groupBy("doc_id", "card", "text").agg(
        F.count(F.lit(1)).alias("fragments")
    )


def entity_roles(spark, sf_dir):
    out = CA.merge_roles(CA.entity_rows(_parsed(spark, sf_dir, "entities")))
    return out.select("doc_id", "name", F.array_join("roles", ";").alias("roles"))


def merged_cards(spark, sf_dir):
    m = CA.merge_cards(CA.card_fragments(_parsed(spark, sf_dir, "cards")))
    return m.select(
        "doc_id", "card", F.col("seq").cast("bigint").alias("seq"), "text",
        F.array_join("source_window_ids", ",").alias("windows"), F.array_join("source_dates", ",").alias("dates"),
        CA.fragment_source().alias("source"),
    )


def merge_stats(spark, sf_dir):
    p = _parsed(spark, sf_dir)
    merged = CA.merge_cards(CA.card_fragments(p))
    return CA.merge_stats(p, CA.merge_roles(CA.entity_rows(p)), merged)


def absent_cards(spark, sf_dir):
    m = CA.card_fragments(_parsed(spark, sf_dir, "cards"))
    return CA.missing_cards(m).select(
        "doc_id", F.array_join("absent_cards", ",").alias("absent"), F.array_join("extra_cards", ",").alias("extra")
    )


def merged_cards_text(spark, sf_dir):
    p = _parsed(spark, sf_dir)
    merged = CA.merge_cards(CA.card_fragments(p))
    return CA.merged_cards_text(CA.merge_roles(CA.entity_rows(p)), merged)


def _case_headers(spark, sf_dir):
    """Requisites of the orders' customers, keyed by order."""
    o = table(spark, sf_dir, "orders")
    none = F.lit(None).cast("string")
    return o.select(
        F.col("o_orderkey").alias("doc_id"), CO.case_number(F.col("o_custkey")).alias("case_number"),
        CO.act_date(F.col("o_custkey")).alias("act_date"), none.alias("court_name"),
        F.array(F.lit("Иванова А. А")).alias("judges"),
        F.concat(F.lit("Должник "), F.col("o_custkey").cast("string")).alias("debtor_name"), none.alias("dispute_context"),
    )


def extraction_requests(spark, sf_dir):
    p = _parsed(spark, sf_dir)
    out = RQ.extraction_requests(
        _case_headers(spark, sf_dir), CA.merge_roles(CA.entity_rows(p)), CA.merge_cards(CA.card_fragments(p))
    )
    return out.select(
        "doc_id", "extractor", F.col("input_fragments_count").cast("bigint").alias("fragments"), "skipped",
        F.array_join("target_sections", ",").alias("sections"),
    )


# -------------------------------------------------------------------- audit


def _features(spark, sf_dir):
    return AU.features_from_sections(AU.section_rows(AU.read_answers(CO.answers(spark, sf_dir))))


def feature_rows(spark, sf_dir):
    return _features(spark, sf_dir).groupBy("path", "value").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("evidence_quote") == "").alias("unquoted")
    )


def feature_winner(spark, sf_dir):
    won = AU.winners(AU.judged(_features(spark, sf_dir)))
    return won.filter("accepted").select("doc_id", "path", "value")


def feature_rejected(spark, sf_dir):
    out = AU.rejected_features(AU.judged(_features(spark, sf_dir)))
    return out.groupBy("doc_id", "path", "value", "reason").agg(F.count(F.lit(1)).alias("n"))


def feature_conflicts(spark, sf_dir):
    # Read by both sides of the join: parsed, judged and planned once.
    flagged = cut_lineage(AU.judged(_features(spark, sf_dir)), "flags")
    out = AU.feature_conflicts(flagged, AU.winners(flagged))
    return out.groupBy("doc_id", "path", "left_value", "right_value").agg(F.count(F.lit(1)).alias("n"))


def _audit(spark, sf_dir):
    return AU.audit_responses(CO.answers(spark, sf_dir), docs=table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")))


def derived_category(spark, sf_dir):
    return _audit(spark, sf_dir).wide.select("doc_id", "basket", "basket_confidence", F.array_join("matched_rules", "|").alias("rules"))


def rule_violations(spark, sf_dir):
    return AU.logic_issues(_audit(spark, sf_dir).wide).groupBy("reason", "severity").agg(F.count(F.lit(1)).alias("n"))


def missing_required(spark, sf_dir):
    return AU.missing_fields(_audit(spark, sf_dir).wide).groupBy("path", "reason", "priority").agg(F.count(F.lit(1)).alias("n"))


def audit_status(spark, sf_dir):
    return _audit(spark, sf_dir).audit.select(
        "doc_id", "overall_status", "field_conflicts_count", "rejected_fields_count", "critical_logic_count",
        "missing_key_fields_count", "soft_missing_fields_count", "extractor_errors_count", "accepted_fields_count",
    )


def manual_review(spark, sf_dir):
    return AU.manual_review(_audit(spark, sf_dir).issues).groupBy("path", "reason").agg(F.count(F.lit(1)).alias("n"))


def evidence_warnings(spark, sf_dir):
    rows = _features(spark, sf_dir).withColumn("accepted", F.lit(True)).withColumn("confidence", F.when(F.col("evidence_quote") == "", "нет").otherwise(F.col("confidence")))
    # Read twice, for the features and for those inside lists: parsed once.
    rows = cut_lineage(rows, "features")
    return AU.evidence_warnings(AU.all_features(rows)).groupBy("path", "reason").agg(F.count(F.lit(1)).alias("n"))


def similarity_view(spark, sf_dir):
    v = AU.similarity_view(_audit(spark, sf_dir).annotation)
    return v.groupBy("economic_dispute_basket", "claim_type", "creditor_status").agg(F.count(F.lit(1)).alias("n"))


def explanation_view(spark, sf_dir):
    headers = _case_headers(spark, sf_dir)
    v = AU.explanation_view(AU.winners(AU.judged(AU.metadata_features(headers))))
    return v.select("doc_id", "case_number", "act_date", "court_name", "judge_name")


def quality_summary(spark, sf_dir):
    a = _audit(spark, sf_dir)
    q = AU.quality_summary(a.annotation, a.audit, len(LA.ABSOLUTE_KEYS) + len(LA.SOFT_KEYS))
    return q.groupBy("schema_completeness", "consistency_status", "audit_result").agg(F.count(F.lit(1)).alias("n"))


def nested_annotation(spark, sf_dir):
    a = AU.nested_annotation(_audit(spark, sf_dir).annotation, ("claim.claim_type", "claim.emergence_timing", "proof.performance_fact_proven"))
    return a.select("doc_id", "annotation.claim.claim_type.value", F.col("annotation.proof.performance_fact_proven.value").alias("proven"))


def refinement_outcomes(spark, sf_dir):
    """Refinement answers over every order: one useful, one unknown, one derived path."""
    won = AU.winners(AU.judged(_features(spark, sf_dir)))
    # The orders may lie in one small file: parsed by all tasks, not by one.
    o = CO.spread(spark, table(spark, sf_dir, "orders"), "o_orderkey")
    answer = F.concat(
        F.lit('{"claim":{"claim_type":{"value":"'), F.when(F.col("o_orderkey") % 2 == 0, "lease").otherwise("unknown"),
        F.lit('","evidence_quote":"цитата","evidence_source":"zone=court_reasoning","confidence":"medium"}}}'),
    )
    r = o.select(
        F.col("o_orderkey").alias("doc_id"), F.lit(1).cast("bigint").alias("extractor_seq"),
        F.lit("claimEconomics").alias("extraction_type"),
        F.array(*[F.lit(p) for p in ("annotation.claim.claim_type", "annotation.claim.claim_origin", "annotation." + LA.BASKET)]).alias("target_paths"),
        F.when(F.col("o_orderkey") % 10 == 9, "[]").otherwise(answer).alias("answer_text"), F.lit(None).cast("string").alias("error"),
    )
    return AU.apply_refinements(won, r).select("doc_id", "path", "outcome", "reason")


QUERIES = {
    f.__name__: f
    for f in (
        anchor_windows, json_props, budget_skip, top_per_customer, card_fragments, entity_roles, merged_cards,
        merge_stats, absent_cards, merged_cards_text, extraction_requests, feature_rows, feature_winner,
        feature_rejected, feature_conflicts, derived_category, rule_violations, missing_required, audit_status,
        manual_review, evidence_warnings, similarity_view, explanation_view, quality_summary, nested_annotation,
        refinement_outcomes,
    )
}

_LINE = """
l AS (
  SELECT l_orderkey AS doc_id, l_linenumber::BIGINT * 1000000000000 + l_partkey * 100000 + l_suppkey AS seq,
    l_linenumber AS ln, 'w' || l_linenumber AS win, strftime(l_shipdate, '%d.%m.%Y') AS d,
    CASE WHEN l_linenumber % 2 = 0 THEN 'claimAndDealCard' ELSE 'courtAssessmentCard' END AS card,
    CASE l_returnflag || l_linestatus
      WHEN 'AF' THEN 'Договор займа подписан сторонами и исполнен банковскими переводами.'
      WHEN 'AO' THEN 'Кредитор контролировал должника через участие в уставном капитале.'
      WHEN 'NF' THEN 'Суд пришел к выводу о реальности поставки по накладным.'
      WHEN 'NO' THEN 'Первичные документы отсутствуют, передача товара ничем не подтверждена.'
      WHEN 'RF' THEN 'Кризис наступил раньше спорной сделки, имущества уже не хватало.'
      ELSE 'Требование понижено в очередности как компенсационное финансирование.' END AS phrase,
    'ООО Поставщик ' || (l_suppkey % 10) AS name, l_linestatus = 'O' AS creditor
  FROM lineitem),
f AS (
  SELECT doc_id, card, seq, 0 AS part, phrase AS text, win, d, ln FROM l
  UNION ALL SELECT doc_id, card, seq, 1, 'Дата отгрузки указана в накладной.', win, d, ln FROM l)"""
_MERGED = (
    _LINE
    + """,
u AS (
  SELECT doc_id, card, text, win, d, ln, min((seq, part)) AS o FROM f GROUP BY ALL),
g AS (SELECT doc_id, card, text, min((seq, part)) AS o FROM f GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, card ORDER BY o) AS seq FROM g),
w AS (SELECT doc_id, card, text, string_agg(v, ',' ORDER BY o) AS windows FROM (SELECT doc_id, card, text, win AS v, min(o) AS o FROM u GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
dd AS (SELECT doc_id, card, text, string_agg(v, ',' ORDER BY o) AS dates FROM (SELECT doc_id, card, text, d AS v, min(o) AS o FROM u GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
ss AS (SELECT doc_id, card, text, string_agg(v, ', ' ORDER BY o) AS sents FROM (SELECT doc_id, card, text, 's' || lpad(ln::VARCHAR, 5, '0') AS v, min(o) AS o FROM u GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
m AS (
  SELECT doc_id, card, n.seq, text, windows, dates,
    'zone=court_reasoning; window=' || replace(windows, ',', ', ') || '; zone_id=z004; sentences=' || sents || '; dates=' || replace(dates, ',', ', ') AS source
  FROM n JOIN w USING (doc_id, card, text) JOIN dd USING (doc_id, card, text) JOIN ss USING (doc_id, card, text))"""
)
_ROLES = """
r AS (
  SELECT doc_id, name, CASE WHEN bool_or(creditor) THEN 'кредитор' ELSE 'юридическое лицо' END AS roles, min(seq) AS o
  FROM l GROUP BY 1, 2)"""

_FEATURES = """
ans AS (
  SELECT l_orderkey AS doc_id, l_linenumber::BIGINT * 1000000000000 + l_partkey * 100000 + l_suppkey AS seq,
    l_quantity::INT AS q, l_partkey AS p, l_suppkey AS s,
    NOT (s % 11 <> 0 AND s % 11 <> 1 AND s % 97 = 2) AS valid
  FROM lineitem),
good AS (SELECT * FROM ans WHERE valid),
feat AS (
  SELECT doc_id, seq, 'claim.claim_type' AS path, ['loan','supply','cession','unknown'][q % 4 + 1] AS raw, p % 7 <> 0 AS quoted FROM good
  UNION ALL SELECT doc_id, seq, 'claim.claim_origin', ['real_deal','compensation_financing','unknown'][p % 3 + 1], true FROM good
  UNION ALL SELECT doc_id, seq, 'creditor_profile.creditor_status', ['independent','affiliated','controlling'][s % 3 + 1], true FROM good
  UNION ALL SELECT doc_id, seq, 'creditor_profile.control_found', ['да','нет','true','не установлено'][(p + s) % 4 + 1], true FROM good
  UNION ALL SELECT doc_id, seq, 'proof.court_recognized_debt_real', ['yes','no','unknown','yes'][p % 4 + 1], true FROM good
  UNION ALL SELECT doc_id, seq, 'qualification.legal_qualification', ['included_general','refused','remand'][s % 3 + 1], true FROM good
  UNION ALL SELECT doc_id, seq, 'qualification.key_reason_category', ['market_behavior','corporate_nature','procedural_remand'][q % 3 + 1], true FROM good),
val AS (
  SELECT *, CASE WHEN path LIKE '%control_found' THEN CASE WHEN raw IN ('да','true') THEN 'yes' ELSE 'no' END ELSE raw END AS value FROM feat),
acc AS (SELECT * FROM val WHERE value <> 'unknown' AND quoted),
win AS (SELECT doc_id, path, arg_min(value, seq) AS value FROM acc GROUP BY 1, 2),
conf AS (
  SELECT a.doc_id, a.path, w.value AS left_value, a.value AS right_value FROM acc a JOIN win w USING (doc_id, path) WHERE a.value <> w.value),
wide AS (
  SELECT o_orderkey AS doc_id,
    coalesce(max(value) FILTER (path = 'claim.claim_type'), 'unknown') AS ct,
    coalesce(max(value) FILTER (path = 'claim.claim_origin'), 'unknown') AS co,
    coalesce(max(value) FILTER (path = 'creditor_profile.creditor_status'), 'unknown') AS cs,
    coalesce(max(value) FILTER (path = 'creditor_profile.control_found'), 'unknown') AS cf,
    coalesce(max(value) FILTER (path = 'proof.court_recognized_debt_real'), 'unknown') AS dr,
    coalesce(max(value) FILTER (path = 'qualification.legal_qualification'), 'unknown') AS lq,
    coalesce(max(value) FILTER (path = 'qualification.key_reason_category'), 'unknown') AS kr
  FROM orders LEFT JOIN win ON doc_id = o_orderkey GROUP BY 1),
bask AS (
  SELECT *, CASE WHEN dr = 'no' THEN 'sham_or_fictitious_debt' WHEN ct = 'cession' THEN 'cession_or_purchase_of_claim'
      WHEN co = 'compensation_financing' THEN 'compensation_financing_loan'
      WHEN ct = 'supply' AND dr = 'yes' THEN 'ordinary_affiliated_business_deal'
      WHEN cs IN ('affiliated','controlling') AND lq = 'included_general' AND kr = 'market_behavior' THEN 'refusal_to_subordinate_despite_affiliation'
      WHEN kr = 'corporate_nature' THEN 'contractual_subordination' ELSE 'unknown' END AS basket
  FROM wide),
logic AS (
  SELECT doc_id, unnest(['creditor_status=independent conflicts with established affiliation/control',
      'creditor_status=controlling requires control_found=yes',
      'creditor_status=affiliated conflicts with control_found=yes; controlling may be required',
      'included_general conflicts with reason usually supporting subordination/refusal',
      'refused conflicts with market_behavior as key reason',
      'remand usually requires key_reason_category=procedural_remand']) AS reason,
    unnest(['critical','critical','warning','critical','warning','warning']) AS severity,
    unnest([cs = 'independent' AND cf = 'yes', cs = 'controlling' AND cf <> 'yes', cs = 'affiliated' AND cf = 'yes',
      lq = 'included_general' AND kr = 'corporate_nature', lq = 'refused' AND kr = 'market_behavior',
      lq = 'remand' AND kr NOT IN ('procedural_remand', 'unknown')]) AS broken FROM bask),
issues AS (SELECT * FROM logic WHERE broken)"""
_PER_DOC = """,
cnt AS (
  SELECT b.doc_id, b.basket, ct, cs,
    (SELECT count(*) FROM conf c WHERE c.doc_id = b.doc_id) AS field_conflicts_count,
    (SELECT count(*) FROM val v WHERE v.doc_id = b.doc_id AND value <> 'unknown' AND NOT quoted) AS rejected_fields_count,
    (SELECT count(*) FROM issues i WHERE i.doc_id = b.doc_id AND severity = 'critical') AS critical_logic_count,
    (SELECT count(*) FROM issues i WHERE i.doc_id = b.doc_id) AS logic_count,
    7 + CASE WHEN basket = 'unknown' THEN 1 ELSE 0 END + CASE WHEN ct = 'unknown' THEN 1 ELSE 0 END + CASE WHEN co = 'unknown' THEN 1 ELSE 0 END
      + CASE WHEN cs = 'unknown' THEN 1 ELSE 0 END + CASE WHEN cf = 'unknown' THEN 1 ELSE 0 END + CASE WHEN dr = 'unknown' THEN 1 ELSE 0 END
      + CASE WHEN lq = 'unknown' THEN 1 ELSE 0 END + CASE WHEN kr = 'unknown' THEN 1 ELSE 0 END - 1 AS missing_key_fields_count,
    18::BIGINT AS soft_missing_fields_count,
    (SELECT count(*) FROM ans a WHERE a.doc_id = b.doc_id AND NOT valid) AS extractor_errors_count,
    (SELECT count(*) FROM win w WHERE w.doc_id = b.doc_id) + CASE WHEN basket <> 'unknown' THEN 1 ELSE 0 END AS accepted_fields_count
  FROM bask b),
stat AS (
  SELECT *, CASE WHEN field_conflicts_count + critical_logic_count + extractor_errors_count > 0 THEN 'needs_manual_review' ELSE 'needs_refill' END AS overall_status
  FROM cnt)"""

ORACLES = {
    "anchor_windows": """
WITH e AS (SELECT user_id, event_id, event_type = 'error' AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
an AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos) <= 2 THEN 0 ELSE 1 END AS opens FROM e WHERE a),
isl AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY pos) AS g FROM an),
sp AS (SELECT user_id, g, min(pos) - 1 AS lo, max(pos) + 1 AS hi FROM isl GROUP BY 1, 2)
SELECT e.user_id, event_id, pos AS position, a AS is_anchor, g::BIGINT AS window_no
FROM e JOIN sp ON sp.user_id = e.user_id AND pos BETWEEN lo AND hi""",
    "json_props": """
SELECT event_id, CASE WHEN event_id % 5 <> 3 THEN json_extract(props, '$.k')::BIGINT END AS k,
  CASE WHEN event_id % 5 = 3 THEN 'invalid_json' END AS parse_error FROM events""",
    "budget_skip": """
WITH RECURSIVE x AS (
  SELECT l_orderkey, l_quantity::INT AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem),
b AS (
  SELECT l_orderkey, i, n AS used, '0' AS skipped FROM x WHERE i = 1
  UNION ALL
  SELECT x.l_orderkey, x.i, CASE WHEN used + n > 100 THEN used ELSE used + n END, skipped || CASE WHEN used + n > 100 THEN '1' ELSE '0' END
  FROM b JOIN x ON x.l_orderkey = b.l_orderkey AND x.i = b.i + 1)
SELECT l_orderkey, arg_max(skipped, i) AS skipped FROM b GROUP BY 1""",
    "top_per_customer": """
SELECT o_custkey, o_orderstatus, rank, o_orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) - 1 AS rank FROM orders) WHERE rank < 8""",
    "card_fragments": f"WITH {_LINE} SELECT doc_id, card, text, count(*) AS fragments FROM f GROUP BY 1, 2, 3",
    "entity_roles": f"WITH {_LINE}, {_ROLES} SELECT doc_id, name, roles FROM r",
    "merged_cards": f"WITH {_MERGED} SELECT doc_id, card, seq, text, windows, dates, source FROM m",
    "merge_stats": f"""
WITH {_LINE}
SELECT doc_id, count(*) AS input_annotations_count, count(*) AS parsed_annotations_count, 0::BIGINT AS empty_annotations_count,
  0::BIGINT AS warnings_count, count(DISTINCT name) AS entity_count, count(DISTINCT card) AS card_count,
  count(DISTINCT card || phrase) + count(DISTINCT card) AS fragment_count FROM l GROUP BY 1""",
    "absent_cards": f"""
WITH {_LINE}, c AS (SELECT doc_id, bool_or(card = 'claimAndDealCard') AS a, bool_or(card = 'courtAssessmentCard') AS b FROM l GROUP BY 1)
SELECT doc_id, 'caseSkeletonCard' || CASE WHEN a THEN '' ELSE ',claimAndDealCard' END || ',creditorStatusCard,debtorCrisisCard,proofAndEvidenceCard'
  || CASE WHEN b THEN '' ELSE ',courtAssessmentCard' END AS absent, '' AS extra FROM c""",
    "merged_cards_text": f"""
WITH {_MERGED}, {_ROLES},
e AS (SELECT doc_id, string_agg(name || ' — ' || roles, chr(10) ORDER BY o) AS e FROM r GROUP BY 1),
b AS (SELECT doc_id, card, '[send_to: ' || card || ']' || chr(10) || string_agg(text || chr(10) || '[source: ' || source || ']', chr(10) || chr(10) ORDER BY seq) AS b FROM m GROUP BY 1, 2),
t AS (SELECT doc_id, string_agg(b, chr(10) || chr(10) ORDER BY card) AS b FROM b GROUP BY 1)
SELECT doc_id, 'ENTITY_MAP:' || chr(10) || e || chr(10) || chr(10) || 'CARD_BLOCKS:' || chr(10) || chr(10) || b AS value FROM e JOIN t USING (doc_id)""",
    "extraction_requests": f"""
WITH {_LINE},
c AS (SELECT doc_id, card, count(DISTINCT phrase) + 1 AS n FROM l GROUP BY 1, 2),
j AS (SELECT o_orderkey AS doc_id, unnest(['caseProcedure','claimEconomics','creditorProfile','debtorCrisis','proofEvidence','courtQualification']) AS extractor,
  unnest(['caseSkeletonCard','claimAndDealCard','creditorStatusCard','debtorCrisisCard','proofAndEvidenceCard','courtAssessmentCard']) AS card,
  unnest(['metadata,procedure','claim,market_terms','creditor_profile,behavior','crisis','proof,proof_burden','qualification,motivation']) AS sections FROM orders)
SELECT doc_id, extractor, CASE WHEN card = 'caseSkeletonCard' THEN 1 ELSE coalesce(n, 0) END::BIGINT AS fragments,
  card <> 'caseSkeletonCard' AND n IS NULL AS skipped, sections FROM j LEFT JOIN c USING (doc_id, card)""",
    "feature_rows": f"WITH {_FEATURES} SELECT path, raw AS value, count(*) AS n, count(*) FILTER (NOT quoted) AS unquoted FROM feat GROUP BY 1, 2",
    "feature_winner": f"WITH {_FEATURES} SELECT doc_id, path, value FROM win",
    "feature_rejected": f"""
WITH {_FEATURES} SELECT doc_id, path, value, 'filled_value_without_required_evidence' AS reason, count(*) AS n
FROM val WHERE value <> 'unknown' AND NOT quoted GROUP BY 1, 2, 3""",
    "feature_conflicts": f"WITH {_FEATURES} SELECT doc_id, path, left_value, right_value, count(*) AS n FROM conf GROUP BY 1, 2, 3, 4",
    "derived_category": f"""
WITH {_FEATURES}
SELECT doc_id, basket, CASE basket WHEN 'sham_or_fictitious_debt' THEN 'high' WHEN 'cession_or_purchase_of_claim' THEN 'high'
  WHEN 'unknown' THEN 'low' ELSE 'medium' END AS basket_confidence,
  CASE basket WHEN 'sham_or_fictitious_debt' THEN 'proof.court_recognized_debt_real=no' WHEN 'cession_or_purchase_of_claim' THEN 'claim.claim_type=cession'
    WHEN 'compensation_financing_loan' THEN 'claim.claim_origin=compensation_financing'
    WHEN 'ordinary_affiliated_business_deal' THEN 'claim.claim_type=supply|proof.court_recognized_debt_real=yes'
    WHEN 'refusal_to_subordinate_despite_affiliation' THEN 'creditor_profile.creditor_status=' || cs
      || '|qualification.legal_qualification=included_general|qualification.key_reason_category=market_behavior'
    WHEN 'contractual_subordination' THEN 'qualification indicates corporate nature' ELSE '' END AS rules FROM bask""",
    "rule_violations": f"WITH {_FEATURES} SELECT reason, severity, count(*) AS n FROM issues GROUP BY 1, 2",
    "missing_required": f"""
WITH {_FEATURES},
k AS (SELECT unnest(['claim.claim_type','claim.claim_origin','creditor_profile.creditor_status','creditor_profile.control_found',
  'proof.court_recognized_debt_real','qualification.legal_qualification','qualification.key_reason_category']) AS path),
p AS (SELECT DISTINCT doc_id, path FROM feat)
SELECT 'annotation.' || k.path AS path, CASE WHEN p.path IS NULL THEN 'missing_field' ELSE 'unknown_or_unaccepted_field' END AS reason,
  'absolute_key' AS priority, count(*) AS n
FROM orders, k LEFT JOIN p ON p.doc_id = o_orderkey AND p.path = k.path LEFT JOIN win w ON w.doc_id = o_orderkey AND w.path = k.path
WHERE w.value IS NULL GROUP BY 1, 2
UNION ALL
SELECT 'annotation.economic_dispute.economic_dispute_basket', 'unknown_or_unaccepted_field', 'absolute_key', count(*) FROM bask WHERE basket = 'unknown'
UNION ALL
SELECT 'annotation.' || path, 'missing_field', 'absolute_key', (SELECT count(*) FROM orders) FROM (SELECT unnest([
  'creditor_profile.formal_affiliation_found','creditor_profile.factual_affiliation_found','crisis.crisis_status',
  'proof.performance_fact_proven','proof.court_doubted_reality','proof.court_found_sham_or_artificial']) AS path)
UNION ALL
SELECT 'annotation.' || path, 'missing_field', 'soft_key', (SELECT count(*) FROM orders) FROM (SELECT unnest([
  'claim.emergence_timing','creditor_profile.connection_basis_primary','crisis.creditor_knew_crisis','crisis.creditor_should_have_known_crisis',
  'behavior.new_financing_provided','behavior.left_funds_in_debtor','behavior.did_not_demand_repayment','behavior.changed_contract_terms',
  'behavior.extended_maturity','behavior.obtained_security','behavior.obtained_preference','behavior.participated_in_management',
  'behavior.acted_as_market_creditor','market_terms.economic_sense_present','market_terms.market_conditions_overall',
  'proof_burden.heightened_standard_applied','proof_burden.burden_to_remove_doubts_on_creditor','proof_burden.creditor_rebutted_doubts']) AS path)""",
    "manual_review": f"""
WITH {_FEATURES}
SELECT path, 'field_conflict' AS reason, count(*) AS n FROM conf GROUP BY 1
UNION ALL
SELECT 'schema_extractions.line', 'extractor_parse_or_runtime_error', count(*) FROM ans WHERE NOT valid
UNION ALL
SELECT CASE
    WHEN reason LIKE 'creditor_status=independent%' THEN 'annotation.creditor_profile.creditor_status, annotation.creditor_profile.formal_affiliation_found, annotation.creditor_profile.factual_affiliation_found, annotation.creditor_profile.control_found'
    WHEN reason LIKE 'creditor_status%' THEN 'annotation.creditor_profile.creditor_status, annotation.creditor_profile.control_found'
    ELSE 'annotation.qualification.legal_qualification, annotation.qualification.key_reason_category' END, reason, count(*)
FROM issues WHERE severity = 'critical' GROUP BY 1, 2""",
    "audit_status": f"""
WITH {_FEATURES}{_PER_DOC}
SELECT doc_id, overall_status, field_conflicts_count, rejected_fields_count, critical_logic_count,
  missing_key_fields_count::BIGINT AS missing_key_fields_count, soft_missing_fields_count, extractor_errors_count, accepted_fields_count FROM stat""",
    "quality_summary": f"""
WITH {_FEATURES}{_PER_DOC}
SELECT CASE WHEN accepted_fields_count >= 0.9 * {len(LA.ABSOLUTE_KEYS) + len(LA.SOFT_KEYS)} THEN 'complete'
    WHEN accepted_fields_count >= 0.6 * {len(LA.ABSOLUTE_KEYS) + len(LA.SOFT_KEYS)} THEN 'partial' ELSE 'insufficient' END AS schema_completeness,
  CASE WHEN critical_logic_count + field_conflicts_count > 0 THEN 'major_conflicts' WHEN logic_count > 0 THEN 'minor_conflicts'
    ELSE 'consistent' END AS consistency_status,
  CASE overall_status WHEN 'needs_manual_review' THEN 'manual_review_required' ELSE 'needs_reextraction' END AS audit_result,
  count(*) AS n
FROM stat GROUP BY 1, 2, 3""",
    "similarity_view": f"WITH {_FEATURES} SELECT basket AS economic_dispute_basket, ct AS claim_type, cs AS creditor_status, count(*) AS n FROM bask GROUP BY 1, 2, 3",
    "evidence_warnings": f"""
WITH {_FEATURES}
SELECT 'annotation.' || path AS path, reason, count(*) AS n FROM (
  SELECT path, 'filled_value_without_evidence_quote' AS reason FROM feat WHERE NOT quoted AND raw <> 'unknown'
  UNION ALL SELECT path, 'unexpected_confidence_value' FROM feat WHERE NOT quoted
  UNION ALL SELECT path, 'unexpected_binary_value' FROM feat WHERE path LIKE '%control_found')
GROUP BY 1, 2""",
    "explanation_view": """
SELECT o_orderkey AS doc_id, 'А' || (o_custkey % 90 + 10) || '-' || o_custkey || '/' || (o_custkey % 7 + 2015) AS case_number,
  (o_custkey % 28 + 1) || ' ' || ['января','февраля','марта','апреля','мая','июня','июля','августа','сентября','октября','ноября','декабря'][o_custkey % 12 + 1]
  || ' ' || (o_custkey % 7 + 2015) || ' года' AS act_date, 'unknown' AS court_name, '["Иванова А. А"]' AS judge_name FROM orders""",
    "nested_annotation": f"""
WITH {_FEATURES} SELECT doc_id, ct AS value, 'unknown' AS proven FROM bask""",
    "refinement_outcomes": f"""
WITH {_FEATURES},
t AS (SELECT o_orderkey AS doc_id, o_orderkey % 10 = 9 AS bad, o_orderkey % 2 = 0 AS useful, unnest(['claim.claim_type','claim.claim_origin','economic_dispute.economic_dispute_basket']) AS path FROM orders)
SELECT t.doc_id, t.path,
  CASE WHEN bad THEN 'error' WHEN path LIKE 'economic%' THEN 'skipped' WHEN win.value IS NOT NULL THEN 'skipped'
    WHEN path = 'claim.claim_origin' THEN 'rejected' WHEN useful THEN 'accepted' ELSE 'rejected' END AS outcome,
  CASE WHEN bad THEN 'refinement_extractor_error' WHEN path LIKE 'economic%' THEN 'path_is_not_refinable_or_derived_only'
    WHEN win.value IS NOT NULL THEN 'target_field_already_accepted_not_overwritten' WHEN path = 'claim.claim_origin' THEN 'candidate_field_not_returned'
    WHEN useful THEN NULL ELSE 'candidate_value_is_unknown' END AS reason
FROM t LEFT JOIN win USING (doc_id, path)""",
}
