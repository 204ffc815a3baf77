"""Queries of the refill loop over the derived acts: search with all profiles, requests, second audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actloom.lexicon import audit as LA
from actloom.lexicon import requests as R
from actloom.operators import audit as AU
from actloom.operators import header as HE
from actloom.operators import refill as RE
from actloom.plans import analyze as AN
from actloom.plans import corpus as CO
from actloom.plans.queries_acts import ACT_SENTENCES
from actloom.session import cut_lineage


def _acts(spark, sf_dir) -> tuple[DataFrame, DataFrame, AU.Audit]:
    docs = cut_lineage(AN.segmented(CO.act_pages(spark, sf_dir)), "acts")
    headers = cut_lineage(HE.case_header(docs), "headers")
    return docs, headers, AU.audit_responses(CO.act_answers(spark, sf_dir), headers)


def _refill(spark, sf_dir) -> AN.Refill:
    docs, headers, first = _acts(spark, sf_dir)
    stage2 = AN.card_stage(headers, CO.act_replies(spark, sf_dir))
    return AN.refill_stage(docs, headers, stage2, first, RE.default_profiles(spark))


def keyword_context(spark, sf_dir):
    """Context fragments of every task of the acts' audit, near the anchors of the merged cards first."""
    rows = RE.context_rows(_refill(spark, sf_dir).contexts)
    return rows.select(
        "doc_id", "path", "skipped", F.col("seq").cast("bigint").alias("seq"), "matched_keyword", "search_stage",
        F.array_join("sentence_ids", ",").alias("sentence_ids"), "source", F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


def context_stats(spark, sf_dir):
    s = RE.context_stats(_refill(spark, sf_dir).contexts)
    return s.select("doc_id", *(F.col(c).cast("bigint").alias(c) for c in ("tasks_count", "contexts_used", "total_context_chars")))


def context_requests(spark, sf_dir):
    """Refill requests routed to their extractors."""
    return _refill(spark, sf_dir).requests.select(
        "doc_id", "extraction_type", F.array_join("target_paths", ",").alias("paths"),
        F.col("refill_contexts_count").cast("bigint").alias("contexts"), F.size("left_out").cast("bigint").alias("left_out"),
    )


def refill_tasks(spark, sf_dir):
    """Fields that the acts' audit asks for again."""
    first = _acts(spark, sf_dir)[2]
    return first.refill_tasks.select("doc_id", "path", "priority", "reason", "needed_context", "source_audit_block")


def _second(spark, sf_dir):
    _, headers, first = _acts(spark, sf_dir)
    return AN.second_audit(CO.act_answers(spark, sf_dir), headers, first, CO.act_refinements(spark, sf_dir))


def second_audit(spark, sf_dir):
    """Audit of all acts after the refill: refilled documents anew, the others as they were."""
    return _second(spark, sf_dir)[0].select(
        "doc_id", "overall_status", "basket", "missing_key_fields_count", "field_conflicts_count", "accepted_fields_count"
    )


def reaudit_changes(spark, sf_dir):
    """Status of refilled documents before and after."""
    return _second(spark, sf_dir)[1]


def refinement_stats(spark, sf_dir):
    """Outcomes of the refill answers of each act."""
    first = AU.audit_responses(CO.act_answers(spark, sf_dir))
    return AU.refinement_stats(AU.apply_refinements(first.annotation, CO.act_refinements(spark, sf_dir)))


#: Closed fields of the check below with their values.
CATALOG = (
    ("claim.claim_type", ("loan", "supply", "unknown")), ("creditor_profile.creditor_status", ("Affiliated",)),
    ("proof.court_doubted_reality", ("yes", "NO")), ("qualification.key_reason_category", ()),
)


def out_of_domain(spark, sf_dir):
    """Structural warnings for values that the schema's catalogue doesn't list."""
    catalog = spark.createDataFrame([(p, "categorical", list(v)) for p, v in CATALOG], "path string, kind string, allowed_values array<string>")
    audit = AU.audit_responses(CO.act_answers(spark, sf_dir), catalog=catalog)
    return audit.issues.filter("kind = 'structural_warning'").select("doc_id", "path", "reason")


QUERIES = {
    f.__name__: f
    for f in (
        keyword_context, context_stats, context_requests, refill_tasks, second_audit, reaudit_changes, refinement_stats, out_of_domain,
    )
}


# Fields in the order of the audit, as SQL rows: place, path, priority and the context that they need.
_FIELDS = ", ".join(
    f"({i}, '{p}', '{'absolute_key' if i < len(LA.ABSOLUTE_KEYS) else 'soft_key'}', "
    f"'{LA.NEEDED_CONTEXT.get(p.split('.')[0], LA.NEEDED_CONTEXT_DEFAULT)}')"
    for i, p in enumerate((*LA.ABSOLUTE_KEYS, *LA.SOFT_KEYS))
)
_OPEN = (*LA.SOFT_KEYS, "claim.claim_type", LA.BASKET)


def _profile(path: str) -> tuple:
    """Cards, zones and keywords of a field: its own, else those of its section's first field, else none."""
    section = [p for p in R.PROFILES if p[0].split(".")[0] == path.split(".")[0]]
    return next((p for p in R.PROFILES if p[0] == path), section[0] if section else (path, (), ("court_reasoning",), ()))[1:]


def _rows(part: int) -> str:
    return ", ".join(f"('{p}', {i}, '{v}')" for p in _OPEN for i, v in enumerate(_profile(p)[part]))


_TASKS = f"""
fields AS (SELECT * FROM (VALUES {_FIELDS}) AS t(i, path, priority, needed_context)),
tasks AS (
  SELECT c_custkey AS doc_id, i, path, priority, needed_context,
    CASE WHEN priority = 'soft_key' THEN 'missing_field' ELSE 'unknown_or_unaccepted_field' END AS reason
  FROM customer, fields
  WHERE priority = 'soft_key' OR (path IN ('claim.claim_type', '{LA.BASKET}') AND c_custkey % 5 > 1))"""

# Lower case and one kind of e is all that the texts need of the search normaliser.
_FOUND = f"""
{ACT_SENTENCES},
{_TASKS},
keys AS (SELECT path, i AS rank, v AS keyword, replace(lower(v), 'ё', 'е') AS key FROM (VALUES {_rows(2)}) AS t(path, i, v)),
zones AS (SELECT path, v AS zone_type FROM (VALUES {_rows(1)}) AS t(path, i, v)),
cards AS (SELECT path, v AS card FROM (VALUES {_rows(0)}) AS t(path, i, v)),
wide AS (
  SELECT s.*, replace(lower(text), 'ё', 'е') AS norm, concat_ws(chr(10), lag(text) OVER w, text, lead(text) OVER w) AS whole,
    concat_ws(',', 's' || lpad(lag(g) OVER w::VARCHAR, 5, '0'), 's' || lpad(g::VARCHAR, 5, '0'), 's' || lpad(lead(g) OVER w::VARCHAR, 5, '0')) AS ids,
    concat_ws(', ', nullif(lag(zone_type) OVER w, zone_type), zone_type, nullif(lead(zone_type) OVER w, zone_type)) AS zs,
    concat_ws(', ', nullif(lag(zone_id) OVER w, zone_id), zone_id, nullif(lead(zone_id) OVER w, zone_id)) AS zids,
    greatest(page_end, lead(page_end) OVER w) AS last_page
  FROM sents s WHERE doc_id % 5 > 1 WINDOW w AS (PARTITION BY doc_id ORDER BY g)),
contained AS (
  SELECT doc_id, g, zone_type, key FROM wide JOIN (SELECT DISTINCT key FROM keys) ON contains(norm, key)),
hits AS (
  SELECT doc_id, path, g, min((rank, keyword)) AS k FROM contained JOIN keys USING (key) JOIN zones USING (path, zone_type) GROUP BY ALL),
anchors AS (
  SELECT DISTINCT o_custkey AS doc_id, ['claimAndDealCard', 'courtAssessmentCard', 'proofAndEvidenceCard'][o_orderkey % 3 + 1] AS card, o_orderkey % 40 + 5 AS g
  FROM orders SEMI JOIN sents s ON s.doc_id = o_custkey AND s.g = o_orderkey % 40 + 5),
near AS (
  SELECT DISTINCT h.doc_id, path, h.g FROM hits h JOIN cards USING (path) JOIN anchors a ON a.doc_id = h.doc_id AND a.card = cards.card AND abs(a.g - h.g) <= 3),
staged AS (
  SELECT h.doc_id, h.path, h.g, k[2] AS keyword, CASE WHEN n.g IS NULL THEN 1 ELSE 0 END AS stage
  FROM hits h LEFT JOIN near n USING (doc_id, path, g)),
chosen AS (
  SELECT * FROM (
    SELECT s.*, whole, ids, zs, zids, last_page, row_number() OVER (PARTITION BY s.doc_id, path, lower(whole) ORDER BY stage, g) AS copy
    FROM staged s JOIN wide USING (doc_id, g)) WHERE copy = 1)"""

ORACLES = {
    "keyword_context": f"""
WITH {_FOUND}
SELECT doc_id, path, false AS skipped, row_number() OVER (PARTITION BY doc_id, path ORDER BY stage, g) - 1 AS seq, keyword AS matched_keyword,
  CASE WHEN stage = 0 THEN 'near_card_coordinates' ELSE 'global_keyword_search' END AS search_stage, ids AS sentence_ids,
  'zone=' || zs || '; zone_id=' || zids || '; sentences=' || replace(ids, ',', ', ') || '; pages=1-' || last_page AS source, md5(whole) AS text_md5
FROM chosen""",
    "context_stats": f"""
WITH {_FOUND}
SELECT doc_id, {len(_OPEN)}::BIGINT AS tasks_count, {len(_OPEN)}::BIGINT AS contexts_used, coalesce(sum(length(whole)), 0)::BIGINT AS total_context_chars
FROM (SELECT c_custkey AS doc_id FROM customer WHERE c_custkey % 5 > 1) LEFT JOIN chosen USING (doc_id) GROUP BY 1""",
    "context_requests": f"""
WITH {_FOUND}, owners AS (SELECT * FROM (VALUES {", ".join(f"('{s}', '{j.name}')" for j in R.JOBS for s in j.sections)}) AS t(section, extraction_type))
SELECT doc_id, extraction_type, string_agg(path, ',' ORDER BY i) AS paths, count(*) AS contexts, 0::BIGINT AS left_out
FROM (SELECT DISTINCT doc_id, path FROM chosen) JOIN fields USING (path) JOIN owners ON section = split_part(path, '.', 1)
GROUP BY 1, 2""",
    "refill_tasks": f"""
WITH {_TASKS}
SELECT doc_id, path, priority, reason, needed_context, 'refill_tasks' AS source_audit_block FROM tasks
UNION ALL
SELECT c_custkey, 'claim.claim_type', NULL, 'conflicting_accepted_values', NULL, 'field_conflicts' FROM customer WHERE c_custkey % 5 = 1""",
    "second_audit": """
SELECT doc_id, CASE WHEN open THEN 'needs_refill' WHEN doc_id % 5 = 1 THEN 'needs_manual_review' ELSE 'complete_with_warnings' END AS overall_status,
  CASE WHEN open THEN 'unknown' ELSE 'cession_or_purchase_of_claim' END AS basket, CASE WHEN open THEN 2 ELSE 0 END::BIGINT AS missing_key_fields_count,
  CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END::BIGINT AS field_conflicts_count, CASE WHEN open THEN 18 ELSE 20 END::BIGINT AS accepted_fields_count
FROM (SELECT c_custkey AS doc_id, c_custkey % 5 = 4 OR (c_custkey % 5 > 1 AND c_custkey % 7 = 0) AS open FROM customer)""",
    "reaudit_changes": """
SELECT c_custkey AS doc_id, 'needs_refill' AS initial_status,
  CASE WHEN c_custkey % 5 = 4 OR c_custkey % 7 = 0 THEN 'needs_refill' ELSE 'complete_with_warnings' END AS final_status
FROM customer WHERE c_custkey % 5 > 1""",
    "refinement_stats": """
SELECT c_custkey AS doc_id, 1::BIGINT AS results_count, 1::BIGINT AS target_paths_count,
  (c_custkey % 7 <> 0 AND c_custkey % 5 < 4)::BIGINT AS accepted_count, (c_custkey % 7 <> 0 AND c_custkey % 5 = 4)::BIGINT AS rejected_count,
  0::BIGINT AS skipped_count, (c_custkey % 7 = 0)::BIGINT AS error_count
FROM customer WHERE c_custkey % 5 > 1""",
    "out_of_domain": """
SELECT c_custkey AS doc_id, 'annotation.creditor_profile.creditor_status' AS path, 'value_not_in_catalogue' AS reason FROM customer
UNION ALL SELECT c_custkey, 'annotation.claim.claim_type', 'value_not_in_catalogue' FROM customer WHERE c_custkey % 5 < 2""",
}
