"""Queries over answers whose shapes vary by key: lists, nested features, shape conflicts, stray sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from actloom.operators import audit as AU
from actloom.plans import corpus as CO
from actloom.session import cut_lineage


def _sections(spark, sf_dir):
    return AU.section_rows(cut_lineage(AU.read_answers(CO.shaped_answers(spark, sf_dir)), "answers"))


def _merged(spark, sf_dir):
    return AU.merge_features(AU.features_from_sections(_sections(spark, sf_dir)))


def merged_lists(spark, sf_dir):
    """List values of the merged annotation, united over all answers of a document."""
    return _merged(spark, sf_dir).annotation.filter("accepted AND kind = 'list'").select("doc_id", "path", "value")


def nested_features(spark, sf_dir):
    """Accepted features of the merged annotation below objects, at any depth."""
    return _merged(spark, sf_dir).annotation.filter("accepted AND is_feature").select("doc_id", "path", "value")


def shape_conflicts(spark, sf_dir):
    """Contradictions between features, lists and plain values of one path."""
    out = _merged(spark, sf_dir).conflicts
    return out.groupBy("doc_id", "path", "left_value", "right_value", "reason").agg(F.count(F.lit(1)).alias("n"))


def structural_warnings(spark, sf_dir):
    return AU.structural_warnings(_sections(spark, sf_dir)).groupBy("path", "reason").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (merged_lists, nested_features, shape_conflicts, structural_warnings)}

_LINES = """
l AS (
  SELECT l_orderkey AS doc_id, l_linenumber::BIGINT * 1000000000000 + l_partkey * 100000 + l_suppkey AS seq, l_suppkey % 4 AS shape,
    l_suppkey % 7 AS extra, (l_partkey % 3)::VARCHAR AS p, (l_quantity::INTEGER % 3)::VARCHAR AS q, l_partkey % 5 = 0 AS listed
  FROM lineitem),
first AS (
  SELECT doc_id, arg_min(shape, seq) AS shape, arg_min(listed, seq) AS listed FROM l GROUP BY doc_id),
items AS (
  SELECT doc_id, 'market_terms.terms' AS path, seq, unnest([0, 1]) AS i, unnest(['"l' || p || '"', '"l' || q || '"']) AS item FROM l WHERE shape = 2
  UNION ALL SELECT doc_id, 'motivation', seq, unnest([0, 1]), unnest(['"m' || p || '"', '"m' || q || '"']) FROM l WHERE listed),
lists AS (
  SELECT doc_id, path, '[' || string_agg(item, ',' ORDER BY o) || ']' AS value
  FROM (SELECT doc_id, path, item, min((seq, i)) AS o FROM items GROUP BY ALL) GROUP BY doc_id, path),
won_lists AS (
  SELECT doc_id, path, value FROM lists JOIN first USING (doc_id)
  WHERE CASE WHEN path = 'motivation' THEN listed ELSE shape = 2 END)"""

ORACLES = {
    # One list of a path stays as it was written; only several lists are united.
    "merged_lists": f"""
WITH {_LINES}, single AS (
  SELECT doc_id, 'market_terms.terms' AS path, count(*) AS n, min('["l' || p || '","l' || q || '"]') AS raw FROM l WHERE shape = 2 GROUP BY doc_id
  UNION ALL SELECT doc_id, 'motivation', count(*), min('["m' || p || '","m' || q || '"]') FROM l WHERE listed GROUP BY doc_id)
SELECT doc_id, path, CASE WHEN n = 1 THEN raw ELSE value END AS value FROM won_lists JOIN single USING (doc_id, path)""",
    "nested_features": f"""
WITH {_LINES}
SELECT doc_id, 'market_terms.terms.rate' AS path, arg_min('r' || p, seq) AS value FROM l JOIN first f USING (doc_id) WHERE f.shape = 1 AND l.shape = 1 GROUP BY doc_id
UNION ALL SELECT doc_id, 'market_terms.terms.period.days', arg_min('d' || q, seq) FROM l JOIN first f USING (doc_id) WHERE f.shape = 1 AND l.shape = 1 GROUP BY doc_id
UNION ALL SELECT doc_id, 'market_terms.terms', arg_min('t' || p, seq) FROM l JOIN first f USING (doc_id) WHERE f.shape = 0 AND l.shape = 0 GROUP BY doc_id
UNION ALL SELECT doc_id, 'motivation.motivation_crisis', 'yes' FROM first WHERE NOT listed
UNION ALL SELECT DISTINCT doc_id, 'claim.claim_type', 'loan' FROM l WHERE extra = 5""",
    "shape_conflicts": f"""
WITH {_LINES}, leaves AS (
  SELECT doc_id, seq, shape, CASE shape WHEN 0 THEN 't' || p WHEN 2 THEN '["l' || p || '","l' || q || '"]' ELSE 'plain' || p END AS value
  FROM l WHERE shape <> 1),
winner AS (
  SELECT f.doc_id, f.shape, CASE WHEN f.shape = 2 AND count(*) FILTER (v.shape = 2) > 1 THEN any_value(x.value) ELSE arg_min(v.value, seq) END AS value
  FROM first f JOIN leaves v USING (doc_id) LEFT JOIN lists x ON x.doc_id = f.doc_id AND x.path = 'market_terms.terms'
  WHERE f.shape <> 1 GROUP BY f.doc_id, f.shape),
nested AS (
  SELECT l.doc_id, seq, unnest(['rate', 'period.days']) AS field, unnest(['r' || p, 'd' || q]) AS value
  FROM l JOIN first f USING (doc_id) WHERE f.shape = 1 AND l.shape = 1),
nested_winner AS (SELECT doc_id, field, arg_min(value, seq) AS value FROM nested GROUP BY 1, 2)
SELECT w.doc_id, 'market_terms.terms' AS path, w.value AS left_value, v.value AS right_value,
  CASE WHEN w.shape = 0 OR v.shape = 0 THEN 'conflicting_accepted_values' ELSE 'conflicting_plain_values' END AS reason, count(*) AS n
FROM winner w JOIN leaves v USING (doc_id) WHERE w.value <> v.value AND NOT (w.shape = 2 AND v.shape = 2) GROUP BY ALL
UNION ALL
SELECT w.doc_id, 'market_terms.terms.' || w.field, w.value, v.value, 'conflicting_accepted_values', count(*)
FROM nested_winner w JOIN nested v ON v.doc_id = w.doc_id AND v.field = w.field WHERE w.value <> v.value GROUP BY ALL""",
    "structural_warnings": f"""
WITH {_LINES}
SELECT 'lishnee' AS path, 'unexpected_top_level_section_from_extractor' AS reason, count(*) AS n FROM l WHERE extra = 3
UNION ALL SELECT 'annotation.economic_dispute', 'llm_economic_dispute_ignored_basket_is_derived_only', count(*) FROM l WHERE extra = 4
UNION ALL SELECT 'annotation.strange', 'unexpected_section_from_extractor', count(*) FROM l WHERE extra = 5""",
}
