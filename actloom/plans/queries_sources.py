"""Queries over files and replies as they come: JSON arrays with bad records, late, doubled and failed replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from actloom import schemas as S
from actloom.operators import requests as RQ
from actloom.plans import corpus as CO
from actloom.sources import readers as RD


def _records(spark, sf_dir):
    return RD.json_records(CO.order_files(spark, sf_dir), S.SENTENCES, "sentences")


def file_records(spark, sf_dir):
    """Records of the files that can be read, in their places."""
    return _records(spark, sf_dir).rows.select(
        RD.file_stem(F.col("file")).alias("doc_id"), F.col("pos").cast("bigint").alias("pos"), "sentence_id",
        F.col("global_index").cast("bigint").alias("global_index"), "text", F.array_join("dates", ",").alias("dates"),
    )


def rejected_records(spark, sf_dir):
    """Files and records that can't be read, with their places and reasons."""
    return _records(spark, sf_dir).rejected.select("file", F.col("pos").cast("bigint").alias("pos"), "reason")


def response_rows(spark, sf_dir):
    """Every request with its reply: the last attempt that answered, else an error row."""
    out = RQ.join_responses(CO.window_requests(spark, sf_dir), CO.window_replies(spark, sf_dir), ("doc_id", "window_id"), "annotation_text")
    return out.select("doc_id", "annotation_seq", "window_id", "annotation_text", "error", "attempts", "failed_attempts")


QUERIES = {f.__name__: f for f in (file_records, rejected_records, response_rows)}

_PLACES = """
f AS (
  SELECT o_custkey AS k, o_orderkey AS o, o_orderdate AS d, o_orderpriority AS text,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders)"""

ORACLES = {
    "file_records": f"""
WITH {_PLACES}
SELECT 'c' || k AS doc_id, pos, 's' || o AS sentence_id, day(d) AS global_index, text, strftime(d, '%d.%m.%Y') AS dates
FROM f WHERE k % 11 > 1 AND o % 13 > 1""",
    "rejected_records": f"""
WITH {_PLACES}
SELECT 'acts/c' || k || '.json' AS file, pos, CASE WHEN o % 13 = 0 THEN 'not_an_object' ELSE 'wrong_type' END AS reason
FROM f WHERE k % 11 > 1 AND o % 13 < 2
UNION ALL
SELECT DISTINCT 'acts/c' || k || '.json', NULL::BIGINT, CASE WHEN k % 11 = 0 THEN 'invalid_json' ELSE 'not_an_array' END FROM f WHERE k % 11 < 2""",
    "response_rows": """
WITH r AS (
  SELECT l_orderkey AS o, l_linenumber AS n, (l_orderkey + l_linenumber) % 3 AS kind FROM lineitem WHERE l_orderkey % 7 <> 0 AND l_orderkey % 10 <> 9),
a AS (
  SELECT o, max(n) FILTER (kind = 2) AS good, max(n) AS last, arg_max(kind, n) AS last_kind, count(*) AS attempts,
    count(*) FILTER (kind <> 2) AS failed_attempts FROM r GROUP BY o)
SELECT o_custkey AS doc_id, o_orderkey AS annotation_seq, 'w' || o_orderkey AS window_id, coalesce('reply ' || good, '') AS annotation_text,
  CASE WHEN a.o IS NULL THEN 'response_missing' WHEN good IS NOT NULL THEN NULL WHEN last_kind = 0 THEN 'timeout ' || last ELSE 'empty_reply' END AS error,
  coalesce(attempts, 0) AS attempts, coalesce(failed_attempts, 0) AS failed_attempts
FROM orders LEFT JOIN a ON a.o = o_orderkey""",
}
