"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A key's shard follows from the key and the number of shards alone; with one shard more, a row stays where it
is or moves into the new shard. There is no ring table and no state.

Defined cases: a null key counts as 0; a null or empty text has size 1 and checksum 0; repeated rows get the
same shard and different slots; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from actloom.llm.common import documents, narrow, stage_table

MULTIPLIER = np.uint64(2862933555777941757)
SHARDS = 16
#: Slots are counted in so many blocks of a shard; a block's rows are sorted in one task. Raise it with the table.
BLOCKS = 512


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, all keys at once; a key leaves the loop when its jump passes the end."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.int64).astype(np.uint64)
    at = np.zeros(len(state), np.int64)
    jump = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = jump[live]
        with np.errstate(over="ignore"):
            state[live] = state[live] * MULTIPLIER + np.uint64(1)
        reach = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        jump[live] = ((at[live] + 1) * reach).astype(np.int64)
        live = live[jump[live] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """Column of shard numbers for a long key; hash other keys first, as with xxhash64."""

    @pandas_udf("int")
    def place(values: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(values.to_numpy(np.int64), shards).astype(np.int32))

    return place(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def gapless(df: DataFrame, group: str, order: list[str], block: Column, blocks: int = BLOCKS) -> DataFrame:
    """Adds slot, 0, 1, 2, ... within each group, without a task per group: rows are numbered in blocks, and
    the blocks' sizes, at most groups x blocks rows, are summed up to offsets."""
    placed = df.withColumn("_block", block % blocks)
    earlier = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(group, "_block").count().select(
        group, "_block", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = F.row_number().over(Window.partitionBy(group, "_block").orderBy(*order))
    return (
        placed.withColumn("_inside", inside).join(offsets, [group, "_block"])
        .withColumn("slot", F.col("_inside").cast("long") - 1 + F.col("_offset")).drop("_block", "_inside", "_offset")
    )


def shard_documents(df: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the shard that one more shard would give."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    digest = narrow(df, key, text).select(
        "doc_id", (F.octet_length(whole).cast("long") + 1).alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32")
    )
    placed = digest.withColumns({
        "shard": shard_of(F.col("doc_id"), shards), "grown_shard": shard_of(F.col("doc_id"), shards + 1),
    })
    block = F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)) % 4294967296 + F.col("text_crc32"), F.lit(4294967296))
    return gapless(stage_table(placed, "shards"), "shard", ["doc_id", "text_crc32", "size"], block)


def query(spark, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def _jump_sql(shards: int) -> str:
    """Walks of all keys side by side; each step keeps the last shard below the count."""
    return f"""
    SELECT doc_id, max(b) AS shard FROM (
      WITH RECURSIVE walk(doc_id, k, b, j) AS (
        SELECT DISTINCT doc_id, coalesce(doc_id, 0)::HUGEINT, -1::BIGINT, 0::BIGINT FROM documents
        UNION ALL
        SELECT doc_id, k2, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k2 // 8589934592) + 1)::DOUBLE))::BIGINT
        FROM (SELECT doc_id, j, (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k2
              FROM walk WHERE j < {shards})
      ) SELECT doc_id, b FROM walk WHERE b >= 0
    ) GROUP BY doc_id"""


ORACLE = f"""
WITH tab AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x::BIGINT, [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]),
    lambda c, d: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), sized AS (
  SELECT d.doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
      lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM documents d, tab
), placed AS (
  SELECT s.*, a.shard::INTEGER AS shard, g.shard::INTEGER AS grown_shard,
    (coalesce(s.doc_id, 0) % 4294967296 + text_crc32) % 4294967296 % {BLOCKS} AS block
  FROM sized s JOIN ({_jump_sql(SHARDS)}) a ON a.doc_id IS NOT DISTINCT FROM s.doc_id
  JOIN ({_jump_sql(SHARDS + 1)}) g ON g.doc_id IS NOT DISTINCT FROM s.doc_id
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY block, doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM placed
"""
