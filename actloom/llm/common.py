"""Shared helpers: narrow inputs, stage tables in the shared folder, Arrow maps over rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task turns into Python objects at once; it bounds memory, not the result.
ROWS_AT_ONCE = 256
BYTES_AT_ONCE = 16_000_000
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
UPPER_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def narrow(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, under fixed names, so that others can't clash."""
    return df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))


def id_remainder(key: str | Column, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo the divisor (null ids count as the empty text)."""
    col = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % divisor


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where it is unset (tests), one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later steps start from files, not from lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What an operator keeps from task to task in a Python worker, by module.
_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What the operator keeps in this worker."""
    return _kept.setdefault(owner, {})


def release_others(owner: str) -> None:
    """Workers are reused: drop what other operators have left in this one."""
    for other in [name for name in _kept if name != owner]:
        del _kept[other]


def map_rows(
    df: DataFrame, schema: str, make: Callable[[], Callable[[dict], dict]], rows_at_once: int = ROWS_AT_ONCE
) -> DataFrame:
    """mapInArrow in small blocks. make() runs once per task and returns a function from columns (lists by
    name) to columns (lists or arrays by name); blocks keep a task's memory independent of partition size."""
    fields = [x.strip().split(" ")[0] for x in schema.split(",")]
    owner = make.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_others(owner)
        work = make()
        for batch in batches:
            for start, end in blocks(batch, rows_at_once):
                part = batch.slice(start, end - start)
                out = work({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                if len(out[fields[0]]):
                    yield pa.RecordBatch.from_arrays([as_arrow(out[f], t) for f, t in zip(fields, types)], names=fields)

    types = [arrow_type(x.strip().split(" ")[1]) for x in schema.split(",")]
    return df.mapInArrow(run, schema)


def blocks(batch: pa.RecordBatch, rows: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many rows, and of BYTES_AT_ONCE or one row."""
    sizes = sum(
        (np.asarray(pc.fill_null(pc.binary_length(c), 0)) for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)),
        start=np.zeros(batch.num_rows, np.int64),
    )
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        end = min(start + rows, max(start + 1, int(np.searchsorted(ends, done + BYTES_AT_ONCE, side="right"))))
        yield start, min(end, batch.num_rows)
        start = end


def arrow_type(name: str) -> pa.DataType:
    return {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(),
        "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
        "array<float>": pa.list_(pa.float32()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()),
    }[name]


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


#: DuckDB SQL of a one-row table tab(t) that crc32_sql() needs beside the rows.
CRC_TABLE = """tab AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x::BIGINT, [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]),
    lambda c, d: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
)"""


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a text's UTF-8 bytes."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'),
      lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"""
