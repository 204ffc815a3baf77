"""Sinks. Everything is written by the executors, one part per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actloom import schemas as S


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def json_arrays(rows: DataFrame, order: Sequence[str], wrapper: str | None = None, key: str = "doc_id") -> DataFrame:
    """``doc_id, value``: the records of a document as one JSON array, in order, or as an object that holds it.

    A document's file is one text, so its records are put together in one row."""
    fields = [c for c in rows.columns if c != key and c not in order]
    record = F.struct(*order, F.struct(*fields).alias("r"))
    listed = F.transform(F.array_sort(F.collect_list(record)), lambda x: x["r"])
    value = listed if wrapper is None else F.struct(listed.alias(wrapper))
    return rows.groupBy(key).agg(F.to_json(value, {"ignoreNullFields": "false"}).alias("value"))


def merged_card_files(merged: DataFrame) -> DataFrame:
    """``doc_id, value``: merged cards as one object ``{"cards": {card: [fragment, ...]}}`` a document."""
    fields = [f.name for f in S.parse(S.MERGED_FRAGMENT).fields]
    fragments = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct(*fields).alias("r")))), lambda x: x["r"])
    cards = merged.groupBy("doc_id", "card").agg(fragments.alias("f")).groupBy("doc_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("card", "f")))).alias("cards")
    )
    return cards.select("doc_id", F.to_json(F.struct("cards"), {"ignoreNullFields": "false"}).alias("value"))


def write_document_files(values: DataFrame, path: str, key: str = "doc_id") -> None:
    """One text file for each document, in a folder of its own that has the document's name."""
    values.select(F.col(key).cast("string").alias(key), "value").write.mode("overwrite").partitionBy(key).text(path, lineSep="\n")


def write_text(df: DataFrame, path: str, column: str = "value") -> None:
    """Text export of one column; a document's blocks are separated by newlines."""
    df.select(df[column].cast("string").alias("value")).write.mode("overwrite").text(path, lineSep="\n\n")


def write_bucketed(df: DataFrame, table: str, key: str = "doc_id", buckets: int = 512) -> None:
    """Table bucketed by document, so later joins on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
