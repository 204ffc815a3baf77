"""Incremental ingest: the same stages over newly arrived pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from actloom import schemas as S
from actloom.plans.analyze import annotation_stage
from actloom.sources.writers import write_table


def page_stream(spark: SparkSession, landing: str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Stream of page files; a batch takes all files that are there. A limit of files per trigger may cut a
    document in two, so it is for landing folders with whole documents in each file only."""
    reader = spark.readStream.schema(S.PAGES).format(fmt)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(landing)


def write_requests(target: str) -> Callable[[DataFrame, int], None]:
    """Batch writer; a repeated batch overwrites its own folder, so it is idempotent."""

    def write(batch: DataFrame, batch_id: int) -> None:
        stage = annotation_stage(batch)
        write_table(stage.requests, f"{target}/requests/batch={batch_id}")
        write_table(stage.headers, f"{target}/headers/batch={batch_id}")
        write_table(stage.quarantine, f"{target}/quarantine/batch={batch_id}")

    return write


def start(stream: DataFrame, target: str, checkpoint: str):
    """Start the ingest with the trigger that drains what is there and stops."""
    return (
        stream.writeStream.foreachBatch(write_requests(target))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
