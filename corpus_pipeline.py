"""Training-data pipeline over `documents`: quality rules, near duplicates, benchmark passages, personal data,
tokens. Each stage is written as Parquet in the shared folder and read again by the next.

A stage works on all that its predecessor kept, and judges every row by itself: rows of one doc_id, or of none,
with different texts are different documents. Rows go through the operators under a 64-bit hash of doc_id and text
(among 10**11 documents a row shares it with another by a chance of 5e-9; such two would be judged as one). Rows
that repeat doc_id and text are judged alike and become one row at the near duplicates. Empty texts and empty
tables follow the operators' definitions; extra columns of documents are dropped at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actloom.llm import byte_bpe, decontamination, near_duplicates, personal_data, quality_rules
from actloom.llm.common import documents, labels, map_rows, stage_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Two documents are near duplicates from this similarity of their word shingles on, in percent.
SIMILARITY = 80


def keyed(docs: DataFrame) -> DataFrame:
    """docs with row, the hash of doc_id and text."""
    return docs.select(*COLUMNS, F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"))


def as_documents(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row").alias("doc_id"), "text")


def keep(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows whose hash is among kept's doc_id."""
    return rows.join(kept.select(F.col("doc_id").alias("row")).distinct(), "row", "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the risk-controlled cutoffs."""
    rows = keyed(docs)
    marks = rows.select("doc_id", "row").join(labels(spark, sf_dir).select("doc_id", "quality"), "doc_id")
    marks = marks.select(F.col("row").alias("doc_id"), "quality").distinct()
    return keep(rows, quality_rules.judge(as_documents(rows), marks).filter("kept")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of least doc_id (nulls last) and text hash. Of rows
    that repeat it, the one of least lang, source and n_chars."""
    rows = keyed(docs)
    linked = near_duplicates.link(as_documents(rows), SIMILARITY).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = rows.select("doc_id", "row").join(linked.distinct(), "row").groupBy("component_id").agg(F.min(order).alias("o"))
    kept = keep(rows, first.select(F.col("o.row").alias("doc_id")))
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    one = kept.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.min(F.struct(*rest)).alias("rest"))
    return one.select("doc_id", "text", "rest.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    rows = keyed(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.summarise(decontamination.find(as_documents(rows), items))
    return keep(rows, found.filter("NOT contaminated")).select(*COLUMNS)


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every personal span replaced by its kind; n_chars follows. Null texts stay null."""
    net = personal_data.fit(docs)

    def make():
        def work(cols: dict) -> dict:
            _, spans = personal_data.find_spans(cols["text"], net)
            texts = [None if t is None else personal_data.masked(t, s) for t, s in zip(cols["text"], spans)]
            sizes = [n if t is None else len(t) for t, n in zip(texts, cols["n_chars"])]
            return cols | {"text": texts, "n_chars": sizes}

        return work

    types = "doc_id long, text string, lang string, source string, n_chars long"
    rows = docs.select(*(F.col(c).cast(t) for c, t in (x.split(" ") for x in types.split(", "))))
    return map_rows(rows, types, make, rows_at_once=1024)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, and checksums of the ids and of the decoded bytes."""
    return byte_bpe.encode_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("personal_data", mask_personal),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Encoding and the trained stages can't be put in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
