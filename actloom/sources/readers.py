"""Readers with explicit schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from actloom import schemas as S
from actloom.functions.answers import strict_json
from actloom.functions.arrays import stage


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Page rows ``doc_id, page, text, tables`` from parquet, JSON lines or ORC."""
    return spark.read.schema(S.PAGES).format(fmt).load(path)


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """One document per text file; the file name gives the document id."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return raw.select(
        F.regexp_extract("file", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("doc_id"),
        F.lit(1).alias("page"),
        F.col("value").alias("text"),
        F.array().cast("array<string>").alias("tables"),
    )


def case_file_key(file_name: Column) -> Column:
    """``struct<case_number,act_yyyymmdd>`` of a ``<case>__<yyyymmdd>`` file name."""
    pattern = r"([^/]+?)__(\d{8})(?:\.[^/]*)?$"
    return F.struct(
        F.nullif(F.regexp_extract(file_name, pattern, 1), F.lit("")).alias("case_number"),
        F.nullif(F.regexp_extract(file_name, pattern, 2), F.lit("")).alias("act_yyyymmdd"),
    )


@dataclass(frozen=True)
class Records:
    """Records of JSON files, and what could not be read: ``file, pos, reason, raw``."""

    rows: DataFrame
    rejected: DataFrame


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, value``: whole files with their names from the file metadata."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def file_stem(file: Column) -> Column:
    """A file's name without folders and ending, the document id of files that hold one document."""
    return F.regexp_extract(file, r"([^/]+?)(?:\.[^./]+)?$", 1)


def json_records(files: DataFrame, schema: str, wrapper: str | None = None) -> Records:
    """Records of files (``file, value``) that each hold a JSON array, or an object with one under ``wrapper``.

    A bad file or record costs no other: rejected are files that are no JSON (``invalid_json``) or hold something
    else (``not_an_array``), elements that are no object (``not_an_object``) and objects with a value of a wrong
    type (``wrong_type``). ``rows`` has file, pos (place in the array) and the fields of the schema; a record keeps
    unnamed fields to itself. An array is one value of its file, so a file must fit a row. Empty files have no rows.
    """
    fields = S.parse(schema)
    wrapped = F.col("v") if wrapper is None else F.coalesce(F.try_variant_get("v", f"$.{wrapper}", "variant"), F.col("v"))
    listed = F.try_variant_get(wrapped, "$", "array<variant>")
    parsed = stage(files.select("file", "value"), v=strict_json(F.col("value")))
    opened = stage(parsed, items=listed)
    bad_files = opened.filter(F.col("items").isNull()).select(
        "file", F.lit(None).cast("int").alias("pos"),
        F.when(F.col("v").isNull(), "invalid_json").otherwise("not_an_array").alias("reason"), F.col("value").alias("raw"),
    )
    texts = F.transform("items", lambda x: F.to_json(x))
    items = opened.filter(F.col("items").isNotNull()).select("file", F.posexplode(texts).alias("pos", "raw"))
    corrupt = StructType([*fields.fields, StructField("_corrupt", StringType())])
    read = F.from_json("raw", corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    reason = F.when(F.json_object_keys("raw").isNull(), "not_an_object").when(F.col("r._corrupt").isNotNull(), "wrong_type")
    judged = stage(stage(items, r=read), reason=reason)
    bad_items = judged.filter(F.col("reason").isNotNull()).select("file", "pos", "reason", "raw")
    rows = judged.filter(F.col("reason").isNull()).select("file", "pos", *(F.col(f"r.{f.name}").alias(f.name) for f in fields.fields))
    return Records(rows, bad_files.unionByName(bad_items))


def _of_documents(spark: SparkSession, path: str, schema: str, wrapper: str | None = None) -> Records:
    """Records of files that hold one document each; where the schema has no doc_id, the file's name gives it."""
    found = json_records(json_files(spark, path), schema, wrapper)
    stem = file_stem(F.col("file"))
    doc = F.coalesce("doc_id", stem) if "doc_id" in found.rows.columns else stem
    return Records(found.rows.withColumn("doc_id", doc).drop("file"), found.rejected)


def read_sentences(spark: SparkSession, path: str) -> Records:
    return _of_documents(spark, path, S.SENTENCES)


def read_windows(spark: SparkSession, path: str) -> Records:
    return _of_documents(spark, path, S.WINDOWS)


def read_annotations(spark: SparkSession, path: str) -> Records:
    """Annotation files: an object with ``window_annotations`` or a bare array."""
    found = _of_documents(spark, path, S.ANNOTATION_ITEM, "window_annotations")
    return Records(found.rows.withColumnRenamed("pos", "annotation_seq"), found.rejected)


def read_merged_cards(spark: SparkSession, path: str) -> DataFrame:
    """Merged-card files ``{"cards": {card: [fragment, ...]}}`` in the shape of ``merge_cards``."""
    kind = f"struct<cards:map<string,array<struct<{_struct_fields(S.MERGED_FRAGMENT)}>>>>"
    files = json_files(spark, path).select(file_stem(F.col("file")).alias("doc_id"), F.from_json("value", kind).alias("j"))
    cards = files.select("doc_id", F.explode("j.cards").alias("card", "fragments"))
    return cards.select("doc_id", "card", F.posexplode("fragments").alias("i", "f")).select(
        "doc_id", "card", (F.col("i") + 1).alias("seq"), "f.*"
    )


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    """Refill reports: an object with ``refill_contexts`` or a bare array; one row of ordered contexts a document."""
    found = _of_documents(spark, path, S.CONTEXT_ITEM, "refill_contexts").rows
    fields = [f.name for f in S.parse(S.CONTEXT_ITEM).fields]
    gathered = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("c"))  # a file's array again
    return gathered.select("doc_id", F.transform("c", lambda c: F.struct(*(c[n].alias(n) for n in fields))).alias("contexts"))


def read_refinements(spark: SparkSession, path: str) -> Records:
    """Refinement reports: an object with ``refinement_results`` or a bare array; the order is the extractor's."""
    found = _of_documents(spark, path, S.REFINEMENT_ITEM, "refinement_results")
    return Records(found.rows.withColumn("extractor_seq", F.col("pos").cast("bigint")).drop("pos"), found.rejected)


def read_feature_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Field catalogue from a schema file ``{"sections": {section: {field: {...}}}}``.

    One row per field: ``path, kind, allowed_values``. ``values`` may be an object
    (value -> meaning) or plain text.
    """
    raw = spark.read.text(path, wholetext=True).select(
        F.from_json("value", "sections map<string,map<string,struct<type:string,values:string>>>").alias("s")
    )
    fields = raw.select(F.explode("s.sections").alias("section", "fields")).select(
        "section", F.explode("fields").alias("field", "f")
    )
    values = F.when(F.col("f.type") == "binary", F.array(*[F.lit(v) for v in ("yes", "no", "unknown")])).otherwise(
        F.coalesce(F.json_object_keys("f.values"), F.array().cast("array<string>"))
    )
    return fields.select(
        F.concat_ws(".", "section", "field").alias("path"), F.col("f.type").alias("kind"),
        values.alias("allowed_values"),
    )


def read_search_profiles(spark: SparkSession, path: str, base: DataFrame | None = None) -> DataFrame:
    """Search profiles ``{path: {cards, zones, keywords, max_windows}}``.

    Entries replace those of ``base`` with the same path.
    """
    item = "struct<cards:array<string>,zones:array<string>,keywords:array<string>,max_windows:int>"
    raw = spark.read.text(path, wholetext=True).select(
        F.posexplode(F.map_entries(F.from_json("value", f"map<string,{item}>"))).alias("seq", "e")
    )
    none = F.array().cast("array<string>")
    own = raw.select(
        F.col("e.key").alias("path"), "seq",
        F.coalesce("e.value.cards", none).alias("cards"),
        F.coalesce("e.value.zones", F.array(F.lit("court_reasoning"))).alias("zones"),
        F.coalesce("e.value.keywords", none).alias("keywords"),
        F.col("e.value.max_windows").alias("max_windows"),
    )
    if base is None:
        return own
    return own.unionByName(base.join(own.select("path"), "path", "left_anti"))


def _struct_fields(ddl: str) -> str:
    """DDL ``a INT, b STRING`` as struct fields ``a:INT,b:STRING``."""
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in S.parse(ddl).fields)
