"""Pattern tagging of sentences: dated citations, hit tables and the blacklist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actloom.functions import text as T
from actloom.functions.arrays import let, stage
from actloom.lexicon import ru_acts as RU

Patterns = Sequence[tuple[str, str]]


def _worth(text: Column, patterns: Patterns) -> Column:
    """Whether a text can match at all; known for the built-in citations only.

    Holds for a text before ``reference_text`` too, which changes quotes, dashes and the kind of white space only.
    """
    return T.opens(RU.CITATION_WORDS)(text) if patterns is RU.CITATIONS else F.lit(True)


def tag(text: Column, patterns: Patterns = RU.CITATIONS) -> Column:
    """``array<struct<category,value>>`` of all hits, category by category."""

    def of_category(category: str, pattern: str) -> Column:
        return F.transform(
            T.hits(text, pattern),
            lambda v: F.struct(F.lit(category).alias("category"), T.reference_text(v).alias("value")),
        )

    found = F.concat(*[of_category(c, p) for c, p in patterns])
    return F.when(_worth(text, patterns), found).when(text.isNotNull(), F.array().cast("array<struct<category:string,value:string>>"))


def is_tagged(text: Column, patterns: Patterns = RU.CITATIONS) -> Column:
    """Whether any pattern matches; stops at the first one that does."""
    out = F.lit(False)
    for _category, pattern in patterns:
        out = out | T.has(text, pattern)
    return _worth(text, patterns) & out


def reference_hits(
    sentences: DataFrame,
    patterns: Patterns = RU.CITATIONS,
    zone_types: Sequence[str] | None = RU.CITED_ZONES,
) -> DataFrame:
    """One row per pattern hit in the scanned zones."""
    if zone_types is not None:
        sentences = sentences.filter(F.col("zone_type").isin(*zone_types))
    sentences = sentences.filter(_worth(F.col("text"), patterns))
    flat = stage(sentences, text=T.reference_text(F.col("text")))
    return flat.select(
        "doc_id", "sentence_id", "zone_id", "zone_type", "page_start", "page_end", "text",
        F.inline(tag(F.col("text"), patterns)),
    ).select(
        "doc_id", "sentence_id", "zone_id", "zone_type", "page_start", "page_end", "category", "value", "text"
    )


def blacklist(hits: DataFrame) -> DataFrame:
    """Sentences that carry a citation."""
    return hits.select("doc_id", "sentence_id").distinct()


def hits_by_category(hits: DataFrame) -> DataFrame:
    return hits.groupBy("category").agg(
        F.count(F.lit(1)).alias("hits"), F.countDistinct("doc_id", "sentence_id").alias("sentences")
    )


def hits_wide(hits: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Hit counts per document, one column per category."""
    return hits.groupBy("doc_id").pivot("category", list(categories)).agg(F.count(F.lit(1))).na.fill(0)


def reference_report(
    sentences: DataFrame,
    patterns: Patterns = RU.CITATIONS,
    zone_types: Sequence[str] = RU.CITED_ZONES,
) -> DataFrame:
    """Per document: scanned, skipped, hit and blacklisted sentence counts.

    Counts come from the sentence row itself, so no hit is shuffled.
    """
    scanned = F.col("zone_type").isin(*zone_types)
    worth = scanned & _worth(F.col("text"), patterns)
    found = F.when(worth, let(T.reference_text(F.col("text")), lambda t: F.size(tag(t, patterns)))).otherwise(0)
    return (
        sentences.select("doc_id", scanned.alias("scanned"), found.alias("n"))
        .groupBy("doc_id")
        .agg(
            F.count_if("scanned").alias("scanned_sentences_count"),
            F.count_if(~F.col("scanned")).alias("skipped_sentences_count"),
            F.sum("n").alias("hits_count"),
            F.count_if(F.col("n") > 0).alias("blacklisted_count"),
        )
    )


def mark_cited(
    docs: DataFrame, patterns: Patterns = RU.CITATIONS, zone_types: Sequence[str] = RU.CITED_ZONES
) -> DataFrame:
    """Flag sentences in the document row (``cited``); keeps the work map-only."""

    def flag(s: Column) -> Column:
        return s.withField(
            "cited",
            s["zone_type"].isin(*zone_types) & _worth(s["text"], patterns)
            & let(T.reference_text(s["text"]), lambda t: is_tagged(t, patterns)),
        )

    return stage(docs, sentences=F.transform("sentences", flag))


def short_reference(category: Column, value: Column) -> Column:
    """Short key of a citation: article and code, number and date, or case number.

    The code that produced this key is not public; the format follows its
    published example output.
    """
    number = T.first_hit(value, r"№\s*([\w/\-]+)", 1)
    date = T.first_hit(value, r"(\d{2}\.\d{2}\.\d{4})", 1)
    article = T.first_hit(value, r"(\d+(?:\.\d+)?)", 1)
    code = T.first_hit(value, r"(АПК\s*РФ|ГК\s*РФ|Закона\s+о\s+банкротстве|Кодекса)", 1)
    case = F.translate(F.upper(T.sub(T.first_hit(value, f"({RU.CASE_NUMBER_SHORT})", 1), r"\s+", "")), "A", "А")
    return F.coalesce(
        case,
        F.when(category.isin("code_articles", "bankruptcy_law_articles"), F.concat_ws(" ", article, code)),
        F.when(number.isNotNull() & date.isNotNull(), F.concat(F.lit("№ "), number, F.lit(" от "), date)),
        date,
        value,
    )
