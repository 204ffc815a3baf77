"""Registered queries over the derived acts, with their SQL counterparts.

The SQL never repeats the regular expressions: it states from the source columns
what the stages must find in the generated text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actloom.lexicon import ru_acts as RU
from actloom.operators import header as HE
from actloom.operators import requests as RQ
from actloom.operators import segment as SE
from actloom.operators import tagging as TA
from actloom.operators import windows as WI
from actloom.plans import corpus as CO
from actloom.plans.analyze import segmented
from actloom.session import cut_lineage

#: All categories of citations.
CITED = [name for name, _ in RU.CITATIONS]
_MONTHS = "['января','февраля','марта','апреля','мая','июня','июля','августа','сентября','октября','ноября','декабря']"

# Sentences of the reasoning zone in order: one opening sentence, then per line
# item D (dated), P (plain, quantity mod 4 times), C (cited), W (year only).
_SENTENCES = """
lines AS (
  SELECT o_custkey AS doc_id, o_orderkey AS line_no, o_orderstatus AS st, o_orderkey % 4 AS k,
         strftime(o_orderdate, '%d.%m.%Y') AS d,
         'Платеж П' || o_orderkey || ' от ' || strftime(o_orderdate, '%d.%m.%Y') || ' подтвержден.' AS dated
  FROM orders),
raw AS (
  SELECT c_custkey AS doc_id, -1 AS line_no, 1 AS i, 'S' AS kind, NULL AS d,
         'Изучив материалы дела, суд округа приходит к следующим выводам.' AS text FROM customer
  UNION ALL
  SELECT doc_id, line_no, i, s AS kind, CASE WHEN s = 'D' THEN d END,
         CASE s WHEN 'D' THEN dated WHEN 'P' THEN 'Довод проверен судами.'
           WHEN 'C' THEN 'Вопрос разрешен по правилам статьи 71 АПК РФ.' ELSE 'Срок истек в 2019 года.' END
  FROM (SELECT *, unnest(kinds) AS s, generate_subscripts(kinds, 1) AS i
        FROM (SELECT *, list_concat(['D'], list_resize(['P'], k, 'P'),
                 CASE WHEN st = 'O' THEN ['C'] ELSE [] END,
                 CASE WHEN st = 'P' THEN ['W'] ELSE [] END) AS kinds FROM lines))),
reasoning AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, i) AS zone_index,
         row_number() OVER (PARTITION BY doc_id ORDER BY line_no, i) + 4 AS global_index
  FROM raw),
lastp AS (
  SELECT c_custkey AS doc_id, coalesce(max(o_orderkey) + 2, 1) AS p
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)"""

_WINDOWS = (
    _SENTENCES
    + """,
kept AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY zone_index) - 1 AS pos,
         count(*) OVER (PARTITION BY doc_id) AS n
  FROM reasoning WHERE kind <> 'C'),
gaps AS (
  SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 2 THEN 0 ELSE 1 END AS opens
  FROM kept WHERE kind = 'D'),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM gaps),
spans AS (
  SELECT doc_id, 0 AS weak, greatest(min(pos) - 1, 0) AS lo, least(max(pos) + 1, max(n) - 1) AS hi,
         min(pos) AS first_pos, max(pos) AS last_pos
  FROM islands GROUP BY doc_id, g
  UNION ALL
  SELECT doc_id, 1, pos, pos, pos, pos FROM kept WHERE kind = 'W'),
members AS (
  SELECT s.doc_id, s.weak, s.lo, s.hi, k.pos, k.global_index, k.zone_index, k.text, k.d, k.kind,
         CASE WHEN s.weak = 1 THEN true ELSE k.kind = 'D' AND k.pos BETWEEN s.first_pos AND s.last_pos END AS anchor
  FROM spans s JOIN kept k ON k.doc_id = s.doc_id AND k.pos BETWEEN s.lo AND s.hi),
built AS (
  SELECT doc_id, weak, lo, min(global_index) AS g0, max(global_index) AS g1,
         min(zone_index) AS z0, max(zone_index) AS z1,
         count(*) AS members, count(*) FILTER (anchor) AS anchors,
         string_agg(CASE WHEN anchor THEN '* ' ELSE '- ' END || text, chr(10) ORDER BY pos) AS text
  FROM members GROUP BY doc_id, weak, lo),
dated AS (
  SELECT doc_id, weak, lo, d, min(pos) AS p FROM members WHERE anchor AND d IS NOT NULL GROUP BY ALL),
date_lists AS (
  SELECT doc_id, weak, lo, string_agg(d, ',' ORDER BY p) AS dates FROM dated GROUP BY ALL),
numbered AS (
  SELECT built.*, dates, row_number() OVER (PARTITION BY doc_id ORDER BY g0, weak) AS w
  FROM built LEFT JOIN date_lists USING (doc_id, weak, lo))"""
)


#: What citations are read from.
_CITED_FIELDS = ("sentence_id", "zone_id", "zone_type", "page_start", "page_end", "text")
#: What windows are built from.
_WINDOWED_FIELDS = (
    "sentence_id", "global_index", "zone_sentence_index", "zone_id", "zone_type", "page_start", "page_end", "text", "dates",
    "weak_dates",
)
#: What the head line and the text of a window show.
_SHOWN_FIELDS = (
    "window_id", "kind", "zone_id", "zone_type", "page_start", "page_end", "sentence_start_zone_index",
    "sentence_end_zone_index", "dates", "weak_dates", "text",
)


def act_cleaned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = SE.full_text(SE.clean_pages(SE.gather_pages(CO.act_pages(spark, sf_dir))))
    return docs.select("doc_id", "main_case_number", F.size("pages").cast("bigint").alias("pages"),
                       F.length("full_text").cast("bigint").alias("chars"))


def act_cleaning_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SE.cleaning_report(SE.clean_pages(SE.gather_pages(CO.act_pages(spark, sf_dir))))


def _zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zoned_pages(CO.act_pages(spark, sf_dir))


def _zoned_pages(pages: DataFrame) -> DataFrame:
    return SE.split_zones(SE.assemble(SE.clean_pages(SE.gather_pages(pages))))


def act_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SE.zone_rows(_zoned(spark, sf_dir)).select(
        "doc_id", "zone_id", "zone_type", F.col("page_start").cast("bigint").alias("page_start"),
        F.col("page_end").cast("bigint").alias("page_end"), "confidence", "boundary_reason",
        F.col("debug.num_sentences").cast("bigint").alias("sentences"),
    )


def act_zone_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = SE.zones_as_pages(SE.zone_rows(_zoned(spark, sf_dir)))
    return rows.select("doc_id", F.col("page").cast("bigint").alias("page"), "section_type",
                       F.size("tables").cast("bigint").alias("tables"))


def act_zone_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SE.zone_integrity(_zoned(spark, sf_dir)).select(
        "doc_id", F.col("zones_count").cast("bigint").alias("zones_count"),
        F.col("length_ratio").alias("length_ratio"), "ok",
    )


def act_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = SE.sentence_rows(SE.split_sentences(_zoned(spark, sf_dir)))
    return rows.select(
        "doc_id", "sentence_id", "zone_type", F.col("global_index").cast("bigint").alias("global_index"),
        F.col("zone_sentence_index").cast("bigint").alias("zone_sentence_index"), "text",
        F.array_join("dates", ",").alias("dates"), F.array_join("weak_dates", ",").alias("weak_dates"), "has_date",
    )


def act_sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SE.sentence_stats(SE.sentence_rows(SE.split_sentences(_zoned(spark, sf_dir)))).withColumn(
        "zone_type", F.coalesce("zone_type", F.lit("total"))
    )


def act_sentences_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = SE.sentences_by_zone(SE.sentence_rows(SE.split_sentences(_zoned(spark, sf_dir))))
    return out.withColumn("first_index", F.col("first_index").cast("bigint"))


def act_first_dated_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("sentence_id", "global_index", "text", "dates", "weak_dates")
    rows = lambda pages: SE.dated_sentences(
        SE.sentence_rows(SE.split_sentences(_zoned_pages(pages), fields=fields), fields), include_weak=True
    )
    top = SE.first_dated_sentences(SE.leading_rows(CO.act_pages(spark, sf_dir), rows, 100), 100)
    return top.select("doc_id", "sentence_id", "text")


def _sentences(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = _CITED_FIELDS) -> DataFrame:
    return SE.sentence_rows(SE.split_sentences(_zoned(spark, sf_dir), fields=fields), fields)


def act_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = TA.reference_hits(_sentences(spark, sf_dir))
    return hits.select(
        "doc_id", "sentence_id", "category", "value",
        TA.short_reference(F.col("category"), F.col("value")).alias("short_value"),
    )


def act_citation_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TA.hits_by_category(TA.reference_hits(_sentences(spark, sf_dir)))


def act_citation_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TA.hits_wide(TA.reference_hits(_sentences(spark, sf_dir)), CITED)


def act_citation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TA.reference_report(_sentences(spark, sf_dir))


def act_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TA.blacklist(TA.reference_hits(_sentences(spark, sf_dir)))


def act_kept_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The flag in the row: a join of sentences with their hits would segment every act twice.
    docs = TA.mark_cited(SE.split_sentences(_zoned(spark, sf_dir), fields=_CITED_FIELDS))
    kept = F.size(F.filter("sentences", lambda s: (s["zone_type"] == "court_reasoning") & ~s["cited"]))
    return docs.select("doc_id", kept.cast("bigint").alias("kept")).filter("kept > 0")


def _windows(spark: SparkSession, sf_dir: str, fields: tuple[str, ...], clean: bool = False) -> DataFrame:
    return segmented(
        CO.act_pages(spark, sf_dir), clean=clean, sentence_fields=_WINDOWED_FIELDS, window_fields=fields
    )


def act_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = tuple(c for c in WI.WINDOW_COLUMNS if c != "sentences")
    rows = WI.window_rows(_windows(spark, sf_dir, fields), fields=fields)
    return rows.select(
        "doc_id", "window_id", F.size("sentence_ids").cast("bigint").alias("members"),
        F.size("date_sentence_ids").cast("bigint").alias("anchors"), F.array_join("dates", ",").alias("dates"),
        F.col("sentence_start_global_index").cast("bigint").alias("g0"),
        F.col("sentence_end_global_index").cast("bigint").alias("g1"), "has_strong_date", "has_weak_date", "text",
    )


def act_clean_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _windows(spark, sf_dir, ("sentence_ids", "date_sentence_ids", "text", "sentences"), clean=True)
    rows = WI.window_rows(docs, "clean_windows", ("window_id", "sentence_ids", "text"))
    return rows.select("doc_id", "window_id", F.size("sentence_ids").cast("bigint").alias("members"), "text")


def act_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return WI.window_stats(WI.window_rows(_windows(spark, sf_dir, ("zone_type",)), fields=("zone_type",)))


def act_first_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lambda pages: WI.window_rows(
        segmented(pages, clean=False, sentence_fields=_WINDOWED_FIELDS, window_fields=("text",)), fields=("window_id", "text")
    )
    return WI.first_windows(SE.leading_rows(CO.act_pages(spark, sf_dir), rows, 120), 120)


def act_windows_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return WI.windows_text(_windows(spark, sf_dir, _SHOWN_FIELDS)).filter("value <> ''")


def act_sanitizer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _windows(spark, sf_dir, (*_SHOWN_FIELDS, "sentence_ids", "date_sentence_ids", "sentences"), clean=True)
    return WI.sanitizer_report(docs).select(
        "doc_id", F.col("windows_before").cast("bigint").alias("windows_before"),
        F.col("windows_after").cast("bigint").alias("windows_after"),
        (F.col("chars_before") - F.col("chars_after")).cast("bigint").alias("chars_removed"),
    )


def act_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return HE.case_header(_zoned(spark, sf_dir)).withColumn("judges", F.array_join("judges", ";"))


def act_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second act is stripped of its first page, so it has no header."""
    pages = CO.act_pages(spark, sf_dir).filter((F.col("page") > 1) | (F.col("doc_id") % 2 == 0))
    pages = pages.withColumn(
        "text", F.when((F.col("doc_id") % 2 == 1) & (F.col("page") == CO.LAST_PAGE), "установил: спор.").otherwise(F.col("text"))
    ).filter((F.col("doc_id") % 2 == 0) | (F.col("page") == CO.LAST_PAGE))
    docs = SE.split_zones(SE.assemble(SE.clean_pages(SE.gather_pages(pages))))
    return HE.quarantine(docs)


def act_annotation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = tuple(c for c in WI.WINDOW_COLUMNS if c != "sentences")
    docs = cut_lineage(_windows(spark, sf_dir, fields), "acts")
    out = RQ.annotation_requests(WI.window_rows(docs, fields=fields), HE.case_header(docs), "Что решил суд?")
    return out.select("doc_id", "window_id", F.col("annotation_seq").cast("bigint").alias("annotation_seq"), "input_text")


QUERIES = {
    f.__name__: f
    for f in (
        act_cleaned_text, act_cleaning_report, act_zones, act_zone_pages, act_zone_integrity, act_sentences,
        act_sentence_stats, act_sentences_by_zone, act_first_dated_sentences, act_citations,
        act_citation_categories, act_citation_pivot, act_citation_report, act_blacklist, act_kept_sentences,
        act_windows, act_clean_windows, act_window_stats, act_first_windows, act_windows_text,
        act_sanitizer_report, act_headers, act_quarantine, act_annotation_requests,
    )
}

_CASE = "'А' || (c_custkey % 90 + 10) || '-' || c_custkey || '/' || (c_custkey % 7 + 2015)"
_DATE = (
    f"(c_custkey % 28 + 1) || ' ' || {_MONTHS}[c_custkey % 12 + 1] || ' ' || (c_custkey % 7 + 2015) || ' года'"
)
_DEBTOR = "'общества с ограниченной ответственностью \"Должник ' || c_custkey || '\"'"
_DISPUTE = (
    "'по заявлению общества с ограниченной ответственностью \"Клиент ' || c_custkey || "
    "'\" о включении требования в реестр требований кредиторов'"
)
#: All sentences of the acts in order, with zones: header, two of the procedural history, the party's position,
#: the reasoning (the operative part is no sentence row).
ACT_SENTENCES = (
    _SENTENCES
    + f""",
sents AS (
  SELECT c_custkey AS doc_id, 1 AS g, 1 AS zi, 'header' AS zone_type, 'z001' AS zone_id, 1 AS page_end,
    'АРБИТРАЖНЫЙ СУД УРАЛЬСКОГО ОКРУГА ПОСТАНОВЛЕНИЕ ' || {_DATE} || ' Дело № ' || {_CASE}
    || ' Арбитражный суд в составе судей Ивановой А. А., Петрова Б. Б. рассмотрел жалобу ' || {_DISPUTE}
    || ' в рамках дела о несостоятельности (банкротстве) ' || {_DEBTOR} AS text,
    -- A case number whose middle is a month reads as a date.
    CASE WHEN c_custkey BETWEEN 1 AND 12 THEN substr({_CASE}, 2) || ',' ELSE '' END || {_DATE} AS dates, '' AS weak, true AS dated
  FROM customer
  UNION ALL SELECT c_custkey, 2, 1, 'procedural_history', 'z002', 1, 'установил:', '', '', false FROM customer
  UNION ALL SELECT c_custkey, 3, 2, 'procedural_history', 'z002', 1, 'В рамках дела о банкротстве открыто конкурсное производство.', '', '', false FROM customer
  UNION ALL SELECT c_custkey, 4, 1, 'party_position', 'z003', 1, 'В кассационной жалобе заявитель просит отменить судебные акты.', '', '', false FROM customer
  UNION ALL SELECT doc_id, global_index, zone_index, 'court_reasoning', 'z004', p, text, coalesce(d, ''),
    CASE WHEN kind = 'W' THEN '2019 года' ELSE '' END, kind IN ('D', 'W') FROM reasoning JOIN lastp USING (doc_id))"""
)
# Characters of a line page without its last line ("стр. n").
_LINE = (
    "length('Платеж П' || o_orderkey || ' от 01.01.2000 подтвержден.') + 1 + 23 * (o_orderkey % 4)"
    " + CASE WHEN o_orderstatus = 'O' THEN 46 ELSE 0 END + CASE WHEN o_orderstatus = 'P' THEN 24 ELSE 0 END"
)
_HEAD = (
    f"length('АРБИТРАЖНЫЙ СУД УРАЛЬСКОГО ОКРУГА ПОСТАНОВЛЕНИЕ ') + length({_DATE}) + length(' Дело № ')"
    f" + length({_CASE}) + length(' Арбитражный суд в составе судей Ивановой А.А., Петрова Б.Б. рассмотрел жалобу"
    " по заявлению общества с ограниченной ответственностью \"Клиент \"')"
    " + length(' о включении требования в реестр требований кредиторов в рамках дела о несостоятельности"
    " (банкротстве) общества с ограниченной ответственностью \"Должник \"') + 2 * length(c_custkey::VARCHAR)"
    " + length(' установил: В рамках дела о банкротстве открыто конкурсное производство. В кассационной жалобе"
    " заявитель просит отменить судебные акты. Изучив материалы дела, суд округа приходит к следующим выводам.')"
)
_TAIL = "length('ПОСТАНОВИЛ: Оставить судебные акты без изменения.')"
_LENGTHS = f"""
heads AS (SELECT c_custkey AS doc_id, {_CASE} AS n, {_HEAD} AS h FROM customer),
ln AS (
  SELECT o_custkey AS doc_id, count(*) AS pages, sum({_LINE} + 5 + length((o_orderkey % 100 + 1)::VARCHAR)) AS r,
    sum({_LINE} - 1) AS c
  FROM orders GROUP BY 1)"""

ORACLES = {
    "act_zones": f"""
WITH {_SENTENCES},
per AS (SELECT doc_id, count(*) AS n FROM reasoning GROUP BY 1),
z AS (
  SELECT c_custkey AS doc_id, unnest([1,2,3,4,5]) AS i FROM customer)
SELECT z.doc_id, 'z00' || i AS zone_id,
  ['header','procedural_history','party_position','court_reasoning','operative_part'][i] AS zone_type,
  CASE WHEN i = 5 THEN 1000000000 ELSE 1 END::BIGINT AS page_start,
  CASE WHEN i = 5 THEN 1000000000 WHEN i = 4 THEN coalesce(p, 1) ELSE 1 END::BIGINT AS page_end,
  'high' AS confidence,
  ['text_before_ustanovil_marker','body_starts_from_ustanovil_marker','found_party_position_marker',
   'found_strong_court_reasoning_marker_after_party_position','text_from_postanovil_marker'][i] AS boundary_reason,
  CASE i WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN n END::BIGINT AS sentences
FROM z JOIN per USING (doc_id) LEFT JOIN lastp USING (doc_id)""",
    "act_zone_pages": """
SELECT c_custkey AS doc_id, CASE WHEN i = 5 THEN 1000000000 ELSE 1 END::BIGINT AS page,
  ['header','procedural_history','party_position','court_reasoning','operative_part'][i] AS section_type,
  0::BIGINT AS tables
FROM (SELECT c_custkey, unnest([1,2,3,4,5]) AS i FROM customer)""",
    "act_zone_integrity": """
SELECT c_custkey AS doc_id, 5::BIGINT AS zones_count, 1.0::DOUBLE AS length_ratio, true AS ok FROM customer""",
    "act_sentences": f"""
WITH {ACT_SENTENCES}
SELECT doc_id, 's' || lpad(g::VARCHAR, 5, '0') AS sentence_id, zone_type, g AS global_index, zi AS zone_sentence_index, text, dates,
  weak AS weak_dates, dated AS has_date
FROM sents""",
    "act_sentence_stats": f"""
WITH {_SENTENCES},
allz AS (
  SELECT 'court_reasoning' AS zone_type, kind FROM reasoning
  UNION ALL SELECT unnest(['header','procedural_history','procedural_history','party_position']),
    unnest(['D','P','P','P']) FROM customer)
SELECT coalesce(zone_type, 'total') AS zone_type, count(*) AS sentences,
  count(*) FILTER (kind = 'D') AS with_dates, count(*) FILTER (kind = 'W') AS with_weak_dates,
  count(*) FILTER (kind IN ('D','W')) AS with_any_date
FROM allz GROUP BY ROLLUP (zone_type)""",
    "act_sentences_by_zone": f"""
WITH {_SENTENCES}
SELECT doc_id, 'z004' AS zone_id, 'court_reasoning' AS zone_type, count(*) AS sentences, 5::BIGINT AS first_index
FROM reasoning GROUP BY 1
UNION ALL
SELECT c_custkey, ['z001','z002','z003'][i], ['header','procedural_history','party_position'][i],
  [1,2,1][i], [1,2,4][i]
FROM (SELECT c_custkey, unnest([1,2,3]) AS i FROM customer)""",
    "act_first_dated_sentences": f"""
WITH {ACT_SENTENCES}
SELECT doc_id, 's' || lpad(g::VARCHAR, 5, '0') AS sentence_id, text FROM sents WHERE dated ORDER BY doc_id, g LIMIT 100""",
    "act_citations": f"""
WITH {_SENTENCES}
SELECT doc_id, 's' || lpad(global_index::VARCHAR, 5, '0') AS sentence_id, 'code_articles' AS category,
  'статьи 71 АПК РФ' AS value, '71 АПК РФ' AS short_value
FROM reasoning WHERE kind = 'C'""",
    "act_citation_categories": f"""
WITH {_SENTENCES}
SELECT 'code_articles' AS category, count(*) AS hits, count(*) AS sentences FROM reasoning WHERE kind = 'C'""",
    "act_citation_pivot": f"""
WITH {_SENTENCES}
SELECT doc_id, {", ".join(f"{'count(*)' if c == 'code_articles' else '0::BIGINT'} AS {c}" for c in CITED)}
FROM reasoning WHERE kind = 'C' GROUP BY 1""",
    "act_citation_report": f"""
WITH {_SENTENCES}
SELECT doc_id, count(*) + 3 AS scanned_sentences_count, 1::BIGINT AS skipped_sentences_count,
  count(*) FILTER (kind = 'C') AS hits_count, count(*) FILTER (kind = 'C') AS blacklisted_count
FROM reasoning GROUP BY 1""",
    "act_blacklist": f"""
WITH {_SENTENCES}
SELECT doc_id, 's' || lpad(global_index::VARCHAR, 5, '0') AS sentence_id FROM reasoning WHERE kind = 'C'""",
    "act_kept_sentences": f"""
WITH {_SENTENCES}
SELECT doc_id, count(*) AS kept FROM reasoning WHERE kind <> 'C' GROUP BY 1""",
    "act_windows": f"""
WITH {_WINDOWS}
SELECT doc_id, 'w' || lpad(w::VARCHAR, 5, '0') AS window_id, members, anchors, coalesce(dates, '') AS dates, g0, g1,
  weak = 0 AS has_strong_date, weak = 1 AS has_weak_date, text
FROM numbered""",
    "act_clean_windows": f"""
WITH {_WINDOWS}
SELECT doc_id, 'sw' || lpad(w::VARCHAR, 5, '0') AS window_id, members, text FROM numbered""",
    "act_window_stats": f"""
WITH {_WINDOWS}
SELECT 'court_reasoning' AS zone_type, count(*) AS windows FROM numbered""",
    "act_first_windows": f"""
WITH {_WINDOWS}
SELECT doc_id, 'w' || lpad(w::VARCHAR, 5, '0') AS window_id, text FROM numbered ORDER BY 1, 2 LIMIT 120""",
    "act_windows_text": f"""
WITH {_WINDOWS}
SELECT doc_id, string_agg('[w' || lpad(w::VARCHAR, 5, '0') || '] kind=date_window zone=court_reasoning:z004 pages=1-'
    || p || ' sentences=' || z0 || '-' || z1 || ' dates=['
    || coalesce(CASE WHEN weak = 0 THEN '''' || replace(dates, ',', ''', ''') || '''' END, '')
    || '] weak_dates=[' || CASE WHEN weak = 1 THEN '''2019 года''' ELSE '' END || ']' || chr(10) || text,
    chr(10) || chr(10) ORDER BY w) AS value
FROM numbered JOIN lastp USING (doc_id) GROUP BY doc_id""",
    "act_sanitizer_report": f"""
WITH {_WINDOWS}
SELECT c_custkey AS doc_id, count(w) AS windows_before, count(w) AS windows_after, -count(w) AS chars_removed
FROM customer LEFT JOIN numbered ON doc_id = c_custkey GROUP BY 1""",
    "act_headers": f"""
SELECT c_custkey AS doc_id, {_CASE} AS case_number, {_DATE} AS act_date,
  'АРБИТРАЖНЫЙ СУД УРАЛЬСКОГО ОКРУГА' AS court_name, 'Ивановой А. А;Петрова Б. Б' AS judges,
  {_DEBTOR} AS debtor_name, {_DISPUTE} AS dispute_context
FROM customer""",
    "act_quarantine": """
SELECT c_custkey AS doc_id, 'header_zone_missing' AS reason FROM customer WHERE c_custkey % 2 = 1""",
    "act_cleaning_report": f"""
WITH {_LENGTHS},
t AS (
  SELECT doc_id, (h + 3 + length(n) + {_TAIL} + coalesce(r, 0))::BIGINT AS raw_length,
    (h + 2 + {_TAIL} + coalesce(c, 0))::BIGINT AS cleaned_length
  FROM heads LEFT JOIN ln USING (doc_id))
SELECT *, round(cleaned_length / raw_length, 6) AS ratio,
  round((1 - cleaned_length / raw_length) * 100, 2) AS reduction_pct
FROM t""",
    "act_cleaned_text": f"""
WITH {_LENGTHS}
SELECT doc_id, n AS main_case_number, (2 + coalesce(pages, 0))::BIGINT AS pages,
  (h + 2 + {_TAIL} + coalesce(c, 0) + 2 * (1 + coalesce(pages, 0)))::BIGINT AS chars
FROM heads LEFT JOIN ln USING (doc_id)""",
    "act_annotation_requests": f"""
WITH {_WINDOWS}
SELECT doc_id, 'w' || lpad(w::VARCHAR, 5, '0') AS window_id, w AS annotation_seq,
  'CASE_CONTEXT:' || chr(10) || 'Номер дела: ' || {_CASE} || chr(10) || 'Дата акта: ' || {_DATE} || chr(10)
  || 'Суд: АРБИТРАЖНЫЙ СУД УРАЛЬСКОГО ОКРУГА' || chr(10) || 'Судьи: [''Ивановой А. А'', ''Петрова Б. Б'']' || chr(10)
  || 'Должник: ' || {_DEBTOR} || chr(10) || 'Обособленный спор: ' || {_DISPUTE} || chr(10) || chr(10)
  || 'WINDOW_ID: w' || lpad(w::VARCHAR, 5, '0') || chr(10) || 'ZONE_ID: z004' || chr(10)
  || 'ZONE_TYPE: court_reasoning' || chr(10) || 'PAGES: 1-' || p || chr(10) || 'DATES: ['
  || coalesce(CASE WHEN weak = 0 THEN '''' || replace(dates, ',', ''', ''') || '''' END, '') || ']' || chr(10) || chr(10)
  || 'USER_QUESTION:' || chr(10) || 'Что решил суд?' || chr(10) || chr(10) || 'WINDOW:' || chr(10) || text AS input_text
FROM numbered JOIN customer ON c_custkey = doc_id JOIN lastp USING (doc_id)""",
}
