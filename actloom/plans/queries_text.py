"""Registered queries over the plain text and key tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actloom.functions import cleaning as C
from actloom.functions import dates as D
from actloom.functions import similarity as SI
from actloom.functions import text as T
from actloom.functions.arrays import let
from actloom.functions.sentences import sentence_edge, sentence_spans, sentence_texts, sentences_before_capitals
from actloom.lexicon import cards as LC
from actloom.lexicon import generic as G
from actloom.lexicon import ru_acts as RU
from actloom.operators import cards as CA
from actloom.operators import header as HE
from actloom.operators import scan as SC
from actloom.operators import segment as SE
from actloom.operators import tagging as TA
from actloom.plans.corpus import table
from actloom.sources.readers import case_file_key

_EDGE = sentence_edge(abbreviations=(), extra=("№",))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def clean_basic_chars(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", C.basic_chars(F.col("text")).alias("text"))


def normalized_variants(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select(
        "doc_id", T.one_line(t).alias("one_line"), T.audit_text(t).alias("audit_text"),
        T.window_text(t).alias("window_text"), T.card_text(t).alias("card_text"),
    )


def match_keys(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select(
        "doc_id", T.match_text(t).alias("match_text"), T.dedup_key(t).alias("dedup_key")
    )


def clean_links(spark, sf_dir):
    """Links and addresses of every web page, removed from "url mail" texts."""
    pages = table(spark, sf_dir, "pages")
    text = F.concat(F.lit("см. "), F.col("url"), F.lit(" или mail"), F.col("page_id").cast("string"),
                    F.lit("@example.org конец"))
    return pages.select("page_id", C.contacts(text).alias("text"))


def clean_requisites(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    text = F.concat(
        F.lit("Покупатель "), F.col("c_name"), F.lit(" (ИНН "), (F.col("c_custkey") + 7700000000).cast("string"),
        F.lit("), ОГРН № "), (F.col("c_custkey") + 1027700000000).cast("string"), F.lit(" тел. +7 812 "),
        (F.col("c_custkey") % 900 + 1001000).cast("string"), F.lit(", далее"),
    )
    return c.select("c_custkey", C.identifiers(C.contacts(text)).alias("text"))


def running_headers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n = F.concat(F.lit("А10-"), F.col("o_orderkey").cast("string"), F.lit("/2020"))
    text = F.concat(
        F.lit("Дело №\n"), n, F.lit("\nтекст "), F.col("o_custkey").cast("string"), F.lit("\n"), n,
        F.lit("\n\n7 "), n, F.lit("\nпо делу №\n\n"), n, F.lit("\n"), n, F.lit("\nконец"),
    )
    return o.select("o_orderkey", C.running_header_lines(text, n).alias("text"),
                    C.main_case_number(F.concat(F.lit("ДЕЛО № a10 - "), F.col("o_orderkey").cast("string"), F.lit(" / 2020"))).alias("number"))


def table_like_lines(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(C.is_table_like(F.col("line"))).alias("table_like")
    )


def paragraph_islands(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", C.restore_paragraphs(F.col("text")).alias("text"))


def table_blocks(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    rows = F.array(
        F.array(F.lit("имя"), F.lit("  "), F.col("c_name")),
        F.array(F.lit(None).cast("string"), F.lit("")),
        F.array(F.lit("сегмент "), F.col("c_mktsegment"), F.lit(None).cast("string")),
    )
    return c.select("c_custkey", C.format_table(rows).alias("text"), C.table_rows_block(rows).alias("block"))


def sentences(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "doc_id", F.posexplode(sentence_texts(F.col("text"), _EDGE)).alias("idx", "sentence")
    ).withColumn("idx", F.col("idx").cast("bigint"))


def sentence_offsets(spark, sf_dir):
    spans = _docs(spark, sf_dir).select(
        "doc_id", F.posexplode(sentence_spans(F.col("text"), _EDGE)).alias("idx", "s")
    )
    return spans.select(
        "doc_id", F.col("idx").cast("bigint").alias("idx"),
        F.col("s.start_offset").cast("bigint").alias("start_offset"),
        F.col("s.end_offset").cast("bigint").alias("end_offset"),
    )


def sentence_stats_rollup(spark, sf_dir):
    n = F.size(sentence_texts(F.col("text"), _EDGE)).cast("bigint")
    return _docs(spark, sf_dir).rollup("lang").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(n).alias("sentences")
    ).withColumn("lang", F.coalesce("lang", F.lit("total")))


def capital_sentences(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.concat(
        F.lit("Долг по ст. 5 на 100 руб. Взыскан "), F.date_format("o_orderdate", "dd.MM.yyyy"),
        F.lit(" судьей И. И. Ивановым. Заказ "), F.col("o_orderkey").cast("string"), F.lit(" закрыт! а вот нет. Все."),
    )
    return o.select("o_orderkey", F.array_join(sentences_before_capitals(text), "|").alias("parts"))


def strong_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    months = F.array(*[F.lit(m) for m in RU.DATES.months])
    text = F.concat(
        F.lit("Договор от "), F.dayofmonth("o_orderdate"), F.lit(" "), F.get(months, F.month("o_orderdate") - 1),
        F.lit(" "), F.year("o_orderdate"), F.lit(" г., оплата "), F.date_format("o_orderdate", "dd.MM.yyyy"),
        F.lit(" и "), F.date_format("o_orderdate", "d/M/yy"), F.lit(", итог "), F.year("o_orderdate"), F.lit(" года"),
    )
    return o.select(
        "o_orderkey", F.array_join(D.strong_dates(text, RU.DATES), "|").alias("dates"),
        F.size(D.weak_dates(text, RU.DATES)).cast("bigint").alias("weak"),
    )


def weak_years(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "doc_id", F.array_join(T.hits(F.col("text"), G.DATES.year_only), ",").alias("years")
    )


def date_sort_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    months = F.array(*[F.lit(m) for m in RU.DATES.months])
    d = F.col("o_orderdate")
    raw = (
        F.when(F.col("o_orderkey") % 5 == 0, F.date_format(d, "d.M.yyyy"))
        .when(F.col("o_orderkey") % 5 == 1, F.date_format(d, "dd/MM/yy"))
        .when(F.col("o_orderkey") % 5 == 2, F.concat_ws(" ", F.dayofmonth(d), F.upper(F.get(months, F.month(d) - 1)), F.year(d)))
        .when(F.col("o_orderkey") % 5 == 3, F.concat(F.year(d), F.lit(" года")))
        .otherwise("нет даты")
    )
    return o.select("o_orderkey", D.sort_key(raw, RU.DATES).alias("sort_key"))


def pattern_hits(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.inline(TA.tag(F.col("text"), G.CITATIONS))).groupBy(
        "doc_id", "category", "value"
    ).agg(F.count(F.lit(1)).alias("hits"))


def exact_dup_groups(spark, sf_dir):
    """Groups of equal dedup keys; the key is hashed before the shuffle."""
    return (
        _docs(spark, sf_dir)
        .groupBy(F.sha2(T.dedup_key(F.col("text")), 256).alias("k"))
        .agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1").select("first_doc", "copies")
    )


def containment_dups(spark, sf_dir):
    """Different documents with the same beginning, each against the next shorter one: the native legs of the
    duplicate test. Copies are one text, so a crowd of them doesn't meet in a block."""
    d = _docs(spark, sf_dir).select("doc_id", T.dedup_key(F.col("text")).alias("a"))
    d = d.groupBy(F.md5(F.col("a").cast("binary")).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.first("a").alias("a"))
    order = Window.partitionBy(F.md5(F.left("a", F.lit(40)).cast("binary"))).orderBy(F.length("a"), "doc_id")
    d = d.select("doc_id", "a", F.lag("doc_id").over(order).alias("shorter"), F.lag("a").over(order).alias("b"))
    return d.filter("shorter IS NOT NULL").select(
        "doc_id", "shorter", SI.contains_most(F.col("a"), F.col("b")).alias("contained"),
        SI.ratio_possible(F.col("a"), F.col("b")).alias("ratio_possible"),
    )


def near_dup_names(spark, sf_dir):
    """Ratio leg on pairs of known ratio: part names against themselves with a strange ending of 0 to 4 letters."""
    k, n = (F.col("p_partkey") % 5).cast("int"), F.length("p_name")
    p = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("a"), F.concat(F.left("p_name", n - k), F.repeat(F.lit("§"), k)).alias("b")
    )
    ratio = SI.sequence_ratio("a", "b")
    return p.withColumn("ratio", ratio).select(
        "p_partkey", F.round("ratio", 6).alias("ratio"), (F.col("ratio") >= LC.DUPLICATE_RATIO).alias("same"),
        SI.ratio_possible(F.col("a"), F.concat("a", F.repeat(F.lit("§"), k * 2))).alias("longer_possible"),
    )


def near_dup_turns(spark, sf_dir):
    """Ratio leg: each turn against the next turn of the same conversation."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.dedup_key(F.col("text")).alias("a"))
    pairs = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b")), ["conv_id", "turn"])
    possible = pairs.filter(SI.ratio_possible(F.col("a"), F.col("b"), 0.5))
    return possible.select("conv_id", "turn", F.round(SI.sequence_ratio("a", "b"), 6).alias("ratio"))


def best_fragment(spark, sf_dir):
    """Most informative document per source; ties go to the first."""
    d = _docs(spark, sf_dir).select("source", "doc_id", CA.fragment_score(F.col("text")).cast("bigint").alias("score"))
    return d.groupBy("source").agg(
        F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("doc_id"), F.max("score").alias("score")
    )


def role_scores(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    role = F.get(F.array(*[F.lit(x) for x in ("Кредитор и залогодержатель", "юридическое лицо", "Должник", "сосед")]),
                 (F.col("p_partkey") % 4).cast("int"))
    mentions = p.select(
        F.col("p_brand").alias("doc_id"), F.col("p_type").alias("name"), role.alias("role"),
        F.struct(F.col("p_partkey").alias("annotation_seq"), F.lit(0).alias("line")).alias("seq"), F.lit(0).alias("role_seq"),
    )
    return CA.merge_roles(mentions).select("doc_id", "name", F.array_join("roles", ";").alias("roles"))


def header_first_match(spark, sf_dir):
    """First of three ordered patterns per page."""
    p = table(spark, sf_dir, "pages")
    found = HE.first_of(F.col("html"), (r"<h2>([^<]*)</h2>", r"<h1>([^<]*)</h1>", r"<title>([^<]*)</title>"))
    return p.select("page_id", found.alias("found"))


def file_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("/data/А56-"), F.col("o_orderkey").cast("string"), F.lit("-2019__"),
                    F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".pdf"))
    return o.select("o_orderkey", case_file_key(name).alias("k")).select("o_orderkey", "k.case_number", "k.act_yyyymmdd")


def priority_candidate(spark, sf_dir):
    """One document per source by label priority, then by id (a combined ``min_by``)."""
    d = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rank = F.when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return d.groupBy("source").agg(F.min_by("doc_id", F.struct(rank, "doc_id")).alias("doc_id"))


def char_report(spark, sf_dir):
    n = F.length(T.text_or_empty(F.col("text"))).cast("bigint")
    kept = F.length(T.one_line(F.col("text"))).cast("bigint")
    return _docs(spark, sf_dir).groupBy("lang").agg(F.sum(n).alias("raw"), F.sum(kept).alias("kept")).select(
        "lang", "raw", "kept", T.spaced_thousands(F.col("raw")).alias("raw_text"),
        F.when(F.col("raw") > 0, F.round((1 - F.col("kept") / F.col("raw")) * 100, 2)).otherwise(0.0).alias("reduction_pct"),
    )


def _turn_pages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), "text"
    )


def page_offsets(spark, sf_dir):
    return SC.page_offsets(_turn_pages(spark, sf_dir), block=4)


def span_pages(spark, sf_dir):
    """Pages touched by every 500-character span of a conversation."""
    offsets = SC.page_offsets(_turn_pages(spark, sf_dir), block=4)
    length = offsets.groupBy("doc_id").agg(F.max("end_offset").alias("n"))
    spans = length.select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(500).cast("bigint"))).alias("start_offset")).withColumn(
        "end_offset", F.col("start_offset") + 500
    )
    out = SE.pages_for_spans(spans, offsets, 1024)
    return out.withColumn("page_start", F.col("page_start").cast("bigint")).withColumn("page_end", F.col("page_end").cast("bigint"))


def forward_fill_roles(spark, sf_dir):
    """Last user turn at or before each turn (forward fill across chunks)."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return SC.forward_fill(
        c, ["conv_id"], F.floor(F.col("turn") / 3), ["turn"], F.when(F.col("role") == "user", F.col("turn")), "last_user_turn"
    )


def zone_transitions(spark, sf_dir):
    """Zone machine over the sentences of a document; letters stand for markers."""
    s = sentence_texts(F.col("text"), _EDGE)
    flags = F.transform(
        s,
        lambda x: F.struct(
            F.startswith(x, F.lit("E")).alias("party"), F.startswith(x, F.lit("I")).alias("strong"),
            F.startswith(x, F.lit("A")).alias("weak"),
        ),
    )
    z = _docs(spark, sf_dir).select("doc_id", let(flags, SE.zone_starts).alias("z"))
    return z.select("doc_id", F.col("z.party").cast("bigint").alias("party"), F.col("z.reasoning").cast("bigint").alias("reasoning"))


QUERIES = {
    f.__name__: f
    for f in (
        clean_basic_chars, normalized_variants, match_keys, clean_links, clean_requisites, running_headers,
        table_like_lines, paragraph_islands, table_blocks, sentences, sentence_offsets, sentence_stats_rollup,
        capital_sentences, strong_dates, weak_years, date_sort_keys, pattern_hits, exact_dup_groups,
        containment_dups, near_dup_names, near_dup_turns, best_fragment, role_scores, header_first_match, file_keys,
        priority_candidate, char_report, page_offsets, span_pages, forward_fill_roles, zone_transitions,
    )
}

_WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_DASH = "translate({t}, chr(160) || chr(8239) || '«»–—−', '  \"\"---')"


def _strip(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '^{_WS}+', ''), '{_WS}+$', '')"


def _squeeze(t: str) -> str:
    return f"regexp_replace({t}, '{_WS}+', ' ', 'g')"


def _tight(t: str) -> str:
    return f"regexp_replace({t}, '{_WS}+([,.!?;:])', '\\1', 'g')"


_KEEP = (
    "trim(regexp_replace(translate(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(160) || chr(8239) || chr(8199)"
    f" || chr(8203) || chr(65279), '   '), '[\\t\\x{{0B}}\\f\\x{{85}}\\p{{Z}}]+(\\n|$)', '\\1', 'g'), chr(10))"
)
_CARD = _strip(
    "regexp_replace(regexp_replace(translate(text, chr(160) || chr(8239) || '«»–—−', '  \"\"---'), '[ \\t]+', ' ', 'g'),"
    " '\\n{3,}', chr(10) || chr(10), 'g')"
)
_FOLD = "translate(lower({t}), 'ё', 'е')"
_DEDUP = (
    "trim(" + _tight(
        "translate(" + _squeeze("regexp_replace(" + _FOLD.format(t=_CARD) + ", '^[*\\-•]\\s*', '')") + ", '\"''`', '')"
    ) + ", ' .;,:')"
)
_SPLIT = (
    "string_split(regexp_replace(regexp_replace(regexp_replace(text, '(^|[^\\p{L}\\p{M}\\p{N}_])([a-zA-Z])\\.', '\\1\\2' || chr(2), 'g'),"
    " '([.!?])(\\s)', '\\1' || chr(1) || '\\2', 'g'), ':\\n', ':' || chr(1) || chr(10), 'g'), chr(1))"
)
_PIECES = f"""
pieces AS (SELECT doc_id, lang, unnest(p) AS piece, generate_subscripts(p, 1) AS i
           FROM (SELECT doc_id, lang, {_SPLIT} AS p FROM documents)),
cut AS (
  SELECT *, {_strip("replace(piece, chr(2), '.')")} AS body,
    length(piece) - length(regexp_replace(piece, '^{_WS}+', '')) AS lead,
    coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM pieces),
sent AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS idx FROM cut WHERE body <> '')"""
_MON = "['января','февраля','марта','апреля','мая','июня','июля','августа','сентября','октября','ноября','декабря']"

ORACLES = {
    "clean_basic_chars": """
SELECT doc_id, replace(replace(translate(regexp_replace(text, '\r\n?', chr(10), 'g'),
  chr(11) || chr(12) || chr(8232) || chr(8233) || chr(160) || chr(8239) || chr(8199) || '‐‒–—−«»“”„' || chr(8203) || chr(65279) || chr(65534) || chr(65533),
  chr(10) || chr(10) || chr(10) || chr(10) || '   -----\"\"\"\"\"'), 'ﬁ', 'fi'), 'ﬂ', 'fl') AS text FROM documents""",
    "normalized_variants": f"""
SELECT doc_id, {_strip(_squeeze(_KEEP))} AS one_line,
  {_strip(_squeeze(_DASH.format(t="text")))} AS audit_text,
  {_strip(_tight(_squeeze("translate(text, chr(160) || '«»–—−', ' \"\"---')")))} AS window_text,
  {_CARD} AS card_text
FROM documents""",
    "match_keys": f"""
SELECT doc_id, {_strip("regexp_replace(regexp_replace(" + _FOLD.format(t=_KEEP) + ", '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS match_text,
  {_DEDUP} AS dedup_key FROM documents""",
    "clean_links": "SELECT page_id, 'см.  или  конец' AS text FROM pages",
    "clean_requisites": "SELECT c_custkey, 'Покупатель ' || c_name || ' ,  , далее' AS text FROM customer",
    "running_headers": """
SELECT o_orderkey, 'Дело №' || chr(10) || n || chr(10) || 'текст ' || o_custkey || chr(10) || chr(10) || 'по делу №'
  || chr(10) || chr(10) || 'конец' AS text, n AS number
FROM (SELECT *, 'А10-' || o_orderkey || '/2020' AS n FROM orders)""",
    "table_like_lines": f"""
WITH l AS (SELECT doc_id, {_strip("line")} AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
SELECT doc_id, count(*) AS lines, count(*) FILTER (s <> ''
  AND NOT (length(s) > 80 AND regexp_matches(s, '(?i)[а-яёa-z]{{3,}}'))
  AND (len(regexp_extract_all(s, ' {{2,}}')) >= 3 OR contains(s, chr(9)) OR contains(s, ' | ')
    OR len(regexp_extract_all(s, '\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{2,4}}')) >= 2
    OR (length(s) < 120 AND len(regexp_extract_all(s, '\\b\\d[\\d\\s.,/-]*\\b')) >= 5))) AS table_like
FROM l GROUP BY 1""",
    "paragraph_islands": f"""
WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\\n{_WS}*\\n+', chr(10) || chr(10), 'g'), '\\n$', '') AS t FROM documents),
l AS (SELECT doc_id, {_strip("line")} AS s, i FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM t)),
f AS (SELECT *, s = '' OR (NOT (length(s) > 80 AND regexp_matches(s, '(?i)[а-яёa-z]{{3,}}'))
    AND (len(regexp_extract_all(s, ' {{2,}}')) >= 3 OR contains(s, chr(9)) OR contains(s, ' | ')
      OR len(regexp_extract_all(s, '\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{2,4}}')) >= 2
      OR (length(s) < 120 AND len(regexp_extract_all(s, '\\b\\d[\\d\\s.,/-]*\\b')) >= 5))) AS alone FROM l),
g AS (SELECT *, sum(CASE WHEN alone OR coalesce(prev, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
      FROM (SELECT *, lag(alone) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM f)),
p AS (SELECT doc_id, g, string_agg(s, ' ' ORDER BY i) AS s FROM g GROUP BY 1, 2)
SELECT doc_id, string_agg(s, chr(10) ORDER BY g) AS text FROM p GROUP BY 1""",
    "table_blocks": """
SELECT c_custkey, 'имя | ' || c_name || chr(10) || 'сегмент | ' || c_mktsegment AS text,
  '[[TABLE]]' || chr(10) || 'имя |    | ' || c_name || chr(10) || ' |' || chr(10) || 'сегмент  | ' || c_mktsegment || ' |'
  || chr(10) || '[[/TABLE]]' AS block FROM customer""",
    "sentences": f"WITH {_PIECES} SELECT doc_id, idx, body AS sentence FROM sent",
    "sentence_offsets": f"""
WITH {_PIECES} SELECT doc_id, idx, (before + lead)::BIGINT AS start_offset, (before + lead + length(body))::BIGINT AS end_offset FROM sent""",
    "sentence_stats_rollup": f"""
WITH {_PIECES}, n AS (SELECT doc_id, count(*) AS n FROM sent GROUP BY 1)
SELECT coalesce(lang, 'total') AS lang, count(*) AS documents, coalesce(sum(n), 0)::BIGINT AS sentences
FROM documents LEFT JOIN n USING (doc_id) GROUP BY ROLLUP (lang)""",
    "capital_sentences": """
SELECT o_orderkey, 'Долг по ст. 5 на 100 руб. Взыскан ' || strftime(o_orderdate, '%d.%m.%Y') || ' судьей И.И. Ивановым.|Заказ '
  || o_orderkey || ' закрыт! а вот нет.|Все.' AS parts FROM orders""",
    "strong_dates": f"""
SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') || '|' || day(o_orderdate) || '/' || month(o_orderdate) || '/' || strftime(o_orderdate, '%y')
  || '|' || day(o_orderdate) || ' ' || {_MON}[month(o_orderdate)] || ' ' || year(o_orderdate) || ' г.' AS dates, 0::BIGINT AS weak FROM orders""",
    "weak_years": f"""
SELECT doc_id, array_to_string(regexp_extract_all(text, '\\b(?:19\\d{{2}}|20\\d{{2}}){_WS}*'), ',') AS years FROM documents""",
    "date_sort_keys": """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN year(o_orderdate) || '-00-00' WHEN 4 THEN '9999-99-99'
  ELSE strftime(o_orderdate, '%Y-%m-%d') END AS sort_key FROM orders""",
    "pattern_hits": f"""
WITH h AS (
  SELECT doc_id, 'ipv4' AS category, unnest(regexp_extract_all(text, '\\b\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\b')) AS value FROM documents
  UNION ALL SELECT doc_id, 'email', unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')) FROM documents
  UNION ALL SELECT doc_id, 'phone', unnest(regexp_extract_all(text, '\\+\\d{{1,3}}[ .-]?\\(?\\d{{2,4}}\\)?[ .-]?\\d{{3}}[ .-]?\\d{{2,4}}')) FROM documents
  UNION ALL SELECT doc_id, 'long_number', unnest(regexp_extract_all(text, '\\b\\d{{12,19}}\\b')) FROM documents
  UNION ALL SELECT doc_id, 'year', unnest(regexp_extract_all(text, '\\b(?:19|20)\\d{{2}}\\b')) FROM documents
  UNION ALL SELECT doc_id, 'licence', unnest(regexp_extract_all(text, '(?i)(?:MIT|Apache|GPL|BSD|Creative Commons)[^.\\n]{{0,20}}')) FROM documents)
SELECT doc_id, category, {_strip(_squeeze("translate(value, chr(160) || '«»–—−', ' \"\"---')"))} AS value, count(*) AS hits
FROM h GROUP BY 1, 2, 3""",
    "exact_dup_groups": f"""
SELECT min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY {_DEDUP} HAVING count(*) > 1""",
    "containment_dups": f"""
WITH d AS (SELECT min(doc_id) AS doc_id, a FROM (SELECT doc_id, {_DEDUP} AS a FROM documents) GROUP BY a),
e AS (SELECT doc_id, a, lag(doc_id) OVER w AS shorter, lag(a) OVER w AS b FROM d WINDOW w AS (PARTITION BY left(a, 40) ORDER BY length(a), doc_id))
SELECT doc_id, shorter, length(b) > 80 AND length(b) / length(a) >= 0.72 AND contains(a, b) AS contained,
  2 * length(b) >= 0.92::DOUBLE * (length(a) + length(b)) AS ratio_possible
FROM e WHERE shorter IS NOT NULL""",
    "near_dup_names": """
SELECT p_partkey, round((length(p_name) - p_partkey % 5) / length(p_name), 6) AS ratio,
  (length(p_name) - p_partkey % 5) / length(p_name) >= 0.92::DOUBLE AS same,
  2 * length(p_name) >= 0.92::DOUBLE * (2 * length(p_name) + 2 * (p_partkey % 5)) AS longer_possible
FROM part""",
    "best_fragment": f"""
WITH s AS (SELECT source, doc_id, (floor(least(length(n), 1200) / 20)
  + 3 * len(regexp_extract_all(n, '\\d{{1,2}}[./-]\\d{{1,2}}[./-]\\d{{2,4}}'))
  + 3 * len(regexp_extract_all(lower(n), '\\d[\\d\\s]*(?:,\\d+)?\\s*(?:руб|%)')))::BIGINT AS score
  FROM (SELECT source, doc_id, {_CARD} AS n FROM documents))
SELECT source, arg_min(doc_id, (-score, doc_id)) AS doc_id, max(score) AS score FROM s GROUP BY 1""",
    "role_scores": """
WITH m AS (SELECT p_brand AS doc_id, p_type AS name, ['Кредитор и залогодержатель','юридическое лицо','Должник','сосед'][p_partkey % 4 + 1] AS role FROM part),
r AS (SELECT DISTINCT *, role = 'юридическое лицо' AS generic,
        CASE role WHEN 'Кредитор и залогодержатель' THEN 13 WHEN 'Должник' THEN 6 WHEN 'сосед' THEN 1 ELSE -8 END AS score FROM m),
h AS (SELECT doc_id, name, bool_or(NOT generic) AS specific FROM r GROUP BY 1, 2)
SELECT doc_id, name, string_agg(role, ';' ORDER BY score DESC) AS roles
FROM r JOIN h USING (doc_id, name) WHERE NOT (specific AND generic) GROUP BY 1, 2""",
    "header_first_match": """
SELECT page_id, coalesce(nullif(regexp_extract(html, '<h2>([^<]*)</h2>', 1), ''), nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), ''),
  nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '')) AS found FROM pages""",
    "file_keys": """
SELECT o_orderkey, 'А56-' || o_orderkey || '-2019' AS case_number, strftime(o_orderdate, '%Y%m%d') AS act_yyyymmdd FROM orders""",
    "priority_candidate": """
SELECT source, arg_min(doc_id, (CASE quality WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END, doc_id)) AS doc_id
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
    "char_report": f"""
SELECT lang, raw, kept, replace(format('{{:,}}', raw), ',', ' ') AS raw_text, round((1 - kept / raw) * 100, 2) AS reduction_pct
FROM (SELECT lang, sum(length(text))::BIGINT AS raw, sum(length({_strip(_squeeze(_KEEP))}))::BIGINT AS kept FROM documents GROUP BY 1)""",
    "page_offsets": """
SELECT conv_id AS doc_id, turn::INT AS page, (e - length(text))::BIGINT AS start_offset, e::BIGINT AS end_offset
FROM (SELECT *, sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn) - 2 AS e FROM conversations)""",
    "span_pages": """
WITH p AS (SELECT conv_id AS doc_id, turn AS page, e - length(text) AS s, e
  FROM (SELECT *, sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn) - 2 AS e FROM conversations)),
x AS (SELECT doc_id, unnest(range(0, max(e)::BIGINT, 500)) AS a FROM p GROUP BY doc_id)
SELECT x.doc_id, a AS start_offset, a + 500 AS end_offset, min(page) AS page_start, max(page) AS page_end
FROM x JOIN p ON p.doc_id = x.doc_id AND p.e > a AND p.s < a + 500 GROUP BY 1, 2, 3""",
    "forward_fill_roles": """
SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_user_turn FROM conversations""",
    "zone_transitions": f"""
WITH {_PIECES},
f AS (SELECT doc_id, idx, body LIKE 'E%' AS party, body LIKE 'I%' AS strong, body LIKE 'A%' AS weak FROM sent),
o AS (SELECT doc_id, min(idx) FILTER (party OR strong) AS s0 FROM f GROUP BY 1),
k AS (SELECT o.*, party FROM o LEFT JOIN f ON f.doc_id = o.doc_id AND f.idx = s0)
SELECT d.doc_id, any_value(CASE WHEN k.party THEN s0 END) AS party,
  CASE WHEN any_value(k.party) THEN min(f.idx) FILTER (f.idx > s0 AND (f.strong OR (f.weak AND f.idx >= s0 + 2))) ELSE any_value(s0) END AS reasoning
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY 1""",
}
