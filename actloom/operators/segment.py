"""Pages -> document text -> zones -> sentences.

Shape of the work: pages of a document are brought together once (the only
exchange); after that every document is one row and all segmentation is map-only.
Long tables are produced at the end by ``explode``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actloom.functions import cleaning as C
from actloom.functions import dates as D
from actloom.functions import text as T
from actloom.functions.arrays import exclusive_running_sum, first_index, let, stage
from actloom.functions.sentences import sentence_edge, sentence_spans
from actloom.lexicon import ru_acts as RU
from actloom.session import cut_lineage

HEADER, HISTORY, PARTY, REASONING, OPERATIVE = (
    "header", "procedural_history", "party_position", "court_reasoning", "operative_part",
)
PREVIEW = 240
SEPARATOR = "\n\n"

_ZONE_EDGE = sentence_edge(extra=())
_SENTENCE_EDGE = sentence_edge()


# ------------------------------------------------------------------ pages

def gather_pages(pages: DataFrame) -> DataFrame:
    """One row per document with its pages in page order (the one exchange).

    Bytes are few but the regular expressions behind are many, so the exchange
    keeps all configured partitions instead of being coalesced by size.
    """
    page = F.struct(
        F.col("page").cast("int").alias("page"),
        T.text_or_empty(F.col("text")).alias("text"),
        F.coalesce(F.col("tables"), F.array().cast("array<string>")).alias("tables"),
    )
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = pages.repartition(n, "doc_id")
    return spread.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))


def clean_pages(docs: DataFrame) -> DataFrame:
    """Clean every page; adds the main case number and raw / cleaned lengths.

    The case number is looked up on the first page only.
    """
    first = C.basic_chars(F.get(F.col("pages"), F.lit(0))["text"])
    docs = stage(docs, main_case_number=C.main_case_number(first))

    def cleaned(pages: Column, number: Column) -> Column:
        out = F.transform(
            pages,
            lambda p, i: F.struct(
                p["page"].alias("page"),
                F.when(p["text"] == "", "").otherwise(C.clean_page(p["text"], i == 0, number)).alias("text"),
                p["tables"].alias("tables"),
                F.length(p["text"]).alias("raw_length"),
            ),
        )
        return out

    docs = stage(docs, pages=cleaned(F.col("pages"), F.col("main_case_number")))
    return docs.select(
        "doc_id",
        "main_case_number",
        F.aggregate("pages", F.lit(0).cast("bigint"), lambda a, p: a + p["raw_length"]).alias("raw_length"),
        F.aggregate("pages", F.lit(0).cast("bigint"), lambda a, p: a + F.length(p["text"])).alias("cleaned_length"),
        F.transform(
            F.filter("pages", lambda p: (p["text"] != "") | (F.size(p["tables"]) > 0)),
            lambda p: p.dropFields("raw_length"),
        ).alias("pages"),
    )


def full_text(docs: DataFrame) -> DataFrame:
    """Whole-document text: pages and tables joined, boilerplate removed."""
    parts = F.flatten(
        F.transform("pages", lambda p: F.concat(F.array(p["text"]), p["tables"]))
    )
    body = T.strip(F.array_join(F.filter(parts, lambda x: x != ""), SEPARATOR))
    return stage(docs, full_text=C.clean_document(body, F.col("main_case_number")))


def cleaning_report(docs: DataFrame) -> DataFrame:
    """Raw and cleaned length per document with guarded ratios."""
    raw, kept = F.col("raw_length"), F.col("cleaned_length")
    return docs.select(
        "doc_id",
        "raw_length",
        "cleaned_length",
        F.when(raw > 0, F.round(kept / raw, 6)).otherwise(0.0).alias("ratio"),
        F.when(raw > 0, F.round((1 - kept / raw) * 100, 2)).otherwise(0.0).alias("reduction_pct"),
    )


def page_text(page: Column) -> Column:
    """Page text followed by its tables as marked blocks."""
    parts = F.concat(
        F.array(T.keep_content(page["text"])),
        F.transform(page["tables"], lambda t: C.table_block(T.strip(t))),
    )
    return T.strip(F.array_join(F.filter(parts, lambda x: x != ""), SEPARATOR))


def assemble(docs: DataFrame) -> DataFrame:
    """Adds ``text`` and ``page_spans`` (offset interval of every page)."""
    texts = F.filter(
        F.transform("pages", lambda p: F.struct(p["page"].alias("page"), page_text(p).alias("text"))),
        lambda p: p["text"] != "",
    )

    def spans(pages: Column) -> Column:
        widths = F.transform(pages, lambda p: F.length(p["text"]) + len(SEPARATOR))
        return let(
            exclusive_running_sum(widths),
            lambda before: F.transform(
                pages,
                lambda p, i: F.struct(
                    p["page"].alias("page"),
                    F.get(before, i).alias("start_offset"),
                    (F.get(before, i) + F.length(p["text"])).alias("end_offset"),
                ),
            ),
        )

    built = let(
        texts,
        lambda pages: F.struct(
            F.array_join(F.transform(pages, lambda p: p["text"]), SEPARATOR).alias("text"),
            spans(pages).alias("page_spans"),
        ),
    )
    return stage(docs, _built=built).select("*", "_built.text", "_built.page_spans").drop("_built")


def pages_touched(page_spans: Column, start: Column, end: Column) -> Column:
    """``struct<lo,hi>`` of the pages that overlap ``[start, end)``; NULLs if none."""
    touched = F.transform(
        F.filter(page_spans, lambda s: (s["end_offset"] > start) & (s["start_offset"] < end)),
        lambda s: s["page"],
    )
    return let(touched, lambda t: F.struct(F.array_min(t).alias("lo"), F.array_max(t).alias("hi")))


# ------------------------------------------------------------------ zones

def hard_boundaries(text: Column) -> Column:
    """``struct<header,body,operative>`` by the two hard markers.

    Header runs to the first opening marker, the body from there to the first
    stand-alone ruling line after it. Without an opening marker all is header.
    """

    def rest(t: Column, head: Column) -> Column:
        tail = F.substr(t, F.length(head) + 1)
        body = F.get(F.split(tail, T.rx(f"(?={RU.RULED_LINE})", "imu"), 2), F.lit(0))
        return let(
            F.struct(tail.alias("tail"), body.alias("body")),
            lambda x: F.struct(
                head.alias("header"),
                x["body"].alias("body"),
                F.substr(x["tail"], F.length(x["body"]) + 1).alias("operative"),
            ),
        )

    return let(T.keep_content(text), lambda t: let(T.before(t, RU.ESTABLISHED), lambda h: rest(t, h)))


def marker_flags(norm: Column) -> Column:
    """Party, strong and weak reasoning flags of one normalised sentence."""

    def any_marker(patterns: tuple[str, ...], words: tuple[str, ...]) -> Column:
        return T.contains_any(norm, words) & T.has(norm, "|".join(f"(?:{p})" for p in patterns), "isu")

    found = F.struct(
        any_marker(RU.PARTY_MARKERS, RU.PARTY_WORDS).alias("party"),
        any_marker(RU.STRONG_REASONING_MARKERS, RU.STRONG_REASONING_WORDS).alias("strong"),
        any_marker(RU.WEAK_REASONING_MARKERS, RU.WEAK_REASONING_WORDS).alias("weak"),
    )
    none = F.struct(*(F.lit(False).alias(n) for n in ("party", "strong", "weak")))
    return F.when(T.opens(RU.MARKER_OPENINGS)(norm), found).otherwise(none)


def zone_starts(flags: Column, weak_gap: int = 2) -> Column:
    """Closed form of the forward-only zone machine.

    ``flags`` is ``array<struct<party,strong,weak>>``; the result holds the first
    sentence of the party and reasoning zones (NULL when absent) and whether the
    reasoning zone was opened by a weak marker. Zones only move forward, so each
    start is the position of the first sentence that meets a condition.
    """

    def after_party(p: Column) -> Column:
        r = first_index(
            flags, lambda f, i: (i > p) & (f["strong"] | (f["weak"] & (i >= p + weak_gap)))
        )
        return let(
            r,
            lambda x: F.struct(
                p.alias("party"), x.alias("reasoning"), (~F.get(flags, x)["strong"]).alias("weak")
            ),
        )

    opening = first_index(flags, lambda f, _i: f["party"] | f["strong"])
    return let(
        opening,
        lambda s: F.when(F.get(flags, s)["party"], after_party(s)).otherwise(
            F.struct(F.lit(None).cast("int").alias("party"), s.alias("reasoning"), F.lit(False).alias("weak"))
        ),
    )


def zone_starts_of(sentences: Column, flags_of: Callable[[Column], Column], weak_gap: int = 2) -> Column:
    """``zone_starts`` of sentences whose flags are only looked up as far as the machine needs them.

    Nothing moves once the reasoning zone is open, so the sentences behind its first one are not searched.
    """
    none = F.lit(None).cast("int")
    start = F.struct(
        F.lit(0).alias("i"), none.alias("party"), none.alias("reasoning"), F.lit(None).cast("boolean").alias("weak")
    )

    def moved(at: Column, f: Column) -> Column:
        in_party = at["party"].isNotNull()
        opens = F.when(in_party, f["strong"] | (f["weak"] & (at["i"] >= at["party"] + weak_gap))).otherwise(
            ~f["party"] & f["strong"]
        )
        return F.struct(
            (at["i"] + 1).alias("i"),
            F.when(~in_party & f["party"], at["i"]).otherwise(at["party"]).alias("party"),
            F.when(opens, at["i"]).alias("reasoning"),
            F.when(opens, in_party & ~f["strong"]).alias("weak"),
        )

    return F.aggregate(
        sentences, start,
        lambda at, s: F.when(at["reasoning"].isNotNull(), at).otherwise(let(flags_of(s), lambda f: moved(at, f))),
    )


def _zone(kind, text, confidence, reason, pages, start, end, debug) -> Column:
    return F.struct(
        F.lit(kind).alias("zone_type"),
        pages["lo"].alias("page_start"),
        pages["hi"].alias("page_end"),
        T.strip(text).alias("text"),
        confidence.alias("confidence"),
        reason.alias("boundary_reason"),
        debug.alias("debug"),
        start.cast("int").alias("start_offset"),
        end.cast("int").alias("end_offset"),
    )


def _debug(lo=None, hi=None, first=None, last=None) -> Column:
    none_int, none_str = F.lit(None).cast("int"), F.lit(None).cast("string")
    return F.struct(
        (none_int if lo is None else lo.cast("int")).alias("sentence_start_idx"),
        (none_int if hi is None else hi.cast("int")).alias("sentence_end_idx"),
        (none_int if lo is None else (hi - lo + 1).cast("int")).alias("num_sentences"),
        (none_str if first is None else F.left(first, F.lit(PREVIEW))).alias("start_preview"),
        (none_str if last is None else F.right(last, F.lit(PREVIEW))).alias("end_preview"),
    )


def zones_of(text: Column, page_spans: Column) -> Column:
    """``array<struct<...>>`` of zones in document order, numbered ``z001``..."""

    def edge_zone(kind: str, body: Column, reason: str, start: Column, end: Column) -> Column:
        zone = _zone(
            kind, body, F.lit("high"), F.lit(reason), pages_touched(page_spans, start, end), start, end, _debug()
        )
        return F.when(T.strip(body) != "", F.array(zone))

    def body_zones(sentences: Column, starts: Column) -> Column:
        n = F.size(sentences)

        def zone(kind: str, lo: Column, hi: Column, confidence: Column, reason: Column) -> Column:
            first, last = F.get(sentences, lo), F.get(sentences, hi)
            body = F.array_join(
                F.transform(F.slice(sentences, lo + 1, F.greatest(hi - lo + 1, F.lit(0))), lambda s: s["text"]),
                SEPARATOR,
            )

            def page_of(s: Column) -> Column:
                touched = pages_touched(page_spans, s["start_offset"], s["end_offset"])
                return F.coalesce(touched["lo"], F.lit(1))

            pages = F.struct(page_of(first).alias("lo"), page_of(last).alias("hi"))
            made = _zone(
                kind, body, confidence, reason, pages, first["start_offset"], last["end_offset"],
                _debug(lo, hi, first["text"], last["text"]),
            )
            return F.when((lo <= hi) & (n > 0), F.array(made))

        party, reasoning, weak = starts["party"], starts["reasoning"], starts["weak"]
        return _concat_zones(
            zone(
                HISTORY, F.lit(0), F.coalesce(party, reasoning, n) - 1, F.lit("high"),
                F.lit("body_starts_from_ustanovil_marker"),
            ),
            zone(
                PARTY, party, F.coalesce(reasoning, n) - 1, F.lit("high"),
                F.lit("found_party_position_marker"),
            ),
            zone(
                REASONING, reasoning, n - 1,
                F.when(weak, "medium").otherwise("high"),
                F.when(weak, "found_weak_court_reasoning_marker_after_party_position_buffer")
                .when(party.isNotNull(), "found_strong_court_reasoning_marker_after_party_position")
                .otherwise("found_strong_court_reasoning_marker_before_party_position"),
            ),
        )

    def from_parts(parts: Column) -> Column:
        body_start = F.length(parts["header"])
        body_end = body_start + F.length(parts["body"])
        total = body_end + F.length(parts["operative"])
        sentences = sentence_spans(T.strip(parts["body"]), _ZONE_EDGE, body_start)
        body = let(
            sentences,
            lambda s: let(
                zone_starts_of(s, lambda x: let(T.match_text(x["text"], blank_numbers=True), marker_flags)),
                lambda st: body_zones(s, st),
            ),
        )
        zones = _concat_zones(
            edge_zone(HEADER, parts["header"], "text_before_ustanovil_marker", F.lit(0), body_start),
            body,
            edge_zone(OPERATIVE, parts["operative"], "text_from_postanovil_marker", body_end, total),
        )
        return let(
            zones,
            lambda z: F.transform(
                z, lambda x, i: x.withField("zone_id", F.format_string("z%03d", i + 1))
            ),
        )

    return let(hard_boundaries(text), from_parts)


def _concat_zones(*parts: Column) -> Column:
    """Concatenate zone arrays, NULL meaning "no such zone"."""
    return F.flatten(F.filter(F.array(*parts), lambda p: p.isNotNull()))


def split_zones(docs: DataFrame) -> DataFrame:
    return stage(docs, zones=zones_of(F.col("text"), F.col("page_spans")))


def zone_rows(docs: DataFrame) -> DataFrame:
    """Long ``zones`` table."""
    z = F.col("z")
    return docs.select("doc_id", F.explode("zones").alias("z")).select(
        "doc_id",
        *[
            z[c].alias(c)
            for c in (
                "zone_id", "zone_type", "page_start", "page_end", "text", "confidence",
                "boundary_reason", "debug", "start_offset", "end_offset",
            )
        ],
    )


def zones_as_pages(zones: DataFrame) -> DataFrame:
    """Zones in the shape of pages, ready to be cut into chunks."""
    return zones.select(
        "doc_id",
        F.coalesce("page_start", F.lit(1)).alias("page"),
        "text",
        F.array().cast("array<string>").alias("tables"),
        F.col("zone_type").alias("section_type"),
        "page_start",
        "page_end",
    )


def zone_integrity(docs: DataFrame) -> DataFrame:
    """Conservation check: the zones together still hold the whole text.

    Both sides live in the same row, so nothing is joined.
    """

    def flat(c: Column) -> Column:
        return T.strip(T.squeeze(F.translate(c, T.NBSP, " ")))

    joined = T.strip(F.array_join(F.transform("zones", lambda z: z["text"]), SEPARATOR))
    out = stage(docs, a=flat(F.col("text")), b=flat(joined)).select(
        "doc_id", F.size("zones").alias("zones_count"), "a", "b"
    )
    la, lb = F.length("a"), F.length("b")
    same = F.col("a") == F.col("b")
    return out.select(
        "doc_id",
        "zones_count",
        la.alias("source_norm_chars"),
        lb.alias("zones_norm_chars"),
        F.when((la == 0) & (lb == 0), 1.0).otherwise(F.round(lb / F.greatest(la, F.lit(1)), 6)).alias("length_ratio"),
        same.alias("text_equal_after_normalization"),
        same.alias("ok"),
    )


# -------------------------------------------------------------- sentences

SENTENCE_COLUMNS = (
    "sentence_id", "global_index", "zone_sentence_index", "zone_id", "zone_type", "page_start",
    "page_end", "zone_start_offset", "zone_end_offset", "sentence_start_offset",
    "sentence_end_offset", "text", "norm_text", "dates", "weak_dates", "has_date",
)


def sentences_of(
    text: Column, zones: Column, lex: D.DateLexicon = RU.DATES, *, with_operative: bool = False,
    fields: Sequence[str] = SENTENCE_COLUMNS,
) -> Column:
    """Sentence records of all zones, globally and per zone numbered.

    Zones are filtered before splitting. Each zone is read back from the document
    text by its offsets, so sentence offsets are exact. Pages are those of the zone.
    ``fields`` names those that are read later: the optimizer prunes no fields inside lambdas.
    """
    dated = bool({"dates", "weak_dates", "has_date"} & set(fields))
    wanted = zones if with_operative else F.filter(zones, lambda z: z["zone_type"] != OPERATIVE)

    def of_zone(z: Column) -> Column:
        source = F.substr(text, z["start_offset"] + 1, z["end_offset"] - z["start_offset"])
        spans = sentence_spans(source, _SENTENCE_EDGE, z["start_offset"])

        def record(s: Column, i: Column, t: Column, strong: Column | None = None, weak: Column | None = None) -> Column:
            made = {
                "zone_sentence_index": i + 1,
                "zone_id": z["zone_id"],
                "zone_type": z["zone_type"],
                "page_start": z["page_start"],
                "page_end": z["page_end"],
                "zone_start_offset": z["start_offset"],
                "zone_end_offset": z["end_offset"],
                "sentence_start_offset": s["start_offset"],
                "sentence_end_offset": s["end_offset"],
                "text": t,
                "norm_text": T.fold_case(t),  # one line already
            }
            if dated:
                made |= {"dates": strong, "weak_dates": weak, "has_date": (F.size(strong) > 0) | (F.size(weak) > 0)}
            return F.struct(*[c.alias(n) for n, c in made.items() if n in fields])

        def of_line(s: Column, i: Column, t: Column) -> Column:
            if not dated:
                return record(s, i, t)
            return let(
                D.strong_dates(t, lex),
                lambda strong: let(D.weak_dates(t, lex, strong), lambda weak: record(s, i, t, strong, weak)),
            )

        return F.transform(spans, lambda s, i: let(T.one_line(s["text"]), lambda t: of_line(s, i, t)))

    return let(
        F.flatten(F.transform(wanted, of_zone)),
        lambda all_: F.transform(
            all_,
            lambda s, i: s.withField("global_index", i + 1).withField(
                "sentence_id", F.format_string("s%05d", i + 1)
            ),
        ),
    )


def split_sentences(
    docs: DataFrame, lex: D.DateLexicon = RU.DATES, *, with_operative: bool = False,
    fields: Sequence[str] = SENTENCE_COLUMNS,
) -> DataFrame:
    made = sentences_of(F.col("text"), F.col("zones"), lex, with_operative=with_operative, fields=fields)
    return stage(docs, sentences=made)


def sentence_rows(docs: DataFrame, fields: Sequence[str] = SENTENCE_COLUMNS) -> DataFrame:
    """Long ``sentences`` table."""
    s = F.col("s")
    return docs.select("doc_id", F.explode("sentences").alias("s")).select("doc_id", *[s[c].alias(c) for c in fields])


def dated_sentences(
    sentences: DataFrame, *, include_weak: bool = False, zone_types: tuple[str, ...] | None = None
) -> DataFrame:
    keep = F.size("dates") > 0
    if include_weak:
        keep = keep | (F.size("weak_dates") > 0)
    if zone_types is not None:
        keep = keep & F.col("zone_type").isin(*zone_types)
    return sentences.filter(keep)


def sentences_by_zone(sentences: DataFrame) -> DataFrame:
    """Sentence counts per document and zone."""
    return sentences.groupBy("doc_id", "zone_id", "zone_type").agg(
        F.count(F.lit(1)).alias("sentences"), F.min("global_index").alias("first_index")
    )


def sentence_stats(sentences: DataFrame) -> DataFrame:
    """Counts per zone type and, by rollup, the total (``zone_type`` NULL)."""
    return sentences.rollup("zone_type").agg(
        F.count(F.lit(1)).alias("sentences"),
        F.count_if(F.size("dates") > 0).alias("with_dates"),
        F.count_if(F.size("weak_dates") > 0).alias("with_weak_dates"),
        F.count_if((F.size("dates") > 0) | (F.size("weak_dates") > 0)).alias("with_any_date"),
    )


def first_dated_sentences(sentences: DataFrame, limit: int = 100) -> DataFrame:
    """The first dated sentences in document order (a top-k report)."""
    return dated_sentences(sentences, include_weak=True).orderBy("doc_id", "global_index").limit(limit)


def leading_rows(
    pages: DataFrame, rows_of: Callable[[DataFrame], DataFrame], limit: int, documents_a_row: int = 4
) -> DataFrame:
    """Rows of ``rows_of(pages)`` that hold the first ``limit`` of them in document order, for a top-k report.

    All pages are read for the order of their documents, but documents are only segmented as far as the report
    reaches: rows of a later document stand behind all rows of an earlier one. If the leading documents give too
    few rows, all documents are taken.
    """
    ids = pages.select("doc_id").distinct().orderBy("doc_id").limit(documents_a_row * limit).withColumnRenamed("doc_id", "_id")
    lead = pages.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    rows = cut_lineage(rows_of(lead), "leading")
    return rows if rows.limit(limit).count() == limit else rows_of(pages)


# --------------------------------------------------- interval join, long form

def pages_for_spans(spans: DataFrame, page_spans: DataFrame, bucket: int = 4096) -> DataFrame:
    """Pages touched by character spans, for tables that are already long.

    Both sides are cut into offset buckets, so the equi-join key is
    ``(doc_id, bucket)`` and one huge document spreads over many tasks. The final
    ``min``/``max`` removes the repeats that bucket edges create.
    """

    def buckets(start: Column, end: Column) -> Column:
        lo = F.floor(start / bucket)
        hi = F.floor(F.greatest(end - 1, start) / bucket)
        return F.explode(F.sequence(lo, hi))

    s = spans.withColumn("b", buckets(F.col("start_offset"), F.col("end_offset")))
    p = page_spans.select(
        "doc_id",
        "page",
        F.col("start_offset").alias("p_start"),
        F.col("end_offset").alias("p_end"),
        buckets(F.col("start_offset"), F.col("end_offset")).alias("b"),
    )
    hit = s.join(p, ["doc_id", "b"]).filter(
        (F.col("p_end") > F.col("start_offset")) & (F.col("p_start") < F.col("end_offset"))
    )
    keys = [c for c in spans.columns]
    return hit.groupBy(*keys).agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"))
