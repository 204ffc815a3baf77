"""Anchor-based sentence windows: build, clean, export, count."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actloom.functions import text as T
from actloom.functions.arrays import cut, indices, let, runs, stage, unique_in_order
from actloom.lexicon import ru_acts as RU

MERGE_GAP = 2
CONTEXT = 1


def anchor_groups(is_anchor: Column, gap: int = MERGE_GAP) -> Column:
    """Islands of anchor positions.

    ``is_anchor`` is ``array<boolean>``. Anchors at most ``gap`` positions apart
    belong together; the result is ``array<struct<first,last>>``.
    """
    positions = let(is_anchor, lambda flags: F.filter(indices(flags), lambda i: F.get(flags, i)))

    def islands(pos: Column) -> Column:
        starts = F.filter(
            indices(pos), lambda k: (k == 0) | (F.get(pos, k) - F.get(pos, k - 1) > gap)
        )
        return F.transform(
            runs(starts, F.size(pos)),
            lambda r: F.struct(F.get(pos, r["lo"]).alias("first"), F.get(pos, r["hi"]).alias("last")),
        )

    return let(positions, islands)


def window_spans(strong: Column, weak_only: Column, gap: int = MERGE_GAP, context: int = CONTEXT) -> Column:
    """``array<struct<lo,hi,first,last>>`` of member and anchor positions.

    Strong anchors give merged windows with context; a weak anchor that is not
    strong gives a window of its own.
    """
    return let(
        F.struct(strong.alias("strong"), weak_only.alias("weak")),
        lambda x: _spans(x["strong"], x["weak"], gap, context),
    )


def _spans(strong: Column, weak_only: Column, gap: int, context: int) -> Column:
    n = F.size(strong)
    merged = F.transform(
        anchor_groups(strong, gap),
        lambda g: F.struct(
            F.greatest(g["first"] - context, F.lit(0)).alias("lo"),
            F.least(g["last"] + context, n - 1).alias("hi"),
            g["first"].alias("first"),
            g["last"].alias("last"),
        ),
    )
    single = F.transform(
        F.filter(indices(weak_only), lambda i: F.get(weak_only, i)),
        lambda i: F.struct(i.alias("lo"), i.alias("hi"), i.alias("first"), i.alias("last")),
    )
    return F.concat(merged, single)


def _marked_text(sentences: Column, is_anchor: Callable[[Column], Column]) -> Column:
    return F.array_join(
        F.transform(
            sentences, lambda s: F.concat(F.when(is_anchor(s), "* ").otherwise("- "), s["text"])
        ),
        "\n",
    )


WINDOW_COLUMNS = (
    "window_id", "kind", "zone_id", "zone_type", "page_start", "page_end",
    "sentence_start_global_index", "sentence_end_global_index", "sentence_start_zone_index",
    "sentence_end_zone_index", "sentence_ids", "date_sentence_ids", "dates", "weak_dates",
    "has_strong_date", "has_weak_date", "text", "sentences",
)


def windows_of(
    sentences: Column, zone_types: Sequence[str] = RU.WINDOW_ZONES, fields: Sequence[str] = WINDOW_COLUMNS
) -> Column:
    """Windows of one document from its sentence array.

    A sentence that is cited (``cited``) or outside the allowed zones is gone
    before positions are counted. Zones are handled one by one. ``fields`` names
    those that are read later; the ones that order the windows are always made.
    """
    made = {*fields, "page_start", "sentence_start_global_index"}
    allowed = F.filter(sentences, lambda s: s["zone_type"].isin(*zone_types) & ~s["cited"])

    def of_zone(zone: Column) -> Column:
        strong = F.transform(zone, lambda s: F.size(s["dates"]) > 0)
        weak_only = F.transform(zone, lambda s: (F.size(s["dates"]) == 0) & (F.size(s["weak_dates"]) > 0))

        def record(w: Column) -> Column:
            def build(x: Column) -> Column:
                members, anchors = x["members"], x["anchors"]
                ids = F.transform(anchors, lambda s: s["sentence_id"])
                pages = F.concat(
                    F.transform(members, lambda s: s["page_start"]),
                    F.transform(members, lambda s: s["page_end"]),
                )
                first, last = F.get(members, F.lit(0)), F.element_at(members, -1)
                dates = unique_in_order(F.flatten(F.transform(anchors, lambda s: s["dates"])))
                weak = unique_in_order(F.flatten(F.transform(anchors, lambda s: s["weak_dates"])))
                values = {
                    "kind": F.lit("date_window"),
                    "zone_id": first["zone_id"],
                    "zone_type": first["zone_type"],
                    "page_start": F.array_min(pages),
                    "page_end": F.array_max(pages),
                    "sentence_start_global_index": first["global_index"],
                    "sentence_end_global_index": last["global_index"],
                    "sentence_start_zone_index": first["zone_sentence_index"],
                    "sentence_end_zone_index": last["zone_sentence_index"],
                    "sentence_ids": F.transform(members, lambda s: s["sentence_id"]),
                    "date_sentence_ids": ids,
                    "dates": dates,
                    "weak_dates": weak,
                    "has_strong_date": F.size(dates) > 0,
                    "has_weak_date": F.size(weak) > 0,
                    "text": _marked_text(members, lambda s: F.array_contains(ids, s["sentence_id"])),
                    "sentences": members,
                }
                return F.struct(*[c.alias(n) for n, c in values.items() if n in made])

            anchors = F.when(
                F.size(F.get(zone, w["first"])["dates"]) == 0, cut(zone, w["first"], w["last"])
            ).otherwise(
                F.filter(cut(zone, w["first"], w["last"]), lambda s: F.size(s["dates"]) > 0)
            )
            return let(
                F.struct(cut(zone, w["lo"], w["hi"]).alias("members"), anchors.alias("anchors")), build
            )

        return F.transform(window_spans(strong, weak_only), record)

    def all_zones(kept: Column) -> Column:
        # Zone ids in order of appearance; each zone is one contiguous run.
        zone_ids = F.array_distinct(F.transform(kept, lambda s: s["zone_id"]))
        found = F.flatten(
            F.transform(
                zone_ids,
                lambda z: let(F.filter(kept, lambda s: s["zone_id"] == z), of_zone),
            )
        )
        ordered = F.transform(
            F.array_sort(
                F.transform(
                    found,
                    lambda w, i: F.struct(
                        F.coalesce(w["page_start"], F.lit(10**9)).alias("p"),
                        w["sentence_start_global_index"].alias("g"),
                        i.alias("i"),
                    ),
                )
            ),
            lambda k: k["i"],
        )
        return let(
            found,
            lambda f: F.transform(
                ordered,
                lambda i, n: F.get(f, i).withField("window_id", F.format_string("w%05d", n + 1)),
            ),
        )

    return let(allowed, all_zones)


def build_windows(
    docs: DataFrame, zone_types: Sequence[str] = RU.WINDOW_ZONES, fields: Sequence[str] = WINDOW_COLUMNS
) -> DataFrame:
    """Adds ``windows``; needs ``sentences`` with the ``cited`` flag."""
    return stage(docs, windows=windows_of(F.col("sentences"), zone_types, fields))


def drop_blacklisted(sentences: DataFrame, blacklisted: DataFrame, zone_types: Sequence[str]) -> DataFrame:
    """Long-table form of the window filter: anti join on the sentence key."""
    return sentences.filter(F.col("zone_type").isin(*zone_types)).join(
        blacklisted, ["doc_id", "sentence_id"], "left_anti"
    )


# ----------------------------------------------------------------- cleaning

def clean_sentence(col: Column) -> Column:
    """Remove service phrases, requisites and bare legal tails from a sentence."""
    def shortened(t: Column) -> Column:
        out = T.subs(t, RU.WINDOW_REMOVALS, flags="isu")
        out = T.subs(out, RU.WINDOW_LEGAL_TAILS, " ", flags="isu")
        return T.tighten_punctuation(T.squeeze(out))

    removals = T.opens(RU.WINDOW_REMOVAL_WORDS, RU.EMPTY_BRACKETS)
    out = let(
        T.window_text(col),
        lambda t: F.when(removals(t) | F.regexp_like(t, F.lit(RU.WINDOW_LEGAL_WORDS)), shortened(t)).otherwise(t),
    )
    commas = let(out, lambda t: F.when(F.contains(t, F.lit(",")), T.sub(t, r",\s*,+", ",", "u")).otherwise(t))
    return T.strip(commas, " ,;:-")


def sanitize_windows(docs: DataFrame) -> DataFrame:
    """Adds ``clean_windows``: cleaned members, windows without an anchor dropped."""

    def clean(w: Column) -> Column:
        members = F.filter(
            F.transform(w["sentences"], lambda s: s.withField("text", clean_sentence(s["text"]))),
            lambda s: s["text"] != "",
        )

        def rebuild(m: Column) -> Column:
            kept_ids = F.transform(m, lambda s: s["sentence_id"])
            anchors = F.filter(w["date_sentence_ids"], lambda i: F.array_contains(kept_ids, i))
            return (
                w.withField("sentences", m)
                .withField("sentence_ids", kept_ids)
                .withField("date_sentence_ids", anchors)
                .withField("text", _marked_text(m, lambda s: F.array_contains(anchors, s["sentence_id"])))
            )

        return let(members, rebuild)

    kept = F.filter(F.transform("windows", clean), lambda w: F.size(w["date_sentence_ids"]) > 0)
    return stage(
        docs,
        clean_windows=F.transform(kept, lambda w, i: w.withField("window_id", F.format_string("sw%05d", i + 1))),
    )


# ------------------------------------------------------------------- export

def window_rows(docs: DataFrame, column: str = "windows", fields: Sequence[str] = WINDOW_COLUMNS) -> DataFrame:
    w = F.col("w")
    return docs.select("doc_id", F.explode(column).alias("w")).select("doc_id", *[w[c].alias(c) for c in fields])


def quoted_list(arr: Column) -> Column:
    """List literal with single quotes, as the text exports print it."""
    body = F.array_join(F.transform(arr, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")
    return F.concat(F.lit("["), body, F.lit("]"))


def window_header(w: Callable[[str], Column]) -> Column:
    def shown(name: str) -> Column:
        return F.coalesce(w(name).cast("string"), F.lit("None"))

    return F.concat(
        F.lit("["), w("window_id"), F.lit("] kind="), w("kind"),
        F.lit(" zone="), w("zone_type"), F.lit(":"), w("zone_id"),
        F.lit(" pages="), shown("page_start"), F.lit("-"), shown("page_end"),
        F.lit(" sentences="), shown("sentence_start_zone_index"), F.lit("-"), shown("sentence_end_zone_index"),
        F.lit(" dates="), quoted_list(w("dates")),
        F.lit(" weak_dates="), quoted_list(w("weak_dates")),
    )


def windows_text(docs: DataFrame, column: str = "windows") -> DataFrame:
    """Compact text of all windows of a document: header line and body each."""
    blocks = F.transform(
        column, lambda w: T.strip(F.concat(window_header(lambda n: w[n]), F.lit("\n"), w["text"]))
    )
    return docs.select("doc_id", T.strip(F.array_join(blocks, "\n\n")).alias("value"))


def window_stats(windows: DataFrame) -> DataFrame:
    """Window counts per zone type."""
    return windows.groupBy("zone_type").agg(F.count(F.lit(1)).alias("windows"))


def first_windows(windows: DataFrame, limit: int = 120) -> DataFrame:
    """The first windows in document order (a top-k report)."""
    return windows.orderBy("doc_id", F.regexp_extract("window_id", r"(\d+)$", 1).try_cast("bigint"), "window_id").limit(limit)


def sanitizer_report(docs: DataFrame) -> DataFrame:
    """Windows and text length before and after cleaning, with % reduction."""
    def length(column: str) -> DataFrame:
        blocks = F.transform(
            column, lambda w: T.strip(F.concat(window_header(lambda n: w[n]), F.lit("\n"), w["text"]))
        )
        return F.length(T.strip(F.array_join(blocks, "\n\n")))

    out = docs.select(
        "doc_id",
        F.size("windows").alias("windows_before"),
        F.size("clean_windows").alias("windows_after"),
        length("windows").alias("chars_before"),
        length("clean_windows").alias("chars_after"),
    )
    return out.withColumn(
        "reduction_pct",
        F.when(F.col("chars_before") == 0, 0.0).otherwise(
            F.round((1 - F.col("chars_after") / F.col("chars_before")) * 100, 2)
        ),
    )
