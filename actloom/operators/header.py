"""Requisites, debtor and subject of the dispute as column jobs over a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actloom.functions import text as T
from actloom.functions.arrays import let, stage
from actloom.functions.sentences import sentences_before_capitals
from actloom.lexicon import ru_header as H

EDGE_MARKS = " ,.;:-"


def first_of(text: Column, patterns: tuple[str, ...], group: int = 1) -> Column:
    """First match of the first pattern that matches (``coalesce`` stops there)."""
    return F.coalesce(*[T.first_hit(text, p, group) for p in patterns])


def unique_clean(values: Column) -> Column:
    cleaned = F.transform(values, lambda v: T.strip(T.header_text(v), EDGE_MARKS))
    return F.array_distinct(F.filter(cleaned, lambda v: v != ""))


# --------------------------------------------------------------- requisites

def case_number(header: Column) -> Column:
    raw = T.first_hit(T.header_text(header), H.CASE_NUMBER, 0, "u")
    return F.translate(T.sub(raw, r"\s+", ""), "A", "А")


def act_date(header: Column) -> Column:
    return let(T.header_text(header), lambda t: T.header_text_or_null(first_of(t, H.ACT_DATES)))


def court_name(header: Column) -> Column:
    return F.upper(T.first_hit(T.header_text(header), H.COURT_NAME, 0))


def judges(header: Column) -> Column:
    panel = T.first_hit(T.header_text(header), H.PANEL, 1, "isu")
    return F.coalesce(unique_clean(T.hits(panel, H.JUDGE, 0, "u")), F.array().cast("array<string>"))


# ------------------------------------------------------------------- debtor

def without_technical_brackets(col: Column) -> Column:
    out = T.subs(T.header_text(col), (H.TECHNICAL_BRACKETS, H.LABELLED_IDENTIFIER, H.LABELLED_ADDRESS), " ")
    return T.header_text(out)


def org_genitive(col: Column) -> Column:
    out = T.header_text(col)
    for pattern, form in H.ORG_GENITIVE:
        out = T.sub(out, pattern, form)
    return out


def cut_org_tail(col: Column) -> Column:
    out = T.subs(without_technical_brackets(col), H.ORG_TAILS, flags="isu")
    out = T.sub(out, r"\(.*\z", "", "u")
    return T.strip(T.header_text(out), EDGE_MARKS)


def org_from_fragment(col: Column) -> Column:
    """Organisation named first in a fragment, in the genitive; NULL if none."""
    fragment = without_technical_brackets(T.before(T.header_text(col), H.ORG_FRAGMENT_END))

    def full_name(f: Column) -> Column:
        body = T.before(T.before(f, H.ORG_STOP), H.ORG_REQUISITES)
        named = cut_org_tail(T.first_hit(body, rf"({H.ORG}\s+.+)", 1, "isu"))
        name = T.strip(org_genitive(T.before(named, H.ORG_CASE_TAIL)), EDGE_MARKS)
        return F.nullif(name, F.lit(""))

    def choose(f: Column) -> Column:
        short = T.first_hit(f, rf"({H.SHORT_ORG}\s+\"[^\"]{{2,160}}\")")
        return let(
            T.before(f, H.ORG),
            lambda lead: F.when(
                ~T.has(f, H.ORG),
                F.when(short.isNotNull(), F.nullif(cut_org_tail(org_genitive(short)), F.lit(""))),
            )
            .when(F.length(T.strip(lead)) > 80, None)
            .when(T.has(lead, H.ORG_BAD_LEAD), None)
            .otherwise(full_name(f)),
        )

    return let(fragment, choose)


def _first_org(fragments: Column) -> Column:
    """First fragment that yields an organisation; later ones are not evaluated."""
    return F.aggregate(
        fragments, F.lit(None).cast("string"), lambda acc, f: F.coalesce(acc, org_from_fragment(f))
    )


def _all_fragments(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.concat(*[T.hits(text, p, 1, "isu") for p in patterns])


def debtor_name(col: Column) -> Column:
    """Debtor by formula cascade, then by the status formula, then by proceedings."""

    def last_org(fragment: Column) -> Column:
        found = T.hits(without_technical_brackets(fragment), H.LAST_ORG, 1, "isu")
        return F.when(F.size(found) > 0, F.nullif(cut_org_tail(org_genitive(F.element_at(found, -1))), F.lit("")))

    def by_status(t: Column) -> Column:
        named = F.transform(
            F.filter(sentences_before_capitals(t), lambda s: T.has(s, H.DEBTOR_STATUS)),
            lambda s: last_org(T.before(s, H.DEBTOR_STATUS)),
        )
        return F.get(F.filter(named, lambda n: n.isNotNull()), F.lit(0))

    return let(
        T.header_text(col),
        lambda t: F.coalesce(
            # Formula groups in order; later, costlier ones run only when needed.
            _first_org(_all_fragments(t, H.DEBTOR_FORMULAS[:4])),
            _first_org(_all_fragments(t, H.DEBTOR_FORMULAS[4:9])),
            _first_org(_all_fragments(t, H.DEBTOR_FORMULAS[9:])),
            by_status(t),
            _first_org(_all_fragments(t, H.DEBTOR_PROCEEDINGS)),
        ),
    )


# ------------------------------------------------------ subject of a dispute

def clean_dispute(col: Column) -> Column:
    out = T.strip(T.sub(T.header_text(col), H.COURT_LEAD))
    out = T.subs(out, H.DISPUTE_BRACKETS, " ")
    return T.strip(T.tighten_punctuation(T.squeeze(out)), EDGE_MARKS)


def cut_after_application(col: Column) -> Column:
    """Text up to where the lower courts or the grounds of the complaint begin."""
    out = T.before(clean_dispute(col), H.LOWER_COURT_START)
    return clean_dispute(T.before(out, H.COMPLAINT_GROUNDS))


def _matches(text: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    out = F.lit(True)
    for words in groups:
        out = out & T.contains_any(text, words)
    return out


def has_subject(lowered: Column) -> Column:
    out = F.lit(False)
    for rule in H.SUBJECT_RULES:
        out = out | _matches(lowered, rule)
    return out


def is_initiation_only(lowered: Column) -> Column:
    return _matches(lowered, tuple((w,) for w in H.INITIATION_WORDS)) & ~T.contains_any(
        lowered, H.INITIATION_EXCLUDED
    )


def is_forbidden(text: Column) -> Column:
    talk = T.has(text, H.LOWER_COURT_RESULT) | T.has(text, H.COMPLAINT_TALK)
    return T.has(text, H.ACT_LEAD) | (talk & ~T.has(text, H.FILED))


def looks_like_application(text: Column) -> Column:
    def test(s: Column) -> Column:
        low = s["low"]
        marker = T.contains_any(low, H.APPLICATION_WORDS) | _matches(low, (("о включении",), ("требован",)))
        return (
            marker
            & has_subject(low)
            & ~is_initiation_only(low)
            & ~T.has(s["t"], H.ACT_WORD)
            & ~is_forbidden(s["t"])
            & ~(T.has(s["t"], H.RESULT_PHRASE) & ~T.has(s["t"], H.FILED_LOOSE))
            & ~T.has(s["t"], H.PARTIAL_APPLICATION)
        )

    return let(
        let(T.header_text(text), lambda t: F.struct(t.alias("t"), F.lower(t).alias("low"))), test
    )


def _applications(raw: Column) -> Column:
    cut = F.transform(raw, cut_after_application)
    return unique_clean(F.filter(cut, looks_like_application))


def header_candidates(col: Column) -> Column:
    return let(T.header_text(col), lambda t: _applications(_all_fragments(t, H.HEADER_DISPUTES)))


def text_candidates(col: Column) -> Column:
    return let(
        T.header_text(col),
        lambda t: _applications(
            F.concat(_all_fragments(t, H.APPLICATIONS), sentences_before_capitals(t))
        ),
    )


def candidate_score(text: Column, source: Column) -> Column:
    """Ranking score of a candidate (optional; selection goes by source priority)."""
    weight = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for kv in H.SOURCE_WEIGHTS.items() for x in kv]), source), F.lit(0)
    )
    low = F.lower(T.header_text(text))
    score = weight
    for points, groups in H.SCORE_RULES:
        score = score + F.when(_matches(low, groups), points).otherwise(0)
    length = F.length(text)
    for points, cond in (
        (2, T.has(low, r"\d[\d\s]*[,.]?\d*\s*(?:руб|рублей)")),
        (-12, T.has(text, H.ACT_WORD)),
        (-6, T.has(text, r"^\s*в\s+лице\b")),
        (4, T.has(text, rf"^\s*(?:{H.ORG}|[А-ЯЁ][а-яё]+\s+[А-ЯЁ]\.?\s*[А-ЯЁ]\.?)")),
        (-4, length > 900),
        (-10, length > 1400),
    ):
        score = score + F.when(cond, points).otherwise(0)
    return score


def dispute_context(
    header: Column,
    history: Column,
    party: Column,
    reasoning: Column,
    *,
    limit: int | None = None,
    compat_party_cut: bool = False,
) -> Column:
    """Best candidate by source priority, cleaned; with ``limit`` cut at a word.

    ``compat_party_cut=True`` leaves the party text uncut before the search.
    """

    def cut_party(t: Column) -> Column:
        return t if compat_party_cut else T.strip(T.before(t, H.PARTY_CUT))

    def first_allowed(candidates: Column) -> Column:
        return F.get(F.filter(candidates, lambda c: ~is_forbidden(c)), F.lit(0))

    head = T.header_text(reasoning)
    selected = F.coalesce(
        first_allowed(header_candidates(header)),
        first_allowed(text_candidates(history)),
        first_allowed(text_candidates(cut_party(T.header_text(party)))),
        first_allowed(text_candidates(head)),
        T.first_hit(T.header_text(F.concat_ws(" ", header, history)), H.LAWSUIT, 1, "isu"),
    )
    return let(
        clean_dispute(selected), lambda t: F.nullif(t if limit is None else T.word_cut(t, limit), F.lit(""))
    )


def candidate_rows(parts: DataFrame) -> DataFrame:
    """Every candidate for the subject of a dispute, one row each: ``doc_id, source, place, text, allowed, score``.

    ``parts`` holds the zone texts ``h, ph, pp, cr``; sources come in their order of priority, places in the order of
    the patterns.
    """
    found = {
        "header": header_candidates(F.col("h")), "procedural_history": text_candidates(F.col("ph")),
        "party_position": text_candidates(T.strip(T.before(T.header_text(F.col("pp")), H.PARTY_CUT))),
        "court_reasoning_head": text_candidates(F.col("cr")),
    }

    def listed(rank: int, name: str) -> Column:
        entry = lambda t, i: F.struct(F.lit(name).alias("source"), F.lit(rank).alias("rank"), i.alias("place"), t.alias("text"))
        return F.transform(found[name], entry)

    every = F.concat(*[listed(rank, name) for rank, name in enumerate(H.SOURCE_PRIORITY)])
    rows = parts.select("doc_id", F.inline(every))
    return rows.withColumns({"allowed": ~is_forbidden(F.col("text")), "score": candidate_score(F.col("text"), F.col("source"))})


def best_candidates(rows: DataFrame) -> DataFrame:
    """The allowed candidate of the highest score; of equal ones the first by source and place."""
    order = F.struct((-F.col("score")).alias("s"), "rank", "place")
    return rows.filter("allowed").groupBy("doc_id").agg(F.min_by(F.struct("source", "text", "score"), order).alias("b")).select("doc_id", "b.*")


# ----------------------------------------------------------------- documents

def zone_text(zones: Column, zone_type: str) -> Column:
    """Text of the first zone of a type, empty if there is none."""
    return T.text_or_empty(F.get(F.filter(zones, lambda z: z["zone_type"] == zone_type), F.lit(0))["text"])


def has_header(docs: DataFrame) -> Column:
    return F.exists("zones", lambda z: (z["zone_type"] == "header") & (z["text"] != ""))


def quarantine(docs: DataFrame) -> DataFrame:
    """Documents without a header zone; they have no requisites to read."""
    return docs.filter(~has_header(docs)).select("doc_id", F.lit("header_zone_missing").alias("reason"))


def zone_parts(docs: DataFrame) -> DataFrame:
    """``doc_id, zones`` and the texts of the four zones that requisites are read from."""
    kinds = (("header", "h"), ("procedural_history", "ph"), ("party_position", "pp"), ("court_reasoning", "cr"))
    return stage(
        docs.filter(has_header(docs)).select("doc_id", "zones"),
        **{name: T.header_text(zone_text(F.col("zones"), kind)) for kind, name in kinds},
    )


def case_header(docs: DataFrame) -> DataFrame:
    """One row of requisites per document with a header zone, from whole zones; map-only."""
    parts = zone_parts(docs)
    h = F.col("h")
    return parts.select(
        "doc_id",
        case_number(h).alias("case_number"),
        act_date(h).alias("act_date"),
        court_name(h).alias("court_name"),
        judges(h).alias("judges"),
        F.coalesce(
            debtor_name(F.concat_ws(" ", "h", "ph", "cr")), debtor_name(h)
        ).alias("debtor_name"),
        dispute_context(h, F.col("ph"), F.col("pp"), F.col("cr")).alias("dispute_context"),
    )
