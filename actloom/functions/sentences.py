"""Sentence splitting with exact offsets, all inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from actloom.functions import text as T
from actloom.functions.arrays import exclusive_running_sum, let
from actloom.lexicon import ru_acts as RU


def sentence_edge(abbreviations: tuple[str, ...] = RU.ABBREVIATIONS, extra: tuple[str, ...] = ("№",)) -> str:
    """Zero-width pattern of the places where a sentence ends.

    An end mark followed by a blank ends a sentence unless the dot belongs to an
    abbreviation or a single letter; a colon ends one at the end of a line.
    """
    known = "|".join((*abbreviations, *extra))
    # What follows is looked at first, and whether it is a letter before all: most places lie within words.
    return (
        r"(?-i:(?=[\x00-/:-@\x5b-\u03ff\u0500-\uffff]))(?=\s)"
        rf"(?:(?<=[.!?])(?<!\b(?:{known}|[А-Яа-яA-Za-z])\.)|(?<=:)(?=\n))"
    )


def split_pieces(col: Column, edge: str) -> Column:
    """Pieces that concatenate back to the input."""
    return F.split(col, T.rx(edge), -1)


def sentence_spans(text: Column, edge: str, start: Column | None = None) -> Column:
    """``array<struct<text,start_offset,end_offset>>`` of non-empty sentences."""
    base = F.lit(0) if start is None else start

    def with_offsets(pieces: Column) -> Column:
        def build(before: Column) -> Column:
            spans = F.transform(
                pieces,
                lambda p, i: let(
                    F.struct(
                        T.strip(p).alias("body"),
                        (F.length(p) - F.length(F.ltrim(p, F.lit(T.WHITESPACE)))).alias("lead"),
                    ),
                    lambda s: F.struct(
                        s["body"].alias("text"),
                        (base + F.get(before, i) + s["lead"]).alias("start_offset"),
                        (base + F.get(before, i) + s["lead"] + F.length(s["body"])).alias("end_offset"),
                    ),
                ),
            )
            return F.filter(spans, lambda s: s["text"] != "")

        return let(exclusive_running_sum(F.transform(pieces, lambda p: F.length(p))), build)

    return let(split_pieces(text, edge), with_offsets)


def sentence_texts(text: Column, edge: str) -> Column:
    """Stripped non-empty sentences without offsets (cheaper)."""
    pieces = F.transform(split_pieces(text, edge), lambda p: T.strip(p))
    return F.filter(pieces, lambda p: p != "")


_DOT = "§"


def protect_dots(col: Column) -> Column:
    """Hide dots of dates, initials and fixed abbreviations behind a sign."""
    out = T.header_text(col)
    out = F.regexp_replace(out, F.lit(r"(\d{1,2})\.(\d{1,2})\.(\d{2,4})"), F.lit(f"$1{_DOT}$2{_DOT}$3"))
    out = T.sub(out, r"\b([А-ЯЁA-Z])\.\s*([А-ЯЁA-Z])\.", f"$1{_DOT}$2{_DOT}", "u")
    for word in RU.PROTECTED_ABBREVIATIONS:
        out = T.sub(out, word.replace(".", r"\."), word.replace(".", _DOT))
    return out


def sentences_before_capitals(col: Column) -> Column:
    """Fallback splitter: after an end mark only in front of a capital letter."""
    parts = F.split(protect_dots(col), r"(?U)(?<=[.!?])\s+(?=[А-ЯЁA-Z])", -1)
    plain = F.transform(parts, lambda p: T.header_text(F.replace(p, F.lit(_DOT), F.lit("."))))
    return F.filter(plain, lambda p: p != "")
