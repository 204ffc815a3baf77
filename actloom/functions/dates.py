"""Date mentions in text: strong dates, year-only mentions and sortable keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from actloom.functions import text as T
from actloom.functions.arrays import let


@dataclass(frozen=True)
class DateLexicon:
    """Month words in calendar order and the words that follow a bare year."""

    months: tuple[str, ...]
    year_words: str
    year_tail: str

    @property
    def numeric(self) -> str:
        return r"(?<!\d)(0?[1-9]|[12]\d|3[01])[./-](0?[1-9]|1[0-2])[./-](\d{4}|\d{2})(?!\d)"

    @property
    def worded(self) -> str:
        names = "|".join(self.months)
        return rf"(?<!\d)(0?[1-9]|[12]\d|3[01])\s+({names})\s+(\d{{4}}){self.year_tail}"

    @property
    def year_only(self) -> str:
        return rf"\b(19\d{{2}}|20\d{{2}})\s*{self.year_words}"


def strong_dates(col: Column, lex: DateLexicon) -> Column:
    """Numeric dates in text order, then day-month-name dates."""
    found = F.concat(T.hits(col, lex.numeric, 0, "u"), T.hits(col, lex.worded))
    return F.when(F.regexp_like(col, F.lit(r"[0-9[\u0660-\x{10ffff}&&\p{Nd}]]")), found).when(col.isNotNull(), F.array().cast("array<string>"))


def weak_dates(col: Column, lex: DateLexicon, strong: Column | None = None) -> Column:
    """Year mentions, only where the text has no strong date."""
    strong = strong_dates(col, lex) if strong is None else strong
    open_ = (F.size(strong) == 0) & T.contains_any(col, ("19", "20"))
    return F.when(open_, T.hits(col, lex.year_only)).otherwise(
        F.array().cast("array<string>")
    )


def sort_key(col: Column, lex: DateLexicon) -> Column:
    """``YYYY-MM-DD``; ``YYYY-00-00`` for a bare year; ``9999-99-99`` otherwise."""
    month_no = F.create_map(
        *[F.lit(x) for i, m in enumerate(lex.months, 1) for x in (T_fold(m), f"{i:02d}")]
    )

    def build(raw: Column) -> Column:
        def numeric(p: str) -> Column:
            day, month, year = (F.regexp_extract(raw, T.rx(p, "u"), g) for g in (1, 2, 3))
            full = F.when(F.length(year) == 4, year).otherwise(
                F.concat(F.when(year.cast("int") < 50, "20").otherwise("19"), year)
            )
            return F.concat_ws("-", full, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))

        def worded(p: str) -> Column:
            day, month, year = (F.regexp_extract(raw, T.rx(p), g) for g in (1, 2, 3))
            return F.concat_ws("-", year, F.element_at(month_no, F.lower(month)), F.lpad(day, 2, "0"))

        year = F.regexp_extract(raw, T.rx(lex.year_only), 1)
        return (
            F.when(T.has(raw, lex.numeric, "u"), numeric(lex.numeric))
            .when(T.has(raw, lex.worded), worded(lex.worded))
            .when(year != "", F.concat(year, F.lit("-00-00")))
            .otherwise("9999-99-99")
        )

    return let(T.fold_case(T.one_line(col)), build)


def T_fold(word: str) -> str:
    return word.lower().replace("ё", "е")
