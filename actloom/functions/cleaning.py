"""Page and document cleaning as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from actloom.functions import text as T
from actloom.functions.arrays import let, runs
from actloom.lexicon import ru_acts as RU


def basic_chars(col: Column) -> Column:
    """Unify line ends, blanks, ligatures, dashes and quotes; drop invisible marks."""
    src = "\v\f  " + T.NBSP + T.NNBSP + T.FIGSP + "‐‒–—−" + "«»“”„" + T.ZERO_WIDTH + "￾�"

    def unified(t: Column) -> Column:
        out = F.regexp_replace(t, F.lit("\r\n?"), F.lit("\n"))
        out = F.translate(out, src, "\n\n\n\n" + "   " + "-----" + '"""""')
        return F.replace(F.replace(out, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))

    return _guarded(T.text_or_empty(col), lambda t: T.may_hold(t, "\r" + src + "ﬁﬂ"), unified)


def _guarded(col: Column, needed: Callable[[Column], Column], clean: Callable[[Column], Column]) -> Column:
    """Run a chain of patterns only where a cheap necessary condition holds.

    Most texts hold no contact, address or identifier at all; one scan instead of
    one per pattern keeps cleaning affordable.
    """
    return let(col, lambda t: F.when(needed(t), clean(t)).otherwise(t))


_REQUISITE_WORDS = "|".join((RU.CONTACT_WORDS, RU.ADDRESS_WORDS, RU.STREETS, RU.IDENTIFIER_WORDS))
_REQUISITE_SIGNS = f"{RU.CONTACT_SIGNS}|{RU.EMPTY_BRACKETS}"


def requisites(col: Column) -> Column:
    """Remove contacts, addresses and identifiers; one scan where there are none."""
    return _guarded(
        col,
        T.opens(_REQUISITE_WORDS, _REQUISITE_SIGNS),
        lambda t: identifiers(addresses(contacts(t))),
    )


def contacts(col: Column) -> Column:
    """Remove links, e-mail addresses, phones and contact labels left empty."""
    return _guarded(col, T.opens(RU.CONTACT_WORDS, RU.CONTACT_SIGNS), lambda t: T.subs(t, RU.CONTACT_PATTERNS))


def addresses(col: Column) -> Column:
    out = _guarded(
        col, T.opens(RU.ADDRESS_WORDS),
        lambda t: T.subs(t, (RU.ADDRESS_TO_IDENTIFIER, RU.ADDRESS_TO_SAFE_STOP), flags="isu"),
    )
    return _guarded(out, T.opens(RU.STREETS), lambda t: T.sub(t, RU.ADDRESS_LINE, flags="imu"))


def identifiers(col: Column) -> Column:
    return _guarded(col, T.opens(RU.IDENTIFIER_WORDS, RU.EMPTY_BRACKETS), lambda t: T.subs(t, RU.IDENTIFIER_PATTERNS))


def page_number_lines(col: Column) -> Column:
    """Lines that only hold a page number."""
    return _page_numbers(col)


def _page_numbers(col: Column) -> Column:
    # Shapes with dashes, the longer word or a slash need these.
    needed = (None, "-", None, "[цЦ][аА]", "/")
    for pattern, sign in zip(RU.PAGE_NUMBER_LINES, needed):
        test = lambda t, s=sign: F.lit(True) if s is None else F.contains(t, F.lit(s)) if len(s) == 1 else F.regexp_like(t, F.lit(s))
        col = _guarded(col, test, lambda t, p=pattern: T.sub(t, p, flags="imu"))
    return col


def first_page_lines(col: Column, is_first: Column) -> Column:
    return let(col, lambda t: F.when(is_first, T.subs(t, RU.FIRST_PAGE_LINES, flags="imu")).otherwise(t))


def service_lines(col: Column) -> Column:
    return _guarded(col, T.opens(RU.SERVICE_WORDS, RU.SERVICE_SIGNS), lambda t: T.subs(t, RU.SERVICE_LINES, flags="imu"))


def boilerplate(col: Column) -> Column:
    """Remove procedural spans, the appeal notice and the signature block."""
    return _guarded(
        col,
        lambda t: F.regexp_like(
            t, F.lit(r"[пП](?iu:рисутствующий|остановление[\p{Z}\s]+вступает|оскольку[\p{Z}\s]+нарушений"
                     r"|редседательствующий)|[сС](?iu:огласно[\p{Z}\s]+части)|[иИ](?iu:ные[\p{Z}\s]+доводы)")
        ),
        lambda t: T.subs(
            t, (*RU.BOILERPLATE_SPANS, RU.SIGNATURE_NAME, RU.SIGNATURE_BLOCK), flags="isu"
        ),
    )


def join_hyphens(col: Column) -> Column:
    return _guarded(col, lambda t: F.contains(t, F.lit("-")) & F.regexp_like(t, F.lit(r"(?U)-\s*\n")), _join_hyphens)


def _join_hyphens(col: Column) -> Column:
    return T.sub(col, r"([А-Яа-яЁёA-Za-z])-\s*\n\s*([А-Яа-яЁёA-Za-z])", "$1$2", "u")


# ------------------------------------------------------------ case number

def normalize_case_number(col: Column) -> Column:
    return F.translate(F.upper(T.sub(col, r"\s+", "")), "A", "А")


def main_case_number(first_page: Column) -> Column:
    return normalize_case_number(T.first_hit(first_page, RU.CASE_NUMBER_LABELLED))


def running_header_lines(col: Column, case_number: Column) -> Column:
    """Drop lines that only repeat the case number.

    A bare case number stays when the last kept non-blank line ends with
    "дело №". A dropped line never becomes that predecessor; a kept bare number
    does, and it never ends with "дело №". So the predecessor of a bare number is
    the nearest earlier non-blank line that is not itself a dropped header line.
    """

    def scan(lines: Column, wanted: Column) -> Column:
        def kind(flat: Column) -> Column:
            return (
                F.when(flat == wanted, F.lit("bare"))
                .when(
                    F.endswith(flat, wanted)
                    & F.regexp_like(F.left(flat, F.length(flat) - F.length(wanted)), F.lit(r"(?U)^\d{1,4}\s+$")),
                    F.lit("numbered"),
                )
                .when(flat == "", F.lit("blank"))
                .when(F.contains(flat, F.lit("№")) & T.has(flat, r"\bдело\s*№\s*$"), F.lit("label"))
                .otherwise(F.lit("text"))
            )

        def keep(kinds: Column) -> Column:
            # Candidates for "previous": text and label lines. A bare line is kept
            # exactly when the closest candidate before it is a label and no other
            # bare line was kept in between.
            state = F.aggregate(
                kinds,
                F.struct(F.lit("text").alias("prev"), F.lit("").alias("flags")),
                lambda acc, k: F.struct(
                    F.when(k.isin("text", "label"), k)
                    .when((k == "bare") & (acc["prev"] == "label"), F.lit("text"))
                    .otherwise(acc["prev"])
                    .alias("prev"),
                    F.concat(
                        acc["flags"],
                        F.when(
                            (k == "numbered") | ((k == "bare") & (acc["prev"] != "label")), F.lit("0")
                        ).otherwise(F.lit("1")),
                    ).alias("flags"),
                ),
            )
            return state["flags"]

        def kept(kinds: Column) -> Column:
            return let(
                keep(kinds),
                lambda flags: F.array_join(
                    F.filter(lines, lambda _l, i: F.substring(flags, i + 1, F.lit(1)) == "1"), "\n"
                ),
            )

        # Only a line that ends with the number can go.
        return let(
            F.transform(lines, lambda l: F.lower(T.strip(l))),
            lambda flat: F.when(F.exists(flat, lambda f: F.endswith(f, wanted)), kept(F.transform(flat, kind))).otherwise(
                F.array_join(lines, "\n")
            ),
        )

    return let(
        F.struct(col.alias("t"), case_number.alias("n")),
        lambda x: F.when(
            # The part after the letter has no case, so no lowering of the whole text is needed.
            x["n"].isNull() | (x["n"] == "") | ~F.contains(x["t"], F.substr(x["n"], F.lit(2))), x["t"]
        ).otherwise(let(F.split(x["t"], "\n"), lambda lines: let(F.lower(x["n"]), lambda n: scan(lines, n)))),
    )


# -------------------------------------------------------- tables, paragraphs

#: All columns need a tab, a bar, two blanks or five numbers; digits other than 0 to 9 lie behind U+065F.
_MAY_BE_TABLE = r"[\t|\u0660-\x{10ffff}]|  |[0-9](?:[^0-9]++[0-9]++){4}"
#: A stripped line that is a heading or like a table matches; the first part holds how all headings begin.
_HEADINGS = r"(?iuU:у\s*с|с\s*у|р\s*е|п\s*о\s*с|о\s*п|вв|мо)"
_MAY_STAND_ALONE = rf"\A{_HEADINGS}|" + _MAY_BE_TABLE
_LINE_START = r"(?:\A|\n)[" + T.WHITESPACE.replace("\n", "") + "]*+"
#: A text with such a line, or with an empty one, matches.
_MAY_HOLD_ALONE = rf"{_LINE_START}(?:{_HEADINGS}|\n|\z)|" + _MAY_BE_TABLE.replace("[^0-9]", r"[^0-9\n]")


def is_table_like(line: Column) -> Column:
    def test(s: Column) -> Column:
        prose = (F.length(s) > 80) & T.has(s, "[а-яёa-z]{3,}")
        columns = (
            (F.regexp_count(s, F.lit(" {2,}")) >= 3)
            | F.contains(s, F.lit("\t"))
            | F.contains(s, F.lit(" | "))
            | (F.regexp_count(s, F.lit(r"\d{1,2}\.\d{1,2}\.\d{2,4}")) >= 2)
            | ((F.length(s) < 120) & (F.regexp_count(s, F.lit(r"(?U)(?=\d)\b\d[\d\s.,/-]*\b")) >= 5))
        )
        return (s != "") & ~prose & F.regexp_like(s, F.lit(_MAY_BE_TABLE)) & columns

    return let(T.strip(line), test)


def restore_paragraphs(col: Column) -> Column:
    """Join ordinary lines; blank, heading and table-like lines stand alone."""

    def build(lines: Column) -> Column:
        alone = F.transform(
            lines, lambda l: (l == "") | T.has(l, RU.HEADING_LINE) | is_table_like(l)
        )

        def join_runs(solo: Column) -> Column:
            starts = F.filter(
                F.transform(lines, lambda _l, i: i),
                lambda i: (i == 0) | F.get(solo, i) | F.coalesce(F.get(solo, i - 1), F.lit(False)),
            )
            return F.array_join(
                F.transform(
                    runs(starts, F.size(lines)),
                    lambda r: F.array_join(F.slice(lines, r["lo"] + 1, r["hi"] - r["lo"] + 1), " "),
                ),
                "\n",
            )

        return F.when(
            F.exists(lines, lambda l: (l == "") | F.regexp_like(l, F.lit(_MAY_STAND_ALONE))), let(alone, join_runs)
        ).otherwise(F.array_join(lines, " "))

    def stripped(t: Column) -> Column:
        return F.transform(F.split(t, "\n"), lambda l: T.strip(l))

    def parted(t: Column) -> Column:
        text = F.regexp_replace(t, F.lit(r"(?U)\n\s*\n+"), F.lit("\n\n"))
        # A trailing newline ends the last line, it does not open an empty one.
        text = let(text, lambda x: F.when(F.endswith(x, F.lit("\n")), F.regexp_replace(x, F.lit(r"\n\z"), F.lit(""))).otherwise(x))
        return let(stripped(text), build)

    def checked(t: Column, body: Column) -> Column:
        # Ordinary lines only: one run. No line of a page that can't hold what stands alone needs a look by itself.
        return let(
            body, lambda b: F.when(F.regexp_like(b, F.lit(_MAY_HOLD_ALONE)), parted(t)).otherwise(F.array_join(stripped(b), " "))
        )

    return let(col, lambda t: checked(t, F.when(F.endswith(t, F.lit("\n")), F.left(t, F.length(t) - 1)).otherwise(t)))


def repair_breaks(col: Column) -> Column:
    """Mend numbers split by blanks, glued words and quotes after a legal form."""
    def numbers(t: Column) -> Column:
        out = T.sub(t, r"([АA]\d{1,4})\s*-\s*(\d+/\d{2,4})", "$1-$2", "u")
        out = T.sub(out, r"(\d+)\s*-\s*([А-ЯЁA-Z]{1,4}\d+)", "$1-$2", "u")
        return T.sub(out, r"([A-Za-zА-Яа-яЁё0-9]+/\d+)\s*-\s*(\d+)", "$1-$2", "u")

    # Without white space beside a dash the passes put back what they find.
    out = _guarded(col, lambda t: F.contains(t, F.lit("-")) & F.regexp_like(t, F.lit(r"(?U)-(?:\s|(?<=\s-))")), numbers)
    out = F.replace(out, F.lit("счетафактуры"), F.lit(RU.GLUED_WORDS["счетафактуры"]))
    return _guarded(
        out,
        lambda t: F.contains(t, F.lit('"')) & (F.contains(t, F.lit("АО")) | F.contains(t, F.lit("ООО"))),
        lambda t: T.sub(t, r'\b(ООО|АО|ПАО|ЗАО)\s+([А-ЯЁA-Z][^"\n]{1,80})"', '$1 "$2"', "u"),
    )


def final_form(col: Column, case_number: Column) -> Column:
    """Last pass: noise again, then blanks, punctuation, quotes and empty lines."""
    out = repair_breaks(requisites(col))
    out = running_header_lines(out, case_number)
    return T.strip(let(out, lambda t: F.when(F.regexp_like(t, F.lit(_UNTIDY)), _tidy(t)).otherwise(_unglued(t))))


#: What the passes of ``_tidy`` need, but for the glued words.
_UNTIDY = (
    r"(?U)(?=[\x00-/:-@\x5b-\u03ff\u0500-\uffff])(?:[\t\"(]|  |(?=\s)(?:\s[,.!?;:]|\n\n)|(?=[,.!?;:])(?:.[А-Яа-яЁёA-Za-z]|,\s*,))"
)


def _unglued(out: Column) -> Column:
    for glued in ("информационнотелекоммуникационной", "гражданскоправовой"):
        out = F.replace(out, F.lit(glued), F.lit(RU.GLUED_WORDS[glued]))
    return out


def _tidy(col: Column) -> Column:
    out = T.tighten_punctuation(T.one_blank(col))
    out = _unglued(F.regexp_replace(out, F.lit("([,.!?;:])([А-Яа-яЁёA-Za-z])"), F.lit("$1 $2")))

    def quotes(t: Column) -> Column:
        for pattern, replacement in ((r'"\s+', '" '), (r'\s+"', ' "'), (r'"\s+([,.;:)])', '"$1')):
            t = T.sub(t, pattern, replacement, "u")
        return t

    out = _guarded(out, lambda t: F.contains(t, F.lit('"')), quotes)
    out = F.regexp_replace(out, F.lit(r"(?U),\s*,+"), F.lit(","))
    out = _guarded(
        out, lambda t: F.contains(t, F.lit("(")), lambda t: T.sub(t, r"\(\s*,?\s*\)", "", "u")
    )
    return F.regexp_replace(T.two_newlines(out), F.lit(" *\n\n *"), F.lit("\n\n"))


def clean_page(col: Column, is_first: Column, case_number: Column) -> Column:
    out = running_header_lines(basic_chars(col), case_number)
    out = first_page_lines(page_number_lines(out), is_first)
    # One scan for both: where neither has anything to remove, the text is the same for the second.
    out = _guarded(
        out, T.opens(f"{_REQUISITE_WORDS}|{RU.SERVICE_WORDS}", f"{_REQUISITE_SIGNS}|{RU.SERVICE_SIGNS}"),
        lambda t: service_lines(requisites(t)),
    )
    return final_form(restore_paragraphs(join_hyphens(out)), case_number)


def clean_document(col: Column, case_number: Column) -> Column:
    return final_form(boilerplate(col), case_number)


# ------------------------------------------------------------------- tables

def clean_cell(col: Column) -> Column:
    return T.strip(T.squeeze(T.text_or_empty(col)))


def format_table(rows: Column) -> Column:
    """``array<array<string>>`` to lines of ``a | b``; empty cells and rows vanish."""
    lines = F.transform(
        rows, lambda row: F.array_join(F.filter(F.transform(row, clean_cell), lambda c: c != ""), " | ")
    )
    return T.strip(F.array_join(F.filter(lines, lambda l: l != ""), "\n"))


def table_block(body: Column) -> Column:
    """Wrap a rendered table in marker lines; empty tables give an empty text."""
    return let(
        T.keep_content(body),
        lambda b: F.when(b != "", F.concat(F.lit("[[TABLE]]\n"), b, F.lit("\n[[/TABLE]]"))).otherwise(""),
    )


def table_rows_block(rows: Column) -> Column:
    """Block of a raw ``array<array<string>>`` table; null cells stay empty."""
    lines = F.transform(
        rows, lambda row: F.array_join(F.transform(row, lambda c: T.text_or_empty(c)), " | ")
    )
    return table_block(F.array_join(lines, "\n"))
