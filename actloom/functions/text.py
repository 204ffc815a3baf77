"""Text normalisation as Column expressions (JVM only, no UDF)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from actloom.functions.arrays import let

# Characters that Unicode-aware strip removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)

# No-break, narrow no-break and figure space; zero-width space and byte-order mark.
NBSP, NNBSP, FIGSP = "\xa0", "\u202f", "\u2007"
ZERO_WIDTH = "\u200b\ufeff"


def rx(pattern: str, flags: str = "iu") -> str:
    """Java pattern with Unicode ``\\b \\w \\s`` (``U``), ``\\n`` as only line end (``d``), plus ``flags``."""
    return f"(?{flags}Ud){pattern}"


def spaced(word: str) -> str:
    """Pattern for a word whose letters may be spread out by blanks."""
    return r"\s*".join(word)


def strip(col: Column, chars: str = WHITESPACE) -> Column:
    """``btrim``; the right end is only trimmed where there is something, as that reads the whole text character by
    character. A sentence is told by its dot."""

    def right(t: Column) -> Column:
        loose = F.contains(F.lit(chars), F.right(t, F.lit(1)))
        if "." not in chars:
            loose = ~F.endswith(t, F.lit(".")) & loose
        return F.when(loose, F.rtrim(t, F.lit(chars))).otherwise(t)

    return let(F.ltrim(col, F.lit(chars)), right)


def rstrip(col: Column, chars: str = WHITESPACE) -> Column:
    return F.rtrim(col, F.lit(chars))


def sub(col: Column, pattern: str, replacement: str = "", flags: str = "iu") -> Column:
    return F.regexp_replace(col, F.lit(rx(pattern, flags)), F.lit(replacement))


def subs(col: Column, patterns: Iterable[str], replacement: str = "", flags: str = "iu") -> Column:
    for pattern in patterns:
        col = sub(col, pattern, replacement, flags)
    return col


def has(col: Column, pattern: str, flags: str = "iu") -> Column:
    return F.regexp_like(col, F.lit(rx(pattern, flags)))


def hits(col: Column, pattern: str, group: int = 0, flags: str = "iu") -> Column:
    return F.regexp_extract_all(col, F.lit(rx(pattern, flags)), F.lit(group))


def first_hit(col: Column, pattern: str, group: int = 1, flags: str = "iu") -> Column:
    """First match of a group, NULL when the pattern does not match."""
    return F.get(hits(col, pattern, group, flags), F.lit(0))


def before(col: Column, pattern: str, flags: str = "iu") -> Column:
    """Text in front of the first match (the whole text if there is none)."""
    return F.get(F.split(col, rx(pattern, flags), 2), F.lit(0))


def contains_any(col: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(col, F.lit(word))
    return out


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


# ------------------------------------------------------------- normalisers
#
# Most texts hold nothing to normalise. A pattern that only matches what would change leaves them alone, and a
# test for a necessary condition is much cheaper than the passes behind it.

#: The characters of ``(?U)\\s`` other than the blank, for character classes.
_OTHER_BLANKS = r"\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same characters one by one.
BLANKS = "".join(c for c in WHITESPACE if c != " " and not "\x1c" <= c <= "\x1f")


def when_like(col: Column, needed: str, change: Callable[[Column], Column]) -> Column:
    """``change`` of the texts that match a pattern, the others as they are."""
    return let(col, lambda t: F.when(F.regexp_like(t, F.lit(needed)), change(t)).otherwise(t))


#: Everything but the Cyrillic block. In front of ``&&`` it spares most characters of an act the tests behind it.
_ELSEWHERE = r"\x00-\u03ff\u0500-\uffff"


def may_hold(col: Column, chars: str) -> Column:
    """Necessary condition for texts that hold one of the characters: the first bytes of their UTF-8 form are looked for.

    ``contains`` compares bytes, so one needle stands for all characters of a block; no decoding, no pattern.
    """
    needles = dict.fromkeys(c.encode()[: 2 if ord(c) > 0x7FF else 1] for c in chars)
    out = F.lit(False)
    for needle in needles:
        out = out | F.contains(col, F.lit(needle).cast("string"))
    return out


#: Letters outside the usual range that equal a Cyrillic one when case is ignored.
_ODD_LETTERS = r"\u1c80-\u1c88"


def opens(words: str = "", signs: str = "") -> Callable[[Column], Column]:
    """Test for words, none of which follows a Cyrillic letter, or for signs.

    Most characters of an act are letters within a word, and two range tests pass over them. The words are an
    alternation whose first letters are Cyrillic and given in both cases; an odd letter in that place counts as a
    word. The signs are a pattern that begins with a class of ASCII characters, which is one look in a table.
    """
    pattern = rf"[\x00-\u040f\u0450-\uffff](?=[А-я{_ODD_LETTERS}])(?:{words}|[{_ODD_LETTERS}])"
    if not words:
        return lambda t: F.regexp_like(t, F.lit(signs))
    # One pass for both.
    both = f"{pattern}|{signs}" if signs else pattern
    return lambda t: F.regexp_like(F.concat(F.lit("\n"), t), F.lit(both))


def translated(col: Column, src: str, dst: str) -> Column:
    """``translate`` of the texts that may hold one of the characters."""
    return let(col, lambda t: F.when(may_hold(t, src), F.translate(t, src, dst)).otherwise(t))


def squeeze(col: Column) -> Column:
    """Every run of white space becomes one blank; single blanks don't match."""
    white = rf"[{_ELSEWHERE}&&[ {_OTHER_BLANKS}]]"
    return let(col, lambda t: F.when(
        F.contains(t, F.lit("  ")) | may_hold(t, BLANKS), F.regexp_replace(t, F.lit(rf"{white}(?:(?<! )|(?={white})){white}*"), F.lit(" "))
    ).otherwise(t))


def one_blank(col: Column) -> Column:
    """Every run of blanks and tabs becomes one blank."""
    return let(col, lambda t: F.when(
        F.contains(t, F.lit("  ")) | F.contains(t, F.lit("\t")), F.regexp_replace(t, F.lit("[ \t]{2,}|\t"), F.lit(" "))
    ).otherwise(t))


def two_newlines(col: Column) -> Column:
    """At most two line ends in a row."""
    return let(col, lambda t: F.when(
        F.contains(t, F.lit("\n\n\n")), F.regexp_replace(t, F.lit("\n{3,}"), F.lit("\n\n"))
    ).otherwise(t))


def tighten_punctuation(col: Column, marks: str = ",.!?;:") -> Column:
    return F.regexp_replace(col, F.lit(rf"(?U)\s+([{marks}])"), F.lit("$1"))


def normalize(
    col: Column,
    *,
    blanks: str = NBSP + NNBSP,
    invisible: str = "",
    quotes: str = "«»",
    dashes: str = "–—−",
    collapse: str = "all",
    punctuation: bool = False,
    fold: bool = False,
) -> Column:
    """One parameterised normaliser for every stage.

    ``collapse``: ``all`` turns any whitespace run into a blank, ``inline`` only
    blanks and tabs (and limits empty lines to one), ``none`` leaves it.
    """
    src = blanks + quotes + dashes + invisible
    dst = " " * len(blanks) + '"' * len(quotes) + "-" * len(dashes)
    out = translated(text_or_empty(col), src, dst)
    if collapse == "all":
        out = squeeze(out)
    elif collapse == "inline":
        out = two_newlines(one_blank(out))
    if punctuation:
        out = tighten_punctuation(out)
    out = strip(out)
    return fold_case(out) if fold else out


def fold_case(col: Column) -> Column:
    return F.replace(F.lower(col), F.lit("ё"), F.lit("е"))


def keep_content(col: Column) -> Column:
    """Unify line ends and blanks, cut line tails, drop outer newlines."""

    def unified(t: Column) -> Column:
        out = F.regexp_replace(t, F.lit("\r\n?"), F.lit("\n"))
        out = F.translate(out, NBSP + NNBSP + FIGSP + ZERO_WIDTH, "   ")
        out = F.regexp_replace(out, F.lit(r"(?U)[\s&&[^\n]]+(?=\n|\z)"), F.lit(""))
        return strip(out, "\n")

    # What a change needs: an odd character, a blank in front of a line end, white space at the end, a first newline.
    odd = "".join(c for c in WHITESPACE if c not in " \t\n\x0b\x0c") + ZERO_WIDTH

    def needed(t: Column) -> Column:
        tails = contains_any(t, (" \n", "\t\n", "\x0b\n", "\x0c\n")) | F.contains(F.lit(WHITESPACE), F.right(t, F.lit(1)))
        return may_hold(t, odd) | tails | F.startswith(t, F.lit("\n"))

    return let(text_or_empty(col), lambda t: F.when(needed(t), unified(t)).otherwise(t))


def match_text(col: Column, *, blank_numbers: bool = False) -> Column:
    """Lower-case text for marker search; optionally blank lone 1-4 digit numbers."""
    def blanked(t: Column) -> Column:
        return one_blank(F.regexp_replace(t, F.lit(r"(?U)(?=\d)(?<=\s)\d{1,4}(?=\s)"), F.lit(" ")))

    out = one_blank(fold_case(keep_content(col)))
    if blank_numbers:
        out = when_like(out, r"(?U)(?=\s)\s\d{1,4}\s", blanked)
    return strip(two_newlines(out))


def one_line(col: Column) -> Column:
    """``keep_content`` on one line: of its changes only the loss of invisible marks outlasts the squeeze."""
    seen = let(text_or_empty(col), lambda t: F.when(contains_any(t, ZERO_WIDTH), F.translate(t, ZERO_WIDTH, "")).otherwise(t))
    return strip(squeeze(seen))


def reference_text(col: Column) -> Column:
    return normalize(col, blanks=NBSP)


def window_text(col: Column) -> Column:
    return normalize(col, blanks=NBSP, punctuation=True)


def card_text(col: Column) -> Column:
    return normalize(col, collapse="inline")


def audit_text(col: Column) -> Column:
    return normalize(col)


#: Characters that the audit's normaliser leaves alone, the blank included.
_SETTLED = r"\A[ -@\[-~а-я]*+\z"


def audit_key(col: Column) -> Column:
    return let(col, column_key)


def column_key(t: Column) -> Column:
    """``audit_key`` of a column. Most values are words of a closed list, their own keys already; one look tells it."""
    loose = F.startswith(t, F.lit(" ")) | F.endswith(t, F.lit(" ")) | F.contains(t, F.lit("  "))
    return F.when(F.regexp_like(t, F.lit(_SETTLED)) & ~loose, t).otherwise(normalize(t, fold=True))


def is_blank(col: Column) -> Column:
    """NULL, or nothing but white space."""
    return F.ltrim(text_or_empty(col), F.lit(WHITESPACE)) == ""


def search_key(col: Column) -> Column:
    return normalize(col, quotes="", fold=True)


def header_text(col: Column) -> Column:
    """Single-line header text without embedded table blocks."""
    out = F.regexp_replace(text_or_empty(col), F.lit("\r\n?"), F.lit("\n"))
    out = F.translate(
        out,
        NBSP + NNBSP + FIGSP + "\ufffc" + "«»“”„–—−" + ZERO_WIDTH,
        '    """""---',
    )
    out = F.regexp_replace(out, F.lit(r"(?s)\[\[TABLE\]\].*?\[\[/TABLE\]\]"), F.lit(" "))
    return strip(tighten_punctuation(squeeze(out)))


def dedup_key(col: Column) -> Column:
    """Key under which two fragments count as the same text."""
    out = fold_case(card_text(col))
    out = F.regexp_replace(out, F.lit("(?U)^[*\\-•]\\s*"), F.lit(""))
    out = squeeze(out)
    out = F.translate(out, "\"'`", "")
    return strip(tighten_punctuation(out), " .;,:")


def word_cut(col: Column, limit: int, tail: str = "...") -> Column:
    """Cut a text at the last blank before ``limit`` characters and mark the cut."""
    head = F.left(col, F.lit(limit))
    head = F.regexp_replace(head, F.lit("(?s) [^ ]*$"), F.lit(""))
    return F.when(F.length(col) > limit, F.concat(strip(head, " ,.;:-"), F.lit(tail))).otherwise(col)


def spaced_thousands(col: Column) -> Column:
    """Whole number with blanks between thousands; ``0`` when it is not a number."""
    number = F.coalesce(col.cast("string").try_cast("bigint"), F.lit(0).cast("bigint"))
    return F.replace(F.format_number(number, 0), F.lit(","), F.lit(" "))


def header_text_or_null(col: Column) -> Column:
    return F.when(col.isNotNull(), header_text(col))
