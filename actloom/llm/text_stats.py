"""Statistics of whole texts, counted in one pass per document."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from actloom.llm.common import map_rows, narrow

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
MARKS = b".,;:!?'\"()-"
_ALL = bytes(range(256))
_NOT = {
    name: bytes(b for b in _ALL if b not in kind)
    for name, kind in {
        "symbols": SYMBOLS, "space": SPACE, "marks": MARKS, "digits": b"0123456789",
        "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "beyond": bytes(range(128, 192)),
        "high": bytes(range(192, 256)),
    }.items()
}
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper",
    "n_lower", "n_digits", "n_marks", "n_high", "n_shouts", "longest_word", "longest_line",
)
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def repeated_words(words: list[bytes], width: int = 3) -> tuple[int, int]:
    """How many words lie in a window of three words that the text holds twice or more, and how many distinct
    words there are. Words get numbers, windows get numbers of their pairs, so equal means equal."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(ids) < width + 1:
        return 0, len(number)
    window = ids
    for step in range(1, width):
        pair = window[:-1] * len(number) + ids[step:]
        if step < width - 1 or len(number) > 1_000_000:
            window = np.unique(pair, return_inverse=True)[1] if len(number) > 1_000_000 else pair
        else:
            window = pair
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(ids), bool)
    for step in range(width):
        inside[step : len(ids) - width + 1 + step] |= twice
    return int(inside.sum()), len(number)


def count_text(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of COUNTS; null counts as empty."""
    raw = (text or "").encode()
    if not raw:
        return (0,) * len(COUNTS)
    words = raw.split()
    lines = [x for x in (raw.split(b"\n") if b"\n" in raw else [raw]) if x.strip()]
    having = lambda name: len(raw.translate(None, _NOT[name]))
    chars = len(raw) - having("beyond")
    repeats, distinct = repeated_words(words)
    return (
        len(words), chars - having("space"), having("symbols"), len(lines) - len(set(lines)), repeats, len(lines),
        distinct, having("upper"), having("lower"), having("digits"), having("marks"), having("high"),
        raw.count(b"!"), max(map(len, words), default=0), max(map(len, lines), default=0),
    )


def count_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the counts of every whole text."""

    def make():
        def work(cols: dict) -> dict:
            rows = np.array([count_text(t) for t in cols["text"]], np.int64).reshape(-1, len(COUNTS))
            return {"doc_id": cols["doc_id"], **{c: rows[:, i] for i, c in enumerate(COUNTS)}}

        return work

    return map_rows(narrow(df, key, text), SCHEMA, make)
