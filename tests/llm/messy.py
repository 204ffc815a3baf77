"""Small tables with the cases that every operator must take: nulls, empty and long texts, ties, repeated rows,
empty tables, extra columns with clashing names."""

from __future__ import annotations

import random

WORDS = [a + b for a in ("ka", "lo", "mi", "re", "tu", "su", "ne") for b in ("n", "r", "sta", "do", "vi", "pe", "gol")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, key string, w string, x string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = r.choice(WORDS)
        out.append(w.capitalize() if i % 9 == 0 else w + ("." if i % 9 == 8 else ""))
    return " ".join(out)


def rows() -> list[tuple]:
    base = prose(1, 90)
    edited = base.replace(base.split()[40], "changed", 1)
    texts = [
        base, base, edited, "", None, "   \n\t ", "one", "four words are here", prose(2, 60), prose(3, 60).upper(),
        "É ñ 日本語 \U0001f642 " * 30, prose(4, 30_000), "a a a a " * 50, "line\nline\nline\n\nother\n", prose(5, 200) + "\n" + base,
        "x" * 70_000, prose(6, 55) + " mail me: some.one@mail3.example.com or +1 (555) 555-1234, 10.0.0.255, 4111 1111 1111 1111.",
        "\x1c\x1d odd \x85 blanks  ", "## $$ ** %% && || << >> " * 30,
    ]
    out = [(i, t, "en", "src0", len(t or ""), 0.5, 1, "k", "w", "x") for i, t in enumerate(texts)]
    return [*out, out[8], out[8], (None, "a row without an id " * 5, None, None, None, None, None, None, None, None)]


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df) -> dict:
    return {r["doc_id"]: r for r in df.collect()}
