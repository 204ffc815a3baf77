"""Added spans of personal data on held-out forms with fresh names, hosts and numbers."""

import random

import pytest
from messy import WORDS, prose

from actloom.llm import personal_data as pd


def test_recall_and_precision_of_added_spans(spark):
    r = random.Random(4)
    pieces = [lambda: f"{r.choice(WORDS)}.{r.randint(10, 99)}@mail{r.randint(0, 9)}.example.com", lambda: f"10.{r.randint(0, 255)}.{r.randint(0, 255)}.7"]
    docs = [(i, f"{prose(i, 40)} {pieces[i % 2]()} {prose(i + 900, 40)}") for i in range(150)]
    net = pd.fit(spark.createDataFrame(docs, "doc_id long, text string"))
    rng = random.Random(77)
    texts, wanted = [], []
    for i in range(480):
        kind = i % len(pd.KINDS)
        piece = pd.rewritten(kind, pd.fresh(kind, rng), rng)
        before = prose(5000 + i, rng.randint(2, 12)) + " "
        texts.append(before + piece + rng.choice([" ", ". ", ", "]) + prose(7000 + i, rng.randint(2, 12)))
        wanted.append((len(before), len(before) + len(piece), kind))
    base, found = pd.find_spans(texts, net)
    for kind, name in enumerate(pd.KINDS):
        mine = [(w, b, f) for w, b, f in zip(wanted, base, found) if w[2] == kind and not any(x < w[1] and w[0] < y for x, y, _ in b)]
        hit = sum(w in f for w, b, f in mine)
        added = sum(len(f) - len(b) for _, b, f in mine)
        assert hit >= 0.9 * len(mine) and hit >= 0.9 * added, (name, hit, added, len(mine))
    lookalikes = [f"{prose(i, 8)} {pd.lookalike(rng)} {prose(i + 50, 8)}" for i in range(1000)]
    base, found = pd.find_spans(lookalikes, net)
    assert sum(len(f) - len(b) for b, f in zip(base, found)) <= 10


@pytest.mark.parametrize("text,span,grown", [
    ("mail jane.doe＠mail.example.org. Next", "jane.doe＠mail.example.o", "jane.doe＠mail.example.org"),
    ("mail jane at host dot com. Next one", "jane at host", "jane at host dot com"),
    ("x (dot) y a_b [at] c (dot) d now", "b [at] c", "a_b [at] c (dot) d"),
    ("from 10 . 20 . 30 . 40. Then", " 10 . 20 . 30 . 40.", "10 . 20 . 30 . 40"),
    ("card 4111/1111/1111/1111, paid", "11/1111/1111/1111", "4111/1111/1111/1111"),
    ("call (555) 123-4567 now", "555) 123-45", "(555) 123-4567"),
    ("no address here", "address", "address"),
])
def test_spans_grow_to_their_ends(text, span, grown):
    kind = 0 if "@" in grown or "＠" in grown or " at " in grown or "[at]" in grown or "address" in grown else 1 if " . " in grown else 2 if "/" in grown else 3
    a = text.index(span)
    x, y = pd.whole(kind, text, a, a + len(span))
    assert text[x:y] == grown
