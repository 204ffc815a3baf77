"""Spelling variants against all pairs, with filters of several segments and rounds."""

import random
import re
import zlib
from collections import Counter

import pytest
from messy import empty, rows, table

from actloom.llm import spelling_variants as sv


def words_by_hand(docs):
    found: Counter = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(docs):
    words = words_by_hand(docs)
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_apart(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def corpus():
    rng = random.Random(5)
    stems = ["".join(rng.choice("abéÿ") for _ in range(rng.randint(6, 9))) for _ in range(40)] + ["é" * 9, "z" * 80, "zy" * 40]
    docs = [(r[0], r[1]) for r in rows()]
    for doc in range(60):
        out = []
        for _ in range(200):
            w = stems[min(int(rng.paretovariate(0.7)) - 1, len(stems) - 1)]
            if rng.random() < 0.2:
                at = rng.randrange(len(w) + 1)
                w = w[:at] + rng.choice(["", "x", "À", "é"]) + w[at + rng.randint(0, 1) :]
            out.append(rng.choice([w, w.upper() if w.isascii() else w, w.capitalize()]))
        docs.append((1000 + doc, rng.choice([" ", ", ", "1"]).join(out)))
    # A chain of forms: 2, 30, 400 and 5,000 occurrences, each one letter from the next.
    docs += [(2000, " ".join(["chainaaaa"] * 2 + ["chainaaab"] * 30 + ["chainaabb"] * 400 + ["chainabbb"] * 5000))]
    return docs


@pytest.mark.parametrize("blocks,most", [(8192, 64_000_000), (4, 64)])
def test_variants_against_brute_force(spark, monkeypatch, blocks, most):
    monkeypatch.setattr(sv, "SEGMENT_BLOCKS", blocks)
    monkeypatch.setattr(sv, "ROUND_BYTES", most)
    monkeypatch.setattr(sv, "EDITS_AT_ONCE", 500 if blocks == 4 else 2_000_000)
    docs = corpus()
    want = variants_by_hand(docs)
    df = table(spark, [(d, t, *[None] * 8) for d, t in docs])
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in sv.group_variants(df).collect()}
    assert got == want
    assert any(root != form for form, root, *_ in want.values() if form)
    assert sv.group_variants(empty(spark)).count() == 0


def test_rounds_cover_every_segment_once(monkeypatch):
    monkeypatch.setattr(sv, "SEGMENT_BLOCKS", 16)
    shape = sv.Shape({7: 1, 8: 1000, 9: 50, 64: 4000})
    seen = [(n, s) for r in shape.rounds(400) for n, (a, b) in r.items() for s in range(a, b)]
    assert sorted(seen) == [(n, s) for n in (7, 8, 9, 64) for s in range(shape.segments[n])]
    for r in shape.rounds(400):
        assert sum(8 * shape.blocks[n] * (b - a) for n, (a, b) in r.items()) <= 400
