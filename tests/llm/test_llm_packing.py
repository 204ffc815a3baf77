"""Packing: exact complements on counts, whole packings on messy rows, ids of the library."""

import functools
import random
import zlib

import numpy as np
from messy import empty, rows, table

from actloom.llm import packing


def best_fit_decreasing(lengths, limit):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            g = min(fits)
            gaps.remove(g)
            gaps.append(g - n)
        else:
            gaps.append(limit - n)
    return len(gaps)


def test_exact_finds_singles_pairs_and_triples():
    rng = random.Random(1)
    for _ in range(300):
        limit = rng.randint(5, 30)
        pieces = [rng.randint(1, limit) for _ in range(rng.randint(0, 6))]
        waiting = packing.Waiting(np.bincount(pieces, minlength=limit + 1))
        for gap in range(1, limit + 1):
            sums = {x for i, x in enumerate(pieces)}
            sums |= {x + y for i, x in enumerate(pieces) for y in pieces[i + 1 :]}
            sums |= {x + y + z for i, x in enumerate(pieces) for j, y in enumerate(pieces[i + 1 :], i + 1) for z in pieces[j + 1 :]}
            found = waiting.exact(gap)
            assert (found is not None) == (gap in sums)
            if found:
                left = list(pieces)
                for x in found:
                    left.remove(x)
                assert sum(found) == gap and len(found) <= 3


def test_plans_hold_every_piece_and_waste_little():
    rng = random.Random(2)
    for limit, n in ((10, 0), (10, 7), (50, 200), (64, 3000), (300, 500)):
        pieces = [min(limit, 1 + int(rng.expovariate(4 / limit))) for _ in range(n)]
        counts = np.bincount(np.array(pieces, np.int64), minlength=limit + 1)
        patterns = packing.plan(counts)
        held = np.zeros(limit + 1, np.int64)
        for times, parts in patterns:
            assert sum(parts) <= limit and times > 0
            np.add.at(held, parts, times)
        assert held.tolist() == counts.tolist()
        made = sum(t for t, _ in patterns)
        assert -(-sum(pieces) // limit) <= made <= best_fit_decreasing(pieces, limit)
        places = packing.Places(patterns)
        seen: dict = {}
        for length in range(1, limit + 1):
            seq, at = places.find(np.full(counts[length], length), np.arange(counts[length]))
            for s, o in zip(seq.tolist(), at.tolist()):
                seen.setdefault(s, []).append((o, length))
        assert len(seen) == made
        for spans in seen.values():
            spans.sort()
            assert [o for o, _ in spans] == np.cumsum([0, *(x for _, x in spans[:-1])]).tolist()


@functools.cache
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def library_ids(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 1]


def test_packing_on_messy_rows(spark):
    limit = 128
    got = packing.pack_documents(table(spark), limit=limit).collect()
    ids = {r[0]: library_ids(r[1]) for r in rows()}
    copies: dict = {}
    for r in rows():
        copies[r[0]] = copies.get(r[0], 0) + 1
    expected = sorted(
        ((-1 if d is None else d), i, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
        for d, x in ids.items() for _ in range(copies[d])
        for i, at in enumerate(range(0, len(x), limit)) for part in [x[at : at + limit]]
    )
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in sequences.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0, *(n for _, n in spans[:-1])]).tolist()
        assert sum(n for _, n in spans) <= limit
    assert len(sequences) <= best_fit_decreasing([r.length for r in got], limit)
    assert packing.pack_documents(empty(spark)).count() == 0


def test_stretches_equal_the_library():
    import public_tokenizers

    stretches, rng = packing.load(public_tokenizers.path("word_bpe_49k.json")), random.Random(3)
    bits = ["a", "B", "H̱", "J̌", "É", "é", "'s", "'", "'t", ",", ".", "!", ")", " ", "\n", "\x1c", " ", "1", "٣", "日", "🙂", "Σ",
            "ΑΣ ", "<|endoftext|>", "<|ENDOFTEXT|>", "İ", "ﬁ", "-", "́", "x" * 300]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert [*np.frombuffer(stretches.encode([text])[0], "<u4").tolist(), 1] == library_ids(text)


def test_words_and_marked_lines_give_the_ids_of_the_library():
    import public_tokenizers

    stretches = packing.Stretches(str(public_tokenizers.path("word_bpe_49k.json")))
    parts = ["word", "Слово", "Й", "Ärger", "é", "e\u0301", "Σ", "İ", "\x01", "a\x01b", "12", "a-b,", "<|endoftext|>", "", "漢", "\u0301", "×"]
    texts = parts + [a + b for a in parts for b in parts] + [" ".join(parts)]
    for text, ids in zip(texts, stretches.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == stretches.tokenizer.encode(text, add_special_tokens=False).ids
    assert packing.PLAIN_WORD("Слово") and not packing.PLAIN_WORD("Σ") and not packing.PLAIN_WORD("a×b")
