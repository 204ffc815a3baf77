"""Sharding, rules, classifiers, tokens and personal data on messy rows and against brute force."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from messy import WORDS, by_id, empty, prose, rows, table
from pyspark.sql import functions as F

from actloom.llm import byte_bpe, common, personal_data, quality_rules, quality_trees, sharding, text_stats, toxicity


def jump_by_hand(key: int, shards: int) -> int:
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_walk_and_consistent():
    keys = np.array([0, 1, 2, 7, 10**12, -5, 2**62], np.int64)
    for n in (1, 2, 16, 17, 1000):
        assert list(sharding.jump_hash(keys, n)) == [jump_by_hand(int(k) % 2**64, n) for k in keys]
    many = np.arange(20_000)
    small, grown = sharding.jump_hash(many, 16), sharding.jump_hash(many, 17)
    assert set(grown[small != grown]) == {16}
    assert abs((small != grown).mean() - 1 / 17) < 0.01
    with pytest.raises(ValueError):
        sharding.jump_hash(many, 0)


def test_shards_have_gapless_slots(spark):
    got = sharding.shard_documents(table(spark)).collect()
    assert len(got) == len(rows())
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    text = {r[0]: (r[1] or "").encode() for r in rows()}
    for r in got:
        raw = text[r.doc_id]
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        assert r.shard == jump_by_hand(r.doc_id or 0, 16) and r.grown_shard == jump_by_hand(r.doc_id or 0, 17)
    assert sharding.shard_documents(empty(spark)).count() == 0


def counts_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    where = collections.defaultdict(list)
    for i in range(len(words) - 2):
        where[tuple(words[i : i + 3])].append(i)
    inside = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(inside)


def test_counts_against_brute_force():
    r = random.Random(3)
    texts = [x[1] for x in rows()] + [" ".join(r.choice("ab|c\n") for _ in range(r.randint(0, 60))) for _ in range(300)]
    for t in texts:
        assert text_stats.count_text(t)[:5] == counts_by_hand(t), t


def test_exact_bound_matches_the_binomial_sum():
    exact = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    for k, n, p, d in ((0, 100, 0.05, 0.01), (3, 200, 0.05, 0.02), (12, 400, 0.02, 0.5), (0, 10, 0.1, 0.3)):
        assert quality_rules.below_risk(k, n, p, d) == (exact(k, n, p) <= d)
    assert not quality_rules.below_risk(0, 0, 0.1, 0.1)


def test_cutoffs_keep_the_risk():
    bins = {(0, "symbols"): {-1: (3000, 0), 20: (10, 5), 150: (0, 400)}}
    (cut,) = quality_rules.choose(bins, 0.02, 0.95)
    assert 20 / quality_rules.STEPS < cut.cutoff <= 150 / quality_rules.STEPS and cut.good_rejected == 0 and cut.bad_rejected == 400
    assert quality_rules.choose({(0, "symbols"): {-1: (30, 0), 150: (0, 400)}}, 0.02, 0.95) == []
    assert quality_rules.choose({}, 0.02, 0.95) == []


def test_rules_on_messy_rows(spark):
    marks = spark.createDataFrame([(0, 1), (3, 0), (8, None), (999, 1)], "doc_id long, quality int")
    got = quality_rules.judge(table(spark), marks).collect()
    assert len(got) == len(rows())
    for r in got:
        n, _, _, _, repeats = counts_by_hand({x[0]: x[1] for x in rows()}[r.doc_id])
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert r.kept == (not r.base_failed)  # four labels guarantee nothing
    assert quality_rules.judge(empty(spark), marks).count() == 0


def test_rules_reject_junk_and_keep_clean(spark):
    good = [(i, prose(i, 120)) for i in range(3000)]
    bad = [(10_000 + i, " ".join(w + "###" for w in prose(i, 120).split())) for i in range(300)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i < 10_000)) for i, _ in good + bad], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.judge(docs, marks).collect()}
    assert not any(got[i].kept for i, _ in bad)
    fine = [got[i] for i, _ in good if not got[i].base_failed]
    assert sum(r.kept for r in fine) >= 0.98 * len(fine)


def test_trees_learn_and_take_messy_rows(spark):
    good = [(i, prose(i, 80)) for i in range(120)]
    bad = [(1000 + i, (prose(i, 20).upper() + "!! ") * 4) for i in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i < 1000)) for i, _ in good + bad], "doc_id long, quality int")
    trees = quality_trees.fit(docs, marks, "quality", F.lit(True))
    assert trees.score(quality_trees.features([prose(777, 80)]))[0] > 0.8
    assert trees.score(quality_trees.features([(prose(778, 20).upper() + "!! ") * 4]))[0] < 0.2
    got = quality_trees.score_documents(table(spark), trees).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    assert quality_trees.score_documents(empty(spark), trees).count() == 0
    none = quality_trees.fit(docs, marks.limit(0), "quality", F.lit(True))
    assert none.score(quality_trees.features(["a", None])).tolist() == [0.5, 0.5]


def test_tree_walk_equals_a_walk_by_hand():
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 3))
    trees = quality_trees.grow(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=20, depth=3)
    for row, score in zip(x[:50], trees.score(x[:50])):
        margin = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value):
            n = 0
            while n < len(f):
                n = 2 * n + 1 + int(row[f[n]] > t[n])
            margin += v[n - len(f)]
        assert abs(score - 1 / (1 + np.exp(-margin))) < 1e-12
    assert ((trees.score(x) > 0.5) == (x[:, 0] * x[:, 1] > 0)).mean() > 0.9


def all_maximal(values):
    """By definition: the best segment, then the same to its left and right (Ruzzo and Tompa)."""
    best = max(((sum(values[a:b]), a, b) for a in range(len(values)) for b in range(a + 1, len(values) + 1)),
               key=lambda x: (round(x[0], 9), -x[1], x[1] - x[2]), default=(0, 0, 0))
    if best[0] <= 1e-12:
        return []
    s, a, b = best
    return all_maximal(values[:a]) + [(s, a, b - 1)] + [(t, x + b, y + b) for t, x, y in all_maximal(values[b:])]


def test_segments_against_brute_force():
    r = random.Random(5)
    for _ in range(300):
        values = [r.uniform(0.1, 3) if r.random() < 0.3 else -0.4 for _ in range(r.randint(0, 14))]
        places = [i for i, v in enumerate(values) if v > 0]
        got = toxicity.maximal_segments(places, [values[i] for i in places], 0.4)
        want = all_maximal(values)
        assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want]
        assert np.allclose([s for s, _, _ in got], [s for s, _, _ in want])


def test_decay_rate_is_the_root():
    gains, shares = np.array([2.0, 3.0]), np.array([0.01, 0.002])
    rate = toxicity.decay_rate(gains, shares, 0.15)
    assert abs((shares * np.exp(rate * gains)).sum() + (1 - shares.sum()) * np.exp(-0.15 * rate) - 1) < 1e-9 and rate > 0


def test_toxic_passages(spark):
    r = random.Random(8)
    docs, marks = [], []
    for i in range(300):
        words = [r.choice(WORDS) for _ in range(r.randint(30, 90))]
        if i % 5 == 0:
            for w in r.sample(["vilest", "scummy", "trashy", "rotters"], 3):
                words.insert(r.randrange(len(words)), w)
        docs.append((i, " ".join(words)))
        marks.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, F.col("doc_id") < 200)
    got = by_id(toxicity.score_documents(docs, model))
    held = [got[i] for i in range(200, 300)]
    assert all((x.score >= 0.3) == (x.doc_id % 5 == 0) for x in held)
    messy = toxicity.score_documents(table(spark), model).collect()
    assert len(messy) == len(rows()) and all(0 <= x.score < 0.3 for x in messy)
    assert toxicity.score_documents(empty(spark), model).count() == 0
    none = toxicity.fit(docs, marks.limit(0), F.lit(True))
    assert none.score(np.zeros(1))[0] < 0.01


@pytest.fixture(scope="module")
def rank_file():
    import public_tokenizers

    return public_tokenizers.path(byte_bpe.TOKENIZER)


def test_bpe_equals_the_library(spark, rank_file):
    import public_tokenizers
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.encode_documents(table(spark)).collect()
    assert len(got) == len(rows())
    text = {r[0]: r[1] or "" for r in rows()}
    for r in got:
        ids = library.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert byte_bpe.encode_documents(empty(spark)).count() == 0
    rng = random.Random(2)
    for _ in range(2000):
        t = "".join(rng.choice("aabAB  \n\té日🙂'st19.,-=") for _ in range(rng.randint(0, 30)))
        assert byte_bpe.token_ids(t, rank_file) == library.encode_ordinary(t)
        assert byte_bpe.decode(byte_bpe.token_ids(t, rank_file), rank_file) == t.encode()


def test_workers_drop_what_other_operators_keep(spark, rank_file):
    common.kept("tests")["x"] = 1
    loaded = byte_bpe.load(rank_file)
    common.release_others(byte_bpe.__name__)
    assert "x" not in common.kept("tests") and byte_bpe.load(rank_file) is loaded
    common.release_others("tests")
    assert byte_bpe.load(rank_file) is not loaded


def test_bpe_waits_for_lower_ranks():
    """Ranks in which a merge makes a pair of still lower rank: fast and slow replay agree with encoding alone."""
    ranks = byte_bpe.Ranks.__new__(byte_bpe.Ranks)
    tokens = [bytes([b]) for b in range(256)] + [b"aba", b"bc", b"ab", b"abab", b"ca", b"abc"]
    ranks.ids = {t: i for i, t in enumerate(tokens)}
    byte_bpe.Ranks.index(ranks)

    def alone(word):
        parts = [bytes([b]) for b in word]
        while True:
            found = [(ranks.ids[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks.ids]
            if not found:
                return [ranks.ids[p] for p in parts]
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(4)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))).encode() for _ in range(500)]
    ids, begins = byte_bpe.replay(words, ranks)
    fast = [list(map(int, x)) for x in np.split(ids, begins[1:])]
    want = [alone(w) for w in words]
    assert byte_bpe.replay_slowly(words, ranks) == want
    assert fast == want


def base_by_hand(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m.group())
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_base_spans_against_brute_force():
    r = random.Random(6)
    for _ in range(3000):
        t = "".join(r.choice(["@", ".", "4111", "1111", " ", "-", "+1", "(555)", "a.b", "x", "7", "255", "é"]) for _ in range(r.randint(0, 14)))
        assert personal_data.spelt(personal_data.base_spans(t)) == base_by_hand(t), t


def test_network_gradients():
    r = np.random.default_rng(0)
    net = personal_data.Network()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, mask, y = r.integers(1, 98, (6, 2)), np.ones((6, 2)), np.zeros((6, 2), np.int64)
    y[1], y[2], mask[5:, 1] = [1, 3], [2, 4], 0
    _, grads = net.gradients(x, y, mask)
    for name, w in net.w.items():
        at = (x[2, 0], 3) if name == "embed" else tuple(n // 2 for n in w.shape)
        old, parts = w[at], []
        for step in (1e-4, -1e-4):
            w[at] = old + step
            parts.append(net.gradients(x, y, mask)[0])
        w[at] = old
        assert abs((parts[0] - parts[1]) / 2e-4 - grads[name][at]) < 2e-3, name


def test_reconciled_windows_agree_with_one_window():
    tags = np.zeros(300, np.int8)
    tags[100], tags[101:180], tags[200], tags[201:210] = 3, 4, 1, 2
    windows = [(a, min(a + 96, 300)) for a in range(0, 300 - 48, 48)]
    got = personal_data.reconciled(windows, [tags[a:b] for a, b in windows])
    assert got == [(100, 180, 1), (200, 210, 0)]


def test_personal_data_learns_new_forms(spark):
    r = random.Random(9)

    def doc(i):
        kind = i % 4
        d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
        card = next(c for c in (d(16) for _ in range(1000)) if personal_data.luhn(c))
        piece = [f"{r.choice(WORDS)}.{d(2)}@mail{d(1)}.example.com", f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.7", card, f"+1 ({d(3)}) 555-{d(4)}"][kind]
        return prose(i, 12) + " " + piece + " " + prose(i + 5000, 12)

    docs = spark.createDataFrame([(i, doc(i)) for i in range(200)], "doc_id long, text string")
    net = personal_data.fit(docs)
    text = prose(7, 10) + " call (555) 555-1234 now " + prose(8, 10)
    base, found = personal_data.find_spans([text, prose(9, 60), None], net)
    assert base == [[], [], []] and found[1:] == [[], []]
    assert any(text[a:b] == "(555) 555-1234" for a, b, _ in found[0])
    got = personal_data.find(table(spark), net).collect()
    assert len(got) == len(rows())
    whole = {x[0]: x[1] or "" for x in rows()}
    for x in got:
        want = base_by_hand(whole[x.doc_id])
        assert x.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(x.spans.split(","))
    assert personal_data.find(empty(spark), None).count() == 0
    assert personal_data.fit(empty(spark)) is None


def test_registered_sql_is_text():
    from actloom.llm import queries

    assert all(isinstance(sql, str) for sql in queries.ORACLES.values())


@pytest.mark.parametrize("address", [
    "name at host dot com", "name [ at ] host.com", "name ( AT ) host [ dot ] com", "name [at] host dot com", "name@host.com",
    "a.very.long.local.part.of.more.than.thirty at one.very.long.host.name.of.more.than.thirty dot example dot com",
    "x" * 300 + " [at] " + "y" * 300 + ".com", "1a@b" + ".c" * 60, "name at h dot com dot",
])
def test_windows_hold_every_form_of_an_address(address):
    """Whatever may be a span lies whole in the stretch that is decoded, with a margin to both sides."""
    text = "look " * 30 + address + " and then" * 30
    windows = personal_data.windows_of(text)
    seen = {i for a, b in windows for i in range(a, b)}
    start = text.index(address)
    spans = [address] if personal_data.form(0, address) else [address.rsplit(" ", 1)[0]]
    assert personal_data.form(0, spans[0])
    assert set(range(start - 20, start + len(spans[0]) + 10)) <= seen
    assert not personal_data.windows_of("we met at home and left at noon, " * 9)


def test_long_words_have_windows_in_linear_time():
    assert personal_data.windows_of("x" * 200_000) == []
    assert len(personal_data.windows_of("x" * 50_000 + "@" + "y" * 50_000)) > 2000


def test_training_reaches_the_ends_of_long_documents(spark):
    """Addresses after more sites than are drawn of one document are learned from too."""
    docs = [(i, " ".join(f"{prose(50 * i + k, 12)} {1900 + k}" for k in range(30)) + f" mail me.{i}@mail.example.com") for i in range(40)]
    assert personal_data.fit(spark.createDataFrame(docs, "doc_id long, text string")) is not None
