"""Near duplicates, decontamination, language model, pages and the pipeline on messy rows and against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from messy import by_id, empty, prose, rows, table
from pyspark.sql import functions as F

from actloom.llm import decontamination, html_text, language_model, near_duplicates

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text, width=5):
    w = BLANK_WORDS.findall((text or "").translate(A_Z))
    if not w:
        return set()
    return {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def components_by_hand(data, percent):
    sets = [(i, shingles(t)) for i, t in data if i is not None]
    links = defaultdict(set)
    for n, (a, s) in enumerate(sets):
        for b, t in sets[:n]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                links[a].add(b)
                links[b].add(a)
    out = {}
    for i, _ in sets:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = min(seen)
    return out


def test_near_duplicates_on_messy_rows(spark):
    got = near_duplicates.link(table(spark)).collect()
    assert len(got) == len(rows())
    want = components_by_hand([r[:2] for r in rows()], 85)
    text = {r[0]: r[1] for r in rows()}
    for r in got:
        assert r.n_shingles == len(shingles(text[r.doc_id]))
        assert r.component_id == want.get(r.doc_id)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert near_duplicates.link(empty(spark)).count() == 0


@pytest.mark.parametrize("percent,tile", [(85, 256), (80, 7)])
def test_near_duplicates_of_a_large_group(spark, percent, tile):
    """One group of near copies of one text, some of them in chains, in small tiles."""
    r = random.Random(percent)
    base = prose(40, 120).split()
    data = []
    for i in range(150):
        w = list(data[-1][1].split()) if i and r.random() < 0.3 else list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"new{r.randint(0, 9999)}"
        data.append((i, " ".join(w)))
    data += [(1000 + i, prose(300 + i, 60)) for i in range(50)]
    got = by_id(near_duplicates.link(spark.createDataFrame(data, "doc_id long, text string"), percent, tile=tile))
    assert {i: x.component_id for i, x in got.items()} == components_by_hand(data, percent)


def test_every_pair_within_the_guarantee_shares_a_key():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**16, (400, near_duplicates.COMPONENTS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[r.choice(near_duplicates.COMPONENTS, near_duplicates.GUARANTEED, replace=False)] ^= 1
    x, y = near_duplicates.bucket_keys(a), near_duplicates.bucket_keys(b)
    shared = x == y
    assert shared.any(1).all()
    assert (near_duplicates.first_keys(a, b) == shared.argmax(1)).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = near_duplicates.components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r.root].add(r.id)
    assert sorted(map(min, groups.values())) == [0, 100] and len(got) == 61 + 40


ITEMS = [(0, prose(70, 40)), (1, "four words are here"), (2, None), (3, ""), (4, prose(70, 40)), (None, "none " * 12), (5, "Ünïcode " * 11)]


def hits_by_hand(text, items):
    w = PLAIN_WORDS.findall((text or "").translate(A_Z))
    hit, found = set(), set()
    for item, body in items:
        v = PLAIN_WORDS.findall((body or "").translate(A_Z))
        if item is None or not v:
            continue
        n = min(len(v), 10)
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_decontamination_against_brute_force(spark, broadcast_rows):
    r = random.Random(11)
    part = ITEMS[0][1].split()
    extra = []
    for i in range(60):
        a = r.randrange(25)
        extra.append((500 + i, prose(800 + i, 20) + " " + " ".join(part[a : a + r.randint(7, 15)]).upper() + "; " + prose(900 + i, 9)))
    extra += [(600, " ".join(part)), (601, "x, four. WORDS-are\nhere"), (602, "ünïcode " * 40), (603, "ab " * 500)]
    data = [x[:2] for x in rows()] + extra
    docs = spark.createDataFrame([(*x, 1, 2) for x in data], "doc_id long, text string, item_id int, w int")
    items = spark.createDataFrame([(*x, "w") for x in ITEMS], "item_id int, text string, window string")
    got = decontamination.summarise(decontamination.find(docs, items, broadcast_rows)).collect()
    text = dict(data)
    assert len(got) == len(data)
    for x in got:
        assert tuple(x)[1:] == hits_by_hand(text[x.doc_id], ITEMS), x.doc_id
    assert decontamination.find(empty(spark), items).count() == 0
    none = decontamination.summarise(decontamination.find(docs, items.limit(0), broadcast_rows)).collect()
    assert len(none) == len(data) and not any(x.contaminated for x in none)


def test_decontamination_is_native(spark):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    plan = decontamination.find(table(spark), items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def model_by_hand(data, part, contexts, weights=None):
    """Scores of every row by the formulas, from plain dictionaries."""
    tokens = [BLANK_WORDS.findall((t or "").translate(A_Z)) + ["\0end"] for _, t in data]
    uni, pairs, kept, kept_pairs = Counter(), Counter(), Counter(), Counter()
    for w, p in zip(tokens, part):
        if p < 2:
            seen = list(zip(["\0start", *w], w))
            uni.update(w)
            pairs.update(seen)
            uni["\0start"] += 1
            if p == 0:
                kept.update([*w, "\0start"])
                kept_pairs.update(seen)
    starts, kept_starts = uni.pop("\0start", 0), kept.pop("\0start", 0)
    n, v = sum(uni.values()), len(uni)
    hashed = {w: language_model.word_hash(w.encode()) for w in uni}
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    top = sorted((w for w in uni if w != "\0end"), key=lambda w: (-uni[w], signed(hashed[w])))[:contexts]
    size = {w: uni[w] for w in top} | {"\0start": starts}
    out = []
    for w in tokens:
        base = sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for a, b in zip(["\0start", *w], w):
            bucket = min(int(math.log2(size[a] + 1)) + 1, language_model.BUCKETS - 1) if a in size else 0
            l2, l1, l0 = weights[bucket] if weights is not None else (1 / 3,) * 3
            p2 = pairs[a, b] / max(size[a], 1) if a in size else 0
            score += math.log10(l2 * p2 + l1 * uni[b] / max(n, 1) + l0 / (v + 1))
        out.append((len(w), sum(x in uni for x in w), n, base, score))
    return out


def test_language_model_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language_model, "CHUNK_TOKENS", 500)
    data = [x[:2] for x in rows()] + [(100 + i, prose(i, 60)) for i in range(80)]
    data = [(i, t) for i, t in data if i != 11] + [(11, prose(4, 3000))]
    part = [0 if i is None or i % 7 not in (2, 3) else 2 if i % 7 == 2 else 1 for i, _ in data]
    docs = spark.createDataFrame([(i, t, p, 1) for (i, t), p in zip(data, part)], "doc_id long, text string, p int, part int")
    frame = docs.select("doc_id", "text", F.col("p").alias("part"))
    model = language_model.count_contexts(frame, 25)
    language_model.learn_weights(frame, model, 5)
    assert np.allclose(model.weights.sum(1), 1) and len(model.codes) == 25
    got = sorted(map(tuple, language_model.per_document(frame, model, 5).collect()), key=repr)
    want = model_by_hand(data, part, 25, model.weights)
    want = sorted(((i, p, n, known, base + n * math.log10(model.tokens + model.words + 1), s)
                   for (i, _), p, (n, known, _, base, s) in zip(data, part, want)), key=repr)
    assert [x[:4] for x in sorted(got, key=lambda x: (repr(x[0]), x[2]))] == [x[:4] for x in sorted(want, key=lambda x: (repr(x[0]), x[2]))]
    by = {x[0]: x for x in want}
    for x in got:
        assert abs(x[4] - by[x[0]][4]) < 1e-6 and abs(x[5] - by[x[0]][5]) < 1e-6, x[0]


def test_language_model_learns(spark):
    docs = spark.createDataFrame([(i, prose(i % 40, 80)) for i in range(140)], "doc_id long, text string")
    rest = F.col("doc_id") % 7
    got = language_model.score_documents(docs, F.when(rest == 2, 2).when(rest == 3, 1).otherwise(0)).collect()
    assert len(got) == 140 and {r.held_out for r in got} == {True, False}
    assert all(r.score > r.base_score for r in got)
    assert language_model.score_documents(empty(spark), F.lit(0)).count() == 0
    alone = language_model.score_documents(docs, F.lit(2)).collect()
    assert all(r.train_tokens == 0 and r.score == 0 and r.base_score == 0 for r in alone)


def test_em_finds_the_mixture():
    r = np.random.default_rng(3)
    p = r.dirichlet(np.ones(50), 3).T
    w = np.array([0.6, 0.3, 0.1])
    got = language_model.maximised(p, 1e6 * p @ w, 2000)
    assert np.allclose(got, w, atol=0.01)


PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
    "<nav><ul><li><a href='/a'>{0}</a></li><li><a href='/b'>More</a></li></ul></nav><!-- ad --><div class=\"ad\">Buy {0}</div>"
    "<article><h1>{0}</h1><p><b>{1} &amp; co.<br>next   line<p>{2}</p><p> </p></article><footer>&copy; {0}</footer></body></html>"
)


def test_leaf_blocks():
    page = PAGE.format("Head", "First", "Second")
    assert [b.text for b in html_text.leaf_blocks(page)] == ["Head", "More", "Buy Head", "Head", "First & co. next line", "Second", "© Head"]
    for odd in (None, "", "<", "no tags", "<p", "</p></div>", "<!-- open", "<script>x", "<a b='", "<p>a<p>b</article>", "&#x41;&bogus;&amp"):
        html_text.leaf_blocks(odd)
    assert [b.text for b in html_text.leaf_blocks("<p>a<p>b</article>c")] == ["a", "b", "c"]


def viterbi_by_hand(chain, page):
    best = None
    for n in range(2 ** len(page)):
        y = [n >> i & 1 for i in range(len(page))]
        s = sum(chain.weights[f].sum() * v for f, v in zip(page, y)) + sum(chain.moves[a, b] for a, b in zip(y, y[1:]))
        if best is None or s > best[0]:
            best = (s, y)
    return best[1]


def test_viterbi_against_all_labellings():
    r = np.random.default_rng(2)
    for _ in range(40):
        chain = html_text.Chain(r.normal(size=html_text.BUCKETS), r.normal(size=(2, 2)))
        page = [list(r.integers(0, html_text.BUCKETS, 3)) for _ in range(r.integers(1, 9))]
        assert chain.decode(page) == viterbi_by_hand(chain, page)


def test_main_text_of_pages(spark):
    pages = [(i, f"http://a/{i}", PAGE.format(f"Title {i}", prose(i, 30), prose(i + 100, 20)), "x") for i in range(60)]
    extra = [(100, None, None, "x"), (101, "u", "", "x"), (102, "u", "<nav>menu</nav>", "x"), (0, *pages[0][1:])]
    df = spark.createDataFrame(pages + extra, "page_id long, url string, html string, text string")
    chain = html_text.fit(df)
    got = html_text.extract(df, chain).collect()
    assert len(got) == 64
    by = {r.page_id: r for r in got}
    for i in range(60):
        assert by[i].text == f"Title {i}\n\n{prose(i, 30)} & co. next line\n\n{prose(i + 100, 20)}"
        assert by[i].n_chars == len(by[i].text)
    assert [by[i].text for i in (100, 101, 102)] == ["", "", ""]
    blocks, labels = html_text.labelled([p[2] for p in pages], seed=99)
    shape = html_text.Featurizer()
    right = [a == b for x, y in zip(blocks, labels) for a, b in zip(chain.decode(shape.of_page(x)), y)]
    assert np.mean(right) > 0.97
    assert html_text.extract(df.limit(0), html_text.fit(df.limit(0))).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from actloom.llm import byte_bpe, personal_data

    data = [x[:5] for x in rows()] + [(100 + i, prose(i, 90), "en", "s", None) for i in range(40)]
    data += [(200 + i, prose(i, 90) + " tail", "en", "s", 3) for i in range(20)]
    data += [(300, prose(1000, 60) + " " + ITEMS[0][1] + " " + prose(1001, 60), "en", "s", 1)]
    types = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(data, types).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = corpus_pipeline.documents(spark, str(tmp_path))
    kept = dict()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage_table(stage(spark, docs, str(tmp_path)), name)
        kept[name] = docs.collect()
        if name != "byte_bpe":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS

    def base_fails(t):
        w = BLANK_WORDS.findall(t or "")
        at = defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        inside = {i + k for x in at.values() if len(x) > 1 for i in x for k in range(3)}
        return len(w) < 50 or 100 * len(inside) > 50 * len(w)

    text = {x[0]: x[1] for x in data}
    good = sorted(x[0] for x in data if not base_fails(x[1]))
    assert sorted(r.doc_id for r in kept["quality_rules"]) == good
    components = components_by_hand([(i, text[i]) for i in set(good)], corpus_pipeline.SIMILARITY)
    firsts = sorted(i for i, c in components.items() if i == c)
    assert sorted(r.doc_id for r in kept["near_duplicates"]) == firsts
    clean = [i for i in firsts if not hits_by_hand(text[i], ITEMS)[-1]]
    assert sorted(r.doc_id for r in kept["decontamination"]) == clean and 300 not in clean
    for r in kept["personal_data"]:
        for a, b, kind in personal_data.base_spans(text[r.doc_id]):
            assert text[r.doc_id][a:b] not in r.text and f"<{personal_data.KINDS[kind]}>" in r.text
        assert r.n_chars == len(r.text)
    masked = {r.doc_id: r.text for r in kept["personal_data"]}
    path = public_tokenizers.path(byte_bpe.TOKENIZER)
    assert len(kept["byte_bpe"]) == len(clean)
    for r in kept["byte_bpe"]:
        assert r.n_tokens == len(byte_bpe.token_ids(masked[r.doc_id], path))
        assert r.decoded_sha256 == hashlib.sha256(masked[r.doc_id].encode()).hexdigest()


def test_language_model_has_every_word_as_context(spark, monkeypatch):
    """With codes for 5 words only, the scores are those of a model in which all words are contexts."""
    monkeypatch.setattr(language_model, "CODED", 5)
    found, learn = [], language_model.learn_weights
    monkeypatch.setattr(language_model, "learn_weights", lambda rows, model, *more: (learn(rows, model, *more), found.append(model)))
    data = [(i, prose(i, 60) + (f" only{i} once{i} and unseen words" if i % 3 else "")) for i in range(90)] + [(4, prose(4, 60)), (None, None)]
    part = [0 if i is None or i % 7 not in (2, 3) else 2 if i % 7 == 2 else 1 for i, _ in data]
    docs, rest = spark.createDataFrame(data, "doc_id long, text string"), F.col("doc_id") % 7
    got = language_model.score_documents(docs, F.when(rest == 2, 2).when(rest == 3, 1).otherwise(0), group_tokens=900).collect()
    weights = found[0].weights
    assert np.allclose(weights.sum(1), 1) and weights[0, 0] == 0 and weights[1:, 0].max() > 0
    want = {(i, n): (known, base, s) for (i, _), (n, known, _, base, s) in zip(data, model_by_hand(data, part, 10**6, weights))}
    assert len(got) == len(data)
    for r in got:
        known, base, score = want[r.doc_id, r.n_tokens]
        assert r.n_known == known and abs(r.base_score - base) < 1e-6 and abs(r.score - score) < 1e-6, r.doc_id


def test_places_of_heavy_pairs_do_not_move(spark, monkeypatch):
    """A pair that is a fixed share of all tokens is scored where it is read; the scores stay the same."""
    docs = spark.createDataFrame([(i, "of the " * 50 + prose(i, 20)) for i in range(70)], "doc_id long, text string")
    rest = F.col("doc_id") % 7
    frame = docs.select("doc_id", "text", F.when(rest == 2, 2).when(rest == 3, 1).otherwise(0).alias("part"))
    model, scores = language_model.count_contexts(frame, 1000), []
    for heavy in (10**9, 1000):
        monkeypatch.setattr(language_model, "HEAVY", heavy)
        language_model.learn_weights(frame, model, 3)
        got = language_model.per_document(frame, model, 3)
        scores.append({r.doc_id: r.score for r in got.collect()})
        assert len(model.heavy) == (0 if heavy > 10**6 else 2)  # of the, the of
    assert all(abs(scores[0][i] - scores[1][i]) < 1e-6 for i in range(70))


@pytest.mark.parametrize("before", [
    "<head><title>t</title><meta x><body>", "<head><title>t</title>", "<body><svg a='b'/>", "<body><noscript>", "<body><iframe src=x>", "<body><object>",
    "<body><template>", "<body><select><option>no<option>no", "<body><div><svg><g>no</div>", "<body><noscript>no<p>was open</p><noscript>no</noscript>",
    "<body><svg><svg>no</svg>no</svg>", "<HEAD><style>p{}</style></HEAD><body><svg/><svg>no</svg>",
])
def test_unclosed_silent_tags_do_not_cut_the_page(before):
    got = [b.text for b in html_text.leaf_blocks(before + "<article><p>one</p>two</article><svg>no</svg>three")]
    assert got[-3:] == ["one", "two", "three"] and set(got[:-3]) <= {"was open"}


def test_pipeline_judges_rows_by_id_and_text(spark, tmp_path):
    """Rows of one id, or of none, with different texts don't stand for each other; empty tables and extra columns."""
    import corpus_pipeline

    bad, item = "### " * 60, ITEMS[0][1]
    data = [(None, prose(1, 90)), (None, prose(2, 60) + " " + item + " " + prose(3, 60)), (5, prose(4, 90)), (5, prose(5, 70) + " " + item),
            (6, prose(6, 90)), (6, bad), (7, prose(7, 90)), (8, prose(7, 90)), (None, prose(7, 90)), (7, prose(7, 90)), (9, None), (None, None)]
    types = "doc_id long, text string, lang string, source string, n_chars long, row long, kept string, component_id string"
    spark.createDataFrame([(i, t, "en", "s", 1, 1, "k", "c") for i, t in data], types).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0), (6, 0, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = corpus_pipeline.documents(spark, str(tmp_path))
    for stage in (corpus_pipeline.quality, corpus_pipeline.near_dedup, corpus_pipeline.decontaminate):
        docs = corpus_pipeline.stage_table(stage(spark, docs, str(tmp_path)), "rows")
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.text) for r in docs.collect())
    assert got == sorted([(-1, prose(1, 90)), (5, prose(4, 90)), (6, prose(6, 90)), (7, prose(7, 90))])
    nothing = corpus_pipeline.documents(spark, str(tmp_path)).filter("false")
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, str(tmp_path))
        assert nothing.count() == 0
