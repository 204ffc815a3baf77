"""Scans, card merge, audit and refill on small fixtures."""

import random

from pyspark.sql import functions as F

from actloom.functions import answers as AN
from actloom.functions.similarity import same_text
from actloom.operators import audit as AU
from actloom.operators import cards as CA
from actloom.operators import refill as RE
from actloom.operators import scan as SC


def test_chunked_scan_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.6 else k, i, rng.random() < 0.3) for i in range(300) for k in (1, 2)][:400]
    rows = [(k, i, a) for i, (k, _, a) in enumerate(rows)]
    df = spark.createDataFrame(rows, "k int, i int, a boolean")
    got = SC.chunked_scan(
        df, ["k"], F.floor(F.col("i") / 7), ["i"], sums={"pos": F.lit(1)},
        previous={"p": F.when(F.col("a"), F.col("i"))}, following={"n": F.when(F.col("a"), F.col("i"))},
    ).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = [x for x in rows if x[0] == r.k]
        before = [x[1] for x in mine if x[1] < r.i and x[2]]
        after = [x[1] for x in mine if x[1] > r.i and x[2]]
        assert (r.pos, r.p, r.n) == (
            sum(x[1] < r.i for x in mine), max(before, default=None), min(after, default=None)
        )


def _fragments(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, card string, i int, text string").select(
        "doc_id", "card", F.struct(F.col("i").alias("annotation_seq"), F.lit(0).alias("block_seq"), F.lit(0).alias("part_seq")).alias("seq"),
        "text", F.concat(F.lit("w"), F.col("i").cast("string")).alias("window_id"), F.lit("z").alias("zone_id"), F.lit("t").alias("zone_type"),
        *[F.array(F.col("i").cast("string")).alias(c) for c in ("dates", "sentence_ids", "date_sentence_ids")],
    )


def _merged_by_hand(df, rows):
    """First-match merge in order, every fragment against every representative."""
    scored = {(r.doc_id, r.card, r.i): (r.k, r.s, r.t) for r in df.select(
        "doc_id", "card", F.col("seq.annotation_seq").alias("i"), CA.T.dedup_key(F.col("text")).alias("k"),
        CA.fragment_score(F.col("text")).alias("s"), CA.T.card_text(F.col("text")).alias("t")).collect()}
    out = {}
    for doc, card, i, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        key, score, text = scored[doc, card, i]
        reps = out.setdefault((doc, card), [])
        hit = next((r for r in reps if same_text(r["key"], key, 0.92)), None)
        if hit is None:
            reps.append({"key": key, "score": score, "text": text, "w": [f"w{i}"]})
        else:
            hit["w"].append(f"w{i}")
            if score > hit["score"]:
                hit.update(key=key, score=score, text=text)
    return {g: [(r["text"], r["w"]) for r in reps] for g, reps in out.items()}


def _got(merged):
    out = {}
    for r in merged.orderBy("doc_id", "card", "seq").collect():
        out.setdefault((r.doc_id, r.card), []).append((r.text, list(r.source_window_ids)))
    return out


def test_card_merge_against_brute_force(spark):
    base = ["Договор займа подписан сторонами и исполнен переводами", "Кризис наступил раньше спорной сделки",
            "Суд признал долг реальным по накладным", "Коротко", "Суд первой инстанции установил, что " * 4 + "долг есть"]
    rng = random.Random(2)
    rows = []
    for i in range(240):
        text = rng.choice(base)
        if rng.random() < 0.6:
            text += rng.choice([".", " 10.04.2017", " на 5 руб.", "!!", " а", " " + "и так далее " * rng.randint(1, 5)])
        rows.append((rng.choice("de"), rng.choice("cc2"), i, text))
    df = _fragments(spark, rows)
    assert _got(CA.merge_cards(df)) == _merged_by_hand(df, rows)


def test_ratio_containment_and_swap_decide(spark):
    long_ = "Кредитор предоставил должнику заем на рыночных условиях, что подтверждено выписками банка и актами сверки"
    rows = [
        (0, "Суд признал долг реальным по накладным и актам"), (1, "Суд признал долг реальным по накладным и актам!!"),  # ratio
        (2, long_), (3, long_ + ", а также платежными поручениями сторон"),                                    # containment, then the longer text
        (4, long_ + ", а также платежными поручениями сторон спора"),                                          # like the swapped text only
        (5, "Иное"), (6, "Иное"), (7, ""), (8, "Нечто совсем другое по длине и смыслу"),
    ]
    rows = [("d", "c", i, t) for i, t in rows]
    df = _fragments(spark, rows)
    got = _got(CA.merge_cards(df))
    assert got == _merged_by_hand(df, rows)
    assert [w for _, w in got["d", "c"]] == [["w0", "w1"], ["w2", "w3", "w4"], ["w5", "w6"], ["w7"], ["w8"]]


def test_a_hot_card_splits(spark):
    """A card with nearly all fragments, of many lengths: its islands go to several tasks, copies to none."""
    rng = random.Random(4)
    words = ["суд", "долг", "заем", "акт", "реестр", "спор"]
    stems = [" ".join(rng.choice(words) for _ in range(2 ** k)) for k in range(8)]
    rows = [("hot", "c", i, rng.choice(stems) + rng.choice(["", "", " да"])) for i in range(1500)] + [("cold", "c", 9000, "суд")]
    df = _fragments(spark, rows)
    placed = CA.assign_representatives(df)
    islands = placed.filter("doc_id = 'hot'").groupBy("island").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(islands) >= 5 and max(r.n for r in islands) < 600
    assert _got(CA.merge_cards(df)) == _merged_by_hand(df, rows)


def test_reply_parsing(spark):
    text = ("WINDOW_ID: w7\nENTITY_MAP: Иванов — кредитор; физическое лицо\nПетров - должник\nCARD_BLOCKS:\nмусор\n"
            "[send_to: aCard]\n- раз\n- два\n[send_to: bCard]\nнет\n")
    df = spark.createDataFrame([(text, "f"), ("CARD_BLOCKS:\n[send_to: x]\nтекст\n\nабзац", "")], "t string, w string")
    a, b = (r.p for r in df.select(CA.parse_reply(F.col("t"), F.col("w")).alias("p")).collect())
    assert a.window_id == "w7" and [(e.name, list(e.roles)) for e in a.entities] == [
        ("Иванов", ["кредитор", "физическое лицо"]), ("Петров", ["должник"])]
    assert [(c.card, c.text) for c in a.cards] == [("aCard", "- раз\n- два")]
    assert b.window_id == "unknown_window" and b.warnings == ["window_id_missing_fallback_used"]
    frags = df.select(F.transform(CA.parse_reply(F.col("t"), F.col("w"))["cards"], lambda c: CA.split_fragments(c["text"])).alias("f")).collect()
    assert [list(x) for x in frags[0].f] == [["раз", "два"]] and [list(x) for x in frags[1].f] == [["текст", "абзац"]]


def test_answer_wrappers(spark):
    texts = ['{"claim":{}}', '{"result":[{"annotation":{"claim":{}}}]}', '[{"claim":{}}]', "", "{", '{"a":1}}', '{"a":1},{}', '{"result":[]}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("p", AN.parse_answer(F.col("t")))
    got = df.orderBy("i").select(F.to_json(AN.unwrap(F.col("p.answer"))).alias("a"), "p.parse_error").collect()
    assert [r.a for r in got[:3]] == ['{"claim":{}}'] * 3
    assert [r.parse_error for r in got[3:]] == ["empty_answer", "invalid_json", "invalid_json", "invalid_json", "no_useful_part"]


def _answer(value, quote="цитата", source="zone=court_reasoning"):
    return '{"claim":{"claim_type":{"value":"%s","evidence_quote":"%s","evidence_source":"%s","confidence":"high"}}}' % (value, quote, source)


def test_audit_statuses(spark):
    rows = [
        ("conflict", 0, _answer("loan")), ("conflict", 1, _answer("supply")),
        ("rejected", 0, _answer("loan", "")), ("equal", 0, _answer("loan", "", "zone=header")), ("equal", 1, _answer("loan")),
        ("error", 0, "нет"), ("section", 0, '{"lishnee":{}}'), ("cession", 0, _answer("cession")),
    ]
    df = spark.createDataFrame(rows, "doc_id string, extractor_seq bigint, answer_text string").select(
        "*", F.lit("x").alias("extractor"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("skipped")
    )
    a = AU.audit_responses(df)
    status = {r.doc_id: r for r in a.audit.collect()}
    assert {k: v.overall_status for k, v in status.items()} == {
        "conflict": "needs_manual_review", "rejected": "needs_refill", "equal": "needs_refill",
        "error": "needs_manual_review", "section": "needs_manual_review", "cession": "needs_refill",
    }
    assert status["cession"].basket == "cession_or_purchase_of_claim"
    won = {(r.doc_id, r.path): r for r in a.annotation.collect()}
    assert won[("equal", "claim.claim_type")].evidence_quote == "цитата"
    assert won[("rejected", "claim.claim_type")].value == "unknown"
    assert won[("conflict", "claim.claim_type")].audit_warning
    tasks = {r.path for r in a.refill_tasks.filter("doc_id = 'cession'").collect()}
    assert "claim.claim_origin" in tasks and "claim.claim_type" not in tasks


def test_budget(spark):
    cases = [([9000, 100], [False, True]), ([5000, 4000, 3000], [False, True, False]), ([], [])]
    df = spark.createDataFrame([(c[0],) for c in cases], "s array<int>")
    assert [list(r.b) for r in df.select(RE.spend_budget(F.col("s"), 8_000).alias("b")).collect()] == [c[1] for c in cases]


def test_nothing_is_cut_without_a_limit(spark):
    """Texts beyond every former limit stay whole; with a limit, what is left out is named."""
    from actloom.functions import answers as A
    from actloom.functions import cleaning as C

    df = spark.createDataFrame([([9_000, 9_000, 1],)], "s array<int>")
    assert df.select(RE.spend_budget(F.col("s")).alias("b")).first().b == [False] * 3
    fragment = "struct<source:string,text:string,matched_keyword:string,search_stage:string>"
    context = f"struct<path:string,reason:string,source_audit_block:string,fragments:array<{fragment}>,context_chars:int,skipped:boolean>"
    many = [(f"claim.f{i}", "r", "b", [("s", "x" * 3_000, "k", "g")], 3_000, False) for i in range(12)]
    routed = RE.route_contexts(spark.createDataFrame([("d", many)], f"doc_id string, contexts array<{context}>"))
    assert routed.select(F.size("contexts").alias("n"), "left_out").first() == (12, [])
    few = RE.route_contexts(spark.createDataFrame([("d", many)], f"doc_id string, contexts array<{context}>"), 5).first()
    assert len(few.contexts) == 5 and few.left_out == [f"claim.f{i}" for i in range(5, 12)]
    headers = spark.createDataFrame([], "doc_id string, case_number string, act_date string, court_name string, judges array<string>, debtor_name string, dispute_context string")
    entities = spark.createDataFrame([], "doc_id string, name string, roles array<string>, first_seen int")
    whole = RE.refinement_requests(routed, headers, entities).first()
    assert whole.input_text_length > 36_000 and len(whole.target_paths) == 12 and whole.left_out == []
    cut = RE.refinement_requests(routed, headers, entities, max_chars=9_000).first()
    assert cut.input_text_length <= 9_000 and list(cut.target_paths) + list(cut.left_out) == [f"claim.f{i}" for i in range(12)]

    deep = '{"claim":{"a":1}}'
    for _ in range(9):
        deep = '{"result":[' + deep + "]}"
    got = spark.createDataFrame([(deep,), ('{"annotation":{"b":2}}',), ("[1]",)], "t string").select(
        F.to_json(A.unwrap(F.try_parse_json("t"))).alias("u")
    ).collect()
    assert [r.u for r in got] == ['{"claim":{"a":1}}', '{"b":2}', None]
    phone = spark.createDataFrame([("тут 8            (912) 123-45-67 конец",)], "t string").select(C.contacts(F.col("t")).alias("t")).first().t
    assert "912" not in phone


def test_window_order_beyond_five_digits(spark):
    from actloom.operators import requests as RQ
    from actloom.operators import windows as W

    windows = spark.range(99_998, 100_003).select(
        F.lit("d").alias("doc_id"), F.format_string("w%05d", "id").alias("window_id"),
        *[F.lit("z").alias(c) for c in ("zone_id", "zone_type", "text")], *[F.lit(1).alias(c) for c in ("page_start", "page_end")],
        *[F.array(F.lit("x")).alias(c) for c in ("sentence_ids", "date_sentence_ids", "dates")],
    )
    headers = spark.createDataFrame([], "doc_id string, case_number string, act_date string, court_name string, judges array<string>, debtor_name string, dispute_context string")
    got = RQ.annotation_requests(windows, headers).select("annotation_seq").collect()
    assert sorted(r.annotation_seq for r in got) == list(range(99_998, 100_003))
    assert [r.window_id for r in W.first_windows(windows, 3).collect()] == ["w99998", "w99999", "w100000"]


def test_repeated_keys_keep_the_last_value(spark):
    from actloom.operators import audit as AU

    rows = spark.createDataFrame(
        [("d", 1, "x", '{"claim":{"a":{"value":"1"},"a":{"value":"2"}}}', None, False)],
        "doc_id string, extractor_seq bigint, extractor string, answer_text string, error string, skipped boolean",
    )
    got = AU.read_answers(rows).first()
    assert got.parse_error is None and '"2"' in got.answer


def test_conflicts_parse_the_answers_once(spark):
    """The flagged features stand on both sides of the join; parsing is not part of its plan twice."""
    from actloom.plans.queries_records import feature_conflicts

    plan = feature_conflicts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "parse_json" not in plan


def test_only_the_named_half_of_a_reply_is_parsed(spark):
    from actloom.operators import cards as CARDS

    text = "ENTITY_MAP:\nООО А — кредитор\nCARD_BLOCKS:\n[send_to: claimAndDealCard]\n- Договор подписан.\n"
    df = spark.createDataFrame([(text, "w1")], "t string, w string")
    both, cards, names = (
        df.select(CARDS.parse_reply(F.col("t"), F.col("w"), *p).alias("p")).first().p
        for p in ((), (("cards",),), (("entities",),))
    )
    assert cards.cards == both.cards and "entities" not in cards.asDict()
    assert names.entities == both.entities and "cards" not in names.asDict()
