"""Segmentation, tagging, windows and header on small hand-written acts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from actloom.functions import cleaning as C
from actloom.functions import text as T
from actloom.functions.arrays import let
from actloom.functions.sentences import sentence_edge, sentence_spans
from actloom.operators import header as HE
from actloom.operators import segment as SE
from actloom.operators import windows as WI
from actloom.plans.analyze import accepted_documents, annotation_stage, quarantined, segmented

P1 = (
    "АРБИТРАЖНЫЙ СУД СЕВЕРО-ЗАПАДНОГО ОКРУГА\nПОСТАНОВЛЕНИЕ\n12 января 2021 года Дело № А56-21124/2019\n"
    "Арбитражный суд в составе судей Ивановой А.А., Петрова Б.Б. рассмотрел жалобу.\nустановил:\n"
    "Общество обратилось с заявлением о включении требования в реестр требований кредиторов. "
    "Должник признан банкротом 01.02.2019."
)
P2 = (
    "В кассационной жалобе заявитель просит отменить акты. По мнению подателя, суды ошиблись.\n"
    "Как установлено судами, договор заключен 05.03.2018. Изучив дело, суд округа приходит к следующим выводам.\n"
    "Договор займа подписан 10.04.2017. Деньги выданы сразу. Иной довод отклонен по правилам статьи 71 АПК РФ. "
    "Долг не возвращен. Платеж от 3 мая 2018 года прошел."
)
P3 = "Другой довод. Итог такой 2019 г. Конец.\nПОСТАНОВИЛ:\nОставить без изменения."


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("d1", 1, P1, ["a | b"]), ("d1", 2, P2, None), ("d1", 3, P3, None), ("d2", 1, "Нет маркера. Да.", None),
            ("d3", 1, "установил: спор.", None)]
    pages = spark.createDataFrame(rows, "doc_id string, page int, text string, tables array<string>")
    return segmented(pages).cache()


def test_zones(docs):
    z = {(r.doc_id, r.zone_type): r for r in SE.zone_rows(docs).collect()}
    assert [k[1] for k in sorted(z, key=lambda k: z[k].zone_id) if k[0] == "d1"] == [
        "header", "procedural_history", "party_position", "court_reasoning", "operative_part",
    ]
    weak = z[("d1", "court_reasoning")]
    assert weak.confidence == "medium" and weak.text.startswith("Как установлено судами")
    assert (weak.page_start, weak.page_end) == (2, 3)
    assert z[("d2", "header")].text == "Нет маркера. Да."


def test_conservation_and_offsets(docs):
    assert all(r.ok for r in SE.zone_integrity(docs).collect())
    bad = docs.select("text", F.explode("sentences").alias("s")).filter(
        T.one_line(F.substr("text", F.col("s.sentence_start_offset") + 1,
                            F.col("s.sentence_end_offset") - F.col("s.sentence_start_offset"))) != F.col("s.text")
    )
    assert bad.count() == 0


def test_windows(docs):
    w = WI.window_rows(docs).orderBy("window_id").collect()
    assert [list(r.dates) for r in w] == [["05.03.2018", "10.04.2017"], ["3 мая 2018 года"], []]
    assert w[1].text == "- Долг не возвращен.\n* Платеж от 3 мая 2018 года прошел.\n- Другой довод."
    assert all(set(r.date_sentence_ids) <= set(r.sentence_ids) for r in w)
    c = WI.window_rows(docs, "clean_windows").orderBy("window_id").collect()
    assert c[0].window_id == "sw00001" and c[0].text.startswith("* договор заключен 05.03.2018.")


def test_header_and_quarantine(docs):
    h = {r.doc_id: r for r in HE.case_header(docs).collect()}
    assert h["d1"].case_number == "А56-21124/2019" and h["d1"].act_date == "12 января 2021 года"
    assert h["d1"].judges == ["Ивановой А. А", "Петрова Б. Б"]
    assert {(r.doc_id, r.reason) for r in quarantined(docs).collect()} == {("d3", "header_zone_missing")}
    assert {r.doc_id for r in accepted_documents(docs).collect()} == {"d1", "d2"}


def test_debtor_cases(spark):
    texts = [
        ("по делу о несостоятельности (банкротстве) общества с ограниченной ответственностью «Вектор» (ИНН 1) установил",
         'общества с ограниченной ответственностью "Вектор"'),
        ("акционерное общество «Луч» признано несостоятельным (банкротом)", 'акционерного общества "Луч"'),
        ("без должника", None),
    ]
    got = spark.createDataFrame(texts, "t string, want string").select(
        HE.debtor_name(F.col("t")).alias("got"), "want"
    ).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_sentence_rules(spark):
    text = "Сумма 5 руб. и ст. 3. Судья И. Иванов решил: да.\nПункт:\nследующий! Хвост без точки"
    edge = sentence_edge()
    row = spark.createDataFrame([(text,)], "t string").select(sentence_spans(F.col("t"), edge).alias("s")).head()
    assert [s.text for s in row.s] == ["Сумма 5 руб. и ст. 3.", "Судья И. Иванов решил: да.", "Пункт:", "следующий!", "Хвост без точки"]
    assert all(text[s.start_offset:s.end_offset] == s.text for s in row.s)


def test_zone_machine_against_brute_force(spark):
    rng = random.Random(3)
    cases = [[tuple(rng.random() < p for p in (0.2, 0.1, 0.3)) for _ in range(rng.randint(0, 9))] for _ in range(400)]

    def brute(flags):
        zone, party, reasoning = 0, None, None
        for i, (p, s, w) in enumerate(flags):
            if zone == 0 and p:
                zone, party = 1, i
            elif zone == 0 and s or zone == 1 and (s or (w and i - party >= 2)):
                zone, reasoning = 2, i
        return party, reasoning

    df = spark.createDataFrame(
        [(i, c) for i, c in enumerate(cases)], "i int, f array<struct<party:boolean,strong:boolean,weak:boolean>>"
    )
    got = {r.i: (r.z.party, r.z.reasoning) for r in df.select("i", let(F.col("f"), SE.zone_starts).alias("z")).collect()}
    assert all(got[i] == brute(c) for i, c in enumerate(cases))


def test_anchor_spans_against_brute_force(spark):
    rng = random.Random(5)
    cases = [[rng.random() < 0.3 for _ in range(rng.randint(1, 14))] for _ in range(300)]

    def brute(a):
        out = []
        for i in (i for i, x in enumerate(a) if x):
            if out and i - out[-1][1] <= 2:
                out[-1][1] = i
            else:
                out.append([i, i])
        return [tuple(x) for x in out]

    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, a array<boolean>")
    got = {r.i: [tuple(x) for x in r.g] for r in df.select("i", WI.anchor_groups(F.col("a")).alias("g")).collect()}
    assert all(got[i] == brute(c) for i, c in enumerate(cases))


def test_no_python_in_plan(spark):
    """The segmentation itself: one exchange, no Python; a stage is read back from its table."""
    pages = spark.createDataFrame([("d1", 1, P1, None)], "doc_id string, page int, text string, tables array<string>")
    plan = segmented(pages)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow", plan)
    assert plan.count("Exchange") == 1
    stage = annotation_stage(pages).docs._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in stage and not re.search("Python|Arrow|Exchange", stage)


def test_guards_change_no_text(spark):
    """Tests in front of costly passes: the result is that of the plain passes, on every mix of odd pieces."""
    from actloom.functions import cleaning as C
    from actloom.lexicon import ru_acts as RU
    from actloom.operators import tagging as TA

    pieces = [
        "статьи 71 АПК РФ", "Ст. 5 ГК РФ", "определение ВС РФ", "как следует из материалов дела", "в кассационной жалобе",
        "суд округа полагает", "адрес: Москва", "(,)", "№ 5", "12 3", " ", "  ", "\t", " ", "\x85", "\n", "\n \n", "\n\n\n\n",
        "\r\n", ",", " ,", "\"", "ООО \" ", "конец.Начало", "гражданскоправовой", "- 5 -", "5/7", "слово",
    ]
    rng = random.Random(3)
    rows = [("".join(rng.choice(pieces) + rng.choice(("", " ")) for _ in range(rng.randint(0, 7))),) for _ in range(1500)]
    t = F.col("t")
    plain_space = F.regexp_replace(t, F.lit(r"(?U)\s+"), F.lit(" "))
    cited = F.lit(False)
    for _, p in RU.CITATIONS:
        cited = cited | T.has(t, p)
    marked = [T.has(t, "|".join(f"(?:{p})" for p in ps), "isu") for ps in (RU.PARTY_MARKERS, RU.STRONG_REASONING_MARKERS, RU.WEAK_REASONING_MARKERS)]
    flags = SE.marker_flags(t)
    untidy = F.regexp_like(t, F.lit(C._UNTIDY))
    pages = C._page_numbers(t).eqNullSafe(T.subs(t, RU.PAGE_NUMBER_LINES, flags="imu"))
    same = (
        T.squeeze(t).eqNullSafe(plain_space) & T.two_newlines(t).eqNullSafe(F.regexp_replace(t, F.lit("\n{3,}"), F.lit("\n\n")))
        & T.one_blank(t).eqNullSafe(F.regexp_replace(t, F.lit("[ \t]+"), F.lit(" "))) & TA.is_tagged(t).eqNullSafe(cited) & pages
        & flags["party"].eqNullSafe(marked[0]) & flags["strong"].eqNullSafe(marked[1]) & flags["weak"].eqNullSafe(marked[2])
        & (untidy | C._tidy(t).eqNullSafe(C._unglued(t)))
    )
    df = spark.createDataFrame(rows, "t string")
    assert df.filter(~same).collect() == []


def test_guards_of_cleaning_lose_no_match(spark):
    """Digits and letters outside the usual ranges, and words beside other signs, reach the patterns."""
    from actloom.functions import cleaning as C
    from actloom.lexicon import ru_acts as RU

    pieces = [
        "дом ", "\u0665", "\u1c82фис", "офис", "\u1c84ел.:", "тел. ", "+7", "8", " 912 345-67-89", "(", ")", ",", "ИНН 5", "ул.", "Мира",
        "заявителя", "адрес", ":", " ", "\n", "«", "а@b.ru", "www.ru", "e-mail:", "слово", "5",
    ]
    rng = random.Random(4)
    rows = [("".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))),) for _ in range(1500)] + [("дом \u0665",), ("\u1c82фис",)]
    t = F.col("t")
    same = (
        C.contacts(t).eqNullSafe(T.subs(t, RU.CONTACT_PATTERNS)) & C.identifiers(t).eqNullSafe(T.subs(t, RU.IDENTIFIER_PATTERNS))
        & C.addresses(t).eqNullSafe(T.sub(
            T.subs(t, (RU.ADDRESS_TO_IDENTIFIER, RU.ADDRESS_TO_SAFE_STOP), flags="isu"), RU.ADDRESS_LINE, flags="imu"))
    )
    df = spark.createDataFrame(rows, "t string")
    assert df.filter(~same).collect() == []


def test_kept_sentences_segment_once(spark):
    from actloom.plans.queries_acts import act_kept_sentences

    plan = act_kept_sentences(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_lazy_zone_machine_equals_closed_form(spark):
    rng = random.Random(7)
    rows = [(i, [tuple(rng.random() < 0.2 for _ in range(3)) for _ in range(rng.randrange(9))]) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, f array<struct<party:boolean,strong:boolean,weak:boolean>>")
    out = df.select(let(F.col("f"), SE.zone_starts).alias("a"), SE.zone_starts_of(F.col("f"), lambda x: x).alias("b")).collect()
    for r in out:
        assert (r.a.party, r.a.reasoning) == (r.b.party, r.b.reasoning)
        assert r.a.reasoning is None or r.a.weak == r.b.weak


def test_only_what_is_read_is_made(spark):
    pages = spark.createDataFrame([("d1", 1, P1, None), ("d1", 2, P2, None), ("d1", 3, P3, None)], "doc_id string, page int, text string, tables array<string>")
    some = segmented(pages, clean=False, sentence_fields=("sentence_id", "zone_id", "zone_type", "page_start", "page_end", "text", "dates", "weak_dates"),
                     window_fields=("zone_type", "text"))
    assert "clean_windows" not in some.columns
    assert "norm_text" not in some.schema["sentences"].dataType.elementType.names
    assert set(some.schema["windows"].dataType.elementType.names) == {"window_id", "zone_type", "text", "page_start", "sentence_start_global_index"}
    texts = lambda d: [(r.window_id, r.text) for r in WI.window_rows(d, fields=("window_id", "text")).orderBy("window_id").collect()]
    assert texts(some) == texts(segmented(pages))


def test_lines_that_may_stand_alone(spark):
    texts = ["а\nб", "а\nсуд установил:\nб", "а\n\nб", "а | б\nв", "Р Е Ш И Л\nа", "решил\nвводная часть\nмотивировочная часть", "постановил\n1; 2; 3; 4; 5\nа", "о п р е д е л и л\nа"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(C.restore_paragraphs(F.col("t"))).collect()]
    assert got[0] == "а б" and got[1:4] == texts[1:4] and got[5] == texts[5] and got[6] == texts[6] and got[7] == texts[7]
    odd = spark.createDataFrame([("а​ б﻿\r\n в ",)], "t string").select(T.one_line(F.col("t"))).first()[0]
    assert odd == "а б в"


def test_leading_rows_stop_early_and_fall_back(spark):
    pages = spark.createDataFrame([(i, 1, "x") for i in range(100)] + [(None, 1, "y")], "doc_id int, page int, text string")
    seen = []

    def rows_of(p):
        seen.append(p.count())
        return p.filter("doc_id % 10 = 9")

    got = SE.leading_rows(pages, rows_of, 5, documents_a_row=1).orderBy("doc_id").limit(5)
    assert seen == [5, 101] and [r["doc_id"] for r in got.collect()] == [9, 19, 29, 39, 49]
    seen.clear()
    got = SE.leading_rows(pages, rows_of, 5, documents_a_row=12).orderBy("doc_id").limit(5)
    assert seen == [60] and [r["doc_id"] for r in got.collect()] == [9, 19, 29, 39, 49]


def test_guards_on_bytes(spark):
    texts = ["", " ", "\xa0а ", "а.", "а.\n", "　.", ".", "а \nб", "№ «а»", "\x1cа\x1f", "а​б"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(
        "t", T.strip(F.col("t")).alias("s"), T.strip(F.col("t"), " .").alias("d"), T.may_hold(F.col("t"), "\xa0 ​").alias("m")
    ).collect()
    for r in got:
        assert r["s"] == r["t"].strip(T.WHITESPACE) and r["d"] == r["t"].strip(" .")
        assert r["m"] or not set("\xa0 ​") & set(r["t"])
    assert not {r["t"]: r["m"] for r in got}["а \nб"]
