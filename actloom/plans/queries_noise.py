"""Every noise shape, marker and citation form, planted by key into a text of each customer.

A case is a text with ``{k}`` for the customer's key and what an operator must leave of it; the SQL states the
second from the key alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from actloom.functions import cleaning as C
from actloom.functions import text as T
from actloom.operators import header as HE
from actloom.operators import segment as SE
from actloom.operators import tagging as TA
from actloom.operators import windows as WI
from actloom.plans.corpus import table
from actloom.session import cut_lineage

Cases = tuple[tuple[str, str], ...]

ADDRESSES: Cases = (
    ("ООО Альфа {k}, адрес: 620000, г. Екатеринбург, ул. Мира, 1, ОГРН 1026600000001, ИНН 6600000001, обратилось в суд.",
     "ООО Альфа {k}, обратилось в суд."),
    ("Иванов {k}, место нахождения: г. Пермь, 12.03.2020 обратился.", "Иванов {k}, 12.03.2020 обратился."),
    ("Общество {k}, юридический адрес: г. Уфа (далее - общество) просит.", "Общество {k} (далее - общество) просит."),
    ("620000, ул.Мира, {k}\nДоговор {k} подписан.", "\nДоговор {k} подписан."),
    ("Договор {k} без места.", "Договор {k} без места."),
)
PAGE_NUMBERS: Cases = (
    ("Текст {k}\n12\nконец", "Текст {k}\n\nконец"),
    ("Текст {k}\n- 12 -\nконец", "Текст {k}\n\nконец"),
    ("Текст {k}\nстр. 12\nконец", "Текст {k}\n\nконец"),
    ("Текст {k}\nСтраница 12\nконец", "Текст {k}\n\nконец"),
    ("Текст {k}\n3 / 12\nконец", "Текст {k}\n\nконец"),
    ("Текст {k}\n12 рублей\nконец", "Текст {k}\n12 рублей\nконец"),
)
FIRST_PAGE: Cases = (
    ("12/34-5(6)\nТекст {k}", "\nТекст {k}"),
    ("620000, г. Пермь\nТекст {k}", "\nТекст {k}"),
    ("12/34\nТекст {k}", "12/34\nТекст {k}"),
)
SERVICE: Cases = (
    ("Электронная подпись действительна\nТекст {k}", "\nТекст {k}"),
    ("Документ подписан судьей\nТекст {k}", "\nТекст {k}"),
    ("КОПИЯ ВЕРНА\nТекст {k}", "\nТекст {k}"),
    ("Файл сформирован 01.02.2020\nТекст {k}", "\nТекст {k}"),
    ("kad.arbitr.ru/card/1\nТекст {k}", "\nТекст {k}"),
    ("Мой арбитр\nТекст {k}", "\nТекст {k}"),
    ("Эта копия верна\nТекст {k}", "Эта копия верна\nТекст {k}"),
)
BOILERPLATE: Cases = (
    ("До {k}. Присутствующий в судебном заседании представитель банка пояснил; иные лица участие в судебное заседание не обеспечили. После.",
     "До {k}.  После."),
    ("До {k}. Согласно части 3 статьи 284 Кодекса неявка не препятствие для проведения судебного заседания. После.", "До {k}.  После."),
    ("До {k}. Иные доводы заявителя кассационной жалобы не свидетельствуют о нарушении норм процессуального права. После.", "До {k}.  После."),
    ("До {k}. Поскольку нарушений норм процессуального права нет, основания для удовлетворения кассационной жалобы отсутствуют. После.", "До {k}.  После."),
    ("До {k}. Постановление вступает в законную силу по статье 291 Арбитражного процессуального кодекса Российской Федерации. После.", "До {k}.  После."),
    ("Текст {k}.\nПредседательствующий судья И.И. Иванов\nСудьи П.П. Петров", "Текст {k}."),
    ("Текст {k}.\nПредседательствующий судья\nИванов\nСудьи\nПетров", "Текст {k}."),
    ("Председатель {k} присутствовал.", "Председатель {k} присутствовал."),
)
BREAKS: Cases = (
    ("договор-\nное {k}", "договорное {k}"), ("contra-  \n ct {k}", "contract {k}"), ("12-\n13 {k}", "12-\n13 {k}"),
    ("Дело А40 - 12/2020 и {k}", "Дело А40-12/2020 и {k}"), ("Постановление 17 - АП12 и {k}", "Постановление 17-АП12 и {k}"),
    ("Дело 12/2020 - 3 и {k}", "Дело 12/2020-3 и {k}"), ("счетафактуры {k}", "счета-фактуры {k}"),
    ('ООО Ромашка {k}" и', 'ООО "Ромашка {k}" и'),
)
PAGES: Cases = (
    ("Суд  установил долг {k} .\n- 12 -\nКопия верна\nЗаем , выдан ( ) банком.", "Суд установил долг {k}.\n\nЗаем, выдан банком."),
    ("Долг {k} при-\nзнан судом\nи включен в реестр ,, полностью.", "Долг {k} признан судом и включен в реестр, полностью."),
    # A phone number takes the line end that follows it.
    ("«Альфа» {k} просит;оплатить\nтел. 8 (343) 123-45-67\nсумму .", '"Альфа" {k} просит; оплатить сумму.'),
    ("А40-1/2020\nСрок {k} истек.\nСтраница 3", "Срок {k} истек."),
)
SENTENCES: Cases = (
    ("установил: долг {k} есть.", "долг {k} есть."), ("Суд установил : долг {k} есть.", "долг {k} есть."),
    ("Как видно из материалов дела, долг {k} есть.", "долг {k} есть."), ("Как установлено судами , долг {k} есть.", "долг {k} есть."),
    ("Судами установлено и следует из материалов дела, что долг {k} есть.", "долг {k} есть."),
    ("В судебном заседании {k} опрошен.", "{k} опрошен."), ("В судебных заседаниях {k} опрошен.", "{k} опрошен."),
    ("После перерыва {k} опрошен.", "{k} опрошен."), ("Долг {k} ИНН 123 признан.", "Долг {k} признан."),
    ("Долг {k} (ОГРН 123) признан.", "Долг {k} признан."), ("Долг {k}, адрес: Пермь; признан.", "Долг {k},; признан."),
    ("Руководствуясь статьями 10, 20 АПК РФ, суд признал долг {k}.", "суд признал долг {k}."),
    ("Суд, в соответствии со статьей 71 Кодекса, признал долг {k}.", "Суд признал долг {k}."),
    ("Суд с учетом положений статьи 10 ГК РФ признал долг {k}.", "Суд признал долг {k}."),
    ("установил:", ""), ("ИНН 123 , КПП 456 ;", ""), ("Обычный текст {k}.", "Обычный текст {k}."),
)
# Which of the three kinds of markers a sentence carries.
MARKERS = (
    ("В кассационной жалобе {k} указано", "p"), ("Не согласившись с принятыми актами, {k} возражает", "p"),
    ("Банк {k} обратился с кассационной жалобой", "p"), ("По мнению заявителя, {k} прав", "p"),
    ("Податель жалобы ссылается на {k}", "p"), ("Кассатор указывает на {k}", "p"), ("Заявитель указывает на {k}", "p"),
    ("Изучив материалы {k}, суд округа приходит к следующим выводам", "s"),
    ("По результатам рассмотрения кассационной жалобы суд округа пришел к следующим выводам {k}", "s"),
    ("Кассационная жалоба {k} не подлежит", ""), ("Кассационная жалоба не подлежит удовлетворению {k}", "s"),
    ("Суд кассационной инстанции полагает, что {k}", "s"), ("Суд округа считает, что {k}", "s"),
    ("Суд округа признает выводы судов обоснованными {k}", "s"), ("Судебная коллегия не находит оснований {k}", "s"),
    ("Нарушений норм материального и процессуального права {k} судом кассационной инстанции не установлено", "s"),
    ("Принимая во внимание, что фактические обстоятельства {k} верны, суд кассационной инстанции полагает", "s"),
    ("Как следует из материалов дела {k}", "w"), ("Как установлено судами, {k}", "w"), ("Как установил суд, {k}", "w"),
    ("Судами установлено {k}", "w"), ("Исследовав и оценив доводы сторон {k}", "w"), ("Исследовав и оценив {k}, судами установлена вина", "w"),
    ("Долг {k} погашен", ""),
)
# Sentence, category of the first hit, the hit and its short key.
CITATIONS = (
    ("По правилам статьи 71 АПК РФ долг {k} есть.", "code_articles", "статьи 71 АПК РФ", "71 АПК РФ"),
    ("По пункту 2 статьи 142 Закона о банкротстве {k}.", "bankruptcy_law_articles", "пункту 2 статьи 142 Закона о банкротстве", "2 Закона о банкротстве"),
    ("Федеральный закон от 26.10.2002 № 127-ФЗ {k}.", "federal_laws", "Федеральный закон от 26.10.2002 № 127-ФЗ", "№ 127-ФЗ от 26.10.2002"),
    ("Решение Арбитражного суда Пермского края от 01.02.2020 по делу № А50-{k}/2019 верно.", "lower_court_cases",
     "Решение Арбитражного суда Пермского края от 01.02.2020 по делу № А50-{k}/2019", "А50-{k}/2019"),
    ("Обзор судебной практики Верховного Суда Российской Федерации, утвержденный 29.01.2020, и {k}.", "supreme_court_reviews",
     "Обзор судебной практики Верховного Суда Российской Федерации, утвержденный 29.01.2020", "29.01.2020"),
    ("Долг {k} признан.", None, None, None),
)

# A phrase for each subject rule, and one without a subject. To ask for bankruptcy alone (14) is no dispute.
SUBJECTS = (
    "во включении в реестр требований кредиторов", "об исключении из списка реестр кредиторов", "о включении требования", "об установлении требования",
    "о процессуальном правопреемстве", "о замене кредитора", "с просьбой заменить кредитора", "замена кредитора", "о недействительности договора",
    "об оспаривании", "об очередности требования", "о субординации", "о взыскании задолженности", "о признании должника несостоятельным",
    "о признании банкротом и включении", "о прекращении производства по делу о банкротстве", "о погашении требования кредитора", "о переносе заседания",
)
# Zone texts (header, history, party's position) with the subject that is read from them, its source and its score:
# the source's weight, the words' points, and 4 where two words read as a name with initials.
DISPUTES = (
    ("по заявлению банка {k} о включении требования в реестр требований кредиторов в рамках дела о банкротстве", "", "",
     "по заявлению банка {k} о включении требования в реестр требований кредиторов", "header", 32),
    ("по спору о недействительности сделки {k} УСТАНОВИЛ", "", "", "по спору о недействительности сделки {k}", "header", 31),
    ("о включении требования {k} в реестр требований кредиторов", "", "", "о включении требования {k} в реестр требований кредиторов", "header", 18),
    ("по иску банка {k}, обратившегося в суд, о взыскании задолженности", "", "", "по иску банка {k}, обратившегося в суд, о взыскании задолженности", "header", 22),
    ("", "Банк {k} обратился в суд с заявлением о процессуальном правопреемстве.", "", "Банк {k} обратился в суд с заявлением о процессуальном правопреемстве", "procedural_history", 22),
    ("", "В арбитражный суд поступило заявление банка {k} об оспаривании сделки.", "", "В арбитражный суд поступило заявление банка {k} об оспаривании сделки", "procedural_history", 14),
    ("", "Банк {k} обратился с ходатайством о замене кредитора.", "", "Банк {k} обратился с ходатайством о замене кредитора", "procedural_history", 14),
    ("", "Банк {k} просил включить требование в реестр требований кредиторов.", "", "Банк {k} просил включить требование в реестр требований кредиторов", "procedural_history", 14),
    ("", "", "Банк {k} обратился с заявлением о субординации. В кассационной жалобе банк возражает.", "Банк {k} обратился с заявлением о субординации", "party_position", 18),
    ("о банкротстве {k}", "Суд {k} открыл заседание.", "", None, None, None),
)


def _planted(spark, sf_dir, cases, *more: str):
    """Each customer's case: its number and its text, with the key put in."""
    k = F.col("c_custkey")
    texts = F.array(*[F.replace(F.lit(c[0]), F.lit("{k}"), k.cast("string")) for c in cases])
    i = (k % len(cases)).cast("int")
    return table(spark, sf_dir, "customer").select("c_custkey", *more, i.alias("i"), F.get(texts, i).alias("before"))


def _cleaned(cases: Cases, clean: Callable[[Column], Column], name: str):
    def query(spark, sf_dir):
        return _planted(spark, sf_dir, cases).select("c_custkey", clean(F.col("before")).alias("text"))

    query.__name__ = name
    return query


def _as_sql(value: str | None) -> str:
    if value is None:
        return "NULL"
    spelt = value.replace("'", "''").replace("\n", "' || chr(10) || '")
    return "('" + spelt.replace("{k}", "' || c_custkey || '") + "')"


def _expected(cases: Cases) -> str:
    ways = " ".join(f"WHEN {i} THEN {_as_sql(after)}" for i, (_, after) in enumerate(cases))
    return f"SELECT c_custkey, CASE c_custkey % {len(cases)} {ways} END AS text FROM customer"


_CLEANED = {
    "noise_addresses": (ADDRESSES, C.addresses),
    "noise_page_numbers": (PAGE_NUMBERS, C.page_number_lines),
    "noise_service_lines": (SERVICE, C.service_lines),
    "noise_boilerplate": (BOILERPLATE, C.boilerplate),
    "noise_breaks": (BREAKS, lambda t: C.repair_breaks(C.join_hyphens(t))),
    "noise_pages": (PAGES, lambda t: C.clean_page(t, F.lit(False), F.lit("А40-1/2020"))),
    "noise_sentences": (SENTENCES, WI.clean_sentence),
}


def noise_first_page(spark, sf_dir):
    """Lines that go from a first page only: every second text is one."""
    rows = _planted(spark, sf_dir, FIRST_PAGE)
    return rows.select("c_custkey", C.first_page_lines(F.col("before"), F.floor(F.col("c_custkey") / len(FIRST_PAGE)) % 2 == 0).alias("text"))


def noise_windows(spark, sf_dir):
    """Windows whose members clean to something else or to nothing; one without its anchor is dropped."""
    text = lambda s: F.replace(F.lit(s), F.lit("{k}"), F.col("c_custkey").cast("string"))

    def window(i: int, members: list[tuple[str, str]], anchors: list[str]) -> Column:
        sentences = F.array(*[F.struct(F.lit(n).alias("sentence_id"), text(s).alias("text")) for n, s in members])
        return F.struct(
            F.lit(f"w{i:05d}").alias("window_id"), sentences.alias("sentences"), F.array(*[F.lit(n) for n, _ in members]).alias("sentence_ids"),
            F.array(*[F.lit(n) for n in anchors]).alias("date_sentence_ids"), F.lit("").alias("text"),
        )

    windows = F.array(
        window(1, [("s1", "Долг {k} есть 01.02.2020."), ("s2", "ИНН 123")], ["s1"]),
        window(2, [("s3", "Установил :"), ("s4", "Иное {k}.")], ["s3"]),
        window(3, [("s5", "установил: акт {k} от 01.02.2020."), ("s6", "Иное.")], ["s5"]),
    )
    docs = WI.sanitize_windows(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), windows.alias("windows")))
    return docs.select("doc_id", F.inline("clean_windows")).select(
        "doc_id", "window_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("date_sentence_ids", ",").alias("anchors"), "text"
    )


def zone_markers(spark, sf_dir):
    """Party, strong and weak reasoning markers of every form."""
    rows = _planted(spark, sf_dir, MARKERS).select("c_custkey", SE.marker_flags(T.match_text(F.col("before"), blank_numbers=True)).alias("f"))
    return rows.select("c_custkey", "f.party", "f.strong", "f.weak")


def citation_forms(spark, sf_dir):
    """First citation of a sentence with its category and short key."""
    hits = TA.tag(T.reference_text(F.col("before")))
    rows = _planted(spark, sf_dir, CITATIONS).select("c_custkey", F.get(hits, F.lit(0)).alias("h"))
    return rows.select("c_custkey", "h.category", "h.value", TA.short_reference(F.col("h.category"), F.col("h.value")).alias("short_value"))


def dispute_subjects(spark, sf_dir):
    """Which texts name a subject that a dispute can have: a phrase for every rule."""
    cases = tuple((f"Банк {{k}} обратился с заявлением {s}", "") for s in SUBJECTS)
    rows = _planted(spark, sf_dir, cases)
    return rows.select("c_custkey", HE.has_subject(F.lower("before")).alias("has_subject"), HE.looks_like_application(F.col("before")).alias("application"))


def dispute_candidates(spark, sf_dir):
    """The best candidate by score over all zones, and the one that the header's rules of priority choose."""
    k = F.col("c_custkey")
    i = (k % len(DISPUTES)).cast("int")
    text = lambda part: F.replace(F.get(F.array(*[F.lit(d[part]) for d in DISPUTES]), i), F.lit("{k}"), k.cast("string"))
    parts = cut_lineage(table(spark, sf_dir, "customer").select(
        k.alias("doc_id"), text(0).alias("h"), text(1).alias("ph"), text(2).alias("pp"), F.lit("").alias("cr")
    ), "parts")
    best = HE.best_candidates(HE.candidate_rows(parts))
    chosen = parts.select("doc_id", HE.dispute_context(F.col("h"), F.col("ph"), F.col("pp"), F.col("cr")).alias("chosen"))
    return chosen.join(best, "doc_id", "left").select("doc_id", "chosen", "source", "text", F.col("score").cast("bigint").alias("score"))


QUERIES = {name: _cleaned(cases, clean, name) for name, (cases, clean) in _CLEANED.items()}
QUERIES |= {f.__name__: f for f in (noise_first_page, noise_windows, zone_markers, citation_forms, dispute_subjects, dispute_candidates)}


def _forms(part: int) -> str:
    return f"CASE c_custkey % {len(CITATIONS)} " + " ".join(f"WHEN {i} THEN {_as_sql(c[part])}" for i, c in enumerate(CITATIONS)) + " END"


_KINDS = f"CASE c_custkey % {len(MARKERS)} " + " ".join(f"WHEN {i} THEN '{m}'" for i, (_, m) in enumerate(MARKERS)) + " END"

_DISPUTE = f"CASE doc_id % {len(DISPUTES)} " + " ".join(f"WHEN {i} THEN {_as_sql(d[3])}" for i, d in enumerate(DISPUTES)) + " END"
_SOURCE = ", ".join(f"({i}, {_as_sql(d[4])}, {'NULL' if d[5] is None else d[5]})" for i, d in enumerate(DISPUTES))

ORACLES = {name: _expected(cases) for name, (cases, _) in _CLEANED.items()}
ORACLES |= {
    "noise_first_page": f"""
SELECT c_custkey, CASE WHEN c_custkey // {len(FIRST_PAGE)} % 2 = 0 THEN a.text ELSE b.text END AS text
FROM ({_expected(FIRST_PAGE)}) a JOIN ({_expected(tuple((x, x) for x, _ in FIRST_PAGE))}) b USING (c_custkey)""",
    "noise_windows": """
SELECT c_custkey AS doc_id, 'sw00001' AS window_id, 's1' AS sentence_ids, 's1' AS anchors, '* Долг ' || c_custkey || ' есть 01.02.2020.' AS text FROM customer
UNION ALL
SELECT c_custkey, 'sw00002', 's5,s6', 's5', '* акт ' || c_custkey || ' от 01.02.2020.' || chr(10) || '- Иное.' FROM customer""",
    "dispute_subjects": f"""
SELECT c_custkey, c_custkey % {len(SUBJECTS)} <> {len(SUBJECTS) - 1} AS has_subject, c_custkey % {len(SUBJECTS)} NOT IN (14, {len(SUBJECTS) - 1}) AS application
FROM customer""",
    "dispute_candidates": f"""
SELECT doc_id, {_DISPUTE.replace("c_custkey", "doc_id")} AS chosen, source, {_DISPUTE.replace("c_custkey", "doc_id")} AS text, score::BIGINT AS score
FROM (SELECT c_custkey AS doc_id FROM customer) JOIN (VALUES {_SOURCE}) AS s(i, source, score) ON i = doc_id % {len(DISPUTES)}""",
    "zone_markers": f"SELECT c_custkey, k = 'p' AS party, k = 's' AS strong, k = 'w' AS weak FROM (SELECT c_custkey, {_KINDS} AS k FROM customer)",
    "citation_forms": f"SELECT c_custkey, {_forms(1)} AS category, {_forms(2)} AS value, {_forms(3)} AS short_value FROM customer",
}
