"""Words and patterns of Russian court acts.

Fixed values: the phrases, abbreviations and formats below define what counts as
a marker, a citation or noise, so they must have exactly this content for results
to be right. All are applied case-insensitively with Unicode word boundaries.
"""

from __future__ import annotations

from actloom.functions.dates import DateLexicon
from actloom.functions.text import spaced

# ---- fixed values: dates ---------------------------------------------------

DATES = DateLexicon(
    months=(
        "января", "февраля", "марта", "апреля", "мая", "июня",
        "июля", "августа", "сентября", "октября", "ноября", "декабря",
    ),
    year_words=r"(?:года|г\.)",
    year_tail=r"(?:\s*г(?:ода|\.)?)?",
)

# ---- fixed values: case number ---------------------------------------------

CASE_NUMBER = r"[АA]\d{1,4}\s*-\s*\d+(?:\s*/\s*\d{2,4}|\s*-\s*\d{2,4})"
CASE_NUMBER_LABELLED = rf"\bДело\s*№\s*({CASE_NUMBER})"
CASE_NUMBER_SHORT = r"[АA]\d{1,4}\s*-\s*\d+[/\-]\d{2,4}"

# ---- fixed values: sentence ends -------------------------------------------

ABBREVIATIONS = (
    "т", "д", "п", "ч", "ст", "абз", "рис", "см", "им", "ул", "г", "гр",
    "руб", "коп", "тыс", "млн", "млрд",
)
PROTECTED_ABBREVIATIONS = (
    "руб.", "коп.", "млн.", "млрд.", "тыс.", "г.", "ул.", "д.", "лит.", "стр.",
    "корп.", "пом.", "оф.", "офис.", "ст.", "п.", "пп.", "ч.", "абз.",
    "т.д.", "т.п.", "т.е.", "в т.ч.",
)

# ---- fixed values: zone markers --------------------------------------------

ESTABLISHED = (
    rf"(?:{spaced('установил')}(?:а)?|{spaced('суд')}\s+{spaced('установил')}"
    r"|установил(?:а)?|суд\s+установил(?:а)?|судом\s+установлено|установлено\s+следующее)\s*:?"
)
RULED_LINE = (
    rf"^[ \t]*(?:{spaced('постановил')}(?:а)?|постановил(?:а)?|определил(?:а)?|решил(?:а)?)"
    r"[ \t]*:?[ \t]*$"
)
HEADING_LINE = (
    r"^\s*(?:"
    rf"установил(?:а)?|{spaced('суд')}\s+{spaced('установил')}(?:а)?|{spaced('установил')}(?:а)?"
    rf"|решил(?:а)?|постановил(?:а)?|{spaced('постановил')}(?:а)?"
    rf"|определил(?:а)?|{spaced('определил')}(?:а)?"
    r"|вводная\s+часть|описательная\s+часть|мотивировочная\s+часть|резолютивная\s+часть"
    r")\s*:?\s*$"
)
PARTY_MARKERS = (
    r"\bв\s+кассационн(?:ой|ых)\s+жалоб(?:е|ах)\b",
    r"\bне\s+согласившись\s+с\s+(?:принят(?:ым|ыми)|судебн(?:ым|ыми)|постановлени(?:ем|ями)"
    r"|определени(?:ем|ями)|решени(?:ем|ями))\b",
    r"\bобратил(?:ся|ась|ись)\s+с\s+кассационн(?:ой|ыми)\s+жалоб(?:ой|ами)\b",
    r"\bпо\s+мнению\s+(?:заявителя|подателя|кассатора)\b",
    r"\bподатель\s+жалоб[ы]?\s+ссылается\b",
    r"\bкассатор\s+указывает\b",
    r"\bзаявитель\s+указывает\b",
)
_BOARD = r"судебная\s+коллегия(?:\s+суда\s+кассационной\s+инстанции)?|коллегия\s+суда\s+кассационной\s+инстанции"
_NO_GROUNDS = r"не\s+находит(?:\s+[а-яё]+){0,3}\s+основани[йя]"
STRONG_REASONING_MARKERS = (
    r"\b(?:изучив|исследовав|заслушав|рассмотрев|проверив|обсудив)[\s\S]{0,1400}?"
    rf"(?:{_BOARD}|арбитражный\s+суд\s+[а-яё\s]+округа|суд\s+кассационной\s+инстанции|суд\s+округа)"
    r"[\s\S]{0,400}?(?:приход(?:ит|ят)\s+к\s+следующим\s+выводам|приш[её]л\s+к\s+следующим\s+выводам"
    r"|пришла\s+к\s+следующим\s+выводам|приходит\s+к\s+выводу|приш[её]л\s+к\s+выводу"
    rf"|{_NO_GROUNDS}|не\s+усматривает\s+оснований)\b",
    r"\bпо\s+результатам\s+рассмотрения\s+кассационн(?:ой|ых)\s+жалоб(?:ы)?\s+"
    r"суд\s+(?:округа|кассационной\s+инстанции)\s+приш[её]л\s+к\s+следующим\s+выводам\b",
    r"\bкассационн(?:ая|ые)\s+жалоб(?:а|ы)\s+не\s+подлеж(?:ит|ат)\s+удовлетворению\b",
    r"\bсуд\s+кассационной\s+инстанции\s+(?:считает|полагает|приходит\s+к\s+выводу"
    r"|приходит\s+к\s+следующим\s+выводам)\b",
    r"\bсуд\s+округа\s+(?:считает|полагает|приходит\s+к\s+выводу"
    r"|приходит\s+к\s+следующим\s+выводам|приш[её]л\s+к\s+выводу)\b",
    r"\bсуд\s+округа\s+призна[её]т\s+выводы\s+судов\s+обоснованными\b",
    rf"\b(?:{_BOARD})\s+(?:считает|полагает|приходит\s+к\s+выводу|приходит\s+к\s+следующим\s+выводам"
    rf"|{_NO_GROUNDS}|не\s+усматривает\s+основани[йя])\b",
    r"\bнарушений\s+норм\s+материального\s+и\s+процессуального\s+права[\s\S]{0,300}?"
    r"судом\s+кассационной\s+инстанции\s+не\s+установлено\b",
    r"\bпринимая\s+во\s+внимание\s*,?\s+что\s+фактические\s+обстоятельства[\s\S]{0,700}?"
    r"суд\s+кассационной\s+инстанции\s+полагает\b",
)
WEAK_REASONING_MARKERS = (
    r"\bкак\s+(?:видно|следует|усматривается)\s+из\s+материалов\s+дела\b",
    r"\bкак\s+установлено\s+судами\b",
    r"\bкак\s+установил(?:и)?\s+суд(?:ы)?\b",
    r"\bсудами\s+установлено\b",
    r"\bисследовав\s+и\s+оценив\s+доводы\s+сторон\b",
    r"\bисследовав\s+и\s+оценив[\s\S]{0,250}?судами\s+установлен[аоы]?\b",
)

# One of these words is part of every match of the markers above (in lower case).
PARTY_WORDS = ("жалоб", "согласившись", "мнению", "кассатор", "заявитель")
STRONG_REASONING_WORDS = ("вывод", "находит", "усматривает", "подлеж", "считает", "полагает", "установлено")
WEAK_REASONING_WORDS = ("материалов", "установ", "исследовав")
# Opening of every match of the markers in lower-case text, for ``text.opens``.
MARKER_OPENINGS = (
    r"в(?U:\s)|н(?iuU:е\s|ару)|о(?iu:брат|бсу)|п(?iuU:о\s|одат|ров|рин)|к(?iuU:асс|олл|ак\s)|з(?iu:аяв|асл)|и(?iu:зуч|ссл)"
    r"|р(?iu:асс)|с(?iu:уд)"
)

# ---- fixed values: page noise ----------------------------------------------

CONTACT_PATTERNS = (
    r"\bhttps?://[^\s]+",
    r"\bwww\.[^\s]+",
    r"\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b",
    r"\b(?:тел\.?|телефон|факс)\s*:?\s*(?:\+?7|8)?\s*\(?\d{3,5}\)?[\s-]*\d[\d\s().-]{5,}",
    r"(?<![\w№/-])(?:\+7|8)\s*\(?\d{3,5}\)?[\s-]*\d[\d\s().-]{6,}",
    r"\b(?:e-mail|email|эл\.?\s*почта)\s*: ?",
    r"\b(?:тел\.?|телефон|факс)\s*: ?",
)
ADDRESS_LABEL = r"(?:адрес|юридический\s+адрес|почтовый\s+адрес|место\s+нахождения|местонахождение)"
ADDRESS_TO_IDENTIFIER = (
    rf",?\s*\b{ADDRESS_LABEL}\s*:\s*.*?(?:\b(?:ОГРН|ОГРНИП|ИНН|КПП)\s*№?\s*\d+\s*,?\s*)+"
    r"(?=\s*(?:\(|,|\.|;|\z))"
)
ADDRESS_TO_SAFE_STOP = (
    rf",?\s*\b{ADDRESS_LABEL}\s*:\s*.*?"
    r"(?=\s*(?:\(\s*далее\b|далее\s*[-–—]|,\s*\d{2}\.\d{2}\.\d{4}\b|\z))"
)
STREET_WORDS = (
    r"ул\.|улица|пр\.|просп\.|проспект|пер\.|переулок|пл\.|площадь|наб\.|набережная|ш\.|шоссе"
    r"|б-р|бульвар|д\.|дом\s+\d+|корп\.|корпус|стр\.|строение|лит\.|пом\.|офис"
)
ADDRESS_LINE = rf"^\s*(?:\d{{6}},\s*)?(?=[^\n]*\b(?:{STREET_WORDS})\b)[^\n]*$"
IDENTIFIER_PATTERNS = (
    r"\bОГРН(?:ИП)?\s*№?\s*\d+\b",
    r"\bИНН\s*№?\s*\d+\b",
    r"\bКПП\s*№?\s*\d+\b",
    r"\(\s*,\s*\)",
    r"\(\s*\)",
)
PAGE_NUMBER_LINES = (
    r"^\s*\d{1,4}\s*$",
    r"^\s*-+\s*\d{1,4}\s*-+\s*$",
    r"^\s*стр\.?\s*\d{1,4}\s*$",
    r"^\s*страница\s*\d{1,4}\s*$",
    r"^\s*\d{1,4}\s*/\s*\d{1,4}\s*$",
)
FIRST_PAGE_LINES = (
    r"^\s*\d+/\d+-\d+(?:\(\d+\))?\s*$",
    r"^\s*\d{6},.*$",
)
SERVICE_LINES = (
    r"^\s*электронная подпись.*$",
    r"^\s*документ подписан.*$",
    r"^\s*копия верна.*$",
    r"^\s*файл сформирован.*$",
    r"^\s*kad\.arbitr\.ru.*$",
    r"^\s*мой арбитр.*$",
)
# Openings of every match of the patterns above, for ``text.opens``; their first letters are given in both cases.
CONTACT_WORDS = (
    r"[тТ](?iuU:ел\.?\s*[:+(\d]|елефон\s*[:+(\d])|[фФ](?iuU:акс\s*[:+(\d])|[эЭ](?iuU:л\.?\s*почта\s*:)"
)
CONTACT_SIGNS = (
    r"[@:wWeE8](?:(?<=@)|(?<=:)//|(?<=[wW])(?iu:ww\.)|(?<=[eE])(?iuU:-?mail\s*:)"
    r"|(?<=8)(?U:[\s\d().-]{10}))|[+]7(?U:[\s\d().-]{10})"
)
ADDRESS_WORDS = r"[аА](?iuU:дрес\s*:)|[мМ](?iuU:есто(?:\s+нахождения|нахождение)\s*:)"
STREETS = (
    r"[уУ](?iuU:л\.\w|лица\b)|[пП](?iuU:(?:р|росп|ер|л|ом)\.\w|роспект\b|ереулок\b|лощадь\b)|[нН](?iuU:аб\.\w|абережная\b)"
    r"|[шШ](?iuU:\.\w|оссе\b)|[бБ](?iuU:-р\b|ульвар\b)|[дД](?iuU:\.\w|ом\s+\d)|[кК](?iuU:орп\.\w|орпус\b)"
    r"|[сС](?iuU:тр\.\w|троение\b)|[лЛ](?iuU:ит\.\w)|[оО](?iuU:фис\b)"
)
IDENTIFIER_WORDS = r"[оО](?iu:грн)|[иИ](?iu:нн)|[кК](?iu:пп)"
EMPTY_BRACKETS = r"[(](?U:\s*,?\s*)[)]"
SERVICE_WORDS = (
    r"[эЭ](?iu:лектронная подпись)|[дД](?iu:окумент подписан)|[кК](?iu:опия верна)|[фФ](?iu:айл сформирован)"
    r"|[мМ](?iu:ой арбитр)"
)
SERVICE_SIGNS = r"(?iu:[.]arbitr)"
BOILERPLATE_SPANS = (
    r"Присутствующий\s+в\s+судебном\s+заседании\s+представитель.*?судебное\s+заседание\s+не\s+обеспечили\.",
    r"Согласно\s+части\s+3\s+статьи\s+284.*?проведения\s+судебного\s+заседания\.",
    r"Иные\s+доводы\s+заявителя\s+кассационной\s+жалобы.*?процессуального\s+права\.",
    r"Поскольку\s+нарушений\s+норм\s+процессуального\s+права.*?кассационной\s+жалобы\s+отсутствуют\.",
    r"Постановление\s+вступает\s+в\s+законную\s+силу.*?Арбитражного\s+процессуального\s+кодекса"
    r"\s+Российской\s+Федерации\.",
)
SIGNATURE_BLOCK = r"\n?\s*Председательствующий\s+судья\s*\n?.*?\n\s*Судьи\s*\n?.*\z"
SIGNATURE_NAME = (
    r"\n?\s*Председательствующий\s+судья\s+[А-ЯЁ]\.\s*[А-ЯЁ]\.\s*[А-ЯЁ][а-яё]+.*\z"
)
GLUED_WORDS = {
    "счетафактуры": "счета-фактуры",
    "информационнотелекоммуникационной": "информационно-телекоммуникационной",
    "гражданскоправовой": "гражданско-правовой",
}

# ---- fixed values: citations -----------------------------------------------

_ARTICLE_WORD = (
    r"(?:стат(?:ья|ьи|ей|е|ями|ях)|ст\.|част(?:ь|и|ью|ей|ями|ях)|ч\.|пункт[а-я]*|п\.)"
)
_ARTICLE_LIST = r"\d+(?:\.\d+)?(?:\s*(?:,|и|-)\s*\d+(?:\.\d+)?)*"
_CODE_NAME = (
    r"(?:АПК\s*РФ|ГК\s*РФ|Арбитражного\s+процессуального\s+кодекса\s+Российской\s+Федерации"
    r"|Гражданского\s+кодекса\s+Российской\s+Федерации|Кодекса)"
)
_PLENUM = (
    r"Пленума\s+(?:Высшего\s+Арбитражного\s+Суда|Верховного\s+Суда)\s+Российской\s+Федерации\s+"
    r"от\s+\d{2}\.\d{2}\.\d{4}(?:\s*года|\s*г\.)?\s*№\s*\d+"
)
CITATIONS = (
    ("code_articles", rf"\b{_ARTICLE_WORD}\s*{_ARTICLE_LIST}.{{0,140}}?\b{_CODE_NAME}"),
    (
        "bankruptcy_law_articles",
        rf"\b{_ARTICLE_WORD}\s*{_ARTICLE_LIST}.{{0,180}}?(?:Закона\s+о\s+банкротстве"
        r"|Федерального\s+закона\s+[^.]{0,120}?О\s+несостоятельности\s*\(\s*банкротстве\s*\))",
    ),
    (
        "federal_laws",
        r"\bФедеральн(?:ый|ого)\s+закон[а-я]*\s+от\s+\d{2}\.\d{2}\.\d{4}\s*№\s*[\w\-ФЗ]+",
    ),
    ("plenum_points", rf"\bпункт[а-я]*\s+\d+(?:\.\d+)?\s+постановлени[ея]\s+{_PLENUM}"),
    ("plenum_resolutions", rf"\bпостановлени[еяию]\s+{_PLENUM}"),
    (
        "supreme_court_reviews",
        r"\bОбзор[а-я\s]+судебной\s+практики\s+(?:Верховного\s+Суда\s+Российской\s+Федерации"
        r"|Президиума\s+Верховного\s+Суда).{0,160}?(?:утвержден[а-я\s]+)?\d{2}\.\d{2}\.\d{4}",
    ),
    (
        "supreme_court_reviews_short",
        r"\bпункт[а-я]*\s+\d+(?:\.\d+)?\s+Обзор[а-я\s]+судебной\s+практики\s+от\s+\d{2}\.\d{2}\.\d{4}",
    ),
    (
        "supreme_court_definitions",
        r"\bопредел\w{0,12}\s+(?:Судебной\s+коллегии\s+по\s+экономическим\s+спорам\s+)?"
        r"(?:Верховн\w+\s+Суд\w+\s+Российск\w+\s+Федерац\w+|ВС\s*РФ)"
        r"(?:.{0,80}?(?:от\s+\d{2}\.\d{2}\.\d{4})?(?:.{0,40}?№\s*[\wА-Яа-яЁё\-()/]+)?)?",
    ),
    (
        "lower_court_cases",
        r"\b(?:решени[ея]|определени[ея]|постановлени[ея])\s+(?:Арбитражного\s+суда|[А-ЯЁа-яё\s]+суда)"
        rf".{{0,160}}?от\s+\d{{2}}\.\d{{2}}\.\d{{4}}.{{0,120}}?\bпо\s+делу\s*№\s*{CASE_NUMBER_SHORT}",
    ),
)
# Opening of every match of a citation, for ``text.opens``: in front of a digit where one must follow.
CITATION_WORDS = (
    r"(?:[сС](?iu:тат[а-я]{1,3}|т\.)|[чЧ](?iu:аст[а-я]{1,3}|\.)|[пП](?iu:ункт[а-я]*|\.))(?U:\s*\d)"
    r"|[фФ](?iu:едеральн)|[пП](?iu:остановлени)|[оО](?iu:бзор|предел)|[рР](?iu:ешени)"
)
CITED_ZONES = ("procedural_history", "party_position", "court_reasoning")
WINDOW_ZONES = ("court_reasoning",)

# ---- fixed values: window cleaning -----------------------------------------

WINDOW_REMOVALS = (
    # service prefixes
    rf"^\s*{spaced('судустановил')}\s*:?\s*",
    rf"^\s*{spaced('установил')}\s*:?\s*",
    r"^\s*как\s+(?:видно|следует|усматривается)\s+из\s+материалов\s+дела\s*,?\s*",
    r"^\s*как\s+установлено\s+судами\s*,?\s*",
    r"^\s*судами\s+установлено\s+и\s+следует\s+из\s+материалов\s+дела\s*,?\s*что\s*",
    # hearing prefixes
    r"^\s*в\s+судебном\s+заседании\s+",
    r"^\s*в\s+судебных\s+заседаниях\s+",
    r"^\s*после\s+перерыва\s+",
    # addresses and requisites
    r"\bадрес\s*:\s*[^.;]*",
    r"\bИНН\s*\d+",
    r"\bОГРН\s*\d+",
    r"\bКПП\s*\d+",
    r"\(\s*,?\s*\)",
)
# Opening of every match of the removals, for ``text.opens``; prefixes count at the beginning only.
WINDOW_REMOVAL_WORDS = (
    r"(?<=\A\n)(?iuU:с\s*у\s*д|у\s*с\s*т|как\s|в\s|после\s)"
    r"|[аА](?iu:дрес)|[иИ](?iu:нн)|[оО](?iu:грн)|[кК](?iu:пп)"
)
# Part of every match of the legal tails, which may begin within a word.
WINDOW_LEGAL_WORDS = r"[рР](?iu:ф)|[фФ](?iu:едерации)|[кК](?iu:одекса)"
WINDOW_LEGAL_TAILS = (
    r"\s*,?\s*руководствуясь\s+статьями\s+[^.]*?(?:Российской\s+Федерации|АПК\s*РФ|ГК\s*РФ)\s*,?",
    r"\s*,?\s*в\s+соответствии\s+с\s+положениями\s+статей\s+[^.]*?(?:Российской\s+Федерации|АПК\s*РФ|ГК\s*РФ)\s*,?",
    r"\s*,?\s*в\s+соответствии\s+со\s+статьей\s+\d+(?:\.\d+)?\s+(?:Кодекса|АПК\s*РФ|ГК\s*РФ)\s*,?",
    r"\s*,?\s*с\s+учетом\s+положений\s+статьи\s+\d+(?:\.\d+)?\s+(?:Кодекса|АПК\s*РФ|ГК\s*РФ)\s*,?",
)
