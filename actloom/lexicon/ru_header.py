"""Patterns for requisites, debtor names and the subject of a dispute.

Fixed values: formulas of Russian court acts; the content must stay exactly so.
"""

from __future__ import annotations

from actloom.functions.text import spaced
from actloom.lexicon.ru_acts import CASE_NUMBER_SHORT

# ---- fixed values: requisites ----------------------------------------------

_WORD_DATE = r"(\d{1,2}\s+[а-яА-ЯёЁ]+\s+\d{4}\s+года)"
_DOT_DATE = r"(\d{1,2}\.\d{1,2}\.\d{4})"
CASE_NUMBER = rf"\b{CASE_NUMBER_SHORT}\b"
ACT_DATES = (
    rf"Постановление\s+изготовлено\s+в\s+полном\s+об[ъьё]еме\s+{_WORD_DATE}",
    rf"Постановление\s+в\s+полном\s+об[ъьё]еме\s+изготовлено\s+{_WORD_DATE}",
    rf"Полный\s+текст\s+постановления\s+изготовлен\s+{_WORD_DATE}",
    rf"Полный\s+текст\s+постановления\s+изготовлен\s+{_DOT_DATE}",
    rf"{_WORD_DATE}\s+Дело\s*№",
    rf"{_DOT_DATE}\s+Дело\s*№",
    rf"Дело\s*№\s*{CASE_NUMBER_SHORT}\s+{_WORD_DATE}",
    rf"Дело\s*№\s*{CASE_NUMBER_SHORT}\s+{_DOT_DATE}",
    rf"г\.\s*[А-ЯЁа-яё\- ]+\s+{_WORD_DATE}\b",
)
COURT_NAME = r"АРБИТРАЖНЫЙ\s+СУД\s+[А-ЯЁ\s\-]+?ОКРУГА"
PANEL = (
    r"в\s+составе\s*:?\s*(.+?)(?:при\s+ведении\s+протокола|при\s+участии|рассмотрев|рассмотрел|установил)"
)
JUDGE = (
    r"\b[А-ЯЁ][а-яё]+(?:ой|ова|ева|ина|енко|ко|их|ых|ая|ий|ый|ев|ин|ов|ын)?\s+[А-ЯЁ]\.?\s*[А-ЯЁ]\.?"
)

# ---- fixed values: organisations -------------------------------------------

ORG_FORMS = (
    r"общество\s+с\s+ограниченной\s+ответственностью",
    r"общества\s+с\s+ограниченной\s+ответственностью",
    r"обществу\s+с\s+ограниченной\s+ответственностью",
    r"обществом\s+с\s+ограниченной\s+ответственностью",
    r"общество\s+с\s+ограниченной\s+ответственности",
    r"общества\s+с\s+ограниченной\s+ответственности",
    r"обществу\s+с\s+ограниченной\s+ответственности",
    r"обществом\s+с\s+ограниченной\s+ответственности",
    r"закрытое\s+акционерное\s+общество",
    r"закрытого\s+акционерного\s+общества",
    r"закрытому\s+акционерному\s+обществу",
    r"закрытым\s+акционерным\s+обществом",
    r"открытое\s+акционерное\s+общество",
    r"открытого\s+акционерного\s+общества",
    r"открытому\s+акционерному\s+обществу",
    r"открытым\s+акционерным\s+обществом",
    r"публичное\s+акционерное\s+общество",
    r"публичного\s+акционерного\s+общества",
    r"публичному\s+акционерному\s+обществу",
    r"публичным\s+акционерным\s+обществом",
    r"акционерное\s+общество",
    r"акционерного\s+общества",
    r"акционерному\s+обществу",
    r"акционерным\s+обществом",
    "ООО", "АО", "ПАО", "ОАО", "ЗАО",
)
ORG = f"(?:{'|'.join(ORG_FORMS)})"
SHORT_ORG = r"(?:общество|общества|обществу|обществом)"
# Nominative, dative and instrumental forms become genitive.
ORG_GENITIVE = (
    (r"^(?:общество|обществу|обществом)\s+с\s+ограниченной\s+ответственност(?:ью|и)\b",
     "общества с ограниченной ответственностью"),
    (r"^общества\s+с\s+ограниченной\s+ответственности\b", "общества с ограниченной ответственностью"),
    (r"^акционерн(?:ое\s+общество|ому\s+обществу|ым\s+обществом)\b", "акционерного общества"),
    (r"^закрыт(?:ое\s+акционерное\s+общество|ому\s+акционерному\s+обществу|ым\s+акционерным\s+обществом)\b",
     "закрытого акционерного общества"),
    (r"^открыт(?:ое\s+акционерное\s+общество|ому\s+акционерному\s+обществу|ым\s+акционерным\s+обществом)\b",
     "открытого акционерного общества"),
    (r"^публичн(?:ое\s+акционерное\s+общество|ому\s+акционерному\s+обществу|ым\s+акционерным\s+обществом)\b",
     "публичного акционерного общества"),
)
IDENTIFIER_WORDS = "ИНН|ОГРН|ОГРНИП|КПП"
TECHNICAL_BRACKETS = (
    rf"\((?=[^)]*(?:{IDENTIFIER_WORDS}|адрес|далее|место нахождения|местонахождение))[^)]*\)"
)
LABELLED_IDENTIFIER = rf"\b(?:{IDENTIFIER_WORDS})\s*[:№]?\s*\d+"
LABELLED_ADDRESS = r"\bадрес\s*:\s*[^.;]+"
ORG_FRAGMENT_END = (
    r"\s*(?:\(\s*далее\b|,?\s*адрес\b|,?\s*ИНН\b|,?\s*ОГРН\b|,?\s*ОГРНИП\b|,?\s*КПП\b|;)"
)
ORG_REQUISITES = (
    r"\s*(?:,?\s*\(|,?\s*адрес\b|,?\s*ИНН\b|,?\s*ОГРН\b|,?\s*ОГРНИП\b|,?\s*КПП\b|,?\s*далее\b)"
)
ORG_BAD_LEAD = r"\b(?:Определением|Постановлением|Решением|Судом|Арбитражный\s+суд)\b"
ORG_STOP = (
    rf"(?:\s+(?:и\s+)?{spaced('установил')}|\s+(?:и\s+)?установил(?:а)?|\s+с\s+заявлени\w+"
    r"|\s+обратил\w+|\s+обрати\w+|\s+в\s+арбитражн\w+\s+суд|,?\s*принят\w*\s+по\s+заявлени\w+"
    r"|\s+по\s+заявлени\w+|\s+несостоятельн\w+|\s+банкрот\w+|\s+признан\w+|\s+введен\w+"
    r"|\s+открыт\w+|\s+утвержден\w+|\s+на\s+определени\w+|\s+на\s+постановлени\w+"
    r"|\s+третье\s+лицо|\s+задолженност\w+\s+по\s+договор\w+|\s+по\s+результатам\s+проведени\w+"
    r"|\s+о\s+процессуальн\w+\s+правопреемств\w+)"
)
ORG_TAILS = (
    rf"\s+(?:и\s+)?{spaced('установил')}.*",
    rf"\s+(?:и\s+)?{spaced('суд')}\s+{spaced('установил')}.*",
    r"\s+установил(?:а)?\s*:?.*",
    r"[,;\s]+принят\w*\s+по\s+заявлени\w+.*",
    r"\s+по\s+заявлени\w+.*",
    r"\s+в\s+арбитражн\w+\s+суд.*",
    r"\s+обратил\w+.*",
    r"\s+обрати\w+.*",
    r"[,;\s]+и\s+в\s+рамках\s+дела.*",
    r"\s+с\s+требовани\w+.*",
    r"\s+с\s+заявлени\w+.*",
    r"\s+о\s+включени\w+.*",
    r"\s+об\s+установлени\w+.*",
    r"\s+о\s+признани\w+.*",
    r"\s+об\s+изменени\w+.*",
    r"\s+несостоятельн\w+.*",
    r"\s+банкрот\w+.*",
    r"\s+утвержден\w+.*",
    r"[,;\s]+введен\w+.*",
    r"\s+открыт\w+.*",
    r"\s+на\s+определени\w+.*",
    r"\s+на\s+постановлени\w+.*",
    r"\s+третье\s+лицо.*",
    r"\s+задолженност\w+\s+по\s+договор\w+.*",
    r"\s+по\s+результатам\s+проведени\w+.*",
    r"\s+о\s+процессуальн\w+\s+правопреемств\w+.*",
)
ORG_CASE_TAIL = r"\s+(?:по\s+делу|по\s+заявлению|в\s+рамках\s+дела)\b"
LAST_ORG = (
    rf"((?:{ORG}|{SHORT_ORG})\s+\".+?\")(?=\s*(?:,|\(|;|\z|несостоятельн|банкрот|признан|введен|открыт))"
)

# ---- fixed values: debtor formulas -----------------------------------------

_INSOLVENCY = r"(?:несостоятельност\w*\s*\(\s*банкротств\w*\s*\)|банкротств\w*)"
DEBTOR_FORMULAS = (
    # after the insolvency formula
    rf"(?:по|в\s+рамках|в)\s+дел\w*(?:\s*№?\s*{CASE_NUMBER_SHORT})?\s+о\s+{_INSOLVENCY}\s+(.{{0,650}})",
    rf"дел[аеу]?\s+(?:о|от)\s+{_INSOLVENCY}\s+(.{{0,650}})",
    rf"о\s+{_INSOLVENCY}\s+(.{{0,650}})",
    r"в\s+отношении\s+(.{0,500})",
    # before it
    r"(?:дел[ае]|в\s+рамках\s+дела|производство\s+по\s+делу)\s+о\s+признании\s+(.{0,420}?)"
    r"\s+несостоятельн\w*\s*\(\s*банкрот\w*\s*\)",
    r"(?:заявлени\w+|ходатайств\w+)\s+о\s+признании\s+(.{0,420}?)\s+несостоятельн\w*\s*\(\s*банкрот\w*\s*\)",
    r"(?:заявлени\w+|ходатайств\w+)\s+о\s+признании\s+(.{0,420}?)\s+банкрот\w*",
    r"(.{0,420}?)\s+(?:был[оа]?\s+)?признан\w*\s+(?:несостоятельн\w*\s*)?\(?банкрот\w*\)?",
    r"(.{0,420}?)\s+введен\w*\s+процедур\w+\s+(?:наблюдения|банкротства|конкурсного\s+производства)",
    # register of claims
    r"реестр\s+требований\s+кредиторов\s+(.{0,420})",
    r"реестр\s+кредиторов\s+(.{0,420})",
)
DEBTOR_STATUS = r"\bпризнан\w*\s+несостоятельн\w*\s*\(\s*банкрот\w*\s*\)"
DEBTOR_PROCEEDINGS = (
    rf"производств\w+\s+по\s+дел\w+\s+о\s+{_INSOLVENCY}\s+(.{{0,650}})",
    rf"дел[аеу]?\s+о\s+{_INSOLVENCY}\s+(.{{0,650}})",
)

# ---- fixed values: subject of the dispute ----------------------------------

COURT_LEAD = (
    rf"^(?:{spaced('установил')}(?:а)?|{spaced('суд')}\s+{spaced('установил')}(?:а)?"
    r"|установил(?:а)?|установил\s+следующее|судом\s+установлено)\s*:?\s*"
)
DISPUTE_BRACKETS = (
    r"\(далее\s*[-–]\s*[^)]*\)",
    rf"\((?=[^)]*(?:адрес|{IDENTIFIER_WORDS}|далее|место нахождения))[^)]*\)",
    LABELLED_ADDRESS,
    LABELLED_IDENTIFIER,
)
LOWER_COURT_START = (
    r"(?=\bТребования\s+основаны\b|\bОпределением\b|\bПостановлением\b|\bРешением\b|\bНе\s+соглас"
    r"|\bВ\s+кассационн|\bКассационн(?:ая|ые)\s+жалоб|\bВ\s+судебном\s+заседании|\bПредставител"
    r"|\bИные\s+лица|\bЗаконность\b|\bИзучив\b|\bПроверив\b|\bСуд\s+округа\b"
    r"|\bСуд\s+кассационной\s+инстанции\b)"
)
COMPLAINT_GROUNDS = (
    r"\b(?:В\s+обоснование\s+(?:кассационной\s+)?жалоб[ыи]|Заявитель\s+указывает"
    r"|По\s+мнению\s+заявител[яь]|Кассационная\s+жалоба\s+мотивирована)\b"
)
PARTY_CUT = (
    r"\b(?:В\s+кассационн(?:ой|ых)\s+жалоб|Не\s+согласившись|Кассационн(?:ая|ые)\s+жалоб"
    r"|Податель\s+жалобы|По\s+мнению\s+подателя\s+жалобы)\b"
)
_ESTABLISHED_STOP = rf"\s+УСТАНОВИЛ|\s+{spaced('устан')}"
_ROOM_STOP = rf"\s+{spaced('Суду')}|\s+В\s+судебном\s+заседании|\s+В\s+помещении"
HEADER_DISPUTES = (
    r"(по\s+заявлени\w+\s+(?!отказано|удовлетворено)[\s\S]{0,1600}?)(?=(?:\s+в\s+рамках\s+дела\s+о"
    rf"|\s+в\s+деле\s+о|\s+по\s+делу\s+о|{_ESTABLISHED_STOP}|{_ROOM_STOP}|\z))",
    r"(по\s+спору\s+о[\s\S]{0,1200}?)(?=(?:\s+в\s+рамках\s+дела\s+о|\s+по\s+делу\s+о"
    rf"|{_ESTABLISHED_STOP}|\z))",
    r"(о\s+включении[\s\S]{0,900}?требовани[\s\S]{0,900}?)(?=(?:\s+в\s+рамках\s+дела\s+о"
    rf"|\s+по\s+делу\s+о|{_ESTABLISHED_STOP}|\z))",
    r"(по\s+иску\s+[\s\S]{0,1000}?\s+о\s+[\s\S]{0,500}?)"
    rf"(?=(?:{_ESTABLISHED_STOP}|{_ROOM_STOP}|\z))",
)
APPLICATIONS = (
    rf"((?:(?:{ORG})\s+[^.!?]{{0,260}}|[А-ЯЁA-Z][^.!?]{{0,220}})\s+\d{{1,2}}\.\d{{1,2}}\.\d{{4}}\s+"
    r"(?:обратил\w*|обрати\w*)[\s\S]{0,700}?с\s+заявлени\w+[\s\S]{0,900})",
    r"((?:В\s+рамках\s+дела|В\s+деле|В\s+настоящем\s+деле)[\s\S]{0,900}?(?:обратил\w*|обрати\w*)"
    r"[\s\S]{0,900}?с\s+заявлени\w+[\s\S]{0,900})",
    r"((?:[А-ЯЁA-Z][^.!?]{0,500}?)(?:обратил\w*|обрати\w*)[\s\S]{0,700}?с\s+заявлени\w+[\s\S]{0,900})",
    r"((?:В\s+арбитражн\w+\s+суд[\s\S]{0,300}?)?поступил\w*\s+(?:заявлени\w+|требовани\w+|ходатайств\w+)"
    r"[\s\S]{0,1200})",
    r"([А-ЯЁA-Z][^.!?]{0,500}?(?:обратил\w*|обрати\w*)[\s\S]{0,500}?с\s+ходатайств\w+[\s\S]{0,900})",
    r"([А-ЯЁA-Z][^.!?]{0,500}?просил\w*\s+включить[\s\S]{0,900})",
    r"((?:требовани\w+|заявлени\w+)[\s\S]{0,300}?о\s+включении[\s\S]{0,900})",
    r"(по\s+заявлени\w+\s+(?!отказано|удовлетворено)[\s\S]{0,1200})",
)
LAWSUIT = r"(Иск\s+заявлен\s+[^.!?]{0,900}?\s+о\s+взыскании\s+[^.!?]{0,500})"

# Each inner tuple is a rule: every group must be present, a group by any of its words.
SUBJECT_RULES = (
    (("реестр требований кредиторов",),),
    (("реестр кредиторов",),),
    (("включени", "включить", "включено"), ("требован",)),
    (("установлени", "установить"), ("требован",)),
    (("процессуальн",), ("правопреемств",)),
    (("замене кредитора",),),
    (("заменить кредитора",),),
    (("замена кредитора",),),
    (("недействительн",), ("сдел", "договор", "операц", "платеж")),
    (("оспаривани",),),
    (("очередност",), ("требован",)),
    (("субординац",),),
    (("о взыскании",), ("денежн", "задолжен")),
    (("признании должника несостоятельным",),),
    (("признании",), ("банкрот",), ("включени",)),
    (("прекращени",), ("производств",), ("банкротств",)),
    (("погашени",), ("требован",), ("кредитор",)),
)
INITIATION_WORDS = ("о признании", "банкрот")
INITIATION_EXCLUDED = (
    "реестр", "требован", "очередност", "субординац", "правопреемств", "недействительн", "оспарив",
)
ACT_LEAD = r"^\s*(?:Определением|Постановлением|Решением)\b"
ACT_WORD = r"\b(?:Определением|Постановлением|Решением)\b"
LOWER_COURT_RESULT = (
    r"\b(?:суд\s+первой\s+инстанции|апелляционн\w+\s+суд|суд\s+апелляционной\s+инстанции"
    r"|нижестоящ\w+\s+суд|оставлен\w+\s+без\s+изменения|заявление\s+[^.;]{0,160}?удовлетворено"
    r"|в\s+удовлетворении\s+[^.;]{0,180}?отказано|производство\s+по\s+[^.;]{0,180}?прекращено"
    r"|требовани\w+\s+[^.;]{0,180}?признан\w+\s+обоснованн\w+|включен\w+\s+в\s+[^.;]{0,80}?реестр)\b"
)
COMPLAINT_TALK = (
    r"\b(?:кассационн\w+\s+жалоб|апелляционн\w+\s+жалоб|не\s+согласившись|подател[ьи]\s+жалоб"
    r"|заявител[ьи]\s+жалоб|по\s+мнению|указывает\s+на|ссылает\w+\s+на|довод\w+\s+жалоб)\b"
)
FILED = r"\b(?:обратил\w*|обрати\w*|поступил\w*|просил\w*\s+включить|просит\s+включить)\b"
RESULT_PHRASE = (
    r"\b(?:заявление\s+[^.;]{0,120}?удовлетворено|в\s+удовлетворении\s+[^.;]{0,120}?отказано"
    r"|производство\s+по\s+[^.;]{0,120}?прекращено|требовани\w+\s+[^.;]{0,160}?признан\w+\s+обоснованн\w+)\b"
)
FILED_LOOSE = r"(?:обратил\w*|обрати\w*|поступил\w*|просил\w*\s+включить)"
PARTIAL_APPLICATION = r"\bпо\s+заявлению\s+в\s+указанной\s+части\b"
APPLICATION_WORDS = (
    "по заявлен", "с заявлен", "с ходатайств", "поступило заявлен", "поступило требован",
    "поступило ходатайство", "обратил", "обрати", "просило включить", "просил включить",
    "просила включить", "просит включить", "просили признать", "по спору о",
)
SOURCE_PRIORITY = ("header", "procedural_history", "party_position", "court_reasoning_head")
SOURCE_WEIGHTS = {"header": 10, "procedural_history": 6, "party_position": 2, "court_reasoning_head": -8}
# Each entry: weight, then groups of words as in SUBJECT_RULES.
SCORE_RULES = (
    (10, (("по заявлен",),)),
    (9, (("по спору о",),)),
    (8, (("обратил", "обрати", "поступило заявлен"),)),
    (8, (("реестр требований кредиторов", "реестр кредиторов"),)),
    (8, (("процессуальн",), ("правопреемств",))),
    (8, (("недействительн",),)),
    (8, (("очередност", "субординац"),)),
)
