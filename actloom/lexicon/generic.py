"""Small language-neutral lexicon for plain multilingual text."""

from __future__ import annotations

from actloom.functions.dates import DateLexicon

DATES = DateLexicon(
    months=(
        "january", "february", "march", "april", "may", "june",
        "july", "august", "september", "october", "november", "december",
    ),
    year_words=r"",
    year_tail=r"",
)

CITATIONS = (
    ("ipv4", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("phone", r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3}[ .-]?\d{2,4}"),
    ("long_number", r"\b\d{12,19}\b"),
    ("year", r"\b(?:19|20)\d{2}\b"),
    ("licence", r"(?:MIT|Apache|GPL|BSD|Creative Commons)[^.\n]{0,20}"),
)
