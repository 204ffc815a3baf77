"""Tolerant reading of model answers (JSON text) with VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from actloom.functions import text as T
from actloom.functions.arrays import let
from actloom.lexicon.audit import CONFLICT_MAX_CHARS


#: A JSON object with one of these keys is a feature.
FEATURE_KEYS = ("value", "evidence_quote", "evidence_source", "confidence")


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def is_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def parse_answer(answer: Column) -> Column:
    """``struct<answer VARIANT, parse_error STRING>``.

    A ``result`` object, the head of a ``result`` list or of a top-level list is
    the useful part; otherwise the object itself.
    """

    def useful(v: Column) -> Column:
        result = _at(v, "$.result")
        plain = F.startswith(answer, F.lit("{")) & ~F.contains(answer, F.lit('"result"'))
        part = (
            F.when(plain, v)
            .when(is_array(v), _at(v, "$[0]"))
            .when(is_object(v) & is_array(result), _at(result, "$[0]"))
            .when(is_object(v) & is_object(result), result)
            .when(is_object(v), v)
        )
        return let(part, lambda p: F.when(~F.coalesce(F.is_variant_null(p), F.lit(True)), p))

    def build(v: Column) -> Column:
        return let(
            useful(v),
            lambda u: F.struct(
                u.alias("answer"),
                F.when(T.strip(T.text_or_empty(answer)) == "", "empty_answer")
                .when(v.isNull(), "invalid_json")
                .when(u.isNull(), "no_useful_part")
                .alias("parse_error"),
            ),
        )

    return let(strict_json(answer), build)


def strict_json(text: Column) -> Column:
    """VARIANT of a text that is exactly one JSON value, else NULL.

    The parser ignores what follows the first value. Anything that trails it
    breaks at least one of the two wrappers.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    keyed = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(keyed.isNotNull(), F.try_variant_get(listed, "$[0]", "variant"))


#: Closes the list in which an answer is read; an answer that holds it is not read that way.
_END = "~end~"
#: Fields of a section whose members are all features.
FIELDS = "map<string,struct<value:string,evidence_quote:string,evidence_source:string,confidence:string>>"
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_WS = r"[ \t\r\n]*"
_WRAPPED = rf"\A{_WS}(?:\[|\{{{_WS}\"(?:annotation|result)\"{_WS}:)"
#: One wrapper around an object, brackets in pairs.
_WRAPPER = (
    rf"(?s)\A{_WS}(?:\{{{_WS}\"(?:annotation|result)\"{_WS}:{_WS}(\{{.*\}}){_WS}\}}"
    rf"|\{{{_WS}\"result\"{_WS}:{_WS}\[{_WS}(\{{.*\}}){_WS}\]{_WS}\}}|\[{_WS}(\{{.*\}}){_WS}\]){_WS}\z"
)


def is_plain(text: Column) -> Column:
    """An object without wrapper keys is its own unwrapped form."""
    return (
        F.startswith(text, F.lit("{")) & ~F.contains(text, F.lit('"result"')) & ~F.contains(text, F.lit('"annotation"'))
    )


def bare(answer: Column) -> Column:
    """An answer without its wrapper (unchecked)."""
    inside = F.regexp_replace(answer, F.lit(_WRAPPER), F.lit("$1$2$3"))
    return F.when(F.regexp_like(answer, F.lit(_WRAPPED)), inside).otherwise(answer)


def listed(text: Column) -> Column:
    """A bare answer read as a list that an end mark closes: what trails it, or another shape, breaks the list or its
    schema. Escaped ASCII could write the mark and is left to the other way."""
    escapes = F.contains(text, F.lit("\\u")) & F.regexp_like(text, F.lit(r"\\u(?:00|[dD])"))
    odd = F.contains(text, F.lit(_END)) | escapes | (F.octet_length(text) > 1_000_000)
    whole = F.concat(F.lit("["), F.when(F.startswith(text, F.lit("{")) & ~odd, text), F.lit(f',{{"{_END}":{{}}}}]'))
    return F.from_json(whole, f"array<map<string,{FIELDS}>>", _STRICT)


def regular(found: Column) -> Column:
    """``map<section,map<field,feature>>`` of a listed answer whose sections are objects of whole features, else NULL.

    One pass instead of one for each level. What the other way could read otherwise is left to it: wrappers, repeated
    keys, features that lack a member, members that may not be texts (numbers and lists are written anew there).
    """
    def is_text(x: Column) -> Column:
        # The first byte decides nearly always.
        between = lambda lo, hi: (x >= F.lit(lo)) & (x < F.lit(hi))
        other = between("-", ":") | between("[", "\\") | between("{", "|")
        return ~(other & F.regexp_like(x, F.lit(r"\A(?:[\[{]|-?[0-9][-+.0-9eE]*\z)")))

    def feature_is_whole(f: Column) -> Column:
        a, b, c, d = (is_text(f[name]) for name in FEATURE_KEYS)
        return F.coalesce(a & b & c & d, F.lit(False))

    def no_repeats(m: Column) -> Column:
        return F.size(F.array_distinct(F.map_keys(m))) == F.size(m)

    def section_is_regular(s: Column) -> Column:
        return s.isNotNull() & F.forall(F.map_values(s), feature_is_whole) & no_repeats(s)

    first = F.get(found, F.lit(0))
    only = (F.size(found) == 2) & F.map_contains_key(F.get(found, F.lit(1)), _END)
    wrapped = F.map_contains_key(first, "result") | F.map_contains_key(first, "annotation")
    return F.when(only & ~wrapped & no_repeats(first) & F.forall(F.map_values(first), section_is_regular), first)


def unwrap(v: Column, text: Column | None = None) -> Column:
    """Follow ``annotation`` and ``result`` wrappers to the innermost one; NULL unless an object.

    Every layer is one ``result`` key, so a text holds at most as many layers as that word; ``text`` is the
    JSON text of ``v`` (made from it where not given).
    """

    def inner(x: Column) -> Column:
        """The next layer, or x itself where there is none."""
        annotation, result = _at(x, "$.annotation"), _at(x, "$.result")
        head = _at(result, "$[0]")
        return (
            F.when(is_object(x) & is_object(annotation), x)
            .when(is_object(x) & is_array(result) & is_object(head), head)
            .when(is_object(x) & is_object(result), result)
            .otherwise(x)
        )

    raw = F.coalesce(F.to_json(v) if text is None else text, F.lit(""))
    layers = F.regexp_count(raw, F.lit('"result"'))
    last = F.when(layers == 0, v).otherwise(F.aggregate(F.sequence(F.lit(1), layers), v, lambda x, _: inner(x)))
    return let(
        last,
        lambda x: F.when(is_object(x) & is_object(_at(x, "$.annotation")), _at(x, "$.annotation")).when(is_object(x), x),
    )


def members(json: Column) -> Column:
    """Members of a JSON object as ``map<string,string>`` of raw JSON text."""
    return F.from_json(json, "map<string,string>")


def shape(raw: Column) -> Column:
    """feature, object, empty (object), list or plain; NULL for JSON null."""
    def of_keys(keys: Column) -> Column:
        return (
            F.when(F.arrays_overlap(keys, F.array(*[F.lit(k) for k in FEATURE_KEYS])), "feature")
            .when(F.size(keys) > 0, "object")
            .when(keys.isNotNull(), "empty")
            .when(F.json_array_length(raw).isNotNull(), "list")
            .when(raw.isNotNull(), "plain")
        )

    return let(F.json_object_keys(raw), of_keys)


def _node(path: Column, raw: Column) -> Column:
    return let(shape(raw), lambda kind: F.struct(path.alias("path"), raw.alias("raw"), kind.alias("kind")))


def _with_branch(path: Column, raw: Column, below: Column) -> Column:
    """The members of an object, and the object itself where it is short enough to contradict a value."""
    itself = F.array(F.struct(path.alias("path"), raw.alias("raw"), F.lit("branch").alias("kind")))
    return F.when(F.length(raw) <= CONFLICT_MAX_CHARS, F.concat(itself, below)).otherwise(below)


def first_level(name: Column, raw: Column) -> Column:
    """Members of a section with their shapes; a section that is no object is a leaf itself."""
    fields = F.transform(F.map_entries(members(raw)), lambda m: _node(F.concat(name, F.lit("."), m["key"]), m["value"]))
    return let(
        shape(raw), lambda kind: F.when(kind == "object", _with_branch(name, raw, fields)).otherwise(F.array(_node(name, raw)))
    )


def leaves(path: Column, raw: Column, into_lists: bool = False) -> Column:
    """Leaves below a JSON value to any depth: ``array<struct<path,raw,kind>>``. Lists are leaves, or their items
    ``path[i]`` are opened too. A value opens at most as often as it has opening brackets."""

    def opened(e: Column) -> Column:
        fields = F.transform(
            F.map_entries(members(e["raw"])), lambda m: _node(F.concat(e["path"], F.lit("."), m["key"]), m["value"])
        )
        out = F.when(e["kind"] == "object", _with_branch(e["path"], e["raw"], fields))
        if into_lists:
            place = lambda i: F.concat(e["path"], F.lit("["), i.cast("string"), F.lit("]"))
            items = F.from_json(e["raw"], "array<string>")
            out = out.when(e["kind"] == "list", F.transform(items, lambda x, i: _node(place(i), x)))
        return out.otherwise(F.array(e))

    rounds = F.regexp_count(raw, F.lit(r"[{\[]"))
    start = F.array(_node(path, raw))
    return F.when(rounds == 0, start).otherwise(
        F.aggregate(F.sequence(F.lit(1), rounds), start, lambda found, _: F.flatten(F.transform(found, opened)))
    )
