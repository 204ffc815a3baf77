"""Merge, validate and score model features; derive the final category.

All of it works on one long table ``features(doc_id, extractor_seq, extractor,
path, value, evidence_quote, evidence_source, confidence, is_feature, kind)``. Merging
is a set operation: aggregates with map-side combine, no per-document fold.
``kind`` is the shape of an answer's leaf: feature, list, plain; ``branch`` marks a short
object whose members are rows of their own (it takes part in conflicts only).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actloom.functions import answers as A
from actloom.functions import text as T
from actloom.functions.arrays import let, settled, stage
from actloom.lexicon import audit as L
from actloom.session import cut_lineage

FEATURE_COLUMNS = (
    "doc_id", "extractor_seq", "extractor", "path", "value",
    "evidence_quote", "evidence_source", "confidence", "is_feature", "kind",
)
_FEATURE_TYPE = "value string, evidence_quote string, evidence_source string, confidence string"


# --------------------------------------------------------- single-feature tests

def is_unknown(value: Column) -> Column:
    return _unknown_key(T.audit_key(value), value)


def _unknown_key(key: Column, value: Column) -> Column:
    return F.coalesce(key.isin(*L.UNKNOWN_MARKERS) | (value == "[]"), F.lit(True)) | value.isNull()


def semantic_key(value: Column) -> Column:
    return T.audit_key(value)


def is_technical_source(source: Column) -> Column:
    return let(T.audit_key(source), _technical_key)


def _technical_key(key: Column) -> Column:
    return F.startswith(key, F.lit("zone=header")) | F.startswith(key, F.lit("derived:"))


def has_evidence(quote: Column, source: Column) -> Column:
    def with_key(key: Column) -> Column:
        return _evidence(quote, key)

    return let(T.audit_key(source), with_key)


def _evidence(quote: Column, source_key: Column) -> Column:
    return ~source_key.isin("", "none") & (~T.is_blank(quote) | _technical_key(source_key))


def field_of(path: Column) -> Column:
    return F.element_at(F.split(path, r"\."), -1)


def section_of(path: Column) -> Column:
    return F.get(F.split(plain_path(path), r"\."), F.lit(0))


def plain_path(path: Column) -> Column:
    """Path without leading ``annotation.`` prefixes."""
    return F.regexp_replace(T.strip(T.text_or_empty(path)), F.lit(r"^(annotation\.)+"), F.lit(""))


def is_binary(path: Column) -> Column:
    return field_of(path).isin(*L.BINARY_FIELDS)


def normalize_binary(path: Column, value: Column) -> Column:
    """yes / no words of binary fields become ``yes`` / ``no``.

    This runs before the unknown test, so "не установлено" counts as ``no`` here.
    """
    return let(T.audit_key(value), lambda k: _binary_word(path, k, value))


def _binary_word(path: Column, key: Column, value: Column) -> Column:
    # The key is looked at first: few values are such words, and the path must be split.
    return (
        F.when(key.isin(*L.YES_WORDS) & is_binary(path), "yes")
        .when(key.isin(*L.NO_WORDS) & is_binary(path), "no")
        .otherwise(value)
    )


def judged(features: DataFrame) -> DataFrame:
    """Adds normalised value, key and the known / evidence / accepted flags."""
    out = features.withColumns({"value_key": T.column_key(F.col("value")), "_source": T.column_key(F.col("evidence_source"))})
    out = out.withColumn("value", _binary_word(F.col("path"), F.col("value_key"), F.col("value")))
    # The words that stand for a binary value are their own keys.
    key = F.when(F.col("value").isin("yes", "no"), F.col("value")).otherwise(F.col("value_key"))
    evidence = ~F.col("is_feature") | _evidence(F.col("evidence_quote"), F.col("_source"))
    quoted = ~T.is_blank(F.col("evidence_quote"))
    out = out.withColumns({"value_key": key, "quoted": quoted, "_evidence": evidence}).drop("_source")
    out = out.withColumn("known", ~_unknown_key(F.col("value_key"), F.col("value")))
    return out.withColumn("accepted", F.col("known") & F.col("_evidence")).drop("_evidence")


# ----------------------------------------------------------- reading of answers

def read_answers(responses: DataFrame) -> DataFrame:
    """Adds ``regular``, ``answer`` and ``parse_error``.

    ``regular`` holds the sections of an answer that is made of whole features only, read in one pass. Of the others
    ``answer`` is the unwrapped object as JSON text; of repeated keys the last counts.
    """
    responses.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    text = F.col("answer_text")
    ready = ~F.coalesce(F.col("skipped"), F.lit(False)) & F.col("error").isNull()
    made = ("parse_error", "answer", "regular")
    found = _with_regular(responses.select(*[c for c in responses.columns if c not in made]), ready)
    parsed = found.withColumn("_p", F.when(ready & F.col("regular").isNull(), A.parse_answer(text)))
    answer = (
        F.when(F.col("_p.answer").isNull(), F.lit(None).cast("string")).when(A.is_plain(text), text)
        .otherwise(F.to_json(A.unwrap(F.col("_p.answer"))))
    )
    opened = parsed.withColumns({"parse_error": F.col("_p.parse_error"), "answer": answer}).drop("_p")
    return settled(opened, "parse_error", "answer")


def _with_regular(responses: DataFrame, ready: Column) -> DataFrame:
    out = responses.withColumn("_bare", F.when(ready, A.bare(F.col("answer_text"))))
    out = out.withColumn("_listed", A.listed(F.col("_bare"))).drop("_bare")
    return settled(out.withColumn("regular", A.regular(F.col("_listed"))).drop("_listed"), "regular")


def section_rows(answers: DataFrame) -> DataFrame:
    """One row per section of a usable answer: its ``body`` as JSON text, or the ``fields`` of a regular one. Members
    of an ``annotation`` object inside the answer are sections too (``inner``)."""
    usable = answers.filter(F.col("parse_error").isNull() & (F.col("regular").isNotNull() | F.col("answer").isNotNull()))

    def rows_of(members: Column, inner: bool, fields: bool = False) -> Column:
        none = F.lit(None)
        return F.transform(F.map_entries(members), lambda m: F.struct(
            m["key"].alias("section"), (none.cast("string") if fields else m["value"]).alias("body"),
            (m["value"] if fields else none.cast(A.FIELDS)).alias("fields"), F.lit(inner).alias("inner"),
        ))

    opened = F.when(F.col("regular").isNotNull(), rows_of(F.col("regular"), False, True)).otherwise(
        rows_of(A.members(F.col("answer")), False)
    )
    rows = usable.select("doc_id", "extractor_seq", "extractor", F.inline(opened)).filter(
        ~F.col("section").isin(*L.IGNORED_SECTIONS)
    )
    whole = F.array(F.struct("section", "body", "fields", "inner"))
    routed = F.when(
        (F.col("section") == "annotation") & F.json_object_keys("body").isNotNull(), rows_of(A.members(F.col("body")), True)
    ).otherwise(whole)
    return rows.select("doc_id", "extractor_seq", "extractor", F.inline(routed))


def features_from_sections(sections: DataFrame) -> DataFrame:
    """Long feature table from routed sections: every leaf of an answer, whatever its shape.

    A leaf is a feature, a list or a plain value; objects are opened to any depth, and a section may itself be
    a leaf. JSON nulls and empty objects state nothing. The derived section is ignored.
    """
    wanted = sections.filter(
        F.col("section").isin(*L.SECTIONS) & ((F.col("section") != "economic_dispute") | F.col("inner"))
    )
    read = F.transform(F.map_entries("fields"), lambda m: F.struct(
        F.concat(F.col("section"), F.lit("."), m["key"]).alias("path"), F.lit(None).cast("string").alias("raw"),
        F.lit("feature").alias("kind"), m["value"].alias("f"),
    ))

    def opened(leaf: Column) -> Column:
        deep = F.when(leaf["kind"] == "object", A.leaves(leaf["path"], leaf["raw"])).otherwise(F.array(leaf))
        return F.transform(deep, lambda x: F.struct(
            x["path"].alias("path"), x["raw"].alias("raw"), x["kind"].alias("kind"),
            F.when(x["kind"] == "feature", F.from_json(x["raw"], _FEATURE_TYPE)).alias("f"),
        ))

    by_shape = F.flatten(F.transform(A.first_level(F.col("section"), F.col("body")), opened))
    leaves = wanted.select(
        "doc_id", "extractor_seq", "extractor", F.inline(F.when(F.col("fields").isNotNull(), read).otherwise(by_shape))
    )
    return _leaf_features(leaves.filter("kind <> 'empty'")).select(*FEATURE_COLUMNS)


def _leaf_features(rows: DataFrame) -> DataFrame:
    """Value, quote, source and confidence of leaves (path, raw, kind and f, the parsed feature)."""
    return rows.withColumns({
        "is_feature": F.col("kind") == "feature",
        "value": F.when(F.col("kind") == "feature", F.col("f.value")).otherwise(F.col("raw")),
        **{c: F.col(f"f.{c}") for c in ("evidence_quote", "evidence_source", "confidence")},
    }).drop("f", "raw")


def structural_warnings(sections: DataFrame) -> DataFrame:
    """Sections nobody asked for, and model-supplied derived sections."""
    section, inner = F.col("section"), F.col("inner")
    derived = (section == "economic_dispute") & ~inner
    return sections.select(
        "doc_id",
        F.when(derived | inner, F.concat(F.lit("annotation."), section)).otherwise(section).alias("path"),
        F.when(derived, "llm_economic_dispute_ignored_basket_is_derived_only")
        .when(~section.isin(*L.SECTIONS) & inner, "unexpected_section_from_extractor")
        .when(~section.isin(*L.SECTIONS), "unexpected_top_level_section_from_extractor")
        .alias("reason"),
        "extractor",
    ).filter(F.col("reason").isNotNull())


def extractor_errors(answers: DataFrame) -> DataFrame:
    problem = F.coalesce("parse_error", "error")
    return answers.filter(problem.isNotNull()).select(
        "doc_id",
        F.concat(F.lit("schema_extractions."), F.col("extractor")).alias("path"),
        problem.alias("reason"),
    )


def metadata_features(headers: DataFrame) -> DataFrame:
    """Requisites as features with source ``zone=header``; they rank first."""
    def entry(field: str, value: Column, source: str, quote: Column | None = None) -> Column:
        filled = value.isNotNull() & ~value.isin("", "[]")
        return F.struct(
            F.lit(f"metadata.{field}").alias("path"),
            F.when(filled, value).otherwise("unknown").alias("value"),
            F.when(filled, T.audit_text(value) if quote is None else quote).otherwise("").alias("evidence_quote"),
            F.when(filled, source).otherwise("none").alias("evidence_source"),
            F.when(filled, "high").otherwise("low").alias("confidence"),
        )

    dispute = entry("dispute_context", F.col("dispute_context"), "zone=header/procedural_history")
    entries = F.array(
        entry("case_number", F.col("case_number"), "zone=header"),
        entry("act_date", F.col("act_date"), "zone=header"),
        entry("court_name", F.col("court_name"), "zone=header"),
        entry("judge_name", F.to_json("judges"), "zone=header", F.array_join("judges", "; ")),
        entry("debtor_name", F.col("debtor_name"), "zone=header"),
        F.when(F.col("dispute_context").isNotNull(), dispute),
    )
    return headers.select(
        "doc_id",
        F.lit(-1).cast("bigint").alias("extractor_seq"),
        F.lit("header").alias("extractor"),
        F.inline(F.filter(entries, lambda e: e.isNotNull())),
        F.lit(True).alias("is_feature"), F.lit("feature").alias("kind"),
    ).select(*FEATURE_COLUMNS)


# ----------------------------------------------------------------------- merge

@dataclass(frozen=True)
class Merged:
    annotation: DataFrame
    rejected: DataFrame
    conflicts: DataFrame


def rejected_features(flagged: DataFrame) -> DataFrame:
    return flagged.filter(F.col("is_feature") & F.col("known") & ~F.col("accepted")).select(
        "doc_id", "path", "value", "evidence_quote", "evidence_source",
        F.lit("filled_value_without_required_evidence").alias("reason"),
    )


def winners(flagged: DataFrame) -> DataFrame:
    """One row per (document, path).

    First accepted row by extractor order; among rows of the same value a quoted
    one is preferred. Without an accepted row the first row stands as unknown.
    Two map-side combined aggregations; no group is ever materialised.
    """
    row = F.struct("value", "evidence_quote", "evidence_source", "confidence", "extractor_seq", "is_feature", "known", "kind", "accepted")
    accepted = F.col("accepted")
    by_value = flagged.filter("kind <> 'branch'").groupBy("doc_id", "path", "value_key").agg(
        F.min(F.when(accepted, F.col("extractor_seq"))).alias("first_accepted"),
        F.min_by(row, F.struct((~accepted).alias("a"), (~(accepted & F.col("quoted"))).alias("q"), "extractor_seq")).alias("r"),
    )
    # Rows that share an extractor position are ordered by their value.
    place = F.struct(
        F.col("first_accepted").isNull().alias("a"), F.coalesce("first_accepted", "r.extractor_seq").alias("seq"), "value_key"
    )
    out = by_value.groupBy("doc_id", "path").agg(F.min_by(F.struct("r", "value_key"), place).alias("w"))
    won = F.col("w.r.accepted")
    plain_unknown = ~won & F.col("w.r.known")

    def pick(name: str, empty: str) -> Column:
        return F.when(plain_unknown, F.lit(empty)).otherwise(F.col(f"w.r.{name}")).alias(name)

    return out.select(
        "doc_id", "path",
        pick("value", "unknown"), pick("evidence_quote", ""), pick("evidence_source", "none"),
        pick("confidence", "low"),
        "w.r.is_feature", "w.r.kind", won.alias("accepted"), F.when(won, F.col("w.value_key")).alias("value_key"),
        F.when(won, F.col("w.r.extractor_seq")).alias("extractor_seq"),
    )


def _short(key: Column) -> Column:
    return F.length(key) <= L.CONFLICT_MAX_CHARS


def _conflict(left: str, right: str) -> list[Column]:
    """Columns of a conflict between two structs of a flagged row's columns."""
    feature = F.col(f"{left}.is_feature") | F.col(f"{right}.is_feature")

    def source(side: str) -> Column:
        return F.when(feature, F.coalesce(F.col(f"{side}.evidence_source"), F.lit("none")))

    return [
        F.col("doc_id"), F.col("path"),
        F.col(f"{left}.value").alias("left_value"), F.col(f"{right}.value").alias("right_value"),
        source(left).alias("left_source"), source(right).alias("right_source"),
        F.when(feature, "conflicting_accepted_values").otherwise("conflicting_plain_values").alias("reason"),
    ]


_SIDE = ("value", "value_key", "evidence_source", "is_feature", "kind", "extractor_seq")


def feature_conflicts(flagged: DataFrame, won: DataFrame) -> DataFrame:
    """Later accepted rows that contradict the winner, one row each. Two lists never do: they are united.

    Equi-join on (doc_id, path); a hot key is split by the adaptive skew join.
    """
    left = won.filter(F.col("accepted") & _short(F.col("value_key"))).select("doc_id", "path", F.struct(*_SIDE).alias("l"))
    right = flagged.filter(F.col("accepted") & (F.col("kind") != "branch") & _short(F.col("value_key")))
    return (
        right.select("doc_id", "path", F.struct(*_SIDE).alias("r")).join(left, ["doc_id", "path"])
        .filter((F.col("l.value_key") != F.col("r.value_key")) & ((F.col("l.kind") != "list") | (F.col("r.kind") != "list")))
        .select(*_conflict("l", "r"))
    )


# ---------------------------------------------------------------- mixed shapes

def _parts(path: str = "path") -> Column:
    return F.split(path, r"\.")


def _parents(least: int) -> Column:
    """Paths above a path, from so many parts on."""
    n = F.size(_parts())
    return F.transform(
        F.when(n > least, F.sequence(F.lit(least), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.array_join(F.slice(_parts(), 1, i), "."),
    )


def resolve_shapes(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without the losing shapes, and the conflicts between shapes.

    Where one answer has an object at a path and another a leaf, the shape that was first accepted stays; an
    object is accepted as such. Rows of the other shape go: the leaves at the path, or all below it. Only paths of
    other than two parts can be mixed, so both sides of the joins start from these rare rows.
    """
    leaf = flagged.filter("kind <> 'branch'")
    depth = F.size(_parts())
    top = leaf.filter(depth == 1).select("doc_id", F.col("path").alias("above")).distinct()
    first = F.min("extractor_seq").alias("branch_seq")
    in_sections = leaf.filter(depth > 1).withColumn("above", F.get(_parts(), F.lit(0))).join(top, ["doc_id", "above"], "left_semi")
    in_objects = leaf.filter(depth > 2).select("doc_id", "extractor_seq", F.explode(_parents(2)).alias("above"))
    branches = in_sections.groupBy("doc_id", "above").agg(first).unionByName(in_objects.groupBy("doc_id", "above").agg(first))
    met = leaf.join(branches.withColumnRenamed("above", "path"), ["doc_id", "path"])
    verdict = cut_lineage(met.groupBy("doc_id", "path").agg(
        F.min("branch_seq").alias("branch_seq"),
        F.coalesce(F.min(F.when(F.col("accepted"), F.col("extractor_seq"))) < F.min("branch_seq"), F.lit(False)).alias("leaf_wins"),
    ), "shapes")
    objects = verdict.filter(~F.col("leaf_wins"))
    above = verdict.filter("leaf_wins").select("doc_id", F.col("path").alias("above"))
    hidden = leaf.select("doc_id", "path", F.explode(_parents(1)).alias("above")).join(above, ["doc_id", "above"], "left_semi")
    lost = objects.select("doc_id", "path").unionByName(hidden.select("doc_id", "path").distinct())
    kept = leaf.join(lost, ["doc_id", "path"], "left_anti")

    side = F.struct(*_SIDE)
    short = flagged.filter(_short(F.col("value_key")))
    object_side = short.filter("kind = 'branch'").join(verdict, ["doc_id", "path"]).select(
        "doc_id", "path", "leaf_wins", "branch_seq", side.alias("o")
    )
    leaf_side = short.filter(F.col("accepted") & (F.col("kind") != "branch")).join(verdict.select("doc_id", "path"), ["doc_id", "path"])
    leaf_side = leaf_side.select("doc_id", "path", side.alias("f"))
    first_leaf = leaf_side.groupBy("doc_id", "path").agg(F.min_by("f", F.struct("f.extractor_seq", "f.value_key")).alias("f"))
    first_object = object_side.filter(~F.col("leaf_wins") & (F.col("o.extractor_seq") == F.col("branch_seq")))
    conflicts = (
        object_side.filter("leaf_wins").join(first_leaf, ["doc_id", "path"]).select(*_conflict("f", "o"))
        .unionByName(first_object.join(leaf_side, ["doc_id", "path"]).select(*_conflict("o", "f")))
    )
    return kept, conflicts


def merge_lists(features: DataFrame) -> DataFrame:
    """Union of list values per path, first occurrence first, as a JSON array; paths with several lists only.

    Items are reduced to distinct keys (map-side combined) before they are put together, and what is put
    together is one value of the result.
    """
    several = features.groupBy("doc_id", "path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = F.transform(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>"), lambda v: F.to_json(v))
    items = features.join(several, ["doc_id", "path"], "left_semi").select(
        "doc_id", "path", "extractor_seq", F.posexplode(members).alias("i", "item")
    )
    united = (
        items.groupBy("doc_id", "path", semantic_key(F.col("item")).alias("k"))
        .agg(F.min(F.struct("extractor_seq", "i", "item")).alias("f"))
        .groupBy("doc_id", "path")
        .agg(F.array_sort(F.collect_list("f")).alias("f"))
    )
    joined = F.array_join(F.transform("f", lambda x: x["item"]), ",")
    return united.select("doc_id", "path", F.concat(F.lit("["), joined, F.lit("]")).alias("value"))


def with_lists(won: DataFrame, flagged: DataFrame) -> DataFrame:
    """Winners whose lists hold the items of all accepted lists of their path."""
    united = merge_lists(flagged.filter("kind = 'list' AND accepted")).withColumnRenamed("value", "united")
    is_list = F.col("accepted") & (F.col("kind") == "list") & F.col("united").isNotNull()
    value = F.when(is_list, F.col("united")).otherwise(F.col("value"))
    out = won.join(united, ["doc_id", "path"], "left").withColumn("value", value)
    return out.withColumn("value_key", F.when(is_list, semantic_key(F.col("value"))).otherwise(F.col("value_key"))).drop("united")


def merge_features(features: DataFrame) -> Merged:
    """Merge of all extractors. Flags and winners are read many times by the checks,
    so both are materialised in the shared checkpoint folder."""
    flagged = cut_lineage(judged(features))
    kept, mixed = resolve_shapes(flagged)
    won = cut_lineage(with_lists(winners(kept), kept))
    conflicts = feature_conflicts(kept, won).unionByName(mixed)
    warned = conflicts.select("doc_id", "path").distinct().withColumn(
        "audit_warning", F.lit("conflict_detected_manual_review_required")
    )
    return Merged(won.join(warned, ["doc_id", "path"], "left"), rejected_features(flagged), conflicts)


def all_features(annotation: DataFrame) -> DataFrame:
    """Feature rows of an annotation, those inside lists included (``path[i]``), with their accepted flag."""
    columns = ["doc_id", "path", "value", "evidence_quote", "evidence_source", "confidence"]
    listed = annotation.filter("kind = 'list'").select("doc_id", F.inline(A.leaves(F.col("path"), F.col("value"), into_lists=True)))
    features = stage(listed.filter("kind = 'feature'"), f=F.from_json("raw", _FEATURE_TYPE))
    inside = _leaf_features(features).withColumn(
        "accepted", ~is_unknown(F.col("value")) & has_evidence(F.col("evidence_quote"), F.col("evidence_source"))
    )
    return annotation.filter("is_feature").select(*columns, "accepted").unionByName(inside.select(*columns, "accepted"))


# ----------------------------------------------------------------- wide values

RULE_PATHS = tuple(
    dict.fromkeys(
        (*L.ABSOLUTE_KEYS[1:], *L.SOFT_KEYS, *L.CONTEXTUAL_KEYS, "procedure.dispute_object")
    )
)


def wide_name(path: str) -> str:
    return path.replace(".", "__")


def accepted_wide(annotation: DataFrame, paths: Sequence[str] = RULE_PATHS) -> DataFrame:
    """Accepted value keys of a document as columns, ``unknown`` otherwise.

    A pivot with a fixed list: one map-side combined ``max`` per column.
    """
    return annotation.groupBy("doc_id").agg(
        *[
            F.coalesce(
                F.max(F.when(F.col("accepted") & (F.col("path") == p), F.col("value_key"))), F.lit("unknown")
            ).alias(wide_name(p))
            for p in paths
        ],
        F.array_sort(
            F.collect_set(F.when(F.col("path").isin(*L.ABSOLUTE_KEYS, *L.SOFT_KEYS), F.col("path")))
        ).alias("present_paths"),
    )


def at(path: str) -> Column:
    return F.col(wide_name(path))


def yes(path: str) -> Column:
    return at(path) == "yes"


# ------------------------------------------------------------ derived category

_AFFILIATED = ("affiliated", "controlling")
_SHAM = ("sham", "artificial", "sham_and_artificial")


def derived_category(wide: DataFrame) -> DataFrame:
    """``basket``, ``basket_confidence`` and the trail of matched rules.

    Ordered rules, the first that applies wins.
    """
    claim, origin = at("claim.claim_type"), at("claim.claim_origin")
    obj, status = at("procedure.dispute_object"), at("creditor_profile.creditor_status")
    legal, key = at("qualification.legal_qualification"), at("qualification.key_reason_category")
    sham = at("proof.court_found_sham_or_artificial")

    def rule(cond: Column, *label: Column | str) -> Column:
        return F.when(cond, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in label]))

    def trail(*rules: Column) -> Column:
        return F.array_compact(F.array(*rules))

    sham_trail = trail(
        rule(sham.isin(*_SHAM), "proof.court_found_sham_or_artificial=", sham),
        rule(at("proof.court_recognized_debt_real") == "no", "proof.court_recognized_debt_real=no"),
        rule(at("proof.performance_fact_proven") == "no", "proof.performance_fact_proven=no"),
        rule(
            key.isin("sham_or_artificial_debt", "reality_not_proven"), "qualification.key_reason_category=", key
        ),
    )
    special = (
        F.when(claim == "cession", "cession_or_purchase_of_claim")
        .when(claim.isin("subrogation", "guarantee", "payment_for_debtor"), "subrogation_guarantee_or_security")
        .when(claim == "restitution", "restitution_after_avoidance")
    )
    kept_money = F.lit(False)
    for field in ("new_financing_provided", "left_funds_in_debtor", "did_not_demand_repayment", "extended_maturity"):
        kept_money = kept_money | yes(f"behavior.{field}")
    compensation_trail = trail(
        rule(origin == "compensation_financing", "claim.claim_origin=compensation_financing"),
        rule(
            legal == "recognized_as_compensation_financing",
            "qualification.legal_qualification=recognized_as_compensation_financing",
        ),
        rule(key == "compensation_financing", "qualification.key_reason_category=compensation_financing"),
        rule(
            (claim == "loan") & (at("crisis.crisis_status") == "established") & status.isin(*_AFFILIATED) & kept_money,
            "loan + crisis established + affiliated/controlling creditor + financing/retention behavior",
        ),
    )
    ordinary_trail = trail(
        rule(claim.isin("supply", "lease", "works_or_services"), "claim.claim_type=", claim),
        rule(yes("proof.court_recognized_debt_real"), "proof.court_recognized_debt_real=yes"),
        rule(yes("behavior.acted_as_market_creditor"), "behavior.acted_as_market_creditor=yes"),
        rule(
            at("market_terms.market_conditions_overall") == "market",
            "market_terms.market_conditions_overall=market",
        ),
    )
    refusal = (
        status.isin(*_AFFILIATED)
        & (legal == "included_general")
        & key.isin("market_behavior", "no_crisis_at_relevant_moment", "no_affiliation_or_control_proven")
    )
    procedural = (
        obj.isin("procedural_succession", "creditor_voting_rights", "manager_action_complaint")
        & (claim == "unknown")
        & (at("proof.performance_fact_proven") == "unknown")
    )
    corporate = (key == "corporate_nature") | (legal == "corporate_claim")

    def result(basket: Column | str, confidence: Column | str, rules: Column) -> Column:
        as_col = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(
            as_col(basket).alias("basket"),
            as_col(confidence).alias("basket_confidence"),
            rules.cast("array<string>").alias("matched_rules"),
        )

    def ladder(t: Column) -> Column:
        n_comp, n_ord = F.size(t["comp"]), F.size(t["ord"])
        return (
            F.when(
                procedural,
                result(
                    "procedural_issue", "medium",
                    F.array(F.concat(F.lit("procedure.dispute_object="), obj, F.lit("; claim/proof not established"))),
                ),
            )
            .when(F.size(t["sham"]) > 0, result("sham_or_fictitious_debt", "high", t["sham"]))
            .when(
                special.isNotNull(),
                result(special, "high", F.array(F.concat(F.lit("claim.claim_type="), claim))),
            )
            .when(
                n_comp > 0,
                result("compensation_financing_loan", F.when(n_comp >= 2, "high").otherwise("medium"), t["comp"]),
            )
            .when(
                claim.isin("supply", "lease", "works_or_services") & (n_ord >= 2),
                result("ordinary_affiliated_business_deal", F.when(n_ord >= 3, "high").otherwise("medium"), t["ord"]),
            )
            .when(
                refusal,
                result(
                    "refusal_to_subordinate_despite_affiliation", "medium",
                    F.array(
                        F.concat(F.lit("creditor_profile.creditor_status="), status),
                        F.lit("qualification.legal_qualification=included_general"),
                        F.concat(F.lit("qualification.key_reason_category="), key),
                    ),
                ),
            )
            .when(
                corporate,
                result("contractual_subordination", "medium", F.array(F.lit("qualification indicates corporate nature"))),
            )
            .otherwise(result("unknown", "low", F.array().cast("array<string>")))
        )

    verdict = let(
        F.struct(sham_trail.alias("sham"), compensation_trail.alias("comp"), ordinary_trail.alias("ord")), ladder
    )
    return wide.withColumn("_v", verdict).select(
        *wide.columns, "_v.basket", "_v.basket_confidence", "_v.matched_rules"
    )


def checked_basket(basket: Column) -> Column:
    """``struct<value,warning>``: a value outside the closed list becomes unknown."""
    ok = basket.isin(*L.BASKETS)
    return F.struct(
        F.when(ok, basket).otherwise("unknown").alias("value"),
        F.when(~F.coalesce(ok, F.lit(False)), "value_not_in_allowed_baskets").alias("warning"),
    )


def derived_features(wide: DataFrame) -> DataFrame:
    """The derived category as an annotation row."""
    known = F.col("basket") != "unknown"
    return wide.select(
        "doc_id",
        F.lit(L.BASKET).alias("path"),
        F.col("basket").alias("value"),
        F.concat(F.lit("derived from accepted schema fields: "), F.array_join("matched_rules", "; ")).alias(
            "evidence_quote"
        ),
        F.lit("derived: audit").alias("evidence_source"),
        F.col("basket_confidence").alias("confidence"),
        F.lit(True).alias("is_feature"),
        known.alias("accepted"),
        F.col("basket").alias("value_key"),
    )


# ---------------------------------------------------------------------- checks

@dataclass(frozen=True)
class LogicRule:
    paths: tuple[str, ...]
    reason: str
    severity: str
    broken: Callable[[], Column]


def _any_link() -> Column:
    base = "creditor_profile."
    return (
        yes(base + "formal_affiliation_found")
        | yes(base + "factual_affiliation_found")
        | yes(base + "control_found")
    )


_CP, _BH, _CR, _PR, _QU = "creditor_profile.", "behavior.", "crisis.", "proof.", "qualification."
_LINKS = tuple(_CP + f for f in ("formal_affiliation_found", "factual_affiliation_found", "control_found"))
_REASON = (_QU + "legal_qualification", _QU + "key_reason_category")

LOGIC_RULES = (
    LogicRule(
        (_CP + "creditor_status", *_LINKS),
        "creditor_status=independent conflicts with established affiliation/control", "critical",
        lambda: (at(_CP + "creditor_status") == "independent") & _any_link(),
    ),
    LogicRule(
        (_CP + "creditor_status", _CP + "control_found"),
        "creditor_status=controlling requires control_found=yes", "critical",
        lambda: (at(_CP + "creditor_status") == "controlling") & ~yes(_CP + "control_found"),
    ),
    LogicRule(
        (_CP + "creditor_status", _CP + "control_found"),
        "creditor_status=affiliated conflicts with control_found=yes; controlling may be required", "warning",
        lambda: (at(_CP + "creditor_status") == "affiliated") & yes(_CP + "control_found"),
    ),
    LogicRule(
        (_CP + "connection_basis_primary", *_LINKS),
        "connection_basis_primary=none conflicts with established affiliation/control", "critical",
        lambda: (at(_CP + "connection_basis_primary") == "none") & _any_link(),
    ),
    LogicRule(
        (_CP + "connection_basis_primary", _CP + "formal_affiliation_found"),
        "formal connection basis usually requires formal_affiliation_found=yes", "warning",
        lambda: at(_CP + "connection_basis_primary").isin(
            "equity_participation", "management", "group_of_companies", "family_ties"
        )
        & ~yes(_CP + "formal_affiliation_found"),
    ),
    LogicRule(
        (_CP + "connection_basis_primary", _CP + "factual_affiliation_found"),
        "factual connection basis usually requires factual_affiliation_found=yes", "warning",
        lambda: at(_CP + "connection_basis_primary").isin(
            "factual_control", "coordinated_actions", "economic_dependence"
        )
        & ~yes(_CP + "factual_affiliation_found"),
    ),
    LogicRule(
        (_CR + "crisis_status", _CR + "creditor_knew_crisis", _CR + "creditor_should_have_known_crisis"),
        "crisis_status=not_established is inconsistent with creditor knowledge of crisis", "warning",
        lambda: (at(_CR + "crisis_status") == "not_established")
        & (yes(_CR + "creditor_knew_crisis") | yes(_CR + "creditor_should_have_known_crisis")),
    ),
    LogicRule(
        (_BH + "acted_as_market_creditor", _BH + "obtained_preference"),
        "market behavior and obtained preference may conflict", "warning",
        lambda: yes(_BH + "acted_as_market_creditor") & yes(_BH + "obtained_preference"),
    ),
    LogicRule(
        (
            _BH + "left_funds_in_debtor", _BH + "did_not_demand_repayment",
            _BH + "extended_maturity", _BH + "changed_contract_terms",
        ),
        "left_funds_in_debtor=yes usually needs non-demand, extension, or changed terms", "warning",
        lambda: yes(_BH + "left_funds_in_debtor")
        & ~(
            yes(_BH + "did_not_demand_repayment")
            | yes(_BH + "extended_maturity")
            | yes(_BH + "changed_contract_terms")
        ),
    ),
    LogicRule(
        (_PR + "court_recognized_debt_real", _PR + "court_found_sham_or_artificial"),
        "court_recognized_debt_real=yes conflicts with sham/artificial debt finding", "critical",
        lambda: yes(_PR + "court_recognized_debt_real") & at(_PR + "court_found_sham_or_artificial").isin(*_SHAM),
    ),
    LogicRule(
        _REASON, "included_general conflicts with reason usually supporting subordination/refusal", "critical",
        lambda: (at(_REASON[0]) == "included_general")
        & at(_REASON[1]).isin(
            "compensation_financing", "corporate_nature", "sham_or_artificial_debt", "reality_not_proven"
        ),
    ),
    LogicRule(
        _REASON, "refused conflicts with market_behavior as key reason", "warning",
        lambda: (at(_REASON[0]) == "refused") & (at(_REASON[1]) == "market_behavior"),
    ),
    LogicRule(
        _REASON, "remand usually requires key_reason_category=procedural_remand", "warning",
        lambda: (at(_REASON[0]) == "remand") & ~at(_REASON[1]).isin("procedural_remand", "unknown"),
    ),
)


def logic_issues(wide: DataFrame) -> DataFrame:
    """Broken logic rules, one row each; a projection, no shuffle."""
    entries = [
        F.when(
            r.broken(),
            F.struct(
                F.array(*[F.lit("annotation." + p) for p in r.paths]).alias("paths"),
                F.lit(r.reason).alias("reason"),
                F.lit(r.severity).alias("severity"),
            ),
        )
        for r in LOGIC_RULES
    ]
    return wide.select("doc_id", F.inline(F.array_compact(F.array(*entries))))


def evidence_warnings(features: DataFrame) -> DataFrame:
    """Four evidence checks for each of ``all_features``."""
    quote, source = T.audit_text(F.col("evidence_quote")), T.audit_text(F.col("evidence_source"))
    known = ~is_unknown(F.col("value"))

    def issue(cond: Column, reason: str, value: Column) -> Column:
        return F.when(cond, F.struct(F.lit(reason).alias("reason"), value.alias("value")))

    checks = F.array_compact(
        F.array(
            issue(
                known & (quote == "") & ~is_technical_source(source),
                "filled_value_without_evidence_quote", F.col("value"),
            ),
            issue(known & source.isin("", "none"), "filled_value_without_evidence_source", F.col("value")),
            issue(
                ~T.audit_key(F.col("confidence")).isin(*L.CONFIDENCES),
                "unexpected_confidence_value", F.col("confidence"),
            ),
            issue(
                is_binary(F.col("path")) & ~semantic_key(F.col("value")).isin(*L.BINARY_VALUES),
                "unexpected_binary_value", F.col("value"),
            ),
        )
    )
    return features.select("doc_id", F.concat(F.lit("annotation."), F.col("path")).alias("path"), F.inline(checks))


def needed_context(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in L.NEEDED_CONTEXT.items() for x in kv])
    return F.coalesce(F.element_at(table, section_of(path)), F.lit(L.NEEDED_CONTEXT_DEFAULT))


def missing_fields(wide: DataFrame) -> DataFrame:
    """Required fields without an accepted value.

    The required list is a literal, so the missing part is an array difference in
    the document row instead of a cross join.
    """

    def missing(paths: Sequence[str], priority: str) -> list[Column]:
        out = []
        for p in paths:
            value = F.col("basket") if p == L.BASKET else at(p)
            present = F.lit(True) if p == L.BASKET else F.array_contains("present_paths", p)
            out.append(
                F.when(
                    value == "unknown",
                    F.struct(
                        F.lit("annotation." + p).alias("path"),
                        F.when(present, "unknown_or_unaccepted_field").otherwise("missing_field").alias("reason"),
                        F.lit(priority).alias("priority"),
                    ),
                )
            )
        return out

    entries = [*missing(L.ABSOLUTE_KEYS, "absolute_key"), *missing(L.SOFT_KEYS, "soft_key")]
    return wide.select("doc_id", F.posexplode(F.array_compact(F.array(*entries))).alias("seq", "m")).select(
        "doc_id", "seq", "m.path", "m.reason", "m.priority", needed_context(F.col("m.path")).alias("needed_context")
    )


def out_of_catalog(annotation: DataFrame, catalog: DataFrame) -> DataFrame:
    """Accepted values outside the declared list of a closed field; the items of a list are values each.

    ``catalog`` (``path, kind, allowed_values``) has a row per schema field; its allowed values take away what is
    allowed by an anti join on path and value.
    """
    closed = catalog.filter(F.size("allowed_values") > 0)
    allowed = closed.select("path", F.explode("allowed_values").alias("v")).select("path", semantic_key(F.col("v")).alias("key"))
    values = F.when(F.col("kind") == "list", F.from_json("value", "array<string>")).otherwise(F.array("value"))
    rows = annotation.filter("accepted").join(closed.select("path").distinct(), "path", "left_semi")
    stated = rows.select("doc_id", "path", F.explode(values).alias("value")).withColumn("key", semantic_key(F.col("value")))
    return stated.join(allowed.distinct(), ["path", "key"], "left_anti").select(
        "doc_id", "path", "value", F.lit("value_not_in_catalogue").alias("reason")
    )


# ---------------------------------------------------------------- audit result

@dataclass(frozen=True)
class Audit:
    annotation: DataFrame   # final long feature table
    wide: DataFrame         # accepted values, category and trail, one row per document
    issues: DataFrame       # long table of everything found
    audit: DataFrame        # one row per document
    refill_tasks: DataFrame


_ISSUE_COLUMNS = ("doc_id", "kind", "path", "paths", "reason", "severity", "value")
STRUCTURAL_IGNORED = "llm_economic_dispute_ignored_basket_is_derived_only"


def _issues(df: DataFrame, kind: str, severity: str | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    cols = set(df.columns)
    return df.select(
        "doc_id",
        F.lit(kind).alias("kind"),
        (F.col("path") if "path" in cols else F.array_join("paths", ", ")).alias("path"),
        (F.col("paths") if "paths" in cols else F.array("path")).alias("paths"),
        F.col("reason"),
        (F.col("severity") if "severity" in cols else F.lit(severity).cast("string")).alias("severity"),
        (F.col("value").cast("string") if "value" in cols else none).alias("value"),
    )


def overall_status() -> Column:
    """Status ladder over the per-document issue counts."""
    c = F.col
    return (
        F.when(
            (c("field_conflicts_count") > 0)
            | (c("critical_logic_count") > 0)
            | (c("extractor_errors_count") > 0)
            | (c("serious_structural_count") > 0),
            "needs_manual_review",
        )
        .when(
            (c("missing_key_fields_count") > 0)
            | (c("rejected_fields_count") > 0)
            | (c("evidence_warnings_count") > 0),
            "needs_refill",
        )
        .when(
            (c("soft_missing_fields_count") > 0) | (c("logical_inconsistencies_count") > 0),
            "complete_with_warnings",
        )
        .otherwise("complete")
    )


def audit_merged(
    merged: Merged, docs: DataFrame, warnings: DataFrame, errors: DataFrame
) -> Audit:
    """Audit of merged features. ``docs`` lists every document to be audited."""
    base = docs.select("doc_id").distinct()
    wide = derived_category(
        base.join(accepted_wide(merged.annotation), "doc_id", "left")
        .na.fill("unknown", [wide_name(p) for p in RULE_PATHS])
        .withColumn("present_paths", F.coalesce("present_paths", F.array().cast("array<string>")))
    )
    wide = cut_lineage(stage(wide, _b=checked_basket(F.col("basket"))).withColumns({
        "basket": F.col("_b.value"), "basket_warning": F.col("_b.warning"),
        "basket_confidence": F.when(F.col("_b.warning").isNotNull(), "low").otherwise(F.col("basket_confidence")),
    }).drop("_b"))
    unlisted = wide.filter("basket_warning IS NOT NULL").select(
        "doc_id", F.lit("annotation." + L.BASKET).alias("path"), F.col("basket_warning").alias("reason"))
    annotation = merged.annotation.filter(F.col("path") != L.BASKET).unionByName(
        derived_features(wide), allowMissingColumns=True
    )
    features = all_features(annotation)
    missing = missing_fields(wide)
    issues = (
        _issues(merged.conflicts.withColumn("value", F.col("right_value")), "field_conflict", "critical")
        .unionByName(_issues(merged.rejected, "rejected_field"))
        .unionByName(_issues(logic_issues(wide), "logical_inconsistency"))
        .unionByName(_issues(evidence_warnings(features), "evidence_warning"))
        .unionByName(_issues(missing.filter("priority = 'absolute_key'"), "missing_key_field"))
        .unionByName(_issues(missing.filter("priority = 'soft_key'"), "soft_missing_field"))
        .unionByName(_issues(warnings, "structural_warning"))
        .unionByName(_issues(unlisted, "structural_warning"))
        .unionByName(_issues(errors, "extractor_error"))
    )

    def n(kind: str, extra: Column | None = None) -> Column:
        cond = F.col("kind") == kind
        return F.count_if(cond if extra is None else cond & extra)

    counts = issues.groupBy("doc_id").agg(
        n("field_conflict").alias("field_conflicts_count"),
        n("rejected_field").alias("rejected_fields_count"),
        n("logical_inconsistency").alias("logical_inconsistencies_count"),
        n("logical_inconsistency", F.col("severity") == "critical").alias("critical_logic_count"),
        n("evidence_warning").alias("evidence_warnings_count"),
        n("missing_key_field").alias("missing_key_fields_count"),
        n("soft_missing_field").alias("soft_missing_fields_count"),
        n("structural_warning").alias("structural_warnings_count"),
        n("structural_warning", F.col("reason") != STRUCTURAL_IGNORED).alias("serious_structural_count"),
        n("extractor_error").alias("extractor_errors_count"),
    )
    accepted = features.groupBy("doc_id").agg(F.count_if("accepted").alias("accepted_fields_count"))
    per_doc = (
        wide.select("doc_id", "basket", "basket_confidence", "matched_rules")
        .join(counts, "doc_id", "left")
        .join(accepted, "doc_id", "left")
        .na.fill(0)
        .withColumn(
            "refill_tasks_count", F.col("missing_key_fields_count") + F.col("soft_missing_fields_count")
        )
        .withColumn("overall_status", overall_status())
    )
    return Audit(annotation, wide, issues, per_doc, refill_tasks(missing, merged.conflicts, logic_issues(wide)))


def manual_review(issues: DataFrame) -> DataFrame:
    """Issues a person has to look at."""
    kind = F.col("kind")
    return issues.filter(
        (kind == "field_conflict")
        | ((kind == "logical_inconsistency") & (F.col("severity") == "critical"))
        | ((kind == "structural_warning") & (F.col("reason") != STRUCTURAL_IGNORED))
        | (kind == "extractor_error")
    ).select(
        "doc_id", "path",
        F.when(kind == "field_conflict", "field_conflict")
        .when(kind == "extractor_error", "extractor_parse_or_runtime_error")
        .otherwise(F.col("reason"))
        .alias("reason"),
    )


def refill_tasks(missing: DataFrame, conflicts: DataFrame, logic: DataFrame) -> DataFrame:
    """Ordered tasks: missing key, missing soft, conflicts, logic (one per path)."""
    none = F.lit(None).cast("string")
    from_missing = missing.select(
        "doc_id",
        F.struct(F.lit(0).alias("b"), F.col("seq").alias("i"), F.col("path").alias("p")).alias("o"),
        "path", "priority", "reason", "needed_context", F.lit("refill_tasks").alias("source_audit_block"),
    )
    from_conflicts = conflicts.select(
        "doc_id",
        F.struct(F.lit(1).alias("b"), F.lit(0).alias("i"), F.col("path").alias("p")).alias("o"),
        "path", none.alias("priority"), "reason", none.alias("needed_context"),
        F.lit("field_conflicts").alias("source_audit_block"),
    )
    from_logic = logic.select("doc_id", "reason", F.posexplode("paths").alias("i", "path")).select(
        "doc_id",
        F.struct(F.lit(2).alias("b"), "i", F.col("path").alias("p")).alias("o"),
        "path", none.alias("priority"), "reason", none.alias("needed_context"),
        F.lit("logical_inconsistencies").alias("source_audit_block"),
    )
    tasks = from_missing.unionByName(from_conflicts).unionByName(from_logic)
    # A field needs one context however often it was reported.
    return tasks.groupBy("doc_id", plain_path(F.col("path")).alias("path")).agg(
        F.min(F.struct("o", "priority", "reason", "needed_context", "source_audit_block")).alias("t")
    ).select(
        "doc_id", "path", F.col("t.o").alias("task_order"), "t.priority", "t.reason", "t.needed_context",
        "t.source_audit_block",
    )


def audit_responses(
    responses: DataFrame, headers: DataFrame | None = None, docs: DataFrame | None = None, catalog: DataFrame | None = None
) -> Audit:
    """Whole audit: answers -> sections -> features -> merge -> checks -> status. With a catalogue of the schema,
    values that it doesn't list are structural warnings."""
    answers = cut_lineage(read_answers(responses))
    sections = section_rows(answers)
    features = features_from_sections(sections)
    if headers is not None:
        features = metadata_features(headers).unionByName(features)
    base = docs if docs is not None else responses
    merged, warnings = merge_features(features), structural_warnings(sections).drop("extractor")
    if catalog is not None:
        unlisted = out_of_catalog(merged.annotation, catalog)
        warnings = warnings.unionByName(unlisted.select("doc_id", F.concat(F.lit("annotation."), "path").alias("path"), "reason"))
    return audit_merged(merged, base, warnings, extractor_errors(answers))


# ------------------------------------------------------------------ refinement

def apply_refinements(annotation: DataFrame, refinements: DataFrame) -> DataFrame:
    """Outcome of every (response, target path): accepted, rejected, skipped, error.

    ``refinements`` holds ``doc_id, extractor_seq, extraction_type, target_paths,
    answer_text, error``. A path that already has an accepted value is never
    overwritten; of several good candidates the first one counts.
    """
    r = _with_regular(refinements, F.lit(True))
    r = stage(r, _p=F.when(F.col("regular").isNull(), A.parse_answer(F.col("answer_text"))))
    r = stage(r, partial=F.to_json(A.unwrap(F.col("_p.answer"))))
    r = stage(r, members=A.members(F.col("partial")))
    failed = F.col("error").isNotNull() | F.col("_p.parse_error").isNotNull()
    unread = F.col("regular").isNull() & F.col("partial").isNull()
    targets = r.select(
        "doc_id", "extractor_seq", "extraction_type", failed.alias("failed"),
        F.coalesce("error", "_p.parse_error").alias("error"), unread.alias("unread"), "regular", "members",
        F.explode("target_paths").alias("target_path"),
    )
    targets = stage(targets, path=plain_path(F.col("target_path")))
    targets = targets.withColumns({"section": section_of(F.col("path")), "field": field_of(F.col("path"))})
    read = F.element_at(F.element_at("regular", F.col("section")), F.col("field"))
    raw = F.element_at(A.members(F.element_at("members", F.col("section"))), F.col("field"))
    c = stage(targets, read=read, raw=raw).drop("regular", "members")
    feature_keys = F.array(*[F.lit(k) for k in A.FEATURE_KEYS])
    overlaps = F.coalesce(F.arrays_overlap(F.json_object_keys("raw"), feature_keys), F.lit(False))
    c = stage(c, is_feature=F.col("read").isNotNull() | overlaps)
    c = stage(c, f=F.coalesce("read", F.when(F.col("is_feature"), F.from_json("raw", _FEATURE_TYPE))))
    c = stage(c, value=normalize_binary(F.col("path"), F.col("f.value")))
    held = annotation.filter("accepted").select("doc_id", "path", F.lit(True).alias("already"))
    c = c.join(held, ["doc_id", "path"], "left")
    section = F.col("section")
    outcome = (
        F.when(F.col("failed"), _outcome("error", "refinement_extractor_error"))
        .when(F.col("unread"), _outcome("error", "empty_or_unreadable_refinement_answer"))
        .when(
            ~section.isin(*L.SECTIONS) | (section == "economic_dispute"),
            _outcome("skipped", "path_is_not_refinable_or_derived_only"),
        )
        .when(F.col("already"), _outcome("skipped", "target_field_already_accepted_not_overwritten"))
        .when(F.col("raw").isNull() & F.col("read").isNull(), _outcome("rejected", "candidate_field_not_returned"))
        .when(~F.col("is_feature"), _outcome("rejected", "candidate_is_not_feature_object"))
        .when(is_unknown(F.col("value")), _outcome("rejected", "candidate_value_is_unknown"))
        .when(
            ~has_evidence(F.col("f.evidence_quote"), F.col("f.evidence_source")),
            _outcome("rejected", "candidate_without_required_evidence"),
        )
        .otherwise(_outcome("accepted", None))
    )
    # Looked at twice: the annotation behind it is merged once.
    c = cut_lineage(c.select(
        "doc_id", "extractor_seq", "extraction_type", "path", "value", "f", "error", outcome.alias("o")
    ), "refinements")
    good = F.col("o.outcome") == "accepted"
    first = c.filter(good).groupBy("doc_id", "path").agg(F.min("extractor_seq").alias("first_good"))
    later = good | F.col("o.reason").isin(
        "candidate_field_not_returned", "candidate_is_not_feature_object", "candidate_value_is_unknown",
        "candidate_without_required_evidence",
    )
    superseded = later & (F.col("extractor_seq") > F.col("first_good"))
    return c.join(first, ["doc_id", "path"], "left").select(
        "doc_id", "extractor_seq", "extraction_type", "path",
        F.when(superseded, "skipped").otherwise(F.col("o.outcome")).alias("outcome"),
        F.when(superseded, "target_field_already_accepted_not_overwritten")
        .otherwise(F.col("o.reason"))
        .alias("reason"),
        "value", F.col("f.evidence_quote").alias("evidence_quote"),
        F.col("f.evidence_source").alias("evidence_source"), F.col("f.confidence").alias("confidence"), "error",
    )


def _outcome(outcome: str, reason: str | None) -> Column:
    return F.struct(F.lit(outcome).alias("outcome"), F.lit(reason).cast("string").alias("reason"))


def refined_annotation(annotation: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Annotation with accepted candidates put in (``refined_by`` names the source)."""
    accepted = outcomes.filter("outcome = 'accepted'").select(
        "doc_id", "path", "value", "evidence_quote", "evidence_source", "confidence",
        F.lit(True).alias("is_feature"), F.lit(True).alias("accepted"),
        semantic_key(F.col("value")).alias("value_key"),
        F.col("extraction_type").alias("refined_by"),
    )
    kept = annotation.join(accepted.select("doc_id", "path"), ["doc_id", "path"], "left_anti")
    return kept.unionByName(accepted, allowMissingColumns=True)


def refinement_stats(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("doc_id").agg(
        F.countDistinct("extractor_seq").alias("results_count"),
        F.count(F.lit(1)).alias("target_paths_count"),
        *[F.count_if(F.col("outcome") == o).alias(f"{o}_count") for o in ("accepted", "rejected", "skipped", "error")],
    )


# ----------------------------------------------------------------------- views

def comparison_view(annotation: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Wide record of the given fields, values as they stand, ``unknown`` if absent."""
    return annotation.groupBy("doc_id").agg(
        *[
            F.coalesce(F.max(F.when(F.col("accepted") & (F.col("path") == p), F.col("value"))), F.lit("unknown")).alias(
                p.split(".")[-1]
            )
            for p in fields
        ]
    )


def similarity_view(annotation: DataFrame) -> DataFrame:
    return comparison_view(annotation, L.SIMILARITY_FIELDS)


def explanation_view(annotation: DataFrame) -> DataFrame:
    return comparison_view(annotation, L.EXPLANATION_FIELDS)


def nested_annotation(annotation: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Nested template per document: section -> field -> feature struct.

    ``fields`` are the catalog paths in template order; a field without a feature
    stands as unknown. One map-side combined aggregate per field.
    """
    feature = F.struct("value", "evidence_quote", "evidence_source", "confidence")
    unknown = F.struct(
        F.lit("unknown").alias("value"), F.lit("").alias("evidence_quote"),
        F.lit("none").alias("evidence_source"), F.lit("low").alias("confidence"),
    )
    rows = annotation.filter("is_feature").groupBy("doc_id").agg(
        *[
            F.coalesce(F.max(F.when(F.col("path") == p, feature)), unknown).alias(wide_name(p))
            for p in fields
        ]
    )
    sections = list(dict.fromkeys(p.split(".")[0] for p in fields))
    return rows.select(
        "doc_id",
        F.struct(
            *[
                F.struct(*[at(p).alias(p.split(".")[1]) for p in fields if p.split(".")[0] == s]).alias(s)
                for s in sections
            ]
        ).alias("annotation"),
    )


def quality_summary(annotation: DataFrame, audit: DataFrame, n_fields: int) -> DataFrame:
    """Completeness, evidence and source coverage, confidence and a 0-1 score.

    Only the names of these measures are given publicly; the thresholds
    (0.9 / 0.6) and equal weights are ours.
    """
    known = ~is_unknown(F.col("value"))
    agg = annotation.groupBy("doc_id").agg(
        F.count_if("accepted").alias("accepted"),
        F.count_if(known).alias("filled"),
        F.count_if(known & (T.audit_text(F.col("evidence_quote")) != "")).alias("quoted"),
        F.count_if(known & ~T.audit_key(F.col("evidence_source")).isin("", "none")).alias("sourced"),
        F.count_if(known & (T.audit_key(F.col("confidence")) == "high")).alias("confident"),
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    level = lambda x, hi, mid, lo: F.when(x >= 0.9, hi).when(x >= 0.6, mid).otherwise(lo)
    c = F.col
    out = audit.join(agg, "doc_id", "left").na.fill(0, ["accepted", "filled", "quoted", "sourced", "confident"])
    complete = F.least(c("accepted") / n_fields, F.lit(1.0))
    quoted, sourced, sure = (share(c(x), c("filled")) for x in ("quoted", "sourced", "confident"))
    return out.select(
        "doc_id",
        level(complete, "complete", "partial", "insufficient").alias("schema_completeness"),
        level(quoted, "high", "medium", "low").alias("evidence_coverage"),
        level(sourced, "high", "medium", "low").alias("source_coverage"),
        F.when(c("critical_logic_count") + c("field_conflicts_count") > 0, "major_conflicts")
        .when(c("logical_inconsistencies_count") > 0, "minor_conflicts")
        .otherwise("consistent")
        .alias("consistency_status"),
        level(sure, "high", "medium", "low").alias("confidence_status"),
        (c("overall_status") == "needs_refill").alias("requires_reextraction"),
        F.round((complete + quoted + sourced + sure) / 4, 4).alias("quality_score"),
        F.when(c("overall_status") == "needs_manual_review", "manual_review_required")
        .when(c("overall_status") == "needs_refill", "needs_reextraction")
        .when(c("overall_status") == "complete_with_warnings", "accepted_with_warnings")
        .otherwise("accepted")
        .alias("audit_result"),
    )
