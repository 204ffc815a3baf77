"""Stage wiring: from pages to windows, and from responses to audited features.

The external model splits the work in three jobs with a written table between
them: (1) pages -> annotation requests, (2) replies -> extraction requests,
(3) answers -> audit, with one optional refill round.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actloom.operators import audit as AU
from actloom.operators import cards as CA
from actloom.operators import header as HE
from actloom.operators import refill as RE
from actloom.operators import requests as RQ
from actloom.operators import segment as SE
from actloom.operators import tagging as TA
from actloom.operators import windows as WI
from actloom.session import cut_lineage


def segmented(
    pages: DataFrame, *, clean: bool = True, sentence_fields: Sequence[str] = SE.SENTENCE_COLUMNS,
    window_fields: Sequence[str] = WI.WINDOW_COLUMNS,
) -> DataFrame:
    """Pages -> one row per document with zones, sentences and windows.

    Who reads only some of it says so: no optimizer prunes a stage's generator or fields inside lambdas.
    """
    docs = SE.assemble(SE.clean_pages(SE.gather_pages(pages)))
    docs = SE.split_sentences(SE.split_zones(docs), fields=sentence_fields)
    docs = WI.build_windows(TA.mark_cited(docs), fields=window_fields)
    return WI.sanitize_windows(docs) if clean else docs


def quarantined(docs: DataFrame) -> DataFrame:
    """Documents that must not go on: lost text or no header zone."""
    lost = SE.zone_integrity(docs).filter(~F.col("ok")).select("doc_id", F.lit("text_lost_in_zones").alias("reason"))
    return lost.unionByName(HE.quarantine(docs))


def accepted_documents(docs: DataFrame) -> DataFrame:
    """Documents outside the quarantine, decided in the row itself (no join)."""
    joined = F.array_join(F.transform("zones", lambda z: z["text"]), SE.SEPARATOR)
    flat = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return docs.filter(HE.has_header(docs) & (flat(F.col("text")) == flat(joined)))


@dataclass(frozen=True)
class Stage1:
    docs: DataFrame
    headers: DataFrame
    requests: DataFrame
    quarantine: DataFrame


def annotation_stage(pages: DataFrame, question: str = "") -> Stage1:
    """Windows, headers, requests and quarantine; segmentation runs once, into a stage table."""
    docs = cut_lineage(segmented(pages), "acts")
    ready = accepted_documents(docs)
    headers = HE.case_header(ready)
    requests = RQ.annotation_requests(WI.window_rows(ready, "clean_windows"), headers, question)
    return Stage1(ready, headers, requests, quarantined(docs))


@dataclass(frozen=True)
class Stage2:
    entities: DataFrame
    merged: DataFrame
    requests: DataFrame
    stats: DataFrame


def card_stage(headers: DataFrame, annotations: DataFrame) -> Stage2:
    """Entities, merged cards, extraction requests and statistics; replies are parsed and merged once."""
    parsed = cut_lineage(CA.parse_annotations(annotations), "replies")
    entities = cut_lineage(CA.merge_roles(CA.entity_rows(parsed)), "entities")
    merged = cut_lineage(CA.merge_cards(CA.card_fragments(parsed)), "cards")
    return Stage2(
        entities, merged, RQ.extraction_requests(headers, entities, merged),
        CA.merge_stats(parsed, entities, merged),
    )


@dataclass(frozen=True)
class Refill:
    contexts: DataFrame
    requests: DataFrame


def refill_stage(
    docs: DataFrame, headers: DataFrame, stage2: Stage2, first: AU.Audit, profiles: DataFrame
) -> Refill:
    """Context and requests for the documents whose audit asks for a refill."""
    chosen = RE.needs_refill(first.audit)
    # Read by every step of the search: the audit behind the tasks is not worked out again for each.
    tasks = cut_lineage(first.refill_tasks.join(chosen, "doc_id", "left_semi"), "tasks")
    contexts = RE.refill_contexts(docs, stage2.merged, tasks, profiles)
    requests = RE.refinement_requests(RE.route_contexts(contexts), headers, stage2.entities)
    return Refill(contexts, requests)


def second_audit(
    responses: DataFrame, headers: DataFrame, first: AU.Audit, refinements: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Audit again with the refined values, for refilled documents only.

    Returns the audit of all documents and a before / after table.
    """
    chosen = RE.needs_refill(first.audit)
    outcomes = AU.apply_refinements(first.annotation, refinements)
    answers = AU.read_answers(responses).join(chosen, "doc_id", "left_semi")
    sections = AU.section_rows(answers)
    features = AU.metadata_features(headers.join(chosen, "doc_id", "left_semi")).unionByName(
        AU.features_from_sections(sections)
    )
    merged = AU.merge_features(features)
    refined = AU.Merged(
        AU.refined_annotation(merged.annotation, outcomes), merged.rejected, merged.conflicts
    )
    again = AU.audit_merged(refined, chosen, AU.structural_warnings(sections), AU.extractor_errors(answers))
    untouched = first.audit.join(chosen, "doc_id", "left_anti")
    before_after = first.audit.select("doc_id", F.col("overall_status").alias("initial_status")).join(
        again.audit.select("doc_id", F.col("overall_status").alias("final_status")), "doc_id"
    )
    return untouched.unionByName(again.audit, allowMissingColumns=True), before_after
