"""Sections, required fields and word lists of the feature audit.

Fixed values: field names, allowed values and markers must have exactly this content.
"""

from __future__ import annotations

# ---- fixed values ------------------------------------------------------------

SECTIONS = (
    "metadata", "procedure", "economic_dispute", "creditor_profile", "claim", "crisis",
    "behavior", "market_terms", "proof", "proof_burden", "qualification", "motivation",
)
IGNORED_SECTIONS = ("audit", "legal_references")
BASKET = "economic_dispute.economic_dispute_basket"
BASKETS = (
    "compensation_financing_loan", "ordinary_affiliated_business_deal", "sham_or_fictitious_debt",
    "covering_relationship", "cession_or_purchase_of_claim", "subrogation_guarantee_or_security",
    "restitution_after_avoidance", "contractual_subordination",
    "refusal_to_subordinate_despite_affiliation", "procedural_issue", "mixed", "other", "unknown",
)
UNKNOWN_MARKERS = ("", "unknown", "none", "null", "не установлено", "нет данных", "—", "-")
CONFIDENCES = ("high", "medium", "low")
BINARY_VALUES = ("yes", "no", "unknown")
YES_WORDS = ("true", "да", "имеется", "установлено", "присутствует")
NO_WORDS = ("false", "нет", "отсутствует", "не установлено", "не доказано")
CONFLICT_MAX_CHARS = 40

ABSOLUTE_KEYS = (
    "economic_dispute.economic_dispute_basket",
    "claim.claim_type",
    "claim.claim_origin",
    "creditor_profile.creditor_status",
    "creditor_profile.formal_affiliation_found",
    "creditor_profile.factual_affiliation_found",
    "creditor_profile.control_found",
    "crisis.crisis_status",
    "proof.performance_fact_proven",
    "proof.court_recognized_debt_real",
    "proof.court_doubted_reality",
    "proof.court_found_sham_or_artificial",
    "qualification.legal_qualification",
    "qualification.key_reason_category",
)
SOFT_KEYS = (
    "claim.emergence_timing",
    "creditor_profile.connection_basis_primary",
    "crisis.creditor_knew_crisis",
    "crisis.creditor_should_have_known_crisis",
    "behavior.new_financing_provided",
    "behavior.left_funds_in_debtor",
    "behavior.did_not_demand_repayment",
    "behavior.changed_contract_terms",
    "behavior.extended_maturity",
    "behavior.obtained_security",
    "behavior.obtained_preference",
    "behavior.participated_in_management",
    "behavior.acted_as_market_creditor",
    "market_terms.economic_sense_present",
    "market_terms.market_conditions_overall",
    "proof_burden.heightened_standard_applied",
    "proof_burden.burden_to_remove_doubts_on_creditor",
    "proof_burden.creditor_rebutted_doubts",
)
CONTEXTUAL_KEYS = (
    "market_terms.interest_terms",
    "market_terms.maturity_terms",
    "market_terms.security_terms",
    "proof.documents_contradictory",
    "proof.primary_docs_absent",
    "proof_burden.presumption_comp_financing_applied",
)
BINARY_FIELDS = (
    "formal_affiliation_found", "factual_affiliation_found", "control_found",
    "creditor_knew_crisis", "creditor_should_have_known_crisis",
    "new_financing_provided", "left_funds_in_debtor", "did_not_demand_repayment",
    "changed_contract_terms", "extended_maturity", "obtained_security", "obtained_preference",
    "participated_in_management", "acted_as_market_creditor", "economic_sense_present",
    "performance_fact_proven", "documents_present", "documents_contradictory",
    "primary_docs_absent", "court_recognized_debt_real", "court_doubted_reality",
    "heightened_standard_applied", "burden_to_remove_doubts_on_creditor",
    "presumption_comp_financing_applied",
    "motivation_facts_detailed", "motivation_affiliation_only", "motivation_economic_sense",
    "motivation_crisis", "motivation_independent_creditors", "motivation_market_terms",
    "motivation_good_faith", "motivation_formalistic", "motivation_contradictory",
)
NEEDED_CONTEXT = {
    "claim": "claimAndDealCard / courtAssessmentCard: договор, основание, период и природа требования",
    "creditor_profile": "creditorStatusCard / courtAssessmentCard: связь, аффилированность, контроль, статус кредитора",
    "crisis": "debtorCrisisCard: кризис, объективное банкротство, знание кредитора",
    "behavior": "creditorStatusCard / courtAssessmentCard: поведение кредитора, финансирование, взыскание, обеспечение, управление",
    "market_terms": "claimAndDealCard / courtAssessmentCard: проценты, сроки, обеспечение, рыночность",
    "proof": "proofAndEvidenceCard: исполнение, документы, реальность долга, мнимость",
    "proof_burden": "proofAndEvidenceCard / courtAssessmentCard: стандарт доказывания, бремя снятия сомнений",
    "qualification": "courtAssessmentCard: итог суда, причина исхода, резолютивный результат",
    "economic_dispute": "accepted claim, proof, creditor_profile, crisis, behavior and qualification fields",
    "metadata": "header zone",
}
NEEDED_CONTEXT_DEFAULT = "nearest source card fragments"

# Comparison views: ordered field lists of the two records.
SIMILARITY_FIELDS = (
    "economic_dispute.economic_dispute_basket",
    "claim.claim_type", "claim.claim_origin", "claim.emergence_timing",
    "creditor_profile.creditor_status", "creditor_profile.formal_affiliation_found",
    "creditor_profile.factual_affiliation_found", "creditor_profile.control_found",
    "creditor_profile.connection_basis_primary",
    "crisis.crisis_status", "crisis.creditor_knew_crisis", "crisis.creditor_should_have_known_crisis",
    "behavior.new_financing_provided", "behavior.left_funds_in_debtor",
    "behavior.did_not_demand_repayment", "behavior.changed_contract_terms",
    "behavior.extended_maturity", "behavior.obtained_security", "behavior.obtained_preference",
    "behavior.participated_in_management", "behavior.acted_as_market_creditor",
    "market_terms.interest_terms", "market_terms.maturity_terms", "market_terms.security_terms",
    "market_terms.economic_sense_present", "market_terms.market_conditions_overall",
    "proof.performance_fact_proven", "proof.documents_contradictory", "proof.primary_docs_absent",
    "proof.court_recognized_debt_real", "proof.court_doubted_reality",
    "proof.court_found_sham_or_artificial",
    "proof_burden.heightened_standard_applied", "proof_burden.burden_to_remove_doubts_on_creditor",
    "proof_burden.presumption_comp_financing_applied", "proof_burden.creditor_rebutted_doubts",
    "qualification.legal_qualification", "qualification.key_reason_category",
)
EXPLANATION_FIELDS = (
    "metadata.case_number", "metadata.court_name", "metadata.instance", "metadata.act_type",
    "metadata.act_date", "metadata.judge_name",
    "procedure.debtor_bankruptcy_type", "procedure.procedure_stage", "procedure.dispute_object",
    "procedure.applicant_role", "procedure.objector_profile",
    "claim.obligation_period_text", "crisis.crisis_period",
    "qualification.final_decision_text", "qualification.decisive_features_text",
    "qualification.non_material_features_text",
    "proof_burden.sufficient_evidence_summary", "proof_burden.insufficient_evidence_summary",
    "motivation.motivation_facts_detailed", "motivation.motivation_affiliation_only",
    "motivation.motivation_economic_sense", "motivation.motivation_crisis",
    "motivation.motivation_independent_creditors", "motivation.motivation_market_terms",
    "motivation.motivation_good_faith", "motivation.motivation_formalistic",
    "motivation.motivation_contradictory",
)
