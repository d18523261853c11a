"""Rescue: candidates and their stage, the plan of branch A, validation, overlay, gate.

Columns in: those of layer 3, and ``b_*`` columns of the branch B leaf of the same criterion.
"""

from __future__ import annotations

from ..functions import text
from ..plans.dialect import Spark, choose, codes, hits, one_of
from .layer1 import ANCHORS, COMPARISONS, COMPUTABILITY, ENTITY_TYPES, EQUALITIES, EXISTENCE, HISTORY, LISTS, OPERATORS, RELATIONS, UNITS, VALUE_TYPES

# Terms and tasks that decide.
CONSERVATIVE = (("list_operator_without_list_value", "list_value_recovery"), ("range_with_both_bounds_missing", "range_bounds_recovery"), ("comparison_without_scalar_value", "scalar_value_recovery"))
TASK_TERMS = (
    ("entity_regrounding", ("entity_not_grounded", "entity_not_in_evidence", "entity_text_empty", "generic_entity_text", "no_bert_anchor", "entity_partially_supported", "entity_supported_by_source_token_overlap")),
    ("value_or_operator_recovery", ("comparison_without_scalar_value", "operator_value_not_structurally_supported", "value_not_grounded", "value_missing", "quantitative_cue_not_represented", "quantitative_cue_unhandled", "equality_without_value", "pattern_operator_without_scalar_value")),
    ("temporal_context_recovery", ("temporal_marker_without_temporal_context", "temporal_context_missing", "temporal_anchor_mismatch", "duration_marker_missing")),
    ("history_context_recovery", ("history_marker_without_history_context", "history_context_invalid", "history_context_missing")),
    ("condition_exception_context_recovery", ("condition_context_present", "condition_or_exception", "exception_context", "exception_clause", "computable_with_exception_context", "condition_exception", "exception_or_condition_clause_without_context_handling")),
    ("polarity_negation_repair", ("negation", "not_exists", "polarity", "negative_entity_with_not_exists_operator")),
    ("entity_type_reclassification", ("entity_type_invalid", "entity_type_other", "entity_type_not_supported", "bad_entity_type")),
    ("duplicate_prune_or_merge_judge", ("duplicate",)),
)
CONTEXT_TERMS = ("condition_context_present_without_handling", "exception_or_condition_clause_without_context_handling", "exception_clause_computable_despite_context", "computable_with_exception_context")
ENTITY_TERMS = ("entity_not_in_evidence", "entity_not_grounded", "entity_not_grounded_in_evidence_or_item", "entity_text_empty", "generic_entity_text", "critical_qualifier_missing_from_entity", "entity_type_not_supported_by_best_anchor", "entity_text_not_aligned_with_any_anchor")
OTHER_ACTIONABLE = ("temporal_marker_without_temporal_context", "history_marker_without_history_context", "condition_context_present_without_handling", "comparison_without_scalar_value", "value_missing_with_quantitative_cue", "quantitative_cue_unhandled", "negation_clause_with_exists_operator", "positive_clause_with_not_exists_operator", "negative_entity_with_not_exists_operator")
POLARITY_TERMS = ("negation_clause_with_exists_operator", "positive_clause_with_not_exists_operator", "negative_entity_with_not_exists_operator")
SCOPE_TERMS = ("condition_context_present", "condition_context_present_without_handling", "exception_or_condition_clause_without_context_handling", "exception_clause_computable_despite_context", "computable_with_exception_context", "condition_exception", "exception_context")
ACTIONABLE_TASKS = ("list_value_recovery", "range_bounds_recovery", "scalar_value_recovery", "value_or_operator_recovery", "temporal_context_recovery", "history_context_recovery", "polarity_negation_repair")
APPLICABLE = ("select_candidate", "mark_partial_or_non_computable")
JUDGED_TASKS = ("branch_a_field_level_semantic_rescue", "duplicate_prune_or_merge_judge", "condition_exception_context_recovery")


def terms(d: Spark) -> list[tuple[str, str]]:
    """All diagnosis terms of a leaf in each branch, joined by semicolons, and whether a conservative structural issue is among them."""
    shared = "codes_1a, codes_1b, codes_1c, codes_1d"
    filled = lambda rest: "concat_ws(';', " + ", ".join(f"nullif({c}, '')" for c in f"{shared}, {rest}".split(", ")) + ")"
    return [("terms_a", filled("risk_reasons, action_a")), ("terms_b", filled("semantic_reasons, routing_reason, action_b")), ("is_conservative", f"{hits(d, 'codes_1a', [c for c, _ in CONSERVATIVE])} > 0")]


def low_terms(d: Spark) -> list[tuple[str, str]]:
    return [("low_terms_a", "lower(terms_a)"), ("low_terms_b", "lower(terms_b)")]


def candidates(d: Spark) -> list[tuple[str, str]]:
    """Task, kind, stage, judge-first and attempts of each branch's rescue candidate."""
    out = []
    for b, default in (("a", "branch_a_field_level_semantic_rescue"), ("b", "branch_b_field_level_semantic_judge")):
        first = [(f"{hits(d, 'codes_1a', (c,))} > 0", f"'{t}'") for c, t in CONSERVATIVE]
        rest = [("(" + " OR ".join(f"contains(low_terms_{b}, '{x}')" for x in names) + ")", f"'{t}'") for t, names in TASK_TERMS]
        target, optional = f"decision_{b} = 'targeted_llm_rescue_candidate'", f"decision_{b} = 'optional_targeted_rescue_or_review'"
        stages = ("P1_run_now_branch_b_mandatory_judge", "P2_budget_allows_branch_b_optional_judge") if b == "b" else ("P3_branch_a_mandatory_diagnostic_rescue_or_ablation", "P4_branch_a_optional_diagnostic_rescue")
        out += [
            (f"rescue_type_{b}", choose([*first, *rest], f"'{default}'")),
            (f"kind_{b}", choose([("is_conservative", "'conservative_structural_recovery_before_downgrade'"), (target, "'mandatory_llm_rescue_or_judge'"), (optional, "'optional_llm_rescue_or_review'")], "'other'")),
            (f"stage_{b}", choose([("is_conservative", "'P1_run_now_conservative_structural_recovery'"), (target, f"'{stages[0]}'"), (optional, f"'{stages[1]}'")], "'P9_not_scheduled'")),
            (f"attempts_{b}", "3" if b == "b" else "2"),
        ]
    return out


def judge_first(d: Spark) -> list[tuple[str, str]]:
    """Branch B is always judged first; branch A only for broad tasks without a conservative issue."""
    return [("judge_first_a", f"CASE WHEN NOT is_conservative AND rescue_type_a IN ({', '.join(repr(t) for t in JUDGED_TASKS)}) THEN 1 ELSE 0 END"), ("judge_first_b", "1")]


# The order of stages, what a model may answer, and the fields that it is asked to judge.
STAGE_ORDER = ("P1_run_now_conservative_structural_recovery", "P1_run_now_branch_b_mandatory_judge", "P2_budget_allows_branch_b_optional_judge", "P3_branch_a_mandatory_diagnostic_rescue_or_ablation", "P4_branch_a_optional_diagnostic_rescue")
JUDGE_ANSWERS = "accept | minor_fix | reextract_leaf | mark_partial_or_non_computable | human_review | no_repair_possible"
RECOVERY_ANSWERS = "repaired | no_repair_possible | human_review"
REPAIR_ANSWERS = "repaired | no_repair_possible | human_review | mark_partial_or_non_computable"
JUDGED_FIELDS = ("entity_text", "entity_type", "operator", "value", "unit", "temporal_context", "history_context", "condition_exception_context", "computability")
RECOVERED = {"list_value_recovery": ("value_type", "value"), "range_bounds_recovery": ("value_type", "value", "unit"), "scalar_value_recovery": ("value_type", "value", "unit")}


def wanted_answer(d: Spark, branch: str) -> list[tuple[str, str]]:
    """Which answers a candidate's model may give, and which fields it judges or repairs."""
    names = lambda xs: "'" + ";".join(xs) + "'"
    task, judged = f"rescue_type_{branch}", f"judge_first_{branch} = 1"
    return [
        (f"answers_{branch}", choose([(judged, f"'{JUDGE_ANSWERS}'"), (one_of(task, tuple(RECOVERED)), f"'{RECOVERY_ANSWERS}'")], f"'{REPAIR_ANSWERS}'")),
        (f"answer_fields_{branch}", choose([(judged, names(JUDGED_FIELDS)), *((f"{task} = '{t}'", names(f)) for t, f in RECOVERED.items())], "''")),
    ]


def payload(branch: str) -> list[tuple[str, str]]:
    """SQL (Spark) of a candidate's id, the place of its stage, and what its model is given, as JSON: the leaf's key, evidence and diagnosis."""
    side = branch.upper()
    codes_of = lambda *cols: f"filter(split(concat_ws(';', {', '.join(cols)}), ';'), c -> c <> '')"
    issues = f"array_intersect(split(codes_1a, ';'), array({', '.join(repr(c) for c, _ in CONSERVATIVE)}))"
    labels = "'risk_label', risk_label, 'reasons', {}" if branch == "a" else "'routing', routing, 'semantic_label', semantic_label, 'reasons', {}"
    reasons = codes_of("risk_reasons") if branch == "a" else codes_of("semantic_reasons")
    diagnosis = f"named_struct('action', decision_{branch}, 'family', family_{branch}, 'codes', array_distinct({codes_of('codes_1a', 'codes_1b', 'codes_1c', 'codes_1d')}), {labels.format(reasons)}, 'conservative_issues', {issues})"
    order = choose([(f"stage_{branch} = '{x}'", str(k + 1)) for k, x in enumerate(STAGE_ORDER)], "99")
    return [
        (f"candidate_id_{branch}", f"concat('{side}__', key_id, '__', rescue_type_{branch})"),
        (f"stage_order_{branch}", order),
        (f"payload_{branch}", f"to_json(named_struct('task_type', rescue_type_{branch}, 'branch', '{side}', 'document_id', document_id, 'criterion_id', key_id, 'evidence_text', trim(evidence_text), 'diagnosis', {diagnosis}))"),
    ]


def b_usable(d: Spark) -> list[tuple[str, str]]:
    """Whether branch B can be offered for branch A, and why (not); needs b_entity_text, b_evidence_text, b_computability, b_found."""
    soft = f"concat_ws(';', CASE WHEN b_computability = 'non_computable' THEN 'branch_b_non_computable' END, CASE WHEN {hits(d, 'terms_b', SCOPE_TERMS)} > 0 THEN 'branch_b_context_or_exception_scope_problem' END)"
    blocked = [
        ("NOT b_found", "'no_matching_branch_b_decision_row'"),
        (f"{text.norm(d, 'b_entity_text')} = ''", "'branch_b_missing_entity_text'"),
        (f"{text.norm(d, 'b_evidence_text')} = ''", "'branch_b_missing_evidence_text'"),
        (f"{hits(d, 'terms_b', POLARITY_TERMS)} > 0", "'branch_b_polarity_problem'"),
        ("is_conservative", "'branch_b_structural_value_problem'"),
    ]
    offered = f"concat('branch_b_available_as_candidate_routing:', routing, CASE WHEN {soft} = '' THEN '' ELSE concat('|soft_warning:', {soft}) END)"
    return [("b_allowed", f"NOT ({' OR '.join(t for t, _ in blocked)})"), ("b_reason", choose(blocked, offered))]


def plan_a(d: Spark) -> list[tuple[str, str]]:
    """Execution group, priority and strategy of branch A: seven rules, the first that holds."""
    explicit = [*ENTITY_TERMS, *(c for c, _ in CONSERVATIVE), *OTHER_ACTIONABLE]
    only_anchor = f"({hits(d, 'terms_a', ('no_bert_anchor', 'missing_bert_anchor'))} > 0 AND {hits(d, 'terms_a', explicit)} = 0)"
    task = lambda names: one_of("rescue_type_a", names)
    rules = [
        ("is_conservative", "A_main_llm_rescue", 10, "recover_structural_information_or_abstain"),
        (f"{task(('condition_exception_context_recovery',))} OR {hits(d, 'terms_a', CONTEXT_TERMS)} > 0", "A_status_or_review", 30, "abstain_or_human_review_for_context_logic"),
        (task(("duplicate_prune_or_merge_judge", "branch_a_field_level_semantic_rescue")), "A_deferred_diagnostic", 90, "defer_broad_or_duplicate_task"),
        (only_anchor, "A_deferred_diagnostic", 80, "defer_no_bert_anchor_only"),
        (task(ACTIONABLE_TASKS), "A_main_llm_rescue", 20, "targeted_field_recovery_with_candidate_check"),
        (f"{task(('entity_regrounding', 'entity_type_reclassification'))} OR {hits(d, 'terms_a', ENTITY_TERMS)} > 0", "A_main_llm_rescue", 25, "entity_candidate_selection_not_anchor_only"),
    ]
    last = ("A_deferred_diagnostic", 95, "defer_non_actionable_high_risk")
    return [
        ("only_no_anchor", only_anchor),
        ("plan_group", choose([(t, f"'{g}'") for t, g, _, _ in rules], f"'{last[0]}'")),
        ("plan_priority", choose([(t, str(p)) for t, _, p, _ in rules], str(last[1]))),
        ("plan_strategy", choose([(t, f"'{s}'") for t, _, _, s in rules], f"'{last[2]}'")),
    ]


def plan_b(d: Spark) -> list[tuple[str, str]]:
    """Execution group, priority, strategy, task and attempts of branch B: mandatory rows are judged, accepted ones stay as they are, all others are blocked from the main budget."""
    mandatory = "stage_b = 'P1_run_now_branch_b_mandatory_judge'"
    kept = "(decision_b = 'keep_without_layer2_action_candidate' OR routing = 'keep_without_layer2_action')"
    rules = [
        (mandatory, "B_main_llm_rescue", 25, "branch_b_dejure_judge_repair_loop", "rescue_type_b", 1, 3, 0),
        (kept, "B_accept_no_change_reference", 5, "keep_without_layer2_action_reference", "'none'", 0, 0, 0),
    ]
    last = ("B_blocked_or_manual_review", 85, "optional_branch_b_review_not_main_rescue", "rescue_type_b", 0, 0, 1)
    pick = lambda k, quote: choose([(r[0], quote(r[k + 1])) for r in rules], quote(last[k]))
    words = lambda v: f"'{v}'"
    return [("plan_group_b", pick(0, words)), ("plan_priority_b", pick(1, str)), ("plan_strategy_b", pick(2, words)), ("plan_task_b", pick(3, str)), ("requires_llm_b", pick(4, str)), ("max_attempts_b", pick(5, str)), ("blocked_b", pick(6, str))]


def overlay(d: Spark) -> list[tuple[str, str]]:
    """The branch A leaf with the fields of the selected branch B leaf; the id stays, and so does a negation unless polarity is the task."""
    keeps = "(operator = 'not_exists' AND rescue_type_a <> 'polarity_negation_repair' AND b_operator = 'exists')"
    take = lambda f: f"CASE WHEN b_found THEN b_{f} ELSE {f} END"
    none = f"({take('value_type')} = 'null')"
    return [
        ("c_entity_type", take("entity_type")),
        ("c_entity_text", take("entity_text")),
        ("c_operator", f"CASE WHEN b_found AND NOT coalesce({keeps}, false) THEN b_operator ELSE operator END"),
        ("c_value_type", take("value_type")),
        ("c_value_kind", f"CASE WHEN {none} THEN 'null' ELSE {take('value_kind')} END"),
        ("c_value_text", f"CASE WHEN NOT {none} THEN {take('value_text')} END"),
        ("c_unit", take("unit")),
        ("c_computability", take("computability")),
        ("c_reason", f"CASE WHEN {take('computability')} = 'non_computable' AND {text.norm(d, 'non_computable_reason')} = '' THEN 'Marked non-computable by Layer 3 candidate-selection rescue.' ELSE non_computable_reason END"),
    ]


def validation(d: Spark) -> list[tuple[str, str]]:
    """Why the overlaid leaf would not do, sorted; empty if it would."""
    source = "concat_ws(' ', low_clause_text, low_item_text, low_evidence_text)"
    entity = f"lower({text.norm(d, 'c_entity_text')})"
    none, temporal = "c_value_kind = 'null'", "(t_relation IS NOT NULL OR t_value IS NOT NULL OR t_unit IS NOT NULL OR t_anchor IS NOT NULL)"
    kind = lambda t: f"coalesce(c_value_type = '{t}', false)"
    operator = lambda names: one_of("c_operator", names)
    pairs = [
        ("missing_entity_text", f"{entity} = ''"),
        ("missing_evidence_text", "low_evidence_text = ''"),
        ("entity_type_not_allowed", f"NOT {one_of('c_entity_type', ENTITY_TYPES)}"),
        ("operator_not_allowed", f"NOT {operator(OPERATORS)}"),
        ("value_type_not_allowed", f"NOT {one_of('c_value_type', VALUE_TYPES)}"),
        ("computability_not_allowed", f"NOT {one_of('c_computability', COMPUTABILITY)}"),
        ("history_context_not_allowed", f"history_context IS NOT NULL AND NOT {one_of('history_context', HISTORY)}"),
        ("temporal_relation_not_allowed", f"{temporal} AND NOT {one_of('t_relation', RELATIONS)}"),
        ("temporal_unit_not_allowed", f"t_unit IS NOT NULL AND NOT {one_of('t_unit', UNITS)}"),
        ("temporal_anchor_event_not_allowed", f"{temporal} AND NOT {one_of('t_anchor', ANCHORS)}"),
        ("null_value_type_with_nonnull_value", f"{kind('null')} AND NOT {none}"),
        ("scalar_value_type_with_invalid_value", f"{kind('scalar')} AND c_value_kind IN ('null', 'list', 'range')"),
        ("list_value_type_with_invalid_value", f"{kind('list')} AND (c_value_kind <> 'list' OR coalesce(c_value_text, '') = '')"),
        ("range_value_type_with_invalid_value", f"{kind('range')} AND c_value_kind <> 'range'"),
        ("range_with_both_bounds_missing", f"{kind('range')} AND c_value_kind = 'range' AND value_min IS NULL AND value_max IS NULL"),
        ("comparison_operator_without_scalar_value", f"{operator((*COMPARISONS, *EQUALITIES))} AND (NOT {kind('scalar')} OR {none})"),
        ("between_operator_without_range_value", f"{operator(('between',))} AND NOT {kind('range')}"),
        ("list_operator_without_list_value", f"{operator(LISTS)} AND NOT {kind('list')}"),
        ("existence_operator_with_non_null_value_type", f"{operator(EXISTENCE)} AND NOT {kind('null')}"),
        ("entity_text_not_in_source_context", f"{entity} <> '' AND low_evidence_text <> '' AND NOT contains({source}, {entity})"),
        ("non_computable_without_reason", f"coalesce(c_computability = 'non_computable', false) AND {text.norm(d, 'c_reason')} = ''"),
    ]
    return [("validation_errors", codes(pairs))]


def gate(d: Spark) -> list[tuple[str, str]]:
    """Why the candidate is not applied, empty if it is: the decision, validation, a selected leaf, a change at all, then new schema errors.

    ``old_*`` are the fields before the overlay, ``new_errors`` structural codes of the overlaid leaf that the old one had not. ``rescue_apply`` is the same over nested trees.
    """
    fields = ("entity_type", "entity_text", "operator", "value_type", "value_kind", "value_text", "unit", "computability")
    same = " AND ".join(f"c_{f} IS NOT DISTINCT FROM old_{f}" for f in fields) + " AND c_reason IS NOT DISTINCT FROM old_non_computable_reason"
    rules = [
        (f"NOT {one_of('rescue_decision', APPLICABLE)}", "concat('not_applicable_final_decision:', coalesce(rescue_decision, ''))"),
        ("validation_errors <> ''", "'local_validation_not_pass:fail'"),
        ("NOT b_found", "'selected_leaf_missing_or_not_object'"),
        (same, "'candidate_identical_to_target_leaf'"),
        ("new_errors <> ''", "concat('full_ast_schema_new_invalid:', new_errors)"),
    ]
    return [("skip_why", choose(rules, "''"))]
