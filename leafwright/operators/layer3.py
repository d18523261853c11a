"""Layer 3: decisions, rescue tasks, safe repairs with their check, final decisions."""

from __future__ import annotations

import re

from ..functions import text
from ..plans.dialect import CODED, Spark, choose, coded, codes, has, holds, one_of
from . import layer1, layer2
from .layer1 import COMPARISONS, UNITS

# Decision name, family, priority, changes the tree, uses a language model.
DECISIONS = {
    "safe_structural_repair_candidate": ("structural_repair", 20, 1, 0),
    "conservative_downgrade_candidate": ("conservative_downgrade", 30, 1, 0),
    "targeted_llm_rescue_candidate": ("llm_rescue_or_review", 40, 1, 1),
    "computability_review_or_partial": ("computability_review", 50, 0, 0),
    "optional_targeted_rescue_or_review": ("optional_review", 60, 0, 1),
    "keep_without_layer2_action_candidate": ("keep_no_action_reference", 80, 0, 0),
    "branch_a_diagnostic_only_not_auto_accept": ("diagnostic_only", 90, 0, 0),
    "human_review_or_abstain": ("human_review_or_abstain", 100, 0, 0),
}
# A task takes a leaf if one of its fragments stands in the joined codes; the first task wins.
RESCUE_TASKS = (
    ("entity_regrounding", ("entity_not_grounded", "entity_not_in", "entity_text_empty", "generic_entity_text", "entity_supported_by_source_token_overlap", "entity_partially_supported")),
    ("value_or_operator_recovery", ("comparison_without_scalar_value", "equality_without_value", "pattern_operator_without_scalar_value", "between_without_range_value", "range_with_both_bounds_missing", "range_with_missing_bound", "list_operator_without_list_value", "operator_value_not_structurally_supported", "value_not_grounded", "value_missing_with_quantitative_cue", "quantitative_cue_not_represented", "quantitative_cue_unhandled")),
    ("temporal_context_recovery", ("temporal_marker_without_temporal_context", "temporal_context_missing", "temporal_anchor_mismatch", "duration_marker_missing")),
    ("history_context_recovery", ("history_marker_without_history_context", "history_context_invalid")),
    ("condition_exception_context_recovery", ("condition_context_present", "condition_or_exception", "exception_context", "exception_clause", "computable_with_exception_context", "condition_exception")),
    ("polarity_negation_repair", ("negation_clause_with_exists_operator", "positive_clause_with_not_exists_operator", "negative_entity_with_not_exists_operator", "allowance_or_polarity", "not_exists", "negation")),
    ("entity_type_reclassification", ("entity_type_invalid", "entity_type_not_supported", "entity_type")),
)
SEVERITY = ("accept", "partial", "non_computable", "human_review")


def rescue_task(joined: str, default: str) -> str:
    return choose([("(" + " OR ".join(f"contains({joined}, '{p}')" for p in parts) + ")", f"'{task}'") for task, parts in RESCUE_TASKS], f"'{default}'")


def _decision(branch: str, rules: list[tuple[str, str]], default: str) -> list[tuple[str, str]]:
    pick = lambda k, q: choose([(t, q(DECISIONS[x][k])) for t, x in rules], q(DECISIONS[default][k]))
    task = choose(
        [
            (rules[0][0], "'deterministic_safe_normalization'"),
            (rules[1][0], "'deterministic_conservative_downgrade'"),
            (rules[2][0], f"named_task_{branch}"),
            *((t, "'computability_review'" if x == "computability_review_or_partial" else f"named_task_{branch}" if x.startswith("optional") else "'none'") for t, x in rules[3:]),
        ],
        "'none'" if branch == "a" else "'manual_review'",
    )
    return [
        (f"decision_{branch}", choose([(t, f"'{x}'") for t, x in rules], f"'{default}'")),
        (f"family_{branch}", pick(0, lambda v: f"'{v}'")),
        (f"priority_{branch}", pick(1, str)),
        (f"changes_tree_{branch}", pick(2, str)),
        (f"task_{branch}", task),
    ]


def said(d: Spark) -> list[tuple[str, str]]:
    """All that is said against a leaf in each branch, as one text."""
    joined = "concat_ws(' ', codes_1a, codes_1b, codes_1c, codes_1d, {})"
    return [("said_a", joined.format("risk_reasons, action_a")), ("said_b", joined.format("semantic_reasons, routing_reason, action_b"))]


def named_tasks(d: Spark) -> list[tuple[str, str]]:
    """The rescue task that each text stands for; for Spark by the codes it is made of."""
    defaults = {"a": "structured_llm_rescue_branch_a", "b": "structured_llm_judge_branch_b"}
    if type(d) is not Spark:
        return [(f"named_task_{b}", rescue_task(f"said_{b}", default)) for b, default in defaults.items()]
    return [(f"named_task_{b}", choose([(test, f"'{task}'") for task, parts in RESCUE_TASKS if (test := _task_test(d, b, parts))], f"'{default}'")) for b, default in defaults.items()]


def _task_test(d: Spark, branch: str, parts: tuple[str, ...]) -> str:
    """Whether one of the fragments stands in what is said against a leaf. No fragment holds a sign that stands between codes, so each lies within one of them."""
    within = lambda text: any(p in text for p in parts)
    tests = []
    for column in ("codes_1a", "codes_1b", "codes_1c", "codes_1d", "risk_reasons" if branch == "a" else "semantic_reasons"):
        names = [n for n in CODED[column] if within(n)]
        if names:
            tests.append(coded(column, names))
    # Texts out of fixed ones, of which two may be joined.
    for column, expression in {f"action_{branch}": dict(layer1._policy(branch))[f"action_{branch}"], **({"routing_reason": dict(layer2.routing_b(d))["routing_reason"]} if branch == "b" else {})}.items():
        fixed = re.findall(r"'(\w*)'", expression)
        tests += [f"contains({column}, '{p}')" for p in parts if any(p in a + b for a in fixed for b in fixed)]
    if branch == "a":
        # The reason for an operator of no category names it.
        tests.append("(operator_category = 'other' AND (" + " OR ".join(f"contains(operator, '{p}')" for p in parts) + "))")
    return "(" + " OR ".join(tests) + ")" if tests else ""


def decisions(d: Spark) -> list[tuple[str, str]]:
    """decision, family, priority and rescue task of each branch."""
    common = [("hint_1a = 'safe_normalization_candidate' OR {} = 'safe_normalization_candidate'", "safe_structural_repair_candidate"), ("hint_1a = 'conservative_rewrite_candidate'", "conservative_downgrade_candidate")]
    a = [(t.format("action_a"), x) for t, x in common] + [
        ("action_a = 'mandatory_rescue_or_review_candidate' OR risk_label = 'review_priority'", "targeted_llm_rescue_candidate"),
        ("action_a = 'computability_review_candidate'", "computability_review_or_partial"),
        ("risk_label = 'intermediate_support'", "optional_targeted_rescue_or_review"),
    ]
    b = [(t.format("action_b"), x) for t, x in common] + [
        ("action_b = 'mandatory_verifier_candidate' OR routing = 'llm_verifier'", "targeted_llm_rescue_candidate"),
        ("action_b = 'computability_review_candidate' OR routing = 'computability_review'", "computability_review_or_partial"),
        ("routing = 'keep_without_layer2_action'", "keep_without_layer2_action_candidate"),
        ("routing = 'optional_llm_verifier_or_review'", "optional_targeted_rescue_or_review"),
    ]
    return [*_decision("a", a, "branch_a_diagnostic_only_not_auto_accept"), *_decision("b", b, "human_review_or_abstain")]


def safe_repairs(d: Spark) -> list[tuple[str, str]]:
    """The repaired fields beside the old ones, and which repairs were made. Nothing is invented."""
    has_1a = lambda c: holds(d, "codes_1a", c)
    own_unit = d.replace("lower(trim(coalesce(unit, '')))", "s+$", "")
    copied = f"{one_of(own_unit, UNITS)} AND value_kind <> 'null'"
    context = "(t_relation IS NOT NULL OR t_value IS NOT NULL OR t_unit IS NOT NULL OR t_anchor IS NOT NULL)"
    numeric = f"{has_1a('comparison_value_is_numeric_string')} AND {one_of('operator', COMPARISONS)}"
    value = f"{has_1a('temporal_context_missing_value')} AND {context} AND t_value IS NULL AND {copied}"
    unit = f"{has_1a('temporal_context_missing_unit')} AND {context} AND t_unit IS NULL AND {copied}"
    partial = f"({has_1a('computable_with_exception_context')} OR {has_1a('computable_with_non_computable_reason')})"
    # A reason is appended once.
    parts = f"concat(';', {d.replace(text.norm(d, 'non_computable_reason'), ' *; *', ';')}, ';')"
    reason = f"CASE WHEN {text.norm(d, 'non_computable_reason')} = '' THEN {{0}} WHEN contains({parts}, concat(';', {{0}}, ';')) THEN non_computable_reason ELSE concat({text.norm(d, 'non_computable_reason')}, '; ', {{0}}) END"
    return [
        ("new_value_kind", f"CASE WHEN {numeric} THEN 'number' ELSE value_kind END"),
        ("new_value_num", f"CASE WHEN {numeric} THEN CAST(trim(value_text) AS DOUBLE) END"),
        ("new_computability", f"CASE WHEN {partial} THEN 'partial' ELSE computability END"),
        ("new_reason", choose([(has_1a("computable_with_exception_context"), reason.format("'exception_context_unresolved'")), (has_1a("non_computable_without_reason"), reason.format("'reason_missing_after_extraction'"))], "non_computable_reason")),
        ("new_t_value", f"CASE WHEN {value} THEN value_text ELSE t_value END"),
        ("new_t_unit", f"CASE WHEN {unit} THEN {own_unit} ELSE t_unit END"),
        ("repairs", codes([("comparison_value_is_numeric_string", numeric), ("computable_with_exception_context", has_1a("computable_with_exception_context")), ("computable_with_non_computable_reason", has_1a("computable_with_non_computable_reason")), ("non_computable_without_reason", has_1a("non_computable_without_reason")), ("temporal_context_missing_value", value), ("temporal_context_missing_unit", unit)])),
    ]


def repair_check(d: Spark) -> list[tuple[str, str]]:
    """Which fields changed, and whether the repairs made allow each of them."""
    fields = {
        "value": ("NOT (new_value_kind <=> value_kind)", ("comparison_value_is_numeric_string",)),
        "computability": ("NOT (new_computability <=> computability)", ("computable_with_exception_context", "computable_with_non_computable_reason")),
        "non_computable_reason": ("NOT (new_reason <=> non_computable_reason)", ("computable_with_exception_context", "non_computable_without_reason")),
        "temporal_context.value": ("NOT (new_t_value <=> t_value)", ("temporal_context_missing_value",)),
        "temporal_context.unit": ("NOT (new_t_unit <=> t_unit)", ("temporal_context_missing_unit",)),
    }
    same = (lambda t: t) if type(d) is Spark else (lambda t: t.replace("<=>", "IS NOT DISTINCT FROM"))
    allowed = lambda names: "(" + " OR ".join(has("repairs", n) for n in names) + ")"
    return [
        ("changed_fields", codes([(f, same(t)) for f, (t, _) in fields.items()])),
        ("forbidden_changes", codes([(f, f"{same(t)} AND NOT {allowed(n)}") for f, (t, n) in fields.items()])),
    ]


# Rules of the final decisions in their order, with what they come to and why.
FINAL_B = (
    ("action_b = 'mandatory_verifier_candidate'", "human_review", "B_layer1_hard_issue", "branch_b_layer1_mandatory_verifier_remains"),
    ("routing = 'llm_verifier'", "human_review", "B_llm_verifier", "branch_b_final_routing_llm_verifier"),
    ("semantic_label = 'reference_review_priority'", "human_review", "B_semantic_high_risk", "branch_b_semantic_grounding_high_risk"),
    ("computability = 'non_computable'", "non_computable", "B_non_computable", "branch_b_non_computable"),
    ("routing = 'computability_review'", "partial", "B_computability_review", "branch_b_computability_review"),
    ("computability = 'partial'", "partial", "B_partial_computability", "branch_b_partial_computability"),
    ("execution_label = 'reference_review_priority'", "partial", "B_execution_risk", "branch_b_execution_reference_review_priority_risk"),
    ("execution_label = 'reference_intermediate_support'", "partial", "B_execution_risk", "branch_b_execution_reference_intermediate_support_risk"),
    ("routing = 'optional_llm_verifier_or_review'", "partial", "B_optional_review_partial", "branch_b_optional_verifier_or_review"),
    ("semantic_label = 'reference_intermediate_support'", "partial", "B_semantic_medium_risk", "branch_b_semantic_grounding_medium_risk"),
    ("routing = 'keep_without_layer2_action'", "accept", "B_accept", "branch_b_accept_routing_low_semantic_risk"),
)
FINAL_A = (
    ("action_a = 'mandatory_rescue_or_review_candidate'", "human_review", "A_layer1_hard_issue", "branch_a_layer1_mandatory_rescue_or_review_remains"),
    ("risk_label = 'review_priority'", "human_review", "A_layer2_high_risk", "branch_a_layer2_high_risk_after_rescue"),
    ("computability = 'non_computable'", "non_computable", "A_non_computable", "branch_a_non_computable"),
    ("computability = 'partial'", "partial", "A_partial_computability", "branch_a_partial_computability"),
    ("action_a = 'computability_review_candidate'", "partial", "A_computability_review", "branch_a_layer1_computability_review"),
    ("risk_label = 'intermediate_support'", "partial", "A_layer2_medium_risk", "branch_a_medium_risk_after_rescue"),
    ("risk_label = 'high_support_not_auto_accept' AND coalesce(computability, '') IN ('', 'computable')", "accept", "A_low_risk_accept", "branch_a_low_risk_no_hard_issue"),
    ("bucket_a = 'safe_normalization_only'", "accept", "A_safe_normalization_accept", "branch_a_safe_normalization_only"),
)


def _first(rules, at: int, default: str) -> str:
    return choose([(r[0], f"'{r[at]}'") for r in rules], f"'{default}'")


def forced_review(d: Spark) -> list[tuple[str, str]]:
    """forced_why: why the rescue leaves a leaf to a person, in order; empty if it does not. Columns: rescue_decision, apply_status, local_validation, skip_reason."""
    unchanged = "coalesce(rescue_decision, '') IN ('', 'no_change') OR coalesce(substr(skip_reason, 1, 39) = 'not_applicable_final_decision:no_change', false)"
    rules = [
        (unchanged, "''"),
        ("rescue_decision = 'human_review'", "'candidate_selection_rescue_returned_human_review'"),
        ("rescue_decision = 'no_repair_possible'", "'candidate_selection_rescue_returned_no_repair_possible'"),
        ("coalesce(local_validation = 'fail', false)", "'candidate_selection_rescue_failed_local_validation'"),
        ("coalesce(apply_status = 'skipped', false) AND coalesce(skip_reason, '') <> ''", "concat('candidate_selection_rescue_skipped:', lower(skip_reason))"),
    ]
    return [("forced_why", choose(rules, "''"))]


def final_b(d: Spark) -> list[tuple[str, str]]:
    """final_b, its rule and its reason; a rescue that is not resolved goes first."""
    first = lambda unresolved, at, default: f"CASE WHEN forced_why <> '' THEN {unresolved} ELSE {_first(FINAL_B, at, default)} END"
    return [("final_b", first("'human_review'", 1, "partial")), ("rule_b", first("'B_rescue_unresolved'", 2, "B_default_partial")), ("final_reasons_b", first("forced_why", 3, "branch_b_uncertain_default_partial"))]


def final_decisions(d: Spark) -> list[tuple[str, str]]:
    """final_a, its rule and its reasons: a leaf taken over from branch B follows B's decision, or goes to a person if there is none (``b_decided``)."""
    replaced, missing = "coalesce(from_b, false)", "NOT coalesce(b_decided, false)"

    def first(unresolved: str, lost: str, taken: str, at: int, default: str) -> str:
        return f"CASE WHEN forced_why <> '' THEN {unresolved} WHEN {replaced} AND {missing} THEN {lost} WHEN {replaced} THEN {taken} ELSE {_first(FINAL_A, at, default)} END"

    return [
        ("final_a", first("'human_review'", "'human_review'", "final_b", 1, "partial")),
        ("rule_a", first("'A_rescue_unresolved'", "'A_hybrid_from_B_missing_b_decision'", "concat('A_hybrid_from_B_', final_b)", 2, "A_default_partial")),
        ("final_reasons_a", first("forced_why", "'branch_a_replaced_by_branch_b_but_missing_branch_b_final_decision'", "concat('branch_a_replaced_by_validated_branch_b_leaf;using_branch_b_post_rescue_decision:', final_b)", 3, "branch_a_uncertain_default_partial")),
    ]


def cross_branch(d: Spark) -> list[tuple[str, str]]:
    """The branch with the milder decision; B where they are equal."""
    rank = lambda x: "CASE " + x + " " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(SEVERITY)) + " ELSE 9 END"
    b_first = f"({rank('final_b')}) <= ({rank('final_a')})"
    return [("chosen_branch", f"CASE WHEN {b_first} THEN 'B' ELSE 'A' END"), ("chosen_decision", f"CASE WHEN {b_first} THEN final_b ELSE final_a END")]


def review_text(d: Spark) -> list[tuple[str, str]]:
    """The compact leaf string of review sheets."""
    return [("compact_leaf", f"concat_ws(' | ', nullif({text.norm(d, 'entity_text')}, ''), entity_type, operator, nullif(coalesce(value_text, ''), ''), unit, computability)")]
