"""Values as JSON texts: their atoms, whether a source holds them, range flags; and layer 1 without a policy.

SQL texts for ``dialect.apply``; sources are compared in their numeric normal form.
"""

from __future__ import annotations

from ..functions import text
from ..plans.dialect import Spark, choose

# Keys of a value that hold atoms; codes of meaning, and what codes of use are made of.
KEYS = ("min", "max", "lower", "upper", "value")
SEMANTIC = (
    "comparison_without_scalar_value", "comparison_value_missing", "range_with_both_bounds_missing", "list_operator_without_list_value", "categorical_value_missing",
    "existence_operator_with_non_null_value", "existence_operator_on_quantitative_phrase", "critical_qualifier_missing_from_entity", "comparison_entity_mismatch_from_source",
    "comparison_with_non_quantitative_entity", "requirement_object_inversion", "temporal_marker_without_temporal_context", "temporal_anchor_mismatch_from_source",
    "duration_marker_missing_from_temporal_context", "condition_context_present_without_handling", "exception_or_condition_clause_without_context_handling",
    "exception_or_condition_clause_with_computable_status", "exception_clause_computable_despite_context", "evidence_text_not_substring_of_pass1_source_text",
    "negation_clause_with_exists_operator", "positive_clause_with_not_exists_operator", "negative_entity_with_not_exists_operator",
)
EXECUTION = ("computable_with_exception_context", "computable_with_non_computable_reason", "non_computable_without_reason", "non_computable_reason", "partial", "non_computable")


def _atoms(v: str, below: int) -> str:
    """Atoms of a VARIANT: of lists all, of objects those of the known keys in their order, else the value itself; lists and objects within each other as deep as ``below``."""
    one = f"CASE WHEN is_variant_null({v}) OR {v} IS NULL THEN CAST(array() AS array<string>) ELSE filter(array(trim(try_variant_get({v}, '$', 'string'))), x{below} -> x{below} <> '') END"
    if not below:
        return one
    listed = f"flatten(transform(try_variant_get({v}, '$', 'array<variant>'), y{below} -> {_atoms(f'y{below}', below - 1)}))"
    keyed = f"flatten(array({', '.join(_atoms(f'''try_variant_get({v}, '$.{k}')''', below - 1) for k in KEYS)}))"
    kind = f"schema_of_variant({v})"
    return f"CASE WHEN {v} IS NULL THEN CAST(array() AS array<string>) WHEN startswith({kind}, 'ARRAY') THEN {listed} WHEN startswith({kind}, 'OBJECT') THEN {keyed} ELSE {one} END"


def parsed(d: Spark) -> list[tuple[str, str]]:
    """The value's text as JSON, or as a text where it is none; its normal form and those of the sources."""
    return [
        ("v_parsed", "coalesce(try_parse_json(nullif(trim(value_text), '')), parse_json(to_json(named_struct('x', trim(coalesce(value_text, ''))))):x)"),
        ("v_norm", text.numeric(d, "value_text")),
        ("v_ev", text.numeric(d, "evidence_text")),
        ("v_item", text.numeric(d, "item_text")),
    ]


def atoms(d: Spark) -> list[tuple[str, str]]:
    return [("v_source", "concat(v_ev, ' ', v_item)"), ("v_atoms", _atoms("v_parsed", 2))]


def normal_atoms(d: Spark) -> list[tuple[str, str]]:
    return [("v_parts", f"filter(transform(v_atoms, a -> {text.numeric(d, 'a')}), a -> a <> '')")]


def value_support(d: Spark) -> list[tuple[str, str]]:
    """value_support and value_reason: 1 for no value or one that the evidence or the source holds, 0.85 where only the item is known to, else 0.45.

    Columns: value_text, value_type, evidence_text, item_text, in_evidence, in_item.
    """
    quoted = lambda x: f"concat('\\\\Q', {x}, '\\\\E')"
    a, b = quoted("v_parts[0]"), quoted("v_parts[1]")
    range_of = lambda between: f"regexp_like(v_source, concat('\\\\b', {a}, '{between}', {b}, '\\\\b'))"
    two = f"(size(v_parts) = 2 AND ({range_of('\\\\s*-\\\\s*')} OR {range_of('\\\\s+to\\\\s+')} OR {range_of('\\\\s+or\\\\s+')}))"
    smoker = "(v_norm IN ('non smoker', 'non-smoker') AND regexp_like(v_source, '\\\\bnon[- ]?smoking\\\\b'))"
    held = f"(size(v_parts) = 0 OR v_norm <> '' AND (v_ev <> '' AND contains(v_ev, v_norm) OR v_item <> '' AND contains(v_item, v_norm)) OR forall(v_parts, p -> contains(v_source, p)) OR {two} OR {smoker})"
    none = "trim(coalesce(value_text, '')) = '' OR lower(trim(coalesce(value_type, ''))) IN ('', 'null', 'none', 'nan')"
    rules = [(none, "1.0", "''"), ("coalesce(in_evidence, false)", "1.0", "''"), (held, "1.0", "''"), ("coalesce(in_item, false)", "0.85", "'value_not_in_evidence_but_in_item'")]
    return [
        ("value_support", choose([(t, f"CAST({v} AS DOUBLE)") for t, v, _ in rules], "CAST(0.45 AS DOUBLE)")),
        ("value_reason", choose([(t, r) for t, _, r in rules], "'value_not_grounded_in_evidence_or_item'")),
    ]


VALUE = (parsed, atoms, normal_atoms, value_support)


def range_flags(v: str) -> list[tuple[str, str]]:
    """has_min, has_max and either, of a VARIANT; a JSON null counts as missing."""
    given = lambda k: f"coalesce(startswith(schema_of_variant({v}), 'OBJECT') AND NOT is_variant_null(try_variant_get({v}, '$.{k}')), false)"
    return [("has_min", given("min")), ("has_max", given("max")), ("has_bound", f"({given('min')} OR {given('max')})")]


def issues(d: Spark) -> list[tuple[str, str]]:
    """Layer-1 codes (``all_codes``, joined) by what they bear on; unknown ones count as meaning."""
    listed = lambda names: ", ".join(f"'{n}'" for n in names)
    use = " OR ".join(f"contains(lower(c), '{k}')" for k in EXECUTION)
    each = "array_distinct(filter(transform(split(all_codes, ';'), c -> trim(c)), c -> c <> ''))"
    return [("n_issues", f"size({each})"), ("use_issues", f"filter({each}, c -> NOT c IN ({listed(SEMANTIC)}) AND ({use}))"), ("meaning_issues", f"filter({each}, c -> c IN ({listed(SEMANTIC)}) OR NOT ({use}))")]


def layer1_support(d: Spark) -> list[tuple[str, str]]:
    """semantic_l1 and execution_l1 with their reasons: by the policy's action where there is one, else by how many issues there are."""
    action = "lower(trim(coalesce(policy_action, '')))"
    n, m = "size(meaning_issues)", "size(use_issues)"
    number = lambda rules, last: choose([(t, f"CAST({v} AS DOUBLE)") for t, v in rules], f"CAST({last} AS DOUBLE)")
    by_count = number([(f"{n} = 0", 1.0), (f"{n} = 1", 0.65), (f"{n} = 2", 0.5)], 0.35)
    used = number([(f"{m} = 0 AND n_issues = 0", 1.0), (f"{m} = 0", 0.9), (f"{m} = 1", 0.7), (f"{m} = 2", 0.55)], 0.4)
    prefixed = lambda what, prefix: f"array_join(transform(array_sort({what}), c -> concat('{prefix}', c)), ';')"
    return [
        ("semantic_l1", f"CASE {action} WHEN '' THEN {by_count} WHEN 'mandatory_verifier_candidate' THEN CAST(0.5 AS DOUBLE) WHEN 'continue_to_layer2_grounding_screen' THEN CAST(0.8 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END"),
        ("execution_l1", f"CASE {action} WHEN '' THEN {used} WHEN 'computability_review_candidate' THEN CAST(0.7 AS DOUBLE) ELSE CASE WHEN n_issues = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END END"),
        ("semantic_l1_reasons", f"CASE {action} WHEN '' THEN {prefixed('meaning_issues', 'layer1_semantic:')} WHEN 'mandatory_verifier_candidate' THEN 'layer1_policy:hard_semantic_or_structural_issue' WHEN 'continue_to_layer2_grounding_screen' THEN 'layer1_policy:soft_semantic_warning' ELSE '' END"),
        ("execution_l1_reasons", f"CASE {action} WHEN '' THEN {prefixed('use_issues', 'layer1_execution:')} WHEN 'computability_review_candidate' THEN 'layer1_execution:layer1_policy_execution_issue' ELSE '' END"),
    ]
