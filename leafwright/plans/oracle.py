"""Hand-written SQL of layers 1 to 3 for the oracle database.

Nothing here is rendered from the operators: the rules are written a second
time, in another form (code lists, set operations), so that a wrong rule on one
side shows. Only the leaf fixture and the lists of fixed values are shared.
"""

from __future__ import annotations

import re

from ..functions import text
from ..operators import layer1, layer2
from .leaves import leaves_sql


def _listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_N = r"lower(trim(regexp_replace(coalesce({0}, ''), '[ \t\n\r\f]+', ' ', 'g')))"
_LIST = "array_to_string(list_sort(list_filter([{0}], lambda x: x IS NOT NULL)), ';')"


def _codes(text: str) -> str:
    """``code: test`` lines as a sorted, joined list."""
    lines = [line.strip().split(": ", 1) for line in text.strip().splitlines()]
    return _LIST.format(", ".join(f"CASE WHEN {test} THEN '{code}' END" for code, test in lines))


def _tokens(x: str, cut: str, stop: str, least: int = 2) -> str:
    return f"list_distinct(list_filter(string_split(trim(regexp_replace({x}, '{cut}', ' ', 'g')), ' '), lambda t: len(t) >= {least} AND NOT list_contains([{stop}], t)))"


_STOP_1 = _listed(text.STOP_WORDS)
_STOP_2 = _listed(text.STOP_WORDS_CLAUSE)
_STOP_5 = _listed(text.STOP_WORDS_GROUNDING)
_PLAIN, _SIGNS = "[^a-z0-9]+", "[^a-z0-9%<>=./+-]+"


def _share(a: str, b: str, cut: str, stop: str) -> str:
    x, y = _tokens(a, cut, stop), _tokens(b, cut, stop)
    return f"(CASE WHEN len({x}) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y})) / len({x})::DOUBLE END)"


_CODES_1A = r"""
criterion_id_missing: criterion_id IS NULL OR criterion_id = ''
criterion_id_malformed: criterion_id <> '' AND NOT regexp_matches(criterion_id, '^.+_C\d+$')
entity_type_invalid_enum: entity_type IS NULL OR NOT list_contains([<ENTITY_TYPES>], entity_type)
history_context_invalid_enum: NOT list_contains([<HISTORY>], history_context)
entity_text_empty: n_ent = ''
evidence_text_empty: n_ev = ''
operator_missing: operator IS NULL
operator_invalid_enum: NOT list_contains([<OPERATORS>], operator)
comparison_without_scalar_value: cmp AND NOT (value_kind <> 'null' AND value_type = 'scalar')
comparison_value_is_numeric_string: cmp AND value_type = 'scalar' AND value_kind = 'string' AND regexp_full_match(trim(value_text), '[-+]?\d+(\.\d+)?')
equality_without_value: operator IN ('=', '!=') AND (value_kind = 'null' OR value_type = 'null')
pattern_operator_without_scalar_value: operator IN ('contains', 'matches') AND NOT (value_kind <> 'null' AND value_type = 'scalar')
between_without_range_value: operator = 'between' AND NOT (value_type = 'range' AND value_kind = 'range')
range_with_both_bounds_missing: operator = 'between' AND value_type = 'range' AND value_kind = 'range' AND value_min IS NULL AND value_max IS NULL
range_with_missing_bound: operator = 'between' AND value_type = 'range' AND value_kind = 'range' AND ((value_min IS NULL AND value_max IS NOT NULL) OR (value_min IS NOT NULL AND value_max IS NULL))
range_min_greater_than_max: operator = 'between' AND value_type = 'range' AND value_kind = 'range' AND value_min > value_max
list_operator_without_list_value: operator IN ('in', 'not_in') AND NOT (value_type = 'list' AND value_kind = 'list' AND coalesce(value_text, '') <> '')
existence_operator_with_non_null_value: ex AND (value_type <> 'null' OR value_kind <> 'null')
null_value_type_with_non_null_value: value_type = 'null' AND value_kind <> 'null'
scalar_value_type_with_complex_value: value_type = 'scalar' AND value_kind IN ('list', 'range')
list_value_type_without_list_value: value_type = 'list' AND value_kind <> 'list'
range_value_type_without_dict_value: value_type = 'range' AND value_kind <> 'range'
value_type_invalid_enum: NOT list_contains([<VALUE_TYPES>], value_type)
temporal_context_missing_relation: tc AND t_relation IS NULL
temporal_context_invalid_relation: NOT list_contains([<RELATIONS>], t_relation)
temporal_context_missing_anchor_event: tc AND t_anchor IS NULL
temporal_context_invalid_anchor_event: NOT list_contains([<ANCHORS>], t_anchor)
temporal_context_invalid_unit: NOT list_contains([<UNITS>], t_unit)
temporal_context_missing_value: t_value IS NULL AND (t_unit IS NOT NULL OR t_relation = 'within')
temporal_context_missing_unit: regexp_full_match(trim(t_value), '\d+(\.\d+)?') AND t_unit IS NULL
computable_with_non_computable_reason: computability = 'computable' AND trim(coalesce(non_computable_reason, '')) <> ''
non_computable_without_reason: computability = 'non_computable' AND trim(coalesce(non_computable_reason, '')) = ''
computable_with_exception_context: computability = 'computable' AND ctx
computability_invalid_enum: NOT list_contains([<COMPUTABILITY>], computability)
unit_present_without_value: unit <> '' AND value_type = 'null' AND NOT ex
normalized_concept_invalid_system: NOT list_contains([<CONCEPT_SYSTEMS>], concept_system)
normalized_concept_system_without_code: concept_system IS NOT NULL AND concept_code IS NULL
"""
_CODES_1A = re.sub("<([A-Z_]+)>", lambda m: _listed(getattr(layer1, m[1])), _CODES_1A)
_SURFACE = r"(\b(count|number|volume|diameter|percentage|percent|grade|class|score|regimen|regimens|lesion|lesions|stenosis|age|size|cm|mm|ml|fetuses)\b|x uln|upper limit|\b\d+(\.\d+)?\s*(cm|mm|ml|mg|kg|%)\b)"
_NORMALITY = r"(\b(normal|abnormal|elevated|positive|negative|level|levels|mg/dl|ng/ml|mmol/l|grade|%)\b|returned to normal|x uln|upper limit|(<=|>=|<|>|=)\s*\d|\b\d+(\.\d+)?\s*(mg/dl|ng/ml|mmol/l|x\s*uln|%)\b)"
_CODES_1C = rf"""
entity_text_too_generic: n_ent IN ({_listed(layer1.GENERIC)}) OR len({_tokens('n_ent', _PLAIN, _STOP_1)}) = 0
comparison_with_non_quantitative_entity: cmp AND entity_type NOT IN ({_listed(layer1.QUANTITATIVE_TYPES)}) AND NOT regexp_matches(n_ent, '{_SURFACE}') AND NOT regexp_matches(n_ev, '{_SURFACE}')
comparison_entity_mismatch_from_source: cmp AND head <> '' AND {_share('lower(head)', 'n_ent', _PLAIN, _STOP_1)} < 0.5
categorical_value_missing: ex AND value_type = 'null' AND mark IS NOT NULL AND NOT regexp_matches(n_ent, '\b' || mark || '\b') AND NOT regexp_matches(n_val, '\b' || mark || '\b')
temporal_marker_without_temporal_context: NOT tc AND regexp_matches(n_ev, '(at screening|during screening|prior to|\bbefore\b|\bafter\b|\bwithin\b|\bsince\b|\bbaseline\b|\brandomization\b|study start|study entry|\bpre-procedure\b|\bpost-procedure\b)')
duration_marker_missing_from_temporal_context: (t_value IS NULL OR t_unit IS NULL) AND NOT (value_kind <> 'null' AND regexp_replace(lower(trim(coalesce(unit, ''))), 's+$', '') IN ('hour','day','week','month','year')) AND regexp_matches(n_ev, '\b(\d+(\.\d+)?|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\s*(hour|hours|day|days|week|weeks|month|months|year|years)\b') AND regexp_matches(n_ev, '(\b(within|before|after|since|following|pre-procedure|post-procedure|randomization|screening)\b|prior to|study entry|study start)')
temporal_anchor_mismatch_from_source: tc AND t_anchor <> said_anchor
critical_qualifier_missing_from_entity: len(list_filter([{_listed(layer1.QUALIFIERS)}], lambda q: regexp_matches(n_ev, '\b' || q || '\b') AND NOT regexp_matches(n_ent, '\b' || q || '\b'))) > 0
requirement_object_inversion: needed <> '' AND contains(n_ent, needed) AND NOT contains(n_ent, needing)
condition_context_present_without_handling: NOT ctx AND regexp_matches(n_ev, '(\b(if|unless|except)\b|if applicable|provided that|in case|only if)')
existence_operator_on_quantitative_phrase: ex AND value_type = 'null' AND entity_type IN ('lab','vital','observation') AND regexp_matches(n_ev, '{_NORMALITY}')
"""
_NEGATIVE = r"unable to|inability to|unability to|lack of|failure to|failed to|not amenable to|non[- ](diabetic|pregnant|smoker|lactating)|asymptomatic|symptom[- ]free"
_CODES_1D = r"""
evidence_text_not_substring_of_pass1_source_text: NOT found
negation_clause_with_exists_operator: neg_clause AND operator = 'exists' AND NOT neg_entity
positive_clause_with_not_exists_operator: operator = 'not_exists' AND NOT neg_clause
negative_entity_with_not_exists_operator: operator = 'not_exists' AND neg_clause AND neg_entity
exception_or_condition_clause_without_context_handling: cond_clause AND NOT ctx
exception_or_condition_clause_with_computable_status: cond_clause AND NOT ctx AND computability = 'computable'
exception_clause_computable_despite_context: cond_clause AND ctx AND computability = 'computable'
"""


def _in(column: str, names: str) -> str:
    return f"len(list_intersect(string_split({column}, ';'), [{names}]))"


_EXECUTION = _listed(layer1.EXECUTION)
_SOFT = _listed(layer1.SOFT_WARNINGS)
_N_1A = "(CASE WHEN codes_1a = '' THEN 0 ELSE len(string_split(codes_1a, ';')) END)"
_N_1C = "(CASE WHEN codes_1c = '' THEN 0 ELSE len(string_split(codes_1c, ';')) END)"
_N_1D = "(CASE WHEN codes_1d = '' THEN 0 ELSE len(string_split(codes_1d, ';')) END)"
_EXISTS_1B = "(CASE WHEN criterion_id IS NOT NULL AND count(*) OVER (PARTITION BY document_id, criterion_id) > 1 THEN 1 ELSE 0 END)"
_TEMPORAL_A = r"\b(within|before|after|since|during|prior to|previously|recent|recently|screening|baseline|randomization|diagnosis|surgery|treatment start|first dose)\b|\b(last|past)\s+\d+\s+(days?|weeks?|months?|years?)\b"
_HISTORY_A = r"\b(history of|prior|previous|previously|current|currently|stable dose|investigational|recurrent|recurrence|previously treated|prior treatment)\b"
_CONDITION_A = r"\b(if|when|unless|except|with the exception of|provided that|in case of)\b"
_CUE_A = r"[<>=≥≤]|\d|\b(greater than|less than|more than|at least|at most|no more than|no less than|equal to|or more|or less|minimum|maximum|between|uln|x\s*10|mm3|mm\^3|mg/dl|mg|ml|score|grade)\b"
_TEMPORAL_B = r"\b(within|during|before|after|prior to|since|until|baseline|screening|enrollment|randomization|study entry|study start|treatment start)\b|\bfollowing\s+(surgery|treatment|therapy|randomization|enrollment|procedure|transplantation)\b|\blast\s+\d+\s+(days?|weeks?|months?|years?)\b"
_HISTORY_B = r"\b(history of|prior|previous|previously|past|recurrent|active|current|currently|ongoing|known|documented|diagnosed|treated|received|receiving)\b"
_CONDITION_B = r"\b(if|unless|except|other than|provided that|in case of|only if|as long as)\b"
_CUE_B = r"[<>≤≥]|\b(at least|at most|less than|more than|greater than|no more than|no less than|minimum|maximum|above|below|under|over|between)\b|\b\d+(\.\d+)?\s*-\s*\d+(\.\d+)?\b|\bgrade\s+\d+"
_GENERIC_B = _listed(layer2.GENERIC_B)
_MODIFIERS = _listed(layer2.MODIFIERS)
_SPECIFIC = _listed(layer2.HARD_MODIFIERS)


def _numeric(x: str) -> str:
    """Commas between digits and articles gone, signs in ASCII, number words as digits, other signs as spaces."""
    t = rf"regexp_replace(regexp_replace(lower(trim(coalesce({x}, ''))), '(\d),(\d)', '\1\2', 'g'), '(\d),(\d)', '\1\2', 'g')"
    t = rf"regexp_replace(replace(replace(replace({t}, '×', 'x'), '≤', '<='), '≥', '>='), '\bthe\b', ' ', 'g')"
    for k, w in enumerate(text.DIGIT_WORDS):
        t = rf"regexp_replace({t}, '\b{w}\b', '{k}', 'g')"
    return rf"trim(regexp_replace(regexp_replace({t}, '(\d)\s*x\s*(uln|lln)', '\1x \2', 'g'), '{_SIGNS}', ' ', 'g'))"


def _clinical(x: str) -> str:
    t = rf"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '(\d),(\d)', '\1\2', 'g'), '(\d),(\d)', '\1\2', 'g')"
    return f"trim(regexp_replace(replace(replace(replace(replace(replace({t}, '×', 'x'), '≤', '<='), '≥', '>='), '–', '-'), '—', '-'), '{_SIGNS}', ' ', 'g'))"


_REASONS_A = """
no_bert_anchor: NOT has_anchor
entity_type_not_supported_by_best_anchor: has_anchor AND NOT anchor_type_match
entity_text_not_aligned_with_any_anchor: has_anchor AND NOT anchor_overlap
entity_not_in_leaf_evidence_but_in_item: NOT in_ev AND in_item AND (has_anchor OR NOT gen_a)
entity_not_grounded_in_evidence_or_item: NOT in_ev AND NOT (in_item AND (has_anchor OR NOT gen_a))
generic_entity_text: gen_a
operator_value_supported_but_value_not_found_in_evidence: cat IN ('comparison', 'range', 'list') AND sup AND NOT val_ev
operator_value_not_structurally_supported: cat IN ('comparison', 'range', 'list') AND NOT sup
unknown_or_other_operator_category: cat = 'other'
temporal_marker_without_temporal_context: t_a AND NOT tc
history_marker_without_history_context: h_a AND coalesce(history_context, '') = ''
computable_with_unhandled_condition_or_exception: c_a AND NOT ctx AND computability = 'computable'
condition_or_exception_marker_without_context: c_a AND NOT ctx AND computability <> 'computable'
computability_partial: computability = 'partial'
computability_non_computable: computability = 'non_computable'
non_computable_without_reason: computability = 'non_computable' AND trim(coalesce(non_computable_reason, '')) = ''
unknown_computability: computability NOT IN ('computable', 'partial', 'non_computable')
quantitative_cue_not_represented: q_a AND (ex OR value_kind = 'null')
layer1_policy_mandatory_rescue_or_review: n_hard_a > 0
layer1_policy_computability_review: n_hard_a = 0 AND n_exec > 0
layer1_policy_safe_normalization_candidate: n_hard_a = 0 AND n_exec = 0 AND n_safe > 0
layer1d_pass1_pass2_logic_flag: codes_1d <> ''
layer1_inventory_flag: codes_1a <> '' OR codes_1c <> ''
"""
_REASONS_B = """
generic_entity_text: e_b = 0.45
entity_not_in_evidence_but_in_item: e_b = 0.85
entity_supported_by_source_token_overlap: e_b = 0.8
entity_partially_supported_by_source_token_overlap: e_b = 0.65
entity_weakly_supported_by_source_token_overlap: e_b = 0.55
entity_not_grounded_in_evidence_or_item: e_b = 0.35
value_not_grounded_in_evidence_or_item: v_b < 1
count_unit_inferred_but_value_not_clearly_grounded: u_b = 0.75
unit_supported_by_source_token_overlap: u_b = 0.85
unit_not_grounded_in_evidence_or_item: u_b = 0.65
operator_value_not_structurally_supported: o_b < 1
quantitative_cue_not_represented: q_b = 0.35
value_missing_despite_quantitative_cue: q_b = 0.4
exists_operator_with_quantitative_cue: q_b = 0.45
temporal_marker_without_temporal_context: mt_b AND NOT tc
temporal_context_without_clear_marker: tc AND NOT mt_b
history_marker_without_history_context: mh_b AND NOT hc
condition_or_exception_marker_without_context: mc_b AND NOT ctx
critical_modifier_missing: len(lost) > 0
allowance_or_polarity_clause: allow
layer1_policy:hard_semantic_or_structural_issue: n_hard_b > 0
layer1_policy:soft_semantic_warning: n_hard_b = 0 AND n_exec = 0 AND n_soft > 0
"""


def _split(text: str) -> str:
    """Code lists where a code may hold a colon: the last one cuts."""
    lines = [line.strip().rsplit(": ", 1) for line in text.strip().splitlines()]
    return _LIST.format(", ".join(f"CASE WHEN {test} THEN '{code}' END" for code, test in lines))


_BANDS = "CASE WHEN {0} < 0.6 THEN '{1}review_priority' WHEN {0} < 0.85 THEN '{1}intermediate_support' ELSE '{1}high_support_not_auto_accept' END"
_TASKS = (
    ("entity_regrounding", "entity_not_grounded|entity_not_in|entity_text_empty|generic_entity_text|entity_supported_by_source_token_overlap|entity_partially_supported"),
    ("value_or_operator_recovery", "comparison_without_scalar_value|equality_without_value|pattern_operator_without_scalar_value|between_without_range_value|range_with_both_bounds_missing|range_with_missing_bound|list_operator_without_list_value|operator_value_not_structurally_supported|value_not_grounded|value_missing_with_quantitative_cue|quantitative_cue_not_represented|quantitative_cue_unhandled"),
    ("temporal_context_recovery", "temporal_marker_without_temporal_context|temporal_context_missing|temporal_anchor_mismatch|duration_marker_missing"),
    ("history_context_recovery", "history_marker_without_history_context|history_context_invalid"),
    ("condition_exception_context_recovery", "condition_context_present|condition_or_exception|exception_context|exception_clause|condition_exception"),
    ("polarity_negation_repair", "negation_clause_with_exists_operator|positive_clause_with_not_exists_operator|allowance_or_polarity|not_exists|negation"),
    ("entity_type_reclassification", "entity_type"),
)


def _task(joined: str, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({joined}, '{p}') THEN '{t}'" for t, p in _TASKS) + f" ELSE '{default}' END"


_HINTS = (
    ("no_action", "codes_1a = ''"),
    ("safe_normalization_candidate", _in("codes_1a", "'computable_with_exception_context','computable_with_non_computable_reason','non_computable_without_reason'") + " > 0"),
    ("flag_only", _in("codes_1a", "'range_with_missing_bound','equality_without_value','pattern_operator_without_scalar_value','temporal_context_invalid_anchor_event','temporal_context_invalid_relation','temporal_context_invalid_unit','operator_missing','entity_type_invalid_enum','history_context_invalid_enum','criterion_id_missing','criterion_id_malformed','null_value_type_with_non_null_value','operator_invalid_enum','value_type_invalid_enum','computability_invalid_enum','normalized_concept_invalid_system','normalized_concept_system_without_code','range_min_greater_than_max'") + " > 0"),
    ("safe_normalization_candidate", _in("codes_1a", "'comparison_value_is_numeric_string'") + " > 0"),
    ("flag_only", _in("codes_1a", "'existence_operator_with_non_null_value'") + " > 0"),
    ("safe_normalization_candidate", _in("codes_1a", "'temporal_context_missing_value','temporal_context_missing_unit'") + " > 0 AND value_kind <> 'null' AND unit <> ''"),
    ("flag_only", _in("codes_1a", "'temporal_context_missing_value','temporal_context_missing_unit'") + " > 0"),
    ("conservative_rewrite_candidate", _in("codes_1a", "'list_operator_without_list_value','comparison_without_scalar_value','range_with_both_bounds_missing'") + " > 0"),
)
_FORCED = "coalesce(rescue_decision, '') NOT IN ('', 'no_change') AND coalesce(skip_reason, '') NOT LIKE 'not!_applicable!_final!_decision:no!_change%' ESCAPE '!' AND (rescue_decision IN ('human_review', 'no_repair_possible') OR coalesce(local_validation, '') = 'fail' OR (coalesce(apply_status, '') = 'skipped' AND coalesce(skip_reason, '') <> ''))"
_DECISION = {
    "safe_structural_repair_candidate": ("structural_repair", 20, 1), "conservative_downgrade_candidate": ("conservative_downgrade", 30, 1), "targeted_llm_rescue_candidate": ("llm_rescue_or_review", 40, 1),
    "computability_review_or_partial": ("computability_review", 50, 0), "optional_targeted_rescue_or_review": ("optional_review", 60, 0), "keep_without_layer2_action_candidate": ("keep_no_action_reference", 80, 0),
    "branch_a_diagnostic_only_not_auto_accept": ("diagnostic_only", 90, 0), "human_review_or_abstain": ("human_review_or_abstain", 100, 0),
}


def _of(decision: str, k: int) -> str:
    quote = (lambda v: f"'{v}'") if k == 0 else str
    return f"CASE {decision} " + " ".join(f"WHEN '{n}' THEN {quote(v[k])}" for n, v in _DECISION.items()) + " END"


def rules() -> str:
    """Common table expressions up to ``final``, one row for each leaf, each computed once."""
    text = rf"""
WITH leaf AS ({leaves_sql()}),
context AS (SELECT *,
  CASE WHEN k % 54 = 9 THEN 'an unrelated item' ELSE evidence_text || ' in this study' END AS item_text,
  CASE k % 29 WHEN 3 THEN 'negation' WHEN 5 THEN 'exception' ELSE 'simple' END AS clause_type,
  CASE WHEN k % 27 = 9 THEN 'another sentence' ELSE evidence_text END AS clause_text,
  k % 11 = 3 AS clause_negated, k % 61 <> 7 AS has_clause,
  CASE k % 12 WHEN 0 THEN 'human_review' WHEN 1 THEN 'no_change' WHEN 2 THEN 'select_candidate' END AS rescue_decision,
  CASE WHEN k % 12 = 2 THEN CASE WHEN k % 24 = 2 THEN 'applied' ELSE 'skipped' END END AS apply_status,
  CASE WHEN k % 12 = 2 AND k % 24 <> 2 AND k % 5 = 1 THEN 'not_applicable_final_decision:no_change' WHEN k % 12 = 2 AND k % 24 <> 2 AND k % 5 <> 0 THEN 'no_selected_leaf' END AS skip_reason,
  CASE WHEN k % 72 = 2 THEN 'fail' WHEN k % 12 = 2 THEN 'pass' END AS local_validation,
  k % 24 = 2 AS from_b, {_EXISTS_1B} AS twice,
  count(*) OVER (PARTITION BY document_id, item_uid, entity_type, lower(entity_text), operator, value_type, value_text, unit, t_relation) > 1 AS same_again
  FROM leaf),
normal AS (SELECT *, {_N.format('evidence_text')} AS n_ev, {_N.format('entity_text')} AS n_ent, {_N.format('value_text')} AS n_val, {_N.format('clause_text')} AS n_clause, {_N.format('item_text')} AS n_item,
  coalesce(operator IN ('<', '<=', '>', '>='), false) AS cmp, coalesce(operator IN ('exists', 'not_exists'), false) AS ex,
  coalesce(t_relation, t_value, t_unit, t_anchor) IS NOT NULL AS tc, (coalesce(cond_text, '') <> '' OR coalesce(exc_text, '') <> '') AS ctx, coalesce(history_context, '') <> '' AS hc,
  regexp_replace(regexp_extract(trim(regexp_replace(evidence_text, '[ \t\n\r\f]+', ' ', 'g')), '([A-Za-z][A-Za-z0-9 /\-]{{1,80}}?)\s*(<=|>=|<|>|=|!=)\s*[-+]?\d', 1), '^(and|or|with|patients with|subjects with|And|Or|With)\s+', '') AS head
  FROM context),
seen AS (SELECT *,
  list_filter(['negative','positive','normal','abnormal'], lambda m: regexp_matches(n_ev, '\b' || m || '\b'))[1] AS mark,
  list_filter([['randomization','randomization'],['screening','screening'],['baseline','baseline'],['study start','screening'],['study entry','screening'],['treatment start','treatment_start'],['prior to treatment','treatment_start'],['before treatment','treatment_start'],['diagnosis','diagnosis'],['surgery','surgery'],['procedure','procedure'],['pre-procedure','procedure'],['post-procedure','procedure']], lambda p: CASE WHEN contains(p[1], ' ') THEN contains(n_ev, p[1]) ELSE regexp_matches(n_ev, '\b' || p[1] || '\b') END)[1][2] AS said_anchor,
  trim(regexp_extract(n_ev, '\b([a-z][a-z\s\-]+?)\s+requiring\s+([a-z][a-z\s\-]+)\b', 1)) AS needing, trim(regexp_extract(n_ev, '\b([a-z][a-z\s\-]+?)\s+requiring\s+([a-z][a-z\s\-]+)\b', 2)) AS needed,
  (n_ev <> '' AND (contains(n_clause, n_ev) OR contains(n_item, n_ev))) OR {_share('n_ev', 'n_clause', _PLAIN, _STOP_2)} >= 0.7 OR {_share('n_ev', 'n_item', _PLAIN, _STOP_2)} >= 0.7 AS found,
  clause_negated OR clause_type = 'negation' OR regexp_matches(n_clause, '\b(no|not|without|absence of|free of|negative for|{_NEGATIVE})\b') AS neg_clause,
  regexp_matches(n_ent, '\b(not|without|unwilling|unwillingness|can not|cannot|{_NEGATIVE})\b') AS neg_entity,
  clause_type IN ('exception', 'condition') OR regexp_matches(n_clause, '\b(if|unless|except|provided that|only if)\b') AS cond_clause
  FROM normal),
coded AS (SELECT *, {_codes(_CODES_1A)} AS codes_1a, {_codes(_CODES_1C)} AS codes_1c, CASE WHEN has_clause THEN {_codes(_CODES_1D)} ELSE 'pass2_leaf_without_pass1_clause' END AS codes_1d,
  {_codes("duplicate_criterion_id: twice = 1" + chr(10) + "duplicate_identical_leaf: same_again")} AS codes_1b FROM seen),
counted AS (SELECT *,
  {_in('codes_1a', _EXECUTION)} AS n_exec, {_in('codes_1a', "'comparison_value_is_numeric_string'")} AS n_safe, {_in('codes_1c', _SOFT)} AS n_soft,
  CASE {' '.join(f"WHEN {t} THEN '{h}'" for h, t in _HINTS)} ELSE 'flag_only' END AS hint_1a FROM coded),
weighed AS (SELECT *, {_N_1A} - n_exec - n_safe + twice + {_N_1C} + {_N_1D} AS n_hard_a, {_N_1A} - n_exec - n_safe + twice + {_N_1C} - n_soft + {_N_1D} AS n_hard_b FROM counted),
policy AS (SELECT *,
  CASE WHEN n_hard_a > 0 THEN 'mandatory_rescue_or_review_candidate' WHEN n_exec > 0 THEN 'computability_review_candidate' WHEN n_safe > 0 THEN 'safe_normalization_candidate' ELSE 'continue_to_layer2' END AS action_a,
  CASE WHEN n_hard_b > 0 THEN 'mandatory_verifier_candidate' WHEN n_exec > 0 THEN 'computability_review_candidate' WHEN n_soft > 0 THEN 'continue_to_layer2_grounding_screen' WHEN n_safe > 0 THEN 'safe_normalization_candidate' ELSE 'continue_to_layer2' END AS action_b FROM weighed),
signals AS (SELECT *,
  CASE WHEN operator IN ('<','<=','>','>=','=','!=') THEN 'comparison' WHEN operator = 'between' THEN 'range' WHEN operator IN ('in','not_in') THEN 'list' WHEN ex THEN 'existence' ELSE 'other' END AS cat,
  n_ent <> '' AND contains(n_ev, n_ent) AS in_ev, n_ent <> '' AND contains(n_item, n_ent) AS in_item,
  n_ent IN ('of','and','or','with','patients','patient','subjects','subject','condition','disease','therapy','treatment','other') AS gen_a,
  CASE WHEN operator IN ('<','<=','>','>=','=','!=') THEN value_type = 'scalar' AND value_kind <> 'null' WHEN operator = 'between' THEN value_type = 'range' AND coalesce(value_min, value_max) IS NOT NULL WHEN operator IN ('in','not_in') THEN value_type = 'list' AND value_kind = 'list' AND coalesce(value_text, '') <> '' ELSE ex END AS sup,
  coalesce(value_text, '') <> '' AND contains(n_ev, lower(coalesce(value_text, ''))) AS val_ev,
  regexp_matches(n_ev, '{_TEMPORAL_A}') OR regexp_matches(n_clause, '{_TEMPORAL_A}') AS t_a, regexp_matches(n_ev, '{_HISTORY_A}') OR regexp_matches(n_clause, '{_HISTORY_A}') AS h_a,
  regexp_matches(n_ev, '{_CONDITION_A}') OR regexp_matches(n_clause, '{_CONDITION_A}') AS c_a, regexp_matches(n_ev, '{_CUE_A}') OR regexp_matches(n_clause, '{_CUE_A}') AS q_a
  FROM policy),
scored AS (SELECT *,
  CASE WHEN has_anchor THEN least(greatest(0.0, least(1.0, coalesce(anchor_score, 0.75))), CASE WHEN anchor_type_match AND anchor_overlap THEN 1.0 ELSE 0.5 END, CASE WHEN in_ev THEN 1.0 WHEN in_item THEN 0.65 ELSE 0.45 END, CASE WHEN gen_a THEN 0.4 ELSE 1.0 END)
       WHEN in_ev AND gen_a THEN 0.4 WHEN in_ev THEN 0.6 WHEN in_item AND NOT gen_a THEN 0.5 ELSE 0.25 END::DOUBLE AS s_entity,
  CASE cat WHEN 'existence' THEN 1.0 WHEN 'other' THEN 0.5 ELSE CASE WHEN NOT sup THEN 0.3 WHEN val_ev THEN 0.9 ELSE 0.7 END END::DOUBLE AS s_operator,
  CASE WHEN q_a AND (ex OR value_kind = 'null') THEN 0.35 ELSE 1.0 END::DOUBLE AS s_quant,
  CASE WHEN NOT t_a THEN 1.0 WHEN tc THEN 0.9 ELSE 0.4 END::DOUBLE AS s_time, CASE WHEN NOT h_a THEN 1.0 WHEN hc THEN 0.9 ELSE 0.5 END::DOUBLE AS s_history,
  CASE WHEN NOT c_a THEN 1.0 WHEN ctx THEN 0.85 WHEN computability = 'computable' THEN 0.3 ELSE 0.4 END::DOUBLE AS s_context,
  CASE computability WHEN 'computable' THEN 1.0 WHEN 'partial' THEN 0.7 WHEN 'non_computable' THEN CASE WHEN trim(coalesce(non_computable_reason, '')) = '' THEN 0.6 ELSE 0.8 END ELSE 0.5 END::DOUBLE AS s_comp,
  least(CASE WHEN n_hard_a > 0 THEN 0.45 WHEN n_exec > 0 THEN 0.7 WHEN n_safe > 0 THEN 0.9 ELSE 1.0 END, CASE WHEN codes_1d <> '' THEN 0.55 ELSE 1.0 END, CASE WHEN codes_1a <> '' OR codes_1c <> '' THEN 0.65 ELSE 1.0 END)::DOUBLE AS s_layer1,
  replace({_codes(_REASONS_A)}, 'unknown_or_other_operator_category', 'unknown_or_other_operator_category:' || coalesce(nullif(operator, ''), cat)) AS risk_reasons FROM signals),
branch_a AS (SELECT *, least(s_entity, s_operator, s_quant, s_time, s_history, s_context, s_comp, s_layer1) AS least_a FROM scored),
labelled AS (SELECT *, {_BANDS.format('least_a', '')} AS risk_label FROM branch_a),
ground AS (SELECT *, {_numeric('evidence_text')} || ' ' || {_numeric('item_text')} AS src, {_clinical('evidence_text')} AS g_ev, {_clinical('entity_text')} AS g_ent, {_clinical('unit')} AS g_unit,
  {_numeric("CASE WHEN value_kind IN ('string', 'number', 'list') THEN value_text END")} AS atom, value_kind = 'null' OR (value_kind IN ('string', 'number', 'list') AND coalesce(value_text, '') = '') AS none_b,
  list_transform(list_filter([value_min, value_max], lambda x: x IS NOT NULL AND value_kind = 'range'), lambda x: x::BIGINT::VARCHAR) AS bounds,
  operator IN ('<','<=','>','>=','=','!=','between') AS quant, regexp_matches(n_ev, '{_CUE_B}') AS cue, regexp_matches(n_ev, '{_TEMPORAL_B}') AS mt_b, regexp_matches(n_ev, '{_HISTORY_B}') AS mh_b, regexp_matches(n_ev, '{_CONDITION_B}') AS mc_b,
  list_filter([{_MODIFIERS}], lambda m: contains(n_ev, m) AND NOT contains(n_ent, m)) AS lost,
  len(list_filter(['not excluded','will not be excluded','not exclusionary','is allowed','are allowed','permitted','eligible despite'], lambda m: contains(n_ev, m))) > 0 AS allow,
  greatest({_share('n_ent', 'n_ev', _SIGNS, _STOP_5)}, {_share('n_ent', 'n_item', _SIGNS, _STOP_5)}) AS e_share FROM labelled),
screened AS (SELECT *,
  CASE WHEN list_contains([{_GENERIC_B}], g_ent) THEN 0.45 WHEN contains(trim(regexp_replace(evidence_text, '[ \t\n\r\f]+', ' ', 'g')), trim(regexp_replace(entity_text, '[ \t\n\r\f]+', ' ', 'g'))) THEN 1.0 WHEN contains(n_ev, n_ent) OR contains(g_ev, g_ent) THEN 0.95 WHEN contains(n_item, n_ent) THEN 0.85 WHEN e_share >= 0.75 THEN 0.8 WHEN e_share >= 0.5 THEN 0.65 WHEN e_share >= 0.25 THEN 0.55 ELSE 0.35 END::DOUBLE AS e_b,
  CASE WHEN none_b OR value_type = 'null' OR (atom = '' OR contains(src, atom)) AND len(list_filter(bounds, lambda b: NOT contains(src, b))) = 0 THEN 1.0 ELSE 0.45 END::DOUBLE AS v_b,
  CASE WHEN g_unit IN ('', 'null', 'none', 'nan') THEN 1.0 WHEN g_unit IN ('count', 'number') THEN CASE WHEN atom <> '' AND contains(src, atom) THEN 1.0 WHEN regexp_matches(n_ev, '\b(one|two|three|four|five|at least|at most|number of)\b') THEN 0.95 ELSE 0.75 END
       WHEN contains(g_ev, g_unit) THEN 1.0 WHEN greatest({_share(_N.format('unit'), 'n_ev', _SIGNS, _STOP_5)}, {_share(_N.format('unit'), 'n_item', _SIGNS, _STOP_5)}) >= 0.75 THEN 0.85 ELSE 0.65 END::DOUBLE AS u_b,
  CASE WHEN operator IS NULL OR (none_b AND (quant OR operator IN ('in', 'contains'))) THEN 0.4 ELSE 1.0 END::DOUBLE AS o_b,
  CASE WHEN NOT cue THEN 1.0 WHEN none_b AND NOT quant THEN 0.35 WHEN none_b THEN 0.4 WHEN operator = 'exists' THEN 0.45 ELSE 1.0 END::DOUBLE AS q_b,
  CASE WHEN mt_b AND tc THEN 0.95 WHEN mt_b THEN 0.4 WHEN tc THEN 0.85 ELSE 1.0 END::DOUBLE AS ts_b, CASE WHEN mh_b AND hc THEN 0.95 WHEN mh_b THEN 0.5 WHEN hc THEN 0.9 ELSE 1.0 END::DOUBLE AS hs_b, CASE WHEN mc_b AND ctx THEN 0.95 WHEN mc_b THEN 0.4 WHEN ctx THEN 0.9 ELSE 1.0 END::DOUBLE AS cs_b,
  CASE WHEN len(lost) > 0 THEN 0.45 ELSE 1.0 END::DOUBLE AS m_b, CASE WHEN allow THEN 0.35 ELSE 1.0 END::DOUBLE AS al_b,
  CASE WHEN n_hard_b > 0 THEN 0.5 WHEN n_exec = 0 AND n_soft > 0 THEN 0.8 ELSE 1.0 END::DOUBLE AS l1_b,
  CASE computability WHEN 'computable' THEN 1.0 WHEN 'partial' THEN 0.6 WHEN 'non_computable' THEN 0.35 ELSE 0.5 END::DOUBLE AS comp_b,
  CASE action_b WHEN 'continue_to_layer2' THEN 1.0 WHEN 'computability_review_candidate' THEN 0.7 ELSE 0.9 END::DOUBLE AS exe_b FROM ground),
joined_b AS (SELECT *, least(e_b, v_b, u_b, o_b, q_b, ts_b, hs_b, cs_b, m_b, al_b, l1_b) AS sem, least(comp_b, exe_b) AS exe, {_split(_REASONS_B)} AS semantic_reasons,
  {_split("computability_partial: comp_b = 0.6" + chr(10) + "computability_non_computable: comp_b = 0.35" + chr(10) + "computability_missing_or_unknown: comp_b = 0.5" + chr(10) + "layer1_execution:layer1_policy_execution_issue: exe_b = 0.7")} AS execution_reasons,
  allow OR e_b IN (0.35, 0.45) OR v_b < 1 OR q_b < 1 OR cs_b = 0.4 OR ts_b = 0.4 OR hs_b = 0.5 OR coalesce(list_contains([{_SPECIFIC}], list_sort(lost)[1]), false) AS hard FROM screened),
routed AS (SELECT *, {_BANDS.format('sem', 'reference_')} AS semantic_label, {_BANDS.format('exe', 'reference_')} AS execution_label,
  CASE WHEN n_hard_b > 0 OR hard THEN 'llm_verifier' WHEN action_b = 'continue_to_layer2_grounding_screen' OR sem < 0.85 THEN 'optional_llm_verifier_or_review' WHEN action_b = 'computability_review_candidate' OR exe < 0.85 THEN 'computability_review' ELSE 'keep_without_layer2_action' END AS routing FROM joined_b),
reasoned AS (SELECT *, CASE WHEN n_hard_b > 0 THEN 'layer1_policy_mandatory_verifier' WHEN hard THEN 'hard_semantic_grounding_uncertainty' WHEN action_b = 'continue_to_layer2_grounding_screen' THEN 'layer1_policy_soft_warning' WHEN sem < 0.85 THEN 'semantic_grounding_' || semantic_label WHEN action_b = 'computability_review_candidate' THEN 'layer1_policy_computability_review' WHEN exe < 0.85 THEN 'execution_support_' || execution_label ELSE 'high_semantic_and_execution_support_reference' END AS routing_reason FROM routed),
decided AS (SELECT *,
  CASE WHEN hint_1a = 'safe_normalization_candidate' OR action_a = 'safe_normalization_candidate' THEN 'safe_structural_repair_candidate' WHEN hint_1a = 'conservative_rewrite_candidate' THEN 'conservative_downgrade_candidate' WHEN action_a = 'mandatory_rescue_or_review_candidate' OR risk_label = 'review_priority' THEN 'targeted_llm_rescue_candidate' WHEN action_a = 'computability_review_candidate' THEN 'computability_review_or_partial' WHEN risk_label = 'intermediate_support' THEN 'optional_targeted_rescue_or_review' ELSE 'branch_a_diagnostic_only_not_auto_accept' END AS decision_a,
  CASE WHEN hint_1a = 'safe_normalization_candidate' OR action_b = 'safe_normalization_candidate' THEN 'safe_structural_repair_candidate' WHEN hint_1a = 'conservative_rewrite_candidate' THEN 'conservative_downgrade_candidate' WHEN routing = 'llm_verifier' THEN 'targeted_llm_rescue_candidate' WHEN action_b = 'computability_review_candidate' OR routing = 'computability_review' THEN 'computability_review_or_partial' WHEN routing = 'keep_without_layer2_action' THEN 'keep_without_layer2_action_candidate' ELSE 'optional_targeted_rescue_or_review' END AS decision_b,
  concat_ws(' ', codes_1a, codes_1b, codes_1c, codes_1d, risk_reasons, action_a) AS said_a, concat_ws(' ', codes_1a, codes_1b, codes_1c, codes_1d, semantic_reasons, routing_reason, action_b) AS said_b FROM reasoned),
tasked AS (SELECT *, {', '.join(f"{_of(f'decision_{b}', 0)} AS family_{b}, {_of(f'decision_{b}', 1)} AS priority_{b}, {_of(f'decision_{b}', 2)} AS changes_tree_{b}" for b in 'ab')},
  CASE decision_a WHEN 'safe_structural_repair_candidate' THEN 'deterministic_safe_normalization' WHEN 'conservative_downgrade_candidate' THEN 'deterministic_conservative_downgrade' WHEN 'computability_review_or_partial' THEN 'computability_review' WHEN 'branch_a_diagnostic_only_not_auto_accept' THEN 'none' ELSE {_task('said_a', 'structured_llm_rescue_branch_a')} END AS task_a,
  CASE decision_b WHEN 'safe_structural_repair_candidate' THEN 'deterministic_safe_normalization' WHEN 'conservative_downgrade_candidate' THEN 'deterministic_conservative_downgrade' WHEN 'computability_review_or_partial' THEN 'computability_review' WHEN 'keep_without_layer2_action_candidate' THEN 'none' ELSE {_task('said_b', 'structured_llm_judge_branch_b')} END AS task_b FROM decided),
ruled AS (SELECT *, {_FORCED} AS forced,
  CASE WHEN {_FORCED} THEN 'human_review|B_rescue_unresolved' WHEN n_hard_b > 0 THEN 'human_review|B_layer1_hard_issue' WHEN routing = 'llm_verifier' THEN 'human_review|B_llm_verifier' WHEN sem < 0.6 THEN 'human_review|B_semantic_high_risk' WHEN computability = 'non_computable' THEN 'non_computable|B_non_computable' WHEN routing = 'computability_review' THEN 'partial|B_computability_review' WHEN computability = 'partial' THEN 'partial|B_partial_computability' WHEN exe < 0.85 THEN 'partial|B_execution_risk' WHEN routing = 'optional_llm_verifier_or_review' THEN 'partial|B_optional_review_partial' WHEN sem < 0.85 THEN 'partial|B_semantic_medium_risk' ELSE 'accept|B_accept' END AS fb,
  CASE WHEN n_hard_a > 0 THEN 'human_review|A_layer1_hard_issue' WHEN least_a < 0.6 THEN 'human_review|A_layer2_high_risk' WHEN computability = 'non_computable' THEN 'non_computable|A_non_computable' WHEN computability = 'partial' THEN 'partial|A_partial_computability' WHEN n_exec > 0 THEN 'partial|A_computability_review' WHEN least_a < 0.85 THEN 'partial|A_layer2_medium_risk' WHEN coalesce(computability, '') IN ('', 'computable') THEN 'accept|A_low_risk_accept' WHEN n_safe > 0 THEN 'accept|A_safe_normalization_accept' ELSE 'partial|A_default_partial' END AS fa FROM tasked),
final AS (SELECT *, split_part(fb, '|', 1) AS final_b, split_part(fb, '|', 2) AS rule_b,
  CASE WHEN forced THEN 'human_review' WHEN from_b AND k % 48 = 26 THEN 'human_review' WHEN from_b THEN split_part(fb, '|', 1) ELSE split_part(fa, '|', 1) END AS final_a,
  CASE WHEN forced THEN 'A_rescue_unresolved' WHEN from_b AND k % 48 = 26 THEN 'A_hybrid_from_B_missing_b_decision' WHEN from_b THEN 'A_hybrid_from_B_' || split_part(fb, '|', 1) ELSE split_part(fa, '|', 2) END AS rule_a FROM ruled)
"""
    return once(text)


def once(text: str) -> str:
    """The same with every table expression that starts a line materialised."""
    return re.sub(r"(?m)^(WITH |, )?(\w+) AS \((SELECT|\n)", r"\1\2 AS MATERIALIZED (\3", text)


#: Reasons by rule; those of a rescue and of the branch B label are put together.
_WHY = """A_hybrid_from_B_missing_b_decision branch_a_replaced_by_branch_b_but_missing_branch_b_final_decision
A_layer1_hard_issue branch_a_layer1_mandatory_rescue_or_review_remains
A_layer2_high_risk branch_a_layer2_high_risk_after_rescue
A_non_computable branch_a_non_computable
A_partial_computability branch_a_partial_computability
A_computability_review branch_a_layer1_computability_review
A_layer2_medium_risk branch_a_medium_risk_after_rescue
A_low_risk_accept branch_a_low_risk_no_hard_issue
A_safe_normalization_accept branch_a_safe_normalization_only
A_default_partial branch_a_uncertain_default_partial
B_layer1_hard_issue branch_b_layer1_mandatory_verifier_remains
B_llm_verifier branch_b_final_routing_llm_verifier
B_semantic_high_risk branch_b_semantic_grounding_high_risk
B_non_computable branch_b_non_computable
B_computability_review branch_b_computability_review
B_partial_computability branch_b_partial_computability
B_optional_review_partial branch_b_optional_verifier_or_review
B_semantic_medium_risk branch_b_semantic_grounding_medium_risk
B_accept branch_b_accept_routing_low_semantic_risk
B_default_partial branch_b_uncertain_default_partial"""
_WHY_RESCUED = "CASE WHEN rescue_decision = 'human_review' THEN 'candidate_selection_rescue_returned_human_review' WHEN rescue_decision = 'no_repair_possible' THEN 'candidate_selection_rescue_returned_no_repair_possible' WHEN local_validation = 'fail' THEN 'candidate_selection_rescue_failed_local_validation' ELSE 'candidate_selection_rescue_skipped:' || lower(skip_reason) END"


def _why(rule: str) -> str:
    return f"CASE WHEN {rule} LIKE '%rescue!_unresolved' ESCAPE '!' THEN {_WHY_RESCUED} WHEN {rule} = 'B_execution_risk' THEN 'branch_b_execution_' || execution_label || '_risk' ELSE map_from_entries([{', '.join('({!r}, {!r})'.format(*x.split()) for x in _WHY.splitlines())}])[{rule}] END"


#: Queries whose oracle statement is written by hand.
STATEMENTS = {
    "structural_codes": "SELECT key_id, codes_1a, hint_1a FROM counted",
    "source_warnings": "SELECT key_id, codes_1c FROM coded",
    "consistency_codes": "SELECT key_id, codes_1d FROM coded",
    "duplicate_codes": "SELECT key_id, codes_1b FROM coded WHERE twice = 1 OR same_again",
    "policy_action_counts": "SELECT action_a, action_b, count(*) AS n, avg(CASE WHEN n_hard_a > 0 THEN 1.0 WHEN n_exec > 0 THEN 0.7 WHEN n_safe > 0 THEN 0.2 ELSE 0.0 END) AS mean_a FROM policy GROUP BY ALL",
    "risk_by_operator_category": f"SELECT cat AS operator_category, risk_label, count(*) AS n, avg(round(least_a, 6)) AS mean_support, min(round(least_a, 6)) AS least_support FROM labelled GROUP BY ALL",
    "scores_a": "SELECT key_id, s_entity AS entity_support, s_operator AS operator_value_support, s_quant AS quantitative_support, s_time AS temporal_support, s_history AS history_support, s_context AS context_support, s_comp AS computability_support, s_layer1 AS layer1_support, round(least_a, 6) AS leaf_support, round(1 - least_a, 6) AS risk_score, risk_label, array_to_string(list_filter([CASE WHEN s_entity <= least_a + 1e-12 THEN 'entity_support' END, CASE WHEN s_operator <= least_a + 1e-12 THEN 'operator_value_support' END, CASE WHEN s_quant <= least_a + 1e-12 THEN 'quantitative_support' END, CASE WHEN s_time <= least_a + 1e-12 THEN 'temporal_support' END, CASE WHEN s_history <= least_a + 1e-12 THEN 'history_support' END, CASE WHEN s_context <= least_a + 1e-12 THEN 'context_support' END, CASE WHEN s_comp <= least_a + 1e-12 THEN 'computability_support' END, CASE WHEN s_layer1 <= least_a + 1e-12 THEN 'layer1_support' END], lambda x: x IS NOT NULL), '|') AS bottlenecks FROM labelled",
    "support_signals_a": "SELECT key_id, cat AS operator_category, in_ev AS entity_in_evidence, gen_a AS generic_entity, sup AS value_supported, val_ev AS value_in_evidence, t_a AS temporal_marker, h_a AS history_marker, c_a AS condition_marker, regexp_matches(n_ev, '\\b(unless|except|with the exception of)\\b') OR regexp_matches(n_clause, '\\b(unless|except|with the exception of)\\b') AS exception_marker, q_a AS quantitative_cue FROM signals",
    "screen_b": "SELECT key_id, e_b AS entity_b, v_b AS value_b, u_b AS unit_b, o_b AS operator_value_b, q_b AS quantitative_b, ts_b AS temporal_b, hs_b AS history_b, cs_b AS context_b, m_b AS modifier_b, al_b AS allowance_b, l1_b AS layer1_b, comp_b AS computability_b, exe_b AS execution_b_support FROM screened",
    "risk_reasons": "SELECT key_id, risk_reasons, semantic_reasons, execution_reasons FROM joined_b",
    "branch_agreement": "SELECT risk_label, semantic_label, routing, count(*) AS n FROM routed GROUP BY ALL",
    "decisions": "SELECT key_id, decision_a, family_a, priority_a, changes_tree_a, task_a, decision_b, family_b, priority_b, changes_tree_b, task_b FROM tasked",
    "decision_counts": "SELECT decision_a, decision_b, count(*) AS n FROM tasked GROUP BY ALL",
    "final_reasons": f"SELECT key_id, CASE WHEN rule_a LIKE 'A!_hybrid%' ESCAPE '!' AND rule_a NOT LIKE '%missing%' THEN 'branch_a_replaced_by_validated_branch_b_leaf;using_branch_b_post_rescue_decision:' || final_b ELSE {_why('rule_a')} END AS final_reasons_a, {_why('rule_b')} AS final_reasons_b FROM final",
    "final_decisions": "SELECT key_id, final_a, rule_a, final_b, rule_b, CASE WHEN b <= a THEN 'B' ELSE 'A' END AS chosen_branch, CASE WHEN b <= a THEN final_b ELSE final_a END AS chosen_decision FROM (SELECT *, list_position(['accept','partial','non_computable','human_review'], final_a) AS a, list_position(['accept','partial','non_computable','human_review'], final_b) AS b FROM final)",
}


def oracle_sql() -> dict[str, str]:
    head = rules()
    return {name: head + statement for name, statement in STATEMENTS.items()}
