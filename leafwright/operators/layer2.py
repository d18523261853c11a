"""Layer 2: support signals, minimum scores, labels and routing of both branches."""

from __future__ import annotations

from ..functions import text
from ..plans.dialect import CODED, Spark, choose, codes, flagged, one_of, some
from .layer1 import COMPARISONS, EQUALITIES, EXISTENCE, LISTS

# Marker patterns of branch A.
TEMPORAL_A = r"\b(within|before|after|since|during|prior to|previously|recent|recently|screening|baseline|randomization|diagnosis|surgery|treatment start|first dose)\b|\b(last|past)\s+\d+\s+(days?|weeks?|months?|years?)\b|\bwithin\s+(the\s+last\s+)?\d+\s+(days?|weeks?|months?|years?)\b"
HISTORY_A = r"\b(history of|prior|previous|previously|current|currently|stable dose|investigational|recurrent|recurrence|previously treated|prior treatment)\b"
CONDITION_A = r"\b(if|when|unless|except|with the exception of|provided that|in case of)\b"
EXCEPTION_A = r"\b(unless|except|with the exception of)\b"
CUE_A = r"(>=|<=|>|<|≥|≤|=)|\b(greater than|less than|more than|at least|at most|no more than|no less than|equal to|or more|or less|minimum|maximum|between)\b|\b\d+(,\d{3})*(\.\d+)?\b|\b(%|uln|x\s*10|mm3|mm\^3|mg/dl|mg|ml|score|grade)\b"
# Marker patterns of branch B.
TEMPORAL_B = r"(\bwithin\b|\bduring\b|\bbefore\b|\bafter\b|\bprior to\b|\bsince\b|\buntil\b|\bfollowing\s+(surgery|treatment|therapy|randomization|enrollment|procedure|transplantation)\b|\bbaseline\b|\bscreening\b|\benrollment\b|\brandomization\b|\bstudy entry\b|\bstudy start\b|\btreatment start\b|\blast\s+\d+\s+(days?|weeks?|months?|years?)\b)"
HISTORY_B = r"\b(history of|prior|previous|previously|past|recurrent|active|current|currently|ongoing|known|documented|diagnosed|treated|received|receiving)\b"
CONDITION_B = r"\b(if|unless|except|except for|other than|provided that|in case of|only if|as long as|if applicable)\b"
CUE_B = r"(<=|>=|<|>|≤|≥)|\b(at least|at most|less than|more than|greater than|no more than|no less than|minimum|maximum|above|below|under|over|between)\b|\b\d+(\.\d+)?\s*-\s*\d+(\.\d+)?\b|\bgrade\s+\d+"
MODIFIERS = ("active", "current", "currently", "ongoing", "uncontrolled", "severe", "symptomatic", "recurrent", "refractory", "relapsed", "residual", "comorbid", "planned", "planned need", "need for", "requiring", "adequate trial", "previous adequate trial", "prior adequate trial", "evident", "measurable")
HARD_MODIFIERS = ("adequate trial", "previous adequate trial", "prior adequate trial", "planned", "planned need", "need for", "requiring", "comorbid", "evident", "measurable")
ALLOWANCES = ("not excluded", "are not excluded", "will not be excluded", "not exclusionary", "is allowed", "are allowed", "permitted", "eligible despite")
GENERIC_B = ("", "patient", "patients", "subject", "subjects", "participant", "participants", "individual", "individuals", "disease", "condition", "therapy", "treatment", "test", "value", "result", "measurement", "criteria", "criterion", "other", "unknown", "none", "null")
GENERIC_A = ("of", "and", "or", "with", "patients", "patient", "subjects", "subject", "condition", "disease", "therapy", "treatment", "other")
REVIEW_BELOW, HIGH_FROM = 0.60, 0.85
COMPONENTS_A = ("entity", "operator_value", "quantitative", "temporal", "history", "context", "computability", "layer1")
COMPONENTS_B = ("entity", "value", "unit", "operator_value", "quantitative", "temporal", "history", "context", "modifier", "allowance", "layer1")


def _n(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


def _score(rules: list[tuple[str, float]], default: float) -> str:
    return choose([(t, _n(v)) for t, v in rules], _n(default))


_TEMPORAL = "(t_relation IS NOT NULL OR t_value IS NOT NULL OR t_unit IS NOT NULL OR t_anchor IS NOT NULL)"
_NO_VALUE = "(value_kind = 'null' OR value_kind IN ('string', 'number', 'list') AND coalesce(value_text, '') = '')"
_CONTEXT = "(coalesce(cond_text, '') <> '' OR coalesce(exc_text, '') <> '')"


def signals_a(d: Spark) -> list[tuple[str, str]]:
    """The signals of branch A, from the leaf and its best anchor."""
    ev, ent = text.lower_norm(d, "evidence_text"), text.lower_norm(d, "entity_text")
    clause, item = text.lower_norm(d, "clause_text"), text.lower_norm(d, "item_text")
    # A clause that is the evidence itself says nothing more.
    find = lambda p: f"({d.like(ev, p)} OR {d.both(f'{clause} <> {ev}', d.like(clause, p))})"
    supported = choose(
        [
            (one_of("operator", (*COMPARISONS, *EQUALITIES)), "coalesce(value_type = 'scalar', false) AND value_kind <> 'null'"),
            ("coalesce(operator = 'between', false)", "coalesce(value_type = 'range', false) AND (value_min IS NOT NULL OR value_max IS NOT NULL)"),
            (one_of("operator", LISTS), "coalesce(value_type = 'list', false) AND value_kind = 'list' AND coalesce(value_text, '') <> ''"),
            (one_of("operator", EXISTENCE), "true"),
        ],
        "false",
    )
    return [
        ("operator_category", choose([(one_of("operator", (*COMPARISONS, *EQUALITIES)), "'comparison'"), ("coalesce(operator = 'between', false)", "'range'"), (one_of("operator", LISTS), "'list'"), (one_of("operator", EXISTENCE), "'existence'")], "'other'")),
        ("entity_in_evidence", f"{ent} <> '' AND contains({ev}, {ent})"),
        ("entity_in_item", f"{ent} <> '' AND contains({item}, {ent})"),
        ("generic_entity", one_of(ent, GENERIC_A)),
        ("value_supported", supported),
        ("value_in_evidence", f"coalesce(value_text, '') <> '' AND contains({ev}, lower(value_text))"),
        ("temporal_marker", find(TEMPORAL_A)),
        ("history_marker", find(HISTORY_A)),
        ("condition_marker", find(CONDITION_A)),
        ("exception_marker", find(EXCEPTION_A)),
        ("quantitative_cue", find(CUE_A)),
    ]


def scores_a(d: Spark) -> list[tuple[str, str]]:
    """The eight component scores of branch A; layer-1 columns come from ``layer1.policy_a``."""
    anchored = "least(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), coalesce(anchor_score, CAST(0.75 AS DOUBLE)))), CASE WHEN anchor_type_match THEN CAST(1 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END, CASE WHEN anchor_overlap THEN CAST(1 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END, CASE WHEN entity_in_evidence THEN CAST(1 AS DOUBLE) WHEN entity_in_item THEN CAST(0.65 AS DOUBLE) ELSE CAST(0.45 AS DOUBLE) END, CASE WHEN generic_entity THEN CAST(0.4 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END)"
    unhandled = f"(condition_marker OR exception_marker) AND NOT {_CONTEXT}"
    exists = one_of("operator", EXISTENCE)
    policy = _score([("action_a = 'mandatory_rescue_or_review_candidate'", 0.45), ("action_a = 'computability_review_candidate'", 0.7), ("action_a = 'safe_normalization_candidate'", 0.9)], 1.0)
    return [
        ("entity_support", choose([("has_anchor", anchored)], _score([("entity_in_evidence AND NOT generic_entity", 0.6), ("entity_in_item AND NOT generic_entity", 0.5), ("entity_in_evidence", 0.4)], 0.25))),
        ("operator_value_support", _score([("operator_category = 'existence'", 1.0), ("operator_category <> 'other' AND value_supported AND value_in_evidence", 0.9), ("operator_category <> 'other' AND value_supported", 0.7), ("operator_category <> 'other'", 0.3)], 0.5)),
        ("quantitative_support", _score([(f"quantitative_cue AND ({exists} OR value_kind = 'null')", 0.35)], 1.0)),
        ("temporal_support", _score([("NOT temporal_marker", 1.0), (_TEMPORAL, 0.9)], 0.4)),
        ("history_support", _score([("NOT history_marker", 1.0), ("coalesce(history_context, '') <> ''", 0.9)], 0.5)),
        ("context_support", _score([(f"coalesce(computability = 'computable', false) AND {unhandled}", 0.3), (unhandled, 0.4), ("condition_marker OR exception_marker", 0.85)], 1.0)),
        ("computability_support", _score([("computability = 'computable'", 1.0), ("computability = 'partial'", 0.7), (f"computability = 'non_computable' AND {text.blank(d, 'non_computable_reason', '<>')}", 0.8), ("computability = 'non_computable'", 0.6)], 0.5)),
        ("layer1_support", f"least({policy}, CASE WHEN {some(d, 'codes_1d')} THEN {_n(0.55)} ELSE {_n(1)} END, CASE WHEN {some(d, 'codes_1a')} OR {some(d, 'codes_1c')} THEN {_n(0.65)} ELSE {_n(1)} END)"),
    ]


def reasons_a(d: Spark) -> list[tuple[str, str]]:
    """risk_reasons: why the components of branch A are below one, sorted."""
    own = flagged(d, "risk_reasons", _reasons_a(d))
    # The reason for an operator of no category names it.
    named = "concat('unknown_or_other_operator_category:', coalesce(nullif(operator, ''), operator_category))"
    return [*own[:-1], ("risk_reasons", f"replace({own[-1][1]}, 'unknown_or_other_operator_category', {named})")]


def _reasons_a(d: Spark) -> list[tuple[str, str]]:
    unhandled = f"(condition_marker OR exception_marker) AND NOT {_CONTEXT}"
    computable = "coalesce(computability = 'computable', false)"
    return [
        ("no_bert_anchor", "NOT has_anchor"),
        ("entity_type_not_supported_by_best_anchor", "has_anchor AND NOT anchor_type_match"),
        ("entity_text_not_aligned_with_any_anchor", "has_anchor AND NOT anchor_overlap"),
        ("entity_not_in_leaf_evidence_but_in_item", "NOT entity_in_evidence AND entity_in_item AND (has_anchor OR NOT generic_entity)"),
        ("entity_not_grounded_in_evidence_or_item", "NOT entity_in_evidence AND (NOT entity_in_item OR NOT has_anchor AND generic_entity)"),
        ("generic_entity_text", "generic_entity"),
        ("operator_value_supported_but_value_not_found_in_evidence", "operator_category IN ('comparison', 'range', 'list') AND value_supported AND NOT value_in_evidence"),
        ("operator_value_not_structurally_supported", "operator_category IN ('comparison', 'range', 'list') AND NOT value_supported"),
        ("unknown_or_other_operator_category", "operator_category = 'other'"),
        ("temporal_marker_without_temporal_context", f"temporal_marker AND NOT {_TEMPORAL}"),
        ("history_marker_without_history_context", "history_marker AND coalesce(history_context, '') = ''"),
        ("computable_with_unhandled_condition_or_exception", f"{computable} AND {unhandled}"),
        ("condition_or_exception_marker_without_context", f"NOT {computable} AND {unhandled}"),
        ("computability_partial", "coalesce(computability = 'partial', false)"),
        ("computability_non_computable", "coalesce(computability = 'non_computable', false)"),
        ("non_computable_without_reason", f"coalesce(computability = 'non_computable', false) AND {text.blank(d, 'non_computable_reason')}"),
        ("unknown_computability", "coalesce(computability, '') NOT IN ('computable', 'partial', 'non_computable')"),
        ("quantitative_cue_not_represented", "quantitative_support < 1"),
        ("layer1_policy_mandatory_rescue_or_review", "action_a = 'mandatory_rescue_or_review_candidate'"),
        ("layer1_policy_computability_review", "action_a = 'computability_review_candidate'"),
        ("layer1_policy_safe_normalization_candidate", "action_a = 'safe_normalization_candidate'"),
        ("layer1d_pass1_pass2_logic_flag", some(d, "codes_1d")),
        ("layer1_inventory_flag", f"{some(d, 'codes_1a')} OR {some(d, 'codes_1c')}"),
    ]


def least_a(d: Spark) -> list[tuple[str, str]]:
    """The least component, with and without layer 1."""
    return [("least_a", "least(" + ", ".join(f"{c}_support" for c in COMPONENTS_A) + ")"), ("least_signal", "least(" + ", ".join(f"{c}_support" for c in COMPONENTS_A if c != "layer1") + ")")]


def _label(x: str, words: tuple[str, str, str]) -> str:
    return choose([(f"{x} < {_n(REVIEW_BELOW)}", f"'{words[0]}'"), (f"{x} >= {_n(HIGH_FROM)}", f"'{words[2]}'")], f"'{words[1]}'")


LABELS_A = ("review_priority", "intermediate_support", "high_support_not_auto_accept")
LABELS_B = ("reference_review_priority", "reference_intermediate_support", "reference_high_support_not_auto_accept")


def label_a(d: Spark) -> list[tuple[str, str]]:
    """leaf_support (the least component), its complement, label and bottlenecks."""
    tight = "concat_ws('|', " + ", ".join(f"CASE WHEN {c}_support - least_a < 1e-12 THEN '{c}_support' END" for c in COMPONENTS_A) + ")"
    return [("leaf_support", "round(least_a, 6)"), ("risk_score", f"round({_n(1)} - least_a, 6)"), ("risk_label", _label("least_a", LABELS_A)), ("bottlenecks", tight)]


def ablation(d: Spark) -> list[tuple[str, str]]:
    """The score without the layer-1 component, its label, and how far the labels are apart."""
    rank = lambda x: f"(CASE WHEN {x} < {_n(REVIEW_BELOW)} THEN 2 WHEN {x} < {_n(HIGH_FROM)} THEN 1 ELSE 0 END)"
    return [("signal_support", "round(least_signal, 6)"), ("signal_label", _label("least_signal", LABELS_A)), ("severity_difference", f"{rank('least_a')} - {rank('least_signal')}")]


def numeric_b(d: Spark) -> list[tuple[str, str]]:
    """Numeric bases of the texts that the screen of branch B compares."""
    return [("base_ev", text.numeric_base(d, "evidence_text")), ("base_item", text.numeric_base(d, "item_text")), ("base_value", text.numeric_base(d, "CASE WHEN value_kind IN ('string', 'number', 'list') THEN value_text END")), *(_clinical(d) if type(d) is Spark else [])]


def _clinical(d: Spark) -> list[tuple[str, str]]:
    return [(f"clinical_{n}", text.clinical(d, x)) for n, x in (("ev", "evidence_text"), ("item", "item_text"), ("entity", "entity_text"), ("unit", "unit"))]


def marks_b(d: Spark) -> list[tuple[str, str]]:
    """What the screen of branch B looks at several times, once; the oracle has it written out."""
    return [(n, e) for n, e in _marks_b(d).items()] if type(d) is Spark else []


def _missing(d: Spark, m: str) -> str:
    return f"(contains({text.lower_norm(d, 'evidence_text')}, '{m}') AND NOT contains({text.lower_norm(d, 'entity_text')}, '{m}'))"


def _marks_b(d: Spark) -> dict[str, str]:
    ev = text.lower_norm(d, "evidence_text")
    found = {n: d.like(ev, p) for n, p in (("temporal_mark_b", TEMPORAL_B), ("history_mark_b", HISTORY_B), ("condition_mark_b", CONDITION_B))}
    return found | {"modifier_missing_b": "(" + " OR ".join(_missing(d, m) for m in MODIFIERS) + ")"}


def grounding_b(d: Spark) -> list[tuple[str, str]]:
    """Normal forms and found parts that the screen of branch B looks at several times."""
    whole = lambda x: f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS STRING) ELSE CAST({x} AS STRING) END"
    # Without articles, number words and limits it is the clinical form.
    same = lambda x, low: d.passed(f"{text.odd(low)} OR contains({low}, 'the') OR contains({low}, 'ln') OR {d.like(low, text.DIGITS)}", text.numeric_words(d, f"base_{x}"), f"clinical_{x}")
    ev, item = same("ev", text.lower_norm(d, "evidence_text")), same("item", text.lower_norm(d, "item_text"))
    spark = type(d) is Spark
    clinical = {} if spark else dict(_clinical(d))
    share = lambda of, against: text.recall_of(d, of, against)
    first = [(n, clinical.pop(n)) for n in ("clinical_ev", "clinical_item", "clinical_entity") if n in clinical]
    return [
        ("source_b", d.wanted("coalesce(base_value, '') <> '' OR value_kind = 'range'", f"concat({ev}, ' ', {item})")),
        *first,
        ("atom_value", text.numeric_words(d, "base_value")),
        ("atom_min", f"coalesce(CASE WHEN value_kind = 'range' THEN {whole('value_min')} END, '')"),
        ("atom_max", f"coalesce(CASE WHEN value_kind = 'range' THEN {whole('value_max')} END, '')"),
        *clinical.items(),
        ("entity_share", f"greatest({share('en_ground', 'ev_ground')}, {share('en_ground', 'it_ground')})"),
        ("unit_share", f"greatest({share('un_ground', 'ev_ground')}, {share('un_ground', 'it_ground')})"),
        ("cue_b", d.wanted(f"{_NO_VALUE} OR operator = 'exists'", d.like(text.lower_norm(d, "evidence_text"), CUE_B))),
        ("no_value_b", _NO_VALUE),
    ]


def screen_b(d: Spark) -> list[tuple[str, str]]:
    """The eleven semantic and two execution scores of branch B."""
    ev, item, ent = text.lower_norm(d, "evidence_text"), text.lower_norm(d, "item_text"), text.lower_norm(d, "entity_text")
    mark = {n: n for n in _marks_b(d)} if type(d) is Spark else _marks_b(d)
    quantitative = one_of("operator", (*COMPARISONS, *EQUALITIES, "between"))
    # Every atom of the value stands in the source; a value without atoms needs none.
    held = lambda x: f"({x} = '' OR contains(source_b, {x}))"
    counted = d.like(ev, r"\b(one|two|three|four|five|at least|at most|number of)\b")
    in_source = "(atom_value <> '' AND contains(source_b, atom_value))"
    return [
        ("entity_b", _score([(one_of("clinical_entity", GENERIC_B), 0.45), (f"contains({text.norm(d, 'evidence_text')}, {text.norm(d, 'entity_text')})", 1.0), (f"contains({ev}, {ent}) OR contains(clinical_ev, clinical_entity)", 0.95), (f"contains({item}, {ent})", 0.85), ("entity_share >= 0.75", 0.8), ("entity_share >= 0.5", 0.65), ("entity_share >= 0.25", 0.55)], 0.35)),
        ("value_b", _score([(f"no_value_b OR coalesce(value_type, 'null') = 'null' OR {held('atom_value')} AND {held('atom_min')} AND {held('atom_max')}", 1.0)], 0.45)),
        ("unit_b", _score([("clinical_unit IN ('', 'null', 'none', 'nan')", 1.0), (f"clinical_unit IN ('count', 'number') AND {in_source}", 1.0), (f"clinical_unit IN ('count', 'number') AND {counted}", 0.95), ("clinical_unit IN ('count', 'number')", 0.75), ("contains(clinical_ev, clinical_unit)", 1.0), ("unit_share >= 0.75", 0.85)], 0.65)),
        ("operator_value_b", _score([("operator IS NULL", 0.4), (f"({quantitative} OR operator IN ('in', 'contains')) AND no_value_b", 0.4)], 1.0)),
        ("quantitative_b", _score([(f"cue_b AND NOT {quantitative} AND no_value_b", 0.35), ("cue_b AND no_value_b", 0.4), ("cue_b AND coalesce(operator = 'exists', false)", 0.45)], 1.0)),
        ("temporal_b", _score([(f"{mark['temporal_mark_b']} AND NOT {_TEMPORAL}", 0.4), (mark['temporal_mark_b'], 0.95), (_TEMPORAL, 0.85)], 1.0)),
        ("history_b", _score([(f"{mark['history_mark_b']} AND coalesce(history_context, '') = ''", 0.5), (mark['history_mark_b'], 0.95), ("coalesce(history_context, '') <> ''", 0.9)], 1.0)),
        ("context_b", _score([(f"{mark['condition_mark_b']} AND NOT {_CONTEXT}", 0.4), (mark['condition_mark_b'], 0.95), (_CONTEXT, 0.9)], 1.0)),
        ("modifier_b", _score([(mark["modifier_missing_b"], 0.45)], 1.0)),
        ("allowance_b", _score([("(" + " OR ".join(f"contains({ev}, '{a}')" for a in ALLOWANCES) + ")", 0.35)], 1.0)),
        ("layer1_b", _score([("action_b = 'mandatory_verifier_candidate'", 0.5), ("action_b = 'continue_to_layer2_grounding_screen'", 0.8)], 1.0)),
        ("computability_b", _score([("computability = 'computable'", 1.0), ("computability = 'partial'", 0.6), ("computability = 'non_computable'", 0.35)], 0.5)),
        ("execution_b_support", _score([("action_b = 'continue_to_layer2'", 1.0), ("action_b = 'computability_review_candidate'", 0.7)], 0.9)),
        # The reason names the missing modifiers in order of the alphabet; the first decides whether it is a hard one.
        ("hard_modifier", d.both(mark["modifier_missing_b"], choose([(_missing(d, m), "true" if m in HARD_MODIFIERS else "false") for m in sorted(MODIFIERS)], "false"))),
    ]


def reasons_b(d: Spark) -> list[tuple[str, str]]:
    """semantic_reasons and execution_reasons of branch B, sorted."""
    execution = [("computability_partial", "computability_b = 0.6"), ("computability_non_computable", "computability_b = 0.35"), ("computability_missing_or_unknown", "computability_b = 0.5"), ("layer1_execution:layer1_policy_execution_issue", "execution_b_support = 0.7")]
    return [*flagged(d, "semantic_reasons", _semantic_reasons()), ("execution_reasons", codes(execution))]


def _semantic_reasons() -> list[tuple[str, str]]:
    return [
        ("generic_entity_text", one_of("clinical_entity", GENERIC_B)),
        ("entity_not_in_evidence_but_in_item", "entity_b = 0.85"),
        ("entity_supported_by_source_token_overlap", "entity_b = 0.8"),
        ("entity_partially_supported_by_source_token_overlap", "entity_b = 0.65"),
        ("entity_weakly_supported_by_source_token_overlap", "entity_b = 0.55"),
        ("entity_not_grounded_in_evidence_or_item", "entity_b = 0.35"),
        ("value_not_grounded_in_evidence_or_item", "value_b = 0.45"),
        ("count_unit_inferred_but_value_not_clearly_grounded", "unit_b = 0.75"),
        ("unit_supported_by_source_token_overlap", "unit_b = 0.85"),
        ("unit_not_grounded_in_evidence_or_item", "unit_b = 0.65"),
        ("operator_value_not_structurally_supported", "operator_value_b < 1"),
        ("quantitative_cue_not_represented", "quantitative_b = 0.35"),
        ("value_missing_despite_quantitative_cue", "quantitative_b = 0.4"),
        ("exists_operator_with_quantitative_cue", "quantitative_b = 0.45"),
        ("temporal_marker_without_temporal_context", "temporal_b = 0.4"),
        ("temporal_context_without_clear_marker", "temporal_b = 0.85"),
        ("history_marker_without_history_context", "history_b = 0.5"),
        ("condition_or_exception_marker_without_context", "context_b = 0.4"),
        ("critical_modifier_missing", "modifier_b < 1"),
        ("allowance_or_polarity_clause", "allowance_b < 1"),
        ("layer1_policy:hard_semantic_or_structural_issue", "layer1_b = 0.5"),
        ("layer1_policy:soft_semantic_warning", "layer1_b = 0.8"),
    ]


CODED.update({"risk_reasons": tuple(sorted(n for n, _ in _reasons_a(Spark()))), "semantic_reasons": tuple(sorted(n for n, _ in _semantic_reasons()))})


def least_b(d: Spark) -> list[tuple[str, str]]:
    """The least semantic and execution components, and whether a hard semantic reason holds."""
    hard = "(allowance_b < 1 OR entity_b IN (0.35, 0.45) OR value_b = 0.45 OR quantitative_b < 1 OR context_b = 0.4 OR temporal_b = 0.4 OR history_b = 0.5 OR hard_modifier)"
    return [("least_sem", "least(" + ", ".join(f"{c}_b" for c in COMPONENTS_B) + ")"), ("least_exe", "least(computability_b, execution_b_support)"), ("hard_reason", hard)]


def routing_b(d: Spark) -> list[tuple[str, str]]:
    """Semantic and execution support, labels, the final routing and its reason."""
    high = _n(HIGH_FROM)
    rules = [
        ("action_b = 'mandatory_verifier_candidate'", "llm_verifier", "'layer1_policy_mandatory_verifier'"),
        ("hard_reason", "llm_verifier", "'hard_semantic_grounding_uncertainty'"),
        ("action_b = 'continue_to_layer2_grounding_screen'", "optional_llm_verifier_or_review", "'layer1_policy_soft_warning'"),
        (f"least_sem < {high}", "optional_llm_verifier_or_review", f"concat('semantic_grounding_', {_label('least_sem', LABELS_B)})"),
        ("action_b = 'computability_review_candidate'", "computability_review", "'layer1_policy_computability_review'"),
        (f"least_exe < {high}", "computability_review", f"concat('execution_support_', {_label('least_exe', LABELS_B)})"),
    ]
    return [
        ("semantic_support", "round(least_sem, 6)"),
        ("execution_support", "round(least_exe, 6)"),
        ("semantic_label", _label("least_sem", LABELS_B)),
        ("execution_label", _label("least_exe", LABELS_B)),
        ("semantic_bottlenecks", f"CASE WHEN least_sem >= {high} THEN '' ELSE {codes([(c, f'{c}_b - least_sem < 1e-12') for c in COMPONENTS_B])} END"),
        ("routing", choose([(t, f"'{r}'") for t, r, _ in rules], "'keep_without_layer2_action'")),
        ("routing_reason", choose([(t, why) for t, _, why in rules], "'high_semantic_and_execution_support_reference'")),
    ]
