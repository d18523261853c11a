"""Layer 1: structural codes, source-text warnings, action hints, policies.

Leaves are flat rows (see ``plans.leaves``). A value is in ``value_kind`` (null,
string, number, list, range), ``value_text``, ``value_num``, ``value_min`` and
``value_max``. Every function returns new columns for ``dialect.apply``.
"""

from __future__ import annotations

from ..functions import text
from ..plans.dialect import CODED, Spark, choose, flagged, held, hits, holds, one_of

# The enumerations of the leaf schema.
COMPARISONS = ("<", "<=", ">", ">=")
EQUALITIES = ("=", "!=")
EXISTENCE = ("exists", "not_exists")
LISTS = ("in", "not_in")
PATTERNS = ("contains", "matches")
OPERATORS = (*EXISTENCE, *EQUALITIES, *COMPARISONS, "between", *LISTS, *PATTERNS)
RELATIONS = ("before", "after", "during", "within", "since")
UNITS = ("hour", "day", "week", "month", "year")
ANCHORS = ("screening", "randomization", "treatment_start", "diagnosis", "index_date", "surgery", "procedure", "baseline", "other")
ENTITY_TYPES = ("condition", "drug", "procedure", "lab", "demographic", "therapy", "biomarker", "vital", "observation", "stage", "line_of_therapy", "other")
HISTORY = ("current", "prior", "previously_treated", "stable_dose", "investigational_use", "other")
VALUE_TYPES = ("scalar", "list", "range", "null")
COMPUTABILITY = ("computable", "partial", "non_computable")
CONCEPT_SYSTEMS = ("SNOMED-CT", "RxNorm", "LOINC", "ICD-10-CM", "UCUM")
# Quantitative types, qualifiers, markers, generic words, anchors by phrase, weights of codes, warnings, checks.
QUANTITATIVE_TYPES = ("lab", "vital", "observation", "demographic", "stage", "line_of_therapy")
QUALIFIERS = ("active", "uncontrolled", "compromised", "refusal", "refuse", "unresolved", "severe", "stable")
TEMPORAL_MARKERS = ("at screening", "during screening", "prior to", "before", "after", "within", "since", "baseline", "randomization", "study start", "study entry", "pre-procedure", "post-procedure")
RELATION_MARKERS = ("within", "prior to", "before", "after", "since", "following", "pre-procedure", "post-procedure", "study entry", "study start", "randomization", "screening")
CONDITION_MARKERS = ("if", "unless", "except", "if applicable", "provided that", "in case", "only if")
GENERIC = ("of", "and", "or", "with", "without", "other", "any", "patients", "subjects", "patient", "subject", "condition", "disease", "history")
# The first phrase present decides.
ANCHOR_OF = (
    ("randomization", "randomization"), ("screening", "screening"), ("baseline", "baseline"), ("study start", "screening"), ("study entry", "screening"),
    ("treatment start", "treatment_start"), ("prior to treatment", "treatment_start"), ("before treatment", "treatment_start"), ("diagnosis", "diagnosis"),
    ("surgery", "surgery"), ("procedure", "procedure"), ("pre-procedure", "procedure"), ("post-procedure", "procedure"),
)
SAFE_NORMAL = ("comparison_value_is_numeric_string",)
EXECUTION = ("computable_with_exception_context", "computable_with_non_computable_reason", "non_computable_without_reason", "computability_invalid_enum")
WARNINGS = (
    "comparison_with_non_quantitative_entity", "comparison_entity_mismatch_from_source", "categorical_value_missing", "temporal_marker_without_temporal_context",
    "duration_marker_missing_from_temporal_context", "critical_qualifier_missing_from_entity", "requirement_object_inversion", "condition_context_present_without_handling",
    "temporal_anchor_mismatch_from_source", "existence_operator_on_quantitative_phrase", "entity_text_too_generic",
)
SOFT_WARNINGS = ("comparison_with_non_quantitative_entity", "temporal_marker_without_temporal_context", "duration_marker_missing_from_temporal_context", "critical_qualifier_missing_from_entity")
CONSISTENCY = (
    "pass2_leaf_without_pass1_clause", "evidence_text_not_substring_of_pass1_source_text", "negation_clause_with_exists_operator", "positive_clause_with_not_exists_operator",
    "negative_entity_with_not_exists_operator", "exception_or_condition_clause_without_context_handling", "exception_or_condition_clause_with_computable_status", "exception_clause_computable_despite_context",
)


def _temporal() -> str:
    """The temporal context exists as soon as one of its fields does."""
    return "(t_relation IS NOT NULL OR t_value IS NOT NULL OR t_unit IS NOT NULL OR t_anchor IS NOT NULL)"


def _tests(d: Spark) -> list[tuple[str, str]]:
    no_value = "value_kind = 'null'"
    existence, comparison = one_of("operator", EXISTENCE), one_of("operator", COMPARISONS)
    reason, context = text.blank(d, "non_computable_reason", "<>"), "(coalesce(cond_text, '') <> '' OR coalesce(exc_text, '') <> '')"
    between = "coalesce(operator = 'between' AND value_type = 'range' AND value_kind = 'range', false)"
    numeric = d.like("trim(coalesce(t_value, ''))", r"^\d+(\.\d+)?$")
    kind = lambda t: f"coalesce(value_type = '{t}', false)"
    return [
        ("criterion_id_missing", "coalesce(criterion_id, '') = ''"),
        ("criterion_id_malformed", f"coalesce(criterion_id, '') <> '' AND NOT {d.like('criterion_id', r'^.+_C\d+$')}"),
        ("entity_type_invalid_enum", f"NOT {one_of('entity_type', ENTITY_TYPES)}"),
        ("history_context_invalid_enum", f"history_context IS NOT NULL AND NOT {one_of('history_context', HISTORY)}"),
        ("entity_text_empty", text.blank(d, "entity_text")),
        ("evidence_text_empty", text.blank(d, "evidence_text")),
        ("operator_missing", "operator IS NULL"),
        ("comparison_without_scalar_value", f"{comparison} AND ({no_value} OR NOT {kind('scalar')})"),
        ("equality_without_value", f"{one_of('operator', EQUALITIES)} AND ({no_value} OR {kind('null')})"),
        ("pattern_operator_without_scalar_value", f"{one_of('operator', PATTERNS)} AND ({no_value} OR NOT {kind('scalar')})"),
        ("between_without_range_value", f"coalesce(operator = 'between', false) AND NOT {between}"),
        ("range_with_both_bounds_missing", f"{between} AND value_min IS NULL AND value_max IS NULL"),
        ("range_with_missing_bound", f"{between} AND (value_min IS NULL) <> (value_max IS NULL)"),
        ("range_min_greater_than_max", f"{between} AND coalesce(value_min > value_max, false)"),
        ("list_operator_without_list_value", f"{one_of('operator', LISTS)} AND NOT ({kind('list')} AND value_kind = 'list' AND coalesce(value_text, '') <> '')"),
        ("existence_operator_with_non_null_value", f"{existence} AND (NOT {kind('null')} OR NOT {no_value})"),
        ("comparison_value_is_numeric_string", f"{comparison} AND {kind('scalar')} AND value_kind = 'string' AND {d.like('trim(coalesce(value_text, ' + chr(39) * 2 + '))', r'^[-+]?\d+(\.\d+)?$')}"),
        ("null_value_type_with_non_null_value", f"{kind('null')} AND NOT {no_value}"),
        ("scalar_value_type_with_complex_value", f"{kind('scalar')} AND value_kind IN ('list', 'range')"),
        ("list_value_type_without_list_value", f"{kind('list')} AND value_kind <> 'list'"),
        ("range_value_type_without_dict_value", f"{kind('range')} AND value_kind <> 'range'"),
        ("temporal_context_missing_relation", f"{_temporal()} AND coalesce(t_relation, '') = ''"),
        ("temporal_context_invalid_relation", f"coalesce(t_relation, '') <> '' AND NOT {one_of('t_relation', RELATIONS)}"),
        ("temporal_context_missing_anchor_event", f"{_temporal()} AND coalesce(t_anchor, '') = ''"),
        ("temporal_context_invalid_anchor_event", f"coalesce(t_anchor, '') <> '' AND NOT {one_of('t_anchor', ANCHORS)}"),
        ("temporal_context_invalid_unit", f"t_unit IS NOT NULL AND NOT {one_of('t_unit', UNITS)}"),
        ("temporal_context_missing_value", "t_value IS NULL AND (t_unit IS NOT NULL OR coalesce(t_relation = 'within', false))"),
        ("temporal_context_missing_unit", f"t_value IS NOT NULL AND {numeric} AND t_unit IS NULL"),
        ("computable_with_non_computable_reason", f"coalesce(computability = 'computable', false) AND {reason}"),
        ("non_computable_without_reason", f"coalesce(computability = 'non_computable', false) AND NOT {reason}"),
        ("computable_with_exception_context", f"coalesce(computability = 'computable', false) AND {context}"),
        ("unit_present_without_value", f"coalesce(unit, '') <> '' AND {kind('null')} AND NOT {existence}"),
        ("operator_invalid_enum", f"operator IS NOT NULL AND NOT {one_of('operator', OPERATORS)}"),
        ("value_type_invalid_enum", f"value_type IS NOT NULL AND NOT {one_of('value_type', VALUE_TYPES)}"),
        ("computability_invalid_enum", f"computability IS NOT NULL AND NOT {one_of('computability', COMPUTABILITY)}"),
        ("normalized_concept_invalid_system", f"concept_system IS NOT NULL AND NOT {one_of('concept_system', CONCEPT_SYSTEMS)}"),
        ("normalized_concept_system_without_code", "concept_system IS NOT NULL AND coalesce(concept_code, '') = ''"),
    ]


#: Every structural code.
STRUCTURAL = tuple(name for name, _ in _tests(Spark()))
HARD_STRUCTURAL = tuple(x for x in STRUCTURAL if x not in (*SAFE_NORMAL, *EXECUTION))
DUPLICATES = ("duplicate_criterion_id", "duplicate_identical_leaf")
CODED.update({"codes_1a": tuple(sorted(STRUCTURAL)), "codes_1b": DUPLICATES, "codes_1c": tuple(sorted(WARNINGS)), "codes_1d": tuple(sorted(CONSISTENCY))})


def structural_codes(d: Spark) -> list[tuple[str, str]]:
    """codes_1a: the structural issues of a leaf."""
    return flagged(d, "codes_1a", _tests(d))


def source_warnings(d: Spark) -> list[tuple[str, str]]:
    """codes_1c: where the leaf disagrees with its own evidence text."""
    src, entity, src_l, entity_l = "evidence_text", "entity_text", text.lower_norm(d, "evidence_text"), text.lower_norm(d, "entity_text")
    existence = f"{one_of('operator', EXISTENCE)} AND coalesce(value_type = 'null', false)"
    comparison = one_of("operator", COMPARISONS)
    head = d.replace(d.extract(text.norm(d, src), r"([A-Za-z][A-Za-z0-9 /\-]{1,80}?)\s*(<=|>=|<|>|=|!=)\s*[-+]?\d", 1), r"^(and|or|with|patients with|subjects with|And|Or|With)\s+", "")
    generic, share, shared = text.token_set(d, entity), text.recall(d, head, entity), []
    if type(d) is Spark:
        # Each once; an expression with a lambda is evaluated anew, and its patterns are not compiled, wherever it is written.
        shared = [("source_head", d.wanted(comparison, head)), ("head_words", d.wanted("source_head <> ''", text.token_set(d, "source_head"))), ("entity_words", generic)]
        head, generic, share = "source_head", "entity_words", text.recall_of(d, "head_words", "entity_words")
    word = lambda x, m: d.like(x, rf"\b{m}\b")
    captured = lambda m: f"({word(entity_l, m)} OR {word(text.lower_norm(d, 'value_text'), m)})"
    markers = ("negative", "positive", "normal", "abnormal")
    categorical = choose([(word(src_l, m), f"NOT {captured(m)}") for m in markers], "false")
    anchor = choose([(f"contains({src_l}, '{p}')" if " " in p else word(src_l, p.replace("-", r"\-")), f"coalesce(t_anchor, '') <> '' AND t_anchor <> '{a}'") for p, a in ANCHOR_OF], "false")
    scalar_duration = f"(value_kind <> 'null' AND {one_of(d.replace('lower(trim(unit))', 's+$', ''), UNITS)})"
    inverted = r"\b([a-z][a-z\s\-]+?)\s+requiring\s+([a-z][a-z\s\-]+)\b"
    left, right = (f"trim({d.extract(src_l, inverted, g)})" for g in (1, 2))
    return [
        *shared,
        *flagged(
            d,
            "codes_1c",
            [
                ("entity_text_too_generic", f"{one_of(entity_l, GENERIC)} OR {d.size(generic)} = 0"),
                ("comparison_with_non_quantitative_entity", f"{comparison} AND NOT {one_of('entity_type', QUANTITATIVE_TYPES)} AND NOT {text.quantitative_surface(d, entity)} AND NOT {text.quantitative_surface(d, src)}"),
                ("comparison_entity_mismatch_from_source", f"{comparison} AND {head} <> '' AND {share} < 0.5"),
                ("categorical_value_missing", f"{existence} AND {categorical}"),
                ("temporal_marker_without_temporal_context", d.asked(text.any_marker(d, src, TEMPORAL_MARKERS), f"NOT {_temporal()}")),
                ("duration_marker_missing_from_temporal_context", d.asked(f"{text.duration(d, src)} AND {text.any_marker(d, src, RELATION_MARKERS)}", f"(t_value IS NULL OR t_unit IS NULL) AND NOT {scalar_duration}")),
                ("temporal_anchor_mismatch_from_source", f"{_temporal()} AND {anchor}"),
                ("critical_qualifier_missing_from_entity", "(" + " OR ".join(f"({word(src_l, q)} AND NOT {word(entity_l, q)})" for q in QUALIFIERS) + ")"),
                ("requirement_object_inversion", f"{right} <> '' AND contains({entity_l}, {right}) AND NOT contains({entity_l}, {left})"),
                ("condition_context_present_without_handling", d.asked(text.any_marker(d, src, CONDITION_MARKERS), f"{text.blank(d, 'cond_text')} AND {text.blank(d, 'exc_text')}")),
                ("existence_operator_on_quantitative_phrase", f"{existence} AND {one_of('entity_type', ('lab', 'vital', 'observation'))} AND {text.normality(d, src)}"),
            ],
        )
    ]


def action_hint(d: Spark) -> list[tuple[str, str]]:
    """hint_1a: what layer 3 may do about the structural codes; the first rule that holds."""
    order = [(c, "safe_normalization_candidate") for c in ("computable_with_exception_context", "computable_with_non_computable_reason", "non_computable_without_reason")]
    order += [(c, "flag_only") for c in (
        "range_with_missing_bound", "equality_without_value", "pattern_operator_without_scalar_value", "temporal_context_invalid_anchor_event", "temporal_context_invalid_relation",
        "temporal_context_invalid_unit", "operator_missing", "entity_type_invalid_enum", "history_context_invalid_enum", "criterion_id_missing", "criterion_id_malformed",
        "null_value_type_with_non_null_value", "operator_invalid_enum", "value_type_invalid_enum", "computability_invalid_enum", "normalized_concept_invalid_system",
        "normalized_concept_system_without_code", "range_min_greater_than_max",
    )]
    order += [("comparison_value_is_numeric_string", "safe_normalization_candidate"), ("existence_operator_with_non_null_value", "flag_only")]
    rules = [("bits_codes_1a = 0" if type(d) is Spark else "codes_1a = ''", "'no_action'"), *((holds(d, "codes_1a", c), f"'{h}'") for c, h in order)]
    missing = f"({holds(d, 'codes_1a', 'temporal_context_missing_value')} OR {holds(d, 'codes_1a', 'temporal_context_missing_unit')})"
    rules.append((missing, "CASE WHEN value_kind <> 'null' AND coalesce(unit, '') <> '' THEN 'safe_normalization_candidate' ELSE 'flag_only' END"))
    rules += [(holds(d, "codes_1a", c), "'conservative_rewrite_candidate'") for c in ("list_operator_without_list_value", "comparison_without_scalar_value", "range_with_both_bounds_missing")]
    return [("hint_1a", choose(rules, "'flag_only'"))]


# What makes a clause negative, what makes an entity negative, what makes a clause conditional.
NEGATIVE_CLAUSE = (
    r"no\b", r"not\b", r"without\b", r"absence of\b", r"free of\b", r"negative for\b", r"unable to\b", r"inability to\b", r"unability to\b", r"lack of\b",
    r"failure to\b", r"failed to\b", r"not agreed to\b", r"not amenable to\b", r"not available\b", r"non[- ]diabetic\b", r"non[- ]pregnant\b",
    r"non[- ]smoker\b", r"non[- ]lactating\b", r"asymptomatic\b", r"symptom[- ]free\b",
)
NEGATIVE_ENTITY = (
    r"not\b", r"without\b", r"unable to\b", r"inability to\b", r"unability to\b", r"unwilling\b", r"unwillingness\b", r"lack of\b", r"failure to\b",
    r"failed to\b", r"can not\b", r"cannot\b", r"not amenable to\b", r"not controlled\b", r"not recovered\b", r"asymptomatic\b", r"symptom[- ]free\b",
    r"non[- ]diabetic\b", r"non[- ]pregnant\b", r"non[- ]smoker\b", r"non[- ]lactating\b",
)
CONDITIONAL_CLAUSE = r"\b(if|unless|except|provided that|only if|if applicable)\b"


def clause_facts(d: Spark) -> list[tuple[str, str]]:
    """What the clause and the entity say, for the consistency codes (columns clause_text, item_text, clause_type, clause_negated, and the token sets)."""
    clause, item, ev = (text.lower_norm(d, x) for x in ("clause_text", "item_text", "evidence_text"))
    kind = "lower(coalesce(clause_type, ''))"
    share = lambda of: text.recall_of(d, "ev_clause", of)
    return [
        ("evidence_found", f"({ev} <> '' AND (contains({clause}, {ev}) OR contains({item}, {ev})) OR greatest({share('cl_clause')}, {share('it_clause')}) >= 0.7)"),
        ("negative_clause", f"(coalesce(clause_negated, false) OR contains({kind}, 'negation') OR {kind} = 'negative' OR {d.like(clause, chr(92) + 'b(' + '|'.join(NEGATIVE_CLAUSE) + ')')})"),
        ("negative_entity", d.like(text.lower_norm(d, "entity_text"), r"\b(" + "|".join(NEGATIVE_ENTITY) + ")")),
        ("conditional_clause", f"(contains({kind}, 'exception') OR contains({kind}, 'condition') OR {d.like(clause, CONDITIONAL_CLAUSE)})"),
        ("context_handled", f"({text.blank(d, 'cond_text', '<>')} OR {text.blank(d, 'exc_text', '<>')})"),
    ]


def consistency_codes(d: Spark) -> list[tuple[str, str]]:
    """codes_1d: the leaf against its clause, from ``clause_facts``; without a clause that is the only code."""
    operator = lambda x: f"coalesce(operator = '{x}', false)"
    computable = "coalesce(computability = 'computable', false)"
    tests = [
        ("evidence_text_not_substring_of_pass1_source_text", "NOT evidence_found"),
        ("negation_clause_with_exists_operator", f"negative_clause AND {operator('exists')} AND NOT negative_entity"),
        ("positive_clause_with_not_exists_operator", f"NOT negative_clause AND {operator('not_exists')}"),
        ("negative_entity_with_not_exists_operator", f"negative_clause AND {operator('not_exists')} AND negative_entity"),
        ("exception_or_condition_clause_without_context_handling", "conditional_clause AND NOT context_handled"),
        ("exception_or_condition_clause_with_computable_status", f"conditional_clause AND NOT context_handled AND {computable}"),
        ("exception_clause_computable_despite_context", f"conditional_clause AND context_handled AND {computable}"),
    ]
    return flagged(d, "codes_1d", tests, ("NOT has_clause", "pass2_leaf_without_pass1_clause"))


def _policy_counts(d: Spark, branch: str) -> list[tuple[str, str]]:
    """How many codes of each weight a leaf has; later columns look at the counts."""
    soft = SOFT_WARNINGS if branch == "b" else ()
    hard_c = tuple(x for x in WARNINGS if x not in soft)
    return [
        (f"hard_{branch}", f"({hits(d, 'codes_1a', HARD_STRUCTURAL)} + {hits(d, 'codes_1b', ('duplicate_criterion_id',))} + {hits(d, 'codes_1c', hard_c)} + {hits(d, 'codes_1d', CONSISTENCY)})"),
        (f"soft_{branch}", hits(d, "codes_1c", soft) if soft else "0"),
        (f"execution_{branch}", hits(d, "codes_1a", EXECUTION)),
        (f"safe_{branch}", hits(d, "codes_1a", SAFE_NORMAL)),
        (f"hard_codes_{branch}", f"concat_ws('|', nullif({held(d, 'codes_1a', HARD_STRUCTURAL)}, ''), nullif({held(d, 'codes_1c', hard_c)}, ''))"),
    ]


def _policy(branch: str) -> list[tuple[str, str]]:
    rows = [
        (f"hard_{branch} > 0", ("hard_or_semantic_layer1_issue", "high", "mandatory_rescue_or_review_candidate", 1.0), ("hard_semantic_or_structural_issue", "high", "mandatory_verifier_candidate", 1.0)),
        (f"execution_{branch} > 0", ("execution_or_computability_issue", "medium", "computability_review_candidate", 0.7), ("execution_or_computability_issue", "medium", "computability_review_candidate", 0.65)),
        (f"soft_{branch} > 0", None, ("soft_semantic_warning", "low_to_medium", "continue_to_layer2_grounding_screen", 0.4)),
        (f"safe_{branch} > 0", ("safe_normalization_only", "low", "safe_normalization_candidate", 0.2), ("safe_normalization_only", "low", "safe_normalization_candidate", 0.15)),
    ]
    at = 1 if branch == "a" else 2
    rows = [(r[0], r[at]) for r in rows if r[at]]
    last = ("no_layer1_issue", "none", "continue_to_layer2", 0.0)
    pick = lambda k, quote: choose([(t, quote(v[k])) for t, v in rows], quote(last[k]))
    words, number = (lambda v: f"'{v}'"), (lambda v: f"CAST({v} AS DOUBLE)")
    return [(f"bucket_{branch}", pick(0, words)), (f"severity_{branch}", pick(1, words)), (f"action_{branch}", pick(2, words)), (f"policy_score_{branch}", pick(3, number))]


def policy_counts_a(d: Spark) -> list[tuple[str, str]]:
    return _policy_counts(d, "a")


def policy_counts_b(d: Spark) -> list[tuple[str, str]]:
    return _policy_counts(d, "b")


def policy_a(d: Spark) -> list[tuple[str, str]]:
    """Branch A: every warning is hard."""
    return _policy("a")


def policy_b(d: Spark) -> list[tuple[str, str]]:
    """Branch B: four warnings are soft and only lower the score."""
    return _policy("b")
