"""Branch A extraction: operator, value, time, history and computability from clause text."""

from __future__ import annotations

from ..functions import text
from ..plans.dialect import Spark, choose

# Fixed values.
UNIT = r"(mg/dl|mg/kg/d|mg/kg|ml/min|cc/min|cells/mm\^3|mmhg|mm hg|meq/l|iu/l|u/l|seconds?|minutes?|hours?|months?|weeks?|years?|yrs?|days?|grade|mg|kg|g|ml|mm|cm|l|%|m\b)"
NON_COMPUTABLE = ("willing", "unwilling", "able to", "unable to", "informed consent", "noncompliance", "preclude study", "psychiatric illness that would preclude")
ANCHOR_WORDS = (("screening", "screening"), ("randomization", "randomization"), ("diagnosis", "diagnosis"), ("surgery", "surgery"), ("baseline", "baseline"), ("study start", "treatment_start"), ("treatment start", "treatment_start"), ("first dose", "treatment_start"))
HISTORY_WORDS = (("previously treated", "previously_treated"), ("prior treatment", "previously_treated"), ("history of", "prior"), ("stable dose", "stable_dose"), ("investigational", "investigational_use"), ("current", "current"))


# Number words, markers of criteria about conduct, and words that give an entity type.
NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
OPERATIONAL = ("preference", "willing", "unwilling", "able to", "unable to", "informed consent", "questionnaire", "follow-up appointment", "attend follow-up", "included in a study", "participate")
DRUG_WORDS = ("drug", "warfarin", "coumadin", "epothilone", "gemcitabine", "topotecan")
LAB_WORDS = ("grade", "ecog", "hemoglobin", "platelet", "creatinine", "bilirubin")
CONDITION_WORDS = ("stage", "metastases", "infection", "neuropathy", "diarrhea", "hiv", "malignancy", "tumor")


def clause_source(d: Spark) -> list[tuple[str, str]]:
    """The text that fields are read from: clause and evidence, in lower-case normal form."""
    return [("x_source", f"concat({text.lower_norm(d, 'clause_text')}, ' ', CASE WHEN low_evidence_text = '' THEN {text.lower_norm(d, 'clause_text')} ELSE low_evidence_text END)")]


def operator_of(d: Spark) -> list[tuple[str, str]]:
    """x_operator; strict comparators are tested first, as the rules prescribe."""
    like = lambda p: d.like("x_source", p)
    # A sign counts unless an equality or exclamation mark touches it; without lookaround, by its neighbours.
    rules = [
        (like(r"\bbetween\b"), "'between'"),
        (like(r"(^|[^!])>([^=]|$)|\babove\b|\bgreater than\b"), "'>'"),
        (like(r"(^|[^!])<([^=]|$)|\bbelow\b|\bless than\b"), "'<'"),
        (like(r"(^|[^<>=!])=([^=]|$)|\bequal to\b|\bequals\b"), "'='"),
        (like(r"(>=|at least|no less than|greater than or equal)"), "'>='"),
        (like(r"(<=|at most|no more than|less than or equal)"), "'<='"),
        (like(r"\bnot in\b"), "'not_in'"),
        (f"{like(r'\b(one of|any of|either)\b')} AND (contains(x_source, ',') OR contains(x_source, ' or '))", "'in'"),
        (f"coalesce(clause_negated, false) OR {like(r'\b(no|without|absence of|free of|negative for)\b')}", "'not_exists'"),
    ]
    return [("x_operator", choose(rules, "'exists'"))]


def between_of(d: Spark) -> list[tuple[str, str]]:
    """x_min, x_max and x_range_unit from either way to write a range."""
    number = r"\d+(?:\.\d+)?"
    unit = "(?:" + UNIT[1:]
    first = rf"\bbetween\s+({number})\s*({unit})?\s+and\s+({number})\s*({unit})?"
    second = rf"\bminimum\s+of\s+({number})\s*({unit})?.*?\bmaximum\s+of\s+({number})\s*({unit})?"
    get = lambda k: f"coalesce(nullif({d.extract('x_source', first, k)}, ''), nullif({d.extract('x_source', second, k)}, ''))"
    one = d.like("x_source", first)
    own = lambda k: f"CASE WHEN {one} THEN nullif({d.extract('x_source', first, k)}, '') ELSE nullif({d.extract('x_source', second, k)}, '') END"
    return [("x_min", own(1)), ("x_max", own(3)), ("x_range_unit", f"coalesce({own(4)}, {own(2)})")]


def number_of(d: Spark) -> list[tuple[str, str]]:
    """The first number, in digits or as a word, and its unit."""
    pattern = rf"(\d+(?:\.\d+)?|\b(?:{'|'.join(NUMBERS)})\b)\s*({'(?:' + UNIT[1:]})?"
    raw = d.extract("x_source", pattern, 1)
    words = " ".join(f"WHEN '{w}' THEN '{k + 1}'" for k, w in enumerate(NUMBERS))
    return [("x_number", f"nullif(CASE {raw} {words} ELSE {raw} END, '')"), ("x_number_unit", f"nullif({d.extract('x_source', pattern, 2)}, '')")]


def fields_of(d: Spark) -> list[tuple[str, str]]:
    """Value by operator, temporal and history context, contexts of conditions and exceptions, entity type and computability."""
    t = "x_source"
    like = lambda p: d.like(t, p)
    compared = "x_operator IN ('>', '>=', '<', '<=', '=', '!=')"
    limit = like(r"\b(above|greater than|below|less than)\s+(the\s+)?(uln|upper limit of normal)\b|\b(below|less than)\s+(the\s+)?lower limit of normal\b")
    within = r"\bwithin( the last)?\s+(\d+(\.\d+)?)\s+(day|week|month|year)s?\b"
    relation = choose([(like(within), "'within'"), (f"contains({t}, 'prior to') OR contains({t}, 'before')", "'before'"), *((f"contains({t}, '{w}')", f"'{w}'") for w in ("after", "since", "during"))], "NULL")
    any_of = lambda words: "(" + " OR ".join(f"contains({t}, '{m}')" for m in words) + ")"
    exception = lambda x: f"nullif({d.extract(x, r'\b((unless|except|with the exception of)\b.+)$', 1)}, '')"
    condition = lambda x: f"nullif({d.extract(x, r'^(if .+?)(,|$)', 1)}, '')"
    kind = choose(
        [
            (any_of(OPERATIONAL), "'other'"),
            (like(r"\b(ct|mri|scan|biopsy|surgery|transplant|therapy|treatment|chemoembolization)\b"), "'procedure'"),
            (any_of(DRUG_WORDS), "'drug'"),
            (like(r"\bage\b|\byears old\b|\bmale\b|\bfemale\b|\bpregnant\b|\blactating\b"), "'demographic'"),
            (any_of(LAB_WORDS), "'lab'"),
            (any_of(CONDITION_WORDS), "'condition'"),
        ],
        "'other'",
    )
    return [
        ("x_value_type", f"CASE WHEN x_operator = 'between' THEN 'range' WHEN {compared} AND ({limit} OR x_number IS NOT NULL) THEN 'scalar' ELSE 'null' END"),
        ("x_value", f"CASE WHEN {compared} THEN CASE WHEN {limit} THEN 'ULN' ELSE x_number END END"),
        ("x_unit", f"CASE WHEN x_operator = 'between' THEN x_range_unit WHEN {compared} AND NOT {limit} THEN x_number_unit END"),
        ("x_relation", relation),
        ("x_t_value", f"nullif({d.extract(t, within, 2)}, '')"),
        ("x_t_unit", f"nullif({d.extract(t, within, 4)}, '')"),
        ("x_anchor", f"CASE WHEN ({relation}) IS NULL THEN NULL ELSE {choose([(f'contains({t}, {chr(39)}{w}{chr(39)})', f'{chr(39)}{a}{chr(39)}') for w, a in ANCHOR_WORDS], chr(39) + 'baseline' + chr(39))} END"),
        ("x_history", choose([(f"contains({t}, '{w}')", f"'{h}'") for w, h in HISTORY_WORDS], "NULL")),
        ("x_exception", f"coalesce({exception('low_evidence_text')}, {exception('low_clause_text')}, {exception('low_item_text')})"),
        ("x_condition", f"coalesce({condition('low_evidence_text')}, {condition('low_clause_text')})"),
        ("x_type", kind),
        ("x_operational", any_of(OPERATIONAL)),
        ("x_computability", choose([(any_of(NON_COMPUTABLE), "'non_computable'"), (like(r"\b(unless|except)\b"), "'partial'"), ("entity_type = 'other' AND x_operator = 'exists'", "'partial'")], "'computable'")),
    ]


EXTRACTION = (clause_source, operator_of, between_of, number_of, fields_of)
