"""Text normalisers, marker tests and the token-overlap measures."""

from __future__ import annotations

import re

from ..plans.dialect import Spark

# The stop words of the three recall measures, number words and units.
STOP_WORDS = (
    "a", "an", "the", "of", "with", "without", "and", "or", "to", "in", "on", "for", "by", "at", "from", "that", "which",
    "has", "have", "had", "is", "are", "be", "been", "patients", "patient", "subjects", "subject", "must",
)
STOP_WORDS_CLAUSE = (
    "a", "an", "the", "of", "with", "without", "and", "or", "to", "in", "on", "for", "by", "at", "from", "that", "which",
    "patients", "patient", "subjects", "subject", "must", "should", "be", "been", "are", "is",
)
STOP_WORDS_GROUNDING = (
    "a", "an", "the", "of", "with", "without", "and", "or", "to", "in", "on", "for", "by", "at", "from", "that", "which",
    "patients", "patient", "subjects", "subject", "participant", "participants", "must", "should", "be", "been", "are", "is", "have", "has", "had", "any",
)
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
DIGITS = rf"\b({'|'.join(DIGIT_WORDS)})\b"
SURFACE_MARKERS = ("count", "number", "volume", "diameter", "percentage", "percent", "grade", "class", "score", "regimen", "regimens", "lesion", "lesions", "stenosis", "age", "size", "cm", "mm", "ml", "fetuses", "x uln", "upper limit")
NORMALITY_MARKERS = ("normal", "abnormal", "elevated", "positive", "negative", "returned to normal", "level", "levels", "mg/dl", "ng/ml", "mmol/l", "x uln", "upper limit", "grade", "%")


def norm(d: Spark, x: str) -> str:
    plain = f"coalesce({x}, '')"
    own = d.replace(plain, '[ \\t\\n\\r\\f]+', ' ')
    # Most texts hold single spaces alone.
    return f"trim({d.passed(' OR '.join(f'contains({x}, {d.text(c)})' for c in _UNEVEN), own, plain) if x.isidentifier() else own})"


#: What makes white space uneven.
_UNEVEN = ("  ", "\t", "\n", "\r", "\f")


def blank(d: Spark, x: str, sign: str = "=") -> str:
    """Whether the normal form is empty (with ``<>``: is not)."""
    return f"trim(LEADING {d.text(' ' + ''.join(_UNEVEN[1:]))} FROM coalesce({x}, '')) {sign} ''" if type(d) is Spark else f"{norm(d, x)} {sign} ''"


#: Leaf texts whose lower-case normal form ``columns`` computes once for all later steps.
NORMALISED = ("evidence_text", "entity_text", "value_text")


#: The same for texts of the clause, which ``clause_columns`` normalises once they are joined.
OF_CLAUSE = ("clause_text", "item_text")


def clause_columns(d: Spark) -> list[tuple[str, str]]:
    # A clause is mostly the evidence itself.
    low = {x: f"lower({norm(d, x)})" for x in OF_CLAUSE}
    return [("low_clause_text", d.passed("NOT (clause_text <=> evidence_text)", low["clause_text"], lower_norm(d, "evidence_text"))), ("low_item_text", low["item_text"])]


def columns(d: Spark) -> list[tuple[str, str]]:
    return [(f"low_{x}", f"lower({norm(d, x)})") for x in NORMALISED]


def lower_norm(d: Spark, x: str) -> str:
    return f"low_{x}" if x in (*NORMALISED, *OF_CLAUSE) else f"lower({norm(d, x)})"


def any_marker(d: Spark, x: str, markers) -> str:
    """Phrases count anywhere, single words at word edges; one alternation."""
    parts = [re.escape(m).replace("\\ ", " ") if " " in m else rf"\b{re.escape(m)}\b" for m in markers]
    return d.like(lower_norm(d, x), "(" + "|".join(parts) + ")")


def duration(d: Spark, x: str) -> str:
    unit = "(hour|hours|day|days|week|weeks|month|months|year|years)"
    t = lower_norm(d, x)
    return d.both("(" + " OR ".join(f"contains({t}, '{u}')" for u in ("hour", "day", "week", "month", "year")) + ")", d.like(t, rf"\b(\d+(\.\d+)?|{'|'.join(NUMBER_WORDS)})\s*{unit}\b"))


def quantitative_surface(d: Spark, x: str) -> str:
    t = lower_norm(d, x)
    markers = SURFACE_MARKERS
    return f"({d.like(t, r'\b\d+(\.\d+)?\s*(cm|mm|ml|mg|kg|%)\b')} OR {d.like(t, r'\b\d+(\.\d+)?\s*x\s*(uln|upper limit)')} OR {any_marker(d, x, markers)})"


def normality(d: Spark, x: str) -> str:
    t = lower_norm(d, x)
    markers = NORMALITY_MARKERS
    return f"({any_marker(d, x, markers)} OR {d.like(t, r'(<=|>=|<|>|=)\s*\d')} OR {d.like(t, r'\b\d+(\.\d+)?\s*(mg/dl|ng/ml|mmol/l|x\s*uln|%)\b')})"


def token_set(d: Spark, x: str, keep: str = "[^a-z0-9]+", stop: tuple = STOP_WORDS, least: int = 2) -> str:
    test = f"length(t) >= {least}" + (f" AND t NOT IN ({', '.join(repr(w) for w in stop)})" if stop else "")
    return d.words(lower_norm(d, x), keep, test)


def recall_of(d: Spark, x: str, y: str) -> str:
    """Share of the tokens x that y has; 0 where x has none."""
    return f"CASE WHEN {d.size(x)} = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({d.size(d.common(x, y))} AS DOUBLE) / {d.size(x)} END"


def recall(d: Spark, a: str, b: str, **kind) -> str:
    """Share of a's tokens that b has; 0 where a has none."""
    return recall_of(d, token_set(d, a, **kind), token_set(d, b, **kind))


def jaccard_of(d: Spark, x: str, y: str, both_empty: float = 0.0) -> str:
    """Share of all tokens that both have; 0 where one has none."""
    common = d.size(d.common(x, y))
    return (
        f"CASE WHEN {d.size(x)} = 0 AND {d.size(y)} = 0 THEN CAST({both_empty} AS DOUBLE) WHEN {d.size(x)} = 0 OR {d.size(y)} = 0 THEN CAST(0 AS DOUBLE) "
        f"ELSE CAST({common} AS DOUBLE) / ({d.size(x)} + {d.size(y)} - {common}) END"
    )


def jaccard(d: Spark, a: str, b: str, both_empty: float = 0.0, keep: str = "[^a-z0-9+-]+") -> str:
    return jaccard_of(d, *(token_set(d, z, keep=keep, stop=(), least=1) for z in (a, b)), both_empty=both_empty)


GROUNDING = {"keep": "[^a-z0-9%<>=./+-]+", "stop": STOP_WORDS_GROUNDING}


def clinical(d: Spark, x: str) -> str:
    """Lower case, no thousand commas, signs of comparison and multiplication in ASCII, one space between what is left."""
    low = t = f"lower(coalesce({x}, ''))"
    t = d.replace(d.replace(t, r"(\d),(\d)", "$1$2"), r"(\d),(\d)", "$1$2")
    t = f"replace(replace(replace(replace(replace({t}, '×', 'x'), '≤', '<='), '≥', '>='), '–', '-'), '—', '-')"
    # White space is made alike below, so the normal form does where there is one.
    t = d.passed(odd(x), t, lower_norm(d, x) if x in (*NORMALISED, *OF_CLAUSE) else low)
    return f"trim({d.replace(t, '[^a-z0-9%<>=./+-]+', ' ')})"


def odd(x: str) -> str:
    """Whether a text holds a comma or a sign beyond ASCII; without them nothing is to be put in other signs."""
    return f"contains({x}, ',') OR octet_length({x}) <> length({x})"


def numeric_base(d: Spark, x: str) -> str:
    """Lower case, no thousand commas, no articles, signs of comparison and multiplication in ASCII."""
    low = t = f"lower(trim(coalesce({x}, '')))"
    t = d.replace(d.replace(t, r"(\d),(\d)", "$1$2"), r"(\d),(\d)", "$1$2")
    t = f"replace(replace(replace({d.replace(t, chr(92) + 'bthe' + chr(92) + 'b', ' ')}, '×', 'x'), '≤', '<='), '≥', '>=')"
    return d.passed(f"{odd(x)} OR contains(lower({x}), 'the')", t, low)


def numeric_words(d: Spark, t: str) -> str:
    """The numeric base with number words as digits and multiples of limits spaced alike; texts without such words pass by."""
    worded = t
    for k, w in enumerate(DIGIT_WORDS):
        worded = d.replace(worded, rf"\b{w}\b", str(k))
    own = t
    t = f"CASE WHEN {d.like(t, DIGITS)} THEN {worded} ELSE {t} END"
    t = d.passed(f"contains({own}, 'ln')" if own.isidentifier() else "true", d.replace(t, r"(\d)\s*x\s*(uln|lln)", "$1x $2"), t)
    return f"trim({d.replace(t, '[^a-z0-9%<>=./+-]+', ' ')})"


def numeric(d: Spark, x: str) -> str:
    """The clinical form with number words as digits, no articles and multiples of limits spaced alike."""
    return numeric_words(d, numeric_base(d, x))


#: Token sets that several rules look at: the text, and how it is cut.
TOKENS = {
    "ev_clause": ("evidence_text", {"stop": STOP_WORDS_CLAUSE}), "cl_clause": ("clause_text", {"stop": STOP_WORDS_CLAUSE}), "it_clause": ("item_text", {"stop": STOP_WORDS_CLAUSE}),
    "ev_ground": ("evidence_text", GROUNDING), "it_ground": ("item_text", GROUNDING), "en_ground": ("entity_text", GROUNDING), "un_ground": ("unit", GROUNDING),
}


def token_columns(d: Spark) -> list[tuple[str, str]]:
    """Each set once for all rules; an expression with a lambda is evaluated anew wherever it is written.

    The clause's sets are looked at only where the evidence does not stand in clause or item as it is; Spark makes those of branch B in ``ground_columns``.
    """
    ev, clause, item = (lower_norm(d, x) for x in ("evidence_text", "clause_text", "item_text"))
    apart = f"{ev} = '' OR NOT contains({clause}, {ev}) AND NOT contains({item}, {ev})"
    return [(name, d.wanted(apart, token_set(d, x, **kind))) for name, (x, kind) in TOKENS.items() if name.endswith("clause") or type(d) is not Spark]


def ground_columns(d: Spark) -> list[tuple[str, str]]:
    """The sets of branch B, where entity or unit are not found as they are (columns of ``layer2.numeric_b``); the oracle has them from ``token_columns``."""
    ev, item, ent = (lower_norm(d, x) for x in ("evidence_text", "item_text", "entity_text"))
    entity = f"NOT contains({ev}, {ent}) AND NOT contains({item}, {ent})"
    unit = "clinical_unit NOT IN ('', 'null', 'none', 'nan', 'count', 'number') AND NOT contains(clinical_ev, clinical_unit)"
    need = {"en_ground": entity, "un_ground": unit}
    return [(name, d.wanted(need.get(name, f"{entity} OR {unit}"), token_set(d, x, **kind))) for name, (x, kind) in TOKENS.items() if name.endswith("ground")] if type(d) is Spark else []
