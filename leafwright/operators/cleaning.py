"""Cleaning of tagged spans: broken fragments, junk, flags, and what a span can stand for.

Tests are SQL texts of columns label, text and score_min, for ``dialect.apply``; a text is
looked at with its white space collapsed (column ``t``).
"""

from __future__ import annotations

from ..plans.dialect import Spark, choose, one_of

# Labels of anchors and supports, and the least sure score.
ANCHOR_LABELS = ("Condition", "Drug", "Procedure", "Measurement", "Device")
SUPPORT_LABELS = ("Qualifier", "Value", "Temporal", "Negation", "Multiplier", "Mood", "Observation", "Scope", "Person", "Visit")
UNSURE, LONG = 0.60, 25
SIGNS = r"<=|>=|!=|(?<![<>=!])[<>=](?!=)"
COMPARING_WORDS = ("less than", "greater than", "at least", "or older", "or less")


def collapsed(d: Spark) -> list[tuple[str, str]]:
    return [("t", f"trim({d.replace('text', '[ \\t\\n\\r\\f]+', ' ')})")]


def broken(d: Spark) -> str:
    """A fragment: nothing, a bracket or slash left open at an end, or a short piece with half of a bracket."""
    return "(t = '' OR substr(t, -1) IN ('[', '/') OR substr(t, 1, 1) = ']' OR length(t) <= 6 AND (substr(t, -1) = ']' AND NOT contains(t, '[') OR substr(t, 1, 1) = '[' AND NOT contains(t, ']')))"


def comparisons(d: Spark) -> str:
    """How many signs and words of comparison a text holds; a sign of two characters is one, and one behind another sign none."""
    return f"regexp_count(lower(t), {d.text(SIGNS)}) + regexp_count(lower(t), {d.text(chr(92) + 'b(' + '|'.join(COMPARING_WORDS) + ')' + chr(92) + 'b')})"


def facts(d: Spark) -> list[tuple[str, str]]:
    return [
        ("is_broken", broken(d)),
        ("bracketed", "(contains(t, '(') OR contains(t, ')') OR contains(t, '[') OR contains(t, ']'))"),
        ("has_letter", d.like("t", r"\p{L}")),
        ("is_number", d.like("t", r"^\p{Nd}+$")),
    ]


def signs(d: Spark) -> list[tuple[str, str]]:
    return [("n_comparisons", comparisons(d))]


def classes(d: Spark) -> list[tuple[str, str]]:
    """nested_value, junk, qa_flags, and ``part``: anchor, support or other."""
    sized = lambda n: f"length(t) >= {n}"
    anchor = choose(
        [
            ("label = 'Condition'", f"NOT is_number AND {sized(2)} AND has_letter AND NOT is_broken"),
            ("label = 'Drug'", f"{sized(3)} AND has_letter"),
            ("label = 'Procedure'", f"has_letter AND {sized(4)} AND NOT is_broken"),
            ("label = 'Measurement'", "has_letter AND NOT is_broken"),
            ("label = 'Device'", sized(3)),
        ],
        "false",
    )
    value = f"({d.like('t', r'[\p{Nd}<>=≤≥]')} OR contains(lower(t), 'grade') OR contains(lower(t), 'negative') OR contains(lower(t), 'positive'))"
    support = f"{one_of('label', SUPPORT_LABELS)} AND t <> '' AND (label <> 'Value' OR {value})"
    flags = [("long_span", f"length(t) >= {LONG}"), ("bracketed_span", "bracketed"), ("multi_comparison", "n_comparisons >= 2"), ("low_score_min", f"coalesce(score_min < CAST({UNSURE} AS DOUBLE), false)"), ("single_token_base_label", "label IN ('Condition', 'Procedure', 'Measurement') AND t <> '' AND NOT contains(t, ' ')")]
    return [
        ("nested_value", "bracketed AND n_comparisons >= 2"),
        ("junk", "is_broken OR length(t) = 1 AND t NOT IN ('<', '>', '=') OR label IN ('Condition', 'Procedure', 'Measurement') AND is_number OR label = 'Measurement' AND NOT has_letter"),
        ("qa_flags", "concat_ws(';', " + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in flags) + ")"),
        ("part", f"CASE WHEN {anchor} THEN 'anchor' WHEN {support} THEN 'support' ELSE 'other' END"),
    ]


STEPS = (collapsed, facts, signs, classes)
