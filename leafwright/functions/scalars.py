"""Small scalar forms: ids, numbers, labels, brackets, signals, span recovery."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a comparison signal, each with how often it may be counted.
COMPARISON_SIGNALS = (r"(>=|<=|≥|≤)", r"(?<![<>=])[<>](?!=)", r"\b(greater|less|more) than\b", r"\b(at least|at most|no more than|no less than)\b", r"\bbetween\b")
#: The eight marks a judge gives, 0 to 5.
JUDGE_MARKS = ("entity", "operator", "value", "unit", "temporal", "history", "context", "computability")


def item_and_clause(criterion_id: Column) -> tuple[Column, Column]:
    """What stands before and after the last underscore; both null without one."""
    clause = F.substring_index(criterion_id, "_", -1)
    split = criterion_id.contains("_")
    return F.when(split, F.substr(criterion_id, F.lit(1), F.length(criterion_id) - F.length(clause) - 1)), F.when(split, clause)


def clause_order(clause_id: Column) -> Column:
    """The trailing number; 999999 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(clause_id, r"(\d+)$", 1), F.lit("")).try_cast("long"), F.lit(999999))


def number_text(value: Column) -> Column:
    """5.0 as 5, 5.50 as 5.5; other texts as they are, trimmed."""
    text = F.trim(value)
    number = text.try_cast("double")
    return F.when(number.isNull(), text).when(number == F.floor(number), number.cast("long").cast("string")).otherwise(number.cast("string"))


def truth(value: Column) -> Column:
    """True for 1, true, yes, y and t; false for all else, null among it."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("1", "true", "yes", "y", "t"), F.lit(False))


def number_or(value: Column, default: float) -> Column:
    found = F.trim(value).try_cast("double")
    return F.when(found.isNull() | F.isnan(found), F.lit(default)).otherwise(found)


def clamped(value: Column, most: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(most), value))


def without_prefix(code: Column) -> Column:
    """What follows the first colon."""
    return F.regexp_replace(code, "^[^:]*:", "")


def balanced(value: Column) -> Column:
    """Whether round, square and curly brackets close in order; a stack folded over the brackets."""
    marks = F.filter(F.split(value, ""), lambda c: c.isin("(", ")", "[", "]", "{", "}"))
    opener = lambda c: F.translate(c, ")]}", "([{")
    step = lambda stack, c: F.when(stack == "!", stack).when(c.isin("(", "[", "{"), F.concat(stack, c)).when((stack != "") & (F.right(stack, F.lit(1)) == opener(c)), F.substr(stack, F.lit(1), F.length(stack) - 1)).otherwise("!")
    return F.aggregate(marks, F.lit(""), step) == ""


def comparison_signals(value: Column) -> Column:
    low = F.lower(value)
    return sum((F.regexp_count(low, F.lit(p)) for p in COMPARISON_SIGNALS), F.lit(0))


def recovered_span(item_start: str, item_text: str, evidence: str, entity: str) -> tuple[Column, Column, Column]:
    """Where a leaf's entity stands in its document, by way of its evidence in its item; else why it is not found."""
    find = lambda a, b: F.expr(f"CASE WHEN coalesce({b}, '') = '' THEN 0 ELSE locate(lower({b}), lower(coalesce({a}, ''))) END")
    first, second = find(item_text, evidence), find(evidence, entity)
    status = F.when(F.col(item_start).isNull(), "missing_item_start").when(first == 0, "evidence_not_in_item").when(second == 0, "span_not_recoverable").otherwise("entity_in_evidence")
    start = F.when(status == "entity_in_evidence", F.col(item_start) + first + second - 2)
    return start, start + F.length(entity), status


def judge_score(marks: dict[str, Column]) -> Column:
    """Mean of the marks that were given, each held to 0..5, 4 digits; null without any."""
    given = F.filter(F.array(*(F.when(marks[m].isNotNull(), clamped(marks[m], 5.0)) for m in JUDGE_MARKS if m in marks)), lambda x: x.isNotNull())
    return F.when(F.size(given) > 0, F.round(F.aggregate(given, F.lit(0.0), lambda a, x: a + x) / F.size(given), 4))
