"""Normal form of leaves that a language model wrote: nulls, temporal misuse, enumerations.

Columns in: operator, value_type, value_kind, value_text, unit, the t_* columns and
history_context as the model gave them; out: the same names with the prefix ``n_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.dialect import Spark, one_of
from .layer1 import ANCHORS, HISTORY, RELATIONS, UNITS


def real_null(x: str) -> str:
    """Null for the words null and none, and for empty text."""
    return f"CASE WHEN lower(trim({x})) IN ('null', 'none', '') THEN NULL ELSE {x} END"


def nulls(d: Spark) -> list[tuple[str, str]]:
    return [(f"w_{c}", real_null(c)) for c in ("value_text", "unit", "t_value", "t_unit", "t_anchor", "t_relation", "history_context", "non_computable_reason")]


def normal_leaf(d: Spark) -> list[tuple[str, str]]:
    """A temporal relation in place of an operator moves to the temporal context; invalid parts of contexts get their default."""
    misuse = one_of("operator", RELATIONS)
    given = "(w_t_relation IS NOT NULL OR w_t_value IS NOT NULL OR w_t_unit IS NOT NULL OR w_t_anchor IS NOT NULL)"
    moved = f"({misuse} AND NOT {given})"
    context = f"({given} OR {moved})"
    unit = f"(CASE WHEN {moved} THEN w_unit ELSE w_t_unit END)"
    return [
        ("n_operator", f"CASE WHEN {misuse} THEN 'exists' ELSE operator END"),
        ("n_value_type", f"CASE WHEN {misuse} THEN 'null' ELSE value_type END"),
        ("n_value_kind", f"CASE WHEN {misuse} OR w_value_text IS NULL AND value_kind IN ('string', 'number') THEN 'null' ELSE value_kind END"),
        ("n_value_text", f"CASE WHEN NOT {misuse} THEN w_value_text END"),
        ("n_unit", f"CASE WHEN NOT {misuse} THEN w_unit END"),
        ("n_t_relation", f"CASE WHEN {moved} THEN operator WHEN {given} THEN CASE WHEN {one_of('w_t_relation', RELATIONS)} THEN w_t_relation ELSE 'during' END END"),
        ("n_t_value", f"CASE WHEN {moved} THEN w_value_text ELSE w_t_value END"),
        ("n_t_unit", f"CASE WHEN {context} AND {one_of(unit, UNITS)} THEN {unit} END"),
        ("n_t_anchor", f"CASE WHEN {moved} THEN 'other' WHEN {given} THEN CASE WHEN {one_of('w_t_anchor', ANCHORS)} THEN w_t_anchor ELSE 'other' END END"),
        ("n_history", f"CASE WHEN w_history_context IS NULL OR {one_of('w_history_context', HISTORY)} THEN w_history_context ELSE 'other' END"),
    ]


def aligned(written: DataFrame, clauses: DataFrame) -> DataFrame:
    """The model's leaves beside the clauses they were asked for: one row for each item and clause of either side.

    ``status`` is ok, missing, unexpected or duplicate; ids and evidence come from the clause.
    """
    keys = ["item_uid", "clause_id"]
    per = written.groupBy(*keys).agg(F.count("*").alias("times"), F.first("operator").alias("operator"))
    both = clauses.select(*keys, "evidence_text", "ord").join(per, keys, "full_outer")
    status = F.when(F.col("ord").isNull(), "unexpected").when(F.col("times").isNull(), "missing").when(F.col("times") > 1, "duplicate").otherwise("ok")
    return both.select(*keys, F.concat_ws("_", *keys).alias("criterion_id"), "evidence_text", status.alias("status"), F.col("ord").cast("long").alias("clause_order"))
