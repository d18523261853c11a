"""How far entities stand in their evidence and in the anchors of their clause: fourteen rates.

Leaves are (entity_text, entity_type, evidence_text, anchors, n_other) with anchors an array
of (text, label, score) in order and n_other the number of other candidates of the clause.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The entity type that a label stands for, and texts that say nothing.
TYPE_OF = {"Condition": "condition", "Drug": "drug", "Procedure": "procedure", "Measurement": "lab", "Device": "other"}
GENERIC = ("treated", "active", "suspected", "acute", "chronic", "history", "dose", "only", "stable", "severe", "uncontrolled", "unresolved")


def _low(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " ")))


def _tokens(x: Column) -> Column:
    return F.regexp_extract_all(_low(x), F.lit(r"([a-z0-9+\-]+)"), F.lit(1))


def best_anchor(anchors: str) -> Column:
    """By score, a missing one last, then by length of the text; the first of equals."""
    ranked = F.transform(anchors, lambda a, i: F.struct((-F.coalesce(a["score"], F.lit(-1.0))).alias("s"), (-F.char_length(F.coalesce(a["text"], F.lit("")))).alias("n"), i.alias("i"), a.alias("a")))
    return F.array_min(ranked)["a"]


def with_facts(leaves: DataFrame) -> DataFrame:
    own = leaves.withColumn("best", best_anchor("anchors")).withColumn("own_tokens", _tokens(F.col("entity_text")))
    meets = lambda text: F.arrays_overlap(F.col("own_tokens"), _tokens(text))
    kind = F.create_map(*(F.lit(x) for kv in TYPE_OF.items() for x in kv))[F.col("best.label")]
    entity = _low(F.col("entity_text"))
    return own.select(
        "*", (entity != "").alias("nonempty"), ((entity != "") & F.contains(_low(F.col("evidence_text")), entity)).alias("in_evidence"), (F.size("anchors") > 0).alias("anchored"),
        ((F.size("anchors") > 0) | (F.col("n_other") > 0)).alias("any_candidate"), F.exists("anchors", lambda a: meets(a["text"])).alias("meets_any"),
        F.coalesce(meets(F.col("best.text")), F.lit(False)).alias("meets_best"), F.coalesce(kind == F.col("entity_type"), F.lit(False)).alias("type_match"), entity.isin(*GENERIC).alias("generic"),
    )


def rates(leaves: DataFrame, *by: str) -> DataFrame:
    """The fourteen rates, four digits, null where there is nothing to divide by."""
    n, anchored = F.count("*"), F.count_if("anchored")
    rate = lambda test, of: F.when(of != 0, F.round(F.count_if(test) / of, 4))
    own = with_facts(leaves)
    return own.groupBy(*by).agg(
        n.alias("n"), rate(F.col("nonempty"), n).alias("entity_nonempty"), rate(F.col("in_evidence"), n).alias("entity_in_evidence"), rate(F.col("anchored"), n).alias("anchor_present"),
        rate(~F.col("anchored"), n).alias("no_anchor"), rate(F.col("any_candidate"), n).alias("any_candidate_present"), rate(~F.col("any_candidate"), n).alias("no_candidate"),
        rate(F.col("in_evidence") & F.col("anchored"), anchored).alias("in_evidence_when_anchored"), rate(F.col("in_evidence") & ~F.col("anchored"), n - anchored).alias("in_evidence_when_not_anchored"),
        rate(F.col("meets_any") & F.col("anchored"), anchored).alias("overlaps_any_when_anchored"), rate(F.col("meets_best") & F.col("anchored"), anchored).alias("overlaps_best_when_anchored"),
        rate(F.col("meets_any"), n).alias("overlaps_any"), rate(F.col("meets_best"), n).alias("overlaps_best"), rate(F.col("type_match"), anchored).alias("type_match_of_anchored"), rate(F.col("generic"), n).alias("generic_entity"),
    )
