"""The anchor that names a clause's entity, and what is taken from it and from the supports.

Clauses are (clause_text, evidence_text, anchors, supports, others), all three arrays of structs of text, label,
score, start, end, in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which label goes first, with a comparison or a value in sight and without.
WITH_VALUE = ("Measurement", "Condition", "Drug", "Procedure", "Device")
WITHOUT_VALUE = ("Condition", "Drug", "Procedure", "Measurement", "Device")
COMPARISON = r"(<=|>=|(?<![<>=!])<(?!=)|(?<![<>=!])>(?!=)|(?<![<>=!])=(?![=])|\bbetween\b|\babove\b|\bbelow\b|\bless than\b|\bgreater than\b|\bat least\b|\bat most\b)"


def _low(x: Column) -> Column:
    return F.lower(collapsed(x))


def collapsed(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def _words(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit("([a-zA-Z0-9]+)"), F.lit(1)))


def overlap_count(a: Column, b: Column) -> Column:
    """How many different words two lower-case texts share."""
    return F.size(F.array_intersect(_words(a), _words(b)))


def _place(label: Column, order: tuple[str, ...]) -> Column:
    at = F.array_position(F.array(*map(F.lit, order)), label)
    return F.when(at > 0, at - 1).otherwise(9)


def with_anchor(clauses: DataFrame) -> DataFrame:
    """``anchor``: by label, whether its text stands in the clause, in the evidence, words shared with the clause, score, length; the first of equals. Without anchors, others of a known label stand in; null if there are none."""
    own = clauses.withColumn("_clause", _low(F.col("clause_text"))).withColumn("_evidence", _low(F.col("evidence_text")))
    valued = F.rlike(F.concat_ws(" ", "_clause", "_evidence"), F.lit(COMPARISON)) | F.exists("supports", lambda s: F.coalesce(s["label"] == "Value", F.lit(False)))
    own = own.withColumn("_valued", F.coalesce(valued, F.lit(False)))

    def ranked(a: Column, i: Column) -> Column:
        text = _low(a["text"])
        stands = lambda where: F.when((text != "") & F.contains(F.col(where), text), 0).otherwise(1)
        label = F.when(F.col("_valued"), _place(a["label"], WITH_VALUE)).otherwise(_place(a["label"], WITHOUT_VALUE))
        size = F.coalesce(a["end"], F.lit(0)) - F.coalesce(a["start"], F.lit(0))
        return F.struct(label.alias("k1"), stands("_clause").alias("k2"), stands("_evidence").alias("k3"), (-overlap_count(text, F.col("_clause"))).alias("k4"), (-F.coalesce(a["score"].cast("double"), F.lit(-1.0))).alias("k5"), (-size).alias("k6"), i.alias("k7"), a.alias("anchor"))

    usable = F.when(F.size("anchors") > 0, F.col("anchors")).otherwise(F.filter("others", lambda a: a["label"].isin(*WITH_VALUE)))
    best = F.array_min(F.transform(usable, ranked))
    return own.withColumn("anchor", best["anchor"]).drop("_clause", "_evidence", "_valued")


def entity_text() -> Column:
    """The anchor's text, else the clause's, else the evidence, on one line."""
    own = collapsed(F.col("anchor.text"))
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(collapsed(F.col("clause_text")), F.lit("")), collapsed(F.col("evidence_text")))


def modifier_text() -> Column:
    """The clause's qualifiers, each once, or null."""
    texts = F.transform(F.filter("supports", lambda s: (s["label"] == "Qualifier") & (F.coalesce(s["text"], F.lit("")) != "")), lambda s: collapsed(s["text"]))
    return F.when(F.size(texts) > 0, F.array_join(F.array_distinct(texts), " | "))
