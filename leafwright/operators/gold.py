"""Predicted spans against gold spans: one-to-one matches of four kinds, and their scores.

``sides`` are (doc, span, a, b, label, side) with side 'gold' or 'pred'. Only documents that
have both count. A prediction without offsets counts as one that matches nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spans

KINDS = ("exact_mention", "soft_mention", "exact_typed", "soft_typed")


def shared_documents(sides: DataFrame) -> DataFrame:
    both = sides.groupBy("doc").agg(F.count_if(F.col("side") == "gold").alias("g"), F.count_if(F.col("side") == "pred").alias("p")).where("g > 0 and p > 0").select("doc")
    return sides.join(both, "doc", "left_semi")


def exact_matches(sides: DataFrame, typed: bool) -> DataFrame:
    """Equal offsets: in order, the n-th prediction of an offset takes its n-th gold span, which is what one after the other comes to."""
    keys = ["doc", "a", "b", *(["label"] if typed else [])]
    placed = sides.where("a is not null and b is not null").withColumn("nth", F.row_number().over(Window.partitionBy("side", *keys).orderBy("span")))
    pred, gold = placed.where("side = 'pred'"), placed.where("side = 'gold'").withColumnRenamed("span", "gold_span")
    return pred.join(gold, [*keys, "nth"]).select("doc", "span", "gold_span", pred.label)


def soft_matches(sides: DataFrame, typed: bool) -> DataFrame:
    """Overlaps, each prediction in order with the free gold span that it overlaps most."""
    keys = ("doc", "label") if typed else ("doc",)
    found = spans.greedy_match(sides.where("a is not null and b is not null"), keys).where("gold_span is not null")
    return found.join(sides.where("side = 'pred'").select("doc", "span", "label"), ["doc", "span"]).select("doc", "span", "gold_span", "label")


def matches(sides: DataFrame) -> DataFrame:
    """kind, doc, span, gold_span, label of all pairs of the four kinds."""
    own = shared_documents(sides)
    found = {"exact_mention": exact_matches(own, False), "soft_mention": soft_matches(own, False), "exact_typed": exact_matches(own, True), "soft_typed": soft_matches(own, True)}
    return reduce(DataFrame.unionByName, (df.withColumn("kind", F.lit(kind)) for kind, df in found.items()))


def _rate(n: Column, of: Column) -> Column:
    return F.when(of != 0, F.round(n / of, 4))


def scores(sides: DataFrame) -> DataFrame:
    """kind, label ('all' or a type), tp, predicted, gold, precision, recall, f1: four decimals, f1 from the rounded ones, null where nothing can be divided."""
    own = shared_documents(sides)
    counted = own.groupBy("label").agg(F.count_if(F.col("side") == "pred").alias("predicted"), F.count_if(F.col("side") == "gold").alias("gold"))
    totals = counted.unionByName(counted.agg(F.lit("all").alias("label"), F.coalesce(F.sum("predicted"), F.lit(0)).alias("predicted"), F.coalesce(F.sum("gold"), F.lit(0)).alias("gold")))
    kinds = own.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    found = matches(sides).groupBy("kind", "label").agg(F.count("*").alias("tp"))
    whole = found.groupBy("kind").agg(F.lit("all").alias("label"), F.sum("tp").alias("tp"))
    # By type, spans of other types are out of sight, so both mention kinds are the typed ones.
    typed = found.where(F.col("kind").endswith("typed"))
    by_type = typed.unionByName(typed.withColumn("kind", F.replace("kind", F.lit("typed"), F.lit("mention"))))
    tp = whole.unionByName(by_type)
    all_rows = totals.join(F.broadcast(kinds), F.lit(True)).join(tp, ["kind", "label"], "left").fillna(0, ["tp"])  # four kinds
    rated = all_rows.withColumn("precision", _rate(F.col("tp"), F.col("predicted"))).withColumn("recall", _rate(F.col("tp"), F.col("gold")))
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", F.when(p + r != 0, F.round(2 * p * r / (p + r), 4))).select("kind", "label", "tp", "predicted", "gold", "precision", "recall", "f1")
