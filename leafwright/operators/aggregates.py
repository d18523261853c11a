"""Evaluation tables: confusion with totals, sweeps, variants, overlaps, micro scores, transitions, token shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABELS = ("correct", "partial", "incorrect")


def share(n: Column, of: Column, digits: int = 6) -> Column:
    """n / of, rounded; 0 where there is nothing."""
    return F.when(of > 0, F.round(n / of, digits)).otherwise(F.lit(0.0))


def confusion(rows: DataFrame, row: str, column: str, values: tuple[str, ...] = LABELS) -> DataFrame:
    """Counts by row and column value, with a column and a row of totals."""
    counted = rows.groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(v) for v in values), F.count("*").alias("All"))
    total = rows.agg(*(F.count_if(F.col(column) == v).alias(v) for v in values), F.count("*").alias("All")).select(F.lit("All").alias(row), *values, "All")
    return counted.unionByName(total)


def prioritised(rows: DataFrame, score: str, label: str, steps: range = range(40, 96, 5)) -> DataFrame:
    """For each threshold, what is below it: how many, how many errors, and the share of all errors. Scores are counted in millionths first."""
    error = F.col(label).isin("partial", "incorrect")
    by_score = rows.groupBy(F.round(F.col(score) * 1_000_000).cast("long").alias("m")).agg(F.count("*").alias("n"), F.count_if(error).alias("errors"), F.count_if(F.col(label) == "incorrect").alias("wrong"))
    each = by_score.select("*", F.explode(F.array(*(F.lit(t) for t in steps))).alias("percent"))
    below = F.col("m") < F.col("percent") * 10_000
    sums = each.groupBy("percent").agg(*(F.coalesce(F.sum(F.when(below, F.col(c))), F.lit(0)).alias(f"{c}_below") for c in ("n", "errors", "wrong")), F.sum("n").alias("n"), F.sum("errors").alias("errors"))
    return sums.select("percent", "n_below", "errors_below", "wrong_below", share(F.col("n_below"), F.col("n")).alias("coverage"), share(F.col("errors_below"), F.col("n_below")).alias("error_rate"), share(F.col("errors_below"), F.col("errors")).alias("error_recall"))


def by_variant(rows: DataFrame, variants: dict[str, str], label: str) -> DataFrame:
    """Errors by scoring variant and its risk label; each row counts once for each variant."""
    stacked = rows.select(label, F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.col(c).alias("risk")) for v, c in variants.items()))).alias("x")).select(label, "x.*")
    error = F.col(label).isin("partial", "incorrect")
    return stacked.groupBy("variant", "risk").agg(F.count("*").alias("n"), F.count_if(error).alias("errors")).withColumn("error_rate", share(F.col("errors"), F.col("n")))


def ranking_by_variant(rows: DataFrame, variants: dict[str, str], label: str) -> DataFrame:
    """variant, labelled, positives, auroc and average_precision of each variant's risk score; windows see one row for each distinct score."""
    stacked = rows.select(label, F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.round(F.col(c) * 1_000_000).cast("long").alias("m")) for v, c in variants.items()))).alias("x")).select(label, "x.*")
    scores = stacked.groupBy("variant", "m").agg(F.count("*").cast("double").alias("n"), F.count_if(F.col(label).isin("partial", "incorrect")).cast("double").alias("pos"))
    up = Window.partitionBy("variant").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("variant").orderBy(F.desc("m")).rowsBetween(Window.unboundedPreceding, 0)
    own = scores.withColumn("below", F.coalesce(F.sum("n").over(up), F.lit(0.0))).withColumn("tp", F.sum("pos").over(down)).withColumn("seen", F.sum("n").over(down))
    pos, all_ = F.sum("pos"), F.sum("n")
    ranks = F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2))
    auroc = F.when((pos > 0) & (all_ > pos), F.round((ranks - pos * (pos + 1) / 2) / (pos * (all_ - pos)), 9))
    precision = F.when(pos > 0, F.round(F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / pos, 9))
    return own.groupBy("variant").agg(all_.cast("long").alias("labelled"), pos.cast("long").alias("positives"), auroc.alias("auroc"), precision.alias("average_precision"))


def overlaps(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """How many rows two conditions share."""
    return rows.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_first"), F.count_if(~a & b).alias("only_second"), F.count_if(~a & ~b).alias("neither"))


def micro_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 (from the rounded two) at 4 digits, from sums of tp, predicted and gold."""
    sums = counts.agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("gold").alias("gold"))
    p, r = share(F.col("tp"), F.col("predicted"), 4), share(F.col("tp"), F.col("gold"), 4)
    scored = sums.withColumn("prec", p).withColumn("recall", r)
    return scored.withColumn("f1", F.when(F.col("prec") + F.col("recall") > 0, F.round(2 * F.col("prec") * F.col("recall") / (F.col("prec") + F.col("recall")), 4)).otherwise(0.0))


def transitions(rows: DataFrame, pre: str, post: str, change: str, changed_only: bool = False) -> DataFrame:
    own = rows.where(F.col(change) != "")
    own = own.where(f"{change} <> 'same'") if changed_only else own
    return own.groupBy(F.concat_ws("_to_", pre, post).alias("transition"), F.col(change).alias("direction")).agg(F.count("*").alias("n"))


def token_shares(items: DataFrame, leaves: DataFrame, tokens: str) -> DataFrame:
    """An item's tokens shared evenly by its leaves."""
    per = leaves.groupBy("item_uid").agg(F.count("*").alias("n_leaves"))
    return leaves.join(items.join(per, "item_uid").select("item_uid", F.round(F.col(tokens) / F.col("n_leaves"), 6).alias("tokens_per_leaf")), "item_uid").select("item_uid", "key_id", "tokens_per_leaf")


def phase_deltas(pre: DataFrame, post: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Each metric before and after, and what it changed by; a metric of one side alone has no change."""
    both = pre.select(metric, F.col(value).alias("pre")).join(post.select(metric, F.col(value).alias("post")), metric, "full_outer")
    return both.withColumn("delta", F.round(F.col("post") - F.col("pre"), 6))


def summary(rows: DataFrame, column: str, digits: int = 2) -> DataFrame:
    """Mean and median of what is given; null without any."""
    return rows.agg(F.round(F.avg(column), digits).alias("mean"), F.round(F.median(column), digits).alias("median"), F.count(column).alias("n"))
