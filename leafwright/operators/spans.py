"""Spans: containment and overlap with items, best anchors, de-duplication, and the sequential folds.

Offsets are half-open. Joins are on the document with a range condition, so a
document's spans meet its own items only. Merging is windows. The folds that depend on
order (suppression, flat selection, greedy matching) run in the JVM over one group of
overlapping spans at a time, as an array with the kept spans as state; most groups
are a single span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contained(spans: DataFrame, items: DataFrame) -> DataFrame:
    """Spans that lie within an item of their document, with offsets inside the item."""
    s, i = spans.alias("s"), items.alias("i")
    inside = (F.col("s.doc") == F.col("i.doc")) & (F.col("s.a") >= F.col("i.a")) & (F.col("s.b") <= F.col("i.b"))
    return s.join(i, inside).select("i.doc", "i.item", "s.span", (F.col("s.a") - F.col("i.a")).alias("a"), (F.col("s.b") - F.col("i.a")).alias("b"), "s.label", "s.score")


def overlapping(spans: DataFrame, items: DataFrame) -> DataFrame:
    """Spans that share at least one character with an item of their document, with the length shared."""
    s, i = spans.alias("s"), items.alias("i")
    shared = F.least("s.b", "i.b") - F.greatest("s.a", "i.a")
    return s.join(i, (F.col("s.doc") == F.col("i.doc")) & (F.col("s.a") < F.col("i.b")) & (F.col("i.a") < F.col("s.b"))).select("i.doc", "i.item", "s.span", shared.alias("shared"), "s.label", "s.score", (F.col("s.b") - F.col("s.a")).alias("size"))


def best_anchor(found: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """One span for each item: label rank, then overlap, score, length, then place."""
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv))[F.col("label")], F.lit(99))
    order = Window.partitionBy("doc", "item").orderBy(rank, F.desc("shared"), F.desc("score"), F.desc("size"), "span")
    return found.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def distinct_spans(spans: DataFrame) -> DataFrame:
    """Of spans with equal offsets and label the best scored, the first of equals."""
    order = Window.partitionBy("doc", "a", "b", "label").orderBy(F.desc("score"), "span")
    return spans.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def _shared(x: Column, y: Column) -> Column:
    """Characters that two spans share; not positive where they are apart."""
    return F.least(x["b"], y["b"]) - F.greatest(x["a"], y["a"])


def _kept(spans: DataFrame, keys: tuple[str, ...], order: list[Column], rival) -> DataFrame:
    """Spans in order, without those that a kept span rules out; within each group of overlapping spans of the keys."""
    row = F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)), *spans.columns)
    groups = clustered(spans, *keys).groupBy(*keys, "cluster").agg(F.array_sort(F.collect_list(row)).alias("own"))
    fold = lambda kept, x: F.when(F.exists(kept, lambda k: rival(k, x)), kept).otherwise(F.concat(kept, F.array(x)))
    kept = F.when(F.size("own") == 1, F.col("own")).otherwise(F.aggregate("own", F.slice("own", 1, 0), fold))
    return groups.select(F.explode(kept).alias("s")).select(*(F.col("s")[c].alias(c) for c in spans.columns))


def suppressed(spans: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Same-label spans by falling score and length; one that shares the threshold of the shorter with a kept one goes."""
    size = lambda x: x["b"] - x["a"]
    rival = lambda k, x: (_shared(k, x) > 0) & (_shared(k, x) >= threshold * F.least(size(k), size(x)))
    return _kept(spans, ("doc", "label"), [-F.col("score"), F.col("a") - F.col("b"), F.col("span")], rival)


def flat(spans: DataFrame) -> DataFrame:
    """Spans by start, longer first; one that lies in a kept one or overlaps it goes."""
    return _kept(spans, ("doc",), [F.col("a"), F.col("a") - F.col("b"), F.col("span")], lambda k, x: _shared(k, x) > 0)


def merged(spans: DataFrame, gap: int = 1) -> DataFrame:
    """Spans of one label that follow each other within ``gap`` characters become one, which is compared again with the next.

    A span joins the run before it if it has its label and starts at most ``gap``
    behind the furthest end of the run; offsets only grow, so windows say so.
    """
    order = Window.partitionBy("doc").orderBy("a", "b", "span")
    run = F.sum(F.when(F.lag("label").over(order).eqNullSafe(F.col("label")), 0).otherwise(1)).over(order)
    within = Window.partitionBy("doc", "run").orderBy("a", "b", "span")
    far = F.max("b").over(within.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(F.col("a") - F.col("far") <= gap, 0).otherwise(1)).over(within)
    placed = spans.withColumn("run", run).withColumn("far", far).withColumn("part", part)
    first = F.min_by("span", F.struct("a", "b", "span"))
    return placed.groupBy("doc", "run", "part").agg(first.alias("span"), F.min("a").alias("a"), F.max("b").alias("b"), F.min("label").alias("label"), F.min("score").alias("score")).drop("run", "part")


def greedy_match(sides: DataFrame, keys: tuple[str, ...] = ("doc",)) -> DataFrame:
    """doc, span, gold_span, shared of every prediction: in order it takes the free gold span that it overlaps most, the first of equals, or none.

    ``sides`` are spans with side 'gold' or 'pred'; ``keys`` keeps them apart, as by type.
    """
    row = F.struct("span", "a", "b")
    of = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, row)))
    groups = clustered(sides, *keys).groupBy(*keys, "cluster").agg(of("gold").alias("gold"), of("pred").alias("pred")).where(F.size("pred") > 0)

    def take(state: Column, p: Column) -> Column:
        free = F.transform("gold", lambda g, i: F.when((_shared(g, p) > 0) & ~F.array_contains(state["used"], i), F.struct(_shared(g, p).alias("shared"), (-i).alias("i"))))
        best = F.array_max(free)
        used = F.when(best.isNull(), state["used"]).otherwise(F.concat(state["used"], F.array(-best["i"])))
        pair = F.struct(p["span"].alias("span"), F.when(best.isNotNull(), F.get("gold", -best["i"])["span"]).alias("gold_span"), F.coalesce(best["shared"], F.lit(0).cast("long")).alias("shared"))
        return F.struct(used.alias("used"), F.concat(state["pairs"], F.array(pair)).alias("pairs"))

    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<span:bigint,gold_span:bigint,shared:bigint>>").alias("pairs"))
    pairs = F.aggregate("pred", start, take, lambda state: state["pairs"])
    return groups.select("doc", F.explode(pairs).alias("p")).select("doc", "p.*")


def clustered(spans: DataFrame, *keys: str) -> DataFrame:
    """``cluster`` numbers, within the keys, the groups of spans between which nothing overlaps."""
    order = Window.partitionBy(*keys).orderBy("a", "b", "span")
    far = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("far", far).withColumn("cluster", F.sum(F.when(F.col("a") < F.col("far"), 0).otherwise(1)).over(order)).drop("far")


def bio_spans(tokens: DataFrame) -> DataFrame:
    """Spans from BIO tags (doc, pos, a, b, tag, score): a B, or an I after another label, starts one; a first I is dropped."""
    w = Window.partitionBy("doc").orderBy("pos")
    label, before = F.substring("tag", 3, 100), F.lag("tag").over(w)
    starts = (F.col("tag").startswith("B-")) | (F.col("tag").startswith("I-") & before.isNotNull() & (F.coalesce(F.substring(before, 3, 100), F.lit("")) != label))
    orphan = F.col("tag").startswith("I-") & before.isNull()
    marked = tokens.withColumn("start", starts.cast("int")).withColumn("orphan", orphan).where("tag <> 'O'").where(~F.col("orphan"))
    run = F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("run", run).where("run > 0").groupBy("doc", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.first(label, ignorenulls=True).alias("label"), F.min("score").alias("score"))
