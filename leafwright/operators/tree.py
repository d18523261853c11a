"""Rule trees: clauses to AND/OR trees, and trees back to leaves with their paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assemble(clauses: DataFrame) -> DataFrame:
    """One tree for each item, from (document_id, section, item_uid, item_index, ord, connector, criterion_id, negated).

    AND binds tighter: a clause stays in the run of the one before it if that
    one's connector is AND. A run of several clauses is an AND node, several
    runs an OR node, negation wraps the leaf.
    """
    w = Window.partitionBy("item_uid").orderBy("ord")
    new_run = F.when(F.lag("connector").over(w).eqNullSafe("AND"), 0).otherwise(1)
    runs = clauses.withColumn("new_run", new_run).withColumn("run", F.sum("new_run").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    leaf = F.struct(F.when(F.col("negated"), "NOT").otherwise("LEAF").alias("op"), "criterion_id", "ord")
    groups = runs.groupBy("document_id", "section", "item_uid", "item_index", "run").agg(F.array_sort(F.collect_list(F.struct("ord", leaf.alias("leaf")))).alias("own"))
    node = F.struct(F.when(F.size("own") > 1, "AND").otherwise("LEAF").alias("op"), F.transform("own", lambda x: x["leaf"]).alias("children"))
    items = groups.groupBy("document_id", "section", "item_uid", "item_index").agg(F.array_sort(F.collect_list(F.struct("run", node.alias("node")))).alias("runs"))
    return items.select("document_id", "section", "item_uid", "item_index", F.when(F.size("runs") > 1, "OR").otherwise("ALL").alias("op"), F.transform("runs", lambda x: x["node"]).alias("groups"))


def documents(items: DataFrame) -> DataFrame:
    """Items in document order, inclusion first, as one array for each document and section."""
    item = F.struct("item_index", "item_uid", "op", "groups")
    return items.groupBy("document_id", "section").agg(F.array_sort(F.collect_list(item)).alias("items"))


def walk(items: DataFrame) -> DataFrame:
    """The leaves of assembled items with their paths; single runs and single clauses leave no level."""
    groups = items.select("document_id", "section", "item_uid", "item_index", "op", F.posexplode("groups").alias("g", "node"))
    leaves = groups.select("*", F.posexplode("node.children").alias("c", "leaf"))
    path = F.concat(
        F.col("section"), F.lit("_criteria.children["), F.col("item_index"), F.lit("]"),
        F.when(F.col("op") == "OR", F.concat(F.lit(".children["), F.col("g"), F.lit("]"))).otherwise(""),
        F.when(F.col("node.op") == "AND", F.concat(F.lit(".children["), F.col("c"), F.lit("]"))).otherwise(""),
    )
    return leaves.select("document_id", "item_uid", F.col("leaf.criterion_id").alias("criterion_id"), (F.col("leaf.op") == "NOT").alias("negated"), path.alias("path"))
