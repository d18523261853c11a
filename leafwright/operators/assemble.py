"""Rule trees put together: clauses with their leaves to item trees, items to documents, as JSON texts.

Items are (document_id, criterion_type, item_index, item_uid, clauses), clauses as ``clauses.with_ids`` makes
them; leaves are (item_uid, clause_id, leaf, ord) with the leaf as JSON text. A clause without a leaf gets one that
says so; of several leaves of a clause the last counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Why a leaf stands in for a missing one.
MISSING = "Missing Pass 2 leaf for this clause during rule-tree assembly."


def duplicate_items(rows: DataFrame) -> DataFrame:
    """item_uid and n of items that stand in a table of rows more than once, which none may."""
    return rows.groupBy("item_uid").agg(F.count("*").alias("n")).where("n > 1")


def _stand_in(item_uid: Column, clause: Column) -> Column:
    none = F.lit(None).cast("string")
    said = lambda x: F.coalesce(x, F.lit(""))
    hints = F.struct(*(none.alias(k) for k in ("source_modifier_text", "source_condition_text", "source_exception_context", "history_context_hint")))
    own = F.struct(
        F.concat(item_uid, F.lit("_"), clause["clause_id"]).alias("criterion_id"), F.lit("other").alias("entity_type"), said(clause["clause_text"]).alias("entity_text"), none.alias("normalized_concept"), F.lit("exists").alias("operator"),
        F.lit("null").alias("value_type"), none.alias("value"), none.alias("unit"), none.alias("temporal_context"), F.lit("partial").alias("computability"), F.lit(MISSING).alias("non_computable_reason"),
        said(clause["evidence_text"]).alias("evidence_text"), hints.alias("provenance"), none.alias("history_context"),
    )
    return F.to_json(own, {"ignoreNullFields": "false"})


def _group(operator: str, children: Column, more: Column | str = "") -> Column:
    tail = F.lit(more) if isinstance(more, str) else more
    return F.concat(F.lit('{"node_type":"group","group_operator":"' + operator + '","children":['), F.array_join(children, ","), F.lit("]"), tail, F.lit("}"))


def item_trees(items: DataFrame, leaves: DataFrame) -> DataFrame:
    """``items`` with ``tree``: a clause alone is its leaf; AND binds tighter than OR, and a missing connector parts like OR; with a quantifier all leaves lie under one OR group that carries the first one. Null without clauses."""
    last = leaves.groupBy("item_uid", "clause_id").agg(F.max_by("leaf", "ord").alias("leaf"))
    held = last.groupBy("item_uid").agg(F.map_from_entries(F.collect_list(F.struct("clause_id", "leaf"))).alias("held"))  # an item's clauses
    own = items.join(held, "item_uid", "left")
    leaf = lambda c: F.coalesce(F.try_element_at("held", c["clause_id"]), _stand_in(F.col("item_uid"), c))
    own = own.withColumn("nodes", F.transform("clauses", lambda c: F.struct(F.concat(F.lit('{"node_type":"criterion","criterion":'), leaf(c), F.lit("}")).alias("node"), c["connector_to_next"].alias("connector"))))

    def join_run(state: Column, x: Column) -> Column:
        """Runs as arrays; ``open`` tells whether the next node stays in the last one."""
        n = F.size(state["runs"])
        stays = F.concat(F.slice(state["runs"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(state["runs"], -1), F.array(x["node"]))))
        parts = F.concat(state["runs"], F.array(F.array(x["node"])))
        return F.struct(F.when(state["open"], stays).otherwise(parts).alias("runs"), x["connector"].eqNullSafe(F.lit("AND")).alias("open"))

    start = F.struct(F.array().cast("array<array<string>>").alias("runs"), F.lit(False).alias("open"))
    runs = F.aggregate("nodes", start, join_run, lambda s: s["runs"])
    parts = F.transform(runs, lambda r: F.when(F.size(r) == 1, r[0]).otherwise(_group("AND", r)))
    given = F.get(F.filter("clauses", lambda c: c["quantifier_type"].isNotNull()), F.lit(0))
    quantifier = F.concat(F.lit(',"group_quantifier":{"quantifier_type":"'), given["quantifier_type"], F.lit('","value":'), F.coalesce(given["quantifier_value"].cast("string"), F.lit("null")), F.lit("}"))
    own = own.withColumn("parts", parts)
    tree = (
        F.when(F.coalesce(F.size("clauses"), F.lit(0)) <= 0, None)
        .when(given.isNotNull(), _group("OR", F.transform("nodes", lambda x: x["node"]), quantifier))
        .when(F.size("parts") == 1, F.get("parts", F.lit(0)))
        .otherwise(_group("OR", F.col("parts")))
    )
    return own.withColumn("tree", tree).drop("held", "nodes", "parts")


def documents(trees: DataFrame) -> DataFrame:
    """document_id and doc: inclusion items under AND, exclusion items under OR, in the order of their index; one item stands alone, none is null."""
    own = trees.where("tree is not null").groupBy("document_id", "criterion_type").agg(F.array_sort(F.collect_list(F.struct("item_index", "item_uid", "tree"))).alias("items"))
    nodes = F.transform("items", lambda x: x["tree"])
    many = F.when(F.col("criterion_type") == "inclusion", _group("AND", nodes, ',"polarity":"include"')).otherwise(_group("OR", nodes, ',"polarity":"exclude"'))
    sections = own.withColumn("section", F.when(F.size("items") == 1, F.get(nodes, F.lit(0))).otherwise(many))
    of = lambda kind: F.coalesce(F.max(F.when(F.col("criterion_type") == kind, F.col("section"))), F.lit("null"))
    both = trees.select("document_id").distinct().join(sections, "document_id", "left").groupBy("document_id").agg(of("inclusion").alias("i"), of("exclusion").alias("e"))
    quoted = F.to_json(F.struct(F.col("document_id").alias("x")))
    name = F.substr(quoted, F.lit(6), F.char_length(quoted) - 6)
    return both.select("document_id", F.concat(F.lit('{"document_id":'), name, F.lit(',"rules_v3_ast":{"trial_id":'), name, F.lit(',"inclusion_criteria":'), "i", F.lit(',"exclusion_criteria":'), "e", F.lit("}}")).alias("doc"))
