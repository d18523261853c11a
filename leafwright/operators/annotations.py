"""Annotated rows of the corpus: text, group id, which rows are kept, and their graph of nodes and edges.

Rows are (id, document_id, passages array of struct of text array, entities, relations); a passage's text may be in pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_text() -> Column:
    """The first passage's pieces joined by spaces, not stripped, so offsets hold; empty without a passage."""
    pieces = F.get("passages", F.lit(0))["text"]
    return F.coalesce(F.array_join(F.array_compact(pieces), " "), F.lit(""))


def group_id(number: str) -> Column:
    """The document's id, else the row's, else its number."""
    return F.coalesce(F.nullif(F.col("document_id"), F.lit("")), F.nullif(F.col("id"), F.lit("")), F.concat(F.lit("row_"), F.col(number)))


def valid_rows(rows: DataFrame) -> DataFrame:
    """id, document_id, text (stripped), n_entities, n_relations of rows that have all three."""
    own = rows.select("id", "document_id", F.trim(whole_text()).alias("text"), F.coalesce(F.size("entities"), F.lit(0)).alias("n_entities"), F.coalesce(F.size("relations"), F.lit(0)).alias("n_relations"))
    return own.where("text <> '' and n_entities > 0 and n_relations > 0")


def graph(rows: DataFrame) -> DataFrame:
    """id, document_id, nodes and edges; what an entity or relation lacks is empty."""
    none = lambda x: F.coalesce(x, F.array())
    node = lambda e: F.struct(e["id"].alias("id"), e["type"].alias("type"), none(e["text"]).alias("text"), F.coalesce(e["offsets"], F.array().cast("array<array<int>>")).alias("offsets"))
    edge = lambda r: F.struct(r["id"].alias("id"), r["type"].alias("type"), r["arg1_id"].alias("arg1_id"), r["arg2_id"].alias("arg2_id"))
    return rows.select("id", "document_id", F.transform("entities", node).alias("nodes"), F.transform("relations", edge).alias("edges"))


def edges_with_ends(graphs: DataFrame) -> DataFrame:
    """A row for each edge with the types of its two nodes; null where an end is not among the nodes."""
    kind = lambda end: F.try_element_at(F.map_from_entries(F.transform("nodes", lambda n: F.struct(n["id"], n["type"]))), end)
    return graphs.select("id", "document_id", "nodes", F.explode("edges").alias("e")).select("id", "document_id", F.col("e.id").alias("edge"), F.col("e.type").alias("type"), kind(F.col("e.arg1_id")).alias("from_type"), kind(F.col("e.arg2_id")).alias("to_type"))
