"""Clauses of items: ids, sanity, places in the text, chains, and their audits.

Items are (item_uid, item_text, clauses) with clauses an array of structs in order:
clause_text, evidence_text, is_negated, connector_to_next, quantifier_type, quantifier_value. An
item's clauses are one array, so what goes from clause to clause is a fold within the row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


CLAUSE = "array<struct<clause_text:string,evidence_text:string,is_negated:boolean,connector_to_next:string,quantifier_type:string,quantifier_value:bigint>>"
# Words of items that are hard to split.
TRICKY = ("unless", "except", " if ", "must have", "including", "history of", "stable for", "at least", "at most", "exactly")


def criterion_type(source_id: str, default: str | None = None) -> Column:
    """inclusion or exclusion by the end of the id."""
    x = F.col(source_id)
    return F.when(F.endswith(x, F.lit("_inc")), "inclusion").when(F.endswith(x, F.lit("_exc")), "exclusion").otherwise(F.lit(default))


def with_ids(items: DataFrame) -> DataFrame:
    """Clauses with ``clause_id`` C1, C2, ..., the last connector as null."""
    last = F.size("clauses") - 1
    own = lambda c, i: F.struct(F.concat(F.lit("C"), (i + 1).cast("string")).alias("clause_id"), c["clause_text"].alias("clause_text"), c["evidence_text"].alias("evidence_text"), c["is_negated"].alias("is_negated"), F.when(i < last, c["connector_to_next"]).alias("connector_to_next"), c["quantifier_type"].alias("quantifier_type"), c["quantifier_value"].alias("quantifier_value"))
    return items.withColumn("clauses", F.transform("clauses", own))


def sanity(items: DataFrame) -> DataFrame:
    """``error``: the first thing wrong with an item's clauses, in this order, or null: none at all, a last connector, an empty evidence, evidence that is not in the item's text letter by letter."""
    evidence = lambda c: F.trim(F.coalesce(c["evidence_text"], F.lit("")))
    wrong = F.transform(
        "clauses",
        lambda c, i: F.when(evidence(c) == "", F.concat(F.lit("Clause "), (i + 1).cast("string"), F.lit(" has empty evidence_text."))).when(~F.contains(F.coalesce("item_text", F.lit("")), evidence(c)), F.concat(F.lit("Clause "), (i + 1).cast("string"), F.lit(" evidence_text is not an exact substring of item_text."))),
    )
    first = F.get(F.filter(wrong, lambda x: x.isNotNull()), F.lit(0))
    none = F.coalesce(F.size("clauses"), F.lit(0)) <= 0
    return items.withColumn("error", F.when(none, "No clauses returned.").when(F.element_at("clauses", -1)["connector_to_next"].isNotNull(), "Last clause must have connector_to_next = null.").otherwise(first))


def located(items: DataFrame) -> DataFrame:
    """``clauses`` with start and end: evidence behind the last find, clause text behind it, then both from the start; null if nowhere.

    The cursor moves to the end of what was found, so phrases that repeat get rising places.
    """
    own = F.coalesce("item_text", F.lit(""))

    def find(what: Column, behind: Column) -> Column:
        at = F.call_function("locate", what, own, behind + 1)
        return F.when((what != "") & (at > 0), F.struct((at - 1).alias("start"), (at - 1 + F.char_length(what)).alias("end")))

    def step(state: Column, c: Column) -> Column:
        zero = F.lit(0)
        found = F.coalesce(find(c["evidence_text"], state["cursor"]), find(c["clause_text"], state["cursor"]), find(c["evidence_text"], zero), find(c["clause_text"], zero))
        # The four searches are written once: what was found goes on as the element of an array of one.
        return F.element_at(F.transform(F.array(found), lambda f: F.struct(F.coalesce(f["end"], state["cursor"]).alias("cursor"), F.concat(state["found"], F.array(f)).alias("found"))), 1)

    start = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))
    places = F.aggregate("clauses", start, step, lambda s: s["found"])
    joined = F.zip_with("clauses", places, lambda c, f: c.withField("start", f["start"]).withField("end", f["end"]))
    return items.withColumn("clauses", joined)


def first_quantifier(items: DataFrame) -> DataFrame:
    """``quantifier``: the first one among an item's clauses, or null."""
    given = F.filter("clauses", lambda c: c["quantifier_type"].isNotNull())
    first = F.get(given, F.lit(0))
    return items.withColumn("quantifier", F.when(first.isNotNull(), F.struct(first["quantifier_type"].alias("quantifier_type"), first["quantifier_value"].alias("value"))))


def logic_chain(clauses: Column) -> Column:
    """``[AT_LEAST 2] NOT(C1: text) AND C2: ...``: clauses and their connectors in order."""

    def token(c: Column) -> Column:
        said = F.concat(c["clause_id"], F.lit(": "), F.trim(F.regexp_replace(F.coalesce(c["clause_text"], F.lit("")), r"(?U)\s+", " ")))
        said = F.when(F.coalesce(c["is_negated"], F.lit(False)), F.concat(F.lit("NOT("), said, F.lit(")"))).otherwise(said)
        return F.when(c["quantifier_type"].isNotNull(), F.concat(F.lit("["), c["quantifier_type"], F.lit(" "), F.coalesce(c["quantifier_value"].cast("string"), F.lit("None")), F.lit("] "), said)).otherwise(said)

    return F.concat_ws(" ", F.flatten(F.transform(clauses, lambda c: F.array(token(c), c["connector_to_next"]))))


def tricky(item_text: str) -> Column:
    """Items with one of the hard words or a full stop."""
    low = F.lower(F.coalesce(item_text, F.lit("")))
    return reduce(lambda found, w: found | low.contains(w), TRICKY, low.contains("."))


def audit(items: DataFrame) -> DataFrame:
    """One row of counts over items: with clauses, last connector null, plain words for connectors met by one, hard items, evidence that is not in its text."""
    low = F.lower(F.coalesce("item_text", F.lit("")))
    has = lambda word: F.exists("clauses", lambda c: c["connector_to_next"].eqNullSafe(F.lit(word)))
    some = F.coalesce(F.size("clauses"), F.lit(0)) > 0
    missed = F.size(F.filter("clauses", lambda c: (F.coalesce(c["evidence_text"], F.lit("")) != "") & ~F.contains(F.coalesce("item_text", F.lit("")), c["evidence_text"])))
    return items.agg(
        F.count("*").alias("items"), F.count_if(some).alias("with_clauses"), F.count_if(some & F.element_at("clauses", -1)["connector_to_next"].isNull()).alias("last_connector_null"),
        F.count_if(low.contains(" or ")).alias("say_or"), F.count_if(low.contains(" or ") & has("OR")).alias("say_or_with_or"), F.count_if(low.contains(" and ")).alias("say_and"), F.count_if(low.contains(" and ") & has("AND")).alias("say_and_with_and"),
        F.count_if(tricky("item_text")).alias("tricky"), F.coalesce(F.sum(F.when(some, missed)), F.lit(0)).alias("evidence_missing"),
    )


def bad_offsets(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (item_uid, start, end, ...) whose offsets do not fit their item's text."""
    sized = items.select("item_uid", F.char_length(F.coalesce("item_text", F.lit(""))).alias("n_chars"))
    found = candidates.where("start is not null and end is not null").join(sized, "item_uid")
    return found.where("start < 0 or end > n_chars or start >= end").drop("n_chars")
