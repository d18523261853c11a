"""Tokens and tags: entities from annotations, BIO labels by a sweep, and the scores of two taggings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spans

# Labels that are left out.
DROPPED = ("Scope",)


def entities(annotations: DataFrame) -> DataFrame:
    """doc, span, a, b, label from (doc, span, label, offsets, n_chars): spans in pieces as one from their first to their last character.

    Pieces outside the text or without length do not count, nor do dropped labels; a missing label is Other.
    """
    valid = F.filter("offsets", lambda o: (F.size(o) == 2) & (o[0] >= 0) & (o[1] > o[0]) & (o[1] <= F.col("n_chars")))
    own = annotations.withColumn("label", F.coalesce("label", F.lit("Other"))).where(~F.col("label").isin(*DROPPED)).withColumn("valid", valid).where(F.size("valid") > 0)
    return own.select("doc", "span", F.array_min(F.transform("valid", lambda o: o[0])).alias("a"), F.array_max(F.transform("valid", lambda o: o[1])).alias("b"), "label")


def flat_entities(annotations: DataFrame) -> DataFrame:
    """Entities without those that lie in or overlap an earlier, longer one."""
    return spans.flat(entities(annotations))


def label_list(flat: DataFrame) -> DataFrame:
    """The tags in their order: O, then B and I of each label by name."""
    names = flat.agg(F.array_sort(F.collect_set("label")).alias("names"))
    tags = F.concat(F.array(F.lit("O")), F.flatten(F.transform("names", lambda n: F.array(F.concat(F.lit("B-"), n), F.concat(F.lit("I-"), n)))))
    return names.select(F.posexplode(tags).alias("id", "tag"))


def bio_labels(tokens: DataFrame, flat: DataFrame) -> DataFrame:
    """``tokens`` (doc, pos, a, b) with their tag: B where a token starts at an entity's start or one character behind, I elsewhere within it, O outside, null for special tokens (0, 0).

    Entities are apart from each other, so one sweep from the end of the document finds for
    each token the first entity that ends behind the token's start; no token meets all entities.
    """
    e = flat.select("doc", (F.col("b") - 1).alias("key"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("pos"), F.struct("a", "b", "label").alias("e"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))
    t = tokens.select("doc", F.col("a").alias("key"), F.lit(1).alias("kind"), F.col("pos").cast("long").alias("pos"), F.lit(None).cast(e.schema["e"].dataType).alias("e"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    sweep = Window.partitionBy("doc").orderBy(F.desc("key"), "kind", "pos").rowsBetween(Window.unboundedPreceding, 0)
    met = e.unionByName(t).withColumn("next", F.last("e", ignorenulls=True).over(sweep)).where("kind = 1")
    inside = F.col("next").isNotNull() & (F.col("next.a") < F.col("b"))
    starts = (F.col("a") >= F.col("next.a")) & (F.col("a") - F.col("next.a") <= 1)
    tag = F.when((F.col("a") == 0) & (F.col("b") == 0), None).when(inside, F.concat(F.when(starts, "B-").otherwise("I-"), F.col("next.label"))).otherwise("O")
    return met.select("doc", "pos", "a", "b", tag.alias("tag"))


def chunks(tokens: DataFrame, tag: str) -> DataFrame:
    """doc, label, first, last of the entities that tags spell: one starts at a B, at an I behind O, and where the label changes."""
    order = Window.partitionBy("doc").orderBy("pos")
    own = tokens.where(F.col(tag).isNotNull()).select("doc", "pos", F.col(tag).alias("tag")).withColumn("before", F.lag("tag").over(order))
    label = F.substr("tag", F.lit(3))
    starts = F.startswith("tag", F.lit("B-")) | F.coalesce(F.col("before") == "O", F.lit(True)) | (F.substr("before", F.lit(3)) != label)
    own = own.withColumn("label", label).withColumn("starts", (starts & (F.col("tag") != "O")).cast("int"))
    own = own.withColumn("run", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("tag <> 'O'")
    return own.groupBy("doc", "run").agg(F.min("label").alias("label"), F.min("pos").alias("first"), F.max("pos").alias("last")).drop("run")


def _ratio(n: Column, of: Column) -> Column:
    return F.when(of != 0, n / of).otherwise(F.lit(0.0))


def entity_scores(tokens: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """tp, predicted, gold, precision, recall, f1 of whole entities, and the share of tokens that are tagged alike; special tokens do not count."""
    own = tokens.where(F.col(truth).isNotNull())
    want, got = chunks(own, truth), chunks(own, guess)
    tp = want.join(got, ["doc", "label", "first", "last"]).agg(F.count("*").alias("tp"))
    counts = tp.crossJoin(got.agg(F.count("*").alias("predicted"))).crossJoin(want.agg(F.count("*").alias("gold")))  # one row each
    counts = counts.crossJoin(own.agg(_ratio(F.count_if(F.col(truth) == F.col(guess)), F.count("*")).alias("accuracy")))
    p, r = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("gold"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", _ratio(2.0 * F.col("tp"), F.col("predicted") + F.col("gold")))


def matthews(tokens: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """tokens and mcc: the multiclass correlation from one table of confusions; 0 where one side has a single class."""
    cells = tokens.where(F.col(truth).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").cast("double").alias("n"))
    row, column = Window.partitionBy("t"), Window.partitionBy("g")
    # Squares of margins: each cell of a margin adds its part of n times the margin.
    own = cells.withColumn("of_t", F.sum("n").over(row)).withColumn("of_g", F.sum("n").over(column))
    by_t = cells.groupBy(F.col("t").alias("c")).agg(F.sum("n").alias("t_n"))
    by_g = cells.groupBy(F.col("g").alias("c")).agg(F.sum("n").alias("g_n"))
    product = by_t.join(by_g, "c").agg(F.coalesce(F.sum(F.col("t_n") * F.col("g_n")), F.lit(0.0)).alias("tp_pk"))
    sums = own.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.when(F.col("t") == F.col("g"), F.col("n"))), F.lit(0.0)).alias("c"), F.coalesce(F.sum(F.col("n") * F.col("of_t")), F.lit(0.0)).alias("tt"), F.coalesce(F.sum(F.col("n") * F.col("of_g")), F.lit(0.0)).alias("gg"))
    below = F.sqrt((F.col("s") * F.col("s") - F.col("gg")) * (F.col("s") * F.col("s") - F.col("tt")))
    return sums.crossJoin(product).select(F.col("s").cast("long").alias("tokens"), F.when(below > 0, (F.col("c") * F.col("s") - F.col("tp_pk")) / below).otherwise(0.0).alias("mcc"))  # one row each
