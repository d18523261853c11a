"""Joins between clauses, leaves of both branches, issues, scores, plans and labels.

All are on equality of keys, with one build row for each key: where several rows
share a key, a rule says which one counts, and where that is an error the join
says so in a column instead of dropping rows. No side is broadcast by hint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLAUSE = ["document_id", "item_uid", "clause_id"]


def _filled(x: str | Column) -> Column:
    """The trimmed text, null where it is empty."""
    return F.nullif(F.trim(F.col(x) if isinstance(x, str) else x), F.lit(""))


def items_with_entities(items: DataFrame, entities: DataFrame, key: str = "chia_id") -> DataFrame:
    """Items with the entity row of their key; ``entity_status`` is ok, missing, or duplicate where the build side repeats the key: then no row is taken."""
    built = entities.groupBy(key).agg(F.count("*").alias("entity_rows"), *(F.when(F.count("*") == 1, F.any_value(c)).alias(c) for c in entities.columns if c != key))
    status = F.when(F.col("entity_rows").isNull(), "missing").when(F.col("entity_rows") > 1, "duplicate").otherwise("ok")
    return items.join(built, key, "left").withColumn("entity_status", status).drop("entity_rows")


def first_clauses(clauses: DataFrame, order: str = "ord") -> DataFrame:
    """One clause for each key, the first by ``order``, and how many there were."""
    rest = [c for c in clauses.columns if c not in CLAUSE]
    picked = clauses.groupBy(*CLAUSE).agg(F.min_by(F.struct(*rest), F.col(order)).alias("first"), F.count("*").alias("clause_count"))
    return picked.select(*CLAUSE, "clause_count", *(F.col("first")[c].alias(c) for c in rest))


def leaves_with_clause(leaves: DataFrame, clauses: DataFrame) -> DataFrame:
    """Leaves with their clause, if there is one; the first of duplicates counts and their number is kept."""
    return leaves.join(first_clauses(clauses), CLAUSE, "left").withColumn("has_clause", F.col("clause_count").isNotNull())


def clauses_without_leaf(clauses: DataFrame, leaves: DataFrame) -> DataFrame:
    return first_clauses(clauses).join(leaves.select(*CLAUSE).distinct(), CLAUSE, "left_anti")


def leaves_with_flags(leaves: DataFrame, flags: DataFrame) -> DataFrame:
    """Leaves with the sorted tree flags of their path; a flag row names several paths, joined by semicolons."""
    paths = flags.select("document_id", F.explode(F.split("paths", ";")).alias("path"), "issue_type").withColumn("path", F.trim("path")).where("path <> ''")
    per = paths.groupBy("document_id", "path").agg(F.concat_ws(";", F.array_sort(F.collect_set("issue_type"))).alias("tree_flags"))
    return leaves.join(per, ["document_id", "path"], "left").withColumn("tree_flags", F.coalesce("tree_flags", F.lit("")))


def leaves_with_issues(leaves: DataFrame, issues: DataFrame, keys: tuple = ("document_id", "criterion_id")) -> DataFrame:
    """Leaves with the sorted set of their issues (rows of semicolon-joined codes)."""
    each = issues.select(*keys, F.explode(F.split("codes", ";")).alias("code")).where("code <> ''")
    per = each.groupBy(*keys).agg(F.concat_ws(";", F.array_sort(F.collect_set("code"))).alias("issues"))
    return leaves.join(per, list(keys), "left").withColumn("issues", F.coalesce("issues", F.lit("")))


def leaves_with_context(leaves: DataFrame, context: DataFrame) -> DataFrame:
    """Leaves with their clause context by criterion; ``context_missing`` where there is none."""
    return leaves.join(context.withColumn("context_found", F.lit(True)), "criterion_id", "left").withColumn("context_missing", F.col("context_found").isNull()).drop("context_found")


def code_sources(sources: dict[str, DataFrame | None]) -> DataFrame:
    """criterion_id, codes and sources over the given layer-1 tables; a source may be absent."""
    parts = [t.select("criterion_id", F.explode(F.split("codes", ";")).alias("code"), F.lit(n).alias("source")).where("code <> ''") for n, t in sources.items() if t is not None]
    both = reduce(DataFrame.unionByName, parts)
    joined = lambda c: F.concat_ws(";", F.array_sort(F.collect_set(c)))
    return both.groupBy("criterion_id").agg(joined("code").alias("all_codes"), joined("source").alias("sources"))


def with_code_sources(leaves: DataFrame, sources: dict[str, DataFrame | None]) -> DataFrame:
    return leaves.join(code_sources(sources), "criterion_id", "left")


def safe_keys(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key names a leaf: not empty, and not a bare clause number, which many items share."""
    return rows.where(_filled(key).isNotNull() & ~F.col(key).rlike(r"^C\d+$"))


def agreement(b: DataFrame, a: DataFrame, key: str, share: Column) -> DataFrame:
    """Branch B leaves with four flags and their number of agreements with branch A, 0 to 5; ``share`` is the overlap of entity tokens.

    A's columns carry the prefix ``a_``. Texts agree if they are equal without case and outer space; two empty ones agree.
    """
    same = lambda f: (F.lower(F.trim(F.coalesce(F.col(f), F.lit("")))) == F.lower(F.trim(F.coalesce(F.col(f"a_{f}"), F.lit(""))))).cast("int")
    fields = ("entity_type", "operator", "value_text", "unit")
    found = F.col("a_found").isNotNull()
    both = b.join(a.select(F.col(key), F.lit(1).alias("a_found"), *(F.col(f).alias(f"a_{f}") for f in (*fields, "entity_text"))), key, "left")
    flags = [F.when(found, same(f)).alias(f"{f}_agrees") for f in fields]
    both = both.select("*", *flags, F.when(found, F.round(share, 6)).alias("entity_overlap"))
    total = reduce(lambda x, y: x + y, (F.col(f"{f}_agrees") for f in fields)) + F.when(F.col("entity_overlap") >= 0.5, 1).otherwise(0)
    return both.withColumn("agreement_n", F.when(found, total).otherwise(0)).drop("a_found")


def first_filled(layers: list[DataFrame], key: str, fields: list[str]) -> DataFrame:
    """One row for each key of the first table; each field from the first table that has it filled."""
    own = [t.select(F.col(key), *(F.col(f).alias(f"{f}_{k}") for f in fields)) for k, t in enumerate(layers)]
    joined = reduce(lambda x, y: x.join(y, key, "left"), own)
    return joined.select(key, *(F.coalesce(*(_filled(f"{f}_{k}") for k in range(len(layers)))).alias(f) for f in fields))


def last_by_key(rows: DataFrame, branch: str, accepted: tuple[str, ...], order: str = "ord") -> DataFrame:
    """The last row of each criterion among those of a branch, under any of its names or none."""
    own = rows.where(F.coalesce("branch", F.lit("")).isin("", *accepted) & _filled("criterion_id").isNotNull())
    rest = [c for c in own.columns if c not in ("criterion_id", "branch")]
    last = own.groupBy("criterion_id").agg(F.max_by(F.struct(*rest), F.col(order)).alias("last"))
    return last.select(F.lit(branch).alias("branch"), "criterion_id", *(F.col("last")[c].alias(c) for c in rest))


def matched(decisions: DataFrame, leaves: DataFrame, key: str = "criterion_id") -> DataFrame:
    return leaves.join(decisions, key)


def unmatched(decisions: DataFrame, leaves: DataFrame, key: str = "criterion_id") -> DataFrame:
    """Decisions without a leaf; a repair run wants none."""
    return decisions.join(leaves.select(key).distinct(), key, "left_anti")


def before_after(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Every key of either side: missing_before, missing_after, changed (with the fields) or same."""
    pre = before.select(F.col(key), F.lit(1).alias("pre"), *(F.col(f).alias(f"{f}_pre") for f in fields))
    post = after.select(F.col(key), F.lit(1).alias("post"), *(F.col(f).alias(f"{f}_post") for f in fields))
    changed = F.concat_ws(";", *(F.when(~F.col(f"{f}_pre").eqNullSafe(F.col(f"{f}_post")), F.lit(f)) for f in sorted(fields)))
    both = pre.join(post, key, "full_outer")
    status = F.when(F.col("pre").isNull(), "missing_before").when(F.col("post").isNull(), "missing_after").when(changed != "", "changed").otherwise("same")
    return both.select(key, status.alias("status"), F.when(F.col("pre").isNotNull() & F.col("post").isNotNull(), changed).otherwise("").alias("changed_fields"))


def plan_inputs(plan: DataFrame, a: DataFrame, b: DataFrame, context: DataFrame, key: str = "criterion_id") -> DataFrame:
    """Plan rows with what they need; ``status`` names the first part that is missing."""
    out = plan
    for name, side in (("a", a), ("b", b), ("context", context)):
        out = out.join(side.select(F.col(key), F.struct(*(c for c in side.columns if c != key)).alias(name)), key, "left")
    status = F.when(F.col("a").isNull(), "error:missing_a_leaf").when(F.col("b").isNull(), "error:missing_b_leaf").when(F.col("context").isNull(), "error:missing_context").otherwise("ok")
    return out.withColumn("status", status)


def substituted(plan_a: DataFrame, results_b: DataFrame, leaves_b: DataFrame, key: str = "criterion_id") -> DataFrame:
    """What branch A takes from branch B: B's result of the same run if it is valid, else B's leaf if no result is required, else review."""
    joined = plan_a.join(results_b.select(F.col(key), F.col("decision").alias("b_decision"), F.col("validation").alias("b_validation")), key, "left")
    joined = joined.join(leaves_b.select(F.col(key), F.lit(1).alias("b_leaf")), key, "left")
    valid = F.coalesce((F.col("b_decision") != "human_review") & (F.col("b_validation") == "pass"), F.lit(False))
    source = F.when(valid, "b_dejure_best").when(F.col("b_leaf").isNotNull() & ~F.col("needs_result"), "b_current").otherwise("human_review")
    return joined.select(key, source.alias("selected_source"))


def labelled_scores(scores: DataFrame, labels: DataFrame, key: str, label: str, order: str = "ord") -> DataFrame:
    """Scores with their first manual label, unlabelled ones dropped; ``unique_key`` tells whether the label's key is one to one."""
    per = labels.groupBy(key).agg(F.min_by(label, order).alias(label), F.count("*").alias("label_rows"))
    out = scores.join(per, key).where(_filled(label).isNotNull())
    return out.withColumn("unique_key", F.col("label_rows") == 1).drop("label_rows")


def grounding_with_labels(grounding: DataFrame, manual: DataFrame, label: str) -> DataFrame:
    """By criterion, or item and clause where a side has no criterion; clashing columns of the manual side get the prefix ``manual_file__``."""
    key = F.coalesce(_filled("criterion_id"), F.concat_ws("_", "item_uid", "clause_id"))
    renamed = [F.col(c).alias(f"manual_file__{c}") if c in grounding.columns else F.col(c) for c in manual.columns]
    right = manual.withColumn("join_key", key).select("join_key", *renamed)
    return grounding.withColumn("join_key", key).join(right, "join_key").where(_filled(label).isNotNull())


def both_branches(a: DataFrame, b: DataFrame, key: str = "criterion_id") -> DataFrame:
    """All criteria of either branch, with both final decisions."""
    left, right = a.select(F.col(key), F.col("decision").alias("decision_a")), b.select(F.col(key), F.col("decision").alias("decision_b"))
    return left.join(right, key, "full_outer")


def shared_documents(gold: DataFrame, predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gold and predicted nodes of the documents that both sides have."""
    both = gold.select("document_id").distinct().join(predictions.select("document_id").distinct(), "document_id")
    return gold.join(both, "document_id", "left_semi"), predictions.join(both, "document_id", "left_semi")


def with_earlier_labels(post: DataFrame, pre: DataFrame, label: str = "label") -> DataFrame:
    """Later labels with the first earlier one of the same item and clause, and how they compare."""
    first = pre.groupBy("item_uid", "clause_id").agg(F.min_by(label, "ord").alias("pre_label"))
    return post.join(first, ["item_uid", "clause_id"], "left").withColumn("change", label_change("pre_label", label))


def label_score(label: str | Column) -> Column:
    """correct 2, partial 1, incorrect 0; null for all else."""
    own = F.lower(F.trim(F.col(label) if isinstance(label, str) else label))
    return F.when(own == "correct", 2).when(own == "partial", 1).when(own == "incorrect", 0)


def label_change(pre: str, post: str) -> Column:
    a, b = label_score(pre), label_score(post)
    return F.when(a.isNull() | b.isNull(), "").when(b > a, "improved").when(b < a, "worsened").otherwise("same")


def plan_with_labels(plan: DataFrame, labels: DataFrame, label: str = "label", key: str = "criterion_id") -> DataFrame:
    """Plan rows with the first manual label of their criterion and whether that is an error."""
    window = Window.partitionBy(key).orderBy("ord")
    first = labels.withColumn("nth", F.row_number().over(window)).where("nth = 1").select(key, F.col(label).alias("manual_label"))
    return plan.join(first, key, "left").withColumn("manual_error", F.col("manual_label").isin("partial", "incorrect"))


def error_coverage(plan: DataFrame, labels: DataFrame, label: str = "label", key: str = "criterion_id") -> DataFrame:
    """How many labelled errors there are, and how many of them the plan holds."""
    per = labels.groupBy(key).agg(F.min_by(label, "ord").alias(label))
    held = per.join(plan.select(F.col(key), F.lit(1).alias("planned")).distinct(), key, "left")
    error = F.col(label).isin("partial", "incorrect")
    counted = held.where(_filled(label).isNotNull()).agg(F.count("*").alias("labelled"), F.count_if(error).alias("errors"), F.count_if(error & F.col("planned").isNotNull()).alias("errors_planned"))
    return counted.withColumn("recall", F.when(F.col("errors") > 0, F.round(F.col("errors_planned") / F.col("errors"), 6)).otherwise(0.0))


def group_summary(annotated: DataFrame, *by: str) -> DataFrame:
    """Rows with a plan and a manual label (null where there is none) by group: how many of each label, the share labelled and the share of errors among them, six digits."""
    label = F.col("manual_label")
    n, labelled = F.count("*"), F.count(label)
    return annotated.groupBy(*by).agg(
        n.alias("n"), labelled.alias("labelled"), *(F.count_if(label == x).alias(f"n_{x}") for x in ("correct", "partial", "incorrect")),
        F.round(labelled / n, 6).alias("label_coverage"), F.when(labelled > 0, F.round(F.count_if(label.isin("partial", "incorrect")) / labelled, 6)).alias("error_rate"),
    )
