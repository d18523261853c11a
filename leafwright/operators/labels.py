"""Manual labels: their normal form, carrying them over, comparing branches, and the subset that is run first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.dialect import Spark, choose, one_of
from .rescue import CONSERVATIVE

# Words for no label, and exact forms; parts are looked at in this order, as one word holds another.
NO_LABEL = ("nan", "none", "null", "na", "n/a", "not_labeled", "unlabeled", "missing")
EXACT = {"correct": ("correct", "c", "ok"), "partial": ("partial", "partially_correct", "partially correct", "p"), "incorrect": ("incorrect", "wrong", "error", "i", "unsupported")}
PARTS = (("incorrect", ("incorrect", "wrong", "unsupported")), ("partial", ("partial",)), ("correct", ("correct",)))
SCORES = {"correct": 2, "partial": 1, "incorrect": 0}
# The stages that are run now, their groups, and the task that is only reviewed.
CONSERVATIVE_STAGE, BRANCH_B_STAGE = "P1_run_now_conservative_structural_recovery", "P1_run_now_branch_b_mandatory_judge"
GROUPS = {CONSERVATIVE_STAGE: "p1_conservative_structural_recovery", BRANCH_B_STAGE: "p1_branch_b_mandatory_llm_judge"}
DUPLICATE_TASK = "duplicate_prune_or_merge_judge"


def _clean(d: Spark, x: str) -> str:
    return f"trim({d.replace(f'coalesce({x}, {chr(39) * 2})', '[ \\t\\n\\r\\f]+', ' ')})"


def normal_label(d: Spark, x: str) -> str:
    """SQL of correct, partial, incorrect or null."""
    low = f"lower({_clean(d, x)})"
    rules = [(f"{low} = '' OR {one_of(low, NO_LABEL)}", "NULL")]
    rules += [(one_of(low, forms), f"'{name}'") for name, forms in EXACT.items()]
    rules += [("(" + " OR ".join(f"contains({low}, '{p}')" for p in parts) + ")", f"'{name}'") for name, parts in PARTS]
    return choose(rules, "NULL")


def copied(d: Spark, pre_leaf: str, post_leaf: str, label: str, issue: str, found: str) -> list[tuple[str, str]]:
    """post_label, post_issue and copy_status: an old label stands as long as the leaf's text does."""
    same = f"{_clean(d, pre_leaf)} = {_clean(d, post_leaf)}"
    given = f"{found} AND {same} AND {_clean(d, label)} <> ''"
    return [
        ("post_label", f"CASE WHEN {given} THEN {_clean(d, label)} ELSE '' END"),
        ("post_issue", f"CASE WHEN {given} THEN {_clean(d, issue)} ELSE '' END"),
        ("copy_status", choose([(f"NOT {found}", "'no_pre_row'"), (f"NOT ({same})", "'changed'"), (f"{_clean(d, label)} = ''", "'unchanged_but_old_label_missing'")], "'copied'")),
    ]


def compared(d: Spark, a: str, b: str) -> list[tuple[str, str]]:
    """b_vs_a and inferred_best of two normal labels."""
    score = lambda x: "CASE " + x + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SCORES.items()) + " END"
    none = f"{a} IS NULL OR {b} IS NULL"
    more, less = f"{score(b)} > {score(a)}", f"{score(b)} < {score(a)}"
    return [
        ("b_vs_a", choose([(none, "'unlabeled'"), (more, "'B_better_than_A'"), (less, "'B_worse_than_A'")], "'B_same_as_A'")),
        ("inferred_best", choose([(none, "''"), (f"{a} = 'incorrect' AND {b} = 'incorrect'", "'none'"), (less, "'A'"), (more, "'B'")], "'tie'")),
    ]


def chosen_label(d: Spark, branch: str, a: str, b: str) -> list[tuple[str, str]]:
    """The manual label of the branch that was chosen."""
    return [("chosen_label", f"CASE {branch} WHEN 'A' THEN {a} WHEN 'B' THEN {b} END")]


def shares(rows: DataFrame, what: str, none: tuple[str, ...] = ()) -> DataFrame:
    """value, n, of, percent (two digits) of a column's values, those of ``none`` and nulls left out."""
    own = rows.where(F.col(what).isNotNull() & ~F.col(what).isin(*none)) if none else rows.where(F.col(what).isNotNull())
    counts = own.groupBy(F.col(what).alias("value")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # a few values
    return counts.withColumn("of", total).withColumn("percent", F.round(100.0 * F.col("n") / F.col("of"), 2))


def run_first(candidates: DataFrame) -> DataFrame:
    """Candidates with selected_for_p1, p1_group, why not, review_only, and what is wrong with those selected.

    Columns in: candidate_id, run_stage, branch, rescue_task_type, conservative_issues. Duplicates are for review alone.
    """
    stage, task = F.trim(F.coalesce("run_stage", F.lit(""))), F.trim(F.coalesce("rescue_task_type", F.lit("")))
    ran, duplicate = stage.isin(*GROUPS), task == DUPLICATE_TASK
    cid = F.trim(F.coalesce("candidate_id", F.lit("")))
    wrong = lambda test, said: F.when(test, said)
    errors = F.array(
        wrong(cid == "", F.lit("missing_candidate_id")),
        wrong((stage == BRANCH_B_STAGE) & (F.col("branch") != "B"), F.concat(cid, F.lit(":branch_b_stage_but_branch_is_"), F.coalesce("branch", F.lit("")))),
        wrong((stage == CONSERVATIVE_STAGE) & (F.trim(F.coalesce("conservative_issues", F.lit(""))) == ""), F.concat(cid, F.lit(":conservative_stage_without_conservative_issues"))),
        wrong(duplicate, F.concat(cid, F.lit(":duplicate_task_should_be_review_only_not_executed"))),
    )
    group: Column = F.lit("")
    for name, own in GROUPS.items():
        group = F.when(stage == name, own).otherwise(group)
    return candidates.select(
        "*", ran.cast("int").alias("selected_for_p1"), group.alias("p1_group"), F.when(ran, "").otherwise(F.concat(F.lit("not_p1_run_stage:"), stage)).alias("not_selected_reason"),
        (ran & duplicate).cast("int").alias("review_only"), F.when(ran, F.array_join(F.array_sort(F.array_distinct(F.array_compact(errors))), ";")).otherwise("").alias("p1_errors"),
    )


def repeated(candidates: DataFrame) -> DataFrame:
    """branch, criterion_id, n of criteria that stand in the candidates more than once."""
    return candidates.groupBy("branch", "criterion_id").agg(F.count("*").alias("n")).where("n > 1")


def conservative_issues(codes_1a: str) -> Column:
    """The conservative structural issues among joined codes."""
    return F.array_join(F.array_sort(F.array_intersect(F.split(codes_1a, ";"), F.array(*(F.lit(c) for c, _ in CONSERVATIVE)))), ";")
