"""The judge and repair loop of branch B, replaying recorded verdicts and repairs.

A plan's leaf is judged first; one that passes is kept. Others are repaired at most three
times: a repair that is locally valid is judged too, the best so far is kept, and a plan
leaves the loop once its best is good enough. Each attempt works on the plans that are
still open and writes its table to the shared folder, under the name of the run: a run that
is started again goes on behind the last attempt that was completed.

Tables: plans (plan_id, criterion_id, rescue_task_type, leaf, context_text, a_leaf), verdicts (plan_id,
candidate_id, parse_status, parse_error, average_score, scores map, critical_errors array), repairs (plan_id, attempt,
abstain, leaf); leaves are JSON text. A plan without a verdict counts as not parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.dialect import apply
from ..sources import shared
from . import nested, rescue_apply

# What is judged, and the thresholds to keep, to select, and to be better by.
CRITERIA = ("semantic_completeness", "entity_grounding", "operator_value_correctness", "temporal_history_correctness", "polarity_negation_correctness", "computability_correctness", "fidelity_to_source", "non_hallucination")
KEEP, CANDIDATE, GAIN, ATTEMPTS = 4.5, 4.0, 0.25, 3
CONFIDENT = 4.75


def clamped(x: Column, default: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), default).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(5.0), x)))


def judgments(verdicts: DataFrame) -> DataFrame:
    """plan_id, candidate_id, score (0 to 5, the mean of the single scores where there is none) and critical (errors that say something)."""
    single = [clamped(F.try_element_at("scores", F.lit(k)), F.lit(0.0)) for k in CRITERIA]
    mean = sum(single[1:], single[0]) / len(CRITERIA)
    parsed = F.col("parse_status") == "ok"
    said = F.filter(F.transform(F.coalesce("critical_errors", F.array().cast("array<string>")), lambda e: F.trim(F.coalesce(e, F.lit("")))), lambda e: e != "")
    failed = F.array(F.concat(F.lit("judge_parse_failed:"), F.coalesce("parse_status", F.lit("None")), F.lit(":"), F.coalesce("parse_error", F.lit(""))))
    return verdicts.select("plan_id", "candidate_id", F.when(parsed, clamped(F.col("average_score"), mean)).otherwise(0.0).alias("score"), F.when(parsed, said).otherwise(failed).alias("critical"))


def local_reasons(m: str, source: str) -> str:
    """SQL of why a leaf (map of JSON texts) would not do, given the source text: its own rules, then grounding."""
    low = lambda x: f"lower(trim(regexp_replace(coalesce({x}, ''), '(?U)\\\\s+', ' ')))"
    plain = lambda k: low(rescue_apply._plain(rescue_apply._json(m, k)))
    entity, evidence, text = plain("entity_text"), plain("evidence_text"), low(source)
    ungrounded = f"{entity} <> '' AND {evidence} <> '' AND NOT contains({evidence}, {entity}) AND NOT contains({text}, {entity})"
    elsewhere = f"{evidence} <> '' AND {text} <> '' AND NOT contains({text}, {evidence})"
    own = rescue_apply.leaf_reasons(m)
    return f"concat_ws('|', nullif({own}, ''), CASE WHEN {ungrounded} THEN 'entity_text_not_in_source_context' END, CASE WHEN {elsewhere} THEN 'evidence_text_not_substring_of_source_context' END)"


def with_reasons(df: DataFrame, leaf: str, source: str, name: str) -> DataFrame:
    """``name``: reasons against a leaf (JSON text column), null if there is no leaf."""
    own = apply(df, lambda d: [("_m", nested.fields(f"try_parse_json({leaf})"))], lambda d: [(name, f"CASE WHEN {leaf} IS NOT NULL THEN CASE WHEN _m IS NULL THEN 'selected_leaf_not_object' ELSE {local_reasons('_m', source)} END END")])
    return own.drop("_m")


def source_text(plans: DataFrame) -> DataFrame:
    """``source``: the plan's context (evidence, clause, item) with the evidence of both leaves."""
    parts = [F.get_json_object(leaf, "$.evidence_text") for leaf in ("a_leaf", "leaf")]
    return plans.withColumn("source", F.concat_ws(" ", "context_text", *parts))


def run(plans: DataFrame, verdicts: DataFrame, repairs: DataFrame, name: str, attempts: int = ATTEMPTS, keep: float = KEEP, candidate: float = CANDIDATE, gain: float = GAIN) -> DataFrame:
    """A row for each plan: decision, source and leaf selected, scores, attempts used, reason, local validation."""
    place = f"{shared.shared_dir(plans.sparkSession)}/judge-{name}"
    judged = judgments(verdicts)
    none = F.array(F.lit("judge_parse_failed:missing:"))
    first = source_text(plans).join(judged.where("candidate_id = 'B_current'").drop("candidate_id"), "plan_id", "left")
    first = first.withColumn("original_score", F.coalesce("score", F.lit(0.0))).withColumn("critical", F.coalesce("critical", none))
    passed = (F.col("original_score") >= keep) & (F.size("critical") == 0)
    state = first.select("plan_id", "criterion_id", "rescue_task_type", F.col("leaf").alias("b_leaf"), "source", "original_score", F.lit("B_current").alias("best_source"), F.col("leaf").alias("best_leaf"), F.col("original_score").alias("best_score"), F.lit(0).alias("used"), F.lit(0).alias("generated"), passed.alias("done"))
    state = shared.once(state, f"{place}/0")
    closed = [state.where("done")]
    for k in range(1, max(0, min(ATTEMPTS, attempts)) + 1):
        state = shared.once(_attempt(state.where("not done"), judged, repairs, k, candidate, gain), f"{place}/{k}")
        closed.append(state.where("done"))
    closed.append(state.where("not done"))
    whole = closed[0]
    for part in closed[1:]:
        whole = whole.unionByName(part)
    return committed(whole, keep, candidate, gain)


def _attempt(open_: DataFrame, judged: DataFrame, repairs: DataFrame, k: int, candidate: float, gain: float) -> DataFrame:
    """The open plans after their k-th repair, if there is one that did not abstain and is an object."""
    said = F.lit(f"LLM_candidate_{k}")
    made = repairs.where((F.col("attempt") == k) & ~F.coalesce("abstain", F.lit(False))).select("plan_id", F.col("leaf").alias("new_leaf"))
    verdict = judged.where(F.col("candidate_id") == said).select("plan_id", F.col("score").alias("new_score"), F.col("critical").alias("new_critical"))
    own = open_.join(made, "plan_id", "left")
    # Ids stay those of the plan, and what a repair does not say is taken from the leaf it repairs.
    old, new = nested.fields("try_parse_json(b_leaf)"), nested.fields("try_parse_json(new_leaf)")
    own = apply(own, lambda d: [("_old", old), ("_new", new)], lambda d: [("_own", "CASE WHEN _new IS NOT NULL THEN map_concat(map_filter(_old, (k, v) -> k = 'criterion_id' OR NOT map_contains_key(_new, k)), map_filter(_new, (k, v) -> k <> 'criterion_id')) END")])
    own = apply(own, lambda d: [("candidate_leaf", f"CASE WHEN _own IS NOT NULL THEN {nested.as_json('_own')} END")]).drop("_old", "_new", "_own", "new_leaf")
    own = with_reasons(own, "candidate_leaf", "source", "reasons").join(verdict, "plan_id", "left")
    score = F.when(F.col("reasons") == "", F.coalesce("new_score", F.lit(0.0)))
    better = F.coalesce((score > F.col("best_score")) & (F.size("new_critical") == 0), F.lit(False))
    pick = lambda new, old: F.when(better, new).otherwise(F.col(old))
    own = own.select("plan_id", "criterion_id", "rescue_task_type", "b_leaf", "source", "original_score", pick(said, "best_source").alias("best_source"), pick(F.col("candidate_leaf"), "best_leaf").alias("best_leaf"), pick(F.col("new_score"), "best_score").alias("best_score"), F.lit(k).alias("used"), (F.col("generated") + F.col("candidate_leaf").isNotNull().cast("int")).alias("generated"))
    # A valid candidate ends the loop once the best is a repair, good enough and better by enough.
    enough = (F.col("best_source") != "B_current") & (F.col("best_score") >= candidate) & (F.col("best_score") - F.col("original_score") >= gain)
    return own.withColumn("done", enough)


def committed(state: DataFrame, keep: float = KEEP, candidate: float = CANDIDATE, gain: float = GAIN) -> DataFrame:
    """What the best of each plan comes to: kept, selected, or left to a person; a selected leaf that is not valid is left to a person too."""
    current = F.col("best_source") == "B_current"
    kept = current & (F.col("original_score") >= keep)
    chosen = ~current & (F.col("best_score") >= candidate) & (F.col("best_score") - F.col("original_score") >= gain)
    two = lambda x: F.format_string("%.2f", x)
    why_kept = F.concat(F.lit("B_current passed the judge threshold ("), two("original_score"), F.lit(f"/5 >= {keep:.2f}/5); kept unchanged."))
    why_chosen = F.concat(F.lit("B_current failed or was weaker ("), two("original_score"), F.lit("/5). The best generated candidate was "), F.col("best_source"), F.lit(" with score "), two("best_score"), F.lit(f"/5, improving by at least {gain:.2f}."))
    why_none = F.concat(F.lit("B_current did not pass and no generated candidate improved enough. Best="), F.col("best_source"), F.lit(" score "), two("best_score"), F.lit("/5; B_current score "), two("original_score"), F.lit("/5."))
    first = F.when(kept, "no_change").when(chosen, "select_candidate").otherwise("human_review")
    own = state.withColumn("first", first).withColumn("picked", F.when(F.col("first") != "human_review", F.col("best_leaf")))
    own = with_reasons(own, "picked", "source", "local_validation_reasons")
    failed = F.coalesce(F.col("local_validation_reasons") != "", F.lit(False))
    review = (F.col("first") == "human_review") | failed
    high = F.when(kept, F.col("original_score") >= CONFIDENT).otherwise(True)
    return own.select(
        "plan_id", F.lit("B").alias("branch_to_update"), "criterion_id", "rescue_task_type", F.when(failed, "human_review").otherwise(F.col("first")).alias("final_decision"),
        F.when(review, "none").otherwise(F.col("best_source")).alias("selected_source"), F.when(~review, F.col("picked")).alias("selected_leaf"),
        "original_score", "best_score", "used", "generated", F.when(review, "low").when(high, "high").otherwise("medium").alias("confidence"),
        F.concat(F.when(F.col("first") == "no_change", why_kept).when(F.col("first") == "select_candidate", why_chosen).otherwise(why_none), F.when(failed, " Local validation failed after selection.").otherwise("")).alias("selection_reason"),
        F.when(F.col("first") == "human_review", "not_applicable").when(failed, "fail").otherwise("pass").alias("local_validation_status"), F.coalesce("local_validation_reasons", F.lit("")).alias("local_validation_reasons"),
    )


def token_use(traces: str) -> list[Column]:
    """calls, prompt, completion and total tokens of a JSON array of calls, however each is shaped; calls without a total do not count.

    ``traces`` names a text column; what is no array has no calls.
    """
    calls = F.expr(f"filter(coalesce(try_variant_get(try_parse_json({traces}), '$', 'array<variant>'), array()), t -> try_variant_get(t, '$.token_usage.total_tokens', 'bigint') IS NOT NULL)")
    total = lambda key: F.aggregate(calls, F.lit(0).cast("long"), lambda s, t: s + F.coalesce(F.call_function("try_variant_get", t, F.lit(f"$.token_usage.{key}"), F.lit("bigint")), F.lit(0).cast("long")))
    return [F.size(calls).alias("calls"), total("prompt_tokens").alias("prompt_tokens"), total("completion_tokens").alias("completion_tokens"), total("total_tokens").alias("total_tokens")]
