"""The registered queries and their SQL.

Most queries are operator steps over the leaf table and a closing statement in
SQL that both engines read; ``{leaf}`` stands for the leaves with the steps'
columns. A closing statement may differ by engine where array functions do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import extract, layer1, layer2, layer3, spans, tree
from ..sources import adapters
from .dialect import DUCK, Spark, apply, flagged, render
from . import branches, evaluation, oracle, trees
from .leaves import leaves, leaves_sql, tables

_SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def context(d: Spark) -> list[tuple[str, str]]:
    """The clause a leaf came from, duplicate codes, and what rescue reported."""
    # A document is an order; by its key the rows lie together already.
    signature = "l_orderkey, item_uid, entity_type, lower(entity_text), operator, value_type, value_text, unit, t_relation"
    return [
        ("item_text", "CASE WHEN k % 54 = 9 THEN 'an unrelated item' ELSE concat(evidence_text, ' in this study') END"),
        ("clause_type", "CASE k % 29 WHEN 3 THEN 'negation' WHEN 5 THEN 'exception' ELSE 'simple' END"),
        ("clause_text", "CASE WHEN k % 27 = 9 THEN 'another sentence' ELSE evidence_text END"),
        ("clause_negated", "k % 11 = 3"),
        ("has_clause", "k % 61 <> 7"),
        *flagged(d, "codes_1b", [("duplicate_criterion_id", "criterion_id IS NOT NULL AND count(*) OVER (PARTITION BY l_orderkey, criterion_id) > 1"), ("duplicate_identical_leaf", f"count(*) OVER (PARTITION BY {signature}) > 1")]),
        ("rescue_decision", "CASE k % 12 WHEN 0 THEN 'human_review' WHEN 1 THEN 'no_change' WHEN 2 THEN 'select_candidate' END"),
        ("apply_status", "CASE WHEN k % 12 = 2 THEN CASE WHEN k % 24 = 2 THEN 'applied' ELSE 'skipped' END END"),
        ("skip_reason", "CASE WHEN k % 12 = 2 AND k % 24 <> 2 AND k % 5 <> 0 THEN CASE WHEN k % 5 = 1 THEN 'not_applicable_final_decision:no_change' ELSE 'no_selected_leaf' END END"),
        ("local_validation", "CASE WHEN k % 12 = 2 THEN CASE WHEN k % 72 = 2 THEN 'fail' ELSE 'pass' END END"),
        ("from_b", "k % 24 = 2"),
        ("b_decided", "k % 48 <> 26"),
    ]


CONTEXT = (context, text.clause_columns, text.token_columns)
LAYER1 = (*CONTEXT, layer1.structural_codes, layer1.source_warnings, layer1.action_hint, layer1.clause_facts, layer1.consistency_codes, layer1.policy_counts_a, layer1.policy_a, layer1.policy_counts_b, layer1.policy_b)
BRANCH_A = (*LAYER1, layer2.signals_a, layer2.scores_a, layer2.least_a, layer2.label_a)
SCREEN_B = (*BRANCH_A, layer2.numeric_b, text.ground_columns, layer2.marks_b, layer2.grounding_b, layer2.screen_b)
BRANCH_B = (*SCREEN_B, layer2.least_b, layer2.routing_b)
LAYER3 = (*BRANCH_B, layer2.reasons_a, layer2.reasons_b, layer3.said, layer3.named_tasks, layer3.decisions)
FINAL = (*LAYER3, layer3.forced_review, layer3.final_b, layer3.final_decisions, layer3.cross_branch)


def _leaf(name: str, steps: tuple, closing: str, duck: str | None = None) -> None:
    steps = (text.columns, *steps)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(closing, leaf=apply(leaves(spark, sf_dir), *steps, wanted=closing))

    _SPARK[name] = run
    ctes, last = render(leaves_sql(), *steps)
    _SQL[name] = f"{ctes} {(duck or closing).replace('{leaf}', last)}"


def _table(name: str, closing: str, *names: str, duck: str | None = None) -> None:
    """A statement over driver tables, each written ``{table}``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(closing, **tables(spark, sf_dir, *names))

    _SPARK[name] = run
    sql = duck or closing
    for n in names:
        sql = sql.replace("{" + n + "}", n)
    _SQL[name] = sql


# --- layer 1 -------------------------------------------------------------------
_leaf("structural_codes", (layer1.structural_codes, layer1.action_hint), "SELECT key_id, codes_1a, hint_1a FROM {leaf}")
_leaf("source_warnings", (layer1.source_warnings,), "SELECT key_id, codes_1c FROM {leaf}")
_leaf("consistency_codes", (*CONTEXT, layer1.clause_facts, layer1.consistency_codes), "SELECT key_id, codes_1d FROM {leaf}")
_leaf("duplicate_codes", (context,), "SELECT key_id, codes_1b FROM {leaf} WHERE codes_1b <> ''")
_leaf("duplicate_paths", (context,), "SELECT document_id, criterion_id, count(*) AS n, min(key_id) AS first_key, max(key_id) AS last_key FROM {leaf} WHERE criterion_id IS NOT NULL GROUP BY document_id, criterion_id HAVING count(*) > 1")
_leaf("missing_leaves", (context,), "SELECT c.key_id, c.clause_text FROM {leaf} AS c LEFT ANTI JOIN (SELECT key_id FROM {leaf} WHERE k % 61 <> 7) AS l ON c.key_id = l.key_id", "SELECT c.key_id, c.clause_text FROM {leaf} AS c ANTI JOIN (SELECT key_id FROM {leaf} WHERE k % 61 <> 7) AS l ON c.key_id = l.key_id")
_leaf("policy_a", LAYER1, "SELECT key_id, bucket_a, severity_a, action_a, policy_score_a, hard_a, execution_a, hard_codes_a FROM {leaf}")
_leaf("policy_b", LAYER1, "SELECT key_id, bucket_b, severity_b, action_b, policy_score_b, hard_b, soft_b, execution_b, hard_codes_b FROM {leaf}")
_leaf("policy_action_counts", LAYER1, "SELECT action_a, action_b, count(*) AS n, avg(policy_score_a) AS mean_a FROM {leaf} GROUP BY action_a, action_b")
_leaf("code_counts", LAYER1, "SELECT code, count(*) AS n FROM (SELECT explode(split(codes_1a, ';')) AS code FROM {leaf}) WHERE code <> '' GROUP BY code", "SELECT code, count(*) AS n FROM (SELECT unnest(string_split(codes_1a, ';')) AS code FROM {leaf}) WHERE code <> '' GROUP BY code")
_leaf(
    "complete_code_counts",
    LAYER1,
    f"SELECT d.code, coalesce(n, 0) AS n FROM (SELECT explode(array({', '.join(repr(c) for c in layer1.STRUCTURAL)})) AS code) AS d LEFT JOIN (SELECT code, count(*) AS n FROM (SELECT explode(split(codes_1a, ';')) AS code FROM {{leaf}}) GROUP BY code) AS c ON d.code = c.code",
    f"SELECT d.code, coalesce(n, 0) AS n FROM (SELECT unnest([{', '.join(repr(c) for c in layer1.STRUCTURAL)}]) AS code) AS d LEFT JOIN (SELECT code, count(*) AS n FROM (SELECT unnest(string_split(codes_1a, ';')) AS code FROM {{leaf}}) GROUP BY code) AS c ON d.code = c.code",
)
_leaf("top_codes", LAYER1, "SELECT code, count(*) AS n FROM (SELECT explode(split(codes_1c, ';')) AS code FROM {leaf}) WHERE code <> '' GROUP BY code ORDER BY n DESC, code LIMIT 5", "SELECT code, count(*) AS n FROM (SELECT unnest(string_split(codes_1c, ';')) AS code FROM {leaf}) WHERE code <> '' GROUP BY code ORDER BY n DESC, code LIMIT 5")
# --- layer 2 -------------------------------------------------------------------
_leaf("support_signals_a", (*CONTEXT, layer2.signals_a), "SELECT key_id, operator_category, entity_in_evidence, generic_entity, value_supported, value_in_evidence, temporal_marker, history_marker, condition_marker, exception_marker, quantitative_cue FROM {leaf}")
_leaf("scores_a", BRANCH_A, "SELECT key_id, entity_support, operator_value_support, quantitative_support, temporal_support, history_support, context_support, computability_support, layer1_support, leaf_support, risk_score, risk_label, bottlenecks FROM {leaf}")
_leaf("risk_by_operator_category", BRANCH_A, "SELECT operator_category, risk_label, count(*) AS n, avg(leaf_support) AS mean_support, min(leaf_support) AS least_support FROM {leaf} GROUP BY operator_category, risk_label")
_leaf("ablation", (*BRANCH_A, layer2.ablation), "SELECT key_id, signal_support, signal_label, severity_difference FROM {leaf}")
_leaf("ablation_crosstab", (*BRANCH_A, layer2.ablation), "SELECT risk_label, signal_label, count(*) AS n FROM {leaf} GROUP BY CUBE (risk_label, signal_label)")
_leaf("screen_b", BRANCH_B, "SELECT key_id, entity_b, value_b, unit_b, operator_value_b, quantitative_b, temporal_b, history_b, context_b, modifier_b, allowance_b, layer1_b, computability_b, execution_b_support FROM {leaf}")
_leaf("routing_b", BRANCH_B, "SELECT key_id, semantic_support, execution_support, semantic_label, execution_label, semantic_bottlenecks, routing, routing_reason FROM {leaf}")
_leaf("risk_reasons", LAYER3, "SELECT key_id, risk_reasons, semantic_reasons, execution_reasons FROM {leaf}")
_leaf("branch_agreement", BRANCH_B, "SELECT risk_label, semantic_label, routing, count(*) AS n FROM {leaf} GROUP BY risk_label, semantic_label, routing")
_leaf("component_summary", BRANCH_A, "SELECT criterion_type, round(avg(leaf_support), 6) AS mean_support, round(median(leaf_support), 6) AS median_support, min(leaf_support) AS least, max(leaf_support) AS most FROM {leaf} GROUP BY criterion_type")
# --- labels and metrics -----------------------------------------------------------
_WRONG = "(CASE WHEN manual_label = 'correct' THEN 0 ELSE 1 END)"
_leaf("error_by_label", BRANCH_A, f"SELECT risk_label, count(*) AS n, count(manual_label) AS labelled, sum(CASE WHEN manual_label IS NOT NULL THEN {_WRONG} ELSE 0 END) AS errors, CASE WHEN count(manual_label) = 0 THEN NULL ELSE round(CAST(sum(CASE WHEN manual_label IS NOT NULL THEN {_WRONG} ELSE 0 END) AS DOUBLE) / count(manual_label), 6) END AS error_rate FROM {{leaf}} GROUP BY risk_label")
_leaf("label_crosstab", BRANCH_A, "SELECT risk_label, sum(CASE WHEN manual_label = 'correct' THEN 1 ELSE 0 END) AS n_correct, sum(CASE WHEN manual_label = 'partial' THEN 1 ELSE 0 END) AS n_partial, sum(CASE WHEN manual_label = 'incorrect' THEN 1 ELSE 0 END) AS n_incorrect, count(*) AS n_all FROM {leaf} GROUP BY risk_label")
_leaf("grouped_error_rates", BRANCH_B, f"SELECT routing, entity_type, count(*) AS n, round(avg(CAST({_WRONG} AS DOUBLE)), 6) AS error_rate FROM {{leaf}} WHERE manual_label IS NOT NULL GROUP BY routing, entity_type")
_leaf("risk_coverage", BRANCH_A, f"SELECT policy, sum(CASE WHEN kept THEN n ELSE 0 END) AS accepted, sum(n) AS labelled, sum(CASE WHEN kept THEN errors ELSE 0 END) AS accepted_errors, sum(CASE WHEN kept THEN 0 ELSE errors END) AS deferred_errors FROM (SELECT policy, n, errors, policy = 'all' OR policy = 'not_review' AND risk_label <> 'review_priority' OR policy = 'high_only' AND risk_label = 'high_support_not_auto_accept' AS kept FROM (SELECT risk_label, count(*) AS n, sum({_WRONG}) AS errors FROM {{leaf}} WHERE manual_label IS NOT NULL GROUP BY risk_label) AS g JOIN (VALUES ('all'), ('not_review'), ('high_only')) AS p(policy) ON g.n > 0) AS x GROUP BY policy")
_leaf("threshold_sweep", BRANCH_A, f"SELECT t.step, sum(CASE WHEN g.millionths >= 500000 + 50000 * t.step THEN n ELSE 0 END) AS accepted, sum(CASE WHEN g.millionths >= 500000 + 50000 * t.step THEN errors ELSE 0 END) AS errors, sum(CASE WHEN g.millionths < 500000 + 50000 * t.step THEN errors ELSE 0 END) AS caught FROM (SELECT CAST(round(leaf_support * 1000000) AS BIGINT) AS millionths, count(*) AS n, sum({_WRONG}) AS errors FROM {{leaf}} WHERE manual_label IS NOT NULL GROUP BY CAST(round(leaf_support * 1000000) AS BIGINT)) AS g JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS t(step) ON g.n > 0 GROUP BY t.step")
# Scores are grouped first, so the windows run over distinct scores only.
_BY_SCORE = f"(SELECT risk_score, count(*) AS n, sum({_WRONG}) AS pos FROM {{leaf}} WHERE manual_label IS NOT NULL GROUP BY risk_score)"
_leaf("auroc", BRANCH_A, f"SELECT round((sum(pos * (below + (n + 1) / 2.0D)) - sum(pos) * (sum(pos) + 1) / 2.0D) / (sum(pos) * sum(n - pos)), 9) AS auroc, sum(pos) AS positives, sum(n) AS labelled FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY risk_score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {_BY_SCORE} AS g) AS w", f"SELECT round((sum(pos * (below + (n + 1) / 2)) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * sum(n - pos)), 9) AS auroc, sum(pos) AS positives, sum(n) AS labelled FROM (SELECT *, CAST(coalesce(sum(n) OVER (ORDER BY risk_score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS below FROM {_BY_SCORE} AS g) AS w")
_leaf("average_precision", BRANCH_A, f"SELECT round(sum(CAST(pos AS DOUBLE) * tp / seen) / sum(pos), 9) AS average_precision FROM (SELECT pos, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(n) OVER w AS DOUBLE) AS seen FROM {_BY_SCORE} AS g WINDOW w AS (ORDER BY risk_score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS x")
_leaf("binary_metrics", BRANCH_B, "SELECT tp, fp, tn, fn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 6) AS prec, round(CASE WHEN tp + fn = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS recall, round(CASE WHEN tn + fp = 0 THEN 0 ELSE CAST(tn AS DOUBLE) / (tn + fp) END, 6) AS specificity, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END, 6) AS f1 FROM (SELECT sum(CASE WHEN p AND w THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p AND NOT w THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN NOT p AND NOT w THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN NOT p AND w THEN 1 ELSE 0 END) AS fn FROM (SELECT routing = 'llm_verifier' AS p, manual_label <> 'correct' AS w FROM {leaf} WHERE manual_label IS NOT NULL) AS a) AS b")
_STRATUM = "CASE WHEN contains(evidence_text, 'unless') OR contains(evidence_text, 'except') THEN 'exception' WHEN k % 11 = 3 THEN 'negation' WHEN t_relation IS NOT NULL THEN 'temporal' WHEN computability = 'non_computable' THEN 'non_computable' ELSE 'simple' END"
_leaf("labels_by_stratum", (), f"SELECT stratum, count(*) AS n, sum(CASE WHEN manual_label = 'correct' THEN 1 ELSE 0 END) AS n_correct, sum(CASE WHEN manual_label = 'partial' THEN 1 ELSE 0 END) AS n_partial, sum(CASE WHEN manual_label = 'incorrect' THEN 1 ELSE 0 END) AS n_incorrect FROM (SELECT *, {_STRATUM} AS stratum FROM {{leaf}}) AS s WHERE manual_label IS NOT NULL GROUP BY stratum")
_leaf("label_transitions", FINAL, "SELECT concat(manual_label, '_to_', CASE chosen_decision WHEN 'accept' THEN 'correct' WHEN 'partial' THEN 'partial' ELSE 'incorrect' END) AS transition, count(*) AS n FROM {leaf} WHERE manual_label IS NOT NULL GROUP BY 1")
_leaf("document_structure", LAYER1, "SELECT document_id, count(*) AS leaves, sum(CASE WHEN codes_1a <> '' THEN 1 ELSE 0 END) AS with_issue, count(DISTINCT item_uid) AS items, count(DISTINCT criterion_id) AS ids, round(avg(CASE WHEN codes_1a = '' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS valid_rate FROM {leaf} GROUP BY document_id")
_leaf("branch_structure_summary", LAYER1, "SELECT count(*) AS documents, round(avg(valid_rate), 6) AS mean_valid_rate, sum(leaves) AS leaves FROM (SELECT document_id, CAST(count(*) AS BIGINT) AS leaves, avg(CASE WHEN codes_1a = '' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS valid_rate FROM {leaf} GROUP BY document_id) AS g")
_leaf("entity_grounding", (*CONTEXT, layer2.signals_a), "SELECT operator_category, count(*) AS n, sum(CASE WHEN entity_in_evidence THEN 1 ELSE 0 END) AS grounded, sum(CASE WHEN has_anchor THEN 1 ELSE 0 END) AS anchored, sum(CASE WHEN has_anchor AND anchor_type_match THEN 1 ELSE 0 END) AS typed, round(avg(CASE WHEN has_anchor THEN anchor_score END), 6) AS mean_anchor FROM {leaf} GROUP BY operator_category")
_leaf("token_burden", (), "SELECT item_uid, count(*) AS leaves, sum(length(evidence_text)) / 4.0D AS tokens_in, sum(length(entity_text)) / 4.0D AS tokens_out, count(*) * 25 AS tokens_cached, round(sum(length(evidence_text)) / 4.0D + 0.1D * 25 * count(*) + 8 * sum(length(entity_text)) / 4.0D, 6) AS burden, round(sum(length(evidence_text)) / 4.0D / count(*), 6) AS per_leaf FROM {leaf} GROUP BY item_uid", "SELECT item_uid, count(*) AS leaves, sum(length(evidence_text)) / 4 AS tokens_in, sum(length(entity_text)) / 4 AS tokens_out, count(*) * 25 AS tokens_cached, round(sum(length(evidence_text)) / 4 + 0.1 * 25 * count(*) + 8 * sum(length(entity_text)) / 4, 6) AS burden, round(sum(length(evidence_text)) / 4 / count(*), 6) AS per_leaf FROM {leaf} GROUP BY item_uid")
# --- layer 3 -------------------------------------------------------------------
_leaf("decisions", LAYER3, "SELECT key_id, decision_a, family_a, priority_a, changes_tree_a, task_a, decision_b, family_b, priority_b, changes_tree_b, task_b FROM {leaf}")
_leaf("decision_counts", LAYER3, "SELECT decision_a, decision_b, count(*) AS n FROM {leaf} GROUP BY decision_a, decision_b")
# The filter stays above the window: pushed below it would repeat every expression that leads to the family.
_leaf("rescue_queue", LAYER3, "SELECT key_id, priority_b, task_b, place FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY queued DESC, priority_b, key_id) AS place FROM (SELECT *, CASE WHEN family_b IN ('structural_repair', 'llm_rescue_or_review') THEN 1 ELSE 0 END AS queued FROM {leaf}) AS q) AS r WHERE queued = 1")
_leaf("safe_repairs", (*LAYER1, layer3.safe_repairs, layer3.repair_check), "SELECT key_id, repairs, new_value_kind, new_value_num, new_computability, new_reason, new_t_value, new_t_unit, changed_fields, forbidden_changes FROM {leaf} WHERE repairs <> ''")
_leaf("unrepaired_unchanged", (*LAYER1, layer3.safe_repairs, layer3.repair_check), "SELECT count(*) AS n, sum(CASE WHEN changed_fields <> '' THEN 1 ELSE 0 END) AS changed FROM {leaf} WHERE repairs = ''")
_leaf("final_decisions", FINAL, "SELECT key_id, final_a, rule_a, final_b, rule_b, chosen_branch, chosen_decision FROM {leaf}")
_leaf("final_reasons", FINAL, "SELECT key_id, final_reasons_a, final_reasons_b FROM {leaf}")
_leaf("cross_branch_summary", FINAL, "SELECT chosen_branch, chosen_decision, count(*) AS n FROM {leaf} GROUP BY chosen_branch, chosen_decision")
_leaf("review_sheet", (layer3.review_text,), "SELECT key_id, compact_leaf, concat('I', lpad(CAST(row_number() OVER (PARTITION BY document_id ORDER BY key_id) AS STRING), 5, '0')) AS review_id FROM {leaf}")


def _reverified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same layer-1 functions, over repaired leaves."""
    fixed = apply(leaves(spark, sf_dir), text.columns, *LAYER1, layer3.safe_repairs, wanted=f"codes_1a {' '.join(_NEW_FIELDS.values())}")
    for old, new in _NEW_FIELDS.items():
        fixed = fixed.withColumn(old, F.col(new))
    fixed = fixed.select(*leaves(spark, sf_dir).columns, F.col("codes_1a").alias("codes_before"))
    return apply(fixed, layer1.structural_codes).select("key_id", "codes_before", "codes_1a")


_NEW_FIELDS = {"value_kind": "new_value_kind", "computability": "new_computability", "non_computable_reason": "new_reason", "t_value": "new_t_value", "t_unit": "new_t_unit"}
_SPARK["reverified_after_repair"] = _reverified
_ctes, _last = render(leaves_sql(), text.columns, *LAYER1, layer3.safe_repairs)
_kept = "SELECT * EXCLUDE (codes_1a) REPLACE (" + ", ".join(f"{n} AS {o}" for o, n in _NEW_FIELDS.items()) + "), codes_1a AS codes_before"
_codes = ", ".join(f"{e} AS {n}" for n, e in layer1.structural_codes(DUCK))
_SQL["reverified_after_repair"] = f"{_ctes}, repaired AS ({_kept} FROM {_last}) SELECT key_id, codes_before, {_codes} FROM repaired"
# --- extraction and text -----------------------------------------------------------
_leaf("extracted_fields", (*CONTEXT, *extract.EXTRACTION), "SELECT key_id, x_operator, x_value_type, x_value, CASE WHEN x_operator = 'between' THEN x_min END AS x_min, CASE WHEN x_operator = 'between' THEN x_max END AS x_max, x_unit, x_relation, x_t_value, x_t_unit, x_anchor, x_history, x_exception, x_condition, x_type, x_operational, x_computability FROM {leaf}")


#: Each measure's tokens, once for both texts: how they are cut, stop words, shortest.
_MEASURES = {"v1": {}, "v3": {"keep": "[^a-z0-9+-]+", "stop": (), "least": 1}, "v4": {"keep": "[^a-z0-9]+", "stop": (), "least": 1}, "v5": {"keep": "[^a-z0-9%<>=./+-]+"}}


def _token_sets(d: Spark) -> list[tuple[str, str]]:
    return [(f"{side}_{v}", text.token_set(d, x, **kind)) for v, kind in _MEASURES.items() for side, x in (("ent", "entity_text"), ("evi", "evidence_text"))]


def _overlaps(d: Spark) -> list[tuple[str, str]]:
    of = lambda v, measure, **more: measure(d, f"ent_{v}", f"evi_{v}", **more)
    return [("recall_v1", of("v1", text.recall_of)), ("jaccard_v3", of("v3", text.jaccard_of)), ("jaccard_v4", of("v4", text.jaccard_of, both_empty=1.0)), ("recall_v5", of("v5", text.recall_of))]


_leaf("token_overlaps", (_token_sets, _overlaps), "SELECT key_id, round(recall_v1, 9) AS recall_v1, round(jaccard_v3, 9) AS jaccard_v3, round(jaccard_v4, 9) AS jaccard_v4, round(recall_v5, 9) AS recall_v5 FROM {leaf}")
#: Lines without leading white space and a bullet or number, without trailing white space; what is empty then is no item.
_LINES = "SELECT doc_id, pos, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({0}) AS l"
_ITEM = "doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS item_index, first_char AS start_char, first_char + length(content) AS end_char, md5(content) AS digest"
_MARKED = "SELECT *, {0} AS bullet FROM ({1}) AS m"
_CUT = "SELECT doc_id, pos, before + length(line) - length(ltrim(line)) + length(bullet) AS first_char, rtrim(substr(ltrim(line), length(bullet) + 1)) AS content FROM ({0}) AS b"
_BULLET = r"^([-•*]|[0-9]+[.)])\s*"


def _items_of(lines: str, bullet: str) -> str:
    return f"SELECT {_ITEM} FROM ({_CUT.format(_MARKED.format(bullet, _LINES.format(lines)))}) AS o WHERE content <> ''"


# The given texts have no bullets, so every third line gets one.
_GIVEN = "CASE WHEN pos % 3 = 1 THEN concat(' - ', raw) WHEN pos % 3 = 2 THEN concat('12) ', raw) ELSE raw END AS line"
_table(
    "item_split",
    _items_of(f"SELECT doc_id, pos, {_GIVEN} FROM (SELECT doc_id, posexplode(split(text, '\n')) AS (pos, raw) FROM {{documents}}) AS r", f"regexp_substr(ltrim(line), r'{_BULLET}')").replace("length(bullet)", "coalesce(length(bullet), 0)"),
    "documents",
    duck=_items_of(f"SELECT doc_id, pos, {_GIVEN} FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM {{documents}}) AS r", f"regexp_extract(ltrim(line), '{_BULLET}')"),
)
_table("paired_sections", "SELECT l_orderkey AS document, count(*) AS n, md5(CAST(l_orderkey AS STRING)) AS place FROM {lineitem} GROUP BY l_orderkey HAVING max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) = 1 ORDER BY place, document LIMIT 100", "lineitem")
_table("latest_per_key", "SELECT user_id, event_type, event_id FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, ts DESC, event_id DESC) AS n FROM {events}) AS x WHERE n = 1", "events")
# A clause joins the run of the one before it if that one is connected by AND (here: an odd turn).
_table(
    "and_or_runs",
    "SELECT conv_id, run, min(turn) AS first_turn, count(*) AS n FROM (SELECT conv_id, turn, sum(CASE WHEN before IS NOT NULL AND before % 2 = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM {conversations}) AS a) AS b GROUP BY conv_id, run",
    "conversations",
)
_table("key_set_algebra", "SELECT side, count(*) AS n FROM (SELECT 'both' AS side, k FROM (SELECT o_custkey AS k FROM {orders} INTERSECT SELECT c_custkey AS k FROM {customer}) AS i UNION ALL SELECT 'customers_only' AS side, k FROM (SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey AS k FROM {orders}) AS e UNION ALL SELECT 'any' AS side, k FROM (SELECT o_custkey AS k FROM {orders} UNION SELECT c_custkey AS k FROM {customer}) AS u) AS x GROUP BY side", "orders", "customer")


#: What a model might write around an object: fences, a word before it, text around it, arrays, broken ones.
_WRAPPED = "CASE event_id % 8 WHEN 0 THEN concat('```json', chr(10), props, chr(10), '```') WHEN 1 THEN concat('Here it is: ', props, ' as asked.') WHEN 2 THEN concat('[', props, ']') WHEN 3 THEN substr(props, 1, length(props) - 1) WHEN 4 THEN '7' WHEN 5 THEN '' WHEN 6 THEN concat('json ', props) ELSE props END"


def _tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(f"SELECT event_id, {_WRAPPED} AS response FROM {{events}}", **tables(spark, sf_dir, "events"))
    return adapters.parsed_json(own).selectExpr("event_id", "parse_status", "CASE WHEN parse_status = 'ok' THEN try_variant_get(json, '$.k', 'string') END AS k")


_SPARK["tolerant_json"] = _tolerant
_SQL["tolerant_json"] = f"""WITH r AS (SELECT event_id, {_WRAPPED} AS response FROM events), b AS (SELECT event_id, response, trim(regexp_replace(regexp_replace(regexp_replace(trim(response), '^```(json)?', ''), '```$', ''), '^(\\s*)[jJ][sS][oO][nN]', '')) AS bare FROM r),
p AS (SELECT *, CASE WHEN json_valid(bare) THEN bare WHEN json_valid(regexp_extract(bare, '(?s)(\\{{.*\\}})', 1)) THEN regexp_extract(bare, '(?s)(\\{{.*\\}})', 1) END AS j FROM b)
SELECT event_id, CASE WHEN trim(coalesce(response, '')) = '' THEN 'empty' WHEN j IS NULL THEN 'error' WHEN json_type(j) <> 'OBJECT' THEN 'not_object' ELSE 'ok' END AS parse_status, CASE WHEN json_type(j) = 'OBJECT' THEN json_extract_string(j, '$.k') END AS k FROM p"""
# --- spans ---------------------------------------------------------------------
_SPANS = "SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS span, l_partkey % 150 AS a, l_partkey % 150 + 5 + CAST(l_quantity AS BIGINT) AS b, CASE l_suppkey % 3 WHEN 0 THEN 'Condition' WHEN 1 THEN 'Measurement' ELSE 'Value' END AS label, round(0.5 + l_discount * 4, 4) AS score FROM lineitem"
_ITEMS = "SELECT o_orderkey AS doc, i AS item, i * 60 AS a, i * 60 + 60 AS b FROM orders JOIN (VALUES (0), (1), (2)) AS n(i) ON o_orderkey >= 0"
_RANKS = {"Condition": 0, "Measurement": 1, "Value": 2}


def _span_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = tables(spark, sf_dir, "lineitem", "orders")
    return spark.sql(_SPANS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=own["lineitem"]), spark.sql(_ITEMS.replace("FROM orders", "FROM {orders}"), orders=own["orders"])


def _span_query(name: str, run, sql: str | None) -> None:
    _SPARK[name] = lambda spark, sf_dir: run(*_span_inputs(spark, sf_dir))
    if sql:
        _SQL[name] = f"WITH spans AS ({_SPANS}), items AS ({_ITEMS}) " + sql


_OVERLAP = "SELECT i.doc, i.item, s.span, least(s.b, i.b) - greatest(s.a, i.a) AS shared, s.label, s.score, s.b - s.a AS size FROM spans AS s JOIN items AS i ON s.doc = i.doc AND s.a < i.b AND i.a < s.b"
_span_query("spans_in_items", spans.contained, "SELECT i.doc, i.item, s.span, s.a - i.a AS a, s.b - i.a AS b, s.label, s.score FROM spans AS s JOIN items AS i ON s.doc = i.doc AND s.a >= i.a AND s.b <= i.b")
_span_query("spans_over_items", spans.overlapping, _OVERLAP)
_span_query("best_anchor", lambda s, i: spans.best_anchor(spans.overlapping(s, i), _RANKS), f"SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY doc, item ORDER BY CASE label WHEN 'Condition' THEN 0 WHEN 'Measurement' THEN 1 ELSE 2 END, shared DESC, score DESC, size DESC, span) AS n FROM ({_OVERLAP})) WHERE n = 1")
_span_query("distinct_spans", lambda s, i: spans.distinct_spans(s), "SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY doc, a, b, label ORDER BY score DESC, span) AS n FROM spans) WHERE n = 1")
# Folds that depend on order: the oracle goes from span to span, with the kept ones in a list.
_FOLD = "WITH RECURSIVE spans AS ({0}), items AS ({1}), placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {{keys}} ORDER BY {{order}}) AS nth FROM spans), fold AS (SELECT {{keys}}, nth, [{{{{'a': a, 'b': b, 'span': span}}}}] AS kept FROM placed WHERE nth = 1 UNION ALL SELECT {{on}}, p.nth, CASE WHEN len(list_filter(f.kept, lambda k: {{rival}})) > 0 THEN f.kept ELSE list_append(f.kept, {{{{'a': p.a, 'b': p.b, 'span': p.span}}}}) END FROM fold AS f JOIN placed AS p ON p.nth = f.nth + 1 AND {{same}}) SELECT s.* FROM spans AS s JOIN (SELECT doc, unnest(kept).span AS span FROM (SELECT doc, arg_max(kept, nth) AS kept FROM fold GROUP BY {{keys}})) AS k ON k.doc = s.doc AND k.span = s.span".format(_SPANS, _ITEMS)
_LEAST = "least(k.b - k.a, p.b - p.a)"
_span_query("suppressed_spans", lambda s, i: spans.suppressed(s), None)
_SQL["suppressed_spans"] = _FOLD.format(keys="doc, label", on="p.doc, p.label", same="p.doc = f.doc AND p.label = f.label", order="score DESC, b - a DESC, span", rival=f"least(k.b, p.b) > greatest(k.a, p.a) AND least(k.b, p.b) - greatest(k.a, p.a) >= 0.8 * {_LEAST}")
_span_query("flat_spans", lambda s, i: spans.flat(s), None)
_SQL["flat_spans"] = _FOLD.format(keys="doc", on="p.doc", same="p.doc = f.doc", order="a, b - a DESC, span", rival="least(k.b, p.b) > greatest(k.a, p.a)")
_SIDES = "SELECT doc, span, a, b, label, CASE WHEN span % 2 = 0 THEN 'gold' ELSE 'pred' END AS side FROM spans"
_span_query("greedy_span_match", lambda s, i: spans.greedy_match(s.withColumn("side", F.when(F.col("span") % 2 == 0, "gold").otherwise("pred"))), None)
#: Predictions of a document one after the other; the gold spans taken so far stand in a list.
GREEDY = "{name}p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY span) AS nth FROM sides WHERE side = 'pred'), {name} AS (SELECT {keys}, 0::BIGINT AS nth, NULL::BIGINT AS span, NULL::BIGINT AS gold_span, 0::BIGINT AS shared, []::BIGINT[] AS used FROM {name}p WHERE nth = 1 UNION ALL SELECT {on}, p.nth, p.span, g.span, coalesce(g.shared, 0), CASE WHEN g.span IS NULL THEN m.used ELSE list_append(m.used, g.span) END FROM {name} AS m JOIN {name}p AS p ON {same} AND p.nth = m.nth + 1 LEFT JOIN LATERAL (SELECT x.span, least(x.b, p.b) - greatest(x.a, p.a) AS shared FROM sides AS x WHERE x.side = 'gold' AND {gold} AND least(x.b, p.b) > greatest(x.a, p.a) AND NOT list_contains(m.used, x.span) ORDER BY shared DESC, x.span LIMIT 1) AS g ON true)"
_SQL["greedy_span_match"] = f"WITH RECURSIVE spans AS ({_SPANS}), sides AS MATERIALIZED ({_SIDES}), " + GREEDY.format(name="m", keys="doc", on="p.doc", same="p.doc = m.doc", gold="x.doc = p.doc") + " SELECT doc, span, gold_span, shared FROM m WHERE nth > 0"
_span_query("merged_spans", lambda s, i: spans.merged(s), "SELECT doc, min(span) FILTER (nth = 1) AS span, min(a) AS a, max(b) AS b, any_value(label) AS label, min(score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc, run, part ORDER BY a, b, span) AS nth FROM (SELECT *, sum(CASE WHEN a - far <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc, run ORDER BY a, b, span) AS part FROM (SELECT *, max(b) OVER (PARTITION BY doc, run ORDER BY a, b, span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM (SELECT *, sum(CASE WHEN label = before THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY a, b, span) AS run FROM (SELECT *, lag(label) OVER (PARTITION BY doc ORDER BY a, b, span) AS before FROM spans))))) GROUP BY doc, run, part")


# --- trees ---------------------------------------------------------------------
_CLAUSES = "SELECT document_id, criterion_type AS section, item_uid, CAST(row_number() OVER (PARTITION BY document_id, criterion_type ORDER BY item_uid, key_id) - 1 AS BIGINT) AS ord, CASE k % 5 WHEN 0 THEN 'OR' WHEN 1 THEN NULL ELSE 'AND' END AS connector, key_id AS criterion_id, k % 11 = 3 AS negated FROM {leaf}"


def _walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section of a document as one item, assembled and walked again."""
    own = spark.sql(_CLAUSES, leaf=leaves(spark, sf_dir)).withColumn("item_uid", F.concat_ws("/", "document_id", "section")).withColumn("item_index", F.lit(0))
    return tree.walk(tree.assemble(own)).select("criterion_id", "negated", "path")


_SPARK["tree_paths"] = _walked
_SQL["tree_paths"] = f"""
WITH s0 AS ({leaves_sql()}), c AS ({_CLAUSES.replace("{leaf}", "s0")}),
r AS (SELECT *, sum(CASE WHEN before = 'AND' THEN 0 ELSE 1 END) OVER (PARTITION BY document_id, section ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS g FROM (SELECT *, lag(connector) OVER (PARTITION BY document_id, section ORDER BY ord) AS before FROM c)),
p AS (SELECT *, row_number() OVER (PARTITION BY document_id, section, g ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY document_id, section, g) AS size, max(g) OVER (PARTITION BY document_id, section) AS last FROM r)
SELECT criterion_id, negated, concat(section, '_criteria.children[0]', CASE WHEN last > 0 THEN concat('.children[', g, ']') ELSE '' END, CASE WHEN size > 1 THEN concat('.children[', i, ']') ELSE '' END) AS path FROM p
"""


branches.register(LAYER3, (*BRANCH_A, layer2.ablation))


def queries() -> dict:
    return _SPARK | branches.queries() | trees.queries() | evaluation.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | oracle.oracle_sql() | branches.oracle_sql() | trees.oracle_sql() | evaluation.oracle_sql()
