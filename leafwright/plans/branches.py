"""Queries over separate tables of clauses, both branches' leaves, issues, scores and labels.

The fixture tables are derived from the leaf table (the same text for both
engines). Spark runs the operators; the oracle runs statements written by hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, text
from ..operators import aggregates, joins, labels, layer1, layer2, layer3, normalise, rescue, values
from . import oracle
from .dialect import apply
from .leaves import leaves, leaves_sql

#: Fixture tables over ``leaf``; each text runs in both engines.
FIXTURES = {
    # Clauses with some twice (another text, later) and some missing.
    "clauses": "SELECT document_id, item_uid, clause_id, k AS ord, evidence_text AS clause_text, k % 11 = 3 AS is_negated FROM leaf WHERE k % 31 <> 8 UNION ALL SELECT document_id, item_uid, clause_id, k + 2000 AS ord, 'said again' AS clause_text, false AS is_negated FROM leaf WHERE k % 37 = 5",
    "leaf_a": "SELECT key_id, key_id AS criterion_id, document_id, item_uid, clause_id, concat(document_id, '/', clause_id) AS path, entity_type, entity_text, operator, value_type, value_kind, value_text, unit, computability, evidence_text, k FROM leaf WHERE k % 61 <> 7",
    "leaf_b": "SELECT key_id AS criterion_id, document_id, item_uid, clause_id, CASE WHEN k % 10 = 3 THEN 'other' ELSE entity_type END AS entity_type, CASE WHEN k % 8 = 5 THEN concat('severe ', entity_text) WHEN k % 8 = 6 THEN '' ELSE entity_text END AS entity_text, CASE WHEN k % 6 = 1 THEN 'exists' ELSE operator END AS operator, CASE WHEN k % 6 = 1 THEN 'null' ELSE value_type END AS value_type, CASE WHEN k % 6 = 1 THEN 'null' ELSE value_kind END AS value_kind, CASE WHEN k % 6 = 1 THEN NULL WHEN k % 9 = 4 THEN '7' ELSE value_text END AS value_text, CASE WHEN k % 12 = 7 THEN 'kg' ELSE unit END AS unit, computability, evidence_text, k FROM leaf WHERE k % 7 <> 5",
    "flags": "SELECT document_id, CASE WHEN k % 2 = 0 THEN 'duplicate_path' ELSE 'single_child' END AS issue_type, concat(document_id, '/C1; ', document_id, '/C2;') AS paths FROM leaf WHERE k % 45 < 2",
    "issues": "SELECT document_id, key_id AS criterion_id, CASE WHEN k % 3 = 0 THEN 'b_code;a_code' ELSE 'c_code' END AS codes FROM leaf WHERE k % 9 < 2 UNION ALL SELECT document_id, key_id AS criterion_id, 'a_code' AS codes FROM leaf WHERE k % 27 = 0",
    "policies": "SELECT key_id AS criterion_id, CASE WHEN k % 4 = 0 THEN 'policy_code' ELSE '' END AS codes, CASE WHEN k % 5 = 0 THEN ' ' WHEN k % 5 = 1 THEN NULL ELSE 'from_policy' END AS action, CASE WHEN k % 3 = 0 THEN '' ELSE evidence_text END AS evidence_text FROM leaf WHERE k % 13 <> 2",
    "decisions": "SELECT key_id AS criterion_id, CASE k % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'A_raw' WHEN 2 THEN '' ELSE 'B_raw' END AS branch, CASE k % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'partial' ELSE 'human_review' END AS decision, k AS ord FROM leaf UNION ALL SELECT key_id AS criterion_id, 'A' AS branch, 'late' AS decision, k + 5000 AS ord FROM leaf WHERE k % 19 = 4 UNION ALL SELECT concat('no_', key_id) AS criterion_id, 'A' AS branch, 'accept' AS decision, k AS ord FROM leaf WHERE k % 97 = 3",
    "plan": "SELECT key_id AS criterion_id, k % 2 = 0 AS needs_result FROM leaf WHERE k % 5 < 2",
    "results": "SELECT key_id AS criterion_id, CASE WHEN k % 8 = 0 THEN 'human_review' ELSE 'use_candidate' END AS decision, CASE WHEN k % 12 = 5 THEN 'fail' ELSE 'pass' END AS validation FROM leaf WHERE k % 5 = 0",
    "labels": "SELECT key_id AS criterion_id, item_uid, clause_id, manual_label AS label, k AS ord, evidence_text AS note FROM leaf WHERE manual_label IS NOT NULL UNION ALL SELECT key_id AS criterion_id, item_uid, clause_id, 'incorrect' AS label, k + 3000 AS ord, evidence_text AS note FROM leaf WHERE manual_label IS NOT NULL AND k % 23 = 6",
    "later": "SELECT item_uid, clause_id, CASE WHEN k % 6 = 0 THEN 'unsure' WHEN k % 6 < 3 THEN 'correct' WHEN k % 6 < 5 THEN 'partial' ELSE manual_label END AS label FROM leaf WHERE k % 3 <> 1",
    "written": "SELECT item_uid, CASE WHEN k % 33 = 4 THEN 'C99' ELSE clause_id END AS clause_id, operator FROM leaf WHERE k % 14 <> 6 UNION ALL SELECT item_uid, clause_id, 'exists' AS operator FROM leaf WHERE k % 51 = 9",
}
_SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(FIXTURES[name].replace("FROM leaf", "FROM {leaf}"), leaf=leaves(spark, sf_dir))


def _query(name: str, tables: str, run: Callable[..., DataFrame], sql: str) -> None:
    """``run`` over the named fixtures, and its statement over tables of the same names."""
    names = tables.split()
    _SPARK[name] = lambda spark, sf_dir: run(*(_fixture(spark, sf_dir, n) for n in names))
    _SQL[name] = f"WITH leaf AS MATERIALIZED ({leaves_sql()}), " + ", ".join(f"{n} AS MATERIALIZED ({FIXTURES[n]})" for n in names) + " " + sql


# --- clauses and leaves ------------------------------------------------------------
_FIRST = "(SELECT document_id, item_uid, clause_id, clause_text, is_negated, count(*) OVER w AS clause_count, row_number() OVER (w ORDER BY ord) AS nth FROM clauses WINDOW w AS (PARTITION BY document_id, item_uid, clause_id))"
_query("leaves_with_clause", "leaf_a clauses", lambda a, c: joins.leaves_with_clause(a, c).select("key_id", "clause_text", "is_negated", "clause_count", "has_clause"),
       f"SELECT key_id, c.clause_text, c.is_negated, c.clause_count, c.clause_count IS NOT NULL AS has_clause FROM leaf_a AS a LEFT JOIN {_FIRST} AS c ON c.nth = 1 AND c.document_id = a.document_id AND c.item_uid = a.item_uid AND c.clause_id = a.clause_id")
_query("clauses_without_leaf", "clauses leaf_a", lambda c, a: joins.clauses_without_leaf(c, a).select("item_uid", "clause_id", "clause_count", "clause_text"),
       f"SELECT item_uid, clause_id, clause_count, clause_text FROM {_FIRST} AS c WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM leaf_a AS a WHERE a.document_id = c.document_id AND a.item_uid = c.item_uid AND a.clause_id = c.clause_id)")
_query("items_with_entities", "leaf_a flags", lambda a, f: joins.items_with_entities(a.select("document_id").distinct(), f.select("document_id", "paths"), "document_id").select("document_id", "entity_status"),
       "SELECT d.document_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS entity_status FROM (SELECT DISTINCT document_id FROM leaf_a) AS d LEFT JOIN (SELECT document_id, count(*) AS n FROM flags GROUP BY ALL) AS f USING (document_id)")
_query("leaves_with_flags", "leaf_a flags", lambda a, f: joins.leaves_with_flags(a, f).select("key_id", "tree_flags"),
       "SELECT key_id, coalesce((SELECT string_agg(DISTINCT issue_type, ';' ORDER BY issue_type) FROM flags AS f WHERE f.document_id = a.document_id AND list_contains(list_transform(string_split(f.paths, ';'), lambda p: trim(p)), a.path)), '') AS tree_flags FROM leaf_a AS a")
_query("leaves_with_issues", "leaf_a issues", lambda a, i: joins.leaves_with_issues(a, i).select("key_id", "issues"),
       "SELECT key_id, coalesce(c.codes, '') AS issues FROM leaf_a AS a LEFT JOIN (SELECT document_id, criterion_id, string_agg(DISTINCT code, ';' ORDER BY code) AS codes FROM (SELECT document_id, criterion_id, unnest(string_split(codes, ';')) AS code FROM issues) GROUP BY ALL) AS c ON c.document_id = a.document_id AND c.criterion_id = a.criterion_id")
_query("leaves_with_context", "leaf_a policies", lambda a, p: joins.leaves_with_context(a.select("criterion_id", "key_id"), p.select("criterion_id", "action")).select("key_id", "action", "context_missing"),
       "SELECT key_id, action, p.criterion_id IS NULL AS context_missing FROM leaf_a AS a LEFT JOIN policies AS p ON p.criterion_id = a.criterion_id")
_query("code_sources", "leaf_a issues policies", lambda a, i, p: joins.with_code_sources(a, {"consistency": i, "policy": p, "inventory": None}).select("key_id", "all_codes", "sources"),
       "SELECT key_id, c.all_codes, c.sources FROM leaf_a AS a LEFT JOIN (SELECT criterion_id, string_agg(DISTINCT code, ';' ORDER BY code) AS all_codes, string_agg(DISTINCT source, ';' ORDER BY source) AS sources FROM (SELECT criterion_id, unnest(string_split(codes, ';')) AS code, 'consistency' AS source FROM issues UNION ALL SELECT criterion_id, unnest(string_split(codes, ';')), 'policy' FROM policies) WHERE code <> '' GROUP BY ALL) AS c ON c.criterion_id = a.criterion_id")
_query("safe_leaf_keys", "leaf_a", lambda a: joins.safe_keys(a.withColumn("key", F.when(F.col("k") % 4 == 1, F.col("clause_id")).when(F.col("k") % 4 == 2, F.lit(" ")).otherwise(F.col("criterion_id"))), "key").select("key_id", "key"),
       "SELECT key_id, key FROM (SELECT key_id, CASE k % 4 WHEN 1 THEN clause_id WHEN 2 THEN ' ' ELSE criterion_id END AS key FROM leaf_a) WHERE trim(key) <> '' AND NOT regexp_full_match(key, 'C[0-9]+')")


def _overlap() -> Column:
    """Share of A's entity tokens that B has; 0 where A has none."""
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != ""))
    own = tokens("a_entity_text")
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, tokens("entity_text"))) / F.size(own)).otherwise(0.0)


_query("branch_agreement_flags", "leaf_b leaf_a", lambda b, a: joins.agreement(b, a, "criterion_id", _overlap()).select("criterion_id", "entity_type_agrees", "operator_agrees", "value_text_agrees", "unit_agrees", "entity_overlap", "agreement_n"),
       "SELECT criterion_id, e AS entity_type_agrees, o AS operator_agrees, v AS value_text_agrees, u AS unit_agrees, s AS entity_overlap, CASE WHEN found THEN e + o + v + u + (s >= 0.5)::INT ELSE 0 END AS agreement_n FROM (SELECT b.criterion_id, a.criterion_id IS NOT NULL AS found, CASE WHEN a.criterion_id IS NOT NULL THEN (b.entity_type = a.entity_type)::INT END AS e, CASE WHEN a.criterion_id IS NOT NULL THEN (b.operator = a.operator)::INT END AS o, CASE WHEN a.criterion_id IS NOT NULL THEN (coalesce(b.value_text, '') = coalesce(a.value_text, ''))::INT END AS v, CASE WHEN a.criterion_id IS NOT NULL THEN (coalesce(b.unit, '') = coalesce(a.unit, ''))::INT END AS u, CASE WHEN a.criterion_id IS NULL THEN NULL WHEN len(a.t) = 0 THEN 0.0 ELSE round(len(list_intersect(a.t, regexp_split_to_array(lower(b.entity_text), '[^a-z0-9]+'))) / len(a.t)::DOUBLE, 6) END AS s FROM leaf_b AS b LEFT JOIN (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(entity_text), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM leaf_a) AS a ON a.criterion_id = b.criterion_id)")
_query("first_filled", "leaf_a policies", lambda a, p: joins.first_filled([a.withColumn("action", F.when(F.col("k") % 6 == 0, "from_layer2")), p, a.withColumn("action", F.lit("from_inventory"))], "criterion_id", ["action", "evidence_text"]),
       "SELECT a.criterion_id, CASE WHEN k % 6 = 0 THEN 'from_layer2' ELSE coalesce(nullif(trim(p.action), ''), 'from_inventory') END AS action, coalesce(nullif(trim(a.evidence_text), ''), nullif(trim(p.evidence_text), '')) AS evidence_text FROM leaf_a AS a LEFT JOIN policies AS p ON p.criterion_id = a.criterion_id")
_query("last_decisions", "decisions", lambda x: joins.last_by_key(x, "A", ("A", "A_raw")),
       "SELECT 'A' AS branch, criterion_id, decision, ord FROM (SELECT *, row_number() OVER (PARTITION BY criterion_id ORDER BY ord DESC) AS nth FROM decisions WHERE branch IN ('', 'A', 'A_raw')) WHERE nth = 1")
_query("matched_decisions", "decisions leaf_a", lambda x, a: joins.matched(joins.last_by_key(x, "A", ("A", "A_raw")).select("criterion_id", "decision"), a).select("key_id", "decision"),
       "SELECT key_id, decision FROM leaf_a JOIN (SELECT criterion_id, arg_max(decision, ord) AS decision FROM decisions WHERE branch <> 'B_raw' GROUP BY ALL) USING (criterion_id)")
_query("unmatched_decisions", "decisions leaf_a", lambda x, a: joins.unmatched(x.select("criterion_id", "decision"), a).groupBy("decision").agg(F.count("*").alias("n")),
       "SELECT decision, count(*) AS n FROM decisions WHERE criterion_id NOT IN (SELECT criterion_id FROM leaf_a) GROUP BY ALL")
_FIELDS = ["entity_type", "operator", "value_text", "unit"]
_query("before_after", "leaf_a leaf_b", lambda a, b: joins.before_after(a, b, "criterion_id", _FIELDS),
       "SELECT coalesce(a.criterion_id, b.criterion_id) AS criterion_id, CASE WHEN a.criterion_id IS NULL THEN 'missing_before' WHEN b.criterion_id IS NULL THEN 'missing_after' WHEN c <> '' THEN 'changed' ELSE 'same' END AS status, CASE WHEN a.criterion_id IS NULL OR b.criterion_id IS NULL THEN '' ELSE c END AS changed_fields FROM (SELECT a, b, concat_ws(';', CASE WHEN a.entity_type IS DISTINCT FROM b.entity_type THEN 'entity_type' END, CASE WHEN a.operator IS DISTINCT FROM b.operator THEN 'operator' END, CASE WHEN a.unit IS DISTINCT FROM b.unit THEN 'unit' END, CASE WHEN a.value_text IS DISTINCT FROM b.value_text THEN 'value_text' END) AS c FROM leaf_a AS a FULL JOIN leaf_b AS b ON a.criterion_id = b.criterion_id)")
_query("plan_inputs", "plan leaf_a leaf_b policies", lambda p, a, b, c: joins.plan_inputs(p, a, b, c).select("criterion_id", "status", F.col("a.operator").alias("operator_a"), F.col("b.operator").alias("operator_b")),
       "SELECT p.criterion_id, CASE WHEN a.criterion_id IS NULL THEN 'error:missing_a_leaf' WHEN b.criterion_id IS NULL THEN 'error:missing_b_leaf' WHEN c.criterion_id IS NULL THEN 'error:missing_context' ELSE 'ok' END AS status, a.operator AS operator_a, b.operator AS operator_b FROM plan AS p LEFT JOIN leaf_a AS a ON a.criterion_id = p.criterion_id LEFT JOIN leaf_b AS b ON b.criterion_id = p.criterion_id LEFT JOIN policies AS c ON c.criterion_id = p.criterion_id")
_query("substitutions", "plan results leaf_b", joins.substituted,
       "SELECT p.criterion_id, CASE WHEN r.decision <> 'human_review' AND r.validation = 'pass' THEN 'b_dejure_best' WHEN b.criterion_id IS NOT NULL AND NOT needs_result THEN 'b_current' ELSE 'human_review' END AS selected_source FROM plan AS p LEFT JOIN results AS r ON r.criterion_id = p.criterion_id LEFT JOIN leaf_b AS b ON b.criterion_id = p.criterion_id")
_query("labelled_scores", "leaf_a labels", lambda a, m: joins.labelled_scores(a.select("criterion_id", "computability"), m, "criterion_id", "label"),
       "SELECT a.criterion_id, computability, l.label, n = 1 AS unique_key FROM leaf_a AS a JOIN (SELECT criterion_id, arg_min(label, ord) AS label, count(*) AS n FROM labels GROUP BY ALL) AS l ON l.criterion_id = a.criterion_id WHERE label <> ''")
_query("grounding_with_labels", "leaf_b labels", lambda b, m: joins.grounding_with_labels(b.withColumn("criterion_id", F.when(F.col("k") % 2 == 0, F.col("criterion_id"))).select("criterion_id", "item_uid", "clause_id", "unit"), m.withColumn("criterion_id", F.when(F.col("ord") % 3 > 0, F.col("criterion_id"))), "label").select("join_key", "unit", "label", "manual_file__criterion_id", "note"),
       "SELECT b.criterion_id AS join_key, unit, label, CASE WHEN m.ord % 3 > 0 THEN m.criterion_id END AS \"manual_file__criterion_id\", note FROM leaf_b AS b JOIN labels AS m ON m.criterion_id = b.criterion_id WHERE label <> ''")
_query("both_branches", "decisions", lambda x: joins.both_branches(x.where("branch = 'A' and decision <> 'late'"), x.where("branch = 'B_raw' or branch = 'A' and ord % 8 = 0 and decision <> 'late'")),
       "SELECT coalesce(a.criterion_id, b.criterion_id) AS criterion_id, a.decision AS decision_a, b.decision AS decision_b FROM (SELECT * FROM decisions WHERE branch = 'A' AND decision <> 'late') AS a FULL JOIN (SELECT * FROM decisions WHERE branch = 'B_raw' OR branch = 'A' AND ord % 8 = 0 AND decision <> 'late') AS b ON a.criterion_id = b.criterion_id")


def _gold(a: DataFrame, b: DataFrame) -> DataFrame:
    gold, own = joins.shared_documents(a.where("k % 3 = 0"), b.where("k % 4 = 1"))
    pair = gold.select("document_id", "item_uid", "entity_type").intersect(own.select("document_id", "item_uid", "entity_type")).agg(F.count("*").alias("tp"))
    sizes = gold.agg(F.count("*").alias("gold")).crossJoin(own.agg(F.count("*").alias("predicted")))  # one row each
    return aggregates.micro_scores(pair.crossJoin(sizes))


_query("micro_scores", "leaf_a leaf_b", _gold,
       "SELECT tp, predicted, gold, p AS prec, r AS recall, CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 4) ELSE 0 END AS f1 FROM (SELECT *, round(tp / predicted, 4) AS p, round(tp / gold, 4) AS r FROM (SELECT (SELECT count(*) FROM (SELECT document_id, item_uid, entity_type FROM leaf_a WHERE k % 3 = 0 INTERSECT SELECT document_id, item_uid, entity_type FROM leaf_b WHERE k % 4 = 1)) AS tp, (SELECT count(*) FROM leaf_b WHERE k % 4 = 1 AND document_id IN (SELECT document_id FROM leaf_a WHERE k % 3 = 0)) AS predicted, (SELECT count(*) FROM leaf_a WHERE k % 3 = 0 AND document_id IN (SELECT document_id FROM leaf_b WHERE k % 4 = 1)) AS gold))")
_LATER = "(SELECT p.item_uid, p.clause_id, p.label, f.label AS pre_label, CASE WHEN f.label IS NULL OR p.label NOT IN ('correct', 'partial', 'incorrect') OR p.label IS NULL THEN '' WHEN list_position(['incorrect','partial','correct'], p.label) > list_position(['incorrect','partial','correct'], f.label) THEN 'improved' WHEN list_position(['incorrect','partial','correct'], p.label) < list_position(['incorrect','partial','correct'], f.label) THEN 'worsened' ELSE 'same' END AS change FROM later AS p LEFT JOIN (SELECT item_uid, clause_id, arg_min(label, ord) AS label FROM labels GROUP BY ALL) AS f ON f.item_uid = p.item_uid AND f.clause_id = p.clause_id)"
_query("labels_before_and_after", "later labels", lambda p, m: joins.with_earlier_labels(p, m), f"SELECT * FROM {_LATER}")
_query("changed_transitions", "later labels", lambda p, m: aggregates.transitions(joins.with_earlier_labels(p, m), "pre_label", "label", "change", True), f"SELECT pre_label || '_to_' || label AS transition, change AS direction, count(*) AS n FROM {_LATER} WHERE change NOT IN ('', 'same') GROUP BY ALL")
_query("all_transitions", "later labels", lambda p, m: aggregates.transitions(joins.with_earlier_labels(p, m), "pre_label", "label", "change"), f"SELECT pre_label || '_to_' || label AS transition, change AS direction, count(*) AS n FROM {_LATER} WHERE change <> '' GROUP BY ALL")
_query("plan_with_labels", "plan labels", lambda p, m: joins.plan_with_labels(p, m).select("criterion_id", "manual_label", "manual_error"),
       "SELECT p.criterion_id, l.label AS manual_label, l.label IN ('partial', 'incorrect') AS manual_error FROM plan AS p LEFT JOIN (SELECT criterion_id, arg_min(label, ord) AS label FROM labels GROUP BY ALL) AS l ON l.criterion_id = p.criterion_id")
_query("error_coverage", "plan labels", joins.error_coverage,
       "SELECT count(*) AS labelled, count(*) FILTER (e) AS errors, count(*) FILTER (e AND planned) AS errors_planned, round(count(*) FILTER (e AND planned) / count(*) FILTER (e), 6) AS recall FROM (SELECT label IN ('partial', 'incorrect') AS e, criterion_id IN (SELECT criterion_id FROM plan) AS planned FROM (SELECT criterion_id, arg_min(label, ord) AS label FROM labels GROUP BY ALL))")
_query("aligned_leaves", "written clauses", lambda w, c: normalise.aligned(w, joins.first_clauses(c.withColumn("evidence_text", F.col("clause_text")).withColumn("at", F.col("ord")), "at")),
       "SELECT coalesce(c.item_uid, w.item_uid) AS item_uid, coalesce(c.clause_id, w.clause_id) AS clause_id, coalesce(c.item_uid, w.item_uid) || '_' || coalesce(c.clause_id, w.clause_id) AS criterion_id, c.clause_text AS evidence_text, CASE WHEN c.item_uid IS NULL THEN 'unexpected' WHEN w.n IS NULL THEN 'missing' WHEN w.n > 1 THEN 'duplicate' ELSE 'ok' END AS status, c.ord AS clause_order FROM (SELECT item_uid, clause_id, arg_min(clause_text, ord) AS clause_text, min(ord) AS ord FROM clauses GROUP BY ALL) AS c FULL JOIN (SELECT item_uid, clause_id, count(*) AS n FROM written GROUP BY ALL) AS w ON w.item_uid = c.item_uid AND w.clause_id = c.clause_id")
# --- tables ----------------------------------------------------------------------
_query("confusion_with_totals", "labels", lambda m: aggregates.confusion(m.withColumn("kind", F.when(F.col("ord") % 2 == 0, "even").otherwise("odd")), "kind", "label"),
       "SELECT coalesce(kind, 'All') AS kind, count(*) FILTER (label = 'correct') AS correct, count(*) FILTER (label = 'partial') AS partial, count(*) FILTER (label = 'incorrect') AS incorrect, count(*) AS \"All\" FROM (SELECT *, CASE WHEN ord % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM labels) GROUP BY ROLLUP (kind)")
_query("token_shares", "leaf_a", lambda a: aggregates.token_shares(a.groupBy("item_uid").agg(F.sum(F.length("evidence_text")).alias("tokens")), a, "tokens"),
       "SELECT item_uid, key_id, round(sum(length(evidence_text)) OVER (PARTITION BY item_uid) / count(*) OVER (PARTITION BY item_uid), 6) AS tokens_per_leaf FROM leaf_a")
_query("phase_deltas", "leaf_a leaf_b", lambda a, b: aggregates.phase_deltas(a.groupBy(F.col("operator").alias("metric")).agg(F.count("*").alias("value")), b.groupBy(F.col("operator").alias("metric")).agg(F.count("*").alias("value"))),
       "SELECT metric, pre, post, post - pre AS delta FROM (SELECT operator AS metric, count(*) AS pre FROM leaf_a GROUP BY ALL) FULL JOIN (SELECT operator AS metric, count(*) AS post FROM leaf_b GROUP BY ALL) USING (metric)")
_query("length_summary", "leaf_a", lambda a: aggregates.summary(a.withColumn("n_chars", F.length("evidence_text")), "n_chars"),
       "SELECT round(avg(length(evidence_text)), 2) AS mean, round(median(length(evidence_text)), 2) AS median, count(evidence_text) AS n FROM leaf_a")
# --- scalars ----------------------------------------------------------------------


def _scalars(a: DataFrame) -> DataFrame:
    item, clause = scalars.item_and_clause(F.col("criterion_id"))
    mixed = F.concat_ws(" ", F.col("evidence_text"), F.when(F.col("k") % 3 == 0, "(a [b] {c})").when(F.col("k") % 3 == 1, "(a [b) ]"))
    text_number = F.concat(F.col("k").cast("string"), F.when(F.col("k") % 2 == 0, ".0").otherwise(".50"))
    marks = {"entity": F.when(F.col("k") % 2 == 0, F.col("k") % 9 - 1.0), "operator": F.col("k") % 6 * 1.0, "value": F.when(F.col("k") % 5 == 0, F.lit(2.5))}
    return a.select(
        "key_id", item.alias("item"), clause.alias("clause"), scalars.clause_order(F.col("clause_id")).alias("clause_order"), scalars.number_text(text_number).alias("number_text"),
        scalars.truth(F.when(F.col("k") % 4 == 0, " Yes").when(F.col("k") % 4 == 1, "0").when(F.col("k") % 4 == 2, "T")).alias("truth"), scalars.number_or(F.when(F.col("k") % 2 == 0, text_number).otherwise("none"), -1.0).alias("number"),
        scalars.clamped(F.col("k") / 500 - 0.5).alias("clamped"), scalars.without_prefix(F.concat(F.lit("layer1:x:"), "operator")).alias("code"),
        scalars.balanced(mixed).alias("balanced"), scalars.comparison_signals(F.col("evidence_text")).cast("int").alias("signals"), scalars.judge_score(marks).alias("judge"),
        joins.label_change("x", "y").alias("change") if "x" in a.columns else F.lit("").alias("change"),
    )


_MIXED = "concat_ws(' ', evidence_text, CASE k % 3 WHEN 0 THEN '(a [b] {c})' WHEN 1 THEN '(a [b) ]' END)"
_query("scalar_forms", "leaf_a", _scalars,
       f"SELECT key_id, regexp_extract(criterion_id, '^(.*)_[^_]*$', 1) AS item, regexp_extract(criterion_id, '([^_]*)$', 1) AS clause, regexp_extract(clause_id, '[0-9]+$')::BIGINT AS clause_order, CASE WHEN k % 2 = 0 THEN k::VARCHAR ELSE k::VARCHAR || '.5' END AS number_text, k % 4 IN (0, 2) AS truth, CASE WHEN k % 2 = 0 THEN k::DOUBLE ELSE -1.0 END AS number, CASE WHEN k / 500 - 0.5 < 0 THEN 0.0 WHEN k / 500 - 0.5 > 1 THEN 1.0 ELSE k / 500 - 0.5 END AS clamped, 'x:' || operator AS code, k % 3 <> 1 AS balanced, len(regexp_extract_all(lower(evidence_text), '>=|<=|<|>|\\b(greater|less|more) than\\b|\\b(at least|at most|no more than|no less than)\\b|\\bbetween\\b')) AS signals, round((coalesce(least(5.0, greatest(0.0, CASE WHEN k % 2 = 0 THEN k % 9 - 1.0 END)), 0) * (k % 2 = 0)::INT + k % 6 + CASE WHEN k % 5 = 0 THEN 2.5 ELSE 0 END) / (1 + (k % 2 = 0)::INT + (k % 5 = 0)::INT), 4) AS judge, '' AS change FROM leaf_a")


def _spans(a: DataFrame) -> DataFrame:
    own = a.withColumn("item_start", F.when(F.col("k") % 17 != 3, F.col("k") * 10)).withColumn("item_text", F.when(F.col("k") % 13 == 2, F.lit("other words")).otherwise(F.concat(F.lit("Item: "), F.upper("evidence_text"))))
    start, end, status = scalars.recovered_span("item_start", "item_text", "evidence_text", "entity_text")
    return own.select("key_id", start.alias("start"), end.alias("end"), status.alias("status"))


_query("recovered_spans", "leaf_a", _spans,
       "SELECT key_id, CASE WHEN status = 'entity_in_evidence' THEN s END AS start, CASE WHEN status = 'entity_in_evidence' THEN s + length(entity_text) END AS end, status FROM (SELECT *, k * 10 + 6 + strpos(lower(evidence_text), lower(entity_text)) - 1 AS s, CASE WHEN k % 17 = 3 THEN 'missing_item_start' WHEN evidence_text = '' OR k % 13 = 2 THEN 'evidence_not_in_item' WHEN entity_text = '' OR strpos(lower(evidence_text), lower(entity_text)) = 0 THEN 'span_not_recoverable' ELSE 'entity_in_evidence' END AS status FROM leaf_a)")


# --- rules over all layers -----------------------------------------------------------
def _leaf(name: str, steps: tuple, closing: str | Callable[[DataFrame], DataFrame], sql: str, wanted: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = apply(leaves(spark, sf_dir), text.columns, *steps, wanted=closing if isinstance(closing, str) else wanted)
        return spark.sql(closing, leaf=own) if isinstance(closing, str) else closing(own)

    _SPARK[name], _SQL[name] = run, oracle.rules() + oracle.once(sql)


def register(layer3_steps: tuple, ablation: tuple) -> None:
    """The queries on top of all layers; the slate hands over its steps."""

    def b_columns(d) -> list[tuple[str, str]]:
        return [
            ("b_found", "k % 7 <> 5"),
            ("b_entity_type", "CASE WHEN k % 10 = 3 THEN 'other' ELSE entity_type END"),
            ("b_entity_text", "CASE WHEN k % 8 = 5 THEN concat('severe ', entity_text) WHEN k % 8 = 6 THEN '' ELSE entity_text END"),
            ("b_operator", "CASE WHEN k % 6 = 1 THEN 'exists' ELSE operator END"),
            ("b_value_type", "CASE WHEN k % 6 = 1 THEN 'null' ELSE value_type END"),
            ("b_value_kind", "CASE WHEN k % 6 = 1 THEN 'null' ELSE value_kind END"),
            ("b_value_text", "CASE WHEN k % 6 = 1 THEN NULL WHEN k % 9 = 4 THEN '7' ELSE value_text END"),
            ("b_unit", "CASE WHEN k % 12 = 7 THEN 'kg' ELSE unit END"),
            ("b_computability", "computability"),
            ("b_evidence_text", "evidence_text"),
        ]

    plan = (*layer3_steps, rescue.terms, rescue.low_terms, rescue.candidates, rescue.judge_first, b_columns, rescue.b_usable, rescue.plan_a)
    _leaf("rescue_candidates", plan, "SELECT key_id, rescue_type_a, kind_a, stage_a, judge_first_a, rescue_type_b, kind_b, stage_b, judge_first_b FROM {leaf}", _CANDIDATES + "SELECT key_id, rescue_type_a, kind_a, stage_a, judge_first_a, rescue_type_b, kind_b, stage_b, 1 AS judge_first_b FROM cand")
    _leaf("rescue_plan", plan, "SELECT key_id, b_allowed, b_reason, only_no_anchor, plan_group, plan_priority, plan_strategy FROM {leaf}", _CANDIDATES + _PLAN)

    _leaf("rescue_plan_b", (*plan, rescue.plan_b), "SELECT key_id, plan_group_b, plan_priority_b, plan_strategy_b, plan_task_b, requires_llm_b, max_attempts_b, blocked_b FROM {leaf}", _CANDIDATES + _PLAN_B)
    _leaf("ranking_by_variant", ablation, lambda own: aggregates.ranking_by_variant(own.where("manual_label is not null").withColumn("risk_a", 1 - F.col("least_a")).withColumn("risk_signal", 1 - F.col("least_signal")), {"full": "risk_a", "signals": "risk_signal"}, "manual_label"), _RANKING, "least_a least_signal")
    _leaf("layer1_without_policy", (*layer3_steps, _blank_policy, values.issues, values.layer1_support), "SELECT key_id, semantic_l1, execution_l1, semantic_l1_reasons, execution_l1_reasons FROM {leaf}", _BLANK)
    answers = tuple(lambda d, b=b: rescue.wanted_answer(d, b) for b in "ab")
    given = tuple(lambda d, b=b: rescue.payload(b) for b in "ab")
    _leaf("candidate_payloads", (*plan, *answers, *given), "SELECT key_id, candidate_id_a, stage_order_a, payload_a, answers_a, answer_fields_a, candidate_id_b, stage_order_b, payload_b, answers_b FROM {leaf}", _CANDIDATES + _PAYLOADS)
    _leaf("plan_group_summary", plan, lambda own: joins.group_summary(own, "plan_group"), _CANDIDATES + _GROUP_SUMMARY, "plan_group manual_label")
    _leaf("run_first", plan, _subset, _CANDIDATES + _SUBSET, "key_id stage_a stage_b rescue_type_a rescue_type_b codes_1a")
    _leaf("carried_labels", (*layer3_steps, layer3.review_text), _carried, _CARRIED, "key_id compact_leaf manual_label k")
    _leaf("branch_label_shares", layer3_steps, _label_shares, _LABEL_SHARES, "key_id manual_label k")

    def applied(own: DataFrame) -> DataFrame:
        done = apply(own, rescue.overlay, rescue.validation)
        old = done.columns
        # Old fields stay beside the overlaid ones for the gate.
        # The structural codes of the overlaid leaf: the same function over other columns.
        swap = {f: f"c_{f}" for f in ("entity_type", "entity_text", "operator", "value_type", "value_kind", "value_text", "unit", "computability")} | {"non_computable_reason": "c_reason"}
        fixed = done.select(*(F.col(swap[c]).alias(c) if c in swap else F.col(c) for c in old if c not in ("codes_1a", "bits_codes_1a", "low_entity_text", "low_value_text")), F.col("codes_1a").alias("codes_before"), *(F.col(f).alias(f"old_{f}") for f in swap))
        again = apply(fixed.withColumn("low_entity_text", F.lower(F.trim(F.regexp_replace(F.coalesce("entity_text", F.lit("")), "[ \\t\\n\\r\\f]+", " ")))), layer1.structural_codes)
        news = F.array_except(F.split("codes_1a", ";"), F.split("codes_before", ";"))
        gated = apply(again.withColumn("new_errors", F.array_join(news, ";")), rescue.gate)
        return gated.select("key_id", "validation_errors", "new_errors", "skip_why", F.when(F.col("skip_why") == "", F.col("operator")).otherwise(F.col("old_operator")).alias("final_operator"))

    _leaf("applied_rescue", plan, applied, _CANDIDATES + _APPLIED)
    _SPARK["normal_leaves"], _SQL["normal_leaves"] = _normal, f"WITH leaf AS ({leaves_sql()})" + _NORMAL
    _leaf("ablation_by_variant", ablation, lambda own: aggregates.by_variant(own.where("manual_label is not null"), {"full": "risk_label", "signals": "signal_label"}, "manual_label"), _VARIANTS, "risk_label signal_label")
    _leaf("ablation_overlap", ablation, lambda own: aggregates.overlaps(own, F.col("risk_label") == "review_priority", F.col("signal_label") == "review_priority"), _OVERLAPS, "risk_label signal_label")
    _leaf("prioritised_sweep", layer3_steps, lambda own: aggregates.prioritised(own.where("manual_label is not null"), "semantic_support", "manual_label"), _SWEEP, "semantic_support")


def _blank_policy(d) -> list[tuple[str, str]]:
    """Every third leaf as from an inventory without a policy, some with few codes."""
    return [("all_codes", "CASE WHEN k % 5 = 1 THEN concat(substring_index(codes_1a, ';', 1), ';odd_partial_code; ') WHEN k % 5 = 2 THEN '' ELSE concat_ws(';', codes_1a, codes_1c, codes_1d) END"), ("policy_action", "CASE WHEN k % 3 <> 0 THEN action_b WHEN k % 2 = 0 THEN ' ' END")]


_RANKING = """, v AS (SELECT 'full' AS variant, round((1 - least_a) * 1000000) AS m, manual_label <> 'correct' AS e FROM labelled WHERE manual_label IS NOT NULL UNION ALL SELECT 'signals', round((1 - least(s_entity, s_operator, s_quant, s_time, s_history, s_context, s_comp)) * 1000000), manual_label <> 'correct' FROM labelled WHERE manual_label IS NOT NULL),
ranked AS (SELECT *, rank() OVER (PARTITION BY variant ORDER BY m) + (count(*) OVER (PARTITION BY variant, m) - 1) / 2 AS r, count(*) FILTER (e) OVER (PARTITION BY variant ORDER BY m DESC) AS tp, count(*) OVER (PARTITION BY variant ORDER BY m DESC) AS seen FROM v)
SELECT variant, count(*) AS labelled, count(*) FILTER (e) AS positives, round((sum(r) FILTER (e) - count(*) FILTER (e) * (count(*) FILTER (e) + 1) / 2) / (count(*) FILTER (e) * count(*) FILTER (NOT e)::DOUBLE), 9) AS auroc, round(avg(tp / seen) FILTER (e), 9) AS average_precision FROM ranked GROUP BY variant"""
_BLANK = f""", told AS (SELECT *, list_distinct(list_filter(list_transform(string_split(CASE WHEN k % 5 = 1 THEN split_part(codes_1a, ';', 1) || ';odd_partial_code; ' WHEN k % 5 = 2 THEN '' ELSE concat_ws(';', codes_1a, codes_1c, codes_1d) END, ';'), lambda c: trim(c)), lambda c: c <> '')) AS cs FROM final),
parted AS (SELECT *, list_filter(cs, lambda c: NOT list_contains([{', '.join(repr(c) for c in values.SEMANTIC)}], c) AND regexp_matches(c, 'computable_with_(exception_context|non_computable_reason)|non_computable|partial')) AS use_ FROM told), counted_issues AS (SELECT *, len(use_) AS m, len(cs) - len(use_) AS n, list_filter(cs, lambda c: NOT list_contains(use_, c)) AS mean_ FROM parted)
SELECT key_id, CASE WHEN k % 3 <> 0 THEN CASE WHEN n_hard_b > 0 THEN 0.5 WHEN action_b = 'continue_to_layer2_grounding_screen' THEN 0.8 ELSE 1 END WHEN n = 0 THEN 1 WHEN n = 1 THEN 0.65 WHEN n = 2 THEN 0.5 ELSE 0.35 END::DOUBLE AS semantic_l1,
  CASE WHEN k % 3 <> 0 THEN CASE WHEN action_b = 'computability_review_candidate' THEN 0.7 WHEN len(cs) = 0 THEN 1 ELSE 0.9 END WHEN m = 0 THEN CASE WHEN len(cs) = 0 THEN 1 ELSE 0.9 END WHEN m = 1 THEN 0.7 WHEN m = 2 THEN 0.55 ELSE 0.4 END::DOUBLE AS execution_l1,
  CASE WHEN k % 3 <> 0 THEN CASE WHEN n_hard_b > 0 THEN 'layer1_policy:hard_semantic_or_structural_issue' WHEN action_b = 'continue_to_layer2_grounding_screen' THEN 'layer1_policy:soft_semantic_warning' ELSE '' END ELSE array_to_string(list_transform(list_sort(mean_), lambda c: 'layer1_semantic:' || c), ';') END AS semantic_l1_reasons,
  CASE WHEN k % 3 <> 0 THEN CASE WHEN action_b = 'computability_review_candidate' THEN 'layer1_execution:layer1_policy_execution_issue' ELSE '' END ELSE array_to_string(list_transform(list_sort(use_), lambda c: 'layer1_execution:' || c), ';') END AS execution_l1_reasons FROM counted_issues"""


_PART = "list_filter(string_split({0}, ';'), lambda c: c <> '')"
_STAGED = "CASE substr({0}, 1, 2) WHEN 'P1' THEN CASE WHEN {0} LIKE '%conservative%' THEN 1 ELSE 2 END WHEN 'P2' THEN 3 WHEN 'P3' THEN 4 WHEN 'P4' THEN 5 ELSE 99 END"
_ANSWERED = "CASE WHEN {0} THEN 'accept | minor_fix | reextract_leaf | mark_partial_or_non_computable | human_review | no_repair_possible' WHEN {1} LIKE '%!_recovery' ESCAPE '!' AND regexp_matches({1}, '^(list|range|scalar)') THEN 'repaired | no_repair_possible | human_review' ELSE 'repaired | no_repair_possible | human_review | mark_partial_or_non_computable' END"


def _payload_sql(branch: str, labels: str, reasons: str) -> str:
    parts = _PART.format("concat_ws(';', codes_1a, codes_1b, codes_1c, codes_1d)")
    ordered = f"list_filter({parts}, lambda c, i: list_position({parts}, c) = i)"
    issues = "list_filter(string_split(codes_1a, ';'), lambda c: list_contains(['list_operator_without_list_value', 'range_with_both_bounds_missing', 'comparison_without_scalar_value'], c))"
    diagnosis = f"{{'action': decision_{branch}, 'family': family_{branch}, 'codes': {ordered}, {labels}, 'reasons': {_PART.format(reasons)}, 'conservative_issues': {issues}}}"
    return f"to_json({{'task_type': rescue_type_{branch}, 'branch': '{branch.upper()}', 'document_id': document_id, 'criterion_id': key_id, 'evidence_text': trim(evidence_text), 'diagnosis': {diagnosis}}})::VARCHAR AS payload_{branch}"


_LABEL_A, _LABEL_B = "'risk_label': risk_label", "'routing': routing, 'semantic_label': semantic_label"
_PAYLOADS = f"SELECT key_id, 'A__' || key_id || '__' || rescue_type_a AS candidate_id_a, {_STAGED.format('stage_a')} AS stage_order_a, {_payload_sql('a', _LABEL_A, 'risk_reasons')}, {_ANSWERED.format('judge_first_a = 1', 'rescue_type_a')} AS answers_a, CASE WHEN judge_first_a = 1 THEN 'entity_text;entity_type;operator;value;unit;temporal_context;history_context;condition_exception_context;computability' WHEN rescue_type_a = 'list_value_recovery' THEN 'value_type;value' WHEN rescue_type_a IN ('range_bounds_recovery', 'scalar_value_recovery') THEN 'value_type;value;unit' ELSE '' END AS answer_fields_a, 'B__' || key_id || '__' || rescue_type_b AS candidate_id_b, {_STAGED.format('stage_b')} AS stage_order_b, {_payload_sql('b', _LABEL_B, 'semantic_reasons')}, {_ANSWERED.format('true', 'rescue_type_b')} AS answers_b FROM cand"


def _subset(own: DataFrame) -> DataFrame:
    """Both branches' candidates as rows; some without an id or under the wrong branch."""
    sides = [own.select("key_id", F.lit(b.upper()).alias("side"), F.when(F.col("k") % 21 == 4, None).otherwise(F.concat(F.lit(b.upper()), F.lit(":"), "key_id")).alias("candidate_id"), F.col(f"stage_{b}").alias("run_stage"), F.when(F.col("k") % 25 == 6, "A").otherwise(F.lit(b.upper())).alias("branch"), F.col(f"rescue_type_{b}").alias("rescue_task_type"), F.when(F.col("k") % 10 != 3, labels.conservative_issues("codes_1a")).alias("conservative_issues")) for b in "ab"]
    return labels.run_first(sides[0].unionByName(sides[1])).select("key_id", "side", "selected_for_p1", "p1_group", "not_selected_reason", "review_only", "p1_errors")


_PLAN_B = "SELECT key_id, split_part(p, '|', 1) AS plan_group_b, split_part(p, '|', 2)::INT AS plan_priority_b, split_part(p, '|', 3) AS plan_strategy_b, CASE WHEN p LIKE 'B!_accept%' ESCAPE '!' THEN 'none' ELSE rescue_type_b END AS plan_task_b, (p LIKE 'B!_main%' ESCAPE '!')::INT AS requires_llm_b, CASE WHEN p LIKE 'B!_main%' ESCAPE '!' THEN 3 ELSE 0 END AS max_attempts_b, (p LIKE 'B!_blocked%' ESCAPE '!')::INT AS blocked_b FROM (SELECT *, CASE WHEN stage_b LIKE 'P1!_%mandatory%' ESCAPE '!' THEN 'B_main_llm_rescue|25|branch_b_dejure_judge_repair_loop' WHEN 'keep_without_layer2_action' IN (routing, replace(decision_b, '_candidate', '')) THEN 'B_accept_no_change_reference|5|keep_without_layer2_action_reference' ELSE 'B_blocked_or_manual_review|85|optional_branch_b_review_not_main_rescue' END AS p FROM cand)"
_SUBSET = """, sides AS (SELECT key_id, 'A' AS side, k, codes_1a, stage_a AS stage, rescue_type_a AS task FROM cand UNION ALL SELECT key_id, 'B', k, codes_1a, stage_b, rescue_type_b FROM cand),
told AS (SELECT *, stage LIKE 'P1!_%' ESCAPE '!' AS ran, CASE WHEN k % 21 = 4 THEN '' ELSE side || ':' || key_id END AS cid, CASE WHEN k % 25 = 6 THEN 'A' ELSE side END AS own, len(list_intersect(string_split(codes_1a, ';'), ['list_operator_without_list_value','range_with_both_bounds_missing','comparison_without_scalar_value'])) > 0 AND k % 10 <> 3 AS issues FROM sides)
SELECT key_id, side, ran::INT AS selected_for_p1, CASE WHEN stage LIKE '%conservative%' THEN 'p1_conservative_structural_recovery' WHEN ran THEN 'p1_branch_b_mandatory_llm_judge' ELSE '' END AS p1_group, CASE WHEN ran THEN '' ELSE 'not_p1_run_stage:' || stage END AS not_selected_reason, (ran AND task LIKE 'duplicate%')::INT AS review_only,
  CASE WHEN NOT ran THEN '' ELSE array_to_string(list_sort(list_filter([CASE WHEN cid = '' THEN 'missing_candidate_id' END, CASE WHEN stage LIKE '%mandatory%' AND own <> 'B' THEN cid || ':branch_b_stage_but_branch_is_' || own END, CASE WHEN stage LIKE '%conservative%' AND NOT issues THEN cid || ':conservative_stage_without_conservative_issues' END, CASE WHEN task LIKE 'duplicate%' THEN cid || ':duplicate_task_should_be_review_only_not_executed' END], lambda x: x IS NOT NULL)), ';') END AS p1_errors FROM told"""
#: Labels as people write them, by remainder.
_WRITTEN = "CASE k % 9 WHEN 0 THEN upper(manual_label) WHEN 1 THEN ' partially   correct ' WHEN 2 THEN 'N/A' WHEN 3 THEN 'rather incorrect, see note' WHEN 4 THEN 'P' WHEN 5 THEN 'mostly correct' WHEN 6 THEN '' WHEN 7 THEN 'unclear' ELSE manual_label END"


def _carried(own: DataFrame) -> DataFrame:
    """Leaves whose text changed, that have no earlier row, or no earlier label."""
    rows = own.withColumn("written", F.expr(_WRITTEN)).withColumn("pre_leaf", F.expr("CASE WHEN k % 4 = 1 THEN concat(compact_leaf, ' | changed') ELSE concat(' ', replace(compact_leaf, ' ', '  ')) END"))
    step = lambda d: [("normal", labels.normal_label(d, "written")), *labels.copied(d, "pre_leaf", "compact_leaf", "written", "CASE WHEN k % 2 = 0 THEN 'wrong entity' END", "k % 13 <> 5")]
    return apply(rows, step).select("key_id", "normal", "post_label", "post_issue", "copy_status")


_CARRIED = f""", own AS (SELECT *, {_WRITTEN} AS written FROM final), form AS (SELECT *, trim(regexp_replace(coalesce(written, ''), ' +', ' ', 'g')) AS clean FROM own)
SELECT key_id, CASE WHEN lower(clean) IN ('', 'n/a') THEN NULL WHEN lower(clean) IN ('p') OR contains(lower(clean), 'partial') THEN 'partial' WHEN contains(lower(clean), 'incorrect') THEN 'incorrect' WHEN contains(lower(clean), 'correct') THEN 'correct' END AS normal,
  CASE WHEN k % 13 <> 5 AND k % 4 <> 1 THEN clean ELSE '' END AS post_label, CASE WHEN k % 13 <> 5 AND k % 4 <> 1 AND clean <> '' AND k % 2 = 0 THEN 'wrong entity' ELSE '' END AS post_issue,
  CASE WHEN k % 13 = 5 THEN 'no_pre_row' WHEN k % 4 = 1 THEN 'changed' WHEN clean = '' THEN 'unchanged_but_old_label_missing' ELSE 'copied' END AS copy_status FROM form"""


def _label_shares(own: DataFrame) -> DataFrame:
    """Branch B against branch A by labels, the better one, and the label of the branch chosen (here by remainder)."""
    step = lambda d: [("la", labels.normal_label(d, "manual_label")), ("lb", labels.normal_label(d, _WRITTEN)), ("branch", "CASE WHEN k % 3 = 0 THEN 'A' ELSE 'B' END")]
    rows = apply(own, step, lambda d: [*labels.compared(d, "la", "lb"), *labels.chosen_label(d, "branch", "la", "lb")])
    out = [labels.shares(rows, c, none).withColumn("what", F.lit(c)) for c, none in (("b_vs_a", ("unlabeled",)), ("inferred_best", ("",)), ("chosen_label", ()))]
    return out[0].unionByName(out[1]).unionByName(out[2])


_LABEL_SHARES = f""", form AS (SELECT k, manual_label AS la, trim(regexp_replace(coalesce({_WRITTEN}, ''), ' +', ' ', 'g')) AS w FROM final), both_labels AS (SELECT k, la, CASE WHEN lower(w) IN ('', 'n/a') THEN NULL WHEN lower(w) = 'p' OR contains(lower(w), 'partial') THEN 'partial' WHEN contains(lower(w), 'incorrect') THEN 'incorrect' WHEN contains(lower(w), 'correct') THEN 'correct' END AS lb FROM form),
label_scores AS (SELECT *, list_position(['incorrect', 'partial', 'correct'], la) AS a, list_position(['incorrect', 'partial', 'correct'], lb) AS b FROM both_labels),
told AS (SELECT 'b_vs_a' AS what, CASE WHEN b > a THEN 'B_better_than_A' WHEN b < a THEN 'B_worse_than_A' ELSE 'B_same_as_A' END AS value FROM label_scores WHERE a IS NOT NULL AND b IS NOT NULL
  UNION ALL SELECT 'inferred_best', CASE WHEN a = 1 AND b = 1 THEN 'none' WHEN a > b THEN 'A' WHEN b > a THEN 'B' ELSE 'tie' END FROM label_scores WHERE a IS NOT NULL AND b IS NOT NULL
  UNION ALL SELECT 'chosen_label', CASE WHEN k % 3 = 0 THEN la ELSE lb END FROM label_scores WHERE CASE WHEN k % 3 = 0 THEN la ELSE lb END IS NOT NULL)
SELECT what, value, n, sum(n) OVER (PARTITION BY what)::BIGINT AS "of", round(100.0 * n / sum(n) OVER (PARTITION BY what), 2) AS percent FROM (SELECT what, value, count(*) AS n FROM told GROUP BY ALL)"""


def _normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves as a model might write them: relations as operators, words for null."""
    own = leaves(spark, sf_dir).withColumn("operator", F.expr("CASE WHEN k % 15 = 4 THEN 'within' ELSE operator END")).withColumn("unit", F.expr("CASE WHEN k % 18 = 2 THEN ' None' ELSE unit END"))
    own = apply(own, normalise.nulls, normalise.normal_leaf)
    return own.select("key_id", *(c for c in own.columns if c.startswith("n_")))


_HAS = "regexp_matches(lower({0}), '{1}')"
_TYPES = tuple((task, "|".join(terms)) for task, terms in rescue.TASK_TERMS)


def _type(said: str, default: str) -> str:
    first = "WHEN list_contains(string_split(codes_1a, ';'), 'list_operator_without_list_value') THEN 'list_value_recovery' WHEN list_contains(string_split(codes_1a, ';'), 'range_with_both_bounds_missing') THEN 'range_bounds_recovery' WHEN list_contains(string_split(codes_1a, ';'), 'comparison_without_scalar_value') THEN 'scalar_value_recovery' "
    return "CASE " + first + " ".join(f"WHEN {_HAS.format(said, p)} THEN '{t}'" for t, p in _TYPES) + f" ELSE '{default}' END"


_CANDIDATES = f""",
termed AS (SELECT *, concat_ws(';', codes_1a, codes_1b, codes_1c, codes_1d, risk_reasons, action_a) AS ta, concat_ws(';', codes_1a, codes_1b, codes_1c, codes_1d, semantic_reasons, routing_reason, action_b) AS tb,
  len(list_intersect(string_split(codes_1a, ';'), ['list_operator_without_list_value','comparison_without_scalar_value','range_with_both_bounds_missing'])) > 0 AS cons FROM final),
typed AS (SELECT *, {_type('ta', 'branch_a_field_level_semantic_rescue')} AS rescue_type_a, {_type('tb', 'branch_b_field_level_semantic_judge')} AS rescue_type_b FROM termed),
cand AS (SELECT *,
  CASE WHEN cons THEN 'conservative_structural_recovery_before_downgrade' WHEN decision_a LIKE 'targeted%' THEN 'mandatory_llm_rescue_or_judge' WHEN decision_a LIKE 'optional%' THEN 'optional_llm_rescue_or_review' ELSE 'other' END AS kind_a,
  CASE WHEN cons THEN 'conservative_structural_recovery_before_downgrade' WHEN decision_b LIKE 'targeted%' THEN 'mandatory_llm_rescue_or_judge' WHEN decision_b LIKE 'optional%' THEN 'optional_llm_rescue_or_review' ELSE 'other' END AS kind_b,
  CASE WHEN cons THEN 'P1_run_now_conservative_structural_recovery' WHEN decision_a LIKE 'targeted%' THEN 'P3_branch_a_mandatory_diagnostic_rescue_or_ablation' WHEN decision_a LIKE 'optional%' THEN 'P4_branch_a_optional_diagnostic_rescue' ELSE 'P9_not_scheduled' END AS stage_a,
  CASE WHEN cons THEN 'P1_run_now_conservative_structural_recovery' WHEN decision_b LIKE 'targeted%' THEN 'P1_run_now_branch_b_mandatory_judge' WHEN decision_b LIKE 'optional%' THEN 'P2_budget_allows_branch_b_optional_judge' ELSE 'P9_not_scheduled' END AS stage_b,
  (NOT cons AND rescue_type_a IN ('branch_a_field_level_semantic_rescue', 'duplicate_prune_or_merge_judge', 'condition_exception_context_recovery'))::INT AS judge_first_a,
  k % 7 <> 5 AS bf, CASE WHEN k % 8 = 5 THEN 'severe ' || entity_text WHEN k % 8 = 6 THEN '' ELSE entity_text END AS b_ent,
  CASE WHEN k % 6 = 1 THEN 'exists' ELSE operator END AS b_op FROM typed)
"""
_PLAN = """, asked AS (SELECT *, len(list_intersect(string_split(ta, ';'), ['entity_not_in_evidence','entity_not_grounded','entity_not_grounded_in_evidence_or_item','entity_text_empty','generic_entity_text','critical_qualifier_missing_from_entity','entity_type_not_supported_by_best_anchor','entity_text_not_aligned_with_any_anchor'])) > 0 AS ent_terms,
  len(list_intersect(string_split(ta, ';'), ['temporal_marker_without_temporal_context','history_marker_without_history_context','condition_context_present_without_handling','value_missing_with_quantitative_cue','quantitative_cue_unhandled','negation_clause_with_exists_operator','positive_clause_with_not_exists_operator','negative_entity_with_not_exists_operator'])) > 0 AS field_terms,
  len(list_intersect(string_split(tb, ';'), ['negation_clause_with_exists_operator','positive_clause_with_not_exists_operator','negative_entity_with_not_exists_operator'])) > 0 AS polar FROM cand),
blocked AS (SELECT *, CASE WHEN NOT bf THEN 'no_matching_branch_b_decision_row' WHEN trim(b_ent) = '' THEN 'branch_b_missing_entity_text' WHEN trim(evidence_text) = '' THEN 'branch_b_missing_evidence_text' WHEN polar THEN 'branch_b_polarity_problem' WHEN cons THEN 'branch_b_structural_value_problem' END AS block,
  concat_ws(';', CASE WHEN computability = 'non_computable' THEN 'branch_b_non_computable' END, CASE WHEN len(list_intersect(string_split(tb, ';'), ['condition_context_present','condition_context_present_without_handling','exception_or_condition_clause_without_context_handling','exception_clause_computable_despite_context','computable_with_exception_context','condition_exception','exception_context'])) > 0 THEN 'branch_b_context_or_exception_scope_problem' END) AS soft,
  list_contains(string_split(ta, ';'), 'no_bert_anchor') AND NOT ent_terms AND NOT cons AND NOT field_terms AS only_no_anchor FROM asked),
placed AS (SELECT *, CASE WHEN cons THEN 'A_main_llm_rescue|10|recover_structural_information_or_abstain'
  WHEN rescue_type_a = 'condition_exception_context_recovery' OR len(list_intersect(string_split(ta, ';'), ['condition_context_present_without_handling','exception_or_condition_clause_without_context_handling','exception_clause_computable_despite_context','computable_with_exception_context'])) > 0 THEN 'A_status_or_review|30|abstain_or_human_review_for_context_logic'
  WHEN rescue_type_a IN ('duplicate_prune_or_merge_judge', 'branch_a_field_level_semantic_rescue') THEN 'A_deferred_diagnostic|90|defer_broad_or_duplicate_task' WHEN only_no_anchor THEN 'A_deferred_diagnostic|80|defer_no_bert_anchor_only'
  WHEN rescue_type_a IN ('list_value_recovery','range_bounds_recovery','scalar_value_recovery','value_or_operator_recovery','temporal_context_recovery','history_context_recovery','polarity_negation_repair') THEN 'A_main_llm_rescue|20|targeted_field_recovery_with_candidate_check'
  WHEN rescue_type_a IN ('entity_regrounding', 'entity_type_reclassification') OR ent_terms THEN 'A_main_llm_rescue|25|entity_candidate_selection_not_anchor_only' ELSE 'A_deferred_diagnostic|95|defer_non_actionable_high_risk' END AS p FROM blocked)
SELECT key_id, block IS NULL AS b_allowed, coalesce(block, 'branch_b_available_as_candidate_routing:' || routing || CASE WHEN soft = '' THEN '' ELSE '|soft_warning:' || soft END) AS b_reason, only_no_anchor, split_part(p, '|', 1) AS plan_group, split_part(p, '|', 2)::INT AS plan_priority, split_part(p, '|', 3) AS plan_strategy FROM placed
"""
_GROUP_SUMMARY = _PLAN[: _PLAN.rindex("SELECT key_id, block IS NULL")] + "SELECT split_part(p, '|', 1) AS plan_group, count(*) AS n, count(manual_label) AS labelled, count(*) FILTER (manual_label = 'correct') AS n_correct, count(*) FILTER (manual_label = 'partial') AS n_partial, count(*) FILTER (manual_label = 'incorrect') AS n_incorrect, round(count(manual_label) / count(*), 6) AS label_coverage, CASE WHEN count(manual_label) > 0 THEN round(count(*) FILTER (manual_label <> 'correct') / count(manual_label), 6) END AS error_rate FROM placed GROUP BY ALL"
_VALIDATION = """
missing_entity_text: n_ce = ''
missing_evidence_text: n_ev = ''
entity_type_not_allowed: NOT list_contains(['condition','drug','procedure','lab','demographic','therapy','biomarker','vital','observation','stage','line_of_therapy','other'], ct)
operator_not_allowed: NOT list_contains(['exists','not_exists','=','!=','<','<=','>','>=','between','in','not_in','contains','matches'], co)
value_type_not_allowed: NOT list_contains(['scalar','list','range','null'], cv)
computability_not_allowed: NOT list_contains(['computable','partial','non_computable'], computability)
history_context_not_allowed: NOT list_contains(['current','prior','previously_treated','stable_dose','investigational_use','other'], history_context)
temporal_relation_not_allowed: tc AND NOT coalesce(list_contains(['before','after','during','within','since'], t_relation), false)
temporal_unit_not_allowed: NOT list_contains(['hour','day','week','month','year'], t_unit)
temporal_anchor_event_not_allowed: tc AND NOT coalesce(list_contains(['screening','randomization','treatment_start','diagnosis','index_date','surgery','procedure','baseline','other'], t_anchor), false)
null_value_type_with_nonnull_value: cv = 'null' AND ck <> 'null'
scalar_value_type_with_invalid_value: cv = 'scalar' AND ck IN ('null', 'list', 'range')
list_value_type_with_invalid_value: cv = 'list' AND (ck <> 'list' OR coalesce(cx, '') = '')
range_value_type_with_invalid_value: cv = 'range' AND ck <> 'range'
range_with_both_bounds_missing: cv = 'range' AND ck = 'range' AND coalesce(value_min, value_max) IS NULL
comparison_operator_without_scalar_value: co IN ('<','<=','>','>=','=','!=') AND NOT (cv = 'scalar' AND ck <> 'null')
between_operator_without_range_value: co = 'between' AND cv <> 'range'
list_operator_without_list_value: co IN ('in', 'not_in') AND cv <> 'list'
existence_operator_with_non_null_value_type: co IN ('exists', 'not_exists') AND cv <> 'null'
entity_text_not_in_source_context: n_ce <> '' AND n_ev <> '' AND NOT contains(n_clause || ' ' || n_item || ' ' || n_ev, n_ce)
"""
_AGAIN = oracle._CODES_1A.replace("n_ent = ''", "n_ce = ''").replace("cmp AND", "co IN ('<', '<=', '>', '>=') AND").replace("NOT ex", "NOT co IN ('exists', 'not_exists')").replace("ex AND (", "co IN ('exists', 'not_exists') AND (")
for _old, _new in (("value_kind", "ck"), ("value_type IS", "cv IS"), ("entity_type IS", "ct IS"), (" value_type ", " cv "), ("(value_type ", "(cv "), (", value_type)", ", cv)"), (", entity_type)", ", ct)"), ("value_text", "cx"), ("non_computable_reason, ''", "cr, ''")):
    _AGAIN = _AGAIN.replace(_old, _new)
_AGAIN = "\n".join((line.split(": ", 1)[0] + ": " + line.split(": ", 1)[1].replace("operator ", "co ").replace(", operator)", ", co)").replace("unit <>", "cu <>")) if ": " in line else line for line in _AGAIN.splitlines())
_AGAIN = _AGAIN.replace("\ncx", "\nvalue_text").replace(": value_type = ", ": cv = ")
_APPLIED = f""", laid AS (SELECT *, CASE WHEN NOT bf THEN entity_type WHEN k % 10 = 3 THEN 'other' ELSE entity_type END AS ct, CASE WHEN bf THEN b_ent ELSE entity_text END AS ce,
  CASE WHEN bf AND NOT (operator = 'not_exists' AND b_op = 'exists' AND rescue_type_a <> 'polarity_negation_repair') THEN b_op ELSE operator END AS co,
  CASE WHEN bf AND k % 6 = 1 THEN 'null' ELSE value_type END AS cv, CASE WHEN bf AND k % 12 = 7 THEN 'kg' ELSE unit END AS cu,
  CASE WHEN computability = 'non_computable' AND trim(coalesce(non_computable_reason, '')) = '' THEN 'Marked' ELSE non_computable_reason END AS cr FROM cand),
laid2 AS (SELECT *, CASE WHEN cv = 'null' THEN 'null' ELSE value_kind END AS ck, CASE WHEN cv = 'null' THEN NULL WHEN bf AND k % 6 <> 1 AND k % 9 = 4 THEN '7' ELSE value_text END AS cx, {oracle._N.format('ce')} AS n_ce FROM laid),
checked AS (SELECT *, {oracle._codes(_VALIDATION)} AS validation_errors, {oracle._codes(_AGAIN)} AS again FROM laid2),
gated AS (SELECT *, array_to_string(list_filter(string_split(again, ';'), lambda c: NOT list_contains(string_split(codes_1a, ';'), c)), ';') AS new_errors FROM checked),
whys AS (SELECT *, CASE WHEN coalesce(rescue_decision, '') <> 'select_candidate' THEN 'not_applicable_final_decision:' || coalesce(rescue_decision, '') WHEN validation_errors <> '' THEN 'local_validation_not_pass:fail' WHEN NOT bf THEN 'selected_leaf_missing_or_not_object' WHEN (ct, ce, co, cv, ck, cu, coalesce(cx, '~'), coalesce(cr, '~')) IS NOT DISTINCT FROM (entity_type, entity_text, operator, value_type, value_kind, unit, coalesce(value_text, '~'), coalesce(non_computable_reason, '~')) THEN 'candidate_identical_to_target_leaf' WHEN new_errors <> '' THEN 'full_ast_schema_new_invalid:' || new_errors ELSE '' END AS skip_why FROM gated)
SELECT key_id, validation_errors, new_errors, skip_why, CASE WHEN skip_why = '' THEN co ELSE operator END AS final_operator FROM whys
"""
_NORMAL = """, w AS (SELECT *, k % 15 = 4 AS misuse, coalesce(t_relation, t_value, t_unit, t_anchor) IS NOT NULL AS given, CASE WHEN lower(trim(value_text)) NOT IN ('null','none','') THEN value_text END AS wv, CASE WHEN k % 18 <> 2 THEN unit END AS wu FROM leaf)
SELECT key_id, CASE WHEN misuse THEN 'exists' ELSE operator END AS n_operator, CASE WHEN misuse THEN 'null' ELSE value_type END AS n_value_type, CASE WHEN misuse OR (wv IS NULL AND value_kind IN ('string', 'number')) THEN 'null' ELSE value_kind END AS n_value_kind, CASE WHEN misuse THEN NULL ELSE wv END AS n_value_text, CASE WHEN misuse THEN NULL ELSE wu END AS n_unit,
  CASE WHEN NOT given THEN CASE WHEN misuse THEN 'within' END WHEN t_relation IN ('before','after','during','within','since') THEN t_relation ELSE 'during' END AS n_t_relation, CASE WHEN misuse AND NOT given THEN wv ELSE t_value END AS n_t_value,
  CASE WHEN misuse AND NOT given THEN CASE WHEN wu IN ('hour','day','week','month','year') THEN wu END WHEN t_unit IN ('hour','day','week','month','year') THEN t_unit END AS n_t_unit,
  CASE WHEN NOT given THEN CASE WHEN misuse THEN 'other' END WHEN t_anchor IN ('screening','randomization','treatment_start','diagnosis','index_date','surgery','procedure','baseline','other') THEN t_anchor ELSE 'other' END AS n_t_anchor,
  CASE WHEN history_context IS NULL OR history_context IN ('current','prior','previously_treated','stable_dose','investigational_use','other') THEN history_context ELSE 'other' END AS n_history FROM w
"""
_LEAST = "least(s_entity, s_operator, s_quant, s_time, s_history, s_context, s_comp)"
_VARIANTS = f"SELECT variant, risk, count(*) AS n, count(*) FILTER (e) AS errors, round(count(*) FILTER (e) / count(*), 6) AS error_rate FROM (SELECT 'full' AS variant, risk_label AS risk, manual_label IN ('partial', 'incorrect') AS e FROM labelled WHERE manual_label IS NOT NULL UNION ALL SELECT 'signals', {oracle._BANDS.format(_LEAST, '')}, manual_label IN ('partial', 'incorrect') FROM labelled WHERE manual_label IS NOT NULL) GROUP BY ALL"
_OVERLAPS = f"SELECT count(*) FILTER (a AND b) AS \"both\", count(*) FILTER (a AND NOT b) AS only_first, count(*) FILTER (b AND NOT a) AS only_second, count(*) FILTER (NOT a AND NOT b) AS neither FROM (SELECT least_a < 0.6 AS a, {_LEAST} < 0.6 AS b FROM labelled)"
_SWEEP = "SELECT t::INT AS percent, count(*) FILTER (p) AS n_below, count(*) FILTER (p AND e) AS errors_below, count(*) FILTER (p AND manual_label = 'incorrect') AS wrong_below, round(count(*) FILTER (p) / count(*), 6) AS coverage, CASE WHEN count(*) FILTER (p) = 0 THEN 0 ELSE round(count(*) FILTER (p AND e) / count(*) FILTER (p), 6) END AS error_rate, round(count(*) FILTER (p AND e) / count(*) FILTER (e), 6) AS error_recall FROM (SELECT t, manual_label, manual_label IN ('partial', 'incorrect') AS e, round(sem * 1000000) < t * 10000 AS p FROM joined_b, (SELECT unnest(range(40, 96, 5)) AS t) WHERE manual_label IS NOT NULL) GROUP BY t"


def queries() -> dict:
    return dict(_SPARK)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
