"""Selected candidates applied to rule trees: gates, overlay of fields, checks before and after, audit.

Trees are (branch, document_id, doc); results are (plan_id, ord, branch_to_update, criterion_id,
final_decision, local_validation_status, rescue_task_type, selected_leaf), with the leaf as JSON
text. Of results with one plan the last counts; several plans of one criterion are applied one after
the other, with results and the trees between written to the shared folder. Leaves are compared and overlaid as maps of field to canonical JSON, so no field has
a column of its own and contexts are taken over whole.

A candidate is stopped by schema errors (path and message) that the leaf did not have before;
errors elsewhere in the tree do not count against it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.dialect import apply
from ..sources.shared import written
from . import nested, validate
from .layer1 import ANCHORS, COMPARISONS, COMPUTABILITY, ENTITY_TYPES, EQUALITIES, EXISTENCE, HISTORY, LISTS, OPERATORS, RELATIONS, UNITS, VALUE_TYPES
from .rescue import APPLICABLE

# Fields that a candidate may change, and keys of a time.
FIELDS = ("entity_text", "entity_type", "normalized_concept", "operator", "value", "value_type", "unit", "temporal_context", "history_context", "negated", "computability", "non_computable_reason", "evidence_text")
TEMPORAL_KEYS = ("relation", "value", "unit", "anchor_event")
REASON = "Marked non-computable by Layer 3 candidate-selection rescue."


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _json(m: str, key: str) -> str:
    """JSON text of a field; 'null' if it is missing."""
    return f"coalesce(try_element_at({m}, '{key}'), 'null')"


def _plain(json: str) -> str:
    """The value of a JSON text as plain text; null for null."""
    return f"get_json_object(concat('{{\"x\":', {json}, '}}'), '$.x')"


def _said(json: str) -> str:
    return f"coalesce({_plain(json)}, 'None')"


def last_results(results: DataFrame) -> DataFrame:
    """The last result of each plan; results without a plan are left out."""
    plan = F.trim(F.coalesce("plan_id", F.lit("")))
    newest = Window.partitionBy("plan_id").orderBy(F.desc("ord"))
    return results.withColumn("plan_id", plan).where("plan_id <> ''").withColumn("nth", F.row_number().over(newest)).where("nth = 1").drop("nth")


def overlaid(old: str, selected: str) -> str:
    """SQL of the candidate: the old leaf with the selected leaf's fields, contexts included; its id stays."""
    # A time written as an empty or null text is none.
    time = f"CASE WHEN {_json('c', 'temporal_context')} IN ('\"\"', '\"null\"', '\"None\"') THEN 'null' ELSE {_json('c', 'temporal_context')} END"
    value = f"CASE WHEN {_json('c', 'value_type')} = '\"null\"' THEN 'null' ELSE try_element_at(c, 'value') END"
    no_reason = f"trim(coalesce({_plain(_json('c', 'non_computable_reason'))}, '')) = ''"
    reason = f"CASE WHEN {_json('c', 'computability')} = '\"non_computable\"' AND {no_reason} THEN '\"{REASON}\"' ELSE try_element_at(c, 'non_computable_reason') END"
    # Negation may change only where polarity is the task.
    negated = f"CASE WHEN {_json(old, 'negated')} <> {_json('c', 'negated')} AND coalesce(trim(rescue_task_type), '') <> 'polarity_negation_repair' THEN {_json(old, 'negated')} ELSE try_element_at(c, 'negated') END"
    ruled = {"temporal_context": time, "value": value, "non_computable_reason": reason, "negated": negated}
    rest = f"map_filter(c, (k, v) -> NOT k IN ({_list(ruled)}))"
    news = ", ".join(f"struct('{k}' AS key, {e} AS value)" for k, e in ruled.items())
    merged = f"map_concat(map_filter({old}, (k, v) -> NOT (k IN ({_list(FIELDS)}) AND map_contains_key({selected}, k))), map_filter({selected}, (k, v) -> k IN ({_list(FIELDS)})))"
    return f"element_at(transform(array({merged}), c -> map_concat({rest}, map_from_entries(filter(array({news}), x -> x.value IS NOT NULL)))), 1)"


def consistency_reasons(m: str) -> list[tuple[str, str]]:
    """Reasons why a leaf's value does not go with its type and operator: name and test, in their order."""
    kind, operator, value = (_json(m, k) for k in ("value_type", "operator", "value"))
    one = lambda x, names: "{} IN ({})".format(x, ", ".join(f"'\"{n}\"'" for n in names))
    none, a_list, an_object = f"{value} = 'null'", f"startswith({value}, '[')", f"startswith({value}, '{{')"
    bounds = f"(json_object_keys({value}) IS NOT NULL AND array_contains(json_object_keys({value}), 'min') AND array_contains(json_object_keys({value}), 'max'))"
    is_kind = lambda k: one(kind, (k,))
    return [
        ("null_value_type_with_nonnull_value", f"{is_kind('null')} AND NOT {none}"),
        ("scalar_value_type_with_invalid_value", f"{is_kind('scalar')} AND ({none} OR {a_list} OR {an_object})"),
        ("list_value_type_with_invalid_value", f"{is_kind('list')} AND (NOT {a_list} OR {value} = '[]')"),
        ("range_value_type_with_invalid_value", f"{is_kind('range')} AND NOT {an_object}"),
        ("range_value_missing_min_or_max_keys", f"{is_kind('range')} AND {an_object} AND NOT {bounds}"),
        ("range_with_both_bounds_missing", f"{is_kind('range')} AND {an_object} AND {bounds} AND get_json_object({value}, '$.min') IS NULL AND get_json_object({value}, '$.max') IS NULL"),
        ("comparison_operator_without_scalar_value", f"{one(operator, (*COMPARISONS, *EQUALITIES))} AND (NOT {is_kind('scalar')} OR {none})"),
        ("between_operator_without_range_value", f"{one(operator, ('between',))} AND NOT {is_kind('range')}"),
        ("list_operator_without_list_value", f"{one(operator, LISTS)} AND NOT {is_kind('list')}"),
        ("existence_operator_with_non_null_value_type", f"{one(operator, EXISTENCE)} AND NOT {is_kind('null')}"),
    ]


def leaf_reasons(m: str) -> str:
    """SQL of all reasons against a leaf, in their order, joined by bars; empty if there is none."""
    text = lambda k: f"trim(coalesce({_plain(_json(m, k))}, ''))"
    allowed = lambda j, names: "{} IN ({})".format(j, ", ".join(f"'\"{n}\"'" for n in names))
    time = _json(m, "temporal_context")
    part = lambda k: f"coalesce(get_json_object({time}, '$.{k}'), 'None')"
    an_object, given = f"startswith({time}, '{{')", f"{time} <> 'null'"
    odd = f"array_sort(array_except(json_object_keys({time}), array({_list(TEMPORAL_KEYS)})))"
    named = lambda name, key, names: (f"NOT {allowed(_json(m, key), names)}", f"concat('{name}_not_allowed:', {_said(_json(m, key))})")
    rules = [
        (f"{text('criterion_id')} = ''", "'missing_criterion_id'"),
        (f"{text('entity_text')} = ''", "'missing_entity_text'"),
        (f"{text('evidence_text')} = ''", "'missing_evidence_text'"),
        named("entity_type", "entity_type", ENTITY_TYPES),
        named("operator", "operator", OPERATORS),
        named("value_type", "value_type", VALUE_TYPES),
        named("computability", "computability", COMPUTABILITY),
        (f"{_json(m, 'history_context')} <> 'null' AND NOT {allowed(_json(m, 'history_context'), HISTORY)}", f"concat('history_context_not_allowed:', {_said(_json(m, 'history_context'))})"),
        (f"{given} AND NOT {an_object}", "'temporal_context_must_be_object_or_null'"),
        (f"{an_object} AND size({odd}) > 0", f"concat('temporal_context_has_unexpected_keys:[', array_join(transform({odd}, k -> concat('\\'', k, '\\'')), ', '), ']')"),
        (f"{an_object} AND NOT {part('relation')} IN ({_list(RELATIONS)})", f"concat('temporal_relation_not_allowed:', {part('relation')})"),
        (f"{an_object} AND NOT {part('unit')} IN ({_list(UNITS)}, 'None')", f"concat('temporal_unit_not_allowed:', {part('unit')})"),
        (f"{an_object} AND NOT {part('anchor_event')} IN ({_list(ANCHORS)})", f"concat('temporal_anchor_event_not_allowed:', {part('anchor_event')})"),
        *((test, f"'{name}'") for name, test in consistency_reasons(m)),
        (f"{_json(m, 'computability')} = '\"non_computable\"' AND {text('non_computable_reason')} = ''", "'non_computable_without_reason'"),
    ]
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {test} THEN {name} END" for test, name in rules) + ")"


def changed_fields(old: str, new: str) -> str:
    """SQL of the fields that differ as canonical JSON, in their order, joined by semicolons."""
    return "concat_ws(';', " + ", ".join(f"CASE WHEN map_contains_key({new}, '{f}') AND {_json(old, f)} <> {_json(new, f)} THEN '{f}' END" for f in FIELDS) + ")"


def shown_errors(errors: str, most: int = 5) -> str:
    """SQL of errors as text: path and message of the first few, and how many more."""
    more = f"CASE WHEN size({errors}) > {most} THEN concat(' | ... plus ', size({errors}) - {most}, ' more schema errors') ELSE '' END"
    return f"concat(array_join(transform(slice({errors}, 1, {most}), e -> concat(e.path, ': ', e.message)), ' | '), {more})"


def located(trees: DataFrame) -> DataFrame:
    """branch, criterion_id, document_id, path, leaf (VARIANT) of the leaves of groups; of leaves with one id in a branch the last."""
    key = F.struct("branch", "document_id")
    docs = trees.select(key.alias("document_id"), "doc")
    own = nested.grouped_criteria(docs).select("document_id.*", "path", "criterion", F.expr("trim(coalesce(try_variant_get(criterion, '$.criterion_id', 'string'), ''))").alias("criterion_id")).where("criterion_id <> ''")
    # Walk order: inclusion before exclusion, children by number.
    place = F.struct(F.col("document_id"), F.when(F.startswith("path", F.lit("inclusion")), 0).otherwise(1), F.transform(F.regexp_extract_all("path", F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: x.cast("int")))
    newest = Window.partitionBy("branch", "criterion_id").orderBy(F.desc(place))
    return own.withColumn("nth", F.row_number().over(newest)).where("nth = 1").drop("nth")


def _judged(found: DataFrame, schema: dict) -> DataFrame:
    """Status, reason, candidate and changed fields of results that met their leaf (old)."""
    early = f"""CASE WHEN NOT branch_to_update IN ('A', 'B') THEN concat('unknown_branch:', branch_to_update) WHEN old IS NULL THEN 'criterion_id_not_found_in_target_ast'
        WHEN NOT coalesce(trim(final_decision), '') IN ({_list(APPLICABLE)}) THEN concat('not_applicable_final_decision:', coalesce(trim(final_decision), ''))
        WHEN coalesce(trim(local_validation_status), '') <> 'pass' THEN concat('local_validation_not_pass:', coalesce(trim(local_validation_status), '')) WHEN selected IS NULL THEN 'selected_leaf_missing_or_not_object' ELSE '' END"""
    at = "concat(replace(replace(path, '[', '.'), ']', ''), '.criterion')"
    steps = [
        [("early", early)],
        [("new", f"CASE WHEN early = '' THEN {overlaid('old', 'selected')} END")],
        [("reasons", f"CASE WHEN early = '' THEN {leaf_reasons('new')} ELSE '' END"), ("changed", f"CASE WHEN early = '' THEN {changed_fields('old', 'new')} ELSE '' END"), ("new_leaf", nested.as_json("new"))],
        # Errors are asked for only where nothing else has stopped a result before.
        [("was", "CASE WHEN early = '' AND reasons = '' AND changed <> '' THEN leaf END"), ("held", "CASE WHEN early = '' AND reasons = '' AND changed <> '' THEN parse_json(new_leaf) END")],
        [*validate.leaf_errors(schema, "was", at, "before"), *validate.leaf_errors(schema, "held", at, "after")],
        [("introduced", validate.new_errors("before", "after"))],
        [("skip_reason", f"CASE WHEN early <> '' THEN early WHEN reasons <> '' THEN concat('candidate_schema_invalid:', reasons) WHEN changed = '' THEN 'candidate_identical_to_target_leaf' WHEN size(introduced) > 0 THEN concat('full_ast_schema_new_invalid:', {shown_errors('introduced')}) ELSE '' END")],
        [("apply_status", "CASE skip_reason WHEN '' THEN 'applied' WHEN 'candidate_identical_to_target_leaf' THEN 'no_change' ELSE 'skipped' END")],
    ]
    return apply(found, *(lambda d, own=own: own for own in steps))


AUDITED = ("entity_text", "operator", "value_type", "value", "unit", "computability", "negated")


def apply_results(trees: DataFrame, results: DataFrame, schema: dict) -> tuple[DataFrame, DataFrame]:
    """The trees after the results, and an audit row for each of them with old and new fields."""
    own = last_results(results).withColumn("branch_to_update", F.trim(F.coalesce("branch_to_update", F.lit("")))).withColumn("criterion_id", F.trim(F.coalesce("criterion_id", F.lit(""))))
    turn = Window.partitionBy("branch_to_update", "criterion_id").orderBy("ord")
    # Results are read for the number of rounds and in each round, trees for their leaves and for the edits: both are made once.
    own, trees = written(own.withColumn("turn", F.row_number().over(turn))), written(trees)
    rounds = own.agg(F.max("turn")).first()[0] or 0
    audits = []
    for k in range(1, rounds + 1):
        r, leaves = own.where(F.col("turn") == k).alias("r"), located(trees).alias("l")
        met = r.join(leaves, (F.col("r.branch_to_update") == F.col("l.branch")) & (F.col("r.criterion_id") == F.col("l.criterion_id")), "left")
        found = met.select("r.*", "l.document_id", "l.path", F.col("l.criterion").alias("leaf"))
        found = apply(found, lambda d: [("old", nested.fields("leaf")), ("selected", nested.fields("try_parse_json(selected_leaf)"))])
        judged = _judged(found, schema)
        # No filter on the status: pushed down it would write every expression that leads to it anew at each place.
        new_leaf = F.expr("CASE WHEN apply_status = 'applied' THEN new_leaf END").alias("leaf")
        docs = trees.select(F.struct("branch", "document_id").alias("document_id"), "doc")
        edits = judged.select(F.struct(F.col("branch_to_update").alias("branch"), "document_id").alias("document_id"), "criterion_id", new_leaf)
        trees = nested.with_edits(docs, edits).select("document_id.*", "doc")
        if k < rounds:
            # A further round reads them twice; as a table of its own the plan stays that of one round.
            trees = written(trees)
        seen = [F.expr(f"{_plain(_json(side, f))}").alias(f"{name}_{f}") for f in AUDITED for side, name in (("old", "old"), ("coalesce(new, old)", "new"))]
        changed = F.when(F.col("apply_status") == "applied", F.col("changed")).otherwise("").alias("changed_fields")
        audits.append(judged.select("plan_id", "branch_to_update", "criterion_id", "final_decision", "apply_status", F.when(F.col("apply_status") == "applied", "apply_selected_candidate_leaf").otherwise("no_update").alias("apply_action"), "skip_reason", changed, *seen))
    if not audits:
        audits = [own.select("plan_id", "branch_to_update", "criterion_id", "final_decision", *(F.lit(None).cast("string").alias(c) for c in ("apply_status", "apply_action", "skip_reason", "changed_fields", *(f"{s}_{f}" for f in AUDITED for s in ("old", "new")))))]
    return trees, reduce(DataFrame.unionByName, audits)
