"""Queries over nested rule trees: walks, regrouping, schema errors, applied edits.

The documents are put together from the leaf table by the same statement for both
engines, but for the ordered joining of texts. Some wrap their sections in further
groups, hold children under other keys, or have no tree but written criteria.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested, rescue_apply, validate
from .leaves import leaves, leaves_sql

_SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: The leaf of a criterion as JSON text, from columns.
_LEAF = """concat('{{"criterion_id":"', key_id, '","entity_type":"', {entity_type}, '","entity_text":"', {entity_text}, '","operator":"', {operator}, '","value_type":"', {value_type}, '","value":', {value},
  ',"unit":', CASE WHEN {unit} IS NULL THEN 'null' ELSE concat('"', {unit}, '"') END, ',"temporal_context":', {temporal}, ',"computability":"', computability, '"', CASE WHEN k % 15 = 8 THEN ',"note":1' ELSE '' END, CASE WHEN k % 18 = 7 THEN '' ELSE concat(',"evidence_text":"', evidence_text, '"') END, '}}')"""
_VALUE = """CASE WHEN value_kind = 'range' THEN concat('{{"min":', coalesce(CAST(CAST(value_min AS BIGINT) AS STRING), 'null'), CASE WHEN k % 7 = 1 THEN '' ELSE concat(',"max":', coalesce(CAST(CAST(value_max AS BIGINT) AS STRING), 'null')) END, '}}') WHEN value_kind = 'list' THEN CASE WHEN k % 5 = 1 THEN '[]' ELSE concat('["', qty, '",', qty, ']') END WHEN value_kind = 'string' THEN concat('"', coalesce(value_text, ''), '"') WHEN value_kind = 'number' THEN coalesce(value_text, 'null') ELSE 'null' END"""
_TEMPORAL = """CASE WHEN t_relation IS NULL THEN 'null' ELSE concat('{{"relation":"', t_relation, '","value":', coalesce(t_value, 'null'), CASE WHEN t_unit IS NULL THEN '' ELSE concat(',"unit":"', t_unit, '"') END, CASE WHEN t_anchor IS NULL THEN '' ELSE concat(',"anchor_event":"', t_anchor, '"') END, '}}') END"""
_OLD = {"entity_type": "entity_type", "entity_text": "entity_text", "operator": "operator", "value_type": "value_type", "value": _VALUE.format(), "unit": "unit", "temporal": _TEMPORAL.format()}
OLD_LEAF = _LEAF.format(**_OLD)


class _Joined:
    """Ordered joining of texts, per engine."""

    @staticmethod
    def spark(text: str, by: str) -> str:
        return f"array_join(transform(array_sort(collect_list(struct({by} AS o, {text} AS x))), y -> y.x), ',')"

    @staticmethod
    def duck(text: str, by: str) -> str:
        return f"string_agg({text}, ',' ORDER BY {by})"


def _documents(leaf: str, joined: Callable[[str, str], str]) -> str:
    """Statement of (document_id, doc) over ``leaf``, with the leaf's JSON given."""
    return f"""
    SELECT document_id, CASE WHEN max(l_orderkey) % 19 = 4 THEN concat('{{"pass2_output":{{"criteria":[', {joined("listed", "section")}, ']}}}}')
        ELSE concat('{{"document_id":"', document_id, '",', CASE WHEN max(l_orderkey) % 17 = 3 THEN '' ELSE '"rules_v3_ast":{{' END, '"trial_id":"', document_id, '","inclusion_criteria":', coalesce(max(CASE WHEN section = 'inclusion' THEN tree END), 'null'),
          ',"exclusion_criteria":', coalesce(max(CASE WHEN section = 'exclusion' THEN tree END), 'null'), CASE WHEN max(l_orderkey) % 17 = 3 THEN '' ELSE '}}' END, '}}') END AS doc
    FROM (
      SELECT document_id, section, l_orderkey, listed, CASE WHEN l_orderkey % 3 = 0 THEN concat('{{"node_type":"group","group_operator":"NOT","children":[{{"node_type":"group","children":[', own, ']}}]}}')
          WHEN l_orderkey % 3 = 1 AND l_orderkey % 2 = 0 THEN concat('{{"type":"GROUP","args":[{{"node_type":"group","rules":[{{"items":[', own, ']}}]}}]}}') ELSE own END AS tree
      FROM (
        SELECT document_id, section, l_orderkey, concat('{{"node_type":"group","group_operator":"OR","polarity":"', CASE WHEN l_orderkey % 23 = 5 THEN 'both' WHEN section = 'inclusion' THEN 'include' ELSE 'exclude' END, '","children":[', {joined("pair", "place")}, ']}}') AS own, {joined("listed", "place")} AS listed
        FROM (
          SELECT document_id, section, l_orderkey, place, {joined("leaf", "ord")} AS listed,
            concat('{{"node_type":"group","group_operator":"', CASE WHEN place = 5 THEN 'XOR' ELSE 'AND' END, '","', CASE place % 4 WHEN 2 THEN 'operands' WHEN 3 THEN 'clauses' ELSE 'children' END, '":[', {joined("node", "ord")}, ']}}') AS pair
          FROM (
            SELECT *, CAST(floor(ord / 2.0) AS BIGINT) AS place, CASE WHEN k % 11 = 3 THEN concat('{{"node_type":"group","group_operator":"NOT","children":[{{"node_type":"criterion","criterion":', leaf, '}}]}}') WHEN k % 13 = 2 THEN leaf WHEN k % 29 = 6 THEN concat('{{"node_type":"Criterion","criterion":', leaf, '}}') ELSE concat('{{"node_type":"criterion","criterion":', leaf, '}}') END AS node
            FROM (SELECT document_id, criterion_type AS section, l_orderkey, k, row_number() OVER (PARTITION BY document_id, criterion_type ORDER BY key_id) - 1 AS ord, {leaf} AS leaf FROM LEAVES) AS a
          ) AS b GROUP BY document_id, section, l_orderkey, place
        ) AS c GROUP BY document_id, section, l_orderkey
      ) AS d
    ) AS e GROUP BY document_id
    """


def documents(spark: SparkSession, sf_dir: str, leaf: str = OLD_LEAF) -> DataFrame:
    """The nested documents as a DataFrame."""
    # Braces of JSON in literals would be read as names of tables.
    view = leaves(spark, sf_dir, whole_documents=True)
    sql = _documents(leaf, _Joined.spark).replace("{", "\\u007B").replace("}", "\\u007D").replace("LEAVES", "{own}")
    return spark.sql(sql, own=view)


def _query(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    _SPARK[name] = run
    _SQL[name] = f"WITH RECURSIVE leaf AS ({leaves_sql()}), docs AS MATERIALIZED ({_documents(OLD_LEAF, _Joined.duck).replace('LEAVES', 'leaf')}), {sql}"


_ROOTS = "SELECT document_id, s AS section, s AS path, json_extract(doc, '$.rules_v3_ast.' || s) AS node FROM docs, (VALUES ('inclusion_criteria'), ('exclusion_criteria')) AS v(s) WHERE json_type(doc, '$.rules_v3_ast.' || s) = 'OBJECT'"
_KIND = "json_extract_string({0}, '$.node_type')"


def _walk(step: str, onward: str) -> str:
    return f"""walk AS ({_ROOTS} UNION ALL SELECT w.document_id, w.section, w.path || {step}, json_extract(w.node, '$.children[' || i || ']') FROM walk AS w, LATERAL (SELECT unnest(range(CASE WHEN json_type(w.node, '$.children') = 'ARRAY' THEN json_array_length(w.node, '$.children')::BIGINT ELSE 0 END)) AS i) AS c WHERE {onward}) """


_ID = "json_extract_string({0}, '$.criterion_id')"
_query("tree_criteria", lambda s, d: nested.criteria(documents(s, d)).select("document_id", "criterion_type", "path", F.expr("variant_get(criterion, '$.criterion_id', 'string')").alias("criterion_id")),
       _walk("'.children[' || i || ']'", "true") + "SELECT document_id, split_part(section, '_', 1) AS criterion_type, path, json_extract_string(node, '$.criterion.criterion_id') AS criterion_id FROM walk WHERE json_extract_string(node, '$.node_type') = 'criterion'")
_query("tree_operator_paths", lambda s, d: nested.operator_paths(documents(s, d)).select("document_id", "criterion_type", "path", F.expr("variant_get(criterion, '$.criterion_id', 'string')").alias("criterion_id")),
       _walk("'/' || coalesce(json_extract_string(w.node, '$.group_operator'), 'GROUP') || '[' || i || ']'", "json_extract_string(w.node, '$.node_type') = 'group'") + "SELECT document_id, split_part(section, '_', 1) AS criterion_type, path, json_extract_string(node, '$.criterion.criterion_id') AS criterion_id FROM walk WHERE json_extract_string(node, '$.node_type') = 'criterion'")
_LEAF_TEST = "(lower(coalesce(nullif(json_extract_string({0}, '$.node_type'), ''), json_extract_string({0}, '$.type'), '')) IN ('leaf', 'criterion', 'atomic', 'atom') OR json_extract({0}, '$.entity_type') IS NOT NULL)"
_query("tree_any_leaves", lambda s, d: nested.any_leaves(documents(s, d)).select("document_id", "path", F.expr("coalesce(try_variant_get(leaf, '$.criterion.criterion_id', 'string'), variant_get(leaf, '$.criterion_id', 'string'))").alias("criterion_id")),
       f"""walk AS (SELECT document_id, p || s AS path, json_extract(doc, '$.' || p || s) AS node FROM docs, (VALUES ('inclusion_criteria'), ('exclusion_criteria')) AS v(s), (VALUES ('rules_v3_ast.'), ('')) AS t(p) WHERE json_type(doc, '$.' || p || s) = 'OBJECT'
       UNION ALL SELECT w.document_id, w.path || '.' || key || '[' || i || ']', json_extract(w.node, '$.' || key || '[' || i || ']') FROM walk AS w, (VALUES ('children'), ('clauses'), ('operands'), ('args'), ('rules'), ('items')) AS v(key), LATERAL (SELECT unnest(range(coalesce(json_array_length(w.node, '$.' || key), 0)::BIGINT)) AS i) AS c WHERE NOT {_LEAF_TEST.format('w.node')})
       SELECT document_id, path, coalesce(json_extract_string(node, '$.criterion.criterion_id'), json_extract_string(node, '$.criterion_id')) AS criterion_id FROM walk WHERE {_LEAF_TEST.format('node')}
       UNION ALL SELECT document_id, 'pass2_output.criteria[' || i || ']', json_extract_string(doc, '$.pass2_output.criteria[' || i || '].criterion_id') FROM docs, LATERAL (SELECT unnest(range(coalesce(json_array_length(doc, '$.pass2_output.criteria'), 0)::BIGINT)) AS i) AS c""")
_query("tree_item_rows", lambda s, d: nested.rows_of_items(nested.criteria(documents(s, d))).select("item_uid", "document_id", "criterion_type", "n", F.expr("array_join(transform(criteria, c -> concat(c.clause_id, '@', c.path)), ' ')").alias("criteria")),
       _walk("'.children[' || i || ']'", "true") + "SELECT item_uid, min(document_id) AS document_id, min(criterion_type) AS criterion_type, count(*)::INT AS n, string_agg(clause_id || '@' || path, ' ' ORDER BY substr(clause_id, 2)::BIGINT, path) AS criteria FROM (SELECT document_id, split_part(section, '_', 1) AS criterion_type, path, regexp_extract(json_extract_string(node, '$.criterion.criterion_id'), '^(.+)_(C[0-9]+)$', 1) AS item_uid, regexp_extract(json_extract_string(node, '$.criterion.criterion_id'), '^(.+)_(C[0-9]+)$', 2) AS clause_id FROM walk WHERE json_extract_string(node, '$.node_type') = 'criterion') WHERE item_uid <> '' GROUP BY item_uid")

# --- schema ------------------------------------------------------------------------
# The schema of a rule tree.
_TEXT = {"type": "string"}
_MAYBE = {"type": ["string", "null"]}
_NUMBER = {"type": ["number", "string", "null"]}
SCHEMA = {
    "definitions": {
        "logical_node": {
            "type": "object",
            "oneOf": [
                {
                    "properties": {
                        "node_type": {"const": "group"},
                        "group_operator": {"enum": ["AND", "OR", "NOT"]},
                        "polarity": {"type": ["string", "null"], "enum": ["include", "exclude", None]},
                        "group_quantifier": {"type": ["object", "null"], "properties": {"quantifier_type": {"enum": ["AT_LEAST", "AT_MOST", "EXACTLY"]}, "value": {"type": "integer", "minimum": 0}}, "required": ["quantifier_type", "value"]},
                        "children": {"type": "array", "items": {"$ref": "#/definitions/logical_node"}, "minItems": 1},
                    },
                    "required": ["node_type", "group_operator", "children"],
                    "additionalProperties": False,
                },
                {"properties": {"node_type": {"const": "criterion"}, "criterion": {"$ref": "#/definitions/criterion_leaf"}}, "required": ["node_type", "criterion"], "additionalProperties": False},
            ],
        },
        "criterion_leaf": {
            "type": "object",
            "properties": {
                "criterion_id": _TEXT,
                "entity_type": {"type": "string", "enum": ["condition", "drug", "procedure", "lab", "demographic", "therapy", "biomarker", "vital", "observation", "stage", "line_of_therapy", "other"]},
                "entity_text": _TEXT,
                "normalized_concept": {"type": ["object", "null"], "properties": {"code": _MAYBE, "system": {"type": ["string", "null"], "enum": ["SNOMED-CT", "RxNorm", "LOINC", "ICD-10-CM", "UCUM", None]}, "display": _MAYBE}},
                "operator": {"type": "string", "enum": ["exists", "not_exists", "=", "!=", "<", "<=", ">", ">=", "between", "in", "not_in", "contains", "matches"]},
                "value_type": {"type": "string", "enum": ["scalar", "list", "range", "null"]},
                "value": {"oneOf": [_NUMBER, {"type": "array", "items": {"type": ["number", "string"]}, "minItems": 1}, {"type": "object", "properties": {"min": _NUMBER, "max": _NUMBER}, "required": ["min", "max"]}]},
                "unit": _MAYBE,
                "temporal_context": {
                    "type": ["object", "null"],
                    "properties": {
                        "relation": {"type": "string", "enum": ["before", "after", "during", "within", "since"]},
                        "value": _NUMBER,
                        "unit": {"type": ["string", "null"], "enum": ["hour", "day", "week", "month", "year", None]},
                        "anchor_event": {"type": "string", "enum": ["screening", "randomization", "treatment_start", "diagnosis", "index_date", "surgery", "procedure", "baseline", "other"]},
                    },
                    "required": ["relation", "anchor_event"],
                },
                "computability": {"type": "string", "enum": ["computable", "non_computable", "partial"]},
                "non_computable_reason": _MAYBE,
                "evidence_text": _TEXT,
                "provenance": {"type": ["object", "null"], "properties": {"source_modifier_text": _MAYBE, "source_condition_text": _MAYBE, "source_exception_context": _MAYBE, "history_context_hint": _MAYBE}},
                "history_context": {"type": ["string", "null"], "enum": ["current", "prior", "previously_treated", "stable_dose", "investigational_use", "other", None]},
            },
            "required": ["entity_type", "entity_text", "operator", "evidence_text", "criterion_id", "computability", "value_type"],
            "additionalProperties": False,
        },
    }
}
_query("schema_errors", lambda s, d: validate.tree_errors(documents(s, d), SCHEMA).select("document_id", "path", F.regexp_replace("message", " is not (one of|valid under).*", " is not $1").alias("message")),
       _walk("'.children.' || i", "true") + """, c AS (SELECT document_id, path || '.criterion' AS path, json_extract(node, '$.criterion') AS x FROM walk WHERE json_extract_string(node, '$.node_type') IS DISTINCT FROM 'group' AND json_extract(node, '$.criterion') IS NOT NULL)
       SELECT document_id, path || '.group_operator' AS path, '"XOR" is not one of' AS message FROM walk WHERE json_extract_string(node, '$.group_operator') = 'XOR'
       UNION ALL SELECT document_id, path || '.polarity', '"both" is not one of' FROM walk WHERE json_extract_string(node, '$.polarity') = 'both'
       UNION ALL SELECT document_id, path, '''children'' is a required property' FROM walk WHERE json_extract_string(node, '$.node_type') = 'group' AND json_extract(node, '$.children') IS NULL
       UNION ALL SELECT document_id, path, '''group_operator'' is a required property' FROM walk WHERE json_extract_string(node, '$.node_type') = 'group' AND json_extract(node, '$.group_operator') IS NULL
       UNION ALL SELECT document_id, path, 'Additional properties are not allowed (' || k || ' unexpected)' FROM (SELECT document_id, path, array_to_string(list_sort(list_filter(json_keys(node), lambda x: NOT list_contains(CASE WHEN json_extract_string(node, '$.node_type') = 'group' THEN ['node_type', 'group_operator', 'polarity', 'group_quantifier', 'children'] ELSE ['node_type', 'criterion'] END, x))), ', ') AS k FROM walk) WHERE k <> ''
       UNION ALL SELECT document_id, path || '.node_type', '"Criterion" is not' FROM walk WHERE false
       UNION ALL SELECT document_id, path || '.node_type', '"criterion" was expected' FROM walk WHERE json_extract_string(node, '$.node_type') NOT IN ('group', 'criterion')
       UNION ALL SELECT document_id, path, '''node_type'' is a required property' FROM walk WHERE json_extract(node, '$.node_type') IS NULL
       UNION ALL SELECT document_id, path, '''criterion'' is a required property' FROM walk WHERE json_extract_string(node, '$.node_type') IS DISTINCT FROM 'group' AND json_extract(node, '$.criterion') IS NULL
       UNION ALL SELECT document_id, path || '.entity_type', '"device" is not one of' FROM c WHERE json_extract_string(x, '$.entity_type') = 'device'
       UNION ALL SELECT document_id, path || '.operator', '"about" is not one of' FROM c WHERE json_extract_string(x, '$.operator') = 'about'
       UNION ALL SELECT document_id, path || '.computability', '"unknown" is not one of' FROM c WHERE json_extract_string(x, '$.computability') = 'unknown'
       UNION ALL SELECT document_id, path, 'Additional properties are not allowed (note unexpected)' FROM c WHERE json_extract(x, '$.note') IS NOT NULL
       UNION ALL SELECT document_id, path, '''evidence_text'' is a required property' FROM c WHERE json_extract(x, '$.evidence_text') IS NULL
       UNION ALL SELECT document_id, path || '.value', json_extract(x, '$.value')::VARCHAR || ' is not valid under' FROM c WHERE json_type(x, '$.value') = 'ARRAY' AND json_array_length(x, '$.value') = 0 OR json_type(x, '$.value') = 'OBJECT' AND json_extract(x, '$.value.max') IS NULL
       UNION ALL SELECT document_id, path || '.temporal_context', '''anchor_event'' is a required property' FROM c WHERE json_type(x, '$.temporal_context') = 'OBJECT' AND json_extract(x, '$.temporal_context.anchor_event') IS NULL
       UNION ALL SELECT document_id, path || '.temporal_context.relation', '"near" is not one of' FROM c WHERE json_extract_string(x, '$.temporal_context.relation') = 'near'
       UNION ALL SELECT document_id, path || '.temporal_context.unit', '"fortnight" is not one of' FROM c WHERE json_extract_string(x, '$.temporal_context.unit') = 'fortnight'
       UNION ALL SELECT document_id, path || '.temporal_context.anchor_event', '"visit" is not one of' FROM c WHERE json_extract_string(x, '$.temporal_context.anchor_event') = 'visit'""")


# --- applied results ---------------------------------------------------------------------
#: What a rescue run wrote about the leaves of branch A: plans with a later word, other branches, failed checks, no leaf, leaves that do not hold.
_SELECTED = """CASE WHEN k % 8 <> 5 THEN concat('{"entity_type":"', CASE WHEN k % 6 = 1 THEN 'device' ELSE 'drug' END, '","entity_text":"', entity_text, ' again","operator":"exists","value_type":"null","value":7,"temporal_context":"null","computability":"computable","evidence_text":"said so","criterion_id":"other"', CASE WHEN k % 16 = 2 THEN ',"normalized_concept":{"system":"OTHER"}' ELSE '' END, '}') END"""
_DECIDED = "CASE k % 10 WHEN 0 THEN 'human_review' WHEN 1 THEN 'no_change' WHEN 2 THEN 'mark_partial_or_non_computable' ELSE 'select_candidate' END"
_RESULTS = f"""SELECT key_id AS plan_id, k AS ord, CASE WHEN k % 41 = 7 THEN 'C' ELSE 'A' END AS branch_to_update, key_id AS criterion_id, {_DECIDED} AS final_decision, CASE WHEN k % 9 = 4 THEN 'fail' ELSE 'pass' END AS local_validation_status, '' AS rescue_task_type, {_SELECTED} AS selected_leaf FROM LEAVES WHERE k % 4 < 3
UNION ALL SELECT key_id, -1 - k, 'A', key_id, 'select_candidate', 'pass', '', '{{}}' FROM LEAVES WHERE k % 20 = 2"""
_NEW_LEAF = """concat('{"computability":"computable","criterion_id":"', key_id, '","entity_text":"', entity_text, ' again","entity_type":"drug","evidence_text":"said so",', CASE WHEN k % 15 = 8 THEN '"note":1,' ELSE '' END, '"operator":"exists","temporal_context":null,"unit":', CASE WHEN unit IS NULL THEN 'null' ELSE concat('"', unit, '"') END, ',"value":null,"value_type":"null"}')"""


def _applied(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = documents(spark, sf_dir).select(F.lit("A").alias("branch"), "document_id", "doc")
    results = spark.sql(_RESULTS.replace("{", "\\u007B").replace("}", "\\u007D").replace("LEAVES", "{own}"), own=leaves(spark, sf_dir))
    return rescue_apply.apply_results(own, results, SCHEMA)


_WHY = """, whys AS MATERIALIZED (SELECT plan_id, CASE WHEN branch_to_update = 'C' THEN 'unknown_branch:C' WHEN f.criterion_id IS NULL THEN 'criterion_id_not_found_in_target_ast' WHEN final_decision IN ('human_review', 'no_change') THEN 'not_applicable_final_decision:' || final_decision WHEN local_validation_status = 'fail' THEN 'local_validation_not_pass:fail'
  WHEN selected_leaf IS NULL THEN 'selected_leaf_missing_or_not_object' WHEN contains(selected_leaf, 'device') THEN 'candidate_schema_invalid:entity_type_not_allowed:device' WHEN contains(selected_leaf, 'OTHER') THEN 'full_ast_schema_new_invalid' ELSE '' END AS why
  FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY ord DESC) AS nth FROM results) AS r LEFT JOIN (SELECT json_extract_string(node, '$.criterion.criterion_id') AS criterion_id FROM walk WHERE json_extract_string(node, '$.node_type') = 'criterion') AS f ON f.criterion_id = r.criterion_id WHERE nth = 1)"""
_GROUPS = _walk("'.children[' || i || ']'", "json_extract_string(w.node, '$.node_type') = 'group'") + f", results AS MATERIALIZED ({_RESULTS.replace('LEAVES', 'leaf')}){_WHY}"
_query("apply_audit", lambda s, d: _applied(s, d)[1].select("plan_id", "apply_status", F.regexp_replace("skip_reason", "^(full_ast_schema_new_invalid):.*$", "$1").alias("why"), "changed_fields", "new_entity_text", "new_operator"),
       _GROUPS + ", told AS (SELECT w.*, l.*, l.value_kind <> 'null' AND coalesce(CASE WHEN l.value_kind IN ('number') THEN l.value_text ELSE 'x' END, 'null') <> 'null' AS had FROM whys AS w JOIN leaf AS l ON l.key_id = w.plan_id) SELECT plan_id, CASE WHEN why = '' THEN 'applied' ELSE 'skipped' END AS apply_status, why, CASE WHEN why <> '' THEN '' ELSE concat_ws(';', 'entity_text', CASE WHEN entity_type <> 'drug' THEN 'entity_type' END, CASE WHEN operator <> 'exists' THEN 'operator' END, CASE WHEN had THEN 'value' END, CASE WHEN value_type <> 'null' THEN 'value_type' END, CASE WHEN t_relation IS NOT NULL THEN 'temporal_context' END, CASE WHEN computability <> 'computable' THEN 'computability' END, CASE WHEN k % 18 = 7 OR evidence_text <> 'said so' THEN 'evidence_text' END) END AS changed_fields, CASE WHEN why LIKE 'criterion%' OR why LIKE 'unknown%' THEN NULL WHEN why = '' OR why LIKE 'cand%' OR why LIKE 'full%' THEN entity_text || ' again' ELSE entity_text END AS new_entity_text, CASE WHEN why LIKE 'criterion%' OR why LIKE 'unknown%' THEN NULL WHEN why = '' OR why LIKE 'cand%' OR why LIKE 'full%' THEN 'exists' ELSE operator END AS new_operator FROM told")
_query("applied_trees", lambda s, d: _applied(s, d)[0].select("document_id", F.md5("doc").alias("digest")),
       _GROUPS + f", edited AS MATERIALIZED (SELECT l.*, coalesce(w.why = '', false) AS done FROM leaf AS l LEFT JOIN whys AS w ON w.plan_id = l.key_id), after AS ({_documents(f'CASE WHEN done THEN {_NEW_LEAF} ELSE {OLD_LEAF} END', _Joined.duck).replace('LEAVES', 'edited')}) SELECT document_id, md5(doc) AS digest FROM after")


def oracle_with(sql: str) -> str:
    """A statement over the nested documents; ROOTS stands for the roots of their sections."""
    return f"WITH RECURSIVE leaf AS ({leaves_sql()}), docs AS MATERIALIZED ({_documents(OLD_LEAF, _Joined.duck).replace('LEAVES', 'leaf')}), {sql.replace('ROOTS', _ROOTS)}"


def queries() -> dict:
    return dict(_SPARK)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
