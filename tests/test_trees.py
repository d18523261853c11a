"""Nested trees: walks, edits, schema errors and applied results against plain loops over dictionaries."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from leafwright.operators import assemble, clauses, nested, rescue_apply, validate
from leafwright.plans import trees

KEYS = ["children", "clauses", "operands", "args", "rules", "items"]


def leaf(rng, cid):
    own = {"criterion_id": cid, "entity_type": rng.choice(["drug", "lab", "device"]), "entity_text": rng.choice(["aspirin", 'a "quoted" {brace}', "é — ☃", ""]), "operator": rng.choice(["exists", ">=", "between"]), "value_type": rng.choice(["null", "scalar", "range"]), "value": rng.choice([None, 5, 2.5, "x", {"min": 1, "max": None}, {"min": 1}, [], [1]]), "unit": None, "evidence_text": "it says [so]", "computability": "computable"}
    if rng.random() < 0.4:
        own["temporal_context"] = {"relation": rng.choice(["before", "near"]), "value": 3, "unit": rng.choice(["day", None]), "anchor_event": "screening"}
    return own


def node(rng, depth, ids, keys=("children",)):
    if depth == 0 or rng.random() < 0.25:
        if ids is None:
            return {"node_type": "criterion", "criterion": leaf(rng, "same")}
        ids.append(f"d_C{len(ids)}")
        own = leaf(rng, ids[-1])
        return rng.choice([{"node_type": "criterion", "criterion": own}, {"criterion": own, "node_type": "criterion"}]) if keys == ("children",) or rng.random() < 0.7 else own
    out = {"node_type": "group", "group_operator": rng.choice(["AND", "OR", "NOT"])} if rng.random() < 0.9 else {"type": "Group"}
    out[rng.choice(keys)] = [node(rng, depth - 1, ids, keys) for _ in range(rng.randint(1, 3))]
    return out


def made(seed, n, keys=("children",), depth=7):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        ids: list[str] = []
        doc = {"document_id": f"d{k}", "rules_v3_ast": {"trial_id": "t", "inclusion_criteria": node(rng, depth, ids, keys), "exclusion_criteria": rng.choice([None, node(rng, 3, ids, keys)])}}
        out.append((f"d{k}", doc))
    return out


def table(spark, docs):
    return spark.createDataFrame([(i, json.dumps(d, ensure_ascii=False, separators=random.Random(i).choice([(",", ":"), (", ", ": ")]))) for i, d in docs], "document_id string, doc string")


def test_children_paths_of_any_depth(spark):
    docs = made(1, 40)

    def walk(x, path):
        if isinstance(x, dict):
            if x.get("node_type") == "criterion" and isinstance(x.get("criterion"), dict):
                yield path, x["criterion"]["criterion_id"]
            for k, c in enumerate(x.get("children") or []):
                yield from walk(c, f"{path}.children[{k}]")

    want = sorted((i, p, c) for i, d in docs for s in nested.SECTIONS for p, c in walk(d["rules_v3_ast"][s], s))
    got = nested.criteria(table(spark, docs)).select("document_id", "path", F.expr("variant_get(criterion, '$.criterion_id', 'string')"))
    assert sorted(tuple(r) for r in got.collect()) == want
    assert max(p.count("[") for _, p, _ in want) == 7

    def operators(x, path):
        if not x or x.get("node_type") not in ("criterion", "group"):
            return
        if x["node_type"] == "criterion":
            yield path, x["criterion"]["criterion_id"]
        for k, c in enumerate(x.get("children") or []):
            yield from operators(c, f"{path}/{x.get('group_operator', 'GROUP')}[{k}]")

    want = sorted((i, p, c) for i, d in docs for s in nested.SECTIONS for p, c in operators(d["rules_v3_ast"][s], s))
    got = nested.operator_paths(table(spark, docs)).select("document_id", "path", F.expr("variant_get(criterion, '$.criterion_id', 'string')"))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_any_keys(spark):
    docs = made(2, 40, tuple(KEYS))
    docs += [("top", {"inclusion_criteria": {"type": "Leaf", "criterion_id": "x"}}), ("listed", {"pass2_output": {"criteria": [{"criterion_id": "y"}, 3, {"criterion_id": "z"}]}}), ("whole", {"entity_text": "e", "criterion_id": "w"}), ("both", {"operator": "=", "rules": [{"node_type": "ATOM", "criterion_id": "v"}], "items": []})]

    def is_leaf(x):
        kind = str(x.get("node_type") or x.get("type") or "").lower()
        return kind in ("leaf", "criterion", "atomic", "atom") or any(f in x for f in nested.LEAF_FIELDS) and not any(isinstance(x.get(k), list) and x[k] for k in KEYS)

    def walk(x, path):
        if is_leaf(x):
            yield path, (x.get("criterion") or x).get("criterion_id")
            return
        for key in KEYS:
            if isinstance(x.get(key), list):
                for k, c in enumerate(x[key]):
                    if isinstance(c, dict):
                        yield from walk(c, f"{path}.{key}[{k}]")

    want = []
    for i, d in docs:
        if "pass2_output" in d:
            want += [(i, f"pass2_output.criteria[{k}]", c["criterion_id"]) for k, c in enumerate(d["pass2_output"]["criteria"]) if isinstance(c, dict)]
            continue
        roots = [(f"rules_v3_ast.{s}", d["rules_v3_ast"][s]) for s in nested.SECTIONS if isinstance(d.get("rules_v3_ast", {}).get(s), dict)] + [(s, d[s]) for s in nested.SECTIONS if isinstance(d.get(s), dict)]
        for name, root in roots or [("doc", d)]:
            want += [(i, p, c) for p, c in walk(root, name)]
    got = nested.any_leaves(table(spark, docs)).select("document_id", "path", F.expr("coalesce(try_variant_get(leaf, '$.criterion.criterion_id', 'string'), variant_get(leaf, '$.criterion_id', 'string'))"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_edits_leave_the_rest_as_it_was(spark):
    docs = made(3, 30)
    own = table(spark, docs)
    texts = {r.document_id: r.doc for r in own.collect()}
    new = '{"criterion_id":"d_C1","entity_text":"new $1 \\\\ text"}'
    edits = spark.createDataFrame([(i, "d_C1", new) for i, _ in docs[::2]] + [(docs[0][0], "unknown", "{}")], "document_id string, criterion_id string, leaf string")
    after = {r.document_id: r.doc for r in nested.with_edits(own, edits).collect()}
    for k, (i, d) in enumerate(docs):
        if k % 2 or '"d_C1"' not in texts[i]:
            assert after[i] == texts[i]
        else:
            at = after[i].index(new)
            assert texts[i].startswith(after[i][:at]) and texts[i].endswith(after[i][at + len(new) :])
            assert json.loads(texts[i][at : len(texts[i]) - (len(after[i]) - at - len(new))])["criterion_id"] == "d_C1"
    same = '{"criterion":{"criterion_id":"a","n":1},"x":[{"criterion":{"criterion_id":"a","n":2}}]}'
    twice = spark.createDataFrame([("d", same)], "document_id string, doc string")
    assert nested.with_edits(twice, spark.createDataFrame([("d", "a", "{}")], "document_id string, criterion_id string, leaf string")).first().doc == same.replace('{"criterion_id":"a","n":2}', "{}")


CHECKS = [
    ({"type": "string"}, [1, "x", None, {}], [True, False, True, True]),
    ({"type": ["string", "null"], "enum": ["a", None]}, ["a", None, "b", 3], [False, False, True, True]),
    ({"type": "integer", "minimum": 0}, [0, -1, 2.5, 2.0, "1"], [False, True, True, False, True]),
    ({"const": "group"}, ["group", "x"], [False, True]),
    ({"type": "array", "items": {"type": ["number", "string"]}, "minItems": 1}, [[], [1, "x"], [None], {}], [True, False, True, True]),
    ({"properties": {"a": {"properties": {"b": {"enum": [1]}}, "required": ["b"]}}, "additionalProperties": False}, [{}, {"a": {}}, {"a": {"b": 1}}, {"a": {"b": 2}}, {"c": 1}, {"a": 1}], [False, True, False, True, True, False]),
    ({"anyOf": [{"type": "string"}, {"type": "null"}]}, ["x", None, 1], [False, False, True]),
    ({"oneOf": [{"type": "number"}, {"type": "integer"}]}, [1, 1.5, "x"], [True, False, True]),
    ({"$ref": "#/definitions/d", "definitions": {"d": {"type": "boolean"}}}, [True, 0], [False, True]),
]


@pytest.mark.parametrize("schema, values, wrong", CHECKS)
def test_schema_words(spark, schema, values, wrong):
    own = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "k int, v string").selectExpr("k", "parse_json(v) AS v")
    got = own.select("k", F.expr(validate.Compiler(schema).errors(schema, "v", "''")).alias("e")).orderBy("k").collect()
    assert [bool(r.e) for r in got] == wrong


def test_paths_and_messages(spark):
    own = spark.createDataFrame([('{"a": [1, {"b": "x"}]}',)], "v string").selectExpr("parse_json(v) AS v")
    schema = {"properties": {"a": {"items": {"type": "object", "properties": {"b": {"enum": ["y"]}}, "required": ["c"]}}}}
    (row,) = own.select(F.expr(validate.Compiler(schema).errors(schema, "v", "'root'")).alias("e")).collect()
    assert sorted((e.path, e.message) for e in row.e) == [("root.a.0", "1 is not of type 'object'"), ("root.a.1", "'c' is a required property"), ("root.a.1.b", '"x" is not one of ["y"]')]


def good(cid, **more):
    return {"criterion_id": cid, "entity_type": "drug", "entity_text": "aspirin", "operator": "exists", "value_type": "null", "value": None, "unit": None, "temporal_context": None, "computability": "computable", "evidence_text": "takes aspirin"} | more


RESULTS = [
    # criterion, decision, status, task, selected, wanted status, wanted reason, changed
    ("a", "select_candidate", "pass", "", {"entity_text": "ibuprofen", "criterion_id": "zz", "note": 1}, "applied", "", "entity_text"),
    ("b", "mark_partial_or_non_computable", "pass", "", {"computability": "non_computable"}, "applied", "", "computability;non_computable_reason"),
    ("c", "human_review", "pass", "", {}, "skipped", "not_applicable_final_decision:human_review", ""),
    ("d", "select_candidate", "fail", "", {}, "skipped", "local_validation_not_pass:fail", ""),
    ("e", "select_candidate", "pass", "", None, "skipped", "selected_leaf_missing_or_not_object", ""),
    ("f", "select_candidate", "pass", "", [1], "skipped", "selected_leaf_missing_or_not_object", ""),
    ("g", "select_candidate", "pass", "", {"entity_type": "device", "operator": "between"}, "skipped", "candidate_schema_invalid:entity_type_not_allowed:device|between_operator_without_range_value", ""),
    ("h", "select_candidate", "pass", "", {"entity_text": "aspirin"}, "no_change", "candidate_identical_to_target_leaf", ""),
    ("i", "select_candidate", "pass", "", {"normalized_concept": {"system": "OTHER"}}, "skipped", 'full_ast_schema_new_invalid:inclusion_criteria.children.8.criterion.normalized_concept.system: "OTHER" is not one of ["SNOMED-CT", "RxNorm", "LOINC", "ICD-10-CM", "UCUM", null]', ""),
    ("unknown", "select_candidate", "pass", "", {}, "skipped", "criterion_id_not_found_in_target_ast", ""),
    ("j", "select_candidate", "pass", "temporal_context_recovery", {"temporal_context": {"relation": "within", "value": 3, "unit": "day", "anchor_event": "screening"}, "history_context": "prior"}, "applied", "", "temporal_context;history_context"),
    ("k", "select_candidate", "pass", "", {"temporal_context": {"relation": "near", "x": 1}}, "skipped", "candidate_schema_invalid:temporal_context_has_unexpected_keys:['x']|temporal_relation_not_allowed:near|temporal_anchor_event_not_allowed:None", ""),
    ("l", "select_candidate", "pass", "", {"operator": "between", "value_type": "range", "value": {"min": 1}}, "skipped", "candidate_schema_invalid:range_value_missing_min_or_max_keys", ""),
    ("m", "select_candidate", "pass", "", {"temporal_context": "null", "value": 4, "entity_type": "lab"}, "applied", "", "entity_type"),
    ("n", "select_candidate", "pass", "", {"history_context": "sometime"}, "skipped", "candidate_schema_invalid:history_context_not_allowed:sometime", ""),
]


def test_results_are_applied_by_their_gates(spark):
    ids = "abcdefghijklmn"
    tree = {"node_type": "group", "group_operator": "AND", "children": [{"node_type": "criterion", "criterion": good(i)} for i in ids] + [{"node_type": "criterion", "criterion": good("broken", entity_type="device")}]}
    docs = {b: {"rules_v3_ast": {"inclusion_criteria": tree, "exclusion_criteria": None}} for b in "AB"}
    own = spark.createDataFrame([(b, "d", json.dumps(d)) for b, d in docs.items()], "branch string, document_id string, doc string")
    rows = [(f"p{k}", k, "A", c, dec, status, task, None if sel is None else json.dumps(sel)) for k, (c, dec, status, task, sel, *_) in enumerate(RESULTS)]
    rows += [("px", 90, " C ", "a", "select_candidate", "pass", "", "{}"), ("p0", -1, "A", "a", "human_review", "pass", "", "{}"), (" ", 99, "A", "a", "select_candidate", "pass", "", "{}")]
    rows += [("q1", 100, "B", "a", "select_candidate", "pass", "", '{"unit": "mg"}'), ("q2", 101, "B", "a", "select_candidate", "pass", "", '{"entity_text": "x", "unit": "mg"}')]
    results = spark.createDataFrame(rows, "plan_id string, ord long, branch_to_update string, criterion_id string, final_decision string, local_validation_status string, rescue_task_type string, selected_leaf string")
    after, audit = rescue_apply.apply_results(own, results, trees.SCHEMA)
    got = {r.plan_id: (r.apply_status, r.skip_reason, r.changed_fields) for r in audit.collect()}
    want = {f"p{k}": tuple(x[5:]) for k, x in enumerate(RESULTS)} | {"px": ("skipped", "unknown_branch:C", ""), "q1": ("applied", "", "unit"), "q2": ("applied", "", "entity_text")}
    assert got == want
    found = {r.branch: json.loads(r.doc) for r in after.collect()}
    a = copy.deepcopy(docs["A"])
    news = {"a": {"entity_text": "ibuprofen"}, "b": {"computability": "non_computable", "non_computable_reason": rescue_apply.REASON}, "j": RESULTS[10][4], "m": {"entity_type": "lab"}}
    for n in a["rules_v3_ast"]["inclusion_criteria"]["children"]:
        n["criterion"] |= news.get(n["criterion"]["criterion_id"], {})
    assert found["A"] == a
    first = found["B"]["rules_v3_ast"]["inclusion_criteria"]["children"][0]["criterion"]
    assert (first["unit"], first["entity_text"]) == ("mg", "x")


def test_assembled_trees_against_plain_loops(spark):
    rng = random.Random(9)
    items, leaves, want = [], [], {}

    def group(op, children, **more):
        return {"node_type": "group", "group_operator": op, "children": children} | more

    for d in range(30):
        sections = {"inclusion": [], "exclusion": []}
        for index in rng.sample(range(20), rng.randrange(5)):
            kind, uid = rng.choice(list(sections)), f"d{d}_x__item{index}"
            own = []
            for _ in range(rng.randrange(6)):
                quantifier = rng.choice([(None, None)] * 9 + [("AT_LEAST", 2)])
                own.append((rng.choice(['say "a"', "b \\ c", None]), "evidence é", False, rng.choice(["AND", "AND", "OR", None]), *quantifier))
            items.append((f"d{d}", kind, index, uid, own))
            nodes = []
            for k, c in enumerate(own):
                cid = f"C{k + 1}"
                if rng.random() < 0.7:
                    leaf = {"criterion_id": f"{uid}_{cid}", "n": rng.random()}
                    leaves += [(uid, cid, "{}", 0), (uid, cid, json.dumps(leaf), 1)]
                else:
                    leaf = {"criterion_id": f"{uid}_{cid}", "entity_type": "other", "entity_text": c[0] or "", "normalized_concept": None, "operator": "exists", "value_type": "null", "value": None, "unit": None, "temporal_context": None, "computability": "partial", "non_computable_reason": assemble.MISSING, "evidence_text": c[1], "provenance": dict.fromkeys(("source_modifier_text", "source_condition_text", "source_exception_context", "history_context_hint")), "history_context": None}
                nodes.append({"node_type": "criterion", "criterion": leaf})
            if not own:
                continue
            first = next((c[4:] for c in own if c[4]), None)
            runs = [[nodes[0]]]
            for c, node in zip(own, nodes[1:]):
                if c[3] == "AND":
                    runs[-1].append(node)
                else:
                    runs.append([node])
            parts = [r[0] if len(r) == 1 else group("AND", r) for r in runs]
            tree = group("OR", nodes, group_quantifier={"quantifier_type": first[0], "value": first[1]}) if first else parts[0] if len(parts) == 1 else group("OR", parts)
            sections[kind].append((index, tree))
        whole = {}
        for kind, own in sections.items():
            trees_ = [t for _, t in sorted(own, key=lambda x: x[0])]
            whole[f"{kind}_criteria"] = None if not trees_ else trees_[0] if len(trees_) == 1 else group("AND", trees_, polarity="include") if kind == "inclusion" else group("OR", trees_, polarity="exclude")
        if any(i[0] == f"d{d}" for i in items):
            want[f"d{d}"] = {"document_id": f"d{d}", "rules_v3_ast": {"trial_id": f"d{d}"} | whole}
    df = spark.createDataFrame(items, f"document_id string, criterion_type string, item_index int, item_uid string, clauses {clauses.CLAUSE}")
    given = spark.createDataFrame(leaves, "item_uid string, clause_id string, leaf string, ord int")
    docs = assemble.documents(assemble.item_trees(clauses.with_ids(df), given))
    got = {r.document_id: json.loads(r.doc) for r in docs.collect()}
    assert got == want
    # What was put together is walked again, each clause once.
    assert nested.criteria(docs).count() == sum(len(i[4]) for i in items)
    assert assemble.duplicate_items(df.union(df.limit(1))).count() == 1


@pytest.mark.parametrize("name", ["tree_criteria", "tree_any_leaves", "schema_errors", "tree_chains"])
def test_walks_store_nothing_between_levels(spark, name):
    from leafwright.plans import slate

    plan = slate.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # The rows of lineitem are shuffled once, by document, before any text is made of them.
    assert "UnionLoop" not in plan and plan.count("Exchange hashpartitioning(document_id") == 1 == plan.count("Exchange hashpartitioning(")


def test_each_field_is_read_once(spark):
    """Errors are columns of a projection over fields that are read once, and nothing of it is written anew for a test before the rows of errors are made."""
    from leafwright.plans import slate

    made = " ".join(e for _, e in validate.node_errors(trees.SCHEMA, "node", "path", "found"))
    assert all(made.count(f"'$.{field}')") == 1 for field in ("operator", "entity_text", "polarity", "history_context", "children"))
    plan = slate.queries()["schema_errors"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(found" in plan and "size(found#" not in plan


@pytest.mark.parametrize("text, kinds", [("1e400", {"number"}), ('"Infinity"', {"string"}), ('"NaN"', {"string"}), ("-0.5", {"number"}), ("-3", {"number", "integer"}), ("123456789012345678901234567890", {"number", "integer"}), ('"7"', {"string"}), ('""', {"string"}), ("[]", {"array"}), ("[null]", {"array"}), ("{}", {"object"}), ("false", {"boolean"}), ("null", {"null"})])
def test_types_follow_from_the_text(spark, text, kinds):
    own = spark.createDataFrame([(text,)], "v string").selectExpr("parse_json(v) AS v")
    names = ["string", "integer", "number", "boolean", "null", "object", "array"]
    wrong = lambda k, **more: validate.Compiler({}).errors({"type": k} | more, "v", "''")
    row = own.select(*(F.expr(wrong(k)).alias(k) for k in names), F.expr(wrong("array", items={"type": "null"}, minItems=1)).alias("filled")).first()
    assert {k for k in names if not row[k]} == kinds
    assert bool(row.filled) == (text != "[null]")


def test_errors_are_asked_for_only_where_nothing_else_stops_a_result(spark):
    """A wrapper around anything but an object is no leaf; of a result that was stopped before, errors are not looked for."""
    made = " ".join(f"{n} {e}" for n, e in validate.leaf_errors(trees.SCHEMA, "was", "''", "before"))
    assert "schema_of_variant(was)" not in made and "leaf" not in made.replace("was", "")
    odd = [{"node_type": "criterion", "criterion": x} for x in ("text", None, [good("a")], 3, {})] + [{"node_type": "criterion"}, {"node_type": "criterion", "criterion": good("a", entity_type="device")}]
    doc = {"rules_v3_ast": {"inclusion_criteria": {"node_type": "group", "group_operator": "AND", "children": odd}, "exclusion_criteria": None}}
    own = spark.createDataFrame([("A", "d", json.dumps(doc))], "branch string, document_id string, doc string")
    assert [r.path for r in nested.criteria(own).sort("path").collect()] == [r.path for r in nested.grouped_criteria(own).sort("path").collect()] == [f"inclusion_criteria.children[{k}]" for k in (4, 6)]
    assert nested.operator_paths(own).count() == 7
    results = spark.createDataFrame([("p", 0, "A", "a", "select_candidate", "pass", "", '{"entity_type": "lab"}'), ("q", 1, "A", "a", "human_review", "pass", "", '{"entity_type": "lab"}')], "plan_id string, ord long, branch_to_update string, criterion_id string, final_decision string, local_validation_status string, rescue_task_type string, selected_leaf string")
    _, audit = rescue_apply.apply_results(own, results, trees.SCHEMA)
    assert sorted((r.plan_id, r.apply_status, r.changed_fields) for r in audit.collect()) == [("p", "applied", "entity_type"), ("q", "skipped", "")]
    plan = audit._jdf.queryExecution().optimizedPlan().toString()
    assert "schemaOfVariant(criterion" not in plan


def test_leaves_of_a_document_are_sought_once(spark):
    docs = table(spark, made(5, 3))
    after = nested.with_edits(docs, spark.createDataFrame([("d0", "d_C0", "{}")], "document_id string, criterion_id string, leaf string"))
    plan = after._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == plan.count("get_json_object(") + plan.count("GetJsonObjectEvaluator") == 1
    assert after.columns == ["document_id", "doc"]


def test_any_leaves_read_a_node_once(spark):
    """A null field makes a leaf, an empty list of children does not keep it from being one; no field is looked up by itself."""
    tree = {"node_type": None, "type": "x", "rules": [{"unit": None}, {"unit": None, "items": [], "args": "none"}, {"unit": 1, "items": [None]}, 7, None, [{"unit": 2}], {"node_type": 5}, {"node_type": "", "type": "ATOMIC"}]}
    docs = [("a", {"inclusion_criteria": tree}), ("b", {"rules_v3_ast": {"exclusion_criteria": tree}, "exclusion_criteria": []}), ("c", {"rules": tree["rules"][:1], "inclusion_criteria": None}), ("d", {"pass2_output": {"criteria": []}, "inclusion_criteria": {"value": 0}}), ("e", [1])]
    own = nested.any_leaves(table(spark, docs))
    inner = [0, 1, 7]
    want = [("a", f"inclusion_criteria.rules[{k}]") for k in inner] + [("b", f"rules_v3_ast.exclusion_criteria.rules[{k}]") for k in inner] + [("c", "doc.rules[0]"), ("d", "inclusion_criteria")]
    assert sorted((r.document_id, r.path) for r in own.select("document_id", "path").collect()) == want
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert "$.entity_type" not in plan and "$.operands" not in plan


def test_results_and_trees_are_made_once(spark):
    """What rounds, leaves and edits read is a table of its own, so the leaf table is not made anew for each of them."""
    after, audit = trees._applied(spark, "/root/testdata/sf0.001")
    for df in (after, audit):
        assert "l_orderkey" not in df._jdf.queryExecution().optimizedPlan().toString()
