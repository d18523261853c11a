"""Rule trees as nested documents of any depth: walks to leaves, and edits by criterion id.

Documents are (document_id, doc) with doc as JSON text. Walks leave a document in its row:
a fold over VARIANT goes a level down a round; a node is opened once, and only what has
children goes on to the next round. Edits leave the document in its row: the text is cut
at its leaves, the edited ones are exchanged, and everything between them stays byte for
byte as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The keys that hold child nodes, the names of leaf kinds, and the fields that make a node a leaf.
CHILD_KEYS = ("children", "clauses", "operands", "args", "rules", "items")
LEAF_KINDS = ("leaf", "criterion", "atomic", "atom")
LEAF_FIELDS = ("entity_type", "entity_text", "operator", "value", "unit", "evidence_text", "value_type", "temporal_context", "history_context", "computability")
SECTIONS = ("inclusion_criteria", "exclusion_criteria")


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _object(node: str) -> str:
    """Whether a value is an object; only that is looked at, not what it holds."""
    return f"try_variant_get({node}, '$', 'struct<>') IS NOT NULL"


def _text(node: str, key: str) -> str:
    return f"try_variant_get({node}, '$.{key}', 'string')"


_IS_CRITERION = "coalesce({}, '') = 'criterion'".format(_text("{n}", "node_type"))


#: A node as it is met: its section, its path and itself.
_NODE = "struct<section:string,path:string,node:variant>"
#: An object has at least one array on the way to each deeper node, so no node lies deeper than the text has opening brackets.
_DEEPEST = "length(doc) - length(replace(doc, '[', ''))"


def _walked(docs: DataFrame, roots: str, children: str, kept: str, node: str = _NODE) -> DataFrame:
    """document_id and ``node``'s fields: the nodes that are ``kept``, from the roots on.

    A document stays in its row and is walked there, a level after the other: ``roots`` is SQL of the first
    level over ``tree`` (VARIANT), ``children`` of the nodes below a node ``x``, ``kept`` a test on ``x``. Nothing
    is shuffled or stored between levels.
    """
    none = f"CAST(array() AS array<{node}>)"
    level = f"named_struct('open', flatten(transform(s.open, x -> {children})), 'found', concat(s.found, filter(s.open, x -> {kept})))"
    found = f"aggregate(sequence(0, deepest), named_struct('open', CAST({roots} AS array<{node}>), 'found', {none}), (s, k) -> CASE WHEN size(s.open) = 0 THEN s ELSE {level} END, s -> s.found)"
    parsed = docs.select("document_id", F.expr("parse_json(doc)").alias("tree"), F.expr(_DEEPEST).alias("deepest"))
    return parsed.select("document_id", F.explode(F.expr(found)).alias("x")).select("document_id", "x.*")


def _below(keys: tuple[str, ...], step: str, onward: str = "true") -> str:
    """The children of ``x`` that stand in arrays under the keys; ``step`` adds ``c.pos`` and the key to the path."""
    each = (f"transform(coalesce(try_variant_get(x.node, '$.{k}', 'array<variant>'), array()), (c, i) -> named_struct('section', x.section, 'path', concat(x.path, {step.format(key=k)}), 'node', c))" for k in keys)
    found = f"concat({', '.join(each)})"
    return found if onward == "true" else f"CASE WHEN {onward} THEN {found} ELSE CAST(array() AS array<{_NODE}>) END"


def _root(section: str, path: str) -> str:
    return f"named_struct('section', '{section}', 'path', '{path}', 'node', try_variant_get(tree, '$.{path}'))"


#: The sections' trees.
_ROOTS = "filter(array({}), x -> x.node IS NOT NULL)".format(", ".join(_root(s, f"rules_v3_ast.{s}").replace(f"'path', 'rules_v3_ast.{s}'", f"'path', '{s}'") for s in SECTIONS))
_CRITERION = _IS_CRITERION.format(n="x.node")
_WRAPPER = f"{_CRITERION} AND try_variant_get(x.node, '$.criterion', 'struct<>') IS NOT NULL"
_GROUP = _text("x.node", "node_type") + " = 'group'"
_INDEXED = "'.children[', i, ']'"


def _criteria(docs: DataFrame, children: str, kept: str = _CRITERION) -> DataFrame:
    return _walked(docs, _ROOTS, children, kept).withColumn("criterion", F.expr("try_variant_get(node, '$.criterion')"))


def criteria(docs: DataFrame) -> DataFrame:
    """document_id, criterion_type, path, criterion (VARIANT): wrapped criteria, with ``.children[i]`` paths; whatever a node calls itself, its children are looked into."""
    own = _criteria(docs, _below(("children",), _INDEXED), _WRAPPER)
    return own.select("document_id", F.split("section", "_")[0].alias("criterion_type"), "path", "criterion")


def operator_paths(docs: DataFrame) -> DataFrame:
    """document_id, criterion_type, path, criterion: the same leaves with ``/OP[i]`` paths; only nodes that say they are groups are opened."""
    step = "'/', coalesce(" + _text("x.node", "group_operator") + ", 'GROUP'), '[', i, ']'"
    return _criteria(docs, _below(("children",), step, _GROUP)).select("document_id", F.split("section", "_")[0].alias("criterion_type"), "path", "criterion")


def grouped_criteria(docs: DataFrame) -> DataFrame:
    """document_id, path, criterion of the leaves that edits look for: only groups are opened, paths are ``.children[i]``."""
    own = _criteria(docs, _below(("children",), _INDEXED, _GROUP), _WRAPPER)
    return own.select("document_id", "path", "criterion")


def nodes(docs: DataFrame) -> DataFrame:
    """document_id, section, path, node: all nodes, with ``.children.i`` paths."""
    return _walked(docs, _ROOTS.replace("x.node IS NOT NULL", "x.node IS NOT NULL AND NOT is_variant_null(x.node)"), _below(("children",), "'.children.', i"), "true")


#: A node of any document with what is asked of it, which is read in one pass over its fields.
_ASKED = "struct<node_type:string,type:string,{},{}>".format(",".join(f"{f}:variant" for f in LEAF_FIELDS), ",".join(f"{k}:array<variant>" for k in CHILD_KEYS))
_ANY_NODE = f"struct<section:string,path:string,node:variant,asked:{_ASKED}>"
_ANY_LEAF = "(lower(coalesce(nullif(x.asked.node_type, ''), x.asked.type, '')) IN ({}) OR ({}) AND NOT ({}))".format(_list(LEAF_KINDS), " OR ".join(f"x.asked.{f} IS NOT NULL" for f in LEAF_FIELDS), " OR ".join(f"coalesce(size(x.asked.{k}), 0) > 0" for k in CHILD_KEYS))


def any_leaves(docs: DataFrame) -> DataFrame:
    """document_id, path, leaf (VARIANT, a wrapper or a bare leaf) of documents under any of the known keys.

    Roots are the sections of the tree, then sections at the top; a document with written
    criteria gives those alone; one without any root is walked as a whole. Children are the ones
    that were read with their node, so none is looked up again.
    """
    node = lambda section, path, v: f"named_struct('section', {section}, 'path', {path}, 'node', {v}, 'asked', try_variant_get({v}, '$', '{_ASKED}'))"
    places = [where + s for where in ("rules_v3_ast.", "") for s in SECTIONS]
    there = {p: f"try_variant_get(tree, '$.{p}', 'struct<>') IS NOT NULL" for p in places}
    # A root is taken out of its document before it is read.
    sections = "transform(filter(array({}), r -> r.node IS NOT NULL), r -> {})".format(", ".join(f"named_struct('path', '{p}', 'node', CASE WHEN {test} THEN try_variant_get(tree, '$.{p}') END)" for p, test in there.items()), node("'section'", "r.path", "r.node"))
    whole = f"filter(array({node("'doc'", "'doc'", 'tree')}), x -> {_object('x.node')})"
    # Written criteria are leaves whatever they hold; their section says so.
    written = f"filter(transform(try_variant_get(tree, '$.pass2_output.criteria', 'array<variant>'), (c, i) -> named_struct('section', 'written', 'path', concat('pass2_output.criteria[', i, ']'), 'node', c, 'asked', CAST(NULL AS {_ASKED}))), x -> {_object('x.node')})"
    roots = f"CASE WHEN try_variant_get(tree, '$.pass2_output.criteria[0]') IS NOT NULL THEN {written} WHEN {' OR '.join(there.values())} THEN {sections} ELSE {whole} END"
    leaf = f"(x.section = 'written' OR {_ANY_LEAF})"
    each = (f"transform(coalesce(x.asked.{k}, array()), (c, i) -> {node('x.section', f"concat(x.path, '.{k}[', i, ']')", 'c')})" for k in CHILD_KEYS)
    children = f"CASE WHEN {leaf} THEN CAST(array() AS array<{_ANY_NODE}>) ELSE concat({', '.join(each)}) END"
    return _walked(docs, roots, children, leaf, _ANY_NODE).select("document_id", "path", F.col("node").alias("leaf"))


def rows_of_items(leaves: DataFrame) -> DataFrame:
    """Leaves of ``criteria`` regrouped by item, in the order of their clause numbers; ids that name no item and clause are left out."""
    cid = F.trim(F.expr("try_variant_get(criterion, '$.criterion_id', 'string')"))
    item, clause = F.regexp_extract(cid, "^(.+)_(C[0-9]+)$", 1), F.regexp_extract(cid, "^(.+)_(C[0-9]+)$", 2)
    order = F.substr(clause, F.lit(2)).try_cast("long")
    own = leaves.select("document_id", "criterion_type", "path", item.alias("item_uid"), clause.alias("clause_id"), order.alias("ord"), cid.alias("criterion_id")).where("item_uid <> ''")
    entry = F.struct("ord", "path", "clause_id", "criterion_id")
    grouped = own.groupBy("item_uid").agg(F.min_by("document_id", "path").alias("document_id"), F.min_by("criterion_type", "path").alias("criterion_type"), F.array_sort(F.collect_list(entry)).alias("criteria"))
    return grouped.select("item_uid", "document_id", "criterion_type", F.size("criteria").alias("n"), "criteria")


def logic_text(docs: DataFrame) -> DataFrame:
    """document_id, section, n, chain: a tree as one line, ``(C1: a AND NOT(C2: b) OR [AT_LEAST 2] (...))``.

    On the way down each node takes along what stands before it and how many groups end with it,
    so the leaves need only be put in order. A group without children is shown as its operator.
    """
    kind, op = _text("x.node", "node_type"), f"coalesce({_text('x.node', 'group_operator')}, 'GROUP')"
    quantifier = "try_variant_get(x.node, '$.group_quantifier.{}', 'string')"
    opened = f"concat(CASE WHEN {quantifier.format('quantifier_type')} IS NOT NULL THEN concat('[', {quantifier.format('quantifier_type')}, ' ', coalesce({quantifier.format('value')}, 'None'), '] ') ELSE '' END, CASE WHEN {op} = 'NOT' THEN 'NOT(' ELSE '(' END)"
    joiner = f"concat(' ', CASE WHEN {op} IN ('AND', 'OR') THEN {op} ELSE 'AND' END, ' ')"
    n = "CASE WHEN {} = 'group' THEN coalesce(size(try_variant_get({}, '$.children', 'array<variant>')), 0) ELSE 0 END"
    entity = "trim(regexp_replace(coalesce(try_variant_get(x.node, '$.criterion.entity_text', 'string'), ''), '(?U)\\\\s+', ' '))"
    said = f"concat(coalesce(substring_index(try_variant_get(x.node, '$.criterion.criterion_id', 'string'), '_', -1), '?'), ': ', {entity})"
    said = f"CASE WHEN {kind} = 'group' THEN concat({op}, '()') WHEN coalesce(try_variant_get(x.node, '$.criterion.operator', 'string'), '') = 'not_exists' THEN concat('NOT(', {said}, ')') ELSE {said} END"
    node = "struct<section:string,node:variant,place:array<int>,before:string,closes:int,n:int>"
    below = f"transform(CASE WHEN x.n > 0 THEN try_variant_get(x.node, '$.children', 'array<variant>') ELSE array() END, (c, i) -> named_struct('section', x.section, 'node', c, 'place', concat(x.place, array(i)), 'before', CASE WHEN i = 0 THEN concat(x.before, {opened}) ELSE {joiner} END, 'closes', CASE WHEN i = x.n - 1 THEN x.closes + 1 ELSE 0 END, 'n', {n.format(_text('c', 'node_type'), 'c')}))"
    # Nodes first, then what is counted of them: the roots are read once.
    roots = f"transform(filter({_ROOTS}, x -> NOT is_variant_null(x.node)), x -> named_struct('section', x.section, 'node', x.node, 'place', CAST(array() AS array<int>), 'before', '', 'closes', 0, 'n', {n.format(kind, 'x.node')}))"
    leaves = _walked(docs, roots, below, "x.n = 0", node).select("document_id", "section", "place", F.expr(f"concat(before, {said.replace('x.node', 'node')}, repeat(')', closes))").alias("said"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "said")))
    return leaves.groupBy("document_id", "section").agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda x: x["said"]), "").alias("chain"))


# --- edits ---------------------------------------------------------------------------
_STRING = r'"(?:[^"\\]++|\\.)*+"'
_FLAT = r"(?:[^{}\"]++|" + _STRING + r")*+"
#: A wrapped criterion; within it objects, but none within those.
_LEAF = r'"criterion"\s*+:\s*+(\{(?:[^{}"]++|' + _STRING + r"|\{" + _FLAT + r"\})*+\})"


def _id_of(leaf: Column) -> Column:
    return F.trim(F.get_json_object(leaf, "$.criterion_id"))


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` after the edits (document_id, criterion_id, leaf), a null leaf being none; documents without edits pass through unread.

    Of leaves with one id the last one is exchanged. What the exchange of a leaf looks at, all leaves and their
    ids, are columns: within the lambda they would be sought in the text anew for each leaf.
    """
    given = F.when(F.col("leaf").isNotNull(), F.struct("criterion_id", "leaf"))
    grouped = edits.groupBy("document_id").agg(F.map_from_entries(F.collect_list(given)).alias("edits"))
    own = docs.join(grouped, "document_id", "left")
    some = F.size("edits") > 0
    own = own.withColumn("whole", F.when(some, F.regexp_extract_all("doc", F.lit(_LEAF), F.lit(0)))).withColumn("between", F.when(some, F.split("doc", _LEAF, -1)))
    # The leaf begins at the first brace of what holds it.
    own = own.withColumn("ids", F.transform("whole", lambda w: _id_of(F.substr(w, F.instr(w, "{"))))).withColumn("back", F.reverse("ids"))

    def exchange(w: Column, i: Column) -> Column:
        cid = F.get("ids", i)
        new = F.try_element_at("edits", cid)
        last = F.size("ids") - F.array_position("back", cid) == i
        return F.when(new.isNotNull() & last, F.concat(F.substring_index(w, "{", 1), new)).otherwise(w)

    after = F.concat_ws("", F.flatten(F.zip_with("between", F.transform("whole", exchange), lambda a, b: F.array(a, b))))
    return own.withColumn("doc", F.when(F.col("whole").isNull(), F.col("doc")).otherwise(after)).drop("edits", "whole", "between", "ids", "back")


def fields(leaf: str) -> str:
    """SQL of a leaf's fields (VARIANT) as a map to canonical JSON texts; null for what is no object."""
    return f"transform_values(try_variant_get({leaf}, '$', 'map<string,variant>'), (k, v) -> to_json(v))"


def as_json(own: str) -> str:
    """SQL of a map of ``fields`` as JSON text, keys in order."""
    return f"concat('{{', array_join(transform(array_sort(map_keys({own})), k -> concat('\"', k, '\":', element_at({own}, k))), ','), '}}')"
