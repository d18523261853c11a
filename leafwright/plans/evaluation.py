"""Queries over clauses, gold matches, tags, splits, the judge loop and traces."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anchors, annotations, assemble, cleaning, clauses, gold, grounding, judge, nested, splits, tagging, values
from . import trees
from .dialect import apply
from .leaves import leaves, leaves_sql, tables

_SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

# --- gold ------------------------------------------------------------------------------
#: Gold spans and predictions of an order; some predictions are a gold span as it is, some have no place, some orders lack a side.
_SIDES = """SELECT doc, span, CASE WHEN side = 'pred' AND z % 13 = 4 THEN NULL WHEN side = 'pred' AND z % 3 = 0 THEN ga ELSE a END AS a, CASE WHEN side = 'pred' AND z % 13 = 4 THEN NULL WHEN side = 'pred' AND z % 3 = 0 THEN gb ELSE b END AS b, label, side
FROM (SELECT *, lag(a) OVER (PARTITION BY doc ORDER BY span) AS ga, lag(b) OVER (PARTITION BY doc ORDER BY span) AS gb FROM (
  SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS span, l_partkey % 60 AS a, l_partkey % 60 + 5 + CAST(l_quantity AS BIGINT) AS b,
    CASE l_suppkey % 3 WHEN 0 THEN 'Condition' WHEN 1 THEN 'Drug' ELSE 'Procedure' END AS label, CASE WHEN (l_partkey + l_linenumber) % 2 = 0 THEN 'gold' ELSE 'pred' END AS side, l_suppkey + l_partkey AS z FROM {lineitem}) AS x) AS y"""


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SIDES, **tables(spark, sf_dir, "lineitem"))


_SPARK["gold_scores"] = lambda s, d: gold.scores(_sides(s, d))
_SPARK["gold_matches"] = lambda s, d: gold.matches(_sides(s, d))


def _gold_sql(closing: str) -> str:
    from .slate import GREEDY

    exact = "SELECT p.doc, p.span, g.span AS gold_span, p.label FROM placed AS p JOIN placed AS g ON p.side = 'pred' AND g.side = 'gold' AND p.doc = g.doc AND p.a = g.a AND p.b = g.b"
    nth = "row_number() OVER (PARTITION BY side, doc, a, b{} ORDER BY span)"
    return f"""WITH RECURSIVE given AS MATERIALIZED ({_SIDES.format(lineitem="lineitem")}), kept AS MATERIALIZED (SELECT * FROM given WHERE doc IN (SELECT doc FROM given WHERE side = 'gold') AND doc IN (SELECT doc FROM given WHERE side = 'pred')),
      sides AS MATERIALIZED (SELECT * FROM kept WHERE a IS NOT NULL AND b IS NOT NULL), placed AS MATERIALIZED (SELECT *, {nth.format('')} AS nth, {nth.format(', label')} AS tnth FROM sides),
      {GREEDY.format(name="m", keys="doc", on="p.doc", same="p.doc = m.doc", gold="x.doc = p.doc")}, {GREEDY.format(name="t", keys="doc, label", on="p.doc, p.label", same="p.doc = m.doc AND p.label = m.label", gold="x.doc = p.doc AND x.label = p.label")},
      pairs AS MATERIALIZED (SELECT 'exact_mention' AS kind, * FROM ({exact} AND p.nth = g.nth) UNION ALL SELECT 'exact_typed', * FROM ({exact} AND p.label = g.label AND p.tnth = g.tnth)
        UNION ALL SELECT 'soft_mention', m.doc, m.span, m.gold_span, k.label FROM m JOIN kept AS k ON k.doc = m.doc AND k.span = m.span WHERE m.gold_span IS NOT NULL UNION ALL SELECT 'soft_typed', doc, span, gold_span, label FROM t WHERE gold_span IS NOT NULL)
      {closing}"""


def _register_gold() -> None:
    _SQL["gold_matches"] = _gold_sql("SELECT kind, doc, span, gold_span, label FROM pairs")
    rate = "CASE WHEN {1} > 0 THEN round({0} / {1}, 4) END"
    _SQL["gold_scores"] = _gold_sql(f""", counts AS (SELECT kind, c.label, predicted, gold, (SELECT count(*) FROM pairs AS p WHERE CASE WHEN c.label = 'all' THEN p.kind = k.kind ELSE p.kind = replace(k.kind, 'mention', 'typed') AND p.label = c.label END) AS tp
        FROM (VALUES ('exact_mention'), ('soft_mention'), ('exact_typed'), ('soft_typed')) AS k(kind), (SELECT label, count(*) FILTER (side = 'pred') AS predicted, count(*) FILTER (side = 'gold') AS gold FROM kept GROUP BY label UNION ALL SELECT 'all', count(*) FILTER (side = 'pred'), count(*) FILTER (side = 'gold') FROM kept) AS c)
      SELECT *, CASE WHEN precision + recall > 0 THEN round(2 * precision * recall / (precision + recall), 4) END AS f1 FROM (SELECT kind, label, tp, predicted, gold, {rate.format('tp', 'predicted')} AS precision, {rate.format('tp', 'gold')} AS recall FROM counts)""")


# --- tags ------------------------------------------------------------------------------
#: Words of the documents with their places; and annotations that start or end at words, some in pieces, some outside, some of a dropped label.
_TOKENS_SPARK = "SELECT doc, pos, CAST(a AS BIGINT) AS a, CAST(a + length(word) AS BIGINT) AS b, word, n_chars FROM (SELECT doc, pos, word, n_chars, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM (SELECT doc_id AS doc, length(text) AS n_chars, posexplode(split(text, ' ')) AS (pos, word) FROM {documents}) AS x) AS y WHERE word <> ''"
_TOKENS_DUCK = "SELECT doc, pos, a, a + length(word) AS b, word, n_chars FROM (SELECT doc, pos, word, n_chars, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM (SELECT doc_id AS doc, length(text) AS n_chars, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents) AS x) AS y WHERE word <> ''"
_ANNOTATED = "SELECT doc, pos AS span, CASE WHEN z % 11 = 3 THEN 'Scope' WHEN z % 17 = 5 THEN NULL WHEN z % 2 = 0 THEN 'Condition' ELSE 'Drug' END AS label, n_chars, a - CASE WHEN z % 5 = 1 AND a > 0 THEN 1 ELSE 0 END AS s1, CASE WHEN z % 7 = 2 THEN n_chars + 5 ELSE b END AS e1, CASE WHEN z % 4 = 1 THEN b + 1 + z % 20 END AS s2, CASE WHEN z % 4 = 1 THEN b + 2 + z % 20 + z % 9 END AS e2 FROM (SELECT *, (doc * 7 + pos * 13 + length(word)) AS z FROM tokens) AS t WHERE z % 6 = 0 OR z % 23 < 4"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_TOKENS_SPARK, **tables(spark, sf_dir, "documents"))


def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(_ANNOTATED.replace("FROM tokens", "FROM {tokens}"), tokens=_tokens(spark, sf_dir))
    pieces = F.filter(F.array(F.array("s1", "e1"), F.when(F.col("s2").isNotNull(), F.array("s2", "e2"))), lambda o: o.isNotNull())
    return own.select("doc", F.col("span").cast("long").alias("span"), "label", "n_chars", pieces.alias("offsets"))


_ENTITIES_SQL = """pieces AS (SELECT doc, span, coalesce(label, 'Other') AS label, s, e FROM (SELECT doc, span, label, n_chars, s1 AS s, e1 AS e FROM annotated UNION ALL SELECT doc, span, label, n_chars, s2, e2 FROM annotated WHERE s2 IS NOT NULL) WHERE s >= 0 AND e > s AND e <= n_chars AND label IS DISTINCT FROM 'Scope'),
  entities AS MATERIALIZED (SELECT doc, span, label, min(s) AS a, max(e) AS b FROM pieces GROUP BY ALL), placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY a, b - a DESC, span) AS nth FROM entities),
  fold AS (SELECT doc, nth, span, b AS last, true AS kept FROM placed WHERE nth = 1 UNION ALL SELECT p.doc, p.nth, p.span, CASE WHEN p.a >= f.last THEN p.b ELSE f.last END, p.a >= f.last FROM fold AS f JOIN placed AS p ON p.doc = f.doc AND p.nth = f.nth + 1),
  flat AS MATERIALIZED (SELECT p.* FROM placed AS p JOIN fold AS f ON f.doc = p.doc AND f.nth = p.nth WHERE f.kept),
  tagged AS MATERIALIZED (SELECT t.doc, t.pos, t.a, t.b, CASE WHEN t.a = 0 AND t.b = 0 THEN NULL WHEN e.label IS NULL THEN 'O' WHEN t.a >= e.a AND t.a - e.a <= 1 THEN 'B-' || e.label ELSE 'I-' || e.label END AS tag FROM tokens AS t LEFT JOIN LATERAL (SELECT label, x.a FROM flat AS x WHERE x.doc = t.doc AND x.a < t.b AND x.b > t.a ORDER BY x.a LIMIT 1) AS e ON true)"""
_TAG_SQL = f"WITH RECURSIVE tokens AS MATERIALIZED ({_TOKENS_DUCK}), annotated AS ({_ANNOTATED}), {_ENTITIES_SQL} "


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.bio_labels(_tokens(spark, sf_dir), tagging.flat_entities(_annotations(spark, sf_dir)))


_SPARK["flat_entities"] = lambda s, d: tagging.flat_entities(_annotations(s, d)).select("doc", "span", "a", "b", "label")
_SQL["flat_entities"] = _TAG_SQL + "SELECT doc, span, a, b, label FROM flat"
_SPARK["bio_labels"] = lambda s, d: _tags(s, d).where("tag <> 'O'")
_SQL["bio_labels"] = _TAG_SQL + "SELECT doc, pos, a, b, tag FROM tagged WHERE tag <> 'O'"
_SPARK["label_ids"] = lambda s, d: tagging.label_list(tagging.flat_entities(_annotations(s, d)))
_SQL["label_ids"] = _TAG_SQL + "SELECT (row_number() OVER (ORDER BY k, label, tag))::INT - 1 AS id, tag FROM (SELECT 0 AS k, '' AS label, 'O' AS tag UNION ALL SELECT DISTINCT 1, label, p || label FROM flat, (VALUES ('B-'), ('I-')) AS v(p))"
#: A tagging with faults: some entities lost, some begun wrongly, some of another label.
_GUESS = "CASE WHEN (doc + pos * 3) % 19 = 4 THEN 'O' WHEN (doc + pos) % 23 = 7 THEN concat('I-', substr(tag, 3)) WHEN (doc * 3 + pos) % 29 = 8 THEN 'B-Drug' ELSE tag END"
_CASES = {"tag": "CASE WHEN tag = 'O' THEN CASE WHEN (doc + pos) % 31 = 5 THEN 'B-Condition' ELSE 'O' END ELSE {} END"}


def _guessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark, sf_dir).selectExpr("doc", "pos", "tag AS truth", f"{_CASES['tag'].format(_GUESS)} AS guess")


_CHUNKS = "{0}c AS (SELECT doc, min(label) AS label, min(pos) AS first, max(pos) AS last FROM (SELECT *, sum(starts) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT doc, pos, {0} AS tag, substr({0}, 3) AS label, ({0} <> 'O' AND ({0} LIKE 'B-%' OR coalesce(lag({0}) OVER w, 'O') = 'O' OR substr(lag({0}) OVER w, 3) <> substr({0}, 3)))::INT AS starts FROM both_tags WINDOW w AS (PARTITION BY doc ORDER BY pos))) WHERE tag <> 'O' GROUP BY doc, run)"
_BOTH = f", both_tags AS MATERIALIZED (SELECT doc, pos, tag AS truth, {_CASES['tag'].format(_GUESS)} AS guess FROM tagged WHERE tag IS NOT NULL)"
_SPARK["entity_scores"] = lambda s, d: tagging.entity_scores(_guessed(s, d)).select("tp", "predicted", "gold", *(F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")))
_SQL["entity_scores"] = _TAG_SQL + f"{_BOTH}, {_CHUNKS.format('truth')}, {_CHUNKS.format('guess')}, n AS (SELECT (SELECT count(*) FROM truthc JOIN guessc USING (doc, label, first, last)) AS tp, (SELECT count(*) FROM guessc) AS predicted, (SELECT count(*) FROM truthc) AS gold) SELECT tp, predicted, gold, (SELECT round(avg((truth = guess)::INT), 9) FROM both_tags) AS accuracy, round(tp / predicted, 9) AS precision, round(tp / gold, 9) AS recall, round(2 * tp / (predicted + gold), 9) AS f1 FROM n"
_SPARK["tag_correlation"] = lambda s, d: tagging.matthews(_guessed(s, d)).select("tokens", F.round("mcc", 9).alias("mcc"))
_SQL["tag_correlation"] = _TAG_SQL + f"{_BOTH}, t AS (SELECT truth AS c, count(*)::DOUBLE AS n FROM both_tags GROUP BY ALL), g AS (SELECT guess AS c, count(*)::DOUBLE AS n FROM both_tags GROUP BY ALL), k AS (SELECT count(*)::DOUBLE AS s, count(*) FILTER (truth = guess)::DOUBLE AS c FROM both_tags) SELECT s::BIGINT AS tokens, round((c * s - (SELECT sum(t.n * g.n) FROM t JOIN g USING (c))) / sqrt((s * s - (SELECT sum(n * n) FROM g)) * (s * s - (SELECT sum(n * n) FROM t))), 9) AS mcc FROM k"

# --- splits ----------------------------------------------------------------------------
#: Groups of very unlike size: the lines of a supplier, those of some suppliers of a part alone.
_GROUPED = "SELECT CASE WHEN l_suppkey % 5 = 0 THEN concat('s', CAST(l_suppkey AS STRING)) ELSE concat('p', CAST(l_partkey AS STRING), '-', CAST(l_suppkey % 7 AS STRING)) END AS g FROM {lineitem}"
_SPARK["group_folds"] = lambda s, d: splits.group_folds(s.sql(_GROUPED, **tables(s, d, "lineitem")), "g", 10, 13).groupBy("fold").agg(F.count("*").alias("groups"), F.sum("size").alias("rows"))
# One group after the other, largest first, to the lightest fold: loads stand in a list.
_SQL["group_folds"] = f"WITH RECURSIVE g AS MATERIALIZED (SELECT size, row_number() OVER (ORDER BY size DESC) AS nth FROM (SELECT g, count(*) AS size FROM ({_GROUPED.format(lineitem='lineitem')}) GROUP BY g)), deal AS (SELECT 0::BIGINT AS nth, list_resize([]::BIGINT[], 10, 0) AS load, list_resize([]::BIGINT[], 10, 0) AS n UNION ALL SELECT g.nth, list_transform(load, lambda x, i: CASE WHEN i = list_position(load, list_min(load)) THEN x + g.size ELSE x END), list_transform(n, lambda x, i: CASE WHEN i = list_position(load, list_min(load)) THEN x + 1 ELSE x END) FROM deal JOIN g ON g.nth = deal.nth + 1) SELECT (unnest(range(10)))::INT AS fold, unnest(n) AS groups, unnest(load) AS rows FROM deal WHERE nth = (SELECT max(nth) FROM g)"


def _parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.group_part(spark.sql(_GROUPED, **tables(spark, sf_dir, "lineitem")), "g", 0.1111, 13).groupBy("chosen").agg(F.count("*").alias("groups"))


_SPARK["group_part"] = _parted
_SQL["group_part"] = f"SELECT c AS chosen, CASE WHEN c THEN ceil(n * 0.1111)::BIGINT ELSE n - ceil(n * 0.1111)::BIGINT END AS groups FROM (SELECT count(DISTINCT g) AS n FROM ({_GROUPED.format(lineitem='lineitem')})), (VALUES (true), (false)) AS v(c)"

# --- clauses ---------------------------------------------------------------------------
#: A section of a document as an item: its leaves' evidence in one text, and clauses in another order, with gaps and repeats.
_CLAUSE = "CASE WHEN k % 19 = 3 THEN 'not in the text' WHEN k % 23 = 4 THEN '' ELSE evidence_text END AS evidence, CASE WHEN k % 19 = 3 AND k % 2 = 0 THEN evidence_text WHEN k % 7 = 2 THEN 'before' ELSE entity_text END AS said, k % 11 = 3 AS negated, CASE k % 4 WHEN 0 THEN 'OR' WHEN 1 THEN NULL ELSE 'AND' END AS connector, CASE WHEN k % 9 = 4 THEN 'AT_LEAST' END AS qtype, k % 3 AS qvalue"
_ITEMS_SPARK = f"SELECT concat(document_id, '_', criterion_type) AS item_uid, array_join(transform(array_sort(collect_list(struct(key_id AS o, evidence_text AS x))), y -> y.x), ' or ') AS item_text, transform(array_sort(collect_list(struct(k AS o, key_id, said, evidence, negated, connector, qtype, qvalue))), c -> struct(c.said AS clause_text, c.evidence AS evidence_text, c.negated AS is_negated, c.connector AS connector_to_next, c.qtype AS quantifier_type, CASE WHEN c.qtype IS NOT NULL THEN c.qvalue END AS quantifier_value)) AS clauses FROM (SELECT *, {_CLAUSE} FROM {{leaf}}) AS l GROUP BY document_id, criterion_type"
_ITEMS_DUCK = f"items AS MATERIALIZED (SELECT document_id || '_' || criterion_type AS item_uid, string_agg(evidence_text, ' or ' ORDER BY key_id) AS item_text FROM leaf GROUP BY document_id, criterion_type), parts AS MATERIALIZED (SELECT document_id || '_' || criterion_type AS item_uid, row_number() OVER w AS nth, count(*) OVER (PARTITION BY document_id, criterion_type) AS n, said, evidence, negated, connector, qtype, qvalue FROM (SELECT *, {_CLAUSE} FROM leaf) WINDOW w AS (PARTITION BY document_id, criterion_type ORDER BY k, key_id))"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_ITEMS_SPARK, leaf=leaves(spark, sf_dir))


def _clause_query(name: str, run: Callable[[DataFrame], DataFrame], sql: str) -> None:
    _SPARK[name] = lambda s, d: run(_items(s, d))
    _SQL[name] = f"WITH RECURSIVE leaf AS MATERIALIZED ({leaves_sql()}), {_ITEMS_DUCK} {sql}"


_FIND = "(SELECT CASE WHEN {what} <> '' AND strpos(substr(i.item_text, {behind} + 1), {what}) > 0 THEN strpos(substr(i.item_text, {behind} + 1), {what}) + {behind} - 1 END)"
_PLACES = ", ".join(f"{_FIND.format(what=w, behind=b)} AS {n}" for w, b, n in (("p.evidence", "f.cursor", "e1"), ("p.said", "f.cursor", "c1"), ("p.evidence", "0", "e0"), ("p.said", "0", "c0")))
_clause_query("clause_places", lambda i: clauses.located(clauses.with_ids(i)).select("item_uid", F.explode("clauses").alias("c")).select("item_uid", "c.clause_id", "c.start", "c.end"),
              f", fold AS (SELECT item_uid, 0::BIGINT AS nth, 0::BIGINT AS cursor, NULL::BIGINT AS s, NULL::BIGINT AS e FROM items UNION ALL SELECT item_uid, nth, coalesce(e, cursor), s, e FROM (SELECT item_uid, nth, cursor, coalesce(e1, c1, e0, c0) AS s, coalesce(e1 + length(evidence), c1 + length(said), e0 + length(evidence), c0 + length(said)) AS e FROM (SELECT f.item_uid, p.nth, f.cursor, p.evidence, p.said, {_PLACES} FROM fold AS f JOIN parts AS p ON p.item_uid = f.item_uid AND p.nth = f.nth + 1 JOIN items AS i ON i.item_uid = f.item_uid))) SELECT item_uid, 'C' || nth AS clause_id, s AS start, e AS \"end\" FROM fold WHERE nth > 0")
_clause_query("clause_sanity", lambda i: clauses.sanity(i).select("item_uid", "error"),
              ", bad AS (SELECT item_uid, arg_min(e, nth) AS e FROM (SELECT p.item_uid, nth, CASE WHEN trim(evidence) = '' THEN 'Clause ' || nth || ' has empty evidence_text.' WHEN NOT contains(item_text, trim(evidence)) THEN 'Clause ' || nth || ' evidence_text is not an exact substring of item_text.' END AS e FROM parts AS p JOIN items USING (item_uid)) WHERE e IS NOT NULL GROUP BY item_uid) SELECT i.item_uid, CASE WHEN l.connector IS NOT NULL THEN 'Last clause must have connector_to_next = null.' ELSE b.e END AS error FROM items AS i JOIN parts AS l ON l.item_uid = i.item_uid AND l.nth = l.n LEFT JOIN bad AS b ON b.item_uid = i.item_uid")
_clause_query("logic_chains", lambda i: clauses.with_ids(i).select("item_uid", clauses.logic_chain(F.col("clauses")).alias("chain")),
              "SELECT item_uid, string_agg(CASE WHEN qtype IS NOT NULL THEN '[' || qtype || ' ' || qvalue || '] ' ELSE '' END || CASE WHEN negated THEN 'NOT(' ELSE '' END || 'C' || nth || ': ' || trim(regexp_replace(said, '\\s+', ' ', 'g')) || CASE WHEN negated THEN ')' ELSE '' END || CASE WHEN nth < n AND connector IS NOT NULL THEN ' ' || connector ELSE '' END, ' ' ORDER BY nth) AS chain FROM parts GROUP BY item_uid")
_clause_query("first_quantifiers", lambda i: clauses.first_quantifier(i).select("item_uid", "quantifier.*"),
              "SELECT item_uid, arg_min(qtype, nth) FILTER (qtype IS NOT NULL) AS quantifier_type, arg_min(qvalue, nth) FILTER (qtype IS NOT NULL) AS value FROM parts GROUP BY item_uid")
_HARD = " OR ".join(f"contains(lower(item_text), '{w}')" for w in (*clauses.TRICKY, "."))
_clause_query("clause_audit", lambda i: clauses.audit(clauses.with_ids(i)),
              f", c AS (SELECT item_uid, bool_or(connector = 'OR' AND nth < n) AS o, bool_or(connector = 'AND' AND nth < n) AS a, count(*) FILTER (evidence <> '' AND NOT contains(item_text, evidence)) AS missed FROM parts JOIN items USING (item_uid) GROUP BY item_uid) SELECT count(*) AS items, count(*) AS with_clauses, count(*) AS last_connector_null, count(*) FILTER (contains(lower(item_text), ' or ')) AS say_or, count(*) FILTER (contains(lower(item_text), ' or ') AND o) AS say_or_with_or, count(*) FILTER (contains(lower(item_text), ' and ')) AS say_and, count(*) FILTER (contains(lower(item_text), ' and ') AND a) AS say_and_with_and, count(*) FILTER ({_HARD}) AS tricky, sum(missed)::BIGINT AS evidence_missing FROM items JOIN c USING (item_uid)")

# --- trees put together ------------------------------------------------------------------
#: Up to three items of a section; some clauses have no leaf, or an earlier one too.
_BUILT = "SELECT document_id, criterion_type, k % 3 AS item_index, concat(document_id, '_', substr(criterion_type, 1, 3), '__item', CAST(k % 3 AS STRING)) AS item_uid, key_id, k, entity_text, evidence_text, CASE k % 4 WHEN 0 THEN 'OR' WHEN 1 THEN NULL ELSE 'AND' END AS connector, CASE WHEN k % 29 = 4 THEN 'AT_MOST' END AS qtype, k % 5 AS qvalue FROM LEAF"
_NUMBERED = f"SELECT *, concat('C', CAST(row_number() OVER (PARTITION BY item_uid ORDER BY key_id) AS STRING)) AS clause_id, row_number() OVER (PARTITION BY item_uid ORDER BY key_id) AS nth, count(*) OVER (PARTITION BY item_uid) AS n FROM ({_BUILT}) AS b"
_BUILT_LEAF = """concat('{"criterion_id":"', item_uid, '_', clause_id, '","entity_text":"', entity_text, '"}')"""


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(_NUMBERED.replace("LEAF", "{leaf}"), leaf=leaves(spark, sf_dir))
    clause = F.struct("nth", F.col("entity_text").alias("clause_text"), "evidence_text", F.lit(False).alias("is_negated"), F.col("connector").alias("connector_to_next"), F.col("qtype").alias("quantifier_type"), F.col("qvalue").alias("quantifier_value"))
    items = own.groupBy("document_id", "criterion_type", "item_index", "item_uid").agg(F.array_sort(F.collect_list(clause)).alias("clauses"))
    leaf = F.expr(_BUILT_LEAF)
    given = own.where("k % 17 <> 3").select("item_uid", "clause_id", leaf.alias("leaf"), F.lit(2).alias("ord")).unionByName(own.where("k % 7 = 3 and k % 17 <> 3").select("item_uid", "clause_id", F.lit("{}").alias("leaf"), F.lit(1).alias("ord")))
    return assemble.documents(assemble.item_trees(clauses.with_ids(items), given)).select("document_id", F.md5("doc").alias("digest"))


_SPARK["assembled_documents"] = _assembled
_SQL["assembled_documents"] = f"""WITH leaf AS MATERIALIZED ({leaves_sql()}), c AS MATERIALIZED ({_NUMBERED.replace('LEAF', 'leaf')}),
l AS MATERIALIZED (SELECT *, '{{"node_type":"criterion","criterion":' || CASE WHEN k % 17 <> 3 THEN {_BUILT_LEAF} ELSE '{{"criterion_id":"' || item_uid || '_' || clause_id || '","entity_type":"other","entity_text":"' || entity_text || '","normalized_concept":null,"operator":"exists","value_type":"null","value":null,"unit":null,"temporal_context":null,"computability":"partial","non_computable_reason":"{assemble.MISSING}","evidence_text":"' || evidence_text || '","provenance":{{"source_modifier_text":null,"source_condition_text":null,"source_exception_context":null,"history_context_hint":null}},"history_context":null}}' END || '}}' AS node,
  sum(CASE WHEN before IS NOT DISTINCT FROM 'AND' THEN 0 ELSE 1 END) OVER (PARTITION BY item_uid ORDER BY nth ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(connector) OVER (PARTITION BY item_uid ORDER BY nth) AS before FROM c)),
r AS (SELECT document_id, criterion_type, item_index, item_uid, run, CASE WHEN count(*) = 1 THEN any_value(node) ELSE '{{"node_type":"group","group_operator":"AND","children":[' || string_agg(node, ',' ORDER BY nth) || ']}}' END AS part FROM l GROUP BY document_id, criterion_type, item_index, item_uid, run),
q AS (SELECT item_uid, arg_min(qtype, nth) FILTER (qtype IS NOT NULL) AS qtype, arg_min(qvalue, nth) FILTER (qtype IS NOT NULL) AS qvalue, string_agg(node, ',' ORDER BY nth) AS flat FROM l GROUP BY item_uid),
t AS (SELECT document_id, criterion_type, item_index, item_uid, CASE WHEN any_value(q.qtype) IS NOT NULL THEN '{{"node_type":"group","group_operator":"OR","children":[' || any_value(q.flat) || '],"group_quantifier":{{"quantifier_type":"' || any_value(q.qtype) || '","value":' || any_value(q.qvalue) || '}}}}' WHEN count(*) = 1 THEN any_value(part) ELSE '{{"node_type":"group","group_operator":"OR","children":[' || string_agg(part, ',' ORDER BY run) || ']}}' END AS tree FROM r JOIN q USING (item_uid) GROUP BY document_id, criterion_type, item_index, item_uid),
s AS (SELECT document_id, criterion_type, CASE WHEN count(*) = 1 THEN any_value(tree) WHEN criterion_type = 'inclusion' THEN '{{"node_type":"group","group_operator":"AND","children":[' || string_agg(tree, ',' ORDER BY item_index) || '],"polarity":"include"}}' ELSE '{{"node_type":"group","group_operator":"OR","children":[' || string_agg(tree, ',' ORDER BY item_index) || '],"polarity":"exclude"}}' END AS section FROM t GROUP BY document_id, criterion_type)
SELECT document_id, md5('{{"document_id":"' || document_id || '","rules_v3_ast":{{"trial_id":"' || document_id || '","inclusion_criteria":' || coalesce(max(section) FILTER (criterion_type = 'inclusion'), 'null') || ',"exclusion_criteria":' || coalesce(max(section) FILTER (criterion_type = 'exclusion'), 'null') || '}}}}') AS digest FROM s GROUP BY document_id"""

# --- trees as text ---------------------------------------------------------------------
_SPARK["tree_chains"] = lambda s, d: nested.logic_text(trees.documents(s, d))
_SQL["tree_chains"] = trees.oracle_with("""walk AS (SELECT document_id, section, node, []::BIGINT[] AS place, '' AS before, 0::BIGINT AS closes, CASE WHEN json_extract_string(node, '$.node_type') = 'group' THEN coalesce(json_array_length(node, '$.children'), 0)::BIGINT ELSE 0 END AS n FROM (ROOTS)
  UNION ALL SELECT document_id, section, node, place, before, closes, CASE WHEN json_extract_string(node, '$.node_type') = 'group' THEN coalesce(json_array_length(node, '$.children'), 0)::BIGINT ELSE 0 END FROM (SELECT w.document_id, w.section, json_extract(w.node, '$.children[' || i || ']') AS node, list_append(w.place, i) AS place,
    CASE WHEN i = 0 THEN w.before || CASE WHEN json_extract_string(w.node, '$.group_operator') = 'NOT' THEN 'NOT(' ELSE '(' END WHEN json_extract_string(w.node, '$.group_operator') = 'OR' THEN ' OR ' ELSE ' AND ' END AS before, CASE WHEN i = w.n - 1 THEN w.closes + 1 ELSE 0 END AS closes FROM walk AS w, LATERAL (SELECT unnest(range(w.n)) AS i) AS c))
  SELECT document_id, section, count(*) AS n, string_agg(before || said || repeat(')', closes), '' ORDER BY place) AS chain FROM (SELECT *, CASE WHEN json_extract_string(node, '$.node_type') = 'group' THEN coalesce(json_extract_string(node, '$.group_operator'), 'GROUP') || '()' WHEN json_extract_string(node, '$.criterion.operator') = 'not_exists' THEN 'NOT(' || l || ')' ELSE l END AS said FROM (SELECT *, coalesce(regexp_extract(json_extract_string(node, '$.criterion.criterion_id'), '([^_]*)$', 1), '?') || ': ' || trim(coalesce(json_extract_string(node, '$.criterion.entity_text'), '')) AS l FROM walk WHERE n = 0)) GROUP BY ALL""")

# --- traces ----------------------------------------------------------------------------
#: Calls of a conversation as a JSON array: some without use, without a total, with nulls; some texts are no array.
_TRACE = """CASE turn % 5 WHEN 0 THEN concat('{"kind":"judge","token_usage":{"prompt_tokens":', n, ',"completion_tokens":7,"total_tokens":', n + 7, '}}') WHEN 1 THEN '{"kind":"repair"}' WHEN 2 THEN concat('{"token_usage":{"prompt_tokens":', n, '}}') WHEN 3 THEN concat('{"token_usage":{"prompt_tokens":null,"total_tokens":', n, '},"messages":[{"x":1}]}') ELSE '{"token_usage":null}' END"""


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT conv_id, turn, coalesce(length(text), 0) AS n FROM {conversations}", **tables(spark, sf_dir, "conversations"))
    joined = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("turn", F.expr(_TRACE).alias("x")))), lambda y: y["x"]))
    whole = F.when(F.col("conv_id") % 9 == 4, F.lit('{"broken"')).when(F.col("conv_id") % 9 == 5, F.lit("{}")).otherwise(F.concat(F.lit("["), joined, F.lit("]")))
    return own.groupBy("conv_id").agg(whole.alias("traces"))


_SPARK["trace_tokens"] = lambda s, d: _traces(s, d).select("conv_id", *judge.token_use("traces"))
_SQL["trace_tokens"] = "SELECT conv_id, (count(*) FILTER (c))::INT AS calls, coalesce(sum(n) FILTER (c AND turn % 5 = 0), 0)::BIGINT AS prompt_tokens, (7 * count(*) FILTER (c AND turn % 5 = 0))::BIGINT AS completion_tokens, coalesce(sum(n + CASE WHEN turn % 5 = 0 THEN 7 ELSE 0 END) FILTER (c), 0)::BIGINT AS total_tokens FROM (SELECT conv_id, turn, coalesce(length(text), 0) AS n, turn % 5 IN (0, 3) AND conv_id % 9 NOT IN (4, 5) AS c FROM conversations) GROUP BY conv_id"


# --- span cleaning and grounding ------------------------------------------------------
_TEXTS = "CASE k % 14 WHEN 0 THEN '[' WHEN 1 THEN concat(entity_text, ' [') WHEN 2 THEN concat('] ', entity_text) WHEN 3 THEN '12' WHEN 4 THEN concat('>= ', qty, '  mg (and < ', qty, ')') WHEN 5 THEN 'a]' WHEN 6 THEN '' WHEN 7 THEN concat('grade ', qty) WHEN 8 THEN 'at least 5 or less' WHEN 9 THEN '<' WHEN 10 THEN 'ab' WHEN 11 THEN '≥ x' WHEN 12 THEN concat(entity_text, ' != ', qty, ' = ', qty) ELSE entity_text END"
_LABELS = "CASE k % 9 WHEN 0 THEN 'Condition' WHEN 1 THEN 'Drug' WHEN 2 THEN 'Procedure' WHEN 3 THEN 'Measurement' WHEN 4 THEN 'Device' WHEN 5 THEN 'Value' WHEN 6 THEN 'Qualifier' WHEN 7 THEN 'Temporal' ELSE 'Reference_point' END"
_SPANS = f"SELECT key_id, {_TEXTS} AS text, {_LABELS} AS label, CASE WHEN k % 6 <> 2 THEN 0.5 + CAST(l_discount AS DOUBLE) * 2 END AS score_min FROM LEAF"


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(spark.sql(_SPANS.replace("LEAF", "{leaf}"), leaf=leaves(spark, sf_dir)), *cleaning.STEPS).select("key_id", "nested_value", "junk", "qa_flags", "part")


_SPARK["cleaned_spans"] = _cleaned
_SQL["cleaned_spans"] = rf"""WITH leaf AS MATERIALIZED ({leaves_sql()}), s AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM ({_SPANS.replace('LEAF', 'leaf')})),
f AS (SELECT *, t = '' OR t[-1:] IN ('[', '/') OR t[1:1] = ']' OR (len(t) <= 6 AND (t LIKE '%]' AND t NOT LIKE '%[%' OR t LIKE '[%' AND t NOT LIKE '%]%')) AS bad, regexp_matches(t, '[()\[\]]') AS br, regexp_matches(t, '\p{{L}}') AS letter, regexp_full_match(t, '\p{{Nd}}+') AS num,
  len(list_filter(regexp_extract_all(t, '[<>=!]+'), lambda x: list_contains(['<=', '>=', '!=', '<', '>', '='], x))) + len(regexp_extract_all(lower(t), '\b(less than|greater than|at least|or older|or less)\b')) AS n FROM s)
SELECT key_id, br AND n >= 2 AS nested_value, bad OR (len(t) = 1 AND NOT list_contains(['<', '>', '='], t)) OR (num AND list_contains(['Condition', 'Procedure', 'Measurement'], label)) OR (label = 'Measurement' AND NOT letter) AS junk,
  concat_ws(';', CASE WHEN len(t) >= 25 THEN 'long_span' END, CASE WHEN br THEN 'bracketed_span' END, CASE WHEN n >= 2 THEN 'multi_comparison' END, CASE WHEN score_min < 0.6::DOUBLE THEN 'low_score_min' END, CASE WHEN list_contains(['Condition', 'Procedure', 'Measurement'], label) AND len(list_filter(string_split(t, ' '), lambda x: x <> '')) = 1 THEN 'single_token_base_label' END) AS qa_flags,
  CASE WHEN CASE label WHEN 'Condition' THEN NOT num AND len(t) >= 2 AND letter AND NOT bad WHEN 'Drug' THEN len(t) >= 3 AND letter WHEN 'Procedure' THEN letter AND len(t) >= 4 AND NOT bad WHEN 'Measurement' THEN letter AND NOT bad WHEN 'Device' THEN len(t) >= 3 ELSE false END THEN 'anchor'
    WHEN t <> '' AND (label IN ('Qualifier', 'Temporal') OR label = 'Value' AND regexp_matches(lower(t), '\p{{Nd}}|[<>=≤≥]|grade|negative|positive')) THEN 'support' ELSE 'other' END AS part FROM f"""
#: A leaf's clause with none, one or two anchors of which the first or the second is the better one.
_GROUNDED = "SELECT operator, CASE WHEN k % 31 = 4 THEN 'Severe' ELSE entity_text END AS entity_text, entity_type, evidence_text, k % 3 AS n, CASE WHEN k % 4 = 0 THEN 'other words' ELSE concat(entity_text, ' x') END AS t1, CASE WHEN k % 5 <> 2 THEN CAST(anchor_score AS DOUBLE) END AS s1, CASE k % 6 WHEN 0 THEN 'Drug' WHEN 1 THEN 'Measurement' WHEN 2 THEN 'Value' ELSE 'Condition' END AS l1, concat('two ', evidence_text) AS t2, CASE WHEN k % 7 <> 3 THEN CAST(0.6 AS DOUBLE) END AS s2, 'Measurement' AS l2, k % 2 AS n_other FROM LEAF"


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(_GROUNDED.replace("LEAF", "{leaf}"), leaf=leaves(spark, sf_dir))
    anchor = lambda i: F.struct(F.col(f"t{i}").alias("text"), F.col(f"l{i}").alias("label"), F.col(f"s{i}").alias("score"))
    return grounding.rates(own.withColumn("anchors", F.slice(F.array(anchor(1), anchor(2)), F.lit(1), F.col("n").cast("int"))), "operator")


_SPARK["grounding_rates"] = _rated
_WORDS = "regexp_extract_all(lower({}), '[a-z0-9+-]+')"
_SQL["grounding_rates"] = f"""WITH leaf AS MATERIALIZED ({leaves_sql()}), g AS ({_GROUNDED.replace('LEAF', 'leaf')}), b AS (SELECT *, n = 2 AND (coalesce(s2, -1) > coalesce(s1, -1) OR coalesce(s2, -1) = coalesce(s1, -1) AND length(t2) > length(t1)) AS two, len(list_intersect({_WORDS.format('entity_text')}, {_WORDS.format('t1')})) > 0 AS m1, len(list_intersect({_WORDS.format('entity_text')}, {_WORDS.format('t2')})) > 0 AS m2 FROM g),
f AS (SELECT *, trim(entity_text) <> '' AS ne, trim(entity_text) <> '' AND contains(lower(evidence_text), lower(trim(entity_text))) AS ev, n > 0 AS an, n > 0 OR n_other > 0 AS cand, n > 0 AND m1 OR n = 2 AND m2 AS any_, n > 0 AND CASE WHEN two THEN m2 ELSE m1 END AS best, n > 0 AND coalesce(map_from_entries([('Condition', 'condition'), ('Drug', 'drug'), ('Procedure', 'procedure'), ('Measurement', 'lab'), ('Device', 'other')])[CASE WHEN two THEN l2 ELSE l1 END] = entity_type, false) AS ty, list_contains([{', '.join(repr(w) for w in grounding.GENERIC)}], lower(trim(entity_text))) AS ge FROM b)
SELECT operator, count(*) AS n, {', '.join(f"CASE WHEN {of} > 0 THEN round(count(*) FILTER ({test}) / {of}, 4) END AS {name}" for name, test, of in (("entity_nonempty", "ne", "count(*)"), ("entity_in_evidence", "ev", "count(*)"), ("anchor_present", "an", "count(*)"), ("no_anchor", "NOT an", "count(*)"), ("any_candidate_present", "cand", "count(*)"), ("no_candidate", "NOT cand", "count(*)"), ("in_evidence_when_anchored", "ev AND an", "count(*) FILTER (an)"), ("in_evidence_when_not_anchored", "ev AND NOT an", "count(*) FILTER (NOT an)"), ("overlaps_any_when_anchored", "any_ AND an", "count(*) FILTER (an)"), ("overlaps_best_when_anchored", "best AND an", "count(*) FILTER (an)"), ("overlaps_any", "any_", "count(*)"), ("overlaps_best", "best", "count(*)"), ("type_match_of_anchored", "ty", "count(*) FILTER (an)"), ("generic_entity", "ge", "count(*)")))} FROM f GROUP BY operator"""

# --- anchors, values, annotations ------------------------------------------------------
#: A clause with up to three anchors, a qualifier twice, a value or none; without anchors two others.
_ANCHORED = """SELECT key_id, CASE WHEN k % 6 = 1 THEN '' ELSE evidence_text END AS clause_text, evidence_text, k % 4 AS n, k % 5 = 2 AS valued, entity_text AS t1, CASE k % 3 WHEN 0 THEN 'Drug' WHEN 1 THEN 'Measurement' ELSE 'Visit' END AS l1, CASE WHEN k % 7 <> 2 THEN CAST(anchor_score AS DOUBLE) END AS s1, k % 9 AS e1, concat('Old ', entity_text) AS t2, CASE WHEN k % 2 = 0 THEN 'Condition' ELSE 'Measurement' END AS l2, CAST(0.75 AS DOUBLE) AS s2, k % 11 AS e2, 'days' AS t3, 'Condition' AS l3, CAST(0.75 AS DOUBLE) AS s3, 4 AS e3 FROM LEAF"""


def _anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(_ANCHORED.replace("LEAF", "{leaf}"), leaf=leaves(spark, sf_dir))
    one = lambda i: F.struct(F.col(f"t{i}").alias("text"), F.col(f"l{i}").alias("label"), F.col(f"s{i}").alias("score"), F.lit(0).alias("start"), F.col(f"e{i}").cast("int").alias("end"))
    said = lambda text, label: F.struct(F.lit(text).alias("text"), F.lit(label).alias("label"))
    three = F.array(one(1), one(2), one(3))
    supports = F.array_compact(F.array(said("severe  form", "Qualifier"), said("severe form", "Qualifier"), F.when(F.col("valued"), said("5", "Value")), F.when(F.col("n") == 2, said("mild", "Qualifier"))))
    own = own.select("key_id", "clause_text", "evidence_text", F.slice(three, F.lit(1), F.col("n").cast("int")).alias("anchors"), F.when(F.col("n") == 3, F.filter(supports, lambda s: s["label"] == "Value")).otherwise(supports).alias("supports"), F.slice(three, 1, 2).alias("others"))
    return anchors.with_anchor(own).select("key_id", F.col("anchor.label").alias("label"), F.col("anchor.text").alias("anchor_text"), anchors.entity_text().alias("entity"), anchors.modifier_text().alias("modifier"))


_SPARK["clause_anchors"] = _anchored
_SQL["clause_anchors"] = f"""WITH leaf AS MATERIALIZED ({leaves_sql()}), a AS ({_ANCHORED.replace('LEAF', 'leaf')}), c AS (SELECT *, lower(trim(regexp_replace(clause_text, ' +', ' ', 'g'))) AS lc, lower(trim(regexp_replace(evidence_text, ' +', ' ', 'g'))) AS le FROM a),
v AS (SELECT *, valued OR regexp_matches(lc || ' ' || le, '(<=|>=|(^|[^<>=!])[<>=]($|[^=])|\\b(between|above|below|less than|greater than|at least|at most)\\b)') AS val FROM c),
o AS (SELECT key_id, lc, le, val, 1 AS i, t1 AS t, l1 AS l, s1 AS s, e1 AS e FROM v WHERE n >= 1 OR l1 <> 'Visit' UNION ALL SELECT key_id, lc, le, val, 2, t2, l2, s2, e2 FROM v WHERE n >= 2 OR n = 0 UNION ALL SELECT key_id, lc, le, val, 3, t3, l3, s3, e3 FROM v WHERE n = 3),
r AS (SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY CASE l WHEN 'Measurement' THEN CASE WHEN val THEN 0 ELSE 3 END WHEN 'Condition' THEN val::INT WHEN 'Drug' THEN 1 + val::INT ELSE 9 END, (NOT (trim(t) <> '' AND contains(lc, lower(trim(t)))))::INT, (NOT (trim(t) <> '' AND contains(le, lower(trim(t)))))::INT, -len(list_intersect(list_distinct(regexp_extract_all(lower(t), '[a-z0-9]+')), regexp_extract_all(lc, '[a-z0-9]+'))), -coalesce(s, -1), -e, i) AS nth FROM o)
SELECT v.key_id, r.l AS label, r.t AS anchor_text, CASE WHEN trim(coalesce(r.t, '')) <> '' THEN trim(regexp_replace(r.t, ' +', ' ', 'g')) WHEN clause_text <> '' THEN trim(regexp_replace(clause_text, ' +', ' ', 'g')) ELSE trim(regexp_replace(evidence_text, ' +', ' ', 'g')) END AS entity, CASE n WHEN 3 THEN NULL WHEN 2 THEN 'severe form | mild' ELSE 'severe form' END AS modifier FROM v LEFT JOIN r ON r.key_id = v.key_id AND r.nth = 1"""
#: Values as people and models write them; what the sources say of them.
_VALUED = """SELECT key_id, k, qty, CAST(p_size AS STRING) AS size, CASE k % 12 WHEN 0 THEN '' WHEN 1 THEN qty WHEN 2 THEN concat('[', qty, ', ', CAST(p_size AS STRING), ']') WHEN 3 THEN concat('{"min":', qty, ',"max":null}') WHEN 4 THEN concat('{"lower":"', qty, '","value":[1,"two"]}') WHEN 5 THEN 'non-smoker' WHEN 6 THEN '"9,876 x ULN"' WHEN 7 THEN 'three' WHEN 8 THEN '99999' WHEN 9 THEN '[]' WHEN 10 THEN 'null' ELSE 'no json {' END AS value_text, CASE WHEN k % 15 = 3 THEN 'Null' ELSE 'scalar' END AS value_type, CASE WHEN k % 10 = 5 THEN 'a non-smoking adult' WHEN k % 10 = 6 THEN 'one or 3 and 9876 xULN' ELSE evidence_text END AS evidence_text, CASE WHEN k % 4 = 1 THEN concat('in ', qty, ' to ', CAST(p_size AS STRING)) ELSE 'item' END AS item_text, k % 17 = 2 AS in_evidence, k % 3 = 1 AS in_item FROM LEAF"""


def _valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(_braced(_VALUED), leaf=leaves(spark, sf_dir))
    return apply(own, *values.VALUE).select("key_id", F.array_join("v_atoms", "|").alias("atoms"), "value_support", "value_reason")


def _value_sql() -> str:
    from . import oracle

    n = oracle._numeric
    return f"""WITH leaf AS MATERIALIZED ({leaves_sql()}), v AS ({_VALUED.replace('LEAF', 'leaf')}), a AS (SELECT *, CASE k % 12 WHEN 1 THEN [qty] WHEN 2 THEN [qty, size] WHEN 3 THEN [qty] WHEN 4 THEN [qty, '1', 'two'] WHEN 5 THEN ['non-smoker'] WHEN 6 THEN ['9,876 x ULN'] WHEN 7 THEN ['three'] WHEN 8 THEN ['99999'] WHEN 11 THEN ['no json {{'] ELSE []::VARCHAR[] END AS atoms FROM v),
b AS (SELECT *, {n('value_text')} AS vn, {n('evidence_text')} AS en, {n('item_text')} AS ino, list_filter(list_transform(atoms, lambda x: {n('x')}), lambda x: x <> '') AS parts FROM a),
c AS (SELECT *, trim(value_text) = '' OR lower(value_type) = 'null' OR in_evidence OR len(parts) = 0 OR (vn <> '' AND (contains(en, vn) OR contains(ino, vn))) OR len(list_filter(parts, lambda p: NOT contains(en || ' ' || ino, p))) = 0 OR (vn = 'non-smoker' AND contains(en, 'non-smoking')) AS held FROM b)
SELECT key_id, array_to_string(atoms, '|') AS atoms, CASE WHEN held THEN 1.0 WHEN in_item THEN 0.85 ELSE 0.45 END::DOUBLE AS value_support, CASE WHEN held THEN '' WHEN in_item THEN 'value_not_in_evidence_but_in_item' ELSE 'value_not_grounded_in_evidence_or_item' END AS value_reason FROM c"""


_SPARK["value_grounding"] = _valued


def _graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as annotated rows: turns as entities, each related to the next one and to one that is missing."""
    own = spark.sql("SELECT conv_id, turn, role, text FROM {conversations}", **tables(spark, sf_dir, "conversations"))
    entity = F.struct(F.concat(F.lit("T"), "turn").alias("id"), F.col("role").alias("type"), F.array("text").alias("text"), F.when(F.col("turn") % 2 == 0, F.array(F.array(F.lit(0), F.length("text")))).alias("offsets"))
    relation = F.struct(F.concat(F.lit("R"), "turn").alias("id"), F.when(F.col("turn") % 3 == 0, "AND").otherwise("OR").alias("type"), F.concat(F.lit("T"), "turn").alias("arg1_id"), F.concat(F.lit("T"), (F.col("turn") + 1).cast("string")).alias("arg2_id"))
    piece = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("turn", x.alias("x")))), lambda y: y["x"])
    rows = own.groupBy("conv_id").agg(piece(F.col("text")).alias("texts"), piece(entity).alias("entities"), piece(relation).alias("relations"))
    return rows.select(F.col("conv_id").cast("string").alias("id"), F.when(F.col("conv_id") % 3 > 0, F.concat(F.lit("d"), (F.col("conv_id") % 5).cast("string"))).alias("document_id"), F.array(F.struct("texts").cast("struct<text:array<string>>")).alias("passages"), "entities", "relations", F.col("conv_id").cast("string").alias("number"))


_SPARK["annotation_edges"] = lambda s, d: annotations.edges_with_ends(annotations.graph(_graphs(s, d))).select("id", "edge", "type", "from_type", "to_type")
_SQL["annotation_edges"] = "SELECT c.conv_id::VARCHAR AS id, 'R' || c.turn AS edge, CASE WHEN c.turn % 3 = 0 THEN 'AND' ELSE 'OR' END AS type, c.role AS from_type, n.role AS to_type FROM conversations AS c LEFT JOIN conversations AS n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1"
_SPARK["annotated_rows"] = lambda s, d: annotations.valid_rows(_graphs(s, d)).select("id", "document_id", F.md5("text").alias("digest"), "n_entities", "n_relations").join(_graphs(s, d).select("id", annotations.group_id("number").alias("group_id")), "id")
_SQL["annotated_rows"] = "SELECT conv_id::VARCHAR AS id, CASE WHEN conv_id % 3 > 0 THEN 'd' || conv_id % 5 END AS document_id, md5(trim(string_agg(text, ' ' ORDER BY turn))) AS digest, count(*)::INT AS n_entities, count(*)::INT AS n_relations, CASE WHEN conv_id % 3 > 0 THEN 'd' || conv_id % 5 ELSE conv_id::VARCHAR END AS group_id FROM conversations GROUP BY conv_id HAVING trim(string_agg(text, ' ' ORDER BY turn)) <> ''"

# --- the judge loop ------------------------------------------------------------------
#: Recorded plans, verdicts and repairs: verdicts that fail to parse, are missing or have single scores only; repairs that abstain, are missing or do not hold.
_PLAN = """SELECT key_id AS plan_id, key_id AS criterion_id, CASE WHEN k % 2 = 0 THEN 'entity_regrounding' ELSE '' END AS rescue_task_type, concat('{"criterion_id":"', key_id, '","entity_type":"drug","entity_text":"', entity_text, '","operator":"exists","value_type":"null","value":null,"unit":null,"computability":"computable","evidence_text":"', evidence_text, '"}') AS leaf, concat(evidence_text, ' in this study') AS context_text, '{}' AS a_leaf FROM LEAF WHERE k % 3 < 2"""
_VERDICT = """SELECT key_id AS plan_id, 'B_current' AS candidate_id, CASE WHEN k % 17 = 5 THEN 'error' ELSE 'ok' END AS parse_status, 'no object' AS parse_error, CASE WHEN k % 13 <> 1 THEN (k % 12) / 2.0 END AS average_score, 3.0 AS single, k % 9 = 4 AS crit FROM LEAF WHERE k % 23 <> 6
UNION ALL SELECT key_id, concat('LLM_candidate_', CAST(n AS STRING)), 'ok', '', ((k * 3 + n * 7) % 13) * 0.4, 0.0, (k + n) % 8 = 1 FROM LEAF, (VALUES (1), (2), (3)) AS v(n) WHERE (k + n) % 10 <> 2"""
_REPAIR = """SELECT key_id AS plan_id, n AS attempt, (k + n) % 7 = 3 AS abstain, concat('{"criterion_id":"other","entity_type":"', CASE WHEN (k + n) % 5 = 0 THEN 'device' ELSE 'lab' END, '","entity_text":"', entity_text, '"}') AS leaf FROM LEAF, (VALUES (1), (2), (3)) AS v(n) WHERE (k + n) % 4 <> 1"""


def _braced(sql: str) -> str:
    return sql.replace("{", "\\u007B").replace("}", "\\u007D").replace("LEAF", "{leaf}")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = leaves(spark, sf_dir)
    plans, given, repairs = (spark.sql(_braced(x), leaf=own) for x in (_PLAN, _VERDICT, _REPAIR))
    marks = F.map_from_arrays(F.array(*map(F.lit, judge.CRITERIA)), F.array_repeat(F.col("single").cast("double"), len(judge.CRITERIA)))
    verdicts = given.select("plan_id", "candidate_id", "parse_status", "parse_error", F.col("average_score").cast("double").alias("average_score"), marks.alias("scores"), F.array(F.when(F.col("crit"), " wrong entity ").otherwise(" ")).alias("critical_errors"))
    out = judge.run(plans, verdicts, repairs, f"slate-{uuid.uuid4().hex}")
    return out.select("plan_id", "final_decision", "selected_source", F.round("original_score", 6).alias("original_score"), F.round("best_score", 6).alias("best_score"), "used", "generated", "confidence", "local_validation_status")


_SPARK["judged_rescue"] = _judged
_ROUND = """s{n} AS MATERIALIZED (SELECT plan_id, b_ok, o, CASE WHEN better THEN 'LLM_candidate_{n}' ELSE src END AS src, CASE WHEN better THEN score ELSE best END AS best, CASE WHEN better THEN valid ELSE ok END AS ok, {n} AS used, gen + made::INT AS gen,
  (better OR src <> 'B_current') AND CASE WHEN better THEN score ELSE best END >= 4.0 AND CASE WHEN better THEN score ELSE best END - o >= 0.25 AS done FROM (SELECT *, made AND valid AND score > best AND NOT crit AS better FROM (
  SELECT s.*, r.attempt IS NOT NULL AS made, r.good AND s.grounded AS valid, coalesce(v.score, 0.0) AS score, coalesce(v.crit, true) AS crit FROM (SELECT q.*, p.grounded FROM s{m} AS q JOIN plan AS p USING (plan_id) WHERE NOT done) AS s LEFT JOIN repair AS r ON r.plan_id = s.plan_id AND r.attempt = {n} LEFT JOIN verdict AS v ON v.plan_id = s.plan_id AND v.candidate_id = 'LLM_candidate_{n}')))"""
_SQL["judged_rescue"] = f"""WITH leaf AS MATERIALIZED ({leaves_sql()}), plan AS MATERIALIZED (SELECT plan_id, trim(e) <> '' AND trim(v) <> '' AND contains(lower(v), lower(e)) AS grounded FROM (SELECT plan_id, json_extract_string(leaf, '$.entity_text') AS e, json_extract_string(leaf, '$.evidence_text') AS v FROM ({_PLAN.replace('LEAF', 'leaf')}))),
verdict AS MATERIALIZED (SELECT plan_id, candidate_id, CASE WHEN parse_status = 'ok' THEN least(5.0, greatest(0.0, coalesce(average_score, single)))::DOUBLE ELSE 0.0 END AS score, crit OR parse_status <> 'ok' AS crit FROM ({_VERDICT.replace('LEAF', 'leaf')})),
repair AS MATERIALIZED (SELECT plan_id, attempt, NOT contains(leaf, 'device') AS good FROM ({_REPAIR.replace('LEAF', 'leaf')}) WHERE NOT abstain),
s0 AS MATERIALIZED (SELECT plan_id, grounded AS b_ok, coalesce(score, 0.0) AS o, 'B_current' AS src, coalesce(score, 0.0) AS best, grounded AS ok, 0 AS used, 0 AS gen, coalesce(score >= 4.5 AND NOT crit, false) AS done FROM plan LEFT JOIN (SELECT * FROM verdict WHERE candidate_id = 'B_current') USING (plan_id)),
{', '.join(_ROUND.format(n=n, m=n - 1) for n in (1, 2, 3))},
last AS (SELECT *, CASE WHEN src = 'B_current' AND o >= 4.5 THEN 'no_change' WHEN src <> 'B_current' AND best >= 4.0 AND best - o >= 0.25 THEN 'select_candidate' ELSE 'human_review' END AS d FROM (SELECT * FROM s0 WHERE done UNION ALL SELECT * FROM s1 WHERE done UNION ALL SELECT * FROM s2 WHERE done UNION ALL SELECT * FROM s3))
SELECT plan_id, CASE WHEN ok THEN d ELSE 'human_review' END AS final_decision, CASE WHEN d = 'human_review' OR NOT ok THEN 'none' ELSE src END AS selected_source, round(o, 6) AS original_score, round(best, 6) AS best_score, used, gen AS generated,
  CASE WHEN d = 'human_review' OR NOT ok THEN 'low' WHEN d = 'select_candidate' OR o >= 4.75 THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN d = 'human_review' THEN 'not_applicable' WHEN ok THEN 'pass' ELSE 'fail' END AS local_validation_status FROM last"""


def queries() -> dict:
    return dict(_SPARK)


def oracle_sql() -> dict[str, str]:
    _register_gold()
    _SQL["value_grounding"] = _value_sql()
    return dict(_SQL)
