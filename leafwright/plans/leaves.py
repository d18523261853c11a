"""A deterministic leaf table over the star schema: same text for Spark and the oracle.

One leaf for each row of lineitem, with defects chosen by remainders, so every
check has rows on either side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_OPS = ("exists", "not_exists", "=", "!=", "<", "<=", ">", ">=", "between", "in", "contains", "about", "matches")
_TAILS = ("within {q} days before screening", "with a history of use", "unless approved by the sponsor", "", "prior to randomization", "if applicable", "with active uncontrolled disease")


def _case(number: str, values) -> str:
    return "CASE " + number + " " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def leaves_sql() -> str:
    q, s = "CAST(CAST(l_quantity AS BIGINT) AS STRING)", "CAST(p_size AS STRING)"
    tails = _case("(l_partkey % 7)", [("concat('within ', " + s + ", ' days before screening')") if "{q}" in t else repr(t) for t in _TAILS])
    ops = _case("o", [f"'{x}'" for x in _OPS])
    units = _case("(p_size % 5)", ["'mg'", "'day'", "'mg/dl'", "NULL", "'days'"])
    return f"""
    SELECT *, concat(item_uid, '_', clause_id) AS key_id,
      CASE WHEN k % 41 = 40 THEN NULL WHEN k % 37 = 36 THEN concat(item_uid, clause_id) ELSE concat(item_uid, '_', clause_id) END AS criterion_id,
      trim(concat_ws(' ', CASE WHEN k % 11 = 3 THEN 'no' END, CASE WHEN k % 13 = 5 THEN 'another lab' ELSE entity_text END, CASE WHEN operator IN ('<', '<=', '>', '>=', '=') THEN operator END, qty, CASE WHEN k % 17 = 4 THEN 'negative' END, {tails})) AS evidence_text
    FROM (
      SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, o_orderpriority, k, {q} AS qty, p_size,
        concat('NCT', lpad(CAST(l_orderkey AS STRING), 8, '0')) AS document_id,
        concat('NCT', lpad(CAST(l_orderkey AS STRING), 8, '0'), CASE WHEN l_returnflag = 'R' THEN '_exc' ELSE '_inc' END, '__item', CAST(l_linenumber AS STRING)) AS item_uid,
        concat('C', CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS STRING)) AS clause_id,
        CASE WHEN l_returnflag = 'R' THEN 'exclusion' ELSE 'inclusion' END AS criterion_type,
        {_case("(p_size % 7)", ["'lab'", "'drug'", "'vital'", "'condition'", "'observation'", "'other'", "'device'"])} AS entity_type,
        CASE WHEN k % 43 = 42 THEN '' WHEN k % 23 = 22 THEN 'of' ELSE lower(p_name) END AS entity_text,
        {ops} AS operator,
        CASE WHEN o IN (0, 1) THEN CASE WHEN k % 19 = 2 THEN 'scalar' ELSE 'null' END WHEN o = 8 THEN 'range' WHEN o = 9 THEN CASE WHEN k % 3 = 0 THEN 'null' ELSE 'list' END WHEN k % 29 = 7 THEN 'null' ELSE 'scalar' END AS value_type,
        CASE WHEN o IN (0, 1) THEN CASE WHEN k % 19 = 2 THEN 'number' ELSE 'null' END WHEN o = 8 THEN CASE WHEN k % 5 = 0 THEN 'null' ELSE 'range' END WHEN o = 9 THEN CASE WHEN k % 3 = 0 THEN 'null' ELSE 'list' END WHEN k % 7 = 3 THEN 'string' WHEN k % 13 = 1 THEN 'null' ELSE 'number' END AS value_kind,
        CASE WHEN o IN (0, 1, 8) THEN NULL WHEN k % 13 = 1 THEN NULL ELSE {q} END AS value_text,
        CASE WHEN o = 8 AND k % 4 <> 1 THEN l_quantity END AS value_min,
        CASE WHEN o = 8 AND k % 6 <> 1 THEN CAST(p_size AS DOUBLE) END AS value_max,
        CASE WHEN k % 21 = 13 THEN 'count' ELSE {units} END AS unit,
        CASE WHEN l_partkey % 7 IN (0, 4) AND k % 3 <> 0 THEN CASE WHEN l_partkey % 7 = 0 THEN 'within' WHEN k % 31 = 4 THEN 'near' ELSE 'before' END END AS t_relation,
        CASE WHEN l_partkey % 7 = 0 AND k % 3 <> 0 AND k % 8 <> 1 THEN {s} END AS t_value,
        CASE WHEN l_partkey % 7 = 0 AND k % 3 <> 0 AND k % 10 <> 1 THEN CASE WHEN k % 47 = 5 THEN 'fortnight' ELSE 'day' END END AS t_unit,
        CASE WHEN l_partkey % 7 IN (0, 4) AND k % 3 <> 0 THEN CASE k % 5 WHEN 0 THEN 'screening' WHEN 1 THEN 'randomization' WHEN 2 THEN 'screening' WHEN 3 THEN NULL ELSE 'visit' END END AS t_anchor,
        CASE k % 9 WHEN 0 THEN 'partial' WHEN 1 THEN 'non_computable' WHEN 2 THEN 'unknown' ELSE 'computable' END AS computability,
        CASE WHEN k % 28 = 15 THEN 'subjective; exception_context_unresolved' WHEN k % 14 = 1 THEN 'subjective' END AS non_computable_reason,
        CASE WHEN l_partkey % 7 = 1 AND k % 2 = 0 THEN 'prior' WHEN k % 53 = 9 THEN 'past' END AS history_context,
        CASE WHEN l_partkey % 7 = 5 AND k % 2 = 0 THEN 'if applicable' END AS cond_text,
        CASE WHEN l_partkey % 7 = 2 AND k % 2 = 1 THEN 'approved by the sponsor' END AS exc_text,
        CASE WHEN k % 16 = 2 THEN 'LOINC' WHEN k % 59 = 3 THEN 'OTHER' END AS concept_system,
        CASE WHEN k % 32 = 2 THEN '718-7' END AS concept_code,
        CAST(l_suppkey % 3 <> 0 AS BOOLEAN) AS has_anchor,
        CAST(0.5 AS DOUBLE) + l_discount * 4 AS anchor_score,
        CAST(k % 4 <> 1 AS BOOLEAN) AS anchor_type_match,
        CAST(k % 5 <> 2 AS BOOLEAN) AS anchor_overlap,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'correct' WHEN '2-HIGH' THEN 'partial' WHEN '3-MEDIUM' THEN 'incorrect' WHEN '4-NOT SPECIFIED' THEN 'correct' END AS manual_label
      FROM (SELECT *, (l_partkey + l_linenumber) % 13 AS o, (l_partkey * 7 + l_linenumber * 3 + l_suppkey * 11 + CAST(l_quantity AS BIGINT)) % 1003 AS k FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey) AS base
    ) AS inner_leaves
    """


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


_DOCUMENT = "concat('NCT', lpad(CAST(l_orderkey AS STRING), 8, '0'))"


def leaves(spark: SparkSession, sf_dir: str, whole_documents: bool = False) -> DataFrame:
    """The leaf table as a DataFrame; with ``whole_documents`` its rows lie together by document, which all else that groups by documents then finds."""
    own = tables(spark, sf_dir, "lineitem", "part", "orders")
    sql = leaves_sql()
    for name in own:
        sql = sql.replace(f" {name} ", f" {{{name}}} ")
    # One exchange by order for all windows over leaves; where both sides of the last join are large it has put them there anyway.
    by, own_id = ("document_id", f"{_DOCUMENT} AS document_id, ") if whole_documents else ("l_orderkey", "")
    sql = sql.replace("FROM (SELECT *, (l_partkey", f"FROM (SELECT /*+ REPARTITION({by}) */ *, {own_id}(l_partkey")
    if whole_documents:
        # The rows are narrow there; behind it whole texts would be shuffled. Long keys share a document, so it is not the order.
        sql = sql.replace(f"        {_DOCUMENT} AS document_id,", "        document_id,").replace("PARTITION BY l_orderkey, l_linenumber", "PARTITION BY document_id, l_orderkey, l_linenumber")
    return spark.sql(sql, **own)
