"""A stated query set against all vectors, which are scanned where they lie.

The vectors are written once, dealt by hash of the id. Queries come in waves of
bounded size, which are broadcast; every task scans its own vectors, in blocks,
and passes on its best few for each query. No vector is shipped for a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, settled

#: Queries of a wave, at most about so many.
WAVE = 16_384
#: Bytes of vectors in a part of the table: what a lost task costs again.
PART = 64 << 20


def usable(vectors: DataFrame, zero: bool = True) -> DataFrame:
    """vec_id and v (doubles) of the vectors that take part.

    Left out: null ids, null or empty vectors, vectors with a null or non-finite
    component and, unless ``zero``, all-zero ones. Of rows with one id the
    smallest vector counts.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    own = own.where("vec_id is not null and size(v) > 0").where(finite)
    if not zero:
        own = own.where(F.exists("v", lambda x: x != 0))
    return own.groupBy("vec_id").agg(F.min("v").alias("v"))


def dealt(vectors: DataFrame, name: str) -> DataFrame:
    """The table written in even parts of at most about ``PART`` bytes, at least two for each core."""
    vectors = settled(vectors, name)
    held = vectors.agg(F.sum(8 * F.size("v") + 8)).first()[0] or 0
    out = settled(vectors.repartition(max(2 * vectors.sparkSession.sparkContext.defaultParallelism, math.ceil(held / PART)), "vec_id"), name)
    discard(vectors)
    return out


def waves(queries: DataFrame, size: int = WAVE) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The queries (vec_id, v) in waves by hash: ids and matrix for each vector length."""
    queries = settled(queries.select("vec_id", "v"), "queries")
    n = queries.count()
    count = math.ceil(n / size)
    for k in range(count):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(count)) == k).collect()  # about size rows
        out: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: r.vec_id):
            out.setdefault(len(r.v), []).append(r)
        if out:
            yield {d: (np.array([r.vec_id for r in own]), np.array([r.v for r in own])) for d, own in out.items()}
    discard(queries)


def matrices(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Table]]:
    """ids, vectors and all columns, in blocks of at most ``block`` vectors of one length."""
    held: dict[int, list[pa.RecordBatch]] = {}

    def made(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, pa.Table]:
        table = pa.Table.from_batches(parts).combine_chunks()
        flat = table.column("v").combine_chunks().flatten()
        return table.column("vec_id").to_numpy(), np.asarray(flat, dtype=np.float64).reshape(table.num_rows, -1), table

    for batch in batches:
        widths = np.diff(np.asarray(batch.column("v").offsets))
        for d in np.unique(widths):
            own = batch if (widths == d).all() else batch.filter(pa.array(widths == d))
            at = 0
            while at < own.num_rows:
                parts = held.setdefault(int(d), [])
                room = block - sum(p.num_rows for p in parts)
                parts.append(own.slice(at, room))
                at += room
                if sum(p.num_rows for p in parts) >= block:
                    yield made(held.pop(int(d)))
    for parts in held.values():
        yield made(parts)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def found_batch(found: dict[int, tuple[np.ndarray, np.ndarray]], kind: pa.DataType) -> pa.RecordBatch:
    """query_id, vec_id, score from ids and scores by query."""
    own = [(q, i, s) for q, (i, s) in found.items() if len(i)]
    queries = np.repeat([q for q, _, _ in own], [len(i) for _, i, _ in own]).astype(np.int64) if own else np.empty(0, dtype=np.int64)
    flat = lambda k: np.concatenate([x[k] for x in own]) if own else np.empty(0)
    return pa.RecordBatch.from_arrays([pa.array(queries), pa.array(flat(1).astype(np.int64)), pa.array(flat(2)).cast(kind)], names=["query_id", "vec_id", "score"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
