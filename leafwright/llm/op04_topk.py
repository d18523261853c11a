"""Exact top-k by inner product without random access.

Every dimension of a block of vectors is a list sorted by component. For one
query a list is read in order, from the end that the query's own component
prefers, step by step. After each step a vector's lower bound takes the list's
last value for what has not been read, its upper bound the last value read.
Vectors whose upper bound falls below the k-th lower bound, or below the k-th
score of the blocks that the task has read before, cannot qualify and leave.
Reading stops when the scores of all that are left are known in full; no entry
is looked up out of order. Entries of a step count once, for a block of queries
at a time, as a matrix product.

Defined results: see ``vectors.usable``; an empty vector takes no part; rows
with a query's own id are not its candidates; fewer than k candidates give
fewer rows; empty tables give none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as vec
from .common import discard, settled

BLOCK, QUERIES = 4096, 64
#: Depths, as shares of a list, after which the bounds are formed.
STEPS = (1 / 16, 1 / 4, 1 / 2, 5 / 8, 3 / 4, 7 / 8, 1)
FOUND = "query_id long, vec_id long, score long"


def quantised(table: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v = floor(scale * component) of the vectors that take part."""
    return vec.usable(table).select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))


class SortedLists:
    """A block's vectors with every dimension as a sorted list. All numbers are whole, so sums are exact."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, n = ids, x, len(x)
        order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, order, axis=0)
        self.place = np.empty(x.shape, dtype=np.int32)
        np.put_along_axis(self.place, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
        #: Vectors still open summed over the queries, by step: how much was read of what.
        self.open_after: list[int] = []

    def top(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray, steps: tuple[float, ...] = STEPS) -> list[tuple[np.ndarray, np.ndarray]]:
        """ids and scores of all that can be among the k best of each query, given that k reach ``floor`` elsewhere."""
        n = len(self.x)
        up, down = np.maximum(queries, 0).T, np.minimum(queries, 0).T
        ids, x, place = self.ids, self.x, self.place
        open_, seen, a = ids[:, None] != own[None, :], np.zeros((n, len(queries))), 0
        lower = seen
        for share in steps:
            b = max(1, min(n, int(np.ceil(share * n))))
            if b == a or not len(ids):
                continue
            # Lists of positive components are read from the top, those of negative ones from the bottom.
            below, above = place < n - b, place >= b
            seen += (x * ((place < n - a) & ~below)) @ up + (x * ((place >= a) & ~above)) @ down
            unread = np.concatenate([below, above], axis=1)
            rest = lambda high, low: unread @ np.concatenate([up * self.sorted[high][:, None], down * self.sorted[low][:, None]])  # noqa: B023,E731
            lower, upper = seen + rest(0, n - 1), seen + rest(n - b, b - 1)
            least = floor
            if len(ids) >= k:
                least = np.maximum(floor, np.partition(np.where(open_, lower, -np.inf), len(ids) - k, axis=0)[len(ids) - k])
            open_ &= upper >= least
            self.open_after.append(int(open_.sum()))
            left = open_.any(axis=1)
            known = ((lower == upper) | ~open_).all()
            ids, x, place, open_, seen, lower = ids[left], x[left], place[left], open_[left], seen[left], lower[left]
            a = b
            if known:
                break
        # Where both bounds met before the end of a list, what was read is only a part of the score; the bound is all of it.
        return [(ids[open_[:, j]], lower[open_[:, j], j]) for j in range(len(queries))]


def scan(blocks: Iterator, wave: dict[int, tuple[np.ndarray, np.ndarray]], k: int, group: int = QUERIES) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The k best of each query of the wave over all blocks."""
    found = {int(q): (np.empty(0, dtype=np.int64), np.empty(0)) for own, _ in wave.values() for q in own}
    floor = dict.fromkeys(found, -np.inf)
    for ids, x, _ in blocks:
        if x.shape[1] not in wave:
            continue
        lists, (own, queries) = SortedLists(ids, x), wave[x.shape[1]]
        for at in range(0, len(own), group):
            part = own[at : at + group]
            new = lists.top(queries[at : at + group], part, k, np.array([floor[int(q)] for q in part]))
            for q, (i, s) in zip(part.tolist(), new):
                i, s = np.concatenate([found[q][0], i]), np.concatenate([found[q][1], s])
                keep = vec.best(i, s, k)
                found[q] = i[keep], s[keep]
                if len(keep) == k:
                    floor[q] = s[keep][-1]
    return found


def top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, wave_size: int = vec.WAVE) -> DataFrame:
    """query_id, rank, vec_id, score for vectors and queries as ``quantised`` makes them."""
    own = vec.dealt(vectors, "vectors")
    out = []
    for wave in vec.waves(queries, wave_size):
        shared = own.sparkSession.sparkContext.broadcast(wave)  # about wave_size vectors

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield vec.found_batch(scan(vec.matrices(batches, block), shared.value, k), pa.int64())

        out.append(settled(own.mapInArrow(run, FOUND), "found"))
        shared.destroy()
    discard(own)
    if not out:
        return own.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return vec.ranked(vec.union(out), k)


#: The same rows in SQL, over every pair.
TOP_5_SQL = """
WITH own AS (
  SELECT vec_id, min(v) AS v FROM (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  ) GROUP BY vec_id
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM own q JOIN own c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
