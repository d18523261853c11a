"""Splits that keep groups whole: balanced folds, and a seeded part of the groups.

No group is ranked against all others in one task. Groups of one size are alike, so a
table of sizes decides how many of each size go to which fold (there are at most
sqrt(2 N) sizes for N rows); which ones, follows from prefix sums over hashed buckets.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def _numbered(groups: DataFrame, key: str, seed: int) -> DataFrame:
    """``groups`` with their place (from 0) among those of their size, by seeded hash."""
    own = groups.withColumn("bucket", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(BUCKETS)))
    counts = own.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("size", "bucket").orderBy(F.xxhash64(key, F.lit(seed)), key)
    return own.withColumn("nth", F.row_number().over(within) - 1).join(starts, ["size", "bucket"]).withColumn("place", F.col("start") + F.col("nth")).drop("bucket", "nth", "start")


def dealt(sizes: list[tuple[int, int]], folds: int) -> list[tuple[int, int, int, int]]:
    """size, fold, first place, last place (not included), from (size, how many): largest first, each group to the lightest fold, the first of equals.

    Groups of one size are dealt at once: rounds that give every fold the same number are skipped.
    """
    load, out = [0] * folds, []
    for size, n in sorted(sizes, reverse=True):
        given = [0] * folds
        heap = [(load[f], f) for f in range(folds)]
        heapq.heapify(heap)
        left = n
        while left:
            low, high = heap[0][0], max(x for x, _ in heap)
            if high - low < size and left >= folds:
                # All folds lie within one group: as many rounds as there are left go to all alike.
                rounds = left // folds
                given = [g + rounds for g in given]
                heap = [(x + rounds * size, f) for x, f in heap]
                heapq.heapify(heap)
                left -= rounds * folds
                continue
            x, f = heap[0]
            heapq.heapreplace(heap, (x + size, f))
            given[f] += 1
            left -= 1
        at = 0
        for f in range(folds):
            if given[f]:
                out.append((size, f, at, at + given[f]))
            load[f] += given[f] * size
            at += given[f]
    return out


def group_folds(rows: DataFrame, key: str, folds: int, seed: int = 0) -> DataFrame:
    """key, size, fold: no group in two folds, and folds differ by at most the largest group."""
    groups = rows.groupBy(key).agg(F.count("*").alias("size"))
    sizes = [(r["size"], r["n"]) for r in groups.groupBy("size").agg(F.count("*").alias("n")).collect()]  # at most sqrt(2 N) rows
    plan = rows.sparkSession.createDataFrame(dealt(sizes, folds), "size long, fold int, low long, high long")
    return _numbered(groups, key, seed).join(plan, "size").where("place >= low and place < high").select(key, "size", "fold")


def group_part(rows: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """key, chosen: a seeded part of the groups, exactly ceil(share * groups) of them, by hash order."""
    groups = rows.select(key).distinct().withColumn("size", F.lit(0))
    n = groups.count()
    return _numbered(groups, key, seed).select(key, (F.col("place") < -(-int(n * share * 10**9) // 10**9)).alias("chosen"))
