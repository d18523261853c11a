"""Packing documents into sequences of a fixed length.

The documents are encoded once; only the lengths of their pieces enter the
packing. The length histogram (at most ``capacity`` rows) gives a configuration
linear program, which multiplicative weights solve on the driver: each round
prices the lengths, a bounded knapsack finds the fullest configuration at these
prices, and lengths that it covers become cheaper. The fractional solution is
rounded down, the rest goes by best fit into the gaps and into new sequences.
What leaves the driver is a table of ranges "the items g0..g1 of length l lie at
this offset of the sequences from s"; it has at most (rounds + a few times
capacity) configurations whatever the size of the corpus.

Defined results: a null text is empty, so the document is its end id alone; a
null id stays null; repeated rows are packed each by themselves; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import byte_bpe
from .common import settled, slices, texts_of

CAPACITY = 2048
ROUNDS = 200
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
RANGES = [("length", "i8"), ("lo", "i8"), ("hi", "i8"), ("seq", "i8"), ("offset", "i8")]


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents, with part and nth: the place among its task's pieces of that length."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.load(path)
        end = np.array([end_id], dtype=bpe.dtype).tobytes()
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                ids = np.frombuffer(bpe.encode(text) + end, dtype=bpe.dtype).astype("<u4")
                n = len(ids)
                first = (n - 1) % capacity + 1
                for k, at in enumerate(range(first - capacity, n, capacity)):
                    at, to = max(at, 0), at + capacity
                    rows.append((doc, k, at, to - at, zlib.crc32(ids[at:to]), part, seen[to - at]))
                    seen[to - at] += 1
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def knapsack(lengths: np.ndarray, value: np.ndarray, bound: np.ndarray, capacity: int) -> np.ndarray:
    """Copies of each length that maximise the value within the capacity, by dynamic programming.

    Bounds above one are split into powers of two.
    """
    items = []
    for i, most in enumerate(bound):
        k, left = 1, min(int(most), capacity // int(lengths[i]))
        while left > 0:
            take = min(k, left)
            items.append((i, take))
            left, k = left - take, 2 * k
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(items), capacity + 1), dtype=bool)
    for j, (i, take) in enumerate(items):
        size = int(lengths[i]) * take
        if size > capacity:
            continue
        other = best[: capacity + 1 - size] + value[i] * take
        better = other > best[size:]
        taken[j, size:] = better
        best[size:] = np.where(better, other, best[size:])
    copies, at = np.zeros(len(lengths), dtype=np.int64), int(best.argmax())
    for j in range(len(items) - 1, -1, -1):
        if taken[j, at]:
            i, take = items[j]
            copies[i] += take
            at -= int(lengths[i]) * take
    return copies


def configurations(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[list]:
    """[how many sequences, room left, {length: copies}] for a histogram of lengths; they hold every item."""
    lengths = np.array(sorted(counts), dtype=np.int64)
    left = np.array([counts[int(x)] for x in lengths], dtype=np.int64)
    total = int((lengths * left).sum())
    if not total:
        return []
    lp = max(1.0, total / capacity)
    # A configuration holds each length about as often as its share asks for.
    bound = np.maximum(1, np.ceil(2 * left / lp)).astype(np.int64)
    weight, step, columns = np.ones(len(lengths)), min(1.0, np.sqrt(8 * np.log(len(lengths) + 1) / rounds)), []
    for _ in range(rounds):
        copies = knapsack(lengths, weight * lengths, bound, capacity)
        columns.append(copies)
        gain = np.clip(copies * lp / left - 1, -1, 1)
        weight *= np.exp(-step * gain)
        weight /= weight.max()
        weight = np.maximum(weight, 1e-9)
    bins: list[list] = []
    # Equal columns add up. What a share has beyond whole sequences is left to best
    # fit, and so are columns that leave room: nothing is sure to fill it.
    shares = Counter(c.tobytes() for c in columns if (c * lengths).sum() == capacity)
    for key, times in shares.items():
        copies = np.frombuffer(key, dtype=np.int64)
        used = copies > 0
        times = min(int(times * lp / rounds), int((left[used] // copies[used]).min())) if used.any() else 0
        if times > 0:
            left = left - times * copies
            bins.append([times, capacity - int((copies * lengths).sum()), {int(lengths[i]): int(copies[i]) for i in np.flatnonzero(used)}])
    return _best_fit(bins, {int(x): int(n) for x, n in zip(lengths, left) if n}, capacity)


def _best_fit(bins: list[list], rest: dict[int, int], capacity: int) -> list[list]:
    """Puts the rest, longest first, each time into the tightest room, whole groups of equal sequences at once."""
    by_room: dict[int, list[list]] = defaultdict(list)
    for group in bins:
        by_room[group[1]].append(group)
    for size in sorted(rest, reverse=True):
        n = rest[size]
        for room in sorted(r for r in by_room if r >= size):
            while n and by_room[room]:
                group = by_room[room].pop()
                copies = min(room // size, max(1, n // group[0]))
                times = min(group[0], n // copies)
                if times < group[0]:
                    by_room[room].append([group[0] - times, room, dict(group[2])])
                held = dict(group[2])
                held[size] = held.get(size, 0) + copies
                by_room[room - copies * size].append([times, room - copies * size, held])
                n -= times * copies
            if not n:
                break
        per = capacity // size
        for copies, times in ((per, n // per), (n % per, 1)):
            if copies and times:
                by_room[capacity - copies * size].append([times, capacity - copies * size, {size: copies}])
    return [g for groups in by_room.values() for g in groups]


def ranges(bins: list[list]) -> np.ndarray:
    """Which sequences and which offset the items of each length get, by their number within the length."""
    given, rows, seq = Counter(), [], 0
    for times, _, held in bins:
        offset = 0
        for size, copies in sorted(held.items(), reverse=True):
            for _ in range(copies):
                rows.append((size, given[size], given[size] + times, seq, offset))
                given[size] += times
                offset += size
        seq += times
    return np.sort(np.array(rows, dtype=RANGES), order=["length", "lo"])


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    spark = docs.sparkSession
    cut = settled(pieces(docs, tokenizer, end_id, capacity), "pieces")
    by_part = cut.groupBy("length", "part").count()
    histogram = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most capacity rows
    table = spark.sparkContext.broadcast(ranges(configurations(histogram, capacity, rounds)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    numbered = cut.join(bases, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("nth"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        keys = rows["length"] * (1 << 48) + rows["lo"]
        for batch in batches:
            size, nth = batch.column("length").to_numpy(), batch.column("nth").to_numpy()
            at = np.searchsorted(keys, size * (1 << 48) + nth, side="right") - 1
            seq, offset = rows["seq"][at] + nth - rows["lo"][at], rows["offset"][at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(seq), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
