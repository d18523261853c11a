"""Helpers that the operators of this package share."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts taken from an Arrow batch at once; bounds the Python copies of a batch.
SLICE = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; without the setting there is none, and no guess."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return place.rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    Cuts the lineage, so a lost executor never leads to a second training or
    encoding run, and later steps read only the columns that they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing will read again."""
    for table in tables:
        jvm = table.sparkSession._jvm
        place = jvm.org.apache.hadoop.fs.Path(table.__dict__["settled_at"])
        place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def bucket_of_id(column: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % F.lit(n)


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def each_text(column: pa.Array) -> Iterator[str]:
    """A column's texts, null as empty, a slice at a time."""
    for at in range(0, len(column), SLICE):
        for x in column.slice(at, SLICE).to_pylist():
            yield x or ""


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The batch's texts in UTF-8, null as empty, without decoding them."""
    column = batch.column(name)
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in column.to_pylist()]


def local_path(uri: str) -> str | None:
    """The path of a file URI or plain path; None for stores that only file-system clients open."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


class Known(dict):
    """Remembered results of ``make`` in two generations: frequent keys survive, and the bytes held are bounded.

    ``limit`` bounds the estimated bytes of a generation; keys longer than
    ``longest`` are made anew each time.
    """

    def __init__(self, make: Callable, limit: int = 24 << 20, longest: int = 64, more: int = 0):
        super().__init__()
        self.make, self.limit, self.longest, self.old, self.held = make, limit, longest, {}, 0
        self.each = 110 + more  # its place in the dictionary, and what the result holds besides

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) > self.longest:
            return found
        if self.held >= self.limit:
            self.old, self.held = dict(self), 0
            self.clear()
        self[key] = found
        self.held += sys.getsizeof(key) + sys.getsizeof(found) + self.each
        return found


#: Bytes of a remembered word besides its letters and what it stands for; longer words are made anew each time.
ENTRY, LONGEST = 190, 64


class Words(dict):
    """Remembered bytes of words, in two generations of at most about ``room`` bytes: frequent words survive.

    ``make`` gives the bytes and whether to keep them: what is put together from
    kept words is cheap to make again and would only crowd them out.
    """

    def __init__(self, make: Callable[[str], tuple[bytes, bool]], room: int, longest: int = LONGEST):
        super().__init__()
        self.make, self.room, self.longest, self.old, self.held = make, room, longest, {}, 0

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found, keep = self.make(word)
            if not keep or len(word) > self.longest:
                return found
        if self.held >= self.room:
            self.old, self.held = dict(self), 0
            self.clear()
        self[word] = found
        self.held += 2 * len(word) + len(found) + ENTRY
        return found


#: Keys of more rows than this share of all, and at least so many, are dealt over ``SALTS`` salts.
HOT_SHARE, HOT_ROWS, SALTS, SLOTS = 256, 256, 256, 4096


def hot_slots(counts: DataFrame, keys: list[str], total: int) -> list[int]:
    """Hash slots of the keys that hold more than a share of ``total`` rows (column n): few keys can, so few of the ``SLOTS``."""
    n = "n"
    if total <= HOT_ROWS:
        return []
    hot = counts.where(F.col(n) > max(HOT_ROWS, total // HOT_SHARE)).select(_slot(keys).alias("slot")).distinct()
    return sorted(r.slot for r in hot.collect())


def _slot(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")


def dealt(df: DataFrame, keys: list[str], by: str, slots: list[int]) -> DataFrame:
    """``df`` with a salt, by the hash of another column where the key lies in a hot slot."""
    salt = F.when(_slot(keys).isin(slots), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0) if slots else F.lit(0)
    return df.withColumn("salt", salt.cast("int"))


def copied(df: DataFrame, keys: list[str], slots: list[int]) -> DataFrame:
    """The other side of a join with ``dealt`` rows: keys in hot slots once for each salt."""
    salts = F.when(_slot(keys).isin(slots), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))) if slots else F.array(F.lit(0))
    return df.withColumn("salt", F.explode(salts))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finaliser of splitmix64 over unsigned 64-bit values."""
    x = np.asarray(x, dtype=np.uint64) + np.uint64((2 * seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))
