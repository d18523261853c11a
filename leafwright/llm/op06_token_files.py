"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Every partition of a range partitioning on the document id writes one ``.bin``
file (the ids, back to back) and one ``.idx`` file (offsets, document ids).
A file's place in the corpus, its base, is the sum of the counts of the files
before it, so no task ever sees more than its own partition.

Defined results: a null text is empty; a null id sorts first and stays null;
repeated ids are kept, ordered by text; an empty table gives no files and no
rows; other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_bpe
from .common import local_path, shared_dir, slices, texts_of

MAGIC = b"LEAFIDS1"
MANIFEST = "part int, docs long, tokens long, path string"


@contextmanager
def _published(target: str):
    """A stream to a file of the shared store that gets its name only when it is whole, so a repeated task never shows half of one."""
    place, tag = local_path(target), uuid.uuid4().hex
    if place is not None:
        with open(f"{place}.{tag}", "wb") as out:
            yield out
        os.replace(f"{place}.{tag}", place)
        return
    store, path = fs.FileSystem.from_uri(target)
    with store.open_output_stream(f"{path}.{tag}") as out:
        yield out
    store.move(f"{path}.{tag}", path)


class _Bytes:
    """A file's bytes by range: mapped where the store has local paths, else read range by range."""

    def __init__(self, target: str):
        place = local_path(target)
        self.mapped = np.memmap(place, dtype="u1", mode="r") if place is not None else None
        if place is None:
            store, path = fs.FileSystem.from_uri(target)
            self.file = store.open_input_file(path)

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[part]
        self.file.seek(part.start)
        return np.frombuffer(self.file.read(part.stop - part.start), dtype="u1")

    def whole(self) -> np.ndarray:
        return self.mapped if self.mapped is not None else np.frombuffer(self.file.read(), dtype="u1")


def write_token_files(docs: DataFrame, out_dir: str, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) into token files under ``out_dir``.

    Returns the manifest: part, docs, tokens, base and path of each file. The
    files follow each other in ascending doc_id order.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    place = local_path(out_dir)
    if place is not None:
        os.makedirs(place, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.load(path)
        end, wide = np.array([end_id], dtype=bpe.dtype).tobytes(), bpe.dtype.itemsize
        part, ids, ends, at = TaskContext.get().partitionId(), [], [], 0
        rows = (batch for batch in slices(batches) if batch.num_rows)
        first = next(rows, None)
        if first is None:
            return
        base = f"{out_dir}/part-{part:06d}"
        with _published(f"{base}.bin") as out:
            for batch in chain([first], rows):
                parts = []
                for text in texts_of(batch):
                    data = bpe.encode(text)
                    at += len(data) // wide + 1
                    ends.append(at)
                    parts += (data, end)
                out.write(b"".join(parts))
                ids += batch.column("doc_id").to_pylist()
        with _published(f"{base}.idx") as out:
            out.write(MAGIC)
            out.write(np.array([bpe.dtype.itemsize, len(ids)], dtype="<u8").tobytes())
            out.write(np.array([0, *ends], dtype="<u8").tobytes())
            out.write(np.array([x or 0 for x in ids], dtype="<i8").tobytes())
            out.write(np.array([x is not None for x in ids], dtype="u1").tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "docs": [len(ids)], "tokens": [at], "path": [base]})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # One row for each file; their prefix sums are the bases.
    files = sorted(ordered.mapInArrow(write, MANIFEST).collect(), key=lambda r: r.part)
    bases = np.cumsum([0, *(r.tokens for r in files)])
    rows = [(r.part, r.docs, r.tokens, int(b), r.path) for r, b in zip(files, bases)]
    return spark.createDataFrame(rows, "part int, docs long, tokens long, base long, path string")


def read_index(path: str) -> tuple[np.dtype, np.ndarray, np.ndarray, np.ndarray]:
    """dtype of the ids, offsets (documents + 1), document ids and their validity, of one .idx file."""
    raw = _Bytes(path).whole()
    if raw[:8].tobytes() != MAGIC:
        raise ValueError(f"{path} is no token index")
    width, n = (int(x) for x in raw[8:24].view("<u8"))
    at = 24 + 8 * (n + 1)
    return np.dtype(f"<u{width}"), raw[24:at].view("<u8"), raw[at : at + 8 * n].view("<i8"), raw[at + 8 * n :].view(bool)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dtype, offsets, ids, valid = read_index(f"{row['path']}.idx")
                flat, wide = _Bytes(f"{row['path']}.bin"), dtype.itemsize
                for at in range(0, len(ids), 4096):
                    ends = offsets[at : at + 4097].astype(np.int64)
                    crcs = [zlib.crc32(flat[x * wide : y * wide].view(dtype).astype("<u4")) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.array(ids[at : at + 4096]), mask=~np.array(valid[at : at + 4096])),
                            pa.array(row["base"] + ends[:-1]),
                            pa.array(np.diff(ends)),
                            pa.array(crcs, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # Some files for each task; a file is read by one task.
    spread = manifest.repartition(max(1, min(manifest.count(), manifest.sparkSession.sparkContext.defaultParallelism * 4)), "part")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes the files in the shared folder and reads the digests back from them."""
    out = f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(docs, out, tokenizer, end_id))
