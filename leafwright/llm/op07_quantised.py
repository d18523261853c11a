"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one codeword from each of ``BOOKS`` codebooks of full
dimension. The codebooks start as residual k-means and are refined by turns of
beam-search encoding and least squares, on a bounded sample (at most ``train_rows``
vectors, chosen by a hash of the id). Every vector is encoded by beam
search; its code and the ratio of its norm to that of its reconstruction are the
index. Equal vectors are one entry, for which the ``k`` + 1 smallest ids stand.

A query adds up table entries of codeword products, times the stored ratio. Only
codes are scanned for that; the ``rerank`` best of the whole table, one list for
each query, meet their original vectors by id and are scored exactly. A rough
score is off by at most the query's norm times the vector's distance from its
scaled reconstruction, which the index keeps. So whatever lies beyond the list and
may still reach the k-th exact score by that bound is scored exactly, where it lies:
no nearest vector is missed, whatever the vectors are like. The tests hold this
against brute force.

Defined results: see ``vectors.usable``, zero vectors take no part; rows with a
query's own id are not its candidates; an empty table gives no rows; vectors of
a length other than the codebooks' are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as vec
from .common import discard, settled

BOOKS, WORDS, BEAM = 16, 64, 8
TRAIN_ROWS = 8192
BLOCK, QUERIES, RERANK = 4096, 256, 256
FOUND = "query_id long, vec_id long, score double"


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows x books) by beam search: after each book the ``beam`` partial sums nearest to the vector stay."""
    n, (m, k, _) = len(x), books.shape
    codes, residual = np.zeros((n, 1, 0), dtype=np.uint8), x[:, None, :]
    for book in books:
        width = residual.shape[1]
        # |r - c|^2 without |r|^2 differs between partial sums, so it is kept.
        cost = (residual**2).sum(-1)[:, :, None] - 2 * residual @ book.T + (book**2).sum(-1)
        flat = cost.reshape(n, width * k)
        keep = min(beam, width * k)
        pick = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        parent, word = pick // k, pick % k
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
        residual = np.take_along_axis(residual, parent[:, :, None], axis=1) - book[word]
    best = (residual**2).sum(-1).argmin(axis=1)
    return codes[np.arange(n), best]


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[m][codes[:, m]] for m in range(len(books)))


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(steps):
        near = (-2 * x @ centres.T + (centres**2).sum(-1)).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        sizes = np.bincount(near, minlength=k)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def fit_books(x: np.ndarray, books: int = BOOKS, words: int = WORDS, turns: int = 2, seed: int = 7) -> np.ndarray:
    """Codebooks (books x words x dimension) for the sample."""
    rng, residual, out = np.random.default_rng(seed), x.copy(), []
    for _ in range(books):
        out.append(_k_means(residual, words, rng))
        residual -= out[-1][(-2 * residual @ out[-1].T + (out[-1] ** 2).sum(-1)).argmin(axis=1)]
    out = np.stack(out)
    for _ in range(turns):
        codes = encode(x, out)
        chosen = np.zeros((len(x), books * words))
        for m in range(books):
            chosen[np.arange(len(x)), m * words + codes[:, m].astype(int)] = 1
        gram = chosen.T @ chosen + 0.1 * np.eye(books * words)
        out = np.linalg.solve(gram, chosen.T @ x + 0.1 * out.reshape(books * words, -1)).reshape(out.shape)
    return out


def train(own: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray | None:
    """Codebooks from at most ``rows`` vectors of the most frequent length among them."""
    n = own.count()
    if n > rows:
        # By hash, nine tenths of what is allowed, so that the limit hardly ever cuts. No task sends more than its share.
        own = own.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < int((1 << 40) * 0.9 * rows / n)).limit(rows)
    sample = [r.v for r in sorted(own.collect(), key=lambda r: r.vec_id)]  # at most rows vectors
    if not sample:
        return None
    widths = [len(v) for v in sample]
    width = max(set(widths), key=widths.count)
    return fit_books(np.array([v for v in sample if len(v) == width]))


def index(own: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, v, code, ratio and off (the distance from the scaled reconstruction) of every vector; no code where the length differs from the codebooks'."""
    shared = own.sparkSession.sparkContext.broadcast(books)  # BOOKS x WORDS x dimension numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = part.column("v").to_pylist()
                fits = np.array([len(v) == books.shape[2] for v in rows])
                code, ratio, off = [None] * len(rows), np.ones(len(rows)), np.zeros(len(rows))
                if fits.any():
                    x = np.array([v for v, f in zip(rows, fits) if f])
                    found = encode(x, books)
                    rebuilt = decode(found, books)
                    near = np.sqrt((rebuilt**2).sum(-1))
                    ratio[fits] = np.sqrt((x**2).sum(-1)) / np.where(near > 0, near, 1)
                    off[fits] = np.sqrt(((x - ratio[fits, None] * rebuilt) ** 2).sum(-1))
                    for k, c in zip(np.flatnonzero(fits), found):
                        code[k] = c.tobytes()
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array(code, pa.binary()), pa.array(ratio), pa.array(off)], names=["vec_id", "v", "code", "ratio", "off"])

    return own.mapInArrow(run, "vec_id long, v array<double>, code binary, ratio double, off double")


def rough_scores(q: np.ndarray, codes: np.ndarray, ratio: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Queries x rows: sums of looked-up products of query and codeword, times the stored ratio."""
    tables = np.einsum("qd,mkd->mqk", q, books).astype(np.float32)
    out = tables[0][:, codes[:, 0]]
    for m in range(1, len(books)):
        out += tables[m][:, codes[:, m]]
    return out * ratio.astype(np.float32)


def _codes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a code, and the codes."""
    column = table.column("code").to_pylist()
    has = np.array([c is not None for c in column], dtype=bool)
    codes = np.frombuffer(b"".join(c for c in column if c is not None), dtype=np.uint8)
    return has, codes.reshape(int(has.sum()), -1)


def _shortlist(codes: DataFrame, books, wave, rerank: int, n: int) -> DataFrame:
    """query_id, vec_id, score: about ``rerank`` rows of the best rough scores for each query, from codes alone.

    A task passes on its even share and six times the square root of it besides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books_, (own, q) = books.value, wave.value
        ids = np.zeros((len(own), 0), dtype=np.int64)
        scores, rows = np.zeros((len(own), 0), dtype=np.float32), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                here, (_, found) = part.column("vec_id").to_numpy(), _codes(pa.Table.from_batches([part]))
                ratio = part.column("ratio").to_numpy()
                rows += len(here)
                new_ids, new_scores = [], []
                for k in range(0, len(own), QUERIES):
                    s = rough_scores(q[k : k + QUERIES], found, ratio, books_)
                    i = np.concatenate([ids[k : k + QUERIES], np.broadcast_to(here, s.shape)], axis=1)
                    s = np.concatenate([scores[k : k + QUERIES], s], axis=1)
                    if s.shape[1] > rerank:
                        keep = np.argpartition(-s, rerank - 1, axis=1)[:, :rerank]
                        i, s = np.take_along_axis(i, keep, axis=1), np.take_along_axis(s, keep, axis=1)
                    new_ids.append(i)
                    new_scores.append(s)
                ids, scores = np.concatenate(new_ids), np.concatenate(new_scores)
        share = rerank * rows / max(1, n)
        most = min(scores.shape[1], int(np.ceil(share + 6 * np.sqrt(share) + 8)))
        out = {}
        for j, query in enumerate(own.tolist()):
            keep = np.argsort(-scores[j], kind="stable")[:most]
            out[query] = ids[j, keep], scores[j, keep].astype(np.float64)
        yield vec.found_batch(out, pa.float64())

    return codes.mapInArrow(run, FOUND)


def _exactly(listed: DataFrame, wave) -> DataFrame:
    """query_id, vec_id, score from rows (vec_id, v, asked): the exact products with the queries in asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = wave.value
        for batch in batches:
            ids, queries, scores = [], [], []
            for vec_id, v, asked in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), batch.column("asked").to_pylist()):
                at = np.searchsorted(own, asked)
                queries.append(own[at])
                ids.append(np.full(len(at), vec_id, dtype=np.int64))
                scores.append((q[at] * np.array(v)).sum(axis=1))
            flat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, dtype=kind)
            yield pa.RecordBatch.from_arrays([pa.array(flat(queries, np.int64)), pa.array(flat(ids, np.int64)), pa.array(flat(scores, np.float64))], names=["query_id", "vec_id", "score"])

    return listed.mapInArrow(run, FOUND)


def _rest(indexed: DataFrame, books, open_, most: int) -> DataFrame:
    """Rows that may reach the last score wanted by the queries left open, scored exactly where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q, least = open_.value
        found = {query: (np.empty(0, dtype=np.int64), np.empty(0)) for query in own.tolist()}
        norms = np.sqrt((q**2).sum(axis=1))
        for ids, x, table in vec.matrices(batches, BLOCK):
            _, codes = _codes(table)
            ratio, off = table.column("ratio").to_numpy(), table.column("off").to_numpy()
            # Rough scores are sums of single precision; no table entry is larger than the query's norm times its word's.
            size = 1e-5 * (np.sqrt((books.value**2).sum(-1)).max(axis=1).sum() * ratio + off)
            for at in range(0, len(own), QUERIES):
                part = slice(at, at + QUERIES)
                rough = rough_scores(q[part], codes, ratio, books.value)
                edge = norms[part, None] * size
                may = rough + norms[part, None] * off + edge >= least[part, None]
                # One product for the block, then the defined sum for what comes within its rounding of the last score wanted.
                may &= q[part] @ x.T + 1e-9 * norms[part, None] * np.sqrt((x**2).sum(axis=1)) >= least[part, None]
                for j in np.flatnonzero(may.any(axis=1)):
                    here, query = np.flatnonzero(may[j]), int(own[at + j])
                    scores = (x[here] * q[at + j]).sum(axis=1)
                    i, s = np.concatenate([found[query][0], ids[here]]), np.concatenate([found[query][1], scores])
                    keep = vec.best(i, s, most)
                    found[query] = i[keep], s[keep]
        yield vec.found_batch(found, pa.float64())

    return indexed.mapInArrow(run, FOUND)


def _others(indexed: DataFrame, wave: dict, width: int, most: int) -> DataFrame:
    """Queries of other lengths than the codebooks', compared exactly with vectors of their own length."""
    rest = {d: own for d, own in wave.items() if d != width}
    shared = indexed.sparkSession.sparkContext.broadcast(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for ids, x, _ in vec.matrices(batches, BLOCK):
            own, q = shared.value.get(x.shape[1], ((), ()))
            for query, v in zip(own, q):
                i, s = found.get(int(query), (np.empty(0, dtype=np.int64), np.empty(0)))
                i, s = np.concatenate([i, ids]), np.concatenate([s, (x * v).sum(axis=1)])
                keep = vec.best(i, s, most)
                found[int(query)] = i[keep], s[keep]
        yield vec.found_batch(found, pa.float64())

    return indexed.where(F.size("v") != width).mapInArrow(run, FOUND)


def search(table: DataFrame, asked: DataFrame, k: int, rerank: int = RERANK, train_rows: int = TRAIN_ROWS, wave_size: int = vec.WAVE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row of ``asked`` by inner product."""
    spark = table.sparkSession
    own = settled(vec.usable(table, zero=False), "vectors")
    # Equal vectors: the k + 1 smallest ids can be an answer; the smallest stands for them in the index.
    same = [F.hash("v").alias("h1"), F.xxhash64("v").alias("h2")]
    order = Window.partitionBy("h1", "h2", "v").orderBy("vec_id")
    copies = own.select("vec_id", "v", *same).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    copies = settled(copies.withColumn("rep", F.min("vec_id").over(Window.partitionBy("h1", "h2", "v"))), "copies")
    reps = copies.where("nth = 1").select("vec_id", "v")
    books = train(reps, train_rows)
    if books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = books.shape[2]
    indexed = vec.dealt(index(reps, books), "codes")
    coded = indexed.where("code is not null")
    n, shared_books = coded.count(), spark.sparkContext.broadcast(books)
    queries = own.join(asked.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    # A query may find its own vector, so one more than k is wanted throughout.
    most, out = k + 1, []
    for wave in vec.waves(queries, wave_size):
        if set(wave) - {width}:
            out.append(settled(_others(indexed, wave, width, most), "others"))
        if width in wave:
            out += _wave(coded, n, shared_books, wave[width], most, rerank)
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = vec.union([x.select("query_id", F.col("vec_id").alias("rep"), "score") for x in out])
    # An entry's score is that of all its ids.
    pairs = found.join(copies.select("rep", "vec_id"), "rep").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return vec.ranked(pairs, k)


def _wave(coded: DataFrame, n: int, books, wave: tuple[np.ndarray, np.ndarray], most: int, rerank: int) -> list[DataFrame]:
    """The best of a wave of queries, as settled tables of query_id, vec_id, score."""
    ids, q = wave
    shared = coded.sparkSession.sparkContext.broadcast(wave)  # about WAVE vectors
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    short = _shortlist(coded.select("vec_id", "code", "ratio"), books, shared, rerank, n)
    short = settled(short.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= rerank).select("query_id", "vec_id", F.col("score").alias("rough")), "shortlist")
    # The originals meet the list by id; a wave's queries for one vector are at most the wave.
    listed = coded.select("vec_id", "v").join(short.groupBy("vec_id").agg(F.collect_list("query_id").alias("asked")), "vec_id")
    exact = settled(_exactly(listed, shared), "exact")
    ranks = exact.join(short, ["query_id", "vec_id"]).withColumn("nth", F.row_number().over(by_score))
    ends = ranks.groupBy("query_id").agg(F.min(F.when(F.col("nth") <= most, F.col("score"))).alias("least"), F.min("rough").alias("last"), F.count("*").alias("n"))
    # Open: the list is full and ends within the largest error of the last score wanted. At most one row for each query of the wave.
    worst = coded.agg(F.max("off")).first()[0] or 0.0
    norms = dict(zip(ids.tolist(), np.sqrt((q**2).sum(axis=1)).tolist()))
    rows = {r.query_id: r for r in ends.where(F.col("n") >= rerank).collect()}
    rows = {i: r for i, r in rows.items() if r.last + norms[i] * worst * (1 + 1e-5) + 1e-5 * abs(r.last) >= r.least}
    out = [settled(vec.ranked(exact, most).drop("rank"), "best")]
    keep = np.array([int(i) in rows for i in ids], dtype=bool)
    if keep.any():
        own = [rows[int(i)] for i in ids[keep]]
        open_ = coded.sparkSession.sparkContext.broadcast((ids[keep], q[keep], np.array([r.least for r in own])))
        out.append(settled(_rest(coded, books, open_, most), "rest"))
        open_.destroy()
    discard(short, exact)
    shared.destroy()
    return out
