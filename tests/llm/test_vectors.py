import math

import duckdb
import numpy as np
import pytest

from leafwright.llm import op04_topk, op07_quantised

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def table(spark, n=700, seed=3, dim=12):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, 0.2, dim).astype(np.float32).tolist(), 1, "x") for i in range(n)]
    same = rows[0][1]
    rows += [(n + i, same, None, None) for i in range(30)]  # ties
    rows += [(5000, None, 1, "x"), (5050, [None] * dim, 1, "x"), (5100, [math.nan] * dim, 1, "x"), (5150, [math.inf] * dim, 1, "x"), (None, same, 1, "x"), (5200, [], 1, "x"), (5250, [0.0] * dim, 1, "x"), (5300, [1.0, 2.0], 1, "x"), (5301, [0.5, 0.25], 1, "x"), (0, same, 1, "x")]
    return spark.createDataFrame(rows, SCHEMA), rows


def brute(rows, every, k, quantise, zero):
    own = {}
    for i, v, *_ in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or (not zero and not any(v)):
            continue
        v = np.array(v, dtype=np.float32).astype(np.float64)
        own[i] = np.floor(256 * v) if quantise else v
    out = []
    for q in own:
        if q % every == 0:
            scored = sorted((-(own[q] * v).sum(), i) for i, v in own.items() if i != q and len(v) == len(own[q]))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 64])
def test_exact(spark, block):
    df, rows = table(spark)
    own = op04_topk.quantised(df)
    got = op04_topk.top_k(own, own.where("vec_id % 50 = 0"), 5, block, 16)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 50, 5, True, True)
    none = own.limit(0)
    assert op04_topk.top_k(none, none, 5).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17])
@pytest.mark.parametrize("kind", ["equal", "constant", "binary", "normal"])
def test_scores_are_whole_in_short_blocks(n, kind):
    """Bounds that meet before a list is read to its end give the whole score."""
    rng = np.random.default_rng(n)
    x = {
        "equal": np.repeat([[3.0, -4.0, 5.0]], n, axis=0),
        "constant": np.column_stack([np.full(n, 7.0), np.floor(rng.normal(0, 9, n)), np.full(n, -2.0)]),
        "binary": rng.integers(0, 2, (n, 3)).astype(float),
        "normal": np.floor(rng.normal(0, 9, (n, 3))),
    }[kind]
    queries = np.array([[2.0, 5.0, -1.0], [0.0, 0.0, 0.0], [-3.0, 1.0, 4.0]])
    ids = np.arange(n)
    for k in (1, 2, 5):
        for j, (found, scores) in enumerate(op04_topk.SortedLists(ids, x).top(queries, np.full(3, -1), k, np.full(3, -np.inf))):
            every = x @ queries[j]
            assert np.array_equal(scores, every[found])
            assert set(np.lexsort((ids, -every))[:k].tolist()) <= set(found.tolist())


@pytest.mark.parametrize("parts", [1, 2, 7, 16, 40])
def test_exact_however_dealt(spark, monkeypatch, parts):
    """The same rows whatever the number of tasks: short last blocks, equal vectors in each."""
    df, rows = table(spark, 250)
    monkeypatch.setattr(op04_topk.vec, "dealt", lambda vectors, name: op04_topk.settled(vectors.repartition(parts, "vec_id"), name))
    own = op04_topk.quantised(df)
    got = op04_topk.top_k(own, own.where("vec_id % 50 = 0"), 5, 64, 16)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 50, 5, True, True)


def test_exact_same_as_sql(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    own = op04_topk.quantised(spark.read.parquet(path))
    got = sorted(tuple(r) for r in op04_topk.top_k(own, own.where("vec_id % 50 = 0"), 5).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    assert got == sorted(db.execute(op04_topk.TOP_5_SQL).fetchall())


def test_approximate_recall(spark):
    df, rows = table(spark, 3000, dim=32)
    got = op07_quantised.search(df, df.where("vec_id % 20 = 0"), 20, rerank=64, wave_size=100).collect()
    want = brute(rows, 20, 20, False, False)
    score = {(q, i): s for q, _, i, s in want}
    assert len(got) == len(want)
    assert all(abs(r.score - score[r.query_id, r.vec_id]) < 1e-12 for r in got if (r.query_id, r.vec_id) in score)
    assert len({(r.query_id, r.vec_id) for r in got} & set(score)) >= 0.9 * len(want)
    assert op07_quantised.search(df.limit(0), df.limit(0), 20).count() == 0


def test_beam_encoding_beats_greedy():
    x = np.random.default_rng(1).normal(size=(2000, 16))
    books = op07_quantised.fit_books(x, 4, 32)
    wide, greedy = (((x - op07_quantised.decode(op07_quantised.encode(x, books, b), books)) ** 2).mean() for b in (8, 1))
    assert wide < greedy < (x**2).mean()


def test_recall_with_production_parameters(spark):
    x = np.random.default_rng(9).normal(0, 0.12, (5200, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r.vec_id) for r in op07_quantised.search(df, df.where("vec_id % 20 = 0"), 20).collect()}
    every = x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(every, -np.inf)
    want = {(q, int(i)) for q in range(0, 5200, 20) for i in np.argsort(-every[q])[:20]}
    assert len(got) == len(want) and len(got & want) >= 0.95 * len(want)


def test_recall_with_copies(spark):
    rng = np.random.default_rng(4)
    n, dim = 6000, 32
    x = rng.normal(0, 0.2, (n, dim))
    kind = rng.integers(0, 3, n)
    x[kind == 1] = x[0]
    x[kind == 2] = x[1] + rng.normal(0, 0.01, ((kind == 2).sum(), dim))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for r in op07_quantised.search(df, df.where("vec_id % 20 = 0"), 20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = {0: [], 1: [], 2: []}
    for q in range(0, n, 20):
        scores = (x.astype(np.float64) * x[q].astype(np.float64)).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(n), -scores)).tolist() if i != q][:20]
        hits[int(kind[q])].append(len(found[q] & set(order)) / 20)
    assert all(np.mean(h) >= 0.98 for h in hits.values()), {k: float(np.mean(h)) for k, h in hits.items()}


def test_reading_stops_early_where_few_components_decide():
    """A few long vectors stand out: after a part of each list no outsider can qualify."""
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(0, 8, (4000, 8)))
    x[:40] += 400
    lists = op04_topk.SortedLists(np.arange(4000), x)
    queries = np.abs(np.floor(rng.normal(0, 200, (16, 8)))) + 1
    own = np.full(16, -1)
    for q, (ids, scores) in zip(queries, lists.top(queries, own, 5, np.full(16, -np.inf))):
        every = x @ q
        keep = np.lexsort((np.arange(4000), -every))[:5]
        assert set(keep) <= set(ids.tolist()) and np.array_equal(scores, every[ids])
    # After the first step of a 32nd almost nothing is open, so little more than that is read.
    assert lists.open_after[0] <= 16 * 60 and len(lists.open_after) < len(op04_topk.STEPS)
    floor = np.full(16, 1e12)
    assert all(not len(ids) for ids, _ in lists.top(queries, own, 5, floor))


@pytest.mark.parametrize("kind", ["tails", "spikes"])
def test_no_nearest_is_missed_on_odd_vectors(spark, kind):
    """Norms over many orders of size, or components that codebooks from a small sample do not know."""
    rng, n, dim = np.random.default_rng(5), 2000, 24
    x = rng.normal(0, 1, (n, dim))
    if kind == "tails":
        x *= np.exp(rng.normal(0, 2, (n, 1)))
    else:
        x *= 0.05
        x[np.arange(n), rng.integers(0, dim, n)] += rng.exponential(1, n) ** 3
    rows = [(i, v.astype(np.float32).tolist(), 1, "x") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = op07_quantised.search(df, df.where("vec_id % 20 = 0"), 20, rerank=40, train_rows=200)
    want = brute(rows, 20, 20, False, False)
    found = {(r.query_id, r.vec_id) for r in got.collect()}
    assert len(found) == len(want) and len(found & {(q, i) for q, _, i, _ in want}) == len(want)
