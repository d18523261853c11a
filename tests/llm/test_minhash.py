import random

import numpy as np
from pyspark.sql import functions as F

from leafwright.llm import op05_minhash as op


def brute(rows, words=3, share=85):
    import re

    sets = []
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
        sets.append((i, s))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and None not in (sets[a][0], sets[b][0]) and 100 * len(x & y) >= share * len(x | y):
                parent[root(a)] = root(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(sets[k][0])
    out = []
    for k, (i, s) in enumerate(sets):
        c = min(groups[root(k)]) if i is not None else None
        out.append((i, len(s), c, i is not None and c == i))
    return sorted(out, key=str)


def made(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    rows = [(1000, None), (1001, ""), (1002, " \t"), (1003, "One two"), (1004, "one TWO"), (None, "one two"), (1005, "É é a"), (1006, "é é a"), (1003, "One two")]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(12)]
    for i in range(n):
        w = list(base[min(11, int(rng.expovariate(0.5)))])
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    return rows


def test_against_brute_force(spark):
    rows = made(4, 400)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int")
    want = brute(rows)
    for chunk in (250_000, 1500):
        got = sorted((tuple(r) for r in op.near_duplicates(docs, weight=chunk).collect()), key=str)
        assert got == want
    assert op.near_duplicates(docs.limit(0)).count() == 0


def test_sketch_estimates_similarity_and_fills():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 400):
        assert (op.sketch(rng.integers(1, 1 << 63, n, dtype=np.uint64)) != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    got = []
    for _ in range(60):
        items = rng.integers(1, 1 << 63, 400, dtype=np.uint64)
        a, b = op.sketch(items[:350]), op.sketch(items[50:])
        got.append((a == b).mean())
    assert abs(np.mean(got) - 0.75) < 0.03


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (5, 3)], "a long, b long")
    got = {r.node: r.component for r in op.components(links).collect()}
    assert {got[k] for k in range(1, 61)} == {0} and got[101] == 100


def test_same_as_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.01/documents.parquet"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = sorted(db.execute(op.NEAR_DUPLICATES_SQL).fetchall())
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in op.near_duplicates(spark.read.parquet(path)).collect())
    assert got == want and any(not r[3] for r in want)


def test_width_and_share(spark):
    first = [f"a{k}" for k in range(2000)]
    second = first[:900] + [f"b{k}" for k in range(200)] + first[1100:]
    rows = [(1, " ".join(first)), (2, " ".join(second)), (3, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in op.keep_one(docs, words=5, share=80).collect()} == {1, 3}
    assert {r.doc_id for r in op.near_duplicates(docs).where("kept").collect()} == {1, 2, 3}
    assert {r.doc_id for r in op.near_duplicates(docs, words=5, share=82).where("kept").collect()} == {1, 2, 3}


def test_rows_that_repeat_an_id(spark):
    long = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(1, "one two three four five", 5), (1, "six seven eight nine ten", 5), (2, "eleven twelve thirteen fourteen", 5), (3, long, 9), (3, long, 2), (4, long + " end", 1), (5, long + " end", 1), (5, "quite another text stands here", 1), (None, long, 1), (6, None, 1), (6, "", 1), (6, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id int")
    got = sorted(((r.doc_id, r.text, r.kept_id) for r in op.keep_one(docs).collect()), key=str)
    # 3 stays once, with its least other column, and takes 4 and one text of 5 along; all other texts stay.
    want = [(1, rows[0][1], 5), (1, rows[1][1], 5), (2, rows[2][1], 5), (3, long, 2), (5, rows[7][1], 1), (None, long, 1), (6, None, 0), (6, "", 1)]
    assert got == sorted(want, key=str)
    assert op.keep_one(docs.select("doc_id", "text", F.create_map(F.lit("a"), F.lit(1)).alias("m"))).count() == 8


def test_a_giant_bucket_that_does_not_link():
    """Sets of like size with one shared shingle, some of them linked: groups of the bucket are compared exactly."""
    rng = np.random.default_rng(3)
    sets = [np.unique(np.concatenate([[7], rng.integers(10, 1 << 60, 50)])).astype(np.uint64) for _ in range(1500)]
    sets[700] = np.concatenate([sets[3][:-2], rng.integers(10, 1 << 60, 2).astype(np.uint64)])
    sets[700].sort()
    assert op.linked(np.arange(1500), sets) == [(3, 700)]
    half = np.arange(1500) < 600
    assert op.linked(np.arange(1500), sets, half, np.arange(1500)) == [(3, 700)]


def test_words_of_very_long_texts():
    text = b"Abc  def\x1cghi\t" * 200_000 + b"x" * 3_000_000
    own = op.word_hashes(text)
    assert len(own) == len(text.lower().split()) and len(set(own.tolist())) == 3
    assert op.word_hashes(b"x" * 64 + b"y") != op.word_hashes(b"y" + b"x" * 64)
    assert len(op.shingles(text)) == 3


def test_hubs_are_dealt_over_salts(spark, monkeypatch):
    from leafwright.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 8)
    monkeypatch.setattr(common, "SALTS", 4)
    links = spark.createDataFrame([(0, i) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(59, 100)], "a long, b long")
    assert {r.component for r in op.components(links).collect()} == {0}
    rows = [(i, "one two three") for i in range(40)] + [(50, "four five six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in op.near_duplicates(docs).collect()) == [(i, 0) for i in range(40)] + [(50, 50)]


def test_a_set_goes_once_to_a_group():
    """A group's table holds each set once, with all of its buckets there; links stay within buckets, whatever else lies in the group."""
    import pyarrow as pa

    own = [np.arange(k, k + 100, dtype="<u8") for k in (0, 2, 4, 1000)]
    table = pa.table({"doc_id": [1, 2, 3, 4], "buckets": pa.array([[9, 5], [9], [5, 6], [6]], pa.list_(pa.int64())), "shingles": pa.array([x.tobytes() for x in own], pa.binary())})
    found = op._bucket_links(table, 85)
    assert {frozenset(x) for x in zip(found["a"].to_pylist(), found["b"].to_pylist())} == {frozenset((1, 2)), frozenset((1, 3))}
