import math
import re
from collections import Counter

import numpy as np

from leafwright.llm import op03_maxent as op

DATA = "/root/testdata/sf0.001"


def words(text):
    return [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), " "]


def base(rows, training):
    c = Counter(w for _, t in training for w in words(t))
    n, v = sum(c.values()), len(c)
    return n, [(i, len(words(t)), sum(c[w] > 0 for w in words(t)), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))) for i, t in rows]


def check(spark, rows, training, hot):
    schema = "doc_id long, text string, score string"
    docs = spark.createDataFrame([(*r, "x") for r in rows], schema)
    n, want = base(rows, training)
    got = op.score(docs, op.train(spark.createDataFrame([(*r, "x") for r in training], schema), hot=hot)).collect()
    key = lambda r: (str(r[0]), r[3])
    for g, w in zip(sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got), key=key), sorted(want, key=key), strict=True):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-6 * max(1, abs(w[3]))
    assert {r.train_tokens for r in got} <= {n}
    assert all(math.isfinite(r.score) for r in got)
    return got


def test_base_and_edges(spark):
    rows = [(1, "The cat sat on the mat"), (2, None), (3, " \t"), (None, "the É dog"), (1, "The cat sat on the mat"), (4, "unseen\x1cword  here"), (5, "word " * 5000)]
    check(spark, rows, rows[:2], 3)
    check(spark, rows, [], 10)
    check(spark, [], rows, 10)


def test_better_than_counts_on_unseen(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    training = [r for r in rows if r[0] % 5 != 1]
    got = check(spark, rows, training, 2000)
    held = [r for r in got if r.doc_id % 5 == 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_softmax_sums_to_one_and_learns():
    rng = np.random.default_rng(0)
    weights, squares = np.zeros((op.TABLE, op.CLASSES), dtype=np.float32), np.zeros((op.TABLE, op.CLASSES), dtype=np.float32)
    features = (rng.integers(0, 4, (4000, op.FEATURES)) + 4 * np.arange(op.FEATURES)).astype(np.uint16)
    classes = features[:, 0].astype(int)
    for _ in range(80):
        op.ascend(weights, squares, features, classes)
    p = op.softmax(weights, features)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4) and p[np.arange(4000), classes].mean() > 0.9
    assert np.allclose(op.log_of(weights, features, classes), np.log(p[np.arange(4000), classes]), atol=1e-4)


def test_gradient_is_the_sum_over_tokens():
    rng = np.random.default_rng(1)
    weights = rng.normal(0, 1, (op.TABLE, 6)).astype(np.float32)
    features, outcomes = rng.integers(0, 5, (50, 3)).astype(np.uint16), rng.integers(0, 6, 50)
    gap = -op.softmax(weights, features)
    gap[np.arange(50), outcomes] += 1
    want = np.zeros_like(weights, dtype=np.float64)
    for i in range(50):
        for f in features[i]:
            want[f] += gap[i]
    squares, new = np.zeros_like(weights), weights.copy()
    op.ascend(new, squares, features, outcomes)
    assert np.allclose(squares, want**2, atol=1e-3)
    assert np.allclose(new - weights, op.STEP * want / np.sqrt(want**2 + 1e-3), atol=1e-3)


def plain_score(text, model, counts, reader):
    """The model's log10 probability, token by token, from its parts."""
    tokens = words(text)
    mark = lambda w: int(reader.mark[reader.numbers[w]]) if w is not None else 0
    cls = lambda w: int(reader.cls[reader.numbers[w]]) if w is not None else 0
    mix = lambda x, s: int(op.mix64(np.array([x], dtype=np.uint64), s)[0])
    mask, total = op.leaf_mask(model.places), 0.0
    for w in tokens:
        reader._add([x for x in [w.encode()] if x not in reader.numbers])
    for i, w in enumerate(tokens):
        before = [tokens[i - k].encode() if i >= k else None for k in (1, 2, 3)]
        m = [mark(b) for b in before]
        pair = mix(m[0] ^ mix(m[1], 31), 32)
        hashed = [mix(m[0], 20), mix(m[1], 21), mix(m[2], 22), pair, mix(cls(before[0]) * op.CLASSES + cls(before[1]), 30)]
        logits = sum(model.weights[h % op.TABLE].astype(float) for h in hashed)
        c, leaf = cls(w.encode()), int(reader.leaf[reader.numbers[w.encode()]])
        total += (logits[c] - np.log(np.exp(logits).sum())) / np.log(10)
        if (mask[c] == 0).sum() > 1:
            own = [mix(h ^ mix(c, 40), 41) % op.TABLE for h in (hashed[0], hashed[1], hashed[3])]
            logits = sum(model.leaf_weights[h].astype(float) for h in own) + mask[c]
            total += (logits[leaf] - np.log(np.exp(logits).sum())) / np.log(10)
        if leaf == op.REST:
            total += math.log10((counts.get(w, 0) + 0.5) / (model.rest_tokens[c] + 0.5 * (model.rest_words[c] + 1)))
    return total


def test_score_against_plain_loops(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    schema = "doc_id long, text string"
    model, table = op.train(spark.createDataFrame(texts[:120], schema), hot=900)
    counts = {r.word: r.n for r in table.collect()}
    assert (op.leaf_mask(model.places) == 0).sum(axis=1).max() > 8 and np.abs(model.leaf_weights).max() > 0
    few = [*texts[110:130], (1000, "never seen before"), (1001, None)]
    got = {r.doc_id: r.score for r in op.score(spark.createDataFrame(few, schema), (model, table)).collect()}
    for i, t in few:
        want = plain_score(t, model, counts, op.Reader(model.hot, model.spelling, model.places))
        assert abs(got[i] - want) < 1e-3 * max(1, abs(want)), (i, got[i], want)
