"""Spelling variants against all pairs of words, by plain loops."""

import random
import re
import zlib
from collections import Counter

from leafwright.llm import op13_variants as op


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 7 and c >= 2}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def made(seed, stems, rows):
    rng = random.Random(seed)
    letters = "abcdeé"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 12))) for _ in range(stems)]
    out = []
    for k in range(rows):
        words = []
        for _ in range(rng.randrange(40)):
            w = base[min(stems - 1, int(rng.expovariate(0.08)))]
            for _ in range(rng.choice((0, 0, 0, 0, 1, 1, 2))):
                at = rng.randrange(len(w) + 1)
                w = rng.choice((w[:at] + rng.choice(letters) + w[at:], w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at + 1 :]))
            words.append(rng.choice((w, w, w.upper(), w.title())))
        out.append((None if k % 97 == 5 else k % 200, rng.choice((" ", "-", "1", "ß ")).join(words)))
    return [*out, (1, None), (2, ""), (3, "x" * 300 + " " + "longword " * 5000), (3, "ÀÿÀÿÀÿÀ ÀÿÀÿÀÿÀ àÿÀÿÀÿÀ")]


def test_against_all_pairs(spark):
    rows = made(3, 60, 900)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = sorted(tuple(r) for r in op.variants(docs).collect())
    assert got == brute(rows)
    assert {r[1] is None for r in got} == {True, False} and any(r[2] not in (r[0], r[1]) for r in got)  # chains of two steps among them


def test_hot_segments(spark, monkeypatch):
    """Words that nearly all share a segment are dealt over salts, and none is lost."""
    monkeypatch.setattr(op, "hot_slots", lambda *a: list(range(4096)))
    rng = random.Random(5)
    rows = [(k, " ".join(["sameseg" + "".join(rng.choice("xy") for _ in range(7))] * 2)) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in op.variants(docs).collect()) == brute(rows)


def test_edges(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op.variants(docs).count() == 0
    docs = spark.createDataFrame([(1, "short words only"), (2, None)], "doc_id long, text string")
    assert op.variants(docs).count() == 0


def test_counts_are_flushed(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(op, "ENTRIES", 2)
    monkeypatch.setattr(op, "slices", lambda batches: (b.slice(k, 1) for b in batches for k in range(b.num_rows)))
    batch = pa.record_batch({"doc_id": ["1", "2", "3"], "text": ["abcdefg hijklmn", "abcdefg opqrstu", "abcdefg"]})
    parts = list(op.counted(iter([batch]), 7))
    assert len(parts) > 1 and sum(sum(p.column("n").to_pylist()) for p in parts) == 5
