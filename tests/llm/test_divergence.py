"""Source divergence against sums over the whole vocabulary, by plain loops."""

import random
import re
from collections import Counter, defaultdict

from leafwright.llm import op12_divergence as op


def brute(rows, documents, ranks):
    texts = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for lang, source, t in rows]
    groups, df = sorted({(x[0], x[1]) for x in texts}), Counter()
    n = defaultdict(Counter)
    for lang, source, terms in texts:
        df.update((lang, t) for t in set(terms))
        n[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (own, t), c in df.items() if own == lang and c >= documents)
        sources = [s for own, s in groups if own == lang]

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(n[lang, s]) for s in sources}
        q = shares(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-(p[s][t] - q[t]), t.encode(), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


def made(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "Übel", "übel", "naïve", "日本", "é", "x1y", "a_b", "don't", "😀"] + [f"{c}{d}" for c in "abcdefgh" for d in "mnopq"]
    rows = [("en", "empty", None), ("en", "", ""), (None, None, "the the"), ("xx", "alone", "never kept"), ("xx", "other", ""), ("de", "one", "wort " * 9)]
    for _ in range(n):
        lang = rng.choice(("en", "en", "fr"))
        source = "hot" if rng.random() < 0.4 else f"s{rng.randrange(6)}"
        own = words[: 20 + hash_of(source)] if lang == "en" else words
        rows.append((lang, source, rng.choice((" ", ", ", "\n")).join(rng.choice(own) for _ in range(rng.randrange(0, 30)))))
    return rows


def hash_of(source):
    return sum(map(ord, source)) % 25


def test_against_sums_over_all_terms(spark):
    rows = made(1, 300)
    docs = spark.createDataFrame([(k % 7, *r, "clash") for k, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string")
    for documents, ranks in ((30, 50), (3, 4), (1, 1000)):
        assert sorted(tuple(r) for r in op.audit(docs, documents, ranks).collect()) == brute(rows, documents, ranks)


def test_edges(spark):
    schema = "doc_id long, lang string, source string, text string"
    assert op.audit(spark.createDataFrame([], schema)).count() == 0
    # No kept term: every distance is 0, ties in order of the name; a source alone has no pair.
    docs = spark.createDataFrame([(1, "en", "b", "x"), (2, "en", "a", None), (3, "fr", "c", "y")], schema)
    assert sorted(tuple(r) for r in op.audit(docs).collect()) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    # Repeated rows are documents of their own; very long texts count whole; entries are flushed.
    long = [("en", s, "word" * 50 + f" {s} " + "zebra " * 200_000) for s in ("a", "b")] + [("en", "c", "zebra tail")] * 40
    docs = spark.createDataFrame([(1, *r) for r in long], schema)
    assert sorted(tuple(r) for r in op.audit(docs, 2).collect()) == brute(long, 2, 50)


def test_counts_are_flushed(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(op, "ENTRIES", 3)
    monkeypatch.setattr(op, "slices", lambda batches: (b.slice(k, 1) for b in batches for k in range(b.num_rows)))
    batch = pa.record_batch({"lang": ["en"] * 4, "source": ["s"] * 4, "text": ["a b c", "a b", "a a", None]})
    parts = list(op.counted(iter([batch])))
    assert len(parts) > 1
    total = Counter()
    for part in parts:
        for row in part.to_pylist():
            total[row["term"]] += row["n"]
    assert total == {None: 0, "a": 4, "b": 2, "c": 1}
