import random

import numpy as np
import pyarrow as pa
import pytest

from leafwright.llm import op01_language, op10_toxicity

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_language_accuracy_on_unseen(spark, docs):
    learned = op01_language.dictionaries(docs.where("doc_id % 4 <> 2"))
    assert sorted(learned) == ["de", "en", "es", "fr"] and all(len(x) <= 100_000 for x in learned.values())
    got = op01_language.predict(docs, learned).join(docs, "doc_id").where("doc_id % 4 = 2")
    right, n, out = got.selectExpr("count_if(lang_pred = lang)", "count(*)", "count_if(rejected)").first()
    assert right >= 0.95 * n and out <= 0.02 * n


def test_language_edges(spark):
    rows = [(1, "the cat and the dog sat there", "en", 1), (2, "der hund und die katze sitzen", "de", 2), (3, None, "en", 3), (4, "12 345", None, 4), (5, "", "de", 5), (6, "the dog and the cat", None, 6), (6, "the dog and the cat", None, 6), (None, "die katze und der hund", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    learned = op01_language.dictionaries(docs)
    got = [(r.doc_id, r.lang_pred) for r in op01_language.predict(docs, learned).collect()]
    assert got == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (6, "en"), (None, "de")]
    assert {r.doc_id for r in op01_language.drop_rejected(docs, learned).collect()} == {1, 2, 6, None}
    nothing = op01_language.dictionaries(docs.limit(0))
    assert nothing == {} and {r.lang_pred for r in op01_language.predict(docs, nothing).collect()} == {"und"}
    assert op01_language.predict(docs.limit(0), learned).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def swapped(a, b):
    return any(a[:k] + a[k + 1] + a[k] + a[k + 2 :] == b for k in range(len(a) - 1))


def test_matcher_against_distances():
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 8))) for _ in range(12)]
    stems = ["abcab", "ccba"]
    matcher = op10_toxicity.Matcher(words, stems, 60)
    near = lambda a, b: distance(a, b) <= 1 or swapped(a, b)
    for _ in range(6000):
        token = "".join(rng.choice("abc") for _ in range(rng.randint(1, 10)))
        kinds = [op10_toxicity.EXACT] if token in words or any(token.startswith(s) for s in stems) else []
        kinds += [op10_toxicity.LONG if len(w) >= 5 else op10_toxicity.SHORT for w in words if near(w, token)]
        kinds += [op10_toxicity.STEM for s in stems for n in range(len(token) + 1) if near(s, token[:n])]
        assert matcher.match(token) == min(kinds, default=0), token


def test_quotation_counts_less():
    model = op10_toxicity.Model(["moron", "idiot"], [], op10_toxicity.PRIOR.tolist())
    rate = op10_toxicity.rater(model)
    abuse, misspelt, quoted, clean = rate("you moron and idiot"), rate("you mor0n and idi0t"), rate('he said the word "moron" was used'), rate("a fine day")
    assert abuse > misspelt > clean and abuse > 0.5 and quoted < 0.5 and clean < 0.1


def test_toxicity_on_unseen(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = op10_toxicity.learn(docs.where("doc_id % 5 <> 0"), labels)
    got = op10_toxicity.score(docs, model).join(labels, "doc_id").where("doc_id % 5 = 0").toPandas()
    order = got.score.rank().to_numpy()
    y = got.toxic.to_numpy() > 0
    auroc = (order[y].mean() - (y.sum() + 1) / 2) / (~y).sum()
    assert auroc > 0.75 and set(got.predicted) <= {0, 1} and np.isfinite(got.score).all()


def test_toxicity_edges(spark):
    rows = [(1, "you moron"), (2, None), (3, ""), (None, "fine"), (1, "you moron")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(1, 1, "a"), (1, 0, "b"), (None, 1, None), (3, None, None), (9, 0, "c")], "doc_id long, toxic int, text string")
    model = op10_toxicity.learn(docs, labels)
    got = op10_toxicity.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    none = op10_toxicity.learn(docs, labels.limit(0))
    assert none is None and {r.score for r in op10_toxicity.score(docs, none).collect()} == {0.0}
    assert op10_toxicity.score(docs.limit(0), model).count() == 0
    assert op10_toxicity.drop_toxic(docs, none).count() == 5


def test_counts_keep_their_types_when_the_last_is_empty():
    text = " ".join("".join(chr(97 + k // 26**i % 26) for i in range(4)) for k in range(26**4))
    texts = pa.RecordBatch.from_pydict({"text": [text], "toxic": [True]})
    got = list(op10_toxicity._term_counts(iter([texts])))
    assert [b.num_rows > 400_000 for b in got] == [True, False] and got[0].schema == got[1].schema


def test_edits_anywhere_raise_the_score():
    rate = op10_toxicity.rater(op10_toxicity.Model(["moron", "idiot", "stupid", "scum"], ["wretch"], op10_toxicity.PRIOR.tolist()))
    for token in ("1diot", "xstupid", "oron", "scvm", "idoit", "wr3tched", "mo-ron"):
        assert rate(f"the {token} here") > rate("the day here"), token


def test_quotation_is_seen_from_afar():
    rate = op10_toxicity.rater(op10_toxicity.Model(["moron"], [], op10_toxicity.PRIOR.tolist()))
    far = "the sign on the wall of the old house near the river reads moron and nothing else"
    assert rate(far.replace("the sign", 'the "sign', 1) + '"') < rate(far)
    assert op10_toxicity.quoted_tokens('a "b c" d «e f» g “h'.split()) == [False, True, True, False, True, True, False, True]


def test_very_long_texts(spark):
    text = "the cat sat on the mat and slept " * 40_000
    docs = spark.createDataFrame([(1, text + "you moron moron moron moron", "en"), (2, "x" * 1_000_000, "de"), (3, "der hund lief durch den wald", "de")], "doc_id long, text string, lang string")
    learned = op01_language.dictionaries(docs)
    assert {r.doc_id: r.lang_pred for r in op01_language.predict(docs, learned).collect()}[1] == "en"
    model = op10_toxicity.Model(["moron"], [], op10_toxicity.PRIOR.tolist())
    assert {r.doc_id: r.predicted for r in op10_toxicity.score(docs, model).collect()} == {1: 1, 2: 0, 3: 0}


def test_dictionaries_draw_from_the_whole_text_and_repeat(spark):
    rows = [(k, "alpha " * 3000 + f"omega{'x' * k} " * 3000, "a") for k in range(60)] + [(7, "another text " * 50, "a")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = op01_language.dictionaries(docs)
    assert b"alpha" in learned["a"] and b"omega" in learned["a"] and len(learned["a"]) <= 100_000
    assert learned == op01_language.dictionaries(docs.repartition(7))


def test_equal_sizes_go_to_the_first_language(spark):
    assert op01_language.Classifier({"b": b"the cat", "a": b"the cat"}).classify("the cat")[0::3] == ("a", True)
