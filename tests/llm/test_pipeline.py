import corpus_pipeline
from leafwright.llm import op01_language, op02_personal, op05_minhash, op09_packing, op10_toxicity
from tests.llm.test_minhash import brute
from tests.llm.test_tokens import check_sequences, ids_of

DATA = "/root/testdata/sf0.001"


def test_stages_against_plain_steps(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = op01_language.Classifier(op01_language.dictionaries(docs))
    kept = {i: t for i, t in rows.items() if not model.classify(t)[3]}
    assert len(kept) > 0.95 * len(rows)
    first = corpus_pipeline.language(spark, docs, DATA)
    assert {r.doc_id for r in first.collect()} == set(kept) and first.columns == docs.columns
    rate = op10_toxicity.rater(op10_toxicity.learn(first, labels))
    kept = {i: t for i, t in kept.items() if rate(t) < 0.5}
    second = corpus_pipeline.toxicity(spark, first, DATA)
    assert {r.doc_id for r in second.collect()} == set(kept)
    one = {i for i, _, _, own in brute(list(kept.items()), 5, 80) if own}
    third = corpus_pipeline.near_duplicates(spark, second, DATA)
    assert {r.doc_id for r in third.collect()} == one
    field = op02_personal.train(op02_personal.labelled_table(spark))
    texts = {i: op02_personal.redacted(kept[i], op02_personal.all_spans([kept[i]], field)[0][1]) for i in one}
    fourth = corpus_pipeline.personal_data(spark, third, DATA)
    got = {r.doc_id: r for r in fourth.collect()}
    assert {i: r.text for i, r in got.items()} == texts and all(r.n_chars == len(r.text) for r in got.values())
    assert not any(op02_personal.base_spans(t) for t in texts.values())
    packed = corpus_pipeline.run(spark, DATA).collect()
    assert sum(r.length for r in packed) == sum(len(ids_of(t, 0)) for t in texts.values())
    n = check_sequences(packed)
    assert n <= 1.02 * sum(r.length for r in packed) / op09_packing.CAPACITY + 2


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    rows = [(1, None, "en", None, None, "x"), (None, "the cat sat", None, None, None, None), (2, "", None, "s", 0, "x"), (3, "the cat sat on the mat", "en", "s", 22, "x"), (3, "the cat sat on the mat", "en", "s", 22, "x")]
    docs = spark.createDataFrame(rows, schema)
    assert op05_minhash.keep_one(docs).count() == 4  # the row that repeats goes
    for stage in (corpus_pipeline.language, corpus_pipeline.toxicity, corpus_pipeline.near_duplicates, corpus_pipeline.personal_data):
        for table in (docs, docs.limit(0)):
            assert stage(spark, table, DATA).columns == docs.columns
            stage(spark, table, DATA).collect()
    assert corpus_pipeline.packing(spark, docs.limit(0), DATA).count() == 0
