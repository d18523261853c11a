"""The queries of this package: thin ones over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import op01_language, op02_personal, op03_maxent, op04_topk, op05_minhash, op06_token_files, op07_quantised, op08_pieces, op09_packing, op11_main_text, op12_divergence, op13_variants
from . import op10_toxicity as toxicity
from .common import bucket_of_id


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_token_files.token_files(_read(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_pieces.encode_decode(_read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_packing.pack(_read(spark, sf_dir, "documents"))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").withColumn("held_out", bucket_of_id("doc_id", 4) == 2)
    learned = op01_language.dictionaries(docs.where("not held_out"))
    return op01_language.predict(docs, learned).withColumn("held_out", bucket_of_id("doc_id", 4) == 2)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.learn(docs.where(bucket_of_id("doc_id", 5) != 0), _read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumn("held_out", bucket_of_id("doc_id", 5) == 0)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = op04_topk.quantised(_read(spark, sf_dir, "embeddings"))
    return op04_topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op7_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return op07_quantised.search(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op2_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_personal.find(_read(spark, sf_dir, "documents"), op02_personal.train(op02_personal.labelled_table(spark)))


def op3_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return op03_maxent.score(docs, op03_maxent.train(docs.where(bucket_of_id("doc_id", 5) != 1))).withColumn("held_out", bucket_of_id("doc_id", 5) == 1)


def op11_main_text_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_main_text.extract(_read(spark, sf_dir, "pages"))


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_divergence.audit(_read(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_variants.variants(_read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_language, op2_personal, op3_maxent, op4_topk, op5_minhash, op6_token_files, op7_quantised, op8_sentencepiece, op9_packing, op10_toxicity, op11_main_text_of_pages, op12_divergence_audit, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op4_topk": op04_topk.TOP_5_SQL, "op5_minhash": op05_minhash.NEAR_DUPLICATES_SQL, "op12_divergence_audit": op12_divergence.AUDIT_SQL}
