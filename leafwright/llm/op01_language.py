"""Language identification by compression.

Each language has a raw-content zstandard dictionary, cut from a bounded sample
of labelled documents. A text is lower-cased, everything but letters becomes one
space, and blocks of it are compressed with every dictionary; the language
whose dictionary gives the fewest bytes over all blocks wins. Where the runner-up is
nearly as small, the text is rejected: it has too little of any one language.

Bounds, all parameters: ``docs_per_lang`` labelled documents for each of the
``most_langs`` languages with most labelled documents (those with the smallest
hash of the id), ``dict_bytes`` of dictionary for each language, shared evenly by
those documents and drawn from ``PLACES`` places spread over each whole text.

Defined results: a null text and a text without letters are ``und`` with score 0,
and rejected; rows with a null language, text or id teach nothing; of rows with
one id and language the smallest text teaches; without any labelled row all is
``und``; equal sizes go to the alphabetically first
language and are rejected; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import each_text, slices, texts_of

DOCS_PER_LANG = 128
DICT_BYTES = 96_000
MOST_LANGS = 256
PLACES = 6
BLOCK = 2048
LEVEL = 9
#: Smaller relative distances between the best two sizes are rejected.
MARGIN = 0.004
RESULT = "doc_id long, lang_pred string, score double, margin double, rejected boolean"

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters_of(text: str) -> str:
    return _NOT_LETTERS.sub(" ", text.lower()).strip()


def dictionaries(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG, dict_bytes: int = DICT_BYTES, most_langs: int = MOST_LANGS) -> dict[str, bytes]:
    """Raw dictionary content by language, from (doc_id, text, lang) rows."""
    usable = labelled.where("doc_id is not null and lang is not null and text is not null")
    ids = usable.select("doc_id", "lang").distinct()
    sizes = ids.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    if not sizes:
        return {}
    # Three times as many as wanted by hash, so that the window sees a bounded number of rows.
    share = F.coalesce(*(F.when(F.col("lang") == r.lang, 3 * docs_per_lang / r.n) for r in sizes), F.lit(0.0))
    few = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < share * float(1 << 40))
    order = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id")
    chosen = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= docs_per_lang).drop("rank")
    # Windows at even distances over the whole text; a short text is one window.
    width = 4 * dict_bytes // (docs_per_lang * PLACES)
    step = F.greatest(F.lit(1), F.ceil((F.length("text") - width) / (PLACES - 1))).cast("int")
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - width + 1), step), lambda at: F.substr(F.col("text"), at, F.lit(width)))
    windows = F.when(F.length("text") <= PLACES * width, F.array("text")).otherwise(windows)
    # At most docs_per_lang rows for each of most_langs languages on the small side and in the result.
    texts = usable.join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "lang", "text")
    rows = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("doc_id", "lang", windows.alias("windows")).collect()
    out: dict[str, list[bytes]] = {}
    taught = Counter(r.lang for r in rows)
    for row in sorted(rows, key=lambda r: (r.lang, r.doc_id)):
        own = _spread([letters_of(w).encode() for w in row.windows], dict_bytes // min(docs_per_lang, taught[row.lang]))
        out.setdefault(row.lang, []).append(b" ".join(own))
    return {lang: b" ".join(_spread(parts, dict_bytes)) for lang, parts in out.items()}


def _spread(parts: list[bytes], most: int) -> list[bytes]:
    """As many bytes of each part as fit evenly."""
    left, out = most, []
    for k, part in enumerate(sorted(parts, key=len)):
        take = min(len(part), left // (len(parts) - k))
        out.append(part[:take])
        left -= take
    return out


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.langs = sorted(dictionaries)
        self.compressors = []
        for lang in self.langs:
            own = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False)
            own.precompute_compress(compression_params=params)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=own, compression_params=params))

    def classify(self, text: str, margin: float = MARGIN) -> tuple[str, float, float, bool]:
        """Language, confidence, relative margin and whether it is rejected."""
        data = letters_of(text).encode()
        if not data or not self.langs:
            return "und", 0.0, 0.0, True
        blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
        sizes = [sum(len(c.compress(x)) for x in blocks) for c in self.compressors]
        (best, k), (second, _) = (sorted((n, i) for i, n in enumerate(sizes)) + [(len(data) + 16, -1)])[:2]
        gap = max(0, second - best)
        share = gap / max(1, second)
        return self.langs[k], 1 - 0.5 * 2.0 ** (-min(gap, 400) / 8), share, share < margin


def predict(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, margin and rejected for each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # dict_bytes for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value)
        for batch in slices(batches):
            lang, score, share, out = zip(*(model.classify(t, margin) for t in texts_of(batch)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang), pa.array(score), pa.array(share), pa.array(out)], names=["doc_id", "lang_pred", "score", "margin", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def drop_rejected(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """The documents, all columns, without those that the classifier rejects; only texts leave the JVM."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    @F.arrow_udf("boolean")
    def certain(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Classifier(shared.value)
        for batch in texts:
            yield pa.array([not model.classify(t, margin)[3] for t in each_text(batch)], pa.bool_())

    return docs.where(certain("text"))
