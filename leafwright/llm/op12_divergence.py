"""Source divergence audit: how far a source's term shares lie from those of the other sources of its language.

Every (lang, source) group and every language gives each kept term a share in
billionths, p = 1 + floor(10^9 * (count + 5) / (N + 5 V)), all whole numbers. The
distance of two sources is the sum of |p - q| over the language's V kept terms.

Most counts are zero, so no pair walks the vocabulary. With p0 and q0 the shares
of a zero count, a pair starts at V * |p0 - q0|, and the postings of the terms
correct it. A term that only one of the two has adds |p - q0| - |p0 - q0|; that
depends on its count alone, so these corrections are summed by (group, count)
before they meet the other sources. For a term that both have, the two one-sided
corrections are too much by twice the overlap of [p0, p] and [q0, q]; the join of
the postings with themselves emits only overlaps that are not empty, and they are
added up before they are shuffled. Terms of a group are ranked by a window, which
drops all beyond the wanted ranks before its shuffle as well.

Rows of the texts are counted a task at a time (flushed at a bound of entries),
so a language or source with a third of all rows is as even as any other.

Defined results: null text, lang and source read as ''; each row is a document of
its own, whatever its id; groups without kept terms take part in pairs (a language
without kept terms has distances of 0); a source alone in its language has no
pairs; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, discard, settled, slices

#: A term is kept in a language from so many of its documents on.
DOCUMENTS = 30
#: Ranks of part ``term``.
RANKS = 50
#: Entries of a task's counts before they are passed on.
ENTRIES = 200_000
COUNTED = "lang string, source string, term string, n long, docs long"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Letters of ASCII and all signs beyond it; in UTF-8 these are whole sequences of such bytes.
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term) of a task; a row without terms leaves its group with the term null."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    entries = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            table = pa.table({"lang": [lang] * (len(terms) + 1), "source": [source] * (len(terms) + 1), "term": pa.array([None, *(t.decode() for t in terms)], pa.string()), "n": [0, *(n[t] for t in terms)], "docs": [0, *(docs[t] for t in terms)]})
            yield from table.to_batches(max_chunksize=50_000)

    for batch in slices(batches):
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), bytes_of(batch)):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            own = Counter(_TERM.findall(text.translate(LOWER)))
            before = len(n)
            n.update(own)
            docs.update(own.keys())
            entries += len(n) - before
        if entries >= ENTRIES:
            yield from rows()
            held, entries = {}, 0
    yield from rows()


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 * (n + 5) / (total + 5 * kept)), exact however large the counts are; null without kept terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", wide(n + 5) * F.lit(1_000_000_000).cast("decimal(10,0)"), F.nullif(wide(total + 5 * kept), wide(F.lit(0)))) + 1


def _gap(a: str, b: str) -> Column:
    return F.abs(F.col(a) - F.col(b))


def audit(docs: DataFrame, documents: int = DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the other sources, and the terms that a source has more of than its language."""
    texts = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.col("text").cast("string").alias("text"))
    counts = settled(texts.mapInArrow(counted, COUNTED).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")

    by_term = Window.partitionBy("lang", "term")
    kept = counts.where("term is not null").withColumn("everywhere", F.sum("docs").over(by_term)).withColumn("q_n", F.sum("n").over(by_term)).where(F.col("everywhere") >= documents)
    kept = settled(kept.select("lang", "term", "source", "n", "q_n"), "kept-terms")
    # Sizes: by group (also those without kept terms) and by language.
    sizes = counts.where("term is null").select("lang", "source").join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").fillna(0, ["total"])
    vocabulary = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kept"))
    langs = sizes.groupBy("lang").agg(F.sum("total").alias("q_total")).join(vocabulary, "lang", "left").fillna(0, ["kept"])
    groups = sizes.join(langs, "lang").withColumn("p0", _share(F.lit(0), F.col("total"), F.col("kept")))
    groups = settled(groups, "groups")

    shares = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "p0", _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), _share(F.col("q_n"), F.col("q_total"), F.col("kept")).alias("q"))
    postings = settled(shares, "postings")
    out = settled(_pairs(groups, postings).unionByName(_terms(postings, ranks)), "audit")
    discard(counts, kept, groups, postings)
    return out


def _pairs(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """Distances of all pairs of sources of a language, each seen from both sides."""
    a = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("a0"), "kept")
    b = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    base = a.join(b, "lang").where("a <> b").select("lang", "a", "b", F.coalesce(F.col("kept") * _gap("a0", "b0"), F.lit(0)).alias("value"))
    # Terms of one group with one count have one share: one row stands for them all.
    alike = postings.groupBy("lang", F.col("source").alias("a"), F.col("p0").alias("a0"), "p").agg(F.count("*").alias("terms"))
    one = alike.join(b, "lang").where("a <> b").select("lang", "a", "b", (F.col("terms") * (_gap("p", "b0") - _gap("a0", "b0"))).alias("value")).where("value <> 0")
    x = postings.select("lang", "term", F.col("source").alias("a"), F.col("p0").alias("a0"), F.col("p").alias("a1"))
    y = postings.select("lang", "term", F.col("source").alias("b"), F.col("p0").alias("b0"), F.col("p").alias("b1"))
    both = x.join(y, ["lang", "term"]).where("a < b and least(a1, b1) > greatest(a0, b0)").select("lang", "a", "b", (-2 * (F.least("a1", "b1") - F.greatest("a0", "b0"))).alias("value"))
    half = one.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value").unionByName(both).unionByName(base.where("a < b")).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    seen = half.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(half.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    return seen.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(postings: DataFrame, ranks: int) -> DataFrame:
    """The terms with the largest surplus over the language, ``ranks`` of each group."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    more = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)


#: The same rows in SQL, with every pair's sum over the whole vocabulary.
AUDIT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS MATERIALIZED (SELECT row, lang, source, unnest(terms) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 30),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(x.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL) AS x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)::HUGEINT) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM c),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 5)::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL)),
v AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source AS s, b.source AS o, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL) AS x ON x.lang = a.lang AND x.s = a.source AND x.o = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, (p.p - q.q)::BIGINT FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q
)
SELECT * FROM (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM v) WHERE part = 'pair' OR rank <= 50
"""
