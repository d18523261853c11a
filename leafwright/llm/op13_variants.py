"""Spelling variants: words within one edit of each other, and the frequent form of each.

Words are counted a task at a time. Two words of at most one edit are found by an
even-partition pigeonhole join: a word of length L is indexed by two segments,
its first L // 2 code points and the rest, under (L, segment). One edit leaves one of
the two whole, so a word meets its neighbours of equal length under its own two
segments, and those one shorter under the two substrings where an insertion would
have left them: the first at its place, the second one place further on. The edit is
verified within the join, which passes on near pairs alone. Short segments are shared by
very many words, so the same rule is used once more within the key: the part of the word
outside the segment, which holds the edit, is cut evenly as well, and one of its
halves is whole and joins the key. A pair that meets under several keys counts under the
first. Keys that many words share even so are dealt over salts.

A word's form is its near word of the largest count, if that is ``RATIO`` times its
own; roots are found by pointer jumping, as counts rise with every step at most the
logarithm of the logarithm of the counts many rounds.

Defined results: null text has no words; a null id counts as the empty text in the
hash that decides on deletions; rows that repeat an id count each; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, copied, dealt, discard, hot_slots, settled, slices

#: Shortest word in code points, least occurrences, and how many times more frequent a form is.
LENGTH, OCCURRENCES, RATIO = 7, 2, 10
#: One run in so many loses a code point.
DELETED = 31
#: Distinct words of a task before they are passed on.
ENTRIES = 300_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def changed(run: str, prefix: int) -> str:
    """The run, without one code point if the hash says so; ``prefix`` is the crc32 of ``<doc_id>:``."""
    h = zlib.crc32(run.encode(), prefix)
    if h % DELETED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counted(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """word, n of a task's texts."""
    # Shorter runs make no word; a greedy run from its leftmost letter is maximal.
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % length)
    held: Counter = Counter()

    def rows() -> Iterator[pa.RecordBatch]:
        yield from pa.table({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())}).to_batches(max_chunksize=50_000)

    for batch in slices(batches):
        for doc, text in zip(batch.column("doc_id").to_pylist(), bytes_of(batch)):
            prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for run, n in Counter(runs.findall(text.translate(LOWER).decode())).items():
                word = changed(run, prefix)
                if len(word) >= length:
                    held[word] += n
        if len(held) >= ENTRIES:
            yield from rows()
            held.clear()
    yield from rows()


def words(docs: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES) -> DataFrame:
    """word, n of the words with enough occurrences over all documents."""
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(lambda batches: counted(batches, length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def _keys(word: str, shorter: int) -> Column:
    """The keys of a word, or those under which words one shorter lie: length, which segment, which half of the rest, both contents."""
    w, size = F.col(word), F.char_length(word) - shorter
    half = F.floor(size / 2).cast("int")
    out = []
    # The kept segment, and where the rest of this word begins and how long it is in the shorter one.
    for nth, begin, kept, other, left in ((1, F.lit(1), half, half + 1, size - half), (2, half + 1 + shorter, size - half, F.lit(1), half)):
        part = F.floor(left / 2).cast("int")
        for nth_part, at, n in ((1, other, part), (2, other + part + shorter, left - part)):
            out.append(F.struct(size.alias("length"), F.lit(2 * nth + nth_part - 2).alias("nth"), F.substr(w, begin, kept).alias("segment"), F.substr(w, at, n).alias("part")))
    return F.array(*out)


def near_pairs(own: DataFrame) -> DataFrame:
    """word, n, other, other_n: each pair of words at one edit once, the shorter (or smaller) first. Needs distinct words."""
    index = own.select("word", "n", F.explode(_keys("word", 0)).alias("key")).select("word", "n", "key.*")
    probes = own.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.explode(F.concat(_keys("word", 0), _keys("word", 1))).alias("key")).select("other", "other_n", "key.*")
    keys = ["length", "nth", "segment", "part"]
    counts = index.groupBy(*keys).agg(F.count("*").alias("n"))
    slots = hot_slots(counts, keys, 4 * own.count())
    met = dealt(probes, keys, "other", slots).join(copied(index, keys, slots), [*keys, "salt"])
    one_edit = F.levenshtein("word", "other", 1) == 1
    ordered = (F.char_length("other") != F.col("length")) | (F.col("word") < F.col("other"))
    # The first of the keys that both words have is the one that counts.
    found = met.where(ordered & one_edit)
    same = F.char_length("other") == F.col("length")
    met_first = F.when(same, _first_common(0)).otherwise(_first_common(1))
    return found.where(F.col("nth") == met_first).select("word", "n", "other", "other_n")


def _first_common(shorter: int) -> Column:
    mine, theirs = _keys("word", 0), _keys("other", shorter)
    hits = [F.when(mine[k] == theirs[k], k + 1) for k in range(4)]
    return F.coalesce(*hits)


def _roots(forms: DataFrame) -> DataFrame:
    """word, root from word, form by pointer jumping."""
    own = settled(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = own.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = settled(own.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not stepped.where("moved").isEmpty()
        discard(own)
        own = stepped
        own.settled_at = stepped.settled_at
        if not moved:
            return own


def variants(docs: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    own = settled(words(docs, length, occurrences), "words")
    pairs = settled(near_pairs(own), "near")
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    found = own.join(best, "word", "left").withColumn("is_form", -F.col("best.less") >= ratio * F.col("n"))
    chosen = settled(found.select("word", F.when(F.col("is_form"), F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("is_form"), -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(chosen.where("form is not null"))
    out = settled(chosen.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
    discard(own, pairs, chosen, roots)
    return out
