"""Near-duplicates: fast similarity sketches, banding, exact verification.

A sketch has ``COORDINATES`` coordinates. In round i every shingle hashes to a
random coordinate with the value (i, hash); from round ``COORDINATES`` on, round
``COORDINATES + b`` aims at coordinate b alone, so every coordinate fills, and
later rounds never beat earlier ones. Coordinates of two sets agree with the
sets' Jaccard similarity as probability, concentrated as in MinHash, but a set
of n shingles needs only about n + t log t hash values instead of n * t.

Documents with equal shingle sets are one class, so copies cost one comparison
of fingerprints. Classes that agree on all rows of a band meet in its bucket.
With 24 bands of 4 rows a pair at similarity 0.85 is missed with probability
2e-8, one at 0.8 with 3e-6.
A bucket is searched exactly: from one member after another all members of
fitting size not yet reached are compared on full shingle sets, so what comes
out are the bucket's connected parts. Groups are bounded by shingles, not by
members: small buckets share a group, dealt by their smallest member, so that those of one cluster lie together and
a set goes once to each group however many of its buckets are there, and a bucket beyond ``WEIGHT`` shingles is
dealt by classes of set size and by hash into chunks; the members that did not
end up in its largest part are then compared, block by block, with every chunk
of their own and the neighbouring size classes, as no link spans more. No pairs
are listed, and no link inside a bucket is lost; a bucket whose members do not
link costs the product of its chunks. Components
come from alternating large-star and small-star rounds over the links, with the rows of hubs dealt over
salts. A set is known by its size and 128 bits of sums, its members by 64 bits.

Defined results: a null or wordless text has an empty set, links with nothing
and is its own component; rows that repeat a doc_id share its component, which
the links of any of their texts decide; a null id takes part in no link (component null, kept
false); empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import bytes_of, copied, dealt, discard, hot_slots, mix64, settled, slices

#: The query's contract: shingles of WORDS words, linked where 100 * intersection >= SHARE * union.
WORDS = 3
SHARE = 85
BANDS, ROWS = 24, 4
COORDINATES = BANDS * ROWS
#: Shingles of a group, 8 bytes each.
WEIGHT = 250_000
#: Of the bitmap that marks wanted ids: 8 MB.
BITS = 1 << 26
#: Bytes of a text that are hashed at once.
BLOCK = 1 << 20
FINGERPRINTS = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"
LINKS = "a long, b long"

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_LETTERS = mix64(np.arange(64 * 256), 50).reshape(64, 256)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words, in order: sums over the bytes by place, mixed."""
    raw = np.frombuffer(text.lower(), dtype=np.uint8)  # ASCII case only
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        part = raw[at:end]
        letters = np.flatnonzero(~_SPACE[part])
        if len(letters):
            starts = np.flatnonzero(np.diff(letters, prepend=-2) > 1)
            place = np.arange(len(letters)) - np.repeat(starts, np.diff(starts, append=len(letters)))
            own = _LETTERS[place & 63, part[letters]] * (2 * (place >> 6) + 1).astype(np.uint64)
            out.append(mix64(np.add.reduceat(own, starts), 60))
        at = end
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text, as sorted 64-bit hashes."""
    own = word_hashes(text)
    if not len(own):
        return own
    width = min(words, len(own))
    out = np.full(len(own) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = mix64(out ^ own[k : len(own) - width + 1 + k], k + 1)
    return np.unique(out)


_SEEDS = (2 * (100 + np.arange(2 * COORDINATES, dtype=np.uint64)) + 1) * np.uint64(0x9E3779B97F4A7C15)


def sketch(items: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of 64-bit hashes."""
    t, first = np.uint64(coordinates), math.ceil(9 * coordinates / len(items))
    out, done = np.full(coordinates, _EMPTY), 0
    places = np.arange(coordinates, dtype=np.uint64) << np.uint64(48)
    while done < coordinates and (out == _EMPTY).any():
        rounds = np.arange(done, min(coordinates, done + first), dtype=np.uint64)
        hashed = mix64(items[None, :] + (_SEEDS[rounds] - _SEEDS[0])[:, None], 100)
        value = (rounds << np.uint64(40))[:, None] | (hashed >> np.uint64(24))
        # By coordinate, then by value; earlier rounds have the smaller values.
        by = np.sort((((hashed & np.uint64(0xFFFFFF)) % t) << np.uint64(48) | value).ravel())
        at = np.searchsorted(by, places)
        least = by[np.minimum(at, len(by) - 1)]
        fills = (at < len(by)) & (least >> np.uint64(48) == np.arange(coordinates, dtype=np.uint64)) & (out == _EMPTY)
        out[fills] = (least & np.uint64((1 << 48) - 1))[fills]
        done += len(rounds)
    for b in np.flatnonzero(out == _EMPTY):
        i = coordinates + int(b)
        out[b] = (np.uint64(i) << np.uint64(40)) | (mix64(items, 100 + i) >> np.uint64(24)).min()
    return out


def band_keys(coords: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = coords.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows.shape[1]):
        key = mix64(key ^ rows[:, k], 7)
    return key


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Set size, two fingerprints of the set, and band keys of every document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            size, f1, f2, bands = [], [], [], []
            for text in bytes_of(batch):
                own = shingles(text, words)
                size.append(len(own))
                f1.append(int(mix64(own, 11).sum().view(np.int64)) if len(own) else 0)
                f2.append(int(mix64(own, 12).sum().view(np.int64)) if len(own) else 0)
                bands.append(band_keys(sketch(own)).view(np.int64).tolist() if len(own) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "f1", "f2", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, FINGERPRINTS)


class Sets:
    """Sets of shingles laid end to end by size, with small numbers for shingles, to compare one with all of fitting size."""

    def __init__(self, sets: list[np.ndarray], share: int):
        self.order = np.argsort([len(x) for x in sets], kind="stable")
        sets = [sets[k] for k in self.order]
        self.share, self.sizes = share, np.array([len(x) for x in sets], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        names, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(names), dtype=np.uint8)

    def members(self, k: int) -> np.ndarray:
        return self.flat[self.starts[k] : self.starts[k] + self.sizes[k]]

    def like(self, own: np.ndarray) -> tuple[int, np.ndarray]:
        """Which sets, from the first of fitting size on, are linked with one."""
        n = len(own)
        lo = int(np.searchsorted(self.sizes * 100, self.share * n))
        hi = int(np.searchsorted(self.sizes * self.share, 100 * n, side="right"))
        if lo >= hi:
            return lo, np.empty(0, dtype=bool)
        a, b = self.starts[lo], self.starts[hi - 1] + self.sizes[hi - 1]
        self.mark[own] = 1
        both = np.add.reduceat(self.mark[self.flat[a:b]], self.starts[lo:hi] - a, dtype=np.int64)
        self.mark[own] = 0
        return lo, 100 * both >= self.share * (self.sizes[lo:hi] + n - both)

    def only(self, keep: np.ndarray) -> Sets:
        """The sets at these places (ascending), without laying shingles out anew."""
        out = object.__new__(Sets)
        out.share, out.mark, out.sizes, out.order = self.share, self.mark, self.sizes[keep], keep
        out.starts = np.concatenate([[0], np.cumsum(out.sizes)[:-1]])
        out.flat = np.concatenate([self.members(k) for k in keep]) if len(keep) else self.flat[:0]
        return out


def linked(ids: np.ndarray, sets: list[np.ndarray], probes: np.ndarray | None = None, label: np.ndarray | None = None, share: int = SHARE) -> list[tuple[int, int]]:
    """Links that connect what is connected among the sets.

    From one member after another, all members not yet reached are compared.
    With ``probes``, only links of these members count; members of one ``label``
    are known to be connected.
    """
    out: list[tuple[int, int]] = []
    whole = Sets(sets, share)
    ids, n = ids[whole.order], len(ids)
    if probes is None:
        # Places in ``open_`` that are still unseen; it is laid out anew when half of them are gone.
        open_, unseen = whole.only(np.arange(n)), np.ones(n, dtype=bool)
        for start in range(n):
            if not unseen[start]:
                continue
            unseen[start], queue = False, [start]
            while queue:
                lo, hits = open_.like(whole.members(queue.pop()))
                found = open_.order[lo : lo + len(hits)][hits]
                found = found[unseen[found]]
                out += [(int(ids[start]), int(ids[k])) for k in found]
                unseen[found] = False
                queue += found.tolist()
                if 2 * unseen.sum() < len(open_.order):
                    open_ = whole.only(np.flatnonzero(unseen))
        return out
    probes, label = probes[whole.order], label[whole.order]
    for one in np.flatnonzero(probes):
        lo, hits = whole.like(whole.members(one))
        found = np.arange(lo, lo + len(hits))[hits]
        found = found[label[found] != label[one]]
        # one link for each other part is enough
        out += [(int(ids[one]), int(ids[k])) for k in found[np.unique(label[found], return_index=True)[1]]]
    return out


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype="<u8") for x in table.column("shingles")]


def _links_table(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _bucket_links(table: pa.Table, share: int) -> pa.Table:
    """Links within each bucket of a group."""
    ids, sets, lists = table.column("doc_id").to_numpy(), _sets(table), table.column("buckets").combine_chunks()
    bucket, row = pc.list_flatten(lists).to_numpy(), pc.list_parent_indices(lists).to_numpy()
    order = np.argsort(bucket, kind="stable")
    found = []
    for own in np.split(row[order], np.flatnonzero(np.diff(bucket[order])) + 1):
        found += linked(ids[own], [sets[k] for k in own], share=share)
    return _links_table(found)


def _probe_links(minor: pa.Table, chunk: pa.Table, share: int) -> pa.Table:
    if not minor.num_rows or not chunk.num_rows:
        return _links_table([])
    both = pa.concat_tables([minor, chunk])
    return _links_table(linked(both.column("doc_id").to_numpy(), _sets(both), np.arange(both.num_rows) < minor.num_rows, both.column("part").to_numpy(), share))


def _least(edges: DataFrame, or_own: bool, total: int) -> tuple[DataFrame, list[int]]:
    """u, its least neighbour (or itself) m, and the slots of the hubs among u."""
    m = F.least(F.min("v"), F.first("u")) if or_own else F.min("v")
    least = settled(edges.groupBy("u").agg(m.alias("m"), F.count("*").alias("n")), "least")
    return least, hot_slots(least, ["u"], total)


def _with_least(edges: DataFrame, least: DataFrame, hubs: list[int]) -> DataFrame:
    return dealt(edges, ["u"], "v", hubs).join(copied(least.select("u", "m"), ["u"], hubs), ["u", "salt"]).drop("salt")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) by alternating large-star and small-star rounds."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = settled(edges, "links")
    mark = lambda x: x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    before = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, hubs = _least(both, True, before.n)
        large = _with_least(both, least, hubs).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = settled(large, "large")
        lower, hubs = _least(large, False, before.n)
        joined = _with_least(large, lower, hubs)
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v"))).distinct()
        new = settled(small, "links")
        after = mark(new)
        discard(edges, least, large, lower)
        edges = new
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = after


def _parts(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members, each with the component of its links so far."""
    found = components(links)
    return members.join(found, members["doc_id"] == found["node"], "left").select(*members.columns, F.coalesce("component", "doc_id").alias("part"))


def near_duplicates(docs: DataFrame, words: int = WORDS, share: int = SHARE, weight: int = WEIGHT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each document, by shingles of ``words`` words and a similarity of ``share`` in 100."""
    prints = settled(fingerprints(docs, words), "sketches")
    full = prints.where("n_shingles > 0 and doc_id is not null")
    # Classes of equal sets; the smallest id stands for its class.
    same = ["n_shingles", "f1", "f2"]
    classes = full.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.count("*").alias("n"))
    classes = settled(classes, "classes")
    rows = settled(classes.select(F.col("rep").alias("doc_id"), "n_shingles", F.explode("bands").alias("bucket")), "bands")
    # Buckets with the same members count once.
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("held"), F.min("doc_id").alias("first"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("who")).where("n > 1")
    buckets = settled(buckets.groupBy("n", "who").agg(F.min("bucket").alias("bucket"), F.min("held").alias("held"), F.min("first").alias("first")).select("bucket", "held", "first"), "buckets")
    groups = max(1, math.ceil((buckets.where(F.col("held") <= weight).agg(F.sum("held")).first()[0] or 0) / weight))
    members = rows.join(buckets, "bucket")
    few = F.col("held") <= weight
    # Neighbouring classes of set size span any link.
    cls = F.floor(F.log("n_shingles") / F.log(F.lit(100 / share))).cast("long")
    group = F.pmod(F.xxhash64("first"), F.lit(groups)).alias("chunk")
    members = members.select("bucket", "doc_id", "n_shingles", group, F.when(few, F.lit(-1).cast("long")).otherwise(cls).alias("cls"))
    members = settled(members, "members")
    large = members.where("cls >= 0").drop("chunk")
    chunks = settled(large.groupBy("bucket", "cls").agg(F.ceil(F.sum("n_shingles") / F.lit(weight)).alias("chunks")), "chunks")
    large = large.join(chunks, ["bucket", "cls"]).select("bucket", "cls", "doc_id", "n_shingles", F.pmod(F.xxhash64("doc_id"), "chunks").alias("chunk"))
    small = members.where("cls < 0").groupBy("cls", "chunk", "doc_id").agg(F.collect_list("bucket").alias("buckets"))
    sets = settled(_member_sets(docs, members, words), "sets")
    columns = ["key", "cls", "chunk", "buckets", "doc_id"]
    small, lone = small.withColumn("key", F.lit(0).cast("long")).select(*columns), large.withColumns({"key": F.col("bucket"), "buckets": F.array("bucket")}).select(*columns)
    placed = small.unionByName(lone).join(sets, "doc_id")
    links = placed.groupBy("key", "cls", "chunk").applyInArrow(lambda table: _bucket_links(table, share), LINKS)
    links = settled(links, "links")
    if not chunks.isEmpty():
        more = settled(links.unionByName(_large_links(settled(large, "large"), chunks, sets, links, weight, share)), "links")
        discard(links)
        links = more
    found = components(links)
    discard(rows, buckets, members, chunks, sets, links)
    of_rep = classes.join(found, classes["rep"] == found["node"], "left").select(*same, "n", F.coalesce("component", "rep").alias("component_id"))
    hot = hot_slots(classes, same, full.count())
    linked_docs = dealt(full.select("doc_id", *same), same, "doc_id", hot).join(copied(of_rep.drop("n"), same, hot), [*same, "salt"]).select("doc_id", "n_shingles", "component_id")
    alone = prints.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked_docs.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _member_sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """doc_id and full shingle set of every class that shares a bucket.

    The texts are not shuffled: a bitmap of ``BITS`` bits, whatever the number of
    documents, marks the hashes of the wanted ids, and the few unwanted ids that
    hit a mark too find no partner in the joins that follow.
    """
    # Spark's bitmaps count from 1.
    marks = members.select((F.pmod(F.xxhash64("doc_id"), F.lit(BITS)) + 1).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    bitmap = np.zeros(BITS // 8, dtype=np.uint8)
    for row in marks.collect():
        at = (row.k - 1) * 4096
        bitmap[at : at + 4096] = np.frombuffer(row.bits, dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy()
            hit = shared.value[h >> 3] >> (h & 7).astype(np.uint8) & 1
            for part in slices([batch.filter(pa.array(hit.astype(bool)))]):
                own = [shingles(x, words).astype("<u8").tobytes() for x in bytes_of(part)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own, pa.binary())], names=["doc_id", "shingles"])

    ids = F.col("doc_id").cast("long")
    texts = docs.where("doc_id is not null").select(ids.alias("doc_id"), F.pmod(F.xxhash64(ids), F.lit(BITS)).alias("h"), "text")
    return texts.mapInArrow(read, "doc_id long, shingles binary").where(F.length("shingles") > 0)


def _large_links(large: DataFrame, chunks: DataFrame, sets: DataFrame, links: DataFrame, weight: int, share: int) -> DataFrame:
    """Links in large buckets between the largest part and all that is outside it, over the chunks of fitting size."""
    parts = settled(_parts(large, links), "parts")
    most = parts.groupBy("bucket", "part").count().groupBy("bucket").agg(F.max_by("part", F.struct("count", "part")).alias("most"))
    outside = parts.join(most, "bucket").where("part <> most").drop("most", "chunk")
    blocks = settled(outside.groupBy("bucket", "cls").agg(F.ceil(F.sum("n_shingles") / F.lit(weight)).alias("blocks")), "blocks")
    outside = outside.join(blocks, ["bucket", "cls"]).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(1)), "blocks"))
    near = lambda of: F.explode(F.sequence(F.col(of) - 1, F.col(of) + 1))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keys = ["bucket", "cls", "block", "other", "chunk"]
    probes = outside.withColumn("other", near("cls")).join(chunks.withColumnRenamed("cls", "other"), ["bucket", "other"]).withColumn("chunk", upto("chunks"))
    against = parts.withColumnRenamed("cls", "other").withColumn("cls", near("other")).join(blocks, ["bucket", "cls"]).withColumn("block", upto("blocks"))
    # New names' ids on either side: both come from the same tables.
    left, right = (x.join(sets, "doc_id").select(*(F.col(c).alias(c) for c in [*keys, "doc_id", "part", "shingles"])) for x in (probes, against))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda minor, chunk: _probe_links(minor, chunk, share), LINKS)


def keep_one(docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """The documents, all columns, with one row for each component: that of its smallest id.

    Rows that repeat an id and its text are copies, of which the one with the
    least other columns stays. An id that stands for several texts is none: each
    of its texts counts as a document of its own, behind those with an id of
    their own, so no text is dropped without a near copy that stays. Rows
    without an id link with nothing and stay.
    """
    text = F.xxhash64(F.coalesce("row.text", F.lit("")), F.col("row.text").isNull())
    # In a structure of their own, so that no column's name clashes.
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("kept_id"), F.struct(*(F.col(c) for c in docs.columns)).alias("row"))
    again = settled(own.groupBy("kept_id").agg(F.count("*").alias("n"), F.min(text).alias("a"), F.max(text).alias("b")).where("n > 1").select("kept_id", (F.col("a") != F.col("b")).alias("several")), "repeated")
    alone = docs.where("doc_id is null")
    if again.isEmpty():
        return own.join(_kept(own, words, share), "kept_id", "left_semi").select("row.*").unionByName(alone)
    # In the upper half of the positive numbers; 62 bits of hash tell the texts apart.
    new_id = F.xxhash64("kept_id", text).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    keyed = own.join(again, "kept_id", "left").select(F.when(F.col("several"), new_id).otherwise(F.col("kept_id")).alias("kept_id"), F.col("several").isNotNull().alias("repeats"), "row")
    keyed = settled(keyed, "keyed")
    left = keyed.join(_kept(keyed, words, share), "kept_id", "left_semi")
    plain = not any(isinstance(f.dataType, MapType) for f in docs.schema)
    once = left.where("repeats").groupBy("kept_id").agg((F.min("row") if plain else F.first("row")).alias("row"))
    return left.where("not repeats").select("row.*").unionByName(once.select("row.*")).unionByName(alone)


def _kept(own: DataFrame, words: int, share: int) -> DataFrame:
    return near_duplicates(own.select(F.col("kept_id").alias("doc_id"), F.col("row.text").alias("text")), words, share).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()


#: The same rows in SQL, over all pairs that share a shingle.
NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), listed AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS l FROM words
), shingles AS (SELECT DISTINCT doc_id, unnest(l) AS s FROM listed),
sizes AS (SELECT doc_id, len(list_distinct(l)) AS n FROM listed),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
half AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
links AS (SELECT x, y FROM half UNION ALL SELECT y, x FROM half),
reached AS (SELECT doc_id AS d, doc_id AS t FROM sizes UNION SELECT r.d, l.y FROM reached r JOIN links l ON r.t = l.x)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, min(r.t) AS component_id, min(r.t) = s.doc_id AS kept
FROM sizes s JOIN reached r ON r.d = s.doc_id GROUP BY s.doc_id, s.n
"""
