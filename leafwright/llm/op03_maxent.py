"""Language-model scores: a hashed maximum-entropy model with class-factored softmax.

The probability of a token is that of its class given the tokens before it,
times that of its leaf in the class given the same, times, in a leaf that many
words share, its share of that leaf's counts. The most frequent tokens are
classes of their own; the next ``FEATURED`` lie in classes by frequency, sized to
equal mass, with a leaf for each of a class's most frequent words and one for its
rest; all other words, seen or not, lie in classes by spelling (character pairs).
Both softmaxes sum hashed features: the three tokens before (an n-gram feature and
two skips), the pair of the last two, and their classes; those of the leaves are
hashed together with the class. They are trained by distributed gradient updates:
in each round every task runs AdaGrad over its documents from the shared weights,
and the tasks' changes are averaged by tokens in a stream, a slice of the table at
a time. Scoring is in sparse numpy batches.

Counts of at most ``HOT`` of the most frequent tokens, a bounded table, sit in every task.
All other tokens of a document go through one join with the full count table.

Defined results: a null or wordless text is its end token alone; with no
training rows N is 0 and every base term is log10(1); null ids and repeated rows
are kept, each row scored by itself; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, mix64, settled, slices

HOT = 100_000
#: Tokens that are features of their own; others are known by their class.
FEATURED = 8_192
SINGLES, BANDS, CLUSTERS, PAIRS = 8, 16, 8, 1024
CLASSES = SINGLES + BANDS + CLUSTERS
#: Leaves of a class; the last is that of all words without one of their own.
LEAVES = 32
REST = LEAVES - 1
TABLE = 1 << 14
FEATURES, LEAF_FEATURES = 5, 3
ROUNDS, STEP, BATCH = 3, 0.25, 16384
PIECES = 16
#: No word holds a space, so the end token is one.
END = b" "
SCORED = "row long, doc_id long, n_tokens long, n_known long, base double, score double, tail array<struct<word:string,cls:int,k:int>>"


def tokens_of(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]  # ASCII case and white space only


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64())], names=["word", "n"])
            own.clear()
            return out

        for batch in slices(batches):
            for text in bytes_of(batch):
                own.update(tokens_of(text))
            if len(own) > 400_000:
                yield flushed()
        yield flushed()

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Spelling:
    """Clusters of words by their character pairs: the centroid with the largest product wins."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids  # PAIRS x CLUSTERS

    @staticmethod
    def pairs(word: bytes) -> np.ndarray:
        c = np.frombuffer(b"\1" + word + b"\1", dtype=np.uint8).astype(np.uint32)
        return ((c[:-1] * np.uint32(256) + c[1:]) * np.uint32(2654435761) >> np.uint32(22)) % np.uint32(PAIRS)

    def clusters(self, words: list[bytes]) -> np.ndarray:
        """All words at once: their pairs' rows end to end, summed by word."""
        if not words:
            return np.empty(0, dtype=np.int64)
        sizes = np.array([len(w) + 1 for w in words])
        c = np.frombuffer(b"\1" + b"\1".join(words) + b"\1", dtype=np.uint8).astype(np.uint32)
        pairs = ((c[:-1] * np.uint32(256) + c[1:]) * np.uint32(2654435761) >> np.uint32(22)) % np.uint32(PAIRS)
        return np.add.reduceat(self.centroids[pairs], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0).argmax(axis=1)

    @classmethod
    def fit(cls, words: list[bytes], steps: int = 12, seed: int = 5) -> Spelling:
        rng = np.random.default_rng(seed)
        x = np.zeros((max(1, len(words)), PAIRS), dtype=np.float32)
        for k, w in enumerate(words):
            np.add.at(x[k], cls.pairs(w), 1)
        x /= np.maximum(1e-9, np.sqrt((x**2).sum(axis=1, keepdims=True)))
        centres = x[rng.choice(len(x), CLUSTERS, replace=len(x) < CLUSTERS)]
        for _ in range(steps):
            near = (x @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            norm = np.sqrt((sums**2).sum(axis=1, keepdims=True))
            centres = np.where(norm > 0, sums / np.maximum(norm, 1e-9), centres)
        return cls(np.ascontiguousarray(centres.T))


@dataclass
class Vocabulary:
    """The hot words with their classes and leaves; a worker builds its reader once."""

    hot: list[bytes]
    spelling: np.ndarray
    places: tuple[np.ndarray, np.ndarray]
    made: Reader | None = None

    def reader(self) -> Reader:
        if self.made is None:
            self.made = Reader(self.hot, self.spelling, self.places)
        return self.made


@dataclass
class Model(Vocabulary):
    counts: np.ndarray | None = None
    tokens: int = 0
    distinct: int = 0
    rest_tokens: np.ndarray | None = None
    rest_words: np.ndarray | None = None
    weights: np.ndarray | None = None
    leaf_weights: np.ndarray | None = None


def classed_words(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and leaf of the first ``FEATURED`` hot words, most frequent first: single ones, then classes of equal mass."""
    n = min(len(sizes), FEATURED)
    mass = np.cumsum(sizes[SINGLES:n])
    band = np.minimum(BANDS - 1, (mass - sizes[SINGLES:n] / 2) * BANDS // max(1, mass[-1] if len(mass) else 1)).astype(np.int64)
    cls = np.concatenate([np.arange(min(n, SINGLES)), SINGLES + np.maximum.accumulate(band)]) if n > SINGLES else np.arange(n)
    first = np.searchsorted(cls, cls)
    return cls, np.minimum(np.arange(n) - first, REST)


def leaf_mask(places: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Classes x leaves: 0 where there is such a leaf. Classes by spelling have the last alone."""
    out = np.full((CLASSES, LEAVES), -1e9, dtype=np.float32)
    out[SINGLES + BANDS :, REST] = 0
    out[places] = 0
    return out


class _Numbers(dict):
    """Numbers of words; one that has none gets the next and is remembered as new."""

    def __init__(self):
        super().__init__()
        self.next, self.new = 0, []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = self.next
        self.next += 1
        self.new.append(word)
        return number


class Reader:
    """Turns texts into token numbers and their features; words beyond the hot ones get numbers for a while."""

    def __init__(self, hot: list[bytes], spelling: np.ndarray, places: tuple[np.ndarray, np.ndarray], spare: int = 200_000):
        self.hot, self.spelling, self.places, self.spare = hot, Spelling(spelling), places, spare
        self.numbers = _Numbers()
        # Marks are few, so what is hashed of one alone is looked up.
        marks = np.arange(CLASSES + 2 + min(FEATURED, len(hot)), dtype=np.uint64)
        self.first, self.second, self.third, self.paired = mix64(marks, 20), mix64(marks, 21), mix64(marks, 22), mix64(marks, 31)
        self.slots = [_slot(x) for x in (self.first, self.second, self.third)]
        self.class_pairs = _slot(mix64(np.arange(CLASSES * CLASSES, dtype=np.uint64), 30))
        self._fill()

    def _fill(self) -> None:
        self.words: list[bytes] = []
        self.numbers.clear()
        # Number 0 is what stands before a text.
        self.cls, self.leaf, self.mark = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.words.append(b"")
        self._add(self.hot)

    def _add(self, words: list[bytes]) -> None:
        """Numbers for words that have none."""
        self.numbers.update(zip(words, range(len(self.words), len(self.words) + len(words))))
        self._numbered(words)

    def _numbered(self, words: list[bytes]) -> None:
        """Class, leaf and mark of the words that were numbered last."""
        first = len(self.words)
        cls = SINGLES + BANDS + self.spelling.clusters(words)
        leaf = np.full(len(words), REST)
        if first == 1:
            n = len(self.places[0])
            cls[:n], leaf[:n] = self.places
        number = np.arange(first, first + len(words))
        # A frequent token is its own feature, another one that of its class.
        mark = np.where(number <= min(FEATURED, len(self.hot)), CLASSES + 1 + number, 1 + cls)
        self.cls, self.leaf, self.mark = np.concatenate([self.cls, cls]), np.concatenate([self.leaf, leaf]), np.concatenate([self.mark, mark])
        self.words += words

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token numbers of all texts end to end, their features (tokens x FEATURES), and where each text starts.

        Numbers 1 to len(hot) are the hot tokens in order.
        """
        if len(self.words) > len(self.hot) + self.spare:
            self._fill()
        tokens = [tokens_of(t) for t in texts]
        sizes = np.array([len(t) for t in tokens])
        every = list(chain.from_iterable(tokens))
        self.numbers.next = len(self.words)
        ids = np.fromiter(map(self.numbers.__getitem__, every), dtype=np.int64, count=len(every))
        if len(self.numbers.new):
            self._numbered(self.numbers.new)
            self.numbers.new = []
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])

        def before(own: np.ndarray, k: int) -> np.ndarray:
            """What stands k places before; 0 where the text is not that long."""
            out = np.zeros_like(own)
            out[k:] = own[:-k]
            for j in range(k):
                at = starts + j
                out[at[j < sizes]] = 0
            return out

        marks, classes = self.mark[ids], self.cls[ids]
        m1, m2, m3 = (before(marks, k) for k in (1, 2, 3))
        pair = mix64(m1.astype(np.uint64) ^ self.paired[m2], 32)
        seen = [self.slots[0][m1], self.slots[1][m2], self.slots[2][m3], _slot(pair), self.class_pairs[before(classes, 1) * CLASSES + before(classes, 2)]]
        return ids, np.stack(seen, axis=1), np.stack([self.first[m1], self.second[m2], pair], axis=1), starts


def _slot(hashed: np.ndarray) -> np.ndarray:
    return (hashed % np.uint64(TABLE)).astype(np.uint16)


def leaf_slots(hashed: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Slots of the features that choose among a class's leaves."""
    return _slot(mix64(hashed ^ mix64(classes.astype(np.uint64), 40)[:, None], 41))


def _scores(weights: np.ndarray, features: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """The summed rows of the tokens' features, held to what has a finite exponential."""
    columns = np.ascontiguousarray(features.T).astype(np.intp)
    score = np.take(weights, columns[0], axis=0, mode="clip")
    more = np.empty_like(score)
    for column in columns[1:]:
        score += np.take(weights, column, axis=0, mode="clip", out=more)
    if mask is not None:
        score += mask
    np.clip(score, -80, 80, out=score)
    return score


def softmax(weights: np.ndarray, features: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Probabilities, tokens x outcomes; ``mask`` is added to the scores."""
    score = _scores(weights, features, mask)
    np.exp(score, out=score)
    score *= (1 / (score @ np.ones(score.shape[1], dtype=score.dtype)))[:, None]
    return score


def log_of(weights: np.ndarray, features: np.ndarray, outcomes: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Natural log probability of each token's outcome."""
    score = _scores(weights, features, mask)
    own = score[np.arange(len(outcomes)), outcomes]
    np.exp(score, out=score)
    return own - np.log(score @ np.ones(score.shape[1], dtype=score.dtype))


def ascend(weights: np.ndarray, squares: np.ndarray, features: np.ndarray, outcomes: np.ndarray, mask: np.ndarray | None = None, step: float = STEP) -> None:
    """One AdaGrad step on a batch, in place."""
    gap = softmax(weights, features, mask)
    gap[np.arange(len(outcomes)), outcomes] -= 1
    # Each row's gradient: what its tokens gave, summed row by row.
    rows, width = features.ravel(), features.shape[1]
    order = np.argsort(rows, kind="stable")
    ranked = rows[order]
    starts = np.flatnonzero(np.diff(ranked.astype(np.int32), prepend=-1))
    order //= width
    total, touched = np.add.reduceat(np.take(gap, order, axis=0, mode="clip"), starts, axis=0), ranked[starts]
    seen = np.square(total)
    seen += squares[touched]
    squares[touched] = seen
    seen += np.float32(1e-3)
    np.sqrt(seen, out=seen)
    total *= -step
    total /= seen
    weights[touched] += total


def _updates(docs: DataFrame, vocabulary: Broadcast, weights: np.ndarray, leaf_weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights after one round: the tasks' changes, averaged by their tokens."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, leaf_weights))
    both = np.concatenate([weights, leaf_weights], axis=1)
    size = TABLE // PIECES

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, leaf_start = shared.value
        reader, own, leaf_own, seen = vocabulary.value.reader(), start.copy(), leaf_start.copy(), 0
        squares, leaf_squares, mask = np.zeros_like(start), np.zeros_like(leaf_start), leaf_mask(reader.places)
        chosen = (mask == 0).sum(axis=1) > 1
        for batch in slices(batches):
            ids, features, hashed, _ = reader.read(bytes_of(batch))
            for at in range(0, len(ids), BATCH):
                part = ids[at : at + BATCH]
                classes = reader.cls[part]
                ascend(own, squares, features[at : at + BATCH], classes)
                some = np.flatnonzero(chosen[classes])
                if len(some):
                    ascend(leaf_own, leaf_squares, leaf_slots(hashed[at : at + BATCH][some], classes[some]), reader.leaf[part[some]], mask[classes[some]])
            seen += len(ids)
        if seen:
            change = np.concatenate([own - start, leaf_own - leaf_start], axis=1).astype(np.float16).reshape(PIECES, -1)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(range(PIECES), pa.int32()), "n": pa.array([seen] * PIECES, pa.int64()), "change": pa.array([c.tobytes() for c in change], pa.binary())})

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A stream: one sum for each slice of the table, however many tasks there were.
        sums: dict[int, list] = {}
        for batch in batches:
            for piece, n, change in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = sums.setdefault(piece, [0, np.zeros(size * both.shape[1])])
                own[0] += n
                own[1] += n * np.frombuffer(change, dtype=np.float16).astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_pydict({"piece": pa.array(list(sums), pa.int32()), "n": pa.array([s[0] for s in sums.values()], pa.int64()), "change": pa.array([s[1].astype(np.float32).tobytes() for s in sums.values()], pa.binary())})

    kind = "piece int, n long, change binary"
    summed = docs.select("text").mapInArrow(climb, kind).repartition(PIECES, "piece").mapInArrow(add_up, kind)
    new = both.copy().reshape(PIECES, -1)
    for row in summed.collect():  # PIECES rows, TABLE x (CLASSES + LEAVES) numbers in all
        new[row.piece] += np.frombuffer(row.change, dtype=np.float32) / row.n
    new = new.reshape(both.shape)
    return np.ascontiguousarray(new[:, :CLASSES]), np.ascontiguousarray(new[:, CLASSES:])


def _most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent words, cut above the first level of counts (1/64 octave) with which they would be over ``most``.

    No task sends a top list of its own, so what reaches the driver does not grow with the tasks.
    """
    level = F.floor(F.log2("n") * 64)
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()  # at most 64 levels for each bit of a count
    least, held = 1 << 62, 0
    for row in sorted(sizes, key=lambda r: -r.level):
        held += row.words
        if held > most:
            break
        least = row.level
    return counts.where(level >= F.lit(least))


def train(docs: DataFrame, rounds: int = ROUNDS, hot: int = HOT) -> tuple[Model, DataFrame]:
    """The model and the full count table (word, n) of the training documents.

    Every training document is counted, and read by one of the rounds.
    """
    counts = settled(word_counts(docs), "word-counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = sorted(_most_frequent(counts, hot).collect(), key=lambda r: (-r.n, r.word))  # at most HOT rows
    words, sizes = [r.word.encode() for r in top], [r.n for r in top]
    if END not in words:
        words, sizes = [*words, END], [*sizes, 0]
    spelling = Spelling.fit([w for w in words[:FEATURED] if w != END]).centroids
    places = classed_words(np.array(sizes, dtype=np.float64))
    shared = docs.sparkSession.sparkContext.broadcast((words[: len(places[0])], spelling, places))

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, centroids, (cls, leaf) = shared.value
        known, clusters = dict(zip(named, range(len(named)))), Spelling(centroids).clusters
        tokens, distinct = np.zeros(CLASSES, dtype=np.int64), np.zeros(CLASSES, dtype=np.int64)
        for batch in batches:
            words, n = bytes_of(batch, "word"), batch.column("n").to_numpy()
            own = SINGLES + BANDS + clusters(words)
            counted = np.ones(len(words), dtype=bool)
            for k, w in enumerate(words):
                if (at := known.get(w)) is not None:
                    own[k], counted[k] = cls[at], leaf[at] == REST
            np.add.at(tokens, own[counted], n[counted])
            np.add.at(distinct, own[counted], 1)
        yield pa.RecordBatch.from_pydict({"cls": pa.array(range(CLASSES), pa.int32()), "n": tokens, "v": distinct})

    sums = counts.mapInArrow(classed, "cls int, n long, v long").groupBy("cls").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()  # CLASSES rows
    rest_tokens, rest_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sums:
        rest_tokens[r.cls], rest_words[r.cls] = r.n, r.v
    weights, leaf_weights = np.zeros((TABLE, CLASSES), dtype=np.float32), np.zeros((TABLE, LEAVES), dtype=np.float32)
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(words, spelling, places))
    for k in range(rounds if n else 0):
        own = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == k)
        weights, leaf_weights = _updates(own, vocabulary, weights, leaf_weights)
    return Model(words, spelling, places, None, np.array(sizes, dtype=np.float64), int(n), int(v), rest_tokens, rest_words, weights, leaf_weights), counts


def score(docs: DataFrame, trained: tuple[Model, DataFrame]) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each whole text."""
    model, counts = trained
    shared = docs.sparkSession.sparkContext.broadcast(model)
    in_all = model.tokens + 0.5 * (model.distinct + 1)
    in_rest = model.rest_tokens + 0.5 * (model.rest_words + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        reader, row = own.reader(), TaskContext.get().partitionId() << 40
        n_hot = len(own.hot)
        counts = np.concatenate([[0], own.counts])
        base_of = np.log10((counts + 0.5) / in_all)
        in_leaf = reader.leaf[: n_hot + 1] == REST
        word_of = np.where(in_leaf, np.log10((counts + 0.5) / in_rest[reader.cls[: n_hot + 1]]), 0)
        mask = leaf_mask(own.places)
        chosen = (mask == 0).sum(axis=1) > 1
        for batch in slices(batches, 64):
            ids, features, hashed, starts = reader.read(bytes_of(batch))
            classes, hot, n = reader.cls[ids], ids <= n_hot, len(starts)
            by_class = np.empty(len(ids))
            for at in range(0, len(ids), BATCH):
                here = classes[at : at + BATCH]
                by_class[at : at + BATCH] = log_of(own.weights, features[at : at + BATCH], here)
                some = np.flatnonzero(chosen[here])
                if len(some):
                    by_class[at + some] += log_of(own.leaf_weights, leaf_slots(hashed[at : at + BATCH][some], here[some]), reader.leaf[ids[at : at + BATCH][some]], mask[here[some]])
            number = np.where(hot, ids, 0)
            scores = np.add.reduceat(by_class / np.log(10) + np.where(hot, word_of[number], 0), starts)
            bases = np.add.reduceat(np.where(hot, base_of[number], 0), starts)
            known = np.add.reduceat(hot & (counts[number] > 0), starts, dtype=np.int64)
            sizes = np.diff([*starts, len(ids)])
            # All other tokens, by document and word.
            width = len(reader.words)
            rare, k = np.unique((np.repeat(np.arange(n), sizes) * width + ids)[~hot], return_counts=True)
            words = pa.array([reader.words[i] for i in (rare % width).tolist()], pa.binary()).cast(pa.string())
            fields = [words, pa.array(reader.cls[rare % width], pa.int32()), pa.array(k, pa.int32())]
            ends = np.searchsorted(rare // width, np.arange(n + 1)).astype(np.int32)
            tails = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, names=["word", "cls", "k"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), batch.column("doc_id"), pa.array(sizes), pa.array(known), pa.array(bases), pa.array(scores), tails],
                names=["row", "doc_id", "n_tokens", "n_known", "base", "score", "tail"],
            )
            row += n

    rows = settled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED), "scored")
    classes = F.array(*(F.lit(float(x)) for x in in_rest))
    rare = rows.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.cls", "t.k").join(counts, "word", "left")
    seen = F.coalesce("n", F.lit(0))
    rare = rare.groupBy("row").agg(
        F.sum(F.when(seen > 0, F.col("k")).otherwise(0)).alias("known2"),
        F.sum(F.col("k") * F.log10((seen + 0.5) / F.lit(float(in_all)))).alias("base2"),
        F.sum(F.col("k") * F.log10((seen + 0.5) / F.element_at(classes, F.col("cls") + 1))).alias("score2"),
    )
    zero = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias
    return rows.drop("tail").join(rare, "row", "left").select(
        "doc_id", "n_tokens", zero("n_known", "known2")("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), zero("base", "base2")("base_score"), zero("score", "score2")("score")
    )
