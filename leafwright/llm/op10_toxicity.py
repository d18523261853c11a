"""Toxicity: a lexicon found misspelled too, and scored by its context.

The lexicon is learned: words and word beginnings whose documents are nearly
always labelled toxic. It becomes a trie, and a Levenshtein automaton of one
edit (a letter too many, missing or wrong, or two neighbours swapped, at any
place of any term) runs over the trie and the token at once; the states of this
product are built when first met and kept within a bound, so a token costs a few
look-ups and a known token one. Hits are of four kinds: exact, and with an edit
in a long term, a beginning or a short term, each with weights of its own. The
context of a hit tells quotation (quote marks, whose state is carried through
the line, and reporting words near it) from abuse (address in the second
person near it). A logistic regression over the counts of hits by kind and
context gives the score.

Terms are words of more than two letters and of letters alone; a spelling with a digit or
sign is no term, but is met where it is one edit from one.

Bounds: ``train_docs`` labelled documents (a share by hash of the id), a
parameter. The lexicon has no cap of its own: a term stands in half a percent of
the toxic documents at least, so there are at most 200 for each distinct word and
beginning of a mean one.

Defined results: null and empty texts score as texts without hits; without any
labelled row every score is 0; a document labelled more than once counts as
toxic if any label says so; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Known, discard, each_text, settled, slices, texts_of

TRAIN_DOCS = 30_000
WINDOW = 6
#: Word beginnings of these lengths can be lexicon entries.
STEMS = (4, 5, 6)
#: Terms of fewer letters are short: with an edit they are a kind of their own.
LONG_FROM = 5
EXACT, LONG, STEM, SHORT = 1, 2, 3, 4
KINDS = 4
QUOTES = "\"“”„«»‹›"
EDGE = QUOTES + "'’‘.,!?;:()[]{}<>|*#$%&~_-+=/\\"
REPORTING = frozenset(("said", "says", "say", "called", "calling", "quote", "quoted", "quotes", "word", "term", "wrote", "written", "dit", "appelé", "mot", "sagte", "nannte", "wort", "dijo", "llamó", "palabra"))
ADDRESS = frozenset(("you", "your", "you're", "ur", "u", "yourself", "tu", "toi", "vous", "du", "dich", "dein", "ihr", "tú", "usted", "eres"))


class Matcher:
    """The lexicon's trie intersected with the automaton of at most one edit, anywhere."""

    def __init__(self, words: list[str], stems: list[str], most_states: int = 8_000):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[int] = [0]  # the kind of an edited hit where a word ends
        self.stem: list[bool] = [False]
        for term, is_stem in [*((w, False) for w in words), *((s, True) for s in stems)]:
            node = 0
            for c in term:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(0)
                    self.stem.append(False)
                node = nxt
            if is_stem:
                self.stem[node] = True
            else:
                self.word[node] = LONG if len(term) >= LONG_FROM else SHORT
        self.most = most_states
        self._reset()

    def _reset(self) -> None:
        #: Members are (node, edits, letter): with a letter, that one must come next to end a swap.
        self.states: list[frozenset] = []
        self.numbers: dict[frozenset, int] = {}
        self.accepts: list[tuple[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self._number(self._closed({(0, 0, "")}))

    def _number(self, state: frozenset) -> int:
        k = self.numbers.get(state)
        if k is None:
            k = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            ends = [(n, e) for n, e, last in state if not last]
            whole = min((EXACT if not e else self.word[n] for n, e in ends if self.word[n]), default=0)
            begun = min((EXACT if not e else STEM for n, e in ends if self.stem[n]), default=0)
            self.accepts.append((whole, begun))
        return k

    def _closed(self, reached: set) -> frozenset:
        reached |= {(n, 1, "") for node, edits, _ in reached if not edits for n in self.children[node].values()}  # a letter missing
        return frozenset(x for x in reached if not x[1] or x[2] or (x[0], 0, "") not in reached)

    def _step(self, state: frozenset, c: str) -> frozenset:
        reached = set()
        for node, edits, last in state:
            if last:
                if c == last:
                    reached.add((node, 1, ""))
                continue
            child = self.children[node].get(c)
            if child is not None:
                reached.add((child, edits, ""))
            if not edits:
                reached.add((node, 1, ""))  # a letter too many
                for letter, n in self.children[node].items():
                    reached.add((n, 1, ""))  # a wrong letter
                    end = self.children[n].get(c)
                    if end is not None and letter != c:
                        reached.add((end, 1, letter))  # the second letter first
        return self._closed(reached)

    def match(self, token: str) -> int:
        """The best kind of hit, 0 for none: a term, or a beginning of the token, as it is or with one edit."""
        if len(self.states) > self.most:
            self._reset()
        at, found = 0, self.accepts[0][1]
        for c in token:
            nxt = self.moves[at].get(c)
            if nxt is None:
                nxt = self.moves[at][c] = self._number(self._step(self.states[at], c))
            at = nxt
            begun = self.accepts[at][1]
            if begun == EXACT:
                return EXACT
            found = found or begun
            if not self.states[at]:
                return found
        whole = self.accepts[at][0]
        return min(whole, found) if whole and found else whole or found


@dataclass
class Model:
    words: list[str]
    stems: list[str]
    weights: list[float]


class Scorer:
    def __init__(self, words: list[str], stems: list[str]):
        self.matcher = Matcher(words, stems)
        self.known = Known(self._code)

    def _code(self, raw: str) -> int:
        """0 for most tokens; else the kind of hit."""
        token = raw.strip(EDGE)
        return self.matcher.match(token) if token else 0

    def features(self, text: str) -> list[float]:
        """Hits by kind, each as abuse, neutral and quotation; all on a log scale."""
        out = [0.0] * (3 * KINDS)
        for line in text.lower().splitlines():
            tokens = line.split()
            codes = np.fromiter(map(self.known.__getitem__, tokens), dtype=np.int8, count=len(tokens))
            hits = np.flatnonzero(codes)
            if not len(hits):
                continue
            inside = quoted_tokens(tokens) if any(q in line for q in QUOTES) else None
            for at in hits:
                near = {t.strip(EDGE) for t in tokens[max(0, at - WINDOW) : at + WINDOW + 1]}
                marks = inside is not None and inside[at]
                quoted = marks or bool(near & REPORTING)
                context = 0 if near & ADDRESS and not marks else 2 if quoted else 1
                out[3 * (int(codes[at]) - 1) + context] += 1
        return [float(np.log1p(x)) for x in out]


def quoted_tokens(tokens: list[str]) -> list[bool]:
    """Which tokens of a line stand in, or touch, quote marks; a mark that is never closed counts to the line's end."""
    out, depth, plain = [], 0, False
    for token in tokens:
        touched = depth > 0 or plain
        for c in token:
            if c == '"':
                plain, touched = not plain, True
            elif c in "“„«‹":
                depth, touched = depth + 1, True
            elif c in "”»›":
                depth, touched = max(0, depth - 1), True
        out.append(touched)
    return out


#: Where the labels say nothing: exact hits count, edited ones less, quoted ones hardly.
PRIOR = np.array([-3.0, 3.0, 2.5, 0.5, 1.5, 1.0, 0.2, 1.5, 1.0, 0.2, 0.7, 0.4, 0.1])


def fit_weights(x: np.ndarray, y: np.ndarray, strength: float = 0.05, steps: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards ``PRIOR``."""
    x = np.column_stack([np.ones(len(x)), x])
    w = PRIOR.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + strength * (w - PRIOR)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        move = np.linalg.solve(hessian, gradient)
        w = w - move / max(1.0, np.abs(move).max())
        if np.abs(move).max() < 1e-6:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, text, toxic of the training sample."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    own = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = settled(own.select("doc_id").distinct().join(marks, "doc_id"), "labelled")
    n = both.count()
    if n > train_docs:
        # A share by hash, nine tenths of what is allowed, so that the limit hardly ever cuts and no task sends a list of its own best.
        both = both.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * 0.9 * train_docs / n)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    return own.join(F.broadcast(both), "doc_id")  # at most train_docs ids


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model | None:
    """The lexicon and the weights, from labelled documents alone."""
    # Copies count once, else what a copied text says by chance looks like a term.
    sample = settled(labelled(docs, labels, train_docs).groupBy("text").agg((F.max("toxic") > 0).alias("toxic")), "sample")
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(True, 0), sizes.get(False, 0)
    if not bad + good:
        discard(sample)
        return None
    counts = sample.mapInArrow(_term_counts, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    # Nearly all documents of a term are toxic, far beyond the labels' share, and there are several.
    sure = (F.col("bad") >= max(4, round(0.005 * bad))) & (F.col("bad") >= 12 * (F.col("good") + 0.25) * max(1.0, bad / max(good, 1)))
    rows = counts.where(sure).select("term").collect()
    words = sorted(r.term for r in rows if r.term[-1] != "*")
    stems = sorted(r.term[:-1] for r in rows if r.term[-1] == "*")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(words, stems)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([scorer.features(t) for t in texts_of(batch)], pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])

    got = sample.mapInArrow(features, "x array<double>, toxic boolean").collect()  # train_docs rows of twelve numbers
    discard(sample)
    weights = fit_weights(np.array([r.x for r in got]), np.array([float(r.toxic) for r in got]))
    return Model(words, stems, weights.tolist())


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other documents each word and each word beginning stands."""
    bad, good = Counter(), Counter()

    def flushed() -> pa.RecordBatch:
        names = list(bad.keys() | good.keys())
        # Typed, as a last flush may have no names.
        out = pa.RecordBatch.from_pydict({"term": pa.array(names, pa.string()), "bad": pa.array([bad[t] for t in names], pa.int64()), "good": pa.array([good[t] for t in names], pa.int64())})
        bad.clear()
        good.clear()
        return out

    for batch in slices(batches):
        for text, toxic in zip(texts_of(batch), batch.column("toxic").to_pylist()):
            own = {w.strip(EDGE) for w in text.lower().split()}
            own = {w for w in own if len(w) > 2 and w.isalpha()}
            own |= {w[:n] + "*" for w in own for n in STEMS if len(w) > n}
            (bad if toxic else good).update(own)
        if len(bad) + len(good) > 400_000:
            yield flushed()
    yield flushed()


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score and predicted for each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = rater(shared.value)
        for batch in slices(batches):
            p = [rate(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def rater(model: Model | None):
    if model is None:
        return lambda text: 0.0
    scorer, weights = Scorer(model.words, model.stems), np.array(model.weights)
    return lambda text: float(1 / (1 + np.exp(-np.clip(weights[0] + np.dot(weights[1:], scorer.features(text)), -30, 30))))


def drop_toxic(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, that score below the threshold; only texts leave the JVM."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rate = rater(shared.value)
        for batch in texts:
            yield pa.array([rate(t) < threshold for t in each_text(batch)], pa.bool_())

    return docs.where(clean("text"))
