"""Personal data: four patterns, and a linear-chain conditional random field.

The patterns find e-mail addresses, IP addresses, card and phone numbers; they
are written so that a long run of digits or letters costs linear time. The field
adds what they miss: secrets, phone numbers without a plus sign, addresses
spelt with other signs. It decodes every token of every text. Its
features are word shapes, of the token and its neighbours, and it is trained by
gradient ascent on a small labelled table of tokens. Sequences of many documents
are decoded together, one Viterbi step for all of them at a time, in numpy.
A text of more than ``STRETCH`` tokens is decoded in stretches that overlap by
``OVERLAP`` tokens, and passes from one to the next where both say outside.

Defined results: a null text is empty; texts without findings have zero counts
and the hash of the empty string; spans of the field that meet a pattern's span
are dropped; positions are code points; null ids and repeated rows are kept;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, Known, slices, texts_of

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
STRETCH, OVERLAP = 384, 64

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match never starts inside a run of digits: what fails at its start fails in it.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, by kind and then start."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            out.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# --- the field ---------------------------------------------------------------

_TOKEN = re.compile(r"[\w@.+=\-]+|[^\w\s]")


def shape(token: str) -> str:
    """The word's shape: runs of letters by case, digits by length, other signs as they are."""
    out = re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 5)}", re.sub(r"[^\W\d_]+", lambda m: "x" if m[0].islower() else "X" if m[0].isupper() else "Xx", token))
    return out if len(out) <= 16 else out[:6] + "~" + str(min(len(out) // 8, 4))


def token_features(token: str) -> tuple[str, ...]:
    plain = token.strip(".+=-")
    digits = sum(c.isdigit() for c in plain)
    signs = "".join(sorted({c for c in plain if not c.isalnum()}))
    tail = plain.rpartition("=")[2]
    head = plain.lower().partition("=")[0]
    return (
        f"s:{shape(plain)}",
        f"c:{signs}|{min(digits, 20) // 4}|{min(len(plain), 48) // 6}",
        f"h:{len(tail) >= 14 and all(c in '0123456789abcdef' for c in tail) and digits > 0}",
        f"m:{plain.isalnum() and plain.isupper() and digits > 0 and len(plain) >= 16}",
        f"l:{plain.isdigit() and 13 <= len(plain) <= 19 and luhn(plain)}",
        f"w:{cue_of(token) or ''}",
        f"k:{head if '=' in plain and head in _CUE else ''}",
        f"v:{bool(tail) and tail != plain and len(tail) >= 6}",
    )


#: Words that are features of their own, and in pairs; all others are known by their shape.
CUES = ("at", "dot", "com", "org", "net", "password", "passwd", "secret", "token", "key", "api_key", "tel", "fax", "phone", "call", "card", "write", "mail", "contact", "(", ")", "is", "was", "=", ":", '"')
_CUE = {w: k + 1 for k, w in enumerate(CUES)}
_EDGE = ".+=-"


def cue_of(token: str) -> int:
    """The number of a cue word, 0 for all others."""
    return _CUE.get(token if len(token) == 1 else token.strip(_EDGE).lower(), 0)


class Field:
    """Weights of a trained field, and its decoder."""

    def __init__(self, weights: dict[str, np.ndarray], moves: np.ndarray):
        self.weights, self.moves = weights, moves
        self.zero = np.zeros(len(LABELS))
        n = len(CUES) + 1
        self.pairs = np.zeros((n, n, len(LABELS)))
        for x in range(n):
            for y in range(n):
                self.pairs[x, y] = weights.get(f"p:{x}|{y}", self.zero)
        self._forget()
        #: An inside label follows only its own begin or inside label.
        self.allowed = np.where([[b[0] != "I" or a[1:] == b[1:] for b in LABELS] for a in LABELS], moves, -1e9)
        self.first = np.where([x[0] == "I" for x in LABELS], -1e9, 0.0)

    def _forget(self) -> None:
        """Tokens met so far have rows in a table, one for all tokens with the same features; both are bounded."""
        self.rows: dict[tuple, int] = {}
        self.table, self.cues = np.zeros((1024, 3, len(LABELS))), np.zeros(1024, dtype=np.int64)
        self.known = Known(self._row, 8 << 20)

    def _row(self, token: str) -> int:
        plain = token.strip(_EDGE)
        cue = cue_of(token)
        if plain.isalpha() and not cue:
            # All such words of one case and length class have the same features.
            key = (0 if plain.islower() else 1 if plain.isupper() else 2, min(len(plain), 48) // 6, token.replace(plain, "", 1), len(plain) > 16, len(token) > 16)
        else:
            key = (*token_features(token), shape(token), cue)
        row = self.rows.get(key)
        if row is None:
            row = self.rows[key] = len(self.rows)
            if row == len(self.table):
                self.table, self.cues = np.concatenate([self.table, np.zeros_like(self.table)]), np.concatenate([self.cues, np.zeros_like(self.cues)])
            get, s = self.weights.get, shape(token)
            own = sum((get(f, self.zero) for f in token_features(token)), self.zero)
            # What a token says about itself, its left and its right neighbour.
            self.table[row] = own, get(f"+:{s}", self.zero), get(f"-:{s}", self.zero)
            self.cues[row] = cue
        return row

    def emissions(self, tokens: list[str]) -> np.ndarray:
        rows = np.fromiter(map(self.known.__getitem__, tokens), dtype=np.int64, count=len(tokens))  # at least one
        said, cues = self.table[rows], self.cues[rows]
        out = said[:, 0].copy()
        out[:-1] += said[1:, 1]
        out[1:] += said[:-1, 2]
        at = np.flatnonzero((cues[:-2] > 0) & (cues[1:-1] > 0))
        out[at + 2] += self.pairs[cues[at], cues[at + 1]]
        return out

    def labels(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The labels of every token of every text."""
        step = STRETCH - OVERLAP
        cut = [[t] if len(t) <= STRETCH else [t[at : at + STRETCH] for at in range(0, len(t) - OVERLAP, step)] for t in texts]
        found, out = iter(self.decode([x for parts in cut for x in parts])), []
        for parts in cut:
            own = next(found)
            for k in range(1, len(parts)):
                nxt, at = next(found), k * step
                both = np.flatnonzero((own[at:] == 0) & (nxt[: len(own) - at] == 0))
                here = int(both[np.abs(both - OVERLAP // 2).argmin()]) if len(both) else OVERLAP // 2
                own = np.concatenate([own[: at + here], nxt[here:]])
            out.append(own)
        return out

    def decode(self, windows: list[list[str]], batch: int = 1024) -> list[np.ndarray]:
        """Best label sequences; windows of like length go through Viterbi together."""
        if len(self.rows) > 30_000:
            self._forget()
        found: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * len(windows)
        order = sorted((k for k, w in enumerate(windows) if w), key=lambda k: len(windows[k]))
        labels = len(LABELS)
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            sizes = np.array([len(windows[k]) for k in own])
            steps, n = int(sizes[-1]), len(own)
            score = np.zeros((steps, labels, n), dtype=np.float32)
            for j, k in enumerate(own):
                score[: sizes[j], :, j] = self.emissions(windows[k])
            best, back = score[0] + self.first.astype(np.float32)[:, None], np.zeros((steps, labels, n), dtype=np.int8)
            moves, last, rows = self.allowed.astype(np.float32)[:, :, None], best.copy(), np.arange(n)
            for t in range(1, steps):
                # Sequences are sorted by length: those that have ended stand in front.
                live = slice(int(np.searchsorted(sizes, t, side="right")), None)
                before, way = best[:, live], back[t, :, live]
                new = before[0] + moves[0]
                for y in range(1, labels):
                    path = before[y] + moves[y]
                    better = path > new
                    np.copyto(new, path, where=better)
                    np.copyto(way, np.int8(y), where=better)
                best[:, live] = new + score[t, :, live]
                last[:, live] = best[:, live]
            label = last.argmax(axis=0)
            out = np.zeros((steps, n), dtype=np.int64)
            for t in range(steps - 1, -1, -1):
                out[t] = label
                label = np.where(t < sizes, back[t][label, rows], label)
            for j, k in enumerate(own):
                found[k] = out[: sizes[j], j]
        return found


def all_spans(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """For each text the patterns' spans, and all spans."""
    base = [base_spans(t) for t in texts]
    added: dict[int, list] = defaultdict(list)
    for k, labels in enumerate(field.labels([_TOKEN.findall(t) for t in texts])):
        if not labels.any():
            continue
        span = None
        for m, label in zip(_TOKEN.finditer(texts[k]), labels.tolist()):
            name = LABELS[label]
            if name[0] == "I" and span and span[0] == name[2:]:
                span[2] = m.end()
                continue
            span = [name[2:], *m.span()] if name[0] == "B" else None
            if span:
                added[k].append(span)
    out = []
    for k, text in enumerate(texts):
        taken = sorted((a, b) for _, a, b in base[k])
        extra = []
        for kind, a, b in added[k]:
            while b > a and text[b - 1] in ".+=-":
                b -= 1
            if a < b and not any(x < b and a < y for x, y in taken):
                extra.append((kind, a, b))
        rank = {x: i for i, x in enumerate(KINDS)}
        out.append((base[k], sorted(base[k] + extra, key=lambda s: (rank[s[0]], s[1]))))
    return out


# --- training ----------------------------------------------------------------

#: A slot's tokens all carry its label.
_SENTENCES = """please write to {email} for details
contact {email} or call {phone} today
her address is {email} and his {email} .
reach me at {phone} after noon
tel {phone} , fax {phone}
call {phone} now
the server {ip} did not answer
from {ip} to {ip} over night
card {card} was charged twice
pay with {card} please
my card number is {card} .
password = {secret} is not safe
the log shows {pass} near the end
export token = " {secret} " before use
key {key} was leaked yesterday
and {key} too
{key}
token = " {secret} "
order {number} of {date} was sent
order {unlike} was sent
pay {unlike} please
the number {unlike} is no card
number {unlike} {unlike} and {unlike}
at at at at at at at at
the time is {long} and the place was {long}
this is {long} to {long} at {long}
he was {long} and she is {long} from {long} to {long}
% $ & * is % and was $
chapter {small} section {small}
version {version} of the licence
licensed under the Apache License , Version 2.0
the GNU General Public License , version {small}
in {year} about {small} people came
we paid {small} . {small} for {small} items
page {small} of {small}
at {time} on {date} we met
room {small} , floor {small}
the code {number} and the sum {number}
results : {version} percent
MIT and CC BY-NC 4.0 apply
born {date} in town
see @ {small} for more
write to {spelt} for details
ask {spelt} about it
or mail {spelt} today
password = {lower}
my password is {lower} , do not share it
the secret is {lower}
set {pair} before the start
run with {pair}
the key to the door is under the mat
the password is not the point
we met at noon and looked at the picture
a dot on the map , and com is short for committee
the secret of the garden was never told
token of thanks from all of us
is it at home or at work
he was called to the phone at last
the cat sat at the door ( at night ) and slept
she is at the market ; it is cold
look at the dot to the left
il est parti à la maison avec le chien
der Hund lief durch den Wald und sah die Katze
el perro corre por la calle y la casa es grande
le mot de passe du jour est un secret
das Wort ist das Wort
Alpha beta GAMMA delta , epsilon : zeta
one - two - three ... four
> quoted | line { with } signs # and * stars
x = y + z
name = value
a=b
color=red"""


def labelled_table(spark: SparkSession, copies: int = 14, seed: int = 11) -> DataFrame:
    """The small labelled table that ships with the operator: sentence, position, token, label.

    Its values are drawn by rule into sentences; any table of this shape does.
    """
    rng = random.Random(seed)
    word = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))

    def card() -> str:
        body = digits(rng.choice([14, 15, 15, 15]))
        return next(body + c for c in "0123456789" if luhn(body + c))

    def draw(kind: str) -> list[str]:
        if kind == "email":
            return [rng.choice([f"{word(3, 8)}.{digits(2)}@{word(3, 6)}{digits(1)}.{word(4, 8)}.com", f"{word(3, 9)}@{word(4, 8)}.org"])] if rng.random() < 0.7 else [word(3, 8), "(", "at", ")", f"{word(4, 8)}{digits(2)}.com"]
        if kind == "phone":
            return rng.choice([[f"+{rng.randint(1, 99)}", "(", digits(3), ")", f"{digits(3)}-{digits(4)}"], ["(", digits(3), ")", f"{digits(3)}-{digits(4)}"], [f"{digits(3)}-{digits(3)}-{digits(4)}"]])
        if kind == "spelt":
            name, place, end = word(3, 8), word(4, 8), rng.choice(["com", "org", "net"])
            return rng.choice([[name, "(", "at", ")", place, ".", end], [name, "(", "at", ")", place, "dot", end], [name, "at", place, "dot", end], [name, "dot", word(3, 6), "at", place, "dot", end], [name, "(", "at", ")", f"{place}.{end}"]])
        if kind == "unlike":
            body = digits(15)
            return [next(body + c for c in "0123456789" if not luhn(body + c))]
        if kind == "long":
            return [word(6, 16)]
        if kind == "lower":
            return [rng.choice([word(8, 14), word(5, 9) + digits(2)])]
        if kind == "pair":
            return [f"{rng.choice(['password', 'passwd', 'secret', 'api_key'])}={rng.choice([word(8, 14), word(5, 9) + digits(3)])}"]
        if kind == "ip":
            return [".".join(str(rng.randint(0, 255)) for _ in range(4))]
        if kind == "card":
            return [card()]
        if kind == "secret":
            return [hexa(rng.choice([18, 32, 40]))]
        if kind == "pass":
            return [f"{rng.choice(['password', 'passwd', 'secret', 'api_key'])}={hexa(rng.choice([16, 18, 24]))}"]
        if kind == "key":
            return ["AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(15)) + rng.choice("234567")]
        return [{"number": digits(rng.randint(4, 16)), "small": digits(rng.randint(1, 3)), "year": f"19{digits(2)}", "version": f"{digits(1)}.{digits(1)}", "time": f"{digits(2)}:{digits(2)}", "date": f"{digits(2)}.{digits(2)}.20{digits(2)}"}[kind]]

    rows, sentence = [], 0
    tags = {"pass": "secret", "key": "secret", "lower": "secret", "pair": "secret", "spelt": "email"}
    for line in _SENTENCES.split("\n") * copies:
        at, noise = 0, rng.random() < 0.6
        parts = [word(1, 9) for _ in range(rng.randint(0, 6))] * noise + line.split() + [word(1, 9) for _ in range(rng.randint(0, 6))] * noise
        for part in parts:
            kind = part[1:-1] if part[0] == "{" and len(part) > 1 else ""
            for j, token in enumerate(draw(kind) if kind else [part]):
                tag = tags.get(kind, kind)
                rows.append((sentence, at, token, f"{'I' if j else 'B'}-{tag}" if tag in KINDS else "O"))
                at += 1
        sentence += 1
    return spark.createDataFrame(rows, "sentence long, position long, token string, label string")


def sentence_features(tokens: list[str]) -> list[list[str]]:
    """The names of all features of each token in its place."""
    out, cues = [], [cue_of(t) for t in tokens]
    for i, t in enumerate(tokens):
        names = [*token_features(t)]
        if i + 1 < len(tokens):
            names.append(f"+:{shape(tokens[i + 1])}")
        if i:
            names.append(f"-:{shape(tokens[i - 1])}")
        if i > 1 and cues[i - 2] and cues[i - 1]:
            names.append(f"p:{cues[i - 2]}|{cues[i - 1]}")
        out.append(names)
    return out


def train(table: DataFrame, epochs: int = 8, rate: float = 0.3, ridge: float = 1e-3, most_rows: int = 100_000, batch: int = 48) -> Field:
    """A field from the first ``most_rows`` tokens of a labelled table, by stochastic gradient ascent on the likelihood."""
    rows = table.where("token is not null and label is not null").orderBy("sentence", "position").limit(most_rows).collect()
    sentences: dict[int, list] = defaultdict(list)
    for r in rows:
        sentences[r.sentence].append((r.token, LABELS.index(r.label)))
    n, longest = len(LABELS), max((len(x) for x in sentences.values()), default=1)
    numbers: dict[str, int] = {"": 0}  # stands for no feature
    width = len(token_features("a")) + 3
    features = np.zeros((len(sentences), longest, width), dtype=np.int64)
    truth = np.full((len(sentences), longest), -1)
    for k, own in enumerate(sentences.values()):
        for i, names in enumerate(sentence_features([t for t, _ in own])):
            features[k, i, : len(names)] = [numbers.setdefault(f, len(numbers)) for f in names]
            truth[k, i] = own[i][1]
    weights, squares = np.zeros((len(numbers), n)), np.full((len(numbers), n), 1e-6)
    moves, move_squares = np.zeros((n, n)), np.full((n, n), 1e-6)
    rng = np.random.default_rng(3)
    for _ in range(epochs if len(sentences) else 0):
        order = rng.permutation(len(sentences))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            y = truth[own]
            steps = int((y >= 0).sum(axis=1).max())
            y, x = y[:, :steps], features[own, :steps]
            known = y >= 0
            gap, pairs = _marginals(weights[x].sum(axis=2), moves, known.sum(axis=1))
            gap = -gap * known[:, :, None]
            k, i = np.nonzero(known)
            gap[k, i, y[known]] += 1
            each = np.repeat(gap.reshape(-1, n), width, axis=0)
            step = np.stack([np.bincount(x.ravel(), each[:, c], len(numbers)) for c in range(n)], axis=1)
            step -= ridge * weights * (step != 0)
            step[0] = 0
            squares += step**2
            weights += rate * step / np.sqrt(squares)
            step = -pairs - ridge * moves
            both = known[:, 1:]
            np.add.at(step, (y[:, :-1][both], y[:, 1:][both]), 1)
            move_squares += step**2
            moves += rate * step / np.sqrt(move_squares)
    return Field({f: weights[k] for f, k in numbers.items() if k and weights[k].any()}, moves)


def _marginals(score: np.ndarray, moves: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every token of a batch of sentences, and expected label pairs, by forward and backward sums."""
    many, steps, n = score.shape
    live = np.arange(steps)[None, :] < sizes[:, None]
    forward, backward = np.zeros_like(score), np.zeros_like(score)
    forward[:, 0] = score[:, 0]
    for t in range(1, steps):
        forward[:, t] = _lse(forward[:, t - 1, :, None] + moves, 1) + score[:, t]
    for t in range(steps - 2, -1, -1):
        onward = _lse(moves + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where(live[:, t + 1, None], onward, 0)
    whole = _lse(forward[np.arange(many), sizes - 1], 1)
    pairs = np.zeros((n, n))
    for t in range(1, steps):
        own = np.exp(np.minimum(0, forward[:, t - 1, :, None] + moves + (score[:, t] + backward[:, t] - whole[:, None])[:, None, :]))
        pairs += own[live[:, t]].sum(axis=0)
    return np.exp(np.minimum(0, forward + backward - whole[:, None, None])), pairs


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


# --- Spark -------------------------------------------------------------------

FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_spans long, has_personal boolean"


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """Counts and digest of the patterns' spans, and all spans, of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((field.weights, field.moves))  # bounded by the labelled table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*shared.value)
        for batch in slices(batches):
            found = all_spans(texts_of(batch), own)
            counts = [pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS[:4]]
            digests = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(digests), pa.array([written(s) for _, s in found]), pa.array([sum(s[0] == "secret" for s in every) for _, every in found], pa.int64()), pa.array([len(every) for _, every in found], pa.int64()), pa.array([bool(every) for _, every in found])], names=[c.split()[0] for c in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; spans that overlap become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """The documents, all columns, with personal data replaced in text; n_chars follows where there is one. Only texts leave the JVM."""
    shared = docs.sparkSession.sparkContext.broadcast((field.weights, field.moves))

    @F.arrow_udf("string")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Field(*shared.value)
        for batch in texts:
            new = []
            for at in range(0, len(batch), SLICE):
                raw = batch.slice(at, SLICE).to_pylist()
                new += [None if t is None else redacted(t, s) for t, (_, s) in zip(raw, all_spans([t or "" for t in raw], own))]
            yield pa.array(new, pa.string())

    out = docs.withColumn("text", clean("text"))
    kind = dict(docs.dtypes).get("n_chars")
    return out.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns) if kind else out
