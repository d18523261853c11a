"""SentencePiece encoding and decoding by backtracking.

A merge-type (BPE) encoding is the only sequence of pieces in which every two
neighbours stay apart when their joint text is merged again. So a word is
encoded left to right with the longest piece that Aho-Corasick finds at each
place; a piece that is not compatible with the one before it gives way to the
next shorter one, and a place from which nothing fits is marked in a bit field
and never tried again. Pieces never hold a space mark behind another character,
so words are independent, and each word is encoded once for as long as it is
remembered. Nor does a merge ever join two characters that are neighbours in no piece,
so closing signs are encoded apart from the word before them where that holds.
Characters outside the vocabulary become byte pieces.

Defined results: a null text is empty; an empty text has only begin and end id;
null ids and repeated rows are kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, slices, texts_of

SPACE = "▁"
CLOSING = ".,!?;:|"
#: Bytes of remembered words in a generation.
ROOM = 24 << 20
#: A run of space marks belongs to the word behind it.
_WORDS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class Pieces:
    """Encoder and decoder of a byte-fallback BPE model without text normalisation."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        if any(SPACE in x.lstrip(SPACE) for x in self.ids):
            raise ValueError("words are not independent in this vocabulary")
        self.scores = {names[i]: model.get_score(i) for i in plain}
        self.bytes = {int(names[i][1:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.decoded = [b""] * n
        for i in plain:
            self.decoded[i] = names[i].replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.decoded[i] = bytes([b])
        self.automaton = ahocorasick.Automaton()
        for name in self.ids:
            if len(name) == 1 or self.merged(name) == [name]:
                self.automaton.add_word(name, len(name))
        self.automaton.make_automaton()
        self.apart: dict[tuple[str, str], bool] = {}
        self.characters = {x for x in self.ids if len(x) == 1}
        named = [names[i] for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.inside = {pair for name in named for pair in zip(name, name[1:])}
        self.known = Words(self._remembered, ROOM)

    def merged(self, text: str) -> list[str]:
        """Merging as defined: again and again the best-scored neighbours, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        found = self.apart.get((left, right))
        if found is None:
            if len(self.apart) > 400_000:
                self.apart.clear()
            found = self.apart[left, right] = self.merged(left + right) == [left, right]
        return found

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a text whose characters are all in the vocabulary."""
        n = len(text)
        fits: list[list[int]] = [[] for _ in range(n)]
        for end, size in self.automaton.iter(text):
            fits[end - size + 1].append(size)  # shorter before longer
        failed, found, tried, pos, apart = 0, [], [len(x) - 1 for x in fits], 0, self.apart
        last = ""
        while pos < n:
            choices, k, piece = fits[pos], tried[pos], ""
            while k >= 0:
                end = pos + choices[k]
                if not failed >> end & 1:
                    piece = text[pos:end]
                    if not last:
                        break
                    fine = apart.get((last, piece))
                    if fine or fine is None and self.compatible(last, piece):
                        break
                k -= 1
            if k >= 0:
                tried[pos] = k
                found.append(piece)
                last, pos = piece, end
                if pos < n:
                    tried[pos] = len(fits[pos]) - 1
            elif found:
                failed |= 1 << pos
                pos -= len(found.pop())
                last = found[-1] if found else ""
            else:
                raise ValueError(f"no encoding of {text!r}")
        return found

    def _remembered(self, word: str) -> tuple[bytes, bool]:
        stem = word.rstrip(CLOSING)
        if 0 < len(stem) < len(word) and (stem[-1], word[len(stem)]) not in self.inside:
            return self.known[stem] + self.known[word[len(stem) :]], False
        return self._word(word), True

    def _word(self, word: str) -> bytes:
        """Ids of a word; unknown characters cut it."""
        if self.characters.issuperset(word):
            return array("I", map(self.ids.__getitem__, self.backtrack(word))).tobytes()
        ids, run = [], []
        for c in word:
            if c in self.ids:
                run.append(c)
                continue
            ids += [self.ids[p] for p in self.backtrack("".join(run))] if run else []
            run = []
            ids += [self.bytes[b] for b in c.encode()]
        ids += [self.ids[p] for p in self.backtrack("".join(run))] if run else []
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """All ids, begin and end included, as little-endian unsigned 32-bit integers."""
        body = b""
        if text:
            marked = SPACE + text.replace(" ", SPACE)
            if SPACE * 2 in marked or marked[-1] == SPACE or "\0" in marked or "\n" + SPACE in marked:
                words = _WORDS.findall(marked)
            else:
                words = marked.replace(SPACE, "\0" + SPACE).replace("\n", "\0\n\0").split("\0")
            body = b"".join(map(self.known.__getitem__, words))
        return array("I", [self.begin]).tobytes() + body + array("I", [self.end]).tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text of ids; control ids are silent, the first space mark is dropped."""
        whole = b"".join(map(self.decoded.__getitem__, ids.tolist()))
        return whole[1:] if whole[:1] == b" " else whole


_LOADED: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each document's whole text."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in slices(batches):
            n, ids_sha, text_sha = [], [], []
            for text in texts_of(batch):
                data = pieces.encode(text)
                ids = np.frombuffer(data, dtype="<u4")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(data).hexdigest())
                text_sha.append(hashlib.sha256(pieces.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(code, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
