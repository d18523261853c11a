"""Fast whole-text encoding with a byte-level BPE of the tokenizers library."""

from __future__ import annotations

import re
import sys
import unicodedata
from array import array

import numpy as np
from tokenizers import Tokenizer

from .common import Words

_TAIL = ".,!?;:|"
#: What stands for a comma and a full stop between words while a text is cut.
_COMMA, _STOP = "\1", "\2"
_CUT_COMMA, _CUT_STOP = f" {_COMMA} ", f" {_STOP} "
#: Such a sign behind anything but a letter or a digit belongs to the signs before it.
_JOINED = re.compile(r"[.,](?<=[\W_][.,]) ")
#: White space that stands alone between visible characters never joins other
#: white space in the pre-tokenizer's pattern; texts with any other take the plain path.
_UNEVEN = ["  ", "\n\n", " \n", "\n ", _COMMA, _STOP, *(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n")]


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


class ByteBpe:
    """Ids of whole texts, remembered by word.

    The pre-tokenizer's pattern cuts before every single space and around every
    single line break, so the words between them are encoded once by the library
    and their ids are reused. Closing punctuation is encoded apart only behind a
    letter or a digit, as the pattern keeps a run of other signs together; commas and
    stops before a space are cut off for the whole text at once where that holds. All other
    words, texts with any other white space, and texts with one of the file's added
    tokens (which get its id) go through the library whole.
    """

    def __init__(self, path: str, room: int = 24 << 20):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.plain = [*_UNEVEN, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        self.letters = _byte_letters()
        wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.code, self.dtype = ("I", np.dtype("<u4")) if wide else ("H", np.dtype("<u2"))
        self.plain_ascii = [x for x in self.plain if x.isascii()]
        self.packed = [bytes(x) for x in np.arange(self.tokenizer.get_vocab_size(), dtype=self.dtype).view("V%d" % self.dtype.itemsize)]
        # Words behind a space, and words that begin a line or follow another word's punctuation.
        self.spaced = Words(self._spaced, room)
        self.bare = Words(self._bare, room // 4)
        self.line = self._library("\n")
        self.signs = {_COMMA: self._library(","), _STOP: self._library(".")}

    def _library(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _spaced(self, word: str) -> tuple[bytes, bool]:
        if word.isalpha() or word.isascii() and word.isdecimal():
            mapped = "Ġ" + word if word.isascii() else "Ġ" + "".join(map(self.letters.__getitem__, word.encode()))
            packed = self.packed
            return b"".join([packed[t.id] for t in self.model.tokenize(mapped)]), True
        if word in self.signs:
            return self.signs[word], True
        stem = word.rstrip(_TAIL)
        if stem and len(stem) < len(word) and unicodedata.category(stem[-1])[0] in "LN":
            return self.spaced[stem] + self.bare[word[len(stem) :]], False
        return self._library(" " + word), True

    def _bare(self, word: str) -> tuple[bytes, bool]:
        if word.isalpha() or word.isascii() and word.isdecimal():
            mapped = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            return b"".join([self.packed[t.id] for t in self.model.tokenize(mapped)]), True
        stem = word.rstrip(_TAIL)
        if stem and len(stem) < len(word) and unicodedata.category(stem[-1])[0] in "LN":
            return self.bare[stem] + self.bare[word[len(stem) :]], False
        return self._library(word), True

    def encode(self, text: str) -> bytes:
        """The ids, as little-endian integers of ``dtype``."""
        if not text:
            return b""
        if text[0] in " \n" or text[-1] in " \n":
            return self._library(text)
        for x in self.plain_ascii if text.isascii() else self.plain:
            if x in text:
                return self._library(text)
        return self.line.join(map(self._line_of, text.split("\n")))

    def _line_of(self, line: str) -> bytes:
        if _JOINED.search(line):
            words = iter(line.split(" "))
            return self.bare[next(words)] + b"".join(map(self.spaced.__getitem__, words))
        end = b""
        if line[-1] == "." and line[-2:-1].isalnum():
            line, end = line[:-1], self.signs[_STOP]
        words = iter(line.replace(", ", _CUT_COMMA).replace(". ", _CUT_STOP).split(" "))
        return self.bare[next(words)] + b"".join(map(self.spaced.__getitem__, words)) + end


_LOADED: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """One encoder for each file and worker process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]
