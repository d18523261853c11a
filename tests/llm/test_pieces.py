import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from leafwright.llm import op08_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", "a  b", " a", "a ", "\n", "a\n b", "a\n\nb  \n c", "a\tb", "x y", "<s> </s> <0x0A>", "▁a b", "\0a", "ﬁ", "café café", "a　b", "日本語 \U0001f600!", "      indented     code()", "the " * 700, "internationalisation's 12,345.67 ___---===", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]


@pytest.fixture(scope="module")
def both():
    return op08_pieces.load(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_same_as_library(both):
    own, lib = both
    rng = random.Random(3)
    letters = "abcdeinrstu  \n.,éß'AT01▁"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    for text in TEXTS + made:
        ids = np.frombuffer(own.encode(text), dtype="<u4").tolist()
        want = lib.encode(text, add_bos=True, add_eos=True)
        assert ids == want, text
        assert own.decode(np.array(ids)).decode() == lib.decode(want), text


def test_long_runs_without_spaces(both):
    own, lib = both
    rng = random.Random(8)
    for text in ("".join(rng.choice("abcdefghinorst") for _ in range(40_000)), "ab" * 20_000, "é1" * 5_000):
        assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == lib.encode(text, add_bos=True, add_eos=True)
    assert all(len(w) <= own.known.longest for w in own.known)  # such words are not remembered


def test_query(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, None, None), (1, TEXTS[1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for i, t, _ in rows:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    got = [tuple(r) for r in op08_pieces.encode_decode(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert op08_pieces.encode_decode(docs.limit(0)).count() == 0
