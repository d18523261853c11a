import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leafwright.llm import byte_bpe, op06_token_files, op09_packing

TEXTS = ["Hello there, world.\nNext line don't.", None, "", "a  b\n\n c ", "é ñ 12.5%", "Hello there, world.\nNext line don't.", "word " * 9000]
SCHEMA = "doc_id long, text string, start string, length double"


def ids_of(text, end):
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*tk.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7 % 11, t, "x", 1.0) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_token_files(spark, docs):
    got = sorted(op06_token_files.token_files(docs).collect(), key=lambda r: (r.start))
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    at = 0
    for want, row in zip(rows, got, strict=True):
        ids = ids_of(want.text, 2)
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (want.doc_id, at, len(ids), crc(ids))
        at += len(ids)
    assert op06_token_files.token_files(docs.limit(0)).count() == 0


def test_packing(spark, docs):
    got = op09_packing.pack(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for row in docs.collect():
        ids = ids_of(row.text, 0)
        own = sorted(by[row.doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == crc(ids[r.start : r.start + r.length])
        assert all(r.length == 2048 for r in own[1:])
    check_sequences(got)
    assert op09_packing.pack(docs.limit(0)).count() == 0


def check_sequences(got):
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append(r)
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return len(seqs)


def test_packing_is_tight():
    rng = np.random.default_rng(5)
    counts = {}
    for x in np.minimum(2048, rng.lognormal(5.5, 1.2, 20000).astype(int) + 1):
        counts[int(x)] = counts.get(int(x), 0) + 1
    bins = op09_packing.configurations(counts)
    held = {}
    for times, room, copies in bins:
        assert room == 2048 - sum(k * v for k, v in copies.items()) >= 0
        for k, v in copies.items():
            held[k] = held.get(k, 0) + v * times
    assert held == counts
    least = sum(k * v for k, v in counts.items()) / 2048
    assert sum(b[0] for b in bins) <= 1.003 * least + 2


def test_knapsack_matches_enumeration():
    got = op09_packing.knapsack(np.array([3, 4, 5]), np.array([4.0, 5.0, 7.0]), np.array([2, 2, 1]), 11)
    assert got.tolist() == [2, 0, 1]


def test_encoder_same_as_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = byte_bpe.ByteBpe(path), Tokenizer.from_file(path)
    texts = ["(the world).", "it was 12%.", 'he said "Hello".', "cafe\u0301. e\u0301, x", "a <|endoftext|>. b", "<|endoftext|>", "x<|endoftext|>|", '"!! ... (a), [b]; \'c\'! d\'s. \u00bd. \u65e5\u672c.', "\u1c89. a\u1c89|"]
    rng = random.Random(3)
    signs = [*"aZ9.,!?;:|)('\"%-\u00e9\u0301\u00bd\u65e5\u2014\U0001f600", " ", " ", "\n", "  ", "'s", "word", "<|endoftext|>"]
    texts += ["".join(rng.choices(signs, k=rng.randint(1, 14))) for _ in range(20000)]
    for text in texts:
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_any_mixture_of_signs_encodes_as_the_library_does():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), byte_bpe.ByteBpe(path, room=4000)
    rng = random.Random(4)
    parts = ["word", "Über", "é", "x1", "12", "12.5%", "don't", "'s", "world).", '"Hello".', "a_b", "_,", ",", "...", "é,", "é.", "日本", "½.", "%%%", "a,b", "end.\nNext", "\nLine", "tab\tx", "  ", "\x01", "\x02", "<|endoftext|>", "we've.", "1,000,", "z),", "Ⅷ.", "١٢", "🙂.", "b;", "e|", ",,", "., "]
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice((" ", " ", " ", "", "\n")) for _ in range(rng.randint(1, 9)))
        text = text.strip(" \n") if rng.random() < 0.5 else text
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
