"""Language by plain compression, toxicity by plain loops, and very long texts of the token operators."""

import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import zstandard
from tokenizers import Tokenizer

from leafwright.llm import op01_language, op03_maxent, op06_token_files, op09_packing, op10_toxicity

DATA = "/root/testdata/sf0.001"


def compressed_size(data, dictionary):
    """Bytes of all blocks of 2048, each compressed by itself with the dictionary as raw content."""
    own = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(9, write_content_size=False, write_checksum=False, write_dict_id=False)
    return sum(len(zstandard.ZstdCompressor(dict_data=own, compression_params=params).compress(data[k : k + 2048])) for k in range(0, len(data), 2048))


def test_language_against_plain_compression(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    learned = op01_language.dictionaries(docs.where("doc_id % 4 <> 2"))
    texts = {r.doc_id: r.text for r in docs.limit(40).collect()} | {9001: None, 9002: "12 _ 34", 9003: "x"}
    got = {r.doc_id: r for r in op01_language.predict(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), learned).collect()}
    for i, text in texts.items():
        data = " ".join(re.findall(r"[^\W\d_]+", (text or "").lower())).encode()
        if not data:
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
            continue
        sizes = sorted((compressed_size(data, learned[lang]), lang) for lang in learned)
        gap = sizes[1][0] - sizes[0][0]
        assert got[i].lang_pred == sizes[0][1] and math.isclose(got[i].margin, gap / sizes[1][0])
        assert math.isclose(got[i].score, 1 - 0.5 * 2 ** (-min(gap, 400) / 8)) and got[i].rejected == (gap / sizes[1][0] < 0.004)


EDGE = "\"“”„«»‹›'’‘.,!?;:()[]{}<>|*#$%&~_-+=/\\"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return a == b
    if len(a) == len(b):
        wrong = [k for k in range(len(a)) if a[k] != b[k]]
        return len(wrong) == 1 or len(wrong) == 2 and wrong[1] == wrong[0] + 1 and a[wrong[0]] == b[wrong[1]] and a[wrong[1]] == b[wrong[0]]
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def kind_of(token, words, stems):
    if token in words or any(token.startswith(s) for s in stems):
        return 1
    kinds = [2 if len(w) >= 5 else 4 for w in words if one_edit(w, token)]
    kinds += [3 for s in stems for n in range(len(token) + 1) if one_edit(s, token[:n])]
    return min(kinds, default=0)


def plain_rate(text, model):
    hits = [0] * 12
    for line in (text or "").lower().splitlines():
        tokens = line.split()
        bare = [t.strip(EDGE) for t in tokens]
        depth, plain = 0, False
        for k, token in enumerate(tokens):
            inside = depth > 0 or plain
            for c in token:
                if c == '"':
                    plain, inside = not plain, True
                elif c in "“„«‹":
                    depth, inside = depth + 1, True
                elif c in "”»›":
                    depth, inside = max(0, depth - 1), True
            kind = kind_of(bare[k], model.words, model.stems) if bare[k] else 0
            if kind:
                near = set(bare[max(0, k - 6) : k + 7])
                quoted = inside or near & op10_toxicity.REPORTING
                context = 0 if near & op10_toxicity.ADDRESS and not inside else 2 if quoted else 1
                hits[3 * (kind - 1) + context] += 1
    z = model.weights[0] + sum(w * math.log1p(h) for w, h in zip(model.weights[1:], hits))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_toxicity_against_plain_loops(spark):
    rng = random.Random(7)
    weights = [rng.uniform(-2, 2) for _ in range(13)]
    model = op10_toxicity.Model(["moron", "idiot", "scum", "ass"], ["wretch", "stup"], weights)
    words = ["moron", "mor0n", "idoit", "scvm", "scum!", "wretched", "wrtched", "stupid", "stuepid", "asses", "as", "you", "your", "said", '"', '"moron"', "«", "»", "“scum", "fine", "day", "the", "\n", "...", "Moron,", "x" * 80]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(300)] + ["", None]
    got = {r.doc_id: r for r in op10_toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, text in enumerate(texts):
        want = plain_rate(text, model)
        assert math.isclose(got[k].score, want, abs_tol=1e-9) and got[k].predicted == int(want >= 0.5), text


def test_very_long_texts_as_tokens(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice(("alpha", "beta,", "gamma.", "δ", "12")) for _ in range(250_000))
    docs = spark.createDataFrame([(1, long), (2, "short one"), (3, "y" * 300_000)], "doc_id long, text string")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in docs.collect()}
    crc = lambda x: zlib.crc32(np.array(x, dtype="<u4").tobytes())
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in op06_token_files.token_files(docs).collect()}
    assert got == {k: (len(v) + 1, crc([*v, 2])) for k, v in ids.items()}
    pieces = {}
    for r in op09_packing.pack(docs).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for k, v in ids.items():
        own = sorted(pieces[k], key=lambda r: r.piece)
        whole = [*v, 0]
        assert sum(r.length for r in own) == len(whole) and all(r.ids_crc32 == crc(whole[r.start : r.start + r.length]) for r in own)


def test_very_long_text_scored(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat " * 40_000), (2, "the dog"), (3, "z" * 500_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in op03_maxent.score(docs, op03_maxent.train(docs, hot=50)).collect()}
    assert got[1].n_tokens == 240_001 and got[1].n_known == 240_001 and got[3].n_tokens == 2
    assert all(math.isfinite(r.score) and r.score < 0 for r in got.values())
    # A text that repeats itself is far likelier than its words by themselves.
    assert got[1].score > 0.5 * got[1].base_score
