import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zlib

from shelfspark.llm import token_output as t

PATH = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(4, "a\tb  c\n\n d"), (2, None), (2, ""), (3, "x <|endoftext|> y\x1c\x85 z q  "), (None, "hi"), (9, "w " * 30_000), (10, "one two\nthree é ñ 12,5"), (10, "one two\nthree é ñ 12,5"), (11, " lead\nin  ")]


@pytest.mark.parametrize("bits", [False, True])
def test_round_trip_equals_plain_encoding(spark, bits):
    docs = spark.createDataFrame([(i, x, 1) for i, x in ROWS], "doc_id long, text string, start long")
    got = sorted((tuple(r) for r in t.tokens_round_trip(docs, PATH, bits=bits, block=1000).collect()), key=lambda r: r[1])
    assert got == t.brute_force(ROWS, PATH)
    assert t.tokens_round_trip(docs.limit(0), PATH).count() == 0


def test_planes_and_crc():
    ids = np.random.default_rng(1).integers(0, 2**32, 1003, dtype=np.uint32)
    for bits in (False, True):
        assert (t.unplanes(t.planes(ids, bits), len(ids)) == ids).all()
    a, b = b"some bytes", b"and others" * 77
    assert t.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_pieces_encode_like_whole_texts(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rng = random.Random(3)
    odd = ["a", "bc ", " ", "\n", "\n\n", "  ", "é", "\t", "12", "'s", "!", ".", "日", "\u3000", "x "]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randint(0, 12))) for _ in range(2000)] + [None, ""]
    encoder = t._Encoder(PATH)
    for _ in range(2):  # the second time from what is remembered
        ids, counts = encoder.batch(pa.array(texts))
        for text, part in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert part.tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids
    assert [len(x) for x in encoder.batch(pa.array([], pa.string()))] == [0, 0]


def test_pieces_are_remembered_in_bounded_generations(monkeypatch):
    monkeypatch.setattr(t, "CACHE", 20)
    encoder = t._Encoder(PATH)
    for i in range(30):
        words = [f"w{i}", f"v{i}", "the"]
        ids, counts = encoder.batch(pa.array([" ".join(words)]))
        assert ids.tolist() == encoder.tokenizer.encode(" ".join(words), add_special_tokens=False).ids
        assert len(encoder.young) + len(encoder.old) <= 24
