import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfspark.llm import bpe_transducer as b

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = b.read_ranks(PATH)
TIKTOKEN = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = b.Encoder(PATH, PATTERN)
TEXTS = [None, "", "a", "the cat's 12 hats\n\n  and\t é日本😀 ", "<|endoftext|> x", "a" * 3000, "ab" * 500, "w " * 150_000, "é" * 700, "x\x1c\x85　 y", " " * 99]


def want(text):
    return TIKTOKEN.encode_ordinary(text or "")


def test_query_equals_tiktoken(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "hi", 2), (3, TEXTS[3], 3), (3, TEXTS[3], 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    sha = lambda x: hashlib.sha256(x).hexdigest()
    expected = sorted((str(i), len(want(t)), sha(np.array(want(t), "<u4").tobytes()), sha((t or "").encode())) for i, t, _ in rows)
    assert sorted((str(r[0]), *r[1:]) for r in b.digest(docs, PATH, PATTERN).collect()) == expected
    assert b.digest(docs.limit(0), PATH, PATTERN).count() == 0


def test_given_documents_equal_tiktoken(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    assert [np.frombuffer(ENCODER.ids(t or ""), "<u4").tolist() for t in texts] == [want(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("etaoin shrdlu'ING\n", max_size=80), st.text("aé日😀  \t1", max_size=40)))
def test_any_text(text):
    assert np.frombuffer(ENCODER.ids(text), "<u4").tolist() == want(text)


def test_states_are_bounded_and_made_anew():
    small, rng = b.Transducer(RANKS, 300), random.Random(2)
    for _ in range(800):
        piece = "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 20))).encode()
        assert small.encode(piece) == TIKTOKEN.encode_ordinary(piece.decode())
        assert len(small._known) <= 301


def test_the_last_byte_of_a_piece_makes_no_state():
    t = b.Transducer(RANKS)
    for i in range(2, 12):  # each piece is the one before and a byte more
        piece = b"qzxjkvwqpbzt"[:i]
        assert t.encode(piece) == TIKTOKEN.encode_ordinary(piece.decode())
        assert len(t._known) <= i


def test_border_test_equals_the_merges():
    t, rng, tokens = b.Transducer(RANKS), random.Random(5), list(RANKS.values())
    for _ in range(4000):
        word = t.bytes[rng.choice(tokens)] + t.bytes[rng.choice(tokens)][: rng.randint(0, 3)]
        k = rng.randint(0, len(word))
        if word[:k] in RANKS and word[k:] in RANKS:
            x, y = RANKS[word[:k]], RANKS[word[k:]]
            assert t.may_follow(x, y) == (b.merge(word, RANKS) == [x, y])


def test_tokens_come_after_bounded_lookahead():
    t, rng = ENCODER.pieces.transducer, random.Random(4)
    longest = max(map(len, RANKS))
    for alphabet in ("ab", "etaoin", " \n"):
        state, out, read = t.start, 0, 0
        for _ in range(4000):
            step = state.get(x := ord(rng.choice(alphabet))) or t._step(state, x)
            state, read = step[0], read + 1
            out += sum(len(t.bytes[i]) for i in step[1])
            assert read - out <= 2 * longest


@pytest.mark.parametrize("block", [1, 2, 7, b.BLOCK])
def test_decoding_in_blocks(block):
    d = b.Decoder(RANKS)
    for text in TEXTS:
        assert d.text(np.array(want(text), "<u4").tobytes(), block) == (text or "", 0)


def test_ill_formed_bytes_in_any_chunks():
    rng = random.Random(1)
    some = [0x41, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC0, 0xC2, 0xDF, 0xE0, 0xE1, 0xED, 0xF0, 0xF1, 0xF4, 0xF5, 0xFF]
    for _ in range(5000):
        raw, machine, out, i = bytes(rng.choice(some) for _ in range(rng.randint(0, 9))), b.Utf8Decoder(), "", 0
        while i < len(raw):
            n = rng.randint(0, 3)
            out, i = out + machine.feed(raw[i : i + n]), i + n
        assert out + machine.finish() == raw.decode("utf-8", "replace")
        assert machine.bad == raw.decode("utf-8", "replace").count("�")


def test_ill_formed_ids_in_a_table(spark):
    half = [RANKS[bytes([x])] for x in "é".encode()]
    rows = spark.createDataFrame([(1, bytearray(np.array(half, "<u4").tobytes())), (2, bytearray(np.array(half[:1] + [RANKS[b"a"]], "<u4").tobytes())), (3, None)], "k int, `my ids` binary")
    assert [tuple(r) for r in b.decode(rows, PATH, "my ids").select("k", "decoded", "n_replaced").orderBy("k").collect()] == [(1, "é", 0), (2, "�a", 1), (3, "", 0)]
