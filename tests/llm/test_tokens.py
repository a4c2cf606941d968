"""Ids equal the public library's; round trips; odd texts."""

import os
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as hs

from cardlake.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.RANK_FILE), reason="no vocabulary here")
RANKS = tokens.read_ranks(open(tokens.RANK_FILE, "rb").read()) if os.path.exists(tokens.RANK_FILE) else {}


@pytest.fixture(scope="module")
def both():
    return tokens.PairEncoder(RANKS), tiktoken.Encoding("own", pat_str=tokens.PIECES, mergeable_ranks=RANKS, special_tokens={})


def test_random_texts(both):
    mine, lib = both
    r = random.Random(1)
    words = list(RANKS)
    for _ in range(3000):
        t = b"".join(r.choice(words) for _ in range(r.randint(1, 9))).decode("utf-8", "replace")
        assert mine.encode(t) == lib.encode_ordinary(t)


@settings(max_examples=300, deadline=None)
@given(hs.text(max_size=60))
def test_any_text(both, t):
    mine, lib = both
    t = t.encode("utf-8", "replace").decode()
    ids = mine.encode(t)
    assert ids == lib.encode_ordinary(t)
    assert b"".join(k for i in ids for k in [lib.decode_single_token_bytes(i)]).decode() == t


def test_long_pieces(both):
    mine, lib = both
    for t in ("a" * 30_000, " " * 9_000, "ab" * 10_000, "é" * 5_000, "\n" * 3_000):
        assert mine.encode(t) == lib.encode_ordinary(t)


def test_special_strings_are_ordinary_text(both):
    mine, lib = both
    assert mine.encode("<|endoftext|>") == lib.encode_ordinary("<|endoftext|>")


def test_table(spark, both):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "Hello, 7H!", "z"), (4, "Hello, 7H!", None)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in tokens.encoded(df).collect()}
    assert got == {1: [], 2: [], 3: both[1].encode_ordinary("Hello, 7H!"), 4: both[1].encode_ordinary("Hello, 7H!")}
    assert {r.doc_id: r.tokens for r in tokens.token_counts(df).collect()}[1] == 0
    assert tokens.encoded(df.limit(0)).count() == 0
