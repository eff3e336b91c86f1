import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pinloom.llm.tokens import FOLDER, VOCABULARY, encode_texts, encoder

tokenizers = pytest.importorskip("tokenizers")
pytestmark = pytest.mark.skipif(not os.path.exists(f"{FOLDER}/{VOCABULARY}"), reason="no vocabulary")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(f"{FOLDER}/{VOCABULARY}")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(reference, text):
    assert encoder().encode(text) == reference(text)


def test_texts_of_letters_and_long_words(reference):
    rng = random.Random(3)
    for _ in range(1500):
        word = "".join(rng.choice("eeetaaoinshrdlu' 19\n") for _ in range(rng.randint(1, 50)))
        assert encoder().encode(word) == reference(word)
    for text in ("a" * 5000, "ab" * 4000, " " * 3000, "<|endoftext|>" * 3, "the" * 2000, "\x1c\x85　x", "１２３²"):
        assert encoder().encode(text) == reference(text)


def test_a_million_letters_take_linear_time():
    assert sum(len(encoder().token[t]) for t in encoder().encode("abcab" * 200_000)) == 1_000_000


def test_ids_decode_to_the_text():
    e = encoder()
    text = "Grüße, мир! \t 🚚 naïve 12,5 %"
    assert b"".join(e.token[t] for t in e.encode(text)).decode() == text


def test_frames(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "", "y"), (3, None, "z"), (1, "a b", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in encode_texts(df).collect())
    assert got == [(1, encoder().encode("a b"))] * 2 + [(2, []), (3, [])]
    assert encode_texts(df.limit(0)).count() == 0
