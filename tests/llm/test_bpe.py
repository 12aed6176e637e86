from __future__ import annotations

import os
from array import array

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm.bpe import encode_corpus, token_counts, vocabulary

PLACE = "/opt/tokenizers"
PATH = f"{PLACE}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{PLACE}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def encode(text):
    out = array("i")
    vocabulary(PATH).encode(text, out)
    return list(out)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(reference, text):
    assert encode(text) == reference(text)


@pytest.mark.parametrize("text", ["", " ", "\n\n  x", "<|endoftext|>", "don't I'LL", "a" * 5000, "ab" * 3000, "カメラが上下逆に" * 400, "​ \x85\x1c x", "😀👩🏽‍🔬" * 50, "0123456789" * 200])
def test_hard_texts(reference, text):
    assert encode(text) == reference(text)


def test_long_piece_takes_little_time():
    import time

    began = time.time()
    assert len(encode("xyz" * 100_000)) > 0
    assert time.time() - began < 30


def test_table(spark):
    df = spark.createDataFrame([(1, "Hello world", 9), (2, "", 9), (3, None, 9)], "doc_id long, text string, ids int")
    out = {r["doc_id"]: r for r in encode_corpus(df, "text", PATH).collect()}
    assert out[1]["ids_1"] == [15496, 995] and out[1]["ids"] == 9
    assert out[2]["ids_1"] == [] and out[3]["ids_1"] == []
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(df, "text", PATH).collect()} == {1: 2, 2: 0, 3: 0}
    assert encode_corpus(df.limit(0), "text", PATH).collect() == []
