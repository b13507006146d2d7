import os

import pytest
from hypothesis import given, settings, strategies as st

from caselode.llm import tokens as t

FILE = t.tokenizer_path("byte_bpe_50k")
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def both():
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(FILE.replace(".tiktoken", ".json"))
    reference.encode_special_tokens = True
    return t.SpeculativeBpe(t.read_ranks(FILE)), reference


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=30) | st.text("abcdeest ing0189\n", max_size=60), max_size=8))
def test_equals_the_public_tokenizer(both, texts):
    own, reference = both
    texts = [x.encode("utf-8", "replace").decode() for x in texts]
    assert own.encode_batch(texts) == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_pairs_tested_together_equal_exact_merging(both):
    own, _ = both
    import numpy as np

    rng = np.random.default_rng(3)
    a, b = rng.integers(0, own.size, 3000), rng.integers(0, own.size, 3000)
    told = own.compatible(a, b)
    for x, y, ok in zip(a, b, told):
        if own._merged(own.bytes_of[x]) == [x] and own._merged(own.bytes_of[y]) == [y]:
            assert ok == (own._merged(own.bytes_of[x] + own.bytes_of[y]) == [x, y])


def test_long_words(both):
    own, reference = both
    texts = ["heartburn" * 300, "ab" * 5000, "Zq9x" * 40 + "é" * 900, "aaaa" * 777, "-=" * 400]
    assert own.encode_batch(texts) == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_null_empty_special(spark, both):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<|endoftext|>"), (4, "word " * 30_000)], "doc_id long, text string")
    encode = t.encoder()
    got = {r["doc_id"]: list(r["ids"]) for r in df.select("doc_id", encode("text").alias("ids")).collect()}
    assert got[1] == got[2] == [] and 50256 not in got[3] and len(got[4]) >= 30_000
    assert df.limit(0).select(encode("text").alias("ids")).count() == 0
