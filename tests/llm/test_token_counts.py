import random

import public_tokenizers
import pytest
from samples import fresh
from tokenizers import Tokenizer

from deckflow.llm import queries, token_counts, tokens

ODD = list("abc'sStTREll09.,;!<|>\n\t  \x1c\x0b́éÉİΣσ가µª½٣あ​　·×÷ßﬁ") + ["<|endoftext|>", "'ve", "'d", " the"]


def library(path, texts):
    got = Tokenizer.from_file(path).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    return [len(g.ids) for g in got]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_counts_equal_the_library(name):
    path, some = public_tokenizers.path(name), random.Random(5)
    texts = ["".join(some.choices(ODD, k=some.randint(0, 40))) for _ in range(4000)]
    counter = token_counts.Counter(path, token_counts.prove(path), limit=2000)
    got = [n for at in range(0, 4000, 400) for n in counter.count(texts[at : at + 400])]
    assert got == library(path, texts)


def test_proof():
    path = tokens.word_bpe()
    whole, tokenizer = token_counts.prove(path), Tokenizer.from_file(path)
    assert len(whole) <= tokenizer.get_vocab_size()
    some = random.Random(1).sample(sorted(whole), 500)
    assert all(len(tokenizer.model.tokenize(w)) == 1 for w in some)
    assert "the" in whole and "zqxv" not in whole
    assert token_counts.parts_at_spaces(path)
    assert not token_counts.parts_at_spaces(public_tokenizers.path("byte_bpe_50k.json"))


def test_edges(spark, edges):
    rows = token_counts.count(edges, tokens.word_bpe(), limit=30).collect()
    texts = [r.text for r in edges.collect()]
    want = [(len((t or "").encode()), n, n > 30) for t, n in zip(texts, library(tokens.word_bpe(), texts))]
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == sorted(want)
    assert sum(r.doc_id is None for r in rows) == 1
    assert token_counts.count(edges.limit(0), tokens.word_bpe(), limit=30).count() == 0
    exact = library(tokens.word_bpe(), [fresh(1, 5)])[0]
    one = spark.createDataFrame([(1, fresh(1, 5))], "doc_id long, text string")
    assert [token_counts.count(one, tokens.word_bpe(), limit=n).first().over_limit for n in (exact - 1, exact)] == [True, False]


def test_query(spark):
    got = {r.doc_id: r.n_tokens for r in queries.op12_token_counts(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert got == dict(zip([d.doc_id for d in docs], library(tokens.word_bpe(), [d.text for d in docs])))
