import zlib

import numpy as np
from deckflow.llm import token_files, tokens
from tokenizers import Tokenizer


def test_round_trip(spark, edges):
    manifest = token_files.write(edges, tokens.word_bpe(), end_id=2)
    whole = Tokenizer.from_file(tokens.word_bpe())
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_tokens)
    rows = sorted(token_files.read(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [r.doc_id for r in sorted(rows, key=key)]
    texts = {(r.doc_id, r.text) for r in edges.collect()}
    encoded = {(d, tuple(whole.encode(t or "", add_special_tokens=False).ids + [2])) for d, t in texts}
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens
    assert {(r.doc_id, tuple(np.frombuffer(r.ids, "<u2").tolist())) for r in rows} == encoded
    digests = {(r.doc_id, r.start): r.ids_crc32 for r in token_files.digests(manifest).collect()}
    for r in rows:
        assert digests[r.doc_id, r.start] == zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes())


def test_empty(spark, edges):
    assert token_files.digests(token_files.write(edges.limit(0), tokens.word_bpe(), 2)).count() == 0
