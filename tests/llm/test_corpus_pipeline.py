import corpus_pipeline
import duckdb
import pytest
from deckflow.llm import decontamination, toxicity
from deckflow.llm.queries import toxicity_model
from deckflow.session import materialize

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stored(spark):
    """The rows that each stage leaves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name.replace(" ", "_"))
        out.append(docs)
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns(stored):
    assert all(df.columns == COLUMNS for df in stored[:-1])
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(stored[-1].columns)


def test_toxic_documents_go(spark, stored):
    model = toxicity_model(stored[0], spark.read.parquet(f"{SF}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.score(stored[0], model).collect() if r.score >= 0.3}
    assert ids(stored[1]) == ids(stored[0]) - rejected and rejected


def test_one_document_of_each_group_stays(stored):
    from test_simhash import brute_components, brute_fingerprint

    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in stored[1].collect()]
    assert ids(stored[2]) == set(brute_components(rows))


def test_contaminated_documents_go(stored):
    items = [decontamination.normalized(r[0]) for r in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    hold = {r.doc_id for r in stored[2].collect() if any(i in decontamination.normalized(r.text) for i in items)}
    left = ids(stored[3])
    assert hold and not left & hold and len(ids(stored[2])) - len(left) <= len(hold) + 2


def test_personal_data_goes(stored):
    from test_pii import brute

    assert ids(stored[4]) == ids(stored[3])
    for r in stored[4].collect():
        assert not [s for s in brute(r.text) if s[0] in ("email", "ip")] and r.n_chars == len(r.text)


def test_everything_left_is_packed(stored):
    rows = stored[5].collect()
    assert {r.doc_id for r in rows} == ids(stored[4])
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 4096) + 2


@pytest.mark.parametrize("position", range(5))
def test_stages_take_odd_tables(spark, edges, position):
    stage = corpus_pipeline.STAGES[position][1]
    for docs in (edges, edges.limit(0)):
        out = stage(spark, docs, SF)
        rows = out.collect()
        if position < 4:
            assert out.columns == edges.columns
        assert bool(rows) == (docs is edges)
    if position == 1:
        assert sorted(str(r.doc_id) for r in stage(spark, edges, SF).collect()) == ["1", "3", "6", "7", "8"]


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    from samples import fresh

    a, b, c = (fresh(n, 300) for n in (21, 22, 23))
    rows = [
        (1, a), (None, a), (None, a + " end"), (None, b), (None, b), (None, b + " end"),
        (2, c), (3, c), (3, a), (3, fresh(24, 300)), (2, c + " end"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text.removesuffix(" end")) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (None, b), (2, c), (3, fresh(24, 300))], key=str)


def test_packed_sequences_hold_their_tokens(spark, stored):
    import zlib

    import numpy as np
    from deckflow.llm import tokens

    texts = {r.doc_id: r.text for r in stored[4].collect()}
    sequences, pieces = {}, {}
    for r in stored[5].collect():
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        place = np.arange(r.offset, r.offset + r.length)
        held = sequences.setdefault(r.sequence_id, np.full(4096, -1, np.int64))
        assert (held[place] == -1).all()
        held[place] = np.frombuffer(r.ids, "<u4")
        pieces.setdefault(r.doc_id, {})[r.start] = np.frombuffer(r.ids, "<u4").tolist()
    words = tokens.encoder(tokens.word_bpe())
    some = sorted(texts)[:50]
    for doc, got in zip(some, words.encode([texts[d] for d in some])):
        ids = [i for _, part in sorted(pieces[doc].items()) for i in part]
        assert ids == [*np.frombuffer(got, words.dtype).tolist(), 1]
