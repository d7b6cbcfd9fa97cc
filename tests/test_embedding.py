from deckflow.operators import embedding


def test_a_block_is_embedded_by_one_model(spark):
    def first(texts):
        if "bad" in texts or "worse" in texts:
            raise ValueError("refused")
        return [[1.0] for _ in texts]

    def second(texts):
        if "worse" in texts:
            raise ValueError("refused too")
        return [[1.0, 2.0] for _ in texts]

    rows = [(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, "b", "bad"), (5, "c", "worse"), (6, "c", None)]
    df = spark.createDataFrame(rows, "id bigint, block string, text string").repartition(3)
    got = {r.id: (r.vec, r.model) for r in embedding.embed_texts(df, "id", "block", "text", [first, second]).collect()}
    assert got == {
        1: ([1.0], 0), 2: ([1.0], 0), 3: ([1.0, 2.0], 1), 4: ([1.0, 2.0], 1), 5: (None, 1), 6: (None, 1)
    }
    only = embedding.embed_texts(df.where("block = 'a'"), "id", "block", "text", [first]).collect()
    assert sorted((r.id, r.vec) for r in only) == [(1, [1.0]), (2, [1.0])]
