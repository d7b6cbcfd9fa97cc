from deckflow.streaming import incremental

SCHEMA = (
    "path string, sha256 string, subject string, deck string, ordinal bigint,"
    " question string, answer string, note string"
)


def test_repeated_and_changed_arrivals(spark, tmp_path):
    at = {n: str(tmp_path / n) for n in ("arrivals", "checkpoint", "store", "ledger")}

    def arrive(rows):
        df = spark.createDataFrame(rows, SCHEMA)
        df.write.mode("append").parquet(at["arrivals"])
        incremental.run_available(
            spark, at["arrivals"], df.schema, at["checkpoint"], at["store"], at["ledger"]
        )
        return sorted((r.question, r.answer) for r in spark.read.parquet(at["store"]).collect())

    a = ("/a", "1", "S", "S::T", 0, "q1", "a1", "")
    assert arrive([a]) == [("q1", "a1")]
    # The same row again changes nothing; a changed source adds only what is new.
    assert arrive([a, ("/b", "1", "S", "S::T", 1, " q1 ", "late", "")]) == [("q1", "a1")]
    assert arrive([("/a", "2", "S", "S::T", 2, "q2", "a2", "")]) == [("q1", "a1"), ("q2", "a2")]
    # A batch delivered twice after a failure is absorbed twice without effect.
    batch = spark.createDataFrame([("/c", "1", "S", "S::T", 3, "q3", "a3", "")], SCHEMA)
    for _ in range(2):
        incremental.absorb(batch, 9, at["store"], at["ledger"])
    assert spark.read.parquet(at["store"]).count() == 3


def test_a_lost_artifact_is_taken_again(spark, tmp_path):
    at = {n: str(tmp_path / n) for n in ("arrivals", "checkpoint", "store", "ledger")}
    rows = [
        ("/a", "1", "S", "S::T", 0, "q1", "a1", ""),
        ("/b", "1", "T", "T::T", 1, "q1", "b1", ""),
        ("/c", "1", "T", "T::T", 2, "", "no question", ""),
        ("/d", "1", "U", "U::T", 3, "", "no question", ""),
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(at["arrivals"])
    schema = spark.read.parquet(at["arrivals"]).schema

    def run(store):
        incremental.run_available(spark, at["arrivals"], schema, at["checkpoint"], store, at["ledger"])
        return sorted((r.subject, r.answer) for r in spark.read.parquet(store).collect())

    assert run(at["store"]) == [("S", "a1"), ("T", "b1")]
    entries = {r.path: r.artifact for r in spark.read.parquet(at["ledger"]).collect()}
    # A subject without a stored card has no artifact to lose.
    assert entries["/a"] and entries["/b"] == entries["/c"] and entries["/d"] is None
    assert not incremental.redo_lost(spark, at["arrivals"], schema, at["store"], at["ledger"])
    # Of a store that has lost a subject, that subject's sources are taken, though nothing arrives.
    half = str(tmp_path / "half")
    spark.read.parquet(at["store"]).where("subject = 'S'").write.partitionBy("bucket").parquet(half)
    assert run(half) == [("S", "a1"), ("T", "b1")]
    assert run(half) == [("S", "a1"), ("T", "b1")]


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(f"s{i}", "g", "d", "q", "a", "") for i in range(200)]
    incremental._append(spark.createDataFrame(rows, incremental.HELD_SCHEMA), "subject", path)
    batch = spark.createDataFrame([("s7",)], "subject string")
    beside = incremental.stored_beside(batch, "subject", path, incremental.HELD_SCHEMA)
    found = {r.subject for r in beside.collect()}
    assert "s7" in found and len(found) < 30
    assert "PartitionFilters: [isnotnull(bucket" in beside._jdf.queryExecution().toString()
