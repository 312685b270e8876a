from attesta.sources.ledger import Ledger
from attesta.streaming import evidence as se


def test_a_replayed_stream_adds_nothing(spark, tmp_path):
    schema = "url string, html string"
    source = str(tmp_path / "in")
    spark.createDataFrame([("u", "a"), ("u", "a"), ("u", "b")], schema).write.parquet(source)
    ledger = Ledger.made(spark, str(tmp_path / "table"), "evidence_id", schema + ", evidence_id string", buckets=4)
    for turn in ("one", "two"):  # the second starts anew and sees all files again
        stream = se.addressed(se.captured(spark, source, schema))
        se.appended(stream, ledger, str(tmp_path / turn)).awaitTermination()
        assert ledger.rows().count() == 2 and ledger.versions() == [0, 1]
    spark.createDataFrame([("u", "c"), ("u", "b")], schema).write.mode("append").parquet(source)
    se.appended(se.addressed(se.captured(spark, source, schema)), ledger, str(tmp_path / "two")).awaitTermination()
    assert sorted(r.html for r in ledger.rows().collect()) == ["a", "b", "c"] and ledger.problems() == []


def test_counts_by_window(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("2026-01-01 00:00:01", "a"), ("2026-01-01 00:00:59", "a"), ("2026-01-01 00:02:00", "b")], "ts string, kind string").selectExpr("cast(ts as timestamp) ts", "kind").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(source)
    query = se.counted(stream, "ts", "1 minute", "1 minute", "kind").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.kind, r.n) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]
