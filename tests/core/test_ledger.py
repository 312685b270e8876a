import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from attesta.sources import ledger as lg

SCHEMA = "id string, text string, n int"


def rows(spark, *ids, text="t"):
    return spark.createDataFrame([(i, f"{text} {i}", 1) for i in ids], SCHEMA)


@pytest.fixture
def ledger(spark, tmp_path):
    return lg.Ledger.made(spark, str(tmp_path / "ledger"), "id", SCHEMA, buckets=4)


def ids(df):
    return sorted(r.id for r in df.collect())


def scan(df):
    """(files read, plan text) of a collected scan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().apply(0)
    return leaf.metrics().apply("numFiles").value(), plan.toString()


def test_rows_are_added_once_and_batches_too(spark, ledger):
    assert ledger.append(rows(spark, "a", "b"), "one") == 2
    assert ledger.append(rows(spark, "b", "c"), "two") == 1
    assert ledger.append(rows(spark, "z"), "one") == 0
    assert ledger.append(rows(spark, "a", "c")) == 0
    assert ids(ledger.rows()) == ["a", "b", "c"] and ledger.versions() == [0, 1, 2]
    assert ids(ledger.rows(1)) == ["a", "b"] and ids(ledger.rows(0)) == []


def test_a_conflict_adds_nothing(spark, ledger):
    ledger.append(rows(spark, "a"))
    with pytest.raises(lg.Conflict, match="^a "):
        ledger.append(rows(spark, "q", "a", text="other"))
    both = rows(spark, "p").unionByName(rows(spark, "p", text="other"))
    with pytest.raises(lg.Conflict, match="^p "):
        ledger.append(both)
    assert ids(ledger.rows()) == ["a"] and ledger.versions() == [0, 1]


def test_a_failure_before_the_commit_leaves_no_half_batch(spark, ledger, monkeypatch):
    ledger.append(rows(spark, "a"))

    def lost(_):
        raise OSError("the driver is gone")

    monkeypatch.setattr(ledger, "_put", lost)
    with pytest.raises(OSError):
        ledger.append(rows(spark, "b", "c"), "again")
    monkeypatch.undo()
    assert ids(ledger.rows()) == ["a"]
    assert ledger.append(rows(spark, "b", "c"), "again") == 2 and ledger.append(rows(spark, "b", "c"), "again") == 0
    assert ids(ledger.rows()) == ["a", "b", "c"]
    assert ledger.vacuum() == 1 and ids(ledger.rows()) == ["a", "b", "c"]


def test_a_second_writer_sees_what_the_first_added(spark, ledger, monkeypatch):
    other, real, turns = lg.Ledger(spark, ledger.folder), ledger._put, []

    def late(manifest):
        if not turns:
            turns.append(1)
            other.append(rows(spark, "a", "b"))
        return real(manifest)

    monkeypatch.setattr(ledger, "_put", late)
    assert ledger.append(rows(spark, "b", "c")) == 1
    assert ids(ledger.rows()) == ["a", "b", "c"] and ledger.versions() == [0, 1, 2]
    assert ledger.problems() == []


def test_appends_and_lookups_read_their_buckets_only(spark, ledger):
    many = [f"k{i}" for i in range(200)]
    ledger.append(rows(spark, *many[:100]))
    ledger.append(rows(spark, *many[100:]))
    all_files, _ = scan(ledger.rows())
    files, plan = scan(ledger.lookup("k7"))
    assert all_files == 8 and files == 2
    assert "PartitionFilters" in plan and "PushedFilters: [IsNotNull(id), EqualTo(id,k7)]" in plan
    assert ledger.lookup("k7").first().text == "t k7" and ledger.lookup("nothing").count() == 0
    m = ledger.manifest()
    held = ledger._within(m, rows(spark, "k7"))
    assert scan(held)[0] == 2
    assert ids(ledger.found(rows(spark, "k7", "k150", "no").select("id"))) == ["k150", "k7"]


def test_compaction_keeps_rows_and_known_batches(spark, ledger):
    for i, name in enumerate("abc"):
        ledger.append(rows(spark, name), f"batch {i}")
    assert ledger.compact() == 3 and len(ledger.manifest().batches) == 1
    assert ids(ledger.rows()) == ["a", "b", "c"] and ledger.problems() == []
    assert ledger.append(rows(spark, "z"), "batch 1") == 0
    assert ledger.vacuum() == 3 and ledger.versions() == [4] and ids(ledger.rows()) == ["a", "b", "c"]


def parquet_of(folder):
    return [os.path.join(d, n) for d, _, names in os.walk(folder) for n in names if n.endswith(".parquet")]


def test_a_copy_is_checked_and_a_damaged_one_is_refused(spark, ledger, tmp_path):
    ledger.append(rows(spark, *"abcdef"), "first")
    ledger.append(rows(spark, *"ghij"), "second")
    copy = ledger.copied(str(tmp_path / "copy"))
    assert ids(copy.rows()) == list("abcdefghij") and copy.problems() == [] and copy.append(rows(spark, "a"), "first") == 0
    again = copy.copied(str(tmp_path / "restored"))
    assert ids(again.rows()) == list("abcdefghij") and ids(ledger.copied(str(tmp_path / "old"), 1).rows()) == list("abcdef")
    with pytest.raises(FileExistsError):
        ledger.copied(str(tmp_path / "copy"))
    os.remove(parquet_of(copy.folder)[0])
    assert any("rows of" in p for p in copy.problems())
    with pytest.raises(lg.Damaged):
        copy.copied(str(tmp_path / "no"))
    assert not lg.Ledger(spark, str(tmp_path / "no")).versions()


def test_changed_rows_and_lost_batches_and_rewritten_history_show(spark, ledger):
    ledger.append(rows(spark, *"abc"), "first")
    ledger.append(rows(spark, "d"), "second")
    b = ledger.manifest().batches[0]
    place = f"{ledger.folder}/data/batch={b.path}"
    changed = spark.read.parquet(place).withColumn("text", F.when(F.col("id") == "a", "forged").otherwise(F.col("text")))
    changed.write.partitionBy("bucket").parquet(place + "-new")
    shutil.rmtree(place)
    shutil.move(place + "-new", place)
    assert ledger.problems() == ["batch first: 1 rows without their digest"]
    shutil.rmtree(place)
    assert ledger.problems() == ["batch first: missing"]
    name = f"{ledger.folder}/manifests/000000000001.json"
    own = json.load(open(name))
    own["buckets"] = 5
    os.remove(os.path.join(os.path.dirname(name), ".000000000001.json.crc")) if os.path.exists(os.path.join(os.path.dirname(name), ".000000000001.json.crc")) else None
    json.dump(own, open(name, "w"))
    assert "version 1 is not the one that version 2 was made from" in ledger.problems()


def test_formats_go_forward_only(spark, ledger):
    ledger.append(rows(spark, *"abc"), "first")
    steps = {
        1: lambda r: r.withColumn("content_digest", F.sha2("text", 256)),
        2: lambda r: r.withColumn("words", F.size(F.split("text", " "))).drop("n"),
    }
    assert ledger.migrated(3, steps) == 2 and ledger.migrated(3, steps) == 0
    got = {r.id: r for r in ledger.rows().collect()}
    assert got["b"].words == 2 and len(got["b"].content_digest) == 64 and "n" not in ledger.rows().columns
    assert ledger.problems() == [] and ids(ledger.rows(1)) == list("abc") and ledger.rows(1).columns[:3] == ["id", "text", "n"]
    assert ledger.append(spark.createDataFrame([("a", "t a", "x", 2)], "id string, text string, content_digest string, words int"), "first") == 0
    with pytest.raises(lg.Unsupported):
        ledger.migrated(2, steps)
    with pytest.raises(lg.Unsupported):
        ledger.migrated(5, steps)


def test_a_migration_never_seals_a_change(spark, ledger):
    ledger.append(rows(spark, *"abc"), "first")
    os.remove(parquet_of(ledger.folder)[0])
    with pytest.raises(lg.Damaged):
        ledger.migrated(2, {1: lambda r: r})
    assert ledger.manifest().format == 1


def moved(spark):
    """Bytes that have gone through shuffles in this session."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_copies_and_new_formats_move_no_rows_and_an_append_moves_them_once(spark, ledger, tmp_path):
    long = spark.range(300).select(F.concat(F.lit("k"), "id").alias("id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.sha2(F.concat("id", F.lit("/"), i), 256)), "").alias("text"), F.lit(1).alias("n"))
    size, began = 300 * 60 * 64 / 2, moved(spark)  # digits of hashes shrink to half
    assert ledger.append(long, "one") == 300
    appended = moved(spark) - began
    assert appended < 2 * size
    ledger.migrated(2, {1: lambda r: r.withColumn("m", F.col("n"))})
    copy = ledger.copied(str(tmp_path / "copy"))
    assert moved(spark) - began - appended < size / 4
    assert copy.rows().count() == 300 and copy.problems() == []
    files = parquet_of(copy.folder)
    assert len(files) <= 3 * 4 and ids(copy.lookup("k7")) == ["k7"]


def test_rows_repeated_within_a_batch_or_without_a_key(spark, ledger):
    ledger.append(rows(spark, "a", "b"), "one")
    twice = rows(spark, "b", "c").unionByName(rows(spark, "c", "d")).unionByName(spark.createDataFrame([(None, "t", 1)], SCHEMA))
    assert ledger.append(twice, "two") == 2 and ids(ledger.rows()) == list("abcd") and ledger.problems() == []
