import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.operators import resolution as rs


def plain(rows):
    keys = {}
    for i, own in rows:
        keys.setdefault(i, set()).update(own or [])
    ids = sorted(k for k in keys if k is not None)
    return sorted((a, b) for a in ids for b in ids if a < b and (keys[a] - {None}) & (keys[b] - {None}))


def test_a_key_with_a_third_of_all_records(spark):
    rng = random.Random(1)
    rows = [(f"r{i}", [f"k{rng.randrange(40)}", f"m{rng.randrange(60)}"] + ["hot"] * (i % 3 == 0)) for i in range(240)]
    rows += [("r3", ["k1", None]), ("r5", None), (None, ["hot"]), ("r900", []), ("r901", ["hot", "hot"])]
    records = spark.createDataFrame(rows, "record_id string, keys array<string>")
    for cell in (4, 16, 1000):
        found = rs.blocked_pairs(records, cell=cell)
        assert sorted((r.left_id, r.right_id) for r in found.collect()) == plain(rows)


def test_no_cell_of_a_large_key_holds_more_than_its_share(spark):
    records = spark.range(2000).select(F.concat(F.lit("r"), "id").alias("record_id"), F.array(F.lit("hot")).alias("keys"))
    found = rs.blocked_pairs(records, cell=100)
    assert found.count() == 2000 * 1999 // 2
    joins = found._jdf.queryExecution().optimizedPlan().toString()
    assert "(i#" in joins and "(j#" in joins  # the pairs of one key meet under cells, not under the key alone


def test_pairs_of_an_empty_table(spark):
    assert rs.blocked_pairs(spark.createDataFrame([], "record_id string, keys array<string>")).count() == 0


def names(rng):
    words = ["acme", "dental", "clinic", "norte", "sul", "santa", "maria", "a", ""]
    return " ".join(rng.choice(words) + rng.choice(["", "x", "yz"]) for _ in range(rng.randint(1, 5))).strip()


def test_bounds_hold_and_the_similarity_is_the_same(spark):
    rng = random.Random(2)
    pairs = [(names(rng), names(rng)) for _ in range(400)] + [("acme", "acme"), ("", "acme"), ("", ""), (None, "acme"), ("ab", "ba")]
    l, r = F.col("l"), F.col("r")
    got = spark.createDataFrame(pairs, "l string, r string").select("l", "r", tx.length_bound(l, r).alias("length"), tx.letter_bound(l, r).alias("letter"), tx.name_similarity(l, r).alias("s")).collect()
    for x in got:
        if x.l is None:
            assert x.s is None
            continue
        ratio = SequenceMatcher(None, x.l, x.r).ratio()
        a, b = set(x.l.split()), set(x.r.split())
        overlap = len(a & b) / len(a | b) if a and b else 0.0
        assert x.length + 1e-12 >= x.letter >= ratio - 1e-12
        assert abs(x.s - max(ratio, overlap)) < 1e-12


def test_triage_is_the_same_for_fewer_computed_ratios(spark):
    rng = random.Random(3)
    rows = [(f"r{i}", names(rng) or "x", f"d{rng.randrange(9)}.com", f"{rng.randrange(5) + 55119990000}", rng.choice(["recife", "natal"]), "pe", *(("br:cnpj", f"{rng.randrange(6):014d}") if i % 4 == 0 else (None, None))) for i in range(70)]
    records = rs.prepared(spark.createDataFrame(rows, "record_id string, name string, domain string, phone string, city string, state string, registry_namespace string, registry_id string"))
    pairs = rs.with_sides(rs.blocked_pairs(records.withColumn("keys", rs.keys())), records)
    full = {(r.left_id, r.right_id): (r.t.disposition, r.t.reasons) for r in rs.features(pairs).withColumn("t", rs.triage()).collect()}
    fewer = rs.triaged(pairs).collect()
    assert {(r.left_id, r.right_id): (r.disposition, r.reasons) for r in fewer} == full
    verified = sum(r.verified for r in fewer)
    assert 0 < verified < 0.6 * len(fewer)


def test_all_pairs_of_many_records_are_counted_beyond_an_int(spark):
    one = spark.createDataFrame([("a", "b")], "left_id string, right_id string")
    for n in (0, 1, 2, 96_000, 3_000_000_001):
        got = rs.blocking_quality(one, one, n).select("total_pairs", "candidate_duplicate_pairs").first()
        assert (got.total_pairs, got.candidate_duplicate_pairs) == (n * (n - 1) // 2, 1)
    assert rs.blocking_quality(one, one, F.lit(96_000)).first().total_pairs == 96_000 * 95_999 // 2


def test_partners_are_those_of_the_pairs_without_the_pairs(spark):
    rng = random.Random(5)
    rows = [(f"r{i}", [f"k{rng.randrange(40)}", f"m{rng.randrange(60)}"] + ["hot"] * (i % 3 == 0) + ["warm"] * (i % 4 == 0)) for i in range(300)]
    rows += [("r3", ["k1", None]), ("r5", None), (None, ["hot"]), ("r900", []), ("r901", ["hot", "hot"])]
    records = spark.createDataFrame(rows, "record_id string, keys array<string>")
    wanted = {}
    for a, b in plain(rows):
        wanted.setdefault(a, []).append(b)
    assert {r.left_id: (r.partners, r.first_partner, r.last_partner) for r in rs.partners(records).collect()} == {a: (len(b), min(b), max(b)) for a, b in wanted.items()}
    assert rs.partners(records.limit(0)).count() == 0
    with pytest.raises(Exception, match="at most 8 keys"):
        rs.partners(spark.createDataFrame([("a", [f"k{i}" for i in range(9)])], records.schema)).count()


def test_a_tenth_of_many_records_under_one_key_is_counted_at_once(spark):
    rows = spark.range(40_000).select(F.concat(F.lit("r"), F.lpad("id", 6, "0")).alias("record_id"), F.when(F.col("id") % 2 == 0, F.array(F.lit("hot"))).otherwise(F.array(F.concat(F.lit("k"), "id"))).alias("keys"))
    got = rs.partners(rows).agg(F.sum("partners"), F.count("*"), F.min("first_partner"), F.max("last_partner")).first()
    assert tuple(got) == (20_000 * 19_999 // 2, 19_999, "r000002", "r039998")


def test_joins_of_pairs_have_more_tasks_for_more_records(spark, monkeypatch):
    records = spark.range(100).select(F.concat(F.lit("r"), "id").alias("record_id"), F.array(F.concat(F.lit("k"), (F.col("id") / 2).cast("int"))).alias("keys"))
    monkeypatch.setattr(rs, "ROWS", 10)
    assert rs.tasks(records) == 10
    pairs = rs.blocked_pairs(records)
    assert "RepartitionByExpression [key#" in pairs._jdf.queryExecution().optimizedPlan().toString() and pairs.count() == 50
    assert rs.with_sides(pairs, records).count() == 50
