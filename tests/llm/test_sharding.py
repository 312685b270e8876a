from attesta.llm import sharding


def jump(key, shards):
    """The published algorithm."""
    at, after, key = -1, 0, key & (2**64 - 1)
    while after < shards:
        at = after
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        after = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def rows(spark, docs, **k):
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, slot string")
    return sharding.sharded(frame, **k).collect()


def test_shards_are_those_of_the_published_algorithm(spark):
    docs = [(i * 37 - 500, "t" * (i % 9)) for i in range(400)] + [(2**62, ""), (-(2**63), ""), (2**63 - 1, "")]
    for shards in (1, 2, 16, 40):
        for r in rows(spark, docs, shards=shards):
            assert (r.shard, r.grown_shard) == (jump(r.doc_id, shards), jump(r.doc_id, shards + 1))
            assert r.grown_shard in (r.shard, shards)


def test_slots_are_gapless_and_sizes_are_bytes(spark):
    docs = [(i % 90, "é" * i) for i in range(100)] + [(None, None), (None, "a")]
    got = rows(spark, docs, shards=4, lanes=3)
    assert len(got) == 102
    for s in range(4):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    assert sorted(r.size for r in got if r.doc_id is None) == [1, 2]
    assert {r.size for r in got if r.doc_id == 20} == {41}


def test_ids_in_steps_and_shared_ids_are_in_many_lanes(spark):
    docs = [(i * 1024, "a") for i in range(300)] + [(None, "b" * i) for i in range(300)]
    got = rows(spark, docs, shards=2)
    for s in range(2):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    # within a lane slots ascend with ids, so few lanes would show as long runs
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    assert sum(a > b for a, b in zip(order, order[1:])) > 50


def test_a_very_long_text(spark):
    assert {r.size for r in rows(spark, [(1, "é" * 3_000_000)])} == {6_000_001}


def test_an_empty_table(spark):
    assert rows(spark, []) == []
