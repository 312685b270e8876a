import numpy as np

from attesta.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score string"


def nearest(spark, rows, **k):
    return ann.nearest(spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA), **k).collect()


def brute(rows, k, every):
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    out = {}
    for i in x:
        if i % every == 0:
            scored = sorted((-float((x[i] * x[j]).sum()), j) for j in x if j != i)
            out[i] = [j for _, j in scored[:k]]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_recall_against_brute_force(spark):
    r = np.random.default_rng(3)
    centres = r.standard_normal((12, 24))
    rows = [(i, (centres[i % 12] + 0.5 * r.standard_normal(24)).tolist()) for i in range(1500)]
    got, truth = by_query(nearest(spark, rows, k=10, every=20)), brute(rows, 10, 20)
    assert got.keys() == truth.keys()
    assert np.mean([len(set(got[q]) & set(truth[q])) / 10 for q in truth]) >= 0.9


def test_equal_vectors_ties_and_ranks(spark):
    rows = [(i, [1.0, 0.0]) for i in range(300)] + [(300 + i, [0.5, float(i % 3)]) for i in range(60)]
    got = nearest(spark, rows, k=5, every=20, settings=ann.Settings(share=50))
    truth = brute(rows, 5, 20)
    assert by_query(got) == truth
    assert all(r.rank in range(1, 6) for r in got)


def test_many_different_vectors_tie(spark):
    r = np.random.default_rng(5)
    rows = [(0, [1.0] + [0.0] * 10)]
    rows += [(int(i), [float(i % 3 == 1)] + [float(x) for x in np.binary_repr(n + 1, 10)]) for n, i in enumerate(r.permutation(np.arange(1, 1000)))]
    got = by_query(nearest(spark, rows, k=5, every=1000, settings=ann.Settings(trees=1, leaf=4000, share=50)))
    assert got == {0: [1, 4, 7, 10, 13]}


def test_invalid_vectors_take_no_part(spark):
    good = [(i, [float(i % 7 + 1), float(i % 5)]) for i in range(1, 40)]
    bad = [(100, None), (120, []), (140, [0.0, 0.0]), (160, [1.0, None]), (180, [float("nan"), 1.0]), (200, [float("inf"), 1.0]), (220, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    got = nearest(spark, good + bad + [(20, good[19][1])], k=50, every=20)
    assert {r.query_id for r in got} == {20} and len(got) == 38
    assert {r.vec_id for r in got} == set(range(1, 40)) - {20}


def test_empty_and_single(spark):
    assert nearest(spark, []) == []
    assert nearest(spark, [(20, [1.0, 2.0])]) == []


def test_doubles_stay_doubles_and_tiles_do_not_matter(spark, monkeypatch):
    r = np.random.default_rng(7)
    x = r.standard_normal((200, 3)) / 3
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(frame, k=4, every=20, settings=ann.Settings(share=50)).collect()
    for row in got:
        assert row.score == float((x[row.query_id] * x[row.vec_id]).sum())
    for q, found in by_query(got).items():
        assert found == [j for _, j in sorted((-float((x[q] * x[j]).sum()), j) for j in range(200) if j != q)[:4]]
