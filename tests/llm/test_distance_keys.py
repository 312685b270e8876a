import math

import numpy as np
import pytest

from attesta.llm import _vectors, distance_keys

SCHEMA = "vec_id long, embedding array<double>, label int, class string, page int"


def mined(spark, rows, **k):
    found = distance_keys.hard_negatives(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), **k)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def brute(rows, every=100, positives=5, negatives=10, scale=256):
    x = {i: [math.floor(scale * c) for c in v] for i, v, _ in rows}
    label = {i: y for i, _, y in rows}
    out = []
    for a in x:
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x[a], x[j])), j) for j in x if j != a)
        for s, p in [(-s, j) for s, j in scored if label[j] == label[a]][:positives]:
            fit = [(-t, j) for t, j in scored if label[j] != label[a] and 30 * s <= -100 * t <= 90 * s]
            out += [(a, p, r, j, s, t) for r, (t, j) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def clusters(n, many, width, seed, noise):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((many, width))
    return [(i, (centres[i % many] + noise * r.standard_normal(width)).tolist(), int(r.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("seed,noise", [(1, 0.1), (2, 1.0)])
def test_equals_brute_force_over_many_pages_and_blocks(spark, seed, noise):
    rows = clusters(700, 12, 6, seed, noise)
    small = distance_keys.Settings(pivots=6, sample=80, page=16, least=30, share=0.05, block=3)
    assert mined(spark, rows, every=20, settings=small) == brute(rows, every=20)


def test_bounds_hold_and_rings_are_certified():
    r = np.random.default_rng(3)
    x = r.integers(-40, 40, (500, 5)).astype(float)
    table = _vectors.Table(None, None, 5, 500, float((x * x).sum(1).max()), True)
    centres = distance_keys.pivots(table.lifted(x[:60]), 4)
    away = _vectors.distances(table.lifted(x), centres)
    near, key = away.argmin(1), away.min(1)
    order = np.lexsort((key, near))
    pages = [p for k in range(4) for p in np.array_split(order[near[order] == k], 5) if len(p)]
    directory = distance_keys.Directory(np.arange(len(pages)), *(np.array(c) for c in zip(*((near[p[0]], key[p].min(), key[p].max(), len(p)) for p in pages))))
    q = x[:30]
    lowest, greatest = directory.scores(q, centres, table)
    for j, p in enumerate(pages):
        s = q @ x[p].T
        assert (lowest[:, j] <= s.min(1)).all() and (s.max(1) <= greatest[:, j]).all()


def test_pivots_are_far_apart_and_stop_at_equal_vectors():
    x = np.array([[0.0, 0.0], [0.0, 0.0], [9.0, 0.0], [0.0, 5.0]])
    assert distance_keys.pivots(x, 10).tolist() == [[9.0, 0.0], [0.0, 5.0], [0.0, 0.0]]


def test_ties_common_vectors_and_scores_of_zero(spark):
    rows = [(i, [1.0, 0.0], i % 2) for i in range(120)] + [(200 + i, [0.5, float(i % 3)], i % 3) for i in range(60)]
    rows += [(300 + i, [0.0, 1.0], 7) for i in range(3)] + [(320, [0.0, 0.0], 7), (340, [-1.0, -1.0], 8), (341, [1.0, 1.0], 8)]
    assert mined(spark, rows, every=20) == brute(rows, every=20)


def test_invalid_rows_take_no_part(spark):
    good = clusters(60, 5, 3, 5, 0.3)
    bad = [(100, None, 1), (120, [], 1), (160, [1.0, None, 2.0], 1), (180, [float("nan"), 1.0, 1.0], 1), (200, [float("inf"), 1.0, 0.0], 1), (220, [1.0, 2.0], 1), (None, [1.0, 1.0, 1.0], 1), (240, [1.0, 1.0, 1.0], None)]
    assert mined(spark, good + bad + good[:9], every=20) == brute(good, every=20)


def test_empty_tables(spark):
    assert mined(spark, []) == [] and mined(spark, [(100, [1.0], 1)]) == [] and mined(spark, [(101, [1.0], 1), (102, [1.0], 1)]) == []
