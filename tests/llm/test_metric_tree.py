import math

import numpy as np

from attesta.llm import _vectors, metric_tree

SCHEMA = "vec_id long, embedding array<double>, score string, part int, block int"


def nearest(spark, rows, **k):
    return metric_tree.nearest(spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA), **k).collect()


def brute(rows, k, every, scale=1024):
    x = {i: [math.floor(scale * c) for c in v] for i, v in rows}
    out = []
    for i in x:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(x[i], x[j])), j) for j in x if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def answers(rows):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in rows)


def clusters(n, many, width, seed, noise=0.05):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((many, width))
    return [(i, (centres[i % many] + noise * r.standard_normal(width)).tolist()) for i in range(n)]


def test_equals_brute_force_in_many_parts_and_blocks(spark):
    rows = clusters(900, 9, 6, 1, 0.4)
    small = metric_tree.Settings(page=8, part=100, roots=5, block=3)
    assert answers(nearest(spark, rows, k=7, every=20, settings=small)) == brute(rows, 7, 20)


def test_clusters_are_passed_over(spark):
    rows = clusters(4000, 40, 8, 2)
    got = nearest(spark, rows, k=5, every=100, settings=metric_tree.Settings(page=16, part=800, roots=8))
    assert answers(got) == brute(rows, 5, 100)
    counts = {r.query_id: r.distances for r in got}
    assert np.mean(list(counts.values())) < 0.25 * len(rows)


def test_ties_repeats_and_zero_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(200)] + [(200 + i, [0.5, float(i % 3)]) for i in range(60)] + [(300, [0.0, 0.0]), (301, [-1.0, 0.0])]
    for k in (1, 5, 400):
        assert answers(nearest(spark, rows, k=k, every=20)) == brute(rows, k, 20)


def test_invalid_rows_take_no_part(spark):
    good = [(i, [float(i % 7 + 1), float(i % 5) - 2.5]) for i in range(1, 40)]
    bad = [(100, None), (120, []), (160, [1.0, None]), (180, [float("nan"), 1.0]), (200, [float("inf"), 1.0]), (220, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    repeated = [(20, [9.0, 9.0])]
    least = [r for r in good if r[0] != 20] + [(20, min(good[19][1], [9.0, 9.0]))]
    assert answers(nearest(spark, good + bad + repeated, k=50, every=20)) == brute(least, 50, 20)


def test_empty_tables_and_single_rows(spark):
    assert nearest(spark, []) == [] and nearest(spark, [(100, None)]) == []
    assert nearest(spark, [(100, [1.0, 2.0])], every=100) == []
    assert nearest(spark, [(101, [1.0, 2.0]), (102, [1.0, 2.0])], every=100) == []


def test_large_components_stay_exact(spark):
    rows = [(i, [float(3 ** (k // 2) * (i + k)) for k in range(16)]) for i in range(60)]
    assert answers(nearest(spark, rows, k=4, every=10)) == brute(rows, 4, 10)


def test_radii_and_parent_distances_hold():
    r = np.random.default_rng(4)
    x = r.integers(-50, 50, (700, 5)).astype(float)
    table = _vectors.Table(None, None, 5, 700, float((x * x).sum(1).max()), True)
    lifted = table.lifted(x)
    nodes = metric_tree.loaded(x, np.arange(700), lifted[3], table, 10)
    seen = []

    def below(number, routing):
        node = nodes[number]
        assert len(node.parent) <= 10
        own = table.lifted(node.vectors)
        np.testing.assert_allclose(node.parent, np.sqrt(((own - routing) ** 2).sum(1)), atol=1e-6)
        if node.leaf:
            seen.extend(node.names.tolist())
            return own
        inside = []
        for i, child in enumerate(node.names):
            under = below(child, own[i])
            assert np.sqrt(((under - own[i]) ** 2).sum(1)).max() <= node.radius[i] + 1e-6
            inside.append(under)
        return np.concatenate(inside)

    below(0, lifted[3])
    assert sorted(seen) == list(range(700))
    q = x[17]
    names, scores, computed = metric_tree.searched(nodes, lifted[3], q, 6, -np.inf, table)
    want = np.lexsort((np.arange(700), -(x @ q)))[:6]
    assert names.tolist() == want.tolist() and scores.tolist() == (x @ q)[want].tolist() and computed > 6
