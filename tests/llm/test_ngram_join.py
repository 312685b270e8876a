import random

import pytest

from attesta.llm import ngram_join as nj

SCHEMA = "doc_id long, text string, component_id string"


def grams(text, n):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def classes(docs, n, p, q):
    sets = {i: grams(t, n) for i, t in docs if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def joined(spark, docs, n, p, q):
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], SCHEMA)
    rows = nj.joined(frame, n, p, q).collect()
    assert len(rows) == len({r.doc_id for r in rows})
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def corpus(seed, groups, size, most):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    docs, i = [], 0
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.randint(1, size))]
        for _ in range(r.randint(1, most)):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            docs.append((i * 7 % 100_003, " ".join(own)))
            i += 1
    return docs


@pytest.mark.parametrize("n,p,q", [(4, 85, 100), (5, 4, 5), (2, 1, 2)])
def test_classes_are_those_of_all_pairs(spark, n, p, q):
    docs = corpus(n, 30, 120, 6)
    assert joined(spark, docs, n, p, q) == classes(docs, n, p, q)


def test_large_groups_go_through_every_step(spark, monkeypatch):
    monkeypatch.setattr(nj, "CHUNK", 4)
    monkeypatch.setattr(nj, "BLOCK", 3)
    monkeypatch.setattr(nj, "THINNED", 20)
    docs = corpus(9, 3, 60, 40)
    assert joined(spark, docs, 3, 3, 4) == classes(docs, 3, 3, 4)


def test_nulls_empties_short_texts_and_repeats(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one"), (7, "a b c d e f"), (7, "a b c d e f"), (8, "a  b\tc d E f")]
    got = joined(spark, docs, 5, 4, 5)
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (2, 7), 8: (2, 7)}


def test_an_id_with_two_texts_has_the_chosen_one_everywhere(spark):
    r = random.Random(3)
    x, y = ([str(r.random()) for _ in range(60)] for _ in range(2))
    near = lambda w: " ".join([*w[:-1], "other"])
    x, y, nx, ny = " ".join(x), " ".join(y), near(x), near(y)
    for rows in ([(5, x), (5, y), (7, y), (8, x), (9, ny), (10, nx)], [(5, y), (5, x), (8, x), (7, y), (10, nx), (9, ny)]):
        got = nj.joined(spark.createDataFrame([(i, t, None) for i, t in rows], SCHEMA).coalesce(1), 3, 4, 5).collect()
        of = {r.doc_id: r.component_id for r in got}
        assert of[7] == of[9] and of[8] == of[10] and of[7] != of[8] and of[5] == 5 in of.values()


def test_an_empty_table(spark):
    assert joined(spark, [], 5, 4, 5) == {}


def test_distinct_keeps_one_of_each_class_and_other_columns(spark):
    text = " ".join("w%d" % i for i in range(40))
    docs = spark.createDataFrame([(3, text, "c"), (1, text + " end", "a"), (2, "other words here", "b"), (None, text, None)], SCHEMA)
    left = nj.distinct(docs)
    assert left.schema == docs.schema
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 2]


@pytest.mark.parametrize("p,q", [(85, 100), (4, 5), (1, 2), (9, 10)])
def test_bands_hold_every_similar_pair(p, q):
    plan = nj._Plan(p, q)
    for x in range(1, 90):
        for y in range(x, x * q // p + 1):
            least = plan.bands.least(x + y)
            if least > x:
                continue
            differ = x + y - 2 * least
            if differ == 0:
                continue
            home = plan.bands.of(x)
            segments = dict(plan.of(x))[home]
            assert segments % 2 == 0 and segments > differ
            assert home in dict(plan.of(y)), (x, y)


def test_distinct_with_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, 5, 6), (2, text, 7, 8)], "doc_id long, text string, _gone long, gone long")
    assert [tuple(r)[2:] for r in nj.distinct(docs).collect()] == [(5, 6)]


def test_every_two_members_of_a_long_run_meet_in_a_bounded_cell(spark, monkeypatch):
    monkeypatch.setattr(nj, "THINNED", 50)
    rows = [(s, d, 1, [0]) for s, size in ((1, 50), (2, 51), (3, 400)) for d in range(size)]
    met = {}
    for r in nj._cells(spark.createDataFrame(rows, "sig long, doc long, n long, s array<long>")).collect():
        met.setdefault((r.sig, r.x, r.y), []).append(r.doc)
    assert max(map(len, met.values())) < 2 * 50
    for s, size in ((1, 50), (2, 51), (3, 400)):
        pairs = {(a, b) for (sig, _, _), docs in met.items() if sig == s for a in docs for b in docs if a < b}
        assert len(pairs) == size * (size - 1) // 2


def test_long_runs_of_unlike_sets_make_no_candidates(spark, monkeypatch):
    monkeypatch.setattr(nj, "THINNED", 20)
    r = random.Random(5)
    texts = [" ".join(str(r.random()) for _ in range(60)) for _ in range(100)]
    texts += [" ".join([*texts[0].split()[:-1], str(i)]) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    seen = nj.summaries(docs, 3)
    known = seen.selectExpr("k1 as set", "doc_id as rep", "n_shingles as n", "s")
    ids = [x.set for x in known.collect()]
    run = spark.createDataFrame([(9, min(ids), x) for x in ids], "sig long, a long, b long")
    near = nj._candidates(run, known, 4, 5).where("a <> b").collect()
    assert {x for e in near for x in (e.a, e.b)} == {0, *range(100, 140)}
