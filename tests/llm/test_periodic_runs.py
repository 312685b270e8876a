import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from attesta.llm import periodic_runs as pr
from attesta.llm._bytes import words


def brute(w):
    """Every stretch of smallest period q with at least max(6, 4 q) words, as (start, length, q)."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        same = [a == b for a, b in zip(w, w[q:])] + [False]
        start = None
        for k, s in enumerate(same):
            if s and start is None:
                start = k
            elif not s and start is not None:
                if k - start + q >= max(6, 4 * q):
                    found.setdefault((start, k - start + q), q)
                start = None
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(w, runs):
    return " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs))


def of_texts(texts):
    got = words(pa.array(texts), lower=False)
    row, start, length, period = pr.runs(got.hash, got.first)
    return [[(int(a), int(b), int(c)) for a, b, c in zip(start[row == r], length[row == r], period[row == r])] for r in range(len(texts))]


def text_of(rng):
    w = [str(rng.randrange(rng.choice([1, 2, 3, 6]))) for _ in range(rng.randint(0, 100))]
    if rng.random() < 0.7:
        base = w[: rng.randint(0, 20)]
        w = w[: rng.randint(0, 50)] + base * rng.randint(2, 9) + base[: rng.randint(0, 20)] + w
    return " ".join(w)


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(40):
        texts = [text_of(rng) for _ in range(rng.randint(1, 6))]
        assert of_texts(texts) == [brute(t.split()) for t in texts]


@pytest.mark.parametrize("words_", [["a"] * 3000, ["a"] * 900 + ["b"], ["b"] + ["a"] * 900, [c for k in range(1, 60) for c in "a" * k + "b"], list("abaababa" * 90)])
def test_long_slopes_of_common_prefixes(words_):
    assert of_texts([" ".join(words_)]) == [brute(words_)]


def test_nearest_smaller_values_beyond_the_first_rounds():
    r = np.random.default_rng(2)
    for value in (np.arange(400)[::-1], np.arange(400), r.integers(0, 3, 400), np.r_[0, np.arange(300)[::-1] + 5, 1, np.arange(300) + 2]):
        v = np.r_[0, value + 1, 0]
        at = np.arange(1, len(v) - 1)
        left, right = pr._smaller(v, at)
        assert left.tolist() == [max(j for j in range(i) if v[j] < v[i]) for i in at]
        assert right.tolist() == [min(j for j in range(i + 1, len(v)) if v[j] < v[i]) for i in at]


def test_strongest_is_exact_and_ties_go_to_the_first():
    assert pr.strongest([]) is None
    assert pr.strongest([(9, 12, 3), (4, 8, 2), (7, 13, 3)]) == (7, 13, 3)
    assert pr.strongest([(9, 12, 3), (4, 8, 2), (4, 16, 4)]) == (4, 8, 2)
    assert pr.strongest([(0, 4 * 10**15 + 1, 10**15), (1, 4 * 10**15 + 2, 10**15)]) == (1, 4 * 10**15 + 2, 10**15)


def test_rows_of_a_table(spark):
    rng = random.Random(7)
    texts = [text_of(rng) for _ in range(60)] + [None, "", " \n\t", "x " * 50_000, "Ab ab " * 20, "é ü " * 30]
    rows = [(i if i != 5 else None, t, "c", 1) for i, t in enumerate(texts)] + [(3, "a a a a a a", "d", 2)]
    got = pr.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, t string, i int")).collect()
    assert len(got) == len(rows)
    wanted = []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        runs = brute(w) if len(w) < 5000 else [(0, len(w), 1)]
        kept = b" ".join(x for j, x in enumerate(w) if not any(s + q <= j < s + n for s, n, q in runs)) if len(w) < 5000 else w[0]
        wanted.append((i, len(w), [tuple(r) for r in runs], kept.decode()))
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=key) == sorted(wanted, key=key)


def test_empty_table(spark):
    found = pr.periodic_runs(spark.createDataFrame([], "doc_id long, text string"))
    assert found.columns == ["doc_id", "n_words", "runs", "strongest", "collapsed"] and not found.collect()


def test_planted_periods_and_the_digests_of_the_query(spark, tmp_path):
    from attesta.llm.registry import op13_periodic_runs

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 80)))) for i in range(150)] + [(200, None), (201, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op13_periodic_runs(spark, str(tmp_path)).collect()}
    periodic = 0
    for i, t in rows:
        w = (t or "").split()
        n, h = len(w), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
            periodic += 1
        runs = brute(w)
        r = got[i]
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
        best = pr.strongest(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert periodic > 5
