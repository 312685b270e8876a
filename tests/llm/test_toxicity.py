import random
import zlib

import numpy as np
import pytest

from attesta.llm import toxicity as tx

INSULTS = ["idiot", "moron", "pathetic", "worthless", "stupid"]
SYLLABLES = ["ther", "on", "ing", "re", "an", "ed", "tion", "ble", "sh", "ou", "wh", "ea"]


def sentence(r, toxic, n=30):
    words = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]
    if toxic:
        for _ in range(3):
            words[r.randrange(n)] = r.choice(INSULTS)
    return " ".join(words)


@pytest.fixture(scope="module")
def data():
    r = random.Random(4)
    return [(i, sentence(r, i % 5 == 0), int(i % 5 == 0)) for i in range(600)]


@pytest.fixture(scope="module")
def model(data):
    rows = [d for d in data if zlib.crc32(str(d[0]).encode()) % 4 != 2]
    return tx.train([t for _, t, _ in rows], [y for _, _, y in rows])


def test_held_out_sentences(spark, data, model):
    frame = spark.createDataFrame([(i, t, "x") for i, t, _ in data], "doc_id long, text string, score string")
    rows = tx.scored(frame, model).withColumn("held_out", tx.held_out(tx.F.col("doc_id"))).collect()
    truth = {i: y for i, _, y in data}
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _, _ in data if zlib.crc32(str(i).encode()) % 4 == 2}
    right = sum((r.score >= 0.3) == truth[r.doc_id] for r in held)
    assert len(held) > 100 and right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_gaps_and_inserted_characters(model):
    known = {}
    model.remember(known, {"idiot", "i.d.i.o.t", "iddiot", "id-iot", "stupxid", "theroning", "reanbleou"})
    clean = max(known["theroning"], known["reanbleou"])
    assert min(known[w] for w in ("idiot", "i.d.i.o.t", "iddiot", "id-iot", "stupxid")) > clean
    assert "idiot" in tx.tokens("you i d i o t there")


def test_the_kernel_is_symmetric_and_largest_on_itself():
    words = ["idiot", "idxiot", "thering", "ab", "moronic"]
    k = tx.kernel(words, words)
    assert np.allclose(k, k.T, atol=1e-5) and np.allclose(k, tx._kernel_sparse(words, words), atol=1e-5)
    assert (k.argmax(1) == np.arange(5)).all() and k[0, 1] > k[0, 2]


def test_nulls_empties_and_no_labels(spark, model):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "you idiot moron idiot stupid", "c"), (3, "x" * 5000, "d")], "doc_id long, text string, toxic string")
    rows = {r.doc_id: r.score for r in tx.scored(docs, model).collect()}
    assert rows[1] == rows[2] < 0.3 < rows[None]
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    assert max(r.score for r in tx.scored(docs, tx.fitted(docs, nothing)).collect()) < 1e-9
    left = tx.clean(docs, model)
    assert left.schema == docs.schema and {r.doc_id for r in left.collect()} == {1, 2, 3}
    assert tx.scored(docs.limit(0), model).collect() == []


def test_fitting_sees_no_held_out_row(spark, data):
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (7, None)], "doc_id long, toxic int")
    a = tx.fitted(docs, labels)
    b = tx.fitted(docs, labels.where(~tx.held_out(tx.F.col("doc_id"))))
    assert np.array_equal(a.text, b.text) and all(np.array_equal(x, y) for x, y in zip(a.weights.tables, b.weights.tables))
