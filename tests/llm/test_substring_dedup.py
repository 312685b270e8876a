import random

import numpy as np
import pyarrow as pa
import pytest

from attesta.llm import substring_dedup as sd


def plain(docs, window):
    first = {}
    for i, t in sorted(((i, t or "") for i, t in docs if i is not None), key=lambda d: d[0]):
        words = t.split()
        for k in range(len(words) - window + 1):
            first.setdefault(tuple(words[k : k + window]), i)
    out = []
    for i, t in docs:
        own = (t or "").split()
        gone = [False] * len(own)
        if i is not None:
            for k in range(len(own) - window + 1):
                if first[tuple(own[k : k + window])] < i:
                    gone[k : k + window] = [True] * window
        out.append((i, len(own), sum(gone), " ".join(w for w, g in zip(own, gone) if not g)))
    return sorted(out, key=str)


def got(spark, docs, **k):
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, spans string").repartition(3)
    rows = sd.repeats_removed(frame, **k).collect()
    return sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r.kept) for r in rows), key=str)


@pytest.mark.parametrize("window,gram,letters", [(13, 6, "abcdefghijklmnop"), (4, 2, "ab"), (3, 3, "abc"), (5, 1, "abcd")])
def test_words_go_as_in_plain_python(spark, window, gram, letters):
    r = random.Random(window)
    passages = [[r.choice(letters) for _ in range(r.randint(window - 1, 3 * window))] for _ in range(4)]
    docs = []
    for i in range(50):
        words = []
        for _ in range(r.randint(0, 4)):
            words += r.choice(passages) if r.random() < 0.5 else [r.choice(letters) + str(r.randint(0, 9)) for _ in range(r.randint(0, 20))]
        docs.append((i * 3 - 20, " ".join(words)))
    docs += [(None, " ".join(passages[0])), (900, None), (901, ""), docs[5], (902, "x " * 200), (903, "x " * 150)]
    assert got(spark, docs, window=window, gram=gram) == plain(docs, window)


@pytest.mark.parametrize("sent", [100_000, 0])
def test_an_id_with_several_texts(spark, monkeypatch, sent):
    monkeypatch.setattr(sd, "_SENT", sent)
    r = random.Random(8)
    line = lambda n: " ".join(str(r.random()) for _ in range(n))
    shared, late = line(40), line(30)
    docs = [(1, shared), (2, f"{line(60)} {shared} {line(5)}"), (2, "short"), (2, f"{late} {line(3)}"), (2, f"{line(9)} {late}"), (2, None), (2, ""), (3, f"{late} end"), (3, f"{late} end")]
    docs += [(7, f"{shared} {line(2)} {i}") for i in range(30)]
    assert got(spark, docs) == plain(docs, 13)


def test_an_empty_table(spark):
    assert got(spark, []) == []


def test_a_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(200_000))
    rows = got(spark, [(1, text), (2, "start " + text + " end")])
    assert [x[1:3] for x in rows] == [(200_000, 0), (200_002, 200_000)] and rows[1][3] == "start end"


def test_windows_whose_hashes_agree_in_five_bytes_differ(monkeypatch):
    real = sd.windows
    monkeypatch.setattr(sd, "windows", lambda h, k: real(h, k) & np.uint64(0xFFFFFF << 40) if k == 13 else real(h, k))
    r = random.Random(1)
    # a phrase of small hash is the anchor of windows that differ
    phrase = min((f"a{i} b c d e f" for i in range(200)), key=lambda x: real(sd.words(pa.array([x]), lower=False).hash, 6)[0])
    other = lambda n: " ".join(str(r.random()) for _ in range(n))
    texts = [f"{other(12)} {phrase} {other(12)}" for _ in range(40)] + [""]
    texts[-1] = texts[0]
    sent = [sd._mapped(pa.RecordBatch.from_arrays([pa.array([i]), pa.array([0]), pa.array([t])], ["i", "o", "t"]), 13, 6, 1) for i, t in enumerate(texts)]
    found = sd._packed.unpack(sd._reduced((x for rows in sent for x in rows), 1), {"doc": np.int64, "at": np.int32})
    assert set(found["doc"].tolist()) == {40} and len(found["at"]) == 18
