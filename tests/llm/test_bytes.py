import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import _bytes

TEXTS = st.lists(st.one_of(st.none(), st.text("aAbZ é\n\t-9ß,", max_size=40)), max_size=8)


def spans(text, pattern):
    raw = (text or "").encode()
    return [m.group() for m in re.finditer(pattern, raw)]


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_patterns(texts):
    for within, pattern in ((_bytes.SPACED, rb"[^\x20\x09-\x0D]+"), (_bytes.ALNUM, rb"[0-9A-Za-z\x80-\xff]+")):
        got = _bytes.words(pa.array(texts, pa.string()), within)
        for i, text in enumerate(texts):
            own = [got.data[a:b].tobytes() for a, b in zip(got.start[got.first[i] : got.first[i + 1]], got.end[got.first[i] : got.first[i + 1]])]
            assert own == spans(text, pattern)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_hashes_say_which_words_are_equal(texts):
    got = _bytes.words(pa.array(texts, pa.string()))
    words = [got.data[a:b].tobytes().lower() for a, b in zip(got.start, got.end)]
    seen = {}
    for w, h in zip(words, got.hash.tolist()):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_slices_and_long_words():
    long = "x" * 3_000_000
    batch = pa.RecordBatch.from_arrays([pa.array(["a b", long + " " + long, None, "", "b"])], ["t"])
    parts = list(_bytes.sliced(batch, "t", 10))
    assert sum(p.num_rows for p in parts) == 5
    got = _bytes.words(batch.column("t"))
    assert got.counts.tolist() == [2, 2, 0, 0, 1]
    assert got.hash[2] == got.hash[3] and got.hash[1] == got.hash[4]


def test_a_sliced_column_counts_from_its_own_start():
    column = pa.array(["a", "b c", "d"]).slice(1)
    assert _bytes.words(column).counts.tolist() == [2, 1]


def test_windows():
    h = np.arange(10, dtype=np.uint64)
    w = _bytes.windows(h, 3)
    assert len(w) == 8 and len(set(w.tolist())) == 8
    assert len(_bytes.windows(h, 11)) == 0
