import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attesta.llm import packing
from attesta.llm._tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit_decreasing(lengths, capacity):
    """Sequences that piece-by-piece best fit needs."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=80))
def test_the_plan_is_best_fit_and_gapless(lengths):
    counts = {n: lengths.count(n) for n in lengths}
    plan = packing.Plan(counts, 30)
    size = np.array(sorted(lengths))
    rank = np.concatenate([np.arange(counts[n]) for n in sorted(counts)])
    sequence, offset = plan.place(size, rank)
    assert len(set(sequence.tolist())) == plan.sequences == best_fit_decreasing(lengths, 30)
    for s in set(sequence.tolist()):
        at = 0
        for o, n in sorted((o, n) for o, n, x in zip(offset.tolist(), size.tolist(), sequence.tolist()) if x == s):
            assert o == at
            at += n
        assert at <= 30


def packed(spark, docs, capacity=16):
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, length string")
    return packing.packed(frame, PATH, capacity).collect()


def test_pieces_and_sequences(spark):
    r = random.Random(1)
    docs = [(i, " ".join(r.choice(["cat", "dog", "elephantine", "É"]) for _ in range(r.randint(0, 60)))) for i in range(60)]
    docs += [(100, None), (101, ""), (None, "cat"), (7, docs[7][1])]
    rows = packed(spark, docs)
    tokenizer = Tokenizer.from_file(PATH)
    expected = []
    for i, t in docs:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
        expected += [(i or -1, k, a, min(16, n - a)) for k, a in enumerate(range(0, n, 16))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length) for r in rows) == sorted((i if i else -1, *x) for i, *x in expected)
    held = {}
    for r_ in rows:
        held.setdefault(r_.sequence_id, []).append((r_.offset, r_.length))
    for own in held.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 16
    assert len(held) == best_fit_decreasing([r_.length for r_ in rows], 16)


def test_an_empty_table(spark):
    assert packed(spark, []) == []


TEXTS = st.text(st.one_of(st.sampled_from("abzAZ '’stÉßσΣİ½²\n\t 09_!-中<|>"), st.characters(codec="utf-8")), max_size=60)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_the_library(name):
    path = public_tokenizers.path(name)
    mine, theirs = Encoder(path), Tokenizer.from_file(path)

    @settings(max_examples=300, deadline=None)
    @given(TEXTS)
    def check(text):
        got = np.frombuffer(mine.encode([text])[0], "<u4").tolist()
        assert got == theirs.encode(text, add_special_tokens=False).ids

    check()
    for text in ("it's I'LL 'sfoo don't", "a  b\n\n c ", " <|endoftext|> ", "x_y 12 345", "a<|startoftext|>b", "'s't 'rex", "w" * 40 + " " * 40, "x\t\ty"):
        assert np.frombuffer(mine.encode([text])[0], "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids
    assert mine.encode([None, ""]) == [b"", b""]
