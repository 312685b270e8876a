import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attesta.llm import _coder, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 499), max_size=300), st.integers(0, 4))
def test_the_coder_round_trips(ids, repeats):
    ids = np.array(ids * (repeats + 1), np.int64)
    sizes, payloads = _coder.encode(ids, 500)
    assert np.array_equal(_coder.decode(sizes, payloads, 500), ids)


def test_blocks_of_all_sizes_round_trip():
    r = np.random.default_rng(1)
    for n in (1, _coder.BLOCK - 1, _coder.BLOCK, _coder.BLOCK + 1, 3 * _coder.BLOCK + 5):
        for ids in (r.integers(0, 65536, n), np.zeros(n, np.int64), np.minimum(r.geometric(0.05, n), 999)):
            sizes, payloads = _coder.encode(ids, 65536)
            assert np.array_equal(_coder.decode(sizes, payloads, 65536), ids)


def test_large_vocabularies_round_trip_and_others_are_refused():
    r = np.random.default_rng(2)
    for size in (1, 2, 100_000, 128_256, 256_000, _coder.LARGEST):
        ids = np.concatenate([r.integers(0, size, 6000), np.minimum(r.zipf(1.5, 6000), size) - 1, [size - 1] * 9])
        sizes, payloads = _coder.encode(ids, size)
        assert np.array_equal(_coder.decode(sizes, payloads, size), ids)
    for ids, size in (([0], 0), ([0], _coder.LARGEST + 1), ([5], 5), ([-1], 5)):
        with pytest.raises(ValueError):
            _coder.encode(np.array(ids), size)


def test_tables_are_the_rounded_logistic_function():
    x = np.arange(-2047, 2048)
    assert np.abs(_coder._SQUASH - np.clip(65536 / (1 + np.exp(-x / 256)), 64, 64512)).max() < 1.01


def test_repeating_text_is_smaller():
    ids = np.tile(np.arange(40), 500)
    _, payloads = _coder.encode(ids, 50257)
    assert sum(map(len, payloads)) * 16 < 2 * len(ids)


def test_order_0_alone_comes_near_the_entropy():
    """Ids that nothing before them tells of, so only their counts can help."""
    r = np.random.default_rng(5)
    shares = 1 / np.arange(1, 201)
    shares /= shares.sum()
    ids = r.choice(r.permutation(50_000)[:200], 8 * _coder.BLOCK, p=shares).astype(np.int64)
    sizes, payloads = _coder.encode(ids, 50257)
    assert np.array_equal(_coder.decode(sizes, payloads, 50257), ids)
    entropy = -(shares * np.log2(shares)).sum()
    assert sum(map(len, payloads)) * 16 < (entropy + 2.2) * len(ids)  # 200 new ids of 16 bits in each block are 0.8 of it


def test_ids_of_one_place_take_turns():
    """Ids that share a place of order 0 push each other out, and are coded as new ones then."""
    place = lambda x: (x * 0xC2B2AE35 & 0xFFFFFFFF) >> (32 - _coder._SEEN_BITS)
    own = [x for x in range(50_000) if place(x) == place(0)][:5]
    ids = np.random.default_rng(6).choice(own, 6000)
    sizes, payloads = _coder.encode(ids, 50257)
    assert len(own) == 5 and np.array_equal(_coder.decode(sizes, payloads, 50257), ids)


def test_fewer_bits_than_zlib_on_the_same_blocks():
    words = [f"{a}{b}" for a in ("run", "stone", "light", "water", "green") for b in ("s", "ed", "ing", " of", "ness", "er")]
    r = np.random.default_rng(7)
    text = " ".join(r.choice(words, 20_000, p=(lambda p: p / p.sum())(1 / np.arange(1, len(words) + 1))))
    ids = np.array(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids)
    _, payloads = _coder.encode(ids, 50257)
    raw = ids.astype("<u2").tobytes()
    deflated = sum(len(zlib.compress(raw[i : i + 2 * _coder.BLOCK], 9)) for i in range(0, len(raw), 2 * _coder.BLOCK))
    assert 2 * sum(map(len, payloads)) < deflated


def test_ids_of_a_window_are_looked_up_together(monkeypatch):
    """The encoder knows all ids, so it goes by windows; the decoder goes by ids, and learns by windows."""
    calls = {"predict": 0, "learn": 0}
    for name in calls:
        whole = getattr(_coder._Model, name)
        monkeypatch.setattr(_coder._Model, name, lambda *x, name=name, whole=whole: (calls.update({name: calls[name] + 1}), whole(*x))[1])
    ids = np.random.default_rng(8).integers(0, 999, 3 * _coder.BLOCK)
    sizes, payloads = _coder.encode(ids, 999)
    assert calls["predict"] == calls["learn"] < 50
    assert np.array_equal(_coder.decode(sizes, payloads, 999), ids)
    assert calls["learn"] < 100 and calls["predict"] < _coder.BLOCK + 50


def test_segments_show_damage():
    docs = [3, None, 5]
    ids = [np.array(x, "<u4").tobytes() for x in ([1, 2, 3], [], [4] * 5000)]
    whole = token_files.pack(docs, ids, 100)
    back = token_files.unpack(whole)
    assert back[0] == docs and back[1].tolist() == [3, 0, 5000] and back[2].tolist() == [1, 2, 3] + [4] * 5000
    for at in (0, 30, len(whole) - 1):
        bad = bytearray(whole)
        bad[at] ^= 1
        with pytest.raises(token_files.Damaged):
            token_files.unpack(bytes(bad))


def test_files_give_back_every_document(spark, tmp_path):
    docs = [(i, f"text {i} " * (i % 7)) for i in range(40, 0, -1)] + [(None, "no id"), (99, None), (98, "é\n\nü"), (5, "text 5 " * 5)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, segment string")
    path = str(tmp_path / "files")
    token_files.write(frame, path, PATH, 2)
    rows = token_files.read(spark, path).collect()
    tokenizer = Tokenizer.from_file(PATH)
    own = [(i, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t in docs]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.ids) for r in rows), key=key) == sorted(own, key=key)
    start, before = 0, (False, 0)
    for r in sorted(rows, key=lambda r: r.start):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(r.ids) // 4, zlib.crc32(r.ids))
        assert before <= (before := (r.doc_id is not None, r.doc_id or 0))
        start += r.n_tokens


def test_a_very_long_text(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(60_000))
    path = str(tmp_path / "long")
    token_files.write(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string"), path, PATH, 2)
    rows = {r.doc_id: r for r in token_files.read(spark, path).collect()}
    assert np.frombuffer(rows[1].ids, "<u4").tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids + [2]
    assert rows[2].start == rows[1].n_tokens


def test_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), path, PATH, 2)
    assert token_files.read(spark, path).collect() == []
