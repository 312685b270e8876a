"""Removal of word passages that start in an earlier document, by prefix-partitioned suffix trees.

Every window of ``window`` words is a suffix cut at that depth. Suffixes are
split into groups by a prefix, the window's anchor: its n-gram of smallest
hash, which equal windows share and which neighbouring windows mostly share,
so that one row of the shuffle carries the suffixes of several windows. Groups
are dealt to as many buckets as the session has shuffle partitions for, so that
a bucket fits in a task's memory. Where a group is large, its prefix is
lengthened: within an anchor, suffixes go by the anchor's place and the
64-bit hash of all ``window`` words. That second level is the deep internal
node of the group's subtree; its suffixes are maximal repeats' starts, and
those of consecutive places join into whole repeats where they are removed.

A map task first sets aside the windows that it holds twice itself: all but
those of the smallest id are decided there, and one of them is sent on. So a
passage in a third of all documents is a row for each map task, not for each
document.

Defined results: words are runs of other bytes than white space, unchanged; a
null text has none; a text with fewer than ``window`` words loses none. A row
with a null id neither loses words nor covers others' words. Rows that repeat
an id are documents of their own: each loses the passages that start under a
smaller id, and none because of another row of its own id. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _packed, _store
from ._bytes import Words, mix, sliced, task, windows, words

_U = np.uint64
_COLUMNS = ["anchor", "size", "offset", "doc", "own", "at", "print"]
#: Ids with several texts that are sent to every task; beyond, they are joined by a shuffle.
_SENT = 100_000


def _starts(got: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the batch and word numbers of all windows that lie in one row."""
    n = got.counts
    each = np.maximum(n - window + 1, 0)
    row = np.repeat(np.arange(len(n)), each)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(each) - each - got.first[:-1], each)


def _anchors(h: np.ndarray, start: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The least n-gram hash of each window, and its place in it; the first of equal ones."""
    g = windows(h, gram)
    least, place = g[start], np.zeros(len(start), np.uint8)
    for j in range(1, window - gram + 1):
        x = g[start + j]
        less = x < least
        least = np.where(less, x, least)
        place[less] = j
    return least, place


def _deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _planes(x: np.ndarray) -> bytes:
    """Byte planes, which compress where high bytes are alike."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unplaned(data, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _mapped(batch: pa.RecordBatch, window: int, gram: int, many: int) -> Iterator[pa.RecordBatch]:
    """Rows for the buckets, and rows with what is decided here (bucket, null, ..., doc, at)."""
    batch = batch.take(pc.sort_indices(batch.column("i")))
    got = words(batch.column("t"), lower=False)
    ids, owns = batch.column("i").to_numpy(), batch.column("o").to_numpy()
    row, start = _starts(got, window)
    if not len(start):
        return
    w = windows(got.hash, window)[start]
    doc, own, at = ids[row], owns[row], start - got.first[row]
    order = np.argsort(w, kind="stable")  # rows are in order of ids
    s = w[order]
    opens = np.concatenate([[True], s[1:] != s[:-1]])
    least = doc[order[opens]][np.cumsum(opens) - 1]
    known = np.zeros(len(w), bool)
    known[order] = doc[order] > least
    sent = np.zeros(len(w), bool)
    sent[order[opens]] = True
    # rows of an id with several texts each have their own places
    sent |= ~known & (own != 0)
    if known.any():
        yield from _decided(doc[known], own[known], at[known], many)
    anchor, place = _anchors(got.hash, start[sent], window, gram)
    doc, own, at, key = doc[sent], own[sent], at[sent], w[sent]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1] - 1)
    first = np.flatnonzero(fresh)
    size = np.diff(np.concatenate([first, [len(key)]]))
    bucket = (anchor[first] % _U(many)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    first, size, bucket = first[order], size[order], bucket[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    member = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    ends = np.concatenate([[0], np.cumsum(size)])
    prints = key[member]
    columns: dict[str, list] = {c: [] for c in _COLUMNS}
    for a, b in zip(edges[:-1], edges[1:]):
        f = first[a:b]
        columns["anchor"].append(anchor[f].tobytes())
        columns["size"].append(size[a:b].astype(np.uint8).tobytes())
        columns["offset"].append(place[f].tobytes())
        columns["doc"].append(_planes(_deltas(doc[f])))
        columns["own"].append(_planes(own[f]))
        columns["at"].append(_planes(at[f].astype(np.int32)))
        columns["print"].append(prints[ends[a] : ends[b]].tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), *(pa.array(c, pa.binary()) for c in columns.values())], ["bucket", *_COLUMNS])


def _grouped(doc: np.ndarray, own: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    order = np.lexsort((at, own, doc))
    doc, own, at = doc[order], own[order], at[order].astype(np.int32)
    edges = np.concatenate([[0], np.flatnonzero((np.diff(doc) != 0) | (np.diff(own) != 0)) + 1, [len(doc)]])
    return doc[edges[:-1]], own[edges[:-1]], [_planes(_deltas(at[a:b])) for a, b in zip(edges[:-1], edges[1:])]


def _decided(doc: np.ndarray, own: np.ndarray, at: np.ndarray, many: int) -> Iterator[pa.RecordBatch]:
    docs, owns, places = _grouped(doc, own, at)
    bucket = pa.array((mix(docs.view(_U)) % _U(many)).astype(np.int32))
    empty = pa.nulls(len(docs), pa.binary())
    values = {"doc": pa.array([d.tobytes() for d in docs], pa.binary()), "own": pa.array([d.tobytes() for d in owns], pa.binary()), "at": pa.array(places, pa.binary())}
    yield pa.RecordBatch.from_arrays([bucket, *(values.get(c, empty) for c in _COLUMNS)], ["bucket", *_COLUMNS])


def _covered(docs: np.ndarray, owns: np.ndarray, places: np.ndarray, many: int) -> Iterator[pa.RecordBatch]:
    packed = _packed.pack((mix(docs.view(_U) ^ mix(owns.view(_U))) % _U(many)).astype(np.int32), {"doc": docs, "own": owns, "at": places.astype(np.int32)})
    if packed:
        yield packed


def _reduced(batches: Iterator[pa.RecordBatch], many: int) -> Iterator[pa.RecordBatch]:
    """Packed (doc, own, at): places of windows that start in a smaller id, too."""
    anchors, sizes, offsets, docs, owns, ats, prints = [], [], [], [], [], [], []
    for batch in batches:
        passed = batch.column("anchor").is_null().to_numpy(False)
        mine = batch.filter(pa.array(passed))
        if mine.num_rows:
            places = [np.cumsum(_unplaned(x.as_buffer(), np.int32), dtype=np.int32) for x in mine.column("at")]
            ids, own = (np.array([np.frombuffer(x.as_buffer(), np.int64)[0] for x in mine.column(c)]) for c in ("doc", "own"))
            sizes_ = [len(x) for x in places]
            yield from _covered(np.repeat(ids, sizes_), np.repeat(own, sizes_), np.concatenate(places), many)
        for r in batch.filter(pa.array(~passed)).to_pylist():
            anchors.append(np.frombuffer(r["anchor"], _U))
            sizes.append(np.frombuffer(r["size"], np.uint8))
            offsets.append(np.frombuffer(r["offset"], np.uint8))
            docs.append(np.cumsum(_unplaned(r["doc"], np.int64)))
            owns.append(_unplaned(r["own"], np.int64))
            ats.append(_unplaned(r["at"], np.int32))
            prints.append(np.frombuffer(r["print"], _U))
    if not anchors:
        return
    size = np.concatenate(sizes).astype(np.int64)
    group = np.repeat(np.arange(len(size)), size)
    step = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
    anchor = np.concatenate(anchors)
    deep = np.concatenate(prints)
    del prints
    key = mix(deep) ^ anchor[group]
    order = np.argsort(key)
    s = key[order]
    same = s[1:] == s[:-1]
    twice = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    if not len(twice):
        return
    g = group[twice]
    doc, own, at = np.concatenate(docs)[g], np.concatenate(owns)[g], np.concatenate(ats)[g] + step[twice]
    place = np.concatenate(offsets)[g] - step[twice]
    order = np.lexsort((doc, place, deep[twice], anchor[g]))
    a, d, place, doc, own, at = anchor[g][order], deep[twice][order], place[order], doc[order], own[order], at[order]
    opens = np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1]) | (place[1:] != place[:-1])])
    late = doc > doc[opens][np.cumsum(opens) - 1]
    yield from _covered(doc[late], own[late], at[late], many)


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, o, at) of every document that loses words."""
    got = _packed.unpack(batches, {"doc": np.int64, "own": np.int64, "at": np.int32})
    if len(got["doc"]):
        docs, owns, places = _grouped(got["doc"], got["own"], got["at"])
        for at in range(0, len(docs), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(docs[at : at + 10_000]), pa.array(owns[at : at + 10_000]), pa.array(places[at : at + 10_000], pa.binary())], ["i", "o", "at"])


def _removed(got: Words, row: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which words of a row go, given the first places of its covered windows."""
    h = got.hash[got.first[row] : got.first[row + 1]]
    w = windows(h, window)
    hit = np.isin(w, w[starts])
    gone = np.zeros(len(h) + 1, np.int32)
    gone[:-window][hit] += 1
    gone[window:][hit] -= 1
    return np.cumsum(gone)[:-1] > 0


def _final(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    got = words(batch.column("t"), lower=False)
    raw, bounds = got.data.tobytes(), got.bounds.tolist()
    kept, spans = [], []
    for r, places in enumerate(batch.column("at").to_pylist()):
        all_words = raw[bounds[r] : bounds[r + 1]].split()
        if not places:
            kept.append(b" ".join(all_words))
            spans.append([])
            continue
        gone = _removed(got, r, np.cumsum(_unplaned(places, np.int32)), window)
        kept.append(b" ".join(compress(all_words, (~gone).tolist())))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)
        spans.append([{"start": a, "end": b} for a, b in edges.tolist()])
    return pa.RecordBatch.from_arrays(
        [
            batch.column("i"),
            pa.array(got.counts, pa.int64()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            pa.array(kept, pa.binary()).cast(pa.string()),
        ],
        ["doc_id", "n_words", "spans", "kept"],
    )


def _told_apart(d: DataFrame) -> DataFrame:
    """Rows (i, t) with a column o: 0, or for ids with several texts a digest of the text."""
    own = F.xxhash64(F.coalesce("t", F.lit("")))
    several = d.where("i is not null").groupBy("i").agg(F.min(own).alias("a"), F.max(own).alias("b")).where("a <> b").select("i", F.lit(True).alias("_several"))
    several = _store.written(several, "substring-ids")
    n = several.count()
    if not n:
        return d.withColumn("o", F.lit(0).cast("long"))
    marked = d.join(F.broadcast(several) if n <= _SENT else several, "i", "left")
    return marked.select("i", "t", F.when(F.col("_several"), own).otherwise(0).cast("long").alias("o"))


def repeats_removed(docs: DataFrame, window: int = 13, gram: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, kept): the words' count, the word ranges that go, and the rest joined by spaces."""
    if not 1 <= gram <= window <= 255:
        raise ValueError("1 <= gram <= window <= 255")
    d = _told_apart(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")))
    many, few = _packed.buckets(docs.sparkSession), _store.partitions(docs.sparkSession)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "t"):
                yield from _mapped(part, window, gram, many)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "t"):
                yield _final(part, window)

    sent = d.where("i is not null").mapInArrow(task(mapped), _packed.schema(_COLUMNS))
    covered = _packed.dealt(sent).mapInArrow(task(lambda batches: _reduced(batches, few)), _packed.schema(["doc", "own", "at"]))
    covered = _packed.dealt(covered).mapInArrow(task(_by_document), "i long, o long, at binary")
    return d.join(covered, ["i", "o"], "left").mapInArrow(task(final), "doc_id long, n_words long, spans array<struct<start: long, end: long>>, kept string")
