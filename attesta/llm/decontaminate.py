"""Benchmark decontamination by spaced-seed hashing.

Fixed masks look at some word positions of a window and ignore the rest, so a
substituted word at an ignored position leaves the seed's hash unchanged. The
seeds of the benchmark are joined with the seeds of every document; around
each hit the two texts are laid side by side on the hit's diagonal, and it is
judged whether any stretch there, which may hold substitutions, meets the rules.

The benchmark is the side that is held in memory. It is read in blocks of
bounded size, whatever its total size; each block is joined with all documents
where they are read, so no document text is shuffled, and a passage that a
third of all documents share is judged in as many tasks as hold them. Only where
there are several blocks, their results are merged by document id and a digest
of the text.

Defined results:

* words are runs of ASCII letters, digits and all non-ASCII bytes; A-Z count
  as a-z and other signs do not count;
* a null or empty text, on either side, matches nothing; so does an item with
  fewer than ``min_words`` words, and a row with a null id on the item side;
* a document row with a null id is judged like any other; repeated rows give
  repeated results; items with equal words count as the one of smallest id;
* an item shorter than the longest mask is sought with masks cut to its length;
* other columns of either table are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import ALNUM, mix, sliced, task, words

_U = np.uint64

#: Word positions that a seed looks at; every mask has six.
MASKS = ("11011011", "1100101011", "10110010011")

SCHEMA = (
    "doc_id long, item_id long, start_word long, n_words long, n_matched long, item_words long, "
    "score double, item_ids array<long>"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("item_id", pa.int64()),
        ("start_word", pa.int64()),
        ("n_words", pa.int64()),
        ("n_matched", pa.int64()),
        ("item_words", pa.int64()),
        ("score", pa.float64()),
        ("item_ids", pa.list_(pa.int64())),
    ]
)


@dataclass(frozen=True)
class Rules:
    """A stretch counts if enough words agree, in a large enough share of its places."""

    min_matched: int = 12
    min_share: float = 0.75
    min_words: int = 4
    #: What a differing word takes from a stretch that gains one for each equal word.
    penalty: float = 1.5


@dataclass(frozen=True)
class Block:
    """Seeds and words of some benchmark items; its size is bounded by the block's bytes."""

    ids: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    shapes: tuple[tuple[int, ...], ...]
    seeds: tuple[np.ndarray, ...]
    owner: tuple[np.ndarray, ...]
    place: tuple[np.ndarray, ...]
    maybe: tuple[np.ndarray, ...]


def _seeds(h: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    n = len(h) - offsets[-1]
    if n <= 0:
        return np.zeros(0, _U)
    out = np.full(n, len(offsets), _U)
    for o in offsets:
        out *= _U(0xC2B2AE3D27D4EB4F)
        out += h[o : o + n] * _U(2 * o + 1)
    return mix(out)


_FILTER_BITS = 22


def block_of(rows: list[tuple[int, str]], rules: Rules) -> Block | None:
    """Index some items."""
    got = words(pa.array([t for _, t in rows], pa.string()), ALNUM)
    seen: dict[bytes, int] = {}
    for i, (item, _) in enumerate(rows):
        h = got.hash[got.first[i] : got.first[i + 1]]
        if len(h) >= rules.min_words and item is not None:
            key = h.tobytes()
            seen[key] = min(item, seen.get(key, item))
    if not seen:
        return None
    items = sorted((item, np.frombuffer(key, _U)) for key, item in seen.items())
    shapes = {tuple(i for i, c in enumerate(m) if c == "1") for m in MASKS}
    longest = max(s[-1] for s in shapes) + 1
    shapes |= {tuple(range(len(h))) for _, h in items if len(h) < longest}
    parts: list[tuple] = []
    for shape in sorted(shapes):
        seeds, owner, place = [], [], []
        for i, (_, h) in enumerate(items):
            if len(shape) != 6 and len(shape) != len(h):
                continue
            s = _seeds(h, shape)
            seeds.append(s)
            owner.append(np.full(len(s), i, np.int64))
            place.append(np.arange(len(s)))
        s = np.concatenate(seeds) if seeds else np.zeros(0, _U)
        order = np.argsort(s, kind="stable")
        maybe = np.zeros(1 << _FILTER_BITS, bool)
        maybe[s >> _U(64 - _FILTER_BITS)] = True
        parts.append((shape, s[order], np.concatenate(owner or [np.zeros(0, np.int64)])[order], np.concatenate(place or [np.zeros(0, np.int64)])[order], maybe))
    first = np.concatenate([[0], np.cumsum([len(h) for _, h in items])])
    return Block(np.array([i for i, _ in items], np.int64), first, np.concatenate([h for _, h in items]), *(tuple(x) for x in zip(*parts)))


def _stretch(same: np.ndarray, least: int, rules: Rules) -> tuple[int, int] | None:
    """A stretch of at least ``least`` equal places, in a share of at least ``min_share``, if there is any.

    That of greatest gain, at one for equal and less ``penalty`` for other
    places, if it meets both rules; else the one of most equal places that does.
    """
    count = np.concatenate([[0], np.cumsum(same)])
    if count[-1] < least:
        return None
    places = np.arange(len(count))
    gain = count - rules.penalty * (places - count)
    end = int(np.argmax(gain - np.minimum.accumulate(gain)))
    start = int(np.argmin(gain[: end + 1]))
    if count[end] - count[start] >= max(least, rules.min_share * (end - start)):
        return start, end
    # a stretch has the share if the sum over it is not negative; the first such start of each end has most equal places
    over = count - rules.min_share * places
    first = np.searchsorted(-np.minimum.accumulate(over), -over - 1e-9)
    end = int(np.argmax(count - count[first]))
    start = int(first[end])
    if count[end] - count[start] < least:
        return None
    equal = np.flatnonzero(same[start:end])
    return start + int(equal[0]), start + int(equal[-1]) + 1


def _judged(doc: np.ndarray, at: np.ndarray, item: np.ndarray, place: np.ndarray, block: Block, rules: Rules):
    """Best stretch of each item that some hit names; at and place are hit starts."""
    found: dict[int, tuple] = {}
    for i, shift in np.unique(np.stack([item, at - place], 1), axis=0).tolist():
        h = block.hash[block.first[i] : block.first[i + 1]]
        lo, hi = max(0, -shift), min(len(h), len(doc) - shift)
        same = doc[lo + shift : hi + shift] == h[lo:hi]
        stretch = _stretch(same, min(rules.min_matched, len(h)), rules)
        if stretch:
            s, e = stretch
            matched = int(np.count_nonzero(same[s:e]))
            found[i] = max(found.get(i, (0,)), (matched, -(lo + shift + s), e - s))
    return found


def scan(batch: pa.RecordBatch, block: Block, rules: Rules, id_col: str, text_col: str) -> pa.RecordBatch:
    """Contaminated rows of one batch."""
    got = words(batch.column(text_col), ALNUM)
    ids = batch.column(id_col).to_pylist() if batch.num_rows else []
    row_of = np.repeat(np.arange(batch.num_rows), got.counts)
    hits: list[tuple[np.ndarray, ...]] = []
    for shape, seeds, owner, place, maybe in zip(block.shapes, block.seeds, block.owner, block.place, block.maybe):
        s = _seeds(got.hash, shape)
        at = np.flatnonzero(maybe[s >> _U(64 - _FILTER_BITS)])
        at = at[row_of[at] == row_of[at + shape[-1]]] if len(at) else at
        left, right = np.searchsorted(seeds, s[at], "left"), np.searchsorted(seeds, s[at], "right")
        n = right - left
        at, left, n = at[n > 0], left[n > 0], n[n > 0]
        which = np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hits.append((np.repeat(at, n), owner[which], place[which]))
    at, item, place = (np.concatenate(x) for x in zip(*hits))
    order = np.argsort(at, kind="stable")
    at, item, place = at[order], item[order], place[order]
    rows = row_of[at] if len(at) else at
    edges = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1, [len(rows)]]) if len(rows) else [0]
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        r = rows[a]
        lo, hi = got.first[r], got.first[r + 1]
        found = _judged(got.hash[lo:hi], at[a:b] - lo, item[a:b], place[a:b], block, rules)
        if found:
            i, (matched, start, length) = max(found.items(), key=lambda x: (x[1], -x[0]))
            size = int(block.first[i + 1] - block.first[i])
            out.append((ids[r], int(block.ids[i]), -start, length, matched, size, matched / length, sorted({int(block.ids[k]) for k in found})))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(_ARROW), _ARROW)], schema=_ARROW)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    rules: Rules = Rules(),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """One row for each document that holds a stretch of some benchmark item.

    ``item_id`` is the item with most agreeing words, ``start_word`` where its
    stretch starts, ``n_words`` its length, ``score`` the share of agreeing
    words, ``item_ids`` every item found. ``block_bytes`` bounds the benchmark
    text that is in memory at once.
    """
    found = [_scanned(docs, block, rules, id_col, text_col, k) for k, block in enumerate(_blocks(benchmark, item_id, item_text, rules, block_bytes))]
    if not found:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    if len(found) == 1:
        return found[0].drop("block", "digest")
    return _merged(reduce(DataFrame.unionByName, found))


def _merged(found: DataFrame) -> DataFrame:
    """The blocks' results as one row for each document row.

    Rows of equal id and text have equal results in each block, so they are
    merged together and then repeated as often as each block found them.
    """
    best = F.max(F.struct("n_matched", (-F.col("start_word")).alias("start"), "n_words", (-F.col("item_id")).alias("item"), "item_words", "score"))
    # an array of each kind of row and block, however often the row is repeated
    merged = found.groupBy("doc_id", "digest").agg(best.alias("x"), F.collect_set("item_ids").alias("ids"), F.count("*").alias("n"), F.size(F.collect_set("block")).alias("blocks"))
    copies = F.sequence(F.lit(1), (F.col("n") / F.col("blocks")).cast("long"))
    return merged.select(
        *("doc_id", (-F.col("x.item")).alias("item_id"), (-F.col("x.start")).alias("start_word"), "x.n_words", "x.n_matched", "x.item_words", "x.score"),
        F.array_sort(F.array_distinct(F.flatten("ids"))).alias("item_ids"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def _rows_of(benchmark: DataFrame, item_id: str, item_text: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).dropna()
    total = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    blocks = -(-total // block_bytes)
    if blocks > 1:
        # items with equal words count as one, so they are in one block
        lower = F.translate("t", string.ascii_uppercase, string.ascii_lowercase)
        items = items.select("i", F.trim(F.regexp_replace(lower, r"[\x00-\x7F&&[^0-9a-z]]+", " ")).alias("t")).groupBy("t").agg(F.min("i").alias("i"))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k) if blocks > 1 else items
        yield [(r.i, r.t) for r in part.collect()]


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, rules: Rules, block_bytes: int) -> Iterator[Block]:
    for rows in _rows_of(benchmark, item_id, item_text, block_bytes):
        block = block_of(rows, rules)
        if block:
            yield block


def _scanned(docs: DataFrame, block: Block, rules: Rules, id_col: str, text_col: str, number: int) -> DataFrame:
    """Results of one block, with its number and a digest of each document's text."""
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "t"):
                numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(part.num_rows)), part.column("t")], ["i", "t"])
                got = scan(numbered, sent.value, rules, "i", "t")
                at = got.column("doc_id")
                digests = [hashlib.blake2b(t, digest_size=16).digest() for t in part.column("t").take(at).cast(pa.binary()).to_pylist()]
                columns = [part.column("i").take(at), *got.columns[1:], pa.array(np.full(len(at), number, np.int32)), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*_ARROW.names, "block", "digest"])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(task(run), f"{SCHEMA}, block int, digest binary")


def clean(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules(), text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no stretch of an item.

    Judged where the rows are read: nothing is shuffled.
    """
    schema = docs.schema
    for block in _blocks(benchmark, item_id, item_text, rules, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in sliced(batch, text_col):
                    text = part.column(text_col)
                    numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(part.num_rows)), text], ["i", "t"])
                    leaks = scan(numbered, sent.value, rules, "i", "t").column("doc_id").to_numpy()
                    keep = np.ones(part.num_rows, bool)
                    keep[leaks] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(task(run), schema)
    return docs
