"""Best-fit packing of tokenized documents into sequences of bounded length.

Documents are cut into pieces of at most ``capacity`` ids, and pieces are
packed longest first, each into the gap that it fits best. Lengths and gaps are
whole numbers up to the capacity, so pieces of one length are alike, and so are
sequences with one gap: both sides are range-sorted classes with counts. Bulk
rounds go through the lengths from the longest. In a round, the pieces of a
length sweep to the successor among the gaps, the smallest that holds them;
where more pieces than gaps meet, or the reverse, ranks decide, which is
splitting a count; the gaps that were used move to their new class, and the
length sweeps on until its pieces are placed or no gap holds them, when new
sequences open. The outcome is that of best-fit decreasing piece by piece.

What the rounds touch is bounded by the capacity, not by the documents: at most
``capacity`` counts come to the driver. Everything about a piece is distributed:
its tokens, its rank among the pieces of its length (counted by lanes, so that a
length with a third of all pieces is no single task's work), and its place,
which is a look-up of length and rank in the plan.

Defined results: a null text counts as empty, and a document without tokens is
one piece of its end id; rows with a null id and repeated rows are documents of
their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _store, _tokens
from ._bytes import sliced, task

#: Pieces for which there is a lane, and lanes at least, in which the ranks of a length are counted.
LANE, LANES = 1 << 20, 256


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _tokens.encoder(tokenizer)
        for batch in batches:
            for part in sliced(batch, "t", 4 << 20):
                own, counts = found.flat(part.column("t"))
                counts += 1
                ends = np.cumsum(counts)
                ids = np.full(int(counts.sum()), end_id, "<u4")
                last = np.zeros(len(ids), bool)
                last[ends - 1] = True
                ids[~last] = own
                many = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), many)
                number = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = number * capacity
                length = np.minimum(capacity, counts[row] - start)
                raw, at = memoryview(ids.tobytes()), 4 * (np.repeat(ends - counts, many) + start)
                crc = [zlib.crc32(raw[a : a + n]) for a, n in zip(at.tolist(), (4 * length).tolist())]
                yield pa.RecordBatch.from_arrays([part.column("i").take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names)

    d = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return d.mapInArrow(task(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Where the pieces of each length go, by rank: runs of equal sequences."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.sequences = 0
        #: gap -> runs (first sequence, sequences) with that gap
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []  # gaps that occur, sorted
        rows: list[tuple[int, int, int, int, int]] = []
        for length in sorted(counts, reverse=True):
            rank, left = 0, counts[length]
            while left:
                at = bisect.bisect_left(self.sizes, length)
                gap = self.sizes[at] if at < len(self.sizes) else capacity
                each = gap // length
                need = -(-left // each)
                first, many = self._taken(gap, need) if at < len(self.sizes) else self._opened(need)
                rows.append((length, rank, first, each, capacity - gap))
                placed = min(left, many * each)
                full, rest = divmod(placed, each)
                self._put(gap - each * length, first, full)
                if rest:
                    self._put(gap - rest * length, first + full, 1)
                rank, left = rank + placed, left - placed
        table = np.array(rows, np.int64).reshape(-1, 5)
        order = np.lexsort((table[:, 1], table[:, 0]))
        self.length, self.rank, self.first, self.each, self.offset = table[order].T

    def _taken(self, gap: int, need: int) -> tuple[int, int]:
        """Some sequences with this gap, at most as many as needed."""
        first, many = self.gaps[gap].pop()
        if many > need:
            self.gaps[gap].append((first + need, many - need))
            many = need
        elif not self.gaps[gap]:
            del self.gaps[gap]
            del self.sizes[bisect.bisect_left(self.sizes, gap)]
        return first, many

    def _opened(self, need: int) -> tuple[int, int]:
        first, self.sequences = self.sequences, self.sequences + need
        return first, need

    def _put(self, gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in self.gaps:
                bisect.insort(self.sizes, gap)
            self.gaps.setdefault(gap, []).append((first, many))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces with these lengths and ranks."""
        shift = max(1, int(self.rank.max(initial=0)) + 1, int(rank.max(initial=0)) + 1)
        at = np.searchsorted(self.length * shift + self.rank, length * shift + rank, "right") - 1
        turn, within = np.divmod(rank - self.rank[at], self.each[at])
        return self.first[at] + turn, self.offset[at] + within * length


def packed(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its sequence and its offset there."""
    cut = _store.kept(pieces(docs, tokenizer, capacity, end_id, id_col, text_col))
    # the lane is dealt by document, so copies are in many
    cut = cut.withColumn("lane", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(LANES, cut.count() // LANE))))
    lanes = cut.groupBy("length", "lane").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in lanes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan = docs.sparkSession.sparkContext.broadcast(Plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lanes.select("length", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "lane").orderBy("doc_id", "piece", "start")
    ranked = cut.withColumn("r", F.row_number().over(within)).join(offsets, ["length", "lane"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("r") + F.col("before") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(task(run), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
