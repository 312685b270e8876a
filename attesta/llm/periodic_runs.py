"""Stretches of a text that repeat with a period, by a suffix tree in the way of Stoye and Gusfield.

Every text is looked at by itself, so rows stay where they are: no shuffle, no
group, and only a single long text takes more memory than a slice of a batch.

A suffix tree over all words would mostly hold words that never repeat. A run
of exponent four holds each of its three-word windows at least three times,
so only places whose window occurs three times in their text become leaves
(counted by a sketch first, then exactly), and of those only stretches of four
or more. Over these places the tree is built as suffix order, common prefixes
and the intervals of equal prefixes, which are its inner nodes with their leaf
lists. From every inner node of depth q the leaf lists of all children but the
largest are gone through: a leaf whose partner q places on, or back, lies under
another child is the place of a branching tandem repeat. Each is rotated to the
left as far as it stays one; repeats with the same first and last word are
merged into one run, whose period is the smallest.

Words count as equal if their 64-bit hashes are. Words are runs of other bytes
than white space, unchanged.

Defined results: a null or empty text has no words and no runs; a text of any
length is looked at whole; each row has its own result, so rows that repeat an
id, or have none, keep theirs; other columns are ignored; an empty table gives
an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import sliced, task, windows, words

_U = np.uint64
#: Words of the window whose repeats make leaves, repeats of it in a run, and places in a row.
GRAM, TIMES, STRETCH = 3, 3, 4
#: A run has at least so many words, and so many periods.
LEAST, PERIODS = 6, 4
#: Bytes of text that are looked at together.
SLICE = 8 << 20

RUN = "struct<start: long, length: long, period: long>"


def _ragged(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first, first + 1, ..., many of them, for each."""
    ends = np.cumsum(many)
    return np.repeat(first - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)


def _stretches(at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which of the places (ascending, with their rows) stand in a stretch of STRETCH or more."""
    opens = np.concatenate([[True], (np.diff(at) != 1) | (row[1:] != row[:-1])])
    size = np.diff(np.concatenate([np.flatnonzero(opens), [len(at)]]))
    return np.repeat(size >= STRETCH, size)


def _repeated(key: np.ndarray, times: int) -> np.ndarray:
    """Which keys occur so often: those that a sketch of counts lets through are counted exactly."""
    bits = max(10, (4 * len(key)).bit_length())
    slot = ((key * _U(0x9E3779B97F4A7C15)) >> _U(64 - bits)).astype(np.int64)
    some = np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] >= times)
    order = some[np.argsort(key[some], kind="stable")]
    k = key[order]
    edges = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff(np.concatenate([edges, [len(k)]]))
    out = np.zeros(len(key), bool)
    out[order[np.repeat(size >= times, size)]] = True
    return out


def leaves(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that a run may hold, ascending, and the key of their window."""
    key = windows(hashes, GRAM)
    if not len(key):
        return np.zeros(0, np.int64), key
    inside = row[: len(key)] == row[GRAM - 1 :]
    key ^= row[: len(key)].astype(_U) * _U(0xD1342543DE82EF95)
    at = np.flatnonzero(inside)
    key = key[at]
    while len(at):
        before = len(at)
        some = _repeated(key, TIMES)
        at, key = at[some], key[some]
        if len(at):
            some = _stretches(at, row[at])
            at, key = at[some], key[some]
        if len(at) > 0.9 * before:
            break
    return at, key


class Tree:
    """The suffix tree of a sequence of symbols that ends in one that occurs once.

    ``order`` has the suffixes in order, ``place`` the number of each in it;
    ``levels[k]`` names the 2**k symbols from each place. Inner nodes have a
    depth and an interval of ``order``; children are listed node by node.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.order = np.argsort(symbols, kind="stable")
        s = symbols[self.order]
        names = np.empty(n, np.int64)
        opens = np.concatenate([[True], s[1:] != s[:-1]])
        names[self.order] = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
        self.levels = [names]
        step = 1
        while not opens.all():
            # places whose 2 * step symbols are not told apart yet are ordered by what follows
            closes = np.concatenate([opens[1:], [True]])
            slots = np.flatnonzero(~(opens & closes))
            active = self.order[slots]
            # two equal blocks hold no last symbol, so what follows them exists
            key = names[active] * (n + 1) + names[np.minimum(active + step, n - 1)]
            by = np.argsort(key, kind="stable")
            self.order[slots] = active[by]
            k = key[by]
            fresh = np.concatenate([[True], k[1:] != k[:-1]])
            opens[slots] |= fresh
            names = names.copy()
            names[active[by]] = np.maximum.accumulate(np.where(fresh, slots, 0))
            step *= 2
            if not opens.all():
                self.levels.append(names)
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        self._nodes(self._common())

    def _common(self) -> np.ndarray:
        """Symbols that each suffix shares with the one before it in order; 0 before the first and after the last."""
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        shared = np.zeros(len(self.order) + 1, np.int64)
        for k in reversed(range(len(self.levels))):
            same = self.levels[k][a] == self.levels[k][b]
            # what is equal holds no last symbol, so a place follows it
            jump = same.astype(np.int64) << k
            a += jump
            b += jump
            shared[1:-1] += jump
        return shared

    def _nodes(self, shared: np.ndarray) -> None:
        cut = np.flatnonzero(shared)
        left, right = _smaller(shared, cut)
        # boundaries of one node have one interval; left to right within it
        by = np.lexsort((cut, right, left))
        cut, left, right = cut[by], left[by], right[by]
        opens = np.ones(len(cut), bool)
        opens[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        first = np.flatnonzero(opens)
        self.depth, self.low, self.high = shared[cut[first]], left[first], right[first]
        # a node with m boundaries has m + 1 children
        m = np.diff(np.concatenate([first, [len(cut)]]))
        node = np.repeat(np.arange(len(first)), m + 1)
        start = np.empty(len(node), np.int64)
        head = np.cumsum(m + 1) - (m + 1)
        is_head = np.zeros(len(node), bool)
        is_head[head] = True
        start[is_head], start[~is_head] = self.low, cut
        end = np.empty(len(node), np.int64)
        tail = np.cumsum(m + 1) - 1
        is_tail = np.zeros(len(node), bool)
        is_tail[tail] = True
        end[is_tail], end[~is_tail] = self.high, start[1:][~is_tail[:-1]]
        size = end - start
        largest = np.lexsort((-size, node))[head] if len(head) else head
        light = np.ones(len(node), bool)
        light[largest] = False
        self.child_node, self.child_start, self.child_end = node[light], start[light], end[light]

    def branching(self) -> tuple[np.ndarray, np.ndarray]:
        """First places and half lengths of all branching tandem repeats."""
        many = self.child_end - self.child_start
        found = []
        n = len(self.order)
        for lo, hi in _portions(many, 1 << 22):
            leaf = self.order[_ragged(self.child_start[lo:hi], many[lo:hi])]
            child = np.repeat(np.arange(lo, hi), many[lo:hi])
            node = self.child_node[child]
            depth = self.depth[node]
            for partner, first in ((leaf + depth, leaf), (leaf - depth, leaf - depth)):
                there = (partner >= 0) & (partner < n)
                p = self.place[np.where(there, partner, 0)]
                there &= (p >= self.low[node]) & (p < self.high[node]) & ((p < self.child_start[child]) | (p >= self.child_end[child]))
                found.append((first[there], depth[there]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f for f, _ in found]), np.concatenate([d for _, d in found])

    def rotated(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """How far each repeat can be rotated to the left."""
        now = at.copy()
        for k in reversed(range(len(self.levels))):
            back = now - (1 << k)
            there = np.maximum(back, 0)
            same = (back >= 0) & (self.levels[k][there] == self.levels[k][there + period])
            now = np.where(same, back, now)
        return at - now


def _portions(many: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of children whose leaves together stay near the limit."""
    ends = np.cumsum(many)
    at = 0
    while at < len(many):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield at, to
        at = to


def _smaller(value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the nearest ones to the left and right with a smaller value; value[0] and value[-1] are least.

    Pointers are jumped over together; the few that are left after some rounds
    (before long falling or rising slopes) are found by halving over minima of
    blocks.
    """
    out = []
    for sign in (-1, 1):
        to = np.arange(len(value)) + sign
        open_ = at
        for _ in range(16):
            open_ = open_[value[to[open_]] >= value[open_]]
            if not len(open_):
                break
            to[open_] = to[to[open_]]
        if len(open_):
            v = value if sign > 0 else value[::-1]
            table = [v]
            while (w := 1 << len(table)) <= len(v):
                table.append(np.minimum(table[-1][: len(v) - w + 1], table[-1][w // 2 : w // 2 + len(v) - w + 1]))
            i = to[open_] if sign > 0 else len(v) - 1 - to[open_]
            least = value[open_]
            for k in reversed(range(len(table))):
                fits = i < len(table[k])
                whole = np.zeros(len(i), bool)
                whole[fits] = table[k][i[fits]] >= least[fits]
                i = i + (whole.astype(np.int64) << k)
            to[open_] = i if sign > 0 else len(v) - 1 - i
        out.append(to[at])
    return out[0], out[1]


def runs(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, length and period of all runs, by row, start and period; row r has the words first[r] to first[r + 1]."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at, key = leaves(hashes, row)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none, none
    # a symbol that occurs once closes each stretch
    closes = np.concatenate([(np.diff(at) != 1) | (row[at][1:] != row[at][:-1]), [True]])
    moved = np.arange(len(at)) + np.cumsum(closes) - closes
    symbols = np.empty(len(at) + int(closes.sum()), np.int64)
    names = np.unique(key, return_inverse=True)[1]
    ends = moved[closes] + 1
    symbols[moved], symbols[ends] = names, len(at) + np.arange(len(ends))
    word = np.zeros(len(symbols), np.int64)
    word[moved] = at
    tree = Tree(symbols)
    i, q = tree.branching()
    # how far a repeat must rotate for its run to be long enough
    wanted = np.maximum(LEAST, PERIODS * q) - (GRAM - 1) - 2 * q
    some = i >= wanted
    i, q, wanted = i[some], q[some], wanted[some]
    some = symbols[i - wanted] == symbols[i - wanted + q]
    i, q, wanted = i[some], q[some], wanted[some]
    left = tree.rotated(i, q)
    some = left >= wanted
    i, q, left = i[some], q[some], left[some]
    start, length = word[i - left], left + 2 * q + GRAM - 1
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    fresh = np.ones(len(q), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, q = start[fresh], length[fresh], q[fresh]
    order = np.lexsort((q, start))
    start, length, q = start[order], length[order], q[order]
    return row[start], start - first[row[start]], length, q


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The (start, length, period) of greatest length / period; ties go to the smallest start, then period."""
    return max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def _of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    got = words(batch.column("t"), lower=False)
    row, start, length, period = runs(got.hash, got.first)
    by_row = np.searchsorted(row, np.arange(batch.num_rows + 1))
    triples = list(zip(start.tolist(), length.tolist(), period.tolist()))
    raw, bounds = got.data.tobytes(), got.bounds.tolist()
    collapsed, found, best = [], [], []
    for r in range(batch.num_rows):
        mine = triples[by_row[r] : by_row[r + 1]]
        own = raw[bounds[r] : bounds[r + 1]].split()
        if mine:
            gone = np.zeros(len(own) + 1, np.int32)
            for s, n, q in mine:
                gone[s + q] += 1
                gone[s + n] -= 1
            own = compress(own, (np.cumsum(gone)[:-1] == 0).tolist())
        collapsed.append(b" ".join(own))
        found.append([{"start": s, "length": n, "period": q} for s, n, q in mine])
        top = strongest(mine)
        best.append(top and {"start": top[0], "length": top[1], "period": top[2]})
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    return pa.RecordBatch.from_arrays(
        [batch.column("i"), pa.array(got.counts, pa.int64()), pa.array(found, pa.list_(kind)), pa.array(best, kind), pa.array(collapsed, pa.binary()).cast(pa.string())],
        ["doc_id", "n_words", "runs", "strongest", "collapsed"],
    )


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, strongest, collapsed): every run by start and period, the one of
    greatest exponent, and the words that no run holds after its first period, joined by spaces."""
    d = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    kind = d.schema["i"].dataType.simpleString()

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "t", SLICE):
                yield _of_batch(part)

    return d.mapInArrow(task(of_task), f"doc_id {kind}, n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string")


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, one in ten of them made periodic from some word on, as its id's checksum says.

    With h the unsigned crc32 of the decimal id and g = h div 10: where h mod 10
    is 0 and there are n > 0 words, word i >= a = g mod n becomes word
    a + (i - a) mod p with p = 1 + (n - a) div (3 + g mod 8). Other texts stay.
    """
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    h = F.crc32(i.cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def made(w):
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        moved = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda j: F.get(w, F.when(j < a, j).otherwise(a + (j - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(moved, " "))

    # an array of one binds the words, so they are cut once
    words_ = F.regexp_extract_all(t, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    periodic = F.get(F.transform(F.array(words_), made), F.lit(0))
    return docs.select(i.alias("doc_id"), F.when(h % 10 == 0, F.coalesce(periodic, t)).otherwise(t).alias("text"))
