"""Token ids of many texts with a public tokenizer, piece by piece.

A byte-pair tokenizer first cuts a text into pieces and then encodes each piece
by itself. Pieces repeat, so each is encoded by the tokenizers library and its
ids are remembered. Cutting and looking up are done with arrays over the UTF-8
bytes of a whole batch, without a Python object for a piece: a piece of at most
16 bytes is named by its bytes, as two 64-bit numbers, so nothing rests on a
hash being free of collisions. What is remembered is a table of fixed size in
which a newer piece takes the place of an older one.

The cutting is done here only for texts of common letters, where the two known
patterns are plain. Any other text, and one that holds the string of an added
token, goes through the library as a whole, as do all texts of other tokenizers.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._bytes import mix, utf8

_U = np.uint64
#: Places of the table of remembered pieces, and ids that they may have together.
PLACES, POOL = 1 << 21, 3 << 21
#: Longer pieces, and those of white space, that are remembered at once.
LONG = 50_000
#: Pieces in one text, and texts that the library encodes at once.
_JOINED, _BATCH = 100, 10_000
#: Pieces that are looked up at once.
_PIECES = 1 << 20
#: Bytes of a piece that name it.
_NAMED = 16

_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
#: The class of each byte; letters beyond ASCII are those from U+00C0 to U+017E.
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0x80:] = _LETTER
#: Texts of which every byte pair is plain; the signs U+00D7 and U+00F7 and the letters U+0130 and U+017F are not.
PLAIN = "^[\t\n\x0b\x0c\r -~À-ÖØ-öø-įı-ž]*$"

#: What the files of the two known tokenizers name their patterns by.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_NORMALIZER = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
#: What may follow an apostrophe as a piece with it.
_ONE = np.frombuffer(b"stmd", np.uint8)
_TWO = [tuple(x) for x in (b"re", b"ve", b"ll")]

_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


def _runs(data: np.ndarray, bounds: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces; ``words``: digits stand alone and white space is dropped."""
    kind = _CLASS[data]
    opens = np.ones(len(data), bool)
    np.not_equal(kind[1:], kind[:-1], out=opens[1:])
    first = np.zeros(len(data), bool)
    first[bounds[:-1][bounds[:-1] < len(data)]] = True
    opens |= first
    if words:
        opens |= kind == _DIGIT
    else:  # the last of some white space is its own, or goes with what follows if it is a space
        at = np.flatnonzero((kind[1:] != _SPACE) & (kind[:-1] == _SPACE) & ~first[1:]) + 1
        opens[at - 1] = True
        opens[at[data[at - 1] == 0x20]] = False
    at = np.flatnonzero((data == 0x27) & opens)
    if len(at):
        rest = bounds[np.searchsorted(bounds, at, "right")] - at
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        one, two = padded[at + 1], padded[at + 2]
        long = np.where(np.isin(one, _ONE) & (rest > 1), 2, 0)
        for a, b in _TWO:
            long[(one == a) & (two == b) & (rest > 2)] = 3
        some = long > 0
        at, long, rest = at[some], long[some], rest[some]
        opens[at + 1] = False
        inside = long < rest
        opens[(at + long)[inside]] = True
    start = np.flatnonzero(opens)
    end = np.append(start[1:], len(data))
    if words:
        some = kind[start] != _SPACE
        start, end = start[some], end[some]
    return start, end


def _names(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and second eight bytes of each piece, zeros after its end."""
    padded = np.concatenate([data, np.zeros(2 * _NAMED, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
    return eight[start] & _MASKS[np.minimum(length, 8)], eight[start + 8] & _MASKS[np.clip(length - 8, 0, 8)]


def _ragged(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first, first + 1, ..., many of them, for each."""
    ends = np.cumsum(many)
    return np.repeat(first - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Ids of texts, equal to those of the untouched library tokenizer without special tokens added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.size = self.tokenizer.get_vocab_size()
        added = made["added_tokens"]
        self.added = [t["content"] for t in added]
        before, normal = made["pre_tokenizer"], made["normalizer"]
        self.words = before["type"] == "Sequence" and before["pretokenizers"][0].get("pattern") == {"Regex": _WORD_SPLIT} and bool(normal) and normal.get("normalizers") == _WORD_NORMALIZER
        self.known_pattern = self.words or (before["type"] == "ByteLevel" and bool(before.get("use_regex")) and not before["add_prefix_space"] and not normal)
        self.known_pattern &= not any(t["normalized"] for t in added)
        self._forget()

    def _forget(self) -> None:
        self.name = np.zeros((2, PLACES), _U)
        self.first, self.many = np.zeros(PLACES, np.int32), np.zeros(PLACES, np.uint8)
        self.pool, self.used = np.zeros(POOL, np.uint32), 0
        self.long: dict[bytes, np.ndarray] = {}

    def _by_library(self, texts: list[str]) -> Iterator[np.ndarray]:
        for at in range(0, len(texts), _BATCH):
            for got in self.tokenizer.encode_batch_fast(texts[at : at + _BATCH], add_special_tokens=False):
                yield np.array(got.ids, np.uint32)

    def _of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and how many each has.

        A text of many pieces is encoded faster than many texts. Between spaces, or
        between line ends that are pieces of their own, the pieces are the same.
        """
        ids, many = [], []
        every, between = (1, " ") if self.words else (2, "\n")
        for at in range(0, len(pieces), _BATCH):
            texts = [between.join(pieces[k : k + _JOINED]) for k in range(at, min(at + _BATCH, len(pieces)), _JOINED)]
            for got in self.tokenizer.encode_batch(texts, add_special_tokens=False):
                own, words = np.array(got.ids, np.uint32), np.array(got.word_ids)
                ids.append(own[words % every == 0])
                many.append(np.bincount(words)[::every])
        sizes = np.concatenate(many or [np.zeros(0, np.int64)])
        if len(sizes) != len(pieces):
            raise AssertionError("pieces of a text were cut otherwise")
        return np.concatenate(ids or [np.zeros(0, np.uint32)]), sizes

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, place: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces that are not known, once each; all ids, and (first, many) of each as an array of two rows."""
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(fresh) - 1
        some = order[fresh]
        raw = data.tobytes()
        ids, many = self._of_pieces([raw[s:e].decode() for s, e in zip(start[some].tolist(), end[some].tolist())])
        first = np.cumsum(many) - many
        short = many < 256
        if self.used + len(ids) > POOL:
            self._forget()
        if len(ids) <= POOL:
            self.pool[self.used : self.used + len(ids)] = ids
            at = place[some][short]
            self.name[0][at], self.name[1][at] = one[some][short], two[some][short]
            self.first[at], self.many[at] = first[short] + self.used, many[short]
            self.used += len(ids)
        return ids, np.stack([first, many])[:, which]

    def _long(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        if len(self.long) > LONG:
            self.long.clear()
        own = [data[s:e].tobytes() for s, e in zip(start.tolist(), end.tolist())]
        here = {x: self.long[x] for x in own if x in self.long}
        new = list({x for x in own if x not in here})
        here |= zip(new, self._by_library([x.decode() for x in new]))
        self.long |= {x: i for x, i in here.items() if len(x) < 256}
        return [here[x] for x in own]

    def _looked_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and how many each has."""
        length = end - start
        one, two = _names(data, start, length)
        place = (mix(one ^ (two * _U(0x9E3779B97F4A7C15))) >> _U(64 - PLACES.bit_length() + 1)).astype(np.int64)
        # white space can't be told apart from what is put between pieces
        long = (length > _NAMED) | ((_CLASS[data[start]] == _SPACE) & (_CLASS[data[end - 1]] == _SPACE))
        known = (self.name[0][place] == one) & (self.name[1][place] == two) & ~long
        first, many = self.first[place].astype(np.int64), self.many[place].astype(np.int64)
        pools, base = [self.pool[: self.used]], self.used
        new = np.flatnonzero(~known & ~long)
        if len(new):
            got, where = self._learn(data, start[new], end[new], place[new], one[new], two[new])
            first[new], many[new] = where[0] + base, where[1]
            pools.append(got)
            base += len(got)
        rest = np.flatnonzero(long)
        if len(rest):
            got = self._long(data, start[rest], end[rest])
            many[rest] = sizes = np.array([len(x) for x in got], np.int64)
            first[rest] = base + np.cumsum(sizes) - sizes
            pools += got
        return np.concatenate(pools)[_ragged(first, many)], many

    def _plain(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of plain texts, and how many each text has."""
        start, end = _runs(data, bounds, self.words)
        # a very long text is looked up in parts
        parts = [self._looked_up(data, start[at : at + _PIECES], end[at : at + _PIECES]) for at in range(0, len(start), _PIECES)]
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
        ends = np.concatenate([[0], np.cumsum(np.concatenate([many for _, many in parts]))])
        return np.concatenate([ids for ids, _ in parts]), np.diff(ends[np.searchsorted(start, bounds)])

    def flat(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a text column in one array, and how many each row has; a null text has none."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column, "")
        plain = np.zeros(len(column), bool)
        if self.known_pattern and len(column):
            own = pc.match_substring_regex(column, PLAIN)
            for added in self.added:
                own = pc.and_not(own, pc.match_substring(column, added))
            plain = own.to_numpy(False)
        some = column.filter(pa.array(plain)) if not plain.all() else column
        data, bounds = utf8(pc.utf8_lower(some) if self.words else some)
        ids, counts = self._plain(data, bounds) if len(data) else (np.zeros(0, np.uint32), np.zeros(len(some), np.int64))
        if plain.all():
            return ids, counts
        others = list(self._by_library(column.filter(pa.array(~plain)).to_pylist()))
        ends = np.cumsum(counts)
        many = np.zeros(len(column), np.int64)
        many[plain], many[~plain] = counts, [len(x) for x in others]
        first = np.zeros(len(column), np.int64)
        first[plain] = ends - counts
        first[~plain] = len(ids) + np.cumsum(many[~plain]) - many[~plain]
        return np.concatenate([ids, *others])[_ragged(first, many)], many

    def encode(self, texts: Iterable[str | None] | pa.Array) -> list[bytes]:
        """The ids of each text as bytes of little-endian unsigned 32-bit integers."""
        ids, counts = self.flat(texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.string()))
        raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
        return [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist())]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
