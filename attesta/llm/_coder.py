"""Adaptive context-mixing range coder for blocks of token ids.

Every block starts from nothing and is coded by itself, so blocks are coded in
lockstep: numpy does one step of all blocks at once. What a block has learned is
brought up to date after each window of ids, not after each id. Within a window
nothing changes, so the encoder looks up all its ids together; only the decoder,
which needs an id to go on, goes one by one, and all learning is done in bulk.

* Orders 2 and 1 predict an id each, from tables of what followed the last two
  ids and the last id; order 0 counts the ids of the block, whatever was before
  them. Symbol 0: the prediction of order 2 holds, or that of order 1 where
  order 2 has none. Its probability mixes the three orders in the logistic
  domain - the confidence of order 2, that of order 1 and whether the two agree,
  and how often order 0 has counted the predicted id's place - each of which adds
  its own adaptive weight of evidence, learned from the errors of the mixture.
* Symbol 1: order 0 knows the id, and its counts code it: an id has the share of
  its place's count. Symbol 2: a new id, which is written as it is, beside the
  coder. The share of these two adapts as well.

Order 0 has places by a hash of the id; the latest id of a place has it. Its
counts are halved now and then, so late ids weigh more.

A block's words are the count of its new ids, the range coder's words, and the
new ids, packed to as many bits as they need. All arithmetic, tables included,
is on integers, so every machine decodes what another encoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Ids of a block, and the windows after which it learns, of which the last goes on.
BLOCK = 4096
_WINDOWS = (8, 8, 16, 32, 64, 128)
#: Contexts of a table, as a power of two, and bits of a place in order 0's table.
_CONTEXT_BITS, _SEEN_BITS = 10, 9
_SEEN = 1 << _SEEN_BITS
#: An entry of a table of predictions: the id, and above it how sure it is, up to 7.
_ID_BITS = 20
_ID, _SURE = (1 << _ID_BITS) - 1, 1 << _ID_BITS
#: Ids are below this.
LARGEST = 1 << _ID_BITS
#: Bounds of the first probability and of the other one, of 65536, so that every symbol has some room.
_FIRST, _OTHER = (64, 64512), (2048, 61440)
_K1, _K2, _K0 = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))


def _squash() -> np.ndarray:
    """65536 / (1 + e^(-x / 256)) for x from -2047 to 2047, from e^(1/256) to 96 bits by whole numbers alone."""
    bits = 96
    step, term, n = 0, 1 << bits, 0
    while term:  # the series of e^(1/256)
        step += term
        n += 1
        term //= 256 * n
    powers = [1 << bits]
    for _ in range(2047):
        powers.append(powers[-1] * step >> bits)
    upper = [65536 * p // (p + (1 << bits)) for p in powers]
    return np.clip(np.array([65536 - x for x in upper[:0:-1]] + upper, np.int32), *_FIRST)


_SQUASH = _squash()
#: What each order begins with, in 65536ths of a unit of evidence: by confidence; by confidence and agreement; by order 0's count and the symbol before.
_BY2 = np.array([-96, -32, 16, 48, 64, 80, 96, 112], np.int32) << 10
_BY1 = np.array([[-64, -48], [-32, 0], [-24, 24], [-16, 40], [-8, 48], [0, 56], [8, 64], [16, 80]], np.int32).ravel() << 10
_BY0 = np.add.outer([-16, -8, 0, 8], [32, -16, -32, 0]).astype(np.int32).ravel() << 10
#: How fast each of their weights learns: halved so many times.
_RATES = np.repeat([0, 1, 2], [len(_BY2), len(_BY1), len(_BY0)])
_BY = np.concatenate([_BY2, _BY1, _BY0])
#: Order 0's counts of a block are halved, but not to 0, when they are more than this together.
_MOST = 1536
#: One error, as it is counted above the sum of a window's errors.
_ONE = 1 << 32
#: By order 0's count of a place: none, one, a few, many; already as rows of the table above.
_OFTEN = (len(_BY2) + len(_BY1) + 4 * np.searchsorted([1, 2, 6], np.arange(BLOCK + 1), "right")).astype(np.int32)


class _Model:
    """What each lane, a block, has learned up to its last window."""

    def __init__(self, lanes: int):
        self.lanes = lanes
        self.lane = np.arange(lanes, dtype=np.int32)
        # of order 2, then of order 1; the ids of order 0's places, their counts and sums; and the weights of evidence
        self.said = np.zeros(2 * lanes << _CONTEXT_BITS, np.int32)
        self.seen, self.own = np.full(lanes << _SEEN_BITS, -1, np.int32), np.zeros(lanes << _SEEN_BITS, np.int16)
        self.below = np.zeros((lanes, _SEEN + 1), np.int16)
        self.by = np.tile(_BY, lanes)
        self.known = np.full(lanes, 32768, np.int32)

    def places(self, lane: np.ndarray, ids: np.ndarray) -> np.ndarray:
        at = ids.view(np.uint32) * _K0
        at >>= np.uint32(32 - _SEEN_BITS)
        at = at.view(np.int32)
        at += lane << _SEEN_BITS
        return at

    def predict(self, lane: np.ndarray, last: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, ...]:
        """(contexts, entries, predicted id, sureness) of some ids, by the ids before."""
        h = np.empty((2, len(last)), np.uint32)
        np.multiply(last.view(np.uint32), _K1, out=h[1])
        np.multiply(prior.view(np.uint32), _K2, out=h[0])
        h[0] += h[1]
        h >>= np.uint32(32 - _CONTEXT_BITS)
        h = h.view(np.int32)
        own = lane << _CONTEXT_BITS
        h[0] += own
        own += self.lanes << _CONTEXT_BITS
        h[1] += own
        entry = self.said.take(h, mode="clip")
        sure, named = entry >> _ID_BITS, entry & _ID
        guess = np.where(sure[0] > 0, named[0], named[1])
        return h, entry, guess, sure, named

    def first(self, lane: np.ndarray, guess: np.ndarray, sure: np.ndarray, named: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the weights of evidence, and the probability that the prediction holds."""
        at = np.empty((3, len(lane)), np.int32)
        by = lane * len(_BY)
        np.add(by, sure[0], out=at[0])
        np.add(sure[1], sure[1], out=at[1])
        at[1] += guess == named[1]
        at[1] += len(_BY2)
        at[1] += by
        by += before
        np.add(by, _OFTEN.take(self.own.take(self.places(lane, guess), mode="clip"), mode="clip"), out=at[2])
        total = self.by.take(at[0], mode="clip")
        total += self.by.take(at[1], mode="clip")
        total += self.by.take(at[2], mode="clip")
        total >>= 8
        total += 2047
        return at, _SQUASH.take(total, mode="clip")

    def learn(self, h: np.ndarray, entry: np.ndarray, at: np.ndarray, p: np.ndarray, symbol: np.ndarray, now: np.ndarray) -> None:
        """Take in a window: contexts and entries, weights and probabilities, symbols and ids, all by lanes and then steps."""
        lanes, steps = self.lanes, len(now) // self.lanes
        # strengthen a prediction that held, weaken or replace one that did not; the latest of a context stays
        named = entry & _ID
        held = np.minimum(entry + _SURE, named | 7 * _SURE)
        missed = np.where(entry >= 2 * _SURE, entry - _SURE, now | _SURE)
        self.said[h] = np.where(named == now, held, missed)
        error = np.where(symbol == 0, 65536, 0) - p
        both = np.zeros(len(self.by))  # sums of errors, and above them how many; of whole numbers below 2^53, so exact
        for own in at:
            both += np.bincount(own, error + float(_ONE), len(both))
        both = both.astype(np.int64)
        many = (both + _ONE // 2) // _ONE
        wrong = both - many * _ONE
        self.by += ((2 * wrong // (8 + many)).reshape(lanes, -1) >> _RATES).ravel().astype(np.int32)
        symbols = symbol.reshape(lanes, steps)
        known, new = (symbols == 1).sum(1), (symbols == 2).sum(1)
        self.known += ((_OTHER[1] * known + _OTHER[0] * new - (known + new) * self.known) // (32 + known + new)).astype(np.int32)
        # order 0 counts what it coded, and what comes to a place; so no place in use has a count of 0
        at0 = self.places(np.repeat(self.lane, steps), now)
        np.add.at(self.own, at0[(symbol > 0) | (self.seen.take(at0, mode="clip") != now)], np.int16(1))
        self.seen[at0] = now
        counts = self.own.reshape(lanes, _SEEN)
        many = np.flatnonzero(counts.sum(1) > _MOST)
        if len(many):
            counts[many] = (counts[many] + 1) >> 1
        np.cumsum(counts, axis=1, dtype=np.int16, out=self.below[:, 1:])


class _Encoder:
    """Words are written with their carries, which are settled in the end."""

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, np.int64)
        self.range = np.full(lanes, (1 << 48) - 1, np.int64)
        self.words = np.zeros((lanes, 1024), np.uint32)
        self.at = np.zeros(lanes, np.int64)

    def room(self, steps: int) -> None:
        if int(self.at.max(initial=0)) + steps + 3 > self.words.shape[1]:
            self.words = np.concatenate([self.words, np.zeros((len(self.words), max(steps, 1024)), np.uint32)], 1)

    def code(self, below: np.ndarray, share: np.ndarray, total: np.ndarray, below0: np.ndarray, share0: np.ndarray) -> None:
        """A share of 65536, and of it one of a total."""
        low, range_ = self.low, self.range
        range_ >>= 16
        low += range_ * below
        range_ *= share
        range_ //= total
        low += range_ * below0
        range_ *= share0
        small = np.flatnonzero(range_ < 1 << 32)
        while len(small):
            x = low.take(small)
            to = self.at.take(small)
            self.words[small, to] = x >> 32
            self.at[small] = to + 1
            low[small] = (x & 0xFFFFFFFF) << 16
            r = range_.take(small) << 16
            range_[small] = r
            small = small[r < 1 << 32]

    def finish(self) -> list[np.ndarray]:
        self.room(3)
        lane = np.arange(len(self.at))
        for part in (self.low >> 32, (self.low >> 16) & 0xFFFF, self.low & 0xFFFF):
            self.words[lane, self.at] = part
            self.at += 1
        words = np.ascontiguousarray(self.words.T)
        for j in range(int(self.at.max(initial=1)) - 1, 0, -1):
            words[j - 1] += words[j] >> 16
        return [w[:n] for w, n in zip(np.ascontiguousarray(words.T).astype("<u2"), self.at.tolist())]


def _windows(steps: int) -> Iterator[tuple[int, int]]:
    at = n = 0
    while at < steps:
        to = min(at + _WINDOWS[min(n, len(_WINDOWS) - 1)], steps)
        yield at, to
        at, n = to, n + 1


def _encoded(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The symbols of blocks of ids, and the coder's words."""
    lanes, steps = ids.shape
    model, coder = _Model(lanes), _Encoder(lanes)
    symbols = np.zeros((lanes, steps), np.int32)
    padded = np.concatenate([np.zeros((lanes, 2), np.int32), ids], 1)
    for at, to in _windows(steps):
        lane = np.repeat(model.lane, to - at)
        now, last, prior = (padded[:, at + k : to + k].ravel() for k in (2, 1, 0))
        h, entry, guess, sure, named = model.predict(lane, last, prior)
        at0 = model.places(lane, now)
        symbol = np.where(guess == now, 0, np.where(model.seen.take(at0, mode="clip") == now, 1, 2)).astype(np.int32)
        symbols[:, at:to] = symbol.reshape(lanes, -1)
        before = symbols[:, at - 1 : to - 1].ravel() if at else np.concatenate([np.zeros((lanes, 1), np.int32), symbols[:, : to - 1]], 1).ravel()
        weights, p = model.first(lane, guess, sure, named, before)
        rest = 65536 - p
        part = (rest * (model.known.take(lane, mode="clip") >> 1)) >> 15  # of at most 31 bits
        below = np.where(symbol == 0, 0, np.where(symbol == 1, p, p + part))
        share = np.where(symbol == 0, p, np.where(symbol == 1, part, rest - part))
        counted = symbol == 1
        total = np.where(counted, model.below[:, _SEEN].take(lane, mode="clip"), 1)
        below0 = model.below.ravel().take(at0 + lane, mode="clip") * counted
        share0 = np.where(counted, model.own.take(at0, mode="clip"), 1)
        coder.room(2 * (to - at))
        parts = [np.ascontiguousarray(x.reshape(lanes, -1).T).astype(np.int64) for x in (below, share, total, below0, share0)]
        for step in zip(*parts):
            coder.code(*step)
        model.learn(h, entry, weights, p, symbol, now)
    return symbols, coder.finish()


def _decoded(words: list[np.ndarray], fresh: list[np.ndarray], steps: int) -> np.ndarray:
    """The ids of blocks, by their coders' words and their new ids."""
    lanes = len(words)
    model, lane = _Model(lanes), np.arange(lanes, dtype=np.int32)
    width = max(map(len, words)) + 4
    read = np.zeros((lanes, width), np.int64)
    for w, own in zip(read, words):
        w[: len(own)] = own
    code = (read[:, 0] << 32) | (read[:, 1] << 16) | read[:, 2]
    read, at = read.ravel(), np.arange(lanes) * width + 3
    range_ = np.full(lanes, (1 << 48) - 1, np.int64)
    new, new_at = np.concatenate([*fresh, np.zeros(1, np.int32)]), np.cumsum([0, *map(len, fresh)])[:-1]
    out = np.zeros((steps, lanes), np.int32)
    last = prior = before = np.zeros(lanes, np.int32)
    below0, every = model.below.ravel(), np.tile(np.arange(_SEEN, dtype=np.int16), lanes)
    for begin, end in _windows(steps):
        n = end - begin
        hs, entries, weights = (np.empty((k, n, lanes), np.int32) for k in (2, 2, 3))
        ps, symbols = np.empty((n, lanes), np.int32), np.empty((n, lanes), np.int32)
        total = model.below[:, _SEEN].astype(np.int64)
        # order 0's places, each as often as it has been counted
        places, first = np.repeat(every, model.own), np.cumsum(total) - total
        total = np.maximum(total, 1)
        half = model.known >> 1
        for t in range(n):
            h, entry, guess, sure, named = model.predict(lane, last, prior)
            at3, p = model.first(lane, guess, sure, named, before)
            rest = 65536 - p
            part = (rest * half) >> 15
            range_ >>= 16
            one = range_ * p
            two = range_ * part
            two += one
            over, above = code >= one, code >= two
            symbol = over.view(np.int8) + above.view(np.int8)
            now = guess
            range_ *= rest
            rest = range_  # the share of symbols 1 and 2
            low = one * over
            range_ = np.where(over, rest, one)
            which = np.flatnonzero(above)
            if len(which):
                edge = two.take(which)
                low[which] = edge
                range_[which] -= edge - one.take(which)
                from_ = new_at.take(which)
                now[which] = new.take(from_, mode="clip")
                new_at[which] = from_ + 1
            which = np.flatnonzero(symbol == 1)
            if len(which):
                edge = one.take(which)
                r = two.take(which) - edge
                r //= total.take(which)
                x = code.take(which) - edge
                x //= r
                x += first.take(which)
                place = places.take(x, mode="clip") + (lane.take(which) << _SEEN_BITS)
                now[which] = model.seen.take(place, mode="clip")
                low[which] = edge + r * below0.take(place + which, mode="clip")
                r *= model.own.take(place, mode="clip")
                range_[which] = r
            code -= low
            small = np.flatnonzero(range_ < 1 << 32)
            while len(small):
                from_ = at.take(small)
                code[small] = (code.take(small) << 16) | read.take(from_, mode="clip")
                at[small] = from_ + 1
                r = range_.take(small) << 16
                range_[small] = r
                small = small[r < 1 << 32]
            hs[:, t], entries[:, t], weights[:, t], ps[t], symbols[t] = h, entry, at3, p, symbol
            out[begin + t] = now
            prior, last, before = last, now, symbols[t]
        by_lane = lambda x: np.ascontiguousarray(np.swapaxes(x, -1, -2)).reshape(*x.shape[:-2], -1)
        model.learn(*(by_lane(x) for x in (hs, entries, weights, ps, symbols, out[begin:end])))
    return out.T


def _packed(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of so many bits: their whole bytes, low ones first, then what is left of each, as whole words."""
    whole, rest = divmod(bits, 8)
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    left = planes[whole, :, None] >> np.arange(rest - 1, -1, -1, dtype=np.uint8) & 1 if rest else planes[:0]
    raw = np.concatenate([planes[:whole].ravel(), np.packbits(left.ravel()), np.zeros(1, np.uint8)])
    return raw[: len(raw) // 2 * 2].view("<u2")


def _unpacked(words: np.ndarray, many: int, bits: int) -> np.ndarray:
    whole, rest = divmod(bits, 8)
    raw = np.ascontiguousarray(words, "<u2").view(np.uint8)
    planes = np.zeros((4, many), np.uint8)
    planes[:whole] = raw[: whole * many].reshape(whole, many)
    if rest:
        left = np.unpackbits(raw[whole * many :], count=rest * many).reshape(many, rest)
        planes[whole] = left @ (1 << np.arange(rest - 1, -1, -1, dtype=np.uint8))
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _words_of(many: int, bits: int) -> int:
    whole, rest = divmod(bits, 8)
    return (whole * many + -(-rest * many // 8) + 1) // 2


def _bits(vocabulary: int) -> int:
    if not 0 < vocabulary <= LARGEST:
        raise ValueError(f"a vocabulary of {vocabulary} ids; at most {LARGEST} can be coded")
    return max(1, (vocabulary - 1).bit_length())


def encode(ids: np.ndarray, vocabulary: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Blocks of ids below the vocabulary's size: their sizes, and their 16-bit words."""
    bits = _bits(vocabulary)
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < vocabulary:
        raise ValueError("an id is not in the vocabulary")
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.zeros(0, np.int64), []
    sizes = np.full(blocks, BLOCK, np.int64)
    sizes[-1] = len(ids) - BLOCK * (blocks - 1)
    whole = np.zeros(blocks * BLOCK, np.int32)  # the last block is filled up if there are others
    whole[: len(ids)] = ids
    whole = whole.reshape(blocks, BLOCK)[:, : sizes[0]]
    symbols, coded = _encoded(whole)
    out = []
    for own, kind, words in zip(whole, symbols, coded):
        fresh = own[kind == 2]
        out.append(np.concatenate([np.array([len(fresh)], "<u2"), words, _packed(fresh, bits)]))
    return sizes, out


def decode(sizes: np.ndarray, payloads: list[np.ndarray], vocabulary: int) -> np.ndarray:
    bits = _bits(vocabulary)
    if not len(sizes):
        return np.zeros(0, np.int64)
    words, fresh = [], []
    for own in payloads:
        n = int(own[0])
        to = len(own) - _words_of(n, bits)
        words.append(own[1:to])
        fresh.append(_unpacked(own[to:], n, bits))
    sizes = np.asarray(sizes, np.int64)
    flat = _decoded(words, fresh, int(sizes[0])).reshape(-1)
    return flat[: int(sizes.sum())].astype(np.int64)
