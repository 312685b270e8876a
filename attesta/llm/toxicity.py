"""Toxicity by a subsequence string kernel machine with Nystroem landmarks.

The kernel of two words is the weighted number of character subsequences of
length three and four that they share; each character that a subsequence skips
costs a factor. So a word that is spelled with gaps or with characters put in
between stays close to the word it hides. A word's map into the span of some
landmark words (Nystroem) is linear in its subsequences, so a trained machine
is one table of subsequence weights, and scoring a word is summing a few dozen
entries of it, in numpy for many words at once.

Training is on labelled sentences, a bounded sample of the labelled rows. The
label is the sentence's, not the word's: the words that testify are those whose
beginnings occur in far more toxic sentences than others. They and the words of
clean sentences train a support vector machine (squared hinge, Newton's
method); clean words that it takes for toxic join a second training. A logistic
model of the highest word scores and of the number of words above zero turns
them into a text's score; it is fitted on sentences that the machine has not
seen, and its intercept is moved to the share of toxic rows among all labelled.

Labels, languages, sources and ids are never inputs of a score.

Defined results: a null or empty text scores as a text without words; a row
with a null id is scored, and is not held out; repeated rows are scored alike;
without labelled rows of both kinds every score is next to 0; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import sliced, task

#: What a skipped character costs.
DECAY = 0.6
#: Places of the later characters of a subsequence, after its first.
TRIPLES = [(a, b) for b in range(2, 5) for a in range(1, b)]
QUADS = [(a, b, c) for c in range(3, 6) for b in range(2, c) for a in range(1, b)]
#: Longer words are scored in overlapping pieces.
LENGTH = 22
_TABLE = 20  # bits of the table of fours
_LETTERS = re.compile(r"[^\W\d_]+")
_SIGNS = re.compile(r"[\W\d_]+")
_SPELLED = re.compile(r"(?<!\S)(?:[^\W\d_] ){2,}[^\W\d_](?!\S)")
#: Words whose scores a task remembers.
REMEMBERED = 250_000
#: Bytes of the texts that are scored at once.
TEXTS = 4 << 20


@dataclass(frozen=True)
class Training:
    """Bounds of the sample and settings of the fit."""

    toxic_rows: int = 1000
    clean_rows: int = 3000
    #: Sentences with more characters are not trained on.
    longest: int = 20_000
    landmarks: int = 192
    words: int = 8_000
    #: Times that the share of toxic sentences with a beginning exceeds that of others,
    ratio: float = 15.0
    #: and how unlikely its count is by chance, as a log-likelihood ratio.
    surprise: float = 12.0


def _codes() -> np.ndarray:
    """A code from 2 to 63 for each character; the common letters have their own."""
    out = np.array([2 + (i * 2654435761 >> 7) % 62 for i in range(0x300)], np.uint8)
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyzßàáâäçèéêëìíîïñòóôöùúûüœæøåãõ"):
        out[ord(c)] = 2 + i
    return out


_CODE = _codes()


def coded(words: list[str]) -> np.ndarray:
    """Codes of each word after a mark of its start; zero beyond its end."""
    n = max(map(len, words), default=0)
    points = np.array(words, dtype=f"<U{max(n, 1)}").view(np.uint32).reshape(len(words), -1)
    codes = np.where(points == 0, 0, _CODE[np.minimum(points, 0x2FF)]).astype(np.int32)
    codes = np.where(points >= 0x300, 2 + (points * np.uint32(2654435761) >> 9) % 62, codes).astype(np.int32)
    return np.concatenate([np.ones((len(words), 1), np.int32), codes], 1)


def _subsequences(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
    """(table, places in it, where valid, weight) for each shape of a subsequence."""
    n = codes.shape[1]
    for table, shapes in ((0, TRIPLES), (1, QUADS)):
        for shape in shapes:
            span = n - shape[-1]
            if span <= 0:
                continue
            at = codes[:, :span]
            for o in shape:
                at = at * 64 + codes[:, o : o + span]
            if table:
                at = (at.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - _TABLE)
            yield table, at, codes[:, shape[-1] :] > 0, DECAY ** (shape[-1] - len(shape))


def _norms(codes: np.ndarray) -> np.ndarray:
    """Length of each word's map, were all its subsequences different."""
    total = np.full(len(codes), 1e-9)
    for _, _, valid, weight in _subsequences(codes):
        total += weight * weight * valid.sum(1)
    return np.sqrt(total)


class Weights:
    """A linear function of a word's subsequences."""

    def __init__(self) -> None:
        self.tables = [np.zeros(1 << 18, np.float32), np.zeros(1 << _TABLE, np.float32)]

    def add(self, codes: np.ndarray, factor: np.ndarray) -> None:
        share = factor / _norms(codes)
        for table, at, valid, weight in _subsequences(codes):
            np.add.at(self.tables[table], at[valid], (np.broadcast_to(share[:, None], at.shape)[valid] * weight).astype(np.float32))

    def of(self, codes: np.ndarray) -> np.ndarray:
        total = np.zeros(len(codes), np.float32)
        for table, at, valid, weight in _subsequences(codes):
            total += weight * np.where(valid, self.tables[table][at], 0).sum(1)
        return total / _norms(codes)


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """The kernel of each left with each right word."""
    codes = coded(left)
    out = np.empty((len(left), len(right)), np.float32)
    for j, word in enumerate(right):
        one = Weights()
        one.add(coded([word]), np.ones(1))
        out[:, j] = one.of(codes)
    return out


def _kernel_sparse(left: list[str], right: list[str]) -> np.ndarray:
    """As :func:`kernel`, by one table of right words for each subsequence that they have."""
    codes = coded(right)
    share = 1 / _norms(codes)
    rows = [[], []]
    for table, at, valid, weight in _subsequences(codes):
        which = np.nonzero(valid)
        rows[table].append((at[valid], which[0], share[which[0]] * weight))
    found, values = [], []
    for parts in rows:
        at = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        keys, code = np.unique(at, return_inverse=True)
        table = np.zeros((len(keys) + 1, len(right)), np.float32)
        if parts:
            np.add.at(table, (code, np.concatenate([p[1] for p in parts])), np.concatenate([p[2] for p in parts]).astype(np.float32))
        found.append(keys)
        values.append(table)
    out = np.zeros((len(left), len(right)), np.float32)
    codes = coded(left)
    for table, at, valid, weight in _subsequences(codes):
        keys = found[table]
        if not len(keys):
            continue
        place = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
        place = np.where(valid & (keys[place] == at), place, len(keys))  # the last row is zero
        for j in range(place.shape[1]):
            some = np.flatnonzero(place[:, j] < len(keys))
            if len(some):
                out[some] += values[table][place[some, j]] * np.float32(weight)
    return out / _norms(codes)[:, None].astype(np.float32)


def units(token: str) -> list[str]:
    """Words of a token without white space: its letter runs, and its letters without the signs between."""
    runs = _LETTERS.findall(token)
    if len(runs) > 1:
        runs.append(_SIGNS.sub("", token))
    out = []
    for r in runs:
        if len(r) <= LENGTH:
            out.append(r)
        else:
            out += [r[i : i + LENGTH] for i in range(0, len(r) - LENGTH // 2, LENGTH // 2)]
    return [r for r in out if len(r) > 1]


def tokens(text: str | None) -> set[str]:
    low = (text or "").lower()
    out = set(low.split())
    out.update(m[0].replace(" ", "") for m in _SPELLED.finditer(low))
    return out


@dataclass
class Model:
    weights: Weights = field(default_factory=Weights)
    bias: float = -1.0
    #: Of the highest word score, the mean of the three highest, the number above zero, the number of words, and one.
    text: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, 0.0, 0.0, -1e9]))

    def words(self, some: list[str]) -> np.ndarray:
        out = np.empty(len(some))
        order = sorted(range(len(some)), key=lambda i: len(some[i]))
        for at in range(0, len(order), 20_000):
            part = order[at : at + 20_000]
            out[part] = self.weights.of(coded([some[i] for i in part])) + self.bias
        return out

    def remember(self, known: dict[str, float], some: set[str]) -> None:
        """Score the tokens that are not known yet; a token has its best word's score."""
        new = [t for t in some if t not in known]
        parts = [units(t) for t in new]
        flat = sorted({u for p in parts for u in p})
        if flat:
            score = dict(zip(flat, self.words(flat).tolist()))
            known.update((t, max((score[u] for u in p), default=-9.0)) for t, p in zip(new, parts))
        else:
            known.update((t, -9.0) for t in new)


def features(scores: list[float]) -> tuple[float, ...]:
    high_all = [x for x in scores if x > -0.5]
    high = sorted(high_all)[-3:]
    best = high[-1] if high else max(scores, default=-1.0)
    best = max(best, -1.0)
    return best, (sum(high) - (3 - len(high))) / 3, math.log1p(sum(x > 0 for x in high_all)), math.log1p(len(scores)), 1.0


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 50.0) -> np.ndarray:
    """Squared hinge loss by Newton's method; the last column of x is one."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(25):
        active = y * (x @ w) < 1
        xa, ca = x[active], (cost * weight[active])[:, None]
        new = np.linalg.solve(ridge + xa.T @ (ca * xa), xa.T @ (ca[:, 0] * y[active]))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ ((p * (1 - p))[:, None] * x) + 1e-2 * np.eye(x.shape[1]), x.T @ (y - p) - 1e-2 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


class _Sample:
    """Labelled sentences as sets of word numbers, with the beginnings of each word."""

    def __init__(self, texts: list[str | None], toxic: list[int]):
        self.toxic = np.array(toxic, bool)
        number: dict[str, int] = {}
        self.docs = []
        for t in texts:
            own = {number.setdefault(u, len(number)) for token in sorted(tokens(t)) for u in units(token)}
            self.docs.append(np.array(sorted(own), np.int32))
        self.words = list(number)
        n = len(self.words)
        keys = [np.arange(n, dtype=np.int64) | 9 << 48]
        owner = [np.arange(n)]
        for at in range(0, n, 50_000):
            codes = coded(self.words[at : at + 50_000]).astype(np.int64)
            packed = np.zeros(len(codes), np.int64)
            for k in range(1, min(8, codes.shape[1])):
                packed = packed * 64 + codes[:, k]
                longer = codes[:, k + 1] > 0 if k + 1 < codes.shape[1] else np.zeros(len(codes), bool)
                if k >= 4:
                    keys.append(packed[longer] | k << 48)
                    owner.append(at + np.flatnonzero(longer))
        found, start = np.unique(np.concatenate(keys), return_inverse=True)
        owner_ = np.concatenate(owner)
        order = np.argsort(owner_, kind="stable")
        self.start, self.n_starts = start[order].astype(np.int32), len(found)
        self.start_of = np.concatenate([[0], np.cumsum(np.bincount(owner_, minlength=n))])

    def _counts(self, which: np.ndarray) -> np.ndarray:
        """In how many of these sentences each beginning occurs."""
        out = np.zeros(self.n_starts, np.int32)
        for i in np.flatnonzero(which):
            own = self.docs[i]
            size = (self.start_of[own + 1] - self.start_of[own]).astype(np.int64)
            at = np.repeat(self.start_of[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            out[np.unique(self.start[at])] += 1
        return out

    def _words_in(self, which: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.words), np.int32)
        for i in np.flatnonzero(which):
            out[self.docs[i]] += 1
        return out

    def testify(self, used: np.ndarray, t: Training) -> np.ndarray:
        """Which words have a beginning that marks toxic sentences among those used, and not by chance."""
        if not self.words:
            return np.zeros(0, bool)
        p, n = self._counts(used & self.toxic).astype(float), self._counts(used & ~self.toxic).astype(float)
        bad, good = max(1, (used & self.toxic).sum()), max(1, (used & ~self.toxic).sum())
        base, share = bad / (bad + good), p / np.maximum(p + n, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            surprise = np.nan_to_num(p * np.log(share / base)) + np.nan_to_num(n * np.log((1 - share) / (1 - base)))
        rich = (surprise > t.surprise) & (p / bad > t.ratio * (n + 0.5) / good)
        return np.bitwise_or.reduceat(rich[self.start], self.start_of[:-1])

    def machine(self, used: np.ndarray, t: Training) -> Model:
        """Train words of the sentences used."""
        testify = self.testify(used, t)
        count_bad, count_good = self._words_in(used & self.toxic), self._words_in(used & ~self.toxic)
        positive = np.flatnonzero(testify & (count_bad > 0))
        negative = np.flatnonzero(~testify & (count_good > 0))
        model = Model()
        if not len(positive) or not len(negative):
            return model
        rng = np.random.default_rng(7)
        positive = positive[np.argsort(-count_bad[positive], kind="stable")][: t.words // 2]
        some = rng.permutation(negative)[: t.words]
        landmarks = []
        for side, count in ((positive[:800], count_bad), (some[np.argsort(-count_good[some], kind="stable")][:800], count_good)):
            landmarks += _landmarks([self.words[i] for i in side], count[side], t.landmarks // 2)
        often = negative[np.argsort(-count_good[negative], kind="stable")]
        some = np.union1d(some, often[:2000])
        model = self._fit(landmarks, positive, some, count_bad, count_good)
        rest = np.concatenate([often[:20_000], rng.permutation(often[20_000:])[:40_000]])
        for _ in range(2):
            # clean words that the machine takes for toxic, or nearly, join the training, some of them as landmarks
            score = model.words([self.words[i] for i in rest])
            order = np.argsort(-score, kind="stable")[: t.words // 4]
            worst, height = rest[order], score[order]
            some = np.union1d(some, worst)
            near = worst[np.argsort(-(height + 1) * np.sqrt(count_good[worst]), kind="stable")][: t.landmarks // 4]
            landmarks = list(dict.fromkeys(landmarks + [self.words[i] for i in near]))
            model = self._fit(landmarks, positive, some, count_bad, count_good)
        return model

    def _fit(self, landmarks: list[str], positive: np.ndarray, negative: np.ndarray, count_bad: np.ndarray, count_good: np.ndarray) -> Model:
        """One machine; words weigh by the root of their occurrences."""
        gram = kernel(landmarks, landmarks).astype(float)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        good = values > 1e-4 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        x = _kernel_sparse([self.words[i] for i in np.concatenate([positive, negative])], landmarks) @ root
        x = np.concatenate([x, np.ones((len(x), 1))], 1)
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        weight = np.concatenate([np.sqrt(count_bad[positive]), np.sqrt(count_good[negative])])
        for side in (y > 0, y < 0):
            weight[side] *= 1000 / weight[side].sum()
        w = _svm(x, y, weight)
        model = Model(bias=float(w[-1]))
        model.weights.add(coded(landmarks), root @ w[:-1])
        return model

    def scores(self, model: Model, which: np.ndarray) -> np.ndarray:
        """Features of some sentences."""
        needed = np.flatnonzero(self._words_in(which))
        score = np.full(len(self.words), -9.0)
        score[needed] = model.words([self.words[i] for i in needed])
        return np.array([features(score[self.docs[i]].tolist()) for i in np.flatnonzero(which)]).reshape(-1, 5)


def _landmarks(words: list[str], count: np.ndarray, n: int) -> list[str]:
    """Words that span the others best, frequent ones before others: pivoted Cholesky of their kernel."""
    if len(words) <= n:
        return list(words)
    gram = _kernel_sparse(words, words).astype(float)
    left, rows, out = gram.diagonal().copy(), [], []
    for _ in range(n):
        i = int(np.argmax(left * count))
        if left[i] < 1e-6:
            break
        row = gram[i] - sum(r[i] * r for r in rows) if rows else gram[i].copy()
        row = row / np.sqrt(left[i])
        rows.append(row)
        left = left - row * row
        left[i] = 0
        out.append(words[i])
    return out


def train(texts: list[str | None], toxic: list[int], t: Training = Training(), share: float | None = None) -> Model:
    """Three in four sentences train the machine, the others the model of its scores.

    ``share`` is the part of all labelled sentences that is toxic, if the sample has another.
    """
    if not 0 < sum(map(bool, toxic)) < len(toxic):
        return Model()
    sample = _Sample(texts, toxic)
    apart = np.zeros(len(toxic), bool)
    for kind in (sample.toxic, ~sample.toxic):
        apart[np.flatnonzero(kind)[::4]] = True
    model = sample.machine(~apart, t)
    model.text = _logistic(sample.scores(model, apart), sample.toxic[apart].astype(float))
    if share and 0 < share < 1:
        odds = lambda p: math.log(p / (1 - p))
        model.text[-1] += odds(share) - odds(sample.toxic.mean())
    return model


def held_out(id_col: Column) -> Column:
    """The rows that no training sees: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, t: Training = Training(), id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> Model:
    """Train on a bounded sample of the labelled rows that are not held out."""
    rows = (
        labels.select(F.col(id_col).cast("long").alias("i"), F.col(toxic_col).cast("int").alias("y"))
        .dropna()
        .where(~held_out(F.col("i")))
        .groupBy("i")
        .agg(F.max("y").alias("y"))
    )
    order = F.xxhash64("i", F.lit(3))
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    chosen = rows.where("y = 1").orderBy(order).limit(t.toxic_rows).unionAll(rows.where("y = 0").orderBy(order).limit(t.clean_rows))
    some = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    some = some.where(F.col("i").isNotNull() & ~held_out(F.col("i")) & (F.char_length("t") <= t.longest))
    # at most toxic_rows + clean_rows ids
    got = some.join(F.broadcast(chosen), "i").select("i", "y", "t").collect()
    got.sort(key=lambda r: (r.i, r.t))
    got = [r for k, r in enumerate(got) if not k or r.i != got[k - 1].i]
    return train([r.t for r in got], [r.y for r in got], t, share)


def _texts_scored(column: pa.Array, model: Model, known: dict[str, float]) -> np.ndarray:
    own = [tokens(t) for t in column.to_pylist()]
    if len(known) > REMEMBERED:
        known.clear()
    model.remember(known, set().union(*own))
    x = np.array([features([known[t] for t in some]) for some in own]).reshape(-1, 5)
    return 1 / (1 + np.exp(-np.clip(x @ model.text, -40, 40)))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            for part in sliced(batch, "t", TEXTS):
                yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(_texts_scored(part.column("t"), sent.value, known), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(task(run), "doc_id long, score double")


def clean(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            for part in sliced(batch, text_col, TEXTS):
                yield part.filter(pa.array(_texts_scored(part.column(text_col), sent.value, known) < threshold))

    return docs.mapInArrow(task(run), docs.schema)
