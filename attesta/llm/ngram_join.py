"""Jaccard self-join on sets of word n-grams, by universe partitions.

Sets are split into size bands; two similar sets are in the same band or in
neighbouring ones. In each band the universe of n-gram hashes is split into an
even number m of segments, more than the most places in which two similar sets
of the band can differ. Segments are taken in pairs, each with two credits to
spend: by the pigeonhole principle some pair holds at most one difference, so

* one of its two segments is equal and not empty in both sets: both sets index
  the exact subset of every segment that is not empty, for one row each; or
* one segment is empty in both sets and the other differs by one n-gram or
  none. An exact subset can't be afforded there, as the empty one is shared by
  everybody; so the credit goes to the one-deletion neighbourhood of the other
  segment, which is indexed only by sets with an empty half.

Candidates are then verified exactly. No similar pair of different sets is
lost. Sets that are equal are one set from the start.

Verifying. Sizes and odd sketches, which never drop a similar pair, thin the
candidates; what is left makes components, a superset of the real ones. The
texts of a component meet in chunks of bounded size, where every pair is judged
exactly; most components are one chunk. Larger ones are dealt into chunks at
random a few times, which joins most of a group of near copies; then every
document outside a component's largest class meets every other document of the
component once, block by block. That last step leaves no pair of different
classes unjudged.

Defined results: a text's words are runs of other bytes than white space, with
A-Z as a-z; a null or empty text and one without words has no n-grams and
links with nothing; a text with fewer words than n has one n-gram, all of it;
repeated rows of one id are one document with the n-grams of the smallest set
key; rows with a null id are left out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _packed, _store
from ._bytes import mix, sliced, task, windows, words
from ._components import components

_U = np.uint64
#: Longs of the shortest sketch, of 64 bits each.
SKETCH = 8

#: Documents and n-grams of a component up to which all its pairs are judged in one chunk.
CHUNK, CHUNK_NGRAMS = 64, 1 << 21
#: Documents and n-grams of one side of a block in the last step.
BLOCK, BLOCK_NGRAMS = 1024, 1 << 19
#: Random dealings of the larger components.
DEALS = 3
#: Documents of a run of one subset up to which all its pairs are candidates one by one,
RUN = 12
#: and up to which a run is thinned in one task; the parts of a longer run meet two by two.
THINNED = 4096
#: Rows up to which the candidates' ids are sent to all executors rather than shuffled.
SENT = 500_000


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Distinct n-gram hashes of one text's word hashes, sorted."""
    if not len(h):
        return np.zeros(0, _U)
    return np.unique(windows(h, min(n, len(h))) + (_U(0) if len(h) >= n else _U(len(h))))


def _texts(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    for part in sliced(batch, "t"):
        got = words(part.column("t"))
        for i, doc in enumerate(part.column("i").to_pylist()):
            yield doc, shingles(got.hash[got.first[i] : got.first[i + 1]], n)


def set_key(ids: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    if not len(ids):
        return 0, 0
    a, b = mix(ids ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U), mix(ids ^ _U(0x14057B7EF767814F)).sum(dtype=_U)
    return int(a.astype(np.int64)), int((b + _U(len(ids))).astype(np.int64))


def sketch(ids: np.ndarray) -> np.ndarray:
    """Odd sketch: the parity of how many ids fall on each bit, with as many bits as ids at least.

    The places in which two sketches differ are no more than those in which the
    sets differ. A sketch folds to half its length by xor of its halves.
    """
    bits = max(SKETCH * 64, 1 << (max(1, len(ids)) - 1).bit_length())
    odd = np.bincount((ids & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(s: np.ndarray, longs: int) -> np.ndarray:
    while len(s) > longs:
        s = s[: len(s) // 2] ^ s[len(s) // 2 :]
    return s


class Bands:
    """Size bands for similarity of at least p / q, and the segments of each."""

    def __init__(self, p: int, q: int):
        if not 0 < p <= q:
            raise ValueError("the threshold must be above 0 and at most 1")
        self.p, self.q = p, q

    def least(self, total: int) -> int:
        """Common ids that two similar sets with so many ids together need."""
        return -(-self.p * total // (self.p + self.q))

    def of(self, size: int) -> int:
        """The lower end of the band that holds a size."""
        low = 1
        while low * self.q // self.p < size:
            low = low * self.q // self.p + 1
        return low

    def below(self, low: int) -> int | None:
        prior, at = None, 1
        while at < low:
            prior, at = at, at * self.q // self.p + 1
        return prior

    def segments(self, low: int) -> int:
        """Even, and more than the places in which similar sets can differ; 0 if only equal sets are similar."""
        high = low * self.q // self.p
        most = 0
        for total in range(2 * low, high + high * self.q // self.p + 1):
            most = max(most, total - 2 * self.least(total))
            if total > 2 * low + 400:  # beyond, the largest total decides
                total = high + high * self.q // self.p
                most = max(most, total - 2 * self.least(total), total - 1 - 2 * self.least(total - 1))
                break
        return 0 if most == 0 else most + 1 + (most + 1) % 2


class _Plan:
    def __init__(self, p: int, q: int):
        self.bands, self.known = Bands(p, q), {}

    def of(self, size: int) -> list[tuple[int, int]]:
        """(band, segments) that a set of this size is indexed under."""
        if size not in self.known:
            low = self.bands.of(size)
            under = [low]
            prior = self.bands.below(low)
            if prior is not None and -(-self.bands.p * size // self.bands.q) < low:
                under.append(prior)
            self.known[size] = [(b, m) for b in under if (m := self.bands.segments(b))]
        return self.known[size]


def signatures(ids: np.ndarray, plan: _Plan) -> tuple[np.ndarray, np.ndarray]:
    """Keys of one set: exact subsets, and one-deletion neighbourhoods beside empty segments.

    With each key, whether it is of the set's own band; a pair is found in the
    band of its smaller set, so keys that no set has in its own band find none.
    """
    out, home = [], []
    mixed = mix(ids)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mixed, dtype=_U)])
    own = plan.bands.of(len(ids)) if len(ids) else 0
    for band, m in plan.of(len(ids)):
        before = len(out)
        cut = np.searchsorted(((ids >> _U(32)) * _U(m)) >> _U(32), np.arange(m + 1, dtype=_U))
        subset = sums[cut[1:]] - sums[cut[:-1]]
        size = np.diff(cut)
        salt = mix(np.arange(m, dtype=_U) + _U(band) * _U(1 << 32))
        full = size > 0
        out.append(mix(subset[full] + salt[full]))
        other = np.arange(m) ^ 1
        bare = ~full & ~full[other]
        if bare.any():
            out.append(mix(salt[bare]))
        for s in np.flatnonzero(full & ~full[other]):
            out.append(mix(subset[s] - mixed[cut[s] : cut[s + 1]] + salt[s]))
        home += [np.full(len(x), band == own, np.uint8) for x in out[before:]]
    if not out:
        return np.zeros(0, _U), np.zeros(0, np.uint8)
    keys, first = np.unique(np.concatenate(out), return_index=True)
    return keys, np.concatenate(home)[first]


def summaries(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, s) of every row, s the odd sketch; docs has columns i and t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, len(ids), *set_key(ids), sketch(ids)) for doc, ids in _texts(batch, n)]
            if rows:
                *numbers, sketches = zip(*rows)
                ends = np.cumsum([0, *map(len, sketches)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sketches)))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in numbers), lists], ["doc_id", "n_shingles", "k1", "k2", "s"])

    return docs.mapInArrow(task(run), "doc_id long, n_shingles long, k1 long, k2 long, s array<long>")


def _chosen(docs: DataFrame, several: DataFrame, n: int) -> DataFrame:
    """The rows, but of ids with several sets only those of the chosen one; several has i, k1, k2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist())
            keep = [k[0] is None or k == tuple(set_key(ids)) for k, (_, ids) in zip(chosen, _texts(batch, n))]
            yield batch.select(["i", "t"]).filter(pa.array(keep, pa.bool_()))

    return docs.join(several, "i", "left").select("i", "t", "k1", "k2").mapInArrow(task(run), "i long, t string")


def _indexed(docs: DataFrame, n: int, p: int, q: int) -> DataFrame:
    """Packed (signature, first half of the set's key): copies are one, wherever they are."""
    many = _packed.buckets(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, seen = _Plan(p, q), set()
        for batch in batches:
            sigs, homes, owner, held = [], [], [], 0
            for _, ids in _texts(batch, n):
                key = set_key(ids)
                if not len(ids) or key in seen:
                    continue
                seen.add(key)
                s, home = signatures(ids, plan)
                sigs.append(s)
                homes.append(home)
                owner.append(np.full(len(s), key[0], np.int64))
                held += len(s)
                if held > 1 << 20:
                    yield _sent(sigs, homes, owner, many)
                    sigs, homes, owner, held = [], [], [], 0
            if held:
                yield _sent(sigs, homes, owner, many)

    return docs.mapInArrow(task(run), _packed.schema(["sig", "set", "home"]))


def _sent(sigs: list, homes: list, owner: list, many: int) -> pa.RecordBatch:
    sig = np.concatenate(sigs)
    return _packed.pack((sig % _U(many)).astype(np.int32), {"sig": sig, "set": np.concatenate(owner), "home": np.concatenate(homes)})


def _runs(packed: DataFrame) -> DataFrame:
    """Of signatures that several sets have: pairs (null, a, b) of short runs, (sig, first member, member) of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _packed.unpack(batches, {"sig": _U, "set": np.int64, "home": np.uint8})
        order = np.lexsort((got["set"], got["sig"]))
        sig, doc, home = got["sig"][order], got["set"][order], got["home"][order]
        if len(sig) < 2:
            return
        fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])])
        sig, doc, home = sig[fresh], doc[fresh], home[fresh]
        first = np.concatenate([[0], np.flatnonzero(sig[1:] != sig[:-1]) + 1, [len(sig)]])
        size = np.diff(first) * np.maximum.reduceat(home, first[:-1])  # runs without a set of the band itself find nothing
        pairs = []
        for n in range(2, RUN + 1):
            at = first[:-1][size == n]
            for x in range(n):
                for y in range(x + 1, n):
                    own = at[(home[at + x] | home[at + y]) > 0]
                    pairs.append(np.stack([doc[own + x], doc[own + y]], 1))
        found = np.unique(np.concatenate(pairs), axis=0)
        long = np.repeat(size > RUN, np.diff(first))
        leader = np.repeat(doc[first[:-1]], np.diff(first))
        for columns in (
            [pa.nulls(len(found), pa.int64()), pa.array(found[:, 0]), pa.array(found[:, 1])],
            [pa.array(sig[long].view(np.int64)), pa.array(leader[long]), pa.array(doc[long])],
        ):
            whole = pa.RecordBatch.from_arrays(columns, ["sig", "a", "b"])
            for at in range(0, whole.num_rows, 1 << 16):
                yield whole.slice(at, 1 << 16)

    return _packed.dealt(packed).mapInArrow(task(run), "sig long, a long, b long")


def _possible(p: int, q: int):
    """Sizes and odd sketches allow similarity; columns na, nb, sa, sb."""
    total = F.col("na") + F.col("nb")
    need = F.ceil(F.lit(p) * total / F.lit(p + q)).cast("long")
    long, short = (F.when((F.size("sa") >= F.size("sb")) == flag, F.col("sa")).otherwise(F.col("sb")) for flag in (F.lit(True), F.lit(False)))
    # similar sets differ in length by less than two if the threshold is above a half; others fold further
    n, times = F.size(short), (F.size(long) / F.size(short)).cast("int")
    fold = lambda x, i: F.aggregate(F.sequence(F.lit(0), times - 1), F.lit(0).cast("long"), lambda z, k: z.bitwiseXOR(F.get(long, k * n + i)))
    differ = F.aggregate(F.transform(short, lambda x, i: F.bit_count(x.bitwiseXOR(fold(x, i)))), F.lit(0), lambda s, x: s + x)
    return (F.lit(q) * F.least("na", "nb") >= F.lit(p) * F.greatest("na", "nb")) & (differ <= total - 2 * need)


def _thinned(rows: DataFrame, p: int, q: int) -> DataFrame:
    """A spanning forest of the possible pairs of each run's cells; rows has sig, x, y, doc, n, s."""

    def run(key, table):
        doc, n = table.column("doc").to_numpy(), table.column("n").to_numpy()
        own = [np.array(x, np.int64) for x in table.column("s").to_pylist()]
        s = np.stack([folded(x, min(map(len, own))) for x in own]).view(_U)
        order = np.argsort(doc)
        doc, n, s = doc[order], n[order], s[order]
        links, left = [], np.arange(len(doc))
        while len(left):  # breadth first through the possible pairs
            queue, left = left[:1], left[1:]
            while len(queue) and len(left):
                x, queue = queue[0], queue[1:]
                total = n[left] + n[x]
                allowed = total - 2 * -(-p * total // (p + q))
                near = np.bitwise_count(s[left] ^ s[x]).sum(1) <= allowed
                near &= q * np.minimum(n[left], n[x]) >= p * np.maximum(n[left], n[x])
                links += [(int(doc[x]), int(y)) for y in doc[left[near]]]
                queue, left = np.concatenate([queue, left[near]]), left[~near]
        return pa.table([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.groupBy("sig", "x", "y").applyInArrow(run, "a long, b long")


def _cells(rows: DataFrame) -> DataFrame:
    """Rows (sig, doc, n, s) of long runs in cells (x, y) of at most some THINNED rows.

    A longer run is dealt into parts, and every two parts meet in a cell, so no
    pair of a run is left out and no cell grows with the run.
    """
    many = rows.groupBy("sig").agg(F.ceil(F.count("doc") / F.lit(THINNED)).alias("many"))
    many = many.select("sig", F.when(F.col("many") == 1, 1).otherwise(2 * F.col("many")).alias("many"))
    own = F.pmod(F.xxhash64("doc"), "many")
    last = F.col("many") - 1
    # a part alone is no cell of its own: its pairs meet in all cells of the part
    others = F.when(last == 0, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), last), lambda k: k != F.col("own")))
    met = rows.join(many, "sig").withColumn("own", own).withColumn("other", F.explode(others))
    return met.select("sig", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "doc", "n", "s")


def _candidates(runs: DataFrame, known: DataFrame, p: int, q: int) -> DataFrame:
    """Edges whose components hold every similar pair; runs as from _runs, known has set, rep, n, s.

    Pairs of short runs, and each member of a long run with its first one, are
    judged by their sketches. That joins most groups of near copies, which share
    many subsets, by one row for each set. The sketches then go to the members
    of those long runs alone in which some member is not yet in the class of
    the first one.

    Where different sets share the first half of their keys, known has a row for
    each, so all of them are candidates.
    """
    long = runs.where("sig is not null")
    pairs = runs.groupBy("a", "b").agg(F.max(F.col("sig").isNotNull()).alias("long"))
    side = lambda x: known.select(F.col("set").alias(x), F.col("rep").alias(f"r{x}"), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}"))
    judged = pairs.join(side("a"), "a").join(side("b"), "b").where("ra <> rb").select("a", "b", "ra", "rb", "long", _possible(p, q).alias("possible"))
    judged = _store.written(judged.where("long or possible"), "judged")
    near = judged.where("possible").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    apart = judged.where("not possible")
    if not apart.limit(1).count():
        return near
    classes = components(near)
    of = lambda x: classes.select(F.col("node").alias(f"r{x}"), F.col("component").alias(f"c{x}"))
    apart = apart.join(of("a"), "ra", "left").join(of("b"), "rb", "left").where("coalesce(ca, ra) <> coalesce(cb, rb)").select("a", "b").distinct()
    mixed = long.join(apart, ["a", "b"], "left_semi").select("sig").distinct()
    members = long.join(mixed, "sig", "left_semi").select("sig", F.col("b").alias("set"))
    rows = members.join(known, "set").select("sig", F.col("rep").alias("doc"), "n", "s").dropDuplicates(["sig", "doc"])
    return near.unionAll(_thinned(_cells(rows), p, q))


def _links(rows: list[tuple[int, np.ndarray]], p: int, q: int, against: set[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs, by an inverted index; against: one side is in it."""
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    links: list[tuple[int, int]] = []
    lengths = np.array([len(s) for _, s in rows])
    if lengths.sum() == 0:
        return links
    _, code = np.unique(np.concatenate([s for _, s in rows]), return_inverse=True)
    order = np.argsort(code, kind="stable")
    owner = np.repeat(np.arange(len(rows)), lengths)[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(code))])
    ends = np.concatenate([[0], np.cumsum(lengths)])
    for x in range(len(rows)):
        if against is not None and rows[x][0] not in against:
            continue
        at = code[ends[x] : ends[x + 1]]
        n = first[at + 1] - first[at]
        which = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        inter = np.bincount(owner[which], minlength=len(rows))
        for y in np.flatnonzero(q * inter >= p * (lengths + lengths[x] - inter)).tolist():
            if y != x and (find(x) != find(y)):
                root[find(y)] = find(x)
                links.append((rows[x][0], rows[y][0]))
    return links


def _judged(met: DataFrame, n: int, p: int, q: int) -> DataFrame:
    """Similar pairs, as a forest, of the texts that meet; met has component, part, doc, t, rest.

    Where some rows have rest, only pairs with one of them are judged.
    """

    def run(key, table):
        rows: dict[int, np.ndarray] = {}
        for batch in table.select(["doc", "t"]).to_batches():
            for part in sliced(batch, "t"):
                got = words(part.column("t"))
                for i, doc in enumerate(part.column("doc").to_pylist()):
                    rows[doc] = shingles(got.hash[got.first[i] : got.first[i + 1]], n)
        rest = {d for d, r in zip(table.column("doc").to_pylist(), table.column("rest").to_pylist()) if r}
        links = _links(sorted(rows.items()), p, q, rest or None)
        return pa.table([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    return met.groupBy("component", "part").applyInArrow(run, "a long, b long")


def _verified(texts: DataFrame, n: int, p: int, q: int) -> DataFrame:
    """Links that join the real components; texts has component, doc, t, n, parts (chunks needed)."""
    no = F.lit(False).alias("rest")
    small = texts.where("parts = 1").select("component", F.lit(0).alias("part"), "doc", "t", no)
    if not texts.where("parts > 1").limit(1).count():
        return _judged(small, n, p, q)
    large = texts.where("parts > 1")
    dealt = [
        large.select("component", (F.lit(k + 1) * 2**40 + F.pmod(F.xxhash64("doc", F.lit(k)), "parts")).cast("long").alias("part"), "doc", "t", no)
        for k in range(DEALS)
    ]
    first = small.withColumn("part", F.col("part").cast("long"))
    for x in dealt:
        first = first.unionAll(x)
    links = _store.written(_judged(first, n, p, q), "links")
    classes = components(links)
    held = large.select("component", "doc", "n").join(classes.withColumnRenamed("node", "doc").withColumnRenamed("component", "class"), "doc", "left").withColumn("class", F.coalesce("class", "doc"))
    held = _store.written(held, "classes")
    sizes = held.groupBy("component", "class").agg(F.count("doc").alias("size"))
    core = sizes.groupBy("component").agg(F.max_by("class", F.struct("size", "class")).alias("core"))
    marked = held.join(core, "component").withColumn("rest", F.col("class") != F.col("core"))
    many = lambda x: F.ceil(F.greatest(F.sum(F.when(x, 1).otherwise(0)) / F.lit(BLOCK), F.sum(F.when(x, F.col("n")).otherwise(0)) / F.lit(BLOCK_NGRAMS)))
    grid = marked.groupBy("component").agg(many(F.lit(True)).alias("across"), many(F.col("rest")).alias("down")).where("down > 0")
    placed = marked.join(grid, "component")
    as_all = placed.select("component", "doc", F.lit(False).alias("rest"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("down") - 1)).alias("y"), F.pmod(F.xxhash64("doc"), "across").alias("x"), "across")
    as_rest = placed.where("rest").select("component", "doc", "rest", F.pmod(F.xxhash64("doc", F.lit(7)), "down").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("across") - 1)).alias("x"), "across")
    cells = as_all.unionAll(as_rest).select("component", "doc", "rest", (F.col("y") * F.col("across") + F.col("x")).alias("part"))
    met = cells.join(large.select("doc", "t"), "doc").select("component", "part", "doc", "t", "rest")
    return links.unionAll(_judged(met, n, p, q))


def joined(docs: DataFrame, n: int = 5, p: int = 4, q: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every id: documents link when q * |A n B| >= p * |A u B|.

    component_id is the smallest id that links lead to, the document itself included.
    """
    d = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i is not null")
    seen = _store.kept(summaries(d, n))
    key = F.struct("k1", "k2")
    one = seen.groupBy("doc_id").agg(F.min(F.struct("k1", "k2", "n_shingles", "s")).alias("x"), (F.min(key) != F.max(key)).alias("several")).select("doc_id", "x.*", "several")
    reps = one.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    known = _store.written(one.join(reps, ["k1", "k2"], "left").select("doc_id", "n_shingles", "s", F.coalesce("rep", "doc_id").alias("rep"), "k1", "k2", "several"), "members")
    several = known.where("several").select(F.col("doc_id").alias("i"), "k1", "k2")
    if several.limit(1).count():
        d = _chosen(d, F.broadcast(several) if several.count() <= SENT else several, n)
    runs = _store.kept(_runs(_indexed(d, n, p, q)))
    edges = _candidates(runs, known.where("doc_id = rep").select(F.col("k1").alias("set"), "rep", F.col("n_shingles").alias("n"), "s"), p, q)
    near = components(edges)
    runs.unpersist()
    seen.unpersist()
    sized = near.join(known.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n")), "node")
    totals = sized.groupBy("component").agg(F.ceil(F.greatest(F.count("node") / F.lit(CHUNK), F.sum("n") / F.lit(CHUNK_NGRAMS))).alias("parts"))
    wanted = _store.written(sized.join(totals, "component").select("component", F.col("node").alias("i"), "n", "parts"), "candidates")
    if not wanted.limit(1).count():
        return known.select("doc_id", "n_shingles", F.col("rep").alias("component_id"))
    if wanted.count() <= SENT:
        texts = d.join(F.broadcast(wanted), "i")
    else:
        texts = d.join(wanted, "i")
    texts = _store.written(texts.select("component", F.col("i").alias("doc"), "t", "n", "parts"), "texts", small=False)
    real = components(_verified(texts, n, p, q))
    return known.join(real.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def distinct(docs: DataFrame, n: int = 5, p: int = 4, q: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component: those of its smallest id.

    Rows with a null id stay.
    """
    free = "gone" + "_" * max(map(len, docs.columns))  # longer than any column's name
    gone = joined(docs, n, p, q, id_col, text_col).where("component_id <> doc_id").select(F.col("doc_id").alias(free))
    gone = _store.written(gone, "gone")
    if gone.count() <= SENT:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(free), "left_anti")
