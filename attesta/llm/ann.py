"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Trees are fitted on a bounded sample: a node splits its sample at the median of
its projection on the difference of two sample vectors. Vectors are lengthened
by one component that makes them equally long (and queries by zero), which turns
the largest inner product into the smallest distance. Every vector is dealt to
one leaf of each tree. A query goes through all trees at once by one priority
queue, ordered by the smallest margin on the way, and takes the leaves that come
off first until their share of the rows is reached. Vectors and queries that
share a leaf meet by a shuffle on buckets of leaves; there candidates are scored
exactly, in tiles of bounded size, and each bucket sends a query's best. Vectors
of doubles stay doubles, and products are taken in double precision.

Equal vectors are one candidate with its smallest ids, and one query, so a
vector that a third of all rows hold is no hot leaf.

Defined results: a vector that is null, empty, zero, or holds a null or a
non-finite component takes no part, nor does one whose length is not the most
frequent one; rows with a null id take no part; of repeated ids one row counts,
that with the least vector; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _store
from ._bytes import task


#: Products of queries and vectors that are in memory at once.
TILE = 8 << 20


@dataclass(frozen=True)
class Settings:
    trees: int = 6
    #: Rows of the fitting sample, and components of all its vectors together.
    sample: int = 20_000
    components: int = 8 << 20
    #: Rows of a leaf that the trees aim at, and sample rows that a leaf has at least.
    leaf: int = 64
    least: int = 8
    #: Share of a tree's rows that a query takes, over all trees together, for so many rows or fewer,
    share: float = 1.6
    rows: int = 2_000
    #: and the power of the rows by which it falls beyond, so that candidates grow slower than the table.
    fall: float = 0.2
    #: Queries that meet a bucket's vectors at once.
    block: int = 20_000
    seed: int = 11


@dataclass(frozen=True)
class Tree:
    """Nodes as arrays; a child below zero is leaf ~child."""

    normal: np.ndarray
    cut: np.ndarray
    children: np.ndarray
    sizes: np.ndarray  # sample rows of each leaf


def _grown(x: np.ndarray, limit: int, rng: np.random.Generator) -> Tree:
    normals, cuts, children, sizes = [], [], [], []
    stack = [(np.arange(len(x)), -1, 0)]
    while stack:
        rows, parent, side = stack.pop()
        child = None
        if len(rows) > limit:
            a, b = x[rng.choice(rows, 2, replace=False)]
            normal = (a - b).astype(np.float32)
            length = np.linalg.norm(normal)
            if length < 1e-12:
                normal = rng.standard_normal(x.shape[1]).astype(np.float32)
                length = np.linalg.norm(normal)
            normal = normal / length
            at = x[rows] @ normal
            cut = float(np.median(at))
            right = at > cut
            if 0 < right.sum() < len(rows):
                child = len(normals)
                normals.append(normal)
                cuts.append(cut)
                children.append([0, 0])
                stack += [(rows[~right], child, 0), (rows[right], child, 1)]
        if child is None:
            child = ~len(sizes)
            sizes.append(len(rows))
        if parent >= 0:
            children[parent][side] = child
    width = x.shape[1]
    return Tree(np.array(normals, np.float32).reshape(-1, width), np.array(cuts, np.float32), np.array(children, np.int64).reshape(-1, 2), np.array(sizes))


def lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest * longest - (x.astype(np.float64) ** 2).sum(1), 0))
    return np.concatenate([x, rest[:, None]], 1).astype(np.float32)


def leaves(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each vector."""
    at = np.zeros(len(x), np.int64) if len(tree.cut) else np.full(len(x), -1, np.int64)
    while (inner := np.flatnonzero(at >= 0)).size:
        node = at[inner]
        right = np.einsum("ij,ij->i", x[inner], tree.normal[node]) > tree.cut[node]
        at[inner] = tree.children[node, right.astype(np.int64)]
    return ~at


def visited(forest: list[Tree], q: np.ndarray, wanted: float) -> list[list[tuple[int, int]]]:
    """For each query, the (tree, leaf) that come first off its queue, with at least ``wanted`` sample rows."""
    margins = [(q @ t.normal.T - t.cut).tolist() for t in forest]
    kids = [t.children.tolist() for t in forest]
    sizes = [t.sizes.tolist() for t in forest]
    out = []
    for i in range(len(q)):
        queue = [(-np.inf, k, 0 if len(t.cut) else -1) for k, t in enumerate(forest)]
        heapq.heapify(queue)
        taken, mine = 0.0, []
        rows = [m[i] for m in margins]
        while queue and taken < wanted:
            worst, k, node = heapq.heappop(queue)
            while node >= 0:  # straight down the near side; the far side waits for its margin
                m = rows[k][node]
                near, far = (1, 0) if m > 0 else (0, 1)
                heapq.heappush(queue, (max(worst, abs(m)), k, kids[k][node][far]))
                node = kids[k][node][near]
            mine.append((k, ~node))
            taken += sizes[k][~node]
        out.append(mine)
    return out


def _kind(rows: DataFrame, vector_col: str) -> str:
    """float for vectors of floats, double for all other numbers."""
    return "float" if rows.select(F.col(f"`{vector_col}`")).schema[0].dataType.simpleString() == "array<float>" else "double"


def _valid(rows: DataFrame, id_col: str, vector_col: str, kind: str) -> DataFrame:
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v")).where("id is not null and v is not null")
    v = F.col("v")
    rows = rows.where(F.size(v) > 0).where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))).where(F.exists(v, lambda x: x != 0))
    # minus zero is zero
    return rows.select("id", F.transform(v, lambda x: x + F.lit(0.0).cast(kind)).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


def nearest(rows: DataFrame, k: int = 20, every: int = 20, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``."""
    spark = rows.sparkSession
    kind = _kind(rows, vector_col)
    valid = _valid(rows, id_col, vector_col, kind)
    sizes = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = sizes.d
    valid = valid.where(F.size("v") == d)
    valid = _store.kept(valid.groupBy("id").agg(F.min("v").alias("v")).withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64(F.lit(1), "v")))
    # of each vector, as many ids as a query can need; salted first, as a vector may be very common
    first = Window.partitionBy("h", "g", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    again = Window.partitionBy("h", "g").orderBy("id")
    few = valid.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).withColumn("r", F.row_number().over(again)).where(F.col("r") <= k + 1)
    classes = _store.kept(few.groupBy("h", "g").agg(F.min("id").alias("class"), F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids")))
    n, longest = classes.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))).first()
    size = max(settings.least, min(settings.sample, settings.components // d))
    taken = classes.orderBy("h", "g").limit(size).select("v").toArrow().column("v").combine_chunks()
    sample = lengthened(_matrix(taken), longest)
    rng = np.random.default_rng(settings.seed)
    limit = max(settings.least, round(settings.leaf * len(sample) / n))
    sent = spark.sparkContext.broadcast([_grown(sample, limit, rng) for _ in range(settings.trees)])
    buckets = max(_store.partitions(spark), -(-n * settings.trees * d * 4 // (32 << 20)))
    wanted = settings.share * min(1.0, (settings.rows / n) ** settings.fall) * len(sample)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = lengthened(_matrix(batch.column("v")), longest)
            for t, tree in enumerate(sent.value):
                leaf = leaves(tree, x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_bucket(t, leaf, buckets)), pa.array(leaf * settings.trees + t), batch.column("class"), batch.column("v")], ["bucket", "leaf", "class", "v"]
                )

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("v"))
            q = np.concatenate([q, np.zeros((len(q), 1))], 1).astype(np.float32)
            rows = []
            for i, own in enumerate(visited(sent.value, q, wanted)):
                tree, leaf = np.array(own, np.int64).T
                at = _bucket(tree, leaf, buckets)
                order = np.argsort(at, kind="stable")
                named = (leaf * settings.trees + tree)[order]
                rows += [(int(x), i, named[a:b]) for x, a, b in zip(*_edges(at[order]))]
            at = pa.array([r[1] for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), batch.column("class").take(at), batch.column("v").take(at)], ["bucket", "leaves", "class", "v"]
            )

    queries = valid.where(F.pmod("id", F.lit(every)) == 0).select("id", "h", "g").join(classes.select("h", "g", "class"), ["h", "g"]).select("id", "class")
    queries = _store.kept(queries)
    asking = classes.join(queries.select("class").distinct(), "class", "left_semi").select("class", "v")
    blocks = max(1, -(-asking.count() // settings.block))
    v_rows = classes.select("class", "v").mapInArrow(task(dealt), f"bucket long, leaf long, class long, v array<{kind}>")
    v_rows = v_rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q_rows = asking.mapInArrow(task(asked), f"bucket long, leaves array<long>, class long, v array<{kind}>").withColumn("block", F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int"))

    def met(left, right):
        v, ids, leaf = _matrix(left.column("v").combine_chunks()).astype(np.float64), left.column("class").to_numpy(), left.column("leaf").to_numpy()
        out = []
        if len(ids) and right.num_rows:
            order = np.argsort(leaf, kind="stable")
            v, ids, leaf = v[order], ids[order], leaf[order]
            # a class may be here from several trees
            one = np.unique(ids, return_index=True)[1]
            number = {int(c): i for i, c in enumerate(ids[one])}
            column = np.array([number[int(c)] for c in ids])
            v, names = v[one], ids[one]
            here, held = np.unique(leaf, return_inverse=True)
            q = _matrix(right.column("v").combine_chunks()).astype(np.float64)
            tile, done = max(1, TILE // len(v)), 0
            scores = np.zeros((0, len(v)))
            long = np.linalg.norm(v, axis=1).max()
            asks = right.column("class").to_pylist()
            for i, own in enumerate(right.column("leaves").to_pylist()):
                if i >= done + len(scores):
                    done = i
                    scores = q[i : i + tile] @ v.T
                place = np.minimum(np.searchsorted(here, own), len(here) - 1)
                taken = np.zeros(len(here), bool)
                taken[place[here[place] == own]] = True
                some = np.zeros(len(names), bool)
                some[column[taken[held]]] = True
                at = np.flatnonzero(some)
                if not len(at):
                    continue
                s = scores[i - done, at]
                if len(at) > k + 1:  # all that may tie with the last, as these products are rounded otherwise
                    rounding = 4 * v.shape[1] * np.finfo(np.float64).eps * np.linalg.norm(q[i]) * long
                    at = at[s >= -np.partition(-s, k)[k] - rounding]
                s = (v[at] * q[i]).sum(1)
                best = np.lexsort((names[at], -s))[: k + 1]
                out.append((asks[i], names[at][best], s[best]))
        lists = [pa.array([r[j].tolist() for r in out], pa.list_(kind)) for j, kind in ((1, pa.int64()), (2, pa.float64()))]
        return pa.table([pa.array([r[0] for r in out], pa.int64()), *lists], ["query", "class", "score"])

    partial = v_rows.groupBy("bucket", "block").cogroup(q_rows.groupBy("bucket", "block")).applyInArrow(met, "query long, class array<long>, score array<double>")
    lists = partial.groupBy("query").agg(F.flatten(F.collect_list(F.arrays_zip("class", "score"))).alias("x"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for query, pairs in zip(batch.column("query").to_pylist(), batch.column("x")):
                names, scores = (pairs.values.field(j).to_numpy() for j in (0, 1))
                names, one = np.unique(names, return_index=True)  # a class comes from several trees
                scores = scores[one]
                order = np.lexsort((names, -scores))[: k + 1]
                out.append((np.full(len(order), query), names[order], scores[order]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query", "class", "score"])

    found = lists.mapInArrow(task(best), "query long, class long, score double")
    found = found.join(classes.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    each = queries.select(F.col("id").alias("query_id"), F.col("class").alias("query")).join(found, "query").where("query_id <> vec_id")
    last = Window.partitionBy("query_id").orderBy("r")
    return each.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _bucket(tree: int, leaf: np.ndarray, buckets: int) -> np.ndarray:
    return (leaf * 2654435761 + tree * 40503) % buckets


def _edges(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.concatenate([[0], np.flatnonzero(np.diff(sorted_)) + 1, [len(sorted_)]])
    return sorted_[at[:-1]], at[:-1], at[1:]
