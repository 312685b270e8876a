"""Exact top-k by inner product: M-trees of paged metric nodes, searched best first.

Vectors are lifted to one length, which makes the search one for smallest
Euclidean distance. Routing objects from a bounded sample split them: each
vector goes to its nearest one, and what gathers at one routing object is dealt
to parts of bounded size, so that no group grows with a cluster. Each part is
loaded as an M-tree: an inner node has routing objects with their covering
radius and the distance to the node's own routing object, a leaf has vectors
with that distance. Nodes are pages, one row each, in a table of the shared
folder; the parts' roots and radii are the directory.

A query goes through a tree by a priority queue of nodes by least possible
distance. In a node, entries whose distance to the routing object, known from
loading, rules them out are passed over without computing their own. It first
searches the part nearest to it; the k-th score found there then rules out
parts by their radii, and the rest are searched from that score on. Parts and
queries meet by a shuffle, in blocks of queries.

Vectors that are equal are one entry with its smallest ids, so a vector that a
third of all rows hold makes no hot page.

Defined results: what takes part is said in ``_vectors.whole``; zero vectors
do. Ties go to the smaller id; a row is no candidate of its own query; without
queries or candidates there are no rows; other columns are ignored. A sum of
products beyond 62 bits is an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _store, _vectors
from ._bytes import task
from ._vectors import Table

OUT = "query_id long, rank int, vec_id long, score long, distances long"


@dataclass(frozen=True)
class Settings:
    #: Entries of a node.
    page: int = 128
    #: Vectors of a part, and routing objects that parts gather at, at most.
    part: int = 8_192
    roots: int = 1_024
    #: Components of all routing objects together.
    components: int = 4 << 20
    #: Queries that meet a part at once.
    block: int = 4_096


@dataclass
class Node:
    leaf: bool
    vectors: np.ndarray
    names: np.ndarray  # classes of a leaf, children of an inner node
    parent: np.ndarray  # distances to the node's routing object
    radius: np.ndarray


def loaded(x: np.ndarray, names: np.ndarray, own: np.ndarray, table: Table, page: int, seed: int = 5) -> list[Node]:
    """The nodes of a tree over vectors, the root first; ``own`` is the root's routing object, lifted."""
    lifted = table.lifted(x)
    rng = np.random.default_rng(seed)
    nodes: list[Node] = []
    waiting = [(np.arange(len(x)), own, -1, 0)]
    while waiting:
        rows, routing, above, slot = waiting.pop()
        number = len(nodes)
        if above >= 0:
            nodes[above].names[slot] = number
        if len(rows) <= page:
            nodes.append(Node(True, x[rows], names[rows], _to(lifted[rows], routing), np.zeros(len(rows))))
            continue
        chosen = np.sort(rng.choice(rows, min(page, -(-2 * len(rows) // page)), replace=False))
        near = np.argmin(_vectors.distances(lifted[rows], lifted[chosen]), 1)
        near[np.searchsorted(rows, chosen)] = np.arange(len(chosen))
        order = np.argsort(near, kind="stable")
        groups = np.split(rows[order], np.cumsum(np.bincount(near, minlength=len(chosen)))[:-1])
        radius = np.array([_to(lifted[g], lifted[c]).max() for g, c in zip(groups, chosen)])
        nodes.append(Node(False, x[chosen], np.zeros(len(chosen), np.int64), _to(lifted[chosen], routing), radius))
        waiting += [(g, lifted[c], number, i) for i, (g, c) in enumerate(zip(groups, chosen))]
    return nodes


def _to(x: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - one) ** 2).sum(1))


def searched(nodes: list[Node], own: np.ndarray, q: np.ndarray, k: int, floor: float, table: Table) -> tuple[np.ndarray, np.ndarray, int]:
    """Classes and scores of the k best with a score of ``floor`` or more, and how many distances it took."""
    names, scores = np.zeros(0, np.int64), np.zeros(0, q.dtype)
    slack = table.slack(q)
    base = float(q.astype(np.float64) @ q.astype(np.float64)) + table.square

    def reach(score: float) -> float:
        """The distance beyond which no score is as good."""
        return np.inf if score == -np.inf else np.sqrt(max(base - 2 * (score - slack), 0))

    limit = reach(floor)
    first = float(_to(table.asked(q[None]), own)[0])
    queue = [(0.0, 0, first)]
    computed = 1
    while queue:
        least, number, to_routing = heapq.heappop(queue)
        if least > limit:
            break
        node = nodes[number]
        room = 1e-7 * (to_routing + limit if limit < np.inf else to_routing)
        some = np.flatnonzero(np.abs(to_routing - node.parent) - node.radius <= limit + room)
        computed += len(some)
        own_scores = (node.vectors if len(some) == len(node.parent) else node.vectors[some]) @ q
        if node.leaf:
            good = own_scores >= floor
            if good.any():
                names, scores = np.concatenate([names, node.names[some[good]]]), np.concatenate([scores, own_scores[good]])
                top = _vectors.best(scores, names, k)
                names, scores = names[top], scores[top]
                if len(names) == k and scores[-1] > floor:
                    floor = float(scores[-1])
                    limit = reach(floor)
        else:
            away = np.sqrt(np.maximum(base - 2 * own_scores.astype(np.float64), 0))
            lower = np.maximum(away - node.radius[some] - room, 0)
            for i in np.flatnonzero(lower <= limit).tolist():
                heapq.heappush(queue, (float(lower[i]), int(node.names[some[i]]), float(away[i])))
    return names, scores, computed


def _paged(nodes: list[Node], root: int, part: int, kind) -> pa.Table:
    columns = {
        "root": pa.array([root] * len(nodes), pa.int32()),
        "part": pa.array([part] * len(nodes), pa.int32()),
        "node": pa.array(range(len(nodes)), pa.int32()),
        "leaf": pa.array([n.leaf for n in nodes]),
        "names": pa.array([n.names.astype("<i8").tobytes() for n in nodes], pa.binary()),
        "parent": pa.array([n.parent.astype("<f8").tobytes() for n in nodes], pa.binary()),
        "radius": pa.array([n.radius.astype("<f8").tobytes() for n in nodes], pa.binary()),
        "vectors": pa.array([n.vectors.astype(kind).tobytes() for n in nodes], pa.binary()),
    }
    return pa.table(list(columns.values()), list(columns))


PAGES = "root int, part int, node int, leaf boolean, names binary, parent binary, radius binary, vectors binary"


def _unpaged(pages: pa.Table, kind, table: Table) -> list[Node]:
    rows = sorted(pages.to_pylist(), key=lambda r: r["node"])
    as_ = np.float64 if table.doubles else np.int64
    return [
        Node(r["leaf"], np.frombuffer(r["vectors"], kind).reshape(-1, table.width).astype(as_), np.frombuffer(r["names"], "<i8"), np.frombuffer(r["parent"], "<f8"), np.frombuffer(r["radius"], "<f8"))
        for r in rows
    ]


def nearest(rows: DataFrame, k: int = 10, every: int = 100, scale: float = 1024, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, distances): the k best other rows of each row whose id is divisible by ``every``.

    The score is the inner product of floor(scale * x); ``distances`` counts
    what was computed for the query.
    """
    spark = rows.sparkSession
    table = _vectors.whole(rows, scale, id_col, vector_col)
    if table is None:
        return spark.createDataFrame([], OUT)
    kind = "<i4" if table.classes.schema["v"].dataType.elementType.simpleString() == "int" else "<i8"
    many = max(1, min(settings.roots, settings.components // table.width, -(-table.count // settings.part)))
    roots = spark.sparkContext.broadcast(table.lifted(_vectors.sample(table, many)))
    # the directory stays bounded: parts grow once there are as many as it may hold
    size = max(settings.part, -(-table.count // (8 * settings.roots)))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, v in _vectors.rows_of(batches, "class", "v"):
            x = table_.matrix(v)
            near = np.argmin(_vectors.distances(table_.lifted(x), roots.value), 1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), names, v], ["root", "class", "v"])

    # closures carry numbers, not DataFrames
    table_ = Table(None, None, table.width, table.count, table.square, table.doubles)
    element = "int" if kind == "<i4" else "long"
    gathered = _store.kept(table.classes.select("class", "v").mapInArrow(task(routed), f"root int, class long, v array<{element}>"))
    parts = {r.root: -(-r["count"] // size) for r in gathered.groupBy("root").count().collect()}
    of_root = F.element_at(F.create_map(*[F.lit(int(x)) for pair in parts.items() for x in pair]), F.col("root"))
    placed = gathered.withColumn("part", F.pmod(F.xxhash64("class"), of_root).cast("int"))

    def load(key, group):
        root, part = (int(x.as_py()) for x in key)
        order = np.argsort(group.column("class").to_numpy())
        x, names = table_.matrix(group.column("v"))[order], group.column("class").to_numpy()[order]
        return _paged(loaded(x, names, roots.value[root], table_, page), root, part, kind)

    page = settings.page
    pages = _store.written(placed.groupBy("root", "part").applyInArrow(load, PAGES), "metric-tree")
    # radius of a whole part: no entry of its root lies further from its routing object
    header = pages.where("node = 0").select("root", "part", "parent", "radius").toArrow()
    reach = [float((np.frombuffer(a.as_py(), "<f8") + np.frombuffer(b.as_py(), "<f8")).max()) for a, b in zip(header.column("parent"), header.column("radius"))]
    order = np.lexsort((header.column("part").to_numpy(), header.column("root").to_numpy()))
    directory = spark.sparkContext.broadcast((header.column("root").to_numpy()[order], header.column("part").to_numpy()[order], np.array(reach)[order]))

    asking = table.rows.where(F.pmod("id", F.lit(every)) == 0).join(table.classes, ["h", "g"]).select("id", "class", "v")
    each = _store.kept(asking.select("id", "class"))
    queries = _store.kept(asking.groupBy("class").agg(F.first("v").alias("query")))
    blocks = max(1, -(-queries.count() // settings.block))
    most = k + 1

    def requests(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            root, part, radius = directory.value
            for names, v, floors in _vectors.rows_of(batches, "class", "query", "floor"):
                q = table_.matrix(v)
                away = _vectors.distances(table_.asked(q), roots.value)[:, root]
                least = np.maximum(away - radius, 0)
                nearest_ = np.argmin(least + 1e-9 * away, 1)
                least *= 1 - 1e-7
                possible = ((q.astype(np.float64) ** 2).sum(1)[:, None] + table_.square - least**2) / 2
                asked = np.zeros(possible.shape, bool)
                asked[np.arange(len(q)), nearest_] = True
                if not first:
                    floor = np.array([-np.inf if f is None else f for f in floors.to_pylist()])
                    room = np.array([table_.slack(x) for x in q])
                    asked = ~asked & (possible + room[:, None] >= floor[:, None])
                at, where = np.nonzero(asked)
                taken = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(root[where], pa.int32()), pa.array(part[where], pa.int32()), names.take(taken), v.take(taken), floors.take(taken)], ["root", "part", "class", "query", "floor"])

        return run

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            nodes = _unpaged(left, kind, table_)
            own = roots.value[left.column("of_root")[0].as_py()]
            q = table_.matrix(right.column("query"))
            for name, floor, x in zip(right.column("class").to_pylist(), right.column("floor").to_pylist(), q):
                out.append((name, *searched(nodes, own, x, most, -np.inf if floor is None else floor, table_)))
        rows_ = [(name, names, scores.astype(np.int64), n) for name, names, scores, n in out]
        return _vectors.lists(rows_, {"query": pa.int64(), "class": pa.list_(pa.int64()), "score": pa.list_(pa.int64()), "distances": pa.int64()})

    def search(asked: DataFrame) -> DataFrame:
        asked = _store.kept(asked.withColumn("block", F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int")))
        used = asked.select("root", "part", F.col("block").alias("to_block")).distinct()
        copies = pages.join(used, ["root", "part"]).withColumnsRenamed({"root": "of_root", "part": "of_part"})
        met_at = copies.groupBy("of_root", "of_part", "to_block").cogroup(asked.groupBy("root", "part", "block"))
        return met_at.applyInArrow(met, "query long, class array<long>, score array<long>, distances long")

    schema = f"root int, part int, class long, query array<{element}>, floor long"
    one = search(queries.withColumn("floor", F.lit(None).cast("long")).mapInArrow(task(requests(True)), schema))
    one = _store.written(one, "metric-first")
    # the k-th of a query's nearest part is the least that others must reach
    floors = one.where(F.size("score") == most).select(F.col("query").alias("class"), F.element_at("score", -1).alias("floor"))
    two = search(queries.join(floors, "class", "left").mapInArrow(task(requests(False)), schema))
    both = one.unionByName(two)
    total = both.groupBy("query").agg(F.sum("distances").alias("distances"))
    top = _vectors.merged(both, ["query"], most).select("query", F.explode("x").alias("x")).select("query", F.col("x.class").alias("class"), (-F.col("x.below")).alias("score"))
    found = top.join(_vectors.members(table, most), "class").select("query", "score", F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= most).join(total, "query")
    pairs = each.select(F.col("id").alias("query_id"), F.col("class").alias("query")).join(found, "query").where("query_id <> vec_id")
    last = Window.partitionBy("query_id").orderBy("r")
    return pairs.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "distances")
