"""Hard negatives by one-dimensional distance keys.

Vectors are lifted to one length, so that the largest inner product is the
smallest Euclidean distance, and each goes to its nearest pivot, from a bounded
sample. The table is stored sorted by (pivot, distance to it), cut into pages
of a bounded number of rows; a page's pivot and first and last key are the
directory. By the triangle inequality a page's keys bound the distance of its
rows to an anchor from both sides, hence their scores.

An anchor first asks the pages whose key interval, widened about its own
distance to each pivot, comes first, until they hold a share of all rows. The
best found there gives the distance that the interval must still be widened to;
the pages of that ring are asked next, and what is beyond them is certified by
its bound. Positives are searched so, then negatives: rows of another label
whose score lies in a range below the positive's, which is an annulus about the
anchor, widened from its inner edge.

Pages and anchors meet by a shuffle, in blocks of anchors. A page holds rows of
one pivot, as many pages as it takes; rows with one vector and label are one
row with its smallest ids, so a common vector makes no hot page.

Defined results: what takes part is said in ``_vectors.whole``; a null label
takes none. Ties go to the smaller id. A positive of negative score has no
negatives, and one of score zero only those of score zero. Other columns are
ignored; without anchors or positives there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _store, _vectors
from ._bytes import task
from ._vectors import Table

OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
PAGES = "page long, pivot int, low double, high double, rows int, class binary, label binary, vectors binary"


@dataclass(frozen=True)
class Settings:
    pivots: int = 32
    sample: int = 4_096
    #: Components of the sample together.
    components: int = 4 << 20
    #: Rows of a page, and pages of the directory, beyond which pages grow.
    page: int = 1_024
    pages: int = 8_192
    #: Share of all rows that an anchor asks for first, and rows at least.
    share: float = 1 / 16
    least: int = 2_048
    #: Anchors that meet a page at once.
    block: int = 4_096


def pivots(x: np.ndarray, many: int) -> np.ndarray:
    """Vectors of the sample, each the furthest from those before it; the first is the one furthest from the mean."""
    chosen = [int(np.argmax(((x - x.mean(0)) ** 2).sum(1)))]
    away = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < many and away.max() > 0:
        chosen.append(int(np.argmax(away)))
        away = np.minimum(away, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


@dataclass(frozen=True)
class Directory:
    page: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    def scores(self, q: np.ndarray, centres: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest score that each page's rows can have, for each anchor."""
        away = _vectors.distances(table.asked(q), centres)[:, self.pivot]
        near = np.maximum(np.maximum(self.low - away, away - self.high), 0)
        far = away + self.high
        base = (q.astype(np.float64) ** 2).sum(1)[:, None] + table.square
        slack = np.array([table.slack(x) for x in q])[:, None]
        return (base - far**2) / 2 - slack, (base - near**2) / 2 + slack

    def first(self, order: np.ndarray, share: float) -> np.ndarray:
        """Which pages come first in an order of them (one row an anchor) until they hold so many rows."""
        before = np.cumsum(self.rows[order], 1) - self.rows[order]
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, before < share, 1)
        return out


def _page(number: int, pivot: int, key: np.ndarray, names: np.ndarray, labels: np.ndarray, x: np.ndarray, kind: str) -> tuple:
    by = np.argsort(names)
    return number, pivot, float(key[0]), float(key[-1]), len(key), names[by].astype("<i8").tobytes(), labels[by].astype("<i8").tobytes(), x[by].astype(kind).tobytes()


def hard_negatives(
    rows: DataFrame,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256,
    settings: Settings = Settings(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``; their positives
    the best other rows of their label, by the inner product of floor(scale *
    x); the negatives of both the best rows of other labels with
    low * positive score <= 100 * score <= high * positive score.
    """
    spark = rows.sparkSession
    table = _vectors.whole(rows, scale, id_col, vector_col, label_col)
    if table is None:
        return spark.createDataFrame([], OUT)
    element = table.classes.schema["v"].dataType.elementType.simpleString()
    kind = "<i4" if element == "int" else "<i8"
    # closures carry numbers, not DataFrames
    plain = Table(None, None, table.width, table.count, table.square, table.doubles)
    taken = _vectors.sample(table, max(1, min(settings.sample, settings.components // table.width)))
    centres = spark.sparkContext.broadcast(pivots(table.lifted(taken), settings.pivots))
    size = max(settings.page, -(-table.count // settings.pages))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, labels, v in _vectors.rows_of(batches, "class", "label", "v"):
            away = _vectors.distances(plain.lifted(plain.matrix(v)), centres.value)
            near = np.argmin(away, 1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(away[np.arange(len(near)), near]), names, labels, v], ["pivot", "key", "class", "label", "v"])

    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for pivot, key, names, labels, v in _vectors.rows_of(batches, "pivot", "key", "class", "label", "v"):
            pivot, key, names, labels, x = pivot.to_numpy(), key.to_numpy(), names.to_numpy(), labels.to_numpy(), plain.matrix(v)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(pivot)) + 1, [len(pivot)]])
            out = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                for s in range(a, b, size):
                    e = min(b, s + size)
                    out.append(_page(number, int(pivot[s]), key[s:e], names[s:e], labels[s:e], x[s:e], kind))
                    number += 1
            columns = list(zip(*out))
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["page", "pivot", "low", "high", "rows", "class", "label", "vectors"])

    stored = table.classes.select("class", "label", "v").mapInArrow(task(keyed), f"pivot int, key double, class long, label long, v array<{element}>")
    stored = _store.kept(stored).repartitionByRange(_store.partitions(spark), "pivot", "key").sortWithinPartitions("pivot", "key", "class")
    pages = _store.written(stored.mapInArrow(task(paged), PAGES), "distance-keys", small=False)
    known = pages.select("page", "pivot", "low", "high", "rows").orderBy("pivot", "low", "page").toArrow()
    directory = spark.sparkContext.broadcast(Directory(*(known.column(c).to_numpy() for c in ("page", "pivot", "low", "high", "rows"))))
    wanted = max(settings.least, settings.share * table.count)

    asking = table.rows.where(F.pmod("id", F.lit(every)) == 0).join(table.classes, ["h", "g"]).select("id", "class", "label", "v")
    each = _store.kept(asking.select("id", "class"))
    queries = _store.kept(asking.groupBy("class").agg(F.first("v").alias("query"), F.first("label").alias("own")))
    blocks = max(1, -(-queries.count() // settings.block))

    def asked(pick):
        """Rows for the pages that ``pick`` says, given the scores that are possible in each page."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                step = max(1, (1 << 22) // len(directory.value.page))
                for part in (batch.slice(a, step) for a in range(0, batch.num_rows, step)):
                    lowest, greatest = directory.value.scores(plain.matrix(part.column("query")), centres.value, plain)
                    at, where = np.nonzero(pick(part, lowest, greatest))
                    yield pa.RecordBatch.from_arrays([pa.array(directory.value.page[where]), *part.take(pa.array(at)).columns], ["page", *part.schema.names])

        return task(run)

    def scanned(wishes: DataFrame, pick, met, out: str) -> DataFrame:
        requests = wishes.mapInArrow(asked(pick), "page long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wishes.schema))
        requests = _store.kept(requests.withColumn("block", F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int")))
        used = requests.select("page", F.col("block").alias("to_block")).distinct()
        copies = pages.join(used, "page").select(F.col("page").alias("of_page"), "to_block", "vectors", F.col("class").alias("names"), F.col("label").alias("labels"))
        return copies.groupBy("of_page", "to_block").cogroup(requests.groupBy("page", "block")).applyInArrow(met, out)

    def unpaged(left: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r = left.select(["names", "labels", "vectors"]).to_pylist()[0]
        x = np.frombuffer(r["vectors"], kind).reshape(-1, plain.width).astype(np.float64 if plain.doubles else np.int64)
        return np.frombuffer(r["names"], "<i8"), np.frombuffer(r["labels"], "<i8"), x

    # positives: the best classes of the anchor's own label, its own one among them
    most = positives + 1

    def best_of_label(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            names, labels, x = unpaged(left)
            scores = (plain.matrix(right.column("query")) @ x.T).astype(np.int64)
            for name, own, floor, s in zip(right.column("class").to_pylist(), right.column("own").to_pylist(), right.column("floor").to_pylist(), scores):
                some = np.flatnonzero((labels == own) & (s >= floor) if floor is not None else labels == own)
                if len(some):
                    some = some[_vectors.best(s[some], names[some], most)]
                    out.append((name, names[some], s[some]))
        return _vectors.lists(out, {"anchor": pa.int64(), "class": pa.list_(pa.int64()), "score": pa.list_(pa.int64())})

    def nearest_pages(greatest: np.ndarray) -> np.ndarray:
        return directory.value.first(np.argsort(-greatest, 1, kind="stable"), wanted)

    def first_ring(part, lowest, greatest):
        return nearest_pages(greatest)

    def last_ring(part, lowest, greatest):
        floor = np.array([-np.inf if f is None else f for f in part.column("floor").to_pylist()])
        return ~nearest_pages(greatest) & (greatest >= floor[:, None])

    out = "anchor long, class array<long>, score array<long>"
    wishes = queries.withColumn("floor", F.lit(None).cast("long"))
    one = _store.written(scanned(wishes, first_ring, best_of_label, out), "hard-positives")
    floors = _vectors.merged(one, ["anchor"], most).where(F.size("x") == most).select(F.col("anchor").alias("class"), (-F.element_at("x", -1)["below"]).alias("floor"))
    two = scanned(queries.join(floors, "class", "left"), last_ring, best_of_label, out)
    top = _vectors.merged(one.unionByName(two), ["anchor"], most)
    lists = _store.written(_vectors.members(table, max(most, negatives)), "hard-members")

    def with_ids(found: DataFrame, keys: list[str], k: int) -> DataFrame:
        """The k best rows of the classes found: keys, id, score, r."""
        flat = found.select(*keys, F.explode("x").alias("x")).select(*keys, F.col("x.class").alias("class"), (-F.col("x.below")).alias("score"))
        flat = flat.join(lists, "class").select(*keys, "score", F.explode("ids").alias("id"))
        return flat.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).where(F.col("r") <= k)

    pairs = each.select(F.col("id").alias("anchor_id"), F.col("class").alias("anchor")).join(with_ids(top, ["anchor"], most), "anchor").where("anchor_id <> id")
    pairs = pairs.withColumn("n", F.row_number().over(Window.partitionBy("anchor_id").orderBy("r"))).where(F.col("n") <= positives)
    pairs = _store.written(pairs.select("anchor", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "hard-pairs")

    # negatives: ranges of scores, one for each score that a positive has
    def below(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            names, labels, x = unpaged(left)
            scores = (plain.matrix(right.column("query")) @ x.T).astype(np.int64)
            for r, s in zip(right.select(["class", "own", "score", "bottom"]).to_pylist(), scores):
                other = labels != r["own"]
                for p, bottom in zip(r["score"], r["bottom"]):
                    some = np.flatnonzero(other & (s >= bottom) & (s <= p * high // 100))
                    if len(some):
                        some = some[_vectors.best(s[some], names[some], negatives)]
                        out.append((r["class"], p, names[some], s[some]))
        return _vectors.lists(out, {"anchor": pa.int64(), "positive_score": pa.int64(), "class": pa.list_(pa.int64()), "score": pa.list_(pa.int64())})

    def ranges(part) -> tuple[np.ndarray, np.ndarray]:
        return (np.array([f(x) for x in part.column(c).to_pylist()], np.float64)[:, None] for c, f in (("bottom", min), ("score", lambda x: max(x) * high // 100)))

    def edge_pages(greatest: np.ndarray, lowest: np.ndarray, bottom: np.ndarray, top: np.ndarray) -> np.ndarray:
        """Pages that can meet the range, nearest to its inner edge first."""
        meets = (greatest >= bottom) & (lowest <= top)
        order = np.argsort(np.where(meets, np.maximum(top - greatest, 0) - 1e-9 * (greatest - top), np.inf), 1, kind="stable")
        return directory.value.first(order, wanted) & meets

    def first_annulus(part, lowest, greatest):
        return edge_pages(greatest, lowest, *ranges(part))

    def rest_of_annulus(part, lowest, greatest):
        found, top = ranges(part)
        least = np.array([min(x) for x in part.column("least").to_pylist()], np.float64)[:, None]
        return ~edge_pages(greatest, lowest, least, top) & (greatest >= found) & (lowest <= top)

    out = "anchor long, positive_score long, class array<long>, score array<long>"
    # the least whole score s with 100 * s >= low * p
    bottoms = F.transform("score", lambda p: (-F.floor(-(p * low) / F.lit(100))).cast("long"))
    scores = pairs.where("positive_score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_set("positive_score")).alias("score"))
    scores = scores.withColumn("bottom", bottoms)
    wishes = _store.kept(queries.join(scores.withColumnRenamed("anchor", "class"), "class"))
    three = _store.written(scanned(wishes, first_annulus, below, out), "hard-negatives")
    # a range that has as many as wanted need not be searched below the last of them
    full = _vectors.merged(three, ["anchor", "positive_score"], negatives).where(F.size("x") == negatives)
    full = full.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("positive_score", (-F.element_at("x", -1)["below"]).alias("last")))).alias("last"))
    again = wishes.join(full.withColumnRenamed("anchor", "class"), "class", "left").withColumn("least", F.col("bottom"))
    risen = F.zip_with("score", "bottom", lambda p, b: F.coalesce(F.try_element_at(F.col("last"), p), b))
    four = scanned(again.withColumn("bottom", risen).drop("last"), rest_of_annulus, below, out)
    found = with_ids(_vectors.merged(three.unionByName(four), ["anchor", "positive_score"], negatives), ["anchor", "positive_score"], negatives)
    return pairs.join(found, ["anchor", "positive_score"]).select("anchor_id", "positive_id", F.col("r").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
