"""Vectors of whole numbers for exact searches by inner product, and their metric.

The largest inner product becomes the smallest distance where every vector is
lengthened by one component that makes all equally long, and a query by zero.
Distances serve as bounds only, with room for rounding; scores are exact whole
numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _store

#: Parts in which the ids of one vector are ranked first, as a third of all rows may hold it.
SALTS = 64
#: Part of a squared distance by which rounding may move it.
ROUNDING = 1e-9


@dataclass(frozen=True)
class Table:
    """Valid rows (id, h, g), vectors that differ (class, v, label), and what is known of all of them.

    A class is the smallest id of the rows with one vector and label.
    """

    rows: DataFrame
    classes: DataFrame
    width: int
    count: int
    #: The greatest squared length.
    square: float
    #: Whether sums of products stay exact in doubles.
    doubles: bool

    def matrix(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(-1, self.width).astype(np.float64 if self.doubles else np.int64)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.concatenate([x, np.sqrt(np.maximum(self.square - (x * x).sum(1), 0))[:, None]], 1)

    def asked(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate([q.astype(np.float64), np.zeros((len(q), 1))], 1)

    def slack(self, q: np.ndarray) -> float:
        """By how much a score that a distance bounds may be off, for a query."""
        q = q.astype(np.float64)
        return ROUNDING * (float(q @ q) + self.square) + 1e-6


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of ``a`` to each row of ``b``."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0))


def whole(rows: DataFrame, scale: float, id_col: str, vector_col: str, label_col: str | None = None) -> Table | None:
    """The rows that take part, with floor(scale * x) for every component; None if there are none.

    Out go rows without id or label, with a null or empty vector, or one with a
    null or non-finite component, and vectors whose length is not the most
    frequent one. Of rows that repeat an id, the one with the least vector, then
    label counts.
    """
    label = F.col(f"`{label_col}`").cast("long") if label_col else F.lit(0).cast("long")
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), label.alias("label"))
    v = F.col("v")
    rows = rows.where("id is not null and label is not null").where(F.size(v) > 0).where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    rows = rows.withColumn("v", F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x)))
    highest = F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))
    known = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(highest).alias("most")).orderBy(F.desc("n"), "d").first()
    if known is None:
        return None
    most = known.d * int(known.most) ** 2
    if most >= 1 << 62:
        raise ValueError("scores go beyond 64 bits")
    kind = "int" if known.most < 1 << 31 else "long"
    rows = rows.where(F.size("v") == known.d).withColumn("v", F.col("v").cast(f"array<{kind}>"))
    one = rows.groupBy("id").agg(F.min(F.struct("v", "label")).alias("x")).select("id", "x.*")
    one = _store.kept(one.withColumn("h", F.xxhash64("v", "label")).withColumn("g", F.xxhash64(F.lit(1), "label", "v")))
    classes = one.groupBy("h", "g").agg(F.min("id").alias("class"), F.first("v").alias("v"), F.first("label").alias("label"))
    classes = _store.kept(classes)
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, square = classes.agg(F.count("*"), F.max(length)).first()
    return Table(one.select("id", "h", "g"), classes.select("class", "v", "label", "h", "g"), known.d, n, square, most < 1 << 52)


def members(table: Table, most: int) -> DataFrame:
    """(class, ids): the ``most`` smallest ids of each class."""
    first = Window.partitionBy("h", "g", F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy("id")
    again = Window.partitionBy("h", "g").orderBy("id")
    few = table.rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= most).withColumn("r", F.row_number().over(again)).where(F.col("r") <= most)
    ids = F.sort_array(F.collect_list("id"))
    return few.groupBy("h", "g").agg(ids.alias("ids")).select(F.col("ids")[0].alias("class"), "ids")


def sample(table: Table, most: int) -> np.ndarray:
    """Up to ``most`` vectors, those of smallest hash, so the same ones at every run."""
    taken = table.classes.orderBy("h", "g").limit(most).select("v").toArrow().column("v")
    return table.matrix(taken)


def best(scores: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties to the smaller name, in order."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return some[np.lexsort((names[some], -scores[some]))[:k]]
    return np.lexsort((names, -scores))[:k]


def lists(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.Table:
    """Rows of numbers and arrays as a table."""
    return pa.table([pa.array([r[j].tolist() if isinstance(r[j], np.ndarray) else r[j] for r in rows], kind) for j, kind in enumerate(kinds.values())], list(kinds))


def merged(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Of the (class, score) lists found for each key, the k best with ties to the smaller class."""
    ordered = F.array_sort(F.transform(F.flatten(F.collect_list(F.arrays_zip("class", "score"))), lambda x: F.struct((-x["score"]).alias("below"), x["class"].alias("class"))))
    return found.groupBy(*keys).agg(F.slice(ordered, 1, k).alias("x"))


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list]:
    for batch in batches:
        if batch.num_rows:
            yield [batch.column(c) for c in columns]
