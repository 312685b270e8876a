"""An append-only table of rows under unique keys, with versions.

Rows lie in hash buckets of their key. A batch writes its rows beside those of
earlier ones and then commits a manifest, which names all batches of a version
and comes into being by one rename. What no manifest names is not there, so a
batch that fails before its commit leaves nothing, and a batch that is tried
again under its id adds nothing. An append reads only the buckets that its own
keys fall into, a lookup only one, whose files are sorted by key and carry a
Bloom filter of it.

A manifest holds, for each batch, the number of its rows and a checksum over
keys and digests in any order, and the digest of the manifest before it. A
version can so be checked as a whole, copied, restored and carried forward to a
later format.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import digest

DIGEST = "record_digest"
#: How often a commit is tried again when another writer was first.
TRIES = 20


class Conflict(ValueError):
    """Other content under a key that is there."""


class Damaged(ValueError):
    """Rows that are not those of their manifest."""


class Unsupported(ValueError):
    """A format that has no way to this one."""


class Files:
    """The few file operations that a commit needs, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def system(self, name: str):
        return self.path(name).getFileSystem(self.conf)

    def exists(self, name: str) -> bool:
        return self.system(name).exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self.system(folder).listStatus(self.path(folder)))

    def delete(self, name: str) -> None:
        self.system(name).delete(self.path(name), True)

    def read(self, name: str) -> str:
        stream = self.system(name).open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Make a whole file appear at once; False if it is there already."""
        part = f"{name.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
        stream = self.system(part).create(self.path(part), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        files = self.jvm.org.apache.hadoop.fs
        context = files.FileContext.getFileContext(self.system(name).getUri(), self.conf)
        # without an option a rename never goes over another file
        plain = SparkContext._gateway.new_array(getattr(files, "Options$Rename"), 0)
        try:
            context.rename(self.path(part), self.path(name), plain)
        except Py4JJavaError as e:
            self.delete(part)
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or "already exists" in str(e.java_exception.getMessage()):
                return False
            raise
        return True


@dataclass(frozen=True)
class Batch:
    id: str
    path: str
    rows: int
    check: int
    #: Ids of batches that a compaction has merged into this one.
    merged: tuple[str, ...] = ()


@dataclass(frozen=True)
class Manifest:
    version: int
    parent: str | None
    format: int
    key: str
    buckets: int
    schema: str
    batches: tuple[Batch, ...]

    def text(self) -> str:
        own = self.__dict__ | {"batches": [b.__dict__ | {"merged": list(b.merged)} for b in self.batches]}
        return json.dumps(own, sort_keys=True, indent=1)

    @staticmethod
    def of(text: str) -> Manifest:
        own = json.loads(text)
        return Manifest(**own | {"batches": tuple(Batch(**b | {"merged": tuple(b["merged"])}) for b in own["batches"])})

    @property
    def known(self) -> set[str]:
        return {i for b in self.batches for i in (b.id, *b.merged)}


def digest_of_columns(columns: list[str]) -> Column:
    """The digest of some columns, whatever their order."""
    own = [F.col(f"`{c}`") for c in sorted(columns)]
    return digest(F.to_json(F.struct(*own), {"ignoreNullFields": "false"}))


def sealed(rows: DataFrame) -> DataFrame:
    """Rows with the digest of all their columns, whatever their order."""
    return rows.withColumn(DIGEST, digest_of_columns(rows.columns))


class Ledger:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark)

    # --- versions ---------------------------------------------------------

    @classmethod
    def made(cls, spark: SparkSession, folder: str, key: str, schema: T.StructType | str, buckets: int = 64, format: int = 1) -> Ledger:
        """The ledger in a folder, made empty if there is none."""
        own = cls(spark, folder)
        if not own.versions():
            kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
            own._put(Manifest(0, None, format, key, buckets, kind.json(), ()))
        return own

    def _name(self, version: int) -> str:
        return f"{self.folder}/manifests/{version:012d}.json"

    def versions(self) -> list[int]:
        return [int(n[:12]) for n in self.files.names(f"{self.folder}/manifests") if n.endswith(".json") and not n.startswith(".")]

    def manifest(self, version: int | None = None) -> Manifest:
        there = self.versions()
        if not there or (version is not None and version not in there):
            raise FileNotFoundError(f"{self.folder}: no version {'at all' if version is None else version}")
        return Manifest.of(self.files.read(self._name(there[-1] if version is None else version)))

    def _put(self, manifest: Manifest) -> bool:
        return self.files.create(self._name(manifest.version), manifest.text())

    def _next(self, head: Manifest, **changes) -> Manifest:
        parent = hashlib.sha256(head.text().encode()).hexdigest()
        return Manifest(**head.__dict__ | {"version": head.version + 1, "parent": parent} | changes)

    # --- reading ----------------------------------------------------------

    def _read(self, m: Manifest, batches: tuple[Batch, ...]) -> DataFrame:
        """Rows with their digest, batch and bucket."""
        kind = T.StructType.fromJson(json.loads(m.schema)).add(DIGEST, "string").add("batch", "string").add("bucket", T.IntegerType())
        paths = [f"{self.folder}/data/batch={b.path}" for b in batches]
        if not paths:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).option("basePath", f"{self.folder}/data").parquet(*paths)

    def rows(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with their digest."""
        m = self.manifest(version)
        return self._read(m, m.batches).drop("batch", "bucket")

    def history(self, version: int | None = None) -> DataFrame:
        """(key, batch) of a version: which batch added each row."""
        m = self.manifest(version)
        names = self.spark.createDataFrame([(b.path, b.id) for b in m.batches], "batch string, id string")
        return self._read(m, m.batches).select(m.key, "batch").join(F.broadcast(names), "batch").select(m.key, F.col("id").alias("batch"))

    def bucket(self, key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")

    def lookup(self, key: str, version: int | None = None) -> DataFrame:
        """The row under a key, if there is one, from the files of its bucket."""
        m = self.manifest(version)
        there = self._read(m, m.batches)
        return there.where((F.col("bucket") == self.bucket(F.lit(key), m.buckets)) & (F.col(m.key) == key)).drop("batch", "bucket")

    def found(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The rows under the keys of a one-column table, from the files of their buckets."""
        m = self.manifest(version)
        wanted = keys.select(F.col(keys.columns[0]).alias(m.key)).distinct()
        return self._within(m, wanted).join(wanted, m.key, "left_semi").drop("batch", "bucket")

    def _within(self, m: Manifest, rows: DataFrame) -> DataFrame:
        """What is held in the buckets of some rows; there are no more buckets than the manifest says."""
        if not m.batches:
            return self._read(m, ())
        touched = sorted(r.b for r in rows.select(self.bucket(F.col(m.key), m.buckets).alias("b")).distinct().collect() if r.b is not None)
        held = self._read(m, m.batches)
        return held.where(F.col("bucket").isin(touched)) if len(touched) < m.buckets else held

    # --- writing ----------------------------------------------------------

    def _files(self, rows: DataFrame, key: str, by: list[str], folder: str) -> None:
        """Files sorted by key in folders of ``by``, as many of each as there are tasks that hold rows of it."""
        sorted_ = rows.sortWithinPartitions(*by, key)
        sorted_.write.partitionBy(*by).option("compression", "zstd").option(f"parquet.bloom.filter.enabled#{key}", "true").mode("overwrite").parquet(folder)

    def _write(self, rows: DataFrame, m: Manifest, path: str, moved: bool = True) -> None:
        """Write one batch. ``moved=False`` leaves rows in their tasks, where those were read from few buckets each."""
        placed = rows.withColumn("bucket", self.bucket(F.col(m.key), m.buckets))
        if moved:
            placed = placed.repartition(min(m.buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "bucket")
        self._files(placed, m.key, ["bucket"], f"{self.folder}/data/batch={path}")

    def _summed(self, m: Manifest, batches: tuple[Batch, ...], digests: bool = True) -> dict[str, tuple[int, int, int]]:
        """(rows, checksum, rows without their digest) of each batch, as it is on disk; the last only for ``digests``."""
        own = T.StructType.fromJson(json.loads(m.schema)).names
        other = ~F.col(DIGEST).eqNullSafe(digest_of_columns(own)) if digests else F.lit(False)
        known = self._read(m, batches).groupBy("batch").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(m.key, DIGEST)).alias("x"), F.count_if(other).alias("bad"))
        return {r.batch: (r.n, r.x, r.bad) for r in known.collect()}

    def append(self, rows: DataFrame, batch: str | None = None) -> int:
        """Add rows whose key is new and say how many.

        Rows that are there already add nothing; another content under a key, there
        or in the batch itself, is a Conflict, and then nothing is added. A batch id
        that a version knows adds nothing.
        """
        batch = batch or uuid.uuid4().hex
        m = self.manifest()
        if batch in m.known:
            return 0
        # kept on the executors' disks, so what makes the rows runs once
        new = sealed(rows.select(*T.StructType.fromJson(json.loads(m.schema)).names)).persist(StorageLevel.DISK_ONLY)
        try:
            for _ in range(TRIES):
                n = self._tried(m, new, batch)
                if n is not None:
                    return n
                # another writer was first: what it added must be seen
                m = self.manifest()
                if batch in m.known:
                    return 0
        finally:
            new.unpersist()
        raise RuntimeError(f"{self.folder}: no commit in {TRIES} tries")

    def _tried(self, m: Manifest, new: DataFrame, batch: str) -> int | None:
        """One try to append; None if another writer was first."""
        new = new.where(F.col(m.key).isNotNull())
        held = self._within(m, new).select(m.key, F.col(DIGEST).alias("_held"))
        # keys and digests alone say what to do; the rows themselves move once, or twice where some are there
        own = new.groupBy(m.key).agg(F.count("*").alias("_n"), F.min(DIGEST).alias("_least"), F.max(DIGEST).alias("_most"))
        own = own.join(held, m.key, "left") if m.batches else own.withColumn("_held", F.lit(None).cast("string"))
        there = F.col("_held").isNotNull()
        other = (F.col("_least") != F.col("_most")) | (there & (F.col("_held") != F.col("_least")))
        said = own.agg(F.min(F.when(other, F.col(m.key))).alias("clash"), F.count_if(F.col("_n") > 1).alias("repeated"), F.count_if(there).alias("there"), F.count_if(~there).alias("fresh")).first()
        if said.clash is not None:
            raise Conflict(f"{said.clash} is there with other content")
        if not said.fresh:
            return 0
        fresh = new.dropDuplicates([m.key]) if said.repeated else new
        fresh = fresh.join(held.select(m.key), m.key, "left_anti") if said.there else fresh
        path = uuid.uuid4().hex
        self._write(fresh.select(*new.columns), m, path)
        n, check, _ = self._summed(m, (Batch(batch, path, 0, 0),), digests=False)[path]
        if self._put(self._next(m, batches=(*m.batches, Batch(batch, path, n, check)))):
            return n
        self.files.delete(f"{self.folder}/data/batch={path}")
        return None

    def compact(self) -> int:
        """Merge all batches into one and say how many there were; their ids stay known."""
        m = self.manifest()
        if len(m.batches) < 2:
            return len(m.batches)
        self._replace(m, self._read(m, m.batches).drop("batch", "bucket"), m)
        return len(m.batches)

    def _replace(self, head: Manifest, rows: DataFrame, like: Manifest, moved: bool = True) -> None:
        """Commit ``rows``, with their digests, as the one batch of the next version."""
        path = uuid.uuid4().hex
        self._write(rows, like, path, moved)
        n, check, _ = self._summed(like, (Batch("", path, 0, 0),), digests=False).get(path, (0, 0, 0))
        one = (Batch(f"version-{head.version + 1}", path, n, check, tuple(sorted(head.known))),) if n else ()
        if not self._put(self._next(head, batches=one, schema=like.schema, format=like.format)):
            self.files.delete(f"{self.folder}/data/batch={path}")
            raise RuntimeError(f"{self.folder}: another writer was first")

    def vacuum(self, keep: int = 1) -> int:
        """Delete all versions but the last ones, and batches that none of those names; say how many batches."""
        there = self.versions()
        for v in there[: max(0, len(there) - keep)]:
            self.files.delete(self._name(v))
        named = {b.path for v in self.versions() for b in self.manifest(v).batches}
        loose = [n for n in self.files.names(f"{self.folder}/data") if n.startswith("batch=") and n[6:] not in named]
        for n in loose:
            self.files.delete(f"{self.folder}/data/{n}")
        return len(loose)

    # --- checks, copies, formats -------------------------------------------

    def problems(self, version: int | None = None) -> list[str]:
        """What is wrong with a version: its line of manifests, batches that are not as written, rows without their digest."""
        m = self.manifest(version)
        out = []
        there = self.versions()
        if m.parent and m.version - 1 in there:
            before = hashlib.sha256(self.files.read(self._name(m.version - 1)).encode()).hexdigest()
            if before != m.parent:
                out.append(f"version {m.version - 1} is not the one that version {m.version} was made from")
        gone = [b for b in m.batches if not self.files.exists(f"{self.folder}/data/batch={b.path}")]
        out += [f"batch {b.id}: missing" for b in gone]
        now = self._summed(m, tuple(b for b in m.batches if b not in gone))
        for b in m.batches:
            if b not in gone:
                n, check, bad = now.get(b.path, (0, 0, 0))
                if n != b.rows:
                    out.append(f"batch {b.id}: {n} rows of {b.rows}")
                elif check != b.check:
                    out.append(f"batch {b.id}: other keys or digests")
                if bad:
                    out.append(f"batch {b.id}: {bad} rows without their digest")
        return out

    def copied(self, folder: str, version: int | None = None) -> Ledger:
        """A version, checked before and after, as the only one of a new ledger."""
        m = self.manifest(version)
        to = Ledger(self.spark, folder)
        if to.versions():
            raise FileExistsError(folder)
        if found := self.problems(m.version):
            raise Damaged("; ".join(found))
        if m.batches:
            # each task has read parts of few buckets, and writes as many files as it has read
            self._files(self._read(m, m.batches), m.key, ["batch", "bucket"], f"{to.folder}/data")
        to._put(Manifest(**m.__dict__ | {"version": m.version, "parent": None}))
        if found := to.problems():
            to.files.delete(to._name(m.version))
            raise Damaged("; ".join(found))
        return to

    def migrated(self, to: int, steps: Mapping[int, Callable[[DataFrame], DataFrame]]) -> int:
        """Carry the rows forward, one format at a time, and say how many steps that took.

        ``steps[f]`` makes rows of format f + 1 from those of format f. A later
        format than ``to``, or a missing step, is refused, and so are rows that are
        not as written: a digest that is there is never made anew over a change.
        """
        done = 0
        while (m := self.manifest()).format != to:
            if m.format > to or m.format not in steps:
                raise Unsupported(f"{self.folder}: no way from format {m.format} to {to}")
            if found := self.problems():
                raise Damaged("; ".join(found))
            rows = sealed(steps[m.format](self.rows().drop(DIGEST)))
            kind = T.StructType([f for f in rows.schema if f.name != DIGEST])
            # rows keep their keys, so they are where their buckets are
            self._replace(m, rows, Manifest(**m.__dict__ | {"format": m.format + 1, "schema": kind.json()}), moved=False)
            done += 1
        return done
