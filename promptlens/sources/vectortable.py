"""A keyed table of immutable bucket files with versions (SNK-03, ST-02, SRC-05).

::

    root/data/<write>/bucket=<b>/part-*   rows of bucket b as one write left them
    root/versions/<n>.json                version n: its properties and, by
                                          bucket, the write that holds it

A row's bucket follows from its key: a hash of it, or, in the ``range`` layout,
a number carried in ``index`` divided by the rows wanted per bucket, so that a
range of numbers is a few buckets whose files are sorted by that number (rows
without one, and negative ones, are in buckets below 0). An
upsert reads the buckets its batch touches, writes them merged under a new name,
once, and then puts the next version file in place by a rename that fails if the
file exists. Nothing that a version names is ever changed, so a reader keeps the
version that it has opened, a writer that dies before the rename leaves the
table as it was, and of two writers one is told to try again. The number of the
last batch of each source is part of a version, so a replayed batch is skipped.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptlens.operators.incremental import last_wins


class WriteConflict(RuntimeError):
    """Another writer has put the same version in place."""


@dataclass(frozen=True)
class Version:
    number: int
    schema: str
    key: str
    layout: str
    buckets: int
    index: str | None
    parts: dict[int, str]
    applied: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @staticmethod
    def of(text: str) -> Version:
        told = json.loads(text)
        told["parts"] = {int(b): w for b, w in told["parts"].items()}
        return Version(**told)


class VectorTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- files ------------------------------------------------------------------
    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    @property
    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        fs, path = self._fs, self._path(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _put(self, version: Version) -> None:
        """The version file appears whole or not at all, and once only."""
        fs = self._fs
        fs.mkdirs(self._path("versions"))
        draft = self._path("versions", f".{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(version.to_json().encode()))
        out.close()
        final = self._path("versions", f"{version.number:012d}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise WriteConflict(f"version {version.number} of {self.root} is there already")

    # -- versions ---------------------------------------------------------------
    def versions(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self._names("versions") if n.endswith(".json") and not n.startswith(".")]

    def version(self, number: int | None = None) -> Version | None:
        """The named version, the newest if left out; None before the first."""
        if number is None:
            number = max(self.versions(), default=None)
        if number is None:
            return None
        stream = self._fs.open(self._path("versions", f"{number:012d}.json"))
        try:
            return Version.of(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def create(self, schema: T.StructType, key: str, buckets: int = 64, layout: str = "hash", index: str | None = None) -> VectorTable:
        """An empty table. ``buckets`` is their number in the hash layout, the
        numbers of ``index`` per bucket in the range layout."""
        if layout not in ("hash", "range") or (layout == "range") != (index is not None):
            raise ValueError("layout is 'hash', or 'range' with an index column")
        self._put(Version(1, schema.json(), key, layout, buckets, index, {}))
        return self

    # -- reading ----------------------------------------------------------------
    def read(self, number: int | None = None, only: list[int] | None = None) -> DataFrame:
        """All rows of a version; ``only``: those of these buckets."""
        version = self.version(number)
        if version is None:
            raise ValueError(f"no table at {self.root}")
        schema = T.StructType.fromJson(json.loads(version.schema))
        paths = [f"{self.root}/data/{w}/bucket={b}" for b, w in sorted(version.parts.items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def fetch(self, lo: int, hi: int, number: int | None = None) -> DataFrame:
        """Rows whose index is in [lo, hi). In the range layout only their
        buckets are opened; the filter itself reaches the Parquet reader, which
        skips row groups by their statistics."""
        version = self.version(number)
        if version is None or version.index is None:
            raise ValueError("a fetch by range needs a table with an index column")
        only = [b for b in version.parts if lo // version.buckets <= b <= (hi - 1) // version.buckets] if hi > lo else []
        return self.read(number, only).where((F.col(version.index) >= lo) & (F.col(version.index) < hi))

    # -- writing ----------------------------------------------------------------
    @staticmethod
    def _bucket(version: Version) -> Column:
        if version.layout == "range":
            at = F.col(version.index).cast("long")
            return F.coalesce(((at - F.pmod(at, F.lit(version.buckets))) / version.buckets).cast("int"), F.lit(-1))
        return F.pmod(F.xxhash64(F.col(version.key).cast("string")), F.lit(version.buckets)).cast("int")

    def upsert(self, batch: DataFrame, order: str | None = None, source: str | None = None, batch_id: int | None = None,
               replace_all: bool = False) -> int:
        """Insert or replace by key; of several rows of a key the one with the
        largest ``order`` counts. A batch of ``source`` that has been applied
        is skipped. Returns the table's version afterwards."""
        version = self.version()
        if version is None:
            raise ValueError(f"no table at {self.root}; create it first")
        if source is not None and version.applied.get(source, -1) >= batch_id:
            return version.number
        parts = {} if replace_all else dict(version.parts)
        batch = batch.persist()  # read for its buckets, its keys and its rows
        try:
            parts |= self._write(version, batch, order, parts)
        finally:
            batch.unpersist()
        applied = version.applied | ({source: batch_id} if source is not None else {})
        self._put(Version(version.number + 1, version.schema, version.key, version.layout, version.buckets, version.index, parts, applied))
        return version.number + 1

    def _write(self, version: Version, batch: DataFrame, order: str | None, parts: dict[int, str]) -> dict[int, str]:
        """Write the batch's buckets merged with the rows they have; returns
        where they are."""
        key, columns = version.key, T.StructType.fromJson(json.loads(version.schema)).names
        new = last_wins(batch, key, order) if order else batch.dropDuplicates([key])
        rows = new.select(*columns).withColumn("bucket", self._bucket(version))
        # one number per bucket of the table
        touched = [r[0] for r in batch.select(self._bucket(version)).distinct().collect()]
        if not touched:
            return {}
        old = [b for b in touched if b in parts]
        if old:
            keys = batch.select(F.col(key).alias("_key"))
            kept = self.read(version.number, old)
            kept = kept.join(keys, kept[key].eqNullSafe(keys["_key"]), "left_anti")
            rows = kept.withColumn("bucket", self._bucket(version)).unionByName(rows)
        write = f"{version.number + 1:012d}-{uuid.uuid4().hex[:12]}"
        (rows.repartition(min(len(touched), self._fan_out()), "bucket").sortWithinPartitions("bucket", version.index or key)
         .write.partitionBy("bucket").parquet(f"{self.root}/data/{write}"))
        return {b: write for b in touched}

    def _fan_out(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def expire(self, keep: int = 10) -> list[str]:
        """Forget all but the last ``keep`` versions and delete the bucket
        folders that none of those names; returns the deleted ones. Not to run
        while a writer is at work."""
        numbers = self.versions()
        kept, gone = numbers[-keep:], numbers[:-keep]
        named = {f"{w}/bucket={b}" for n in kept for b, w in self.version(n).parts.items()}
        for n in gone:
            self._fs.delete(self._path("versions", f"{n:012d}.json"), False)
        deleted = []
        for write in self._names("data"):
            folders = [x for x in self._names("data", write) if x.startswith("bucket=")]
            free = [x for x in folders if f"{write}/{x}" not in named]
            for x in free:
                self._fs.delete(self._path("data", write, x), True)
                deleted.append(f"{write}/{x}")
            if len(free) == len(folders):
                self._fs.delete(self._path("data", write), True)
        return deleted


def open_or_create(spark: SparkSession, root: str, schema: T.StructType, key: str, **properties) -> VectorTable:
    table = VectorTable(spark, root)
    return table if table.versions() else table.create(schema, key, **properties)
