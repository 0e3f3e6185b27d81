"""Tables by key that change in place: buckets of Parquet, and one manifest for each change.

A row's bucket is the hash of its key. A change rewrites the buckets that its keys fall into, each into a
folder of its own, and then adds one manifest: for every bucket, the folder that holds it now. A manifest
is a single small file and the last thing that a change writes, so a reader sees all of a change or
nothing of it, and a change that dies leaves the table as it was. Buckets that a change does not touch
keep their files.

Manifests are numbered. Whoever adds a number that is there already has lost a race and fails. Each
names its writer (a stream, or nobody) and the writer's batch: a batch that is delivered again after its
manifest is there changes nothing, a batch whose base is missing fails, and so does a stream that the
table does not belong to, whatever its first batch is.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Change = Callable[[DataFrame, DataFrame], DataFrame]
_LOG = "version int, writer string, batch long, buckets int, bucket int, folder string"


class Conflict(RuntimeError):
    """Somebody else has changed the table since it was read."""


@dataclass(frozen=True)
class Manifest:
    version: int
    writer: str | None
    batch: int
    buckets: int
    folders: dict[int, str]


class KeyedTable:
    """schema: of the rows (a StructType, or as text), one a key. buckets: of a new table; one that is there keeps its own number."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType | str, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def versions(self) -> list[int]:
        """The numbers of all manifests, from one listing."""
        try:
            files = self.spark.read.schema(_LOG).parquet(f"{self.path}/log/*").inputFiles()
        except AnalysisException:
            return []
        return sorted({int(m[1]) for f in files if (m := re.search(r"/log/v(\d+)/", f))})

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The manifest of a version, the newest by default; None of a table that is not there yet."""
        known = self.versions()
        if not known:
            return None
        rows = self.spark.read.schema(_LOG).parquet(f"{self.path}/log/v{known[-1] if version is None else version:012d}").collect()
        return Manifest(rows[0].version, rows[0].writer, rows[0].batch, rows[0].buckets, {r.bucket: r.folder for r in rows if r.folder})

    def _rows(self, folders: list[str]) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the newest by default; no rows of a table that is not there yet."""
        at = self.manifest(version)
        return self._rows(list(at.folders.values()) if at else [])

    def change(self, new: DataFrame, how: Change, writer: str | None = None, batch: int = 0, take_over: bool = False, base: int | None = None) -> int:
        """Rewrites the buckets of new's keys as how(their rows, new), and returns the table's version.

        writer, batch: a stream's name and its batch's number. take_over: the table may be another's until
        now. base: the version that new was made from; fails if the table has gone on since."""
        now = self.manifest()
        version = now.version if now else -1
        if base is not None and base != version:
            raise Conflict(f"{self.path} is at version {version}, the change was made from {base}")
        if writer is not None and now is not None and now.writer == writer:
            if batch <= now.batch:
                return version
            if batch > now.batch + 1:
                raise ValueError(f"{self.path}: batch {now.batch + 1} of {writer} is missing")
        elif writer is not None and not take_over and (now is not None or batch > 0):
            raise ValueError(f"{self.path} does not hold the batches of {writer}; a new stream needs a new table")
        if writer is None and now is not None:
            writer, batch = now.writer, now.batch
        buckets = now.buckets if now else self.buckets
        bucket = F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")
        folders = dict(now.folders) if now else {}
        # One row for each bucket: as many as the table has at most.
        touched = sorted(r[0] for r in new.select(bucket).distinct().collect())
        folder = f"data/{version + 1:012d}-{uuid.uuid4().hex}"
        old = self._rows([folders[b] for b in touched if b in folders])
        out = how(old, new).select(*self.schema.names).withColumn("_bucket", bucket)
        out.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        folders |= {b: f"{folder}/_bucket={b}" for b in touched}
        filled = {r[0] for r in self.spark.read.schema("_bucket int").parquet(f"{self.path}/{folder}").distinct().collect()} if touched else set()
        rows = [(version + 1, writer, batch, buckets, b, folders.get(b) if b not in touched or b in filled else None) for b in range(buckets)]
        try:
            self.spark.createDataFrame(rows, _LOG).coalesce(1).write.mode("error").parquet(f"{self.path}/log/v{version + 1:012d}")
        except AnalysisException as e:
            raise Conflict(f"{self.path} got another version {version + 1} meanwhile") from e
        return version + 1

    def upsert(self, rows: DataFrame, **kw) -> int:
        """Rows in place of those with the same keys; rows has one for a key."""
        return self.change(rows, lambda old, new: old.join(new.select(self.key), self.key, "left_anti").unionByName(new), **kw)

    def update(self, values: DataFrame, **kw) -> int:
        """values: the key and some columns, one row a key. Rows with the key get these columns' values;
        keys that the table does not have change nothing."""
        names = [c for c in values.columns if c != self.key]

        def how(old: DataFrame, new: DataFrame) -> DataFrame:
            marked = new.select(self.key, *(F.col(c).alias(f"_new_{c}") for c in names), F.lit(True).alias("_has"))
            return old.join(marked, self.key, "left").withColumns({c: F.when(F.col("_has"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in names})

        return self.change(values, how, **kw)

    def delete(self, keys: DataFrame, **kw) -> int:
        """Rows with these keys go."""
        return self.change(keys, lambda old, new: old.join(new.select(self.key), self.key, "left_anti"), **kw)

    def unnamed(self, keep: int = 2) -> list[str]:
        """Data folders that none of the newest manifests names, for whoever clears the store."""
        known = self.versions()
        if not known:
            return []
        named = {f for v in known[-keep:] for f in self.manifest(v).folders.values()}
        older = {f for v in known[:-keep] for f in self.manifest(v).folders.values()}
        return sorted(older - named)
