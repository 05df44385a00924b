"""Tables dealt over buckets, of which an update replaces those that it touches, in one commit.

A bucket's rows lie in a folder that is written once. A commit is a file that names the folder of every bucket; it is
written aside and then renamed to the next number, which fails where that number is there. So of two writers that began from
one version one wins, and a writer that is lost half-way leaves files that no commit names. Readers
take the commit of the highest number and the folders it names, and list no others. The file system has to rename
atomically without overwriting, as that of a streaming checkpoint has to.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 128


class ConflictError(RuntimeError):
    """Another writer has made the version that this one was to make."""


@dataclass(frozen=True)
class Version:
    """What a commit says: ``number`` (0: nothing yet), the folder of each bucket as family/bucket, folders that it replaced, and the last ``batch`` of a stream that is in it."""

    number: int = 0
    folders: dict[str, str] = field(default_factory=dict)
    replaced: tuple[str, ...] = ()
    batch: int = -1


def bucket(*columns: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


class Store:
    """Families of buckets below a folder. The driver holds a path for each bucket and no rows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join((self.folder, *parts)))

    def version(self) -> Version:
        """The newest version."""
        at = self._path("commits")
        if not self._files.exists(at):
            return Version()
        numbers = [int(n) for n in (p.getPath().getName() for p in self._files.listStatus(at)) if n.isdigit()]
        if not numbers:
            return Version()
        stream = self._files.open(self._path("commits", f"{max(numbers):010d}"))
        try:
            told = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Version(max(numbers), told["folders"], tuple(told["replaced"]), told["batch"])

    def read(self, version: Version, family: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a family, or of some of its buckets."""
        names = [n for n in version.folders if n.startswith(f"{family}/")] if buckets is None else [f"{family}/{b}" for b in buckets]
        paths = [f"{self.folder}/{version.folders[n]}" for n in names if n in version.folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def stage(self, rows: DataFrame, family: str, at: Column, touched: list[int]) -> dict[str, str | None]:
        """Write the whole new content of the buckets ``touched`` aside: bucket to folder, or none where nothing is left. A
        bucket of very many rows is written by several tasks."""
        name = f"data/{family}-{uuid.uuid4().hex}"
        rows.withColumn("bucket", at).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{name}")
        there = {int(n.partition("=")[2]) for n in (p.getPath().getName() for p in self._files.listStatus(self._path(name))) if n.startswith("bucket=")}
        return {f"{family}/{b}": f"{name}/bucket={b}" if b in there else None for b in touched}

    def commit(self, base: Version, changes: dict[str, str | None], batch: int | None = None) -> Version:
        """Make the version after ``base``, or raise :class:`ConflictError`. What the version before ``base`` had replaced is deleted."""
        folders = {k: v for k, v in (base.folders | changes).items() if v is not None}
        new = Version(base.number + 1, folders, tuple(base.folders[k] for k in changes if k in base.folders), base.batch if batch is None else batch)
        aside = self._path("commits", f".{uuid.uuid4().hex}")
        out = self._files.create(aside, False)
        try:
            out.write(json.dumps({"folders": new.folders, "replaced": new.replaced, "batch": new.batch}).encode())
        finally:
            out.close()
        options = self.spark._sc._gateway.new_array(self._hadoop.Options.Rename, 0)
        context = self._hadoop.FileContext.getFileContext(self._path().toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(context.makeQualified(aside), context.makeQualified(self._path("commits", f"{new.number:010d}")), options)
        except Py4JJavaError as e:
            self._files.delete(aside, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise ConflictError(f"version {new.number} of {self.folder} is there already") from None
            raise
        for old in base.replaced:
            self._files.delete(self._path(old), True)
        return new

    def remove(self, path: str) -> None:
        """Delete a folder that isn't part of the store."""
        at = self._hadoop.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
