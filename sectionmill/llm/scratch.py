"""Intermediate tables in the folder that the cluster shares, and small helpers of all operators.

A table written here cuts lineage and survives the loss of executors. The folder is
the one named in ``spark.checkpoint.dir``; a temporary one is used only where that
setting is absent and the master is local, as in tests on one machine.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local: list[str] = []

#: Rows and bytes of one Arrow batch, so that long texts don't add up in a Python worker.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20
#: Rows of a run that are put in order together, and runs of a block.
RUN, BLOCK = 500, 1000


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for this application's intermediate tables."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="sectionmill-"))
        base = _local[0]
    return f"{base.rstrip('/')}/sectionmill-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as read from there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a materialised table that no later step reads."""
    path = getattr(df, "_scratch_path", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers receive, for the session: a plan is carried out after
    the call that made it, so the setting has to stay. Smaller bounds of the caller's are kept."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def kind(df: DataFrame, column: str) -> str:
    """A column's type, as a schema string names it."""
    return df.schema[column].dataType.simpleString()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def content_key(*columns: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of the values; a null differs from an empty string. Rows that are equal
    in these columns have equal keys, and no key is null."""
    flags = [c.isNull() for c in columns]
    return F.xxhash64(*columns, *flags), F.xxhash64(F.lit(7), *flags, *reversed(columns))


def valid(text: Column) -> Column:
    """The text with every broken UTF-8 sequence replaced by U+FFFD."""
    return F.make_valid_utf8(text)


def run_starts(sums: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """``sums`` (keys, run, amount) gives (keys, run, start): the amounts of the runs before, by key.

    Runs are summed in blocks first, so that no window holds all runs of a large key.
    """
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocked = sums.withColumn("block", F.floor(F.col("run") / BLOCK))
    inner = before(Window.partitionBy(*keys, "block").orderBy("run"))
    outer = before(Window.partitionBy(*keys).orderBy("block"))
    blocks = blocked.groupBy(*keys, "block").agg(F.sum(amount).alias("in_block"))
    blocks = blocks.select(*keys, "block", F.coalesce(F.sum("in_block").over(outer), F.lit(0)).alias("base"))
    return blocked.withColumn("part", F.coalesce(F.sum(amount).over(inner), F.lit(0))).join(blocks, [*keys, "block"]).select(*keys, "run", (F.col("base") + F.col("part")).alias("start"))
