"""Tables replayed as streams: part by part, each to completion, resumed from the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.manifest import read_snapshot
from ..workspace import new_folder
from .streams import incremental_compile, latest_progress, manifest_stream, title_progress

#: Arrivals into which a table is cut, in order of ``seq``.
PARTS = 3


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares."""
    return new_folder(spark, "replay")


def _parts(rows: DataFrame) -> list[DataFrame]:
    """``rows`` cut into ``PARTS`` in order of ``seq``."""
    edges = [None, *(rows.stat.approxQuantile("seq", [i / PARTS for i in range(1, PARTS)], 0.01) if not rows.isEmpty() else []), None]
    every = F.lit(True)
    return [rows.where(every if low is None else F.col("seq") > low).where(every if high is None else F.col("seq") <= high) for low, high in zip(edges, edges[1:], strict=False)]


def replay(rows: DataFrame, folder: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Write ``rows`` in ``PARTS`` arrivals; after each, ``start(stream)`` begins a query that runs until it has read all there is."""
    for part in _parts(rows):
        part.write.mode("append").parquet(f"{folder}/arrivals")
        start(rows.sparkSession.readStream.schema(rows.schema).parquet(f"{folder}/arrivals")).awaitTermination()


def replay_manifest(events: DataFrame) -> DataFrame:
    """The manifest that the stream leaves."""
    folder = shared_folder(events.sparkSession)
    replay(events, folder, lambda s: manifest_stream(s, f"{folder}/manifest", f"{folder}/checkpoint"))
    return read_snapshot(events.sparkSession, f"{folder}/manifest")


def _replay_complete(events: DataFrame, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The last complete result; each batch has a folder of its own, so none is overwritten as it is read."""
    spark, folder = events.sparkSession, shared_folder(events.sparkSession)
    seen = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows-{number}")
        seen.append(number)

    replay(events, folder, lambda s: job(s).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    return spark.read.parquet(f"{folder}/rows-{max(seen)}")


def replay_title_progress(events: DataFrame) -> DataFrame:
    return _replay_complete(events, title_progress)


def replay_latest_progress(events: DataFrame) -> DataFrame:
    return _replay_complete(events, latest_progress)


def replay_compile(records: DataFrame) -> str:
    """Compile records that arrive in parts; returns the folder of the titles' lines."""
    folder = shared_folder(records.sparkSession)
    replay(records, folder, lambda s: incremental_compile(s, f"{folder}/records", f"{folder}/titles", f"{folder}/checkpoint"))
    return f"{folder}/titles"
