"""Manifest, progress and compile as streams. None needs event time. What the manifest and the compile keep of each section lies in buckets of
a :class:`~sectionmill.store.Store`, kept for good; the last arrival by ``seq`` wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..operators.corpus import grouped, json_lines, write_titles
from ..operators.manifest import upsert_snapshot
from ..store import Store, Version, bucket
from ..workspace import written


def manifest_stream(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep the manifest of a stream of events as the newest version of a snapshot (:func:`~sectionmill.operators.manifest.read_snapshot`).

    A batch folds its events, by windows, into the buckets of the documents that it names and commits them with its number, so that a
    batch that runs again does nothing. Events of a document may come in any batches; within one they are in order of ``seq``.
    """
    named = lambda batch, number: upsert_snapshot(batch, folder, number)
    return events.writeStream.foreachBatch(named).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def title_progress(events: DataFrame) -> DataFrame:
    """(title, done, failed) so far; a later success doesn't lower the failures."""
    title = F.when(X.filled(F.col("title")), F.col("title")).otherwise("Unknown")
    return events.groupBy(title.alias("title")).agg(F.count_if(F.col("kind") == "section").alias("done"), F.count_if(F.col("kind") == "fail").alias("failed"))


def latest_progress(events: DataFrame) -> DataFrame:
    """(title, label, done, failed, total) of each title's newest section event."""
    newest = F.max_by(F.struct("label", "done", "failed", "total"), "seq")
    return events.where("kind = 'section'").groupBy("title").agg(newest.alias("x")).select("title", "x.*")


#: What tells one section from another.
SECTION = ("contentitem_urn", "nodeid")
_SLUGS = ["pub_slug", "title_slug"]
_INDEX = "k1 long, k2 long, seq long, pub_slug string, title_slug string"


def _arrived(batch: DataFrame, key: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The batch's newest row of each section, with its title's slugs and two hashes of the section's key: narrow (k1, k2, seq, slugs), and whole."""
    rows = grouped(batch)
    flags = [F.col(c).isNull() for c in key]
    rows = rows.withColumns({"k1": F.xxhash64(*key, *flags), "k2": F.xxhash64(F.lit(7), *flags, *reversed(key)), "row": F.xxhash64(F.to_json(F.struct(*batch.columns)))})
    narrow = rows.groupBy("k1", "k2").agg(F.max(F.struct("seq", "row", *_SLUGS)).alias("r")).select("k1", "k2", "r.seq", *[f"r.{c}" for c in _SLUGS])
    newest = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.desc("seq"), F.desc("row"))) == 1
    return narrow, rows.withColumn("newest", newest).where("newest").drop("row", "newest")


def _buckets(rows: DataFrame, at: Column) -> list[int]:
    return sorted(r["b"] for r in rows.select(at.alias("b")).distinct().collect())  # store.BUCKETS at most


def incremental_compile(records: DataFrame, all_records: str, path: str, checkpoint: str, *, key: tuple[str, ...] = SECTION) -> StreamingQuery:
    """Write the titles that each batch of a stream of finished records touches, and no others.

    A section that arrives again is one line: its newest row by ``seq`` counts (of equal ones the last to arrive), and one that has moved
    to another title leaves the old one. ``all_records`` is the folder of a :class:`~sectionmill.store.Store` that keeps the newest row of every section, by buckets of
    titles, and where each section is, by buckets of sections. A batch replaces the buckets that it touches, so neither rows nor files
    add up with the number of batches. The titles are written first and the commit comes last: a batch that runs again does the same once more.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store = Store(spark, all_records)
        base = store.version()
        of_section, of_title = bucket(F.col("k1")), bucket(F.col("pub_slug"), F.col("title_slug"))
        narrow, whole = _arrived(batch, key)
        narrow = written(narrow, "arrivals")
        section_buckets = _buckets(narrow, of_section)
        known = store.read(base, "sections", _INDEX, section_buckets)
        before = known.select("k1", "k2", F.col("seq").alias("old_seq"), *[F.col(c).alias(f"old_{c}") for c in _SLUGS])
        fresh = written(narrow.join(before, ["k1", "k2"], "left").where("old_seq is null or seq is null or seq >= old_seq"), "fresh")
        touched = fresh.select(*_SLUGS).union(fresh.where("old_pub_slug is not null").select("old_pub_slug", "old_title_slug")).distinct()
        touched = written(touched, "touched")
        title_buckets = _buckets(touched, of_title)
        keys = fresh.select("k1", "k2")
        kept = store.read(base, "records", whole.schema, title_buckets).join(keys, ["k1", "k2"], "left_anti")
        # Staged before they are read: bodies go once by section, once by bucket, and once by their place in their title.
        changes = store.stage(kept.unionByName(whole.join(keys, ["k1", "k2"], "left_semi")), "records", of_title, title_buckets)
        now = store.read(Version(folders={k: v for k, v in changes.items() if v}), "records", whole.schema)
        write_titles(json_lines(now).join(touched, _SLUGS, "left_semi"), path, "titles")
        for r in touched.join(now.select(*_SLUGS), _SLUGS, "left_anti").toLocalIterator():  # titles that all their sections have left
            for top in (path, f"{path}/_parts"):
                store.remove(f"{top}/pub_slug={r['pub_slug']}/title_slug={r['title_slug']}")
        index = known.join(keys, ["k1", "k2"], "left_anti").unionByName(fresh.select("k1", "k2", "seq", *_SLUGS))
        store.commit(base, changes | store.stage(index, "sections", of_section, section_buckets))

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
