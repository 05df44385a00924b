"""The state of every section: a fold of harvested, done and failed events, and its reports.

Rules of the fold, by event and in order of ``seq``:

* harvested, key unknown: a pending row. Known and not done: nodeid, title, number, heading and
  source_url are refreshed. Known and done: nothing.
* done: status done, record set, error cleared. failed: status failed, error cut to 1000
  characters, record kept. Neither does anything for an unknown key.
* harvested with a key other than its urn deletes the row keyed by the bare urn unless that is done.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import MANIFEST, MANIFEST_EVENTS
from ..store import BUCKETS, Store, bucket

META = ["nodeid", "title", "number", "heading", "source_url"]
COLUMNS = [c.split()[0] for c in MANIFEST.split(", ")]
EVENT_COLUMNS = [c.split()[0] for c in MANIFEST_EVENTS.split(", ")]
SUPERSEDED = "superseded"
_ENDS = ["done", "failed"]


def event_urn() -> Column:
    """An event's urn: its own, or the key up to the first ``#``."""
    return F.coalesce("urn", F.substring_index("section_key", "#", 1))


def fold(events: DataFrame) -> DataFrame:
    """The manifest that ``events`` leave, by windows alone: what a superseding harvest does to the bare urn's
    row is a mark among the events of that key."""
    named = events.select(*EVENT_COLUMNS).withColumn("urn", event_urn())
    return fold_by_window(settled(named, named))


def settled(events: DataFrame, later: DataFrame) -> DataFrame:
    """``events`` without those before the last mark that deleted the row of their key; the harvests in ``later``
    mark the keys that they supersede.

    Marks cut a key's events into runs. A row is deleted at a mark unless it is done there. So a run has one of three effects:
    it leaves the row done whatever came before (a done comes last, after a harvest of the run's own), it leaves it not
    done (a failure comes last), or it leaves it as it was, absent or done. The last run with one of the first two effects decides.
    """
    marks = later.where((F.col("kind") == "harvested") & (F.col("section_key") != F.col("urn")))
    marks = marks.select(*[F.col("urn") if c == "section_key" else F.lit(SUPERSEDED).alias("kind") if c == "kind" else F.col(c) for c in EVENT_COLUMNS])
    marks = marks.toDF(*EVENT_COLUMNS)
    superseded = marks.select("section_key").distinct()
    key = Window.partitionBy("section_key")
    is_mark, harvested, ended = F.col("kind") == SUPERSEDED, F.col("kind") == "harvested", F.col("kind").isin(_ENDS)
    before = key.orderBy("seq", F.col("kind") == SUPERSEDED).rowsBetween(Window.unboundedPreceding, -1)
    run = events.join(superseded, "section_key", "left_semi").select("section_key", "seq", "kind").unionByName(marks.select("section_key", "seq", "kind"))
    run = run.withColumn("run", F.coalesce(F.sum(F.when(is_mark, 1).otherwise(0)).over(before), F.lit(0)))
    run = run.withColumn("first", F.min(F.when(harvested, F.col("seq"))).over(Window.partitionBy("section_key", "run")))
    runs = run.groupBy("section_key", "run").agg(
        F.max(F.when(is_mark, F.col("seq"))).alias("mark"), F.max_by("kind", F.when(ended, F.col("seq"))).alias("last"), F.max_by("kind", F.when(ended & (F.col("seq") > F.col("first")), F.col("seq"))).alias("last_own")
    ).where("mark is not null")
    effect = F.when(F.col("last_own") == "done", "done").when(F.col("last") == "failed", "absent")
    after = F.coalesce(F.last(effect, ignorenulls=True).over(key.orderBy("run").rowsBetween(Window.unboundedPreceding, 0)), F.lit("absent"))
    resets = runs.withColumn("after", after).where("after = 'absent'").groupBy(F.col("section_key").alias("__key")).agg(F.max("mark").alias("__reset"))
    kept = events.join(resets, F.col("section_key") == F.col("__key"), "left").where(F.col("__reset").isNull() | (F.col("seq") > F.col("__reset")))
    return kept.drop("__key", "__reset")


def fold_by_window(events: DataFrame) -> DataFrame:
    """The fold of keys that nothing supersedes."""
    key = Window.partitionBy("section_key")
    harvested, ended = F.col("kind") == "harvested", F.col("kind").isin(_ENDS)
    e = events.withColumn("first", F.min(F.when(harvested, F.col("seq"))).over(key)).where(harvested | (ended & (F.col("seq") > F.col("first"))))
    before = F.last(F.when(ended, F.col("kind")), ignorenulls=True).over(key.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("before", F.coalesce(before, F.lit("")))
    seq = F.col("seq")
    last = F.max_by(F.struct("kind", "error", "ts"), F.when(ended, seq))
    meta = F.max_by(F.struct(*META), F.when(harvested & (F.col("before") != "done"), seq))
    rows = e.groupBy("section_key").agg(
        F.min_by("urn", F.when(harvested, seq)).alias("urn"), meta.alias("meta"), last.alias("last"), F.max_by("record", F.when(F.col("kind") == "done", seq)).alias("record"),
        F.min_by("ts", F.when(harvested, seq)).alias("first_ts"),
    )
    status = F.coalesce("last.kind", F.lit("pending"))
    return rows.select(
        "section_key", "urn", *[F.col(f"meta.{c}").alias(c) for c in META], status.alias("status"), F.lit(None).cast("string").alias("path"), "record",
        F.when(status == "failed", F.left(F.coalesce("last.error", F.lit("")), F.lit(1000))).alias("error"), F.coalesce("last.ts", "first_ts").alias("updated_at"),
    )


def snapshot_events(snapshot: DataFrame) -> DataFrame:
    """Events that rebuild a snapshot; their ``seq`` is below any that comes later."""
    empty = F.lit(None).cast("string")
    harvest = snapshot.select(
        F.lit(-3).cast("long").alias("seq"), F.col("updated_at").alias("ts"), F.lit("harvested").alias("kind"), "section_key", "urn", *META, empty.alias("record"), empty.alias("error")
    )
    keys = [F.col("updated_at").alias("ts")]
    blank = [empty.alias(c) for c in META]
    done = snapshot.where("status = 'done' or record is not null").select(F.lit(-2).cast("long").alias("seq"), *keys, F.lit("done").alias("kind"), "section_key", "urn", *blank, "record", empty.alias("error"))
    failed = snapshot.where("status = 'failed'").select(F.lit(-1).cast("long").alias("seq"), *keys, F.lit("failed").alias("kind"), "section_key", "urn", *blank, empty.alias("record"), "error")
    return harvest.unionByName(done).unionByName(failed)


def upsert(snapshot: DataFrame, events: DataFrame) -> DataFrame:
    """The snapshot after more events. ``seq`` of the events is at least 0.

    A harvest of the snapshot never supersedes a bare urn of the snapshot: it has been settled.
    """
    named = events.select(*EVENT_COLUMNS).withColumn("urn", event_urn())
    return fold_by_window(settled(snapshot_events(snapshot).unionByName(named), named))


def migrate(old: DataFrame) -> DataFrame:
    """A snapshot of the older layout, keyed by urn, perhaps without a record column."""
    have = set(old.columns)
    record = F.col("record") if "record" in have else F.lit(None).cast("string")
    path = F.col("path") if "path" in have else F.lit(None).cast("string")
    return old.select(
        F.col("urn").alias("section_key"), "urn", *META, F.coalesce("status", F.lit("pending")).alias("status"), path.alias("path"), record.alias("record"), "error", F.col("updated_at").cast("double").alias("updated_at")
    )


def _of(urn: Column) -> Column:
    """The bucket of a key or urn: that of its document, so that a bare urn is in the bucket of the keys that supersede it."""
    return bucket(F.substring_index(urn, "#", 1))


def write_snapshot(manifest: DataFrame, folder: str) -> int:
    """Write a whole manifest as the newest version; its number. Raises :class:`~sectionmill.store.ConflictError` if another writer made that version meanwhile."""
    store = Store(manifest.sparkSession, folder)
    base = store.version()
    touched = [int(k.partition("/")[2]) for k in base.folders] + list(range(BUCKETS))
    return store.commit(base, store.stage(manifest.select(*COLUMNS), "manifest", _of(F.col("section_key")), sorted(set(touched)))).number


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version that was committed; an empty manifest if there is none."""
    store = Store(spark, folder)
    return store.read(store.version(), "manifest", MANIFEST)


def upsert_snapshot(events: DataFrame, folder: str, batch: int | None = None) -> list[int]:
    """Fold events into the newest version and commit the next: only buckets of documents that the events name are read
    and written; these are returned. ``seq`` of the events is at least 0. A ``batch`` that a version has already is left out. Raises as :func:`write_snapshot` does,
    and leaves the version as it was."""
    store = Store(events.sparkSession, folder)
    base = store.version()
    if batch is not None and batch <= base.batch:
        return []
    named = events.select(_of(F.col("section_key")).alias("a"), _of(event_urn()).alias("b"))
    touched = sorted(r["b"] for r in named.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("b")).distinct().collect())  # BUCKETS at most
    if touched:
        rows = upsert(store.read(base, "manifest", MANIFEST, touched), events)
        store.commit(base, store.stage(rows.select(*COLUMNS), "manifest", _of(F.col("section_key")), touched), batch)
    return touched


def pending(manifest: DataFrame, title: str | None = None) -> DataFrame:
    rows = manifest.where("status <> 'done'")
    return rows.where(F.col("title") == title) if title else rows


def failed_keys(manifest: DataFrame) -> DataFrame:
    return manifest.where("status = 'failed'").select("section_key")


def select_work(sections: DataFrame, manifest: DataFrame, only_failed: bool = False) -> DataFrame:
    """Sections still to do: not done and, for a retry, only failed ones."""
    work = sections.join(manifest.where("status = 'done'").select("section_key"), "section_key", "left_anti")
    return work.join(failed_keys(manifest), "section_key", "left_semi") if only_failed else work


def work_counts(sections: DataFrame, manifest: DataFrame, only_failed: bool = False) -> DataFrame:
    """One row: total, to_do, skipped."""
    total = sections.agg(F.count("*").alias("total"))
    to_do = select_work(sections, manifest, only_failed).agg(F.count("*").alias("to_do"))
    return total.crossJoin(F.broadcast(to_do)).select("total", "to_do", (F.col("total") - F.col("to_do")).alias("skipped"))  # one row each


def counts_by_status(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status").agg(F.count("*").alias("n"))


def title_counts(manifest: DataFrame) -> DataFrame:
    """(title, done, failed, pending, total); a null or empty title counts as Unknown."""
    title = F.when(X.filled(F.col("title")), F.col("title")).otherwise("Unknown")
    return manifest.groupBy(title.alias("title")).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("done", "failed", "pending")], F.count("*").alias("total"))


def titles_with_failures(counts: DataFrame) -> DataFrame:
    return counts.where("failed > 0")


def title_status(done: Column, failed: Column, total: Column) -> Column:
    begun = F.when((done > 0) | (failed > 0), "in progress").otherwise("not started")
    return F.when(F.coalesce(total, F.lit(0)) == 0, begun).when(total - done - failed <= 0, F.when(failed == 0, "complete").otherwise("has failures")).otherwise(begun)


def progress_percent(done: Column, total: Column) -> Column:
    """Done as a percentage of the total, at most 100; 0 without a total."""
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), done * 100.0 / F.nullif(total, F.lit(0))))


def overall_percent(done: Column, failed: Column, total: Column) -> Column:
    """Done and failed of the whole run, where no total counts as one."""
    whole = F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(1)).otherwise(total)
    return F.least(F.lit(100.0), (done + failed) * 100.0 / whole)


def titles_with_counts(titles: DataFrame, counts: DataFrame) -> DataFrame:
    """Catalog titles (nodeid, name) with their counts and status; without a match 0, 0 and null."""
    clean, _ = X.split_title_volume(F.col("name"))
    c = counts.select(F.col("title").alias("__title"), "done", "failed", "total")
    joined = titles.withColumn("clean", clean).join(c, F.col("clean") == F.col("__title"), "left").drop("__title")
    joined = joined.withColumns({"done": F.coalesce("done", F.lit(0)), "failed": F.coalesce("failed", F.lit(0))})
    return joined.withColumn("status", title_status(F.col("done"), F.col("failed"), F.col("total")))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """One row from (outcome: done, skipped or failed): total, done, skipped, failed."""
    return outcomes.agg(F.count("*").alias("total"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("done", "skipped", "failed")])
