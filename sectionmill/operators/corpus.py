"""Records to a corpus: JSON lines and Markdown per title, in reading order.

Reading order is made of narrow rows (keys, sizes, paths), sorted by ranges; what a range needs to know of those before it is a
row of a small table. So a title may lie on any number of tasks. Bodies meet their place by a hash of their content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..workspace import written
from .records import unique_footnotes

GROUP = ["pub", "tit"]
SLUGS = ["pub_slug", "title_slug"]
#: Bytes of a part: a larger title is written in several parts, and a task writes less than two.
PART_BYTES = 128 << 20
_KEY = ["k1", "k2"]


def grouped(records: DataFrame) -> DataFrame:
    """Records with their group (pub, tit) and its slugs (pub_slug, title_slug)."""
    named = records.withColumns({
        "pub": F.when(X.filled(F.col("publication")), F.col("publication")).otherwise("Unknown"),
        "tit": F.when(X.filled(F.col("title")), F.col("title")).otherwise("Untitled"),
    })
    return named.withColumns({"pub_slug": X.slug(F.col("pub")), "title_slug": X.slug(F.col("tit"))})


def json_lines(records: DataFrame) -> DataFrame:
    """Groups and the emitted line of each record: ten fields, with nulls, footnotes as an object."""
    notes = F.map_from_entries(unique_footnotes(F.col("footnotes")))
    line = F.to_json(
        F.struct("breadcrumb", "body_markdown", notes.alias("footnotes"), "contentitem_urn", "pdtocnodeidentifier", "decoded_path", "retrieved_at", "jurisdiction", "word_count", "footnote_count"),
        {"ignoreNullFields": "false"},
    )
    return grouped(records).select("pub_slug", "title_slug", *GROUP, "nodeid", "seq", line.alias("value"))


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with two hashes of all their columns."""
    flags = [F.col(c).isNull() for c in rows.columns]
    return rows.withColumns({"k1": F.xxhash64(*rows.columns, *flags), "k2": F.xxhash64(F.lit(7), *flags, *reversed(rows.columns))})


def _in_order(narrow: DataFrame) -> DataFrame:
    """Rows, one for each key, in reading order: ``range`` and, within it and beyond, ``at``. A title's own lines (``seq`` null) come first."""
    order = [*SLUGS, *GROUP, F.col("seq").isNotNull(), F.col("nodeid").asc_nulls_first(), "seq", *_KEY]
    ordered = narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return written(ordered, "order").withColumn("range", F.shiftright("at", 33))


def _before(ranges: DataFrame, **columns: tuple[str, bool]) -> DataFrame:
    """A row per range with what the ranges before it hold: the last value of a column, or its sum."""
    order = Window.partitionBy(F.lit(0)).orderBy("range")  # a row per range
    summed = order.rowsBetween(Window.unboundedPreceding, -1)
    return written(ranges.select("range", *[(F.coalesce(F.sum(c).over(summed), F.lit(0)) if add else F.lag(c).over(order)).alias(name) for name, (c, add) in columns.items()]), "ranges")


def _here() -> Column:
    """A keyed line's place in its title, as a value that compares as reading order does."""
    return F.struct(*GROUP, F.col("seq").isNotNull().alias("own"), "nodeid", "seq", *_KEY)


def placed(lines: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Narrow rows (k1, k2, slugs, here, n, bytes, part) of keyed ``lines``: the corpus in reading order is cut into parts of ``part_bytes``. A title that is no
    larger is in one part, that in which it begins; equal lines are in one part."""
    narrow = lines.groupBy(*_KEY).agg(*[F.first(c).alias(c) for c in (*SLUGS, *GROUP, "nodeid", "seq")], F.count("*").alias("n"), F.sum(F.octet_length("value").cast("long") + 1).alias("bytes"))
    ordered = _in_order(narrow)
    base = _before(ordered.groupBy("range").agg(F.sum("bytes").alias("b")), base=("b", True))
    running = Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = ordered.join(base, "range").withColumn("from", F.col("base") + F.coalesce(F.sum("bytes").over(running), F.lit(0)))
    rows = written(rows.select(*SLUGS, _here().alias("here"), "range", "n", "bytes", "from"), "places")
    of_title = Window.partitionBy(*SLUGS)  # a row for each range that holds the title
    spans = rows.groupBy(*SLUGS, "range").agg(F.min("from").alias("start"), F.sum("bytes").alias("size"))
    spans = spans.select(*SLUGS, "range", F.min("start").over(of_title).alias("start"), F.sum("size").over(of_title).alias("size"))
    part = F.floor(F.when(F.col("size") <= part_bytes, F.col("start")).otherwise(F.col("from")) / part_bytes).cast("int")
    return rows.join(spans, [*SLUGS, "range"]).select("here.k1", "here.k2", *SLUGS, "here", "n", "bytes", part.alias("part"))


def write_titles(lines: DataFrame, path: str, mode: str = "overwrite", *, part_bytes: int = PART_BYTES) -> None:
    """A folder per publication and title with its lines in reading order: one file, or for a large title
    one for each part, in the order of their names. ``_parts`` tells the parts of each title, with their records and bytes.

    A part is written by one task. A line finds its part by where the parts of its title begin, so bodies are shuffled once. ``mode`` is that of the writer;
    titles that aren't among ``lines`` stay with the mode ``titles``.
    """
    keyed = _keyed(lines.select(*SLUGS, *GROUP, "nodeid", "seq", "value"))
    places = written(placed(keyed, part_bytes), "parts")
    parts = (places.agg(F.max("part")).first()[0] or 0) + 1
    starts = places.groupBy(*SLUGS, "part").agg(F.min("here").alias("here")).groupBy(*SLUGS).agg(F.collect_list(F.struct("here", "part")).alias("starts"))
    begun = F.filter("starts", lambda s: s["here"] <= F.col("here"))
    part = F.when(F.size("starts") == 1, F.get("starts", F.lit(0))["part"]).otherwise(F.array_max(F.transform(begun, lambda s: s["part"])))
    rows = keyed.select(*SLUGS, "value", _here().alias("here")).join(written(starts, "starts"), SLUGS).select(*SLUGS, "value", "here", part.alias("part"))
    rows = rows.repartitionById(parts, "part").sortWithinPartitions(*SLUGS, "here")
    files = lambda df, partial: (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") if partial else df.write.mode(mode)).partitionBy(*SLUGS)
    files(rows.select(*SLUGS, "value"), mode == "titles").text(path)
    told = places.groupBy(*SLUGS, "part").agg(F.sum("n").alias("records"), F.sum("bytes").alias("bytes"))
    files(told.repartition(*SLUGS), True).parquet(f"{path}/_parts")


def compile_jsonl(records: DataFrame, path: str) -> DataFrame:
    """Write the titles' lines below ``titles`` and all lines in order in the part files below
    ``corpus``; returns the statistics. Two titles with one slug share a file, one after the other."""
    lines = json_lines(records)
    write_titles(lines, f"{path}/titles")
    lines.orderBy(*GROUP, F.col("nodeid").asc_nulls_first(), "seq").select("value").write.mode("overwrite").text(f"{path}/corpus")
    return corpus_stats(records)


def corpus_stats(records: DataFrame) -> DataFrame:
    """One row: publications, titles, records."""
    titles = grouped(records).groupBy(*GROUP).agg(F.count("*").alias("n"))
    return titles.agg(F.countDistinct("pub").alias("publications"), F.count("*").alias("titles"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"))


def promoted_headings(records: DataFrame) -> DataFrame:
    """``records`` with ``head`` and ``rest``: a body's own ``###`` line that holds the heading becomes it."""
    heading, body = F.coalesce("heading", F.lit("")), F.coalesce("body_markdown", F.lit(""))
    number = X.strip(F.coalesce("section_number", F.lit("")))
    own = F.when((number != "") & ~F.startswith(heading, number), X.strip(F.concat(number, F.lit(". "), heading))).otherwise(heading)
    first = F.substring_index(body, "\n", 1)
    after = F.when(F.length(first) < F.length(body), F.substr(body, F.length(first) + 2)).otherwise("")
    hit = F.startswith(first, F.lit("### ")) & F.contains(F.lower(first), F.lower(own))
    return records.withColumns({
        "head": F.when(hit, X.strip(F.substr(first, F.lit(5)))).otherwise(F.when(own == "", "(untitled)").otherwise(own)),
        "rest": F.when(hit, F.ltrim(after, F.lit("\n"))).otherwise(body),
    })


def _told(rows: DataFrame, some: Column) -> DataFrame:
    """Keyed records with promoted headings give (k1, k2, at, told, last): a narrow row for each key with the Markdown headings, depth by depth, that differ from the path of
    the record before it in its title, and whether it is the last of its title that has headings or ``some`` text."""
    path = F.concat(F.filter(F.coalesce("hierarchy", F.array().cast("array<string>")), lambda x: X.filled(x)), F.array("head"))
    narrow = rows.select(*_KEY, *SLUGS, *GROUP, "nodeid", "seq", path.alias("path"), some.alias("some")).dropDuplicates(_KEY)
    ordered = _in_order(narrow).withColumn("here", F.struct(*GROUP, "path"))
    last = _before(ordered.groupBy("range").agg(F.max_by("here", "at").alias("last")), before=("last", False))
    previous = F.lag("here").over(Window.partitionBy("range").orderBy("at"))
    met = ordered.join(last, "range").withColumn("p", F.coalesce(previous, F.col("before")))
    same = (F.col("p.pub") == F.col("pub")) & (F.col("p.tit") == F.col("tit"))
    met = met.withColumn("previous", F.when(same, F.col("p.path")).otherwise(F.array().cast("array<string>")))
    marked = F.transform("path", lambda label, i: F.struct(i.alias("depth"), label.alias("label"), F.coalesce(F.get(F.col("previous"), i) != label, F.lit(True)).alias("new")))
    line = lambda s: F.concat(F.repeat(F.lit("#"), F.least(s["depth"] + 2, F.lit(6)).cast("int")), F.lit(" "), s["label"])
    told = written(met.select(*_KEY, *GROUP, "at", "some", F.transform(F.filter(marked, lambda s: s["new"]), line).alias("told")), "headings")
    ends = told.where(F.col("some") | (F.size("told") > 0)).groupBy(*GROUP).agg(F.max("at").alias("last_at")).select("last_at")
    return told.join(ends, F.col("at") == F.col("last_at"), "left").select(*_KEY, "at", "told", F.col("last_at").isNotNull().alias("last"))


def _headed(rows: DataFrame, told: DataFrame) -> DataFrame:
    """Keyed records with promoted headings, which meet their narrow rows here, with ``headings`` and ``last``. Of equal records the first alone has headings."""
    first = F.row_number().over(Window.partitionBy(*_KEY).orderBy(*_KEY)) == 1
    return rows.join(told, _KEY).withColumn("headings", F.when(first, F.col("told")).otherwise(F.array().cast("array<string>"))).drop("told")


def emitted_headings(records: DataFrame) -> DataFrame:
    """Grouped records with ``headings``: those Markdown headings that differ, depth by depth, from
    the previous record's path. Of equal records the first alone has any."""
    rows = promoted_headings(_keyed(grouped(records)))
    return _headed(rows, _told(rows, F.lit(True))).drop("last", *_KEY)


def title_facts(records: DataFrame) -> DataFrame:
    """(pub, tit, volume, jurisdiction, retrieved_at, n): first volume that isn't empty, facts of the
    first record, number of records."""
    place = F.struct(F.coalesce("nodeid", F.lit("")).alias("nodeid"), "seq")
    volume = F.min_by("volume", F.when(X.filled(F.col("volume")), place))
    return grouped(records).groupBy(*GROUP).agg(
        F.when(X.filled(F.max("volume")), volume).alias("volume"), F.min_by("jurisdiction", place).alias("jurisdiction"), F.min_by("retrieved_at", place).alias("retrieved_at"), F.count("*").alias("n")
    )


def markdown_blocks(records: DataFrame) -> DataFrame:
    """(pub_slug, title_slug, pub, tit, nodeid, seq, value): the blocks of each title's document, each with the line end
    before it: a title and facts first (``seq`` null), then the records in reading order. In order and a line end
    after each, they are the document; no title is ever one value."""
    rows = promoted_headings(_keyed(grouped(records)))
    notes = X.footnote_lines(unique_footnotes(F.col("footnotes")))
    rows = _headed(rows, _told(rows, X.filled(F.col("rest")) | X.filled(notes)))
    block = F.array_join(F.concat(F.col("headings"), F.filter(F.array("rest", notes), lambda x: X.filled(x))), "\n\n")
    rows = rows.select(*SLUGS, *GROUP, "nodeid", "seq", "last", block.alias("block")).where("block <> ''")
    # Of a title's records the last loses the blanks at its end.
    bodies = rows.withColumn("value", F.concat(F.lit("\n"), F.when(F.col("last"), F.regexp_replace("block", rf"(?U){X.WS}+\z", "")).otherwise(F.col("block")))).drop("block", "last")
    title = F.concat(F.lit("# "), F.col("tit"), F.when(F.col("volume").isNotNull(), F.concat(F.lit(" — "), F.col("volume"))).otherwise(""))
    facts = F.filter(F.array("pub", "jurisdiction", F.concat(F.col("n").cast("string"), F.lit(" sections")), F.concat(F.lit("retrieved "), F.left(F.coalesce("retrieved_at", F.lit("")), F.lit(10)))), lambda x: X.filled(x))
    head = F.concat(title, F.lit("\n\n*"), F.array_join(facts, " · "), F.lit("*"))
    null = F.lit(None)
    heads = title_facts(records).select(X.slug(F.col("pub")).alias("pub_slug"), X.slug(F.col("tit")).alias("title_slug"), *GROUP, null.cast("string").alias("nodeid"), null.cast("long").alias("seq"), head.alias("value"))
    return heads.unionByName(bodies.withColumn("seq", F.col("seq").cast("long")))


def compile_markdown(records: DataFrame, path: str) -> DataFrame:
    """Write one text per title, block by block; returns the statistics with the number of files."""
    write_titles(written(markdown_blocks(records), "blocks"), path)
    files = grouped(records).select("pub_slug", "title_slug").distinct().agg(F.count("*").alias("files"))
    return corpus_stats(records).crossJoin(F.broadcast(files))  # a row each


def slug_collisions(records: DataFrame) -> DataFrame:
    """Slugs that more than one title shares, with their number."""
    titles = grouped(records).select("pub_slug", "title_slug", *GROUP).distinct()
    return titles.groupBy("pub_slug", "title_slug").agg(F.count("*").alias("n")).where("n > 1")


def append_failures(failures: DataFrame, path: str) -> None:
    """Append one line per failure: urn, title, number, and kind with up to 200 characters of message."""
    what = F.concat(F.col("error_type"), F.lit(": "), F.left(F.coalesce("message", F.lit("")), F.lit(200)))
    failures.select(F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in ("urn", "title", "number")], what).alias("value")).write.mode("append").text(path)
