"""Sections and what was parsed of them to records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import FOOTNOTES


def to_records(sections: DataFrame, parsed: DataFrame, retrieved_at: str) -> DataFrame:
    """The 18 columns of a record, ``nodeid`` and ``seq``, for each section that was parsed.

    ``retrieved_at`` is the run's time, ``%Y-%m-%dT%H:%M:%SZ``. Footnotes are an array here and a
    map in JSON.
    """
    p = parsed.where("error is null").select(F.col("section_key").alias("__key"), F.col("heading").alias("__heading"), "body_markdown", "footnotes")
    return record_columns(sections.join(p, F.col("section_key") == F.col("__key")), retrieved_at)


def record_columns(joined: DataFrame, retrieved_at: str) -> DataFrame:
    """Project section columns with __heading, body_markdown and footnotes to records."""
    c = F.col
    body = F.coalesce("body_markdown", F.lit(""))
    notes = F.coalesce("footnotes", F.array().cast(FOOTNOTES))
    heading = F.when(X.filled(c("__heading")), c("__heading")).otherwise(c("heading"))
    last = F.when(X.filled(c("number")), X.strip(F.concat(c("number"), F.lit(". "), heading))).otherwise(heading)
    title = F.when(X.filled(c("volume")), F.concat(c("title"), F.lit(" ("), c("volume"), F.lit(")"))).otherwise(c("title"))
    crumb = F.filter(F.concat(F.array("publication", title), c("hierarchy"), F.array(last)), lambda x: x.isNotNull() & (x != ""))
    return joined.select(
        X.short_id(c("urn")).alias("id"), "publication", "title", "volume", c("number").alias("section_number"), heading.alias("heading"), "hierarchy",
        F.array_join(crumb, X.SEPARATOR).alias("breadcrumb"), body.alias("body_markdown"), notes.alias("footnotes"), c("urn").alias("contentitem_urn"),
        c("nodeid").alias("pdtocnodeidentifier"), "decoded_path", "source_url", F.lit(retrieved_at).alias("retrieved_at"), X.jurisdiction(c("publication")).alias("jurisdiction"),
        X.word_count(body).alias("word_count"), F.size(notes).alias("footnote_count"), "nodeid", "seq",
    )


def section_documents(records: DataFrame) -> DataFrame:
    """(nodeid, document): each record as a standalone Markdown document."""
    return records.select("contentitem_urn", "nodeid", X.assemble(F.col("section_number"), F.col("heading"), F.col("body_markdown"), F.col("footnotes")).alias("document"))


def footnotes_table(records: DataFrame) -> DataFrame:
    """One row (contentitem_urn, nodeid, place, n, text) per footnote, in order."""
    return records.select("contentitem_urn", "nodeid", F.posexplode("footnotes").alias("place", "note")).select("contentitem_urn", "nodeid", "place", F.col("note.n").alias("n"), F.col("note.text").alias("text"))


def unique_footnotes(footnotes):
    """Footnotes with each number once: at its first place, with its last text."""
    numbers = F.array_distinct(F.transform(footnotes, lambda f: f["n"]))
    last = lambda n: F.element_at(F.filter(footnotes, lambda f: f["n"] == n), -1)["text"]
    return F.transform(numbers, lambda n: F.struct(n.alias("n"), last(n).alias("text")))
