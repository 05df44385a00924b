"""Contents nodes to sections: candidates, keys, hierarchy, reading order, and audits of a capture.

Every job takes the ``toc_nodes`` table: nodes with publication, title_nodeid, title_name and a
``seq`` that says in which order they arrived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nodeid as N
from ..functions import text as X
from ..functions import urls as U

TITLE = ["publication", "title_nodeid"]


def candidates(nodes: DataFrame) -> DataFrame:
    """Nodes that are sections: with urn and id, and without children or with an anchor of their own."""
    branch = F.coalesce("has_children", F.lit(False))
    return nodes.where(X.filled(F.col("urn")) & X.filled(F.col("nodeid")) & (~branch | X.filled(F.col("anchor_id"))))


def section_keys(nodes: DataFrame) -> DataFrame:
    """Candidates with ``section_key``: the urn, or urn#nodeid where a title uses the urn more than once.

    The count is an aggregate joined back, so one urn with very many sections is summed before
    it is shuffled and its rows can be split at run time.
    """
    found = candidates(nodes)
    uses = found.groupBy(*TITLE, "urn").agg(F.count("*").alias("__uses"))
    uses = uses.select(*[F.col(c).alias(f"__{c}") for c in TITLE], F.col("urn").alias("__urn"), "__uses")
    same = (F.col("urn") == F.col("__urn")) & F.col("publication").eqNullSafe(F.col("__publication")) & F.col("title_nodeid").eqNullSafe(F.col("__title_nodeid"))
    key = F.when(F.col("__uses") > 1, F.concat_ws("#", "urn", "nodeid")).otherwise(F.col("urn"))
    return found.join(uses, same).select(*nodes.columns, key.alias("section_key"))


def first_by_key(keyed: DataFrame, seq: str = "seq") -> DataFrame:
    """The first row of each title's section key."""
    rows = Window.partitionBy(*TITLE, "section_key").orderBy(seq)
    return keyed.withColumn("__n", F.row_number().over(rows)).where("__n = 1").drop("__n")


def last_labels(nodes: DataFrame) -> DataFrame:
    """(title, nodeid, label): the last label of each node, even if that one is empty."""
    label = X.strip(F.coalesce("label", F.lit("")))
    return nodes.where(X.filled(F.col("nodeid"))).groupBy(*TITLE, "nodeid").agg(F.max_by(label, F.col("seq")).alias("label"))


def hierarchies(sections: DataFrame, nodes: DataFrame) -> DataFrame:
    """``sections`` with ``hierarchy``: labels of the ancestors below the title, root first.

    Prefixes of the id meet the labels in an equi-join; nothing walks the tree.
    """
    labels = last_labels(nodes).where("label <> ''").select(*[F.col(c).alias(f"__{c}") for c in TITLE], F.col("nodeid").alias("__prefix"), F.col("label").alias("__label"))
    wanted = sections.select(*TITLE, "section_key", F.explode(N.proper_prefixes(F.col("nodeid"), 6)).alias("prefix"))
    met = wanted.join(labels, (F.col("prefix") == F.col("__prefix")) & F.col("publication").eqNullSafe(F.col("__publication")) & F.col("title_nodeid").eqNullSafe(F.col("__title_nodeid")))
    path = F.transform(F.array_sort(F.collect_list(F.struct(F.length("prefix").alias("n"), F.col("__label").alias("label")))), lambda s: s["label"])
    paths = met.groupBy(*TITLE, "section_key").agg(path.alias("hierarchy"))
    paths = paths.select(*[F.col(c).alias(f"__{c}") for c in TITLE], F.col("section_key").alias("__key"), "hierarchy")
    on = (F.col("section_key") == F.col("__key")) & F.col("publication").eqNullSafe(F.col("__publication")) & F.col("title_nodeid").eqNullSafe(F.col("__title_nodeid"))
    joined = sections.join(paths, on, "left").drop("__key", "__publication", "__title_nodeid")
    return joined.withColumn("hierarchy", F.coalesce("hierarchy", F.array().cast("array<string>")))


def build_sections(nodes: DataFrame, *, base_url: str = U.BASE_URL, wide_ids: bool = False) -> DataFrame:
    """Ordered, deduplicated sections of all titles, without those whose id isn't valid.

    Rows of an invalid id are in :func:`rejects`. ``wide_ids`` are those of more siblings than a chunk's letters number.
    """
    kept = first_by_key(section_keys(nodes.where(N.is_valid(F.col("nodeid"), wide_ids) | ~X.filled(F.col("nodeid")))))
    placed = hierarchies(kept, nodes)
    number, heading = X.split_number_heading(F.col("label"))
    title, volume = X.split_title_volume(F.col("title_name"))
    url = F.when(X.filled(F.col("url")), F.col("url")).otherwise(U.build_viewer_url(F.col("urn"), F.col("nodeid"), F.col("anchor_id"), base_url=base_url))
    return placed.select(
        "section_key", "urn", "nodeid", title.alias("title"), number.alias("number"), heading.alias("heading"), "hierarchy", volume.alias("volume"),
        url.alias("source_url"), "publication", "anchor_id", F.coalesce("has_children", F.lit(False)).alias("body_only"), N.nodeid_to_path(F.col("nodeid"), wide_ids).alias("decoded_path"), "title_nodeid", "seq",
    )


def rejects(nodes: DataFrame, *, wide_ids: bool = False) -> DataFrame:
    """Candidates that can't be placed, with the reason."""
    return candidates(nodes).where(~N.is_valid(F.col("nodeid"), wide_ids)).withColumn("error", F.concat(F.lit("invalid node id: "), F.col("nodeid")))


def reading_order(rows: DataFrame, group: list[str], nodeid: str = "nodeid", seq: str = "seq") -> DataFrame:
    """Rows sorted by group and path; a missing path first, ties as they came."""
    return rows.orderBy(*group, F.col(nodeid).asc_nulls_first(), seq)


def merge_batches(nodes: DataFrame, batch: str = "batch_seq") -> DataFrame:
    """The union of captured responses: the first delivery of each title's node wins."""
    rows = Window.partitionBy(*TITLE, "nodeid").orderBy(batch, "seq")
    return nodes.withColumn("__n", F.row_number().over(rows)).where("__n = 1").drop("__n")


def stranded(nodes: DataFrame) -> DataFrame:
    """Branches of which no child arrived."""
    parents = nodes.select(*[F.coalesce(F.col(c), F.lit("")).alias(f"__{c}") for c in TITLE], N.parent(F.col("nodeid")).alias("__parent")).where("__parent is not null").distinct()
    on = (F.col("nodeid") == F.col("__parent")) & (F.coalesce("publication", F.lit("")) == F.col("__publication")) & (F.coalesce("title_nodeid", F.lit("")) == F.col("__title_nodeid"))
    return nodes.where(F.coalesce("has_children", F.lit(False))).join(parents, on, "left_anti")


def frontier(nodes: DataFrame, titles: DataFrame) -> DataFrame:
    """What to ask for next: stranded branches, each with the deepest level to ask for."""
    levels = titles.select(F.col("nodeid").alias("__title"), X.extract_to_level(F.col("countsbylevel")).alias("title_level"))
    level = F.when(F.col("max_level") > 0, F.col("max_level")).otherwise(F.coalesce("title_level", F.lit(X.DEFAULT_LEVELS)))
    return stranded(nodes).join(levels, F.col("title_nodeid") == F.col("__title"), "left").select(*TITLE, "nodeid", level.alias("target_level"))


def subtree(nodes: DataFrame, roots: DataFrame, root: str = "root") -> DataFrame:
    """(root, node columns): all proper descendants of the given roots, by an equi-join on prefixes."""
    prefix = N.proper_prefixes(F.col("nodeid"), 3)
    return nodes.withColumn("__prefix", F.explode(prefix)).join(roots.select(F.col(root).alias("root")).distinct(), F.col("__prefix") == F.col("root")).select("root", *nodes.columns)


def title_catalog(nodes: DataFrame) -> DataFrame:
    """Titles (nodeid, name, countsbylevel) with their publication: the first non-empty title of the root.

    ``nodes``: publication_id, seq, nodeid, title, countsbylevel; a root has an empty node id.
    """
    roots = nodes.where((F.col("nodeid") == "") & X.filled(F.col("title"))).groupBy("publication_id").agg(X.strip(F.min_by("title", "seq")).alias("publication"))
    return nodes.where(F.length("nodeid") == 3).join(roots, "publication_id", "left").select("publication_id", "publication", "nodeid", F.col("title").alias("name"), "countsbylevel")


def select_titles(titles: DataFrame, wanted: str | None) -> DataFrame:
    """Titles whose name starts with ``wanted`` in any case; if none does, those that contain it."""
    if not wanted:
        return titles
    name, want = F.lower(F.coalesce("name", F.lit(""))), F.lit(wanted.lower())
    flagged = titles.withColumn("__starts", F.startswith(name, want)).where(F.contains(name, want))
    any_starts = flagged.agg(F.coalesce(F.max("__starts"), F.lit(False)).alias("__any"))  # one row
    return flagged.crossJoin(F.broadcast(any_starts)).where("__starts or not __any").drop("__starts", "__any")


def harvest_summary(titles: DataFrame, sections: DataFrame) -> DataFrame:
    """(nodeid, line): a title's id, name, number of sections and level, tab-separated."""
    counts = sections.groupBy(F.col("title_nodeid").alias("__title")).agg(F.count("*").alias("n"))
    joined = titles.join(counts, F.col("nodeid") == F.col("__title"), "left")
    n = F.coalesce("n", F.lit(0)).cast("string")
    line = F.concat_ws("\t", "nodeid", "name", F.concat(F.lit("sections="), n), F.concat(F.lit("level="), X.extract_to_level(F.col("countsbylevel")).cast("string")))
    return joined.select("nodeid", line.alias("line"))

