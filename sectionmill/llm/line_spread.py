"""Line dedup by distinct-site spread, in DataFrame operations only.

Each line's hash collects a HyperLogLog sketch of the sites it stands on; sketches merge by
aggregation. Lines whose estimate lies within ``BAND`` of the threshold get an exact distinct
count. A line on at least ``min_sites`` sites is boilerplate: all its places go but the first
(least id, then least place), so that a page copied to many sites keeps one whole copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import content_key, fresh, materialise

MIN_SITES, MIN_CHARS, BAND, LOG_K = 10, 12, 0.25, 12
_PLACE = ["nameless", "id", "k1", "k2", "place"]


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_chars: int) -> DataFrame:
    """One row per line that is long enough. A document is known by two hashes of its id, text and site,
    so texts that share an id are told apart and only rows equal in all three count as one."""
    k1, k2 = content_key(F.col(id_col), F.col(text_col), F.col(site_col))
    line = F.trim(F.col("line"), F.lit(" \t\r"))
    return (
        docs.select(F.col(id_col).isNull().alias("nameless"), F.col(id_col).alias("id"), k1.alias("k1"), k2.alias("k2"), F.col(site_col).alias("site"), F.posexplode(F.split(text_col, "\n")).alias("place", "line"))
        .select("nameless", "id", "k1", "k2", "site", "place", line.alias("line"))
        .where(F.length("line") >= min_chars)
        .select("nameless", "id", "k1", "k2", "site", "place", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))
    )


def boilerplate_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", *, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS
) -> DataFrame:
    """Boilerplate lines as (h1, h2, first): two hashes of the line and its first place."""
    lines = _lines(docs, id_col, text_col, site_col, min_chars)
    wide = materialise(
        lines.groupBy("h1", "h2")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_K))).alias("sites"), F.min(F.struct(*_PLACE)).alias("first"))
        .where(F.col("sites") >= min_sites * (1 - BAND)),
        "wide-lines",
    )
    unsure = F.col("sites") <= min_sites * (1 + BAND)
    near = wide.where(unsure)
    counted = lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().where("site is not null")
    exact = counted.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("h1", "h2")
    return wide.where(~unsure).select("h1", "h2", "first").union(near.join(exact, ["h1", "h2"], "left_semi").select("h1", "h2", "first"))


def remove_boilerplate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", *, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS
) -> DataFrame:
    """``docs`` with the boilerplate lines taken out of ``text_col``, and with ``n_lines`` and
    ``n_removed`` (columns of these names are replaced; all others pass through, whatever their names).

    Lines are compared without blanks at their ends; shorter ones than ``min_chars`` stay. Ids may be
    null, of any type, and repeated: each row is cleaned by its own text, and of places that tie for the first the
    one of the least hash stays. Rows equal in id, text and site are treated alike and count as one document. A null
    site is no site. A null text has 0 lines and stays null; an empty one has one line and
    stays empty. A very long text is cut into lines by the task that holds its row.
    """
    docs = docs.drop("n_lines", "n_removed")
    found = materialise(boilerplate_lines(docs, id_col, text_col, site_col, min_sites=min_sites, min_chars=min_chars), "boilerplate")
    one, two, gone = (fresh(docs, n) for n in ("row_one", "row_two", "gone"))
    hits = (
        _lines(docs, id_col, text_col, site_col, min_chars)
        .join(found, ["h1", "h2"])
        .where("not (k1 = first.k1 and k2 = first.k2 and place = first.place)")
        .groupBy(F.col("k1").alias(one), F.col("k2").alias(two))
        .agg(F.collect_set("place").alias(gone))
    )
    k1, k2 = content_key(F.col(id_col), F.col(text_col), F.col(site_col))
    lines = F.split(text_col, "\n")
    left = lambda cut: F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col(gone))
    # The text is cut once, as the one element of an array, and not once for each line that stays.
    text = F.get(F.transform(F.array(lines), lambda cut: F.array_join(F.transform(left(cut), lambda i: F.get(cut, i)), "\n")), F.lit(0))
    joined = docs.withColumns({one: k1, two: k2}).join(hits, [one, two], "left")
    return joined.select(
        *[F.when(F.col(gone).isNull(), F.col(c)).otherwise(text).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
    )


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, source, place, trim(split[place + 1], ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS split, unnest(range(len(string_split(text, chr(10))))) AS place
        FROM documents WHERE text IS NOT NULL)
), spread AS (
  SELECT line, min({{'id': doc_id, 'place': place}}) AS first FROM lines WHERE length(line) >= {MIN_CHARS}
  GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), gone AS (
  SELECT doc_id, list(place) AS gone FROM lines JOIN spread USING (line)
  WHERE NOT (doc_id = first.id AND place = first.place) GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string(
    list_transform(list_filter(range(len(string_split(text, chr(10)))), lambda i: NOT list_contains(gone, i)),
                   lambda i: string_split(text, chr(10))[i + 1]), chr(10)) END AS text
FROM documents LEFT JOIN gone USING (doc_id)
"""
