"""Readers of seeds, pages and finished records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import RECORD


def seed_columns(lines: DataFrame) -> DataFrame:
    """(title, url, volume) of lines ``Title | URL | Volume`` in ``value``; blank lines and comments go.

    A line of one field is a url, titled ``Untitled``; fields past the third are ignored.
    """
    line = X.strip(F.col("value"))
    rows = lines.select(line.alias("line")).where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    parts = F.transform(F.split("line", r"\|"), X.strip)
    one = F.size("parts") == 1
    return rows.select(parts.alias("parts")).select(
        F.when(one, "Untitled").otherwise(F.get("parts", F.lit(0))).alias("title"), F.when(one, F.get("parts", F.lit(0))).otherwise(F.get("parts", F.lit(1))).alias("url"), F.get("parts", F.lit(2)).alias("volume")
    )


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    return seed_columns(spark.read.text(path))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured documents (url, html) and whatever else the table holds."""
    return spark.read.parquet(path)


def done_records(manifest: DataFrame) -> DataFrame:
    """The records of done rows; rows whose record isn't JSON are left out."""
    rows = manifest.where("status = 'done' and record is not null").where(F.try_parse_json("record").isNotNull())
    return rows.select("section_key", F.from_json("record", RECORD).alias("r")).select("section_key", "r.*")


def undecodable_records(manifest: DataFrame) -> DataFrame:
    """One row: how many done records aren't JSON."""
    return manifest.where("status = 'done' and record is not null").agg(F.count_if(F.try_parse_json("record").isNull()).alias("n"))
