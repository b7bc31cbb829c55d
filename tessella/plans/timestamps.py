"""Queries of the timestamp operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.timestamps import normalise_timestamps, zone_tables
from tessella.sources.tables import table


def _rows(spark: SparkSession, d: str) -> DataFrame:
    archives, searches = table(spark, d, "archives"), table(spark, d, "searches")
    papers = table(spark, d, "papers").select("paper_id", "source", "published_date")
    seen = table(spark, d, "seen_papers").select("record_id", "search_name", "first_seen")
    zones = zone_tables(archives, searches, texts={"published_date": papers, "first_seen": seen})
    a = normalise_timestamps(papers, "published_date", archives, "source", zones, version="zone_data").withColumnRenamed("paper_id", "record_id")
    b = normalise_timestamps(seen, "first_seen", searches, "search_name", zones, version="zone_data")
    return reduce(DataFrame.unionByName, [r.select(F.lit(n).alias("record_table"), "record_id", "utc_micros", "zone_data") for n, r in (("papers", a), ("seen_papers", b))])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).where("utc_micros is not null").drop("zone_data")


def p1_versions(spark: SparkSession, d: str) -> DataFrame:
    """How many values were read under which version of the zone data, and how many denote no time."""
    return _rows(spark, d).groupBy("record_table", "zone_data").agg(F.count("utc_micros").alias("read"), F.count_if(F.col("utc_micros").isNull()).alias("no_time"))


QUERIES = {"p1_found": p1_found, "p1_versions": p1_versions}
SQL: dict[str, str] = {}
