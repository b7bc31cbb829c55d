"""Incremental index of files by content hash with history: classify, apply, purge.

Index rows are (path, sha, active), one per version; the present state is (path, sha). Null paths or hashes take no
part. A path comes out in exactly one class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(index: DataFrame, now: DataFrame) -> DataFrame:
    """(path, old_sha, new_sha, class): new, deleted, unchanged, reactivate or modified."""
    known = index.where("path is not null and sha is not null").groupBy("path").agg(F.max(F.when(F.col("active"), F.col("sha"))).alias("old_sha"), F.collect_set("sha").alias("__all"))
    state = now.where("path is not null and sha is not null").groupBy("path").agg(F.max("sha").alias("new_sha"))
    kind = (
        F.when(F.col("__all").isNull(), "new").when(F.col("new_sha").isNull(), F.when(F.col("old_sha").isNotNull(), "deleted").otherwise("gone"))
        .when(F.col("new_sha") == F.col("old_sha"), "unchanged").when(F.array_contains("__all", F.col("new_sha")), "reactivate").otherwise("modified")
    )
    return known.join(state, "path", "full_outer").select("path", "old_sha", "new_sha", kind.alias("class")).where("class <> 'gone'")


def apply(index: DataFrame, now: DataFrame) -> DataFrame:
    """The index after the sync: versions of all times, those of the present state active."""
    state = now.where("path is not null and sha is not null").groupBy("path").agg(F.max("sha").alias("sha"))
    return index.select("path", "sha").unionByName(state.select("path", "sha")).distinct().join(state.withColumn("active", F.lit(True)), ["path", "sha"], "left").select("path", "sha", F.coalesce("active", F.lit(False)).alias("active"))


def purge(index: DataFrame) -> DataFrame:
    """The active versions only; files without one are dropped."""
    return index.where("active")
