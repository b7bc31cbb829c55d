"""Aggregations and per-group choices. Ties are settled by the order column given, so results are repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each group in the order given, by aggregation (no sort of the group)."""
    rest = [c for c in df.columns if c not in keys]
    exprs = [F.col(o) if isinstance(o, str) else o for o in order]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[e.alias(f"o{i}") for i, e in enumerate(exprs)])).alias("r")).select(*keys, "r.*")


def ordered_distinct(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Per key the distinct values in the order in which they were first seen."""
    first = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("o"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", value))), lambda x: x[value]).alias("items"))


def prefix_rollup(df: DataFrame, path: str, size: str, depth: int) -> DataFrame:
    """Sizes summed by the first ``depth`` components of the path."""
    head = F.array_join(F.slice(F.split(path, "/"), 1, depth), "/")
    return df.groupBy(head.alias("prefix")).agg(F.sum(size).alias("bytes"), F.count("*").alias("files"))


def exact_duplicates(df: DataFrame, id_col: str, size: str, digest: Column) -> DataFrame:
    """(id, keeper): rows with the same size and digest as an earlier row; sizes are compared before anything is hashed."""
    shared = df.where(F.col(size) > 0).groupBy(size).agg(F.count("*").alias("n")).where("n > 1").select(size)
    hashed = df.join(shared, size, "left_semi").select(F.col(id_col).alias("id"), size, digest.alias("digest"))
    keep = hashed.groupBy(size, "digest").agg(F.min("id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    return hashed.join(keep, [size, "digest"]).where("id <> keeper").select("id", "keeper", size)


def null_if_any_null(c: str) -> Column:
    return F.when(F.count_if(F.col(c).isNull()) == 0, F.sum(c))


def constant_columns(df: DataFrame, columns: list[str], keep: str = "PASSED") -> DataFrame:
    """(column, distinct, dropped): columns with one value, unless that value is ``keep``, in one pass over the data."""
    lo, hi = [F.min(F.col(c).cast("string")).alias(f"lo_{c}") for c in columns], [F.max(F.col(c).cast("string")).alias(f"hi_{c}") for c in columns]
    one = df.agg(*lo, *hi)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), (F.col(f"lo_{c}").eqNullSafe(F.col(f"hi_{c}"))).alias("constant"), F.col(f"lo_{c}").alias("value")) for c in columns]))
    return one.select(cells.alias("x")).select("x.name", "x.constant", (F.col("x.constant") & F.coalesce(F.col("x.value") != keep, F.lit(True))).alias("dropped"))


def islands(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Add ``island``: runs of intervals that touch or overlap, numbered per group in order of their start."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def stitched(pieces: Column) -> Column:
    """One text from pieces (start, end, bytes) sorted by start, each adding only what lies beyond the end so far."""
    zero = F.struct(F.lit(-1).cast("bigint").alias("reach"), F.unhex(F.lit("")).alias("text"))
    grown = F.aggregate(
        pieces, zero,
        lambda a, p: F.when((a["reach"] >= 0) & (p["end"] <= a["reach"]), a).otherwise(
            F.struct(p["end"].cast("bigint").alias("reach"), F.concat(a["text"], F.when(a["reach"] < 0, p["bytes"]).otherwise(F.substring(p["bytes"], (a["reach"] - p["start"] + 1).cast("int"), F.length(p["bytes"])))).alias("text"))),
    )
    return F.decode(grown["text"], "utf-8")


def aliases(df: DataFrame, digest: str, name: str, order: str) -> DataFrame:
    """(digest, names, first): the distinct names that share a digest; rows without one stay apart."""
    own = F.when(F.col(digest).isNull(), F.col(order))
    grouped = df.groupBy(digest, own.alias("__own")).agg(F.array_join(F.array_sort(F.collect_set(name)), "|").alias("names"), F.min(order).alias("first"))
    return grouped.select(digest, "names", "first")
