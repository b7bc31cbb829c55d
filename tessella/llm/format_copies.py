"""Records that differ in nothing but formatting: one row each, with the number of copies.

Method: every column is dictionary-encoded. Each distinct value is canonicalised once (letter case folded, white
space, punctuation and other signs removed; lists of names: set of names, each the sorted parts of the name) and
gets an integer; a record becomes the sorted array of its (field, value) integers; the compact arrays are grouped.

Integers are assigned without a driver and without chance of collision: values are spread over hash buckets, and
within its bucket a value's number is its rank, so a recomputed task finds the same numbers.

Null in a text field: the record has no copies (nothing is known to be equal). Null and empty name lists are
equal, as are name lists of signs only. Texts of signs only are equal to each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import durable

BUCKETS = 1024
_SIGNS = r"[^\p{L}\p{N}\p{M}]+"


def folded(text: Column) -> Column:
    """Letters, digits and accents of a text, whatever their case (so that a sharp s equals its capitals)."""
    return F.regexp_replace(F.lower(F.upper(text)), _SIGNS, "")


def folded_name(name: Column) -> Column:
    """The sorted parts of a personal name; blanks, commas and stops end a part, other signs are dropped."""
    parts = F.transform(F.split(F.lower(F.upper(name)), r"[\s\p{Z}\p{Cf},.;]+"), lambda p: F.regexp_replace(p, _SIGNS, ""))
    return F.array_join(F.array_sort(F.filter(parts, lambda p: p != "")), " ")


def _encode(values: DataFrame) -> DataFrame:
    """(raw, canonical) of the distinct values -> (raw, code)."""
    canonical = values.groupBy("canonical").agg(F.lit(1).alias("one")).withColumn("bucket", F.pmod(F.xxhash64("canonical"), F.lit(BUCKETS)))
    ranked = canonical.withColumn("code", F.col("bucket") * F.lit(1 << 40) + F.row_number().over(Window.partitionBy("bucket").orderBy("canonical")))
    return values.join(ranked.select("canonical", "code"), "canonical").select("raw", "code")


def compact_records(df: DataFrame, id_col: str, texts: list[str], names: list[str] = ()) -> DataFrame:
    """(id, key): each record's sorted array of field-value integers. Records with a null text are left out."""
    rows = df.select(F.col(id_col).alias("__id"), *[F.col(c).alias(f"__t{i}") for i, c in enumerate(texts)], *[F.col(c).alias(f"__n{i}") for i, c in enumerate(names)])
    for i in range(len(texts)):
        column = f"__t{i}"
        rows = rows.where(F.col(column).isNotNull())
        values = rows.select(F.col(column).alias("raw")).distinct().withColumn("canonical", folded(F.col("raw")))
        rows = rows.join(_encode(values).withColumnRenamed("raw", column), column).withColumnRenamed("code", f"__c{i}").drop(column)
    codes = [F.array(F.struct(F.lit(i).alias("f"), F.col(f"__c{i}").alias("v"))) for i in range(len(texts))]
    kept = rows.select("__id", *[f"__n{i}" for i in range(len(names))], F.concat(*codes).alias("__key"))
    for i in range(len(names)):
        column, f = f"__n{i}", len(texts) + i
        values = kept.select(F.col(column).alias("raw")).where("raw is not null").distinct()
        each = values.select("raw", F.explode("raw").alias("part")).where("part is not null")
        parts = each.select(F.col("part").alias("raw")).distinct().withColumn("canonical", folded_name(F.col("raw"))).where("canonical <> ''")
        coded = each.join(_encode(parts).withColumnRenamed("raw", "part"), "part").groupBy("raw").agg(F.collect_set("code").alias("__codes"))
        kept = kept.join(coded.withColumnRenamed("raw", column), column, "left").select(
            "__id", *[f"__n{j}" for j in range(i + 1, len(names))],
            F.concat("__key", F.transform(F.coalesce(F.col("__codes"), F.array().cast("array<bigint>")), lambda v, f=f: F.struct(F.lit(f).alias("f"), v.alias("v")))).alias("__key"),
        )
    return kept.select(F.col("__id").alias("id"), F.array_sort("__key").alias("key"))


def format_copies(df: DataFrame, id_col: str, texts: list[str], names: list[str] = ()) -> DataFrame:
    """(copy_id, kept_id, copies): each record that has copies, with the smallest id and the size of its set.

    The groups are made by partial aggregation, so a set that holds a third of all rows is reduced before the
    shuffle; the join that hands its id back streams the records, and adaptive execution splits a hot set there.
    """
    compact = durable(compact_records(df, id_col, texts, names))
    sets = compact.groupBy("key").agg(F.min("id").alias("kept_id"), F.count("*").alias("copies")).where("copies > 1")
    return compact.join(sets, "key").select(F.col("id").alias("copy_id"), "kept_id", "copies")


def collapse(df: DataFrame, id_col: str, texts: list[str], names: list[str] = ()) -> DataFrame:
    """(kept_id, copies): one row per set of records that differ in formatting only, single records included."""
    compact = compact_records(df, id_col, texts, names)
    return compact.groupBy("key").agg(F.min("id").alias("kept_id"), F.count("*").alias("copies")).select("kept_id", "copies")


def keyless(df: DataFrame, id_col: str, texts: list[str]) -> DataFrame:
    """(kept_id, copies): the records with a null text, which ``collapse`` leaves out; each is a set of its own."""
    some = F.lit(False)
    for c in texts:
        some = some | F.col(c).isNull()
    return df.where(some).select(F.col(id_col).alias("kept_id"), F.lit(1).cast("bigint").alias("copies"))
