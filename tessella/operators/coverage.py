"""Coverage facts (file, line, hits, br_taken, br_total): merge of reports, changed lines, per-file and total figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.joins import covered_lines


def merge(reports: DataFrame) -> DataFrame:
    """One row per file and line of several reports (ord): most hits; a partial branch only if the file's newest
    report has it and no earlier report has the line whole."""
    newest = reports.groupBy("file").agg(F.max("ord").alias("newest"))
    partial = (F.col("br_taken") > 0) & (F.col("br_taken") < F.col("br_total"))
    last = F.max(F.when(partial & (F.col("ord") == F.col("newest")), F.struct("ord", "br_taken", "br_total")))
    whole_before = F.bool_or((F.col("ord") < F.col("newest")) & ~F.coalesce(partial, F.lit(False)))
    merged = reports.join(newest, "file").groupBy("file", "line").agg(F.max("hits").alias("hits"), last.alias("p"), whole_before.alias("w"))
    return merged.select("file", "line", "hits", F.when(~F.col("w"), F.col("p.br_taken")).alias("br_taken"), F.when(~F.col("w"), F.col("p.br_total")).alias("br_total"))


def percent(total: Column, miss: Column, partial: Column, taken: Column, possible: Column) -> Column:
    """Whole percent, 99 rather than 100 while anything is missed, 1 rather than 0 once anything is hit."""
    credit = F.coalesce(F.try_divide(partial * taken, possible), F.lit(0.0))
    raw = F.floor(100.0 * (total - miss - partial + credit) / total).cast("int")
    return F.when((raw == 100) & ((miss > 0) | (partial > 0)), 99).when((raw == 0) & (miss != total), 1).otherwise(raw)


def report(facts: DataFrame, by: list[str]) -> DataFrame:
    """Figures per group of columns (none: the grand total)."""
    partial = F.col("br_taken").isNotNull()
    g = (facts.groupBy(*by) if by else facts).agg(F.count("*").alias("total"), F.count_if(F.col("hits") <= 0).alias("miss"), F.count_if(partial).alias("partial"), F.coalesce(F.sum("br_taken"), F.lit(0)).alias("taken"), F.coalesce(F.sum("br_total"), F.lit(0)).alias("possible"))
    return g.withColumn("percent", percent(*[F.col(c) for c in ("total", "miss", "partial", "taken", "possible")]))


def diff_lines(text_lines: DataFrame) -> DataFrame:
    """(file, line) added by a unified diff without context, given as (diff, no, text): the file header is carried
    forward to the hunks below it, a hunk ``+a,b`` stands for b lines from a (none if b is 0)."""
    w = Window.partitionBy("diff").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("text").startswith("+++ b/"), F.trim(F.substring("text", 7, 1000)))
    hunk = r"^@@ -\S+ \+(\d+)(?:,(\d+))?"
    filled = text_lines.withColumn("file", F.last(head, ignorenulls=True).over(w)).where(F.col("text").rlike(hunk) & F.col("file").isNotNull())
    start, n = F.regexp_extract("text", hunk, 1).cast("int"), F.coalesce(F.nullif(F.regexp_extract("text", hunk, 2), F.lit("")).cast("int"), F.lit(1))
    return filled.where(n > 0).select("file", F.explode(F.sequence(start, start + n - 1)).alias("line")).distinct()


def changed(facts: DataFrame, lines: DataFrame, full: bool = False) -> DataFrame:
    """The facts of statements with a changed line before the next one; ``full``: of all lines of the files touched."""
    return facts.join(lines.select("file").distinct(), "file", "left_semi") if full else covered_lines(facts, lines)
