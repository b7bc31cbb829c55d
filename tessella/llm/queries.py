"""Queries of the training-data operators: pN_ is a query of problem N."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import canonical, format_copies, history, leakage, matching, mixing, splitting, survivors
from tessella.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.suppliers(table(spark, d, "papers"), table(spark, d, "archives"))


def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "papers"), table(spark, d, "archives"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_works(table(spark, d, "papers"), table(spark, d, "shelf_papers"), confidence=False)


def p3_matches(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_works(table(spark, d, "papers"), table(spark, d, "shelf_papers"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    index = history.build_index(table(spark, d, "seen_papers"))
    return history.check_batches(index, table(spark, d, "incoming_papers"), "batch_no")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversize_paragraphs(splitting.split_items(table(spark, d, "chunks"), table(spark, d, "chunk_limits")))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_items(table(spark, d, "chunks"), table(spark, d, "chunk_limits"))


def p5_checks(spark: SparkSession, d: str) -> DataFrame:
    items, limits = table(spark, d, "chunks"), table(spark, d, "chunk_limits")
    return splitting.piece_checks(splitting.split_items(items, limits), items, limits)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    papers = format_copies.format_copies(table(spark, d, "papers"), "paper_id", ["title"], ["authors"])
    seen = format_copies.format_copies(table(spark, d, "seen_papers"), "record_id", ["identity"])
    pairs = papers.withColumn("record_table", F.lit("papers")).unionByName(seen.withColumn("record_table", F.lit("seen_papers")))
    return pairs.where("copy_id <> kept_id").select("record_table", "kept_id", "copy_id")


def p6_collapsed(spark: SparkSession, d: str) -> DataFrame:
    sets = None
    for name, key, texts, names in (("papers", "paper_id", ["title"], ["authors"]), ("seen_papers", "record_id", ["identity"], [])):
        rows = table(spark, d, name)
        part = format_copies.collapse(rows, key, texts, names).unionByName(format_copies.keyless(rows, key, texts)).withColumn("record_table", F.lit(name))
        sets = part if sets is None else sets.unionByName(part)
    return sets.select("record_table", "kept_id", "copies")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).where("exact_windows > 0").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    return leakage.reparameterised(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.look_alike_pairs(table(spark, d, "documents"), "doc_id", "text").select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return canonical.look_alike_classes(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p9_canonical(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", canonical.canonical_text(F.col("text")).alias("canonical"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit() and callable(f)}
