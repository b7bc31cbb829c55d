"""Mixing sources to target weights by systematic sampling.

Method: with weights w, sizes A (tokens) and caps r, a source's documents are expected e = w T / A times each; the
expected copies are summed in a fixed order within the source, one random offset is added, and a document is
emitted once for every integer boundary its stretch crosses. So a document comes floor(e) or ceil(e) times, never
more than the cap, and the source's total is its target but for rounding. The order goes by length, then by a
hash, so that the documents chosen are as long as the source's documents on the whole.

The prefix sum is taken in two steps, over counts of small cells and within each cell, so neither a source that
holds a third of all rows nor one length shared by many documents ends in one task.

Total: without ``total_tokens`` the largest T at which every source with documents reaches its weight within its
cap. A larger T leaves the capped sources short; the shares actually reached are reported either way. Documents
with a null text have no tokens and take no part; empty texts neither. Listed sources without documents share
nothing out: the weights of the others are scaled to sum to 1. Documents of unlisted or null sources stay out.
"""

from __future__ import annotations

import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessella.session import durable

TOKENIZER_FILE = os.environ.get("TESSELLA_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pre-tokenisation pattern that belongs to the byte-level vocabulary.
TOKENIZER_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CELLS = 256


@lru_cache(maxsize=4)
def _encoding(path: str):  # noqa: ANN202
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=TOKENIZER_PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(path: str = TOKENIZER_FILE):  # noqa: ANN201
    """A column function: tokens of a text under the byte-level vocabulary in ``path`` (a file every worker can read)."""

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(path).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count


def token_sizes(documents: DataFrame, path: str = TOKENIZER_FILE) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents that have tokens."""
    docs = documents.select("doc_id", "source", "text").where("text is not null and text <> ''")
    return docs.select("doc_id", "source", count_tokens(path)(F.col("text")).alias("n_tokens"))


def plan_mix(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """One row per target source: what it has, what it should give, and how often each document is expected."""
    goals = targets.groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats")).where("source is not null and weight > 0")
    have = sizes.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("available"))
    joined = goals.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    live = F.when(F.col("available") > 0, F.col("weight")).otherwise(0.0)
    whole = Window.partitionBy(F.lit(0))  # over the targets, one row per source
    scaled = joined.withColumn("share", F.try_divide(live, F.sum(live).over(whole)))
    reach = F.min(F.when(F.col("share") > 0, F.col("max_repeats") * F.col("available") / F.col("share"))).over(whole)
    total = F.lit(float(total_tokens)) if total_tokens else reach
    return scaled.withColumn("total", total).withColumn("expected", F.when(F.col("share") > 0, F.least(F.col("max_repeats").cast("double"), F.col("share") * F.col("total") / F.col("available"))).otherwise(0.0))


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7, total_tokens: float | None = None, path: str = TOKENIZER_FILE) -> tuple[DataFrame, DataFrame]:
    """(chosen documents with their number of copies, report of the shares per target source)."""
    sizes = durable(token_sizes(documents, path))
    plan = plan_mix(sizes, targets, total_tokens)
    cell = sizes.select("doc_id", "source", "n_tokens", F.floor(F.log2(F.col("n_tokens") + 1) * 64).alias("length"), F.xxhash64("doc_id", F.lit(seed)).alias("order")).withColumn("cell", F.pmod("order", F.lit(_CELLS)))
    cells = cell.groupBy("source", "length", "cell").agg(F.count("*").alias("n"))
    before = cells.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("length", "cell").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    wanted = plan.where("expected > 0").select("source", "expected", "max_repeats", (F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 32)) / F.lit(float(1 << 32))).alias("offset"))
    within = F.row_number().over(Window.partitionBy("source", "length", "cell").orderBy("order", "doc_id"))
    placed = cell.withColumn("within", within).join(before.join(wanted, "source"), ["source", "length", "cell"])
    rank = F.coalesce("before", F.lit(0)) + F.col("within")
    crossed = F.floor(rank * F.col("expected") + F.col("offset")) - F.floor((rank - 1) * F.col("expected") + F.col("offset"))
    chosen = placed.withColumn("copies", F.least(crossed.cast("int"), F.col("max_repeats"))).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")
    given = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("given"), F.count("*").alias("used"), F.max("copies").alias("most_copies"))
    report = plan.join(given, "source", "left").select(
        "source", F.col("weight").alias("target_share"), F.col("share").alias("scaled_share"), "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.col("available").alias("available_tokens"),
        F.coalesce("used", F.lit(0)).alias("used_documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("given", F.lit(0)).alias("given_tokens"),
        F.try_divide(F.coalesce("given", F.lit(0)), F.sum("given").over(Window.partitionBy(F.lit(0)))).alias("actual_share"),
    )
    return chosen, report
