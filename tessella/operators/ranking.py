"""Scores, composite ranks, dominance between evaluated entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREPRINT_ARCHIVES = ["arxiv", "biorxiv", "medrxiv", "chemrxiv"]


def paper_score(today: str) -> Column:
    """Weighted score of a federated record: relevance, citations, access, review, recency (six digits)."""
    cited = F.when(F.col("citation_count") > 0, F.least(F.lit(1.0), F.log1p(F.col("citation_count")) / F.log1p(F.lit(1000)))).otherwise(0.0)
    access = F.when(F.col("is_open_access"), 1.0).otherwise(0.2)
    review = F.when(F.col("is_peer_reviewed"), 1.0).when(F.col("source").isin(PREPRINT_ARCHIVES), 0.5).otherwise(0.0)
    day = F.when(F.col("published_date").rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.left("published_date", F.lit(10)), "yyyy-MM-dd"))
    recent = F.coalesce(F.greatest(F.lit(0.0), 1 - F.datediff(F.lit(today).cast("date"), day) / 365.0), F.lit(0.0))
    return F.round(0.35 * F.coalesce("relevance_score", F.lit(0.0)) + 0.20 * cited + 0.25 * access + 0.15 * review + 0.05 * recent, 6)


def identity(doi: Column, title: Column) -> Column:
    return F.when(doi.isNotNull() & (doi != ""), F.concat(F.lit("doi:"), doi)).otherwise(F.concat(F.lit("title:"), F.sha2(F.lower(F.trim(title)), 256)))


def composite_rank(results: DataFrame) -> DataFrame:
    """(entity, vector, place) of results (entity, test, category, score, duration), base tests being in no category.

    Entities are ranked by passes, time of passes, scores and time, over all tests and in each category in which
    they pass something; the vector of ranks decides. There are as many rows as entities.
    """
    total = lambda c: F.round(F.sum(c), 6)
    passed = F.col("score") == 1.0
    stats = [F.count_if(passed).alias("passed"), total(F.when(passed, F.col("duration")).otherwise(0.0)).alias("ptime"), total("score").alias("points"), total("duration").alias("time")]
    order = [F.desc("passed"), F.asc("ptime"), F.desc("points"), F.asc("time"), F.asc("entity")]
    overall = results.groupBy("entity").agg(*stats).withColumn("overall", F.row_number().over(Window.orderBy(*order)) - 1).select("entity", "overall")
    n = overall.agg(F.count("*").alias("n"))
    cats = results.where("category <> 'base'").select("category").distinct()
    ranks = results.where("category <> 'base'").groupBy("entity", "category").agg(*stats).withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy(*order)) - 1).where("passed > 0").select("entity", "category", "r")
    grid = overall.join(F.broadcast(n)).join(F.broadcast(cats)).join(ranks, ["entity", "category"], "left")
    vectors = grid.groupBy("entity", "overall").agg(F.collect_list(F.coalesce("r", F.col("n").cast("int")) * 2 + 1).alias("c"))
    full = overall.join(vectors.select("entity", "c"), "entity", "left").withColumn("c", F.coalesce("c", F.array().cast("array<int>")))
    vector = F.concat(F.array_sort(F.concat(F.array("overall"), "c")), F.array("overall"))
    return full.select("entity", vector.alias("vector")).withColumn("place", F.row_number().over(Window.orderBy("vector", "entity")))


def covered_by(results: DataFrame) -> DataFrame:
    """(entity, by): the first other entity that passes all that one passes, is nowhere lower in points unless it
    passes more, and is not over half slower (a second at least) where one passes. ``results``: entity, test, score,
    duration. Pairs meet on the tests that both have; entities are the few things compared, not rows of data.
    """
    a = results.select(F.col("entity").alias("a"), "test", F.col("score").alias("sa"), F.col("duration").alias("ta"))
    b = results.select(F.col("entity").alias("b"), "test", F.col("score").alias("sb"), F.col("duration").alias("tb"))
    own = a.groupBy("a").agg(F.count("*").alias("n"))
    p = a.join(b, "test").where("a <> b").groupBy("a", "b").agg(
        F.count("*").alias("both"), F.bool_or((F.col("sa") == 1) & (F.col("sb") != 1)).alias("fails"), F.bool_or((F.col("sa") != 1) & (F.col("sb") == 1)).alias("better"),
        F.bool_or(F.col("sa") > F.col("sb")).alias("lower"), F.bool_or((F.col("sa") == 1) & (F.greatest(F.lit(1.0), F.col("ta")) * 1.5 < F.col("tb"))).alias("slow"),
    )
    good = p.join(own, "a").where("both = n and not fails and (better or not lower) and not slow")
    return own.select("a").join(good.groupBy("a").agg(F.min("b").alias("by")), "a", "left").select(F.col("a").alias("entity"), F.coalesce("by", F.lit("")).alias("by"))
