"""Lexical and vector retrieval, adaptive cut-offs, rank fusion.

Documents with null text have no tokens; queries without known tokens find nothing. Scores that are zero or less
are dropped. Ties go to the smaller document id.

``bm25`` and ``nearest`` answer one query. ``bm25_each`` and ``nearest_each`` answer a table of queries against all
rows: the queries are written as a table, each task reads it in blocks of BLOCK queries, multiplies them with its rows
and keeps the best k of each query, so neither side is broadcast and no pair of row and query is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.session import durable, scratch_path

K1, B, EPSILON, FUSION = 1.5, 0.75, 0.25, 60
BLOCK, CELLS = 128, 4_000_000  # queries read at once; numbers in one dense block of rows


def tokens(text: Column) -> Column:
    """Lower-case runs without white space."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: t != "")


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, term, tf, length): one row per document and term."""
    listed = docs.select(F.col(doc_id).alias("doc"), tokens(F.col(text)).alias("t")).where("size(t) > 0")
    return listed.select("doc", F.size("t").alias("length"), F.explode("t").alias("term")).groupBy("doc", "length", "term").agg(F.count("*").alias("tf"))


def term_stats(posted: DataFrame, n_docs: Column) -> DataFrame:
    """(term, df, idf): negative idf becomes a share of the mean idf over the vocabulary."""
    df = posted.groupBy("term").agg(F.count("*").alias("df")).withColumn("raw", F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.agg(F.avg("raw").alias("mean"))
    return df.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25(docs: DataFrame, doc_id: str, text: str, query: list[str]) -> DataFrame:
    """(doc, score) of all documents with a positive score; repeated query tokens count repeatedly.

    The corpus statistics are one row, and the query's terms as many rows as the query has: both are bounded.
    """
    spark = docs.sparkSession
    posted = postings(docs, doc_id, text)
    sizes = posted.groupBy("doc").agg(F.max("length").alias("length")).agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))
    asked = spark.createDataFrame([(t,) for t in query], "term string").groupBy("term").agg(F.count("*").alias("times"))
    df = posted.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(sizes)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.agg(F.avg("raw").alias("mean"))
    idf = df.join(F.broadcast(asked), "term").join(F.broadcast(mean)).select("term", "times", "mean_length", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    return posted.join(F.broadcast(idf), "term").groupBy("doc").agg(F.sum(part).alias("score")).where("score > 0")


@dataclass
class Postings:
    """A lexical index as tables in the shared folder: postings in folders by the term's hash, and one row per term.

    A search reads the folders of its own terms and the lengths' two figures, not the texts.
    """

    spark: SparkSession
    path: str
    buckets: int

    @staticmethod
    def build(docs: DataFrame, doc_id: str, text: str, path: str | None = None, buckets: int = 16) -> Postings:
        out = Postings(docs.sparkSession, path or scratch_path(docs.sparkSession, "postings"), buckets)
        posted = durable(postings(docs, doc_id, text), "posted")
        sizes = posted.groupBy("doc").agg(F.max("length").alias("length")).agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))
        df = posted.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(sizes)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        mean = df.agg(F.avg("raw").alias("mean"))
        idf = df.join(F.broadcast(mean)).select("term", "mean_length", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
        for name, rows in (("postings", posted), ("terms", idf)):
            rows.withColumn("bucket", out._bucket(F.col("term"))).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{out.path}/{name}")
        return out

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def search(self, query: list[str]) -> DataFrame:
        """(doc, score) of all documents with a positive score; repeated query tokens count repeatedly."""
        asked = self.spark.createDataFrame([(t,) for t in query], "term string").groupBy("term").agg(F.count("*").alias("times"))
        there = [r[0] for r in asked.select(self._bucket(F.col("term"))).distinct().collect()]  # a query's terms
        read = lambda name, schema: self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/{name}").where(F.col("bucket").isin(there)).drop("bucket")
        weights = read("terms", "term string, mean_length double, idf double").join(F.broadcast(asked), "term")
        part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
        hits = read("postings", "doc bigint, length int, term string, tf bigint").join(F.broadcast(weights), "term")
        return hits.groupBy("doc").agg(F.sum(part).alias("score")).where("score > 0")


def k_bounds(wanted: Column, total: Column) -> tuple[Column, Column]:
    """Least and most results to choose from: half and double of what is wanted, within what there is."""
    return F.least(F.greatest(F.lit(1), F.floor(wanted / 2)), total).cast("int"), F.least(wanted * 2, total).cast("int")


def score_distance(score: Column) -> Column:
    """A lexical score as a distance."""
    return 1.0 / (1.0 + score)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, id_col: str, vector: str, query_id: int) -> DataFrame:
    """(id, distance) of all other vectors to one; the query is one row."""
    q = vectors.where(F.col(id_col) == query_id).select(F.col(vector).alias("__q"))
    return vectors.where(F.col(id_col) != query_id).join(F.broadcast(q.limit(1))).select(F.col(id_col).alias("id"), squared_distance(F.col(vector), F.col("__q")).alias("distance"))


def _blocks(path: str) -> Iterator[dict]:
    """The written queries, BLOCK at a time, as columns."""
    import pyarrow.dataset as ds

    for batch in ds.dataset(path, format="parquet").to_batches(batch_size=BLOCK):
        if batch.num_rows:
            yield batch.to_pydict()


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """The values of many lists, and the list that each is from."""
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    return np.concatenate([np.asarray(x) for x in lists]), np.repeat(np.arange(len(lists)), sizes)


def _best(cost: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least costs, ties by id; infinite costs never."""
    at = np.flatnonzero(np.isfinite(cost))
    if len(at) > k:
        at = at[cost[at] <= np.partition(cost[at], k - 1)[k - 1]]
    return at[np.lexsort((ids[at], cost[at]))][:k]


def top_each(df: DataFrame, k: int, by: list[str], *order: Column) -> DataFrame:
    """The first k rows of each group with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def bm25_each(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc, score, rank): the best k documents of each query of (query_id, text); scores have 9 decimals."""
    posted = postings(docs, doc_id, text)
    sizes = posted.groupBy("doc").agg(F.max("length").alias("length")).agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))
    df = posted.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(sizes)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.agg(F.avg("raw").alias("mean"))
    idf = df.join(F.broadcast(mean)).select("term", "mean_length", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    known = durable(idf.withColumn("no", F.monotonically_increasing_id()), "vocabulary")
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    of = lambda rows, value: rows.groupBy("doc").agg(F.collect_list(F.struct("no", value.cast("double").alias("w"))).alias("t")).select("doc", F.col("t.no").alias("no"), F.col("t.w").alias("w"))
    path = scratch_path(docs.sparkSession, "queries")
    of(postings(queries, "query_id", "text").join(known, "term"), F.col("tf")).write.parquet(path)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            ids, (no, row), w = batch["doc"].to_numpy(), _flat(list(batch["no"])), _flat(list(batch["w"]))[0]
            for q in _blocks(path):
                asked, column = _flat(q["no"])
                words, at = np.unique(asked, return_inverse=True)
                matrix = np.zeros((len(words), len(q["doc"])))
                matrix[at, column] = _flat(q["w"])[0]
                place = np.minimum(np.searchsorted(words, no), len(words) - 1)
                hit = words[place] == no
                r, p, v = row[hit], place[hit], w[hit]
                scores, step = np.zeros((len(ids), len(q["doc"]))), max(1, CELLS // len(words))
                for low in range(0, len(ids), step):
                    a, b = np.searchsorted(r, (low, low + step))
                    dense = np.zeros((min(step, len(ids) - low), len(words)))
                    dense[r[a:b] - low, p[a:b]] = v[a:b]
                    scores[low : low + step] = dense @ matrix
                cost = np.where(scores > 0, -np.round(scores, 9), np.inf)
                for n, name in enumerate(q["doc"]):
                    few = _best(cost[:, n], ids, k)
                    yield pd.DataFrame({"query_id": np.int64(name), "doc": ids[few], "score": -cost[few, n]})

    near = of(posted.join(known, "term"), weight).mapInPandas(score, "query_id bigint, doc bigint, score double")
    return top_each(near, k, ["query_id"], F.desc("score"), F.col("doc"))


def nearest_each(vectors: DataFrame, id_col: str, vector: str, queries: DataFrame, k: int, part: str | None = None) -> DataFrame:
    """(query_id, part, id, distance, rank): the nearest k other vectors of each query of (query_id, vector).

    With ``part``, a bigint column, the nearest k of each part. Null vectors and such of another length are no neighbours.
    """
    path = scratch_path(vectors.sparkSession, "queries")
    queries.where("vector is not null").select("query_id", "vector").write.parquet(path)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = batch["v"].map(len)
            for q in _blocks(path):
                length = np.array([len(x) for x in q["vector"]])
                for dim in np.unique(length):
                    same = batch[size == dim]
                    if same.empty:
                        continue
                    names = np.array(q["query_id"])[length == dim]
                    b = np.array([x for x in q["vector"] if len(x) == dim], dtype=np.float64)
                    a, ids, parts = np.stack(list(same["v"])).astype(np.float64), same["id"].to_numpy(), same["part"].to_numpy()
                    cost = np.zeros((len(a), len(b)))
                    for i in range(dim):  # one dimension after the other, as a sum over the array adds them up
                        step = a[:, i, None] - b[None, :, i]
                        cost += step * step
                    cost[ids[:, None] == names[None, :]] = np.inf
                    for one in np.unique(parts):
                        of = np.flatnonzero(parts == one)
                        for n, name in enumerate(names):
                            few = of[_best(cost[of, n], ids[of], k)]
                            yield pd.DataFrame({"query_id": np.int64(name), "part": np.int64(one), "id": ids[few], "distance": cost[few, n]})

    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), (F.col(part) if part else F.lit(0)).cast("bigint").alias("part"), F.col(vector).alias("v"))
    if part:
        rows = rows.where("part is not null")
    near = rows.mapInPandas(measure, "query_id bigint, part bigint, id bigint, distance double")
    return top_each(near, k, ["query_id", "part"], F.col("distance"), F.col("id"))


def adaptive_k(distances: Column, least: int, most: int) -> Column:
    """How many of the sorted distances to keep: few after a sharp first step, many where they lie close."""
    n, first, last = F.size(distances), F.get(distances, F.lit(0)), F.try_element_at(distances, F.lit(-1))
    spread = last - first
    sharp = F.try_divide(F.get(distances, F.lit(1)) - first, spread)
    smooth = F.bround(F.lit(float(least)) + (1 - sharp) * (most - least)).cast("int")
    return F.when(n < 2, n).when(spread < 1e-6, most).when(sharp > 0.5, least).otherwise(smooth)


def fuse(*ranked: DataFrame, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """(id, score) by reciprocal ranks; each input has id and rank from 1. Ties: earlier list, then better rank."""
    both = None
    for n, r in enumerate(ranked):
        part = r.select(*by, (1.0 / (FUSION + F.col("rank"))).alias("s"), (F.lit(n) * 1_000_000 + F.col("rank")).alias("first"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy(*by).agg(F.sum("s").alias("score"), F.min("first").alias("first"))


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows with their rank; take-ordered, so no full sort."""
    few = df.orderBy(*order).limit(k)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
