"""Streaming forms of the incremental operators: index sync, first-seen state, request-response correlation.

Each is a Structured Streaming query with a checkpoint; a batch that is repeated after a failure does no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from tessella.operators import sync
from tessella.operators.groups import first_by


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Rows of the parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


INDEX_BUCKETS = 16


def current_index(spark: SparkSession, index_path: str, before: int | None = None) -> DataFrame:
    """(path, sha, active): of each bucket of paths the newest version, or the newest of those older than ``before``."""
    whole = spark.read.schema("path string, sha string, active boolean, v int, bucket int").parquet(index_path)
    older = whole if before is None else whole.where(F.col("v") < before)
    newest = older.groupBy("bucket").agg(F.max("v").alias("v"))  # from the names of the folders; no column is read
    return older.join(newest, ["bucket", "v"]).select("path", "sha", "active")


def sync_index(states: DataFrame, index_path: str, checkpoint: str) -> StreamingQuery:
    """Keep an index of (path, sha, active) under ``index_path`` in step with a stream of (path, sha) changes.

    A batch writes the next version of the buckets of paths that it touches and reads only older versions of them, so
    its cost follows what it touches, and a repeated batch rewrites its own version and nothing else.
    """
    spark = states.sparkSession
    bucket = F.pmod(F.xxhash64("path"), F.lit(INDEX_BUCKETS)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        seen = batch.select("path", "sha").where("path is not null").persist()
        touched = [r[0] for r in seen.select(bucket).distinct().collect()]  # INDEX_BUCKETS at most
        held = current_index(spark, index_path, number).where(bucket.isin(touched)) if number else spark.createDataFrame([], "path string, sha string, active boolean")
        names = seen.select("path").distinct()
        kept, changed = held.join(names, "path", "left_anti"), held.join(names, "path", "left_semi")
        after = kept.unionByName(sync.apply(changed, seen)).withColumn("bucket", bucket)
        after.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{index_path}/v={number}")
        seen.unpersist()

    return states.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_unseen(records: DataFrame, key: str, order: str, state_path: str, checkpoint: str) -> StreamingQuery:
    """Append the first record of every key that the state doesn't hold yet; one folder ``b`` per batch.

    A batch reads the folders of earlier batches only, so one that is repeated finds and writes the same rows.
    """
    spark = records.sparkSession
    schema = records.schema

    def add(batch: DataFrame, number: int) -> None:
        new = first_by(batch.where(F.col(key).isNotNull()), [key], [order]).select(*schema.names)
        if number:
            held = spark.read.schema(StructType([*schema.fields, StructField("b", IntegerType())])).parquet(state_path).where(F.col("b") < number)
            new = new.join(held.select(key), key, "left_anti").select(*schema.names)
        new.write.mode("overwrite").parquet(f"{state_path}/b={number}")

    return records.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def correlate(requests: DataFrame, responses: DataFrame, key: str, limit: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    """Stream-stream join of (key, req_id, req_at) and (key, resp_id, resp_at) within the limit; state is dropped
    once the watermark has passed, and a request without a response comes out with a null one."""
    r = requests.withWatermark("req_at", late).alias("r")
    s = responses.withWatermark("resp_at", late).alias("s")
    met = F.expr(f"r.{key} = s.{key} and s.resp_at >= r.req_at and s.resp_at <= r.req_at + interval {limit}")
    return r.join(s, met, "left_outer").select(F.col(f"r.{key}").alias(key), "req_id", "resp_id")


def windowed_counts(events: DataFrame, at: str, kind: str, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts per kind in tumbling windows of event time."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
