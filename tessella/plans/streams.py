"""Streaming queries run to the end of their input, so that their result can be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import scratch_path
from tessella.sources.tables import table
from tessella.streaming import streams


def _as_stream(spark: SparkSession, parts: list[DataFrame], name: str) -> DataFrame:
    """The parts as a stream, one batch each."""
    path = scratch_path(spark, name)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def _twice(start, checkpoint: str, spark: SparkSession) -> None:  # noqa: ANN001
    """Run a query to the end of its input, forget that its last batch was committed, and run it again."""
    start().awaitTermination()
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    numbers = [int(f.getPath().getName()) for f in files.listStatus(folder) if f.getPath().getName().isdigit()]
    files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, str(max(numbers))), False)
    start().awaitTermination()


def stream_sync(spark: SparkSession, d: str) -> DataFrame:
    """Stale versions of files first, then the present ones; the last batch is repeated."""
    state = lambda flag: table(spark, d, "chunks").where(flag).groupBy(F.col("file_path").alias("path")).agg(F.max("file_sha").alias("sha"))
    home = scratch_path(spark, "stream-sync")
    stream = _as_stream(spark, [state("not active"), state("active")], "states")
    _twice(lambda: streams.sync_index(stream, f"{home}/index", f"{home}/checkpoint"), f"{home}/checkpoint", spark)
    return streams.current_index(spark, f"{home}/index")


def stream_unseen(spark: SparkSession, d: str) -> DataFrame:
    """Three batches in the order of their records; the last one is repeated."""
    home = scratch_path(spark, "stream-unseen")
    rows = table(spark, d, "incoming_papers").select("identity", "record_id", "batch_no")
    parts = [rows.where(F.col("batch_no").between(a, b)).drop("batch_no") for a, b in ((1, 4), (5, 8), (9, 1 << 30))]
    stream = _as_stream(spark, parts, "incoming")
    _twice(lambda: streams.append_unseen(stream, "identity", "record_id", f"{home}/state", f"{home}/checkpoint"), f"{home}/checkpoint", spark)
    return spark.read.schema("identity string, record_id bigint").option("recursiveFileLookup", "true").parquet(f"{home}/state").select("record_id", "identity")


def stream_correlate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = _as_stream(spark, [e], "events")
    req = stream.where("event_type = 'click'").select("user_id", F.col("event_id").alias("req_id"), F.col("ts").alias("req_at"))
    resp = stream.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("resp_id"), F.col("ts").alias("resp_at"))
    home = scratch_path(spark, "stream-correlate")
    out = streams.correlate(req, resp, "user_id", "3600 seconds").where("resp_id is not null")
    out.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id bigint, req_id bigint, resp_id bigint").parquet(f"{home}/out")


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and k[0] != "_"}

SQL = {
    "stream_sync": """with s as (select file_path as path, active as now, max(file_sha) as sha from chunks where active is not null group by 1, 2),
        v as (select distinct path, sha from s), n as (select path, max_by(sha, now::int) as cur from s group by 1)
        select path, sha, sha = cur as active from v join n using (path)""",
    "stream_unseen": "select min(record_id) as record_id, identity from incoming_papers where identity is not null group by identity",
    "stream_correlate": "select a.user_id, a.event_id as req_id, b.event_id as resp_id from events a join events b on a.user_id = b.user_id and a.event_type = 'click' and b.event_type = 'purchase' and b.ts >= a.ts and epoch_us(b.ts) - epoch_us(a.ts) <= 3600000000",
}
