"""Queries of the sources and of the operators that need Python."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tessella.operators import sequential as Q
from tessella.sources import archives, files
from tessella.sources.tables import table


def scan_files(spark: SparkSession, d: str) -> DataFrame:
    return files.listing(spark, d, [".parquet"], exclude="(events|region)").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), (F.col("bytes") > 0).alias("filled"))


def segment_keypoints(spark: SparkSession, d: str) -> DataFrame:
    day = table(spark, d, "events").select("user_id", F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200, 3).alias("at"))
    return Q.segment(day, "user_id", "at", 2592000.0, 3600.0, 43200.0).withColumn("at", F.round("at", 3))


def cron_due(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "part").select(F.concat((F.col("p_size") % 60).cast("string"), F.lit(" */"), (F.col("p_size") % 5 + 1).cast("string"), F.lit(" * * "), F.when(F.col("p_partkey") % 3 == 0, "1-5").otherwise("*"), F.lit(" run "), F.col("p_partkey").cast("string"), F.lit(" # x")).alias("value"))
    fires = files.schedule(lines).withColumn("next", Q.next_fires(F.col("cron"), F.lit(1704067200)))
    return fires.where(F.col("next") <= 1704067200 + 7200)


def validate_syntax(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("def f():\n    return "), F.col("p_size").cast("string"))).when(F.col("p_size") % 3 == 1, F.lit("def f(:\n  pass")).otherwise(F.concat(F.lit('{"a": '), F.col("p_size").cast("string"), F.lit("}")))
    language = F.when(F.col("p_size") % 3 == 2, "json").otherwise("python")
    return table(spark, d, "part").select("p_partkey", Q.syntax_verdict(language, code).alias("v")).select("p_partkey", "v.valid", F.size("v.errors").alias("errors"))


def chunk_code(spark: SparkSession, d: str) -> DataFrame:
    code = table(spark, d, "chunks").where("lower(rel_path) like '%.py'")
    return Q.chunk_code(code, "item_no", "text", 512).select("item_no", "byte_offset", "line_start", "line_end", F.md5("text").alias("digest"))


def latest_release(spark: SparkSession, d: str) -> DataFrame:
    version = F.concat((F.col("l_linenumber") + 8).cast("string"), F.lit("."), F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_returnflag") == "R", "rc1").otherwise(""))
    return table(spark, d, "lineitem").select("l_partkey", version.alias("version")).groupBy("l_partkey").agg(F.max_by("version", Q.version_key(F.col("version"))).alias("version"))


def binary_kv(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf(BinaryType())
    def packed(size: pd.Series, name: pd.Series) -> pd.Series:
        def text(s: str) -> bytes:
            return struct.pack("<Q", len(s.encode())) + s.encode()

        return pd.Series([struct.pack("<IIQQ", files.MAGIC, 3, 0, 3) + text("general.size") + struct.pack("<Ii", 5, int(s)) + text("general.name") + struct.pack("<I", 8) + text(n) + text("tokenizer.ggml.x") + struct.pack("<IIQ", 9, 4, 2) + struct.pack("<II", 1, 2) for s, n in zip(size, name)])

    return files.binary_headers(table(spark, d, "part").select("p_partkey", packed("p_size", "p_name").alias("content")), "p_partkey", "content").withColumnRenamed("id", "p_partkey")


def archive_records(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers")
    named = F.transform("authors", lambda a: F.struct(a.alias("name")))
    raw = {
        "arxiv": p.where("paper_id % 4 = 0").select("paper_id", F.to_json(F.struct("title", "authors", "doi", "url", "abstract", F.col("published_date").alias("date"))).alias("raw")),
        "semantic_scholar": p.where("paper_id % 4 = 1").select("paper_id", F.to_json(F.struct("title", named.alias("authors"), "doi", "url", "abstract", F.lit("2020").alias("year"), F.col("citation_count").alias("citationCount"), F.col("is_open_access").alias("isOpenAccess"))).alias("raw")),
        "chemrxiv": p.where("paper_id % 4 = 2").select("paper_id", F.to_json(F.struct(F.struct("title", named.alias("authors"), "doi", "abstract", F.col("published_date").alias("publishedDate")).alias("item"))).alias("raw")),
        "biorxiv": p.where("paper_id % 4 = 3").select("paper_id", F.to_json(F.struct("title", F.array_join("authors", "; ").alias("authors"), "doi", "abstract", F.col("published_date").alias("date"))).alias("raw")),
    }
    return archives.federate(raw).select("paper_id", "source", "title", F.size("authors").alias("n_authors"), "doi", "url", F.col("citation_count"))


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and k[0] != "_"}

SQL = {
    "cron_due": """with c as (select p_partkey, p_size % 60 as m, p_size % 5 + 1 as h from part)
        select concat(m, ' */', h, ' * * ', case when p_partkey % 3 = 0 then '1-5' else '*' end) as cron, 'run ' || p_partkey as command, 1704067200 + case when m > 0 then m * 60 when h = 1 then 3600 when h = 2 then 7200 end as next from c where case when m > 0 then m * 60 when h = 1 then 3600 when h = 2 then 7200 end <= 7200""",
    "validate_syntax": "select p_partkey, p_size % 3 <> 1 as valid, case when p_size % 3 = 1 then 1 else 0 end as errors from part",
    "binary_kv": "select p_partkey, 'general.size' as key, cast(p_size as varchar) as value from part union all select p_partkey, 'general.name', p_name from part",
    "latest_release": "select l_partkey, version from (select *, row_number() over (partition by l_partkey order by a desc, b desc, f) as r from (select l_partkey, l_linenumber + 8 as a, cast(l_quantity as int) as b, l_returnflag = 'R' as f, (l_linenumber + 8) || '.' || cast(l_quantity as int) || case when l_returnflag = 'R' then 'rc1' else '' end as version from lineitem)) where r = 1",
    "archive_records": """select paper_id, case paper_id % 4 when 0 then 'arxiv' when 1 then 'semantic_scholar' when 2 then 'chemrxiv' else 'biorxiv' end as source, coalesce(title, '') as title, case when paper_id % 4 = 3 then coalesce(len(authors), 0) else len(authors) end as n_authors, doi,
        case when paper_id % 4 in (0, 1) then url when doi is not null then 'https://doi.org/' || doi end as url, case when paper_id % 4 = 1 then coalesce(citation_count, 0) else 0 end as citation_count from papers""",
}
