"""Files as tables: listings, tolerant JSON, coverage XML, tab-separated listings, schedules, binary headers."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, path: str, suffixes: list[str] | None = None, exclude: str | None = None) -> DataFrame:
    """(path, bytes, modified) of the files below a folder; contents are not read.

    Kept are files with one of the lower-case suffixes, without those whose path matches the exclude pattern.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    if suffixes:
        found = found.where(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    return found.where(~F.col("path").rlike(exclude)) if exclude else found


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a schema; a line that doesn't parse keeps its text in ``broken``."""
    return spark.read.schema(f"{schema}, broken string").option("columnNameOfCorruptRecord", "broken").option("mode", "PERMISSIVE").json(path)


def coverage_xml(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, hits, br_taken, br_total) of coverage reports in XML."""
    line = "struct<_number:int,_hits:int,`_condition-coverage`:string>"
    rows = spark.read.format("xml").option("rowTag", "class").schema(f"_filename string, lines struct<line:array<{line}>>").load(path)
    each = rows.select(F.col("_filename").alias("file"), F.explode("lines.line").alias("l"))
    branch = lambda k: F.nullif(F.regexp_extract(F.col("l._condition-coverage"), r"\((\d+)/(\d+)\)", k), F.lit("")).cast("int")
    return each.select("file", F.col("l._number").alias("line"), F.col("l._hits").alias("hits"), branch(1).alias("br_taken"), branch(2).alias("br_total"))


def coverage_reports(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The facts of the reports that exist among the paths, with the place of their path as ``ord``; all missing: none."""
    jvm, found = spark.sparkContext._jvm, []
    for n, p in enumerate(paths):
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            found.append(coverage_xml(spark, p).withColumn("ord", F.lit(n)))
    if not found:
        return spark.createDataFrame([], "file string, line int, hits int, br_taken int, br_total int, ord int")
    return reduce(lambda a, b: a.unionByName(b), found)


def text_files(spark: SparkSession, path: str, suffixes: list[str], most: int = 256 << 20) -> DataFrame:
    """(path, text) of the files with one of the suffixes, bytes that are no UTF-8 left out; null beyond ``most`` bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\\.") for s in suffixes) + ")$"))
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    return found.select("path", F.when(F.col("length") <= most, text).alias("text"))


def fresh(kept: DataFrame, at: str, now: Column, seconds: int) -> DataFrame:
    """The rows of a cache that were fetched within so many seconds before ``now``; null times are stale."""
    return kept.where((F.col(at) > now - F.make_interval(secs=F.lit(seconds))) & (F.col(at) <= now))


def schedule(lines: DataFrame) -> DataFrame:
    """(cron, command) of the lines (``value``) of a schedule: five fields, then the command; comments are dropped."""
    text = F.trim(F.regexp_replace("value", "#.*$", ""))
    parts = F.split(text, r"\s+", 6)
    return lines.where(F.size(parts) >= 6).select(F.array_join(F.slice(parts, 1, 5), " ").alias("cron"), F.get(parts, 5).alias("command"))


def table_of_tabs(lines: DataFrame, names: list[str]) -> DataFrame:
    """Columns of tab-separated lines (``value``); lines with another number of fields are dropped."""
    parts = F.split("value", "\t", -1)
    return lines.where(F.size(parts) == len(names)).select(*[F.get(parts, i).alias(n) for i, n in enumerate(names)])


# The format's magic number and the layouts of its scalar kinds.
MAGIC = 0x46554747
LAYOUTS = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<B", 10: "<Q", 11: "<q", 12: "<d"}


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise EOFError
        self.at += n
        return self.data[self.at - n : self.at]

    def scalar(self, layout: str):  # noqa: ANN202
        return struct.unpack(layout, self.take(struct.calcsize(layout)))[0]

    def value(self, kind: int):  # noqa: ANN202
        if kind == 8:
            return self.take(self.scalar("<Q")).decode("utf-8", "replace")
        if kind == 9:
            inner, count = self.scalar("<I"), self.scalar("<Q")
            return [self.value(inner) for _ in range(count)]
        if kind not in LAYOUTS:
            raise EOFError
        return self.scalar(LAYOUTS[kind])


def header_fields(data: bytes | None) -> dict[str, str]:
    """Key -> value (as text) of a binary header; what a truncation leaves is kept, tokenizer tables are dropped."""
    out: dict[str, str] = {}
    reader = _Reader(data or b"")
    try:
        if reader.scalar("<I") != MAGIC:
            return out
        reader.take(12)
        for _ in range(reader.scalar("<Q")):
            key = reader.take(reader.scalar("<Q")).decode("utf-8", "replace")
            value = reader.value(reader.scalar("<I"))
            if not key.startswith("tokenizer.ggml."):
                out[key] = str(value)
    except EOFError:
        pass
    return out


def binary_headers(files: DataFrame, id_col: str, content: str) -> DataFrame:
    """(id, key, value) of the headers of binary contents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, v) for i, c in zip(batch["id"], batch["content"]) for k, v in header_fields(None if c is None else bytes(c)).items()]
            yield pd.DataFrame(rows, columns=["id", "key", "value"])

    return files.select(F.col(id_col).cast("bigint").alias("id"), F.col(content).alias("content")).mapInPandas(run, "id bigint, key string, value string")


def is_text(content: Column, block: int = 1 << 20) -> Column:
    """Whether the first block is UTF-8 without a zero byte; a character that the block's end cuts is none of its faults."""
    head = F.substring(content, 1, block)
    cut = [F.is_valid_utf8(F.substring(content, 1, block - k)) for k in range(4)]
    whole = F.when(F.octet_length(content) <= block, cut[0]).otherwise(cut[0] | cut[1] | cut[2] | cut[3])
    return whole & ~F.contains(head, F.lit(bytearray(1)))
