"""Operators that carry state along an ordered group. Rows are sorted within partitions of whole keys and streamed
through in batches, so a long group needs no more memory than a batch. Their functions are plain Python.

Null keys form a group of their own; null times are skipped.
"""

from __future__ import annotations

import ast
import json
import math
import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType


class Cutter:
    """Boundaries of one group, fed with times in order: at least ``least`` apart, gaps over ``most`` divided evenly."""

    def __init__(self, least: float, most: float) -> None:
        self.least, self.most, self.last = min(least, most / 2), most, 0.0

    def _fits(self, at: float) -> bool:
        return self.least <= at - self.last <= self.most

    def _fill(self, until: float) -> Iterator[float]:
        while until - self.last > self.most:
            even = self.last + (until - self.last) / math.ceil((until - self.last) / self.most)
            self.last = next((x for x in (float(math.ceil(even)), float(math.floor(even))) if self._fits(x)), even)
            yield self.last

    def feed(self, at: float) -> Iterator[float]:
        yield from self._fill(at)
        if at - self.last >= self.least:
            self.last = at
            yield at

    def end(self, duration: float) -> Iterator[float]:
        yield from self._fill(duration)


def keypoints(duration: float, times: list[float], least: float, most: float) -> list[float]:
    """Boundaries of one recording, 0 first."""
    cut = Cutter(least, most)
    out = [0.0]
    for t in sorted({t for t in times if 0 < t < duration}):
        out += cut.feed(t)
    return out + list(cut.end(duration))


def segment(df: DataFrame, key: str, at: str, duration: float, least: float, most: float) -> DataFrame:
    """(key, at): boundaries of every key's time line from 0 to ``duration``."""
    source = df.select(F.col(key).cast("bigint").alias("key"), F.col(at).cast("double").alias("at")).where("at is not null").distinct().repartition("key").sortWithinPartitions("key", "at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, cut = None, None
        for batch in batches:
            out = []
            for k, t in zip(batch["key"].tolist(), batch["at"].tolist()):
                if cut is None or k != current:
                    if cut is not None:
                        out += [(current, x) for x in cut.end(duration)]
                    current, cut = k, Cutter(least, most)
                    out.append((k, 0.0))
                if 0 < t < duration:
                    out += [(k, x) for x in cut.feed(t)]
            yield pd.DataFrame(out, columns=["key", "at"])
        if cut is not None:
            yield pd.DataFrame([(current, x) for x in cut.end(duration)], columns=["key", "at"])

    return source.mapInPandas(run, "key bigint, at double").withColumnRenamed("key", key)


def _field(text: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        a, _, b = span.partition("-")
        first, last = (low, high) if a == "*" else (int(a), int(b) if b else (high if step else int(a)))
        out |= set(range(first, last + 1, int(step) if step else 1))
    if not out or min(out) < low or max(out) > high:
        raise ValueError(text)
    return out


def next_fire(cron: str | None, after: int | None) -> int | None:
    """The first second after ``after`` (seconds UTC) that a five-field schedule names, null if it names none."""
    try:
        minute, hour, day, month, weekday = cron.split()
        minutes, hours, days, months = _field(minute, 0, 59), _field(hour, 0, 23), _field(day, 1, 31), _field(month, 1, 12)
        weekdays = {d % 7 for d in _field(weekday, 0, 7)}
        t = (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=int(after))).replace(second=0) + timedelta(minutes=1)
    except (ValueError, AttributeError, TypeError):
        return None
    either = day != "*" and weekday != "*"
    for _ in range(366 * 8):
        named = t.day in days, (t.weekday() + 1) % 7 in weekdays
        if t.month in months and (any(named) if either else all(named)):
            while True:
                if t.hour in hours and t.minute in minutes:
                    return int(t.timestamp())
                later = t + (timedelta(minutes=1) if t.hour in hours else timedelta(hours=1) - timedelta(minutes=t.minute))
                if later.day != t.day:
                    t = later
                    break
                t = later
        else:
            t = (t + timedelta(days=1)).replace(hour=0, minute=0)
    return None


def next_fires(cron: Column, after: Column) -> Column:
    """Column form of next_fire; each distinct schedule and time of a batch is worked out once."""

    @F.pandas_udf(StringType())
    def run(crons: pd.Series, times: pd.Series) -> pd.Series:
        known: dict[tuple, str | None] = {}
        out = []
        for pair in zip(crons, times):
            if pair not in known:
                got = next_fire(*pair)
                known[pair] = None if got is None else str(got)
            out.append(known[pair])
        return pd.Series(out, dtype=object)

    return run(cron, after).cast("bigint")


VERDICT = StructType([StructField("valid", BooleanType()), StructField("errors", ArrayType(StructType([StructField("line", IntegerType()), StructField("column", IntegerType()), StructField("message", StringType())])))])


def check_syntax(language: str | None, code: str | None) -> dict:
    """Whether a text is well-formed in a language, with the places that aren't; fences around it are dropped."""
    text = code or ""
    if m := re.search(r"```[^\n]*\n(.*?)```", text, re.S):
        text = m[1]
    kind = (language or "").lower()
    try:
        if kind in ("python", "py"):
            ast.parse(text)
        elif kind == "json":
            json.loads(text)
        else:
            return {"valid": False, "errors": [{"line": 0, "column": 0, "message": f"no checker for {kind or 'no language'}"}]}
    except SyntaxError as e:
        return {"valid": False, "errors": [{"line": e.lineno or 0, "column": e.offset or 0, "message": e.msg}]}
    except json.JSONDecodeError as e:
        return {"valid": False, "errors": [{"line": e.lineno, "column": e.colno, "message": e.msg}]}
    except (ValueError, RecursionError, MemoryError) as e:
        return {"valid": False, "errors": [{"line": 0, "column": 0, "message": type(e).__name__}]}
    return {"valid": True, "errors": []}


def syntax_verdict(language: Column, code: Column) -> Column:
    """Column form of check_syntax, sent to Python in Arrow batches."""
    return F.udf(check_syntax, VERDICT, useArrow=True)(language, code)


def code_chunks(text: str | None, limit: int) -> list[tuple[int, int, int, str]]:
    """(byte offset, first line, last line, text) of code cut before unindented lines, each up to ``limit`` characters
    where a line allows it; the chunks put together are the text."""
    out, held, offset, line, size = [], [], 0, 1, 0

    def flush() -> None:
        nonlocal held, offset, line, size
        body = "".join(held)
        out.append((offset, line, line + body.count("\n"), body))
        offset, line, held, size = offset + len(body.encode("utf-8", "surrogatepass")), line + body.count("\n"), [], 0

    for row in (text or "").splitlines(keepends=True):
        top = row[:1] not in (" ", "\t", "\n", "\r", ")", "}", "]", "")
        if held and (size + len(row) > limit or (top and size > limit // 2)):
            flush()
        held.append(row)
        size += len(row)
    if held:
        flush()
    return out


def chunk_code(df: DataFrame, id_col: str, text: str, limit: int) -> DataFrame:
    """(id, byte_offset, line_start, line_end, text) of the code chunks of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(i, *c) for i, t in zip(batch["id"], batch["text"]) for c in code_chunks(t, limit)], columns=["id", "byte_offset", "line_start", "line_end", "text"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text")).mapInPandas(run, "id bigint, byte_offset bigint, line_start bigint, line_end bigint, text string").withColumnRenamed("id", id_col)


def version_key(version: Column) -> Column:
    """An array that orders release numbers: development and pre-releases before, post-releases after the release."""
    plain = F.lower(F.trim(version))
    release = F.transform(F.split(F.regexp_extract(plain, r"^v?(\d+(?:\.\d+)*)", 1), r"\."), lambda p: p.try_cast("int"))
    padded = F.slice(F.concat(release, F.array_repeat(F.lit(0), 6)), 1, 6)
    tail = F.regexp_extract(plain, r"^v?\d+(?:\.\d+)*(.*)$", 1)
    phase = F.when(tail == "", 4).when(tail.rlike(r"^[._-]?dev"), 0).when(tail.rlike(r"^[._-]?a"), 1).when(tail.rlike(r"^[._-]?b"), 2).when(tail.rlike(r"^[._-]?(rc|c|pre)"), 3).otherwise(5)
    number = F.coalesce(F.regexp_extract(tail, r"(\d+)", 1).try_cast("int"), F.lit(0))
    return F.when(plain.rlike(r"^v?\d"), F.concat(padded, F.array(phase, number)))
