"""Joins beyond equality, each with an equality key of its own so that it shuffles instead of looping.

Null keys and null bounds join nothing unless said otherwise. Empty inputs give empty results (outer forms keep
their left side). Columns beside those named are carried along on the side they come from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def two_way_difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of either side that the other lacks, side by side: (key, value_a, value_b)."""
    pair = [key, value]
    left, right = a.select(pair).distinct(), b.select(pair).distinct()
    lost, new = left.join(right, pair, "left_anti"), right.join(left, pair, "left_anti")
    x, y = lost.withColumnRenamed(value, f"{value}_a"), new.withColumnRenamed(value, f"{value}_b")
    return x.join(y, key, "full_outer")


def _bins(start: Column, end: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def interval_overlap(a: DataFrame, b: DataFrame, key: str, width: float) -> DataFrame:
    """Pairs of half-open intervals of the same key that overlap (touching is no overlap).

    ``a`` has a_start and a_end, ``b`` has b_start and b_end, as numbers. Intervals are spread over bins of
    ``width``; a pair is kept in the bin in which the later of the two begins, so it comes once. Choose ``width``
    near the usual length: each interval is repeated once per bin it touches.
    """
    x = a.where("a_end > a_start").withColumn("__bin", _bins(F.col("a_start"), F.col("a_end"), width))
    y = b.where("b_end > b_start").withColumn("__bin", _bins(F.col("b_start"), F.col("b_end"), width))
    met = (F.col("a_end") > F.col("b_start")) & (F.col("a_start") < F.col("b_end"))
    first = F.floor(F.greatest("a_start", "b_start") / width) == F.col("__bin")
    return x.join(y, [key, "__bin"]).where(met & first).drop("__bin")


def point_in_interval(points: DataFrame, intervals: DataFrame, key: str, at: str) -> DataFrame:
    """Each point with the interval of its key that holds it, else with the last one before it ends all: the last.

    ``intervals`` (i_start, i_end) of a key don't overlap; they and the points are laid on one time line, and the
    last interval begun is carried forward, so neither side is repeated. Points of a key without intervals get null.
    """
    names = [c for c in intervals.columns if c != key]
    last = intervals.groupBy(key).agg(F.max_by(F.struct(*names), "i_start").alias("__last"))
    line = points.select(key, F.struct(*[c for c in points.columns if c != key]).alias("__p"), F.col(at).alias("__t"), F.lit(None).cast(intervals.select(F.struct(*names).alias("i")).schema["i"].dataType).alias("__i"), F.lit(1).alias("__o"))
    starts = intervals.select(key, F.lit(None).cast(line.schema["__p"].dataType).alias("__p"), F.col("i_start").alias("__t"), F.struct(*names).alias("__i"), F.lit(0).alias("__o"))
    carried = F.last("__i", ignorenulls=True).over(Window.partitionBy(key).orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, 0))
    found = line.unionByName(starts).withColumn("__c", carried).where("__p is not null")
    hit = F.when(F.col("__t") < F.col("__c.i_end"), F.col("__c"))
    joined = found.withColumn("__hit", hit).join(last, key, "left").withColumn("__use", F.coalesce("__hit", "__last"))
    return joined.select(key, "__p.*", *[F.col(f"__use.{n}").alias(n) for n in names])


def asof_nearest(events: DataFrame, key: str, at: Column, anchor: Column, order: str) -> DataFrame:
    """Per key the row nearest to the anchor; the smaller ``order`` wins ties. Null times never win."""
    return events.where(at.isNotNull()).groupBy(key).agg(F.min_by(F.struct(*[c for c in events.columns if c != key]), F.struct(F.abs(at - anchor), F.col(order))).alias("r")).select(key, "r.*")


def asof_backward(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, value: str) -> DataFrame:
    """Each left row with the value of the latest right row of its key that is not later (null if there is none)."""
    x = left.select("*", F.col(at).alias("__t"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(1).alias("__o"))
    y = right.select(*[F.col(key) if c == key else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.col(right_at).alias("__t"), F.col(value).alias("__v"), F.lit(0).alias("__o"))
    seen = F.last("__v", ignorenulls=True).over(Window.partitionBy(key).orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, 0))
    return x.unionByName(y).withColumn(value, seen).where("__o = 1").select(*left.columns, value)


def longest_prefix(paths: DataFrame, path: str, prefixes: DataFrame, prefix: str, separator: str = "/") -> DataFrame:
    """Each path with the longest of the prefixes that it lies under, by whole components (null if none)."""
    parts = F.split(path, separator)
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))
    each = paths.select(F.col(path), F.explode(ups).alias(prefix)).distinct()
    best = each.join(prefixes.select(prefix).distinct(), prefix).groupBy(path).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))
    return paths.join(best, path, "left")


def fuzzy_best(queries: DataFrame, items: DataFrame) -> DataFrame:
    """(query, item, score): per query the item with the greatest 2|A and B| - |B without A| - |A without B|.

    ``queries`` (query, tokens), ``items`` (item, tokens), tokens as arrays. At least one token must be common;
    the smaller item wins ties.
    """
    q = queries.select("query", F.array_distinct("tokens").alias("tq"))
    i = items.select("item", F.array_distinct("tokens").alias("ti"))
    common = q.select("query", F.size("tq").alias("nq"), F.explode("tq").alias("t")).join(i.select("item", F.size("ti").alias("ni"), F.explode("ti").alias("t")), "t").groupBy("query", "item", "nq", "ni").agg(F.count("*").alias("n"))
    scored = common.select("query", "item", (4 * F.col("n") - F.col("ni") - F.col("nq")).alias("score"))
    best = scored.groupBy("query").agg(F.min(F.struct((-F.col("score")).alias("s"), "item")).alias("b"))
    return best.select("query", F.col("b.item").alias("item"), (-F.col("b.s")).alias("score"))


def correlated(requests: DataFrame, responses: DataFrame, key: str, limit_seconds: int) -> DataFrame:
    """Requests (req_id, req_at) with the responses (resp_id, resp_at) of their key that follow within the limit.

    Bins of the limit's length make it an equality join: a response lies in the request's bin or the next.
    """
    second = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    r = requests.withColumn("__s", second("req_at")).withColumn("__bin", F.explode(F.array(F.floor(F.col("__s") / limit_seconds), F.floor(F.col("__s") / limit_seconds) + 1)))
    s = responses.withColumn("__e", second("resp_at")).withColumn("__bin", F.floor(F.col("__e") / limit_seconds))
    return r.join(s, [key, "__bin"]).where((F.col("__e") >= F.col("__s")) & (F.col("__e") - F.col("__s") <= limit_seconds)).drop("__bin", "__s", "__e")


def neighbours(seeds: DataFrame, chunks: DataFrame, lines: int = 20, size: int = 4096) -> DataFrame:
    """Seed chunks and the chunks of the same file within ``lines`` lines and less than ``size`` bytes of one.

    Both have item_no, file_path, line_start and byte_offset; bins of ``size`` bytes carry the range join. Each
    chunk comes once, seeds before neighbours (``kind``).
    """
    s = seeds.select(F.col("file_path").alias("file_path"), F.col("line_start").alias("__l"), F.col("byte_offset").alias("__b")).distinct()
    s = s.withColumn("__bin", F.explode(F.array(*[F.floor(F.col("__b") / size) + k for k in (-1, 0, 1)])))
    c = chunks.withColumn("__bin", F.floor(F.col("byte_offset") / size))
    near = c.join(s, ["file_path", "__bin"]).where((F.abs(F.col("line_start") - F.col("__l")) <= lines) & (F.abs(F.col("byte_offset") - F.col("__b")) < size))
    both = seeds.select("item_no", "file_path", F.lit(0).alias("kind")).unionByName(near.select("item_no", "file_path", F.lit(1).alias("kind")))
    return both.groupBy("item_no", "file_path").agg(F.min("kind").alias("kind"))


def contains_words(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id): texts of which one holds the other as a run of whole words.

    ``a`` (a_id, a_text), ``b`` (b_id, b_text), words parted by one blank. The contained text's rarest word must
    stand in the other, so the pairs meet on that word only.
    """

    def words(df: DataFrame, s: str) -> DataFrame:
        return df.where(f"{s}_text <> ''").select(f"{s}_id", f"{s}_text", F.explode(F.array_distinct(F.split(f"{s}_text", " "))).alias("w"))

    wa, wb = words(a, "a"), words(b, "b")
    freq = wa.select("w").unionByName(wb.select("w")).groupBy("w").agg(F.count("*").alias("f"))
    rarest = lambda w, s: w.join(freq, "w").groupBy(f"{s}_id", f"{s}_text").agg(F.min_by("w", F.struct("f", "w")).alias("w"))
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    inner = rarest(wa, "a").join(wb, "w").where(pad("b_text").contains(pad("a_text")))
    outer = rarest(wb, "b").join(wa, "w").where(pad("a_text").contains(pad("b_text")))
    return inner.select("a_id", "b_id").unionByName(outer.select("a_id", "b_id")).distinct()


def covered_lines(statements: DataFrame, changed: DataFrame) -> DataFrame:
    """Statement lines of which a changed line lies between them and the file's next statement.

    ``statements`` (file, line, ...) and ``changed`` (file, line). Every changed line is given to the last statement
    not after it, on one line per file; both sides stay unrepeated.
    """
    marks = changed.select("file", F.col("line").alias("at"), F.lit(None).cast("int").alias("line"), F.lit(1).alias("o"))
    own = statements.select("file", F.col("line").alias("at"), F.col("line").cast("int").alias("line"), F.lit(0).alias("o")).distinct()
    w = Window.partitionBy("file").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    hit = marks.unionByName(own).withColumn("line", F.last("line", ignorenulls=True).over(w)).where("o = 1 and line is not null").select("file", "line").distinct()
    return statements.join(hit, ["file", "line"], "left_semi")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def named_or_prefixed(queries: DataFrame, query: str, items: DataFrame, name: str, order: str) -> DataFrame:
    """(query, order, exact): per query the last item of that very name, else the last whose name begins with it.

    Names are cut to the lengths that queries have, so both forms are equality joins; a query without any item is null.
    """
    asked = queries.select(F.col(query)).where(F.col(query).isNotNull()).distinct()
    sizes = asked.agg(F.collect_set(F.length(query)).alias("__sizes"))  # one row, as long as the longest query at most
    cut = items.select(F.col(name).alias("__name"), F.col(order)).join(F.broadcast(sizes)).select("__name", order, F.explode("__sizes").alias("__n")).where(F.length("__name") >= F.col("__n"))
    heads = cut.select(F.left("__name", F.col("__n")).alias(query), (F.length("__name") == F.col("__n")).alias("exact"), order).groupBy(query).agg(F.max(F.struct("exact", order)).alias("b"))
    return asked.join(heads, query, "left").select(query, F.col(f"b.{order}").alias(order), F.coalesce("b.exact", F.lit(False)).alias("exact"))
