"""Queries of the join, grouping and window operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import groups as G
from tessella.operators import joins as J
from tessella.sources.tables import table

SECONDS = "unix_micros(cast(ts as timestamp)) / 1e6"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("s", F.expr(SECONDS))


def version_diff(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    side = lambda r: part.where(F.col("p_partkey") % 2 == r).groupBy(F.col("p_name").alias("name")).agg(F.min("p_brand").alias("version"))
    return J.two_way_difference(side(0), side(1), "name", "version")


def unreferenced(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey").join(table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


def path_set_algebra(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "chunks").select("rel_path")
    wanted = paths.where("rel_path like '%.py'").union(paths.where("rel_path like 'b%'")).distinct()
    return wanted.subtract(paths.where("rel_path like '%logs%'")).intersect(paths)


def exact_dups(spark: SparkSession, d: str) -> DataFrame:
    return G.exact_duplicates(table(spark, d, "documents"), "doc_id", "n_chars", F.sha2("text", 512))


def dup_savings(spark: SparkSession, d: str) -> DataFrame:
    return exact_dups(spark, d).agg(F.count("*").alias("copies"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("saved"), F.countDistinct("keeper").alias("keepers"))


def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    a = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("a_id"), F.col("s").alias("a_start"), (F.col("s") + 3600).alias("a_end"))
    b = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("b_id"), F.col("s").alias("b_start"), (F.col("s") + 1800).alias("b_end"))
    return J.interval_overlap(a, b, "user_id", 3600.0).select("user_id", "a_id", "b_id")


def point_in_interval(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    w = Window.partitionBy("user_id").orderBy("s", "event_id")
    spans = e.where("event_type = 'signup'").withColumn("i_end", F.lead("s").over(w)).select("user_id", F.col("event_id").alias("i_id"), F.col("s").alias("i_start"), F.coalesce("i_end", F.col("s") + 3600).alias("i_end"))
    return J.point_in_interval(e.where("event_type = 'click'").select("user_id", "event_id", "s"), spans, "user_id", "s").select("user_id", "event_id", "i_id")


def asof_nearest(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("user_id", "event_id", "event_type", "s")
    return J.asof_nearest(e, "user_id", F.col("s"), F.lit(1705320000.0), "event_id").select("user_id", "event_id", "event_type")


def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    left = e.where("event_type = 'purchase'").select("user_id", "event_id", "s")
    right = e.where("event_type = 'click'").select("user_id", F.col("s").alias("rs"), F.col("event_id").alias("click_id"))
    return J.asof_backward(left, right, "user_id", "s", "rs", "click_id").select("user_id", "event_id", "click_id")


def request_response(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    req = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("req_id"), F.col("ts").alias("req_at"))
    resp = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("resp_id"), F.col("ts").alias("resp_at"))
    return J.correlated(req, resp, "user_id", 3600).select("user_id", "req_id", "resp_id")


def longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "chunks").select("rel_path").distinct()
    parts = F.split("rel_path", "/")
    prefixes = paths.where(F.hash("rel_path").isNotNull() & (F.length("rel_path") % 2 == 0)).select(F.array_join(F.slice(parts, 1, 2), "/").alias("prefix")).union(paths.select(F.get(parts, 0).alias("prefix")).where("prefix < 'm'"))
    return J.longest_prefix(paths, "rel_path", prefixes, "prefix").select("rel_path", "prefix")


def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    queries = table(spark, d, "searches").select(F.col("search_name").alias("query"), F.split("search_name", "-").alias("tokens"))
    items = table(spark, d, "papers").where("title is not null").select(F.lower(F.regexp_replace("title", r"[^A-Za-z]+", " ")).alias("item")).distinct().select("item", F.split("item", " ").alias("tokens"))
    return J.fuzzy_best(queries, items)


def containment_match(spark: SparkSession, d: str) -> DataFrame:
    clean = lambda c: F.trim(F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", " ")))
    a = table(spark, d, "shelf_papers").select(F.col("shelf_id").alias("a_id"), clean("title").alias("a_text"))
    b = table(spark, d, "papers").select(F.col("paper_id").alias("b_id"), clean("title").alias("b_text"))
    return J.contains_words(a, b).select(F.col("a_id").alias("shelf_id"), F.col("b_id").alias("paper_id"))


def dim_lookup(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return table(spark, d, "supplier").join(names, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name", F.coalesce("r_name", F.lit("unknown")).alias("r_name"))


def coalesce_merge(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.nullif(F.col("p_size") % 7, F.lit(0)), F.nullif(F.col("p_partkey") % 11, F.lit(0))
    return table(spark, d, "part").select("p_partkey", F.coalesce(a, b, F.lit(-1)).cast("bigint").alias("value"))


def overlay_results(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    new = part.where("p_size > 25").select("p_partkey", F.col("p_type").alias("new_type"))
    return part.join(new, "p_partkey", "left").select("p_partkey", F.coalesce("new_type", F.concat(F.lit("old "), "p_type")).alias("result"))


def spec_expand(spark: SparkSession, d: str) -> DataFrame:
    spec = table(spark, d, "searches").select("search_name", F.split("search_name", "-").alias("models"))
    return spec.select("search_name", F.posexplode("models").alias("pos", "model"), (F.size("models") > 1).alias("labelled"))


def annotate_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "chunks").select(F.col("item_no").alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "content")).select("file", (F.col("pos") + 1).alias("line"), F.length("content").alias("width"))
    facts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line")).agg(F.max("l_quantity").alias("hits"))
    return lines.join(facts, ["file", "line"], "left").select("file", "line", "width", F.when(F.col("hits").isNull(), " ").when(F.col("hits") > 25, ">").otherwise("!").alias("mark"))


def state_filter(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") != "F", "open").when(F.col("o_totalprice") > 250000, "merged").otherwise("closed")
    return table(spark, d, "orders").select("o_orderkey", state.alias("state")).where("state <> 'open'")


def date_filter_keep_null(spark: SparkSession, d: str) -> DataFrame:
    day = F.try_to_date(F.regexp_extract("published_date", r"^(\d{4}-\d{2}-\d{2})$", 1), "yyyy-MM-dd")
    return table(spark, d, "papers").withColumn("day", day).where("day is null or day between date'2015-01-01' and date'2020-12-31'").select("paper_id", F.col("day").cast("string").alias("day"))


def constrained_candidates(spark: SparkSession, d: str) -> DataFrame:
    burden = F.when(F.col("p_size") % 9 > 0, F.col("p_size") * 1.5)
    return table(spark, d, "part").withColumn("burden", burden).where(F.col("burden").between(10, 60)).select("p_partkey", F.round("burden", 3).alias("burden"))


def capability_flags(spark: SparkSession, d: str) -> DataFrame:
    has = lambda s: F.coalesce(F.exists("authors", lambda x: F.endswith(x, F.lit(s))), F.lit(False))
    return table(spark, d, "papers").select("paper_id", has("son").alias("any_son"), has("berg").alias("any_berg"), F.coalesce(F.forall("authors", lambda x: x.contains(",")), F.lit(False)).alias("all_comma"))


def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "papers").where("citation_count >= 5").select("title", "paper_id", "source")
    return G.first_by(rows, ["title"], ["paper_id"])


def alias_by_hash(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("chunk_id", "item_no", "rel_path")
    return rows.groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_set("rel_path")), "|").alias("names"), F.min_by("rel_path", "item_no").alias("first_path"), F.count("*").alias("n"))


def best_variant(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.min_by("p_partkey", F.struct(-F.col("p_size"), "p_partkey")).alias("p_partkey"), F.max("p_size").alias("p_size"))


def best_per_bucket(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").withColumn("bucket", F.bround(F.col("p_size") / 4).cast("int"))
    return G.first_by(rows.select("p_brand", "bucket", "p_partkey", "p_retailprice"), ["p_brand", "bucket"], [-F.col("p_retailprice"), F.col("p_partkey")]).select("p_brand", "bucket", "p_partkey")


def multipart_sum(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("p_name", F.lit("-0000"), (F.col("p_size") % 3).cast("string"), F.lit("-of-00003.gguf"))
    base = F.regexp_replace(name, r"-\d{5}-of-\d{5}\.gguf$", "")
    return table(spark, d, "part").groupBy(base.alias("base")).agg(F.sum("p_size").alias("size"), F.count("*").alias("parts"))


def prefix_rollup(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "chunks").groupBy(F.replace("rel_path", F.lit("\\"), F.lit("/")).alias("path")).agg(F.max("file_size").alias("size"))
    return G.prefix_rollup(files, "path", "size", 1)


def session_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kinds = [F.count_if(F.col("event_type") == k).alias(k) for k in ("click", "purchase", "view")]
    return e.groupBy("user_id").agg(*kinds, F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("most"))


def session_texts(spark: SparkSession, d: str) -> DataFrame:
    return G.ordered_distinct(table(spark, d, "events"), "user_id", "event_type", "event_id").select("user_id", F.array_join("items", ",").alias("kinds"))


def usage_sum(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("tokens", F.when(F.col("event_id") % 97 > 0, F.col("event_id") % 10))
    return e.groupBy("user_id").agg(F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), G.null_if_any_null("tokens").alias("strict"))


def group_outputs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").groupBy("p_type", "p_name").agg(F.array_sort(F.collect_list(F.struct("p_size", "p_partkey"))).alias("m"))
    return rows.select("p_type", F.col("p_name").alias("output"), F.array_join(F.transform("m", lambda x: x["p_partkey"].cast("string")), ",").alias("members"), F.col("m")[0]["p_size"].alias("fastest"))


def pass_score(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    present, absent = [r"\bmerging\b|fusion", r"\d+ percent"], [r"```", r"(?i)erratum"]
    odd = text.rlike("[\\x{1F300}-\\x{1F9FF}\\x{2190}-\\x{21FF}\\x{2500}-\\x{257F}]")
    hits = sum([F.when(text.rlike(p), 1).otherwise(0) for p in present] + [F.when(text.rlike(p), 0).otherwise(1) for p in absent] + [F.when(odd, 0).otherwise(1)], F.lit(0))
    return table(spark, d, "documents").where("text is not null").select("doc_id", hits.alias("hits"), F.lit(len(present) + len(absent) + 1).alias("needed"))


def best_attempt(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("hits", F.col("l_quantity") % 5)
    full = F.min(F.when(F.col("hits") == 4, F.struct("l_linenumber", "l_shipdate", "l_partkey")))
    best = F.max("hits")
    return rows.groupBy("l_orderkey").agg(full.isNotNull().alias("passed"), best.cast("int").alias("hits"), full["l_linenumber"].alias("attempt"))


def constant_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_brand", F.lit("PASSED").alias("always"), F.lit("x").alias("same"), "p_size")
    return G.constant_columns(rows, ["p_brand", "always", "same", "p_size"])


def active_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("active").select("rel_path").distinct()


def manifest(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "chunks").where("active").select(F.substring_index(F.replace("rel_path", F.lit("\\"), F.lit("/")), "/", 1).alias("folder"), "rel_path").distinct()
    listed = files.groupBy("folder").agg(F.array_join(F.array_sort(F.collect_list("rel_path")), "\n").alias("body"), F.count("*").alias("files"))
    return listed.select("folder", "files", F.sha2("body", 256).alias("digest"))


def delta_assemble(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.left("event_type", F.lit(1)).alias("c")))).alias("p"))
    return e.select("user_id", F.array_join(F.transform("p", lambda x: x["c"]), "").alias("text"))


def last_user_text(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.coalesce(F.max_by(F.when(F.col("event_type") == "click", F.col("props")), F.when(F.col("event_type") == "click", F.col("event_id"))), F.lit("")).alias("text"))


def inject_system(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "props")
    first = e.groupBy("user_id").agg(F.min(F.when((F.col("event_type") == "signup") & (F.col("event_id") % 3 == 0), F.col("event_id"))).alias("f"))
    kept = e.join(first, "user_id").select("user_id", "event_id", F.when(F.col("event_id") == F.col("f"), F.concat("props", F.lit(" +context"))).otherwise(F.col("props")).alias("content"))
    made = first.where("f is null").select("user_id", F.lit(-1).cast("bigint").alias("event_id"), F.lit("context").alias("content"))
    return kept.unionByName(made)


def lead_intervals(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _events(spark, d).select("user_id", "event_id", F.round(F.lead("s", 1).over(w) - F.col("s"), 3).alias("gap"), F.lead("event_id", 1, -1).over(w).alias("next_id"))


def lag_prev(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.lag("event_type", 1, "").over(w).alias("previous"))


def tumbling_intervals(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 10).alias("duration"))
    return spans.select("p_partkey", "duration", F.explode(F.sequence(F.lit(0), F.col("duration") - 1, F.lit(60))).alias("start")).select("p_partkey", "start", F.least(F.col("start") + 60, F.col("duration")).alias("end"))


def sample_points(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size") % 5 + 1
    step = F.try_divide(F.lit(100.0), n - 1)
    return table(spark, d, "part").select("p_partkey", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(n == 1, F.lit(0.0)).otherwise(i * step))).alias("i", "at")).select("p_partkey", "i", F.round("at", 6).alias("at"))


def union_sorted(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    both = e.where("event_type = 'error'").select("event_id", F.lit("a").alias("kind"), "ts").unionByName(e.where("event_type = 'signup'").select("event_id", F.lit("b").alias("kind"), "ts"))
    return both.orderBy("ts", "event_id").select("event_id", "kind")


def catalog_sorted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice").orderBy(F.desc("p_size"), F.desc("p_retailprice"), "p_partkey")


def reorder_by_previous(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    old = part.where("p_size > 20").select("p_partkey", F.col("p_size").alias("old_pos"))
    placed = part.join(old, "p_partkey", "left").select("p_partkey", F.coalesce("old_pos", F.lit(-1)).alias("pos"))
    return placed.orderBy("pos", "p_partkey")


def unpivot_max(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("quantity"), (F.col("l_discount") * 500).alias("discount"), (F.col("l_tax") * 500).alias("tax"))
    long = wide.unpivot("l_orderkey", ["quantity", "discount", "tax"], "metric", "value")
    return long.groupBy("l_orderkey").agg(F.round(F.max(F.when(F.col("metric") == "tax", F.col("value") * 0.5).otherwise(F.col("value"))), 6).alias("best"))


def fallback_chain(spark: SparkSession, d: str) -> DataFrame:
    chain = F.coalesce("doi", F.nullif("url", F.lit("")), F.nullif("pdf_url", F.lit("")), F.concat(F.lit("row:"), F.col("paper_id").cast("string")))
    return table(spark, d, "papers").select("paper_id", chain.alias("reference"))


def federate_sources(spark: SparkSession, d: str) -> DataFrame:
    shape = lambda t, k, origin: table(spark, d, t).select(F.lit(origin).alias("origin"), F.col(k).alias("id"), "title", F.lower(F.trim("source")).alias("source"), "search_name")
    return J.union_all([shape("papers", "paper_id", "papers"), shape("seen_papers", "record_id", "seen"), shape("incoming_papers", "record_id", "incoming")]).groupBy("origin", "source").agg(F.count("*").alias("n"), F.count_if(F.col("title").isNull()).alias("untitled"), F.countDistinct("search_name").alias("searches"))


def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    batch = G.first_by(table(spark, d, "incoming_papers").select("identity", "record_id"), ["identity"], ["record_id"])
    return batch.join(table(spark, d, "seen_papers").select("identity"), "identity", "left_anti").select("record_id", "identity")


def incremental_pending(spark: SparkSession, d: str) -> DataFrame:
    state = lambda flag, name: table(spark, d, "chunks").where(flag).groupBy("rel_path").agg(F.max("file_mtime").alias(name))
    return state("active", "in_time").join(state("not active", "out_time"), "rel_path", "left").where("out_time is null or out_time <= in_time").select("rel_path")


def summary_pivot(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    return rows.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))


def html_links(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit('<p><a href="'), F.coalesce("url", F.lit("/none")), F.lit('">t</a> x <a class="b" href="/s/'), F.col("source"), F.lit('">s</a></p>'))
    return table(spark, d, "papers").select("paper_id", F.posexplode(F.regexp_extract_all(page, F.lit('href="([^"]*)"'))).alias("pos", "link"))


def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    size = F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("<i>"), F.col("p_size").cast("string"), F.lit(".5K</i>"))).otherwise("")
    page = F.concat(F.lit('<li class="m"><a href="/'), "p_brand", F.lit('"><h2>'), "p_name", F.lit("</h2></a>"), size, F.lit('</li><li class="m"><h2>'), "p_type", F.lit("</h2></li>"))
    blocks = table(spark, d, "part").select("p_partkey", F.posexplode(F.regexp_extract_all(page, F.lit(r'<li class="m">(.*?)</li>'))).alias("pos", "block"))
    got = lambda p: F.nullif(F.regexp_extract("block", p, 1), F.lit(""))
    return blocks.select("p_partkey", "pos", got("<h2>([^<]*)</h2>").alias("name"), got('href="([^"]*)"').alias("link"), S.count_strict(F.coalesce(got("<i>([^<]*)</i>"), F.lit(""))).alias("pulls"))


def html_tag_table(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit('<a href="/m:'), "p_name", F.lit('"></a> '), F.col("p_size").cast("string"), F.lit("GB 128K abc"), F.lpad((F.col("p_size") % 7).cast("string"), 9, "0"))
    tag, size = F.regexp_extract(page, 'href="/m:([^"]*)"', 1), F.regexp_extract(page, r"(\d+(?:\.\d+)?[MGT]B)", 1)
    rows = table(spark, d, "part").select(tag.alias("tag"), S.size_in_gb(size).alias("gb"), S.context_length(F.regexp_extract(page, r" (\d+[KM]) ", 1)).alias("context"), F.regexp_extract(page, r"\b([0-9a-f]{12})\b", 1).alias("hash"))
    return rows.groupBy("hash").agg(F.max("gb").alias("gb"), F.max("context").alias("context"), F.array_join(F.array_sort(F.collect_set("tag")), "|").alias("tags"))


def pending_tests(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    wanted = part.where("p_size < 30").select("p_partkey").union(part.where("p_type = 'PROMO'").select("p_partkey")).distinct()
    done = table(spark, d, "lineitem").where("l_quantity > 30 and l_shipdate >= timestamp_ntz'1998-01-01 00:00:00'").select(F.col("l_partkey").alias("p_partkey"))
    return wanted.join(part.where("p_brand = 'Brand#1'").select("p_partkey"), "p_partkey", "left_anti").join(done, "p_partkey", "left_anti")


def asof_release(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("package"), F.col("l_linenumber").alias("major"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("at"))
    newest = rows.groupBy("package").agg(F.max("major").alias("installed"))
    lower = rows.join(newest, "package").where("major < installed")
    anchor = F.lit(883612800000000)
    return J.asof_nearest(lower, "package", F.col("at"), anchor, "id").select("package", "installed", "major", "id")


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and k[0] != "_"}

_E = "e as (select *, epoch_us(ts) / 1e6 as s from events)"
SQL = {
    "version_diff": """with a as (select p_name as name, min(p_brand) as version from part where p_partkey % 2 = 0 group by 1), b as (select p_name as name, min(p_brand) as version from part where p_partkey % 2 = 1 group by 1),
        x as (select * from a except select * from b), y as (select * from b except select * from a) select coalesce(x.name, y.name) as name, x.version as version_a, y.version as version_b from x full join y on x.name = y.name""",
    "unreferenced": "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)",
    "path_set_algebra": "(select rel_path from chunks where rel_path like '%.py' union select rel_path from chunks where rel_path like 'b%') except select rel_path from chunks where rel_path like '%logs%'",
    "exact_dups": "select doc_id as id, keeper, n_chars from (select *, min(doc_id) over (partition by n_chars, text) as keeper from documents where n_chars > 0) where doc_id <> keeper",
    "dup_savings": "select count(*) as copies, cast(coalesce(sum(n_chars), 0) as bigint) as saved, count(distinct keeper) as keepers from (select *, min(doc_id) over (partition by n_chars, text) as keeper from documents where n_chars > 0) where doc_id <> keeper",
    "interval_overlap": f"with {_E} select a.user_id, a.event_id as a_id, b.event_id as b_id from e a join e b on a.user_id = b.user_id and a.event_type = 'view' and b.event_type = 'error' and a.s + 3600 > b.s and a.s < b.s + 1800",
    "point_in_interval": f"""with {_E}, i as (select user_id, event_id as i_id, s as i_start, coalesce(lead(s) over (partition by user_id order by s, event_id), s + 3600) as i_end from e where event_type = 'signup'),
        l as (select user_id, arg_max(i_id, i_start) as last_id from i group by 1)
        select e.user_id, e.event_id, coalesce(i.i_id, l.last_id) as i_id from e left join i on i.user_id = e.user_id and e.s >= i_start and e.s < i_end left join l on l.user_id = e.user_id where event_type = 'click'""",
    "asof_nearest": f"with {_E} select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by abs(s - 1705320000.0), event_id) as r from e) where r = 1",
    "asof_backward": f"with {_E} select p.user_id, p.event_id, c.event_id as click_id from (select * from e where event_type = 'purchase') p asof left join (select * from e where event_type = 'click') c on p.user_id = c.user_id and p.s >= c.s",
    "request_response": "select a.user_id, a.event_id as req_id, b.event_id as resp_id from events a join events b on a.user_id = b.user_id and a.event_type = 'click' and b.event_type = 'purchase' and b.ts >= a.ts and epoch_us(b.ts) - epoch_us(a.ts) <= 3600000000",
    "longest_prefix": """with p as (select distinct rel_path from chunks), f as (select array_to_string(string_split(rel_path, '/')[1:2], '/') as prefix from p where length(rel_path) % 2 = 0 union select string_split(rel_path, '/')[1] from p where string_split(rel_path, '/')[1] < 'm')
        select rel_path, arg_max(prefix, length(prefix)) as prefix from p left join f on p.rel_path = f.prefix or starts_with(p.rel_path, f.prefix || '/') group by rel_path""",
    "fuzzy_match": """with q as (select search_name as query, list_distinct(string_split(search_name, '-')) as tq from searches), i as (select distinct lower(regexp_replace(title, '[^A-Za-z]+', ' ', 'g')) as item from papers where title is not null),
        t as (select query, item, len(list_intersect(tq, string_split(item, ' '))) as n, len(tq) as nq, len(list_distinct(string_split(item, ' '))) as ni from q, i)
        select query, item, score from (select query, item, 4 * n - ni - nq as score, row_number() over (partition by query order by 4 * n - ni - nq desc, item) as r from t where n > 0) where r = 1""",
    "containment_match": """with a as (select shelf_id, trim(lower(regexp_replace(title, '[^A-Za-z0-9]+', ' ', 'g'))) as x from shelf_papers), b as (select paper_id, trim(lower(regexp_replace(title, '[^A-Za-z0-9]+', ' ', 'g'))) as y from papers)
        select shelf_id, paper_id from a, b where x <> '' and y <> '' and (contains(' ' || y || ' ', ' ' || x || ' ') or contains(' ' || x || ' ', ' ' || y || ' '))""",
    "dim_lookup": "select s_suppkey, n_name, coalesce(r_name, 'unknown') as r_name from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey",
    "coalesce_merge": "select p_partkey, cast(coalesce(nullif(p_size % 7, 0), nullif(p_partkey % 11, 0), -1) as bigint) as value from part",
    "overlay_results": "select p_partkey, case when p_size > 25 then p_type else 'old ' || p_type end as result from part",
    "spec_expand": "select search_name, i - 1 as pos, m[i] as model, len(m) > 1 as labelled from (select search_name, m, unnest(range(1, len(m) + 1)) as i from (select search_name, string_split(search_name, '-') as m from searches))",
    "annotate_lines": """with l as (select item_no as file, i as line, length(p[i]) as width from (select item_no, p, unnest(range(1, len(p) + 1)) as i from (select item_no, string_split(text, chr(10)) as p from chunks))), f as (select l_orderkey as file, l_linenumber as line, max(l_quantity) as hits from lineitem group by 1, 2)
        select l.file, l.line, width, case when hits is null then ' ' when hits > 25 then '>' else '!' end as mark from l left join f on l.file = f.file and l.line = f.line""",
    "state_filter": "select o_orderkey, case when o_totalprice > 250000 then 'merged' else 'closed' end as state from orders where o_orderstatus = 'F'",
    "date_filter_keep_null": "select paper_id, cast(day as varchar) as day from (select paper_id, try_cast(nullif(regexp_extract(published_date, '^(\\d{4}-\\d{2}-\\d{2})$', 1), '') as date) as day from papers) where day is null or day between date '2015-01-01' and date '2020-12-31'",
    "constrained_candidates": "select p_partkey, round(burden, 3) as burden from (select p_partkey, case when p_size % 9 > 0 then p_size * 1.5::double end as burden from part) where burden between 10 and 60",
    "capability_flags": "select paper_id, coalesce(len(list_filter(authors, lambda x: ends_with(x, 'son'))) > 0, false) as any_son, coalesce(len(list_filter(authors, lambda x: ends_with(x, 'berg'))) > 0, false) as any_berg, coalesce(len(list_filter(authors, lambda x: not contains(x, ','))) = 0, false) as all_comma from papers",
    "dedupe_first": "select title, paper_id, source from (select *, row_number() over (partition by title order by paper_id) as r from papers where citation_count >= 5) where r = 1",
    "alias_by_hash": "select chunk_id, array_to_string(list_sort(list_distinct(list(rel_path))), '|') as names, arg_min(rel_path, item_no) as first_path, count(*) as n from chunks group by 1",
    "best_variant": "select p_brand, p_type, p_partkey, p_size from (select *, row_number() over (partition by p_brand, p_type order by p_size desc, p_partkey) as r from part) where r = 1",
    "best_per_bucket": "select p_brand, bucket, p_partkey from (select *, row_number() over (partition by p_brand, bucket order by p_retailprice desc, p_partkey) as r from (select *, cast(round_even(p_size / 4, 0) as int) as bucket from part)) where r = 1",
    "multipart_sum": "select p_name as base, cast(sum(p_size) as bigint) as size, count(*) as parts from part group by 1",
    "prefix_rollup": "select string_split(path, '/')[1] as prefix, cast(sum(size) as bigint) as bytes, count(*) as files from (select replace(rel_path, chr(92), '/') as path, max(file_size) as size from chunks group by 1) group by 1",
    "session_summary": "select user_id, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'purchase') as purchase, count(*) filter (event_type = 'view') as view, round(sum(value), 4) as total, max(value) as most from events group by 1",
    "session_texts": "select user_id, string_agg(event_type, ',' order by o) as kinds from (select user_id, event_type, min(event_id) as o from events group by 1, 2) group by 1",
    "usage_sum": "select user_id, cast(sum(case when event_id % 97 > 0 then event_id % 10 else 0 end) as bigint) as tokens, case when count(*) filter (event_id % 97 = 0) = 0 then cast(sum(event_id % 10) as bigint) end as strict from events group by 1",
    "group_outputs": "select p_type, p_name as output, string_agg(cast(p_partkey as varchar), ',' order by p_size, p_partkey) as members, min(p_size) as fastest from part group by 1, 2",
    "pass_score": "select doc_id, cast(regexp_matches(text, '\\bmerging\\b|fusion') as int) + cast(regexp_matches(text, '\\d+ percent') as int) + cast(not contains(text, '```') as int) + cast(not regexp_matches(text, '(?i)erratum') as int) + cast(not regexp_matches(text, '[\\x{1F300}-\\x{1F9FF}\\x{2190}-\\x{21FF}\\x{2500}-\\x{257F}]') as int) as hits, 5 as needed from documents where text is not null",
    "best_attempt": "select l_orderkey, count(*) filter (l_quantity % 5 = 4) > 0 as passed, cast(max(l_quantity % 5) as int) as hits, min(l_linenumber) filter (l_quantity % 5 = 4) as attempt from lineitem group by 1",
    "constant_columns": "select 'p_brand' as name, min(p_brand) = max(p_brand) as constant, min(p_brand) = max(p_brand) as dropped from part union all select 'always', true, false union all select 'same', true, true union all select 'p_size', min(p_size) = max(p_size), min(p_size) = max(p_size) from part",
    "active_paths": "select distinct rel_path from chunks where active",
    "manifest": "select folder, count(*) as files, sha256(string_agg(rel_path, chr(10) order by rel_path)) as digest from (select distinct string_split(replace(rel_path, chr(92), '/'), '/')[1] as folder, rel_path from chunks where active) group by 1",
    "delta_assemble": "select user_id, string_agg(left(event_type, 1), '' order by event_id) as text from events group by 1",
    "last_user_text": "select user_id, coalesce(arg_max(props, event_id) filter (event_type = 'click'), '') as text from events group by 1",
    "inject_system": """with f as (select user_id, min(event_id) filter (event_type = 'signup' and event_id % 3 = 0) as f from events group by 1)
        select e.user_id, event_id, case when event_id = f then props || ' +context' else props end as content from events e join f on e.user_id = f.user_id union all select user_id, -1, 'context' from f where f is null""",
    "lead_intervals": f"with {_E} select user_id, event_id, round(lead(s) over w - s, 3) as gap, lead(event_id, 1, -1) over w as next_id from e window w as (partition by user_id order by ts, event_id)",
    "lag_prev": "select user_id, event_id, lag(event_type, 1, '') over (partition by user_id order by ts, event_id) as previous from events",
    "tumbling_intervals": "select p_partkey, start, least(start + 60, p_size * 10) as end from (select p_partkey, p_size, unnest(range(0, p_size * 10, 60)) as start from part)",
    "sample_points": "select p_partkey, i, round(case when n = 1 then 0.0::double else i * (100.0::double / nullif(n - 1, 0)) end, 6) as at from (select p_partkey, n, unnest(range(0, n)) as i from (select p_partkey, p_size % 5 + 1 as n from part))",
    "union_sorted": "select event_id, case event_type when 'error' then 'a' else 'b' end as kind from events where event_type in ('error', 'signup')",
    "catalog_sorted": "select p_partkey, p_size, p_retailprice from part order by p_size desc, p_retailprice desc, p_partkey",
    "reorder_by_previous": "select p_partkey, case when p_size > 20 then p_size else -1 end as pos from part order by pos, p_partkey",
    "unpivot_max": "select l_orderkey, round(max(greatest(l_quantity, l_discount * 500, l_tax * 500 * 0.5)), 6) as best from lineitem group by 1",
    "fallback_chain": "select paper_id, coalesce(doi, nullif(url, ''), nullif(pdf_url, ''), 'row:' || paper_id) as reference from papers",
    "federate_sources": """with u as (select 'papers' as origin, title, source, search_name from papers union all select 'seen', title, source, search_name from seen_papers union all select 'incoming', title, source, search_name from incoming_papers)
        select origin, lower(trim(source)) as source, count(*) as n, count(*) filter (title is null) as untitled, count(distinct search_name) as searches from u group by 1, 2""",
    "insert_if_absent": "select min(record_id) as record_id, identity from incoming_papers where identity not in (select identity from seen_papers where identity is not null) group by identity",
    "incremental_pending": "with i as (select rel_path, max(file_mtime) as a from chunks where active group by 1), o as (select rel_path, max(file_mtime) as b from chunks where not active group by 1) select i.rel_path from i left join o on i.rel_path = o.rel_path where b is null or b <= a",
    "summary_pivot": "select o_orderpriority, nullif(count(*) filter (o_orderstatus = 'F'), 0) as F, nullif(count(*) filter (o_orderstatus = 'O'), 0) as O, nullif(count(*) filter (o_orderstatus = 'P'), 0) as P from orders group by 1",
    "html_links": "select paper_id, 0 as pos, coalesce(url, '/none') as link from papers union all select paper_id, 1, '/s/' || source from papers",
    "html_blocks": """select p_partkey, 0 as pos, p_name as name, '/' || p_brand as link, case when p_size % 3 > 0 then cast(floor((p_size + 0.5) * 1000) as bigint) end as pulls from part
        union all select p_partkey, 1, p_type, null, null from part""",
    "html_tag_table": "select 'abc' || lpad(cast(p_size % 7 as varchar), 9, '0') as hash, max(p_size::double) as gb, cast(131072 as bigint) as context, array_to_string(list_sort(list_distinct(list(p_name))), '|') as tags from part group by 1",
    "pending_tests": "select p_partkey from part where (p_size < 30 or p_type = 'PROMO') and p_brand <> 'Brand#1' and p_partkey not in (select l_partkey from lineitem where l_quantity > 30 and l_shipdate >= timestamp '1998-01-01')",
    "asof_release": """with r as (select l_partkey as package, l_linenumber as major, l_orderkey * 100 + l_linenumber as id, epoch_us(l_shipdate) as t, max(l_linenumber) over (partition by l_partkey) as installed from lineitem)
        select package, installed, major, id from (select *, row_number() over (partition by package order by abs(t - 883612800000000), id) as n from r where major < installed) where n = 1""",
}
