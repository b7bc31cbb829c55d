"""Queries of catalogue functions, reports, commands and sinks, and of the joins they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import catalog as C
from tessella.functions import scalars as S
from tessella.operators import coverage, groups, joins, retrieval
from tessella.plans import analytics
from tessella.session import scratch_path
from tessella.sources import files
from tessella.sources.tables import table


def memory_heuristic(spark: SparkSession, d: str) -> DataFrame:
    quant = F.when(F.col("p_size") % 3 == 0, "Q4_K_M").when(F.col("p_size") % 3 == 1, "F32")
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 9).cast("double").alias("gb"), C.bits_of(quant).alias("bits"), F.when(F.col("p_size") % 4 > 0, F.col("p_partkey") * 64).alias("context"))
    return rows.select("p_partkey", F.round(C.memory_by_size(F.col("gb"), F.col("bits"), F.col("context")), 6).alias("gb"))


def short_forms(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_orderkey") * F.col("l_partkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.short_count(n).alias("downloads"), C.short_context(n).alias("context"))


def markdown_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", C.fenced(F.col("text"), 2000).alias("markdown"), C.html_escaped(F.col("text")).alias("html"))


def origin_of(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("hf.co/"), "p_name")).when(F.col("p_size") % 3 == 1, F.concat("p_name", F.lit("-HuggingFace"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", C.origin_of(name).alias("origin"))


def timestamp_text(spark: SparkSession, d: str) -> DataFrame:
    zone = F.when(F.col("o_orderkey") % 4 == 0, "").when(F.col("o_orderkey") % 4 == 1, "Z").when(F.col("o_orderkey") % 4 == 2, "+02:00").otherwise(" or so")
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return table(spark, d, "orders").select("o_orderkey", C.utc_text(text).alias("shown"))


def int_lenient(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("p_size") % 4 == 0, F.concat(F.col("p_size").cast("string"), F.lit(",345"))).when(F.col("p_size") % 4 == 1, F.col("p_name")).when(F.col("p_size") % 4 == 2, F.concat(F.lit(" -"), F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", C.whole_or_zero(text).alias("n"))


def doi_from_name(spark: SparkSession, d: str) -> DataFrame:
    base = F.concat(F.when(F.col("p_size") % 2 == 0, "0af3bc12-").otherwise("0AF3-"), F.lit("tse.2019."), F.col("p_partkey").cast("string"), F.lit(".pdf"))
    return table(spark, d, "part").select("p_partkey", C.doi_of_file(F.concat(F.lit("/papers/x/"), base)).alias("doi"))


def _info() -> Column:
    size = F.col("p_size").cast("string")
    kv = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("["), size, F.lit(",4,1]"))).otherwise(size)
    keys = [F.lit("q.vision.block_count"), F.lit("77"), F.lit("q.block_count"), size, F.lit("q.attention.head_count_kv"), kv, F.lit("q.attention.head_count"), F.lit("8"), F.lit("q.embedding_length"), (F.col("p_partkey") * 16).cast("string")]
    return F.map_concat(F.create_map(*keys), F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("q.attention.key_length"), F.lit("128"), F.lit("q.context_length"), F.lit("8192"))).otherwise(F.create_map().cast("map<string,string>")))


def arch_params(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", C.model_figures(_info()).alias("m")).select("p_partkey", "m.num_layers", "m.num_kv_heads", "m.head_dim", "m.context_length", "m.embedding_length")


def context_sizes(spark: SparkSession, d: str) -> DataFrame:
    parameters = F.when(F.col("p_size") % 5 > 1, F.concat(F.lit("stop x\nnum_ctx   "), (F.col("p_size") * 100).cast("string"), F.lit("\ntop_k 4")))
    size = C.context_size(_info(), F.coalesce(parameters, F.lit("")))
    return table(spark, d, "part").select("p_partkey", size.alias("context")).select("p_partkey", "context", C.chunk_size(F.col("context")).alias("chunk"), C.chunk_size(F.col("context"), True).alias("query_chunk"))


def factor_steps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_join(C.factor_steps(F.col("p_size") / 8.0), ",").alias("steps"))


def title_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", C.title_key(F.replace(F.upper("p_name"), F.lit(" "), F.lit("_"))).alias("title"))


def word_range(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", C.word_hits(F.col("text"), ["merging", "fusion"], 50, 120).alias("hits"))


def fill_label(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("Title: "), F.coalesce("title", F.lit("-")), F.when(F.col("paper_id") % 2 == 0, F.lit(" DOI: unknown")).otherwise(F.lit(" end")))
    return table(spark, d, "papers").select("paper_id", C.filled_label(text, "DOI: unknown", F.coalesce("doi", F.lit(""))).alias("text"))


def query_strings(spark: SparkSession, d: str) -> DataFrame:
    terms = F.split("search_name", "-")
    return table(spark, d, "searches").select("search_name", C.any_of_all(F.array(terms, F.array(F.lit("review"), F.lit("survey")))).alias("boolean"), F.array_join(terms, " AND ").alias("flat"), F.array_join(terms, " ").alias("words"))


# The columns a report may show: width, whether right-aligned, and what stands in them.
REPORT = {
    "name": (12, False, lambda: F.col("p_name")),
    "kind": (8, False, lambda: F.col("p_type")),
    "size": (6, True, lambda: S.human_bytes(F.col("p_size") * 1_000_000)),
    "key": (8, True, lambda: C.short_count(F.col("p_partkey") * 1000)),
}


def text_table(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", C.table_line(REPORT, ["name", "kind", "key"]).alias("line"))


def markdown_report(spark: SparkSession, d: str) -> DataFrame:
    """A section for each brand: a heading and a table of its types."""
    counted = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.max("p_size").alias("most"))
    line = F.format_string("| %s | %d | %d |", "p_type", "n", "most")
    lines = counted.groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_type", line.alias("line")))), lambda x: x["line"]).alias("l"))
    return lines.select("p_brand", F.concat(F.lit("## "), "p_brand", F.lit("\n\n| type | parts | largest |\n| --- | --- | --- |\n"), F.array_join("l", "\n"), F.lit("\n")).alias("section"))


def install_lines(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    side = lambda r: part.where(F.col("p_partkey") % 2 == r).groupBy(F.col("p_name").alias("name")).agg(F.min("p_brand").alias("version"))
    both = joins.two_way_difference(side(0), side(1), "name", "version")
    line = lambda verb, c: both.where(F.col(c).isNotNull()).select(F.lit(verb).alias("verb"), F.concat("name", F.lit("=="), c).alias("item"))
    items = line("uninstall", "version_a").unionByName(line("install", "version_b"))
    return items.groupBy("verb").agg(F.array_join(F.array_sort(F.collect_list("item")), " ").alias("items")).select("verb", F.concat_ws(" ", F.lit("pip"), "verb", "items").alias("command"))


def json_sink(spark: SparkSession, d: str) -> DataFrame:
    nested = F.struct("p_name", F.struct("p_size", F.col("p_brand")).alias("facts"), F.array("p_type").alias("tags"))
    return table(spark, d, "part").select("p_partkey", F.to_json(nested).alias("json"))


def prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "chunks").select(F.col("rel_path").alias("name"), "item_no")
    asked = items.select(F.when(F.col("item_no") % 7 == 0, F.col("name")).otherwise(F.left("name", F.lit(12))).alias("query")).distinct()
    return joins.named_or_prefixed(asked, "query", items, "name", "item_no")


def sizes_or_zero(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "lineitem").where("l_quantity > 40").groupBy("l_orderkey").agg(F.max("l_quantity").alias("most"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")).join(sizes, "l_orderkey", "left").select("l_orderkey", F.coalesce("most", F.lit(0.0)).alias("most"))


def source_caps(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 records of every archive in the order of their numbers."""
    ranked = table(spark, d, "papers").select("paper_id", F.lower(F.trim("source")).alias("source")).withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("paper_id")))
    return ranked.where("n <= 50").select("source", "paper_id")


def k_bounds(spark: SparkSession, d: str) -> DataFrame:
    least, most = retrieval.k_bounds(F.col("p_size") % 9, F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", least.alias("least"), most.alias("most"), F.round(retrieval.score_distance(F.col("p_size").cast("double")), 9).alias("distance"))


def bm25_indexed(spark: SparkSession, d: str) -> DataFrame:
    index = retrieval.Postings.build(table(spark, d, "documents"), "doc_id", "text")
    return index.search(analytics.QUERY).select("doc", F.round("score", 6).alias("score"))


def bm25_best(spark: SparkSession, d: str) -> DataFrame:
    index = retrieval.Postings.build(table(spark, d, "documents"), "doc_id", "text")
    return retrieval.top(index.search(analytics.QUERY).withColumn("score", F.round("score", 6)), 10, F.desc("score"), F.col("doc")).select("doc", "score", "rank")


def fresh_cache(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "incoming_papers").select("record_id", F.col("delivered_at").alias("fetched_at"))
    return files.fresh(kept, "fetched_at", F.lit("2025-09-01").cast("timestamp_ntz"), 200 * 86400).select("record_id")


def coverage_xml_merged(spark: SparkSession, d: str) -> DataFrame:
    """Three reports written as XML, one path that holds none; read, merged and reported by file."""
    facts, home = analytics._facts(spark, d), scratch_path(spark, "reports")
    branch = F.when(F.col("br_total").isNotNull(), F.format_string(' branch="true" condition-coverage="0%% (%d/%d)"', "br_taken", "br_total")).otherwise("")
    line = F.format_string('<class filename="f%d"><lines><line number="%d" hits="%d"%s/></lines></class>', "file", "line", "hits", branch)
    for n in range(3):
        classes = facts.where(F.col("ord") == n).groupBy((F.col("file") % 64).alias("part")).agg(F.array_join(F.collect_list(line), "\n").alias("body"))
        classes.select("part", F.concat(F.lit("<coverage>\n"), "body", F.lit("\n</coverage>")).alias("value")).write.partitionBy("part").text(f"{home}/{n}")
    read = files.coverage_reports(spark, [f"{home}/0", f"{home}/1", f"{home}/none", f"{home}/2"])
    merged = coverage.merge(read.withColumn("ord", F.when(F.col("ord") > 1, F.col("ord") - 1).otherwise(F.col("ord"))))
    return coverage.report(merged, ["file"]).withColumn("file", F.substring("file", 2, 20).cast("bigint"))


def diff_coverage_full(spark: SparkSession, d: str) -> DataFrame:
    facts = analytics._facts(spark, d).groupBy("file", "line").agg(F.max("hits").alias("hits"))
    lines = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("file"), (F.col("o_custkey") % 9).alias("line"))
    return coverage.changed(facts, lines, full=True)


def containment_first(spark: SparkSession, d: str) -> DataFrame:
    """Per listed title the DOI of the first paper whose title holds it or is held by it, whole words counting."""
    clean = lambda c: F.trim(F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", " ")))
    a = table(spark, d, "shelf_papers").select(F.col("shelf_id").alias("a_id"), clean("title").alias("a_text"))
    papers = table(spark, d, "papers").where("doi is not null and doi <> ''")
    found = joins.contains_words(a, papers.select(F.col("paper_id").alias("b_id"), clean("title").alias("b_text")))
    first = found.groupBy(F.col("a_id").alias("shelf_id")).agg(F.min("b_id").alias("paper_id"))
    return first.join(papers.select("paper_id", "doi"), "paper_id").select("shelf_id", "doi")


def alias_or_own(spark: SparkSession, d: str) -> DataFrame:
    """Names by content hash; rows without a hash stay rows of their own."""
    rows = table(spark, d, "chunks").select(F.when(F.col("item_no") % 5 > 0, F.col("chunk_id")).alias("hash"), "item_no", "rel_path")
    return groups.aliases(rows, "hash", "rel_path", "item_no")


def text_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 512).alias("sha512"))


def strip_ansi(spark: SparkSession, d: str) -> DataFrame:
    shown = F.concat(F.lit("\x1b[1;31m"), "p_name", F.lit("\x1b[0m "), F.col("p_size").cast("string"), F.lit("\x1b[K"))
    return table(spark, d, "part").select("p_partkey", S.strip_ansi(shown).alias("text"))


def text_test(spark: SparkSession, d: str) -> DataFrame:
    tail = F.when(F.col("doc_id") % 4 == 1, F.lit(bytearray(1))).when(F.col("doc_id") % 4 == 2, F.lit(bytearray([0xFF, 0x41]))).when(F.col("doc_id") % 4 == 3, F.lit(bytearray([0x70, 0x09, 0x71, 0x00]))).otherwise(F.lit(bytearray()))
    return table(spark, d, "documents").where("text is not null").select("doc_id", files.is_text(F.concat(F.encode("text", "utf-8"), tail)).alias("is_text"))


def indexed_files(spark: SparkSession, d: str) -> DataFrame:
    """The tools of a code index: its files by pattern, each put together from its active chunks (digest of the text)."""
    active = table(spark, d, "chunks").where("active and text is not null")
    paths = active.select("file_path").distinct().where(F.col("file_path").rlike(r"(?i)\.(md|py)$"))
    pieces = F.struct(F.col("byte_offset").alias("start"), (F.col("byte_offset") + F.octet_length(F.encode("text", "utf-8"))).alias("end"), F.encode("text", "utf-8").alias("bytes"))
    return active.join(paths, "file_path", "left_semi").groupBy("file_path").agg(F.array_sort(F.collect_set(pieces)).alias("p")).select("file_path", F.size("p").alias("pieces"), F.get("p", F.lit(0))["start"].alias("first_byte"))


def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    from tessella.streaming.streams import windowed_counts as counts

    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return counts(e, "ts", "event_type").select(F.unix_seconds("start").alias("start"), "event_type", "n")


def tab_table(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name", F.when(F.col("p_size") % 5 > 0, F.col("p_brand")))
    return files.table_of_tabs(table(spark, d, "part").select(line.alias("value")), ["id", "name", "brand"]).select(F.col("id").cast("bigint").alias("id"), "name", "brand")


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and k[0] != "_"}

_INFO_SQL = "case when p_size % 3 = 0 then 8192 end"

SQL = {
    "memory_heuristic": """with r as (select p_partkey, p_size % 9 as gb, case p_size % 3 when 0 then 4.5 when 1 then 32.0 else 16.0 end as bits, case when p_size % 4 > 0 then p_partkey * 64 end as ctx from part)
        select p_partkey, round(case when gb > 0 then case when ctx > 0 then gb * (1.5 + bits / 32 * 0.5 + least(ctx / 32768, 4.0) * 0.5) else gb * 2.0 end end, 6) as gb from r""",
    "short_forms": """with r as (select l_orderkey, l_linenumber, l_orderkey * l_partkey as n from lineitem) select l_orderkey, l_linenumber,
        case when n < 1000000 then n::varchar when n < 1000000000 then (n // 1000)::varchar || 'k' else (n // 1000000)::varchar || 'M' end as downloads,
        case when n >= 10240000 then (n // 1048576)::varchar || 'M' when n >= 10000 then (n // 1024)::varchar || 'k' when n > 0 then n::varchar || ' ' else '' end as context from r""",
    "markdown_escape": r"""with r as (select doc_id, text, repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0) + 1)::bigint) as f, regexp_matches(text, '[*_`\[\]()>+\\]|[#=-]+(\s|$)|(\r?\n){2,}', 'm') or regexp_matches(text, '(?m)[#=-]+$') as s,
        case when length(text) > 2000 then left(text, 2000) || '...' else text end as b from documents)
        select doc_id, case when s then chr(10) || f || chr(10) || b || chr(10) || f || chr(10) else text end as markdown, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as html from r""",
    "origin_of": "select p_partkey, case when p_size % 3 < 2 then 'huggingface' else 'ollama' end as origin from part",
    "timestamp_text": "select o_orderkey, case o_orderkey % 4 when 3 then null else strftime(o_orderdate - case when o_orderkey % 4 = 2 then interval 2 hour else interval 0 hour end, '%Y-%m-%d %H:%M:%S UTC') end as shown from orders",
    "int_lenient": "select p_partkey, cast(case p_size % 4 when 0 then p_size * 1000 + 345 when 2 then -p_size else 0 end as bigint) as n from part",
    "doi_from_name": "select p_partkey, case when p_size % 2 = 0 then '10.1109/TSE.2019.' || p_partkey end as doi from part",
    "arch_params": """select p_partkey, cast(p_size as bigint) as num_layers, cast(case when p_size % 2 = 0 then ceil((p_size + 5) / 3.0) else p_size end as bigint) as num_kv_heads, cast(case when p_size % 3 = 0 then 128 else p_partkey * 2 end as bigint) as head_dim,
        cast(case when p_size % 3 = 0 then 8192 end as bigint) as context_length, cast(p_partkey * 16 as bigint) as embedding_length from part""",
    "context_sizes": """with r as (select p_partkey, cast(case when p_size % 3 = 0 then 8192 when p_size % 5 > 1 then p_size * 100 else 2048 end as int) as context from part)
        select p_partkey, context, cast(least(4096, greatest(256, context * 3 // 4)) as int) as chunk, cast(greatest(256, context * 3 // 4) as int) as query_chunk from r""",
    "factor_steps": """with r as (select p_partkey, p_size / 8.0 as f, greatest(0, ceil(log2(p_size / 8.0)) - 1)::int as up, greatest(0, -floor(log2(p_size / 8.0)) - 1)::int as down from part)
        select p_partkey, array_to_string(list_concat(list_concat(list_transform(range(up), lambda i: 'atempo=2.0'), list_transform(range(down), lambda i: 'atempo=0.5')), case when f / pow(2, up) * pow(2, down) <> 1 then ['atempo=' || printf('%5.3f', f / pow(2, up) * pow(2, down))] else [] end), ',') as steps from r""",
    "title_key": "select p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as title from part",
    "word_range": r"select doc_id, cast(contains(lower(text), 'merging') or contains(lower(text), 'fusion') as int) + cast(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) between 51 and 119 as int) as hits from documents where text is not null",
    "fill_label": "select paper_id, 'Title: ' || coalesce(title, '-') || case when paper_id % 2 = 1 then ' end' when coalesce(doi, '') <> '' then ' DOI: unknown ' || doi else ' DOI: unknown' end as text from papers",
    "query_strings": """select search_name, '("' || replace(search_name, '-', '" OR "') || '") AND ("review" OR "survey")' as boolean, replace(search_name, '-', ' AND ') as flat, replace(search_name, '-', ' ') as words from searches""",
    "text_table": """with r as (select p_partkey, p_name as a, p_type as b, case when p_partkey < 1000 then (p_partkey * 1000)::varchar when p_partkey < 1000000 then p_partkey::varchar || 'k' else (p_partkey // 1000)::varchar || 'M' end as c from part)
        select p_partkey, rpad(case when length(a) > 12 then left(a, 9) || '...' else a end, 12, ' ') || ' ' || rpad(case when length(b) > 8 then left(b, 5) || '...' else b end, 8, ' ') || ' ' || lpad(case when length(c) > 8 then left(c, 5) || '...' else c end, 8, ' ') as line from r""",
    "markdown_report": """with c as (select p_brand, p_type, count(*) as n, max(p_size) as most from part group by 1, 2)
        select p_brand, '## ' || p_brand || chr(10) || chr(10) || '| type | parts | largest |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || p_type || ' | ' || n || ' | ' || most || ' |', chr(10) order by p_type) || chr(10) as section from c group by p_brand""",
    "install_lines": """with a as (select p_name as name, min(p_brand) as v from part where p_partkey % 2 = 0 group by 1), b as (select p_name as name, min(p_brand) as v from part where p_partkey % 2 = 1 group by 1),
        i as (select 'uninstall' as verb, name || '==' || v as item from (select * from a except select * from b) union all select 'install', name || '==' || v from (select * from b except select * from a))
        select verb, 'pip ' || verb || ' ' || string_agg(item, ' ' order by item) as command from i group by verb""",
    "json_sink": """select p_partkey, '{"p_name":"' || p_name || '","facts":{"p_size":' || p_size || ',"p_brand":"' || p_brand || '"},"tags":["' || p_type || '"]}' as json from part""",
    "prefix_lookup": """with q as (select distinct case when item_no % 7 = 0 then rel_path else left(rel_path, 12) end as query from chunks)
        select query, coalesce((select max(item_no) from chunks where rel_path = query), (select max(item_no) from chunks where starts_with(rel_path, query))) as item_no, coalesce((select max(item_no) from chunks where rel_path = query) is not null, false) as exact from q""",
    "sizes_or_zero": "select o_orderkey as l_orderkey, coalesce((select max(l_quantity) from lineitem where l_orderkey = o_orderkey and l_quantity > 40), 0.0) as most from orders",
    "source_caps": "select source, paper_id from (select lower(trim(source, ' ')) as source, paper_id, row_number() over (partition by lower(trim(source, ' ')) order by paper_id) as n from papers) where n <= 50",
    "k_bounds": "select p_partkey, cast(least(greatest(1, (p_size % 9) // 2), p_size) as int) as least, cast(least((p_size % 9) * 2, p_size) as int) as most, round(1.0::double / (1.0::double + p_size), 9) as distance from part",
    "bm25_indexed": analytics.SQL["bm25_search"],
    "bm25_best": f"select doc, score, row_number() over (order by score desc, doc) as rank from ({analytics.SQL['bm25_search']}) order by rank limit 10",
    "fresh_cache": "select record_id from incoming_papers where delivered_at > timestamp '2025-09-01' - interval 200 day and delivered_at <= timestamp '2025-09-01'",
    "coverage_xml_merged": analytics.SQL["coverage_report"],
    "diff_coverage_full": f"with {analytics._FACTS} select file, line, max(hits) as hits from fa where file in (select o_orderkey from orders where o_orderkey % 3 = 0) group by 1, 2",
    "containment_first": """with a as (select shelf_id, ' ' || trim(lower(regexp_replace(title, '[^A-Za-z0-9]+', ' ', 'g'))) || ' ' as x from shelf_papers), b as (select paper_id, doi, ' ' || trim(lower(regexp_replace(title, '[^A-Za-z0-9]+', ' ', 'g'))) || ' ' as y from papers where doi <> '')
        select shelf_id, arg_min(doi, paper_id) as doi from a join b on length(x) > 2 and length(y) > 2 and (contains(x, y) or contains(y, x)) group by shelf_id""",
    "alias_or_own": """with r as (select case when item_no % 5 > 0 then chunk_id end as hash, item_no, rel_path from chunks)
        select hash, array_to_string(list_sort(list_distinct(list(rel_path))), '|') as names, min(item_no) as first from r group by hash, case when hash is null then item_no end""",
    "strip_ansi": "select p_partkey, p_name || ' ' || p_size as text from part",
    "text_test": "select doc_id, doc_id % 4 = 0 and not contains(text, chr(0)) as is_text from documents where text is not null",
    "indexed_files": r"""with r as (select distinct file_path, byte_offset, text from chunks where active and text is not null and regexp_matches(file_path, '(?i)\.(md|py)$')) select file_path, cast(count(*) as int) as pieces, min(byte_offset) as first_byte from r group by 1""",
    "windowed_counts": "select epoch(date_trunc('hour', ts))::bigint as start, event_type, count(*) as n from events group by 1, 2",
    "tab_table": "select p_partkey as id, p_name as name, p_brand as brand from part where p_size % 5 > 0",
}
