"""Queries of the scalar functions, each over a whole table, with texts of the needed shapes made from its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.sources.tables import table


def _part(spark: SparkSession, d: str, expr: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.expr(expr).alias("t"))


_NAME = "concat(p_name, case p_size % 7 when 0 then '-Q6_K_L.gguf' when 1 then '-bf16' when 2 then '-q4-k-m' when 3 then '_Q2_K_S.GGUF' when 4 then '-00001-of-00003.gguf' when 5 then '.iq3_xxs' else '' end)"
_COUNT = "case p_size % 8 when 0 then concat(p_size, '.5M') when 1 then concat(p_size, ',', 123) when 2 then 'abc' when 3 then '0' when 4 then concat(p_size, 'b') when 5 then concat(' ', p_size, 'k ') when 6 then '' else concat(p_partkey, ',') end"
_SIZE = "case p_size % 6 when 0 then concat(p_size, 'MB') when 1 then concat(p_size, '.5 GB') when 2 then concat(p_size, 'tb') when 3 then '' when 4 then concat(p_size, 'K') else cast(p_size as varchar(9)) end"
_DURATION = "case p_size % 5 when 0 then concat(p_size, ':02:03.5') when 1 then cast(p_size as varchar(9)) when 2 then concat('a:', p_size) when 3 then concat(p_size, ':30') else concat(' ', p_size, '.25') end"
_TICKS = "case p_size % 4 when 0 then 'a ``` b ```` c' when 1 then 'x `y` z' when 2 then 'none' else '``````' end"
_REASON = "case p_size % 3 when 0 then concat('<think>a</think> ', p_name, ' ') when 1 then p_name else concat('<think>x</think>y</think>', p_size) end"
_BRACE = "case p_size % 3 when 0 then concat('say {\"a\": {\"b\": ', p_size, '}} end') when 1 then 'no object' else '} {' end"
_FENCE = "case p_size % 3 when 0 then concat('Here:', chr(10), '```json', chr(10), '{\"v\": ', p_size, '}', chr(10), '```', chr(10), 'end') when 1 then concat(' ', p_name, ' ') else concat('```', chr(10), p_name, chr(10), '```') end"
_KINDS = "case p_size % 6 when 0 then concat('Qwen2-Coder-', p_size) when 1 then concat('llava-', p_size) when 2 then 'nomic-embed' when 3 then 'geochat' when 4 then 'Extractor' else 'plain' end"
_FILE = "case p_size % 4 when 0 then concat('a/b:', p_name, '?. ') when 1 then '. .' when 2 then concat(p_name, '|x*') else p_name end"


def quant_extract(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d, _NAME).select("p_partkey", S.quant_format(F.col("t")).alias("quant"))


def type_classify(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d, _KINDS).select("p_partkey", S.kind_of(F.col("t")).alias("kind"))


def parse_count(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d, _COUNT).select("p_partkey", S.count_lenient(F.col("t")).alias("lenient"), S.count_strict(F.col("t")).alias("strict"))


def parse_size(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d, _SIZE).select("p_partkey", F.round(S.size_in_gb(F.col("t")), 6).alias("gb"), S.context_length(F.col("t")).alias("context"))


def human_bytes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.human_bytes(F.floor(F.col("l_extendedprice") * F.col("l_orderkey")).cast("bigint")).alias("shown"))


def duration_codec(spark: SparkSession, d: str) -> DataFrame:
    seconds = S.parse_duration(F.col("t"))
    return _part(spark, d, _DURATION).select("p_partkey", F.round(seconds, 3).alias("seconds"), S.format_duration(seconds).alias("shown"))


def tag_format(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d, _NAME).select("p_partkey", S.tag_of_file(F.col("t")).alias("tag"))


def safe_name(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d, _FILE).select("p_partkey", S.safe_name(F.col("t")).alias("file"), S.safe_title(F.col("t")).alias("title"))


def fence(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d, _TICKS).select("p_partkey", S.fence_for(F.col("t")).alias("fence"))


def strip_reasoning(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d, _REASON).select("p_partkey", S.after_reasoning(F.col("t")).alias("answer"))


def json_braces(spark: SparkSession, d: str) -> DataFrame:
    found = S.braces(F.col("t"))
    return _part(spark, d, _BRACE).select("p_partkey", found.alias("found"), F.get_json_object(found, "$.a.b").alias("b"))


def strip_fence(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d, _FENCE).select("p_partkey", S.strip_fence(F.col("t")).alias("body"))


def truncate_middle(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.middle_out(F.col("text"), 600).alias("short"))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("item_no", S.content_id(F.col("file_sha"), F.col("byte_offset"), F.col("text")).alias("content_id"))


def base64_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.data_url(F.col("text")).alias("url"))


def cnf_filter(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws(" ", "title", "abstract")
    return table(spark, d, "papers").where(S.all_of_any(text, [["merging", "fusion", "Pooling"], ["oncology", "banking", "geology"]])).select("paper_id", "source")


def regex_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").where(F.col("title").rlike("(?i)toolkit for .*(caching|tuning)")).select("paper_id", "title")


def include_exclude(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("rel_path")
    return table(spark, d, "chunks").where((path.rlike(r"\.(py|md)$") | (path == "acoustics/releases/coverage_00029.log")) & ~path.rlike("(^|/)logs?/")).select("item_no", "rel_path")


def path_component_filter(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split(F.replace("rel_path", F.lit("\\"), F.lit("/")), "/")
    return table(spark, d, "chunks").where(~F.exists(parts, lambda p: p.rlike("^(tables|logs.*|.*_0000[0-9].*)$"))).select("item_no", "rel_path")


def map_filter_prefix(spark: SparkSession, d: str) -> DataFrame:
    kept = F.map_filter("extra", lambda k, v: ~k.startswith("r"))
    return table(spark, d, "papers").where("extra is not null").select("paper_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("kept"), F.size(kept).alias("n"))


def map_regex_get(spark: SparkSession, d: str) -> DataFrame:
    hits = F.filter(F.map_entries("extra"), lambda e: e["key"].rlike("^r[a-z]+$") & e["value"].rlike("^[0-9]+$"))
    return table(spark, d, "papers").select("paper_id", F.try_element_at(hits, F.lit(1))["value"].try_cast("int").alias("value"))


def fit_dims(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.col("p_partkey") % 3000 + 1, F.col("p_size") * 40 + 1
    scale = F.least(F.lit(1.0), F.lit(1024.0) / F.greatest(w, h))
    return table(spark, d, "part").select("p_partkey", F.floor(w * scale).alias("w"), F.floor(h * scale).alias("h"))


def clamp_box(spark: SparkSession, d: str) -> DataFrame:
    left, right = F.greatest(F.lit(0), F.col("p_size") * 3 - 4), F.least(F.lit(100), F.col("p_size") * 3 + F.col("p_partkey") % 9 + 4)
    return table(spark, d, "part").select("p_partkey", F.when(right > left, left).alias("left"), F.when(right > left, right).alias("right"))


def grid_position(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 7).alias("row"), (F.col("event_id") % 7).alias("col"))


def mount_parse(spark: SparkSession, d: str) -> DataFrame:
    t = F.expr("case p_size % 3 when 0 then concat('C:', p_name, ':/data:rw') when 1 then concat(p_name, ':/data') else concat('/a/', p_name, ':/b:ro') end")
    got = lambda k: F.regexp_extract(t, "^(.*?):(/[^:]*)(?::(ro|rw))?$", k)
    return table(spark, d, "part").select("p_partkey", got(1).alias("src"), got(2).alias("dst"), F.when(got(3) == "", "ro").otherwise(got(3)).alias("mode"))


def zip_pad(spark: SparkSession, d: str) -> DataFrame:
    zipped = F.posexplode(F.arrays_zip(F.split("p_name", " ").alias("word"), F.split("p_type", " ").alias("kind")))
    return table(spark, d, "part").select("p_partkey", zipped.alias("pos", "z")).select("p_partkey", "pos", F.coalesce("z.word", F.lit("-")).alias("word"), F.coalesce("z.kind", F.lit("-")).alias("kind"))


def inverted_to_text(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "eval_items").select("item_id", F.posexplode(F.split("text", " ")).alias("p", "w")).groupBy("item_id", "w").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    maps = words.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("positions"))
    return maps.select("item_id", S.words_from_positions(F.col("positions")).alias("text"))


def vector_check(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.size(e).alias("dims"), F.exists(e, lambda x: x != 0).alias("any_nonzero"), F.round(100.0 * F.size(F.filter(e, lambda x: x > 0)) / F.size(e), 2).alias("positive_percent"))


def property_rows(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "part").select("p_partkey", F.coalesce("p_brand", F.lit("unknown")).alias("Brand"), F.coalesce("p_type", F.lit("none")).alias("Type"), F.format_number(F.col("p_partkey") * 1000, 0).alias("Key"), F.floor(F.sqrt(F.col("p_size") * 100)).cast("string").alias("Edge"))
    return wide.unpivot("p_partkey", ["Brand", "Type", "Key", "Edge"], "property", "value")


def distance_to_range(spark: SparkSession, d: str) -> DataFrame:
    off = S.to_range(F.col("n_chars"), 400, 600)
    return table(spark, d, "documents").where(off < 100).select("doc_id", off.alias("distance"))


def json_parse_tolerant(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.from_json("metadata", "citation_count int, is_open_access boolean, url string, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    return table(spark, d, "seen_papers").select("record_id", parsed.alias("j")).select("record_id", (F.col("j.broken").isNull()).alias("whole"), F.when(F.col("j.broken").isNull(), F.col("j.citation_count")).alias("citations"))


def digest_extract(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all(F.lower("identity"), F.lit("([0-9a-f]{64})"))
    return table(spark, d, "seen_papers").select(F.explode(found).alias("digest")).groupBy("digest").agg(F.count("*").alias("n"))


def kv_list_parse(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "part").select("p_partkey", F.explode(F.split(F.concat(F.replace("p_name", F.lit(" "), F.lit("==")), F.lit(",# skip,bare\n"), F.col("p_brand"), F.lit("==1")), "[\n,]")).alias("item"))
    return listed.where("item like '%==%' and not startswith(item, '#')").select("p_partkey", F.split_part("item", F.lit("=="), F.lit(1)).alias("name"), F.split_part("item", F.lit("=="), F.lit(2)).alias("version"))


def log_probe(spark: SparkSession, d: str) -> DataFrame:
    stamps = F.regexp_extract_all("text", F.lit(r"(\d{4}-\d\d-\d\d \d\d:\d\d) (?:INFO|WARN|ERROR)"))
    return table(spark, d, "chunks").where("lower(rel_path) like '%.log'").select("item_no", F.size(stamps).alias("lines"), F.try_element_at(stamps, F.lit(-1)).alias("last"), F.size(F.regexp_extract_all("text", F.lit("( ERROR )"))).alias("errors"))


def embedded_json(spark: SparkSession, d: str) -> DataFrame:
    script = F.concat(F.lit("var a = 1; spec = "), F.col("props"), F.lit("; var b = {};"))
    return table(spark, d, "events").select("event_id", F.get_json_object(F.regexp_extract(script, r"spec = (\{.*?\});", 1), "$.k").try_cast("int").alias("k"))


def md_images(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("a ![one]("), F.col("p_brand"), F.lit(".png) b ![two](x/"), F.col("p_size").cast("string"), F.lit(".jpg)"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)]*)\)"), 1), "|").alias("targets"), F.regexp_replace(text, r"!\[([^\]]*)\]\([^)]*\)", "<$1>").alias("spliced"))


def status_label(spark: SparkSession, d: str) -> DataFrame:
    hits, needed = F.when(F.col("p_size") % 5 > 0, F.col("p_size") % 4), F.lit(1) + F.col("p_partkey").cast("int") % 3
    label = S.status_label(hits, needed)
    return table(spark, d, "part").select("p_partkey", label.alias("status"), F.round(S.status_score(label), 6).alias("score"))


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and k[0] != "_"}

_SQL_QUANT = " ".join(f"when contains(n, '{q}') then '{q}'" for q, _, _ in S.QUANT_FORMATS)
_SQL_KIND = " ".join(f"when regexp_matches(lower(t), '{p}') then '{k}'" for k, p in S.KIND_PATTERNS)
_SCALE = "case right(upper(t), 1) when 'K' then 1e3 when 'M' then 1e6 when 'B' then 1e9 end"
_HUMAN = "case when n < 100000 then lpad(cast(n as varchar), 5, ' ') || ' ' " + " ".join(f"when length(printf('%.3f', n / {float(1 << (10 * k))})) <= 7 then left(printf('%.3f', n / {float(1 << (10 * k))}), 5) || '{u}'" for k, u in enumerate(["", "k", "M", "G", "T", "P"])) + " end"

SQL = {
    "quant_extract": f"select p_partkey, case {_SQL_QUANT} else 'UNKNOWN' end as quant from (select p_partkey, replace(upper({_NAME}), '-', '_') as n from part)",
    "type_classify": f"select p_partkey, case {_SQL_KIND} end as kind from (select p_partkey, {_KINDS} as t from part)",
    "parse_count": f"""with a as (select p_partkey, {_COUNT} as raw from part), b as (select p_partkey, raw, replace(trim(raw), ',', '') as t from a), c as (select *, {_SCALE} as s from b)
        select p_partkey, coalesce(case when s is not null then cast(floor(try_cast(left(t, length(t) - 1) as double) * s + 1e-6) as bigint) else try_cast(t as bigint) end, 0) as lenient,
        case when s is not null then cast(floor(try_cast(left(t, length(t) - 1) as double) * s + 1e-6) as bigint) when regexp_matches(rtrim(trim(raw), ','), '^\\d+$') and try_cast(rtrim(trim(raw), ',') as bigint) > 0 then try_cast(rtrim(trim(raw), ',') as bigint) end as strict from c""",
    "parse_size": f"""with a as (select p_partkey, upper(trim({_SIZE})) as t from part)
        select p_partkey, round(coalesce(case right(t, 2) when 'GB' then try_cast(left(t, length(t) - 2) as double) when 'MB' then try_cast(left(t, length(t) - 2) as double) / 1024 when 'TB' then try_cast(left(t, length(t) - 2) as double) * 1024 else try_cast(t as double) end, 0), 6) as gb,
        case when t like '%K' then cast(floor(try_cast(left(t, length(t) - 1) as double) * 1024) as bigint) when t like '%M' then cast(floor(try_cast(left(t, length(t) - 1) as double) * 1048576) as bigint) when regexp_matches(t, '^\\d+$') then try_cast(t as bigint) end as context from a""",
    "human_bytes": f"select l_orderkey, l_linenumber, {_HUMAN} as shown from (select *, cast(floor(l_extendedprice * l_orderkey) as bigint) as n from lineitem)",
    "duration_codec": f"""with a as (select p_partkey, string_split(trim({_DURATION}), ':') as p from part),
        b as (select p_partkey, case len(p) when 1 then try_cast(p[1] as double) when 2 then try_cast(p[1] as double) * 60 + try_cast(p[2] as double) else try_cast(p[1] as double) * 3600 + try_cast(p[2] as double) * 60 + try_cast(p[3] as double) end as s from a), c as (select *, cast(floor(s) as bigint) as i from b)
        select p_partkey, round(s, 3) as seconds, case when s < 3600 then printf('%d:%02d', i // 60, i % 60) when s is not null then printf('%d:%02d:%02d', i // 3600, (i // 60) % 60, i % 60) end as shown from c""",
    "tag_format": f"select p_partkey, upper(case when contains(b, '-') then string_split(b, '-')[-1] else string_split(b, '_')[-1] end) as tag from (select p_partkey, regexp_replace(regexp_replace({_NAME}, '(?i)\\.gguf$', ''), '-[0-9]{{5}}-of-[0-9]{{5}}$', '') as b from part)",
    "safe_name": f"""select p_partkey, case when f = '' then 'unnamed' else f end as file, left(regexp_replace(t, '[^A-Za-z0-9]', '_', 'g'), 80) as title
        from (select p_partkey, {_FILE} as t, regexp_replace(regexp_replace({_FILE}, '[<>:"/\\\\|?*]', '_', 'g'), '[ .]+$', '') as f from part)""",
    "fence": f"select p_partkey, repeat('`', cast(greatest(3, coalesce(list_max(list_transform(regexp_extract_all({_TICKS}, '`+'), lambda x: length(x))), 0) + 1) as int)) as fence from part",
    "strip_reasoning": f"select p_partkey, trim(string_split({_REASON}, '</think>')[-1]) as answer from part",
    "json_braces": f"select p_partkey, nullif(f, '') as found, case when f <> '' then json_extract_string(f, '$.a.b') end as b from (select p_partkey, regexp_extract({_BRACE}, '(?s)\\{{.*\\}}') as f from part)",
    "strip_fence": f"select p_partkey, regexp_replace(case when contains(t, '```') then regexp_extract(t, '(?s)```[^\\n]*\\n(.*?)```', 1) else t end, '^\\s+|\\s+$', '', 'g') as body from (select p_partkey, {_FENCE} as t from part)",
    "truncate_middle": "select doc_id, case when length(text) > 600 then left(text, 300) || chr(10) || '...' || chr(10) || right(text, 300) else text end as short from documents",
    "content_hash": "select doc_id, sha256(text) as sha256, md5(text) as md5 from documents",
    "chunk_ids": "select item_no, left(sha256(concat_ws(':', file_sha, cast(byte_offset as varchar), text)), 32) as content_id from chunks",
    "base64_text": "select doc_id, 'data:text/plain;base64,' || to_base64(encode(text)) as url from documents",
    "cnf_filter": "select paper_id, source from (select *, lower(concat_ws(' ', title, abstract)) as t from papers) where (contains(t, 'merging') or contains(t, 'fusion') or contains(t, 'pooling')) and (contains(t, 'oncology') or contains(t, 'banking') or contains(t, 'geology'))",
    "regex_filter": "select paper_id, title from papers where regexp_matches(title, '(?i)toolkit for .*(caching|tuning)')",
    "include_exclude": "select item_no, rel_path from chunks where (regexp_matches(rel_path, '\\.(py|md)$') or rel_path = 'acoustics/releases/coverage_00029.log') and not regexp_matches(rel_path, '(^|/)logs?/')",
    "path_component_filter": "select item_no, rel_path from chunks where len(list_filter(string_split(replace(rel_path, chr(92), '/'), '/'), lambda p: regexp_matches(p, '^(tables|logs.*|.*_0000[0-9].*)$'))) = 0",
    "map_filter_prefix": "select paper_id, array_to_string(list_sort(list_filter(map_keys(extra), lambda k: not starts_with(k, 'r'))), ',') as kept, len(list_filter(map_keys(extra), lambda k: not starts_with(k, 'r'))) as n from papers where extra is not null",
    "map_regex_get": "select paper_id, try_cast(list_filter(map_entries(extra), lambda e: regexp_full_match(e.key, 'r[a-z]+') and regexp_full_match(e.value, '[0-9]+'))[1].value as int) as value from papers",
    "fit_dims": "select p_partkey, cast(floor(w * s) as bigint) as w, cast(floor(h * s) as bigint) as h from (select *, least(1.0, 1024.0::double / greatest(w, h)) as s from (select p_partkey, p_partkey % 3000 + 1 as w, p_size * 40 + 1 as h from part))",
    "clamp_box": "select p_partkey, case when r > l then l end as left, case when r > l then r end as right from (select p_partkey, greatest(0, p_size * 3 - 4) as l, least(100, p_size * 3 + p_partkey % 9 + 4) as r from part)",
    "grid_position": "select event_id, event_id // 7 as row, event_id % 7 as col from events",
    "mount_parse": """select p_partkey, regexp_extract(t, '^(.*?):(/[^:]*)(?::(ro|rw))?$', 1) as src, regexp_extract(t, '^(.*?):(/[^:]*)(?::(ro|rw))?$', 2) as dst, coalesce(nullif(regexp_extract(t, '^(.*?):(/[^:]*)(?::(ro|rw))?$', 3), ''), 'ro') as mode
        from (select p_partkey, case p_size % 3 when 0 then concat('C:', p_name, ':/data:rw') when 1 then concat(p_name, ':/data') else concat('/a/', p_name, ':/b:ro') end as t from part)""",
    "zip_pad": "select p_partkey, i - 1 as pos, coalesce(a[i], '-') as word, coalesce(b[i], '-') as kind from (select *, unnest(range(1, greatest(len(a), len(b)) + 1)) as i from (select p_partkey, string_split(p_name, ' ') as a, string_split(p_type, ' ') as b from part))",
    "inverted_to_text": "select item_id, text from eval_items",
    "vector_check": "select vec_id, len(embedding) as dims, len(list_filter(embedding, lambda x: x <> 0)) > 0 as any_nonzero, round(100.0 * len(list_filter(embedding, lambda x: x > 0)) / len(embedding), 2) as positive_percent from embeddings",
    "property_rows": """select p_partkey, 'Brand' as property, coalesce(p_brand, 'unknown') as value from part union all select p_partkey, 'Type', coalesce(p_type, 'none') from part
        union all select p_partkey, 'Key', format('{:,}', p_partkey * 1000) from part union all select p_partkey, 'Edge', cast(cast(floor(sqrt(p_size * 100)) as bigint) as varchar) from part""",
    "distance_to_range": "select doc_id, greatest(400 - n_chars, n_chars - 600, 0) as distance from documents where greatest(400 - n_chars, n_chars - 600, 0) < 100",
    "json_parse_tolerant": "select record_id, coalesce(json_valid(metadata), true) as whole, case when json_valid(metadata) then try_cast(json_extract_string(metadata, '$.citation_count') as int) end as citations from seen_papers",
    "digest_extract": "select digest, count(*) as n from (select unnest(regexp_extract_all(lower(identity), '[0-9a-f]{64}')) as digest from seen_papers) group by digest",
    "kv_list_parse": "select p_partkey, string_split(item, '==')[1] as name, string_split(item, '==')[2] as version from (select p_partkey, unnest(regexp_split_to_array(replace(p_name, ' ', '==') || ',# skip,bare' || chr(10) || p_brand || '==1', '[\\n,]')) as item from part) where item like '%==%' and not starts_with(item, '#')",
    "log_probe": "select item_no, len(s) as lines, s[-1] as last, len(regexp_extract_all(text, ' ERROR ')) as errors from (select *, regexp_extract_all(text, '(\\d{4}-\\d\\d-\\d\\d \\d\\d:\\d\\d) (?:INFO|WARN|ERROR)', 1) as s from chunks where lower(rel_path) like '%.log')",
    "embedded_json": "select event_id, try_cast(json_extract_string(props, '$.k') as int) as k from events",
    "md_images": """select p_partkey, array_to_string(regexp_extract_all(t, '!\\[[^\\]]*\\]\\(([^)]*)\\)', 1), '|') as targets, regexp_replace(t, '!\\[([^\\]]*)\\]\\([^)]*\\)', '<\\1>', 'g') as spliced from (select p_partkey, 'a ![one](' || p_brand || '.png) b ![two](x/' || p_size || '.jpg)' as t from part)""",
    "status_label": """with a as (select p_partkey, case when p_size % 5 > 0 then p_size % 4 end as h, 1 + p_partkey % 3 as n from part), b as (select *, case when h is null then 'Unknown' when n = 1 then case when h >= 1 then 'PASSED' else 'Failed' end when h >= n then 'PASSED' else h || '/' || n end as status from a)
        select p_partkey, status, round(case when status = 'PASSED' then 1.0 when contains(status, '/') then h::double / n else 0.0 end, 6) as score from b""",
}
