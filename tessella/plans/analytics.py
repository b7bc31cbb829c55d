"""Queries of retrieval, ranking, index sync, coverage and chunk operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import coverage as C
from tessella.operators import groups as G
from tessella.operators import joins as J
from tessella.operators import ranking as K
from tessella.operators import retrieval as R
from tessella.operators import sync as Y
from tessella.sources.tables import table

QUERY = "the coverage of retrieval rose percent coverage".split()
TODAY = "2025-09-01"


def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    posted = R.postings(table(spark, d, "documents"), "doc_id", "text")
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(table(spark, d, "documents"), "doc_id", "text", QUERY).select("doc", F.round("score", 6).alias("score"))


def knn(spark: SparkSession, d: str) -> DataFrame:
    return R.top(R.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", 0), 10, F.col("distance"), F.col("id")).select("id", F.round("distance", 6).alias("distance"), "rank")


def adaptive_k(spark: SparkSession, d: str) -> DataFrame:
    near = R.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", 0).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    best = near.groupBy("label").agg(F.slice(F.array_sort(F.collect_list("distance")), 1, 10).alias("d"))
    return best.select("label", R.adaptive_k(F.col("d"), 2, 10).alias("k"))


def _ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    vector = R.top(R.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", 0), 10, F.col("distance"), F.col("id"))
    words = R.top(R.bm25(table(spark, d, "documents"), "doc_id", "text", QUERY).select(F.col("doc").alias("id"), F.round("score", 9).alias("score")), 10, F.desc("score"), F.col("id"))
    return vector.select("id", "rank"), words.select("id", "rank")


def rrf(spark: SparkSession, d: str) -> DataFrame:
    return R.fuse(*_ranked(spark, d)).select("id", F.round("score", 9).alias("score"))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return R.top(R.fuse(*_ranked(spark, d)), 10, F.desc(F.round("score", 12)), F.col("first")).select("id", "rank")


def _asked(spark: SparkSession, d: str, name: str, key: str, value: str, out: str) -> DataFrame:
    """Every row whose id is divisible by 20, as a query."""
    return table(spark, d, name).where(F.col(key) % 20 == 0).select(F.col(key).alias("query_id"), F.col(value).alias(out))


def _words_each(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25_each(table(spark, d, "documents"), "doc_id", "text", _asked(spark, d, "documents", "doc_id", "text", "text"), 10)


def _near_each(spark: SparkSession, d: str, part: str | None = None) -> DataFrame:
    return R.nearest_each(table(spark, d, "embeddings"), "vec_id", "embedding", _asked(spark, d, "embeddings", "vec_id", "embedding", "vector"), 10, part)


def _fused_each(spark: SparkSession, d: str) -> DataFrame:
    words = _words_each(spark, d).select("query_id", F.col("doc").alias("id"), "rank")
    return R.fuse(_near_each(spark, d).select("query_id", "id", "rank"), words, by=("query_id", "id"))


def bm25_search_each(spark: SparkSession, d: str) -> DataFrame:
    return _words_each(spark, d).select("query_id", "doc", F.round("score", 6).alias("score"), "rank")


def knn_each(spark: SparkSession, d: str) -> DataFrame:
    return _near_each(spark, d).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


def adaptive_k_each(spark: SparkSession, d: str) -> DataFrame:
    best = _near_each(spark, d, "label").groupBy("query_id", F.col("part").cast("int").alias("label")).agg(F.array_sort(F.collect_list("distance")).alias("d"))
    return best.select("query_id", "label", R.adaptive_k(F.col("d"), 2, 10).alias("k"))


def rrf_each(spark: SparkSession, d: str) -> DataFrame:
    return _fused_each(spark, d).select("query_id", "id", F.round("score", 9).alias("score"))


def hybrid_search_each(spark: SparkSession, d: str) -> DataFrame:
    return R.top_each(_fused_each(spark, d), 10, ["query_id"], F.desc(F.round("score", 12)), F.col("first")).select("query_id", "id", "rank")


def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("n_chars > 0")
    starts = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), (F.col("n_chars") - 1).cast("int"), F.lit(448))).alias("start"))
    piece = F.substring("text", F.col("start") + 1, F.lit(512))
    before = F.substring("text", F.lit(1), F.col("start"))
    return starts.select("doc_id", "start", F.md5(piece).alias("digest"), F.octet_length(before).alias("byte_offset"), (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line"))


def expand_context(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").where("active").select("item_no", "file_path", "line_start", "byte_offset", "text")
    return J.neighbours(chunks.where("text like '%retrieval slows%' or text like '%retrieval%lowers%'").drop("text"), chunks.drop("text"))


def merge_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("file_path", "file_sha", "item_no", "line_start", "line_end", "byte_offset", (F.col("byte_offset") + F.octet_length("text")).alias("byte_end"))
    runs = G.islands(rows, ["file_path", "file_sha"], "byte_offset", "byte_end")
    return runs.groupBy("file_path", "file_sha", "island").agg(F.min("byte_offset").alias("start"), F.max("byte_end").alias("end"), F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), F.count("*").alias("chunks")).drop("island")


def merged_text(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("file_path", "file_sha", F.col("byte_offset").alias("start"), (F.col("byte_offset") + F.octet_length("text")).alias("end"), F.encode("text", "utf-8").alias("bytes"))
    runs = G.islands(rows, ["file_path", "file_sha"], "start", "end").groupBy("file_path", "file_sha", "island").agg(F.array_sort(F.collect_list(F.struct("start", "end", "bytes"))).alias("p"))
    return runs.select("file_path", "file_sha", F.col("p")[0]["start"].alias("start"), F.octet_length(G.stitched(F.col("p"))).alias("n_bytes"))


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("doc_id").alias("i"), F.md5("text").alias("sha"))
    first = docs.where("i % 10 <> 0").select("path", F.when(F.col("i") % 7 == 0, F.concat(F.lit("x"), "sha")).otherwise(F.col("sha")).alias("sha"), F.lit(True).alias("active"))
    older = docs.where("i % 10 <> 0 and i % 7 = 0 and i % 13 < 6").select("path", "sha", F.lit(False).alias("active"))
    return first.unionByName(older), docs.where("i % 11 <> 0").select("path", "sha")


def sync_classify(spark: SparkSession, d: str) -> DataFrame:
    return Y.classify(*_index(spark, d)).select("path", "class")


def sync_counts(spark: SparkSession, d: str) -> DataFrame:
    return Y.classify(*_index(spark, d)).groupBy("class").agg(F.count("*").alias("n"))


def sync_apply(spark: SparkSession, d: str) -> DataFrame:
    return Y.apply(*_index(spark, d))


def purge_inactive(spark: SparkSession, d: str) -> DataFrame:
    return Y.purge(Y.apply(*_index(spark, d)))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    quantity = F.col("l_quantity").cast("int")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.greatest(F.lit(0), quantity - 25).alias("hits"), F.when(quantity % 4 == 0, quantity % 3).alias("br_taken"), F.when(quantity % 4 == 0, F.lit(2)).alias("br_total"), (F.col("l_suppkey") % 3).alias("ord"))


def coverage_merge(spark: SparkSession, d: str) -> DataFrame:
    return C.merge(_facts(spark, d))


def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    return C.report(C.merge(_facts(spark, d)), ["file"])


def coverage_total(spark: SparkSession, d: str) -> DataFrame:
    return C.report(C.merge(_facts(spark, d)), [])


def diff_coverage(spark: SparkSession, d: str) -> DataFrame:
    facts = _facts(spark, d).groupBy("file", "line").agg(F.max("hits").alias("hits"))
    lines = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("file"), (F.col("o_custkey") % 9).alias("line"))
    return C.changed(facts, lines)


def diff_hunk_lines(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderkey % 2 = 0")
    text = F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("+++ b/f"), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.lit("@@ -1 +"), (F.col("o_custkey") % 50).cast("string"), F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit(","), (F.col("o_orderkey") % 3).cast("string"))).otherwise(""), F.lit(" @@")))
    return C.diff_lines(o.select((F.col("o_orderkey") / 1000).cast("bigint").alias("diff"), F.col("o_orderkey").alias("no"), text.alias("text")))


def weighted_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("paper_id", K.paper_score(TODAY).alias("score"))


def identity_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "papers").select(K.identity(F.col("doi"), F.col("title")).alias("identity"), "search_name", "source", "paper_id")
    return G.first_by(rows, ["identity"], ["search_name", "source", "paper_id"])


def topk_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "papers").select("paper_id", "search_name", K.paper_score(TODAY).alias("score"))
    return R.top(rows, 10, F.desc("score"), F.col("paper_id")).select("rank", "paper_id", "score")


def _results(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").groupBy(F.col("p_brand").alias("entity"), F.col("p_type").alias("test")).agg(F.count_if(F.col("p_size") > 2).alias("hits"), F.count("*").alias("needed"), F.round(F.avg("p_retailprice") / 100, 3).alias("duration"))
    category = F.when(F.col("test") < "F", "base").when(F.col("test") < "Q", "light").otherwise("heavy")
    return rows.select("entity", "test", category.alias("category"), F.when(F.col("hits") >= F.col("needed"), 1.0).otherwise(F.round(F.col("hits") / F.col("needed"), 6)).alias("score"), "duration")


def composite_rank(spark: SparkSession, d: str) -> DataFrame:
    return K.composite_rank(_results(spark, d)).select("entity", "place", F.array_join(F.transform("vector", lambda x: x.cast("string")), ",").alias("vector"))


def covered_by(spark: SparkSession, d: str) -> DataFrame:
    return K.covered_by(_results(spark, d))


def nearest_bucket(spark: SparkSession, d: str) -> DataFrame:
    bits = F.col("p_retailprice") / 1000 * F.col("p_size") % 20
    best = F.array_min(F.array(*[F.struct(F.abs(bits - b).alias("distance"), F.lit(n).alias("n"), F.lit(q).alias("quant")) for n, (q, _, b) in enumerate(S.QUANT_FORMATS)]))
    return table(spark, d, "part").select("p_partkey", best["quant"].alias("quant"))


def memory_estimate(spark: SparkSession, d: str) -> DataFrame:
    weights = F.greatest(F.col("p_retailprice") * 1e6, F.when(F.col("p_size") % 3 > 0, F.col("p_partkey") * 1e6 * 4.5 / 8))
    kv = F.when(F.col("p_size") % 4 > 0, 4 * (F.col("p_size") % 4) * 8 * 128 * F.least(F.lit(32768), F.col("p_size") * 1024)).otherwise(0)
    return table(spark, d, "part").select("p_partkey", F.round((weights + kv) / (1 << 30), 6).alias("gib"))


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and k[0] != "_"}

_TOK = "select doc_id as doc, list_filter(regexp_split_to_array(lower(text), '[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{0085}]+'), lambda t: t <> '') as t from documents"
_POST = f"tok as ({_TOK}), post as (select doc, len(t) as length, unnest(t) as term from tok where len(t) > 0), tf as (select doc, length, term, count(*) as tf from post group by all)"
_ASK = "values " + ", ".join(f"('{t}')" for t in QUERY)
_BM25 = f"""{_POST}, n as (select count(*) as n, avg(length) as mean_length from (select distinct doc, length from tf)), df as (select term, count(*) as df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) as raw from tf, n group by term, n),
    q as (select term, count(*) as times from ({_ASK}) as v(term) group by term), idf as (select df.term, times, case when raw < 0 then 0.25 * (select avg(raw) from df) else raw end as idf from df join q on df.term = q.term),
    bm as (select doc, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))) as score from tf join idf on tf.term = idf.term, n group by doc having score > 0)"""
_KNN = "q as (select embedding as v from embeddings where vec_id = 0), kn as (select vec_id as id, label, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (embedding[i]::double - v[i]::double) * (embedding[i]::double - v[i]::double))) as distance from embeddings, q where vec_id <> 0)"
_RRF = f"""{_BM25.replace('q as (select term', 'qq as (select term').replace('join q on df.term = q.term', 'join qq on df.term = qq.term')}, {_KNN}, va as (select id, row_number() over (order by distance, id) as rank from kn), wo as (select doc as id, row_number() over (order by round(score, 9) desc, doc) as rank from bm),
    f as (select id, sum(s) as score, min(first) as first from (select id, 1.0::double / (60 + rank) as s, rank as first from va where rank <= 10 union all select id, 1.0::double / (60 + rank), 1000000 + rank from wo where rank <= 10) group by id)"""
_BM_EACH = f"""{_POST}, n as (select count(*) as n, avg(length) as mean_length from (select distinct doc, length from tf)), df as (select term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) as raw from tf, n group by term, n),
    w as (select doc, tf.term, (case when raw < 0 then 0.25 * (select avg(raw) from df) else raw end) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length)) as w from tf join df on tf.term = df.term, n),
    bm as (select q.doc as query_id, w.doc, sum(q.tf * w) as score from tf q join w on q.term = w.term where q.doc % 20 = 0 group by 1, 2 having sum(q.tf * w) > 0), wo as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc) as rank from bm)"""
_KNN_EACH = """kn as (select q.vec_id as query_id, e.vec_id as id, e.label, list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: (e.embedding[i]::double - q.embedding[i]::double) * (e.embedding[i]::double - q.embedding[i]::double))) as distance
    from embeddings e, embeddings q where q.vec_id % 20 = 0 and e.vec_id <> q.vec_id), va as (select *, row_number() over (partition by query_id order by distance, id) as rank from kn)"""
_RRF_EACH = f"""{_BM_EACH}, {_KNN_EACH}, f as (select query_id, id, sum(s) as score, min(first) as first from (select query_id, id, 1.0::double / (60 + rank) as s, rank as first from va where rank <= 10
    union all select query_id, doc, 1.0::double / (60 + rank), 1000000 + rank from wo where rank <= 10) group by 1, 2)"""
_IDX = """doc as (select cast(doc_id as varchar) as path, doc_id as i, md5(text) as sha from documents), idx as (select path, case when i % 7 = 0 then 'x' || sha else sha end as sha, true as active from doc where i % 10 <> 0
    union all select path, sha, false from doc where i % 10 <> 0 and i % 7 = 0 and i % 13 < 6), now as (select path, sha from doc where i % 11 <> 0)"""
_CLS = f"""{_IDX}, k as (select path, max(sha) filter (active) as old_sha, list(sha) as a from idx group by path), c as (select coalesce(k.path, now.path) as path, case when a is null then 'new' when now.sha is null then 'deleted' when now.sha = old_sha then 'unchanged' when list_contains(a, now.sha) then 'reactivate' else 'modified' end as class from k full join now on k.path = now.path)"""
_FACTS = "fa as (select l_orderkey as file, l_linenumber as line, greatest(0, cast(l_quantity as int) - 25) as hits, case when cast(l_quantity as int) % 4 = 0 then cast(l_quantity as int) % 3 end as br_taken, case when cast(l_quantity as int) % 4 = 0 then 2 end as br_total, l_suppkey % 3 as ord from lineitem)"
_MERGED = f"""{_FACTS}, fn as (select *, max(ord) over (partition by file) as newest, coalesce(br_taken > 0 and br_taken < br_total, false) as p from fa),
    me as (select file, line, max(hits) as hits, case when not bool_or(ord < newest and not p) then max(br_taken) filter (p and ord = newest) end as br_taken, case when not bool_or(ord < newest and not p) then max(br_total) filter (p and ord = newest) end as br_total from fn group by file, line)"""
_REPORT = "count(*) as total, count(*) filter (hits <= 0) as miss, count(br_taken) as partial, cast(coalesce(sum(br_taken), 0) as bigint) as taken, cast(coalesce(sum(br_total), 0) as bigint) as possible"
_PERCENT = "case when raw = 100 and (miss > 0 or partial > 0) then 99 when raw = 0 and miss <> total then 1 else raw end as percent"
_RAW = "cast(floor(100.0::double * (total - miss - partial + coalesce((partial * taken)::double / nullif(possible, 0), 0)) / total) as int) as raw"
_SCORE = """round(0.35 * coalesce(relevance_score, 0) + 0.20 * case when citation_count > 0 then least(1.0, ln(1 + citation_count) / ln(1001)) else 0 end + 0.25 * case when is_open_access then 1.0 else 0.2 end + 0.15 * case when is_peer_reviewed then 1.0 when source in ('arxiv', 'biorxiv', 'medrxiv', 'chemrxiv') then 0.5 else 0 end
    + 0.05 * coalesce(greatest(0.0, 1 - (date '2025-09-01' - try_cast(case when regexp_matches(published_date, '^\\d{4}-\\d{2}-\\d{2}') then left(published_date, 10) end as date)) / 365.0::double), 0), 6)"""
_RES = """r0 as (select p_brand as entity, p_type as test, count(*) filter (p_size > 2) as hits, count(*) as needed, round(avg(p_retailprice) / 100, 3) as duration from part group by 1, 2),
    re as (select entity, test, case when test < 'F' then 'base' when test < 'Q' then 'light' else 'heavy' end as category, case when hits >= needed then 1.0::double else round(hits::double / needed, 6) end as score, duration from r0)"""
_STATS = "count(*) filter (score = 1) as passed, round(sum(case when score = 1 then duration else 0 end), 6) as ptime, round(sum(score), 6) as points, round(sum(duration), 6) as time"
SQL = {
    "bm25_stats": f"with {_POST} select term, count(*) as df, cast(sum(tf) as bigint) as cf from tf group by term",
    "bm25_search": f"with {_BM25} select doc, round(score, 6) as score from bm",
    "knn": f"with {_KNN} select id, round(distance, 6) as distance, rank from (select *, row_number() over (order by distance, id) as rank from kn) where rank <= 10",
    "adaptive_k": f"""with {_KNN}, s as (select label, list_sort(list(distance))[1:10] as d from kn group by label), t as (select label, d, len(d) as n, d[-1] - d[1] as spread from s)
        select label, cast(case when n < 2 then n when spread < 1e-6 then 10 when (d[2] - d[1]) / spread > 0.5 then 2 else round_even(2.0 + (1 - (d[2] - d[1]) / spread) * 8, 0) end as int) as k from t""",
    "rrf": f"with {_RRF} select id, round(score, 9) as score from f",
    "hybrid_search": f"with {_RRF} select id, rank from (select id, row_number() over (order by round(score, 12) desc, first) as rank from f) where rank <= 10",
    "bm25_search_each": f"with {_BM_EACH} select query_id, doc, round(score, 6) as score, rank from wo where rank <= 10",
    "knn_each": f"with {_KNN_EACH} select query_id, id, round(distance, 6) as distance, rank from va where rank <= 10",
    "adaptive_k_each": f"""with {_KNN_EACH}, s as (select query_id, label, list_sort(list(distance))[1:10] as d from kn group by 1, 2), t as (select query_id, label, d, len(d) as n, d[-1] - d[1] as spread from s)
        select query_id, label, cast(case when n < 2 then n when spread < 1e-6 then 10 when (d[2] - d[1]) / spread > 0.5 then 2 else round_even(2.0 + (1 - (d[2] - d[1]) / spread) * 8, 0) end as int) as k from t""",
    "rrf_each": f"with {_RRF_EACH} select query_id, id, round(score, 9) as score from f",
    "hybrid_search_each": f"with {_RRF_EACH} select query_id, id, rank from (select query_id, id, row_number() over (partition by query_id order by round(score, 12) desc, first) as rank from f) where rank <= 10",
    "chunk_text": "select doc_id, start, md5(substring(text, start + 1, 512)) as digest, strlen(left(text, start)) as byte_offset, length(left(text, start)) - length(replace(left(text, start), chr(10), '')) + 1 as line from (select doc_id, text, cast(unnest(range(0, n_chars, 448)) as int) as start from documents where n_chars > 0)",
    "expand_context": """with c as (select * from chunks where active), s as (select * from c where text like '%retrieval slows%' or text like '%retrieval%lowers%')
        select item_no, file_path, min(kind) as kind from (select item_no, file_path, 0 as kind from s union all select c.item_no, c.file_path, 1 from c join s on c.file_path = s.file_path and abs(c.line_start - s.line_start) <= 20 and abs(c.byte_offset - s.byte_offset) < 4096) group by 1, 2""",
    "merge_chunks": """with r as (select *, byte_offset + strlen(text) as byte_end from chunks), m as (select *, max(byte_end) over (partition by file_path, file_sha order by byte_offset, byte_end rows between unbounded preceding and 1 preceding) as reach from r),
        i as (select *, sum(case when reach is null or byte_offset > reach then 1 else 0 end) over (partition by file_path, file_sha order by byte_offset, byte_end rows unbounded preceding) as island from m)
        select file_path, file_sha, min(byte_offset) as start, max(byte_end) as end, min(line_start) as line_start, max(line_end) as line_end, count(*) as chunks from i group by file_path, file_sha, island""",
    "merged_text": """with r as (select *, byte_offset + strlen(text) as byte_end from chunks), m as (select *, max(byte_end) over (partition by file_path, file_sha order by byte_offset, byte_end rows between unbounded preceding and 1 preceding) as reach from r),
        i as (select *, sum(case when reach is null or byte_offset > reach then 1 else 0 end) over (partition by file_path, file_sha order by byte_offset, byte_end rows unbounded preceding) as island from m)
        select file_path, file_sha, min(byte_offset) as start, max(byte_end) - min(byte_offset) as n_bytes from i group by file_path, file_sha, island""",
    "sync_classify": f"with {_CLS} select path, class from c",
    "sync_counts": f"with {_CLS} select class, count(*) as n from c group by class",
    "sync_apply": f"with {_IDX} select u.path, u.sha, now.path is not null as active from (select path, sha from idx union select path, sha from now) u left join now on u.path = now.path and u.sha = now.sha",
    "purge_inactive": f"with {_IDX} select path, sha, true as active from now",
    "coverage_merge": f"with {_MERGED} select * from me",
    "coverage_report": f"with {_MERGED} select file, total, miss, partial, taken, possible, {_PERCENT} from (select *, {_RAW} from (select file, {_REPORT} from me group by file))",
    "coverage_total": f"with {_MERGED} select total, miss, partial, taken, possible, {_PERCENT} from (select *, {_RAW} from (select {_REPORT} from me))",
    "diff_coverage": f"""with {_FACTS}, s as (select file, line, max(hits) as hits from fa group by 1, 2), n as (select *, lead(line) over (partition by file order by line) as next from s), g as (select o_orderkey as file, o_custkey % 9 as line from orders where o_orderkey % 3 = 0)
        select file, line, hits from n where exists (select 1 from g where g.file = n.file and g.line >= n.line and (n.next is null or g.line < n.next))""",
    "diff_hunk_lines": """with t as (select o_orderkey // 1000 as diff, o_orderkey as no, case when o_orderkey % 10 = 0 then '+++ b/f' || o_custkey else '@@ -1 +' || o_custkey % 50 || case when o_orderkey % 4 = 0 then ',' || o_orderkey % 3 else '' end || ' @@' end as text from orders where o_orderkey % 2 = 0),
        f as (select *, last_value(case when text like '+++ b/%' then substring(text, 7) end ignore nulls) over (partition by diff order by no rows unbounded preceding) as file from t),
        h as (select file, cast(regexp_extract(text, '\\+(\\d+)', 1) as int) as a, coalesce(try_cast(nullif(regexp_extract(text, '\\+\\d+,(\\d+)', 1), '') as int), 1) as n from f where text like '@@%' and file is not null)
        select distinct file, cast(unnest(range(a, a + n)) as int) as line from h where n > 0""",
    "weighted_score": f"select paper_id, {_SCORE} as score from papers",
    "identity_dedupe": "select identity, search_name, source, paper_id from (select *, row_number() over (partition by identity order by search_name, source, paper_id) as r from (select *, case when doi is not null and doi <> '' then 'doi:' || doi else 'title:' || sha256(lower(trim(title))) end as identity from papers)) where r = 1",
    "topk_report": f"select rank, paper_id, score from (select paper_id, score, row_number() over (order by score desc, paper_id) as rank from (select paper_id, {_SCORE} as score from papers)) where rank <= 10",
    "composite_rank": f"""with {_RES}, o as (select entity, row_number() over (order by passed desc, ptime, points desc, time, entity) - 1 as overall from (select entity, {_STATS} from re group by entity)), n as (select count(*) as n from o),
        c as (select entity, category, r from (select *, row_number() over (partition by category order by passed desc, ptime, points desc, time, entity) - 1 as r from (select entity, category, {_STATS} from re where category <> 'base' group by 1, 2)) where passed > 0),
        g as (select o.entity, overall, list(coalesce(r, n) * 2 + 1) as c from o, n, (select distinct category from re where category <> 'base') k left join c on c.entity = o.entity and c.category = k.category group by 1, 2),
        v as (select entity, list_concat(list_sort(list_concat([overall], c)), [overall]) as vector from g) select entity, row_number() over (order by vector, entity) as place, array_to_string(vector, ',') as vector from v""",
    "covered_by": f"""with {_RES}, p as (select a.entity as a, b.entity as b, count(*) as shared, bool_or(a.score = 1 and b.score <> 1) as fails, bool_or(a.score <> 1 and b.score = 1) as better, bool_or(a.score > b.score) as lower, bool_or(a.score = 1 and greatest(1.0, a.duration) * 1.5 < b.duration) as slow from re a join re b on a.test = b.test and a.entity <> b.entity group by 1, 2),
        n as (select entity, count(*) as n from re group by 1), g as (select a, min(b) as who from p join n on a = entity where shared = n and not fails and (better or not lower) and not slow group by a) select entity, coalesce(who, '') as "by" from n left join g on a = entity""",
    "nearest_bucket": "with q(n, quant, bits) as (values " + ", ".join(f"({n}, '{q}', {b}::double)" for n, (q, _, b) in enumerate(S.QUANT_FORMATS)) + ") select p_partkey, quant from (select p_partkey, quant, row_number() over (partition by p_partkey order by abs((p_retailprice / 1000 * p_size) % 20 - bits), n) as r from part, q) where r = 1",
    "memory_estimate": "select p_partkey, round((greatest(p_retailprice * 1e6, case when p_size % 3 > 0 then p_partkey * 1e6 * 4.5 / 8 end) + case when p_size % 4 > 0 then 4 * (p_size % 4) * 8 * 128 * least(32768, p_size * 1024) else 0 end) / 1073741824, 6) as gib from part",
}
