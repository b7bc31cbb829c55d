import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import coverage as C
from tessella.operators import groups as G
from tessella.operators import joins as J
from tessella.operators import retrieval as R
from tessella.operators import sequential as Q
from tessella.operators import sync as Y
from tessella.sources import archives, files


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("name", "want"), [("x-Q6_K_L.gguf", "Q6_K"), ("m-bf16", "BF16"), ("m-q4-k-m", "Q4_K_M"), ("Q2_K_S", "Q2_K"), ("foo", "UNKNOWN"), (None, None)])
def test_quant_format(spark, name, want):
    assert value(spark, S.quant_format(F.lit(name).cast("string"))) == want


@pytest.mark.parametrize(("text", "lenient", "strict"), [("15.8M", 15800000, 15800000), ("1,234", 1234, None), ("abc", 0, None), ("0", 0, None), ("4b", 4000000000, 4000000000), ("", 0, None)])
def test_counts(spark, text, lenient, strict):
    assert value(spark, S.count_lenient(F.lit(text))) == lenient
    assert value(spark, S.count_strict(F.lit(text))) == strict


def test_sizes_and_durations(spark):
    assert [value(spark, S.size_in_gb(F.lit(t))) for t in ("512MB", "2TB", "1.5GB", "", "junk")] == [0.5, 2048.0, 1.5, 0.0, 0.0]
    assert [value(spark, S.context_length(F.lit(t))) for t in ("128K", "1M", "x")] == [131072, 1048576, None]
    assert [value(spark, S.parse_duration(F.lit(t))) for t in ("1:02:03.5", "90", "a:b")] == [3723.5, 90.0, None]
    assert [value(spark, S.human_bytes(F.lit(n))) for n in (99999, 100000)] == ["99999 ", "97.65k"]
    assert value(spark, S.fence_for(F.lit("a ``` b ```` c"))) == "`````"
    assert value(spark, S.to_range(F.lit(1900), 2000, 4000)) == 100


def test_middle_and_fences(spark):
    assert value(spark, S.middle_out(F.lit("abcdefghij"), 4)) == "ab\n...\nij"
    assert value(spark, S.strip_fence(F.lit("x\n```py\ncode\n```\ny"))) == "code"
    assert value(spark, S.after_reasoning(F.lit("<think>a</think> b "))) == "b"
    assert value(spark, S.safe_name(F.lit(" . "))) == "unnamed" or value(spark, S.safe_name(F.lit(". ."))) == "unnamed"
    assert value(spark, S.words_from_positions(F.create_map(F.lit("b"), F.array(F.lit(1)), F.lit("a"), F.array(F.lit(0), F.lit(2))))) == "a b a"


def test_adaptive_k(spark):
    k = lambda xs, lo=2, hi=10: value(spark, R.adaptive_k(F.array(*[F.lit(float(x)) for x in xs]).cast("array<double>"), lo, hi))
    assert [k(x) for x in ([0.1, 0.2, 0.3, 0.5], [0.1, 0.4, 0.5], [0.3, 0.3, 0.3], [0.2], [])] == [8, 2, 10, 1, 0]
    assert k([0, 1, 2], 2, 3) == 2


def test_rank_fusion(spark):
    a, b = (spark.createDataFrame([(x, i + 1) for i, x in enumerate(s)], "id string, rank int") for s in ("ab", "bc"))
    got = {r["id"]: round(r["score"], 6) for r in R.fuse(a, b).collect()}
    assert got == {"b": 0.032522, "a": 0.016393, "c": 0.016129}


def test_interval_overlap_against_brute_force(spark):
    rng = random.Random(1)
    side = lambda: [(i, rng.randint(0, 2), float(s := rng.randint(0, 100)), float(s + rng.randint(0, 40))) for i in range(60)]
    a, b = side(), side()
    want = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[3] > y[2] and x[2] < y[3] and x[3] > x[2] and y[3] > y[2]}
    da = spark.createDataFrame(a, "a_id int, k int, a_start double, a_end double")
    db = spark.createDataFrame(b, "b_id int, k int, b_start double, b_end double")
    got = [tuple(r) for r in J.interval_overlap(da, db, "k", 10.0).select("a_id", "b_id").collect()]
    assert set(got) == want and len(got) == len(want)


def test_point_falls_back_to_the_last_interval(spark):
    spans = spark.createDataFrame([(1, 0.0, 10.0, "A"), (1, 10.0, 20.0, "B")], "k int, i_start double, i_end double, name string")
    points = spark.createDataFrame([(1, 10.0), (1, 25.0), (2, 1.0), (1, 3.0)], "k int, t double")
    got = {(r["k"], r["t"]): r["name"] for r in J.point_in_interval(points, spans, "k", "t").collect()}
    assert got == {(1, 10.0): "B", (1, 25.0): "B", (2, 1.0): None, (1, 3.0): "A"}


def test_diff_coverage(spark):
    facts = spark.createDataFrame([("f", n, 1) for n in (1, 5, 9)], "file string, line int, hits int")
    for changed, want in (([6], {5}), ([10], {9}), ([5], {5}), ([], set())):
        lines = spark.createDataFrame([("f", n) for n in changed], "file string, line int")
        assert {r["line"] for r in C.changed(facts, lines).collect()} == want


@pytest.mark.parametrize(("total", "miss", "partial", "taken", "possible", "want"), [(1000, 1, 0, 0, 0, 99), (1000, 999, 0, 0, 0, 1), (3, 0, 0, 0, 0, 100), (3, 3, 0, 0, 0, 0), (10, 0, 2, 2, 4, 90)])
def test_percent(spark, total, miss, partial, taken, possible, want):
    assert value(spark, C.percent(*[F.lit(x) for x in (total, miss, partial, taken, possible)])) == want


def test_partial_branches_survive_only_in_the_newest_report(spark):
    rows = [("f", 1, 0, 1, 2, 0), ("f", 1, 3, 1, 2, 1), ("f", 2, 1, None, None, 0), ("f", 2, 1, 1, 2, 1), ("f", 3, 1, 1, 2, 0), ("f", 4, 0, None, None, 1)]
    got = {r["line"]: (r["hits"], r["br_taken"]) for r in C.merge(spark.createDataFrame(rows, "file string, line int, hits int, br_taken int, br_total int, ord int")).collect()}
    assert got == {1: (3, 1), 2: (1, None), 3: (1, None), 4: (0, None)}


def test_sync_classes(spark):
    index = spark.createDataFrame([("a", "s1", True), ("b", "s2", True), ("b", "s1", False), ("c", "s1", True), ("d", "s1", True)], "path string, sha string, active boolean")
    now = spark.createDataFrame([("a", "s1"), ("b", "s1"), ("c", "s9"), ("e", "s1"), (None, "s1")], "path string, sha string")
    assert {r["path"]: r["class"] for r in Y.classify(index, now).collect()} == {"a": "unchanged", "b": "reactivate", "c": "modified", "d": "deleted", "e": "new"}
    after = Y.apply(index, now)
    assert {(r["path"], r["sha"]) for r in Y.purge(after).collect()} == {("a", "s1"), ("b", "s1"), ("c", "s9"), ("e", "s1")}
    assert {r["class"] for r in Y.classify(after, now).collect()} == {"unchanged"}


def test_islands_and_stitching(spark):
    text = "abcdefghij"
    pieces = [(0, "abcd"), (3, "defg"), (6, "ghij"), (9, "j")]
    for drop, want in ((None, ["abcdefghij"]), (6, ["abcdefg", "j"])):
        rows = spark.createDataFrame([("f", at, at + len(t), t.encode()) for at, t in pieces if at != drop], "file string, start bigint, end bigint, bytes binary")
        runs = G.islands(rows, ["file"], "start", "end").groupBy("file", "island").agg(F.array_sort(F.collect_list(F.struct("start", "end", "bytes"))).alias("p")).orderBy("island")
        assert [r["t"] for r in runs.select(G.stitched(F.col("p")).alias("t"), "island").orderBy("island").collect()] == want
    assert text


def test_keypoints(spark):
    assert Q.keypoints(30, [3, 4, 25], 2, 10) == [0, 3, 11, 18, 25]
    rows = spark.createDataFrame([(1, 25.0), (1, 3.0), (1, 4.0), (2, 1.0), (1, None)], "k bigint, t double")
    got = sorted(tuple(r) for r in Q.segment(rows, "k", "t", 30.0, 2.0, 10.0).collect())
    assert [t for k, t in got if k == 1] == [0, 3, 11, 18, 25] and [t for k, t in got if k == 2] == Q.keypoints(30, [1.0], 2, 10)


def test_schedules():
    monday = 1704067200  # 2024-01-01
    assert Q.next_fire("30 4 * * *", monday) == monday + 4 * 3600 + 1800
    assert Q.next_fire("*/15 * * * *", monday) == monday + 900
    assert Q.next_fire("0 0 29 2 *", monday) == monday + 59 * 86400
    assert Q.next_fire("0 0 * * 0", monday) == monday + 6 * 86400
    assert Q.next_fire("0 0 31 2 *", monday) is None
    assert [Q.next_fire(x, monday) for x in ("x", None, "61 * * * *", "")] == [None] * 4


def test_syntax_and_code_chunks():
    assert Q.check_syntax("python", "```py\nx = 1\n```") == {"valid": True, "errors": []}
    assert Q.check_syntax("json", "{,}")["errors"][0]["line"] == 1
    assert not Q.check_syntax("cobol", "x")["valid"] and not Q.check_syntax(None, None)["valid"]
    code = "import x\n\ndef f():\n    return 1\n\ndef g():\n    return 'é'\n" * 9
    parts = Q.code_chunks(code, 60)
    assert "".join(p[3] for p in parts) == code and all(code.encode()[p[0] :].startswith(p[3].encode()) for p in parts)
    assert Q.code_chunks(None, 10) == [] and Q.code_chunks("", 10) == []


def test_versions(spark):
    order = ["1.0.dev1", "1.0a1", "1.0b2", "1.0rc1", "1.0", "1.0.post1", "1.0.1", "1.2", "1.10", "v2"]
    rows = spark.createDataFrame([(v,) for v in reversed(order)], "v string").orderBy(Q.version_key(F.col("v"))).collect()
    assert [r["v"] for r in rows] == order
    assert value(spark, Q.version_key(F.lit("junk"))) is None


def test_binary_header():
    import struct

    text = lambda s: struct.pack("<Q", len(s)) + s
    data = struct.pack("<IIQQ", files.MAGIC, 3, 0, 3) + text(b"a") + struct.pack("<If", 6, 0.5) + text(b"l") + struct.pack("<IIQ", 9, 8, 2) + text(b"x") + text(b"y") + text(b"z") + struct.pack("<I", 8)
    assert files.header_fields(data) == {"a": "0.5", "l": "['x', 'y']"}
    assert files.header_fields(None) == {} and files.header_fields(b"GGUF") == {} and files.header_fields(b"nope" * 9) == {}


def test_coverage_xml_and_schedule(spark, tmp_path):
    (tmp_path / "c.xml").write_text('<coverage><class filename="a.py"><lines><line number="1" hits="2"/><line number="3" hits="1" condition-coverage="50% (1/2)"/></lines></class></coverage>')
    rows = {tuple(r) for r in files.coverage_xml(spark, str(tmp_path / "c.xml")).collect()}
    assert rows == {("a.py", 1, 2, None, None), ("a.py", 3, 1, 1, 2)}
    lines = spark.createDataFrame([("# x",), ("*/5 * * * * run it now",), ("bad",), (None,)], "value string")
    assert [tuple(r) for r in files.schedule(lines).collect()] == [("*/5 * * * *", "run it now")]


def test_hunks(spark):
    lines = ["--- a/x", "+++ b/x", "@@ -1,2 +3,2 @@ f", "+new", "@@ -9 +9 @@", "@@ -5,2 +4,0 @@", "+++ b/y", "@@ -0,0 +1 @@"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "diff int, no int, text string")
    assert {tuple(r) for r in C.diff_lines(rows).collect()} == {("x", 3), ("x", 4), ("x", 9), ("y", 1)}


def test_archives_map_to_one_schema(spark):
    raw = {
        "openalex": '{"id": "W1", "title": "T", "doi": "https://doi.org/10.1/x", "authorships": [{"author": {"display_name": "A B"}}, {"author": {}}], "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "cited_by_count": 4, "open_access": {"is_oa": true}, "type": "journal-article"}',
        "doaj": '{"bibjson": {"title": "D", "identifier": [{"type": "doi", "id": "10.2/y"}], "link": [{"type": "fulltext", "content_type": "application/pdf", "url": "p"}], "author": [{"name": "C"}]}}',
        "europe_pmc": '{"title": "E", "doi": "10.3/z", "isOpenAccess": "Y", "pmcid": "PMC1", "authorList": {"author": [{"firstName": "F", "lastName": "G"}]}, "source": "MED"}',
        "ieee": '{"title": "I", "access_type": "LOCKED", "pdf_url": "p", "authors": {"authors": [{"full_name": "H"}]}}',
        "core": "{broken",
        "arxiv": '{"title": "X", "authors": ["J"], "url": "http://a/abs/1", "date": "2020-01-01"}',
    }
    got = {r["source"]: r for r in archives.federate({k: spark.createDataFrame([(v,)], "raw string") for k, v in raw.items()}).collect()}
    assert (got["openalex"]["abstract"], got["openalex"]["doi"], got["openalex"]["authors"], got["openalex"]["is_peer_reviewed"]) == ("a b a", "10.1/x", ["A B"], True)
    assert (got["doaj"]["doi"], got["doaj"]["url"], got["doaj"]["pdf_url"]) == ("10.2/y", "p", "p")
    assert (got["europe_pmc"]["authors"], got["europe_pmc"]["url"], got["europe_pmc"]["is_open_access"]) == (["F G"], "https://doi.org/10.3/z", True)
    assert (got["ieee"]["pdf_url"], got["ieee"]["relevance_score"]) == (None, 0.7)
    assert (got["core"]["title"], got["core"]["doi"]) == ("", None)
    assert got["arxiv"]["pdf_url"] == "http://a/pdf/1"
    assert set(archives.PROVIDERS) >= set(raw)


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "query string, item string, tokens array<string>")
    assert J.fuzzy_best(e.select("query", "tokens"), e.select("item", "tokens")).count() == 0
    d = spark.createDataFrame([], "doc_id bigint, text string, n_chars bigint")
    assert R.bm25(d, "doc_id", "text", ["a"]).count() == 0
    assert G.exact_duplicates(d, "doc_id", "n_chars", F.md5("text")).count() == 0
    none = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id bigint, text string")
    assert R.bm25(none, "doc_id", "text", ["a"]).count() <= 1


def test_queries_and_sql_agree_on_their_names():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 100
    assert all(callable(f) for f in entry.queries().values())
