import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessella.llm import history, matching, mixing, survivors

PAPERS = "paper_id bigint, title string, authors array<string>, doi string, abstract string, source string, published_date string, citation_count int, pdf_url string, retrieved_at timestamp_ntz"


@pytest.fixture(scope="module")
def archives(spark):
    return spark.createDataFrame([("ieee", 1), ("arxiv", 8)], "source string, trust int")


def test_survivors(spark, archives):
    day = lambda n: datetime(2024, 1, n)
    rows = spark.createDataFrame(
        [
            (1, "t", [], "https://doi.org/10.1234/AB.", "A long own text that is cut [truncated]", "arXiv ", None, 5, "https://x.org/pdf/1", day(1)),
            (2, "t", [], "10.1234%2Fab", "A long own text that is cut off nowhere.   ", "IEEE", None, -1, "/pdf/2", day(2)),
            (3, "t", [], "doi:10.1234/ab", "Sign in to read this very long text that stands everywhere and says nothing at all.", None, None, None, "https://x.org/login?next=3", day(3)),
            (4, "t", [], "10.1234/ab", "n/a", "arxiv", None, 7, "http://f.org/4.pdf", None),
            (5, "t", [], "10.9999/one", "Alone.", "ieee", None, 1, None, day(1)),
            (6, "t", [], None, "No doi.", "ieee", None, 1, None, day(1)),
            (7, "t", [], "10.8888/c", None, None, None, None, None, None),
            (8, "t", [], "10.8888/c", "null", "", None, None, "N/A", None),
        ],
        PAPERS,
    )
    got = {(r["doi"], r["field_name"], r["paper_id"]) for r in survivors.suppliers(rows, archives).collect()}
    assert got == {("10.1234/ab", "abstract", 2), ("10.1234/ab", "pdf_url", 1), ("10.1234/ab", "citation_count", 1), ("10.1234/ab", "source", 2)}
    one = survivors.survivors(rows, archives).where("doi = '10.1234/ab'").first()
    assert (one["n_rows"], one["citation_count"], one["source"], one["pdf_url"]) == (4, 5, "IEEE", "https://x.org/pdf/1")
    assert survivors.suppliers(rows.limit(0), archives).count() == 0


def test_a_text_under_several_dois_is_a_notice(spark, archives):
    rows = spark.createDataFrame([(i, "t", [], f"10.1234/x{i // 2}", "Our site will be closed on Sunday." if i % 2 else f"Own {i}.", "ieee", None, 1, None, None) for i in range(8)], PAPERS)
    got = {r["paper_id"] for r in survivors.suppliers(rows, archives).where("field_name = 'abstract'").collect()}
    assert got == {0, 2, 4, 6}


SEEN = "record_id bigint, identity string, title string, doi string, metadata string, first_seen string"


def _record(i, identity, title, doi, authors, day, cut=None):
    text = '{"authors": [' + ", ".join(f'"{a}"' for a in authors) + f'], "abstract": null, "published_date": "{day}", "extra": {{}}}}'
    return (i, identity, title, doi, text[:cut] if cut else text, None)


def _history_rows():
    long = "Weighted hashing of tables with Zofira graphs for rural optics"
    seen = [
        _record(1, "doi:10.1234/ab.c1", long, "10.1234/ab.c1", ["Jane Doe", "Roe, Max"], "2020-01-02"),
        _record(2, "DOI:10-1234//AB.C1", long.upper(), None, ["M. Roe", "Doe J"], "2020-01-02"),
        _record(3, "title:" + "0" * 64, "Weighted hashng of tables with Zofira graphs for rural optics", None, ["Doe, J.", "Max Roe"], "2020-01-02"),
        _record(4, "title:" + "1" * 64, "Erratum", None, ["Ann Poe"], "2021-05-05"),
        _record(5, "title:" + "2" * 64, "Erratum", None, ["Bob Coe"], "2021-06-06"),
        _record(6, "doi:10.1234/p1", "On the counting of sheep, part I", "10.1234/p1", ["Ann Poe"], "2019-01-01"),
        (7, None, None, None, None, None),
    ]
    batch = [
        _record(101, "doi: 10.1234/ab.c1", "something else", None, [], "x"),
        _record(102, "title:" + "3" * 64, "Erratum", None, ["A. Poe"], "2021-05-05"),
        _record(103, "title:" + "4" * 64, "Erratum", None, ["Zed Zoe"], "2022-01-01"),
        _record(104, "doi:10.1234/p2", "On the counting of sheep, part II", "10.1234/p2", ["Ann Poe"], "2019-01-01"),
        _record(105, "title:" + "5" * 64, "On the counting of sheep, part II", None, ["Poe, Ann"], "2019-01-01"),
        _record(106, "title:" + "6" * 64, long + " [preprint]", None, ["Jane Doe", "Max Roe"], "2020-01-02"),
        _record(107, "title:" + "7" * 64, long, None, ["Jane Doe", "Max Roe"], "2020-01-02", cut=30),
        (108, None, None, None, None, None),
        _record(109, "title:" + "4" * 64, "Erratum!", None, ["Zoe, Zed"], "2022-01-01"),
    ]
    return seen, batch


WANT = {(1, 101), (4, 102), (104, 105), (1, 106), (1, 107), (103, 109)}


def test_batch_against_history(spark):
    seen, batch = _history_rows()
    index = history.build_index(spark.createDataFrame(seen, SEEN))
    assert {r["paper"]: r["root"] for r in index.papers().collect()}[3] == 1
    got = {tuple(r) for r in history.check_batch(index, spark.createDataFrame(batch, SEEN), append=False).select("original_id", "record_id").collect()}
    assert got == WANT


def test_batches_in_turn_find_the_same(spark):
    seen, batch = _history_rows()
    index, got = history.build_index(spark.createDataFrame(seen, SEEN)), set()
    for part in (batch[:3], batch[3:4], batch[4:]):
        got |= {tuple(r) for r in history.check_batch(index, spark.createDataFrame(part, SEEN)).select("original_id", "record_id").collect()}
    assert got == WANT
    assert history.check_batch(index, spark.createDataFrame([], SEEN)).count() == 0


def test_batches_repeating_a_known_paper_leave_its_title_unambiguous(spark):
    long = "Weighted hashing of tables with Zofira graphs for rural optics"
    seen = [_record(1, "doi:10.1234/ab.c1", long, "10.1234/ab.c1", ["Jane Doe"], "2020-01-02"), _record(2, "title:" + "1" * 64, "Nested pooling of quiet maps by Vamoxor trees", None, [], "x", cut=30)]
    batch = [
        (1, *_record(101, "title:" + "2" * 64, long, None, ["Doe, J."], "2020-01-02")),
        (2, *_record(102, "title:" + "3" * 64, long, None, ["Jane Doe"], "2020-01-02", cut=30)),
        (2, *_record(103, "title:" + "4" * 64, seen[1][2], None, ["Ann Poe"], "2021-05-05")),
        (3, *_record(104, "title:" + "5" * 64, seen[1][2], None, ["Bob Coe"], "2022-06-06")),
        (3, *_record(105, "doi:10.1234/ab.c1", long, "10.1234/ab.c1", ["Jane Doe"], "2020-01-02")),
    ]
    index = history.build_index(spark.createDataFrame(seen, SEEN))
    got = [tuple(r) for r in history.check_batches(index, spark.createDataFrame(list(reversed(batch)), "batch_no int, " + SEEN), "batch_no").select("original_id", "record_id").collect()]
    assert sorted(got) == [(1, 101), (1, 102), (1, 105), (2, 103)]
    assert 105 not in {r["paper"] for r in index.papers().collect()}


def test_empty_history(spark):
    index = history.build_index(spark.createDataFrame([], SEEN))
    rows = spark.createDataFrame([_record(1, "doi:10.1234/a1", "t", None, [], ""), _record(2, "doi:10.1234/a1", "t", None, [], "")], SEEN)
    assert [tuple(r) for r in history.check_batch(index, rows).collect()] == [(1, 2)]


SHELF = "shelf_id bigint, title string, authors string, doi string, published_date string"


def test_matching_works(spark):
    rng = random.Random(2)
    pools = [["weighted", "sparse", "nested", "robust", "tuned", "hybrid", "joint"], ["hashing", "pooling", "routing", "tracing", "voting"], ["tables", "images", "logs", "queries", "slides", "maps"], ["optics", "botany", "geology", "banking", "urbanism"]]
    names = ["Doerner", "Roevik", "Poelman", "Coenen", "Hoeller", "Janssen", "Kowalski", "Lindqvist", "Moreau", "Novakova"]
    papers, shelf = [], []
    for i in range(1, 121):
        a, b, c, d = (rng.choice(p) for p in pools)
        title = f"{rng.choice('BDFGKLMNPRSTVZ')}{rng.choice('aeiou')}{rng.choice('bdfgklmn')}{rng.choice('aeiou')}x{i}: {a} {b} of {c} with trees for rural {d}"
        authors = rng.sample(names, rng.randint(1, 3))
        papers.append((i, title, [f"Ann {x}" for x in authors], f"10.1234/w{i}", None, "ieee", f"20{10 + i % 10}-05-0{1 + i % 9}", 1, None, None))
        if i % 3 == 0:
            words = title.split()
            del words[4]
            shelf.append((i, " ".join(words).upper(), " and ".join(f"{x}, A." for x in authors), None, f"20{10 + i % 10}"))
    papers.append((200, None, None, "10.1234/w3", None, None, None, None, None, None))
    papers.append((201, papers[5][1], None, None, None, None, None, None, None, None))
    papers.append((202, "", [], None, None, None, None, None, None, None))
    shelf += [(900, None, None, None, None), (901, "", None, None, "2020"), (902, "A wholly different thing about cheese", "Q. Nobody", None, "2012")]
    p, s = spark.createDataFrame(papers, PAPERS), spark.createDataFrame(shelf, SHELF)
    got = matching.match_works(p, s).collect()
    want = {(i, i) for i in range(3, 121, 3)} | {(200, 3), (201, 6)}
    pairs = {(r["paper_id"], r["shelf_id"]) for r in got}
    assert len(pairs & want) >= 0.95 * len(want) and len(pairs - want) <= 2
    assert all(0 <= r["confidence"] <= 1 for r in got)
    assert matching.match_works(p.limit(0), s).count() == 0
    assert matching.match_works(p, s.limit(0)).count() == 0


def _mix(spark, docs, targets, **more):
    d, t = spark.createDataFrame(docs, "doc_id bigint, source string, text string, copies string"), spark.createDataFrame(targets, "source string, weight double, max_repeats int")
    chosen, report = mixing.mix(d, t, **more)
    return {r["doc_id"]: r["copies"] for r in chosen.collect()}, {r["source"]: r for r in report.collect()}


def test_mix_follows_the_weights(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.randint(5, 60)))
    docs = [(i, "big" if i % 10 else "small", text(), "x") for i in range(3000)] + [(9000, None, "x", None), (9001, "big", None, None), (9002, "other", "x", None)]
    copies, report = _mix(spark, docs, [("big", 0.6, 1), ("small", 0.3, 4), ("absent", 0.1, 2)])
    assert abs(report["big"]["actual_share"] - 2 / 3) < 0.01 and abs(report["small"]["actual_share"] - 1 / 3) < 0.01
    assert report["absent"]["given_tokens"] == 0 and report["small"]["most_copies"] <= 4
    assert not {9000, 9001, 9002} & set(copies) and max(copies.values()) <= 4


def test_mix_reports_a_capped_source(spark):
    docs = [(i, "a" if i < 90 else "b", "alpha beta gamma", None) for i in range(100)]
    copies, report = _mix(spark, docs, [("a", 0.5, 2), ("b", 0.5, 2)], total_tokens=10 * report_size())
    assert report["b"]["most_copies"] == 2 and report["b"]["actual_share"] < 0.5
    assert {copies[i] for i in range(90, 100)} == {2}
    assert _mix(spark, docs[:0], [("a", 1.0, 1)])[0] == {}


def report_size():
    return 30


def test_tokens_match_the_library(spark):
    texts = ["Hello world", "", "naïve café\n\n  x", "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", mixing.count_tokens()(F.col("t")).alias("n"))
    want = [len(mixing._encoding(mixing.TOKENIZER_FILE).encode_ordinary(t)) for t in texts]
    assert [r["n"] for r in df.orderBy("i").collect()] == want


def test_blocking_finds_what_all_pairs_would(spark, monkeypatch):
    """Two bits with two flips put every pair into every table, with all limits open: brute force with the same rules.

    Whether like records meet depends on bits, tables and probes, not on the number of rows, so more bits stand for
    more rows: 20 bits are what 67 million profiles get, 26 bits four billion.
    """
    from pathlib import Path

    d = "/root/testdata/sf0.01"
    if not Path(d).exists():
        pytest.skip("no test data")
    p, s = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("papers", "shelf_papers"))
    run = lambda bits: {(r[0], r[1]) for r in matching.match_works(p, s, bits=bits).select("paper_id", "shelf_id").collect()}
    found = {bits: run(bits) for bits in (8, 14, 20, 26, 32)}
    with monkeypatch.context() as m:
        m.setattr(matching, "BROADCAST_BYTES", 0)
        assert run(8) == found[8]  # the other way of joining
    monkeypatch.setattr(matching, "SKETCH_DISTANCE", 128)
    want = run(2)
    print("blocking found", {b: len(f) for b, f in found.items()}, "of", len(want))
    assert all(f <= want and len(f) >= 0.95 * len(want) for f in found.values())


def test_the_model_comes_from_all_profiles(spark):
    """More profiles than one shard: every token that two of them hold is trained, whatever the order and the tasks."""
    import numpy as np
    from tessella.llm.vectors import TRAINED

    rows = spark.range(9000).selectExpr("id pid", "concat('common title number n', id div 2) title", "if(id % 3 = 0, concat('name', id % 100), null) people")
    one, means, n = matching.fit_model(rows.repartition(1))
    assert n == 9000
    assert all(np.any(one.token_rows([f"n{i}"])[0, :TRAINED]) for i in range(4500))
    assert not np.any(one.token_rows(["n4500"])[0, :TRAINED])
    other, same, _ = matching.fit_model(rows.orderBy("title").repartition(7))
    assert np.array_equal(one.trained, other.trained) and np.array_equal(one.weight, other.weight) and np.array_equal(means, same)
    every = np.mean([one.vectors([f"common title number n{i // 2}".split() for i in range(k, k + 1000)]).mean(0) for k in range(0, 9000, 1000)], axis=0)
    assert np.allclose(means[0], every, atol=1e-5)


def test_the_curve_counts_every_pair():
    import numpy as np

    x, y, n = np.array([0.2, 0.6, 0.9]), np.array([1.0, 30_000.0, 50_000.0]), np.array([40_000.0, 60_000.0, 51_000.0])
    slope, intercept = matching._logistic(x, y, n)
    assert np.allclose(1 / (1 + np.exp(-(slope * x + intercept))) @ n, y.sum(), rtol=1e-3)


def test_works_of_one_hot_title(spark):
    """A third of all papers have one title and differ in authors only."""
    rows = [(i, "Weighted hashing of tables with Zofira graphs for rural optics" if i % 3 == 0 else f"Robust voting of maps number {i * 7919} for banking", [f"Ann Name{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}son"], None, None, "ieee", "2019", 1, None, None) for i in range(900)]
    p = spark.createDataFrame(rows, PAPERS)
    s = spark.createDataFrame([(i, rows[i][1].lower(), rows[i][2][0], None, "2019") for i in range(0, 90, 3)], SHELF)
    got = {(r["paper_id"], r["shelf_id"]) for r in matching.match_works(p, s).collect()}
    assert {(i, i) for i in range(0, 90, 3)} <= got


def test_matching_frees_its_shuffles(spark):
    """Each step's shuffle files go with the step: once the pairs are written, the disk holds none of them."""
    import time
    from pathlib import Path

    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*")}
    p = spark.createDataFrame([(i, f"Weighted hashing of {i * 7919} tables for rural optics", [f"Ann Name{i}"], None, None, "ieee", "2019", 1, None, None) for i in range(300)], PAPERS)
    s = spark.createDataFrame([(i, f"weighted hashing of {i * 7919} tables for rural optics", f"A. Name{i}", None, "2019") for i in range(0, 300, 3)], SHELF)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held, setting = files(), spark.conf.get(key)
    got = matching.match_works(p, s, confidence=False)
    for _ in range(20):
        if not (left := files() - held):
            break
        time.sleep(0.25)
    assert not left and spark.conf.get(key) == setting
    assert {(i, i) for i in range(0, 300, 3)} <= {tuple(r) for r in got.collect()} == {tuple(r) for r in got.collect()}


def test_a_look_up_reads_what_the_batch_needs(spark):
    """Twice the history, the same batch: the rows read stay where they are."""
    record = lambda i: _record(i, f"doi:10.1234/w{i * 7919}", f"Title {i * 104729} about things {i * 1299709} and more", f"10.1234/w{i * 7919}", [f"Ann Name{i}"], f"20{10 + i % 10}-0{1 + i % 9}-1{i % 10}")
    read = []
    for n in (2000, 4000):
        index = history.build_index(spark.createDataFrame([record(i) for i in range(1, n + 1)], SEEN), chunks_each=64)
        batch = spark.createDataFrame([(*record(7)[:0], 10_001, *record(7)[1:])], SEEN)
        chunks = history.prepare(batch, F.lit("0")).chunks("0")
        there = [r[0] for r in chunks.select(index.chunk_bucket(F.col("chunk"))).distinct().collect()]
        read.append(index.chunks(there).count())
        assert [tuple(r) for r in history.check_batch(index, batch).select("original_id", "record_id").collect()] == [(7, 10_001)]
    assert read[1] < 1.5 * read[0] and read[1] < index.chunks().count() / 4


def test_links_settle_over_any_number_of_steps(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95)], "x bigint, y bigint")
    labels, rounds = history.components(chain)
    assert {r["node"]: r["label"] for r in labels.collect()} == {**{i: 1 for i in range(1, 41)}, 100: 90, 90: 90, 95: 90}
    assert rounds <= 12


def test_links_settle_alike_on_the_driver_and_by_joins(spark, monkeypatch):
    rng = random.Random(5)
    edges = spark.createDataFrame([(rng.randrange(400), 1000 - rng.randrange(400)) for _ in range(250)] + [(i + 2000, i + 2001) for i in range(30)], "x bigint, y bigint")
    got = lambda: sorted(tuple(r) for r in history.linked(edges).collect())
    here = got()
    joins = []
    components = history.components
    monkeypatch.setattr(history, "components", lambda e: joins.append(1) or components(e))
    assert got() == here and not joins
    monkeypatch.setattr(history, "LOCAL_EDGES", 0)
    assert got() == here and joins
    assert history.linked(edges.limit(0)).count() == 0
