"""One key, text or paper that holds a third of all rows, and results that must stay whole all the same."""

import random

from pyspark.sql import functions as F

from tessella.llm import canonical, format_copies, history, leakage, mixing, survivors

N = 3000


def test_format_copies_of_a_hot_title(spark):
    rng = random.Random(1)
    hot = lambda: "".join(rng.choice((c, c.upper())) for c in "a very common title") + rng.choice(("", "!", " ", "..."))
    rows = spark.createDataFrame([(i, hot() if i % 3 == 0 else f"title number {i}", ["A B"]) for i in range(N)], "paper_id bigint, title string, authors array<string>")
    got = format_copies.format_copies(rows, "paper_id", ["title"], ["authors"]).agg(F.count("*").alias("n"), F.min("kept_id").alias("lo"), F.max("kept_id").alias("hi"), F.max("copies").alias("c")).first()
    assert tuple(got) == (N // 3, 0, 0, N // 3)
    assert format_copies.collapse(rows, "paper_id", ["title"], ["authors"]).count() == N - N // 3 + 1


def test_survivor_of_a_hot_doi(spark):
    archives = spark.createDataFrame([("ieee", 1)], "source string, trust int")
    rows = spark.range(N).select(
        F.col("id").alias("paper_id"), F.when(F.col("id") % 3 == 0, "10.1234/hot").otherwise(F.concat(F.lit("10.1234/"), F.col("id").cast("string"))).alias("doi"),
        F.concat(F.lit("own text "), F.repeat(F.lit("x"), (F.col("id") % 100).cast("int"))).alias("abstract"), F.lit("ieee").alias("source"), F.lit(None).cast("string").alias("pdf_url"),
        F.col("id").cast("int").alias("citation_count"), F.lit(None).cast("timestamp_ntz").alias("retrieved_at"),
    )
    got = {r["field_name"]: r["paper_id"] for r in survivors.suppliers(rows, archives).collect()}
    assert got["source"] == 0 and got["citation_count"] == 0 and "pdf_url" not in got


def test_history_with_a_hot_paper(spark):
    rng = random.Random(2)

    def typo(t):
        at = rng.randrange(5, len(t) - 5)
        return t[:at] + t[at + 1 :]

    title = "Sparse routing of ledgers with Vamoxor graphs for coastal optics"
    record = lambda i, hot: (i, "title:" + "0" * 64, typo(title) if hot else f"Another title {i} about thing {i * 7}", None, '{"authors": ["Jane Roe"], "published_date": "' + ("2020-02-02" if hot else f"20{10 + i % 10}-0{1 + i % 9}-{10 + i % 18}") + '"}', None)
    schema = "record_id bigint, identity string, title string, doi string, metadata string, first_seen string"
    index = history.build_index(spark.createDataFrame([record(i, i % 3 == 0) for i in range(1, 601)], schema))
    found = history.check_batch(index, spark.createDataFrame([record(i, i % 3 == 0) for i in range(1001, 1301)], schema)).collect()
    hot = {r["record_id"]: r["original_id"] for r in found if r["record_id"] % 3 == 0}
    assert len(hot) == 100 and set(hot.values()) == {3}


def test_look_alikes_and_leaks_of_a_hot_text(spark):
    text = "the same words stand here in a third of all rows and nobody minds it at all"
    docs = spark.createDataFrame([(i, text if i % 3 == 0 else f"other text {i}") for i in range(N)] + [(N, text.replace("a", "а"))], "doc_id bigint, text string")
    assert canonical.look_alike_pairs(docs, "doc_id", "text").count() == N // 3
    items = spark.createDataFrame([(1, "so " + text)], "item_id bigint, text string")
    assert leakage.leaks(docs, items).where("exact_windows > 0").count() == N // 3 + 1


def test_mix_of_a_hot_source_and_one_length(spark):
    docs = spark.createDataFrame([(i, "hot" if i % 3 else f"s{i % 2}", "one two three", None) for i in range(N)], "doc_id bigint, source string, text string, x string")
    targets = spark.createDataFrame([("hot", 0.2, 1), ("s0", 0.4, 5), ("s1", 0.4, 5)], "source string, weight double, max_repeats int")
    shares = {r["source"]: r["actual_share"] for r in mixing.mix(docs, targets)[1].collect()}
    assert abs(shares["hot"] - 0.2) < 0.005 and abs(shares["s0"] - 0.4) < 0.005
