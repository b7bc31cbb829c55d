import random

from pyspark.sql import functions as F

from tessella.operators import retrieval as R


def test_every_query_meets_every_vector(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)], i % 3) for i in range(300)] + [(300, None, 0)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, v array<float>, label int").repartition(3).cache()
    asked = vectors.where("vec_id % 2 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("vector"))
    held = {r["vec_id"]: (r["v"], r["label"]) for r in vectors.collect() if r["v"]}
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(held[a][0], held[b][0]))
    for part in (None, "label"):
        got = {}
        for r in R.nearest_each(vectors, "vec_id", "v", asked, 4, part).collect():
            got.setdefault((r["query_id"], r["part"]), []).append((r["rank"], r["id"]))
        groups = {(q, held[i][1] if part else 0) for q in range(0, 300, 2) for i in held if i != q}
        assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == {(q, p): sorted((i for i in held if i != q and p == (held[i][1] if part else 0)), key=lambda i: (far(q, i), i))[:4] for q, p in groups}


def test_every_text_is_searched_as_the_single_search_does(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(words, [1 / (n + 1) for n in range(40)], k=rng.randint(1, 12)))) for i in range(280)] + [(280, None), (281, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).cache()
    asked = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("query_id"), "text")
    got = {}
    for r in R.bm25_each(docs, "doc_id", "text", asked, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc"], round(r["score"], 6)))
    assert len(got) > R.BLOCK
    for q in (0, 2, 100, 278):
        one = sorted(((-round(r["score"], 9), r["doc"]) for r in R.bm25(docs, "doc_id", "text", rows[q][1].split()).collect()))[:5]
        assert sorted(got[q]) == [(n, doc, round(-s, 6)) for n, (s, doc) in enumerate(one, 1)]
    assert 280 not in got


def test_ranks_are_fused_per_query(spark):
    a, b = (spark.createDataFrame(rows, "query_id int, id string, rank int") for rows in ([(1, "a", 1), (2, "b", 1)], [(1, "a", 1), (2, "c", 1)]))
    assert {(r["query_id"], r["id"]): round(r["score"], 6) for r in R.fuse(a, b, by=("query_id", "id")).collect()} == {(1, "a"): 0.032787, (2, "b"): 0.016393, (2, "c"): 0.016393}
