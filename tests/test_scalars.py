import base64

from tessella.plans import scalars


def test_base64_text_holds_the_whole_text(spark, tmp_path):
    texts = {1: "x" * 41, 2: "naïve – 数据\n" * 500, 3: "", 4: None, 5: "short"}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["url"] for r in scalars.base64_text(spark, str(tmp_path)).collect()}
    assert got == {i: t if t is None else "data:text/plain;base64," + base64.b64encode(t.encode()).decode() for i, t in texts.items()}
