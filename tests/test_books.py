from lectern.plans import texts


def test_whole_book(spark, tmp_path):
    rows = [(1, n, f"页{n}的文字。") for n in range(1, 21)]
    spark.createDataFrame(rows, "book int, pair_id long, zh string").write.parquet(f"{tmp_path}/pairs_zh.parquet")
    got = "\n".join(str(r) for r in texts.ingest_chinese_books(spark, str(tmp_path)).collect())
    assert all(f"页{n}的文字" in got for n in range(1, 21))
