from lectern.plans import audio


def test_all_languages(spark, tmp_path):
    rows = [(1, 1, "1", "chunk_1.wav", "en", "the bell rang", "The bell rang."), (2, 1, "1", "chunk_1.wav", "de", "die Glocke klang", "Die Glocke klang."), (3, 1, "1", "chunk_2.wav", None, "x y z", "x y z"), (4, None, None, "chunk_1.wav", "hi", "a b c", None)]
    spark.createDataFrame(rows, "pair_id long, book int, chapter string, chunk_file string, lang string, source string, target string").write.parquet(f"{tmp_path}/pairs_en.parquet")
    assert {r.pair_id for r in audio.verify_spans(spark, str(tmp_path)).collect()} == {1, 2, 3, 4}
    windows = {r.pair_id: r.reference for r in audio._passages(spark, str(tmp_path)).collect()}
    assert windows[1] == "The bell rang." and windows[2] == "Die Glocke klang." and windows[3] == "x y z"
    for query in (audio.align_spans, audio.align_pipeline):
        assert {1, 2, 3} <= {r.pair_id for r in query(spark, str(tmp_path)).collect()}
