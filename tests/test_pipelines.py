from lectern.operators import pipelines as P


def test_chinese_book(spark):
    pages = {1: ["书书名名", "1", "第  章", "开开始始"], 2: ["长短" * 16 + "他走", "了。", "", "第2章", "二"], 3: ["x" * 31]}
    rows = [(7, p, n, s) for p, x in pages.items() for n, s in enumerate(x, 1)]
    got = {r.part: r.text for r in P.ingest_chinese_book(spark.createDataFrame(rows, "book int, page_no int, line_no int, line string").repartition(5), "book").collect()}
    assert got == {"title": "书名\n", "1": "第1章\n开始\n" + "长短" * 16 + "他走了。\n\n", "2": "第2章\n二\n" + "x" * 31}


def test_english_book(spark):
    got = P.ingest_english_book(spark.createDataFrame([(1, "x\r\nCHAPTER ONE\r\nA b\r\n")], "id int, text string"), "id", "text").collect()
    assert [(r.chapter_no, r.text) for r in got] == [(1, "CHAPTER ONE\nAb\n")]


def test_split_audio(spark):
    loud, quiet = b"\x00\x40" * 480, b"\x00\x00" * 480
    raw = loud * 10 + quiet * 5 + loud * 10 + b"\x00\x40" * 16
    got = P.split_audio(spark.createDataFrame([(1, bytearray(raw)), (2, None), (3, bytearray())], "id int, pcm binary"), "id", "pcm", 120, 30, 0.2).orderBy("seg_no").collect()
    assert [(r.id, r.seg_no, r.start_ms, r.end_ms, len(r.pcm)) for r in got] == [(1, 1, 0, 420, 13440), (1, 2, 420, 751, 10592)]
    assert b"".join(bytes(r.pcm) for r in got) == raw
