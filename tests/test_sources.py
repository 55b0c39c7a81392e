import json

from pyspark.sql import functions as F

from lectern.sources import readers as R
from lectern.sources import writers as W
from lectern.streaming import transcripts as S


def fill(folder):
    for n in (1, 2, 10):
        body = {"chunk_file": f"chunk_{n}.wav", "text": " x é", "language": "en", "segments": [{"id": 0, "start": 0.0, "end": 1.5, "text": " x"}]}
        (folder / f"chunk_{n}.json").write_text(json.dumps(body, indent=2, ensure_ascii=False), encoding="utf-8")
    (folder / "chunk_1_aligned.json").write_text(json.dumps({"chunk_file": "chunk_1.wav", "source": "x", "target": "X."}), encoding="utf-8")
    (folder / "chunk_2_error.json").write_text("{}")


def test_transcripts_and_pairs(spark, tmp_path):
    fill(tmp_path)
    rows = R.read_transcripts(spark, str(tmp_path)).orderBy("chunk_no").collect()
    assert [(r.chunk_no, r.text, len(r.segments)) for r in rows] == [(1, " x é", 1), (2, " x é", 1), (10, " x é", 1)]
    assert R.read_transcripts(spark, str(tmp_path), exclude_outputs=False).count() == 5
    assert [(r.chunk_no, r.target) for r in R.read_pairs(spark, str(tmp_path)).collect()] == [(1, "X.")]


def test_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\rthree\xff\n")
    (tmp_path / "b.txt").write_bytes("第1章\n".encode())
    got = {r.file[-5:]: r.text for r in R.read_texts_leniently(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "one\ntwo\nthree\n", "b.txt": "第1章\n"}
    assert {r.text for r in R.read_texts(spark, str(tmp_path) + "/b.txt").collect()} == {"第1章\n"}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "1", "a\nb"), (1, "2", "c")], "book int, chapter string, text string")
    W.write_chapters(df, str(tmp_path / "ch"))
    back = spark.read.text(str(tmp_path / "ch"), wholetext=True)
    assert {(r.book, r.chapter, r.value.rstrip("\n")) for r in back.collect()} == {(1, 1, "a\nb"), (1, 2, "c")}
    W.write_json(df, str(tmp_path / "j"), ["book"])
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    W.write_dead_letters(spark.createDataFrame([(1, "e")], "k int, error string"), str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).first().error == "e"
    pcm = spark.createDataFrame([(1, 1, bytearray(b"\x01\x00" * 1600)), (1, 2, None)], "id int, seg_no int, pcm binary")
    W.write_wav(pcm, str(tmp_path / "w"), "id", "seg_no", "pcm")
    row = spark.read.parquet(str(tmp_path / "w")).where("chunk_file = 'chunk_1.wav'").first()
    (tmp_path / "wavs").mkdir()
    (tmp_path / "wavs" / "chunk_1.wav").write_bytes(row.content)
    (tmp_path / "wavs" / "chunk_2.wav").write_bytes(b"no")
    got = {r.file[-5:]: (r.total_ms, r.error is None) for r in R.read_wav(spark, str(tmp_path / "wavs")).collect()}
    assert got == {"1.wav": (100, True), "2.wav": (None, False)}


def test_pages(spark):
    df = spark.createDataFrame([(1, bytearray(b"a\nb\fc"))], "id int, content binary")
    got = R.page_lines(df, "id", lambda raw: raw.decode().split("\f") + [None]).orderBy("page_no", "line_no").collect()
    assert [(r.page_no, r.line_no, r.line) for r in got] == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, 1, "")]


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    fill(folder)
    run = lambda: S.each_batch(S.read_stream(spark, str(folder)), lambda b: b.select("chunk_no", F.length("text").alias("n")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    run()
    first = sorted(r.chunk_no for r in spark.read.parquet(str(tmp_path / "out")).collect())
    (folder / "chunk_3.json").write_text((folder / "chunk_1.json").read_text(encoding="utf-8"), encoding="utf-8")
    run()
    assert first == [1, 2, 10] and sorted(r.chunk_no for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3, 10]


def test_windowed_counts(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:01:00' as ts, 'a b c' as text union all select timestamp'2024-01-01 00:12:00', 'd'").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "s"))
    q = S.words_per_window(stream, "ts", "text").writeStream.outputMode("complete").format("memory").queryName("words").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.n, r.words) for r in spark.sql("select * from words").collect()) == [(1, 1), (1, 3)]


def test_wav_names_and_decoder(spark, tmp_path):
    import wave

    from lectern.sources.readers import read_wav

    for name, rate in (("chunk_1.wav", 16_000), ("other.wav", 16_000), ("chunk_2.wav", 8_000)):
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes(b"\x01\x00" * 1600)
    (tmp_path / "chunk_3.mp3").write_bytes(b"mp3")
    take = lambda df: {r.file.rsplit("/", 1)[1]: (r.total_ms, r.error) for r in df.collect()}
    assert take(read_wav(spark, str(tmp_path))).keys() == {"chunk_1.wav", "chunk_2.wav", "other.wav"}
    assert take(read_wav(spark, str(tmp_path), chunks_only=True)) == {"chunk_1.wav": (100, None), "chunk_2.wav": (None, "not 16 kHz mono 16-bit")}

    def decode(content):
        if content == b"mp3":
            return b"\x00\x00" * 3200
        raise ValueError("unknown")

    assert take(read_wav(spark, str(tmp_path), True, decode)) == {"chunk_1.wav": (100, None), "chunk_2.wav": (None, "unknown"), "chunk_3.mp3": (200, None)}
