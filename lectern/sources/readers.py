"""Reading texts, transcripts, pairs, audio and page dumps; the file name carries the key."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X

TRANSCRIPT = "chunk_file string, text string, language string, segments array<struct<id: bigint, start: double, end: double, text: string>>"
PAIR_EN = "chunk_file string, source string, target string"
PAIR_ZH = "chunk_file string, en string, zh string"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): whole files; CR LF and CR become LF, as text mode has it."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return rows.withColumn("text", F.regexp_replace("text", "\r\n?", "\n"))


def read_texts_leniently(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of UTF-8 files of which bad bytes are dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"file": b["path"], "text": [x.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") for x in b["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, text string")


def _json(spark: SparkSession, path: str, schema: str, glob: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", glob).json(path).withColumn("file", F.col("_metadata.file_name"))


def read_transcripts(spark: SparkSession, path: str, exclude_outputs: bool = True) -> DataFrame:
    """Transcripts chunk_N.json with their number; aligned and error files are left out unless asked for."""
    rows = _json(spark, path, TRANSCRIPT, "*.json")
    if exclude_outputs:
        rows = rows.where(~F.col("file").rlike("aligned|_error"))
    return rows.withColumn("chunk_no", X.chunk_number(F.col("file")))


def read_pairs(spark: SparkSession, path: str, chinese: bool = False) -> DataFrame:
    """Aligned pairs chunk_N_aligned.json with their number."""
    return _json(spark, path, PAIR_ZH if chinese else PAIR_EN, "*_aligned.json").withColumn("chunk_no", X.chunk_number(F.col("file")))


def _samples(content: bytes) -> bytes | None:
    """The samples of a 16 kHz mono 16-bit wave file; null for other forms."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            return w.readframes(w.getnframes()) if (w.getframerate(), w.getnchannels(), w.getsampwidth()) == (16_000, 1, 2) else None
    except (wave.Error, EOFError):
        return None


def read_wav(spark: SparkSession, path: str, chunks_only: bool = False, decode=None) -> DataFrame:
    """(file, pcm, total_ms, error) of 16 kHz mono 16-bit wave files; with ``chunks_only`` of those whose names hold
    'chunk'. Other forms and containers are for ``decode(bytes) -> samples`` (16 kHz mono 16-bit): if it is given, files of
    any name are read. What fails, fails in its row (pcm null, error set)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"]):
                try:
                    pcm = _samples(c)
                    if pcm is None and decode is None:
                        raise ValueError("not 16 kHz mono 16-bit")
                    pcm = decode(c) if pcm is None else pcm
                    rows.append((p, pcm, len(pcm) // 2 * 1000 // 16_000, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((p, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["file", "pcm", "total_ms", "error"])

    name = ("*chunk" if chunks_only else "") + ("*" if decode is not None else "*.wav")
    files = spark.read.format("binaryFile").option("pathGlobFilter", name).load(path).select("path", "content")
    return files.mapInPandas(run, "file string, pcm binary, total_ms bigint, error string")


def page_lines(df: DataFrame, key: str, pages) -> DataFrame:
    """(key, page_no, line_no, line) of binary documents (key, content), by an adapter ``pages(bytes) -> list of page
    texts``; a page without text has one empty line."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, p, n, line) for k, c in zip(b[key], b["content"]) for p, t in enumerate(pages(c), 1) for n, line in enumerate((t or "").split("\n"), 1)]
            yield pd.DataFrame(rows, columns=["k", "page_no", "line_no", "line"])

    return df.select(key, "content").mapInPandas(run, f"k {kind}, page_no int, line_no int, line string").withColumnRenamed("k", key)
