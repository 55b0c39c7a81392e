"""Operators put together: books from pages, pieces from audio."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import models as M
from lectern.operators import segments as G
from lectern.operators import text as T


def dump_pages(lines: DataFrame, key: str) -> DataFrame:
    """(key, text): the lines of a document's pages in order, each followed by a line feed."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "line_no", "line")))
    return lines.groupBy(key).agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def ingest_chinese_book(lines: DataFrame, key: str) -> DataFrame:
    """(key, part, text) from the lines of pages (key, page_no, line_no, line): doubled ideographs undone, broken chapter
    numbers mended within their page, lines re-flowed over the whole book, chapters split. Part 'title' is what stands
    before the first chapter; of two chapters with one number the later stays."""
    rows = lines.withColumn("line", X.undouble(F.col("line")))
    rows = T.fix_chapter_numbers(rows, [key, "page_no"], "line_no", "line")
    books = dump_pages(rows, key).withColumn("text", F.regexp_replace("text", r"\n\z", ""))
    return T.split_chapters_zh(books.withColumn("text", T.reflow(F.split("text", "\n"))), key, "text")


def ingest_english_book(books: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chapter_no, text) of whole texts; line ends are normalised first."""
    return T.split_chapters_en(books.withColumn(text, F.regexp_replace(text, "\r\n?", "\n")), key, text)


def split_audio(audio: DataFrame, key: str, pcm: str, silence_ms: int = 1000, frame_ms: int = 30, min_chunk_sec: float = 5.0, is_speech=M.energy_is_speech) -> DataFrame:
    """(key, seg_no, start_ms, end_ms, pcm): audio cut after silences, short pieces merged, nothing of it lost."""
    frames = M.frames(audio, key, pcm, frame_ms, is_speech)
    totals = audio.where(F.col(pcm).isNotNull()).select(key, F.expr(f"octet_length({pcm}) div {M.RATE * M.WIDTH // 1000}").alias("total_ms"))
    cuts = G.silence_cuts(frames, key, "frame_no", "is_speech", G.frames_needed(silence_ms, frame_ms))
    segments = G.merge_short(G.cut_intervals(cuts, key, totals, "total_ms", frame_ms), key, int(min_chunk_sec * 1000))
    return segments.join(M.cut_audio(audio, key, pcm, segments), [key, "seg_no"])
