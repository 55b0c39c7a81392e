"""Writing transcripts, pairs, chapters and dead letters. Inputs are never overwritten."""

from __future__ import annotations

import io
import wave

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


def write_json(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """One object a line, characters as they are, folders by ``by``."""
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).json(path)


def write_chapters(df: DataFrame, path: str, book: str = "book", chapter: str = "chapter", text: str = "text", mode: str = "overwrite") -> None:
    """One text file per row under book=.../chapter=..., line feeds kept."""
    df.select(book, chapter, F.col(text).cast("string").alias("value")).write.mode(mode).partitionBy(book, chapter).option("lineSep", "\n").text(path)


def write_dead_letters(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


@F.pandas_udf(BinaryType())
def wav_bytes(pcm: pd.Series) -> pd.Series:
    """A 16 kHz mono 16-bit wave file around raw samples."""

    def one(raw: bytes) -> bytes:
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(16_000)
            w.writeframes(raw)
        return out.getvalue()

    return pcm.map(one, na_action="ignore").astype(object)


def write_wav(df: DataFrame, path: str, key: str, seg_no: str, pcm: str, mode: str = "overwrite") -> None:
    """Rows (key, chunk_file, content) of wave files, as a table: a file per chunk does not scale."""
    df.select(key, F.concat(F.lit("chunk_"), F.col(seg_no).cast("string"), F.lit(".wav")).alias("chunk_file"), wav_bytes(pcm).alias("content")).write.mode(mode).parquet(path)
