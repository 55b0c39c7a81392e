"""Boundaries to speech models, with stand-ins where one is honest."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lectern.operators.align import built

RATE, WIDTH = 16_000, 2


def energy_is_speech(frame: bytes, threshold: float = 500.0) -> bool:
    """Stand-in for a voice detector: loudness (root mean square of 16-bit samples) over a threshold."""
    samples = np.frombuffer(frame[: len(frame) // 2 * 2], "<i2").astype(float)
    return bool(len(samples)) and float(np.sqrt((samples**2).mean())) >= threshold


def frames(df: DataFrame, key: str, pcm: str, frame_ms: int = 30, is_speech=energy_is_speech) -> DataFrame:
    """(key, frame_no, is_speech): whole frames of 16 kHz mono 16-bit samples; a last part of a frame is not judged."""
    if frame_ms not in (10, 20, 30):
        raise ValueError("frame_ms must be 10, 20 or 30")
    size = RATE * frame_ms // 1000 * WIDTH
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, raw in zip(batch[key], batch[pcm]):
                if raw is not None:
                    n = len(raw) // size
                    yield pd.DataFrame({"k": [k] * n, "frame_no": range(n), "is_speech": [is_speech(raw[i * size : (i + 1) * size]) for i in range(n)]})

    return df.select(key, pcm).mapInPandas(run, f"k {kind}, frame_no int, is_speech boolean").withColumnRenamed("k", key)


def cut_audio(df: DataFrame, key: str, pcm: str, segments: DataFrame) -> DataFrame:
    """(key, seg_no, pcm): the samples of each piece of audio, by its milliseconds."""
    per_ms = RATE * WIDTH // 1000
    from pyspark.sql import functions as F

    joined = segments.join(df.select(key, F.col(pcm).alias("_pcm")), key)
    return joined.select(key, "seg_no", F.expr(f"substring(_pcm, cast(start_ms * {per_ms} + 1 as int), cast((end_ms - start_ms) * {per_ms} as int))").alias("pcm"))


def transcribe(df: DataFrame, key: str, pcm: str, make) -> DataFrame:
    """(key, text, language, segments, error) by an adapter built once per Python worker, whose ``one(bytes)`` returns a
    dict in the form of a transcript. There is no stand-in for a recogniser."""
    kind, token = df.schema[key].dataType.simpleString(), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = built(token, make)
        for batch in batches:
            rows = []
            for k, raw in zip(batch[key], batch[pcm]):
                try:
                    t = model.one(raw)
                    rows.append((k, t.get("text", ""), t.get("language", ""), [{n: s.get(n) for n in ("id", "start", "end", "text")} for s in t.get("segments", [])], None))
                except Exception as e:  # noqa: BLE001
                    rows.append((k, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["k", "text", "language", "segments", "error"])

    schema = f"k {kind}, text string, language string, segments array<struct<id:bigint,start:double,end:double,text:string>>, error string"
    return df.select(key, pcm).mapInPandas(run, schema).withColumnRenamed("k", key)
