"""Cutting audio at silences and merging short pieces, as window expressions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frames_needed(silence_ms: int = 1000, frame_ms: int = 30) -> int:
    """Frames without speech after which a cut is made; frames are 10, 20 or 30 ms long."""
    if frame_ms not in (10, 20, 30):
        raise ValueError("frame_ms must be 10, 20 or 30")
    return math.ceil(silence_ms / frame_ms)


def silence_cuts(frames: DataFrame, key: str, frame_no: str, is_speech: str, needed: int) -> DataFrame:
    """(key, cut_frame): a cut after every ``needed``-th frame of a run without speech; a long run is cut repeatedly."""
    w = Window.partitionBy(key).orderBy("f")
    rows = frames.select(key, F.col(frame_no).alias("f"), F.col(is_speech).alias("s")).withColumn("island", F.sum(F.col("s").cast("int")).over(w))
    quiet = rows.where(~F.col("s")).withColumn("r", F.row_number().over(Window.partitionBy(key, "island").orderBy("f")))
    return quiet.where(F.col("r") % needed == 0).select(key, (F.col("f") + 1).alias("cut_frame"))


def cut_intervals(cuts: DataFrame, key: str, totals: DataFrame, total_ms: str, frame_ms: int = 30) -> DataFrame:
    """(key, seg_no, start_ms, end_ms): pieces between cuts that cover the whole audio; the last runs to its end, empty
    ones go."""
    starts = totals.select(key, F.col(total_ms).alias("total"), F.lit(0).cast("bigint").alias("start_ms")).unionByName(
        cuts.join(totals.select(key, F.col(total_ms).alias("total")), key).select(key, "total", (F.col("cut_frame") * frame_ms).cast("bigint").alias("start_ms"))
    )
    w = Window.partitionBy(key).orderBy("start_ms")
    rows = starts.withColumn("end_ms", F.coalesce(F.lead("start_ms").over(w), F.col("total")))
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.col(c), F.col("total")))
    rows = rows.select(key, clamp("start_ms").cast("bigint").alias("start_ms"), clamp("end_ms").cast("bigint").alias("end_ms")).where("end_ms > start_ms")
    return rows.withColumn("seg_no", F.row_number().over(w)).select(key, "seg_no", "start_ms", "end_ms")


def merge_short(segments: DataFrame, key: str, min_ms: int = 5000) -> DataFrame:
    """(key, seg_no, start_ms, end_ms): contiguous pieces shorter than ``min_ms`` joined to the one before, at the start
    to the one after. A new piece starts where a piece is long enough and so is all that came before it."""
    w = Window.partitionBy(key).orderBy("start_ms")
    rows = segments.select(key, "start_ms", "end_ms").withColumn("first", F.min("start_ms").over(w)).withColumn("before", F.lag("end_ms").over(w))
    new = (F.col("end_ms") - F.col("start_ms") >= min_ms) & (F.col("before") - F.col("first") >= min_ms)
    rows = rows.withColumn("g", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(w))
    out = rows.groupBy(key, "g").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return out.select(key, (F.col("g") + 1).alias("seg_no"), "start_ms", "end_ms")
