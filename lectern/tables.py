"""Reading the project's tables and cutting lineage."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where shared files go when the session names no place and runs on one machine only (tests).
LOCAL_SHARED = "/tmp/lectern-shared"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local master does without it."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    os.makedirs(LOCAL_SHARED, exist_ok=True)
    return f"file://{LOCAL_SHARED}"


#: Shuffle files of a stage that was written out are of no more use.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _path(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends there, and a lost executor costs nothing.

    The table is deleted by ``discard``, or else when the application ends; its name is unique to the call.
    """
    spark = df.sparkSession
    place = f"{shared_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(place)
    finally:
        spark.conf.set(CLEAN, before)
    path, fs = _path(spark, place)
    fs.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(place)
    out._lectern_place = place
    return out


def mounted(table: DataFrame) -> str | None:
    """The folder of a materialised table as a path, if it is a plain one that processes can open by its name."""
    path, fs = _path(table.sparkSession, table._lectern_place)
    return fs.makeQualified(path).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def discard(*tables: DataFrame | None) -> None:
    """Delete materialised tables that nothing reads any more."""
    for t in tables:
        place = getattr(t, "_lectern_place", None)
        if place:
            path, fs = _path(t.sparkSession, place)
            fs.delete(path, True)
            fs.cancelDeleteOnExit(path)
