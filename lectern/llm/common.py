"""Shared helpers of the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes per task, by the planner's estimate for the columns that are read, from which a table is spread enough as it is.
ENOUGH = 1 << 20


def spread(df: DataFrame, per: int = 2) -> DataFrame:
    """``df`` over ``per`` partitions for each task that the session runs at a time. A small table is dealt out anew; one that
    keeps all tasks busy stays as it was read, without a shuffle. Decided from the planner's estimate of the size:
    nothing is run."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(per * wanted) if size < wanted * ENOUGH else df


def key(df: DataFrame, column: str, alias: str) -> Column:
    """A key column as text for the way through Python: whole numbers beside nulls would become floats there."""
    return F.col(column).cast("string").alias(alias)


def keyed(out: DataFrame, df: DataFrame, column: str, alias: str) -> DataFrame:
    """``out`` with the key in the type and under the name that it has in ``df``."""
    return out.withColumn(alias, F.col(alias).cast(df.schema[column].dataType)).withColumnRenamed(alias, column)
