"""Continuous periods and gaps of overlapping, nested or scattered intervals.

The state that is merged is a list of sorted disjoint intervals. Every Arrow batch first makes such a list of each
(key, slice) in it, a slice being a fixed stretch of the axis in which an interval *starts*. Lists of one slice are
merged linearly behind one shuffle; a slice of ``width`` units can hold at most ``width`` distinct starts, so no task
ever holds a whole key, however large. The upper level of the tree is a scan over one small row per slice (its last
start and its furthest end), from which each slice learns what reaches into it from the left; slices that open a period
then tell the one before where its last period ended. Lists and their complements are emitted slice by slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_MS = 600_000


def merge_sorted(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint intervals of rows sorted by (group, start); intervals that touch become one."""
    if not len(start):
        return group, start, end
    new = np.empty(len(group), bool)
    new[0] = True
    new[1:] = group[1:] != group[:-1]
    number = np.cumsum(new) - 1
    base = int(start.min())
    span = int(end.max()) - base + 1
    if span * (int(number[-1]) + 1) < 2**62:
        reach = np.maximum.accumulate(end - base + number * span) - number * span + base
    else:  # the shift would overflow: group by group
        reach = end.copy()
        for part in np.split(np.arange(len(end)), np.flatnonzero(new)[1:]):
            reach[part] = np.maximum.accumulate(end[part])
    head = new.copy()
    head[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(head)
    last = np.append(at[1:] - 1, len(start) - 1)
    return group[at], start[at], reach[last]


def _lists(keys: pa.Array, slices: np.ndarray, group: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """One row per group 0..n-1, whose keys and slices are given in that order."""
    offsets = np.searchsorted(group, np.arange(len(slices) + 1)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (start, end)]
    return pa.RecordBatch.from_arrays([keys, pa.array(slices), *lists], ["key", "slice", "starts", "ends"])


def _group(key: np.ndarray, slices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the runs of equal (key, slice), and the place of each run's first row."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (slices[1:] != slices[:-1])
    return np.cumsum(new) - 1, np.flatnonzero(new)


def partial_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, slice, start, end) -> (key, slice, starts, ends), merged within each batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column(0).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        slices, start, end = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        order = np.lexsort((start, slices, code))
        code, slices, start, end = code[order], slices[order], start[order], end[order]
        number, first = _group(code, slices)
        yield _lists(coded.dictionary.take(pa.array(code[first])), slices[first], *merge_sorted(number, start, end))


def merge_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``partial_lists`` sorted by (key, slice) -> one row per (key, slice). A group may span batches: the
    last one of a batch is merged and carried on."""
    carry: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if carry is not None:
            batch = pa.Table.from_batches([carry, batch.select(carry.schema.names)]).combine_chunks().to_batches()[0]
        coded = batch.column(0).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        slices = batch.column(1).to_numpy(zero_copy_only=False)
        number, first = _group(code, slices)
        starts, ends = batch.column(2), batch.column(3)
        lengths = np.diff(starts.offsets.to_numpy())
        group = np.repeat(number, lengths)
        start, end = starts.flatten().to_numpy(zero_copy_only=False), ends.flatten().to_numpy(zero_copy_only=False)
        order = np.lexsort((start, group))  # the runs are sorted already, so this is a merge
        merged = _lists(coded.dictionary.take(pa.array(code[first])), slices[first], *merge_sorted(group[order], start[order], end[order]))
        carry = merged.slice(merged.num_rows - 1)
        if merged.num_rows > 1:
            yield merged.slice(0, merged.num_rows - 1)
    if carry is not None:
        yield carry


def periods_and_gaps(df: DataFrame, key: str, start: Column, end: Column, width: int = SLICE_MS) -> DataFrame:
    """Rows (key, kind, start, end): each 'period' that the intervals of a key cover, each 'gap' between two periods.

    ``start`` and ``end`` must be whole numbers (BIGINT). Intervals that touch are continuous. Rows whose key, start or
    end is null and rows that do not end after they start cover nothing. A key without any covering row has no output;
    an empty table gives none; repeated rows change nothing; further columns of ``df``, whatever their names, are not
    read. Nothing before the first or after the last period is a gap.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), start.cast("bigint").alias("s"), end.cast("bigint").alias("e")).where("key is not null and s < e")
    rows = rows.select("key", F.expr(f"s div {width} - if(s % {width} < 0, 1, 0)").alias("slice"), "s", "e")
    schema = f"key {kind}, slice bigint, starts array<bigint>, ends array<bigint>"
    lists = rows.mapInArrow(partial_lists, schema).repartition("key", "slice").sortWithinPartitions("key", "slice").mapInArrow(merge_lists, schema)

    by = Window.partitionBy("key")
    slices = (
        lists.select("key", "slice", F.element_at("starts", -1).alias("last_start"), F.element_at("ends", -1).alias("reach"))
        .withColumn("reached", F.max("reach").over(by.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("furthest", F.max("reach").over(by))
        .where("reached is null or last_start > reached")
        .select("key", "slice", "reached", "furthest")
    )
    # what starts at or before `reached` belongs to the period that comes in from the left; the rest opens periods here
    opening = lists.join(slices, ["key", "slice"]).select(
        "key",
        "slice",
        "furthest",
        F.expr("filter(arrays_zip(starts, ends), x -> reached is null or x.starts > reached)").alias("heads"),
        F.expr("if(reached is null, null, greatest(reached, array_max(filter(arrays_zip(starts, ends), x -> x.starts <= reached).ends)))").alias("before"),
    )
    inner = F.expr(
        """flatten(transform(heads, (h, i) -> array(
             struct('gap' as kind, if(i = 0, before, heads[greatest(i - 1, 0)].ends) as start, h.starts as end),
             struct('period' as kind, if(i = size(heads) - 1, null, h.starts) as start, h.ends as end))))"""
    )
    across = opening.select(
        "key",
        F.lit("period").alias("kind"),
        F.element_at("heads", -1)["starts"].alias("start"),
        F.coalesce(F.lead("before").over(by.orderBy("slice")), "furthest").alias("end"),
    )
    return opening.select("key", F.inline(inner)).where("start is not null").unionByName(across).withColumnRenamed("key", key)


def milliseconds(seconds: str) -> Column:
    """Seconds as whole milliseconds, halves away from zero; null where the value is null, NaN or infinite."""
    x = F.col(seconds)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.round(x * 1000)).cast("bigint")
