import random

from pyspark.sql import functions as F

from lectern.operators.intervals import milliseconds, periods_and_gaps


def by_hand(rows):
    groups = {}
    for k, s, e in rows:
        if k is not None and s is not None and e is not None and e > s:
            groups.setdefault(k, []).append((s, e))
    out = []
    for k, g in groups.items():
        merged = []
        for s, e in sorted(g):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(k, "period", s, e) for s, e in merged]
        out += [(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out)


def run(spark, rows, width=600_000):
    df = spark.createDataFrame(rows, "key bigint, start bigint, end bigint").withColumn("slice", F.lit("x"))
    out = periods_and_gaps(df.repartition(4), "key", F.col("start"), F.col("end"), width)
    return sorted(map(tuple, out.collect()))


def test_random_against_brute_force(spark):
    r = random.Random(5)
    for width, reach in ((7, 30), (100, 90), (600_000, 30)):
        rows = []
        for _ in range(700):
            s = r.randrange(-200, 2000)
            rows.append((r.choice([1, 1, 1, 2, 3, None]), r.choice([s, s, s, s, None]), s + r.randrange(-3, r.choice([3, reach]))))
        rows += rows[:50]
        assert run(spark, rows, width) == by_hand(rows)


def test_long_interval_over_many_slices(spark):
    rows = [(1, 0, 1000), (1, 50, 60), (1, 500, 1001), (1, 1001, 1005), (1, 1007, 1009), (2, -50, -40), (2, -5, 5)]
    assert run(spark, rows, 10) == by_hand(rows)


def test_no_rows_and_useless_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, 5, 5), (1, 6, 5), (1, None, 5), (1, 5, None), (None, 1, 2)]) == []


def test_huge_values(spark):
    rows = [(k, s, s + 5) for k in range(50) for s in (-(2**55), 0, 2**55)]
    assert run(spark, rows, 1000) == by_hand(rows)


def test_milliseconds(spark):
    df = spark.createDataFrame([(1.0005,), (2.345000000001,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r[0] for r in df.select(milliseconds("x")).collect()] == [1001, 2345, None, None, None]
