"""Problem 5: periods and gaps of the segments of each audio."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.intervals import milliseconds, periods_and_gaps
from lectern.tables import table


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "segments").select("audio_id", milliseconds("start").alias("s"), milliseconds("end").alias("e"))
    out = periods_and_gaps(rows, "audio_id", F.col("s"), F.col("e"))
    return out.select("audio_id", "kind", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"))


QUERIES = {"p5_found": p5_found}

SQL = {
    "p5_found": """
with x as (select audio_id, cast(round("start" * 1000) as bigint) as s, cast(round("end" * 1000) as bigint) as e
           from segments where "start" is not null and "end" is not null and not isnan("start") and not isnan("end")),
y as (select *, max(e) over (partition by audio_id order by s, e rows between unbounded preceding and 1 preceding) as m from x where e > s),
z as (select *, sum(case when m is null or s > m then 1 else 0 end) over (partition by audio_id order by s, e rows unbounded preceding) as g from y),
p as (select audio_id, g, min(s) as a, max(e) as b from z group by audio_id, g),
q as (select audio_id, a, b, lag(b) over (partition by audio_id order by g) as before from p)
select audio_id, 'period' as kind, a as start_ms, b as end_ms from q
union all select audio_id, 'gap', before, a from q where before is not null
"""
}
