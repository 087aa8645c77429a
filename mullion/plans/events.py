"""Queries on the event table: windows in batch and as a stream run to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mullion.plans.manifests import table
from mullion.scale import Scratch
from mullion.streaming import windows

DAILY_SQL = "select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2"


def _daily(df: DataFrame) -> DataFrame:
    return df.withColumn("total", F.round("total", 4))


def event_daily(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(windows.tumbling(table(spark, sf, "events"), "ts", "event_type", "value"))


def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return windows.sessions(table(spark, sf, "events").select("ts", "user_id"), "ts", "user_id", "6 hours")


def event_daily_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The daily windows from a stream over the table's files, ended when all input is read; complete output."""
    scratch = Scratch(spark)
    # A pattern, as the table may be one file or a folder of files; a stream's plain path has to be a folder.
    files = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events.parque[t]")
    out = f"{scratch.root}/daily"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = windows.tumbling(files.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value").writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{scratch.root}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return _daily(spark.read.parquet(out)).withColumn("start", F.col("start").cast("timestamp_ntz"))


QUERIES = {"event_daily": event_daily, "event_sessions": event_sessions, "event_daily_stream": event_daily_stream}
SQL = {
    "event_daily": DAILY_SQL,
    "event_daily_stream": DAILY_SQL,
    "event_sessions": """with e as (select ts, user_id, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as g from e) select user_id, min(ts) as start, max(ts) + interval 6 hours as "end", count(*) as n from s group by user_id, g""",
}
