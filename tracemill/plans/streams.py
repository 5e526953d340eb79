"""Streaming operators run to the end of the events table, their results read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.plans.relational import _ADMITTED, _LAST, _LEDGER
from tracemill.session import scratch
from tracemill.streaming import stateful as SS
from tracemill.tables import load

Query = Callable[[SparkSession, str], DataFrame]


def run_to_end(out: DataFrame) -> DataFrame:
    """Run a stream over all that is there now, into Parquet in the shared folder."""
    spark = out.sparkSession
    where = scratch(spark, "out")
    query = out.writeStream.format("parquet").option("path", where).option("checkpointLocation", f"{where}-state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(where)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.readStream.schema(load(spark, d, "events").schema).parquet(f"{d}/events.parquet*")


def stream_ledger(spark, d):
    """The ledger of each user as events arrive; the last state of each."""
    e = _events(spark, d)
    events = e.select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "withdraw").otherwise("deposit").alias("kind"), F.round(F.col("value") * 100).cast("bigint").alias("amount"))
    states = run_to_end(SS.stream_ledger(events, "user_id"))
    last = states.groupBy("account").agg(F.max_by(F.struct("balance", "error"), "seq").alias("s"))
    return last.select(F.col("account").cast("bigint").alias("user_id"), "s.balance", "s.error")


def stream_windows(spark, d):
    """Events per hour and type, for the hours that the watermark has closed."""
    counts = run_to_end(SS.windowed_counts(_events(spark, d), "ts", ["event_type"], "1 hour"))
    return counts.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")


def stream_limiter(spark, d):
    """Three events an hour per user, as they arrive: all of them in one batch, which is taken by time."""
    e = _events(spark, d).withColumn("now", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return run_to_end(SS.stream_limiter(e, "user_id", "now", 3, 3600.0))


def queries() -> dict[str, Query]:
    return {"stream_ledger": stream_ledger, "stream_windows": stream_windows, "stream_limiter": stream_limiter}


def sql() -> dict[str, str]:
    return {
        "stream_ledger": _LEDGER.format(where="") + _LAST.replace("balance, last_seq, error", "balance, error"),
        "stream_limiter": _ADMITTED + "SELECT CAST(user_id AS VARCHAR) AS key, now, allowed, retry_after FROM walk",
        "stream_windows": """
            SELECT strftime(h, '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS h, event_type FROM events)
            WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL""",
    }
