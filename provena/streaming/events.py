"""Event-stream operators as Structured Streaming jobs; each has a batch twin in operators.sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_folder

EVENTS = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = 1) -> DataFrame:
    """A stream over files of events, a folder of them or a pattern; ts becomes the event time.

    Without files_per_batch all files that are there make one batch: in a finished table, whose files
    may be in any order of time, no row is then late.
    """
    reader = spark.readStream.schema(EVENTS).option("recursiveFileLookup", True)
    rows = (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, bucket, events): counters of a tumbling day; the state of days past the watermark is dropped."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), F.col("event_type").alias("bucket")).agg(F.count(F.lit(1)).alias("events"))
    return counts.select(F.to_date("w.start").alias("day"), "bucket", "events")


def daily_uniques(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, people): a HyperLogLog sketch a day, so the state doesn't grow with visitors."""
    sketch = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w")).agg(F.hll_sketch_agg("user_id").alias("s"))
    return sketch.select(F.to_date("w.start").alias("day"), F.hll_sketch_estimate("s").alias("people"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, steps): for events without session ids, runs without a pause of the gap."""
    runs = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("steps"))
    return runs.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "steps")


def funnel(events: DataFrame, stages: list[str], keep: str = "1 day") -> DataFrame:
    """(session, reached) of sessions that a batch brought steps and that have reached a stage: a pointer for each session, advanced by one stage at most with each step in order of time. The state holds the session's steps at any stage, so that steps of an earlier time may come in a later batch; it is dropped once the session's day is older than the watermark."""
    day = events.withColumn("day", F.date_trunc("day", "ts")).withWatermark("day", f"{keep} 1 day")  # a day ends a day after it begins
    reaches = lambda name, stage: (name == stage) | name.startswith(F.concat(stage, F.lit(".")))
    any_stage = F.exists(F.array(*map(F.lit, stages)), lambda stage: reaches(F.col("event_type"), stage))
    steps = day.groupBy("user_id", "day").agg(F.collect_list(F.when(any_stage, F.struct("ts", "event_id", "event_type"))).alias("steps"))
    wanted = F.array(*map(F.lit, stages))
    advance = lambda at, step: at + F.coalesce(reaches(step["event_type"], F.get(wanted, at)), F.lit(False)).cast("int")
    session = F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("day").cast("string"))
    return steps.select(session.alias("session"), F.aggregate(F.array_sort("steps"), F.lit(0), advance).alias("reached")).where("reached > 0")


def run_available(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over what is there and returns what it wrote: with complete the last batch, else all of them."""
    spark, written = stream.sparkSession, []
    folder = new_folder(spark, f"stream-{name}")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{number}")  # a batch that is repeated after a failure replaces itself
        written.append(number)

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    if not written:
        return spark.createDataFrame([], stream.schema)
    paths = [f"{folder}/rows/{n}" for n in (written[-1:] if mode == "complete" else written)]
    return spark.read.schema(stream.schema).parquet(*paths)
