"""Event-stream operators in batch form: sessions, ordered funnels, paths, rollups, uniques. All take and return DataFrames.

A step is a row (session, t, seq, name): seq orders steps of equal time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def steps_of(events: DataFrame) -> DataFrame:
    """Steps of the events table: a session is a user's day."""
    session = F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))
    return events.select(session.alias("session"), F.col("ts").alias("t"), F.col("event_id").alias("seq"), F.col("event_type").alias("name"))


def sessions(steps: DataFrame) -> DataFrame:
    """One row for each session: start, end, whole seconds between them, steps."""
    out = steps.groupBy("session").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count(F.lit(1)).alias("steps"))
    seconds = F.round((F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 1_000_000).cast("long")
    return out.withColumn("seconds", seconds)


def _is_stage(name: Column, stage: str) -> Column:
    return (name == stage) | name.startswith(stage + ".")


def reached(steps: DataFrame, stages: list[str]) -> DataFrame:
    """(session, reached): how many stages, in order, the session's steps pass; a step advances by one stage at most."""
    wanted = steps.where(F.exists(F.array(*map(F.lit, stages)), lambda s: (F.col("name") == s) | F.col("name").startswith(F.concat(s, F.lit(".")))))
    ordered = wanted.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("t", "seq", "name"))).alias("run"))

    def advance(at: Column, step: Column) -> Column:
        out = at
        for k, stage in enumerate(stages):
            out = F.when((at == k) & _is_stage(step["name"], stage), F.lit(k + 1)).otherwise(out)
        return out

    return ordered.select("session", F.aggregate("run", F.lit(0), advance).alias("reached"))


def funnel(steps: DataFrame, stages: list[str]) -> DataFrame:
    """(stage_no, stage, reached, share): sessions that reach each stage, and their share of those that reach the first."""
    found = reached(steps, stages).agg(*[F.count_if(F.col("reached") >= k + 1).alias(f"r{k}") for k in range(len(stages))])
    rows = F.array(*[F.struct(F.lit(k + 1).alias("stage_no"), F.lit(s).alias("stage"), F.col(f"r{k}").alias("reached"), F.round(F.col(f"r{k}") / F.nullif(F.col("r0"), F.lit(0)), 6).alias("share")) for k, s in enumerate(stages)])
    return found.select(F.inline(rows))


def common_paths(steps: DataFrame, depth: int = 3, top: int = 8) -> DataFrame:
    """(path, sessions): the first steps of sessions without immediate repeats, the most frequent first, equal counts by path."""
    order = Window.partitionBy("session").orderBy("t", "seq")
    changed = steps.withColumn("before", F.lag("name").over(order)).where("before IS NULL OR before <> name")
    first = changed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= depth)
    paths = first.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]), " → ").alias("path"))
    return paths.groupBy("path").agg(F.count(F.lit(1)).alias("sessions")).orderBy(F.desc("sessions"), "path").limit(top)


def daily(events: DataFrame, time: str = "ts", bucket: str = "event_type") -> DataFrame:
    """(day, bucket, events): counters of a tumbling day."""
    day = events.groupBy(F.window(time, "1 day").alias("w"), F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("events"))
    return day.select(F.to_date("w.start").alias("day"), "bucket", "events")


def uniques(events: DataFrame, who: str = "user_id", time: str = "ts") -> DataFrame:
    """(day, people): distinct visitors of each day; several days add up, a visitor counts once on each."""
    return events.groupBy(F.to_date(time).alias("day")).agg(F.count_distinct(who).alias("people"))


def sketched_uniques(events: DataFrame, who: str = "user_id", time: str = "ts") -> DataFrame:
    """(day, people, sketch): the same by a mergeable HyperLogLog sketch."""
    out = events.groupBy(F.to_date(time).alias("day")).agg(F.hll_sketch_agg(who).alias("sketch"))
    return out.select("day", F.hll_sketch_estimate("sketch").alias("people"), "sketch")


def merge_top(counters: DataFrame, top: int = 12) -> DataFrame:
    """Daily counters (bucket, events) added up over days; the largest, equal ones by bucket."""
    return counters.groupBy("bucket").agg(F.sum("events").alias("events")).orderBy(F.desc("events"), "bucket").limit(top)


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median): the value at place floor(n / 2) of each group in order, found by counting equal values, not by gathering the group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*keys)
    placed = counts.withColumn("upto", F.sum("n").over(group.orderBy(value))).withColumn("all", F.sum("n").over(group))
    return placed.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(*keys).agg(F.min(value).alias("median"))


def debounced(events: DataFrame, who: str, what: str, time: str, gap_seconds: int = 60) -> DataFrame:
    """(who, what, visits, last): a repeat within the gap of the event before it is the same visit; a gap of exactly that length is a new one."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    before = F.lag(micros).over(Window.partitionBy(who, what).orderBy(time))
    fresh = events.withColumn("fresh", F.coalesce(micros - before >= gap_seconds * 1_000_000, F.lit(True)))
    return fresh.groupBy(who, what).agg(F.count_if("fresh").alias("visits"), F.max(time).alias("last"))


def newest_of_day(events: DataFrame, cap: int, time: str = "ts", seq: str = "event_id") -> DataFrame:
    """The newest rows of each day, at most cap; the cap is the feature: what a capped stream keeps."""
    order = Window.partitionBy(F.to_date(time)).orderBy(F.desc(time), F.desc(seq))
    return events.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= cap).drop("__n")


def accepted(events: DataFrame, names: list[str], name: str = "event_type", label: str = "props") -> DataFrame:
    """Events with an allowed name; label stripped to plain characters and 60 of them."""
    clean = F.substring(F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), r"[^A-Za-z0-9 ._/-]", "")), 1, 60)
    return events.where(F.col(name).isin(names)).withColumn("label", clean)


def merge_visits(one: DataFrame, two: DataFrame, top: int = 200) -> DataFrame:
    """Two lists (id, visits, title, seen) as one: the larger count, the later title and time; the newest of them."""
    both = one.unionByName(two).groupBy("id").agg(F.max("visits").alias("visits"), F.max_by("title", F.struct("seen", "title")).alias("title"), F.max("seen").alias("seen"))
    return both.orderBy(F.desc("seen"), "id").limit(top)


def visit_summary(visits: DataFrame) -> DataFrame:
    """(papers, opens, since) of a list (id, visits, seen)."""
    return visits.agg(F.count(F.lit(1)).alias("papers"), F.sum("visits").alias("opens"), F.min("seen").alias("since"))
