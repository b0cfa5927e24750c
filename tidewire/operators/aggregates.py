"""Statistics of runs and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def timing_stats(trace: DataFrame, by: str = "component", value: str = "processing_ms", slow: str = "is_slow") -> DataFrame:
    return trace.groupBy(by).agg(F.count(value).alias("count"), F.avg(value).alias("avg_ms"), F.max(value).alias("max_ms"), F.min(value).alias("min_ms"), F.count_if(F.col(slow)).alias("slow_count"))


def p95_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """sorted[min(int(n * 0.95), n - 1)] of each group, exactly, without sorting it: (keys, n, p95).

    A sketch, made by partial aggregation, gives two values that surely lie around it (its error of a ten-thousandth of the ranks is a twentieth of
    the margin). Rows below are counted; equal values between are counted first, so that only distinct values of the margin are put in order.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    around = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", [0.948, 0.952], 10_000).alias("_q"))
    around = around.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_n", F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    low = F.col("_v") < F.col("_lo")
    met = rows.join(F.broadcast(around) if not keys else around, same).where(F.col("_v") <= F.col("_hi"))
    met = met.groupBy(*keys, "_n", F.when(~low, F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))  # all rows below are one: the null
    upto = met.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys, "_n").orderBy(F.asc_nulls_first("_v"))))
    target = F.least((F.col("_n") * F.lit(0.95)).cast("bigint"), F.col("_n") - 1)
    return upto.where(F.col("_upto") > target).groupBy(*keys, F.col("_n").alias("n")).agg(F.min("_v").alias("p95"))


def run_stats(results: DataFrame, start_ns: str = "start_ns", end_ns: str = "end_ns", ms: str = "processing_ms") -> DataFrame:
    """One row: counters, throughput and latencies of a run's frames (frame_id, ok, processing_ms, triggers, observations, start_ns, end_ns)."""
    seconds = F.when(F.max(end_ns).isNotNull() & F.min(start_ns).isNotNull(), (F.max(end_ns) - F.min(start_ns)) / F.lit(1e9)).otherwise(F.lit(0.0))
    a = results.agg(
        F.count("*").alias("frames_ingested"), F.count_if("ok").alias("frames_extracted"), F.count_if(~F.col("ok")).alias("extractions_failed"), F.sum("triggers").alias("triggers_fired"), F.sum("observations").alias("observations_output"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col(ms))), F.lit(0.0)).alias("total_ms"), F.coalesce(F.avg(F.when(F.col("ok"), F.col(ms))), F.lit(0.0)).alias("avg_ms"), seconds.alias("duration_sec"),
    )
    high = p95_by(results.where("ok"), [], ms).select(F.col("p95").alias("p95_ms"))
    a = a.join(F.broadcast(high), F.lit(True), "left").withColumn("p95_ms", F.coalesce("p95_ms", F.lit(0.0)))  # one row each
    return a.withColumn("throughput_fps", throughput(F.col("frames_extracted"), F.col("duration_sec")))


def worker_stats(results: DataFrame, worker: str = "worker", frame: str = "frame_id") -> DataFrame:
    """One row: what workers did, from rows with their struct(observation, error, timing_ms): frames, observations, timeouts, other errors, mean time of a frame."""
    w = F.col(worker)
    timeout = F.coalesce(w["error"].startswith("TimeoutError"), F.lit(False))
    return results.agg(
        F.count_distinct(frame).alias("frames_processed"), F.count(w["observation"]).alias("total_observations"), F.count_if(timeout).alias("timeouts"), F.count_if(w["error"].isNotNull() & ~timeout).alias("errors"),
        F.when(F.count_distinct(frame) > 0, F.sum(w["timing_ms"]) / F.count_distinct(frame)).otherwise(F.lit(0.0)).alias("avg_time_ms"),
    )


def session_stats(frames: DataFrame, trigger, keys: tuple = ("stream_id",), time: str = "t_ns") -> DataFrame:
    """A row for each session: frames, those for which ``trigger`` holds, seconds from the first to the last."""
    return frames.groupBy(*keys).agg(F.count("*").alias("frames"), F.count_if(trigger).alias("triggers"), ((F.max(time) - F.min(time)) / F.lit(1e9)).alias("duration_sec"))


def throughput(frames, seconds):
    return F.when(seconds > 0, frames / seconds).otherwise(F.lit(0.0))


def duration(frames, fps):
    return F.when(fps > 0, frames / fps).otherwise(F.lit(0.0))


def fps_summary(trace: DataFrame, every: int = 100) -> DataFrame:
    """A row for each ``every`` frames: frames, mean, largest and 95th-percentile latency, slow ones; with a ``component`` column, each component's mean."""
    t = trace.withColumn("window", F.floor(F.col("frame_id") / every))
    out = t.groupBy("window").agg(F.count("*").alias("frames"), F.avg("processing_ms").alias("avg_ms"), F.max("processing_ms").alias("max_ms"), F.count_if("is_slow").alias("slow"))
    out = out.join(p95_by(t, ["window"], "processing_ms").select("window", F.col("p95").alias("p95_ms")), "window", "left")
    if "component" in trace.columns:
        each = t.groupBy("window", "component").agg(F.avg("processing_ms").alias("ms"))
        each = each.groupBy("window").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("component", "ms")))).alias("component_avg_ms"))
        out = out.join(each, "window", "left")
    return out
