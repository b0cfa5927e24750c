"""Stateless operators: sources, row rewriting, filters, routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..schema import FLOW_COLUMNS, OBS


def to_flow(frames: DataFrame, path_id: str = "default") -> DataFrame:
    """Frames (stream_id, frame_id, t_ns, seq and any payload) as flow rows with no observations. Missing stream and seq are ``main`` and the frame id."""
    has = set(frames.columns)
    base = [
        (F.col("stream_id").cast("string") if "stream_id" in has else F.lit("main")).alias("stream_id"),
        F.col("frame_id").cast("bigint").alias("frame_id"),
        F.col("t_ns").cast("bigint").alias("t_ns"),  # as it is, so that filters on it reach the scan
        (F.col("seq") if "seq" in has else F.col("frame_id")).cast("bigint").alias("seq"),
        F.lit(path_id).alias("path_id"),
        F.coalesce(F.col("t_ns").cast("bigint"), F.lit(0)).alias("timestamp_ns"),
        F.expr(f"cast(array() as array<{OBS}>)").alias("observations"),
        F.expr(f"cast(array() as array<{OBS}>)").alias("results"),
        F.expr("cast(map() as map<string,string>)").alias("metadata"),
    ]
    return frames.select(*base, *[F.col(f"`{c}`") for c in frames.columns if c not in FLOW_COLUMNS])


def with_path(df: DataFrame, path_id: str) -> DataFrame:
    return df.withColumn("path_id", F.lit(path_id))


def add_observations(df: DataFrame, *obs: Column) -> DataFrame:
    """Append observations, null ones left out, in their order."""
    return df.withColumn("observations", F.concat("observations", F.array_compact(F.array(*obs))))


def add_results(df: DataFrame, *obs: Column) -> DataFrame:
    return df.withColumn("results", F.concat("results", F.array_compact(F.array(*obs))))


def with_observations(df: DataFrame, *obs: Column) -> DataFrame:
    """Replace the observations."""
    return df.withColumn("observations", F.array_compact(F.array(*obs)))


def with_results(df: DataFrame, *obs: Column) -> DataFrame:
    return df.withColumn("results", F.array_compact(F.array(*obs)))


def keep(df: DataFrame, condition: Column) -> DataFrame:
    """Null is false, so the condition goes to the scan as it is."""
    return df.where(condition)


def min_observations(df: DataFrame, n: int = 1) -> DataFrame:
    return df.where(F.size("observations") >= n)


def any_signal(name: str, comparison: str, threshold: float) -> Column:
    """Whether any observation has the signal and it compares so."""

    def test(o):
        v = F.try_element_at(o["signals"], F.lit(name))
        return v.isNotNull() & fn.compare(v, comparison, threshold)

    return F.exists("observations", test)


def branch(df: DataFrame, condition: Column, if_true: str, if_false: str) -> DataFrame:
    return df.withColumn("path_id", F.when(condition, if_true).otherwise(if_false))


def fan_out(df: DataFrame, paths: list[str]) -> DataFrame:
    """One row for each path."""
    return df.withColumn("path_id", F.explode(F.array(*[F.lit(p) for p in paths])))


def multi_branch(df: DataFrame, branches: list[tuple[Column, str]], default: str | None = None) -> DataFrame:
    """The first condition that holds names the path; else the default, without which the row is dropped."""
    chosen = reduce(lambda c, b: c.when(b[0], b[1]), branches[1:], F.when(branches[0][0], branches[0][1])).otherwise(F.lit(default).cast("string"))
    return df.withColumn("path_id", chosen).where(F.col("path_id").isNotNull())


def conditional_fan_out(df: DataFrame, paths: list[tuple[str, Column]]) -> DataFrame:
    """A row for each path whose condition holds."""
    return df.withColumn("path_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(p)) for p, c in paths]))))


def union(*dfs: DataFrame) -> DataFrame:
    """Rows of all, repeated ones kept; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def triggers(df: DataFrame, dedupe: bool = False) -> DataFrame:
    """One row for each result that fires and carries a point in time. A trigger that comes by several paths counts each time unless ``dedupe``."""
    r = df.select("stream_id", "frame_id", F.explode("results").alias("r")).where(fn.fires(F.col("r")) & F.col("r.trigger.event_ns").isNotNull())
    out = r.select(
        "stream_id", "frame_id", "r.trigger.event_ns", "r.trigger.clip_start_ns", "r.trigger.clip_end_ns", "r.trigger.label", F.coalesce("r.trigger.score", F.lit(0.0)).alias("score"), F.coalesce("r.trigger.reason", F.lit("")).alias("reason"), "r.source"
    )
    return out.distinct() if dedupe else out


def fired(df: DataFrame) -> DataFrame:
    """Rows any of whose results fires, with or without a point in time."""
    return df.where(F.exists("results", fn.fires))
