"""Fusion: decisions over the latest observation of each source, with a cool-down."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..schema import NS
from .joins import latest_per_source
from .ordered import ORDER, cooldown


def fuse(df: DataFrame, name: str, sources: list[str], decide: Callable[..., Column], wait_sec: float = 2.0, pre_sec: float = 2.0, post_sec: float = 2.0, order=ORDER, bucket_ns: int | None = None) -> DataFrame:
    """``df`` with an observation of ``name`` for each row, also among ``results`` where it fires.

    ``decide(latest)`` gets {source: its latest observation} and returns ``decision(...)``, or any struct (reason, score) or null for no trigger. In order:
    rows in a cool-down are ``cooldown``; rows before all sources were seen ``missing_sources``; those whose decision failed ``error`` (see
    ``decision``); null ``no_trigger``; else the row fires. The latest observations move on in a cool-down too. Every row's state is in the
    observation's metadata; rows that do not fire have score 0 and no reason. ``bucket_ns``: long streams are spread over many tasks.
    """
    rows = latest_per_source(df, sources, order, bucket_ns)
    seen = F.lit(True)
    for s in sources:
        seen = seen & F.col(f"latest_{s}").isNotNull()
    verdict = decide({s: F.col(f"latest_{s}") for s in sources})
    with lenient(df.sparkSession):
        rows = rows.withColumns({"_seen": seen, "_verdict": F.when(seen, verdict)})
    failed = F.coalesce(F.col("_verdict.failed"), F.lit(False)) if "failed" in rows.schema["_verdict"].dataType.names else F.lit(False)
    rows = rows.withColumns({"_failed": failed, "_candidate": F.col("_verdict").isNotNull() & ~failed})
    rows = cooldown(rows, "_candidate", int(wait_sec * NS), "_cool", order=order, bucket_ns=bucket_ns, clustered=bool(sources))
    fires = F.col("_cool.fires")
    state = F.when(F.col("_cool.cooling"), "cooldown").when(~F.col("_seen"), "missing_sources").when(F.col("_failed"), "error").when(F.col("_verdict").isNull(), "no_trigger").otherwise("triggered")
    reason, score = F.when(fires, F.col("_verdict.reason")).otherwise(F.lit("")), F.when(fires, F.col("_verdict.score")).otherwise(F.lit(0.0))
    point = fn.trigger(reason, score, fires, pre_sec=pre_sec, post_sec=post_sec)
    quiet = F.struct(F.lit(False).alias("fire"), F.lit(0.0).alias("score"), F.lit("").alias("reason"), F.lit(None).cast("string").alias("label"), *[F.lit(None).cast("bigint").alias(c) for c in ("event_ns", "clip_start_ns", "clip_end_ns")])
    obs = fn.observation(name, metadata=F.create_map(F.lit("state"), state), trigger=F.when(fires, point).otherwise(quiet))
    out = rows.withColumn("_obs", obs).withColumns({"observations": F.concat("observations", F.array("_obs")), "results": F.when(fires, F.concat("results", F.array("_obs"))).otherwise(F.col("results"))})
    return out.select(*df.columns)


def decision(when: Column, reason, score=1.0) -> Column:
    """(reason, score) where the condition holds, else null. A condition that is null, because something in it fails or is missing, is an error."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    made = lambda r, s, failed: F.struct(r.cast("string").alias("reason"), s.cast("double").alias("score"), F.lit(failed).alias("failed"))
    return F.when(when.isNull(), made(F.lit(None), F.lit(None), True)).when(when, made(col(reason), col(score), False))


@contextmanager
def lenient(spark: SparkSession):
    """Expressions that are resolved within give null where they would fail (division by zero, casts, elements out of bounds); they keep to that."""
    was = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", was)


#: Order of rows that ``explode_observations`` makes.
BY_OBSERVATION = (*ORDER, "observation_no")


def explode_observations(df: DataFrame) -> DataFrame:
    """A row for each observation, for fusions that are fed one at a time; ``observation_no`` is its place in its row."""
    rows = df.select(*[c for c in df.columns if c != "observations"], F.posexplode("observations").alias("observation_no", "_o"))
    return rows.withColumn("observations", F.array("_o")).select(*df.columns, "observation_no")
