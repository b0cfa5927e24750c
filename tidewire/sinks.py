"""Sinks of triggers and observations: tables, JSON lines, messages, callbacks; each for batch and stream."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import functions as fn


def call_back(rows: DataFrame, callbacks: Iterable[Callable]) -> int:
    """Each callback gets each row, partition by partition; returns how many rows there were."""
    n = 0
    callbacks = list(callbacks)
    for r in rows.toLocalIterator():
        n += 1
        for c in callbacks:
            c(r)
    return n


def trigger_messages(triggers: DataFrame, faces: str | None = None) -> DataFrame:
    """Triggers as messages: label (HIGHLIGHT if none), clip, number of faces, score and reason."""
    count = F.coalesce(F.size(faces), F.lit(0)) if faces else F.lit(0)
    m = F.struct(fn.label_or(F.col("label")).alias("label"), F.col("clip_start_ns").alias("t_start_ns"), F.col("clip_end_ns").alias("t_end_ns"), count.alias("faces"), "score", "reason")
    return triggers.select(F.to_json(m).alias("value"))


def observation_messages(flow: DataFrame) -> DataFrame:
    """Every observation as a JSON message."""
    return flow.select(F.explode("observations").alias("o")).select(fn.to_message(F.col("o")).alias("value"))


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_messages(messages: DataFrame, path: str, append: bool = False) -> None:
    messages.write.mode("append" if append else "overwrite").text(path)


def discard(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def to_kafka(messages: DataFrame, servers: str, topic: str):
    """A writer of messages for Kafka (its connector must be on the class path); call ``save()`` or, on a stream, ``start()``."""
    w = messages.writeStream if messages.isStreaming else messages.write
    return w.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)


def each_batch(*sinks: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the batch is kept while every sink writes it."""

    def run(df: DataFrame, _: int) -> None:
        df.persist()
        try:
            for s in sinks:
                s(df)
        finally:
            df.unpersist()

    return run
