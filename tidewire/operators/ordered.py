"""Ordered operators: numbering, scans that carry state, and what is built on them.

Two primitives. ``ordinal`` numbers the rows of each stream; with a bucket width it does so in two levels, so that a stream which holds a third of
all rows is spread over many tasks. ``scan`` sorts each stream within a partition and passes over it once in Arrow batches with constant state, so
that no stream is ever collected; it is for recurrences that no window function expresses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("stream_id",)
ORDER = ("t_ns", "seq")


def over(keys=KEYS, order=ORDER):
    return Window.partitionBy(*keys).orderBy(*order)


def ordinal(df: DataFrame, out: str = "ordinal", keys=KEYS, order=ORDER, bucket_ns: int | None = None) -> DataFrame:
    """1-based number of each row in its stream. ``bucket_ns``: number within buckets of ``order[0]``, then add the rows of earlier buckets."""
    if bucket_ns is None:
        return df.withColumn(out, F.row_number().over(over(keys, order)).cast("bigint"))
    b = df.withColumn("_bucket", F.floor(F.col(order[0]) / F.lit(bucket_ns)))
    sizes = b.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"), before.alias("_before"))
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    numbered = b.withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    return numbered.join(offsets, same).withColumn(out, (F.col("_row") + F.col("_before")).cast("bigint")).select(*df.columns, out)


def scan(df: DataFrame, start: Callable[[], object], step: Callable[[object, dict], list[dict]], schema, reads: list[str], keys=KEYS, order=ORDER, flush: Callable[[object], list[dict]] | None = None) -> DataFrame:
    """New rows of ``schema`` from one ordered pass over each stream.

    ``start()`` makes a stream's state, ``step(state, row)`` sees its rows in order (``reads`` columns only) and returns rows, ``flush(state)`` may return
    more at the stream's end. State lives in one task and is as large as ``step`` makes it.
    """
    need = list(dict.fromkeys([*keys, *order, *reads]))

    def run(batches: Iterator[pa.RecordBatch]):
        key, state = None, None
        target = None
        for b in batches:
            out: list[dict] = []
            for row in b.to_pylist():
                k = tuple(row[x] for x in keys)
                if state is None or k != key:
                    if state is not None and flush:
                        out += flush(state)
                    key, state = k, start()
                out += step(state, row)
            target = target or arrow_schema(schema)
            yield pa.RecordBatch.from_pylist(out, target)
        if state is not None and flush:
            yield pa.RecordBatch.from_pylist(flush(state), arrow_schema(schema))

    return df.select(*need).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema))


def flag(df: DataFrame, start: Callable[[], object], test: Callable[..., object], inputs: list[str], out: str, kind: str = "boolean", keys=KEYS, order=ORDER, clustered: bool = False) -> DataFrame:
    """``df`` with a column from one ordered pass: ``test(state, *inputs)`` for each row. All other columns pass through Arrow untouched.

    ``clustered``: the rows come straight from a window over the same keys and order, so that they need no second shuffle or sort.
    """
    from pyspark.sql.types import StructType

    names = df.columns
    schema = StructType([*df.schema.fields, *StructType.fromDDL(f"`{out}` {kind}").fields])
    at, k_at = [names.index(c) for c in inputs], [names.index(c) for c in keys]

    def run(batches: Iterator[pa.RecordBatch]):
        key, state = None, None
        target = arrow_schema(schema)
        for b in batches:
            ks = list(zip(*[b.column(i).to_pylist() for i in k_at]))
            cols = [b.column(i).to_pylist() for i in at]
            got = []
            for i, k in enumerate(ks):
                if state is None or k != key:
                    key, state = k, start()
                got.append(test(state, *[c[i] for c in cols]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, target.field(out).type)], [*names, out])

    rows = df if clustered else df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return rows.mapInArrow(run, schema)


def greedy(state: dict, t: int | None, interval: int) -> bool:
    """First passes; then those at least ``interval`` after the last that passed. A null time never passes. Shared by batch and stream."""
    if t is None:
        return False
    last = state.get("last")
    if last is None or t - last >= interval:
        state["last"] = t
        return True
    return False


def cooling(state: dict, t: int | None, wait: int, candidate: bool) -> tuple[bool, bool]:
    """(fires, is cooling): after a fire at t, rows before t + wait are cooling; the first possible fire is at 0. A null time neither fires nor cools. Shared by batch and stream."""
    if t is None:
        return False, False
    if t < state.get("until", 0):
        return False, True
    if candidate:
        state["until"] = t + wait
        return True, False
    return False, False


def every_nth(df: DataFrame, n: int, mode: str = "count", bucket_ns: int | None = None) -> DataFrame:
    """``count``: the n-th, 2n-th ... row of each stream. ``modulo``: rows whose frame_id is a multiple of n, without any state."""
    if mode == "modulo":
        return df.where(F.col("frame_id") % n == 0)
    return ordinal(df, "_ordinal", bucket_ns=bucket_ns).where(F.col("_ordinal") % n == 0).drop("_ordinal")


def episodes(df: DataFrame, gap_ns: int, out: str, bucket_ns: int, keys=KEYS, order=ORDER) -> DataFrame:
    """``df`` with the time at which the row's episode began: a new one begins ``gap_ns`` or more after the row before. Found in two levels, so no task holds a stream.

    Greedy sampling and cool-downs of up to ``gap_ns`` start anew with each episode, whatever came before.
    """
    t = F.col(order[0])
    b = df.withColumn("_bucket", F.floor(t / F.lit(bucket_ns)))
    in_bucket = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    b = b.withColumn("_start", F.when(t - F.lag(order[0]).over(in_bucket) >= gap_ns, t))
    ends = b.groupBy(*keys, "_bucket").agg(F.min(order[0]).alias("_first"), F.max(order[0]).alias("_end"), F.max("_start").alias("_last_start"))
    stream = Window.partitionBy(*keys).orderBy("_bucket")
    #: A bucket's first row begins an episode if it comes late after the bucket before, or is the stream's first.
    ends = ends.withColumn("_new", F.when((F.col("_first") - F.lag("_end").over(stream) >= gap_ns) | F.lag("_end").over(stream).isNull(), F.col("_first")))
    carried = F.last(F.coalesce("_last_start", "_new"), ignorenulls=True).over(stream.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"), F.coalesce("_new", carried).alias("_entry"))
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    mine = F.last("_start", ignorenulls=True).over(in_bucket.rowsBetween(Window.unboundedPreceding, 0))
    return b.withColumn("_mine", mine).join(ends, same).withColumn(out, F.coalesce("_mine", "_entry")).select(*df.columns, out)


def min_interval(df: DataFrame, interval_ns: int, time: str = "timestamp_ns", bucket_ns: int | None = None) -> DataFrame:
    """Greedy sampling in event time (or by an arrival-time column, which makes it a rate limit). Rows without a time don't pass.

    ``bucket_ns``: streams are cut where nothing comes for the interval, and the parts are worked on apart.
    """
    if bucket_ns is None:
        return flag(df, dict, lambda s, t: greedy(s, t, interval_ns), [time], "_pass").where("_pass").drop("_pass")
    order = (time, *[c for c in ORDER if c != time])
    parts = episodes(df.where(F.col(time).isNotNull()), interval_ns, "_episode", bucket_ns, order=order)
    return flag(parts, dict, lambda s, t: greedy(s, t, interval_ns), [time], "_pass", keys=(*KEYS, "_episode"), order=order).where("_pass").drop("_pass", "_episode")


def cooldown(df: DataFrame, candidate: str, wait_ns: int, out: str = "fires", time: str = "t_ns", keys=KEYS, order=ORDER, bucket_ns: int | None = None, clustered: bool = False) -> DataFrame:
    """``df`` with ``out``, struct(fires, cooling), for rows whose boolean column ``candidate`` says that they could fire. Rows without a time neither fire nor cool.

    One ordered pass of each stream. With ``bucket_ns`` only the times and places of candidates cross to Python, of streams that are cut where no candidate
    comes for that long; what fired then meets the rows, which look back to the last fire in two levels. So a long stream is spread over many tasks.
    Candidates of the same place (keys and order) then fire together.
    """
    if bucket_ns is None:
        return flag(df, dict, lambda s, t, c: dict(zip(("fires", "cooling"), cooling(s, t, wait_ns, bool(c)))), [time, candidate], out, "struct<fires: boolean, cooling: boolean>", keys, order, clustered)
    places = list(dict.fromkeys([*keys, *order, time]))
    hot = df.where(F.coalesce(F.col(candidate), F.lit(False)) & F.col(time).isNotNull()).select(*places).distinct()
    hot = episodes(hot, wait_ns, "_episode", bucket_ns, keys, order)
    fired = flag(hot, dict, lambda s, t: cooling(s, t, wait_ns, True)[0], [time], "_fire", keys=(*keys, "_episode"), order=order).where("_fire").select(*places)
    rows = df.withColumn("_row", F.lit(True)).unionByName(fired.withColumn("_row", F.lit(False)), allowMissingColumns=True)
    rows = latest(rows, F.when(~F.col("_row"), F.struct(*dict.fromkeys([*order, time]))), "_last", keys, (*order, "_row"), bucket_ns).where("_row")
    here = F.coalesce(F.col(candidate), F.lit(False)) & F.col("_last").isNotNull()
    for c in order:
        here = here & F.col(c).eqNullSafe(F.col("_last")[c])
    cools = F.coalesce(~here & (F.col(time) < F.col("_last")[time] + wait_ns), F.lit(False)) | F.coalesce(F.col(time) < 0, F.lit(False))
    return rows.withColumn(out, F.struct(here.alias("fires"), cools.alias("cooling"))).select(*df.columns, out)


def latest(df: DataFrame, value: Column, out: str, keys=KEYS, order=ORDER, bucket_ns: int | None = None) -> DataFrame:
    """The last value that is not null, up to and with each row: an as-of lookup without a limit on age."""
    return latest_of(df, {out: value}, keys, order, bucket_ns)


def latest_of(df: DataFrame, values: dict[str, Column], keys=KEYS, order=ORDER, bucket_ns: int | None = None) -> DataFrame:
    """``latest`` of several values in one pass.

    ``bucket_ns``: looked up within buckets of ``order[0]`` first, then in the buckets before, so that a long stream is spread over many tasks.
    """
    if bucket_ns is None:
        w = over(keys, order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({out: F.last(value, ignorenulls=True).over(w) for out, value in values.items()})
    outs = list(values)
    b = df.withColumns({"_bucket": F.floor(F.col(order[0]) / F.lit(bucket_ns))} | {f"_value{i}": values[o] for i, o in enumerate(outs)})
    steps = b.groupBy(*keys, "_bucket").agg(*[F.max_by(f"_value{i}", F.when(F.col(f"_value{i}").isNotNull(), F.struct(*order))).alias(f"_end{i}") for i in range(len(outs))])
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"), *[F.last(f"_end{i}", ignorenulls=True).over(earlier).alias(f"_before{i}") for i in range(len(outs))])
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    so_far = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = b.withColumns({f"_near{i}": F.last(f"_value{i}", ignorenulls=True).over(so_far) for i in range(len(outs))})
    return near.join(carried, same, "left").select(*df.columns, *[F.coalesce(f"_near{i}", f"_before{i}").alias(o) for i, o in enumerate(outs)])


def gaps(df: DataFrame, keys=KEYS, order=ORDER) -> DataFrame:
    """Rows after a gap in frame ids, with ``dropped_frame_ids``."""
    w = df.withColumn("_last", F.lag("frame_id").over(over(keys, order)))
    return w.where(F.col("frame_id") > F.col("_last") + 1).withColumn("dropped_frame_ids", F.sequence(F.col("_last") + 1, F.col("frame_id") - 1)).drop("_last")


def ema_by(df: DataFrame, keys, order, value: str, alpha: float = 0.3, out: str = "ema") -> DataFrame:
    """Each row's moving average so far, by one ordered pass. Null values change nothing; before the first value it is null."""

    def step(s, x):
        if x is None:
            return s.get("e")
        s["e"] = float(x) if s.get("e") is None else alpha * float(x) + (1 - alpha) * s["e"]
        return s["e"]

    return flag(df, dict, step, [value], out, "double", keys, order)
