"""Joins in time: paths of a row, interval joins, alignment by frame, latest values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import latest_of, scan


def by_place(items, place: str):
    """An array of structs in order of a number in each; the structs may hold maps, which cannot be compared."""
    order = lambda a, b: F.when(a[place] < b[place], -1).when(a[place] > b[place], 1).otherwise(0)
    return F.array_sort(items, order)


def merge_same_frame(
    df: DataFrame, paths: list[str], out_path: str = "merged", order: dict[str, int] | None = None, observations: bool = True, results: bool = True, complete: bool = True, keys: tuple = ("stream_id", "frame_id")
) -> DataFrame:
    """Join of paths by ``keys``: valid where each path has one row of a key at most and all see the same ones, or frames lie further apart than the window.
    Arrival, (stream_id, frame_id, t_ns, seq), tells repeated frames apart.

    One shuffle and no Python: partial lists are made before it. Observations, results and metadata are merged in path order; other columns are the
    first path's. ``complete``: only frames that all paths have.
    """
    rank = {p: i for i, p in enumerate(paths)} if order is None else order
    ord_ = F.element_at(F.create_map(*[x for p, i in rank.items() for x in (F.lit(p), F.lit(i))]), F.col("path_id"))
    others = [c for c in df.columns if c not in (*keys, "path_id", "observations", "results", "metadata")]
    rows = df.where(F.col("path_id").isin(paths)).withColumn("_ord", ord_)
    item = F.struct("_ord", "observations", "results", F.map_entries("metadata").alias("metadata"), *others)
    met = rows.groupBy(*keys).agg(by_place(F.collect_list(item), "_ord").alias("_rows"), F.collect_set("path_id").alias("_paths"))
    if complete:
        met = met.where(F.size("_paths") == len(set(paths)))
    empty = F.slice(F.col("_rows")[0]["observations"], 1, 0)
    pairs = F.flatten(F.col("_rows.metadata"))
    last = F.map_from_entries(F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda f: f["key"] == e["key"])))
    merged = met.select(
        *keys, F.lit(out_path).alias("path_id"),
        (F.flatten(F.col("_rows.observations")) if observations else empty).alias("observations"), (F.flatten(F.col("_rows.results")) if results else empty).alias("results"), last.alias("metadata"),
        *[F.col("_rows")[0][c].alias(c) for c in others],
    )
    return merged.select(*df.columns)


class PathBuffer:
    """The latest row of each path, met until all are there; see ``join_paths``. Shared by batch and stream."""

    def __init__(self, paths, mode, window_ns, lateness_ns, observations, results, out_path):
        self.paths, self.mode, self.window, self.late = tuple(paths), mode, window_ns, lateness_ns
        self.obs, self.res, self.out = observations, results, out_path
        self.held: dict[str, dict] = {}

    def push(self, row: dict) -> list[dict]:
        p = row["path_id"]
        if p not in self.paths:
            return [row]
        self.held[p] = row
        if self.late > 0 and len(self.held) > 1:
            newest = max(r["timestamp_ns"] for r in self.held.values())
            self.held = {k: r for k, r in self.held.items() if newest - r["timestamp_ns"] <= self.late}
        if self.window > 0 and len(self.held) > 1:
            at = [r["timestamp_ns"] for r in self.held.values()]
            if max(at) - min(at) > self.window:
                return []
        if not self.held or (self.mode == "all" and any(q not in self.held for q in self.paths)):
            return []
        return self.flush()

    def flush(self) -> list[dict]:
        if not self.held:
            return []
        rows, self.held = list(self.held.values()), {}
        out = dict(rows[0], path_id=self.out)
        out["observations"] = [o for r in rows for o in r["observations"] or []] if self.obs else []
        out["results"] = [o for r in rows for o in r["results"] or []] if self.res else []
        out["metadata"] = list({k: v for r in rows for k, v in (r["metadata"].items() if isinstance(r["metadata"], dict) else r["metadata"] or [])}.items())
        return [out]


def join_paths(df: DataFrame, paths: list[str], mode: str = "all", window_ns: int = 100_000_000, lateness_ns: int = 0, out_path: str = "merged", observations: bool = True, results: bool = True, flush: bool = False, order=("t_ns", "seq")) -> DataFrame:
    """Keyless join of each stream's paths, in arrival order: a path's newer row replaces its older one, rows further apart than the window wait,
    a match takes all that is held. ``any`` passes every row, renamed. Rows of other paths pass. ``flush``: what is held at the end comes out too.
    """
    if mode == "any" and lateness_ns <= 0:
        mine = F.col("path_id").isin(list(paths))
        out = df.withColumn("path_id", F.when(mine, out_path).otherwise(F.col("path_id")))
        if not observations:
            out = out.withColumn("observations", F.when(mine, F.slice("observations", 1, 0)).otherwise(F.col("observations")))
        if not results:
            out = out.withColumn("results", F.when(mine, F.slice("results", 1, 0)).otherwise(F.col("results")))
        return out
    make = lambda: PathBuffer(paths, mode, window_ns, lateness_ns, observations, results, out_path)
    return scan(df, make, lambda s, r: s.push(r), df.schema, df.columns, order=order, flush=(lambda s: s.flush()) if flush else None)


def interval_join(left: DataFrame, right: DataFrame, window_ns: int, keys=("stream_id",), time: str = "t_ns", suffix: str = "_right") -> DataFrame:
    """All pairs of equal keys at most ``window_ns`` apart. Time is cut in bins as wide as the window and the right side put in three, so that Spark hashes on (keys, bin)
    and a long stream is spread over its bins instead of being compared row by row. Null keys and times match nothing."""
    w = max(1, window_ns)
    names = [c for c in right.columns if c not in keys]
    r = right.select(*keys, *[F.col(c).alias(f"{c}{suffix}") for c in names])
    bin_r = F.floor(F.col(f"{time}{suffix}") / F.lit(w)).cast("bigint")
    r = r.withColumn("_bin", F.explode(F.sequence(bin_r - 1, bin_r + 1)))
    lft = left.withColumn("_bin", F.floor(F.col(time) / F.lit(w)).cast("bigint"))
    met = lft.join(r, [*keys, "_bin"])
    return met.where(F.abs(F.col(f"{time}{suffix}") - F.col(time)) <= window_ns).drop("_bin")


def interval_join_all(tables: list[DataFrame], window_ns: int, keys=("stream_id",)) -> DataFrame:
    """Interval joins from left to right; the left row's time and frame stay, both sides' lists are kept."""
    out = tables[0]
    for k, t in enumerate(tables[1:]):
        out = interval_join(out, t, window_ns, keys, suffix=f"_{k + 2}")
    return out


def align(messages: DataFrame, window_ns: int, release: str = "strict") -> DataFrame:
    """Messages (stream_id, frame_id, source, t_ns, seq, ...) gathered by frame: each source's last one.

    ``strict``: frames more than ``window_ns`` before the stream's newest time; ``flush``: all. Returns stream_id, frame_id, first and last time, the delay,
    the sources and a map of messages. The newest time is a small aggregate, joined back; frames are never in one task's list.
    """
    others = [c for c in messages.columns if c not in ("stream_id", "frame_id", "source")]
    last = messages.groupBy("stream_id", "frame_id", "source").agg(F.max_by(F.struct(*others), F.struct("seq")).alias("m"))
    frames = last.groupBy("stream_id", "frame_id").agg(F.min("m.t_ns").alias("first_ns"), F.max("m.t_ns").alias("last_ns"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "m")))).alias("messages"))
    newest = messages.groupBy("stream_id").agg(F.max("t_ns").alias("newest_ns"))
    out = frames.join(newest, "stream_id")
    if release == "strict":
        out = out.where(F.col("newest_ns") - F.col("first_ns") > window_ns)
    elif release != "flush":
        raise ValueError("release is 'strict' or 'flush'")
    return out.withColumns({"delay_ns": F.col("newest_ns") - F.col("first_ns"), "sources": F.map_keys("messages"), "spread_ns": F.col("last_ns") - F.col("first_ns")})


def sync_delays(aligned: DataFrame, window_ns: int) -> DataFrame:
    """Frames released later than 1.5 windows: the delay beyond the window, in milliseconds."""
    return aligned.where(F.col("delay_ns") > 1.5 * window_ns).withColumn("delay_ms", (F.col("delay_ns") - window_ns) / F.lit(1e6))


def collect_batches(df: DataFrame, size: int, flush: bool = False, bucket_ns: int | None = None) -> DataFrame:
    """Every ``size`` rows of a stream as one: lists concatenated in order, the first row's other columns, metadata with ``_batch_size``. 0 counts as 1.

    ``flush``: a stream's last, smaller batch comes out too.
    """
    from .ordered import ordinal

    n = max(1, size)
    rows = ordinal(df, "_n", bucket_ns=bucket_ns).withColumn("_b", F.floor((F.col("_n") - 1) / n))
    others = [c for c in df.columns if c not in ("stream_id", "observations", "results", "metadata")]
    item = F.struct("_n", "observations", "results", F.map_entries("metadata").alias("metadata"), *others)
    met = rows.groupBy("stream_id", "_b").agg(by_place(F.collect_list(item), "_n").alias("_rows"))
    if not flush:
        met = met.where(F.size("_rows") == n)
    return one_of(met, df.columns)


def one_of(met: DataFrame, columns: list[str]) -> DataFrame:
    """(stream_id, _rows), rows in order with metadata as entries, as one row each: see ``collect_batches``. Shared by batch and stream."""
    others = [c for c in columns if c not in ("stream_id", "observations", "results", "metadata")]
    first = F.col("_rows")[0]
    kept = F.map_filter(F.map_from_entries(first["metadata"]), lambda k, _: k != "_batch_size")
    out = met.select(
        "stream_id", F.flatten(F.col("_rows.observations")).alias("observations"), F.flatten(F.col("_rows.results")).alias("results"),
        F.map_concat(kept, F.create_map(F.lit("_batch_size"), F.size("_rows").cast("string"))).alias("metadata"), *[first[c].alias(c) for c in others],
    )
    return out.select(*columns)


def latest_per_source(df: DataFrame, sources: list[str], order=("t_ns", "seq"), bucket_ns: int | None = None) -> DataFrame:
    """Columns ``latest_<source>``: the stream's last observation of each source up to the row. ``bucket_ns``: in two levels, see ``ordered.latest_of``."""
    of = lambda s: F.try_element_at(F.filter("observations", lambda o: o["source"] == s), F.lit(-1))
    return latest_of(df, {f"latest_{s}": of(s) for s in sources}, order=order, bucket_ns=bucket_ns) if sources else df


def spread(df: DataFrame, sources: list[str], out: str = "spread_ns") -> DataFrame:
    """How far apart the latest observations of the sources are, for rows (of ``latest_per_source``) that have seen all."""
    t = F.array(*[F.col(f"latest_{s}")["t_ns"] for s in sources])
    return df.where(~F.exists(t, lambda x: x.isNull())).withColumn(out, F.array_max(t) - F.array_min(t))


