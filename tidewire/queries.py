"""Queries of the engine's operators on the supplied tables, each with the same rows in DuckDB SQL where SQL can express them.

``events`` is the stream of frames: stream = user, frame = event, time in nanoseconds, one observation a frame with the event's type as source and
``value`` and ``k`` as signals. Times are spread over weeks, so windows are hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import functions as fn
from . import observability as obs
from . import streaming as st
from .modules import ColumnModule, FusionModule, Path, PythonModule, detection_udf, extract_paths, extractor, python_condition, python_processor, run_modules, worker_results
from .operators import aggregates as agg
from .operators import fusion as fus
from .operators import joins, ordered, rows
from .plans import specs as S
from .plans.builder import FlowGraphBuilder
from .plans.compiler import compile_graph
from .plans.graph import FlowGraph
from .sinks import observation_messages, trigger_messages, write_messages
from .sources import frames as src

HOUR = 3_600_000_000_000
QUERIES: dict = {}
ORACLE: dict = {}
EV = "ev AS (SELECT event_id AS frame_id, CAST(user_id AS VARCHAR) AS stream_id, epoch_us(ts) * 1000 AS t_ns, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"
ORD = EV + ", o AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t_ns, frame_id) AS rn FROM ev)"


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return put


def events(spark, d: str) -> DataFrame:
    return src.from_events(spark.read.parquet(f"{d}/events.parquet")).withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).drop("props")


def live(spark, d: str) -> DataFrame:
    """``events`` as a stream of one file, read in order of time."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return src.from_events(spark.readStream.schema(e.schema).parquet(f"{d}/events.parquet*")).withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).drop("props")


def scratch(spark) -> str:
    """A new folder among those that all executors share."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewire-")
    return f"{base.rstrip('/')}/streams/{uuid.uuid4().hex[:12]}"


def reading(**more) -> ColumnModule:
    """Each frame's own observation."""
    return ColumnModule("reading", lambda: fn.observation(F.col("event_type"), signals=fn.signals(value=F.col("value"), k=F.col("k")), **more))


def flow(spark, d: str) -> DataFrame:
    return reading().apply(rows.to_flow(events(spark, d)))


def ids(df: DataFrame, *more) -> DataFrame:
    return df.select("stream_id", "frame_id", "t_ns", *more)


@query(f"WITH {EV}, p AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t_ns, frame_id) AS rn FROM ev), s AS (SELECT * FROM p WHERE rn % 2 = 0 AND value > 20.0) SELECT stream_id, frame_id, t_ns AS event_ns, t_ns - 2000000000 AS clip_start_ns, t_ns + 2000000000 AS clip_end_ns, 'high' AS label, value AS score, 'high' AS reason, 'alarm' AS source FROM s WHERE value > 60.0")
def flagship(spark, d):
    """Source, every second frame, a signal filter, an analyzer and a trigger, as one graph."""
    alarm = ColumnModule("alarm", lambda: F.when(F.col("value") > 60.0, fn.observation("alarm", trigger=fn.trigger("high", F.col("value")))))
    g = FlowGraphBuilder().source().sample(2).path("read", [reading()]).filter_signal("value", 20.0).path("main", [alarm]).build()
    return compile_graph(g, events(spark, d)).triggers()


@query(f"WITH {EV} SELECT stream_id, frame_id, t_ns, 'cam' AS path_id, t_ns AS timestamp_ns, 0 AS n_observations FROM ev")
def source_flow(spark, d):
    return ids(rows.to_flow(events(spark, d), "cam"), "path_id", "timestamp_ns", F.size("observations").alias("n_observations"))


@query("SELECT i AS frame_id, i * 100000000 AS t_ns FROM generate_series(0, 9) AS g(i)")
def mock_source(spark, d):
    return src.mock_frames(spark, 10).select("frame_id", "t_ns")


@query(f"WITH {ORD}, s AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t_ns, frame_id) - 1 AS fid FROM o WHERE rn % 3 = 0) SELECT stream_id, fid AS frame_id, t_ns FROM s")
def source_decimation(spark, d):
    return ids(src.decimate(events(spark, d), 30, 10))


@query(f"WITH {EV} SELECT stream_id, frame_id, t_ns, value FROM ev WHERE value > 50.0 AND event_type = 'click'")
def filter_cond(spark, d):
    g = FlowGraphBuilder().source().filter(lambda: (F.col("value") > 50.0) & (F.col("event_type") == "click")).build()
    return ids(compile_graph(g, events(spark, d)).results, "value")


@query(f"WITH {EV} SELECT stream_id, frame_id, t_ns, CAST(2 AS INTEGER) AS n FROM ev WHERE k % 2 = 0")
def obs_count_filter(spark, d):
    extra = ColumnModule("even", lambda: F.when(F.col("k") % 2 == 0, fn.observation("even")))
    return ids(rows.min_observations(extra.apply(flow(spark, d)), 2), F.size("observations").alias("n"))


def _signal_filter(c, op):
    @query(f"WITH {EV} SELECT stream_id, frame_id, t_ns, value FROM ev WHERE k {op} 50", f"signal_filter_{c}")
    def run(spark, d):
        g = FlowGraph().add_node("f", S.SignalFilter("k", 50.0, c))
        return ids(compile_graph(g, flow(spark, d)).results, "value")


for _c, _op in zip(fn.COMPARISONS, (">", ">=", "<", "<=", "=", "<>")):
    _signal_filter(_c, _op)


@query(f"WITH {EV}, n AS (SELECT *, CASE WHEN k % 3 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS x FROM ev) SELECT frame_id, NOT isnan(x) AND x > 50 AS gt, NOT isnan(x) AND x >= 50 AS ge, NOT isnan(x) AND x < 50 AS lt, NOT isnan(x) AND x <= 50 AS le, NOT isnan(x) AND x = 50 AS eq, isnan(x) OR x <> 50 AS ne FROM n")
def compare_nan(spark, d):
    e = events(spark, d).withColumn("x", F.when(F.col("k") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return e.select("frame_id", *[fn.compare(F.col("x"), c, 50.0).alias(c) for c in fn.COMPARISONS])


@query(f"WITH {ORD} SELECT stream_id, frame_id, t_ns FROM o WHERE rn % 3 = 0")
def sample_count(spark, d):
    return ids(compile_graph(FlowGraphBuilder().source().sample(3).build(), events(spark, d)).results)


@query(f"WITH {EV} SELECT stream_id, frame_id, t_ns FROM ev WHERE frame_id % 3 = 0")
def sample_modulo(spark, d):
    return ids(compile_graph(FlowGraphBuilder().source().sample(3, mode="modulo").build(), events(spark, d)).results)


@query(f"WITH {EV}, o AS (SELECT *, row_number() OVER (ORDER BY t_ns, frame_id) AS rn FROM ev) SELECT frame_id, t_ns, rn AS ordinal FROM o WHERE rn % 5 = 0")
def sample_one_stream(spark, d):
    """One stream of all events, numbered in two levels, so that no task sorts it whole."""
    e = rows.to_flow(events(spark, d).withColumn("stream_id", F.lit("all")))
    return ordered.ordinal(e, bucket_ns=24 * HOUR).where(F.col("ordinal") % 5 == 0).select("frame_id", "t_ns", "ordinal")


def _greedy_sql(interval):
    return f"WITH RECURSIVE {ORD}, f AS (SELECT stream_id, rn, frame_id, t_ns, t_ns AS last, true AS pass FROM o WHERE rn = 1 UNION ALL SELECT o.stream_id, o.rn, o.frame_id, o.t_ns, CASE WHEN o.t_ns - f.last >= {interval} THEN o.t_ns ELSE f.last END, o.t_ns - f.last >= {interval} FROM f JOIN o ON o.stream_id = f.stream_id AND o.rn = f.rn + 1) SELECT stream_id, frame_id, t_ns FROM f WHERE pass"


@query(_greedy_sql(12 * HOUR))
def ts_sample(spark, d):
    return ids(compile_graph(FlowGraphBuilder().source().sample_time(12 * HOUR).build(), events(spark, d)).results)


@query(_greedy_sql(6 * HOUR))
def rate_limit(spark, d):
    """By an arrival-time column, in milliseconds."""
    return ids(compile_graph(FlowGraphBuilder().source().rate_limit(6 * 3600 * 1000, time_column="t_ns").build(), events(spark, d)).results)


@query(f"WITH {EV} SELECT stream_id, frame_id, t_ns, CASE WHEN value > 50.0 THEN 'high' ELSE 'low' END AS path_id FROM ev")
def branch(spark, d):
    g = FlowGraphBuilder().source().branch(lambda: F.col("value") > 50.0, "high", "low").build()
    return ids(compile_graph(g, events(spark, d)).results, "path_id")


@query(f"WITH {EV} SELECT stream_id, frame_id, t_ns, p.path_id FROM ev, (VALUES ('a'), ('b'), ('c')) AS p(path_id)")
def fanout(spark, d):
    return ids(compile_graph(FlowGraphBuilder().source().fanout(["a", "b", "c"]).build(), events(spark, d)).results, "path_id")


@query(f"WITH {EV} SELECT stream_id, frame_id, t_ns, CASE WHEN event_type = 'click' THEN 'c' WHEN value > 50.0 THEN 'v' ELSE 'rest' END AS path_id FROM ev")
def multi_branch(spark, d):
    g = FlowGraphBuilder().source().multi_branch([(lambda: F.col("event_type") == "click", "c"), (lambda: F.col("value") > 50.0, "v")], "rest").build()
    return ids(compile_graph(g, events(spark, d)).results, "path_id")


@query(f"WITH {EV} SELECT stream_id, frame_id, t_ns, CASE WHEN event_type = 'click' THEN 'c' WHEN value > 50.0 THEN 'v' END AS path_id FROM ev WHERE event_type = 'click' OR value > 50.0")
def multi_branch_drop(spark, d):
    return ids(rows.multi_branch(rows.to_flow(events(spark, d)), [(F.col("event_type") == "click", "c"), (F.col("value") > 50.0, "v")]), "path_id")


@query(f"WITH {EV} SELECT stream_id, frame_id, t_ns, 'c' AS path_id FROM ev WHERE event_type = 'click' UNION ALL SELECT stream_id, frame_id, t_ns, 'v' FROM ev WHERE value > 50.0")
def cond_fanout(spark, d):
    g = FlowGraphBuilder().source().conditional_fanout([("c", lambda: F.col("event_type") == "click"), ("v", lambda: F.col("value") > 50.0)]).build()
    return ids(compile_graph(g, events(spark, d)).results, "path_id")


@query(f"WITH {EV} SELECT stream_id, frame_id, t_ns, 'high' AS path_id, value * 2.0 AS x FROM ev WHERE value > 50.0 UNION ALL SELECT stream_id, frame_id, t_ns, 'low', CAST(k AS DOUBLE) FROM ev WHERE NOT value > 50.0 AND k > 30")
def dag_routing(spark, d):
    """A branch whose paths take different nodes, and their union."""
    a = ColumnModule("double", lambda: fn.observation("double", signals=fn.signals(x=F.col("value") * 2.0)))
    b = ColumnModule("kay", lambda: fn.observation("kay", signals=fn.signals(x=F.col("k"))))
    g = FlowGraphBuilder().source().branch(lambda: F.col("value") > 50.0, "high", "low").path("high", [a]).path("low", [b]).filter(lambda: F.col("k") > 30, "over_30").build()
    out = compile_graph(g, events(spark, d)).results
    return ids(out, "path_id", F.get("observations", F.lit(0))["signals"]["x"].alias("x"))


@query(f"WITH {EV} SELECT stream_id, frame_id, t_ns, p.path_id FROM ev, (VALUES ('left'), ('right')) AS p(path_id)")
def diamond_union(spark, d):
    """A diamond without a join gives both paths' rows."""
    g = FlowGraph().add_node("s", S.Source()).add_node("a", S.Custom(lambda df: rows.with_path(df, "left"))).add_node("b", S.Custom(lambda df: rows.with_path(df, "right"))).add_node("end", S.ObservationFilter(0))
    g.add_edge("s", "a").add_edge("s", "b").add_edge("a", "end").add_edge("b", "end")
    return ids(compile_graph(g, events(spark, d)).results, "path_id")


@query(f"WITH {EV} SELECT stream_id, frame_id, t_ns, 'merged' AS path_id, CAST(2 AS INTEGER) AS n, value + 1.0 AS first_x, CAST(k AS DOUBLE) AS second_x FROM ev")
def join_all_frame(spark, d):
    """Fan-out, an analyzer on each path, and a join that the compiler turns into one shuffle by frame."""
    a = ColumnModule("a", lambda: fn.observation("a", signals=fn.signals(x=F.col("value") + 1.0)))
    b = ColumnModule("b", lambda: fn.observation("b", signals=fn.signals(x=F.col("k"))))
    g = FlowGraphBuilder().source().fanout(["pa", "pb"]).path("pa", [a]).path("pb", [b]).join(["pa", "pb"]).build()
    out = compile_graph(g, events(spark, d)).results
    return ids(out, "path_id", F.size("observations").alias("n"), F.get("observations", F.lit(0))["signals"]["x"].alias("first_x"), F.get("observations", F.lit(1))["signals"]["x"].alias("second_x"))


@query(f"WITH {EV} SELECT stream_id, frame_id, t_ns, CASE WHEN event_type IN ('click', 'view') THEN 'merged' ELSE event_type END AS path_id FROM ev")
def join_any(spark, d):
    e = rows.to_flow(events(spark, d)).withColumn("path_id", F.col("event_type"))
    return ids(joins.join_paths(e, ["click", "view"], "any"), "path_id")


@query(f"WITH {EV} SELECT stream_id, frame_id, t_ns, event_type AS path_id FROM ev WHERE event_type NOT IN ('click', 'view')")
def join_unknown_path(spark, d):
    e = rows.to_flow(events(spark, d)).withColumn("path_id", F.col("event_type"))
    return ids(joins.join_paths(e, ["click", "view"], window_ns=24 * HOUR).where("path_id <> 'merged'"), "path_id")


@query(f"""WITH RECURSIVE {EV}, o AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t_ns, frame_id) AS rn FROM ev WHERE event_type IN ('click', 'view')),
f AS (SELECT stream_id, rn, CASE WHEN event_type = 'click' THEN frame_id END AS c_id, CASE WHEN event_type = 'click' THEN t_ns END AS c_t, CASE WHEN event_type = 'view' THEN frame_id END AS v_id, CASE WHEN event_type = 'view' THEN t_ns END AS v_t, event_type AS first, false AS done FROM o WHERE rn = 1
UNION ALL SELECT n.stream_id, n.rn, n.c_id, n.c_t, n.v_id, n.v_t, n.first, n.c_t IS NOT NULL AND n.v_t IS NOT NULL AND abs(n.c_t - n.v_t) <= {24 * HOUR} FROM (
SELECT o.stream_id, o.rn, CASE WHEN o.event_type = 'click' THEN o.frame_id WHEN NOT f.done THEN f.c_id END AS c_id, CASE WHEN o.event_type = 'click' THEN o.t_ns WHEN NOT f.done THEN f.c_t END AS c_t,
CASE WHEN o.event_type = 'view' THEN o.frame_id WHEN NOT f.done THEN f.v_id END AS v_id, CASE WHEN o.event_type = 'view' THEN o.t_ns WHEN NOT f.done THEN f.v_t END AS v_t, CASE WHEN f.done THEN o.event_type ELSE f.first END AS first
FROM f JOIN o ON o.stream_id = f.stream_id AND o.rn = f.rn + 1) n)
SELECT stream_id, CASE WHEN first = 'click' THEN c_id ELSE v_id END AS frame_id, CASE WHEN first = 'click' THEN v_id ELSE c_id END AS other_id, CAST(2 AS INTEGER) AS n FROM f WHERE done""")
def join_latest_exact(spark, d):
    """Latest row of each path in arrival order, consumed on a match within 24 hours."""
    e = flow(spark, d).withColumn("path_id", F.col("event_type"))
    out = joins.join_paths(e, ["click", "view"], window_ns=24 * HOUR).where("path_id = 'merged'")
    return out.select("stream_id", "frame_id", F.get("observations", F.lit(1))["frame_id"].alias("other_id"), F.size("observations").alias("n"))


@query(f"WITH {EV} SELECT a.stream_id, a.frame_id, b.frame_id AS frame_id_right, b.t_ns - a.t_ns AS delta_ns FROM ev a JOIN ev b ON a.stream_id = b.stream_id AND a.event_type = 'click' AND b.event_type = 'view' AND b.t_ns BETWEEN a.t_ns - {6 * HOUR} AND a.t_ns + {6 * HOUR}")
def interval_join(spark, d):
    e = events(spark, d)
    out = joins.interval_join(e.where("event_type = 'click'"), e.where("event_type = 'view'"), 6 * HOUR)
    return out.select("stream_id", "frame_id", "frame_id_right", (F.col("t_ns_right") - F.col("t_ns")).alias("delta_ns"))


@query(f"WITH {EV} SELECT a.frame_id, b.frame_id AS frame_id_2, c.frame_id AS frame_id_3 FROM ev a JOIN ev b ON a.event_type = 'click' AND b.event_type = 'view' AND abs(b.t_ns - a.t_ns) <= {HOUR // 4} JOIN ev c ON c.event_type = 'purchase' AND abs(c.t_ns - a.t_ns) <= {HOUR // 4}")
def interval_join_fold(spark, d):
    """Three inputs of one stream, folded from the left."""
    e = events(spark, d).withColumn("stream_id", F.lit("all"))
    return joins.interval_join_all([e.where(F.col("event_type") == t) for t in ("click", "view", "purchase")], HOUR // 4).select("frame_id", "frame_id_2", "frame_id_3")


def _messages(spark, d):
    """Up to five sources to a frame: events of a user on a day are a frame."""
    e = events(spark, d)
    return e.select("stream_id", F.floor(F.col("t_ns") / F.lit(24 * HOUR)).alias("frame_id"), F.col("event_type").alias("source"), "t_ns", F.col("frame_id").alias("seq"), "value")


_ALIGN = f"""{EV}, m AS (SELECT stream_id, t_ns // {24 * HOUR} AS frame_id, event_type AS source, t_ns, frame_id AS seq, value FROM ev),
l AS (SELECT stream_id, frame_id, source, arg_max(t_ns, seq) AS t_ns, arg_max(value, seq) AS value FROM m GROUP BY ALL),
n AS (SELECT stream_id, max(t_ns) AS newest FROM m GROUP BY stream_id),
a AS (SELECT stream_id, frame_id, min(t_ns) AS first_ns, max(t_ns) AS last_ns, count(*) AS sources, max(value) AS top FROM l GROUP BY ALL)"""


def _aligned(spark, d, release):
    a = joins.align(_messages(spark, d), 72 * HOUR, release)
    return a.select("stream_id", "frame_id", "first_ns", "last_ns", F.size("sources").cast("bigint").alias("sources"), F.array_max(F.transform(F.map_values("messages"), lambda m: m["value"])).alias("top"), "delay_ns")


@query(f"WITH {_ALIGN} SELECT a.*, newest - first_ns AS delay_ns FROM a JOIN n USING (stream_id) WHERE newest - first_ns > {72 * HOUR}")
def aligned_release(spark, d):
    return _aligned(spark, d, "strict")


@query(f"WITH {_ALIGN} SELECT a.*, newest - first_ns AS delay_ns FROM a JOIN n USING (stream_id)")
def aligned_flush(spark, d):
    return _aligned(spark, d, "flush")


@query(f"WITH {_ALIGN} SELECT stream_id, frame_id, (newest - first_ns - {72 * HOUR}) / 1000000.0::DOUBLE AS delay_ms FROM a JOIN n USING (stream_id) WHERE newest - first_ns > {108 * HOUR}")
def sync_delay(spark, d):
    return joins.sync_delays(_aligned(spark, d, "strict"), 72 * HOUR).select("stream_id", "frame_id", "delay_ms")


@query(f"WITH {EV} SELECT stream_id, frame_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS click, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS view FROM ev WINDOW w AS (PARTITION BY stream_id ORDER BY t_ns, frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def latest_asof(spark, d):
    x = joins.latest_per_source(flow(spark, d), ["click", "view"])
    return x.select("stream_id", "frame_id", F.col("latest_click")["signals"]["value"].alias("click"), F.col("latest_view")["signals"]["value"].alias("view"))


@query(f"WITH {EV} SELECT frame_id, last_value(CASE WHEN event_type = 'click' AND k > 90 THEN value END IGNORE NULLS) OVER (ORDER BY t_ns, frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rare FROM ev")
def latest_one_stream(spark, d):
    """All events as one stream, looked up in two levels."""
    e = rows.to_flow(events(spark, d).withColumn("stream_id", F.lit("all")))
    return ordered.latest(e, F.when((F.col("event_type") == "click") & (F.col("k") > 90), F.col("value")), "rare", bucket_ns=HOUR).select("frame_id", "rare")


_FUSE = f"""WITH RECURSIVE {EV}, l AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS c, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS v, row_number() OVER (PARTITION BY stream_id ORDER BY t_ns, frame_id) AS rn
FROM ev WINDOW w AS (PARTITION BY stream_id ORDER BY t_ns, frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
o AS (SELECT *, c IS NOT NULL AND v IS NOT NULL AS seen, coalesce(c + v > 80.0, false) AS cand FROM l),
f AS (SELECT stream_id, rn, frame_id, t_ns, c, v, seen, cand, CASE WHEN cand THEN t_ns + {12 * HOUR} ELSE 0 END AS until, cand AS fire, false AS cool FROM o WHERE rn = 1
UNION ALL SELECT o.stream_id, o.rn, o.frame_id, o.t_ns, o.c, o.v, o.seen, o.cand, CASE WHEN o.cand AND o.t_ns >= f.until THEN o.t_ns + {12 * HOUR} ELSE f.until END, o.cand AND o.t_ns >= f.until, o.t_ns < f.until FROM f JOIN o ON o.stream_id = f.stream_id AND o.rn = f.rn + 1)"""


def _fused(spark, d):
    both = FusionModule("both", ["click", "view"], lambda s: fus.decision(s["click"]["signals"]["value"] + s["view"]["signals"]["value"] > 80.0, "sum", s["click"]["signals"]["value"] + s["view"]["signals"]["value"]), 12 * 3600.0)
    return both.apply(flow(spark, d))


@query(_FUSE + " SELECT stream_id, frame_id, t_ns, CASE WHEN cool THEN 'cooldown' WHEN NOT seen THEN 'missing_sources' WHEN NOT cand THEN 'no_trigger' ELSE 'triggered' END AS state, CASE WHEN fire THEN c + v ELSE 0.0 END AS score FROM f")
def fusion_state(spark, d):
    o = F.try_element_at("observations", F.lit(-1))
    return ids(_fused(spark, d), o["metadata"]["state"].alias("state"), fn.trigger_score(o).alias("score"))


@query(_FUSE + " SELECT stream_id, frame_id, t_ns AS event_ns, t_ns - 2000000000 AS clip_start_ns, t_ns + 2000000000 AS clip_end_ns, 'sum' AS label, c + v AS score, 'sum' AS reason, 'both' AS source FROM f WHERE fire")
def fusion_trigger(spark, d):
    return rows.triggers(_fused(spark, d))


@query(f"WITH RECURSIVE {EV}, o AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t_ns, frame_id) AS rn FROM ev WHERE value > 40.0), f AS (SELECT stream_id, rn, frame_id, t_ns, t_ns + {24 * HOUR} AS until, true AS fire FROM o WHERE rn = 1 UNION ALL SELECT o.stream_id, o.rn, o.frame_id, o.t_ns, CASE WHEN o.t_ns >= f.until THEN o.t_ns + {24 * HOUR} ELSE f.until END, o.t_ns >= f.until FROM f JOIN o ON o.stream_id = f.stream_id AND o.rn = f.rn + 1) SELECT stream_id, frame_id, t_ns FROM f WHERE fire")
def cooldown(spark, d):
    e = events(spark, d).withColumn("hot", F.col("value") > 40.0)
    return ids(ordered.cooldown(e, "hot", 24 * HOUR).where("fires.fires"))


@query(f"WITH {EV} SELECT frame_id, t_ns - 1500000000 AS clip_start_ns, t_ns + 500000000 AS clip_end_ns, CASE WHEN event_type = 'click' THEN 'HIGHLIGHT' ELSE event_type END AS label FROM ev WHERE value > 80.0")
def clip_window(spark, d):
    t = fn.trigger("r", F.col("value"), label=F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type")), pre_sec=1.5, post_sec=0.5)
    x = events(spark, d).where("value > 80.0").withColumn("t", t)
    return x.select("frame_id", "t.clip_start_ns", "t.clip_end_ns", fn.label_or(F.col("t.label")).alias("label"))


@query(f"WITH {EV} SELECT '{{\"label\":\"' || event_type || '\",\"t_start_ns\":' || (t_ns - 2000000000) || ',\"t_end_ns\":' || (t_ns + 2000000000) || ',\"faces\":0,\"score\":1.0,\"reason\":\"high\"}}' AS value FROM ev WHERE value > 90.0")
def trigger_sender(spark, d):
    m = ColumnModule("m", lambda: F.when(F.col("value") > 90.0, fn.observation("m", trigger=fn.trigger("high", label=F.col("event_type")))))
    return trigger_messages(rows.triggers(m.apply(rows.to_flow(events(spark, d)))))


def _batches_sql(having):
    return f"WITH {ORD}, b AS (SELECT *, (rn - 1) // 4 AS b FROM o) SELECT stream_id, CAST(arg_min(frame_id, rn) AS BIGINT) AS frame_id, CAST(count(*) AS VARCHAR) AS batch_size, CAST(count(*) AS INTEGER) AS n, CAST(arg_max(frame_id, rn) AS BIGINT) AS last_id FROM b GROUP BY stream_id, b.b{having}"


def _batches(spark, d, flush):
    out = joins.collect_batches(flow(spark, d), 4, flush)
    return out.select("stream_id", "frame_id", F.col("metadata")["_batch_size"].alias("batch_size"), F.size("observations").alias("n"), F.try_element_at("observations", F.lit(-1))["frame_id"].alias("last_id"))


@query(_batches_sql(" HAVING count(*) = 4"))
def collector(spark, d):
    return _batches(spark, d, False)


@query(_batches_sql(""))
def collector_flush(spark, d):
    return _batches(spark, d, True)


@query(f"WITH {EV}, l AS (SELECT *, lag(frame_id) OVER (PARTITION BY event_type ORDER BY frame_id) AS p FROM ev) SELECT event_type, frame_id, p + 1 AS first_dropped, frame_id - 1 AS last_dropped, CAST(frame_id - p - 1 AS INTEGER) AS n FROM l WHERE frame_id > p + 1")
def frame_gap(spark, d):
    g = ordered.gaps(events(spark, d), ("event_type",), ("frame_id",))
    return g.select("event_type", "frame_id", F.array_min("dropped_frame_ids").alias("first_dropped"), F.array_max("dropped_frame_ids").alias("last_dropped"), F.size("dropped_frame_ids").alias("n"))


@query(f"WITH {EV} SELECT frame_id, (0.0::DOUBLE + CASE WHEN value > 30.0 THEN value ELSE 0.0::DOUBLE END) + CASE WHEN k > 40 THEN CAST(k AS DOUBLE) / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS total_score FROM ev")
def cascade_score_sum(spark, d):
    a = ColumnModule("a", lambda: F.when(F.col("value") > 30.0, fn.observation("a", trigger=fn.trigger("v", F.col("value")))))
    b = ColumnModule("b", lambda: F.when(F.col("k") > 40, fn.observation("b", trigger=fn.trigger("k", F.col("k").cast("double") / 100.0))))
    total = lambda df: df.withColumn("total_score", F.aggregate("results", F.lit(0.0), lambda s, r: s + fn.trigger_score(r)))
    g = FlowGraphBuilder().source().path("p", [a, b]).cascade_fusion(total).build()
    return compile_graph(g, events(spark, d)).results.select("frame_id", "total_score")


@query(f"WITH {EV} SELECT event_type AS component, count(k) AS count, avg(k) AS avg_ms, CAST(max(k) AS DOUBLE) AS max_ms, CAST(min(k) AS DOUBLE) AS min_ms, count(*) FILTER (WHERE k > 50) AS slow_count FROM ev GROUP BY event_type")
def timing_stats(spark, d):
    """Times are whole numbers, so that means do not hang on the order of sums."""
    e = events(spark, d).withColumns({"component": F.col("event_type"), "processing_ms": F.col("k").cast("double")})
    return agg.timing_stats(obs.slow(e, "processing_ms", 50.0))


@query(f"WITH {EV}, g AS (SELECT event_type, list_sort(list(value)) AS l, count(*) AS n FROM ev GROUP BY event_type) SELECT event_type, n, l[least(CAST(floor(n * 0.95::DOUBLE) AS BIGINT), n - 1) + 1] AS p95 FROM g")
def p95(spark, d):
    return agg.p95_by(events(spark, d), ["event_type"], "value")


@query(f"WITH RECURSIVE {ORD}, f AS (SELECT stream_id, rn, frame_id, value AS ema FROM o WHERE rn = 1 UNION ALL SELECT o.stream_id, o.rn, o.frame_id, 0.3::DOUBLE * o.value + (1 - 0.3::DOUBLE) * f.ema FROM f JOIN o ON o.stream_id = f.stream_id AND o.rn = f.rn + 1) SELECT stream_id, frame_id, ema FROM f")
def ema(spark, d):
    return ordered.ema_by(events(spark, d), ("stream_id",), ("t_ns", "seq"), "value").select("stream_id", "frame_id", "ema")


@query(f"WITH {EV}, r AS (SELECT *, k % 7 <> 0 AS ok FROM ev), s AS (SELECT list_sort(list(CAST(k AS DOUBLE)) FILTER (WHERE ok)) AS l, count(*) AS n, count(*) FILTER (WHERE ok) AS good, CAST(count(*) FILTER (WHERE value > 50.0) AS BIGINT) AS fired, (max(t_ns) - min(t_ns)) / 1000000000.0::DOUBLE AS secs FROM r) SELECT n AS frames_ingested, good AS frames_extracted, n - good AS extractions_failed, fired AS triggers_fired, n AS observations_output, list_sum(l) AS total_ms, list_sum(l) / good AS avg_ms, l[least(CAST(floor(good * 0.95::DOUBLE) AS BIGINT), good - 1) + 1] AS p95_ms, secs AS duration_sec, good / secs AS throughput_fps FROM s")
def run_counters(spark, d):
    e = events(spark, d)
    r = e.select("frame_id", (F.col("k") % 7 != 0).alias("ok"), F.col("k").cast("double").alias("processing_ms"), (F.col("value") > 50.0).cast("bigint").alias("triggers"), F.lit(1).cast("bigint").alias("observations"), F.col("t_ns").alias("start_ns"), F.col("t_ns").alias("end_ns"))
    return agg.run_stats(r)


@query(f"WITH {EV}, g AS (SELECT frame_id // 100 AS \"window\", list_sort(list(k)) AS l, count(*) AS frames, avg(k) AS avg_ms, CAST(max(k) AS DOUBLE) AS max_ms, count(*) FILTER (WHERE k > 50) AS slow, avg(k) FILTER (WHERE event_type = 'click') AS click_ms FROM ev GROUP BY 1) SELECT * EXCLUDE (l), CAST(l[least(CAST(floor(frames * 0.95::DOUBLE) AS BIGINT), frames - 1) + 1] AS DOUBLE) AS p95_ms FROM g")
def fps_summary(spark, d):
    e = events(spark, d).withColumns({"component": F.col("event_type"), "processing_ms": F.col("k").cast("double")})
    return agg.fps_summary(obs.slow(e, "processing_ms", 50.0)).withColumn("click_ms", F.try_element_at("component_avg_ms", F.lit("click"))).drop("component_avg_ms")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey > 0 THEN 250.0::DOUBLE / n_nationkey ELSE 0.0::DOUBLE END AS seconds FROM nation")
def video_duration(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    return n.select(F.col("n_nationkey").alias("id"), agg.duration(F.lit(250.0), F.col("n_nationkey")).alias("seconds"))


@query(f"WITH {EV} SELECT frame_id, event_type AS source, t_ns, value, CAST(k AS DOUBLE) AS k, 'fast' AS mode FROM ev")
def obs_json_roundtrip(spark, d):
    m = reading(metadata=F.create_map(F.lit("mode"), F.lit("fast")), timing=F.create_map(F.lit("detect"), F.lit(10.5)))
    x = m.apply(rows.to_flow(events(spark, d))).select(fn.from_message(fn.to_message(F.get("observations", F.lit(0)))).alias("o"))
    return x.select("o.frame_id", "o.source", "o.t_ns", F.col("o.signals")["value"].alias("value"), F.col("o.signals")["k"].alias("k"), F.col("o.metadata")["mode"].alias("mode"))


_LINES = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'OBS src=' || event_type || ' frame=' || event_id || ' t_ns=' || (event_id * 1000) WHEN 1 THEN '{"source":"' || event_type || '","frame_id":' || event_id || ',"t_ns":7}' WHEN 2 THEN 'not valid json' WHEN 3 THEN 'OBS frame=abc' ELSE '{}' END AS line FROM events"""


def _lines(spark, d):
    i, t = F.col("event_id").cast("string"), F.col("event_type")
    text = (
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("OBS src="), t, F.lit(" frame="), i, F.lit(" t_ns="), (F.col("event_id") * 1000).cast("string")))
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit('{"source":"'), t, F.lit('","frame_id":'), i, F.lit(',"t_ns":7}')))
        .when(F.col("event_id") % 5 == 2, "not valid json").when(F.col("event_id") % 5 == 3, "OBS frame=abc").otherwise("{}")
    )
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", text.alias("value"))


@query(f"WITH l AS ({_LINES}) SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id WHEN 1 THEN event_id WHEN 4 THEN 0 END AS frame_id, CASE WHEN event_id % 5 IN (0, 1) THEN event_type WHEN event_id % 5 = 4 THEN 'unknown' END AS source, CASE event_id % 5 WHEN 0 THEN event_id * 1000 WHEN 1 THEN 7 ELSE 0 END AS t_ns FROM l JOIN events USING (event_id)")
def obs_header_parse(spark, d):
    h = fn.header(F.col("value"))
    return _lines(spark, d).select("event_id", h["frame_id"].alias("frame_id"), h["source"].alias("source"), h["t_ns"].alias("t_ns"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 1 THEN 'json:' || event_type WHEN event_id % 5 = 0 THEN 'text:' || event_type WHEN event_id % 5 = 4 THEN 'text:unknown' END AS parsed FROM events")
def composite_mapper(spark, d):
    first = lambda m: F.concat(F.lit("json:"), fn.from_message(m)["source"])
    second = lambda m: F.concat(F.lit("text:"), fn.header(m)["source"])
    return _lines(spark, d).select("event_id", fn.first_parsed(F.col("value"), first, second).alias("parsed"))


@query(f"WITH {EV} SELECT frame_id, CAST(k AS DOUBLE) AS count, CASE WHEN value > 50.0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS big, event_type AS name FROM ev WHERE k % 4 <> 0")
def dict_to_observation(spark, d):
    """Numbers and booleans become signals, the rest data; where all are null there is no observation."""
    some = lambda c: F.when(F.col("k") % 4 != 0, c)
    m = ColumnModule("m", lambda: fn.split_values({"count": some(F.col("k")), "big": some(F.col("value") > 50.0)}, {"name": some(F.col("event_type"))}, "m"))
    x = rows.min_observations(m.apply(rows.to_flow(events(spark, d)))).withColumn("o", F.get("observations", F.lit(0)))
    return x.select("frame_id", F.col("o.signals")["count"].alias("count"), F.col("o.signals")["big"].alias("big"), F.get_json_object("o.data", "$.name").alias("name"))


@query(f"WITH {EV} SELECT frame_id, event_type AS k, 'x' AS extra, CAST(3 AS INTEGER) AS n FROM ev")
def observation_to_dict(spark, d):
    """Data wins over signals of the same name."""
    o = fn.observation("m", signals=fn.signals(k=F.col("k"), value=F.col("value")), data=F.to_json(F.struct(F.col("event_type").alias("k"), F.lit("x").alias("extra"))))
    x = events(spark, d).select("frame_id", fn.merged(o).alias("m"))
    return x.select("frame_id", F.col("m")["k"].alias("k"), F.col("m")["extra"].alias("extra"), F.size("m").alias("n"))


@query(f"WITH {EV} SELECT frame_id, value + 1.0::DOUBLE AS first_x, (value + 1.0::DOUBLE) * 2.0::DOUBLE AS second_x, CAST(2 AS INTEGER) AS n FROM ev")
def dependency_chain(spark, d):
    """The second module reads the first one's observation of the same row; a missing one is left out."""
    a = ColumnModule("a", lambda: fn.observation("a", signals=fn.signals(x=F.col("value") + 1.0)))
    b = ColumnModule("b", lambda deps: fn.observation("b", signals=fn.signals(x=deps("a")["signals"]["x"] * 2.0)), ("a", "gone"))
    x = run_modules(rows.to_flow(events(spark, d)), [a, b])
    return x.select("frame_id", F.get("observations", F.lit(0))["signals"]["x"].alias("first_x"), F.get("observations", F.lit(1))["signals"]["x"].alias("second_x"), F.size("observations").alias("n"))


@query(f"WITH {EV} SELECT frame_id, value + 1.0::DOUBLE AS x, (value + 1.0::DOUBLE) * 3.0::DOUBLE AS y FROM ev WHERE k % 5 <> 0")
def module_chain_udf(spark, d):
    """Two Python modules in one pass; the first gives nothing for some rows, and those go."""
    a = PythonModule("a", lambda frame: None if frame["k"] % 5 == 0 else {"x": frame["value"] + 1.0}, reads=("k", "value"))
    b = PythonModule("b", lambda frame, deps: {"y": deps["a"]["signals"]["x"] * 3.0} if "a" in deps else None, ("a",))
    x = rows.min_observations(run_modules(rows.to_flow(events(spark, d)), [a, b]), 2)
    return x.select("frame_id", F.get("observations", F.lit(0))["signals"]["x"].alias("x"), F.get("observations", F.lit(1))["signals"]["y"].alias("y"))


@query(f"WITH {EV} SELECT frame_id, value FROM ev WHERE k % 10 <> 0")
def module_error_drop(spark, d):
    """A module that fails on some rows gives no observation for them."""

    def work(frame):
        if frame["k"] % 10 == 0:
            raise ValueError("no")
        return {"x": frame["value"]}

    x = PythonModule("m", work, reads=("k", "value"), on_error="drop").apply(rows.to_flow(events(spark, d)))
    return rows.min_observations(x).select("frame_id", F.get("observations", F.lit(0))["signals"]["x"].alias("value"))


@query(f"WITH {EV} SELECT frame_id, i AS part FROM ev, generate_series(1, 3) AS g(i) WHERE i <= k % 4")
def custom_udtf(spark, d):
    """A custom node that turns a row into none to three."""
    g = FlowGraphBuilder().source().custom(lambda df: df.withColumn("part", F.explode(F.filter(F.array(*[F.lit(i).cast("bigint") for i in (1, 2, 3)]), lambda i: i <= F.col("k") % 4)))).build()
    return compile_graph(g, events(spark, d)).results.select("frame_id", "part")


@query(f"WITH {EV} SELECT frame_id, event_type, CASE WHEN value > 70.0 THEN 'triggered' ELSE 'no_trigger' END AS state, CASE WHEN value > 70.0 THEN value ELSE 0.0 END AS score FROM ev WHERE event_type IN ('click', 'view')")
def path_process(spark, d):
    """A path with a fusion that is fed each observation: all of its outputs, firing or not."""
    f = FusionModule("f", ["reading"], lambda s: fus.decision(s["reading"]["signals"]["value"] > 70.0, "hot", s["reading"]["signals"]["value"]), 0.0)
    one = ColumnModule("reading", lambda: fn.observation("reading", signals=fn.signals(value=F.col("value"))))
    p = Path("p", [one], f).process(rows.to_flow(events(spark, d).where("event_type in ('click', 'view')")))
    o = F.try_element_at("observations", F.lit(-1))
    return p.select("frame_id", "event_type", o["metadata"]["state"].alias("state"), fn.trigger_score(o).alias("score"))


@query(f"WITH {EV} SELECT frame_id, value > 50.0 AS is_slow FROM ev")
def slow_flag(spark, d):
    return obs.slow(events(spark, d), "value", 50.0).select("frame_id", "is_slow")


@query(f"WITH {EV}, l AS (SELECT *, lag(frame_id) OVER (PARTITION BY stream_id ORDER BY t_ns, frame_id) AS p FROM ev), g AS (SELECT frame_id, range(p + 1, frame_id) AS ids FROM l WHERE frame_id > p + 1) SELECT frame_id, 'DROP ' || array_to_string(ids[1:5], ', ') || CASE WHEN len(ids) > 5 THEN ' +' || (len(ids) - 5) || ' more' ELSE '' END || ': gap' AS line FROM g")
def drop_report(spark, d):
    t = ordered.gaps(events(spark, d)).withColumns({"record_type": F.lit("frame_drop"), "reason": F.lit("gap"), "processing_ms": F.lit(0.0), "component": F.lit(""), "delay_ms": F.lit(0.0), "waiting_for": F.array().cast("array<string>")})
    return obs.console_lines(t).select("frame_id", "line")


@query(f"WITH {EV} SELECT frame_id, CAST(k % 4 AS INTEGER) AS min_level FROM ev WHERE k % 4 <= 2")
def trace_level(spark, d):
    return obs.admitted(events(spark, d).withColumn("min_level", (F.col("k") % 4).cast("int")), obs.TraceLevel.NORMAL).select("frame_id", "min_level")


@query(f"WITH {EV} SELECT frame_id, t_ns FROM ev ORDER BY t_ns DESC, frame_id DESC LIMIT 50")
def memory_ring(spark, d):
    """The newest 50 records: a ring buffer."""
    return obs.last_records(events(spark, d), 50, ("t_ns", "frame_id")).select("frame_id", "t_ns")


@query(f"WITH {EV}, c AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN t_ns END IGNORE NULLS) OVER w AS c, last_value(CASE WHEN event_type = 'view' THEN t_ns END IGNORE NULLS) OVER w AS v FROM ev WINDOW w AS (PARTITION BY stream_id ORDER BY t_ns, frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT frame_id, greatest(c, v) - least(c, v) AS spread_ns FROM c WHERE c IS NOT NULL AND v IS NOT NULL")
def temporal_spread(spark, d):
    x = joins.latest_per_source(flow(spark, d), ["click", "view"])
    return joins.spread(x, ["click", "view"]).select("frame_id", "spread_ns")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn FROM conversations) WHERE rn % 2 = 0")
def sample_turns(spark, d):
    """Every second turn of each conversation: another ordered stream."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return ordered.ordinal(c, "n", ("conv_id",), ("turn", "role", "text")).where("n % 2 = 0").select("conv_id", "turn", "role")


@query(f"WITH {ORD} SELECT stream_id, CAST(count(*) AS BIGINT) AS frames, CAST(count(*) FILTER (WHERE value > 60.0) AS BIGINT) AS triggers, (max(t_ns) - min(t_ns)) / 1000000000.0::DOUBLE AS duration_sec FROM o GROUP BY stream_id")
def session_summary(spark, d):
    return agg.session_stats(events(spark, d), F.col("value") > 60.0)


@query(ORACLE["sample_count"])
def stream_sample_count(spark, d):
    """The stateful streaming form gives the batch form's rows."""
    return ids(st.to_table(st.every_nth(live(spark, d), 3), scratch(spark)))


@query(ORACLE["ts_sample"])
def stream_ts_sample(spark, d):
    return ids(st.to_table(st.min_interval(live(spark, d), 12 * HOUR), scratch(spark)))


@query(ORACLE["cooldown"])
def stream_cooldown(spark, d):
    return ids(st.to_table(st.cooldown(live(spark, d).withColumn("hot", F.col("value") > 40.0), "hot", 24 * HOUR), scratch(spark)))


@query(_FUSE + " SELECT stream_id, frame_id, t_ns, CASE WHEN cool THEN 'cooldown' WHEN NOT seen THEN 'missing_sources' WHEN NOT cand THEN 'no_trigger' ELSE 'triggered' END AS state, CASE WHEN fire THEN c + v ELSE 0.0 END AS score FROM f")
def stream_fusion(spark, d):
    both = lambda s: ("sum", s["click"] + s["view"]) if s["click"] + s["view"] > 80.0 else None
    x = live(spark, d).withColumnRenamed("event_type", "source")
    return ids(st.to_table(st.fuse(x, ["click", "view"], both, 12 * HOUR), scratch(spark)), "state", "score")


@query(f"WITH {EV} SELECT a.stream_id, a.frame_id, b.frame_id AS frame_id_right FROM ev a JOIN ev b ON a.stream_id = b.stream_id AND a.event_type = 'click' AND b.event_type = 'view' AND abs(b.t_ns - a.t_ns) <= {6 * HOUR}")
def stream_interval_join(spark, d):
    x = live(spark, d)
    out = st.interval_join(x.where("event_type = 'click'"), x.where("event_type = 'view'"), 6 * HOUR, "40 days")
    return st.to_table(out.select("stream_id", "frame_id", "frame_id_right"), scratch(spark))


@query(f"WITH {EV} SELECT stream_id, frame_id, t_ns FROM ev WHERE k % 7 = 3 AND k % 10 <> 3")
def filter_python(spark, d):
    """A condition that is a Python function; rows on which it fails are dropped."""

    def test(r):
        return 1 // (r["k"] % 10 - 3) is not None and r["k"] % 7 == 3

    g = FlowGraphBuilder().source().filter(python_condition(test, ["k"], "drop")).build()
    return ids(compile_graph(g, events(spark, d)).results)


@query(f"WITH {EV} SELECT frame_id, CASE WHEN k % 10 = 0 THEN 'ValueError: no' END AS error, CASE WHEN k % 10 <> 0 THEN value END AS x FROM ev")
def worker_errors(spark, d):
    """Errors as values of the row."""

    def work(frame):
        if frame["k"] % 10 == 0:
            raise ValueError("no")
        return {"x": frame["value"]}

    w = worker_results(PythonModule("m", work, reads=("k", "value")), rows.to_flow(events(spark, d)))
    return w.select("frame_id", "worker.error", F.try_element_at("worker.observation.signals", F.lit("x")).alias("x"))


@query("SELECT n_nationkey AS id, b AS path_id FROM nation, (VALUES ('p1'), ('p2')) AS t(b)")
def multi_path(spark, d):
    """Several paths over the same rows, each with its own analyzers."""
    f = rows.to_flow(spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("frame_id"), F.lit(0).cast("bigint").alias("t_ns")))
    paths = [Path(p, [ColumnModule(p, lambda: fn.observation("x"))]) for p in ("p1", "p2")]
    return extract_paths(paths, f).select(F.col("frame_id").cast("int").alias("id"), "path_id")


@query(ORACLE["sample_count"])
def sample_bucketed(spark, d):
    """Every third row of a stream in a graph, numbered in two levels."""
    return ids(compile_graph(FlowGraphBuilder().source().sample(3, bucket_ns=24 * HOUR).build(), events(spark, d)).results)


@query(ORACLE["ts_sample"])
def ts_sample_bucketed(spark, d):
    """Streams cut where nothing comes for the interval."""
    return ids(compile_graph(FlowGraphBuilder().source().sample_time(12 * HOUR, bucket_ns=48 * HOUR).build(), events(spark, d)).results)


@query(ORACLE["cooldown"])
def cooldown_bucketed(spark, d):
    e = events(spark, d).withColumn("hot", F.col("value") > 40.0)
    return ids(ordered.cooldown(e, "hot", 24 * HOUR, bucket_ns=48 * HOUR).where("fires.fires"))


@query(ORACLE["collector"])
def collector_bucketed(spark, d):
    g = FlowGraph().add_node("c", S.Collector(4, bucket_ns=24 * HOUR))
    out = compile_graph(g, flow(spark, d)).results
    return out.select("stream_id", "frame_id", F.col("metadata")["_batch_size"].alias("batch_size"), F.size("observations").alias("n"), F.try_element_at("observations", F.lit(-1))["frame_id"].alias("last_id"))


@query(ORACLE["latest_asof"])
def latest_bucketed(spark, d):
    x = joins.latest_per_source(flow(spark, d), ["click", "view"], bucket_ns=48 * HOUR)
    return x.select("stream_id", "frame_id", F.col("latest_click")["signals"]["value"].alias("click"), F.col("latest_view")["signals"]["value"].alias("view"))


@query(ORACLE["fusion_state"])
def fusion_bucketed(spark, d):
    both = FusionModule("both", ["click", "view"], lambda s: fus.decision(s["click"]["signals"]["value"] + s["view"]["signals"]["value"] > 80.0, "sum", s["click"]["signals"]["value"] + s["view"]["signals"]["value"]), 12 * 3600.0, bucket_ns=48 * HOUR)
    o = F.try_element_at("observations", F.lit(-1))
    return ids(both.apply(flow(spark, d)), o["metadata"]["state"].alias("state"), fn.trigger_score(o).alias("score"))


@query(f"WITH {EV} SELECT frame_id, CASE WHEN k = 0 THEN 'error' WHEN 600 // k > 20 THEN 'triggered' ELSE 'no_trigger' END AS state FROM ev")
def fusion_error(spark, d):
    """A decision that fails on some rows gives the state ``error`` there and stops nothing."""
    f = FusionModule("f", ["reading"], lambda s: fus.decision(F.lit(600).cast("bigint") / F.col("k") >= 21, "many"), 0.0)
    one = ColumnModule("reading", lambda: fn.observation("reading", signals=fn.signals(value=F.col("value"))))
    return f.apply(one.apply(rows.to_flow(events(spark, d)))).select("frame_id", F.try_element_at("observations", F.lit(-1))["metadata"]["state"].alias("state"))


@query(f"""WITH {EV} SELECT frame_id, 'filter' AS node, 'default' AS path_id FROM ev WHERE k <> 0 AND 600 / k > 20
UNION ALL SELECT frame_id, 'branch', CASE WHEN 600 / k > 20 THEN 'yes' ELSE 'no' END FROM ev WHERE k <> 0
UNION ALL SELECT frame_id, 'multi', CASE WHEN k > 90 THEN 'high' WHEN 600 / k > 20 THEN 'yes' ELSE 'rest' END FROM ev WHERE k <> 0
UNION ALL SELECT frame_id, 'fanout', p FROM ev, (VALUES ('big'), ('all')) AS t(p) WHERE k <> 0 AND (p = 'all' OR 600 / k > 20)""")
def error_policy(spark, d):
    """Conditions that fail on rows (a division by zero): under ``drop`` every node drops those rows and goes on."""
    e = events(spark, d)
    many = lambda: F.lit(600) / F.col("k") > 20
    b = FlowGraphBuilder
    graphs = {
        "filter": b().source().filter(many, on_error="drop"),
        "branch": b().source().branch(many, "yes", "no", on_error="drop"),
        "multi": b().source().multi_branch([(lambda: F.col("k") > 90, "high"), (many, "yes")], "rest", on_error="drop"),
        "fanout": b().source().conditional_fanout([("big", many), ("all", lambda: F.col("k") >= 0)], on_error="drop"),
    }
    return rows.union(*[compile_graph(g.build(), e).results.select("frame_id", F.lit(n).alias("node"), "path_id") for n, g in graphs.items()])


@query(f"WITH {EV} SELECT stream_id, frame_id, t_ns, 'merged' AS path_id, CAST(2 AS INTEGER) AS n FROM ev UNION ALL SELECT stream_id, frame_id, t_ns, 'merged', CAST(2 AS INTEGER) FROM ev")
def join_repeated_frames(spark, d):
    """Frames that come twice: each arrival is a row of its own, in the join that the compiler picks as in the exact one."""
    e = events(spark, d)
    twice = e.unionByName(e.withColumn("seq", F.col("seq") + 1_000_000_000))
    a, b = ColumnModule("a", lambda: fn.observation("a")), ColumnModule("b", lambda: fn.observation("b"))
    g = FlowGraphBuilder().source().fanout(["pa", "pb"]).path("pa", [a]).path("pb", [b]).join(["pa", "pb"]).build()
    return ids(compile_graph(g, twice).results, "path_id", F.size("observations").alias("n"))


@query(f"WITH {EV} SELECT stream_id, CAST(arg_max(frame_id, (t_ns, frame_id)) AS BIGINT) AS frame_id FROM ev WHERE event_type = 'click' GROUP BY stream_id")
def join_flush(spark, d):
    """A join whose other path never comes gives, at the end, what it holds: the stream's last click."""
    e = rows.to_flow(events(spark, d)).withColumn("path_id", F.col("event_type"))
    return joins.join_paths(e, ["click", "never"], flush=True).where("path_id = 'merged'").select("stream_id", "frame_id")


@query(f"WITH {EV} SELECT frame_id, value AS x, CAST(1 AS INTEGER) AS n FROM ev")
def dependency_alias(spark, d):
    """A dependency that is missing, and another source that stands in for it."""
    b = ColumnModule("b", lambda deps: fn.observation("b", signals=fn.signals(x=deps("sensor")["signals"]["value"])), ("sensor",), {"sensor": "reading"})
    one = ColumnModule("reading", lambda: fn.observation("reading", signals=fn.signals(value=F.col("value"))))
    x = run_modules(rows.to_flow(events(spark, d)), [one, b])
    return x.select("frame_id", F.try_element_at("observations", F.lit(-1))["signals"]["x"].alias("x"), F.size(F.filter("observations", lambda o: o["source"] == "b")).alias("n"))


@query(f"WITH {EV} SELECT frame_id, value AS score, CAST(1 AS INTEGER) AS n FROM ev WHERE value > 70.0")
def extract_fusion(spark, d):
    """An extract node: its fusion's outputs are results where they fire, and never observations."""
    one = ColumnModule("reading", lambda: fn.observation("reading", signals=fn.signals(value=F.col("value"))))
    f = FusionModule("f", ["reading"], lambda s: fus.decision(s["reading"]["signals"]["value"] > 70.0, "hot", s["reading"]["signals"]["value"]), 0.0)
    out = compile_graph(FlowGraph().add_node("x", S.Extract((one,), f)), rows.to_flow(events(spark, d))).fired()
    return out.select("frame_id", fn.trigger_score(F.try_element_at("results", F.lit(-1))).alias("score"), F.size("observations").alias("n"))


@query(f"WITH {EV} SELECT frame_id, value * 2.0::DOUBLE AS x FROM ev WHERE k % 2 = 0")
def decorated_extractor(spark, d):
    @extractor("doubled")
    def doubled():
        return F.when(F.col("k") % 2 == 0, fn.observation("doubled", signals=fn.signals(x=F.col("value") * 2.0)))

    x = rows.min_observations(doubled.apply(rows.to_flow(events(spark, d))))
    return x.select("frame_id", F.get("observations", F.lit(0))["signals"]["x"].alias("x"))


@query(f"WITH {EV} SELECT frame_id, i AS part FROM ev, generate_series(1, 3) AS g(i) WHERE i <= k % 4 AND k % 10 <> 7")
def custom_python(spark, d):
    """A custom node that is a Python function of a row: none, one or many rows, and rows on which it fails are dropped."""

    def split(r):
        if r["k"] % 10 == 7:
            raise ValueError("no")
        n = r["k"] % 4
        return None if not n else {"frame_id": r["frame_id"], "part": 1} if n == 1 else [{"frame_id": r["frame_id"], "part": i + 1} for i in range(n)]

    return python_processor(split, "frame_id bigint, part bigint", "drop")(events(spark, d).select("frame_id", "k"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey IN (3, 7) THEN 'TimeoutError' END AS error FROM nation")
def module_timeout(spark, d):
    """Calls that take too long count as failed."""
    import time

    def work(frame):
        if frame["frame_id"] in (3, 7):
            time.sleep(1.0)
        return {"x": 1}

    f = rows.to_flow(spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("frame_id"), F.lit(0).cast("bigint").alias("t_ns")))
    w = worker_results(PythonModule("m", work, timeout_sec=0.3), f)
    return w.select(F.col("frame_id").cast("int").alias("id"), F.split(F.col("worker.error"), ":")[0].alias("error"))


@query(f"WITH {EV} SELECT count(*) AS frames_processed, count(*) FILTER (WHERE k % 5 <> 0) AS total_observations, count(*) FILTER (WHERE k % 10 = 0) AS timeouts, count(*) FILTER (WHERE k % 10 = 5) AS errors, CAST(sum(k) AS DOUBLE) / count(*) AS avg_time_ms FROM ev")
def orchestrator_stats(spark, d):
    e = rows.to_flow(events(spark, d))
    error = F.when(F.col("k") % 10 == 0, F.lit("TimeoutError: ")).when(F.col("k") % 10 == 5, F.lit("ValueError: no"))
    w = F.struct(F.when(error.isNull(), fn.observation("m")).alias("observation"), error.alias("error"), F.col("k").cast("double").alias("timing_ms"))
    return agg.worker_stats(e.withColumn("worker", w))


@query(f"WITH l AS ({_LINES}) SELECT CASE event_id % 5 WHEN 0 THEN event_id WHEN 1 THEN event_id WHEN 4 THEN 0 END AS frame_id, CASE WHEN event_id % 5 IN (0, 1) THEN event_type WHEN event_id % 5 = 4 THEN 'unknown' END AS source, CASE event_id % 5 WHEN 0 THEN event_id * 1000 WHEN 1 THEN 7 ELSE 0 END AS t_ns, event_id % 5 = 1 AS observed FROM l JOIN events USING (event_id)")
def message_receiver(spark, d):
    """Lines written and received again: header fields, and an observation where the line is JSON."""
    path = scratch(spark)
    write_messages(_lines(spark, d).select("value"), path)
    return src.messages(spark, path).select("frame_id", "source", "t_ns", F.col("observation").isNotNull().alias("observed"))


@query(f"WITH {EV} SELECT frame_id, event_type AS source, t_ns, CAST(k AS DOUBLE) AS k FROM ev")
def message_sender(spark, d):
    """Every observation as a JSON message, written and read."""
    path = scratch(spark)
    write_messages(observation_messages(flow(spark, d)), path)
    v = F.col("value")
    return spark.read.text(path).select(F.get_json_object(v, "$.frame_id").cast("bigint").alias("frame_id"), F.get_json_object(v, "$.source").alias("source"), F.get_json_object(v, "$.t_ns").cast("bigint").alias("t_ns"), F.get_json_object(v, "$.signals.k").cast("double").alias("k"))


@query(f"WITH {EV} SELECT 'timing' AS record_type, frame_id, event_type AS component, CAST(k AS DOUBLE) AS processing_ms, k > 50 AS is_slow FROM ev")
def trace_file(spark, d):
    """A trace written as JSON lines and read again."""
    path = scratch(spark)
    e = events(spark, d).select(F.lit("timing").alias("record_type"), "frame_id", F.col("event_type").alias("component"), F.col("k").cast("double").alias("processing_ms"), F.lit(1).alias("min_level"))
    obs.write_trace(obs.slow(e, "processing_ms", 50.0), path)
    return spark.read.schema("record_type string, frame_id bigint, component string, processing_ms double, is_slow boolean").json(path)


@query(f"WITH {EV} SELECT frame_id, CAST(k % 3 AS INTEGER) AS n, CASE WHEN k % 3 > 0 THEN CAST(k AS DOUBLE) / 100.0::DOUBLE END AS confidence FROM ev")
def detections(spark, d):
    """A vectorised detector: none, one or two boxes for each image."""

    def detect(image):
        k = int(image)
        return [{"bbox": {"x": i, "y": 0, "w": 1, "h": 1}, "confidence": k / 100.0, "class_id": 0, "class_name": "face", "metadata": {}} for i in range(k % 3)]

    x = events(spark, d).select("frame_id", detection_udf(detect)(F.col("k").cast("string").cast("binary")).alias("found"))
    return x.select("frame_id", F.size("found").alias("n"), F.get("found", F.lit(0))["confidence"].alias("confidence"))


@query(ORACLE["collector"])
def stream_collector(spark, d):
    """Whole rows, as the batch form gives them."""
    x = reading().apply(rows.to_flow(live(spark, d)))
    out = st.to_table(st.collect_batches(x, 4).select("stream_id", "frame_id", F.col("metadata")["_batch_size"].alias("batch_size"), F.size("observations").alias("n"), F.try_element_at("observations", F.lit(-1))["frame_id"].alias("last_id")), scratch(spark))
    return out


@query(ORACLE["aligned_release"])
def stream_align(spark, d):
    """Frames released when the stream has gone on for a window, with each source's last message."""
    e = live(spark, d)
    m = e.select("stream_id", F.floor(F.col("t_ns") / F.lit(24 * HOUR)).alias("frame_id"), F.col("event_type").alias("source"), "t_ns", F.col("frame_id").alias("seq"), "value")
    a = st.to_table(st.align(m, 72 * HOUR), scratch(spark))
    return a.select("stream_id", "frame_id", "first_ns", "last_ns", F.size("sources").cast("bigint").alias("sources"), F.array_max(F.transform("messages", lambda x: F.get_json_object(x, "$.value").cast("double"))).alias("top"), "delay_ns")


@query(f"WITH {EV}, w AS (SELECT stream_id, t_ns // {24 * HOUR} AS day, count(*) AS n, min(t_ns) AS first_ns, max(t_ns) AS last_ns FROM ev GROUP BY ALL), e AS (SELECT max(t_ns) AS newest FROM ev) SELECT stream_id, n, first_ns, last_ns FROM w, e WHERE (day + 1) * {24 * HOUR} <= newest - 10000000000")
def stream_tumbling(spark, d):
    """Days of each stream, given when the watermark has passed them."""
    return st.to_table(st.tumbling(live(spark, d), "1 day").select("stream_id", "n", "first_ns", "last_ns"), scratch(spark))


@query(f"WITH {EV} SELECT frame_id, value AS extracted, value * 2.0::DOUBLE AS updated FROM ev")
def legacy_modules(spark, d):
    """Objects of older kinds: one with ``extract``, one with ``update``, which is fed the first dependency."""

    class Extractor:
        def extract(self, frame):
            return {"x": frame["value"]}

    class Fusion:
        def update(self, observation):
            return {"y": observation["signals"]["x"] * 2.0}

    a, b = PythonModule("a", Extractor(), reads=("value",)), PythonModule("b", Fusion(), ("a",))
    x = run_modules(rows.to_flow(events(spark, d)), [a, b])
    return x.select("frame_id", F.get("observations", F.lit(0))["signals"]["x"].alias("extracted"), F.get("observations", F.lit(1))["signals"]["y"].alias("updated"))
