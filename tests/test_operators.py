"""Small cases with known answers, empty input, nulls, and Python models of the sequential operators on random streams."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire import ColumnModule, FlowGraph, FlowGraphBuilder, FusionModule, NodeProcessingError, Path, PythonModule, compile_graph, decision, process
from tidewire import functions as fn
from tidewire.modules import worker_results
from tidewire.operators import aggregates, joins, ordered, rows
from tidewire.plans import specs as S
from tidewire.plans.graph import dependency_groups
from tidewire.sources import frames as src

MS = 1_000_000


def flow(spark, n=9, step=100 * MS):
    return rows.to_flow(src.mock_frames(spark, n, step))


def at_times(spark, times, stream="main"):
    data = [(stream, i, t, i) for i, t in enumerate(times)]
    return rows.to_flow(spark.createDataFrame(data, "stream_id string, frame_id long, t_ns long, seq long"))


def ids(df):
    return [r.frame_id for r in df.orderBy("t_ns", "seq").collect()]


def scored(name, score):
    return ColumnModule(name, lambda: fn.observation(name, trigger=fn.trigger("r", score)))


def test_every_nth(spark):
    assert ids(ordered.every_nth(flow(spark), 3)) == [2, 5, 8]
    assert ids(ordered.every_nth(flow(spark), 1)) == list(range(9))
    assert ids(ordered.every_nth(flow(spark), 3, "modulo")) == [0, 3, 6]
    assert ids(ordered.every_nth(flow(spark), 3, bucket_ns=250 * MS)) == [2, 5, 8]
    with pytest.raises(ValueError):
        S.Sample(0)


def test_event_time_sampler(spark):
    assert ids(ordered.min_interval(at_times(spark, [0, 50 * MS, 100 * MS, 120 * MS]), 100 * MS)) == [0, 2]
    with pytest.raises(ValueError):
        S.TimestampSample(-1)
    with pytest.raises(ValueError):
        S.RateLimit(-1.0)


@pytest.mark.parametrize(("comparison", "want"), [("gt", [1]), ("le", [0])])
def test_signal_filter(spark, comparison, want):
    m = ColumnModule("m", lambda: fn.observation("m", signals=fn.signals(score=F.when(F.col("frame_id") == 0, 0.3).otherwise(0.8))))
    assert ids(m.apply(flow(spark, 2)).where(rows.any_signal("score", comparison, 0.5))) == want


def test_bad_comparisons():
    with pytest.raises(ValueError):
        S.SignalFilter("x", 1.0, "over")
    with pytest.raises(ValueError):
        S.SignalFilter("x", float("nan"))


def test_multi_branch(spark):
    f = flow(spark, 3)
    first = F.col("frame_id") == 0
    assert [r.path_id for r in rows.multi_branch(f, [(first, "a")], "rest").orderBy("frame_id").collect()] == ["a", "rest", "rest"]
    assert ids(rows.multi_branch(f, [(first, "a")])) == [0]
    assert ids(rows.conditional_fan_out(f, [("a", first), ("b", F.col("frame_id") >= 0), ("c", F.lit(None).cast("boolean"))])) == [0, 0, 1, 2]


def test_join_modes(spark):
    f = at_times(spark, [0, 0]).withColumn("path_id", F.when(F.col("frame_id") == 0, "a").otherwise("b"))
    f = rows.add_observations(f, fn.observation("o"))
    out = joins.join_paths(f, ["a", "b"]).collect()
    assert [(r.path_id, len(r.observations)) for r in out] == [("merged", 2)]
    assert joins.join_paths(f.where("path_id = 'a'"), ["a", "b"]).count() == 0
    assert joins.join_paths(f.where("path_id = 'a'"), ["a", "b"], flush=True).count() == 1
    assert joins.join_paths(f, ["a", "b"], "any").count() == 2
    assert [r.path_id for r in joins.join_paths(f.withColumn("path_id", F.lit("c")), ["a", "b"]).collect()] == ["c", "c"]
    with pytest.raises(ValueError):
        S.Join(("a",), "most")


def model_join(events, paths, window, late):
    held, out = {}, []
    for path, i, t in events:
        if path not in paths:
            out.append((path, [i]))
            continue
        held[path] = (i, t)
        if late > 0 and len(held) > 1:
            top = max(x for _, x in held.values())
            held = {p: v for p, v in held.items() if top - v[1] <= late}
        times = [x for _, x in held.values()]
        if window > 0 and len(held) > 1 and max(times) - min(times) > window:
            continue
        if held and all(p in held for p in paths):
            out.append(("merged", [i for i, _ in held.values()]))
            held = {}
    return out


@pytest.mark.parametrize(("paths", "window", "late"), [(["a", "b"], 30, 0), (["a", "b", "c"], 50, 0), (["a", "b", "c"], 50, 25), (["a", "b"], 0, 0)])
def test_exact_join_against_a_model(spark, paths, window, late):
    r = random.Random(len(paths) + window + late)
    events, t = [], 0
    for i in range(400):
        t += r.choice([0, 1, 5, 20, 40])
        events.append((r.choice(["a", "b", "c", "d"]), i, t))
    data = [("s", i, t, i, p) for p, i, t in events]
    f = rows.to_flow(spark.createDataFrame(data, "stream_id string, frame_id long, t_ns long, seq long, p string")).withColumn("path_id", F.col("p"))
    f = rows.add_observations(f, fn.observation("o"))
    got = joins.join_paths(f, paths, window_ns=window, lateness_ns=late).collect()
    mine = sorted((x.path_id, [o.frame_id for o in x.observations]) for x in got)
    assert mine == sorted(model_join(events, paths, window, late))


def test_interval_join_against_all_pairs(spark):
    r = random.Random(3)
    a = [("s", i, r.randrange(1000), i) for i in range(60)]
    b = [("s", i, r.randrange(1000), i) for i in range(60)]
    schema = "stream_id string, frame_id long, t_ns long, seq long"
    got = joins.interval_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 17)
    want = sorted((x[1], y[1]) for x in a for y in b if abs(x[2] - y[2]) <= 17)
    assert sorted((x.frame_id, x.frame_id_right) for x in got.collect()) == want


def test_collector(spark):
    assert [int(r.metadata["_batch_size"]) for r in joins.collect_batches(flow(spark, 3), 3).collect()] == [3]
    assert sorted(int(r.metadata["_batch_size"]) for r in joins.collect_batches(flow(spark, 5), 2, flush=True).collect()) == [1, 2, 2]
    assert joins.collect_batches(flow(spark, 4), 0).count() == 4


def test_cooldown_and_sources(spark):
    f = at_times(spark, [0, 500 * MS, 1500 * MS])
    always = FusionModule("f", ["x"], lambda s: decision(F.lit(True), "yes"), 1.0)
    x = ColumnModule("x", lambda: fn.observation("x"))
    out = always.apply(x.apply(f)).orderBy("t_ns").collect()
    assert [r.observations[-1].metadata["state"] for r in out] == ["triggered", "cooldown", "triggered"]
    both = FusionModule("g", ["face", "pose"], lambda s: decision(F.lit(True), "yes"), 0.0)
    m = [ColumnModule("face", lambda: F.when(F.col("frame_id") == 0, fn.observation("face"))), ColumnModule("pose", lambda: F.when(F.col("frame_id") == 1, fn.observation("pose")))]
    out = both.apply(m[1].apply(m[0].apply(f))).orderBy("t_ns").collect()
    assert [r.observations[-1].metadata["state"] for r in out] == ["missing_sources", "triggered", "triggered"]


def test_cascade_sum(spark):
    total = lambda df: df.withColumn("metadata", F.create_map(F.lit("total"), F.aggregate("results", F.lit(0.0), lambda a, r: a + fn.trigger_score(r)).cast("string")))
    g = FlowGraphBuilder().source().path("p", [scored("a", 0.3), scored("b", 0.5)]).cascade_fusion(total).build()
    assert {r.metadata["total"] for r in compile_graph(g, src.mock_frames(spark, 2)).results.collect()} == {"0.8"}


def test_graph_end_to_end(spark):
    calls = []
    g = FlowGraphBuilder().source().sample(2).path("p", [scored("t", 0.7)]).on_trigger(calls.append).build()
    result = process(g, src.mock_frames(spark, 6))
    assert result.frame_count == 6 and result.stats["triggers"] == 3 and len(calls) == 3
    t = result.triggers.orderBy("frame_id").first()
    assert (t.clip_start_ns, t.clip_end_ns) == (t.event_ns - 2_000_000_000, t.event_ns + 2_000_000_000)
    empty = process(g, src.mock_frames(spark, 0))
    assert empty.frame_count == 0 and empty.stats["triggers"] == 0


def test_results_and_terminals(spark):
    """A trigger that comes by two paths counts twice; a row that no edge takes is a result."""
    g = FlowGraphBuilder().source().path("p", [scored("t", 0.7)]).fanout(["a", "b", "c"]).path("a", [scored("u", 0.1)]).build()
    out = compile_graph(g, src.mock_frames(spark, 1))
    assert sorted(r.path_id for r in out.results.collect()) == ["a", "b", "c"]
    assert out.triggers().count() == 4 and out.triggers(dedupe=True).count() == 2
    assert out.fired().count() == 1


def test_fire_without_a_point(spark):
    m = ColumnModule("m", lambda: fn.observation("m", trigger=F.struct(F.lit(True).alias("fire"), F.lit(1.0).alias("score"), F.lit("r").alias("reason"), F.lit(None).alias("label"), F.lit(None).alias("event_ns"), F.lit(None).alias("a"), F.lit(None).alias("b"))))
    out = compile_graph(FlowGraph.from_modules([m]), src.mock_frames(spark, 2))
    assert out.fired().count() == 2 and out.triggers().count() == 0


def test_graph_validation():
    g = FlowGraph().add_node("a", S.Source()).add_node("b", S.Filter(None))
    with pytest.raises(ValueError, match="reached"):
        g.validate()
    g.add_edge("a", "b").add_edge("b", "a")
    with pytest.raises(ValueError, match="cycle"):
        g.validate()
    with pytest.raises(ValueError):
        g.add_node("a", S.Source())
    with pytest.raises(ValueError):
        g.add_edge("a", "z")
    with pytest.raises(ValueError, match="depends"):
        FlowGraph.from_modules([ColumnModule("x", lambda: None, ("y",))]).validate()
    with pytest.raises(ValueError, match="no entry"):
        FlowGraph().validate()


def test_drawing():
    g = FlowGraphBuilder().source().fanout(["a", "b"]).path("a", [scored("x", 1)]).path("b", [scored("y", 1)]).join(["a", "b"]).build()
    assert '"fanout" -> "a" [label="a"]' in g.to_dot() and g.to_ascii().count("(ref)") == 1


def test_dependency_groups():
    face, expression, pose = ColumnModule("face", None), ColumnModule("expression", None, ("face",)), ColumnModule("pose", None)
    assert [[m.name for m in x] for x in dependency_groups([face, expression, pose])] == [["face", "expression"], ["pose"]]
    with pytest.raises(ValueError):
        Path("p", [expression, face])


def test_python_modules(spark):
    events = []
    a = PythonModule("a", lambda frame: {"count": 2, "boxes": [[1, 2]], "ok": True} if frame["frame_id"] else None, init=lambda: "ready")
    b = PythonModule("b", lambda frame, deps: {"twice": deps["a"]["signals"]["count"] * 2} if deps else None, ("a",))
    out = compile_graph(FlowGraph.from_modules([a, b]), src.mock_frames(spark, 2)).results.orderBy("frame_id").collect()
    assert out[0].observations == [] and events == []
    assert out[1].observations[0].signals == {"count": 2.0, "ok": 1.0} and out[1].observations[0].data == '{"boxes": [[1, 2]]}'
    assert out[1].observations[1].signals == {"twice": 4.0}
    bad = PythonModule("bad", lambda frame: 1 / 0, on_error="drop")
    assert compile_graph(FlowGraph.from_modules([bad]), src.mock_frames(spark, 2)).results.count() == 2


def test_timeouts_and_workers(spark):
    import time

    slow = PythonModule("slow", lambda frame: time.sleep(0.5 * frame["frame_id"]) or {"x": 1}, timeout_sec=0.2, on_error="drop")
    out = compile_graph(FlowGraph.from_modules([slow]), src.mock_frames(spark, 2)).results.orderBy("frame_id").collect()
    assert [len(r.observations) for r in out] == [1, 0]
    w = worker_results(PythonModule("m", lambda frame: {"x": 1 / frame["frame_id"]}), flow(spark, 2)).orderBy("frame_id").collect()
    assert w[0].worker.error.startswith("ZeroDivisionError") and w[1].worker.observation.signals == {"x": 1.0} and w[1].worker.timing_ms >= 0


def test_aliases(spark):
    face = ColumnModule("face", lambda: fn.observation("face", signals=fn.signals(n=F.lit(1))))
    user = ColumnModule("user", lambda deps: fn.observation("user", signals=fn.signals(n=deps("face_detect")["signals"]["n"])), ("face_detect",), {"face_detect": "face"})
    out = compile_graph(FlowGraph.from_modules([face, user]), src.mock_frames(spark, 1)).results.first()
    assert out.observations[1].signals == {"n": 1.0}


def test_messages(spark):
    df = spark.createDataFrame([("OBS src=test source=a frame=1 t_ns=1000000",), ("not valid json",), ('{"source":"t","frame_id":3,"t_ns":5,"signals":{"v":0.8}}',), (None,), ("",)], "value string")
    got = [tuple(r) for r in src.parse_messages(df).select("frame_id", "source", "t_ns", "observation.signals").collect()]
    assert got == [(1, "test", 1000000, None), (None, None, 0, None), (3, "t", 5, {"v": 0.8}), (None, None, 0, None), (None, None, 0, None)]


def test_statistics(spark):
    t = spark.createDataFrame([("face", 10.0, False), ("face", 20.0, False), ("face", 30.0, True), ("pose", 15.0, False)], "component string, processing_ms double, is_slow boolean")
    face = aggregates.timing_stats(t).where("component = 'face'").first()
    assert (face["count"], face.avg_ms, face.slow_count) == (3, 20.0, 1)
    one = spark.range(1).select(fn.ema(F.array(F.lit(10.0), F.lit(20.0))).alias("e"), fn.p95(F.sequence(F.lit(1), F.lit(20)).cast("array<double>")).alias("p"), fn.p95(F.array().cast("array<double>")).alias("z")).first()
    assert one.e == pytest.approx(13.0) and one.p == 20.0 and one.z == 0.0


def test_empty_and_null_input(spark):
    none = spark.createDataFrame([], "stream_id string, frame_id long, t_ns long, seq long, value double")
    f = rows.to_flow(none)
    for df in (ordered.every_nth(f, 2), ordered.min_interval(f, 5), joins.join_paths(f, ["a", "b"]), joins.collect_batches(f, 2), joins.interval_join(f, f, 5), rows.triggers(f)):
        assert df.count() == 0
    null = rows.to_flow(spark.createDataFrame([(None, 1, None, None, None)], none.schema))
    assert ordered.every_nth(null, 1).count() == 1 and null.first().timestamp_ns == 0


def test_extract_with_fusion(spark):
    x = ColumnModule("x", lambda: fn.observation("x", signals=fn.signals(v=F.col("frame_id"))))
    f = FusionModule("f", ["x"], lambda s: decision(s["x"]["signals"]["v"] >= 1, "on", 0.7), 0.0)
    out = compile_graph(FlowGraph.from_pipeline([x], f), src.mock_frames(spark, 3)).results.orderBy("frame_id").collect()
    assert [[o.source for o in r.observations] for r in out] == [["x"]] * 3 and [len(r.results) for r in out] == [0, 1, 1]
    quiet = S.Extract((x,), f, run_fusion=False)
    assert compile_graph(FlowGraph().add_node("e", S.Source()).add_node("q", quiet).add_edge("e", "q"), src.mock_frames(spark, 1)).results.first().results == []


def test_payload_ends(spark):
    f = src.mock_frames(spark, 2).withColumn("data", F.lit("x"))
    g = FlowGraphBuilder().source().path("p", [scored("a", 0.1)]).filter(lambda: F.lit(True), "f").build()
    out = compile_graph(g, f, drop_after={"data": "p"}).outputs
    assert "data" in out["source"].columns and "data" not in out["p"].columns and "data" not in out["f"].columns


def test_compile_errors(spark):
    with pytest.raises(TypeError):
        compile_graph(FlowGraph().add_node("x", object()), src.mock_frames(spark, 1))

    def fails(df):
        raise ValueError("broken")

    with pytest.raises(NodeProcessingError, match="broken"):
        compile_graph(FlowGraph().add_node("x", S.CascadeFusion(fails)), src.mock_frames(spark, 1))


def test_plans(spark, tmp_path):
    """Filters and columns reach the scan; a frame join is one exchange; an interval join is no nested loop."""
    src.mock_frames(spark, 100).withColumn("wide", F.lit("x")).write.parquet(str(tmp_path / "f"))
    f = spark.read.parquet(str(tmp_path / "f"))
    g = FlowGraphBuilder().source().filter(lambda: F.col("t_ns") > 5).build()
    plan = compile_graph(g, f).results.select("frame_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(t_ns,5)" in plan and "wide" not in plan
    plan = joins.interval_join(f, f, 5).hint("shuffle")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    j = FlowGraphBuilder().source().fanout(["a", "b"]).path("a", [scored("x", 1)]).path("b", [scored("y", 1)]).join(["a", "b"]).build()
    plan = compile_graph(j, f).results._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan
    x = ColumnModule("x", lambda: fn.observation("x"))
    fused = FusionModule("f", ["x"], lambda s: decision(F.lit(True), "yes")).apply(x.apply(rows.to_flow(f)))
    plan = fused._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_nulls_in_ordered_operators(spark):
    data = [("s", 1, None, 1, 1.0, True), ("s", 2, 10, 2, None, True), ("s", 3, 20, 3, 2.0, None), ("s", 4, 200, 4, 4.0, True)]
    df = spark.createDataFrame(data, "stream_id string, frame_id long, t_ns long, seq long, v double, hot boolean")
    assert [r.ema for r in ordered.ema_by(df.where("frame_id > 1"), ("stream_id",), ("t_ns",), "v", 0.5).orderBy("t_ns").collect()] == [None, 2.0, 3.0]
    for bucket in (None, 50):
        got = {r.frame_id: tuple(r.fires) for r in ordered.cooldown(df, "hot", 100, bucket_ns=bucket).collect()}
        assert got == {1: (False, False), 2: (True, False), 3: (False, True), 4: (True, False)}
        assert {r.frame_id for r in ordered.min_interval(df, 100, "t_ns", bucket).collect()} == {2, 4}


@pytest.mark.parametrize("bucket", [7, 40, 10**6])
def test_long_streams_in_parts(spark, bucket):
    """One stream of all rows, cut in buckets, gives what one pass gives."""
    import random

    r = random.Random(bucket)
    t, data = -30, []
    for i in range(400):
        t += r.choice([0, 1, 2, 3, 30, 90])
        data.append(("s", i, t, i, r.random() < 0.4, r.choice([None, float(i)])))
    df = spark.createDataFrame(data, "stream_id string, frame_id long, t_ns long, seq long, hot boolean, v double").repartition(5)
    for wait in (0, 5, 40, 10**5):
        a, b = ({x.frame_id: tuple(x.fires) for x in ordered.cooldown(df, "hot", wait, bucket_ns=k).collect()} for k in (None, bucket))
        assert a == b
        a, b = ({x.frame_id for x in ordered.min_interval(df, wait, "t_ns", k).collect()} for k in (None, bucket))
        assert a == b
    a, b = ({x.frame_id: x.last for x in ordered.latest(df, F.col("v"), "last", bucket_ns=k).collect()} for k in (None, bucket))
    assert a == b
    plan = ordered.latest(df, F.col("v"), "last", bucket_ns=bucket)._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan


def test_p95_is_exact(spark):
    import random

    from tidewire.operators import aggregates as agg

    r = random.Random(4)
    data = [(k, v) for k, n in ((None, 1), ("a", 2), ("b", 20), ("c", 1000), ("d", 4321)) for v in [float(r.choice([1, 2, 3])) if k == "c" else r.gauss(0, 1e6) for _ in range(n)]] + [("e", None)]
    want = {}
    for k in {k for k, v in data if v is not None}:
        x = sorted(v for j, v in data if j == k and v is not None)
        want[k] = (len(x), x[min(int(len(x) * 0.95), len(x) - 1)])
    df = spark.createDataFrame(data, "k string, v double")
    assert {x.k: (x.n, x.p95) for x in agg.p95_by(df, ["k"], "v").collect()} == want
    every = sorted(v for _, v in data if v is not None)
    assert agg.p95_by(df, [], "v").first().p95 == every[int(len(every) * 0.95)]
    empty = agg.run_stats(spark.createDataFrame([], "frame_id long, ok boolean, processing_ms double, triggers long, observations long, start_ns long, end_ns long")).first()
    assert empty.frames_ingested == 0 and empty.p95_ms == 0.0 and empty.throughput_fps == 0.0


def test_shared_nodes_run_once(spark):
    """A Python node that two nodes read is kept; the graph's errors are those of its nodes unless it says otherwise."""
    calls = spark.sparkContext.accumulator(0)

    def work(frame):
        calls.add(1)
        return {"x": 1.0}

    g = FlowGraphBuilder().source().path("p", [PythonModule("m", work)]).branch(lambda: F.col("frame_id") % 2 == 0, "even", "odd").path("even", [scored("y", 1)]).path("odd", [scored("z", 1)]).build()
    c = compile_graph(g, src.mock_frames(spark, 20))
    assert c.results.count() == 20 and calls.value == 20 and len(c.shared) == 1
    c.release()
    f = FlowGraphBuilder().source().filter(lambda: F.lit(6) / F.col("frame_id") > 1).build()
    assert {r.frame_id for r in compile_graph(f, src.mock_frames(spark, 10), on_error="drop").results.collect()} == {1, 2, 3, 4, 5}
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        compile_graph(f, src.mock_frames(spark, 10)).results.collect()
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
