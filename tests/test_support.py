"""Configuration, registry, traces, command line and streams."""

import io
import json

import pytest
from pyspark.sql import functions as F

from tidewire import ColumnModule, cli, config, registry, runner
from tidewire import functions as fn
from tidewire import observability as obs
from tidewire import streaming as st
from tidewire.modules import isolation
from tidewire.operators import joins, ordered, rows
from tidewire.sources import frames as src

YAML = """
version: "1.0"
globals: {observability: {enabled: true, level: minimal, sinks: [{type: memory}]}}
pipelines:
  main: {extractors: [wave], fusion: {name: alarm, cooldown: 1.0}}
"""


@pytest.fixture
def known():
    registry.register(ColumnModule("wave", lambda: fn.observation("wave", signals=fn.signals(v=F.col("frame_id")))))
    registry.register(ColumnModule("alarm", lambda deps: F.when(deps("wave")["signals"]["v"] > 2, fn.observation("alarm", trigger=fn.trigger("high"))), ("wave",)))
    yield
    registry.forget()


def test_variables():
    assert config.substitute({"a": ["${MISSING:-default}", "${A} ${B}!"]}, {"A": "x", "B": "y"}) == {"a": ["default", "x y!"]}
    with pytest.raises(KeyError):
        config.substitute("${MISSING}", {})


@pytest.mark.parametrize("text", ["pipelines: {}", "version: '2'\npipelines: {a: {extractors: [x]}}", "pipelines: {a: {extractors: []}}", "pipelines: {a: {extractors: [{name: x, isolation: venv}]}}", "pipelines: {a: {extractors: [x], observability: {sinks: [{type: file}]}}}"])
def test_bad_configurations(text):
    pytest.importorskip("yaml")
    with pytest.raises((ValueError, TypeError)):
        config.load(text)


def test_configured_pipeline(spark, known):
    pytest.importorskip("yaml")
    c = config.load(YAML)
    hub = c.pipelines["main"].observability.hub()
    result = runner.process(c.pipelines["main"].graph(), src.mock_frames(spark, 5), hub=hub)
    assert result.stats["triggers"] == 2
    assert [r.type for r in hub.sinks[0].records] == ["session_start", "session_end"]


def test_graph_files(spark, known):
    data = {"nodes": [{"name": "s", "type": "source"}, {"name": "b", "type": "branch", "condition": "frame_id > 2", "if_true": "hi", "if_false": "lo"}, {"name": "p", "type": "path", "modules": ["wave"]}], "edges": [{"source": "s", "target": "b"}, {"source": "b", "target": "p", "path": "hi"}]}
    from tidewire import compile_graph

    assert compile_graph(config.graph_from(data), src.mock_frames(spark, 5)).outputs["p"].count() == 2
    with pytest.raises(ValueError):
        config.graph_from({"nodes": [{"name": "s", "type": "sampler"}]})


def test_registry(known):
    assert registry.list_modules() == ["alarm", "wave"]
    with pytest.raises(ValueError):
        registry.get_module("gone")


def test_isolation():
    assert isolation("inline", "process") == "process" and isolation("PROCESS", override="thread") == "thread"
    with pytest.raises(NotImplementedError):
        isolation("container")
    with pytest.raises(ValueError):
        isolation("moon")


def test_sinks(tmp_path):
    m, out = obs.MemorySink(3), io.StringIO()
    hub = obs.Hub(obs.TraceLevel.NORMAL, [m, obs.ConsoleSink(out, color=False), obs.FileSink(str(tmp_path / "a" / "t.jsonl"), 2), obs.NullSink()])
    for i in range(5):
        hub.emit(obs.timing(i, "face", 10.0 * (i + 1)))
    hub.emit(obs.frame_extract(1, "face"))
    hub.emit(obs.frame_drop(list(range(7)), "timeout"))
    hub.close()
    assert len(m) == 3 and m.get_by_frame(4)[0].fields["processing_ms"] == 50.0
    assert out.getvalue() == "DROP 0, 1, 2, 3, 4 +2 more: timeout\n"
    lines = [json.loads(x) for x in (tmp_path / "a" / "t.jsonl").read_text().splitlines()]
    assert len(lines) == 6 and "min_level" not in lines[0]


def test_trace_table(spark, tmp_path):
    t = obs.trace_table(spark, [obs.timing(1, "a", 60.0), obs.sync_delay(2, 0, 5_000_000, ["x"]), obs.frame_drop([1, 2], "slow"), obs.session_start("s")])
    assert sorted(r.line for r in obs.console_lines(t).collect()) == ["DROP 1, 2: slow", "SLOW a frame 1: 60.0 ms", "SYNC frame 2: 5.0 ms, waiting for x"]
    obs.write_trace(t, str(tmp_path / "trace"))
    assert spark.read.json(str(tmp_path / "trace")).count() == 4
    assert obs.admitted(t, obs.TraceLevel.MINIMAL).count() == 3


def test_command_line(tmp_path, capsys, known):
    pytest.importorskip("yaml")
    f = tmp_path / "c.yaml"
    f.write_text(YAML)
    assert cli.main(["validate", str(f), "--check-plugins"]) == 0 and cli.main(["run", "-c", str(f), "--dry-run"]) == 0
    assert cli.main(["version"]) == 0 and cli.main(["plugins", "list"]) == 0 and cli.main(["run", "-c", str(f), "--pipeline", "x"]) == 1
    assert cli.main(["debug", "--dot"]) == 0
    assert "digraph" in capsys.readouterr().out


def stream_of(spark, path, n=40):
    data = [("s" + str(i % 2), i, (1000 + i * 37 % 1000) * 1_000_000, i, "ab"[i % 3 % 2], float(i)) for i in range(n)]
    df = spark.createDataFrame(data, "stream_id string, frame_id long, t_ns long, seq long, p string, v double")
    df.coalesce(1).write.parquet(path)
    return df, spark.readStream.schema(df.schema).parquet(path)


def drained(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams_agree_with_batch(spark, tmp_path):
    batch, live = stream_of(spark, str(tmp_path / "in"))
    same = lambda a, b: sorted(r.frame_id for r in a.collect()) == sorted(r.frame_id for r in b.collect())
    assert same(drained(st.every_nth(live, 3), tmp_path, "nth"), ordered.every_nth(batch, 3))
    assert same(drained(st.min_interval(live, 90_000_000), tmp_path, "gap"), ordered.min_interval(batch, 90_000_000, "t_ns"))
    hot = lambda d: d.withColumn("hot", F.col("v") > 10)
    assert same(drained(st.cooldown(hot(live), "hot", 200_000_000), tmp_path, "cool"), ordered.cooldown(hot(batch), "hot", 200_000_000).where("fires.fires"))
    flow = lambda d: ColumnModule("x", lambda: fn.observation("x", signals=fn.signals(v=F.col("v")), metadata=F.create_map(F.lit("a"), F.lit("b")))).apply(rows.to_flow(d))
    got = drained(st.collect_batches(flow(live), 4), tmp_path, "coll")
    want = joins.collect_batches(flow(batch), 4)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 10


def test_stream_alignment_across_batches(spark, tmp_path):
    """A frame's messages come in different files, around any window's edge; it is released whole."""
    schema = "stream_id string, frame_id long, source string, t_ns long, seq long"
    files = [[("s", 1, "a", 90, 0)], [("s", 1, "b", 110, 1), ("s", 2, "a", 150, 2)], [("s", 2, "b", 260, 3)], [("s", 3, "a", 600, 4)]]
    for i, data in enumerate(files):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = st.run(st.align(live, 100), lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "cp"), available_now=True)
        q.awaitTermination(120)
    got = {r.frame_id: (r.first_ns, r.last_ns, r.sources) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (90, 110, ["a", "b"]), 2: (150, 260, ["a", "b"])}


def test_stream_join_and_windows(spark, tmp_path):
    batch, live = stream_of(spark, str(tmp_path / "in"))
    a, b = "p = 'a'", "p = 'b'"
    got = drained(st.interval_join(live.where(a), live.where(b), 50_000_000), tmp_path, "ij").collect()
    want = joins.interval_join(batch.where(a), batch.where(b), 50_000_000).collect()
    assert sorted((r.frame_id, r.frame_id_right) for r in got) == sorted((r.frame_id, r.frame_id_right) for r in want)
    assert drained(st.tumbling(live, "100 milliseconds", "0 seconds"), tmp_path, "tum").count() > 0


def test_stream_of_a_graph(spark, tmp_path):
    _, live = stream_of(spark, str(tmp_path / "in"))
    found = []
    m = ColumnModule("m", lambda: F.when(F.col("v") > 35, fn.observation("m", trigger=fn.trigger("high", F.col("v")))))
    from tidewire import FlowGraph

    q = runner.stream(FlowGraph.from_modules([m]), live, lambda df, n: found.extend(df.collect()), str(tmp_path / "cp"), available_now=True)
    q.awaitTermination(120)
    assert len(found) == 4


def test_video_decoder(spark, tmp_path):
    (tmp_path / "v.bin").write_bytes(b"abcdef")
    decode = lambda content: ((i * 100.0, bytes([c]), 1, 1) for i, c in enumerate(content))
    got = src.video_files(spark, str(tmp_path / "v.bin"), fps=10, decode=decode).orderBy("frame_id").collect()
    assert [(r.frame_id, r.t_ns, bytes(r.data)) for r in got] == [(0, 200_000_000, b"c"), (1, 500_000_000, b"f")]
    result = runner.process_video(spark, str(tmp_path / "v.bin"), [ColumnModule("m", lambda: fn.observation("m", trigger=fn.trigger("r")))], decode=decode)
    assert result.stats["triggers"] == 2
    images = src.image_files(spark, str(tmp_path / "v.bin"))
    assert images.count() == 1 and rows.to_flow(images).first().data == b"abcdef"
