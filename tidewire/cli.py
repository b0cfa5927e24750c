"""Command line: run and check configurations, list modules, try a pipeline on generated frames."""

from __future__ import annotations

import argparse
import sys


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tidewire").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("tidewire")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="run a pipeline of a configuration on a table or folder of frames")
    run.add_argument("-c", "--config", required=True)
    run.add_argument("--pipeline")
    run.add_argument("--input", help="Parquet frames (stream_id, frame_id, t_ns, seq, ...)")
    run.add_argument("--output", help="folder for the triggers")
    run.add_argument("--dry-run", action="store_true")
    check = sub.add_parser("validate", help="check a configuration")
    check.add_argument("config")
    check.add_argument("--check-plugins", action="store_true")
    sub.add_parser("plugins", help="list known modules").add_argument("action", nargs="?", default="list")
    sub.add_parser("version")
    debug = sub.add_parser("debug", help="run a sample pipeline on generated frames")
    debug.add_argument("-n", "--frames", type=int, default=10)
    debug.add_argument("-s", "--sample", type=int, default=1)
    debug.add_argument("-d", "--dot", action="store_true", help="print the graph only")
    a = p.parse_args(argv)
    try:
        return {"run": _run, "validate": _validate, "plugins": _plugins, "version": _version, "debug": _debug}[a.command](a)
    except (ValueError, KeyError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _run(a) -> int:
    from . import config, runner

    c = config.load_file(a.config)
    name = a.pipeline or next(iter(c.pipelines))
    if name not in c.pipelines:
        raise ValueError(f"no pipeline {name!r}")
    pipeline = c.pipelines[name]
    print(f"pipeline {name}: {', '.join(e.name for e in pipeline.extractors)}")
    if a.dry_run:
        return 0
    if not a.input:
        raise ValueError("--input is needed to run")
    hub = pipeline.observability.hub()
    result = runner.process(pipeline.graph(), _session().read.parquet(a.input), hub=hub)
    hub.close()
    if a.output:
        result.triggers.write.mode("overwrite").parquet(a.output)
    print(runner.summary(result))
    return 0


def _validate(a) -> int:
    from . import config, registry

    c = config.load_file(a.config)
    if a.check_plugins:
        for p in c.pipelines.values():
            for n in [e.name for e in p.extractors] + ([p.fusion.name] if p.fusion else []):
                registry.get_module(n)
    print(f"valid: {', '.join(c.pipelines)}")
    return 0


def _plugins(_) -> int:
    from . import registry

    for kind in registry.GROUPS:
        print(f"{kind}: {', '.join(registry.list_modules(kind)) or 'none'}")
    return 0


def _version(_) -> int:
    from . import __version__

    print(__version__)
    return 0


def _debug(a) -> int:
    from pyspark.sql import functions as F

    from . import functions as fn
    from .modules import ColumnModule
    from .plans.builder import FlowGraphBuilder
    from .plans.compiler import compile_graph
    from .sources.frames import mock_frames

    wave = ColumnModule("wave", lambda: fn.observation("wave", signals=fn.signals(value=F.abs(F.sin(F.col("frame_id"))))))
    alarm = ColumnModule("alarm", lambda deps: F.when(deps("wave")["signals"]["value"] > 0.3, fn.observation("alarm", trigger=fn.trigger("high", deps("wave")["signals"]["value"]))), ("wave",))
    g = FlowGraphBuilder().source().sample(a.sample).path("main", [wave, alarm]).build()
    print(g.to_dot() if a.dot else g.to_ascii())
    if not a.dot:
        compile_graph(g, mock_frames(_session(), a.frames)).triggers().show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
