"""Command line: ``python -m lorekeep STATE [--once | --all | --step NAME | --stats | --runs | --rollback RUN] ...``."""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime

from lorekeep import schema


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lorekeep")
    p.add_argument("state", help="folder of the graph")
    what = p.add_argument_group("what to do")
    what.add_argument("--once", action="store_true", help="one run over the oldest raw memories")
    what.add_argument("--all", action="store_true", help="runs until nothing raw is left")
    what.add_argument("--step", choices=schema.STEPS, help="one step only; its batch stays raw")
    what.add_argument("--stats", action="store_true")
    what.add_argument("--runs", action="store_true")
    what.add_argument("--rollback", metavar="RUN")
    what.add_argument("--search", metavar="MEMORY", help="memories similar to the given one")
    p.add_argument("--batch", type=int, help=f"memories a run; {schema.BATCH}, with --all {schema.BATCH_ALL}")
    p.add_argument("--limit", type=int, default=8)
    p.add_argument("--force", action="store_true", help="roll back although later runs exist")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if a.all and a.step:
        p.error("--all with --step never ends: a single step leaves its batch raw")
    if a.batch is not None and a.batch < 1:
        p.error("--batch takes a number from 1")
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from lorekeep.operators import graph, pipeline, retrieval
    from lorekeep.sources.state import GraphState

    spark = spark or SparkSession.builder.appName("lorekeep").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    state, now = GraphState(spark, a.state), datetime.now(UTC).replace(tzinfo=None)
    steps = (a.step,) if a.step else schema.STEPS
    batch = a.batch or (schema.BATCH_ALL if a.all else schema.BATCH)
    run = lambda i=0: pipeline.Run(f"run-{now:%Y%m%dT%H%M%S}-{i}", now, batch=batch, steps=steps)
    if a.stats:
        graph.graph_stats(state.graph()).show(truncate=False)
    elif a.runs:
        graph.run_list(state.read("editor_run"), state.read("edit_action")).show(truncate=False)
    elif a.rollback:
        try:
            pipeline.roll_back(state, a.rollback, now, a.force)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
    elif a.search:
        g = state.graph()
        q = g.memory.where(F.col("id") == a.search).select("id", "embedding")
        r = retrieval.retrieve(g, q, now, max(1, min(20, a.limit)))
        r.join(g.memory.select("id", "content"), "id").orderBy("rank").select("rank", "score", "id", "content").show(20, truncate=False)
    elif a.all:
        for c in pipeline.run_all(state, run):
            print(c)
        if left := pipeline.raw_count(state):
            print(f"{left} memories stay raw: the last run changed none of them", file=sys.stderr)
            return 1
    else:
        print(pipeline.run_once(state, run()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
