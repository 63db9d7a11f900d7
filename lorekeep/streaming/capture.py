"""Event-driven behaviour as Structured Streaming: capture after every turn, recall, windows, similarity gates.

Sources deliver at least once and repeat whole transcripts; the keyed upserts make the state exactly-once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text
from lorekeep.operators import retrieval
from lorekeep.operators.writer import write_facts
from lorekeep.runtime import cut
from lorekeep.sources.state import GraphState


def capture_batch(state: GraphState, facts: DataFrame) -> dict[str, int]:
    """Take one micro-batch of facts (sessionid, pos, content, kind, confidence, salience, observed, embedding) into the graph.

    Facts whose key is in their session already, or that restate an active memory of it, change nothing, so a repeated
    delivery is harmless.  New ids are derived from the key.
    """
    f = cut(facts.where(text.worth_keeping(F.col("content"), F.col("salience"))).withColumn("writekey", text.write_key(F.col("sessionid"), F.col("content"))))
    f = f.dropDuplicates(["writekey"]).withColumn("fact_id", F.col("writekey"))
    memory = state.read("memory")
    outcome = cut(write_facts(f, memory))
    new = f.join(outcome.where("outcome = 'written'").select("fact_id"), "fact_id", "left_semi")
    rows = new.select(
        F.concat(F.lit("mem-"), F.substring("writekey", 1, 32)).alias("id"), "sessionid", "writekey", "content", "kind", F.col("observed").alias("timestamp"), F.col("observed").alias("validfrom"),
        text.unit_interval(F.col("confidence")).alias("confidence"), text.unit_interval(F.col("salience")).alias("salience"), F.lit("raw").alias("status"), F.col("embedding").cast("array<float>").alias("embedding"),
    )
    counts = {r.outcome: r["count"] for r in outcome.groupBy("outcome").count().collect()}
    if counts.get("written"):
        full = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None).cast(t)).alias(c) for c, t in memory.dtypes])
        state.commit({}, append={"memory": full})
    return counts


def capture_stream(stream: DataFrame, state: GraphState, checkpoint: str, trigger: dict | None = None):
    """Run ``capture_batch`` for every micro-batch of a stream of facts."""
    return (
        stream.writeStream.foreachBatch(lambda df, _: capture_batch(state, df) and None).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def recall_stream(prompts: DataFrame, state: GraphState, as_of, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Answer each micro-batch of prompts (id, embedding) from the latest snapshot."""

    def answer(df: DataFrame, epoch: int) -> None:
        g = state.graph()
        q = df.select("id", "embedding")
        sink(retrieval.context_text(g, retrieval.retrieve(g, q, as_of, retrieval.LIMIT), as_of), epoch)

    return prompts.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def similarity_gate(stream: DataFrame, least: float = 0.95, keep: int = 1000, ttl_ms: int = 86_400_000) -> DataFrame:
    """(sessionid, fact_id, novel): per session, whether a fact is unlike all earlier ones.

    State is the session's vectors, the latest ``keep``, dropped ``ttl_ms`` after the session's last fact.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        vecs = [np.array(v) for v in (state.get[0] if state.exists else [])]
        out = []
        for pdf in batches:
            for r in pdf.sort_values("fact_id").itertuples(index=False):
                v = np.asarray(r.embedding, dtype=np.float64)
                n = np.linalg.norm(v)
                u = v / n if n else v
                novel = not any(len(w) == len(u) and float(w @ u) >= least for w in vecs)
                if novel:
                    vecs.append(u)
                out.append((key[0], r.fact_id, novel))
        state.update(([w.tolist() for w in vecs[-keep:]],))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=["sessionid", "fact_id", "novel"])

    return stream.groupBy("sessionid").applyInPandasWithState(
        update, "sessionid string, fact_id string, novel boolean", "vecs array<array<double>>", "append", "ProcessingTimeTimeout"
    )


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes", at: str = "ts", by: str = "event_type") -> DataFrame:
    """Counts and sums per event-time window and type; rows later than ``late`` are dropped.  An addition for event tables."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return events.withWatermark(at, late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", at: str = "ts", by: str = "user_id") -> DataFrame:
    """Activity sessions: runs of events with less than ``gap`` between them."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
