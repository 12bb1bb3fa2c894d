"""Streams of edited documents and of events: findings, windows, sessions, and what an edit made dirty."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from proofmill.plans.registry import Rule, findings


def streamed_findings(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Findings of a stream of documents (doc_id, text, lang): one projection without state, as for a table."""
    return findings(docs, rules)


def event_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) by tumbling or, with ``slide``, sliding windows of event time; rows later than ``late`` are dropped."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return e.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): a user's events no more than ``gap`` apart."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def new_chunks(docs: DataFrame, late: str = "1 day") -> DataFrame:
    """(ts, doc_id, hash): chunks of a stream of documents (ts, doc_id, text) not met within the watermark before."""
    parts = docs.withWatermark("ts", late) if docs.isStreaming else docs
    hashed = parts.where("text is not null").select("ts", "doc_id", F.explode(F.split("text", "\n\n")).alias("c")).select("ts", "doc_id", F.xxhash64("c").alias("hash"))
    return hashed.dropDuplicatesWithinWatermark(["doc_id", "hash"]) if docs.isStreaming else hashed.dropDuplicates(["doc_id", "hash"])


def _changed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    old = list(state.get[0]) if state.exists else None
    rows = []
    for b in batches:
        for version, hashes in sorted(zip(b["version"], b["hashes"]), key=lambda x: x[0]):
            hashes = [int(h) for h in hashes]
            dirty = range(len(hashes)) if old is None or len(old) != len(hashes) else [k for k, (x, y) in enumerate(zip(old, hashes)) if x != y]
            rows += [(key[0], int(version), k) for k in dirty]
            old = hashes
    if old is not None:
        state.update((old,))
    yield pd.DataFrame(rows, columns=["doc_id", "version", "chunk_no"])


def dirty_chunks_of_edits(edits: DataFrame) -> DataFrame:
    """(doc_id, version, chunk_no): chunks to be looked at again after each version in a stream (doc_id, version, text).

    The state holds the hashes of every document's last version. Where the numbers of chunks
    differ all are dirty, as in ``operators.findings.dirty_chunks``. Within a micro-batch versions come in order.
    """
    h = edits.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("version").cast("bigint").alias("version"), F.transform(F.split("text", "\n\n"), lambda c: F.xxhash64(c)).alias("hashes"))
    return h.groupBy("doc_id").applyInPandasWithState(_changed, "doc_id bigint, version bigint, chunk_no int", "hashes array<bigint>", "append", GroupStateTimeout.NoTimeout)


def upsert_findings(docs: DataFrame, path: str, checkpoint: str, rules: list[Rule] | None = None) -> StreamingQuery:
    """Starts a query that keeps the findings of every document's newest version under ``path``, a folder a batch.

    A batch replayed after a failure writes the same folder again. ``latest_findings`` reads the newest by document.
    """

    def write(batch: DataFrame, no: int) -> None:
        newest = batch.groupBy("doc_id").agg(F.max_by(F.struct("text", "lang"), "version").alias("d"), F.max("version").alias("version"))
        # documents without findings keep a row, so that they replace their older ones
        found = findings(newest.select("doc_id", "d.*"), rules)
        newest.select("doc_id", "version").join(found, "doc_id", "left").write.mode("overwrite").parquet(f"{path}/batch={no}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def latest_findings(stored: DataFrame) -> DataFrame:
    """Of stored findings (doc_id, version, rule_id, severity, n) those of each document's newest version."""
    top = stored.groupBy("doc_id").agg(F.max("version").alias("version"))
    return stored.join(top, ["doc_id", "version"]).where("rule_id is not null").select("doc_id", "rule_id", "severity", "n")
