"""Streams give what the same rows give as a table."""

from pyspark.sql import functions as F

from proofmill.operators import findings as fo
from proofmill.plans.registry import findings
from proofmill.streaming import documents as sd

SCHEMA = "version bigint, doc_id bigint, text string, lang string, ts timestamp"


def source(spark, tmp_path, *batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame([(*r, None) for r in rows], SCHEMA).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("version") * 60)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b={k}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")


def drain(spark, df, mode, name):
    df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_findings_of_a_stream(spark, tmp_path):
    rows = [(1, i, "a  b... \"q\" -- c", "en") for i in range(3)] + [(1, 9, None, "en")]
    s = source(spark, tmp_path, rows[:2], rows[2:])
    got = drain(spark, sd.streamed_findings(s.select("doc_id", "text", "lang")), "append", "t_found")
    want = findings(spark.createDataFrame([r[1:] for r in rows], "doc_id bigint, text string, lang string"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count()


def test_dirty_chunks_of_a_stream(spark, tmp_path):
    versions = [["x\n\ny", "x\n\nz", "x\n\nz\n\nw"], ["p", "p", "q"]]
    rows = [(v, d, t, "en") for d, ts in enumerate(versions) for v, t in enumerate(ts)]
    s = source(spark, tmp_path, [r for r in rows if r[0] < 2], [r for r in rows if r[0] == 2])
    got = {tuple(r) for r in drain(spark, sd.dirty_chunks_of_edits(s), "append", "t_dirty").collect()}
    frame = lambda v: fo.chunks(spark.createDataFrame([(d, ts[v]) for d, ts in enumerate(versions)], "doc_id bigint, text string"))
    want = {(r.doc_id, 0, r.chunk_no) for r in frame(0).collect()} | {(r.doc_id, v, r.chunk_no) for v in (1, 2) for r in fo.dirty_chunks(frame(v - 1), frame(v)).collect()}
    assert got == want


def test_newest_findings(spark, tmp_path):
    s = source(spark, tmp_path, [(1, 1, "a  b", "en"), (1, 2, "c  d", "en")], [(2, 1, "fine here", "en")])
    sd.upsert_findings(s.select("doc_id", "version", "text", "lang"), f"{tmp_path}/out", f"{tmp_path}/at").processAllAvailable()
    for q in spark.streams.active:
        q.stop()
    got = sd.latest_findings(spark.read.parquet(f"{tmp_path}/out"))
    assert {r.doc_id for r in got.where("rule_id = 'TYPO-018'").collect()} == {2}


def test_windows_sessions_and_new_chunks(spark, tmp_path):
    rows = [(v, v % 2, "same\n\nnew %d" % v, "en") for v in (0, 1, 2, 50, 200, 400, 401)]
    s = source(spark, tmp_path, rows[:4], rows[4:])
    events = lambda x: x.select("ts", F.col("lang").alias("event_type"), F.lit(1.0).alias("value"), F.col("doc_id").alias("user_id"))
    table = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    closed = drain(spark, sd.event_counts(events(s)), "append", "t_windows").collect()
    every = {tuple(r) for r in sd.event_counts(events(table)).collect()}
    assert closed and {tuple(r) for r in closed} < every
    sliding = sd.event_counts(events(table), slide="30 minutes")
    assert sliding.agg(F.sum("n")).first()[0] == 2 * len(rows)
    seen = {tuple(r) for r in drain(spark, sd.sessions(events(s)), "append", "t_sessions").collect()}
    assert seen and seen < {tuple(r) for r in sd.sessions(events(table)).collect()}
    fresh = drain(spark, sd.new_chunks(s.select("ts", "doc_id", "text")), "append", "t_chunks")
    assert fresh.count() == len(rows) + 2 == sd.new_chunks(table).count()
