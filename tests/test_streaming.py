"""Streams fed file by file must give what the batch twins give on the rows that were not late."""

import datetime as dt
import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from clauselake.operators import lexical, triage
from clauselake.sources import corpus
from clauselake.streaming import jobs

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
EVENTS = "event_id long, user_id long, ts timestamp, elapsed_ms double, is_error boolean"
BATCHES = [
    [(1, 1, 0, 100.0, False), (2, 1, 60, 9000.0, False), (3, 2, 200, 50.0, True)],
    [(4, 1, 1800, 10.0, False), (4, 1, 1800, 10.0, False), (5, 2, 1900, 10.0, False)],
    [(6, 1, 100, 99999.0, True), (7, 2, 90000, 1.0, False)],
]


def run(spark, folder, make):
    """Feed the batches one file at a time; returns sink rows and all source rows."""
    for rows in BATCHES:
        timed = [(e, u, T0 + dt.timedelta(seconds=s), ms, err) for e, u, s, ms, err in rows]
        spark.createDataFrame(timed, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = jobs.read_files(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, "*.parquet", per_batch=1)
        jobs.run_to_end(make(stream), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out"), spark.read.parquet(f"{folder}/in")


def test_alert_windows_drop_late_rows(spark, tmp_path):
    out, rows = run(spark, tmp_path, jobs.sla_stream)
    on_time = rows.filter("event_id not in (6, 7)")
    want = sorted(map(tuple, jobs.sla_windows(on_time).collect()))
    assert sorted(map(tuple, out.collect())) == want
    first = want[0]
    assert first[1:] == (3, 1, 0.333333, 9000.0, True, True)


def test_repeats_are_dropped(spark, tmp_path):
    out, _ = run(spark, tmp_path, lambda s: jobs.drop_repeats(s, "event_id").select("event_id"))
    assert sorted(r.event_id for r in out.collect()) == [1, 2, 3, 4, 5, 7]


def test_sessions(spark, tmp_path):
    out, rows = run(spark, tmp_path, lambda s: jobs.session_stream(s, "user_id"))
    # the late event still joins its session, which ends six hours after it
    want = [tuple(r) for r in jobs.sessions(rows, "user_id").collect() if r.session_start < dt.datetime(2024, 1, 2)]
    got = [tuple(r) for r in out.select("user_id", "session_start", "session_end", "n", "n_errors").collect()]
    assert sorted(got) == sorted(want) and len(got) == 2


def test_batch_sessions_match_session_window(spark):
    rows = spark.range(3000).select(
        (F.col("id") % 7).alias("user_id"), F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(2_000_000))).alias("ts"), (F.col("id") % 5 == 0).alias("is_error")
    )
    for gap in (20, 600, 6 * 3600):
        native = rows.groupBy("user_id", F.session_window("ts", f"{gap} seconds").alias("s")).agg(F.count("*").alias("n"), F.count_if("is_error").alias("e"))
        want = sorted((r.user_id, r.s.start, r.s.end, r.n, r.e) for r in native.collect())
        assert sorted(map(tuple, jobs.sessions(rows, "user_id", gap_seconds=gap).collect())) == want


def test_one_busy_user_over_many_ranges(spark):
    rng = random.Random(3)
    at, rows = 0, []
    for i in range(800):  # some gaps end a session, some sessions are longer than several ranges
        at += rng.choice([1, 20, 59, 60, 61, 90, 4000])
        rows.append((i, 1 if i % 9 else 2, T0 + dt.timedelta(seconds=at), 1.0, rng.random() < 0.3))
    events = spark.createDataFrame(rows, EVENTS)
    for gap in (30, 100, 3600):
        native = events.groupBy("user_id", F.session_window("ts", f"{gap} seconds").alias("s")).agg(F.count("*").alias("n"), F.count_if("is_error").alias("e"))
        want = sorted(map(tuple, native.select("user_id", "s.start", "s.end", "n", "e").collect()))
        for ranges in (1, 3, 50, 1 << 14):
            got = jobs.sessions(events, "user_id", gap_seconds=gap, range_minutes=ranges)
            assert sorted(map(tuple, got.collect())) == want



def test_history_state_equals_batch(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 else "assistant", "" if t == 4 else f"{c}-{t}") for c in (1, 2) for t in range(20)]
    schema = "conv_id long, turn long, role string, text string"
    for lo in (0, 7, 14):
        part = [r for r in rows if lo <= r[1] < lo + 7]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.read_files(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, "*.parquet")
        jobs.run_to_end(jobs.history_stream(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    want = sorted(map(tuple, triage.history(spark.createDataFrame(rows, schema)).collect()))
    assert got == want


def test_ingest_skips_seen_documents_and_replaces_revised_ones(spark, tmp_path):
    sink, taken = str(tmp_path / "out"), []
    batches = [
        [(1, "a b\nc\nd"), (2, "same text")],
        [(1, "a b"), (2, "same text"), (3, "new words")],
        [(2, "same text"), (3, "")],
    ]

    def chunker(batch):
        taken.append(sorted(r.doc_id for r in batch.collect()))
        lines = batch.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text")).filter("text <> ''")
        return lines.select("doc_id", F.concat_ws("#", "doc_id", "n").alias("chunk_id"), "text")

    for rows in batches:
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.read_files(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, "*.parquet")
        jobs.ingest(stream, chunker, sink, str(tmp_path / "state"), postings=lambda c: lexical.term_counts(c, ["doc_id", "chunk_id"], "text"))
        now = {(r.chunk_id, r.text) for r in corpus.read_revisions(spark, sink).collect()}
        if len(taken) == 2:
            assert now == {("1#0", "a b"), ("2#0", "same text"), ("3#0", "new words")}
            index = jobs.ingested_index(spark, sink)
            hits = lexical.bm25_top(index, spark.createDataFrame([(1, "new c d words")], "query_id int, text string"), 5).collect()
            assert [h.chunk_id for h in hits] == ["3#0"] and index.corpus.first().n_docs == 3
    assert taken == [[1, 2], [1, 3], [3]]
    assert now == {("1#0", "a b"), ("2#0", "same text")}


def test_stream_of_a_table_in_many_files(spark, tmp_path):
    """A folder of more files than a batch takes by default, a conversation's turns dealt over them."""
    rows = [(c, t, "user" if t % 2 else "assistant", f"c{c} t{t}") for c in range(3) for t in range(30)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(80, "conv_id", "turn").write.option(
        "maxRecordsPerFile", 1).parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in entry.queries()["stream_history"](spark, str(tmp_path)).collect()}
    want = set()
    for c in range(3):
        for t in range(1, 30, 2):
            lines = [f"{'用户' if p % 2 else '助手'}：c{c} t{p}" for p in range(max(0, t - triage.HISTORY_TURNS), t)]
            want.add((c, t, len(lines), "\n".join(lines)))
    assert got == want
