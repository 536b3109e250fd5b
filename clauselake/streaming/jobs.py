"""Streaming twins of ingest, monitoring and conversation state.

Late rows are dropped ten minutes behind the newest event time.  Sinks and checkpoints live in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from clauselake.operators.lexical import LexicalIndex, lexical_index
from clauselake.operators.triage import HISTORY_CHARS, HISTORY_TURNS
from clauselake.sources import corpus

# fixed values: lateness, alert window and limits
LATENESS = "10 minutes"
WINDOW = "5 minutes"
SLOW_MS = 5000
ERROR_SHARE = 0.03
ACCURACY = 10_000

RANGE_MINUTES = 1 << 14
"""Minutes of a key that one task orders."""


def read_files(spark: SparkSession, folder: str, schema: StructType, glob: str, per_batch: int = 64) -> DataFrame:
    """Stream of the parquet files of a folder, new files only."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).parquet(folder)
    )


def run_to_end(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Write all available rows to a parquet folder and stop."""
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def ingest(
    documents: DataFrame, chunker: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, text_col: str = "text",
    postings: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Chunk the documents of a stream that are new, and those whose text is another one than before.

    A document that was seen with the same text is passed over; a revised one replaces all its chunks.  A replayed
    batch replaces its own files.  With `postings`, the words of the new chunks are stored beside them, so that an index
    grows with the batches.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marked = batch.withColumn("_digest", F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
        newest = marked.dropDuplicates(["doc_id"])
        seen = corpus.ingested(spark, sink, before=batch_id)
        if seen is not None:
            newest = newest.join(seen.select("doc_id", F.col("digest").alias("_digest")), ["doc_id", "_digest"], "left_anti")
        chunks = chunker(newest.drop("_digest"))
        corpus.write_revisions(chunks, newest.select("doc_id", F.col("_digest").alias("digest")), sink, batch_id)
        if postings is not None:
            stored = spark.read.parquet(f"{sink}/chunks/batch_id={batch_id}")
            postings(stored).write.mode("overwrite").parquet(f"{sink}/postings/batch_id={batch_id}")

    query = (
        documents.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def ingested_index(spark: SparkSession, sink: str, id_col: str = "chunk_id") -> LexicalIndex:
    """Index over the current chunks of an ingest that stores postings; statistics are those of the current chunks."""
    latest = corpus.ingested(spark, sink).select("doc_id", "batch_id")
    postings = spark.read.parquet(f"{sink}/postings").join(latest, ["doc_id", "batch_id"], "left_semi").drop("doc_id", "batch_id")
    return lexical_index(corpus.read_revisions(spark, sink), postings, id_col)


def sla_windows(events: DataFrame, ts: str = "ts", slide: str | None = None) -> DataFrame:
    """Per window: requests, errors, error share, 95th percentile of elapsed_ms and the two alerts."""
    window = F.window(ts, WINDOW, slide) if slide else F.window(ts, WINDOW)
    share = F.count_if("is_error") / F.count("*")
    p95 = F.percentile_approx("elapsed_ms", 0.95, ACCURACY)
    return events.groupBy(window.alias("w")).agg(
        F.count("*").alias("n"), F.count_if("is_error").alias("n_errors"), F.round(share, 6).alias("error_share"),
        p95.alias("p95_ms"), (p95 > SLOW_MS).alias("slow_alert"), (share > ERROR_SHARE).alias("error_alert"),
    ).select(F.col("w.start").alias("window_start"), "n", "n_errors", "error_share", "p95_ms", "slow_alert", "error_alert")


def sla_stream(events: DataFrame, ts: str = "ts", slide: str | None = None) -> DataFrame:
    """The same over a stream; a window is final once the newest event is past its end by the lateness."""
    return sla_windows(events.withWatermark(ts, LATENESS), ts, slide)


def drop_repeats(rows: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """First arrival per key while its time is inside the watermark."""
    return rows.withWatermark(ts, LATENESS).dropDuplicatesWithinWatermark([key])


def sessions(
    events: DataFrame, key: str, ts: str = "ts", gap_seconds: int = 6 * 3600, range_minutes: int = RANGE_MINUTES
) -> DataFrame:
    """Per key and burst of activity: start, end, events and errors of a finished table.

    Events of one minute (or of a shorter gap) are always in one session, so they are summed up before the
    shuffle and a busy key brings its minutes, not its events, to the window.  A task orders one time range of a key; only
    the first and last session of each range, which others may continue, meet per key.
    """
    micros, gap = 1_000_000, gap_seconds * 1_000_000
    width = min(60, gap_seconds) * micros
    at = F.unix_micros(ts)
    minutes = events.groupBy(key, F.floor(at / width).alias("_m")).agg(
        F.min(at).alias("a"), F.max(at).alias("b"), F.count("*").alias("n"), F.count_if("is_error").alias("n_errors")
    )
    sums = [F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n"), F.sum("n_errors").alias("n_errors")]

    def joined(spans: DataFrame, *part: str) -> DataFrame:
        """Spans of a part that follow each other within the gap become one; _s numbers what comes out."""
        order = Window.partitionBy(*part).orderBy("a")
        opens = F.when(F.col("a") - F.lag("b").over(order) <= gap, 0).otherwise(1)
        numbered = spans.withColumn("_o", opens).withColumn(
            "_s", F.sum("_o").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return numbered.groupBy(*part, "_s").agg(*sums)

    parts = joined(minutes.withColumn("_r", F.floor(F.col("_m") / range_minutes)), key, "_r").withColumn(
        "_inner", (F.col("_s") > 1) & (F.col("_s") < F.max("_s").over(Window.partitionBy(key, "_r"))))
    borders = joined(parts.filter(~F.col("_inner")).select(key, "a", "b", "n", "n_errors"), key)
    whole = parts.filter("_inner").select(key, "a", "b", "n", "n_errors").unionByName(borders.drop("_s"))
    return whole.select(
        key, F.timestamp_micros("a").alias("session_start"), F.timestamp_micros(F.col("b") + gap).alias("session_end"),
        "n", "n_errors")


def session_stream(events: DataFrame, key: str, ts: str = "ts", gap: str = "6 hours") -> DataFrame:
    """Sessions over a stream."""
    return events.withWatermark(ts, LATENESS).groupBy(key, F.session_window(ts, gap).alias("s")).agg(
        F.count("*").alias("n"), F.count_if("is_error").alias("n_errors")
    ).select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n", "n_errors")


def history_stream(turns: DataFrame, labels: tuple[str, str] = ("用户", "助手")) -> DataFrame:
    """(conv_id, turn, n_prior, history) at each user turn as messages arrive; state is the last six lines.

    Rows of one trigger are taken in turn order; a conversation keeps at most six short lines as state.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lines = list(state.get[0]) if state.exists else []
        parts = list(batches)
        rows = pd.concat(parts).sort_values("turn", kind="stable") if parts else pd.DataFrame()
        out = []
        for turn, role, text in rows[["turn", "role", "text"]].itertuples(index=False) if len(rows) else ():
            if role == "user":
                out.append((key[0], turn, len(lines), "\n".join(lines)))
            lines = [*lines, f"{labels[0] if role == 'user' else labels[1]}：{text[:HISTORY_CHARS]}"][-HISTORY_TURNS:]
        state.update((lines,))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "n_prior", "history"])

    finished = turns.filter(F.col("role").isin("user", "assistant") & (F.coalesce("text", F.lit("")) != ""))
    return finished.groupBy("conv_id").applyInPandasWithState(
        update, "conv_id long, turn long, n_prior int, history string", "lines array<string>", "append",
        GroupStateTimeout.NoTimeout,
    )
