"""Sources, ids and streams over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake import profiles as P
from clauselake import schemas
from clauselake.functions.text import strip
from clauselake.operators import chunking
from clauselake.plans import dialogue, structure
from clauselake.plans.registry import ORACLES, query
from clauselake.plans.sql import BLANK
from clauselake.sources import corpus
from clauselake.sources.tables import read_documents, read_table, spread
from clauselake.streaming import jobs


@query("corpus_scan", rf"""
SELECT source, count(*) AS n_rows, count(*) FILTER (regexp_replace(text, '{BLANK}', '', 'g') <> '') AS n_kept, CAST(sum(len(text)) AS BIGINT) AS n_chars FROM documents GROUP BY 1""")
def corpus_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and usable rows per source."""
    docs = read_documents(spark, sf, "source", "text")
    return docs.groupBy("source").agg(
        F.count("*").alias("n_rows"), F.count_if(strip(F.col("text")) != "").alias("n_kept"), F.sum(F.length("text")).alias("n_chars")
    )


FILE_ROWS = 500


def _document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks: the source is the code, the language the domain."""
    doc = F.col("doc_id").cast("string")
    return read_documents(spark, sf, "text", "lang", "source").select(
        F.concat("source", F.lit("#"), doc).alias("chunk_id"), F.col("source").alias("spec_code"), F.col("source").alias("spec_name"),
        F.lit(None).cast("string").alias("chapter"), F.lit(None).cast("string").alias("section"), doc.alias("clause"),
        F.lit("clause").alias("type"), "text", F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.lit(False).alias("is_mandatory"),
        F.col("lang").alias("domain"), F.col("source").alias("source_pdf"), F.length("text").alias("char_count"))


@query("chunk_files", """
SELECT source AS spec_code, lang AS domain, count(*) AS n_chunks, CAST(sum(len(text)) AS BIGINT) AS n_chars,
  count(DISTINCT doc_id) AS n_ids FROM documents WHERE text <> '' GROUP BY 1, 2""")
def chunk_files(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks and characters by code and domain, from files with a list of chunks each that the documents are written to."""
    folder, _ = _folders(spark, "chunks")
    chunks = _document_chunks(spark, sf)
    # a file has the chunks of one code whose numbers are close, so none grows with the code
    lists = chunks.groupBy("spec_code", F.floor(F.col("clause").cast("long") / FILE_ROWS).alias("part")).agg(
        F.collect_list(F.struct(*chunks.columns)).alias("chunks"))
    lists.select("chunks").write.option("maxRecordsPerFile", 1).json(folder)
    chunks.limit(1).select(F.lit("{broken").alias("value")).write.mode("append").text(folder)
    return corpus.read_chunks(spark, folder).groupBy("spec_code", "domain").agg(
        F.count("*").alias("n_chunks"), F.sum("char_count").alias("n_chars"), F.countDistinct("chunk_id").alias("n_ids"))


@query("chunk_sink", """
SELECT lang AS domain, source AS spec_slug, 2 * count(*) AS n_rows, count(*) AS n_chunks FROM documents
WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2""")
def chunk_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and different chunks per folder after the corpus was written, rebuilt and added to."""
    folder, _ = _folders(spark, "sink")
    chunks = _document_chunks(spark, sf).filter("spec_code is not null and domain is not null")
    for mode in ("append", "overwrite", "append"):
        corpus.write_chunks(chunks, folder, mode)
    return spark.read.schema("chunk_id string, domain string, spec_slug string").json(folder).groupBy("domain", "spec_slug").agg(
        F.count("*").alias("n_rows"), F.countDistinct("chunk_id").alias("n_chunks"))


@query("eval_file", """
SELECT CAST(item_id AS VARCHAR) AS id, 'd' || item_id % 3 AS difficulty, md5(text || ' "x",' || chr(10) || 'y') AS query_md5 FROM benchmark""")
def eval_file(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items written as an eval set with quotes, commas and line ends in its fields, and read again."""
    folder, _ = _folders(spark, "eval")
    item = F.col("item_id").cast("string")
    values = {"id": item, "difficulty": F.concat(F.lit("d"), (F.col("item_id") % 3).cast("string")),
              "query": F.concat("text", F.lit(' "x",\ny'))}
    rows = read_table(spark, sf, "benchmark").select(*[
        values.get(name, F.lit(None).cast("string")).alias(name) for name in schemas.names(schemas.EVAL_ROW)])
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(folder)
    return corpus.read_eval_set(spark, folder).select("id", "difficulty", F.md5("query").alias("query_md5"))


@query("schema_project", """
SELECT 'src' || doc_id || '#' || lang AS chunk_id, source AS spec_code, lang AS domain, len(text) AS char_count FROM documents WHERE n_chars >= 50 AND doc_id % 13 <> 0""")
def schema_project(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunk rows; those with a missing field are skipped by the projection."""
    docs = read_documents(spark, sf, "text", "lang", "source", "n_chars")
    doc = F.col("doc_id")
    rows = docs.select(
        F.concat(F.lit("src"), doc.cast("string"), F.lit("#"), F.col("lang")).alias("chunk_id"), F.col("source").alias("spec_code"),
        F.when(doc % 13 != 0, F.col("source")).alias("spec_name"), F.lit(None).cast("string").alias("chapter"),
        F.lit(None).cast("string").alias("section"), doc.cast("string").alias("clause"), F.lit("clause").alias("type"),
        F.when(F.col("n_chars") >= 50, F.col("text")).alias("text"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"),
        F.lit(False).alias("is_mandatory"), F.col("lang").alias("domain"), F.col("source").alias("source_pdf"),
        F.length("text").alias("char_count"), F.lit("extra").alias("unknown_key"),
    )
    return corpus.project_chunks(rows).select("chunk_id", "spec_code", "domain", "char_count")


@query("title_overrides", """
WITH t AS (SELECT p_partkey, p_size, CASE WHEN p_size % 5 = 0 THEN 'odd ' || p_size || '.pdf' ELSE 'GB ' || p_partkey || ' 《' || p_name || '》.pdf' END AS file, p_name FROM part)
SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN 'GB ' || p_partkey WHEN p_size % 2 = 0 THEN 'X ' || p_size ELSE '' END AS code,
  CASE WHEN p_size % 5 > 0 THEN p_name WHEN p_size % 2 = 0 THEN 'title ' || p_size ELSE '' END AS name,
  CASE WHEN p_size % 5 = 0 AND p_size % 2 = 1 THEN 'error' ELSE 'ok' END AS status FROM t""")
def title_overrides(spark: SparkSession, sf: str) -> DataFrame:
    """Code and title of file names built from the parts; odd names are listed or become errors."""
    size = F.col("p_size").cast("string")
    usual = F.concat(F.lit("GB "), F.col("p_partkey").cast("string"), F.lit(" 《"), F.col("p_name"), F.lit("》.pdf"))
    odd = F.concat(F.lit("odd "), size, F.lit(".pdf"))
    files = read_table(spark, sf, "part", "p_partkey", "p_name", "p_size").select(
        "p_partkey", F.when(F.col("p_size") % 5 == 0, odd).otherwise(usual).alias("file"))
    parsed = files.withColumn("t", chunking.parse_title(F.col("file"))).select("p_partkey", "file", "t.code", "t.name")
    listed = {f"odd {i}.pdf": (f"X {i}", f"title {i}") for i in range(0, 60, 2)}
    return corpus.override_titles(parsed, "file", listed).select(
        "p_partkey", F.coalesce("code", F.lit("")).alias("code"), F.coalesce("name", F.lit("")).alias("name"), "status")


@query("report_file", ORACLES["corpus_report"])
def report_file(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus report as its file has it."""
    report = structure.corpus_report(spark, sf)
    path = f"{corpus.shared_dir(spark)}/clauselake/report-{uuid.uuid4().hex}"
    corpus.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query("point_ids", """
WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(source || '#' || doc_id)) AS d FROM documents)
SELECT doc_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || translate(substr(d, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab')
  || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS point_id FROM h""")
def point_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Storage id of every document."""
    docs = read_table(spark, sf, "documents", "doc_id", "source")
    return docs.select("doc_id", corpus.point_id(F.concat("source", F.lit("#"), F.col("doc_id").cast("string"))).alias("point_id"))


@query("missing_docs", """
SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def missing_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without a label, joined through codes in two spellings."""
    code = F.col("doc_id").cast("string")
    docs = read_table(spark, sf, "documents", "doc_id", "source").withColumn("code", F.concat(F.lit("Doc "), code))
    done = read_table(spark, sf, "labels", "doc_id").select(F.concat(F.lit("DOC　"), code).alias("code"))
    return corpus.missing(docs, done, "code").select("doc_id", "source")


PREFIXES = "px(domain, prefix) AS (VALUES " + ", ".join(f"('{d}', '{p}')" for p, d in P.PROSE_PREFIXES.items()) + ")"


@query("longest_prefix_domain", f"""
WITH {PREFIXES}, m AS (SELECT page_id, arg_max(domain, len(prefix)) AS domain FROM pages JOIN px ON starts_with(url, prefix) GROUP BY 1)
SELECT p.page_id, coalesce(domain, '') AS domain, CASE WHEN domain IS NULL THEN 'no_domain' ELSE 'ok' END AS status FROM pages p LEFT JOIN m USING (page_id)""")
def longest_prefix_domain(spark: SparkSession, sf: str) -> DataFrame:
    """Domain of every page by the longest prefix of its address."""
    pages = read_table(spark, sf, "pages", "page_id", "url")
    return corpus.resolve_domain(pages, "url", P.PROSE_PREFIXES, []).select("page_id", F.coalesce("domain", F.lit("")).alias("domain"), "status")


@query("source_index", r"""
WITH h AS (SELECT page_id, url, upper(regexp_extract(url, '^https?://([^/]+)', 1)) AS code FROM pages) SELECT code, arg_max(url, page_id) AS file FROM h GROUP BY 1""")
def source_index(spark: SparkSession, sf: str) -> DataFrame:
    """Latest page per host."""
    pages = read_table(spark, sf, "pages", "page_id", "url")
    return corpus.source_index(pages, F.regexp_extract("url", r"^https?://([^/]+)", 1), "url", "page_id")


def timed_events(df: DataFrame) -> DataFrame:
    """Events with elapsed time and error mark."""
    return df.select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("value") * 100).alias("elapsed_ms"),
        (F.col("event_type") == "error").alias("is_error"),
    )


SLA = """
e AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS w, value * 100 AS ms, event_type = 'error' AS err FROM events),
s AS (SELECT w, count(*) AS n, count(*) FILTER (err) AS n_errors, quantile_disc(ms, 0.95) AS p95_ms FROM e GROUP BY 1)
SELECT epoch_us(w) AS window_us, n, n_errors, round(n_errors / n, 6) AS error_share, round(p95_ms, 6) AS p95_ms, p95_ms > 5000 AS slow_alert, n_errors / n > 0.03 AS error_alert FROM s"""


def _windows(df: DataFrame) -> DataFrame:
    return df.select(
        F.unix_micros("window_start").alias("window_us"), "n", "n_errors", "error_share", F.round("p95_ms", 6).alias("p95_ms"),
        "slow_alert", "error_alert",
    )


@query("sla_windows", f"WITH {SLA}")
def sla_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Five-minute windows of the events with alerts."""
    return _windows(jobs.sla_windows(timed_events(read_table(spark, sf, "events"))))


SESSIONS = """
WITH o AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM o)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_errors FROM g GROUP BY user_id, s"""


def _sessions(df: DataFrame) -> DataFrame:
    return df.select(
        "user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n", "n_errors"
    )


@query("user_sessions", SESSIONS)
def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Bursts of activity per user."""
    return _sessions(jobs.sessions(timed_events(read_table(spark, sf, "events")), "user_id"))


def _folders(spark: SparkSession, name: str) -> tuple[str, str]:
    """New sink and checkpoint folder of one run, in the shared folder."""
    run = f"{corpus.shared_dir(spark)}/clauselake/{name}-{uuid.uuid4().hex}"
    return f"{run}/out", f"{run}/state"


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the given tables, a file or a folder of files, as a stream; rows that belong together may stand in any of the
    files, so all are one batch."""
    table = read_table(spark, sf, name)
    files = table.inputFiles()
    if any(file.endswith(f"/{name}.parquet") for file in files):
        return jobs.read_files(spark, sf, table.schema, f"{name}.parquet")
    return jobs.read_files(spark, f"{sf}/{name}.parquet", table.schema, "*", max(1, len(files)))


@query("stream_ingest", f"WITH {structure.MERGED} SELECT chunk_id, clause, type, text, char_count FROM md")
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of the documents, made by the incremental ingest in two batches, the second of which repeats the first."""
    sink, state = _folders(spark, "ingest")
    docs, source = read_documents(spark, sf, "text"), f"{sink}-source"
    sink_files = []
    for part in (docs.filter(F.col("doc_id") % 2 == 0), docs):  # a batch is as many files as a part has
        part.write.mode("append").parquet(source)
        sink_files.append(len(spark.read.schema(docs.schema).parquet(source).inputFiles()) - sum(sink_files))
    stream = jobs.read_files(spark, source, docs.schema, "*.parquet", per_batch=sink_files[0])

    def chunk(batch: DataFrame) -> DataFrame:
        return chunking.chunk_lines(chunking.lines_of(spread(batch.select("doc_id", "text"), "doc_id"), P.PROSE), structure.code(), P.PROSE)

    jobs.ingest(stream, chunk, sink, state)
    return corpus.read_revisions(spark, sink).select("chunk_id", "clause", "type", "text", "char_count")


@query("stream_sla", f"""WITH {SLA.replace("GROUP BY 1)", "GROUP BY 1 HAVING w + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE)")}""")
def stream_sla(spark: SparkSession, sf: str) -> DataFrame:
    """Final five-minute windows of the event stream; the newest ones still wait for late events."""
    sink, state = _folders(spark, "sla")
    jobs.run_to_end(jobs.sla_stream(timed_events(_stream(spark, sf, "events"))), sink, state)
    return _windows(spark.read.parquet(sink))


@query("stream_dedup", "SELECT event_id, user_id FROM events")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a stream that delivers each one twice."""
    sink, state = _folders(spark, "dedup")
    twice = timed_events(_stream(spark, sf, "events")).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    jobs.run_to_end(jobs.drop_repeats(twice, "event_id").select("event_id", "user_id"), sink, state)
    return spark.read.parquet(sink)


@query("stream_history", ORACLES["history_window"])
def stream_history(spark: SparkSession, sf: str) -> DataFrame:
    """Histories of the conversations, kept as state of a stream."""
    sink, state = _folders(spark, "history")
    jobs.run_to_end(jobs.history_stream(_stream(spark, sf, "conversations")), sink, state)
    return spark.read.parquet(sink)


@query("stream_sessions", SESSIONS + " HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Finished sessions of the event stream."""
    sink, state = _folders(spark, "sessions")
    jobs.run_to_end(jobs.session_stream(timed_events(_stream(spark, sf, "events")), "user_id"), sink, state)
    return _sessions(spark.read.parquet(sink))
