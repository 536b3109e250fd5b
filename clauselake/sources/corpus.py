"""Readers and writers of chunk files, eval sets, result files and batch-versioned tables."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from clauselake import profiles as P
from clauselake import schemas
from clauselake.functions.text import norm_code, squeeze, strip
from clauselake.operators.catalog import fixed_table
from clauselake.operators.scale import broadcast_if, keep_first

CHUNKS_PER_FILE = 100_000
"""Chunks that one task writes into a folder."""

# fixed value: name space of the storage ids
ID_NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named in spark.checkpoint.dir.

    Without one, a plain local[...] session gets a temporary folder, and a cluster an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not context.master.startswith("local["):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="clauselake-")
    return _OWN[context.applicationId]


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of all JSON files of a folder, as bare arrays or under "chunks".

    Broken files and files starting with an underscore are skipped, rows need a text.
    """
    row = schemas.STORED_CHUNK
    raw = (
        spark.read.schema(f"{row}, chunks array<struct<{row}>>, _corrupt_record string")
        .option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "[!_]*.json").json(path)
    )
    good = raw.filter(F.col("_corrupt_record").isNull())
    flat = good.filter(F.col("chunks").isNull()).drop("chunks", "_corrupt_record")
    nested = good.filter(F.col("chunks").isNotNull()).select(F.inline("chunks"))
    return flat.unionByName(nested).filter(F.coalesce("text", F.lit("")) != "")


def project_chunks(chunks: DataFrame, counts: Observation | None = None) -> DataFrame:
    """Schema fields of the complete rows; the observation gets n_read and n_skipped without another pass."""
    complete = F.lit(True)
    for name in schemas.CHUNK_REQUIRED:
        complete = complete & F.col(name).isNotNull()
    marked = chunks.withColumn("_ok", complete)
    if counts is not None:
        marked = marked.observe(counts, F.count("*").alias("n_read"), F.count_if(~F.col("_ok")).alias("n_skipped"))
    return marked.filter("_ok").select(*schemas.names(schemas.CHUNK))


def slug(code: Column) -> Column:
    """Name safe for files: no slashes and colons, blanks as underscores."""
    return F.translate(F.translate(code, "/:", ""), " ", "_")


def write_chunks(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Chunks in one folder per domain and code; overwrite rebuilds the corpus, append adds to it.

    Rows are spread by folder and digest of the chunk id, over as many tasks as the folder's share of the rows asks for.
    """
    parts = chunks.withColumn("spec_slug", slug(F.col("spec_code")))
    keys = ["domain", "spec_slug"]
    sizes = parts.groupBy(*keys).agg(F.ceil(F.count("*") / CHUNKS_PER_FILE).cast("int").alias("_files")).select(
        *[F.col(k).alias(f"_{k}") for k in keys], "_files")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    spread = parts.join(broadcast_if(sizes), same, "left").withColumn(
        "_s", F.pmod(F.xxhash64("chunk_id"), F.greatest(F.lit(1), F.coalesce("_files", F.lit(1)))))
    spread.repartition(*keys, "_s").select(*parts.columns).write.mode(mode).partitionBy(*keys).json(path)


def read_eval_set(spark: SparkSession, path: str, extra: Sequence[str] = ()) -> DataFrame:
    """Eval rows of a CSV file with header, all text; extra names further columns of later versions."""
    schema = ", ".join([schemas.EVAL_ROW, *[f"{name} string" for name in extra]])
    return (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False)
        .schema(schema).csv(path)
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """One flat row per result file with its configuration, overall metrics and file time."""
    raw = spark.read.schema(schemas.RESULT_FILE).option("multiLine", True).json(path)
    c, o = "config.", "overall."
    return raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.regexp_extract(F.coalesce(F.col(c + "csv"), F.lit("unknown")), r"[^/]*$", 0).alias("csv"),
        F.coalesce(F.col(c + "use_multi_query"), F.lit(False)).alias("mq"),
        F.coalesce(F.col(c + "use_rerank"), F.lit(False)).alias("rk"),
        F.coalesce(F.col(c + "use_hybrid"), F.lit(False)).alias("hyb"),
        F.coalesce(F.col(c + "rerank_candidate_k"), F.lit(20)).alias("ck"),
        F.coalesce(F.col(c + "passage_format"), F.lit("text_only")).alias("pf"),
        *[F.coalesce(F.col(o + m), F.lit(0.0)).alias(m) for m in ("hit5_strict", "hit5_loose", "mrr_strict", "mrr_loose")],
        F.coalesce(F.col(c + "elapsed_s"), F.lit(0.0)).alias("elapsed_s"),
        F.coalesce(F.nullif(F.col(c + "n_results"), F.lit(0)), F.col(o + "n"), F.lit(0)).alias("n_eval"),
        F.coalesce(F.col(c + "timestamp"), F.lit("")).alias("ts"),
        F.try_to_timestamp(F.col(c + "timestamp"), F.lit("yyyyMMdd_HHmmss")).alias("run_at"),
        F.col("_metadata.file_modification_time").alias("mtime"),
    )


def write_report(report: DataFrame, path: str) -> None:
    """Aggregates as JSON lines."""
    report.write.mode("overwrite").json(path)


def point_id(name: Column) -> Column:
    """Name-based UUID (version 5) of a chunk id, so that re-runs hit the same row."""
    digest = F.sha1(F.concat(F.unhex(F.lit(ID_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
        F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Store one batch of an upsert table; writing the same batch again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_current(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Newest row per key over all batches."""
    rows = spark.read.parquet(path)
    return keep_first(rows, [key], [F.col("batch_id").desc()]).drop("batch_id")


def write_revisions(chunks: DataFrame, docs: DataFrame, path: str, batch_id: int) -> None:
    """Store the chunks of a batch and, last, the documents they were made of: (doc_id, digest)."""
    chunks.write.mode("overwrite").parquet(f"{path}/chunks/batch_id={batch_id}")
    docs.write.mode("overwrite").parquet(f"{path}/documents/batch_id={batch_id}")


def ingested(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """(doc_id, digest, batch_id) of the latest revision of every document; None while there is none."""
    found = sorted(int(p) for p in _batches(spark, f"{path}/documents") if before is None or int(p) < before)
    if not found:
        return None
    rows = spark.read.option("basePath", f"{path}/documents").parquet(*[f"{path}/documents/batch_id={p}" for p in found])
    return keep_first(rows, ["doc_id"], [F.col("batch_id").desc()])


def _batches(spark: SparkSession, path: str) -> list[str]:
    """Numbers of the batches that a folder holds."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return [n.removeprefix("batch_id=") for n in names if n.startswith("batch_id=")]


def read_revisions(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of the latest revision of every document; what an older revision had beside them is gone."""
    latest = ingested(spark, path).select("doc_id", "batch_id")
    return spark.read.parquet(f"{path}/chunks").join(latest, ["doc_id", "batch_id"], "left_semi").drop("batch_id")


def missing(sources: DataFrame, done: DataFrame, code: str) -> DataFrame:
    """Sources whose code has no output yet, under any spelling."""
    have = done.select(norm_code(F.col(code)).alias("_k")).distinct()
    return sources.withColumn("_k", norm_code(F.col(code))).join(have, "_k", "left_anti").drop("_k")


def resolve_domain(
    files: DataFrame, name: str, prefixes: dict[str, str] | None = None, excluded: Sequence[str] | None = None
) -> DataFrame:
    """Adds domain by the longest listed prefix of the trimmed name, and status ok or no_domain.

    Names are cut to each occurring prefix length and joined by equality; excluded files are left out.
    """
    prefixes = P.DOMAIN_PREFIXES if prefixes is None else prefixes
    rows = list(prefixes.items())
    listed = fixed_table(files.sparkSession, rows, "prefix string, domain string")
    lengths = sorted({len(p) for p, _ in rows}, reverse=True)
    some = files.filter(~F.col(name).isin(*(P.EXCLUDED_FILES if excluded is None else excluded)))
    clean = strip(F.col(name))
    maps = listed.agg(F.map_from_entries(F.collect_list(F.struct("prefix", "domain")))).scalar()
    found = F.coalesce(*[F.try_element_at(F.col("_m"), F.substring("_n", 1, n)) for n in lengths])
    return (
        some.withColumn("_m", maps).withColumn("_n", clean).withColumn("domain", found).drop("_m", "_n")
        .withColumn("status", F.when(F.col("domain").isNull(), "no_domain").otherwise("ok"))
    )


def override_titles(files: DataFrame, name: str, overrides: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Code and title of listed odd file names take the place of the parsed ones; with neither, status is error."""
    rows = [(k, *v) for k, v in (P.FILE_OVERRIDES if overrides is None else overrides).items()]
    listed = fixed_table(files.sparkSession, rows, f"{name} string, _code string, _title string")
    return files.join(listed, name, "left").withColumns(
        {
            "code": F.coalesce("_code", "code"), "name": F.coalesce("_title", "name"),
            "status": F.when(F.coalesce("_code", "code").isNull(), "error").otherwise("ok"),
        }
    ).drop("_code", "_title")


def source_index(files: DataFrame, code: Column, file: str, order: str) -> DataFrame:
    """(code, file): the later file per normalized code."""
    return files.groupBy(F.upper(squeeze(code)).alias("code")).agg(F.max_by(file, order).alias("file"))
