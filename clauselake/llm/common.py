"""Helpers shared by the training-data operators: shared folders, written tables, skew-safe joins, Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_SHARE = 2000
"""A key with more than 1/HOT_SHARE of all rows is hot, so at most HOT_SHARE keys are."""

# fixed values: the six blanks of the word patterns
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach: the one named in spark.checkpoint.dir.

    Where none is named, a plain local[...] session, as in tests, gets a temporary one; a cluster gets an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local["):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="shared-")
    return _OWN[context.applicationId]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: lineage ends there, and lost executors cost nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Chosen columns of the documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def splits(df: DataFrame, least: int = 2) -> int:
    """Number of partitions the scan of a frame has; only planned, nothing runs."""
    return max(least, df.rdd.getNumPartitions())


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, row_id: str) -> DataFrame:
    """Left join of rows with one row per key, however large a key's share of the rows is.

    Keys with more than total / HOT_SHARE rows are at most HOT_SHARE, a proven bound, and are broadcast.  Their rows
    then carry a key of their own through the second join, as do rows without a key, so they spread over all tasks
    instead of meeting in one.
    """
    limit = max(1, total // HOT_SHARE)
    values = [c for c in groups.columns if c != key]
    kind = dict(rows.dtypes)[key]
    hot = groups.filter(F.col(size) > limit).select(F.col(key), F.struct(*values).alias("_hot"))
    cold = groups.filter(F.col(size) <= limit).select(F.col(key).alias("_key"), F.struct(*values).alias("_cold"))
    # hot rows take their broadcast values, so it does no harm if a key of their own meets another one
    own = F.xxhash64(key, row_id) if kind == "bigint" else F.concat(
        F.lit("\0"), F.xxhash64(key, row_id).cast("string")).cast(kind)
    marked = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_key", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(own))
    joined = marked.join(cold, "_key", "left")
    found = F.coalesce("_hot", "_cold")
    return joined.select(*rows.columns, *[found[c].alias(c) for c in values])


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, empty where null."""
    return [x or "" for x in column.to_pylist()]


def record_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch from one list or array per field."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
         for f, c in ((f, columns[f.name]) for f in schema)], schema=schema)


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a column holds about `most` bytes in each; a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data = batch.column(column)
        ends = np.frombuffer(data.buffers()[1], np.int32, batch.num_rows + 1 + data.offset)[data.offset:] \
            if data.type in (pa.string(), pa.binary()) else None
        if ends is None or int(ends[-1]) - int(ends[0]) <= most:
            yield batch
            continue
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, int(ends[start]) + most, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def held_out(doc_id: str, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves the given rest; an id that is null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == rest


def grouped(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The groups of a partition that is sorted by the keys, one after the other."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changes = np.zeros(batch.num_rows, bool)
        for c in columns:
            changes[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(changes).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != at:
                yield pa.Table.from_batches(held)
                held = []
            at = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
