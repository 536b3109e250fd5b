"""Token ids in directly addressable files.

A shard holds the ids of consecutive documents.  Each id is split into chunks of eight bits: level 0 has the low chunk
of every id, level k+1 the next chunk of those ids that go on after level k.  A bitmap per level marks the ids that go
on, and a directory holds the number of marks before each block of 512 bits.  The chunk of an id on the next level is at
the rank of its mark, so any id is read with one byte, one directory entry and one bitmap block per level, and no
other id is decoded.

Layout, little-endian: the magic, then eight 64-bit numbers per shard (documents, ids, levels, five reserved), the
document ids (int64), a byte per document that marks a missing id, the first position of every document and the end
(uint64), and per level: its number of chunks (uint64), the chunks, and, but for the last level, the bitmap (uint64
words) and the directory (uint64 per block).  Every part is padded to eight bytes.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauselake.llm.common import record_batch, scratch, sliced, splits, strings
from clauselake.llm.units import UnitEncoder

# fixed values of the file format
MAGIC = b"DACIDS01"
HEAD = struct.Struct("<8Q")
BLOCK_WORDS = 8

SHARD_IDS = 4 << 20
"""Ids per shard, but for a longer document, which is a shard of its own."""

READ_IDS = 1 << 20
"""Ids held at once when whole documents are read."""

REMEMBER = 280 << 20
"""Bytes of the units that a worker remembers, which does nothing else then."""

END = 0
"""Id after each document."""


def _padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 8)


def pack_shard(doc_ids: Sequence[int | None], docs: Sequence[np.ndarray]) -> Iterator[bytes]:
    """The parts of a shard file."""
    ids = np.concatenate([*docs, np.zeros(0, np.uint32)]).astype(np.uint32)
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    rest = ids
    while True:
        goes_on = rest > 0xFF
        levels.append(((rest & 0xFF).astype(np.uint8), goes_on))
        if not goes_on.any():
            break
        rest = rest[goes_on] >> 8
    starts = np.cumsum([0, *map(len, docs)], dtype=np.uint64)
    yield MAGIC
    yield HEAD.pack(len(docs), len(ids), len(levels), 0, 0, 0, 0, 0)
    yield np.array([i or 0 for i in doc_ids], "<i8").tobytes()
    yield _padded(np.array([i is None for i in doc_ids], np.uint8).tobytes())
    yield starts.astype("<u8").tobytes()
    for n, (chunks, goes_on) in enumerate(levels):
        yield struct.pack("<Q", len(chunks))
        yield _padded(chunks.tobytes())
        if n + 1 < len(levels):
            bits = np.packbits(goes_on, bitorder="little").tobytes()
            words = np.frombuffer(_padded(bits), "<u8")
            yield words.tobytes()
            blocks = np.add.reduceat(np.bitwise_count(words).astype(np.uint64), range(0, len(words), BLOCK_WORDS))
            yield np.concatenate([[0], np.cumsum(blocks)]).astype("<u8").tobytes()


class ShardReader:
    """Random access to the ids of a shard; only the bytes asked for are read."""

    def __init__(self, file):
        """file: anything with read_at(size, offset), such as an Arrow input file."""
        self._file = file
        if file.read_at(8, 0) != MAGIC:
            raise ValueError("not a shard of token ids")
        self.n_docs, self.n_ids, n_levels, *_ = HEAD.unpack(file.read_at(HEAD.size, 8))
        at = 8 + HEAD.size
        self._ids_at = at
        at += 8 * self.n_docs
        self._null_at = at
        at += self.n_docs + -self.n_docs % 8
        self._starts_at = at
        at += 8 * (self.n_docs + 1)
        self._levels: list[tuple[int, int, int]] = []  # where chunks, bitmap and directory begin
        for n in range(n_levels):
            (size,) = struct.unpack("<Q", file.read_at(8, at))
            chunks = at + 8
            bitmap = chunks + size + -size % 8
            words = -(-size // 64)
            directory = bitmap + 8 * words
            self._levels.append((chunks, bitmap, directory))
            at = directory + 8 * (-(-words // BLOCK_WORDS) + 1) if n + 1 < n_levels else bitmap

    def _array(self, kind: str, at: int, first: int, count: int) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.frombuffer(self._file.read_at(size * count, at + size * first), kind)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Document ids and the positions where they start, with the end."""
        ids = self._array("<i8", self._ids_at, 0, self.n_docs).tolist()
        missing = self._array("u1", self._null_at, 0, self.n_docs)
        return [None if m else i for i, m in zip(ids, missing)], self._array("<u8", self._starts_at, 0, self.n_docs + 1)

    def _rank(self, level: int, i: int) -> int:
        """Number of marks before position i of a level's bitmap: one directory entry and one block."""
        _, bitmap, directory = self._levels[level]
        block = i // (64 * BLOCK_WORDS)
        before = int(self._array("<u8", directory, block, 1)[0])
        inside = i - block * 64 * BLOCK_WORDS
        words = self._array("<u8", bitmap, block * BLOCK_WORDS, -(-inside // 64)).copy()
        if inside % 64:
            words[-1] &= np.uint64((1 << inside % 64) - 1)
        return before + int(np.bitwise_count(words).sum())

    def token(self, i: int) -> int:
        """The id at one position."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for level, (chunks, bitmap, _) in enumerate(self._levels):
            value |= int(self._array("u1", chunks, i, 1)[0]) << 8 * level
            if level + 1 == len(self._levels) or not int(self._array("<u8", bitmap, i // 64, 1)[0]) >> i % 64 & 1:
                return value
            i = self._rank(level, i)
        return value

    def slice(self, start: int, stop: int, level: int = 0) -> np.ndarray:
        """The ids from start to stop."""
        chunks, bitmap, _ = self._levels[level]
        values = self._array("u1", chunks, start, stop - start).astype("<u4")
        if level + 1 < len(self._levels) and stop > start:
            word = start // 64
            words = self._array("<u8", bitmap, word, -(-stop // 64) - word)
            bits = np.unpackbits(words.view(np.uint8), bitorder="little")[start - 64 * word: stop - 64 * word]
            marked = np.flatnonzero(bits)
            first = self._rank(level, start)
            values[marked] |= self.slice(first, first + len(marked), level + 1) << np.uint32(8)
        return values


@lru_cache(maxsize=1)
def library_encoder(path: str, plain: bool = False, remember: int = REMEMBER) -> UnitEncoder:
    """The worker's encoder by the tokenizers library, which remembers the ids of frequent units.

    With plain, the strings of special tokens are ordinary text.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(units: Sequence[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(list(units), add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    return UnitEncoder(encode, remember)


def _files(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_tokens(
    docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text",
    end: int = END, shard_ids: int = SHARD_IDS
) -> DataFrame:
    """Write the ids of all documents in ascending id order, and return the stored list of shards.

    Documents are range-partitioned by id (missing ids first, equal ids by a hash of the text); every task writes
    its range as shards of bounded size and returns one row per shard, which Spark commits.  A task that runs twice
    writes files of other names, and only files in the committed list count.  Columns: part, shard, path, n_docs, n_ids,
    start (ids in all shards before).  A null text is empty, a document always gets its end id, and an empty table
    gives an empty list.
    """
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ranged = source.repartitionByRange(splits(source), *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("part", F.spark_partition_id())
    fields = "part int, shard int, path string, n_docs long, n_ids long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()),
                            ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        encode = library_encoder(tokenizer_path)
        files, base = _files(folder)
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = shard = part = 0
        files.create_dir(base, recursive=True)

        def flush() -> pa.RecordBatch:
            name = posixpath.join(base, f"ids-{part:06d}-{shard:06d}-{uuid.uuid4().hex}.dac")
            with files.open_output_stream(name) as out:
                for piece in pack_shard(ids, held):
                    out.write(piece)
            return record_batch(schema, part=[part], shard=[shard], path=[name], n_docs=[len(ids)], n_ids=[size])

        for batch in sliced(batches, "text", 4 << 20):
            part = batch.column("part")[0].as_py()
            for i, packed in zip(batch.column("doc_id").to_pylist(), encode(strings(batch.column("text")))):
                doc = np.append(np.frombuffer(packed, "<u4"), np.uint32(end))
                if ids and size + len(doc) > shard_ids:
                    yield flush()
                    ids, held, size, shard = [], [], 0, shard + 1
                ids.append(i)
                held.append(doc)
                size += len(doc)
        if ids:
            yield flush()

    listed = f"{folder}/list"
    ranged.mapInArrow(run, fields).write.parquet(listed)
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return docs.sparkSession.read.schema(fields).parquet(listed).withColumn(
        "start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read_tokens(shards: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and ids_crc32 of its ids as little-endian uint32."""
    spark = shards.sparkSession
    spread = shards.repartition(max(spark.sparkContext.defaultParallelism, shards.count()), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                            ("ids_crc32", pa.int64())])
        files, _ = _files(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_file(row["path"]) as file:
                    shard = ShardReader(file)
                    ids, starts = shard.documents()
                    yield record_batch(
                        schema, doc_id=ids, start=(starts[:-1].astype(np.int64) + row["start"]),
                        n_tokens=np.diff(starts).astype(np.int64), ids_crc32=list(_checksums(shard, starts)))

    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _checksums(shard: ShardReader, starts: np.ndarray) -> Iterator[int]:
    """crc32 of each document's ids; a run of short documents is read at once, a long one in pieces."""
    bounds = starts.tolist()
    doc = 0
    while doc < len(bounds) - 1:
        last = doc + 1
        while last < len(bounds) - 1 and bounds[last + 1] - bounds[doc] <= READ_IDS:
            last += 1
        if last == doc + 1:
            crc = 0
            for at in range(bounds[doc], bounds[last], READ_IDS):
                crc = zlib.crc32(shard.slice(at, min(at + READ_IDS, bounds[last])).tobytes(), crc)
            yield crc
        else:
            ids = shard.slice(bounds[doc], bounds[last])
            for a, b in zip(bounds[doc:last], bounds[doc + 1: last + 1]):
                yield zlib.crc32(ids[a - bounds[doc]: b - bounds[doc]].tobytes())
        doc = last


def tokens_round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the ids of all documents to a new folder and read the files back."""
    folder = scratch(spark, "tokens")
    return read_tokens(write_tokens(docs, tokenizer_path, folder), folder)
