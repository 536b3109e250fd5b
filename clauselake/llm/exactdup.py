"""Exact duplicates through a sharded cuckoo-filter index of live digests.

Texts are compared by the SHA-256 of the text with every run of blanks made one space.  The index is split into shards
by the digest; a shard has a cuckoo filter and, bucketed beside it, the stored keys: digest, the smallest id and the
number of rows.  A lookup that the filter denies is new for sure; one that it affirms is verified against the stored
keys.  Deleting the last row of a digest takes its fingerprint out of the filter.  A filter that overflows is built
anew with twice the buckets from the stored keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.llm.common import BLANKS, free_name, join_groups, record_batch, splits, stored

SLOTS = 4
"""Fingerprints per bucket of a filter."""

KICKS = 500
"""Moves tried before a filter counts as full."""

SHARD_KEYS = 1 << 18
"""Digests that a shard of a new index is planned for."""

COMBINE = 200_000
"""Digests combined at once within a task before they are sent to their shards."""


class CuckooFilter:
    """Membership of 32-byte digests with insertion and deletion; 16-bit fingerprints, two buckets each."""

    def __init__(self, n_buckets: int = 1024):
        """n_buckets: a power of two."""
        self.n_buckets = n_buckets
        self.slots = np.zeros((n_buckets, SLOTS), np.uint16)
        self._rows = None
        self._turn = 0

    def _place(self, digest: bytes) -> tuple[int, int]:
        print_ = int.from_bytes(digest[8:10], "little") or 1
        return print_, int.from_bytes(digest[16:24], "little") & (self.n_buckets - 1)

    def _other(self, bucket: int, print_: int) -> int:
        return bucket ^ (print_ * 0x5BD1E995 >> 7) & (self.n_buckets - 1)

    def _lists(self) -> list[list[int]]:
        """The buckets as lists while single digests are worked on."""
        if self._rows is None:
            self._rows = self.slots.tolist()
        return self._rows

    def __contains__(self, digest: bytes) -> bool:
        print_, a = self._place(digest)
        rows = self._lists()
        return print_ in rows[a] or print_ in rows[self._other(a, print_)]

    def insert(self, digest: bytes) -> bool:
        """Add a digest; False if the filter is full, which then has lost nothing but must be built anew."""
        print_, a = self._place(digest)
        rows = self._lists()
        b = self._other(a, print_)
        for bucket in (a, b):
            if 0 in rows[bucket]:
                rows[bucket][rows[bucket].index(0)] = print_
                return True
        bucket, moved = b, []
        for _ in range(KICKS):
            self._turn = (self._turn + 1) % SLOTS
            moved.append((bucket, self._turn, rows[bucket][self._turn]))
            print_, rows[bucket][self._turn] = rows[bucket][self._turn], print_
            bucket = self._other(bucket, print_)
            if 0 in rows[bucket]:
                rows[bucket][rows[bucket].index(0)] = print_
                return True
        for bucket, slot, old in reversed(moved):
            rows[bucket][slot] = old
        return False

    def delete(self, digest: bytes) -> bool:
        """Remove one copy of a digest's fingerprint; the digest must have been inserted."""
        print_, a = self._place(digest)
        rows = self._lists()
        for bucket in (a, self._other(a, print_)):
            if print_ in rows[bucket]:
                rows[bucket][rows[bucket].index(print_)] = 0
                return True
        return False

    def to_bytes(self) -> bytes:
        """The fingerprints, bucket by bucket."""
        if self._rows is not None:
            self.slots = np.array(self._rows, np.uint16)
        return self.slots.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        """The filter that to_bytes wrote."""
        made = cls(max(1, len(data) // (2 * SLOTS)))
        made.slots = np.frombuffer(data, "<u2").reshape(-1, SLOTS).copy()
        return made


class ShardIndex:
    """One shard: a cuckoo filter and the stored keys, digest to [smallest id, rows], by bucket of the digest."""

    def __init__(self, keys: Sequence[tuple[bytes, int | None, int]] = (), filter_bytes: bytes | None = None):
        self.keys: dict[bytes, list] = {d: [i, n] for d, i, n in keys}
        self.checked = self.false_hits = self.resizes = 0
        if filter_bytes:
            self.filter = CuckooFilter.from_bytes(filter_bytes)
        else:
            self._rebuild(64)

    def _rebuild(self, n_buckets: int) -> None:
        """A filter of at least this size from the stored keys, twice as large each time it overflows."""
        while True:
            self.filter = CuckooFilter(n_buckets)
            if all(map(self.filter.insert, self.keys)):
                return
            n_buckets *= 2

    def find(self, digest: bytes) -> list | None:
        """The stored key of a digest: denied by the filter, or verified against the stored keys."""
        if digest not in self.filter:
            return None
        self.checked += 1
        found = self.keys.get(digest)
        self.false_hits += found is None
        return found

    def insert(self, digest: bytes, least_id: int | None, rows: int) -> None:
        """Add rows of a digest."""
        found = self.find(digest)
        if found is None:
            self.keys[digest] = [least_id, rows]
            if not self.filter.insert(digest):
                self.resizes += 1
                self._rebuild(2 * self.filter.n_buckets)
            return
        if found[0] is None or least_id is not None and least_id < found[0]:
            found[0] = least_id
        found[1] += rows

    def delete(self, digest: bytes, rows: int) -> None:
        """Take rows of a digest away; the last one takes its fingerprint along.  Unknown digests are passed over."""
        found = self.find(digest)
        if found is None:
            return
        found[1] -= rows
        if found[1] <= 0:
            del self.keys[digest]
            self.filter.delete(digest)


def normalized(text: Column) -> Column:
    """The text with every run of blanks made one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANKS}]+", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_sha256 of the normalized text in UTF-8, as hex."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"),
                       F.sha2(F.encode(normalized(docs[text_col].cast("string")), "UTF-8"), 256).alias("text_sha256"))


def _combined(rows: DataFrame, n_shards: int) -> DataFrame:
    """Rows of one digest within a task made one, so that a digest travels once per task however many copies it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("digest", pa.binary()), ("least_id", pa.int64()),
                            ("n_rows", pa.int64())])
        held: dict[str, list] = {}

        def flush() -> pa.RecordBatch:
            keys = [bytes.fromhex(h) for h in held]
            return record_batch(
                schema, shard=[int.from_bytes(k[:8], "little") % n_shards for k in keys], digest=keys,
                least_id=[v[0] for v in held.values()], n_rows=[v[1] for v in held.values()])

        for batch in batches:
            for i, h in zip(batch.column("doc_id").to_pylist(), batch.column("text_sha256").to_pylist()):
                found = held.get(h)
                if found is None:
                    held[h] = [i, 1]
                else:
                    found[1] += 1
                    if found[0] is None or i is not None and i < found[0]:
                        found[0] = i
            if len(held) >= COMBINE:
                yield flush()
                held = {}
        if held:
            yield flush()

    return rows.mapInArrow(run, "shard int, digest binary, least_id long, n_rows long")


def _worked(index: DataFrame | None, changes: DataFrame, n_shards: int, work: Callable[[ShardIndex, tuple], None]) -> DataFrame:
    """The shards after the changes: filter rows and key rows of one table, one task per shard and change set."""
    fields = "shard int, digest binary, least_id long, n_rows long, filter binary, n_shards int"
    new = changes.withColumn("filter", F.lit(None).cast("binary")).withColumn("is_new", F.lit(True))
    rows = new if index is None else index.drop("n_shards").withColumn("is_new", F.lit(False)).unionByName(new)
    dealt = rows.repartition(n_shards, "shard").sortWithinPartitions("shard", "is_new")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("digest", pa.binary()), ("least_id", pa.int64()),
                            ("n_rows", pa.int64()), ("filter", pa.binary()), ("n_shards", pa.int32())])
        at, state, keys, data = None, None, [], None

        def result(shard: int, state: ShardIndex) -> Iterator[pa.RecordBatch]:
            items = list(state.keys.items())
            yield record_batch(schema, shard=[shard], digest=[None], least_id=[None], n_rows=[None],
                               filter=[state.filter.to_bytes()], n_shards=[n_shards])
            for k in range(0, len(items), 10_000):
                part = items[k: k + 10_000]
                yield record_batch(
                    schema, shard=[shard] * len(part), digest=[d for d, _ in part],
                    least_id=[v[0] for _, v in part], n_rows=[v[1] for _, v in part], filter=[None] * len(part),
                    n_shards=[n_shards] * len(part))

        for batch in batches:
            for shard, digest, least, n, stored_filter, is_new in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != at:
                    if at is not None:
                        yield from result(at, state or ShardIndex(keys, data))
                    at, state, keys, data = shard, None, [], None
                if is_new:
                    if state is None:
                        state = ShardIndex(keys, data)
                    work(state, (digest, least, n))
                elif digest is None:
                    data = stored_filter
                else:
                    keys.append((digest, least, n))
        if at is not None:
            yield from result(at, state or ShardIndex(keys, data))

    return dealt.mapInArrow(run, fields)


def build_index(rows: DataFrame, total: int) -> DataFrame:
    """Stored index of a table of digests: key rows (shard, digest, least_id, n_rows) and one filter row per shard.

    The number of shards is planned once, for `total` rows, and kept in the index.
    """
    n_shards = max(splits(rows), -(-total // SHARD_KEYS))
    return stored(_worked(None, _combined(rows, n_shards), n_shards, lambda s, r: s.insert(*r)), "digests")


def insert(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored index with more rows."""
    n = index.agg(F.max("n_shards")).first()[0] or 1
    return stored(_worked(index, _combined(rows, n), n, lambda s, r: s.insert(*r)), "digests")


def delete(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored index without these rows.  A digest that keeps rows keeps its smallest id, also if that row went."""
    n = index.agg(F.max("n_shards")).first()[0] or 1
    return stored(_worked(index, _combined(rows, n), n, lambda s, r: s.delete(r[0], r[2])), "digests")


def groups_of(index: DataFrame) -> DataFrame:
    """The stored keys: text_sha256, keep_id, group_size."""
    return index.filter(F.col("digest").isNotNull()).select(
        F.lower(F.hex("digest")).alias("text_sha256"), F.col("least_id").alias("keep_id"),
        F.col("n_rows").alias("group_size"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the smallest id stays, an id that is missing only where all are.  Null texts equal empty ones.  Of
    rows that repeat the id that stays, one is kept.  An empty table gives no rows.
    """
    rows = stored(digests(docs, id_col, text_col), "document-digests")
    total = rows.count()
    groups = groups_of(build_index(rows, total))
    found = join_groups(rows, groups, "text_sha256", "group_size", total, "doc_id")
    same_id = Window.partitionBy("text_sha256", "doc_id").orderBy("group_size")
    return found.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(same_id) == 1)).alias("kept"),
        "text_sha256")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat an id and a text, one."""
    rows = stored(digests(docs, id_col, text_col), "document-digests")
    groups = groups_of(build_index(rows, rows.count()))
    key, own = free_name(docs, "_digest"), free_name(docs, "_id")
    marked = docs.withColumn(
        key, F.sha2(F.encode(normalized(docs[text_col].cast("string")), "UTF-8"), 256)).withColumn(
        own, F.coalesce(docs[id_col].cast("string"), F.lit("")))
    stay = groups.select(F.col("text_sha256").alias(key), F.coalesce(F.col("keep_id").cast("string"), F.lit("")).alias(own))
    return marked.join(stay, [key, own], "left_semi").dropDuplicates([key, own]).select(*docs.columns)
