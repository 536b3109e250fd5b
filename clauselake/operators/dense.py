"""Exact nearest neighbours by blocked matrix products, and text vectors."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.operators.lexical import Store, term_counts
from clauselake.operators.scale import top_k

# the classes below travel with the plan, so that executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PACK_ROWS = 2048
"""Vectors per packed block."""

BROADCAST_BYTES = 64 << 20
"""Query vectors up to this size are sent to every task; more are joined block by block."""

SLACK = 1e-12
"""By how much a product of blocks may differ from the sum that ranks."""

BLOCK_ROWS, PART_BYTES = 4096, 32 << 20
"""Vectors per stored block, and bytes of blocks that a task holds of the corpus."""

PRODUCTS, CHECKED = 1 << 21, 1 << 14
"""Products that a task has at a time, and pairs whose buckets it compares at a time."""


def _packs(df: DataFrame, id_col: str, vec_col: str, part_col: str | None) -> DataFrame:
    """Rows (part, cell, ids, mat): unit vectors of up to PACK_ROWS rows of one part as one binary block."""
    id_type = df.schema[id_col].dataType.simpleString()
    part_type = df.schema[part_col].dataType.simpleString() if part_col else "int"
    picked = df.select(
        (F.col(part_col) if part_col else F.lit(0)).alias("part"), F.col(id_col).alias("id"),
        F.col(vec_col).cast("array<double>").alias("vec"),
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, group in batch.groupby("part", sort=True):
                for at in range(0, len(group), PACK_ROWS):
                    some = group.iloc[at : at + PACK_ROWS]
                    mat = np.vstack(some["vec"].to_list()).astype("float64")
                    norms = np.linalg.norm(mat, axis=1, keepdims=True)
                    mat = np.divide(mat, norms, out=np.zeros_like(mat), where=norms > 0)
                    yield pd.DataFrame(
                        {
                            "part": [part], "cell": [0], "ids": [some["id"].to_list()], "mat": [mat.tobytes()],
                        }
                    )

    return picked.mapInPandas(pack, f"part {part_type}, cell int, ids array<{id_type}>, mat binary")


def nearest(
    corpus: DataFrame | Blocks, queries: DataFrame | Blocks, k: int, corpus_id: str = "vec_id", query_id: str = "query_id",
    vec_col: str = "embedding", part_col: str | None = None,
) -> DataFrame:
    """(query, id, score, rank): the k corpus vectors of largest cosine per query, exactly.

    Both sides travel as packed blocks, so one row stands for thousands of vectors and a product of two blocks
    yields only its own top k.  With part_col a query meets only vectors of its part; a large part is many
    blocks, so it spreads over tasks.  Few queries are broadcast; many are joined cell by cell, each cell of
    the corpus meeting every query block once.  Full doubles are ranked; equal scores fall back to the id.  Stored blocks of
    both sides meet where they are.
    """
    if isinstance(corpus, Blocks):
        found = best_in_blocks(corpus, queries, k)
        return top_k(found, [queries.id_col], [F.col("score").desc(), F.col(corpus.id_col)], k)
    spark = corpus.sparkSession
    n_queries = queries.select(F.lit(1)).count()
    dim = queries.select(F.size(vec_col).alias("n")).limit(1).collect()
    small = n_queries * (dim[0]["n"] if dim else 0) * 8 <= BROADCAST_BYTES
    cells = 1 if small else spark.sparkContext.defaultParallelism
    left = _packs(corpus, corpus_id, vec_col, part_col)
    if cells > 1:
        left = left.withColumn("cell", F.pmod(F.xxhash64("ids"), F.lit(cells)).cast("int"))
    right = (
        _packs(queries, query_id, vec_col, part_col)
        .withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
        .select("part", "cell", F.col("ids").alias("qids"), F.col("mat").alias("qmat"))
    )
    # Spark sizes the blocks by their scan, far too low, and would broadcast them
    pairs = left.join(F.broadcast(right) if small else right.hint("merge"), ["part", "cell"]).select("ids", "mat", "qids", "qmat")
    id_type = corpus.schema[corpus_id].dataType.simpleString()
    qid_type = queries.schema[query_id].dataType.simpleString()

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, mat, qids, qmat in zip(batch["ids"], batch["mat"], batch["qids"], batch["qmat"]):
                ids, qids = np.asarray(ids), np.asarray(qids)
                rows = np.frombuffer(mat, dtype="float64").reshape(len(ids), -1)
                wanted = np.frombuffer(qmat, dtype="float64").reshape(len(qids), -1)
                order = np.argsort(ids, kind="stable")
                ids, rows = ids[order], rows[order]
                products = wanted @ rows.T
                n = min(k, len(ids))
                cut = np.partition(products, len(ids) - n, axis=1)[:, len(ids) - n]
                at, near = np.nonzero(products >= cut[:, None] - SLACK)
                # the same sum wherever two vectors meet, so equal vectors tie
                scores = (wanted[at] * rows[near]).sum(axis=1)
                best = np.lexsort((near, -scores, at))
                place = np.arange(len(at)) - np.searchsorted(at[best], at[best])
                best = best[place < k]
                yield pd.DataFrame({"q": qids[at[best]], "id": ids[near[best]], "score": scores[best]})

    found = pairs.mapInPandas(product, f"q {qid_type}, id {id_type}, score double").select(
        F.col("q").alias(query_id), F.col("id").alias(corpus_id), "score"
    )
    return top_k(found, [query_id], [F.col("score").desc(), F.col(corpus_id)], k)


def nearest_any(
    corpus: DataFrame, queries: DataFrame, k: int, code_col: str, codes_col: str, corpus_id: str = "vec_id",
    query_id: str = "query_id", vec_col: str = "embedding",
) -> DataFrame:
    """As nearest, among the vectors whose code is any of those that a query lists."""
    each = queries.select(query_id, vec_col, F.explode(F.array_distinct(codes_col)).alias("_code"))
    return nearest(corpus.withColumn("_code", F.col(code_col)), each, k, corpus_id, query_id, vec_col, "_code")


@dataclass
class Blocks:
    """Vectors as rows (no, ids, mat) of up to BLOCK_ROWS vectors, in the type and under the name of their ids."""

    frame: DataFrame
    id_col: str
    id_type: str
    kind: str

    def named(self, id_col: str) -> Blocks:
        """The same blocks, their ids under another name."""
        return Blocks(self.frame, id_col, self.id_type, self.kind)


def blocks(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", store: Store | None = None) -> Blocks:
    """Vectors as blocks; with `store`, which writes a frame and reads it again, they are packed once for all that read them."""
    single = df.schema[vec_col].dataType.simpleString() == "array<float>"
    id_type = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col).alias("id"), (F.col(vec_col) if single else F.col(vec_col).cast("array<double>")).alias("vec"))
    cores = df.sparkSession.sparkContext.defaultParallelism
    if picked.rdd.getNumPartitions() < cores:
        picked = picked.repartition(cores)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("vec")
            if lists.null_count or lists.flatten().null_count or pc.count_distinct(pc.list_value_length(lists)).as_py() > 1:
                raise ValueError("vectors must have one length and no nulls")
            mat = lists.flatten().to_numpy().reshape(batch.num_rows, -1)
            at = range(0, batch.num_rows, BLOCK_ROWS)
            ids = pa.ListArray.from_arrays(pa.array([*at, batch.num_rows], pa.int32()), batch.column("id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array([mat[a: a + BLOCK_ROWS].tobytes() for a in at], pa.binary())], names=["ids", "mat"])

    packs = picked.mapInArrow(pack, f"ids array<{id_type}>, mat binary").select(F.monotonically_increasing_id().alias("no"), "ids", "mat")
    return Blocks(store(packs) if store else packs, id_col, id_type, "<f4" if single else "<f8")


@dataclass
class Hashing:
    """Random projections: a vector's bucket in a table is the signs of its projections; the planes come from a fixed seed."""

    tables: int
    bits: int
    probes: int

    def buckets(self, x: np.ndarray, probes: int) -> np.ndarray:
        """Buckets of vectors (row, table, probe).  Further probes turn the signs whose projections are nearest to zero."""
        planes = np.random.default_rng(7).normal(size=(self.tables, x.shape[1], self.bits))
        out = np.empty((len(x), self.tables, probes), np.int64)
        for t in range(self.tables):
            at = x @ planes[t]
            out[:, t, 0] = (at > 0) @ (1 << np.arange(self.bits))
            order = np.argsort(np.abs(at), axis=1)
            for p in range(1, probes):
                out[:, t, p] = out[:, t, 0] ^ (1 << order[:, p - 1])
        return out


def best_in_blocks(corpus: Blocks, queries: Blocks, k: int, hashing: Hashing | None = None) -> DataFrame:
    """(query, id, score): the k best of each query in each part of the corpus; with `hashing`, of those that share a bucket.

    Each block of queries meets each block of the corpus where they are stored, so no copy of a vector is shuffled.  A task holds
    one block of queries and its best so far, and PART_BYTES of the corpus, so few rows move on.
    """
    size = corpus.frame.agg(F.sum(F.octet_length("mat"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    left = queries.frame.select(F.col("no").alias("q_no"), F.col("ids").alias("q_ids"), F.col("mat").alias("q_mat"))
    right = corpus.frame.select("ids", "mat").coalesce(parts)
    pairs = left.hint("shuffle_replicate_nl").crossJoin(right)
    kinds = queries.kind, corpus.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                no = batch.column("q_no")[i].as_py()
                if no != at:
                    if best is not None:
                        yield best.rows()
                    at, best = no, _Best(k, hashing, *_block(batch, i, "q_ids", "q_mat", kinds[0]))
                best.meet(*_block(batch, i, "ids", "mat", kinds[1]))
        if best is not None:
            yield best.rows()

    return pairs.mapInArrow(run, f"q {queries.id_type}, id {corpus.id_type}, score double").select(
        F.col("q").alias(queries.id_col), F.col("id").alias(corpus.id_col), "score")


def _block(batch: pa.RecordBatch, i: int, ids: str, mat: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block."""
    own = batch.column(ids)[i].values.to_numpy(zero_copy_only=False)
    return own, np.frombuffer(batch.column(mat)[i].as_buffer(), kind).reshape(len(own), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


class _Best:
    """A block of queries and the best k vectors so far of each.

    Products in single precision leave out what is surely too low; the scores of the others are sums in doubles, the same wherever
    two vectors meet, so equal vectors tie.
    """

    def __init__(self, k: int, hashing: Hashing | None, ids: np.ndarray, x: np.ndarray):
        self.k, self.hashing, self.ids, self.unit = k, hashing, ids, _unit(x)
        self.single = self.unit.astype(np.float32)
        self.probed = hashing and hashing.buckets(x, hashing.probes)
        self.slack = 2 * (x.shape[1] + 8) * 6e-8
        self.floor = np.full(len(ids), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        """A block of the corpus against all queries."""
        unit = _unit(x)
        block = ids, unit, unit.astype(np.float32)
        # rows of one id are one hit where buckets are shared, so a cut by rows could leave too few
        cut = self.hashing is None or len(set(ids.tolist())) == len(ids)
        rows, cols = np.arange(len(self.ids)), np.arange(len(ids))
        if self.hashing is None:
            self._meet(*block, rows, cols, cut)
        else:
            own = self.hashing.buckets(x, 1)[:, :, 0]
            shared = [pair for t in range(own.shape[1]) for pair in _sharing(self.probed[:, t], own[:, t])]
            if sum(len(q) * len(c) for q, c in shared) < len(rows) * len(cols):
                for q, c in shared:
                    self._meet(*block, q, c, cut)
            else:  # buckets overlap so much that all pairs once are fewer products
                self._meet(*block, rows, cols, cut, own)
        self._cut()

    def _share(self, rows: np.ndarray, cols: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Whether pairs share a bucket."""
        out = np.zeros(len(rows), bool)
        for a in range(0, len(rows), CHECKED):
            some = slice(a, a + CHECKED)
            out[some] = (self.probed[rows[some]] == own[cols[some]][:, :, None]).any(axis=(1, 2))
        return out

    def _meet(self, ids: np.ndarray, unit: np.ndarray, single: np.ndarray, rows: np.ndarray, cols: np.ndarray, cut: bool,
              own: np.ndarray | None = None) -> None:
        k, step = self.k, max(1, PRODUCTS // len(cols))
        for a in range(0, len(rows), step):
            q = rows[a: a + step]
            products = self.single[q] @ single[cols].T
            near = products >= (self.floor[q] - self.slack).astype(np.float32)[:, None]
            many = np.flatnonzero(np.count_nonzero(near, axis=1) > 2 * k) if cut else []
            if len(many):
                top = products[many]
                n = min(4 * k, len(cols))
                if own is None:
                    floor = np.partition(top, len(cols) - k, axis=1)[:, len(cols) - k]
                else:  # the k-th best of the first that share a bucket, if so many do
                    first = np.argpartition(top, len(cols) - n, axis=1)[:, len(cols) - n:]
                    share = self._share(np.repeat(q[many], n), cols[first].ravel(), own).reshape(first.shape)
                    found = np.where(share, np.take_along_axis(top, first, axis=1), -np.inf)
                    floor = np.partition(found, n - k, axis=1)[:, n - k]
                near[many] &= top >= (floor - self.slack).astype(np.float32)[:, None]
            i, j = np.nonzero(near)
            for b in range(0, len(i), 1 << 16):
                row, col = q[i[b: b + (1 << 16)]], cols[j[b: b + (1 << 16)]]
                if own is not None:
                    share = self._share(row, col, own)
                    row, col = row[share], col[share]
                self.held.append((row, ids[col], (self.unit[row] * unit[col]).sum(axis=1)))
                if sum(len(x[0]) for x in self.held[1:]) > 1 << 20:
                    self._cut()

    def _cut(self) -> None:
        if not self.held:
            return
        q, ids, score = (np.concatenate(column) for column in zip(*self.held))
        by_id = np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids
        if self.hashing is not None:  # a pair may share several buckets, and an id have several rows
            order = np.lexsort((-score, by_id, q))
            order = order[np.append(True, (np.diff(q[order]) != 0) | (np.diff(by_id[order]) != 0))] if len(order) else order
            q, ids, score, by_id = q[order], ids[order], score[order], by_id[order]
        order = np.lexsort((by_id, -score, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        order = order[place < self.k]
        self.held = [(q[order], ids[order], score[order])]
        ends = np.searchsorted(q[order], np.arange(len(self.ids)), "right")
        full = np.flatnonzero(np.diff(ends, prepend=0) == self.k)
        self.floor[full] = score[order][ends[full] - 1]

    def rows(self) -> pa.RecordBatch:
        self._cut()
        q, ids, score = self.held[0] if self.held else (np.zeros(0, np.int64), self.ids[:0], np.zeros(0))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(ids), pa.array(score)], names=["q", "id", "score"])


def _sharing(probed: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of queries (with all their probes) and of vectors by the buckets of a table that have both."""
    order, flat = np.argsort(own, kind="stable"), probed.ravel()
    by_bucket = np.argsort(flat, kind="stable")
    values, starts = np.unique(own[order], return_index=True)
    ends = np.append(starts[1:], len(own))
    low, high = np.searchsorted(flat[by_bucket], values), np.searchsorted(flat[by_bucket], values, "right")
    for i in np.flatnonzero(high > low):
        yield by_bucket[low[i]: high[i]] // probed.shape[1], order[starts[i]: ends[i]]


def lsh_nearest(
    corpus: DataFrame | Blocks, queries: DataFrame | Blocks, k: int, tables: int = 16, bits: int = 5, probes: int = 6,
    corpus_id: str = "vec_id", query_id: str = "query_id", vec_col: str = "embedding",
) -> DataFrame:
    """(query, id, score, rank): the k nearest by cosine that share a bucket with the query in one of the hash tables.

    Vectors meet in blocks; inside two blocks only those that share a bucket are compared, unless that takes more products than
    there are pairs.  More bits make buckets smaller, more tables and probes find more.
    """
    left = corpus if isinstance(corpus, Blocks) else blocks(corpus, corpus_id, vec_col)
    right = queries if isinstance(queries, Blocks) else blocks(queries, query_id, vec_col)
    found = best_in_blocks(left, right, k, Hashing(tables, bits, probes)).groupBy(right.id_col, left.id_col).agg(F.max("score").alias("score"))
    return top_k(found, [right.id_col], [F.col("score").desc(), F.col(left.id_col)], k)


def hash_bucket(term: Column, dim: int) -> Column:
    """Bucket of a word from its md5 digest, so that any engine finds the same one."""
    return (F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long") % dim).cast("int")


def hashed_vectors(docs: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """(id, bucket, weight): word counts folded into dim buckets, unit length; the offline text encoder."""
    folded = (
        term_counts(docs, [id_col], text_col).withColumn("bucket", hash_bucket(F.col("term"), dim))
        .groupBy(id_col, "bucket").agg(F.sum("tf").cast("double").alias("w"))
    )
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return folded.select(id_col, "bucket", (F.col("w") / length).alias("weight"))


def encode(
    df: DataFrame, id_col: str, text_col: str, encoder: Callable[[list[str]], np.ndarray], batch: int = 32
) -> DataFrame:
    """(id, embedding) from a model given as a function of a batch of texts.

    Texts are range-spread and sorted by length first so that each batch holds texts of similar length.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.length(text_col).alias("n"))
    parts = df.sparkSession.sparkContext.defaultParallelism
    bucketed = picked.repartitionByRange(parts, "n", "id").sortWithinPartitions("n", "id").drop("n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                some = pdf.iloc[at : at + batch]
                vectors = np.asarray(encoder(some["text"].fillna("").to_list()), dtype="float32")
                if len(vectors) != len(some):
                    raise ValueError(f"{len(some)} texts gave {len(vectors)} vectors")
                yield pd.DataFrame({id_col: some["id"].to_list(), "embedding": list(vectors)})

    return bucketed.mapInPandas(run, f"`{id_col}` {id_type}, embedding array<float>")


def key_audit(chunks: DataFrame, vectors: DataFrame, chunk_id: str, vec_id: str) -> DataFrame:
    """How many keys are on both sides, only in the chunks, only in the vectors."""
    left = chunks.select(F.col(chunk_id).alias("id")).distinct().withColumn("_c", F.lit(1))
    right = vectors.select(F.col(vec_id).alias("id")).distinct().withColumn("_v", F.lit(1))
    return left.join(right, "id", "full_outer").agg(
        F.count_if(F.col("_c").isNotNull() & F.col("_v").isNotNull()).alias("n_both"),
        F.count_if(F.col("_v").isNull()).alias("n_chunk_only"),
        F.count_if(F.col("_c").isNull()).alias("n_vector_only"),
    )
