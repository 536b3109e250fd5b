"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors get one more component so that all have the same length; the largest inner product is then the smallest
distance.  Balanced k-means on a bounded sample gives the centroids of the lists.  Every vector goes to its nearest
centroid's list, and a vector near a border to further ones too, as long as none of the lists it has lies between.  The
centroids are linked to near ones as a graph, and a query walks the graph from list to list, taking those whose distance
is within a ratio of the nearest one's.  The ratio, and the number of centroids from which a walk starts, are measured on
some of the queries asked, against all vectors and through the walk itself, so that the wanted recall is met.  A task holds a
block of queries, each with a bit for every list it is looked up in, and streams lists past them; long lists are split.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauselake.llm.common import record_batch, stored

LIST_VECTORS = 256
"""Vectors that a posting list is planned for."""

MAX_LISTS = 4096
"""Centroids at most; lists grow beyond that and are split into blocks."""

SAMPLE_PER_LIST = 64
"""Sample vectors per centroid; at most MAX_LISTS * SAMPLE_PER_LIST vectors are fitted on."""

STEPS = 8
REPLICAS = 4
BORDER = 1.10
"""A vector also goes to lists whose centroid is at most this much farther than the nearest."""

DEGREE = 16
"""Links of each centroid."""

RECALL = 0.99
"""Share of the true neighbours of the probes that the walks must reach."""

PROBES = 256
"""Queries whose true neighbours are looked up among all vectors to measure the ratio."""

STARTS = 16
"""Centroids from which a walk starts; four times as many, up to all, while the probes' walks miss too much."""

BLOCK_QUERIES, QUERY_BYTES = 1 << 15, 16 << 20
"""Queries, and their bytes as doubles, that one task holds with the best found for each; more are dealt to several blocks."""

BLOCK_VECTORS = 4096
"""Vectors of a list that meet the queries at a time."""

PRODUCTS = 1 << 21
"""Products of queries and vectors that a task has at a time."""

HELD_HITS = 1_000_000
"""Hits that a task holds before it cuts them to the best of each query."""

HELD_ROWS = 1 << 16
"""Hits whose scores are summed at a time."""

WALKED = 512
"""Queries whose walks are taken together."""


@dataclass(frozen=True)
class Lists:
    """Centroids, their graph, the length of the longest vector, the ratio that selects lists, and where walks start.

    Vectors are divided by that length, and everything is in doubles: crowds may be far closer than they are long.
    """

    centroids: np.ndarray
    links: np.ndarray
    length: float
    ratio: float
    starts: np.ndarray

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the component that brings them to length one."""
        x = x.astype(np.float64) / self.length
        rest = np.sqrt(np.maximum(1.0 - (x**2).sum(axis=1), 0.0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def aimed(self, q: np.ndarray) -> np.ndarray:
        """Queries at length one; their own length does not change what is nearest."""
        q = q.astype(np.float64)
        q = q / np.abs(q).max(axis=1, keepdims=True)
        q = q / np.sqrt((q**2).sum(axis=1))[:, None]
        return np.concatenate([q, np.zeros((len(q), 1))], axis=1)

    def homes(self, lifted: np.ndarray) -> list[list[int]]:
        """The lists of each vector, nearest first."""
        out = []
        for part in range(0, len(lifted), 1024):
            apart = _distances(lifted[part: part + 1024], self.centroids)
            near = _least(apart, REPLICAS)
            for row, order in zip(apart, near.tolist()):
                chosen = order[:1]
                for c in order[1:]:
                    if row[c] > BORDER**2 * row[order[0]]:
                        break
                    if all(((self.centroids[c] - self.centroids[h]) ** 2).sum() >= row[c] for h in chosen):
                        chosen.append(c)
                out.append(chosen)
        return out

    def walks(self, aimed: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
        """Whether a query (row) is looked up in a list (column): the walks of many queries, taken in step.

        All walks go on from the centroids they have reached within the ratio, a link at a time; what a walk takes does not depend
        on the others.  Walks that hold less than `least` vectors are taken one by one.
        """
        out = np.zeros((len(aimed), len(self.centroids)), bool)
        for part in range(0, len(aimed), WALKED):
            some = aimed[part: part + WALKED]
            apart = _distances(some, self.centroids)
            seen, taken = np.zeros(apart.shape, bool), np.zeros(apart.shape, bool)
            seen[:, self.starts] = True
            best = apart[:, self.starts].min(axis=1)
            while True:
                query, at = np.nonzero(seen & ~taken & (apart <= (self.ratio**2 * 1.05 * best)[:, None]))
                if not len(query):
                    break
                taken[query, at] = True
                np.minimum.at(best, query, apart[query, at])
                for link in self.links.T:
                    seen[query, link[at]] = True
            taken &= apart <= (self.ratio**2 * best)[:, None]
            for i in np.flatnonzero(taken @ sizes < least):
                taken[i] = False
                taken[i, self.walk(some[i], sizes, least)] = True
            out[part: part + WALKED] = taken
        return out

    def walk(self, query: np.ndarray, sizes: np.ndarray, least: int) -> list[int]:
        """The lists that a query is looked up in: within the ratio, and further ones until `least` vectors are there."""
        seen = np.zeros(len(self.centroids), bool)
        seen[self.starts] = True
        todo = list(zip(((self.centroids[self.starts] - query) ** 2).sum(axis=1).tolist(), self.starts.tolist()))
        heapq.heapify(todo)
        best, taken, held = todo[0][0], [], 0.0
        while todo:
            apart, c = heapq.heappop(todo)
            if apart > self.ratio**2 * best * 1.05 and held >= least:
                break
            taken.append((apart, c))
            best = min(best, apart)
            held += sizes[c]
            fresh = self.links[c][~seen[self.links[c]]]
            seen[fresh] = True
            for d, n in zip(((self.centroids[fresh] - query) ** 2).sum(axis=1).tolist(), fresh.tolist()):
                heapq.heappush(todo, (d, n))
        out, held = [], 0.0
        for apart, c in sorted(taken):
            if apart > self.ratio**2 * best and held >= least:
                break
            out.append(c)
            held += sizes[c]
        return out


def _least(apart: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n least of each row, the least first."""
    if n < apart.shape[1]:
        near = np.sort(np.argpartition(apart, n - 1, axis=1)[:, :n], axis=1)
    else:
        near = np.broadcast_to(np.arange(apart.shape[1]), apart.shape)
    return np.take_along_axis(near, np.argsort(np.take_along_axis(apart, near, axis=1), axis=1, kind="stable"), axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1)[None, :], 0.0)


def balanced_centroids(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Centroids by k-means in which full lists are made to look farther."""
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), k, replace=False)]
    weight = np.ones(k)
    for _ in range(STEPS):
        owner = np.concatenate([
            (_distances(x[i: i + 512], centroids) * weight[None, :]).argmin(axis=1) for i in range(0, len(x), 512)])
        sizes = np.bincount(owner, minlength=k)
        sums = np.zeros((k, x.shape[1]))
        np.add.at(sums, owner, x)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
        weight = np.clip((sizes + 1) / (len(x) / k + 1), 0.8, 1.25) ** 0.2 * weight
    return centroids


def linked(centroids: np.ndarray) -> np.ndarray:
    """Up to DEGREE links per centroid: near ones that no nearer link covers, and a ring that reaches all."""
    k = len(centroids)
    links = np.empty((k, DEGREE + 2), np.int64)
    for c in range(k):
        apart = ((centroids - centroids[c]) ** 2).sum(axis=1)
        order = np.argsort(apart, kind="stable")
        chosen: list[int] = []
        for n in order[1: 4 * DEGREE].tolist():
            if len(chosen) < DEGREE and all(((centroids[n] - centroids[m]) ** 2).sum() > apart[n] for m in chosen):
                chosen.append(n)
        chosen += [int(n) for n in order[1: DEGREE + 1] if n not in chosen][: DEGREE - len(chosen)]
        ring = [(c + 1) % k, (c - 1) % k]
        links[c] = (chosen + ring + [ring[0]] * DEGREE)[: DEGREE + 2]
        links[c, -2:] = ring
    return links


def spread_out(centroids: np.ndarray, n: int) -> np.ndarray:
    """Up to n centroids, each the farthest from those before."""
    chosen = [0]
    apart = ((centroids - centroids[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(centroids)):
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, ((centroids - centroids[chosen[-1]]) ** 2).sum(axis=1))
        apart[chosen] = -1.0
    return np.array(chosen)


def fit(sample: np.ndarray, length: float, n_lists: int) -> Lists:
    """Lists from a sample; the ratio is still to be measured."""
    bare = Lists(np.zeros((1, sample.shape[1] + 1)), np.zeros((1, 1), np.int64), length, 1.0, np.zeros(1, np.int64))
    centroids = balanced_centroids(bare.lifted(sample), n_lists)
    return Lists(centroids, linked(centroids), length, 1.0, spread_out(centroids, STARTS))


def measured(lists: Lists, queries: np.ndarray, near: list[np.ndarray], sizes: np.ndarray, least: int, recall: float) -> Lists:
    """Lists with the ratio, and as many starts, that reach the wanted share of the queries' true neighbours (`near`)."""
    aimed = lists.aimed(queries)
    homes = [lists.homes(lists.lifted(vectors)) for vectors in near]
    ratios = []
    for row, found in zip(_distances(aimed, lists.centroids), homes):
        ratios += [row[h].min() / max(row.min(), 1e-300) for h in found]
    if not ratios:
        return lists
    out = replace(lists, ratio=max(1.0, float(np.sqrt(np.quantile(ratios, recall, method="higher"))) * (1 + 1e-9)))
    while True:
        walks = out.walks(aimed, sizes, least)
        hits = sum(bool(walk[h].any()) for walk, found in zip(walks, homes) for h in found)
        if hits >= recall * len(ratios) or len(out.starts) == len(out.centroids):
            return out
        out = replace(out, starts=spread_out(out.centroids, 4 * len(out.starts)))


def _packed(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """vec_id and packed components of the vectors that take part, and the numpy type of a component."""
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
        & F.exists("v", lambda c: c != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("vec_id", pa.int64()), ("size", pa.int32()), ("norm", pa.float64()), ("v", pa.binary())])
        for batch in batches:
            arrays = [np.asarray(x, kind) for x in batch.column("v").to_pylist()]
            yield record_batch(schema, vec_id=batch.column("vec_id"), size=list(map(len, arrays)),
                               norm=[_length(a.astype("<f8")) for a in arrays], v=[a.tobytes() for a in arrays])

    return stored(rows.mapInArrow(run, "vec_id long, size int, norm double, v binary"), "ann-vectors"), kind


def _length(x: np.ndarray) -> float:
    top = float(np.abs(x).max())
    return top * float(np.sqrt(((x / top) ** 2).sum()))


def _matrix(column: pa.Array | pa.ChunkedArray, kind: str, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dims)


def _best(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best hits of each query, each vector once: queries, vectors, scores."""
    query, vec, score = (np.concatenate(column) for column in zip(*held))
    order = np.lexsort((-score, vec, query))
    query, vec, score = query[order], vec[order], score[order]
    if not len(query):
        return query, vec, score
    first = np.append(True, (query[1:] != query[:-1]) | (vec[1:] != vec[:-1]))
    query, vec, score = query[first], vec[first], score[first]
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    heads = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
    place = np.arange(len(query)) - np.repeat(heads, np.diff(np.append(heads, len(query))))
    return query[place < k], vec[place < k], score[place < k]


def _neighbours(good: DataFrame, probes: list, kind: str, dims: int, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The probes, and the vectors of the k true neighbours of each among all rows, by one product with every row."""
    ids = np.array([r["vec_id"] for r in probes])
    x = np.frombuffer(b"".join(bytes(r["v"]) for r in probes), kind).reshape(-1, dims).astype(np.float64)
    shared = good.sparkSession.sparkContext.broadcast((ids, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("probe", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("v", pa.binary())])
        ids, x = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("vec_id").to_numpy()
            products = x @ _matrix(batch.column("v"), kind, dims).astype(np.float64).T
            products[ids[:, None] == own[None, :]] = -np.inf
            n = min(k, len(own))
            probe, at = np.repeat(np.arange(len(x)), n), np.argpartition(products, -n, axis=1)[:, -n:].ravel()
            other = products[probe, at] > -np.inf
            probe, at = probe[other], at[other]
            yield record_batch(schema, probe=probe, vec_id=own[at], score=products[probe, at], v=batch.column("v").take(pa.array(at)))

    best = Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id")
    found = good.mapInArrow(run, "probe long, vec_id long, score double, v binary").withColumn(
        "rank", F.row_number().over(best)).filter(F.col("rank") <= k).collect()
    near = [b"".join(bytes(r["v"]) for r in rows) for rows in (
        [r for r in found if r["probe"] == i] for i in range(len(probes)))]
    return x, [np.frombuffer(vectors, kind).reshape(-1, dims) for vectors in near]


def _sampled(good: DataFrame, n: int, total: int, kind: str, dims: int) -> np.ndarray:
    """The n vectors of least hash; rows whose hash is far too high for that are not ordered."""
    own = F.xxhash64("vec_id", "v")
    likely = 1.05 * n + 1000
    if likely < total:
        low = good.filter(own <= F.lit(int((likely / total - 0.5) * 2.0**64)))
        good = low if low.count() >= n else good
    return _matrix(good.orderBy(own, "vec_id").limit(n).select("v").toArrow().column("v"), kind, dims)


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20,
            recall: float = RECALL) -> DataFrame:
    """The k nearest found of each query, by inner product: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by `every`; candidates are all rows of other ids.  Scores are inner products
    in double precision, ties go to the smaller id.  Vectors that are null, empty, zero, hold a null or non-finite
    component, have another length than most, or have no id take no part.  Rows that share an id are one candidate
    with its best score.  If there are fewer than k candidates, all are returned; an empty table gives no rows.
    """
    packed, kind = _packed(vectors, id_col, vector_col)
    most = packed.groupBy("size").agg(F.count("*").alias("n"), F.max("norm").alias("norm")).orderBy(
        F.desc("n"), F.desc("size")).first()
    answer = "query_id long, rank int, vec_id long, score double"
    if most is None:
        return vectors.sparkSession.createDataFrame([], answer)
    dims, total, length = most["size"], most["n"], most["norm"]
    good = packed.filter(F.col("size") == dims).select("vec_id", "v")
    n_lists = max(1, min(MAX_LISTS, total // LIST_VECTORS))
    lists = fit(_sampled(good, n_lists * SAMPLE_PER_LIST, total, kind, dims), length, n_lists)
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(lists)  # MAX_LISTS centroids at most

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("list", pa.int32()), ("vec_id", pa.int64()), ("v", pa.binary())])
        for batch in batches:
            if batch.num_rows:
                homes = shared.value.homes(shared.value.lifted(_matrix(batch.column("v"), kind, dims)))
                rows = np.repeat(np.arange(batch.num_rows), [len(h) for h in homes])
                yield record_batch(schema, list=[c for h in homes for c in h],
                                   vec_id=batch.column("vec_id").take(pa.array(rows)), v=batch.column("v").take(pa.array(rows)))

    postings = stored(good.mapInArrow(post, "list int, vec_id long, v binary"), "ann-postings")
    sizes, held = np.zeros(len(lists.centroids), np.int64), np.zeros(len(lists.centroids))
    # the postings of an id count one in all, so lists that hold so much have as many ids at least
    copies = postings.groupBy("vec_id", "list").agg(F.count("*").alias("n")).withColumn(
        "all", F.sum("n").over(Window.partitionBy("vec_id")))
    for r in copies.groupBy("list").agg(F.sum("n").alias("n"), F.sum(F.col("n") / F.col("all")).alias("ids")).collect():
        sizes[r["list"]], held[r["list"]] = r["n"], r["ids"]
    least = 8 * REPLICAS * (k + 1)
    queries = good.filter(F.col("vec_id") % every == 0)
    probes = queries.orderBy(F.xxhash64("v", "vec_id"), "vec_id").limit(PROBES).collect()
    if probes:
        lists = measured(lists, *_neighbours(good, probes, kind, dims, k), held, least, recall)
    shared_aim = spark.sparkContext.broadcast((lists, held))

    n_lists = len(lists.centroids)

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("vec_id", pa.int64()), ("v", pa.binary()), ("walk", pa.binary())])
        for batch in batches:
            if batch.num_rows:
                lists, held = shared_aim.value
                walks = np.packbits(lists.walks(lists.aimed(_matrix(batch.column("v"), kind, dims)), held, least), axis=1)
                yield record_batch(schema, vec_id=batch.column("vec_id"), v=batch.column("v"), walk=[w.tobytes() for w in walks])

    # a bit for each list: a row for each list of a query would grow with the square of the vectors
    asked = stored(queries.dropDuplicates(["vec_id", "v"]).mapInArrow(aim, "vec_id long, v binary, walk binary"), "ann-queries")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, counts = 0, np.zeros(n_lists, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, WALKED):
                counts += _bits(batch.column("walk").slice(at, WALKED), n_lists).sum(axis=0)
            n += batch.num_rows
        yield record_batch(pa.schema([("list", pa.int32()), ("n", pa.int64())]), list=[-1, *range(n_lists)], n=[n, *counts])

    counts = np.zeros(n_lists + 1, np.int64)
    for r in asked.mapInArrow(count, "list int, n long").groupBy("list").agg(F.sum("n").alias("n")).collect():
        counts[r["list"]] = r["n"]  # the queries themselves at the end
    blocks = max(1, -(-int(counts[-1]) // max(1, min(BLOCK_QUERIES, QUERY_BYTES // (8 * dims)))))
    groups = spark.sparkContext.defaultParallelism
    dealt_to = _dealt(sizes * counts[:-1], groups)
    members = [np.array(sorted({c for c, to in dealt_to.items() if g in to}), np.int64) for g in range(groups)]
    shared_members = spark.sparkContext.broadcast(members)
    met = "cell int, list int, vec_id long, v binary, walk binary"
    # a long list is dealt to several groups
    own = F.xxhash64("vec_id", "v")
    to = spark.createDataFrame([(c, to) for c, to in dealt_to.items()], "list int, groups array<int>")
    placed = postings.join(F.broadcast(to), "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        (F.col("block") * groups + F.get("groups", F.pmod(own, F.size("groups")).cast("int"))).cast("int").alias("cell"),
        "list", "vec_id", "v", F.lit(None).cast("binary").alias("walk"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cell", pa.int32()), ("list", pa.int32()), ("vec_id", pa.int64()), ("v", pa.binary()), ("walk", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, WALKED):
                some = batch.slice(at, WALKED)
                walks, block = _bits(some.column("walk"), n_lists), some.column("block").to_numpy()
                for g, lists in enumerate(shared_members.value):
                    mine = walks[:, lists]
                    rows = np.flatnonzero(mine.any(axis=1))
                    if len(rows):
                        yield record_batch(
                            schema, cell=block[rows] * groups + g, list=np.full(len(rows), -1),
                            vec_id=some.column("vec_id").take(pa.array(rows)), v=some.column("v").take(pa.array(rows)),
                            walk=[w.tobytes() for w in np.packbits(mine[rows], axis=1)])

    placed = placed.unionByName(asked.withColumn("block", F.pmod(own, F.lit(blocks)).cast("int")).mapInArrow(ask, met))
    # all queries of a cell come before its lists
    streams = placed.repartitionById(blocks * groups, F.col("cell")).sortWithinPartitions("cell", "list")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        cell, asked, best = None, [], None
        for batch in batches:
            at, of = batch.column("cell").to_numpy(), batch.column("list").to_numpy()
            cuts = np.flatnonzero((at[1:] != at[:-1]) | (of[1:] != of[:-1])) + 1
            cuts = np.union1d(cuts, np.arange(0, batch.num_rows, BLOCK_VECTORS)).tolist()
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                if at[a] != cell:
                    if best is not None:
                        yield record_batch(schema, **best.rows())
                    cell, asked, best = at[a], [], None
                some = batch.slice(a, b - a)
                if of[a] < 0:
                    asked.append(some)
                elif asked:
                    best = best or _Best(pa.Table.from_batches(asked), shared_members.value[cell % groups], kind, dims, k)
                    best.meet(of[a], some.column("vec_id").to_numpy(), _matrix(some.column("v"), kind, dims).astype(np.float64))
        if best is not None:
            yield record_batch(schema, **best.rows())

    # dealt by query once, for both the rows of an id and the ranks
    found = streams.mapInArrow(search, "query_id long, vec_id long, score double").repartition("query_id").groupBy(
        "query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _bits(column: pa.Array, n: int) -> np.ndarray:
    """Rows of packed bits as a matrix of n columns."""
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.unpackbits(packed, axis=1, count=n).view(bool)


def _dealt(load: np.ndarray, groups: int) -> dict[int, list[int]]:
    """The groups of each list that is looked up: the heaviest first to the lightest group; one over the mean is dealt to several."""
    share = max(1.0, load.sum() / groups)
    pieces = sorted(((load[c] / n, int(c)) for c in np.flatnonzero(load) for n in [min(groups, int(-(-load[c] // share)))]
                     for _ in range(n)), key=lambda x: (-x[0], x[1]))
    heap, out = [(0.0, g) for g in range(groups)], {}
    for size, c in pieces:
        done, g = heapq.heappop(heap)
        out.setdefault(c, []).append(g)
        heapq.heappush(heap, (done + size, g))
    return out


class _Best:
    """The queries of a cell, and the best vectors so far of each."""

    def __init__(self, asked: pa.Table, lists: np.ndarray, kind: str, dims: int, k: int):
        self.k, self.ids = k, asked.column("vec_id").to_numpy()
        self.x = _matrix(asked.column("v"), kind, dims).astype(np.float64)
        self.walks = np.frombuffer(b"".join(asked.column("walk").to_pylist()), np.uint8).reshape(len(self.ids), -1)
        self.place = {int(c): i for i, c in enumerate(lists)}
        self.floor = np.full(len(self.ids), -np.inf)
        self.held, self.size, self.kept = [], 0, 0

    def meet(self, c: int, own: np.ndarray, x: np.ndarray) -> None:
        """Vectors of a list against the queries that look into it."""
        at = self.place[int(c)]
        queries = np.flatnonzero(self.walks[:, at >> 3] & (128 >> (at & 7)))
        by_id = np.argsort(own, kind="stable")
        own, x = own[by_id], x[by_id]
        heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        step = max(1, PRODUCTS // len(own))
        for start in range(0, len(queries), step):
            self._meet(queries[start: start + step], own, x, heads)

    def _meet(self, queries: np.ndarray, own: np.ndarray, x: np.ndarray, heads: np.ndarray) -> None:
        products = self.x[queries] @ x.T
        floor = self.floor[queries]
        near = products >= (floor - 1e-9 * np.maximum(1.0, np.abs(floor)))[:, None]
        low = np.searchsorted(own, self.ids[queries])
        for i in np.flatnonzero(own[np.minimum(low, len(own) - 1)] == self.ids[queries]):
            same = slice(low[i], np.searchsorted(own, self.ids[queries[i]], "right"))
            products[i, same], near[i, same] = -np.inf, False
        many = np.flatnonzero(near.sum(axis=1) > 2 * self.k)
        if len(many) and len(heads) > self.k:
            each = products[many] if len(heads) == len(own) else np.maximum.reduceat(products[many], heads, axis=1)  # rows of one id are one candidate
            cut = np.partition(each, each.shape[1] - self.k, axis=1)[:, each.shape[1] - self.k]
            near[many] &= products[many] >= (cut - 1e-9 * np.maximum(1.0, np.abs(cut)))[:, None]
        i, j = np.nonzero(near)
        for a in range(0, len(i), HELD_ROWS):
            row, col = queries[i[a: a + HELD_ROWS]], j[a: a + HELD_ROWS]
            scores = (x[col] * self.x[row]).sum(axis=1)  # the same sum for equal vectors, so ties are ties
            self.held.append((row, own[col], scores))
            self.size += len(row)
            if self.size > self.kept + HELD_HITS:
                self._cut()

    def _cut(self) -> None:
        query, vec, score = best = _best(self.held, self.k)
        self.held, self.size, self.kept = [best], len(query), len(query)
        ends = np.searchsorted(query, np.arange(len(self.ids)), "right")
        full = np.flatnonzero(np.diff(ends, prepend=0) == self.k)
        self.floor[full] = score[ends[full] - 1]

    def rows(self) -> dict[str, np.ndarray]:
        """The best vectors of each query."""
        if not self.held:
            return {"query_id": [], "vec_id": [], "score": []}
        self._cut()
        query, vec, score = self.held[0]
        return {"query_id": self.ids[query], "vec_id": vec, "score": score}
