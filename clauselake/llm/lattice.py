"""Near duplicates of vectors by lattice hashing: random projections decoded to points of the E8 lattice.

A table projects unit vectors to a few blocks of eight places, shifts and scales them, and decodes every block to its
nearest E8 point; the points of all blocks are the cell of the vector.  A vector lies in its home cell and probes the
neighbouring cells that are nearest to it, one lattice step away in one block.  Two vectors meet in a table if one is at
home in a cell that the other is in or probes.  There are as many tables as it takes for a pair at the threshold to be
missed with a chance below MISS, measured on random pairs at that threshold; the scale grows with the number of vectors.

Cells may hold a large group.  Equal vectors are one node.  A node close enough to the least node of a crowded cell joins its
ball: two nodes of a ball are within the threshold for sure, so they are counted without a comparison.  Only nodes of
different balls are compared, block by block, and a pair counts in the first cell in which it meets, so it counts once
without being written out.  What leaves a comparison is a number per node and the components of its links.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.common import grouped, join_groups, record_batch, stored
from clauselake.llm.neardup import components

DIMS = 8
PROBES = 4
MISS = 1e-3
"""Chance that a pair at the threshold meets in no table."""

MOST_TABLES = 255

LAYOUTS = ((20_000, 2, 1.6), (200_000, 2, 1.9), (2_000_000, 3, 1.9), (20_000_000, 3, 2.2), (math.inf, 3, 2.6))
"""Up to how many vectors a cell has so many blocks of eight places, at such a scale: more vectors, smaller cells."""

CROWDED = 64
"""Vectors in a cell from which on balls are made of them."""

SMALL = 1024
"""Vectors in a cell that are compared at once; more are compared in blocks."""

BLOCK, SLICE = 512, 4096
GRID = float(1 << 20)
"""Projections are rounded to so many parts, so that they do not depend on the batch they are computed in."""

SEED = 20240811
CHUNK = 256


@lru_cache(maxsize=1)
def steps() -> np.ndarray:
    """The 240 shortest vectors of E8: two places of one, or all of a half with an even number of minus signs."""
    found = []
    for i, j in itertools.combinations(range(DIMS), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            found.append([s if k == i else t if k == j else 0.0 for k in range(DIMS)])
    found += [list(v) for v in itertools.product((0.5, -0.5), repeat=DIMS) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(found)


def _even(y: np.ndarray) -> np.ndarray:
    """The nearest points with whole places and an even sum."""
    x = np.rint(y)
    odd = np.flatnonzero(x.sum(axis=1) % 2)
    off = y[odd] - x[odd]
    worst = np.abs(off).argmax(axis=1)
    row = np.arange(len(odd))
    x[odd, worst] += np.where(off[row, worst] >= 0, 1.0, -1.0)
    return x


def decoded(y: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the nearer one of the two cosets of whole and half places."""
    a, b = _even(y), _even(y - 0.5) + 0.5
    near = ((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1)
    return np.where(near[:, None], a, b)


class Tables:
    """All tables for vectors of one length."""

    def __init__(self, size: int, blocks: int, scale: float, n_tables: int):
        self.blocks, self.n_tables = blocks, n_tables
        places = DIMS * blocks
        rng = np.random.default_rng([SEED, size, blocks])
        self._projections = []
        for _ in range(n_tables):
            # orthogonal columns; lengths are kept on average, or exactly if there are as many places as components
            q, _ = np.linalg.qr(rng.normal(size=(max(size, places), places)))
            self._projections.append(q[:size] * (scale * math.sqrt(max(size, places) / places)))
        self._projections = np.concatenate(self._projections, axis=1)
        self._shift = rng.uniform(0, 2, n_tables * places)
        self._weights = rng.integers(0, 1 << 63, (n_tables, blocks, DIMS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        moves = (2 * steps()).astype(np.int64).view(np.uint64)
        self._moves = (moves[None, None, :, :] * self._weights[:, :, None, :]).sum(axis=3, dtype=np.uint64)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Per unit vector and table the key of the home cell, then those of the probed cells; the low byte is the table."""
        return np.concatenate([np.zeros((0, self.n_tables, PROBES + 1), np.int64),
                               *[self._keys(x[i: i + CHUNK]) for i in range(0, len(x), CHUNK)]])

    def _keys(self, x: np.ndarray) -> np.ndarray:
        n, t, m = len(x), self.n_tables, self.blocks
        y = (np.rint((x @ self._projections + self._shift) * GRID) / GRID).reshape(-1, DIMS)
        points = decoded(y)
        cell = (2 * points).astype(np.int64).view(np.uint64).reshape(n, t, m, DIMS)
        home = (cell * self._weights[None]).sum(axis=(2, 3), dtype=np.uint64)
        nearer = ((y - points) @ steps().T).reshape(n, t, m * len(steps()))  # sums of dyadic numbers: exact
        chosen = np.argpartition(-nearer, PROBES, axis=2)[:, :, :PROBES]
        table = np.arange(t)[None, :, None]
        probed = home[:, :, None] + self._moves[table, chosen // len(steps()), chosen % len(steps())]
        keys = np.concatenate([home[:, :, None], probed], axis=2)
        keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((keys & np.uint64(0xFFFFFFFFFFFFFF00)) | table.astype(np.uint64)).view(np.int64)


@lru_cache(maxsize=8)
def tables(size: int, blocks: int, scale: float, threshold: float) -> Tables:
    """As many tables as a pair at the threshold needs, by the share of random such pairs that meet in a table."""
    rng = np.random.default_rng(SEED + 1)
    a = rng.normal(size=(2048, size))
    a /= np.linalg.norm(a, axis=1)[:, None]
    c = rng.normal(size=a.shape)
    c -= (a * c).sum(axis=1)[:, None] * a
    length = np.linalg.norm(c, axis=1)[:, None]
    b = a if size == 1 else threshold * a + math.sqrt(1 - threshold**2) * c / length
    trial = Tables(size, blocks, scale, 4)
    p, q = trial.keys(a), trial.keys(b)
    meet = float(((p == q[:, :, :1]).any(axis=2) | (q == p[:, :, :1]).any(axis=2)).mean())
    needed = 1 if meet >= 1 else math.ceil(math.log(MISS) / math.log1p(-meet)) if meet > 0 else MOST_TABLES
    return Tables(size, blocks, scale, min(MOST_TABLES, needed))


def layout(n: int) -> tuple[int, float]:
    """Blocks and scale for so many vectors."""
    return next((blocks, scale) for most, blocks, scale in LAYOUTS if n <= most)


def _units(column: pa.Array | pa.ChunkedArray, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of vectors of the same length, and these as unit vectors in double precision."""
    data = column.to_pylist()
    width = np.dtype(kind).itemsize
    sizes = np.array([len(d) // width for d in data])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        x = np.frombuffer(b"".join(data[i] for i in rows), kind).reshape(-1, size).astype(np.float64)
        x /= np.abs(x).max(axis=1)[:, None]  # squares of very large or small components stay finite
        yield rows, x / np.sqrt((x * x).sum(axis=1))[:, None]


def _keyed(nodes: DataFrame, kind: str, blocks: int, scale: float, threshold: float) -> DataFrame:
    """key, node and home of every cell that a node is in or probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("home", pa.bool_())])
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy()
            for rows, x in _units(batch.column("v"), kind):
                own = tables(x.shape[1], blocks, scale, threshold)
                for i in range(0, len(rows), CHUNK):
                    keys = own.keys(x[i: i + CHUNK])
                    yield record_batch(schema, key=keys.ravel(), node=np.repeat(node[rows[i: i + CHUNK]], keys[0].size),
                                       home=np.tile(np.arange(PROBES + 1) == 0, keys.size // (PROBES + 1)))

    return nodes.select("node", "v").mapInArrow(run, "key long, node long, home boolean")


def _balls(members: DataFrame, nodes: DataFrame, kind: str, threshold: float) -> DataFrame:
    """node and ball: the least node of a crowded cell that the node is within half the threshold's angle of."""
    half = math.cos(math.acos(threshold) / 2) + 1e-7
    pairs = members.filter((F.col("size") >= CROWDED) & (F.col("node") != F.col("least"))).select("least", "node").distinct()
    pivots = nodes.select(F.col("node").alias("least"), F.col("v").alias("pivot"))
    # a pivot may have many nodes: it meets them in parts
    parts = F.pmod(F.xxhash64("node"), F.lit(64))
    spread = pairs.withColumn("part", parts)
    met = spread.join(spread.select("least", "part").distinct().join(pivots, "least"), ["least", "part"]).join(
        nodes.select("node", "v"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("ball", pa.int64())])
        for batch in batches:
            if not batch.num_rows:
                continue
            node, least = batch.column("node").to_numpy(), batch.column("least").to_numpy()
            for (rows, x), (_, p) in zip(_units(batch.column("v"), kind), _units(batch.column("pivot"), kind)):
                near = rows[(x * p).sum(axis=1) >= half]
                yield record_batch(schema, node=node[near], ball=least[near])

    # cells are of one length, so a pivot has the length of its nodes
    found = met.mapInArrow(run, "node long, ball long").groupBy("node").agg(F.min("ball").alias("ball"))
    pivot_of = found.select(F.col("ball").alias("node")).distinct().withColumn("own", F.col("node"))
    return found.join(pivot_of, "node", "full").select("node", F.coalesce("ball", "own").alias("ball"))


def _compared(members: DataFrame, nodes: DataFrame, kind: str, blocks: int, scale: float, threshold: float, total: int) -> DataFrame:
    """node, links, and component: links found of nodes of different balls, and a node that is reached by them.

    members: key, node, home, ball.  A row per node and comparison in which it has links.
    """
    per = members.groupBy("key", "ball").agg(F.count("*").alias("n"), F.max("home").alias("home"))
    open_ = per.groupBy("key").agg(
        F.max_by("ball", F.struct("n", "ball")).alias("main"), F.sum("n").alias("size"), F.max("n").alias("most"),
        F.count("*").alias("kinds"), F.max("home").alias("home")).filter("kinds > 1 and home")
    small = F.col("size") <= SMALL
    open_ = stored(open_.select(
        "key", "main", "size",
        F.when(small, 1).otherwise(F.ceil((F.col("size") - F.col("most")) / BLOCK)).cast("int").alias("blocks"),
        F.when(small, 1).otherwise(F.ceil(F.col("size") / SLICE)).cast("int").alias("slices")), "lattice-open")
    rows = join_groups(members, open_, "key", "size", total, "node").filter("main is not null")
    late = F.col("ball") != F.col("main")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    slice_ = F.pmod(F.xxhash64("node", F.lit(1)), F.col("slices")).cast("int")

    def place(i, j, asks, member):
        return F.struct(i.alias("i"), j.alias("j"), asks.alias("asks"), member.alias("member"))

    yes, no = F.lit(True), F.lit(False)
    as_member = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: place(i, slice_, no, yes))
    as_late = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda j: place(block, j, yes, no))
    at = F.when(F.col("blocks") * F.col("slices") == 1, F.array(place(F.lit(0), F.lit(0), late, yes))).when(
        late, F.concat(as_member, as_late)).otherwise(as_member)
    dealt = rows.select("key", "node", "home", "ball", late.alias("late"), F.explode(at).alias("at")).select(
        "key", "at.i", "at.j", "at.asks", "at.member", "late", "node", "home", "ball")
    dealt = dealt.join(nodes.select("node", "weight", "v"), "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("component", pa.int64())])
        for group in grouped(batches, ["key", "i", "j"]):
            asks, member = (np.flatnonzero(group.column(c).to_numpy()) for c in ("asks", "member"))
            if not len(asks) or not len(member):
                continue
            node, ball, weight = (group.column(c).to_numpy() for c in ("node", "ball", "weight"))
            home, late_ = group.column("home").to_numpy(), group.column("late").to_numpy()
            ((_, x),) = _units(group.column("v"), kind)
            pairs = []
            for i in range(0, len(asks), BLOCK):
                some = asks[i: i + BLOCK]
                near = x[some] @ x[member].T >= threshold - 1e-9
                near &= home[some][:, None] | home[member][None, :]
                near &= ball[some][:, None] != ball[member][None, :]
                # two late nodes see each other twice
                near &= ~late_[member][None, :] | (node[some][:, None] < node[member][None, :])
                p, q = np.nonzero(near)
                p, q = some[p], member[q]
                sure = (x[p] * x[q]).sum(axis=1) >= threshold
                pairs.append((p[sure], q[sure]))
            p, q = (np.concatenate(side) for side in zip(*pairs))
            if not len(p):
                continue
            first = _meets_first(int(group.column("key")[0].as_py()), tables(x.shape[1], blocks, scale, threshold), x, p, q)
            links = np.bincount(p[first], weight[q[first]], len(node)) + np.bincount(q[first], weight[p[first]], len(node))
            label = np.arange(len(node))
            while True:  # the least place that links reach
                least = np.minimum(label[p], label[q])
                after = label.copy()
                np.minimum.at(after, p, least)
                np.minimum.at(after, q, least)
                after = after[after]
                if (after == label).all():
                    break
                label = after
            some = np.union1d(p, q)
            yield record_batch(schema, node=node[some], links=links[some].astype(np.int64), component=node[label[some]])

    return dealt.mapInArrow(run, "node long, links long, component long")


def _meets_first(key: int, own: Tables, x: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the pairs (p, q) meet in no earlier table, nor in a lesser cell of this table."""
    rows, at = np.unique(np.concatenate([p, q]), return_inverse=True)
    keys = own.keys(x[rows])
    table = key & 0xFF
    out = np.ones(len(p), bool)
    for i in range(0, len(p), 8192):
        a, b = keys[at[i: min(i + 8192, len(p))]], keys[at[len(p) + i: len(p) + min(i + 8192, len(p))]]
        in_b = (a[:, :, :1] == b).any(axis=2)  # the home of the one is a cell of the other
        in_a = (b[:, :, :1] == a).any(axis=2)
        before = (in_a | in_b)[:, :table].any(axis=1)
        most = np.iinfo(np.int64).max
        least = np.minimum(np.where(in_b[:, table], a[:, table, 0], most), np.where(in_a[:, table], b[:, table, 0], most))
        out[i: i + 8192] = ~before & (least == key)
    return out


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors are linked if their cosine in double precision is `threshold` or more and they meet in a cell; n_links counts
    the other rows linked directly, component_id is the least id that links reach, itself included.  Vectors that are null,
    empty or zero or hold a null or non-finite component are linked with nothing, vectors of different lengths neither.
    Rows that repeat are vectors of their own; those without an id are linked as others, but name no component (theirs is null
    if no row with an id is reached), and they are kept only then.  An empty table gives no rows.
    """
    element = dict(vectors.dtypes)[vector_col]
    kind = "<f4" if element == "array<float>" else "<f8"
    v = vectors[vector_col]
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(v, lambda c: c != 0)
    source = vectors.select(vectors[id_col].cast("long").alias("vec_id"), F.when(good, v).alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("vec_id", pa.int64()), ("v", pa.binary())])
        for batch in batches:
            yield record_batch(schema, vec_id=batch.column("vec_id"), v=[
                None if x is None else (np.asarray(x, kind) + 0).tobytes() for x in batch.column("v").to_pylist()])

    rows = stored(source.mapInArrow(pack, "vec_id long, v binary"), "lattice-rows")
    # equal vectors are one node, numbered when it is stored
    nodes = stored(rows.filter("v is not null").groupBy("v").agg(
        F.min("vec_id").alias("least_id"), F.count("*").alias("weight")).withColumn("node", F.monotonically_increasing_id()),
        "lattice-nodes")
    total = rows.count()
    n = nodes.count()
    blocks, scale = layout(n)
    keyed = stored(_keyed(nodes, kind, blocks, scale, threshold), "lattice-keys")
    buckets = stored(keyed.groupBy("key").agg(F.count("*").alias("size"), F.max("home").alias("any_home"), F.min("node").alias(
        "least")).filter("size > 1 and any_home").drop("any_home"), "lattice-buckets")
    n_keys = keyed.count()
    members = stored(join_groups(keyed, buckets, "key", "size", n_keys, "node").filter("size is not null"), "lattice-members")
    balls = stored(_balls(members, nodes, kind, threshold), "lattice-balls")
    labelled = members.drop("size", "least").join(balls, "node", "left").withColumn(
        "ball", F.coalesce("ball", -F.col("node") - 1))  # a node in no ball is one of its own
    found = stored(_compared(stored(labelled, "lattice-labelled"), nodes, kind, blocks, scale, threshold, n_keys), "lattice-links")
    edges = found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(
        balls.select(F.col("node").alias("u"), F.col("ball").alias("v")))
    named = stored(components(edges), "lattice-components")
    sizes = balls.join(nodes.select("node", "weight"), "node").groupBy("ball").agg(F.sum("weight").alias("in_ball"), F.count("*").alias("n"))
    of_ball = join_groups(balls, sizes, "ball", "n", max(1, n), "node").select("node", "in_ball")
    counted = nodes.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(
        of_ball, "node", "left").join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counted = stored(counted.select("v", "weight", "least_id", "component", (
        F.coalesce("links", F.lit(0)) + F.coalesce("in_ball", F.col("weight")) - 1).cast("long").alias("n_links")), "lattice-counted")
    groups = counted.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    facts = join_groups(counted, groups, "component", "n", max(1, n), "least_id").select("v", "weight", "n_links", "component_id")
    answer = join_groups(rows, facts, "v", "weight", total, "vec_id")
    alone = F.col("v").isNull()
    return answer.select(
        "vec_id", F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn(
        "kept", F.col("component_id").isNull() | F.col("component_id").eqNullSafe(F.col("vec_id")))
