"""Merkle manifest of a table of documents, grown by aligned appends with incremental witnesses.

A tree of three-way runs holds the leaves of each source, and one tree above holds the roots of the sources.  Leaves are
appended in order, in blocks of 3**HEIGHT that are aligned to the tree.  Within a block a stream of appends keeps
the open subtrees: three siblings close a run, and all leaves under them get their missing siblings attached to their
partial witness.  A closed block is never read again: its root is appended as a leaf, HEIGHT levels up, by the same
stream, and so on until one node is left.  A leaf's witness is its own, then that of its block's root, and so on; these
are joined on the number of the block, so a source of any size is spread over its blocks.

A witness is a string of bytes: per level one byte with the siblings to the left (times four) and to the right, then
their digests from left to right.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.llm.common import grouped, record_batch, splits, stored

ARITY = 3
HEIGHT = 7
"""Levels of a block."""

DIGEST = 32

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CARRIED = ("doc_id", "leaf", "changed")


def parent(digests: Sequence[bytes]) -> bytes:
    """Digest of a run: of the hex texts of its nodes, one after the other."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


class Appender:
    """Streaming append of nodes; the witness of each is extended whenever siblings above it are complete."""

    def __init__(self) -> None:
        self.witnesses: list[bytearray] = []
        self._open: list[list[tuple[bytes, int]]] = [[]]  # per level: digest and first leaf of each node without a run

    def append(self, digest: bytes) -> None:
        """One more leaf at the right."""
        self.witnesses.append(bytearray())
        self._push(0, digest, len(self.witnesses) - 1)

    def _push(self, level: int, digest: bytes, first: int) -> None:
        if level == len(self._open):
            self._open.append([])
        self._open[level].append((digest, first))
        if len(self._open[level]) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        """Make a run of the open nodes of a level and extend the witnesses below."""
        run, self._open[level] = self._open[level], []
        digests = [d for d, _ in run]
        ends = [first for _, first in run[1:]] + [len(self.witnesses)]
        for i, ((_, first), end) in enumerate(zip(run, ends)):
            more = struct.pack("B", i << 2 | len(run) - 1 - i) + b"".join(digests[:i] + digests[i + 1:])
            for witness in self.witnesses[first:end]:
                witness += more
        self._push(level + 1, parent(digests), run[0][1])

    def root(self, height: int | None) -> bytes:
        """Close all open runs up to a height, or until one node remains, and give the root."""
        level, nodes = 0, len(self.witnesses)
        while nodes > 1 if height is None else level < height:
            if self._open[level]:
                self._close(level)
            level, nodes = level + 1, -(-nodes // ARITY)
        return self._open[level][0][0]


def levels(witness: bytes) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """The siblings to the left and to the right, level by level."""
    at = 0
    while at < len(witness):
        left, right = witness[at] >> 2, witness[at] & 3
        at += 1
        both = [witness[at + DIGEST * i: at + DIGEST * (i + 1)] for i in range(left + right)]
        at += DIGEST * (left + right)
        yield both[:left], both[left:]


def folded(digest: bytes, witness: bytes) -> bytes:
    """The root that a leaf and its witness give."""
    for left, right in levels(witness):
        digest = parent([*left, digest, *right])
    return digest


def siblings(witness: bytes) -> list[bytes]:
    """All digests of a witness, level by level, from left to right."""
    return [d for left, right in levels(witness) for d in (*left, *right)]


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Digest of a document: its fields with their lengths, one after the other."""
    def field(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.unhex(F.sha2(F.concat(field(doc_id.cast("long")), field(source), field(lang), field(n_chars.cast("long")),
                                   field(text)), 256))


def tampered(doc_id: Column, text: Column) -> Column:
    """The text without line ends where two divides the checksum of the id as text; a null text stays null."""
    chosen = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 2 == 0
    return F.when(chosen, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def leaves(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, tree (its source, null before all others), leaf, and changed: the leaf of the tampered text."""
    doc_id, source, lang, n_chars, text = (docs[c] for c in FIELDS)
    other = tampered(doc_id, text.cast("string"))
    return docs.select(
        doc_id.cast("long").alias("doc_id"), _tree(source).alias("tree"),
        leaf(doc_id, source, lang, n_chars, text).alias("leaf"),
        F.when(~other.eqNullSafe(text.cast("string")), leaf(doc_id, source, lang, n_chars, other)).alias("changed"))


def _tree(source: Column) -> Column:
    """Name of a source's tree: no name is before all others, and the order of names is the bytewise one of sources."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def numbered(rows: DataFrame, order: Sequence[str], name: str, sizes: DataFrame | None = None) -> DataFrame:
    """The rows with their position `pos` in their tree, from 0 or the tree's size, and `n`, the tree's size with them.

    Rows are range-partitioned by tree and order, so a large tree is spread over many tasks; each task numbers its rows
    and stores them, and the rows of a tree in the ranges before are added.
    """
    by = ["tree", *order]
    ranged = rows.repartitionByRange(splits(rows), *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = 0, None
        for batch in batches:
            places = []
            for t in batch.column("tree").to_pylist():
                at, tree = (at + 1, tree) if t == tree else (0, t)
                places.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())],
                                             names=[*batch.schema.names, "place"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema.fields) + ", place long"
    placed = stored(ranged.mapInArrow(run, ddl), name)
    # a range holds whole trees but for its first and last, so this has a row per range and per tree
    parts = placed.groupBy("tree", "part").agg(F.count("*").alias("size"))
    parts = parts.withColumn("old", F.lit(0)) if sizes is None else parts.join(
        sizes.select("tree", F.col("n").alias("old")), "tree", "left").fillna(0, "old")
    all_of = Window.partitionBy("tree")
    before = all_of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("tree", "part", (F.col("old") + F.coalesce(F.sum("size").over(before), F.lit(0))).alias("start"),
                          (F.col("old") + F.sum("size").over(all_of)).alias("n"))
    return placed.join(starts, ["tree", "part"]).select(
        *rows.columns, (F.col("start") + F.col("place")).alias("pos"), F.col("n").cast("long").alias("n"))


def _witnessed(rows: DataFrame, name: str, height: int, carried: Sequence[str] = ()) -> DataFrame:
    """Append the nodes (tree, pos, node, whole) of each block, and store their witnesses.

    `whole` says that the tree has no other block.  Columns: tree, pos, block, whole, witness, root (of the block, on the
    row of its first node), and those that are carried.
    """
    out = ["tree", "pos", "block", "whole", "witness", "root", *carried]
    kinds = dict(rows.dtypes) | {"block": "bigint", "witness": "binary", "root": "binary"}
    dealt = rows.withColumn("block", F.floor(F.col("pos") / ARITY**height)).repartition("tree", "block").sortWithinPartitions(
        "tree", "block", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["tree", "block"]):
            stream = Appender()
            for digest in group.column("node").to_pylist():
                stream.append(digest)
            root = stream.root(None if group.column("whole")[0].as_py() else height)
            made = {"witness": pa.array([bytes(w) for w in stream.witnesses], pa.binary()),
                    "root": pa.array([root] + [None] * (group.num_rows - 1), pa.binary())}
            columns = [made[c] if c in made else group.column(c).combine_chunks() for c in out]
            yield pa.RecordBatch.from_arrays(columns, names=out)

    return stored(dealt.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in out)), name)


def _roots(blocks: DataFrame) -> DataFrame:
    return blocks.filter("root is not null").select("tree", F.col("block").alias("pos"), F.col("root").alias("node"), "whole")


def _upper(nodes: DataFrame, name: str, height: int) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of blocks over nodes (tree, pos, node, whole) until each tree has one, and the roots: tree, node."""
    block = ARITY**height
    rounds, roots = [], [nodes.filter("whole").select("tree", "node")]
    rest = nodes.filter(~F.col("whole"))
    while True:
        sizes = rest.groupBy("tree").agg(F.count("*").alias("n"))
        largest = sizes.agg(F.max("n")).first()[0]
        if largest is None:
            break
        # every tree here has a row per block only
        done = _witnessed(rest.drop("whole").join(sizes.select("tree", (F.col("n") <= block).alias("whole")), "tree"), name, height)
        rounds.append(done)
        above = _roots(done)
        roots.append(above.filter("whole").select("tree", "node"))
        if largest <= block:
            break
        rest = above.filter(~F.col("whole"))
    return rounds, reduce(DataFrame.unionByName, roots)


@dataclass(frozen=True)
class Manifest:
    """A manifest in stored tables: closed blocks with their witnesses, leaves of open blocks, and the size of each tree."""

    closed: tuple[DataFrame, ...] = ()
    open: DataFrame | None = None
    sizes: DataFrame | None = None
    height: int = HEIGHT

    @property
    def block(self) -> int:
        """Leaves of a closed block."""
        return ARITY**self.height

    def append(self, docs: DataFrame) -> Manifest:
        """The manifest with one leaf more per document.

        Leaves of a source follow those of earlier appends, those of one append in the order of their ids (null first,
        ties by digest); so appends of ascending ids give the same roots as one append.  Only the open blocks of the
        trees are read again, closed ones are not.  No documents change nothing.
        """
        fresh = numbered(stored(leaves(docs), "merkle-leaves"), ["doc_id", "leaf"], "merkle-order", self.sizes)
        sizes = fresh.groupBy("tree").agg(F.max("n").alias("n"))
        rows = fresh
        if self.open is not None and self.sizes is not None:
            sizes = sizes.unionByName(self.sizes).groupBy("tree").agg(F.max("n").alias("n"))
            rows = fresh.unionByName(self.open.drop("n").join(sizes, "tree"))  # less than a block of each tree
        is_full = F.col("pos") < F.floor(F.col("n") / self.block) * self.block
        done = _witnessed(rows.filter(is_full).select(
            "tree", "pos", F.col("leaf").alias("node"), F.lit(False).alias("whole"), *CARRIED), "merkle-closed", self.height, CARRIED)
        return Manifest((*self.closed, done), stored(rows.filter(~is_full), "merkle-open"), stored(sizes, "merkle-sizes"),
                        self.height)

    def witnesses(self) -> DataFrame:
        """doc_id, tree, leaf, changed, witness, subroot and root of every leaf."""
        rest = _witnessed(self.open.select("tree", "pos", F.col("leaf").alias("node"), (F.col("pos") < self.block).alias("whole"),
                                           *CARRIED), "merkle-rest", self.height, CARRIED)
        both = reduce(DataFrame.unionByName, [*self.closed, rest])
        # the one block of a tree, open or full, has the tree's root
        alone = self.sizes.filter(F.col("n") <= self.block).select("tree", F.lit(True).alias("alone"))
        blocks = _roots(both).drop("whole").join(alone, "tree", "left").fillna(False, "alone").withColumnRenamed("alone", "whole")
        rounds, subroots = _upper(blocks, "merkle-round", self.height)
        top_nodes = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"), ["name"], "merkle-top")
        top = _witnessed(top_nodes.withColumn("whole", F.col("n") <= self.block), "merkle-top", self.height, ["name", "node"])
        top_rounds, roots = _upper(_roots(top), "merkle-top", self.height)
        found = roots.first()
        root = F.lit(bytes(found["node"]) if found else None).cast("binary")
        above = _extended(top_rounds, None)
        names = _joined(top, above, None).select(
            F.col("name").alias("tree"), F.col("node").alias("subroot"), F.col("witness").alias("end"))
        names = stored(names, "merkle-names")
        above = _extended(rounds, names)
        return _joined(both, above, names).select("doc_id", "tree", "leaf", "changed", "witness", "subroot", root.alias("root"))


def _extended(rounds: Sequence[DataFrame], names: DataFrame | None) -> DataFrame | None:
    """Witnesses of the nodes of the lowest round, up to the root; those of each round are extended by the round above."""
    above = None
    for blocks in reversed(rounds):
        above = _joined(blocks, above, names)
    return above


def _joined(rows: DataFrame, above: DataFrame | None, names: DataFrame | None) -> DataFrame:
    """Rows with the witness of their block's root after their own.

    That root is a node of the round above, or the root of the whole tree, found by name; in either case no more
    rows than a block has meet it.
    """
    if above is not None:
        upper = above.select("tree", F.col("pos").alias("block"), F.col("witness").alias("more"),
                             *([F.col("subroot").alias("upper_root")] if names is not None else []))
        rows = rows.join(upper, ["tree", "block"], "left")
        rows = rows.withColumn("witness", F.concat("witness", F.coalesce("more", F.lit(b"")))).withColumn(
            "reached", F.col("more").isNotNull()).drop("more")
    else:
        rows = rows.withColumn("reached", F.lit(False))
    if names is None:
        return rows.drop("reached")
    # rows that an upper round has reached carry a key of their own instead of their tree's, so no tree gathers its rows
    key = F.when(F.col("reached"), F.concat(F.lit("\0"), F.col("tree"), F.lit("\0"), F.col("block").cast("string"))).otherwise(F.col("tree"))
    rows = rows.withColumn("own", key).join(names.withColumnRenamed("tree", "own"), "own", "left")
    rows = rows.withColumn("witness", F.concat("witness", F.coalesce("end", F.lit(b"")))).drop("end", "own", "reached")
    if above is not None:
        rows = rows.withColumn("subroot", F.coalesce("upper_root", "subroot")).drop("upper_root")
    return rows


def verified(manifest: Manifest) -> DataFrame:
    """Per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; digests as hex text.

    proof_sha256 is the digest of the siblings' hex texts.  folded_root comes from the witness and the leaf of the
    tampered text, or the stored leaf where nothing was changed.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in (
        "leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            made = [folded(c or d, w) for c, d, w in zip(rows["changed"], rows["leaf"], rows["witness"])]
            proofs = [hashlib.sha256(b"".join(siblings(w)).hex().encode()).hexdigest() for w in rows["witness"]]
            yield record_batch(
                schema, doc_id=batch.column("doc_id"), **{c: [x.hex() for x in rows[c]] for c in ("leaf", "subroot", "root")},
                proof_sha256=proofs, folded_root=[x.hex() for x in made], verified=[x == y for x, y in zip(made, rows["root"])])

    return manifest.witnesses().mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
                                                "folded_root string, verified boolean")


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """One append of all documents and the check of every leaf; see Manifest.append and verified.

    Documents need doc_id, source, lang, n_chars and text, each of which may be null; others are ignored.  Rows that
    repeat are leaves of their own, and an empty table gives no rows.
    """
    return verified(Manifest().append(docs))
