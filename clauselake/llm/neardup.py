"""Near duplicates by a multi-index Hamming join of MinHash signatures, confirmed on full shingle sets.

A signature has 16 bits per MinHash; the share of places in which two signatures agree estimates the similarity of the
sets.  For the join the first places are split into chunks of CHUNK places.  By the pigeonhole principle two signatures
that differ in fewer than (ERRORS + 1) places per chunk have a chunk with at most ERRORS of them; every way
to leave ERRORS places out of a chunk gives a key, so such a pair shares a key for sure.  There are as many chunks as it
takes for a pair at the threshold to be missed with a chance below MISS.

A key's bucket can be large, so its pairs are never written out.  Documents with the same set are one node.  First
every node is compared with the least node of each of its buckets (a star).  Nodes of a bucket that are not in its
largest component yet are stragglers; each is compared with its nearest other component, and only what is then still
apart is compared in full, block by block, on signatures.  Two nodes of one component need no comparison, so components
are complete: every pair that shares a key is in one component or was compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.common import HOT_SHARE, free_name, grouped, join_groups, record_batch, sliced, stored, strings

CHUNK = 6
ERRORS = 1
MISS = 3e-5
"""Chance that a pair at the threshold shares no key."""

PLACES = 120
"""Places of a signature; all of them tell whether a pair is worth confirming."""

SIGMAS = 4.8
"""A pair is confirmed if it differs in fewer places than a pair at the threshold plus so many standard deviations."""

SPLIT = 16
"""Tasks over which the partners of one node are spread, at least."""

EXACT = 2048
"""Sets of up to so many shingles are compared as hashes where a bucket is compared in full."""

BLOCK = 512
SLICE = 4096
"""Stragglers and members of a bucket that one task compares at once."""

HELD = 4 << 20
"""Bytes of members' hashes that a comparison reads at once."""

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_HASHES = _random.integers(0, 1 << 64, PLACES, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, words: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles of a text: runs of so many words; fewer words are one shingle, none give none."""
    found = text.encode().lower().split()  # bytes: lower-cases A-Z only, splits at the six blanks only
    if len(found) < words:
        return {tuple(found)} if found else set()
    return set(zip(*(found[i:] for i in range(words))))


def shingle_hashes(texts: Sequence[str], words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    parts = [t.encode().lower() for t in texts]
    data = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", np.uint8)
    offsets = np.cumsum([1, *(len(p) + 1 for p in parts)])
    at = np.flatnonzero(~BLANK[data])
    out = [np.zeros(0, np.uint64)] * len(parts)
    if not len(at):
        return out
    heads = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    lengths = np.diff(np.append(heads, len(at)))
    place = np.arange(len(at)) - np.repeat(heads, lengths)
    powers = np.ones(int(lengths.max()), np.uint64)
    powers[1:] = np.uint64(0xD6E8FEB86659FD93)
    powers = np.multiply.accumulate(powers)
    hashes = _mixed(np.add.reduceat(_BYTE[data[at]] * powers[place], heads) + lengths.astype(np.uint64))
    bounds = np.searchsorted(at[heads], offsets)
    for i in range(len(parts)):
        own = hashes[bounds[i]: bounds[i + 1]]
        if not len(own):
            continue
        n = min(words, len(own))
        rolled = np.zeros(len(own) - n + 1, np.uint64) + np.uint64(n)
        for k in range(n):
            rolled = rolled * _STEP + own[k: len(own) - n + 1 + k]
        out[i] = np.unique(_mixed(rolled))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """The top 16 bits of each MinHash of a set."""
    least = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 4096):
        least = np.minimum(least, (_HASHES[:, None] * hashes[None, k: k + 4096]).min(axis=1))
    return (least >> np.uint64(48)).astype("<u2")


def chunks_needed(percent: int) -> int:
    """Chunks so that a pair at the threshold has one with at most ERRORS differences, but for a chance of MISS."""
    agree = percent / 100
    good = sum(math.comb(CHUNK, e) * (1 - agree) ** e * agree ** (CHUNK - e) for e in range(ERRORS + 1))
    return min(PLACES // CHUNK, math.ceil(math.log(MISS) / math.log(1 - good))) if good < 1 else 1


def most_differences(percent: int) -> int:
    """Places in which a pair at the threshold or above differs at most, but for a negligible chance."""
    apart = 1 - percent / 100
    return math.ceil(PLACES * apart + SIGMAS * math.sqrt(PLACES * apart * (1 - apart)))


def keys_of(signatures: np.ndarray, n_chunks: int) -> np.ndarray:
    """The keys of each signature: one per chunk and way to leave ERRORS places out."""
    keys = []
    for c in range(n_chunks):
        for way, left in enumerate(combinations(range(CHUNK), CHUNK - ERRORS)):
            key = np.full(len(signatures), c * 1000 + way + 1, np.uint64)
            for p in left:
                key = _mixed(key * _STEP + signatures[:, c * CHUNK + p].astype(np.uint64))
            keys.append(key)
    return np.stack(keys, axis=1).view(np.int64)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, PLACES)


def described(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """One row per document: doc_id, n_shingles, and the digest and signature of its set, null if it is empty."""
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()),
                            ("signature", pa.binary())])
        for batch in sliced(batches, "text", 2 << 20):
            sets = shingle_hashes(strings(batch.column("text")), words)
            yield record_batch(
                schema, doc_id=batch.column("doc_id"), n_shingles=[len(s) for s in sets],
                set_key=[hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                signature=[signature(s).tobytes() if len(s) else None for s in sets])

    return source.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature binary")


def _buckets(nodes: DataFrame, n_chunks: int) -> DataFrame:
    """key and node of every signature key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])
        for batch in batches:
            if batch.num_rows:
                keys = keys_of(_signatures(batch.column("signature")), n_chunks)
                yield record_batch(schema, key=keys.ravel(), node=np.repeat(batch.column("node").to_numpy(), keys.shape[1]))

    return nodes.select("node", "signature").mapInArrow(run, "key long, node long")


def _members(keyed: DataFrame, buckets: DataFrame, total: int) -> DataFrame:
    """key, node, size and least of every row whose key has a bucket.

    Buckets with more than 1/HOT_SHARE of all rows are at most HOT_SHARE, a proven bound: their keys are listed, their
    rows meet a broadcast and stay out of the shuffle, in which the other rows meet their buckets.
    """
    limit = max(1, total // HOT_SHARE)
    hot = [r["key"] for r in buckets.filter(F.col("size") > limit).select("key").collect()]
    cold = keyed.filter(~F.col("key").isin(hot)) if hot else keyed
    found = cold.join(buckets.filter(F.col("size") <= limit), "key")
    if hot:
        found = found.unionByName(
            keyed.filter(F.col("key").isin(hot)).join(F.broadcast(buckets.filter(F.col("size") > limit)), "key"))
    return found.select("key", "node", "size", "least")


def _worth_confirming(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, part) whose signatures and set sizes allow the threshold; part spreads the partners of a."""
    facts = nodes.select("node", F.struct("n", "signature").alias("f"))
    left = pairs.select("a", "part").distinct().join(facts.withColumnRenamed("node", "a"), "a").withColumnRenamed("f", "fa")
    both = pairs.join(facts.withColumnRenamed("node", "b"), "b").withColumnRenamed("f", "fb").join(left, ["a", "part"]).select(
        "a", "b", "part", F.col("fa.n").alias("na"), F.col("fb.n").alias("nb"),
        F.col("fa.signature").alias("sa"), F.col("fb.signature").alias("sb"))
    most = most_differences(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            apart = (_signatures(batch.column("sa")) != _signatures(batch.column("sb"))).sum(axis=1)
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            good = (apart <= most) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            yield batch.select(["a", "b", "part"]).filter(pa.array(good))

    return both.mapInArrow(run, "a long, b long, part int").dropDuplicates(["a", "b"])


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs that are similar on their full sets.  Each partner's text travels to its part of the first node's."""
    ids = pairs.select("a", "part", F.col("b").alias("node"), "b").unionByName(
        pairs.select("a", "part", F.col("a").alias("node"), F.lit(None).cast("long").alias("b")).distinct())
    rows = ids.join(texts, "node").select("a", "part", "b", "text")
    dealt = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        at, first = None, []
        for batch in sliced(batches, "text"):
            us, vs = [], []
            for a, part, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b", "text"))):
                if (a, part) != at:
                    at, first = (a, part), []
                found = shingle_set(text or "", words)
                if b is None:
                    first.append(found)
                    continue
                for other in first:
                    common = len(found & other)
                    if found and 100 * common >= percent * (len(found) + len(other) - common):
                        us.append(a)
                        vs.append(b)
                        break
            yield record_batch(schema, u=us, v=vs)

    return dealt.mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node and component, the least node that can be reached, of every node of the edges (u, v).

    Large and small stars in turn: all larger neighbours of a node are linked to its least neighbour, then all smaller
    ones, until nothing changes.  A node's neighbours never meet in one task.
    """

    def star(links: DataFrame, total: int, small: bool) -> DataFrame:
        both = links if small else links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_min"), F.count("*").alias("_degree")).withColumn(
            "_min", F.least("u", "_min"))
        found = join_groups(both, least, "u", "_degree", total, "v")
        kept = found if small else found.filter("v > u")
        made = kept.select(F.col("v").alias("u"), F.col("_min").alias("v"))
        if small:
            made = made.unionByName(least.select("u", F.col("_min").alias("v")))
        return made.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def state(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    links = stored(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = state(links)
    while before[0]:
        links = stored(star(stored(star(links, 2 * before[0], False), "links"), before[0], True), "links")
        after = state(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _hashed(texts: DataFrame, words: int) -> DataFrame:
    """node and the low 32 bits of its sorted shingle hashes, null beyond EXACT shingles or if an id has several texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("hashes", pa.binary())])
        for batch in sliced(batches, "text", 2 << 20):
            sets = shingle_hashes(strings(batch.column("text")), words)
            yield record_batch(schema, node=batch.column("node"),
                               hashes=[x.astype(np.uint32).tobytes() if len(x) <= EXACT else None for x in sets])

    per = texts.mapInArrow(run, "node long, hashes binary").groupBy("node").agg(
        F.count("*").alias("n_texts"), F.first("hashes").alias("hashes"))
    return per.select("node", F.when(F.col("n_texts") == 1, F.col("hashes")).alias("hashes"))


def _near_labels(links: DataFrame) -> DataFrame:
    """node and its least neighbour, itself included: components of stars, finer than those of chains."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("_v")).select(
        "node", F.least("node", "_v").alias("component"))


def _hooked(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after new links: a component takes the least label that a link joins it to."""

    def named(side: str) -> DataFrame:
        return labels.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))

    joined = links.join(named("u"), "u", "left").join(named("v"), "v", "left").select(
        F.coalesce("cu", "u").alias("cu"), F.coalesce("cv", "v").alias("cv")).filter("cu != cv")
    moved = joined.groupBy(F.greatest("cu", "cv").alias("component")).agg(F.min(F.least("cu", "cv")).alias("_to"))
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    groups = moved.join(sizes, "component", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    alone = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).distinct().join(
        labels, "node", "left_anti").withColumn("component", F.col("node"))
    every = labels.unionByName(alone)
    return join_groups(every, groups, "component", "n", max(1, every.count()), "node").select(
        "node", F.coalesce("_to", "component").alias("component"))


def _stragglers(members: DataFrame, nodes: DataFrame, labels: DataFrame, percent: int, nearest: bool, parts: int,
                texts: DataFrame, words: int) -> DataFrame:
    """Pairs (a, b, part) of different components in a bucket that may be similar; a is a straggler.

    members: key and node of buckets with three nodes or more.  With `nearest`, only a straggler's nearest by signature.
    Otherwise sets of up to EXACT shingles are compared as hashes, so of small sets only similar pairs come out; larger
    ones are judged by their signatures.
    """
    labelled = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    per = labelled.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum(F.hash("node")).alias("h"))
    kept = per.groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("size"), F.max("n").alias("most"),
        F.sum("h").alias("h"), F.count("*").alias("kinds")).filter("kinds > 1").groupBy("size", "h", "main").agg(
        F.min("key").alias("key"), F.first("most").alias("most"))  # buckets with the same nodes count once
    open_ = stored(kept.select("key", "size", "main", F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int").alias("blocks"),
                               F.ceil(F.col("size") / SLICE).cast("int").alias("slices")), "near-open")
    total = members.count()
    rows = join_groups(labelled, open_, "key", "size", total, "node").filter("main is not null")
    facts = nodes.select("node", "n", "signature")
    if nearest:
        facts = facts.withColumn("hashes", F.lit(None).cast("binary"))
    else:
        rows = stored(rows, "near-rows")
        wanted = rows.select("node").distinct()
        facts = facts.join(wanted, "node", "left_semi").join(
            _hashed(texts.join(wanted, "node", "left_semi"), words), "node", "left")
    rows = rows.join(facts, "node")
    is_late = F.col("component") != F.col("main")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    slice_ = F.pmod(F.xxhash64("node", F.lit(1)), F.col("slices")).cast("int")
    dealt = rows.select(
        "key", "node", "component", "n", "signature", "hashes", F.explode(F.concat(
            F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                        lambda i: F.struct(i.alias("i"), slice_.alias("j"), F.lit(False).alias("late"))),
            F.when(is_late, F.transform(F.sequence(F.lit(0), F.col("slices") - 1),
                                        lambda j: F.struct(block.alias("i"), j.alias("j"), F.lit(True).alias("late"))))
            .otherwise(F.array().cast("array<struct<i:int,j:int,late:boolean>>")))).alias("at"), is_late.alias("is_late")
    ).select("key", "at.i", "at.j", "at.late", "is_late", "node", "component", "n", "signature", "hashes")
    sorted_rows = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    most = most_differences(percent)

    def compare(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        late = group.column("late").to_numpy()
        node, comp = group.column("node").to_numpy(), group.column("component").to_numpy()
        n, lagging = group.column("n").to_numpy(), group.column("is_late").to_numpy()
        sig = _signatures(group.column("signature"))
        hashes = group.column("hashes")
        sizes = pc.fill_null(pc.binary_length(hashes), 0).to_numpy()
        known = hashes.is_valid().to_numpy()
        at = np.flatnonzero(~late)
        for members_ in np.split(at, np.flatnonzero(np.diff(np.cumsum(sizes[at]) // HELD)) + 1):
            found: list[tuple[int, np.ndarray]] = []
            for x in np.flatnonzero(late):
                ok = (comp[members_] != comp[x]) & (100 * np.minimum(n[members_], n[x]) >= percent * np.maximum(n[members_], n[x]))
                if not nearest:
                    ok &= ~lagging[members_] | (node[members_] > node[x])  # a pair of stragglers meets twice
                near = members_[ok]
                apart = (sig[near] != sig[x]).sum(axis=1)
                if nearest and len(near):
                    best = int(apart.argmin())
                    near, apart = near[best: best + 1], apart[best: best + 1]
                near = near[apart <= most]
                if len(near):
                    found.append((x, near))
            if not found:
                continue
            if not nearest:
                found = similar(found, known, hashes, n)
            yield (np.concatenate([np.full(len(near), node[x]) for x, near in found]),
                   np.concatenate([node[near] for _, near in found]))

    def similar(found: list[tuple[int, np.ndarray]], known: np.ndarray, hashes: pa.ChunkedArray,
                n: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """The rows and partners that stay once known sets are compared; only sets that have a partner are read."""
        used = np.unique(np.concatenate([[x for x, _ in found], *(near for _, near in found)]).astype(np.int64))
        used = used[known[used]]
        sets = [np.frombuffer(hashes[int(i)].as_buffer(), np.uint32) for i in used]
        heads = np.cumsum([0, *map(len, sets)])
        names, flat = np.unique(np.concatenate([np.zeros(0, np.uint32), *sets]), return_inverse=True)
        kept = []
        for x, near in found:
            both = near[known[near]] if known[x] else near[:0]
            if len(both):
                at = int(np.searchsorted(used, x))
                mine = np.zeros(len(names), bool)
                mine[flat[heads[at]: heads[at + 1]]] = True
                common = np.array([np.count_nonzero(mine[flat[heads[k]: heads[k + 1]]]) for k in np.searchsorted(used, both)])
                poor = both[100 * common < percent * (n[both] + n[x] - common)]
                near = near[~np.isin(near, poor)]
            kept.append((x, near))
        return kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for group in grouped(batches, ["key", "i", "j"]):
            for a, b in compare(group):
                yield record_batch(schema, a=a, b=b)

    return sorted_rows.mapInArrow(run, "a long, b long").distinct().withColumn(
        "part", F.pmod(F.xxhash64("b"), F.lit(parts)).cast("int"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                    percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * common shingles >= percent * all shingles of both; component_id is the least id that
    links reach.  Texts without words (null, empty, blanks) are linked with nothing.  Rows that repeat an id are one
    document with several texts, which is linked if one of them is.  Rows without an id take part through a document
    that has the same set; otherwise their component is null, and they are kept.  An empty table gives no rows.
    """
    sets = stored(described(docs, id_col, text_col, words), "near-sets")
    total = sets.count()
    nodes = stored(sets.filter("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"),
        F.count("*").alias("n_rows")), "near-nodes")
    real = nodes.filter("node is not null")
    n_chunks = chunks_needed(percent)
    keyed = _buckets(real, n_chunks)
    buckets = stored(keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("least")).filter(
        "size > 1"), "near-buckets")
    members = stored(_members(keyed, buckets, total * n_chunks * math.comb(CHUNK, ERRORS)), "near-members")
    pairs = members.filter("node != least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    parts = max(SPLIT, total // 1_000_000)
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(parts)).cast("int"))
    wanted = members.select("node").distinct()
    texts = stored(docs.select(docs[id_col].cast("long").alias("node"), docs[text_col].cast("string").alias("text"))
                   .join(wanted, "node", "left_semi"), "near-texts")
    links = stored(_confirmed(stored(_worth_confirming(pairs, real, percent), "near-pairs"), texts, words, percent), "near-links")
    labels = stored(_near_labels(links), "near-labels")
    crowded = members.filter("size > 2").select("key", "node")
    for nearest in (True, False):
        more = stored(_stragglers(crowded, real, labels, percent, nearest, parts, texts, words), "near-pairs")
        if more.isEmpty():
            continue
        found = stored(_confirmed(more, texts, words, percent), "near-links")
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = stored(_hooked(labels, found), "near-labels") if nearest else labels
    labels = stored(components(links), "near-labels")
    named = nodes.join(labels, "node", "left").select(
        "set_key", "n_rows", F.coalesce("component", "node").alias("component_id"))
    answered = join_groups(sets.select("doc_id", "n_shingles", "set_key"), named, "set_key", "n_rows", total, "doc_id")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return answered.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("component_id").isNull() | F.col("component_id").eqNullSafe(F.col("doc_id")))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                        percent: int = 80) -> DataFrame:
    """The documents that stay, one of each group of near duplicates, with all their columns."""
    own = free_name(docs, "_id")
    gone = near_duplicates(docs, id_col, text_col, words, percent).filter(~F.col("kept") & F.col("doc_id").isNotNull())
    return docs.withColumn(own, docs[id_col].cast("long")).join(
        gone.select(F.col("doc_id").alias(own)).distinct(), own, "left_anti").select(*docs.columns)
