"""Alignment of the tokens that two tokenizers cut the same bytes into.

Both cut a space and the text.  Byte offsets at which tokens of both end cut the tokens into groups.  Where the two agree,
token i of one ends with token i + shift of the other for a long stretch: probes of doubling length compare the two arrays
of ends along that diagonal and halve again at its end, so a stretch is jumped in few comparisons.  What does not agree is
walked token by token up to the next common end, which gives a new shift.

A pair of tokens is linked if their bytes overlap.  Inside a group no ends meet but the last, so the distinct ends of both
cut the bytes into pieces that belong to one link each.  Links are counted per pair of ids over all documents: every task
sums up what it has before the shuffle, and documents look the counts up in a table that is sent to the tasks if its
measured size allows, and is joined otherwise.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauselake.llm.common import join_groups, record_batch, sliced, stored, strings
from clauselake.llm.tokens import library_encoder
from clauselake.llm.units import PATTERN, SAME_CLASSES, Vocabulary

LOOKUP_PAIRS = 1 << 20
"""Pairs of ids that are sent to the tasks as a table; more are joined."""

HELD_PAIRS = 1 << 20
"""Pairs whose counts a task holds before it hands them on."""

TEXT_BYTES = 1 << 20
LIBRARY_BYTES = 16 << 20
"""Bytes of the units that a worker remembers for the slower library."""

WORD = 8
"""Bytes of an end in an array of ends."""

FIRST_PROBE = 4 * WORD

LONG_BLANK = re.compile(r"\s{200}")


def common_cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of tokens of both before each common end, given the ascending ends of both; the last ends are equal."""
    # stretches of groups of one token each, from the group that ends them; unlike words stop every probe at the end
    first_a, first_b, runs = [], [], []
    whole_a, whole_b = (np.append(e, end).astype(np.int64).tobytes() for e, end in ((ends_a, -1), (ends_b, -2)))
    a, b = ends_a.tolist(), ends_b.tolist()
    n, i, j = len(a), 0, 0
    while i < n:
        # step on where the end comes first, until both end together
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i += 1
        j += 1
        first_a.append(i)
        first_b.append(j)
        # one token to one along the diagonal: probe twice as far while the ends agree, then half as far down to one
        at = start = WORD * i
        shift = WORD * j - start
        width = FIRST_PROBE
        while whole_a[at: at + width] == whole_b[at + shift: at + shift + width]:
            at += width
            width *= 2
        while width > WORD:
            width //= 2
            if whole_a[at: at + width] == whole_b[at + shift: at + shift + width]:
                at += width
        run = (at - start) // WORD
        runs.append(run + 1)
        i += run
        j += run
    steps = np.arange(sum(runs)) - np.repeat(np.cumsum(runs) - runs, runs)
    return np.repeat(first_a, runs) + steps, np.repeat(first_b, runs) + steps


@dataclass(frozen=True)
class Groups:
    """Aligned texts one after the other: ids of both, where each text ends, and after how many ids each group ends."""

    a: np.ndarray
    b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    cuts_a: np.ndarray
    cuts_b: np.ndarray
    ends_groups: np.ndarray


class Pair:
    """Two loaded tokenizers and the bytes of their tokens."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        import tiktoken

        self._path = byte_path
        vocabulary = Vocabulary(byte_path)
        self._ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=vocabulary.ids, special_tokens={})
        self._pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.bytes_a = [vocabulary.bytes_of.get(i, b"") for i in range(max(vocabulary.bytes_of) + 1)]
        self.bytes_b = [self._piece(i) for i in range(self._pieces.get_piece_size())]
        self.size_a = np.array(list(map(len, self.bytes_a)))
        self.size_b = np.array(list(map(len, self.bytes_b)))
        self.vocabulary = max(len(self.size_a), len(self.size_b))

    def _piece(self, i: int) -> bytes:
        if self._pieces.is_byte(i):
            return bytes([int(self._pieces.id_to_piece(i)[3:5], 16)])
        return self._pieces.id_to_piece(i).replace("▁", " ").encode()

    def _byte_ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of a space and each text.

        The faster library has the same merges; texts with characters that Unicode versions class differently, or with
        blanks too long for its patterns, go to the library that the vocabulary is for.
        """
        easy = [(t.isascii() or max(t) < SAME_CLASSES) and LONG_BLANK.search(t) is None for t in texts]
        hard = [t for t, e in zip(texts, easy) if not e]
        # a letter before the space is a token of its own, so its id is cut off again
        others = iter(library_encoder(self._path, True, LIBRARY_BYTES)(["x " + t for t in hard]) if hard else ())
        return [self._ranks.encode_to_numpy(" " + t, disallowed_special=()) if e else np.frombuffer(next(others), "<u4")[1:]
                for t, e in zip(texts, easy)]

    def align(self, texts: list[str]) -> Groups:
        """The groups of all texts; a text whose tokens' bytes differ from it has no ids."""
        own, others = self._byte_ids(texts), self._pieces.encode(texts, num_threads=1)
        nothing = np.zeros(0, np.int64)
        ids_a, ids_b, cuts_a, cuts_b = [nothing], [nothing], [nothing], [nothing]
        done_a = done_b = 0
        for text, a, pieces in zip(texts, own, others):
            whole = b" " + text.encode()
            ends = np.cumsum(self.size_a[a])  # every byte is a token, so none of these gets lost
            b = np.array(pieces, np.int64)
            if not text or ends[-1] != len(whole) or b"".join(map(self.bytes_b.__getitem__, pieces)) != whole:
                a, b, cuts = nothing, nothing, (nothing, nothing)
            else:
                cuts = common_cuts(ends, np.cumsum(self.size_b[b]))
            ids_a.append(a)
            ids_b.append(b)
            cuts_a.append(cuts[0] + done_a)
            cuts_b.append(cuts[1] + done_b)
            done_a, done_b = done_a + len(a), done_b + len(b)
        ends_a, ends_b, ends_groups = (np.cumsum([len(v) for v in x[1:]], dtype=np.int64) for x in (ids_a, ids_b, cuts_a))
        return Groups(np.concatenate(ids_a).astype(np.int64), np.concatenate(ids_b), ends_a, ends_b, np.concatenate(cuts_a),
                      np.concatenate(cuts_b), ends_groups)

    def links(self, groups: Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of the two tokens of every link, and where the links of each text end."""
        ends_a, ends_b = np.cumsum(self.size_a[groups.a]), np.cumsum(self.size_b[groups.b])  # both sides have the same bytes
        in_a, in_b = np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 1, bool), None
        in_b = in_a.copy()
        in_a[ends_a] = True
        in_b[ends_b] = True
        ends = np.flatnonzero(in_a | in_b)
        of_text = np.append(0, ends_a)[groups.ends_a]
        return (np.cumsum(in_a) - in_a)[ends], (np.cumsum(in_b) - in_b)[ends], np.searchsorted(ends, of_text, side="right")


@lru_cache(maxsize=1)
def tokenizer_pair(byte_path: str, piece_path: str) -> Pair:
    """The worker's pair of tokenizers."""
    return Pair(byte_path, piece_path)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("long").alias("doc_id"),
                       docs[text_col].cast("string").alias("text"))


def aligned(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The groups of every text: row (a number of its own), doc_id, a, b, a_cuts, b_cuts.

    a and b are the ids of a space and the text by the byte-level vocabulary and by the piece model, a_cuts and b_cuts the
    numbers of ids up to the end of each group.  Strings of special tokens are plain text.  A text that is null or empty, or
    whose tokens' bytes differ from it, has empty arrays.  Rows that repeat come out as often, ids may be null, and an empty
    table gives no rows.  Nothing is shuffled.
    """
    def lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(values.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizer_pair(byte_path, piece_path)
        for batch in sliced(batches, "text", TEXT_BYTES):
            g = pair.align(strings(batch.column("text")))
            n = np.diff(g.ends_groups, prepend=0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), lists(g.a, g.ends_a), lists(g.b, g.ends_b),
                 lists(g.cuts_a - np.repeat(np.append(0, g.ends_a)[:-1], n), g.ends_groups),
                 lists(g.cuts_b - np.repeat(np.append(0, g.ends_b)[:-1], n), g.ends_groups)],
                names=["row", "doc_id", "a", "b", "a_cuts", "b_cuts"])

    return _source(docs, id_col, text_col).mapInArrow(run, "row long, doc_id long, a array<int>, b array<int>, a_cuts array<int>, b_cuts array<int>")


@lru_cache(maxsize=1)
def _written(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each id followed by a comma, by a bar, and by a semicolon: as rows of characters, and how many there are."""
    made = [f"{i}{mark}".encode() for mark in ",|;" for i in range(size)]
    sizes = np.array(list(map(len, made)))
    widest = int(sizes.max())
    table = np.frombuffer(b"".join(x.ljust(widest) for x in made), np.uint8).reshape(len(made), -1)
    return table, sizes


def group_digests(groups: Groups, vocabulary: int) -> list[str]:
    """Digest of each text's groups as text: ids parted by commas, the two sides by a bar, groups by semicolons.

    All ids are below `vocabulary`.
    """
    a, b, cuts_a, cuts_b = groups.a.copy(), groups.b.copy(), groups.cuts_a, groups.cuts_b
    table, sizes = _written(vocabulary)
    # the place of an id among the ids of both sides: group after group, one side after the other
    place_a = np.arange(len(a)) + np.repeat(np.append(0, cuts_b)[:-1], np.diff(cuts_a, prepend=0))
    place_b = np.arange(len(b)) + np.repeat(cuts_a, np.diff(cuts_b, prepend=0))
    a[cuts_a - 1] += vocabulary
    b[cuts_b - 1] += 2 * vocabulary
    mixed = np.empty(len(a) + len(b), np.int64)
    mixed[place_a] = a
    mixed[place_b] = b
    lengths = sizes[mixed]
    data = table[mixed][np.arange(table.shape[1]) < lengths[:, None]].tobytes()
    ends = np.append(0, np.cumsum(lengths))[groups.ends_a + groups.ends_b].tolist()
    return [hashlib.sha256(data[i: j - 1]).hexdigest() if j > i else "" for i, j in zip([0, *ends], ends)]


def described(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text its groups in short: row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct pairs of ids.

    The pairs are packed as 64-bit integers (the first id in the high half), `times` says how many links each has.  Rows are
    those of `aligned`.
    """
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                        ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
                        ("pairs", pa.binary()), ("times", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizer_pair(byte_path, piece_path)
        for batch in sliced(batches, "text", TEXT_BYTES):
            groups = pair.align(strings(batch.column("text")))
            at_a, at_b, ends = pair.links(groups)
            linked = groups.a[at_a] << 32 | groups.b[at_b]
            counted = [np.unique(linked[i:j], return_counts=True) for i, j in zip(np.append(0, ends), ends)]
            yield record_batch(
                schema, row=batch.column("row"), doc_id=batch.column("doc_id"), n_a=np.diff(groups.ends_a, prepend=0),
                n_b=np.diff(groups.ends_b, prepend=0), n_groups=np.diff(groups.ends_groups, prepend=0),
                n_links=np.diff(ends, prepend=0), groups_sha256=group_digests(groups, pair.vocabulary),
                pairs=[p.astype("<i8").tobytes() for p, _ in counted], times=[t.astype("<u4").tobytes() for _, t in counted])

    return _source(docs, id_col, text_col).mapInArrow(
        run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")


def pair_counts(described_rows: DataFrame) -> DataFrame:
    """pair, n and is_best of every linked pair of ids: its links over all documents, and whether its second id has no
    pair with more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            pairs, inverse = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            return pairs, np.bincount(inverse, np.concatenate([t for _, t in held]), len(pairs)).astype(np.int64)

        for batch in batches:
            for part in sliced(iter([batch]), "pairs", TEXT_BYTES):
                pairs = np.frombuffer(b"".join(part.column("pairs").to_pylist()), "<i8")
                held.append((pairs, np.frombuffer(b"".join(part.column("times").to_pylist()), "<u4").astype(np.int64)))
                size += len(pairs)
                if size > HELD_PAIRS:
                    held = [summed()]
                    size = len(held[0][0])
                    if 2 * size > HELD_PAIRS:
                        yield record_batch(schema, pair=held[0][0], n=held[0][1])
                        held, size = [], 0
        if held:
            pairs, counts = summed()
            yield record_batch(schema, pair=pairs, n=counts)

    counts = described_rows.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # an id has at most as many partners as the other vocabulary has ids
    of_second = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    return counts.withColumn("is_best", F.col("n") == F.max("n").over(of_second))


def _looked_up(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """n_best and count_sum of each row from a table that is sent to all tasks."""
    table = counts.orderBy("pair").toArrow()  # at most LOOKUP_PAIRS rows
    shared = rows.sparkSession.sparkContext.broadcast(
        tuple(np.ascontiguousarray(table.column(c).to_numpy()) for c in ("pair", "n", "is_best")))
    keys = [c for c in rows.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, is_best = shared.value
        for batch in batches:
            for part in sliced(iter([batch]), "pairs", TEXT_BYTES):
                best, total = [], []
                for own, times in zip(part.column("pairs").to_pylist(), part.column("times").to_pylist()):
                    at = np.searchsorted(pairs, np.frombuffer(own, "<i8"))
                    k = np.frombuffer(times, "<u4").astype(np.int64)
                    best.append(int(k[is_best[at]].sum()))
                    total.append(int((k * n[at]).sum()))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keys], pa.array(best, pa.int64()), pa.array(total, pa.int64())],
                    names=[*keys, "n_best", "count_sum"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", n_best long, count_sum long")


def _joined(rows: DataFrame, counts: DataFrame, links: int) -> DataFrame:
    """The same by a join; pairs with a large share of the links take a broadcast, so they stay out of the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row", pa.int64()), ("pair", pa.int64()), ("times", pa.int64())])
        for batch in batches:
            for part in sliced(iter([batch]), "pairs", TEXT_BYTES):
                pairs = part.column("pairs").to_pylist()
                yield record_batch(
                    schema, row=np.repeat(part.column("row").to_numpy(), [len(p) // 8 for p in pairs]),
                    pair=np.frombuffer(b"".join(pairs), "<i8"),
                    times=np.frombuffer(b"".join(part.column("times").to_pylist()), "<u4").astype(np.int64))

    flat = rows.select("row", "pairs", "times").mapInArrow(run, "row long, pair long, times long")
    met = join_groups(flat, counts, "pair", "n", links, "row")
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"),
                                  F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return rows.drop("pairs", "times").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])


def link_statistics(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text",
                    lookup: int = LOOKUP_PAIRS) -> DataFrame:
    """Digest and link counts of every text: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best counts the links whose pair is linked as often, over all documents, as any pair of its second id; count_sum adds
    up the counts of the links' pairs.  Texts without tokens have zeros and an empty digest; for the other cases see `aligned`.
    """
    rows = stored(described(docs, byte_path, piece_path, id_col, text_col), "align-rows")
    counts = stored(pair_counts(rows), "align-pairs")
    size, links = counts.agg(F.count("*"), F.sum("n")).first()
    found = _looked_up(rows, counts) if size <= lookup else _joined(rows, counts, links)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
