"""Best documents by cosine for query sets so large that a row per pair of query and document does not fit."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.operators.lexical import K1, B, LexicalIndex, query_terms
from clauselake.operators.scale import BROADCAST_ROWS, top_k

# the classes below travel with the plan, so that executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GROUP_QUERIES = 1 << 18
"""Queries that one task holds, with their best documents so far; more are dealt to several groups."""

PART_POSTINGS = 8_000_000
"""Postings that stream past one group in one task."""

QUERIES, DOCS = 4096, 2048
"""Sides of the matrix of scores that a task works on."""

DENSE, LOOPED = 0.016, 2000
"""Words shared by more than this part of a matrix are multiplied as dense columns; words shared by more pairs than the second
bound are added one at a time, all others together."""

TABLE = 1 << 23
"""Words times documents up to which a table says where the postings are."""

LEAST = 1e-30
"""A score of the matrix below which no word is shared."""

SLACK = 1.2e-7
"""By how much, in proportion and for each word of a query, a score of the matrix (in single precision, of parts that are not
negative) may differ from the sum that ranks."""


def cosine_top(
    index: LexicalIndex, queries: DataFrame, k: int, query_cols: Sequence[str] = ("query_id",), text_col: str = "text",
    rank: str = "rank",
) -> DataFrame:
    """(query, id, score, overlap, rank): the best k documents per query by the cosine of pair_scores, exactly.

    Every query meets every document that shares a word with it, but no row stands for such a pair: a task holds the words of a
    group of queries, streams a part of the documents past them and keeps the best k per query.  So documents shuffle once per
    group of queries, and only k rows per query and part move on.
    """
    keys = list(query_cols)
    id_type = index.postings.schema[index.id_col].dataType.simpleString()
    words = query_terms(queries, index.tokenizer, query_cols, text_col).groupBy(*keys).agg(
        F.first("n_words").alias("n_words"), F.collect_list(F.struct("term", F.col("qtf").alias("n"), F.col("qnorm").alias("norm"))).alias("w"))
    texts = index.postings.groupBy(index.id_col).agg(F.collect_list(F.struct("term", F.col("tf").alias("n"), "norm")).alias("w"))
    n_queries = queries.select(F.lit(1)).count()
    groups = max(1, -(-n_queries // GROUP_QUERIES))
    n_postings = index.corpus.select("n_postings").first()[0]
    parts = max(queries.sparkSession.sparkContext.defaultParallelism, -(-n_postings // PART_POSTINGS))

    def packed(df: DataFrame, docs: bool, own: list[str], others: int, cell) -> DataFrame:
        copies = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        nothing = F.lit(None)
        return copies.select(
            cell(F.pmod(F.xxhash64(*own), F.lit(parts if docs else groups)).cast("int"), F.col("_copy")).alias("cell"),
            F.lit(docs).alias("is_doc"),
            *[(nothing.cast(queries.schema[c].dataType) if docs else F.col(c)).alias(f"q_{i}") for i, c in enumerate(keys)],
            (nothing.cast("long") if docs else F.col("n_words").cast("long")).alias("n_words"),
            (F.col(index.id_col) if docs else nothing.cast(id_type)).alias("id"),
            *[F.col("w")[c].alias(c) for c in ("term", "n", "norm")])

    both = packed(words, False, keys, parts, lambda group, part: group * parts + part).unionByName(
        packed(texts, True, [index.id_col], groups, lambda part, group: group * parts + part))
    # all queries of a cell come before its documents
    streams = both.repartitionById(parts * groups, F.col("cell")).sortWithinPartitions("cell", "is_doc")
    shown = [f"q_{i}" for i in range(len(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, best = None, None
        for batch in batches:
            at, docs = batch.column("cell").to_numpy(), batch.column("is_doc").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(at) != 0) | (np.diff(docs.astype("int8")) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(at)]):
                if a == b:
                    continue
                if at[a] != cell:
                    if best is not None:
                        yield from best.rows()
                    cell, best = at[a], _Best(k, shown)
                some = batch.slice(a, b - a)
                best.see(some) if docs[a] else best.ask(some)
        if best is not None:
            yield from best.rows()

    schema = ", ".join([*[f"{s} {queries.schema[c].dataType.simpleString()}" for s, c in zip(shown, keys)],
                        f"id {id_type}, score double, overlap double"])
    found = streams.mapInArrow(run, schema).select(
        *[F.col(s).alias(c) for s, c in zip(shown, keys)], F.col("id").alias(index.id_col), "score", "overlap")
    return top_k(found, keys, [F.col("score").desc(), F.col(index.id_col)], k, rank)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Row number, word, count and norm of all words of a batch."""
    lists = batch.column("term")
    rows = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return rows, lists.flatten(), batch.column("n").flatten().to_numpy(), batch.column("norm").flatten().to_numpy()


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers start, start + 1, ... of spans of given sizes, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class _Best:
    """The best k documents so far of the queries of one cell."""

    def __init__(self, k: int, shown: list[str]):
        self.k, self.shown, self.asked, self.blocks = k, shown, [], None

    def ask(self, batch: pa.RecordBatch) -> None:
        self.asked.append(batch)

    def _start(self) -> None:
        """Words get numbers in their order, as sums go by word; queries are cut into blocks."""
        table = pa.Table.from_batches(self.asked).combine_chunks()
        self.blocks, self.vocabulary = [], pa.array([], pa.string())
        if not len(table):
            return
        batch = table.to_batches()[0]
        rows, terms, n, norm = _flat(batch)
        self.vocabulary = pa.array(sorted(pc.unique(terms).to_pylist()), pa.string())
        number = pc.index_in(terms, value_set=self.vocabulary).to_numpy()
        for a in range(0, len(batch), QUERIES):
            own = np.flatnonzero((rows >= a) & (rows < a + QUERIES))
            self.blocks.append(_Block(self.k, batch.slice(a, QUERIES), rows[own] - a, number[own], n[own], norm[own]))

    def see(self, batch: pa.RecordBatch) -> None:
        if self.blocks is None:
            self._start()
        if not self.blocks:
            return
        for a in range(0, len(batch), DOCS):
            some = batch.slice(a, DOCS)
            rows, terms, n, norm = _flat(some)
            number = pc.fill_null(pc.index_in(terms, value_set=self.vocabulary), -1).to_numpy()
            known = np.flatnonzero(number >= 0)
            known = known[np.lexsort((rows[known], number[known]))]
            ids = some.column("id").to_numpy(zero_copy_only=False)
            docs = (ids, number[known], rows[known], n[known] / norm[known], n[known], norm[known])
            for block in self.blocks:
                block.meet(*docs)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for block in self.blocks or []:
            keys = [block.batch.column(c).take(pa.array(block.q)) for c in self.shown]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(block.id), pa.array(block.score), pa.array(block.n_met / block.n_words[block.q])],
                names=[*self.shown, "id", "score", "overlap"])


class _Held:
    """Where documents have words, from postings sorted by word and document: in a table if that is small."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, n_docs: int):
        self.n_docs, self.keys, self.table = n_docs, term.astype("int64") * n_docs + doc, None
        first = np.flatnonzero(np.diff(term, prepend=-1))
        if (len(first) + 1) * n_docs <= TABLE and len(term) and np.diff(self.keys, prepend=-1).all():  # no document has a word twice
            self.row = np.zeros(int(term[-1]) + 2, "int64")  # the first row is for words that no document has
            self.row[term[first]] = np.arange(1, len(first) + 1)
            self.table = np.full((len(first) + 1) * n_docs, -1, "int32")
            self.table[self.row[term] * n_docs + doc] = np.arange(len(term))

    def find(self, term: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For all that there are: which of the pairs of word and document it is, and the place of the posting."""
        if self.table is not None:
            post = self.table[self.row[np.minimum(term, len(self.row) - 1)] * self.n_docs + doc]
            at = np.flatnonzero(post >= 0)
            return at, post[at]
        wanted = term.astype("int64") * self.n_docs + doc
        low = np.searchsorted(self.keys, wanted)
        found = np.searchsorted(self.keys, wanted, "right") - low
        return np.repeat(np.arange(len(wanted)), found), _spans(low, found)


class _Block:
    """Some queries: their words by query (for the sums that rank) and by word (for the matrix), and their best documents.

    n_met counts the words of the query that a document has, or those of the query of `first` that stands for it.
    """

    first, first_of = None, None

    def __init__(self, k: int, batch: pa.RecordBatch, q: np.ndarray, term: np.ndarray, n: np.ndarray, norm: np.ndarray):
        self.k, self.batch, self.n_words = k, batch, batch.column("n_words").to_numpy()
        order = np.lexsort((term, q))
        self.term, self.n, self.norm = term[order], n[order], norm[order]
        self.start = np.searchsorted(q[order], np.arange(len(batch) + 1))
        order = np.lexsort((q, term))
        pairs = term[order].astype("int64") * QUERIES + q[order]
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        self.by_q = pairs[first] % QUERIES
        self.by_weight = (np.add.reduceat((n / norm)[order], first) if len(first) else np.zeros(0)).astype(np.float32)
        self.slack = 1 - SLACK * (np.bincount(q, minlength=len(batch)) + 8)
        self.words, self.word_start = np.unique(pairs[first] // QUERIES, return_index=True)
        self.word_size = np.diff(np.append(self.word_start, len(first)))
        self.q, self.id, self.score, self.n_met = np.zeros(0, "int64"), None, np.zeros(0), np.zeros(0, "int64")
        self.floor = np.zeros(len(batch))

    def common(self, q: np.ndarray, d: np.ndarray, held: _Held) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pair, word of the query and place among the documents' words of all words that pairs share, by pair and word."""
        sizes = self.start[q + 1] - self.start[q]
        word = _spans(self.start[q], sizes)
        at, post = held.find(self.term[word], np.repeat(d, sizes))
        return np.repeat(np.arange(len(q)), sizes)[at], word[at], post

    def _shares(self, word: np.ndarray, n: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """What words add to the sums that rank."""
        return self.n[word] * n / (self.norm[word] * norm)

    def _matrix(self, n_docs: int, term: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Scores of all queries and documents, but for the order of the sums."""
        out, weight = np.zeros((len(self.batch), n_docs), np.float32), weight.astype(np.float32)
        first = np.flatnonzero(np.diff(term, prepend=-1))
        _, mine, theirs = np.intersect1d(self.words, term[first], assume_unique=True, return_indices=True)
        size = np.diff(np.append(first, len(term)))[theirs]
        start, q_start, q_size = first[theirs], self.word_start[mine], self.word_size[mine]
        shared = q_size * size
        dense = np.flatnonzero(shared > DENSE * out.size)
        if len(dense):
            left, right = np.zeros((len(self.batch), len(dense)), np.float32), np.zeros((len(dense), n_docs), np.float32)
            for i, t in enumerate(dense):
                a, b = q_start[t], start[t]
                left[self.by_q[a: a + q_size[t]], i] = self.by_weight[a: a + q_size[t]]
                np.add.at(right[i], doc[b: b + size[t]], weight[b: b + size[t]])
            out += left @ right
        plain = np.diff(term * n_docs + doc, prepend=-1).all()  # no document has a word twice
        for t in np.flatnonzero((shared > LOOPED) & (shared <= DENSE * out.size) & plain):
            a, b = q_start[t], start[t]
            out[self.by_q[a: a + q_size[t], None], doc[b: b + size[t]]] += (
                self.by_weight[a: a + q_size[t], None] * weight[b: b + size[t]])
        rest = np.flatnonzero((shared <= (LOOPED if plain else DENSE * out.size)) & (shared <= DENSE * out.size))
        mine = _spans(q_start[rest], q_size[rest])
        each = np.repeat(size[rest], q_size[rest])
        theirs = _spans(np.repeat(start[rest], q_size[rest]), each)
        mine = np.repeat(mine, each)
        np.add.at(out.reshape(-1), self.by_q[mine] * n_docs + doc[theirs], self.by_weight[mine] * weight[theirs])
        return out

    def meet(self, ids: np.ndarray, term: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: np.ndarray, norm: np.ndarray,
             held: _Held | None = None) -> None:
        """Documents (ids) with their words sorted by word and document, against all queries of the block.

        weight is what a word adds to a score of the matrix, for a query's weight of one; n and norm give the sums that rank.
        """
        term, n_docs = term.astype("int64"), len(ids)
        scores = self._matrix(n_docs, term, doc, weight)
        near = scores >= np.maximum(self.floor * self.slack, LEAST).astype(np.float32)[:, None]
        many = np.flatnonzero(np.count_nonzero(near, axis=1) > 2 * self.k)
        if len(many):
            cut = np.partition(scores[many], n_docs - self.k, axis=1)[:, n_docs - self.k]
            near[many] &= scores[many] >= (cut * self.slack[many]).astype(np.float32)[:, None]
        q, d = np.nonzero(near)
        if not len(q):
            return
        # the sums that rank go by word, as in pair_scores, so equal documents tie
        held = held or _Held(term, doc, n_docs)
        pair, word, post = self.common(q, d, held)
        score = np.bincount(pair, self._shares(word, n[post], norm[post]), len(q))
        n_met = np.bincount(pair if self.first is None else self.first.common(self.first_of[q], d, held)[0], minlength=len(q))
        q, score, n_met = np.append(self.q, q), np.append(self.score, score), np.append(self.n_met, n_met)
        ids = ids[d] if self.id is None else np.append(self.id, ids[d])
        by_id = np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids
        order = np.lexsort((by_id, -score, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        order = order[place < self.k]
        self.q, self.id, self.score, self.n_met = q[order], ids[order], score[order], n_met[order]
        last = self.score[np.searchsorted(self.q, np.arange(len(self.batch)), "right") - 1]
        full = np.bincount(self.q, minlength=len(self.batch)) == self.k
        self.floor = np.where(full, last, 0.0)


class _Keywords(_Block):
    """As _Block, by BM25: a query's word has its count times its weight, and the norm of a document's word is what it is divided by."""

    def _shares(self, word: np.ndarray, n: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return self.n[word] * n * (K1 + 1) / norm  # the order fixes the rounding


def best_paths(index: LexicalIndex, variants: DataFrame, k: int, vector: bool = True) -> DataFrame | None:
    """(query_id, path, rank, score, id, overlap): search_paths of the pair_scores, without a row per query and document.

    A task holds the words of all variants (query_id, variant_no, text), streams its documents past them and keeps the best k per
    path.  None if the variants have over BROADCAST_ROWS words or a word of negative weight.
    """
    spark, id_col = variants.sparkSession, index.id_col
    words = query_terms(variants, index.tokenizer, ("query_id", "variant_no")).limit(BROADCAST_ROWS + 1).toArrow()
    terms = pc.unique(words.column("term"))
    if len(words) > BROADCAST_ROWS:
        return None
    terms = pa.array(sorted(terms.to_pylist()), pa.string())
    numbers = spark.createDataFrame(pa.table({"term": terms, "no": pa.array(range(len(terms)), pa.int32())}))
    weighted = index.terms.join(F.broadcast(numbers), "term").select("no", "idf").toArrow()
    idf = np.full(len(terms), np.nan)
    idf[weighted.column("no").to_numpy()] = weighted.column("idf").to_numpy()
    if (idf < 0).any():
        return None
    avgdl = index.corpus.select("avgdl").first()[0]
    known = ~np.isnan(idf)
    number = pc.index_in(words.column("term"), value_set=terms).to_numpy()
    words = words.filter(pa.array(known[number]))
    number = number[known[number]]
    # a row for each variant; its words point to it
    owners = list(zip(words.column("query_id").to_pylist(), words.column("variant_no").to_pylist()))
    place = {key: i for i, key in enumerate(dict.fromkeys(owners))}
    q = np.array([place[key] for key in owners], np.int64)
    n_words = np.ones(len(place), np.int64)
    n_words[q[::-1]] = words.column("n_words").to_numpy()[::-1]
    firsts = np.array([place.get((query, 0), -1) for query, _ in place], np.int64)
    id_type, query_type = (df.schema[c].dataType.simpleString() for df, c in ((index.postings, id_col), (variants, "query_id")))
    asked = pa.table({"query_id": pa.array([key[0] for key in place], words.schema.field("query_id").type),
                      "variant_no": pa.array([key[1] for key in place], pa.int64()), "n_words": n_words}).combine_chunks().to_batches()
    qtf, qnorm = (words.column(c).to_numpy().astype("float64") for c in ("qtf", "qnorm"))
    shared = spark.sparkContext.broadcast((asked, q, number, qtf, qnorm, idf[number], firsts))
    wanted = index.postings.filter(F.col("term").isin(terms.to_pylist())).join(F.broadcast(numbers), "term") if len(terms) else (
        index.postings.limit(0).withColumn("no", F.lit(0)))
    texts = wanted.groupBy(id_col).agg(F.collect_list(F.struct("no", F.col("tf").alias("n"), "dl", "norm")).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, q, number, qtf, qnorm, idf, firsts = shared.value
        if not asked:
            return
        paths = _Paths(k, asked[0], q, number, qtf, qnorm, idf, firsts, vector)
        for batch in batches:
            for a in range(0, batch.num_rows, DOCS):
                paths.see(batch.slice(a, DOCS), avgdl)
        yield from paths.rows()

    found = texts.select(F.col(id_col).alias("id"), *[F.col("w")[c].alias(c) for c in ("no", "n", "dl", "norm")]).mapInArrow(
        run, f"query_id {query_type}, path string, score double, id {id_type}, overlap double")
    return top_k(found.withColumnRenamed("id", id_col), ["query_id", "path"], [F.col("score").desc(), F.col(id_col)], k).select(
        "query_id", "path", "rank", "score", id_col, "overlap")


class _Paths:
    """The best k documents so far of all variants by cosine, and of the original wordings (variant 0) by BM25."""

    def __init__(self, k: int, asked: pa.RecordBatch, q: np.ndarray, number: np.ndarray, qtf: np.ndarray, qnorm: np.ndarray,
                 idf: np.ndarray, firsts: np.ndarray, vector: bool):
        # originals first count what a document has of them; a variant without one has an empty query for it
        self.n_words = np.append(asked.column("n_words").to_numpy(), 1)
        self.firsts, originals = firsts, np.flatnonzero(asked.column("variant_no").to_numpy() == 0)
        self.vectors, self.words = [], []
        counted = _Block(k, pa.RecordBatch.from_pydict({"n_words": self.n_words}), q, number, qtf, qnorm)
        for rows, kind, weight, norm, out in ((np.arange(len(asked)) if vector else originals[:0], _Block, qtf, qnorm, self.vectors),
                                              (originals, _Keywords, qtf * idf, np.ones(len(q)), self.words)):
            for a in range(0, len(rows), QUERIES):
                some = rows[a: a + QUERIES]
                at = np.full(len(asked), -1)
                at[some] = np.arange(len(some))
                own = np.flatnonzero(at[q] >= 0)
                block = kind(k, asked.take(pa.array(some)), at[q[own]], number[own], weight[own], norm[own])
                block.first, block.first_of = counted, np.where(firsts[some] < 0, len(asked), firsts[some])
                out.append(block)

    def see(self, batch: pa.RecordBatch, avgdl: float) -> None:
        lists = batch.column("no")
        rows = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        term, n, dl, norm = (batch.column(c).flatten().to_numpy() for c in ("no", "n", "dl", "norm"))
        order = np.lexsort((rows, term))
        term, rows, n, dl, norm = term[order], rows[order], n[order], dl[order], norm[order]
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        held = _Held(term, rows, len(ids))
        for block in self.vectors:
            block.meet(ids, term, rows, n / norm, n, norm, held)
        by = n + K1 * (1 - B + B * dl / avgdl)
        for block in self.words:
            block.meet(ids, term, rows, n * (K1 + 1) / by, n, by, held)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for blocks, name in ((self.vectors, None), (self.words, "words")):
            for block in blocks:
                if block.id is None:
                    continue
                some = block.batch.take(pa.array(block.q))
                path = [name or f"vector_{v:02d}" for v in some.column("variant_no").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column("query_id"), pa.array(path, pa.string()), pa.array(block.score), pa.array(block.id),
                     pa.array(block.n_met / self.n_words[block.first_of[block.q]])], names=["query_id", "path", "score", "id", "overlap"])
