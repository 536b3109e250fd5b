"""Lexical index tables and BM25 scoring for whole query sets."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from clauselake.functions.text import mixed_tokens, squeeze
from clauselake.operators.scale import BROADCAST_ROWS, broadcast_if, top_k

Tokenizer = Callable[[Column], Column]
Store = Callable[[DataFrame], DataFrame]

HOT_TERMS = 2000
"""A term with more than 1/HOT_TERMS of all postings is split over tasks where the postings shuffle by term."""

PREFIX, HEAD = 200, 40

BUCKET_CHARS = 4 << 20
"""Characters of text whose postings stand in one bucket, so that a task sorts and sums them in memory."""

BUCKETS_FOR_ALL = 16_384
"""Buckets at most."""

LENGTH_CLASSES = 8
"""Blocks of documents for each doubling of the number of words."""

FREQUENT = 8
"""Documents from which on a term has its highest shares stored by block; postings of rarer terms are always scored."""

LEFT_OUT = 0.3
"""Part of the floor up to which terms are left out at first: with more, fewer postings are read, but more documents stay
within reach and are scored in full."""

PUSHED_TERMS = 10_000
"""Words of a query set up to which a bounded search pushes them to the scan of the postings."""

PROBE_POSTINGS, PROBED = 2000, 100
"""Postings of a query's rarest terms that are looked at first, and the best documents of these that are scored in full."""

# fixed values: ranking defaults
K1 = 1.5
B = 0.75
IDF_FLOOR = 0.25


def term_counts(
    docs: DataFrame, id_cols: Sequence[str], text_col: str, tokenizer: Tokenizer = mixed_tokens
) -> DataFrame:
    """Rows (ids, dl, norm, term, tf): text length in words, length of the count vector, word and count.

    Counting happens inside the row, by run lengths of the sorted words, so postings need no shuffle at all.
    """
    # inline_outer: a plain explode would add a filter that repeats the whole expression below the exchange
    sorted_words = docs.select(*id_cols, F.sort_array(tokenizer(F.col(text_col))).alias("_s"))
    starts = sorted_words.withColumn(
        "_b",
        F.filter(
            F.when(F.size("_s") > 0, F.sequence(F.lit(0), F.size("_s") - 1)),
            lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1)),
        ),
    )
    runs = F.transform(
        F.col("_b"),
        lambda start, j: F.struct(
            F.get("_s", start).alias("term"),
            (F.coalesce(F.get("_b", j + 1), F.size("_s")) - start).cast("long").alias("tf"),
        ),
    )
    counted = starts.select(*id_cols, F.size("_s").cast("long").alias("dl"), runs.alias("_r"))
    squares = F.aggregate("_r", F.lit(0).cast("long"), lambda acc, x: acc + x["tf"] * x["tf"])
    postings = counted.withColumn("norm", F.sqrt(squares)).select(*id_cols, "dl", "norm", F.inline_outer("_r"))
    return postings.filter(F.col("term").isNotNull())


def grouped_counts(
    docs: DataFrame, id_cols: Sequence[str], text_col: str, tokenizer: Tokenizer = mixed_tokens
) -> DataFrame:
    """As term_counts, by grouping the words of a row: less work where texts have few different words for their length.

    Texts that are partitioned by an id column stay where they are.
    """
    own = docs.select(*id_cols, F.monotonically_increasing_id().alias("_row"), tokenizer(F.col(text_col)).alias("_words"))
    words = own.select(*id_cols, "_row", F.explode_outer("_words").alias("term")).filter(F.col("term").isNotNull())
    counted = words.groupBy(*id_cols, "_row", "term").agg(F.count("*").alias("tf"))
    whole = Window.partitionBy(*id_cols, "_row")
    return counted.select(*id_cols, F.sum("tf").over(whole).alias("dl"), F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(whole)).alias("norm"),
                          "term", "tf")


def prefix_key(text: Column, n: int = PREFIX) -> Column:
    """Text without blanks, first n characters; blanks are taken from the whole text only if its head has too many."""
    text = F.coalesce(text, F.lit(""))
    head = squeeze(F.substring(text, 1, 2 * n))
    return F.substring(F.when(F.length(head) >= n, head).otherwise(squeeze(text)), 1, n)


@dataclass
class LexicalIndex:
    """One corpus: postings(id, dl, norm, term, tf), terms(term, df, idf), corpus(n_docs, avgdl, ...), facts(id, key, head).

    bounds(term, block, n, top) has the highest share of each frequent term in a block of documents of like length; an index
    without it scores all postings.  The tokenizer that cut the texts also cuts the queries.
    """

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    facts: DataFrame
    id_col: str = "doc_id"
    tokenizer: Tokenizer = mixed_tokens
    bounds: DataFrame | None = None

    @classmethod
    def read(cls, spark: SparkSession, path: str, id_col: str = "doc_id", tokenizer: Tokenizer = mixed_tokens) -> LexicalIndex:
        """Index written before, to be read with the tokenizer it was written with."""
        terms, corpus, facts = (spark.read.parquet(f"{path}/{p}") for p in ("terms", "corpus", "facts"))
        n_buckets, columns = corpus.select("n_buckets", "columns").first()
        name = _table_name(path)
        if not spark.catalog.tableExists(name):
            spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{id_col}`) SORTED BY (term, `{id_col}`) "
                f"INTO {n_buckets} BUCKETS LOCATION '{path}/postings'")
        return cls(spark.table(name), terms, corpus, facts, id_col, tokenizer, spark.read.parquet(f"{path}/bounds"))


def _table_name(path: str) -> str:
    return f"clauselake_postings_{hashlib.md5(path.encode()).hexdigest()}"


def _term_table(postings: DataFrame, n_docs: Column) -> DataFrame:
    """(term, df, idf): log odds, where terms in over half of the documents get a share of the mean instead."""
    return term_weights(postings.groupBy("term").agg(F.count("*").alias("df")), n_docs)


def term_weights(frequencies: DataFrame, n_docs: Column) -> DataFrame:
    """(term, df, idf) from (term, df)."""
    raw = frequencies.withColumn("_raw", F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("_raw")).scalar()
    return raw.select(
        "term", "df", F.when(F.col("_raw") < 0, F.lit(IDF_FLOOR) * mean).otherwise(F.col("_raw")).alias("idf"))


def _facts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """What searches show and compare of a document, so that they need no text."""
    return docs.select(id_col, prefix_key(F.col(text_col)).alias("key"), F.substring(text_col, 1, HEAD).alias("head"))


def length_block(dl: Column) -> Column:
    """The block of documents of like length: their shares for a term differ little, so its highest one says much."""
    return F.floor(F.log2(dl) * LENGTH_CLASSES).cast("int")


def share(avgdl: Column) -> Column:
    """What a posting adds to a score, but for the weight of its term."""
    tf = F.col("tf")
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / avgdl))


def _bounds(postings: DataFrame, terms: DataFrame, avgdl: Column) -> DataFrame:
    """(term, block, n, top) of the terms with FREQUENT postings or more; a sum by term and block shrinks map-side."""
    frequent = broadcast_if(terms.filter(F.col("df") >= FREQUENT).select("term"))
    return postings.join(frequent, "term", "left_semi").groupBy("term", length_block(F.col("dl")).alias("block")).agg(
        F.count("*").alias("n"), F.max(share(avgdl)).alias("top"))


def _corpus(docs: DataFrame, postings: DataFrame, id_col: str) -> DataFrame:
    """Documents without words count for n_docs and avgdl only."""
    n_docs = docs.select(id_col).agg(F.count("*")).scalar()
    return postings.agg(F.sum("tf").alias("_words"), F.count("*").alias("n_postings")).select(
        n_docs.alias("n_docs"), (F.coalesce("_words", F.lit(0)) / n_docs).alias("avgdl"), "n_postings")


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: Tokenizer = mixed_tokens
) -> LexicalIndex:
    """Index over all documents, as plans."""
    return lexical_index(docs, term_counts(docs, [id_col], text_col, tokenizer), id_col, text_col, tokenizer)


def lexical_index(
    docs: DataFrame, postings: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: Tokenizer = mixed_tokens
) -> LexicalIndex:
    """Index over documents whose postings are at hand, as plans."""
    corpus = _corpus(docs, postings, id_col)
    terms = _term_table(postings, corpus.select("n_docs").scalar())
    return LexicalIndex(postings, terms, corpus, _facts(docs, id_col, text_col), id_col, tokenizer)


def write_index(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: Tokenizer = mixed_tokens,
    n_buckets: int | None = None, counts: Callable[..., DataFrame] = term_counts,
) -> LexicalIndex:
    """Index written as tables: texts are cut into words once, statistics come from the written postings.

    Postings are bucketed by document and sorted by term.  A document's postings then stand in one task, so scores are
    summed without an exchange, in the order of the terms, and the few terms of a query set leave most pages out.  Buckets
    grow in number with the texts, not in size, and texts move to them before they are cut into words.
    """
    spark = docs.sparkSession
    started = time.time()
    n = n_buckets or bucket_count(docs, text_col)
    postings = counts(docs.select(id_col, text_col).repartition(n, id_col), [id_col], text_col, tokenizer)
    postings.write.mode("overwrite").bucketBy(n, id_col).sortBy("term", id_col).option(
        "path", f"{path}/postings").saveAsTable(_table_name(path))
    stored = spark.table(_table_name(path))
    columns = ", ".join(f"`{c}` {t}" for c, t in stored.dtypes)
    corpus = _corpus(docs, stored, id_col).select(
        "*", F.lit(n).alias("n_buckets"), F.lit(columns).alias("columns"), F.lit(started).alias("built_at"))
    corpus.write.mode("overwrite").parquet(f"{path}/corpus")
    n_docs = spark.read.parquet(f"{path}/corpus").select("n_docs").scalar()
    _term_table(stored, n_docs).write.mode("overwrite").parquet(f"{path}/terms")
    _facts(docs, id_col, text_col).write.mode("overwrite").parquet(f"{path}/facts")
    avgdl = spark.read.parquet(f"{path}/corpus").select("avgdl").scalar()
    _bounds(stored, spark.read.parquet(f"{path}/terms"), avgdl).write.mode("overwrite").parquet(f"{path}/bounds")
    return LexicalIndex.read(spark, path, id_col, tokenizer)


def bucket_count(docs: DataFrame, text_col: str = "text") -> int:
    """As many buckets as the cores need, and no more text in one than a task holds."""
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    return min(BUCKETS_FOR_ALL, max(docs.sparkSession.sparkContext.defaultParallelism, -(-chars // BUCKET_CHARS)))


def idf_table(index: LexicalIndex) -> DataFrame:
    """(term, df, idf) of every term."""
    return index.terms.select("term", "df", "idf")


def query_terms(
    queries: DataFrame, tokenizer: Tokenizer, query_cols: Sequence[str] = ("query_id",), text_col: str = "text"
) -> DataFrame:
    """(query, term, qtf, qnorm, n_words): a repeated word counts again; n_words counts different ones."""
    counted = term_counts(queries.withColumn("_words", F.size(F.array_distinct(tokenizer(F.col(text_col))))),
                          [*query_cols, "_words"], text_col, tokenizer)
    return counted.select(*query_cols, "term", F.col("tf").alias("qtf"), F.col("norm").alias("qnorm"),
                          F.col("_words").alias("n_words"))


def weighted_postings(
    index: LexicalIndex, qterms: DataFrame, columns: Sequence[str], only: DataFrame | None = None
) -> DataFrame:
    """Postings of the terms of a query set, each joined with the rows of the queries that have the term.

    With `only` (query, id), a posting meets just the queries that its document is listed for.

    One look at the query terms, up to the bound, decides how they meet.  Few of them are broadcast and pushed to the scan as a
    list of terms.  Otherwise both sides shuffle by term, and the postings of a hot term are split over as many tasks
    as it has shares of 1/HOT_TERMS, at most HOT_TERMS terms in all.
    """
    few = [r[0] for r in qterms.select("term").limit(BROADCAST_ROWS + 1).collect()]
    weights = qterms.join(index.terms.select("term", "idf"), "term").select(*columns, "term", "qtf", "qnorm", "n_words", "idf")
    if len(few) <= BROADCAST_ROWS:
        wanted = index.postings.filter(F.col("term").isin(sorted(set(few)))) if few else index.postings.limit(0)
        if only is not None:
            return wanted.join(broadcast_if(only), index.id_col).join(F.broadcast(weights), ["term", *columns])
        return wanted.join(F.broadcast(weights), "term")
    share = F.greatest(F.lit(1), F.ceil(index.corpus.select("n_postings").scalar() / HOT_TERMS))
    hot = index.terms.filter(F.col("df") > share).select("term", F.ceil(F.col("df") / share).cast("int").alias("_parts"))
    split = index.postings.join(F.broadcast(hot), "term", "left").withColumn(
        "_part", F.pmod(F.xxhash64(index.id_col), F.coalesce("_parts", F.lit(1))).cast("int"))
    copied = weights.join(F.broadcast(hot), "term", "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    met = split.drop("_parts").join(copied.drop("_parts"), ["term", "_part"]).drop("_part")
    return met if only is None else met.join(only, [*columns, index.id_col], "left_semi")


def pair_scores(
    index: LexicalIndex, queries: DataFrame, query_cols: Sequence[str] = ("query_id",), text_col: str = "text",
    facets: DataFrame | None = None, only: DataFrame | None = None,
) -> DataFrame:
    """(query, id, bm25, cosine, overlap) for every document sharing a word with a query, all from one pass.

    overlap is the share of the query's different words that the document has.  With facets (id, domain, code) a query's
    `domain` and `spec_codes` columns limit its documents to that domain and to any of those codes; null does not.  With
    `only` (query, id) just these pairs are scored.
    """
    qterms = query_terms(queries, index.tokenizer, query_cols, text_col)
    avgdl = index.corpus.select("avgdl").scalar()
    tf = F.col("tf")
    bm25 = F.col("qtf") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / avgdl))  # the order fixes the rounding
    cosine = F.col("qtf") * tf / (F.col("qnorm") * F.col("norm"))
    met = weighted_postings(index, qterms, query_cols, only)
    pairs = met.groupBy(index.id_col, *query_cols).agg(
        F.sum(bm25).alias("bm25"), F.sum(cosine).alias("cosine"), (F.count("*") / F.first("n_words")).alias("overlap"))
    if facets is None:
        return pairs
    return allowed(pairs, queries, facets, query_cols, index.id_col)


def allowed(
    pairs: DataFrame, queries: DataFrame, facets: DataFrame, query_cols: Sequence[str] = ("query_id",), id_col: str = "doc_id"
) -> DataFrame:
    """The pairs that the filters of their query let through: its domain, and any of its codes."""
    wanted = [c for c in ("domain", "spec_codes") if c in queries.columns]
    rules = queries.select(*query_cols, *[F.col(c).alias(f"_{c}") for c in wanted])
    joined = pairs.join(facets.select(id_col, F.col("domain").alias("_has_domain"), F.col("code").alias("_has_code")), id_col).join(
        rules, list(query_cols))
    if "domain" in wanted:
        joined = joined.filter(F.col("_domain").isNull() | (F.col("_domain") == F.col("_has_domain")))
    if "spec_codes" in wanted:
        codes = F.col("_spec_codes")
        if not isinstance(queries.schema["spec_codes"].dataType, ArrayType):
            codes = F.when(codes.isNotNull(), F.array(codes))
        joined = joined.filter(codes.isNull() | F.array_contains(codes, F.col("_has_code")))
    return joined.select(*pairs.columns)


def ranked(
    scores: DataFrame, score: str, k: int, query_cols: Sequence[str] = ("query_id",), id_col: str = "doc_id"
) -> DataFrame:
    """(query, id, score, rank, overlap): best k per query above zero; equal scores fall back to the id."""
    named = scores.select(*query_cols, id_col, F.col(score).alias("score"), "overlap").filter(F.col("score") > 0)
    return top_k(named, query_cols, [F.col("score").desc(), F.col(id_col)], k)


def bm25_top(
    index: LexicalIndex, queries: DataFrame, k: int, query_cols: Sequence[str] = ("query_id",),
    facets: DataFrame | None = None, store: Store | None = None,
) -> DataFrame:
    """Best k documents per query by BM25, within the queries' domains and codes if facets are given.

    With `store`, which writes a frame and reads it again, and an index that has bounds, only documents that can be among
    the best are scored in full; the rows are the same.
    """
    only = None
    if store is not None and index.bounds is not None and not index.terms.filter("idf < 0").limit(1).count():
        only = reachable(index, queries, k, store, query_cols, facets)
    return ranked(pair_scores(index, queries, query_cols, facets=facets, only=only), "bm25", k, query_cols, index.id_col)


def reachable(
    index: LexicalIndex, queries: DataFrame, k: int, store: Store, query_cols: Sequence[str] = ("query_id",),
    facets: DataFrame | None = None,
) -> DataFrame:
    """(query, id) of the documents that may be among a query's best k: all of those are in it."""
    return _candidates(index, queries, k, store, query_cols, facets)[0]


def _candidates(
    index: LexicalIndex, queries: DataFrame, k: int, store: Store, query_cols: Sequence[str], facets: DataFrame | None
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The documents within reach, the terms scored per block, the terms probed, and the documents scored for the floor.

    1. The postings of a query's rarest terms give its most promising documents; these are scored in full, and the k-th
       best score is a floor that any document among the best reaches.
    2. In each block, terms whose highest shares together stay below a part of the floor are left out: a document that has only
       such terms cannot reach it.  Terms are left out in the order of their share per posting, so frequent ones go first.
    3. The other terms are scored; documents that reach the floor with what the left-out terms could add are within reach.
    """
    keys = list(query_cols)
    avgdl = index.corpus.select("avgdl").scalar()
    qterms = store(query_terms(queries, index.tokenizer, query_cols).join(index.terms, "term"))
    rarest = Window.partitionBy(*keys).orderBy("df", "term")
    upto = F.sum("df").over(rarest.rowsBetween(Window.unboundedPreceding, 0))
    probe = store(qterms.withColumn("_n", F.row_number().over(rarest)).withColumn("_upto", upto).filter(
        (F.col("_n") == 1) | (F.col("_upto") <= PROBE_POSTINGS)))
    gain = F.col("qtf") * F.col("idf") * share(avgdl)

    few = [r[0] for r in qterms.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    read = index.postings.filter(F.col("term").isin(few)) if len(few) <= PUSHED_TERMS else index.postings

    def postings_of(terms: DataFrame, on: Sequence[str] = ("term",)) -> DataFrame:
        wanted = read.join(broadcast_if(terms.select("term").distinct()), "term", "left_semi")
        return wanted.withColumn("block", length_block(F.col("dl"))).join(broadcast_if(terms.select(*keys, *on, "qtf", "idf")), list(on))

    def within(pairs: DataFrame) -> DataFrame:
        return pairs if facets is None else allowed(pairs, queries, facets, query_cols, index.id_col)

    first = within(postings_of(probe).groupBy(index.id_col, *keys).agg(F.sum(gain).alias("_part")))
    likely = store(top_k(first, keys, [F.col("_part").desc(), F.col(index.id_col)], PROBED).select(*keys, index.id_col))
    best = ranked(pair_scores(index, queries, query_cols, only=likely), "bm25", k, query_cols, index.id_col)
    # a little below the k-th score, as sums of other orders may be
    floor = best.filter(F.col("rank") == k).select(*keys, (F.col("score") * (1 - 1e-9)).alias("floor"))
    floors = store(queries.select(*keys).distinct().join(floor, keys, "left").fillna(0.0, "floor"))
    tops = qterms.join(index.bounds, "term").withColumn("_top", F.col("qtf") * F.col("idf") * F.col("top")).join(floors, keys)
    cheapest = Window.partitionBy(*keys, "block").orderBy(F.col("_top") / F.col("n"), "term")
    upto = F.sum("_top").over(cheapest.rowsBetween(Window.unboundedPreceding, 0))
    judged = store(tops.withColumn("_out", upto < F.col("floor") * LEFT_OUT).select(*keys, "term", "block", "qtf", "idf", "n", "_top", "_out"))
    slack = judged.filter("_out").groupBy(*keys, "block").agg(F.sum("_top").alias("_slack"))
    scored = judged.filter(~F.col("_out"))
    rare = qterms.filter(F.col("df") < FREQUENT)
    sums = postings_of(scored, ("term", "block")).select(index.id_col, *keys, "block", gain.alias("_part")).unionByName(
        postings_of(rare).select(index.id_col, *keys, "block", gain.alias("_part"))).groupBy(index.id_col, *keys).agg(
        F.sum("_part").alias("_part"), F.first("block").alias("block"))
    near = sums.join(broadcast_if(slack), [*keys, "block"], "left").join(broadcast_if(floors), keys).filter(
        F.col("_part") + F.coalesce("_slack", F.lit(0.0)) >= F.col("floor"))
    return store(near.select(*keys, index.id_col)), scored, probe, likely


def postings_scored(
    index: LexicalIndex, queries: DataFrame, k: int, store: Store, query_cols: Sequence[str] = ("query_id",)
) -> DataFrame:
    """(query, n_postings, n_scored, n_candidates): postings of a query's terms, those that a bounded search adds up in all its
    passes, and the documents that it scores in full."""
    keys = list(query_cols)
    near, scored, probe, likely = _candidates(index, queries, k, store, query_cols, None)
    qterms = query_terms(queries, index.tokenizer, query_cols).join(index.terms, "term")
    every = qterms.groupBy(*keys).agg(F.sum("df").alias("n_postings"), F.sum(F.when(F.col("df") < FREQUENT, F.col("df")).otherwise(0)).alias("_rare"))
    terms = query_terms(queries, index.tokenizer, query_cols)
    parts = [probe.groupBy(*keys).agg(F.sum("df").alias("_n")), scored.groupBy(*keys).agg(F.sum("n").alias("_n")),
             every.select(*keys, F.col("_rare").alias("_n")),
             *[weighted_postings(index, terms, query_cols, some).groupBy(*keys).agg(F.count("*").alias("_n")) for some in (near, likely)]]
    total = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum("_n").alias("n_scored"))
    return every.drop("_rare").join(total, keys).join(near.groupBy(*keys).agg(F.count("*").alias("n_candidates")), keys)
