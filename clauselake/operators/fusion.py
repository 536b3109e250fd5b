"""Rank fusion, de-duplication, reranking and the hybrid search built from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions.text import mixed_tokens, strip
from clauselake.operators.cosine import best_paths, cosine_top
from clauselake.operators.lexical import LexicalIndex, Tokenizer, allowed, pair_scores
from clauselake.operators.scale import keep_first, top_k

# fixed values: search defaults
RRF_K = 60
MIN_RELEVANCE = 0.3
MIN_RERANK = 0.1
RERANK_TOP = 5
CANDIDATES = 20
PER_SUB_QUERY = 2
MAX_VARIANTS = 3
MAX_SUB_QUERIES = 4
JSON_ARRAY = r"(?s)\[(?:[^\[\]]|\[[^\[\]]*\])*\]"
QUOTES = "\"'“”‘’"


def fuse(hits: DataFrame, query_col: str = "query_id", id_col: str = "doc_id", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of hits (query, path, rank, id): summed score, number of paths, first path.

    A document is on few paths; its shares are summed in the order of the paths, so equal ranks give equal scores.
    """
    shares = F.array_sort(F.collect_list(F.struct("path", (1.0 / (k + F.col("rank"))).alias("share"))))
    grouped = hits.groupBy(query_col, id_col).agg(
        shares.alias("_shares"), F.count("*").alias("n_paths"), F.min(F.struct("path", "rank")).alias("first_seen"),
        *([F.max("overlap").alias("overlap")] if "overlap" in hits.columns else []),
    )
    total = F.aggregate("_shares", F.lit(0.0), lambda acc, x: acc + x["share"])
    return grouped.withColumn("rrf", total).drop("_shares")


def fused_order(id_col: str = "doc_id") -> list[Column]:
    """Order of fused hits: score, then where first seen, then id."""
    return [F.col("rrf").desc(), F.col("first_seen"), F.col(id_col)]


def drop_copies(
    hits: DataFrame, code: Column, key: Column, score: str, id_col: str = "doc_id",
    query_cols: Sequence[str] = ("query_id",),
) -> DataFrame:
    """Of hits with the same code and text prefix keep the best-scored."""
    marked = hits.withColumn("_code", F.coalesce(strip(code), F.lit(""))).withColumn("_key", key)
    return keep_first(marked, [*query_cols, "_code", "_key"], [F.col(score).desc(), F.col(id_col)]).drop(
        "_code", "_key"
    )


def overlap(query: Column, text: Column, tokenizer: Tokenizer = mixed_tokens) -> Column:
    """Share of the query's distinct words found in the text: the offline pair scorer."""
    words = F.array_distinct(tokenizer(query))
    both = F.array_intersect(words, tokenizer(text))
    return F.when(F.size(words) > 0, F.size(both) / F.size(words)).otherwise(0.0)


def score_pairs(
    pairs: DataFrame, scorer: Callable[[list[tuple[str, str]]], np.ndarray], query: str = "query", passage_col: str = "passage",
    out: str = "pair_score", batch: int = 4,
) -> DataFrame:
    """Adds the scores of a model given as a function of a batch of (query, passage) pairs.

    Pairs are range-spread and sorted by passage length first, so that a batch holds passages of similar length.
    """
    parts = pairs.sparkSession.sparkContext.defaultParallelism
    size = F.length(F.coalesce(F.col(passage_col), F.lit("")))
    spread = pairs.repartitionByRange(parts, size, F.xxhash64(query)).sortWithinPartitions(size)
    schema = ", ".join([*[f"`{c}` {t}" for c, t in pairs.dtypes], f"`{out}` double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = list(zip(pdf[query].fillna(""), pdf[passage_col].fillna("")))
            found = [np.asarray(scorer(texts[at: at + batch]), dtype="float64") for at in range(0, len(texts), batch)]
            scores = np.concatenate([np.zeros(0), *found])
            if len(scores) != len(pdf):
                raise ValueError(f"{len(pdf)} pairs gave {len(scores)} scores")
            yield pdf.assign(**{out: scores})

    return spread.mapInPandas(run, schema)


def rerank(
    candidates: DataFrame, pair_score: str, order: Sequence[Column], top: int = RERANK_TOP,
    min_score: float = MIN_RERANK, query_cols: Sequence[str] = ("query_id",),
) -> DataFrame:
    """Drop pairs under min_score, keep the best `top` per query; `order` settles equal scores."""
    kept = candidates.filter(F.col(pair_score) >= min_score)
    return top_k(kept, query_cols, [F.col(pair_score).desc(), *order], top, "rerank_rank")


def rerank_or_fallback(
    candidates: DataFrame, pair_score: str, relevance: str, id_col: str = "doc_id", top: int = RERANK_TOP,
    query_col: str = "query_id",
) -> DataFrame:
    """Rerank; pairs whose score is null (the scorer failed) keep their relevance order and threshold."""
    scored = F.col(pair_score).isNotNull()
    kept = candidates.filter(
        F.when(scored, F.col(pair_score) >= MIN_RERANK).otherwise(F.col(relevance) >= MIN_RELEVANCE)
    ).withColumn("used_fallback", ~scored)
    return top_k(
        kept, [query_col],
        [F.coalesce(pair_score, relevance).desc(), F.col(relevance).desc(), F.col(id_col)], top, "rerank_rank",
    )


def passage(style: str, name: Column, clause: Column, text: Column) -> Column:
    """Text given to the pair scorer: text_only, clause_text or rich; any other style is text_only."""
    name, clause, text = (F.coalesce(c, F.lit("")) for c in (name, clause, text))
    if style == "clause_text":
        parts = F.array(clause, text)
    elif style == "rich":
        parts = F.array(
            F.when(name != "", F.concat(F.lit("<规范>"), name, F.lit("</规范>"))).otherwise(""),
            F.when(clause != "", F.concat(F.lit("<条文>"), clause, F.lit("</条文>"))).otherwise(""),
            text,
        )
    else:
        return text
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")


def search_paths(scores: DataFrame, k: int, id_col: str = "doc_id", vector: bool = True) -> DataFrame:
    """(query_id, path, rank, score, id, overlap): best k per path.

    Scores of (query_id, variant_no) pairs become one long table: every variant has a vector path, and the
    original wording (variant 0) a keyword path as well.  One ranking serves all paths.  overlap is that of the original
    wording; all variants of a document stand in one task, so gathering it needs no exchange.
    """
    number = F.lpad(F.col("v.variant_no").cast("string"), 2, "0")
    both = scores.groupBy(id_col, "query_id").agg(
        F.collect_list(F.struct("variant_no", "bm25", "cosine")).alias("vs"),
        F.coalesce(F.max(F.when(F.col("variant_no") == 0, F.col("overlap"))), F.lit(0.0)).alias("overlap"))
    words = F.struct(F.lit("words").alias("path"), F.col("v.bm25").alias("score"))
    vectors = F.struct(F.concat(F.lit("vector_"), number).alias("path"), F.col("v.cosine").alias("score"))
    long = both.select(id_col, "query_id", "overlap", F.explode("vs").alias("v")).select(
        "query_id", F.col("v.variant_no").alias("variant_no"), id_col, "overlap",
        F.inline(F.array(vectors, words) if vector else F.array(words)),
    ).filter(((F.col("path") != "words") | (F.col("variant_no") == 0)) & (F.col("score") > 0))
    return top_k(long, ["query_id", "path"], [F.col("score").desc(), F.col(id_col)], k).select(
        "query_id", "path", "rank", "score", id_col, "overlap"
    )


def vector_paths(hits: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """Dense hits (query_id, variant_no, id, score) as paths; their overlap with the query is not known here."""
    path = F.concat(F.lit("vector_"), F.lpad(F.col("variant_no").cast("string"), 2, "0"))
    long = hits.filter(F.col("score") > 0).select("query_id", path.alias("path"), "score", id_col)
    return top_k(long, ["query_id", "path"], [F.col("score").desc(), F.col(id_col)], k).select(
        "query_id", "path", "rank", "score", id_col, F.lit(None).cast("double").alias("overlap"))


def hybrid_stages(
    index: LexicalIndex, variants: DataFrame, docs: DataFrame, candidate_k: int = CANDIDATES,
    top: int = RERANK_TOP, store: str | None = None, dense: DataFrame | None = None,
    filters: DataFrame | None = None, facets: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Stage tables of the multi-variant hybrid search: paths, fused, deduped, reranked.

    variants: (query_id, variant_no, text).  docs: (doc_id, code); no document text is read, the overlap comes from the
    postings and the prefix from the index.  dense: hits (query_id, variant_no, doc_id, score) of a vector search, which
    then take the place of the word-count cosine.  filters: (query_id, domain, spec_codes) with facets (doc_id, domain, code)
    limit every path, null limits nothing.  With a store folder the path hits, a few rows per query, are written
    there once, for callers that read several stages.
    """
    wide = 2 * candidate_k
    keys = ("query_id", "variant_no")
    paths = best_paths(index, variants, wide, vector=dense is None) if filters is None else None
    if paths is None:
        scores = pair_scores(index, variants, keys)
        if filters is not None:
            scores = allowed(scores, filters, facets)
        paths = search_paths(scores, wide, vector=dense is None)
    if dense is not None:
        near = dense if filters is None else allowed(dense, filters, facets)
        paths = paths.unionByName(vector_paths(near, wide))
    if store:
        paths.write.mode("overwrite").parquet(store)
        paths = paths.sparkSession.read.schema(paths.schema).parquet(store)
    fused = top_k(fuse(paths), ["query_id"], fused_order(), wide, "fused_rank")
    if dense is not None:
        fused = _with_overlap(index, fused, variants)
    facts = fused.join(docs.select("doc_id", "code"), "doc_id").join(index.facts.select("doc_id", "key"), "doc_id")
    unique = drop_copies(facts, F.col("code"), F.col("key"), "rrf")
    deduped = top_k(unique, ["query_id"], fused_order(), candidate_k, "dedup_rank")
    reranked = rerank(deduped, "overlap", [F.col("dedup_rank")], top)
    return {"paths": paths, "fused": fused, "deduped": deduped, "reranked": reranked}


def _with_overlap(index: LexicalIndex, fused: DataFrame, variants: DataFrame) -> DataFrame:
    """Fused hits with the overlap of the original wording, also for documents that only vectors found."""
    originals = variants.filter(F.col("variant_no") == 0).select("query_id", "text")
    wanted = fused.select("query_id", "doc_id")
    found = pair_scores(index, originals).select("query_id", "doc_id", F.col("overlap").alias("_overlap")).join(
        wanted, ["query_id", "doc_id"], "left_semi")
    return fused.join(found, ["query_id", "doc_id"], "left").withColumn(
        "overlap", F.coalesce("_overlap", "overlap", F.lit(0.0))).drop("_overlap")


def decomposed(
    index: LexicalIndex, sub_queries: DataFrame, docs: DataFrame, per_sub: int = PER_SUB_QUERY,
    candidate_k: int = CANDIDATES, code: str = "code", clause: str = "clause", facets: DataFrame | None = None,
) -> DataFrame:
    """Search, de-duplicate and rerank each sub-query (query_id, sub_no, text) by itself, then merge in order.

    docs: (doc_id, code, clause).  A document found by several sub-queries stays with the first; the merge key is code,
    clause and the first 40 characters.  With facets the sub-queries' domain and spec_codes columns limit the search.
    """
    keys = ("query_id", "sub_no")
    if facets is None:  # a row per sub-query and document that share a word would not fit
        coarse = cosine_top(index, sub_queries, candidate_k, keys, rank="coarse_rank")
    else:
        scores = pair_scores(index, sub_queries, keys, facets=facets).select(
            *keys, "doc_id", F.col("cosine").alias("score"), "overlap")
        coarse = top_k(scores, keys, [F.col("score").desc(), F.col("doc_id")], candidate_k, "coarse_rank")
    facts = coarse.join(docs.select("doc_id", code, clause), "doc_id").join(index.facts, "doc_id")
    unique = drop_copies(facts, F.col(code), F.col("key"), "score", query_cols=keys)
    best = rerank(unique, "overlap", [F.col("coarse_rank")], per_sub, query_cols=keys)
    merged = keep_first(
        best, ["query_id", code, clause, "head"], [F.col("sub_no"), F.col("rerank_rank")]
    )
    return merged.select("query_id", "sub_no", F.col("rerank_rank").alias("rank"), "doc_id", "overlap")


def parse_list(raw: Column) -> Column:
    """Strings of the first JSON array in a model output: trimmed, unquoted, blanks and non-strings dropped."""
    found = F.try_parse_json(F.nullif(F.regexp_extract(raw, JSON_ARRAY, 0), F.lit("")))
    items = F.coalesce(found.try_cast("array<variant>"), F.array().cast("array<variant>"))
    texts = F.transform(
        F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: v.cast("string")
    )
    clean = F.transform(texts, lambda t: strip(F.btrim(strip(t), F.lit(QUOTES))))
    return F.filter(clean, lambda t: t != "")


def variant_list(query: Column, raw: Column, cap: int = MAX_VARIANTS) -> Column:
    """The query itself, then up to cap new wordings from the model output."""
    return F.array_distinct(F.concat(F.array(query), F.slice(parse_list(raw), 1, cap)))


def sub_query_list(query: Column, raw: Column, cap: int = MAX_SUB_QUERIES) -> Column:
    """The query, then up to cap new sub-queries; a single sub-query means the question is not compound."""
    subs = parse_list(raw)
    new = F.array_distinct(F.concat(F.array(query), subs))
    return F.when(F.size(subs) <= 1, F.array(query)).otherwise(F.slice(new, 1, cap + 1))
