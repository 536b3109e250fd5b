"""Retrieval over the given tables: benchmark items and user turns ask, documents and embeddings answer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.functions.text import tokens
from clauselake.operators import dense, fusion, lexical
from clauselake.operators.scale import keep_first, top_k
from clauselake.plans import sql
from clauselake.plans.registry import query
from clauselake.sources.corpus import shared_dir
from clauselake.sources.segments import SegmentedIndex
from clauselake.sources.tables import keep, read_documents, read_table


def bench_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as queries."""
    return read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_INDEXES: dict[tuple, str] = {}


def _indexed(spark: SparkSession, sf: str, name: str, docs: DataFrame, sized: DataFrame | None = None, **how) -> lexical.LexicalIndex:
    """Index written to the shared folder on first use in an application, and again when the files are others."""
    key = (spark.sparkContext.applicationId, sf, name, tuple(sorted(docs.inputFiles())))
    if key not in _INDEXES:
        path = f"{shared_dir(spark)}/clauselake/index-{uuid.uuid4().hex}"
        lexical.write_index(docs, path, n_buckets=None if sized is None else lexical.bucket_count(sized), **how)
        _INDEXES[key] = path
    return lexical.LexicalIndex.read(spark, _INDEXES[key])


def doc_index(spark: SparkSession, sf: str) -> lexical.LexicalIndex:
    """Index of all documents."""
    return _indexed(spark, sf, "plain", read_documents(spark, sf, "text"))


LETTERS = "abcdefghijklmnopqrstuvwxyz"
IDEOGRAPHS = "标准规范设计建筑防火安全出口服务半径高层消防给水结构"


def to_ideographs(text) -> F.Column:
    """Text in the script of the standards: every letter a-z becomes an ideograph, other characters stay."""
    return F.translate(F.lower(text), LETTERS, IDEOGRAPHS)


def cjk_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their texts in ideographs."""
    return read_documents(spark, sf, "source", "text").withColumn("text", to_ideographs(F.col("text")))


def cjk_index(spark: SparkSession, sf: str) -> lexical.LexicalIndex:
    """Index of the documents in ideographs."""
    # the texts are as long as the given ones, and have few different pairs
    return _indexed(spark, sf, "cjk", cjk_documents(spark, sf).select("doc_id", "text"), sized=read_table(spark, sf, "documents", "text"),
                    counts=lexical.grouped_counts)


CJK_TEXT = f"translate(lower(text), '{LETTERS}', '{IDEOGRAPHS}')"
CJK_DOCS = f"cdocs AS (SELECT doc_id, source, {CJK_TEXT} AS text FROM documents)"


def first_sentence(text) -> F.Column:
    """Text up to its first full stop, used as a second wording."""
    return F.regexp_extract(text, r"^[^.]*", 0)


def bench_variants(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, variant_no, text): the item, and its first sentence as the second wording."""
    both = F.array(F.col("text"), first_sentence("text"))
    return bench_queries(spark, sf).select("query_id", F.posexplode(both).alias("variant_no", "text"))


VARIANTS = (
    sql.BENCH + ", bv AS (SELECT query_id, 0 AS variant_no, text FROM bq UNION ALL "
    "SELECT query_id, 1, regexp_extract(text, '^[^.]*') FROM bq)"
)


@query("token_counts", rf"""
SELECT doc_id, len(regexp_extract_all(lower(text), '{sql.WORD}')) AS n_tokens,
       len(list_distinct(regexp_extract_all(lower(text), '{sql.WORD}'))) AS n_distinct,
       len(regexp_extract_all(lower(text), '{sql.WORD}|[^ \t\n\r\f\x0b\x{{00a0}}\x{{3000}}\p{{L}}\p{{N}}]')) AS n_with_punct
FROM documents""")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Words per document, with and without punctuation marks."""
    docs = read_documents(spark, sf, "text")
    words = docs.select("doc_id", tokens(F.col("text")).alias("w"), tokens(F.col("text"), True).alias("p"))
    return words.select(
        "doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct"),
        F.size("p").alias("n_with_punct"),
    )


@query("bm25_index_stats", f"""
WITH {sql.DOC_TERMS}
SELECT max(n_docs) AS n_docs, round(max(avgdl), 6) AS avgdl, count(*) AS n_terms, CAST(sum(df) AS BIGINT) AS n_postings,
       max(df) AS max_df, round(avg(idf), 6) AS mean_idf, count(*) FILTER (idf.df * 2 > n_docs) AS n_floored
FROM idf, corpus""")
def bm25_index_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Size and state of the index."""
    index = doc_index(spark, sf)
    n_docs, avgdl = index.corpus.select("n_docs").scalar(), index.corpus.select("avgdl").scalar()
    return lexical.idf_table(index).agg(
        F.max(n_docs).alias("n_docs"), F.round(F.max(avgdl), 6).alias("avgdl"), F.count("*").alias("n_terms"),
        F.sum("df").alias("n_postings"), F.max("df").alias("max_df"), F.round(F.avg("idf"), 6).alias("mean_idf"),
        F.count_if(F.col("df") * 2 > n_docs).alias("n_floored"),
    )


@query("term_idf", rf"""
WITH p AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{sql.WORD}')) AS term FROM documents),
r AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM p GROUP BY 1),
      (SELECT count(*) AS n FROM documents))
SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END, 6) AS idf FROM r""")
def term_idf(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequency and weight of every word."""
    return lexical.idf_table(doc_index(spark, sf)).select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_topk", f"""
WITH {sql.DOC_TERMS}, {sql.BENCH}, {sql.scores("bq")}, {sql.top("hits", "qscore", "bm25", 10)}
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM hits""")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Ten best documents per benchmark item."""
    return shown(lexical.bm25_top(doc_index(spark, sf), bench_queries(spark, sf), 10))


@query("bm25_bounded", f"""
WITH {sql.DOC_TERMS}, {sql.BENCH}, {sql.scores("bq")}, {sql.top("hits", "qscore", "bm25", 10)}
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM hits""")
def bm25_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """As bm25_topk, but only documents within reach of the best are scored in full."""
    return shown(lexical.bm25_top(doc_index(spark, sf), bench_queries(spark, sf), 10, store=keep(spark)))


@query("bm25_segments", f"""
WITH {sql.DOC_TERMS}, {sql.BENCH}, {sql.scores("bq")}, {sql.top("hits", "qscore", "bm25", 10)}
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM hits""")
def bm25_segments(spark: SparkSession, sf: str) -> DataFrame:
    """As bm25_topk, from an index of three batches that is compacted once; the second batch revises and deletes documents of the first."""
    docs = read_documents(spark, sf, "text")
    index = SegmentedIndex(spark, f"{shared_dir(spark)}/clauselake/segments-{uuid.uuid4().hex}")
    third = F.col("doc_id") % 3
    index.append(docs.filter(third != 2).withColumn("text", F.when(third == 0, F.reverse("text")).otherwise(F.col("text"))), 0)
    index.append(docs.filter(third == 0), 1, deleted=docs.filter(third == 1))
    index.compact()
    index.append(docs, 2)
    return shown(lexical.bm25_top(index.read(), bench_queries(spark, sf), 10))


@query("bm25_work")
def bm25_work(spark: SparkSession, sf: str) -> DataFrame:
    """Per benchmark item: postings of its words, postings that the bounded search adds up, documents it scores in full."""
    return lexical.postings_scored(doc_index(spark, sf), bench_queries(spark, sf), 10, keep(spark))


@query("bm25_cjk", f"""
WITH {CJK_DOCS}, {sql.doc_terms(sql.cjk_words, "cdocs")}, bq AS (SELECT item_id AS query_id, {CJK_TEXT} AS text FROM benchmark),
{sql.scores("bq", tok=sql.cjk_words)}, {sql.top("hits", "qscore", "bm25", 10)}
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM hits""")
def bm25_cjk(spark: SparkSession, sf: str) -> DataFrame:
    """Ten best documents per benchmark item, all in ideographs."""
    queries = bench_queries(spark, sf).withColumn("text", to_ideographs(F.col("text")))
    return shown(lexical.bm25_top(cjk_index(spark, sf), queries, 10))


RULES = """
rules AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 > 0 THEN ['en', 'es'][(item_id % 3)::INTEGER] END AS domain,
  CASE WHEN item_id % 2 = 0 THEN ['src' || (item_id % 20), 'src' || (item_id % 7), 'src3', 'src' || (item_id % 11)] END AS spec_codes
  FROM benchmark)"""


def bench_filters(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, domain, spec_codes): filters of some benchmark items, null where there is none."""
    item = F.col("item_id")

    def code(n):
        return F.concat(F.lit("src"), (item % n).cast("string"))

    return read_table(spark, sf, "benchmark").select(
        item.alias("query_id"), F.when(item % 3 == 1, "en").when(item % 3 == 2, "es").alias("domain"),
        F.when(item % 2 == 0, F.array(code(20), code(7), F.lit("src3"), code(11))).alias("spec_codes"))


def doc_facets(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, domain, code) of the documents."""
    return read_documents(spark, sf, "lang", "source").select(
        "doc_id", F.col("lang").alias("domain"), F.col("source").alias("code"))


ALLOWED = ("(r.domain IS NULL OR r.domain = d.lang) AND (r.spec_codes IS NULL OR list_contains(r.spec_codes, d.source))")


@query("bm25_filtered", f"""
WITH {sql.DOC_TERMS}, {sql.BENCH}, {sql.scores("bq")}, {RULES},
near AS (SELECT q.* FROM qscore q JOIN documents d USING (doc_id) JOIN rules r USING (query_id) WHERE {ALLOWED}),
{sql.top("hits", "near", "bm25", 10)}
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM hits""")
def bm25_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Ten best documents per item within its domain and any of its codes; statistics come from all documents."""
    queries = bench_queries(spark, sf).join(bench_filters(spark, sf), "query_id")
    return shown(lexical.bm25_top(doc_index(spark, sf), queries, 10, facets=doc_facets(spark, sf)))


def shown(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Hits with rounded scores."""
    return hits.select("query_id", id_col, F.round("score", 6).alias("score"), "rank")


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Embeddings as corpus and as queries."""
    corpus = read_table(spark, sf, "embeddings")
    return corpus, corpus.withColumnRenamed("vec_id", "query_id")


COSINE = """
pairs AS (SELECT a.vec_id AS query_id, b.vec_id, a.label AS qlabel, b.label,
  list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
    / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))
       * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS score
  FROM embeddings a, embeddings b)"""


@query("knn_topk", f"""
WITH {COSINE}
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT query_id, vec_id, score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5""")
def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Five nearest vectors of every vector, exactly."""
    corpus, queries = vectors(spark, sf)
    return shown(dense.nearest(corpus, queries, 5), "vec_id")


@query("knn_filtered", f"""
WITH {COSINE}
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT query_id, vec_id, score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM pairs WHERE label = qlabel) WHERE rank <= 3""")
def knn_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Three nearest vectors with the same label."""
    corpus, queries = vectors(spark, sf)
    return shown(dense.nearest(corpus, queries, 3, part_col="label"), "vec_id")


@query("knn_spec_filter", f"""
WITH {COSINE}
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT query_id, vec_id, score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM pairs WHERE label IN (qlabel, (qlabel + 3) % 10)) WHERE rank <= 3""")
def knn_spec_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Three nearest vectors with any of the labels that a query lists."""
    corpus, queries = vectors(spark, sf)
    label = F.col("label")
    return shown(dense.nearest_any(corpus, queries.withColumn("labels", F.array(label, (label + 3) % 10)), 3, "label", "labels"), "vec_id")


@query("knn_lsh_recall")
def knn_lsh_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the ten exact neighbours of every vector that the approximate search finds; has no SQL."""
    corpus = dense.blocks(vectors(spark, sf)[0], store=keep(spark))
    queries = corpus.named("query_id")
    exact = dense.nearest(corpus, queries, 10).select("query_id", "vec_id")
    found = dense.lsh_nearest(corpus, queries, 10).select("query_id", "vec_id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "vec_id"], "left").agg(
        F.count("*").alias("n_exact"), F.count("hit").alias("n_found"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


@query("threshold_hits", f"""
WITH {COSINE}, hits AS (SELECT query_id, vec_id, score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, count(*) AS n_kept, round(min(score), 6) AS lowest FROM hits WHERE rank <= 20 AND score >= 0.3 GROUP BY 1""")
def threshold_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Of the twenty nearest vectors, how many reach the relevance threshold."""
    corpus, queries = vectors(spark, sf)
    hits = dense.nearest(corpus, queries, fusion.CANDIDATES).filter(F.col("score") >= fusion.MIN_RELEVANCE)
    return hits.groupBy("query_id").agg(F.count("*").alias("n_kept"), F.round(F.min("score"), 6).alias("lowest"))


@query("vector_audit", """
SELECT count(*) FILTER (d.doc_id IS NOT NULL AND e.vec_id IS NOT NULL) AS n_both,
       count(*) FILTER (e.vec_id IS NULL) AS n_chunk_only, count(*) FILTER (d.doc_id IS NULL) AS n_vector_only
FROM documents d FULL OUTER JOIN embeddings e ON d.doc_id = e.vec_id""")
def vector_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without vectors and vectors without documents."""
    return dense.key_audit(
        read_table(spark, sf, "documents", "doc_id"), read_table(spark, sf, "embeddings", "vec_id"), "doc_id", "vec_id"
    )


@query("hash_embed", f"""
WITH {sql.DOC_TERMS},
folded AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 64 AS INTEGER) AS bucket,
           CAST(sum(tf) AS DOUBLE) AS w FROM post GROUP BY ALL),
lens AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM folded GROUP BY 1)
SELECT doc_id, bucket, round(w / norm, 6) AS weight FROM folded JOIN lens USING (doc_id)""")
def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    """Word-count vectors of the documents folded into 64 buckets."""
    rows = dense.hashed_vectors(read_documents(spark, sf, "text"), "doc_id", "text")
    return rows.withColumn("weight", F.round("weight", 6))


PATHS = f"""{sql.DOC_TERMS}, {sql.BENCH}, {sql.scores("bq")},
{sql.top("hb", "qscore", "bm25", 20)}, {sql.top("hc", "qscore", "cosine", 20)},
paths AS (SELECT 'vector_00' AS path, * FROM hc UNION ALL SELECT 'words', * FROM hb),
fused AS (SELECT query_id, doc_id, {sql.RRF} AS rrf, count(*) AS n_paths,
          min({{'path': path, 'rank': rank}}) AS first_seen FROM paths GROUP BY 1, 2),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first_seen, doc_id) AS rank FROM fused)"""


def two_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Word and vector paths of the benchmark items, 20 hits each."""
    one = bench_queries(spark, sf).withColumn("variant_no", F.lit(0))
    return fusion.search_paths(
        lexical.pair_scores(doc_index(spark, sf), one, ("query_id", "variant_no")), fusion.CANDIDATES
    )


@query("rrf_fuse", f"""
WITH {PATHS}
SELECT query_id, doc_id, round(rrf, 9) AS rrf, n_paths, rank FROM fr WHERE rank <= 10""")
def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    """Reciprocal rank fusion of both paths."""
    fused = top_k(fusion.fuse(two_paths(spark, sf)), ["query_id"], fusion.fused_order(), 10)
    return fused.select("query_id", "doc_id", F.round("rrf", 9).alias("rrf"), "n_paths", "rank")


@query("prefix_dedup", f"""
SELECT lang, doc_id, n_chars FROM (SELECT lang, doc_id, n_chars, row_number() OVER (
  PARTITION BY lang, {sql.PREFIX_KEY} ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1""")
def prefix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """One document per language and text prefix, the longest."""
    docs = read_documents(spark, sf, "lang", "n_chars", "text").select(
        "doc_id", "lang", "n_chars", lexical.prefix_key(F.col("text")).alias("key")
    )
    kept = fusion.drop_copies(docs, F.col("lang"), F.col("key"), "n_chars", query_cols=())
    return kept.select("lang", "doc_id", "n_chars")


RERANKED = f"""{sql.DOC_TERMS}, {sql.BENCH}, {sql.scores("bq")}, {sql.top("hits", "qscore", "bm25", 20)},
cand AS (SELECT h.query_id, h.doc_id, h.score, h.rank, {sql.overlap("q.text", "d.text")} AS overlap
         FROM hits h JOIN documents d USING (doc_id) JOIN bq q USING (query_id))"""


def bm25_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, doc_id, score, rank, overlap): BM25 hits with the pair score of the offline scorer."""
    return lexical.bm25_top(doc_index(spark, sf), bench_queries(spark, sf), fusion.CANDIDATES)


@query("rerank_topk", f"""
WITH {RERANKED}
SELECT query_id, doc_id, round(overlap, 6) AS overlap, rerank_rank FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY overlap DESC, rank) AS rerank_rank FROM cand WHERE overlap >= 0.1)
WHERE rerank_rank <= 5""")
def rerank_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Five best of the BM25 candidates by pair score."""
    best = fusion.rerank(bm25_candidates(spark, sf), "overlap", [F.col("rank")])
    return best.select("query_id", "doc_id", F.round("overlap", 6).alias("overlap"), "rerank_rank")


@query("passage_format", """
WITH f AS (SELECT doc_id, text AS text_only, source || ' ' || text AS clause_text,
  '<规范>' || lang || '</规范> <条文>' || source || '</条文> ' || text AS rich FROM documents)
SELECT doc_id, md5(text_only) AS text_only, md5(clause_text) AS clause_text, md5(rich) AS rich,
       md5(text_only) AS other FROM f""")
def passage_format(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of each document's passage in every style."""
    docs = read_documents(spark, sf, "lang", "source", "text")
    styles = ["text_only", "clause_text", "rich", "other"]
    return docs.select(
        "doc_id",
        *[F.md5(fusion.passage(s, F.col("lang"), F.col("source"), F.col("text"))).alias(s) for s in styles],
    )


def hybrid_sql(variants: str = VARIANTS, docs: str = "documents", tok=sql.words, allowed: str = "") -> str:
    """CTEs up to rer(query_id, doc_id, rerank_rank, overlap, rrf, n_paths, dedup_rank)."""
    return f"""{sql.doc_terms(tok, docs)}, {variants}, {sql.scores("bv", "query_id, variant_no", tok)},
allpaths AS (SELECT query_id, doc_id, 'vector_0' || variant_no AS path, cosine AS score FROM qscore {allowed}
          UNION ALL SELECT query_id, doc_id, 'words', bm25 FROM qscore {allowed} {"AND" if allowed else "WHERE"} variant_no = 0),
paths AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, doc_id) AS rank
          FROM allpaths WHERE score > 0) WHERE rank <= 40),
fused AS (SELECT query_id, doc_id, {sql.RRF} AS rrf, count(*) AS n_paths,
          min({{'path': path, 'rank': rank}}) AS first_seen FROM paths GROUP BY 1, 2),
fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first_seen, doc_id) AS fused_rank
       FROM fused) WHERE fused_rank <= 40),
ft AS (SELECT f.*, d.source, d.text, {sql.overlap("q.text", "d.text", tok)} AS overlap
       FROM fr f JOIN {docs} d USING (doc_id) JOIN bq q USING (query_id)),
uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source, {sql.PREFIX_KEY}
         ORDER BY rrf DESC, doc_id) AS rn FROM ft) WHERE rn = 1),
ded AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first_seen, doc_id) AS dedup_rank
        FROM uniq) WHERE dedup_rank <= 20),
rer AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, dedup_rank) AS rerank_rank
        FROM ded WHERE overlap >= 0.1) WHERE rerank_rank <= 5)"""


HYBRID = hybrid_sql()
RERANK_COLUMNS = ("query_id, doc_id, rerank_rank, round(overlap, 6) AS overlap, round(rrf, 9) AS rrf, n_paths, dedup_rank")


def reranked(stages: dict[str, DataFrame]) -> DataFrame:
    """Result of a hybrid search with rounded scores."""
    return stages["reranked"].select(
        "query_id", "doc_id", "rerank_rank", F.round("overlap", 6).alias("overlap"), F.round("rrf", 9).alias("rrf"),
        "n_paths", "dedup_rank")


def doc_names(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, code) of the documents."""
    return read_documents(spark, sf, "source").withColumnRenamed("source", "code")


def hybrid(spark: SparkSession, sf: str, several: bool = False) -> dict[str, DataFrame]:
    """Stage tables of the hybrid search of all benchmark items; path hits are stored when several are read."""
    store = f"{shared_dir(spark)}/clauselake/paths-{uuid.uuid4().hex}" if several else None
    return fusion.hybrid_stages(doc_index(spark, sf), bench_variants(spark, sf), doc_names(spark, sf), store=store)


@query("hybrid_search", f"WITH {HYBRID} SELECT {RERANK_COLUMNS} FROM rer")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: two wordings, keyword and vector paths, fusion, de-duplication and rerank for every item."""
    return reranked(hybrid(spark, sf))


CJK_VARIANTS = f"""bq AS (SELECT item_id AS query_id, {CJK_TEXT} AS text FROM benchmark),
bv AS (SELECT query_id, 0 AS variant_no, text FROM bq UNION ALL SELECT query_id, 1, regexp_extract(text, '^[^.]*') FROM bq)"""


@query("hybrid_cjk", f"""
WITH {CJK_DOCS}, {hybrid_sql(CJK_VARIANTS, "cdocs", sql.cjk_words)} SELECT {RERANK_COLUMNS} FROM rer""")
def hybrid_cjk(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship search over texts in ideographs."""
    variants = bench_variants(spark, sf).withColumn("text", to_ideographs(F.col("text")))
    return reranked(fusion.hybrid_stages(cjk_index(spark, sf), variants, doc_names(spark, sf)))


@query("hybrid_filtered", f"""
WITH {RULES}, {hybrid_sql(allowed="JOIN documents d USING (doc_id) JOIN rules r USING (query_id) WHERE " + ALLOWED)}
SELECT {RERANK_COLUMNS} FROM rer""")
def hybrid_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship search within each item's domain and any of its codes."""
    return reranked(fusion.hybrid_stages(
        doc_index(spark, sf), bench_variants(spark, sf), doc_names(spark, sf), filters=bench_filters(spark, sf),
        facets=doc_facets(spark, sf)))


@query("retrieval_funnel", f"""
WITH {HYBRID},
p AS (SELECT query_id, count(*) AS n_candidates, count(DISTINCT path) AS n_paths FROM paths GROUP BY 1),
f AS (SELECT query_id, count(*) AS n_before_dedup FROM fr GROUP BY 1),
d AS (SELECT query_id, count(*) AS n_deduped FROM ded GROUP BY 1),
r AS (SELECT query_id, count(*) AS n_kept FROM rer GROUP BY 1),
v AS (SELECT query_id, count(*) AS n_queries FROM bv GROUP BY 1)
SELECT query_id, n_queries, coalesce(n_paths, 0) AS n_paths, coalesce(n_candidates, 0) AS n_candidates,
  coalesce(n_before_dedup, 0) AS n_before_dedup, coalesce(n_deduped, 0) AS n_deduped, coalesce(n_kept, 0) AS n_kept
FROM v LEFT JOIN p USING (query_id) LEFT JOIN f USING (query_id) LEFT JOIN d USING (query_id) LEFT JOIN r USING (query_id)""")
def retrieval_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """Per query: hits left after each stage."""
    stages = hybrid(spark, sf, several=True)
    out = bench_variants(spark, sf).groupBy("query_id").agg(F.count("*").alias("n_queries"))
    counts = {
        "paths": [F.count("*").alias("n_candidates"), F.countDistinct("path").alias("n_paths")],
        "fused": [F.count("*").alias("n_before_dedup")],
        "deduped": [F.count("*").alias("n_deduped")],
        "reranked": [F.count("*").alias("n_kept")],
    }
    for stage, aggs in counts.items():
        out = out.join(stages[stage].groupBy("query_id").agg(*aggs), "query_id", "left")
    return out.fillna(0)


@query("no_result_queries", f"""
WITH {RERANKED}
SELECT query_id, 'no_result' AS fallback FROM bq
WHERE query_id NOT IN (SELECT query_id FROM cand WHERE overlap >= 0.95)""")
def no_result_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items without any candidate holding nearly all of their words."""
    kept = bm25_candidates(spark, sf).filter(F.col("overlap") >= 0.95)
    return (
        bench_queries(spark, sf).join(kept, "query_id", "left_anti")
        .select("query_id", F.lit("no_result").alias("fallback"))
    )


@query("rerank_fallback", f"""
WITH {sql.DOC_TERMS}, {sql.BENCH}, {sql.scores("bq")}, {sql.top("hits", "qscore", "cosine", 20)},
cand AS (SELECT h.query_id, h.doc_id, h.score AS relevance,
           CASE WHEN d.lang <> 'fr' THEN {sql.overlap("q.text", "d.text")} END AS pair_score
         FROM hits h JOIN documents d USING (doc_id) JOIN bq q USING (query_id))
SELECT query_id, doc_id, round(coalesce(pair_score, relevance), 6) AS final_score, pair_score IS NULL AS used_fallback, rerank_rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(pair_score, relevance) DESC, relevance DESC, doc_id)
        AS rerank_rank
      FROM cand WHERE CASE WHEN pair_score IS NULL THEN relevance >= 0.3 ELSE pair_score >= 0.1 END)
WHERE rerank_rank <= 5""")
def rerank_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Rerank where the scorer has no answer for one language: those pairs keep their vector order."""
    queries = bench_queries(spark, sf)
    hits = lexical.ranked(lexical.pair_scores(doc_index(spark, sf), queries), "cosine", fusion.CANDIDATES)
    pairs = hits.join(read_documents(spark, sf, "lang"), "doc_id").select(
        "query_id", "doc_id", F.col("score").alias("relevance"),
        F.when(F.col("lang") != "fr", F.col("overlap")).alias("pair_score"),
    )
    best = fusion.rerank_or_fallback(pairs, "pair_score", "relevance")
    return best.select(
        "query_id", "doc_id", F.round(F.coalesce("pair_score", "relevance"), 6).alias("final_score"), "used_fallback",
        "rerank_rank",
    )


SUB_QUERIES = r"""
ut AS (SELECT conv_id * 1000 + turn AS query_id, list_filter(list_transform(string_split(text, '.'),
         lambda x: regexp_replace(x, '^[ \t\n\r\f\x0b\x{00a0}\x{3000}]+|[ \t\n\r\f\x0b\x{00a0}\x{3000}]+$', '', 'g')),
         lambda x: x <> '') AS subs FROM conversations WHERE role = 'user'),
sq AS (SELECT query_id, unnest(generate_series(1, len(subs))) AS sub_no, unnest(subs) AS text FROM ut)"""


def turn_sub_queries(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, sub_no, text): sentences of the user turns."""
    turns = read_table(spark, sf, "conversations").filter(F.col("role") == "user")
    parts = F.filter(F.transform(F.split("text", r"\.", -1), fusion.strip), lambda s: s != "")
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.posexplode(parts).alias("i", "text")
    ).select("query_id", (F.col("i") + 1).alias("sub_no"), "text")


@query("decomposed_search", f"""
WITH {sql.DOC_TERMS}, {SUB_QUERIES}, {sql.scores("sq", "query_id, sub_no")},
coarse AS (SELECT * FROM (SELECT query_id, sub_no, doc_id, cosine AS score, row_number() OVER (
  PARTITION BY query_id, sub_no ORDER BY cosine DESC, doc_id) AS coarse_rank FROM qscore) WHERE coarse_rank <= 20),
ct AS (SELECT c.*, d.source, d.lang, d.text, {sql.overlap("q.text", "d.text")} AS overlap
       FROM coarse c JOIN documents d USING (doc_id) JOIN sq q USING (query_id, sub_no)),
uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, sub_no, source, {sql.PREFIX_KEY}
         ORDER BY score DESC, doc_id) AS rn FROM ct) WHERE rn = 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, sub_no ORDER BY overlap DESC, coarse_rank) AS rank
         FROM uniq WHERE overlap >= 0.1) WHERE rank <= 2)
SELECT query_id, sub_no, rank, doc_id, round(overlap, 6) AS overlap FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id, source, lang, substr(text, 1, 40) ORDER BY sub_no, rank) AS mn FROM best) WHERE mn = 1""")
def decomposed_search(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of every user turn searched one by one, two documents each, merged in sentence order."""
    docs = read_documents(spark, sf, "source", "lang")
    found = fusion.decomposed(
        doc_index(spark, sf), turn_sub_queries(spark, sf), docs, code="source", clause="lang"
    )
    return found.withColumn("overlap", F.round("overlap", 6))


RAW_OUTPUT = """
raw AS (SELECT conv_id, turn, regexp_extract(text, '^[^.]*') AS query,
  'Variants: ["' || replace(replace(regexp_extract(text, '^[^.]*'), chr(10), ' '), '"', '') || '", 7, "  ' || chr(39)
  || replace(replace(regexp_extract(text, '[^.]*$'), chr(10), ' '), '"', '') || chr(39) || ' ", "", "  ", "turn ' || turn
  || '", "more", "last"] end ["x"]' AS output FROM conversations WHERE role = 'user')"""


def raw_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with a model-style answer holding a list: text around it, a number, quotes, blanks, too many."""
    turns = read_table(spark, sf, "conversations").filter(F.col("role") == "user")
    first = F.regexp_extract("text", r"^[^.]*", 0)
    last = F.regexp_extract("text", r"[^.]*$", 0)

    def plain(c):
        return F.replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit(""))

    output = F.concat(
        F.lit('Variants: ["'), plain(first), F.lit('", 7, "  \''), plain(last), F.lit('\' ", "", "  ", "turn '),
        F.col("turn").cast("string"), F.lit('", "more", "last"] end ["x"]'),
    )
    return turns.select("conv_id", "turn", first.alias("query"), output.alias("output"))


@query("parse_variants", rf"""
WITH {RAW_OUTPUT},
items AS (SELECT conv_id, turn, query, list_filter(list_transform(list_filter(
    json_extract(regexp_extract(output, '(?s)\[(?:[^\[\]]|\[[^\[\]]*\])*\]'), '$[*]'), lambda x: json_type(x) = 'VARCHAR'),
    lambda x: regexp_replace(trim(regexp_replace(json_extract_string(x, '$'), '^{sql.BLANK}+|{sql.BLANK}+$', '', 'g'), '"''“”‘’'),
      '^{sql.BLANK}+|{sql.BLANK}+$', '', 'g')), lambda x: x <> '') AS vs FROM raw),
lists AS (SELECT conv_id, turn, list_concat([query], vs[1:3]) AS all_vs FROM items),
flat AS (SELECT conv_id, turn, unnest(generate_series(1, len(all_vs))) AS i, unnest(all_vs) AS variant FROM lists),
firsts AS (SELECT conv_id, turn, variant, min(i) AS i FROM flat GROUP BY ALL)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS variant_no, variant FROM firsts""")
def parse_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Wordings parsed out of model outputs, the original first, no repeats."""
    listed = raw_outputs(spark, sf).withColumn("vs", fusion.variant_list(F.col("query"), F.col("output")))
    return listed.select("conv_id", "turn", F.posexplode("vs").alias("variant_no", "variant"))
