"""The registered queries of the training-data operators, and the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.llm import align, ann, bpe, exactdup, langid, lattice, merkle, mixing, neardup, pii, tokens, toxicity, warc
from clauselake.llm.common import BLANKS, WORD, documents
from clauselake.plans.registry import query

VOCABULARY, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def vocabulary(name: str = VOCABULARY) -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_bpe_prefixes")
def op6_bpe_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return bpe.encode_decode(documents(spark, sf_dir, "doc_id", "text"), vocabulary())


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, length and checksum of every document's ids, from the files that hold them."""
    return tokens.tokens_round_trip(spark, documents(spark, sf_dir, "doc_id", "text"), vocabulary())


@query("op5_exact_duplicates", rf"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[{BLANKS}]+', ' ', 'g')) AS text_sha256
           FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
""")
def op5_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document that stays for it."""
    return exactdup.exact_duplicates(documents(spark, sf_dir, "doc_id", "text"))


@query("op2_mixed_sources", rf"""
WITH t AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
           md5('0:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
       FROM t GROUP BY source),
s1 AS (SELECT *, [3, 1, 2][rank % 3 + 1]::BIGINT AS weight FROM s0),
s2 AS (SELECT *, row_number() OVER (ORDER BY source_size * (6 // weight), rank) AS pos FROM s1),
s3 AS (SELECT a.*, (SELECT sum(source_size)::BIGINT FROM s2) AS words,
         (SELECT sum(weight)::BIGINT FROM s2 b WHERE b.pos >= a.pos) AS rest,
         coalesce((SELECT sum(source_size)::BIGINT FROM s2 b WHERE b.pos < a.pos), 0) AS used FROM s2 a),
s4 AS (SELECT *, 4 * source_size * rest <= weight * (3 * words - 4 * used) AS is_full FROM s3),
s5 AS (SELECT *, CASE WHEN is_full THEN (2 * source_size)::DOUBLE ELSE
         (weight * (3 * words - 4 * coalesce((SELECT sum(source_size)::BIGINT FROM s4 WHERE is_full), 0)))::DOUBLE
         / (2 * (SELECT sum(weight)::BIGINT FROM s4 WHERE NOT is_full))::DOUBLE END AS target FROM s4),
q AS (SELECT t.*, rank, words, source_size, target, sum(size) OVER (PARTITION BY rank ORDER BY key, doc_id, size
        ROWS UNBOUNDED PRECEDING)::BIGINT AS done FROM t JOIN s5 ON t.source IS NOT DISTINCT FROM s5.source),
c AS (SELECT *, (done + round * source_size)::DOUBLE / target AS finish
      FROM q, (VALUES (0), (1)) AS r(round) WHERE size > 0),
m AS (SELECT doc_id, 2 * sum(size) OVER (ORDER BY finish, rank, key, doc_id, size, round ROWS UNBOUNDED PRECEDING)
        <= 3 * words AS taken FROM c),
n AS (SELECT doc_id, count(*) AS copies FROM m WHERE taken GROUP BY 1)
SELECT doc_id, size, source_size, target, (size * coalesce(copies, 0))::BIGINT AS taken FROM q LEFT JOIN n USING (doc_id)
""")
def op2_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(documents(spark, sf_dir, "doc_id", "source", "text")).drop("source")


@query("op10_personal_data")
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return pii.find_personal_data(documents(spark, sf_dir, "doc_id", "text"))


@query("op3_capture_history")
def op3_capture_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its archive has it, in the order of the capture history."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return warc.capture_history(spark, pages).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp")


@query("op9_language_spans")
def op9_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, and the number of spans."""
    found = langid.identify(documents(spark, sf_dir, "doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.score_toxicity(documents(spark, sf_dir, "doc_id", "text"), labels)


@query("op4_near_duplicates", rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]]
        ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingles FROM w),
n AS (SELECT doc_id, len(shingles) AS n FROM s),
p AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM p a JOIN p b ON a.shingle = b.shingle
      AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM c JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v
      WHERE 100 * common >= 80 * (a.n + b.n - common)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.reach)
SELECT doc_id, n AS n_shingles, min(reach) AS component_id, doc_id = min(reach) AS kept
FROM r JOIN n USING (doc_id) GROUP BY doc_id, n
""")
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near duplicates of every document, on shingles of two words."""
    return neardup.near_duplicates(documents(spark, sf_dir, "doc_id", "text"), words=2)


@query("op8_nearest_vectors")
def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every twentieth one."""
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


@query("op11_merkle_manifest", r"""
WITH RECURSIVE
d AS (SELECT *, CASE WHEN list_reduce(list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ascii(c)::BIGINT),
    lambda crc, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END,
    xor(crc, b)), 4294967295) & 1 = 1 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents),
e AS (SELECT doc_id, source,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail, coalesce(strlen(other) || ':' || other, '-') AS bad FROM d),
l AS (SELECT doc_id, source, sha256(head || tail) AS leaf, sha256(head || bad) AS changed,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM e),
up(source, level, pos, h, n) AS (SELECT source, 0, pos, leaf, n FROM l UNION ALL
    SELECT source, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM up WHERE n > 1
    GROUP BY source, level, pos // 3, n),
t AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top(level, pos, h, n) AS (SELECT 0, pos, h, n FROM t UNION ALL
    SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM top WHERE n > 1
    GROUP BY level, pos // 3, n),
f(doc_id, source, level, pos, n, h, proof) AS (SELECT doc_id, source, 0, pos, n, changed, '' FROM l UNION ALL
    SELECT f.doc_id, f.source, f.level + 1, f.pos // 3, (f.n + 2) // 3,
      sha256(string_agg(CASE WHEN u.pos = f.pos THEN f.h ELSE u.h END, '' ORDER BY u.pos)),
      f.proof || string_agg(CASE WHEN u.pos = f.pos THEN '' ELSE u.h END, '' ORDER BY u.pos)
    FROM f JOIN up u ON u.source IS NOT DISTINCT FROM f.source AND u.level = f.level AND u.pos // 3 = f.pos // 3
    WHERE f.n > 1 GROUP BY f.doc_id, f.source, f.level, f.pos, f.n, f.h, f.proof),
g(doc_id, level, pos, n, h, proof) AS (SELECT f.doc_id, 0, t.pos, t.n, f.h, f.proof
    FROM f JOIN t ON t.source IS NOT DISTINCT FROM f.source WHERE f.n = 1 UNION ALL
    SELECT g.doc_id, g.level + 1, g.pos // 3, (g.n + 2) // 3,
      sha256(string_agg(CASE WHEN u.pos = g.pos THEN g.h ELSE u.h END, '' ORDER BY u.pos)),
      g.proof || string_agg(CASE WHEN u.pos = g.pos THEN '' ELSE u.h END, '' ORDER BY u.pos)
    FROM g JOIN top u ON u.level = g.level AND u.pos // 3 = g.pos // 3
    WHERE g.n > 1 GROUP BY g.doc_id, g.level, g.pos, g.n, g.h, g.proof)
SELECT l.doc_id, l.leaf, t.h AS subroot, r.h AS root, sha256(g.proof) AS proof_sha256, g.h AS folded_root, g.h = r.h AS verified
FROM l JOIN t ON t.source IS NOT DISTINCT FROM l.source JOIN g ON g.doc_id = l.doc_id AND g.n = 1
CROSS JOIN (SELECT h FROM top WHERE n = 1) r
""")
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, the roots above it, and whether its tampered text is found out."""
    return merkle.merkle_manifest(documents(spark, sf_dir, *merkle.FIELDS))


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of every document by two tokenizers."""
    return align.link_statistics(documents(spark, sf_dir, "doc_id", "text"), vocabulary(), vocabulary(PIECES))


@query("op12_near_vectors", """
WITH RECURSIVE
x AS (SELECT vec_id, list_transform(embedding, lambda c: c::DOUBLE) AS v FROM embeddings),
ok AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM x WHERE v IS NOT NULL AND len(v) > 0
       AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(v, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      AND list_dot_product(a.v, b.v) >= 0.9 * a.norm * b.norm),
r(vec_id, reach) AS (SELECT vec_id, vec_id FROM x UNION SELECT r.vec_id, l.w FROM r JOIN l ON l.u = r.reach),
c AS (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY 1),
n AS (SELECT u AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
""")
def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links and the group of near duplicates of every vector."""
    return lattice.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
