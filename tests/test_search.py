import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauselake.functions.text import cjk_tokens, norm_code
from clauselake.operators import containment, cosine, dense, fusion, lexical, scale

DOCS = [(1, "cat dog cat"), (2, "cat bird"), (3, "cat dog fish"), (4, "cat"), (5, "sun"), (6, "!!")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def scores_by_hand(query: str) -> dict[int, float]:
    """BM25 by hand over DOCS."""
    words = {d: t.replace("!", "").split() for d, t in DOCS}
    n, avg = len(DOCS), sum(map(len, words.values())) / len(DOCS)
    df = {w: sum(w in ws for ws in words.values()) for ws in words.values() for w in ws}
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in raw.items()}
    out = {}
    for d, ws in words.items():
        s = sum(
            idf[w] * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for w in query.split() if w in idf and w in ws
        )
        if s > 0:
            out[d] = s
    return out


def test_bm25_by_hand(spark, docs, tmp_path):
    queries = spark.createDataFrame([("q1", "cat dog dog"), ("q2", "sun"), ("q3", "moon")], "query_id string, text string")
    for index in (lexical.build_index(docs), lexical.write_index(docs, str(tmp_path / "i"), n_buckets=3)):
        got: dict[str, dict[int, float]] = {}
        for r in lexical.bm25_top(index, queries, 10).collect():
            got.setdefault(r.query_id, {})[r.doc_id] = r.score
        want = {"q1": scores_by_hand("cat dog dog"), "q2": scores_by_hand("sun")}
        assert got.keys() == want.keys() and all(got[q] == pytest.approx(want[q]) for q in want)
        stats = index.corpus.collect()[0]
        assert stats.n_docs == 6 and stats.avgdl == pytest.approx(10 / 6)


def test_scores_do_not_depend_on_broadcast(spark, docs, monkeypatch):
    queries = spark.createDataFrame([("q1", "cat dog dog"), ("q2", "cat")], "query_id string, text string")

    def rows():
        scores = lexical.pair_scores(lexical.build_index(docs), queries)
        return sorted(map(tuple, scores.select("query_id", "doc_id", F.round("bm25", 9), F.round("cosine", 9), "overlap").collect()))

    few = rows()
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(lexical, "HOT_TERMS", 20)  # the terms of several documents are split over tasks
    assert rows() == few and {r[4] for r in few} == {1.0, 0.5}


def test_scores_rank_unrounded(spark):
    scores = spark.createDataFrame([(1, 7, 0.5000001, 1.0), (1, 8, 0.5000004, 1.0), (1, 9, 4e-7, 1.0), (1, 10, 0.0, 1.0)],
                                   "query_id int, doc_id int, bm25 double, overlap double")
    assert [r.doc_id for r in lexical.ranked(scores, "bm25", 5).orderBy("rank").collect()] == [8, 7, 9]


CLAUSES = [(1, "疏散楼梯的净宽度不应小于1.10m", "消防", "GB 1"), (2, "服务半径不宜大于300m", "规划", "GB 2"), (3, "给水管道应设置阀门", "市政", "GB 3"),
           (4, "楼梯间应采用自然通风", "消防", "GB 4"), (5, "绿地率不应低于30%", "景观", "GB 2")]


@pytest.mark.parametrize("written", [False, True])
def test_search_over_chinese_clauses(spark, tmp_path, written):
    docs = spark.createDataFrame(CLAUSES, "doc_id long, text string, domain string, code string")
    index = lexical.write_index(docs, str(tmp_path / "i"), n_buckets=2) if written else lexical.build_index(docs)
    queries = spark.createDataFrame([(1, "疏散楼梯净宽度", None, None), (2, "服务半径", None, None), (3, "楼梯", "消防", ["GB 4", "GB 9"]),
                                     (4, "不应", None, ["GB 2"])], "query_id long, text string, domain string, spec_codes array<string>")
    best = {r.query_id: r.doc_id for r in lexical.bm25_top(index, queries, 1).collect()}
    assert best[1] == 1 and best[2] == 2
    some = lexical.bm25_top(index, queries, 5, facets=docs)
    got = {}
    for r in some.collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got[3] == [4] and got[4] == [5]
    variants = queries.select("query_id", F.lit(0).alias("variant_no"), "text")
    stages = fusion.hybrid_stages(index, variants, docs.select("doc_id", "code"), filters=queries.drop("text"), facets=docs)
    found = {r.query_id: r.doc_id for r in stages["reranked"].filter("rerank_rank = 1").collect()}
    assert found == {1: 1, 2: 2, 3: 4, 4: 5}
    subs = variants.withColumnRenamed("variant_no", "sub_no")
    parts = fusion.decomposed(index, subs, docs.withColumn("clause", F.lit("1")))
    assert {r.query_id: r.doc_id for r in parts.filter("rank = 1").collect()}[1] == 1


def test_dense_hits_take_the_vector_path(spark):
    docs = spark.createDataFrame(CLAUSES, "doc_id long, text string, domain string, code string")
    variants = spark.createDataFrame([(1, 0, "服务半径")], "query_id long, variant_no int, text string")
    near = spark.createDataFrame([(1, 0, 3, 0.9), (1, 0, 2, 0.8), (1, 0, 5, -0.1)], "query_id long, variant_no int, doc_id long, score double")
    stages = fusion.hybrid_stages(lexical.build_index(docs), variants, docs.select("doc_id", "code"), dense=near)
    assert {(r.path, r.doc_id, r["rank"]) for r in stages["paths"].collect()} == {("words", 2, 1), ("vector_00", 3, 1), ("vector_00", 2, 2)}
    fused = {r.doc_id: (r.overlap, r.n_paths) for r in stages["fused"].collect()}
    assert fused == {2: (1.0, 2), 3: (0.0, 1)}
    assert [r.doc_id for r in stages["reranked"].collect()] == [2]


def test_no_exchange_between_postings_and_scores(spark, docs, tmp_path):
    index = lexical.write_index(docs, str(tmp_path / "i"), n_buckets=3)
    queries = spark.createDataFrame([(1, "cat sun")], "query_id int, text string")
    plan = lexical.pair_scores(index, queries)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Bucketed: true" in plan and "In(term" in plan.replace("IN (", "In(term")


def test_pair_scorer_gets_batches_of_similar_length(spark):
    rows = [(i, "q", "x" * (i * 7 % 50)) for i in range(40)] + [(40, None, None)]
    df = spark.createDataFrame(rows, "doc_id int, query string, passage string")
    scored = fusion.score_pairs(df, lambda pairs: np.array([len(p) + (max(len(t) for _, t in pairs) - min(len(t) for _, t in pairs) > 25) for _, p in pairs]))
    assert {r.doc_id: r.pair_score for r in scored.collect()} == {i: float(len(p or "")) for i, _, p in rows}
    with pytest.raises(Exception, match="scores"):
        fusion.score_pairs(df, lambda pairs: np.zeros(0)).collect()


def test_tokens_and_codes(spark):
    row = spark.range(1).select(
        cjk_tokens(F.lit("服务半径300m，GB")).alias("t"),
        *[norm_code(F.lit("GB 5　0－1–x"), lv).alias(lv) for lv in "abcde"],
    ).collect()[0]
    assert row.t == ["服务", "务半", "半径", "300m", "，", "gb"]
    assert (row.a, row.b, row.c, row.d, row.e) == ("GB50－1–X", "GB50－1–X", "GB50-1-X", "GB5　0－1–X", "gb50－1–x")


def test_fusion_ties_and_paths(spark):
    hits = spark.createDataFrame(
        [(1, "a", 1, 10), (1, "a", 2, 11), (1, "b", 1, 11), (1, "b", 2, 10), (1, "b", 3, 12)], "query_id int, path string, rank int, doc_id int"
    )
    rows = fusion.fuse(hits).orderBy(*fusion.fused_order()).collect()
    assert [r.doc_id for r in rows] == [10, 11, 12]
    assert rows[0].rrf == rows[1].rrf == pytest.approx(1 / 61 + 1 / 62) and rows[0].n_paths == 2


def test_copies_keep_the_best(spark):
    rows = [(1, " c ", "a b　c\n" + "x" * 300, 0.5, 7), (1, "c", "abc" + "x" * 300 + "tail", 0.9, 8), (1, None, "abc", 0.1, 9), (1, "c", "abc", 0.2, 10)]
    df = spark.createDataFrame(rows, "query_id int, code string, text string, score double, doc_id int")
    kept = fusion.drop_copies(df, F.col("code"), lexical.prefix_key(F.col("text")), "score")
    assert sorted(r.doc_id for r in kept.collect()) == [8, 9, 10]


def test_rerank_and_fallback(spark):
    df = spark.createDataFrame(
        [(1, 1, 0.9, 0.2), (1, 2, None, 0.5), (1, 3, None, 0.2), (1, 4, 0.05, 0.9)], "query_id int, doc_id int, pair double, cos double"
    )
    got = [(r.doc_id, r.used_fallback) for r in fusion.rerank_or_fallback(df, "pair", "cos").orderBy("rerank_rank").collect()]
    assert got == [(1, False), (2, True)]


def test_passages(spark):
    row = spark.range(1).select(
        *[fusion.passage(s, F.lit("名"), F.lit("1.1"), F.lit("文")).alias(s) for s in ("text_only", "clause_text", "rich", "odd")],
        fusion.passage("clause_text", F.lit("名"), F.lit(None).cast("string"), F.lit("文")).alias("bare"),
    ).collect()[0]
    assert tuple(row) == ("文", "1.1 文", "<规范>名</规范> <条文>1.1</条文> 文", "文", "文")


@pytest.mark.parametrize("raw,want", [
    ('好的：```json\n["“甲”", " 乙 ", 3, "", "q", "丙", "丁"]\n```', ["q", "甲", "乙"]),
    ("no list", ["q"]), ("[broken", ["q"]), ('["a", ["b"]] tail', ["q", "a"]), (None, ["q"]),
])
def test_variants(spark, raw, want):
    df = spark.createDataFrame([("q", raw)], "q string, raw string")
    assert df.select(fusion.variant_list(F.col("q"), F.col("raw")).alias("v")).collect()[0].v == want


def test_sub_queries(spark):
    df = spark.createDataFrame([("q", '["only"]'), ("q", '["a","b","q","c","d","e"]')], "q string, raw string")
    got = [r.v for r in df.select(fusion.sub_query_list(F.col("q"), F.col("raw")).alias("v")).collect()]
    assert got == [["q"], ["q", "a", "b", "c", "d"]]


@pytest.mark.parametrize("limit", [dense.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("part", [None, "label"])
def test_nearest_is_exact(spark, monkeypatch, limit, part):
    monkeypatch.setattr(dense, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(dense, "PACK_ROWS", 7)
    rng = np.random.default_rng(0)
    mat = rng.normal(size=(60, 5)).round(2)
    mat[3] = mat[40]
    mat[9] = 0
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(mat)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got: dict[int, list[int]] = {}
    hits = dense.nearest(corpus, corpus.withColumnRenamed("vec_id", "query_id"), 4, part_col=part)
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    norms = np.linalg.norm(mat, axis=1, keepdims=True)
    unit = np.divide(mat, norms, out=np.zeros_like(mat), where=norms > 0)
    sims = np.round(unit @ unit.T, 6)
    for i in range(60):
        ids = [j for j in range(60) if part is None or j % 3 == i % 3]
        assert got[i] == sorted(ids, key=lambda j: (-sims[i, j], j))[:4]


def test_encode_checks_lengths(spark, docs):
    out = dense.encode(docs, "doc_id", "text", lambda texts: np.array([[len(t), 1.0] for t in texts]))
    assert {r.doc_id: r.embedding[0] for r in out.collect()} == {d: float(len(t)) for d, t in DOCS}
    with pytest.raises(Exception, match="vectors"):
        dense.encode(docs, "doc_id", "text", lambda texts: np.zeros((0, 2))).collect()


@pytest.mark.parametrize("bound", [scale.BROADCAST_BYTES, 0])
def test_containment_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(scale, "BROADCAST_BYTES", bound)
    rng = random.Random(3)
    words = ["aa", "ab", "ba", "Éa", "x1"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) + rng.choice(["", ".", "\n"]) for _ in range(60)]
    passages = [t[s : s + rng.choice([1, 2, 3, 5, 14, 25])] for t in texts for s in [rng.randrange(len(t))]] + ["aa ab ba Éa x1 aa", "zz"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    p = spark.createDataFrame(list(enumerate(passages)), "query_id int, text string")
    got = sorted((r.query_id, r.doc_id, r.pos) for r in containment.containing(d, p).collect())
    assert got == sorted((i, j, t.index(q) + 1) for i, q in enumerate(passages) for j, t in enumerate(texts) if q in t)


def test_bounded_search_has_the_same_rows(spark, tmp_path):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 3, 20, 60, 200])))) for i in range(400)]
    docs += [(1000 + i, docs[i][1]) for i in range(40)] + [(2000, None), (2001, "")]
    asked = [(i, " ".join(rng.choices(words, k=rng.choice([1, 4, 15])))) for i in range(25)] + [(90, "none"), (91, None), (92, docs[7][1])]
    index = lexical.write_index(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "index"))
    queries = spark.createDataFrame(asked, "query_id long, text string").withColumn("domain", F.when(F.col("query_id") % 3 == 0, "even"))
    facets = spark.createDataFrame([(i, ["even", "odd"][i % 2], "c") for i, _ in docs], "doc_id long, domain string, code string")

    def store(df, n=iter(range(1000))):
        path = str(tmp_path / f"kept-{next(n)}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    def rows(df):
        return sorted(map(tuple, df.collect()))

    for k, some in ((10, None), (10, facets)):
        assert rows(lexical.bm25_top(index, queries, k, facets=some, store=store)) == rows(lexical.bm25_top(index, queries, k, facets=some))
    near = lexical.reachable(index, queries, 1, store)
    assert 0 < near.count() < lexical.pair_scores(index, queries).count() / 2
    work = {r.query_id: r for r in lexical.postings_scored(index, queries, 10, store).collect()}
    assert all(r.n_candidates >= 1 and r.n_postings >= 1 for r in work.values())


def test_neighbours_closer_than_a_rounded_score_rank_by_their_score(spark):
    corpus = spark.createDataFrame([(i, [1.0, x]) for i, x in enumerate([3e-4, 2e-4, 1e-4, 2e-4, 0.0])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<double>")
    hits = dense.nearest(corpus, queries, 4).orderBy("rank").collect()
    assert [h.vec_id for h in hits] == [4, 2, 1, 3] and hits[2].score == hits[3].score and 0 < hits[0].score - hits[1].score < 1e-8


def test_buckets_grow_with_the_texts(spark, tmp_path, monkeypatch):
    """More text is more buckets, so a task sorts and sums no more of it; the bounds are those of all postings."""
    monkeypatch.setattr(lexical, "BUCKET_CHARS", 1000)
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} both " * 10) for i in range(200)], "doc_id long, text string")
    index = lexical.write_index(docs, str(tmp_path / "index"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0]
    assert index.corpus.first()["n_buckets"] == -(-chars // 1000)
    assert index.postings.groupBy("doc_id", "term").count().count() == index.postings.count() == index.terms.agg(F.sum("df")).first()[0]
    plain = lexical.build_index(docs)
    avgdl = index.corpus.first()["avgdl"]
    want = plain.postings.groupBy("term", lexical.length_block(F.col("dl")).alias("block")).agg(
        F.count("*").alias("n"), F.max(lexical.share(F.lit(avgdl))).alias("top"))
    assert sorted(map(tuple, index.bounds.collect())) == sorted(map(tuple, want.collect()))
    queries = spark.createDataFrame([(1, "w1 both"), (2, "w2 w5")], "query_id long, text string")
    assert sorted(map(tuple, lexical.bm25_top(index, queries, 5).collect())) == sorted(map(tuple, lexical.bm25_top(plain, queries, 5).collect()))


@pytest.mark.parametrize("tiers", [(0.016, 2000), (0.05, 3), (2.0, 0), (0.0, 0)])
def test_best_by_cosine_without_a_row_per_pair(spark, tmp_path, monkeypatch, tiers):
    """Same rows as from scores of all pairs: many copies, a word in nearly all texts, repeated words, ids that are texts, no hits."""
    for name, value in zip(("DENSE", "LOOPED"), tiers):
        monkeypatch.setattr(cosine, name, value)
    for name, value in (("QUERIES", 16), ("DOCS", 32), ("GROUP_QUERIES", 40), ("PART_POSTINGS", 500)):
        monkeypatch.setattr(cosine, name, value)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(["all", *rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.choice([1, 6, 30]))]) for _ in range(150)]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate([*texts, *[texts[0]] * 90, "", None, "none"])], "doc_id string, text string")
    asked = [(i, j, " ".join(rng.choices([*words, "all", "absent"], k=rng.choice([1, 3, 9])))) for i in range(30) for j in (1, 2)]
    queries = spark.createDataFrame([*asked, (70, 1, "absent"), (71, 1, ""), (72, 1, None), (73, 1, texts[0])], "query_id long, sub_no int, text string")
    keys = ("query_id", "sub_no")
    index = lexical.write_index(docs, str(tmp_path / "index"), n_buckets=3)
    columns = [*keys, "doc_id", "score", "overlap", "rank"]
    want = lexical.ranked(lexical.pair_scores(index, queries, keys), "cosine", 7, keys).select(columns)
    got = cosine.cosine_top(index, queries, 7, keys).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 300
    # a search of sub-queries makes no row per pair
    monkeypatch.setattr(fusion, "pair_scores", None)
    facts = docs.select("doc_id", F.lit("c").alias("code"), F.lit("1").alias("clause"))
    assert fusion.decomposed(index, queries, facts).count() > 0


@pytest.mark.parametrize("bits", [3, 9])  # buckets that overlap so much that all pairs are fewer products, and small ones
def test_lsh_finds_the_best_that_share_a_bucket(spark, monkeypatch, bits):
    monkeypatch.setattr(dense, "BLOCK_ROWS", 50)
    monkeypatch.setattr(dense, "PART_BYTES", 9000)
    monkeypatch.setattr(dense, "PRODUCTS", 900)
    monkeypatch.setattr(dense, "CHECKED", 70)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[::9], x[5] = x[7], 0.0  # a crowd of equal vectors, and one without direction
    ids = np.arange(400) // np.where(np.arange(400) < 40, 2, 1)  # some ids have two rows
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<float>").repartition(3)
    kept = []
    corpus = dense.blocks(df, store=lambda packs: kept.append(packs.cache()) or kept[0])
    hits = dense.lsh_nearest(corpus, corpus.named("query_id"), 4, tables=3, bits=bits, probes=2)
    got: dict = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hashing = dense.Hashing(3, bits, 2)
    share = (hashing.buckets(x.astype(float), 2)[:, None] == hashing.buckets(x.astype(float), 1)[None]).any(axis=(2, 3))
    unit = dense._unit(x.astype(float))
    wanted: dict = {}
    for q, v in zip(*np.nonzero(share)):
        own = wanted.setdefault(int(ids[q]), {})
        own[int(ids[v])] = max(own.get(int(ids[v]), -2.0), float((unit[q] * unit[v]).sum()))
    assert got == {q: sorted(own.items(), key=lambda h: (-h[1], h[0]))[:4] for q, own in wanted.items()}
    assert dense.lsh_nearest(df.limit(0), df.limit(0).withColumnRenamed("vec_id", "query_id"), 4).collect() == []


def test_lsh_moves_no_copies_of_vectors(spark):
    """Each vector was copied for each table, probe and cell, and moved with its copies."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(200, 8)))], "vec_id long, embedding array<float>")
    plan = dense.lsh_nearest(df.repartition(4), df.repartition(4).withColumnRenamed("vec_id", "query_id"), 4)._jdf.queryExecution().sparkPlan().toString()
    below = plan[plan.index("MapInArrow"):]
    assert "CartesianProduct" in below and not any(join in below for join in ("SortMergeJoin", "Generate", "MapInPandas"))


def test_blocks_refuse_vectors_of_several_lengths(spark):
    df = spark.createDataFrame([(i, [1.0] * (i % 3 + 1)) for i in range(40)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="one length"):
        dense.blocks(df).frame.collect()


@pytest.mark.parametrize("table", [1 << 23, 0])
def test_best_paths_without_a_row_per_pair(spark, tmp_path, monkeypatch, table):
    """Same rows as from scores of all pairs: copies, repeated words, variants without an original wording, ids that are texts, no hits."""
    for name, value in (("QUERIES", 16), ("DOCS", 32), ("TABLE", table)):
        monkeypatch.setattr(cosine, name, value)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.choice([1, 6, 30]))) for _ in range(150)]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate([*texts, *[texts[0]] * 90, "", None, *["other"] * 300])], "doc_id string, text string")
    asked = [(f"q{i}", j, " ".join(rng.choices([*words, "absent"], k=rng.choice([1, 3, 9])))) for i in range(30) for j in range(i % 2, 3)]
    variants = spark.createDataFrame([*asked, ("x", 0, "absent"), ("y", 0, ""), ("z", 0, None), ("z", 1, texts[0])], "query_id string, variant_no int, text string")
    index = lexical.write_index(docs, str(tmp_path / "index"), n_buckets=3)
    scores = lexical.pair_scores(index, variants, ("query_id", "variant_no"))
    for vector in (True, False):
        want = fusion.search_paths(scores, 7, vector=vector)
        got = cosine.best_paths(index, variants, 7, vector=vector)
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert cosine.best_paths(index, variants.filter("query_id = 'x'"), 7).collect() == []
    # a hybrid search makes no row per pair
    monkeypatch.setattr(fusion, "pair_scores", None)
    assert fusion.hybrid_stages(index, variants, docs.select("doc_id", F.lit("c").alias("code")))["reranked"].count() > 0


def test_pairs_of_ideographs_by_hand(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("标准规aB９é 　。,-〇𠀀", k=rng.randrange(0, 14))) for _ in range(600)]

    def by_hand(text: str, punctuation: bool) -> list[str]:
        out, run = [], ""
        kinds = ["c" if "一" <= x <= "鿿" else "w" if x.isalnum() else "s" if x.isspace() else "p" for x in text]
        for i, (x, kind) in enumerate(zip(text.lower(), kinds)):
            run = run + x if i and kinds[i - 1] == kind else x
            if kind in "cw" and (i + 1 == len(text) or kinds[i + 1] != kind):
                out += [run] if kind == "w" or len(run) == 1 else [run[j: j + 2] for j in range(len(run) - 1)]
            if kind == "p" and punctuation:
                out.append(x)
        return out

    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", cjk_tokens(F.col("text")).alias("all"), cjk_tokens(F.col("text"), False).alias("words")).collect():
        assert r["all"] == by_hand(r["text"], True) and r["words"] == by_hand(r["text"], False)


def test_prefix_of_texts_with_many_blanks(spark):
    texts = ["", "a b", " " * 500 + "x" * 300, "ab " * 90, "a " * 150 + "b" * 200, "c" * 1000]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    assert [r.k for r in df.select(lexical.prefix_key(F.col("text")).alias("k")).collect()] == [
        "".join((t or "").split())[:200] for t in [*texts, None]]


def test_words_counted_by_grouping(spark):
    rows = [(1, "cat dog cat"), (1, "cat 标准规范标准"), (2, ""), (3, None), (None, "sun sun"), (4, "!!"), *[(5, "a b a")] * 2]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    inside, grouped = (f(docs, ["doc_id"], "text") for f in (lexical.term_counts, lexical.grouped_counts))
    assert grouped.columns == inside.columns and sorted(map(str, grouped.collect())) == sorted(map(str, inside.collect()))
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange") == 1  # texts are dealt once, words are not


def test_scores_closer_than_the_matrix_tells_rank_by_their_sums(spark, tmp_path):
    """The matrix of scores is in single precision; documents whose cosines differ by less are ranked by the sums in doubles."""
    texts = ["a " * (3000 + i) + "b " * 3000 + "c " * (3000 - i % 3) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    queries = spark.createDataFrame([(1, 1, "a b c"), (2, 1, "a a b"), (3, 1, "c")], "query_id long, sub_no int, text string")
    index, keys, columns = lexical.write_index(docs, str(tmp_path / "index")), ("query_id", "sub_no"), ["query_id", "doc_id", "score", "rank"]
    want = lexical.ranked(lexical.pair_scores(index, queries, keys), "cosine", 5, keys).select(columns).collect()
    assert sorted(map(tuple, cosine.cosine_top(index, queries, 5, keys).select(columns).collect())) == sorted(map(tuple, want))
    scores = sorted(r.score for r in want if r.query_id == 1)
    assert 0 < scores[-1] - scores[0] < 1e-6
    one = np.zeros(1, "int64")
    block = cosine._Block(5, cosine.pa.RecordBatch.from_pydict({"n_words": [1]}), one, one, np.ones(1), np.ones(1))
    assert block._matrix(1, one, one, np.ones(1)).itemsize == 4
