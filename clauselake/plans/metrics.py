"""Evaluation queries: benchmark retrieval, and events and labels as runs, verdicts and revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.operators import evaluation as ev
from clauselake.operators import fusion, triage
from clauselake.operators.containment import containing
from clauselake.operators.lexical import pair_scores, ranked
from clauselake.operators.scale import index_percentiles, top_k
from clauselake.plans import dialogue, sql
from clauselake.plans.registry import query
from clauselake.plans.search import HYBRID, bench_queries, doc_index, hybrid
from clauselake.sources.tables import keep, read_documents, read_table

K = 20

TRUTH = """
truth AS (SELECT b.item_id AS query_id, d.doc_id, d.source AS code, lpad(CAST(d.doc_id AS VARCHAR), 8, '0') AS clause
  FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


def doc_codes(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, code, clause): source and padded number of each document."""
    return read_table(spark, sf, "documents", "doc_id", "source").select(
        "doc_id", F.col("source").alias("code"), F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("clause")
    )


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, doc_id, code, clause): documents that hold the benchmark passage."""
    pairs = containing(read_documents(spark, sf, "source", "text"), bench_queries(spark, sf), carry=["source"])
    return pairs.select(
        "query_id", "doc_id", F.col("source").alias("code"), F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("clause")
    )


def bm25_hits(spark: SparkSession, sf: str, score: str = "bm25") -> DataFrame:
    """(query_id, rank, doc_id, code, clause) of the best documents per item."""
    hits = ranked(pair_scores(doc_index(spark, sf), bench_queries(spark, sf)), score, K)
    return doc_codes(spark, sf).join(hits, "doc_id").select("query_id", "rank", "doc_id", "code", "clause")


def _ranks_sql(name: str, hits: str, truth: str = "truth", keys: str = "bq") -> str:
    """CTE {name}(query_id, rank_strict, rank_loose)."""
    return f"""
{name}_c AS (SELECT h.query_id, h.rank, d.source AS code, lpad(CAST(d.doc_id AS VARCHAR), 8, '0') AS clause FROM {hits} h JOIN documents d USING (doc_id)),
{name}_m AS (SELECT h.query_id, min(h.rank) AS rank_loose, min(CASE WHEN h.clause <> '' AND t.clause <> '' AND (contains(h.clause, t.clause) OR contains(t.clause, h.clause))
   THEN h.rank END) AS rank_strict FROM {name}_c h JOIN {truth} t ON t.query_id = h.query_id
   AND upper(replace(t.code, ' ', '')) = upper(replace(h.code, ' ', '')) GROUP BY 1),
{name} AS (SELECT query_id, rank_strict, rank_loose FROM (SELECT query_id FROM {keys}) LEFT JOIN {name}_m USING (query_id))"""


BASE = f"{sql.DOC_TERMS}, {sql.BENCH}, {sql.scores('bq')}, {sql.top('hits', 'qscore', 'bm25', K)}, {TRUTH}"
RANKS = f"{BASE}, {_ranks_sql('ranks', 'hits')}"


def _shown(df: DataFrame) -> DataFrame:
    return df.fillna(-1, [c for c in df.columns if c.startswith("rank_")])


def ranks(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, rank_strict, rank_loose) of the BM25 hits."""
    return ev.first_hits(bm25_hits(spark, sf), truth(spark, sf), bench_queries(spark, sf))


@query("gt_presence", f"""
WITH {TRUTH}, p AS (SELECT query_id, count(*) AS n FROM truth GROUP BY 1)
SELECT item_id AS query_id, coalesce(n, 0) AS n_documents, n IS NOT NULL AS present FROM benchmark LEFT JOIN p ON p.query_id = item_id""")
def gt_presence(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each benchmark passage is in the corpus, and how often."""
    counts = truth(spark, sf).groupBy("query_id").agg(F.count("*").alias("n"))
    return bench_queries(spark, sf).select("query_id").join(counts, "query_id", "left").select(
        "query_id", F.coalesce("n", F.lit(0)).alias("n_documents"), F.col("n").isNotNull().alias("present")
    )


@query("gt_clause_audit", """
WITH t AS (SELECT item_id AS query_id, 'SRC' || (item_id % 20) AS code, lpad(CAST(item_id * 37 % 1000 AS VARCHAR), 3, '0') AS clause FROM benchmark),
p AS (SELECT DISTINCT query_id FROM t JOIN documents d ON upper(d.source) = t.code AND contains(lpad(CAST(d.doc_id AS VARCHAR), 8, '0'), t.clause))
SELECT query_id, p.query_id IS NOT NULL AS present FROM t LEFT JOIN p USING (query_id)""")
def gt_clause_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the clause that each item expects stands in the corpus under its code."""
    item = F.col("item_id")
    expected = read_table(spark, sf, "benchmark", "item_id").select(
        item.alias("query_id"), F.concat(F.lit("SRC "), (item % 20).cast("string")).alias("code"),
        F.lpad((item * 37 % 1000).cast("string"), 3, "0").alias("clause"))
    return ev.truth_audit(expected, doc_codes(spark, sf))


@query("first_hit_rank", f"WITH {RANKS} SELECT query_id, coalesce(rank_strict, -1) AS rank_strict, coalesce(rank_loose, -1) AS rank_loose FROM ranks")
def first_hit_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Rank of the first relevant hit per item, by document and by source."""
    return _shown(ranks(spark, sf))


ACCEPT = """
gt AS (SELECT item_id AS query_id, coalesce(min(t.code), '') AS code, coalesce(min_by(t.clause, t.code), '') AS clause,
  ' SRC' || (item_id * 7 % 20) || '|0000;; |x ;src ' || (item_id * 11 % 20) || ' ; src3|' || lpad(CAST(item_id AS VARCHAR), 8, '0') AS also
  FROM benchmark LEFT JOIN truth t ON t.query_id = item_id GROUP BY item_id),
acc AS (SELECT query_id, code, clause FROM gt WHERE code <> '' UNION ALL SELECT query_id, 'SRC' || (query_id * 7 % 20), '0000' FROM gt
  UNION ALL SELECT query_id, 'src ' || (query_id * 11 % 20), '' FROM gt UNION ALL SELECT query_id, 'src3', lpad(CAST(query_id AS VARCHAR), 8, '0') FROM gt)"""


@query("multi_gt_rank", f"""WITH {BASE}, {ACCEPT.replace("min_by(t.clause, t.code)", "arg_min(t.clause, t.code || t.clause)")}, {_ranks_sql("mr", "hits", "acc")}
SELECT query_id, coalesce(rank_strict, -1) AS rank_strict, coalesce(rank_loose, -1) AS rank_loose FROM mr""")
def multi_gt_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Best rank over the main expectation and alternatives written as a list."""
    main = truth(spark, sf).groupBy("query_id").agg(
        F.min("code").alias("expected_code"), F.min_by("clause", F.concat("code", "clause")).alias("expected_clause")
    )
    item = F.col("query_id")
    also = F.concat(
        F.lit(" SRC"), (item * 7 % 20).cast("string"), F.lit("|0000;; |x ;src "), (item * 11 % 20).cast("string"),
        F.lit(" ; src3|"), F.lpad(item.cast("string"), 8, "0"),
    )
    rows = bench_queries(spark, sf).select("query_id").join(main, "query_id", "left").withColumn("also", also)
    return _shown(ev.first_hits(bm25_hits(spark, sf), ev.truth_rows(rows, extra="also"), bench_queries(spark, sf)))


METRICS = ", ".join(
    ["count(*) AS n"] + [
        f"round(avg(CASE WHEN rank_{s} <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit5_{s}, round(avg(CASE WHEN rank_{s} <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hit10_{s}, "
        f"round(avg(coalesce(1.0::DOUBLE / rank_{s}, 0.0::DOUBLE)), 6) AS mrr_{s}" for s in ("strict", "loose")
    ]
)


def evaluable(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks of the items whose passage is in the corpus, with first letter and length class of the item."""
    facts = bench_queries(spark, sf).select(
        "query_id", F.upper(F.substring("text", 1, 1)).alias("domain"),
        F.when(F.length("text") < 200, "short").otherwise("long").alias("difficulty"),
    )
    return ev.expected_hits(bm25_hits(spark, sf), truth(spark, sf)).join(facts, "query_id")


EVALUABLE = f"""{RANKS},
er AS (SELECT r.*, upper(substr(text, 1, 1)) AS domain, CASE WHEN len(text) < 200 THEN 'short' ELSE 'long' END AS difficulty
  FROM ranks r JOIN bq USING (query_id) WHERE query_id IN (SELECT query_id FROM truth))"""


@query("retrieval_metrics", f"WITH {EVALUABLE} SELECT {METRICS}, (SELECT count(*) FROM bq) - count(*) AS n_boundary FROM er")
def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Hit rates and reciprocal rank over the evaluable items; the others are counted apart."""
    total = bench_queries(spark, sf).agg(F.count("*")).scalar()
    return evaluable(spark, sf).agg(*ev.metrics(), (total - F.count("*")).alias("n_boundary"))


@query("metrics_grouping_sets", f"""
WITH {EVALUABLE} SELECT coalesce(domain, 'ALL') AS domain, coalesce(difficulty, 'ALL') AS difficulty, {METRICS} FROM er
GROUP BY GROUPING SETS ((), (domain), (difficulty))""")
def metrics_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    """The same overall, by first letter and by length class."""
    return ev.breakdown(evaluable(spark, sf), "domain", "difficulty").fillna("ALL", ["domain", "difficulty"])


@query("miss_list", f"""
WITH {RANKS} SELECT query_id, coalesce(rank_loose, -1) AS rank_loose, CASE WHEN rank_loose IS NULL THEN 'missed' ELSE 'code_only' END AS kind
FROM ranks WHERE rank_strict IS NULL ORDER BY query_id LIMIT 10""")
def miss_list(spark: SparkSession, sf: str) -> DataFrame:
    """First ten items without a strict hit."""
    return _shown(ev.misses(ranks(spark, sf), [F.col("query_id")]).select("query_id", "rank_loose", "kind"))


@query("smoke_gate", f"""
WITH {RANKS}, s AS (SELECT count(*) AS n, count(*) FILTER (rank_strict <= 5) AS n_hit FROM ranks WHERE query_id IN (SELECT query_id FROM truth))
SELECT n, n_hit, round(n_hit / n, 6) AS hit_rate, n_hit / n >= 0.8 AS passed FROM s""")
def smoke_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Whether enough items find their document among the first five."""
    share = F.count_if(F.col("rank_strict") <= 5) / F.count("*")
    return evaluable(spark, sf).agg(
        F.count("*").alias("n"), F.count_if(F.col("rank_strict") <= 5).alias("n_hit"), F.round(share, 6).alias("hit_rate"),
        (share >= ev.SMOKE).alias("passed"),
    )


@query("paired_delta", f"""
WITH {BASE}, {sql.top("chits", "qscore", "cosine", K)}, {_ranks_sql("br", "hits")}, {_ranks_sql("cr", "chits")}
SELECT query_id, coalesce(br.rank_strict, -1) AS rank_before, coalesce(cr.rank_strict, -1) AS rank_after,
  CASE WHEN br.rank_strict IS NULL AND cr.rank_strict IS NULL THEN 'missing' WHEN br.rank_strict IS NULL THEN 'gained' WHEN cr.rank_strict IS NULL THEN 'lost'
    WHEN cr.rank_strict < br.rank_strict THEN 'better' WHEN cr.rank_strict > br.rank_strict THEN 'worse' ELSE 'same' END AS change
FROM br JOIN cr USING (query_id)""")
def paired_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Per item: strict rank by keywords and by vectors, and the change."""
    known, items = truth(spark, sf), bench_queries(spark, sf)
    before = ev.first_hits(bm25_hits(spark, sf), known, items)
    after = ev.first_hits(bm25_hits(spark, sf, "cosine"), known, items)
    return ev.paired(before, after, "query_id", "rank_strict").select(
        "query_id", F.coalesce("before", F.lit(-1)).alias("rank_before"), F.coalesce("after", F.lit(-1)).alias("rank_after"), "change"
    )


STAGES = {"fr": "fused_rank", "ded": "dedup_rank", "rer": "rerank_rank"}


@query("stage_diagnosis", f"""
WITH {HYBRID}, {TRUTH},
st AS (SELECT query_id, {", ".join(f"(SELECT min(s.{c}) FROM {t} s JOIN truth t USING (query_id, doc_id) WHERE s.query_id = k.query_id) AS {c}" for t, c in STAGES.items())}
  FROM (SELECT DISTINCT query_id FROM truth) k)
SELECT query_id, {", ".join(f"coalesce({c}, -1) AS {c}" for c in STAGES.values())},
  CASE WHEN rerank_rank <= 5 THEN 'ok' WHEN coalesce(fused_rank, dedup_rank) IS NOT NULL THEN 'rank_failure' ELSE 'recall_failure' END AS verdict FROM st""")
def stage_diagnosis(spark: SparkSession, sf: str) -> DataFrame:
    """Rank of the target in each stage of the hybrid search, and where it was lost."""
    stages, known = hybrid(spark, sf, several=True), truth(spark, sf).select("query_id", "doc_id")
    out = known.select("query_id").distinct()
    for stage, rank in (("fused", "fused_rank"), ("deduped", "dedup_rank"), ("reranked", "rerank_rank")):
        found = stages[stage].select("query_id", "doc_id", rank).join(known, ["query_id", "doc_id"], "left_semi")
        out = out.join(found.groupBy("query_id").agg(F.min(rank).alias(rank)), "query_id", "left")
    verdict = ev.diagnose(out, ["fused_rank", "dedup_rank"], "rerank_rank")
    return out.withColumn("verdict", verdict).fillna(-1)


COMBO_SQL = "cb(combo, mq, rk, hyb) AS (VALUES " + ", ".join(f"('{c}', {m}, {r}, {h})".lower().replace(f"'{c.lower()}'", f"'{c}'") for c, m, r, h in ev.COMBOS) + ")"


@query("combo_matrix", f"""
WITH {HYBRID}, {TRUTH}, {COMBO_SQL},
cp AS (SELECT combo, rk, p.* FROM paths p JOIN cb ON (p.path = 'vector_00' OR (p.path = 'vector_01' AND mq) OR (p.path = 'words' AND hyb))),
cf AS (SELECT combo, rk, query_id, doc_id, {sql.RRF} AS rrf, min({{'path': path, 'rank': rank}}) AS first_seen FROM cp GROUP BY ALL),
ct AS (SELECT cf.*, {sql.overlap("q.text", "d.text")} AS overlap FROM cf JOIN documents d USING (doc_id) JOIN bq q USING (query_id)),
cr AS (SELECT *, row_number() OVER (PARTITION BY combo, query_id ORDER BY CASE WHEN rk THEN overlap ELSE rrf END DESC, rrf DESC, first_seen, doc_id) AS rank FROM ct),
cq AS (SELECT combo, query_id FROM cb, (SELECT DISTINCT query_id FROM truth)),
cm AS (SELECT c.combo, c.query_id, min(r.rank) AS rank_strict FROM cq c LEFT JOIN (SELECT cr.* FROM cr JOIN truth USING (query_id, doc_id) WHERE cr.rank <= 10) r
   ON r.combo = c.combo AND r.query_id = c.query_id GROUP BY 1, 2)
SELECT combo, count(*) AS n, round(avg(CASE WHEN rank_strict <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit5_strict,
  round(avg(CASE WHEN rank_strict <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hit10_strict, round(avg(coalesce(1.0::DOUBLE / rank_strict, 0.0::DOUBLE)), 6) AS mrr_strict FROM cm GROUP BY 1""")
def combo_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of the six configurations of wordings, rerank and keyword path, from one search of all paths."""
    paths, known = hybrid(spark, sf, several=True)["paths"], truth(spark, sf).select("query_id", "doc_id")
    combos = F.broadcast(spark.createDataFrame(ev.COMBOS, "combo string, mq boolean, rk boolean, hyb boolean"))
    used = F.array(
        F.struct(F.lit("vector_00").alias("path")), F.when(F.col("mq"), F.struct(F.lit("vector_01").alias("path"))),
        F.when(F.col("hyb"), F.struct(F.lit("words").alias("path"))),
    )
    members = F.broadcast(combos.select("combo", "rk", F.inline(F.array_compact(used))))
    runs = paths.join(members, "path").withColumn("run", F.struct("combo", "rk", "query_id"))
    fused = fusion.fuse(runs.drop("overlap"), "run").select("run.*", "doc_id", "rrf", "first_seen")
    overlaps = paths.select("query_id", "doc_id", F.col("overlap").alias("o")).distinct()
    scored = fused.join(overlaps, ["query_id", "doc_id"])
    best = top_k(
        scored, ["combo", "query_id"],
        [F.when(F.col("rk"), F.col("o")).otherwise(F.col("rrf")).desc(), F.col("rrf").desc(), F.col("first_seen"), F.col("doc_id")], 10,
    )
    found = best.join(known, ["query_id", "doc_id"], "left_semi").groupBy("combo", "query_id").agg(F.min("rank").alias("rank_strict"))
    wanted = known.select("query_id").distinct().select(
        "query_id", F.explode(F.array(*[F.lit(c) for c, *_ in ev.COMBOS])).alias("combo")
    )
    return wanted.join(found, ["combo", "query_id"], "left").groupBy("combo").agg(*ev.metrics(["strict"]))


EVENTS = "(SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the number of their properties."""
    return read_table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


@query("upsert_latest", """
SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Latest event per user after upserting the second half of the month into the first."""
    rows = read_table(spark, sf, "events", "user_id", "event_id", "event_type", "value", "ts")
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    versioned = rows.withColumn("version", F.struct("ts", "event_id"))
    merged = ev.upsert(versioned.filter(F.col("ts") < middle), versioned.filter(F.col("ts") >= middle), "user_id", "version")
    return merged.select("user_id", "event_id", "event_type", "value")


@query("latest_within_ttl", """
WITH l AS (SELECT user_id, event_type, max(ts) AS ts, arg_max(event_id, {'ts': ts, 'e': event_id}) AS event_id FROM events GROUP BY 1, 2)
SELECT user_id, event_type, event_id FROM l WHERE epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) <= 86400000000""")
def latest_within_ttl(spark: SparkSession, sf: str) -> DataFrame:
    """Newest event per user and type, where it is at most a day older than the newest of all."""
    rows = read_table(spark, sf, "events", "user_id", "event_type", "event_id", "ts")
    found = ev.latest_within(rows, ["user_id", "event_type"], "ts", "event_id", ["event_id"], rows.agg(F.max("ts")).scalar())
    return found.select("user_id", "event_type", "event_id")


def week_of(ts: str) -> F.Column:
    """First day of the week, as text."""
    return F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd")


@query("flip_detect", f"""
WITH d AS (SELECT event_type, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, CAST(ts AS DATE) AS day, round(avg(value) / 10, 6) AS strict, round(avg(k) / 100, 6) AS loose FROM {EVENTS} GROUP BY 1, 2, 3),
l AS (SELECT event_type, week, arg_max(strict, day) AS strict, arg_max(loose, day) AS loose FROM d GROUP BY 1, 2),
x AS (SELECT a.event_type, a.week AS new_set, b.week AS old_set, round(a.strict - b.strict, 6) AS delta_strict, round(a.loose - b.loose, 6) AS delta_loose
  FROM l a JOIN l b USING (event_type) WHERE a.week = (SELECT max(week) FROM l) AND b.week <> a.week)
SELECT *, abs(delta_loose) >= 0.05 OR abs(delta_strict) >= 0.05 AS flipped, CASE WHEN delta_loose <= -0.05 THEN 'loose down' WHEN delta_loose >= 0.05 THEN 'loose up'
  WHEN abs(delta_strict) >= 0.05 THEN 'strict changed' ELSE '' END AS note FROM x""")
def flip_detect(spark: SparkSession, sf: str) -> DataFrame:
    """Event types whose latest daily means differ between the last week and the others."""
    daily = events(spark, sf).groupBy(
        "event_type", week_of("ts").alias("week"), F.to_date("ts").alias("day")
    ).agg(F.round(F.avg("value") / 10, 6).alias("strict"), F.round(F.avg("k") / 100, 6).alias("loose"))
    last = ev.latest(daily, ["event_type", "week"], "day", "day", ["strict", "loose"])
    newest = last.agg(F.max("week")).scalar()
    return ev.flips(last.filter(F.col("week") == newest), last, "event_type", "week")


@query("run_variance", """
WITH r AS (SELECT event_type, CAST(ts AS DATE) AS run, round(avg(value), 6) AS m FROM events GROUP BY 1, 2)
SELECT event_type, count(*) AS n_runs, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std, min(m) AS lowest, max(m) AS highest FROM r GROUP BY 1""")
def run_variance(spark: SparkSession, sf: str) -> DataFrame:
    """Spread of the daily mean value of each event type."""
    runs = read_table(spark, sf, "events", "event_type", "ts", "value").groupBy("event_type", F.to_date("ts").alias("run")).agg(
        F.round(F.avg("value"), 6).alias("m")
    )
    return ev.variance(runs, ["event_type"], "m")


@query("persistent_fail", """
WITH f AS (SELECT user_id, date_trunc('week', ts) AS run FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) >= 3),
p AS (SELECT user_id, count(DISTINCT run) AS n_runs FROM f GROUP BY 1), h AS (SELECT n_runs, count(*) AS n_ids FROM p GROUP BY 1)
SELECT n_runs, n_ids, round(n_ids / (SELECT sum(n_ids) FROM h), 6) AS share FROM h""")
def persistent_fail(spark: SparkSession, sf: str) -> DataFrame:
    """Users by the number of weeks with at least three errors."""
    week = week_of("ts").alias("run")
    failures = read_table(spark, sf, "events", "user_id", "ts", "event_type").filter(F.col("event_type") == "error").groupBy(
        "user_id", week
    ).agg(F.count("*").alias("n")).filter(F.col("n") >= 3)
    return ev.persistence(failures, "user_id", "run")


@query("latency_pctl", """
WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n,
  avg(value) OVER (PARTITION BY event_type) AS m FROM events WHERE value > 0)
SELECT event_type, max(n) AS n, round(max(m), 6) AS mean, max(CASE WHEN i = least(n - 1, CAST(floor(n * 0.5) AS BIGINT)) THEN value END) AS p50,
  max(CASE WHEN i = least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) THEN value END) AS p95 FROM s GROUP BY 1""")
def latency_pctl(spark: SparkSession, sf: str) -> DataFrame:
    """Median and 95th percentile by index, and mean, per event type; zero values are left out."""
    rows = read_table(spark, sf, "events", "event_type", "value").filter(F.col("value") > 0)
    points = index_percentiles(rows, ["event_type"], "value", [0.5, 0.95], store=keep(spark))
    wide = points.groupBy("event_type").agg(
        F.max("n").alias("n"), F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("p50"),
        F.max(F.when(F.col("p") == 0.95, F.col("value"))).alias("p95"),
    )
    means = rows.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    return wide.join(means, "event_type")


DIMS = """
dm AS (SELECT doc_id, quality AS dim1_recall, quality * (doc_id % 2) AS dim2_precision, 1 AS dim6_boundary, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS dim3_citation,
  1 - toxic AS dim4_wording, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 1 END AS dim5_numeric, CASE WHEN doc_id % 7 = 0 AND quality = 0 THEN 0 ELSE 1 END AS dim7_no_halluc FROM labels),
cs AS (SELECT doc_id, round(dim1_recall * 0.20::DOUBLE + dim2_precision * 0.15::DOUBLE + dim6_boundary * 0.10::DOUBLE + dim3_citation * 0.20::DOUBLE + dim4_wording * 0.15::DOUBLE
  + dim5_numeric * 0.10::DOUBLE + dim7_no_halluc * 0.10::DOUBLE, 6) AS composite, dim4_wording = 0 OR dim5_numeric = 0 OR dim7_no_halluc = 0 AS veto FROM dm)"""


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, composite, veto): judge dimensions made from the labels."""
    doc = F.col("doc_id")
    dims = read_table(spark, sf, "labels").select(
        "doc_id", F.col("quality").alias("dim1_recall"), (F.col("quality") * (doc % 2)).alias("dim2_precision"),
        F.lit(1).alias("dim6_boundary"), F.when(doc % 3 == 0, 0).otherwise(1).alias("dim3_citation"),
        (1 - F.col("toxic")).alias("dim4_wording"), F.when(doc % 11 == 0, 0).otherwise(1).alias("dim5_numeric"),
        F.when((doc % 7 == 0) & (F.col("quality") == 0), 0).otherwise(1).alias("dim7_no_halluc"),
    )
    return dims.select("doc_id", ev.composite().alias("composite"), ev.vetoed().alias("veto"))


@query("quality_composite", f"WITH {DIMS} SELECT * FROM cs")
def quality_composite(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted quality and veto of every labelled document."""
    return judged(spark, sf)


@query("quality_grade", f"""
WITH {DIMS}, g AS (SELECT source, count(*) AS n, round(avg(composite), 6) AS mean, count(*) FILTER (veto) AS n_veto FROM cs JOIN documents USING (doc_id) GROUP BY 1)
SELECT *, CASE WHEN mean >= 0.75 AND n_veto = 0 THEN 'GREEN' WHEN mean >= 0.6 THEN 'YELLOW' ELSE 'RED' END AS grade FROM g""")
def quality_grade(spark: SparkSession, sf: str) -> DataFrame:
    """Mean quality, vetoes and grade per source."""
    docs = read_table(spark, sf, "documents", "doc_id", "source")
    per = judged(spark, sf).join(docs, "doc_id").groupBy("source").agg(
        F.count("*").alias("n"), F.round(F.avg("composite"), 6).alias("mean"), F.count_if("veto").alias("n_veto")
    )
    return per.withColumn("grade", ev.grade(F.col("mean"), F.col("n_veto") > 0))


@query("skip_accounting", """
WITH j AS (SELECT d.lang, l.doc_id IS NOT NULL AS judged, CASE WHEN l.doc_id IS NULL THEN 'no_verdict' WHEN l.toxic = 1 AND l.quality = 0 THEN 'judge_error' END AS reason, l.quality
  FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT lang, count(*) AS n_attempted, count(*) FILTER (reason IS NULL) AS n_eval, count(*) FILTER (reason IS NOT NULL) AS n_skipped,
  count(*) FILTER (reason = 'judge_error') AS n_errors, round(avg(CASE WHEN reason IS NULL THEN quality END), 6) AS mean_quality FROM j GROUP BY 1""")
def skip_accounting(spark: SparkSession, sf: str) -> DataFrame:
    """Attempted, judged and skipped documents per language; skipped ones leave the mean."""
    joined = read_table(spark, sf, "documents", "doc_id", "lang").join(read_table(spark, sf, "labels"), "doc_id", "left")
    reason = F.when(F.col("quality").isNull(), "no_verdict").when((F.col("toxic") == 1) & (F.col("quality") == 0), "judge_error")
    return joined.withColumn("reason", reason).groupBy("lang").agg(
        F.count("*").alias("n_attempted"), F.count_if(F.col("reason").isNull()).alias("n_eval"),
        F.count("reason").alias("n_skipped"), F.count_if(F.coalesce(F.col("reason") == "judge_error", F.lit(False))).alias("n_errors"),
        F.round(F.avg(F.when(F.col("reason").isNull(), F.col("quality"))), 6).alias("mean_quality"),
    )


@query("citation_dims", f"""
WITH {BASE},
c AS (SELECT h.query_id, h.rank, d.source AS code, lpad(CAST(d.doc_id AS VARCHAR), 8, '0') AS clause FROM hits h JOIN documents d USING (doc_id) WHERE h.rank <= 5),
g AS (SELECT query_id, min(code || '|' || clause) AS gt FROM truth GROUP BY 1),
e AS (SELECT query_id, split_part(gt, '|', 1) AS code, split_part(gt, '|', 2) AS clause FROM g)
SELECT e.query_id, CASE WHEN count(c.code) FILTER (c.code = e.code) > 0 THEN 1 ELSE 0 END AS dim1_recall,
  CASE WHEN count(*) FILTER (c.code = e.code AND c.clause = e.clause) > 0 THEN 1 ELSE 0 END AS dim2_precision FROM e LEFT JOIN c USING (query_id) GROUP BY e.query_id""")
def citation_dims(spark: SparkSession, sf: str) -> DataFrame:
    """Recall and precision dimension of each item from its first five citations."""
    cites = bm25_hits(spark, sf).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "code", "clause"))).alias("cites")
    )
    want = truth(spark, sf).groupBy("query_id").agg(F.min(F.struct("code", "clause")).alias("t"))
    joined = want.join(cites, "query_id", "left").withColumn("cites", F.coalesce("cites", F.expr("cast(array() as array<struct<rank:int,code:string,clause:string>>)")))
    return joined.select("query_id", *ev.citation_dims(F.col("cites"), F.col("t.code"), F.col("t.clause")))


EXPECTED = "CASE WHEN query_id % 6 = 0 THEN 'no_result' WHEN len(query) < 60 THEN 'ambiguous' ELSE 'normal' END"


def expected_scenario() -> F.Column:
    """Rule standing in for labels of user turns."""
    return (
        F.when(F.col("query_id") % 6 == 0, "no_result").when(F.length("query") < 60, "ambiguous").otherwise("normal")
    )


@query("fallback_eval", f"""
WITH {dialogue.TRIAGED}, x AS (SELECT {EXPECTED} AS expected, scenario AS actual FROM tr)
SELECT expected, count(*) AS total, count(*) FILTER (expected = actual) AS hit, count(*) FILTER (expected = 'no_result' AND actual = 'normal') AS soft,
  count(*) FILTER (expected <> actual AND NOT (expected = 'no_result' AND actual = 'normal')) AS failed FROM x GROUP BY 1""")
def fallback_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Scenario rules against expected scenarios of the user turns."""
    rows = dialogue.user_queries(spark, sf).select(
        expected_scenario().alias("expected"), triage.scenario(F.col("query"), dialogue.T).alias("actual")
    )
    return ev.scenario_eval(rows)


ROUTE_ROWS = f"""{dialogue.ROUTED},
rr AS (SELECT CASE WHEN matched IN ('broad', 'compound') AND query_id % 4 > 0 THEN 'decompose' WHEN matched = 'catalog' OR query_id % 9 = 0 THEN 'tool' ELSE 'plain' END AS expected,
  route AS got, query_id % 5 = 0 AS borderline FROM ro)"""


def route_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(expected, got, borderline) of the routing rules on the user turns."""
    q = F.col("query_id")
    expected = (
        F.when(F.col("matched").isin("broad", "compound") & (q % 4 > 0), "decompose")
        .when((F.col("matched") == "catalog") | (q % 9 == 0), "tool").otherwise("plain")
    )
    return dialogue.routed(spark, sf).select(expected.alias("expected"), F.col("route").alias("got"), (q % 5 == 0).alias("borderline"))


@query("confusion_matrix", f"""
WITH {ROUTE_ROWS}, c AS (SELECT expected, got, count(*) AS n FROM rr GROUP BY 1, 2)
SELECT expected, got, n, round(n / sum(n) OVER (PARTITION BY expected), 6) AS recall, round(n / sum(n) OVER (PARTITION BY got), 6) AS precision FROM c""")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Expected against chosen routes."""
    return ev.confusion(route_rows(spark, sf))


@query("route_report", f"""
WITH {ROUTE_ROWS}
SELECT count(*) AS n, round(count(*) FILTER (expected = got) / count(*), 6) AS accuracy,
  round(count(*) FILTER (expected = got AND NOT borderline) / count(*) FILTER (NOT borderline), 6) AS accuracy_clear,
  round(count(*) FILTER (expected = got AND borderline) / count(*) FILTER (borderline), 6) AS accuracy_borderline,
  round(count(*) FILTER (expected = 'plain' AND got <> 'plain') / count(*) FILTER (expected = 'plain'), 6) AS false_trigger,
  round(count(*) FILTER (expected <> 'plain' AND got = 'plain') / count(*) FILTER (expected <> 'plain'), 6) AS missed FROM rr""")
def route_report(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy and trigger errors of the routing rules."""
    return ev.route_report(route_rows(spark, sf))


@query("stratified_sample", f"""
WITH {DIMS},
b AS (SELECT doc_id, 0 AS stratum, '' AS o FROM cs WHERE veto ORDER BY doc_id LIMIT 15),
g AS (SELECT doc_id, 1 AS stratum, md5('42' || doc_id) AS o FROM cs WHERE NOT veto ORDER BY o, doc_id LIMIT 30)
SELECT doc_id, stratum FROM (SELECT * FROM b UNION ALL SELECT * FROM g) ORDER BY stratum, o, doc_id LIMIT 30""")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Thirty documents for review: vetoed first, then others in a seeded order."""
    return ev.review_sample(judged(spark, sf), "doc_id", "veto", "42").select("doc_id", "stratum")


@query("revision_overlay", """
WITH r AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'remapped' WHEN toxic = 1 THEN 'refallback' ELSE 'rewritten' END AS status,
   CASE WHEN quality = 0 THEN 'src' || (doc_id % 20) WHEN toxic = 1 THEN '' END AS source, 'label ' || quality || toxic AS reason FROM labels)
SELECT d.doc_id, coalesce(r.source, d.source) AS source, CASE WHEN r.source IS NOT NULL AND r.source <> d.source THEN d.source ELSE '' END AS old_source,
  coalesce(r.status, 'kept') AS status, coalesce(r.reason, '') AS reason FROM documents d LEFT JOIN r USING (doc_id)""")
def revision_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Documents after revisions made from the labels, with the replaced values."""
    source = F.when(F.col("quality") == 0, F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string"))).when(F.col("toxic") == 1, "")
    status = F.when(F.col("quality") == 0, "remapped").when(F.col("toxic") == 1, "refallback").otherwise("rewritten")
    revisions = read_table(spark, sf, "labels").select(
        "doc_id", status.alias("status"), source.alias("source"),
        F.concat(F.lit("label "), F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("reason"),
    )
    rows = ev.overlay(read_table(spark, sf, "documents", "doc_id", "source"), revisions, "doc_id", ["source"])
    return rows.withColumn("old_source", F.coalesce("old_source", F.lit("")))


@query("round_robin_pick", r"""
WITH s AS (SELECT doc_id, source, CAST(text LIKE '% is %' AS INTEGER) + CAST(regexp_matches(text, '[0-9]') AS INTEGER) + CAST(len(text) BETWEEN 50 AND 450 AS INTEGER)
   + CAST(lang = 'en' AS INTEGER) AS score FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS round FROM s)
SELECT doc_id, source, score, round FROM r WHERE round <= 2 ORDER BY round, source LIMIT 25""")
def round_robin_pick(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty-five good candidates taken in turns over the sources."""
    docs = read_documents(spark, sf, "source", "lang", "text").select(
        "doc_id", "source", (
            F.contains("text", F.lit(" is ")).cast("int") + F.col("text").rlike("[0-9]").cast("int")
            + F.length("text").between(50, 450).cast("int") + (F.col("lang") == "en").cast("int")
        ).alias("score"),
    )
    return ev.round_robin(docs, "source", F.col("score"), "doc_id", 2, 25).select("doc_id", "source", "score", "round")


NUMBERS = r"[0-9]+(?:[.][0-9]+)?"


@query("key_elements", rf"""
WITH n AS (SELECT doc_id, regexp_extract_all(text, '{NUMBERS}') AS x FROM documents),
u AS (SELECT doc_id, unnest(generate_series(1, len(x))) AS i, unnest(x) AS v FROM n), f AS (SELECT doc_id, v, min(i) AS i FROM u GROUP BY 1, 2),
k AS (SELECT doc_id, substr(string_agg(v, ' / ' ORDER BY i), 1, 80) AS key_elements FROM f GROUP BY 1)
SELECT doc_id, coalesce(key_elements, '') AS key_elements FROM documents LEFT JOIN k USING (doc_id)""")
def key_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct numbers of each document in order; without a number, an empty text."""
    docs = read_documents(spark, sf, "text")
    return docs.select("doc_id", ev.key_numbers(F.col("text"), NUMBERS).alias("key_elements"))


@query("eval_profile", """
SELECT coalesce(lang, 'ALL') AS lang, coalesce(source, 'ALL') AS source, count(*) AS n, count(*) FILTER (n_chars >= 50) AS n_valid, count(*) FILTER (n_chars < 50) AS n_boundary
FROM documents GROUP BY CUBE (lang, source)""")
def eval_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of usable and near-empty documents over all combinations of language and source."""
    return read_table(spark, sf, "documents", "lang", "source", "n_chars").cube("lang", "source").agg(
        F.count("*").alias("n"), F.count_if(F.col("n_chars") >= 50).alias("n_valid"), F.count_if(F.col("n_chars") < 50).alias("n_boundary")
    ).fillna("ALL", ["lang", "source"])
