"""Catalog, taxonomy, citation and project queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake import profiles as P
from clauselake.functions.text import norm_code
from clauselake.operators import catalog, triage
from clauselake.operators.lexical import bm25_top
from clauselake.operators.scale import broadcast_if
from clauselake.plans import sql
from clauselake.plans.registry import query
from clauselake.plans.search import bench_queries, doc_index
from clauselake.plans.sql import BLANK
from clauselake.sources.tables import read_documents, read_table, spread


@query("list_specs", """
SELECT source, arg_min(lang, doc_id) AS lang, arg_min(n_chars, doc_id) AS n_chars, count(*) AS n_chunks FROM documents GROUP BY 1""")
def list_specs(spark: SparkSession, sf: str) -> DataFrame:
    """Sources with the fields of their first document and their size."""
    docs = read_table(spark, sf, "documents", "doc_id", "source", "lang", "n_chars")
    return catalog.specs(docs, "source", ["lang", "n_chars"], "doc_id")


@query("list_specs_domain", """
SELECT source, arg_min(lang, doc_id) AS lang, count(*) AS n_chunks FROM documents WHERE lang = 'en' GROUP BY 1""")
def list_specs_domain(spark: SparkSession, sf: str) -> DataFrame:
    """Sources within one language."""
    docs = read_table(spark, sf, "documents", "doc_id", "source", "lang")
    return catalog.specs(docs, "source", ["lang"], "doc_id", F.col("lang") == "en")


WANTED = "['PROMO', 'ECONOM', 'XLARGE', ' STANDARD', 'MEDIUM BOX', 'TANDAR', 'NONE', '', 'SMALLER']"
REQUESTS = f"""
rq AS (SELECT c_custkey AS request_id, 'brand #' || (c_custkey % 30) AS code, ({WANTED})[c_custkey % 9 + 1] AS clause FROM customer),
rn AS (SELECT request_id, upper(replace(replace(code, ' ', ''), chr(12288), '')) AS k, trim(clause) AS want, code, clause FROM rq),
lb AS (SELECT upper(replace(p_brand, ' ', '')) AS k, trim(p_type) AS clause, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2),
ma AS (SELECT request_id, lb.clause, p_partkey, lb.clause = want AS exact, row_number() OVER (PARTITION BY request_id
  ORDER BY CASE WHEN lb.clause = want THEN 0 ELSE 1 END, p_partkey) AS rn
  FROM rn JOIN lb USING (k) WHERE want <> '' AND (contains(lb.clause, want) OR contains(want, lb.clause)))"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """(request_id, code, clause) wanted by the customers, in loose spellings."""
    words = ["PROMO", "ECONOM", "XLARGE", " STANDARD", "MEDIUM BOX", "TANDAR", "NONE", "", "SMALLER"]
    return read_table(spark, sf, "customer", "c_custkey").select(
        F.col("c_custkey").alias("request_id"),
        F.concat(F.lit("brand #"), (F.col("c_custkey") % 30).cast("string")).alias("code"),
        F.get(F.array(*[F.lit(w) for w in words]), (F.col("c_custkey") % 9).cast("int")).alias("clause"),
    )


def part_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct part types per brand."""
    return catalog.clause_labels(read_table(spark, sf, "part", "p_partkey", "p_brand", "p_type"), "p_brand", "p_type", "p_partkey")


@query("clause_lookup", f"WITH {REQUESTS} SELECT request_id, clause, p_partkey, exact FROM ma WHERE rn = 1")
def clause_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Best part type per request."""
    return catalog.lookup_clause(requests(spark, sf), part_labels(spark, sf), "p_partkey")


@query("near_hints", f"""
WITH {REQUESTS},
mi AS (SELECT * FROM rn WHERE request_id NOT IN (SELECT request_id FROM ma)),
hi AS (SELECT request_id, lb.clause AS hint, row_number() OVER (PARTITION BY request_id ORDER BY lb.clause) AS hint_no
  FROM mi JOIN lb USING (k) WHERE starts_with(lb.clause, CASE WHEN contains(want, '.') THEN split_part(want, '.', 1) ELSE substr(want, 1, 2) END))
SELECT request_id, hint_no, hint FROM hi WHERE hint_no <= 8""")
def near_hints(spark: SparkSession, sf: str) -> DataFrame:
    """Similar part types for the requests without a match."""
    asked, labels = requests(spark, sf), part_labels(spark, sf)
    missing = asked.join(catalog.lookup_clause(asked, labels, "p_partkey"), "request_id", "left_anti")
    return catalog.near_clauses(missing, labels)


STATUS = [("BRAND# 3", "废止", "Brand#4", "old"), ("brand#7", "即将实施", None, "soon"), ("Brand#99", "废止", None, None)]


def statuses(spark: SparkSession) -> DataFrame:
    """Short list of codes that are not simply in force."""
    return catalog.fixed_table(spark, STATUS, "code string, status string, replaced_by string, status_note string")


@query("status_join", f"""
WITH {REQUESTS},
st(k, status, replaced_by, note) AS (VALUES ('BRAND#3', '废止', 'Brand#4', 'old'), ('BRAND#7', '即将实施', NULL, 'soon'), ('BRAND#99', '废止', NULL, NULL)),
co AS (SELECT k, count(*) AS n FROM lb GROUP BY 1)
SELECT request_id, coalesce(status, '现行') AS status, coalesce(replaced_by, '') AS replaced_by, coalesce(note, '') AS status_note, co.k IS NOT NULL AS in_corpus
FROM rn LEFT JOIN st USING (k) LEFT JOIN co USING (k)""")
def status_join(spark: SparkSession, sf: str) -> DataFrame:
    """Status of every requested code and whether the corpus has it."""
    asked = catalog.with_status(requests(spark, sf), "code", statuses(spark)).withColumn("code_key", norm_code(F.col("code"), "a"))
    known = part_labels(spark, sf).select("code_key").distinct().withColumn("_in", F.lit(True))
    return asked.join(known, "code_key", "left").select(
        "request_id", "status", F.coalesce("replaced_by", F.lit("")).alias("replaced_by"),
        F.coalesce("status_note", F.lit("")).alias("status_note"), F.col("_in").isNotNull().alias("in_corpus"),
    )


@query("norm_code_join", """
WITH s AS (SELECT s_suppkey, ' brand' || chr(12288) || '#' || (s_suppkey % 28) || '－a' AS raw FROM supplier),
n AS (SELECT s_suppkey, upper(replace(replace(regexp_replace(raw, '[ \\x{3000}]', '', 'g'), '－', '-'), '—', '-')) AS k FROM s),
p AS (SELECT upper(p_brand) || '-A' AS k, count(*) AS n_parts FROM part GROUP BY 1)
SELECT s_suppkey, k AS code, n_parts FROM n JOIN p USING (k)""")
def norm_code_join(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers joined to brands through loosely written codes."""
    raw = F.concat(F.lit(" brand　#"), (F.col("s_suppkey") % 28).cast("string"), F.lit("－a"))
    left = read_table(spark, sf, "supplier", "s_suppkey").select("s_suppkey", norm_code(raw).alias("code"))
    right = read_table(spark, sf, "part", "p_brand").groupBy(
        norm_code(F.concat("p_brand", F.lit("–A"))).alias("code")
    ).agg(F.count("*").alias("n_parts"))
    return left.join(right, "code").select("s_suppkey", "code", "n_parts")


GROUPS = "gr(p_brand, sub_group) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in P.PROSE_GROUPS.items()) + ")"
ORDERS = "od(p_type, sub_group, declared) AS (VALUES " + ", ".join(
    f"('{d}', '{g}', {i})" for d, names in P.PROSE_GROUP_ORDER.items() for i, g in enumerate(names)
) + ")"


@query("taxonomy_join", f"WITH {GROUPS} SELECT p_partkey, coalesce(sub_group, '未分类') AS sub_group FROM part LEFT JOIN gr USING (p_brand)")
def taxonomy_join(spark: SparkSession, sf: str) -> DataFrame:
    """Group of every part by its brand."""
    parts = catalog.with_group(read_table(spark, sf, "part", "p_partkey", "p_brand"), "p_brand", P.PROSE_GROUPS)
    return parts.select("p_partkey", F.coalesce("sub_group", F.lit(P.UNCLASSIFIED)).alias("sub_group"))


def brand_specs(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (type, brand)."""
    return read_table(spark, sf, "part", "p_type", "p_brand").distinct()


GROUPED = f"""{GROUPS}, {ORDERS},
sp AS (SELECT DISTINCT p_type, p_brand FROM part),
cn AS (SELECT p_type, coalesce(sub_group, '未分类') AS sub_group, count(*) AS n_specs FROM sp LEFT JOIN gr USING (p_brand) GROUP BY ALL),
cd AS (SELECT *, CAST(sum(n_specs) OVER (PARTITION BY p_type) AS BIGINT) AS n_domain FROM cn),
gp AS (SELECT cd.*, row_number() OVER (PARTITION BY cd.p_type ORDER BY CASE WHEN cd.sub_group = '未分类' THEN 1 ELSE 0 END,
  declared NULLS LAST, cd.sub_group) AS group_pos
  FROM cd LEFT JOIN od ON od.p_type = cd.p_type AND od.sub_group = cd.sub_group WHERE n_domain >= 8 AND cd.p_type IN (SELECT p_type FROM od))"""


@query("taxonomy_groups", f"WITH {GROUPED} SELECT p_type, sub_group, group_pos, n_specs, n_domain FROM gp")
def taxonomy_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Subdivided part types with their groups in order."""
    return catalog.grouped_specs(brand_specs(spark, sf), "p_type", "p_brand", P.PROSE_GROUP_ORDER, P.PROSE_GROUPS)


@query("taxonomy_audit", f"""
WITH {GROUPED},
un AS (SELECT DISTINCT p_brand FROM sp WHERE p_brand NOT IN (SELECT p_brand FROM gr)),
st AS (SELECT p_brand FROM gr WHERE p_brand NOT IN (SELECT p_brand FROM sp)),
orp AS (SELECT DISTINCT sub_group FROM gr WHERE sub_group NOT IN (SELECT sub_group FROM od))
SELECT 'unclassified' AS problem, p_brand AS name FROM un UNION ALL SELECT 'not in corpus', p_brand FROM st UNION ALL SELECT 'no order', sub_group FROM orp
UNION ALL SELECT 'coverage', CAST(round(100.0 * count(*) FILTER (p_brand IN (SELECT p_brand FROM gr)) / count(*), 1) AS DECIMAL(9,1))::VARCHAR
FROM (SELECT DISTINCT p_brand FROM sp)""")
def taxonomy_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Brands without a group, listed brands without parts, groups without an order, and coverage."""
    groups = catalog.fixed_table(spark, list(P.PROSE_GROUPS.items()), "p_brand string, sub_group string")
    ordered = catalog.fixed_table(
        spark, [(g,) for names in P.PROSE_GROUP_ORDER.values() for g in names], "sub_group string"
    )
    brands = brand_specs(spark, sf).select("p_brand").distinct()
    marked = brands.join(groups, "p_brand", "left")

    def problem(name: str, df: DataFrame, col) -> DataFrame:
        return df.select(F.lit(name).alias("problem"), F.col(col).alias("name"))

    share = marked.agg(F.format_string("%.1f", 100.0 * F.count("sub_group") / F.count("*")).alias("name"))
    return (
        problem("unclassified", brands.join(groups, "p_brand", "left_anti"), "p_brand")
        .union(problem("not in corpus", groups.join(brands, "p_brand", "left_anti"), "p_brand"))
        .union(problem("no order", groups.select("sub_group").distinct().join(ordered, "sub_group", "left_anti"), "sub_group"))
        .union(problem("coverage", share, "name"))
    )


@query("nav_cost", f"""
WITH {GROUPED},
d AS (SELECT p_type, CAST(sum(n_specs) AS BIGINT) AS n, round((sum(n_specs) + 1) / 2, 6) AS flat,
  round((count(*) + 1) / 2 + sum(n_specs * (n_specs + 1) / 2) / sum(n_specs), 6) AS grouped FROM cn GROUP BY 1)
SELECT p_type, n, flat, grouped FROM d UNION ALL
SELECT 'ALL', CAST(sum(n) AS BIGINT), round(sum(n * flat) / sum(n), 6), round(sum(n * grouped) / sum(n), 6) FROM d""")
def nav_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Expected rows read to find a brand, flat and grouped, per part type and weighted over all."""
    counts = catalog.with_group(brand_specs(spark, sf), "p_brand", P.PROSE_GROUPS).groupBy(
        "p_type", F.coalesce("sub_group", F.lit(P.UNCLASSIFIED)).alias("sub_group")
    ).agg(F.count("*").alias("m"))
    per = catalog.scan_costs(counts, "p_type", "m")
    total = per.agg(
        F.lit("ALL").alias("p_type"), F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("flat")) / F.sum("n"), 6).alias("flat"),
        F.round(F.sum(F.col("n") * F.col("grouped")) / F.sum("n"), 6).alias("grouped"),
    )
    return per.unionByName(total)


@query("corpus_stats", """
WITH p AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT coalesce(lang, 'ALL') AS lang, coalesce(source, 'ALL') AS source, CAST(sum(n) AS BIGINT) AS n_chunks, count(*) AS n_specs
FROM p GROUP BY ROLLUP (lang, source)""")
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Documents per language and source with totals."""
    counts = catalog.corpus_counts(read_table(spark, sf, "documents", "lang", "source"), "lang", "source")
    return counts.fillna("ALL", ["lang", "source"])


@query("corpus_tree", """
WITH p AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT lang, CAST(sum(n) AS BIGINT) AS n_chunks, string_agg(source || ':' || n, ',' ORDER BY source) AS specs FROM p GROUP BY 1""")
def corpus_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Nested source list per language."""
    tree = catalog.corpus_tree(read_table(spark, sf, "documents", "lang", "source"), "lang", "source")
    flat = F.transform("specs", lambda s: F.concat(s["source"], F.lit(":"), s["n"].cast("string")))
    return tree.select("lang", "n_chunks", F.array_join(flat, ",").alias("specs"))


HITS = f"""{sql.DOC_TERMS}, {sql.BENCH}, {sql.scores("bq")}, {sql.top("hits", "qscore", "bm25", 5)},
ev AS (SELECT h.query_id, h.rank, d.doc_id, d.lang, d.source, d.text, d.n_chars % 3 = 0 AS mandatory, d.doc_id % 40 + 1 AS page
  FROM hits h JOIN documents d USING (doc_id))"""


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Five best documents per benchmark item with the fields of a citation."""
    queries = bench_queries(spark, sf)
    hits = bm25_top(doc_index(spark, sf), queries, 5).select("query_id", "doc_id", "rank")
    return read_documents(spark, sf, "lang", "source", "n_chars", "text").join(
        broadcast_if(hits, queries.count() * 5), "doc_id"
    ).select(
        "query_id", "rank", "doc_id", "lang", "source", "text", (F.col("n_chars") % 3 == 0).alias("mandatory"),
        (F.col("doc_id") % 40 + 1).alias("page"),
    )


@query("citations", f"""
WITH {HITS}
SELECT query_id, rank, doc_id, source AS code, page, mandatory, substr(text, 1, 200) AS original_text, regexp_matches(text, '[0-9]+-[0-9]+') AS has_formula,
  CASE WHEN source = 'src3' THEN '废止' ELSE '现行' END AS status FROM ev""")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    """Citation records of the hits of every benchmark item."""
    listed = catalog.fixed_table(
        spark, [("SRC 3", "废止", "src4", None)], "code string, status string, replaced_by string, status_note string"
    )
    cited = evidence(spark, sf).select(
        "query_id", "rank", "doc_id", F.col("source").alias("code"), "page", "mandatory",
        *catalog.citation(F.col("text"), "[0-9]+-[0-9]+"),
    )
    return catalog.with_status(cited, "code", listed).drop("replaced_by", "status_note")


@query("tier_summary", """
WITH t AS (SELECT p_type, upper(p_brand) AS k, CASE WHEN starts_with(upper(p_brand), 'BRAND#1') THEN 'local'
  WHEN starts_with(upper(p_brand), 'BRAND#2') THEN 'national' ELSE 'trade' END AS tier FROM part)
SELECT p_type, tier, count(DISTINCT k) AS n_codes, CASE tier WHEN 'national' THEN 1 WHEN 'trade' THEN 2 ELSE 3 END AS pos FROM t GROUP BY 1, 2""")
def tier_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct brands per tier and part type."""
    parts = read_table(spark, sf, "part", "p_type", "p_brand")
    return catalog.tier_summary(parts, "p_brand", (("national", "BRAND#2"), ("trade", ""), ("local", "BRAND#1")), ["p_type"])


TITLED = f"""
k AS (SELECT * FROM conversations WHERE NOT (role = 'assistant' AND coalesce(text, '') = '')),
tt AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS t FROM k GROUP BY 1),
tf AS (SELECT conv_id, regexp_replace(regexp_replace(t, '^{BLANK}+|{BLANK}+$', '', 'g'), '{BLANK}+', ' ', 'g') AS t FROM tt WHERE t IS NOT NULL),
ti AS (SELECT conv_id, CASE WHEN len(t) > 24 THEN substr(t, 1, 24) || '…' ELSE t END AS title FROM tf)"""


@query("conv_search", f"""
WITH {TITLED},
h AS (SELECT conv_id, min(turn) AS turn, arg_min(text, turn) AS text FROM conversations WHERE contains(lower(text), 'eit') GROUP BY 1),
s AS (SELECT conv_id, turn, text, strpos(lower(text), 'eit') AS p FROM h),
x AS (SELECT conv_id, turn, CASE WHEN p - 1 > 12 THEN '…' ELSE '' END || replace(substr(text, greatest(p - 12, 1), p - greatest(p - 12, 1) + 15), chr(10), ' ') AS snippet FROM s)
SELECT conv_id, coalesce(contains(lower(title), 'eit'), false) AS in_title, coalesce(turn, -1) AS turn, coalesce(snippet, '') AS snippet
FROM ti FULL JOIN x USING (conv_id) WHERE coalesce(contains(lower(title), 'eit'), false) OR snippet IS NOT NULL""")
def conv_search(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations holding a term, with a snippet of the first message that has it."""
    turns = spread(read_table(spark, sf, "conversations"), "conv_id", "turn")
    found = catalog.search_conversations(turns, triage.titles(turns).select("conv_id", "title"), "eit")
    return found.fillna({"turn": -1, "snippet": ""})


@query("filter_toggle", """
WITH s AS (SELECT p_type, list_sort(list(DISTINCT p_brand) FILTER (p_size > 30)) AS sel,
  list_sort(list(DISTINCT p_brand) FILTER (p_size < CASE WHEN p_type < 'M' THEN 2 ELSE 60 END AND p_brand LIKE '%1')) AS grp FROM part GROUP BY 1),
g AS (SELECT p_type, coalesce(sel, []) AS sel, coalesce(grp, []) AS grp FROM s),
m AS (SELECT *, list_filter(grp, lambda x: NOT list_contains(sel, x)) AS missing FROM g)
SELECT p_type, array_to_string(list_sort(CASE WHEN len(missing) = 0 THEN list_filter(sel, lambda x: NOT list_contains(grp, x)) ELSE list_concat(sel, missing) END), ',') AS after_toggle FROM m""")
def filter_toggle(spark: SparkSession, sf: str) -> DataFrame:
    """Brand filter per part type after toggling a group of brands."""
    limit = F.when(F.col("p_type") < "M", 2).otherwise(60)
    sets = read_table(spark, sf, "part", "p_type", "p_brand", "p_size").groupBy("p_type").agg(
        F.collect_set(F.when(F.col("p_size") > 30, F.col("p_brand"))).alias("sel"),
        F.collect_set(F.when((F.col("p_size") < limit) & F.col("p_brand").endswith("1"), F.col("p_brand"))).alias("grp"),
    )
    after = F.array_sort(catalog.toggle(F.col("sel"), F.col("grp")))
    return sets.select("p_type", F.array_join(after, ",").alias("after_toggle"))


@query("context_block", rf"""
WITH {HITS},
e AS (SELECT query_id, rank, '[' || rank || '] 《' || lang || '》' || source || ' 第 ' || doc_id || ' 条（第 ' || page || ' 页' || CASE WHEN mandatory THEN '·强制性条文' ELSE '' END || '）'
  || chr(10) || '"' || regexp_replace(text, '^{BLANK}+|{BLANK}+$', '', 'g') || '"' AS entry,
  '[' || rank || '] 《' || lang || '》' || source || ' ' || doc_id || '（' || CASE WHEN mandatory THEN '强制性条文 · ' ELSE '' END || '第' || page || '页）' || chr(10)
  || substr(replace(text, chr(10), ' '), 1, 300) AS short_entry FROM ev)
SELECT query_id, md5(string_agg(entry, chr(10) || chr(10) ORDER BY rank)) AS block, string_agg(short_entry, chr(10) || chr(10) ORDER BY rank) AS check_block FROM e GROUP BY 1""")
def context_block(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence blocks of every benchmark item, for the prompt (digest) and for the answer check."""
    args = [F.col("rank"), F.col("lang"), F.col("source"), F.col("doc_id").cast("string"), F.col("page"), F.col("mandatory"), F.col("text")]
    entries = evidence(spark, sf).select(
        "query_id", "rank", catalog.evidence_entry(*args).alias("entry"), catalog.check_entry(*args).alias("short_entry")
    )
    full = catalog.block(entries, "query_id", "rank", "entry").select("query_id", F.md5("block").alias("block"))
    short = catalog.block(entries, "query_id", "rank", "short_entry").withColumnRenamed("block", "check_block")
    return full.join(short, "query_id")


@query("spec_search", """
WITH s AS (SELECT p_brand || '-' || p_partkey AS code, p_name AS title FROM part), f AS (SELECT *, instr(lower(title), 'ol') AS p FROM s)
SELECT code, title, CASE WHEN p > 0 THEN CASE WHEN p > 13 THEN '…' ELSE '' END || substr(title, greatest(p - 12, 1), p - greatest(p - 12, 1) + 14) ELSE '' END AS snippet
FROM f WHERE p > 0 OR contains(lower(code), 'ol')""")
def spec_search(spark: SparkSession, sf: str) -> DataFrame:
    """Parts, as specs, whose code or name holds a term."""
    parts = read_table(spark, sf, "part", "p_partkey", "p_brand", "p_name").select(
        F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string")).alias("code"), F.col("p_name").alias("title"))
    return catalog.search_specs(parts, "OL")


@query("project_scope", """
WITH c AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 7 = 0 THEN NULL ELSE conv_id % 7 END AS project_id FROM conversations),
l AS (SELECT conv_id, CASE WHEN project_id IN (1, 2, 3, 4) THEN project_id END AS project_id FROM c)
SELECT coalesce(project_id, -1) AS project_id, count(*) AS n_conversations, min(conv_id) AS first_conv FROM l GROUP BY 1""")
def project_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations per project after two projects were deleted."""
    bucket = F.col("conv_id") % 7
    convs = read_table(spark, sf, "conversations", "conv_id").distinct().withColumn("project_id", F.when(bucket != 0, bucket))
    projects = catalog.fixed_table(spark, [(i,) for i in (1, 2, 3, 4)], "project_id long")
    return catalog.live_projects(convs, projects).groupBy(F.coalesce("project_id", F.lit(-1)).alias("project_id")).agg(
        F.count("*").alias("n_conversations"), F.min("conv_id").alias("first_conv")
    )


@query("project_default_filter", """
WITH c AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 7 BETWEEN 1 AND 4 THEN conv_id % 7 END AS project_id FROM conversations),
d AS (SELECT doc_id, source FROM documents)
SELECT conv_id, coalesce(project_id, -1) AS project_id, count(d.doc_id) AS n_docs
FROM c LEFT JOIN d ON project_id IS NULL OR d.source IN ('src' || project_id, 'src' || (project_id + 10)) GROUP BY 1, 2""")
def project_default_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in scope of each conversation through the spec list of its project; without a project, all."""
    rest = F.col("conv_id") % 7
    convs = read_table(spark, sf, "conversations", "conv_id").distinct().withColumn("project_id", F.when(rest.between(1, 4), rest))
    lists = catalog.fixed_table(
        spark, [(i, f"src{j}") for i in (1, 2, 3, 4) for j in (i, i + 10)], "project_id long, source string"
    )
    sizes = read_table(spark, sf, "documents", "source").groupBy("source").agg(F.count("*").alias("n"))
    per = lists.join(sizes, "source", "left").groupBy("project_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    return convs.join(per, "project_id", "left").select(
        "conv_id", F.coalesce("project_id", F.lit(-1)).alias("project_id"), F.coalesce("n_docs", total).alias("n_docs"))
