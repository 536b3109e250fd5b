"""Repairs, issue scans and audits over the documents table, with stand-in word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauselake import profiles as P
from clauselake.functions.text import count_class, strip
from clauselake.operators import quality
from clauselake.operators.containment import containing
from clauselake.operators.scale import top_k
from clauselake.plans.registry import query
from clauselake.plans.sql import BLANK
from clauselake.sources.tables import read_documents, read_table


def q(text: str) -> str:
    """SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def py(replacement: str) -> str:
    """Replacement with the group marks of the other regex engine."""
    return replacement.replace("$", "\\")


def _repair_sql() -> str:
    ctes, prev = [], "SELECT doc_id, source, text, 0 AS n FROM documents"
    for i, (a, b) in enumerate(P.PROSE_REPAIRS.items()):
        ctes.append(f"r{i} AS ({prev})")
        prev = (
            f"SELECT doc_id, source, replace(text, {q(a)}, {q(b)}) AS text, "
            f"n + (len(text) - len(replace(text, {q(a)}, ''))) // {len(a)} AS n FROM r{i}"
        )
    ctes.append(f"repaired AS ({prev})")
    return ", ".join(ctes)


@query("dict_repair", f"WITH {_repair_sql()} SELECT doc_id, md5(text) AS digest, CAST(n AS BIGINT) AS n_words FROM repaired")
def dict_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Documents after dictionary repair, with replacement counts."""
    done = quality.repair_words(read_documents(spark, sf, "text"), "text", P.PROSE_REPAIRS)
    return done.select("doc_id", F.md5("text").alias("digest"), "n_words")


@query("regex_repair", rf"""
SELECT doc_id, md5(regexp_replace(text, {q(P.PROSE_UNIT)}, '{py(P.PROSE_UNIT_REPLACEMENT)}', 'g')) AS digest,
  len(regexp_extract_all(text, {q(P.PROSE_UNIT)})) AS n_units FROM documents""")
def regex_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Documents after pattern repair, with match counts."""
    rules = [(P.PROSE_UNIT, P.PROSE_UNIT_REPLACEMENT)]
    done = quality.repair_patterns(read_documents(spark, sf, "text"), "text", rules)
    return done.select("doc_id", F.md5("text").alias("digest"), "n_units")


LISTED = "(" + ", ".join(q(x) for x in P.PROSE_FURNITURE) + ")"
FURNITURE = rf"""
fl AS (SELECT doc_id, source, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no,
  unnest(string_split(text, chr(10))) AS line FROM documents),
ft AS (SELECT *, regexp_replace(line, '^{BLANK}+|{BLANK}+$', '', 'g') AS t FROM fl),
fw AS (SELECT *, t IN {LISTED} AS wm FROM ft),
fp AS (SELECT *, regexp_matches(t, {q(P.PROSE_PAGE_NUMBER)}) AND (coalesce(lag(wm) OVER w, false) OR coalesce(lead(wm) OVER w, false)) AS pg
  FROM fw WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
fx AS (SELECT doc_id, any_value(source) AS source,
  coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT wm AND NOT pg), '') AS text,
  count(*) FILTER (wm) AS n_furniture, count(*) FILTER (pg) AS n_page_no FROM fp GROUP BY doc_id)"""


@query("strip_repeated_lines", f"WITH {FURNITURE} SELECT doc_id, md5(text) AS digest, n_furniture, n_page_no FROM fx")
def strip_repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without listed lines and without short lines beside them."""
    docs = read_documents(spark, sf, "text")
    done = quality.strip_furniture(docs, "text", P.PROSE_FURNITURE, P.PROSE_PAGE_NUMBER)
    return done.select("doc_id", F.md5("text").alias("digest"), "n_furniture", "n_page_no")


KEYWORD = " OR ".join(f"t LIKE '%{k}%'" for k in P.PROSE_FURNITURE_KEYWORDS)


@query("line_census", f"WITH {FURNITURE} SELECT t AS line, count(*) AS n FROM ft WHERE ({KEYWORD}) AND t NOT IN {LISTED} GROUP BY 1")
def line_census(spark: SparkSession, sf: str) -> DataFrame:
    """Unlisted lines holding a keyword, with counts."""
    return quality.line_census(
        read_documents(spark, sf, "text"), "text", P.PROSE_FURNITURE_KEYWORDS, P.PROSE_FURNITURE
    )


@query("rejoin_audit", rf"""
WITH {FURNITURE},
kept AS (SELECT *, CASE WHEN t <> '' AND NOT wm AND NOT regexp_matches(t, {q(P.PROSE_PAGE_NUMBER)}) THEN t END AS k FROM fw),
ar AS (SELECT doc_id, line_no, wm, last_value(k IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  first_value(k IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM kept)
SELECT doc_id, line_no, right(b, 18) AS before, substr(a, 1, 18) AS after FROM ar WHERE wm AND a IS NOT NULL AND b IS NOT NULL""")
def rejoin_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Text on both sides of every removed line that sits between kept lines."""
    docs = read_documents(spark, sf, "text")
    return quality.rejoin_audit(docs, "doc_id", "text", P.PROSE_FURNITURE, P.PROSE_PAGE_NUMBER)


@query("change_rollup", f"""
WITH {_repair_sql()}, {FURNITURE},
c AS (SELECT source, doc_id, n AS n_words, n_furniture + n_page_no AS n_lines FROM repaired JOIN (SELECT doc_id, n_furniture, n_page_no FROM fx) USING (doc_id))
SELECT coalesce(source, 'ALL') AS source, count(*) FILTER (n_words + n_lines > 0) AS n_changed,
  CAST(sum(n_words) AS BIGINT) AS n_words, CAST(sum(n_lines) AS BIGINT) AS n_lines FROM c GROUP BY ROLLUP (source)""")
def change_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Changed documents and changes per source and in total."""
    docs = read_documents(spark, sf, "source", "text").withColumn("raw", F.col("text"))
    done = quality.repair_words(docs, "text", P.PROSE_REPAIRS)
    done = quality.strip_furniture(done, "raw", P.PROSE_FURNITURE, P.PROSE_PAGE_NUMBER)
    per = done.select("source", "n_words", (F.col("n_furniture") + F.col("n_page_no")).alias("n_lines"))
    return per.rollup("source").agg(
        F.count_if(F.col("n_words") + F.col("n_lines") > 0).alias("n_changed"), F.sum("n_words").alias("n_words"),
        F.sum("n_lines").alias("n_lines"),
    ).withColumn("source", F.coalesce("source", F.lit("ALL")))


def _issues_sql() -> str:
    fixed = [
        f"SELECT doc_id, source, 'known_error' AS kind, {q(f'{e}>{fix}')} AS detail FROM documents WHERE text LIKE '%{e}%'"
        for e, fix in P.PROSE_ERRORS.items()
    ]
    for kind, pattern, detail in (
        ("punctuation_run", P.PROSE_PUNCTUATION_RUN, f"regexp_extract(text, {q(P.PROSE_PUNCTUATION_RUN)})"),
        ("zero_mixup", P.PROSE_ZERO_MIXUP, "'0'"), ("one_mixup", P.PROSE_ONE_MIXUP, "'1'"),
        ("mixed_run", P.PROSE_MIXED_RUN, "''"),
    ):
        fixed.append(f"SELECT doc_id, source, '{kind}', {detail} FROM documents WHERE regexp_matches(text, {q(pattern)})")
    fixed.append(
        f"SELECT doc_id, source, 'rare_char', unnest(regexp_extract_all(regexp_replace(text, {q(P.PROSE_USUAL)}, '', 'g'), '(?s).')) FROM documents"
    )
    return "issues AS (" + " UNION ALL ".join(fixed) + ")"


def issues(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, source, kind, detail) of the first scan."""
    docs = read_documents(spark, sf, "source", "text")
    found = quality.scan_issues(
        F.col("text"), P.PROSE_ERRORS, P.PROSE_PUNCTUATION_RUN, P.PROSE_ZERO_MIXUP, P.PROSE_ONE_MIXUP,
        P.PROSE_MIXED_RUN, P.PROSE_USUAL,
    )
    return docs.select("doc_id", "source", F.inline_outer(found)).filter(F.col("kind").isNotNull())


@query("issue_scan", f"WITH {_issues_sql()} SELECT doc_id, kind, detail, count(*) AS n FROM issues GROUP BY ALL")
def issue_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Issues per document."""
    return issues(spark, sf).groupBy("doc_id", "kind", "detail").agg(F.count("*").alias("n"))


@query("issue_rollup", f"""
WITH {_issues_sql()},
by_kind AS (SELECT 'kind' AS scope, kind AS name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, kind) AS pos FROM issues GROUP BY kind),
by_source AS (SELECT 'source' AS scope, source AS name, count(DISTINCT doc_id) AS n,
  row_number() OVER (ORDER BY count(DISTINCT doc_id) DESC, source) AS pos FROM issues GROUP BY source)
SELECT * FROM by_kind UNION ALL SELECT * FROM by_source WHERE pos <= 15""")
def issue_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Issues by kind, and the fifteen sources with most affected documents."""
    found = issues(spark, sf)
    kinds = quality.issue_kinds(found).select(F.lit("kind").alias("scope"), F.col("kind").alias("name"), "n")
    sources = found.groupBy("source").agg(F.countDistinct("doc_id").alias("n")).select(
        F.lit("source").alias("scope"), F.col("source").alias("name"), "n"
    )
    best = [F.col("n").desc(), F.col("name")]
    ranked = kinds.withColumn("pos", F.row_number().over(Window.orderBy(*best)))  # one row per kind
    return ranked.unionByName(top_k(sources, ["scope"], best, 15, "pos"))


@query("issue_details", f"""
WITH {_issues_sql()}, d AS (SELECT DISTINCT kind, doc_id, detail FROM issues)
SELECT kind, doc_id, detail, pos FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY doc_id, detail) AS pos FROM d) WHERE pos <= 50""")
def issue_details(spark: SparkSession, sf: str) -> DataFrame:
    """The first fifty details of each kind of issue."""
    found = issues(spark, sf).select("kind", "doc_id", "detail").distinct()
    return top_k(found, ["kind"], [F.col("doc_id"), F.col("detail")], 50, "pos")


def _issues_2_sql() -> str:
    parts = [
        f"SELECT doc_id, 'known' AS kind, {q(f'{e}>{fix}')} AS detail FROM documents WHERE text LIKE '%{e}%'"
        for e, fix in P.PROSE_ERRORS.items()
    ] + [
        f"SELECT doc_id, 'unit_drop', regexp_extract(text, {q(p)}) FROM documents WHERE regexp_matches(text, {q(p)})"
        for p, _ in P.PROSE_UNIT_DROPS
    ] + [f"SELECT doc_id, 'number_letter_mix', unnest(regexp_extract_all(text, {q(P.PROSE_NUMBER_LETTER)})) FROM documents"]
    for ch, fix in P.PROSE_SUSPICIOUS.items():
        for c in P.PROSE_SUSPICIOUS_CONTEXTS:
            word = c.format(ch)
            parts.append(f"SELECT doc_id, 'suspicious_char', {q(f'{word}:{ch}>{fix}')} FROM documents WHERE text LIKE '%{word}%'")
    suggestions = " + ".join(
        [f"CASE WHEN text LIKE '%{e}%' THEN 1 ELSE 0 END" for e in P.PROSE_ERRORS]
        + [f"CASE WHEN regexp_replace(text, {q(p)}, '{py(r)}', 'g') <> text THEN 1 ELSE 0 END" for p, r in P.PROSE_UNIT_DROPS]
    )
    first = "coalesce(" + ", ".join(
        [f"CASE WHEN text LIKE '%{e}%' THEN replace(text, {q(e)}, {q(fix)}) END" for e, fix in P.PROSE_ERRORS.items()]
        + [f"nullif(regexp_replace(text, {q(p)}, '{py(r)}', 'g'), text)" for p, r in P.PROSE_UNIT_DROPS] + ["''"]
    ) + ")"
    return (
        "i2 AS (" + " UNION ALL ".join(parts) + "), "
        "g2 AS (SELECT doc_id, count(*) AS n_issues, bool_or(kind = 'known') AS hi, string_agg(kind || '=' || detail, ';' ORDER BY kind, detail) AS details "
        "FROM i2 GROUP BY 1), "
        f"s2 AS (SELECT doc_id, {suggestions} AS n_suggestions, {first} AS first_suggestion FROM documents)"
    )


@query("issue_scan_v2", f"""
WITH {_issues_2_sql()}
SELECT doc_id, n_issues, n_suggestions, CASE WHEN hi THEN 'hi' ELSE 'mid' END AS confidence, md5(first_suggestion) AS first_suggestion,
  details FROM g2 JOIN s2 USING (doc_id)""")
def issue_scan_v2(spark: SparkSession, sf: str) -> DataFrame:
    """Second scan: issues, corrected texts offered and confidence per document."""
    docs = read_documents(spark, sf, "text")
    scan = quality.scan_issues_2(
        F.col("text"), P.PROSE_ERRORS, P.PROSE_UNIT_DROPS, P.PROSE_NUMBER_LETTER, P.PROSE_SUSPICIOUS,
        P.PROSE_SUSPICIOUS_CONTEXTS,
    )
    rows = docs.select("doc_id", F.inline(F.array(scan)))
    details = F.array_sort(F.transform("issues", lambda x: F.concat(x["kind"], F.lit("="), x["detail"])))
    return rows.filter(F.size("issues") > 0).select(
        "doc_id", F.size("issues").alias("n_issues"), F.size("suggestions").alias("n_suggestions"), "confidence",
        F.md5(F.coalesce(F.get("suggestions", F.lit(0)), F.lit(""))).alias("first_suggestion"),
        F.array_join(details, ";").alias("details"),
    )


@query("verdict_join", f"""
WITH {_issues_2_sql()},
v AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'fix: wording' WHEN toxic = 1 THEN 'false positive' ELSE 'maybe' END AS verdict FROM labels)
SELECT CASE WHEN verdict IS NULL THEN 'unverified' WHEN verdict LIKE 'fix%' THEN 'fix' WHEN verdict LIKE 'false%' THEN 'false_positive'
  ELSE 'uncertain' END AS bucket, CASE WHEN hi THEN 'hi' ELSE 'mid' END AS confidence, count(*) AS n
FROM g2 LEFT JOIN v USING (doc_id) GROUP BY ALL""")
def verdict_join(spark: SparkSession, sf: str) -> DataFrame:
    """Flagged documents by verdict of a later check (labels stand in) and confidence."""
    flagged = issue_scan_v2(spark, sf).select("doc_id", "confidence")
    verdict = (
        F.when(F.col("quality") == 0, "fix: wording").when(F.col("toxic") == 1, "false positive").otherwise("maybe")
    )
    verdicts = read_table(spark, sf, "labels").select("doc_id", verdict.alias("verdict"))
    return flagged.join(verdicts, "doc_id", "left").groupBy(
        quality.verdict_bucket(F.col("verdict")).alias("bucket"), "confidence"
    ).agg(F.count("*").alias("n"))


def sampled_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, source, pairs) of thirty sampled texts per source; proposals are made from their words."""
    docs = read_documents(spark, sf, "source", "n_chars", "text").select(
        "doc_id", "source", "n_chars", F.contains("text", F.lit(" the ")).alias("mandatory"),
        F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)).alias("w"),
    )
    halves = F.when(F.size("w") >= 2, F.sequence(F.lit(0), F.expr("size(w) div 2 - 1"))).otherwise(F.array().cast("array<int>"))
    lines = F.transform(halves, lambda i: F.concat(
        F.substring(F.get("w", i * 2), 1, 3), F.lit("=>"), F.substring(F.get("w", i * 2 + 1), 1, 3)))
    proposals = F.concat(F.array_join(lines, "\n "), F.lit("\nNONE\nabcd=>x"))
    sample = quality.sample_per_spec(docs, "source", "n_chars", "mandatory", "doc_id", 30)
    return sample.select("doc_id", "source", quality.proposed_pairs(proposals, r"\p{L}").alias("pairs"))


SAMPLED = r"""
s0 AS (SELECT doc_id, source, n_chars, regexp_extract_all(text, '\p{L}+') AS w,
  row_number() OVER (PARTITION BY source ORDER BY text LIKE '% the %' DESC, doc_id) AS rn FROM documents WHERE n_chars BETWEEN 60 AND 400),
s1 AS (SELECT doc_id, source, w FROM s0 WHERE rn <= 30),
si AS (SELECT *, unnest(range(1, len(w) // 2 + 1)) AS i FROM s1),
s2 AS (SELECT doc_id, source, substr(w[2 * i - 1], 1, 3) AS wrong, substr(w[2 * i], 1, 3) AS fixed FROM si),
s3 AS (SELECT * FROM s2 WHERE wrong <> '' AND fixed <> '' AND wrong <> fixed)"""


@query("pair_mining", f"WITH {SAMPLED} SELECT wrong, fixed AS \"right\", count(*) AS n FROM s3 GROUP BY 1, 2 HAVING count(*) >= 2")
def pair_mining(spark: SparkSession, sf: str) -> DataFrame:
    """Corrections proposed at least twice."""
    pairs = sampled_pairs(spark, sf).select(F.inline_outer("pairs")).filter(F.col("wrong").isNotNull())
    return pairs.groupBy("wrong", "right").agg(F.count("*").alias("n")).filter(F.col("n") >= 2)


@query("pair_damage", f"""
WITH {SAMPLED},
d AS (SELECT source, count(*) AS n_seen FROM s1 GROUP BY 1),
e AS (SELECT source, count(DISTINCT doc_id) AS n_hit FROM s3 GROUP BY 1)
SELECT source, n_seen, coalesce(n_hit, 0) AS n_hit, round(coalesce(n_hit, 0) / n_seen, 6) AS ratio FROM d LEFT JOIN e USING (source) WHERE n_seen >= 2""")
def pair_damage(spark: SparkSession, sf: str) -> DataFrame:
    """Share of sampled texts per source with a proposed correction."""
    per = sampled_pairs(spark, sf).groupBy("source").agg(
        F.count("*").alias("n_seen"), F.count_if(F.size("pairs") > 0).alias("n_hit")
    )
    return per.filter(F.col("n_seen") >= 2).withColumn("ratio", F.round(F.col("n_hit") / F.col("n_seen"), 6))


@query("concordance", """
WITH p AS (SELECT string_split(text, 'eaux') AS p FROM documents WHERE text LIKE '%eaux%'),
o AS (SELECT p, unnest(generate_series(1, len(p) - 1)) AS i FROM p),
c AS (SELECT right(array_to_string(p[1:i], 'eaux'), 3) AS "left", substr(array_to_string(p[i + 1:], 'eaux'), 1, 3) AS "right" FROM o)
SELECT "left", "right", count(*) AS n FROM c GROUP BY ALL""")
def concordance(spark: SparkSession, sf: str) -> DataFrame:
    """Every occurrence of a candidate error with three characters on both sides."""
    return quality.concordance(read_documents(spark, sf, "text"), "text", "eaux", 3)


@query("low_content", r"""
SELECT doc_id, source, len(text) AS n, len(regexp_extract_all(text, '\p{L}')) AS n_letters FROM documents
WHERE len(text) < 12 OR len(regexp_extract_all(text, '\p{L}')) / len(text) < 0.75""")
def low_content(spark: SparkSession, sf: str) -> DataFrame:
    """Very short documents and those with few letters."""
    docs = read_documents(spark, sf, "source", "text")
    bad = quality.low_content(F.col("text"), r"\p{L}", 12, 0.75)
    return docs.filter(bad).select(
        "doc_id", "source", F.length("text").alias("n"), count_class(F.col("text"), r"\p{L}").alias("n_letters")
    )


GARBLE = r"[a-z][%*&!$]+[a-z]|[%*&!$#]{2,}"


@query("garble_density", rf"""
SELECT source, CAST(sum(len(regexp_extract_all(text, {q(GARBLE)}))) AS BIGINT) AS n_hits, CAST(sum(len(text)) AS BIGINT) AS n_chars,
  round(sum(len(regexp_extract_all(text, {q(GARBLE)}))) / sum(len(text)) * 1000, 6) AS density FROM documents GROUP BY 1""")
def garble_density(spark: SparkSession, sf: str) -> DataFrame:
    """Garbled runs per thousand characters by source."""
    return quality.density(read_documents(spark, sf, "source", "text"), "source", "text", GARBLE)


@query("contam_share", """
WITH hits AS (SELECT d.doc_id, min(strpos(d.text, b.text)) AS pos, count(*) AS n FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY 1)
SELECT lang, count(*) AS n_docs, count(h.doc_id) AS n_affected, round(count(h.doc_id) / count(*), 6) AS share,
  coalesce(CAST(sum(h.n) AS BIGINT), 0) AS n_passages, count(*) FILTER (h.pos <= 200) AS n_near_start
FROM documents d LEFT JOIN hits h USING (doc_id) GROUP BY 1""")
def contam_share(spark: SparkSession, sf: str) -> DataFrame:
    """Documents holding a benchmark passage by language, and those where it starts near the top."""
    docs = read_documents(spark, sf, "lang", "text")
    passages = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    placed = containing(docs, passages).groupBy("doc_id").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
    return docs.select("doc_id", "lang").join(placed, "doc_id", "left").groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.count("n").alias("n_affected"),
        F.round(F.count("n") / F.count("*"), 6).alias("share"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_passages"),
        F.count_if(F.col("pos") <= 200).alias("n_near_start"),
    )


@query("dup_ratio", rf"""
SELECT source, count(*) AS n, count(DISTINCT md5(regexp_replace(text, '{BLANK}', '', 'g'))) AS n_distinct,
  round(count(*) / count(DISTINCT md5(regexp_replace(text, '{BLANK}', '', 'g'))), 6) AS ratio FROM documents GROUP BY 1""")
def dup_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Documents per distinct text by source."""
    docs = read_documents(spark, sf, "source", "text").select(
        "source", F.md5(F.regexp_replace("text", BLANK, "")).alias("key")
    )
    return docs.groupBy("source").agg(
        F.count("*").alias("n"), F.countDistinct("key").alias("n_distinct"),
        F.round(F.count("*") / F.countDistinct("key"), 6).alias("ratio"),
    )
