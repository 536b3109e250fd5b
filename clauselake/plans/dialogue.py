"""Triage, routing and history over the conversations table, with the prose profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.functions.text import strip
from clauselake.operators import triage
from clauselake.plans.registry import query
from clauselake.plans.sql import BLANK
from clauselake.profiles import PROSE_ROUTES, PROSE_TRIAGE
from clauselake.sources.tables import read_table, spread

T, R = PROSE_TRIAGE, PROSE_ROUTES


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """All turns."""
    return spread(read_table(spark, sf, "conversations"), "conv_id", "turn")


def user_queries(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, query): user turns."""
    users = turns(spark, sf).filter(F.col("role") == "user")
    return users.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _count(column: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({column}, '{w}') THEN 1 ELSE 0 END" for w in words) + ")"


DEP_RAW = f"upper(regexp_replace(regexp_extract(q, '{T.deprecated_code}'), '\\s+', '', 'g'))"
DEP = "CASE " + " ".join(
    f"WHEN contains({DEP_RAW}, '{c.upper().replace(' ', '')}') THEN '{c}'" for c, *_ in T.deprecated
) + " END"
AMBIGUOUS = f"""CASE WHEN len(q) < {T.very_short} THEN true WHEN len(q) <= {T.mid_length} THEN
  {_count("q", T.concrete_words)} = 0 OR (NOT {_any("q", T.question_words)} AND {_count("q", T.concrete_words)} < 2) ELSE false END"""
TRIAGED = f"""
uq AS (SELECT conv_id * 1000 + turn AS query_id, text AS query FROM conversations WHERE role = 'user'),
us AS (SELECT query_id, query, regexp_replace(query, '^{BLANK}+|{BLANK}+$', '', 'g') AS q FROM uq),
tr AS (SELECT *, {DEP} AS dep, CASE WHEN q = '' THEN 'input_empty' WHEN len(q) > {T.max_length} THEN 'input_too_long'
  WHEN regexp_matches(q, '{T.sensitive}') THEN 'sensitive' WHEN ({DEP}) IS NOT NULL THEN 'deprecated'
  WHEN regexp_matches(q, '{T.chitchat}') THEN 'chitchat'
  WHEN len(q) <= {T.scope_length} AND {_any("lower(q)", T.out_of_scope)} THEN 'out_of_scope'
  WHEN {AMBIGUOUS} THEN 'ambiguous' ELSE 'normal' END AS scenario FROM us)"""


def _m(pattern: str) -> str:
    return f"regexp_matches(q, '{pattern}')"


ROUTED = f"""{TRIAGED},
rt AS (SELECT *, CASE WHEN q = '' THEN '' WHEN {_m(R.catalog)} THEN 'catalog' WHEN {_m(R.code)} AND {_m(R.status)} THEN 'status'
  WHEN {_m(R.code)} AND {_m(R.clause)} THEN 'clause_lookup' WHEN {_m(R.clause)} AND {_m(R.clause_lookup)} THEN 'clause_lookup'
  WHEN {_m(R.compound)} THEN 'compound' WHEN {_m(R.broad)} THEN CASE WHEN {_m(R.specific)} THEN 'broad_but_specific' ELSE 'broad' END
  ELSE '' END AS matched FROM tr),
ro AS (SELECT *, CASE WHEN matched IN ('catalog', 'status', 'clause_lookup') THEN 'tool'
  WHEN matched IN ('compound', 'broad') THEN 'decompose' ELSE 'plain' END AS route FROM rt)"""


def routed(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, query, scenario, route, reason, matched)."""
    return user_queries(spark, sf).select(
        "query_id", "query", triage.scenario(F.col("query"), T).alias("scenario"),
        F.inline(F.array(triage.route(F.col("query"), R))),
    )


@query("triage", f"WITH {TRIAGED} SELECT query_id, scenario FROM tr")
def triage_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Scenario of every user turn."""
    return user_queries(spark, sf).select("query_id", triage.scenario(F.col("query"), T).alias("scenario"))


@query("deprecated_lookup", f"WITH {TRIAGED} SELECT query_id, dep AS code FROM tr WHERE dep IS NOT NULL")
def deprecated_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """User turns naming a listed code."""
    code = triage.deprecated_code(strip(F.col("query")), T)
    return user_queries(spark, sf).select("query_id", code.alias("code")).filter(F.col("code").isNotNull())


@query("ambiguous_rule", f"""
WITH {TRIAGED} SELECT query_id, len(q) AS n, {_count("q", T.concrete_words)} AS n_concrete, {AMBIGUOUS} AS ambiguous FROM us""")
def ambiguous_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Length, concrete words and ambiguity of every user turn."""
    q = strip(F.col("query"))
    return user_queries(spark, sf).select(
        "query_id", F.length(q).alias("n"), triage.count_present(q, T.concrete_words).alias("n_concrete"),
        triage.is_ambiguous(q, T).alias("ambiguous"),
    )


@query("route", f"WITH {ROUTED} SELECT query_id, route, matched FROM ro")
def route(spark: SparkSession, sf: str) -> DataFrame:
    """Route of every user turn."""
    return routed(spark, sf).select("query_id", "route", "matched")


@query("route_escalate", f"""
WITH {ROUTED}, v AS (SELECT query_id, CASE query_id % 3 WHEN 0 THEN ' Single' WHEN 1 THEN 'BROAD or single' ELSE 'broad.' END AS verdict FROM us WHERE query_id % 4 < 3),
w AS (SELECT query_id, lower(verdict) AS verdict FROM v)
SELECT query_id, CASE WHEN matched = 'broad' AND contains(verdict, 'single') THEN 'plain' ELSE route END AS route,
  CASE WHEN matched = 'broad' AND contains(verdict, 'single') THEN 'verdict_single' WHEN matched = 'broad' AND contains(verdict, 'broad') THEN 'verdict_broad'
  ELSE matched END AS matched FROM ro LEFT JOIN w USING (query_id)""")
def route_escalate(spark: SparkSession, sf: str) -> DataFrame:
    """Routes after outside verdicts on the unsure ones."""
    key = F.col("query_id") % 3
    verdict = F.when(key == 0, " Single").when(key == 1, "BROAD or single").otherwise("broad.")
    verdicts = user_queries(spark, sf).filter(F.col("query_id") % 4 < 3).select("query_id", verdict.alias("verdict"))
    done = triage.escalate(routed(spark, sf).select("query_id", "route", "matched"), verdicts)
    return done.select("query_id", "route", "matched")


REPLIES = {
    "input_empty": "Please type a question.", "input_too_long": "Please split the question.",
    "sensitive": "Please ask the authority in charge.", "chitchat": "Hello, ask about the corpus.",
    "out_of_scope": "That is outside the corpus.", "ambiguous": "Please say what you look for.",
    "deprecated": "{name} {code} was replaced by {current} ({year}).",
}
REPLY_SQL = "replies(scenario, template) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in REPLIES.items()) + ")"
INFO_SQL = "info(code, current, name, year) AS (VALUES " + ", ".join(str(tuple(r)) for r in T.deprecated) + ")"


@query("fallback_reply", f"""
WITH {TRIAGED}, {REPLY_SQL}, {INFO_SQL}
SELECT query_id, scenario, replace(replace(replace(replace(template, '{{name}}', coalesce(name, '')), '{{code}}', coalesce(dep, '')),
  '{{current}}', coalesce(current, '')), '{{year}}', coalesce(year, '')) AS reply
FROM tr JOIN replies USING (scenario) LEFT JOIN info ON info.code = tr.dep""")
def fallback_reply(spark: SparkSession, sf: str) -> DataFrame:
    """Canned reply of every user turn that is not searched."""
    replies = spark.createDataFrame(list(REPLIES.items()), "scenario string, template string")
    triaged = routed(spark, sf).select("query_id", strip(F.col("query")).alias("query"), "scenario")
    return triage.fallback_reply(triaged, replies, T).select("query_id", "scenario", "reply")


@query("dispatch_counts", f"""
WITH {ROUTED}
SELECT CASE WHEN scenario IN ('input_empty', 'input_too_long', 'sensitive', 'deprecated') THEN 'reply:' || scenario
  WHEN route = 'tool' AND query_id % 5 <> 0 THEN 'tool' WHEN scenario <> 'normal' THEN 'reply:' || scenario
  WHEN route = 'decompose' THEN 'decomposed search' ELSE 'search' END AS handled_by, count(*) AS n FROM ro GROUP BY 1""")
def dispatch_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many user turns each step answers; the tool fails on every fifth."""
    step = triage.handled_by(F.col("scenario"), F.col("route"), F.col("query_id") % 5 != 0)
    return routed(spark, sf).groupBy(step.alias("handled_by")).agg(F.count("*").alias("n"))


@query("history_window", """
WITH f AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN '用户' ELSE '助手' END || '：' || substr(text, 1, 200) AS line
  FROM conversations WHERE role IN ('user', 'assistant') AND coalesce(text, '') <> ''),
h AS (SELECT conv_id, turn, role, list(line) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS h FROM f)
SELECT conv_id, turn, coalesce(len(h), 0) AS n_prior, coalesce(array_to_string(h, chr(10)), '') AS history FROM h WHERE role = 'user'""")
def history_window(spark: SparkSession, sf: str) -> DataFrame:
    """Last six messages before every user turn."""
    return triage.history(turns(spark, sf))


@query("conv_titles", f"""
WITH k AS (SELECT * FROM conversations WHERE NOT (role = 'assistant' AND coalesce(text, '') = '')),
t AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS t, count(*) AS n_messages FROM k GROUP BY 1),
f AS (SELECT conv_id, n_messages, regexp_replace(regexp_replace(t, '^{BLANK}+|{BLANK}+$', '', 'g'), '{BLANK}+', ' ', 'g') AS t FROM t WHERE t IS NOT NULL)
SELECT conv_id, n_messages, CASE WHEN len(t) > 24 THEN substr(t, 1, 24) || '…' ELSE t END AS title FROM f""")
def conv_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Title and size of every conversation."""
    return triage.titles(turns(spark, sf))


@query("qa_pairs", """
WITH n AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, text AS question, CASE WHEN nr = 'assistant' THEN nt ELSE '' END AS answer FROM n WHERE role = 'user'""")
def qa_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with the answer right after them."""
    return triage.answer_pairs(turns(spark, sf)).withColumn("answer", F.coalesce("answer", F.lit("")))
