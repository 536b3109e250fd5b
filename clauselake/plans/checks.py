"""Answer checks over conversations (assistant turns answer, the user turn before them is the evidence)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.functions.text import strip
from clauselake.operators import evidence, triage
from clauselake.plans.registry import query
from clauselake.plans.sql import BLANK
from clauselake.profiles import PROSE_MODALS, PROSE_NUMBER_PATTERN
from clauselake.sources.tables import read_documents, read_table, spread

MATCH = 3
WORDS = "(" + ", ".join(f"'{w}'" for w in PROSE_MODALS.tiers) + ")"

PAIRS = """
nx AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
qa AS (SELECT conv_id * 1000 + turn AS id, text AS question, nt AS answer FROM nx WHERE role = 'user' AND nr = 'assistant')"""


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """(id, question, text): answered questions."""
    turns = spread(read_table(spark, sf, "conversations"), "conv_id", "turn")
    return triage.answer_pairs(turns).filter(F.col("answer").isNotNull()).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "question", F.col("answer").alias("text")
    )


def _anchors_sql(name: str, source: str, text: str, pieces: str, keep: str) -> str:
    """CTEs up to {name}(id, pos, prefix, word, suffix)."""
    return rf"""
{name}_p AS (SELECT id, {text} AS text, regexp_extract_all({text}, '{pieces}') AS p FROM {source}),
{name}_u AS (SELECT id, unnest(generate_series(1, len(p))) AS i, unnest(p) AS word FROM {name}_p),
{name}_w AS (SELECT *, CAST(sum(len(word)) OVER (PARTITION BY id ORDER BY i) - len(word) AS INTEGER) AS pos FROM {name}_u),
{name}_k AS (SELECT * FROM {name}_w WHERE {keep}),
{name} AS (SELECT id, pos, right(array_to_string(p[greatest(i - 16, 1):i - 1], ''), 8) AS prefix, word,
  substr(array_to_string(p[i + 1:i + 16], ''), 1, 8) AS suffix FROM {name}_k JOIN {name}_p USING (id))"""


WORD_PIECES = r"(?s)[\p{L}\p{N}]+|[^\p{L}\p{N}]+"
NUMBER_PIECES = r"(?s)" + PROSE_NUMBER_PATTERN + r"|[^0-9]+"


@query("anchor_extract", f"""
WITH src AS (SELECT doc_id AS id, text FROM documents), {_anchors_sql("a", "src", "text", WORD_PIECES, f"word IN {WORDS}")}
SELECT id AS doc_id, pos, prefix, word, suffix FROM a""")
def anchor_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Words of obligation in the documents with their places and contexts."""
    found = evidence.anchors(read_documents(spark, sf, "text"), ["doc_id"], "text", PROSE_MODALS.pattern)
    return found.drop("no")


TIERS = "CASE " + " ".join(f"WHEN word = '{w}' THEN '{t}'" for w, t in PROSE_MODALS.tiers.items()) + " END"


@query("modal_profile", f"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '{WORD_PIECES}')) AS word FROM documents)
SELECT doc_id, {TIERS} AS tier, count(*) AS n FROM w WHERE word IN {WORDS} GROUP BY 1, 2""")
def modal_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Words of obligation per document and tier."""
    return evidence.modal_tiers(read_documents(spark, sf, "text"), "doc_id", "text", PROSE_MODALS)


def _match_sql(a: str, s: str, extra: str = "") -> str:
    """CTEs up to ch(id, pos, old, new, context): all pairs per answer, best kept."""
    tail = " + ".join(
        f"CASE WHEN least(len(a.prefix), len(s.prefix)) >= {i} AND right(a.prefix, {i}) = right(s.prefix, {i}) THEN 1 ELSE 0 END" for i in range(1, 9)
    )
    head = " + ".join(
        f"CASE WHEN least(len(a.suffix), len(s.suffix)) >= {i} AND substr(a.suffix, 1, {i}) = substr(s.suffix, 1, {i}) THEN 1 ELSE 0 END" for i in range(1, 9)
    )
    return f"""
pr AS (SELECT a.id, a.pos, a.prefix, a.word AS old, a.suffix, s.word AS new, s.pos AS s_pos, {tail} + {head} AS total
  FROM {a} a JOIN {s} s USING (id) WHERE true {extra}),
bs AS (SELECT *, row_number() OVER (PARTITION BY id, pos ORDER BY total DESC, s_pos) AS rn FROM pr WHERE total >= {MATCH}),
ch AS (SELECT id, pos, old, new, substr(prefix || old || suffix, 1, 40) AS context FROM bs WHERE rn = 1 AND old <> new)"""


MODAL_ANCHORS = (
    _anchors_sql("aa", "qa", "answer", WORD_PIECES, f"word IN {WORDS}") + ","
    + _anchors_sql("sa", "qa", "question", WORD_PIECES, f"word IN {WORDS}")
)


def sources(pairs: DataFrame) -> DataFrame:
    """(id, ev_no, text): the question as the only evidence."""
    return pairs.select("id", F.lit(1).alias("ev_no"), F.col("question").alias("text"))


def modal_changes(pairs: DataFrame) -> DataFrame:
    """Differences between the words of obligation of answers and evidence."""
    found = evidence.anchors(pairs, ["id"], "text", PROSE_MODALS.pattern)
    known = evidence.anchors(sources(pairs), ["id", "ev_no"], "text", PROSE_MODALS.pattern)
    return evidence.match_anchors(found, known, "id", MATCH)


@query("modal_diffs", f"WITH {PAIRS}, {MODAL_ANCHORS}, {_match_sql('aa', 'sa')} SELECT id, pos, old, new, context FROM ch")
def modal_diffs(spark: SparkSession, sf: str) -> DataFrame:
    """Words of obligation that differ between answer and evidence in the same context."""
    return modal_changes(answers(spark, sf))


@query("anchor_align", f"""
WITH {PAIRS}, {MODAL_ANCHORS}, {_match_sql('aa', 'sa')},
ap AS (SELECT id, answer AS text, regexp_extract_all(answer, '{WORD_PIECES}') AS p FROM qa),
au AS (SELECT id, unnest(generate_series(1, len(p))) AS i, unnest(p) AS word FROM ap),
aw AS (SELECT *, CAST(sum(len(word)) OVER (PARTITION BY id ORDER BY i) - len(word) AS INTEGER) AS pos FROM au),
rb AS (SELECT aw.id, string_agg(coalesce(ch.new, aw.word), '' ORDER BY i) AS text, count(ch.new) AS n_changes FROM aw LEFT JOIN ch USING (id, pos) GROUP BY 1)
SELECT id, md5(text) AS digest, n_changes FROM rb""")
def anchor_align(spark: SparkSession, sf: str) -> DataFrame:
    """Answers after their words of obligation were set to those of the evidence."""
    pairs = answers(spark, sf)
    done = evidence.align_modals(pairs.select("id", "text"), sources(pairs), "id", PROSE_MODALS, MATCH)
    return done.select("id", F.md5("text").alias("digest"), F.col("n_changes").cast("long").alias("n_changes"))


NUMBERED = r"""
na AS (SELECT id, question || ' about ' || (id % 7) || ' of ' || (id % 5) || '.' AS question,
  answer || ' about ' || (id % 6) || ' of ' || (id % 5) || '.' AS answer FROM qa)"""


@query("number_diffs", f"""
WITH {PAIRS}, {NUMBERED}, {_anchors_sql("aa", "na", "answer", NUMBER_PIECES, "regexp_matches(word, '^[0-9]')")},
{_anchors_sql("sa", "na", "question", NUMBER_PIECES, "regexp_matches(word, '^[0-9]')")}, {_match_sql('aa', 'sa', "AND a.word <> s.word")}
SELECT id, pos, old, new, context FROM ch""")
def number_diffs(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers that differ between answer and evidence; both get a closing phrase with numbers of the turn."""

    def with_numbers(text: str, m: int) -> F.Column:
        return F.concat(
            F.col(text), F.lit(" about "), (F.col("id") % m).cast("string"), F.lit(" of "), (F.col("id") % 5).cast("string"), F.lit(".")
        )

    pairs = answers(spark, sf).select("id", with_numbers("question", 7).alias("question"), with_numbers("text", 6).alias("text"))
    found = evidence.anchors(pairs, ["id"], "text", PROSE_NUMBER_PATTERN)
    known = evidence.anchors(sources(pairs), ["id", "ev_no"], "text", PROSE_NUMBER_PATTERN)
    return evidence.match_anchors(found, known, "id", MATCH, skip_equal=True)


def quoting_answers(pairs: DataFrame) -> DataFrame:
    """Answers that quote the whole question, on one line, and its first ten letters."""
    flat = strip(F.translate("question", '\n"', "  "))
    quoted = F.concat(F.lit('asked "'), flat, F.lit('" and "'), F.substring(flat, 1, 10), F.lit('" '), F.translate("text", '"“”「」『』', "       "))
    return pairs.select("id", flat.alias("question"), quoted.alias("text"))


@query("echo_guard", rf"""
WITH {PAIRS},
fl AS (SELECT id, regexp_replace(replace(replace(question, chr(10), ' '), '"', ' '), '^{BLANK}+|{BLANK}+$', '', 'g') AS q FROM qa),
sp AS (SELECT id, 7 AS span_start, q AS part FROM fl WHERE len(q) >= 4
  UNION ALL SELECT id, 14 + len(q), substr(q, 1, 10) FROM fl WHERE len(q) >= 4 AND 2.0::DOUBLE * least(10, len(q)) / (len(q) + least(10, len(q))) >= 0.9),
wd AS (SELECT id, unnest(regexp_extract_all(part, '{WORD_PIECES}')) AS word FROM sp)
SELECT id, span_start, span_start + len(part) AS span_end, (SELECT count(*) FROM wd WHERE wd.id = sp.id AND word IN {WORDS}) AS n_protected FROM sp""")
def echo_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Protected span of answers that quote their question, and the words of obligation inside it."""
    pairs = quoting_answers(answers(spark, sf))
    spans = pairs.select("id", evidence.echo_spans("text", "question").alias("spans"))
    found = evidence.anchors(pairs, ["id"], "text", PROSE_MODALS.pattern)
    free = evidence.outside_spans(found, spans, "id").groupBy("id").agg(F.count("*").alias("n_free"))
    total = found.groupBy("id").agg(F.count("*").alias("n_all"))
    flat = spans.select("id", F.inline("spans")).select("id", F.col("start").alias("span_start"), F.col("end").alias("span_end"))
    return flat.join(total, "id", "left").join(free, "id", "left").select(
        "id", "span_start", "span_end",
        (F.coalesce("n_all", F.lit(0)) - F.coalesce("n_free", F.lit(0))).alias("n_protected"),
    )


REFERRED = """
rf AS (SELECT conv_id, turn, text || ' [' || turn || '] [0] [' || (conv_id % 9) || '][120] [07]' AS text FROM conversations WHERE role = 'assistant')"""


@query("dangling_refs", rf"""
WITH {REFERRED},
n AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '\[([0-9]{{1,2}})\]', 1), lambda x: CAST(x AS INTEGER)) AS refs FROM rf)
SELECT conv_id, turn, len(refs) AS n_refs, len(list_filter(refs, lambda x: x < 1 OR x > 5)) AS n_dangling FROM n""")
def dangling_refs(spark: SparkSession, sf: str) -> DataFrame:
    """References in answers (made from turn and conversation numbers) that point past five evidence entries."""
    turns = spread(read_table(spark, sf, "conversations"), "conv_id", "turn").filter(F.col("role") == "assistant")
    text = F.concat(
        F.col("text"), F.lit(" ["), F.col("turn").cast("string"), F.lit("] [0] ["), (F.col("conv_id") % 9).cast("string"), F.lit("][120] [07]")
    )
    return turns.select("conv_id", "turn", text.alias("text")).select(
        "conv_id", "turn", F.size(evidence.references(F.col("text"))).alias("n_refs"),
        F.size(evidence.dangling(F.col("text"), F.lit(5))).alias("n_dangling"),
    )


SECTIONED = """
sx AS (SELECT doc_id, text, text || chr(10) || '## 补充说明' || chr(10) || substr(text, 1, 40) || chr(10) || chr(10) || '### Next' || chr(10) || 'kept'
  || chr(10) || chr(10) || '**备注**：' || source || chr(10) || 'gone' || chr(10) || chr(10) || 'end' || chr(10) AS answer,
  text || chr(10) || '### Next' || chr(10) || 'kept' || chr(10) || chr(10) || chr(10) || 'end' AS left_over FROM documents)"""


def sectioned(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as answers that end with a supplementary heading, a kept heading and a remark."""
    answer = F.concat(
        F.col("text"), F.lit("\n## 补充说明\n"), F.substring("text", 1, 40), F.lit("\n\n### Next\nkept\n\n**备注**："),
        F.col("source"), F.lit("\ngone\n\nend\n"),
    )
    return read_documents(spark, sf, "source", "text").select("doc_id", answer.alias("answer"))


@query("strip_sections", rf"""
WITH {SECTIONED},
cl AS (SELECT doc_id, answer, regexp_replace(regexp_replace(left_over, '\n{{3,}}', chr(10) || chr(10), 'g'), '^{BLANK}+|{BLANK}+$', '', 'g') AS t FROM sx)
SELECT doc_id, md5(t) AS digest, len(answer) - len(t) AS removed FROM cl""")
def strip_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Answers without supplementary sections."""
    done = sectioned(spark, sf).select("doc_id", F.inline(F.array(evidence.strip_sections(F.col("answer")))))
    return done.select("doc_id", F.md5("text").alias("digest"), "removed")


@query("detect_sections", rf"""
WITH {SECTIONED}
SELECT doc_id, 'heading' AS label, substr(replace(regexp_extract(answer, '(?s)\n## 补充说明\n.*\n### Next'), chr(10), ' '), 1,
  least(60, len(regexp_extract(answer, '(?s)\n## 补充说明\n.*\n### Next')) - 9)) AS preview FROM sx
UNION ALL SELECT doc_id, 'bold_label', ' **备注**：' || replace(regexp_extract(answer, '(?s)备注\*\*：(.*)\n\nend', 1), chr(10), ' ') FROM sx""")
def detect_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Supplementary sections with a preview."""
    return sectioned(spark, sf).select("doc_id", F.inline(evidence.detect_sections(F.col("answer"))))


RAW_VERDICT = """
rv AS (SELECT event_id, k, CASE k % 6 WHEN 0 THEN 'see ' || props || ' end' WHEN 1 THEN '{"grounded": false, "issues": []}'
  WHEN 2 THEN 'x {"grounded": true, "issues": [" k' || k || ' ", "", 7, null, ["n"]]} y' WHEN 3 THEN 'no verdict' WHEN 4 THEN '{broken ' || k || '}'
  ELSE '{"grounded": 0, "issues": "none"}' END AS raw FROM (SELECT event_id, props, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events))"""


@query("verdict_parse", f"""
WITH {RAW_VERDICT}
SELECT event_id, CASE k % 6 WHEN 1 THEN false WHEN 2 THEN false WHEN 5 THEN false ELSE true END AS grounded, k % 6 NOT IN (3, 4) AS verified,
  CASE WHEN k % 6 = 2 THEN 'k' || k || '|7' ELSE '' END AS issues FROM rv""")
def verdict_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts read from checker outputs of many shapes, built from the event properties."""
    k = F.get_json_object("props", "$.k").cast("int")
    events = spread(read_table(spark, sf, "events", "event_id", "props"), "event_id").withColumn("k", k)
    raw = (
        F.when(F.col("k") % 6 == 0, F.concat(F.lit("see "), F.col("props"), F.lit(" end")))
        .when(F.col("k") % 6 == 1, '{"grounded": false, "issues": []}')
        .when(F.col("k") % 6 == 2, F.concat(F.lit('x {"grounded": true, "issues": [" k'), F.col("k").cast("string"), F.lit(' ", "", 7, null, ["n"]]} y')))
        .when(F.col("k") % 6 == 3, "no verdict")
        .when(F.col("k") % 6 == 4, F.concat(F.lit("{broken "), F.col("k").cast("string"), F.lit("}")))
        .otherwise('{"grounded": 0, "issues": "none"}')
    )
    parsed = events.select("event_id", raw.alias("raw")).select("event_id", F.inline(F.array(evidence.parse_verdict(F.col("raw")))))
    return parsed.select("event_id", "grounded", "verified", F.array_join("issues", "|").alias("issues"))


@query("budget_rule", """
SELECT event_type, count(*) AS n, count(*) FILTER (value * 100 < 12000) AS n_checked, count(*) FILTER (value * 100 >= 12000) AS n_skipped FROM events GROUP BY 1""")
def budget_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Answers checked and skipped by time used (event value in tenths of a second) and type."""
    ok = evidence.may_verify(F.col("value") * 100)
    return read_table(spark, sf, "events", "event_type", "value").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_checked"), F.count_if(~ok).alias("n_skipped")
    )


@query("answer_audit", rf"""
WITH {PAIRS}, {MODAL_ANCHORS}, {_match_sql('aa', 'sa')},
cc AS (SELECT id, count(*) AS n FROM ch GROUP BY 1)
SELECT qa.id, 2 AS n_citations, CASE WHEN id % 10 > 5 OR id % 10 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 4 + 3 > 5 THEN 1 ELSE 0 END AS dangling_count, 5 AS n_evidence,
  coalesce(cc.n, 0) AS modal_corrections, coalesce(cc.n, 0) > 0 AS post_filter_applied FROM qa LEFT JOIN cc USING (id)""")
def answer_audit(spark: SparkSession, sf: str) -> DataFrame:
    """One row per answer with the counts of all checks."""
    pairs = answers(spark, sf)
    marked = F.concat(
        F.col("text"), F.lit(" ["), (F.col("id") % 10).cast("string"), F.lit("] ["), (F.col("id") % 4 + 3).cast("string"), F.lit("]")
    )
    changes = modal_changes(pairs).groupBy("id").agg(F.count("*").alias("n"))
    refs = pairs.select(
        "id", F.size(evidence.references(marked)).alias("n_citations"),
        F.size(evidence.dangling(marked, F.lit(5))).alias("dangling_count"), F.lit(5).alias("n_evidence"),
    )
    return refs.join(changes, "id", "left").select(
        "id", "n_citations", "dangling_count", "n_evidence", F.coalesce("n", F.lit(0)).alias("modal_corrections"),
        (F.coalesce("n", F.lit(0)) > 0).alias("post_filter_applied"),
    )
