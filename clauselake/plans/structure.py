"""Document structuring over the documents table, with the prose profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.functions.text import WIDE_DIGITS
from clauselake.operators import chunking
from clauselake.operators.scale import carry_forward, number_rows
from clauselake.plans.registry import query
from clauselake.plans.sql import BLANK
from clauselake.profiles import PROSE
from clauselake.sources.tables import keep, read_documents, read_table, spread

P = PROSE


def _kinds_sql(name: str, article: bool) -> str:
    """CTEs up to {name}(doc_id, line_no, page, text, bold, size, in_appendix, kind, label)."""
    if article:
        tail = f"""
    WHEN regexp_matches(text, '{P.chapter_article}') AND len(text) <= 30 THEN 'chapter'
    WHEN regexp_matches(text, '{P.clause_article}') THEN 'clause'"""
        label = f"'<' || regexp_extract(text, '{P.clause_article}', 1) || '>'"
    else:
        tail = f"""
    WHEN regexp_matches(text, '{P.clause_4}') OR regexp_matches(text, '{P.clause_3}') THEN 'clause'
    WHEN in_appendix AND regexp_matches(text, '{P.clause_appendix}') THEN 'clause'
    WHEN regexp_matches(text, '{P.section}') AND ((size >= 12.5 AND len(text) <= 30) OR bold) THEN 'section'
    WHEN regexp_matches(text, '{P.chapter}') AND NOT regexp_matches(text, '{P.section}') AND size >= 14
      AND len(text) BETWEEN 4 AND 25 AND len(regexp_extract_all(text, '{P.heading_char}')) >= 2 THEN 'chapter'"""
        label = f"""CASE WHEN regexp_matches(text, '{P.clause_4}') THEN regexp_extract(text, '{P.clause_4}', 1)
    WHEN regexp_matches(text, '{P.clause_3}') THEN regexp_extract(text, '{P.clause_3}', 1)
    ELSE regexp_extract(text, '{P.clause_appendix}', 1) END"""
    opened = "false" if article else f"regexp_matches(text, '{P.appendix_start}') AND size >= 14 AND len(text) <= 30"
    return rf"""
{name}_o AS (SELECT *, {opened} AS opens FROM lines),
{name}_a AS (SELECT *, coalesce(bool_or(opens) OVER (PARTITION BY doc_id ORDER BY line_no
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS in_appendix FROM {name}_o),
{name}_k AS (SELECT *, CASE WHEN opens AND NOT in_appendix THEN 'appendix'
    WHEN regexp_matches(text, '{P.table_head}') THEN 'table'
    WHEN regexp_matches(text, '{P.formula_head}') THEN 'formula'{tail} ELSE 'body' END AS kind FROM {name}_a),
{name} AS (SELECT * EXCLUDE (opens), CASE WHEN kind = 'clause' THEN {label}
    WHEN kind = 'table' THEN 'T:' || regexp_extract(text, '{P.table_head}', 1)
    WHEN kind = 'formula' THEN 'F:' || regexp_extract(text, '{P.formula_head}', 1)
    WHEN kind <> 'body' THEN text END AS label FROM {name}_k)"""


LINES = rf"""
raw_lines AS (SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no,
  unnest(string_split(text, chr(10))) AS raw FROM documents),
trimmed AS (SELECT doc_id, line_no, regexp_replace(raw, '^{BLANK}+|{BLANK}+$', '', 'g') AS text FROM raw_lines),
lines AS (SELECT doc_id, line_no // 40 + 1 AS page, line_no, text, len(text) % 7 = 0 AS bold,
  CASE WHEN len(text) <= 30 THEN 16.0 ELSE 10.0 END AS size FROM trimmed WHERE text <> '')"""


def _mandatory(text: str) -> str:
    return f"regexp_matches(lower(substr({text}, 1, 80)), '{P.mandatory}')"


def _segments_sql(name: str, kinds: str) -> str:
    """CTEs up to {name}(doc_id, seg, chapter, section, clause, type, text, page_start, page_end, is_mandatory)."""
    return rf"""
{name}_c AS (SELECT *, sum(CASE WHEN kind <> 'body' THEN 1 ELSE 0 END) OVER w AS seg,
    last_value(CASE WHEN kind IN ('chapter', 'appendix') THEN label END IGNORE NULLS) OVER w AS chapter,
    last_value(CASE WHEN kind IN ('section', 'chapter', 'appendix')
      THEN CASE WHEN kind = 'section' THEN label ELSE '' END END IGNORE NULLS) OVER w AS section0,
    last_value(CASE WHEN kind <> 'body' THEN {{'kind': kind, 'label': label, 'app': in_appendix, 'bold': bold, 'text': text}} END
      IGNORE NULLS) OVER w AS opener
  FROM {kinds} WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{name}_g AS (SELECT doc_id, CAST(seg AS BIGINT) AS seg, any_value(chapter) AS chapter, nullif(any_value(section0), '') AS section,
    any_value(opener) AS opener,
    CASE WHEN any_value(opener.kind) <> 'clause' THEN any_value(opener.kind)
         WHEN any_value(opener.app) THEN 'appendix' ELSE 'clause' END AS type,
    regexp_replace(string_agg(text, chr(10) ORDER BY line_no), '^{BLANK}+|{BLANK}+$', '', 'g') AS text,
    min(page) AS page_start, max(page) AS page_end, bool_or(kind = 'body' AND bold) AS bold_body
  FROM {name}_c WHERE opener.kind IN ('clause', 'table', 'formula') GROUP BY doc_id, seg),
{name} AS (SELECT doc_id, seg, chapter, section, opener.label AS clause, type, text, page_start, page_end,
    (opener.kind = 'clause' AND (opener.bold OR {_mandatory("opener.text")})) OR (type = 'clause' AND bold_body)
      OR (type IN ('clause', 'appendix') AND {_mandatory("text")}) AS is_mandatory
  FROM {name}_g WHERE len(text) >= 3)"""


def _split_sql(name: str, segments: str) -> str:
    """CTEs up to {name}: as segments, with piece, clause suffix and char_count."""
    return rf"""
{name}_p AS (SELECT * EXCLUDE (text), text, type IN ('clause', 'appendix') AND len(text) > 800 AS long,
   list_transform(list_filter(list_transform(string_split(text, chr(10)),
     lambda x: regexp_replace(x, '^{BLANK}+|{BLANK}+$', '', 'g')), lambda x: x <> ''),
     lambda x: {{'done': []::VARCHAR[], 'cur': x, 'n': len(x)}}) AS paras FROM {segments}),
{name}_r AS (SELECT * EXCLUDE (paras), CASE WHEN long THEN list_reduce(paras, lambda a, b:
   CASE WHEN a.n + b.n > 800 THEN {{'done': list_append(a.done, a.cur), 'cur': b.cur, 'n': b.n}}
        ELSE {{'done': a.done, 'cur': a.cur || chr(10) || b.cur, 'n': a.n + b.n}} END) END AS st FROM {name}_p),
{name}_l AS (SELECT * EXCLUDE (st, text, clause), clause AS clause0, CASE WHEN long THEN list_append(st.done, st.cur) ELSE [text] END AS pieces FROM {name}_r),
{name}_u AS (SELECT * EXCLUDE (pieces), unnest(generate_series(1, len(pieces))) AS piece, unnest(pieces) AS text FROM {name}_l),
{name} AS (SELECT * EXCLUDE (clause0, long), CASE WHEN long THEN clause0 || '-' || piece ELSE clause0 END AS clause, len(text) AS char_count FROM {name}_u)"""


def _numbered_sql(name: str, pieces: str) -> str:
    return f"""
{name}_b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seg, piece) AS seq,
   row_number() OVER (PARTITION BY doc_id, clause ORDER BY seg, piece) - 1 AS n FROM {pieces}),
{name} AS (SELECT * EXCLUDE (n), 'doc' || doc_id || '#' || clause || CASE WHEN n > 0 THEN '_d' || n ELSE '' END AS chunk_id FROM {name}_b)"""


def _merged_sql(name: str, numbered: str) -> str:
    return f"""
{name}_x AS (SELECT *, lead(type) OVER w AS nt, lead(section) OVER w AS ns, lead(clause) OVER w AS nc, lead(text) OVER w AS nx,
   lead(chapter) OVER w AS nch, lead(is_mandatory) OVER w AS nm, lead(char_count) OVER w AS nn, lead(page_end) OVER w AS np
   FROM {numbered} WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
{name}_y AS (SELECT *, type = 'clause' AND char_count < 50 AND coalesce(nt = 'clause', false)
   AND section IS NOT DISTINCT FROM ns AS glue FROM {name}_x),
{name}_z AS (SELECT *, glue AND (seq - coalesce(last_value(CASE WHEN NOT glue THEN seq END IGNORE NULLS) OVER (PARTITION BY doc_id
   ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)) % 2 = 1 AS start FROM {name}_y),
{name}_w AS (SELECT *, coalesce(lag(start) OVER (PARTITION BY doc_id ORDER BY seq), false) AS gone FROM {name}_z),
{name} AS (SELECT doc_id, chunk_id, seq, CASE WHEN start THEN nch ELSE chapter END AS chapter, section, type,
   CASE WHEN start THEN clause || '+' || nc ELSE clause END AS clause,
   CASE WHEN start THEN text || chr(10) || nx ELSE text END AS text,
   CASE WHEN start THEN is_mandatory OR nm ELSE is_mandatory END AS is_mandatory,
   CASE WHEN start THEN char_count + nn + 1 ELSE char_count END AS char_count,
   page_start, CASE WHEN start THEN np ELSE page_end END AS page_end
   FROM {name}_w WHERE NOT gone)"""


DECIMAL = LINES + "," + _kinds_sql("kd", False)
ARTICLE = _kinds_sql("ka", True)
SEGS = DECIMAL + "," + _segments_sql("sd", "kd")
PIECES = SEGS + "," + _split_sql("pd", "sd")
NUMBERED = PIECES + "," + _numbered_sql("nd", "pd")
MERGED = NUMBERED + "," + _merged_sql("md", "nd")
BOTH = ",".join(
    [MERGED, ARTICLE, _segments_sql("sa", "ka"), _split_sql("pa", "sa"), _numbered_sql("na", "pa"), _merged_sql("ma", "na")]
)


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line table of the documents; the texts are exchanged once, before they are cut into lines."""
    return chunking.lines_of(read_documents(spark, sf, "text"), P)


def code() -> F.Column:
    """Document code used in chunk ids."""
    return F.concat(F.lit("doc"), F.col("doc_id").cast("string"))


@query("line_kinds", f"WITH {DECIMAL} SELECT doc_id, line_no, page, kind, coalesce(label, '') AS label, in_appendix FROM kd")
def line_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Kind and label of every line."""
    kinds = chunking.line_kinds(doc_lines(spark, sf), P)
    return kinds.select(
        "doc_id", "line_no", "page", "kind", F.coalesce("label", F.lit("")).alias("label"), "in_appendix"
    )


STANDARD_LINES = """
sl AS (SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no,
  unnest(string_split(text, chr(10))) AS raw FROM documents),
sk AS (SELECT doc_id, line_no, line_no % 7 AS cat, doc_id % 9 + 1 AS a, line_no % 90 + 1 AS b,
  min(CASE WHEN line_no % 7 = 5 THEN line_no END) OVER (PARTITION BY doc_id) AS first_app FROM sl)"""


@query("line_kinds_standard", f"""
WITH {STANDARD_LINES}
SELECT doc_id, line_no, CASE WHEN cat = 0 THEN 'chapter' WHEN cat = 1 THEN 'section' WHEN cat = 2 THEN 'clause' WHEN cat = 3 THEN 'table'
    WHEN cat = 4 THEN 'formula' WHEN cat = 5 AND line_no = first_app THEN 'appendix' ELSE 'body' END AS kind,
  CASE WHEN cat = 2 THEN a || '.' || b || '.' || (b + 1) WHEN cat = 3 THEN '表' || a || '.' || b WHEN cat = 4 THEN '式' || a || '.' || b ELSE '' END AS label
FROM sk""")
def line_kinds_standard(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of the lines of the documents, each written as a heading, clause, table or text of a standard.

    Blanks are ideographic or typographic ones and digits partly full-width, as scanned standards have them.
    """
    docs = read_documents(spark, sf, "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    a, b, c = ((n.cast("string")) for n in (F.col("doc_id") % 9 + 1, F.col("line_no") % 90 + 1, F.col("line_no") % 90 + 2))

    def wide(digits):
        return F.translate(digits, "0123456789", WIDE_DIGITS)

    cat = F.col("line_no") % 7
    text = (
        F.when(cat == 0, F.concat(wide(a), F.lit("　总则内容")))
        .when(cat == 1, F.concat(a, F.lit("."), wide(b), F.lit("\u2003一般规定")))
        .when(cat == 2, F.concat(F.lit("　"), wide(a), F.lit("."), b, F.lit("."), wide(c), F.lit("　应符合规定")))
        .when(cat == 3, F.concat(F.lit("表　"), a, F.lit("."), wide(b), F.lit("　服务半径")))
        .when(cat == 4, F.concat(F.lit("式\u2002（"), a, F.lit("."), b, F.lit("）")))
        .when(cat == 5, F.lit("附　录　Ａ　说明")).otherwise(F.lit("正文内容，没有编号"))
    )
    rebuilt = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", text.alias("t")))).alias("ls")).select(
        "doc_id", F.array_join(F.transform("ls", lambda x: x["t"]), "\n").alias("text"))
    kinds = chunking.line_kinds(chunking.lines_of(rebuilt))
    shown = F.when(F.col("kind").isin("clause", "table", "formula"), F.col("label")).otherwise("")
    return kinds.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "kind", shown.alias("label"))


@query("carry_forward", """
SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (
  PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS last_signup FROM events""")
def last_signup(spark: SparkSession, sf: str) -> DataFrame:
    """Latest signup of the user at each event; busy users are worked on minute by minute."""
    events = read_table(spark, sf, "events", "event_id", "user_id", "ts", "event_type").withColumn(
        "signup", F.when(F.col("event_type") == "signup", F.col("event_id"))
    )
    out = carry_forward(
        events, ["user_id"], ["ts", "event_id"], F.date_trunc("minute", "ts"), "signup", "last_signup"
    )
    return out.select("event_id", "user_id", F.coalesce("last_signup", F.lit(-1)).alias("last_signup"))


SEG_COLUMNS = "doc_id, seg, coalesce(chapter, '') AS chapter, coalesce(section, '') AS section, clause, type, text, page_start, page_end, is_mandatory"


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(
        *[F.coalesce(c, F.lit("")).alias(c) if c in ("chapter", "section") else F.col(c) for c in columns]
    )


@query("assemble_segments", f"WITH {SEGS} SELECT {SEG_COLUMNS} FROM sd")
def assemble_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of the documents with structure, text and mandatory flag."""
    segs = chunking.assemble(chunking.carry_structure(chunking.line_kinds(doc_lines(spark, sf), P)), P)
    return _shown(
        segs, "doc_id", "seg", "chapter", "section", "clause", "type", "text", "page_start", "page_end", "is_mandatory"
    )


def pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Segments after cutting long ones."""
    segs = chunking.assemble(chunking.carry_structure(chunking.line_kinds(doc_lines(spark, sf), P)), P)
    return chunking.split_long(segs, P)


@query("split_long", f"WITH {PIECES} SELECT doc_id, seg, piece, clause, type, text, char_count FROM pd")
def split_long(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of the segments, long ones cut by paragraph."""
    return pieces(spark, sf).select("doc_id", "seg", "piece", "clause", "type", "text", "char_count")


@query("split_documents", rf"""
WITH sd AS (SELECT doc_id, doc_id AS seg, NULL AS chapter, NULL AS section, 'whole' AS clause, 'clause' AS type, text, 1 AS page_start,
  1 AS page_end, false AS is_mandatory FROM documents), {_split_sql("pd", "sd")}
SELECT doc_id, piece, clause, text, char_count FROM pd""")
def split_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every document packed into pieces by paragraph, as one long clause."""
    docs = read_documents(spark, sf, "text").select("doc_id", F.lit("whole").alias("clause"), F.lit("clause").alias("type"), "text")
    return chunking.split_long(docs, P).select("doc_id", "piece", "clause", "text", "char_count")


@query("dup_suffix", f"WITH {NUMBERED} SELECT doc_id, seq, chunk_id FROM nd")
def dup_suffix(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk ids with repeat numbers."""
    return chunking.number_copies(pieces(spark, sf), code()).select("doc_id", "seq", "chunk_id")


@query("copy_numbers", """
SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) - 1 AS copy_no FROM documents""")
def copy_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Number of each document among the exact copies of its text, however many there are."""
    docs = read_documents(spark, sf, "text").select("doc_id", F.md5("text").alias("digest"))
    return number_rows(docs, ["digest"], "doc_id", "n").select("doc_id", (F.col("n") - 1).alias("copy_no"))


@query("merge_short", f"""WITH {MERGED} SELECT doc_id, chunk_id, coalesce(chapter, '') AS chapter, coalesce(section, '') AS section, clause, type, text, is_mandatory,
  char_count, page_start, page_end FROM md""")
def merge_short(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks after gluing short clauses to the next one."""
    chunks = chunking.chunk_lines(doc_lines(spark, sf), code(), P)
    return _shown(
        chunks, "doc_id", "chunk_id", "chapter", "section", "clause", "type", "text", "is_mandatory", "char_count", "page_start",
        "page_end",
    )


@query("mandatory_flag", f"""
WITH {LINES} SELECT doc_id, count(*) AS n_lines, count(*) FILTER ({_mandatory("text")}) AS n_mandatory,
  count(*) FILTER (bold) AS n_bold, count(*) FILTER (bold OR {_mandatory("text")}) AS n_flagged FROM lines GROUP BY 1""")
def mandatory_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Lines per document with a word of obligation near their start, or in bold."""
    flag = chunking.has_mandatory(F.col("text"), P)
    return doc_lines(spark, sf).groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count_if(flag).alias("n_mandatory"), F.count_if("bold").alias("n_bold"),
        F.count_if(F.col("bold") | flag).alias("n_flagged"),
    )


@query("mode_choice", f"""
WITH {BOTH},
n AS (SELECT doc_id, (SELECT count(*) FROM md WHERE md.doc_id = d.doc_id) AS nd, (SELECT count(*) FROM ma WHERE ma.doc_id = d.doc_id) AS na
      FROM documents d)
SELECT doc_id, CASE WHEN nd < 10 AND na > nd THEN 'article' ELSE 'decimal' END AS mode,
  CASE WHEN nd < 10 AND na > nd THEN na ELSE nd END AS n_chunks FROM n WHERE greatest(nd, na) > 0 AND NOT (nd = 0 AND NOT (na > nd))""")
def mode_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Reading mode and chunk count per document."""
    chunks = chunking.chunk_documents(doc_lines(spark, sf), code(), P, keep(spark))
    return chunks.groupBy("doc_id", "mode").agg(F.count("*").alias("n_chunks"))


@query("doc_stats", """
SELECT source, count(*) AS chunks_total, count(*) FILTER (lang = 'en') AS n_en, count(*) FILTER (lang = 'fr') AS n_fr,
  count(*) FILTER (lang = 'de') AS n_de, count(*) FILTER (lang = 'es') AS n_es, min(len(text)) AS char_min, max(len(text)) AS char_max,
  round(avg(len(text)), 1) AS char_avg, count(*) FILTER (text LIKE '%|%') AS mandatory_count FROM documents GROUP BY 1""")
def doc_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Per source: count, counts by language, shortest, longest and mean text, texts holding a bar."""
    docs = read_documents(spark, sf, "source", "lang", "text").select(
        "source", "lang", F.length("text").alias("n"), F.contains("text", F.lit("|")).alias("bar")
    )
    stats = chunking.chunk_stats(docs, ["source"], "lang", "n", "bar")
    langs = [F.coalesce(F.try_element_at("by_type", F.lit(x)), F.lit(0)).alias(f"n_{x}") for x in ("en", "fr", "de", "es")]
    return stats.select("source", "chunks_total", *langs, "char_min", "char_max", "char_avg", "mandatory_count")


@query("corpus_report", """
WITH per AS (SELECT source, lang, count(*) AS n, sum(n_chars) AS chars, max(n_chars) AS hi, min(n_chars) AS lo,
   count(*) FILTER (n_chars < 50) AS n_empty FROM documents GROUP BY 1, 2)
SELECT lang, CAST(sum(n) AS BIGINT) AS n_docs, count(DISTINCT source) AS n_sources, round(sum(n) / (SELECT sum(n) FROM per), 6) AS share,
  round(sum(chars) / sum(n), 1) AS mean_chars, arg_max(source, {'hi': hi, 's': source}) AS longest_in, arg_min(source, {'lo': lo, 's': source}) AS shortest_in,
  CAST(sum(n_empty) AS BIGINT) AS n_empty, CAST(sum(n) - sum(n_empty) AS BIGINT) AS n_succeeded FROM per GROUP BY 1""")
def corpus_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per language: documents, share of all, mean length, source of the longest and shortest text, near-empty ones."""
    per = read_table(spark, sf, "documents", "source", "lang", "n_chars").groupBy("source", "lang").agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("hi"),
        F.min("n_chars").alias("lo"), F.count_if(F.col("n_chars") < 50).alias("n_empty"),
    )
    total = per.agg(F.sum("n")).scalar()
    return per.groupBy("lang").agg(
        F.sum("n").alias("n_docs"), F.countDistinct("source").alias("n_sources"),
        F.round(F.sum("n") / total, 6).alias("share"), F.round(F.sum("chars") / F.sum("n"), 1).alias("mean_chars"),
        F.max_by("source", F.struct("hi", "source")).alias("longest_in"),
        F.min_by("source", F.struct("lo", "source")).alias("shortest_in"), F.sum("n_empty").alias("n_empty"),
        (F.sum("n") - F.sum("n_empty")).alias("n_succeeded"),
    )


@query("parse_title", r"""
WITH t AS (SELECT p_partkey, p_brand, 'GB:T' || CAST(50000 + p_partkey AS VARCHAR) || '—20' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS code, p_name, p_size FROM part),
f AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_name ELSE code || ' 《' || p_name || '》.pdf' END AS file_name, code, p_name, p_size FROM t)
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN p_size % 5 = 0 THEN '' ELSE replace(replace(code, 'GB:T', 'GB/T '), '—', '-') END AS code,
  CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END AS name FROM f""")
def parse_title(spark: SparkSession, sf: str) -> DataFrame:
    """Code and title read from file names built from the parts; names of another shape become error rows."""
    size = F.lpad(F.col("p_size").cast("string"), 2, "0")
    raw = F.concat(F.lit("GB:T"), (F.col("p_partkey") + 50000).cast("string"), F.lit("—20"), size)
    name = F.when(F.col("p_size") % 5 == 0, F.col("p_name")).otherwise(
        F.concat(raw, F.lit(" 《"), F.col("p_name"), F.lit("》.pdf"))
    )
    parts = spread(read_table(spark, sf, "part", "p_partkey", "p_name", "p_size"), "p_partkey")
    parsed = parts.select("p_partkey", chunking.parse_title(name).alias("t"))
    return parsed.select(
        "p_partkey", F.when(F.col("t")["code"].isNull(), "error").otherwise("ok").alias("status"),
        F.coalesce(F.col("t")["code"], F.lit("")).alias("code"), F.coalesce(F.col("t")["name"], F.lit("")).alias("name"),
    )
