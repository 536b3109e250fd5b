"""SQL fragments shared by the checks: each is a list of CTEs without WITH and without trailing comma."""

WORD = r"[\p{L}\p{N}]+"
BLANK = (r"[ \t\n\r\f\x0b\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
         r"\x{3000}]")

CJK = r"\x{4e00}-\x{9fff}"


def words(expr: str) -> str:
    """List of the words of a text."""
    return f"regexp_extract_all(lower({expr}), '{WORD}')"


def cjk_words(expr: str) -> str:
    """List of the words of a text, runs of ideographs as overlapping pairs.

    Marks around each run of ideographs make the other words end there, as this pattern language has no difference of classes.
    """
    marked = f"regexp_replace(lower({expr}), '([{CJK}]+)', chr(1) || '\\1' || chr(1), 'g')"
    runs = f"regexp_extract_all({marked}, '{WORD}')"
    pairs = "list_transform(range(1, len(r)), lambda i: substr(r, i, 2))"
    return (f"flatten(list_transform({runs}, lambda r: CASE WHEN regexp_full_match(r, '[{CJK}]{{2,}}') THEN {pairs} ELSE [r] END))")


def doc_terms(tok=words, docs: str = "documents") -> str:
    """CTEs post, dstat, dnorm, corpus and idf over the texts of a table."""
    return f"""
dtok AS (SELECT doc_id, unnest({tok('text')}) AS term FROM {docs}),
post AS (SELECT doc_id, term, count(*) AS tf FROM dtok GROUP BY 1, 2),
dstat AS (SELECT doc_id, len({tok('text')}) AS dl FROM {docs}),
dnorm AS (SELECT doc_id, sqrt(sum(tf * tf)) AS norm FROM post GROUP BY 1),
corpus AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dstat),
traw AS (SELECT term, count(*) AS df, ln((SELECT n_docs FROM corpus) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw
         FROM post GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM traw) ELSE raw END AS idf FROM traw)
"""


DOC_TERMS = doc_terms()


def scores(queries_cte: str, keys: str = "query_id", tok=words) -> str:
    """CTE qscore(keys, doc_id, bm25, cosine) over a CTE or table with keys and text; sums go by term."""
    on = " AND ".join(f"n.{k} = q.{k}" for k in keys.split(", "))
    qkeys = ", ".join(f"q.{k}" for k in keys.split(", "))
    return f"""
qtok AS (SELECT {keys}, unnest({tok('text')}) AS term FROM {queries_cte}),
qtf AS (SELECT {keys}, term, count(*) AS qtf FROM qtok GROUP BY ALL),
qnorm AS (SELECT {keys}, sqrt(sum(qtf * qtf)) AS qnorm FROM qtf GROUP BY ALL),
qscore AS (
  SELECT {qkeys}, p.doc_id,
         sum(q.qtf * i.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * d.dl / (SELECT avgdl FROM corpus))) ORDER BY q.term) AS bm25,
         sum(q.qtf * p.tf / (n.qnorm * m.norm) ORDER BY q.term) AS cosine
  FROM qtf q JOIN post p USING (term) JOIN idf i USING (term) JOIN dstat d ON d.doc_id = p.doc_id
  JOIN dnorm m ON m.doc_id = p.doc_id JOIN qnorm n ON {on}
  GROUP BY ALL)
"""


BENCH = "bq AS (SELECT item_id AS query_id, text FROM benchmark)"


def top(cte: str, source: str, score: str, k: int, keys: str = "query_id") -> str:
    """CTE with the best k rows per key: keys, doc_id, score (not rounded), rank."""
    return f"""
{cte} AS (SELECT * FROM (SELECT {keys}, doc_id, {score} AS score,
  row_number() OVER (PARTITION BY {keys} ORDER BY {score} DESC, doc_id) AS rank
  FROM {source} WHERE {score} > 0) WHERE rank <= {k})"""


PREFIX_KEY = f"substr(regexp_replace(text, '{BLANK}', '', 'g'), 1, 200)"


def overlap(query: str, text: str, tok=words) -> str:
    """Expression: share of the distinct query words present in the text."""
    q, t = f"list_distinct({tok(query)})", f"list_distinct({tok(text)})"
    return f"(CASE WHEN len({q}) > 0 THEN len(list_intersect({q}, {t})) / len({q}) ELSE 0 END)"


RRF = "sum(1.0::DOUBLE / (60 + rank) ORDER BY path)"
