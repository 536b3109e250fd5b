"""Checks of answers against their evidence: sections, modal words, numbers, references, verdicts."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauselake import profiles as P
from clauselake.functions.text import strip
from clauselake.operators.scale import keep_first

# fixed values: context of a word, agreement needed, similarity of a quoted question, time left for checking
CONTEXT = 8
MIN_MATCH = 5
ECHO_RATIO = 0.90
VERIFY_BUDGET_MS = 12_000

# fixed values: supplementary sections, heading, bold label and inline note; (?d) makes \n the only line end
SUPPLEMENTS = [
    (
        "heading",
        r"(?md)(?:^|\n)#{2,4}\s*(?:补充说明|另注|备注|附注|说明（[^）]*）|关于[^\n]{0,20}的?补充)[^\n]*"
        r"(?:\n(?!#{2,4}\s).*+)*+",
    ),
    (
        "bold_label",
        r"(?md)(?:^|\n)\*\*(?:补充说明|另注|备注|附注|关于[^*]{0,20}的?补充|本助手补充)[^*]*\*\*\s*[：:]?\s*"
        r"[^\n]*(?:\n(?!\n)(?!\*\*)[^\n]*+)*+",
    ),
    ("inline_note", r"(?md)(?:^|\n)\*\*(?:另注|附注)\*\*\s*[：:]\s*[^\n]*(?:\n(?!\n)(?!\*\*)[^\n]*+)*+"),
]
QUOTED = r'[“"「『]([^”"」』\n]{4,})[”"」』]'
MARK = ""


def strip_sections(text: Column) -> Column:
    """struct(text, removed): answer without supplementary sections, and how many characters went."""
    out = text
    for _, pattern in SUPPLEMENTS:
        out = F.regexp_replace(out, pattern, "")
    out = strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))
    return F.struct(out.alias("text"), (F.length(text) - F.length(out)).alias("removed"))


def detect_sections(text: Column) -> Column:
    """array<struct<label,preview>> of supplementary sections, 60 characters each on one line."""
    def shown(label: str) -> Callable[[Column], Column]:
        return lambda m: F.struct(
            F.lit(label).alias("label"), F.replace(F.substring(m, 1, 60), F.lit("\n"), F.lit(" ")).alias("preview")
        )

    found = [
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), shown(label)) for label, pattern in SUPPLEMENTS
    ]
    return F.concat(*found)


def anchors(df: DataFrame, keys: list[str], text: str, pattern: str, context: int = CONTEXT) -> DataFrame:
    """(keys, no, pos, prefix, word, suffix) of every match, pos counted from 0.

    Matches are marked and the text is split at the marks: pieces alternate between plain text and match, so the
    context is cut from a few neighbouring pieces and only anchor rows, not texts, are exchanged to sum up the
    positions.
    """
    safe = F.translate(F.coalesce(F.col(text), F.lit("")), MARK, " ")
    marked = F.regexp_replace(safe, f"({pattern})", f"{MARK}$1{MARK}")
    pieces = df.select(*keys, F.split(marked, MARK, -1).alias("_p"))
    reach = 2 * context + 1

    def anchor(j: Column) -> Column:
        start = F.greatest(F.lit(1), j - reach + 1)
        return F.struct(
            j.alias("no"), F.length(F.get("_p", j - 1)).alias("gap"), F.length(F.get("_p", j)).alias("len"),
            F.right(F.array_join(F.slice("_p", start, j - start + 1), ""), F.lit(context)).alias("prefix"),
            strip(F.get("_p", j)).alias("word"),
            F.substring(F.array_join(F.slice("_p", j + 2, reach), ""), 1, context).alias("suffix"),
        )

    where = F.when(F.size("_p") > 2, F.sequence(F.lit(1), F.size("_p") - 2, F.lit(2)))
    rows = pieces.select(*keys, F.inline_outer(F.transform(where, anchor))).filter(F.col("no").isNotNull())
    before = Window.partitionBy(*keys).orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    pos = F.coalesce(F.sum(F.col("gap") + F.col("len")).over(before), F.lit(0)) + F.col("gap")
    return rows.select(*keys, "no", pos.cast("int").alias("pos"), "prefix", "word", "suffix")


def _common_tail(a: Column, b: Column, n: int = CONTEXT) -> Column:
    """Number of equal characters from the right, at most n."""
    shorter = F.least(F.length(a), F.length(b))
    return sum(
        (F.when((shorter >= i) & (F.right(a, F.lit(i)) == F.right(b, F.lit(i))), 1).otherwise(0) for i in range(1, n + 1)),
        F.lit(0),
    )


def _common_head(a: Column, b: Column, n: int = CONTEXT) -> Column:
    """Number of equal characters from the left, at most n."""
    shorter = F.least(F.length(a), F.length(b))
    return sum(
        (F.when((shorter >= i) & (F.substring(a, 1, i) == F.substring(b, 1, i)), 1).otherwise(0) for i in range(1, n + 1)),
        F.lit(0),
    )


def match_anchors(
    answer: DataFrame, source: DataFrame, key: str, min_match: int = MIN_MATCH, direction: str = "",
    direction_before: bool = False, skip_equal: bool = False,
) -> DataFrame:
    """(key, pos, old, new, context): answer anchors whose best evidence anchor has another word.

    answer: (key, pos, prefix, word, suffix).  source: the same with ev_no.  Two contexts agreeing in min_match
    characters share at least half of them on one side, so pairs meet on that many characters of the prefix end
    or the suffix start instead of all against all.  Most agreement wins, then evidence order.  With direction
    characters given, pairs whose neighbouring characters point in different directions are left out: the first
    of the suffix, or the last of the prefix with direction_before.
    """
    part = (min_match + 1) // 2
    a = answer.select(key, "pos", *[F.col(c).alias(f"a_{c}") for c in ("prefix", "word", "suffix")])
    s = source.select(key, "ev_no", F.col("pos").alias("s_pos"), *[F.col(c).alias(f"s_{c}") for c in ("prefix", "word", "suffix")])

    def gram(side: str) -> Column:
        return F.array(
            F.struct(F.lit("t").alias("k"), F.right(f"{side}_prefix", F.lit(part)).alias("g")),
            F.struct(F.lit("h").alias("k"), F.substring(f"{side}_suffix", 1, part).alias("g")),
        )

    pairs = a.select("*", F.inline(gram("a"))).join(s.select("*", F.inline(gram("s"))), [key, "k", "g"]).filter(
        F.length("g") == part
    )
    tail, head = _common_tail(F.col("a_prefix"), F.col("s_prefix")), _common_head(F.col("a_suffix"), F.col("s_suffix"))
    scored = pairs.withColumn("_t", tail).filter((F.col("k") == "t") | (F.col("_t") < part)).withColumn(
        "total", F.col("_t") + head
    ).filter(F.col("total") >= min_match)
    if skip_equal:
        scored = scored.filter(F.replace("a_word", F.lit(" "), F.lit("")) != F.replace("s_word", F.lit(" "), F.lit("")))
    if direction:
        one = [F.right(f"{x}_prefix", F.lit(1)) if direction_before else F.substring(f"{x}_suffix", 1, 1) for x in "as"]
        points = [(c != "") & F.contains(F.lit(direction), c) for c in one]
        scored = scored.filter(~(points[0] & points[1] & (one[0] != one[1])))
    best = keep_first(scored, [key, "pos"], [F.col("total").desc(), F.col("ev_no"), F.col("s_pos")])
    return best.filter(F.col("a_word") != F.col("s_word")).select(
        key, "pos", F.col("a_word").alias("old"), F.col("s_word").alias("new"),
        F.substring(F.concat("a_prefix", "a_word", "a_suffix"), 1, 40).alias("context"),
    )


def apply_changes(answers: DataFrame, changes: DataFrame, key: str, text: str) -> DataFrame:
    """Answers with the words replaced from right to left; n_changes is zero where nothing changed."""
    listed = changes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "old", "new")), asc=False).alias("_c"))
    joined = answers.join(listed, key, "left")

    def put(acc: Column, c: Column) -> Column:
        end = c["pos"] + F.length(c["old"])
        same = acc.substr(c["pos"] + 1, F.length(c["old"])) == c["old"]
        return F.when(
            same, F.concat(acc.substr(F.lit(1), c["pos"]), c["new"], acc.substr(end + 1, F.length(acc)))
        ).otherwise(acc)

    return joined.withColumn(
        text, F.when(F.col("_c").isNotNull(), F.aggregate("_c", F.col(text), put)).otherwise(F.col(text))
    ).withColumn("n_changes", F.coalesce(F.size("_c"), F.lit(0))).drop("_c")


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(_SPANS)
def echo_spans(answer: pd.Series, question: pd.Series) -> pd.Series:
    """Quoted spans of an answer that repeat the question nearly word for word."""

    def near(quote: str, asked: str) -> bool:
        """The length allows the ratio, which rules out most quotations, and the texts reach it."""
        if 2 * min(len(quote), len(asked)) < ECHO_RATIO * (len(quote) + len(asked)):
            return False
        return quote == asked or difflib.SequenceMatcher(None, asked, quote).ratio() >= ECHO_RATIO

    def spans(a: str | None, q: str | None) -> list[dict[str, int]]:
        asked = (q or "").strip()
        return [
            {"start": m.start(1), "end": m.end(1)}
            for m in (re.finditer(QUOTED, a or "") if asked else ()) if near(m.group(1), asked)
        ]

    return pd.Series([spans(a, q) for a, q in zip(answer, question)])


def outside_spans(anchor_rows: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Anchors that lie in no protected span; spans: (key, spans)."""
    joined = anchor_rows.join(spans, key, "left")
    inside = F.exists("spans", lambda s: (s["start"] <= F.col("pos")) & (F.col("pos") < s["end"]))
    return joined.filter(~F.coalesce(inside, F.lit(False))).drop("spans")


def align_modals(
    answers: DataFrame, sources: DataFrame, key: str, modals: P.ModalProfile = P.STANDARD_MODALS,
    min_match: int = MIN_MATCH, question: str | None = None,
) -> DataFrame:
    """Answers (key, text[, question]) with modal words set to those of their evidence (key, ev_no, text).

    With a question column, words inside a quotation of the question are left alone.
    """
    found = anchors(answers, [key], "text", modals.pattern)
    if question:
        found = outside_spans(found, answers.select(key, echo_spans("text", question).alias("spans")), key)
    known = anchors(sources, [key, "ev_no"], "text", modals.pattern)
    return apply_changes(answers, match_anchors(found, known, key, min_match, modals.direction_chars), key, "text")


def align_numbers(
    answers: DataFrame, sources: DataFrame, key: str, pattern: str = P.NUMBER_PATTERN, min_match: int = MIN_MATCH,
) -> DataFrame:
    """The same for numbers with units; kept as an option, since changing numbers is riskier than words."""
    found = anchors(answers, [key], "text", pattern)
    known = anchors(sources, [key, "ev_no"], "text", pattern)
    changes = match_anchors(
        found, known, key, min_match, P.NUMBER_DIRECTION_CHARS, direction_before=True, skip_equal=True
    )
    return apply_changes(answers, changes, key, "text")


def references(text: Column) -> Column:
    """Numbers of all [n] marks with one or two digits."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,2})\]"), F.lit(1)), lambda x: x.cast("int"))


def dangling(text: Column, n_evidence: Column) -> Column:
    """References to evidence that does not exist."""
    return F.filter(references(text), lambda n: (n < 1) | (n > n_evidence))


def parse_verdict(raw: Column) -> Column:
    """struct(grounded, issues, verified) of a checker's output; unreadable output counts as grounded, unverified."""
    data = F.try_parse_json(F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")))
    verified = F.coalesce(F.startswith(F.schema_of_variant(data), F.lit("OBJECT")), F.lit(False))
    grounded = F.try_variant_get(data, "$.grounded", "variant")
    kind = F.schema_of_variant(grounded)
    truthy = (
        F.when(grounded.isNull(), True).when(kind == "BOOLEAN", grounded.try_cast("boolean"))
        .when(kind == "VOID", False).when(kind == "STRING", grounded.cast("string") != "")
        .when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), grounded.try_cast("double") != 0).otherwise(True)
    )
    listed = F.try_variant_get(data, "$.issues", "array<variant>")
    items = F.filter(
        F.coalesce(listed, F.array().cast("array<variant>")),
        lambda v: F.schema_of_variant(v).rlike("^(STRING|BIGINT|DOUBLE|DECIMAL|BOOLEAN)"),
    )
    issues = F.filter(F.transform(items, lambda v: strip(v.cast("string"))), lambda x: x != "")
    return F.when(
        verified, F.struct((truthy & (F.size(issues) == 0)).alias("grounded"), issues.alias("issues"), verified.alias("verified"))
    ).otherwise(
        F.struct(F.lit(True).alias("grounded"), F.array().cast("array<string>").alias("issues"), F.lit(False).alias("verified"))
    )


def may_verify(elapsed_ms: Column) -> Column:
    """Whether the time used so far leaves room for the check."""
    return elapsed_ms < VERIFY_BUDGET_MS


def modal_tiers(df: DataFrame, key: str, text: str, modals: P.ModalProfile = P.STANDARD_MODALS) -> DataFrame:
    """(key, tier, n): words of obligation by tier, without those that their neighbours show to be other words."""
    rows = anchors(df, [key], text, modals.pattern)
    tiers = F.create_map(*[F.lit(x) for pair in modals.tiers.items() for x in pair])
    prev, nxt = F.right("prefix", F.lit(1)), F.substring("suffix", 1, 1)
    false = F.lit(False)
    for guard, char in ((modals.guard_prev, prev), (modals.guard_next, nxt)):
        for word, chars in guard.items():
            false = false | ((F.col("word") == word) & (char != "") & F.contains(F.lit(chars), char))
    kept = rows.withColumn("tier", F.try_element_at(tiers, F.col("word"))).filter(F.col("tier").isNotNull() & ~false)
    return kept.groupBy(key, "tier").agg(F.count("*").alias("n"))
