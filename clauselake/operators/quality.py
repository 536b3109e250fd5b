"""Text repair, page furniture, issue scans and corpus audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake import profiles as P
from clauselake.functions.text import contains_any, count_class, strip
from clauselake.operators.scale import top_k


def repair_words(df: DataFrame, text: str, repairs: dict[str, str] | None = None) -> DataFrame:
    """Replace known misreadings in order; n_words counts replacements on the running text."""
    repairs = P.REPAIRS if repairs is None else repairs
    start = F.struct(F.col(text).alias("t"), F.lit(0).cast("long").alias("n"))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in repairs.items()])

    def step(acc: Column, pair: Column) -> Column:
        hits = (F.length(acc["t"]) - F.length(F.replace(acc["t"], pair["a"], F.lit("")))) / F.length(pair["a"])
        return F.struct(
            F.replace(acc["t"], pair["a"], pair["b"]).alias("t"), (acc["n"] + hits.cast("long")).alias("n")
        )

    done = df.withColumn("_r", F.aggregate(pairs, start, step))
    return done.withColumn(text, F.col("_r")["t"]).withColumn("n_words", F.col("_r")["n"]).drop("_r")


def repair_patterns(df: DataFrame, text: str, rules: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Replace by patterns in order; n_units counts all matches."""
    rules = [(P.UNIT_PATTERN, P.UNIT_REPLACEMENT), (P.UNIT_HEADER_PATTERN, P.UNIT_REPLACEMENT)] if rules is None else rules
    out = df.withColumn("n_units", F.lit(0).cast("long"))
    for pattern, replacement in rules:
        out = out.withColumn("n_units", F.col("n_units") + F.regexp_count(text, F.lit(pattern))).withColumn(
            text, F.regexp_replace(text, pattern, replacement)
        )
    return out


def mark_furniture(
    df: DataFrame, text: str, whitelist: Sequence[str] | None = None, page_number: str = P.PAGE_NUMBER
) -> DataFrame:
    """Adds _lines: structs (line, furniture, page_no) in order.

    Furniture is a line that equals a listed one; a page number only counts next to one.
    """
    listed = F.array(*[F.lit(x) for x in (P.FURNITURE if whitelist is None else whitelist)])
    split = df.withColumn("_l", F.split(text, "\n", -1))
    known = split.withColumn("_w", F.transform("_l", lambda x: F.array_contains(listed, strip(x))))

    def mark(x: Column, i: Column) -> Column:
        beside = F.coalesce(F.get("_w", i - 1), F.lit(False)) | F.coalesce(F.get("_w", i + 1), F.lit(False))
        return F.struct(
            x.alias("line"), F.get("_w", i).alias("furniture"), (strip(x).rlike(page_number) & beside).alias("page_no")
        )

    return known.withColumn("_lines", F.transform("_l", mark)).drop("_l", "_w")


def strip_furniture(
    df: DataFrame, text: str, whitelist: Sequence[str] | None = None, page_number: str = P.PAGE_NUMBER
) -> DataFrame:
    """Delete furniture lines and the page numbers beside them; nothing else changes."""
    marked = mark_furniture(df, text, whitelist, page_number)
    kept = F.filter("_lines", lambda x: ~x["furniture"] & ~x["page_no"])
    return (
        marked.withColumn(text, F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
        .withColumn("n_furniture", F.size(F.filter("_lines", lambda x: x["furniture"])))
        .withColumn("n_page_no", F.size(F.filter("_lines", lambda x: x["page_no"])))
        .drop("_lines")
    )


def line_census(
    df: DataFrame, text: str, keywords: Sequence[str] | None = None, whitelist: Sequence[str] | None = None
) -> DataFrame:
    """(line, n): lines holding a keyword that no list knows yet."""
    keywords = P.FURNITURE_KEYWORDS if keywords is None else keywords
    whitelist = P.FURNITURE if whitelist is None else whitelist
    lines = df.select(F.explode_outer(F.split(text, "\n", -1)).alias("line")).select(strip(F.col("line")).alias("line"))
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.col("line").contains(k)
    return lines.filter(hit & ~F.col("line").isin(*whitelist)).groupBy("line").agg(F.count("*").alias("n"))


def rejoin_audit(
    df: DataFrame, id_col: str, text: str, whitelist: Sequence[str] | None = None,
    page_number: str = P.PAGE_NUMBER, width: int = 18,
) -> DataFrame:
    """(id, line_no, before, after): the kept lines around each furniture line that sits between kept lines.

    Only documents holding a listed text are cut into lines.
    """
    some = df.select(id_col, text).filter(contains_any(F.col(text), list(P.FURNITURE if whitelist is None else whitelist)))
    rows = mark_furniture(some, text, whitelist, page_number).select(
        id_col, F.posexplode_outer("_lines").alias("line_no", "x")
    )
    line = strip(F.col("x")["line"])
    is_number = line.rlike(page_number)
    kept = F.when((line != "") & ~F.col("x")["furniture"] & ~is_number, line)
    order = Window.partitionBy(id_col).orderBy("line_no")
    before = F.last(kept, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(kept, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    around = rows.select(id_col, "line_no", F.col("x")["furniture"].alias("f"), before.alias("b"), after.alias("a"))
    return around.filter(F.col("f") & F.col("b").isNotNull() & F.col("a").isNotNull()).select(
        id_col, "line_no", F.right("b", F.lit(width)).alias("before"), F.substring("a", 1, width).alias("after")
    )


def _issue(when: Column, kind: str, detail: Column) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("kind"), detail.alias("detail")))


def scan_issues(
    text: Column, errors: dict[str, str] | None = None, punctuation_run: str = P.PUNCTUATION_RUN,
    zero_mixup: str = P.ZERO_MIXUP, one_mixup: str = P.ONE_MIXUP, mixed_run: str = P.LATIN_IN_CJK,
    usual: str = P.USUAL_CHARS,
) -> Column:
    """array<struct<kind,detail>> of suspected misreadings; every unusual character is an issue of its own."""
    errors = P.SCAN_ERRORS if errors is None else errors
    fixed = [
        _issue(text.contains(e), "known_error", F.lit(f"{e}>{fix}")) for e, fix in errors.items()
    ] + [
        _issue(text.rlike(punctuation_run), "punctuation_run", F.regexp_extract(text, punctuation_run, 0)),
        _issue(text.rlike(zero_mixup), "zero_mixup", F.lit("0")),
        _issue(text.rlike(one_mixup), "one_mixup", F.lit("1")),
        _issue(text.rlike(mixed_run), "mixed_run", F.lit("")),
    ]
    rare = F.regexp_extract_all(F.regexp_replace(text, usual, ""), F.lit("(?s)."), F.lit(0))
    rare_issues = F.transform(rare, lambda ch: F.struct(F.lit("rare_char").alias("kind"), ch.alias("detail")))
    return F.concat(F.array_compact(F.array(*fixed)), rare_issues)


def scan_issues_2(
    text: Column, errors: dict[str, str] | None = None, unit_drops: Sequence[tuple[str, str]] | None = None,
    number_letter: str = P.NUMBER_LETTER, suspicious: dict[str, str] | None = None,
    contexts: Sequence[str] | None = None,
) -> Column:
    """struct(issues, suggestions, confidence) of the second scan; hi when the dictionary knows the error."""
    errors = P.SCAN_2_ERRORS if errors is None else errors
    unit_drops = P.UNIT_DROPS if unit_drops is None else unit_drops
    suspicious = P.SUSPICIOUS if suspicious is None else suspicious
    contexts = P.SUSPICIOUS_CONTEXTS if contexts is None else contexts
    known = [_issue(text.contains(e), "known", F.lit(f"{e}>{fix}")) for e, fix in errors.items()]
    drops = [_issue(text.rlike(p), "unit_drop", F.regexp_extract(text, p, 0)) for p, _ in unit_drops]
    mixes = F.transform(
        F.regexp_extract_all(text, F.lit(number_letter), F.lit(0)),
        lambda m: F.struct(F.lit("number_letter_mix").alias("kind"), m.alias("detail")),
    )
    odd = [
        _issue(text.contains(c.format(ch)), "suspicious_char", F.lit(f"{c.format(ch)}:{ch}>{fix}"))
        for ch, fix in suspicious.items() for c in contexts
    ]
    suggestions = [F.when(text.contains(e), F.replace(text, F.lit(e), F.lit(fix))) for e, fix in errors.items()] + [
        F.nullif(F.when(text.rlike(p), F.regexp_replace(text, p, r)), text) for p, r in unit_drops
    ]
    issues = F.concat(F.array_compact(F.array(*known, *drops)), mixes, F.array_compact(F.array(*odd)))
    any_known = F.lit(False)
    for e in errors:
        any_known = any_known | text.contains(e)
    return F.struct(
        issues.alias("issues"), F.array_compact(F.array(*suggestions)).alias("suggestions"),
        F.when(any_known, "hi").otherwise("mid").alias("confidence"),
    )


def issue_kinds(issues: DataFrame) -> DataFrame:
    """(kind, n) of exploded issue rows."""
    return issues.groupBy("kind").agg(F.count("*").alias("n"))


def verdict_bucket(verdict: Column) -> Column:
    """fix, false_positive or uncertain from the beginning of a verdict text; null stays unverified."""
    return (
        F.when(verdict.isNull(), "unverified").when(F.startswith(verdict, F.lit("fix")), "fix")
        .when(F.startswith(verdict, F.lit("false")), "false_positive").otherwise("uncertain")
    )


def sample_per_spec(chunks: DataFrame, spec: str, length: str, mandatory: str, id_col: str, n: int) -> DataFrame:
    """First n chunks of middling length per spec, mandatory ones first."""
    fit = chunks.filter(F.col(length).between(60, 400))
    return top_k(fit, [spec], [F.col(mandatory).desc(), F.col(id_col)], n, "sample_no")


def proposed_pairs(proposals: Column, char_class: str = r"\x{4e00}-\x{9fff}") -> Column:
    """array<struct<wrong,right>> from lines of the form wrong=>right, one to three characters each."""
    pattern = f"^([{char_class}]{{1,3}})=>([{char_class}]{{1,3}})$"
    good = F.filter(F.transform(F.split(proposals, "\n", -1), strip), lambda x: x.rlike(pattern))
    pairs = F.transform(
        good, lambda x: F.struct(
            F.regexp_extract(x, pattern, 1).alias("wrong"), F.regexp_extract(x, pattern, 2).alias("right")
        ),
    )
    return F.filter(pairs, lambda p: (p["wrong"] != p["right"]) & (p["wrong"] != "错字"))


def concordance(df: DataFrame, text: str, candidate: str, width: int) -> DataFrame:
    """(left, right, n): every occurrence of a candidate with its neighbours."""
    pieces = df.select(F.split(text, f"\\Q{candidate}\\E", -1).alias("_p"))
    both = F.when(
        F.size("_p") > 1,
        F.transform(
            F.sequence(F.lit(0), F.size("_p") - 2),
            lambda i: F.struct(
                _tail("_p", i, candidate, width).alias("left"), _head("_p", i + 1, candidate, width).alias("right")
            ),
        ),
    )
    rows = pieces.select(F.inline_outer(both)).filter(F.col("left").isNotNull())
    return rows.groupBy("left", "right").agg(F.count("*").alias("n"))


def _tail(pieces: str, i: Column, candidate: str, width: int) -> Column:
    """Last characters before an occurrence; short pieces reach back over earlier occurrences."""
    start = F.greatest(i - width + 1, F.lit(0))
    near = F.slice(pieces, start + 1, i - start + 1)
    return F.right(F.array_join(near, candidate), F.lit(width))


def _head(pieces: str, i: Column, candidate: str, width: int) -> Column:
    """First characters after an occurrence."""
    return F.substring(F.array_join(F.slice(pieces, i + 1, width), candidate), 1, width)


def low_content(text: Column, char_class: str = r"[\x{4e00}-\x{9fff}]", shortest: int = 12, share: float = 0.12) -> Column:
    """Whether a text is very short or has few characters of the expected class."""
    return (F.length(text) < shortest) | (count_class(text, char_class) / F.length(text) < share)


def density(df: DataFrame, key: str, text: str, pattern: str, per: int = 1000) -> DataFrame:
    """(key, n_hits, n_chars, density): matches per thousand characters."""
    return df.groupBy(key).agg(
        F.sum(F.regexp_count(text, F.lit(pattern))).cast("long").alias("n_hits"), F.sum(F.length(text)).alias("n_chars"),
        F.round(F.sum(F.regexp_count(text, F.lit(pattern))) / F.sum(F.length(text)) * per, 6).alias("density"),
    )

