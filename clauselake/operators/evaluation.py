"""Retrieval metrics, quality grades, regression comparisons and eval-set upkeep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.functions.text import norm_code, strip
from clauselake.operators.scale import keep_first, top_k

# fixed values: judge weights, veto dimensions, grades, thresholds
WEIGHTS = {
    "dim1_recall": 0.20, "dim2_precision": 0.15, "dim6_boundary": 0.10, "dim3_citation": 0.20,
    "dim4_wording": 0.15, "dim5_numeric": 0.10, "dim7_no_halluc": 0.10,
}
VETO_DIMS = ("dim4_wording", "dim5_numeric", "dim7_no_halluc")
GREEN, YELLOW = 0.75, 0.6
FLIP = 0.05
SMOKE = 0.8
TTL_SECONDS = 86_400
COMBOS = [
    ("A", True, True, True), ("B", False, True, True), ("C", True, False, True),
    ("D", False, False, True), ("E", True, True, False), ("F", False, False, False),
]


def clause_match(expected: Column, actual: Column) -> Column:
    """Either clause contains the other, both non-empty."""
    e, a = strip(F.coalesce(expected, F.lit(""))), strip(F.coalesce(actual, F.lit("")))
    return (e != "") & (a != "") & (F.contains(e, a) | F.contains(a, e))


def truth_audit(truth: DataFrame, corpus: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, present): whether the corpus has a clause of the expected code that contains the expected one or is in it.

    truth: (key, code, clause).  corpus: (code, clause).  Codes join by equality on their distinct clauses only.
    """
    have = corpus.select(norm_code(F.col("code"), "d").alias("_k"), F.col("clause").alias("_has")).distinct()
    wanted = truth.select(key, norm_code(F.col("code"), "d").alias("_k"), "clause")
    found = wanted.join(have, "_k").filter(clause_match(F.col("clause"), F.col("_has"))).select(key).distinct()
    return truth.select(key).distinct().join(found.withColumn("present", F.lit(True)), key, "left").select(
        key, F.coalesce("present", F.lit(False)).alias("present"))


def also_accept(text: Column) -> Column:
    """array<struct<code,clause>> from `code|clause;code|clause`; entries without a code are ignored."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ";", -1), strip)
    pairs = F.transform(
        parts, lambda p: F.struct(
            strip(F.substring_index(p, "|", 1)).alias("code"),
            F.when(F.contains(p, F.lit("|")), strip(F.regexp_extract(p, r"(?s)\|(.*)$", 1))).otherwise("").alias("clause"),
        ),
    )
    return F.filter(pairs, lambda x: x["code"] != "")


def truth_rows(rows: DataFrame, key: str = "query_id", extra: str | None = None) -> DataFrame:
    """(key, code, clause): main expectation and all accepted alternatives, blank codes dropped."""
    main = F.array(F.struct(F.col("expected_code").alias("code"), F.col("expected_clause").alias("clause")))
    every = F.concat(main, also_accept(F.col(extra))) if extra else main
    listed = rows.select(key, F.inline_outer(every))
    return listed.filter(strip(F.coalesce("code", F.lit(""))) != "")


def first_hits(hits: DataFrame, truth: DataFrame, queries: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, rank_strict, rank_loose): best rank whose code matches, and whose clause matches too; else null.

    hits: (key, rank, code, clause), a bounded list per query.  truth: (key, code, clause).  Codes join by
    equality; the clause test runs on those pairs only.
    """
    left = hits.select(key, "rank", norm_code(F.col("code"), "a").alias("_c"), F.col("clause").alias("_actual"))
    right = truth.select(key, norm_code(F.col("code"), "a").alias("_c"), F.col("clause").alias("_want"))
    matched = left.join(right, [key, "_c"]).groupBy(key).agg(
        F.min(F.when(clause_match(F.col("_want"), F.col("_actual")), F.col("rank"))).alias("rank_strict"),
        F.min("rank").alias("rank_loose"),
    )
    return queries.select(key).join(matched, key, "left")


def expected_hits(hits: DataFrame, truth: DataFrame, key: str = "query_id") -> DataFrame:
    """The same ranks for the queries that have an expectation, reading the expectations once."""
    left = hits.select(key, "rank", norm_code(F.col("code"), "a").alias("_c"), F.col("clause").alias("_actual"))
    right = truth.select(key, norm_code(F.col("code"), "a").alias("_c"), F.col("clause").alias("_want"))
    return right.join(left, [key, "_c"], "left").groupBy(key).agg(
        F.min(F.when(clause_match(F.col("_want"), F.col("_actual")), F.col("rank"))).alias("rank_strict"),
        F.min("rank").alias("rank_loose"),
    )


def metrics(suffixes: Sequence[str] = ("strict", "loose")) -> list[Column]:
    """Count, Hit@5, Hit@10 and mean reciprocal rank of rank_<suffix> columns."""
    out = [F.count("*").alias("n")]
    for s in suffixes:
        rank = F.col(f"rank_{s}")
        out += [
            F.round(F.avg(F.when(rank <= 5, 1.0).otherwise(0.0)), 6).alias(f"hit5_{s}"),
            F.round(F.avg(F.when(rank <= 10, 1.0).otherwise(0.0)), 6).alias(f"hit10_{s}"),
            F.round(F.avg(F.coalesce(1.0 / rank, F.lit(0.0))), 6).alias(f"mrr_{s}"),
        ]
    return out


def breakdown(ranks: DataFrame, first: str, second: str) -> DataFrame:
    """Metrics overall, by the first and by the second column, in one pass of grouping sets."""
    sets = [[], [F.col(first)], [F.col(second)]]
    return ranks.groupingSets(sets, first, second).agg(*metrics())


def misses(ranks: DataFrame, order: Sequence[Column], top: int = 10) -> DataFrame:
    """First rows without a strict hit: code_only where the code was found, missed where nothing was."""
    kind = F.when(F.col("rank_loose").isNotNull(), "code_only").otherwise("missed")
    return ranks.filter(F.col("rank_strict").isNull()).withColumn("kind", kind).orderBy(*order).limit(top)


def latest(df: DataFrame, keys: Sequence[str], ts: str, tie: str, fields: Sequence[str]) -> DataFrame:
    """Fields of the newest row per key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(ts, *fields), F.struct(ts, tie)).alias("_l")).select(*keys, "_l.*")


def latest_within(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, fields: Sequence[str], now: Column, seconds: int = TTL_SECONDS
) -> DataFrame:
    """Newest row per key when it is young enough; an older newest row gives nothing."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    return latest(df, keys, ts, tie, fields).filter(age <= seconds * 1_000_000)


def flips(new: DataFrame, history: DataFrame, combo: str, set_col: str, threshold: float = FLIP) -> DataFrame:
    """(combo, new_set, old_set, delta_strict, delta_loose, flipped, note) of each combo against every other set.

    new and history: (combo, set, strict, loose), one row per combo and set.
    """
    a = new.select(combo, F.col(set_col).alias("new_set"), F.col("strict").alias("s1"), F.col("loose").alias("l1"))
    b = history.select(combo, F.col(set_col).alias("old_set"), F.col("strict").alias("s0"), F.col("loose").alias("l0"))
    d = a.join(b, combo).filter(F.col("new_set") != F.col("old_set")).select(
        combo, "new_set", "old_set", F.round(F.col("s1") - F.col("s0"), 6).alias("delta_strict"),
        F.round(F.col("l1") - F.col("l0"), 6).alias("delta_loose"),
    )
    loose, strict = F.abs("delta_loose") >= threshold, F.abs("delta_strict") >= threshold
    note = (
        F.when(loose & (F.col("delta_loose") < 0), "loose down").when(loose, "loose up").when(strict, "strict changed").otherwise("")
    )
    return d.withColumn("flipped", loose | strict).withColumn("note", note)


def composite(weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of the judge dimensions."""
    weights = WEIGHTS if weights is None else weights
    return F.round(sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0)), 6)


def vetoed() -> Column:
    """True when a dimension that must not fail is zero."""
    out = F.lit(False)
    for d in VETO_DIMS:
        out = out | (F.col(d) == 0)
    return out


def grade(mean: Column, any_veto: Column) -> Column:
    """GREEN, YELLOW or RED of a run."""
    return F.when((mean >= GREEN) & ~any_veto, "GREEN").when(mean >= YELLOW, "YELLOW").otherwise("RED")


def citation_dims(citations: Column, code: Column, clause: Column, first: int = 5) -> list[Column]:
    """dim1 and dim2 from the first citations array<struct<code,clause>>: code found, code and clause found."""
    head = F.slice(citations, 1, first)
    same = F.filter(head, lambda c: norm_code(c["code"], "d") == norm_code(code, "d"))
    return [
        (F.size(same) > 0).cast("int").alias("dim1_recall"),
        F.exists(same, lambda c: clause_match(clause, c["clause"])).cast("int").alias("dim2_precision"),
    ]


def scenario_eval(rows: DataFrame, expected: str = "expected", actual: str = "actual") -> DataFrame:
    """(expected, total, hit, soft, failed): no_result may come back as normal, since only search can tell."""
    hit = F.col(expected) == F.col(actual)
    soft = (F.col(expected) == "no_result") & (F.col(actual) == "normal")
    return rows.groupBy(expected).agg(
        F.count("*").alias("total"), F.count_if(hit).alias("hit"), F.count_if(soft).alias("soft"),
        F.count_if(~hit & ~soft).alias("failed"),
    )


def confusion(rows: DataFrame, expected: str = "expected", got: str = "got") -> DataFrame:
    """(expected, got, n, recall, precision): cells with their share of row and column."""
    cells = rows.groupBy(expected, got).agg(F.count("*").alias("n"))
    by_row, by_col = Window.partitionBy(expected), Window.partitionBy(got)
    return cells.select(
        expected, got, "n", F.round(F.col("n") / F.sum("n").over(by_row), 6).alias("recall"),
        F.round(F.col("n") / F.sum("n").over(by_col), 6).alias("precision"),
    )


def route_report(rows: DataFrame, hard: str = "borderline") -> DataFrame:
    """One row: accuracy overall, on clear and on borderline rows, false triggers and missed triggers."""
    ok, plain = F.col("expected") == F.col("got"), F.col("expected") == "plain"

    def share(part: Column, whole: Column, name: str) -> Column:
        return F.round(F.count_if(part & whole) / F.nullif(F.count_if(whole), F.lit(0)), 6).alias(name)

    every = F.lit(True)
    return rows.agg(
        F.count("*").alias("n"), share(ok, every, "accuracy"), share(ok, ~F.col(hard), "accuracy_clear"),
        share(ok, F.col(hard), "accuracy_borderline"), share(F.col("got") != "plain", plain, "false_trigger"),
        share(F.col("got") == "plain", ~plain, "missed"),
    )


def review_sample(rows: DataFrame, id_col: str, veto: str, seed: str, vetoes: int = 15, n: int = 30) -> DataFrame:
    """First vetoed rows, filled up with others in a seeded digest order."""
    order = F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")))
    bad = rows.filter(F.col(veto)).orderBy(id_col).limit(vetoes).withColumn("stratum", F.lit(0)).withColumn("_o", F.lit(""))
    good = rows.filter(~F.col(veto)).withColumn("_o", order).orderBy("_o", id_col).limit(n).withColumn("stratum", F.lit(1))
    return bad.unionByName(good).orderBy("stratum", "_o", id_col).limit(n).drop("_o")


def variance(runs: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Mean, population deviation, least and largest value of a metric over runs."""
    return runs.groupBy(*keys).agg(
        F.count("*").alias("n_runs"), F.round(F.avg(metric), 6).alias("mean"), F.round(F.stddev_pop(metric), 6).alias("std"),
        F.min(metric).alias("lowest"), F.max(metric).alias("highest"),
    )


def persistence(failures: DataFrame, id_col: str, run: str) -> DataFrame:
    """(n_runs, n_ids, share): how many ids failed in how many runs."""
    per = failures.groupBy(id_col).agg(F.countDistinct(run).alias("n_runs"))
    hist = per.groupBy("n_runs").agg(F.count("*").alias("n_ids"))
    total = hist.agg(F.sum("n_ids")).scalar()
    return hist.withColumn("share", F.round(F.col("n_ids") / total, 6))


def overlay(rows: DataFrame, revisions: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows with revised fields; status and reason come from the revision, kept otherwise; old_<field> is the log."""
    news = revisions.select(key, "status", "reason", *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = rows.join(news, key, "left")
    return joined.select(
        *[c for c in rows.columns if c not in fields],
        *[F.coalesce(f"_new_{f}", f).alias(f) for f in fields],
        *[F.when(F.col(f"_new_{f}").isNotNull() & ~F.col(f"_new_{f}").eqNullSafe(F.col(f)), F.col(f)).alias(f"old_{f}") for f in fields],
        F.coalesce("status", F.lit("kept")).alias("status"), F.coalesce("reason", F.lit("")).alias("reason"),
    )


def round_robin(rows: DataFrame, spec: str, score: Column, id_col: str, per_spec: int, target: int) -> DataFrame:
    """Best rows per spec, taken in turns over the specs until the target is reached."""
    best = top_k(rows.withColumn("score", score), [spec], [F.col("score").desc(), F.col(id_col)], per_spec, "round")
    return best.orderBy("round", spec).limit(target)


def key_numbers(text: Column, pattern: str, limit: int = 80) -> Column:
    """Distinct numbers with units in order, joined and cut."""
    return F.substring(F.array_join(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), " / "), 1, limit)


def diagnose(ranks: DataFrame, stages: Sequence[str], final: str, top: int = 5) -> Column:
    """ok, rank failure (some stage had the target) or recall failure (none had)."""
    seen = F.coalesce(*[F.col(s) for s in stages])
    return F.when(F.col(final) <= top, "ok").when(seen.isNotNull(), "rank_failure").otherwise("recall_failure")


def paired(before: DataFrame, after: DataFrame, key: str, rank: str) -> DataFrame:
    """(key, before, after, change): better, worse, same, gained, lost or missing per query."""
    a = before.select(key, F.col(rank).alias("before"))
    b = after.select(key, F.col(rank).alias("after"))
    x, y = F.col("before"), F.col("after")
    change = (
        F.when(x.isNull() & y.isNull(), "missing").when(x.isNull(), "gained").when(y.isNull(), "lost")
        .when(y < x, "better").when(y > x, "worse").otherwise("same")
    )
    return a.join(b, key, "full_outer").withColumn("change", change)


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Old and new rows with one row per key, the highest version."""
    return keep_first(old.unionByName(new, allowMissingColumns=True), [key], [F.col(version).desc()])
