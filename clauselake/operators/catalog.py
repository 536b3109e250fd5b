"""Catalog lookups, taxonomy, citations and searches over conversations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauselake import profiles as P
from clauselake.functions.text import norm_code, strip
from clauselake.operators.scale import BROADCAST_BYTES, is_small, keep_first, top_k

CITED_CHARS = 200
EVIDENCE_CHARS = 300
SNIPPET = 12
HINTS = 8

GRAM = 3
"""Characters of the grams on which labels and wanted clauses meet."""


def fixed_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Table of a list that the caller holds; a short one is broadcast, a long one is joined like any other."""
    table = spark.createDataFrame(list(rows), schema)
    size = sum(16 + 8 * len(r) + sum(4 * len(v) for v in r if isinstance(v, str)) for r in rows)
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def specs(chunks: DataFrame, code: str, fields: Sequence[str], id_col: str, domain: Column | None = None) -> DataFrame:
    """One row per code: fields of its first chunk and the number of chunks."""
    some = chunks if domain is None else chunks.filter(domain)
    first = F.min_by(F.struct(*fields), id_col).alias("_f")
    return some.groupBy(code).agg(first, F.count("*").alias("n_chunks")).select(code, "_f.*", "n_chunks")


def _grams(text: Column, size: Column) -> Column:
    """The distinct parts of a text that have so many characters."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1))
    return F.array_distinct(F.transform(starts, lambda i: text.substr(i, size)))


def contained(parts: DataFrame, texts: DataFrame) -> DataFrame:
    """(code_key, part, text): all pairs of one code in which the text contains the part; texts come once per code.

    A part meets only the texts that have its rarest gram of GRAM characters, or of as many as it has; these are verified.
    A text adds at most one row per character and gram size that the parts of its code use; no row is compared with all.
    """
    sized = parts.filter(F.col("part") != "").withColumn("_q", F.least(F.length("part"), F.lit(GRAM)))
    sizes = sized.groupBy("code_key").agg(F.collect_set("_q").alias("_sizes"))  # GRAM sizes at most
    grams = texts.join(sizes, "code_key").select(
        "code_key", "text", F.explode(F.flatten(F.transform("_sizes", lambda q: F.coalesce(
            _grams(F.col("text"), q), F.array().cast("array<string>"))))).alias("_gram"))
    counts = grams.groupBy("code_key", "_gram").agg(F.count("*").alias("_df"))
    of_parts = sized.select("code_key", "part", F.explode(_grams(F.col("part"), F.col("_q"))).alias("_gram"))
    rarest = of_parts.join(counts, ["code_key", "_gram"], "left").groupBy("code_key", "part").agg(
        F.min(F.coalesce("_df", F.lit(0))).alias("_least"), F.min_by("_gram", F.struct("_df", "_gram")).alias("_gram")
    ).filter("_least > 0").drop("_least")
    return rarest.join(grams, ["code_key", "_gram"]).filter(F.col("text").contains(F.col("part"))).select("code_key", "part", "text")


def clause_labels(chunks: DataFrame, code: str, clause: str, id_col: str) -> DataFrame:
    """(code_key, clause, id): distinct clause labels per normalized code with their first chunk."""
    return chunks.select(norm_code(F.col(code), "a").alias("code_key"), strip(F.col(clause)).alias("clause"), id_col).filter(
        F.col("clause") != ""
    ).groupBy("code_key", "clause").agg(F.min(id_col).alias(id_col))


def lookup_clause(requests: DataFrame, labels: DataFrame, id_col: str, request_id: str = "request_id") -> DataFrame:
    """(request, clause, id) best match per request (request_id, code, clause); unmatched requests are absent.

    Exact label first, then a label containing the wanted one or contained in it, then the id.  Both containments are
    joins on rare grams, so nothing is compared pairwise; what several requests want is looked up once.
    """
    wanted = requests.select(
        request_id, norm_code(F.col("code"), "a").alias("code_key"), strip(F.col("clause")).alias("want")
    ).filter(F.col("want") != "")
    wants, clauses = wanted.select("code_key", "want").distinct(), labels.select("code_key", "clause")
    holds = contained(wants.withColumnRenamed("want", "part"), clauses.withColumnRenamed("clause", "text"))
    inside = contained(clauses.withColumnRenamed("clause", "part"), wants.withColumnRenamed("want", "text"))
    pairs = holds.toDF("code_key", "want", "clause").unionByName(
        inside.toDF("code_key", "clause", "want").filter(F.col("clause") != F.col("want")))
    best = keep_first(
        pairs.join(labels, ["code_key", "clause"]), ["code_key", "want"],
        [F.when(F.col("clause") == F.col("want"), 0).otherwise(1), F.col(id_col)])
    return wanted.join(best, ["code_key", "want"]).select(
        request_id, "clause", id_col, (F.col("clause") == F.col("want")).alias("exact")
    )


def near_clauses(missing: DataFrame, labels: DataFrame, request_id: str = "request_id") -> DataFrame:
    """(request, hint): up to eight labels of the code that share the leading part of the wanted clause."""
    want = strip(F.col("clause"))
    lead = F.when(want.contains("."), F.substring_index(want, ".", 1)).otherwise(F.substring(want, 1, 2))
    wanted = missing.select(request_id, norm_code(F.col("code"), "a").alias("code_key"), lead.alias("lead"))
    starts = labels.select(
        "code_key", F.col("clause").alias("hint"),
        F.explode(
            F.transform(F.sequence(F.lit(0), F.length("clause")), lambda n: F.col("clause").substr(F.lit(1), n))
        ).alias("lead"),
    )
    first = top_k(starts, ["code_key", "lead"], [F.col("hint")], HINTS, "hint_no")
    return wanted.join(first, ["code_key", "lead"]).select(request_id, "hint_no", "hint")


def with_status(df: DataFrame, code: str, statuses: DataFrame) -> DataFrame:
    """Adds status, replaced_by and status_note; codes without an entry are in force.

    statuses: (code, status, replaced_by, status_note); broadcast when it is short.
    """
    listed = statuses.select(norm_code(F.col("code"), "a").alias("_k"), "status", "replaced_by", "status_note")
    return (
        df.withColumn("_k", norm_code(F.col(code), "a")).join(F.broadcast(listed) if is_small(statuses) else listed, "_k", "left").drop("_k")
        .withColumn("status", F.coalesce("status", F.lit(P.IN_FORCE)))
    )


def with_group(df: DataFrame, code: str, groups: dict[str, str] | None = None) -> DataFrame:
    """Adds the second-level group of a code; unknown codes stay null."""
    spark = df.sparkSession
    rows = list((P.SUBCATEGORIES if groups is None else groups).items())
    listed = fixed_table(spark, rows, "code string, sub_group string").select(
        norm_code(F.col("code"), "c").alias("_k"), "sub_group"
    )
    return df.withColumn("_k", norm_code(F.col(code), "c")).join(listed, "_k", "left").drop("_k")


def grouped_specs(
    spec_rows: DataFrame, domain: str, code: str, order: dict[str, list[str]] | None = None,
    groups: dict[str, str] | None = None, min_specs: int = P.SUBDIVIDE_MIN, unclassified: str = P.UNCLASSIFIED,
) -> DataFrame:
    """(domain, sub_group, group_pos, n_specs) of the domains that are subdivided.

    A domain is subdivided when it has a declared order and enough specs.  Declared groups come first in that
    order, others by name, the unclassified last.
    """
    spark = spec_rows.sparkSession
    order = P.SUBCATEGORY_ORDER if order is None else order
    placed = fixed_table(
        spark, [(d, g, i) for d, names in order.items() for i, g in enumerate(names)],
        f"{domain} string, sub_group string, declared int",
    )
    domains = fixed_table(spark, [(d,) for d in order], f"{domain} string")
    counted = with_group(spec_rows.select(domain, code), code, groups).withColumn(
        "sub_group", F.coalesce("sub_group", F.lit(unclassified))
    ).groupBy(domain, "sub_group").agg(F.count("*").alias("n_specs"))
    total = F.sum("n_specs").over(Window.partitionBy(domain))
    kept = counted.withColumn("n_domain", total).filter(F.col("n_domain") >= min_specs).join(domains, domain, "left_semi")
    ranked = kept.join(placed, [domain, "sub_group"], "left")
    pos = F.row_number().over(
        Window.partitionBy(domain).orderBy(
            F.when(F.col("sub_group") == unclassified, 1).otherwise(0), F.col("declared").asc_nulls_last(), "sub_group"
        )
    )
    return ranked.withColumn("group_pos", pos).select(domain, "sub_group", "group_pos", "n_specs", "n_domain")


def scan_costs(spec_counts: DataFrame, domain: str, size: str) -> DataFrame:
    """(domain, n, flat, grouped): expected rows read to find a spec in a flat list and in a grouped one."""
    n, m, k = F.sum(size), F.col(size), F.count("*")
    return spec_counts.groupBy(domain).agg(
        n.alias("n"), F.round((n + 1) / 2, 6).alias("flat"),
        F.round((k + 1) / 2 + F.sum(m * (m + 1) / 2) / n, 6).alias("grouped"),
    )


def corpus_counts(chunks: DataFrame, domain: str, code: str) -> DataFrame:
    """(domain, code, n_chunks, n_specs): per spec, per domain (null code) and in total (null domain)."""
    per = chunks.groupBy(domain, code).agg(F.count("*").alias("n"))
    return per.rollup(domain, code).agg(F.sum("n").alias("n_chunks"), F.count("*").alias("n_specs"))


def corpus_tree(chunks: DataFrame, domain: str, code: str) -> DataFrame:
    """(domain, n_chunks, specs): nested spec list per domain, built from counts and not from chunks."""
    per = chunks.groupBy(domain, code).agg(F.count("*").alias("n"))
    return per.groupBy(domain).agg(
        F.sum("n").alias("n_chunks"), F.array_sort(F.collect_list(F.struct(code, "n"))).alias("specs")
    )


def citation(text: Column, formula: str = P.FORMULA_SIGNAL) -> list[Column]:
    """Quoted head of a text and whether it announces a formula."""
    return [F.substring(text, 1, CITED_CHARS).alias("original_text"), text.rlike(formula).alias("has_formula")]


def tier(code: Column, tiers: Sequence[tuple[str, str]] = tuple(P.TIERS)) -> Column:
    """Tier by code prefix; the one without a prefix takes the rest."""
    key = norm_code(code, "b")
    rest = next(name for name, prefix in tiers if not prefix)
    out = F.lit(rest)
    for name, prefix in tiers:
        if prefix:
            out = F.when(F.startswith(key, F.lit(prefix)), name).otherwise(out)
    return out


def tier_summary(cites: DataFrame, code: str, tiers: Sequence[tuple[str, str]] = tuple(P.TIERS), keys: Sequence[str] = ()) -> DataFrame:
    """(keys, tier, pos, n_codes): distinct codes per tier, in the fixed order of tiers."""
    marked = cites.select(*keys, tier(F.col(code), tiers).alias("tier"), norm_code(F.col(code), "b").alias("k"))
    pos = F.array_position(F.array(*[F.lit(n) for n, _ in tiers]), F.col("tier"))
    return marked.groupBy(*keys, "tier").agg(F.countDistinct("k").alias("n_codes")).withColumn("pos", pos)


def search_conversations(
    turns: DataFrame, titles: DataFrame, term: str, conv: str = "conv_id", turn: str = "turn"
) -> DataFrame:
    """(conv, in_title, turn, snippet): conversations whose title or any message holds a term, first message shown."""
    low = term.lower()
    hits = turns.filter(F.lower(F.col("text")).contains(low)).groupBy(conv).agg(
        F.min(turn).alias(turn), F.min_by("text", turn).alias("text")
    )
    at = F.locate(low, F.lower(F.col("text")))
    start = F.greatest(at - SNIPPET, F.lit(1))
    piece = F.col("text").substr(start, at - start + len(low) + SNIPPET)
    snippet = F.concat(F.when(at - 1 > SNIPPET, "…").otherwise(""), F.replace(piece, F.lit("\n"), F.lit(" ")))
    in_title = F.coalesce(F.lower(F.col("title")).contains(low), F.lit(False))
    joined = titles.join(hits.select(conv, turn, snippet.alias("snippet")), conv, "full_outer").withColumn("in_title", in_title)
    return joined.filter(F.col("in_title") | F.col("snippet").isNotNull()).select(conv, "in_title", turn, "snippet")


def search_specs(spec_rows: DataFrame, term: str, code: str = "code", title: str = "title") -> DataFrame:
    """(code, title, snippet) of the specs whose code or title holds a term in any case, a long title cut around it."""
    low = term.lower()
    shown = F.coalesce(F.col(title), F.lit(""))
    at = F.locate(low, F.lower(shown))
    start = F.greatest(at - SNIPPET, F.lit(1))
    piece = F.concat(F.when(at - 1 > SNIPPET, "…").otherwise(""), shown.substr(start, at - start + len(low) + SNIPPET))
    found = F.lower(F.coalesce(F.col(code), F.lit(""))).contains(low) | (at > 0)
    return spec_rows.filter(found).select(code, title, F.when(at > 0, piece).otherwise("").alias("snippet"))


def toggle(selected: Column, group: Column) -> Column:
    """Filter set after a click on a group: all there, take them out; else add the missing."""
    missing = F.array_except(group, selected)
    return F.when(F.size(missing) == 0, F.array_except(selected, group)).otherwise(F.array_union(selected, missing))


def evidence_entry(no: Column, name: Column, code: Column, clause: Column, page: Column, mandatory: Column, text: Column) -> Column:
    """One numbered evidence entry of a prompt."""
    shown = F.when(clause.startswith("表") | clause.startswith("式"), clause).otherwise(
        F.concat(F.lit("第 "), clause, F.lit(" 条"))
    )
    marker = F.when(mandatory, "·强制性条文").otherwise("")
    head = F.format_string("[%d] 《%s》%s %s（第 %s 页%s）", no, name, code, shown, F.coalesce(page.cast("string"), F.lit("?")), marker)
    return F.concat(head, F.lit('\n"'), strip(text), F.lit('"'))


def check_entry(no: Column, name: Column, code: Column, clause: Column, page: Column, mandatory: Column, text: Column) -> Column:
    """One numbered evidence entry for the answer check, text cut and on one line."""
    flags = F.array_compact(F.array(
        F.when(mandatory, "强制性条文"), F.when(page.isNotNull(), F.concat(F.lit("第"), page.cast("string"), F.lit("页")))
    ))
    meta = F.when(F.size(flags) > 0, F.concat(F.lit("（"), F.array_join(flags, " · "), F.lit("）"))).otherwise("")
    flat = F.substring(F.replace(text, F.lit("\n"), F.lit(" ")), 1, EVIDENCE_CHARS)
    return F.concat(F.format_string("[%d] 《%s》%s %s%s\n", no, name, code, clause, meta), flat)


def block(entries: DataFrame, key: str, no: str, entry: str) -> DataFrame:
    """(key, block): entries of each key joined in order; a key holds the few hits of one query."""
    ordered = F.array_sort(F.collect_list(F.struct(no, entry)))
    return entries.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x[entry]), "\n\n").alias("block"))


def live_projects(conversations: DataFrame, projects: DataFrame, project: str = "project_id") -> DataFrame:
    """Conversations of deleted projects stay, without a project."""
    live = projects.select(project).withColumn("_live", F.lit(True))
    return conversations.join(live, project, "left").withColumn(project, F.when(F.col("_live"), F.col(project))).drop("_live")
