"""Cutting ordered lines into structured, size-bounded chunks with windows.

A line table holds (doc_id, page, line_no, text, bold, size).  All windows are per document and in line order,
so the lines are exchanged once and every later step reuses that partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.functions.text import count_class, plain_digits, strip
from clauselake.profiles import STANDARDS, StructureProfile

CHUNK_OPENERS = ("clause", "table", "formula")


def lines_of(docs: DataFrame, profile: StructureProfile = STANDARDS, per_page: int = 40) -> DataFrame:
    """Line table of plain texts: short lines count as large print, every seventh length as bold."""
    lines = docs.select("doc_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("line_no", "raw"))
    text = plain_digits(strip(F.col("raw")))
    return lines.select("doc_id", "line_no", text.alias("text")).filter(F.col("text") != "").select(
        "doc_id", (F.floor(F.col("line_no") / per_page) + 1).cast("int").alias("page"), "line_no", "text",
        (F.length("text") % 7 == 0).alias("bold"),
        F.when(F.length("text") <= profile.short_line, 16.0).otherwise(10.0).alias("size"),
    )


def line_kinds(lines: DataFrame, profile: StructureProfile = STANDARDS, article: bool = False) -> DataFrame:
    """Adds kind (appendix, table, formula, chapter, section, clause, body), label and in_appendix."""
    text, size, length = F.col("text"), F.col("size"), F.length("text")
    order = Window.partitionBy("doc_id").orderBy("line_no")
    opens_appendix = (
        F.lit(not article) & text.rlike(profile.appendix_start) & (size >= profile.size_appendix)
        & (length <= profile.short_line)
    )
    lines = lines.withColumn("_open", opens_appendix)
    earlier = F.coalesce(
        F.max("_open").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)
    )
    lines = lines.withColumn("in_appendix", earlier)
    is_section, is_clause_3 = text.rlike(profile.section), text.rlike(profile.clause_3)
    low, high = profile.chapter_length
    kind = (
        F.when(F.col("_open") & ~F.col("in_appendix"), "appendix")
        .when(text.rlike(profile.table_head), "table")
        .when(text.rlike(profile.formula_head), "formula")
    )
    if article:
        kind = kind.when(text.rlike(profile.chapter_article) & (length <= profile.short_line), "chapter").when(
            text.rlike(profile.clause_article), "clause"
        )
        before, after = profile.article_label
        clause_label = F.concat(F.lit(before), F.regexp_extract(text, profile.clause_article, 1), F.lit(after))
    else:
        kind = (
            kind.when(text.rlike(profile.clause_4) | is_clause_3, "clause")
            .when(F.col("in_appendix") & text.rlike(profile.clause_appendix), "clause")
            .when(
                is_section & (((size >= profile.size_section) & (length <= profile.short_line)) | F.col("bold")),
                "section",
            )
            .when(
                text.rlike(profile.chapter) & ~is_section & (size >= profile.size_chapter)
                & length.between(low, high)
                & (count_class(text, profile.heading_char) >= profile.heading_chars),
                "chapter",
            )
        )
        clause_label = (
            F.when(text.rlike(profile.clause_4), F.regexp_extract(text, profile.clause_4, 1))
            .when(is_clause_3, F.regexp_extract(text, profile.clause_3, 1))
            .otherwise(F.regexp_extract(text, profile.clause_appendix, 1))
        )
    label = (
        F.when(F.col("kind") == "clause", clause_label)
        .when(
            F.col("kind") == "table",
            F.concat(F.lit(profile.table_label), F.regexp_extract(text, profile.table_head, 1)),
        )
        .when(
            F.col("kind") == "formula",
            F.concat(F.lit(profile.formula_label), F.regexp_extract(text, profile.formula_head, 1)),
        )
        .when(F.col("kind").isin("appendix", "chapter", "section"), text)
    )
    return lines.withColumn("kind", kind.otherwise("body")).withColumn("label", label).drop("_open")


def carry_structure(kinds: DataFrame) -> DataFrame:
    """Adds seg (running number of openers), chapter and section in force, opener kind and its label.

    A chapter or appendix heading clears the section, and any heading closes the clause: body lines before the
    next opener belong to a segment whose opener is a heading and are dropped later.
    """
    running = (
        Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    )
    kind = F.col("kind")
    chapter = F.when(kind.isin("chapter", "appendix"), F.col("label"))
    section = F.when(
        kind.isin("section", "chapter", "appendix"), F.struct(F.when(kind == "section", F.col("label")).alias("v"))
    )
    opener = F.when(kind != "body", F.struct("kind", "label", "in_appendix", "page", "bold", "text"))
    return kinds.select(
        "*",
        F.sum(F.when(kind != "body", 1).otherwise(0)).over(running).alias("seg"),
        F.last(chapter, ignorenulls=True).over(running).alias("chapter"),
        F.last(section, ignorenulls=True).over(running)["v"].alias("section"),
        F.last(opener, ignorenulls=True).over(running).alias("opener"),
    )


def has_mandatory(text: Column, profile: StructureProfile = STANDARDS) -> Column:
    """Whether the head of a text holds a word of obligation."""
    return F.lower(F.substring(text, 1, profile.head)).rlike(profile.mandatory)


def assemble(carried: DataFrame, profile: StructureProfile = STANDARDS) -> DataFrame:
    """One row per segment: clause, type, text, pages, mandatory flag."""
    inside = carried.filter(F.col("opener")["kind"].isin(*CHUNK_OPENERS)).withColumn(
        "type",
        F.when(F.col("opener")["kind"] != "clause", F.col("opener")["kind"])
        .when(F.col("opener")["in_appendix"], "appendix").otherwise("clause"),
    )
    body = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    grouped = inside.groupBy("doc_id", "seg").agg(
        F.first("opener").alias("opener"), F.first("type").alias("type"), F.first("chapter").alias("chapter"),
        F.first("section").alias("section"), strip(F.array_join(body, "\n")).alias("text"),
        F.min("page").alias("page_start"), F.max("page").alias("page_end"),
        F.bool_or((F.col("kind") == "body") & F.col("bold")).alias("bold_body"),
    ).filter(F.length("text") >= profile.min_text)
    opener = F.col("opener")
    mandatory = (
        ((opener["kind"] == "clause") & (opener["bold"] | has_mandatory(opener["text"], profile)))
        | ((F.col("type") == "clause") & F.col("bold_body"))
        | (F.col("type").isin("clause", "appendix") & has_mandatory(F.col("text"), profile))
    )
    return grouped.select(
        "doc_id", "seg", "chapter", "section", opener["label"].alias("clause"), "type", "text",
        "page_start", "page_end", mandatory.alias("is_mandatory"),
    )


def pack_paragraphs(text: Column, limit: int) -> Column:
    """Greedy packing of trimmed paragraphs; joining breaks do not count, one long paragraph stays whole."""
    paragraphs = F.filter(F.transform(F.split(text, "\n", -1), strip), lambda p: p != "")
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n")
    )

    def step(acc: Column, p: Column) -> Column:
        full = (acc["n"] > 0) & (acc["n"] + F.length(p) > limit)
        return F.when(
            full, F.struct(F.array_append(acc["done"], acc["cur"]).alias("done"), p.alias("cur"), F.length(p).alias("n"))
        ).otherwise(
            F.struct(
                acc["done"].alias("done"),
                F.when(acc["n"] == 0, p).otherwise(F.concat_ws("\n", acc["cur"], p)).alias("cur"),
                (acc["n"] + F.length(p)).alias("n"),
            )
        )

    return F.aggregate(
        paragraphs, start, step,
        lambda acc: F.when(acc["n"] > 0, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]),
    )


def split_long(segments: DataFrame, profile: StructureProfile = STANDARDS) -> DataFrame:
    """Cut clause and appendix texts over the limit; the pieces get the suffixes -1, -2, ... and a piece number."""
    long = F.col("type").isin("clause", "appendix") & (F.length("text") > profile.max_chunk)
    pieces = F.when(long, pack_paragraphs(F.col("text"), profile.max_chunk)).otherwise(F.array("text"))
    cut = segments.withColumn("_long", long).select(
        *[c for c in segments.columns if c not in ("text", "clause")], "clause", "_long",
        F.posexplode_outer(pieces).alias("_i", "text"),
    )
    piece = F.col("_i") + 1
    return cut.select(
        *[c for c in segments.columns if c not in ("text", "clause")],
        F.when(F.col("_long"), F.concat("clause", F.lit("-"), piece.cast("string"))).otherwise(F.col("clause")).alias("clause"),
        piece.alias("piece"), "text", F.length("text").alias("char_count"),
    )


def number_copies(chunks: DataFrame, code: Column) -> DataFrame:
    """chunk_id = code#clause, with _dN for the N-th repeat inside the document; adds seq, the chunk order."""
    numbered = chunks.withColumn("_base", F.concat(code, F.lit("#"), F.col("clause")))
    order = [F.col("seg"), F.col("piece")]
    repeat = F.row_number().over(Window.partitionBy("doc_id", "_base").orderBy(*order)) - 1
    return (
        numbered.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
        .withColumn("_n", repeat)
        .withColumn(
            "chunk_id", F.when(F.col("_n") > 0, F.concat("_base", F.lit("_d"), F.col("_n").cast("string")))
            .otherwise(F.col("_base")),
        )
        .drop("_base", "_n")
    )


def merge_short(chunks: DataFrame, profile: StructureProfile = STANDARDS) -> DataFrame:
    """Glue a short clause in front of the next clause of its section.

    A merged chunk is not tested again, so of a run of gluable rows every odd one starts a merge and the row
    after it is swallowed.  The position in the run is the distance to the last row that cannot glue.
    """
    order = Window.partitionBy("doc_id").orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    nxt = {c: F.lead(c).over(order) for c in ("type", "section", "chapter", "clause", "text", "is_mandatory", "char_count", "page_end")}
    glues = (
        (F.col("type") == "clause") & (F.col("char_count") < profile.min_chunk)
        & F.coalesce(nxt["type"] == "clause", F.lit(False)) & F.col("section").eqNullSafe(nxt["section"])
    )
    marked = chunks.select("*", glues.alias("_glue"), *[v.alias(f"_next_{k}") for k, v in nxt.items()])
    stop = F.coalesce(F.last(F.when(~F.col("_glue"), F.col("seq")), ignorenulls=True).over(upto), F.lit(0))
    marked = marked.withColumn("_start", F.col("_glue") & ((F.col("seq") - stop) % 2 == 1))
    marked = marked.withColumn("_gone", F.coalesce(F.lag("_start").over(order), F.lit(False)))
    start = F.col("_start")
    merged = {
        "chapter": F.col("_next_chapter"),
        "clause": F.concat_ws("+", "clause", "_next_clause"),
        "text": F.concat_ws("\n", "text", "_next_text"),
        "is_mandatory": F.col("is_mandatory") | F.col("_next_is_mandatory"),
        "char_count": F.col("char_count") + F.col("_next_char_count") + 1,
        "page_end": F.col("_next_page_end"),
    }
    return marked.filter(~F.col("_gone")).select(
        *[F.when(start, merged[c]).otherwise(F.col(c)).alias(c) if c in merged else F.col(c) for c in chunks.columns]
    )


def chunk_lines(
    lines: DataFrame, code: Column, profile: StructureProfile = STANDARDS, article: bool = False
) -> DataFrame:
    """Chunks of all documents in one reading mode."""
    segments = assemble(carry_structure(line_kinds(lines, profile, article)), profile)
    return merge_short(number_copies(split_long(segments, profile), code), profile)


def chunk_documents(
    lines: DataFrame, code: Column, profile: StructureProfile = STANDARDS,
    store: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Chunks in the better mode per document: decimal, unless it gives few and article mode gives more.

    Only the documents with few decimal chunks are read in article mode; counts travel, texts do not.  `store` writes a
    frame and reads it again: the chunks of a mode are read more than once, and would be computed anew each time.
    """
    decimal = store(chunk_lines(lines, code, profile).withColumn("mode", F.lit("decimal")))
    n_decimal = decimal.groupBy("doc_id").agg(F.count("*").alias("_d"))
    few = lines.select("doc_id").distinct().join(n_decimal, "doc_id", "left").select(
        "doc_id", F.coalesce("_d", F.lit(0)).alias("_d")).filter(F.col("_d") < profile.few_chunks)
    article = store(chunk_lines(lines.join(few.select("doc_id"), "doc_id", "left_semi"), code, profile, article=True).withColumn(
        "mode", F.lit("article")))
    more = article.groupBy("doc_id").agg(F.count("*").alias("_a")).join(few, "doc_id").filter(F.col("_a") > F.col("_d")).select("doc_id")
    return decimal.join(more, "doc_id", "left_anti").unionByName(article.join(more, "doc_id", "left_semi"))


def parse_title(file_name: Column) -> Column:
    """struct(code, name) from `code《name》`; both null where the name has another shape."""
    clean = strip(file_name)
    pattern = r"^([^《]+?)\s*《([^》]+)》"
    code = F.translate(strip(F.regexp_extract(clean, pattern, 1)), "：　—–", ": --")
    for old, new in ((r":T(?=\d)", "/T "), (r"T\+(?=\d)", "T "), (r"^GBT\s+", "GB/T ")):
        code = F.regexp_replace(code, old, new)
    code = F.regexp_replace(code, r"([A-Z\x{4e00}-\x{9fff}])(?=\d)", "$1 ")
    code = strip(F.regexp_replace(code, r"\s+", " "))
    found = clean.rlike(pattern)
    return F.struct(
        F.when(found, code).alias("code"),
        F.when(found, strip(F.regexp_extract(clean, pattern, 2))).alias("name"),
    )


def chunk_stats(chunks: DataFrame, keys: list[str], type_col: str, text_len: str, mandatory: str) -> DataFrame:
    """Per document: chunk count, counts by type, mandatory count, shortest, longest and mean length."""
    by_type = chunks.groupBy(*keys, type_col).agg(
        F.count("*").alias("n"), F.count_if(mandatory).alias("m"), F.min(text_len).alias("lo"),
        F.max(text_len).alias("hi"), F.sum(text_len).alias("total"),
    )
    return by_type.groupBy(*keys).agg(
        F.sum("n").alias("chunks_total"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(type_col, "n")))).alias("by_type"),
        F.sum("m").alias("mandatory_count"), F.min("lo").alias("char_min"), F.max("hi").alias("char_max"),
        F.round(F.sum("total") / F.sum("n"), 1).alias("char_avg"),
    )
