"""Which documents contain a passage word for word."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions.text import WORD
from clauselake.operators.scale import is_small

GRAM = 4


def _word_grams(col: Column, n: int) -> Column:
    """Distinct runs of n words."""
    starts = F.when(F.size(col) >= n, F.sequence(F.lit(1), F.size(col) - (n - 1))).otherwise(
        F.array().cast("array<int>")
    )
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(col, i, n), " ")))


def _char_grams(col: Column, n: int) -> Column:
    """Distinct runs of n characters."""
    starts = F.when(F.length(col) >= n, F.sequence(F.lit(1), F.length(col) - (n - 1))).otherwise(
        F.array().cast("array<int>")
    )
    return F.array_distinct(F.transform(starts, lambda i: col.substr(i, F.lit(n))))


def containing(
    docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", passage_id: str = "query_id",
    carry: Sequence[str] = (),
) -> DataFrame:
    """(passage, document, pos, carried document columns): where the document text holds the passage text, and its first place.

    The first and last word of a passage may be cut, but every inner run of words must appear in the document,
    so pairs meet on one inner four-word run (the longest) and only those are compared in full.  Passages too
    short for that meet on a run of up to three characters.
    """
    docs = docs.select(doc_id, *carry, F.col("text").alias("_text"))
    kept = [doc_id, *carry]
    split = passages.select(
        passage_id, F.col("text").alias("_passage"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("_w")
    ).withColumn("_grams", _word_grams(F.slice("_w", 2, F.greatest(F.size("_w") - 2, F.lit(0))), GRAM))
    small = is_small(passages.select(passage_id, "text"))
    longest = F.array_max(F.transform("_grams", lambda g: F.struct(F.length(g).alias("n"), g.alias("g"))))["g"]
    long_ones = split.filter(F.size("_grams") > 0).select(passage_id, "_passage", longest.alias("_gram"))
    short_ones = split.filter((F.size("_grams") == 0) & (F.length("_passage") > 0)).select(
        passage_id, "_passage"
    )
    worded = docs.withColumn("_w", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    found = _meet(worded, _word_grams(F.col("_w"), GRAM), long_ones, small, kept, passage_id)
    lengths = short_ones.select(F.least(F.length("_passage"), F.lit(3)).alias("n")).distinct()
    for n in sorted(r["n"] for r in lengths.collect()):  # at most 1, 2 and 3
        some = short_ones.filter(F.least(F.length("_passage"), F.lit(3)) == n).withColumn(
            "_gram", F.substring("_passage", 1, n)
        )
        found = found.union(_meet(docs, _char_grams(F.col("_text"), n), some, small, kept, passage_id))
    return found


def _meet(
    docs: DataFrame, grams: Column, passages: DataFrame, small: bool, kept: list[str], passage_id: str
) -> DataFrame:
    """Pairs sharing the passage's run, then checked in full."""
    if small:
        runs = docs.select(*kept, "_text", F.explode_outer(grams).alias("_gram"))
        pairs = runs.join(F.broadcast(passages), "_gram")
    else:  # keep the text out of the shuffle by run and fetch it for the candidates
        doc_id = kept[0]
        runs = docs.select(doc_id, F.explode_outer(grams).alias("_gram"))
        pairs = runs.join(passages, "_gram").join(docs.select(*kept, "_text"), doc_id)
    at = F.instr("_text", F.col("_passage"))
    return pairs.select(passage_id, *kept, at.alias("pos")).filter(F.col("pos") > 0)
