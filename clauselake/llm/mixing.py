"""Mixing sources to target weights by weighted fair queueing.

The documents of a source are queued in shuffled order, twice over: a second round follows the first.  A copy's virtual
finish time is the number of words its source has queued up to its end, divided by the source's target.  All copies in
the order of their finish times, cut where the total budget is used up, are the mix; every source whose target can be
met then ends near its target, as all finish around time 1.

Nothing sorts a source or the whole queue in one task.  The shuffled order is cut into buckets by the head of the
shuffle key, and the finish times into bins; sums per bucket and per bin are added up first, and only the bin in which
the budget ends is sorted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.llm.common import WORD, free_name, join_groups, stored

# fixed values of the mix: weights of the sources in code point order, and its size as a share of all words, in halves
WEIGHTS = (3, 1, 2)
SHARE_HALVES = 3
ROUNDS = 2

PART_ROWS = 50_000
"""Copies that one bucket or bin is planned for."""


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """One row per source: source, source_rank, n_rows, source_size, target.

    Sources are ranked by code point, null last, and weigh `weights` in turn.  A target stops at twice its source's
    size; what is above goes to the other sources by weight.  With the sources in the order of size by weight, those
    that reach their limit come first, so one pass over the running sums finds them.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    by_code = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    common = math.lcm(*weights)
    ranked = per.withColumn("source_rank", F.row_number().over(by_code) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_rank") % len(weights) + 1).cast("int")).cast("long")
    ).withColumn("_fill", F.col("source_size") * F.expr(f"{common} div weight"))
    by_fill = Window.orderBy("_fill", "source_rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    filled = ranked.withColumn("_all", F.sum("source_size").over(everything)).withColumn(
        "_rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero)).withColumn(
        "_left", SHARE_HALVES * F.col("_all") - 2 * ROUNDS * F.coalesce(F.sum("source_size").over(before), zero)
    ).withColumn("_full", 2 * ROUNDS * F.col("source_size") * F.col("_rest") <= F.col("weight") * F.col("_left"))
    shared = filled.withColumn(
        "_open", F.sum(F.when(~F.col("_full"), F.col("weight"))).over(everything)).withColumn(
        "_words", SHARE_HALVES * F.col("_all") - 2 * ROUNDS * F.coalesce(
            F.sum(F.when(F.col("_full"), F.col("source_size"))).over(everything), zero))
    target = F.when(F.col("_full"), (ROUNDS * F.col("source_size")).cast("double")).otherwise(
        (F.col("weight") * F.col("_words")).cast("double") / (2 * F.col("_open")).cast("double"))
    return shared.select("source", "source_rank", "n_rows", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: int = 0) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, taken.

    taken is 0, 1 or 2 times the size.  The shuffle key is md5 of the seed and the id, ties go by id and size, so reruns
    agree; rows that repeat an id and a size are taken alike.  A null text has no words and is never taken, a null
    source is a source of its own, and an empty table gives no rows.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit(""))).cast("binary"))
    sizes = stored(docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"),
        word_count(docs[text_col].cast("string")).alias("size"), key.alias("key")), "mix-sizes")
    total, words = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = max(1, -(-total // PART_ROWS))
    digits = max(3, math.ceil(math.log(parts, 16)))
    named = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source")).alias("_source")
    sources = stored(source_targets(sizes), "mix-sources").withColumn("_source", named).drop("source")
    queued = join_groups(sizes.withColumn("_source", named), sources, "_source", "n_rows", total, "doc_id").withColumn(
        "bucket", F.substring("key", 1, digits))
    keys = ["source_rank", "bucket"]
    upto = Window.partitionBy("source_rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = queued.groupBy(*keys).agg(F.sum("size").alias("_n")).select(
        *keys, F.coalesce(F.sum("_n").over(upto), F.lit(0).cast("long")).alias("_start"))
    inside = Window.partitionBy(*keys).orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    ends = queued.withColumn("_inside", F.sum("size").over(inside)).join(starts, keys, "left").withColumn(
        "end", F.col("_start") + F.col("_inside"))
    timed = stored(ends.select(
        "doc_id", "source", "size", "source_size", "target", "source_rank", "key",
        *[F.try_divide((F.col("end") + r * F.col("source_size")).cast("double"), F.col("target")).alias(f"finish{r}")
          for r in range(ROUNDS)]), "mix-times")  # null where a source has no words
    grid = float(1024 * parts)

    def bin_of(time: Column) -> Column:
        return F.floor(time * grid)

    def order(r: int) -> Column:
        return F.struct(F.col(f"finish{r}").alias("finish"), "source_rank", "key", "doc_id", "size", F.lit(r).alias("round"))

    copies = timed.filter("size > 0").select("size", F.explode(F.array(*map(order, range(ROUNDS)))).alias("at"))
    copies = copies.withColumn("bin", bin_of(F.col("at.finish")))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # one row per bin
    sums = copies.groupBy("bin").agg(F.sum("size").alias("_n")).withColumn("_upto", F.sum("_n").over(before))
    last = sums.filter(2 * F.col("_upto") > SHARE_HALVES * words).agg(
        F.min_by(F.struct("bin", (F.col("_upto") - F.col("_n")).alias("used")), "bin")).first()[0]
    if last is None:
        taken = F.lit(ROUNDS).cast("long")
    else:
        running = Window.partitionBy("bin").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        fits = copies.filter(F.col("bin") == last["bin"]).withColumn("_upto", F.sum("size").over(running) + last["used"])
        cut = fits.filter(2 * F.col("_upto") <= SHARE_HALVES * words).agg(F.max("at")).first()[0]

        def in_mix(r: int) -> Column:
            early = bin_of(F.col(f"finish{r}")) < last["bin"]
            if cut is None:
                return early
            edge = F.struct(*[F.lit(v).cast(t).alias(n) for (n, t), v in zip(
                [("finish", "double"), ("source_rank", "int"), ("key", "string"), ("doc_id", "long"), ("size", "long"),
                 ("round", "int")], cut)])
            return early | (bin_of(F.col(f"finish{r}")) == last["bin"]) & (order(r) <= edge)

        taken = sum((F.when(in_mix(r), 1).otherwise(0) for r in range(ROUNDS)), F.lit(0)).cast("long")
    return timed.select("doc_id", "source", "size", "source_size", "target",
                        F.when(F.col("size") > 0, F.col("size") * taken).otherwise(F.lit(0).cast("long")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    seed: int = 0) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns."""
    shares = mix(docs, id_col, text_col, source_col, seed)
    names = [free_name(docs, f"_mix{i}") for i in range(4)]
    mine = docs.withColumns({
        names[0]: F.coalesce(docs[id_col].cast("string"), F.lit("")),
        names[1]: F.coalesce(F.concat(F.lit("="), docs[source_col].cast("string")), F.lit("")),
        names[2]: word_count(docs[text_col].cast("string"))})
    picked = shares.filter("taken > 0").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(names[0]),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias(names[1]),
        F.col("size").alias(names[2]), F.try_divide("taken", "size").cast("int").alias(names[3])).distinct()
    return mine.join(picked, names[:3]).withColumn(
        names[3], F.explode(F.array_repeat(F.lit(1), F.col(names[3])))).select(*docs.columns)
