"""Skew-safe building blocks shared by the operators.

One key may hold a third of all rows, so nothing here sorts or collects a whole group in one task unless the
group is bounded: rankings are cut per task before the shuffle, numberings and running values are computed in
blocks and stitched together with per-block summaries, and percentiles are bracketed by a mergeable sketch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 32 << 20
"""Bytes below which a side may be broadcast; beyond it the join is left to shuffle."""

BROADCAST_ROWS = 100_000
"""Words of a query set below which they are broadcast."""

BLOCK = 1 << 20
"""Rows per block that a task sorts for one key."""

MOST_ORDERED = 100_000
"""Distinct values of a key that one task orders for an order statistic."""

CELLS, CELL_ACCURACY = 64, 10_000
"""Cells into which a larger bracket is cut, and the accuracy of the sketch that places their borders."""

MAX_RANGES = 4096
"""Id ranges at most; beyond MAX_RANGES * BLOCK rows the ranges grow."""


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key; the literal cut lets Spark limit each task's groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order."""
    return top_k(df, keys, order, 1, "_rn").drop("_rn")


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: texts as long as they are, other columns by their usual width."""
    total = F.lit(16)
    for field in df.schema.fields:
        kind = field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(field.name), F.lit(0)) + 8
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            total = total + F.greatest(F.size(field.name), F.lit(0)) * 24 + 16
        else:
            total = total + (64 if isinstance(kind, T.StructType) else 8)
    return total


def is_small(df: DataFrame, max_bytes: int | None = None) -> bool:
    """Whether a frame has at most so many bytes, reading no more rows than can fit."""
    bound = BROADCAST_BYTES if max_bytes is None else max_bytes
    measured = df.limit(bound // 16 + 1).agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()[0]
    return measured <= bound


def broadcast_if(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast hint when the frame is small; otherwise leave the choice to the optimizer.

    With a known bound on the rows of a frame without texts its bytes follow; else they are measured.
    """
    texts = any(isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType)) for f in df.schema.fields)
    if rows is not None and not texts:
        return F.broadcast(df) if rows * (16 + 64 * len(df.columns)) <= BROADCAST_BYTES else df
    return F.broadcast(df) if is_small(df) else df


def number_rows(
    df: DataFrame, keys: Sequence[str], id_col: str, out: str, width: int = BLOCK
) -> DataFrame:
    """1-based position of each row among the rows of its key, ordered by a unique integer id.

    Rows are numbered inside (key, id range) and shifted by the sizes of the earlier ranges.  The borders of the ranges
    come from a quantile sketch of all ids, so a range holds about `width` rows whatever the ids are, and a hot key is
    spread over as many tasks as it has ranges.  Keys must not be null.
    """
    counted = df.agg(F.count("*").alias("n")).first()[0]
    n_ranges = min(MAX_RANGES, -(-counted // width))
    if n_ranges > 1:
        shares = [i / n_ranges for i in range(1, n_ranges)]
        borders = sorted(set(df.agg(F.percentile_approx(id_col, shares, 10 * n_ranges)).first()[0]))
        block = F.size(F.filter(F.lit(borders), lambda b: b < F.col(id_col)))
    else:
        block = F.lit(0)
    blocked = df.withColumn("_blk", block)
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        blocked.groupBy(*keys, "_blk").agg(F.count("*").alias("_n"))
        .select(*keys, "_blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    inside = Window.partitionBy(*keys, "_blk").orderBy(id_col)
    return (
        blocked.withColumn("_pos", F.row_number().over(inside))
        .join(shifts, [*keys, "_blk"])
        .withColumn(out, F.col("_pos") + F.col("_shift"))
        .drop("_blk", "_pos", "_shift")
    )


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: str, out: str
) -> DataFrame:
    """Latest non-null value at or before each row of its key.

    `block` must grow with the order and bound the rows of one (key, block).  The last value of each block is
    found by a partial aggregate, carried over the block summaries and used where a block has none of its own.
    """
    blocked = df.withColumn("_blk", block)
    last = (
        blocked.filter(F.col(value).isNotNull()).groupBy(*keys, "_blk")
        .agg(F.max_by(value, F.struct(*order)).alias("_last"))
    )
    ends = blocked.select(*keys, "_blk").distinct().join(last, [*keys, "_blk"], "left")
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_blk", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    inside = Window.partitionBy(*keys, "_blk").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        blocked.withColumn("_own", F.last(value, ignorenulls=True).over(running))
        .join(carried, [*keys, "_blk"])
        .withColumn(out, F.coalesce("_own", "_carry"))
        .drop("_blk", "_own", "_carry")
    )


def index_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, percentiles: Sequence[float], accuracy: int = 10_000,
    most: int = MOST_ORDERED, store: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Exact order statistic sorted[min(n-1, int(n*p))] per key: columns keys, p, n, value.

    A quantile sketch (merged map-side) gives two values that surely enclose the wanted rank.  Rows below the
    lower one are only counted.  While the bracket may hold over `most` distinct values, which follows from the rows of the
    largest key, it is cut into cells, and the counts of the cells tell which of them has the rank.  So no task orders
    more than `most` values of a key.  With `store`, each narrowed bracket is written and read again.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    slack = 3.0 / accuracy
    lows = [max(0.0, p - slack) for p in percentiles]
    highs = [min(1.0, p + slack) for p in percentiles]
    sketch = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min(value).alias("_min"),
        F.max(value).alias("_max"),
        F.percentile_approx(value, lows, accuracy).alias("_lo"),
        F.percentile_approx(value, highs, accuracy).alias("_hi"),
    )
    rows = [
        F.struct(
            F.lit(float(p)).alias("p"),
            F.when(F.lit(lows[i] <= 0.0), F.col("_min")).otherwise(F.col("_lo")[i]).alias("lo"),
            F.when(F.lit(highs[i] >= 1.0), F.col("_max")).otherwise(F.col("_hi")[i]).alias("hi"),
        )
        for i, p in enumerate(percentiles)
    ]
    wanted = sketch.select(*keys, "n", F.inline(F.array(*rows))).withColumn(
        "_at", F.least(F.col("n") - 1, F.floor(F.col("n") * F.col("p")))
    )
    small = is_small(df.select(*keys).distinct(), BROADCAST_BYTES // len(percentiles))
    joined = counts.join(F.broadcast(wanted) if small else wanted, list(keys))
    below = (
        joined.filter(F.col(value) < F.col("lo")).groupBy(*keys, "p").agg(F.sum("_c").alias("_below"))
    )
    inside = F.col(value).between(F.col("lo"), F.col("hi"))
    held, most = _held(df.filter(F.col(value).isNotNull()), keys, accuracy), max(most, CELLS)
    if held <= most:
        inner = joined.filter(inside).join(below, [*keys, "p"], "left").withColumn("_below", F.coalesce("_below", F.lit(0)))
    else:
        wanted = wanted.join(below, [*keys, "p"], "left").withColumn("_below", F.coalesce("_below", F.lit(0)))
        while held > most:
            wanted = _narrowed(counts, wanted, keys, value)
            wanted = store(wanted) if store else wanted
            held = held * (1 / CELLS + 2 / CELL_ACCURACY) + 2
        inner = counts.join(F.broadcast(wanted) if small else wanted, list(keys)).filter(inside)
    w = Window.partitionBy(*keys, "p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        inner.withColumn("_upto", F.col("_below") + F.sum("_c").over(w))
        .filter(F.col("_upto") > F.col("_at"))
        .groupBy(*keys, "p").agg(F.first("n").alias("n"), F.min(value).alias(value))
    )


def _held(df: DataFrame, keys: Sequence[str], accuracy: int) -> float:
    """Distinct values that the bracket of a key holds at most: its slack and the error of the sketch on either side."""
    largest = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return min(largest, largest * 8 / accuracy + 2)


def _narrowed(counts: DataFrame, wanted: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The brackets cut down to one of CELLS cells, which hold about as many distinct values each; counts are exact."""
    own = [*keys, "p"]
    held = counts.join(wanted, list(keys)).filter(F.col(value).between(F.col("lo"), F.col("hi")))
    grid = held.groupBy(*own).agg(
        F.percentile_approx(value, [i / CELLS for i in range(1, CELLS)], CELL_ACCURACY).alias("_grid"))
    placed = held.join(grid, own).withColumn("_cell", F.size(F.filter("_grid", lambda g: g < F.col(value))))
    cells = placed.groupBy(*own, "_cell").agg(
        F.sum("_c").alias("_in"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.first("n").alias("n"),
        F.first("_at").alias("_at"), F.first("_below").alias("_below"))
    w = Window.partitionBy(*own).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)  # at most CELLS rows
    upto = cells.withColumn("_upto", F.col("_below") + F.sum("_in").over(w))
    return upto.filter((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_in") <= F.col("_at"))).select(
        *keys, "n", "p", "lo", "hi", "_at", (F.col("_upto") - F.col("_in")).alias("_below"))


def in_blocks(df: DataFrame, keys: Sequence[str], pos: str, before: int, width: int = BLOCK) -> DataFrame:
    """Adds _blk and _copy so that a frame of `before` preceding rows can be computed inside (keys, _blk).

    pos numbers the rows of a key without gaps.  The last `before` rows of a block are copied into the next one;
    rows with _copy set only feed frames and must be filtered out afterwards.
    """
    blk = F.floor((F.col(pos) - 1) / width)
    near_end = (F.col(pos) - 1) % width >= width - before
    places = F.when(near_end, F.array(F.struct(blk.alias("_blk"), F.lit(False).alias("_copy")),
                                      F.struct((blk + 1).alias("_blk"), F.lit(True).alias("_copy")))).otherwise(
        F.array(F.struct(blk.alias("_blk"), F.lit(False).alias("_copy")))
    )
    return df.select("*", F.inline(places))
