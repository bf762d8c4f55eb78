"""Mixing sources to target weights, in DataFrame operations only.

Every row gets a hash-random key; inside its source it lies in a slice of the key range, and the
rows of a slice are sorted by key. Sums per slice, then a running sum over the slices and one
inside each slice, give each row the number of words before it in its source. The mix takes whole
epochs of a source and then the rows up to its exact budget, the last one in part.

A slice holds a bounded number of rows of one source whatever the source's share, so a source with
a third of all rows is spread over as many tasks as its slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.sources.shared import write_shared

from .common import word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
ROWS_PER_SLICE = 20_000
LEAST_SLICES = 64


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = MOST_EPOCHS
) -> DataFrame:
    """(source, source_size) with `target` and `budget` added.

    Sources ordered by code point, NULL last, take the weights in turn. A target stops at `epochs`
    times its source; what it leaves is dealt to the others by weight until none is above: sources
    sorted by epochs * size / weight are full up to one of them, and the level of the rest follows
    from two running sums. One row per source is all that the windows see.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn(
        "weight",
        F.element_at(
            F.array(*[F.lit(int(w)).cast("long") for w in weights]),
            (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"),
        ),
    ).withColumn("cap", F.col("source_size") * epochs)
    fill = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (
        F.lit(float(share)) * F.sum("source_size").over(everything)
        - F.coalesce(F.sum("cap").over(before), F.lit(0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # the level if this source and all after it are not full; the first that stays below its cap holds
    levels = ranked.withColumn("level", level).withColumn(
        "level",
        F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(everything)["level"],
    )
    target = F.when(
        F.col("level").isNull() | (F.col("level") * F.col("weight") >= F.col("cap")), F.col("cap").cast("double")
    ).otherwise(F.col("level") * F.col("weight"))
    return levels.select(
        "source", "source_size", target.alias("target"), F.floor(target + 0.5).cast("long").alias("budget")
    )


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    epochs: int = MOST_EPOCHS,
    seed: str = "mix",
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken.

    `taken` counts the words that the mix takes of the row, repeats included: whole epochs of the
    source, then a part of one more; within a source they add up to the rounded target. Empty and
    NULL texts have size 0 and are taken 0 times. NULL sources are one source of their own. Rows
    with equal ids are ordered by size and text hash, so repeated rows get results that do not
    depend on the run. An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(
        F.col(f"`{id_column}`").alias("doc_id"),
        F.col(f"`{source}`").alias("source"),
        word_count(F.col(f"`{text}`")).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")))).alias("key"),
        F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("tie"),
    )
    rows = write_shared(rows)
    sizes = write_shared(
        rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    )
    n = sizes.agg(F.sum("n")).first()[0] or 0
    slices = LEAST_SLICES
    while slices * ROWS_PER_SLICE < n:
        slices *= 2
    # the first 12 hex digits are a 48-bit number; equal parts of its range are the slices
    number = F.conv(F.substring("key", 1, 12), 16, 10).cast("long")
    sliced = rows.withColumn("slice", F.floor(number / F.lit(2**48 // slices)).cast("long"))
    offsets = (
        sliced.groupBy("source", "slice")
        .agg(F.sum("size").alias("words"))
        .withColumn(
            "slice_before",
            F.sum("words").over(
                W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, W.currentRow)
            )
            - F.col("words"),
        )
        .drop("words")
    )
    targets = source_targets(sizes.drop("n"), weights, share, epochs)
    offsets = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select(
        "o.source", "o.slice", "slice_before", "source_size", "target", "budget"
    )
    upto = W.partitionBy("source", "slice").orderBy("key", "doc_id", "size", "tie").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    inside = sliced.withColumn("before", F.sum("size").over(upto) - F.col("size"))
    joined = inside.alias("r").join(
        offsets.alias("o"),
        F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.slice") == F.col("o.slice")),
    )
    whole = F.floor(F.col("budget") / F.nullif(F.col("source_size"), F.lit(0))).cast("long")
    rest = F.col("budget") - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before") - F.col("slice_before")))
    return joined.select(
        "doc_id",
        F.col("r.source").alias("source"),
        "size",
        "tie",
        "source_size",
        "target",
        F.coalesce(whole * F.col("size") + part, F.lit(0)).cast("long").alias("taken"),
    )


def copies(size: Column, taken: Column) -> Column:
    """Words of each copy of a row in the mix: whole ones, then the part."""
    whole = F.floor(taken / F.nullif(size, F.lit(0))).cast("int")
    part = (taken - whole * size).cast("long")
    full = F.array_repeat(size.cast("long"), F.coalesce(whole, F.lit(0)))
    return F.when(part > 0, F.concat(full, F.array(part))).otherwise(full)
