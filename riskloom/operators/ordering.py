"""Running totals over a globally ordered table without funnelling it through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import write_shared


def running_totals(
    table: DataFrame, order: Sequence[Column], sums: Sequence[str], totals: bool = False, ranges: int | None = None
) -> DataFrame:
    """Add `<s>_before`, the sum of `s` over all earlier rows, and with `totals` also `<s>_all`,
    the sum over all rows.

    `table` should be cheap to read again (written or persisted) and unique on `order`.
    It is cut into contiguous ranges of the order at every size; the range number is stored with
    the rows, so the per-range offsets and the per-range windows always see the same cut. Ranges
    are dealt to tasks by their number, one to a task, and the window inside a range needs no
    further shuffle. The only unpartitioned window runs over one row per range. `ranges` sets their
    number, else it is the session's number of shuffle partitions.
    """
    cut = table.repartitionByRange(ranges, *order) if ranges else table.repartitionByRange(*order)
    sliced = write_shared(cut.withColumn("_slice", F.spark_partition_id()))
    earlier = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = (
        sliced.groupBy("_slice")
        .agg(*[F.sum(s).alias(s) for s in sums])
        .select(
            "_slice",
            *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_base_{s}") for s in sums],
            *[F.coalesce(F.sum(s).over(everything), F.lit(0)).alias(f"{s}_all") for s in sums if totals],
        )
    )
    upto = W.partitionBy("_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = sliced.repartitionByRange("_slice").withColumns(
        {f"{s}_before": F.sum(s).over(upto) - F.col(s) for s in sums}
    )
    return (
        inside.join(offsets, "_slice")
        .withColumns({f"{s}_before": F.col(f"_base_{s}") + F.col(f"{s}_before") for s in sums})
        .drop("_slice", *[f"_base_{s}" for s in sums])
    )
