"""The numbers behind each chart: densities, box plots, rate lines, stacked shares, heat maps."""

from __future__ import annotations

import math
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import column
from ..functions.numeric import ratio
from ..sources.shared import write_shared
from .levels import global_rate_of
from .ordering import running_totals
from .ranks import QUARTILES, histogram_quantiles, value_histogram

HISTOGRAM_BINS = 50
BLOCK_WIDTH = 1024
CURVE_POINTS = 1000
# exp(-z²/2) is zero in double precision beyond this many bandwidths
KERNEL_REACH = 38.7
CELL = 0.5  # of a bandwidth
TERMS = 25  # an odd number, so that the last power is even and no truncated kernel is negative


def _winsorised(histogram: DataFrame, limits: tuple[float, float]) -> tuple[DataFrame, float | None, float | None]:
    """(v, n) clipped to two exact quantiles, and the two limits; the limits may repeat."""
    low, high = histogram_quantiles(histogram, {"n": limits})["n"]
    clipped = F.least(F.greatest(F.col("v"), F.lit(low)), F.lit(high))
    known = histogram.where(F.col("v").isNotNull())
    return known.select(clipped.alias("v"), "n"), low, high


def density_histogram(
    df: DataFrame, variable: str, limits: tuple[float, float] = (0.01, 0.99), bins: int = HISTOGRAM_BINS
) -> DataFrame:
    """(bin_id, lo, hi, effectif, densite): equal-width bins of the winsorised column.

    The last bin is closed. A constant column gets a range of one around its value.
    """
    values, low, high = _winsorised(value_histogram(df, variable), limits)
    if low is None:
        low, high = 0.0, 1.0
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    slot = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("long")
    counts = values.groupBy(slot.alias("bin_id")).agg(F.sum("n").alias("effectif"))
    total = counts.agg(F.sum("effectif")).scalar()
    filled = F.coalesce(F.col("effectif"), F.lit(0))
    edge = F.lit(low) + F.col("id") * F.lit(width)
    return (
        df.sparkSession.range(bins)
        .join(counts, F.col("id") == F.col("bin_id"), "left")
        .select(
            F.col("id").alias("bin_id"),
            edge.alias("lo"),
            (edge + F.lit(width)).alias("hi"),
            filled.alias("effectif"),
            ratio(filled, total * F.lit(width)).alias("densite"),
        )
    )


def density_curve(
    df: DataFrame, variable: str, limits: tuple[float, float] = (0.01, 0.99), points: int = CURVE_POINTS
) -> DataFrame:
    """(point_id, x, densite): Gaussian kernel density of the winsorised column, Scott bandwidth,
    on a grid half a range wider on each side.

    Values are summed up as moments of cells half a bandwidth wide, and only cells meet grid points:
    with d the offset in its cell and t the distance of a point from the cell's centre, both in
    bandwidths, exp(-(t - d)²/2) = exp(-t²/2) Σ tʲ · exp(-d²/2) dʲ/j!. What is left out after the
    terms kept is below exp(-t²/2 + |td|) |td|ᵖ/p!, with |d| at most 1/4 and 25 terms below 1e-27 of
    a kernel's peak. The cells that hold values grow with the fifth root of the rows.

    A constant column gets a range of one around its value and the grid's step as bandwidth; a
    column without values has no rows.
    """
    spark = df.sparkSession
    values, low, high = _winsorised(value_histogram(df, variable), limits)
    v, n = F.col("v"), F.col("n")
    if low is None:
        return spark.createDataFrame([], "point_id long, x double, densite double")
    mean = values.agg(ratio(F.sum(v * n), F.sum(n))).scalar()
    size, squares = values.agg(F.sum(n), F.sum(n * (v - mean) * (v - mean))).first()
    constant = low == high
    if constant:
        low, high = low - 0.5, high + 0.5
    start, step = low - 0.5 * (high - low), 2 * (high - low) / (points - 1)
    bandwidth = step if constant else math.sqrt(squares / (size - 1)) * size ** (-1 / 5)

    cell = F.floor((v - F.lit(low)) / F.lit(CELL * bandwidth))
    offset = (v - F.lit(low)) / F.lit(bandwidth) - (F.col("cell") + 0.5) * F.lit(CELL)
    weight = n * F.exp(-0.5 * F.col("d") * F.col("d"))
    moments = [
        (F.sum(F.col("weight") * F.pow("d", F.lit(j))) / F.lit(float(math.factorial(j)))).alias(f"m{j}") for j in range(TERMS)
    ]
    cells = (
        values.withColumn("cell", cell).withColumn("d", offset).withColumn("weight", weight).groupBy("cell").agg(*moments)
    )

    centre = F.lit(low) + (F.col("cell") + 0.5) * F.lit(CELL * bandwidth)
    reach = (KERNEL_REACH + CELL / 2) * bandwidth

    def place(x, rounded):
        return F.least(F.greatest(rounded((x - F.lit(start)) / F.lit(step)), F.lit(-1)), F.lit(points)).cast("int")

    first = F.greatest(place(centre - F.lit(reach), F.ceil), F.lit(0))
    last = F.least(place(centre + F.lit(reach), F.floor), F.lit(points - 1))
    near = cells.withColumns({"centre": centre, "a": first, "b": last}).where("a <= b")
    met = near.withColumn("point_id", F.explode(F.sequence("a", "b"))).withColumn(
        "t", (F.lit(start) + F.col("point_id") * F.lit(step) - F.col("centre")) / F.lit(bandwidth)
    )
    t = F.col("t")
    series = F.col(f"m{TERMS - 1}")
    for j in reversed(range(TERMS - 1)):
        series = series * t + F.col(f"m{j}")
    parts = met.groupBy(F.col("point_id").cast("long").alias("point_id")).agg(F.sum(series * F.exp(-0.5 * t * t)).alias("part"))
    scale = size * bandwidth * math.sqrt(2 * math.pi)
    grid = spark.range(points).withColumnRenamed("id", "point_id").join(parts, "point_id", "left")
    return grid.select(
        "point_id",
        (F.lit(start) + F.col("point_id") * F.lit(step)).alias("x"),
        (F.coalesce("part", F.lit(0.0)) / F.lit(scale)).alias("densite"),
    )


def box_statistics(df: DataFrame, variable: str, target: str) -> DataFrame:
    """One row per class: quartiles, whiskers (furthest points within 1.5 IQR), outlier count."""
    histogram = value_histogram(df, variable, target)
    quartiles = histogram_quantiles(histogram, {"n0": QUARTILES, "n1": QUARTILES})
    v = F.col("v")
    sides = []
    for label, count in ((0, "n0"), (1, "n1")):
        q1, q2, q3 = (F.lit(q).cast("double") for q in quartiles[count])
        fence = 1.5 * (q3 - q1)
        held = F.col(count) > 0
        inside = held & (v >= q1 - fence) & (v <= q3 + fence)
        sides.append(
            F.struct(
                F.lit(label).alias("classe"),
                F.coalesce(F.sum(F.when(v.isNotNull(), F.col(count))), F.lit(0)).alias("effectif"),
                q1.alias("q1"),
                q2.alias("mediane"),
                q3.alias("q3"),
                # a whisker never crosses into its box
                F.least(F.min(F.when(inside, v)), q1).alias("moustache_basse"),
                F.greatest(F.max(F.when(inside, v)), q3).alias("moustache_haute"),
                F.coalesce(F.sum(F.when(held & v.isNotNull() & ~inside, F.col(count))), F.lit(0)).alias("nb_extremes"),
            )
        )
    return histogram.agg(F.array(*sides).alias("sides")).select(F.explode("sides").alias("s")).select("s.*")


def level_bars(levels: DataFrame, variable: str) -> DataFrame:
    """Bars with their default rate and the global rate as a reference line."""
    overall = global_rate_of(levels).select("taux_global_%").scalar()
    return levels.select(
        column(variable), "effectif", column("taux_defaut_%"), overall.alias("taux_global_%")
    )


def rate_by_month(monthly: DataFrame, month: str, variable: str, levels: list | None = None) -> DataFrame:
    """One row per month, one column per level; months or levels without any rate vanish.

    Levels become columns, so this is for a level list that is short; `rate_blocks` takes any.
    """
    rated = monthly.where(column("taux_defaut_%").isNotNull())
    grouped = rated.groupBy(column(month))
    pivoted = grouped.pivot(variable, levels) if levels else grouped.pivot(variable)
    return pivoted.agg(F.first(column("taux_defaut_%")))


def heat_map(monthly: DataFrame, month: str, variable: str, months: list | None = None) -> DataFrame:
    """One row per level, one column per month; `rate_blocks` takes any number of months."""
    rated = monthly.where(column("taux_defaut_%").isNotNull())
    grouped = rated.groupBy(column(variable))
    pivoted = grouped.pivot(month, months) if months else grouped.pivot(month)
    return pivoted.agg(F.first(column("taux_defaut_%")))


def rate_blocks(monthly: DataFrame, down: str, across: str, width: int = BLOCK_WIDTH) -> tuple[DataFrame, DataFrame]:
    """The wide table of rates for any number of columns, cut into blocks of `width` columns.

    Returns the dictionary (block, place, `across`) of the columns in their order, and one row per
    value of `down` and block that holds a rate, (`down`, block, cells): `cells` is an array as long
    as the block has columns, NULL where there is no rate. No cell grows with the number of columns, and no
    column name reaches the driver. Pairs without a rate leave as in `rate_by_month`; without any
    rate both tables are empty.
    """
    if width < 1:
        raise ValueError("a block needs at least one column")
    d, a = column(down), column(across)
    rated = monthly.where(d.isNotNull() & a.isNotNull() & column("taux_defaut_%").isNotNull())
    cells = write_shared(rated.select(d.alias("_d"), a.alias("_a"), column("taux_defaut_%").alias("_t")))
    names = write_shared(cells.select("_a").distinct().withColumn("one", F.lit(1).cast("long")))
    placed = running_totals(names, [F.col("_a").asc()], ["one"]).select(
        "_a",
        F.floor(F.col("one_before") / width).alias("block"),
        (F.col("one_before") % width).cast("int").alias("place"),
    )
    dictionary = write_shared(placed)
    sizes = F.max("place") + 1
    longest = dictionary.groupBy("block").agg(sizes.alias("_columns"))
    held = cells.join(dictionary, "_a").groupBy("_d", "block").agg(
        F.map_from_entries(F.collect_list(F.struct("place", "_t"))).alias("_rates")
    )
    listed = F.transform(F.sequence(F.lit(0), F.col("_columns") - 1), lambda i: F.try_element_at("_rates", i))
    blocks = held.join(longest, "block").select(F.col("_d").alias(down), "block", listed.alias("cells"))
    return dictionary.select("block", "place", F.col("_a").alias(across)), blocks


def heat_map_cells(monthly: DataFrame, month: str, variable: str) -> DataFrame:
    """Long heat map with the light/dark choice: text is white above the mean of all cells."""
    rate = column("taux_defaut_%")
    mean = monthly.agg(F.avg(rate)).scalar()
    return monthly.where(rate.isNotNull()).select(
        column(month),
        column(variable),
        rate,
        F.when(rate > mean, F.lit("white")).otherwise(F.lit("black")).alias("texte"),
    )


def stacked_shares(
    monthly: DataFrame,
    month: str,
    variable: str,
    count: str = "effectif",
) -> DataFrame:
    """Shares with the lower edge of each bar piece, stacked in level order within a month.

    Counts are accumulated over (month, level) and the month's own start is taken off, so a
    month with any number of levels is never one task's work.
    """
    m, v, n = column(month), column(variable), column(count)
    pieces = write_shared(monthly.groupBy(m, v).agg(F.sum(n).alias("n")))
    stacked = running_totals(pieces, [m.asc(), v.asc()], ["n"])
    months = stacked.groupBy(m).agg(F.min("n_before").alias("_start"), F.sum("n").alias("_size"))
    return stacked.join(months, month).select(
        m,
        v,
        (ratio(F.col("n"), F.col("_size")) * 100).alias("part_%"),
        (ratio(F.col("n_before") - F.col("_start"), F.col("_size")) * 100).alias("base_%"),
    )
