"""Column expressions shared by every table: rounding, ratios, logs, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shares are floored here before a logarithm is taken.
SHARE_FLOOR = 1e-10

# Upper bounds and wording of the information-value classes.
IV_CLASSES = [
    (0.02, "Non prédictif"),
    (0.1, "Faiblement prédictif"),
    (0.3, "Moyennement prédictif"),
    (0.5, "Fortement prédictif"),
]
IV_ABOVE = "Suspicieusement prédictif (vérifier)"

# Upper bounds and wording of the population-stability classes.
PSI_CLASSES = [(0.1, "Stable"), (0.2, "Dérive légère")]
PSI_ABOVE = "Dérive significative"
PSI_ONE_PERIOD = "Non calculable (une seule période)"


def round_even(value: Column, digits: int) -> Column:
    """Round half to even on the scaled double, as numpy does (Spark's round is half-up).

    Adding 0.0 turns a negative zero into zero.
    """
    scale = float(10**digits)
    return F.rint(value * scale) / scale + 0.0


def rint_number(value: float | None, digits: int) -> float | None:
    """`round_even` for a single number."""
    scale = float(10**digits)
    return None if value is None else round(value * scale) / scale + 0.0


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double quotient; NULL for a zero denominator (plain `/` raises in ANSI mode)."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return round_even(ratio(part, whole) * 100, digits)


def floor_share(share: Column) -> Column:
    """Share floored away from zero; NULL stays NULL (greatest() would drop it)."""
    return F.when(share < SHARE_FLOOR, F.lit(SHARE_FLOOR)).otherwise(share)


def log_ratio(a: Column, b: Column) -> Column:
    return F.ln(floor_share(a) / floor_share(b))


def _classify(value: Column, classes: list[tuple[float, str]], above: str) -> Column:
    (bound, label), *rest = classes
    chain = F.when(value < bound, F.lit(label))
    for bound, label in rest:
        chain = chain.when(value < bound, F.lit(label))
    return chain.otherwise(F.lit(above))


def iv_class(iv: Column) -> Column:
    return _classify(iv, IV_CLASSES, IV_ABOVE)


def psi_class(psi: Column) -> Column:
    return _classify(psi, PSI_CLASSES, PSI_ABOVE)


def cuts_passed(value: Column, cuts: list[float], inclusive: bool) -> Column:
    """How many of the sorted `cuts` lie below `value` (or at it, when inclusive).

    A balanced tree of comparisons: log2(len(cuts)) tests per row, inside generated code.
    """

    def node(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        cut = F.lit(cuts[middle])
        passed = value >= cut if inclusive else value > cut
        return F.when(passed, node(middle + 1, high)).otherwise(node(low, middle))

    return node(0, len(cuts))
