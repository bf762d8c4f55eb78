"""Table loaders for the queries and the SQL fragments their oracles share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.numeric import round_even


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def loans(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as a loan table: target y, month, and a line number with missing values."""
    return table(spark, folder, "lineitem").withColumns(
        {
            "y": (F.col("l_returnflag") == "R").cast("int"),
            "mois": F.date_format("l_shipdate", "yyyy-MM"),
            "annee": F.year("l_shipdate"),
            "ligne": F.nullif(F.col("l_linenumber"), F.lit(7)),
            "quantite": F.nullif(F.col("l_quantity"), F.lit(25.0)),
        }
    )


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({name: round_even(F.col(f"`{name}`"), digits) for name in names})


def joined_text(array: str | Column) -> Column:
    return F.array_join(array, ",")


LOANS = """loans AS (
  SELECT *, CAST(l_returnflag = 'R' AS INTEGER) AS y, strftime(l_shipdate, '%Y-%m') AS mois,
         CAST(year(l_shipdate) AS INTEGER) AS annee,
         nullif(l_linenumber, 7) AS ligne, nullif(l_quantity, 25.0) AS quantite
  FROM lineitem)"""


def r(expression: str, digits: int) -> str:
    """Half-even rounding, without a negative zero."""
    scale = f"1e{digits}"
    return f"(round_even(({expression}) * {scale}, 0) / {scale} + 0.0)"


def pct(part: str, whole: str) -> str:
    return r(f"CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0) * 100", 2)


def floored(share: str) -> str:
    return f"greatest({share}, 1e-10)"


def levels_sql(source: str, level: str, name: str = "lv") -> str:
    """CTE: counts and rate per present level."""
    return f"""{name} AS (
  SELECT {level}, count(y) AS effectif, CAST(coalesce(sum(y), 0) AS BIGINT) AS nb_defaut,
         count(y) - CAST(coalesce(sum(y), 0) AS BIGINT) AS nb_non_defaut,
         {pct('sum(y)', 'count(y)')} AS "taux_defaut_%"
  FROM {source} WHERE {level} IS NOT NULL GROUP BY {level})"""


def woe_sql(source: str = "lv", iv: str = "IV_modalite", name: str = "woe") -> str:
    """CTE: shares, WoE and IV parts of a level table."""
    woe = r(f"ln({floored('dist_non_defaut')} / {floored('dist_defaut')})", 4)
    return f"""shares AS (
  SELECT *, CAST(nb_defaut AS DOUBLE) / (SELECT sum(nb_defaut) FROM {source}) AS dist_defaut,
         CAST(nb_non_defaut AS DOUBLE) / (SELECT sum(nb_non_defaut) FROM {source}) AS dist_non_defaut
  FROM {source}),
weights AS (SELECT *, {woe} AS "WoE" FROM shares),
{name} AS (SELECT *, {r('(dist_non_defaut - dist_defaut) * "WoE"', 6)} AS "{iv}" FROM weights)"""


IV_CASE = """CASE WHEN iv_total < 0.02 THEN 'Non prédictif' WHEN iv_total < 0.1 THEN 'Faiblement prédictif'
  WHEN iv_total < 0.3 THEN 'Moyennement prédictif' WHEN iv_total < 0.5 THEN 'Fortement prédictif'
  ELSE 'Suspicieusement prédictif (vérifier)' END"""

PSI_CASE = """CASE WHEN psi < 0.1 THEN 'Stable' WHEN psi < 0.2 THEN 'Dérive légère'
  ELSE 'Dérive significative' END"""


def psi_sql(cells: str, month: str, level: str, count: str) -> str:
    """Final SELECT: PSI between the first and last month of a month × level table."""
    return f"""SELECT {r('psi', 6)} AS psi, {PSI_CASE} AS interpretation, periode_ref, periode_act FROM (
  SELECT sum(({floored('act')} - {floored('ref')}) * ln({floored('act')} / {floored('ref')})) AS psi,
         any_value(first) AS periode_ref, any_value(last) AS periode_act
  FROM (SELECT coalesce(sum({count}) FILTER ({month} = first), 0) / CAST(any_value(n_first) AS DOUBLE) AS ref,
               coalesce(sum({count}) FILTER ({month} = last), 0) / CAST(any_value(n_last) AS DOUBLE) AS act,
               any_value(first) AS first, any_value(last) AS last
        FROM {cells}, (SELECT min({month}) AS first, max({month}) AS last FROM {cells}) e,
             (SELECT sum({count}) AS n_first FROM {cells} WHERE {month} = (SELECT min({month}) FROM {cells})) a,
             (SELECT sum({count}) AS n_last FROM {cells} WHERE {month} = (SELECT max({month}) FROM {cells})) b
        GROUP BY {level}))"""


def chi2_sql(cells: str) -> str:
    """CTEs: the test over a long contingency table (x, y, o), full grid, with the 2x2 correction."""
    return f"""mr AS (SELECT x, sum(o) AS rn FROM {cells} GROUP BY x),
mc AS (SELECT y, sum(o) AS cn FROM {cells} GROUP BY y),
size AS (SELECT CAST(sum(o) AS DOUBLE) AS n, count(DISTINCT x) AS nr, count(DISTINCT y) AS nc FROM {cells}),
grid AS (
  SELECT coalesce(c.o, 0) AS o, mr.rn * mc.cn / size.n AS e, size.n, size.nr, size.nc
  FROM mr CROSS JOIN mc CROSS JOIN size LEFT JOIN {cells} c ON c.x = mr.x AND c.y = mc.y),
test AS (
  SELECT any_value(n) AS n, (any_value(nr) - 1) * (any_value(nc) - 1) AS dof,
         sum(CASE WHEN nr = 2 AND nc = 2 THEN pow(abs(o - e) - least(0.5, abs(o - e)), 2) ELSE pow(o - e, 2) END / e) AS chi2,
         any_value(least(nr, nc)) - 1 AS k
  FROM grid)"""


def erfc_sql(x: str) -> str:
    """Complementary error function of a small argument, by its power series."""
    return f"""(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 90), lambda k:
      (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * k + 1) * ln(greatest(abs({x}), 1e-300)) - lgamma(k + 1)) / (2 * k + 1)))
      * sign({x}))"""
