"""Queries on categorical variables, their drift and their association."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom.operators import association, charts, cleaning, drift, levels, monthly as months, woe
from riskloom.plans.categorical import analyse_categorielle
from riskloom.sources.bundle import read_bundle, write_bundle
from riskloom.sources.shared import shared_folder

from .base import (
    IV_CASE,
    LOANS,
    PSI_CASE,
    chi2_sql,
    erfc_sql,
    floored,
    joined_text,
    levels_sql,
    loans,
    pct,
    psi_sql,
    r,
    rounded,
    table,
    woe_sql,
)

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


# --- frequencies ------------------------------------------------------------------------------


def _frequency_sql(source: str, level: str) -> str:
    return f"""
, c AS (SELECT {level}, count(*) AS effectif FROM {source} GROUP BY {level}),
h AS (SELECT *, CAST(round_even(CAST(effectif AS DOUBLE) / (SELECT sum(effectif) FROM c) * 100 * 100, 0) AS BIGINT) AS cents
      FROM c WHERE {level} IS NOT NULL)
SELECT {level}, effectif, cents / 100.0::DOUBLE AS "frequence_%",
       CAST(sum(cents) OVER (ORDER BY effectif DESC, {level} ROWS UNBOUNDED PRECEDING) AS BIGINT) / 100.0::DOUBLE AS "frequence_cum_%"
FROM h"""


@query(f"WITH {LOANS}" + _frequency_sql("loans", "ligne"))
def level_frequencies(spark, folder):
    return levels.frequency_table(loans(spark, folder), "ligne")


@query("WITH z AS (SELECT 1)" + _frequency_sql("orders", "o_custkey"))
def customer_frequencies(spark, folder):
    return levels.frequency_table(table(spark, folder, "orders"), "o_custkey")


@query(f"""WITH {LOANS}, c AS (SELECT ligne, count(*) AS n FROM loans GROUP BY ligne),
k AS (SELECT sum(n) AS n_total, coalesce(sum(n) FILTER (ligne IS NULL), 0) AS n_missing, count(ligne) AS n_modalites FROM c),
e AS (SELECT -sum(n / t * log2(n / t)) AS entropie FROM c, (SELECT CAST(sum(n) AS DOUBLE) AS t FROM c WHERE ligne IS NOT NULL)
      WHERE ligne IS NOT NULL)
SELECT CAST(n_total AS BIGINT) AS n_total, CAST(n_missing AS BIGINT) AS n_missing, {pct('n_missing', 'n_total')} AS pct_missing,
       n_modalites, {r('entropie', 6)} AS entropie,
       {r('entropie / CASE WHEN n_modalites > 1 THEN log2(n_modalites) ELSE 1 END', 6)} AS entropie_norm
FROM k, e""")
def level_entropy(spark, folder):
    return rounded(levels.entropy_table(loans(spark, folder), "ligne"), 6, "entropie", "entropie_norm")


@query(f"""WITH {LOANS}
SELECT variable, count(*) AS n_total, count(*) FILTER (gone) AS n_missing, {pct('count(*) FILTER (gone)', 'count(*)')} AS pct_missing
FROM (SELECT 'ligne' AS variable, ligne IS NULL AS gone FROM loans UNION ALL
      SELECT 'quantite', quantite IS NULL FROM loans UNION ALL
      SELECT 'l_tax', l_tax IS NULL FROM loans) GROUP BY variable""")
def missing_value_rates(spark, folder):
    return levels.missing_rates(loans(spark, folder), "ligne", "quantite", "l_tax")


# --- target tables ----------------------------------------------------------------------------


@query(f"WITH {LOANS}, {levels_sql('loans', 'ligne')} SELECT * FROM lv")
def target_by_level(spark, folder):
    return levels.target_table(loans(spark, folder), "ligne", "y")


@query(f"""WITH {LOANS}, {levels_sql('loans', 'ligne')}, {woe_sql()}
SELECT ligne, effectif, nb_defaut, nb_non_defaut, "taux_defaut_%", {r('dist_defaut', 9)} AS dist_defaut,
       {r('dist_non_defaut', 9)} AS dist_non_defaut, "WoE", "IV_modalite" FROM woe""")
def weight_of_evidence(spark, folder):
    result = woe.woe_table(loans(spark, folder), "ligne", "y")
    return rounded(result, 9, "dist_defaut", "dist_non_defaut")


@query(f"""WITH src AS (SELECT l_suppkey, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem),
{levels_sql('src', 'l_suppkey')}, {woe_sql()} SELECT l_suppkey, effectif, nb_defaut, "WoE", "IV_modalite" FROM woe""")
def weight_of_evidence_suppliers(spark, folder):
    result = woe.woe_table(loans(spark, folder), "l_suppkey", "y")
    return result.select("l_suppkey", "effectif", "nb_defaut", "WoE", "IV_modalite")


@query(f"""WITH {LOANS}, {levels_sql('loans', 'ligne')}, {woe_sql()},
t AS (SELECT {r('sum("IV_modalite")', 6)} AS iv_total FROM woe) SELECT iv_total, {IV_CASE} AS iv_interpretation FROM t""")
def information_value(spark, folder):
    return woe.information_value(loans(spark, folder), "ligne", "y")


@query(f"""WITH src AS (SELECT o_orderstatus, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders),
{levels_sql('src', 'o_orderstatus')}, {woe_sql()},
t AS (SELECT {r('sum("IV_modalite")', 6)} AS iv_total FROM woe) SELECT iv_total, {IV_CASE} AS iv_interpretation FROM t""")
def information_value_separating(spark, folder):
    orders = table(spark, folder, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return woe.information_value(orders, "o_orderstatus", "y")


_BY_VARIABLE = f"""u AS (SELECT 'ligne' AS variable, CAST(ligne AS VARCHAR) AS level, y FROM loans UNION ALL
  SELECT 'l_linestatus', l_linestatus, y FROM loans UNION ALL SELECT 'annee', CAST(annee AS VARCHAR), y FROM loans),
lv AS (SELECT variable, level, count(y) AS effectif, CAST(sum(y) AS BIGINT) AS nb_defaut,
         count(y) - CAST(sum(y) AS BIGINT) AS nb_non_defaut, {pct('sum(y)', 'count(y)')} AS "taux_defaut_%"
       FROM u WHERE level IS NOT NULL GROUP BY ALL),
sh AS (SELECT *, nb_defaut / CAST(sum(nb_defaut) OVER (PARTITION BY variable) AS DOUBLE) AS dd,
              nb_non_defaut / CAST(sum(nb_non_defaut) OVER (PARTITION BY variable) AS DOUBLE) AS dn FROM lv),
ww AS (SELECT *, {r('ln(greatest(dn, 1e-10) / greatest(dd, 1e-10))', 4)} AS "WoE" FROM sh),
woe AS (SELECT *, {r('(dn - dd) * "WoE"', 6)} AS "IV_modalite" FROM ww)"""


@query(f"""WITH {LOANS}, {_BY_VARIABLE}
SELECT variable, level, effectif, nb_defaut, nb_non_defaut, "taux_defaut_%", "WoE", "IV_modalite" FROM woe""")
def weight_of_evidence_by_variable(spark, folder):
    result = woe.woe_by_variable(loans(spark, folder), ["ligne", "l_linestatus", "annee"], "y")
    return result.drop("dist_defaut", "dist_non_defaut")


@query(f"""WITH {LOANS}, {_BY_VARIABLE}, t AS (SELECT variable, {r('sum("IV_modalite")', 6)} AS iv_total FROM woe GROUP BY variable)
SELECT variable, iv_total, {IV_CASE} AS iv_interpretation FROM t""")
def information_value_by_variable(spark, folder):
    return woe.iv_by_variable(loans(spark, folder), ["ligne", "l_linestatus", "annee"], "y")


@query(f"""WITH {LOANS}, {levels_sql('loans', 'ligne')}
SELECT CAST(sum(effectif) AS BIGINT) AS effectif, CAST(sum(nb_defaut) AS BIGINT) AS nb_defaut,
       {r('CAST(sum(nb_defaut) AS DOUBLE) / sum(effectif) * 100', 6)} AS "taux_global_%" FROM lv""")
def global_default_rate(spark, folder):
    return rounded(levels.global_rate_of(levels.target_table(loans(spark, folder), "ligne", "y")), 6, "taux_global_%")


@query(f"WITH {LOANS} SELECT ligne AS x, y, count(*) AS o FROM loans WHERE ligne IS NOT NULL GROUP BY ligne, y")
def contingency_table(spark, folder):
    return levels.contingency(loans(spark, folder), "ligne", "y")


@query(f"""WITH {LOANS} SELECT ligne, quantite, mois FROM loans
WHERE ligne IS NOT NULL AND quantite IS NOT NULL AND mois IS NOT NULL""")
def complete_rows(spark, folder):
    return cleaning.complete_rows(loans(spark, folder), ["ligne", "quantite", "mois"])


@query(f"""WITH {LOANS} SELECT l_orderkey, coalesce(ligne, 0) AS ligne, coalesce(quantite, -1.0) AS quantite, mois FROM loans""")
def imputed_values(spark, folder):
    return (
        loans(spark, folder)
        .select("l_orderkey", "ligne", "quantite", "mois")
        .transform(cleaning.impute_missing_values, ["ligne"], 0)
        .transform(cleaning.impute_missing_values, ["quantite"], -1.0)
    )


@query(f"""WITH {LOANS} SELECT l_orderkey, l_linenumber, coalesce(CAST(ligne AS DOUBLE), 0.5::DOUBLE) AS ligne FROM loans""")
def imputed_fraction(spark, folder):
    """A whole-number column filled with a fraction becomes double."""
    df = loans(spark, folder).select("l_orderkey", "l_linenumber", "ligne")
    return cleaning.impute_missing_values(df, ["ligne"], 0.5)


# --- months and drift -------------------------------------------------------------------------

_MONTHLY = f"""monthly AS (
  SELECT mois, ligne, count(y) AS effectif, CAST(sum(y) AS BIGINT) AS nb_defaut, {pct('sum(y)', 'count(y)')} AS "taux_defaut_%"
  FROM loans WHERE ligne IS NOT NULL GROUP BY mois, ligne)"""


@query(f"WITH {LOANS} SELECT DISTINCT mois FROM loans")
def month_list(spark, folder):
    return levels.month_list(loans(spark, folder), "mois")


@query(f"WITH {LOANS}, {_MONTHLY} SELECT * FROM monthly")
def target_by_month(spark, folder):
    return levels.monthly_table(loans(spark, folder), "ligne", "y", "mois")


@query(f"""WITH o AS (SELECT date_trunc('day', o_orderdate)::DATE AS jour, o_orderpriority FROM orders),
c AS (SELECT jour, o_orderpriority, count(*) AS n FROM o GROUP BY ALL)
SELECT CAST(m.jour AS VARCHAR) AS jour, l.o_orderpriority, coalesce(c.n, 0) AS n,
       {r('coalesce(c.n, 0) / CAST(s.t AS DOUBLE) * 100', 6)} AS "part_%"
FROM (SELECT DISTINCT jour FROM c) m CROSS JOIN (SELECT DISTINCT o_orderpriority FROM c) l
LEFT JOIN c ON c.jour = m.jour AND c.o_orderpriority = l.o_orderpriority
JOIN (SELECT jour, sum(n) AS t FROM c GROUP BY jour) s ON s.jour = m.jour""")
def monthly_level_shares(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("jour"), "o_orderpriority"
    )
    counts = orders.groupBy("jour", "o_orderpriority").agg(F.count(F.lit(1)).alias("effectif"))
    return rounded(levels.monthly_shares(counts, "jour", "o_orderpriority"), 6, "part_%")


@query(f"WITH {LOANS}, {_MONTHLY} {psi_sql('monthly', 'mois', 'ligne', 'effectif')}")
def stability_index(spark, folder):
    return rounded(drift.psi_table(loans(spark, folder), "ligne", "y", "mois"), 6, "psi")


@query("""WITH o AS (SELECT 'tout' AS mois, o_orderpriority FROM orders)
SELECT CAST(NULL AS DOUBLE) AS psi, 'Non calculable (une seule période)' AS interpretation,
       min(mois) AS periode_ref, max(mois) AS periode_act FROM o""")
def stability_index_one_period(spark, folder):
    orders = table(spark, folder, "orders").withColumns(
        {"mois": F.lit("tout"), "y": (F.col("o_orderstatus") == "F").cast("int")}
    )
    return drift.psi_table(orders, "o_orderpriority", "y", "mois")


# --- association ------------------------------------------------------------------------------

_TEST = f"""SELECT CAST(n AS BIGINT) AS n, dof, {r('chi2', 6)} AS chi2, {r('CASE WHEN k > 0 THEN sqrt(chi2 / (n * k)) ELSE 0 END', 6)} AS v_cramer"""


@query(f"""WITH {LOANS}, cells AS (SELECT l_linestatus AS x, y, count(*) AS o FROM loans GROUP BY ALL), {chi2_sql('cells')}
{_TEST}, {r(erfc_sql('sqrt(chi2 / 2)'), 6)} AS p_value FROM test""")
def independence_test_corrected(spark, folder):
    result = association.chi2_test(loans(spark, folder), "l_linestatus", "y")
    return rounded(result, 6, "chi2", "v_cramer", "p_value")


@query(f"""WITH cells AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS o FROM lineitem GROUP BY ALL), {chi2_sql('cells')}
{_TEST}, {r('exp(-chi2 / 2)', 6)} AS p_value FROM test""")
def independence_test_pvalue(spark, folder):
    result = association.chi2_test(table(spark, folder, "lineitem"), "l_returnflag", "l_linestatus")
    return rounded(result, 6, "chi2", "v_cramer", "p_value")


@query(f"""WITH cells AS (SELECT l_suppkey AS x, l_tax AS y, count(*) AS o FROM lineitem GROUP BY ALL), {chi2_sql('cells')}
{_TEST} FROM test""")
def independence_test_suppliers(spark, folder):
    result = association.chi2_test(table(spark, folder, "lineitem"), "l_suppkey", "l_tax").drop("p_value")
    return rounded(result, 6, "chi2", "v_cramer")


@query(f"""WITH {LOANS}, cells AS (SELECT ligne AS x, l_returnflag AS y, count(*) AS o FROM loans WHERE ligne IS NOT NULL GROUP BY ALL),
{chi2_sql('cells')} SELECT {r('CASE WHEN k > 0 THEN sqrt(chi2 / (n * k)) ELSE 0 END', 6)} AS v_cramer FROM test""")
def cramers_v(spark, folder):
    return rounded(association.cramers_v(loans(spark, folder), "ligne", "l_returnflag"), 6, "v_cramer")


_MATRIX = ["l_returnflag", "l_linestatus", "ligne", "l_tax"]


def _matrix_sql() -> str:
    values = [f"SELECT '{a}' AS variable, '{b}' AS other, CAST({a} AS VARCHAR) AS x, CAST({b} AS VARCHAR) AS y FROM loans"
              for a in _MATRIX for b in _MATRIX if a != b]
    wide = ", ".join(
        f"CASE WHEN variable = '{c}' THEN 1.0::DOUBLE ELSE max(CASE WHEN other = '{c}' THEN v END) END AS \"{c}\"" for c in _MATRIX
    )
    return f"""WITH {LOANS}, raw AS ({' UNION ALL '.join(values)}),
cells AS (SELECT variable, other, x, y, count(*) AS o FROM raw WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
mr AS (SELECT variable, other, x, sum(o) AS rn FROM cells GROUP BY ALL),
mc AS (SELECT variable, other, y, sum(o) AS cn FROM cells GROUP BY ALL),
size AS (SELECT variable, other, CAST(sum(o) AS DOUBLE) AS n, count(DISTINCT x) AS nr, count(DISTINCT y) AS nc FROM cells GROUP BY ALL),
grid AS (SELECT variable, other, coalesce(o, 0) AS o, rn * cn / n AS e, n, nr, nc
         FROM mr JOIN mc USING (variable, other) JOIN size USING (variable, other) LEFT JOIN cells USING (variable, other, x, y)),
pairs AS (SELECT variable, other, sqrt(sum(CASE WHEN nr = 2 AND nc = 2 THEN pow(abs(o - e) - least(0.5, abs(o - e)), 2) ELSE pow(o - e, 2) END / e)
            / (any_value(n) * (any_value(least(nr, nc)) - 1))) AS w FROM grid GROUP BY ALL),
v AS (SELECT variable, other, {r('w', 6)} AS v FROM pairs)
SELECT variable, {wide} FROM v GROUP BY variable"""


@query(_matrix_sql())
def cramers_v_matrix(spark, folder):
    return rounded(association.cramers_v_matrix(loans(spark, folder), _MATRIX), 6, *_MATRIX)


@query(f"""SELECT *, CAST(NULL AS DOUBLE) AS vide FROM ({_matrix_sql()})
UNION ALL SELECT 'vide', {', '.join('NULL' for _ in _MATRIX)}, 1.0""")
def cramers_v_matrix_empty_column(spark, folder):
    """A column without values keeps its row: 1 on the diagonal, NULL elsewhere."""
    df = loans(spark, folder).withColumn("vide", F.lit(None).cast("string"))
    return rounded(association.cramers_v_matrix(df, [*_MATRIX, "vide"]), 6, *_MATRIX)


# --- orders of levels -------------------------------------------------------------------------


def _orders(spark, folder):
    return table(spark, folder, "orders").withColumns(
        {
            "annee": F.year("o_orderdate").cast("string"),
            "cher": (F.col("o_totalprice") > 250000).cast("int"),
            "priorite": F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")),
        }
    )


_ORDERS = """o AS (SELECT *, CAST(year(o_orderdate) AS VARCHAR) AS annee, CAST(o_totalprice > 250000 AS INTEGER) AS cher,
  nullif(o_orderpriority, '5-LOW') AS priorite FROM orders)"""


def _order_sql(direction: str) -> str:
    lists = ", ".join(
        f"(SELECT string_agg(l, ',' ORDER BY n {direction}, l) FROM (SELECT {v} AS l, sum(cher) AS n FROM o WHERE {v} IS NOT NULL GROUP BY {v})) AS {v}"
        for v in ("priorite", "annee", "o_orderstatus")
    )
    return f"WITH {_ORDERS} SELECT {lists}"


@query(_order_sql("ASC"))
def modality_order_ascending(spark, folder):
    order = levels.modality_order(_orders(spark, folder), ["priorite", "annee", "o_orderstatus"], "cher")
    return order.select(*[joined_text(c).alias(c) for c in order.columns])


@query(_order_sql("DESC"))
def modality_order_descending(spark, folder):
    order = levels.modality_order(
        _orders(spark, folder), ["priorite", "annee", "o_orderstatus"], "cher", sens="decroissant"
    )
    return order.select(*[joined_text(c).alias(c) for c in order.columns])


@query(f"""WITH {_ORDERS}, u AS (
  SELECT 'priorite' AS variable, coalesce(priorite, 'MISSING') AS level, cher FROM o UNION ALL SELECT 'annee', annee, cher FROM o),
a AS (SELECT variable, level, avg(cher) AS taux, count(*) AS effectif, count(cher) AS n_cible, CAST(sum(cher) AS BIGINT) AS nb_defaut
      FROM u GROUP BY ALL)
SELECT variable, level, CAST(row_number() OVER (PARTITION BY variable ORDER BY taux, level) - 1 AS INTEGER) AS rang,
       {r('taux', 9)} AS taux, effectif, n_cible, nb_defaut FROM a""")
def risk_order(spark, folder):
    return rounded(levels.risk_order(_orders(spark, folder), ["priorite", "annee"], "cher"), 9, "taux")


# --- chart tables -----------------------------------------------------------------------------


@query(f"""WITH {LOANS}, {levels_sql('loans', 'ligne')}
SELECT ligne, effectif, "taux_defaut_%", (SELECT {r('CAST(sum(nb_defaut) AS DOUBLE) / sum(effectif) * 100', 6)} FROM lv) AS "taux_global_%" FROM lv""")
def level_bars(spark, folder):
    target = levels.target_table(loans(spark, folder), "ligne", "y")
    return rounded(charts.level_bars(target, "ligne"), 6, "taux_global_%")


@query(f"""WITH {LOANS}, {levels_sql('loans', 'ligne')}, {woe_sql()}
SELECT ligne, "WoE", CASE WHEN "WoE" >= 0 THEN 'positif' ELSE 'negatif' END AS cote, "IV_modalite" FROM woe""")
def woe_bars(spark, folder):
    return woe.woe_bars(woe.woe_table(loans(spark, folder), "ligne", "y"), "ligne")


_STATUS_MONTHLY = f"""m AS (SELECT mois, l_linestatus, count(y) AS effectif, {pct('sum(y)', 'count(y)')} AS rate FROM loans GROUP BY ALL)"""


@query(f"""WITH {LOANS}, {_STATUS_MONTHLY}
SELECT mois, max(rate) FILTER (l_linestatus = 'F') AS "F", max(rate) FILTER (l_linestatus = 'O') AS "O" FROM m GROUP BY mois""")
def rate_by_month(spark, folder):
    monthly = levels.monthly_table(loans(spark, folder), "l_linestatus", "y", "mois")
    return charts.rate_by_month(monthly, "mois", "l_linestatus")


@query(f"""WITH {LOANS}, m AS (SELECT annee, l_linestatus, {pct('sum(y)', 'count(y)')} AS rate FROM loans GROUP BY ALL)
SELECT l_linestatus, CAST(annee AS VARCHAR) AS annee, rate AS taux
FROM (SELECT DISTINCT l_linestatus FROM m) CROSS JOIN (SELECT DISTINCT annee FROM m) LEFT JOIN m USING (l_linestatus, annee)""")
def rate_heat_map(spark, folder):
    monthly = levels.monthly_table(loans(spark, folder), "l_linestatus", "y", "annee")
    years = sorted(row[0] for row in monthly.select("annee").distinct().collect())
    wide = charts.heat_map(monthly, "annee", "l_linestatus", years)
    return wide.unpivot(["l_linestatus"], [str(year) for year in years], "annee", "taux")


@query(f"""WITH {LOANS}, {_STATUS_MONTHLY}
SELECT mois, l_linestatus, rate AS "taux_defaut_%", CASE WHEN rate > (SELECT avg(rate) FROM m) THEN 'white' ELSE 'black' END AS texte FROM m""")
def rate_heat_map_cells(spark, folder):
    monthly = levels.monthly_table(loans(spark, folder), "l_linestatus", "y", "mois")
    return charts.heat_map_cells(monthly, "mois", "l_linestatus")


@query(f"""WITH {LOANS}, {_MONTHLY}, s AS (SELECT *, CAST(sum(effectif) OVER (PARTITION BY mois) AS DOUBLE) AS t,
  coalesce(sum(effectif) OVER (PARTITION BY mois ORDER BY ligne ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM monthly)
SELECT mois, ligne, {r('effectif / t * 100', 6)} AS "part_%", {r('b / t * 100', 6)} AS "base_%" FROM s""")
def stacked_shares(spark, folder):
    monthly = levels.monthly_table(loans(spark, folder), "ligne", "y", "mois")
    return rounded(charts.stacked_shares(monthly, "mois", "ligne"), 6, "part_%", "base_%")


_RATE_BLOCKS = f"""src AS (SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS annee, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem),
m AS (SELECT annee, l_suppkey, {pct('sum(y)', 'count(y)')} AS rate FROM src WHERE l_suppkey IS NOT NULL AND annee IS NOT NULL GROUP BY ALL),
d AS (SELECT l_suppkey, (row_number() OVER (ORDER BY l_suppkey) - 1) // 4 AS block,
  CAST((row_number() OVER (ORDER BY l_suppkey) - 1) % 4 AS INTEGER) AS place FROM (SELECT DISTINCT l_suppkey FROM m WHERE rate IS NOT NULL))"""


@query(f"""WITH {_RATE_BLOCKS}, held AS (SELECT DISTINCT annee, block FROM m JOIN d USING (l_suppkey) WHERE rate IS NOT NULL)
SELECT annee, block, string_agg(coalesce(CAST(CAST(round(rate * 100, 0) AS BIGINT) AS VARCHAR), '-'), ',' ORDER BY place) AS cells
FROM held JOIN d USING (block) LEFT JOIN m USING (annee, l_suppkey) GROUP BY annee, block""")
def rate_blocks_by_supplier(spark, folder):
    """Years by suppliers, four suppliers to a block; rates shown in whole hundredths."""
    source = loans(spark, folder)
    _, blocks = charts.rate_blocks(levels.monthly_table(source, "l_suppkey", "y", "annee"), "annee", "l_suppkey", 4)
    shown = F.transform("cells", lambda c: F.coalesce(F.rint(c * 100).cast("long").cast("string"), F.lit("-")))
    return blocks.select("annee", "block", joined_text(shown).alias("cells"))


@query(f"WITH {_RATE_BLOCKS} SELECT block, place, l_suppkey FROM d")
def rate_block_columns(spark, folder):
    source = loans(spark, folder)
    return charts.rate_blocks(levels.monthly_table(source, "l_suppkey", "y", "annee"), "annee", "l_suppkey", 4)[0]


# --- months of many variables -----------------------------------------------------------------

_VARIABLES = ["ligne", "l_linestatus", "annee", "l_suppkey"]
_LONG = " UNION ALL ".join(f"SELECT '{v}' AS variable, CAST({v} AS VARCHAR) AS level, mois, y FROM loans" for v in _VARIABLES)
_CELLS = f"""{LOANS}, u AS ({_LONG}),
cells AS (SELECT variable, level, mois, count(y) AS effectif, CAST(coalesce(sum(y), 0) AS BIGINT) AS nb_defaut,
  {pct('sum(y)', 'count(y)')} AS "taux_defaut_%" FROM u WHERE level IS NOT NULL AND mois IS NOT NULL GROUP BY ALL)"""


@query(f"""WITH {_CELLS}, e AS (SELECT variable, min(mois) AS a, max(mois) AS b FROM cells GROUP BY variable),
s AS (SELECT variable, level, a, b, coalesce(sum(effectif) FILTER (mois = a), 0) AS na, coalesce(sum(effectif) FILTER (mois = b), 0) AS nb
  FROM cells JOIN e USING (variable) GROUP BY ALL),
p AS (SELECT variable, a, b, na / CAST(sum(na) OVER w AS DOUBLE) AS ref, nb / CAST(sum(nb) OVER w AS DOUBLE) AS act
  FROM s WINDOW w AS (PARTITION BY variable)),
t AS (SELECT variable, a, b, sum(({floored('act')} - {floored('ref')}) * ln({floored('act')} / {floored('ref')})) AS psi FROM p GROUP BY ALL)
SELECT variable, {r('psi', 6)} AS psi, {PSI_CASE} AS interpretation, a AS periode_ref, b AS periode_act FROM t""")
def stability_by_variable(spark, folder):
    """PSI of four variables, one with a level per supplier, from one scan."""
    return rounded(months.monthly_profile(loans(spark, folder), _VARIABLES, "y", "mois")["psi"], 6, "psi")


@query(f"""WITH {_CELLS}, k AS (SELECT variable, mois, sum(effectif) AS t FROM cells GROUP BY ALL), l AS (SELECT DISTINCT variable, level FROM cells)
SELECT variable, mois, level, coalesce(effectif, 0) AS n, {r('coalesce(effectif, 0) / CAST(t AS DOUBLE) * 100', 6)} AS "part_%"
FROM k JOIN l USING (variable) LEFT JOIN cells USING (variable, mois, level)""")
def monthly_shares_by_variable(spark, folder):
    return rounded(months.monthly_profile(loans(spark, folder), _VARIABLES, "y", "mois")["parts"], 6, "part_%")


@query(f"""WITH {_CELLS} SELECT variable, mois, level, effectif, nb_defaut, "taux_defaut_%" FROM cells""")
def monthly_rates_by_deliveries(spark, folder):
    """Two deliveries by the parity of the order key, so that every month is filled by both; the first
    is delivered twice."""
    place = f"{shared_folder(spark)}/riskloom/months-{uuid.uuid4().hex}"
    source = loans(spark, folder)
    for part in (0, 1, 0):
        delivery = source.where(F.col("l_orderkey") % 2 == part)
        months.store_batch(months.month_cells(delivery, _VARIABLES, "y", "mois"), place, f"part-{part}")
    return months.rates_of(months.stored_cells(spark, place))


# --- the whole profile ------------------------------------------------------------------------


def _profile(spark, folder, name):
    return analyse_categorielle(loans(spark, folder), "ligne", "y", "mois")[name]


@query(f"WITH {LOANS}" + _frequency_sql("loans", "ligne"))
def categorical_profile_frequencies(spark, folder):
    return _profile(spark, folder, "univarie")


@query(f"""WITH {LOANS}, {levels_sql('loans', 'ligne')}, {woe_sql()},
t AS (SELECT {r('sum("IV_modalite")', 6)} AS iv_total FROM woe),
cells AS (SELECT ligne AS x, y, count(*) AS o FROM loans WHERE ligne IS NOT NULL GROUP BY ALL), {chi2_sql('cells')}
SELECT {r('chi2', 6)} AS chi2, dof, {r(f"{erfc_sql('sqrt(chi2 / 2)')} + exp(-chi2 / 2) * (sqrt(chi2 / 2) * 2 + pow(chi2 / 2, 1.5) * 4 / 3) / sqrt(pi())", 6)} AS p_value,
  {r('sqrt(chi2 / (n * k))', 6)} AS v_cramer, iv_total, {IV_CASE} AS iv_interpretation FROM test, t""")
def categorical_profile_tests(spark, folder):
    """Six levels against two classes: five degrees of freedom."""
    return rounded(_profile(spark, folder, "tests"), 6, "chi2", "p_value", "v_cramer")


@query(f"WITH {LOANS}, {_MONTHLY} {psi_sql('monthly', 'mois', 'ligne', 'effectif')}")
def categorical_profile_drift(spark, folder):
    return rounded(_profile(spark, folder, "psi"), 6, "psi")


@query(f"""WITH {LOANS}, {levels_sql('loans', 'ligne')}, {woe_sql()}
SELECT ligne, effectif, nb_defaut, nb_non_defaut, "taux_defaut_%", "WoE", "IV_modalite" FROM woe""")
def categorical_profile_saved(spark, folder):
    tables = analyse_categorielle(loans(spark, folder), "ligne", "y", "mois")
    place = f"{shared_folder(spark)}/riskloom/bundle-{uuid.uuid4().hex}"
    write_bundle(tables, place)
    return read_bundle(spark, place, tables)["bivarie"].drop("dist_defaut", "dist_non_defaut")
