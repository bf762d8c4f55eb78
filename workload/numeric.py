"""Queries on numeric variables: summaries, rank tests, binning, densities."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.numeric import round_even
from riskloom.operators import binning, charts, ranks, regression
from riskloom.plans.quantitative import analyse_quantitative, bin_woe_table

from .base import IV_CASE, LOANS, erfc_sql, loans, pct, psi_sql, r, rounded, table, woe_sql

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


# --- summaries and rank tests -----------------------------------------------------------------


def _summary_sql(source: str, x: str) -> str:
    quantiles = ", ".join(
        f'{r(f"quantile_cont({x}, {q / 100})", 4)} AS "Q{q}"' for q in (1, 5, 10, 25, 50, 75, 90, 95, 99)
    )
    return f"""SELECT count(*) AS count, count(*) - count({x}) AS missing, {pct(f'count(*) - count({x})', 'count(*)')} AS "missing_%",
  {r(f'avg({x})', 4)} AS mean, {r(f'median({x})', 4)} AS median, {r(f'stddev_samp({x})', 4)} AS std, {r(f'min({x})', 4)} AS min,
  {r(f'max({x})', 4)} AS max, {r(f'skewness({x})', 4)} AS skewness, {r(f'kurtosis({x})', 4)} AS kurtosis, {quantiles} FROM {source}"""


@query(_summary_sql("lineitem", "l_extendedprice"))
def numeric_summary(spark, folder):
    return ranks.numeric_summary(table(spark, folder, "lineitem"), "l_extendedprice")


@query(f"WITH {LOANS} " + _summary_sql("loans", "quantite"))
def numeric_summary_ties(spark, folder):
    return ranks.numeric_summary(loans(spark, folder), "quantite")


@query(_summary_sql("documents", "n_chars"))
def numeric_summary_documents(spark, folder):
    return ranks.numeric_summary(table(spark, folder, "documents"), "n_chars")


def _ranks_sql(x: str, source: str = "loans") -> str:
    """CTE: one row of pair counts and rank statistics of x against y."""
    return f"""hist AS (SELECT {x} AS v, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS n0, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS n1
  FROM {source} WHERE {x} IS NOT NULL AND y IS NOT NULL GROUP BY {x}),
run AS (SELECT *, coalesce(sum(n1) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below1,
               sum(n1) OVER (ORDER BY v DESC ROWS UNBOUNDED PRECEDING) AS tp,
               sum(n0) OVER (ORDER BY v DESC ROWS UNBOUNDED PRECEDING) AS fp FROM hist),
rk AS (SELECT sum(n0) AS s0, sum(n1) AS s1, sum(n0 * (below1 + n1 / 2)) AS u0, sum(n1 * tp / (tp + fp)) / sum(n1) AS ap FROM run)"""


_CLASS_TESTS = """SELECT u0 AS "mann_whitney_U", {auc} AS auc, {auc_adj} AS auc_ajuste, {stats}
FROM rk, (SELECT {aggregates} FROM loans)"""


def _class_tests_sql(x: str) -> str:
    names = {"non_defaut": 0, "defaut": 1}
    aggregates = ", ".join(
        f"avg({x}) FILTER (y = {c}) AS m{c}, median({x}) FILTER (y = {c}) AS d{c}, "
        f"stddev_samp({x}) FILTER (y = {c}) AS s_{c}, count({x}) FILTER (y = {c}) AS k{c}"
        for c in (0, 1)
    )
    stats = ", ".join(
        f"{r(f'm{c}', 6)} AS moyenne_{n}, {r(f'd{c}', 6)} AS mediane_{n}, {r(f's_{c}', 6)} AS ecart_type_{n}, k{c} AS effectif_{n}"
        for n, c in names.items()
    )
    auc = "(s0 * s1 - u0) / (s0 * s1)"
    head = f"WITH {LOANS}, {_ranks_sql(x)} "
    return head + _CLASS_TESTS.format(
        auc=r(auc, 9), auc_adj=r(f"greatest({auc}, 1 - {auc})", 9), stats=stats, aggregates=aggregates
    )


def _class_tests(df, x):
    result = ranks.class_tests(df, x, "y").drop("mann_whitney_pvalue")
    result = rounded(result, 9, "auc", "auc_ajuste")
    return rounded(
        result,
        6,
        *[f"{s}_{c}" for s in ("moyenne", "mediane", "ecart_type") for c in ("non_defaut", "defaut")],
    )


@query(_class_tests_sql("l_extendedprice"))
def class_tests(spark, folder):
    return _class_tests(loans(spark, folder), "l_extendedprice")


@query(_class_tests_sql("quantite"))
def class_tests_ties(spark, folder):
    return _class_tests(loans(spark, folder), "quantite")


@query(f"""WITH {LOANS}, {_ranks_sql('quantite')}, t AS (SELECT sum(pow(n0 + n1, 3) - (n0 + n1)) AS ties FROM hist),
zz AS (SELECT u0, (greatest(u0, s0 * s1 - u0) - s0 * s1 / 2 - 0.5)
  / sqrt(s0 * s1 / 12 * ((s0 + s1 + 1) - ties / ((s0 + s1) * (s0 + s1 - 1)))) AS z FROM rk, t)
SELECT u0 AS "mann_whitney_U", {r(f"least(1, {erfc_sql('z / sqrt(2)')})", 6)} AS mann_whitney_pvalue FROM zz""")
def mann_whitney_pvalue(spark, folder):
    result = ranks.class_tests(loans(spark, folder), "quantite", "y").select("mann_whitney_U", "mann_whitney_pvalue")
    return rounded(result, 6, "mann_whitney_pvalue")


@query(f"""WITH {LOANS}, {_ranks_sql('l_extendedprice')}
SELECT {r('(s0 * s1 - u0) / (s0 * s1)', 9)} AS auc, {r('2 * (s0 * s1 - u0) / (s0 * s1) - 1', 9)} AS gini,
       {r('ap', 9)} AS auc_pr, {r('s1 / (s0 + s1)', 9)} AS prevalence, {r('ap / (s1 / (s0 + s1))', 9)} AS rp FROM rk""")
def score_metrics(spark, folder):
    result = ranks.score_metrics(loans(spark, folder), "l_extendedprice", "y")
    return rounded(result, 9, *result.columns)


_SCORED = f"""WITH {LOANS}, s AS (SELECT y, (l_quantity + 1) / 60.0::DOUBLE AS p FROM loans),
t AS (SELECT count(*) AS n, sum(y * ln(p + 1e-15::DOUBLE) + (1 - y) * ln(1 - p + 1e-15::DOUBLE)) AS ll, avg((p - y) * (p - y)) AS b FROM s)
SELECT n, {r('ll', 4)} AS loglik, {r('-2 * ll + 2 * 4', 4)} AS aic, {r('-2 * ll + 4 * ln(n)', 4)} AS bic, {r('b', 6)} AS brier FROM t"""


@query(_SCORED)
def probability_metrics(spark, folder):
    scored = loans(spark, folder).withColumn("p", (F.col("l_quantity") + 1) / 60.0)
    result = regression.metrics_of_scores(scored, "p", "y", 3)
    return rounded(rounded(result, 4, "loglik", "aic", "bic"), 6, "brier")


# --- binning ----------------------------------------------------------------------------------


def _quantile_cte(x: str, n: int, where: str) -> str:
    edges = ", ".join(f"quantile_cont({x}, {i / n!r})" for i in range(n + 1))
    return f"""cuts AS (SELECT list_sort(list_distinct([{edges}])) AS e FROM loans WHERE {where}),
binned AS (SELECT loans.*, len(list_filter(e[2:], lambda c: c < {x})) AS bin_id, e FROM loans, cuts WHERE {where})"""


def _bin_levels(keep: str) -> str:
    return f"""lv AS (SELECT {keep}, count(y) AS effectif, CAST(sum(y) AS BIGINT) AS nb_defaut,
  count(y) - CAST(sum(y) AS BIGINT) AS nb_non_defaut, {pct('sum(y)', 'count(y)')} AS "taux_defaut_%" FROM binned GROUP BY ALL)"""


def _quantile_bins_sql(x: str, n: int) -> str:
    return f"""WITH {LOANS}, {_quantile_cte(x, n, f'{x} IS NOT NULL AND y IS NOT NULL')},
{_bin_levels('bin_id, e[bin_id + 1] AS lo, e[bin_id + 2] AS hi')}, {woe_sql('lv', 'IV_tranche')}
SELECT CAST(bin_id AS INTEGER) AS bin_id, {r('lo', 6)} AS lo, {r('hi', 6)} AS hi, effectif, nb_defaut, nb_non_defaut,
       "taux_defaut_%", "WoE", "IV_tranche" FROM woe"""


def _quantile_bins(df, x, n):
    result = bin_woe_table(df, x, "y", n_tranches=n).drop("tranche", "dist_defaut", "dist_non_defaut")
    return rounded(result, 6, "lo", "hi")


@query(_quantile_bins_sql("l_extendedprice", 5))
def quantile_bins(spark, folder):
    return _quantile_bins(loans(spark, folder), "l_extendedprice", 5)


@query(_quantile_bins_sql("quantite", 7))
def quantile_bins_ties(spark, folder):
    return _quantile_bins(loans(spark, folder), "quantite", 7)


@query(_quantile_bins_sql("l_tax", 20))
def quantile_bins_repeated_edges(spark, folder):
    return _quantile_bins(loans(spark, folder), "l_tax", 20)


_SEUILS = [10, 20, 35, 60]
_LABELS = ["≤ 10", "]10, 20]", "]20, 35]", "]35, 60]", "> 60"]
_BIN_LIST = "bins AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(_LABELS)) + ") b(bin_id, tranche))"
_SEUIL_BIN = " + ".join(f"CAST(quantite > {s} AS INTEGER)" for s in _SEUILS)
_SEUIL_ROWS = f"binned AS (SELECT *, {_SEUIL_BIN} AS bin_id FROM loans WHERE quantite IS NOT NULL)"


@query(f"""WITH {LOANS}, {_SEUIL_ROWS}, {_BIN_LIST},
lv AS (SELECT bin_id, any_value(tranche) AS tranche, count(y) AS effectif, CAST(coalesce(sum(y), 0) AS BIGINT) AS nb_defaut,
  count(y) - CAST(coalesce(sum(y), 0) AS BIGINT) AS nb_non_defaut, {pct('sum(y)', 'count(y)')} AS "taux_defaut_%"
  FROM bins LEFT JOIN binned USING (bin_id) GROUP BY bin_id), {woe_sql('lv', 'IV_tranche')}
SELECT bin_id, tranche, effectif, nb_defaut, nb_non_defaut, "taux_defaut_%", "WoE", "IV_tranche" FROM woe""")
def threshold_bins(spark, folder):
    result = bin_woe_table(loans(spark, folder), "quantite", "y", seuils=_SEUILS)
    return result.drop("lo", "hi", "dist_defaut", "dist_non_defaut")


@query(f"""WITH {LOANS}, {_SEUIL_ROWS}, {_BIN_LIST}
SELECT m.mois, b.bin_id, any_value(b.tranche) AS tranche, count(y) AS effectif, CAST(coalesce(sum(y), 0) AS BIGINT) AS nb_defaut,
       {pct('sum(y)', 'count(y)')} AS "taux_defaut_%"
FROM (SELECT DISTINCT mois FROM binned) m CROSS JOIN bins b LEFT JOIN binned r ON r.mois = m.mois AND r.bin_id = b.bin_id
GROUP BY m.mois, b.bin_id""")
def threshold_bins_by_month(spark, folder):
    tables = analyse_quantitative(loans(spark, folder), "quantite", "y", "mois", seuils=_SEUILS)
    return tables["temporel"].drop("lo", "hi")


@query(f"""WITH {LOANS}, {_quantile_cte('l_extendedprice', 5, 'l_extendedprice IS NOT NULL AND ligne IS NOT NULL')}
SELECT annee, CAST(bin_id AS INTEGER) AS bin_id, {r('e[bin_id + 1]', 6)} AS lo, {r('e[bin_id + 2]', 6)} AS hi,
       count(y) AS effectif, CAST(sum(y) AS BIGINT) AS nb_defaut, {pct('sum(y)', 'count(y)')} AS "taux_defaut_%"
FROM (SELECT * REPLACE (CASE WHEN ligne IS NOT NULL THEN annee END AS annee) FROM binned) GROUP BY ALL""")
def quantile_bins_by_month(spark, folder):
    df = loans(spark, folder).withColumn("annee", F.when(F.col("ligne").isNotNull(), F.col("annee")))
    tables = analyse_quantitative(df, "l_extendedprice", "y", "annee")
    return rounded(tables["temporel"].drop("tranche"), 6, "lo", "hi")


@query(f"""WITH {LOANS}, {_quantile_cte('quantite', 5, 'quantite IS NOT NULL')},
cells AS (SELECT mois, bin_id, count(*) AS n FROM binned GROUP BY ALL) {psi_sql('cells', 'mois', 'bin_id', 'n')}""")
def numeric_stability_index(spark, folder):
    tables = analyse_quantitative(loans(spark, folder), "quantite", "y", "mois")
    return rounded(tables["psi"], 6, "psi")


@query(f"""WITH {LOANS}, {_quantile_cte('l_extendedprice', 5, 'y IS NOT NULL')}, {_bin_levels('bin_id')}, {woe_sql('lv', 'IV_tranche')},
t AS (SELECT {r('sum("IV_tranche")', 6)} AS iv_total FROM woe) SELECT iv_total, {IV_CASE} AS interpretation FROM t""")
def numeric_information_value(spark, folder):
    return analyse_quantitative(loans(spark, folder), "l_extendedprice", "y", "mois")["iv"]


@query(f"WITH {LOANS} " + _summary_sql("loans", "quantite"))
def numeric_profile_summary(spark, folder):
    return analyse_quantitative(loans(spark, folder), "quantite", "y", "mois")["univarie"]


@query(f"""SELECT l_orderkey, {r('least(greatest(l_extendedprice, lo), hi)', 6)} AS l_extendedprice FROM lineitem,
(SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem)""")
def winsorised_prices(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_extendedprice")
    return rounded(binning.winsorise(df, "l_extendedprice"), 6, "l_extendedprice")


_DIGITS = {"quantite": [10.0, 20.0, 30.0], "l_extendedprice": [1000.0, 25000.0, 50000.0, 90000.0], "l_tax": []}


def _digit_sql(x: str, cuts: list[float]) -> str:
    steps = " + ".join([f"CAST({x} >= {c} AS INTEGER)" for c in cuts]) or "0"
    return f"CASE WHEN {x} IS NULL THEN -1 ELSE {steps} END AS {x}"


@query(f"""WITH {LOANS} SELECT {', '.join(_digit_sql(x, c) for x, c in _DIGITS.items())},
coalesce(CAST(ligne AS VARCHAR), 'MISSING') AS ligne, l_linestatus FROM loans""")
def digitised_table(spark, folder):
    df = loans(spark, folder).select(*_DIGITS, "ligne", "l_linestatus")
    return binning.transform_dataframe(df, _DIGITS)


# --- tree thresholds --------------------------------------------------------------------------


def _trees(spark, folder):
    """One tree dump per part: some are leaves, some split on categories, the rest on size."""
    leaf = F.to_json(F.struct(F.col("p_retailprice").alias("leaf")))
    split = F.to_json(F.struct(F.col("p_type").alias("split"), F.col("p_size").alias("split_condition")))
    on_categories = F.to_json(
        F.struct(
            F.col("p_type").alias("split"),
            F.col("p_size").alias("split_condition"),
            F.array("p_brand").alias("categories"),
        )
    )
    kind = (
        F.when(F.col("p_size") % 10 == 0, leaf).when(F.col("p_size") % 10 == 1, on_categories).otherwise(split)
    )
    return table(spark, folder, "part").select(F.col("p_partkey").alias("tree_id"), kind.alias("tree"))


_ROOTS = "roots AS (SELECT p_type AS feature, p_size AS t FROM part WHERE p_size % 10 NOT IN (0, 1) GROUP BY ALL)"


@query(f"WITH {_ROOTS} SELECT feature, string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) AS bins FROM roots GROUP BY feature")
def tree_thresholds(spark, folder):
    bins = F.array_join(F.transform("bins", lambda b: b.cast("int").cast("string")), ",")
    return binning.extract_thresholds(_trees(spark, folder)).select("feature", bins.alias("bins"))


@query(f"""WITH {_ROOTS}, e AS (SELECT *, row_number() OVER w AS i, lead(t) OVER w AS nxt FROM roots WINDOW w AS (PARTITION BY feature ORDER BY t))
SELECT feature, CAST(i AS INTEGER) AS bin_id, t::DOUBLE AS lo, nxt::DOUBLE AS hi, false AS is_missing FROM e
UNION ALL SELECT feature, 0, NULL, min(t)::DOUBLE, false FROM e GROUP BY feature
UNION ALL SELECT DISTINCT feature, -1, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), true FROM e""")
def bin_description(spark, folder):
    described = binning.build_bin_description(binning.extract_thresholds(_trees(spark, folder)))
    # open ends as NULL, which SQL can show
    return described.withColumns({c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c)) for c in ("lo", "hi")})


@query("""SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY ALL""")
def json_fields(spark, folder):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, folder, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


# --- chart tables -----------------------------------------------------------------------------

_LIMITS = "lim AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders)"
_CLIPPED = "w AS (SELECT least(greatest(o_totalprice, lo), hi) AS x, lo, hi FROM orders, lim)"


@query(f"""WITH {_LIMITS}, {_CLIPPED},
b AS (SELECT least(CAST(floor((x - lo) / ((hi - lo) / 50)) AS BIGINT), 49) AS bin_id, count(*) AS n FROM w GROUP BY ALL),
g AS (SELECT range AS bin_id FROM range(50))
SELECT g.bin_id, {r('lo + g.bin_id * ((hi - lo) / 50)', 4)} AS lo, {r('lo + g.bin_id * ((hi - lo) / 50) + (hi - lo) / 50', 4)} AS hi,
       coalesce(n, 0) AS effectif, {r('coalesce(n, 0) / ((SELECT count(*) FROM w) * ((hi - lo) / 50)) * 1e6', 6)} AS densite
FROM g CROSS JOIN lim LEFT JOIN b USING (bin_id)""")
def density_histogram(spark, folder):
    result = charts.density_histogram(table(spark, folder, "orders"), "o_totalprice")
    result = result.withColumn("densite", F.col("densite") * 1e6)
    return rounded(rounded(result, 4, "lo", "hi"), 6, "densite")


@query(f"""WITH {_LIMITS}, {_CLIPPED},
k AS (SELECT stddev_samp(x) * pow(count(*), -0.2) AS h, count(*) AS n, any_value(lo) - 0.5 * (any_value(hi) - any_value(lo)) AS a,
             2 * (any_value(hi) - any_value(lo)) / 999 AS step FROM w),
g AS (SELECT range AS point_id, a + range * step AS x0, h, n FROM range(1000), k),
v AS (SELECT x, count(*) AS c FROM w GROUP BY x)
SELECT point_id, {r('any_value(x0)', 4)} AS x,
       {r('sum(c * exp(-0.5 * pow((x0 - v.x) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())) * 1e6', 6)} AS densite
FROM g, v GROUP BY point_id""")
def density_curve(spark, folder):
    result = charts.density_curve(table(spark, folder, "orders"), "o_totalprice")
    return rounded(result.withColumn("densite", F.col("densite") * 1e6), 6, "densite").withColumn(
        "x", round_even(F.col("x"), 4)
    )


@query(f"""WITH {LOANS}, q AS (SELECT y, count(*) AS effectif, quantile_cont(l_extendedprice, 0.25) AS q1, median(l_extendedprice) AS q2,
  quantile_cont(l_extendedprice, 0.75) AS q3 FROM loans GROUP BY y),
f AS (SELECT loans.y, l_extendedprice AS v, q1, q3, l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
      FROM loans JOIN q USING (y))
SELECT q.y AS classe, q.effectif, {r('q1', 6)} AS q1, {r('q2', 6)} AS mediane, {r('q3', 6)} AS q3, lo AS moustache_basse, hi AS moustache_haute, nb AS nb_extremes
FROM q JOIN (SELECT y, least(min(v) FILTER (inside), any_value(q1)) AS lo, greatest(max(v) FILTER (inside), any_value(q3)) AS hi,
             count(*) FILTER (NOT inside) AS nb FROM f GROUP BY y) USING (y)""")
def box_statistics(spark, folder):
    result = charts.box_statistics(loans(spark, folder), "l_extendedprice", "y")
    return rounded(result, 6, "q1", "mediane", "q3")


@query("""WITH d AS (SELECT n_chars AS v, CAST(lang = 'en' AS INTEGER) AS y FROM documents),
q AS (SELECT y, count(*) AS effectif, quantile_cont(v, 0.25) AS q1, median(v) AS q2, quantile_cont(v, 0.75) AS q3 FROM d GROUP BY y),
f AS (SELECT d.y, CAST(v AS DOUBLE) AS v, q1, q3, v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM d JOIN q USING (y))
SELECT q.y AS classe, q.effectif, q1, q2 AS mediane, q3, lo AS moustache_basse, hi AS moustache_haute, nb AS nb_extremes
FROM q JOIN (SELECT y, least(min(v) FILTER (inside), any_value(q1)) AS lo, greatest(max(v) FILTER (inside), any_value(q3)) AS hi,
             count(*) FILTER (NOT inside) AS nb FROM f GROUP BY y) USING (y)""")
def box_statistics_outliers(spark, folder):
    documents = table(spark, folder, "documents").withColumn("y", (F.col("lang") == "en").cast("int"))
    return charts.box_statistics(documents, "n_chars", "y")
