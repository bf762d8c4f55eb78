"""Queries on encoding, logistic models, selection, scorecards, folds and variable graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.checks import column
from riskloom.operators import encoding, folds, graph, levels, newton, regression, scorecard, selection, sparse

from .base import LOANS, erfc_sql, loans, r, rounded, table

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


# --- encoding ---------------------------------------------------------------------------------

_VARIABLES = ["ligne", "l_linestatus", "l_tax"]


def _split(spark, folder):
    """Even orders train, odd orders test."""
    df = loans(spark, folder).select("l_orderkey", "y", *_VARIABLES)
    even = F.pmod("l_orderkey", F.lit(2)) == 0
    return df.where(even), df.where(~even)


_LONG = """long AS (
  SELECT l_orderkey, y, 'ligne' AS variable, coalesce(CAST(ligne AS VARCHAR), 'MISSING') AS level FROM loans UNION ALL
  SELECT l_orderkey, y, 'l_linestatus', l_linestatus FROM loans UNION ALL
  SELECT l_orderkey, y, 'l_tax', CAST(l_tax AS VARCHAR) FROM loans)"""


def _ranks(where: str) -> str:
    """CTEs: level counts and risk ranks over the rows that `where` keeps."""
    return f"""lv AS (SELECT variable, level, count(*) AS n, CAST(sum(y) AS DOUBLE) AS d, CAST(sum(y) AS DOUBLE) / count(*) AS rate
       FROM long WHERE {where} GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY rate, level) - 1 AS rang FROM lv)"""


_TRAIN = "l_orderkey % 2 = 0"


def _column_sums(encoded):
    """One row per dummy column: how often it is set, and the sum of the order keys it marks."""
    names = [c for c in encoded.columns if "&" in c]
    k = F.col("l_orderkey")
    sums = [
        F.struct(F.lit(c).alias("colonne"), F.sum(column(c)).alias("n"), F.sum(column(c) * k).alias("somme_cle"))
        for c in names
    ]
    return encoded.agg(F.array(*sums).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")


def _sums_sql(learned_on: str, chosen: str = "true") -> str:
    return f"""WITH {LOANS}, {_LONG}, {_ranks(learned_on)}
SELECT rk.variable || '&' || rk.level AS colonne, count(l_orderkey) AS n, CAST(coalesce(sum(l_orderkey), 0) AS BIGINT) AS somme_cle
FROM rk LEFT JOIN long t ON t.variable = rk.variable AND t.level = rk.level WHERE rang > 0 AND {chosen} GROUP BY ALL"""


def _encoded(spark, folder):
    train, test = _split(spark, folder)
    learned = encoding.get_dummies(train, "y", _VARIABLES, keep=["l_orderkey", "y"])
    return learned, encoding.get_test_dummies(test, learned.categ, keep=["l_orderkey", "y"])


@query(_sums_sql("true"))
def one_hot_training(spark, folder):
    df = loans(spark, folder).select("l_orderkey", "y", *_VARIABLES)
    return _column_sums(encoding.get_dummies(df, "y", _VARIABLES, keep=["l_orderkey"]).frame)


@query(_sums_sql(_TRAIN))
def one_hot_stored_order(spark, folder):
    """The level order learned on the training rows, applied to every row."""
    train, _ = _split(spark, folder)
    learned = encoding.get_dummies(train, "y", _VARIABLES)
    return _column_sums(encoding.get_test_dummies(loans(spark, folder), learned.categ, keep=["l_orderkey"]))


@query(_sums_sql(_TRAIN, "rk.variable <> 'l_tax'"))
def design_matrix(spark, folder):
    learned, test = _encoded(spark, folder)
    both = encoding.build_dummies(learned.frame, test, ["ligne", "l_linestatus"], ["l_orderkey"])
    return _column_sums(both[0].unionByName(both[1]))


@query(f"""WITH {LOANS}, v AS (SELECT DISTINCT coalesce(CAST(ligne AS VARCHAR), 'MISSING') AS level FROM loans)
SELECT 'ligne' AS variable, level, 'nouveau' AS presence FROM v WHERE level NOT IN ('1', '2', '3', '99')
UNION ALL SELECT 'ligne', '99', 'absent'""")
def level_mismatches(spark, folder):
    return encoding.level_mismatches(loans(spark, folder), {"ligne": ["1", "2", "3", "99"]})


# --- logistic models: one variable gives a closed form -------------------------------------------

_RATES = f"""WITH {LOANS}, sides AS (
  SELECT ligne, coalesce(CAST(ligne AS VARCHAR), 'MISSING') AS level, y, l_orderkey % 2 AS side FROM loans),
lv AS (SELECT level, CAST(count(*) FILTER (side = 0 AND y = 0) AS DOUBLE) AS a0, CAST(count(*) FILTER (side = 0 AND y = 1) AS DOUBLE) AS a1,
              CAST(count(*) FILTER (side = 1 AND y = 0) AS DOUBLE) AS b0, CAST(count(*) FILTER (side = 1 AND y = 1) AS DOUBLE) AS b1
       FROM sides GROUP BY level),
rates AS (SELECT *, a1 / (a0 + a1) AS p FROM lv)"""

_METRICS = f"""{_RATES},
sc AS (SELECT p, sum(a0) AS a0, sum(a1) AS a1, sum(b0) AS b0, sum(b1) AS b1 FROM rates GROUP BY p),
run AS (SELECT *, coalesce(sum(a0) OVER w, 0) AS a0_before, coalesce(sum(b0) OVER w, 0) AS b0_before,
               sum(b0) OVER d AS fp, sum(b1) OVER d AS tp FROM sc
        WINDOW w AS (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), d AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
k AS (SELECT count(*) AS k FROM lv),
m AS (SELECT sum(a0) + sum(a1) AS n, sum(b0) + sum(b1) AS nt, sum(a1 * ln(p + 1e-15::DOUBLE) + a0 * ln(1 - p + 1e-15::DOUBLE)) AS ll,
  2 * sum(a1 * (a0_before + a0 / 2)) / (sum(a0) * sum(a1)) - 1 AS g, 2 * sum(b1 * (b0_before + b0 / 2)) / (sum(b0) * sum(b1)) - 1 AS gt,
  sum(b1 * tp / (tp + fp)) / sum(b1) AS ap, sum(b1) / (sum(b0) + sum(b1)) AS prev,
  sum(a1 * pow(1 - p, 2) + a0 * p * p) AS q, sum(b1 * pow(1 - p, 2) + b0 * p * p) AS qt FROM run)
SELECT {r('-2 * ll + 2 * k', 3)} AS aic, {r('-2 * ll + k * ln(n)', 3)} AS bic, {r('g', 4)} AS gini_train, {r('q / n', 5)} AS brier_train,
       {r('gt', 4)} AS gini_test, {r('ap', 4)} AS auc_pr, {r('ap / prev', 4)} AS rp, {r('qt / nt', 5)} AS brier_test FROM m, k"""


def _line_model(spark, folder, wald=True):
    learned, test = _encoded(spark, folder)
    features = encoding.dummy_columns(learned.frame.columns, ["ligne"])
    return regression.fit_logit_and_metrics(learned.frame, test, "y", features, wald=wald)


@query(f"""{_RATES}, base AS (SELECT * FROM rates ORDER BY p, level LIMIT 1),
c AS (SELECT r.level, ln(r.p / (1 - r.p)) - ln(b.p / (1 - b.p)) AS coef,
  sqrt(1 / ((r.a0 + r.a1) * r.p * (1 - r.p)) + 1 / ((b.a0 + b.a1) * b.p * (1 - b.p))) AS se FROM rates r, base b WHERE r.level <> b.level)
SELECT 'ligne' AS variable, level, {r('coef', 4)} AS coef, {r('se', 4)} AS std_error, {r('coef / se', 3)} AS wald_z,
  {r(erfc_sql('coef / se / sqrt(2)'), 3)} AS pvalue FROM c""")
def logit_coefficients(spark, folder):
    coefficients = _line_model(spark, folder).coefficient_table(spark)
    return rounded(rounded(coefficients, 4, "coef", "std_error"), 3, "wald_z", "pvalue")


@query(f"""{_RATES}
SELECT l_orderkey, l_linenumber, {r('p', 4)} AS probabilite FROM loans
JOIN rates ON level = coalesce(CAST(ligne AS VARCHAR), 'MISSING')""")
def scored_rows(spark, folder):
    """The model learned on the training rows, applied to every row."""
    train, _ = _split(spark, folder)
    learned = encoding.get_dummies(train, "y", ["ligne"])
    everything = loans(spark, folder).select("l_orderkey", "l_linenumber", "ligne")
    encoded = encoding.get_test_dummies(everything, learned.categ, keep=["l_orderkey", "l_linenumber"])
    scored = regression.score(_line_model(spark, folder, wald=False), encoded)
    return rounded(scored.select("l_orderkey", "l_linenumber", "probabilite"), 4, "probabilite")


@query(_METRICS)
def logit_metrics(spark, folder):
    metrics = _line_model(spark, folder, wald=False).metrics
    row = spark.createDataFrame([tuple(metrics.values())], ", ".join(f"{m} double" for m in metrics))
    row = rounded(row, 3, "aic", "bic")
    row = rounded(row, 4, "gini_train", "gini_test", "auc_pr", "rp")
    return rounded(row, 5, "brier_train", "brier_test")


@query(f"""WITH {LOANS}, {_LONG}, {_ranks(_TRAIN)},
b AS (SELECT variable, -2 * sum(d * ln(rate + 1e-15::DOUBLE) + (n - d) * ln(1 - rate + 1e-15::DOUBLE)) + count(*) * ln(sum(n)) AS bic FROM lv GROUP BY variable)
SELECT CAST(1 AS INTEGER) AS step, 'add' AS action, variable, variable AS selected_vars, {r('bic', 3)} AS best_score FROM b ORDER BY bic LIMIT 1""")
def stepwise_first_step(spark, folder):
    learned, test = _encoded(spark, folder)
    chosen = selection.stepwise_selection_categorical(learned.frame, test, "y", _VARIABLES, max_vars=1)
    history = chosen.history.select("step", "action", "variable", F.array_join("selected_vars", ",").alias("selected_vars"), "best_score")
    return rounded(history, 3, "best_score")


@query()
def stepwise_by_gini(spark, folder):
    learned, test = _encoded(spark, folder)
    return selection.stepwise_selection_categorical(
        learned.frame, test, "y", _VARIABLES, criterion="gini", threshold_in=-1.0
    ).history


@query(f"""WITH h AS (SELECT year(o_orderdate) AS step, avg(o_totalprice) AS bic, avg(CAST(o_orderstatus = 'F' AS INTEGER)) AS gini_test,
  avg(CAST(o_orderstatus = 'O' AS INTEGER)) AS gini_train, max(o_totalprice) AS auc_pr, min(o_totalprice) AS rp FROM orders GROUP BY ALL)
SELECT CAST(step AS INTEGER) AS step, {r('gini_train', 6)} AS gini_train, {r('gini_test', 6)} AS gini_test, auc_pr, rp, {r('bic', 4)} AS bic,
  {r('(bic - (SELECT min(bic) FROM h)) / ((SELECT max(bic) FROM h) - (SELECT min(bic) FROM h))', 6)} AS bic_scaled,
  {r('(gini_test / lag(gini_test) OVER (ORDER BY step) - 1) * 100', 6)} AS gini_test_pct_gain FROM h""")
def step_evolution(spark, folder):
    history = (
        table(spark, folder, "orders")
        .groupBy(F.year("o_orderdate").alias("step"))
        .agg(
            F.avg("o_totalprice").alias("bic"),
            F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("gini_test"),
            F.avg((F.col("o_orderstatus") == "O").cast("int")).alias("gini_train"),
            F.max("o_totalprice").alias("auc_pr"),
            F.min("o_totalprice").alias("rp"),
        )
    )
    result = selection.gini_evolution(history)
    result = rounded(result, 6, "gini_train", "gini_test", "bic_scaled", "gini_test_pct_gain")
    return rounded(result, 4, "bic")


# --- several variables: reweighted least squares as a recursive query ---------------------------

_THREE = ["priorite", "statut", "client"]


def _three(spark, folder):
    """Orders with three two-level variables that all move the target; even keys train, odd ones test."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        (F.col("o_orderpriority") < "3").cast("int").cast("string").alias("priorite"),
        (F.col("o_orderstatus") == "F").cast("int").cast("string").alias("statut"),
        F.pmod("o_custkey", F.lit(2)).cast("string").alias("client"),
    )
    limit = 150 + 250 * F.col("priorite").cast("int") + 120 * F.col("statut").cast("int") + 80 * F.col("client").cast("int")
    rows = orders.withColumn("y", (F.pmod(F.floor(F.col("o_orderkey") / 2) * 7919, F.lit(1000)) < limit).cast("int"))
    even = F.pmod("o_orderkey", F.lit(2)) == 0
    return rows.where(even).drop("o_orderkey"), rows.where(~even).drop("o_orderkey")


_STEPS = 25
#: Newton steps of all seven subsets side by side; `it` holds the coefficients after each step.
_IRLS = f"""WITH RECURSIVE u AS (
  SELECT o_orderkey, CAST(CAST(o_orderpriority < '3' AS INTEGER) AS VARCHAR) AS priorite, CAST(CAST(o_orderstatus = 'F' AS INTEGER) AS VARCHAR) AS statut,
         CAST(o_custkey % 2 AS VARCHAR) AS client FROM orders),
o AS (SELECT *, CAST((o_orderkey // 2 * 7919) % 1000 < 150 + 250 * CAST(priorite AS INTEGER) + 120 * CAST(statut AS INTEGER) + 80 * CAST(client AS INTEGER) AS INTEGER) AS y,
             o_orderkey % 2 AS side FROM u),
b1 AS (SELECT priorite AS base FROM o WHERE side = 0 GROUP BY 1 ORDER BY avg(y), 1 LIMIT 1),
b2 AS (SELECT statut AS base FROM o WHERE side = 0 GROUP BY 1 ORDER BY avg(y), 1 LIMIT 1),
b3 AS (SELECT client AS base FROM o WHERE side = 0 GROUP BY 1 ORDER BY avg(y), 1 LIMIT 1),
pat AS (SELECT CAST(priorite <> (SELECT base FROM b1) AS DOUBLE) AS x1, CAST(statut <> (SELECT base FROM b2) AS DOUBLE) AS x2,
               CAST(client <> (SELECT base FROM b3) AS DOUBLE) AS x3,
               CAST(count(*) FILTER (side = 0 AND y = 0) AS DOUBLE) AS a0, CAST(count(*) FILTER (side = 0 AND y = 1) AS DOUBLE) AS a1,
               CAST(count(*) FILTER (side = 1 AND y = 0) AS DOUBLE) AS s0, CAST(count(*) FILTER (side = 1 AND y = 1) AS DOUBLE) AS s1
        FROM o GROUP BY ALL),
m AS (SELECT CAST(m1 AS DOUBLE) AS m1, CAST(m2 AS DOUBLE) AS m2, CAST(m3 AS DOUBLE) AS m3
      FROM (VALUES (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (1, 1, 1)) AS v(m1, m2, m3)),
it AS (
  SELECT 0 AS k, m1, m2, m3, 0::DOUBLE AS c0, 0::DOUBLE AS c1, 0::DOUBLE AS c2, 0::DOUBLE AS c3,
         0::DOUBLE AS v1, 0::DOUBLE AS v2, 0::DOUBLE AS v3 FROM m
  UNION ALL
  SELECT k + 1, m1, m2, m3, c0 + d0, c1 + d1, c2 + d2, c3 + d3, i11 * i11 + i21 * i21 + i31 * i31, i22 * i22 + i32 * i32, i33 * i33 FROM (
    SELECT *, sqrt(h00) AS l00, h01 / l00 AS l10, h02 / l00 AS l20, h03 / l00 AS l30, sqrt(h11 - l10 * l10) AS l11, (h12 - l10 * l20) / l11 AS l21,
      (h13 - l10 * l30) / l11 AS l31, sqrt(h22 - l20 * l20 - l21 * l21) AS l22, (h23 - l20 * l30 - l21 * l31) / l22 AS l32,
      sqrt(h33 - l30 * l30 - l31 * l31 - l32 * l32) AS l33, g0 / l00 AS z0, (g1 - l10 * z0) / l11 AS z1, (g2 - l20 * z0 - l21 * z1) / l22 AS z2,
      (g3 - l30 * z0 - l31 * z1 - l32 * z2) / l33 AS z3, z3 / l33 AS d3, (z2 - l32 * d3) / l22 AS d2, (z1 - l21 * d2 - l31 * d3) / l11 AS d1,
      (z0 - l10 * d1 - l20 * d2 - l30 * d3) / l00 AS d0, 1 / l11 AS i11, 1 / l22 AS i22, 1 / l33 AS i33, -l21 * i11 / l22 AS i21, -l32 * i22 / l33 AS i32,
      -(l31 * i11 + l32 * i21) / l33 AS i31
    FROM (SELECT k, m1, m2, m3, c0, c1, c2, c3, sum(w) AS h00, sum(w * e1) AS h01, sum(w * e2) AS h02, sum(w * e3) AS h03,
            sum(w * e1) + 1 - m1 AS h11, sum(w * e1 * e2) AS h12, sum(w * e1 * e3) AS h13, sum(w * e2) + 1 - m2 AS h22, sum(w * e2 * e3) AS h23,
            sum(w * e3) + 1 - m3 AS h33, sum(q) AS g0, sum(q * e1) AS g1, sum(q * e2) AS g2, sum(q * e3) AS g3
          FROM (SELECT it.*, x1 * m1 AS e1, x2 * m2 AS e2, x3 * m3 AS e3, 1 / (1 + exp(-(c0 + c1 * e1 + c2 * e2 + c3 * e3))) AS p,
                       (a0 + a1) * p * (1 - p) AS w, a1 - (a0 + a1) * p AS q FROM it, pat WHERE k < {_STEPS})
          GROUP BY k, m1, m2, m3, c0, c1, c2, c3))),
fit AS (SELECT * FROM it WHERE k = {_STEPS}),
sc AS (SELECT m1, m2, m3, 1 / (1 + exp(-(c0 + c1 * x1 * m1 + c2 * x2 * m2 + c3 * x3 * m3))) AS p, sum(a0) AS a0, sum(a1) AS a1, sum(s0) AS s0, sum(s1) AS s1
       FROM fit, pat GROUP BY ALL),
run AS (SELECT *, coalesce(sum(s0) OVER (PARTITION BY m1, m2, m3 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0_before FROM sc),
sets AS (SELECT m1, m2, m3, m1 + m2 + m3 AS size, -2 * sum(a1 * ln(p + 1e-15::DOUBLE) + a0 * ln(1 - p + 1e-15::DOUBLE)) + (1 + m1 + m2 + m3) * ln(sum(a0) + sum(a1)) AS bic,
                2 * sum(s1 * (s0_before + s0 / 2)) / (sum(s0) * sum(s1)) - 1 AS gini FROM run GROUP BY m1, m2, m3),
named AS (SELECT *, list_filter([CASE WHEN m1 = 1 THEN 'priorite' END, CASE WHEN m2 = 1 THEN 'statut' END, CASE WHEN m3 = 1 THEN 'client' END], lambda x: x IS NOT NULL) AS vars FROM sets)"""


def _path_ctes(score: str, gain: str, loss: str) -> str:
    """`h`: forward steps while the score falls by `gain`, and after the third one the removal that keeps it."""
    return f"""{_IRLS},
s AS (SELECT *, {score} AS score FROM named),
f1 AS (SELECT vars, score, vars[1] AS v FROM s WHERE size = 1 ORDER BY score LIMIT 1),
f2 AS (SELECT s.vars, s.score, list_filter(s.vars, lambda x: x <> f1.v)[1] AS v FROM s, f1 WHERE size = 2 AND list_contains(s.vars, f1.v) ORDER BY s.score LIMIT 1),
o2 AS (SELECT f2.* FROM f1, f2 WHERE f2.score < f1.score - {gain}),
o3 AS (SELECT s.vars, s.score, list_filter(s.vars, lambda x: NOT list_contains(o2.vars, x))[1] AS v FROM s, o2 WHERE size = 3 AND s.score < o2.score - {gain}),
r4 AS (SELECT s.vars, s.score, list_filter(o3.vars, lambda x: NOT list_contains(s.vars, x))[1] AS v FROM s, o3 WHERE size = 2 ORDER BY s.score LIMIT 1),
o4 AS (SELECT r4.* FROM r4, o3 WHERE r4.score < o3.score + {loss}),
h AS (SELECT 1 AS step, 'add' AS action, v, score, vars FROM f1 UNION ALL SELECT 2, 'add', v, score, vars FROM o2
      UNION ALL SELECT 3, 'add', v, score, vars FROM o3 UNION ALL SELECT 4, 'remove', v, score, vars FROM o4)"""


def _path_sql(score: str, gain: str, loss: str) -> str:
    return f"""{_path_ctes(score, gain, loss)}
SELECT CAST(step AS INTEGER) AS step, action, v AS variable, CAST(len(vars) AS INTEGER) AS n_vars, {r('score', 4)} AS best_score FROM h"""


def _path(spark, folder, **options):
    train, test = _three(spark, folder)
    learned = encoding.get_dummies(train, "y", _THREE)
    encoded = encoding.get_test_dummies(test, learned.categ, keep=["y"])
    history = selection.stepwise_selection_categorical(learned.frame, encoded, "y", _THREE, **options).history
    return history


@query(_path_sql("bic", "0", "0"))
def stepwise_by_bic(spark, folder):
    """Several additions and the removal test, thresholds as they are."""
    history = _path(spark, folder)
    return rounded(history.select("step", "action", "variable", F.size("selected_vars").alias("n_vars"), "best_score"), 4, "best_score")


@query(_path_sql("-gini", "0.0005", "0"))
def stepwise_three_by_gini(spark, folder):
    history = _path(spark, folder, criterion="gini")
    return rounded(history.select("step", "action", "variable", F.size("selected_vars").alias("n_vars"), "best_score"), 4, "best_score")


@query(f"""{_path_ctes("-gini", "0.0005", "0")},
e AS (SELECT step, bic, gini FROM h JOIN named USING (vars)), w AS (SELECT min(bic) AS low, max(bic) AS high FROM e)
SELECT CAST(step AS INTEGER) AS step, {r('gini', 6)} AS gini_test, {r('bic', 4)} AS bic, {r('coalesce((bic - low) / nullif(high - low, 0), 0)', 6)} AS bic_scaled,
  {r('(gini / lag(gini) OVER (ORDER BY step) - 1) * 100', 4)} AS gini_test_pct_gain FROM e, w""")
def stepwise_evolution(spark, folder):
    """The evolution of the steps that `stepwise_three_by_gini` took."""
    result = selection.gini_evolution(_path(spark, folder, criterion="gini")).drop("gini_train", "auc_pr", "rp")
    return rounded(rounded(result, 6, "gini_test", "bic_scaled"), 4, "bic", "gini_test_pct_gain")


@query(f"""{_IRLS}, one AS (SELECT * FROM fit WHERE m1 + m2 + m3 = 3),
c AS (SELECT 'priorite' AS variable, CASE (SELECT base FROM b1) WHEN '0' THEN '1' ELSE '0' END AS level, c1 AS coef, sqrt(v1) AS se FROM one UNION ALL
      SELECT 'statut', CASE (SELECT base FROM b2) WHEN '0' THEN '1' ELSE '0' END, c2, sqrt(v2) FROM one UNION ALL
      SELECT 'client', CASE (SELECT base FROM b3) WHEN '0' THEN '1' ELSE '0' END, c3, sqrt(v3) FROM one)
SELECT variable, level, {r('coef', 6)} AS coef, {r('se', 6)} AS std_error, {r('coef / se', 3)} AS wald_z FROM c""")
def logit_three_variables(spark, folder):
    """Coefficients and Wald errors of three variables, from raw level columns."""
    fit = newton.fit_by_levels(*_three(spark, folder), "y", _THREE)
    return rounded(rounded(fit.coefficient_table(spark).drop("pvalue"), 6, "coef", "std_error"), 3, "wald_z")


@query(f"""WITH {LOANS}, k AS (SELECT l_orderkey, y, CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS cle, ligne FROM loans),
long AS (SELECT l_orderkey, y, 'cle' AS variable, cle AS level FROM k UNION ALL SELECT l_orderkey, y, 'ligne', coalesce(CAST(ligne AS VARCHAR), 'MISSING') FROM k),
{_ranks('true')},
named AS (SELECT variable, level, CAST(rang AS INTEGER) AS code, row_number() OVER (ORDER BY variable, rang) AS colonne FROM rk WHERE rang > 0)
SELECT named.variable || '&' || named.level AS nom, colonne, code, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS somme_cle
FROM named JOIN long USING (variable, level) GROUP BY ALL""")
def sparse_encoding(spark, folder):
    """Every row of lineitem a level of its own, beside a small variable: codes and active columns."""
    df = loans(spark, folder).select(
        "l_orderkey", "y", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("cle"), "ligne"
    )
    order = sparse.level_order(df, ["cle", "ligne"], "y")
    encoded = sparse.encode_levels(df, order, ["cle", "ligne"], keep=["l_orderkey"], on_mismatch="zero")
    active = encoded.select("l_orderkey", F.explode("colonnes").alias("colonne"))
    counted = active.groupBy("colonne").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("somme_cle"))
    names = sparse.column_names(order).join(order.select("colonne", "code"), "colonne")
    return counted.join(names, "colonne").select("nom", "colonne", "code", "n", "somme_cle")


# --- scorecard --------------------------------------------------------------------------------


def _scorecard_sql(learned_on: str, variables: str, digits: int, points: int) -> str:
    """One-variable coefficients are log-odds of each level against its base."""
    return f"""WITH {LOANS}, {_LONG}, {_ranks(learned_on)},
cf AS (SELECT variable, level, ln(rate / (1 - rate)) - first_value(ln(rate / (1 - rate))) OVER (PARTITION BY variable ORDER BY rang) AS coef, rang
       FROM rk WHERE {variables}),
tops AS (SELECT variable, max(coef) AS coef_max FROM cf WHERE rang > 0 GROUP BY variable),
s AS (SELECT rk.variable, rk.level, rate * 100 AS taux_cible, n / CAST((SELECT count(*) FROM loans WHERE {learned_on}) AS DOUBLE) * 100 AS taux_pop,
        CASE WHEN rk.rang > 0 THEN coef ELSE 0 END AS coef, lead(rate) OVER (PARTITION BY rk.variable ORDER BY rate, rk.level) AS nxt, rate,
        1000 * (coef_max - CASE WHEN rk.rang > 0 THEN coef ELSE 0 END) / (SELECT sum(coef_max) FROM tops) AS points
      FROM rk JOIN cf USING (variable, level) JOIN tops ON tops.variable = rk.variable)
SELECT variable, level, {r('taux_cible', 6)} AS taux_cible, {r('taux_pop', 6)} AS taux_pop, {r('coef', digits)} AS coef,
       {r('(nxt / rate - 1) * 100', 6)} AS ecart_relatif, {r('points', points)} AS points_1000,
       {r('greatest(max(points) OVER (PARTITION BY variable), 0) / 10', points)} AS contribution FROM s"""


def _card(df, coefficients, digits, points):
    card = scorecard.summarize_model(df, "y", coefficients).drop("pvalue")
    card = rounded(card, 6, "taux_cible", "taux_pop", "ecart_relatif")
    return rounded(rounded(card, digits, "coef"), points, "points_1000", "contribution")


@query(_scorecard_sql("true", "true", 6, 4))
def scorecard_points(spark, folder):
    df = loans(spark, folder).select("l_orderkey", "y", *_VARIABLES)
    ranked = levels.risk_order(df, _VARIABLES, "y")
    odds = F.ln(F.col("taux") / (1 - F.col("taux")))
    base = ranked.where(F.col("rang") == 0).select("variable", odds.alias("base"))
    coefficients = (
        ranked.where(F.col("rang") > 0)
        .join(base, "variable")
        .select("variable", "level", (odds - F.col("base")).alias("coef"), F.lit(None).cast("double").alias("pvalue"))
    )
    return _card(df, coefficients, 6, 4)


@query(_scorecard_sql(_TRAIN, "variable = 'ligne'", 4, 0))
def scorecard_from_fit(spark, folder):
    train, _ = _split(spark, folder)
    return _card(train, _line_model(spark, folder).coefficient_table(spark), 4, 0)


# --- folds and boosted trees --------------------------------------------------------------------


@query("""WITH o AS (SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders), n AS (SELECT y, count(*) AS n FROM o GROUP BY y)
SELECT CAST(f AS INTEGER) AS fold, y, n // 3 + CAST(f < n % 3 AS BIGINT) AS effectif FROM n, (SELECT unnest([0, 1, 2]) AS f)""")
def fold_balance(spark, folder):
    orders = table(spark, folder, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    dealt = folds.stratified_folds(orders, "y", ["o_orderkey"])
    return dealt.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("effectif"))


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderpriority < '5' THEN CAST(o_orderstatus = 'F' AS INTEGER) END AS y FROM orders)
SELECT o_orderkey, y, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM o""")
def fold_of_each_row(spark, folder):
    """Five folds row by row; orders of the last priority have no target."""
    known = F.when(F.col("o_orderpriority") < "5", (F.col("o_orderstatus") == "F").cast("int"))
    orders = table(spark, folder, "orders").select("o_orderkey", known.alias("y"))
    return folds.stratified_folds(orders, "y", ["o_orderkey"], k=5)


@query(f"""WITH o AS (SELECT o_orderkey % 3 AS fold, o_orderpriority < '3' AS x, o_orderpriority < '3' OR o_orderkey % 5 = 0 AS y FROM orders),
f AS (SELECT fold, CAST(count(*) FILTER (x AND y) AS DOUBLE) / count(*) FILTER (y) AS tpr,
             CAST(count(*) FILTER (x AND NOT y) AS DOUBLE) / count(*) FILTER (NOT y) AS fpr FROM o GROUP BY fold)
SELECT CAST(rang AS INTEGER) AS rang, {r('auc', 6)} AS auc_cv FROM (SELECT avg(0.5::DOUBLE + (tpr - fpr) / 2) AS auc FROM f), (SELECT unnest([1, 2, 3]) AS rang)""")
def boosted_tree_search(spark, folder):
    """One 0/1 feature: trees that split rank its two values by risk, whatever their settings, so
    the AUC over the given folds has a closed form. Few rounds; all other ranges as they are."""
    high = F.col("o_orderpriority") < "3"
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        high.cast("int").alias("x"),
        (high | (F.col("o_orderkey") % 5 == 0)).cast("int").alias("y"),
        (F.col("o_orderkey") % 3).cast("int").alias("fold"),
    )
    found = folds.boosted_tree_search(
        orders, ["x"], "y", ["o_orderkey"], n_trials=3, k=3, space={"maxIter": ("int", 3, 6)}, fold="fold"
    )
    return rounded(found.select("rang", "auc_cv"), 6, "auc_cv")


# --- variable graph ---------------------------------------------------------------------------


def _clusters(spark, folder):
    """Part types with their brands, most frequent first, then brands with their types."""
    part = table(spark, folder, "part")

    def cluster(key, other, order):
        counts = part.groupBy(key, other).agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy(key).agg(
            F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(other).alias("o")))), lambda s: s.o).alias("correlees")
        ).select(F.lit(order).cast("long").alias("ordre"), F.col(key).alias("representant"), "correlees")

    return cluster("p_type", "p_brand", 0).unionByName(cluster("p_brand", "p_type", 1))


@query("""SELECT DISTINCT p_type AS id, 'representant' AS type FROM part UNION SELECT DISTINCT p_brand, 'representant' FROM part""")
def graph_nodes(spark, folder):
    return graph.graph_nodes(_clusters(spark, folder))


@query("""SELECT DISTINCT p_type AS id, 'representant' AS type FROM part UNION SELECT DISTINCT p_brand, 'correlee' FROM part""")
def graph_nodes_one_way(spark, folder):
    return graph.graph_nodes(_clusters(spark, folder).where("ordre = 0"))


@query("""WITH c AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL),
e AS (SELECT least(p_type, p_brand) AS a, greatest(p_type, p_brand) AS b,
      CAST(row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS INTEGER) AS rang FROM c)
SELECT a, b, rang, round_even(1.0::DOUBLE / rang * 1e6, 0) / 1e6 AS poids, round_even(3.0::DOUBLE / rang * 1e6, 0) / 1e6 AS largeur FROM e""")
def graph_edges(spark, folder):
    return rounded(graph.graph_edges(_clusters(spark, folder)), 6, "poids", "largeur")
