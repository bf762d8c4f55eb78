"""Brute-force numpy versions of what the library computes, for small inputs."""

import math

import numpy as np
import pandas as pd


def rows(df, *order):
    """Collected rows as tuples, sorted by the given columns."""
    found = [r.asDict() for r in df.collect()]
    return sorted(found, key=lambda r: tuple((r[c] is None, r[c]) for c in order))


def sample_frame(n=400, seed=0, levels=("a", "b", "c", "d")):
    """Loans with missing values, NaN, ties, a rare level and uneven months."""
    g = np.random.default_rng(seed)
    level = g.choice(levels, n, p=[0.4, 0.3, 0.25, 0.05]).astype(object)
    risk = pd.Series(level).map(dict(zip(levels, (0.1, 0.25, 0.5, 0.7)))).to_numpy(dtype=float)
    x = np.round(g.lognormal(3, 0.7, n), 1)
    frame = pd.DataFrame(
        {
            "id": np.arange(n),
            "niveau": level,
            "x": x,
            "mois": g.choice(["2024-01", "2024-02", "2024-03", "2024-04"], n),
            "y": (g.random(n) < risk).astype(float),
        }
    )
    frame.loc[g.choice(n, n // 12, replace=False), "niveau"] = None
    frame.loc[g.choice(n, n // 15, replace=False), "x"] = np.nan
    frame.loc[g.choice(n, n // 20, replace=False), "y"] = np.nan
    frame.loc[g.choice(n, n // 25, replace=False), "mois"] = None
    return frame


def to_spark(spark, frame):
    """NaN in object columns becomes NULL, in float columns stays NaN."""
    records = []
    for row in frame.itertuples(index=False):
        records.append(tuple(None if v is None else (v.item() if hasattr(v, "item") else v) for v in row))
    kinds = {"f": "double", "i": "long", "O": "string", "U": "string"}
    schema = ", ".join(f"`{c}` {kinds.get(frame[c].dtype.kind, 'string')}" for c in frame.columns)
    return spark.createDataFrame(records, schema)


def np_round(x, d):
    return np.rint(np.asarray(x, dtype=float) * 10**d) / 10**d


def woe_frame(counts):
    """counts: DataFrame with effectif, nb_defaut."""
    t = counts.copy()
    t["nb_non_defaut"] = t.effectif - t.nb_defaut
    t["dd"] = t.nb_defaut / t.nb_defaut.sum()
    t["dn"] = t.nb_non_defaut / t.nb_non_defaut.sum()
    t["WoE"] = np_round(np.log(t.dn.clip(lower=1e-10) / t.dd.clip(lower=1e-10)), 4)
    t["IV"] = np_round((t.dn - t.dd) * t.WoE, 6)
    return t


def chi2_table(o):
    o = np.asarray(o, dtype=float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    dof = (o.shape[0] - 1) * (o.shape[1] - 1)
    if dof == 0:
        return 0.0, 0
    gap = np.abs(o - e)
    if dof == 1:
        gap = gap - np.minimum(0.5, gap)
    return float((gap**2 / e).sum()), dof


def pair_wins(low, high):
    """Pairs (a in low, b in high) with a > b, ties counted half."""
    low, high = np.asarray(low)[:, None], np.asarray(high)[None, :]
    return float((low > high).sum() + 0.5 * (low == high).sum())


def average_precision(y, s):
    total = 0.0
    y, s = np.asarray(y), np.asarray(s)
    recall = 0.0
    for cut in sorted(set(s), reverse=True):
        called = s >= cut
        hit = (y[called] == 1).sum()
        step = hit / (y == 1).sum()
        total += (step - recall) * hit / called.sum()
        recall = step
    return float(total)


def newton_logit(x, y, w=None, steps=60):
    """Coefficients (intercept first) and standard errors."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.ones(len(y)) if w is None else w
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ beta))
        h = x.T @ (x * (w * p * (1 - p))[:, None])
        beta = beta + np.linalg.solve(h, x.T @ (w * (y - p)))
    p = 1 / (1 + np.exp(-x @ beta))
    h = x.T @ (x * (w * p * (1 - p))[:, None])
    return beta, np.sqrt(np.diag(np.linalg.inv(h)))


def logit_metrics(xtr, ytr, xte, yte):
    beta, _ = newton_logit(xtr, ytr)
    ptr = 1 / (1 + np.exp(-(beta[0] + xtr @ beta[1:])))
    pte = 1 / (1 + np.exp(-(beta[0] + xte @ beta[1:])))
    # equal feature rows must tie whatever the order of summation
    ptr, pte = np.round(ptr, 12), np.round(pte, 12)

    def auc(y, p):
        return pair_wins(p[y == 1], p[y == 0]) / ((y == 1).sum() * (y == 0).sum())

    ll = float((ytr * np.log(ptr + 1e-15) + (1 - ytr) * np.log(1 - ptr + 1e-15)).sum())
    k = xtr.shape[1] + 1
    ap = average_precision(yte, pte)
    return {
        "aic": -2 * ll + 2 * k,
        "bic": -2 * ll + k * math.log(len(ytr)),
        "gini_train": 2 * auc(ytr, ptr) - 1,
        "brier_train": float(((ptr - ytr) ** 2).mean()),
        "gini_test": 2 * auc(yte, pte) - 1,
        "auc_pr": ap,
        "rp": ap / yte.mean(),
        "brier_test": float(((pte - yte) ** 2).mean()),
    }
