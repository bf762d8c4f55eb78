"""URL filter: hand-written rules first, then a ratio of two character language models.

The URLs that the rules allow and block teach one variable-order Markov model each. All counts of
(context, next character) over those URLs make the models: totals, types and smoothed log ratios
are computed in Spark, one context length after another. A model that was counted small is
broadcast; a larger one is joined to the distinct grams of the URLs, with the same scores. The
score of a URL is its log-likelihood difference per character, and the cut is calibrated to lie
halfway between the two classes' mean scores. (Deviations are left out of it: the models know the
URLs they are calibrated on, so their spread is too small.)
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.sources.shared import write_shared

from .common import ASCII_UPPER

ORDER = 5
BROADCAST_GRAMS = 150_000  # a model of more counts is joined by shuffle


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        inside = (host == self.host) | host.endswith("." + self.host)
        return inside & path.startswith(self.path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for NULL and for a text without `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, ASCII_UPPER, ASCII_UPPER.lower()), path


def matching_rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits; NULL if none does."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict")))
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        out = out.when(
            rule.fits(host, path), F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        )
    return out


class UrlModel:
    """Difference of two Witten-Bell smoothed models in back-off form.

    `seen[context + character]` is the log ratio of the interpolated probabilities, and
    `back[context]` what is added where a character was not seen after a context.
    """

    def __init__(self, counts: Sequence[tuple[str, str, int, int]], order: int):
        self.order = order
        totals: dict[str, list[int]] = {}
        for context, _, a, b in counts:
            t = totals.setdefault(context, [0, 0, 0, 0])
            t[0] += a
            t[1] += b
            t[2] += a > 0
            t[3] += b > 0
        self.back = {c: _log_share(t[0], t[2]) - _log_share(t[1], t[3]) for c, t in totals.items()}
        prob: dict[str, tuple[float, float]] = {}
        self.seen: dict[str, float] = {}

        def lower(context: str, ch: str) -> tuple[float, float]:
            scale_a = scale_b = 1.0
            while True:
                if context + ch in prob and context in totals:
                    a, b = prob[context + ch]
                    return scale_a * a, scale_b * b
                if t := totals.get(context):
                    scale_a *= t[2] / (t[0] + t[2]) if t[0] else 1.0
                    scale_b *= t[3] / (t[1] + t[3]) if t[1] else 1.0
                if not context:
                    return scale_a / 256, scale_b / 256
                context = context[1:]

        for context, ch, a, b in sorted(counts, key=lambda r: len(r[0])):
            low_a, low_b = lower(context[1:], ch) if context else (1 / 256, 1 / 256)
            na, nb, ta, tb = totals[context]
            pa = (a + ta * low_a) / (na + ta) if na else low_a
            pb = (b + tb * low_b) / (nb + tb) if nb else low_b
            prob[context + ch] = (pa, pb)
            self.seen[context + ch] = math.log(pa / pb)


def score_text(text: str, seen: dict[str, float], back: dict[str, float], order: int) -> float:
    """Log-likelihood difference per character; 0 for an empty text."""
    total, padded = 0.0, "\n" + text
    for i in range(1, len(padded)):
        for j in range(max(0, i - order), i + 1):
            found = seen.get(padded[j : i + 1])
            if found is not None:
                total += found
                break
            total += back.get(padded[j:i], 0.0)
    return total / len(text) if text else 0.0


def _log_share(n: int, types: int) -> float:
    return math.log(types / (n + types)) if n else 0.0


def context_counts(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """(context, ch, a, b) over all rows of (text, allowed): counts of ch after each context."""
    padded = F.concat(F.lit("\n"), "text")
    at = urls.select(
        padded.alias("s"), "allowed", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("i")
    )
    longest = F.least(F.col("i"), F.lit(order))
    grams = at.select(
        "s", "allowed", "i", F.explode(F.sequence(F.lit(0), longest)).alias("k")
    ).select(
        "allowed",
        F.substring(F.col("s"), F.col("i") - F.col("k") + 1, F.col("k")).alias("context"),
        F.substring(F.col("s"), F.col("i") + 1, F.lit(1)).alias("ch"),
    )
    return grams.groupBy("context", "ch").agg(
        F.sum(F.col("allowed").cast("long")).alias("a"), F.sum(1 - F.col("allowed").cast("long")).alias("b")
    )


def smoothed(counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """(context, ch, ratio) of every count, and (context, back) of every context: UrlModel in Spark.

    The suffix of a counted gram is counted too, so a gram's lower probabilities are one row of the
    shorter contexts.
    """
    totals = write_shared(
        counts.groupBy("context").agg(
            F.sum("a").alias("na"),
            F.sum("b").alias("nb"),
            F.sum((F.col("a") > 0).cast("long")).alias("ta"),
            F.sum((F.col("b") > 0).cast("long")).alias("tb"),
        )
    )

    def mixed(count: str, total: str, types: str, low: str) -> Column:
        share = (F.col(count) + F.col(types) * F.col(low)) / F.nullif(F.col(total) + F.col(types), F.lit(0))
        return F.coalesce(share, F.col(low))

    every = counts.join(totals, "context")
    levels: list[DataFrame] = []
    for k in range(order + 1):
        level = every.where(F.length("context") == k)
        if levels:
            shorter = levels[-1].select(
                F.col("context").alias("suffix"), "ch", F.col("pa").alias("low_a"), F.col("pb").alias("low_b")
            )
            level = level.withColumn("suffix", F.substring("context", 2, k)).join(shorter, ["suffix", "ch"])
        else:
            level = level.withColumns({"low_a": F.lit(1 / 256), "low_b": F.lit(1 / 256)})
        level = level.select(
            "context", "ch", mixed("a", "na", "ta", "low_a").alias("pa"), mixed("b", "nb", "tb", "low_b").alias("pb")
        )
        levels.append(write_shared(level))
    grams = levels[0]
    for level in levels[1:]:
        grams = grams.unionAll(level)

    def log_share(total: str, types: str) -> Column:
        return F.when(F.col(total) > 0, F.log(F.col(types) / (F.col(total) + F.col(types)))).otherwise(F.lit(0.0))

    return (
        grams.select("context", "ch", F.log(F.col("pa") / F.col("pb")).alias("ratio")),
        totals.select("context", (log_share("na", "ta") - log_share("nb", "tb")).alias("back")),
    )


def joined_scores(texts: DataFrame, grams: DataFrame, backs: DataFrame, order: int = ORDER) -> DataFrame:
    """(text, score) of the distinct non-empty texts, by joins with the whole model.

    A text's grams of `order` + 1 characters (shorter at its start) are counted first, and each
    distinct gram is looked up once, from its longest context down.
    """
    padded = F.concat(F.lit("\n"), "text")
    at = texts.select("text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("i"))
    k = F.least(F.col("i"), F.lit(order))
    held = write_shared(
        at.select("text", F.substring(padded, F.col("i") - k + 1, k + 1).alias("gram"))
        .groupBy("text", "gram")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    # `left` is what is still looked up of a gram, one character less after each miss
    current = held.select("gram").distinct().withColumns({"left": F.col("gram"), "value": F.lit(0.0)})
    done = None
    for size in range(order + 1, 0, -1):
        rows = grams.where(F.length("context") == size - 1).select(F.concat("context", "ch").alias("left"), "ratio")
        off = backs.where(F.length("context") == size - 1)
        looked = (
            current.where(F.length("left") == size)
            .join(rows, "left", "left")
            .withColumn("context", F.substring("left", 1, size - 1))
            .join(off, "context", "left")
        )
        looked = write_shared(
            looked.select(
                "gram",
                "left",
                (F.col("value") + F.coalesce("ratio", "back", F.lit(0.0))).alias("value"),
                (F.col("ratio").isNotNull() | F.lit(size == 1)).alias("found"),
            )
        )
        ended = looked.where("found").select("gram", "value")
        done = ended if done is None else done.unionAll(ended)
        again = looked.where("NOT found").select("gram", F.substring("left", 2, size).alias("left"), "value")
        current = current.where(F.length("left") < size).unionAll(again)
    return (
        held.join(done, "gram")
        .groupBy("text")
        .agg((F.sum(F.col("times") * F.col("value")) / F.first(F.length("text"))).alias("score"))
    )


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    id_column: str = "page_id",
    url: str = "url",
    broadcast_grams: int = BROADCAST_GRAMS,
) -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row per row of `pages`.

    `score` is the models' log-likelihood difference per character of host and path, for every row.
    A row that no rule fits is allowed if its score reaches the calibrated cut. If no URL was
    allowed or none blocked by rule, nothing can be learned and the rest is allowed. NULL and empty
    URLs have empty host and path and the score 0. Repeated rows are judged alike.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(f"`{url}`"))
    parsed = pages.select(F.col(f"`{id_column}`").alias("page_id"), host.alias("host"), path.alias("path"))
    ruled = parsed.withColumn("hit", matching_rule(rules, F.col("host"), F.col("path")))
    ruled = ruled.withColumn("text", F.concat("host", "path"))
    taught = ruled.where("hit IS NOT NULL").select("text", (F.col("hit.verdict") == "allow").alias("allowed"))
    counts = write_shared(context_counts(taught.where(F.length("text") > 0)))
    if counts.count() <= broadcast_grams:
        model = UrlModel([tuple(r) for r in counts.collect()], ORDER)
        shared = spark.sparkContext.broadcast((model.seen, model.back, model.order))

        @F.pandas_udf("double")
        def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            seen, back, order = shared.value
            for batch in texts:
                yield pd.Series([score_text(t, seen, back, order) for t in batch], index=batch.index)

        judged = ruled.withColumn("score", scored("text"))
    else:
        grams, backs = smoothed(counts)
        texts = ruled.where(F.length("text") > 0).select("text").distinct()
        scores = write_shared(joined_scores(texts, grams, backs))
        # empty texts have no score and do not meet in one task of the join
        full = ruled.where(F.length("text") > 0).join(scores, "text")
        empty = ruled.where(F.length("text") == 0).withColumn("score", F.lit(0.0))
        judged = full.unionByName(empty)
    stats = (
        judged.where("hit IS NOT NULL")
        .groupBy((F.col("hit.verdict") == "allow").alias("allowed"))
        .agg(F.avg("score").alias("mean"))
        .collect()
    )
    cut = sum(r["mean"] for r in stats) / 2 if len(stats) == 2 else -math.inf
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", F.when(F.col("score") >= cut, "allow").otherwise("block")).alias("verdict"),
        "score",
    )
