"""op8: mixing the sources of `documents` to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import spaced, table
from .mixing import copies, mix


def mixed_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: each row as often as the mix takes it, the last copy cut to its words.

    Columns as in `docs`; rows without words are in no copy. A part copy ends with its last word.
    """
    columns = docs.columns
    # equal rows differ in `taken` only where the budget ends, so a few runs describe any number of them
    group = W.partitionBy("doc_id", "tie", "source").orderBy("taken")
    taken = (
        mix(docs.select("doc_id", "text", "source"))
        .where("taken > 0")
        .groupBy("doc_id", "tie", "source", "size", "taken")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("upto", F.sum("rows").over(group))
        .groupBy("doc_id", "tie", "source")
        .agg(F.array_sort(F.collect_list(F.struct("upto", "size", "taken"))).alias("__runs"))
    )
    id_, source = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.coalesce("source", F.lit(""))
    keys = {
        "__k1": id_,
        "__k2": F.col("doc_id").isNull(),
        "__k4": source,
        "__k5": F.col("source").isNull(),
    }
    left = docs.withColumns(keys | {"__k3": F.md5(F.coalesce("text", F.lit("")))})
    right = taken.withColumns(keys).withColumnRenamed("tie", "__k3").drop("doc_id", "source")
    on = ["__k1", "__k2", "__k3", "__k4", "__k5"]
    numbered = left.join(right, on).withColumn(
        "__row", F.row_number().over(W.partitionBy(*on).orderBy(F.lit(0)))
    )
    # rows beyond the last run are not taken
    run = F.get(F.filter("__runs", lambda r: r["upto"] >= F.col("__row")), F.lit(0))
    each = numbered.withColumn("__run", run).where("__run IS NOT NULL")
    each = each.withColumn("__take", F.explode(copies(F.col("__run.size"), F.col("__run.taken"))))
    # only a part copy is cut apart: at single spaces, so that joining gives the prefix's length
    short = F.col("__take") < F.col("__run.size")
    each = each.withColumn("__parts", F.when(short, F.split(spaced(F.col("text")), " ")))
    filled = F.filter(F.sequence(F.lit(0), F.size("__parts") - 1), lambda i: F.get("__parts", i) != "")
    last = F.element_at(filled, F.col("__take").cast("int"))
    prefix = F.array_join(F.slice("__parts", F.lit(1), last + 1), " ")
    part = F.substring(F.col("text"), F.lit(1), F.length(prefix))
    text = F.when(F.col("__parts").isNotNull(), part).otherwise(F.col("text"))
    return each.withColumn("text", text).select(*[F.col(f"`{c}`") for c in columns])


_CTES = r"""
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
             md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key, md5(coalesce(text, '')) AS tie
      FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM s),
l AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio,
             (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(cap) OVER b, 0) AS DOUBLE))
             / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS lv
      FROM w WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size,
             CASE WHEN v IS NULL OR v * weight >= cap THEN CAST(cap AS DOUBLE) ELSE v * weight END AS target
      FROM l, (SELECT arg_min(lv, ratio) AS v FROM l WHERE lv <= ratio)),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id NULLS FIRST, size, tie ROWS UNBOUNDED PRECEDING) - d.size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)"""

QUERIES = {"op8_mixed_sources": mixed_sources}
SQL = {
    "op8_mixed_sources": f"""WITH {_CTES}
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(coalesce(budget // nullif(source_size, 0) * size
    + greatest(0, least(size, budget - budget // nullif(source_size, 0) * source_size - before)), 0) AS BIGINT) AS taken
FROM r"""
}
