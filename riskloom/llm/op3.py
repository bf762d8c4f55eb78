"""op3: write `pages` as WARC archives with revisits, and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.shared import write_shared

from .common import broadcast_if_small, table
from .warc import archive_folder, read_archives, write_archives

LEAST_BYTES = 100


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: one row per row of `pages`.

    Of equal payloads of at least LEAST_BYTES the one with the smallest id is a response and the
    others refer to it. NULL html is an empty payload. Rows without an id are never referred to;
    rows that repeat the smallest id and its payload are responses each.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn(
        "digest", F.sha2("payload", 256)
    )
    # narrow rows only; a payload that thousands of pages share is one partial row per task
    groups = write_shared(
        rows.where((F.octet_length("payload") >= LEAST_BYTES))
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select("digest", "first")
    )
    linked = rows.join(broadcast_if_small(groups, most=200_000), "digest", "left")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first"))
    manifest = write_shared(write_archives(linked.withColumn("refers_to", refers), archive_folder(spark)))
    found = write_shared(read_archives(spark, manifest))
    # a revisit takes length and digest from the response that it refers to
    sources = (
        found.where("record_type = 'response' AND page_id IS NOT NULL")
        .join(broadcast_if_small(groups, most=200_000).withColumnRenamed("digest", "group_digest"),
              (F.col("page_id") == F.col("first")) & (F.col("payload_digest") == F.col("group_digest")), "left_semi")
        .select(F.col("page_id").alias("target"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"))
        .distinct()
    )
    back = found.join(
        broadcast_if_small(sources, most=200_000),
        (F.col("refers_to") == F.col("target")) & (F.col("digest") == F.col("d")),
        "left",
    )
    return back.select(
        "page_id",
        F.coalesce("payload_bytes", "b").alias("payload_bytes"),
        F.coalesce("payload_digest", "d").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(table(spark, folder, "pages").select("page_id", "url", "html"))


QUERIES = {"op3_warc_round_trip": warc_round_trip}
SQL = {
    "op3_warc_round_trip": """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest AS d, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p LEFT JOIN f ON d = payload_digest"""
}
