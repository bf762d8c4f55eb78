"""op2: allow or block every URL of `pages`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .urls import Rule, judge

RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "pages").select("page_id", "url"), RULES)


QUERIES = {"op2_url_verdicts": url_verdicts}
SQL: dict[str, str] = {}
