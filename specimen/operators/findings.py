"""One shape for the findings of every operator family, and their order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "subject string, id string, severity string, category string, title string, detail string, n bigint, examples array<string>, examples_truncated boolean, priority int"
TIER = {"danger": 0, "warning": 0, "notice": 1, "info": 2}


def finding(rows: DataFrame, subject: Column, rule: Column, severity: Column | str, category: Column | str, rank: Column | int, title: Column | str, detail: Column | str, n: Column, examples: Column | None = None, cap: int = 12) -> DataFrame:
    """Rows in which a rule fired, as findings.  Counts are exact, examples are capped and say so."""
    sev = F.lit(severity) if isinstance(severity, str) else severity
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    ex = F.coalesce(examples, F.array().cast("array<string>")) if examples is not None else F.array().cast("array<string>")
    tier = F.element_at(F.create_map(*[F.lit(x) for kv in TIER.items() for x in kv]), sev)
    return rows.select(subject.cast("string").alias("subject"), rule.alias("id"), sev.alias("severity"), text(category).alias("category"), text(title).alias("title"), text(detail).alias("detail"), n.cast("bigint").alias("n"), F.slice(ex, 1, cap).alias("examples"), (F.size(ex) > cap).alias("examples_truncated"), (tier * 1000 + F.lit(rank) * 10).cast("int").alias("priority"))


def gather(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SCHEMA)


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("priority", "subject", "title", "id")
