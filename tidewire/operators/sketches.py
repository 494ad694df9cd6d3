"""Approximate facets from sketches kept by day: a range of days merges its days' sketches and reads no rows.

Most frequent values come from sketches of at most ``items`` values (exact while a range has no more distinct ones; beyond, a count
is off by at most about 3.5 / ``items`` of the range's rows, by the published bound of such sketches). Distinct counts come from HLL sketches with
2^``precision`` registers (relative error about 0.83 / sqrt(2^precision): 1.3 % at 12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_days(rows: DataFrame, folder: str, at: str, value: str, distinct: str, by: list[str] | None = None, items: int = 4096, precision: int = 12) -> None:
    """Sketches of ``value`` and of the distinct ones of ``distinct``, for each day of ``at`` (and group ``by``). Days that the rows
    have are replaced, others stay; nulls are left out, and rows without a time have no day."""
    by = by or []
    day = F.to_date(at).alias("day")
    told = rows.where(F.col(at).isNotNull()).select(day, *by, F.col(value).cast("string").alias("value"), F.col(distinct).cast("string").alias("one"))
    made = told.groupBy("day", *by).agg(F.count("value").alias("n"), F.expr(f"approx_top_k_accumulate(value, {items})").alias("top"), F.hll_sketch_agg("one", precision).alias("ones"))
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)


def days(spark: SparkSession, folder: str, since: str, until: str) -> DataFrame:
    """The days' sketches from ``since`` to before ``until``."""
    return spark.read.parquet(folder).where((F.col("day") >= F.lit(since).cast("date")) & (F.col("day") < F.lit(until).cast("date")))


def most_frequent(sketches: DataFrame, k: int, items: int = 4096) -> DataFrame:
    """(value, n) of the k most frequent values, equal ones by value."""
    merged = sketches.groupBy(F.lit(1)).agg(F.expr(f"approx_top_k_combine(top, {items})").alias("top"), F.sum("n").alias("n")).where("n > 0")
    found = merged.select(F.explode(F.expr(f"approx_top_k_estimate(top, {items})")).alias("x")).select(F.col("x.item").alias("value"), F.col("x.count").alias("n"))
    return found.orderBy(F.desc("n"), "value").limit(k)


def distinct_counts(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by, n): about how many distinct ones each group has."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("ones")).alias("n"))
