"""Release cadence of projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.web import repo_from_url, tag_from_url


def release_rows(articles: DataFrame) -> DataFrame:
    out = articles.select("id", "url", F.col("published_at").cast("timestamp").alias("published_at"), repo_from_url(F.col("url")).alias("repo"), tag_from_url(F.col("url")).alias("tag"))
    return out.where("repo IS NOT NULL")


def releases(articles: DataFrame, as_of: str) -> DataFrame:
    """One row for each project: count, releases a week (0 under two releases or a span under 0.05 weeks), the last 7 days, the latest."""
    weeks = (F.unix_timestamp(F.max("published_at")) - F.unix_timestamp(F.min("published_at"))) / 604800.0
    recent = F.count_if(F.col("published_at") >= F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 7 DAYS"))
    out = release_rows(articles).groupBy("repo").agg(F.count("*").alias("n_releases"), weeks.alias("weeks"), recent.alias("last_7d"), F.max_by("tag", F.struct("published_at", "id")).alias("latest_tag"), F.max("published_at").alias("latest_at"))
    rate = F.when((F.col("n_releases") < 2) | (F.col("weeks") < 0.05), 0.0).otherwise(F.col("n_releases") / F.greatest("weeks", F.lit(0.05)))
    return out.withColumn("per_week", rate).drop("weeks")


def release_history(articles: DataFrame, shown: int = 8) -> DataFrame:
    """The latest releases of each project, newest first; Spark keeps only so many of each in the first step."""
    place = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("published_at"), F.desc("id")))
    return release_rows(articles).withColumn("place", place).where(F.col("place") <= shown)
