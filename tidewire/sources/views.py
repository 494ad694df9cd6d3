"""Article-shaped views over the star-schema tables; the SQL runs unchanged in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"

VIEWS: dict[str, tuple[str, str]] = {
    "sources": ("documents", """SELECT DISTINCT CAST(substr(source, 4) AS INT) AS id, source AS slug, concat('Source ', substr(source, 4)) AS name,
  CASE CAST(substr(source, 4) AS INT) % 8 WHEN 0 THEN 'rss' WHEN 1 THEN 'github_releases' WHEN 2 THEN 'google_news' WHEN 3 THEN 'arxiv'
    WHEN 4 THEN 'hf_papers' WHEN 5 THEN 'hf_models' WHEN 6 THEN 'hn' ELSE 'reddit' END AS kind,
  CASE CAST(substr(source, 4) AS INT) % 4 WHEN 0 THEN 'first_party' WHEN 1 THEN 'press' WHEN 2 THEN 'community' ELSE 'leaks' END AS category,
  1 + CAST(substr(source, 4) AS INT) % 5 AS base_credibility,
  CASE WHEN CAST(substr(source, 4) AS INT) % 3 = 0 THEN concat('org', CAST(CAST(substr(source, 4) AS INT) % 7 AS VARCHAR(9))) END AS org_slug,
  CAST(substr(source, 4) AS INT) % 7 <> 6 AS enabled,
  CASE WHEN CAST(substr(source, 4) AS INT) % 10 = 9 THEN TIMESTAMP '2024-01-15 00:00:00' END AS muted_at,
  30 * (1 + CAST(substr(source, 4) AS INT) % 3) AS poll_minutes,
  CASE WHEN CAST(substr(source, 4) AS INT) % 5 <> 4 THEN TIMESTAMP '2024-01-30 23:10:00' END AS last_polled_at,
  CASE WHEN CAST(substr(source, 4) AS INT) % 6 = 0 THEN '{"managedBy":"user"}' ELSE '{}' END AS meta
FROM documents"""),
    "articles": ("documents", """SELECT doc_id AS id, CAST(substr(source, 4) AS INT) AS source_id,
  concat('https://', source, '.example.com/', lang, '/', CAST(doc_id AS VARCHAR(20))) AS url,
  substr(split_part(text, chr(10), 1), 1, 90) AS title, substr(text, 1, 400) AS summary,
  CASE WHEN doc_id % 3 <> 0 THEN concat('author', CAST(doc_id % 17 AS VARCHAR(9))) END AS author,
  CASE WHEN doc_id % 2 = 1 THEN concat('pub', CAST(doc_id % 23 AS VARCHAR(9)), '.example.com') END AS publisher_domain,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * CAST((doc_id * 7919) % 43200 AS INT) AS published_at,
  TIMESTAMP '2024-01-01 00:10:00' + INTERVAL '1' MINUTE * CAST((doc_id * 7919) % 43200 AS INT) AS ingested_at,
  CASE doc_id % 5 WHEN 0 THEN 'model-launch' WHEN 1 THEN 'model-leak' WHEN 2 THEN 'deal' WHEN 3 THEN 'policy' ELSE 'other' END AS category,
  CAST(1 + doc_id % 5 AS INT) AS credibility, CAST(n_chars % 101 AS INT) AS impact, 1 + doc_id % 5 <= 2 AS is_rumour,
  CAST(doc_id % 4 AS INT) AS corroboration_count,
  CASE WHEN doc_id % 4 = 0 THEN concat('s', CAST(doc_id % 50 AS VARCHAR(9))) END AS story_id,
  CASE WHEN doc_id % 6 = 0 THEN 'llm' ELSE 'heuristic' END AS enriched_by, lang
FROM documents"""),
    "labels_of_articles": ("documents", """SELECT doc_id AS article_id, concat('org', CAST(doc_id % 7 AS VARCHAR(9))) AS org_slug, concat('tag', CAST(doc_id % 37 AS VARCHAR(9))) AS tag FROM documents
UNION ALL
SELECT doc_id, concat('org', CAST((doc_id + 3) % 7 AS VARCHAR(9))), concat('tag', CAST((doc_id * 5 + 1) % 37 AS VARCHAR(9))) FROM documents WHERE doc_id % 3 = 0"""),
    "ingest_runs": ("events", """SELECT event_id AS id, CAST(user_id % 20 AS INT) AS source_id, ts AS ran_at, event_type <> 'error' AS ok,
  CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS INT) ELSE 0 END AS items_new,
  CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'HTTP 403 for x' WHEN 1 THEN 'HTTP 404 for x' WHEN 2 THEN 'HTTP 429 for x' ELSE 'getaddrinfo ENOTFOUND x' END END AS error
FROM events"""),
    "article_reads": ("events", """SELECT user_id, CAST(replace(replace(props, '{"k": ', ''), '}', '') AS BIGINT) AS article_id, min(ts) AS read_at
FROM events WHERE event_type = 'view' GROUP BY 1, 2"""),
    "saved_articles": ("events", """SELECT user_id, CAST(replace(replace(props, '{"k": ', ''), '}', '') AS BIGINT) AS article_id, max(ts) AS saved_at
FROM events WHERE event_type = 'purchase' GROUP BY 1, 2"""),
    "reader_state": ("events", "SELECT user_id, max(ts) AS last_seen_at FROM events WHERE event_type = 'click' AND user_id % 5 <> 0 GROUP BY 1"),
    "release_articles": ("orders", """SELECT o_orderkey AS id,
  concat('https://github.com/owner', CAST(o_custkey % 12 AS VARCHAR(9)), '/proj', CAST(o_custkey % 12 AS VARCHAR(9)), '/releases/tag/',
    CASE o_orderkey % 4 WHEN 0 THEN concat('v1.', CAST(o_orderkey % 50 AS VARCHAR(9)), '.0')
      WHEN 1 THEN concat('rust-v0.', CAST(o_orderkey % 50 AS VARCHAR(9)), '.0-alpha.1')
      WHEN 2 THEN concat('b', CAST(o_orderkey AS VARCHAR(20))) ELSE concat('v0.', CAST(o_orderkey % 50 AS VARCHAR(9)), '.2rc0') END) AS url,
  o_orderdate AS published_at
FROM orders"""),
    "article_duplicates": ("documents", """SELECT doc_id AS id, doc_id - 1 AS article_id, CAST(substr(source, 4) AS INT) AS source_id,
  concat('https://dup.example.net/', CAST(doc_id AS VARCHAR(20))) AS url,
  CASE WHEN doc_id % 2 = 1 THEN concat('pub', CAST(doc_id % 23 AS VARCHAR(9)), '.example.com') END AS publisher_domain
FROM documents WHERE doc_id % 9 = 1"""),
}

#: Articles with their whole text as the summary.
VIEWS["full_articles"] = ("documents", VIEWS["articles"][1].replace("substr(text, 1, 400) AS summary", "text AS summary"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, sql = VIEWS[name]
    spark.read.parquet(f"{sf_dir}/{base}.parquet").createOrReplaceTempView(f"raw_{base}")
    return spark.sql(sql.replace(f"FROM {base}", f"FROM raw_{base}"))


def ctes(*names: str) -> str:
    """The views as a WITH clause for the SQL side."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in names) + " "
