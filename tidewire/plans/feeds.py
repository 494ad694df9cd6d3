"""Queries of the payload parsers, search and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import search as S
from tidewire.operators.shared import new_folder, stage
from tidewire.operators.snapshots import Snapshots
from tidewire.plans.enrichment import ORGS, RULES, TAGS
from tidewire.plans.registry import query
from tidewire.plans.relational import every_form, indexed, ranked, text_times
from tidewire.plans.stories import items
from tidewire.sources import payloads as P
from tidewire.sources.views import AS_OF, ctes, view
from tidewire.streaming import jobs as J
from tidewire.streaming.cycle import read_articles, stream_cycles

C = F.col


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, '<>&"\\', "     "), r"\s+", " "))


SQL_PLAIN = "trim(regexp_replace(translate({c}, '<>&\"\\', '     '), '\\s+', ' ', 'g'))"
T, S4 = SQL_PLAIN.format(c="title"), SQL_PLAIN.format(c="summary")


def payloads(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    """Articles written as feeds of their source's kind (or the given one), some dozens to a payload. Numbers in links have five
    digits where a kind is given, as its query's SQL cuts them, else all that the id has, so that every item has a link of its own."""
    kinds = view(spark, d, "sources").select(C("id").alias("source_id"), C("kind"))
    a = view(spark, d, "articles").join(kinds, "source_id").withColumns({"t": plain(C("title")), "s": plain(C("summary")), "k": F.lit(kind) if kind else C("kind")})
    iso, mail = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    n = C("id").cast("string")
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(x, F.lit("")) for x in xs])
    number = F.lpad(n, 5, "0") if kind else F.lpad(n, F.greatest(F.lit(5), F.length(n)), "0")
    rss = lambda *more: cat("<item><title>", C("t"), "</title><link>", C("url"), "</link><pubDate>", mail, "</pubDate>", *more, "</item>")
    entry = lambda href, body: cat("<entry><title>", C("t"), "</title><link rel='alternate' href='", href, "'/><content type='html'>", body, "</content><author><name>/u/", C("author"), "</name></author><published>", iso, "</published></entry>")
    item = (
        F.when(C("k") == "rss", rss("<description>&lt;p&gt;", C("s"), "&lt;/p&gt;</description><dc:creator>", C("author"), "</dc:creator>"))
        .when(C("k") == "google_news", cat("<item><title>", C("t"), " - Pub ", n, "</title><link>", C("url"), "</link><pubDate>", mail, "</pubDate><source url='https://www.pub", n, ".example.com'>Pub ", n, "</source></item>"))
        .when(C("k") == "arxiv", cat("<item><title>", C("t"), "</title><link>https://arxiv.org/abs/2501.", number, "</link><pubDate>", mail, "</pubDate><description>arXiv:2501.", number, " Announce Type: ", F.when(C("id") % 3 == 0, "replace-cross").otherwise("new"), " \nAbstract: ", C("s"), "</description></item>"))
        .when(C("k") == "github_releases", entry(cat("https://github.com/own/proj", (C("id") % 9).cast("string"), "/releases/tag/v1.", n), C("s")))
        .when(C("k") == "reddit", entry(C("url"), cat(C("s"), " submitted by /u/someone [link] [comments]")))
        .when(C("k") == "hf_models", F.to_json(F.struct(cat("own/model-", n, F.when(C("id") % 4 == 0, "-GGUF").otherwise("")).alias("id"), (C("id") * 7).alias("likes"), (C("id") * 1000).alias("downloads"), iso.alias("createdAt"))))
        .when(C("k") == "hf_papers", F.to_json(F.struct(iso.alias("publishedAt"), F.struct(number.alias("id"), C("t").alias("title"), C("s").alias("summary"), (C("id") % 40).alias("upvotes"), F.array(*[F.struct(F.lit(x).alias("name")) for x in "ABCD"]).alias("authors")).alias("paper"))))
        .otherwise(F.to_json(F.struct(n.alias("objectID"), C("t").alias("title"), F.when(C("id") % 2 == 0, "").otherwise(C("url")).alias("url"), (C("id") % 90).alias("points"), iso.alias("created_at"), C("author").alias("author"))))
    )
    whole = a.groupBy("source_id", C("k").alias("kind"), F.expr("id div 400").alias("page")).agg(F.call_function("array_join", F.transform(F.array_sort(F.collect_list(F.struct("id", item.alias("x")))), lambda p: p["x"]), F.when(F.first("k").isin("hf_models", "hf_papers", "hn"), ",").otherwise("")).alias("items"))
    head = F.when(C("kind").isin("rss", "google_news", "arxiv"), "<rss xmlns:dc='d' xmlns:content='c'><channel><title>x</title>").when(C("kind").isin("github_releases", "reddit"), "<feed><title>x</title>").when(C("kind") == "hn", '{"hits":[').otherwise("[")
    tail = F.when(C("kind").isin("rss", "google_news", "arxiv"), "</channel></rss>").when(C("kind").isin("github_releases", "reddit"), "</feed>").when(C("kind") == "hn", "]}").otherwise("]")
    feed = F.concat(F.lit("https://www.reddit.com/r/sub/"), C("page").cast("string"))
    return stage(whole.select("source_id", "kind", feed.alias("feed_url"), F.lit(AS_OF).cast("timestamp").alias("fetched_at"), F.concat(head, "items", tail).alias("body")))


def shown(items: DataFrame, *cols: str) -> DataFrame:
    return text_times(items.select("source_id", "title", "url", "published_at", *cols), "published_at")


BASE = "SELECT source_id, {t} AS title, {u} AS url, CAST(published_at AS VARCHAR) AS published_at{more} FROM articles WHERE {w}"


def sql(t: str = T, u: str = "url", more: str = "", w: str = f"{T} <> ''") -> str:
    return ctes("articles") + BASE.format(t=t, u=u, more=more, w=w)


@query("parse_rss", sql(more=f", {S4} AS content, author"))
def parse_rss(spark: SparkSession, d: str) -> DataFrame:
    return shown(P.parse_rss(payloads(spark, d, "rss")), "content", "author")


@query("parse_google_news", sql(more=", concat('pub', id, '.example.com') AS publisher_domain"))
def parse_google_news(spark: SparkSession, d: str) -> DataFrame:
    return shown(P.parse_google_news(payloads(spark, d, "google_news")), "publisher_domain")


@query("parse_arxiv", sql(u="concat('https://arxiv.org/abs/2501.', lpad(CAST(id AS VARCHAR), 5, '0'))", more=", concat('2501.', lpad(CAST(id AS VARCHAR), 5, '0')) AS arxiv_id", w=f"{T} <> '' AND id % 3 <> 0"))
def parse_arxiv(spark: SparkSession, d: str) -> DataFrame:
    out = P.parse_arxiv(payloads(spark, d, "arxiv")).withColumn("arxiv_id", C("meta")["arxivId"])
    return shown(out, "arxiv_id")


GH = "concat('https://github.com/own/proj', id % 9, '/releases/tag/v1.', id)"


@query("parse_github_releases", sql(t=f"concat('proj', id % 9, ' ', CASE WHEN {T} = '' THEN concat('v1.', id) ELSE {T} END)", u=GH, more=", concat('v1.', id) AS tag", w="true"))
def parse_github_releases(spark: SparkSession, d: str) -> DataFrame:
    return shown(P.parse_github_releases(payloads(spark, d, "github_releases")).withColumn("tag", C("meta")["tag"]), "tag")


@query("parse_reddit", sql(more=f", {S4} AS content, author, 'sub' AS subreddit"))
def parse_reddit(spark: SparkSession, d: str) -> DataFrame:
    return shown(P.parse_reddit(payloads(spark, d, "reddit")).withColumn("subreddit", C("meta")["subreddit"]), "content", "author", "subreddit")


@query("parse_hf_models", sql(t="concat('model-', id, ' released on Hugging Face')", u="concat('https://huggingface.co/own/model-', id)", more=", CAST(id * 7 AS VARCHAR) AS likes", w="id % 4 <> 0"))
def parse_hf_models(spark: SparkSession, d: str) -> DataFrame:
    return shown(P.parse_hf_models(payloads(spark, d, "hf_models")).withColumn("likes", C("meta")["likes"]), "likes")


@query("parse_hf_papers", sql(u="concat('https://huggingface.co/papers/', lpad(CAST(id AS VARCHAR), 5, '0'))", more=f", 'A, B, C' AS author, CAST(id % 40 AS VARCHAR) AS upvotes, {S4} AS content"))
def parse_hf_papers(spark: SparkSession, d: str) -> DataFrame:
    return shown(P.parse_hf_papers(payloads(spark, d, "hf_papers")).withColumn("upvotes", C("meta")["upvotes"]), "author", "upvotes", "content")


@query("parse_hn", sql(u="CASE WHEN id % 2 = 0 THEN concat('https://news.ycombinator.com/item?id=', id) ELSE url END", more=", CAST(id % 90 AS VARCHAR) AS points"))
def parse_hn(spark: SparkSession, d: str) -> DataFrame:
    return shown(P.parse_hn(payloads(spark, d, "hn")).withColumn("points", C("meta")["points"]), "points")


@query("route_payloads", ctes("articles", "sources") + f"SELECT s.kind, count(*) AS n, count(DISTINCT a.id) AS urls FROM articles a JOIN sources s ON s.id = a.source_id WHERE CASE s.kind WHEN 'arxiv' THEN {T} <> '' AND a.id % 3 <> 0 WHEN 'hf_models' THEN a.id % 4 <> 0 WHEN 'github_releases' THEN true ELSE {T} <> '' END GROUP BY 1")
def route_payloads(spark: SparkSession, d: str) -> DataFrame:
    return P.route_payloads(payloads(spark, d)).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("url").alias("urls"))


GIVEN = f"CASE s.kind WHEN 'arxiv' THEN {T} <> '' AND a.id % 3 <> 0 WHEN 'hf_models' THEN a.id % 4 <> 0 WHEN 'github_releases' THEN true ELSE {T} <> '' END"


@query("probe_feed", ctes("articles", "sources") + f"SELECT s.id AS source_id, s.kind, concat('https://www.reddit.com/r/sub/', a.id // 400) AS feed_url, count(*) FILTER ({GIVEN}) AS item_count, CAST(max(a.published_at) FILTER ({GIVEN}) AS VARCHAR) AS newest_at, count(*) FILTER ({GIVEN}) > 0 AS ok FROM articles a JOIN sources s ON s.id = a.source_id GROUP BY 1, 2, 3")
def probe_feed(spark: SparkSession, d: str) -> DataFrame:
    return text_times(P.probe_feed(payloads(spark, d)).drop("sample_title", "fetched_at"), "newest_at")


#: An alternative of words without a phrase, one of a phrase over a stop word, one of a word without another.
QUERY = 'anan with therly -"thanedbl the anea" OR "onbleea of anon" OR thed -rewh'


@query("search_match", ctes("full_articles").rstrip() + indexed("full_articles", "anan", "ther", "thanedbl", "anea", "onbleea", "anon", "thed", "rewh") + """, has AS (SELECT DISTINCT id, token FROM x),
two AS (SELECT DISTINCT a.id, a.token AS first FROM x a JOIN x b ON b.id = a.id AND b.pos = a.pos + 2 WHERE (a.token, b.token) IN (('thanedbl', 'anea'), ('onbleea', 'anon')))
SELECT id FROM full_articles WHERE (id IN (SELECT id FROM has WHERE token = 'anan') AND id IN (SELECT id FROM has WHERE token = 'ther') AND id NOT IN (SELECT id FROM two WHERE first = 'thanedbl'))
OR id IN (SELECT id FROM two WHERE first = 'onbleea') OR (id IN (SELECT id FROM has WHERE token = 'thed') AND id NOT IN (SELECT id FROM has WHERE token = 'rewh'))""")
def search_match(spark: SparkSession, d: str) -> DataFrame:
    return S.search_match(S.index(view(spark, d, "full_articles")), QUERY)


@query("search_rank", ctes("full_articles").rstrip() + indexed("full_articles", "anan", "ther", forms=every_form) + ranked("full_articles", "anan", "ther") + " SELECT id, round(rank, 6) AS score FROM r")
def search_rank(spark: SparkSession, d: str) -> DataFrame:
    return S.search_rank(S.index(view(spark, d, "full_articles")), "with anan therly").select("id", F.round("score", 6).alias("score"))


def chunks(df: DataFrame, order: str, n: int = 4) -> str:
    """The rows as files that a stream reads one after another, in order."""
    folder = new_folder(df.sparkSession, "stream-in")
    df.repartitionByRange(n, order).sortWithinPartitions(order).write.parquet(folder)
    return folder


def stream_items(spark: SparkSession, d: str) -> DataFrame:
    a = view(spark, d, "articles")
    return a.select("id", "title", F.concat(F.lit("https://c.example.com/"), F.expr("id div 2").cast("string")).alias("canonical_url"), C("published_at").cast("timestamp").alias("published_at"))


ONCE = ctes("articles") + "SELECT concat('https://c.example.com/', id // 2) AS canonical_url, 1 AS n FROM articles GROUP BY 1"


def times_written(out: DataFrame) -> DataFrame:
    """How often each URL was written: 1, if the stream did its work."""
    return out.groupBy("canonical_url").agg(F.count("*").alias("n"))


@query("stream_url_dedup", ONCE)
def stream_url_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Both halves of a pair carry one URL; the horizon here is wider than the month, so one of each stays."""
    items = stream_items(spark, d)
    source, out, check = chunks(items, "published_at"), new_folder(spark, "stream-out"), new_folder(spark, "stream-check")
    J.stream_url_dedup(J.read_files(spark, source, items.schema), out, check, "60 days")
    return times_written(spark.read.parquet(out))


@query("stream_ingest", ONCE)
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Whole cycles, one for each file of landed items: both items of a pair carry one URL, with other tracking parameters. The bound for
    vectors is out of reach, so that every URL becomes an article, once."""
    n = C("id").cast("string")
    url = F.concat(F.lit("https://c.example.com/"), F.expr("id div 2").cast("string"), F.lit("?utm_source="), n)
    landed = items(spark, d).withColumns({"url": url, "position": C("id"), "published_at": C("published_at").cast("timestamp"), "error": F.lit(None).cast("string")})
    landed = landed.withColumn("fetched_at", C("published_at") + F.expr("INTERVAL 10 MINUTES"))
    source, store, check = chunks(landed, "published_at", 3), Snapshots(spark, new_folder(spark, "stream-store")), new_folder(spark, "stream-check")
    stream_cycles(J.read_files(spark, source, landed.schema, 1), store, check, vector_threshold=2.0, rules=RULES, tags=TAGS, orgs=ORGS)
    return times_written(read_articles(store))


RUNS = "id long, source_id int, ran_at timestamp, ok boolean, items_new int"


def runs(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "ingest_runs").select("id", "source_id", C("ran_at").cast("timestamp").alias("ran_at"), "ok", "items_new")


def windows(table: str, at: str, unit: str, n: int, late: str, columns: str) -> str:
    """SQL for the windows of n units, one beginning at each, that are complete once the latest row less ``late`` is seen."""
    start = f"date_trunc('{unit}', {at})::TIMESTAMP - INTERVAL 1 {unit} * CAST(k AS INT)"
    grouped = f"SELECT start, {columns} FROM (SELECT *, {start} AS start FROM {table}, (SELECT unnest(range(0, {n})) AS k)) GROUP BY 1"
    done = f"start + INTERVAL {n} {unit} <= (SELECT max({at}) - INTERVAL {late} FROM {table})"
    return f"SELECT * REPLACE (CAST(start AS VARCHAR) AS start) FROM ({grouped}) WHERE {done}"


@query("stream_window_counts", ctes("ingest_runs") + windows("ingest_runs", "ran_at", "day", 7, "1 day", "CAST(sum(items_new) AS BIGINT) AS items_new, count(*) AS runs"))
def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Runs and new items of seven days, one window a day."""
    r = runs(spark, d)
    source, out, check = chunks(r, "ran_at"), new_folder(spark, "stream-out"), new_folder(spark, "stream-check")
    J.stream_window_counts(J.read_files(spark, source, r.schema), out, check, {"items_new": F.sum("items_new"), "runs": F.count("*")})
    return text_times(spark.read.parquet(out), "start")


@query("stream_article_counts", ctes("articles") + windows("articles", "published_at", "hour", 24, "1 hour", "count(*) AS articles, count(*) FILTER (is_rumour) AS rumours"))
def stream_article_counts(spark: SparkSession, d: str) -> DataFrame:
    """Articles and rumours of 24 hours, one window an hour."""
    a = view(spark, d, "articles").select("id", C("published_at").cast("timestamp").alias("published_at"), "is_rumour")
    source, out, check = chunks(a, "published_at"), new_folder(spark, "stream-out"), new_folder(spark, "stream-check")
    counts = {"articles": F.count("*"), "rumours": F.count_if("is_rumour")}
    J.stream_window_counts(J.read_files(spark, source, a.schema), out, check, counts, "published_at", "24 hours", "1 hour", "1 hour")
    return text_times(spark.read.parquet(out), "start")


@query("stream_failure_streak", ctes("ingest_runs") + """, g AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY ran_at, id) AS island FROM ingest_runs)
SELECT source_id, CAST(ran_at AS VARCHAR) AS at FROM (SELECT *, row_number() OVER (PARTITION BY source_id, island ORDER BY ran_at, id) AS n FROM g WHERE NOT ok) WHERE n = 3""")
def stream_failure_streak(spark: SparkSession, d: str) -> DataFrame:
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        r = runs(spark, d)
        source, out, check = chunks(r, "ran_at"), new_folder(spark, "stream-out"), new_folder(spark, "stream-check")
        J.stream_failure_streak(J.read_files(spark, source, r.schema), out, check, 3)
    finally:
        spark.conf.set(store, before) if before else spark.conf.unset(store)
    return text_times(spark.read.parquet(out).select("source_id", "at"), "at")
