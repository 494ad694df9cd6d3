"""Landed feed payloads to items. Each kind has a parser over ``raw_payloads(source_id, kind, feed_url, fetched_at, body)``; XML
and JSON are read by Spark's own functions with fixed schemas. A missing date is the time of fetching, so a second run gives
the same rows; an item without title or link, or with a date that can't be read, is dropped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import text as X
from tidewire.functions import web as W
from tidewire.operators.shared import stage

BODY = 4000
RSS = """channel struct<item: array<struct<title: string, link: string, `content:encoded`: string, description: string, pubDate: string, `dc:creator`: string, author: string, `arxiv:announce_type`: string, source: struct<_VALUE: string, _url: string>>>>,
entry array<struct<title: string, link: array<struct<_href: string, _rel: string>>, content: struct<_VALUE: string, _type: string>, summary: string, published: string, updated: string, author: struct<name: string>>>"""
HITS = "hits array<struct<objectID: string, title: string, url: string, points: bigint, num_comments: bigint, created_at: string, author: string, story_text: string>>"
MODELS = "array<struct<id: string, likes: bigint, downloads: bigint, createdAt: string, lastModified: string>>"
PAPERS = "array<struct<title: string, publishedAt: string, submittedOnDailyAt: string, paper: struct<id: string, title: string, summary: string, upvotes: bigint, publishedAt: string, authors: array<struct<name: string>>, ai_keywords: array<string>>>>"
KEEP = ["source_id", "kind", "feed_url", "fetched_at"]
ITEM = ["source_id", "kind", "position", "title", "url", "content", "author", "published_at", "publisher_domain", "meta"]


def when_given(text: Column, fallback: Column) -> Column:
    """A date in ISO or mail notation; the fallback if there is none, null if it can't be read."""
    clean = F.nullif(F.trim(text), F.lit(""))
    mail = F.regexp_replace(F.regexp_replace(clean, "^[A-Za-z]{3}, *", ""), "(GMT|UTC|UT|Z)$", "+0000")
    read = F.coalesce(clean.try_cast("timestamp"), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")))
    return F.when(clean.isNull(), fallback).otherwise(read)


def meta(**values: Column) -> Column:
    return F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())


def shaped(rows: DataFrame, *, title: Column, url: Column, content: Column, author: Column, date: Column, publisher: Column | None = None, extra: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    out = rows.select(
        "source_id", "kind", "position", F.nullif(F.trim(title), F.lit("")).alias("title"), F.nullif(F.trim(url), F.lit("")).alias("url"), F.substring(content, 1, BODY).alias("content"), F.nullif(F.trim(author), F.lit("")).alias("author"),
        when_given(date, F.col("fetched_at")).alias("published_at"), (none if publisher is None else publisher).alias("publisher_domain"), (F.create_map().cast("map<string,string>") if extra is None else extra).alias("meta"),
    )
    return out.where("title IS NOT NULL AND url IS NOT NULL AND published_at IS NOT NULL")


def _rss(payloads: DataFrame) -> DataFrame:
    return payloads.withColumn("x", F.from_xml("body", RSS)).select(*KEEP, F.posexplode("x.channel.item").alias("position", "i"))


def _atom(payloads: DataFrame) -> DataFrame:
    rows = payloads.withColumn("x", F.from_xml("body", RSS)).select(*KEEP, F.posexplode("x.entry").alias("position", "i"))
    plain = F.filter("i.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    return rows.withColumn("href", F.get(plain, F.lit(0))["_href"])


def _strip(*options: Column) -> Column:
    return W.strip_html(F.coalesce(*[F.nullif(F.trim(o), F.lit("")) for o in options]))


I = lambda n: F.col("i")[n]  # noqa: E731, E741


def parse_rss(payloads: DataFrame) -> DataFrame:
    r = _rss(payloads)
    out = shaped(r, title=I("title"), url=I("link"), content=_strip(I("content:encoded"), I("description")), author=F.coalesce(I("dc:creator"), I("author")), date=I("pubDate"))
    a = _atom(payloads)
    more = shaped(a, title=I("title"), url=F.col("href"), content=_strip(F.col("i.content._VALUE"), I("summary")), author=F.col("i.author.name"), date=F.coalesce(I("published"), I("updated")))
    return out.unionByName(more)


def parse_google_news(payloads: DataFrame) -> DataFrame:
    r = _rss(payloads)
    name = F.trim(F.col("i.source._VALUE"))
    return shaped(r, title=X.strip_publisher_suffix(I("title"), name), url=I("link"), content=_strip(I("description")), author=name, date=I("pubDate"), publisher=W.host_of(F.col("i.source._url")))


def parse_arxiv(payloads: DataFrame) -> DataFrame:
    r = _rss(payloads).withColumn("announce", F.coalesce(I("arxiv:announce_type"), X.announce_type(I("description"))))
    r = r.where(~F.coalesce(F.col("announce").rlike("(?i)replace"), F.lit(False)))
    return shaped(r, title=I("title"), url=I("link"), content=X.clean_abstract(I("description")), author=I("dc:creator"), date=I("pubDate"), extra=meta(isPaper=F.lit("true"), arxivId=X.arxiv_id(I("link"))))


def parse_github_releases(payloads: DataFrame) -> DataFrame:
    a = _atom(payloads)
    repo, tag = W.repo_from_url(F.col("href")), W.tag_from_url(F.col("href"))
    title = F.concat(W.project_name(repo), F.lit(" "), F.coalesce(F.nullif(F.trim(I("title")), F.lit("")), tag))
    return shaped(a.where(repo.isNotNull()), title=title, url=F.col("href"), content=_strip(F.col("i.content._VALUE"), I("summary")), author=F.col("i.author.name"), date=F.coalesce(I("updated"), I("published")), extra=meta(isRelease=F.lit("true"), repo=repo, tag=tag))


def parse_reddit(payloads: DataFrame) -> DataFrame:
    a = _atom(payloads)
    return shaped(a, title=I("title"), url=F.col("href"), content=X.clean_reddit_body(_strip(F.col("i.content._VALUE"))), author=F.regexp_replace(F.col("i.author.name"), "^/u/", ""), date=F.coalesce(I("published"), I("updated")), extra=meta(subreddit=X.subreddit_from(F.col("feed_url"))))


def parse_hf_models(payloads: DataFrame) -> DataFrame:
    r = payloads.select(*KEEP, F.posexplode(F.from_json("body", MODELS)).alias("position", "i")).where(I("id").isNotNull() & ~X.is_derivative_variant(I("id")))
    likes, downloads = F.coalesce(I("likes"), F.lit(0)), F.coalesce(I("downloads"), F.lit(0))
    content = F.concat(F.lit("New model "), I("id"), F.lit(": "), F.format_number(downloads, 0), F.lit(" downloads, "), F.format_number(likes, 0), F.lit(" likes"))
    return shaped(r, title=F.concat(F.element_at(F.split(I("id"), "/"), -1), F.lit(" released on Hugging Face")), url=F.concat(F.lit("https://huggingface.co/"), I("id")), content=content, author=F.get(F.split(I("id"), "/"), F.lit(0)), date=F.coalesce(I("createdAt"), I("lastModified")), extra=meta(isModelRelease=F.lit("true"), likes=likes, downloads=downloads))


def parse_hf_papers(payloads: DataFrame) -> DataFrame:
    r = payloads.select(*KEEP, F.posexplode(F.from_json("body", PAPERS)).alias("position", "i"))
    p = lambda n: F.col(f"i.paper.{n}")
    names = F.array_join(F.slice(F.filter(F.transform(F.coalesce(p("authors"), F.array().cast("array<struct<name:string>>")), lambda a: a["name"]), lambda n: n.isNotNull()), 1, 3), ", ")
    return shaped(r, title=F.coalesce(p("title"), I("title")), url=F.concat(F.lit("https://huggingface.co/papers/"), p("id")), content=F.trim(p("summary")), author=names, date=F.coalesce(I("submittedOnDailyAt"), I("publishedAt"), p("publishedAt")), extra=meta(isPaper=F.lit("true"), upvotes=F.coalesce(p("upvotes"), F.lit(0)), keywords=F.array_join(p("ai_keywords"), ",")))


def parse_hn(payloads: DataFrame) -> DataFrame:
    """Several queries' hits; the first hit of an objectID (by query, then position) stays."""
    r = payloads.withColumn("x", F.from_json("body", HITS)).select(*KEEP, F.posexplode("x.hits").alias("position", "i"))
    first = F.row_number().over(Window.partitionBy("source_id", F.col("i.objectID")).orderBy("feed_url", "position"))
    r = r.withColumn("_row", first).where("_row = 1")
    page = F.concat(F.lit("https://news.ycombinator.com/item?id="), I("objectID"))
    return shaped(r, title=I("title"), url=F.coalesce(F.nullif(I("url"), F.lit("")), page), content=W.strip_html(I("story_text")), author=I("author"), date=I("created_at"), extra=meta(points=I("points"), comments=I("num_comments")))


PARSERS = {"rss": parse_rss, "google_news": parse_google_news, "arxiv": parse_arxiv, "github_releases": parse_github_releases, "reddit": parse_reddit, "hf_models": parse_hf_models, "hf_papers": parse_hf_papers, "hn": parse_hn}


def route_payloads(payloads: DataFrame) -> DataFrame:
    """Every payload through the parser of its kind, one table of items."""
    return reduce(DataFrame.unionByName, [parse(payloads.where(F.col("kind") == kind)).select(ITEM) for kind, parse in PARSERS.items()])


def probe_feed(payloads: DataFrame) -> DataFrame:
    """For each payload: how many items it gives, the first title, the newest date; no items is not ok. Every payload is parsed as
    a source of its own, so one that gives nothing is seen beside full ones of its source."""
    numbered = stage(payloads.withColumn("payload", F.monotonically_increasing_id()))
    own = numbered.drop("source_id").withColumnRenamed("payload", "source_id")
    items = route_payloads(own).groupBy(F.col("source_id").alias("payload")).agg(F.count("*").alias("item_count"), F.min_by("title", "position").alias("sample_title"), F.max("published_at").alias("newest_at"))
    out = numbered.join(items, "payload", "left")
    return out.select("source_id", "feed_url", "fetched_at", "kind", F.coalesce("item_count", F.lit(0)).cast("long").alias("item_count"), "sample_title", "newest_at", F.col("item_count").isNotNull().alias("ok"))
