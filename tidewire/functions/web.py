"""Column functions over URLs, HTML and poll errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track, as patterns over the lower-cased name.
TRACKING = "^(utm_.*|ref|ref_src|source|fbclid|gclid|mc_cid|mc_eid|igshid|s|at_medium|at_campaign|__twitter_impression|guccounter)$"
#: White space of the source language's \\s.
WS = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Classes of poll errors, in order, with patterns over the message.
POLL_ERRORS = [
    ("not-a-feed", "(?i)Unexpected close tag|Non-whitespace before first tag|Invalid character|Unexpected end"),
    ("not-valid", "(?i)Unexpected token|is not valid JSON"),
    ("refused", "HTTP 40[13]"),
    ("moved", "HTTP 404"),
    ("rate-limited", "HTTP 429"),
    ("timeout", "(?i)aborted|timeout|ETIMEDOUT"),
    ("unknown-host", "(?i)ENOTFOUND|EAI_AGAIN|getaddrinfo"),
]
#: Kinds of feed by parts of their URL, in order.
FEED_KINDS = [
    ("google_news", "news\\.google\\.com/rss"), ("github_releases", "/releases\\.atom"), ("arxiv", "arxiv\\.org/rss|export\\.arxiv\\.org"), ("hf_papers", "huggingface\\.co/api/daily_papers"),
    ("hf_models", "huggingface\\.co/api/models"), ("hn", "hn\\.algolia\\.com"), ("reddit", "reddit\\.com/r/"),
]


def first_match(text: Column, table: list[tuple[str, str]], default: str | None) -> Column:
    out = F.lit(default)
    for name, pattern in reversed(table):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def poll_error_class(error: Column) -> Column:
    return first_match(error, POLL_ERRORS, "other")


def detect_kind(url: Column) -> Column:
    return first_match(F.lower(url), FEED_KINDS, "rss")


def host_of(url: Column) -> Column:
    """Lower-case host without www; null if the URL can't be read."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def canonicalize_url(url: Column) -> Column:
    """https, no fragment, no www, no tracking parameters, parameters sorted by name, no /amp, no trailing slash.

    What can't be read as a URL with a host is returned trimmed. Percent-encoding is left as it is.
    """
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    port = F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("")), r":(\d+)$", 1)
    port = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"(?i)/amp/?$", "/"), r"(?i)\.amp$", ""), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).rlike(TRACKING))
    ordered = F.transform(F.array_sort(F.transform(parts, lambda p, i: F.struct(F.split(p, "=")[0].alias("k"), i.alias("i"), p.alias("p")))), lambda x: x["p"])
    query = F.array_join(ordered, "&")
    whole = F.concat(F.lit("https://"), host, port, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(host.isNull() | (host == ""), F.trim(url)).otherwise(whole)


#: Named references that are resolved, in this order.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")]


def strip_html(html: Column) -> Column:
    """Script and style bodies and tags become spaces, references are resolved, white space is one space, trimmed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))

    def resolve(text: Column, pattern: str, code: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        return F.aggregate(found, text, lambda acc, x: F.replace(acc, x, code_point(code(x))))

    def code_point(n: Column) -> Column:
        char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.when(n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF), char).otherwise(F.lit(""))

    out = resolve(out, "&#[xX][0-9a-fA-F]{1,6};", lambda x: F.conv(F.regexp_extract(x, "[xX]([0-9a-fA-F]+)", 1), 16, 10).cast("long"))
    out = resolve(out, "&#[0-9]{1,7};", lambda x: F.regexp_extract(x, "([0-9]+)", 1).cast("long"))
    return F.trim(F.regexp_replace(out, WS + "+", " "))


def repo_from_url(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"github\.com/([^/]+/[^/]+)/releases/tag/", 1), F.lit(""))


def tag_from_url(url: Column) -> Column:
    tag = F.nullif(F.regexp_extract(url, r"/releases/tag/(.+)$", 1), F.lit(""))
    return F.coalesce(F.try_url_decode(F.replace(tag, F.lit("+"), F.lit("%2B"))), tag)


def project_name(repo: Column) -> Column:
    return F.coalesce(F.get(F.split(repo, "/"), F.lit(1)), repo)


def parse_tag(tag: Column) -> Column:
    """struct(version, channel, is_prerelease, is_build)."""
    version = F.regexp_replace(F.regexp_replace(tag, r"(?i)^[a-z][\w.]*-(?=v?\d)", ""), "(?i)^v", "")
    build = version.rlike("(?i)^[a-z][0-9]+$")
    channel = F.when(~build, F.lower(F.nullif(F.regexp_extract(version, "(?i)(alpha|beta|rc|dev|nightly|preview|pre)", 1), F.lit(""))))
    return F.struct(version.alias("version"), channel.alias("channel"), channel.isNotNull().alias("is_prerelease"), build.alias("is_build"))


def cadence_label(per_week: Column) -> Column:
    #: Labels of releases a week, from the highest.
    steps = [(14, "multiple daily"), (5, "~daily"), (1.5, "few per week"), (0.5, "~weekly")]
    out = F.lit("occasional")
    for least, name in reversed(steps):
        out = F.when(per_week >= least, name).otherwise(out)
    return F.when(per_week <= 0, "—").otherwise(out)
