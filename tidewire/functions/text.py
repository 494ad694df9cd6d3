"""Column functions over titles, summaries and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.rule_tables import CREDIBILITY_LABELS, DERIVATIVES, STOPWORDS
from tidewire.functions.web import WS, strip_html


def title_tokens(title: Column) -> Column:
    """Distinct words of over two characters that are no stop words, in order."""
    low = F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}\s-]", " ")
    words = F.transform(F.split(low, WS + "+"), lambda w: F.regexp_replace(w, "^-+|-+$", ""))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct words; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def title_similarity(a: Column, b: Column) -> Column:
    return jaccard(title_tokens(a), title_tokens(b))


def useful_summary(title: Column, content: Column) -> Column:
    """The trimmed content; null if it only says the title again, with less than 40 characters more."""
    summary = F.regexp_replace(content, f"^{WS}+|{WS}+$", "")
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    t, s = plain(F.coalesce(title, F.lit(""))), plain(summary)
    again = (s == t) | (s.startswith(t) & (F.length(s) - F.length(t) < 40))
    return F.when(summary.isNull() | (summary == "") | again, F.lit(None)).otherwise(summary)


def normalize_tag(raw: Column) -> Column:
    tag = F.regexp_replace(F.regexp_replace(F.lower(raw), f"^{WS}+|{WS}+$", ""), r"[^\p{L}\p{N}\s-]", "")
    tag = F.regexp_replace(F.regexp_replace(tag, WS + "+", "-"), "^-+|-+$", "")
    return F.when(F.length(tag).between(2, 28) & (F.size(F.split(tag, "-")) <= 3), tag)


def strip_publisher_suffix(title: Column, publisher: Column) -> Column:
    suffix = F.concat(F.lit(" - "), publisher)
    exact = (publisher != "") & F.endswith(title, suffix)
    loose = F.trim(F.regexp_replace(title, r"\s+-\s+[^-]{2,40}$", ""))
    return F.when(exact, F.trim(F.substring(title, F.lit(1), F.length(title) - F.length(suffix)))).when(loose == "", title).otherwise(loose)


def clean_abstract(text: Column) -> Column:
    out = F.regexp_replace(strip_html(text), r"(?i)^arXiv:\S+\s*", "")
    out = F.regexp_replace(out, r"(?i)^(.*?)Announce Type:\s*[\w-]+\s*", "$1")
    return F.trim(F.regexp_replace(out, r"(?i)^Abstract:\s*", ""))


def arxiv_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?i)arxiv\.org/abs/([\d.]+(?:v\d+)?)", 1), F.lit(""))


def announce_type(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?i)Announce Type:\s*([\w-]+)", 1), F.lit(""))


def clean_reddit_body(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?i)submitted by\s*/u/[\w-]+", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)\[(link|comments)\]", ""), r"(?m)^\s*https?://\S+\s*$", "")
    return F.trim(F.regexp_replace(out, WS + "+", " "))


def subreddit_from(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, "/r/([^/]+)", 1), F.lit(""))


def is_derivative_variant(model_id: Column) -> Column:
    return F.element_at(F.split(model_id, "/"), -1).rlike(f"(?i)-({'|'.join(DERIVATIVES)})$")


def embedding_text(title: Column, summary: Column) -> Column:
    return F.trim(F.substring(F.concat(title, F.lit("\n\n"), F.coalesce(summary, F.lit(""))), 1, 1200))


def credibility_label(score: Column) -> Column:
    out = F.lit("Unrated")
    for n, label in CREDIBILITY_LABELS.items():
        out = F.when(score == n, label).otherwise(out)
    return out


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 for unequal lengths, empty vectors or a norm of zero."""
    double = lambda v: F.transform(v, lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(double(x), double(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0)
    return F.when(usable, dot(a, b) / F.when(usable, norm).otherwise(1.0)).otherwise(F.lit(0.0))
