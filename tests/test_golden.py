"""Golden rows of the text, URL and rule functions with their default tables."""

import pytest
from pyspark.sql import functions as F

from tidewire.functions import rules as R
from tidewire.functions import text as X
from tidewire.functions import web as W
from tidewire.operators.feed import FeedFilters

L = F.lit


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


@pytest.mark.parametrize("url, want", [
    ("https://www.Example.com/a/?utm_source=x&b=2&a=1#top", "https://example.com/a?a=1&b=2"),
    ("http://example.com", "https://example.com/"),
    ("https://example.com/story/amp/", "https://example.com/story"),
    ("https://example.com/story.amp?ref=hn", "https://example.com/story"),
    ("https://example.com/a?s=1&id=3&fbclid=q", "https://example.com/a?id=3"),
    ("  not a url ", "not a url"),
])
def test_canonical_url(spark, url, want):
    assert one(spark, W.canonicalize_url(L(url))) == want


@pytest.mark.parametrize("html, want", [
    ("<p>Hello&nbsp;<b>world</b></p>", "Hello world"),
    ("a<script>var x='<p>';</script>b<style>p{}</style>c", "a b c"),
    ("caf&#233; &#x1F600; &amp;lt;", "café \U0001f600 <"),
    ("", ""),
])
def test_strip_html(spark, html, want):
    assert one(spark, W.strip_html(L(html))) == want


@pytest.mark.parametrize("title, summary, want", [
    ("OpenAI introduces GPT-5 today", None, "model-launch"),
    ("Leaked benchmark hints at unreleased Gemini model", None, "model-leak"),
    ("Startup raises $40 million in series B", None, "deal"),
    ("We propose a new method for pruning", None, "research-paper"),
    ("Regulators open antitrust lawsuit", None, "policy"),
    ("How Acme uses ChatGPT", None, "other"),
    ("A quiet day", None, "other"),
])
def test_classify(spark, title, summary, want):
    no = L(False)
    assert one(spark, R.classify(L(title), L(summary).cast("string"), no, no, no)) == want


def test_hints_win(spark):
    assert one(spark, R.classify(L("x"), L("y"), L(True), L(True), L(True))) == "research-paper"


def test_word_edges_are_ascii(spark):
    assert one(spark, R.rumour_label(L("éleaked"))) == "leaked"
    assert one(spark, R.rumour_label(L("bleaked"))) is None


@pytest.mark.parametrize("text, slugs", [
    ("GPT-5 and Claude Opus 4.5, claude opus 4.5 again", ["gpt-5", "claude-4.5-opus"]),
    ("Gemini 2.5 Pro beats Qwen 30b and Llama 70B", ["gemini-2.5-pro"]),
    ("Kimi K2 Thinking", ["kimi-k2-thinking"]),
    ("GPT 2024 roadmap, GLM 47", []),
    ("DeepSeek-V3.1", ["deepseek-v3.1"]),
])
def test_models(spark, text, slugs):
    assert [m["slug"] for m in one(spark, R.extract_models(L(text)))] == slugs


def test_orgs(spark):
    assert one(spark, R.match_orgs(L("Claude Code and chatgpt; non-Gemini"), L("https://blogs.nvidia.com/x"))) == ["openai", "anthropic", "nvidia"]
    assert one(spark, R.first_party_org(L("https://www.openai.com/x"))) == "openai"
    assert one(spark, R.first_party_org(L("https://notopenai.com/x"))) is None


@pytest.mark.parametrize("domain, tier", [("www.Reuters.com", 5), ("blog.openai.com", 5), ("uk.finance.yahoo.com", 2), ("nobody.example", None)])
def test_tiers(spark, domain, tier):
    assert one(spark, R.tier_for_domain(L(domain))) == tier


def test_credibility(spark):
    args = dict(title=L("Leaked: GPT-9"), summary=L(None).cast("string"), url=L("https://x.example"), base=L(2), publisher=L(None).cast("string"), author=L("a"), has_date=L(True), corroboration=L(0))
    s = one(spark, R.score_credibility(**args))
    assert (s["score"], s["is_rumour"], [r["rule"] for r in s["reasons"]]) == (1, True, ["source", "hedged"])
    s = one(spark, R.score_credibility(**{**args, "title": L("x"), "url": L("https://openai.com/x"), "base": L(4), "corroboration": L(3)}))
    assert (s["score"], [r["rule"] for r in s["reasons"]]) == (5, ["source", "first-party", "corroborated", "clamped"])
    s = one(spark, R.score_credibility(**{**args, "claim": L("confirmed"), "claim_reason": L("said so")}))
    assert [(r["rule"], r["detail"]) for r in s["reasons"]][-1] == ("llm-confirmed", "said so")


def test_small_functions(spark):
    assert one(spark, X.title_tokens(L("The new GPT-5 is -here- now, éclair"))) == ["gpt-5", "here", "éclair"]
    assert one(spark, X.title_similarity(L(""), L("x"))) == 0.0
    assert one(spark, X.useful_summary(L("A title"), L(" a TITLE! "))) is None
    assert one(spark, X.normalize_tag(L(" Open  Source! "))) == "open-source"
    assert one(spark, X.normalize_tag(L("a b c d"))) is None
    assert one(spark, X.strip_publisher_suffix(L("Title - The Verge"), L("The Verge"))) == "Title"
    assert one(spark, X.clean_abstract(L("arXiv:2501.1v1 Announce Type: new \nAbstract: We do."))) == "We do."
    assert one(spark, X.clean_reddit_body(L("hi submitted by /u/a-b [link] [comments]"))) == "hi"
    assert one(spark, X.is_derivative_variant(L("org/Model-GGUF"))) and not one(spark, X.is_derivative_variant(L("org-gguf/Model")))
    assert one(spark, W.parse_tag(L("rust-v0.5.0-alpha.1"))).asDict() == {"version": "0.5.0-alpha.1", "channel": "alpha", "is_prerelease": True, "is_build": False}
    assert one(spark, W.parse_tag(L("b1234")))["is_build"]
    assert one(spark, W.tag_from_url(L("https://github.com/a/b/releases/tag/v1%2B2"))) == "v1+2"
    assert one(spark, W.poll_error_class(L("HTTP 403 for x"))) == "refused"
    assert one(spark, X.cosine_similarity(F.array(L(1.0), L(0.0)), F.array(L(0.0)))) == 0.0


def test_filters():
    f = FeedFilters.from_params({"category": ["deal,nope", "deal"], "cred": "9", "page": "-1", "sort": "odd", "from": "bad", "to": "2024-01-02"})
    assert (f.categories, f.cred, f.page, f.sort, f.since, f.until) == (("deal",), 1, 1, "newest", None, "2024-01-02 00:00:00")
    assert f.active() and not FeedFilters.from_params({"page": "3"}).active()
