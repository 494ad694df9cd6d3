"""Rules as Column expressions, built from rule tables that the caller can replace."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import rule_tables as rt
from tidewire.functions.web import WS, host_of

_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def compiled(pattern: str) -> str:
    """For the JVM: word edges and white space mean what they mean in the tables' notation (ASCII words, all spaces)."""
    out, at, inside = [], 0, False
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two[0] == "\\" and len(two) == 2:
            out.append((_EDGE if not inside else two) if two == "\\b" else (WS[1:-1] if inside else WS) if two == "\\s" else two)
            at += 2
            continue
        inside = True if two[0] == "[" else False if two[0] == "]" else inside
        out.append(two[0])
        at += 1
    return "".join(out)


def needed(pattern: str) -> list[str]:
    """Texts of three characters or more, one of which stands in everything (in lower case) that has the pattern; none if the pattern doesn't tell.

    They are the longest run of plain characters outside of groups, or those of each branch of a group that must be there.
    """
    rest, groups = re.sub(r"\\.|\[(?:\\.|[^\]])*\]", "\n", pattern.removeprefix("(?i)")), []

    def longest(part: str) -> str:
        return max(re.split(r".(?:[?*]|\{[^}]*\})|[^a-z0-9 -]", part.lower(), flags=re.DOTALL), key=len)

    while m := re.search(r"\((\?:)?([^()]*)\)([?*]|\{[^}]*\})?", rest):
        if not m[3] and not m[2].startswith("?") and rest.count("(", 0, m.start()) == 0:
            groups.append([longest(branch) for branch in m[2].split("|")])
        rest = rest[: m.start()] + "\n" + rest[m.end() :]
    if "|" in rest:
        return []
    best = max([[longest(rest)], *groups], key=lambda g: min(map(len, g)))
    return best if min(map(len, best)) >= 3 else []


def has(x: Column, pattern: str) -> Column:
    """x: struct(text, low), low being the text in lower case. The pattern is searched only where a text that it needs is found."""
    found = x["text"].rlike(compiled(pattern))
    gates = [F.contains(x["low"], F.lit(t)) for t in needed(pattern)]
    return reduce(Column.__or__, gates) & found if gates else found


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct of the values, each of which is worked out once however often the body reads it."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def with_low(body: Callable[[Column], Column], text: Column) -> Column:
    return let(body, text=text, low=F.lower(text))


def any_of(text: Column, patterns: list[str]) -> Column:
    return with_low(lambda x: any_in(x, patterns), text)


def any_in(x: Column, patterns: list[str]) -> Column:
    return reduce(Column.__or__, [has(x, p) for p in patterns])


def joined(title: Column, summary: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(summary, F.lit("")))


def is_case_study(title: Column, summary: Column) -> Column:
    return any_of(joined(title, summary), rt.CASE_STUDY_PATTERNS)


def rumour_label(text: Column, patterns: list[tuple[str, str]] = rt.RUMOUR_PATTERNS) -> Column:
    """The first label whose pattern is found, or null."""
    return with_low(lambda x: F.coalesce(*[F.when(has(x, p), label) for label, p in patterns]), text)


def classify(title: Column, summary: Column, is_paper: Column, is_model_release: Column, is_release: Column, rules: list[tuple[str, list[str]]] = rt.CATEGORY_RULES) -> Column:
    told = [("other", rt.CASE_STUDY_PATTERNS), *rules]
    by_rule = with_low(lambda x: F.coalesce(*[F.when(any_in(x, ps), name) for name, ps in told], F.lit("other")), joined(title, summary))
    hint = F.when(is_paper, "research-paper").when(is_model_release, "model-launch").when(is_release, "tool-launch")
    return F.coalesce(hint, by_rule)


def extract_tags(text: Column, extra: Column | None = None, rules: list[tuple[str, list[str]]] = rt.TAG_RULES, most: int = 12) -> Column:
    """Tags by rule in the table's order, then the given keywords, distinct, at most 12."""
    from tidewire.functions.text import normalize_tag

    found = with_low(lambda x: F.array_compact(F.array(*[F.when(any_in(x, ps), tag) for tag, ps in rules])), text)
    if extra is not None:
        found = F.array_union(found, F.array_compact(F.transform(F.coalesce(extra, F.array().cast("array<string>")), normalize_tag)))
    return F.slice(found, 1, most)


@dataclass(frozen=True)
class Org:
    slug: str
    rank: int
    primary: bool
    names: tuple[str, ...]
    domains: tuple[str, ...]


DEFAULT_ORGS = [Org(s, r, p, tuple(n), tuple(d)) for s, _, r, p, n, d in rt.ORGS]


def _quoted(name: str) -> str:
    return "".join("\\" + c if c in ".*+?^${}()|[]\\" else c for c in name)


def host_suffixes(host: Column) -> Column:
    """The host and what stands after each of its dots, the longest first: a suffix test becomes an equality."""
    parts = F.split(host, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def match_orgs(text: Column, url: Column, orgs: list[Org] = DEFAULT_ORGS) -> Column:
    """Slugs by rank: a name stands in the text by itself (hyphens join words), or the host is one of the domains or below."""
    return let(lambda x: _orgs_in(x, sorted(orgs, key=lambda o: o.rank)), text=text, low=F.lower(text), own=F.coalesce(host_suffixes(host_of(url)), F.array().cast("array<string>")))


def _orgs_in(x: Column, orgs: list[Org]) -> Column:
    tests = []
    for o in orgs:
        pattern = "(?i)(?<![A-Za-z0-9_-])(?:" + "|".join(_quoted(n) for n in sorted(o.names, key=len, reverse=True)) + ")(?![A-Za-z0-9_-])"
        name = reduce(Column.__or__, [F.contains(x["low"], F.lower(F.lit(n))) for n in o.names]) & x["text"].rlike(pattern) if o.names else F.lit(False)
        domain = F.arrays_overlap(x["own"], F.array(*map(F.lit, o.domains))) if o.domains else F.lit(False)
        tests.append(F.when(domain | name, o.slug))
    return F.array_compact(F.array(*tests))


def _map(pairs: list[tuple[str, object]]) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs for x in p])


def first_party_org(url: Column, orgs: list[Org] = DEFAULT_ORGS) -> Column:
    """The org of the first domain, in the table's order, that the host is or is below."""
    place = [(d, k) for k, d in enumerate(d for o in orgs for d in o.domains)]
    slugs = [o.slug for o in orgs for _ in o.domains]
    known = _map(place)
    best = F.array_min(F.transform(F.coalesce(host_suffixes(host_of(url)), F.array().cast("array<string>")), lambda s: known[s]))
    return F.get(F.array(*map(F.lit, slugs)), best)


def tier_for_domain(domain: Column, tiers: dict[str, int] = rt.PUBLISHER_TIERS, orgs: list[Org] = DEFAULT_ORGS) -> Column:
    """The listed tier of the host itself, then 5 for any first party, then the tier of the first listed domain that it is below."""
    host = F.regexp_replace(F.lower(domain), r"^www\.", "")
    known = _map(list(tiers.items()))
    place, tier = _map([(d, n) for n, d in enumerate(tiers)]), F.array(*map(F.lit, tiers.values()))
    below = lambda x: F.get(tier, F.array_min(F.transform(x["ends"], lambda s: place[s])))
    domains = F.array(*[F.lit(d) for o in orgs for d in o.domains])
    return let(lambda x: F.coalesce(known[x["host"]], F.when(F.arrays_overlap(x["ends"], domains), 5), below(x)), host=host, ends=host_suffixes(host))


def score_credibility(*, title: Column, summary: Column, url: Column, base: Column, publisher: Column, author: Column, has_date: Column, corroboration: Column, claim: Column | None = None, claim_reason: Column | None = None) -> Column:
    """struct(score, reasons, is_rumour): reasons are (rule, delta, detail) in the order in which they were applied."""
    text = lambda c: c.cast("string")
    nothing = F.lit(None).cast("string")
    claim = nothing if claim is None else claim
    def _reason(rule: str, delta: Column, detail: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), delta.cast("int").alias("delta"), detail.alias("detail"))

    def _scored(y: Column) -> Column:
        zero = F.lit(0)
        first = (
            F.when(y["named"] & y["tier"].isNotNull(), _reason("publisher", zero, F.concat(y["publisher"], F.lit(" rated "), text(y["tier"]), F.lit("/5"))))
            .when(y["named"], _reason("publisher-unknown", zero, F.concat(y["publisher"], F.lit(" not rated — defaulted to 3/5"))))
            .otherwise(_reason("source", zero, F.concat(F.lit("source rated "), text(y["base"]), F.lit("/5"))))
        )
        steps = [
            ("first-party", y["owner"].isNotNull() & (y["start"] < 5), 1, F.concat(F.lit("published on "), y["owner"], F.lit("'s own domain"))),
            ("hedged", y["hedge"].isNotNull(), -1, F.concat(F.lit("unconfirmed phrasing (“"), y["hedge"], F.lit("”)"))),
            ("llm-unconfirmed", (y["claim"] == "unconfirmed") & y["hedge"].isNull(), -1, y["detail"]),
            ("llm-confirmed", (y["claim"] == "confirmed") & y["hedge"].isNotNull(), 1, y["detail"]),
            ("corroborated", y["n"] >= 2, 1, F.concat(text(y["n"]), F.lit(" independent sources carrying this"))),
            ("no-provenance", y["bare"], -1, F.lit("no byline and no publish date")),
        ]
        made = F.array_compact(F.array(first, *[F.when(F.coalesce(test, F.lit(False)), _reason(rule, F.lit(delta), why)) for rule, test, delta, why in steps]))
        return let(_clamped, start=y["start"], reasons=made)

    def _clamped(z: Column) -> Column:
        total = z["start"] + F.aggregate(z["reasons"], F.lit(0), lambda t, r: t + r["delta"])
        return let(_result, reasons=z["reasons"], total=total, clamped=F.greatest(F.lit(1), F.least(F.lit(5), total)))

    def _result(w: Column) -> Column:
        cut = F.when(w["clamped"] != w["total"], F.array(_reason("clamped", w["clamped"] - w["total"], F.concat(F.lit("clamped to "), text(w["clamped"]), F.lit("/5")))))
        none = F.slice(w["reasons"], F.lit(1), F.lit(0))
        return F.struct(w["clamped"].cast("int").alias("score"), F.concat(w["reasons"], F.coalesce(cut, none)).alias("reasons"), (w["clamped"] <= 2).alias("is_rumour"))

    return let(
        lambda x: let(
            lambda y: _scored(y),
            **{k: x[k] for k in ("publisher", "base", "tier", "owner", "hedge", "claim", "detail", "n", "bare")},
            start=F.when(x["named"], F.coalesce(x["tier"], F.lit(3))).otherwise(x["base"]), named=x["named"],
        ),
        publisher=publisher, base=base, named=F.coalesce(publisher != "", F.lit(False)), tier=tier_for_domain(publisher), owner=first_party_org(url),
        hedge=rumour_label(joined(title, summary)), claim=claim, detail=F.coalesce(F.nullif(claim_reason, F.lit("")) if claim_reason is not None else nothing, claim),
        n=F.coalesce(corroboration, F.lit(0)), bare=(F.coalesce(author, F.lit("")) == "") & ~has_date,
    )


def score_impact(*, category: Column, credibility: Column, orgs: Column, corroboration: Column, points: Column, upvotes: Column, case_study: Column, primary: list[str] | None = None) -> Column:
    primary = [o.slug for o in DEFAULT_ORGS if o.primary] if primary is None else primary
    hits = F.size(F.array_intersect(orgs, F.array(*map(F.lit, primary))))
    log = lambda c, by, most: F.when(c > 0, F.least(F.log10(c + 1) * by, F.lit(most).cast("double"))).otherwise(0.0)
    score = _map(list(rt.CATEGORY_WEIGHT.items()))[category] + F.least(hits, F.lit(3)) * 8 + credibility * 4 + F.least(corroboration, F.lit(5)) * 3
    score = score + log(points, 8, 16) + log(upvotes, 10, 20) - F.when(case_study, 25).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(score + 0.5))).cast("int")


def _model_pattern() -> str:
    families, tiers = "|".join(f for f, _, _ in rt.MODEL_FAMILIES), "|".join(rt.MODEL_TIERS)
    sep = f"(?:{WS}|[-_])?"
    return rf"(?i)(?<![A-Za-z0-9_])({families}){sep}(?:({tiers}){sep})?([kv]?\d+(?:\.\d+)?)(?!\d)(?![bB](?![A-Za-z0-9_]))(?:{sep}({tiers}))?"


def extract_models(text: Column) -> Column:
    """array(struct(slug, name, family, org)) of the versioned product names, in order, distinct by slug.

    Years, whole numbers over 10 and parameter counts are no versions.
    """
    pattern = _model_pattern()
    part = lambda m, k: F.nullif(F.regexp_extract(m, pattern, k), F.lit(""))
    labels, orgs = _map([(f, n) for f, _, n in rt.MODEL_FAMILIES]), _map([(f, o) for f, o, _ in rt.MODEL_FAMILIES])

    def made(m: Column) -> Column:
        return let(named, family=F.lower(part(m, 1)), before=part(m, 2), version=F.lower(part(m, 3)), after=part(m, 4))

    def named(x: Column) -> Column:
        family, before, version, after = (x[k] for k in ("family", "before", "version", "after"))
        shown = F.when(version.rlike("^[kv]"), F.concat(F.upper(F.substring(version, 1, 1)), F.substring(version, 2, 99))).otherwise(version)
        cap = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 99))
        slug = F.concat_ws("-", family, version, F.lower(F.coalesce(before, after)))
        return F.struct(slug.alias("slug"), F.concat_ws(" ", labels[family], cap(before), shown, cap(after)).alias("name"), family.alias("family"), orgs[family].alias("org"), version.alias("version"))

    every = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), made)
    version = lambda m: m["version"]
    good = F.filter(every, lambda m: ~version(m).rlike(r"^(19|20)\d{2}$") & ~F.when(version(m).rlike(r"^\d+$"), version(m).cast("double") > 10).otherwise(F.lit(False)))
    first = lambda x: F.filter(x["good"], lambda m, i: F.array_position(x["slugs"], m["slug"]) == i + 1)
    slugs = lambda x: let(first, good=x["good"], slugs=F.transform(x["good"], lambda m: m["slug"]))
    return F.transform(let(slugs, good=good), lambda m: m.dropFields("version"))


def derive_status(first_party: Column, credibility: Column, outlets: Column) -> Column:
    return F.when(first_party, "released").when(credibility >= 4, "confirmed").when((credibility >= 3) | (outlets >= 2), "reported").otherwise("rumoured")


def same_outlet(source_a: Column, publisher_a: Column, source_b: Column, publisher_b: Column) -> Column:
    both, neither = publisher_a.isNotNull() & publisher_b.isNotNull(), publisher_a.isNull() & publisher_b.isNull()
    return F.when(both, publisher_a == publisher_b).when(neither, source_a == source_b).otherwise(F.lit(False))


def normalize_llm_response(raw: Column, categories: list[str], orgs: list[str]) -> Column:
    """raw: JSON text. struct(summary, category, tags, orgs, claim, reason), every part brought into its range."""
    from tidewire.functions.text import normalize_tag

    r = F.from_json(raw, "summary string, category string, tags array<string>, orgs array<string>, claim_status string, status_reason string")
    none = F.array().cast("array<string>")
    tags = F.slice(F.array_distinct(F.array_compact(F.transform(F.coalesce(r["tags"], none), normalize_tag))), 1, 8)
    return F.struct(
        F.coalesce(F.trim(r["summary"]), F.lit("")).alias("summary"), F.when(r["category"].isin(*categories), r["category"]).otherwise("other").alias("category"), tags.alias("tags"),
        F.array_intersect(F.coalesce(r["orgs"], none), F.array(*map(F.lit, orgs))).alias("orgs"),
        F.when(r["claim_status"].isin("confirmed", "unconfirmed"), r["claim_status"]).otherwise("reported").alias("claim"), F.coalesce(F.substring(F.trim(r["status_reason"]), 1, 160), F.lit("")).alias("reason"),
    )
