"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Each element of a page is a node with a hidden label, content or not. Its unary potential is log-linear in features of the
element (kind of tag, words in its class and id, how much text it has and how much of that is in links, sentences, depth, what
stands above it); a pairwise potential couples each node with its parent, by kind of tag. Sum-product messages go up and then
down the tree, level by level for a whole batch of pages at once, and give each node's exact content marginal. A block of text
is content if the node that holds it has a marginal of at least ``threshold``.

Training maximises the likelihood of labelled pages: observed features less those expected under the marginals, summed by
Spark over a bounded sample of pages in each round. Labelled pages are pages whose mark-up says what they are (nodes inside
``article`` or ``main`` are content, but for nav, aside, form, comments and the like there; the rest is not), and the built-in
``LAYOUTS``, made anew from lists of words, which show the same roles under class names alone. For half of the training copies
the tags that tell are replaced by ``div``, so that the other features carry weight.

Decoding: character references are resolved, white space inside a block becomes one space, blocks are trimmed and joined in
page order by a line feed. Scripts, styles, templates, comments and the head never hold text; nor do elements that show
something else (``SKIPPED``), each up to its own end tag. The head ends with its end tag, or where body text or a body's tag begins.

Defined results: a null or empty html, or a page without content, is an empty text; unclosed, stray or wrongly nested tags are
closed as the next tag implies (a skipped element, title, textarea or iframe without an end tag by the next block or the end of
what it stands in; a script or style without one goes on to the end of the page); repeated rows and null ids are kept row by row; an empty table trains on the layouts alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import frame, staged, table

#: Element names of HTML by their role here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style title textarea iframe".split()
SKIPPED = set("noscript template svg math object select canvas audio video".split())
_IN_HEAD = set("meta link base basefont bgsound title style script noscript template noframes head html".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
KINDS = [
    "article main", "nav menu", "header", "footer", "aside", "form button fieldset", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd",
    "div section center", "table tbody thead tfoot tr", "td th caption", "blockquote pre figure figcaption", "a", "html body", "dialog",
]
#: Parts of class, id and role values, by what they hint at.
HINTS = [
    "article content story entry post body-text main prose text", "nav menu breadcrumb toolbar tabs pager pagination", "header masthead banner top-bar topbar",
    "footer colophon copyright legal bottom", "sidebar side aside rail widget related recommend popular more-from", "ad ads advert sponsor promo banner-ad adbox",
    "comment comments reply disqus discussion", "cookie consent notice alert popup modal overlay gdpr notification", "form search login subscribe newsletter signup",
    "share social tags byline meta author date", "script hidden skip sr-only",
]
KIND_OF = {t: k for k, ts in enumerate(KINDS) for t in ts.split()}
HINT_OF = {w: k for k, ws in enumerate(HINTS) for w in ws.split()}
N_KINDS, N_HINTS = len(KINDS) + 1, len(HINTS)
N_SHAPES = 12
N_UNARY = 1 + N_KINDS + 2 * N_HINTS + N_SHAPES
N_PAIRS = 2 * 2 * 3  # of labels, by the child's hint: none, some, structural tag

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}
#: Tags that end an open paragraph or list item.
_ENDS_P = set("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_BLOCKS = (_ENDS_P | set(KIND_OF)) - {"a", "button"}
_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BOUND = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": set()}


def _tokens(source: str) -> tuple[list[tuple[re.Match, int]], dict[int, int], set[int]]:
    """Tags and comments with where they end (raw text is part of its tag); of skipped elements the place of the end tag, by
    that of the start tag; the places of title, textarea and iframe tags without an end tag."""
    out: list[tuple[re.Match, int]] = []
    ends: dict[int, int] = {}
    unclosed: set[int] = set()
    waiting: dict[str, list[int]] = {}
    gone: set[str] = set()
    foreign, at, n = False, 0, len(source)
    while m := _TOKEN.search(source, at):
        at, name = m.end(), (m[2] or "").lower()
        whole = not (m[3] or "").endswith("/")
        if name in SKIPPED:
            if m[1]:
                if waiting.get(name):
                    ends[waiting[name].pop()] = len(out)
            elif whole or name not in ("svg", "math"):
                waiting.setdefault(name, []).append(len(out))
            foreign = name in ("svg", "math") and not m[1] and whole
        elif name in _BLOCKS:
            foreign = False
        elif name in _RAW_END and not m[1] and (whole or not foreign):
            end = None if name in gone else _RAW_END[name].search(source, at)
            if end:
                at = end.end()
            else:
                gone.add(name)
                if name in ("script", "style"):
                    at = n
                else:
                    unclosed.add(len(out))
        out.append((m, at))
    return out, ends, unclosed


class Page:
    """Nodes in page order (0 is the root), and the runs of text with the node and the block they stand in."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.hints = ["html"], [-1], [frozenset()]
        self.runs: list[tuple[int, int, str, bool]] = []  # node, block, raw text, inside a link
        self._read(source)

    def _read(self, source: str) -> None:
        block, links, at, i = 0, 0, 0, 0
        tag, parent, hints, runs = self.tag, self.parent, self.hints, self.runs
        # the open elements: node and name; those deeper than 200 have the node of the last level
        open_, names, count = [0], ["html"], Counter()
        stack_inline: list[str] = []
        skip = ""  # the head, or an open element without an end tag that holds no text
        n = len(source)
        tokens, ends, unclosed = _tokens(source)

        def close(to: int) -> None:
            count.subtract(names[to:])
            del open_[to:], names[to:]

        while at < n:
            m, after = tokens[i] if i < len(tokens) else (None, n)
            begin = m.start() if m else n
            if begin > at:
                if skip == "head" and not source[at:begin].isspace():
                    skip = ""
                if not skip:
                    runs.append((open_[-1], block, source[at:begin], links > 0))
            if not m:
                break
            at, own, i = after, i, i + 1
            name = m[2]
            if not name:
                continue
            name = name.lower()
            if skip:
                if m[1]:
                    ended = name in ("head", "body", "html") if skip == "head" else name in ("body", "html") or count[name] > 0 or name in stack_inline
                else:
                    ended = name not in _IN_HEAD if skip == "head" else name in _BLOCKS
                if ended:
                    skip = ""
                elif own in ends:
                    i, at = ends[own] + 1, tokens[ends[own]][1]
                elif own in unclosed:
                    skip = name
                if not ended:
                    continue
            if m[1]:
                if name in INLINE:
                    if name in stack_inline:
                        stack_inline.remove(name)
                        links -= name == "a"
                elif name == "p" or name == "br":
                    block += 1
                    if name == "p" and names[-1] == "p":
                        close(len(names) - 1)
                elif count[name] > 0:
                    for k in range(len(open_) - 1, 0, -1):
                        if names[k] == name:
                            close(k)
                            block += 1
                            break
                continue
            if name == "head":
                skip = "head" if len(tag) == 1 else ""
                continue
            if name in SKIPPED or name in _RAW_END:
                if own in ends:
                    i, at = ends[own] + 1, tokens[ends[own]][1]
                elif own in unclosed or name in SKIPPED and not (name in ("svg", "math") and (m[3] or "").endswith("/")):
                    skip = name
                continue
            if name in INLINE:
                if name == "a":
                    links += "a" not in stack_inline
                    if "a" in stack_inline:
                        stack_inline.remove("a")
                if name not in VOID and not (m[3] or "").endswith("/"):
                    stack_inline.append(name)
                continue
            if name != "br":
                block += 1
            if name in VOID:
                if name == "br":
                    runs.append((open_[-1], block, " ", links > 0))
                continue
            if name in ("html", "body"):
                if m[3]:
                    hints[0] |= _hints_of(m[3])
                continue
            if name in _ENDS_P:
                stack_inline, links = [], 0
                if names[-1] == "p":
                    close(len(names) - 1)
            if name in _OWN and any(count[x] > 0 for x in _OWN[name]):
                for k in range(len(open_) - 1, 0, -1):
                    if names[k] in _BOUND[name]:
                        break
                    if names[k] in _OWN[name]:
                        close(k)
                        break
            tag.append(name)
            parent.append(open_[-1])
            hints.append(_hints_of(m[3]) if m[3] else frozenset())
            open_.append(len(tag) - 1 if len(open_) < 200 else open_[-1])  # deeper ones stand as leaves of the last level
            names.append(name)
            count[name] += 1

    def blocks(self) -> list[tuple[int, str]]:
        """(node, text) of each block with text, in page order; a block belongs to the node of its first words."""
        out: list[tuple[int, str]] = []
        last, node, parts = -1, 0, []
        for own, block, raw, _ in [*self.runs, (-1, -2, "", False)]:
            if block != last or (own != node and parts):
                text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
                if text:
                    out.append((node, text))
                last, parts, node = block, [], own
            parts.append(raw)
        return out


@lru_cache(10_000)
def _hint_words(text: str) -> frozenset:
    words = _WORD.findall(text.lower())
    out = {HINT_OF[w] for w in words if w in HINT_OF}
    for pair in zip(words, words[1:]):
        if "-".join(pair) in HINT_OF:
            out.add(HINT_OF["-".join(pair)])
    return frozenset(out)


def _hints_of(attributes: str) -> frozenset:
    found = _ATTR.findall(attributes)
    return frozenset().union(*[_hint_words(a or b or c) for a, b, c in found]) if found else frozenset()


def unary(page: Page, hide: bool = False) -> tuple[list[list[int]], list[int]]:
    """The features that are on, for each node, and the kind of its pairwise potential. hide: tags that tell count as div."""
    n = len(page.tag)
    chars, linked, stops, runs = [0] * n, [0] * n, [0] * n, [0] * n
    for node, _, raw, link in page.runs:
        size = len(raw)
        if size > 2:
            chars[node] += size
            linked[node] += size if link else 0
            stops[node] += raw.count(". ") + raw.count(".\n") + (raw.rstrip()[-1:] in (".", "!", "?"))
            runs[node] += 1
    total, total_links = chars[:], linked[:]
    for i in range(n - 1, 0, -1):
        total[page.parent[i]] += total[i]
        total_links[page.parent[i]] += total_links[i]
    page_chars = max(1, total[0])
    depth, above = [0] * n, [frozenset()] * n
    out, kinds = [], []
    first_shape = 1 + N_KINDS + 2 * N_HINTS
    for i in range(n):
        p = page.parent[i]
        if p >= 0:
            depth[i] = depth[p] + 1
            above[i] = above[p] | page.hints[p]
        kind = KIND_OF.get(page.tag[i], N_KINDS - 1)
        if hide and kind < 6:
            kind = KIND_OF["div"]
        on = [0, 1 + kind, *(1 + N_KINDS + h for h in page.hints[i]), *(1 + N_KINDS + N_HINTS + h for h in above[i])]
        density = total_links[i] / total[i] if total[i] else 0
        size = 0 if chars[i] < 3 else 1 if chars[i] < 40 else 2 if chars[i] < 150 else 3
        on.append(first_shape + size)
        on.append(first_shape + 4 + (0 if density < 0.1 else 1 if density < 0.5 else 2))
        on.append(first_shape + 7 + (0 if total[i] < 0.1 * page_chars else 1 if total[i] < 0.5 * page_chars else 2))
        if stops[i] > 1:
            on.append(first_shape + 10)
        if depth[i] <= 2:
            on.append(first_shape + 11)
        out.append(on)
        kinds.append(2 if kind < 6 else 1 if page.hints[i] else 0)
    return out, kinds


class Forest:
    """The trees of some pages side by side, level by level."""

    def __init__(self, pages: list[Page], hide: list[bool] | None = None) -> None:
        parents, feats, kinds, self.begin, at = [], [], [], [], 0
        for k, page in enumerate(pages):
            own, own_kinds = unary(page, bool(hide and hide[k]))
            feats += own
            kinds += own_kinds
            parents += [p + at if p >= 0 else -1 for p in page.parent]
            self.begin.append(at)
            at += len(own)
        self.n = at
        self.parent = np.array(parents, np.int64)
        self.kind = np.array(kinds, np.int64)
        self.node = np.repeat(np.arange(at), [len(f) for f in feats])
        self.feature = np.array([x for f in feats for x in f], np.int64)
        depth = np.zeros(at, np.int64)
        for i, p in enumerate(parents):
            if p >= 0:
                depth[i] = depth[p] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max(initial=0)) + 1)]

    def infer(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of the labels of each node, and of (parent's label, own label) for each node but the roots."""
        u, pair = weights[:N_UNARY], weights[N_UNARY:].reshape(3, 2, 2)
        local = np.zeros((self.n, 2))
        local[:, 1] = np.bincount(self.node, u[self.feature], self.n)
        up = np.zeros((self.n, 2))  # what each node tells its parent
        belief = local.copy()
        for at in reversed(self.levels):
            both = belief[at][:, None, :] + pair[self.kind[at]]
            top = both.max(axis=2)
            up[at] = top + np.log(np.exp(both - top[:, :, None]).sum(axis=2))
            np.add.at(belief, self.parent[at], up[at])
        joint = np.zeros((self.n, 2, 2))
        full = belief.copy()  # with what the parent tells
        for at in self.levels:
            rest = full[self.parent[at]] - up[at]
            both = rest[:, :, None] + pair[self.kind[at]]
            top = both.max(axis=1)
            full[at] = belief[at] + top + np.log(np.exp(both - top[:, None, :]).sum(axis=1))
            edge = both + belief[at][:, None, :]
            edge = np.exp(edge - edge.max(axis=(1, 2), keepdims=True))
            joint[at] = edge / edge.sum(axis=(1, 2), keepdims=True)
        p = np.exp(full - full.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), joint

    def totals(self, single: np.ndarray, joint: np.ndarray) -> np.ndarray:
        """Sums of the features under the given marginals."""
        pairs = np.zeros((3, 2, 2))
        inner = self.parent >= 0
        np.add.at(pairs, self.kind[inner], joint[inner])
        return np.concatenate([np.bincount(self.feature, single[self.node, 1], N_UNARY), pairs.ravel()])


# --- labelled pages -----------------------------------------------------------------------------------------------------

_INSIDE, _OUTSIDE = {"article", "main"}, {"nav", "aside", "footer", "form", "header", "menu", "dialog", "button"}
_NEVER = {1, 3, 4, 5, 6, 7, 8}  # hints that mark what is no content even inside an article


def labels(page: Page) -> np.ndarray | None:
    """1 for content, from the mark-up itself; None if it has no article or main element."""
    if not _INSIDE & set(page.tag):
        return None
    y = np.zeros(len(page.tag), np.int64)
    for i in range(1, len(y)):
        inside = y[page.parent[i]] or page.tag[i] in _INSIDE
        y[i] = bool(inside) and page.tag[i] not in _OUTSIDE and not (_NEVER & page.hints[i])
    return y


def layouts(n: int = 100) -> list[tuple[str, str]]:
    """Labelled pages made from lists of roles: (html, the same html with the content inside article)."""
    rng = np.random.default_rng(7)
    syllables = ["ka", "lo", "mi", "ren", "ta", "sol", "vi", "dor", "an", "el"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    words = lambda k: " ".join(word() for _ in range(k))
    sentence = lambda: words(rng.integers(6, 20)).capitalize() + "."
    links = lambda k: "".join(f'<li><a href="/{word()}">{words(rng.integers(1, 3))}</a></li>' for _ in range(k))
    text = lambda: "".join(f"<p>{' '.join(sentence() for _ in range(rng.integers(1, 6)))}</p>" for _ in range(rng.integers(2, 7)))
    pick = lambda k: str(rng.choice(HINTS[k].split()))
    out = []
    for _ in range(n):
        parts = [
            f'<div class="{pick(1)}"><ul>{links(rng.integers(3, 9))}</ul></div>', f'<div class="{pick(2)}"><p>{words(3)}</p></div>',
            f'<div class="{pick(7)}"><p>{sentence()}</p></div>', f'<div class="{pick(5)}"><p>{sentence()}</p></div>',
        ]
        after = [
            f'<div class="{pick(4)}"><h3>{words(2)}</h3><ul>{links(rng.integers(3, 7))}</ul></div>', f'<div class="{pick(6)}"><h3>{words(1)}</h3><p>{sentence()}</p><p>{sentence()}</p></div>',
            f'<form class="{pick(8)}"><p>{words(4)}</p></form>', f'<div class="{pick(3)}"><p>{words(6)}</p></div>', f'<aside><p>{sentence()}</p></aside>',
            f'<section class="{pick(6)}"><div><p>{sentence()}</p></div></section>', f"<footer><p>{words(5)}</p></footer>",
        ]
        rng.shuffle(parts)
        rng.shuffle(after)
        body = f"<h1>{words(5)}</h1>{text()}" + (f"<h2>{words(3)}</h2>{text()}" if rng.random() < 0.5 else "") + (f"<ul>{''.join(f'<li>{sentence()}</li>' for _ in range(3))}</ul>" if rng.random() < 0.3 else "")
        name = str(rng.choice(["article", "content", "story", "entry", "post", "main", ""]))
        head, tail = "".join(parts[: rng.integers(1, 5)]), "".join(after[: rng.integers(1, 8)])
        shown = f'<div class="{name}">{body}</div>' if name else f"<div>{body}</div>"
        out.append((f"<html><body>{head}{shown}{tail}</body></html>", f"<html><body>{head}<main>{body}</main>{tail}</body></html>"))
    return out


@lru_cache(2)  # a worker meets the same sample in every round
def _examples(sources: tuple[str, ...], with_layouts: bool) -> tuple[Forest, np.ndarray] | None:
    pages, hide, ys = [], [], []
    for s in sources:
        page = Page(s)
        y = labels(page)
        if y is not None:
            for h in (False, True):
                pages.append(page)
                hide.append(h)
                ys.append(y)
    for shown, told in layouts() if with_layouts else []:
        pages.append(Page(shown))
        hide.append(False)
        ys.append(labels(Page(told)))
    return (Forest(pages, hide), np.concatenate(ys)) if pages else None


def train(pages: DataFrame, source: str = "html", sample: int = 200, longest: int = 200_000, rounds: int = 25) -> np.ndarray:
    """Weights. The sample: the ``sample`` pages with the least hash among those of at most ``longest`` characters that have
    an article or main element; it is the only part of the input that training reads."""
    rows = pages.select(F.col(source).alias("source")).where(F.lower("source").rlike("<(article|main)[ >]") & (F.length("source") <= longest))
    rows = rows.orderBy(F.xxhash64("source"), "source").limit(sample)
    rows = staged(rows.unionByName(pages.sparkSession.createDataFrame([(None,)], "source string")), "html-sample")  # null: the layouts
    weights = np.zeros(N_UNARY + N_PAIRS)
    speed = np.full(len(weights), 1e-3)

    def gradient(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = [t for pdf in batches for t in pdf["source"]]
        made = _examples(tuple(t for t in texts if t is not None), any(t is None for t in texts))
        if made:
            forest, y = made
            seen, inner = np.eye(2)[y], forest.parent >= 0
            joint = np.zeros((forest.n, 2, 2))
            joint[inner, y[forest.parent[inner]], y[inner]] = 1
            g = forest.totals(seen, joint) - forest.totals(*forest.infer(weights))
            yield frame([(k, float(x), forest.n) for k, x in enumerate(g)], "k int, g double, n long")

    for _ in range(rounds):
        sums = rows.mapInPandas(gradient, "k int, g double, n long").groupBy("k").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toPandas().sort_values("k")
        step = sums["g"].to_numpy() / sums["n"].max() - 1e-4 * weights
        speed += step**2
        weights += 0.5 * step / np.sqrt(speed)
    return weights


def extract(weights: np.ndarray, source: Column, threshold: float = 0.5, batch_nodes: int = 200_000) -> Column:
    @F.pandas_udf(T.StringType())
    def main_text(sources: pd.Series) -> pd.Series:
        out: list[str] = []
        pages: list[Page] = []
        n = 0

        def flush() -> None:
            if pages:
                forest = Forest(pages)
                content = forest.infer(weights)[0][:, 1] >= threshold
                out.extend("\n".join(t for node, t in page.blocks() if content[at + node]) for page, at in zip(pages, forest.begin))
                pages.clear()

        for s in sources:
            pages.append(Page(s or ""))
            n += len(pages[-1].tag)
            if n >= batch_nodes:
                flush()
                n = 0
        flush()
        return pd.Series(out, dtype=object)

    return main_text(source)


def main_text(pages: DataFrame, source: str = "html") -> DataFrame:
    """Adds ``text`` to every row."""
    weights = train(pages, source)
    rest = [F.col(f"`{c}`") for c in pages.columns if c.lower() != "text"]
    return pages.select(*rest, extract(weights, F.col(source)).alias("text"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
