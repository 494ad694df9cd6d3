"""The training-data operators against brute force, exact round trips and held-out labels, and on edge cases."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from compare import rows
from pyspark.sql import functions as F

from tidewire.llm import decontamination, html_extraction, language_model, licenses, packing
from tidewire.llm import quality_classifier, quality_rules, registry, simhash, token_files, tokenizing, warc
from tidewire.llm.common import new_dir

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(name, spark, sf, oracle):
    assert rows(registry.queries()[name](spark, sf).toPandas()) == rows(oracle(registry.oracle_sql()[name]))


# --- 1 and 3 ------------------------------------------------------------------------------------------------------------


def test_rules_keep_clean_and_reject_junk(spark, sf):
    told = pd.read_parquet(sf.replace("0.001", "0.01") + "/labels.parquet").merge(quality_rules.op1_quality_rules(spark, sf.replace("0.001", "0.01")).toPandas(), on="doc_id")
    clean = told[(told.quality == 1) & ~told.base_failed]
    assert clean.kept.mean() > 0.99 and told[told.quality == 0].kept.mean() < 0.1


def test_rules_edge(edge, empty):
    out = quality_rules.quality_rules(edge).collect()
    assert len(out) == edge.count() and all(not r.kept for r in out if not (r.text or "").strip())
    assert quality_rules.quality_rules(empty).count() == 0


def test_line_rules():
    fails = lambda t: quality_rules.line_fails(t, t.encode().split())
    assert not any(map(fails, ["A plain sentence of some words.", "这是一个很长的句子，没有问题。", "यह एक वाक्य है।", "هل هذا سؤال؟", "He said “yes.”", "Das ist ein Satz, der endet. 12"]))
    assert all(map(fails, ["Home About Contact Products Blog Careers end. ok now", "Home About Us Our Products Blog.", "Home | About | Contact us.", "see https://a.b/c www.d.e.", "no stop at the end here", "Nous utilisons des cookies. Wir verwenden cookies.", "THIS IS SHOUTED."]))


def test_repeated_words_equals_loop():
    rng = np.random.default_rng(3)
    for n, v in ((30, 2), (200, 3), (500, 40), (7, 1), (8, 1), (9, 1), (64, 64)):
        words = [b"%d" % x for x in rng.integers(0, v, n)]
        words += words[: n // 3]
        seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        hit = {i + j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(8)}
        assert quality_rules.repeated_words(words) == len(hit)


def test_classifier_on_held_out_labels(spark, sf):
    d = sf.replace("0.001", "0.01")
    out = pd.read_parquet(d + "/labels.parquet").merge(quality_classifier.op3_quality_classifier(spark, d).toPandas(), on="doc_id")
    held = out[out.held_out]
    assert ((held.predicted == held.quality).mean() > 0.95) and held.score.between(0, 1).all()
    assert (out.held_out == [zlib.crc32(str(k).encode()) % 5 == 0 for k in out.doc_id]).all()


def test_classifier_equals_plain_computation(spark, sf):
    d = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(d + "/documents.parquet"), spark.read.parquet(d + "/labels.parquet")
    labels = labels.union(labels.limit(30))  # repeated labels and repeated ids
    docs = docs.unionByName(docs.limit(200))
    model = quality_classifier.fit(docs, labels)
    told = dict(zip(*[labels.toPandas()[c] for c in ("doc_id", "quality")]))
    rows_ = [(told[r.doc_id], quality_classifier.statistics(r.text)) for r in docs.collect() if r.doc_id in told]
    y, x = np.array([r[0] for r in rows_]), np.array([r[1] for r in rows_])
    pooled = sum(np.cov(x[y == c].T, bias=True) * (y == c).sum() for c in (0, 1)) / len(y)
    density = []
    for c in (0, 1):
        own, mean = x[y == c], x[y == c].mean(axis=0)
        s = np.cov(own.T, bias=True)
        spread = np.mean([np.linalg.norm(np.outer(v - mean, v - mean) - s) ** 2 for v in own]) / len(own)
        a = min(1.0, spread / np.linalg.norm(s - pooled) ** 2)
        cov = (1 - a) * s + a * pooled + (1e-3 * np.trace(pooled) / x.shape[1] + 1e-9) * np.eye(x.shape[1])
        inverse = np.linalg.inv(cov)
        density.append([-0.5 * (v - mean) @ inverse @ (v - mean) - 0.5 * np.linalg.slogdet(cov)[1] for v in x])
    assert np.allclose(model.difference(x), np.array(density[1]) - np.array(density[0]), rtol=1e-6, atol=1e-6)


def test_classifier_edge(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1), (1, None), (5, 0), (None, 1)], "doc_id long, quality int")
    out = quality_classifier.classify(edge, labels).collect()
    assert len(out) == edge.count() and all(0 <= r.score <= 1 for r in out)
    assert quality_classifier.classify(empty, labels.limit(0)).count() == 0


# --- 2 and 5 ------------------------------------------------------------------------------------------------------------

ODD = ["", " ", "a  b\n\n c", "it's <|endoftext|> x<|endoftext|>y", "a\xa0b \xa0c", "x\x1cy z", "İstanbul ﬁ é ½²³ … '.' ’s", "Ünïcode—dash “q” 日本語 😀", "don't DON'T 12345 1a2b ...!!! 'tis", "\x00\x01 a\x7f"]


@pytest.mark.parametrize("name", [tokenizing.WORD_BPE, tokenizing.BYTE_BPE])
def test_ids_equal_the_library(name, sf):
    enc = tokenizing.Encoder(name, most=50)
    rng = np.random.default_rng(1)
    letters = list(" \n\t'sStrevmld0129.,!é Éß½\xa0\x85…<|>endoftext İſ")
    texts = ODD + ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(3000)] + list(pd.read_parquet(sf + "/documents.parquet").text[:40])
    assert [t for t in texts if enc.encode(t) != enc.full(t)] == []


def ids_of(name, text, end):
    enc = tokenizing.encoder(name)
    return enc.full(text or "") + np.array([end], "<u4").tobytes()


def test_token_files_round_trip(spark, sf, edge, empty):
    docs = pd.read_parquet(sf + "/documents.parquet").sort_values("doc_id")
    at, want = 0, {}
    for k, t in zip(docs.doc_id, docs.text):
        ids = ids_of(tokenizing.WORD_BPE, t, 1)
        want[k] = (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.op2_token_files(spark, sf).collect()}
    assert got == want
    folder = new_dir(spark, "t")
    token_files.write_token_files(edge, folder, shard_docs=3, bucket_keys=4)
    back = token_files.read_token_files(edge.select("doc_id").union(spark.createDataFrame([(99999,)], "doc_id long")), folder).collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in back) == Counter((r.doc_id, ids_of(tokenizing.WORD_BPE, r.text, 1)) for r in edge.collect())
    one = token_files.KeyedReader(folder)
    for key in {r.doc_id for r in edge.collect()}:
        assert sorted((s, i.tobytes()) for s, i in one.get(key)) == sorted((r.start, bytes(r.ids)) for r in back if r.doc_id == key)
    assert one.get(99999) == one.get(-1) == []
    with pytest.raises(TypeError):
        token_files.write_token_files(edge.withColumn("doc_id", F.col("doc_id").cast("string")), new_dir(spark, "t"))
    starts = sorted((r.start, len(r.ids) // 4) for r in back)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    folder = new_dir(spark, "t")
    token_files.write_token_files(empty, folder)
    assert token_files.read_token_files(empty, folder).count() == 0


def test_perfect_hash():
    keys = np.arange(-500, 20_000, 7)
    h = token_files.key_hash(keys, np.zeros(len(keys), bool))
    at = token_files.slots(h, token_files.build_mph(h), len(h))
    assert sorted(at) == list(range(len(keys)))


def check_packing(docs, pieces, size=1024):
    by = {}
    for r in pieces:
        by.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in own])
        assert [r.offset for r in own] == [0, *ends[:-1]] and ends[-1] <= size
        padding += size - ends[-1] if ends[-1] & (ends[-1] - 1) else 0
    texts = Counter((d.doc_id, ids_of(tokenizing.BYTE_BPE, d.text, 0)) for d in docs)
    for r in pieces:
        assert len(r.ids) == 4 * r.length and any(k == r.doc_id and t[4 * r.start : 4 * (r.start + r.length)] == r.ids and len(t) == 4 * r.doc_tokens for k, t in texts)
    assert sum(r.length for r in pieces) == sum(n * len(t) // 4 for (_, t), n in texts.items())
    return padding / max(1, sum(r.length for r in pieces))


def test_packing(spark, sf, edge, empty):
    docs = spark.read.parquet(sf + "/documents.parquet").select("doc_id", "text")
    assert check_packing(docs.collect(), packing.pack_documents(docs).collect()) < 0.01
    assert check_packing(edge.collect(), packing.pack_documents(edge, most_open=2).collect()) < 0.01
    assert packing.pack_documents(empty).count() == 0


def test_sum_of_squares_choice():
    p = packing.Packer(10, 0, 100)
    for s in (6, 6, 4):
        p.add(s, np.arange(s, dtype="<u4").tobytes())
    assert p.counts[6] == 1 and len(p.out) == 2  # 4 fills one of the two windows at 6: the sum of squares falls most


def test_placement_equals_loop():
    rng = np.random.default_rng(8)
    size, packer, counts = 32, packing.Packer(32, 0, 10**6), Counter()
    for k in range(3_000):
        s = int(rng.choice([3, 5, 9, 11, 17, 20]))
        packer.add(k, np.full(s, k, "<u4").tobytes())
        best = []
        for level in range(0, size - s + 1):  # the sum of squares after each choice
            if level and not counts[level]:
                continue
            after = counts.copy()
            after[level] -= level > 0
            after[level + s] += level + s < size
            best.append((sum(v * v for v in after.values()), -level, after))
        counts = min(best, key=lambda x: x[:2])[2]
        assert [int(x) for x in packer.counts] == [counts[h] for h in range(size + 1)]
    closed, waiting = len(packer.out), packer.n_open
    packer.finish()
    cut = Counter(row[0] for row in packer.out)
    assert sum(n > 1 for n in cut.values()) <= waiting  # only windows that nothing fits in are cut
    by_rule = sum(len({r[0] for r in packer.out if r[4] == s}) > 1 for s in range(closed))
    assert by_rule > 0 and all(r[5] + r[2] <= size for r in packer.out) and sum(r[2] for r in packer.out) == sum(len(r[6]) // 4 for r in packer.out)


# --- 4 ------------------------------------------------------------------------------------------------------------------


def test_licenses(spark, edge, empty):
    mit = licenses.KNOWN_TEXTS[0][1]
    docs = [(1, "Copyright (c) 2020 X\n\n" + mit.upper().replace("SUBLICENSE", "sub" + "licence")), (2, None), (3, "* Copyright 2019 by Q\n" + licenses.KNOWN_TEXTS[3][1]), (4, "x\nSPDX-Licence-Identifier: MIT\nall rights reserved"), (5, ""), (6, mit + " and more")]
    got = {r.doc_id: (r.text_license, r.n_notices, r.notices) for r in licenses.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1][0] == "MIT" and got[3][0] == "ISC" and got[4][1:] == (2, ["LicenseRef-all-rights-reserved", "MIT"]) and got[2] == got[5] == (None, 0, []) and got[6][0] is None
    assert licenses.license_scan(edge).count() == edge.count() and licenses.license_scan(empty).count() == 0


def test_every_known_text_and_notice_is_found(spark):
    every = licenses.known_texts()
    assert {"GPL-2.0-only", "GPL-3.0-only", "Apache-2.0", "MPL-2.0", "LGPL-2.1-only", "CC0-1.0"} <= {x for x, _ in every}
    assert all(re.search(licenses.LIKELY, t) for _, t in licenses.KNOWN_NOTICES)
    wrapped = lambda t, n: "\n".join("# " + " ".join(t.split()[k : k + n]) for k in range(0, len(t.split()), n))
    docs = [(k, "Copyright (C) 1999 A. Body\n\n" + t) for k, (_, t) in enumerate(every)]
    notices = [(k, f"int f(void);\n\n{wrapped(t, 9)}\n#\nint g(void);\n") for k, (_, t) in enumerate(licenses.KNOWN_NOTICES)]
    got = {r.doc_id: r.text_license for r in licenses.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {k: x for k, (x, _) in enumerate(every)}
    got = {r.doc_id: r.notices for r in licenses.license_scan(spark.createDataFrame(notices, "doc_id long, text string")).collect()}
    assert all(got[k] == [x] for k, (x, _) in enumerate(licenses.KNOWN_NOTICES))
    marks = spark.createDataFrame([(1, "// SPDX-License-Identifier: AGPL-3.0-or-later\nx\n/* SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 OR MIT) */")], "doc_id long, text string")
    assert licenses.license_scan(marks).head()["notices"] == ["AGPL-3.0-or-later", "GPL-2.0-only WITH Classpath-exception-2.0 OR MIT"]


# --- 6 ------------------------------------------------------------------------------------------------------------------


def test_main_text_of_labelled_pages(spark, sf):
    from html import unescape

    def truth(source):
        body = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", lambda m: " " if m[0] == "<br>" else "", p))).strip() for p in re.split(r"</?(?:p|h1)>", body)]
        return "\n".join(p for p in parts if p)

    pages = pd.read_parquet(sf + "/pages.parquet").set_index("page_id").html
    out = html_extraction.op6_html_extraction(spark, sf).collect()
    assert len(out) == len(pages) and np.mean([r.text == truth(pages[r.page_id]) for r in out]) > 0.95


@pytest.fixture(scope="module")
def weights(spark, sf):
    return html_extraction.train(spark.read.parquet(sf + "/pages.parquet").limit(0), rounds=25)


def test_layouts_by_class_names(weights):
    wrong = 0
    for shown, told in html_extraction.layouts(40):
        forest = html_extraction.Forest([html_extraction.Page(shown)])
        wrong += int((html_extraction.labels(html_extraction.Page(told)) != (forest.infer(weights)[0][:, 1] >= 0.5)).any())
    assert wrong <= 6


def test_messages_equal_enumeration(weights):
    page = html_extraction.Page("<div class=nav><ul><li>a<li>b</ul></div><div><p>Some text. More of it.<p>x</div>")
    forest = html_extraction.Forest([page])
    single, joint = forest.infer(weights)
    u, pair = weights[: html_extraction.N_UNARY], weights[html_extraction.N_UNARY :].reshape(3, 2, 2)
    n, total, p1 = forest.n, 0.0, np.zeros(forest.n)
    local = np.bincount(forest.node, u[forest.feature], n)
    for bits in range(2**n):
        y = [bits >> i & 1 for i in range(n)]
        w = math.exp(sum(local[i] * y[i] for i in range(n)) + sum(pair[forest.kind[i], y[forest.parent[i]], y[i]] for i in range(n) if forest.parent[i] >= 0))
        total += w
        p1 += w * np.array(y)
    assert np.allclose(single[:, 1], p1 / total) and np.allclose(joint[1:].sum(axis=(1, 2)), 1)


def test_html_edge(spark, weights):
    docs = [(1, None), (2, ""), (3, "<p>"), (4, "plain"), (5, "<div>" * 3000 + "deep" + "</div>" * 3000), (6, "</p></div><!-- x"), (7, "<p>A &amp; b\n\n c &copy;</p>" * 2000), (7, None)]
    df = spark.createDataFrame([(k, h, "u") for k, h in docs], "page_id long, html string, text string")
    out = df.select("page_id", html_extraction.extract(weights, F.col("html")).alias("t")).collect()
    assert [r.t for r in out if r.page_id in (1, 2, 3)] == ["", "", ""] and len(out) == len(docs) and all(isinstance(r.t, str) for r in out)
    assert html_extraction.Page("<p>A &amp; b\n\n c</p>").blocks() == [(1, "A & b c")]


def test_unclosed_and_deep_elements_lose_no_text():
    told = lambda source: [t for _, t in html_extraction.Page(source).blocks()]
    rest = "<article><p>One text.</p><p>Two texts.</p></article>"
    for before in (
        "<html><head><title>T</title><body>", "<head><meta charset=x><script>a<b</script>", "<svg class=x/>", "<a href=x><svg><path></a>", "<div><svg><g><text>x</div>",
        "<select><option>x<option>y", "<noscript><img src=x>x", "<object data=x>", "<video src=x><source src=y>x", "<video src=x>", "<title>x", "<iframe src=x>", "<head><title>x",
        "<noscript><div>x</div></noscript>", "<video><p>x</video>", "<object><object>x</object><p>x</object>", "<svg><style/><title>x</title><foreignObject><div>x</div></foreignObject></svg>",
        "<template><article>x</article></template>", "<textarea><p>x</textarea>", "<head><noscript><p>x</p></noscript></head>", "<!-- <svg> --><style>x</style>",
    ):
        assert told(before + rest) == ["One text.", "Two texts."], before
    assert told("<video src=x>" + rest + "<video><p>x</video>") == ["One text.", "Two texts."]
    assert told("<head><title>T</title>A text alone.") == ["A text alone."]
    assert told("<p>a</p><script>x<p>b</p>") == ["a"]
    deep = html_extraction.Page("<article>" + "<div>" * 300 + "<p>in</p>" + "</div>" * 300 + "<p>out</p></article><p>after</p>")
    (_, a), (node, b), (last, c) = deep.blocks()
    assert (a, b, c) == ("in", "out", "after") and deep.tag[deep.parent[node]] == "article" and deep.parent[last] == 0
    many = html_extraction.Page("<article><section><div>" + "<ul><li>x" * 250 + "</ul>" * 250 + "</div><p>out</p></section></article>")
    assert many.tag[many.parent[many.blocks()[-1][0]]] == "section"


# --- 7 ------------------------------------------------------------------------------------------------------------------


def test_contamination_of_a_long_text_that_is_all_benchmark(spark):
    words = [f"w{k * 7919 % 30_011}" for k in range(20_000)]
    bench = spark.createDataFrame([(f"i{k:04d}", " ".join(words[k : k + 60])) for k in range(0, 20_000, 50)] + [("short", "w0 w7919"), ("none", "!?")], "item_id string, text string")
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "w0 W7919, and no more"), (3, "w0 w1")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, len(r["items"])) for r in decontamination.contamination(docs, bench, block=50).collect()}
    assert got == {1: (20_000, 20_000, 401), 2: (5, 2, 1), 3: (2, 0, 0)}


def test_contamination_equals_loop(spark, edge, empty):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    rng = np.random.default_rng(5)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 4, n))
    items = [(1, say(30)), (2, say(10)), (3, "W1 w2"), (4, "same text"), (5, None), (6, "..."), (10, say(12)), (10, say(11)), (None, "text")]
    docs = [(k, say(int(rng.integers(0, 120)))) for k in range(40)] + [(r.doc_id, r.text) for r in edge.collect()]
    windows = {}
    for k, t in items:
        w = low(t)
        for n in [min(len(w), 10)] if w and k is not None else []:
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(str(k))
    want = Counter()
    for k, t in docs:
        w, hit, found = low(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        want[k, len(w), len(hit), tuple(sorted(found))] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1_000_000, 7):
        got = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench, block=block).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == want
    assert decontamination.contamination(empty, bench).count() == 0
    assert all(r.n_hit == 0 for r in decontamination.contamination(edge, bench.limit(0)).collect())


# --- 8 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [500_000, 0])
def test_warc_round_trip(spark, sf, block):
    pages = [(1, "http://a\nb", "x"), (2, "ü%20", "x"), (None, None, "x"), (None, None, None), (3, "c", ""), (9, "z", "long é " * 100_000), (5, "q", "only")]
    folder = new_dir(spark, "w")
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, key string")
    warc.write_warc(df, folder, block=block)
    back = {(r.page_id, r.payload_bytes): r for r in warc.read_warc(spark, folder).collect()}
    assert len(back) == len(pages)
    for k, _, h in pages:
        raw = (h or "").encode()
        r = back[k, len(raw)]
        top = max((p[0] for p in pages if (p[2] or "").encode() == raw and p[0] is not None), default=None)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if k == top else ("revisit", top))
        assert r.payload is None if k != top else bytes(r.payload) == raw
    folder = new_dir(spark, "w")
    warc.write_warc(df.limit(0), folder)
    assert warc.read_warc(spark, folder).count() == 0
    out = warc.op8_warc(spark, sf).toPandas()
    assert len(out) == len(pd.read_parquet(sf + "/pages.parquet")) and (out.payload_digest.str.len() == 32).all()


# --- 9 ------------------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    import xxhash

    w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    f = np.array(fps, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1 :]) <= 2):
            a, b = find(i), find(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


def test_simhash_equals_loop(spark, sf):
    docs = pd.read_parquet(sf + "/documents.parquet").sort_values("doc_id")
    fps = [slow_fingerprint(t) for t in docs.text]
    ids = docs.doc_id.tolist()
    want = {k: ("%016x" % f, ids[c]) for k, f, c in zip(ids, fps, slow_components(fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op9_simhash(spark, sf).collect()} == want


@pytest.mark.parametrize("large", [4, 64])
def test_links_in_dense_groups(spark, large):
    rng = np.random.default_rng(0)
    fps = {0, 2**64 - 1, 3, 2**63}
    for b in rng.integers(0, 2**63, 4):
        for _ in range(120):
            x = int(b)
            for k in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(k)
            fps.add(x)
    fps = sorted(fps, key=lambda x: x - 2**64 if x >> 63 else x)
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    got = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), large)).collect()}
    assert [got.get(x, x) for x in signed] == [signed[c] for c in slow_components(fps)]


def test_simhash_edge(edge, empty):
    out = simhash.near_duplicates(edge).collect()
    assert len(out) == edge.count() and {r.component_id for r in out if r.doc_id in (2, 3, 4)} == {2} and {r.component_id for r in out if r.doc_id in (6, 7)} == {6}
    assert simhash.near_duplicates(empty).count() == 0


def slow_similar(texts, least=0.8, size=5):
    """For each text the first that it is linked to, over all pairs."""
    sets = []
    for t in texts:
        w = WORD.findall((t or "").encode().lower())
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and len(a & b) >= least * len(a | b)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(sets))]


def near_copies(rng, n_families=12, copies=5, large_family=80):
    """Texts with families of near copies: a few words of a base changed, dropped or added."""
    say = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    out = []
    for f in range(n_families + 1):
        base = say(int(rng.integers(120, 400)))
        for _ in range(large_family if f == n_families else copies):
            own = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 60))):
                k = int(rng.integers(0, len(own)))
                own[k : k + 1] = [[], say(1), [own[k], *say(1)]][int(rng.integers(0, 3))]
            out.append(" ".join(own))
    return out + [" ".join(say(int(rng.integers(1, 200)))) for _ in range(60)] + ["a b", "A  b", "", None, " ", "a b c d e", "a b c d f"]


def test_similar_groups_equal_all_pairs(spark, empty):
    texts = near_copies(np.random.default_rng(4))
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    for large, block in ((16, 256), (3, 20)):  # the second: all families in bundles, of several blocks
        got = {r.row: r.group for r in simhash.similar_groups(docs, large=large, block=block).collect()}
        strict, loose = slow_similar(texts, 0.9), slow_similar(texts, 0.8)
        assert sorted(got) == list(range(len(texts)))
        assert all(got[k] == got[strict[k]] for k in got)  # 0.998 of such links are found one by one
        assert all(loose[k] == loose[got[k]] for k in got)  # and none is made up
        assert sum(got[k] == k for k in got) <= 1.03 * len(set(loose))
    assert simhash.similar_groups(empty.select("row", "text")).count() == 0


def test_similar_groups_recall_by_similarity(spark):
    """Pairs alone, planted at three similarities: of those at the bound itself 0.9 or more are found, and no other row is linked."""
    rng, texts, bound = np.random.default_rng(8), [], []
    for n, change in ((404, 41), (404, 30), (404, 19)):  # 400 shingles: changed heads and tails leave 0.80, 0.86, 0.91 of them
        for _ in range(400):
            own = [f"w{x}" for x in rng.integers(0, 10**6, n + change)]
            bound.append((n - 4 - change) / (n - 4 + change))
            texts += [" ".join(own[:n]), " ".join(own[change:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    got = {r.row: r.group for r in simhash.similar_groups(docs).collect()}
    assert all(g in (k, k - k % 2) for k, g in got.items())
    found = np.array([got[2 * k + 1] == 2 * k for k in range(1200)]).reshape(3, 400).mean(axis=1)
    assert np.round(np.array(bound).reshape(3, 400)[:, 0], 2).tolist() == [0.81, 0.86, 0.91]
    assert found[0] >= 0.94 and found[1] >= 0.98 and found[2] >= 0.99, found


def test_segment_plan():
    assert simhash.segment_plan(0, 0.8, 0.975) == simhash.segment_plan(200_000, 0.8, 0.975) == (16, 28)
    for n in (10**6, 10**9, 10**11):
        segments, width = simhash.segment_plan(n, 0.8, 0.975)
        assert segments * (width + 1) * n < 8 * 2**width and (segments * (width + 1)).bit_length() + width < 63


# --- 10 -----------------------------------------------------------------------------------------------------------------


def slow_base(docs, folds=10):
    texts = [((t or "").encode().lower().split() + [None], zlib.crc32(str(k).encode()) % folds == 0 if k is not None else None) for k, t in docs]
    c = Counter(w for t, h in texts for w in t if h is False)
    n, v = sum(c.values()), len(c)
    return Counter((k, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 4), bool(h)) for (k, _), (t, h) in zip(docs, texts))


def test_language_model(spark, sf, edge, empty):
    d = sf.replace("0.001", "0.01")
    out = language_model.op10_language_model(spark, d).collect()
    docs = pd.read_parquet(d + "/documents.parquet")
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), r.held_out) for r in out) == slow_base(list(zip(docs.doc_id, docs.text)))
    assert sum(r.score for r in out if r.held_out) > sum(r.base_score for r in out if r.held_out)
    out = language_model.language_model(edge, rounds=1, chunk_tokens=50).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), r.held_out) for r in out) == slow_base([(r.doc_id, r.text) for r in edge.collect()])
    assert language_model.language_model(empty, rounds=1).count() == 0


def trained_on_a_few_words(spark):
    rng = np.random.default_rng(3)
    texts = [(k, " ".join(f"w{x}" for x in rng.zipf(1.3, int(rng.integers(0, 60))) % 900)) for k in range(400)]
    encoded = language_model.encode(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text", 10, 2_000)
    vocabulary = language_model.Vocabulary(encoded)
    coded = language_model.code_texts(encoded, vocabulary)
    start = language_model.Maxent(1 << 10, *vocabulary.offsets())
    return vocabulary, coded, language_model.train(coded, start, rounds=2, speed=0.1, batch=64, task_tokens=1_000)


def test_language_model_is_a_distribution_and_equals_a_loop(spark):
    lm = language_model
    vocabulary, coded, model = trained_on_a_few_words(spark)
    counts = {r["word"]: r["c"] for r in vocabulary.counts.collect()}
    ranks = {w: k for k, (w, _) in enumerate(vocabulary.heads)}
    assert len(counts) > lm.HEAD_WORDS and sum(counts.values()) == vocabulary.n and len(counts) == vocabulary.v

    def factor(table, row_hashes, offset):
        z = [float(offset[c]) + sum(float(model.weights[table][int(h) % model.buckets][c]) for h in row_hashes) for c in range(len(offset))]
        total = sum(math.exp(x) for x in z)
        return [math.exp(x) / total for x in z]

    def chances(before):  # of each class, and of each slot of each head class
        hashes = lm.features([np.array([x], np.uint32) for x in before])
        classes = factor(0, hashes[0], model.class_offset)
        return classes, [factor(1, lm.of_class(hashes, np.array([c]))[0], model.slot_offset[c]) for c in range(lm.HEADS)]

    classes, slots = chances((5, 0, 700))
    tails = {w: c for w, c in counts.items() if w not in ranks}
    share = lambda cls, c: (c + 0.1) / (vocabulary.tail_n[cls] + 0.1 * (vocabulary.tail_v[cls] + 1))
    cls_of = {r["word"]: r["cls"] for r in vocabulary.counts.select("word", lm.ending_class(F.col("word")).alias("cls")).collect()}
    mass = sum(classes[r // lm.SLOTS] * slots[r // lm.SLOTS][r % lm.SLOTS] for r in ranks.values())
    mass += sum(classes[cls_of[w]] * share(cls_of[w], c) for w, c in tails.items()) + sum(classes[c] * share(c, 0) for c in range(lm.HEADS, lm.CLASSES))
    assert abs(mass - 1) < 1e-4  # all known words and one unseen of each tail class

    row = coded.where("n_tokens BETWEEN 8 AND 30").orderBy("id").head()
    codes, want = [0, 0, 0, *np.frombuffer(row["codes"], np.uint32).tolist()], row["tail_score"]
    for k in range(3, len(codes)):
        classes, slots = chances((codes[k - 1], codes[k - 2], codes[k - 3]))
        cls = int(lm.class_of(np.array([codes[k]]))[0])
        want += math.log10(classes[cls]) + (math.log10(slots[cls][codes[k] % lm.SLOTS]) if codes[k] < lm.HEAD_WORDS else 0)
    told = sum(model.log10(c, b).sum() for _, c, b in lm.batches_of(iter([np.frombuffer(row["codes"], np.uint32)]), 7))
    assert abs(told + row["tail_score"] - want) < 1e-3


def test_sums_by_row_equals_loop():
    rng = np.random.default_rng(0)
    rows_, values = (rng.zipf(1.5, (300, 4)) % 40).astype(np.uint16), rng.normal(size=(300, 3)).astype(np.float32)
    want = np.zeros((40, 3))
    for k in range(300):
        for r in rows_[k]:
            want[r] += values[k]
    own, sums = language_model.sums_by_row(rows_, values, short=2)
    assert sorted(own) == sorted(set(rows_.ravel().tolist())) and np.allclose(want[own], sums, atol=1e-4)


def test_notices_below_long_copyright_lines_equal_sql(spark, tmp_path):
    """A copyright line of any length above a notice doesn't hide it: the scan and its SQL over each known notice."""
    import duckdb
    import pandas as pd
    from compare import rows

    docs = []
    for n, (_, notice) in enumerate(licenses.KNOWN_NOTICES):
        for size in (1, 60, 400, 415, 1500, 5000):
            holder = ("Holder of a long name " * 250)[:size]
            docs.append((len(docs), f"int f(void);\n\n * Copyright (c) 2020 {holder}\n * {notice}\n\nint g{n}(void);"))
    frame = pd.DataFrame(docs, columns=["doc_id", "text"])
    con = duckdb.connect()
    con.register("documents", frame)
    got = licenses.license_scan(spark.createDataFrame(frame))
    got = got.select("doc_id", "text_license", "n_notices", F.array_join("notices", ",").alias("notices")).toPandas()
    assert rows(got) == rows(con.sql(licenses.oracle_sql()["op4_license_scan"]).df()) and (got["n_notices"] > 0).all()
