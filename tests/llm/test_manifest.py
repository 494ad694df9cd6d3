"""The Merkle manifest against lists in memory."""

import random
import zlib
from hashlib import sha256

from tidewire.llm.manifest import manifest, op12_manifest

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def low(text):
    return None if text is None else text.translate({c: c + 32 for c in range(65, 91)})


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((i % 16, level[i // 16 * 16 : i // 16 * 16 + 16]))
        i //= 16
    return out


def expected(rows):
    leaf = lambda r, text: digest(*map(field, (*r[:4], text)))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for own in groups.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {s: tree([leaf(r, r[4]) for r in groups[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for n, s in enumerate(sources):
        for i, r in enumerate(groups[s]):
            runs, own = path(trees[s], i) + path(top, n), leaf(r, r[4])
            node = leaf(r, low(r[4])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else own
            proof = digest(*["".join(x for j, x in enumerate(run) if j != at) for at, run in runs])
            for at, run in runs:
                node = digest(*run[:at], node, *run[at + 1 :])
            out.append((r[0], own, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_lists(spark):
    """Dense, sparse, negative and shared ids, rows that repeat, nulls, many sources of one row."""
    rng = random.Random(1)
    rows = [(rng.choice([k, k, k * 10**12, -k * 77, rng.getrandbits(63), 2**63 - 1, -(2**63)]), rng.choice(["a", "b", "ü", None, "", *"aaaaa"]), rng.choice(["en", None]), rng.choice([None, k]), rng.choice([None, "", f"Text {k} Ä", "x"])) for k in range(2000)]
    rows += [(5, "a", "en", 1, f"T{k % 7}") for k in range(200)] + [(None, "z", "en", 1, "T")] * 40 + [(None,) * 5] * 20 + [(9, "only", "en", 1, "T")]
    rows += [(k, f"s{k}", "en", 1, "Q") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(6)
    assert got(manifest(df)) == expected(rows)


def test_one_row_empty_table_and_clashing_columns(spark, edge, empty):
    rows = [(9, "only", "en", 1, "T")]
    assert got(manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))) == expected(rows)
    assert manifest(empty).count() == 0
    assert got(manifest(edge)) == expected([tuple(r) for r in edge.select(*COLUMNS).collect()])


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*COLUMNS)
    out = got(op12_manifest(spark, sf))
    assert out == expected([tuple(r) for r in docs.collect()])
    assert any(not r[6] for r in out) and any(r[6] for r in out)
