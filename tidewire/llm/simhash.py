"""SimHash near-duplicates with deletion-variant signatures.

Fingerprint (64 bits): the text with A-Z in lower case, its words, every 3-word shingle with repeats (fewer words: the whole
sequence), XXH64 with seed 42 of each; a bit is 1 if it is set in over half of the hashes. No words: zero.

Links: two fingerprints that differ in at most ``2`` bits. The 64 bits are cut into two segments of 32, so that of two linked
fingerprints one segment differs in at most one bit. Each distinct fingerprint is indexed under each segment as it is, and
under each segment with one bit struck out (one wildcard), with the struck bit beside the key: a 0 and a 1 under one key differ
in just that bit. Fingerprints that share a key are joined and verified.

A key with many fingerprints (a large group of near copies) is never paired within: its members are indexed once more, by
the other segment with the bits struck out that may still differ. All that share such a key are within two bits of each
other, so each is linked to the smallest, which loses no link between components.

``similar_groups`` is the same index for another similarity: texts whose sets of ``shingle``-word shingles have a Jaccard
similarity of at least ``similarity``. For each bit of their fingerprint every shingle has a vote and a weight, both by hash, and
the heaviest shingle's vote decides. Two texts then differ in a bit with probability (1 - similarity) / 2, 0.1 at 0.8; by equal
votes it would be 0.152, and of pairs at 0.8 the same index would find only 0.88. Each text is indexed under the one-wildcard
variants of every segment, and candidates are verified twice: by the bits that differ in all and by the exact similarity of the
shingle sets. The width of a segment grows with the logarithm of the number of rows (28 bits up to 262,144 rows, 36 at 67
million), so that a text has about as many chance meetings at every size, and as many segments are taken as find a pair at
``similarity`` with probability ``recall`` (16 segments of 28 bits for 0.975; more similar pairs are found nearly always: 0.999 at
0.85); a text of a larger group has that chance with each of its near copies. Members of keys with more than ``large`` texts
(families of near copies) form bundles. Within a
bundle nothing is paired by rows: its texts are dealt to blocks, each pair of blocks is one task of bounded size that compares
their shingle sets exactly and returns the links of a spanning forest, which loses no link between components.

Components come from alternating large-star and small-star steps over the links of distinct fingerprints; each round is a
checkpoint. Exact copies share a fingerprint and never make links.

Defined results: a null or empty text has fingerprint zero and is linked like any other; repeated rows each get a row; a null
id gets a component but never names one (a component of null ids alone is null); an empty table gives an empty table. Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import staged, table
from tidewire.llm.token_files import mix

WHOLE = 32  # the wildcard position that stands for none


def fingerprint(text: str | None, block: int = 200_000) -> int:
    """As an unsigned number."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - 2)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, block):  # very long texts in blocks
        own = words[at : at + block + 2]
        shingles = [b" ".join(s) for s in zip(own, own[1:], own[2:])] if len(words) > 2 else [b" ".join(own)]
        hashes = np.fromiter((xxh64_intdigest(s, 42) for s in shingles), "<u8", len(shingles))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(text: Column) -> Column:
    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return of(text)


def _segment(fp: Column, s: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * s).bitwiseAND(F.lit(0xFFFFFFFF))


def links(prints: DataFrame, large: int = 64) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of column ``fp``; components are those of all pairs within two bits.

    Keys with up to ``large`` members are paired and verified; the others take the second index.
    """
    seg = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), _segment(F.col("fp"), s).alias("own"), _segment(F.col("fp"), 1 - s).alias("other")) for s in (0, 1)]))
    one = F.array(*[F.lit(1 << k).cast("long") for k in range(32)])
    index = prints.select("fp", seg.alias("g")).select("fp", "g.*").select(
        "fp", "s", "other", F.posexplode(F.concat(F.transform(one, lambda b: F.struct(F.col("own").bitwiseAND(F.bitwise_not(b)).alias("rest"), (F.col("own").bitwiseAND(b) != 0).cast("int").alias("bit"))), F.array(F.struct(F.col("own").alias("rest"), F.lit(0).alias("bit"))))).alias("pos", "v")
    )
    # s, pos and rest in one number
    index = index.select("fp", "other", "v.bit", "pos", (F.col("v.rest") + F.col("pos").cast("long") * F.lit(1 << 32) + F.col("s").cast("long") * F.lit(1 << 40)).alias("key"))
    by = Window.partitionBy("key")
    # who shares its key with one from the other side (with anyone, where nothing is struck out)
    index = index.withColumn("n", F.count("*").over(by)).where("n > 1").withColumn("n1", F.sum("bit").over(by)).where(f"pos = {WHOLE} OR (n1 > 0 AND n1 < n)")
    index = staged(index.select("fp", "other", "bit", "pos", "key", "n"), "simhash-index")

    small = index.where(F.col("n") <= large)
    a, b = small.select("key", "pos", F.col("fp").alias("a"), F.col("bit").alias("bit_a")), small.select("key", F.col("fp").alias("b"), F.col("bit").alias("bit_b"))
    pairs = a.join(b, "key").where(F.when(F.col("pos") == WHOLE, F.col("a") < F.col("b")).otherwise(F.col("bit_a") < F.col("bit_b")))
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    hot = index.where(F.col("n") > large)
    two = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.transform(F.sequence(i, F.lit(31)), lambda j: F.get(one, i).bitwiseOR(F.get(one, j)))))
    # one bit is left to differ where one was struck out, else two (i = j strikes out one bit twice)
    masks = F.when(F.col("pos") == WHOLE, two).otherwise(one)
    again = hot.select("fp", "key", F.explode(masks).alias("mask"), "other").withColumn("rest", F.col("other").bitwiseAND(F.bitwise_not("mask")))
    least = again.groupBy("key", "mask", "rest").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a < top")
    stars = again.join(least, ["key", "mask", "rest"]).where("a < fp").select("a", F.col("fp").alias("b"))
    return staged(pairs.unionByName(stars).distinct(), "simhash-links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b): root is the smallest node of its component.

    Alternates large-star (each node links its larger neighbours to its smallest) and small-star (each node links its smaller
    neighbours and itself to the smallest) until nothing changes; the rounds grow with the logarithm of the nodes.
    """
    edges = edges.select("a", "b").where("a <> b")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x <> y")
        edges = staged(small.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) for each row: its fingerprint as a signed number and the smallest key of its component."""
    rows = staged(docs.select(key, fingerprints(F.col(text)).alias("fp")), "simhash-rows")
    return rows.join(_components_of(rows.select("fp", F.col(key).alias("_id"))), "fp")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key): the smallest key of each component, which is never null."""
    rows = staged(docs.select(F.col(key).alias("_id"), fingerprints(F.col(text)).alias("fp")), "simhash-rows")
    return _components_of(rows).select(F.col("component_id").alias(key)).distinct()


def _components_of(ids: DataFrame) -> DataFrame:
    """(fp, component_id) for each fingerprint that stands for several rows or has links; others are components by themselves."""
    prints = staged(ids.groupBy("fp").agg(F.min("_id").alias("least"), F.count("*").alias("n")), "simhash-prints")
    roots = components(links(prints.select("fp")))
    named = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root").select("fp", "component_id")


# --- groups by the similarity of shingle sets ---------------------------------------------------------------------------


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles (fewer words: of the whole sequence; none: nothing)."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(own) - size + 1)
    out = np.full(n, min(size, len(own)), np.uint64)
    for j in range(min(size, len(own))):
        out = mix(out, 11) + own[j : j + n]
    return np.unique(mix(out, 13))


def segment_values(hashes: np.ndarray, segments: int, width: int, block: int = 256) -> list[int]:
    """A bit is the vote of the set's heaviest hash, by 32-bit weights of that bit; ``segments * width`` bits, cut into segments."""
    own = mix(np.arange(segments * width, dtype=np.uint64), 101).astype(np.uint32)
    odd, plus, least = own | np.uint32(1), mix(own.astype(np.uint64), 102).astype(np.uint32), np.full(len(own), ~np.uint32(0))
    short, weight = hashes.astype(np.uint32), np.empty((block, len(own)), np.uint32)
    for at in range(0, len(short), block):
        some = weight[: min(block, len(short) - at)]
        np.multiply(short[at : at + block, None], odd, out=some)
        np.add(some, plus, out=some)
        np.minimum(least, some.min(axis=0), out=least)
    bits = (mix(least.astype(np.uint64), 103) & np.uint64(1)).astype(np.int64).reshape(segments, width)
    return (bits @ (1 << np.arange(width))).tolist()


def segment_plan(n: int, similarity: float, recall: float) -> tuple[int, int]:
    """(segments, width) for n rows."""
    from math import ceil, log, log2

    same, width = (1 + similarity) / 2, max(28, ceil(log2(max(n, 1))) + 10)
    found = same**width + width * (1 - same) * same ** (width - 1)
    return ceil(log(1 - recall) / log(1 - found)), width


SKETCH = "struct<digest: binary, size: long, segs: array<long>>"


def sketches(text: Column, shingle: int, segments: int, width: int) -> Column:
    from hashlib import blake2b

    @F.pandas_udf(SKETCH)
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            own = shingle_set(t, shingle)
            out.append((blake2b(own.tobytes(), digest_size=16).digest(), len(own), segment_values(own, segments, width)))
        return pd.DataFrame(out, columns=["digest", "size", "segs"])

    return of(text)


def sets_of(text: Column, shingle: int) -> Column:
    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, shingle).view(np.int64) for t in texts])

    return of(text)


def variants(classes: DataFrame, width: int) -> DataFrame:
    """(node, key, bit): each segment under its own value and with each bit struck out, which ``bit`` then holds."""
    own, each = F.col("own"), [F.lit(1 << k).cast("long") for k in range(width)]
    struck = F.transform(F.array(*each), lambda b: own.bitwiseAND(F.bitwise_not(b)) * 2 + (own.bitwiseAND(b) != 0).cast("long"))
    spread = classes.select("node", F.posexplode("segs").alias("s", "own")).select("node", "s", F.posexplode(F.concat(struck, F.array(own * 2))).alias("pos", "x"))
    place = (F.col("s") * (width + 1) + F.col("pos")).cast("long") * F.lit(1 << width)
    return spread.select("node", (place + F.shiftright("x", 1)).alias("key"), (F.col("x") % 2).cast("int").alias("bit"), (F.col("pos") == width).alias("whole"))


def block_links(similarity: float):
    """Compares the shingle sets of two blocks of one bundle; returns links that connect what is linked there."""

    def links_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")
        nodes, sets = pdf["node"].to_numpy(), list(pdf["set"])
        n, sizes = len(nodes), np.array([len(x) for x in sets])
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(column, kind="stable")
        row, column = np.repeat(np.arange(n), sizes)[order], column[order]
        both = np.zeros((n, n), np.float32)
        step = 8192
        for first in range(0, int(column[-1]) + 1, step):
            lo, hi = np.searchsorted(column, [first, first + step])
            m = np.zeros((n, step), np.float32)
            m[row[lo:hi], column[lo:hi] - first] = 1
            both += m @ m.T
        near = both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-6
        root = np.arange(n)
        while True:  # the least neighbour's label, until nothing changes
            least = np.where(near, root[None, :], n).min(axis=1)
            if (least == root).all():
                break
            root = least
        return pd.DataFrame({"a": np.minimum(nodes[root], nodes), "b": np.maximum(nodes[root], nodes)})[root != np.arange(n)]

    return links_of


def similar_groups(rows: DataFrame, *, row: str = "row", text: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = 0.975, large: int = 16, block: int = 256, block_shingles: int = 400_000) -> DataFrame:
    """(row, group) for each row of a written table that numbers its rows in ``row``: the smallest number of its group.

    Texts with equal shingle sets are one class. A null or empty text has the empty set; all of these are one group.
    """
    from math import ceil, sqrt

    segments, width = segment_plan(rows.count(), similarity, recall)
    told = staged(rows.select(F.col(row).alias("row"), sketches(F.col(text), shingle, segments, width).alias("k")).select("row", "k.*"), "similar-rows")
    classes = told.groupBy("digest").agg(F.min("row").alias("node"), F.first("size").alias("size"), F.first("segs").alias("segs"))
    classes = staged(classes, "similar-classes")

    by = Window.partitionBy("key")
    index = variants(classes.where("size > 0"), width).withColumn("n", F.count("*").over(by)).where("n > 1").withColumn("n1", F.sum("bit").over(by))
    index = index.withColumn("least", F.min("node").over(by)).where("whole OR (n1 > 0 AND n1 < n)")  # of a key all rows stay or none
    index = staged(index.select("node", "key", "bit", "whole", "n", "least"), "similar-index")

    hot = index.where(F.col("n") > large)
    stars = hot.where("least < node").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    bundles = staged(_with_roots(components(staged(stars, "similar-stars"))), "similar-bundles")

    some = staged(index.where(F.col("n") <= large).drop("least").join(bundles, "node", "left"), "similar-small")
    a = some.select("key", "whole", *[F.col(c).alias(f"{c}_a") for c in ("node", "bit", "root")])
    b = some.select("key", *[F.col(c).alias(f"{c}_b") for c in ("node", "bit", "root")])
    apart = F.col("root_a").isNull() | F.col("root_b").isNull() | (F.col("root_a") != F.col("root_b"))
    meet = (F.col("whole") & (F.col("node_a") < F.col("node_b"))) | (~F.col("whole") & (F.col("bit_a") < F.col("bit_b")))
    pairs = a.join(b.withColumnRenamed("key", "key_b"), (F.col("key") == F.col("key_b")) & apart & meet)
    pairs = pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    bits, p = segments * width, (1 - similarity) / 2
    most = ceil(bits * p + 4 * sqrt(bits * p * (1 - p)))  # four deviations beyond what the similarity makes differ
    part = lambda c: classes.select(F.col("node").alias(c), F.col("segs").alias(f"segs_{c}"), F.col("size").alias(f"size_{c}"))
    differ = F.aggregate(F.zip_with("segs_a", "segs_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    likely = pairs.join(part("a"), "a").join(part("b"), "b").where((differ <= most) & (F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b")))
    likely = staged(likely.select("a", "b"), "similar-pairs")

    # only candidates' texts are read again
    wanted = likely.select(F.col("a").alias("node")).union(likely.select("b")).union(bundles.select("node")).distinct()
    sets = staged(rows.select(F.col(row).alias("node"), text).join(wanted, "node", "left_semi").select("node", sets_of(F.col(text), shingle).alias("set")), "similar-sets")
    of = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    links = likely.join(of("a"), "a").join(of("b"), "b").where(common >= similarity * (F.size("set_a") + F.size("set_b") - common) - 1e-6).select("a", "b")

    member = bundles.join(sets, "node")
    blocks = member.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.size("set")).alias("shingles"))
    blocks = blocks.select("root", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("shingles") / block_shingles)).cast("int").alias("blocks"))
    member = member.join(blocks, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    member = member.select("root", "node", "set", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = member.groupBy("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    links = links.union(dealt.applyInPandas(block_links(similarity), "a long, b long"))

    roots = components(staged(links.distinct(), "similar-links"))
    groups = classes.select("digest", "node").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("group"))
    return told.select("row", "digest").join(groups, "digest").select(F.col("row").alias(row), "group")


def _with_roots(parts: DataFrame) -> DataFrame:
    """Components with a row for each root itself."""
    return parts.unionByName(parts.select(F.col("root").alias("node"), "root").distinct())


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
