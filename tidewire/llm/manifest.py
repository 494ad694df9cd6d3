"""Merkle manifest of a dataset, with leaf coordinates from bitmap ranks.

Each row is a leaf. The leaves of a source stand by doc_id, but nothing is sorted for it: the ids of a source are bits of 64-bit
words, which tasks merge by OR (words without ids are not kept), and a directory counts the rows before each word: within its
block of 1,024 words, within the block's 65,536 and so on, four levels to the whole range of ids. The rank of an id is the sum of
these counts and the popcount of the lower bits of its word; it is the leaf's slot. Ids that several rows share are ranked within
by the first 56 bits of their leaves, and rows of equal leaves by a row number, through the same words.

A level of the tree groups nodes by (source, slot div 16) into slot arrays and hashes each; levels shrink by 16, and a source is
done when one node is left. The sources' roots, in the order of the sources, form the upper tree in the same way. Proofs come
down: a run hands its path to its members, so that leaves meet their paths in groups of 16.

Defined results: a null source is a group of its own and the first; a null doc_id stands first in its source and is never tampered
with; repeated rows are leaves of their own (equal ones in any order, since their leaves are equal); a null field is ``-``, an empty
text ``0:``; texts are hashed whole, however long. An empty table gives an empty table. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.common import ascii_lower, crc32_sql, staged, table

FAN = 16


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def ranks(rows: DataFrame, parent: list[str], value: str) -> DataFrame:
    """The rows with ``rank``, how many rows of the parent have a smaller value, and ``same``, how many have this one."""
    rows = rows.withColumns({"_word": F.shiftright(value, 6), "_bit": F.col(value).bitwiseAND(F.lit(63)).cast("int")})
    own = [*parent, "_word"]
    words = rows.groupBy(*own).agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("bits"), F.count("*").alias("n"))
    words = staged(words, "rank-words")

    levels, at = [], words.select(*parent, F.col("_word").alias("at"), "n")
    for up in (F.shiftright("at", 10), F.shiftright("at", 16), F.shiftright("at", 16), F.lit(0).cast("long")):
        at = at.withColumn("up", up)
        before = F.sum("n").over(Window.partitionBy(*parent, "up").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
        levels.append(at.withColumn("before", F.coalesce(before, F.lit(0))).drop("n"))
        at = at.groupBy(*parent, F.col("up").alias("at")).agg(F.sum("n").alias("n"))
    base = levels.pop()
    while levels:
        above = base.select(*parent, F.col("at").alias("up"), F.col("before").alias("more"))
        base = levels.pop().join(above, [*parent, "up"]).withColumn("before", F.col("before") + F.col("more")).drop("more")
    words = words.join(base.select(*parent, F.col("at").alias("_word"), "before"), own)

    crowded = words.where(F.col("n") > F.bit_count("bits")).select(*own)
    often = rows.join(crowded, own, "left_semi").groupBy(*own, "_bit").agg(F.count("*").alias("c")).where("c > 1")
    often = often.groupBy(*own).agg(F.collect_list(F.struct("_bit", "c")).alias("often"))  # at most 64
    told = rows.join(words.join(often, own, "left"), own)
    lower = F.expr("bit_count(bits & ~shiftleft(-1L, _bit))")
    copies = F.expr("coalesce(aggregate(often, 0L, (t, x) -> t + IF(x._bit < _bit, x.c - 1, 0L)), 0L)")
    same = F.expr("coalesce(get(filter(often, x -> x._bit = _bit), 0).c, 1L)")
    return told.withColumns({"rank": F.col("before") + lower + copies, "same": same}).drop("_word", "_bit", "bits", "n", "before", "often")


def with_slots(rows: DataFrame, parent: list[str], values: list[str]) -> DataFrame:
    """The rows with ``slot``, their rank by the values in turn; only ties go on to the next value."""
    out = staged(ranks(rows, parent, values[0]).withColumn("slot", F.col("slot") + F.col("rank")), "rank-rows")
    tied = out.where("same > 1").drop("rank", "same")
    if len(values) == 1 or tied.isEmpty():
        return out.drop("rank", "same")
    return out.where("same = 1").drop("rank", "same").unionByName(with_slots(tied, [*parent, values[0]], values[1:]))


def height(n: Column) -> Column:
    """Levels above the leaves, the subroot's counted in."""
    return sum((n > FAN**k).cast("int") for k in range(15))


def numbered(keys: DataFrame, key: str, part: int = 10_000) -> DataFrame:
    """The rows, one for each key, with ``i``, the key's place in byte order."""
    parts = 1 + keys.count() // part
    laid = staged(keys.repartitionByRange(parts, key).withColumn("p", F.spark_partition_id()), "manifest-order")
    first = laid.groupBy("p").agg(F.count("*").alias("n")).withColumn("first", F.sum("n").over(Window.orderBy("p")) - F.col("n"))  # a row for each part
    place = F.row_number().over(Window.partitionBy("p").orderBy(key)) - 1
    return laid.withColumn("at", place).join(first.select("p", "first"), "p").withColumn("i", F.col("at") + F.col("first")).drop("p", "at", "first")


def merged(runs: DataFrame) -> DataFrame:
    """(g, i, h, hash): the node of each run."""
    return runs.select("g", "i", "h", digest(F.array_join(F.transform("items", lambda x: x["hash"]), "")).alias("hash"))


def grow(runs: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """From the runs of the leaves (g, i, h, items) all levels of runs, and each group's last node (g, hash)."""
    levels, most = [runs], runs.agg(F.max("h")).head()[0] or 0
    ends = runs.where("h = 0").select("g", F.get("items", F.lit(0))["hash"].alias("hash"))
    for level in range(1, most + 1):
        nodes = merged(levels[-1].where(f"h >= {level}"))
        if level == most:
            nodes = staged(nodes, "manifest-nodes")
        ends = ends.unionByName(nodes.where(f"h = {level}").select("g", "hash"))
        if level < most:
            runs = nodes.where(f"h > {level}").groupBy("g", F.shiftright("i", 4).alias("i")).agg(F.first("h").alias("h"), F.array_sort(F.collect_list(F.struct(F.col("i").alias("slot"), "hash"))).alias("items"))
            levels.append(staged(runs, "manifest-runs"))
    return levels, ends


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """tops: g, h, path, subroot. (g, i, items, path, subroot): the runs of the leaves, with the path from the run's node to the root."""
    cur = None
    for level in reversed(range(len(levels))):
        above = tops.where(f"h = {level + 1}" if level else "h <= 1").select("g", F.lit(0).cast("long").alias("i"), "path", "subroot")
        if cur is not None:
            step = F.struct(F.col("pos"), F.transform("items", lambda x: x["hash"]).alias("hashes"))
            members = cur.select("g", "items", "path", "subroot", F.posexplode("items").alias("pos", "x"))
            above = above.unionByName(members.select("g", F.col("x.slot").alias("i"), F.concat(F.array(step), "path").alias("path"), "subroot"))
        cur = levels[level].join(above, ["g", "i"])
    return cur


PATH = "array<struct<pos: int, hashes: array<string>>>"
LEFT, RIGHT = "array_join(slice(x.hashes, 1, x.pos), '')", "array_join(slice(x.hashes, x.pos + 2, 16), '')"


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text: str = "text") -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) for each row; every fifth id (by crc32) with its text in lower case."""
    c = F.col
    leaf = digest(*[field(c(f)) for f in fields])
    altered = digest(*[field(ascii_lower(c(f)) if f == text else c(f)) for f in fields])
    tampered = F.coalesce(F.crc32(c(key).cast("string")) % 5 == 0, F.lit(False))
    g = F.coalesce(F.concat(F.lit("="), c(group).cast("string")), F.lit(""))
    rows = docs.select(c(key).alias("id"), g.alias("g"), leaf.alias("hash"), F.when(tampered, altered).alias("altered"))
    least = F.lit(-(2**63)).cast("long")
    by_leaf = F.conv(F.substring("hash", 1, 14), 16, 10).cast("long") - F.when(c("id").isNull(), 1 << 60).otherwise(0)  # null before the least id
    values = {"value": F.coalesce(c("id").cast("long"), least), "by_leaf": by_leaf, "row": F.monotonically_increasing_id(), "slot": F.lit(0).cast("long")}
    rows = staged(rows.withColumns(values), "manifest-leaves")
    rows = with_slots(rows, ["g"], ["value", "by_leaf", "row"]).select("g", "slot", "id", "hash", "altered")

    sizes = rows.groupBy("g").agg(height(F.count("*")).alias("h"))
    runs = rows.groupBy("g", F.shiftright("slot", 4).alias("i")).agg(F.array_sort(F.collect_list(F.struct("slot", "hash", "id", "altered"))).alias("items"))
    levels, ends = grow(staged(runs.join(sizes, "g"), "manifest-runs"))

    subroots = staged(numbered(ends.join(sizes, "g"), "g"), "manifest-subroots")
    upper = subroots.groupBy(F.lit("").alias("g"), F.shiftright("i", 4).alias("i")).agg(F.lit(0).alias("h"), F.array_sort(F.collect_list(F.struct(F.col("i").alias("slot"), "hash", F.col("g").alias("of"), F.col("h").alias("of_h")))).alias("items"))
    tall = F.lit(subroots.select(height(F.count("*"))).head()[0])
    above, root = grow(staged(upper.withColumn("h", tall), "manifest-upper"))
    whole = root.head()
    start = upper.sparkSession.range(1).select(F.lit("").alias("g"), tall.alias("h"), F.array().cast(PATH).alias("path"), F.lit("").alias("subroot"))
    tops = descend(above, start).select("items", "path", F.posexplode("items").alias("pos", "x"))
    step = F.when(tall > 0, F.array(F.struct("pos", F.transform("items", lambda x: x["hash"]).alias("hashes")))).otherwise(F.array().cast(PATH))
    tops = staged(tops.select(c("x.of").alias("g"), c("x.of_h").alias("h"), F.concat(step, "path").alias("path"), c("x.hash").alias("subroot")), "manifest-tops")

    leaves = descend(levels, tops).select("items", "path", "subroot", "h", F.posexplode("items").alias("pos", "x"))
    step = F.when(c("h") > 0, F.array(F.struct("pos", F.transform("items", lambda x: x["hash"]).alias("hashes")))).otherwise(F.array().cast(PATH))
    leaves = leaves.select("x", "subroot", F.lit(whole["hash"] if whole else None).cast("string").alias("root"), F.concat(step, "path").alias("path"))
    proof = F.expr(f"sha2(array_join(transform(path, x -> concat({LEFT}, {RIGHT})), ''), 256)")
    folded = F.expr(f"aggregate(path, coalesce(x.altered, x.hash), (node, x) -> sha2(concat({LEFT}, node, {RIGHT}), 256))")
    out = leaves.select(c("x.id").alias(key), c("x.hash").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", c("folded_root") == c("root"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def oracle_sql() -> dict[str, str]:
    field = lambda x: f"coalesce(concat(strlen({x}::VARCHAR), ':', {x}::VARCHAR), '-')"  # noqa: E731  bytes, not code points
    leaf = lambda text: "sha256(concat(" + ", ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + "))"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    grow = lambda name, leaves: f"""{name}(level, g, i, n, h) AS ({leaves} UNION ALL
  SELECT level + 1, g, i // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY level, g, i // 16)"""  # noqa: E731
    sql = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf("text")} AS leaf, CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 5 = 0 THEN {leaf(low)} ELSE {leaf("text")} END AS own FROM documents),
p AS MATERIALIZED (SELECT row_number() OVER () AS r, *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot, count(*) OVER (PARTITION BY g) AS n FROM d),
{grow("lower_", "SELECT 0, g, slot, n, leaf FROM p")},
subs AS MATERIALIZED (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS slot, count(*) OVER () AS n FROM lower_ WHERE n = 1),
{grow("upper_", "SELECT 0, '', slot, n, h FROM subs")},
steps AS MATERIALIZED (SELECT p.r, 100 * 0 + l.level AS step, string_agg(l.h, '' ORDER BY l.i) FILTER (l.i < p.slot // power(16, l.level)::BIGINT) AS lo, string_agg(l.h, '' ORDER BY l.i) FILTER (l.i > p.slot // power(16, l.level)::BIGINT) AS hi
  FROM p JOIN lower_ l ON l.g = p.g AND l.n > 1 AND l.i // 16 = p.slot // power(16, l.level + 1)::BIGINT GROUP BY 1, 2
  UNION ALL SELECT p.r, 100 + l.level, string_agg(l.h, '' ORDER BY l.i) FILTER (l.i < s.slot // power(16, l.level)::BIGINT), string_agg(l.h, '' ORDER BY l.i) FILTER (l.i > s.slot // power(16, l.level)::BIGINT)
  FROM p JOIN subs s ON s.g = p.g JOIN upper_ l ON l.n > 1 AND l.i // 16 = s.slot // power(16, l.level + 1)::BIGINT GROUP BY 1, 2),
placed AS MATERIALIZED (SELECT r, row_number() OVER (PARTITION BY r ORDER BY step) AS k, coalesce(lo, '') AS lo, coalesce(hi, '') AS hi FROM steps),
fold(r, k, node) AS (SELECT r, 0, own FROM p UNION ALL SELECT f.r, f.k + 1, sha256(concat(s.lo, f.node, s.hi)) FROM fold f JOIN placed s ON s.r = f.r AND s.k = f.k + 1),
ends AS (SELECT r, arg_max(node, k) AS folded FROM fold GROUP BY 1), proofs AS (SELECT r, sha256(string_agg(concat(lo, hi), '' ORDER BY k)) AS proof FROM placed GROUP BY 1), root AS (SELECT h FROM upper_ WHERE n = 1)
SELECT p.doc_id, p.leaf, subs.h AS subroot, root.h AS root, coalesce(proofs.proof, sha256('')) AS proof_sha256, ends.folded AS folded_root, ends.folded = root.h AS verified
FROM p JOIN subs USING (g) JOIN ends USING (r) LEFT JOIN proofs USING (r), root"""
    return {"op12_manifest": sql}
