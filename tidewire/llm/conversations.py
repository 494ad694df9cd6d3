"""Repair of conversations' structure, by Hirschberg's divide and conquer over four states.

What has been put out so far is in one of four states: nothing, a system turn alone, ends with a user turn, ends with an
assistant turn. An edit of a row (with inserts before it) leads from state to state at a cost, so a stretch of rows is a table of
16 least costs. A stretch is cut in the middle: cost vectors run forward from its begin and backward from its end, the states in
which they meet at least cost are the crossings, both halves are solved for these alone, and of equal crossings that with the
ASCII-least edits stays. No table of a whole conversation by states is kept: memory is linear in the rows.

Rows are dealt by ranges of (conversation, turn), so a conversation may lie in many partitions, whatever its length. A partition
solves the stretches at its two ends for all 16 pairs of states and gives their costs and the order of their edits; these few
numbers of a conversation's stretches then meet and are solved from the last to the first in the same way. Edits of stretches over
the same rows are never prefixes of each other (each ends with its last row's edit), so comparing stretch by stretch is exact.
Faults that need a view of the whole conversation (a row seen earlier) come from one aggregation by content. The digest of a
repaired conversation is one SHA-256 over its bytes, which is sequential by its nature: one task streams each conversation
in batches, without holding it.

Defined results: null role or text is one space, and so is a null conv_id or turn in the damage's key; rows of null conv_id are one
conversation; null turns stand first; rows of one turn stand by role and a hash of their text, so repeated rows are adjacent and
all but the first are duplicates. Roles other than those that begin with s, u, a (in lower case) can only be deleted or get
another role. A conversation without rows after the damage has zeros, an empty audit and the hash of nothing. An empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import crc32_sql, frame, staged, table

NONE, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
PAIRS = [(s, t) for s in STATES for t in STATES]
SPOKEN = {NONE: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}  # who speaks next
DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
FAR = 1 << 60


def row_edits(kind: str) -> dict[tuple[int, int], tuple[int, str]]:
    """For each pair of states the least cost and the least edits of one row, inserts before it included.

    kind: the role's initial (x: another), in upper case if the row is truncated, - if it must go."""
    out: dict[tuple[int, int], tuple[int, str]] = {}
    for start in STATES:
        at = start
        for inserts in range(3):
            paid, done = INSERT * inserts, "I" * inserts
            edits = [(at, DELETE, "D")]
            if kind[0] != "-":
                cut = CUT * kind.isupper()
                edits.append((SPOKEN[at], REROLE + cut, "R"))
                keeps = {"s": at == NONE, "u": at != USER, "a": at == USER}
                if keeps.get(kind.lower(), False):
                    edits.append(({"s": SYSTEM, "u": USER, "a": ASSISTANT}[kind.lower()], cut, "K"))
            for end, cost, letter in edits:
                out[start, end] = min(out.get((start, end), (FAR, "")), (paid + cost, done + letter))
            at = SPOKEN[at]
    return out


EDITS = {kind: row_edits(kind) for kind in "suaxSUAX-"}
INTO = {kind: [[(s, e[s, t][0]) for s in STATES if (s, t) in e] for t in STATES] for kind, e in EDITS.items()}
OUT_OF = {kind: [[(t, e[s, t][0]) for t in STATES if (s, t) in e] for s in STATES] for kind, e in EDITS.items()}
LAST = {NONE: (0, ""), ASSISTANT: (0, ""), USER: (INSERT, "I"), SYSTEM: (2 * INSERT, "II")}  # to a legal end


def forward(kinds: str, start: int) -> list[int]:
    v = [FAR] * 4
    v[start] = 0
    for k in kinds:
        v = [min([v[s] + c for s, c in into], default=FAR) for into in INTO[k]]
    return v


def backward(kinds: str, end: int) -> list[int]:
    v = [FAR] * 4
    v[end] = 0
    for k in reversed(kinds):
        v = [min([v[t] + c for t, c in out], default=FAR) for out in OUT_OF[k]]
    return v


def solve(kinds: str, pairs: set[tuple[int, int]]) -> dict[tuple[int, int], tuple[int, str]]:
    """For each wanted pair of states that can be reached: the least cost of the rows and the ASCII-least edits of that cost."""
    if len(kinds) == 1:
        return {p: EDITS[kinds][p] for p in pairs if p in EDITS[kinds]}
    first, second = kinds[: len(kinds) // 2], kinds[len(kinds) // 2 :]
    ahead = {s: forward(first, s) for s in {s for s, _ in pairs}}
    behind = {t: backward(second, t) for t in {t for _, t in pairs}}
    cross = {}
    for s, t in pairs:
        costs = [a + b for a, b in zip(ahead[s], behind[t])]
        if min(costs) < FAR:
            cross[s, t] = [x for x in STATES if costs[x] == min(costs)]
    left = solve(first, {(s, x) for (s, _), xs in cross.items() for x in xs})
    right = solve(second, {(x, t) for (_, t), xs in cross.items() for x in xs})
    out = {}
    for (s, t), xs in cross.items():
        edits = min(left[s, x][1] + right[x, t][1] for x in xs)
        out[s, t] = (left[s, xs[0]][0] + right[xs[0], t][0], edits)
    return out


def ended(ways: dict[tuple[int, int], tuple[int, str]]) -> tuple[int, str]:
    """The cheapest way from the begin to a legal end."""
    return min((cost + LAST[t][0], edits + LAST[t][1]) for (s, t), (cost, edits) in ways.items() if s == NONE)


@lru_cache(maxsize=1 << 16)
def short(kinds: str) -> tuple[int, str]:
    return ended(solve(kinds, {(NONE, t) for t in STATES}))


def repair(kinds: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    if not kinds:
        return 0, ""
    return short(kinds) if len(kinds) <= 64 else ended(solve(kinds, {(NONE, t) for t in STATES}))


LEGAL = {"su", "ua", "au"}
STRETCH = "k string, part int, whole boolean, rows array<long>, first string, last string, illegal long, cost long, costs array<long>, order array<int>, audits array<string>"


def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows (k, row, kind, initial) of a partition in; a row for each conversation in it, solved if it lies within."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()

    def told(k: str, rows: np.ndarray, kinds: str, initials: str, whole: bool) -> tuple:
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        cost, costs, order = 0, None, None
        if whole:
            cost, audit = repair(kinds)
            audits = [audit]
        else:
            ways = solve(kinds, set(PAIRS))
            costs, audits = [ways.get(p, (FAR, ""))[0] for p in PAIRS], [ways.get(p, (FAR, ""))[1] for p in PAIRS]
            place = {a: n for n, a in enumerate(sorted(set(audits)))}
            order = [place[a] for a in audits]
        return k, part, whole, rows, initials[0], initials[-1], illegal, cost, costs, order, audits

    held: tuple[str, list[np.ndarray], list[str], list[str]] | None = None
    edge = True  # the partition's first conversation may have begun before
    for pdf in batches:
        out = []
        k = pdf["k"].to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1), len(k)] if len(k) else []
        rows, kinds, initials = pdf["row"].to_numpy(), "".join(pdf["kind"]), "".join(pdf["initial"])
        for a, b in zip(cuts, cuts[1:]):
            if held and held[0] != k[a]:
                out.append(told(held[0], np.concatenate(held[1]), "".join(held[2]), "".join(held[3]), not edge))
                held, edge = None, False
            held = held or (k[a], [], [], [])
            for to, x in zip(held[1:], (rows[a:b], kinds[a:b], initials[a:b])):
                to.append(x)
        if out:
            yield frame(out, STRETCH)
    if held:
        yield frame([told(held[0], np.concatenate(held[1]), "".join(held[2]), "".join(held[3]), False)], STRETCH)


CHOSEN = "k string, part int, at int, tail string, illegal long, cost long"


def join_stretches(pdf: pd.DataFrame) -> pd.DataFrame:
    """The stretches of one conversation (costs, and the order of the edits for each pair of states): which pair each takes."""
    pdf = pdf.sort_values("part")
    best = {t: (cost, (len(tail),)) for t, (cost, tail) in LAST.items()}  # from a state to the end: cost, and a key in the order of the edits
    choices = []
    for costs, order in zip(pdf["costs"].iloc[::-1], pdf["order"].iloc[::-1]):
        now, chosen = {}, {}
        for n, (s, t) in enumerate(PAIRS):
            if costs[n] < FAR and t in best:
                way = (costs[n] + best[t][0], (order[n], *best[t][1]))
                if s not in now or way < now[s]:
                    now[s], chosen[s] = way, t
        ranked = sorted({key for _, key in now.values()})  # the keys stay short: their order is all that counts
        best = {s: (cost, (ranked.index(key),)) for s, (cost, key) in now.items()}
        choices.append(chosen)
    at, out = NONE, []
    illegal = int(pdf["illegal"].sum()) + sum(a + b not in LEGAL for a, b in zip(pdf["last"], pdf["first"].iloc[1:]))
    for n, (k, part, chosen) in enumerate(zip(pdf["k"], pdf["part"], reversed(choices))):
        to = chosen[at]
        final = n == len(pdf) - 1
        out.append((k, part, 4 * at + to, LAST[to][1] if final else "", illegal if final else 0, best[NONE][0] if final else 0))
        at = to
    return frame(out, CHOSEN)


NAMES = {USER: b"user:", ASSISTANT: b"assistant:"}


def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (k, edits, role, text) in order; the SHA-256 of each repaired conversation, held as its state alone."""
    from hashlib import sha256

    k, state, sha, lines = None, NONE, sha256(), 0

    def put(line: bytes) -> None:
        nonlocal lines
        sha.update(b"\n" + line if lines else line)
        lines += 1

    def end() -> tuple[str, str]:
        nonlocal state
        for _ in LAST[state][1]:
            state = SPOKEN[state]
            put(NAMES[state])
        return k, sha.hexdigest()

    for pdf in batches:
        out = []
        for name, edits, role, text in zip(pdf["k"], pdf["edits"], pdf["role"], pdf["text"]):
            if name != k:
                if k is not None:
                    out.append(end())
                k, state, sha, lines = name, NONE, sha256(), 0
            for letter in edits:
                if letter == "K":
                    state = SYSTEM if role[0] == "s" else SPOKEN[state]
                    put(f"{role}:{text}".encode())
                elif letter != "D":
                    state = SPOKEN[state]
                    put(NAMES[state] + (text.encode() if letter == "R" else b""))
        if out:
            yield frame(out, "k string, repaired_sha256 string")
    if k is not None:
        yield frame([end()], "k string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """rows: k, conv_id, turn, role, text. With the faults that crc32 of ``conv_id:turn`` plants."""
    c, spaced = F.col, lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    rows = rows.select("k", "turn", spaced("role").alias("role"), spaced("text").alias("text"), code.cast("int").alias("code")).where("code <> 0")
    text = F.when(c("code") == 1, "").when(c("code") == 2, F.translate("text", ".!?", "")).otherwise(c("text"))
    rows = rows.select("k", "turn", F.when(c("code") == 4, "user").otherwise(c("role")).alias("role"), text.alias("text"), F.explode(F.when(c("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows


def repaired(conversations: DataFrame, *, damage: bool = True, rows_of_part: int = 200_000, least_rows: int = 4096) -> DataFrame:
    """conversations: conv_id, turn, role, text. (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)
    for each conv_id; ``damage`` False repairs the rows as they are."""
    c, spark = F.col, conversations.sparkSession
    key = F.coalesce(F.concat(F.lit("="), c("conv_id").cast("string")), F.lit(""))
    given = conversations.select(key.alias("k"), "conv_id", "turn", "role", "text")
    rows = damaged(given) if damage else given.select("k", "turn", *[F.coalesce(c(x), F.lit(" ")).alias(x) for x in ("role", "text")])
    bare = F.rtrim(c("text"), F.lit(BLANKS))
    fault = F.when(bare == "", "blank").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    rows = rows.select("k", "turn", "role", "text", fault.alias("fault"), F.md5("text").alias("digest"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    rows = staged(rows, "turns")

    same = ["k", "role", "digest"]
    place = F.struct(c("turn").isNotNull().alias("known"), "turn", "row")  # nulls first
    seen = rows.groupBy(*same).agg(F.count("*").alias("n"), F.min(place).alias("least")).where("n > 1").drop("n")
    flat = rows.drop("text").join(seen, same, "left")
    again = c("least").isNotNull() & (c("fault").isNull() | (c("fault") != "blank")) & (c("least.row") != c("row"))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    fault = F.when(again, "duplicate").otherwise(c("fault"))
    kind = F.when(fault.isin("blank", "duplicate"), "-").when(fault == "truncated", F.upper(initial)).otherwise(initial)
    flat = staged(flat.select("k", "turn", "role", "h", "row", fault.alias("fault"), initial.alias("initial"), kind.alias("kind")), "turn-kinds")

    count = flat.count()
    parts = max(1, count // rows_of_part, min(count // least_rows, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    order = [c("k"), c("turn").asc_nulls_first(), c("role"), c("h"), c("row")]
    sorted_rows = flat.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("k", "row", "kind", "initial")
    pieces = staged(sorted_rows.mapInPandas(stretches, STRETCH), "turn-stretches")

    ends = pieces.where("NOT whole").select("k", "part", "first", "last", "illegal", "costs", "order")
    chosen = staged(ends.groupBy("k").applyInPandas(join_stretches, CHOSEN), "turn-choices")
    cut = pieces.where("NOT whole").drop("illegal", "cost").join(chosen, ["k", "part"]).select("k", "part", "rows", F.get("audits", c("at")).alias("edits"), "tail", "illegal", "cost")
    edits = pieces.where("whole").select("k", "part", "rows", F.get("audits", F.lit(0)).alias("edits"), F.lit("").alias("tail"), "illegal", "cost")
    edits = staged(edits.unionByName(cut), "turn-edits")
    found = edits.groupBy("k").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", F.concat("edits", "tail").alias("e")))), lambda x: x["e"]), "").alias("audit"))

    each = edits.select("k", "part", "rows", F.regexp_extract_all("edits", F.lit("I*[DKR]"), F.lit(0)).alias("e"))
    each = each.select("k", "part", F.posexplode(F.arrays_zip("rows", "e")).alias("pos", "x")).select("k", "part", "pos", c("x.rows").alias("row"), c("x.e").alias("edits"))
    gone = c("edits").endswith("D")
    lines = each.join(rows.select("row", "role", "text"), "row").select("k", "part", "pos", "edits", F.when(~gone, c("role")).alias("role"), F.when(~gone, c("text")).alias("text"))
    shas = lines.repartition("k").sortWithinPartitions("k", "part", "pos").select("k", "edits", "role", "text").mapInPandas(digests, "k string, repaired_sha256 string")

    faults = [F.count_if(c("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")]
    told = flat.groupBy("k").agg(*faults, F.min("turn").alias("low"), F.max("turn").alias("high"))
    turns = flat.where("turn IS NOT NULL").select("k", "turn").distinct().groupBy("k").agg(F.count("*").alias("turns"))
    told = told.join(turns, "k", "left").join(found, "k").join(shas, "k")
    out = given.select("k", "conv_id").distinct().join(told, "k", "left")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return out.select("conv_id", zero(c("high") - c("low") + 1 - c("turns")).alias("gaps"), *[zero(c(x)).alias(x) for x in ("blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))


def oracle_sql() -> dict[str, str]:
    """The plain pass over each conversation: for each state the cheapest, then least edits so far, row after row."""
    names = {USER: "user", ASSISTANT: "assistant"}
    moves = []
    for kind, edits in EDITS.items():
        for (s, t), (cost, piece) in edits.items():
            state, lines = s, ""
            for _ in range(piece.count("I")):
                state = SPOKEN[state]
                lines += f"{names[state]}:|"
            moves.append(f"('{kind}', {s}, {t}, {cost}, '{piece}', '{lines}', '{names[SPOKEN[state]]}')")
    bare = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    spaced = lambda x: f"coalesce({x}::VARCHAR, ' ')"
    code = crc32_sql("k")
    sql = f"""WITH RECURSIVE moves(kind, s, t, cost, piece, ins, speaker) AS (VALUES {", ".join(moves)}),
g AS (SELECT conv_id, turn, {spaced("role")} AS role, {spaced("text")} AS text, concat({spaced("conv_id")}, ':', {spaced("turn")}) AS k FROM conversations),
c AS MATERIALIZED (SELECT *, {code} % 20 AS code FROM g),
d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE code <> 0),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM d),
f AS MATERIALIZED (SELECT *, CASE WHEN {bare} = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN right({bare}, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'x' END AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS prior FROM n),
w(conv_id, pos, state, best) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}} FROM f UNION ALL
  SELECT w.conv_id, w.pos + 1, m.t, min({{'cost': w.best.cost + m.cost, 'audit': w.best.audit || m.piece, 'lines': list_concat(list_concat(w.best.lines, list_filter(string_split(m.ins, '|'), lambda x: x <> '')), CASE right(m.piece, 1) WHEN 'K' THEN [concat(f.role, ':', f.text)] WHEN 'R' THEN [concat(m.speaker, ':', f.text)] ELSE []::VARCHAR[] END)}})
  FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1 JOIN moves m ON m.s = w.state AND m.kind = CASE WHEN f.fault IN ('blank', 'duplicate') THEN '-' WHEN f.fault = 'truncated' THEN upper(f.initial) ELSE f.initial END GROUP BY 1, 2, 3),
t AS (SELECT conv_id, turn IS NULL AS no_turn, turn, count(*) FILTER (fault = 'blank') OVER x AS blank, count(*) FILTER (fault = 'duplicate') OVER x AS duplicate, count(*) FILTER (fault = 'truncated') OVER x AS truncated, count(*) FILTER (prior IS NOT NULL AND concat(prior, substr(role, 1, 1)) NOT IN ('su', 'ua', 'au')) OVER x AS illegal, count(*) OVER x AS len FROM f WINDOW x AS (PARTITION BY conv_id)),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, any_value(blank) AS blank, any_value(duplicate) AS duplicate, any_value(truncated) AS truncated, any_value(illegal) AS illegal, any_value(len) AS len FROM t GROUP BY 1),
e AS (SELECT w.conv_id, min({{'cost': w.best.cost + CASE w.state WHEN 2 THEN 3 WHEN 1 THEN 6 ELSE 0 END, 'audit': w.best.audit || CASE w.state WHEN 2 THEN 'I' WHEN 1 THEN 'II' ELSE '' END, 'lines': list_concat(w.best.lines, CASE w.state WHEN 2 THEN ['assistant:'] WHEN 1 THEN ['user:', 'assistant:'] ELSE []::VARCHAR[] END)}}) AS best
  FROM w JOIN told ON told.conv_id IS NOT DISTINCT FROM w.conv_id AND told.len = w.pos GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.best.cost, 0)::BIGINT AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(array_to_string(e.best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""
    return {"op13_conversation_repair": sql}
