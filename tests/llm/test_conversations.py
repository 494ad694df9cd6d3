"""Conversation repair against a search that keeps every cheapest way."""

import random
import re
import zlib
from hashlib import sha256
from itertools import product

import pytest

from tidewire.llm.conversations import op13_conversation_repair, repair, repaired

WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        spaced = lambda x: " " if x is None else str(x)
        code = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = "user" if code == 4 else spaced(role), spaced(text)
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def cheapest(rows, every=True):
    """(cost, audit, lines): all ways of equal cost are kept for each last initial, with up to two inserts in a gap.

    every = False keeps the least audit of each last initial after each row, for conversations with very many ways."""

    def best(ways):
        out = {}
        for last, own in ways.items():
            least = min(c for c, _, _ in own)
            out[last] = {w for w in own if w[0] == least}
        return out

    def inserts(ways):
        out = {k: set(v) for k, v in ways.items()}
        now = ways
        for _ in range(2):
            then = {}
            for last, own in now.items():
                to = "a" if last == "u" else "u"
                then.setdefault(to, set()).update((c + 3, audit + "I", (*lines, "assistant:" if to == "a" else "user:")) for c, audit, lines in own)
            for k, v in then.items():
                out.setdefault(k, set()).update(v)
            now = then
        return best(out)

    ways = {"": {(0, "", ())}}
    for role, text, fault in rows:
        then = {}
        for last, own in inserts(ways).items():
            for c, audit, lines in own:
                then.setdefault(last, set()).add((c + 4, audit + "D", lines))
                if fault in ("blank", "duplicate"):
                    continue
                more, to = 3 * (fault == "truncated"), "a" if last == "u" else "u"
                if role[:1] in ("u", "a") and role[:1] == to or role[:1] == "s" and last == "":
                    then.setdefault(role[:1], set()).add((c + more, audit + "K", (*lines, f"{role}:{text}")))
                then.setdefault(to, set()).add((c + 3 + more, audit + "R", (*lines, ("assistant:" if to == "a" else "user:") + text)))
        ways = best(then)
        if not every:
            ways = {last: {min(own)} for last, own in ways.items()}
    ways = inserts(ways)
    return min(w for last in ("", "a") for w in ways.get(last, ()))


def expected(rows, damaged=True, every=True):
    groups, out = {}, []
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for conv, own in groups.items():
        own = damage(own) if damaged else [tuple(" " if x is None and n else x for n, x in enumerate(r[1:])) for r in own]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, told = set(), []
        for _, role, text in own:
            bare = text.strip(WHITE)
            told.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None))
            seen.add((role, text))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        cost, audit, lines = cheapest(told, every)
        out.append((conv, gaps, *[sum(t[2] == f for t in told) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def talks():
    rng, rows = random.Random(2), {}
    for conv in [None, *range(400)]:
        for t in range(rng.choice([1, 2, 3, 5, 8, 12])):
            turn = rng.choice([t] * 9 + [None]) if rng.random() < 0.9 else t + rng.randrange(3) * 5
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            rows[conv, turn] = (conv, turn, role, rng.choice([f"Text {t}.", "Same.", "no end", " ", None, "Q? \n", f"a{t}!"]))
    return list(rows.values())


@pytest.mark.parametrize("more", [{}, {"rows_of_part": 5, "least_rows": 2}])
def test_equals_search(spark, talks, more):
    """Conversations within a partition, and in stretches over several."""
    df = spark.createDataFrame([(*r, 1) for r in talks], "conv_id long, turn long, role string, text string, cost int").repartition(6)
    assert got(repaired(df, **more)) == expected(talks)


def test_all_short_shapes():
    """Every sequence of up to four kinds of row."""
    kinds = {"s": ("system", "A."), "u": ("user", "B."), "a": ("assistant", "C."), "x": ("tool", "D."), "U": ("user", "E"), "A": ("assistant", "F"), "S": ("system", "G"), "-": ("user", "")}
    shapes = ["".join(s) for n in range(5) for s in product(kinds, repeat=n)]
    for shape in shapes:
        rows = [(kinds[k][0], kinds[k][1], "blank" if k == "-" else "truncated" if k.isupper() else None) for k in shape]
        assert repair(shape) == cheapest(rows)[:2], shape


def test_long_conversation_over_partitions(spark):
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["x", f"Line {t}."])) for t in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(repaired(df, rows_of_part=30, least_rows=10)) == got(repaired(df)) == expected(rows, every=False)


def test_ties_repeats_and_empty_tables(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, None, None, None), (3, 1, "user", "Ho."), (3, 1, "assistant", "Hm.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(repaired(df, damage=False)) == expected(rows, damaged=False)
    assert repaired(df.limit(0)).count() == 0


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = got(op13_conversation_repair(spark, sf))
    assert out == expected(rows) and any(r[6] for r in out)
