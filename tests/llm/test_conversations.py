import hashlib
import itertools
import random
import re
import zlib

import pytest
from helpers import SF
from pyspark.sql import functions as F

from tickloom.llm import conversations as conv
from tickloom.llm import queries

SPACE = " \t\n\x0b\x0c\r"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        k = zlib.crc32(":".join(" " if v is None else str(v) for v in (c, t)).encode()) % 20
        if k:
            x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
            out += [(c, t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    return out


def faults(rows):
    out, seen = [], set()
    for _, _, r, x in rows:
        out.append("blank" if not x.strip(SPACE) else "duplicate" if (r, x) in seen else "" if x.strip(SPACE)[-1] in ".!?" else "truncated")
        seen.add((r, x))
    return out


def cheapest(rows, found):
    """(cost, audit) by all states with whole strings: each layer closed under up to six inserts."""
    moves = {"": "su", "s": "u", "u": "a", "a": "u"}

    def close(layer):
        for _ in range(6):
            for s, (c, a) in list(layer.items()):
                for to in moves[s].replace("s", ""):
                    new = (c + 5, a + "I")
                    if to not in layer or new < layer[to]:
                        layer[to] = new
        return layer

    # prefixes must not be dropped for being a longer string's beginning: keep the layer open for the next row, closed for its moves
    layer = {"": (0, "")}
    for (_, _, r, _), fault in zip(rows, found):
        after = {}

        def offer(to, c, a):
            if to not in after or (c, a) < after[to]:
                after[to] = (c, a)

        for s, (c0, a0) in layer.items():
            for j in range(4):
                c, a, at = c0 + 5 * j, a0 + "I" * j, s
                for _ in range(j):
                    at = moves[at].replace("s", "")
                offer(at, c + 2, a + "D")
                if fault in ("", "truncated"):
                    c += 5 * (fault == "truncated")
                    offer(moves[at].replace("s", ""), c + 1, a + "R")
                    if r[:1] and r[0] in moves[at]:
                        offer(r[0], c, a + "K")
        layer = after
    return min(v for s, v in close(layer).items() if s in ("", "a"))


def apply(rows, audit):
    out, at = [], 0
    after = lambda: "assistant" if out and out[-1][0][0] == "u" else "user"
    for edit in audit:
        if edit == "I":
            out.append((after(), ""))
            continue
        _, _, r, x = rows[at]
        at += 1
        if edit != "D":
            out.append((r if edit == "K" else after(), x))
    assert at == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    return "\n".join(f"{r}:{x}" for r, x in out)


def brute(rows, ids):
    out = {}
    for c in ids:
        mine = [r for r in rows if r[0] == c]
        mine.sort(key=lambda r: (r[1] is not None, r[1], r[2], r[3]))
        found = faults(mine)
        turns = {r[1] for r in mine} - {None}
        cost, audit = cheapest(mine, found)
        initials = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[c] = (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(apply(mine, audit).encode()).hexdigest())
    return out


def as_dict(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.select(COLUMNS).collect()}


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def noise(n, ids, seed):
    draw = random.Random(seed)
    texts = ["fine.", "yes!", "why?", "cut off", "", " \n", "fine.", "again. ", "x"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "umpire"]
    rows, turn = [], dict.fromkeys(ids, 0)
    for _ in range(n):
        c = draw.choice(ids)
        turn[c] += draw.choice([1, 1, 1, 2])
        rows.append((c, turn[c] if draw.random() > 0.03 else None, draw.choice(roles), draw.choice(texts) if draw.random() < 0.5 else f"text {draw.random()}{draw.choice('.!? ')}"))
    return rows


def distinct_places(rows):
    """Ties of a turn are ordered by role, then by a hash: keep one text for each (conversation, turn, role)."""
    return list({(c, t, r): (c, t, r, x) for c, t, r, x in rows}.values())


def test_equals_plain_version(spark):
    t = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in t.collect()]
    assert as_dict(queries.op11_conversation_repair(spark, SF)) == brute(damaged(rows), {r[0] for r in rows})


@pytest.mark.parametrize("ranges", ["1", "13"])
def test_long_and_broken_conversations(spark, ranges):
    """One conversation has most rows and spans many ranges; ids, turns, roles and texts may be missing; rows repeat."""
    rows = distinct_places(noise(600, [7, 7, 7, 7, 1, 2, None], 5) + [(3, None, None, None), (4, 1, "user", "a."), (5, 5, "system", "only.")])
    rows += [(9, 1, "user", "copy me.")] * 50 + [(9, 2, "user", "copy me.")] * 3 + [(9, 3, "assistant", "done.")]
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        given = table(spark, rows).withColumn("key", F.lit("k")).withColumn("at", F.lit("x")).withColumn("piece", F.lit(1))
        repair = conv.Repair(table(spark, [r for r in rows if None not in r[2:]]))
        assert (repair._chosen.where("NOT whole").count() > 0) == (ranges == "13")
        assert as_dict(conv.repair_report(conv.damage(given), given)) == brute(damaged(rows), {r[0] for r in rows})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c."), (2, 0, "tool", "x."), (2, 1, "assistant", "y.")]
    repair = conv.Repair(table(spark, rows))
    got = [(r["key"], r["role"], r["text"]) for r in repair.repaired().orderBy("key", "piece", "number").collect()]
    # deleting one of two users is cheaper than an insert; of two equal ways the one that sorts first
    assert got == [("=1", "user", "b."), ("=1", "assistant", "c."), ("=2", "user", "x."), ("=2", "assistant", "y.")]
    assert {r["key"]: r["audit"] for r in repair.report().collect()} == {"=1": "DKK", "=2": "RK"}


def test_nothing(spark):
    none = table(spark, [])
    assert conv.repair_report(conv.damage(none), none).collect() == []
    (row,) = conv.repair_report(none, table(spark, [(1, 1, "user", "x")])).collect()
    assert tuple(row)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_search_equals_all_edit_strings():
    """Every string of edits of short conversations, tried one by one."""
    kinds = [("s", ""), ("u", ""), ("a", ""), ("t", "truncated"), ("u", "truncated"), ("u", "blank"), ("a", "")]
    draw = random.Random(1)
    for _ in range(60):
        rows = [(0, 0, *draw.choice(kinds)) for _ in range(draw.randint(1, 4))]
        best = None
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            for edits in itertools.product("KRD", repeat=len(rows)):
                audit = "".join("I" * g + e for g, e in zip(gaps, [*edits, ""]))
                roles, cost = [], 5 * sum(gaps)
                at = 0
                for e in audit:
                    if e == "D":
                        cost += 2
                    elif e in "KR":
                        if rows[at][3] == "blank":
                            break
                        cost += (e == "R") + 5 * (rows[at][3] == "truncated")
                        roles.append(rows[at][2] if e == "K" else "?")
                    else:
                        roles.append("?")
                    at += e != "I"
                else:
                    lead = roles[:1] == ["s"]
                    rest = roles[lead:]
                    if len(rest) % 2 == 0 and (rest or not lead) and all(r in ("?", "ua"[k % 2]) for k, r in enumerate(rest)) and (best is None or (cost, audit) < best):
                        best = (cost, audit)
        ends = conv.search([(conv.kind_of(r[2], r[3] == "truncated", r[3] == "blank"), 1) for r in rows], conv.START)
        state, cost, inserts = conv.closing({s: e[:2] for s, e in enumerate(ends) if e})
        assert (cost, ends[state][2] + inserts) == best == cheapest(rows, [r[3] for r in rows])


def test_many_copies_take_few_steps():
    ends = conv.search([(conv.kind_of("u", False, False), 1_000_000), (conv.kind_of("a", False, False), 1)], conv.START)
    assert ends[conv.ASSISTANT][0] == 2 * 999_999 and ends[conv.ASSISTANT][2] == "K" + "D" * 999_999 + "K"
