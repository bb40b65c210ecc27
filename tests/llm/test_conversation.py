"""Conversation repair against a shortest-path search over whole strings."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from verdant.llm import conversation as C

ROWS = "conv_id long, turn long, role string, text string, pass int, fault string"  # clashing extra columns


def cheapest(rows):
    """(cost, audit, repaired rows) by Dijkstra over (cost, audit); rows: role, text, fault."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, wrote, out = heapq.heappop(queue)
        last = wrote[-1:]
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", wrote):
            return cost, audit, list(out)
        if (i, wrote if wrote == "" else last) in done:
            continue
        done.add((i, wrote if wrote == "" else last))
        steps = []
        if i < len(rows):
            role, text, bad = rows[i]
            steps.append((4, "D", i + 1, None))
            if bad not in ("blank", "duplicate"):
                more = 3 * (bad == "truncated")
                steps.append((more, "K", i + 1, (role, text)))
                steps += [(3 + more, "R", i + 1, (r, text)) for r in ("user", "assistant")]
        steps += [(3, "I", i, (r, "")) for r in ("user", "assistant")]
        for more, letter, j, row in steps:
            now = wrote if row is None else wrote + (row[0][:1] or "-")
            if re.fullmatch("s?(ua)*u?", now):
                heapq.heappush(queue, (cost + more, audit + letter, j, now, out if row is None else out + (row,)))


def brute(table):
    """The contract, row by row."""
    convs = {}
    for conv_id, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        own = convs.setdefault(conv_id, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv_id, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, role, text in own:
            stripped = re.sub("[\x20\x09-\x0d]+$", "", text)
            faults.append("blank" if not stripped else "duplicate" if (role, text) in seen else
                          "truncated" if stripped[-1] not in ".!?" else None)
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, rows = cheapest([(r, t, f) for (_, r, t), f in zip(own, faults)])
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest()
        out.append((conv_id, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def run(spark, table):
    df = spark.createDataFrame([(*r, 7, "x") for r in table], ROWS)
    return sorted(map(tuple, C.repair(C.damaged(df)).collect()), key=repr)


def random_rows(rng, n):
    return [(rng.choice(["user", "assistant", "user", "assistant", "system", " ", "", "Unknown", "used"]), f"t{rng.randrange(9)}",
             rng.choice([None] * 5 + ["blank", "duplicate", "truncated", "truncated"])) for _ in range(n)]


def test_search_equals_dijkstra():
    rng = random.Random(1)
    for _ in range(1500):
        rows = random_rows(rng, rng.randint(0, 9))
        roles = bytearray(C.role_class(r) for r, _, _ in rows)
        faults = bytearray(C.GONE if f in ("blank", "duplicate") else C.CUT if f else C.CLEAN for _, _, f in rows)
        assert C.Search(roles, faults).run() == cheapest(rows)[:2]


def test_estimate_never_overrates():
    rng = random.Random(2)
    for _ in range(300):
        rows = random_rows(rng, rng.randint(1, 8))
        roles = bytearray(C.role_class(r) for r, _, _ in rows)
        faults = bytearray(C.GONE if f in ("blank", "duplicate") else C.CUT if f else C.CLEAN for _, _, f in rows)
        search = C.Search(roles, faults)
        for i in range(len(rows)):
            assert search.estimate(i, C.START) <= cheapest(rows[i:])[0]


def test_long_conversations_stay_cheap():
    rng = random.Random(3)
    for roles in ([C.U] * 3000, [C.U, C.U, C.A] * 1000, [C.S] * 1500, [rng.choice([C.U, C.A]) for _ in range(1000)]):
        search = C.Search(bytearray(roles), bytearray(rng.choice([0, 0, 0, 1, 2]) for _ in roles))
        cost, audit = search.run()
        assert cost > 0 and sum(x != "I" for x in audit) == len(roles)


def test_equals_contract(spark):
    rng = random.Random(4)
    texts = ["Hello there.", "What?", "no end", "", " \t\x0b", "é!", "Same.", None, "A. B! ", "long " * 20_000 + "."]
    table = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 14)):
            row = (conv, rng.choice([turn, turn, turn, turn + 3]), rng.choice(["user", "assistant", "system", None, "", "bot"]), rng.choice(texts))
            table += [row] * rng.choice([1, 1, 1, 2])
        if conv is not None and conv % 9 == 0:
            table += [(conv, None, "user", "x."), (conv, None, "assistant", "y.")]
    dropped = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table += [(dropped, 0, "user", "gone."), (dropped + 5000, -(2 ** 62), "user", "a."), (dropped + 5000, 2 ** 62, "assistant", "b.")]
    rng.shuffle(table)
    want = brute(table)
    assert run(spark, table) == want
    empty = next(r for r in want if r[0] == dropped)
    assert empty == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_given_table_and_repaired_rows(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    table = [tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()]
    assert run(spark, table) == brute(table)
    convs = {}
    for r in sorted(C.repaired(C.damaged(rows)).collect(), key=lambda r: (r.conv_id, r.position)):
        convs.setdefault(r.conv_id, []).append(r)
    for r in C.repair(C.damaged(rows)).collect():
        own = convs.get(r.conv_id, [])
        assert [x.position for x in own] == list(range(len(own))) and re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in own))
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in own).encode()).hexdigest()


def test_one_conversation_of_many_rows(spark):
    df = spark.range(20_000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id, '.') as text")
    (row,) = C.repair(C.damaged(df)).collect()
    dropped = sum(zlib.crc32(f"1:{i}".encode()) % 20 == 0 for i in range(20_000))
    assert row.gaps == dropped - sum(zlib.crc32(f"1:{i}".encode()) % 20 == 0 for i in (0, 19_999))
    assert row.audit.count("D") >= row.blank + row.duplicate > 0 and sum(x != "I" for x in row.audit) == sum(
        {0: 0, 3: 2}.get(zlib.crc32(f"1:{i}".encode()) % 20, 1) for i in range(20_000))


def test_empty_table(spark):
    assert run(spark, []) == []
    assert C.repaired(C.damaged(spark.createDataFrame([], ROWS))).count() == 0


@pytest.mark.parametrize("rows, want", [([], (0, "")), ([C.S], (4, "D")), ([C.U], (3, "KI")), ([C.A, C.U], (6, "IKKI"))])
def test_small_cases(rows, want):
    assert C.Search(bytearray(rows), bytearray(len(rows))).run() == want
