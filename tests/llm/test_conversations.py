"""Conversation repair against plain searches over all edits, and on hand-made rows."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from compare import difference
from mediaseries.llm import oracles, queries
from mediaseries.llm.conversations import AFTER, Lattice, damaged, repair, repair_report, with_copies

COLUMNS = "conv_id long, turn long, role string, text string, run string, part string, audit string, n string, mark string"
CLASH = ("r", "p", "a", "n", "m")
EMPTY = hashlib.sha256(b"").hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], COLUMNS)


def plain(codes, entry=0, exits=(0, 3), trailing=True):
    """All edits, by recursion from the end."""

    @lru_cache(None)
    def best(i, q, inserts):
        ways = [(0, "")] if i == len(codes) and q in exits else []
        if inserts < 3 and (i < len(codes) or trailing):
            way = best(i, AFTER[q], inserts + 1)
            ways += [(way[0] + 2, "I" + way[1])] if way else []
        if i < len(codes):
            code, cut = codes[i] & 3, codes[i] >> 3
            steps = [(3, "D", q)]
            if not codes[i] & 4:
                steps += [(cut, "K", code)] if code == 1 and q == 0 or code > 1 and AFTER[q] == code else []
                steps.append((2 + cut, "R", AFTER[q]))
            for cost, letter, to in steps:
                way = best(i + 1, to, 0)
                ways += [(way[0] + cost, letter + way[1])] if way else []
        return min(ways, default=None)

    return best(0, entry, 0)


def folded(codes):
    """The same from the front, for long conversations: the least (cost, audit) of each state."""
    ways = {0: (0, "")}

    def opened(ways):
        ways = dict(ways)
        for _ in range(3):
            for q, (cost, audit) in list(ways.items()):
                ways[AFTER[q]] = min(ways.get(AFTER[q], (1 << 60, "")), (cost + 2, audit + "I"))
        return ways

    for c in codes:
        after = {}

        def reach(q, way):
            after[q] = min(after.get(q, way), way)

        code, cut = c & 3, c >> 3
        for q, (cost, audit) in opened(ways).items():
            reach(q, (cost + 3, audit + "D"))
            if not c & 4:
                if code == 1 and q == 0 or code > 1 and AFTER[q] == code:
                    reach(code, (cost + cut, audit + "K"))
                reach(AFTER[q], (cost + 2 + cut, audit + "R"))
        ways = after
    return min(way for q, way in opened(ways).items() if q in (0, 3))


def some(rng, n):
    return [rng.choice([0, 1, 2, 3, 2, 3]) + rng.choice([0, 0, 0, 4, 8]) for _ in range(n)]


def test_cheapest_edits():
    rng = random.Random(1)
    for n in range(11):
        for _ in range(150):
            codes = some(rng, n)
            assert Lattice(codes, True).cheapest(0, (0, 3)) == plain(codes) == folded(codes)
            entry, exit = rng.randrange(4), rng.randrange(4)
            assert Lattice(codes, False).cheapest(entry, (exit,)) == plain(codes, entry, (exit,), trailing=False)


def test_copies_go_behind_their_row():
    assert with_copies("IKRDI", [1, 3, 2]) == "IKRDDDDI"


def expected(rows):
    """The contract's columns of one conversation's rows, in order."""
    seen, codes, faults = set(), [], dict(blank=0, duplicate=0, truncated=0)
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        codes.append({"s": 1, "u": 2, "a": 3}.get(role[:1], 0) + (4 if fault in ("blank", "duplicate") else 8 if fault else 0))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit = folded(codes)
    out, left, state = [], iter(rows), 0
    for letter in audit:
        _, role, text = ("", "", "") if letter == "I" else next(left)
        if letter != "D":
            state = 1 if letter == "K" and role[0] == "s" else AFTER[state]
            out.append(f"{role if letter == 'K' else ('user', 'assistant')[state == 3]}:{text}")
    initials = "".join(line[0] for line in out)
    assert re.fullmatch("(s?(ua)+)?", initials)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **faults,
        "illegal": sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest(),
    }


def in_order(rows):
    known = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(known, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


def test_reports(spark):
    rng = random.Random(2)
    words = ["Yes.", "No", "Why?", "", " ", None, "so be it!", "é", "Go on.  \n"]
    rows = []
    for conv in [None, *range(60)]:
        for _ in range(rng.randrange(1, 14)):
            turn = rng.choice([None, *range(10)])
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "", None, "User", "u"]), rng.choice(words)))
    rows += [(100, 0, "user", "Same.")] * 40 + [(101, k, "user", "Same.") for k in range(30)]
    got = {r["conv_id"]: r.asDict() for r in repair_report(frame(spark, rows)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        own = [x[1:] for x in rows if x[0] == conv]
        assert {k: v for k, v in r.items() if k != "conv_id"} == expected(in_order(own)), conv


def test_a_long_conversation_spans_runs(spark):
    rng = random.Random(3)
    roles = [rng.choice(["user", "assistant", "assistant", "system", "x"]) for _ in range(9500)]
    rows = [(7, k, role, rng.choice([f"{k}.", f"{k}", "", "again."])) for k, role in enumerate(roles)] + [(8, 0, "user", "Hm.")]
    got = {r["conv_id"]: r.asDict() for r in repair_report(frame(spark, rows)).collect()}
    for conv in (7, 8):
        assert {k: v for k, v in got[conv].items() if k != "conv_id"} == expected(in_order([r[1:] for r in rows if r[0] == conv]))


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "tool", "x."), (1, 2, "assistant", "Bye."), (2, 0, "user", " ")]
    got = [tuple(r) for r in repair(frame(spark, rows)).orderBy("conv_id", "step").collect()]
    assert got == [(1, 0, "I", "user", ""), (1, 1, "K", "assistant", "Hello."), (1, 2, "R", "user", "x."), (1, 3, "K", "assistant", "Bye.")]


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    got = {}
    for r in damaged(frame(spark, rows)).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"]))
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        fault, same = zlib.crc32(key.encode()) % 20, (role or " ", text or " ")
        want = {0: None, 1: [(same[0], "")], 2: [(same[0], same[1].translate({46: None, 33: None, 63: None}))], 3: [same] * 2, 4: [("user", same[1])]}
        assert got.get((c, t)) == want.get(fault, [same])


def test_conversations_without_rows(spark):
    rows = frame(spark, [(1, 0, "user", "a")])
    got = repair_report(rows.limit(0), rows).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "", EMPTY)]
    assert repair_report(rows.limit(0)).count() == repair(rows.limit(0)).count() == 0


@pytest.mark.parametrize("null", ["conv_id", "turn", "role", "text"])
def test_sql_with_nulls(spark, tmp_path, null):
    """The registered query and its SQL on rows with NULLs and equal turns."""
    import duckdb

    path = str(tmp_path / "conversations.parquet")
    source = queries.table(spark, "/root/testdata/sf0.001", "conversations")
    source.selectExpr(*[f"if(turn % 3 = 1, null, {c}) as {c}" if c == null else c for c in source.columns]).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    assert difference(queries.op11_conversation_repair(spark, str(tmp_path)), con, oracles.OP11) is None
