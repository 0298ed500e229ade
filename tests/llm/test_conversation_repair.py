"""Operator 13 against a plain uniform-cost search, and on odd tables."""

import hashlib
import heapq
import random
import re
import time
import zlib

import pytest

from sporeline.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile("(s?(ua)+)?")


def plain(rows):
    """Faults and (cost, audit, repaired) of rows (role, text) in order, by uniform-cost search over the edits, written apart from the operator."""
    seen, faults, state = set(), [], []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:], strict=False)]
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return faults, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, out
        if (i, last) in done:
            continue
        done.add((i, last))
        for letter in {"": "su", "s": "u", "u": "a", "a": "u"}[last]:
            name = {"u": "user", "a": "assistant"}.get(letter)
            if name:
                heapq.heappush(heap, (cost + 5, audit + "I", i, letter, (*out, (name, ""))))
            if i < len(rows) and faults[i] in ("", "truncated"):
                extra = 5 * (faults[i] == "truncated")
                if rows[i][0][:1] == letter:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, letter, (*out, rows[i])))
                if name:
                    heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, letter, (*out, (name, rows[i][1]))))
        if i < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, out))


def mended(rows):
    """The operator's helper on rows (role, text), equal neighbours counted together."""
    runs = []
    for r in rows:
        if runs and runs[-1][0] == r:
            runs[-1][1] += 1
        else:
            runs.append([r, 1])
    got = C.mend([r[0] for r, _ in runs], [r[1] for r, _ in runs], [n for _, n in runs])
    return got, tuple((role, runs[k][0][1] if k >= 0 else "") for k, role in zip(got["places"], got["roles"], strict=True))


@pytest.mark.parametrize("longest", [6, 12, 60])
def test_search_equals_uniform_cost(longest):
    rng = random.Random(longest)
    for _ in range(400 if longest < 60 else 120):
        roles = rng.choice((["user", "assistant"], ["user", "assistant", "system", "tool", "", " "], ["user"], ["system", "assistant"]))
        rows = [(rng.choice(roles), rng.choice(["a.", "b!", "c", " \t", "", f"{rng.random()}?", f"{rng.random()}"])) for _ in range(rng.randint(0, longest))]
        faults, illegal, cost, audit, out = plain(rows)
        got, repaired = mended(rows)
        assert (got["cost"], got["audit"], repaired) == (cost, audit, out)
        assert [got[k] for k in ("blank", "duplicate", "truncated")] == [faults.count(k) for k in ("blank", "duplicate", "truncated")] and got["illegal"] == illegal
        assert GOOD.fullmatch("".join(r[:1] for r, _ in repaired))


def test_work_grows_with_the_rows():
    took = {}
    for n in (2000, 8000):
        for roles in (["user"], ["assistant", "user"], ["tool"], ["user", "user", "assistant", "assistant", "system"]):
            rows = [(roles[i % len(roles)], f"{i}" + ("." if i % 3 else "")) for i in range(n)]
            began = time.process_time()
            got, repaired = mended(rows)
            took[n] = took.get(n, 0) + time.process_time() - began
            assert GOOD.fullmatch("".join(r[:1] for r, _ in repaired))
    assert took[8000] < 8 * took[2000]


def harmed(rows):
    """The contract's damage on rows (conv, turn, role, text), and the order."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        space = lambda x: " " if x is None else str(x)
        d, role, text = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20, space(role), space(text)
        if d:
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            mine += [(turn is not None, turn or 0, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return {c: sorted(v) for c, v in out.items()}


def test_query_equals_uniform_cost_on_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for conv in [None, *range(60)]:
        for _ in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([None, *range(8)]), rng.choice(["user", "assistant", "system", None, ""]), rng.choice([None, "", " ", "Hello.", "So", "é 漢?\n", f"{rng.random()}!", "x" * 50000 + "."])))
    rows += rows[:20] + [(7, 3, "user", "again and again.")] * 500
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", copies string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in C.op13_conversation_repair(spark, str(tmp_path)).collect()}
    want = harmed(rows)
    assert set(got) == set(want)
    for conv, mine in want.items():
        r, turns = got[conv], {t for known, t, *_ in mine if known}
        faults, illegal, cost, audit, out = plain([(role, text) for *_, role, text in mine])
        assert (r.gaps, r.illegal, r.cost, r.audit) == (max(turns) - min(turns) + 1 - len(turns) if turns else 0, illegal, cost, audit)
        assert [r.blank, r.duplicate, r.truncated] == [faults.count(k) for k in ("blank", "duplicate", "truncated")]
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()


def test_dropped_conversations_stay_and_empty_tables_stay_empty(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = spark.createDataFrame([(dropped, 0, "user", "Hi.")], SCHEMA)
    (r,) = C.repair_conversations(C.damaged(rows), copies_col="copies").collect()
    assert tuple(r) == (dropped, 0, 0, 0, 0, 0, 0, "", [])
    assert C.repair_conversations(rows.limit(0)).count() == 0
    (r,) = C.repair_conversations(rows).collect()
    assert (r.cost, r.audit, [tuple(x) for x in r.repaired]) == (2, "D", [])
