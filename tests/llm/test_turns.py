import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from deltascope.llm import turns

SCHEMA = "audit string, conv_id long, fault int, turn long, role string, text string, copy int, dropped boolean"
WORDY = re.compile("[^\x20\x09-\x0d]")


def damage(rows):
    """conv_id -> its rows after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        mine += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def brute(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        found = WORDY.findall(text)
        faults.append("b" if not found else "d" if (role, text) in seen else "t" if found[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, done, inserted):
        """Cheapest (cost, edits) from row i on, `done` being the initials so far, shortened."""
        ways = [(0, "", "")] if i == len(rows) and (done == "" or done[-1] == "a") else []
        need = "a" if done[-1:] == "u" else "u"
        if inserted < 3:
            c, e, _ = best(i + 1 - 1, need, inserted + 1)
            ways.append((c + 2, "I" + e, need))
        if i < len(rows):
            c, e, _ = best(i + 1, done, 0)
            ways.append((c + 3, "D" + e, ""))
            if faults[i] in ("", "t"):
                more = int(faults[i] == "t")
                first = rows[i][1][:1]
                if first == need or (first == "s" and done == ""):
                    c, e, _ = best(i + 1, first, 0)
                    ways.append((c + more, "K" + e, first))
                c, e, _ = best(i + 1, need, 0)
                ways.append((c + 2 + more, "R" + e, need))
        return min(ways) if ways else (10**9, "", "")

    cost, edits, _ = best(0, "", 0)
    lines, i, last = [], 0, ""
    for x in edits:
        need = "assistant" if last == "u" else "user"
        if x == "I":
            lines.append(need + ":")
            last = need[0]
            continue
        _, role, text = rows[i]
        i += 1
        if x == "D":
            continue
        role = role if x == "K" else need
        lines.append(f"{role}:{text}")
        last = role[0]
    numbers = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made_up(seed, conversations=150):
    r = random.Random(seed)
    rows = []
    for c in range(conversations):
        n = r.randrange(0, 14)
        for t in range(n):
            role = r.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User"])
            text = r.choice(["Yes.", "No!", "Is it?  ", "cut off", " \t\n", "", None, "Why? Because", "é.", "x" * 50 + "."])
            turn = None if r.random() < 0.05 else t if r.random() < 0.9 else r.randrange(n)
            rows.append((c if c else None, turn, role, text))
    return rows


@pytest.mark.parametrize("seed,spill", [(1, 1 << 20), (2, 3), (3, 1)])
def test_repair_equals_brute_force(spark, seed, spill):
    rows = made_up(seed)
    df = spark.createDataFrame([("x", c, 7, t, r, x, 9, True) for c, t, r, x in rows], SCHEMA).repartition(3)
    want = damage(rows)
    got = {r.conv_id: tuple(r)[1:] for r in turns.repair(turns.damaged(df), spill).collect()}
    assert set(got) == set(want)
    for c in want:
        assert got[c] == brute(want[c]), (c, want[c])


def test_long_conversation_over_many_batches_and_pieces(spark):
    n = 30_000
    rows = [(5, t, "user" if t % 2 == 0 else "assistant", f"turn {t}." if t % 7 else f"turn {t}") for t in range(n)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    try:
        got = turns.repair(turns.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), 4096).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    kept = damage(rows)[5]
    assert len(got.audit.replace("I", "")) == len(kept)
    # the cost follows from the edits, and the edits give the digest
    price, last, lines, i = 0, "", [], 0
    seen = set()
    for x in got.audit:
        need = "assistant" if last == "u" else "user"
        if x != "I":
            _, role, text = kept[i]
            i += 1
            bad = not WORDY.search(text) or (role, text) in seen
            seen.add((role, text))
            if x != "D":
                assert not bad
                price += text.rstrip()[-1] not in ".!?"
        price += {"I": 2, "R": 2, "D": 3, "K": 0}[x]
        if x != "D":
            role, text = (need, "") if x == "I" else (role if x == "K" else need, text)
            lines.append(f"{role}:{text}")
            last = role[0]
    assert price == got.cost and got.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_empty_table_and_dropped_conversations(spark):
    assert turns.repaired_damage(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = turns.repaired_damage(spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_very_long_text(spark):
    text = "word " * 2_000_000 + "end."
    rows = [(1, 1, "user", text), (1, 2, "assistant", text)]
    got = turns.repaired_damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert tuple(got)[1:] == brute(damage(rows)[1])
