"""Conversation repair against a memoised search over all edits."""

import functools
import hashlib
import random
import re
import sys
import zlib

import pytest

from tradewright.llm import conversations

sys.setrecursionlimit(20_000)  # search() goes one level deeper with each row
SCHEMA = "conv_id long, turn long, role string, text string, conv string, block long, copy int, audit string"


def search(rows):
    """rows: (role, text, must_delete, truncated). Cheapest (cost, audit, turns), ties to the ASCII-least audit."""
    pattern = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.lru_cache(None)
    def best(i, last, inserts):
        found = []
        if i == len(rows) and last in ("", "a"):
            found.append((0, "", ()))
        new = "a" if last == "u" else "u"
        if inserts < 3:
            c, a, t = best(i, new, inserts + 1)
            found.append((c + 3, "I" + a, (({"u": "user", "a": "assistant"}[new], ""),) + t))
        if i < len(rows):
            role, text, must, cut = rows[i]
            c, a, t = best(i + 1, last, 0)
            found.append((c + 4, "D" + a, t))
            if not must:
                if role[:1] and role[:1] in pattern[last]:
                    c, a, t = best(i + 1, role[:1], 0)
                    found.append((c + 3 * cut, "K" + a, ((role, text),) + t))
                c, a, t = best(i + 1, new, 0)
                found.append((c + 3 + 3 * cut, "R" + a, (({"u": "user", "a": "assistant"}[new], text),) + t))
        return min(found) if found else (10 ** 9, "", ())

    return best(0, "", 0)


def by_hand(table):
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in [r for r in table if r[0] == conv]:
            role, text = " " if role is None else role, " " if text is None else text
            fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if fate:
                text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
                rows += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults, marked = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in rows:
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        turns = [r[0] for r in rows if r[0] is not None]
        cost, audit, kept = search(tuple(marked))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults.values(), illegal, cost, audit, digest)
    return out


@pytest.fixture(scope="module")
def table():
    rng = random.Random(13)
    roles = ["user"] * 6 + ["assistant"] * 6 + ["system", "tool", None, "", "user2", "Assistant"]
    texts = ["Well.", "So?", "Yes!", "cut off", "", "  \t", None, "漢字。", "a. ", "b\n", "é!  " + " " * 100]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, None, 2]), rng.choice(roles), rng.choice(texts)))
    rows += [(None, t, r, x) for t, r, x in [(0, "user", "a."), (None, "assistant", "b."), (1, "assistant", "c")]]
    rows += [(99, 0, "user", "Same.")] * 40 + [(98, t, "ua"[t % 2] + "x", f"long {t}.") for t in range(60)] + [(97, 2 ** 62, "user", "x" * 50000)]
    return rows


def test_repair_is_the_cheapest_and_least(spark, table, monkeypatch):
    monkeypatch.setattr(conversations, "LEAST_BLOCK", 3)  # several blocks a conversation
    rows = [(*r, "x", 1, 2, "y") for r in table]
    got = {r[0]: tuple(r[1:]) for r in conversations.audit(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = by_hand(table)
    assert len(got) == len(want)
    for conv in want:
        assert got[conv] == want[conv], conv


def test_one_block_gives_the_same(spark, table):
    frame = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in table], SCHEMA)
    assert {r[0]: tuple(r[1:]) for r in conversations.audit(frame).collect()} == by_hand(table)


def test_empty_table(spark):
    assert conversations.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_conversation_split_over_ranges(spark):
    """One conversation holds nearly all rows, some of them equal: it spans ranges and blocks, and no block passes its size."""
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"text {t % 70}.") for t in range(200)] + [(1, 5, "user", "again.")] * 90 + [(2, 0, "user", "a.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = conversations.in_blocks(conversations.damaged(frame), 64).selectExpr("conv", "length(kinds) n", "spark_partition_id() p").collect()
        got = {r[0]: tuple(r[1:]) for r in conversations.audit(frame).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["n"] for r in sizes) <= 64 and len({r["p"] for r in sizes if r["conv"] == "v1"}) > 1
    assert got == by_hand(rows)
