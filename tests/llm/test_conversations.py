"""Conversation repair against enumeration of all edits; large conversations against whole ones."""

import hashlib
import random
import re
import zlib

import pytest

from tidemark.llm.conversations import damaged, repair_conversations, solve

ROW = "conv_id long, turn long, role string, text string, n int, block string, cost string"
AFTER = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def enumerated(turns):
    """All edit sequences with at most two inserts in a gap: the least (cost, audit)."""
    best = [(3 * len(turns) + 1, "")]

    def go(i, state, cost, audit):
        if cost > best[0][0]:
            return
        here = state
        for n in range(3):
            if n:
                here = "a" if here == "u" else "u"
            if i == len(turns):
                if here in ("", "a"):
                    best[0] = min(best[0], (cost + 2 * n, audit + "I" * n))
                continue
            initial, gone, cut = turns[i]
            go(i + 1, here, cost + 2 * n + 3, audit + "I" * n + "D")
            if not gone:
                for role, letter, price in ((initial, "K", 0), ("u", "R", 2), ("a", "R", 2)):
                    if role in AFTER[here]:
                        go(i + 1, AFTER[here][role], cost + 2 * n + price + cut, audit + "I" * n + letter)

    go(0, "", 0, "")
    return best[0]


def test_solve_matches_enumeration():
    rng = random.Random(3)
    for _ in range(600):
        turns = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(0, 6))]
        cost, letters = solve(turns)
        assert (cost, "".join(letters)) == enumerated(turns), turns


def plain(rows):
    """Damage, faults and repair, conversation by conversation."""
    out = []
    for conv in {r[0] for r in rows}:
        after = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            mark = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if mark:
                text = "" if mark == 1 else re.sub("[.!?]", "", text) if mark == 2 else text
                after += [(turn, "user" if mark == 4 else role, text)] * (2 if mark == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, turns, counts = set(), [], [0, 0, 0]
        for _, role, text in after:
            ink = re.sub("[\x20\x09-\x0d]", "", text)
            fault = 0 if not ink else 1 if (role, text) in seen else 2 if ink[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            turns.append((role[:1], fault in (0, 1), fault == 2))
        numbers = [t for t, *_ in after if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        cost, audit = enumerated(turns)
        state, lines, left = "", [], iter(after)
        for letter in audit:
            _, role, text = (None, "", "") if letter == "I" else next(left)
            if letter == "K":
                lines.append(f"{role}:{text}")
                state = AFTER[state][role[:1]]
            elif letter != "D":
                state = "a" if state == "u" else "u"
                lines.append(("user:" if state == "u" else "assistant:") + text)
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, conversations, longest):
    rng = random.Random(seed)
    said = ["Yes.", "No", "Why?", "  ", "", "Ünd so\n!", None, "long " * 50 + ".", "a.b", "\u00a0"]
    rows = []
    for c in range(conversations):
        for t in range(rng.randrange(1, longest)):
            turn = None if rng.random() < 0.05 else rng.choice([t, t, t, t + 3])
            rows.append((c, turn, rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "User"]), rng.choice(said)))
    return rows + [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (10_000, None, None, None)]


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"whole_rows": 2, "block_rows": 2}), (3, {"whole_chars": 30, "block_rows": 3})])
def test_repairs_match_enumeration(spark, seed, options):
    rows = made(seed, 40, 8)
    rows += rows[:5]
    df = spark.createDataFrame([(*r, 1, "b", "c") for r in rows], ROW)
    got = repair_conversations(df, damaged(df), **options).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


def test_one_large_conversation_in_blocks(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"Own {t}.", f"Cut {t}", ""])) for t in range(1500)]
    df = spark.createDataFrame([(*r, 1, "b", "c") for r in rows], ROW)
    whole = repair_conversations(df, damaged(df), whole_rows=10_000).collect()
    parts = repair_conversations(df, damaged(df), whole_rows=100, block_rows=64).collect()
    assert [tuple(r) for r in whole] == [tuple(r) for r in parts]


def test_nothing_left_and_empty_table(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.", 1, "", "")], ROW)
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in repair_conversations(df, damaged(df)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
    none = df.limit(0)
    assert repair_conversations(none, damaged(none)).count() == 0
