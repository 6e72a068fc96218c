"""Repairs against a search of all edits, over made conversations, odd ones and long ones."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from millrace.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def cheapest(turns):
    """The least (cost, audit, repaired) by Dijkstra's search over (turns done, role that came last)."""
    todo, done = [(0, "", 0, "", ())], set()
    while todo:
        cost, audit, i, last, out = heapq.heappop(todo)
        if i == len(turns) and last in ("", "a"):
            return cost, audit, out
        if (i, last) in done:
            continue
        done.add((i, last))
        after = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        for x, role in (("u", "user"), ("a", "assistant")):
            if x in after:
                heapq.heappush(todo, (cost + 5, audit + "I", i, x, (*out, (role, ""))))
        if i < len(turns):
            role, text, fault = turns[i]
            heapq.heappush(todo, (cost + 2, audit + "D", i + 1, last, out))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role[:1] and role[:1] in after:
                    heapq.heappush(todo, (cost + more, audit + "K", i + 1, role[:1], (*out, (role, text))))
                for x, new in (("u", "user"), ("a", "assistant")):
                    if x in after:
                        heapq.heappush(todo, (cost + more + 1, audit + "R", i + 1, x, (*out, (new, text))))


def brute_force(rows):
    """{conv_id: figures} of rows (conv_id, turn, role, text)."""
    kept, found = {}, {}
    for conv, turn, role, text in damaged(rows):
        kept.setdefault(conv, []).append((turn is not None, turn or 0, role.encode(), text.encode()))
    for conv in {r[0] for r in rows}:
        own, seen, turns = sorted(kept.get(conv, [])), set(), []
        for _, _, role, text in own:
            role, text = role.decode(), text.decode()
            end = text.rstrip("\t\n\x0b\x0c\r ")
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "none"
            seen.add((role, text))
            turns.append((role, text, fault))
        numbers = {t for known, t, _, _ in own if known}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        odd = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, out = cheapest(turns)
        counts = [sum(t[2] == x for t in turns) for x in ("blank", "duplicate", "truncated")]
        found[conv] = (gaps, *counts, odd, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())
    return found


def reported(spark, rows, schema=SCHEMA):
    df = repair.report(spark.createDataFrame(rows, schema))
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


TEXTS = ["Yes.", "no", "What?", "", " \t\n", "Well! ", "é\x85", "a\n.", "so.\n", None, "ß. ", "Yes. "]


def made(seed, conversations, longest, turns=None):
    rng, rows = random.Random(seed), []
    for conv in range(conversations):
        for turn in range(rng.randrange(1, longest)):
            number = None if rng.random() < 0.05 else turn if turns is None else rng.choice(turns)
            role = rng.choice(["user", "assistant"] * 5 + ["system", "tool", "", None, "User", "apple"])
            rows.append((None if conv == 0 else conv, number, role, rng.choice(TEXTS) if rng.random() < 0.4 else f"Turn {rng.randrange(10**6)}{rng.choice('.!?,')}"))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_short_conversations(spark, seed):
    rows = made(seed, 150, 9)
    assert reported(spark, rows) == brute_force(rows)


def test_turns_of_one_number_and_negative_ones(spark):
    rows = made(5, 60, 12, [-300, -1, 0, 3, 3, 255, 256, 10**12])
    assert reported(spark, rows) == brute_force(rows)


def test_long_conversations_come_in_chunks(spark):
    rows = made(7, 3, 1500) + [(9, i, "user" if i % 2 == 0 else "assistant", f"{i}.") for i in range(1100)]
    # A turn number that many rows share, and no number at all.
    rows += [(10, 5, "user", f"{i}.") for i in range(600)] + [(11, None, "assistant", f"{i}") for i in range(600)]
    assert reported(spark, rows) == brute_force(rows)


def test_a_conversation_that_is_dropped_whole(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    none = hashlib.sha256(b"").hexdigest()
    assert reported(spark, [(gone, 0, "user", "Hello.")]) == {gone: (0, 0, 0, 0, 0, 0, "", none)}


def test_no_rows_and_other_columns(spark):
    assert reported(spark, []) == {}
    rows = made(11, 5, 6)
    wide = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS rows", "2 AS chunk", "3 AS fault", "4 AS k", "5 AS of", "6 AS after")
    assert {r.conv_id: tuple(r)[1:] for r in repair.report(wide).collect()} == brute_force(rows)


def test_a_very_long_text(spark):
    rows = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "x" * 2_000_000 + "?"), (1, 2, "user", " " * 2_000_000)]
    assert reported(spark, rows) == brute_force(rows)


def test_the_repaired_turns_themselves(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "user", "Are you there?"), (1, 3, "assistant", "")]
    out = repair.repair(spark.createDataFrame(rows, SCHEMA)).first()
    assert (out.cost, out.audit, out.blank, out.illegal) == (3, "KKRD", 1, 1)
    assert [tuple(t) for t in out.repaired] == [("system", "Be kind."), ("user", "Hi!"), ("assistant", "Are you there?")]
