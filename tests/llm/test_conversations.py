"""The repair of conversations against a plain backward table over whole conversations, and on conversations that lie over many tasks."""

import hashlib
import random
import re
import zlib
from math import inf

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm.conversations import CUT_OFF, FINE, MUST_GO, damaged, repair, search, ways

STEPS = {0: {"s": 1, "u": 2, "": 0}, 1: {"u": 2, "": 1}, 2: {"a": 3, "": 2}, 3: {"u": 2, "": 3}}
FORCED = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}


def plain(rows):
    """Cost, audit and repaired lines of rows (must_go, truncated, role, text): the least of (cost, audit) from every place and state, from the back."""
    n = len(rows)
    best = [[(inf, "")] * 4 for _ in range(n + 1)]
    for i in range(n, -1, -1):
        own = [(0, "") if i == n and q in (0, 3) else (inf, "") for q in range(4)]
        if i < n:
            must_go, cut, role, _ = rows[i]
            for q in range(4):
                found = [(best[i + 1][q][0] + 3, "D" + best[i + 1][q][1])]
                if not must_go:
                    r = best[i + 1][FORCED[q][1]]
                    found.append((r[0] + 2 + cut, "R" + r[1]))
                    if role[:1] in STEPS[q]:
                        r = best[i + 1][STEPS[q][role[:1]]]
                        found.append((r[0] + cut, "K" + r[1]))
                own[q] = min(found)
        for _ in range(3):
            own = [min(own[q], (own[FORCED[q][1]][0] + 2, "I" + own[FORCED[q][1]][1])) for q in range(4)]
        best[i] = own
    cost, audit = best[0][0]
    q, i, out = 0, 0, []
    for e in audit:
        if e == "K":
            out.append(f"{rows[i][2]}:{rows[i][3]}")
            q = STEPS[q][rows[i][2][:1]]
        elif e in "IR":
            out.append(f"{FORCED[q][0]}:{rows[i][3] if e == 'R' else ''}")
            q = FORCED[q][1]
        i += e != "I"
    assert "".join(x[:1] for x in (y.split(":")[0] for y in out)) == "" or re.fullmatch("s?(ua)+", "".join(y.split(":")[0][:1] for y in out))
    return cost, audit, out


def brute(rows):
    """The contract for rows (turn, role, text) of one conversation."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    seen, judged, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        kept = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        judged.append((fault in ("blank", "duplicate"), int(fault == "truncated"), role, text))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = plain(judged)
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def harmed(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 0:
            continue
        row = (turn, "user" if draw == 4 else role, "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text)
        own += [row] * (2 if draw == 3 else 1)
    return out


KIND = {FINE: (False, 0), MUST_GO: (True, 0), CUT_OFF: (False, 1)}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([FINE, FINE, MUST_GO, CUT_OFF]), st.sampled_from(["s", "u", "a", "x", ""])), max_size=20))
def test_the_first_accepting_path_is_the_least(rows):
    cost, audit, _ = plain([(*KIND[k], r, "") for k, r in rows])
    got = ways(rows, [0, 4, 2, 0], [0])[0]
    assert got[0] == cost and audit.startswith(got[1]) and set(audit[len(got[1]) :]) <= {"I"}
    if len(rows) <= 8:
        assert search(rows, 0, [0, 4, 2, 0])[0] == cost


def test_no_way_is_said_so():
    assert search([(FINE, "u")], 2, [0, inf, inf, inf]) == (inf, "")
    assert search([], 0, [inf] * 4) == (inf, "")


SCHEMA = "conv_id long, turn long, role string, text string, part int, seq int, piece string, cost string"


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "clash", "clash") for r in rows], SCHEMA)


def compared(got, expected):
    assert {tuple(r) for r in got} == {(c, *brute(x)) for c, x in expected.items()} and len(got) == len(expected)


def test_awkward_rows(spark):
    rows = [
        (1, None, "user", "first of all."), (1, 3, None, None), (1, 3, "assistant", "so?"), (1, 3, "assistant", "so?"), (1, 9, "tool", "x"), (None, None, None, None), (None, 2, "user", "who."),
        (2, 1, "", "nothing"), (2, 2, "system", "s."), (3, 5, "assistant", "a" * 300_000), (3, 4, "user", " \n\t"), (4, 1, "ümlaut", "日本語。"), (5, 7, "user", "one."), (5, 6, "assistant", "two! \x0b"),
    ]
    for some in (rows, []):
        expected = {}
        for r in some:
            expected.setdefault(r[0], []).append(r[1:])
        compared(repair(made(spark, some)).collect(), expected)
        compared(repair(damaged(made(spark, some)), present_col="present").collect(), harmed(some))


@pytest.mark.parametrize("turns", [1, 0])
def test_a_conversation_over_many_tasks(spark, turns):
    """One conversation holds most rows, with repeats far apart; turns that differ, or none."""
    draw = random.Random(7)
    text = lambda: draw.choice(["yes.", "no", "", "what?", *(f"answer {i}." for i in range(1500))])
    rows = [(5, i if turns else None, draw.choice(["user", "assistant", "assistant", "user", "system", "tool"]), text()) for i in range(2600)]
    rows += [(c, t, draw.choice(["user", "assistant"]), text()) for c in range(10) if c != 5 for t in range(5)]
    compared(repair(damaged(made(spark, rows)).repartition(7), present_col="present").collect(), harmed(rows))


def test_registered_query(spark, sf_dir):
    from ledgerloom.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    compared(QUERIES["op13_conversation_repair"](spark, sf_dir).collect(), harmed(rows))
