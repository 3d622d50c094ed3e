import hashlib
import heapq
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np

from fragsieve.llm import conversations as C

SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    """From the contract's words; rows of one turn in the operator's order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        out[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(code, 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{r[1]}:{r[2]}".encode()).digest())
    return {conv: sorted(found, key=key) for conv, found in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        shown = text.rstrip(SPACE)
        out.append("b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, bad):
    """Least cost, then least letters, over all sequences of edits: a search by (cost, letters) without any cost-to-go."""
    accepts = re.compile("(s?(ua)+)?")
    prefix = re.compile("s?(ua)*u?")
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, letters, i, initials, made = heapq.heappop(queue)
        if i == len(rows) and accepts.fullmatch(initials):
            return cost, letters, "\n".join(f"{r}:{t}" for r, t in made)
        state = (i, initials[-1:])
        if state in done:
            continue
        done.add(state)
        edits = [(3, "I", i, role, "") for role in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            more = 3 * (bad[i] == "t")
            edits.append((4, "D", i + 1, None, None))
            if bad[i] not in ("b", "d"):
                edits += [(more, "K", i + 1, role, text), *((3 + more, "R", i + 1, r, text) for r in ("user", "assistant"))]
        for c, letter, j, role, text in edits:
            now = initials + (role[:1] or "-" if role is not None else "")
            if prefix.fullmatch(now):
                heapq.heappush(queue, (cost + c, letters + letter, j, now, made if role is None else (*made, (role, text))))


def brute(rows):
    out = {}
    for conv, found in damage(rows).items():
        bad = faults(found)
        turns = {t for t, _, _ in found if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(found))
        cost, letters, text = cheapest(found, bad)
        out[conv] = (gaps, *(bad.count(x) for x in "bdt"), illegal, cost, letters, hashlib.sha256(text.encode()).hexdigest())
    return out


def got(spark, rows, kind="long", **more):
    df = spark.createDataFrame([(c, t, r, x, 5, "y") for c, t, r, x in rows], f"conv_id {kind}, turn long, role string, text string, copies int, fault string")
    found = [tuple(r) for r in C.repair(C.damaged(df), **more).collect()]
    assert len({r[0] for r in found}) == len(found)
    return {r[0]: r[1:] for r in found}


def conversations(n, seed, most=9):
    rng = np.random.default_rng(seed)
    stock = ["Fine.", "Good!", "no end", "", "  \n", "Why?", "same.", "Ça va.", "Dots... ", "x "]
    roles = ["user", "assistant", "user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    out = []
    for conv in range(n):
        turn = int(rng.integers(-2, 3))
        for i in range(int(rng.integers(1, most))):
            role = ["user", "assistant"][i % 2] if rng.random() < 0.6 else roles[rng.integers(len(roles))]
            out.append((conv, None if rng.random() < 0.03 else turn, role, None if rng.random() < 0.03 else stock[rng.integers(len(stock))] if rng.random() < 0.5 else f"Turn {i}."))
            turn += int(rng.choice([0, 1, 1, 1, 2]))
    return out


def test_against_brute_force(spark):
    rows = conversations(400, 1) + [(None, 1, "user", "Hello."), (None, 2, "assistant", "Yes."), (None, None, "system", "Rules.")]
    want = brute(rows)
    assert got(spark, rows) == want
    assert any(v[6] == "" for v in want.values()) and {x for v in want.values() for x in v[6]} == set("DIKR")


def test_long_conversations_are_split(spark):
    rows = [(7, i, r, t) for i, (_, _, r, t) in enumerate(conversations(120, 2))] + conversations(5, 3) + [(8, 1, "user", "Copy.")] * 300 + [(9, i // 7, "user", "Same.") for i in range(100)]
    want = brute(rows)
    assert got(spark, rows) == want
    assert got(spark, rows, chunk_rows=3) == want
    assert got(spark, rows, chunk_bytes=20) == want


def test_text_ids_and_no_rows(spark):
    rows = [("a", 1, "user", "Hi."), ("b c", 1, "assistant", "Only me."), (None, 0, "user", "x"), ("", 3, "system", "Alone.")]
    assert got(spark, rows, "string") == brute(rows)
    assert got(spark, rows[:0]) == {}
