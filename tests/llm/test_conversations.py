"""Repair of conversations against all edits, against a plain dynamic programme, and of odd tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest

from foliomill.llm import conversations as C

SPACE = " \t\n\x0b\x0c\r"
GOAL = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string, key string, at long, audit string"


def every_audit(rows):
    """(cost, audit, roles) of all edits of a few rows with at most two inserts before each and at the end."""
    gaps = [(), ("u",), ("a",), ("u", "a")]
    choices = []
    for initial, fault in rows:
        ways = [("D", "", 3)]
        if fault < 2:
            ways += [("K", initial, fault), ("R", "u", 2 + fault), ("R", "a", 2 + fault)]
        choices += [gaps, ways]
    for pick in product(*choices, gaps):
        audit = roles = ""
        cost = 0
        for k, way in enumerate(pick):
            if k % 2:
                audit, roles, cost = audit + way[0], roles + way[1], cost + way[2]
            else:
                audit, roles, cost = audit + "I" * len(way), roles + "".join(way), cost + 2 * len(way)
        if GOAL.match(roles):
            yield cost, audit, roles


def code(initial, fault):
    return C.CODES["sua".find(initial) % 4 * 3 + fault] if initial in "sua" else C.CODES[9 + fault]


def plain_audit(rows):
    """The same by whole strings: least (cost, audit) for every state, kept as they are."""
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    after = {0: 2, 1: 2, 3: 2, 2: 3}

    def inserted(live):
        for _ in range(2):
            for s, (cost, audit) in list(live.items()):
                live[after[s]] = min(live.get(after[s], (10**9, "")), (cost + 2, audit + "I"))
        return live

    live = {0: (0, "")}
    for initial, fault in rows:
        found = {}
        for s, (cost, audit) in inserted(live).items():
            ways = [(s, 3, "D")]
            if fault < 2:
                ways += [(after[s], 2 + fault, "R")] + ([(keep[s, initial], fault, "K")] if (s, initial) in keep else [])
            for t, price, letter in ways:
                found[t] = min(found.get(t, (10**9, "")), (cost + price, audit + letter))
        live = found
    live = inserted(live)
    return min(live[s] for s in (0, 3) if s in live)


def test_audits_are_the_least_of_all_edits():
    rng = random.Random(4)
    for _ in range(60):
        rows = [(rng.choice("suuaaax"), rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.randint(0, 4))]
        codes = "".join(code(*r) for r in rows)
        best = min(every_audit(rows))[:2]
        assert C.joined_blocks([C.block_table(codes, False)] if codes else []) == best == plain_audit(rows)


@pytest.mark.parametrize("size", [1, 3, 50])
def test_blocks_join_to_the_whole(size):
    rng = random.Random(size)
    for n in (1, 7, 40, 300):
        rows = [(rng.choice("sua" + "ua" * 3), rng.choice([0, 0, 0, 0, 1, 2])) for _ in range(n)]
        codes = "".join(code(*r) for r in rows)
        blocks = [codes[k : k + size] for k in range(0, n, size)]
        assert C.joined_blocks(C.block_table(b, k > 0) for k, b in enumerate(blocks)) == plain_audit(rows)


def test_colliding_hashes_change_nothing(monkeypatch):
    monkeypatch.setattr(C, "_PRIME", 2)
    C.block_table.cache_clear()
    rng = random.Random(9)
    rows = [(rng.choice("sua"), rng.choice([0, 0, 1])) for _ in range(200)]
    codes = "".join(code(*r) for r in rows)
    assert C.joined_blocks([C.block_table(codes, False)]) == plain_audit(rows)
    C.block_table.cache_clear()


def by_hand(table):
    groups = defaultdict(list)
    for conv, turn, role, text, *_ in table:
        groups[conv]
        shown = [" " if v is None else str(v) for v in (conv, turn)]
        fault = zlib.crc32(":".join(shown).encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        groups[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    out = []
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, role, text in rows:
            solid = text.strip(SPACE)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit = plain_audit([(i or "x", {"": 0, "truncated": 1}.get(f, 2)) for i, f in zip(initials, faults, strict=True)])
        state, rest, lines = 0, iter(rows), []
        for letter in audit:
            row = None if letter == "I" else next(rest)
            if letter == "D":
                continue
            if letter == "K":
                state = {"s": 1, "u": 2, "a": 3}[row[1][0]]
                lines.append(f"{row[1]}:{row[2]}")
            else:
                state = 3 if state == 2 else 2
                lines.append(f"{'user' if state == 2 else 'assistant'}:{'' if row is None else row[2]}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shift", [1, 12])
def test_conversations_against_brute_force(spark, shift):
    rng = random.Random(7)
    texts = ["Yes.", "No!", "Why?", "cut off", " \t\n", "", "é.\n", "Yes. ", None, "long " * 5000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    rows = []
    for conv in [*range(150), None]:
        for turn in range(rng.randint(0, 12)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(roles), rng.choice(texts), "x", 1, "y"))
    rows += [(1000, t, ("user", "assistant")[t % 2], f"Turn {t}.", "x", 1, "y") for t in range(600)]
    rows += rows[:20]
    found = C.audited(spark.createDataFrame(rows, SCHEMA).repartition(4), shift).collect()
    assert sorted((tuple(r) for r in found), key=repr) == by_hand(rows)


def test_empty_table(spark):
    assert C.audited(spark.createDataFrame([], SCHEMA)).count() == 0
