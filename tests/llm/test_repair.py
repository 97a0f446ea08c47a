"""Conversation repair against brute force over all edits."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest

from landspark.llm import queries, repair
from landspark.llm.common import table

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, copies int, part long, symbols string"


def damaged_by_hand(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        some = out[conv]
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if lot == 1:
            text = ""
        if lot == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if lot == 4:
            role = "user"
        some += [(turn, role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def repaired_by_hand(rows):
    """Cheapest path over (row, roles so far), least audit first among equal costs: no matrices, no grammar."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    step = lambda state, r: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, r))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, state, text = heapq.heappop(heap)
        if k == len(rows) and state in ("", "a"):
            break
        if (k, state) in done:
            continue
        done.add((k, state))
        for r, name in (("u", "user"), ("a", "assistant")):
            if step(state, r):
                heapq.heappush(heap, (cost + 3, audit + "I", k, r, (*text, name + ":")))
        if k < len(rows):
            _, role, t = rows[k]
            heapq.heappush(heap, (cost + 4, audit + "D", k + 1, state, text))
            if faults[k] not in ("blank", "duplicate"):
                more = 3 * (faults[k] == "truncated")
                if role[:1] and step(state, role[:1]):
                    heapq.heappush(heap, (cost + more, audit + "K", k + 1, role[:1], (*text, f"{role}:{t}")))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if step(state, r):
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", k + 1, r, (*text, f"{name}:{t}")))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())


def compare(got, rows):
    want = sorted([(c, *repaired_by_hand(r)) for c, r in damaged_by_hand(rows).items()], key=lambda r: (r[0] is not None, r[0] or 0))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = sorted(map(tuple, got.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == w
    return got


def odd_conversations(seed, convs, most):
    rng = random.Random(seed)
    texts = ["fine.", "so?", "no end", "", " \t", "yes!", None, "é.", "long " * 50 + ".", "end. \n"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "usher", "User"]
    rows = []
    for c in [*range(convs), None]:
        n = rng.randint(1, most)
        role = rng.choice([["user", "assistant"], roles])
        for t in range(n):
            rows.append((c, rng.choice([t, t, t, t + 5, None, -3]), role[t % 2] if len(role) == 2 else rng.choice(role), rng.choice(texts)))
    return rows + rows[:9] + rows[3:5]


@pytest.mark.parametrize("segment", [4096, 3])
def test_repair(spark, monkeypatch, segment):
    """Short segments make most conversations pass through the joining of segments."""
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = odd_conversations(3, 150, 12)
    frame = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA).repartition(5)
    compare(repair.repair_report(repair.damaged(frame.drop("copies"))), rows)


def test_one_long_conversation(spark, monkeypatch):
    """A third of all rows in one conversation, in many segments and partitions."""
    monkeypatch.setattr(repair, "SEGMENT", 50)
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["a b.", "c", "d?"]) + rng.choice(["", f" {t}."])) for t in range(1500)]
    rows += [(c, t, ["user", "assistant"][t % 2], f"t {t}.") for c in range(100, 600) for t in range(6)]
    compare(repair.repair_report(repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))), rows)


def test_grammar_agrees_with_single_turns():
    rng = random.Random(1)
    g = repair.Grammar()
    for pair in ("ua", "UA", "bd", "uu"):
        g.add(pair)
    g.add(g.rules[0][1] * 2)
    g.add(g.rules[4][1] + g.rules[1][1])
    plain = repair.Grammar()
    for _ in range(500):
        s = "".join(rng.choice("uauauauaUAsobd") for _ in range(rng.randint(0, 14)))
        assert g.rows(s) == plain.rows(s) and g.best(s) == plain.best(s)


def test_grammar_is_learned(spark):
    parts = spark.createDataFrame([("suauaua",), ("uauaua",), ("uaub",)] * 30, "symbols string")
    g = repair.learned(parts)
    assert g.rules[0][0] == "ua" and len(g.compress("uauauaua")) < 8


def test_empty_table_and_query(spark):
    rows = table(spark, "/root/testdata/sf0.001", "conversations")
    assert repair.repair_report(repair.damaged(rows.limit(0))).collect() == []
    compare(queries.QUERIES["op12_conversation_repair"](spark, "/root/testdata/sf0.001"), [tuple(r) for r in rows.collect()])
