"""Conversation repair against a plain search over awkward and random rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewall.llm import conversations, queries

SF = "/root/testdata/sf0.01"
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
GRAMMAR = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def cheapest(rows):
    """(cost, audit, lines) by trying every edit at every row and place, last row first."""
    best = {}
    for at in range(len(rows), -1, -1):
        found = {}
        for place in ("", "s", "u", "a"):
            options = [(0, "", [])] if at == len(rows) and place in ("", "a") else []
            if at < len(rows):
                role, text, fault = rows[at]
                options.append((4 + best[at + 1, place][0], "D" + best[at + 1, place][1], best[at + 1, place][2]))
                if fault in ("", "truncated"):
                    more = 3 * (fault == "truncated")
                    if (place, role[:1]) in GRAMMAR:
                        cost, audit, lines = best[at + 1, GRAMMAR[place, role[:1]]]
                        options.append((more + cost, "K" + audit, [f"{role}:{text}", *lines]))
                    for new in ("user", "assistant"):
                        if (place, new[0]) in GRAMMAR:
                            cost, audit, lines = best[at + 1, new[0]]
                            options.append((3 + more + cost, "R" + audit, [f"{new}:{text}", *lines]))
            found[place] = options
        # Insertions join places of the same row; three rounds are enough for the longest useful chain.
        values = {p: min(o, default=(10**9, "", [])) for p, o in found.items()}
        for _ in range(3):
            values = {
                p: min([*o, *((3 + values[n[0]][0], "I" + values[n[0]][1], [f"{n}:", *values[n[0]][2]])
                              for n in ("user", "assistant") if (p, n[0]) in GRAMMAR)], default=(10**9, "", []))
                for p, o in found.items()
            }
        best |= {(at, p): v for p, v in values.items()}
    return best[0, ""]


def plain(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = by[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, kept in by.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged, count = set(), [], defaultdict(int)
        for turn, role, text in kept:
            solid = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"
            seen.add((role, text))
            count[fault] += 1
            judged.append((role, text, fault))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1] if a[1] and b[1] else "") not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit, lines = cheapest(judged)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest))
    return sorted(map(str, out))


def repaired(rows):
    return conversations.digests(conversations.repair(conversations.damaged(rows))).select(*NAMES)


def awkward():
    rng = random.Random(8)
    texts = ["Yes.", "No", "Why? ", "", " \t\r\n", None, "Well\x0b!", "ok…", "日本。", "a" * 20 + "x.", "a" * 20 + "y.", "Line\nend.", "x\x1c", "é"]
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", None, "User", "u", "support"]
    rows = []
    for conv in [*range(-3, 120), None]:
        turn = rng.choice([0, 0, 5, -4])
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 13])):
            rows.append((conv, turn if rng.random() < 0.95 else None, rng.choice(roles), rng.choice(texts)))
            turn += rng.choice([0, 1, 1, 1, 2, 40])
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(90)]
    rows += [(501, t, rng.choice(roles), rng.choice(texts)) for t in range(300)]
    rows += [(502, 1, "user", "The same.")] * 70 + [(502, 2, "user", "The same.")] * 30
    rows += [(503, None, "user", f"No turn {t}.") for t in range(40)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_repair_like_a_plain_search(spark):
    rows = awkward()
    assert sorted(map(str, map(tuple, repaired(spark.createDataFrame(rows, SCHEMA)).collect()))) == plain(rows)


def test_given_conversations(spark):
    table = queries.table(spark, SF, "conversations")
    got = queries.QUERIES["op12_repair_conversations"](spark, SF).select(*NAMES).collect()
    assert sorted(map(str, map(tuple, got))) == plain([tuple(r) for r in table.collect()])


@pytest.mark.parametrize("size", [1, 3, 7])
def test_long_conversations_in_pieces(spark, monkeypatch, size):
    """The same results where conversations fall into pieces of a few rows."""
    monkeypatch.setattr(conversations, "PIECE_ROWS", size)
    rows = [r for r in awkward() if r[0] is None or r[0] >= 495 or r[0] % 9 == 0]
    survey = conversations._survey
    # Tasks unpickle functions by name: the size travels with the closure here.
    def sized(batches, kind):
        conversations.PIECE_ROWS = size
        return survey(batches, kind)

    monkeypatch.setattr(conversations, "_survey", sized)
    table = spark.createDataFrame(rows, SCHEMA)
    parts = conversations.repair(conversations.damaged(table)).collect()
    assert max(sum(1 for p in parts if p["conv_id"] == c) for c in (500, 501)) >= 80 // size
    assert sorted(map(str, map(tuple, repaired(table).collect()))) == plain(rows)


def test_no_rows_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repaired(empty).count() == 0
    dropped = [(c, 0, "user", "Hi.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    out = repaired(spark.createDataFrame(dropped, SCHEMA)).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert len(dropped) > 5 and sorted(map(tuple, out)) == [(c, 0, 0, 0, 0, 0, 0, "", nothing) for c, *_ in dropped]
    rows = awkward()[:200]
    names = ("times", "mark", "digest", "prefix", "part", "piece", "whole", "cost", "audit", "symbols", "first")
    extra = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(7) for n in names})
    assert sorted(map(str, map(tuple, repaired(extra).collect()))) == plain(rows)
    texts = [(str(c) if c is not None else None, *rest) for c, *rest in rows]
    out = repaired(spark.createDataFrame(texts, "conv_id string, turn int, role string, text string")).collect()
    assert sorted(str(tuple(r)[1:]) for r in out) == sorted(str(tuple(r)[1:]) for r in repaired(spark.createDataFrame(rows, SCHEMA)).collect())
