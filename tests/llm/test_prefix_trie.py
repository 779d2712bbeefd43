"""The prefix trie against a plain one, and its defined cases."""

from __future__ import annotations

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from feira.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(rows) -> dict[int, tuple]:
    own: dict[int, list] = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = (*own.get(c - c % 100, [])[:h], *turns[h:])
    return made


def plain(rows) -> set[tuple]:
    convs = rebuilt(rows)
    members: dict[tuple, list[int]] = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    found = set()
    for path, ids in members.items():
        inside = [p for p in members if p[: len(path)] == path]
        children = lambda of: sum(len(p) == len(of) + 1 and p[: len(of)] == of for p in members)
        ends = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(path))))
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in inside if p)
        leaves = sum(children(p) == 0 for p in inside)
        found.add((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), children(path), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return found


def nodes(spark, rows, **more):
    given = spark.createDataFrame(rows, TURNS)
    for c, v in more.items():
        given = given.withColumn(c, F.lit(v))
    return prefix_trie.trie(prefix_trie.with_shared_beginnings(prefix_trie.digested_turns(given)))


def check(spark, rows, **more):
    found = nodes(spark, rows, **more).collect()
    assert {tuple(r[c] for c in COLUMNS) for r in found} == plain(rows) and len(found) == len(plain(rows))
    assert sorted(r["position"] for r in found) == list(range(1, len(found) + 1))
    return found


def test_ties_nulls_and_clashing_columns(spark):
    rows = [(100, 0, "user", "a"), (100, 1, None, "b"), (100, 1, "", "b"), (100, None, "system", None), (101, 0, "user", "x"), (102, 2, "user", "c"), (102, 2, "user", "c")]
    rows += [(c, t, "user", f"{t // 2}é") for c in (103, 104, 105, 250, -3, -250) for t in range(7)] + [(None, 0, "user", "lost"), (777, 0, None, None)]
    check(spark, rows, depth=1, k1="clash", place=3, rank=0)


def test_random_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 8)
    draw = random.Random(5)
    rows = [(c, t, draw.choice(["user", "assistant"]), draw.choice("ab")) for c in range(120) for t in range(draw.randrange(1, 9))]
    check(spark, rows)


def test_long_conversations_are_ranked_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    rows = [(c, t, "user", f"{t}" if t < stop else f"{c}-{t}") for c, n, stop in ((1, 23, 99), (2, 40, 17), (3, 41, 99), (4, 41, 99), (5, 4, 99), (6, 8, 7)) for t in range(n)]
    found = check(spark, rows)
    at = {r["position"]: r for r in found}
    assert all(r["subtree_end"] - r["position"] + 1 == sum(s["position"] >= r["position"] and s["position"] <= r["subtree_end"] for s in at.values()) for r in found)


def test_only_turnless_and_no_conversations(spark):
    turnless = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 2)
    found = check(spark, [(turnless, 0, "user", "gone")])
    assert [(r["depth"], r["n_convs"], r["n_leaves"]) for r in found] == [(0, 1, 1)]
    assert nodes(spark, [(None, 0, "user", "lost")]).count() == 0
