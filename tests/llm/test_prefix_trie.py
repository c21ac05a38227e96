"""The prefix trie against one built turn by turn."""

import hashlib
import zlib

import numpy as np
import pytest
from llm_fixtures import rows_of

from larder.llm.prefix_trie import numbered_turns, prefix_trie, share_beginnings

SCHEMA = "conv_id long, turn long, role string, text string, n long, depth string, a string, low string"


def brute(rows):
    own = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own.setdefault(conv, []).append((role or "", text or ""))
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - int(np.fmod(c, 100)), [])[:h] + own[c][h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = lambda p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(rebuilt[c]) == len(path)))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(convs), len(path), parent, len(convs), kids(path), sum(kids(p) == 0 for p in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", None) for r in rows], SCHEMA)


def built(df, block=4):
    return sorted(rows_of(prefix_trie(*share_beginnings(numbered_turns(df)), block=block)), key=str)


@pytest.mark.parametrize("block", [1, 3, 4, 64])
def test_trie_matches_one_built_turn_by_turn(spark, block):
    rng = np.random.default_rng(block)
    rows = []
    for c in [*range(0, 30), *range(95, 130), *range(-110, -90), 250, 251]:
        words = rng.integers(0, 2, int(rng.integers(1, 14)))
        rows += [(c, t, "user" if t % 2 else "assistant", f"turn {w}" + "é" * int(w)) for t, w in enumerate(words)]
    rows += [(c, t, "user", "always the same") for c in range(1000, 1040) for t in range(9)]  # one hot conversation
    assert built(table(spark, rows), block) == brute(rows)


def test_trie_edges(spark):
    rows = [(5, None, None, None), (5, 2, "user", ""), (5, 1, None, "x" * 50_000), (None, 1, "user", "no conversation"), (None, None, None, None)]
    rows += [(7, 0, "user", "a"), (7, 1, "user", "a"), (7, 2, "user", "a"), (300, 0, "u", "b"), (301, 0, "u", "b"), (301, 5, "u", "c"), (9, 0, "ab", "c"), (10, 0, "a", "bc")]
    assert built(table(spark, rows)) == brute(rows)
    turnless = [(301, 0, "u", "b")] if zlib.crc32(b"301") % 6 else [(302, 0, "u", "b")]
    assert built(table(spark, turnless)) == brute(turnless)  # no head: nothing is left but the root
    assert built(table(spark, rows[3:5])) == [] and built(table(spark, rows[:0]) if rows[:0] else table(spark, rows).where("false")) == []


def test_equal_turn_numbers_and_repeated_rows(spark):
    rows = [(c, 1, "user", "same") for c in (1, 2) for _ in range(7)] + [(3, 1, r, "tied") for r in "abcd"]
    df = table(spark, rows)
    assert sorted(rows_of(prefix_trie(*share_beginnings(numbered_turns(df))))) == sorted(rows_of(prefix_trie(*share_beginnings(numbered_turns(df.orderBy("role", "conv_id"))))))
    assert [r for r in built(df) if r[1] == 0][0][3] == 3


def test_one_long_conversation_is_numbered_in_pieces(spark):
    rows = [(100, t, "user", f"t{t % 50}") for t in range(9000)] + [(101, t, "user", f"t{t % 50}") for t in range(9005)]
    got = built(table(spark, rows))
    assert max(r[1] for r in got) == 9005 and sum(r[3] for r in got) == 9001 + 9006
    assert {r[3] for r in got if r[1] <= 9000} == {2} and {r[5] for r in got} == {1}
