"""The conversation trie against brute force over whole prefixes."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import pytest

from crewledger.llm import conversation_trie, queries
from tests.compare import connect, differences

SCHEMA = "conv_id long, turn long, role string, text string, c long, owner string, depth string, turns string, k1 string"
FOLDER = "/root/testdata/sf0.001"


def brute(rows):
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    conv = {}
    for c in by:
        by[c].sort()
    for c in by:
        h = zlib.crc32(str(c).encode()) % 6
        conv[c] = tuple(t[2:] for t in by.get(c - c % 100, [])[:h] + by[c][h:])
    members, kids = collections.defaultdict(list), collections.defaultdict(set)
    for c, turns in conv.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                kids[turns[: d - 1]].add(turns[:d])
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in kids[s]) if kids[s] else 1
        saved[s] = (len(members[s]) - 1) * (len(s[-1][1]) if s else 0) + sum(saved[k] for k in kids[s])
    return sorted(
        (min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids[s]), leaves[s], saved[s],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(conv[c]) == len(s)).encode()).hexdigest())
        for s, m in members.items())


def found(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "o", "d", "t", "k") for r in rows], SCHEMA).repartition(4)
    return sorted(map(tuple, conversation_trie.prefix_trie(docs).collect()), key=lambda r: r[:2])


def test_trie_against_brute_force(spark, monkeypatch):
    """Copies, hot first turns, conversations over many stretches, nulls, missing lenders, repeated rows; small tries and stretches."""
    monkeypatch.setattr(conversation_trie, "TRIE_TURNS", 300)
    monkeypatch.setattr(conversation_trie, "STRETCH", 16)
    r = random.Random(4)
    rows = [(c, t if t else None, r.choice(["u", "a", None]), r.choice(["x", "yy", None, "é漢"]))
            for c in range(420) if c != 300 for t in range(r.randrange(1, 9))]
    rows += [(900, t, "u", f"z{t % 3}") for t in range(150)] + [(901, t, "u", f"z{t % 3}") for t in range(140)]
    rows += [(c, t, "u", "same") for c in range(1000, 1060) for t in range(7)]
    rows += [(None, 1, "u", "nobody"), (77, 3, "a", "again"), (77, 3, "a", "again"), (5_000_000_000, 1, "u", "w" * 50_000)]
    assert found(spark, rows) == brute(rows)


def test_one_turnless_conversation(spark):
    c = next(n for n in range(101, 200) if zlib.crc32(str(n).encode()) % 6 == 5)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    assert found(spark, rows) == brute(rows) and len(brute(rows)) == 1
    assert found(spark, []) == []


def test_two_fattest():
    for low in range(40):
        for high in range(low + 1, 60):
            assert conversation_trie.two_fattest(low, high) == max(range(low + 1, high + 1), key=lambda n: n & -n)


@pytest.mark.parametrize("seed", range(6))
def test_z_fast_trie_holds_every_prefix(seed, monkeypatch):
    """Edges expanded give each prefix once; handles lie on their edges; what was put in is found where it ends."""
    monkeypatch.setattr(conversation_trie, "BATCH", 7)
    r = random.Random(seed)
    strings = ["".join(r.choice("ab") for _ in range(r.randrange(1, 25))) for _ in range(60)] + ["a" * 40, "a" * 39, "a" * 40]
    keys = [[s[:d] for d in range(len(s) + 1)] for s in strings]
    trie = conversation_trie.ZFastTrie([0] * len(keys), keys)
    ends = trie.insert_all()
    expanded = [keys[trie.like[v]][d] for v in range(len(trie.like)) for d in range(trie.top[v] + 1, trie.extent[v] + 1)]
    assert sorted(expanded) == sorted({s[:d] for s in strings for d in range(1, len(s) + 1)})
    for (depth, key), node in trie.handles.items():
        assert trie.top[node] < depth <= trie.extent[node] and keys[trie.like[node]][depth] == key
    for n, s in enumerate(strings):
        assert trie.exit(n) == (ends[n], len(s)) and keys[trie.like[ends[n]]][trie.extent[ends[n]]] == s


def test_query_against_sql(spark):
    run, sql = queries.queries()["op13_conversation_trie"], queries.oracle_sql()["op13_conversation_trie"]
    assert differences(run, sql, spark, connect(FOLDER), FOLDER) is None
