"""The prefix trie against a plain one built turn by turn."""

import hashlib
import random
import re
import zlib

import pytest

from knotwork.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn int, role string, text string"


def plain_rebuilt(rows):
    turns = {}
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = turns.get(c - c % 20, [])[:h] + own[h:]
    return out


def plain_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, mine in members.items():
        subtree = [k for k in members if k[: len(node)] == node]
        children = [k for k in subtree if len(k) == len(node) + 1]
        leaves = sum(not any(len(k) == len(s) + 1 and k[: len(s)] == s for k in subtree) for s in subtree)
        words = sum((len(members[s]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) for s in subtree if s)
        ends = ",".join(map(str, sorted(c for c in mine if len(convs[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(mine), len(node), parent, len(mine), len(children), leaves, words, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def conversations(seed=1):
    rng, rows = random.Random(seed), []
    for c in range(70):
        for t in range(rng.choice([1, 2, 3, 5, 6])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "hello  there\x0byou", "a b c", ""])))
    for c in range(200, 260):  # one conversation in many copies, and one that ends earlier
        rows += [(c, t, "user", f"same turn {t}") for t in range(9 if c % 7 else 4)]
    rows += [(300, t, "user", "long") for t in range(40)] + [(320, t, "user", "long") for t in range(33)]
    rows += [(c, 0, "user", "alone") for c in range(401, 420)]  # their conversation of the first turns is absent
    rows += [(41, None, None, None), (41, None, None, "x"), (41, 2, "user", None), (None, 1, "user", "nobody"), (63, 0, "b", "t"), (63, 0, "a", "t"), (63, 0, "a", "t")]
    return rows


def result(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[:2])


def test_query_equals_plain_trie(spark, tables):
    rows = conversations()
    assert any(not turns for turns in plain_rebuilt(rows).values())
    folder = tables(conversations=([(*r, 1) for r in rows], SCHEMA + ", depth int"))
    assert result(queries.op12_prefix_trie(spark, folder)) == plain_trie(plain_rebuilt(rows))


@pytest.mark.parametrize("primes", [(3, 2), (7, 1)])
def test_collisions_are_split(spark, primes):
    rng = random.Random(9)
    convs = {c: [("r", rng.choice("abc")) for _ in range(rng.randint(0, 6))] for c in range(40)}
    turns = spark.createDataFrame([(c, t, *turn) for c, ts in convs.items() for t, turn in enumerate(ts)], SCHEMA)
    every = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    assert result(prefix_trie.trie(turns.repartition(3), every, primes)) == plain_trie(convs)


def test_long_digests_and_empty_table(spark, tables, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    convs = {c: [("u", "x")] for c in range(-3, 100)} | {1000 + c: [("u", f"y{c}")] for c in range(5)}
    turns = spark.createDataFrame([(c, t, *turn) for c, ts in convs.items() for t, turn in enumerate(ts)], SCHEMA)
    assert result(prefix_trie.trie(turns)) == plain_trie(convs)
    assert queries.op12_prefix_trie(spark, tables(conversations=([], SCHEMA))).collect() == []
