"""The conversation trie against all prefixes, one by one."""

import hashlib
import random
import re
import zlib

import pytest

from reviewloom.llm import conversations

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, path string"


def brute_force(rows):
    """Every node of the rebuilt conversations, from sets of members of prefixes."""
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own.setdefault(conv_id, []).append(((turn is not None, turn or 0, role, tie), (role, text)))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[:len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[:len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        ends = ",".join(str(c) for c in sorted(convs) if whole[c] == node)
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children),
                    len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **options):
    frame = spark.createDataFrame([(*row, "clash", "clash") for row in rows], SCHEMA)
    nodes = conversations.prefix_trie(conversations.rebuilt(conversations.turn_sequences(frame)), **options)
    return sorted((tuple(r) for r in nodes.drop("key").collect()), key=str)


@pytest.mark.parametrize("container", [1, 3, 1000])
def test_against_all_prefixes(spark, container):
    """Many shared beginnings, long chains of heads, copies, ends inside of others."""
    r = random.Random(container)
    rows = []
    for c in r.sample(range(-40, 400), 150):
        kind = r.random()
        n = 30 if kind < 0.2 else r.randrange(8)
        text = (lambda t: f"long {t}") if kind < 0.2 else (lambda t: "a b" * r.randrange(3))
        rows += [(c, t, r.choice(("user", "bot")) if kind > 0.5 else "user", text(t)) for t in range(n)]
    assert found(spark, rows, container=container) == brute_force(rows)


def test_edge_cases(spark):
    rows = [(1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (2, 5, "", ""), (3, 1, "b", "t"),
            (3, 1, "a", "u"), (3, 1, "a", "t"), (None, 0, "user", "gone"), (0, 0, "user", "word " * 100_000),
            (0, 1, "user", "é \U0001f600"), (21, 0, "r", "b"), (22, 0, "rb", "")]
    for container in (1, 100):
        assert found(spark, rows, container=container) == brute_force(rows)
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "a", "b")]) == []


def test_turnless(spark):
    """Conversations that lose all turns to a missing base are members of the root, and end there."""
    lost = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 1]
    rows = [(c, 0, "user", "x") for c in lost]
    got = found(spark, rows)
    assert got == brute_force(rows)
    assert got == [(lost[0], 0, None, len(lost), 0, 1, 0, hashlib.sha256(",".join(map(str, lost)).encode()).hexdigest())]


def test_hot_conversation(spark, monkeypatch):
    """Thousands of copies are one sequence, and their ids are hashed in chunks."""
    monkeypatch.setattr(conversations, "CHUNK", 1000)
    rows = [(20 * c, t, "user", f"t{t}") for c in range(3000) for t in range(3)]
    nodes = {x[1]: x for x in found(spark, rows)}
    ids = ",".join(str(20 * c) for c in range(3000))
    assert sorted(nodes) == [0, 1, 2, 3]
    assert nodes[3] == (0, 3, 0, 3000, 0, 1, 2999, hashlib.sha256(ids.encode()).hexdigest())
    assert nodes[0][3:7] == (3000, 1, 1, 3 * 2999)
