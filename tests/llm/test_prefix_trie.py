import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tablecraft.llm import prefix_trie
from tablecraft.llm.queries import queries
from tablecraft.llm.text import table

SCHEMA = "conv_id long, turn long, role string, text string, key string, size long, depth long"


def plain_sequences(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in convs.items()}


def plain_heads(convs):
    rebuilt = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = convs.get(base, [])[:h] + turns[h:]
    return rebuilt


def plain_nodes(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)

    def subtree(node):
        todo = [node]
        while todo:
            one = todo.pop()
            yield one
            todo.extend(children[one])

    rows = []
    for node, own in members.items():
        below = list(subtree(node))
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(c for c in own if len(convs[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        rows.append((min(own), len(node), parent, len(own), len(children[node]),
                     sum(not children[n] for n in below), saved,
                     hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def nodes(frame):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
             "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)


def branching(seed, count):
    random.seed(seed)
    rows = []
    for c in random.sample(range(-50, 20_000), count):
        for turn in range(random.choice([0, 1, 2, 3, 5, 9, 17, 40])):
            text = random.choice(["hi", "é", ""]) if random.random() < 0.9 else f"{c} {turn}"
            rows.append((c, turn, random.choice(["user", None]) if turn > 3 else "user", text))
    return rows


@pytest.mark.parametrize("shard, pack", [(2048, 4096), (3, 2)])  # small: many upper nodes
def test_nodes_equal_brute_force(spark, monkeypatch, shard, pack):
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    monkeypatch.setattr(prefix_trie, "PACK", pack)
    rows = branching(1, 150) + [(c, t, "user", "same") for c in range(7000, 7040) for t in range(6)]
    turns = prefix_trie.turn_sequences(frame(spark, rows))
    plain = plain_sequences(rows)
    assert nodes(prefix_trie.prefix_nodes(turns)) == plain_nodes(plain)
    rebuilt = prefix_trie.with_shared_heads(turns)
    assert nodes(prefix_trie.prefix_nodes(rebuilt)) == plain_nodes(plain_heads(plain))


def test_edge_cases(spark):
    """Null ids, turns, roles and texts; repeated rows; a long text; clashing columns."""
    rows = [
        (None, 1, "user", "lost"),
        (1, 2, "user", "second"),
        (1, None, "user", "first"),
        (1, 2, "user", "second"),
        (2, 1, None, None),
        (3, 1, "", ""),
        (4, 1, "us", "er"),
        (6, 1, "user", ""),
        (5, 0, "user", "long " * 100_000),
        (10, None, None, "x"),
    ]
    turns = prefix_trie.turn_sequences(frame(spark, rows))
    plain = plain_sequences(rows)
    assert nodes(prefix_trie.prefix_nodes(turns)) == plain_nodes(plain)
    rebuilt = prefix_trie.with_shared_heads(turns)
    assert nodes(prefix_trie.prefix_nodes(rebuilt)) == plain_nodes(plain_heads(plain))


def test_empty_table(spark):
    turns = prefix_trie.turn_sequences(frame(spark, []))
    assert prefix_trie.prefix_nodes(prefix_trie.with_shared_heads(turns)).count() == 0


def test_many_equal_conversations_hash_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_BITS", 3)
    rows = [(c, 0, "user", "same") for c in range(-20, 60)]
    turns = prefix_trie.turn_sequences(frame(spark, rows))
    assert nodes(prefix_trie.prefix_nodes(turns)) == plain_nodes(plain_sequences(rows))


def test_double_array_finds_only_what_was_put_in():
    random.seed(4)
    trie, children = prefix_trie.DoubleArray(), {0: {}}
    for _ in range(300):
        parent = random.choice([s for s in children if not children[s]] or [0])
        if children[parent]:
            break
        symbols = np.array(sorted(random.sample(range(400), random.choice([1, 1, 2, 7]))))
        trie.place(parent, symbols)
        found = trie.step(np.full(len(symbols), parent), symbols).tolist()
        assert len(set(found)) == len(symbols) and not set(found) & set(children)
        children[parent] = dict(zip(symbols.tolist(), found))
        children.update({slot: {} for slot in found})
    for slot, known in children.items():
        found = trie.step(np.full(400, slot), np.arange(400)) if known else []
        assert {i: s for i, s in enumerate(found) if s >= 0} == known


def test_query_over_the_small_table(spark, small):
    rows = [tuple(r) for r in table(spark, small, "conversations").collect()]
    found = queries()["op12_prefix_trie"](spark, small)
    assert nodes(found) == plain_nodes(plain_heads(plain_sequences(rows)))
