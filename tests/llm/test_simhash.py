import random

import xxhash
from brute import components

from tablecraft.llm import simhash
from tablecraft.llm.components import connected_components
from tablecraft.llm.queries import queries
from tablecraft.llm.text import table


def plain_fingerprint(text, size):
    words = []
    for part in (text or "").translate({c: " " for c in range(9, 14)}).split(" "):
        if part:
            words.append("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in part))
    runs = [words[i : i + size] for i in range(max(1, len(words) - size + 1))] if words else []
    votes = [0] * 64
    for run in runs:
        value = xxhash.xxh64(" ".join(run).encode(), seed=42).intdigest()
        for bit in range(64):
            votes[bit] += value >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * votes[bit] > len(runs))


def test_fingerprints_of_edge_cases(edge_docs):
    found = [(r["doc_id"], r["fp"] % 2**64) for r in simhash.fingerprints(edge_docs).collect()]
    expected = [(r["doc_id"], plain_fingerprint(r["text"], 3)) for r in edge_docs.collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_components_of_edge_cases(edge_docs):
    rows = simhash.simhash_components(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    found = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
    assert found[1] == found[2] == 1  # copies, one of them repeated
    assert found[3] == found[4] == found[5] == 3  # no words: fingerprint 0
    assert found[6] == 6
    nulls = [r["component_id"] for r in rows if r["doc_id"] is None]
    assert sorted(nulls, key=repr) == [3, None]  # the null text joins the empty ones


def test_empty_table(no_docs):
    result = simhash.simhash_components(no_docs)
    assert result.columns == ["doc_id", "fp", "component_id"]
    assert result.count() == 0
    assert simhash.keep_first(no_docs, result).columns == no_docs.columns


def test_links_connect_what_brute_force_connects(spark):
    random.seed(5)
    values = {random.getrandbits(64) for _ in range(600)}
    for value in list(values)[:200]:  # chains, stars and a dense ball
        for _ in range(random.randrange(4)):
            value ^= 1 << random.randrange(64) ^ random.choice([0, 1 << random.randrange(64)])
            values.add(value % 2**64)
    center = random.getrandbits(64)
    values |= {center ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    expected = components(signed, lambda a, b: ((a ^ b) % 2**64).bit_count() <= 2)
    groups = {}
    for value, smallest in expected.items():
        groups.setdefault(smallest, set()).add(value)
    expected_groups = {frozenset(g) for g in groups.values() if len(g) > 1}
    for cell_rows in (20_000, 150, 4):  # 0, 2 and 4 levels
        links = simhash.hamming_links(frame, 2, cell_rows)
        found = {}
        for row in connected_components(links).collect():
            found.setdefault(row["root"], set()).add(row["node"])
        assert {frozenset(g) for g in found.values()} == expected_groups
    assert simhash.cell_levels(len(signed), 150) == 2
    assert simhash.cell_levels(len(signed), 4) == 4


def test_cell_search_uses_the_tree(spark):
    random.seed(6)
    values = [random.getrandbits(64) for _ in range(1500)]
    values += [v ^ (1 << random.randrange(64)) for v in values[:300]]
    import numpy as np

    fps = np.array(values, np.uint64).view(np.int64)
    pairs = {
        tuple(sorted((int(a), int(b))))
        for i, j in simhash.near_pairs(fps, fps, 2)
        for a, b in zip(i, j)
        if a != b
    }
    brute = {
        (a, b)
        for b in range(len(values))
        for a in range(b)
        if (values[a] ^ values[b]).bit_count() <= 2
    }
    assert pairs == brute


def test_paths_and_stars_contract(spark):
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    loops = [(5000, 5000), (None, 3)]
    edges = spark.createDataFrame(path + star + loops, "a long, b long")
    roots = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert len({roots[n] for n in range(301)}) == 1
    assert len({roots[1000 + i] for i in range(200)}) == 1
    assert roots[0] != roots[1000] and 5000 not in roots
    none = connected_components(spark.createDataFrame([], "a long, b long"))
    assert none.count() == 0


def test_query_equals_brute_force(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").collect()]
    prints = {i: plain_fingerprint(t, 3) for i, t in docs}
    expected = components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    rows = queries()["op10_simhash_near_dedup"](spark, small).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows} == {
        (i, f"{prints[i]:016x}", expected[i]) for i in prints
    }


def test_keep_first_keeps_one_row_per_group(edge_docs):
    groups = simhash.simhash_components(edge_docs)
    kept = simhash.keep_first(edge_docs, groups)
    assert kept.columns == edge_docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == [1, 3, 6, 7, 8, 9, 10, 11]
    assert kept.where("doc_id IS NULL").count() == 2
