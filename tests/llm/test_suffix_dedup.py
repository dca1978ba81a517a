import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tablecraft.llm import suffix_dedup
from tablecraft.llm.queries import queries
from tablecraft.llm.text import table


def plain(texts, length):
    """``n_bytes, n_removed, n_spans, sha256`` of each text, from all windows."""
    texts = [(text or "").encode() for text in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    results = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        results.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return results


def results(frame):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


def expected(docs, length):
    rows = docs.collect()
    return sorted(
        ((r["doc_id"], *p) for r, p in zip(rows, plain([r["text"] for r in rows], length))),
        key=repr,
    )


def patchwork(seed, count):
    """Texts that share passages, overlap, repeat inside, and have long runs."""
    random.seed(seed)
    alphabet = ["ab", "é", "xyz ", "q", "\n"]
    passage = ["".join(random.choices(alphabet, k=random.randrange(20, 120))) for _ in range(8)]
    texts = []
    for _ in range(count):
        parts = []
        for _ in range(random.randrange(1, 5)):
            kind = random.random()
            if kind < 0.5:
                whole = random.choice(passage)
                cut = random.randrange(len(whole))
                parts.append(whole[cut:] if random.random() < 0.5 else whole)
            elif kind < 0.6:
                parts.append("x" * random.randrange(120))
            else:
                parts.append("".join(random.choices("abcdefghij", k=random.randrange(60))))
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize("pack", [4096, 2])  # 2: buckets are compared window by window
def test_whole_results_equal_brute_force(spark, monkeypatch, pack):
    monkeypatch.setattr(suffix_dedup, "PACK", pack)
    texts = [*patchwork(3, 60), None, "", "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = suffix_dedup.removals(docs, length=50, gram=16)
    assert results(found) == expected(docs, 50)


def test_edge_cases(spark, edge_docs):
    short = edge_docs.where("length(text) < 5000 OR text IS NULL")
    for length, gram in ((20, 8), (4, 4), (1, 1)):
        assert results(suffix_dedup.removals(short, length, gram)) == expected(short, length)


def test_long_periodic_text_goes_whole(edge_docs):
    rows = suffix_dedup.removals(edge_docs).where("doc_id = 6").collect()
    assert [(r["n_removed"], r["n_spans"]) for r in rows] == [(len(rows[0]["text"]), 1)]


def test_remove_repeats_keeps_columns_and_bytes(edge_docs):
    found = suffix_dedup.remove_repeats(edge_docs)
    assert found.columns == [*[c for c in edge_docs.columns if c != "kept"], "kept"]
    kept = {r["doc_id"]: r["kept"] for r in found.collect()}
    assert kept[6] == b"" and kept[3] == b"" and kept[7] == b"x"


def test_empty_table(no_docs):
    assert suffix_dedup.removals(no_docs).count() == 0


def test_every_window_is_in_one_run():
    texts = [t.encode() for t in [*patchwork(5, 20), "ab" * 100_000, "y" * 199]]
    starts = [[] for _ in texts]
    for text, start, count, _ in suffix_dedup.neighbourhoods(texts):
        for i, s, n in zip(text, start, count):
            starts[i].extend(range(s, s + n))
    assert [sorted(s) for s in starts] == [list(range(len(t) - 199)) for t in texts]


def test_refinement_equals_counting():
    random.seed(2)
    texts = [bytes(random.choices(b"ab", k=random.randrange(30, 90))) for _ in range(30)]
    seen = Counter(t[i : i + 13] for t in texts for i in range(len(t) - 12))
    hits = suffix_dedup.repeated_windows(texts, 13)
    for t, hit in zip(texts, hits):
        plain_hits = [i for i in range(len(t) - 12) if seen[t[i : i + 13]] > 1]
        assert np.array_equal(hit, plain_hits)


def test_query_over_the_small_table(spark, small):
    found = queries()["op13_suffix_array_dedup"](spark, small)
    assert results(found) == expected(table(spark, small, "documents"), 200)
