import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablecraft.llm import packing
from tablecraft.llm.queries import queries
from tablecraft.llm.text import table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encode():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def naive_best_fit(lengths, capacity):
    free = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(free) if room >= length]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= length
        else:
            free.append(capacity - length)
    return len(free)


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_as_few_sequences_as_best_fit(seed):
    random.seed(seed)
    top = random.choice([64, 20, 40])
    lengths = [min(64, max(1, int(random.expovariate(1 / top)))) for _ in range(700)]
    counts = Counter(lengths)
    plan = packing.best_fit_plan(counts, 64)
    used = Counter()
    places = []
    for length, rank, count, first, offset in zip(*plan):
        for i in range(count):
            used[int(length)] += 1
            places.append((int(first) + i, int(offset), int(length)))
    assert used == counts
    ends = {}
    for sequence, offset, length in sorted(places):
        assert ends.get(sequence, 0) == offset  # gapless, no overlap
        ends[sequence] = offset + length
    assert max(ends.values()) <= 64
    assert len(ends) == naive_best_fit(lengths, 64)
    assert set(ends) == set(range(len(ends)))


def test_plan_size_does_not_grow_with_the_counts():
    few = packing.best_fit_plan({n: 3 for n in range(1, 2049)})
    many = packing.best_fit_plan({n: 3 * 10**9 for n in range(1, 2049)})
    assert len(many.length) < 40_000 and len(many.length) <= 4 * len(few.length)
    assert int(many.count.sum()) == 3 * 10**9 * 2048


def test_edge_texts_keep_their_ids(edge_docs, encode):
    pieces = packing.tokenize(edge_docs, VOCABULARY, capacity=100)
    whole = {}
    for row in sorted(pieces.collect(), key=lambda r: (str(r["doc_id"]), r["start"])):
        ids = np.frombuffer(row["ids"], "<u4").tolist()
        assert len(ids) == row["length"] <= 100 and row["start"] == 100 * row["piece"]
        if row["doc_id"] not in (None, 2):  # these have several rows
            whole.setdefault(row["doc_id"], []).extend(ids)
    for row in edge_docs.collect():
        if row["doc_id"] not in (None, 2):
            assert whole[row["doc_id"]] == encode(row["text"])


def test_tokens_of_all_documents(spark, small, encode):
    docs = table(spark, small, "documents")
    pieces = packing.tokenize(docs, VOCABULARY).collect()
    whole = {}
    for row in sorted(pieces, key=lambda r: (r["doc_id"], r["piece"])):
        whole.setdefault(row["doc_id"], []).extend(np.frombuffer(row["ids"], "<u4").tolist())
    for row in docs.collect():
        assert whole[row["doc_id"]] == encode(row["text"])


def check_layout(rows, capacity=2048):
    ends = {}
    for row in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends.get(row["sequence_id"], 0) == row["offset"]
        ends[row["sequence_id"]] = row["offset"] + row["length"]
    assert not ends or max(ends.values()) <= capacity
    return len(ends)


def test_query(spark, small, encode):
    rows = queries()["op4_best_fit_packing"](spark, small).collect()
    sequences = check_layout(rows)
    lengths = [r["length"] for r in rows]
    assert sequences <= naive_best_fit(lengths, 2048)
    texts = {r["doc_id"]: r["text"] for r in table(spark, small, "documents").collect()}
    for row in rows:
        ids = encode(texts[row["doc_id"]])[row["start"] :][: row["length"]]
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sum(lengths) == sum(len(encode(t)) for t in texts.values())


def test_packing_of_edge_cases(edge_docs, no_docs):
    pieces = packing.tokenize(edge_docs, VOCABULARY)
    rows = packing.pack(pieces.drop("ids")).collect()
    check_layout(rows)
    assert len(rows) == pieces.count()
    assert packing.pack(packing.tokenize(no_docs, VOCABULARY).drop("ids")).count() == 0


def test_assembled_sequences(edge_docs, encode):
    docs = edge_docs.where("doc_id > 2").dropDuplicates(["doc_id"])
    pieces = packing.tokenize(docs, VOCABULARY)
    placed = packing.pack(pieces.drop("ids"))
    joined = packing.assemble(pieces, placed).collect()
    total = sum(len(encode(r["text"])) for r in docs.collect())
    assert sum(len(r["ids"]) // 4 for r in joined) == total == sum(r["length"] for r in joined)
    where = {(r["doc_id"], r["piece"]): r for r in placed.collect()}
    ids = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in joined}
    for row in pieces.collect():
        place = where[row["doc_id"], row["piece"]]
        part = ids[place["sequence_id"]][place["offset"] :][: place["length"]]
        assert part.tobytes() == bytes(row["ids"])


def test_lengths_out_of_range_are_refused(spark):
    pieces = spark.createDataFrame([(1, 0, 0, 3000)], "doc_id long, piece int, start long, length long")
    with pytest.raises(ValueError):
        packing.pack(pieces)
