import zlib

import numpy as np
import pyarrow as pa

from tablecraft.llm import quality_model
from tablecraft.llm.queries import queries


def test_held_out_ranking(spark, small):
    rows = queries()["op6_quality_classifier"](spark, small).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    known = [(r["score"], labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels]
    good = [s for s, y in known if y == 1]
    bad = [s for s, y in known if y == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.95


def test_shapes():
    assert quality_model.shape("Then") == "Xx"
    assert quality_model.shape("STOP!!") == "X!"
    assert quality_model.shape("a1b2,") == "x9x9,"


def plain_tokens(text):
    found = []
    for word in (text or "").encode().split():
        word = word.decode()
        letters = "".join(c for c in word if c.isalpha()).lower() or word
        for key in (letters, "shape " + quality_model.shape(word)):
            found.append(zlib.crc32(key.encode()) % quality_model.BUCKETS)
    return found


def test_tokens_of_edge_cases(monkeypatch, edge_docs):
    texts = [r["text"] for r in edge_docs.collect()] + [" a\x1cb ", "é\u00a0x", "\n\n"]
    for size in (1 << 22, 100, 1):
        monkeypatch.setattr(quality_model, "_TEXT_BYTES", size)
        found = [part.tolist() for part in quality_model.tokens(pa.array(texts, pa.string()))]
        assert found == [plain_tokens(text) for text in texts]
    assert list(quality_model.tokens(pa.array([], pa.string()))) == []


def test_neighbours_are_added_up(monkeypatch):
    index = quality_model._index_vectors()
    assert (np.abs(index).sum(1) == quality_model.MARKS).all()
    random = np.random.default_rng(1)
    texts = [random.integers(0, 50, size) for size in (1, 2, 9, 40)]
    sums = np.zeros((quality_model.BUCKETS, quality_model.DIMENSIONS), np.int64)
    quality_model._add(sums, index, texts)
    expected = np.zeros_like(sums)
    reach = 2 * quality_model.WINDOW
    for text in texts:
        for i, bucket in enumerate(text):
            for j in range(max(0, i - reach), min(len(text), i + reach + 1)):
                if i != j:
                    expected[bucket] += index[text[j]]
    assert (sums == expected).all()


def test_network_learns_and_is_calibrated():
    random = np.random.default_rng(2)
    x = random.normal(size=(2000, 6))
    chance = 1 / (1 + np.exp(-3 * x[:, 0] * x[:, 1]))
    y = (random.random(2000) < chance).astype(float)
    layers, temperature = quality_model.fit_network(x, y)
    _, out = quality_model._forward(layers, x)
    predicted = quality_model._sigmoid(out / temperature)
    assert ((predicted > 0.5) == (chance > 0.5)).mean() > 0.85
    high = predicted > 0.8
    assert abs(predicted[high].mean() - y[high].mean()) < 0.1
    again, same = quality_model.fit_network(x, y)
    assert same == temperature and all((a == b).all() for a, b in zip(layers, again))


def test_edge_cases(spark, edge_docs, no_docs):
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 0, 1), (None, 1, 0), (7, None, 0), (8, 5, 0), (99, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    rows = quality_model.classify(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    blank = {r["score"] for r in rows if r["doc_id"] in (3, 4, 5)}
    assert len(blank) == 1
    assert quality_model.classify(edge_docs, labels.where("false")).count() == len(rows)
    assert quality_model.classify(no_docs, labels).count() == 0
