import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tablecraft.llm import language_id
from tablecraft.llm.queries import queries


def test_held_out_accuracy(spark, small):
    rows = queries()["op1_language_id"](spark, small).collect()
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"] and docs[r["doc_id"]]]
    right = sum(r["lang_pred"] == docs[r["doc_id"]] for r in held)
    assert right >= 0.97 * len(held) > 20


def plain_buckets(text):
    """The n-grams of a text, found letter by letter."""
    letters = "".join(c if c.isalpha() else "\0" for c in text.lower())
    padded = "\0" + letters + "\0"
    kept = padded[0] + "".join(b for a, b in zip(padded, padded[1:]) if (a, b) != ("\0", "\0"))
    found = Counter()
    for order in language_id.ORDERS:
        for i in range(len(kept) - order + 1):
            gram = kept[i : i + order]
            if gram.strip("\0"):
                found[gram] += 1
    return found


@pytest.mark.parametrize("text", ["Ab c", "  x1y\n\n", "éÉ ß, ü!", "日本 \U0001f600 a", ""])
def test_ngrams(text):
    parts = list(language_id.ngram_buckets(text))
    found = np.concatenate(parts) if parts else []
    assert len(found) == sum(plain_buckets(text).values())
    assert len(set(found)) == len(plain_buckets(text))


def test_long_texts_lose_no_ngrams(monkeypatch):
    text = "Wörter und noch mehr, words! " * 40
    whole = Counter(np.concatenate(list(language_id.ngram_buckets(text))).tolist())
    monkeypatch.setattr(language_id, "_CHUNK", 50)
    pieces = Counter(np.concatenate(list(language_id.ngram_buckets(text))).tolist())
    # pieces overlap a little, so that no n-gram is lost
    assert not whole - pieces
    assert sum((pieces - whole).values()) < 0.3 * sum(whole.values())


def test_scores_equal_brute_force(spark):
    texts = ["the cat", "a dog and the cat", "der hund und", "die katze", "le chat", "un chien et le"]
    langs = ["en", "en", "de", "de", "fr", "fr"]
    docs = spark.createDataFrame(
        [(i, t, lang) for i, t, lang in zip(range(100, 106), texts, langs)],
        "doc_id long, text string, lang string",
    )
    model = language_id.train(docs)
    held = {i for i in range(100, 106) if zlib.crc32(str(i).encode()) % 4 == 2}
    seen = {}
    for i, (text, lang) in enumerate(zip(texts, langs), 100):
        if i not in held:
            seen.setdefault(lang, Counter()).update(
                np.concatenate(list(language_id.ngram_buckets(text))).tolist()
            )
    assert model.languages == sorted(seen)
    for r in language_id.predict(docs, model).collect():
        found = np.concatenate(list(language_id.ngram_buckets(texts[r["doc_id"] - 100]))).tolist()
        total = {
            lang: sum(
                math.log((counts[b] + 0.5) / (sum(counts.values()) + 0.5 * language_id.BUCKETS))
                for b in found
            )
            for lang, counts in seen.items()
        }
        assert r["lang_pred"] == max(total, key=total.get)


def test_edge_cases(edge_docs, no_docs):
    rows = language_id.identify(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"]}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (3, 4, 5))
    assert by_id[6]["lang_pred"] in ("en", "de", "fr")
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert language_id.identify(no_docs).count() == 0
    unknown = language_id.identify(edge_docs.where("lang IS NULL")).collect()
    assert {r["lang_pred"] for r in unknown} == {"und"}
