import hashlib

import pytest
from pyspark.sql import functions as F

from tablecraft.llm import imatch
from tablecraft.llm.queries import queries
from tablecraft.llm.text import lowered_words, table


@pytest.fixture(scope="module")
def result(spark, small):
    return {r["doc_id"]: r for r in queries()["op3_document_fingerprints"](spark, small).collect()}


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, small, "documents").collect()}


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def test_edited_texts(result, texts):
    ids = sorted(texts)
    assert sorted(result) == ids
    for i, following in zip(ids, ids[1:] + ids[:1]):
        changed = edited(texts[i], texts[following]).encode()
        assert result[i]["n_chars"] == len(texts[i])
        assert result[i]["edited_sha256"] == hashlib.sha256(changed).hexdigest()


def test_fingerprints_depend_on_lexicon_terms_only(spark, result, texts):
    """A fingerprint stands for the text's terms in each subset of the lexicon."""
    docs = len(texts)
    words = {i: set(lowered_words(t)) for i, t in texts.items()}
    frequency = {}
    for found in words.values():
        for word in found:
            frequency[word] = frequency.get(word, 0) + 1
    band = {w for w, n in frequency.items() if imatch.LOW * docs <= n <= imatch.HIGH * docs}
    whole = {}
    for i, found in words.items():
        key = frozenset(found & band) or frozenset(found)
        whole.setdefault(result[i]["fingerprint"][:8], set()).add(key)
    assert all(len(keys) == 1 for keys in whole.values())
    by_text = {}
    for i, text in texts.items():
        by_text.setdefault(text, set()).add(result[i]["fingerprint"])
    assert all(len(prints) == 1 for prints in by_text.values())


def test_likeness(result, texts):
    ids = sorted(texts)
    for i, following in zip(ids, ids[1:] + ids[:1]):
        row = result[i]
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        same = row["fingerprint"] == result[following]["fingerprint"]
        assert (row["near_next"] == 1.0) == same
        assert (row["near_edited"] == 1.0) == (row["fingerprint"] == row["edited_fingerprint"])
    long = [result[i] for i in ids if len(texts[i]) > 500]
    nearer = sum(r["near_edited"] > r["near_next"] for r in long)
    assert nearer > 0.85 * len(long)


def test_edge_cases(spark, edge_docs, no_docs, monkeypatch):
    assert imatch.fingerprints(no_docs).count() == 0
    one = imatch.fingerprints(edge_docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    expected = imatch.fingerprints(edge_docs).collect()
    assert len(expected) == edge_docs.count()
    copies = [r["fingerprint"] for r in expected if r["doc_id"] in (1, 2)]
    assert len(copies) == 3 and len(set(copies)) == 1
    blank = {r["fingerprint"] for r in expected if r["doc_id"] in (3, 4, 5)}
    assert len(blank) == 1
    # many buckets give what one bucket gives
    monkeypatch.setattr(imatch, "BUCKET_ROWS", 2)
    again = imatch.fingerprints(edge_docs).collect()
    assert sorted(again, key=repr) == sorted(expected, key=repr)


def test_next_document_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(imatch, "BUCKET_ROWS", 3)
    ids = [*range(-50, 50, 7), *range(10**6, 10**6 + 40), 10**12]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    rows = imatch.with_next(docs).where(~F.col("guest")).collect()
    following = {r["doc_id"]: r["next_text"] for r in rows}
    ids.sort()
    assert following == {a: f"text {b}" for a, b in zip(ids, ids[1:] + ids[:1])}


def test_text_is_shuffled_once(spark, small):
    docs = table(spark, small, "documents")
    plan = imatch.with_next(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
