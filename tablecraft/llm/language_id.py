"""Language identification: naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.llm.text import fold

FOLDS, HELD_OUT = 4, 2
ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
# Training texts of each language, drawn by a hash of the id; whole texts count.
TEXTS_PER_LANGUAGE = 20_000
# The matrix has a column per language: 256 KB for each.
MOST_LANGUAGES = 1000
SMOOTHING = 0.5
# N-grams of a text are not independent; so many of them count as one piece of
# evidence when probabilities are given.
EVIDENCE = 30.0
UNKNOWN = "und"
_CHUNK = 1 << 20
_BATCH = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_buckets(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a text, in chunks of bounded size.

    Letters are lower-cased and everything else is a gap, of which one is kept
    between words; n-grams without a letter don't count. No letter, no n-gram.
    """
    longest = max(ORDERS)
    text = text or ""
    for start in range(0, len(text), _CHUNK):
        part = text[max(0, start - 1) : start + _CHUNK + longest].lower()
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.where(_letters()[codes], codes, 0)
        padded = np.concatenate([[0], codes, [0]]).astype(np.uint64)
        kept = padded[np.concatenate([[True], (padded[1:] != 0) | (padded[:-1] != 0)])]
        value = np.zeros(len(kept), np.uint64)
        found = []
        for order in range(1, longest + 1):
            if len(kept) < order:
                break
            value = value[: len(kept) - order + 1] * np.uint64(0x110001) + kept[order - 1 :] + np.uint64(1)
            if order in ORDERS:
                some = kept[order - 1 :] != 0
                for back in range(1, order):
                    some = some | (kept[order - 1 - back : len(kept) - back] != 0)
                mixed = (value[some] + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(32)
                mixed *= np.uint64(0xD6E8FEB86659FD93)
                found.append((mixed >> np.uint64(48)).astype(np.int64))
        if found:
            yield np.concatenate(found)


class Model(NamedTuple):
    languages: list[str]
    log_chance: np.ndarray  # BUCKETS x languages


def train(docs: DataFrame) -> Model:
    """Log-probabilities of the buckets in each language.

    Learns from rows of ``docs`` with a language whose id is not held out, up to
    about TEXTS_PER_LANGUAGE of each; tasks add up their counts, and the driver
    gets a row per bucket and language at most. Languages weigh alike.
    """
    usable = docs.where(
        (fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull()
    ).select(F.col("doc_id").cast("long"), F.col("lang").cast("string").alias("lang"), "text")
    sizes = dict(usable.groupBy("lang").count().collect())
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"{len(sizes)} languages; at most {MOST_LANGUAGES}")
    languages = sorted(sizes)
    number = {lang: i for i, lang in enumerate(languages)}
    share = F.lit(0.0)
    for lang, size in sizes.items():
        share = F.when(F.col("lang") == lang, TEXTS_PER_LANGUAGE / size).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for buckets in ngram_buckets(text.as_py()):
                    counts[number[lang]] += np.bincount(buckets, minlength=BUCKETS)
        cell = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cell), pa.array(counts.ravel()[cell])], ["cell", "n"]
        )

    rows = (
        usable.where(draw < share)
        .select("lang", "text")
        .mapInArrow(count, "cell long, n long")
        .groupBy("cell")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    counts = np.full(len(languages) * BUCKETS, SMOOTHING)
    counts[rows.column("cell").to_numpy()] += rows.column("n").to_numpy()
    counts = counts.reshape(len(languages), BUCKETS)
    chance = np.log(counts / counts.sum(1, keepdims=True))
    return Model(languages, np.ascontiguousarray(chance.T, dtype=np.float32))


def _batch_scores(model: Model, texts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of log-probabilities and numbers of n-grams of some texts.

    The n-grams are one sparse matrix in row form: buckets in a row, and where
    each text starts.
    """
    rows = [np.concatenate(parts) for parts in texts]
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.add.reduceat(model.log_chance[np.concatenate(rows)], starts, axis=0), sizes


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs``.

    The prediction depends on the text only. A null text, one without a letter,
    and any text if there is no language to learn, gives ``und`` with score 0.
    A null id is not held out; repeated rows are predicted alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    count = len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            names = [UNKNOWN] * batch.num_rows
            scores = np.zeros(batch.num_rows)
            waiting: list[tuple[int, list[np.ndarray]]] = []
            size = 0

            def settle() -> None:
                sums, sizes = _batch_scores(known, [parts for _, parts in waiting])
                eased = sums / np.maximum(1.0, sizes / EVIDENCE)[:, None]
                chance = np.exp(eased - eased.max(1, keepdims=True))
                chance /= chance.sum(1, keepdims=True)
                for (row, _), best, value in zip(waiting, sums.argmax(1), chance):
                    names[row], scores[row] = known.languages[best], value[best]

            for row, text in enumerate(batch.column(2)):
                parts, own = [], 0
                for buckets in ngram_buckets(text.as_py()) if count else ():
                    parts.append(buckets)
                    own += len(buckets)
                    if own > _BATCH:  # a long text is added up by itself
                        break
                if own > _BATCH:
                    sums, total = 0.0, 0
                    for buckets in ngram_buckets(text.as_py()):
                        sums = sums + known.log_chance[buckets].sum(0, dtype=np.float64)
                        total += len(buckets)
                    eased = sums * (EVIDENCE / total)
                    chance = np.exp(eased - eased.max())
                    best = int(np.argmax(sums))
                    names[row] = known.languages[best]
                    scores[row] = chance[best] / chance.sum()
                elif own:
                    waiting.append((row, parts))
                    size += own
                    if size > _BATCH:
                        settle()
                        waiting, size = [], 0
            if waiting:
                settle()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names), pa.array(scores)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    held = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows of ``docs`` that are not held out, and predict all."""
    return predict(docs, train(docs))
