"""Quality classifier: random-indexing word vectors and a two-layer network."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.llm.text import fold

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
# Words share this many vectors by a hash; the table is 8 MB.
BUCKETS = 1 << 15
DIMENSIONS = 64
# Marks other than 0 in a word's index vector, and neighbours on each side.
MARKS = 4
WINDOW = 2
# Labelled texts the network learns from, drawn by a hash of the id.
TRAIN_TEXTS = 20_000
HIDDEN = 32
EPOCHS = 60
SEED = 20
_TOKENS = 1 << 18
_TEXT_BYTES = 1 << 22
_REMEMBERED = 300_000
_FEATURES = 2 * DIMENSIONS + 4


def _index_vectors() -> np.ndarray:
    """A sparse random vector of -1, 0 and 1 for every bucket."""
    random = np.random.default_rng(SEED)
    vectors = np.zeros((BUCKETS, DIMENSIONS), np.int8)
    rows = np.arange(BUCKETS)[:, None]
    places = random.random((BUCKETS, DIMENSIONS)).argsort(1)[:, :MARKS]
    vectors[rows, places] = random.choice(np.array([-1, 1], np.int8), (BUCKETS, MARKS))
    return vectors


def shape(word: str) -> str:
    """Kinds of characters in a row: X upper, x lower or other letter, 9 digit."""
    kinds: list[str] = []
    for c in word:
        kind = ("X" if c.isupper() else "x") if c.isalpha() else "9" if c.isdigit() else c
        if not kinds or kinds[-1] != kind:
            kinds.append(kind)
    return "".join(kinds[:8])


class _Buckets(dict):
    """Buckets of a word and of its shape, as one number; forgets when full."""

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        letters = "".join(filter(str.isalpha, text)).lower() or text
        low = zlib.crc32(letters.encode("utf-8")) % BUCKETS
        high = zlib.crc32(b"shape " + shape(text).encode("utf-8")) % BUCKETS
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = found = low << 16 | high
        return found


_buckets = _Buckets()


def tokens(texts: pa.Array) -> Iterator[np.ndarray]:
    """Word and shape buckets in turn, a pair for each word, of one text after another.

    Texts are split together, and each distinct word of some is looked up once.
    """
    texts = texts.fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + _TEXT_BYTES, "right")))
        lists = pc.ascii_split_whitespace(texts.slice(at, to - at))
        words = lists.flatten().dictionary_encode()
        # Blanks at an end of a text leave an empty word there.
        known = [_buckets[word.encode()] if word else -1 for word in words.dictionary.to_pylist()]
        both = np.array(known, np.int64)[words.indices.to_numpy()]
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            found = both[start:end]
            found = found[found >= 0]
            yield np.stack([found >> 16, found & 0xFFFF], 1).ravel()
        at = to


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Random-indexing vectors of all buckets, of unit length, over all texts.

    A bucket's vector adds up the index vectors of what stands within WINDOW
    words of it, word shapes included. Tasks add up in a table of fixed size and
    the driver gets a row per bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index_vectors()
        sums = np.zeros((BUCKETS, DIMENSIONS), np.int64)
        waiting: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for found in tokens(batch.column(0)):
                for at in range(0, len(found), _TOKENS):
                    waiting.append(found[at : at + _TOKENS])
                    size += len(waiting[-1])
                    if size >= _TOKENS:
                        _add(sums, index, waiting)
                        waiting, size = [], 0
        if waiting:
            _add(sums, index, waiting)
        used = np.flatnonzero(sums.any(1))
        for at in range(0, len(used), 4096):
            part = used[at : at + 4096]
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(sums[part].ravel()), DIMENSIONS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), vectors.cast(pa.list_(pa.int64()))], ["bucket", "vector"]
            )

    added = (
        docs.select("text")
        .mapInArrow(count, "bucket long, vector array<long>")
        .groupBy("bucket")
        .agg(*(F.sum(F.get("vector", F.lit(i))).alias(f"v{i}") for i in range(DIMENSIONS)))
        .toArrow()
    )
    table = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    columns = [added.column(f"v{i}").to_numpy() for i in range(DIMENSIONS)]
    values = np.stack(columns, 1).astype(float)
    length = np.sqrt((values**2).sum(1, keepdims=True))
    table[added.column("bucket").to_numpy()] = values / np.maximum(length, 1e-9)
    return table


def _add(sums: np.ndarray, index: np.ndarray, texts: list[np.ndarray]) -> None:
    """Add the neighbours' index vectors of some texts' tokens to their buckets."""
    reach = 2 * WINDOW
    gap = np.full(reach, BUCKETS)
    joined = np.concatenate([part for text in texts for part in (text, gap)])
    # Equal pairs of neighbours are counted first, and an index vector has MARKS
    # places only, so few additions are left.
    pairs = [joined[:-step] * (BUCKETS + 1) + joined[step:] for step in range(1, reach + 1)]
    pairs = np.sort(np.concatenate(pairs))
    firsts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    times = np.diff(np.append(firsts, len(pairs))).astype(np.float64)
    one, other = np.divmod(pairs[firsts], BUCKETS + 1)
    real = (one < BUCKETS) & (other < BUCKETS)
    one, other = one[real], other[real]
    one, other = np.concatenate([one, other]), np.concatenate([other, one])
    times = np.tile(times[real], 2)
    places = np.argsort(index == 0, axis=1, kind="stable")[:, :MARKS]
    signs = np.take_along_axis(index, places, 1)
    cells = one[:, None] * DIMENSIONS + places[other]
    added = np.bincount(
        cells.ravel(), (signs[other] * times[:, None]).ravel(), minlength=BUCKETS * DIMENSIONS
    )
    sums += added.reshape(BUCKETS, DIMENSIONS).astype(np.int64)


def pooled(vectors: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Of a text's tokens: mean vector of its words, mean vector of their shapes, and its size.

    The last four: logarithm of the number of words, share of distinct ones, and
    the lengths of both means, which are large where few words are repeated.
    """
    if not len(found):
        return np.zeros(_FEATURES, np.float32)
    words, shapes = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    count = len(found) // 2
    for at in range(0, len(found), _TOKENS):
        part = found[at : at + _TOKENS]
        words += vectors[part[0::2]].sum(0)
        shapes += vectors[part[1::2]].sum(0)
    words, shapes = words / count, shapes / count
    distinct = len(np.unique(found[0::2])) / count
    more = [np.log1p(count), distinct, np.linalg.norm(words), np.linalg.norm(shapes)]
    return np.concatenate([words, shapes, more]).astype(np.float32)


class Model(NamedTuple):
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]  # weights and offsets of both layers
    temperature: float


def _forward(layers: tuple[np.ndarray, ...], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, first_offset, second, second_offset = layers
    hidden = np.tanh(x @ first + first_offset)
    return hidden, hidden @ second + second_offset


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray) -> tuple[tuple[np.ndarray, ...], float]:
    """Two layers by Adam on four fifths of the rows, temperature on the others."""
    random = np.random.default_rng(SEED)
    order = random.permutation(len(x))
    check, learn = order[: len(x) // 5], order[len(x) // 5 :]
    layers = [
        random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)),
        np.zeros(HIDDEN),
        random.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
        np.zeros(()),
    ]
    first, second = [np.zeros_like(v) for v in layers], [np.zeros_like(v) for v in layers]
    turn = 0
    for _ in range(EPOCHS):
        random.shuffle(learn)
        for at in range(0, len(learn), 256):
            rows = learn[at : at + 256]
            hidden, out = _forward(tuple(layers), x[rows])
            error = (_sigmoid(out) - y[rows]) / len(rows)
            back = np.outer(error, layers[2]) * (1 - hidden**2)
            steps = [x[rows].T @ back + 1e-4 * layers[0], back.sum(0), hidden.T @ error, error.sum()]
            turn += 1
            for i, step in enumerate(steps):
                first[i] = 0.9 * first[i] + 0.1 * step
                second[i] = 0.999 * second[i] + 0.001 * step**2
                rate = 0.003 / (np.sqrt(second[i] / (1 - 0.999**turn)) + 1e-8)
                layers[i] = layers[i] - rate * first[i] / (1 - 0.9**turn)
    temperature = 1.0
    if len(check):
        _, out = _forward(tuple(layers), x[check])
        grid = np.geomspace(0.25, 8, 61)
        chance = np.clip(_sigmoid(out[None, :] / grid[:, None]), 1e-9, 1 - 1e-9)
        loss = -(y[check] * np.log(chance) + (1 - y[check]) * np.log(1 - chance)).mean(1)
        temperature = float(grid[loss.argmin()])
    return tuple(layers), temperature


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The classifier from all texts and about TRAIN_TEXTS of the labelled ones.

    Uses labels of rows that are not held out, with a quality of 0 or 1; an id
    with several labels or texts counts with each. Without labels the network
    keeps its random start and says little.
    """
    vectors = word_vectors(docs)
    usable = labels.where(
        (fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("quality").isin(0, 1)
    ).select(F.col("doc_id").cast("long").alias("of"), F.col("quality").cast("double").alias("y"))
    share = TRAIN_TEXTS / max(usable.count(), 1)
    draw = F.pmod(F.xxhash64("of", F.lit(13)), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.broadcast(usable.where(draw < share))  # about TRAIN_TEXTS rows
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [pooled(shared.value, found).tobytes() for found in tokens(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["of", "y", "x"]
            )

    rows = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .join(chosen, F.col("doc_id") == F.col("of"))
        .select("of", "y", "text")
        .mapInArrow(pool, "of long, y double, x binary")
        .collect()
    )
    rows.sort(key=lambda row: (row["of"], row["y"], bytes(row["x"])))
    x = np.array([np.frombuffer(row["x"], np.float32) for row in rows], float)
    x = x.reshape(len(rows), _FEATURES)
    y = np.array([row["y"] for row in rows])
    mean = x.mean(0) if len(x) else np.zeros(_FEATURES)
    scale = x.std(0) + 1e-3 if len(x) else np.ones(_FEATURES)
    layers, temperature = fit_network((x - mean) / scale, y)
    return Model(vectors, mean, scale, layers, temperature)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    The score depends on the text only; empty and null texts have one too. A
    null id is not held out; repeated rows score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            x = [pooled(known.vectors, found) for found in tokens(batch.column(2))]
            x = (np.array(x, float).reshape(-1, _FEATURES) - known.mean) / known.scale
            # what training never came near says no more than its edge
            _, out = _forward(known.layers, np.clip(x, -8, 8))
            # matrix products differ in the last places with the size of a batch
            chance = np.round(_sigmoid(out / known.temperature), 9)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(chance),
                 pa.array((chance >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    held = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int"
    )


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels that are not held out, and score all of ``docs``."""
    return score(docs, train(docs, labels))
