"""Hard negatives by an inverted multi-index over two half-spaces.

A vector's first and second half each have a codebook, and a pair of codewords
is a cell. An anchor visits cells in the order of the sum of two half-score
bounds (a codeword's inner product, plus the anchor's norm times the codeword's
radius) by the multi-sequence heap, and stops when no cell left can change what
it asked for. So results are exact, whatever the codebooks are like.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.session import materialize

# The codebooks are fitted on so many rows at most; every row is indexed.
SAMPLE = 16_384
KMEANS_ROUNDS = 8
# Rows of a cell, and anchors, that one task scores against each other.
BLOCK = 32_768
ASKED = 16_384
# Rows that an anchor may visit in its first round, and growth of that.
FIRST_ROWS = 4096
GROWTH = 8
# Components beyond this make scores that a long can't hold.
LARGEST = 1 << 27
ANY = 1 << 62

_INDEX = "cell long, block int, vec_id long, label long, vec binary, near double, far double"
_BEST = "query binary, window int, score long, vec_id long"


@dataclass(frozen=True)
class Directory:
    """Codebooks, and count and radii of each cell: O(sqrt(rows)) numbers in all."""

    split: int
    dims: int
    books: tuple[np.ndarray, np.ndarray]
    rows: np.ndarray
    radii: tuple[np.ndarray, np.ndarray]
    block: int = BLOCK

    def visits(self, vec: np.ndarray) -> Iterator[tuple[float, int, float, float]]:
        """``order, cell, upper, lower`` of all cells with rows, by falling ``order``.

        ``order`` bounds the scores of this cell and of all later ones; ``upper``
        and ``lower`` bound those of the cell itself.
        """
        halves = (vec[: self.split], vec[self.split :])
        norms = [float(np.linalg.norm(half)) for half in halves]
        scores = [book @ half for book, half in zip(self.books, halves)]
        reach = [norm * r for norm, r in zip(norms, self.radii)]
        shape = self.rows.shape
        near, far = (r.reshape(shape) for r in reach)
        bounds = [scores[0] + near.max(1), scores[1] + far.max(0)]
        ranks = [np.argsort(-bound, kind="stable") for bound in bounds]
        slack = 1e-9 * sum(n * (n + np.abs(b).max(initial=0.0) + 1) for n, b in zip(norms, self.books))
        slack += 1e-6 + 1e-9 * sum(r.max(initial=0.0) for r in reach)
        falling = [bound[rank] for bound, rank in zip(bounds, ranks)]
        heap = [(-(falling[0][0] + falling[1][0]), 0, 0)]
        while heap:
            order, a, b = heapq.heappop(heap)
            # (a, b + 1) follows (a, b), and (a + 1, 0) follows (a, 0): each cell once.
            if b + 1 < shape[1]:
                heapq.heappush(heap, (-(falling[0][a] + falling[1][b + 1]), a, b + 1))
            if b == 0 and a + 1 < shape[0]:
                heapq.heappush(heap, (-(falling[0][a + 1] + falling[1][0]), a + 1, 0))
            i, j = int(ranks[0][a]), int(ranks[1][b])
            if self.rows[i, j]:
                middle = scores[0][i] + scores[1][j]
                wide = near[i, j] + far[i, j] + slack
                yield -order + slack, i * shape[1] + j, middle + wide, middle - wide


def fit_codebook(sample: np.ndarray, size: int) -> np.ndarray:
    """k-means from evenly spaced sample rows; fewer rows make fewer codewords."""
    distinct = np.unique(sample, axis=0)
    book = distinct[np.linspace(0, len(distinct) - 1, min(size, len(distinct))).astype(int)]
    book = book.astype(float)
    for _ in range(KMEANS_ROUNDS):
        nearest = _nearest(sample, book)[0]
        sums = np.zeros_like(book)
        np.add.at(sums, nearest, sample)
        counts = np.bincount(nearest, minlength=len(book))
        book[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return book


def _nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each row, and the distance to it."""
    chosen = (-2 * (rows @ book.T) + (book**2).sum(1)).argmin(1)
    return chosen, np.sqrt(((rows - book[chosen]) ** 2).sum(1))


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of little-endian 32-bit components, shorter ones filled up with zeros."""
    rows = np.zeros((len(column), dims), np.int64)
    for i, value in enumerate(column.to_pylist()):
        rows[i, : len(value) // 4] = np.frombuffer(value, "<i4")
    return rows


def prepared(rows: DataFrame) -> DataFrame:
    """``vec_id, label, vec``: the rows that take part, vectors as packed integers.

    Rows with a null vec_id, label or vector, a null component, or one of 2**27
    or more, take no part. ``vector`` is an array of whole numbers.
    """
    usable = F.forall("vector", lambda x: F.coalesce((x > -LARGEST) & (x < LARGEST), F.lit(False)))
    known = rows.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & usable
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.array(v, "<i4").tobytes() for v in batch.column("vector").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(packed, pa.binary())],
                ["vec_id", "label", "vec"],
            )

    whole = F.transform("vector", lambda x: x.cast("int"))
    columns = [F.col(c).cast("long").alias(c) for c in ("vec_id", "label")]
    return known.select(*columns, whole.alias("vector")).mapInArrow(
        pack, "vec_id long, label long, vec binary"
    )


def build_index(rows: DataFrame) -> tuple[DataFrame, Directory | None]:
    """Every prepared row with its cell; the codebooks and the cells' bounds.

    ``n`` rows get about n ** 0.25 codewords a half, so a cell has about sqrt(n)
    rows and the directory about sqrt(n) cells. A cell of many rows is stored in
    blocks by a hash of the row.
    """
    rows = materialize(rows, "negatives-rows")
    count, widest = rows.agg(F.count("*"), F.max(F.octet_length("vec"))).first()
    if not count:
        return rows, None
    dims = max(2, widest // 4)
    split = (dims + 1) // 2
    sample = rows.select("vec").orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(SAMPLE)
    sample = _vectors(sample.toArrow().column("vec").combine_chunks(), dims).astype(float)
    size = int(np.ceil(count**0.25))
    books = fit_codebook(sample[:, :split], size), fit_codebook(sample[:, split:], size)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _vectors(batch.column("vec"), dims).astype(float)
            one, near = _nearest(vectors[:, :split], books[0])
            two, far = _nearest(vectors[:, split:], books[1])
            cells = one * len(books[1]) + two
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells), *(batch.column(c) for c in ("vec_id", "label", "vec")),
                 pa.array(near), pa.array(far)],
                ["cell", "vec_id", "label", "vec", "near", "far"],
            )

    placed = rows.mapInArrow(assign, _INDEX.replace(" block int,", ""))
    placed = materialize(placed, "negatives-cells")
    cells = placed.groupBy("cell").agg(
        F.count("*").alias("rows"), F.max("near").alias("near"), F.max("far").alias("far")
    )
    shape = len(books[0]), len(books[1])
    filled = np.zeros(shape, np.int64)
    radii = np.zeros(shape), np.zeros(shape)
    for cell in cells.toLocalIterator():
        at = divmod(cell["cell"], shape[1])
        filled[at], radii[0][at], radii[1][at] = cell["rows"], cell["near"], cell["far"]
    blocks = F.ceil(F.col("rows") / BLOCK)
    block = F.pmod(F.xxhash64("vec_id", "label", "vec"), blocks).cast("int")
    index = placed.join(cells.select("cell", "rows"), "cell").withColumn("block", block)
    return index.drop("rows", "near", "far"), Directory(split, dims, books, filled, radii, BLOCK)


def _needed(windows: list[dict], worst: dict[int, int]) -> tuple[float, float]:
    """Scores that may still change a query's result: from, to."""
    open_ = [(worst.get(k, w["lo"]), w["hi"]) for k, w in enumerate(windows) if w["lo"] <= w["hi"]]
    if not open_:
        return np.inf, -np.inf
    return min(low for low, _ in open_), max(high for _, high in open_)


def _plan(
    batches: Iterator[pa.RecordBatch], directory: Directory, spent: int, allowed: int
) -> Iterator[pa.RecordBatch]:
    """The blocks that each unfinished query visits in this round.

    The order of a query's cells never changes, so a round takes up where the
    budget of the last one, ``spent`` rows, ended.
    """
    for batch in batches:
        cells, blocks, owners = [], [], []
        vectors = _vectors(batch.column("vec"), directory.dims).astype(float)
        columns = zip(batch.column("windows").to_pylist(), batch.column("worst").to_pylist())
        for i, (windows, worst) in enumerate(columns):
            low, high = _needed(windows, {w["window"]: w["score"] for w in worst or []})
            seen = 0
            for order, cell, upper, lower in directory.visits(vectors[i]):
                if order < low or seen >= allowed:
                    break
                rows = int(directory.rows.flat[cell])
                if seen >= spent and upper >= low and lower <= high:
                    n = -(-rows // directory.block)
                    cells += [cell] * n
                    blocks += range(n)
                    owners += [i] * n
                seen += rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells, pa.int64()), pa.array(blocks, pa.int32()),
             *(batch.column(c).take(pa.array(owners, pa.int64())) for c in _QUERY)],
            ["cell", "block", *_QUERY],
        )


_QUERY = ("query", "vec_id", "label", "vec", "windows", "worst")
_WINDOWS = "array<struct<lo:long,hi:long>>"
_WORST = "array<struct<window:int,score:long>>"


def _score(asked: pa.Table, block: pa.Table, dims: int, want: int, same: bool) -> pa.Table:
    """The best rows of one block for each query and window."""
    found: list[tuple[bytes, int, int, int]] = []
    if asked.num_rows and block.num_rows:
        queries = _vectors(asked.column("vec").combine_chunks(), dims)
        rows = {  # repeated rows count once
            (i, label, vec)
            for i, label, vec in zip(*(block.column(c).to_pylist() for c in ("vec_id", "label", "vec")))
        }
        ids, labels, vecs = zip(*sorted(rows))
        ids, labels = np.array(ids), np.array(labels)
        vectors = _vectors(pa.array(vecs, pa.binary()), dims)
        names = asked.column("query").to_pylist()
        own = asked.column("vec_id").to_numpy()
        own_labels = asked.column("label").to_numpy()
        windows, worst = asked.column("windows").to_pylist(), asked.column("worst").to_pylist()
        # Doubles are exact below 2**53, and several times faster.
        size = dims * int(np.abs(queries).max(initial=0)) * int(np.abs(vectors).max(initial=0))
        kind = np.float64 if size < 1 << 53 else np.int64
        right = vectors.T.astype(kind)
        for at in range(0, len(names), 128):
            part = slice(at, at + 128)
            scores = (queries[part].astype(kind) @ right).astype(np.int64)
            fits = (own_labels[part, None] == labels) == same
            mine = own[part, None] == ids
            for i, row in zip(*np.nonzero(mine & (own_labels[part, None] == labels))):
                fits[i, row] &= not np.array_equal(queries[at + i], vectors[row])
            for i, (fit, score) in enumerate(zip(fits, scores), at):
                floors = {w["window"]: w["score"] for w in worst[i] or []}
                low, high = _needed(windows[i], floors)
                near = np.flatnonzero(fit & (score >= low) & (score <= high))
                near = near[np.lexsort((ids[near], -score[near]))]
                for k, w in enumerate(windows[i]):
                    values = score[near]
                    ok = near[(values >= max(w["lo"], floors.get(k, w["lo"]))) & (values <= w["hi"])]
                    found += [(names[i], k, int(score[r]), int(ids[r])) for r in ok[:want]]
    columns = list(zip(*found)) or [[], [], [], []]
    kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)],
                    names=["query", "window", "score", "vec_id"])


def search(index: DataFrame, directory: Directory, queries: DataFrame, want: int, same: bool) -> DataFrame:
    """The first ``want`` rows of each query's score windows, with ``place`` from 1.

    ``queries`` has a distinct ``query``, ``vec_id``, ``label``, ``vec`` and
    ``windows`` (``lo``, ``hi``, both included); rows have the query's label if
    ``same``, else another. Higher scores come first, ties by smaller id. Each
    round visits more cells, for the queries that aren't certain yet.
    """
    chunks = max(1, -(-queries.count() // ASKED))
    chunk = F.pmod(F.xxhash64("query"), F.lit(chunks)).cast("int")
    parts = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    blocks = index.withColumn("chunk", parts)
    place = F.row_number().over(
        Window.partitionBy("query", "window").orderBy(F.desc("score"), "vec_id")
    )
    best = None
    spent, allowed = 0, FIRST_ROWS
    total, dims = int(directory.rows.sum()), directory.dims
    while spent < total:
        plan = functools.partial(_plan, directory=directory, spent=spent, allowed=allowed)
        spent, allowed = allowed, allowed * GROWTH
        asking = queries.withColumn("worst", F.lit(None).cast(_WORST))
        if best is not None:
            full = best.where(F.col("place") == want).groupBy("query")
            worst = full.agg(F.collect_list(F.struct("window", "score")).alias("worst"))
            asking = queries.join(worst, "query", "left")
        visits = asking.select(*_QUERY).mapInArrow(
            plan,
            "cell long, block int, query binary, vec_id long, label long, vec binary, "
            f"windows {_WINDOWS}, worst {_WORST}",
        )
        visits = materialize(visits.withColumn("chunk", chunk), "negatives-visits")
        if best is not None and visits.isEmpty():
            continue
        keys = ("cell", "block", "chunk")
        wanted = blocks.join(visits.select(*keys).distinct(), list(keys), "left_semi")
        found = (
            visits.groupBy(*keys)
            .cogroup(wanted.groupBy(*keys))
            .applyInArrow(lambda asked, block: _score(asked, block, dims, want, same), _BEST)
        )
        if best is not None:
            found = found.unionByName(best.drop("place"))
        best = found.withColumn("place", place).where(F.col("place") <= want)
        best = materialize(best, "negatives-best")
    return best


def _score_window(low_percent: int, high_percent: int) -> tuple[Column, Column]:
    """Least and largest whole score between two percentages of ``score``.

    Hundreds are split off first, so no product leaves the range of a long. A
    negative score leaves no window.
    """
    hundreds, rest = F.expr("score div 100"), F.col("score") % 100
    least = hundreds * low_percent + F.ceil(rest * low_percent / F.lit(100.0))
    most = hundreds * high_percent + F.floor(rest * high_percent / F.lit(100.0))
    negative = F.col("score") < 0
    return F.when(negative, 1).otherwise(least).alias("lo"), F.when(negative, 0).otherwise(most).alias("hi")


def mine(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
) -> DataFrame:
    """Hard negatives of each anchor and positive.

    ``rows`` has ``vec_id``, ``label`` and ``vector`` (see ``prepared`` for rows
    that take no part); ``anchors`` is a condition on ``vec_id``. Scores are
    integer inner products. Of a shorter vector the missing components are zero.
    Rows equal in all three columns count once; others are rows of their own,
    also under one vec_id. Positives are the first rows of the anchor's label
    other than itself; negatives are the first rows of other labels with
    ``low_percent * positive_score <= 100 * score <= high_percent * positive_score``,
    fewer where there are fewer. An empty table gives an empty result.
    """
    index, directory = build_index(prepared(rows))
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    spark = rows.sparkSession
    if directory is None:
        kinds = ("long", "long", "int", "long", "long", "long")
        return spark.createDataFrame([], ", ".join(map(" ".join, zip(names, kinds))))
    index = materialize(index, "negatives-index")
    query = F.unhex(F.sha2(F.concat_ws(":", "vec_id", "label", F.hex("vec")), 256))
    asked = index.where(anchors).select("vec_id", "label", "vec").distinct()
    asked = materialize(asked.withColumn("query", query), "negatives-anchors")
    everything = F.array(F.struct(F.lit(-ANY).alias("lo"), F.lit(ANY).alias("hi")))
    same = search(index, directory, asked.withColumn("windows", everything), positives, True)

    limits = _score_window(low_percent, high_percent)
    grouped = same.groupBy("query").agg(
        F.array_sort(F.collect_list(F.struct("place", *limits))).alias("sorted")
    )
    windows = F.transform("sorted", lambda w: F.struct(w["lo"], w["hi"]))
    asked = materialize(
        asked.join(grouped, "query").withColumn("windows", windows).drop("sorted"), "negatives-asked"
    )
    found = search(index, directory, asked, negatives, False)
    pairs = same.select(
        "query",
        (F.col("place") - 1).alias("window"),
        F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    ids = asked.select("query", F.col("vec_id").alias("anchor_id"))
    named = found.select(
        "query",
        "window",
        F.col("place").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        F.col("score").alias("negative_score"),
    )
    return named.join(pairs, ["query", "window"]).join(ids, "query").select(*names)
