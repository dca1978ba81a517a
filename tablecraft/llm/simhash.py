"""SimHash fingerprints, and their links found by vantage-point partitioning.

Fingerprints are compared as distinct values, so a group of copies costs one
row however many documents it holds.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.llm.components import connected_components
from tablecraft.llm.text import GAP, TEXT_CODEC, ascii_lower, lowered_words
from tablecraft.session import materialize

BITS = 64
BLOCK_BITS = 8
BLOCKS = BITS // BLOCK_BITS
# A ring distance within one block takes about this many values, weighted by
# how often each occurs: 2 ** entropy of a binomial with 8 trials.
RINGS_PER_BLOCK = 5.9
# Fingerprints in an average cell; a cell is searched by one task.
CELL_ROWS = 20_000
# Vantage points are chosen among, and judged on, so many fingerprints.
SAMPLE = 512
LEAF = 256
HASH_SEED = 42
_CHUNK = 1 << 16
# Shingles that occur in many texts are ordered last, as far as a share of the
# texts, or so many of them, show. This bears on cost only: any order is exact.
COUNTED_SHARE = 1 / 16
COUNTED_TEXTS = 1 << 15
COMMON_FROM = 4
COMMON_SHINGLES = 1 << 20
# Groups of up to PAIRED texts are compared pair by pair; in larger ones each
# round compares MORE_CENTERS times as many texts as the last with all others.
PAIRED = 8
MORE_CENTERS = 8


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words joined by one space.

    Fewer words make one shingle of them all; no words make none.
    """
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    span = min(size, len(words)) - 1
    cuts = zip(starts[: len(words) - span].tolist(), ends[span:].tolist())
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[i:j], HASH_SEED) for i, j in cuts], np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit value whose bits are those set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """``doc_id, fp``: the signed 64-bit SimHash of each whole text.

    A null text has no words, and a text without words has fingerprint 0.
    Every row gives one row, also repeated ones and those with a null id.
    """

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [
                majority_bits(shingle_hashes(lowered_words(text.as_py()), shingle_words))
                for text in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values, pa.int64())], ["doc_id", "fp"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(
        fingerprint, "doc_id long, fp long"
    )


def vantage_points(values: DataFrame, levels: int) -> list[tuple[int, int]]:
    """``(vantage point, mask)`` of each level.

    Level i measures distance on the i-th block of bits only, and takes the
    point whose distances to a bounded sample spread most.
    """
    sample = values.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    known = np.array([row["fp"] for row in sample], np.int64)
    chosen = []
    for level in range(levels):
        mask = np.array([((1 << BLOCK_BITS) - 1) << (BLOCK_BITS * level)], np.uint64).view(np.int64)
        block = (known & mask).view(np.uint64)
        spread = np.bitwise_count(block[:, None] ^ block[None, :]).var(1)
        chosen.append((int(known[spread.argmax()]), int(mask[0])))
    return chosen


def _boundary_steps(levels: int, radius: int) -> list[tuple[int, ...]]:
    """Ring steps to other cells that may hold a partner, one of each +/- pair.

    A partner within ``radius`` bits differs by that much over all blocks, so
    by the triangle inequality ring numbers differ by ``radius`` in total.
    """
    steps = itertools.product(range(-radius, radius + 1), repeat=levels)
    return [
        step
        for step in steps
        if 0 < sum(map(abs, step)) <= radius and next(filter(None, step)) > 0
    ]


def cell_levels(count: int, rows: int = CELL_ROWS) -> int:
    """Levels that bring an average cell to about ``rows`` of ``count`` rows."""
    levels = 0
    while levels < BLOCKS and count > rows * RINGS_PER_BLOCK**levels:
        levels += 1
    return levels


def hamming_links(values: DataFrame, radius: int = 2, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links ``a, b`` that connect all values within ``radius`` bits.

    ``values`` has distinct longs ``fp``. Each cell returns a spanning forest of
    its links, so the result connects exactly the values that all links would
    connect, with at most one row per value and cell it was sent to.

    Values are split by their Hamming distance to one vantage point per level
    (rings), each level on its own block of bits. A value is stored in its own
    cell and sent as a query to the neighbouring cells that the triangle bound
    cannot exclude; a cell is searched with a vantage-point tree.
    """
    levels = cell_levels(values.count(), cell_rows)
    points = vantage_points(values, levels)
    rings: list[Column] = [
        F.bit_count(F.col("fp").bitwiseXOR(F.lit(point)).bitwiseAND(F.lit(mask)))
        for point, mask in points
    ]
    named = values.select("fp", *(ring.alias(f"ring{i}") for i, ring in enumerate(rings)))
    base = BLOCK_BITS + 1

    def cell(step: tuple[int, ...]) -> Column:
        number = F.lit(0)
        for i, move in enumerate(step):
            number = number + (F.col(f"ring{i}") + move) * base**i
        return number.cast("long")

    def inside(step: tuple[int, ...]) -> Column:
        allowed = F.lit(True)
        for i, move in enumerate(step):
            if move:
                allowed = allowed & (F.col(f"ring{i}") + move).between(0, BLOCK_BITS)
        return allowed

    visits = [F.struct(cell((0,) * levels).alias("cell"), F.lit(True).alias("stored"))]
    for step in _boundary_steps(levels, radius):
        visit = F.struct(cell(step).alias("cell"), F.lit(False).alias("stored"))
        visits.append(F.when(inside(step), visit))
    routed = (
        named.select("fp", F.explode(F.array(*visits)).alias("visit"))
        .where(F.col("visit").isNotNull())
        .select("visit.cell", "visit.stored", "fp")
    )

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].to_numpy(np.int64)
        stored = pdf["stored"].to_numpy(bool)
        return pd.DataFrame(cell_forest(fps, stored, radius), columns=["a", "b"], dtype="int64")

    return routed.groupBy("cell").applyInPandas(search, "a long, b long")


def near_pairs(
    items: np.ndarray, queries: np.ndarray, radius: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in ``items`` and ``queries`` of all pairs within ``radius``."""
    # numpy counts the bits of a signed number's absolute value
    items, queries = items.view(np.uint64), queries.view(np.uint64)
    todo = [(np.arange(len(items)), np.arange(len(queries)))]
    while todo:
        held, asked = todo.pop()
        if not len(held) or not len(asked):
            continue
        if len(held) > LEAF:
            point = items[held[len(held) // 2]]
            reach = np.bitwise_count(items[held] ^ point).astype(np.int16)
            asked_reach = np.bitwise_count(queries[asked] ^ point).astype(np.int16)
            middle = np.int16(np.median(reach))
            inner = reach <= middle
            if not inner.all():
                todo.append((held[inner], asked[asked_reach <= middle + radius]))
                todo.append((held[~inner], asked[asked_reach > middle - radius]))
                continue
        rows = max(1, (1 << 21) // len(held))
        for at in range(0, len(asked), rows):
            part = asked[at : at + rows]
            close = np.bitwise_count(queries[part][:, None] ^ items[held][None, :]) <= radius
            i, j = np.nonzero(close)
            if len(i):
                yield held[j], part[i]


def cell_forest(fps: np.ndarray, stored: np.ndarray, radius: int) -> np.ndarray:
    """Spanning forest of the links between stored values and all values."""
    if not stored.any():
        return np.empty((0, 2), np.int64)
    homes = np.flatnonzero(stored)
    parent = np.arange(len(fps))
    kept = []
    for i, j in near_pairs(fps[homes], fps, radius):
        i = homes[i]
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped
        fresh = parent[i] != parent[j]
        if not fresh.any():
            continue
        for x, y in np.unique(np.stack([i[fresh], j[fresh]], 1), axis=0).tolist():
            root_x, root_y = _root(parent, x), _root(parent, y)
            if root_x != root_y:
                parent[max(root_x, root_y)] = min(root_x, root_y)
                kept.append((x, y))
    return fps[np.array(kept, np.int64).reshape(-1, 2)]


def _root(parent: np.ndarray, node: int) -> int:
    while parent[node] != node:
        node = parent[node]
    return int(node)


def simhash_components(
    docs: DataFrame, shingle_words: int = 3, radius: int = 2, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """``doc_id, fp, component_id`` of every document.

    Documents whose fingerprints differ in ``radius`` bits or fewer are linked;
    ``component_id`` is the smallest id reachable over links, the document
    itself included. Rows with a null id take part in linking but are no one's
    smallest id, so a component of such rows only has a null ``component_id``.
    Repeated rows and repeated ids are separate documents. An empty table gives
    an empty result. Other columns of ``docs`` are ignored.
    """
    prints = materialize(fingerprints(docs, shingle_words), "fingerprints")
    # partial minima: a third of all rows with one fingerprint is a row per task
    values = materialize(
        prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints"
    )
    links = hamming_links(values.select("fp"), radius, cell_rows)
    roots = connected_components(links).select(F.col("node").alias("fp"), "root")
    linked = values.join(roots, "fp")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("smallest"))
    found = linked.join(smallest, "root").select("fp", "smallest")
    classes = (
        values.join(found.withColumn("linked", F.lit(True)), "fp", "left")
        .select(
            "fp",
            F.when(F.col("linked"), F.col("smallest"))
            .otherwise(F.col("first_id"))
            .alias("component_id"),
        )
    )
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their group, all columns kept.

    ``groups`` has ``doc_id, component_id``. The row whose id is its component's
    id stays; of several rows with that id the one with the smallest hash of its
    text stays. Rows without an id stay, since no decision names them.
    """
    chosen = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.col("text"))
    rank = "__row_of_id"
    kept = (
        docs.join(chosen, "doc_id", "left_semi")
        .withColumn(rank, F.row_number().over(order))
        .where(F.col(rank) == 1)
        .select(*docs.columns)
    )
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


def common_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of the most common shingles of some texts.

    ``texts`` has ``rep, text``. At most COMMON_SHINGLES reach the driver; the
    least count among them comes from a histogram of 16 steps per power of two.
    """

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for text in batch.column(0):
                rows.append(np.unique(shingle_hashes(lowered_words(text.as_py()), words)))
                size += len(rows[-1])
                if size >= _CHUNK:
                    yield together(rows)
                    rows, size = [], 0
            if rows:
                yield together(rows)

    def together(rows: list[np.ndarray]) -> pa.RecordBatch:
        hashes = np.concatenate(rows).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(hashes)], ["shingle"])

    share = max(COUNTED_SHARE, COUNTED_TEXTS / max(texts.count(), 1))
    draw = F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    counted = materialize(
        texts.where(draw < share)
        .select("text")
        .mapInArrow(distinct, "shingle long")
        .groupBy("shingle")
        .count()
        .where(F.col("count") >= COMMON_FROM)
        .withColumn("step", F.floor(F.log2("count") * 16)),
        "common-shingles",
    )
    least, total = 1 << 62, 0
    steps = counted.groupBy("step").agg(F.count("*").alias("rows")).collect()
    for row in sorted(steps, reverse=True):
        total += row["rows"]
        if total > COMMON_SHINGLES:
            break
        least = row["step"]
    table = counted.where(F.col("step") >= least).orderBy("shingle").toArrow()
    return table.column("shingle").to_numpy(), table.column("count").to_numpy()


def prefix(
    shingles: np.ndarray, common: np.ndarray, counts: np.ndarray, least: float
) -> np.ndarray:
    """The first of a text's distinct shingles, those not in ``common`` first.

    Sets with a Jaccard similarity of ``least`` share that part of the larger
    one's n shingles, so in one order of all shingles the first that they share
    is among the first n - least * n + 1 of both.
    """
    known = shingles.view(np.int64)
    at = np.minimum(np.searchsorted(common, known), max(len(common) - 1, 0))
    often = np.where(common[at] == known, counts[at], 0) if len(common) else np.zeros(len(known))
    mixed = shingles * np.uint64(0x9E3779B97F4A7C15)
    size = len(shingles) - math.ceil(least * len(shingles) - 1e-9) + 1
    return known[np.lexsort((mixed, often))[:size]]


def prefix_members(texts: DataFrame, words: int, least: float) -> DataFrame:
    """``group, rep, size``: the shingles in the prefixes of two texts or more."""
    common = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, words))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for rep, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                shingles = np.unique(shingle_hashes(lowered_words(text.as_py()), words))
                if len(shingles):
                    first = prefix(shingles, *common.value, least)
                    rows.append((first, rep, len(shingles)))
                    size += len(first)
                if size >= _CHUNK:
                    yield together(rows)
                    rows, size = [], 0
            if rows:
                yield together(rows)

    def together(rows: list[tuple[np.ndarray, int, int]]) -> pa.RecordBatch:
        firsts, reps, sizes = zip(*rows)
        lengths = [len(first) for first in firsts]
        columns = (np.concatenate(firsts), np.repeat(reps, lengths), np.repeat(sizes, lengths))
        return pa.RecordBatch.from_arrays(
            [pa.array(column, pa.int64()) for column in columns], ["group", "rep", "size"]
        )

    rows = materialize(
        texts.select("rep", "text").mapInArrow(prefixes, "group long, rep long, size long"),
        "prefixes",
    )
    groups = rows.groupBy("group").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
    shared = groups.where(F.col("low") < F.col("high")).select("group")
    return rows.join(shared, "group")


def _similar(texts: DataFrame, pairs: DataFrame, words: int, least: float) -> DataFrame:
    """``a, b`` of the pairs whose texts' shingle sets have that Jaccard similarity."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @functools.lru_cache(64)
        def shingles(text: str | None) -> np.ndarray:
            return np.unique(shingle_hashes(lowered_words(text), words))

        for batch in batches:
            kept = []
            for one, other in zip(batch.column(2), batch.column(3)):
                first, second = shingles(one.as_py()), shingles(other.as_py())
                shared = len(np.intersect1d(first, second, assume_unique=True))
                union = len(first) + len(second) - shared
                kept.append(union == 0 or shared >= least * union)
            mask = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).filter(mask) for i in range(2)], ["a", "b"]
            )

    one = texts.select(F.col("rep").alias("a"), F.col("text").alias("one"))
    other = texts.select(F.col("rep").alias("b"), F.col("text").alias("other"))
    return (
        pairs.join(one, "a")
        .join(other, "b")
        .select("a", "b", "one", "other")
        .mapInArrow(verify, "a long, b long")
    )


def checked_links(
    members: DataFrame,
    texts: DataFrame,
    words: int = 5,
    least: float = 0.8,
    known: DataFrame | None = None,
) -> DataFrame:
    """Links ``a, b`` that connect what all links within groups would connect.

    ``members`` has ``group, rep, size`` (distinct shingles of the text),
    ``texts`` has ``rep, text``. Links ``known`` before are among the result, and
    texts that they connect are not compared. A round compares some members of a group, its
    centers, with all others and then takes them out of the group, until those
    left are connected. So two members are compared on whole texts, or their
    sizes rule a link out, or checked links connect them already; copies that
    one center connects are done in one round.
    """
    found = known
    left = members.select("group", "rep", "size")
    if known is None:
        left = left.withColumn("root", F.col("rep"))
    else:
        left = _with_roots(left, known)
    turn = 0
    while True:
        left = materialize(left, "open-members")
        groups = left.groupBy("group").agg(
            F.count("*").alias("rows"),
            F.min("rep").alias("first"),
            F.min("root").alias("low"),
            F.max("root").alias("high"),
        )
        # the same texts in all groups, so that most pairs are found repeatedly
        draw = F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
        more = float(min(MORE_CENTERS**turn, 1 << 40)) if turn else 0.0
        marked = left.join(groups.where(F.col("low") < F.col("high")), "group").select(
            "group",
            "rep",
            "size",
            "root",
            (
                (F.col("rows") <= PAIRED)
                | (F.col("rep") == F.col("first"))
                | (draw < more / F.col("rows"))
            ).alias("center"),
        )
        marked = materialize(marked, "marked-members")
        if marked.isEmpty():
            break
        centers = marked.where("center").select(
            "group",
            F.col("rep").alias("center_rep"),
            F.col("size").alias("center_size"),
            F.col("root").alias("center_root"),
        )
        sizes = F.least("size", "center_size") >= least * F.greatest("size", "center_size") - 1e-9
        pairs = (
            marked.join(centers, "group")
            .where((F.col("root") != F.col("center_root")) & sizes)
            .select(
                F.least("rep", "center_rep").alias("a"), F.greatest("rep", "center_rep").alias("b")
            )
            .distinct()
        )
        similar = _similar(texts, materialize(pairs, "candidates"), words, least)
        found = materialize(
            similar if found is None else found.unionByName(similar), "checked-links"
        )
        left = _with_roots(marked.where(~F.col("center")).select("group", "rep", "size"), found)
        turn += 1
    if found is None:
        found = members.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    return found


def _with_roots(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members, each with the root of what the links connect it to, or itself."""
    roots = connected_components(links).select(F.col("node").alias("rep"), "root")
    return members.join(roots, "rep", "left").select(
        "group", "rep", "size", F.coalesce("root", "rep").alias("root")
    )


def _content() -> list[Column]:
    """Two hashes that tell the words of a text, A-Z lower-cased, from all others."""
    text = F.concat_ws(" ", F.transform(F.split(F.coalesce("text", F.lit("")), GAP), ascii_lower))
    return [F.xxhash64(F.trim(text)), F.xxhash64(F.lit(1), F.trim(text))]


def similar_texts(texts: DataFrame, words: int, least: float) -> DataFrame:
    """``rep, root`` of the texts that are similar to another one, directly or over others.

    ``texts`` has ``rep, text``, a row per distinct text. Texts whose SimHash
    fingerprints are within two bits are linked first, by ``simhash_components``;
    shingle sets then add the links that are too far apart for 64 bits.
    """
    near = simhash_components(texts.select(F.col("rep").alias("doc_id"), "text"))
    linked = materialize(
        near.where(F.col("doc_id") != F.col("component_id")).select(
            F.col("doc_id").alias("a"), F.col("component_id").alias("b")
        ),
        "simhash-links",
    )
    members = prefix_members(texts, words, least)
    classes = connected_components(checked_links(members, texts, words, least, linked))
    return classes.select(F.col("node").alias("rep"), "root")


def near_duplicates(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """``doc_id, component_id``: groups of copies and near copies.

    Texts belong together, directly or over others, if their SimHash fingerprints
    differ in two bits or fewer, as in ``simhash_components``, or if their sets of
    ``words``-word shingles have a Jaccard similarity of ``least`` or more. Both
    searches are exact. At 0.8 a whole text's fingerprint differs in about ten bits,
    too far for a search in 64 bits; but two such texts share a shingle of their
    prefixes, and texts that do are compared on whole texts until links connect
    them or every pair that they don't connect was compared.

    Rows with a null id get no row. Texts without words are copies of each other.
    Rows that share an id are compared each with its own text. An empty table
    gives an empty result.
    """
    one, two = _content()
    named = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long"), one.alias("one"), two.alias("two"), "text"
    )
    # copies first: one row stands for all texts with the same words
    texts = materialize(
        named.groupBy("one", "two")
        .agg(F.min("doc_id").alias("least_id"), F.first("text").alias("text"))
        .withColumn("rep", F.monotonically_increasing_id()),
        "distinct-texts",
        codec=TEXT_CODEC,
    )
    found = similar_texts(texts.select("rep", "text"), words, least)
    known = texts.select("one", "two", "rep", "least_id").join(found, "rep", "left").select(
        "one", "two", "least_id", F.coalesce("root", "rep").alias("root")
    )
    smallest = known.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = known.join(smallest, "root").select("one", "two", "component_id")
    return named.drop("text").join(known, ["one", "two"]).select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without copies and near copies, all columns kept.

    Groups are those of ``near_duplicates``, over all rows: of each the row with
    the smallest ``doc_id`` stays, rows without an id last, and of rows with one
    id that with the smallest hash of its text. Of equal rows any one stays. Rows
    that share an id, or have none, are judged by their texts like all others;
    texts without words are copies of each other. An empty table gives an empty
    result.
    """
    # Ranked before they are shuffled: of a third of all rows with one text, each
    # task passes one on.
    order = (F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("text"))
    copies = Window.partitionBy("__one", "__two").orderBy(*order)
    one, two = _content()
    firsts = materialize(
        docs.withColumns({"__one": one, "__two": two})
        .withColumn("__rank", F.row_number().over(copies))
        .where(F.col("__rank") == 1)
        .select(*docs.columns, F.monotonically_increasing_id().alias("__rep")),
        "first-copies",
        codec=TEXT_CODEC,
    )
    texts = firsts.select(F.col("__rep").alias("rep"), "text")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), F.col("__rep"))
    grouped = firsts.select(F.col("__rep").alias("rep"), place.alias("place")).join(
        materialize(similar_texts(texts, words, least), "similar-texts"), "rep"
    )
    winners = grouped.groupBy("root").agg(F.min_by("rep", "place").alias("winner"))
    gone = grouped.join(winners, "root").where(F.col("rep") != F.col("winner"))
    gone = gone.select(F.col("rep").alias("__rep"))
    return firsts.join(gone, "__rep", "left_anti").select(*docs.columns)
