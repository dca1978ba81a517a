"""Passages that occur twice, found by bucket-pointer refinement of suffixes.

Suffixes are bucketed by the bytes they start with, and buckets are refined by
the buckets of later offsets, until a bucket holds equal strings of the wanted
length. Sorting every suffix of a corpus is needless for that: each string of
the wanted length picks one gram inside it by its content alone, so equal
strings pick equal grams, and only suffixes around grams that occur twice are
ever refined.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.session import materialize

LENGTH = 200
GRAM = 64
# Bytes bucketed at once, and the bits that hold a place among them.
CHUNK = 1 << 17
PLACE_BITS = np.uint64(20)
# Neighbourhoods that one task refines at once. In a larger bucket they are
# compared window by window, in as many tasks as it takes.
PACK = 4096
FIRST_GRAM = 8

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def gram_buckets(data: np.ndarray, size: int) -> np.ndarray:
    """Bucket of the ``size`` bytes at each place, from buckets of half the size."""
    bucket, reach = _BYTE[data], 1
    while reach < size:
        step = min(reach, size - reach)
        later = bucket[step:]
        bucket = bucket[:-step] * _MIX + (later ^ (later >> np.uint64(31)))
        reach += step
    bucket = (bucket ^ (bucket >> np.uint64(32))) * _MIX
    return bucket ^ (bucket >> np.uint64(29))


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, by running minima within blocks."""
    blocks = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(values) - width + 1], ahead[width - 1 : len(values)])


def neighbourhoods(
    texts: list[bytes], length: int = LENGTH, gram: int = GRAM
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows of ``length`` bytes that pick the same gram.

    Yields arrays ``text, start, count, bucket``: number of the text, place of
    the first window, number of windows, and bucket of the gram. Every window
    of every text belongs to exactly one run.
    """
    pieces: list[tuple[int, int, bytes]] = []
    held = 0
    for number, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, CHUNK):
            piece = text[at : at + CHUNK + length - 1]
            pieces.append((number, at, piece))
            held += len(piece)
            if held >= CHUNK:
                yield _runs(pieces, length, gram)
                pieces, held = [], 0
    if pieces:
        yield _runs(pieces, length, gram)


def _runs(
    pieces: list[tuple[int, int, bytes]], length: int, gram: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(piece for _, _, piece in pieces), np.uint8)
    buckets = gram_buckets(data, gram)
    places = np.arange(len(buckets), dtype=np.uint64)
    ranked = (buckets >> PLACE_BITS << PLACE_BITS) | places
    picked = _window_minima(ranked, length - gram + 1) & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))
    sizes = np.array([len(piece) for _, _, piece in pieces])
    firsts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(pieces)), sizes)[: len(picked)]
    inside = np.arange(len(picked)) + length <= (firsts + sizes)[owner]
    starts = np.flatnonzero(inside)
    owner, picked = owner[starts], picked[starts].astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (picked[1:] != picked[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(starts)))
    of = owner[heads]
    numbers = np.array([number for number, _, _ in pieces])
    offsets = np.array([at for _, at, _ in pieces])
    return numbers[of], starts[heads] - firsts[of] + offsets[of], counts, buckets[picked[heads]].view(np.int64)


def repeated_windows(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Per context, the places whose ``length`` bytes occur again in any of them.

    Buckets of the first eight bytes are refined by sorting on the bucket at a
    later offset. Each refinement reads the pointers that the one before has
    written, so the bytes told apart double; suffixes alone in their bucket
    keep it and aren't sorted again.
    """
    data = np.frombuffer(b"".join(contexts) + bytes(length), np.uint8)
    sizes = np.array([len(context) for context in contexts])
    ends = np.cumsum(sizes)
    reach = min(FIRST_GRAM, length)
    grams = np.zeros((len(data) - reach + 1, 8), np.uint8)
    grams[:, :reach] = np.lib.stride_tricks.sliding_window_view(data, reach)
    _, pointer = np.unique(grams.view(np.uint64).ravel(), return_inverse=True)
    total = int(ends[-1])
    open_ = np.arange(total)
    while reach < length:
        step = min(reach, length - reach)
        crowd = np.bincount(pointer[open_])
        open_ = open_[crowd[pointer[open_]] > 1]
        later = pointer[np.minimum(open_ + step, len(pointer) - 1)]
        width = int(pointer.max()) + 1
        _, refined = np.unique(pointer[open_] * width + later, return_inverse=True)
        pointer[open_] = width + refined
        reach += step
    counts = sizes - length + 1
    windows = np.concatenate(
        [np.arange(end - size, end - size + n) for end, size, n in zip(ends, sizes, counts)]
    )
    _, bucket, members = np.unique(pointer[windows], return_inverse=True, return_counts=True)
    again = members[bucket] > 1
    cuts = np.cumsum(counts)[:-1]
    return [np.flatnonzero(part) for part in np.split(again, cuts)]


def _grams_of_texts(
    batches: Iterator[pa.RecordBatch], length: int, gram: int
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column("key")
        for text, _, _, bucket in neighbourhoods(batch.column("text").to_pylist(), length, gram):
            order = np.lexsort((bucket, text))
            text, bucket = text[order], bucket[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (bucket[1:] != bucket[:-1])
            heads = np.flatnonzero(new)
            several = np.diff(np.append(heads, len(text))) > 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[heads]), keys.take(pa.array(text[heads])), pa.array(several)],
                ["gram", "key", "several"],
            )


def _members_of_texts(
    batches: Iterator[pa.RecordBatch], length: int, gram: int
) -> Iterator[pa.RecordBatch]:
    """One row per text and distinct neighbourhood of a gram that occurs twice."""
    for batch in batches:
        keys, texts = batch.column("key").to_pylist(), batch.column("text").to_pylist()
        wanted = [np.array(found, np.int64) for found in batch.column("grams").to_pylist()]
        rows: dict[tuple[int, bytes], list] = {}
        for number, start, count, bucket in neighbourhoods(texts, length, gram):
            cuts = np.flatnonzero(np.diff(number)) + 1
            for at in np.split(np.arange(len(number)), cuts):
                text = int(number[at[0]])
                at = at[np.isin(bucket[at], wanted[text])]
                for i, n, head in zip(start[at].tolist(), count[at].tolist(), bucket[at].tolist()):
                    context = xxhash.xxh3_128_digest(texts[text][i : i + n + length - 1])
                    rows.setdefault((text, context), [head, n, []])[2].append(i)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row[0] for row in rows.values()], pa.int64()),
                    pa.array([context for _, context in rows], pa.binary()),
                    pa.array([keys[text] for text, _ in rows], pa.binary()),
                    pa.array([row[2] for row in rows.values()], pa.list_(pa.int32())),
                    pa.array([row[1] for row in rows.values()], pa.int32()),
                ],
                ["gram", "context", "key", "starts", "windows"],
            )


def _refine_buckets(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Refines whole buckets, several at once; rows arrive sorted by bucket."""

    def refined(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        hits = repeated_windows([content for _, _, content in rows], length)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([context for _, context, _ in rows], pa.binary()),
                pa.array([hit.tolist() for hit in hits], pa.list_(pa.int32())),
            ],
            ["context", "hits"],
        )

    held: list[tuple[int, bytes, bytes]] = []
    for row in _rows(batches, ("gram", "context", "content")):
        if len(held) >= PACK and held[-1][0] != row[0]:
            yield refined(held)
            held = []
        held.append(row)
    if held:
        yield refined(held)


def _rows(batches: Iterator[pa.RecordBatch], names: Iterable[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(name).to_pylist() for name in names))


def _cut_texts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, froms, tos = [], [], []
        for text, marks in _rows([batch], ("text", "marks")):
            change = np.zeros(len(text) + 1, np.int32)
            for mark in marks:
                hits = mark["hits"]
                hits = np.arange(mark["windows"]) if hits is None else np.array(hits, np.int64)
                places = (np.array(mark["starts"])[:, None] + hits).ravel()
                np.add.at(change, places, 1)
                np.add.at(change, places + length, -1)
            covered = np.cumsum(change[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[0], covered, [0]])))
            kept.append(np.frombuffer(text, np.uint8)[~covered].tobytes())
            froms.append(edges[::2].tolist())
            tos.append(edges[1::2].tolist())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key"),
                pa.array(kept, pa.binary()),
                pa.array(froms, pa.list_(pa.int64())),
                pa.array(tos, pa.list_(pa.int64())),
            ],
            ["key", "kept", "starts", "ends"],
        )


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__bytes``, ``__sha256`` and ``__key`` of each text (null: empty)."""
    content = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    found = docs.withColumns({"__bytes": content, "__sha256": F.sha2(content, 256)})
    return found.withColumn("__key", F.substring(F.unhex("__sha256"), 1, 16))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """What goes from each text that holds ``length`` bytes which also start elsewhere.

    Returns ``key`` (of ``keyed``), ``kept`` (binary: the remaining bytes) and
    ``starts``, ``ends`` of the maximal removed runs, one row per distinct text
    that loses anything. Matches stay inside a document, all are judged on the
    input, and may overlap. A null text is empty; texts shorter than ``length``
    lose nothing; a text of at least ``length`` bytes that a second row repeats
    goes whole. Ids play no part, so rows with null or equal ids are documents
    of their own. An empty table gives an empty result.

    Copies of a text are one text. A passage that many texts hold is a few
    distinct neighbourhoods, whatever its number of holders. Equality rests on
    128-bit hashes of neighbourhoods, and on the bytes themselves where two
    neighbourhoods share a gram but differ.
    """
    if not 0 < gram <= length:
        raise ValueError("a gram must have at least one byte and fit in the length")
    texts = keyed(docs).select(F.col("__key").alias("key"), F.col("__bytes").alias("text"))
    texts = texts.where(F.octet_length("text") >= length)

    def run(step, *sizes):
        return functools.partial(step, **dict(zip(("length", "gram"), sizes)))

    grams = texts.mapInArrow(
        run(_grams_of_texts, length, gram), "gram long, key binary, several boolean"
    )
    grams = materialize(grams, "repeat-grams")
    shared = (
        grams.groupBy("gram")
        .agg(F.min("key").alias("one"), F.max("key").alias("other"), F.max("several").alias("s"))
        .where((F.col("one") != F.col("other")) | F.col("s"))
        .select("gram")
    )
    found = grams.join(shared, "gram").groupBy("key").agg(F.collect_set("gram").alias("grams"))
    held = texts.groupBy("key").agg(F.first("text").alias("text")).join(found, "key")
    held = materialize(held, "repeat-texts")

    members = held.mapInArrow(
        run(_members_of_texts, length, gram),
        "gram long, context binary, key binary, starts array<int>, windows int",
    )
    members = materialize(members, "repeat-members")
    contexts = members.groupBy("gram", "context").agg(
        F.min(F.struct("key", F.col("starts")[0].alias("start"), "windows")).alias("at"),
        ((F.min("key") != F.max("key")) | (F.max(F.size("starts")) > 1)).alias("again"),
    )
    contexts = materialize(contexts, "repeat-contexts")
    verdicts = contexts.where("again").select(
        "context", F.lit(None).cast("array<int>").alias("hits")
    )
    verdicts = verdicts.unionByName(_open_windows(contexts, held, length))
    marks = (
        members.join(verdicts, "context")
        .groupBy("key")
        .agg(F.collect_list(F.struct("starts", "windows", "hits")).alias("marks"))
    )
    return held.select("key", "text").join(marks, "key").mapInArrow(
        run(_cut_texts, length), "key binary, kept binary, starts array<long>, ends array<long>"
    )


def _open_windows(contexts: DataFrame, held: DataFrame, length: int) -> DataFrame:
    """Repeated windows of contexts that share a gram with a different one."""
    sizes = contexts.groupBy("gram").agg(
        F.count("*").alias("size"), F.bool_and("again").alias("settled")
    )
    sizes = sizes.where((F.col("size") > 1) & ~F.col("settled")).drop("settled")
    asked = contexts.join(sizes, "gram").select("gram", "context", "size", "at.*")
    content = F.substring(
        F.col("text"), F.col("start") + 1, F.col("windows") + F.lit(length - 1)
    )
    asked = asked.join(held.select("key", "text"), "key").select(
        "gram", "context", "size", "windows", content.alias("content")
    )
    asked = materialize(asked, "repeat-contents")

    small = asked.where(F.col("size") <= PACK).select("gram", "context", "content")
    small = small.repartition("gram").sortWithinPartitions("gram")
    refined = small.mapInArrow(
        functools.partial(_refine_buckets, length=length), "context binary, hits array<int>"
    )

    place = F.explode(F.sequence(F.lit(0), F.col("windows") - 1))
    windows = asked.where(F.col("size") > PACK).select("context", "content", place.alias("place"))
    bucket = F.unhex(F.md5(F.substring(F.col("content"), F.col("place") + 1, F.lit(length))))
    windows = windows.select("context", "place", bucket.alias("bucket"))
    where = F.struct("context", "place")
    several = (
        windows.groupBy("bucket")
        .agg(F.min(where).alias("one"), F.max(where).alias("other"))
        .where(F.col("one") != F.col("other"))
        .select("bucket")
    )
    crowded = windows.join(several, "bucket").groupBy("context")
    crowded = crowded.agg(F.collect_list("place").alias("hits"))
    return refined.unionByName(crowded).where(F.size("hits") > 0)


def removals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` of each row.

    Rows as in ``repeats``; columns of ``docs`` with these names give way.
    """
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    rows = keyed(docs.drop(*names))
    rows = rows.withColumn("n_bytes", F.octet_length("__bytes").cast("long")).drop("__bytes")
    own = rows.select("__key", "n_bytes").groupBy("__key").agg(F.count("*").alias("__copies"))
    copied = own.where("__copies > 1")
    cut = repeats(docs, length, gram).select(
        F.col("key").alias("__key"),
        F.octet_length("kept").cast("long").alias("__left"),
        F.size("starts").cast("long").alias("__spans"),
        F.sha2("kept", 256).alias("__cut"),
    )
    gone = F.col("__copies").isNotNull() & (F.col("n_bytes") >= length)
    joined = rows.join(copied, "__key", "left").join(cut, "__key", "left")
    return joined.select(
        *[c for c in docs.columns if c not in names],
        "n_bytes",
        F.when(gone, F.col("n_bytes"))
        .otherwise(F.coalesce(F.col("n_bytes") - F.col("__left"), F.lit(0)))
        .alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("__spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(b""), 256))
        .otherwise(F.coalesce("__cut", "__sha256"))
        .alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with the binary column ``kept``: each text without its repeated bytes.

    Rows as in ``repeats``. Cut texts may end inside a UTF-8 character, hence
    the binary type.
    """
    rows = keyed(docs.drop("kept"))
    own = rows.select("__key").groupBy("__key").agg(F.count("*").alias("__copies"))
    cut = repeats(docs, length, gram)
    cut = cut.select(F.col("key").alias("__key"), F.col("kept").alias("__kept"))
    joined = rows.join(own.where("__copies > 1"), "__key", "left").join(cut, "__key", "left")
    gone = F.col("__copies").isNotNull() & (F.octet_length("__bytes") >= length)
    kept = F.when(gone, F.lit(b"")).otherwise(F.coalesce("__kept", "__bytes"))
    return joined.select(*[c for c in docs.columns if c != "kept"], kept.alias("kept"))
