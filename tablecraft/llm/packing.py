"""Best-fit packing of documents into sequences, planned on a length histogram."""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 2048
END_ID = 0
# Words, and parts of words, that a Python worker remembers: under 300 MB.
REMEMBERED_WORDS = 800_000
# Ranks are counted within (length, bucket), so that a length which holds a
# third of all pieces is ranked by so many tasks.
RANK_BUCKETS = 128
_RANK_BITS = 44
_SIGNS = re.compile(r"[!-&(-/:-@\[-`{-~]+\Z")  # ASCII signs but the apostrophe
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_GAPS = re.compile(r"[^\S\x1c-\x1f]+")
_LATIN_END = "\u0130"  # before it, lower case is one code point for one


def _byte_letters() -> list[str]:
    """The printable character that byte-level tokenizers write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(byte if byte in plain else next(spare)) for byte in range(256)]


class _Memo(dict):
    """Values of a function, computed when missing; about the last ``size`` used."""

    def __init__(self, function: Callable[[str], bytes], size: int) -> None:
        super().__init__()
        self._function, self._half, self._old = function, size // 2, {}

    def __missing__(self, key: str) -> bytes:
        value = self._old.get(key)
        if value is None:
            value = self._function(key)
        if len(self) >= self._half:
            self._old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordTokenizer:
    """Token ids by way of the words between white space, each encoded once.

    Valid for byte-level tokenizers that drop white space and lower the case
    before anything else, so that a text's ids are its words' ids in a row. A
    word of letters with a tail of ASCII signs splits before the tail, as the
    vocabularies this is written for never join letters and signs.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._letters = _byte_letters()
        self._parts = _Memo(self._part, REMEMBERED_WORDS)
        self._words = _Memo(self._word, REMEMBERED_WORDS)

    def __call__(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids, the end id included."""
        return b"".join(map(self._words.__getitem__, _split(text or ""))) + _END

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        tail = _SIGNS.search(word)
        letters = word[: tail.start()] if tail else word
        if not (letters.isalpha() and max(letters) < _LATIN_END):
            return self._encode(word)
        ids = self._parts[letters.lower()]
        return ids + self._parts[tail.group()] if tail else ids

    def _part(self, part: str) -> bytes:
        if not part.isalpha():
            return self._encode(part)
        letters = "".join(map(self._letters.__getitem__, part.encode("utf-8")))
        return _bytes(token.id for token in self._tokenizer.model.tokenize(letters))

    def _encode(self, text: str) -> bytes:
        return _bytes(self._tokenizer.encode(text, add_special_tokens=False).ids)


def _split(text: str) -> list[str]:
    """The parts between white space; four separators that Python adds are none."""
    if any(mark in text for mark in _SEPARATORS):
        return _GAPS.sub(" ", text).split(" ")
    return text.split()


def _bytes(ids: Iterable[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else b"".join(
        value.to_bytes(4, "little") for value in ids
    )


_END = END_ID.to_bytes(4, "little")


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


def tokenize(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids: ``doc_id, piece, start, length, ids``.

    A document's ids are those of its text, then 0; null text counts as empty,
    so every row has a piece. Longer documents are cut into full pieces, the
    last one may be shorter. ``ids`` is binary: little-endian unsigned 32 bit.
    ``vocabulary`` is the path of the tokenizer file on every executor.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py())
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc_id, piece, start, len(part) // 4, part))
                size += len(ids)
                if size > 1 << 22:
                    yield _piece_batch(rows)
                    rows, size = [], 0
            if rows:
                yield _piece_batch(rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        pieces, "doc_id long, piece int, start long, length long, ids binary"
    )


_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
    ]
)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), _PIECES.types)]
    return pa.RecordBatch.from_arrays(columns, schema=_PIECES)


class Plan(NamedTuple):
    """Runs of slots, ordered by length and rank.

    Run i gives the ``count[i]`` pieces of ``length[i]`` that rank from
    ``rank[i]`` on one slot each: at ``offset[i]`` in the sequences from
    ``sequence[i]`` on.
    """

    length: np.ndarray
    rank: np.ndarray
    count: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best-fit decreasing over a histogram of lengths.

    Sequences that are equally full are handled together as ranges of numbers,
    so the work and the plan depend on ``capacity`` and not on the counts: at
    most one range per length is made and one is split, and each range is
    extended at most ``capacity`` times.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        free = length
        while left and free < capacity:
            ranges = room.get(free)
            if not ranges:
                free += 1
                continue
            first, size = ranges.pop()
            used = min(size, left)
            if used < size:
                ranges.append((first + used, size - used))
            runs.append((length, rank, used, first, capacity - free))
            rank, left = rank + used, left - used
            rest = free - length
            if rest:
                room.setdefault(rest, []).append((first, used))
            if rest >= length:
                free = rest
        per = capacity // length
        for size, items in ((left // per, per), (1, left % per)):
            if size and items:
                for slot in range(items):
                    runs.append((length, rank, size, opened, slot * length))
                    rank += size
                rest = capacity - items * length
                if rest:
                    room.setdefault(rest, []).append((opened, size))
                opened += size
    table = np.array(runs, np.int64).reshape(-1, 5)
    return Plan(*table[np.lexsort((table[:, 1], table[:, 0]))].T)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id, offset`` to stored ``pieces``.

    ``pieces`` needs ``doc_id, piece, start, length`` and is read three times,
    so store it first (without token ids: assemble() joins them). Lengths run
    from 1 to ``capacity``. Repeated rows are pieces of their own; a null id is
    allowed; an empty table gives an empty result. Sequences are filled from 0
    on without gaps.

    The driver sees one count per length. Pieces are ranked within their length
    and take the slot planned for the rank; which piece of a length takes which
    slot follows a hash of its id.
    """
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_BUCKETS))
    named = pieces.withColumn("__bucket", bucket)
    sizes = named.groupBy("length", "__bucket").count()
    counts = {
        row["length"]: row["total"]
        for row in sizes.groupBy("length").agg(F.sum("count").alias("total")).collect()
    }
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths must be 1 to {capacity}")
    plan = best_fit_plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # at most capacity x RANK_BUCKETS rows, whatever the number of pieces
    offsets = sizes.select(
        "length", "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before")
    )
    within = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece")
    ranked = (
        named.withColumn("__within", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), ["length", "__bucket"])
        .withColumn("__rank", F.col("__before") + F.col("__within"))
    )
    order = (plan.length << _RANK_BITS) + plan.rank

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = (length.to_numpy(np.int64) << _RANK_BITS) + rank.to_numpy(np.int64)
        run = np.searchsorted(order, key, side="right") - 1
        return pd.DataFrame(
            {
                "sequence_id": plan.sequence[run] + rank.to_numpy(np.int64) - plan.rank[run],
                "offset": plan.offset[run],
            }
        )

    placed = ranked.withColumn("__slot", slot("length", "__rank"))
    return placed.select(*pieces.columns, "__slot.sequence_id", "__slot.offset")


def assemble(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """``sequence_id, length, ids``: the packed sequences themselves.

    ``pieces`` carries ``ids``, ``placed`` is pack()'s result for them; rows are
    matched by ``doc_id`` and ``piece``, so ids must be unique and not null.
    """
    slots = placed.select("doc_id", "piece", "sequence_id", "offset")
    return (
        pieces.join(slots, ["doc_id", "piece"])
        .groupBy("sequence_id")
        .agg(
            F.sum("length").alias("length"),
            F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"),
        )
        .select("sequence_id", "length", F.expr("array_join(transform(parts, p -> hex(p.ids)), '')").alias("hex"))
        .select("sequence_id", "length", F.unhex("hex").alias("ids"))
    )
