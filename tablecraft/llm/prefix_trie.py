"""Prefix tries of conversations, packed as double arrays.

A turn is known by a 128-bit hash of its role and text, and a node by a chained
hash of its turns. Sequences are sharded by a prefix short enough that a shard
holds few distinct sequences; each shard is a double array, and the nodes above
the shards' prefixes are merged from all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.session import materialize

# Distinct sequences that may share a shard's prefix.
SHARD = 2048
# Sequences that a task packs at once: whole shards, until there are so many.
PACK = 4096
# Ends of one node are joined in blocks of 2 ** ID_BITS consecutive ids.
ID_BITS = 12
# Free slots that are tried for a node's children before the end of the arrays.
TRIES = 32

ROOT = bytes(16)
HEADS = 8
_NODE = (
    "upper boolean, key binary, parent_key binary, path array<binary>, depth long, conv_id long, "
    "parent_conv_id long, size long, n_convs long, n_children long, n_leaves long, saved long"
)


class DoubleArray:
    """Children of slot ``s`` by symbol ``c``: slot ``base[s] + c``, if its check is ``s``."""

    def __init__(self) -> None:
        self.base = np.zeros(1024, np.int64)
        self.check = np.full(1024, -1, np.int64)
        self.check[0] = 0
        self._free = 1  # no slot before this one is free
        self._end = 1  # all slots from here on are free

    def place(self, parent: int, symbols: np.ndarray) -> None:
        """Put the children of ``parent`` (ascending symbols) into free slots."""
        while self.check[self._free] >= 0:
            self._free += 1
        offsets = symbols - symbols[0]
        first, tries = self._free, TRIES
        self._reserve(first + offsets[-1])
        while tries and (self.check[first + offsets] >= 0).any():
            first, tries = first + 1, tries - 1
            self._reserve(first + offsets[-1])
        if not tries:
            first = self._end
            self._reserve(first + offsets[-1])
        self.check[first + offsets] = parent
        self.base[parent] = first - symbols[0]
        self._end = max(self._end, int(first + offsets[-1]) + 1)

    def step(self, slots: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Child slot of each slot by its symbol; -1 where there is none."""
        found = self.base[slots] + symbols
        inside = (found > 0) & (found < len(self.check))
        ok = inside & (self.check[np.where(inside, found, 0)] == slots)
        return np.where(ok, found, -1)

    def _reserve(self, slot: int) -> None:
        while slot + 1 >= len(self.check):
            self.base = np.concatenate([self.base, np.zeros(len(self.base), np.int64)])
            self.check = np.concatenate([self.check, np.full(len(self.check), -1, np.int64)])


def _pack(sequences: list[tuple]) -> pa.RecordBatch:
    """Nodes of whole shards. ``sequences``: end, turns, n, conv_id, cut."""
    lengths = np.array([len(turns) for _, turns, _, _, _ in sequences])
    members = np.array([n for _, _, n, _, _ in sequences], np.int64)
    convs = np.array([conv for _, _, _, conv, _ in sequences], np.int64)
    cuts = np.array([cut for _, _, _, _, cut in sequences], np.int64)
    # Turns get dense ids, near each other for the children of one node.
    dense: dict[bytes, int] = {}
    keys: list[bytes] = []
    sizes: list[int] = []
    symbols: list[np.ndarray] = []
    trie = DoubleArray()
    slots = np.zeros(len(sequences), np.int64)
    for depth in range(int(lengths.max(initial=0))):
        alive = np.flatnonzero(lengths > depth)
        alive = alive[np.argsort(slots[alive], kind="stable")]
        own = np.empty(len(alive), np.int64)
        for i, s in enumerate(alive.tolist()):
            turn = sequences[s][1][depth]
            symbol = dense.setdefault(turn["key"], len(dense))
            if symbol == len(keys):
                keys.append(turn["key"])
                sizes.append(turn["size"])
            own[i] = symbol
        pairs = np.unique(np.stack([slots[alive], own]), axis=1)
        cutsets = np.flatnonzero(np.diff(pairs[0])) + 1
        for part in np.split(np.arange(pairs.shape[1]), cutsets):
            trie.place(int(pairs[0, part[0]]), pairs[1, part])
        at_depth = np.full(len(sequences), -1, np.int64)
        at_depth[alive] = own
        symbols.append(at_depth)
        slots[alive] = trie.step(slots[alive], own)
    return _traverse(trie, sequences, symbols, keys, np.array(sizes, np.int64), members, convs, cuts)


def _traverse(trie, sequences, symbols, keys, sizes, members, convs, cuts) -> pa.RecordBatch:
    """Walk every sequence down the arrays, then sum up from the leaves."""
    width = len(trie.check)
    n_convs = np.zeros(width, np.int64)
    conv = np.full(width, np.iinfo(np.int64).max, np.int64)
    cut = np.zeros(width, np.int64)
    symbol = np.full(width, -1, np.int64)
    levels = [np.zeros(1, np.int64)]
    slots = np.zeros(len(sequences), np.int64)
    alive = np.arange(len(sequences))
    for depth in range(len(symbols) + 1):
        np.add.at(n_convs, slots[alive], members[alive])
        np.minimum.at(conv, slots[alive], convs[alive])
        np.maximum.at(cut, slots[alive], cuts[alive])
        if depth < len(symbols):
            alive = alive[symbols[depth][alive] >= 0]
            own = symbols[depth][alive]
            slots[alive] = trie.step(slots[alive], own)
            symbol[slots[alive]] = own
            levels.append(np.unique(slots[alive]))
    end = {int(slot): row[0] for slot, row in zip(slots, sequences)}

    upper = np.zeros(width, bool)
    children = np.zeros(width, np.int64)
    leaves = np.zeros(width, np.int64)
    saved = np.zeros(width, np.int64)
    for depth in reversed(range(len(levels))):
        level = levels[depth]
        upper[level] = depth < cut[level]
        # Above the cut, counts and leaves need all shards.
        final = level[~upper[level]]
        leaves[final] += children[final] == 0
        saved[final] += (n_convs[final] - 1) * sizes[symbol[final]]
        if depth:
            parents = trie.check[final]
            np.add.at(children, parents, 1)
            np.add.at(leaves, parents, leaves[final])
            np.add.at(saved, parents, saved[final])

    path: dict[int, list[bytes]] = {}
    rows = []
    for depth, level in enumerate(levels):
        for slot in level.tolist():
            parent = int(trie.check[slot])
            size = int(sizes[symbol[slot]]) if depth else 0
            key = parent_key = above = parent_conv = None
            if upper[slot]:
                above = [*path[parent]] if depth else []
                key = _chain(above[-1], keys[symbol[slot]]) if depth else ROOT
                path[slot] = [*above, key]
            else:
                key = end.get(slot)
                parent_conv = None if upper[parent] else int(conv[parent])
            if depth and upper[parent]:
                parent_key = path[parent][-1]
            rows.append((bool(upper[slot]), key, parent_key, above, depth, int(conv[slot]),
                         parent_conv, size, int(n_convs[slot]), int(children[slot]),
                         int(leaves[slot]), int(saved[slot])))
    kinds = [pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.binary()), *[pa.int64()] * 8]
    names = [column.split()[0] for column in _NODE.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)], names
    )


def _chain(key: bytes, turn: bytes) -> bytes:
    return hashlib.sha256(key + turn).digest()[:16]


def _pack_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Double arrays of whole shards; rows arrive sorted by shard."""
    held: list[tuple] = []
    last = None
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("shard", "end", "turns", "n", "conv_id", "cut"))
        for shard, *row in zip(*columns):
            if len(held) >= PACK and shard != last:
                yield _pack(held)
                held = []
            held.append(tuple(row))
            last = shard
    if held:
        yield _pack(held)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of each sequence's prefixes of 1, 2, 4, 8 ... turns."""
    for batch in batches:
        ends, depths, prefixes = [], [], []
        for end, turns in zip(batch.column("end").to_pylist(), batch.column("turns").to_pylist()):
            key = ROOT
            for depth, turn in enumerate(turns, 1):
                key = _chain(key, turn["key"])
                if depth & (depth - 1) == 0:
                    ends.append(end)
                    depths.append(depth)
                    prefixes.append(key)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ends, pa.binary()), pa.array(depths, pa.int64()), pa.array(prefixes, pa.binary())],
            ["end", "depth", "prefix"],
        )


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids; their blocks arrive in order and are not kept."""
    last, digest = None, hashlib.sha256()
    for batch in batches:
        done = []
        for end, part in zip(batch.column("end").to_pylist(), batch.column("part").to_pylist()):
            if end != last:
                if last is not None:
                    done.append((last, digest.hexdigest()))
                last, digest = end, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(part.encode())
        yield _digests(done)
    yield _digests([] if last is None else [(last, digest.hexdigest())])


def _digests(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())],
        ["end", "ends_sha256"],
    )


def turn_sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order, as key and text size.

    Turns are ordered by ``turn``, null first; ties and repeated rows all stay,
    in the order of their keys. Null role or text is empty. Rows without a
    conv_id belong to no conversation and go. A conversation is one row of 32
    bytes a turn; texts are read once and not shuffled.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(
        F.col("turn").isNotNull().alias("known"),
        F.col("turn").cast("long").alias("turn"),
        F.substring(F.unhex(F.sha2(named.cast("binary"), 256)), 1, 16).alias("key"),
        F.octet_length(text).cast("long").alias("size"),
    )
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn")
    )
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return listed.select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["key"], t["size"])).alias("turns")
    )


def with_shared_heads(sequences: DataFrame, every: int = 5) -> DataFrame:
    """Conversations rebuilt on the first turns of conversation ``c - c % every``.

    The first h = crc32(decimal c) % 9 turns come from there (all if fewer, none
    if it is absent), the rest are c's own turns after its first h.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = sequences.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS).alias("head")
    )
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEADS + 1)).cast("int")
    joined = sequences.withColumns({"base": base, "taken": taken}).join(heads, "base", "left")
    own = F.slice("turns", F.col("taken") + 1, F.size("turns"))
    head = F.slice("head", F.lit(1), F.col("taken"))
    whole = F.when(F.col("head").isNull(), own).otherwise(F.concat(head, own))
    return joined.select("conv_id", F.when(F.size("turns") == 0, head).otherwise(whole).alias("turns"))


def prefix_nodes(sequences: DataFrame) -> DataFrame:
    """One row per distinct prefix of the sequences, the empty one included.

    ``sequences`` has one row per conv_id (see ``turn_sequences``). Returns
    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (root: null),
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and
    ``ends_sha256``. An empty table has no nodes.

    Equal sequences collapse to one before they are packed. A prefix with more
    than ``SHARD`` distinct sequences is no shard: those are told apart by
    prefixes twice as long, and a sequence without a longer prefix has all its
    nodes merged over the shards. Ids of equal conversations are joined in
    blocks of consecutive ids and hashed as a stream.
    """
    start = F.lit(ROOT)
    end = F.aggregate(
        "turns",
        start,
        lambda key, t: F.substring(F.unhex(F.sha2(F.concat(key, t["key"]), 256)), 1, 16),
    )
    ended = materialize(sequences.select("conv_id", "turns", end.alias("end")), "trie-sequences")
    distinct = ended.groupBy("end").agg(
        F.first("turns").alias("turns"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id")
    )
    distinct = materialize(distinct, "trie-distinct")
    prefixes = distinct.select("end", "turns").mapInArrow(
        _prefixes, "end binary, depth long, prefix binary"
    )
    crowded = prefixes.groupBy("prefix").count().where(F.col("count") > SHARD).select("prefix")
    cuts = prefixes.join(crowded, "prefix", "left_anti").groupBy("end")
    cuts = cuts.agg(F.min(F.struct("depth", "prefix")).alias("cut"))
    sharded = distinct.join(cuts, "end", "left").select(
        F.coalesce("cut.prefix", "end").alias("shard"),
        "end",
        "turns",
        "n",
        "conv_id",
        F.coalesce("cut.depth", F.size("turns") + F.lit(1)).cast("long").alias("cut"),
    )
    packed = sharded.repartition("shard").sortWithinPartitions("shard")
    packed = materialize(packed.mapInArrow(_pack_shards, _NODE), "trie-nodes")
    return _with_ends(_merge_upper(packed), _ends(ended))


def _merge_upper(packed: DataFrame) -> DataFrame:
    upper = packed.where("upper").groupBy("key").agg(
        *[F.first(c).alias(c) for c in ("parent_key", "path", "depth", "size")],
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
    )
    upper = materialize(upper, "trie-upper")
    inner = upper.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("inner"))
    n_children = F.col("n_children") + F.coalesce("inner", F.lit(0))
    upper = upper.join(inner, "key", "left").withColumns(
        {
            "n_children": n_children,
            "n_leaves": F.col("n_leaves") + (n_children == 0).cast("long"),
            "saved": F.col("saved") + (F.col("n_convs") - 1) * F.col("size"),
        }
    )
    subtree = upper.select(
        F.explode(F.concat("path", F.array("key"))).alias("key"), "n_leaves", "saved"
    )
    subtree = subtree.groupBy("key").agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")
    )
    upper = materialize(upper.drop("n_leaves", "saved").join(subtree, "key"), "trie-upper")
    parents = upper.select(
        F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")
    )
    figures = ("key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved")
    lower = packed.where(~F.col("upper"))
    below = lower.where(F.col("parent_key").isNotNull()).drop("parent_conv_id")
    return (
        lower.where(F.col("parent_key").isNull())
        .select(*figures)
        .unionByName(below.join(parents, "parent_key").select(*figures))
        .unionByName(upper.join(parents, "parent_key", "left").select(*figures))
    )


def _ends(ended: DataFrame) -> DataFrame:
    """``end, ends_sha256``: hash of the ascending ids of equal sequences."""
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string"))
    blocks = ended.groupBy("end", F.shiftright("conv_id", ID_BITS).alias("block")).agg(
        F.array_join(ids, ",").alias("part")
    )
    blocks = blocks.repartition("end").sortWithinPartitions("end", "block")
    return blocks.select("end", "part").mapInArrow(_hash_ends, "end binary, ends_sha256 string")


def _with_ends(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    empty = hashlib.sha256().hexdigest()
    ends = ends.withColumnRenamed("end", "key")
    passed = nodes.where(F.col("key").isNull()).withColumn("ends_sha256", F.lit(empty))
    ended = nodes.where(F.col("key").isNotNull()).join(ends, "key", "left")
    ended = ended.fillna({"ends_sha256": empty})
    figures = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves")
    columns = [*figures, F.col("saved").alias("saved_tokens"), "ends_sha256"]
    return passed.select(*columns).unionByName(ended.select(*columns))
