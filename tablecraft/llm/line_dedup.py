"""Line deduplication by a deletion-neighbourhood join, as built-in functions only.

Two lines within one edit agree after deleting one character from the longer
one, or from both at the same place. All such variants of all lines would be as
many rows as the corpus has characters, so they are emitted for the part of a
line that can differ only: a line is cut into blocks, and a block is looked at
further only if another line has the same text around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecraft.llm.quality_rules import BLANKS, let
from tablecraft.llm.text import ROW, with_row_keys
from tablecraft.session import materialize

# Shorter lines are duplicates only if they are equal.
MIN_FUZZY = 16
EDITS = 1
BLOCKS = 3
INNER_BLOCKS = 4
_LAST_ID = (1 << 63) - 1


def document_lines(docs: DataFrame) -> DataFrame:
    """``id, row, no, line, h`` of every line with a word, blanks at its ends cut off."""
    return (
        docs.select(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)).alias("id"),
            F.col(ROW).alias("row"),
            F.posexplode(F.split("text", "\n")).alias("no", "raw"),
        )
        .select("id", "row", "no", F.btrim("raw", F.lit(BLANKS)).alias("line"))
        .where(F.col("line") != "")
        .withColumn("h", F.xxhash64("line"))
    )


def _around(text: Column, length: Column, part: int, parts: int) -> tuple[Column, ...]:
    """Block ``part`` of a text, and the text before and after it.

    Cuts are counted from the start before the block and from the end after it,
    for a text of ``length`` characters; a text of one more has it in the block.
    """
    start = F.floor(length * part / parts).cast("int")
    rest = (length - F.floor(length * (part + 1) / parts)).cast("int")
    before = F.substring(text, F.lit(1), start)
    after = F.when(rest > 0, F.right(text, rest)).otherwise("")
    block = F.substring(text, start + 1, F.length(text) - start - rest)
    return block, before, after


def _blocks(group: Column, text: Column, longer: Column, parts: int) -> list[tuple[Column, ...]]:
    """Key and text of every block of a text that belongs to a group."""
    length = F.length(text) - longer.cast("int")
    entries = []
    for part in range(parts):
        block, before, after = _around(text, length, part, parts)
        entries.append((F.xxhash64(group, length, F.lit(part), before, after), longer, block))
    return entries


def _shared(texts: DataFrame, entries: list[tuple[Column, ...]]) -> DataFrame:
    """``h, key, longer, block`` of the blocks whose key two lines have.

    ``entries`` are those of every row of ``texts``, which has ``h``. Keys are counted
    and looked up without the blocks, which are cut out of the lines concerned only.
    """
    counted = texts.select("h", F.explode(F.array(*(key for key, _, _ in entries))).alias("key"))
    several = materialize(
        counted.groupBy("key")
        .agg(F.min("h").alias("least"), F.max("h").alias("most"))
        .where(F.col("least") != F.col("most"))
        .select("key"),
        "shared-keys",
    )
    concerned = materialize(
        counted.join(several, "key", "left_semi").select("h").distinct(), "concerned-lines"
    )
    named = [
        F.struct(key.alias("key"), longer.alias("longer"), block.alias("block"))
        for key, longer, block in entries
    ]
    keyed = (
        texts.join(concerned, "h", "left_semi")
        .select("h", F.explode(F.array(*named)).alias("k"))
        .select("h", "k.*")
    )
    return materialize(keyed.join(several, "key", "left_semi").distinct(), "shared-blocks")


def _without(text: Column, place: Column) -> Column:
    return F.concat(
        F.substring(text, F.lit(1), place - 1),
        F.substring(text, place + 1, F.length(text)),
    )


def near_earlier(lines: DataFrame, first: DataFrame) -> DataFrame:
    """``h`` of the lines that are one edit away from a line that comes earlier.

    ``first`` has the place ``id, row, no`` of the first occurrence of each ``h``. In
    a group of equal variants the earliest line decides for all others, so no
    pairs are made: lines that agree without character i differ in it only, and
    a shorter line that equals a longer one's variant is one deletion away.
    """
    long_lines = lines.where(F.length("line") >= MIN_FUZZY).select("h", "line")
    whole = [
        entry
        for longer in (False, True)
        for entry in _blocks(F.lit(0).cast("long"), F.col("line"), F.lit(longer), BLOCKS)
    ]
    rows = _shared(long_lines, whole)
    inner = _blocks(F.col("key"), F.col("block"), F.col("longer"), INNER_BLOCKS)
    rows = _shared(rows, inner).join(first, "h")
    block, key = F.col("block"), F.col("key")
    places = F.filter(F.sequence(F.lit(1), F.length("block")), lambda i: i <= F.length("block"))
    places = F.when(F.length("block") > 0, places).otherwise(F.array().cast("array<int>"))
    shorter_keys = F.concat(
        F.array(F.xxhash64(key, F.lit(0), block)),
        F.transform(places, lambda i: F.xxhash64(key, i, _without(block, i))),
    )
    longer_keys = F.transform(places, lambda i: F.xxhash64(key, F.lit(0), _without(block, i)))
    variants = materialize(
        rows.select(
            "h", "longer", "block", "id", "row", "no",
            F.explode(
                F.when(F.col("longer"), F.array_distinct(longer_keys)).otherwise(shorter_keys)
            ).alias("variant"),
        ),
        "line-variants",
    )
    place = F.struct("id", "row", "no", "block")
    earliest = variants.groupBy("variant").agg(
        F.min(F.when(~F.col("longer"), place)).alias("short"),
        F.min(F.when(F.col("longer"), place)).alias("long"),
        (F.min("h") != F.max("h")).alias("several"),
    ).where("several")
    own = F.struct("id", "row", "no")

    def decides(other: str) -> Column:
        partner = F.col(other)
        earlier = F.struct(partner["id"], partner["row"], partner["no"]) < own
        return earlier & (F.levenshtein(block, partner["block"], EDITS) >= 0)

    decided = F.when(F.col("longer"), decides("short")).otherwise(
        F.coalesce(decides("short"), F.lit(False)) | F.coalesce(decides("long"), F.lit(False))
    )
    return variants.join(earliest, "variant").where(decided).select("h").distinct()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated and nearly repeated lines removed from the texts.

    A line goes if an earlier line, in order of ``doc_id`` and place, equals it
    or is within one edit of it (a character put in, left out or changed), also
    if that line goes itself; blanks at the ends of a line don't count, and lines
    of under 16 characters must be equal. The earliest stays. Lines without a
    word always stay. All rows and columns are kept, and two columns are added,
    ``__lines`` and ``__dropped``: lines with a word, and those removed.

    A null text stays null; a text that loses all its lines becomes empty. Rows
    without an id come last. Rows that share an id, or have none, are documents
    of their own, in the order in which they are read. An empty table gives an
    empty result.
    """
    keyed = with_row_keys(docs, "line-rows")
    lines = document_lines(keyed)
    first = materialize(
        lines.groupBy("h").agg(F.min(F.struct("id", "row", "no")).alias("at")).select("h", "at.*"),
        "first-lines",
    )
    gone = near_earlier(lines, first)
    kept = (
        first.join(gone, "h", "left_anti")
        .groupBy(F.col("row").alias(ROW))
        .agg(F.collect_list("no").alias("__kept"))
    )
    none = F.array().cast("array<int>")

    def rebuilt(parts: Column) -> Column:
        blank = F.filter(
            F.transform(parts, lambda p, i: F.when(F.btrim(p, F.lit(BLANKS)) == "", i)),
            lambda i: i.isNotNull(),
        )
        mine = F.filter(F.coalesce("__kept", F.lit(none)), lambda i: i < F.size(parts))
        order = F.sort_array(F.array_union(mine, blank))
        return F.struct(
            F.array_join(F.transform(order, lambda i: F.get(parts, i)), "\n").alias("text"),
            (F.size(parts) - F.size(blank)).cast("long").alias("lines"),
            (F.size(parts) - F.size(order)).cast("long").alias("dropped"),
        )

    result = keyed.join(kept, ROW, "left").withColumn(
        "__new", let(F.split("text", "\n"), rebuilt)
    )
    others = [F.col("__new.text").alias(c) if c == "text" else F.col(c) for c in docs.columns]
    zero = F.lit(0).cast("long")
    return result.select(
        *others,
        F.coalesce("__new.lines", zero).alias("__lines"),
        F.coalesce("__new.dropped", zero).alias("__dropped"),
    )
