"""Words of a text, in Spark expressions and in Python helpers for tasks.

A word is a maximal run of anything but space, tab, line feed, vertical tab,
form feed and carriage return, in both forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
ROW = "__row"
# Copies of whole texts are the largest files that operators keep.
TEXT_CODEC = "zstd"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_keys(docs: DataFrame, label: str) -> DataFrame:
    """``docs``, written out with a number of its own for every row in ``ROW``.

    Rows that share an id, or have none, are told apart by it. The numbers grow
    in the order in which rows are read; they are stored, so a task that is run
    again doesn't change them.
    """
    numbered = docs.withColumn(ROW, F.monotonically_increasing_id())
    return materialize(numbered, label, codec=TEXT_CODEC)


def words(text: Column) -> Column:
    """Array of the words; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda word: word != "")


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (-1 for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))


def lowered_words(text: str | None) -> list[bytes]:
    """UTF-8 words with A-Z lower-cased; ``bytes.split`` cuts at exactly GAP."""
    return (text or "").encode("utf-8").lower().split()
