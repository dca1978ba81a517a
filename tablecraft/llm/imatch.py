"""I-Match fingerprints with randomised lexicons, as built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.llm.quality_rules import let, split_words
from tablecraft.llm.text import ascii_lower
from tablecraft.session import materialize

# Terms in at least LOW and at most HIGH of all documents form the lexicon. A
# document has d distinct terms on average, so no more than d / LOW terms pass:
# about a million for long documents, however large the corpus.
LOW = 0.001
HIGH = 0.1
# (parts the lexicon is cut into at random, how many of them are subsets). The
# whole lexicon tells exact copies; small subsets survive edits, and which size
# is right depends on the length of the document.
SUBSETS = ((1, 1), (16, 3), (128, 12), (1024, 16))
# Lists that the lexicon is split into by a hash.
SHELVES = 1 << 15
# Documents that one task puts in order, and the most tasks to do it.
BUCKET_ROWS = 4096
MOST_BUCKETS = 100_000
_QUANTILES = 200
_NO_ID = -(1 << 63)


def terms(text: Column) -> Column:
    """Distinct 64-bit hashes of the lower-cased words, in order."""
    hashes = F.transform(split_words(ascii_lower(text)), lambda word: F.xxhash64(word))
    return F.sort_array(F.array_distinct(hashes))


def lexicon(texts: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """``term``: hashes of the terms in the band of document frequencies.

    ``texts`` has a column ``text`` without nulls. Counting combines before the
    shuffle, so a term in every document is a row per task.
    """
    counted = texts.select(F.explode(terms(F.col("text"))).alias("term"))
    frequency = counted.groupBy("term").count()
    total = texts.count()
    kept = frequency.where(F.col("count").between(math.ceil(low * total), max(high * total, 1)))
    return materialize(kept.select("term"), "lexicon")


def _ordered_buckets(docs: DataFrame) -> tuple[Column, DataFrame]:
    """Bucket of an id, and the first id of each bucket with the bucket before.

    Buckets follow quantiles of the ids, and are cut evenly between two of them.
    """
    total = docs.count()
    wanted = min(MOST_BUCKETS, max(1, total // BUCKET_ROWS))
    quantiles = min(_QUANTILES, wanted)
    parts = -(-wanted // quantiles)
    at = [i / quantiles for i in range(quantiles + 1)]
    bounds = docs.agg(F.percentile_approx("id", at, 10_000)).first()[0] or [0, 0]
    bounds = sorted(set(bounds))
    known = F.array(*(F.lit(b).cast("long") for b in bounds))
    place = F.greatest(
        F.size(F.filter(known, lambda b: b <= F.col("id"))) - 1, F.lit(0)
    )
    low = F.get(known, place).cast("double")
    high = F.coalesce(F.get(known, place + 1), F.get(known, place) + 1).cast("double")
    inner = F.floor((F.col("id") - low) / (high - low) * parts)
    inner = F.greatest(F.least(inner, F.lit(parts - 1)), F.lit(0))
    bucket = (place * parts + inner).cast("int")
    firsts = sorted(
        docs.select("id", bucket.alias("bucket"))
        .groupBy("bucket")
        .agg(F.min("id").alias("id"))
        .collect()
    )
    # the document after the last one is the first one
    before = [(row["id"], firsts[i - 1]["bucket"], i == 0) for i, row in enumerate(firsts)]
    spark = docs.sparkSession
    return bucket, spark.createDataFrame(before, "first_id long, to int, wrap boolean")


def with_next(docs: DataFrame) -> DataFrame:
    """``bucket, place, guest, doc_id, text, next_text``.

    The next document is the one with the next larger id, after the last the
    first; rows with the same id follow each other by a hash of their text. A
    null id comes before all others. ``place`` numbers the rows of a bucket.
    The text is shuffled once: a bucket also receives the first document of the
    next one, as a guest at its end. There is one row per row of ``docs`` that is
    no guest.
    """
    named = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    bucket, firsts = _ordered_buckets(named.select("id"))
    # at most MOST_BUCKETS rows
    joined = named.join(F.broadcast(firsts), F.col("id") == F.col("first_id"), "left")
    own = F.struct(bucket.alias("bucket"), F.lit(False).alias("guest"), F.lit(False).alias("wrap"))
    guest = F.struct(F.col("to").alias("bucket"), F.lit(True).alias("guest"), F.col("wrap"))
    visits = F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, guest))
    sent = joined.select(
        "doc_id", "id", "text", F.xxhash64("text").alias("hash"), F.explode(visits).alias("visit")
    ).select("doc_id", "id", "text", "hash", "visit.*")
    order = Window.partitionBy("bucket").orderBy("wrap", "id", "hash", "guest")
    return (
        sent.withColumn("next_text", F.lead("text").over(order))
        .withColumn("place", F.row_number().over(order))
        .withColumn("next_text", F.coalesce("next_text", "text"))
        .select("bucket", "place", "guest", "doc_id", "text", "next_text")
    )


def edited(text: Column, following: Column) -> Column:
    """The text with its second half replaced by the start of the following one."""
    half = F.floor(F.length(text) / 2).cast("int")
    kept = F.substring(text, F.lit(1), F.length(text) - half)
    return F.concat(kept, F.substring(following, F.lit(1), half))


def _in_shelves(known: DataFrame) -> DataFrame:
    """The lexicon as one row, ``always, shelves``: its terms by a hash.

    As bounded as the lexicon itself. Joined on a constant it lets a document's
    terms be looked up within the row, instead of a row for each term.
    """
    spark = known.sparkSession
    shelf = F.pmod("term", F.lit(SHELVES)).alias("shelf")
    filled = known.groupBy(shelf).agg(F.collect_list("term").alias("terms"))
    none = F.array().cast("array<bigint>")
    return (
        spark.range(SHELVES)
        .withColumnRenamed("id", "shelf")
        .join(filled, "shelf", "left")
        .select("shelf", F.coalesce("terms", none).alias("terms"))
        .groupBy(F.lit(True).alias("always"))
        .agg(F.sort_array(F.collect_list(F.struct("shelf", "terms"))).alias("rows"))
        .select("always", F.col("rows.terms").alias("shelves"))
    )


def _known(found: Column) -> Column:
    """The terms that are in the lexicon of the row."""

    def contained(term: Column) -> Column:
        place = F.pmod(term, F.lit(SHELVES)).cast("int")
        return F.array_contains(F.get("shelves", place), term)

    return F.filter(found, contained)


def _hash(ordered: Column) -> Column:
    return F.when(F.size(ordered) > 0, F.xxhash64(ordered))


def subset_hashes(found: Column, everything: Column) -> Column:
    """For each subset of the lexicon the hash of a text's sorted terms in it.

    Null where it has none; the whole lexicon gives way to ``everything``, the
    text's own terms.
    """
    first = F.array(F.coalesce(_hash(found), F.xxhash64(everything)))
    levels = [
        _level(found, level, parts, taken)
        for level, (parts, taken) in enumerate(SUBSETS[1:], 1)
    ]
    return F.concat(first, *levels)


def _level(found: Column, level: int, parts: int, taken: int) -> Column:
    """Hashes of the first ``taken`` of ``parts`` random subsets."""

    def part(term: Column) -> Column:
        return F.pmod(F.xxhash64(term, F.lit(level)), F.lit(parts))

    def split(few: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(taken - 1)),
            lambda subset: let(F.filter(few, lambda term: part(term) == subset), _hash),
        )

    return let(F.filter(found, lambda term: part(term) < taken), split)


def likeness(one: Column, other: Column) -> Column:
    """Share of subsets with equal hashes, of those that either text has terms in."""
    agree = F.zip_with(
        one,
        other,
        lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.when(a == b, 1).otherwise(0)),
    )
    same = let(
        F.array_compact(agree),
        lambda known: F.size(F.filter(known, lambda hit: hit == 1))
        / F.greatest(F.size(known), F.lit(1)),
    )
    return same


def printable(fingerprint: Column) -> Column:
    """Hex digits, 8 for each subset; dashes for a subset without terms."""
    parts = F.transform(
        fingerprint,
        lambda v: F.coalesce(F.lower(F.substring(F.lpad(F.hex(v), 16, "0"), 9, 8)), F.lit("-" * 8)),
    )
    return F.array_join(parts, "")


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of every document, of its edited text, and of the next one.

    Returns a row per row of ``docs``: ``doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next``. Null text counts
    as empty. A text without a term of the lexicon is told apart by the hash of
    all its terms. Equal texts have equal fingerprints. With one row the next
    document is the row itself; an empty table gives an empty result; ties and
    null ids see with_next().

    Documents stay where the one shuffle of the text has put them: terms are
    looked up within the row, and the next fingerprint within the same buckets.
    """
    plain = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    shelves = _in_shelves(lexicon(plain, low, high))
    paired = with_next(docs).withColumn("other", edited(F.col("text"), F.col("next_text")))
    kept = ["bucket", "place", "guest", "doc_id", "n_chars", "edited_sha256"]
    sets = paired.select(
        "bucket",
        "place",
        "guest",
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("other").cast("binary"), 256).alias("edited_sha256"),
        terms(F.col("text")).alias("terms"),
        terms(F.col("other")).alias("other_terms"),
        F.lit(True).alias("always"),
    )
    matched = sets.join(F.broadcast(shelves), "always").select(
        *kept,
        "terms",
        "other_terms",
        _known(F.col("terms")).alias("found"),
        _known(F.col("other_terms")).alias("other_found"),
    )
    order = Window.partitionBy("bucket").orderBy("place")
    return (
        matched.select(
            *kept,
            subset_hashes(F.col("found"), F.col("terms")).alias("mine"),
            subset_hashes(F.col("other_found"), F.col("other_terms")).alias("edited"),
        )
        .withColumn("following", F.coalesce(F.lead("mine").over(order), "mine"))
        .where(~F.col("guest"))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            printable(F.col("mine")).alias("fingerprint"),
            printable(F.col("edited")).alias("edited_fingerprint"),
            likeness(F.col("mine"), F.col("edited")).alias("near_edited"),
            likeness(F.col("mine"), F.col("following")).alias("near_next"),
        )
    )
