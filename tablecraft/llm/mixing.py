"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.llm.text import ROW, with_row_keys, word_count
from tablecraft.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
SEED = "mix-1"
# Groups a source's shuffled documents fall into for running totals: 16 ** 3.
_SHUFFLE_DIGITS = 3
# Ranges of virtual time, per unit, that the global order is cut into.
_TIME_RANGES = 1 << 16
_RANGES = 4096  # the last one holds all later times


def document_sizes(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id, source, size, place`` and columns to keep; size in words, 0 for a null text.

    ``place`` orders documents at random: a hash of the id and a seed. Without
    an id it is one of the text, so that such rows spread over all places.
    """
    of_text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), of_text), F.lit(f":{SEED}"))
    return docs.select(
        *keep,
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        word_count(F.col("text")).alias("size"),
        F.substring(F.md5(key.cast("binary")), 1, 16).alias("place"),
    )


def source_targets(
    sizes: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_COPIES,
) -> DataFrame:
    """``source, source_size, target``, one row per source.

    Sources by code point, null last, take ``weights`` in turn and divide
    ``share`` of all sizes by weight. A target stops at ``most`` times the
    source's size and the excess goes to the others by weight, until none is
    above: with sources ordered by the level at which they fill up, all that
    fill up before the common level get their limit.
    """
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    numbered = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).select(
        "source",
        "source_size",
        ((F.row_number().over(by_code_point) - 1) % len(weights)).alias("turn"),
    )
    weighted = numbered.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("turn") + 1)
    ).withColumn("limit", most * F.col("source_size"))
    filling = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    later = filling.rowsBetween(0, Window.unboundedFollowing)
    leveled = weighted.withColumn(
        "level",
        (
            share * F.sum("source_size").over(everything)
            - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0))
        )
        / F.sum("weight").over(later),
    )
    fills = F.col("limit") / F.col("weight") <= F.col("level")
    # past the first source that doesn't fill up the level only falls
    common = F.max(F.when(~fills, F.col("level"))).over(everything)
    return leveled.select(
        "source",
        "source_size",
        F.when(fills, F.col("limit").cast("double"))
        .otherwise(F.col("weight") * common)
        .alias("target"),
    )


def finish_words(
    sizes: DataFrame, targets: DataFrame, keep: Sequence[str] = ()
) -> DataFrame:
    """``doc_id, source, place, size, source_size, target, done`` per document.

    ``done`` counts the words of its source up to and with the document, in
    shuffled order. The order is cut into groups, whose totals are added up
    first, so that the documents of one source are ordered by many tasks.
    """
    grouped = sizes.withColumn("group", F.substring("place", 1, _SHUFFLE_DIGITS))
    before = Window.partitionBy("source").orderBy("group").rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = (
        grouped.groupBy("source", "group")
        .agg(F.sum("size").alias("words"))
        .select("source", "group", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
        .join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .select(F.col("source").alias("of"), F.col("group").alias("of_group"), "before",
                "source_size", "target")
    )
    inside = (
        Window.partitionBy("source", "group")
        .orderBy("place", "doc_id", "size", *keep)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("group") == F.col("of_group"))
    return (
        grouped.withColumn("within", F.sum("size").over(inside))
        .join(totals, same)
        .select(*keep, "doc_id", "source", "place", "size", "source_size", "target",
                (F.col("before") + F.col("within")).alias("done"))
    )


def _time(copy: Column | int) -> Column:
    """Virtual finish time of a document's copy: words of its source over its target."""
    return (F.col("done") + copy * F.col("source_size")) / F.nullif(F.col("target"), F.lit(0.0))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    keep: Sequence[str] = (),
) -> DataFrame:
    """How often the mix takes every document.

    Returns a row per row of ``docs``: the columns to ``keep``, ``doc_id, source,
    size, source_size, target, copies, taken``; the last is in words. Documents are taken whole, in
    the order of their virtual finish times over all sources, until the next one
    would pass the budget, the sum of all targets. So each source comes within
    about one document of its target, and no document is taken more than twice.
    Empty documents and null texts have size 0 and are never taken. A null
    source is a source, a null id an id like any other; repeated rows are
    documents of their own. An empty table gives an empty result.
    """
    sizes = materialize(document_sizes(docs, keep), "mix-sizes")
    targets = materialize(source_targets(sizes, weights, share), "mix-targets")
    timed = materialize(finish_words(sizes, targets, keep), "mix-times")
    last = _last_taken(timed, targets)
    order = (F.col("place"), F.coalesce("doc_id", F.lit(_NO_ID)))
    copies = F.lit(0)
    for copy in range(MOST_COPIES):
        time = _time(copy)
        taken = time <= 1
        if last is not None:
            kinds = zip(last, ("double", "string", "long", "int"))
            final = F.struct(*(F.lit(value).cast(kind) for value, kind in kinds))
            reached = F.struct(time, *order, F.lit(copy)) <= final
            taken = taken | reached
        copies = copies + F.when((F.col("size") > 0) & taken, 1).otherwise(0)
    return timed.withColumn("copies", copies).select(
        *keep, "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


_NO_ID = -(1 << 63)


def _last_taken(timed: DataFrame, targets: DataFrame) -> tuple | None:
    """Place in the global order of the last copy that fits the budget, past time 1.

    By time 1 no source has passed its target, so all copies until then fit.
    Later ones are summed by ranges of time; only the range in which the budget
    ends is put in order.
    """
    copies = (
        timed.where(F.col("size") > 0)
        .withColumn("copy", F.explode(F.array(*map(F.lit, range(MOST_COPIES)))))
        .select(
            _time(F.col("copy")).alias("time"),
            "place",
            F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"),
            "copy",
            "size",
            F.floor(F.least((_time(F.col("copy")) - 1) * _TIME_RANGES, F.lit(_RANGES))).alias("range"),
        )
        .withColumn("range", F.when(F.col("time") <= 1, -1).otherwise(F.col("range")))
    )
    sums = dict(copies.groupBy("range").agg(F.sum("size")).collect())
    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    rest = budget - sums.pop(-1, 0)
    if not sums:
        return None
    for at in sorted(sums):
        if sums[at] > rest:
            break
        rest -= sums[at]
    else:
        at, rest = max(sums), float("inf")
    order = ("time", "place", "id", "copy")
    running = F.sum("size").over(
        Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    within = (
        copies.where(F.col("range") == F.lit(at))
        .withColumn("running", running)
        .where(F.col("running") <= F.lit(rest))
    )
    found = within.agg(F.max(F.struct(*order)).alias("last")).first()["last"]
    if found is None:  # nothing of that range fits
        found = copies.where((F.col("range") >= 0) & (F.col("range") < at)).agg(
            F.max(F.struct(*order)).alias("last")
        ).first()["last"]
    return found and tuple(found)


def repeat_rows(docs: DataFrame, mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mixed`` takes its key.

    Rows are matched by ``key``. Rows that share one are one document here and
    take the largest number of copies found for it; rows without one are left
    out, as nothing can say how often they were taken: ``mixed_rows`` loses
    none. All columns of ``docs`` are kept.
    """
    copies = (
        mixed.where((F.col("copies") > 0) & F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max("copies").alias("__copies"))
    )
    times = F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")
    return docs.join(copies, key).select(*docs.columns, times).select(*docs.columns)


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of the mix, each as often as ``mix`` takes that very row.

    Rows are told apart by a number of their own, so ids may repeat or be null.
    All columns of ``docs`` are kept; an empty table gives an empty result.
    """
    keyed = with_row_keys(docs, "mix-rows")
    return repeat_rows(keyed, mix(keyed, keep=(ROW,)), ROW).select(*docs.columns)
