"""Quality rules: how far a document diverges from its language's habits.

Everything is computed by built-in functions within a row, but for the language
references, which are sums over the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.llm.text import GAP
from tablecraft.session import materialize

BLANKS = " \t\n\x0b\f\r"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
WINDOW = 3
# Classes of characters in the order they are counted; what is left is "symbol".
CLASSES = (
    ("lower", r"\p{Ll}+"),
    ("upper", r"\p{Lu}+"),
    ("letter", r"\p{L}+"),
    ("digit", r"\p{N}+"),
    ("point", r"[.,;:!?'\"()-]+"),
    ("mark", r"[#*$%&|<>]+"),
)
MARK, BLANK = 5, 6
COMMON_WORDS = 16
# A language needs this share of all documents, or so many of them, for a reference
# of its own, and the most common ones get it: MAX_LANGUAGES is above the number
# of languages there are, and as many as can have that share. Documents of others
# are measured against all documents, which rejects none of them.
LANGUAGE_SHARE = 1e-4
LANGUAGE_DOCS = 20
MAX_LANGUAGES = 10_000
# Too short texts have no reliable histogram.
MIN_CHARS = 200
MIN_HISTOGRAM_WORDS = 100
MAX_CLASS_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.33


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` evaluated once, also inside its lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def split_words(text: Column) -> Column:
    """Array of the words of a text that is not null."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def repeated_words(words: Column) -> Column:
    """Words that lie in a run of three found at least twice.

    Runs are compared by a 64-bit hash; the repeated ones are looked up in
    about as many buckets as each bucket has entries, so a text of n words
    takes n * sqrt(n) steps at worst.
    """

    def starts(runs: Column) -> Column:
        repeated = let(
            F.sort_array(runs),
            lambda s: F.array_distinct(
                F.filter(s, lambda run, i: (i > 0) & (run == F.get(s, i - 1)))
            ),
        )
        buckets = let(
            repeated,
            lambda found: let(
                F.ceil(F.sqrt(F.size(found))).cast("int"),
                lambda n: F.transform(
                    F.sequence(F.lit(0), n - 1),
                    lambda b: F.filter(found, lambda run: F.pmod(run, n) == b),
                ),
            ),
        )

        def positions(table: Column) -> Column:
            numbered = F.transform(
                runs,
                lambda run, i: F.when(
                    F.array_contains(F.get(table, F.pmod(run, F.size(table)).cast("int")), run), i
                ),
            )
            return F.array_compact(numbered)

        none = F.array().cast("array<int>")
        return F.when(F.size(F.array_distinct(runs)) == F.size(runs), none).otherwise(
            let(buckets, positions)
        )

    def covered(at: Column) -> Column:
        reach = F.transform(
            at,
            lambda start, i: F.least(
                F.lit(WINDOW), F.coalesce(F.get(at, i + 1), start + WINDOW) - start
            ),
        )
        return F.aggregate(reach, F.lit(0), lambda a, b: a + b)

    def count(all_words: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), F.size(all_words) - WINDOW),
            lambda i: F.xxhash64(*(F.get(all_words, i + j) for j in range(WINDOW))),
        )
        some = let(runs, lambda r: let(starts(r), covered))
        return F.when(F.size(all_words) < WINDOW, 0).otherwise(some)

    return let(words, count)


def _class_counts(text: Column) -> Column:
    """Characters of each class, then blanks, then symbols.

    Each class is cut out of what the classes before it left, so only the first
    one reads the whole text.
    """

    def cut(rest: Column, classes: tuple) -> Column:
        if not classes:
            bare = F.length(F.translate(rest, BLANKS, ""))
            return F.array(F.length(rest) - bare, bare)
        (_, pattern), *others = classes
        return let(
            F.regexp_replace(rest, pattern, ""),
            lambda left: F.concat(
                F.array(F.length(rest) - F.length(left)), cut(left, tuple(others))
            ),
        )

    return cut(text, CLASSES)


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with its counts: the base rules' and the histograms' inputs.

    Added columns start with two underscores, so that no column of ``docs`` is
    in the way.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, BLANKS, "") != "")
    repeats = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    counted = docs.withColumns({"__words": split_words(text), "__classes": _class_counts(text)})
    return counted.withColumns(
        {
            "__n_words": F.size("__words").cast("long"),
            "__word_chars": (F.length(text) - F.get("__classes", F.lit(BLANK))).cast("long"),
            "__n_symbols": F.get("__classes", F.lit(MARK)).cast("long"),
            "__n_dup_lines": repeats.cast("long"),
            "__n_repeat_words": repeated_words(F.col("__words")).cast("long"),
        }
    )


def references(docs: DataFrame) -> DataFrame:
    """Histograms of each language, and of all documents (null ``of``).

    ``of, class_shares, common, common_shares``: shares of the character
    classes, the most frequent words (as they are written) and their shares of
    all words. Sums cover all documents and combine before the shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(F.col("lang").cast("string").alias("lang"), text.alias("text"))
    classes = len(CLASSES) + 2  # blanks and symbols
    counted = plain.select("lang", _class_counts(F.col("text")).alias("classes"))
    by_language = materialize(
        counted.groupBy("lang").agg(
            F.count("*").alias("docs"),
            *(F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(classes)),
        ),
        "class-sums",
    )
    everything = Window.partitionBy(F.lit(0))
    own = (
        by_language.withColumn("share", F.col("docs") / F.sum("docs").over(everything))
        .where((F.col("share") >= LANGUAGE_SHARE) | (F.col("docs") >= LANGUAGE_DOCS))
        .where(F.col("lang").isNotNull())
        .drop("share")
        .orderBy(F.desc("docs"), "lang")
        .limit(MAX_LANGUAGES)
    )
    pooled = by_language.groupBy(F.lit(None).cast("string").alias("lang")).agg(
        *(F.sum(name).alias(name) for name in by_language.columns[1:])
    )
    sums = F.array(*(F.col(f"c{i}").cast("double") for i in range(classes)))
    shares = own.unionByName(pooled).select(
        F.col("lang").alias("of"),
        let(sums, lambda s: F.transform(s, lambda c: c / F.greatest(_total(s), F.lit(1.0)))).alias(
            "class_shares"
        ),
    )
    words = materialize(
        plain.select("lang", F.explode(split_words(F.col("text"))).alias("word"))
        .groupBy("lang", "word")
        .count(),
        "language-words",
    )
    all_words = words.groupBy("word").agg(F.sum("count").alias("count"))
    return shares.join(
        _common(words.where(F.col("lang").isNotNull()), "lang").unionByName(
            _common(all_words.withColumn("lang", F.lit(None).cast("string")), "lang")
        ),
        F.col("of").eqNullSafe(F.col("lang")),
        "left",
    ).select("of", "class_shares", "common", "common_shares")


def _common(words: DataFrame, language: str) -> DataFrame:
    """The most frequent words of each language and their shares."""
    totals = words.groupBy(F.col(language).alias("__of")).agg(F.sum("count").alias("all"))
    ranked = Window.partitionBy(language).orderBy(F.desc("count"), "word")
    top = words.withColumn("rank", F.row_number().over(ranked)).where(
        F.col("rank") <= COMMON_WORDS
    )
    entry = F.struct("rank", "word", (F.col("count") / F.col("all")).alias("share"))
    return (
        top.join(totals, F.col(language).eqNullSafe(F.col("__of")))
        .groupBy(language)
        .agg(F.sort_array(F.collect_list(entry)).alias("top"))
        .select(language, F.col("top.word").alias("common"), F.col("top.share").alias("common_shares"))
    )


def _gain(p: Column, q: Column) -> Column:
    """p's part of the Jensen-Shannon divergence from q, in bits."""
    return F.when(p > 0, p / 2 * F.log2(2 * p / (p + q))).otherwise(0.0)


def class_distance(counts: Column, shares: Column) -> Column:
    """Jensen-Shannon distance between class counts and reference shares."""
    parts = let(
        F.greatest(_total(F.transform(counts, lambda c: c.cast("double"))), F.lit(1.0)),
        lambda total: F.zip_with(
            counts, shares, lambda c, q: _gain(c / total, q) + _gain(q, c / total)
        ),
    )
    return F.sqrt(F.greatest(_total(parts), F.lit(0.0)))


def word_distance(words: Column, common: Column, shares: Column) -> Column:
    """Jensen-Shannon distance over the common words and all others together."""

    def distance(ranks: Column) -> Column:
        total = F.size(words).cast("double")

        def parts(distinct: Column) -> Column:
            def part(rank: Column, i: Column) -> Column:
                # equal ranks stand together, so a rank ends where the next one starts
                end = F.coalesce(
                    F.array_position(ranks, F.get(distinct, i + 1)), F.size(ranks) + 1
                )
                p = (end - F.array_position(ranks, rank)) / total
                q = F.element_at(shares, rank.cast("int"))
                return _gain(p, q) + _gain(q, p) - q / 2  # an absent word gives q / 2

            return F.transform(distinct, part)

        seen = _total(let(F.array_distinct(ranks), parts))
        rest_p = 1 - F.size(ranks) / total
        rest_q = F.greatest(1 - _total(shares), F.lit(0.0))
        rest = _gain(rest_p, rest_q) + _gain(rest_q, rest_p)
        return F.sqrt(F.greatest(seen + _total(shares) / 2 + rest, F.lit(0.0)))

    ranks = F.filter(
        F.transform(words, lambda w: F.array_position(common, w)), lambda rank: rank > 0
    )
    return let(F.sort_array(ranks), distance)


def judge(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with the rules' figures and its verdict.

    Adds the figures ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, class_distance, word_distance`` and ``kept``,
    all under names with two leading underscores. A null text counts as empty and fails the
    base rules; texts below the minimum lengths have null distances, which
    reject nothing. A null language, or one too rare for a reference, is
    compared with all documents together, and its distances reject nothing
    either, as they measure the language and not the document. Repeated rows are
    judged alike; an empty table gives an empty result.
    """
    known = F.broadcast(materialize(references(docs), "language-references"))
    measured = measures(docs).join(
        known.where(F.col("of").isNotNull()).select(
            F.col("of").alias("__of"),
            F.struct("class_shares", "common", "common_shares").alias("__own"),
        ),
        F.col("lang") == F.col("__of"),
        "left",
    )
    fallback = known.where(F.col("of").isNull()).select(
        F.lit(True).alias("__pool"),
        F.struct("class_shares", "common", "common_shares").alias("__pooled"),
    )
    reference = F.coalesce("__own", "__pooled")
    long_enough = F.size("__words") >= MIN_HISTOGRAM_WORDS
    judged = (
        measured.withColumn("__pool", F.col("__own").isNull())
        .join(fallback, "__pool", "left")
        .withColumns(
            {
                "__class_distance": F.when(
                    F.length("text") >= MIN_CHARS,
                    class_distance(F.col("__classes"), reference["class_shares"]),
                ),
                "__word_distance": F.when(
                    long_enough,
                    word_distance(
                        F.col("__words"), reference["common"], reference["common_shares"]
                    ),
                ),
            }
        )
    )
    failed = (F.col("__n_words") < MIN_WORDS) | (
        100 * F.col("__n_repeat_words") > MAX_REPEATED_PERCENT * F.col("__n_words")
    )
    far = F.col("__own").isNotNull() & (
        (F.coalesce("__class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE)
        | (F.coalesce("__word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    )
    figures = [name for name in judged.columns if name.startswith("__")]
    return judged.select(
        *docs.columns,
        *(name for name in figures if name not in ("__of", "__own", "__pool", "__pooled")),
        failed.alias("__base_failed"),
        (~failed & ~far).alias("__kept"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    return judge(docs).where("__kept").select(*docs.columns)
