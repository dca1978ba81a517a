"""URL filters: rules on host and path, and a character model where no rule fits.

Two smoothed Markov models of variable order, one of the URLs that rules accept
and one of those they reject, compare how likely a URL is among each. Built-in
functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.llm.text import ascii_lower
from tablecraft.session import materialize

ORDER = 3
# Pseudo-counts a longer context gives to the estimate of the next shorter one.
BACKOFF = 2.0
# Symbols: a to z, one for all digits, four signs, one for anything else, and
# the marks of start and end. Runs of ORDER + 1 symbols are at most 34 ** 4.
SYMBOLS = 34
START, END, OTHER, DIGIT = "^", "$", "*", "0"
# Every fourth URL that a rule decides calibrates; the others train.
FOLDS = 4
STEPS = 400
LIMIT = 4.0


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a URL; both empty without ``://``."""
    known = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(known, r"://([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(known, r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``rule, verdict`` of the longest rule that fits; null if none does.

    A rule fits its host and all its subdomains if the path starts with its own.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        named = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, named).otherwise(found)
    return found


def spelled(host: Column, path: Column) -> Column:
    """Host and path in the model's symbols, with marks of start and end."""
    text = ascii_lower(F.concat(host, path))
    text = F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9./_-]", OTHER), r"[0-9]+", DIGIT)
    return F.concat(F.lit(START * ORDER), text, F.lit(END))


def _grams(text: Column) -> Column:
    """Every run of ORDER + 1 symbols: a symbol with its context."""
    starts = F.sequence(F.lit(1), F.length(text) - ORDER)
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(ORDER + 1)))


def likelihood_ratios(urls: DataFrame) -> DataFrame:
    """``gram, ratio``: log10 probability if accepted less that if rejected.

    ``urls`` has distinct ``text`` and ``train``: allow, block, or null for a URL
    that is scored only. The estimate of a symbol after each context is mixed
    with that after the context without its first symbol, down to an even
    spread; a context that was never seen leaves the shorter one's estimate.
    """
    counted = materialize(
        urls.select("train", F.explode(_grams(F.col("text"))).alias("gram"))
        .groupBy("gram")
        .agg(*(F.count(F.when(F.col("train") == v, 1)).alias(v) for v in ("allow", "block"))),
        "url-grams",
    )
    totals = counted.agg(F.sum("allow"), F.sum("block")).first()
    estimates = {"allow": F.lit(1.0 / SYMBOLS), "block": F.lit(1.0 / SYMBOLS)}
    grams = counted
    for order in range(ORDER + 1):
        # the last order + 1 symbols, and the context before the last of them
        seen = F.substring("gram", ORDER + 1 - order, order + 1)
        context = F.substring("gram", ORDER + 1 - order, order)
        for i, verdict in enumerate(estimates):
            hits = F.sum(verdict).over(Window.partitionBy(seen))
            tries = (
                F.sum(verdict).over(Window.partitionBy(context)) if order else F.lit(totals[i] or 0)
            )
            name = f"{verdict}_{order}"
            smoothed = (hits + BACKOFF * estimates[verdict]) / (tries + BACKOFF)
            grams = grams.withColumn(name, smoothed)
            estimates[verdict] = F.col(name)
    return grams.select(
        "gram", (F.log10(estimates["allow"]) - F.log10(estimates["block"])).alias("ratio")
    )


def threshold(scored: DataFrame) -> float:
    """The score that best separates held-out accepted from rejected URLs.

    Least sum of both error rates over a grid; the middle of the best scores.
    Zero if either kind is missing. The driver sees one row per grid step.
    """
    step = F.floor(
        (F.greatest(F.least("score", F.lit(LIMIT)), F.lit(-LIMIT)) + LIMIT) / (2 * LIMIT) * STEPS
    )
    rows = scored.groupBy(step.alias("step"), "verdict").count().collect()
    count = {verdict: [0] * (STEPS + 1) for verdict in ("allow", "block")}
    for row in rows:
        count[row["verdict"]][row["step"]] = row["count"]
    total = {verdict: sum(values) for verdict, values in count.items()}
    if not all(total.values()):
        return 0.0
    errors = []
    refused, passed = 0, total["block"]
    for at in range(STEPS + 1):  # allow from step ``at`` on
        errors.append(refused / total["allow"] + passed / total["block"])
        refused += count["allow"][at]
        passed -= count["block"][at]
    best = [at for at, error in enumerate(errors) if error <= min(errors) + 1e-12]
    return (best[0] + best[-1]) / 2 / STEPS * 2 * LIMIT - LIMIT


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row of ``pages``.

    The verdict is the longest fitting rule's, else the model's: allow if the
    log-likelihood difference per symbol reaches the threshold. A null URL, or
    one without ``://``, is an empty one. Without accepted and rejected URLs to
    learn from the threshold is 0 and so is every score, which allows. Repeated
    rows are judged alike; an empty table gives an empty result; other columns
    are ignored.
    """
    host, path = host_and_path(F.col("url"))
    found = rule_of(F.col("host"), F.col("path"), rules)
    named = (
        pages.select("page_id", host.alias("host"), path.alias("path"))
        .withColumn("found", found)
        .select("page_id", "host", "path", "found.rule", "found.verdict",
                spelled(F.col("host"), F.col("path")).alias("text"))
    )
    # rules look at more than the model's symbols, so a spelling may be decided both ways
    fold = F.crc32(F.col("text").cast("binary")) % FOLDS
    urls = materialize(
        named.groupBy("text").agg(F.max("verdict").alias("verdict")).withColumn("held", fold == 0),
        "urls",
    )
    train = F.when(~F.col("held"), F.col("verdict"))
    ratios = likelihood_ratios(urls.select("text", train.alias("train")))
    scored = materialize(
        urls.select("text", "verdict", "held", F.explode(_grams(F.col("text"))).alias("gram"))
        .join(F.broadcast(ratios), "gram")  # at most SYMBOLS ** (ORDER + 1) rows
        .groupBy("text", "verdict", "held")
        .agg(F.avg("ratio").alias("score")),
        "url-scores",
    )
    limit = threshold(scored.where(F.col("held") & F.col("verdict").isNotNull()))
    model = F.when(F.col("score") >= limit, "allow").otherwise("block")
    return named.join(scored.select("text", "score"), "text").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", model).alias("verdict"), "score"
    )
