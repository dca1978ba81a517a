"""Exact sums of doubles, the same to the last bit in any order.

A double is a whole number of units of 2**-1074. Written in digits of base
2**28 it has three neighbouring digits that aren't zero; their place is the
double's band. Digits are added as longs per band, with a map-side combine, and
the bands of a group are put together once: carried, and rounded to the nearest
double. A digit's sum has room for 2**34 rows; beyond that the long addition is
an error, not a wrong total.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGIT_BITS = 28
DIGIT = 1 << DIGIT_BITS
UNIT_EXPONENT = -1074
# Highest band of a finite double, and the lowest one used: the next lower ones
# can't be scaled to whole digits in one step, and their digits fit below it.
TOP_BAND = (1024 - UNIT_EXPONENT) // DIGIT_BITS
LOW_BAND = 2
# Digits above the highest band, for what its sum carries.
CARRIES = 3
NAN, INFINITE, MINUS_INFINITE = -1, -2, -3
_DIGITS = ("high", "middle", "low")


# The expressions are built as SQL text: one string costs one call into the JVM
# where a Column for each operation costs hundreds, at every use.


def digits(name: str) -> Column:
    """``struct<band, high, middle, low>`` of a column; fields of null are null.

    Plain arithmetic, so it stays inside generated code, where the expressions
    that the three digits share are computed once.
    """
    x = f"CAST(`{name}` AS DOUBLE)"
    # An estimate one band too low or too high only shifts digits within the
    # three. The logarithm of zero is null, which greatest() passes over.
    near = f"CAST(floor((log2(abs({x})) - {UNIT_EXPONENT}) / {DIGIT_BITS}) AS INT)"
    band = f"""CASE WHEN isnan({x}) THEN {NAN} WHEN {x} = double('inf') THEN {INFINITE}
        WHEN {x} = double('-inf') THEN {MINUS_INFINITE}
        WHEN {x} IS NOT NULL THEN greatest({LOW_BAND}, least({near}, {TOP_BAND})) END"""
    scales = ", ".join(
        f"{2.0 ** (-UNIT_EXPONENT - DIGIT_BITS * b)!r}D" for b in range(LOW_BAND, TOP_BAND + 1)
    )
    scaled = f"""IF({band} < 0, 0D, {x})
        * element_at(array({scales}), greatest({band}, {LOW_BAND}) - {LOW_BAND - 1})"""
    high = f"CAST({scaled} AS BIGINT)"
    rest = f"(({scaled} - CAST({high} AS DOUBLE)) * {DIGIT}D)"
    middle = f"CAST({rest} AS BIGINT)"
    low = f"CAST(({rest} - CAST({middle} AS DOUBLE)) * {DIGIT}D AS BIGINT)"
    return F.expr(
        f"named_struct('band', {band}, 'high', {high}, 'middle', {middle}, 'low', {low})"
    )


def total(name: str) -> Column:
    """The sum, as a double, of a column of arrays of ``struct<band, high, middle, low>``.

    A band may occur several times. As in a plain sum, NaN or an infinity
    decides the result. An empty array gives null. Works on the digits between
    the lowest and the highest band only, which are few for amounts of one kind.
    """
    bands = f"`{name}`"
    finite = f"filter({bands}, b -> b.band >= 0)"
    places = f"transform({finite}, b -> b.band)"
    lowest = f"(coalesce(array_min({places}), {LOW_BAND}) - 2)"
    highest = f"(coalesce(array_max({places}), {LOW_BAND}) + {CARRIES})"
    limbs = f"""transform(sequence({lowest}, {highest}), k -> aggregate({finite}, 0L, (sum, b) ->
        sum + CASE b.band - k WHEN 0 THEN b.high WHEN 1 THEN b.middle WHEN 2 THEN b.low ELSE 0L END))"""
    once = f"array(named_struct('limbs', {limbs}, 'lowest', {lowest}))"
    # A borrow is left over from a negative sum: then its opposite is rounded.
    both = f"""transform({once}, c -> named_struct('lowest', c.lowest, 'up', {_carried("c.limbs")},
        'down', {_carried("transform(c.limbs, v -> -v)")}))"""
    rounded = f"""transform({both}, c -> IF(c.up.carry >= 0, {_nearest("c.up.out", "c.lowest")},
        -{_nearest("c.down.out", "c.lowest")}))[0]"""

    def has(code: int) -> str:
        return f"exists({bands}, b -> b.band = {code})"

    return F.expr(
        f"""CASE WHEN size({bands}) = 0 THEN NULL
        WHEN {has(NAN)} OR ({has(INFINITE)} AND {has(MINUS_INFINITE)}) THEN double('nan')
        WHEN {has(INFINITE)} THEN double('inf') WHEN {has(MINUS_INFINITE)} THEN double('-inf')
        ELSE {rounded} END"""
    )


def _carried(limbs: str) -> str:
    """``struct<carry, out>``: digits from 0 to base - 1, lowest first."""
    return f"""aggregate({limbs}, named_struct('carry', 0L, 'out', CAST(array() AS ARRAY<BIGINT>)),
        (acc, limb) -> named_struct('carry', shiftright(limb + acc.carry, {DIGIT_BITS}),
            'out', concat(acc.out, array((limb + acc.carry) & {DIGIT - 1}L))))"""


def _nearest(out: str, lowest: str) -> str:
    """The double nearest to digits that are not negative.

    The four highest digits hold more bits than a double, and one more bit says
    whether anything follows, so the one rounding, to double, is right. The power
    is applied in two steps, as it may be no double itself.
    """
    top = f"aggregate(sequence(1, size({out})), 1, (best, k) -> IF({out}[k - 1] > 0, k, best))"
    lead = "CAST(0 AS DECIMAL(38,0))"
    for i in range(1, 5):
        lead = f"""CAST({lead} * CAST({DIGIT} AS DECIMAL(10,0)) + coalesce(get({out}, k - {i}), 0L)
            AS DECIMAL(38,0))"""
    follows = f"IF(exists(slice({out}, 1, greatest(k - 4, 0)), d -> d > 0), 1, 0)"
    odd = f"CAST(CAST({lead} * CAST(2 AS DECIMAL(1,0)) + {follows} AS DECIMAL(38,0)) AS DOUBLE)"
    power = f"(({lowest} + k - 4) * {DIGIT_BITS} + {UNIT_EXPONENT - 1})"
    half = f"floor({power} / 2)"
    return f"""transform(array({top}), k ->
        {odd} * pow(2D, {half}) * pow(2D, {power} - {half}))[0]"""


def add_up(
    df: DataFrame, keys: Sequence[str], amounts: Sequence[str], counts: Mapping[str, Column] = {}
) -> DataFrame:
    """Digit sums of the columns ``amounts`` (see ``digits``) per group and band.

    ``counts`` are aggregates that a plain ``sum`` may add further, such as
    ``count``. A group has one row for each combination of bands it contains.
    Can be applied again to its own result.
    """
    bands = [F.col(name)["band"].alias(f"__band_{name}") for name in amounts]
    sums = [
        F.sum(F.col(name)[digit]).alias(f"__{digit}_{name}") for name in amounts for digit in _DIGITS
    ]
    grouped = df.groupBy(*keys, *bands).agg(
        *sums, *[count.alias(name) for name, count in counts.items()]
    )
    packed = [
        F.when(
            F.col(f"__band_{name}").isNotNull(),
            F.struct(
                F.col(f"__band_{name}").alias("band"),
                *[F.col(f"__{digit}_{name}").alias(digit) for digit in _DIGITS],
            ),
        ).alias(name)
        for name in amounts
    ]
    return grouped.select(*keys, *packed, *counts)


def exact_totals(
    df: DataFrame,
    keys: Sequence[str],
    sums: Mapping[str, Column],
    averages: Mapping[str, Column] = {},
    counts: Mapping[str, Column] = {},
) -> DataFrame:
    """``keys`` with exact ``sums``, ``averages`` (an exact sum by its count) and ``counts``.

    ``counts`` are aggregates as for ``add_up``. Nulls are left out; a group
    without a value has a null sum and average. An amount that is both summed
    and averaged is added up once.
    """
    wanted: dict[str, Column] = {}
    source: dict[str, str] = {}
    for name, value in [*sums.items(), *averages.items()]:
        known = next((n for n, v in wanted.items() if str(v) == str(value)), None)
        source[name] = known or name
        wanted.setdefault(source[name], value)
    inner = {f"__n_{name}": F.count(F.col(name)["band"]) for name in wanted}
    split = df.withColumns(wanted).withColumns({name: digits(name) for name in wanted})
    partial = add_up(split, keys, list(wanted), {**inner, **counts})
    merged = partial.groupBy(*keys).agg(
        *[F.collect_list(name).alias(name) for name in wanted],
        *[F.sum(name).alias(name) for name in [*inner, *counts]],
    )
    merged = merged.withColumns({name: total(name) for name in wanted})
    return merged.select(
        *keys,
        *counts,
        *[F.col(source[name]).alias(name) for name in sums],
        *[
            F.try_divide(source[name], F.col(f"__n_{source[name]}").cast("double")).alias(name)
            for name in averages
        ],
    )
