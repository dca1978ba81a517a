"""Non-negative matrix factorisation of a sparse interaction matrix.

Minimises ``|V - W H|`` (Frobenius, zeros included) by cyclic coordinate descent
(Cichocki and Phan 2009) on long tables. ``V`` holds the non-zero cells only;
the zeros enter through the k x k Gram matrices of the factors, which are the
only data that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecraft.operators.quality import QualityError
from tablecraft.session import materialize, scratch_path


@dataclass(frozen=True)
class Factorization:
    """``user_factors(user_id, factors)``, ``item_factors(item_id, factors)``
    and the error after every iteration, the starting error first."""

    user_factors: DataFrame
    item_factors: DataFrame
    errors: tuple[float, ...]
    rank: int

    @property
    def error(self) -> float:
        return self.errors[-1]

    @property
    def iterations(self) -> int:
        return len(self.errors) - 1


def factorize(
    matrix: DataFrame,
    n_components: int = 10,
    max_iter: int = 200,
    tol: float = 1e-4,
    seed: int = 42,
    init: tuple[DataFrame, DataFrame] | None = None,
) -> Factorization:
    """Factor ``matrix(user_id, item_id, score)`` into non-negative factors.

    The rank is ``min(n_components, users, items)``. Iteration stops at
    ``max_iter``, or when the gradient an iteration could still follow (summed
    over all factor entries) has fallen to ``tol`` of the first iteration's.
    ``init`` gives starting factors as two tables ``(id, factors)``, of at least
    the users and items with a cell; by default they come from a seeded hash of
    the ids. Users and items of ``init`` without a cell keep a row.

    Each half-step joins the matrix with one factor table and sums per row of
    the other, k sums at once with a map-side combine; the descent over the k
    components of a row needs nothing else than those sums and a Gram matrix. A
    factor table small enough is broadcast by the planner from its stored size;
    otherwise the join shuffles and adaptive execution splits an over-full user
    or item.
    """
    spark = matrix.sparkSession
    cells = materialize(
        matrix.where(F.col("score") != 0).select(
            "user_id", "item_id", F.col("score").cast("double").alias("score")
        ),
        "nmf-cells",
    )
    per_user = cells.groupBy("user_id").agg(
        F.sum("score").alias("total"), F.sum(F.col("score") * F.col("score")).alias("squares")
    )
    users = per_user.agg(
        F.count("*").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares")
    ).first()
    n_items = cells.select("item_id").distinct().count()
    if not users.n:
        raise QualityError("the interaction matrix has no non-zero cell")
    rank = min(n_components, users.n, n_items)
    names = [f"f{j}" for j in range(rank)]

    # Two generations per factor: one is read while the other is written.
    slots = {
        side: [f"{scratch_path(spark, f'nmf-{side}')}/{g}" for g in (0, 1)]
        for side in ("user", "item")
    }
    if init is None:
        scale = (users.total / (users.n * n_items) / rank) ** 0.5
        start = {
            side: cells.select(f"{side}_id")
            .distinct()
            .select(f"{side}_id", *_hashed_factors(f"{side}_id", names, seed, scale))
            for side in ("user", "item")
        }
    else:
        start = {
            side: table.select(f"{side}_id", *_unpack("factors", names))
            for side, table in zip(("user", "item"), init)
        }
        for side, table in start.items():
            if not cells.join(table, f"{side}_id", "left_anti").isEmpty():
                raise QualityError(f"init lacks a {side} of the matrix")
    w = materialize(start["user"], "nmf", slots["user"][0])
    h = materialize(start["item"], "nmf", slots["item"][0])
    gram_w, gram_h = gram(w, names), gram(h, names)
    cross = _cross_term(cells, w, h, names)
    errors = [_error(users.squares, cross, gram_w, gram_h)]

    first_violation = None
    for iteration in range(1, max_iter + 1):
        generation = iteration % 2
        w_next = _update(cells, w, h, "user_id", "item_id", gram_h, names)
        w = materialize(w_next, "nmf", slots["user"][generation])
        gram_w, _, w_violation = _totals(w, names)
        h_next = _update(cells, h, w, "item_id", "user_id", gram_w, names)
        h = materialize(h_next, "nmf", slots["item"][generation])
        gram_h, cross, h_violation = _totals(h, names)
        errors.append(_error(users.squares, cross, gram_w, gram_h))
        violation = w_violation + h_violation
        if first_violation is None:
            first_violation = violation
        if violation <= tol * first_violation:
            break
    return Factorization(
        w.select("user_id", F.array(*names).alias("factors")),
        h.select("item_id", F.array(*names).alias("factors")),
        tuple(errors),
        rank,
    )


def reconstruction_error(
    matrix: DataFrame, user_factors: DataFrame, item_factors: DataFrame, rank: int
) -> DataFrame:
    """``|V - W H|`` over all cells, zeros included. One row, column ``error``.

    Expands to ``sum(v^2) - 2 sum(v * w.h) + tr(W'W HH')``, so only non-zero
    cells are visited.
    """
    names = [f"f{j}" for j in range(rank)]
    w = user_factors.select("user_id", *_unpack("factors", names))
    h = item_factors.select("item_id", *_unpack("factors", names))
    zeros_term = _trace(gram(w, names), gram(h, names))
    cells = matrix.where(F.col("score") != 0)
    joined = _joined(cells, w, h, names)
    squared = f"sum(score * score) - 2 * sum(score * ({_dot(names)})) + {zeros_term!r}D"
    return joined.selectExpr(f"sqrt(greatest({squared}, 0D)) AS error")


def gram(factors: DataFrame, names: Sequence[str]) -> list[list[float]]:
    """``F'F`` of a factor table: k x k sums in one aggregate."""
    return _symmetric(factors.selectExpr(*_gram_sums(names)).first(), len(names))


# The expressions below are built as SQL text: with k factors there are k * k
# terms, and one string costs one call into the JVM instead of hundreds.


def _update(
    cells: DataFrame,
    factors: DataFrame,
    other: DataFrame,
    key: str,
    other_key: str,
    other_gram: list[list[float]],
    names: Sequence[str],
) -> DataFrame:
    """One pass of coordinate descent over all components of one factor."""
    sums = (
        cells.join(other.select(other_key, *names), other_key)
        .groupBy(key)
        .agg(*[F.expr(f"sum(score * {n}) AS n_{n}") for n in names])
    )
    # Each component is moved with the ones before it already moved: the new
    # values x_* refer to one another inside one SELECT.
    current = list(names)
    moves, shifts = [], []
    for position, (name, row) in enumerate(zip(names, other_gram)):
        curvature = row[position]
        if curvature == 0:
            continue
        slope = _sum_text(f"{c} * {g!r}D" for c, g in zip(current, row))
        step = f"({slope} - n_{name}) / {curvature!r}D"
        moves.append(f"greatest({name} - {step}, 0D) AS x_{name}")
        shifts.append(f"abs({name} - x_{name}) * {curvature!r}D")
        current[position] = f"x_{name}"
    # A row of the starting factors may have no cell: nothing pulls it up.
    moved = (
        factors.select(key, *names)
        .join(sums, key, "left")
        .fillna(0.0, [f"n_{n}" for n in names])
        .selectExpr("*", *moves)
    )
    # n_* stay in the table: with the new factors they give the error's cross term.
    return moved.selectExpr(
        key,
        *[f"{c} AS {n}" for c, n in zip(current, names)],
        *[f"n_{n}" for n in names],
        f"{_sum_text(shifts) or '0D'} AS violation",
    )


def _totals(
    factors: DataFrame, names: Sequence[str]
) -> tuple[list[list[float]], float, float]:
    """Gram matrix, cross term with the matrix, and the followed gradient."""
    cross = f"sum({_sum_text(f'{n} * n_{n}' for n in names)}) AS cross"
    row = factors.selectExpr(*_gram_sums(names), cross, "sum(violation) AS violation").first()
    return _symmetric(row, len(names)), row.cross, row.violation


def _cross_term(cells: DataFrame, w: DataFrame, h: DataFrame, names: Sequence[str]) -> float:
    return _joined(cells, w, h, names).selectExpr(f"sum(score * ({_dot(names)}))").first()[0]


def _joined(cells: DataFrame, w: DataFrame, h: DataFrame, names: Sequence[str]) -> DataFrame:
    left = w.selectExpr("user_id", *[f"{n} AS w_{n}" for n in names])
    right = h.selectExpr("item_id", *[f"{n} AS h_{n}" for n in names])
    return cells.join(left, "user_id").join(right, "item_id")


def _dot(names: Sequence[str]) -> str:
    return _sum_text(f"w_{n} * h_{n}" for n in names)


def _gram_sums(names: Sequence[str]) -> list[str]:
    return [
        f"sum({a} * {b}) AS g_{i}_{j}"
        for i, a in enumerate(names)
        for j, b in enumerate(names)
        if i <= j
    ]


def _symmetric(row, rank: int) -> list[list[float]]:
    values = row.asDict()
    return [[values[f"g_{min(i, j)}_{max(i, j)}"] for j in range(rank)] for i in range(rank)]


def _trace(gram_w: list[list[float]], gram_h: list[list[float]]) -> float:
    return sum(a * b for rows in zip(gram_w, gram_h) for a, b in zip(*rows))


def _error(squares: float, cross: float, gram_w, gram_h) -> float:
    return max(squares - 2 * cross + _trace(gram_w, gram_h), 0.0) ** 0.5


def _hashed_factors(key: str, names: Sequence[str], seed: int, scale: float) -> list[Column]:
    steps = 1_000_003
    return [
        F.expr(
            f"(pmod(xxhash64({seed}, '{key}', '{n}', {key}), {steps}) + 1) / {steps}D"
            f" * {scale!r}D AS {n}"
        )
        for n in names
    ]


def _unpack(column: str, names: Sequence[str]) -> list[Column]:
    return [F.expr(f"CAST({column}[{j}] AS DOUBLE) AS {n}") for j, n in enumerate(names)]


def _sum_text(terms: Iterable[str]) -> str:
    return " + ".join(terms)
