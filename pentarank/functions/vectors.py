"""Vector, ranking and likelihood expressions over arrays.

Candidates of one record stay in one array, so scoring a record never shuffles.
Positions are 0-based; among equal scores the lowest position comes first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from pentarank.functions.arrays import as_column, let, total
from pentarank.schemas import IGNORE_INDEX

NAN = float("nan")


def _norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def _dot(left: Column, right: Column) -> Column:
    return total(F.zip_with(left, right, lambda x, y: x * y))


def cosine_scores(text_vector: Column | str, candidate_vectors: Column | str) -> Column:
    """Cosine of one vector against each vector of an array; a zero vector gives NaN."""
    text = as_column(text_vector).cast("array<double>")
    candidates = as_column(candidate_vectors).cast("array<array<double>>")

    def score(text: Column, norm: Column, candidate: Column) -> Column:
        ratio = F.try_divide(_dot(text, candidate), norm * _norm(candidate))
        return F.coalesce(ratio, F.when(candidate.isNotNull(), F.lit(NAN)))

    return let(
        text,
        lambda t: let(_norm(t), lambda n: F.transform(candidates, lambda c: score(t, n, c))),
    )


def argmax(scores: Column | str) -> Column:
    scores = as_column(scores)
    return F.array_position(scores, F.array_max(scores)) - 1


def argsort(values: Column | str, descending: bool = True) -> Column:
    """Positions in order of value. NaN counts as the greatest value."""
    values = as_column(values)
    if descending:
        keyed = F.transform(values, lambda x, i: F.struct(x.alias("x"), (-i).alias("i")))
        return F.transform(F.sort_array(keyed, asc=False), lambda c: -c["i"])
    keyed = F.transform(values, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.sort_array(keyed), lambda c: c["i"])


def inverse_permutation(order: Column | str) -> Column:
    """Rank of each position: where position ``i`` stands in ``order``."""
    order = as_column(order)
    return F.transform(order, lambda _, i: (F.array_position(order, i) - 1).cast("int"))


def gold_order(scores: Column, gold: Column | str | Sequence[int] | None) -> Column:
    """Reference ranking as an argsort permutation.

    ``None``: candidates are stored best first. A sequence of numbers: one ranking for
    every row. A column: one array of label values per row, smallest first.
    """
    if gold is None:
        return F.transform(scores, lambda _, i: i)
    if isinstance(gold, (str, Column)):
        return argsort(gold, descending=False)
    shared = sorted(range(len(gold)), key=lambda i: gold[i])
    return F.array(*[F.lit(i) for i in shared])


def spearman(
    scores: Column | str,
    gold: Column | str | Sequence[int] | None = None,
    method: str = "permutation",
) -> Column:
    """``1 - 6*sum(d^2) / (n(n^2-1))`` per row; NULL when there are fewer than two.

    ``permutation`` takes d between the two argsort permutations, ``ranks`` between
    the ranks themselves (the textbook coefficient). They agree for the default gold.
    """
    if method not in ("permutation", "ranks"):
        raise ValueError("method must be 'permutation' or 'ranks'")
    scores = as_column(scores)
    predicted, expected = argsort(scores), gold_order(scores, gold)
    if method == "ranks":
        predicted = let(predicted, inverse_permutation)
        expected = let(expected, inverse_permutation)
    squares = F.zip_with(predicted, expected, lambda a, b: ((a - b) * (a - b)).cast("double"))
    n = F.size(scores).cast("double")
    return F.lit(1.0) - F.try_divide(F.lit(6.0) * total(squares), n * (n * n - 1))


def pairwise_losses(scores: Column | str, weights: Sequence[float] | None = None) -> Column:
    """Loss of each neighbouring pair, ``-log(sigmoid(s[i] - s[i+1]))``, weighted.

    With weights, a row with more pairs than weights raises rather than losing a pair.
    """
    scores = as_column(scores)
    count = F.greatest(F.size(scores) - 1, F.lit(0))

    def softplus(x: Column) -> Column:
        return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))

    losses = F.zip_with(
        F.slice(scores, 1, count), F.slice(scores, 2, count), lambda a, b: softplus(b - a)
    )
    if weights is None:
        return losses
    factors = F.array(*[F.lit(float(w)) for w in weights])
    return F.transform(losses, lambda x, i: x * factors[i])


def target_log_prob(
    logits: Column | str,
    target: Column | str,
    ignore_index: int = IGNORE_INDEX,
    floor: float = 1e-9,
) -> Column:
    """Log-softmax of the target class, clamped from below; NULL when ignored."""
    target = as_column(target)
    values = as_column(logits).cast("array<double>")

    def prob(v: Column, top: Column) -> Column:
        mass = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
        return F.exp(v[target] - top) / mass

    def log_prob(v: Column) -> Column:
        return let(F.array_max(v), lambda top: F.log(F.greatest(prob(v, top), F.lit(floor))))

    return F.when(target != ignore_index, let(values, log_prob))


def mean_log_prob(
    logits: Column | str,
    targets: Column | str,
    shift: bool = False,
    ignore_index: int = IGNORE_INDEX,
    floor: float = 1e-9,
) -> Column:
    """Mean target log-probability of a sequence held in one row; NaN when all is padding.

    ``logits`` has one array per position, ``targets`` one class per position. With
    ``shift`` each position predicts the target of the next one. Rows stored this way
    are scored where they are, without the shuffles the long form needs.
    """
    logits, targets = as_column(logits), as_column(targets)
    if shift:
        count = F.greatest(F.size(targets) - 1, F.lit(0))
        logits, targets = F.slice(logits, 1, count), F.slice(targets, 2, count)

    def one(row: Column, target: Column) -> Column:
        return target_log_prob(row, target, ignore_index, floor)

    def mean(scored: Column) -> Column:
        return F.coalesce(F.try_divide(total(scored), F.size(scored)), F.lit(NAN))

    return let(F.array_compact(F.zip_with(logits, targets, one)), mean)
