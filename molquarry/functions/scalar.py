"""Scalar expressions: imputation, encoding, binning, activations, schedules, padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def impute(x: Column, value: float = -1.0) -> Column:
    """Null and NaN to a sentinel."""
    return F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(value))


def clamp_nan(x: Column) -> Column:
    """NaN to 0, positive infinity to 10; others, nulls too, as they are."""
    return F.when(F.isnan(x), F.lit(0.0)).when(x == F.lit(float("inf")), F.lit(10.0)).otherwise(x)


def vocab_index(x: Column, vocabulary: list) -> Column:
    """0-based place in the vocabulary, the last place for what isn't in it."""
    v = F.array(*map(F.lit, vocabulary))
    return F.coalesce(F.nullif(F.array_position(v, x), F.lit(0).cast("long")), F.lit(len(vocabulary)).cast("long")) - 1


def bin_index(x: Column, low: float, high: float, bins: int) -> Column:
    """floor((x - low) / width), kept within 0 .. bins - 1."""
    width = (high - low) / bins
    return F.least(F.greatest(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(0)), F.lit(bins - 1))


def percentile_bar(x: Column, points: list[float]) -> Column:
    """Linear percentiles (points in 0 .. 100) of a group, zeros for an empty one."""
    p = F.percentile(x, F.array(*[F.lit(v / 100.0) for v in points]))
    return F.coalesce(p, F.array(*[F.lit(0.0)] * len(points)))


def standardize(x: Column, mean: Column, std: Column, eps: float = 1e-8) -> Column:
    return (x - mean) / (std + F.lit(eps))


def activation(x: Column, name: str) -> Column:
    """relu (also for unknown names), sigmoid, silu, gelu (tanh form), selu, leakyrelu, hardswish, rrelu (mean slope), none."""
    sig = F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
    if name == "none":
        return x
    if name == "sigmoid":
        return sig
    if name == "silu":
        return x * sig
    if name == "gelu":
        return F.lit(0.5) * x * (F.lit(1.0) + F.tanh(F.lit(0.7978845608028654) * (x + F.lit(0.044715) * x * x * x)))
    if name == "selu":
        scale, alpha = 1.0507009873554805, 1.6732632423543772
        return F.lit(scale) * F.when(x > 0, x).otherwise(F.lit(alpha) * (F.exp(x) - 1))
    if name == "leakyrelu":
        return F.when(x >= 0, x).otherwise(x * F.lit(0.01))
    if name == "rrelu":
        return F.when(x >= 0, x).otherwise(x * F.lit((1 / 8 + 1 / 3) / 2))
    if name == "hardswish":
        return x * F.least(F.greatest(x + 3, F.lit(0.0)), F.lit(6.0)) / 6
    return F.greatest(x, F.lit(0.0))


def warmup_weight(weight: float, epoch: Column, warmup: int) -> Column:
    return F.when(epoch < warmup, F.lit(weight) * epoch / F.lit(float(warmup))).otherwise(F.lit(weight))


def cosine_rate(rate: float, epoch: Column, epochs: int) -> Column:
    return F.lit(rate) * (F.lit(1.0) + F.cos(F.lit(3.141592653589793) * epoch / F.lit(float(epochs)))) / 2


def step_rate(rate: float, epoch: Column, every: int = 10, gamma: float = 0.5) -> Column:
    return F.lit(rate) * F.pow(F.lit(gamma), F.floor(epoch / F.lit(float(every))).cast("double"))


# Fixed values: (data set size below, ((batch size up to, k), ...), k beyond); None is no bound.
K_STEPS = (
    (1_000, ((32, 4), (64, 8)), 16),
    (10_000, ((32, 8), (64, 16), (128, 32)), 64),
    (None, ((32, 16), (64, 32), (128, 64), (256, 128)), None),
)


def recommended_k(rows: Column, batch: Column) -> Column:
    """Neighbours to use, by data set size and batch size; beyond the table a quarter of the batch, 256 at most."""
    by_size = None
    for below, steps, beyond in reversed(K_STEPS):
        k = F.lit(beyond) if beyond is not None else F.least(F.lit(256), F.floor(batch / F.lit(4)).cast("int"))
        for most, value in reversed(steps):
            k = F.when(batch <= most, F.lit(value)).otherwise(k)
        by_size = k if below is None else F.when(rows < below, k).otherwise(by_size)
    return by_size


def hard_k_by_share(batch: Column, k: int, share: float) -> Column:
    """Hardest negatives to use: ``k``, at most batch - 1 and the share of the batch, at least 1; 0 for a batch of 1."""
    least = F.least(F.lit(k), batch - 1, F.floor(batch * F.lit(share)))
    return F.when(batch > 1, F.greatest(F.lit(1), least)).otherwise(F.lit(0)).cast("int")


def hard_k_by_quarter(rows: Column, columns: Column, most: int = 10) -> Column:
    """A quarter of the rows, from 1 to all negatives of a row, ``most`` at most."""
    return F.least(F.greatest(F.floor(rows / F.lit(4)), F.lit(1)), F.greatest(columns - 1, F.lit(1)), F.lit(most)).cast("int")


def vocab_size(vocab: list) -> int:
    """Codes of vocab_index(): one for each entry, the unknown one among them."""
    return len(vocab)


def pad(a: Column, size: Column, value: float) -> Column:
    """An array with ``value`` appended up to ``size``."""
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(size - F.size(a), F.lit(0)).cast("int")))


def attention_mask(length: Column, longest: Column) -> Column:
    """1 for the first length + 1 places of longest + 1, else 0."""
    return F.transform(F.sequence(F.lit(0), longest.cast("int")), lambda i: (i <= length).cast("int"))
