"""Column expressions over per-token arrays: masks, folds, padding, logits.

Arrays are of natural length. All of these are JVM-side higher-order functions; a null array
gives null, a null element is taken as the function's docstring says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it, in folds over arrays too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_sum(a: ColumnLike) -> Column:
    """Sum of the elements, 0.0 for none; null elements count as 0."""
    return F.aggregate(col(a), F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))


def masked(values: ColumnLike, mask: ColumnLike) -> Column:
    """values where mask is not 0, else 0.0, so that NaN under the mask is ignored."""
    return F.zip_with(col(values), col(mask), lambda v, m: F.when(m != 0, v.cast("double") * m).otherwise(0.0))


def masked_sum(values: ColumnLike, mask: ColumnLike) -> Column:
    return array_sum(masked(values, mask))


def masked_mean(values: ColumnLike, mask: ColumnLike) -> Column:
    """Masked sum over the mask's sum plus 1e-8."""
    return masked_sum(values, mask) / (array_sum(mask) + 1e-8)


def running(a: ColumnLike, start: float = 0.0) -> Column:
    """Prefix sums, each including its own element."""
    first = F.struct(F.lit(start).cast("double").alias("s"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["s"] + x.cast("double")
        return F.struct(s.alias("s"), F.array_append(acc["out"], s).alias("out"))

    return F.aggregate(col(a), first, step, lambda acc: acc["out"])


def reverse_scan(rows: Column, state: dict[str, Column], step: Callable[[Column, Column], dict[str, Column]], out: str) -> Column:
    """Fold an array of structs from its end; `out` of every state, in the order of the array.

    rows: array<struct>; state: the first state's fields; step(state, row) gives the next state's fields.
    """
    first = F.struct(*[v.alias(k) for k, v in state.items()], F.array().cast("array<double>").alias("_out"))

    def fold(acc: Column, row: Column) -> Column:
        new = step(acc, row)
        return F.struct(*[v.alias(k) for k, v in new.items() if k in state], F.array_append(acc["_out"], new[out]).alias("_out"))

    return F.reverse(F.aggregate(F.reverse(rows), first, fold, lambda acc: acc["_out"]))


def first_end_mask(ids: ColumnLike, end: Column) -> Column:
    """1 up to and including the first element equal to `end`, then 0; all 1 where there is none."""
    ids = col(ids)
    at = F.array_position(ids, end)
    return F.transform(ids, lambda _, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def positions(mask: ColumnLike) -> Column:
    """max(prefix sum of the mask - 1, 0): the position of each unmasked token."""
    return F.transform(running(mask), lambda x: F.greatest(x - 1, F.lit(0.0)).cast("int"))


def pad(a: ColumnLike, length: int, value: Column, left: bool = False) -> Column:
    """The array with `value` added up to `length`; longer arrays stay."""
    a = col(a)
    extra = F.array_repeat(value, F.greatest(F.lit(length) - F.size(a), F.lit(0)))
    return F.concat(extra, a) if left else F.concat(a, extra)


def truncate(a: ColumnLike, length: int, how: str = "error") -> Column:
    """At most `length` elements: the last ones ("left"), the first ones ("right"), half of either end ("middle"), or an error."""
    a = col(a)
    short = F.size(a) <= length
    if how == "left":
        cut = F.slice(a, F.greatest(F.size(a) - length + 1, F.lit(1)), F.lit(length))
    elif how == "right":
        cut = F.slice(a, 1, length)
    elif how == "middle":
        head = length // 2
        cut = F.concat(F.slice(a, 1, head), F.slice(a, F.greatest(F.size(a) - (length - head) + 1, F.lit(1)), F.lit(length - head)))
    elif how == "error":
        cut = F.raise_error(F.concat(F.lit("sequence of "), F.size(a).cast("string"), F.lit(f" is longer than {length}")))
        return F.when(short, a).otherwise(cut.cast("array<int>"))
    else:
        raise ValueError(f"unknown truncation {how!r}")
    return F.when(short, a).otherwise(cut)


def strip_padding(ids: ColumnLike, mask: ColumnLike) -> Column:
    """Elements whose mask is not 0."""
    return F.transform(F.filter(F.arrays_zip(col(ids).alias("x"), col(mask).alias("m")), lambda z: z["m"] != 0), lambda z: z["x"])


def log_sum_exp(a: ColumnLike) -> Column:
    def over(top: Column) -> Column:
        return top + F.log(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top)))

    return let(F.array_max(F.transform(col(a), lambda x: x.cast("double"))), over)


def entropy(logits: ColumnLike) -> Column:
    """Entropy of the softmax: log-sum-exp less the expected logit."""
    return let(log_sum_exp(logits), lambda lse: lse - F.aggregate(col(logits), F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - lse) * x.cast("double")))


def log_prob(logits: ColumnLike, label: ColumnLike) -> Column:
    """Log-probability of the 0-based label."""
    return F.element_at(col(logits), (col(label) + 1).cast("int")).cast("double") - log_sum_exp(logits)


def sum_pi_squared(logits: ColumnLike) -> Column:
    """Sum of squared softmax probabilities."""
    return F.exp(log_sum_exp(F.transform(col(logits), lambda x: 2 * x.cast("double"))) - 2 * log_sum_exp(logits))


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    low, high = (F.lit(v) if not isinstance(v, Column) else v for v in (low, high))
    return F.greatest(low, F.least(high, x))


def spread(value: ColumnLike, like: ColumnLike) -> Column:
    """The row's value at every place of an array."""
    return F.transform(col(like), lambda _: col(value))


def last_place(value: ColumnLike, like: ColumnLike) -> Column:
    """Zeros as long as `like`, the value in the last place; an empty array has no place for it."""
    n = F.size(col(like))
    return F.transform(col(like), lambda _, i: F.when(i == n - 1, col(value).cast("double")).otherwise(0.0))


def response_part(a: ColumnLike, prompt_length: Column, response_length: Column) -> Column:
    """Of model outputs over prompt and response, those that predict the response: shifted left by one; none for a length under 1."""
    return F.slice(col(a), F.greatest(prompt_length, F.lit(1)), F.greatest(response_length, F.lit(0)))


def tempered(logits: ColumnLike, temperature: float) -> Column:
    """Logits over the temperature."""
    return F.transform(col(logits), lambda x: x.cast("double") / temperature)


def picked(values: ColumnLike, index: ColumnLike) -> Column:
    """The element at a 0-based index; null beyond the array."""
    return F.get(col(values), col(index).cast("int"))
