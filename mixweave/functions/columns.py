"""Column expressions of the mixture engine: tokens, quality cells, weights, vectors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as one token.
CHARS_PER_TOKEN = 4
#: Quality of every cluster where there is nothing to judge by.
UNJUDGED = 5.0


def char_count(text: Column) -> Column:
    """Code points of a text; a null has none."""
    return F.coalesce(F.length(text), F.lit(0)).cast("long")


def tokens_from_chars(chars: Column) -> Column:
    """One token per four characters, rounded down, and one at least."""
    return F.greatest(F.floor(F.coalesce(chars, F.lit(0)) / CHARS_PER_TOKEN), F.lit(1)).cast("long")


def tokens_from_text(text: Column) -> Column:
    return tokens_from_chars(char_count(text))


def total_tokens(chars: Column) -> Column:
    """Aggregate: a corpus's tokens by its characters, without the minimum per document."""
    return F.coalesce(F.floor(F.sum(chars) / CHARS_PER_TOKEN), F.lit(0)).cast("long")


def clean(score: Column) -> Column:
    """A quality cell; null and NaN count as 0."""
    return F.coalesce(F.nanvl(score.cast("double"), F.lit(0.0)), F.lit(0.0))


def total(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def row_mean(cols: Sequence[Column]) -> Column:
    return total(cols) / F.lit(len(cols))


def is_finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def inner_product(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(a: Column) -> Column:
    return F.sqrt(inner_product(a, a))


def normalized_weights(w: Column) -> Column:
    """Weights that sum to 1; uniform where they sum to next to nothing."""
    s = array_sum(w)
    return F.transform(w, lambda x: F.when(s < 1e-10, F.lit(1.0) / F.size(w)).otherwise(x / s))


def weights_key(w: Column, digits: int = 4) -> Column:
    """What makes two mixtures the same: weights rounded half to even."""
    return F.transform(w, lambda x: F.bround(x, digits))


def weights_by_label(labels: Column, w: Column) -> Column:
    return F.map_from_arrays(labels, w)


def share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def shard_number(file_name: Column) -> Column:
    """The first run of digits in a file's name."""
    return F.regexp_extract(file_name, r"(\d+)", 1).try_cast("int")


def signed(x: Column) -> Column:
    return F.format_string("%+.4f", x)
