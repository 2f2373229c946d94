"""Array logic between prompts: turn gaps, implicit prefixes, sampled headers, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def turn_gap(stream: Column, ending: Column, complete: Column | None = None) -> Column:
    """What of ending the stream's tail lacks: the suffix behind the longest of its prefixes that the stream ends with."""
    n = F.size(ending)
    gaps = F.transform(F.sequence(n, F.lit(0), F.lit(-1)), lambda k: F.when(tail(stream, k) == F.slice(ending, F.lit(1), k), F.slice(ending, k + 1, n)))
    gap = F.when(n == 0, ending).otherwise(F.get(F.filter(gaps, lambda g: g.isNotNull()), F.lit(0)))
    return gap if complete is None else F.when((F.size(complete) > 0) & (tail(stream, F.size(complete)) == complete), F.slice(ending, 1, 0)).otherwise(gap)


def tail(stream: Column, k: Column) -> Column:
    """The last k elements; null if there are fewer."""
    return F.when(F.size(stream) >= k, F.slice(stream, F.greatest(F.lit(1), F.size(stream) - k + 1), k))


def implicit_prefix(one: Column, two: Column) -> Column:
    """What a render of one message and one of the same message twice have before it; null if they don't line up."""
    n = 2 * F.size(one) - F.size(two)
    fits = (n >= 0) & (n <= F.size(one))
    return F.when(fits & (two == F.concat(one, F.slice(one, F.greatest(n, F.lit(0)) + 1, F.size(one)))), F.slice(one, F.lit(1), F.greatest(n, F.lit(0))))


def without_sampled_header(stream: Column, delta: Column, header: Column) -> Column:
    """delta without a header that the stream's tail has already; null if the tail has it and delta doesn't."""
    sampled = (F.size(header) > 0) & F.coalesce(tail(stream, F.size(header)) == header, F.lit(False))
    starts = F.slice(delta, F.lit(1), F.size(header)) == header
    return F.when(~sampled, delta).when(starts, F.slice(delta, F.size(header) + 1, F.size(delta)))
