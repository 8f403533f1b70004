"""Scalar expressions: text, hashing, rounding rules and vector distances, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters stripped from both ends of a word.
STRIPPED = ".,?!/\\\"'\n\t()[];:{}~`-_<>@#$%&^*1234567890"

# Words too frequent to count (the empty word is one of them).
STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over under again further
then once here there when where why how all any both each few more most other some such no nor not only own same so
than too very s t can will just don should now""".split()


def words(text: Column | str) -> Column:
    """Lower-cased pieces between single spaces, stripped of ``STRIPPED`` at both ends; may be empty."""
    return F.transform(F.split(F.lower(text), " "), lambda w: F.btrim(w, F.lit(STRIPPED)))


def year_range(date: Column | str, year: int) -> Column:
    """Whether a date string starts with ``year``, as a range that reaches the scan."""
    date = F.col(date) if isinstance(date, str) else date
    return (date >= f"{year:04d}") & (date < f"{year + 1:04d}")


def local_support(support: Column, part: Column, total: Column) -> Column:
    """The share of a support that falls to a part of the baskets, rounded up."""
    return F.ceil(support.cast("double") * part / total)


def universal_hash(a: int, b: int, x: Column, prime: int, size: int | None = None) -> Column:
    """((a x + b) mod prime) mod size, in bigint arithmetic."""
    out = (F.lit(a) * x + F.lit(b)) % F.lit(prime)
    return out % F.lit(size) if size else out


def pair_bucket(a: Column, b: Column, buckets: int, *, numeric: bool) -> Column:
    """Bucket of a pair: the sum of its numbers, or of its first characters' code points, modulo ``buckets``."""
    value = (lambda c: c.cast("bigint")) if numeric else (lambda c: F.ascii(c).cast("bigint"))
    return (value(a) + value(b)) % F.lit(buckets)


def half_even(x: Column) -> Column:
    return F.rint(x)


def step_score(x: Column) -> Column:
    """Extreme scores pulled to 5 and 2, others left."""
    return F.when(x > 4.5, 5.0).when(x < 2.5, 2.0).otherwise(x)


def step_mean(x: Column) -> Column:
    """A mean as a fallback score: above 4 is 5, below 3 is 2, else the nearest whole (half to even)."""
    return F.when(x > 4, 5.0).when(x < 3, 2.0).otherwise(half_even(x))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def normalised_distance(a: Column, centre: Column, variance: Column) -> Column:
    """Distance in standard deviations per dimension; dimensions without variance count only if the values differ."""
    parts = F.zip_with(F.zip_with(a, centre, lambda x, c: (x - c) * (x - c)), variance, lambda d, v: F.when(v > 1e-12, d / v).when(d > 0, d / 1e-12).otherwise(0.0))
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v))
