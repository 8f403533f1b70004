"""Counts, word counts, category means, top-k, rating aggregates, partition statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmill.functions.scalars import STOP_WORDS, words, year_range


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows, repeated ones included."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def year_count(df: DataFrame, date: str, year: int = 2018) -> DataFrame:
    """Number of rows whose date string lies in ``year``; null dates don't."""
    return row_count(df.where(year_range(date, year)))


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    """Number of distinct non-null values."""
    return df.agg(F.countDistinct(column).alias("n"))


def group_counts(df: DataFrame, key: str, *, above: float = 0) -> DataFrame:
    """Rows per non-null key, for keys of strictly more than ``above`` rows; combined before the shuffle."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > above)


def top_counts(df: DataFrame, key: str, m: int = 10) -> DataFrame:
    """The ``m`` most frequent keys, ties by rising key."""
    return group_counts(df, key).orderBy(F.desc("n"), key).limit(m)


def word_counts(df: DataFrame, text: str, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Count of every word that is neither empty, nor a stop word, nor holds an apostrophe."""
    rows = df.select(F.explode(words(text)).alias("word"))
    return rows.where((F.col("word") != "") & ~F.col("word").isin(list(stop_words)) & ~F.col("word").contains("'")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def top_words(df: DataFrame, text: str, n: int = 10, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    return word_counts(df, text, stop_words).orderBy(F.desc("n"), "word").limit(n)


def category_means(reviews: DataFrame, business: DataFrame, *, key: str, stars: str, categories: str) -> DataFrame:
    """Mean stars per category over reviews: sums and counts per business are formed before the join.

    Categories are split on commas and trimmed; null and empty fields are left out, a category listed twice counts
    twice, and empty names stay. Businesses without reviews are left out.
    """
    per = reviews.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(stars).alias("s"), F.count(stars).alias("c"))
    listed = business.where(F.col(categories).isNotNull() & (F.col(categories) != "")).select(
        key, F.explode(F.transform(F.split(categories, ","), lambda v: F.regexp_replace(v, r"^\s+|\s+$", ""))).alias("category")
    )
    means = listed.join(per, key).groupBy("category").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    return means.where("c > 0").select("category", (F.col("s") / F.col("c")).alias("mean"), F.col("c").alias("n"))


def top_categories(means: DataFrame, n: int = 10) -> DataFrame:
    return means.select("category", F.round("mean", 6).alias("mean")).orderBy(F.desc("mean"), "category").limit(n)


def mean_ratings(ratings: DataFrame) -> DataFrame:
    """One row per (user, item): the mean of its ratings."""
    return ratings.groupBy("user", "item").agg(F.avg("stars").alias("stars"))


def last_ratings(ratings: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per (user, item): the rating that comes last by ``order``."""
    return ratings.groupBy("user", "item").agg(F.max_by("stars", F.struct(*order)).alias("stars"))


def key_means(ratings: DataFrame, key: str) -> DataFrame:
    return ratings.groupBy(key).agg(F.avg(F.col("stars").cast("double")).alias("mean"), F.count(F.lit(1)).alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """Degree of every vertex of an undirected graph given by edges (a, b)."""
    return edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def known(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is among ``keys``."""
    return df.join(keys, on, "left_semi")


def cold_pairs(pairs: DataFrame, ratings: DataFrame) -> DataFrame:
    """Pairs whose user or item has no rating, with flags for which are known."""
    users = ratings.select("user").distinct().withColumn("user_known", F.lit(True))
    items = ratings.select("item").distinct().withColumn("item_known", F.lit(True))
    flags = pairs.join(users, "user", "left").join(items, "item", "left")
    return flags.select("user", "item", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("user_known", "item_known"))).where("not (user_known and item_known)")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of every non-null key by ``order``, ties by the other columns."""
    others = [c for c in df.columns if c not in (key, order)]
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *others)).alias("_r"))
    return best.select(key, F.col(f"_r.{order}").alias(order), *(F.col(f"_r.{c}").alias(c) for c in others))


def hash_partitioned(df: DataFrame, key: str, n: int = 27) -> DataFrame:
    return df.repartition(n, key)


def randomly_partitioned(df: DataFrame, n: int = 27, seed: int = 42) -> DataFrame:
    """Rows spread evenly whatever their keys; later aggregates don't change by it."""
    return df.repartition(n, F.rand(seed))


def partition_sizes(df: DataFrame, n: int) -> DataFrame:
    """Rows in each of ``n`` partitions, empty ones with 0."""
    counts = df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("partition"))
    return every.join(counts, "partition", "left").select("partition", F.coalesce("n", F.lit(0)).alias("n"))


def bucket_sizes(df: DataFrame, bucket, n: int) -> DataFrame:
    """Rows in each of ``n`` explicit buckets, given by an expression, empty ones with 0."""
    counts = df.groupBy(F.pmod(bucket, F.lit(n)).cast("int").alias("partition")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("partition"))
    return every.join(counts, "partition", "left").select("partition", F.coalesce("n", F.lit(0)).alias("n"))


def top_per_row(df: DataFrame, keys: Sequence[str], score: str, tie: str, n: int) -> DataFrame:
    """The ``n`` rows of highest score per key, ties by rising ``tie``; for groups of bounded size."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)
