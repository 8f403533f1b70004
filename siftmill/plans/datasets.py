"""Canonical views over the given tables: reviews, ratings, baskets, graph input, points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.operators.basic import latest
from siftmill.session import clean_id, load


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """Review rows with clean ids; repeated rows stay."""
    return load(spark, d, "review").withColumns({c: clean_id(c) for c in ("review_id", "user_id", "business_id")})


def raw_ratings(spark: SparkSession, d: str) -> DataFrame:
    """(user, item, stars, review_id, loaded_at) of complete ratings."""
    rows = reviews(spark, d).select(F.col("user_id").alias("user"), F.col("business_id").alias("item"), "stars", "review_id", "loaded_at")
    return rows.where("user is not null and item is not null and stars is not null")


def business(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each business."""
    return latest(load(spark, d, "business").withColumn("business_id", clean_id("business_id")).select("business_id", "loaded_at", "categories", "review_count", "stars"), "business_id", "loaded_at")


def users(spark: SparkSession, d: str) -> DataFrame:
    return latest(load(spark, d, "user_profile").withColumn("user_id", clean_id("user_id")).select("user_id", "loaded_at", "review_count", "average_stars"), "user_id", "loaded_at")


def test_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (user, item) of the test table, neither null nor blank."""
    rows = load(spark, d, "test_review").select(clean_id("user_id").alias("user"), clean_id("business_id").alias("item"))
    return rows.where("user <> '' and item <> ''").distinct()


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (user_id, business_id) of the basket table."""
    return load(spark, d, "small1").select(clean_id("user_id").alias("user_id"), clean_id("business_id").alias("business_id")).dropna().distinct()


def points(spark: SparkSession, d: str) -> DataFrame:
    """(id, features, label, chunk) of the vectors."""
    rows = load(spark, d, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label", (F.col("vec_id") % 5).cast("int").alias("chunk"))
