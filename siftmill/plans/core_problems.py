"""Queries of the core training-data problems (1, 6, 7) and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.operators.orphans import Link, orphan_references, orphan_report
from siftmill.operators.packed import latest_field, unpack
from siftmill.operators.skew import heavy_keys, key_totals
from siftmill.session import load

FIELDS = ("user_id", "business_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    review = load(spark, d, "review")
    return heavy_keys(key_totals(review, FIELDS, "stars"), review.count()).select("field", "key_value")


def _per_key(field: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        totals = key_totals(load(spark, d, "review"), (field,), "stars")
        return totals.select(F.col("key_value").alias(field), "n_rows", "n_values", F.round("mean_value", 6).alias("mean_stars"))

    return run


def _distinct_fields(spark: SparkSession, d: str) -> DataFrame:
    return latest_field(load(spark, d, "business"), "business_id", "categories", "loaded_at")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return unpack(_distinct_fields(spark, d), "categories", keep=["business_id"], value="category")


def p6_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return p6_found(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n_values"), F.countDistinct("business_id").alias("n_businesses"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    links = [
        Link("user_id", ["user_id"], load(spark, d, "user_profile"), ["user_id"], since="loaded_at", until="deleted_at"),
        Link("business_id", ["business_id"], load(spark, d, "business"), ["business_id"], since="loaded_at", until="deleted_at"),
    ]
    return orphan_references(load(spark, d, "test_review"), links, keep=["test_id"], moment="asked_at").distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("test_id", "field").distinct()


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


def p7_composite_partial(spark: SparkSession, d: str) -> DataFrame:
    """(user, business) of test_review against the pairs of review, a missing half matching any, without life spans."""
    link = Link("user_id,business_id", ["user_id", "business_id"], load(spark, d, "review"), ["user_id", "business_id"], match="partial")
    return orphan_references(load(spark, d, "test_review"), [link], keep=["test_id"]).select("test_id", "field").distinct()


def queries() -> dict:
    return {
        "p1_found": p1_found,
        "p1_user_totals": _per_key("user_id"),
        "p1_business_totals": _per_key("business_id"),
        "p6_found": p6_found,
        "p6_value_counts": p6_value_counts,
        "p7_found": p7_found,
        "p7_report": p7_report,
        "p7_composite_partial": p7_composite_partial,
    }


_HEAVY = """SELECT '{f}' AS field, k AS key_value FROM (SELECT trim({f}, ' \t') AS k, count(*) AS n FROM review GROUP BY 1)
WHERE k IS NOT NULL AND n * 100 >= (SELECT count(*) FROM review)"""
_TOTALS = """SELECT trim({f}, ' \t') AS {f}, count(*) AS n_rows, count(stars) AS n_values, round(avg(stars), 6) AS mean_stars FROM review GROUP BY 1"""
_ORPHANS = """SELECT DISTINCT test_id, asked_at, '{f}' AS field FROM test_review r
WHERE trim({f}, ' \t') <> '' AND NOT EXISTS (SELECT 1 FROM {t} t WHERE trim(t.{f}, ' \t') = trim(r.{f}, ' \t')
  AND t.loaded_at <= r.asked_at AND (t.deleted_at IS NULL OR t.deleted_at > r.asked_at))"""
_BOTH = _ORPHANS.format(f="user_id", t="user_profile") + " UNION ALL " + _ORPHANS.format(f="business_id", t="business")
_TEST_KEYS = "SELECT DISTINCT test_id, nullif(trim(user_id, ' \t'), '') AS u, nullif(trim(business_id, ' \t'), '') AS b FROM test_review"
_PAIRS = "SELECT DISTINCT trim(user_id, ' \t') AS u, trim(business_id, ' \t') AS b FROM review"
#: Problem 6 in SQL takes the other way round: it walks over matches of a value pattern instead of cutting at quotes.
_VALUES = r"""SELECT business_id, CAST(row_number() OVER (PARTITION BY business_id ORDER BY i) - 1 AS BIGINT) AS pos, v AS category FROM (
  SELECT business_id, i, replace(replace(CASE WHEN left(x, 1) = '"' AND right(x, 1) = '"' AND length(x) > 1 THEN replace(substr(x, 2, length(x) - 2), '""', '"')
      WHEN left(x, 1) = chr(8220) AND right(x, 1) = chr(8221) THEN substr(x, 2, length(x) - 2) ELSE x END, chr(57344), '"'), chr(57345), '/') AS v
  FROM (SELECT business_id, unnest(range(1, len(m) + 1)) AS i, regexp_replace(unnest(m), '^\s+|\s+$', '', 'g') AS x FROM (
    SELECT business_id, regexp_extract_all(regexp_replace(replace(CASE WHEN c LIKE '[%]' THEN substr(c, 2, length(c) - 2) ELSE c END, '\"', chr(57344)), '([^\s])/([^\s])', '\1' || chr(57345) || '\2', 'g'),
      '\s*"(?:[^"]|"")*"|\s*“[^”]*”|[^,;|，\t\n/]+') AS m
    FROM (SELECT DISTINCT trim(business_id, ' ' || chr(9)) AS business_id, regexp_replace(categories, '^\s+|\s+$', '', 'g') AS c FROM business WHERE categories IS NOT NULL))))
WHERE v <> ''"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _HEAVY.format(f="user_id") + " UNION ALL " + _HEAVY.format(f="business_id"),
        "p1_user_totals": _TOTALS.format(f="user_id"),
        "p1_business_totals": _TOTALS.format(f="business_id"),
        "p6_found": _VALUES,
        "p6_value_counts": f"SELECT category, count(*) AS n_values, count(DISTINCT business_id) AS n_businesses FROM ({_VALUES}) GROUP BY 1",
        "p7_found": f"SELECT DISTINCT test_id, field FROM ({_BOTH})",
        "p7_report": f"SELECT field, strftime(asked_at, '%Y-%m') AS month, count(*) AS n_orphans FROM ({_BOTH}) GROUP BY 1, 2",
        "p7_composite_partial": f"""SELECT test_id, 'user_id,business_id' AS field FROM (
  SELECT k.test_id FROM ({_TEST_KEYS}) k WHERE u IS NOT NULL AND b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ({_PAIRS}) p WHERE p.u = k.u AND p.b = k.b)
  UNION SELECT k.test_id FROM ({_TEST_KEYS}) k WHERE u IS NOT NULL AND b IS NULL AND u NOT IN (SELECT u FROM ({_PAIRS}) WHERE u IS NOT NULL)
  UNION SELECT k.test_id FROM ({_TEST_KEYS}) k WHERE u IS NULL AND b IS NOT NULL AND b NOT IN (SELECT b FROM ({_PAIRS}) WHERE b IS NOT NULL))""",
    }
