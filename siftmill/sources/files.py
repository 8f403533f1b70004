"""File sources and sinks: JSON lines, CSV with or without header, line lists, chunk folders, report documents."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "review": "review_id string, user_id string, business_id string, stars double, date string, text string, useful bigint, funny bigint, cool bigint",
    "business": "business_id string, categories string, review_count bigint, stars double",
    "user": "user_id string, review_count bigint, average_stars double",
    "pairs": "user_id string, business_id string",
    "model": "b1 string, b2 string, sim double",
    "ratings": "user_id string, business_id string, stars double",
}


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line under a named or given schema; missing keys are null, unused ones aren't parsed."""
    return spark.read.schema(SCHEMAS.get(schema, schema)).json(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """CSV of user and business with a header line."""
    return spark.read.schema(SCHEMAS["pairs"]).option("header", True).csv(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """CSV lines id, x1, ..., xd without header, as (id, features, file)."""
    lines = spark.read.text(path).select(F.split("value", ",").alias("v"), F.col("_metadata.file_name").alias("file"))
    return lines.select(F.col("v")[0].alias("id"), F.transform(F.slice("v", F.lit(2), F.size("v") - 1), lambda x: x.cast("double")).alias("features"), "file")


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The point files of a folder as chunks in the order of their names: (id, features, chunk)."""
    points = read_points(spark, folder)
    names = sorted(r.file for r in points.select("file").distinct().collect())
    number = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("file")) - 1
    return points.select("id", "features", number.cast("int").alias("chunk"))


def read_words(spark: SparkSession, path: str) -> list[str]:
    """A list of words, one per line; it is small by its nature."""
    return [r.value for r in spark.read.text(path).collect()]


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_lines(df: DataFrame, path: str) -> None:
    """Writes a one-column string table as text, in one ordered file if the table is ordered and small."""
    df.write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Adds rows to the CSV files in ``path``; every file begins with the header, which ``read_csv`` drops again."""
    df.write.mode("append").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_run_time(spark: SparkSession, path: str, took: dict[str, float]) -> None:
    """One JSON object of a run time in seconds, as ``timed`` gives it."""
    spark.createDataFrame([(float(took["time"]),)], "time double").write.mode("overwrite").json(path)


def pair_document(rows: DataFrame, key: str, value: str, *order: Column | str) -> DataFrame:
    """One JSON object {"result": [[key, value], ...]} of a report of bounded size, in the given order."""
    pair = F.concat(F.expr(f"regexp_replace(to_json(array(`{key}`)), ']$', ',')"), F.to_json(F.array(F.col(value))).substr(F.lit(2), F.lit(1 << 30)))
    place = F.row_number().over(Window.orderBy(*order))
    listed = rows.select(place.alias("at"), pair.alias("pair")).agg(F.array_sort(F.collect_list(F.struct("at", "pair")))["pair"].alias("all"))
    return listed.select(F.concat(F.lit('{"result":['), F.array_join("all", ","), F.lit("]}")).alias("value"))


def document(spark: SparkSession, **parts: DataFrame | object) -> DataFrame:
    """One JSON object of named results: scalars as they are, tables (reports of bounded size) as lists of rows."""
    out = spark.range(1).select(F.lit(1).alias("_one"))
    for name, part in parts.items():
        if isinstance(part, DataFrame):
            rows = part.agg(F.collect_list(F.struct(*part.columns)).alias(name)).withColumn("_one", F.lit(1))
            out = out.join(rows, "_one")
        else:
            out = out.withColumn(name, F.lit(part))
    return out.select(F.to_json(F.struct(*parts)).alias("value"))


def community_lines(communities: DataFrame) -> DataFrame:
    """One line per community, ordered by size and members: quoted members joined by a comma and a blank."""
    line = F.concat(F.lit("'"), F.array_join("members", "', '"), F.lit("'"))
    return communities.orderBy("size", "members").select(line.alias("value"))


def edge_lines(scores: DataFrame) -> DataFrame:
    """One line per edge, ordered by falling score and the pair: ('a', 'b'), score."""
    return scores.orderBy(F.desc("score"), "a", "b").select(F.format_string("('%s', '%s'), %s", "a", "b", F.col("score").cast("string")).alias("value"))


def point_map(labels: DataFrame) -> DataFrame:
    """JSON lines of id and cluster, -1 for points in no cluster."""
    return labels.select(F.to_json(F.struct(F.col("id").cast("string").alias("id"), "cluster")).alias("value"))


def point_map_lines(labels: DataFrame) -> DataFrame:
    """One JSON object id -> cluster (-1: in none) as ordered lines (value): concatenated they are the document.

    The lines are sorted, not gathered, so the map may be of any size; without points it is empty.
    """
    rows = labels.select(F.lit(1).alias("part"), F.col("id"), F.concat(F.regexp_extract(F.to_json(F.struct(F.col("id").cast("string").alias("id"))), r":(.*)\}$", 1), F.lit(": "), F.col("cluster").cast("string")).alias("line"))
    least = labels.agg(F.min("id")).first()[0]
    rows = rows.withColumn("line", F.concat(F.when(F.col("id") == F.lit(least), "").otherwise(","), "line"))
    kind = dict(rows.dtypes)["id"]
    ends = labels.sparkSession.createDataFrame([(0, "{"), (2, "}")], "part int, line string").select("part", F.lit(None).cast(kind).alias("id"), "line")
    return rows.unionByName(ends).orderBy("part", "id").select(F.col("line").alias("value"))


def timed(run: Callable[[], object]) -> tuple[object, dict[str, float]]:
    """The result of ``run`` and its run time in seconds."""
    at = time.perf_counter()
    out = run()
    return out, {"time": time.perf_counter() - at}
