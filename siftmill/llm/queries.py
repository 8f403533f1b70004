"""Queries of the training-data problems of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm.cooccur import item_pairs
from siftmill.llm.langid import identify
from siftmill.llm.mixing import Target, mix, share_report, source_name
from siftmill.llm.packing import fill_report, pack
from siftmill.llm.setjoin import set_links, similar_sets
from siftmill.llm.terms import term_statistics
from siftmill.llm.tokens import token_count
from siftmill.llm.topn import top_per_group
from siftmill.session import load, materialise


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    return term_statistics(load(spark, d, "review"), "review_id", "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_terms(spark, d).where("mark is not null").select("term", "mark")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = item_pairs(load(spark, d, "small1"), "user_id", "business_id", min_count=8, min_lift=3)
    return found.select(F.col("item_a").alias("business_a"), F.col("item_b").alias("business_b"))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return item_pairs(load(spark, d, "small1"), "user_id", "business_id").withColumn("lift", F.round("lift", 6))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = similar_sets(load(spark, d, "review"), "business_id", "user_id", least=5)
    return found.select(F.col("a").alias("business_a"), F.col("b").alias("business_b"))


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of every business: the number of similar ones and the best similarity."""
    found = set_links(load(spark, d, "review"), "business_id", "user_id", least=5)
    return found.select("business_id", "n_links", F.round("best", 6).alias("best"))


def p5_top3(spark: SparkSession, d: str) -> DataFrame:
    return top_per_group(load(spark, d, "model"), "b1", "b2", "sim", 3)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_top3(spark, d).select("b1", "b2")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", "text", "source", token_count("text").alias("size"))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    tiers = [(r.container, r.capacity_tokens) for r in load(spark, d, "container_size").collect()]
    return pack(_sized(spark, d), "doc_id", "size", tiers)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p8_pack(spark, d), load(spark, d, "container_size"))


def p8_steps(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and cost of every step group."""
    packed = p8_pack(spark, d).where("container is not null")
    return packed.groupBy("container", "step").agg(F.countDistinct("container_no").alias("n_containers"), F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("cost"))


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Documents, and how often the packing breaks a rule: containers above capacity, documents cut though they fit,
    documents whose pieces aren't all of them, places taken twice."""
    tiers = [(r.container, r.capacity_tokens) for r in load(spark, d, "container_size").collect()]
    sized = materialise(_sized(spark, d).select("doc_id", "size"))
    packed = materialise(pack(sized, "doc_id", "size", tiers))
    boxes = packed.where("container is not null").groupBy("container", "container_no").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("slots"))
    rooms = boxes.join(load(spark, d, "container_size"), "container").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("n_over"), F.count_if(F.col("n") != F.col("slots")).alias("n_shared"))
    whole = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("n_tokens").alias("t"))
    docs = sized.join(whole, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if((F.col("k") > 1) & (F.col("size") <= max(c for _, c in tiers))).alias("n_cut"),
        F.count_if(F.coalesce("t", F.lit(-1)) != F.col("size")).alias("n_incomplete"),
    )
    return docs.join(rooms).select("n_documents", "n_over", "n_cut", "n_incomplete", "n_shared")  # one row each


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    targets = [Target(r.source, r.target_share, r.max_repeat) for r in load(spark, d, "mix_target").collect()]
    return mix(_sized(spark, d), "doc_id", "text", "source", "size", targets)


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return share_report(p9_mix(spark, d), load(spark, d, "mix_target"))


def p9_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per target: the number of draws beyond max_repeat or of texts that don't occur under the source, and whether it
    has tokens within a few items of its share among the targets that have any."""
    sized = materialise(_sized(spark, d).select("doc_id", F.sha2("text", 256).alias("h"), source_name("source").alias("own")))
    drawn = materialise(p9_mix(spark, d))
    target = load(spark, d, "mix_target")
    home = sized.select("h", F.col("own").alias("source")).distinct()
    checked = drawn.join(sized.select("doc_id", "h"), "doc_id").join(home.withColumn("there", F.lit(True)), ["h", "source"], "left").join(target, "source")
    per = checked.groupBy("source", "target_share", "max_repeat").agg(
        F.count_if((F.col("uses") > F.col("max_repeat")) | F.col("there").isNull()).alias("n_wrong"), F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"), F.max("n_tokens").alias("largest"),
    )
    per = materialise(per)
    all_of = per.agg(F.sum("tokens").alias("t"), F.sum("target_share").alias("s")).first()
    due = F.col("target_share") * F.lit((all_of.t or 0) / (all_of.s or 1.0))
    near = F.abs(F.col("tokens") - due) <= 4 * F.col("max_repeat") * F.col("largest")
    found = per.select("source", "n_wrong", near.alias("near"))
    return target.select("source").join(found, "source", "left").select("source", F.coalesce("n_wrong", F.lit(0)).alias("n_wrong"), F.coalesce("near", F.lit(False)).alias("near"))


def _languages(spark: SparkSession, d: str) -> DataFrame:
    return identify(load(spark, d, "documents"), "doc_id", "text", "lang", "source", "business_id", load(spark, d, "lang_sample"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of several languages, or with a label that doesn't name theirs: one row for each of their languages."""
    case = (F.size("langs") > 1) | F.col("label_lang").isNull() | (F.col("label_lang") != F.col("langs")[0]["lang"])
    return _languages(spark, d).where((F.size("langs") > 0) & case).select("doc_id", F.explode("langs.lang").alias("lang"))


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).select("doc_id", "label_lang", "lang", F.round("confidence", 6).alias("confidence"), F.size("langs").alias("n_langs"))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = _languages(spark, d).select("doc_id", F.posexplode("segments").alias("segment", "s"))
    return rows.select("doc_id", "segment", F.col("s.begin").alias("char_from"), F.col("s.end").alias("char_to"), F.col("s.lang").alias("lang"), F.col("s.sentences").alias("sentences"), F.round("s.confidence", 6).alias("confidence"))


def queries() -> dict:
    return {
        "p2_found": p2_found,
        "p2_terms": p2_terms,
        "p3_found": p3_found,
        "p3_pairs": p3_pairs,
        "p4_found": p4_found,
        "p4_links": p4_links,
        "p5_found": p5_found,
        "p5_top3": p5_top3,
        "p8_pack": p8_pack,
        "p8_fill": p8_fill,
        "p8_steps": p8_steps,
        "p8_invariants": p8_invariants,
        "p9_mix": p9_mix,
        "p9_report": p9_report,
        "p9_invariants": p9_invariants,
        "p10_found": p10_found,
        "p10_documents": p10_documents,
        "p10_segments": p10_segments,
    }


_TERMS = r"""SELECT term, CAST(sum(c) AS BIGINT) AS occurrences, count(DISTINCT id) AS records,
  CASE WHEN count(DISTINCT id) <= 2 THEN 'rare' WHEN count(DISTINCT id) * 100 > 25 * (SELECT count(DISTINCT trim(review_id, ' ' || chr(9))) FROM review) THEN 'common' END AS mark
FROM (SELECT id, term, count(*) AS c FROM (SELECT id, unnest(regexp_extract_all(t, '[\p{L}\p{N}]+')) AS term
  FROM (SELECT DISTINCT trim(review_id, ' ' || chr(9)) AS id, lower(text) AS t FROM review)) GROUP BY 1, 2) GROUP BY term"""
_PAIRS = """WITH e AS (SELECT DISTINCT trim(user_id, ' ' || chr(9)) AS u, trim(business_id, ' ' || chr(9)) AS b FROM small1 WHERE user_id IS NOT NULL AND business_id IS NOT NULL),
  n AS (SELECT b, count(*) AS n FROM e GROUP BY 1), t AS (SELECT count(DISTINCT u) AS n FROM e),
  p AS (SELECT x.b AS a, y.b AS b, count(*) AS c FROM e x JOIN e y ON x.u = y.u AND x.b < y.b GROUP BY 1, 2)
SELECT a AS {a}, p.b AS {b}{more} FROM p JOIN n x ON x.b = p.a JOIN n y ON y.b = p.b, t"""
_SIMILAR = """WITH e AS (SELECT DISTINCT trim(business_id, ' ' || chr(9)) AS b, trim(user_id, ' ' || chr(9)) AS u FROM review WHERE user_id IS NOT NULL AND business_id IS NOT NULL),
  n AS (SELECT b, count(*) AS n FROM e GROUP BY 1 HAVING count(*) >= 5),
  p AS (SELECT x.b AS a, y.b AS b, count(*) AS c FROM (e SEMI JOIN n USING (b)) x JOIN (e SEMI JOIN n USING (b)) y ON x.u = y.u AND x.b < y.b GROUP BY 1, 2),
  s AS (SELECT p.a, p.b, c / (x.n + y.n - c) AS s FROM p JOIN n x ON x.b = p.a JOIN n y ON y.b = p.b WHERE 3 * c >= x.n + y.n)
"""
_TOP = """SELECT {c} FROM (SELECT b1, b2, sim, row_number() OVER (PARTITION BY b1 ORDER BY sim DESC, b2) AS rank FROM (
  SELECT trim(b1, ' ' || chr(9)) AS b1, trim(b2, ' ' || chr(9)) AS b2, max(sim) AS sim FROM model WHERE sim IS NOT NULL AND NOT isnan(sim) GROUP BY 1, 2)) WHERE rank <= 3"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"SELECT term, mark FROM ({_TERMS}) WHERE mark IS NOT NULL",
        "p2_terms": _TERMS,
        "p3_found": _PAIRS.format(a="business_a", b="business_b", more="") + " WHERE c >= 8 AND c * t.n >= 3 * x.n * y.n",
        "p3_pairs": _PAIRS.format(a="item_a", b="item_b", more=", x.n AS n_a, y.n AS n_b, c AS n_ab, t.n AS n_baskets, round(c * CAST(t.n AS DOUBLE) / (x.n * CAST(y.n AS DOUBLE)), 6) AS lift"),
        "p4_found": _SIMILAR + "SELECT a AS business_a, b AS business_b FROM s",
        "p4_links": _SIMILAR + "SELECT business_id, count(*) AS n_links, round(max(s), 6) AS best FROM (SELECT a AS business_id, s FROM s UNION ALL SELECT b, s FROM s) GROUP BY 1",
        "p5_found": _TOP.format(c="b1, b2"),
        "p5_top3": _TOP.format(c="b1, b2, sim, rank"),
        "p8_invariants": "SELECT count(*) AS n_documents, CAST(0 AS BIGINT) AS n_over, CAST(0 AS BIGINT) AS n_cut, CAST(0 AS BIGINT) AS n_incomplete, CAST(0 AS BIGINT) AS n_shared FROM documents",
        "p9_invariants": r"""SELECT source, CAST(0 AS BIGINT) AS n_wrong, source IN (SELECT regexp_replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '[\s_-]+', '_', 'g') FROM documents WHERE text <> '' AND source IS NOT NULL) AS near FROM mix_target""",
    }
