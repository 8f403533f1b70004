"""The registered queries do the whole job: the operators' settings, without cuts in size, rounds or support."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

DATA, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def exact_similarities(d: str) -> dict:
    """All pairs of businesses of Jaccard similarity 1/10 or more, by SQL without a limit on the sets' sizes."""
    import verify

    from siftmill.plans.mining_sql import OVERLAP, SETS

    sql = f"""WITH e AS ({SETS}), n AS (SELECT id, count(*) AS n FROM e GROUP BY 1)
      SELECT a, b, o.n / (x.n + y.n - o.n) AS sim FROM ({OVERLAP}) o JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE o.n * 11 >= x.n + y.n"""
    return {(a, b): sim for a, b, sim in verify.connect(d).execute(sql).fetchall()}


def test_lsh_pairs_reach_a_recall_of_nine_tenths_from_one_third(spark):
    exact = exact_similarities(MORE)
    found = {(r.a, r.b): r.sim for r in entry.queries()["lsh_pairs"](spark, MORE).collect()}
    assert all(round(exact[p], 6) == sim for p, sim in found.items())
    alike = {p for p, sim in exact.items() if sim * 3 >= 1}
    assert alike and len(alike & found.keys()) >= 0.9 * len(alike)
    assert min(found.values()) < 0.2


def test_jaccard_pairs_are_all_pairs_from_one_tenth(spark):
    got = {(r.a, r.b): r.sim for r in entry.queries()["jaccard_pairs"](spark, DATA).collect()}
    assert got == {p: round(sim, 6) for p, sim in exact_similarities(DATA).items()}


def test_item_model_takes_pairs_of_three_common_raters(spark):
    from siftmill.operators import similarity
    from siftmill.plans import datasets

    ratings = datasets.raw_ratings(spark, MORE).groupBy("user", "item").agg({"stars": "avg"}).withColumnRenamed("avg(stars)", "stars")
    want = {(r.b1, r.b2, r.n) for r in similarity.correlated_items(ratings).collect()}
    got = {(r.b1, r.b2, r.n) for r in entry.queries()["item_model"](spark, MORE).collect()}
    assert got == want and min(n for *_, n in got) == 3


@pytest.mark.parametrize("name", ["chunk_labels", "chunk_rounds"])
def test_chunked_clustering_runs_to_zero_shift(spark, monkeypatch, name):
    from siftmill.operators import cluster

    class Made(Exception):
        pass

    def started(self, chunk):
        raise Made(self.max_rounds)

    monkeypatch.setattr(cluster.ChunkedClustering, "feed", started)
    with pytest.raises(Made, match="^1000$"):
        entry.queries()[name](spark, DATA)


def test_blended_model_is_the_operators_own(spark, monkeypatch):
    from siftmill.operators import recommend

    seen, model = [], recommend.predict_model
    monkeypatch.setattr(recommend, "predict_model", lambda train, test, **how: seen.append(how) or model(train, test, trees=1, depth=1))
    entry.queries()["blended_predictions"](spark, DATA)
    assert seen and seen[0].get("trees", 95) == 95 and seen[0].get("depth", 10) == 10


def test_local_candidates_and_document_hold_every_frequent_itemset(spark):
    import json

    q = entry.queries()
    frequent = {r.itemset for r in q["frequent_itemsets"](spark, MORE).collect()}
    assert frequent <= {r.itemset for r in q["local_candidates"](spark, MORE).collect()}
    document = json.loads(q["itemset_document"](spark, MORE).first()[0])
    assert {",".join(s) for level in document["frequent"] for s in level["itemsets"]} == frequent


def test_graph_divided_runs_all_rounds(spark, monkeypatch):
    from siftmill.operators import graph

    seen, divide = [], graph.divide
    monkeypatch.setattr(graph, "divide", lambda edges, **how: seen.append(how) or divide(edges, max_rounds=0))
    entry.queries()["graph_divided"](spark, DATA)
    assert seen and seen[0].get("max_rounds") is None


def joined_rows(df) -> int:
    """The most rows that a join of the executed plan of ``df`` gave."""
    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            return walk(node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan())
        own = node.metrics().apply("numOutputRows").value() if "Join" in node.nodeName() else 0
        children = node.children()
        return max([own, *(walk(children.apply(i)) for i in range(children.size()))])

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("name", ["stored_model_predictions", "prediction_errors", "blended_errors", "neighbour_predictions", "blended_predictions", "collaborative_predictions"])
def test_predictions_join_the_shorter_list_of_each_pair(spark, monkeypatch, name):
    from siftmill.operators import recommend

    seen, near, trees = {}, recommend.neighbours, recommend.boosted_trees

    def counted(pairs, ratings, model, n):
        per_item = model.selectExpr("explode(array(b1, b2)) item").groupBy("item").count().withColumnRenamed("count", "m")
        lists = pairs.select("user", "item").distinct().join(per_item, "item").join(ratings.groupBy("user").count(), "user")
        seen["least"], seen["items"] = lists.selectExpr("sum(least(m, count))", "sum(m)").first()
        seen["keys"] = max(pairs.count(), ratings.count())
        return near(pairs, ratings, model, n)

    monkeypatch.setattr(recommend, "neighbours", counted)
    monkeypatch.setattr(recommend, "boosted_trees", lambda *a, **how: trees(*a, **how | {"trees": 1, "depth": 1}))
    rows = joined_rows(entry.queries()[name](spark, MORE))
    assert 0 < rows <= max(seen["least"], seen["keys"]) < seen["items"]


class Modelled(Exception):
    pass


@pytest.mark.parametrize("name", ["neighbour_predictions", "blended_errors", "collaborative_predictions"])
def test_models_meet_ratings_of_common_users_only(spark, monkeypatch, name):
    from siftmill.operators import recommend, similarity

    made, trees = similarity.correlated_items, recommend.boosted_trees

    def measured(ratings, **how):
        per_item = ratings.groupBy("item").count()
        pairs = similarity.overlapping_pairs(ratings, "item", "user", how["co_rated"])
        n_a, n_b = (per_item.select(per_item["item"].alias(c), per_item["count"].alias(f"n_{c}")) for c in ("a", "b"))
        least = pairs.select("a", "b").join(n_a, "a").join(n_b, "b").selectExpr("sum(least(n_a, n_b))").first()[0]
        raise Modelled(joined_rows(made(ratings, **how)) < least)

    monkeypatch.setattr(similarity, "correlated_items", measured)
    monkeypatch.setattr(recommend, "boosted_trees", lambda *a, **how: trees(*a, **how | {"trees": 1, "depth": 1}))
    with pytest.raises(Modelled, match="^True$"):
        entry.queries()[name](spark, MORE)


def test_a_written_intermediate_leaves_no_shuffle_files(spark):
    import time

    from siftmill import session

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in disk.getAllFiles().mkString("|").split("|") if "/shuffle_" in x}
    before, setting = files(), spark.conf.get(session.FREED, None)
    back = session.materialise(spark.range(10_000).selectExpr("id % 100 AS k").groupBy("k").count())
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and back.count() == 100 and spark.conf.get(session.FREED, None) == setting


def test_model_and_neighbours_in_parts_are_those_of_the_whole(spark):
    """Also with equal sets and with items of more ratings than are gathered."""
    import random

    from siftmill.operators import recommend, similarity

    draw = random.Random(5)
    raters = {i: sorted(draw.sample(range(25), draw.choice([3, 4, 6, 12]))) for i in range(24)} | {24: [0, 1, 2, 3], 25: [0, 1, 2, 3], 26: [0, 1, 2, 3]}
    ratings = spark.createDataFrame([(f"u{u}", f"i{i:02}", float(draw.randint(1, 5))) for i, us in raters.items() for u in us], "user string, item string, stars double").cache()
    whole = similarity.correlated_items(ratings, array=8, above=-2.0)
    parts = similarity.correlated_items(ratings, array=8, above=-2.0, most=40)
    assert not hasattr(whole, "_siftmill_path") and hasattr(parts, "_siftmill_path")
    assert sorted(whole.collect()) == sorted(parts.collect()) and whole.count() > 50
    pairs = ratings.select("user").distinct().crossJoin(ratings.select("item").distinct())
    near = recommend.neighbours(pairs, ratings, parts, 4, most=100)
    assert hasattr(near, "_siftmill_path")
    columns = ["user", "item", "nb", "stars", "sim", "rank"]
    assert sorted(near.select(columns).collect()) == sorted(recommend.neighbours(pairs, ratings, parts, 4).select(columns).collect())


def test_collaborative_predictions_run_on_codes_and_delete_what_the_model_wrote(spark, monkeypatch):
    from pathlib import Path

    from siftmill import session
    from siftmill.operators import recommend

    seen, near = {}, recommend.neighbours

    def noted(pairs, ratings, model, n):
        seen["types"] = {t for df in (pairs, ratings, model) for c, t in df.dtypes if c in ("user", "item", "b1", "b2")}
        seen["left"] = [p for _, p in session._written[before:] if Path(p.removeprefix("file:")).exists()]
        return near(pairs, ratings, model, n)

    monkeypatch.setattr(recommend, "neighbours", noted)
    before = len(session._written)
    assert entry.queries()["collaborative_predictions"](spark, MORE).count()
    assert seen["types"] == {"bigint"}
    # The codes of users and of items, the pairs, the ratings and the model.
    assert len(seen["left"]) == 5 < len(session._written) - before


def test_blended_predictions_take_features_and_ratings_on_codes(spark, monkeypatch):
    from siftmill.operators import recommend

    seen, made = set(), recommend.features
    monkeypatch.setattr(recommend, "features", lambda *dfs: seen.update(t for df in dfs for c, t in df.dtypes if c in ("user", "item")) or made(*dfs))
    monkeypatch.setattr(recommend, "predict_model", lambda train, test, **how: test.selectExpr("user", "item", "3D AS stars"))
    out = entry.queries()["blended_predictions"](spark, DATA)
    assert seen == {"bigint"} and dict(out.dtypes)["user"] == "string"
