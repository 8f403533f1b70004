"""The mining operators on small inputs: goldens by brute force, invariants, sources and streams."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from siftmill.functions import scalars as S
from siftmill.operators import basic, cluster, graph, itemsets, recommend, similarity
from siftmill.session import materialise
from siftmill.sources import files
from siftmill.streaming.chunks import cluster_stream


@pytest.fixture(scope="module")
def entries():
    rng = random.Random(3)
    return sorted({(f"b{rng.randint(0, 39)}", f"{int(rng.paretovariate(0.6)) % 12 + 97}") for _ in range(400)})


def brute_itemsets(entries, support):
    baskets = {}
    for b, i in entries:
        baskets.setdefault(b, set()).add(i)
    items, out = sorted({i for _, i in entries}), {}
    for k in range(1, len(items) + 1):
        level = {c: n for c in itertools.combinations(items, k) if (n := sum(set(c) <= x for x in baskets.values())) >= support}
        if not level:
            return out
        out |= level
    return out


def test_itemsets_by_both_ways_and_any_chunks(spark, entries):
    rows = itemsets.entries(spark.createDataFrame([*entries, (None, "1"), ("b1", None), *entries[:9]], "u string, i string"), "u", "i")
    want = brute_itemsets(entries, 7)
    assert max(map(len, want)) >= 3
    as_dict = lambda df: {tuple(r.itemset): r.support for r in df.collect()}
    assert as_dict(itemsets.frequent_itemsets(rows, 7)) == want
    for n in (1, 3):
        assert as_dict(itemsets.two_phase_itemsets(rows, 7, F.pmod(F.xxhash64("basket"), F.lit(n)))) == want
    assert itemsets.frequent_itemsets(rows.limit(0), 7).count() == 0


def test_large_classes_are_divided_and_counted_in_blocks(spark, monkeypatch, entries):
    rows = itemsets.entries(spark.createDataFrame(entries, "u string, i string"), "u", "i")
    want = brute_itemsets(entries, 7)
    for class_rows, bits in ((40, 64 << 20), (10**6, 0), (5, 0)):
        monkeypatch.setattr(itemsets, "CLASS_ROWS", class_rows)
        monkeypatch.setattr(itemsets, "BIT_BYTES", bits)
        found = itemsets.frequent_itemsets(rows, 7).collect()
        assert len(found) == len(want) and {tuple(r.itemset): r.support for r in found} == want
        short = itemsets.frequent_itemsets(rows, 7, max_size=3).collect()
        assert len(short) == len({k for k in want if len(k) <= 3}) and all(len(r.itemset) <= 3 for r in short)
        candidates = spark.createDataFrame([(list(k),) for k in want] + [(["97", "none"],)], "itemset array<string>")
        assert {tuple(r.itemset): r.support for r in itemsets.count_itemsets(candidates, rows, 7).collect()} == want


def test_a_basket_of_fifty_thousand_items(spark, entries):
    big = spark.range(50_000).select(F.lit("big").alias("basket"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("item"))
    rows = materialise(itemsets.entries(spark.createDataFrame(entries, "basket string, item string"), "basket", "item").unionAll(big))
    got = {tuple(r.itemset): r.support for r in itemsets.two_phase_itemsets(rows, 7, F.lit(0)).collect()}
    assert got == brute_itemsets(entries, 7)


def test_bucket_pruning_loses_no_pair(spark, entries):
    rows = itemsets.entries(spark.createDataFrame(entries, "u string, i string"), "u", "i").withColumn("chunk", F.lit(0))
    supports = spark.createDataFrame([(0, 7)], "chunk int, local_support bigint")
    for numeric, buckets in ((True, 5), (True, 1000), (False, 50)):
        got = {tuple(r.itemset): r.support for r in itemsets.pruned_pairs(rows, supports, buckets, numeric=numeric).collect()}
        assert got == {k: n for k, n in brute_itemsets(entries, 7).items() if len(k) == 2}


def test_words_and_scalars(spark):
    df = spark.createDataFrame([("The don't-stop (Pizza)! pizza\n 12 i",), (None,), ("",)], "t string")
    assert {r.word: r.n for r in basic.word_counts(df, "t").collect()} == {"pizza": 2}
    nums = spark.createDataFrame([(x,) for x in (0.5, 1.5, 2.5, 4.6, 2.4, 1.0, 4.2)], "x double")
    assert [r[0] for r in nums.select(S.half_even(F.col("x"))).collect()] == [0, 2, 2, 5, 2, 1, 4]
    assert [r[0] for r in nums.select(S.step_score(F.col("x"))).collect()] == [2, 2, 2.5, 5, 2, 2, 4.2]
    assert [r[0] for r in nums.select(S.step_mean(F.col("x"))).collect()] == [2, 2, 2, 5, 2, 2, 5]


def test_categories_weigh_by_review(spark):
    reviews = spark.createDataFrame([("a", 5.0), ("a", 1.0), ("b", 4.0), ("c", 3.0), (None, 1.0)], "k string, s double")
    business = spark.createDataFrame([("a", "X, Y,X"), ("b", "X"), ("c", None), ("d", "Z"), ("c", "")], "k string, c string")
    got = {r.category: (round(r["mean"], 6), r.n) for r in basic.category_means(reviews, business, key="k", stars="s", categories="c").collect()}
    assert got == {"X": (3.2, 5), "Y": (3.0, 2)}


def test_partition_statistics(spark):
    df = spark.range(1000).select((F.col("id") % 7).cast("string").alias("k"))
    for parts in (basic.hash_partitioned(df, "k", 27), basic.randomly_partitioned(df, 27)):
        sizes = basic.partition_sizes(parts, 27).collect()
        assert len(sizes) == 27 and sum(r.n for r in sizes) == 1000
        assert {r.n for r in basic.group_counts(parts, "k", above=142).collect()} == {143}


def test_set_similarity(spark):
    rng = random.Random(5)
    sets = {f"s{i}": {f"t{int(rng.paretovariate(0.5)) % 40}" for _ in range(rng.randint(1, 20))} for i in range(60)}
    df = spark.createDataFrame([(k, t) for k, s in sets.items() for t in s] + [(None, "t1"), ("s1", None)], "o string, t string")
    pairs = [(a, b, len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a, b in itertools.combinations(sorted(sets), 2)]
    for array in (4096, 8):
        found = similarity.jaccard_pairs(df, "o", "t", num=3, den=10, array=array).collect()
        got = {(r.a, r.b) for r in found}
        assert got == {(a, b) for a, b, n, u in pairs if n * 10 >= 3 * u} and len(found) == len(got)
        over = {(r.a, r.b): r.n_ab for r in similarity.overlapping_pairs(df, "o", "t", 4, array=array).collect()}
        assert over == {(a, b): n for a, b, n, _ in pairs if n >= 4}
    lsh = {(r.a, r.b) for r in similarity.lsh_pairs(df, "o", "t", num=3, den=10, bands=30, rows=2).collect()}
    assert lsh <= got and len(lsh) > 0.7 * len(got)
    assert lsh == {(r.a, r.b) for r in similarity.lsh_pairs(df, "o", "t", num=3, den=10, bands=30, rows=2, array=8).collect()}


@pytest.fixture(scope="module")
def ratings(spark):
    rng = random.Random(7)
    rows = {(f"u{rng.randint(0, 30)}", f"i{rng.randint(0, 12)}"): float(rng.randint(1, 5)) for _ in range(250)}
    return rows, spark.createDataFrame([(u, i, s) for (u, i), s in rows.items()], "user string, item string, stars double")


def test_correlation(spark, ratings):
    rows, df = ratings
    got = {(r.b1, r.b2): (r.n, round(r.sim, 9)) for r in similarity.correlated_items(df, co_rated=4, above=-2).collect()}
    want = {}
    for a, b in itertools.combinations(sorted({i for _, i in rows}), 2):
        both = [(rows[u, a], rows[u, b]) for u in {u for u, _ in rows} if (u, a) in rows and (u, b) in rows]
        if len(both) >= 4:
            ma, mb = (sum(x) / len(both) for x in zip(*both))
            va, vb = sum((x - ma) ** 2 for x, _ in both), sum((y - mb) ** 2 for _, y in both)
            want[a, b] = (len(both), round(sum((x - ma) * (y - mb) for x, y in both) / math.sqrt(va * vb), 9) if va > 1e-9 and vb > 1e-9 else 0.0)
    assert got == want


def test_correlation_is_the_same_with_giants_and_with_equal_sets(spark, ratings):
    rows, df = ratings
    same = spark.createDataFrame([(f"u{u}", f"{e}{k}", float(1 + u * (k + 2) % 5)) for e, n in (("e", 6), ("f", 4)) for k in range(4) for u in range(n)], "user string, item string, stars double")
    df = df.unionByName(same)
    v, w = df.selectExpr("user", "item b1", "stars v"), df.selectExpr("user", "item b2", "stars w")
    want = {(r.b1, r.b2): r.n for r in v.join(w, "user").where("b1 < b2").groupBy("b1", "b2").agg(F.count("*").alias("n")).where("n >= 4").collect()}
    found = []
    for array in (4096, 10, 3):
        model = similarity.correlated_items(df, co_rated=4, above=-2, array=array).collect()
        found.append({(r.b1, r.b2): (r.n, r.sim) for r in model})
        assert {k: n for k, (n, _) in found[-1].items()} == want and len(model) == len(want)
    assert found[0] == found[1] == found[2] and ("e0", "f3") in want and ("e0", "e1") in want


def test_directed_model_by_hand(spark, ratings):
    rows, df = ratings
    model = {(r.b1, r.b2): r.sim for r in similarity.correlated_items(df, co_rated=5, above=0.0).collect()}
    pairs = spark.createDataFrame([("u1", "i1"), ("u2", "i1"), ("u2", "new"), ("u1", "i1")], "user string, item string")
    raters = Counter(i for _, i in rows)
    want = {(nb, "i1"): model.get((min(nb, "i1"), max(nb, "i1"))) for u in ("u1", "u2") for x, nb in rows if x == u and nb != "i1"}
    want = {k: v for k, v in want.items() if v is not None} | ({("i1", "i1"): 1.0} if raters["i1"] >= 5 and any((u, "i1") in rows for u in ("u1", "u2")) else {})
    got = {(r.nb, r["item"]): r.sim for r in similarity.directed_model(pairs, df, co_rated=5).collect()}
    assert got == pytest.approx(want) and want


def test_cold_start_rules(spark, ratings):
    rows, df = ratings
    model = similarity.correlated_items(df, co_rated=3)
    pairs = spark.createDataFrame([("u1", "new"), ("new", "i1"), ("new", "new"), ("u1", "i1"), ("u1", "i1")], "user string, item string")
    cf = {(r.user, r.item): r for r in recommend.predict_collaborative(pairs, df, model).collect()}
    mean = lambda p: sum(s for k, s in rows.items() if p(k)) / sum(p(k) for k in rows)
    assert len(cf) == 4 and cf["new", "new"].stars == 2.5 and cf["new", "new"].history == 0
    assert math.isclose(cf["u1", "new"].stars, mean(lambda k: k[0] == "u1")) and math.isclose(cf["new", "i1"].stars, mean(lambda k: k[1] == "i1"))
    knn = {(r.user, r.item): r.rule for r in recommend.predict_neighbours(pairs, df, model).collect()}
    assert knn["u1", "new"] == "user" and knn["new", "i1"] == "item" and knn["new", "new"] == "unknown"
    blended = recommend.blend(recommend.predict_collaborative(pairs, df, model), pairs.distinct().withColumn("stars", F.lit(3.0))).collect()
    assert len(blended) == 4 and all(2.0 <= r.stars <= 5.0 for r in blended)


def test_model_and_errors(spark, ratings):
    _, df = ratings
    users = df.groupBy("user").agg(F.count("*").alias("user_count"), F.avg("stars").alias("user_mean"))
    items = df.groupBy("item").agg(F.count("*").alias("item_count"), F.avg("stars").alias("item_mean"))
    p = recommend.predict_model(recommend.features(df, users, items), recommend.features(df.drop("stars"), users, items), trees=3, depth=3)
    e = recommend.errors(p, df).first()
    assert e.n == df.count() and 0 < e.rmse < 1.5 and e.n_extreme == df.where("stars in (1, 2, 5)").count()


def test_boosted_trees(spark):
    import numpy as np

    from siftmill.operators import boosting

    rng = random.Random(4)
    rows = [(float(rng.randint(0, 9)), rng.random(), None if rng.random() < 0.1 else rng.gauss(0, 1), 0.0, i) for i in range(3000)]
    rows = [(a, b, c, (3.0 if a > 4 else 0.0) + (1.0 if b > 0.5 and (c or -9) > 0 else 0.0), i) for a, b, c, _, i in rows] + [(1.0, 1.0, 1.0, None, -1)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, id int")
    model = boosting.boosted_trees(df, ["a", "b", "c"], "y", bins=40, trees=40, depth=3, rate=0.3)
    got = {r.id: r.prediction for r in model.predict(df).collect()}
    error = [(got[i] - y) ** 2 for *_, y, i in rows if y is not None]
    assert len(got) == len(rows) and sum(error) / len(error) < 0.03
    # One tree of one level: the best single cut, its leaves shrunk by the penalty, by hand.
    x, y = np.array([[0], [1], [2], [3]]), np.array([1.0, 1.0, 4.0, 6.0])
    tree, leaf = boosting.grow(x, np.ones(4), y - 3.0, 4, 1, 0.5, 1.0)
    assert (tree.feature[0], tree.cut[0]) == (0, 1) and leaf.tolist() == [1, 1, 2, 2] == tree.leaves(x).tolist()
    assert tree.value[1:].tolist() == [0.5 * -4 / 3, 0.5 * 4 / 3]
    again = boosting.boosted_trees(df.repartition(5), ["a", "b", "c"], "y", bins=40, trees=3, depth=3)
    assert [t.cut.tolist() for t in again.trees] == [t.cut.tolist() for t in boosting.boosted_trees(df, ["a", "b", "c"], "y", bins=40, trees=3, depth=3).trees]
    assert boosting.boosted_trees(df.limit(0), ["a"], "y").predict(df.limit(2)).count() == 2
    assert [r.prediction for r in boosting.boosted_trees(df.limit(0), ["a"], "y").predict(df.limit(1)).collect()] == [0.0]


EDGES = [(a, b) for part in ("abcd", "efgh") for a, b in itertools.combinations(part, 2)] + [("d", "e"), ("x", "y")]


def brute_betweenness(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    score = Counter()
    for root in near:
        dist, sigma, order, parents = {root: 0}, Counter({root: 1}), [], {}
        queue = deque([root])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    parents.setdefault(w, []).append(v)
        credit = Counter()
        for w in reversed(order):
            for v in parents.get(w, []):
                c = (credit[w] + 1) * sigma[v] / sigma[w]
                credit[v] += c
                score[tuple(sorted((v, w)))] += c / 2
    return score, near


def test_graph(spark):
    edges = spark.createDataFrame(EDGES, "a string, b string")
    comp = {r.id: r.component for r in graph.connected_components(edges).collect()}
    assert comp == {**{v: "a" for v in "abcdefgh"}, "x": "x", "y": "x"}
    want, _ = brute_betweenness(EDGES)
    got = {(r.a, r.b): r.score for r in graph.edge_betweenness(edges).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    parts, log = graph.divide(edges)
    assert {frozenset(r.members) for r in graph.communities(parts, "component").collect()} == {frozenset("abcd"), frozenset("efgh"), frozenset("xy")}
    assert log[0][2] < max(q for _, _, q in log) and log[-1][1] == 0
    labels = {r.id: r.label for r in graph.label_propagation(edges).collect()}
    assert len(labels) == 10 and labels["x"] != labels["y"]  # two vertices swap labels each round
    assert graph.connected_components(edges.limit(0)).count() == 0


def test_betweenness_and_division_by_both_ways(spark, monkeypatch):
    rng = random.Random(6)
    pairs = sorted({tuple(sorted(rng.sample([f"v{i:02}" for i in range(24)], 2))) for _ in range(40)})
    edges = spark.createDataFrame(pairs, "a string, b string")
    want, _ = brute_betweenness(pairs)
    close = lambda df: {(r.a, r.b): r.score for r in df.collect()} == {k: pytest.approx(v) for k, v in want.items()}
    assert close(graph.edge_betweenness(edges))
    monkeypatch.setattr(graph, "QUICK", 0)
    assert close(graph.edge_betweenness(edges)) and close(graph.joined_betweenness(edges))
    parts, log = graph.divide(edges, max_rounds=4)
    monkeypatch.setattr(graph, "HELD_EDGES", 0)
    other, again = graph.divide(edges, max_rounds=4)
    assert [x[:2] for x in log] == [x[:2] for x in again] and [x[2] for x in log] == pytest.approx([x[2] for x in again])
    assert sorted(parts.collect()) == sorted(other.collect())
    nothing = edges.limit(0)
    monkeypatch.setattr(graph, "HELD_EDGES", 10)
    assert graph.edge_betweenness(nothing).count() == 0 and graph.divide(nothing)[0].count() == 0


def test_cooccurrence_graph(spark):
    df = spark.createDataFrame([(u, f"i{i}") for u, n in (("a", 8), ("b", 7), ("c", 3)) for i in range(n)], "u string, i string")
    assert [(r.a, r.b, r.shared) for r in graph.cooccurrence_edges(df, "u", "i", 7).collect()] == [("a", "b", 7)]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(10 * (i % 3), 1), rng.gauss(-10 * (i % 3), 1)], i // 60) for i in range(180)]
    rows += [(1000 + j, [500.0 + 90 * j, 500.0], 1) for j in range(2)]
    return rows, spark.createDataFrame(rows, "id long, features array<double>, chunk int")


def test_kmeans(spark, blobs):
    rows, df = blobs
    clustered, centres = cluster.kmeans(df.where("id < 1000").select("id", "features"), 3)
    got = {r.id: r.cluster for r in clustered.collect()}
    assert len({frozenset(i for i, c in got.items() if c == k) for k in range(3)}) == 3
    assert all(len({got[i] for i in range(k, 180, 3)}) == 1 for k in range(3))
    few, _ = cluster.kmeans(df.where("id < 2").select("id", "features"), 5)
    assert len({r.cluster for r in few.collect()}) == 2
    assert cluster.kmeans(df.limit(0).select("id", "features"), 3)[0].count() == 0


def test_clustering_in_memory_and_by_jobs_is_the_same(spark, monkeypatch, blobs):
    rows, df = blobs
    points = df.select("id", "features").repartition(3)
    held = cluster.kmeans(points, 4)
    few = cluster.farthest_first(points, 6)
    monkeypatch.setattr(cluster, "HELD_VALUES", 0)
    monkeypatch.setattr(cluster, "MATRIX_VALUES", 16)
    jobs = cluster.kmeans(points, 4)
    assert {r.id: r.cluster for r in held[0].collect()} == {r.id: r.cluster for r in jobs[0].collect()}
    assert all(math.dist(a, b) < 1e-9 for a, b in zip(held[1], jobs[1])) and cluster.farthest_first(points, 6) == few
    monkeypatch.setattr(cluster, "HELD_CLUSTERS", 2)
    got = {r.cluster: (r.n, r.s, r.ss) for r in cluster.summaries(df.withColumn("cluster", F.concat(F.lit("c"), F.col("id") % 7))).collect()}
    for k in range(7):
        mine = [x for i, x, _ in rows if i % 7 == k]
        assert got[f"c{k}"][0] == len(mine) and got[f"c{k}"][1] == pytest.approx([sum(c) for c in zip(*mine)]) and got[f"c{k}"][2] == pytest.approx([sum(v * v for v in c) for c in zip(*mine)])


def test_close_summaries_merge(spark):
    rng = random.Random(1)

    def made(key, at):
        points = [[rng.gauss(at, 1), rng.gauss(-at, 1)] for _ in range(20)]
        return cluster.Summary(key, 20, [sum(c) for c in zip(*points)], [sum(v * v for v in c) for c in zip(*points)])

    sets = [made(0, 0), made(1, 100), made(2, 0.1), made(3, 100.1), made(4, 0.2), made(5, -500)]
    moved = cluster.merge_close(sets)
    assert [(s.key, s.n) for s in sets] == [(0, 60), (1, 40), (5, 20)] and moved == {2: 0, 4: 0, 3: 1}
    assert cluster.merge_close(sets) == {} and cluster.merge_close([]) == {}


def test_chunked_clustering_keeps_every_point(spark, blobs):
    rows, df = blobs
    state = cluster.cluster_chunks(df, k=3, max_rounds=20)
    labels = [(r.id, r.cluster) for r in state.labels().collect()]
    assert sorted(i for i, _ in labels) == sorted(r[0] for r in rows)
    stats = state.rounds(spark).collect()
    assert [r["round"] for r in stats] == [1, 2, 3]
    assert stats[-1].discard_points + stats[-1].compression_points + stats[-1].retained_points == len(rows)
    assert sum(s.n for s in state.discard) == sum(c >= 0 for _, c in labels)


def test_files_round_trip(spark, tmp_path, blobs):
    rows, df = blobs
    for c in range(3):
        lines = "\n".join(f"{i},{x[0]!r},{x[1]!r}" for i, x, chunk in rows if chunk == c)
        (tmp_path / "chunks").mkdir(exist_ok=True)
        (tmp_path / "chunks" / f"part{c}.txt").write_text(lines + "\n")
    back = files.read_chunks(spark, str(tmp_path / "chunks"))
    assert {(int(r.id), tuple(r.features), r.chunk) for r in back.collect()} == {(i, tuple(x), c) for i, x, c in rows}
    state = cluster_stream(spark, str(tmp_path / "chunks"), str(tmp_path / "checkpoint"), k=3, max_rounds=20)
    assert state.labels().count() == len(rows) and len(state.stats) == 3
    (tmp_path / "pairs.csv").write_text("user_id,business_id\nu1,97\nu2,98\n")
    assert files.read_pairs(spark, str(tmp_path / "pairs.csv")).count() == 2
    (tmp_path / "words.txt").write_text("a\nthe\n")
    assert files.read_words(spark, str(tmp_path / "words.txt")) == ["a", "the"]
    model = spark.createDataFrame([("a", "b", 0.5)], "b1 string, b2 string, sim double")
    files.write_json_lines(model, str(tmp_path / "model"))
    assert files.read_json_lines(spark, str(tmp_path / "model"), "model").collect() == model.collect()
    doc = files.document(spark, A=basic.row_count(df), n=3).first().value
    assert doc == '{"A":[{"n":182}],"n":3}'
    lines = files.community_lines(spark.createDataFrame([(2, ["a", "b"]), (1, ["c"])], "size int, members array<string>"))
    assert [r.value for r in lines.collect()] == ["'c'", "'a', 'b'"]
    scored = files.edge_lines(spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.0)], "a string, b string, score double"))
    assert [r.value for r in scored.collect()] == ["('a', 'c'), 2.0", "('a', 'b'), 1.0"]
    assert files.timed(lambda: 1)[1]["time"] >= 0
    files.write_run_time(spark, str(tmp_path / "time"), {"time": 1.5})
    assert spark.read.json(str(tmp_path / "time")).collect() == [(1.5,)]
    rows = spark.createDataFrame([('a "q"', 4.5), ("b", 5.0)], "k string, v double")
    assert files.pair_document(rows, "k", "v", F.desc("v"), "k").first().value == '{"result":[["b",5.0],["a \\"q\\"",4.5]]}'
    assert files.pair_document(rows.limit(0), "k", "v", "k").first().value == '{"result":[]}'
    import json

    labels = spark.createDataFrame([(i, i % 3 - 1) for i in range(50)], "id long, cluster int").repartition(4)
    assert json.loads("\n".join(r.value for r in files.point_map_lines(labels).collect())) == {str(i): i % 3 - 1 for i in range(50)}
    assert json.loads("".join(r.value for r in files.point_map_lines(labels.limit(0)).collect())) == {}
    for n in (1, 2):
        files.append_csv(spark.createDataFrame([(n, "x")], "round int, t string"), str(tmp_path / "rounds"))
    assert sorted(files.read_csv(spark, str(tmp_path / "rounds"), "round int, t string").collect()) == [(1, "x"), (2, "x")]
    again = cluster.cluster_chunks(df, k=3, max_rounds=20, rounds_path=str(tmp_path / "stats"))
    assert sorted(files.read_csv(spark, str(tmp_path / "stats"), cluster.ROUNDS).collect()) == again.rounds(spark).collect()
