"""Queries of the mining operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.functions import scalars as S
from siftmill.operators import basic, cluster, graph, itemsets, recommend, similarity
from siftmill.plans import datasets as D
from siftmill.session import discard, folder, load, materialise, materialise_only
from siftmill.sources import files

YEAR, SUPPORT, CHUNKS, BUCKETS = 2018, 9, 4, 1000
BANDS, ROWS = 50, 2
CO_RATED, EDGE = 3, 5


# Counts, words, categories -------------------------------------------------------------------------------------

def top_users(spark: SparkSession, d: str) -> DataFrame:
    return basic.top_counts(D.reviews(spark, d), "user_id", 10)


def category_means(spark: SparkSession, d: str) -> DataFrame:
    return basic.category_means(D.reviews(spark, d), D.business(spark, d), key="business_id", stars="stars", categories="categories")


def category_top(spark: SparkSession, d: str) -> DataFrame:
    return basic.top_categories(category_means(spark, d), 10)


def facts_document(spark: SparkSession, d: str) -> DataFrame:
    r = D.reviews(spark, d)
    return files.document(
        spark, reviews=basic.row_count(r), in_year=basic.year_count(r, "date", YEAR), users=basic.distinct_count(r, "user_id"),
        top_users=basic.top_counts(r, "user_id", 10), top_words=basic.top_words(r, "text", 10),
    )


def category_document(spark: SparkSession, d: str) -> DataFrame:
    """The best categories as {"result": [[category, mean], ...]}."""
    return files.pair_document(category_top(spark, d), "category", "mean", F.desc("mean"), "category")


def partition_buckets(spark: SparkSession, d: str) -> DataFrame:
    return basic.bucket_sizes(load(spark, d, "documents"), F.col("doc_id"), 27)


def partition_hash_sizes(spark: SparkSession, d: str) -> DataFrame:
    return basic.partition_sizes(basic.hash_partitioned(D.reviews(spark, d).select("business_id"), "business_id", 27), 27)


def partition_random_counts(spark: SparkSession, d: str) -> DataFrame:
    return basic.group_counts(basic.randomly_partitioned(D.reviews(spark, d).select("business_id"), 27), "business_id", above=4)


def partition_document(spark: SparkSession, d: str) -> DataFrame:
    """Number of partitions, rows in each, and the keys above the threshold, as one JSON object."""
    rows = basic.hash_partitioned(D.reviews(spark, d).select("business_id"), "business_id", 27)
    return files.document(spark, n_partitions=rows.rdd.getNumPartitions(), n_items=basic.partition_sizes(rows, 27).orderBy("partition"), result=basic.group_counts(rows, "business_id", above=4))


# Ratings --------------------------------------------------------------------------------------------------------

def _ratings(spark: SparkSession, d: str) -> DataFrame:
    return basic.mean_ratings(D.raw_ratings(spark, d))


def mean_ratings(spark: SparkSession, d: str) -> DataFrame:
    return _ratings(spark, d).withColumn("stars", F.round("stars", 6))


def last_ratings(spark: SparkSession, d: str) -> DataFrame:
    return basic.last_ratings(D.raw_ratings(spark, d), ["loaded_at", "review_id", "stars"])


def _means(key: str):
    return lambda spark, d: basic.key_means(D.raw_ratings(spark, d), key).withColumn("mean", F.round("mean", 6))


def longest_history(spark: SparkSession, d: str) -> DataFrame:
    return _ratings(spark, d).groupBy("user").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"))


def known_pairs(spark: SparkSession, d: str) -> DataFrame:
    r = D.raw_ratings(spark, d)
    return basic.known(basic.known(D.test_pairs(spark, d), r.select("user").distinct(), "user"), r.select("item").distinct(), "item")


def cold_pairs(spark: SparkSession, d: str) -> DataFrame:
    return basic.cold_pairs(D.test_pairs(spark, d), D.raw_ratings(spark, d))


def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    m = basic.key_means(D.raw_ratings(spark, d), "item")
    code = F.ascii("item").cast("bigint")
    return m.select(
        "item", S.half_even(F.col("mean")).alias("even"), S.step_score(F.round("mean", 6)).alias("score"), S.step_mean(F.col("mean")).alias("fallback"),
        F.round(F.sqrt("mean"), 6).alias("root"), F.abs(F.col("mean") - 5).cast("decimal(9,3)").cast("double").alias("off"), S.universal_hash(12345, 678, code, 40009, 97).alias("hash"),
        S.local_support(F.lit(50), F.col("n"), F.lit(1000)).cast("long").alias("share"), S.pair_bucket(F.col("item"), F.lit("A"), 50, numeric=False).alias("bucket"),
    )


# Itemsets -------------------------------------------------------------------------------------------------------

def _entries(spark: SparkSession, d: str, basket: str = "user_id", item: str = "business_id", more_than: int = 0) -> DataFrame:
    return itemsets.entries(load(spark, d, "small1"), basket, item, more_than=more_than)


def _chunk():
    return (F.col("basket").cast("bigint") % CHUNKS).cast("int")


def _sorted(df: DataFrame) -> DataFrame:
    return df.withColumn("itemset", F.array_join("itemset", ","))


def baskets_by_user(spark: SparkSession, d: str) -> DataFrame:
    return itemsets.baskets(_entries(spark, d)).withColumn("items", F.array_join("items", ","))


def baskets_by_business(spark: SparkSession, d: str) -> DataFrame:
    return itemsets.baskets(_entries(spark, d, "business_id", "user_id")).withColumn("items", F.array_join("items", ","))


def baskets_active(spark: SparkSession, d: str) -> DataFrame:
    return itemsets.baskets(_entries(spark, d, more_than=10)).withColumn("items", F.array_join("items", ","))


def local_supports(spark: SparkSession, d: str) -> DataFrame:
    return itemsets.chunk_supports(_entries(spark, d), SUPPORT, _chunk())


def pair_bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    return itemsets.bucket_counts(_entries(spark, d).withColumn("chunk", _chunk()), BUCKETS, numeric=True)


def bucket_pruned_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = materialise(_entries(spark, d).withColumn("chunk", _chunk()))
    return _sorted(itemsets.pruned_pairs(rows, itemsets.chunk_supports(rows, SUPPORT, F.col("chunk")), BUCKETS, numeric=True))


def triple_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = itemsets.frequent_itemsets(_entries(spark, d), SUPPORT, max_size=2)
    return _sorted(itemsets.next_candidates(found.where(F.size("itemset") == 2), []))


def local_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _sorted(itemsets.local_candidates(_entries(spark, d), SUPPORT, _chunk()))


def frequent_itemsets(spark: SparkSession, d: str) -> DataFrame:
    return _sorted(itemsets.frequent_itemsets(_entries(spark, d), SUPPORT))


def two_phase_itemsets(spark: SparkSession, d: str) -> DataFrame:
    return _sorted(itemsets.two_phase_itemsets(_entries(spark, d), SUPPORT, _chunk()))


def itemsets_by_business(spark: SparkSession, d: str) -> DataFrame:
    return _sorted(itemsets.frequent_itemsets(_entries(spark, d, "business_id", "user_id"), SUPPORT))


def itemsets_by_length(spark: SparkSession, d: str) -> DataFrame:
    found = itemsets.frequent_itemsets(_entries(spark, d), SUPPORT)
    return itemsets.by_length(found).withColumn("itemsets", F.array_join(F.transform("itemsets", lambda x: F.array_join(x, ",")), ";"))


def association_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = materialise(_entries(spark, d))
    rules = itemsets.association_rules(materialise(itemsets.frequent_itemsets(rows, SUPPORT)), rows.select("basket").distinct().count())
    return rules.select(F.array_join("antecedent", ",").alias("antecedent"), "item", "support", F.round("confidence", 6).alias("confidence"), F.round("lift", 6).alias("lift"))


def itemset_document(spark: SparkSession, d: str) -> DataFrame:
    """Candidates and frequent itemsets by length, and the run time, as one JSON object."""
    rows = materialise(_entries(spark, d))

    def run() -> tuple[DataFrame, DataFrame]:
        candidates = materialise(itemsets.local_candidates(rows, SUPPORT, _chunk()))
        return candidates, materialise(itemsets.count_itemsets(candidates, rows, SUPPORT))

    (candidates, frequent), took = files.timed(run)
    return files.document(spark, candidates=itemsets.by_length(candidates), frequent=itemsets.by_length(frequent), runtime=took["time"])


# Similarity -----------------------------------------------------------------------------------------------------

def _pairs_of_review(spark: SparkSession, d: str) -> DataFrame:
    return D.reviews(spark, d).select("business_id", "user_id")


def overlapping_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity.overlapping_pairs(_pairs_of_review(spark, d), "business_id", "user_id", CO_RATED).select("a", "b", F.col("n_ab").cast("long").alias("n"))


def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity.jaccard_pairs(_pairs_of_review(spark, d), "business_id", "user_id").select("a", "b", F.round("sim", 6).alias("sim"))


def minhash_signatures(spark: SparkSession, d: str) -> DataFrame:
    return similarity.signatures(_pairs_of_review(spark, d), "business_id", "user_id", BANDS * ROWS).select("id", F.array_join(F.col("sig").cast("array<string>"), ",").alias("sig"))


def lsh_candidates(spark: SparkSession, d: str) -> DataFrame:
    sigs = materialise(similarity.signatures(_pairs_of_review(spark, d), "business_id", "user_id", BANDS * ROWS))
    return similarity.lsh_candidates(similarity.band_buckets(sigs, BANDS, ROWS))


def lsh_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity.lsh_pairs(_pairs_of_review(spark, d), "business_id", "user_id", bands=BANDS, rows=ROWS).select("a", "b", F.round("sim", 6).alias("sim"))


def _model(spark: SparkSession, d: str, ratings: DataFrame | None = None) -> DataFrame:
    return similarity.correlated_items(ratings if ratings is not None else materialise(_ratings(spark, d)), co_rated=CO_RATED)


def item_model(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark, d).withColumn("sim", F.round("sim", 6))


def item_model_strict(spark: SparkSession, d: str) -> DataFrame:
    """The variant of the blended recommender: more common raters, any positive correlation."""
    return similarity.correlated_items(materialise(_ratings(spark, d)), co_rated=2 * CO_RATED, above=0.0).withColumn("sim", F.round("sim", 6))


def item_model_directed(spark: SparkSession, d: str) -> DataFrame:
    """The model of the hybrid recommender: from history items to the items asked for, themselves included."""
    return similarity.directed_model(D.test_pairs(spark, d), materialise(_ratings(spark, d))).withColumn("sim", F.round("sim", 6))


# Recommendation -------------------------------------------------------------------------------------------------

def _held_out(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Ratings for training and for testing: those whose review id begins with a character of code 0 modulo 10 are held out."""
    r = D.raw_ratings(spark, d).withColumn("held", F.ascii("review_id") % 10 == 0)
    return materialise(basic.mean_ratings(r.where("not held"))), materialise(basic.mean_ratings(r.where("held")))


def neighbour_predictions(spark: SparkSession, d: str) -> DataFrame:
    r = materialise(_ratings(spark, d))
    return recommend.predict_neighbours(D.test_pairs(spark, d), r, materialise(_model(spark, d, r)), n=3).withColumn("stars", F.round("stars", 6))


def user_neighbour_predictions(spark: SparkSession, d: str) -> DataFrame:
    """The user-based form: the same operators with users and items in each other's place."""
    swap = lambda df: df.select(*(F.col(c).alias({"user": "item", "item": "user"}.get(c, c)) for c in df.columns))
    r = materialise(swap(_ratings(spark, d)))
    p = recommend.predict_neighbours(swap(D.test_pairs(spark, d)), r, materialise(_model(spark, d, r)), n=3)
    return swap(p).withColumn("stars", F.round("stars", 6))


def stored_model_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with the model table, its repeated pairs reduced to their highest similarity."""
    m = load(spark, d, "model").where("sim is not null and not isnan(sim)").select(F.btrim("b1", F.lit(" \t")).alias("x"), F.btrim("b2", F.lit(" \t")).alias("y"), "sim").where("x <> y")
    m = materialise(m.groupBy(F.least("x", "y").alias("b1"), F.greatest("x", "y").alias("b2")).agg(F.max("sim").alias("sim")))
    return recommend.predict_neighbours(D.test_pairs(spark, d), materialise(_ratings(spark, d)), m, n=3).withColumn("stars", F.round("stars", 6))


def _on_codes(pairs: DataFrame, ratings: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """As ``recommend.on_codes`` of materialised ratings, which nothing else reads."""
    out = recommend.on_codes(pairs, ratings)
    discard(ratings)
    return out


def collaborative_predictions(spark: SparkSession, d: str) -> DataFrame:
    pairs, r, ids = _on_codes(D.test_pairs(spark, d), materialise(_ratings(spark, d)))
    p = recommend.predict_collaborative(pairs, r, materialise_only(lambda: _model(spark, d, r)))
    return recommend.decoded(p, ids).withColumn("stars", F.round("stars", 6))


def rating_features(spark: SparkSession, d: str) -> DataFrame:
    return recommend.features(D.test_pairs(spark, d), *_sides(spark, d))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    u = D.users(spark, d).select(F.col("user_id").alias("user"), F.col("review_count").alias("user_count"), F.col("average_stars").alias("user_mean"))
    b = D.business(spark, d).select(F.col("business_id").alias("item"), F.col("review_count").alias("item_count"), F.col("stars").alias("item_mean"))
    return u, b


def _blended(spark: SparkSession, d: str, train: DataFrame, pairs: DataFrame) -> DataFrame:
    """Blend over ``pairs`` with the operator's defaults, 95 trees of depth 10."""
    pairs, train, ids = _on_codes(pairs, train)
    u, b = (recommend.with_codes(side, ids) for side in _sides(spark, d))
    modelled = recommend.predict_model(recommend.features(train, u, b), recommend.features(pairs, u, b))
    return recommend.decoded(recommend.blend(recommend.predict_collaborative(pairs, train, materialise_only(lambda: _model(spark, d, train))), modelled), ids)


def blended_predictions(spark: SparkSession, d: str) -> DataFrame:
    return _blended(spark, d, materialise(_ratings(spark, d)), D.test_pairs(spark, d))


def prediction_errors(spark: SparkSession, d: str) -> DataFrame:
    train, test = _held_out(spark, d)
    p = recommend.predict_neighbours(test, train, materialise(_model(spark, d, train)), n=3)
    return recommend.errors(p, test).withColumns({c: F.round(c, 4) for c in ("rmse", "rmse_extreme")})


def blended_errors(spark: SparkSession, d: str) -> DataFrame:
    train, test = _held_out(spark, d)
    return recommend.errors(_blended(spark, d, train, test.select("user", "item")), test)


# Graph ----------------------------------------------------------------------------------------------------------

def _edges(spark: SparkSession, d: str, least: int = EDGE) -> DataFrame:
    return materialise(graph.cooccurrence_edges(D.pairs(spark, d), "user_id", "business_id", least))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.cooccurrence_edges(D.pairs(spark, d), "user_id", "business_id", EDGE)


def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return basic.degrees(graph_edges(spark, d))


def graph_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.connected_components(_edges(spark, d))


def graph_labels(spark: SparkSession, d: str) -> DataFrame:
    return graph.label_propagation(_edges(spark, d), 5)


def graph_communities(spark: SparkSession, d: str) -> DataFrame:
    return graph.communities(graph_labels(spark, d)).withColumn("members", F.array_join("members", ","))


def graph_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.shortest_paths(_edges(spark, d, 7))


def graph_betweenness(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_betweenness(_edges(spark, d, 7)).withColumn("score", F.round("score", 4))


def graph_modularity(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return graph.modularity(graph.connected_components(e), e).withColumn("q", F.round("q", 8))


def graph_divided(spark: SparkSession, d: str) -> DataFrame:
    """The partition of best modularity over all rounds of divisive communities."""
    return graph.divide(_edges(spark, d, 7))[0]


def graph_lines(spark: SparkSession, d: str) -> DataFrame:
    return files.community_lines(graph.communities(graph.connected_components(_edges(spark, d)), "component"))


def graph_edge_lines(spark: SparkSession, d: str) -> DataFrame:
    return files.edge_lines(graph.edge_betweenness(_edges(spark, d, 7)).withColumn("score", F.round("score", 4)))


# Clustering -----------------------------------------------------------------------------------------------------

def _centres(p: DataFrame, k: int = 10) -> list[list[float]]:
    return [list(r.features) for r in p.orderBy("id").limit(k).collect()]


def point_assignment(spark: SparkSession, d: str) -> DataFrame:
    p = D.points(spark, d)
    return cluster.assign(p, _centres(p)).select("id", "cluster", F.round("distance", 6).alias("distance"))


def kmeans_step(spark: SparkSession, d: str) -> DataFrame:
    p = D.points(spark, d)
    s = cluster.summaries(cluster.assign(p, _centres(p)))
    return s.select("cluster", "n", F.posexplode(cluster.centre(F.col("n"), F.col("s"))).alias("dim", "x")).withColumn("x", F.round("x", 6))


def cluster_summaries(spark: SparkSession, d: str) -> DataFrame:
    s = cluster.summaries(D.points(spark, d), "label")
    v = F.arrays_zip("s", "ss", cluster.variance(F.col("n"), F.col("s"), F.col("ss")).alias("v"))
    rows = s.select("cluster", "n", F.posexplode(v).alias("dim", "c"))
    return rows.select("cluster", "n", "dim", F.round("c.s", 4).alias("s"), F.round("c.ss", 4).alias("ss"), F.round("c.v", 6).alias("v"))


def merged_summaries(spark: SparkSession, d: str) -> DataFrame:
    p = D.points(spark, d)
    by_chunk = cluster.summaries(p.where("chunk = 0"), "label")
    for c in range(1, 5):
        by_chunk = by_chunk.unionByName(cluster.summaries(p.where(f"chunk = {c}"), "label"))
    return cluster.merge_summaries(by_chunk).select("cluster", "n", F.posexplode("s").alias("dim", "s")).withColumn("s", F.round("s", 4))


def near_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Points within 2 sqrt(d) standard deviations of their label's nearest frozen summary."""
    p = D.points(spark, d)
    sets = [cluster.Summary(r.cluster, r.n, list(r.s), list(r.ss)) for r in sorted(cluster.summaries(p.where("chunk = 0"), "label").collect(), key=lambda r: r.cluster)]
    return cluster.assign_summaries(p, sets).select("id", "key")


def first_centres(spark: SparkSession, d: str) -> DataFrame:
    c = cluster.farthest_first(D.points(spark, d), 10)
    return spark.createDataFrame([(i, j, x) for i, row in enumerate(c) for j, x in enumerate(row)], "centre int, dim int, x double").withColumn("x", F.round("x", 6))


def kmeans(spark: SparkSession, d: str) -> DataFrame:
    return cluster.kmeans(D.points(spark, d), 10)[0].select("id", "cluster")


def size_split(spark: SparkSession, d: str) -> DataFrame:
    big, rest = cluster.split_by_size(D.points(spark, d).withColumn("cluster", F.col("label") * 2 + F.col("chunk") % 2), 25)
    return big.select("id", F.lit("inner").alias("part")).unionAll(rest.select("id", F.lit("outer").alias("part")))


def chunk_labels(spark: SparkSession, d: str) -> DataFrame:
    return cluster.cluster_chunks(D.points(spark, d)).labels()


def chunk_rounds(spark: SparkSession, d: str) -> DataFrame:
    return cluster.cluster_chunks(D.points(spark, d)).rounds(spark)


def chunk_label_lines(spark: SparkSession, d: str) -> DataFrame:
    return files.point_map(chunk_labels(spark, d))


def chunk_label_map(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the one JSON map from points to clusters."""
    return files.point_map_lines(chunk_labels(spark, d))


def chunk_rounds_csv(spark: SparkSession, d: str) -> DataFrame:
    """Statistics appended to CSV files round by round, read back."""
    path = _folder(spark, "rounds")
    cluster.cluster_chunks(D.points(spark, d), rounds_path=path)
    return files.read_csv(spark, path, cluster.ROUNDS)


def chunk_stream(spark: SparkSession, d: str) -> DataFrame:
    """Round statistics of the chunks as a stream of files, written one after another."""
    from siftmill.streaming.chunks import cluster_stream

    path = _folder(spark, "stream")
    for c in range(5):
        _write_points(D.points(spark, d).where(f"chunk = {c}").coalesce(1), path, "append")
    return cluster_stream(spark, path, _folder(spark, "state")).rounds(spark)


# Sources and sinks ----------------------------------------------------------------------------------------------

def _folder(spark: SparkSession, name: str) -> str:
    return folder(spark, name)


def _write_points(points: DataFrame, path: str, mode: str = "overwrite") -> None:
    points.select(F.concat_ws(",", F.col("id").cast("string"), F.col("features").cast("array<string>")).alias("value")).write.mode(mode).text(path)


def source_json(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "review")
    files.write_json_lines(load(spark, d, "review").select("user_id", "business_id", "stars"), path)
    return files.read_json_lines(spark, path, "ratings").groupBy("business_id").agg(F.count(F.lit(1)).alias("n"), F.sum("stars").alias("stars"))


def source_csv(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "pairs")
    files.write_csv(D.pairs(spark, d), path)
    return files.read_pairs(spark, path)


def source_model(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "model")
    files.write_json_lines(load(spark, d, "model").where("not isnan(sim)"), path)
    return files.read_json_lines(spark, path, "model").groupBy("b1").agg(F.count(F.lit(1)).alias("n"), F.max("sim").alias("best"))


def source_points(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "points")
    _write_points(D.points(spark, d), path)
    back = files.read_points(spark, path)
    return back.select(F.col("id").cast("long").alias("id"), F.size("features").alias("d"), F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def source_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A folder of chunk files in the order of their names: points and ids of each chunk."""
    path, names = _folder(spark, "chunks"), {}
    _write_points(D.points(spark, d).repartition(3, "id"), path)
    for r in files.read_points(spark, path).select("file").distinct().orderBy("file").collect():
        names[r.file] = len(names)
    back = files.read_chunks(spark, path)
    right = files.read_points(spark, path).select("id", F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.col("file")).alias("place"))
    return back.join(right, "id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chunk").alias("n_chunks"), F.count_if(F.col("chunk") != F.col("place")).alias("n_wrong"))


def source_words(spark: SparkSession, d: str) -> DataFrame:
    """A list of stop words from a file, one per line, and the reviews' words without them."""
    path = _folder(spark, "words")
    files.write_lines(spark.createDataFrame([(w,) for w in S.STOP_WORDS], "value string"), path)
    return basic.top_words(D.reviews(spark, d), "text", 20, files.read_words(spark, path))


def source_run_time(spark: SparkSession, d: str) -> DataFrame:
    """The run-time file of a count: its key, and whether the time is one."""
    path = _folder(spark, "time")
    _, took = files.timed(lambda: D.reviews(spark, d).count())
    files.write_run_time(spark, path, took)
    return files.read_json_lines(spark, path, "time double").select(F.lit("time").alias("name"), (F.col("time") > 0).alias("positive"))


def queries() -> dict:
    count = lambda f: lambda spark, d: f(D.reviews(spark, d))
    return {
        "total_reviews": count(basic.row_count),
        "year_reviews": count(lambda r: basic.year_count(r, "date", YEAR)),
        "distinct_users": count(lambda r: basic.distinct_count(r, "user_id")),
        "top_users": top_users,
        "word_counts": count(lambda r: basic.word_counts(r, "text")),
        "top_words": count(lambda r: basic.top_words(r, "text", 10)),
        "facts_document": facts_document,
        "category_means": lambda spark, d: category_means(spark, d).withColumn("mean", F.round("mean", 6)),
        "category_top": category_top,
        "category_document": category_document,
        "business_counts": count(lambda r: basic.group_counts(r, "business_id", above=4)),
        "partition_buckets": partition_buckets,
        "partition_hash_sizes": partition_hash_sizes,
        "partition_random_counts": partition_random_counts,
        "partition_document": partition_document,
        "mean_ratings": mean_ratings,
        "last_ratings": last_ratings,
        "user_means": _means("user"),
        "item_means": _means("item"),
        "longest_history": longest_history,
        "known_pairs": known_pairs,
        "cold_pairs": cold_pairs,
        "scalar_functions": scalar_functions,
        "baskets_by_user": baskets_by_user,
        "baskets_by_business": baskets_by_business,
        "baskets_active": baskets_active,
        "local_supports": local_supports,
        "pair_bucket_counts": pair_bucket_counts,
        "bucket_pruned_pairs": bucket_pruned_pairs,
        "triple_candidates": triple_candidates,
        "local_candidates": local_candidates,
        "frequent_itemsets": frequent_itemsets,
        "two_phase_itemsets": two_phase_itemsets,
        "itemsets_by_business": itemsets_by_business,
        "itemsets_by_length": itemsets_by_length,
        "association_rules": association_rules,
        "itemset_document": itemset_document,
        "overlapping_pairs": overlapping_pairs,
        "jaccard_pairs": jaccard_pairs,
        "minhash_signatures": minhash_signatures,
        "lsh_candidates": lsh_candidates,
        "lsh_pairs": lsh_pairs,
        "item_model": item_model,
        "item_model_strict": item_model_strict,
        "item_model_directed": item_model_directed,
        "neighbour_predictions": neighbour_predictions,
        "user_neighbour_predictions": user_neighbour_predictions,
        "stored_model_predictions": stored_model_predictions,
        "collaborative_predictions": collaborative_predictions,
        "rating_features": rating_features,
        "blended_predictions": blended_predictions,
        "prediction_errors": prediction_errors,
        "blended_errors": blended_errors,
        "graph_edges": graph_edges,
        "graph_degrees": graph_degrees,
        "graph_components": graph_components,
        "graph_labels": graph_labels,
        "graph_communities": graph_communities,
        "graph_paths": graph_paths,
        "graph_betweenness": graph_betweenness,
        "graph_modularity": graph_modularity,
        "graph_divided": graph_divided,
        "graph_lines": graph_lines,
        "graph_edge_lines": graph_edge_lines,
        "point_assignment": point_assignment,
        "kmeans_step": kmeans_step,
        "cluster_summaries": cluster_summaries,
        "merged_summaries": merged_summaries,
        "near_summaries": near_summaries,
        "first_centres": first_centres,
        "kmeans": kmeans,
        "size_split": size_split,
        "chunk_labels": chunk_labels,
        "chunk_rounds": chunk_rounds,
        "chunk_label_lines": chunk_label_lines,
        "chunk_label_map": chunk_label_map,
        "chunk_rounds_csv": chunk_rounds_csv,
        "chunk_stream": chunk_stream,
        "source_json": source_json,
        "source_csv": source_csv,
        "source_model": source_model,
        "source_points": source_points,
        "source_chunks": source_chunks,
        "source_words": source_words,
        "source_run_time": source_run_time,
    }


def oracle_sql() -> dict[str, str]:
    from siftmill.plans.mining_sql import statements

    return statements()
