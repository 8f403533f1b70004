"""ANSI SQL (DuckDB) for the mining queries: the same rows by another way."""

from __future__ import annotations

from siftmill.functions.scalars import STOP_WORDS, STRIPPED
from siftmill.operators.similarity import PRIME, hash_family
from siftmill.plans.mining import BANDS, BUCKETS, CHUNKS, CO_RATED, EDGE, ROWS, SUPPORT, YEAR

BLANKS = "' ' || chr(9)"
REVIEW = f"(SELECT trim(review_id, {BLANKS}) AS review_id, trim(user_id, {BLANKS}) AS user_id, trim(business_id, {BLANKS}) AS business_id, stars, date, text, loaded_at FROM review)"
RAW = f"(SELECT user_id AS \"user\", business_id AS item, stars, review_id, loaded_at FROM {REVIEW} WHERE user_id IS NOT NULL AND business_id IS NOT NULL AND stars IS NOT NULL)"
RATINGS = f'(SELECT "user", item, avg(stars) AS stars FROM {RAW} GROUP BY 1, 2)'
BUSINESS = f"""(SELECT * FROM (SELECT trim(business_id, {BLANKS}) AS business_id, categories, review_count, stars,
  row_number() OVER (PARTITION BY trim(business_id, {BLANKS}) ORDER BY loaded_at DESC NULLS LAST, categories DESC NULLS LAST, review_count DESC NULLS LAST, stars DESC NULLS LAST) AS r
  FROM business WHERE business_id IS NOT NULL) WHERE r = 1)"""
USERS = f"""(SELECT * FROM (SELECT trim(user_id, {BLANKS}) AS user_id, review_count, average_stars,
  row_number() OVER (PARTITION BY trim(user_id, {BLANKS}) ORDER BY loaded_at DESC NULLS LAST, review_count DESC NULLS LAST, average_stars DESC NULLS LAST) AS r
  FROM user_profile WHERE user_id IS NOT NULL) WHERE r = 1)"""
TEST = f"""(SELECT DISTINCT trim(user_id, {BLANKS}) AS "user", trim(business_id, {BLANKS}) AS item FROM test_review WHERE trim(user_id, {BLANKS}) <> '' AND trim(business_id, {BLANKS}) <> '')"""
UB = f"(SELECT DISTINCT trim(user_id, {BLANKS}) AS u, trim(business_id, {BLANKS}) AS b FROM small1 WHERE user_id IS NOT NULL AND business_id IS NOT NULL)"
POINTS = "(SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS f, label, CAST(vec_id % 5 AS INT) AS chunk FROM embeddings)"


def _quoted(s: str) -> str:
    return " || ".join(["''", *(f"chr({ord(c)})" for c in s)])


WORDS = f"""(SELECT word, count(*) AS n FROM (SELECT trim(unnest(string_split(lower(text), ' ')), {_quoted(STRIPPED)}) AS word FROM review)
WHERE word <> '' AND word NOT IN ({', '.join("'" + w + "'" for w in STOP_WORDS)}) AND position('''' IN word) = 0 GROUP BY 1)"""

MEANS = f"""(SELECT category, sum(s) / sum(c) AS mean, CAST(sum(c) AS BIGINT) AS n FROM
  (SELECT business_id, regexp_replace(unnest(string_split(categories, ',')), '^\\s+|\\s+$', '', 'g') AS category FROM {BUSINESS} WHERE categories <> '') JOIN
  (SELECT business_id, sum(stars) AS s, count(stars) AS c FROM {REVIEW} GROUP BY 1) USING (business_id) GROUP BY 1 HAVING sum(c) > 0)"""

# Itemsets: baskets e(basket, item); levels unrolled; up to sf0.1 there is none beyond the seventh.
def _levels(entries: str, support: str, keys: str = "", top: int = 9, limits: str = "") -> str:
    """Frequent itemsets by plain counting of all sets of up to ``top`` frequent items; ``limits`` are supports by key."""
    k = f"{keys}, " if keys else ""
    with_limit = f" JOIN limits USING ({keys})" if limits else ""
    first = f"limits AS MATERIALIZED ({limits}), " if limits else ""
    out = f"WITH RECURSIVE {first}e AS MATERIALIZED ({entries}), f AS (SELECT {k}item FROM e{with_limit} GROUP BY {k}item HAVING count(*) >= {support}), g AS MATERIALIZED (SELECT e.* FROM e SEMI JOIN f USING ({k}item)), l1 AS (SELECT {k}basket, [item] AS s, item AS z FROM g)"
    for n in range(2, top + 1):
        x = ", ".join(f"x.{c.strip()}" for c in keys.split(",")) + ", " if keys else ""
        out += f", a{n} AS MATERIALIZED (SELECT {x}x.basket, list_append(x.s, y.item) AS s, y.item AS z FROM l{n - 1} x JOIN g y ON x.basket = y.basket AND y.item > x.z)"
        out += f", c{n} AS (SELECT {k}s FROM a{n}{with_limit} GROUP BY {k}s HAVING count(*) >= {support}), l{n} AS MATERIALIZED (SELECT a{n}.* FROM a{n} SEMI JOIN c{n} USING ({k}s))"
    return out + " " + " UNION ALL ".join(f"SELECT {k}array_to_string(s, ',') AS itemset, len(s) AS k, count(*) AS support FROM l{n} GROUP BY {k}s" for n in range(1, top + 1))


ENTRIES = f"SELECT u AS basket, b AS item FROM {UB}"
CHUNKED = f"SELECT u AS basket, b AS item, CAST(CAST(u AS BIGINT) % {CHUNKS} AS INT) AS chunk FROM {UB}"
SUPPORTS = "(SELECT chunk, n_baskets, CAST(ceil(CAST({s} AS DOUBLE) * n_baskets / sum(n_baskets) OVER ()) AS BIGINT) AS local_support FROM (SELECT chunk, count(DISTINCT basket) AS n_baskets FROM ({e}) GROUP BY 1))"
BUCKETED = f"SELECT x.chunk, x.item, y.item AS other, (CAST(x.item AS BIGINT) + CAST(y.item AS BIGINT)) % {BUCKETS} AS bucket FROM ({{e}}) x JOIN ({{e}}) y ON x.basket = y.basket AND x.item < y.item"

# Similarity.
SETS = f"SELECT DISTINCT business_id AS id, user_id AS t FROM {REVIEW} WHERE business_id IS NOT NULL AND user_id IS NOT NULL"
OVERLAP = "SELECT x.id AS a, y.id AS b, count(*) AS n FROM e x JOIN e y ON x.t = y.t AND x.id < y.id GROUP BY 1, 2"
ALL = f"e AS MATERIALIZED ({SETS}), n AS (SELECT id, count(*) AS n FROM e GROUP BY 1)"
HASHES = ", ".join(f"({h}, {a}, {b})" for h, (a, b) in enumerate(hash_family(BANDS * ROWS)))
SIGS = f"""i AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS x FROM (SELECT DISTINCT t FROM ({SETS}))), h(h, a, b) AS (VALUES {HASHES}),
  m AS MATERIALIZED (SELECT id, h, min((a * x + b) % {PRIME}) AS v FROM e JOIN i USING (t), h GROUP BY 1, 2)"""
MET = f"k AS (SELECT id, h // {ROWS} AS band, list(v ORDER BY h) AS bucket FROM m GROUP BY 1, 2), c AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y ON x.band = y.band AND x.bucket = y.bucket AND x.id < y.id)"


def _model(ratings: str, co_rated: int, above: str) -> str:
    return f"""SELECT b1, b2, n, CASE WHEN vx > 1e-9 AND vy > 1e-9 THEN round((sxy - sx * sy / n) / sqrt(vx * vy), 9) ELSE 0 END AS sim FROM (
  SELECT *, sxx - sx * sx / n AS vx, syy - sy * sy / n AS vy FROM (SELECT x.item AS b1, y.item AS b2, count(*) AS n, sum(x.stars) AS sx, sum(y.stars) AS sy,
    sum(x.stars * y.stars) AS sxy, sum(x.stars * x.stars) AS sxx, sum(y.stars * y.stars) AS syy
    FROM {ratings} x JOIN {ratings} y ON x."user" = y."user" AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= {co_rated})) WHERE CASE WHEN vx > 1e-9 AND vy > 1e-9 THEN round((sxy - sx * sy / n) / sqrt(vx * vy), 9) ELSE 0 END > {above}"""


STORED = f"""SELECT least(x, y) AS b1, greatest(x, y) AS b2, max(sim) AS sim FROM (SELECT trim(b1, {BLANKS}) AS x, trim(b2, {BLANKS}) AS y, sim FROM model WHERE sim IS NOT NULL AND NOT isnan(sim)) WHERE x <> y GROUP BY 1, 2"""
STEP_MEAN = "CASE WHEN im > 4 THEN 5.0 WHEN im < 3 THEN 2.0 ELSE round_even(im, 0) END"


def _neighbours(test: str, ratings: str, model: str, n: int) -> str:
    return f"""r AS (SELECT * FROM {ratings}), t AS (SELECT "user", item FROM {test}), m AS ({model}), d AS (SELECT b1 AS item, b2 AS nb, sim FROM m UNION ALL SELECT b2, b1, sim FROM m),
  c AS (SELECT t."user", t.item, r.stars, d.sim, row_number() OVER (PARTITION BY t."user", t.item ORDER BY d.sim DESC, d.nb) AS k FROM t JOIN d USING (item) JOIN r ON r."user" = t."user" AND r.item = d.nb),
  s AS (SELECT "user", item, sum(stars * sim) AS num, sum(abs(sim)) AS den FROM c WHERE k <= {n} GROUP BY 1, 2),
  u AS (SELECT "user", avg(stars) AS um, count(*) AS h FROM r GROUP BY 1), i AS (SELECT item, avg(stars) AS im FROM r GROUP BY 1)"""


def _predicted(test: str, ratings: str, model: str) -> str:
    return f"""WITH {_neighbours(test, ratings, model, 3)} SELECT "user", item, CASE WHEN num <> 0 AND den <> 0 THEN num / den WHEN im IS NOT NULL THEN {STEP_MEAN} ELSE coalesce(um, 2.5) END AS stars,
  CASE WHEN num <> 0 AND den <> 0 THEN 'neighbours' WHEN im IS NOT NULL THEN 'item' WHEN um IS NOT NULL THEN 'user' ELSE 'unknown' END AS rule
  FROM t LEFT JOIN s USING ("user", item) LEFT JOIN u USING ("user") LEFT JOIN i USING (item)"""


HELD = f'(SELECT "user", item, avg(stars) AS stars FROM {RAW} WHERE ascii(review_id) % 10 = 0 GROUP BY 1, 2)'
TRAIN = f'(SELECT "user", item, avg(stars) AS stars FROM {RAW} WHERE ascii(review_id) % 10 <> 0 GROUP BY 1, 2)'


# Graph.
def _edges(least: int) -> str:
    return f"SELECT x.u AS a, y.u AS b, count(*) AS shared FROM {UB} x JOIN {UB} y ON x.b = y.b AND x.u < y.u GROUP BY 1, 2 HAVING count(*) >= {least}"


def _graph(least: int) -> str:
    return f"g AS MATERIALIZED ({_edges(least)}), l AS MATERIALIZED (SELECT a AS src, b AS dst FROM g UNION ALL SELECT b, a FROM g), v AS (SELECT DISTINCT src AS id FROM l)"


REACH = "reach AS (SELECT id, id AS o FROM v UNION SELECT r.id, l.dst FROM reach r JOIN l ON l.src = r.o), comp AS (SELECT id, min(o) AS component FROM reach GROUP BY 1)"
ROUND = "n{k} AS (SELECT id, label FROM (SELECT dst AS id, label, row_number() OVER (PARTITION BY dst ORDER BY count(*) DESC, label) AS r FROM l JOIN n{j} ON n{j}.id = src GROUP BY 1, 2) WHERE r = 1)"
LABELS = f"WITH {_graph(EDGE)}, n0 AS (SELECT id, id AS label FROM v), " + ", ".join(ROUND.format(k=k, j=k - 1) for k in range(1, 6))
PATHS = f"""WITH RECURSIVE {_graph(7)}, walk AS (SELECT id AS root, id AS node, 0 AS level FROM v UNION SELECT root, dst, level + 1 FROM walk JOIN l ON src = node WHERE level < 12),
  dist AS MATERIALIZED (SELECT root, node, min(level) AS level FROM walk GROUP BY 1, 2),
  path AS (SELECT id AS root, id AS node, 0 AS level FROM v UNION ALL SELECT p.root, l.dst, p.level + 1 FROM path p JOIN l ON l.src = p.node JOIN dist d ON d.root = p.root AND d.node = l.dst AND d.level = p.level + 1),
  q AS MATERIALIZED (SELECT root, node, level, CAST(count(*) AS DOUBLE) AS sigma FROM path GROUP BY 1, 2, 3)"""
CENTRES = f"(SELECT row_number() OVER (ORDER BY id) - 1 AS i, f AS c FROM (SELECT id, f FROM {POINTS} ORDER BY id LIMIT 10))"
ASSIGNED = f"(SELECT id, f, d, i FROM (SELECT id, f, list_distance(f, c) AS d, i, row_number() OVER (PARTITION BY id ORDER BY list_distance(f, c), i) AS r FROM {POINTS}, {CENTRES}) WHERE r = 1)"
CELLS = f"(SELECT label, chunk, id, unnest(f) AS x, CAST(generate_subscripts(f, 1) - 1 AS INT) AS dim FROM {POINTS})"


SWAPPED = lambda t: f'(SELECT item AS "user", "user" AS item FROM {t})'
SWAPPED_RATINGS = f'(SELECT item AS "user", "user" AS item, stars FROM {RATINGS})'
RULES = f"""WITH a AS MATERIALIZED ({_levels(ENTRIES, str(SUPPORT))}), n AS (SELECT count(DISTINCT u) AS n FROM {UB}),
  r AS (SELECT array_to_string(list_filter(string_split(itemset, ','), lambda z: z <> item), ',') AS antecedent, item, support FROM (SELECT itemset, support, unnest(string_split(itemset, ',')) AS item FROM a WHERE k > 1))
  SELECT antecedent, r.item, r.support, round(r.support / x.support, 6) AS confidence, round(r.support / x.support * n.n / y.support, 6) AS lift
  FROM r JOIN a x ON x.itemset = r.antecedent JOIN a y ON y.itemset = r.item, n"""
DIRECTED = f"""WITH r AS MATERIALIZED (SELECT * FROM {RATINGS}), c AS (SELECT DISTINCT r.item AS nb, t.item FROM {TEST} t JOIN r USING ("user")),
  s AS (SELECT c.nb, c.item, count(*) AS n, sum(x.stars) AS sx, sum(y.stars) AS sy, sum(x.stars * y.stars) AS sxy, sum(x.stars * x.stars) AS sxx, sum(y.stars * y.stars) AS syy
    FROM (SELECT nb, item FROM c SEMI JOIN (SELECT item FROM r GROUP BY 1 HAVING count(*) >= 175) b ON b.item = c.nb) c JOIN r x ON x.item = c.nb JOIN r y ON y.item = c.item AND y."user" = x."user" GROUP BY 1, 2 HAVING count(*) >= 175)
  SELECT nb, item, n, round((sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)), 6) AS sim FROM s
  WHERE sxx - sx * sx / n > 1e-9 AND syy - sy * sy / n > 1e-9 AND (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) > 0"""


# k-means from farthest-first centres, k = 10. The rounds are unrolled; after the fixpoint they change nothing.
def _farthest_sql(k: int = 10) -> str:
    out = f"p AS MATERIALIZED (SELECT id, f FROM {POINTS}), c0 AS MATERIALIZED (SELECT 0 AS i, f AS c FROM p ORDER BY id LIMIT 1), d0 AS MATERIALIZED (SELECT id, p.f, list_distance(p.f, c) AS d FROM p, c0)"
    for i in range(1, k):
        out += f", c{i} AS MATERIALIZED (SELECT {i} AS i, f AS c FROM d{i - 1} ORDER BY d DESC, id LIMIT 1), d{i} AS MATERIALIZED (SELECT id, x.f, least(d, list_distance(x.f, c)) AS d FROM d{i - 1} x, c{i})"
    return out + ", k0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT i, c FROM c{i}" for i in range(k)) + ")"


def _lloyd_sql(rounds: int) -> str:
    out = _farthest_sql()
    for r in range(1, rounds + 1):
        out += f""", a{r} AS MATERIALIZED (SELECT f, i FROM (SELECT f, i, row_number() OVER (PARTITION BY id ORDER BY list_distance(f, c), i) AS r FROM p, k{r - 1}) WHERE r = 1),
  m{r} AS (SELECT i, list(x ORDER BY dim) AS c FROM (SELECT i, dim, avg(x) AS x FROM (SELECT i, unnest(f) AS x, generate_subscripts(f, 1) AS dim FROM a{r}) GROUP BY 1, 2) GROUP BY 1),
  k{r} AS MATERIALIZED (SELECT i, coalesce(m{r}.c, k{r - 1}.c) AS c FROM k{r - 1} LEFT JOIN m{r} USING (i))"""
    return out


def statements() -> dict[str, str]:
    mean = lambda key: f'SELECT "{key}", round(avg(stars), 6) AS mean, count(*) AS n FROM {RAW} GROUP BY 1'
    items = lambda more="": f"SELECT u AS basket, string_agg(b, ',' ORDER BY b) AS items FROM {UB} GROUP BY 1{more}"
    joined = lambda t: f"SELECT itemset, support FROM ({t})"
    return {
        "total_reviews": "SELECT count(*) AS n FROM review",
        "year_reviews": f"SELECT count(*) AS n FROM review WHERE substr(date, 1, 4) = '{YEAR}'",
        "distinct_users": f"SELECT count(DISTINCT user_id) AS n FROM {REVIEW}",
        "top_users": f"SELECT user_id, count(*) AS n FROM {REVIEW} WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10",
        "word_counts": f"SELECT * FROM {WORDS}",
        "top_words": f"SELECT * FROM {WORDS} ORDER BY n DESC, word LIMIT 10",
        "category_means": f"SELECT category, round(mean, 6) AS mean, n FROM {MEANS}",
        "category_top": f"SELECT category, round(mean, 6) AS mean FROM {MEANS} ORDER BY mean DESC, category LIMIT 10",
        "category_document": f"""SELECT '{{"result":[' || string_agg('[' || to_json(category) || ',' || mean || ']', ',' ORDER BY mean DESC, category) || ']}}' AS value
  FROM (SELECT category, round(mean, 6) AS mean FROM {MEANS} ORDER BY mean DESC, category LIMIT 10)""",
        "facts_document": f"""SELECT '{{"reviews":[{{"n":' || (SELECT count(*) FROM review) || '}}],"in_year":[{{"n":' || (SELECT count(*) FROM review WHERE substr(date, 1, 4) = '{YEAR}') || '}}],"users":[{{"n":' || (SELECT count(DISTINCT user_id) FROM {REVIEW})
  || '}}],"top_users":[' || (SELECT string_agg('{{"user_id":' || to_json(user_id) || ',"n":' || n || '}}', ',' ORDER BY n DESC, user_id) FROM (SELECT user_id, count(*) AS n FROM {REVIEW} WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10))
  || '],"top_words":[' || (SELECT string_agg('{{"word":' || to_json(word) || ',"n":' || n || '}}', ',' ORDER BY n DESC, word) FROM (SELECT * FROM {WORDS} ORDER BY n DESC, word LIMIT 10)) || ']}}' AS value""",
        "source_words": f"SELECT * FROM {WORDS} ORDER BY n DESC, word LIMIT 20",
        "source_run_time": "SELECT 'time' AS name, true AS positive",
        "source_chunks": f"SELECT count(*) AS n, CAST(3 AS BIGINT) AS n_chunks, CAST(0 AS BIGINT) AS n_wrong FROM {POINTS}",
        "item_model_directed": DIRECTED,
        "first_centres": f"WITH {_farthest_sql()} SELECT CAST(i AS INT) AS centre, CAST(dim AS INT) AS dim, round(x, 6) AS x FROM (SELECT i, unnest(c) AS x, generate_subscripts(c, 1) - 1 AS dim FROM k0)",
        "kmeans": f"WITH {_lloyd_sql(60)} SELECT id, CAST(i AS INT) AS cluster FROM (SELECT id, i, row_number() OVER (PARTITION BY id ORDER BY list_distance(f, c), i) AS r FROM p, k60) WHERE r = 1",
        "graph_edge_lines": PATHS + """, b AS (SELECT g.a, g.b, round(sum(s.sigma * t.sigma / w.sigma) / 2, 4) AS score FROM l JOIN g ON g.a = least(l.src, l.dst) AND g.b = greatest(l.src, l.dst)
  JOIN q s ON s.node = l.src JOIN q t ON t.root = l.dst JOIN q w ON w.root = s.root AND w.node = t.node AND w.level = s.level + 1 + t.level GROUP BY 1, 2) SELECT '(' || chr(39) || a || chr(39) || ', ' || chr(39) || b || chr(39) || '), ' || score AS value FROM b""",
        "business_counts": f"SELECT business_id, count(*) AS n FROM {REVIEW} WHERE business_id IS NOT NULL GROUP BY 1 HAVING count(*) > 4",
        "partition_random_counts": f"SELECT business_id, count(*) AS n FROM {REVIEW} WHERE business_id IS NOT NULL GROUP BY 1 HAVING count(*) > 4",
        "partition_buckets": "SELECT CAST(p AS INT) AS partition, count(doc_id) AS n FROM range(27) t(p) LEFT JOIN documents ON doc_id % 27 = p GROUP BY 1",
        "mean_ratings": f'SELECT "user", item, round(stars, 6) AS stars FROM {RATINGS}',
        "last_ratings": f'SELECT "user", item, stars FROM (SELECT *, row_number() OVER (PARTITION BY "user", item ORDER BY loaded_at DESC, review_id DESC, stars DESC) AS r FROM {RAW}) WHERE r = 1',
        "user_means": mean("user"),
        "item_means": mean("item"),
        "longest_history": f'SELECT max(n) AS n FROM (SELECT count(*) AS n FROM {RATINGS} GROUP BY "user")',
        "known_pairs": f'SELECT "user", item FROM {TEST} WHERE "user" IN (SELECT "user" FROM {RAW}) AND item IN (SELECT item FROM {RAW})',
        "cold_pairs": f'SELECT * FROM (SELECT "user", item, "user" IN (SELECT "user" FROM {RAW}) AS user_known, item IN (SELECT item FROM {RAW}) AS item_known FROM {TEST}) WHERE NOT (user_known AND item_known)',
        "scalar_functions": f"""SELECT item, round_even(m, 0) AS even, CASE WHEN round(m, 6) > 4.5 THEN 5.0 WHEN round(m, 6) < 2.5 THEN 2.0 ELSE round(m, 6) END AS score,
  CASE WHEN m > 4 THEN 5.0 WHEN m < 3 THEN 2.0 ELSE round_even(m, 0) END AS fallback, round(sqrt(m), 6) AS root, CAST(CAST(abs(m - 5) AS DECIMAL(9, 3)) AS DOUBLE) AS "off",
  ((12345 * CAST(ascii(item) AS BIGINT) + 678) % 40009) % 97 AS hash, CAST(ceil(50.0 * n / 1000) AS BIGINT) AS share, CAST((ascii(item) + 65) % 50 AS BIGINT) AS bucket
  FROM (SELECT item, avg(stars) AS m, count(*) AS n FROM {RAW} GROUP BY 1)""",
        "baskets_by_user": items(),
        "baskets_by_business": f"SELECT b AS basket, string_agg(u, ',' ORDER BY u) AS items FROM {UB} GROUP BY 1",
        "baskets_active": items(" HAVING count(*) > 10"),
        "local_supports": f"SELECT * FROM {SUPPORTS.format(s=SUPPORT, e=CHUNKED)}",
        "pair_bucket_counts": f"SELECT chunk, bucket, count(*) AS n FROM ({BUCKETED.format(e=CHUNKED)}) GROUP BY 1, 2",
        "bucket_pruned_pairs": f"""SELECT chunk, item || ',' || other AS itemset, count(*) AS support FROM ({BUCKETED.format(e=CHUNKED)}) JOIN {SUPPORTS.format(s=SUPPORT, e=CHUNKED)} USING (chunk)
  GROUP BY chunk, item, other, local_support HAVING count(*) >= local_support""",
        "triple_candidates": f"""WITH e AS ({ENTRIES}), p AS (SELECT x.item AS a, y.item AS b FROM e x JOIN e y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= {SUPPORT})
  SELECT x.a || ',' || x.b || ',' || y.b AS itemset FROM p x JOIN p y ON x.a = y.a AND x.b < y.b SEMI JOIN p z ON z.a = x.b AND z.b = y.b""",
        "local_candidates": f"SELECT DISTINCT itemset FROM ({_levels(CHUNKED, 'any_value(local_support)', 'chunk', 18, f'SELECT chunk, local_support FROM {SUPPORTS.format(s=SUPPORT, e=CHUNKED)}')})",
        "frequent_itemsets": joined(_levels(ENTRIES, str(SUPPORT))),
        "two_phase_itemsets": joined(_levels(ENTRIES, str(SUPPORT))),
        "itemsets_by_business": joined(_levels(f"SELECT b AS basket, u AS item FROM {UB}", str(SUPPORT))),
        "itemsets_by_length": f"SELECT CAST(k AS INT) AS k, count(*) AS n, string_agg(itemset, ';' ORDER BY string_split(itemset, ',')) AS itemsets FROM ({_levels(ENTRIES, str(SUPPORT))}) GROUP BY 1",
        "association_rules": RULES,
        "overlapping_pairs": f"WITH e AS ({SETS}) SELECT * FROM ({OVERLAP}) WHERE n >= {CO_RATED}",
        "jaccard_pairs": f"WITH {ALL} SELECT a, b, round(o.n / (x.n + y.n - o.n), 6) AS sim FROM ({OVERLAP}) o JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE o.n * 11 >= x.n + y.n",
        "minhash_signatures": f"WITH {ALL}, {SIGS} SELECT id, string_agg(v, ',' ORDER BY h) AS sig FROM m GROUP BY 1",
        "lsh_candidates": f"WITH {ALL}, {SIGS}, {MET} SELECT a, b FROM c",
        "lsh_pairs": f"WITH {ALL}, {SIGS}, {MET} SELECT a, b, round(o.n / (x.n + y.n - o.n), 6) AS sim FROM ({OVERLAP}) o JOIN n x ON x.id = a JOIN n y ON y.id = b SEMI JOIN c USING (a, b) WHERE o.n * 11 >= x.n + y.n",
        "item_model": f"SELECT b1, b2, n, round(sim, 6) AS sim FROM ({_model(RATINGS, CO_RATED, '0.1')})",
        "item_model_strict": f"SELECT b1, b2, n, round(sim, 6) AS sim FROM ({_model(RATINGS, 2 * CO_RATED, '0')})",
        "neighbour_predictions": f'SELECT "user", item, round(stars, 6) AS stars, rule FROM ({_predicted(TEST, RATINGS, _model(RATINGS, CO_RATED, "0.1"))})',
        "user_neighbour_predictions": f'SELECT item AS "user", "user" AS item, round(stars, 6) AS stars, rule FROM ({_predicted(SWAPPED(TEST), SWAPPED_RATINGS, _model(SWAPPED_RATINGS, CO_RATED, "0.1"))})',
        "stored_model_predictions": f'SELECT "user", item, round(stars, 6) AS stars, rule FROM ({_predicted(TEST, RATINGS, STORED)})',
        "collaborative_predictions": f"""WITH {_neighbours(TEST, RATINGS, _model(RATINGS, CO_RATED, "0.1"), 40)} SELECT "user", item,
  round(CASE WHEN um IS NULL OR im IS NULL THEN coalesce(um, im, 2.5) WHEN num * den <> 0 THEN num / den ELSE im END, 6) AS stars, coalesce(h, 0) AS history
  FROM t LEFT JOIN s USING ("user", item) LEFT JOIN u USING ("user") LEFT JOIN i USING (item)""",
        "rating_features": f"""SELECT t."user", t.item, coalesce(u.review_count, 0) AS user_count, coalesce(u.average_stars, 2.5) AS user_mean, coalesce(b.review_count, 0) AS item_count, coalesce(b.stars, 2.5) AS item_mean
  FROM {TEST} t LEFT JOIN {USERS} u ON u.user_id = t."user" LEFT JOIN {BUSINESS} b ON b.business_id = t.item""",
        "prediction_errors": f"""SELECT count(*) AS n, round(sqrt(avg((p - y) ** 2)), 4) AS rmse, count(*) FILTER (y IN (1, 2, 5)) AS n_extreme, round(sqrt(avg((p - y) ** 2) FILTER (y IN (1, 2, 5))), 4) AS rmse_extreme
  FROM (SELECT x.stars AS p, h.stars AS y FROM ({_predicted(HELD, TRAIN, _model(TRAIN, CO_RATED, "0.1"))}) x JOIN {HELD} h USING ("user", item))""",
        "graph_edges": _edges(EDGE),
        "graph_degrees": f"WITH {_graph(EDGE)} SELECT src AS id, count(*) AS degree FROM l GROUP BY 1",
        "graph_components": f"WITH RECURSIVE {_graph(EDGE)}, {REACH} SELECT * FROM comp",
        "graph_lines": f"WITH RECURSIVE {_graph(EDGE)}, {REACH} SELECT '''' || string_agg(id, ''', ''' ORDER BY id) || '''' AS value FROM comp GROUP BY component",
        "graph_labels": LABELS + " SELECT id, label FROM n5",
        "graph_communities": LABELS + " SELECT CAST(count(*) AS INT) AS size, string_agg(id, ',' ORDER BY id) AS members FROM n5 GROUP BY label",
        "graph_paths": PATHS + " SELECT * FROM q",
        "graph_betweenness": PATHS + """ SELECT g.a, g.b, round(sum(s.sigma * t.sigma / w.sigma) / 2, 4) AS score FROM l JOIN g ON g.a = least(l.src, l.dst) AND g.b = greatest(l.src, l.dst)
  JOIN q s ON s.node = l.src JOIN q t ON t.root = l.dst JOIN q w ON w.root = s.root AND w.node = t.node AND w.level = s.level + 1 + t.level GROUP BY 1, 2""",
        "graph_modularity": f"""WITH RECURSIVE {_graph(EDGE)}, {REACH}, m AS (SELECT count(*) AS m FROM g), d AS (SELECT src AS id, count(*) AS k FROM l GROUP BY 1)
  SELECT round(sum(CASE WHEN x.component = y.component THEN CASE WHEN l.src IS NOT NULL THEN 1 ELSE 0 END - dx.k * dy.k / (2.0 * m) ELSE 0 END) / (2.0 * any_value(m)), 8) AS q
  FROM comp x JOIN d dx USING (id), comp y JOIN d dy USING (id) LEFT JOIN l ON l.src = x.id AND l.dst = y.id, m""",
        "point_assignment": f"SELECT id, CAST(i AS INT) AS cluster, round(d, 6) AS distance FROM {ASSIGNED}",
        "kmeans_step": f"SELECT CAST(i AS INT) AS cluster, count(*) AS n, dim, round(avg(x), 6) AS x FROM (SELECT i, unnest(f) AS x, CAST(generate_subscripts(f, 1) - 1 AS INT) AS dim FROM {ASSIGNED}) GROUP BY i, dim",
        "cluster_summaries": f"SELECT label AS cluster, count(*) AS n, dim, round(sum(x), 4) AS s, round(sum(x * x), 4) AS ss, round(sum(x * x) / count(*) - (sum(x) / count(*)) ** 2, 6) AS v FROM {CELLS} GROUP BY 1, 3",
        "merged_summaries": f"SELECT label AS cluster, count(*) AS n, dim, round(sum(x), 4) AS s FROM {CELLS} GROUP BY 1, 3",
        "near_summaries": f"""WITH s AS (SELECT label, dim, avg(x) AS c, greatest(sum(x * x) / count(*) - (sum(x) / count(*)) ** 2, 0) AS v FROM {CELLS} WHERE chunk = 0 GROUP BY 1, 2),
  d AS (SELECT id, s.label, sqrt(sum((x - c) ** 2 / greatest(v, 1e-12))) AS d, count(*) AS k FROM {CELLS} p JOIN s USING (dim) GROUP BY 1, 2)
  SELECT id, CASE WHEN d <= 2 * sqrt(k) THEN label END AS key FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, label) AS r FROM d) WHERE r = 1""",
        "size_split": f"SELECT id, CASE WHEN count(*) OVER (PARTITION BY label * 2 + chunk % 2) > 25 THEN 'inner' ELSE 'outer' END AS part FROM {POINTS}",
        "source_json": "SELECT business_id, count(*) AS n, sum(stars) AS stars FROM review GROUP BY 1",
        "source_csv": f"SELECT u AS user_id, b AS business_id FROM {UB}",
        "source_model": "SELECT b1, count(*) AS n, max(sim) AS best FROM model WHERE sim IS NULL OR NOT isnan(sim) GROUP BY 1",
        "source_points": f"SELECT id, CAST(len(f) AS INT) AS d, round(list_sum(f), 4) AS total FROM {POINTS}",
    }
