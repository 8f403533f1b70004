"""Overlap and similarity of sets and ratings: inverted lists with prefix bounds, banded min-hashes, correlation."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions.scalars import universal_hash
from siftmill.session import dense_codes, discard, materialise, materialise_parts, small

#: Modulus of the hash family: a prime above any dense user index in use; products stay within bigint.
PRIME = 2_147_483_647


#: Sets of more tokens than this are never gathered into an array; their overlaps are counted relationally.
ARRAY = 4_096
#: Members of a class of equal sets that are paired in one group; larger classes are paired block by block.
CLASS_BLOCK = 1_000
#: Pairs that may meet in one part of a correlation model; a larger model is made part by part, so that the disk holds
#: the shuffled rows of one part only.
PART = 10_000_000


def ranked_tokens(df: DataFrame, owner: str, token: str, *, least: int = 1) -> DataFrame:
    """(id, n, code): each owner's distinct tokens as codes that rise with frequency, for owners of ``least`` tokens or more."""
    rows = materialise(df.select(F.col(owner).alias("id"), F.col(token).alias("t")).dropna().distinct())
    kept = rows.join(rows.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n")).where(F.col("n") >= least), "id")
    codes = materialise(kept.groupBy("t").agg(F.count(F.lit(1)).alias("f")).orderBy("f", "t").withColumn("code", F.monotonically_increasing_id()))
    return materialise(kept.join(codes, "t").select("id", "n", "code"))


def _gathered(coded: DataFrame, array: int) -> DataFrame:
    """(id, n, x): the sets of at most ``array`` tokens as sorted arrays of codes."""
    return coded.where(F.col("n") <= array).groupBy("id", "n").agg(F.sort_array(F.collect_list("code")).alias("x"))


def _overlaps(met: DataFrame, sets: DataFrame, *, listed: bool = False) -> DataFrame:
    """The overlap of pairs (a, b) of gathered sets, with the common tokens if ``listed``."""
    x = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("x").alias("x_a"))
    y = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("x").alias("x_b"))
    both = F.array_intersect("x_a", "x_b")
    return met.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", F.size(both).cast("long").alias("n_ab"), *[both.alias("common")] * listed)


def _beside_giants(coded: DataFrame, array: int, fits: str = "true") -> DataFrame:
    """The rows l and r of each token that two sets share, the first of them of more than ``array`` tokens."""
    l, r = coded.where(F.col("n") > array).alias("l"), coded.alias("r")
    return l.join(r, (F.col("l.code") == F.col("r.code")) & F.expr(f"(r.n <= {array} or l.id < r.id) and l.id <> r.id and {fits}"))


def _with_giants(coded: DataFrame, array: int, fits: str) -> DataFrame:
    """Pairs (a < b) with a set of more than ``array`` tokens, by counting common tokens over the inverted lists."""
    n = _beside_giants(coded, array, fits).groupBy(F.col("l.id").alias("i"), F.col("r.id").alias("j"), F.col("l.n").alias("n_i"), F.col("r.n").alias("n_j")).agg(F.count(F.lit(1)).alias("n_ab"))
    first = F.col("i") < F.col("j")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return n.select(pick("i", "j").alias("a"), pick("j", "i").alias("b"), pick("n_i", "n_j").alias("n_a"), pick("n_j", "n_i").alias("n_b"), "n_ab")


def equal_classes(coded: DataFrame, array: int = ARRAY) -> DataFrame:
    """(id, head, n, k) of the sets that equal another one, of at most ``array`` tokens; the head is the least id."""
    sets = materialise(_gathered(coded, array))
    equal = sets.groupBy("n", "x").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("k")).where("k > 1")
    members = materialise(sets.join(equal, ["n", "x"]).select("id", "head", "n", "k"))
    discard(sets)
    return members


def pairs_within(members: DataFrame, block: int = CLASS_BLOCK) -> DataFrame:
    """Pairs i < j of the members (id, head, n, k) of each class, with n. A pair is made in the group of its two blocks,
    so a class of any size is spread over many groups of bounded size."""
    m = members.withColumn("blocks", F.ceil(F.col("k") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.explode(F.expr("sequence(0, blocks - 1)"))
    l = m.select("head", F.col("id").alias("i"), "n", F.col("own").alias("x"), every.alias("y"))
    r = m.select("head", F.col("id").alias("j"), every.alias("x"), F.col("own").alias("y"))
    return l.join(r, ["head", "x", "y"]).where("i < j").select("i", "j", "n")


def _of_members(alike: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b, n_a, n_b, n_ab, ...) of heads, and those of the members of two heads."""
    for side in ("a", "b"):
        m = small(members.select(F.col("head").alias(side), F.col("id").alias("_m")))  # a head stands for itself too
        alike = alike.join(m, side, "left").withColumn(side, F.coalesce("_m", side)).drop("_m")
    first = F.col("a") < F.col("b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return alike.withColumns({"a": pick("a", "b"), "b": pick("b", "a"), "n_a": pick("n_a", "n_b"), "n_b": pick("n_b", "n_a")})


def _expanded(alike: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b, n_a, n_b, n_ab) of heads, and the pairs of all their members, among themselves too."""
    if members.isEmpty():
        return alike
    same = pairs_within(members).select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("n").alias("n_a"), F.col("n").alias("n_b"), F.col("n").cast("long").alias("n_ab"))
    return _of_members(alike, members).unionByName(same)


def _heads(coded: DataFrame, array: int) -> tuple[DataFrame, DataFrame]:
    """The rows of the sets that aren't copies of their head, and the members of the classes of equal sets."""
    members = equal_classes(coded, array)
    return coded.join(small(members.where("id <> head").select("id")), "id", "left_anti"), members


def _begun(sets: DataFrame, prefix: str) -> DataFrame:
    """(id, n, at, code) of the ``prefix`` rarest tokens of gathered sets."""
    return sets.select("id", "n", F.posexplode(F.expr(f"slice(x, 1, {prefix})")).alias("at", "code"))


def _met(begun: DataFrame, fits: str) -> DataFrame:
    """Pairs a < b of sets that share one of their rarest tokens and meet ``fits``.

    Tokens that occur in many sets come last in every set, so long inverted lists take part only where a set has
    hardly any other tokens.
    """
    l, r = begun.alias("l"), begun.alias("r")
    met = l.join(r, (F.col("l.code") == F.col("r.code")) & (F.col("l.id") < F.col("r.id")) & F.expr(fits))
    return met.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()


def _head_pairs(coded: DataFrame, prefix: str, fits: str, room: str, array: int, kept: str) -> tuple[DataFrame, DataFrame]:
    """Pairs a < b of sets of at most ``array`` tokens that share one of their ``prefix`` rarest tokens, meet ``fits``
    and are ``kept``, as ``_overlaps`` gives them, and the members of the classes of equal sets. Equal sets take part as
    one, their head.
    """
    heads, members = _heads(coded, array)
    met = _met(_begun(_gathered(heads, array), prefix), f"{fits} and {room}")
    return _overlaps(met, materialise(_gathered(heads, array))).where(kept), members


def _pairs(coded: DataFrame, prefix: str, fits: str, room: str, array: int, kept: str) -> DataFrame:
    """All pairs a < b that meet ``fits`` and are ``kept``, with their overlap, as ``_head_pairs`` finds them. Equal
    sets are expanded at the end; so ``kept`` must hold for them."""
    out = _expanded(*_head_pairs(coded, prefix, fits, room, array, kept))
    return out.unionByName(_with_giants(coded, array, fits).where(kept)) if coded.where(F.col("n") > array).limit(1).count() else out


def overlapping_pairs(df: DataFrame, owner: str, token: str, least: int, *, array: int = ARRAY) -> DataFrame:
    """Pairs a < b of owners with at least ``least`` common tokens, without comparing all owners."""
    return _pairs(ranked_tokens(df, owner, token, least=least), *_overlapping(least, array))


def _overlapping(least: int, array: int) -> tuple:
    return f"n - {least - 1}", "true", f"(1 + least(l.n - 1 - l.at, r.n - 1 - r.at)) >= {least}", array, f"n_ab >= {least}"


def jaccard_pairs(df: DataFrame, owner: str, token: str, *, num: int = 1, den: int = 10, least: int = 1, array: int = ARRAY) -> DataFrame:
    """Pairs a < b of owners with Jaccard similarity num/den or more (exact), among owners of ``least`` tokens or more."""
    coded = ranked_tokens(df, owner, token, least=least)
    fits = f"l.n * {den} >= r.n * {num} and r.n * {den} >= l.n * {num}"
    room = f"(1 + least(l.n - 1 - l.at, r.n - 1 - r.at)) * {num + den} >= (l.n + r.n) * {num}"
    return _with_similarity(_pairs(coded, f"n - cast(({num} * n + {den - 1}) div {den} as int) + 1", fits, room, array, _similar(num, den)))


def _similar(num: int, den: int) -> str:
    return f"n_ab * {num + den} >= (n_a + n_b) * {num}"


def _with_similarity(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("sim", F.col("n_ab") / (F.col("n_a") + F.col("n_b") - F.col("n_ab")))


def hash_family(n: int, seed: int = 42) -> list[tuple[int, int]]:
    """``n`` parameter pairs (a, b) of the universal hashes, the same for a seed."""
    draw = random.Random(seed)
    return [(draw.randint(1, 30_000_000), draw.randint(1, 30_000_000)) for _ in range(n)]


def signatures(df: DataFrame, owner: str, token: str, n_hashes: int, *, seed: int = 42, least: int = 1) -> DataFrame:
    """(id, n, sig): min-hash signatures over dense token indexes, all minima in one combined aggregation."""
    rows = materialise(df.select(F.col(owner).alias("id"), F.col(token).alias("t")).dropna().distinct())
    index = dense_codes(rows.select("t").distinct(), "t", name="x")
    minima = [F.min(universal_hash(a, b, F.col("x"), PRIME)).alias(f"h{i}") for i, (a, b) in enumerate(hash_family(n_hashes, seed))]
    return rows.join(index, "t").groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n"), *minima).where(F.col("n") >= least).select("id", "n", F.array(*(f"h{i}" for i in range(n_hashes))).alias("sig"))


def band_buckets(sigs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(band, bucket, id): each band's slice of the signature, itself the bucket, so that nothing collides."""
    return sigs.select("id", F.posexplode(F.expr(f"transform(sequence(0, {bands - 1}), b -> slice(sig, b * {rows} + 1, {rows}))")).alias("band", "bucket"))


def lsh_candidates(buckets: DataFrame) -> DataFrame:
    """Pairs a < b that share a bucket. Members meet their bucket's pairs in a join, which may be split, not in a list."""
    l, r = buckets.alias("l"), buckets.alias("r")
    return l.join(r, (F.col("l.band") == F.col("r.band")) & (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.id") < F.col("r.id"))).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()


def lsh_pairs(df: DataFrame, owner: str, token: str, *, num: int = 1, den: int = 10, bands: int = 50, rows: int = 2, seed: int = 42, least: int = 1, array: int = ARRAY) -> DataFrame:
    """Banded min-hash join, verified exactly: no false pairs; a pair of similarity s is found with 1-(1-s^rows)^bands.

    Equal sets have one signature and take part as one, so a bucket holds no copies; they are expanded at the end.
    """
    coded = ranked_tokens(df, owner, token, least=least)
    members = equal_classes(coded, array)
    copies = small(members.where("id <> head").select("id"))
    heads = materialise(coded.join(copies, "id", "left_anti"))
    own = df.select(F.col(owner).alias("id"), F.col(token).alias("t")).dropna()
    sigs = materialise(signatures(own, "id", "t", bands * rows, seed=seed, least=least).join(copies, "id", "left_anti"))
    met = lsh_candidates(band_buckets(sigs, bands, rows))
    counted = _overlaps(met, materialise(_gathered(heads, array)))
    big = materialise(heads.where(F.col("n") > array).select("id").distinct())
    counted = _expanded(counted.where(_similar(num, den)), members)
    if not big.isEmpty():
        # Candidates with a set too large to gather: only their own tokens are counted. Copies of the other side follow.
        met = materialise(met)
        if not members.isEmpty():
            other = members.where("id <> head")
            for side, far in (("a", "b"), ("b", "a")):
                m = other.select(F.col("head").alias(side), F.col("id").alias("_m"))
                met = met.unionByName(met.join(m, side).select(F.col("_m").alias(side), far))
            met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        far = met.join(big.select(F.col("id").alias("a")), "a", "left_semi").unionByName(met.join(big.select(F.col("id").alias("b")), "b", "left_semi")).distinct()
        counted = counted.unionByName(_with_giants(coded, array, "true").join(far, ["a", "b"], "left_semi").where(_similar(num, den)))
    return _with_similarity(counted)


def pearson(n: Column, sx: Column, sy: Column, sxy: Column, sxx: Column, syy: Column) -> Column:
    """Correlation from one pass of sums, to 9 places, so that equal ones stay equal whatever the order of the sums;
    0 where a side doesn't vary."""
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    return F.when((vx > 1e-9) & (vy > 1e-9), F.round((sxy - sx * sy / n) / F.sqrt(vx * vy), 9)).otherwise(0.0)


def _shared_ratings(coded: DataFrame, co_rated: int, array: int, most: int) -> tuple[int, Callable[[int], DataFrame]]:
    """The number of parts in which at most about ``most`` pairs meet, and a function of a part's number: (a, b, v, w),
    a row for each common user of its items a < b of at most ``array`` ratings with ``co_rated`` such users or more.

    The users come from the overlap itself, so that a pair looks up these and not all of an item's ratings.
    """
    prefix, fits, room, _, kept = _overlapping(co_rated, array)
    heads, members = _heads(coded, array)
    sets = materialise(_gathered(heads, array))
    begun = materialise(_begun(sets, prefix))
    whole = members.isEmpty()
    meet = begun.groupBy("code").agg(F.count(F.lit(1)).alias("f")).agg(F.sum(F.expr("f * (f - 1) / 2"))).first()[0] or 0
    parts = max(1, math.ceil(meet / most))

    def part(k: int) -> DataFrame:
        alike = _overlaps(_met(begun, f"{fits} and {room} and {_of_part('l.id', k, parts)}"), sets, listed=True).where(kept)
        if whole:
            met = alike.select("a", "b", F.explode("common").alias("code"))
        else:
            within = pairs_within(members).where(_of_part("i", k, parts))
            same = within.join(coded.select(F.col("id").alias("i"), "code"), "i").select(F.col("i").alias("a"), F.col("j").alias("b"), "code")
            met = _of_members(alike, members).select("a", "b", F.explode("common").alias("code")).unionByName(same)
        met = materialise(met)  # frees what the overlaps shuffled
        v = coded.select(F.col("id").alias("a"), "code", F.col("stars").alias("v"))
        w = coded.select(F.col("id").alias("b"), "code", F.col("stars").alias("w"))
        shared = met.join(v, ["a", "code"]).join(w, ["b", "code"]).select("a", "b", "v", "w")
        shared._met = met
        return shared

    return parts, part


def _of_part(code: str, k: int, parts: int) -> str:
    return f"pmod({code}, {parts}) = {k}" if parts > 1 else "true"


def correlated_items(ratings: DataFrame, *, co_rated: int = 3, above: float = 0.1, array: int = ARRAY, most: int = PART) -> DataFrame:
    """Model of item pairs b1 < b2 by Pearson correlation over their common users: (b1, b2, n, sim), sim > ``above``.

    ``ratings`` has one row per (user, item). Pairs with ``co_rated`` common users are found first by prefixes of
    rare users; only the ratings of their common users meet, in one aggregation. Items of more than ``array`` ratings
    meet the others user by user. All this runs on dense codes, of items in the order of the ids, of users by frequency,
    so that the shuffled rows are short; only the model gets its ids back. Where more than ``most`` pairs meet, the model
    is written in parts, each with all pairs of a share of the items.
    """
    ratings = ratings.dropna(subset=["item", "user"])
    items = dense_codes(ratings.groupBy("item").agg(F.count(F.lit(1)).cast("int").alias("n")).where(F.col("n") >= co_rated), "item")
    users = dense_codes(ratings.groupBy("user").agg(F.count(F.lit(1)).alias("f")), "f", "user")
    coded = materialise(ratings.join(items.withColumnRenamed("code", "id"), "item").join(users, "user").select("id", "n", "code", "stars"))
    s = lambda e: F.sum(F.expr(e))
    sums = F.count(F.lit(1)).alias("n"), s("v").alias("sv"), s("w").alias("sw"), s("v * w").alias("svw"), s("v * v").alias("svv"), s("w * w").alias("sww")
    giants = coded.where(F.col("n") > array).limit(1).count() > 0
    parts, shared_of = _shared_ratings(coded, co_rated, array, most)

    def model(shared: DataFrame, k: int) -> DataFrame:
        # A pair's few rows are spread over the tasks: partial sums would hardly be fewer, but longer.
        found = shared.repartition("a", "b").groupBy("a", "b").agg(*sums)
        if giants:
            met = _beside_giants(coded, array, _of_part("r.id", k, parts)).select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"), F.col("l.stars").alias("v"), F.col("r.stars").alias("w"))
            # Which of the two is the giant doesn't matter: the correlation is symmetric.
            found = found.unionByName(met.groupBy("a", "b").agg(*sums).where(F.col("n") >= co_rated))
        sim = pearson(*(F.col(c) for c in ("n", "sv", "sw", "svw", "svv", "sww")))
        found = found.select("a", "b", "n", sim.alias("sim")).where(F.col("sim") > above)
        for c, name in (("a", "b1"), ("b", "b2")):
            found = found.join(items.select(F.col("code").alias(c), F.col("item").alias(name)), c)
        return found.select("b1", "b2", "n", "sim")

    def written() -> Iterator[DataFrame]:
        for k in range(parts):
            shared = shared_of(k)
            yield model(shared, k)
            discard(shared._met)

    return model(shared_of(0), 0) if parts == 1 else materialise_parts(written())


def directed_model(pairs: DataFrame, ratings: DataFrame, *, co_rated: int = 175, above: float = 0.0) -> DataFrame:
    """Correlations (nb, item, n, sim) of the items that users rated with the items they are asked for in ``pairs``.

    As ``correlated_items`` with ``co_rated`` common raters or more and sim > ``above``, in the direction from the
    history to the asked item. An item is also its own neighbour, with sim 1, if it has so many raters and its
    ratings vary.
    """
    model = correlated_items(ratings, co_rated=co_rated, above=above)
    spread = F.sum(F.col("stars") * F.col("stars")) - F.sum("stars") * F.sum("stars") / F.count(F.lit(1))
    own = ratings.groupBy("item").agg(F.count(F.lit(1)).alias("n"), spread.alias("v")).where((F.col("n") >= co_rated) & (F.col("v") > 1e-9) & F.lit(above < 1))
    directed = (
        model.select(F.col("b1").alias("nb"), F.col("b2").alias("item"), "n", "sim")
        .unionAll(model.select(F.col("b2").alias("nb"), F.col("b1").alias("item"), "n", "sim"))
        .unionAll(own.select(F.col("item").alias("nb"), "item", "n", F.lit(1.0).alias("sim")))
    )
    asked = pairs.select("user", "item").distinct().join(directed, "item")
    return asked.join(ratings.select("user", F.col("item").alias("nb")), ["user", "nb"], "left_semi").select("nb", "item", "n", "sim").distinct()
