"""All similar pairs of set-valued records: a size-aware overlap join."""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.operators.similarity import pairs_within
from siftmill.session import clean_id, discard, materialise, small

#: A set is small while it has at most this many threshold-sized subsets.
SUBSETS = 256
#: Sets of more tokens than this are never gathered into an array; their overlaps are counted relationally.
ARRAY = 4_096
#: Members of equal sets that are paired in one group; larger classes are paired block by block.
CLASS_BLOCK = 1_000


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def _overlaps(n: int, least: int, most: int, num: int, den: int) -> range:
    """The overlaps that a set of ``n`` tokens may need with a partner of ``least`` to ``most`` tokens."""
    partners = [b for b in range(max(least, _ceil(num * n, den)), most + 1) if b * num <= n * den]
    needed = [_ceil(num * (n + b), num + den) for b in partners]
    return range(min(needed), max(needed) + 1) if needed else range(0)


def _small_limit(least: int, num: int, den: int) -> int:
    n = least - 1
    while n < 30 and sum(comb(n + 1, o) for o in _overlaps(n + 1, least, n + 1, num, den)) <= SUBSETS:
        n += 1
    return n


@dataclass
class Classes:
    """The result of the join before expansion, as written tables.

    ``owners`` (id, s, n) names the sets. Equal sets form a class whose head is its least id: ``members`` (id, head,
    n, k) has the sets of classes of k > 1. ``alike`` (i, j, n_i, n_j, n_ab) are the similar pairs of heads, and
    ``giants``, if not None, those with a set too large to gather, between single sets.
    """

    owners: DataFrame
    members: DataFrame
    alike: DataFrame
    giants: DataFrame | None


def similar_classes(df: DataFrame, owner: str, token: str, *, num: int = 1, den: int = 2, least: int = 1, array: int = ARRAY) -> Classes:
    """Similar pairs between representatives of equal sets, and who they stand for; see ``similar_sets``."""
    rows = materialise(df.select(clean_id(F.col(owner).cast("string")).alias("s"), clean_id(F.col(token).cast("string")).alias("t")).dropna().distinct())
    owners = materialise(rows.groupBy("s").agg(F.count(F.lit(1)).cast("int").alias("n")).where(F.col("n") >= least).orderBy("s").withColumn("id", F.monotonically_increasing_id()))
    kept = rows.join(small(owners), "s")
    # Codes in the order of rising frequency.
    codes = materialise(kept.groupBy("t").agg(F.count(F.lit(1)).alias("f")).orderBy("f", "t").withColumn("code", F.monotonically_increasing_id()))
    coded = materialise(kept.join(small(codes), "t").select("id", "n", "code"))
    discard(rows, codes)

    sets = materialise(coded.where(F.col("n") <= array).groupBy("id", "n").agg(F.sort_array(F.collect_list("code")).alias("x")))
    equal = materialise(sets.groupBy("n", "x").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("k")))
    heads = equal.select(F.col("head").alias("id"), "n", "x")
    members = materialise(sets.join(equal.where("k > 1").select("n", "x", "head", "k"), ["n", "x"]).select("id", "head", "n", "k"))
    discard(sets)

    limit = _small_limit(least, num, den)
    found = _by_subsets(heads, least, limit, num, den).unionAll(_by_lists(heads, limit, num, den)).distinct()
    l, r = heads.alias("l"), heads.alias("r")
    verified = (
        found.join(l, F.col("i") == F.col("l.id")).join(r, F.col("j") == F.col("r.id"))
        .select("i", "j", F.col("l.n").alias("n_i"), F.col("r.n").alias("n_j"), F.size(F.array_intersect("l.x", "r.x")).alias("n_ab"))
    )
    alike = materialise(verified.where(F.col("n_ab") * (num + den) >= (F.col("n_i") + F.col("n_j")) * num))
    giants = materialise(_giants(coded, array, num, den)) if owners.where(F.col("n") > array).limit(1).count() else None
    discard(equal, coded)
    return Classes(owners, members, alike, giants)


def similar_sets(df: DataFrame, owner: str, token: str, *, num: int = 1, den: int = 2, least: int = 1, array: int = ARRAY) -> DataFrame:
    """Pairs of owners whose token sets, of at least ``least`` tokens, have a Jaccard similarity of num/den or more.

    Gives a < b (byte order), n_a, n_b, n_ab and similarity; ``num``/``den`` is in (0, 1].

    Method: a pair of sets needs an overlap o set by its two sizes. Small sets enumerate their subsets of exactly
    the sizes o that some partner can need, so that two small sets meet under such a subset only if they are
    similar: common tokens, however frequent, bring no false candidates. For a pair with a large set the inverted
    lists of the larger set's rarest tokens are scanned, as many as any similar partner must hit, with bounds on
    size and position. The candidates' overlap is then computed on the sets. Pairs with a set of more than
    ``array`` tokens are counted on the inverted lists of all their tokens, without gathering a set. Equal sets
    are joined as one class and expanded here, large classes block by block; ``similar_classes`` and ``set_links``
    give the result without expansion.

    Defined cases: rows with a null owner or token don't count, so an owner without tokens is in no pair; blanks
    and tabs around both are removed; repeated rows count once; equal sets are pairs; an empty table gives no
    rows; other columns don't matter.
    """
    c = similar_classes(df, owner, token, num=num, den=den, least=least, array=array)
    pairs = c.alike
    if not c.members.isEmpty():
        for side in ("i", "j"):
            m = small(c.members.select(F.col("head").alias(side), F.col("id").alias("_m")))  # a head stands for itself too
            pairs = pairs.join(m, side, "left").withColumn(side, F.coalesce("_m", side)).drop("_m")
        same = pairs_within(c.members, CLASS_BLOCK).select("i", "j", F.col("n").alias("n_i"), F.col("n").alias("n_j"), F.col("n").alias("n_ab"))
        pairs = pairs.unionByName(same)
    if c.giants is not None:
        pairs = pairs.unionByName(c.giants)
    names = small(c.owners.select("id", "s"))
    left = names.select(F.col("id").alias("i"), F.col("s").alias("s_i"))
    right = names.select(F.col("id").alias("j"), F.col("s").alias("s_j"))
    ordered = F.col("i") < F.col("j")
    return pairs.join(left, "i").join(right, "j").select(
        F.when(ordered, F.col("s_i")).otherwise(F.col("s_j")).alias("a"),
        F.when(ordered, F.col("s_j")).otherwise(F.col("s_i")).alias("b"),
        F.when(ordered, F.col("n_i")).otherwise(F.col("n_j")).cast("long").alias("n_a"),
        F.when(ordered, F.col("n_j")).otherwise(F.col("n_i")).cast("long").alias("n_b"),
        F.col("n_ab").cast("long").alias("n_ab"),
        (F.col("n_ab") / (F.col("n_i") + F.col("n_j") - F.col("n_ab"))).alias("similarity"),
    )


def set_links(df: DataFrame, owner: str, token: str, *, num: int = 1, den: int = 2, least: int = 1, array: int = ARRAY) -> DataFrame:
    """Per owner with a similar set: owner, its class, n_links and the best similarity, without expanding equal sets.

    Owners of equal sets have the same ``class``. The pairs and defined cases are those of ``similar_sets``.
    """
    c = similar_classes(df, owner, token, num=num, den=den, least=least, array=array)
    similarity = F.col("n_ab") / (F.col("n_i") + F.col("n_j") - F.col("n_ab"))
    ends = lambda pairs: pairs.select(F.explode(F.array(F.struct(F.col("i").alias("x"), F.col("j").alias("y")), F.struct(F.col("j").alias("x"), F.col("i").alias("y")))).alias("e"), similarity.alias("best")).select("e.x", "e.y", "best")
    sizes = c.members.where("id = head").select(F.col("head").alias("y"), "k")
    by_head = ends(c.alike).join(sizes, "y", "left").groupBy("x").agg(F.sum(F.coalesce("k", F.lit(1))).alias("n_links"), F.max("best").alias("best"))
    links = by_head.join(c.members.select(F.col("head").alias("x")).distinct(), "x", "left_anti").withColumn("head", F.col("x"))
    inner = c.members.join(by_head.withColumnRenamed("x", "head"), "head", "left").select(
        F.col("id").alias("x"), (F.coalesce("n_links", F.lit(0)) + F.col("k") - 1).alias("n_links"), F.lit(1.0).alias("best"), "head"
    )
    links = links.select("x", "n_links", "best", "head").unionAll(inner)
    if c.giants is not None:
        large = ends(c.giants).groupBy("x").agg(F.count(F.lit(1)).alias("n_links"), F.max("best").alias("best")).withColumn("head", F.lit(None).cast("bigint"))
        links = links.unionAll(large).groupBy("x").agg(F.sum("n_links").alias("n_links"), F.max("best").alias("best"), F.max("head").alias("head"))
    return links.join(small(c.owners.select(F.col("id").alias("x"), "s")), "x").select(F.col("s").alias(owner), F.coalesce("head", "x").alias("class"), "n_links", "best")


def _by_subsets(heads: DataFrame, least: int, limit: int, num: int, den: int) -> DataFrame:
    """Pairs of small sets that share a subset of the size their pair needs."""
    plan = [
        (n, o, mask)
        for n in range(least, limit + 1)
        for o in _overlaps(n, least, limit, num, den)
        for mask in range(1 << n)
        if mask.bit_count() == o
    ]
    table = heads.sparkSession.createDataFrame(plan or [(-1, 0, 0)], "n int, o int, mask int")  # (limit - least + 1) * SUBSETS rows at most
    picked = F.filter("x", lambda _, i: F.getbit("mask", i) == 1)
    keys = heads.where(F.col("n") <= limit).join(F.broadcast(table), "n").select("id", "n", "o", F.xxhash64(picked).alias("h"))
    l, r = keys.alias("l"), keys.alias("r")
    fits = F.expr(f"l.o = ((l.n + r.n) * {num} + {num + den - 1}) div {num + den}")
    return l.join(r, (F.col("l.o") == F.col("r.o")) & (F.col("l.h") == F.col("r.h")) & (F.col("l.id") < F.col("r.id")) & fits).select(F.col("l.id").alias("i"), F.col("r.id").alias("j"))


def _by_lists(heads: DataFrame, limit: int, num: int, den: int) -> DataFrame:
    """Candidates with a large set: the larger one's rarest tokens scan the inverted lists of the others' rarest tokens."""
    prefix = heads.where(F.col("n") >= _ceil(num * (limit + 1), den)).select(
        "id", "n", F.posexplode(F.expr(f"slice(x, 1, n - cast(({num} * n + {den - 1}) div {den} as int) + 1)")).alias("at", "code")
    )
    l, r = prefix.where(F.col("n") > limit).alias("l"), prefix.alias("r")
    smaller = "(r.n < l.n or (r.n = l.n and r.id < l.id))"
    near = f"r.n * {den} >= l.n * {num}"
    room = f"(1 + least(l.n - 1 - l.at, r.n - 1 - r.at)) * {num + den} >= (l.n + r.n) * {num}"
    return l.join(r, (F.col("l.code") == F.col("r.code")) & F.expr(f"{smaller} and {near} and {room}")).select(F.col("l.id").alias("i"), F.col("r.id").alias("j"))


def _giants(coded: DataFrame, array: int, num: int, den: int) -> DataFrame:
    """Pairs whose larger set has more than ``array`` tokens, counted over the full inverted lists of sets of such sizes."""
    near = coded.where(F.col("n") * den >= (array + 1) * num)
    l, r = near.where(F.col("n") > array).alias("l"), near.alias("r")
    counted = l.join(r, (F.col("l.code") == F.col("r.code")) & F.expr(f"(r.n < l.n or (r.n = l.n and r.id < l.id)) and r.n * {den} >= l.n * {num}"))
    return (
        counted.groupBy(F.col("l.id").alias("i"), F.col("r.id").alias("j"), F.col("l.n").alias("n_i"), F.col("r.n").alias("n_j"))
        .agg(F.count(F.lit(1)).cast("int").alias("n_ab"))
        .where(F.col("n_ab") * (num + den) >= (F.col("n_i") + F.col("n_j")) * num)
    )
