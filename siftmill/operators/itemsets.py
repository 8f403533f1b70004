"""Frequent itemsets: mining by prefix classes, hash-bucket pruning, and two phases over chunks of baskets."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.functions.scalars import local_support, pair_bucket
from siftmill.session import discard, materialise, small

#: Rows (item, basket) of a prefix class that is mined, or of a block of baskets that is counted, in one task's memory.
CLASS_ROWS = 1_000_000
#: Bytes that the bit sets of one class may take; beyond that its baskets are kept as sets of numbers.
BIT_BYTES = 64 << 20


def entries(df: DataFrame, basket: str, item: str, *, more_than: int = 0) -> DataFrame:
    """Distinct non-null (basket, item) rows, of baskets of strictly more than ``more_than`` items."""
    rows = df.select(F.btrim(F.col(basket).cast("string"), F.lit(" \t")).alias("basket"), F.btrim(F.col(item).cast("string"), F.lit(" \t")).alias("item")).dropna().distinct()
    if more_than:
        kept = rows.groupBy("basket").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > more_than).select("basket")
        rows = rows.join(kept, "basket", "left_semi")
    return rows


def baskets(rows: DataFrame) -> DataFrame:
    """Items of every basket in order."""
    return rows.groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("items"))


def chunk_supports(rows: DataFrame, support: int, chunk: Column) -> DataFrame:
    """Baskets per chunk and the local support that falls to each."""
    parts = rows.withColumn("chunk", chunk).select("chunk", "basket").distinct().groupBy("chunk").agg(F.count(F.lit(1)).alias("n_baskets"))
    total = F.sum("n_baskets").over(Window.partitionBy())  # over one row per chunk
    return parts.withColumn("local_support", local_support(F.lit(support), F.col("n_baskets"), total).cast("long"))


def pairs_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs item < other of each basket; call it with frequent items only, whose number bounds a basket."""
    left, right = rows.select(*keys, "item"), rows.select(*keys, F.col("item").alias("other"))
    return left.join(right, keys).where("item < other")


def bucket_counts(rows: DataFrame, buckets: int, *, numeric: bool) -> DataFrame:
    """Pairs per (chunk, hash bucket) over all pairs of the chunk's baskets."""
    pairs = pairs_of(rows, ["chunk", "basket"])
    return pairs.groupBy("chunk", pair_bucket(F.col("item"), F.col("other"), buckets, numeric=numeric).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def frequent_items(rows: DataFrame, supports: DataFrame) -> DataFrame:
    """Items that reach their chunk's support."""
    counts = rows.groupBy("chunk", "item").agg(F.count(F.lit(1)).alias("support"))
    return counts.join(F.broadcast(supports), "chunk").where(F.col("support") >= F.col("local_support")).select("chunk", "item", "support")


def pruned_pairs(rows: DataFrame, supports: DataFrame, buckets: int, *, numeric: bool) -> DataFrame:
    """Frequent pairs per chunk: of frequent items, in frequent buckets, counted and kept at the local support."""
    limits = F.broadcast(supports.select("chunk", "local_support"))
    heavy = bucket_counts(rows, buckets, numeric=numeric).join(limits, "chunk").where("n >= local_support").select("chunk", "bucket")
    usable = rows.join(frequent_items(rows, supports).select("chunk", "item"), ["chunk", "item"], "left_semi")
    pairs = pairs_of(usable, ["chunk", "basket"]).withColumn("bucket", pair_bucket(F.col("item"), F.col("other"), buckets, numeric=numeric))
    counted = pairs.join(heavy, ["chunk", "bucket"], "left_semi").groupBy("chunk", "item", "other").agg(F.count(F.lit(1)).alias("support"))
    return counted.join(limits, "chunk").where("support >= local_support").select("chunk", F.array("item", "other").alias("itemset"), "support")


def next_candidates(frequent: DataFrame, keys: list[str]) -> DataFrame:
    """Itemsets one longer, all of whose subsets are frequent: a prefix join, then a count of frequent subsets."""
    k = F.size("itemset")
    parts = frequent.select(*keys, "itemset", F.slice("itemset", F.lit(1), k - 1).alias("prefix"), F.element_at("itemset", -1).alias("last"))
    left, right = parts.select(*keys, "prefix", "itemset", "last"), parts.select(*keys, "prefix", F.col("last").alias("next"))
    joined = left.join(right, [*keys, "prefix"]).where("last < next").select(*keys, F.array_append("itemset", F.col("next")).alias("candidate"))
    subsets = joined.select(*keys, "candidate", F.explode(F.expr("transform(sequence(1, size(candidate)), i -> filter(candidate, (x, j) -> j <> i - 1))")).alias("itemset"))
    good = subsets.join(frequent.select(*keys, "itemset"), [*keys, "itemset"], "left_semi")
    return good.groupBy(*keys, "candidate").agg(F.count(F.lit(1)).alias("c")).where("c = size(candidate)").select(*keys, F.col("candidate").alias("itemset"))


def _basket_sets(items: list, baskets: list) -> dict:
    """The baskets of each item: as the bits of a whole number while these fit ``BIT_BYTES``, else as a set of numbers."""
    number = {b: i for i, b in enumerate(dict.fromkeys(baskets))}
    held: dict = {}
    for i, b in zip(items, baskets):
        held.setdefault(i, []).append(number[b])
    if len(held) * len(number) > 8 * BIT_BYTES:
        return {i: frozenset(x) for i, x in held.items()}
    out = {}
    for i, x in held.items():
        bits = bytearray(len(number) // 8 + 1)
        for n in x:
            bits[n >> 3] |= 1 << (n & 7)
        out[i] = int.from_bytes(bits, "little")
    return out


def _support(baskets: int | frozenset) -> int:
    return baskets.bit_count() if isinstance(baskets, int) else len(baskets)


def _groups(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """The groups of rows sorted by their first ``n_keys`` columns, one after another: key and the other columns."""
    key, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        keys = [tuple(tuple(x) if isinstance(x, list) else x for x in k) for k in zip(*columns[:n_keys])]
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for a, z in zip(cuts, cuts[1:]):
            if z > a and keys[a] != key:
                if held:
                    yield key, held
                key, held = keys[a], [[] for _ in columns[n_keys:]]
            for h, c in zip(held, columns[n_keys:]):
                h += c[a:z]
    if held:
        yield key, held


def _class_miner(max_size: int | None) -> Callable:
    """Mines prefix classes (chunk, prefix | item, f, basket, need), depth first over intersections of basket sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])

        def flush() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(out[0], pa.int32()), pa.array(out[1], pa.list_(pa.string())), pa.array(out[2], pa.int64())], names=["chunk", "itemset", "support"])
            for x in out:
                x.clear()
            return batch

        for (chunk, prefix), (items, f, baskets, need) in _groups(batches, 2):
            least, order = need[0], dict(zip(items, f))
            sets = _basket_sets(items, baskets)
            tails = [(i, sets[i], _support(sets[i])) for i in sorted(sets, key=lambda i: (order[i], i))]
            stack = [(prefix, [t for t in tails if t[2] >= least])]
            while stack:
                head, tails = stack.pop()
                for at, (item, held, n) in enumerate(tails):
                    itemset = (*head, item)
                    for x, v in zip(out, (chunk, sorted(itemset), n)):
                        x.append(v)
                    if len(out[0]) >= 20_000:
                        yield flush()
                    if max_size is None or len(itemset) < max_size:
                        further = [(i, both, _support(both)) for i, m, _ in tails[at + 1 :] if (both := held & m)]
                        further = [t for t in further if t[2] >= least]
                        if further:
                            stack.append((itemset, further))
        if out[0]:
            yield flush()

    return run


def mine(rows: DataFrame, supports: DataFrame, *, max_size: int | None = None) -> DataFrame:
    """Frequent itemsets of every chunk (chunk, itemset, support), by prefix classes.

    A class holds, for a frequent itemset (its prefix), the frequent items that come after it and the baskets of
    each; items come in the order of rising support, so classes of many items have few baskets. The pairs of a
    basket's frequent items are counted and those of frequent pairs are kept: the classes of one item. A class of
    at most ``CLASS_ROWS`` rows is mined in memory, in the task it is shuffled to; larger ones are divided into
    classes of a longer prefix first. So neither a chunk nor a basket must fit a task.

    Null-free (basket, item, chunk) rows, each once; an empty table gives no rows.
    """
    limits = F.broadcast(supports.select("chunk", F.col("local_support").alias("need")))  # one row per chunk
    first = materialise(frequent_items(rows, supports).withColumnRenamed("support", "f"))
    found = [first.select("chunk", F.array("item").alias("itemset"), F.col("f").alias("support"))]
    if max_size is not None and max_size < 2:
        return found[0]
    none = F.expr("cast(array() as array<string>)")
    held = materialise(rows.join(small(first), ["chunk", "item"]).select("chunk", none.alias("prefix"), "basket", "item", "f"))
    key = ["chunk", "prefix"]
    while True:
        x, y = held, held.select(*key, "basket", F.col("item").alias("item2"), F.col("f").alias("f2"))
        pairs = x.join(y, [*key, "basket"]).where("f < f2 or (f = f2 and item < item2)")
        level = pairs.groupBy(*key, "item", "item2").agg(F.count(F.lit(1)).alias("support")).join(limits, "chunk").where("support >= need")
        level = materialise(level.select(*key, "item", "item2", "support"))
        wider = pairs.join(level.select(*key, "item", "item2"), [*key, "item", "item2"], "left_semi").select("chunk", F.array_append("prefix", F.col("item")).alias("prefix"), "basket", F.col("item2").alias("item"), F.col("f2").alias("f"))
        sizes = level.groupBy("chunk", F.array_append("prefix", F.col("item")).alias("prefix")).agg(F.sum("support").alias("size"))
        large = materialise(sizes.where(F.col("size") > CLASS_ROWS).select("chunk", "prefix"))
        depth = len(level.select("prefix").first()[0]) + 2 if not level.isEmpty() else 0
        if not depth:
            break
        divided = not large.isEmpty() and (max_size is None or depth < max_size)
        inside = wider.join(small(large), key, "left_anti") if divided else wider
        classes = inside.join(limits, "chunk").select(*key, "item", "f", "basket", "need").repartition(*key).sortWithinPartitions(*key)
        found.append(materialise(classes.mapInArrow(_class_miner(max_size), "chunk int, itemset array<string>, support bigint")))
        if not divided:
            break
        found.append(level.join(small(large), (level.chunk == large.chunk) & (F.array_append(level.prefix, level.item) == large.prefix)).select(level.chunk, F.array_sort(F.concat(level.prefix, F.array("item", "item2"))).alias("itemset"), "support"))
        before, held = held, materialise(wider.join(small(large), key, "left_semi"))
        discard(before)
    return reduce(DataFrame.unionByName, found)


def frequent_itemsets(rows: DataFrame, support: int, *, max_size: int | None = None) -> DataFrame:
    """All itemsets in at least ``support`` baskets: (itemset, support)."""
    whole = rows.withColumn("chunk", F.lit(0))
    limit = rows.sparkSession.createDataFrame([(0, support)], "chunk int, local_support bigint")
    return mine(whole, limit, max_size=max_size).select("itemset", "support")


def local_candidates(rows: DataFrame, support: int, chunk: Column, *, max_size: int | None = None) -> DataFrame:
    """Phase one over chunks: itemsets frequent in some chunk at its local support."""
    rows = materialise(rows.withColumn("chunk", chunk.cast("int")))
    supports = materialise(chunk_supports(rows, support, F.col("chunk")))
    return mine(rows, supports, max_size=max_size).select("itemset").distinct()


def _count_block(head: tuple, held: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
    """Supports of one item's candidates over the block's baskets, all of which hold the item."""
    if held.empty or candidates.empty:
        return pd.DataFrame({"itemset": pd.Series([], dtype=object), "support": pd.Series([], dtype="int64")})
    sets = _basket_sets(held["item"].tolist(), held["basket"].tolist())
    counts = []
    for itemset in candidates["itemset"]:
        each = sorted((sets.get(i, 0) for i in itemset), key=lambda s: _support(s) if s else 0)
        counts.append(_support(reduce(lambda a, b: a & b, each)) if all(each) else 0)
    return pd.DataFrame({"itemset": [list(x) for x in candidates["itemset"]], "support": counts})


def count_itemsets(candidates: DataFrame, rows: DataFrame, support: int) -> DataFrame:
    """Phase two: the candidates' supports over all baskets, kept at ``support``.

    Candidates are led by their rarest item. For each leader and each item of its candidates the common baskets are
    found by joins; a leader's baskets form blocks of bounded size, on which its candidates are counted by
    intersection, and the blocks' counts are added up.
    """
    frequency = rows.groupBy("item").agg(F.count(F.lit(1)).alias("f"))
    led = materialise(
        candidates.select("itemset", F.explode("itemset").alias("item")).join(frequency, "item")
        .groupBy("itemset").agg(F.min(F.struct("f", "item")).alias("m")).select("itemset", F.col("m.item").alias("head"), F.col("m.f").alias("f"))
    )
    pairs = materialise(led.select("head", F.explode("itemset").alias("item")).distinct())
    blocks = F.ceil(F.col("f") * F.col("k") / CLASS_ROWS).cast("int")  # at most k items in each of f baskets
    heads = materialise(led.select("head", "f").distinct().join(pairs.groupBy("head").agg(F.count(F.lit(1)).alias("k")), "head").select("head", blocks.alias("blocks")))
    block = F.pmod(F.xxhash64("basket"), F.col("blocks")).cast("int").alias("block")
    common = (
        rows.withColumnRenamed("item", "head").join(small(heads), "head").select("head", "basket", block)
        .join(small(pairs), "head").join(rows, ["basket", "item"]).select("head", "block", "item", "basket")
    )
    asked = led.join(small(heads), "head").select("head", "itemset", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    counted = common.groupBy("head", "block").cogroup(asked.groupBy("head", "block")).applyInPandas(_count_block, "itemset array<string>, support bigint")
    return counted.groupBy("itemset").agg(F.sum("support").alias("support")).where(F.col("support") >= support)


def two_phase_itemsets(rows: DataFrame, support: int, chunk: Column, *, max_size: int | None = None) -> DataFrame:
    """Frequent itemsets by local candidates and one global count; the result doesn't depend on the chunks."""
    rows = materialise(rows)
    return count_itemsets(materialise(local_candidates(rows, support, chunk, max_size=max_size)), rows, support)


def by_length(itemsets: DataFrame) -> DataFrame:
    """Itemsets gathered by length in order, as a report of bounded size."""
    return itemsets.groupBy(F.size("itemset").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("itemset")).alias("itemsets"))


def association_rules(itemsets: DataFrame, n_baskets: int) -> DataFrame:
    """Rules antecedent -> item from frequent itemsets: support, confidence and lift.

    ``itemsets`` is a complete result (itemset, support), so that every antecedent and item is in it.
    """
    longer = itemsets.where(F.size("itemset") > 1).select("itemset", "support", F.explode("itemset").alias("item"))
    rules = longer.select(F.array_remove("itemset", F.col("item")).alias("antecedent"), "item", "support")
    known = itemsets.select(F.col("itemset").alias("antecedent"), F.col("support").alias("n_antecedent"))
    single = itemsets.where(F.size("itemset") == 1).select(F.col("itemset")[0].alias("item"), F.col("support").alias("n_item"))
    joined = rules.join(known, "antecedent").join(single, "item")
    confidence = F.col("support") / F.col("n_antecedent")
    return joined.select("antecedent", "item", "support", confidence.alias("confidence"), (confidence * F.lit(float(n_baskets)) / F.col("n_item")).alias("lift"))
