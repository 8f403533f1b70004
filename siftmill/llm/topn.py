"""Top N items within every group: simultaneous bisection of an order-preserving code, for all groups at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.session import clean_id, discard, materialise, small

#: Intervals into which one pass cuts a group's range: as many bisection steps as its logarithm.
CUTS = 256
#: Bytes of the identifier in one word of the code.
CHUNK = 6


def _word(level: Column) -> Column:
    """The word of a row's code at ``level``; codes compare word by word, the best first.

    Words 0 and 1 are the halves of the score's bits, made order preserving and turned round; the next ones hold
    the identifier, ``CHUNK`` bytes each with their number, so that a prefix comes before what it begins.
    """
    start = (level - 2) * CHUNK + 1
    part = F.hex(F.substring(F.encode("id", "utf-8"), F.greatest(start, F.lit(1)), F.lit(CHUNK)))
    chunk = F.conv(F.rpad(part, 2 * CHUNK, "0"), 16, 10).cast("bigint") * 8 + (F.length(part) / 2).cast("bigint")
    return F.when(level == 0, F.shiftright("score_code", 32)).when(level == 1, F.col("score_code").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(chunk)


def _score_code(score: Column) -> Column:
    """The bits of a double as a bigint, turned round so that higher scores have smaller codes.

    They are read from the double's exact hexadecimal form, [-]0xL.FFFpE, inside the JVM and without reflection.
    """
    form = F.format_string("%a", F.abs(score))
    fraction = F.conv(F.rpad(F.regexp_extract(form, r"\.([0-9a-f]+)p", 1), 13, "0"), 16, 10).cast("bigint")
    exponent = F.regexp_extract(form, r"p(-?\d+)$", 1).cast("bigint")
    bits = F.when(form == "Infinity", F.lit(0x7FF << 52)).when(form.startswith("0x0."), fraction).otherwise((exponent + 1023) * F.lit(1 << 52) + fraction)
    return F.when(score < 0, bits).otherwise(F.bitwise_not(bits))


def top_per_group(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """The ``n`` items of highest ``score`` in each group, equal scores by rising item (byte order), with rank from 1.

    Method: score and item form one order-preserving code. All groups keep an interval that holds their n-th code;
    a pass counts, in one aggregation with partial counts before the shuffle, each group's rows between ``CUTS``
    points of its interval. Rows above the interval are taken, rows below it are dropped, and the interval shrinks
    to the actual codes about the cutoff, until it ends in exactly n rows. So a group of any size is never sorted
    or gathered, and each pass sees only rows that are still undecided.

    Defined cases: null and NaN scores don't count, nor rows with a null group or item; blanks and tabs around
    both ids are removed; of several rows of one (group, item) the highest score counts; -0.0 equals 0.0; smaller
    groups give what they have; an empty table or n <= 0 gives no rows; other columns don't matter.
    """
    value = F.col(score).cast("double")
    rows = (
        df.where(value.isNotNull() & ~F.isnan(value))
        .select(clean_id(F.col(group).cast("string")).alias("g"), clean_id(F.col(item).cast("string")).alias("id"), value.alias("score"))
        .dropna().groupBy("g", "id").agg(F.max("score").alias("score")).withColumn("score_code", _score_code(F.col("score")))
    )
    rows = materialise(rows)
    first = _word(F.lit(0))
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("lo"), F.max(first).alias("hi"))
    state = materialise(sizes.select("g", F.lit(n).cast("bigint").alias("k"), F.lit(0).alias("level"), "lo", "hi", (F.col("n") <= n).alias("whole")))
    open_groups = state.where("not whole").drop("whole")
    taken = [rows.join(small(state.where("whole").select("g")), "g", "left_semi")] if n > 0 else [rows.limit(0)]
    left, previous = rows, None
    while n > 0 and not open_groups.isEmpty():
        placed = left.join(small(open_groups), "g").withColumn("w", _word(F.col("level"))).withColumn("next", _word(F.col("level") + 1))
        slot = F.expr(f"(w - lo) div ((hi - lo) div {CUTS} + 1)")
        counts = placed.groupBy("g", "k", "level", slot.alias("slot")).agg(
            F.count(F.lit(1)).alias("c"), F.min("w").alias("a"), F.max("w").alias("z"), F.min("next").alias("na"), F.max("next").alias("nz")
        )
        above = F.sum("c").over(Window.partitionBy("g").orderBy("slot")) - F.col("c")
        cut = counts.withColumn("above", above).where((F.col("above") < F.col("k")) & (F.col("above") + F.col("c") >= F.col("k")))
        one = F.col("a") == F.col("z")
        cuts = materialise(cut.select(
            "g", "slot", (F.col("k") - F.col("above")).alias("rest"), (F.col("c") == F.col("k") - F.col("above")).alias("done"),
            F.when(one, F.col("level") + 1).otherwise(F.col("level")).alias("then"),
            F.when(one, F.col("na")).otherwise(F.col("a")).alias("then_lo"), F.when(one, F.col("nz")).otherwise(F.col("z")).alias("then_hi"),
        ))
        decided = materialise(
            placed.select("g", "id", "score", "score_code", slot.alias("at")).join(small(cuts.select("g", "slot", "done")), "g")
            .where("at <= slot").select("g", "id", "score", "score_code", F.expr("at < slot or done").alias("taken"))
        )
        taken.append(decided.where("taken").drop("taken"))
        discard(previous)
        left, previous = decided.where("not taken").drop("taken"), cuts
        open_groups = cuts.where("not done").select("g", F.col("rest").alias("k"), F.col("then").alias("level"), F.col("then_lo").alias("lo"), F.col("then_hi").alias("hi"))
    best = reduce(DataFrame.unionByName, taken)
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), "id"))
    return best.select(F.col("g").alias(group), F.col("id").alias(item), F.col("score").alias(score), rank.cast("long").alias("rank"))
