"""Filling fixed-capacity containers with items: hierarchical packing over several container sizes."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmill.session import materialise

#: Containers of a step group.
STEP = 8
#: Items of one length that are numbered in one task.
BUCKET = 50_000

PACKED = "piece int, token_from bigint, n_tokens bigint, container string, container_no bigint, slot int, step bigint"


def plan_containers(lengths: dict[int, int], tiers: Sequence[tuple[str, int]]) -> list[tuple[int, list[tuple[int, int]]]]:
    """Batches of equal containers: (tier index, count, lengths in slot order), for items counted by length.

    Lengths are routed to the smallest tier that takes them. Tiers are packed from the largest: each item of the
    tier opens a container, longest first, and the gap is filled with the longest items left that fit - of the same
    or a shorter tier - until none does. Items are handled by length, so the work depends on the capacity only.
    """
    left = {n: c for n, c in lengths.items() if c}
    order = sorted(left)
    batches: list[tuple[int, int, tuple[int, ...]]] = []

    def longest(room: int) -> int | None:
        at = bisect_right(order, room) - 1
        return order[at] if at >= 0 else None

    def take(n: int, count: int) -> None:
        left[n] -= count
        if not left[n]:
            order.remove(n)

    bounds = [0, *(c for _, c in tiers)]
    for tier in range(len(tiers) - 1, -1, -1):
        capacity = bounds[tier + 1]
        while order and order[-1] > bounds[tier]:
            first = order[-1]
            opened = left[first]
            per = capacity // first  # several of one length in one container
            if per > 1 and opened >= per:
                opened //= per
                take(first, opened * per)
                open_batches = [(opened, (first,) * per)]
            else:
                opened = opened if per == 1 else 1
                n = 1 if per == 1 else left[first]
                take(first, opened * n)
                open_batches = [(opened, (first,) * n)]
            while open_batches:
                count, slots = open_batches.pop()
                fit = longest(capacity - sum(slots))
                if fit is None:
                    batches.append((tier, count, slots))
                    continue
                filled = min(count, left[fit])
                take(fit, filled)
                if filled < count:
                    open_batches.append((count - filled, slots))
                open_batches.append((filled, (*slots, fit)))
    return [(t, c, list(s)) for t, c, s in batches]


def _places(batches: list, tiers: Sequence[tuple[str, int]], step: int) -> dict[str, np.ndarray]:
    """For each length, intervals of ranks and where they go, sorted by (length, first rank)."""
    cost = lambda b: sum(s * s for s in b[2])  # noqa: E731  what a step over the container costs
    next_no, used, rows = [0] * len(tiers), {}, []
    for tier, count, slots in sorted(batches, key=lambda b: (b[0], -cost(b), b[2])):
        for slot, n in enumerate(slots):
            rows.append((n, used.get(n, 0), tier, next_no[tier], slot))
            used[n] = used.get(n, 0) + count
        next_no[tier] += count
    rows.sort()
    columns = [np.array(c, np.int64) for c in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 5
    groups = np.array([max(1, -(-n // step)) for n in next_no], np.int64)
    return dict(zip(("length", "rank", "tier", "no", "slot"), columns)) | {"groups": groups}


def _assign(places: dict[str, np.ndarray], names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = np.int64(1) << np.int64(40)  # ranks within one length stay below
        keys = places["length"] * span + places["rank"]
        for batch in batches:
            n, rank = batch.column("n_tokens").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, n * span + rank, "right") - 1
            tier, no = places["tier"][at], places["no"][at] + rank - places["rank"][at]
            groups = places["groups"][tier]
            row, column = no // groups, no % groups
            step = np.where(row % 2 == 0, column, groups - 1 - column)  # to and fro, so that every group gets dear and cheap ones
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array(np.array(names, object)[tier], pa.string()), pa.array(no), pa.array(places["slot"][at].astype(np.int32)), pa.array(step)],
                names=[*batch.schema.names[:-1], "container", "container_no", "slot", "step"],
            )

    return run


def pack(df: DataFrame, item: str, size: str, tiers: Sequence[tuple[str, int]], *, step: int = STEP) -> DataFrame:
    """The container of every item: item, piece, token_from, n_tokens, container, container_no, slot, step.

    Items of ``size`` above the largest capacity are cut into pieces of that capacity and a rest; no other item is
    cut. ``container`` and ``container_no`` identify a container, ``slot`` is the place in it. ``step`` numbers
    groups of up to ``step`` containers of one tier whose costs (sums of squared lengths) are balanced.

    Method: the plan is made on the driver from the number of pieces per length - at most as many numbers as the
    largest capacity - and says for every length which ranks go where; ranks within a length are found in two
    levels (buckets of bounded size, then their offsets), so no task sees a whole length.

    Defined cases: sizes null or below 1 take no room and come with null container, one row each; equal items are
    items of their own; ties are ordered by item, then piece; an empty table gives no rows; without tiers or with a
    capacity below 1 a ValueError is raised. ``item`` should be unique.
    """
    tiers = sorted(tiers, key=lambda t: (t[1], t[0]))
    if not tiers or tiers[0][1] < 1:
        raise ValueError("containers need a capacity of 1 or more")
    top, kind = tiers[-1][1], dict(df.dtypes)[item]
    sized = materialise(df.select(F.col(item).alias("item"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("total")))
    pieces = (
        sized.where("total > 0")
        .select("item", "total", F.explode(F.expr(f"sequence(0, cast((total - 1) div {top} as int))")).alias("piece"))
        .select("item", "piece", (F.col("piece").cast("bigint") * top).alias("token_from"), F.expr(f"least({top}, total - cast(piece as bigint) * {top})").alias("n_tokens"))
    )
    parts = max(1, sized.count() // BUCKET)
    pieces = pieces.withColumn("b", F.pmod(F.xxhash64("item", "piece"), F.lit(parts)))
    counts = pieces.groupBy("n_tokens", "b").agg(F.count(F.lit(1)).alias("c"))
    counts = materialise(counts.withColumn("before", F.sum("c").over(Window.partitionBy("n_tokens").orderBy("b")) - F.col("c")))
    lengths = {r.n_tokens: r.c for r in counts.groupBy("n_tokens").agg(F.sum("c").alias("c")).collect()}
    places = _places(plan_containers(lengths, tiers), tiers, step)

    within = F.row_number().over(Window.partitionBy("n_tokens", "b").orderBy("item", "piece"))
    ranked = pieces.withColumn("r", within).join(counts.select("n_tokens", "b", "before"), ["n_tokens", "b"]).select("item", "piece", "token_from", "n_tokens", (F.col("before") + F.col("r") - 1).alias("rank"))
    placed = ranked.mapInArrow(_assign(places, [n for n, _ in tiers]), f"item {kind}, {PACKED}")
    empty = sized.where("total = 0").select("item", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("token_from"), F.lit(0).cast("bigint").alias("n_tokens"), F.lit(None).cast("string").alias("container"), F.lit(None).cast("bigint").alias("container_no"), F.lit(None).cast("int").alias("slot"), F.lit(None).cast("bigint").alias("step"))
    return placed.unionByName(empty).withColumnRenamed("item", item)


def fill_report(packed: DataFrame, tiers: DataFrame) -> DataFrame:
    """Per kind of container: containers used, items and tokens in them, and the share of room used."""
    used = packed.where("container is not null").groupBy("container").agg(
        F.countDistinct("container_no").alias("n_containers"), F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("tokens")
    )
    return tiers.join(used, "container", "left").select(
        "container", "capacity_tokens", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_containers", "n_pieces", "tokens")),
        F.when(F.col("n_containers") > 0, F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("fill"),
    )
