"""Mixing sources to target weights: min-cost flow from membership patterns to source quotas."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.session import materialise, small

#: Documents of one pattern whose running sum is taken in one task.
BUCKET = 50_000


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    max_repeat: int


class _Flow:
    """Min-cost flow by the primal-dual method: for each path cost in turn, all cheapest paths at once."""

    def __init__(self, n: int) -> None:
        self.arcs: list[list[int]] = []  # to, room, cost
        self.out: list[list[int]] = [[] for _ in range(n)]

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        self.out[a].append(len(self.arcs))
        self.arcs.append([b, room, cost])
        self.out[b].append(len(self.arcs))
        self.arcs.append([a, 0, -cost])
        return len(self.arcs) - 2

    def costs(self, source: int) -> dict[int, int]:
        """Least cost of a path with room from ``source`` to each node it reaches."""
        cost, waiting, listed = {source: 0}, deque([source]), {source}
        while waiting:
            a = waiting.popleft()
            listed.discard(a)
            for e in self.out[a]:
                b, room, c = self.arcs[e]
                if room and cost[a] + c < cost.get(b, 1 << 60):
                    cost[b] = cost[a] + c
                    if b not in listed:
                        listed.add(b)
                        waiting.append(b)
        return cost

    def run(self, source: int, sink: int) -> int:
        total = 0
        while sink in (cost := self.costs(source)):
            while amount := self._push(source, sink, cost):
                total += amount
        return total

    def _push(self, source: int, sink: int, cost: dict[int, int]) -> int:
        """Sends flow along cheapest paths, depth first, leaving a node for good once it leads nowhere."""
        total, left, path, here = 0, {source}, [], source
        turn = dict.fromkeys(cost, 0)
        while True:
            if here == sink:
                amount = min(self.arcs[e][1] for e in path)
                total += amount
                for e in path:
                    self.arcs[e][1] -= amount
                    self.arcs[e ^ 1][1] += amount
                full = next(i for i, e in enumerate(path) if not self.arcs[e][1])
                for e in path[full:]:
                    left.discard(self.arcs[e][0])
                here = self.arcs[path[full] ^ 1][0]
                del path[full:]
                continue
            while turn[here] < len(self.out[here]):
                e = self.out[here][turn[here]]
                b, room, c = self.arcs[e]
                if room and b not in left and cost.get(b) == cost[here] + c:
                    break
                turn[here] += 1
            else:
                if not path:
                    return total
                here = self.arcs[path.pop() ^ 1][0]  # the node left stays marked
                turn[here] += 1
                continue
            path.append(e)
            left.add(b)
            here = b


def _levels(weights: dict[int, int], targets: Sequence[Target]) -> list[tuple[int, int]]:
    return [(mask, r) for mask in sorted(weights) for r in range(1, 1 + max((t.max_repeat for i, t in enumerate(targets) if mask >> i & 1), default=0))]


def _network(weights: dict[int, int], targets: Sequence[Target], quotas: Sequence[int]) -> tuple[_Flow, list[tuple[int, int]], dict[tuple[int, int], int], int, int]:
    """The flow network, its levels, the arcs from (level, source), and its two ends."""
    levels = _levels(weights, targets)
    start, end = len(levels) + len(targets), len(levels) + len(targets) + 1
    flow, drawn = _Flow(end + 1), {}
    for n, (mask, r) in enumerate(levels):
        flow.arc(start, n, weights[mask], r - 1)
        for i, t in enumerate(targets):
            if mask >> i & 1 and t.max_repeat >= r:
                drawn[n, i] = flow.arc(n, len(levels) + i, weights[mask], 0)
    for i, quota in enumerate(quotas):
        flow.arc(len(levels) + i, end, quota, 0)
    return flow, levels, drawn, start, end


def largest_total(weights: dict[int, int], targets: Sequence[Target]) -> int:
    """The most tokens that can be drawn with exact shares, from the tokens of each pattern (a bit mask of targets).

    A target without any token to draw doesn't count; what its share would be stays out of the total drawn.
    Found by the flow itself: a total is tried, and if some quotas can't be met, the sources on the sink's side of
    the least cut are those that lack tokens; what these can draw, over their share, is the next, smaller total.
    Each step meets a new cut, and few are needed.
    """
    def room(chosen: set[int]) -> int:
        return sum(w * max((t.max_repeat for i, t in enumerate(targets) if i in chosen and mask >> i & 1), default=0) for mask, w in weights.items())

    wanted = {i for i, t in enumerate(targets) if t.share > 0 and room({i}) > 0}
    total = min((int(room({i}) / targets[i].share) for i in wanted), default=0)
    while total > 0:
        quotas = [int(total * t.share) if i in wanted else 0 for i, t in enumerate(targets)]
        flow, levels, _, start, end = _network(weights, targets, quotas)
        if flow.run(start, end) >= sum(quotas):
            return total
        # Sources from whose quota something is missing, and all whose tokens they already compete for.
        lacking = [i for i in range(len(targets)) if (e := flow.arcs[flow.out[len(levels) + i][-1]])[1] > 0]
        seen, waiting = set(len(levels) + i for i in lacking), deque(len(levels) + i for i in lacking)
        while waiting:
            b = waiting.popleft()
            for e in flow.out[b]:
                a = flow.arcs[e][0]
                if flow.arcs[e ^ 1][1] and a not in seen and a not in (start, end):
                    seen.add(a)
                    waiting.append(a)
        chosen = {i for i in range(len(targets)) if len(levels) + i in seen}
        total = min(total - 1, int(room(chosen) / sum(targets[i].share for i in chosen)))
    return 0


def route(weights: dict[int, int], targets: Sequence[Target], total: int) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Tokens that (pattern, repetition) gives to sources: {(mask, level): [(source index, tokens), ...]}.

    Level r is the r-th use of a pattern's documents; each level costs one more than the last (convex), so
    documents are repeated only where first uses don't suffice. Only sources with max_repeat >= r draw from it.
    """
    flow, levels, drawn, start, end = _network(weights, targets, [round(total * t.share) for t in targets])
    flow.run(start, end)
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for (n, i), e in drawn.items():
        if amount := flow.arcs[e ^ 1][1]:
            out.setdefault(levels[n], []).append((i, amount))
    return out


def source_name(source: Column | str) -> Column:
    """A source's plain name: lower case, without blanks around it, with one underscore for any gap."""
    return F.regexp_replace(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")), r"[\s_-]+", "_")


def mix(df: DataFrame, item: str, text: str, source: str, size: str, targets: Sequence[Target], *, total: int | None = None, seed: int = 42) -> DataFrame:
    """The drawn items: item, source (for which it is drawn), uses, n_tokens (of one use).

    An item belongs to every target source under which its exact text occurs, so sources may overlap. ``total`` is
    the number of tokens to draw; None takes the most that allows exact shares of the targets that have any tokens.
    A source's items are used at most its ``max_repeat`` times for it.

    Method: items are grouped by membership pattern; the flow from pattern levels to quotas, solved on the driver
    over the totals of the patterns that occur (subsets of at most 62 targets), says how many tokens each pattern
    gives to each source at each repetition; items fill these amounts in the order of a seeded hash, by running
    sums taken in two levels (buckets of bounded size, then their offsets), whole items only: an item goes where
    its middle lies. So a source misses its amount by half an item per pattern and level at most.

    Defined cases: sources are compared by ``source_name``; items whose source is null or has no target are drawn
    only if their text occurs under a target; items of size null or below 1 and null texts are never drawn; equal
    texts are items of their own; an empty table or no targets give no rows. ``item`` should be unique.
    """
    if len(targets) > 62:
        raise ValueError("at most 62 targets")
    spark, kind = df.sparkSession, dict(df.dtypes)[item]
    result = f"item {kind}, source string, uses bigint, n_tokens bigint"
    targets = sorted(targets, key=lambda t: t.source)
    bits = [F.lit(x) for i, t in enumerate(targets) for x in (t.source, 1 << i)]
    bit = F.coalesce(F.try_element_at(F.create_map(*bits), source_name(source)), F.lit(0)) if targets else F.lit(0)
    # Sizes may come from a tokenizer: they are written before anything filters on them, so that each text is read once.
    sized = materialise(df.select(F.col(item).alias("item"), F.sha2(F.col(text), 256).alias("h"), F.col(size).cast("bigint").alias("n_tokens"), bit.cast("bigint").alias("own")))
    rows = sized.where("h is not null and n_tokens > 0")
    shared = materialise(rows.groupBy("h").agg(F.bit_or("own").alias("mask"), F.bit_and("own").alias("least")).where("mask <> least").select("h", "mask"))
    member = rows.join(small(shared), "h", "left").select("item", "n_tokens", F.coalesce("mask", "own").alias("mask")).where("mask <> 0")
    parts = max(1, rows.count() // BUCKET)
    order = F.xxhash64(F.col("item"), F.lit(seed))
    member = member.withColumn("o", order).withColumn("b", F.pmod("o", F.lit(parts)))
    sums = member.groupBy("mask", "b").agg(F.sum("n_tokens").alias("w"))
    sums = materialise(sums.withColumn("before", F.sum("w").over(Window.partitionBy("mask").orderBy("b")) - F.col("w")))
    weights = {r.mask: r.w for r in sums.groupBy("mask").agg(F.sum("w").alias("w")).collect()}
    amount = largest_total(weights, targets) if total is None else total
    segments = []  # mask, source, from, to: at most levels x sources rows a pattern
    for (mask, _), parts_of in route(weights, targets, amount).items():
        at = 0
        for i, n in parts_of:
            segments.append((mask, targets[i].source, at, at + n))
            at += n
    if not segments:
        return spark.createDataFrame([], result).withColumnRenamed("item", item)
    table = spark.createDataFrame(segments, "mask bigint, source string, a bigint, z bigint")
    running = F.sum("n_tokens").over(Window.partitionBy("mask", "b").orderBy("o", "item").rowsBetween(Window.unboundedPreceding, 0))
    placed = member.withColumn("run", running).join(sums.select("mask", "b", "before"), ["mask", "b"]).withColumn("middle", 2 * (F.col("before") + F.col("run")) - F.col("n_tokens"))
    drawn = placed.join(F.broadcast(table), "mask").where("middle >= 2 * a and middle < 2 * z")
    return drawn.groupBy("item", "source").agg(F.count(F.lit(1)).alias("uses"), F.max("n_tokens").alias("n_tokens")).select(F.col("item").alias(item), "source", "uses", "n_tokens")


def share_report(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: items, most uses of one, tokens drawn and the share they make up."""
    got = materialise(drawn.groupBy("source").agg(F.count(F.lit(1)).alias("n_items"), F.max("uses").alias("most_uses"), F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens")))
    total = got.agg(F.sum("tokens")).first()[0] or 0
    joined = targets.join(got, "source", "left")
    share = F.coalesce("tokens", F.lit(0)) / F.lit(float(total)) if total else F.lit(0.0)
    return joined.select("source", "target_share", "max_repeat", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_items", "most_uses", "tokens")), share.alias("actual_share"))
