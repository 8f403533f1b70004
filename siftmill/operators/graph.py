"""Graphs as edge tables (a < b): co-occurrence, components, labels, betweenness, modularity, divisive communities.

Loops write each round's state once and keep only counts on the driver. Betweenness and divisive communities of a
graph of at most ``HELD_EDGES`` edges, which are counted, hold it as arrays in every task and distribute the roots;
larger graphs go level by level through joins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.operators.similarity import overlapping_pairs
from siftmill.session import discard, materialise

#: Edges of a graph that a task or the driver may hold (some 24 bytes each).
HELD_EDGES = 2_000_000
#: Roots times edges that are walked on the driver rather than in a job of their own.
QUICK = 3_000_000


def cooccurrence_edges(df: DataFrame, vertex: str, shared: str, least: int = 7) -> DataFrame:
    """Edges a < b between vertices that share at least ``least`` values; lone vertices are in no edge."""
    return overlapping_pairs(df, vertex, shared, least).select("a", "b", F.col("n_ab").cast("long").alias("shared"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionAll(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, label) after synchronous rounds: each vertex takes its neighbours' most frequent label, ties the smallest."""
    links = materialise(both_ways(edges))
    labels = materialise(vertices(edges).withColumn("label", F.col("id")))
    for _ in range(rounds):
        votes = links.join(labels.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id"), "label").agg(F.count(F.lit(1)).alias("n"))
        new = materialise(votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).getField("label").alias("label")))
        discard(labels)
        labels = new
    return labels


def communities(labels: DataFrame, label: str = "label") -> DataFrame:
    """Members of every community in order: (size, members)."""
    return labels.groupBy(label).agg(F.sort_array(F.collect_list("id")).alias("members")).select(F.size("members").alias("size"), "members")


def connected_components(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, component): the smallest id reachable. Each round takes the least label of the neighbours and of the
    label's own label, so long paths shorten by jumps; the loop ends when nothing changes."""
    links = materialise(both_ways(edges))
    state = materialise((ids if ids is not None else vertices(edges)).withColumn("component", F.col("id")))
    while True:
        near = links.join(state.select(F.col("id").alias("src"), "component"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("near"))
        stepped = state.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        stepped = materialise(stepped)
        jump = stepped.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = materialise(stepped.join(jump, "component", "left").select("id", "old", F.least("component", "further").alias("component")))
        changed = not new.where("old <> component").isEmpty()
        discard(state, stepped)
        state = new.drop("old")
        state._siftmill_path = new._siftmill_path
        if not changed:
            discard(links)
            return state


def shortest_paths(edges: DataFrame) -> DataFrame:
    """(root, node, level, sigma): distance and number of shortest paths from every vertex, level by level."""
    links = materialise(both_ways(edges))
    start = vertices(edges).select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("level"), F.lit(1.0).alias("sigma"))
    levels = [materialise(start)]
    seen = levels[0].select("root", "node")
    while True:
        step = levels[-1].join(links, F.col("node") == F.col("src")).groupBy("root", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma"))
        new = materialise(step.join(seen, ["root", "node"], "left_anti").select("root", "node", F.lit(len(levels)).alias("level"), "sigma"))
        if new.isEmpty():
            break
        levels.append(new)
        # A new level's vertices touch the last two levels only.
        seen = levels[-1].select("root", "node").unionAll(levels[-2].select("root", "node"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionAll(x)
    return out


class _Held:
    """A graph as arrays: names of the vertices, ends of the edges, and each vertex's neighbours and edges."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: int) -> None:
        self.a, self.b, self.n = a, b, n
        ends, other, edge = np.append(a, b), np.append(b, a), np.tile(np.arange(len(a)), 2)
        order = np.lexsort((other, ends))
        self.near, self.edge = other[order], edge[order]
        self.start = np.append(0, np.cumsum(np.bincount(ends, minlength=n)))

    @classmethod
    def of(cls, edges: DataFrame) -> tuple[_Held, np.ndarray]:
        table = edges.select("a", "b").orderBy("a", "b").toArrow()
        a, b = (np.array(table.column(c).to_pylist(), object) for c in ("a", "b"))
        names, codes = np.unique(np.append(a, b), return_inverse=True)
        return cls(codes[: len(a)], codes[len(a) :], len(names)), names

    def credits(self, roots: np.ndarray) -> np.ndarray:
        """Credit of every edge, summed over the shortest paths from ``roots``."""
        out = np.zeros(len(self.a))
        level, sigma, credit = np.full(self.n, -1), np.zeros(self.n), np.zeros(self.n)
        for root in roots:
            level[:], sigma[:], credit[:] = -1, 0, 0
            level[root], sigma[root] = 0, 1
            front, steps = np.array([root]), []
            while len(front):
                size = self.start[front + 1] - self.start[front]
                at = np.repeat(self.start[front] - np.cumsum(size) + size, size) + np.arange(size.sum())
                u, v = np.repeat(front, size), self.near[at]
                front = np.unique(v[level[v] < 0])
                level[front] = len(steps) + 1
                down = level[v] == len(steps) + 1
                u, v, e = u[down], v[down], self.edge[at[down]]
                np.add.at(sigma, v, sigma[u])
                steps.append((u, v, e))
            for u, v, e in reversed(steps):
                flow = (credit[v] + 1) * sigma[u] / sigma[v]
                np.add.at(credit, u, flow)
                out[e] += flow
        return out

    def betweenness(self, spark, roots: np.ndarray) -> np.ndarray:
        """Scores by ``roots``, whose tasks each give one sum per edge. Summed exactly, so the tasks don't matter."""
        if len(roots) * len(self.a) <= QUICK:
            return self.credits(roots) / 2
        graph = self

        def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            score = sum((graph.credits(b.column(0).to_numpy()) for b in batches), np.zeros(len(graph.a)))
            e = np.flatnonzero(score)
            yield pa.record_batch([pa.array(e), pa.array(score[e])], names=["e", "score"])

        parts = min(len(roots), 4 * spark.sparkContext.defaultParallelism)
        table = spark.createDataFrame([(int(r),) for r in roots], "root bigint").repartition(parts)
        rows = table.mapInArrow(walk, "e bigint, score double").groupBy("e").agg(F.sum("score").alias("score")).toArrow()
        out = np.zeros(len(self.a))
        out[rows.column("e").to_numpy()] = rows.column("score").to_numpy()
        return out / 2

    def components(self, keep: np.ndarray) -> np.ndarray:
        """The least vertex that each one reaches over the edges ``keep``: labels sink and paths are halved until nothing changes."""
        label, a, b = np.arange(self.n), self.a[keep], self.b[keep]
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            for x in (a, b, label[a], label[b]):
                np.minimum.at(new, x, low)
            new = new[new]
            if (new == label).all():
                return label
            label = new


def edge_betweenness(edges: DataFrame) -> DataFrame:
    """(a, b, score): over all vertex pairs, the share of shortest paths that use the edge.

    From every root, numbers of shortest paths go down level by level and credits come back: an edge from a parent
    p to a child c carries (credit(c) + 1) * sigma(p) / sigma(c); scores are halved, as each path is seen from both
    ends. A graph of at most ``HELD_EDGES`` edges is walked in the tasks' memory, the roots being distributed.
    """
    edges = materialise(edges.select("a", "b"))
    if edges.count() > HELD_EDGES:
        return joined_betweenness(edges)
    spark = edges.sparkSession
    graph, names = _Held.of(edges)
    score = graph.betweenness(spark, np.arange(graph.n))
    table = pa.table([pa.array(names[graph.a].tolist(), pa.string()), pa.array(names[graph.b].tolist(), pa.string()), pa.array(score)], names=["a", "b", "score"])
    kind = edges.schema["a"].dataType
    return spark.createDataFrame(table).select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "score")


def joined_betweenness(edges: DataFrame) -> DataFrame:
    """As ``edge_betweenness``, for graphs of any size: joins per level over all roots, (vertices squared) rows in all."""
    paths = materialise(shortest_paths(edges))
    links = materialise(both_ways(edges))
    depth = paths.agg(F.max("level")).first()[0] or 0
    credit, flows = None, []
    for level in range(depth, 0, -1):
        child = paths.where(F.col("level") == level).select("root", F.col("node").alias("c"), F.col("sigma").alias("sc"))
        if credit is not None:
            child = child.join(credit, ["root", "c"], "left")
        child = child.withColumn("credit", F.coalesce("credit", F.lit(0.0)) if credit is not None else F.lit(0.0))
        parent = paths.where(F.col("level") == level - 1).select("root", F.col("node").alias("p"), F.col("sigma").alias("sp"))
        flow = child.join(links, F.col("c") == F.col("src")).select("root", "c", "sc", "credit", F.col("dst").alias("p")).join(parent, ["root", "p"])
        flow = materialise(flow.select("root", "p", "c", ((F.col("credit") + 1) * F.col("sp") / F.col("sc")).alias("flow")))
        flows.append(flow)
        credit = flow.groupBy("root", F.col("p").alias("c")).agg(F.sum("flow").alias("credit"))
    if not flows:
        return edges.select("a", "b", F.lit(0.0).alias("score"))
    every = flows[0]
    for x in flows[1:]:
        every = every.unionAll(x)
    return every.groupBy(F.least("p", "c").alias("a"), F.greatest("p", "c").alias("b")).agg((F.sum("flow") / 2).alias("score"))


def modularity(parts: DataFrame, edges: DataFrame, label: str = "component") -> DataFrame:
    """Q of a partition (id, label) of the graph: sum over communities of inner edges / m - (degree sum / 2m)^2."""
    m = edges.count()
    p, q = (parts.select(F.col("id").alias(x), F.col(label).alias(f"l{x}")) for x in ("a", "b"))
    inner = edges.join(p, "a").join(q, "b").where("la = lb").groupBy(F.col("la").alias("l")).agg(F.count(F.lit(1)).alias("inner"))
    degree = edges.select(F.explode(F.array("a", "b")).alias("id")).join(parts.select("id", F.col(label).alias("l")), "id").groupBy("l").agg(F.count(F.lit(1)).alias("d"))
    terms = degree.join(inner, "l", "left").select((F.coalesce("inner", F.lit(0)) / F.lit(float(m)) - F.pow(F.col("d") / F.lit(2.0 * m), F.lit(2))).alias("q"))
    return terms.agg(F.coalesce(F.sum("q"), F.lit(0.0)).alias("q"))


def divide(edges: DataFrame, *, max_rounds: int | None = None) -> tuple[DataFrame, list[tuple[int, int, float]]]:
    """Divisive communities: drop all edges of highest betweenness (ties within 1e-9), split, score against the whole
    graph, until no edge is left or ``max_rounds``. Gives the partition of the first best modularity, and the log
    of rounds (round, edges left, Q)."""
    whole = materialise(edges.select("a", "b"))
    if whole.count() <= HELD_EDGES:
        return _divide_held(whole, max_rounds)
    ids = materialise(vertices(whole))
    best = connected_components(whole, ids)
    best_q = modularity(best, whole).first()[0]
    log, left = [(0, whole.count(), best_q)], whole
    while log[-1][1] and (max_rounds is None or len(log) <= max_rounds):
        scores = materialise(joined_betweenness(left))
        top = scores.agg(F.max("score")).first()[0]
        left = materialise(scores.where(F.col("score") < top * (1 - 1e-9)).select("a", "b"))
        parts = connected_components(left, ids)
        q = modularity(parts, whole).first()[0]
        log.append((len(log), left.count(), q))
        if q > best_q + 1e-12:
            best, best_q = parts, q
    return best, log


def _divide_held(whole: DataFrame, max_rounds: int | None) -> tuple[DataFrame, list[tuple[int, int, float]]]:
    """The rounds of ``divide`` on a held graph: a round walks only from the vertices of components that lost edges."""
    graph, names = _Held.of(whole)
    m, degree = len(graph.a), np.bincount(np.append(graph.a, graph.b), minlength=graph.n)

    def quality(label: np.ndarray) -> float:
        inner = label[graph.a] == label[graph.b]
        return float(inner.sum() / m - (np.bincount(label, degree) / (2 * m)).astype(float) @ (np.bincount(label, degree) / (2 * m))) if m else 0.0

    alive = np.ones(m, bool)
    label = best = graph.components(alive)
    best_q = quality(label)
    log, score, stale = [(0, m, best_q)], np.zeros(m), np.ones(graph.n, bool)
    while alive.any() and (max_rounds is None or len(log) <= max_rounds):
        fresh = alive & stale[graph.a]
        if fresh.any():
            e = np.flatnonzero(fresh)
            part = _Held(graph.a[e], graph.b[e], graph.n)
            score[e] = part.betweenness(whole.sparkSession, np.unique(np.append(part.a, part.b)))
        gone = alive & (score >= score[alive].max() * (1 - 1e-9))
        alive &= ~gone
        hit = np.isin(label, label[graph.a[gone]])  # the components that lost an edge
        label, stale = graph.components(alive), hit
        q = quality(label)
        log.append((len(log), int(alive.sum()), q))
        if q > best_q + 1e-12:
            best, best_q = label, q
    kind = whole.schema["a"].dataType
    table = pa.table([pa.array(names.tolist(), pa.string()), pa.array(names[best].tolist() if m else [], pa.string())], names=["id", "component"])
    return whole.sparkSession.createDataFrame(table).select(F.col("id").cast(kind).alias("id"), F.col("component").cast(kind).alias("component")), log


def ranked_edges(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.desc("score"), "a", "b")
