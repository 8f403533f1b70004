"""k-means and incremental clustering by summaries over chunks. Points are rows (id, features array<double>).

Only centres and summaries - k or a few times k rows - are on the driver; points stay in tables, whose batches are
reduced as matrices before anything is shuffled. Points of at most ``HELD_VALUES`` coordinates in all, which are
counted, are clustered in memory, without a job for every round.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.session import append, folder, materialise, read_folder, small

#: Coordinates (8 bytes each) that the driver may hold, and that one distance matrix may take.
HELD_VALUES, MATRIX_VALUES = 4_000_000, 4_000_000
#: Clusters whose sums a task holds before it hands them on.
HELD_CLUSTERS = 10_000

ROUNDS = "round int, discard_sets int, discard_points bigint, compression_sets int, compression_points bigint, retained_points bigint"


def _matrix(features: pa.Array) -> np.ndarray:
    """The features of a batch as rows."""
    n = len(features)
    return features.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 0))


def _nearest(x: np.ndarray, centres: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of every row, ties to the smaller index, and its distance; coordinates may be weighted per centre."""
    index, distance = np.zeros(len(x), np.int32), np.zeros(len(x))
    step = max(1, MATRIX_VALUES // max(1, centres.size))
    for at in range(0, len(x), step):
        square = (x[at : at + step, None, :] - centres) ** 2
        d = (square if weights is None else square * weights).sum(2)
        index[at : at + step] = d.argmin(1)
        distance[at : at + step] = np.sqrt(d[np.arange(len(d)), index[at : at + step]])
    return index, distance


def _added(points: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([*points.schema.fields, *fields])


def assign(points: DataFrame, centres: list[list[float]]) -> DataFrame:
    """Adds cluster and distance of the nearest centre by Euclidean distance, ties to the smaller index."""
    c, at = np.array(centres, float), points.columns.index("features")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, distance = _nearest(_matrix(batch.column(at)), c) if batch.num_rows else (np.zeros(0, np.int32), np.zeros(0))
            yield pa.record_batch([*batch.columns, pa.array(index), pa.array(distance)], names=[*batch.schema.names, "cluster", "distance"])

    return points.mapInArrow(run, _added(points, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.DoubleType())))


def _sums(index: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, sums and sums of squares of each of ``k`` clusters."""
    order = np.argsort(index, kind="stable")
    index, x = index[order], x[order]
    n, s, ss = np.bincount(index, minlength=k), np.zeros((k, x.shape[1])), np.zeros((k, x.shape[1]))
    at = np.flatnonzero(np.append(True, index[1:] != index[:-1])) if len(index) else np.zeros(0, int)
    if len(at):
        s[index[at]], ss[index[at]] = np.add.reduceat(x, at), np.add.reduceat(x * x, at)
    return n, s, ss


def _summary_rows(keys: pa.Array, n: np.ndarray, s: np.ndarray, ss: np.ndarray) -> pa.RecordBatch:
    lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))
    return pa.record_batch([keys, pa.array(n.astype(np.int64)), lists(s), lists(ss)], names=["cluster", "n", "s", "ss"])


def summaries(points: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, n, s, ss): number, and sums and sums of squares per dimension, one row per task and cluster in the shuffle."""
    kind = points.schema[cluster].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def merged() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column("cluster").combine_chunks().dictionary_encode(null_encoding="encode")
            index = keys.indices.to_numpy(zero_copy_only=False)
            values = (table.column("n").to_numpy().astype(float), _matrix(table.column("s").combine_chunks()), _matrix(table.column("ss").combine_chunks()))
            n, s, ss = (np.zeros((len(keys.dictionary), *m.shape[1:])) for m in values)
            for total, m in zip((n, s, ss), values):
                np.add.at(total, index, m)
            return _summary_rows(keys.dictionary, n, s, ss)

        for batch in batches:
            if batch.num_rows:
                keys = batch.column(0).dictionary_encode(null_encoding="encode")
                held.append(_summary_rows(keys.dictionary, *_sums(keys.indices.to_numpy(zero_copy_only=False), _matrix(batch.column(1)), len(keys.dictionary))))
                if len(held) > 50 or sum(b.num_rows for b in held) > HELD_CLUSTERS:
                    held = [merged()]
                    if held[0].num_rows > HELD_CLUSTERS:
                        yield held.pop()
        if held:
            yield merged()

    schema = T.StructType([T.StructField("cluster", kind), T.StructField("n", T.LongType()), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("s", "ss"))])
    return merge_summaries(points.select(cluster, F.col("features").cast("array<double>").alias("features")).mapInArrow(run, schema))


def merge_summaries(parts: DataFrame) -> DataFrame:
    """Adds up summaries of one cluster."""
    cells = parts.select("cluster", "n", F.posexplode(F.arrays_zip("s", "ss")).alias("dim", "v"))
    sums = cells.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("v.s").alias("s"), F.sum("v.ss").alias("ss"))
    rows = sums.groupBy("cluster").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "s", "ss"))).alias("_c"))
    return rows.select("cluster", "n", F.col("_c.s").alias("s"), F.col("_c.ss").alias("ss"))


def centre(n: Column, s: Column) -> Column:
    return F.transform(s, lambda x: x / n)


def variance(n: Column, s: Column, ss: Column) -> Column:
    """Per dimension, never below 0."""
    return F.zip_with(s, ss, lambda a, b: F.greatest(b / n - (a / n) * (a / n), F.lit(0.0)))


def _farthest(ids: pa.Array, x: np.ndarray, centres: np.ndarray) -> tuple[float, object, np.ndarray] | None:
    """The row farthest from all centres, ties to the least id."""
    if not len(x):
        return None
    _, d = _nearest(x, centres)
    best = np.flatnonzero(d == d.max())
    at = min(best.tolist(), key=lambda i: ids[i].as_py())
    return float(d[at]), ids[at].as_py(), x[at]


def _held(points: DataFrame) -> pa.Table | None:
    """Points of bounded size as an Arrow table, else None."""
    first = points.select(F.size("features").alias("d")).first()
    if first is None or points.count() * max(1, first.d) > HELD_VALUES:
        return None
    return points.select("id", F.col("features").cast("array<double>").alias("features")).orderBy("id").toArrow().combine_chunks()


def farthest_first(points: DataFrame, k: int) -> list[list[float]]:
    """Initial centres: the point of least id, then again and again the point farthest from all so far (ties: least id)."""
    points = points.select("id", F.col("features").cast("array<double>").alias("features"))
    held = _held(points)
    if held is not None:
        ids, x = held.column("id").combine_chunks(), _matrix(held.column("features").combine_chunks())
        first = x[0].tolist() if len(x) else None
    else:
        first = points.agg(F.min_by("features", "id")).first()[0]
    centres = [list(first)] if first is not None else []
    while centres and len(centres) < k:
        c = np.array(centres)
        if held is not None:
            distance, _, far = _farthest(ids, x, c)
        else:

            def run(batches: Iterable[pa.RecordBatch], c: np.ndarray = c) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if (found := _farthest(b.column(0), _matrix(b.column(1)), c)) is not None:
                        yield pa.record_batch([pa.array([-found[0]]), pa.array([found[1]], b.schema.types[0]), pa.array([found[2].tolist()])], names=["d", "id", "features"])

            schema = T.StructType([T.StructField("d", T.DoubleType()), *points.schema.fields])
            m = points.mapInArrow(run, schema).agg(F.min(F.struct("d", "id", "features")).alias("m")).first().m
            distance, far = -m.d, np.array(m.features)
        if not distance:
            break
        centres.append(far.tolist())
    return centres


def lloyd_step(points: DataFrame, centres: list[list[float]]) -> list[list[float]]:
    """The means of the points nearest to each centre; a centre without points stays. A task sends one row per centre."""
    new = [list(c) for c in centres]
    for r in summaries(assign(points.select("id", "features"), centres)).collect():
        new[r.cluster] = [x / r.n for x in r.s]
    return new


def kmeans(points: DataFrame, k: int, *, max_rounds: int = 1000, tolerance: float = 0.0) -> tuple[DataFrame, list[list[float]]]:
    """Points with their cluster, and the centres. With k or fewer distinct points each distinct point is its own cluster.

    The points are written once; a round reads them as matrices. Points that fit ``HELD_VALUES`` go through the
    same rounds in memory.
    """
    if getattr(points, "_siftmill_path", None) is None:
        points = materialise(points)
    centres = farthest_first(points, k)
    if not centres:
        return points.withColumn("cluster", F.lit(0)).withColumn("distance", F.lit(0.0)), []
    if len(centres) == k:
        held = _held(points)
        x = _matrix(held.column("features").combine_chunks()) if held is not None else None
        for _ in range(max_rounds):
            if x is not None:
                c = np.array(centres)
                n, s, _ = _sums(_nearest(x, c)[0], x, k)
                new = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c).tolist()
            else:
                new = lloyd_step(points, centres)
            shift = max(math.dist(a, b) for a, b in zip(new, centres))
            centres = new
            if shift <= tolerance:
                break
    return assign(points, centres), centres


def split_by_size(clustered: DataFrame, above: int) -> tuple[DataFrame, DataFrame]:
    """Points of clusters with more than ``above`` points, and the others."""
    sizes = small(materialise(clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > above).select("cluster")))
    return clustered.join(sizes, "cluster", "left_semi"), clustered.join(sizes, "cluster", "left_anti")


@dataclass
class Summary:
    """A cluster on the driver: key, number of points, sums and sums of squares per dimension."""

    key: int
    n: int
    s: list[float]
    ss: list[float]

    @property
    def mean(self) -> list[float]:
        return [x / self.n for x in self.s]

    @property
    def var(self) -> list[float]:
        return [max(b / self.n - (a / self.n) ** 2, 0.0) for a, b in zip(self.s, self.ss)]

    def add(self, other: Summary) -> None:
        self.n += other.n
        self.s = [a + b for a, b in zip(self.s, other.s)]
        self.ss = [a + b for a, b in zip(self.ss, other.ss)]


def assign_summaries(points: DataFrame, sets: list[Summary]) -> DataFrame:
    """Adds ``key`` of the nearest summary within 2 sqrt(d) standard deviations, else null; summaries stay frozen."""
    if not sets:
        return points.withColumn("key", F.lit(None).cast("int"))
    means, weights = np.array([s.mean for s in sets]), 1 / np.maximum(np.array([s.var for s in sets]), 1e-12)
    keys, at = np.array([s.key for s in sets], np.int32), points.columns.index("features")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, d = _nearest(_matrix(batch.column(at)), means, weights) if batch.num_rows else (np.zeros(0, np.int32), np.zeros(0))
            yield pa.record_batch([*batch.columns, pa.array(keys[index], mask=d > 2 * math.sqrt(means.shape[1]))], names=[*batch.schema.names, "key"])

    return points.mapInArrow(run, _added(points, T.StructField("key", T.IntegerType())))


def merge_close(sets: list[Summary]) -> dict[int, int]:
    """Merges, closest first, summaries whose centres are within 2 sqrt(d) of each other both ways; gives old to new keys.

    Summaries are few, so this runs on the driver; a merge updates only the distances of the set that grew.
    """
    if len(sets) < 2:
        return {}
    moved: dict[int, int] = {}
    means, weights = np.array([s.mean for s in sets]), 1 / np.maximum(np.array([s.var for s in sets]), 1e-12)

    def apart(i: int) -> np.ndarray:
        """The larger of the distances from set i to each other one and back."""
        square = (means - means[i]) ** 2
        return np.sqrt(np.maximum((square * weights[i]).sum(1), (square * weights).sum(1)))

    d = np.array([apart(i) for i in range(len(sets))])
    np.fill_diagonal(d, np.inf)
    while len(sets) > 1:
        i, j = divmod(int(d.argmin()), len(sets))  # d is symmetric: the first is the pair with i < j
        if d[i, j] > 2 * math.sqrt(means.shape[1]):
            break
        gone = sets.pop(j)
        sets[i].add(gone)
        means, weights, d = np.delete(means, j, 0), np.delete(weights, j, 0), np.delete(np.delete(d, j, 0), j, 1)
        means[i], weights[i] = sets[i].mean, 1 / np.maximum(sets[i].var, 1e-12)
        d[i] = d[:, i] = apart(i)
        d[i, i] = np.inf
        moved = {k: sets[i].key if v == gone.key else v for k, v in moved.items()} | {gone.key: sets[i].key}
    return moved


@dataclass
class ChunkedClustering:
    """Clustering of chunks that arrive one after another, with discard, compression and retained sets.

    ``feed`` takes a chunk: points near a discard or compression summary (frozen for the chunk) join it, the others
    are clustered with the retained points; clusters of several points become compression sets, single points are
    retained, and close compression sets merge. The first chunk seeds the discard sets. ``finish`` moves every
    compression set into the nearest discard set and tests the retained points once more.
    """

    k: int = 10
    max_rounds: int = 1000
    discard: list[Summary] = field(default_factory=list)
    compression: list[Summary] = field(default_factory=list)
    retained: DataFrame | None = None
    members: str | None = None
    moved: dict[int, int] = field(default_factory=dict)
    stats: list[tuple] = field(default_factory=list)
    #: A folder of CSV files to which every round's statistics are appended when the round is over.
    rounds_path: str | None = None
    _next: int = 0

    def _new_sets(self, clustered: DataFrame) -> tuple[list[Summary], DataFrame]:
        rows = summaries(clustered).collect()
        keys = {r.cluster: self._next + i for i, r in enumerate(sorted(rows, key=lambda r: r.cluster))}
        self._next += len(rows)
        labels = F.element_at(F.from_json(F.lit(json.dumps([keys.get(i, -1) for i in range(max(keys, default=-1) + 1)])), "array<int>"), F.col("cluster") + 1)
        return [Summary(keys[r.cluster], r.n, list(r.s), list(r.ss)) for r in sorted(rows, key=lambda r: r.cluster)], clustered.select("id", labels.alias("key"))

    def _keep(self, labels: DataFrame) -> None:
        """Appends (id, key) to the one folder of all labelled points."""
        self.members = self.members or folder(labels.sparkSession, "members")
        append(labels, self.members)

    def _split_rest(self, rest: DataFrame) -> None:
        """Clusters points outside all sets: several together form compression sets, single ones are retained."""
        clustered, _ = kmeans(rest, self.k, max_rounds=self.max_rounds)
        many, single = split_by_size(materialise(clustered), 1)
        sets, labels = self._new_sets(many)
        self.compression += sets
        self._keep(labels)
        self.retained = materialise(single.select("id", "features"))

    def _absorb(self, points: DataFrame, sets: list[Summary]) -> DataFrame:
        """Adds points near ``sets`` to them and returns the others."""
        near = materialise(assign_summaries(points.select("id", "features"), sets))
        by_key = {s.key: s for s in sets}
        joined = near.where("key is not null")
        for r in summaries(joined, "key").collect():
            by_key[r.cluster].add(Summary(r.cluster, r.n, list(r.s), list(r.ss)))
        self._keep(joined.select("id", "key"))
        return near.where("key is null").select("id", "features")

    def _report(self, spark) -> None:
        if self.rounds_path and self.stats:
            spark.createDataFrame(self.stats[-1:], ROUNDS).write.mode("append").option("header", True).csv(self.rounds_path)

    def feed(self, chunk: DataFrame) -> None:
        self._report(chunk.sparkSession)  # of the round before: the last one's changes at the end
        chunk = materialise(chunk.select("id", "features"))
        if not self.discard:
            clustered, _ = kmeans(chunk, self.k, max_rounds=self.max_rounds)
            inner, outer = split_by_size(materialise(clustered), self.k)
            again, _ = kmeans(materialise(inner.select("id", "features")), self.k, max_rounds=self.max_rounds)
            self.discard, labels = self._new_sets(materialise(again))
            self._keep(labels)
            self._split_rest(materialise(outer.select("id", "features")))
        else:
            rest = self._absorb(self._absorb(chunk, self.discard), self.compression)
            self._split_rest(materialise(rest.unionByName(self.retained)))
        self._record(merge_close(self.compression))
        self._count()

    def _record(self, moves: dict[int, int]) -> None:
        self.moved = {a: moves.get(b, b) for a, b in self.moved.items()} | moves

    def _count(self) -> None:
        self.stats.append((len(self.stats) + 1, len(self.discard), sum(s.n for s in self.discard), len(self.compression), sum(s.n for s in self.compression), self.retained.count()))

    def finish(self) -> None:
        moves = {}
        for c in self.compression:
            best = min(self.discard, key=lambda d: (math.dist(c.mean, d.mean), d.key)) if self.discard else None
            if best is not None:
                best.add(c)
                moves[c.key] = best.key
        self._record(moves)
        self.compression = []
        self.retained = materialise(self._absorb(self.retained, self.discard))
        if self.stats:
            self.stats.pop()
        self._count()
        self._report(self.retained.sparkSession)

    def labels(self) -> DataFrame:
        """(id, cluster): the discard set of every point, -1 for retained ones."""
        out = self.retained.select("id", F.lit(-1).alias("cluster"))
        order = {s.key: i for i, s in enumerate(self.discard)}
        final = [order.get(self.moved.get(k, k), -1) for k in range(self._next)]
        target = F.element_at(F.from_json(F.lit(json.dumps(final)), "array<int>"), F.col("key") + 1)
        if self.members:
            out = out.unionByName(read_folder(out.sparkSession, self.members).select("id", target.alias("cluster")))
        return out

    def rounds(self, spark) -> DataFrame:
        return spark.createDataFrame(self.stats, ROUNDS)


def cluster_chunks(points: DataFrame, *, chunk: str = "chunk", k: int = 10, max_rounds: int = 1000, rounds_path: str | None = None) -> ChunkedClustering:
    """Feeds the chunks of ``points`` in order and finishes. The points are written once, a folder per chunk, so that
    each chunk reads its own rows."""
    state = ChunkedClustering(k=k, max_rounds=max_rounds, rounds_path=rounds_path)
    written = materialise(points.select("id", "features", F.col(chunk).alias("_chunk")), by="_chunk")
    for c in [r[0] for r in written.select("_chunk").distinct().orderBy("_chunk").collect()]:
        state.feed(written.where(F.col("_chunk") == c))
    state.finish()
    return state
