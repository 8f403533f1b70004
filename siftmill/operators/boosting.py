"""Boosted regression trees on binned features: one aggregation over all rows, then trees on the cells."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.session import discard, materialise

#: Cells that the driver may hold; the number of bins per feature follows from it.
CELLS = 1_000_000


@dataclass
class Tree:
    """Nodes as arrays: the feature and last bin that go left, the left child (the right one follows), or a leaf's value."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        at = np.zeros(len(codes), np.int64)
        rows = np.arange(len(codes))
        while (inner := self.left[at] >= 0).any():
            step = self.left[at] + (codes[rows, self.feature[at]] > self.cut[at])
            at = np.where(inner, step, at)
        return at


def grow(codes: np.ndarray, n: np.ndarray, gradient: np.ndarray, bins: int, depth: int, rate: float, penalty: float) -> tuple[Tree, np.ndarray]:
    """A tree on cells of ``n`` rows whose residuals sum to ``gradient``, level by level, and the cells' leaves.

    A node is split where G^2 / (N + penalty) gains most over both sides, each of at least one row; ties go to the
    lower feature, then to the lower bin.
    """
    feature, cut, left, value = [0], [0], [-1], [0.0]
    node, level = np.zeros(len(codes), np.int64), [0]
    for _ in range(depth):
        where = np.full(len(left), -1)
        where[level] = np.arange(len(level))
        live = where[node] >= 0
        at, g, c = where[node[live]], gradient[live], n[live]
        total_g, total_n = np.bincount(at, g, len(level)), np.bincount(at, c, len(level))
        best = np.full(len(level), 1e-9)
        choice = np.full((len(level), 2), -1)
        for f in range(codes.shape[1]):
            cell = at * bins + codes[live, f]
            gl, nl = (np.cumsum(np.bincount(cell, x, len(level) * bins).reshape(-1, bins), 1)[:, :-1] for x in (g, c))
            gr, nr = total_g[:, None] - gl, total_n[:, None] - nl
            gain = np.where((nl >= 1) & (nr >= 1), gl**2 / (nl + penalty) + gr**2 / (nr + penalty) - (total_g**2 / (total_n + penalty))[:, None], -np.inf)
            top = gain.argmax(1)
            better = gain[np.arange(len(level)), top] > best
            best[better] = gain[better, top[better]]
            choice[better] = np.stack([np.full(better.sum(), f), top[better]], 1)
        following = []
        for i, node_id in enumerate(level):
            if choice[i, 0] >= 0:
                feature[node_id], cut[node_id], left[node_id] = choice[i, 0], choice[i, 1], len(left)
                following += [len(left), len(left) + 1]
                for x, v in ((feature, 0), (cut, 0), (left, -1), (value, 0.0)):
                    x += [v, v]
        if not following:
            break
        l, f, c = (np.array(x) for x in (left, feature, cut))
        split = (l[node] >= 0) & live
        node[split] = l[node[split]] + (codes[split, f[node[split]]] > c[node[split]])
        level = following
    value = rate * np.bincount(node, gradient, len(left)) / (np.bincount(node, n, len(left)) + penalty)
    return Tree(*(np.array(x) for x in (feature, cut, left)), value), node


@dataclass
class Model:
    columns: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree]

    def codes(self, values: Sequence[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, v, "left") for e, v in zip(self.edges, values)], 1)

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """``df`` with the prediction of each row; a null feature counts as the smallest value."""
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != name)
        kept = [f.name for f in df.schema if f.name != name]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = [np.nan_to_num(batch.column(i).to_numpy(zero_copy_only=False).astype(float), nan=-np.inf, posinf=np.inf, neginf=-np.inf) for i in range(batch.num_columns - len(self.columns), batch.num_columns)]
                codes = self.codes(values)
                out = np.full(batch.num_rows, self.base)
                for t in self.trees:
                    out += t.value[t.leaves(codes)]
                yield pa.record_batch([*batch.columns[: -len(self.columns)], pa.array(out)], names=[*kept, name])

        inputs = df.select(*(F.col(f"`{c}`") for c in kept), *(F.col(f"`{c}`").cast("double").alias(f"_f{i}") for i, c in enumerate(self.columns)))
        return inputs.mapInArrow(run, f"{schema}, {name} double")


def boosted_trees(train: DataFrame, columns: Sequence[str], label: str, *, trees: int = 95, depth: int = 10, rate: float = 0.095, penalty: float = 1.0, bins: int | None = None) -> Model:
    """Gradient boosted trees for the squared error, with L2 penalty on the leaves.

    Features are cut at quantiles into at most ``bins`` bins (by default 256, or as many as keep bins ** features within
    ``CELLS``; fewer distinct values are kept apart). All rows are then reduced to cells - a code per feature, the
    number of rows and the sum of their labels - in one aggregation with partial sums, which is all the squared
    error needs; the driver grows the trees on at most ``CELLS`` cells, however many rows there are.

    Defined cases: rows with a null label don't count; a null feature counts as the smallest value; without rows
    every prediction is 0.
    """
    bins = bins or min(256, max(2, int(CELLS ** (1 / len(columns)) + 1e-9)))
    rows = materialise(train.where(F.col(label).isNotNull()).select(*(F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))).alias(f"f{i}") for i, c in enumerate(columns)), F.col(label).cast("double").alias("y")))
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*(F.percentile_approx(f"f{i}", shares, 20_000).alias(f"q{i}") for i in range(len(columns)))).first()
    edges = [np.unique(np.array(found[f"q{i}"] or [], float)) for i in range(len(columns))]
    code = lambda i: F.expr("+".join(["0", *(f"cast(f{i} > cast('{float(e)!r}' as double) as int)" for e in edges[i])]))
    cells = rows.groupBy(*(code(i).alias(f"c{i}") for i in range(len(columns)))).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).toArrow()
    discard(rows)
    if not cells.num_rows:
        return Model(list(columns), edges, 0.0, [])
    values = [c.to_numpy() for c in cells.columns]
    codes = np.stack(values[: len(columns)], 1).astype(np.int64)
    order = np.lexsort(codes.T)
    codes, n, y = codes[order], values[-2][order].astype(float), values[-1][order]
    base = float(y.sum() / n.sum())
    score, grown = np.full(len(n), base), []
    for _ in range(trees):
        tree, leaf = grow(codes, n, y - score * n, bins, depth, rate, penalty)
        score += tree.value[leaf]
        grown.append(tree)
    return Model(list(columns), edges, base, grown)
