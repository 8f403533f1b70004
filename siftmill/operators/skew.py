"""Per-key totals without skew: dense accumulator arrays over equal input splits."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.session import clean_id

#: A split folds its arrays together whenever it holds this many entries, which bounds a task's memory.
FOLD_ENTRIES = 400_000

PARTIAL = "field string, key_value string, n_rows bigint, n_values bigint, value_sum double"
_SCHEMA = pa.schema([("field", pa.string()), ("key_value", pa.string()), ("n_rows", pa.int64()), ("n_values", pa.int64()), ("value_sum", pa.float64())])


class _Arrays:
    """Accumulator arrays of one field, addressed by the codes of a local dictionary."""

    def __init__(self) -> None:
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        self.entries = 0

    def add(self, keys: pa.Array, rows: np.ndarray | None, values: np.ndarray | None, sums: np.ndarray) -> None:
        """Scatter-reduces one batch: ``rows`` and ``values`` are counts per entry, or None for ones."""
        coded = keys.dictionary_encode(null_encoding="encode")
        code, size = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
        self.parts.append((
            coded.dictionary,
            np.bincount(code, rows, size).astype(np.int64),
            np.bincount(code, values, size).astype(np.int64),
            np.bincount(code, sums, size),
        ))
        self.entries += size
        if self.entries > FOLD_ENTRIES:
            self.fold()

    def fold(self) -> None:
        """Sums the array blocks gathered so far into one over their common dictionary."""
        if len(self.parts) > 1:
            parts, self.parts, self.entries = self.parts, [], -(1 << 62)
            self.add(pa.concat_arrays([p[0] for p in parts]), *(np.concatenate([p[i] for p in parts]) for i in (1, 2, 3)))
        self.entries = 0  # counts what came since the last fold

    def batches(self, field: str, step: int = 50_000) -> Iterator[pa.RecordBatch]:
        self.fold()
        for keys, rows, values, sums in self.parts:
            for at in range(0, len(keys), step):
                part = keys[at : at + step]
                yield pa.record_batch(
                    [pa.array([field] * len(part), pa.string()), part.cast(pa.string()), pa.array(rows[at : at + step]), pa.array(values[at : at + step]), pa.array(sums[at : at + step])],
                    schema=_SCHEMA,
                )


def _count_split(fields: Sequence[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = {f: _Arrays() for f in fields}
        for batch in batches:
            value = batch.column(len(fields))
            there = pc.is_valid(value).to_numpy(zero_copy_only=False).astype(np.float64)
            amount = pc.fill_null(value, 0.0).to_numpy(zero_copy_only=False)
            for i, f in enumerate(fields):
                arrays[f].add(batch.column(i), None, there, amount)
        for f in fields:
            yield from arrays[f].batches(f)

    return run


def _sum_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    arrays: dict[str, _Arrays] = {}
    for batch in batches:
        names = batch.column(0)
        for f in pc.unique(names).to_pylist():
            part = batch.filter(pc.equal(names, f))
            arrays.setdefault(f, _Arrays()).add(part.column(1), *(part.column(i).to_numpy() for i in (2, 3, 4)))
    for f, a in arrays.items():
        yield from a.batches(f)


def key_totals(df: DataFrame, fields: Sequence[str], value: str) -> DataFrame:
    """Rows, non-null values and mean of ``value`` for every key of each of ``fields``.

    Method: every input split, equal in bytes whatever its keys, encodes its keys by a local dictionary and adds
    its rows into dense arrays by ``numpy.bincount``; the arrays are cut into blocks by the hash of the key, and
    blocks of one hash range are summed by scatter-reduce over their common dictionary. A key takes part in the
    shuffle once per split at most, so a key with a third of all rows costs as much as any other.

    Defined cases: blanks and tabs around a key are removed; rows with a null key come as key null; null values
    don't count in ``n_values`` and the mean, NaN values make it NaN; a key without values has mean null; repeated
    rows count each; other columns of ``df`` don't matter; an empty table gives no rows.
    """
    rows = df.select(*(clean_id(f).cast("string").alias(f"k{i}") for i, f in enumerate(fields)), F.col(value).cast("double").alias("v"))
    partial = rows.mapInArrow(_count_split(list(fields)), PARTIAL)
    total = partial.repartition("field", "key_value").mapInArrow(_sum_blocks, PARTIAL)
    return total.withColumn("mean_value", F.when(F.col("n_values") > 0, F.col("value_sum") / F.col("n_values")))


def heavy_keys(totals: DataFrame, n_rows: int, *, percent: int = 1) -> DataFrame:
    """The non-null keys of ``key_totals`` that hold at least ``percent`` % of ``n_rows`` rows (null keys' included)."""
    return totals.where(F.col("key_value").isNotNull() & (F.col("n_rows") * 100 >= F.lit(n_rows * percent)))
