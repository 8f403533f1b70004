"""Items that appear together: a blocked Gram matrix over binary sparse item blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.session import clean_id, dense_codes, materialise, small

#: Items per item block; items are coded by falling frequency, and the first blocks are multiplied as operands.
WIDTH, HEAD = 1024, 4
#: Basket-item entries per record block and per task, and products formed at a time within a record block.
BLOCK_ENTRIES, TASK_ENTRIES, STEP = 200_000, 1_000_000, 2_000_000
#: A task hands on its sum of sparse products whenever it holds this many cells.
HELD_CELLS = 3_000_000
#: Cells of an item-block pair that are summed in one task, as a power of two.
STRIP = 14
#: Cost of a listed product against one multiply-add of a dense one.
LISTED = 300

CELLS = "bi bigint, bj bigint, strip int, cells array<int>, counts array<bigint>"
_CELLS = pa.schema([("bi", pa.int64()), ("bj", pa.int64()), ("strip", pa.int32()), ("cells", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])


def _fold(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(keys, return_inverse=True)
    return unique, np.bincount(at, counts, len(unique)).astype(np.int64)


def _strips(bi: int, bj: int, cells: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows for the sorted cells of an item-block pair, cut where strips end."""
    cuts = np.flatnonzero(np.append(True, cells[1:] >> STRIP != cells[:-1] >> STRIP)) if len(cells) else np.zeros(0, int)
    for a, z in zip(cuts, np.append(cuts[1:], len(cells))):
        yield pa.record_batch([pa.array([x], t) for x, t in zip((bi, bj, cells[a] >> STRIP, cells[a:z].astype(np.int32), counts[a:z]), _CELLS.types)], schema=_CELLS)


class _Gram:
    """The upper part of X'X summed over a task's record blocks: dense for pairs of head blocks, sparse for the rest."""

    def __init__(self, top: int, width: int, step: int) -> None:
        self.top, self.width, self.step = top, width, step
        self.head = min(HEAD, -(-top // width))
        self.dense: dict[tuple[int, int], np.ndarray] = {}
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, row: np.ndarray, column: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Adds a record block of binary entries sorted by (row, column); hands on what exceeds the task's memory."""
        # Head items: one operand per item block, with the rows it occurs in.
        block = column // self.width
        operands = [(row[m], column[m] % self.width) for m in (block == b for b in range(self.head))]
        n_rows = int(row[-1]) + 1
        per_row = [np.bincount(r, minlength=n_rows) for r, _ in operands]
        for i in range(self.head):
            for j in range(i, self.head):
                if n := int(per_row[i] @ per_row[j]):
                    self._multiply(i, j, operands, per_row, n)
        # The rest: each entry outside the head with all entries before it in its row, ``step`` products at a time.
        start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        first = np.repeat(start, np.diff(np.append(start, len(row))))
        tail = np.flatnonzero(block >= self.head)
        before = tail - first[tail]
        reach, at = np.cumsum(before), 0
        while at < len(tail):
            done = reach[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(reach, done + self.step, "right")))
            n = before[at:end]
            right = np.repeat(tail[at:end], n)
            left = np.repeat(first[tail[at:end]], n) + np.arange(len(right)) - np.repeat(np.cumsum(n) - n, n)
            self.keys, self.counts = _fold(np.append(self.keys, column[left] * self.top + column[right]), np.append(self.counts, np.ones(len(left), np.int64)))
            if len(self.keys) > HELD_CELLS:
                yield from self._sparse()
            at = end

    def _multiply(self, i: int, j: int, operands: list, per_row: list, n: int) -> None:
        """Adds the transpose-product of two operands, dense over the items and rows that occur or by listing."""
        (ra, ca), (rb, cb) = operands[i], operands[j]
        total = self.dense.setdefault((i, j), np.zeros((self.width, self.width), np.int32))
        common = np.flatnonzero((per_row[i] > 0) & (per_row[j] > 0))
        ia, ib = np.unique(ca), np.unique(cb)
        if len(common) * len(ia) * len(ib) < n * LISTED:
            spot = np.full(len(per_row[i]), -1)
            for at in range(0, len(common), step := max(1, (1 << 24) // (len(ia) + len(ib)))):
                rows = common[at : at + step]
                spot[:] = -1
                spot[rows] = np.arange(len(rows))
                x = []
                for r, c, items in ((ra, ca, ia), (rb, cb, ib)):
                    m = spot[r] >= 0
                    dense = np.zeros((len(rows), len(items)), np.float32)
                    dense[spot[r[m]], np.searchsorted(items, c[m])] = 1
                    x.append(dense)
                total[np.ix_(ia, ib)] += (x[0].T @ x[1]).astype(np.int32)  # exact: fewer than 2 ** 24 rows
            return
        start = np.cumsum(per_row[j]) - per_row[j]
        each = per_row[j][ra]
        reach, at = np.cumsum(each), 0
        while at < len(ra):
            end = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + self.step, "right")))
            m = each[at:end]
            left = np.repeat(np.arange(at, end), m)
            right = np.repeat(start[ra[at:end]], m) + np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m)
            total += np.bincount(ca[left] * self.width + cb[right], minlength=self.width**2).astype(np.int32).reshape(total.shape)
            at = end

    def _sparse(self) -> Iterator[pa.RecordBatch]:
        i, j, counts = self.keys // self.top, self.keys % self.top, self.counts
        pair, cell = (i // self.width) * (self.top // self.width + 1) + j // self.width, (i % self.width) * self.width + j % self.width
        order = np.lexsort((cell, pair))
        pair, cell, counts = pair[order], cell[order], counts[order]
        cuts = np.append(np.flatnonzero(np.append(True, pair[1:] != pair[:-1])), len(pair)) if len(pair) else []
        for a, z in zip(cuts[:-1], cuts[1:]):
            yield from _strips(int(pair[a]) // (self.top // self.width + 1), int(pair[a]) % (self.top // self.width + 1), cell[a:z], counts[a:z])
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def close(self) -> Iterator[pa.RecordBatch]:
        yield from self._sparse()
        for (i, j), total in self.dense.items():
            upper = np.triu(total, 1) if i == j else total
            cell = np.flatnonzero(upper)
            yield from _strips(i, j, cell, upper.ravel()[cell].astype(np.int64))
        self.dense = {}


def _products(top: int, width: int, step: int):
    """A partition of (basket, code) rows sorted by both holds whole baskets; it is cut into record blocks between them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = _Gram(top, width, step)
        held: list[pa.RecordBatch] = []
        for batch in _then_none(batches):
            if batch is not None:
                held.append(batch)
                if sum(b.num_rows for b in held) < BLOCK_ENTRIES:
                    continue
            if not held:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            basket = table.column(0).combine_chunks()
            new = np.append(True, pc.not_equal(basket.slice(1), basket.slice(0, len(basket) - 1)).to_numpy(zero_copy_only=False))
            # The last basket may go on in the next batch.
            end = len(basket) if batch is None else int(np.flatnonzero(new)[-1])
            held = [] if batch is None else table.slice(end).to_batches()
            if end:
                yield from gram.add(np.cumsum(new[:end]) - 1, table.column(1).to_numpy()[:end])
        yield from gram.close()

    return run


def _then_none(batches: Iterable) -> Iterator:
    yield from batches
    yield None


def _outer(width: int):
    """The product of two item blocks of one large basket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a, b = np.array(r["li"], np.int64), np.array(r["lj"], np.int64)
                cell = (a[:, None] * width + b[None, :]).ravel()
                if r["bi"] == r["bj"]:
                    cell = cell[(a[:, None] < b[None, :]).ravel()]
                cell = np.sort(cell)
                yield from _strips(r["bi"], r["bj"], cell, np.ones(len(cell), np.int64))

    return run


def _sum(least: int, width: int):
    """Sums the parts of each strip of an item-block pair, one after another, and keeps the cells of at least ``least``."""

    def close(bi: int, bj: int, parts: list) -> Iterator[pa.RecordBatch]:
        cells, counts = _fold(*(np.concatenate(x) for x in zip(*parts)))
        cells, counts = cells[counts >= least], counts[counts >= least]
        if len(cells):
            yield pa.record_batch([pa.array(bi * width + cells // width), pa.array(bj * width + cells % width), pa.array(counts)], names=["i", "j", "n_ab"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip, parts = None, []
        for batch in batches:
            for key, cells, counts in zip(zip(*(batch.column(i).to_pylist() for i in range(3))), batch.column(3), batch.column(4)):
                if key != strip:
                    if strip:
                        yield from close(*strip[:2], parts)
                    strip, parts = key, []
                parts.append((cells.values.to_numpy().astype(np.int64), counts.values.to_numpy()))
                if len(parts) >= 64:
                    parts = [_fold(*(np.concatenate(x) for x in zip(*parts)))]
        if strip:
            yield from close(*strip[:2], parts)

    return run


def item_pairs(df: DataFrame, basket: str, item: str, *, min_count: int = 1, min_lift: int = 0, large: int = 20_000, width: int = WIDTH, step: int = STEP) -> DataFrame:
    """Pairs of items in at least ``min_count`` common baskets and ``min_lift`` times as often as chance has it.

    Gives item_a < item_b (byte order), n_a, n_b, n_ab, n_baskets and lift = n_ab * n_baskets / (n_a * n_b).

    Method: items get dense codes by falling frequency and form blocks of ``width``; the baskets, hashed to tasks,
    are taken in record blocks of bounded size, each a set of binary sparse item blocks. The transpose-products of
    the first ``HEAD`` item blocks - the frequent items, that make up most pairs - are formed block by block, dense
    where that is cheaper; pairs with a rarer item are listed. A task sums its record blocks' products before they
    are shuffled, in strips of item-block pairs; the strips are summed and normalised by the marginals. A basket of
    more than ``large`` items is itself cut into item blocks, whose pairs are multiplied in separate tasks. Items
    that can't reach a threshold (in fewer than ``min_count`` baskets, or in more than n_baskets / min_lift) are
    left out before; this loses no pair.

    Defined cases: rows with a null basket or item don't count; blanks and tabs around ids are removed; repeated
    rows count once; baskets of one item count in n_baskets and the marginals; an empty table gives no rows; other
    columns don't matter.
    """
    entries = materialise(
        df.select(clean_id(F.col(basket).cast("string")).alias("basket"), clean_id(F.col(item).cast("string")).alias("item")).dropna().distinct()
    )
    n_baskets = entries.select("basket").distinct().count()
    kept = entries.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= min_count) & (F.col("n") * min_lift <= n_baskets))
    items = materialise(dense_codes(kept, F.desc("n"), "item"))
    top = items.count()
    coded = entries.join(small(items), "item").select("basket", "code")
    size = coded.groupBy("basket").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > large).select("basket")
    big = materialise(size)
    n_entries = entries.count()
    parts = max(1, -(-n_entries // TASK_ENTRIES), min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_entries // BLOCK_ENTRIES))
    usual = coded
    partial = None
    if big.count():
        usual = coded.join(small(big), "basket", "left_anti")
        lists = materialise(
            coded.join(small(big), "basket", "left_semi")
            .groupBy("basket", F.floor(F.col("code") / width).alias("b")).agg(F.sort_array(F.collect_list(F.col("code") % width)).alias("l"))
        )
        salts = 64
        left = lists.select("basket", F.col("b").alias("bi"), F.col("l").alias("li"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        right = lists.select("basket", F.col("b").alias("bj"), F.col("l").alias("lj"), F.expr(f"cast(b % {salts} as int)").alias("salt"))
        partial = left.join(right, ["basket", "salt"]).where("bi <= bj").select("bi", "bj", "li", "lj").mapInArrow(_outer(width), CELLS)
    products = usual.repartition(parts, "basket").sortWithinPartitions("basket", "code").mapInArrow(_products(max(1, top), width, step), CELLS)
    partial = products if partial is None else products.unionAll(partial)
    key = ["bi", "bj", "strip"]
    summed = partial.repartition(*key).sortWithinPartitions(*key).mapInArrow(_sum(min_count, width), "i bigint, j bigint, n_ab bigint")
    names = small(items)
    a = names.select(F.col("code").alias("i"), F.col("item").alias("item_i"), F.col("n").alias("n_i"))
    b = names.select(F.col("code").alias("j"), F.col("item").alias("item_j"), F.col("n").alias("n_j"))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    first = F.col("item_i") < F.col("item_j")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return (
        summed.join(a, "i").join(b, "j")
        .where(whole("n_ab") * F.lit(n_baskets).cast("decimal(18,0)") >= F.lit(min_lift) * (whole("n_i") * whole("n_j")))
        .select(
            pick("item_i", "item_j").alias("item_a"), pick("item_j", "item_i").alias("item_b"), pick("n_i", "n_j").alias("n_a"), pick("n_j", "n_i").alias("n_b"), "n_ab",
            F.lit(n_baskets).alias("n_baskets"), (F.col("n_ab") * F.lit(float(n_baskets)) / (F.col("n_i") * F.col("n_j").cast("double"))).alias("lift"),
        )
    )
