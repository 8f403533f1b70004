"""Frequency of every distinct term: burst tries, routed by adaptive prefixes and merged by subtree."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from siftmill.session import clean_id, discard, materialise, small

#: A container that holds more terms than this bursts into one container per next character.
BURST = 2_000
#: Containers below a prefix of this many characters don't burst.
DEPTH = 64
#: A worker's trie is written out and begun anew at this many terms, which bounds a task's memory.
TRIE_TERMS = 400_000
#: A record of more differing texts than this isn't gathered; its terms are made distinct by a shuffle.
WIDE = 64
#: Bits for each copied record id in the filter, bits of one of its blocks, and blocks at most (64 MB in all).
FILTER_BITS, FILTER_BLOCK, FILTER_BLOCKS = 12, 1 << 19, 1 << 10

SUBTREE = "prefix string, suffixes array<string>, occurrences array<bigint>, records array<bigint>"
_SUBTREE = pa.schema([("prefix", pa.string()), ("suffixes", pa.list_(pa.string())), ("occurrences", pa.list_(pa.int64())), ("records", pa.list_(pa.int64()))])
_WORD = re.compile(r"[^\W_]+")


class BurstTrie:
    """Terms with two counters each: an access trie of dicts over containers that map suffixes to counters."""

    def __init__(self, burst: int = BURST) -> None:
        self.burst, self.terms, self.root = burst, 0, _Container()

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, parent, i = self.root, None, 0
        while type(node) is dict:
            parent, key = node, term[i : i + 1]
            node = parent.get(key)
            if node is None:
                node = parent[key] = _Container()
            i += 1
            if not key:
                break
        suffix = term[i:]
        found = node.get(suffix)
        if found is None:
            node[suffix] = [occurrences, records]
            self.terms += 1
            if len(node) > self.burst and i < DEPTH:
                self._burst(node, parent, term[i - 1 : i] if parent is not None else "", i)
        else:
            found[0] += occurrences
            found[1] += records

    def _burst(self, full: _Container, parent: dict | None, key: str, depth: int) -> None:
        inner: dict = {}
        for suffix, counters in full.items():
            inner.setdefault(suffix[:1], _Container())[suffix[1:]] = counters
        if parent is None:
            self.root = inner
        else:
            parent[key] = inner
        for k, node in list(inner.items()):
            if k and len(node) > self.burst and depth + 1 < DEPTH:
                self._burst(node, inner, k, depth + 1)

    def containers(self) -> Iterator[tuple[str, _Container]]:
        """Prefix and container of every leaf, in the order of the prefixes."""
        stack: list[tuple[str, object]] = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            if type(node) is dict:
                stack += [(prefix + k, node[k]) for k in sorted(node, reverse=True)]
            elif node:
                yield prefix, node


class _Container(dict):
    """Suffix to [occurrences, records]; a class of its own so that a plain dict is an inner node."""


def _rows(trie: BurstTrie, most: int = 200) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for prefix, node in trie.containers():
        keys = sorted(node)
        rows.append((prefix, keys, [node[k][0] for k in keys], [node[k][1] for k in keys]))
        if len(rows) == most:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _SUBTREE.types)], schema=_SUBTREE)
            rows = []
    if rows:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _SUBTREE.types)], schema=_SUBTREE)


class Filter:
    """A Bloom filter in blocks: all bits of a key lie in one block, so blocks are built apart. No key is missed."""

    def __init__(self, blocks: dict[int, bytes], n_blocks: int, n_bits: int) -> None:
        self.n_bits = n_bits
        self.bits = np.zeros((n_blocks, FILTER_BLOCK // 8), np.uint8)
        for b, data in blocks.items():
            self.bits[b] = np.frombuffer(data, np.uint8)

    @staticmethod
    def places(keys: np.ndarray, n_bits: int) -> Iterator[np.ndarray]:
        """The places of the keys' bits in their blocks."""
        k = keys.view(np.uint64)
        at, step = k & np.uint64(FILTER_BLOCK - 1), k >> np.uint64(20) & np.uint64(FILTER_BLOCK - 1) | np.uint64(1)
        for _ in range(n_bits):
            yield (at & np.uint64(FILTER_BLOCK - 1)).astype(np.int64)
            at = at + step

    def holds(self, keys: np.ndarray) -> np.ndarray:
        block = (keys.view(np.uint64) >> np.uint64(40)) % np.uint64(len(self.bits))
        found = np.ones(len(keys), bool)
        for at in self.places(keys, self.n_bits):
            found &= self.bits[block.astype(np.int64), at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
        return found

    @classmethod
    def of(cls, keys: DataFrame, n: int) -> Filter:
        """The filter of ``n`` bigint keys in column h; blocks are filled where their keys are shuffled to."""
        n_blocks = min(FILTER_BLOCKS, max(1, -(-n * FILTER_BITS // FILTER_BLOCK)))
        n_bits = max(1, min(8, round(0.7 * n_blocks * FILTER_BLOCK / max(1, n))))

        def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks: dict[int, np.ndarray] = {}
            for batch in batches:
                number, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for b in np.unique(number).tolist():
                    bits = blocks.setdefault(b, np.zeros(FILTER_BLOCK, bool))
                    for at in cls.places(key[number == b], n_bits):
                        bits[at] = True
            for b, bits in blocks.items():
                yield pa.record_batch([pa.array([b], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["b", "bits"])

        numbered = keys.select(F.pmod(F.shiftrightunsigned("h", 40), F.lit(n_blocks)).cast("int").alias("b"), "h")
        filled = numbered.repartitionById(n_blocks, "b").mapInArrow(fill, "b int, bits binary").collect()
        return cls({r.b: bytes(r.bits) for r in filled}, n_blocks, n_bits)


class _Counts:
    """Counts a batch's words, then adds each distinct one to the trie with its two counters."""

    def __init__(self, burst: int) -> None:
        self.burst, self.trie, self.occurrences, self.records = burst, BurstTrie(burst), Counter(), Counter()

    def text(self, text: str | None) -> list[str]:
        found = _WORD.findall(text) if text else []
        self.occurrences.update(found)
        return found

    def pour(self, *, close: bool = False) -> Iterator[pa.RecordBatch]:
        for term, n in self.occurrences.items():
            self.trie.add(term, n, self.records.get(term, 0))
        self.occurrences.clear()
        self.records.clear()
        if close or self.trie.terms > TRIE_TERMS:
            yield from _rows(self.trie)
            self.trie = BurstTrie(self.burst)


def _grower(burst: int, copied: Filter | None = None):
    """Counts rows (id, h, text), each a record of its own if it has an id; those that may be copies come out as they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(burst)
        for batch in batches:
            ids = batch.column(0)
            if copied is not None:
                hit = copied.holds(batch.column(1).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)
                if hit.any():
                    out = batch.filter(pa.array(hit))
                    none = [pa.nulls(out.num_rows, t) for t in _SUBTREE.types]
                    yield pa.record_batch([*none, out.column(0), out.column(2)], names=[*_SUBTREE.names, "id", "text"])
                    batch = batch.filter(pa.array(~hit))
                    ids = batch.column(0)
            for text, counted in zip(batch.column(2), ids.is_valid().to_pylist()):
                found = counts.text(text.as_py())
                if counted:
                    counts.records.update(set(found))
                if len(counts.occurrences) > TRIE_TERMS // 4:
                    yield from map(_with_row, counts.pour())
            yield from map(_with_row, counts.pour())
        yield from map(_with_row, counts.pour(close=True))

    return run


def _with_row(batch: pa.RecordBatch) -> pa.RecordBatch:
    none = pa.nulls(batch.num_rows, pa.string())
    return pa.record_batch([*batch.columns, none, none], names=[*batch.schema.names, "id", "text"])


def _record_grower(burst: int):
    """Counts rows (id, text) in the order of their ids: the texts of one id are one record."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, current, terms = _Counts(burst), None, set()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i != current:
                    counts.records.update(terms)
                    # Only between records, for a record's terms must be in when its counters are poured.
                    if len(counts.occurrences) > TRIE_TERMS // 4:
                        yield from counts.pour()
                    current, terms = i, set()
                terms.update(counts.text(text.as_py()))
        counts.records.update(terms)
        yield from counts.pour(close=True)

    return run


def _splitter(bounds: list[str], numbers: list[int]):
    """Sends every subtree to the range of terms it lies in; a subtree that reaches over several ranges is split."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("route", pa.int32()), *_SUBTREE])
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                prefix, suffixes = r["prefix"], r["suffixes"]
                at, n = 0, len(suffixes)
                while at < n:
                    to = bisect_right(bounds, prefix + suffixes[at]) - 1
                    end = n if to + 1 == len(bounds) else bisect_left(suffixes, bounds[to + 1], at, key=lambda s: prefix + s)
                    rows.append((numbers[to], prefix, suffixes[at:end], r["occurrences"][at:end], r["records"][at:end]))
                    at = end
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the subtrees of a range, which are all the rows of a task, into one trie and gives its terms."""
    trie = BurstTrie()
    for batch in batches:
        for r in batch.to_pylist():
            for s, o, n in zip(r["suffixes"], r["occurrences"], r["records"]):
                trie.add(r["prefix"] + s, o, n)
    for prefix, node in trie.containers():
        keys = sorted(node)
        for at in range(0, len(keys), 20_000):
            part = keys[at : at + 20_000]
            yield pa.record_batch(
                [pa.array([prefix + k for k in part]), pa.array([node[k][0] for k in part], pa.int64()), pa.array([node[k][1] for k in part], pa.int64())],
                names=["term", "occurrences", "records"],
            )


def pack_ranges(leaves: list[tuple[str, int]], share: int) -> tuple[list[str], list[int]]:
    """Ranges of prefixes in order, each of at most ``share`` terms unless a single leaf has more: (first prefix, weight)."""
    bounds, weights = [""], [0]
    for prefix, n in sorted(leaves):
        if weights[-1] and weights[-1] + n > share:
            bounds.append(prefix)
            weights.append(0)
        weights[-1] += n
    return bounds, weights


def _routes(subtrees: DataFrame, parts: int, burst: int) -> tuple[list[str], list[int]]:
    """First terms of ranges that share the partial terms out evenly, and the ranges' numbers, the heaviest first.

    A prefix with more terms than a share is refined by a character, round by round; the prefixes left are packed
    in order. A share is at most what one trie may hold. Each round the driver gets at most (prefixes above a
    share, so at most as many as there are shares) x (characters that follow one) numbers.
    """
    terms = subtrees.select(F.explode("suffixes").alias("s"), "prefix").select(F.concat("prefix", "s").alias("term"))
    total = subtrees.agg(F.sum(F.size("suffixes"))).first()[0] or 0
    share = min(max(burst, total // max(1, parts)), TRIE_TERMS)
    leaves: list[tuple[str, int]] = []
    heavy, depth = [""], 0
    while heavy:
        depth += 1
        at = terms if depth == 1 else terms.where(F.substring("term", 1, depth - 1).isin(heavy))
        found = at.groupBy(F.substring("term", 1, depth).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()
        # A prefix that is as long as its depth can be refined; a shorter one is a term itself.
        heavy = [r.k for r in found if r.n > share and len(r.k) == depth and depth <= DEPTH]
        rest = set(heavy)
        leaves += [(r.k, r.n) for r in found if r.k not in rest]
    bounds, weights = pack_ranges(leaves, share)
    numbers = [0] * len(bounds)
    for n, i in enumerate(sorted(range(len(bounds)), key=lambda i: -weights[i])):
        numbers[i] = n
    return bounds, numbers


def term_statistics(df: DataFrame, record: str, text: str, *, rare_max: int = 2, common_percent: int = 25, burst: int = BURST) -> DataFrame:
    """Every term of ``text`` with its occurrences, the number of distinct records that hold it, and a mark.

    A term is a maximal run of letters of any script and numbers in the lower-cased text. ``mark`` is 'rare' if at
    most ``rare_max`` records hold the term, else 'common' if more than ``common_percent`` % of all distinct
    records do, else null.

    Method: each worker counts into a burst trie, a batch's distinct words at a time; the subtrees are written once;
    adaptive prefixes, refined until none has more than its share of the partial terms, are packed in order into
    ranges of a share; each range's subtrees merge in one trie, in a task of their own. A Bloom filter of the ids that
    occur more than once, of bounded size, tells the rows that may be copies: only these are shuffled, made distinct
    and counted per record. All other texts never move, at any size of the table.

    Defined cases: identical copies of a record count once, a record's differing texts add up in ``occurrences``
    and count it once in ``records``; rows with a null record id count in ``occurrences`` only; null and empty
    texts and texts without terms give no term, yet their records count in the total; whole texts are read;
    other columns of ``df`` don't matter; an empty table gives no rows.
    """
    spark = df.sparkSession
    rows = df.select(clean_id(F.col(record).cast("string")).alias("id"), F.lower(text).alias("text"))
    seen = Observation()
    ids = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    copied = materialise(ids.observe(seen, F.count(F.lit(1)).alias("n")).where("n > 1").select(F.xxhash64("id").alias("h")))
    total, n_copied = seen.get.get("n", 0), copied.count()
    held = Filter.of(copied, n_copied) if n_copied else None

    hashed = lambda rows: rows.select("id", F.xxhash64("id").alias("h"), "text")
    ROW = SUBTREE + ", id string, text string"
    grown = materialise(hashed(rows.where(F.col("text").isNotNull())).mapInArrow(_grower(burst, held), ROW))
    of_trie = [c.split()[0] for c in SUBTREE.split(", ")]
    subtrees = [grown.where(F.col("prefix").isNotNull()).select(of_trie)]
    if held is not None:
        copies = materialise(grown.where(F.col("prefix").isNull()).select("id", "text").distinct())
        differing = materialise(copies.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
        single, several, wide = copies, None, None
        if differing.count():
            single = copies.join(small(differing.select("id")), "id", "left_anti")
            several = copies.join(small(differing.where(F.col("k") <= WIDE).select("id")), "id", "left_semi")
            wide = copies.join(small(differing.where(F.col("k") > WIDE).select("id")), "id", "left_semi")
        subtrees.append(hashed(single).mapInArrow(_grower(burst), ROW).select(of_trie))
        if several is not None:
            subtrees.append(several.repartition("id").sortWithinPartitions("id").mapInArrow(_record_grower(burst), SUBTREE))
            # Occurrences of wide records as for rows without an id; their records from distinct (id, term).
            subtrees.append(hashed(wide.withColumn("id", F.lit(None).cast("string"))).mapInArrow(_grower(burst), ROW).select(of_trie))
            held_terms = wide.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+)"), 1))).alias("term")).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n"))
            subtrees.append(held_terms.select(F.lit("").alias("prefix"), F.array("term").alias("suffixes"), F.array(F.lit(0).cast("bigint")).alias("occurrences"), F.array("n").alias("records")))
        more = subtrees[1]
        for x in subtrees[2:]:
            more = more.unionAll(x)
        more = materialise(more)
        discard(copied, copies, differing)
        subtrees = [subtrees[0], more]
    every = subtrees[0] if len(subtrees) == 1 else subtrees[0].unionAll(subtrees[1])
    bounds, numbers = _routes(every, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), burst)
    routed = every.mapInArrow(_splitter(bounds, numbers), "route int, " + SUBTREE)
    merged = routed.repartitionById(len(bounds), "route").mapInArrow(_merge, "term string, occurrences bigint, records bigint")
    common = F.col("records") * 100 > F.lit(total * common_percent)
    return merged.withColumn("mark", F.when(F.col("records") <= rare_max, "rare").when(common, "common"))
