"""Item pairs, similar sets and top-n against brute force, with hot keys, ties and edge cases."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest

from siftmill.llm import cooccur
from siftmill.llm.cooccur import item_pairs
from siftmill.llm import setjoin
from siftmill.llm.setjoin import _small_limit, set_links, similar_sets
from siftmill.llm.topn import top_per_group


def brute_pairs(rows, min_count, min_lift):
    baskets = defaultdict(set)
    for b, i in rows:
        if b is not None and i is not None:
            baskets[b.strip(" \t")].add(i.strip(" \t"))
    single, both, n = Counter(), Counter(), len(baskets)
    for s in baskets.values():
        single.update(s)
        both.update(itertools.combinations(sorted(s), 2))
    return {(a, b): (single[a], single[b], c, n) for (a, b), c in both.items() if c >= min_count and c * n >= min_lift * single[a] * single[b]}


@pytest.mark.parametrize(("width", "large", "step"), [(1024, 20_000, 2_000_000), (4, 10, 50)])
def test_item_pairs(spark, monkeypatch, width, large, step):
    rng = random.Random(width)
    rows = [(f"b{rng.randint(0, 60)}", f"{97 + int(rng.paretovariate(0.7)) % 40}") for _ in range(600)]
    rows += [("big", f"{97 + i}") for i in range(40)] + [(" big\t", " 99"), (None, "97"), ("b1", None), ("lone", "zz"), (None, None)]
    monkeypatch.setattr(cooccur, "BLOCK_ENTRIES", 100)
    df = spark.createDataFrame([(b, i, 1, "c") for b, i in rows], "u string, i string, n int, code string")
    for count, lift in ((1, 0), (3, 2)):
        got = {(r.item_a, r.item_b): (r.n_a, r.n_b, r.n_ab, r.n_baskets) for r in item_pairs(df, "u", "i", min_count=count, min_lift=lift, large=large, width=width, step=step).collect()}
        assert got == brute_pairs(rows, count, lift)
    assert item_pairs(df.limit(0), "u", "i").count() == 0
    assert item_pairs(df.where("u = 'lone'"), "u", "i").count() == 0


def test_gram_matrix_of_record_blocks(monkeypatch):
    """Dense and listed products, head and tail, one block or many: always the plain pair counts."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    baskets = [sorted(rng.sample(range(37), rng.randint(1, 20))) for _ in range(200)]
    entries = [(f"b{i:03}", c) for i, b in enumerate(baskets) for c in b]
    want = Counter(p for b in baskets for p in itertools.combinations(b, 2))
    for head, block, held, listed in itertools.product((0, 2, 9), (7, 10**6), (20, 10**6), (0, 10**6)):
        for name, value in (("HEAD", head), ("BLOCK_ENTRIES", block), ("HELD_CELLS", held), ("LISTED", listed), ("STRIP", 3)):
            monkeypatch.setattr(cooccur, name, value)
        batches = [pa.record_batch([pa.array([b for b, _ in part]), pa.array([c for _, c in part], pa.int64())], names=["basket", "code"]) for part in (entries[at : at + 33] for at in range(0, len(entries), 33))]
        got = Counter()
        for out in cooccur._products(37, 8, 50)(batches):
            for r in out.to_pylist():
                assert {c >> 3 for c in r["cells"]} == {r["strip"]}
                for c, n in zip(r["cells"], r["counts"]):
                    got[r["bi"] * 8 + c // 8, r["bj"] * 8 + c % 8] += n
        assert got == want
    assert list(cooccur._products(1, 8, 50)([])) == []


def brute_similar(rows, num, den, least):
    sets = defaultdict(set)
    for o, t in rows:
        if o is not None and t is not None:
            sets[o.strip(" \t")].add(t.strip(" \t"))
    sets = {o: s for o, s in sets.items() if len(s) >= least}
    return {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) * den >= num * len(sets[a] | sets[b])}


@pytest.mark.parametrize(("num", "den", "least", "array"), [(1, 2, 5, 4096), (1, 2, 1, 12), (4, 5, 3, 4096), (1, 3, 2, 25), (1, 1, 1, 4096)])
def test_similar_sets(spark, monkeypatch, num, den, least, array):
    monkeypatch.setattr(setjoin, "CLASS_BLOCK", 2)
    rng = random.Random(num * 10 + den)
    rows = []
    for k in range(120):
        base = rng.sample(range(60), rng.choice([2, 3, 5, 6, 8, 9, 10, 15, 30]))
        for copy in range(rng.choice([1, 1, 2, 3, 7])):
            kept = [t for t in base if rng.random() < (1.0 if copy % 2 else 0.8)] or base
            rows += [(f"o{k}_{copy}", f"t{t}") for t in kept] + ([(f"o{k}_{copy}", "hot")] if rng.random() < 0.7 else [])
    rows += [(" o1_0\t", "t1 "), (None, "t1"), ("o1_0", None)] + rows[:30]
    df = spark.createDataFrame([(o, t, 1, "x") for o, t in rows], "o string, t string, n int, id string")
    got = [(r.a, r.b, r.n_ab) for r in similar_sets(df, "o", "t", num=num, den=den, least=least, array=array).collect()]
    want = brute_similar(rows, num, den, least)
    assert len(got) == len({g[:2] for g in got}) and {(a, b): n for a, b, n in got} == want and want
    links = Counter(x for pair in want for x in pair)
    rows = set_links(df, "o", "t", num=num, den=den, least=least, array=array).collect()
    assert {r.o: r.n_links for r in rows} == dict(links) and len(rows) == len(links) and len({r["class"] for r in rows}) < len(rows)
    assert all(0 < r.best <= 1 for r in rows)
    assert similar_sets(df.limit(0), "o", "t").count() == set_links(df.limit(0), "o", "t").count() == 0


def test_small_sets_are_those_with_few_subsets():
    assert _small_limit(5, 1, 2) == 9
    assert _small_limit(1, 1, 1) == 30


def brute_top(rows, n):
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and not math.isnan(s):
            k = (g.strip(" \t"), i.strip(" \t"))
            best[k] = max(best.get(k, -math.inf), s)
    groups = defaultdict(list)
    for (g, i), s in best.items():
        groups[g].append((-s, i.encode(), i))
    return {(g, i, r + 1) for g, xs in groups.items() for r, (_, _, i) in enumerate(sorted(xs)[:n])}


@pytest.mark.parametrize("n", [0, 1, 3, 7, 1000])
def test_top_per_group(spark, n):
    rng = random.Random(n)
    scores = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 1.0, 0.1, 0.5, 0.5000000001, -2.5, 1e300, -1e-300, math.inf, -math.inf, math.nan, None]
    ids = ["a", "a\x00", "ab", "abcdef", "abcdefg", "é", "日本", "", *(f"same-long-prefix-{i}" for i in range(300))]
    rows = [(rng.choice(["hot", "hot", "hot", " hot", f"g{rng.randint(0, 30)}", None]), rng.choice([*ids, None]), rng.choice(scores)) for _ in range(3000)]
    rows += [("tie", f"same-long-prefix-{i}", 0.25) for i in range(500)]
    df = spark.createDataFrame([(g, i, s, 1, "x") for g, i, s in rows], "g string, i string, s double, level int, lo string")
    got = {(r.g, r.i, r["rank"]) for r in top_per_group(df, "g", "i", "s", n).collect()}
    assert got == brute_top(rows, n)
    assert top_per_group(df.limit(0), "g", "i", "s", 3).count() == 0
