"""Key totals, packed fields and orphan references against brute force and in their edge cases."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from datetime import datetime

from siftmill.operators.orphans import Link, orphan_references, orphan_report
from siftmill.operators.packed import latest_field, packed_values, unpack
from siftmill.operators.skew import heavy_keys, key_totals
from siftmill.operators import skew


def test_key_totals_match_brute_force_with_a_heavy_key(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        user = "hot" if rng.random() < 0.4 else rng.choice([None, " hot ", "\tu1", "u1", f"u{rng.randint(0, 200)}", ""])
        rows.append((user, rng.choice([None, 1.0, 2.5, 5.0]), i, "x"))
    df = spark.createDataFrame(rows, "user string, stars double, n_rows long, field string").repartition(7)
    want = defaultdict(lambda: [0, 0, 0.0])
    for u, s, *_ in rows:
        w = want[u if u is None else u.strip(" \t")]
        w[0] += 1
        if s is not None:
            w[1] += 1
            w[2] += s
    got = {r.key_value: [r.n_rows, r.n_values, r.value_sum] for r in key_totals(df, ["user"], "stars").collect()}
    assert got == dict(want)
    heavy = {r.key_value for r in heavy_keys(key_totals(df, ["user"], "stars"), df.count(), percent=10).collect()}
    assert heavy == {k for k, w in want.items() if k is not None and w[0] * 10 >= len(rows)}


def test_key_totals_fold_within_bounded_memory(spark, monkeypatch):
    arrays = skew._Arrays()
    monkeypatch.setattr(skew, "FOLD_ENTRIES", 10)
    import numpy as np
    import pyarrow as pa

    for i in range(50):
        keys = pa.array([f"k{j % 7}" for j in range(i, i + 20)])
        arrays.add(keys, None, np.ones(20), np.full(20, 0.5))
    rows = [b.to_pylist() for b in arrays.batches("f")]
    assert sum(r["n_rows"] for b in rows for r in b) == 1000 and len(rows[0]) == 7


def test_key_totals_of_empty_null_and_nan(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert key_totals(empty, ["k"], "v").count() == 0
    df = spark.createDataFrame([("a", None), ("a", None), ("b", float("nan")), ("b", 1.0), (None, 3.0)], "k string, v double")
    got = {r.key_value: r.mean_value for r in key_totals(df, ["k"], "v").collect()}
    assert got["a"] is None and math.isnan(got["b"]) and got[None] == 3.0


def _values(spark, text):
    return spark.createDataFrame([(text,)], "c string").select(packed_values("c").alias("v")).first().v


def test_packed_values(spark):
    cases = {
        "Food, Bars": ["Food", "Bars"],
        '"Pots, Pans; Knives"，Kebab/Wrap, Cut / Style': ["Pots, Pans; Knives", "Kebab/Wrap", "Cut", "Style"],
        '"The ""Slow"" Kitchen";"Vinyl 12"", 7"" Records"|Bars': ['The "Slow" Kitchen', 'Vinyl 12", 7" Records', "Bars"],
        '["The \\"Slow\\" Kitchen", "Men\'s Tailors"]': ['The "Slow" Kitchen', "Men's Tailors"],
        "“Sauna; Steam” , Spas: Day, Home & Garden, Arts + Crafts, Bed and Breakfast": ["Sauna; Steam", "Spas: Day", "Home & Garden", "Arts + Crafts", "Bed and Breakfast"],
        "Bars\t\tFood\nBars, , ;Bars /  / Tea": ["Bars", "Food", "Bars", "Bars", "Tea"],
        '"Sauna; Steam"\t  "Pots, Pans"\n  Food \t "Cut / Style" / “Bed | Breakfast”\r\n': ["Sauna; Steam", "Pots, Pans", "Food", "Cut / Style", "Bed | Breakfast"],
        '"Bars"/Food, "a"b, "Bars" /Food': ['"Bars"/Food', '"a"b', '"Bars" /Food'],
        'Vinyl 12", Bars, "open': ['Vinyl 12"', "Bars", '"open'],
        '"""Quoted""", ""': ['"Quoted"'],
        " ; ": [], "": [], "[]": [],
    }
    for text, want in cases.items():
        assert _values(spark, text) == want, text
    assert _values(spark, None) is None


def test_unpack_of_long_fields_and_rows_without_values(spark):
    long = ", ".join(['"a ""b"", c"'] * 20_000)
    df = spark.createDataFrame([(1, long, "x"), (2, None, "y"), (3, " , ", "z"), (4, "p,p", "q")], "id int, c string, value string")
    got = unpack(df, "c", keep=["id"]).collect()
    assert sum(r.id == 1 for r in got) == 20_000 and {r.value for r in got if r.id == 1} == {'a "b", c'}
    assert [(r.pos, r.value) for r in got if r.id == 4] == [(0, "p"), (1, "p")]
    assert unpack(df.limit(0), "c", keep=["id"]).count() == 0


def test_latest_field(spark):
    df = spark.createDataFrame([(" a", "x", 1), ("a", "y", 2), ("a", None, 3), (None, "z", 1)], "k string, c string, t int")
    assert {(r.k, r.c) for r in latest_field(df, "k", "c", "t").collect()} == {("a", "y"), (None, "z")}


T = lambda d: datetime(2020, 1, d)


def test_orphans_by_life_span(spark):
    target = spark.createDataFrame([("a", T(5), None), ("b", T(1), T(3)), (" b", T(10), None), (None, T(1), None)], "k string, since timestamp, until timestamp")
    refs = spark.createDataFrame(
        [(1, "a ", T(5)), (2, "a", T(4)), (3, "b", T(3)), (4, "b", T(2)), (5, "b", T(11)), (6, "c", T(1)), (7, None, T(1)), (8, " \t", T(1)), (9, "a", None), (6, "c", T(1))],
        "id int, ref string, at timestamp",
    )
    link = Link("ref", ["ref"], target, ["k"], since="since", until="until")
    found = orphan_references(refs, [link], keep=["id"], moment="at")
    assert sorted(r.id for r in found.collect()) == [2, 3, 6, 6, 9]
    assert {(r.month, r.n_orphans) for r in orphan_report(found).collect()} == {("2020-01", 4), (None, 1)}
    nothing = Link("ref", ["ref"], target.limit(0), ["k"], since="since", until="until")
    assert orphan_references(refs, [nothing], keep=["id"], moment="at").count() == 8
    assert orphan_references(refs.limit(0), [link], keep=["id"], moment="at").count() == 0


def test_composite_references_by_match(spark):
    target = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "p string, q string")
    refs = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "y"), (4, None, "z"), (5, "c", None), (6, "d", None), (7, None, None)], "id int, p string, q string")
    found = lambda match: sorted(r.id for r in orphan_references(refs, [Link("pq", ["p", "q"], target, ["p", "q"], match=match)], keep=["id"]).collect())
    assert found("simple") == [2]
    assert found("partial") == [2, 4, 6]
    assert found("full") == [2, 3, 4, 5, 6]
