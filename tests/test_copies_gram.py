"""Repeated rows by fingerprint, correlations of many columns at once, and values carried forward together."""
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulario.operators import copies as C
from tabulario.operators import quality as Q
from tabulario.operators import repair as R


def odd_rows(n=400, seed=3):
    rng = random.Random(seed)
    pick = lambda *v: rng.choice(v)
    return [(pick(None, "a", "b", ""), pick(None, "a", "b"), pick(None, 0.0, -0.0, math.nan, 1.5), pick(1, 2, None)) for _ in range(n)]


ODD = "x string, y string, v double, k int"


def plain(row):
    """Equal cells are equal: -0.0 is 0.0 and NaN is NaN."""
    return tuple("nan" if isinstance(c, float) and math.isnan(c) else 0.0 if c == 0 and isinstance(c, float) else c for c in row)


def planted(df, columns):
    """Fingerprints of which many different rows share one."""
    return [F.abs(F.xxhash64(*columns)) % 5]


@pytest.mark.parametrize("marks", [C.fingerprint, planted, lambda df, columns: [F.lit(1)]])
@pytest.mark.parametrize("broadcast", [True, False])
def test_duplicates_do_not_rest_on_fingerprints(spark, marks, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(C, "BROADCAST", -1)
    data = odd_rows()
    df = spark.createDataFrame(data, ODD).repartition(5)
    distinct = {plain(r) for r in data}
    assert C.duplicate_rows(df, marks).head()[0] == len(data) - len(distinct)
    once = C.first_of_copies(df, marks=marks).collect()
    assert len(once) == len(distinct) and {plain(r) for r in once} == distinct


def test_missing_cells_in_other_columns_are_other_rows(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), (None, None), (None, None)], "x string, y string")
    assert C.duplicate_rows(df).head()[0] == 1
    assert C.first_of_copies(df).count() == 3


def test_first_of_copies_keeps_the_smallest_id(spark):
    data = [(i, *r) for i, r in enumerate(odd_rows())]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "id long, " + ODD).select("x", "id", "y", "v", "k")
    got = C.first_of_copies(df, "id")
    assert got.columns == df.columns
    first = {}
    for i, *r in data:
        first[plain(r)] = min(i, first.get(plain(r), i))
    assert sorted(r["id"] for r in got.collect()) == sorted(first.values())
    missing = spark.createDataFrame([(None, 1), (4, 1), (None, 2)], "id long, v int")
    assert {tuple(r) for r in C.first_of_copies(missing, "id").collect()} == {(4, 1), (None, 2)}


def test_duplicates_of_odd_tables(spark):
    empty = spark.createDataFrame([], ODD)
    assert C.duplicate_rows(empty).head()[0] == 0 and C.first_of_copies(empty).count() == 0
    clash = spark.createDataFrame([(1, 2, 3), (1, 2, 3), (1, 2, 4)], "_copies int, _f0 int, _n int")
    assert C.duplicate_rows(clash).head()[0] == 1 and C.first_of_copies(clash).columns == clash.columns
    dotted = spark.createDataFrame([(1,), (1,)], "`a.b` int")
    assert C.duplicate_rows(dotted).head()[0] == 1 and C.first_of_copies(dotted).count() == 1
    maps = spark.sql("SELECT * FROM VALUES (map('a', 1, 'b', 2), array(1)), (map('b', 2, 'a', 1), array(1)), (map('a', 1), array(1)) t(m, l)")
    assert C.duplicate_rows(maps).head()[0] == 1
    one = spark.createDataFrame([(3,), (1,), (None,)], "id int")
    assert [r["id"] for r in C.first_of_copies(one, "id").collect()] == [1]


def test_rows_without_a_repeated_fingerprint_are_not_shuffled(spark):
    df = spark.range(1000).select("id", F.repeat(F.lit("long text "), 50).alias("t"))
    plan = C.Copies(df.unionByName(df.limit(3))).single()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def pair_frame(df, columns, complete=False):
    return {(r["a"], r["b"]): (r["n"], r["r"]) for r in Q.correlations(df, columns, complete).collect()}


def test_correlations_of_two_hundred_columns(spark):
    rng = np.random.default_rng(0)
    common = rng.normal(size=(500, 1))
    x = common * rng.normal(size=200) + rng.normal(size=(500, 200)) + rng.choice([0, 1e6], 200)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 7], x[:, 8] = np.nan, np.where(np.isnan(x[:, 8]), np.nan, 0.1)
    pdf = pd.DataFrame(x, columns=[f"c {i}" for i in range(200)])
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"`{c}` double" for c in pdf.columns)).repartition(6)
    got = pair_frame(df, list(pdf.columns))
    assert len(got) == 200 * 199 // 2
    want = pdf.corr().to_numpy()
    present = pdf.notna().to_numpy().astype(int)
    n = present.T @ present
    for i in range(200):
        for j in range(i + 1, 200):
            count, r = got[f"c {i}", f"c {j}"]
            assert count == n[i, j]
            if i in (7, 8) or j in (7, 8):
                assert r is None
            else:
                assert r == pytest.approx(want[i, j], abs=1e-8)


def test_correlations_of_complete_rows_and_far_from_zero(spark):
    pdf = pd.DataFrame({"a": [1e9 + i for i in range(40)], "b": [2e9 + i * i for i in range(40)], "c": [None if i % 3 else float(-i) for i in range(40)]})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double").repartition(7)
    got, whole = pair_frame(df, ["a", "b", "c"]), pdf.dropna()
    assert got["a", "b"] == (40, pytest.approx(pdf.a.corr(pdf.b), abs=1e-8)) and got["a", "c"] == (14, pytest.approx(-1))
    complete = pair_frame(df, ["a", "b", "c"], True)
    assert complete["a", "b"] == (14, pytest.approx(whole.a.corr(whole.b), abs=1e-8))


def test_correlations_of_odd_tables(spark):
    assert pair_frame(spark.createDataFrame([], "a double, b int"), ["a", "b"]) == {("a", "b"): (0, None)}
    assert pair_frame(spark.createDataFrame([(1.0, 2)], "a double, b int"), ["a", "b"]) == {("a", "b"): (1, None)}
    assert pair_frame(spark.createDataFrame([(1.0,)], "a double"), ["a"]) == {}
    far = spark.createDataFrame([(math.inf, 1.0, 2.0), (1.0, 2.0, 4.0), (2.0, 3.0, 6.0)], "a double, b double, c double")
    got = pair_frame(far, ["a", "b", "c"])
    assert got["a", "b"] == (3, None) and got["b", "c"] == (3, pytest.approx(1))


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_carry_many_columns_forward_in_one_range(spark, keys, monkeypatch):
    rng = random.Random(5)
    pdf = pd.DataFrame({"g": [rng.choice("ab") for _ in range(300)], "i": range(300),
                        "s": [rng.choice([None, None, None, "x", "y"]) for _ in range(300)],
                        "t": [rng.choice([None, None, 1, 2, 3]) for _ in range(300)],
                        "none": [None] * 300}, dtype=object)
    df = spark.createDataFrame(pdf, "g string, i long, s string, t long, none string").repartition(4)
    calls, ranges = [], R.Q.ranges
    monkeypatch.setattr(R.Q, "ranges", lambda *a: calls.append(1) or ranges(*a))
    got = R.carry_forward(df, ["s", "t", "none"], "i", keys).orderBy("i").collect()
    assert len(calls) == 1
    for c in ("s", "t"):
        want = pdf.groupby("g")[c].transform(lambda x: x.ffill().bfill()) if keys else pdf[c].ffill().bfill()
        assert [r[c] for r in got] == want.tolist()
    assert all(r["none"] is None for r in got)


def test_plan_carries_forward_together_up_to_a_removal(spark, monkeypatch):
    rows = [(1, None, "p", None), (2, "a", None, 1), (3, None, "q", None), (4, None, None, 4), (5, "b", None, None)]
    df = spark.createDataFrame(rows, "i int, s string, t string, k int")
    calls, ranges = [], R.Q.ranges
    monkeypatch.setattr(R.Q, "ranges", lambda *a: calls.append(1) or ranges(*a))
    out = R.apply_plan(df, R.Plan(impute={"s": "ffill", "t": "ffill"}), row_id="i")
    assert [tuple(r) for r in out.table.orderBy("i").collect()] == [
        (1, "a", "p", None), (2, "a", "p", 1), (3, "a", "q", None), (4, "a", "q", 4), (5, "b", "q", None)]
    assert len(calls) == 1 and [r["n_affected"] for r in out.log.orderBy("step").collect()][:2] == [3, 3]
    out = R.apply_plan(df, R.Plan(impute={"s": "ffill", "k": "eliminar_filas", "t": "ffill"}), row_id="i")
    assert [tuple(r) for r in out.table.orderBy("i").collect()] == [(2, "a", None, 1), (4, "a", None, 4)]
    assert len(calls) == 3
