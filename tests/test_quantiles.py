import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulario.operators import groups as G
from tabulario.operators import quantiles as Q
from tabulario.operators import repair as R
from tabulario.operators.kpi import evaluate, mediana, percentil

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


@pytest.fixture(params=[1_000_000, 20], ids=["one bracket", "brackets inside brackets"])
def distributed(request, monkeypatch):
    """With few candidates allowed, brackets are sketched again from the inside, as they are on very large tables."""
    monkeypatch.setattr(Q, "CANDIDATES", request.param)


def skewed(n=60_000, seed=1):
    rng = np.random.default_rng(seed)
    v = np.round(rng.lognormal(3, 2, n), 2)
    v[: n // 3] = 7.0  # one value holds a third of the rows
    return pd.DataFrame({"g": np.where(np.arange(n) % 3 < 2, "a", rng.choice(list("bcd"), n)), "v": rng.permutation(v)})


def test_quantiles_match_pandas(spark, distributed):
    pdf = skewed()
    df = spark.createDataFrame(pdf)
    assert Q.quantiles(df, "v", PROBS) == pytest.approx(pdf.v.quantile(PROBS).tolist())
    per = Q.grouped_quantiles(df, ["g"], "v", {"q1": 0.25, "q2": 0.5, "q9": 0.9}).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert per.loc[g].tolist() == pytest.approx(part.v.quantile([0.25, 0.5, 0.9]).tolist())


def test_small_and_empty_tables(spark, distributed):
    pdf = skewed(3000)
    df = spark.createDataFrame(pdf)
    assert Q.quantiles(df, "v", PROBS) == pytest.approx(pdf.v.quantile(PROBS).tolist())
    assert Q.quantiles(df.where("v < 0"), "v", [0.5]) == [None]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 900])
def test_groups_of_any_size(spark, n):
    pdf = pd.DataFrame({"g": ["x"] * n + [None] * (n + 1), "v": np.random.default_rng(n).normal(size=2 * n + 1)})
    probs = {"a": 0.1, "b": 0.25, "c": 0.5, "d": 0.9, "e": 0.99}
    got = {r["g"]: r for r in Q.grouped_quantiles(spark.createDataFrame(pdf, "g string, v double"), ["g"], "v", probs).collect()}
    for g, part in pdf.groupby("g", dropna=False):
        row = got[None if pd.isna(g) else g]
        assert [row[k] for k in probs] == pytest.approx(part.v.quantile(list(probs.values())).tolist())


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=80))
def test_any_small_list(spark, distributed, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert Q.quantiles(df, "v", [0.25, 0.5]) == pytest.approx(np.quantile(values, [0.25, 0.5]).tolist(), rel=1e-9, abs=1e-6)


@pytest.mark.parametrize("fraction, k", [(0.01, Q.one_percent), (0.1, Q.rounded_share(0.1)), (0.2, Q.rounded_share(0.2))])
def test_top_k_sum(spark, distributed, fraction, k):
    pdf = skewed(40_001)
    row = Q.top_k_sum(spark.createDataFrame(pdf), "v", fraction, k).head()
    size = k(len(pdf))
    assert row["k"] == size and row["n"] == len(pdf)
    assert row["top_sum"] == pytest.approx(pdf.v.nlargest(size).sum())


def test_descending_prefix(spark):
    pdf = skewed(20_000)
    out = Q.descending_prefix(spark.createDataFrame(pdf).select("v"), "v").agg(F.sum("c"), F.max("upto"), F.max("n")).head()
    assert out[0] == out[2] == len(pdf) and out[1] == pytest.approx(pdf.v.sum())
    ordered = pdf.v.sort_values(ascending=False)
    tail = G.long_tail(spark.createDataFrame(pdf).select(F.lit("k").alias("k"), "v")).head()
    assert tail["n_total"] == len(pdf) and abs(tail["n_tail"] - (ordered.cumsum() / ordered.sum() > 0.95).sum()) <= 1


@pytest.mark.parametrize("keys", [None, ["g"]])
def test_carry_forward(spark, keys):
    pdf = skewed(8_000)
    pdf["i"] = np.arange(len(pdf))
    pdf["s"] = [None if i % 7 < 5 or i > 7900 or i < 40 else f"x{i}" for i in pdf.i]
    got = R.carry_forward(spark.createDataFrame(pdf, "g string, v double, i long, s string"), "s", "i", keys).orderBy("i").toPandas()["s"]
    want = pdf.groupby("g").s.transform(lambda x: x.ffill().bfill()) if keys else pdf.s.ffill().bfill()
    assert got.tolist() == want.tolist()


def test_carry_forward_by_text_and_ties(spark):
    """Text orders as text; a third of the rows share one order value."""
    rows = [("a" if i % 3 == 0 else f"b{i:04d}", f"x{i}" if i % 5 == 0 else None) for i in range(3000)]
    got = R.carry_forward(spark.createDataFrame(rows, "o string, s string"), "s", "o").toPandas()
    assert got.s.notna().all() and len(got) == 3000
    last = None
    for o, s in sorted(r for r in rows if r[0] != "a"):
        last = s or last
        if last:
            assert got[got.o == o].s.tolist() == [last]


def test_quantiles_of_several_columns_in_one_search(spark, monkeypatch):
    rng = random.Random(8)
    pdf = pd.DataFrame({"g": [rng.choice("abbbb") for _ in range(500)], "x": [rng.choice([None, rng.random(), 1.0]) for _ in range(500)],
                        "y": [rng.gauss(0, 5) for _ in range(500)]})
    pdf.loc[pdf.g == "a", "x"] = None
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g string, x double, y double")
    calls, one = [], Q.grouped_quantiles
    monkeypatch.setattr(Q, "grouped_quantiles", lambda *a: calls.append(1) or one(*a))
    wanted = {"xm": ("x", 0.5), "x9": ("x", 0.9), "ym": ("y", 0.5), "y1": ("y", 0.1)}
    got = Q.grouped_quantiles_of(df, ["g"], wanted).toPandas().set_index("g")
    assert len(calls) == 1 and set(got.index) == {"a", "b"}
    for name, (c, p) in wanted.items():
        want = pdf.groupby("g")[c].quantile(p)
        for g in "ab":
            assert (pd.isna(got.at[g, name]) and pd.isna(want[g])) or abs(got.at[g, name] - want[g]) < 1e-9
    assert Q.grouped_quantiles_of(df.limit(0), ["g"], wanted).count() == 0


def test_grouped_measures_share_one_search(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, None), ("b", 7.0, None), (None, 9.0, 9.0)], "g string, x double, y double")
    calls, one = [], Q.grouped_quantiles
    monkeypatch.setattr(Q, "grouped_quantiles", lambda *a: calls.append(1) or one(*a))
    got = evaluate(df, {"mx": mediana("x"), "my": mediana("y"), "px": percentil("x", 90)}, ["g"]).orderBy("g").collect()
    assert len(calls) == 1
    assert [tuple(r) for r in got] == [("a", 2.0, 5.0, 2.8), ("b", 7.0, None, 7.0)]
