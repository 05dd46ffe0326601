"""Steps that several jobs share read the table once, and what reaches one task or the driver stays small."""
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulario.functions.dates import to_datetime
from tabulario.functions.numbers import to_number
from tabulario.models import unsupervised as U
from tabulario.operators import kpi as K
from tabulario.operators import profile as P
from tabulario.operators import quality as QL
from tabulario.operators import quantiles as Q
from tabulario.operators.copies import without_copies


@pytest.fixture
def counted(spark):
    """A table of 60 rows and how many rows of it were computed so far."""
    seen = spark.sparkContext.accumulator(0)

    def passes(x):
        seen.add(1)
        return x

    df = spark.range(0, 60, 1, 2).select(
        F.udf(passes, "long")("id").alias("folio"), F.concat(F.lit("$ "), F.format_number(F.col("id") * 1000.5, 2)).alias("importe"),
        F.when(F.col("id") % 2 == 0, "Norte").otherwise("norte").alias("zona"))
    return df, seen


def test_rules_read_the_table_once(counted):
    df, seen = counted
    assert QL.detect_issues(df, as_of=date(2026, 1, 1)).where("code = 'numero_como_texto'").count() == 1
    assert seen.value == 60


def test_overview_reads_the_table_once(counted):
    df, seen = counted
    profiles = P.profile(df, stats=False)
    before = seen.value
    assert P.overview(df, profiles).head()["filas_duplicadas"] == 0
    assert seen.value == before + 60


def test_removed_copies_are_counted_without_reading_the_rest(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "b"), (2, "b"), (3, None)], "x int, y string")
    once, n = without_copies(df)
    assert n == 3 and sorted(tuple(r) for r in once.collect()) == [(1, "a"), (2, "b"), (3, None)]
    assert without_copies(df.distinct())[1] == 0


def test_deltas_of_every_unit_come_from_the_daily_totals(spark):
    df = spark.range(800).select(F.expr("timestamp'2024-01-01' + make_dt_interval(id)").alias("fecha"), (F.col("id") + 1.0).alias("importe"))
    mapping = {"fecha": "fecha", "ingreso": "importe"}
    found = spark.createDataFrame([(1, "Registros", 800.0), (2, "Ingreso total", 320400.0)], "position int, kpi string, value double")
    daily = K.totals_by_day(df, mapping)
    broken = df.select(F.raise_error(F.lit("read again")).cast("timestamp").alias("fecha"), "importe")
    for unit in "DWMQY":
        want = [tuple(r) for r in K.with_deltas(found, df, mapping, unit).collect()]
        assert [tuple(r) for r in K.with_deltas(found, broken, mapping, unit, daily).collect()] == want
    assert K.totals_by_day(df, {"ingreso": "importe"}) is None


def test_rows_stay_where_they_are_while_groups_are_few(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.sqrt(F.col("id").cast("double")).alias("v"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = Q.grouped_quantiles(df, ["g"], "v", {"m": 0.5})
        assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
        got = {r["g"]: r["m"] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert got == {g: pytest.approx(float(np.median(np.sqrt(np.arange(g, 5000, 3))))) for g in range(3)}


def test_centres_settle_on_the_sample(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 0.1, (200, 2)) for m in (0.0, 5.0)])
    assert np.allclose(U.settled(x, x[[0, -1]]), [x[:200].mean(0), x[200:].mean(0)])
    vectors = spark.createDataFrame([(v.tolist(),) for v in x], "_v array<double>")
    n, sums, squares = U.cluster_sums(vectors, {2: x[[0, -1]]})[2]
    assert n.tolist() == [200, 200] and np.allclose(sums[0], x[:200].sum(0)) and np.isclose(squares.sum(), (x * x).sum())


def test_short_ways_of_parsing_agree_with_the_long_one(spark):
    numbers = {"$ 1,234.50": 1234.5, "1,234": 1234.0, "-12.5": -12.5, "1,23": 1.23, "1.234,5": 1234.5, "(7)": -7.0, "12 usd": 12.0, "5%": 5.0,
               "a@b1.mx": None, "12/3": None, "N/D": None, "$": None, " 12\u0085": 12.0, "1e3": 1000.0, "1,2345": 1.2345, "12\n": 12.0}
    dates = {"31/12/1899": "1899-12-31", "12/31/2020": "2020-12-31", " 1/2/2020\u0085": "2020-02-01", "2020-1-5": "2020-01-05", "1.2.2020": "2020-02-01",
             "2020/3/4": "2020-03-04", "x1/2/2020": None, "1/2/20": None, "$ 1": None}
    got = spark.createDataFrame([(k,) for k in numbers], "t string").select("t", to_number(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == numbers
    got = spark.createDataFrame([(k,) for k in dates], "t string").select("t", to_datetime(F.col("t")).cast("date").cast("string")).collect()
    assert {r[0]: r[1] for r in got} == dates
