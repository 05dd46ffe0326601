from datetime import date, datetime, timedelta

import pytest
from py4j.protocol import Py4JError
from pyspark.sql import functions as F

from tabulario.operators import explain as E
from tabulario.operators import geo
from tabulario.operators import groups as G
from tabulario.operators import insight as X
from tabulario.operators import kpi as K
from tabulario.operators import profile as P
from tabulario.operators import series as S
from tabulario.operators import views as V

MAP = {"fecha": "fecha", "ingreso": "importe", "segmento": "seg", "cliente": "cliente"}


@pytest.fixture(scope="module")
def sales(spark):
    rows = []
    for i in range(1200):
        day = datetime(2023, 1, 1) + timedelta(days=i % 600)
        seg = "ABC"[i % 3]
        rows.append((i, day, 100.0 + i % 600 + (400.0 if seg == "A" else 0.0), 50.0, f"c{i % 40}", seg))
    return spark.createDataFrame(rows, "folio long, fecha timestamp_ntz, importe double, costo double, cliente string, seg string")


def test_measures_compose(sales):
    pdf = sales.toPandas()
    m = {"a": (K.suma("importe") - K.suma("costo")) / K.suma("IMPORTE"), "b": K.mediana("importe") * 2 + 1, "c": 1 / K.conteo(),
         "d": K.conteo() % 7, "e": K.percentil("importe", 0.9), "f": -K.suma_si("importe", "seg", "a"), "g": K.abs_(1 - K.promedio("costo")) ** 2}
    row = K.evaluate(sales, m).head()
    assert row["a"] == pytest.approx(1 - pdf.costo.sum() / pdf.importe.sum())
    assert row["b"] == pytest.approx(pdf.importe.median() * 2 + 1) and row["c"] == pytest.approx(1 / 1200) and row["d"] == 1200 % 7
    assert row["e"] == pytest.approx(pdf.importe.quantile(0.9)) and row["f"] == pytest.approx(-pdf[pdf.seg == "A"].importe.sum()) and row["g"] == pytest.approx(49.0 ** 2)
    per = K.evaluate(sales, {"m": K.mediana("importe")}, ["seg"]).toPandas().set_index("seg").m
    assert per.to_dict() == pytest.approx(pdf.groupby("seg").importe.median().to_dict())
    assert (K.suma("x") + K.conteo()).additive and not K.promedio("x").additive and not (K.suma("x") / 2).additive


def test_menu_refuses_incomplete_choices():
    for bad in (("nada",), ("sumar",), ("dividir", "a"), ("porcentaje",)):
        with pytest.raises(K.KpiError):
            K.choose(*bad)
    assert K.choose("margen", "a", "b").fmt == "porcentaje" and "importe" in K.choose("sumar", "importe", None, "seg", "A").name


def test_significant_trend_and_season(spark, sales):
    found = X.generate(sales, P.profile(sales), MAP, as_of=date(2026, 1, 1)).collect()
    by = {r["code"]: r for r in found}
    assert by["tendencia"]["kind"] == "oportunidad" and by["tendencia"]["evidence"]["p"] < 0.05
    assert by["segmento_discrimina"]["evidence"]["p"] < 0.05 and by["datos_viejos"]["kind"] == "riesgo"
    assert "regla_fallida" not in by
    assert [r["impact"] for r in found] == sorted((r["impact"] for r in found), reverse=True)


def test_a_failing_rule_stops_no_other(sales):
    def broken(c):
        raise RuntimeError("x")
    found = X.generate(sales, P.profile(sales), MAP, rules=[broken, X.dispersed, X.segments]).collect()
    assert {"regla_fallida", "segmento_discrimina"} <= {r["code"] for r in found}


def test_a_failed_job_is_no_finding(spark, sales):
    def unknown_column(c):
        c.df.select("no such column").count()

    def division(c):
        spark.range(3).select(F.expr("1 div (id - id)")).collect()

    def lost(c):
        raise Py4JError("job aborted: executor lost")

    profiles = P.profile(sales)
    notes = X.generate(sales, profiles, MAP, rules=[unknown_column, division]).collect()
    assert {r["subject"] for r in notes if r["code"] == "regla_fallida"} == {"unknown_column", "division"}
    with pytest.raises(Py4JError):
        X.generate(sales, profiles, MAP, rules=[lost])


def test_flat_series_has_no_unusual_period(spark):
    flat = spark.createDataFrame([(date(2022 + m // 12, 1 + m % 12, 1), 100.0) for m in range(24)], "period date, value double")
    assert E.unusual_periods(flat).isEmpty()
    spike = flat.withColumn("value", F.when(F.month("period") == 6, 900.0).otherwise(F.col("value") + F.month("period")))
    assert {r["period"].month for r in E.unusual_periods(spike).collect()} == {6}
    assert E.read_series(spike, "M").head()["best_label"].startswith("junio")


def test_spike_is_explained(spark):
    rows = [(datetime(2024, 1 + m, 1 + d), 10.0 + m, "ab"[d % 2], f"c{d}") for m in range(8) for d in range(20)]
    rows.append((datetime(2024, 5, 9), 5000.0, "a", "grande"))
    df = spark.createDataFrame(rows, "fecha timestamp_ntz, importe double, seg string, cliente string")
    series = S.period_series(df, "fecha", "importe", "M", trim=False, drop_incomplete=False)
    row = E.explain_unusual(df, series, "fecha", "importe", "M", {"cliente": "cliente", "segmento": "seg"}).head()
    assert row["period"] == date(2024, 5, 1) and row["single_detail"].startswith("grande") and row["single_share"] > 0.9


def test_period_series_fills_gaps_and_drops_open_end(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 5), 1.0), (datetime(2024, 3, 31), 2.0), (datetime(2024, 4, 10), 9.0)], "f timestamp_ntz, v double")
    got = [(r["period"].month, r["value"], r["n"]) for r in S.period_series(df, "f", "v", "M").orderBy("period").collect()]
    assert got == [(1, 1.0, 1), (2, 0.0, 0), (3, 2.0, 1)]


def test_top_with_others_adds_up(spark):
    df = spark.createDataFrame([(f"k{i}", float(i)) for i in range(20)], "k string, v double")
    got = G.top_with_others(df, 5).collect()
    assert [r["label"] for r in got] == ["k19", "k18", "k17", "k16", "Otros (16)"] and sum(r["value"] for r in got) == 190.0
    assert G.top_with_others(df.limit(3), 5).count() == 3


def test_states(spark):
    names = ["nuevo león", "méxico", "estado de méxico", "jalisco", "SLP", "edo. de sonora", "Monterrey"]
    df = spark.createDataFrame([(n, 1.0) for n in names], "k string, v double")
    got = {r["label"]: r["value"] for r in geo.state_totals(df).collect()}
    assert got == {"Nuevo León": 1.0, "Estado de México": 2.0, "Jalisco": 1.0, "San Luis Potosí": 1.0, "Sonora": 1.0}
    assert geo.recognition(df, "k").head()["es_de_estados"] is True
    assert geo.state_places(spark).count() == 32 and geo.state_names(spark).count() < 200


def test_chart_kinds(spark):
    cats = spark.createDataFrame([("a", 1.0), ("b", -2.0)], "category string, value double")
    kinds = V.chart_kinds(cats, 0, cats, 5)
    got = {r["kind"]: r["ok"] for r in kinds.collect()}
    assert got == {"line": False, "area": False, "bar": True, "pie": False, "hist": False, "box": False, "scatter": False, "mapa": False}
    assert V.chosen_kind(kinds, "pie", "bar") == ("bar", "hay valores negativos") and V.chosen_kind(kinds, "auto", "bar") == ("bar", "")
    assert V.chosen_kind(V.chart_kinds(cats, 5, cats.where("value > 0"), 50, placed=True), "mapa", "bar") == ("mapa", "")
