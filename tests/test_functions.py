import math

import pytest
from pyspark.sql import functions as F

from tabulario.functions import dates, numbers, statistics, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).head()[0]


@pytest.mark.parametrize("given, wanted", [
    ("$ 1,234.50", 1234.5), ("1.234,50", 1234.5), ("(500)", -500.0), ("12%", 12.0), ("1,23", 1.23), ("1,234", 1234.0),
    (",234", 0.234), ("MXN 100", 100.0), ("250 pesos", 250.0), ("  7 ", 7.0), ("-3.5", -3.5), ("1e3", 1000.0), (" 1 000 ", 1000.0),
    ("N/A", None), ("nd", None), ("--", None), ("", None), ("hola", None), ("12d", None), (None, None), ("1,23,4", None), ("€9", 9.0),
])
def test_to_number(spark, given, wanted):
    assert one(spark, given, numbers.to_number) == wanted


@pytest.mark.parametrize("given, wanted", [
    ("2024-03-01", "2024-03-01 00:00:00"), ("2024-03-01 10:20:30", "2024-03-01 10:20:30"), ("2024-03-01T10:20:30", "2024-03-01 10:20:30"),
    ("2024/3/1", "2024-03-01 00:00:00"), ("5/3/2024", "2024-03-05 00:00:00"), ("25/12/2024", "2024-12-25 00:00:00"),
    ("12/25/2024", "2024-12-25 00:00:00"), ("5-3-2024", "2024-03-05 00:00:00"), ("5.3.2024", "2024-03-05 00:00:00"),
    ("31/12/1899", "1899-12-31 00:00:00"), ("99/99/2024", None), ("2024", None), ("texto", None), (None, None),
])
def test_to_datetime(spark, given, wanted):
    found = one(spark, given, dates.to_datetime)
    assert (str(found) if found else None) == wanted


@pytest.mark.parametrize("given, wanted", [
    ("MarÃ­a", "María"), ("CafÃ© y piÃ±a", "Café y piña"), ("limpio", "limpio"), ("María Ã±", "María ñ"), ("Ã‘andÃº", "Ñandú"), (None, None),
])
def test_fix_mojibake(spark, given, wanted):
    assert one(spark, given, text.fix_mojibake) == wanted


def test_text_keys(spark):
    assert one(spark, "  ÁRBOL   Ñandú\t", text.norm_key) == "arbol nandu"
    assert one(spark, "Nº de  Pedido / Año", text.slug) == "nº_de_pedido_ano"
    assert one(spark, "///", text.slug) == "columna"
    assert one(spark, " a  b ", text.collapse_spaces) == "a b"
    assert one(spark, "4088.0", text.label) == "4088"
    assert one(spark, None, text.label) == "(sin dato)"
    assert one(spark, "S.L.P.", text.plain_place) == "s l p"
    assert one(spark, "a@b.co", text.is_email) is True
    assert one(spark, "a@b", text.is_email) is False
    assert one(spark, "+52 (55) 1234-5678", text.is_phone) is True


def test_display(spark):
    values = [(1.5e9, "1.50B"), (2.5e6, "2.50M"), (34500.0, "34.5K"), (1234.5, "1,234.50"), (0.0, "0"), (0.1234, "0.1234"), (-2e6, "-2.00M")]
    df = spark.createDataFrame(values, "v double, w string").select(numbers.human(F.col("v")).alias("r"), "w")
    assert all(r["r"] == r["w"] for r in df.collect())
    df = spark.createDataFrame([(0.1234, "porcentaje", "12.3%"), (2.0, "entero", "2"), (10.0, "moneda", "$10.00"), (None, "numero", "—")], "v double, f string, w string")
    assert all(r["r"] == r["w"] for r in df.select(numbers.display(F.col("v"), F.col("f")).alias("r"), "w").collect())


def test_period_labels(spark):
    d = spark.sql("select date'2024-03-04' as d")
    row = d.select(*[dates.period_label(F.col("d"), u) for u in "DWQM"]).head()
    assert list(row) == ["4 de marzo de 2024 (lunes)", "la semana del 4 de marzo de 2024", "el trimestre 1 de 2024", "marzo de 2024"]
    ends = d.select(*[dates.period_end(dates.period_start(F.col("d"), u), u).cast("string") for u in "DWMQY"]).head()
    assert list(ends) == ["2024-03-04", "2024-03-10", "2024-03-31", "2024-03-31", "2024-12-31"]


def test_tails():
    # published table values
    assert abs(statistics.t_two_sided(2.228, 10) - 0.05) < 1e-4
    assert abs(statistics.f_tail(4.10, 2, 10) - 0.05) < 1e-3
    assert abs(statistics.incomplete_beta(2, 3, 0.5) - 0.6875) < 1e-12
    assert statistics.f_tail(0.0, 3, 5) == 1.0 and math.isclose(statistics.t_two_sided(0.0, 5), 1.0)


def test_functions_run_on_streams(spark, tmp_path):
    spark.createDataFrame([("$ 5",), ("x",)], "v string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("v string").parquet(str(tmp_path / "in")).select(numbers.to_number(F.col("v")).alias("r"))
    q = stream.writeStream.format("memory").queryName("numbers_out").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r[0] or 0 for r in spark.table("numbers_out").collect()) == [0, 5.0]


@pytest.mark.parametrize("given, wanted", [("999.5", 3), ("-999.99", 3), ("1000", 4), ("0.7", 1), ("123456789012345678", 18), ("1e30", 31), ("inf", None), ("nan", None)])
def test_digits_of_a_number_are_cut_not_rounded(spark, given, wanted):
    assert one(spark, given, lambda c: text.shape_length(c.cast("double"), numeric=True)) == wanted
