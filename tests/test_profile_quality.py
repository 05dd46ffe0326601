from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tabulario.operators import profile as P
from tabulario.operators import quality as Q
from tabulario.operators import repair as R
from tabulario.plans.autoclean import auto_clean

AS_OF = date(2026, 1, 1)


def codes(df, **kw):
    return {(r["code"], r["column"]) for r in Q.detect_issues(df, as_of=AS_OF, **kw).collect()}


@pytest.fixture(scope="module")
def dirty(spark):
    data = []
    for i in range(300):
        data.append((f"F{i:04d}", "31/12/1899" if i == 7 else f"{1 + i % 28:02d}/{1 + i % 12:02d}/2024",
                     ["Norte", "norte ", "SUR", "Sur"][i % 4], f"$ {1000 + i:,}.50", None if i % 5 == 0 else float(i),
                     "MarÃ­a" if i % 2 else "Ana", None, "fijo"))
    return spark.createDataFrame(data + data[:10], "folio string, fecha string, canal string, importe string, costo double, vendedor string, comentario string, zona string")


def test_planted_errors_are_found(dirty):
    found = codes(dirty)
    for wanted in [("filas_duplicadas", None), ("columna_vacia", "comentario"), ("columna_constante", "zona"), ("nulos", "costo"),
                   ("numero_como_texto", "importe"), ("fecha_como_texto", "fecha"), ("espacios", "canal"), ("mojibake", "vendedor"),
                   ("categorias_inconsistentes", "canal"), ("fechas_imposibles", "fecha"), ("id_duplicado", "folio"), ("hueco_temporal", "fecha")]:
        assert wanted in found, wanted


def test_score_rises_after_cleaning(dirty):
    before = Q.quality_score(Q.detect_issues(dirty, as_of=AS_OF)).head()["score"]
    done = auto_clean(dirty, as_of=AS_OF)
    after = Q.quality_score(Q.detect_issues(done.table, as_of=AS_OF)).head()["score"]
    assert after > before
    assert done.table.count() == 300 and "comentario" not in done.table.columns
    assert {r[0] for r in done.table.select("canal").distinct().collect()} in ({"Norte", "SUR"}, {"norte", "SUR"}, {"Norte", "Sur"}, {"norte", "Sur"})
    assert dict(done.table.dtypes)["importe"] == "double" and done.table.where("fecha < timestamp'1950-01-01'").isEmpty()
    log = {(r["action"], r["column"]): r["n_affected"] for r in done.log.collect()}
    assert log["eliminar_duplicadas", None] == 10 and log["vaciar_fechas", "fecha"] == 2 or log["vaciar_fechas", "fecha"] == 1
    assert done.mapping["ingreso"] == "importe" and done.mapping["costo"] == "costo" and done.mapping["fecha"] == "fecha"


def test_value_out_of_scale_lists_exact_rows(spark):
    values = [1.0] * 300 + [2.0] * 40 + [3.0] * 10 + [50.0] + [1370.0] * 3
    data = [(i, v, 7500000000000 + i * 13, 100.0 + (i * 37 % 900)) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "fila long, Cantidad double, Gtin long, Precio double")
    found = Q.detect_issues(df, row_id="fila", as_of=AS_OF).where("code = 'valor_raro'").collect()
    assert [r["column"] for r in found] == ["Cantidad"]
    assert [x["row"] for x in found[0]["rows"]] == ["351", "352", "353"] and found[0]["n_affected"] == 3
    # position 0 in the table is row 2 of the sheet
    cells = spark.createDataFrame([(351,), (353,)], "r long").select(Q.cell_reference(16, F.col("r")).alias("c")).collect()
    assert [c[0] for c in cells] == ["Q353", "Q355"] and Q.column_letter(27) == "AB" and Q.column_letter(25) == "Z"


def test_cells_of_odd_shape_list_exact_rows(spark):
    data = [(i, 4000 + i if i < 400 else 1, 10000 + i * 7, 5.0 + i * 3.3) for i in range(403)]
    df = spark.createDataFrame(data, "fila long, sku long, cp long, precio double")
    found = {r["column"]: r for r in Q.detect_issues(df, row_id="fila", as_of=AS_OF).where("code = 'celda_rara'").collect()}
    assert list(found) == ["sku"]
    assert [x["row"] for x in found["sku"]["rows"]] == ["400", "401", "402"]


@pytest.mark.parametrize("make", [
    lambda s: s.createDataFrame([(None, None)] * 3, "a string, b double"),
    lambda s: s.createDataFrame([("x",)], "a string"),
    lambda s: s.createDataFrame([], "a string, b double"),
    lambda s: s.createDataFrame([(f"ñandú 🐦 {i}",) for i in range(40)], "`columna rara` string"),
    lambda s: s.createDataFrame([(float("nan"), 1)] * 60, "a double, b int"),
])
def test_edge_frames(spark, make):
    df = make(spark)
    found = Q.detect_issues(df, as_of=AS_OF)
    score = Q.quality_score(found).head()["score"]
    assert 0 <= score <= 100
    if df.isEmpty():
        assert [r["code"] for r in found.collect()] == ["sin_filas"] and score == 0
    else:
        R.apply_plan(df, R.plan_from_issues(found, aggressive=True)).table.count()


def test_name_roles():
    wanted = {"Importe": "monetario", "cantidad": "cantidad", "Fecha de alta": "fecha", "id_cliente": "identificador", "estado": "geografia",
              "cliente": "persona", "correo": "contacto", "Teléfono": "contacto", "pct_avance": "porcentaje", "color": None, "idea": None}
    assert {k: P.name_role(k) for k in wanted} == wanted


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double")
    p = P.profile(df)["v"]
    assert p.n_missing == 2 and p.n_unique == 1 and p.semantic == "constante"


def test_semantics(spark):
    rows = [("si" if i % 2 else "no", f"{i}/01/2024" if i < 28 else "05/02/2024", f"{i}.5", f"K-{i}", "frase larga " * 5 + str(i % 30), bool(i % 2), datetime(2024, 1, 1) + timedelta(i)) for i in range(1, 41)]
    found = P.profile(spark.createDataFrame(rows, "b string, f string, n string, k string, t string, l boolean, d timestamp_ntz"))
    assert {c: p.semantic for c, p in found.items()} == {"b": "booleano", "f": "fecha", "n": "numerico", "k": "identificador", "t": "texto", "l": "booleano", "d": "fecha"}
    assert found["n"].text_stored == "numero" and found["f"].text_stored == "fecha" and found["k"].role == "identificador"


def test_impute_and_clip(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else float(i), None if i % 3 == 0 else "abc"[i % 2]) for i in range(40)] + [(99, 1e6, "a")], "i long, v double, s string")
    out = R.apply_plan(df, R.Plan(impute={"v": "mediana", "s": "moda"}, clip_outliers={"v": "iqr"}))
    pdf = out.table.toPandas()
    assert pdf.v.notna().all() and pdf.s.notna().all() and pdf.v.max() < 1000
    log = {(r["action"], r["column"]): r["n_affected"] for r in out.log.collect()}
    assert log["imputar", "v"] == 10 and log["acotar", "v"] == 1
    gone = R.apply_plan(df, R.Plan(impute={"v": "eliminar_filas"}))
    assert gone.table.count() == 31
    with pytest.raises(ValueError):
        R.apply_plan(df, R.Plan(impute={"v": "ffill"}))


def test_snake_names():
    assert R.snake_names(["Año", "ano", "¡!", "A b"]) == {"Año": "ano", "ano": "ano_1", "¡!": "columna", "A b": "a_b"}


def test_fill_value_in_the_log_has_two_decimals(spark):
    df = spark.createDataFrame([(1, 10.5), (2, 10.53), (3, None)], "i int, v double")
    log = R.apply_plan(df, R.Plan(impute={"v": "mediana"})).log
    assert [r["detail"] for r in log.where("action = 'imputar'").collect()] == ["mediana=10.52"]
    one = spark.createDataFrame([(1, 12.5), (2, None)], "i int, v double")
    log = R.apply_plan(one, R.Plan(impute={"v": "mediana"})).log
    assert [r["detail"] for r in log.where("action = 'imputar'").collect()] == ["mediana=12.50"]
