"""Models: features, leakage, guards, metrics, training, segments, anomalies, forecasts, scoring."""
from __future__ import annotations


from pyspark.sql import functions as F

from checks.q_kpi import W_DEMO, rounded
from checks.registry import query, r, rs
from checks.views import table, ventas_demo
from tabulario.models import evaluate as M
from tabulario.models import features as FT
from tabulario.models import forecast as FC
from tabulario.models import prepare as PR
from tabulario.models import supervised as SV
from tabulario.models import unsupervised as U
from tabulario.models.scoring import SavedModel, score
from tabulario.operators import intake as I
from tabulario.operators import profile as P
from tabulario.session import held


@query("mod-01", f"""{W_DEMO}, h AS (SELECT COUNT(DISTINCT cliente) AS c, COUNT(DISTINCT folio) / COUNT(*) AS f FROM ventas_demo)
SELECT v.c AS "column", v.u AS uso, CASE WHEN v.c = 'cliente' THEN concat(h.c, ' categorías') ELSE v.m END AS motivo FROM h, (VALUES ('folio','excluida','identificador'), ('fecha','fecha',''), ('cliente','excluida',''),
('segmento','categorica',''), ('estado','categorica',''), ('producto','categorica',''), ('cantidad','numerica',''), ('importe','numerica',''), ('costo','numerica','')) v(c, u, m) WHERE h.f > 0.95 AND h.c > 50""")
def mod_01(spark, sf):
    df = ventas_demo(spark, sf)
    return FT.features_frame(df, FT.usable_features(P.profile(df), "estatus"))


@query("mod-02", """SELECT c AS "column", t AS task FROM (SELECT COUNT(DISTINCT l_extendedprice) AS a, COUNT(DISTINCT l_linenumber) AS b, COUNT(DISTINCT l_discount) AS d, COUNT(DISTINCT l_returnflag) AS e FROM lineitem),
LATERAL (VALUES ('l_extendedprice', CASE WHEN a > 10 THEN 'regresión' ELSE 'clasificación' END), ('l_linenumber', CASE WHEN b > 20 THEN 'regresión' ELSE 'clasificación' END),
('l_discount', CASE WHEN d > 10 THEN 'regresión' ELSE 'clasificación' END), ('l_returnflag', 'clasificación')) v(c, t)""")
def mod_02(spark, sf):
    df = table(spark, sf, "lineitem").select("l_extendedprice", "l_linenumber", "l_discount", "l_returnflag")
    found = P.profile(df, stats=False)
    return I.rows(spark, [(c, FT.infer_task(df, c, found[c].n_unique)) for c in df.columns], "column string, task string")


_MONEY = "SELECT folio, concat('$ ', {f}) AS importe, fecha FROM {t}"


@query("mod-03", f"{W_DEMO} SELECT folio, importe AS num__importe, CAST(year(fecha) AS DOUBLE) AS fecha__anio, CAST(month(fecha) AS DOUBLE) AS fecha__mes, CAST(isodow(fecha) - 1 AS DOUBLE) AS fecha__dia_semana FROM ventas_demo")
def mod_03(spark, sf):
    df = spark.sql(_MONEY.format(f="format_number(importe, 2)", t="{t}"), t=ventas_demo(spark, sf))
    return PR.ColumnCoercer(numeric=["importe"], dates=["fecha"]).transform(df).drop("importe", "fecha")


@query("mod-04", f"{W_DEMO}, k AS (SELECT COUNT(DISTINCT segmento) + COUNT(DISTINCT estado) AS k FROM ventas_demo) SELECT folio, {rs('(importe - avg(importe) OVER ()) / stddev_samp(importe) OVER ()', 4)} AS importe, {rs('(cantidad - avg(cantidad) OVER ()) / stddev_samp(cantidad) OVER ()', 4)} AS cantidad, 2e0 AS marcas, CAST(5 + k AS INTEGER) AS ancho FROM ventas_demo, k")
def mod_04(spark, sf):
    """Numbers and date parts centred and scaled, then one mark per category of each column."""
    from pyspark.ml.functions import vector_to_array
    df = ventas_demo(spark, sf)
    features = FT.Features(("importe", "cantidad"), ("segmento", "estado"), ("fecha",), ())
    v = PR.fit_features(df, features).transform(df).select("folio", vector_to_array("features").alias("v"))
    marks = F.aggregate(F.slice("v", F.lit(6), F.size("v")), F.lit(0.0), lambda a, x: a + x)
    return v.select("folio", r(F.col("v")[0], 4).alias("importe"), r(F.col("v")[1], 4).alias("cantidad"), marks.alias("marcas"), F.size("v").alias("ancho"))


_LEAKY = "SELECT segmento, estatus, concat(segmento, '-', folio % 10) AS derivada, estado, importe, CASE segmento WHEN 'BUILDING' THEN 1000e0 ELSE 0e0 END + importe % 500 AS separa, CASE WHEN segmento = 'BUILDING' THEN 'si' ELSE 'no' END AS clase FROM ventas_demo"


@query("mod-05", f"{W_DEMO}, v AS ({_LEAKY}), p AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS c, COUNT(DISTINCT clase) AS k FROM v GROUP BY 2" for c in ("derivada", "estado", "estatus"))
       + "), n AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", max({c}) FILTER (WHERE clase = 'no') < min({c}) FILTER (WHERE clase = 'si') OR max({c}) FILTER (WHERE clase = 'si') < min({c}) FILTER (WHERE clase = 'no') AS fuga FROM v" for c in ("importe", "separa"))
       + f""") SELECT "column", {rs('avg(CASE WHEN k = 1 THEN 1e0 ELSE 0e0 END)', 6)} AS purity, avg(CASE WHEN k = 1 THEN 1e0 ELSE 0e0 END) > 0.98 AND COUNT(*) > 2 AS fuga FROM p GROUP BY 1 UNION ALL SELECT "column", NULL, fuga FROM n""")
def mod_05(spark, sf):
    df = spark.sql(_LEAKY.replace("ventas_demo", "{t}"), t=ventas_demo(spark, sf))
    cats = FT.category_leaks(df, ["derivada", "estado", "estatus"], "clase").select("column", r("purity", 6).alias("purity"), F.col("leaks").alias("fuga"))
    nums = FT.range_leaks(df, ["importe", "separa"], "clase").select("column", F.lit(None).cast("double").alias("purity"), F.col("separated").alias("fuga"))
    return cats.unionByName(nums)


@query("win-07", f"{W_DEMO}, r AS (SELECT segmento AS y, min(importe) AS lo, max(importe) AS hi FROM ventas_demo GROUP BY 1), o AS (SELECT lo, max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS antes FROM r) SELECT 'importe' AS \"column\", COUNT(*) AS classes, bool_and(COALESCE(antes < lo, true)) AS separated FROM o")
def win_07(spark, sf):
    return FT.range_leaks(ventas_demo(spark, sf), ["importe"], "segmento")


_COPY = "SELECT l_extendedprice AS objetivo, l_extendedprice * 1.16e0 AS facturado, l_quantity AS cantidad, l_discount AS rebaja FROM lineitem"


@query("mod-06", f"WITH v AS ({_COPY}) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {rs(f'corr({c}, objetivo)', 4)} AS r, abs(corr({c}, objetivo)) > 0.98 AS leaks FROM v" for c in ("facturado", "cantidad", "rebaja")))
def mod_06(spark, sf):
    df = spark.sql(_COPY.replace(" lineitem", " {t}"), t=table(spark, sf, "lineitem"))
    return rounded(FT.target_correlations(df, ["facturado", "cantidad", "rebaja"], "objetivo"), 4)


@query("mod-07", "SELECT CAST(p_size AS VARCHAR) AS y, COUNT(*) AS n, COUNT(*) >= 5 AS usable FROM part GROUP BY 1")
def mod_07(spark, sf):
    return FT.class_counts(table(spark, sf, "part"), "p_size")


@query("mod-08", f"{W_DEMO}, c AS (SELECT segmento AS y, COUNT(*) AS n FROM ventas_demo GROUP BY 1) SELECT y, n, true AS exacta FROM c")
def mod_08(spark, sf):
    placed = SV.split(ventas_demo(spark, sf), F.col("segmento"), SV.Settings())
    per = placed.groupBy(F.col("segmento").alias("y")).agg(F.count("*").alias("n"), F.count_if("_train").alias("t"))
    return per.select("y", "n", (F.abs(F.col("t") - 0.75 * F.col("n")) <= 1).alias("exacta"))


_GUESS = "SELECT estatus AS real, CASE WHEN folio % 10 < 7 THEN estatus WHEN folio % 2 = 0 THEN 'Pagado' ELSE 'Cancelado' END AS predicho, importe, importe * (0.9e0 + (folio % 21) / 100e0) AS estimado FROM ventas_demo"


@query("mod-11", f"{W_DEMO}, c AS (SELECT estatus, COUNT(*) AS n FROM ventas_demo GROUP BY 1) SELECT (SELECT estatus FROM c ORDER BY n DESC, estatus LIMIT 1) AS clase, {rs('avg(importe)')} AS media FROM ventas_demo")
def mod_11(spark, sf):
    df = ventas_demo(spark, sf)
    return df.limit(1).select(M.baseline_class(df, "estatus").alias("clase"), r(M.baseline_mean(df, "importe")).alias("media"))


def _guesses(spark, sf):
    return spark.sql(_GUESS.replace("ventas_demo", "{t}"), t=ventas_demo(spark, sf))


_CELLS = f"{W_DEMO}, v AS ({_GUESS}), m AS (SELECT real, predicho, COUNT(*) AS n FROM v GROUP BY ALL), k AS (SELECT DISTINCT real AS c FROM m UNION SELECT DISTINCT predicho FROM m), s AS (SELECT c, (SELECT sum(n) FROM m WHERE real = c) AS r, (SELECT sum(n) FROM m WHERE predicho = c) AS p, (SELECT sum(n) FROM m WHERE real = c AND predicho = c) AS h FROM k)"


@query("mod-12", f"{_CELLS} SELECT {rs('sum(h) / sum(r)', 6)} AS exactitud, {rs('avg(h / r)', 6)} AS exactitud_balanceada, {rs('avg(2e0 * h / (r + p))', 6)} AS f1_macro FROM s")
def mod_12(spark, sf):
    return rounded(M.classification_metrics(M.confusion(_guesses(spark, sf), "real", "predicho")), 6)


@query("set-02", f"{W_DEMO}, v AS ({_GUESS}) SELECT real AS clase FROM v UNION SELECT predicho FROM v")
def set_02(spark, sf):
    return M.labels(_guesses(spark, sf), "real", "predicho")


@query("mod-13", f"{W_DEMO}, v AS ({_GUESS}) SELECT {rs('1 - sum(power(importe - estimado, 2)) / (COUNT(*) * var_pop(importe))', 6)} AS r2, {rs('avg(abs(importe - estimado))', 4)} AS mae, {rs('sqrt(avg(power(importe - estimado, 2)))', 4)} AS rmse, {rs('avg(abs((importe - estimado) / importe))', 6)} AS mape FROM v")
def mod_13(spark, sf):
    return rounded(M.regression_metrics(_guesses(spark, sf), "importe", "estimado"), 4, r2=6, mape=6)


@query("mod-15", f"{_CELLS}, x AS (SELECT avg(h / r) AS s, 1e0 / COUNT(*) AS b FROM s) SELECT l, CASE WHEN l > 0 THEN 'fuga' WHEN s <= b + 0.02e0 THEN 'no_supera' WHEN s < 0.6e0 THEN 'debil' ELSE 'claro' END AS verdict FROM x, (VALUES (0), (1)) v(l)")
def mod_15(spark, sf):
    one = M.classification_metrics(M.confusion(_guesses(spark, sf), "real", "predicho"))
    cases = one.withColumn("l", F.explode(F.array(F.lit(0), F.lit(1))))
    return cases.select("l", M.verdict(FT.CLASSIFICATION, F.col("exactitud_balanceada"), F.lit(1 / 3), F.col("l")).alias("verdict"))


_SALES = "SELECT importe, costo, cantidad, segmento, producto, estatus, CASE WHEN importe > 100000e0 THEN 'grande' ELSE 'chica' END AS talla FROM ventas_demo"


def _trained(spark, sf, kind):
    """The table and the report of a training with all candidates at full effort."""
    sales = spark.sql(_SALES.replace("ventas_demo", "{t}"), t=ventas_demo(spark, sf))
    df = sales.drop("importe") if kind == "talla" else sales.drop("talla", "costo")
    return df, SV.run_supervised(df, P.profile(df), kind, SV.Settings())


_TALLA = "CASE WHEN importe > 100000e0 THEN 'grande' ELSE 'chica' END"


@query("mod-09", f"""{W_DEMO} SELECT {_TALLA} AS talla, COUNT(*) AS n, true AS exacta, true AS iguales, true AS dentro, 0.5e0 AS base, 3 AS modelos, 2 AS clases FROM ventas_demo GROUP BY 1""")
def mod_09(spark, sf):
    """Rows per class, the exact share held out, and metrics computed anew from the stored predictions."""
    df, report = _trained(spark, sf, "talla")
    held = report.predictions.select("talla", "_prediccion")
    hit = F.col("talla") == F.col("_prediccion")
    per = held.groupBy("talla").agg(F.count("*").alias("prueba"), F.count_if(hit).alias("aciertos"))
    balanced, exact = per.agg(F.avg(F.col("aciertos") / F.col("prueba")), F.sum("aciertos") / F.sum("prueba")).head()
    same = abs(balanced - report.metrics["exactitud_balanceada"]) < 1e-9 and abs(exact - report.metrics["exactitud"]) < 1e-9
    inside = all(0 <= mean <= 1 for mean, _ in report.candidates.values()) and 0.5 <= report.metrics["roc_auc"] <= 1
    return df.groupBy("talla").agg(F.count("*").alias("n")).join(per, "talla").select(
        "talla", "n", (F.abs(F.col("prueba") - 0.25 * F.col("n")) <= 1).alias("exacta"), F.lit(same).alias("iguales"), F.lit(inside).alias("dentro"),
        F.lit(report.baseline["exactitud_balanceada"]).alias("base"), F.lit(len(report.candidates)).alias("modelos"), F.lit(len(report.classes)).alias("clases"))


@query("mod-10", f"""{W_DEMO} SELECT COUNT(*) AS n, COUNT(*) - CAST(floor((COUNT(*) - 1) * 0.75e0) + 1 AS BIGINT) AS prueba, true AS iguales, true AS base_nula, 3 AS modelos FROM ventas_demo""")
def mod_10(spark, sf):
    """Rows, rows held out, and metrics computed anew from the stored predictions."""
    df, report = _trained(spark, sf, "importe")
    miss = F.col("importe") - F.col("prediction")
    n, r2, mae, rmse = report.predictions.agg(
        F.count("*"), 1 - F.sum(miss * miss) / (F.count("*") * F.var_pop("importe")), F.avg(F.abs(miss)), F.sqrt(F.avg(miss * miss))).head()
    same = all(abs(found / report.metrics[k] - 1) < 1e-9 for k, found in (("r2", r2), ("mae", mae), ("rmse", rmse)))
    return df.agg(F.count("*").alias("n")).select("n", F.lit(n).alias("prueba"), F.lit(same).alias("iguales"),
                                                  F.lit(-0.1 < report.baseline["r2"] <= 0).alias("base_nula"), F.lit(len(report.candidates)).alias("modelos"))


@query("mod-14", """SELECT v AS variable, true AS medida, CAST(1 AS BIGINT) AS filas FROM (VALUES ('cantidad'), ('segmento'), ('producto'), ('estatus')) t(v)""")
def mod_14(spark, sf):
    ranked = SV.permutation_importance(_trained(spark, sf, "importe")[1])
    return ranked.groupBy("variable").agg(F.bool_and(F.col("importancia").between(-5.0, 5.0)).alias("medida"), F.count("*").alias("filas"))


@query("mod-16", f"{W_DEMO} SELECT COUNT(*) AS registros, {rs('avg(importe)', 1)} AS importe, true AS hay, true AS iguales, COUNT(DISTINCT segmento) AS segmentos FROM ventas_demo")
def mod_16(spark, sf):
    """Whole counts and means, and each segment's row of the summary computed anew from the labels."""
    df = ventas_demo(spark, sf).select("importe", "costo", "cantidad", "segmento")
    with held(df):
        found = U.run_clustering(df, P.profile(df))
    anew = found.rows.groupBy(U.SEGMENT).agg(F.count("*").alias("n"), F.avg("importe").alias("i"), F.avg("costo").alias("c"))
    same = F.bool_and((F.col("registros") == F.col("n")) & (F.abs(F.col("importe") - F.col("i")) < 1e-3) & (F.abs(F.col("costo") - F.col("c")) < 1e-3))
    whole = F.sum(F.col("registros") * F.col("importe")) / F.sum("registros")
    return found.summary.join(anew, U.SEGMENT).agg(
        F.sum("registros").alias("registros"), r(whole, 1).alias("importe"), F.count("*").between(2, 8).alias("hay"), same.alias("iguales"),
        F.lit(found.rows.select("segmento").distinct().count()).cast("long").alias("segmentos"))


@query("mod-17", f"""{W_DEMO}, n AS (SELECT COUNT(*) AS n FROM ventas_demo) SELECT n, CAST(floor((n - 1) * 0.02e0) + 1 AS BIGINT) AS raros, true AS bajo_umbral, true AS en_rango FROM n""")
def mod_17(spark, sf):
    """The share set apart, all of it below the threshold that ranks give, and scores in their range."""
    df = ventas_demo(spark, sf).select("folio", "importe", "costo", "cantidad", "segmento")
    found = U.run_anomalies(df, P.profile(df))
    below = found.scored.agg(F.count("*").alias("n"), F.count_if(F.col("score") < found.threshold).alias("raros"), F.bool_and(F.col("score").between(-1.0, 0.0)).alias("en_rango"))
    return below.select("n", "raros", F.lit(found.rows.where(F.col("score") >= found.threshold).isEmpty()).alias("bajo_umbral"), "en_rango")


@query("mod-18", f"""{W_DEMO}, e AS (SELECT segmento AS serie, min(date_trunc('month', fecha)) AS lo, max(date_trunc('month', fecha)) AS hi FROM ventas_demo GROUP BY 1),
n AS (SELECT serie, hi, CAST(date_diff('month', lo, hi) + 1 AS INTEGER) AS months FROM e), k AS (SELECT *, greatest(3, least(6, months // 4)) AS k FROM n)
SELECT serie, 'prueba' AS tipo, months, CAST(hi - to_months(CAST(k - i AS INTEGER)) AS DATE) AS month FROM k, generate_series(1, 6) g(i) WHERE i <= k AND months >= 12
UNION ALL SELECT serie, 'futuro', months, CAST(hi + to_months(CAST(i AS INTEGER)) AS DATE) FROM k, generate_series(1, 6) g(i) WHERE months >= 12""")
def mod_18(spark, sf):
    return FC.forecast(FC.monthly_series(ventas_demo(spark, sf), "fecha", "importe", ["segmento"])).where("value IS NOT NULL").select("serie", "tipo", "months", "month")


@query("mod-18-naive", f"""{W_DEMO}, b AS (SELECT segmento AS serie, CAST(date_trunc('month', fecha) AS DATE) AS month, sum(importe) AS v FROM ventas_demo GROUP BY ALL), e AS (SELECT serie, min(month) AS lo, max(month) AS hi FROM b GROUP BY 1),
s AS (SELECT serie, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM e), w AS (SELECT s.serie, s.month, COALESCE(v, 0e0) AS v FROM s LEFT JOIN b USING (serie, month)),
o AS (SELECT *, row_number() OVER (PARTITION BY serie ORDER BY month) AS i, COUNT(*) OVER (PARTITION BY serie) AS n FROM w), k AS (SELECT *, greatest(3, least(6, n // 4)) AS k FROM o), l AS (SELECT *, max(CASE WHEN i = n - k THEN v END) OVER (PARTITION BY serie) AS ult FROM k)
SELECT serie, max(n) AS months, {rs('avg(abs((v - ult) / v))', 6)} AS mape_naive FROM l WHERE i > n - k GROUP BY 1""")
def mod_18_naive(spark, sf):
    return rounded(FC.naive_errors(FC.monthly_series(ventas_demo(spark, sf), "fecha", "importe", ["segmento"])), 6)


_SCORED = f"{W_DEMO} SELECT CASE WHEN importe > 100000e0 THEN 'grande' ELSE 'chica' END AS talla, COUNT(*) AS n, true AS valida FROM ventas_demo GROUP BY 1"


@query("dep-02", _SCORED)
def dep_02(spark, sf):
    df, report = _trained(spark, sf, "talla")
    saved = SavedModel(report.model, report.task, report.target, report.features.columns, report.classes, report.metrics, report.baseline, report.beats_baseline, "")
    scored, _ = score(saved, df)
    known = F.col("_prediccion").isin("grande", "chica")
    sure = F.col("_confianza").between(0.5, 1.0) if "_confianza" in scored.columns else F.lit(True)
    return scored.groupBy("talla").agg(F.count("*").alias("n"), F.bool_and(known & sure).alias("valida"))


@query("dep-01", f"{W_DEMO} SELECT 'clasificación' AS tarea, COUNT(*) AS n, true AS iguales FROM ventas_demo")
def dep_01(spark, sf):
    """Saved, loaded and used again, a model predicts what it did before."""
    from tabulario.models.scoring import load_model, save_model
    from tabulario.sources.sinks import scratch
    df, report = _trained(spark, sf, "talla")
    path = scratch(spark)
    save_model(report, path, spark, "ventas")
    saved = load_model(path, spark)
    counted = lambda d: d.groupBy("talla", "_prediccion").agg(F.count("*").alias("n"))
    before, after = counted(report.model.transform(df)), counted(score(saved, df)[0])
    both = before.withColumnRenamed("n", "m").join(after, ["talla", "_prediccion"], "full")
    return both.agg(F.lit(saved.task).alias("tarea"), F.sum("n").alias("n"), F.bool_and(F.col("n").eqNullSafe(F.col("m"))).alias("iguales"))
