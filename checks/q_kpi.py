"""Aggregates, KPIs, period series and windows."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from checks.registry import query, r, rs
from checks.views import SQL_DEMO, SQL_SUCIAS, table, ventas_demo, ventas_sucias
from tabulario.functions import dates, text
from tabulario.operators import groups as G
from tabulario.operators import intake as I
from tabulario.operators import kpi as K
from tabulario.operators import quantiles as Q
from tabulario.operators import series as S

MAPPING = {"fecha": "fecha", "ingreso": "importe", "costo": "costo", "cantidad": "cantidad", "cliente": "cliente",
           "producto": "producto", "transaccion": "folio", "segmento": "segmento", "estatus": "estatus"}
W_DEMO = f"WITH {SQL_DEMO}"


def rounded(df, digits=2, **other):
    """Every double column rounded, for comparison."""
    return df.select(*[r(F.col(c), other.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("agg-01", f"""{W_DEMO} SELECT {rs('sum(importe)')} AS suma, {rs('avg(importe)')} AS promedio, {rs('median(importe)')} AS mediana, min(importe) AS minimo, max(importe) AS maximo,
{rs('stddev_samp(importe)')} AS desviacion, CAST(COUNT(*) AS DOUBLE) AS filas, CAST(COUNT(estado) AS DOUBLE) AS presentes, CAST(COUNT(DISTINCT cliente) AS DOUBLE) AS unicos FROM ventas_demo""")
def agg_01(spark, sf):
    return rounded(K.evaluate(ventas_demo(spark, sf), {
        "suma": K.suma("importe"), "promedio": K.promedio("importe"), "mediana": K.mediana("importe"), "minimo": K.minimo("importe"),
        "maximo": K.maximo("importe"), "desviacion": K.desviacion("importe"), "filas": K.conteo(), "presentes": K.conteo("estado"),
        "unicos": K.unicos("cliente")}))


@query("agg-02", f"SELECT {', '.join(rs(f'quantile_cont(l_extendedprice, {p})') + f' AS p{i}' for i, p in enumerate((0.1, 0.25, 0.5, 0.9, 0.99)))} FROM lineitem")
def agg_02(spark, sf):
    ps = (10, 25, 50, 90, 0.99)
    return rounded(K.evaluate(table(spark, sf, "lineitem"), {f"p{i}": K.percentil("l_extendedprice", p) for i, p in enumerate(ps)}))


@query("agg-03", f"""{W_DEMO} SELECT {rs("sum(importe) FILTER (WHERE lower(estatus) = 'pagado')")} AS pagado, CAST(COUNT(*) FILTER (WHERE lower(estatus) = 'cancelado') AS DOUBLE) AS cancelados FROM ventas_demo""")
def agg_03(spark, sf):
    return rounded(K.evaluate(ventas_demo(spark, sf), {"pagado": K.suma_si("importe", "estatus", "PAGADO"), "cancelados": K.conteo_si("estatus", "Cancelado")}))


query("flt-04", f"WITH {SQL_SUCIAS} SELECT folio, canal FROM ventas_sucias WHERE lower(canal) = lower('Building')")(
    lambda spark, sf: ventas_sucias(spark, sf).where(text.equals_ignoring_case(F.col("canal"), "Building")).select("folio", "canal"))


@query("agg-04", f"""{W_DEMO}, t AS (SELECT estado AS category, sum(importe) AS total, COUNT(importe) AS n, avg(importe) AS mean FROM ventas_demo GROUP BY 1)
SELECT category, {rs('total')} AS total, n, {rs('mean')} AS mean, {rs('total / sum(total) OVER ()', 6)} AS share FROM t""")
def agg_04(spark, sf):
    return rounded(G.ranking(ventas_demo(spark, sf), "estado", "importe"), share=6)


@query("agg-09", f"{W_DEMO}, m AS (SELECT median(importe) AS m FROM ventas_demo) SELECT {rs('median(abs(importe - m))')} AS mad, {rs('any_value(m)')} AS mediana FROM ventas_demo, m")
def agg_09(spark, sf):
    from tabulario.operators.explain import median_deviation
    return rounded(median_deviation(ventas_demo(spark, sf), "importe"))


@query("agg-12", f"""{W_DEMO} SELECT regr_count(importe, costo) AS n, {rs('regr_slope(importe, costo)', 6)} AS slope, {rs('regr_intercept(importe, costo)')} AS intercept, {rs('regr_r2(importe, costo)', 6)} AS r2,
{rs('sqrt((1 - regr_r2(importe, costo)) * regr_syy(importe, costo) / (regr_count(importe, costo) - 2) / regr_sxx(importe, costo))', 6)} AS stderr FROM ventas_demo""")
def agg_12(spark, sf):
    fit = S.linear_fit(ventas_demo(spark, sf), F.col("costo"), F.col("importe"))
    return rounded(fit.drop("t"), 6, intercept=2)


_ANOVA = """g AS (SELECT {dim} AS g, COUNT(*) AS n, avg(importe) AS m, var_samp(importe) AS s2 FROM ventas_demo GROUP BY 1 HAVING COUNT(*) >= 5),
t AS (SELECT sum(n * m) / sum(n) AS gm FROM g)"""


@query("agg-13", f"{W_DEMO}, {_ANOVA.format(dim='segmento')} SELECT COUNT(*) AS groups, CAST(sum(n) AS BIGINT) AS n, {rs('(sum(n * power(m - gm, 2)) / (COUNT(*) - 1)) / (sum((n - 1) * s2) / (sum(n) - COUNT(*)))', 4)} AS f FROM g, t")
def agg_13(spark, sf):
    return rounded(G.anova(G.group_moments(ventas_demo(spark, sf), "segmento", "importe")).select("groups", "n", "f"), 4)


_TOP1 = "k AS (SELECT greatest(1, CAST(floor(COUNT(*) * 0.01e0) AS BIGINT)) AS k, sum(importe) AS total FROM ventas_demo), o AS (SELECT importe, row_number() OVER (ORDER BY importe DESC) AS p FROM ventas_demo)"


@query("agg-14", f"""{W_DEMO}, {_TOP1} SELECT (SELECT COUNT(*) FROM ventas_demo) AS n, (SELECT {rs('stddev_samp(importe) / abs(avg(importe))', 6)} FROM ventas_demo) AS cv,
(SELECT {rs('median(importe)')} FROM ventas_demo) AS p50, (SELECT {rs('quantile_cont(importe, 0.9)')} FROM ventas_demo) AS p90, any_value(k) AS k, {rs('sum(importe) / any_value(total)', 6)} AS share_top FROM o, k WHERE p <= k""")
def agg_14(spark, sf):
    return rounded(G.dispersion(ventas_demo(spark, sf), "importe"), 6, p50=2, p90=2)


_MARGIN = "(sum(importe) - sum(costo)) / sum(importe)"


def margin():
    return (K.suma("importe") - K.suma("costo")) / K.suma("importe")


for _key in ("agg-15", "kpi-15"):
    query(_key, f"{W_DEMO} SELECT estado AS category, {rs(_MARGIN, 6)} AS value FROM ventas_demo GROUP BY 1")(
        lambda spark, sf: rounded(K.by_category(ventas_demo(spark, sf), margin(), "estado"), 6))


_BINS = """b AS (SELECT min(v) AS lo, max(v) AS hi, least(50, greatest(10, CAST(floor(sqrt(COUNT(*))) AS INTEGER))) AS k FROM x),
h AS (SELECT CAST(least(floor((v - lo) / ((hi - lo) / k)), k - 1) AS INTEGER) AS bin, COUNT(*) AS n FROM x, b GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, (FLOOR((lo + i * ((hi - lo) / k))*1e2+0.5e0)/1e2) AS low, COALESCE(n, 0) AS n FROM b, range(50) r(i) LEFT JOIN h ON h.bin = i WHERE i < k"""


@query("agg-16", f"WITH x AS (SELECT o_totalprice AS v FROM orders), {_BINS}")
def agg_16(spark, sf):
    return rounded(G.histogram(table(spark, sf, "orders"), "o_totalprice")).drop("high")


_FOLD = "heads AS (SELECT estado FROM ventas_demo GROUP BY 1 ORDER BY COUNT(*) DESC, estado LIMIT 7), d AS (SELECT *, CASE WHEN estado IN (FROM heads) THEN estado ELSE 'Otros' END AS c FROM ventas_demo)"


@query("agg-17", f"{W_DEMO}, {_FOLD} SELECT c AS category, COUNT(*) AS n, min(importe) AS low, max(importe) AS high, {rs('quantile_cont(importe, 0.25)')} AS q1, {rs('median(importe)')} AS median, {rs('quantile_cont(importe, 0.75)')} AS q3 FROM d GROUP BY 1")
def agg_17(spark, sf):
    return rounded(G.boxes(ventas_demo(spark, sf), "estado", "importe"))


@query("agg-18", f"{W_DEMO}, {_FOLD} SELECT CAST(date_trunc('quarter', fecha) AS DATE) AS period, c AS category, {rs('sum(importe)')} AS value FROM d GROUP BY ALL")
def agg_18(spark, sf):
    return rounded(G.period_breakdown(ventas_demo(spark, sf), dates.period_start(F.col("fecha"), "Q"), "estado", "importe"))


@query("vis-06", f"{W_DEMO}, p AS (SELECT CAST(date_trunc('month', fecha) AS DATE) AS period, estatus, sum(importe) AS v FROM ventas_demo GROUP BY ALL) SELECT period, "
       + ", ".join(f"{rs(f'''COALESCE(sum(v) FILTER (WHERE estatus = '{e}'), 0e0)''')} AS \"{e}\"" for e in ("Cancelado", "Pagado", "Pendiente")) + " FROM p GROUP BY 1")
def vis_06(spark, sf):
    return rounded(G.pivot(G.period_breakdown(ventas_demo(spark, sf), dates.period_start(F.col("fecha"), "M"), "estatus", "importe")))


# --- KPIs --------------------------------------------------------------------------------

_AGG = """a AS (SELECT COUNT(*) AS n, sum(importe) AS ing, COUNT(DISTINCT folio) AS tx, median(importe) AS med, max(importe) AS mx, sum(cantidad) AS cant, sum(costo) AS cost,
 COUNT(DISTINCT cliente) AS cli, COUNT(DISTINCT producto) AS prod, date_diff('day', min(fecha), max(fecha)) AS dias,
 COUNT(*) FILTER (WHERE estatus = 'Cancelado') / COUNT(*) AS canc FROM ventas_demo),
pc AS (SELECT sum(importe) AS v FROM ventas_demo GROUP BY cliente), ok AS (SELECT v, row_number() OVER (ORDER BY v DESC) AS p FROM pc),
top AS (SELECT sum(v) FILTER (WHERE p <= greatest(1, round_even(0.1e0 * (SELECT COUNT(*) FROM pc), 0))) / sum(v) AS s FROM ok)"""
_KPIS = {
    "Registros": "n", "Ingreso total": "ing", "Transacciones": "tx", "Ticket promedio": "ing / tx", "Ticket mediano": "med", "Venta máxima": "mx",
    "Unidades": "cant", "Precio promedio por unidad": "ing / cant", "Costo total": "cost", "Utilidad bruta": "ing - cost", "Margen bruto": "(ing - cost) / ing",
    "Clientes únicos": "cli", "Ingreso por cliente": "ing / cli", "Frecuencia de compra": "tx / cli", "Concentración top 10% clientes": "s",
    "Productos distintos": "prod", "Tasa de Cancelado": "canc", "Cobertura (días)": "dias", "Ingreso promedio diario": "ing / dias",
}


def _kpi_sql(names):
    return f"{W_DEMO}, {_AGG} " + " UNION ALL ".join(f"SELECT '{k}' AS kpi, {rs(f'CAST({_KPIS[k]} AS DOUBLE)', 4)} AS value FROM a, top" for k in names)


def _kpi_query(key, names, **slots):
    mapping = {k: v for k, v in MAPPING.items() if slots.get(k, True)}

    def run(spark, sf):
        return K.catalogue(ventas_demo(spark, sf), mapping, list(names)).select("kpi", r("value", 4).alias("value"))

    query(key, _kpi_sql(names))(run)


_NAMES = list(_KPIS)
_kpi_query("kpi-01", _NAMES[:6])
_kpi_query("kpi-02", _NAMES[6:8])
_kpi_query("kpi-03", _NAMES[8:11])
_kpi_query("kpi-04", _NAMES[11:14])
_kpi_query("kpi-05", _NAMES[14:15])
_kpi_query("kpi-06", _NAMES[15:16])
_kpi_query("kpi-07", _NAMES[16:17])
_kpi_query("kpi-08", _NAMES[17:19])
_kpi_query("kpi-09", _NAMES)


@query("top-07", f"{W_DEMO}, o AS (SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, '{k}')" for i, k in enumerate(
    ["Ingreso total", "Utilidad bruta", "Margen bruto", "Transacciones", "Ticket promedio", "Clientes únicos"])) + ") v(position, kpi)) SELECT CAST(position AS INTEGER) AS position, kpi FROM o WHERE (SELECT COUNT(importe) FROM ventas_demo) > 0")
def top_07(spark, sf):
    first = K.by_priority(K.catalogue(ventas_demo(spark, sf), MAPPING)).collect()
    return I.rows(spark, [(i + 1, x["kpi"]) for i, x in enumerate(first)], "position int, kpi string")


def monthly(unit="month", value="sum(importe)", source="ventas_demo"):
    """SQL of a gap-free series whose open last period is dropped."""
    step = {"week": "INTERVAL 7 DAY", "quarter": "INTERVAL 3 MONTH"}.get(unit, f"INTERVAL 1 {unit}")
    return f"""b AS (SELECT CAST(date_trunc('{unit}', fecha) AS DATE) AS period, {value} AS v, COUNT(*) AS c FROM {source} GROUP BY 1),
e AS (SELECT min(period) AS lo, max(period) AS hi, (SELECT max(fecha) FROM {source}) AS last FROM b),
spine AS (SELECT CAST(unnest(generate_series(lo, hi, {step})) AS DATE) AS period, hi, last FROM e),
serie AS (SELECT s.period, COALESCE(v, 0e0) AS value, COALESCE(c, 0) AS n FROM spine s LEFT JOIN b ON b.period = s.period
 WHERE NOT (s.period = hi AND CAST(s.period + {step} - INTERVAL 1 DAY AS TIMESTAMP) > last))"""


@query("win-01", f"{W_DEMO}, {monthly()} SELECT period, {rs('value')} AS value, {rs('previous')} AS previous, {rs('(value - previous) / abs(previous)', 6)} AS delta_value, {rs('(n - pn) / pn', 6)} AS delta_n FROM (SELECT *, lag(value) OVER (ORDER BY period) AS previous, lag(n) OVER (ORDER BY period) AS pn FROM serie) ORDER BY period DESC LIMIT 1")
def win_01(spark, sf):
    return rounded(S.last_change(S.period_series(ventas_demo(spark, sf), "fecha", "importe", "M", robust=False, trim=False)), delta_value=6, delta_n=6)


_UNITS = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}


def _last_deltas(code: str, unit: str) -> str:
    return f"""SELECT '{code}' AS unidad, k AS kpi, CASE k WHEN 'Registros' THEN {rs('(n - pn) / pn', 6)} ELSE {rs('(value - p) / abs(p)', 6)} END AS delta
 FROM (WITH {monthly(unit)} SELECT value, lag(value) OVER (ORDER BY period) AS p, n, lag(n) OVER (ORDER BY period) AS pn, period FROM serie ORDER BY period DESC LIMIT 1), (VALUES ('Registros'), ('Ingreso total')) v(k)"""


@query("kpi-10", f"{W_DEMO} " + " UNION ALL ".join(_last_deltas(code, unit) for code, unit in _UNITS.items()))
def kpi_10(spark, sf):
    df = ventas_demo(spark, sf)
    found = K.catalogue(df, MAPPING, ["Registros", "Ingreso total"])
    daily = K.totals_by_day(df, MAPPING)
    per = [K.with_deltas(found, df, MAPPING, unit, daily).select(F.lit(unit).alias("unidad"), "kpi", r("delta", 6).alias("delta")) for unit in _UNITS]
    return reduce(lambda a, b: a.unionByName(b), per)


CUSTOM = [
    K.Kpi("Margen", margin(), K.PERCENT, 0.5, "line"), K.Kpi("Ticket", K.suma("importe") / K.unicos("folio"), K.MONEY, 200000.0),
    K.Kpi("P90", K.percentil("importe", 90)), K.Kpi("Roto", K.suma("no_existe")), K.Kpi("Entre cero", K.suma("importe") / (K.conteo() - K.conteo())),
]


@query("kpi-11", f"{W_DEMO} SELECT 'Margen' AS kpi, {rs(_MARGIN, 4)} AS value, 'ok' AS resultado FROM ventas_demo UNION ALL SELECT 'Ticket', {rs('sum(importe) / COUNT(DISTINCT folio)', 4)}, 'ok' FROM ventas_demo UNION ALL SELECT 'P90', {rs('quantile_cont(importe, 0.9)', 4)}, 'ok' FROM ventas_demo UNION ALL SELECT k, NULL, 'error' FROM (VALUES ('Roto'), ('Entre cero')) v(k)")
def kpi_11(spark, sf):
    good, bad = K.compute_custom(ventas_demo(spark, sf), CUSTOM)
    return good.select("kpi", r("value", 4).alias("value"), F.lit("ok").alias("resultado")).unionByName(
        bad.select("kpi", F.lit(None).cast("double").alias("value"), F.lit("error").alias("resultado")))


_MENU = {
    "sumar": ("sum(importe) FILTER (WHERE lower(estatus) = 'pagado')", ("importe", None, "estatus", "Pagado")), "promedio": ("avg(importe)", ("importe",)),
    "mediana": ("median(importe)", ("importe",)), "maximo": ("max(importe)", ("importe",)), "minimo": ("min(importe)", ("importe",)),
    "contar": ("CAST(COUNT(*) FILTER (WHERE estatus = 'Pagado') AS DOUBLE)", (None, None, "estatus", "Pagado")), "distintos": ("CAST(COUNT(DISTINCT cliente) AS DOUBLE)", ("cliente",)),
    "dividir": ("sum(importe) / sum(cantidad)", ("importe", "cantidad")), "restar": ("sum(importe) - sum(costo)", ("importe", "costo")),
    "margen": (_MARGIN, ("importe", "costo")), "promedio_por": ("sum(importe) / COUNT(DISTINCT cliente)", ("importe", "cliente")),
    "porcentaje": ("COUNT(*) FILTER (WHERE estatus = 'Pagado') / COUNT(*)", (None, None, "estatus", "Pagado")),
}


@query("kpi-12", f"{W_DEMO} SELECT " + ", ".join(f"{rs(sql, 4)} AS {k}" for k, (sql, _) in _MENU.items()) + " FROM ventas_demo")
def kpi_12(spark, sf):
    return rounded(K.evaluate(ventas_demo(spark, sf), {k: K.choose(k, *a).measure for k, (_, a) in _MENU.items()}), 4)


@query("kpi-13", f"{W_DEMO}, v AS (SELECT 'Margen' AS kpi, {_MARGIN} AS value, 0.5e0 AS target FROM ventas_demo UNION ALL SELECT 'Ticket', sum(importe) / COUNT(DISTINCT folio), 200000e0 FROM ventas_demo UNION ALL SELECT 'P90', quantile_cont(importe, 0.9), NULL FROM ventas_demo) SELECT kpi, CASE WHEN value / target >= 1 THEN 'ok' WHEN value / target >= 0.9 THEN 'cerca' WHEN target IS NOT NULL THEN 'bajo' END AS status FROM v")
def kpi_13(spark, sf):
    return K.with_status(K.compute_custom(ventas_demo(spark, sf), CUSTOM[:3])[0]).select("kpi", "status")


@query("kpi-14", f"{W_DEMO}, s AS (SELECT CAST(date_trunc('month', fecha) AS DATE) AS period, {_MARGIN} AS value FROM ventas_demo GROUP BY 1) SELECT period, {rs('value', 6)} AS value FROM s WHERE period < (SELECT max(period) FROM s)")
def kpi_14(spark, sf):
    return rounded(S.measure_series(ventas_demo(spark, sf), margin(), "fecha", "M"), 6)


# --- series ------------------------------------------------------------------------------

_Q = monthly("quarter")


@query("ins-01", f"""{W_DEMO}, s AS (SELECT fecha FROM ventas_demo), t AS (SELECT greatest(CAST(floor((quantile_cont(epoch(fecha), 0.99) - quantile_cont(epoch(fecha), 0.01)) / 86400) AS INTEGER), 1) AS dias FROM s)
SELECT dias, CASE WHEN dias <= 45 THEN 'D' WHEN dias <= 200 THEN 'W' WHEN dias <= 1200 THEN 'M' ELSE 'Q' END AS unidad FROM t""")
def ins_01(spark, sf):
    days = S.Scope(ventas_demo(spark, sf), "fecha").span
    return I.rows(spark, [(days, S.choose_unit(days))], "dias int, unidad string")


query("ins-02", f"{W_DEMO}, {_Q} SELECT period, {rs('value')} AS value, n FROM serie")(
    lambda spark, sf: rounded(S.period_series(ventas_demo(spark, sf), "fecha", "importe", "Q")))
_WEEK = monthly("week", "CAST(COUNT(*) AS DOUBLE)", "v")


@query("vis-01", f"WITH v AS (SELECT ts AS fecha FROM events), d AS (SELECT CAST(fecha AS DATE) AS period, CAST(COUNT(*) AS DOUBLE) AS value, COUNT(*) AS n FROM v GROUP BY 1), {_WEEK} SELECT 'D' AS unidad, period, value, n FROM d UNION ALL SELECT 'W', CAST(period + INTERVAL 6 DAY AS DATE), value, n FROM serie")
def vis_01(spark, sf):
    df = table(spark, sf, "events")
    unit = S.choose_unit(S.Scope(df, "ts").full_days, board=True)
    daily = S.period_series(df, "ts", None, unit, trim=False).select(F.lit(unit).alias("unidad"), "period", "value", "n")
    weekly = S.period_series(df, "ts", None, "W", trim=False)
    return daily.unionByName(weekly.select(F.lit("W").alias("unidad"), S.label_date(F.col("period"), "W").alias("period"), "value", "n"))


@query("vis-08", f"{W_DEMO} SELECT min(fecha) AS desde, max(fecha) AS hasta FROM ventas_demo")
def vis_08(spark, sf):
    return S.covered(ventas_demo(spark, sf), "fecha")


_FDATE = "try_strptime(fecha, '%d/%m/%Y')"
_BOUNDS = f"f AS (SELECT folio, {_FDATE} AS f FROM ventas_sucias), b AS (SELECT quantile_cont(epoch(f), 0.25) AS q1, quantile_cont(epoch(f), 0.75) AS q3 FROM f)"


@query("flt-03", f"WITH {SQL_SUCIAS}, {_BOUNDS} SELECT folio FROM f, b WHERE epoch(f) BETWEEN q1 - 5 * (q3 - q1) AND q3 + 5 * (q3 - q1)")
def flt_03(spark, sf):
    return S.within_dates(ventas_sucias(spark, sf), "fecha").select("folio")


@query("ins-03", f"WITH {SQL_SUCIAS}, {_BOUNDS} SELECT COUNT(f) AS fechas, COUNT(*) FILTER (WHERE epoch(f) BETWEEN q1 - 5 * (q3 - q1) AND q3 + 5 * (q3 - q1)) AS creibles, COUNT(f) - COUNT(*) FILTER (WHERE epoch(f) BETWEEN q1 - 5 * (q3 - q1) AND q3 + 5 * (q3 - q1)) AS descartadas FROM f, b")
def ins_03(spark, sf):
    return S.set_aside(ventas_sucias(spark, sf), "fecha")


@query("win-08", f"{W_DEMO}, {_Q}, o AS (SELECT value, row_number() OVER (ORDER BY period) AS i, COUNT(*) OVER () AS n FROM serie), t AS (SELECT avg(value) FILTER (WHERE i <= greatest(1, n // 3)) AS a, avg(value) FILTER (WHERE i > n - greatest(1, n // 3)) AS z FROM o) SELECT {rs('a')} AS first_third, {rs('z')} AS last_third, {rs('(z - a) / abs(a)', 6)} AS change FROM t")
def win_08(spark, sf):
    return rounded(S.thirds(S.period_series(ventas_demo(spark, sf), "fecha", "importe", "Q")), change=6)


_HIST = f"{_Q}, u AS (SELECT *, row_number() OVER (ORDER BY period DESC) AS i, lag(value) OVER (ORDER BY period) AS previous FROM serie), t AS (SELECT any_value(value) FILTER (WHERE i = 1) AS value, any_value(previous) FILTER (WHERE i = 1) AS previous, avg(value) FILTER (WHERE i > 1) AS mean, stddev_samp(value) FILTER (WHERE i > 1) AS sd FROM u)"


@query("win-09", f"{W_DEMO}, {_HIST} SELECT {rs('value')} AS value, {rs('mean')} AS mean, {rs('sd')} AS sd, {rs('(value - mean) / sd', 6)} AS z FROM t")
def win_09(spark, sf):
    return rounded(S.last_against_history(S.period_series(ventas_demo(spark, sf), "fecha", "importe", "Q")).select("value", "mean", "sd", "z"), z=6)


@query("ins-06", f"{W_DEMO}, {_HIST} SELECT {rs('(value - mean) / sd', 6)} AS z, {rs('(value - previous) / abs(previous)', 6)} AS change, abs((value - mean) / sd) >= 2 AS inusual FROM t")
def ins_06(spark, sf):
    end = S.last_against_history(S.period_series(ventas_demo(spark, sf), "fecha", "importe", "Q"))
    return end.select(r("z", 6).alias("z"), r("change", 6).alias("change"), (F.abs("z") >= 2).alias("inusual"))


@query("ins-05", f"{W_DEMO}, {_Q}, o AS (SELECT value, CAST(row_number() OVER (ORDER BY period) - 1 AS DOUBLE) AS i, period FROM serie) SELECT regr_count(value, i) AS n, {rs('regr_slope(value, i)')} AS slope, {rs('regr_r2(value, i)', 6)} AS r2, {rs('regr_slope(value, i) / abs(avg(value))', 6)} AS change, {rs('arg_max(value, period) + regr_slope(value, i)')} AS proyeccion FROM o")
def ins_05(spark, sf):
    t = S.trend(S.period_series(ventas_demo(spark, sf), "fecha", "importe", "Q"))
    return t.select("n", r("slope").alias("slope"), r("r2", 6).alias("r2"), r("change", 6).alias("change"), r(F.col("last") + F.col("slope")).alias("proyeccion"))


# --- joins, sets, ranking ----------------------------------------------------------------


@query("joi-01", f"{W_DEMO}, m AS (SELECT median(epoch(fecha)) AS m FROM ventas_demo), a AS (SELECT segmento AS c, sum(importe) AS v FROM ventas_demo, m WHERE epoch(fecha) <= m GROUP BY 1), b AS (SELECT segmento AS c, sum(importe) AS v FROM ventas_demo, m WHERE epoch(fecha) > m GROUP BY 1) SELECT COALESCE(a.c, b.c) AS category, {rs('COALESCE(a.v, 0e0)')} AS before, {rs('COALESCE(b.v, 0e0)')} AS after FROM a FULL OUTER JOIN b ON a.c = b.c")
def joi_01(spark, sf):
    return rounded(G.halves(ventas_demo(spark, sf), "fecha", "segmento", "importe").select("category", "before", "after"))


query("set-01", f"{W_DEMO} SELECT folio, importe FROM ventas_demo UNION ALL SELECT folio, importe FROM ventas_demo WHERE importe > 1e6")(
    lambda spark, sf: (lambda d: d.select("folio", "importe").unionByName(d.where("importe > 1e6").select("folio", "importe")))(ventas_demo(spark, sf)))


@query("flt-05", f"{W_DEMO}, raras AS (SELECT estado FROM ventas_demo GROUP BY 1 HAVING COUNT(*) < (SELECT COUNT(*) / 25 FROM ventas_demo)) SELECT folio, estado FROM ventas_demo WHERE estado NOT IN (FROM raras)")
def flt_05(spark, sf):
    df = ventas_demo(spark, sf)
    rare = df.groupBy("estado").count().where(F.col("count") < df.agg(F.count("*") / 25).scalar())
    return G.by_membership(df, "estado", rare.select("estado"), inside=False).select("folio", "estado")


@query("flt-06", f"{W_DEMO}, q AS (SELECT quantile_cont(importe, 0.01) AS lo, quantile_cont(importe, 0.99) AS hi FROM ventas_demo) SELECT folio, importe FROM ventas_demo, q WHERE importe BETWEEN lo AND hi")
def flt_06(spark, sf):
    return G.central_values(ventas_demo(spark, sf).select("folio", "importe"), "importe")


@query("top-01", f"{W_DEMO}, t AS (SELECT estado, sum(importe) AS v FROM ventas_demo GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY v DESC, estado) AS p FROM t) SELECT CAST(p AS INTEGER) AS position, estado AS label, {rs('v')} AS value FROM o WHERE p < 8 UNION ALL SELECT CAST(8 AS INTEGER), concat('Otros (', COUNT(*), ')'), {rs('sum(v)')} FROM o WHERE p >= 8")
def top_01(spark, sf):
    return rounded(G.top_with_others(K.per_value(ventas_demo(spark, sf), "estado", "importe")))


@query("vis-07", f"{W_DEMO}, t AS (SELECT segmento, greatest(sum(importe) - 1e7, 0e0) AS v FROM ventas_demo GROUP BY 1) SELECT segmento AS label, {rs('v')} AS value, {rs('v / sum(v) OVER ()', 6)} AS share FROM t")
def vis_07(spark, sf):
    totals = K.per_value(ventas_demo(spark, sf), "segmento", "importe").withColumn("v", F.col("v") - F.lit(1e7))
    return rounded(G.pie(totals), share=6).drop("position")


@query("win-04", f"{W_DEMO}, t AS (SELECT sum(importe) AS v FROM ventas_demo GROUP BY cliente), c AS (SELECT sum(v) OVER (ORDER BY v DESC ROWS UNBOUNDED PRECEDING) / sum(v) OVER () AS s FROM t) SELECT COUNT(*) AS n_total, COUNT(*) FILTER (WHERE s > 0.95) AS n_tail FROM c")
def win_04(spark, sf):
    return G.long_tail(K.per_value(ventas_demo(spark, sf), "cliente", "importe"))
