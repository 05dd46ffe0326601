"""Insights, explanations, views and geography."""
from __future__ import annotations


from pyspark.sql import functions as F

from checks.q_kpi import _ANOVA, _FOLD, _TOP1, CUSTOM, MAPPING, W_DEMO, monthly, rounded
from checks.q_quality import _EVERY, AS_OF, WITH
from checks.registry import query, r, rs
from checks.views import SQL_DEMO, SQL_ESTADOS, estados, table, ventas_demo, ventas_sucias
from tabulario.operators import explain as E
from tabulario.operators import geo
from tabulario.operators import groups as G
from tabulario.operators import insight as X
from tabulario.operators import kpi as K
from tabulario.operators import profile as P
from tabulario.operators import quality as QL
from tabulario.operators import series as S
from tabulario.operators import views as V
from tabulario.operators.intake import rows
from tabulario.session import held


def evidence(insights, code, *names, digits=6):
    """kind, code, subject, impact and the named figures of one kind of insight, rounded."""
    return insights.where(F.col("code") == code).select(
        "kind", "code", "subject", r("impact", 4).alias("impact"), *[r(F.col("evidence")[n], digits).alias(n) for n in names])


def _rule(key, rule, code, sql, *names, df=None, digits=6):
    def run(spark, sf):
        with held((df or ventas_demo)(spark, sf)) as frame:
            profiles = P.profile(frame, stats=False)
            return evidence(X.frame(frame, rule(X.Context(frame, MAPPING, profiles, AS_OF))), code, *names, digits=digits)

    query(key, sql)(run)


_rule("ins-04", X.temporal, "datos_viejos", f"{W_DEMO} SELECT 'riesgo' AS kind, 'datos_viejos' AS code, 'fecha' AS subject, 0.6e0 AS impact, CAST(date_diff('day', max(fecha), TIMESTAMP '2026-01-01') AS DOUBLE) AS dias_sin_datos FROM ventas_demo", "dias_sin_datos")

_DAYS = "['lunes','martes','miércoles','jueves','viernes','sábado','domingo']"
_MONTHS = "['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre']"


@query("ins-07", f"WITH p AS (SELECT CAST(isodow(ts) AS INTEGER) AS position, CAST(COUNT(*) AS DOUBLE) AS value FROM events GROUP BY 1) SELECT position, {_DAYS}[position] AS name, value, {rs('value / sum(value) OVER ()', 6)} AS share FROM p")
def ins_07(spark, sf):
    return rounded(X.calendar_shares(S.daily_totals(table(spark, sf, "events"), "ts", None), "weekday"), share=6)


_rule("ins-08", X.seasonality, "estacionalidad", f"""{W_DEMO}, p AS (SELECT CAST(month(fecha) AS INTEGER) AS m, sum(importe) AS v FROM ventas_demo GROUP BY 1), s AS (SELECT m, v / sum(v) OVER () AS s FROM p)
SELECT 'hallazgo' AS kind, 'estacionalidad' AS code, {_MONTHS}[arg_max(m, s)] AS subject, 0.65e0 AS impact, CAST(arg_max(m, s) AS DOUBLE) AS mejor, {rs('max(s)', 6)} AS cuota_mejor, CAST(arg_min(m, s) AS DOUBLE) AS peor, {rs('min(s)', 6)} AS cuota_peor FROM s HAVING max(s) > 1.5e0 / 12""",
      "mejor", "cuota_mejor", "peor", "cuota_peor")

_CONC = """pc AS (SELECT cliente, sum(importe) AS v FROM ventas_demo GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY v DESC) AS p, COUNT(*) OVER () AS n, sum(v) OVER () AS total FROM pc WHERE v > 0),
c AS (SELECT any_value(n) AS n, greatest(1, round_even(0.2e0 * any_value(n), 0)) AS k FROM o),
s AS (SELECT sum(v) FILTER (WHERE p <= k) / any_value(total) AS top, max(v) / any_value(total) AS uno, any_value(c.k) AS k, any_value(c.n) AS n FROM o, c)"""
_rule("ins-09", X.concentrated, "concentracion", f"{W_DEMO}, {_CONC} SELECT CASE WHEN uno > 0.3e0 THEN 'riesgo' ELSE 'hallazgo' END AS kind, 'concentracion' AS code, 'cliente' AS subject, {rs('least(0.9e0, 0.5e0 + top * 0.4e0 + uno)', 4)} AS impact, {rs('top', 6)} AS share_top20, {rs('uno', 6)} AS share_top1, CAST(k AS DOUBLE) AS k, CAST(n AS DOUBLE) AS n FROM s WHERE top >= 0.7e0",
      "share_top20", "share_top1", "k", "n")


_rule("ins-10", X.concentrated, "cola_larga", f"{W_DEMO}, t AS (SELECT sum(importe) AS v FROM ventas_demo GROUP BY cliente), c AS (SELECT sum(v) OVER (ORDER BY v DESC ROWS UNBOUNDED PRECEDING) / sum(v) OVER () AS s FROM t), z AS (SELECT COUNT(*) AS n_total, COUNT(*) FILTER (WHERE s > 0.95) AS n_cola FROM c) SELECT 'oportunidad' AS kind, 'cola_larga' AS code, 'cliente' AS subject, 0.55e0 AS impact, CAST(n_cola AS DOUBLE) AS n_cola, CAST(n_total AS DOUBLE) AS n_total FROM z WHERE n_cola >= greatest(5, n_total * 0.3e0)",
      "n_cola", "n_total")


_F = "(sum(n * power(m - gm, 2)) / (COUNT(*) - 1)) / (sum((n - 1) * s2) / (sum(n) - COUNT(*)))"
_rule("ins-11", X.segments, "segmento_discrimina", f"{W_DEMO}, {_ANOVA.format(dim='segmento')}, f AS (SELECT {_F} AS f FROM g, t), a AS (SELECT avg(importe) AS a FROM ventas_demo), l AS (SELECT (max(m) - any_value(a)) / abs(any_value(a)) AS lift, (min(m) - any_value(a)) / abs(any_value(a)) AS caida FROM g, a) SELECT 'oportunidad' AS kind, 'segmento_discrimina' AS code, 'segmento' AS subject, {rs('least(0.9e0, 0.6e0 + abs(lift) * 0.3e0)', 4)} AS impact, {rs('f', 4)} AS f, {rs('lift', 4)} AS lift, {rs('caida', 4)} AS \"drop\" FROM f, l",
      "f", "lift", "drop", digits=4)

_HALVES = "m AS (SELECT median(epoch(fecha)) AS m FROM ventas_demo), c AS (SELECT segmento AS s, sum(importe) FILTER (WHERE epoch(fecha) <= m) AS a, sum(importe) FILTER (WHERE epoch(fecha) > m) AS b FROM ventas_demo, m GROUP BY 1), h AS (SELECT s, a, b, (b - a) / a AS ch, a / sum(a) OVER () AS w FROM c WHERE a > 0)"


@query("ins-12", f"{W_DEMO}, {_HALVES} SELECT s AS category, {rs('a')} AS before, {rs('b')} AS after, {rs('ch', 6)} AS change, {rs('w', 6)} AS weight, CASE WHEN w >= 0.05 AND ch < -0.15 THEN 'riesgo' WHEN w >= 0.05 AND ch > 0.15 THEN 'oportunidad' END AS kind FROM h")
def ins_12(spark, sf):
    h = G.halves(ventas_demo(spark, sf), "fecha", "segmento", "importe").where("before > 0")
    kind = F.when((F.col("weight") >= 0.05) & (F.col("change") < -0.15), "riesgo").when((F.col("weight") >= 0.05) & (F.col("change") > 0.15), "oportunidad")
    return rounded(h.withColumn("kind", kind), change=6, weight=6)


_rule("ins-13", X.dispersed, "dispersion", f"{W_DEMO} SELECT 'hallazgo' AS kind, 'dispersion' AS code, 'importe' AS subject, 0.55e0 AS impact, {rs('stddev_samp(importe) / abs(avg(importe))', 4)} AS cv, {rs('median(importe)', 4)} AS p50, {rs('quantile_cont(importe, 0.9)', 4)} AS p90 FROM ventas_demo HAVING stddev_samp(importe) / abs(avg(importe)) > 1.2", "cv", "p50", "p90", digits=4)
_rule("ins-14", X.dispersed, "pocos_registros_dominan", f"{W_DEMO}, {_TOP1}, s AS (SELECT sum(importe) / any_value(total) AS s FROM o, k WHERE p <= k) SELECT 'riesgo' AS kind, 'pocos_registros_dominan' AS code, 'importe' AS subject, 0.6e0 AS impact, {rs('s', 6)} AS share_top1pct FROM s WHERE s > 0.2e0", "share_top1pct")

_PAIR = "SELECT l_extendedprice AS importe, l_extendedprice * (0.5e0 + l_discount * 5e0) AS pagado, l_quantity AS cantidad, l_tax AS impuesto FROM lineitem"
_COLS = ["importe", "pagado", "cantidad", "impuesto"]
_PCORR = " UNION ALL ".join(f"SELECT '{a} / {b}' AS subject, corr({a}, {b}) AS c FROM v" for i, a in enumerate(_COLS) for b in _COLS[i + 1:])


@query("ins-15", f"WITH v AS ({_PAIR}), c AS ({_PCORR}) SELECT 'hallazgo' AS kind, 'correlacion' AS code, subject, {rs('0.4e0 + abs(c) * 0.2e0', 4)} AS impact, {rs('c', 4)} AS r FROM c WHERE abs(c) >= 0.5 AND abs(c) < 0.98 ORDER BY abs(c) DESC LIMIT 3")
def ins_15(spark, sf):
    df = spark.sql(_PAIR.replace(" lineitem", " {t}"), t=table(spark, sf, "lineitem"))
    return evidence(X.frame(df, X.moving_together(X.Context(df, {}, P.profile(df, stats=False), AS_OF))), "correlacion", "r", digits=4)


_RARE = "SELECT folio, CASE WHEN folio % 20 = 3 THEN 'devuelto' ELSE 'normal' END AS tipo, segmento FROM ventas_demo"


@query("ins-16", f"{W_DEMO}, v AS ({_RARE}), t AS (SELECT tipo, COUNT(*) / (SELECT COUNT(*) FROM v) AS s FROM v GROUP BY 1) SELECT 'contexto' AS kind, 'desbalance' AS code, 'tipo' AS subject, 0.3e0 AS impact, {rs('max(s)', 6)} AS cuota FROM t HAVING max(s) > 0.9")
def ins_16(spark, sf):
    df = spark.sql(_RARE.replace("ventas_demo", "{t}"), t=ventas_demo(spark, sf))
    return evidence(X.frame(df, X.unbalanced(X.Context(df, {}, P.profile(df, stats=False), AS_OF))), "desbalance", "cuota")


@query("ins-17", f"{WITH}, todo AS ({_EVERY}) SELECT 'riesgo' AS kind, 'calidad' AS code, CAST(NULL AS VARCHAR) AS subject, 0.98e0 AS impact, CAST(COUNT(*) AS DOUBLE) AS n_criticos FROM todo WHERE severity = 'crítico'")
def ins_17(spark, sf):
    df = ventas_sucias(spark, sf)
    return evidence(X.frame(df, X.pending_quality(QL.detect_issues(df, as_of=AS_OF))), "calidad", "n_criticos")


def _insights(spark, sf):
    with held(ventas_demo(spark, sf)) as df:
        return X.generate(df, P.profile(df), MAPPING, as_of=AS_OF)




@query("ins-18")
def ins_18(spark, sf):
    return _insights(spark, sf).select("kind", "code", "subject", "title", r("impact", 4).alias("impact"))


@query("top-05")
def top_05(spark, sf):
    df = ventas_demo(spark, sf)
    return X.generate(df, P.profile(df), MAPPING, as_of=AS_OF, limit=5).select("kind", "code", "subject", r("impact", 4).alias("impact"))


@query("ins-19")
def ins_19(spark, sf):
    with held(ventas_demo(spark, sf)) as df:
        profiles = P.profile(df)
        score = QL.quality_score(QL.detect_issues(df, profiles, as_of=AS_OF))
        return X.executive_summary(X.generate(df, profiles, MAPPING, as_of=AS_OF), P.overview(df, profiles), score).select(
            "filas", "columnas", "score", "n_riesgos", "n_oportunidades", "texto")


# --- explanations ------------------------------------------------------------------------

_M = monthly()
_THIRDS = "o AS (SELECT value, period, row_number() OVER (ORDER BY period) AS i, COUNT(*) OVER () AS n FROM serie), t AS (SELECT avg(value) FILTER (WHERE i <= greatest(1, n // 3)) AS a, avg(value) FILTER (WHERE i > n - greatest(1, n // 3)) AS z FROM o)"


@query("exp-01", f"{W_DEMO}, {_M}, {_THIRDS} SELECT arg_max(period, value) AS best, {rs('max(value)')} AS best_value, arg_min(period, value) AS worst, {rs('min(value)')} AS worst_value, {rs('avg(value)')} AS mean, COUNT(*) AS periods, CASE WHEN abs(any_value((z - a) / abs(a))) < 0.08 THEN 'estable' WHEN any_value(z) > any_value(a) THEN 'sube' ELSE 'baja' END AS course, concat({_MONTHS}[month(arg_max(period, value))], ' de ', year(arg_max(period, value))) AS best_label FROM serie, t")
def exp_01(spark, sf):
    s = S.period_series(ventas_demo(spark, sf), "fecha", "importe", "M", trim=False)
    return rounded(E.read_series(s, "M").select("best", "best_value", "worst", "worst_value", "mean", "periods", "course", "best_label"))


_MAD = "s0 AS (SELECT median(value) AS m FROM serie), s1 AS (SELECT period, value, m, abs(value - m) AS d FROM serie, s0), s2 AS (SELECT *, 0.6745e0 * d / (SELECT median(d) FROM s1) AS score FROM s1)"


@query("exp-02", f"{W_DEMO}, {_M}, {_MAD}, o AS (SELECT *, row_number() OVER (ORDER BY score DESC, period) AS p FROM s2 WHERE score >= 3.5) SELECT CAST(p AS INTEGER) AS position, period, {rs('value')} AS value, {rs('m')} AS median, {rs('score', 4)} AS score FROM o WHERE p <= 3")
def exp_02(spark, sf):
    return rounded(E.unusual_periods(S.period_series(ventas_demo(spark, sf), "fecha", "importe", "M", trim=False)), score=4)


@query("exp-09", f"{W_DEMO}, {_M}, {_MAD}, o AS (SELECT *, row_number() OVER (ORDER BY value DESC, period) AS p FROM s2 WHERE score > 3.5) SELECT CAST(p AS INTEGER) AS position, period, {rs('value')} AS value, {rs('m')} AS median, {rs('score', 4)} AS score FROM o WHERE p <= 3")
def exp_09(spark, sf):
    return rounded(V.kpi_outliers(S.period_series(ventas_demo(spark, sf), "fecha", "importe", "M", trim=False)), score=4)


def _base(spark, sf, unit="M"):
    return E.dated(ventas_demo(spark, sf), "fecha", unit, "importe")


@query("exp-03", f"{W_DEMO}, p AS (SELECT CAST(date_trunc('month', fecha) AS DATE) AS period, COUNT(*) AS n, avg(importe) AS mean FROM ventas_demo GROUP BY 1), u AS (SELECT median(n) AS usual FROM p) SELECT period, n, {rs('mean')} AS mean, usual, {rs('n / usual', 6)} AS ratio, CASE WHEN n / usual >= 1.4 THEN 'volumen' WHEN n / usual <= 0.7 THEN 'tamano' END AS clue FROM p, u")
def exp_03(spark, sf):
    return rounded(E.volume_clue(_base(spark, sf)), ratio=6)


@query("exp-04", f"{W_DEMO}, p AS (SELECT CAST(date_trunc('month', fecha) AS DATE) AS period, * FROM ventas_demo), o AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY importe DESC, cliente DESC, producto DESC) AS i, sum(importe) OVER (PARTITION BY period) AS t FROM p) SELECT period, cliente, producto, importe AS largest, {rs('importe / t', 6)} AS share FROM o WHERE i = 1")
def exp_04(spark, sf):
    return rounded(E.single_clue(_base(spark, sf), ["cliente", "producto"]), share=6)


@query("exp-05", f"{W_DEMO}, m AS (SELECT month(fecha) AS m, sum(importe) AS v FROM ventas_demo GROUP BY 1), b AS (SELECT arg_max(m, v) AS m, max(v) / sum(v) AS s FROM m) SELECT DISTINCT CAST(date_trunc('month', fecha) AS DATE) AS period, {rs('s', 6)} AS share FROM ventas_demo, b WHERE month(fecha) = m AND s > 1.4e0 / 12")
def exp_05(spark, sf):
    return rounded(E.season_clue(_base(spark, sf), "M"), 6)


_CAT = "p AS (SELECT CAST(date_trunc('month', fecha) AS DATE) AS period, segmento AS category, sum(importe) AS v FROM ventas_demo GROUP BY ALL), g AS (SELECT category, sum(v) / (SELECT sum(v) FROM p) AS usual FROM p GROUP BY 1), o AS (SELECT period, category, v / sum(v) OVER (PARTITION BY period) AS share, row_number() OVER (PARTITION BY period ORDER BY v DESC, category DESC) AS i FROM p)"


@query("exp-06", f"{W_DEMO}, {_CAT} SELECT period, category, {rs('share', 6)} AS share, {rs('usual', 6)} AS usual FROM o JOIN g USING (category) WHERE i = 1 AND share >= 0.4 AND share >= usual * 1.5")
def exp_06(spark, sf):
    return rounded(E.category_clue(_base(spark, sf), "segmento"), 6)


_PS = "p AS (SELECT CAST(date_trunc('month', fecha) AS DATE) AS period, estado, sum(importe) AS v FROM ventas_demo GROUP BY ALL), g AS (SELECT estado, sum(v) / (SELECT sum(v) FROM p) AS usual FROM p GROUP BY 1), o AS (SELECT period, estado, v / sum(v) OVER (PARTITION BY period) AS share, row_number() OVER (PARTITION BY period ORDER BY v DESC, estado DESC) AS i FROM p)"


@query("joi-04", f"{W_DEMO}, {_PS} SELECT period, estado AS category, {rs('share', 6)} AS share, {rs('usual', 6)} AS usual FROM o JOIN g USING (estado) WHERE i = 1 AND share >= 0.4 AND share >= usual * 1.5")
def joi_04(spark, sf):
    return rounded(E.category_clue(_base(spark, sf), "estado"), 6)


_RANKED = "t AS (SELECT estado AS k, sum(importe) AS v FROM ventas_demo GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY v DESC, k) AS p, COUNT(*) OVER () AS n, sum(v) OVER () AS s FROM t)"


@query("exp-07", f"{W_DEMO}, {_RANKED} SELECT max(k) FILTER (WHERE p = 1) AS first, {rs('max(v)')} AS first_value, {rs('max(v) / any_value(s)', 6)} AS first_share, {rs('sum(v) FILTER (WHERE p <= 2) / any_value(s)', 6)} AS two_share, {rs('1 - sum(v) FILTER (WHERE p <= 7) / any_value(s)', 6)} AS rest_share, any_value(n) - 7 AS n_rest FROM o")
def exp_07(spark, sf):
    return rounded(E.read_ranking(K.per_value(ventas_demo(spark, sf), "estado", "importe")), 6, first_value=2)


_LEAD = "t AS (SELECT cliente AS k, sum(importe) AS v FROM ventas_demo GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY v DESC, k) AS p FROM t), m AS (SELECT median(v) AS m FROM o WHERE p > 1)"


@query("exp-08", f"{W_DEMO}, {_LEAD} SELECT k AS first, {rs('v')} AS v, {rs('m')} AS median_rest, {rs('v / m', 4)} AS times FROM o, m WHERE p = 1 AND v >= 3 * m")
def exp_08(spark, sf):
    return rounded(E.unusual_leader(K.per_value(ventas_demo(spark, sf), "cliente", "importe")), times=4)


# --- views -------------------------------------------------------------------------------

_VIEWS = f"""{W_DEMO}, {_M}, {_FOLD.replace('heads AS', 'heads0 AS').replace('(FROM heads)', '(FROM heads0)').replace('d AS', 'd0 AS')},
seg AS (SELECT segmento AS c, sum(importe) AS v FROM ventas_demo GROUP BY 1), prod AS (SELECT producto AS c, sum(importe) AS v FROM ventas_demo GROUP BY 1),
q AS (SELECT quantile_cont(importe, 0.01) AS lo, quantile_cont(importe, 0.99) AS hi FROM ventas_demo), x AS (SELECT importe AS v FROM ventas_demo, q WHERE importe BETWEEN lo AND hi),
box AS (SELECT segmento AS c, median(importe) AS v FROM ventas_demo GROUP BY 1), """


@query("vis-02", _VIEWS + f"""b2 AS (SELECT least(50, greatest(10, CAST(floor(sqrt(COUNT(*))) AS INTEGER))) AS k, COUNT(*) AS n FROM x),
todo AS (SELECT 'tiempo' AS view, COUNT(*) AS filas, {rs('sum(value)')} AS total FROM serie UNION ALL SELECT 'volumen', COUNT(*), sum(n) FROM serie
UNION ALL SELECT 'rank_segmento', COUNT(*), {rs('sum(v)')} FROM seg UNION ALL SELECT 'rank_producto', COUNT(*), {rs('sum(v)')} FROM prod
UNION ALL SELECT 'dist', any_value(k), any_value(n) FROM b2 UNION ALL SELECT 'caja', COUNT(*), {rs('sum(v)')} FROM box)
SELECT view, CAST(filas AS BIGINT) AS filas, CAST(total AS DOUBLE) AS total FROM todo""")
def vis_02(spark, sf):
    figures = {"line": "value", "bar": "total", "hist": "n", "box": "median"}
    out = None
    with held(ventas_demo(spark, sf)) as df:
        for v in V.board_views(df, P.profile(df), MAPPING):
            one = v.data.agg(F.lit(v.name).alias("view"), F.count(F.lit(1)).alias("filas"), r(F.sum(figures[v.kind]).cast("double")).alias("total"))
            out = one if out is None else out.unionByName(one)
        return rows(spark, [tuple(x) for x in out.collect()], out.schema)  # a row per view


@query("vis-03", f"{W_DEMO}, s AS (SELECT CAST(date_trunc('month', fecha) AS DATE) AS period, (sum(importe) - sum(costo)) / sum(importe) AS a, sum(importe) / COUNT(DISTINCT folio) AS b FROM ventas_demo GROUP BY 1) SELECT 'Margen' AS kpi, period, {rs('a', 4)} AS value FROM s WHERE period < (SELECT max(period) FROM s) UNION ALL SELECT 'Ticket', period, {rs('b', 4)} FROM s WHERE period < (SELECT max(period) FROM s)")
def vis_03(spark, sf):
    df = ventas_demo(spark, sf)
    out = None
    for v in V.kpi_views(df, P.profile(df), MAPPING, CUSTOM[:2]):
        one = v.data.select(F.lit(v.name).alias("kpi"), "period", r("value", 4).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query("vis-04", f"{W_DEMO} SELECT COUNT(*) AS n, {rs('corr(cantidad, importe)', 6)} AS r, {rs('regr_slope(importe, cantidad)')} AS slope, {rs('regr_intercept(importe, cantidad)')} AS intercept, {rs('avg(cantidad)')} AS mean_x, {rs('avg(importe)')} AS mean_y FROM ventas_demo")
def vis_04(spark, sf):
    return rounded(G.pair_fit(ventas_demo(spark, sf), "cantidad", "importe"), r=6)


# --- geography ---------------------------------------------------------------------------

_NAMES = "nombres(plano, clave, etiqueta, lat, lon) AS (VALUES ('cdmx','ciudad de mexico','Ciudad de México',19.43e0,-99.13e0), ('distrito federal','ciudad de mexico','Ciudad de México',19.43e0,-99.13e0), ('s l p','san luis potosi','San Luis Potosí',22.15e0,-100.98e0), ('san luis potosi','san luis potosi','San Luis Potosí',22.15e0,-100.98e0), ('mexico','estado de mexico','Estado de México',19.35e0,-99.63e0), ('estado de mexico','estado de mexico','Estado de México',19.35e0,-99.63e0), ('coahuila de zaragoza','coahuila','Coahuila',27.30e0,-102.05e0)), p AS (SELECT *, trim(regexp_replace(lower(strip_accents(estado)), '[^a-z0-9]+', ' ', 'g')) AS plano FROM estados)"


@query("joi-03", f"WITH {SQL_ESTADOS}, {_NAMES} SELECT folio, estado, clave AS state FROM p LEFT JOIN nombres USING (plano)")
def joi_03(spark, sf):
    return geo.with_state(estados(spark, sf), "estado").select("folio", "estado", "state")


@query("geo-01", f"WITH {SQL_ESTADOS}, {_NAMES}, d AS (SELECT DISTINCT estado, clave FROM p LEFT JOIN nombres USING (plano)) SELECT COUNT(*) AS distintos, COUNT(clave) AS reconocidos, COUNT(*) >= 3 AND COUNT(clave) / COUNT(*) >= 0.6 AS es_de_estados FROM d")
def geo_01(spark, sf):
    return geo.recognition(estados(spark, sf), "estado")


_GEO = f"WITH {SQL_ESTADOS}, {_NAMES} SELECT clave AS state, etiqueta AS label, lat, lon, {rs('sum(importe)')} AS value FROM p JOIN nombres USING (plano) GROUP BY ALL"


@query("geo-02", _GEO)
def geo_02(spark, sf):
    return rounded(geo.state_totals(K.per_value(estados(spark, sf), "estado", "importe")))


@query("geo-03", _GEO)
def geo_03(spark, sf):
    df = estados(spark, sf)
    return rounded(V.map_data(df, P.profile(df), "importe")[1])


# --- crosses used by the models ----------------------------------------------------------


@query("joi-05", f"WITH {SQL_DEMO} SELECT segmento AS c, estatus AS y, COUNT(*) AS n FROM ventas_demo GROUP BY ALL")
def joi_05(spark, sf):
    from tabulario.models.features import cross_table
    return cross_table(ventas_demo(spark, sf), "segmento", "estatus")
