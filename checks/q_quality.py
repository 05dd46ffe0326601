"""Quality rules, score and repairs."""
from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from checks.q_values import _ALL, _SQL_NUMBER
from checks.registry import query, r, rs
from checks.views import SQL_DEMO, SQL_SUCIAS, table, ventas_demo, ventas_sucias
from tabulario.operators import profile as P
from tabulario.operators import quality as Q
from tabulario.operators import repair as R
from tabulario.operators.copies import duplicate_rows
from tabulario.plans.autoclean import auto_clean
from tabulario.session import held

AS_OF = date(2026, 1, 1)


def short(issues):
    return issues.select("code", "severity", "column", "n_affected", r("pct_affected", 6).alias("pct_affected"))


def issue(code: str, severity: str, column: str, n: str, pct: str, source: str = "ventas_sucias", where: str = "") -> str:
    """SQL for one issue row; `n` and `pct` are expressions over the source, `where` decides whether it fires."""
    return (f"SELECT '{code}' AS code, {severity} AS severity, {column} AS \"column\", CAST({n} AS BIGINT) AS n_affected, "
            f"{rs(pct, 6)} AS pct_affected FROM {source} {where}")


CRIT, WARN, INF = "'crítico'", "'advertencia'", "'info'"
_DUP = f"(SELECT SUM(c - 1) AS d, SUM(c) AS n FROM (SELECT COUNT(*) AS c FROM ventas_sucias GROUP BY {', '.join(_ALL)}))"
# text columns that are neither numbers, dates, constant nor empty
_TEXT = ["cliente", "canal", "estado", "vendedor", "estatus", "correo", "lote"]
_KEY = "regexp_replace(trim(lower(strip_accents(v))), '\\s+', ' ', 'g')"
_AMOUNT = "CAST(replace(replace(importe, '$ ', ''), ',', '') AS DOUBLE)"
_NUMERIC = {"importe": _AMOUNT, "costo": "costo", "cantidad": "cantidad"}
_MARKS = "Ã¡|Ã©|Ã­|Ã³|Ãº|Ã±|Ã‘|Â¿|Â°|â€™|â€œ|ï¿½"
_DATE = "try_strptime(fecha, '%d/%m/%Y')"


def each(columns, f):
    return " UNION ALL ".join(f(c) for c in columns)


def _text_rule(code, severity, columns, test):
    return each(columns, lambda c: issue(code, severity, f"'{c}'", "COUNT(*) FILTER (WHERE " + test(c) + ")",
                                         "COUNT(*) FILTER (WHERE " + test(c) + f") / COUNT({c})",
                                         where="HAVING COUNT(*) FILTER (WHERE " + test(c) + ") > 0"))


def _lengths(columns) -> str:
    def one(c):
        v = _NUMERIC.get(c, c) if c != "importe" else c
        if c in ("folio", "sku", "costo", "cantidad"):
            size = f"length(CAST(CAST(trunc(abs({v})) AS BIGINT) AS VARCHAR))"
        else:
            size = f"length(translate(regexp_replace(trim({c}), '\\.0$', ''), '- ,', ''))"
        return f"SELECT '{c}' AS col, {size} AS l, COUNT(*) AS n FROM ventas_sucias WHERE {c} IS NOT NULL GROUP BY 2"

    return f"""(WITH k AS ({each(columns, one)}),
 p AS (SELECT *, COALESCE(SUM(n) OVER (PARTITION BY col ORDER BY n DESC, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS antes,
   SUM(n) OVER (PARTITION BY col) AS total FROM k),
 q AS (SELECT *, antes < total * 0.95e0 AS comun FROM p),
 ok AS (SELECT col FROM q WHERE comun GROUP BY col HAVING COUNT(*) <= 3),
 raro AS (SELECT q.col, q.n, q.total FROM q JOIN ok USING (col) WHERE NOT comun AND NOT EXISTS
   (SELECT 1 FROM q z WHERE z.col = q.col AND z.comun AND abs(z.l - q.l) < 2))
 SELECT col, SUM(n) AS n, max(total) AS total FROM raro GROUP BY col HAVING SUM(n) <= greatest(5, floor(0.005e0 * max(total))))"""


def _tail(c, least: str = "salto >= 5") -> str:
    return f"""(WITH v AS (SELECT {_NUMERIC[c]} AS v FROM ventas_sucias WHERE {c} IS NOT NULL),
 t AS (SELECT DISTINCT v FROM v WHERE v > (SELECT quantile_cont(v, 0.99) FROM v)),
 j AS (SELECT v, v / CASE WHEN lag(v) OVER (ORDER BY v) > 0 THEN lag(v) OVER (ORDER BY v) END AS razon FROM t),
 m AS (SELECT max(razon) AS salto, arg_min(v, (-razon, v)) AS corte FROM j WHERE razon IS NOT NULL)
 SELECT salto, corte, (SELECT COUNT(*) FROM v WHERE v >= corte) AS n, (SELECT COUNT(*) FROM v) AS total,
   (SELECT SUM(v) FROM v WHERE v >= corte) / (SELECT SUM(v) FROM v) AS peso FROM m WHERE {least})"""


RULES = {
    "filas_duplicadas": issue("filas_duplicadas", f"CASE WHEN d / n > 0.05e0 THEN {CRIT} ELSE {WARN} END", "NULL", "d", "d / n", _DUP, "WHERE d > 0"),
    "id_duplicado": each(["folio", "sku", "correo"], lambda c: issue(
        "id_duplicado", CRIT, f"'{c}'", f"COUNT({c}) - COUNT(DISTINCT {c})", f"(COUNT({c}) - COUNT(DISTINCT {c})) / COUNT({c})",
        where=f"HAVING COUNT(DISTINCT {c}) / COUNT({c}) >= 0.9 AND COUNT({c}) > COUNT(DISTINCT {c})")),
    "nulos": each(_ALL, lambda c: issue(
        "nulos", f"CASE WHEN 1 - COUNT({c}) / COUNT(*) >= 0.6 THEN {CRIT} WHEN 1 - COUNT({c}) / COUNT(*) >= 0.2 THEN {WARN} ELSE {INF} END",
        f"'{c}'", f"COUNT(*) - COUNT({c})", f"(COUNT(*) - COUNT({c})) / COUNT(*)", where=f"HAVING COUNT({c}) < COUNT(*)")),
    "columna_vacia": each(_ALL, lambda c: issue("columna_vacia", CRIT, f"'{c}'", "COUNT(*)", "1e0", where=f"HAVING COUNT({c}) = 0")),
    "columna_constante": each(_ALL, lambda c: issue("columna_constante", WARN, f"'{c}'", "0", "0e0", where=f"HAVING COUNT(DISTINCT {c}) = 1")),
    "numero_como_texto": issue("numero_como_texto", CRIT, "'importe'", "0", "1e0", where=f"HAVING COUNT(TRY_CAST(replace(replace(importe, '$ ', ''), ',', '') AS DOUBLE)) / COUNT(importe) >= 0.85"),
    "fecha_como_texto": issue("fecha_como_texto", WARN, "'fecha'", "0", "1e0", where=f"HAVING COUNT({_DATE}) / COUNT(fecha) >= 0.85"),
    "tipo_mixto": each(_TEXT, lambda c: issue("tipo_mixto", WARN, f"'{c}'", "0", f"COUNT(TRY_CAST({c} AS DOUBLE)) / COUNT({c})",
                                              where=f"HAVING COUNT(TRY_CAST({c} AS DOUBLE)) / COUNT({c}) BETWEEN 0.2 AND 0.85")),
    "espacios": _text_rule("espacios", WARN, _TEXT, lambda c: f"{c} <> trim({c})"),
    "mojibake": _text_rule("mojibake", WARN, _TEXT, lambda c: f"regexp_matches({c}, '{_MARKS}')"),
    "categorias_inconsistentes": each(["canal", "estado", "vendedor", "estatus", "lote"], lambda c: issue(
        "categorias_inconsistentes", CRIT, f"'{c}'", "SUM(n)", "SUM(n) / max(total)",
        f"(SELECT SUM(n) AS n, COUNT(*) AS g, max(total) AS total FROM (SELECT {c} AS v, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS total FROM ventas_sucias WHERE {c} IS NOT NULL GROUP BY 1) GROUP BY {_KEY} HAVING COUNT(*) > 1)",
        "HAVING COUNT(*) > 0")),
    "email_invalido": _text_rule("email_invalido", WARN, ["correo"], lambda c: rf"NOT regexp_matches({c}, '^[^@\s]+@[^@\s]+\.[a-zA-Z]{{2,}}$')"),
    "valor_raro": each(_NUMERIC, lambda c: issue("valor_raro", f"CASE WHEN peso > 0.05e0 THEN {CRIT} ELSE {WARN} END", f"'{c}'", "n", "n / total",
                                                 _tail(c), "WHERE n <= greatest(5, floor(0.005e0 * total))")),
    "celda_rara": issue("celda_rara", WARN, "col", "n", "n / total", _lengths([c for c in _ALL if c not in ("fecha", "comentario")]),
                        "WHERE col NOT IN (SELECT \"column\" FROM raros)"),
    "negativos_sospechosos": each(_NUMERIC, lambda c: issue(
        "negativos_sospechosos", WARN, f"'{c}'", f"COUNT(*) FILTER (WHERE {_NUMERIC[c]} < 0)", f"COUNT(*) FILTER (WHERE {_NUMERIC[c]} < 0) / COUNT({c})",
        where=f"HAVING COUNT(*) FILTER (WHERE {_NUMERIC[c]} < 0) > 0")),
    "outliers": each(_NUMERIC, lambda c: issue(
        "outliers", f"CASE WHEN fuera / n < 0.05e0 THEN {WARN} ELSE {CRIT} END", f"'{c}'", "fuera", "fuera / n",
        f"""(SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE v < q1 - 3 * (q3 - q1) OR v > q3 + 3 * (q3 - q1)) AS fuera, any_value(q3 - q1) AS ric
 FROM (SELECT {_NUMERIC[c]} AS v FROM ventas_sucias WHERE {c} IS NOT NULL), (SELECT quantile_cont({_NUMERIC[c]}, 0.25) AS q1, quantile_cont({_NUMERIC[c]}, 0.75) AS q3 FROM ventas_sucias))""",
        "WHERE fuera > 0 AND ric > 0")),
    "asimetria": each(_NUMERIC, lambda c: issue("asimetria", INF, f"'{c}'", "0", "0e0", where=f"HAVING abs(skewness({_NUMERIC[c]})) > 3")),
    "fechas_imposibles": issue("fechas_imposibles", CRIT, "'fecha'", f"COUNT(*) FILTER (WHERE {_DATE} < TIMESTAMP '1950-01-01')",
                               f"COUNT(*) FILTER (WHERE {_DATE} < TIMESTAMP '1950-01-01') / COUNT({_DATE})",
                               where=f"HAVING COUNT(*) FILTER (WHERE {_DATE} < TIMESTAMP '1950-01-01') > 0"),
    "hueco_temporal": issue("hueco_temporal", WARN, "'fecha'", "0", "0e0",
                            f"""(SELECT max(g) AS g, median(g) AS m FROM (SELECT date_diff('day', lag(d) OVER (ORDER BY d), d) AS g FROM (SELECT DISTINCT CAST({_DATE} AS DATE) AS d FROM ventas_sucias WHERE fecha IS NOT NULL)))""",
                            "WHERE g > greatest(m * 10, 30)"),
    "alta_cardinalidad": each(_TEXT, lambda c: issue("alta_cardinalidad", INF, f"'{c}'", "0", "0e0",
                                                     where=f"HAVING COUNT(DISTINCT {c}) > 50 AND COUNT(DISTINCT {c}) / COUNT({c}) > 0.5 AND COUNT(DISTINCT {c}) / COUNT({c}) <= 0.95")),
}
# odd values first: their columns are not examined for odd cells
WITH = f"WITH {SQL_SUCIAS}, raros AS ({RULES['valor_raro']})"
WITH_NONE = f"WITH {SQL_SUCIAS}, raros AS (SELECT NULL AS \"column\" WHERE false)"


def _rule(key, code, f, stats=False, **kw):
    def run(spark, sf):
        with held(ventas_sucias(spark, sf)) as df:
            return short(f(df, P.profile(df, stats=stats), **kw))

    query(key, f"{WITH} {RULES[code]}")(run)


_rule("qlt-02", "filas_duplicadas", Q.repeated_rows)
_rule("qlt-05", "id_duplicado", Q.repeated_keys, stats=True)
_rule("qlt-06", "nulos", Q.missing_values)
_rule("qlt-07", "columna_vacia", Q.empty_columns)
_rule("qlt-08", "columna_constante", Q.constant_columns)
_rule("qlt-09", "numero_como_texto", Q.numbers_as_text)
_rule("qlt-10", "fecha_como_texto", Q.dates_as_text)
_rule("qlt-11", "tipo_mixto", Q.mixed_types)
_rule("qlt-12", "espacios", Q.padded_text)
_rule("qlt-13", "mojibake", Q.broken_text)
_rule("qlt-14", "categorias_inconsistentes", Q.inconsistent_spelling)
_rule("qlt-15", "email_invalido", Q.bad_emails)
_rule("qlt-17", "valor_raro", Q.odd_values, stats=True)
_rule("qlt-19", "negativos_sospechosos", Q.suspicious_negatives, stats=True)
_rule("qlt-20", "outliers", Q.outliers, stats=True)
_rule("qlt-21", "asimetria", Q.skewed, stats=True)
_rule("qlt-25", "fechas_imposibles", Q.impossible_dates, stats=True)
_rule("qlt-26", "hueco_temporal", Q.time_gap, stats=True)


@query("qlt-18", f"{WITH} {RULES['celda_rara']}")
def qlt_18(spark, sf):
    df = ventas_sucias(spark, sf)
    found = P.profile(df)
    odd = tuple(x["column"] for x in Q.odd_values(df, found).collect())
    return short(Q.odd_cells(df, found, reported=odd))


def _on(key, sql, view, f, stats=True):
    """A rule over a view of one table; `view` is text both engines read."""
    name = next(t for t in ("orders", "lineitem", "nation") if f" {t}" in view)

    def run(spark, sf):
        df = spark.sql(view.replace(f" {name}", " {t}"), t=table(spark, sf, name))
        return short(f(df, P.profile(df, stats=stats)))

    query(key, f"WITH v AS ({view}) {sql}")(run)


_on("qlt-01", issue("sin_filas", CRIT, "NULL", "0", "0e0", "v", "HAVING COUNT(*) = 0"),
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 0", Q.no_rows)
_on("qlt-03", issue("filas_vacias", WARN, "NULL", "COUNT(*) FILTER (WHERE a IS NULL AND b IS NULL)",
                    "COUNT(*) FILTER (WHERE a IS NULL AND b IS NULL) / COUNT(*)", "v"),
    "SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS a, CASE WHEN o_orderkey % 25 = 0 THEN NULL ELSE o_orderstatus END AS b FROM orders",
    Q.empty_rows, False)
_on("qlt-04", issue("pocos_registros", WARN, "NULL", "0", "0e0", "v", "HAVING COUNT(*) < 30"), "SELECT * FROM nation", Q.few_rows, False)
_BAD_PHONE = r"COUNT(*) FILTER (WHERE NOT regexp_matches(telefono, '^[\d\s\-+().]{7,20}$'))"
_on("qlt-16", issue("telefono_invalido", INF, "'telefono'", _BAD_PHONE, _BAD_PHONE + " / COUNT(*)", "v"),
    "SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'sin telefono' ELSE concat('55-', CAST(1000 + o_orderkey % 9000 AS VARCHAR(9)), '-', CAST(1000 + o_orderkey % 8999 AS VARCHAR(9))) END AS telefono FROM orders",
    Q.bad_phones, False)
_OUT = "COUNT(*) FILTER (WHERE pct_avance < 0 OR pct_avance > 100)"
_on("qlt-22", issue("porcentaje_fuera_rango", WARN, "'pct_avance'", _OUT, _OUT + " / COUNT(*)", "v"),
    "SELECT l_tax * 2000e0 AS pct_avance, l_quantity FROM lineitem", Q.percent_out_of_range)
_on("qlt-23", issue("muchos_ceros", WARN, "'saldo'", "COUNT(*) FILTER (WHERE saldo = 0)", "COUNT(*) FILTER (WHERE saldo = 0) / COUNT(*)", "v"),
    "SELECT CASE WHEN o_orderkey % 5 < 2 THEN 0e0 ELSE o_totalprice END AS saldo FROM orders", Q.too_many_zeros)
_LATE = "COUNT(*) FILTER (WHERE fecha > TIMESTAMP '2001-01-01')"
_on("qlt-24", issue("fechas_futuras", WARN, "'fecha'", _LATE, _LATE + " / COUNT(fecha)", "v"),
    "SELECT o_orderdate AS fecha FROM orders", lambda df, p: Q.future_dates(df, p, date(2001, 1, 1)))
_on("qlt-28", issue("alta_cardinalidad", INF, "'etiqueta'", "0", "0e0", "v", "HAVING COUNT(DISTINCT etiqueta) > 50 AND COUNT(DISTINCT etiqueta) / COUNT(*) > 0.5"),
    "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'general' ELSE concat('lote ', CAST(o_orderkey AS VARCHAR(12))) END AS etiqueta FROM orders",
    Q.high_cardinality, False)

_PAIRS = "SELECT l_extendedprice AS importe, l_extendedprice * 1.16e0 AS facturado, l_quantity AS cantidad, l_discount AS rebaja FROM lineitem"
_CORR = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, COUNT(*) AS n, {rs(f'corr({a}, {b})', 4)} AS r FROM v"
    for i, a in enumerate(["importe", "facturado", "cantidad", "rebaja"]) for b in ["importe", "facturado", "cantidad", "rebaja"][i + 1:])


@query("qlt-27", f"WITH v AS ({_PAIRS}), c AS ({_CORR}) SELECT 'columnas_redundantes' AS code, 'info' AS severity, a, b, r FROM c WHERE abs(r) > 0.98")
def qlt_27(spark, sf):
    df = spark.sql(_PAIRS.replace(" lineitem", " {t}"), t=table(spark, sf, "lineitem"))
    found = Q.redundant_columns(df, P.profile(df))
    return found.select("code", "severity", F.col("payload")["a"].alias("a"), F.col("payload")["b"].alias("b"),
                        r(F.col("payload")["r"].cast("double"), 4).alias("r"))


@query("agg-10", f"WITH v AS ({_PAIRS}) {_CORR}")
def agg_10(spark, sf):
    df = spark.sql(_PAIRS.replace(" lineitem", " {t}"), t=table(spark, sf, "lineitem"))
    return Q.correlations(df, df.columns).select("a", "b", "n", r("r", 4).alias("r"))


@query("agg-11", f"WITH {SQL_SUCIAS}, v AS (SELECT costo, cantidad, CAST(sku AS DOUBLE) AS sku FROM ventas_sucias WHERE costo IS NOT NULL AND cantidad IS NOT NULL) "
       + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, COUNT(*) AS n, {rs(f'corr({a}, {b})', 6)} AS r FROM v"
                            for a, b in (("costo", "cantidad"), ("costo", "sku"), ("cantidad", "sku"))))
def agg_11(spark, sf):
    df = ventas_sucias(spark, sf).select("costo", "cantidad", "sku")
    return Q.correlations(df, df.columns, complete_rows=True).select("a", "b", "n", r("r", 6).alias("r"))


_HOLES = ("SELECT CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END AS importe, CASE WHEN l_partkey % 5 <> 0 THEN l_quantity END AS cantidad, "
          "CASE WHEN l_suppkey % 3 <> 0 THEN l_discount END AS rebaja, l_tax AS impuesto, CASE WHEN l_linenumber > 9 THEN l_tax END AS vacio FROM lineitem")
_HOLED = ["importe", "cantidad", "rebaja", "impuesto", "vacio"]


@query("agg-10-holes", f"WITH v AS ({_HOLES}) " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, COUNT(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, {rs(f'corr({a}, {b})', 4)} AS r FROM v"
    for i, a in enumerate(_HOLED) for b in _HOLED[i + 1:]))
def agg_10_holes(spark, sf):
    df = spark.sql(_HOLES.replace(" lineitem", " {t}"), t=table(spark, sf, "lineitem"))
    return Q.correlations(df, df.columns).select("a", "b", "n", r("r", 4).alias("r"))


_EVERY = " UNION ALL ".join(f"({s})" for s in RULES.values())


def _issues(spark, sf):
    return Q.detect_issues(ventas_sucias(spark, sf), as_of=AS_OF)


@query("qlt-29", f"{WITH} {_EVERY}")
def qlt_29(spark, sf):
    return short(_issues(spark, sf))


_RANK = "CASE severity WHEN 'crítico' THEN 1 WHEN 'advertencia' THEN 2 ELSE 3 END"


@query("top-04", f"{WITH}, todo AS ({_EVERY}) SELECT CAST(row_number() OVER (ORDER BY {_RANK}, pct_affected DESC, code, \"column\") AS INTEGER) AS position, code, \"column\" FROM todo")
def top_04(spark, sf):
    issues = _issues(spark, sf).collect()
    return spark.createDataFrame([(i + 1, x["code"], x["column"]) for i, x in enumerate(issues)], "position int, code string, column string")


_SCORE = f"""tipos AS (SELECT code, max(CASE severity WHEN 'crítico' THEN 12e0 WHEN 'advertencia' THEN 5e0 ELSE 1.5e0 END) AS w, max(pct_affected) AS p, COUNT(*) AS k FROM todo GROUP BY code),
puntaje AS (SELECT CAST(round_even(greatest(0e0, 100e0 - SUM(w * (0.35e0 + 0.65e0 * least(p, 1e0) + least(0.3e0 * (k - 1), 1.5e0)))), 0) AS INTEGER) AS score FROM tipos)"""


@query("qlt-30", f"""{WITH}, todo AS ({_EVERY}), {_SCORE} SELECT score, (SELECT COUNT(*) FROM todo WHERE severity = 'crítico') AS n_critico,
(SELECT COUNT(*) FROM todo WHERE severity = 'advertencia') AS n_advertencia, (SELECT COUNT(*) FROM todo WHERE severity = 'info') AS n_info FROM puntaje""")
def qlt_30(spark, sf):
    return Q.quality_score(_issues(spark, sf))


@query("qlt-31", f"""{WITH}, todo AS ({_EVERY}), {_SCORE} SELECT score, CASE WHEN score >= 78 THEN 'Alta' WHEN score >= 50 THEN 'Media' ELSE 'Baja' END AS confianza FROM puntaje""")
def qlt_31(spark, sf):
    return Q.quality_score(_issues(spark, sf)).select("score", Q.confidence(F.col("score")).alias("confianza"))


_SAFE = "'filas_duplicadas','filas_vacias','columna_vacia','numero_como_texto','fecha_como_texto','espacios','mojibake','categorias_inconsistentes','fechas_imposibles'"


@query("qlt-32", f"""{WITH}, todo AS ({_EVERY}) SELECT severity AS severidad, COALESCE("column", '(tabla completa)') AS columna, code, n_affected AS registros, code IN ({_SAFE}) AS corregible FROM todo""")
def qlt_32(spark, sf):
    return Q.issue_table(_issues(spark, sf)).select("severidad", "columna", "code", "registros", "corregible")


@query("top-08", f"""{WITH}, todo AS ({_EVERY}) SELECT code, "column", n_affected FROM todo WHERE code IN ('valor_raro', 'celda_rara')""")
def top_08(spark, sf):
    return Q.rarities(_issues(spark, sf)).select("code", "column", "n_affected")


@query("win-02", f"""WITH {SQL_SUCIAS}, d AS (SELECT DISTINCT CAST({_DATE} AS DATE) AS d FROM ventas_sucias),
g AS (SELECT d, lag(d) OVER (ORDER BY d) AS antes, date_diff('day', lag(d) OVER (ORDER BY d), d) AS g FROM d)
SELECT (SELECT COUNT({_DATE}) FROM ventas_sucias) AS n, (SELECT COUNT(*) FROM d) AS days, CAST(max(g) AS INTEGER) AS max_gap, median(g) AS median_gap,
arg_min(antes, (-g, d)) FILTER (WHERE g IS NOT NULL) AS gap_start, arg_min(d, (-g, d)) FILTER (WHERE g IS NOT NULL) AS gap_end FROM g""")
def win_02(spark, sf):
    return Q.day_gaps(ventas_sucias(spark, sf), ["fecha"]).drop("column")


@query("win-03", f"WITH {SQL_SUCIAS} " + each(_NUMERIC, lambda c: f"SELECT '{c}' AS \"column\", {rs('salto', 4)} AS jump, {rs('corte', 2)} AS cut FROM {_tail(c, 'true')} AS t WHERE salto IS NOT NULL"))
def win_03(spark, sf):
    found = Q.tail_jump(ventas_sucias(spark, sf), list(_NUMERIC))
    return found.select("column", r("jump", 4).alias("jump"), r("cut").alias("cut"))


_LEN = ["sku", "estatus", "cliente", "canal"]


@query("win-05", f"""WITH {SQL_SUCIAS}, k AS (""" + each(_LEN, lambda c: f"SELECT '{c}' AS \"column\", " + (
    f"length(CAST(abs({c}) AS VARCHAR))" if c == "sku" else f"length(translate(trim({c}), '- ,', ''))") + f" AS length, COUNT(*) AS n FROM ventas_sucias WHERE {c} IS NOT NULL GROUP BY 2")
    + """) SELECT "column", CAST(length AS INTEGER) AS length, CAST(n AS BIGINT) AS n, COALESCE(SUM(n) OVER (PARTITION BY "column" ORDER BY n DESC, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.95e0 * SUM(n) OVER (PARTITION BY "column") AS common FROM k""")
def win_05(spark, sf):
    return Q.covered_lengths(Q.shape_counts(ventas_sucias(spark, sf), _LEN)).select("column", "length", "n", "common")


@query("agg-05", f"WITH {SQL_SUCIAS} SELECT CAST(d AS BIGINT) AS n_duplicates FROM {_DUP}")
def agg_05(spark, sf):
    return duplicate_rows(ventas_sucias(spark, sf))


# --- repairs -----------------------------------------------------------------------------


@query("prp-01", f"WITH {SQL_SUCIAS} SELECT replace(vendedor, 'MarÃ­a', 'María') AS vendedor, COUNT(*) AS n FROM ventas_sucias GROUP BY 1")
def prp_01(spark, sf):
    out = R.apply_plan(ventas_sucias(spark, sf), R.Plan(fix_mojibake=["vendedor"]))
    return out.table.groupBy("vendedor").agg(F.count("*").alias("n"))


@query("prp-02", f"WITH {SQL_SUCIAS} SELECT regexp_replace(trim(canal), '\\s+', ' ', 'g') AS canal, COUNT(*) AS n FROM ventas_sucias GROUP BY ALL")
def prp_02(spark, sf):
    out = R.apply_plan(ventas_sucias(spark, sf), R.Plan(trim=["canal"]))
    return out.table.groupBy("canal").agg(F.count("*").alias("n"))


_CANON = f"""c AS (SELECT canal AS v, COUNT(*) AS n FROM ventas_sucias GROUP BY 1), k AS (SELECT v, n, {_KEY} AS clave FROM c),
canon AS (SELECT v, first_value(v) OVER (PARTITION BY clave ORDER BY n DESC, v) AS canal FROM k)"""


@query("prp-03", f"WITH {SQL_SUCIAS}, {_CANON} SELECT canon.canal, COUNT(*) AS n, CAST(SUM(CASE WHEN canon.canal <> s.canal THEN 1 ELSE 0 END) AS BIGINT) AS cambiados FROM ventas_sucias s JOIN canon ON s.canal = canon.v GROUP BY ALL")
def prp_03(spark, sf):
    df = ventas_sucias(spark, sf).withColumn("antes", F.col("canal"))
    return R.unify_categories(df, "canal").groupBy("canal").agg(
        F.count("*").alias("n"), F.count_if(F.col("canal") != F.col("antes")).alias("cambiados"))


@query("joi-02", f"WITH {SQL_SUCIAS}, {_CANON} SELECT v AS value, {_KEY} AS key, canal AS canonical FROM canon WHERE v <> canal")
def joi_02(spark, sf):
    return R.canonical_spellings(ventas_sucias(spark, sf), "canal")


@query("prp-04", f"WITH {SQL_SUCIAS}, textos AS (SELECT folio, importe AS texto, lote FROM ventas_sucias), {_SQL_NUMBER} SELECT folio, numero AS importe, TRY_CAST(lote AS DOUBLE) AS lote FROM numeros")
def prp_04(spark, sf):
    out = R.apply_plan(ventas_sucias(spark, sf).select("folio", "importe", "lote"), R.Plan(to_numeric=["importe", "lote"]))
    return out.table


@query("prp-05", f"WITH {SQL_SUCIAS} SELECT folio, {_DATE} AS fecha FROM ventas_sucias")
def prp_05(spark, sf):
    return R.apply_plan(ventas_sucias(spark, sf).select("folio", "fecha"), R.Plan(to_datetime=["fecha"])).table


@query("prp-06", f"WITH {SQL_SUCIAS} SELECT folio, CASE WHEN {_DATE} >= TIMESTAMP '1950-01-01' THEN {_DATE} END AS fecha FROM ventas_sucias")
def prp_06(spark, sf):
    return R.apply_plan(ventas_sucias(spark, sf).select("folio", "fecha"), R.Plan(null_dates=["fecha"])).table


@query("prp-07", f"""WITH {SQL_SUCIAS}, m AS (SELECT median(costo) AS med, avg(costo) AS media FROM ventas_sucias),
e AS (SELECT estado AS moda FROM ventas_sucias WHERE estado IS NOT NULL GROUP BY estado ORDER BY COUNT(*) DESC, estado LIMIT 1)
SELECT folio, {rs('COALESCE(costo, med)')} AS mediana, {rs('COALESCE(costo, media)')} AS media, COALESCE(estado, moda) AS moda, COALESCE(costo, 0e0) AS cero, COALESCE(estado, 'DESCONOCIDO') AS desconocido FROM ventas_sucias, m, e""")
def prp_07(spark, sf):
    df = ventas_sucias(spark, sf).select("folio", F.col("costo").alias("mediana"), F.col("costo").alias("media"),
                                         F.col("estado").alias("moda"), F.col("costo").alias("cero"), F.col("estado").alias("desconocido"))
    plan = R.Plan(impute={c: c for c in ("mediana", "media", "moda", "cero", "desconocido")})
    out = R.apply_plan(df, plan).table
    return out.withColumns({"mediana": r("mediana"), "media": r("media")})


_FILL = f"""COALESCE(last_value(estado IGNORE NULLS) OVER (ORDER BY folio ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
first_value(estado IGNORE NULLS) OVER (ORDER BY folio ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
_GAPS = "SELECT folio, CASE WHEN folio % 25 < 3 THEN NULL ELSE estado END AS estado FROM ventas_demo"


@query("prp-08", f"WITH {SQL_DEMO}, v AS ({_GAPS}) SELECT folio, {_FILL} AS estado FROM v")
def prp_08(spark, sf):
    df = spark.sql(_GAPS.replace("ventas_demo", "{t}"), t=ventas_demo(spark, sf))
    return R.apply_plan(df, R.Plan(impute={"estado": "ffill"}), row_id="folio").table


@query("win-06", f"WITH {SQL_DEMO}, v AS ({_GAPS.replace('estado FROM', 'estado, segmento FROM')}) SELECT folio, {_FILL.replace('ORDER BY', 'PARTITION BY segmento ORDER BY')} AS estado FROM v")
def win_06(spark, sf):
    df = spark.sql(_GAPS.replace("estado FROM", "estado, segmento FROM").replace("ventas_demo", "{t}"), t=ventas_demo(spark, sf))
    return R.carry_forward(df, "estado", "folio", ["segmento"]).select("folio", "estado")


_SEVERAL = {"estado": "folio % 25 < 3", "producto": "folio % 7 = 0", "importe": "folio % 11 < 4"}


@query("win-06-several", f"WITH {SQL_DEMO}, v AS (SELECT folio, segmento, " + ", ".join(
    f"CASE WHEN {w} THEN NULL ELSE {c} END AS {c}" for c, w in _SEVERAL.items()) + " FROM ventas_demo) SELECT folio, " + ", ".join(
    _FILL.replace("estado", c).replace("ORDER BY", "PARTITION BY segmento ORDER BY") + f" AS {c}" for c in _SEVERAL) + " FROM v")
def win_06_several(spark, sf):
    df = ventas_demo(spark, sf).select("folio", "segmento", *[F.when(~F.expr(w), F.col(c)).alias(c) for c, w in _SEVERAL.items()])
    return R.carry_forward(df, list(_SEVERAL), "folio", ["segmento"]).drop("segmento")


@query("prp-09", f"WITH {SQL_SUCIAS} SELECT folio, estado FROM ventas_sucias WHERE estado IS NOT NULL")
def prp_09(spark, sf):
    return R.apply_plan(ventas_sucias(spark, sf).select("folio", "estado"), R.Plan(impute={"estado": "eliminar_filas"})).table


@query("prp-10", f"""WITH {SQL_DEMO}, q AS (SELECT quantile_cont(importe, 0.25) AS q1, quantile_cont(importe, 0.75) AS q3, quantile_cont(costo, 0.01) AS p1, quantile_cont(costo, 0.99) AS p99 FROM ventas_demo)
SELECT folio, {rs('least(greatest(importe, q1 - 3 * (q3 - q1)), q3 + 3 * (q3 - q1))')} AS importe, {rs('least(greatest(costo, p1), p99)')} AS costo FROM ventas_demo, q""")
def prp_10(spark, sf):
    plan = R.Plan(clip_outliers={"importe": "iqr", "costo": "p1p99"})
    out = R.apply_plan(ventas_demo(spark, sf).select("folio", "importe", "costo"), plan).table
    return out.select("folio", r("importe").alias("importe"), r("costo").alias("costo"))


_COLS = "folio, cliente, fecha, canal, importe, costo, cantidad, estado, correo"


@query("prp-11", f"WITH {SQL_SUCIAS} SELECT DISTINCT {_COLS} FROM ventas_sucias")
def prp_11(spark, sf):
    return R.apply_plan(ventas_sucias(spark, sf).select(*_COLS.split(", ")), R.Plan(drop_duplicates=True)).table


_ODD = "SELECT o_orderkey AS `Nº de Pedido`, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS `Clave Cliente`, o_totalprice AS `Año/Monto`, o_orderstatus AS `sobra` FROM {t}"


@query("prp-12", """SELECT o_orderkey AS n_de_pedido, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS clave_cliente, o_totalprice AS ano_monto FROM orders""".replace("n_de_pedido", "nº_de_pedido"))
def prp_12(spark, sf):
    df = spark.sql(_ODD, t=table(spark, sf, "orders"))
    return R.apply_plan(df, R.Plan(drop_columns=["sobra"], drop_empty_rows=True, snake_case=True)).table


query("prj-02", "SELECT o_orderkey AS \"nº_de_pedido\", CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS clave_cliente, o_totalprice AS ano_monto, o_orderstatus AS sobra FROM orders")(
    lambda spark, sf: R.rename_snake_case(spark.sql(_ODD, t=table(spark, sf, "orders"))))
query("prj-01", f"WITH {SQL_SUCIAS} SELECT folio, canal, importe FROM ventas_sucias")(
    lambda spark, sf: ventas_sucias(spark, sf).drop(*[c for c in _ALL if c not in ("folio", "canal", "importe")]))
_BLANK = "SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS a, CASE WHEN o_orderkey % 25 = 0 THEN NULL ELSE o_orderstatus END AS b FROM {t}"
query("flt-01", f"WITH v AS ({_BLANK.format(t='orders')}) SELECT * FROM v WHERE a IS NOT NULL OR b IS NOT NULL")(
    lambda spark, sf: R.drop_empty_rows(spark.sql(_BLANK, t=table(spark, sf, "orders"))))
query("flt-02", f"WITH v AS ({_BLANK.format(t='orders')}) SELECT * FROM v WHERE b IS NOT NULL")(
    lambda spark, sf: spark.sql(_BLANK, t=table(spark, sf, "orders")).na.drop(subset=["b"]))


@query("prp-14", f"""WITH {SQL_SUCIAS}, c AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE canal <> trim(canal)) AS espacios, COUNT(*) FILTER (WHERE costo IS NULL) AS sin_costo, median(costo) AS mediana FROM ventas_sucias)
SELECT x.* FROM c, LATERAL (VALUES ('eliminar_columna', 'comentario', NULL, ''), ('recortar_espacios', 'canal', espacios, ''), ('a_numero', 'importe', 0, 'valores que quedaron nulos'),
 ('imputar', 'costo', sin_costo, concat('mediana=', format('{{:.2f}}', mediana))), ('eliminar_duplicadas', NULL, n - (SELECT COUNT(*) FROM orders), '')) x(action, "column", n_affected, detail)""")
def prp_14(spark, sf):
    df = ventas_sucias(spark, sf)
    plan = R.Plan(drop_columns=["comentario"], trim=["canal"], normalize_categories=["canal"], to_numeric=["importe"],
                  null_dates=["fecha"], impute={"costo": "mediana"}, clip_outliers={"cantidad": "iqr"}, drop_duplicates=True)
    log = R.apply_plan(df, plan).log.drop("step")
    return log.where(~F.col("action").isin("unificar_categorias", "vaciar_fechas", "acotar", "resultado"))


_CLEAN = f"""limpia AS (SELECT DISTINCT folio, CASE WHEN {_DATE} >= TIMESTAMP '1950-01-01' THEN {_DATE} END AS fecha, canon.canal AS canal, {_AMOUNT} AS importe, costo, cantidad, estado, estatus, sku
 FROM (SELECT * REPLACE (trim(canal) AS canal) FROM ventas_sucias) s JOIN canon ON s.canal = canon.v)"""
_CANON_TRIM = _CANON.replace("canal AS v", "trim(canal) AS v")


@query("prp-15", f"WITH {SQL_SUCIAS}, {_CANON_TRIM}, {_CLEAN} SELECT folio, fecha, canal, importe, costo, cantidad, estado, estatus, sku FROM limpia")
def prp_15(spark, sf):
    return auto_clean(ventas_sucias(spark, sf), as_of=AS_OF).table.select("folio", "fecha", "canal", "importe", "costo", "cantidad", "estado", "estatus", "sku")
