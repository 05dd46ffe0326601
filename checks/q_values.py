"""Scalar functions, value counts, profiling."""
from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, r, rs
from checks.views import SQL_DEMO, SQL_ESTADOS, SQL_SUCIAS, estados, table, ventas_demo, ventas_sucias
from tabulario.functions import dates, numbers, text
from tabulario.operators import intake as I
from tabulario.operators import choices as C
from tabulario.operators import profile as P
from tabulario.operators import quality as QL
from tabulario.operators import values as V
from tabulario.session import held

# amounts written in the ways people write them
_AMOUNTS = """
SELECT o_orderkey AS folio, CASE o_orderkey % 12
  WHEN 0 THEN concat('$ ', {f}) WHEN 1 THEN concat('(', {f}, ')')
  WHEN 2 THEN replace(replace(replace({f}, ',', '#'), '.', ','), '#', '.')
  WHEN 3 THEN replace(CAST(o_orderkey % 97 AS VARCHAR(9)) || '.25', '.', ',')
  WHEN 4 THEN concat(CAST(o_orderkey % 900 + 100 AS VARCHAR(9)), ',', CAST(o_orderkey % 900 + 100 AS VARCHAR(9)))
  WHEN 5 THEN concat(CAST(o_orderkey % 100 AS VARCHAR(9)), ' %') WHEN 6 THEN 'N/A'
  WHEN 7 THEN concat('MXN ', {f}) WHEN 8 THEN concat(CAST(o_orderkey AS VARCHAR(9)), ' pesos')
  WHEN 9 THEN 'pendiente' WHEN 10 THEN concat('-', {f}) ELSE '' END AS texto
FROM {t}
"""
_WORDS = r"(?i)[$€£¥₡₱]|\b(?:mxn|usd|eur|pesos?|dlls?|dolares?)\b"
_SQL_NUMBER = f"""
stripped AS (SELECT *, regexp_replace(trim(texto), '^[()]+|[()]+$', '', 'g') AS s FROM textos),
bodied AS (SELECT *, regexp_replace(regexp_replace(s, '{_WORDS}', '', 'g'), '[% ]', '', 'g') AS b FROM stripped),
pointed AS (SELECT *, CASE
   WHEN contains(b, ',') AND contains(b, '.') THEN
     CASE WHEN strpos(reverse(b), '.') < strpos(reverse(b), ',') THEN replace(b, ',', '') ELSE replace(replace(b, '.', ''), ',', '.') END
   WHEN contains(b, ',') THEN CASE WHEN length(split_part(b, ',', -1)) = 3 AND split_part(b, ',', 1) <> '' THEN replace(b, ',', '') ELSE replace(b, ',', '.') END
   ELSE b END AS p FROM bodied),
numeros AS (SELECT *, CASE WHEN lower(trim(texto)) IN ('', 'na', 'n/a', 'nan', 'null', 'none', '-', '--', 's/d', 'nd') THEN NULL
   ELSE TRY_CAST(p AS DOUBLE) * CASE WHEN trim(texto) LIKE '(%)' THEN -1e0 ELSE 1e0 END END AS numero FROM pointed)
"""


@query("scl-01", "WITH textos AS (" + _AMOUNTS.format(f="format('{:,.2f}', o_totalprice)", t="orders") + f"), {_SQL_NUMBER}"
       + " SELECT folio, texto, numero FROM numeros")
def scl_01(spark, sf):
    texts = spark.sql(_AMOUNTS.format(f="format_number(o_totalprice, 2)", t="{t}"), t=table(spark, sf, "orders"))
    return texts.withColumn("numero", numbers.to_number(F.col("texto")))


_STAMPS = """
SELECT o_orderkey AS folio, CASE o_orderkey % 7
  WHEN 0 THEN {iso} WHEN 1 THEN concat({iso}, ' 10:20:30') WHEN 2 THEN {dmy} WHEN 3 THEN {mdy}
  WHEN 4 THEN replace({dmy}, '/', '-') WHEN 5 THEN replace({dmy}, '/', '.') ELSE 'sin fecha' END AS texto
FROM {t}
"""


@query("scl-02", "WITH t AS (" + _STAMPS.format(iso="strftime(o_orderdate,'%Y-%m-%d')", dmy="strftime(o_orderdate,'%d/%m/%Y')",
                                               mdy="strftime(o_orderdate,'%m/%d/%Y')", t="orders") + """)
SELECT folio, texto, COALESCE(try_strptime(texto, '%Y-%m-%d %H:%M:%S'), try_strptime(texto, '%Y-%m-%d'),
  try_strptime(texto, '%d/%m/%Y'), try_strptime(texto, '%d-%m-%Y'), try_strptime(texto, '%d.%m.%Y'),
  try_strptime(texto, '%m/%d/%Y'), try_strptime(texto, '%m-%d-%Y')) AS instante FROM t""")
def scl_02(spark, sf):
    sql = _STAMPS.format(iso="date_format(o_orderdate,'yyyy-MM-dd')", dmy="date_format(o_orderdate,'dd/MM/yyyy')",
                         mdy="date_format(o_orderdate,'MM/dd/yyyy')", t="{t}")
    return spark.sql(sql, t=table(spark, sf, "orders")).withColumn("instante", dates.to_datetime(F.col("texto")))


_MARKS = "Ã¡|Ã©|Ã­|Ã³|Ãº|Ã±|Ã‘|Â¿|Â°|â€™|â€œ|ï¿½"


@query("scl-03", f"WITH {SQL_SUCIAS} SELECT vendedor, regexp_matches(vendedor, '{_MARKS}') AS roto, COUNT(*) AS n FROM ventas_sucias GROUP BY ALL")
def scl_03(spark, sf):
    df = ventas_sucias(spark, sf)
    return df.groupBy("vendedor", text.has_mojibake(F.col("vendedor")).alias("roto")).agg(F.count("*").alias("n"))


#: What the broken texts of the view become; every other text stays.
_REPAIRED = "CASE vendedor WHEN 'MarÃ­a Solís' THEN 'María Solís' ELSE vendedor END"


@query("scl-04", f"WITH {SQL_SUCIAS} SELECT vendedor, {_REPAIRED} AS reparado, COUNT(*) AS n FROM ventas_sucias GROUP BY ALL")
def scl_04(spark, sf):
    df = ventas_sucias(spark, sf)
    return df.groupBy("vendedor", text.fix_mojibake(F.col("vendedor")).alias("reparado")).agg(F.count("*").alias("n"))


@query("scl-05", f"WITH {SQL_ESTADOS} SELECT estado, strip_accents(estado) AS plano, COUNT(*) AS n FROM estados GROUP BY ALL")
def scl_05(spark, sf):
    df = estados(spark, sf)
    return df.groupBy("estado", text.strip_accents(F.col("estado")).alias("plano")).agg(F.count("*").alias("n"))


@query("scl-06", f"""WITH {SQL_SUCIAS} SELECT regexp_replace(trim(lower(strip_accents(canal))), '\\s+', ' ', 'g') AS clave,
COUNT(DISTINCT canal) AS grafias, COUNT(*) AS n FROM ventas_sucias GROUP BY ALL""")
def scl_06(spark, sf):
    return ventas_sucias(spark, sf).groupBy(text.norm_key(F.col("canal")).alias("clave")).agg(
        F.count_distinct("canal").alias("grafias"), F.count("*").alias("n"))


@query("scl-07", f"""WITH {SQL_ESTADOS} SELECT estado,
trim(regexp_replace(lower(strip_accents(estado)), '[^a-z0-9_]+', '_', 'g'), '_') AS slug, COUNT(*) AS n FROM estados GROUP BY ALL""")
def scl_07(spark, sf):
    return estados(spark, sf).groupBy("estado", text.slug(F.col("estado")).alias("slug")).agg(F.count("*").alias("n"))


@query("scl-08", "SELECT doc_id, md5(regexp_replace(trim(text, ' \n\t\r'), '\\s+', ' ', 'g')) AS huella FROM documents")
def scl_08(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.collapse_spaces(F.col("text"))).alias("huella"))


@query("scl-09", f"""WITH {SQL_DEMO} SELECT folio, CASE WHEN folio % 5 = 0 THEN NULL ELSE importe / CAST(folio % 5 AS DOUBLE) END AS cociente FROM ventas_demo""")
def scl_09(spark, sf):
    return ventas_demo(spark, sf).select("folio", numbers.safe_div(F.col("importe"), F.col("folio") % 5).alias("cociente"))


_HUMAN = """CASE WHEN x IS NULL THEN '—' ELSE concat(CASE WHEN x < 0 THEN '-' ELSE '' END, CASE
 WHEN abs(x) >= 1e9 THEN concat(format('{:,.2f}', abs(x)/1e9), 'B') WHEN abs(x) >= 1e6 THEN concat(format('{:,.2f}', abs(x)/1e6), 'M')
 WHEN abs(x) >= 1e4 THEN concat(format('{:,.1f}', abs(x)/1e3), 'K') WHEN abs(x) >= 1 THEN format('{:,.2f}', abs(x))
 WHEN x = 0 THEN '0' ELSE format('{:,.4f}', abs(x)) END) END"""
_VALUES10 = "CASE folio % 5 WHEN 0 THEN importe * 1000e0 WHEN 1 THEN importe WHEN 2 THEN -importe / 1000e0 WHEN 3 THEN CAST(folio % 2 AS DOUBLE) ELSE importe * 1e6 END"


@query("scl-10", f"""WITH {SQL_DEMO}, v AS (SELECT folio, {_VALUES10} AS x FROM ventas_demo)
SELECT folio, {_HUMAN} AS texto, concat(format('{{:,.1f}}', x * 100), '%') AS pct, concat('$', {_HUMAN}) AS moneda FROM v""")
def scl_10(spark, sf):
    v = ventas_demo(spark, sf).select("folio", F.expr(_VALUES10).alias("x"))
    return v.select("folio", numbers.human(F.col("x")).alias("texto"), numbers.percent(F.col("x")).alias("pct"),
                    numbers.display(F.col("x"), F.lit("moneda")).alias("moneda"))


@query("scl-11", f"""WITH {SQL_SUCIAS} SELECT COALESCE(regexp_replace(CAST(cantidad AS VARCHAR), '^(-*\\d+)\\.0$', '\\1'), '(sin dato)') AS cantidad,
COALESCE(estado, '(sin dato)') AS estado, COUNT(*) AS n FROM ventas_sucias GROUP BY ALL""")
def scl_11(spark, sf):
    return ventas_sucias(spark, sf).groupBy(
        text.label(F.col("cantidad")).alias("cantidad"), text.label(F.col("estado")).alias("estado")
    ).agg(F.count("*").alias("n"))


@query("scl-12", rf"""WITH {SQL_SUCIAS} SELECT correo, regexp_matches(correo, '^[^@\s]+@[^@\s]+\.[a-zA-Z]{{2,}}$') AS es_correo,
regexp_matches(CAST(1000000 + sku AS VARCHAR), '^[\d\s\-+().]{{7,20}}$') AS es_telefono FROM ventas_sucias""")
def scl_12(spark, sf):
    df = ventas_sucias(spark, sf)
    return df.select("correo", text.is_email(F.col("correo")).alias("es_correo"),
                     text.is_phone((F.col("sku") + 1000000).cast("string")).alias("es_telefono"))


@query("scl-13", f"""WITH {SQL_SUCIAS} SELECT length(CAST(abs(sku) AS VARCHAR)) AS largo_sku, length(CAST(CAST(trunc(abs(cantidad)) AS BIGINT) AS VARCHAR)) AS largo_cantidad,
length(translate(trim(importe), '- ,', '')) AS largo_importe, COUNT(*) AS n FROM ventas_sucias GROUP BY ALL""")
def scl_13(spark, sf):
    return ventas_sucias(spark, sf).groupBy(
        text.shape_length(F.col("sku"), numeric=True).alias("largo_sku"),
        text.shape_length(F.floor(F.abs(F.col("cantidad"))), numeric=True).alias("largo_cantidad"),
        text.shape_length(F.col("importe")).alias("largo_importe"),
    ).agg(F.count("*").alias("n"))


@query("scl-14", f"""WITH {SQL_DEMO}, c AS (SELECT folio AS brandId, folio AS pedido, importe * 1e0 AS importe,
   CAST(7500000000000 + folio AS BIGINT) AS barra, cantidad FROM ventas_demo)
SELECT 'barra' AS "column", bool_and(barra % 1 = 0) AND median(abs(barra)) >= 1e10 AS codigo FROM c
UNION ALL SELECT 'brandId', true FROM (SELECT COUNT(*) FROM c)
UNION ALL SELECT 'cantidad', bool_and(cantidad % 1 = 0) AND median(abs(cantidad)) >= 1e10 FROM c
UNION ALL SELECT 'importe', bool_and(importe % 1 = 0) AND median(abs(importe)) >= 1e10 FROM c
UNION ALL SELECT 'pedido', bool_and(pedido % 1 = 0) AND median(abs(pedido)) >= 1e10 FROM c""")
def scl_14(spark, sf):
    df = ventas_demo(spark, sf).select(
        F.col("folio").alias("brandId"), F.col("folio").alias("pedido"), "importe",
        (F.col("folio") + F.lit(7500000000000)).alias("barra"), "cantidad")
    found = P.profile(df)
    return I.rows(spark, [(c, P.looks_like_code(found[c])) for c in sorted(df.columns)], "column string, codigo boolean")


_MONTHS = "['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre']"
_DAYS = "['lunes','martes','miércoles','jueves','viernes','sábado','domingo']"


@query("scl-15", f"""WITH {SQL_DEMO}, d AS (SELECT DISTINCT CAST(fecha AS DATE) AS dia FROM ventas_demo)
SELECT dia, CAST(year(dia) AS INTEGER) AS anio, CAST(month(dia) AS INTEGER) AS mes, CAST(isodow(dia) - 1 AS INTEGER) AS dia_semana,
 CAST(quarter(dia) AS INTEGER) AS trimestre,
 concat(day(dia), ' de ', {_MONTHS}[month(dia)], ' de ', year(dia), ' (', {_DAYS}[isodow(dia)], ')') AS etq_dia,
 concat('la semana del ', day(dia), ' de ', {_MONTHS}[month(dia)], ' de ', year(dia)) AS etq_semana,
 concat({_MONTHS}[month(dia)], ' de ', year(dia)) AS etq_mes,
 concat('el trimestre ', quarter(dia), ' de ', year(dia)) AS etq_trimestre FROM d""")
def scl_15(spark, sf):
    d = ventas_demo(spark, sf).select(F.col("fecha").cast("date").alias("dia")).distinct()
    c = F.col("dia")
    return d.select(
        "dia", F.year(c).alias("anio"), F.month(c).alias("mes"), F.weekday(c).alias("dia_semana"), F.quarter(c).alias("trimestre"),
        *[dates.period_label(c, u).alias(n) for u, n in (("D", "etq_dia"), ("W", "etq_semana"), ("M", "etq_mes"), ("Q", "etq_trimestre"))])


@query("scl-16", f"""WITH {SQL_ESTADOS} SELECT estado, trim(regexp_replace(regexp_replace(lower(strip_accents(estado)), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS plano,
COUNT(*) AS n FROM estados GROUP BY ALL""")
def scl_16(spark, sf):
    return estados(spark, sf).groupBy("estado", text.plain_place(F.col("estado")).alias("plano")).agg(F.count("*").alias("n"))


@query("scl-17", f"""WITH {SQL_DEMO} SELECT {rs('sqrt(sum(importe))')} AS raiz, {rs('abs(sum(costo) - sum(importe))')} AS absoluto,
{rs('sum(importe) / sum(costo)', 6)} AS cociente, {rs('power(avg(cantidad), 2)', 6)} AS potencia, CAST(COUNT(*) AS DOUBLE) % 7 AS resto FROM ventas_demo""")
def scl_17(spark, sf):
    from tabulario.operators.kpi import abs_, conteo, promedio, raiz, suma
    kpis = {"raiz": raiz(suma("importe")), "absoluto": abs_(suma("costo") - suma("importe")),
            "cociente": suma("importe") / suma("costo"), "potencia": promedio("cantidad") ** 2, "resto": conteo() % 7}
    from tabulario.operators.kpi import evaluate
    one = evaluate(ventas_demo(spark, sf), kpis)
    return one.select(r("raiz").alias("raiz"), r("absoluto").alias("absoluto"), r("cociente", 6).alias("cociente"),
                      r("potencia", 6).alias("potencia"), "resto")


@query("scl-18", f"""WITH {SQL_SUCIAS}, t AS (SELECT folio, sku FROM ventas_sucias WHERE sku = 1) SELECT folio, concat('M', CAST(folio + 2 AS VARCHAR)) AS celda FROM t""")
def scl_18(spark, sf):
    df = ventas_sucias(spark, sf)
    position = df.columns.index("sku")
    return df.where("sku = 1").select("folio", QL.cell_reference(position, F.col("folio")).alias("celda"))


# --- value counts and profiles -----------------------------------------------------------


@query("agg-06", f"""WITH {SQL_SUCIAS}, t AS (SELECT COALESCE(estado, 'nan') AS value, COUNT(*) AS n FROM ventas_sucias GROUP BY ALL)
SELECT value, n, {rs('n / SUM(n) OVER ()', 6)} AS share FROM t""")
def agg_06(spark, sf):
    return V.shares(ventas_sucias(spark, sf), "estado", missing="nan").select("value", "n", r("share", 6).alias("share"))


_TEXT = ["cliente", "canal", "estado", "vendedor", "estatus"]
_COUNTS = "counts AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c} AS value, COUNT(*) AS n FROM ventas_sucias WHERE {c} IS NOT NULL GROUP BY 2" for c in _TEXT) + ")"


@query("agg-07", f"""WITH {SQL_SUCIAS}, {_COUNTS}, k AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS p FROM counts)
SELECT "column", value AS moda, n AS freq_moda FROM k WHERE p = 1""")
def agg_07(spark, sf):
    return V.mode(V.value_counts(ventas_sucias(spark, sf), _TEXT))


@query("top-02", f"""WITH {SQL_SUCIAS}, {_COUNTS}, k AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS position FROM counts)
SELECT "column", value, n, CAST(position AS INTEGER) AS position FROM k WHERE position <= 15""")
def top_02(spark, sf):
    return V.top_values(V.value_counts(ventas_sucias(spark, sf), _TEXT), 15)


@query("top-03", f"""WITH {SQL_SUCIAS}, v AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", folio, {c} AS value FROM ventas_sucias WHERE {c} IS NOT NULL" for c in _TEXT) + """),
k AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY folio, value) AS position FROM v)
SELECT "column", CAST(position AS INTEGER) AS position, value FROM k WHERE position <= 5""")
def top_03(spark, sf):
    return V.first_values(ventas_sucias(spark, sf), "folio", _TEXT)


_ALL = ["folio", "cliente", "fecha", "canal", "importe", "costo", "cantidad", "estado", "vendedor", "estatus", "zona", "comentario", "sku", "correo", "lote"]


def _each(select: str, columns: list[str]) -> str:
    return " UNION ALL ".join(select.replace("{c}", c) for c in columns)


@query("prf-01", f"WITH {SQL_SUCIAS} " + _each(
    f"""SELECT '{{c}}' AS "column", COUNT(*) AS n, COUNT(*) - COUNT({{c}}) AS n_missing, {rs('(COUNT(*) - COUNT({c})) / COUNT(*)', 6)} AS pct_missing,
COUNT(DISTINCT {{c}}) AS n_unique, {rs('COUNT(DISTINCT {c}) / greatest(COUNT({c}), 1)', 6)} AS unique_ratio FROM ventas_sucias""", _ALL))
def prf_01(spark, sf):
    df = ventas_sucias(spark, sf)
    return P.profiles_frame(df, P.profile(df, stats=False)).select(
        "column", "n", "n_missing", r("pct_missing", 6).alias("pct_missing"), "n_unique", r("unique_ratio", 6).alias("unique_ratio"))


_RATIO = ["fecha", "canal", "importe", "lote", "correo"]


@query("prf-02", f"WITH {SQL_SUCIAS}, textos AS (" + _each("""SELECT '{c}' AS "column", {c} AS texto FROM ventas_sucias WHERE {c} IS NOT NULL""", _RATIO)
       + f"), {_SQL_NUMBER}" + f"""SELECT "column", {rs('COUNT(numero) / COUNT(*)', 6)} AS convertible_numeric,
{rs("COUNT(COALESCE(try_strptime(texto,'%d/%m/%Y'), try_strptime(texto,'%m/%d/%Y'))) / COUNT(*)", 6)} AS convertible_datetime FROM numeros GROUP BY ALL""")
def prf_02(spark, sf):
    df = ventas_sucias(spark, sf).select(*_RATIO)
    return P.profiles_frame(df, P.profile(df, stats=False)).select(
        "column", r("convertible_numeric", 6).alias("convertible_numeric"), r("convertible_datetime", 6).alias("convertible_datetime"))


_KINDS = {
    "folio": ("numerico", "identificador"), "cliente": ("categorico", "persona"), "fecha": ("fecha", "fecha"),
    "canal": ("categorico", None), "importe": ("numerico", "monetario"), "costo": ("numerico", "monetario"),
    "cantidad": ("numerico", "cantidad"), "estado": ("categorico", "geografia"), "vendedor": ("categorico", "persona"),
    "estatus": ("categorico", None), "zona": ("constante", "geografia"), "comentario": ("vacia", None),
    "sku": ("numerico", "identificador"), "correo": ("categorico", "contacto"), "lote": ("categorico", None),
}
# the decision tree in SQL: types are physical facts of the view, the rest is measured
_TYPED = {"folio": "n", "costo": "n", "cantidad": "n", "sku": "n"}
_ROLE = {c: f"'{k[1]}'" if k[1] else "NULL" for c, k in _KINDS.items()}


@query("prf-03", f"WITH {SQL_SUCIAS}, textos AS (" + _each("""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS texto FROM ventas_sucias""", _ALL)
       + f"), {_SQL_NUMBER}, hechos AS (" + """SELECT "column", COUNT(texto) AS n, COUNT(DISTINCT texto) AS u, COUNT(numero) / greatest(COUNT(texto), 1) AS num,
 COUNT(COALESCE(try_strptime(texto,'%d/%m/%Y'), try_strptime(texto,'%m/%d/%Y'))) / greatest(COUNT(texto), 1) AS fec, avg(length(texto)) AS largo,
 bool_and(numero % 1 = 0) AS enteros,
 COUNT(DISTINCT texto) FILTER (WHERE regexp_replace(trim(lower(strip_accents(texto))), '\\s+', ' ', 'g') IN ('si','no','s','n','true','false','verdadero','falso','yes','1','0','activo','inactivo','vigente','cancelado')) AS logicos
 FROM numeros GROUP BY ALL), base AS (SELECT *, """
       + "CASE \"column\" " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in _ROLE.items()) + " END AS rol, \"column\" IN ('folio','costo','cantidad','sku') AS es_numero FROM hechos)"
       + """ SELECT "column", CASE WHEN n = 0 THEN 'vacia' WHEN u = 1 THEN 'constante'
 WHEN es_numero THEN CASE WHEN u / n > 0.95 AND enteros AND rol = 'identificador' THEN 'identificador' ELSE 'numerico' END
 WHEN u <= 2 AND logicos = u THEN 'booleano' WHEN fec >= 0.85 AND fec > num THEN 'fecha' WHEN num >= 0.85 THEN 'numerico'
 WHEN u / n > 0.95 AND n > 20 THEN 'identificador' WHEN largo > 40 AND u / n > 0.5 THEN 'texto' ELSE 'categorico' END AS semantic,
 CASE WHEN rol IS NULL AND NOT es_numero AND u / n > 0.95 AND n > 20 AND NOT (fec >= 0.85 AND fec > num) AND num < 0.85 THEN 'identificador' ELSE rol END AS role FROM base""")
def prf_03(spark, sf):
    df = ventas_sucias(spark, sf)
    return P.profiles_frame(df, P.profile(df)).select("column", "semantic", "role")


_NUMERIC_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {rs(f'min({c})')} AS min, {rs(f'max({c})')} AS max, {rs(f'avg({c})')} AS mean, {rs(f'median({c})')} AS median,
{rs(f'stddev_samp({c})')} AS std, {rs(f'quantile_cont({c}, 0.25)')} AS q1, {rs(f'quantile_cont({c}, 0.75)')} AS q3,
{rs(f'skewness({c})', 4)} AS skew, CAST(COUNT(*) FILTER (WHERE {c} = 0) AS DOUBLE) AS zeros, CAST(COUNT(*) FILTER (WHERE {c} < 0) AS DOUBLE) AS negatives FROM ventas_demo"""
    for c in ("cantidad", "importe", "costo"))


def _numeric(spark, sf):
    df = ventas_demo(spark, sf)
    s = P.numeric_statistics(df, P.profile(df.select("cantidad", "importe", "costo")))
    return s.select("column", *[r(c).alias(c) for c in ("min", "max", "mean", "median", "std", "q1", "q3")],
                    r("skew", 4).alias("skew"), "zeros", "negatives")


query("prf-04", f"WITH {SQL_DEMO} {_NUMERIC_SQL}")(_numeric)


@query("agg-08", f"WITH {SQL_DEMO} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {rs(f'skewness({c})', 4)} AS skew FROM ventas_demo""" for c in ("importe", "costo", "cantidad")))
def agg_08(spark, sf):
    df = ventas_demo(spark, sf).select("importe", "costo", "cantidad")
    found = P.numeric_summary(df, df.columns)
    return I.rows(spark, [(c, found[c]["skew"]) for c in df.columns], "column string, skew double").select("column", r("skew", 4).alias("skew"))


@query("prf-05", f"""WITH {SQL_DEMO} SELECT 'fecha' AS "column", min(fecha) AS min, max(fecha) AS max, CAST(date_diff('day', min(fecha), max(fecha)) AS INTEGER) AS rango_dias FROM ventas_demo
UNION ALL SELECT 'l_shipdate', min(l_shipdate), max(l_shipdate), CAST(date_diff('day', min(l_shipdate), max(l_shipdate)) AS INTEGER) FROM lineitem""")
def prf_05(spark, sf):
    demo, items = ventas_demo(spark, sf).select("fecha"), table(spark, sf, "lineitem").select("l_shipdate")
    return P.date_statistics(demo, P.profile(demo)).unionByName(P.date_statistics(items, P.profile(items)))


@query("prf-06", f"""WITH {SQL_SUCIAS}, {_COUNTS}, k AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS p FROM counts)
SELECT "column", max(value) FILTER (WHERE p = 1) AS moda, max(n) AS freq_moda, string_agg(concat(value, '=', n), '|' ORDER BY p) FILTER (WHERE p <= 15) AS top FROM k GROUP BY ALL""")
def prf_06(spark, sf):
    full = P.full_profile(ventas_sucias(spark, sf).select("folio", *_TEXT), "folio").where("column <> 'folio'")
    top = F.array_join(F.transform("top_values", lambda x: F.concat(x["value"], F.lit("="), x["count"].cast("string"))), "|")
    return full.select("column", "moda", "freq_moda", top.alias("top"))


@query("prf-07", f"WITH {SQL_DEMO} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS columna, '{t}' AS tipo, {ro} AS rol, COUNT(*) - COUNT({c}) AS nulos, round_even(100e0 * (COUNT(*) - COUNT({c})) / COUNT(*), 1) AS pct_nulos,
COUNT(DISTINCT {c}) AS unicos, CAST(arg_min({c}, folio) AS VARCHAR) AS ejemplo FROM ventas_demo"""
    for c, t, ro in (("segmento", "categorico", "'—'"), ("estado", "categorico", "'geografia'"), ("producto", "categorico", "'—'"),
                     ("estatus", "categorico", "'—'"), ("importe", "numerico", "'monetario'"), ("cantidad", "numerico", "'cantidad'"))))
def prf_07(spark, sf):
    df = ventas_demo(spark, sf).select("folio", "segmento", "estado", "producto", "estatus", "importe", "cantidad")
    return P.profile_table(df, P.profile(df, stats=False), "folio").where("columna <> 'folio'").drop("dtype")


@query("prf-08", f"""WITH {SQL_SUCIAS}, d AS (SELECT COUNT(*) AS c FROM ventas_sucias GROUP BY {', '.join(_ALL)}),
v AS (SELECT {' + '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c in _ALL)} AS e FROM ventas_sucias)
SELECT COUNT(*) AS filas, CAST(15 AS BIGINT) AS columnas, CAST(SUM(e) AS BIGINT) AS celdas_vacias, {rs('SUM(e) / (COUNT(*) * 15)', 6)} AS pct_vacias,
(SELECT CAST(SUM(c - 1) AS BIGINT) FROM d) AS filas_duplicadas FROM v""")
def prf_08(spark, sf):
    with held(ventas_sucias(spark, sf)) as df:
        return P.overview(df, P.profile(df, stats=False)).select("filas", "columnas", "celdas_vacias", r("pct_vacias", 6).alias("pct_vacias"), "filas_duplicadas")


# --- choices from profiles ---------------------------------------------------------------


def _list(spark, pairs):
    return I.rows(spark, [(i, c) for i, c in enumerate(pairs)], "position int, column string")


def _names(*names: str, source: str = "ventas_demo") -> str:
    """SQL that lists columns whose measured facts put them there."""
    return " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS \"column\" FROM (SELECT COUNT(*) FROM {source})"
                              for i, c in enumerate(names))


@query("prj-03", f"""WITH {SQL_SUCIAS}, hechos AS (""" + _each("""SELECT '{c}' AS "column", COUNT(DISTINCT {c}) AS u, COUNT({c}) AS n FROM ventas_sucias""",
       ["cliente", "canal", "estado", "vendedor", "estatus", "zona", "comentario", "correo", "lote"]) +
       """) SELECT "column", 'categorico' AS semantic FROM hechos WHERE u > 1 AND u / n <= 0.95""")
def prj_03(spark, sf):
    df = ventas_sucias(spark, sf)
    return I.rows(spark, [(c, "categorico") for c in C.columns_by(P.profile(df, stats=False), "categorico")], "column string, semantic string")


@query("prj-04", f"WITH {SQL_DEMO}, t AS (SELECT COUNT(*) AS n, COUNT(DISTINCT folio) AS u, max(folio) - min(folio) + 1 AS rango FROM ventas_demo), m AS (" + _names("cantidad", "importe", "costo") + ") SELECT m.* FROM m, t WHERE u / n > 0.99 AND rango <= 1.2 * u")
def prj_04(spark, sf):
    df = ventas_demo(spark, sf)
    return _list(spark, C.metric_columns(P.profile(df)))


@query("prj-05", f"""WITH {SQL_SUCIAS} SELECT CAST(0 AS INTEGER) AS position, 'fecha' AS "column" FROM ventas_sucias
HAVING COUNT(COALESCE(try_strptime(fecha,'%d/%m/%Y'), try_strptime(fecha,'%m/%d/%Y'))) / COUNT(fecha) >= 0.85""")
def prj_05(spark, sf):
    return _list(spark, C.date_columns(P.profile(ventas_sucias(spark, sf), stats=False)))


@query("prj-06", f"""WITH {SQL_SUCIAS}, hechos AS (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {i} AS orden, COUNT(DISTINCT {c}) AS u FROM ventas_sucias""" for i, c in enumerate(_ALL) if _KINDS[c][0] == "categorico") + """)
SELECT CAST(row_number() OVER (ORDER BY u, orden) - 1 AS INTEGER) AS position, "column" FROM hechos WHERE u > 1 AND u <= 60""")
def prj_06(spark, sf):
    return _list(spark, C.dimension_columns(P.profile(ventas_sucias(spark, sf), stats=False)))


@query("prj-07", f"""WITH {SQL_DEMO}, h AS (SELECT COUNT(DISTINCT folio) / COUNT(*) AS clave, COUNT(DISTINCT estatus) AS estatus, COUNT(DISTINCT segmento) AS segmento FROM ventas_demo)
SELECT slot, "column" FROM (VALUES ('fecha','fecha'),('ingreso','importe'),('costo','costo'),('cantidad','cantidad'),('cliente','cliente'),('producto','producto'),
('transaccion','folio'),('segmento','segmento'),('estatus','estatus')) t(slot, "column"), h
WHERE (slot <> 'transaccion' OR clave >= 0.9) AND (slot <> 'estatus' OR estatus <= 10) AND (slot <> 'segmento' OR segmento BETWEEN 2 AND 30)""")
def prj_07(spark, sf):
    mapping = C.suggest_mapping(P.profile(ventas_demo(spark, sf)))
    return I.rows(spark, list(mapping.items()), "slot string, column string")


@query("top-06", f"WITH {SQL_SUCIAS}, h AS (" + _each("""SELECT '{c}' AS "column", (COUNT(*) - COUNT({c})) / COUNT(*) AS p FROM ventas_sucias""", _ALL)
       + f""") SELECT "column", {rs('p * 100', 4)} AS pct FROM h WHERE p > 0 ORDER BY p DESC, "column" LIMIT 20""")
def top_06(spark, sf):
    df = ventas_sucias(spark, sf)
    most = P.profiles_frame(df, P.profile(df, stats=False)).where("pct_missing > 0").orderBy(F.desc("pct_missing"), "column").limit(20)
    return most.select("column", r(F.col("pct_missing") * 100, 4).alias("pct"))
