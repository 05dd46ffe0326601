"""Views over the given tables, written once as Spark frames and once as SQL text.

`ventas_demo` is a clean sales table with trend, season and a few large clients; `ventas_sucias`
is the same table with dirt planted by key arithmetic; `estados` spells states in several ways.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DEMO = """
SELECT o_orderkey AS folio, o_orderdate AS fecha, c_name AS cliente, c_mktsegment AS segmento,
       n_name AS estado, o_orderpriority AS producto,
       CASE o_orderstatus WHEN 'F' THEN 'Pagado' WHEN 'O' THEN 'Pendiente' ELSE 'Cancelado' END AS estatus,
       CAST(1 + o_orderkey % 12 AS DOUBLE) AS cantidad,
       FLOOR(100e0 * o_totalprice
             * (1 + {days} / 1400e0 * 0.35e0)
             * CASE WHEN month(o_orderdate) IN (11,12) THEN 1.7e0 WHEN month(o_orderdate) IN (1,2) THEN 0.8e0 ELSE 1e0 END
             * CASE WHEN c_custkey < 10 THEN 80e0 WHEN c_custkey < 100 THEN 6e0 ELSE 0.5e0 END
             * CASE c_mktsegment WHEN 'BUILDING' THEN 1.3e0 WHEN 'MACHINERY' THEN 0.7e0 ELSE 1e0 END + 0.5e0) / 100e0 AS importe,
       FLOOR(100e0 * o_totalprice * (0.5e0 + (o_orderkey % 17) / 100e0) + 0.5e0) / 100e0 AS costo
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""

_SUCIAS = """
SELECT folio, cliente,
       CASE WHEN folio % 1009 = 0 THEN '31/12/1899' ELSE {fdate} END AS fecha,
       CASE WHEN folio % 20 = 0 THEN concat(lower(segmento), ' ') WHEN folio % 20 = 1 THEN lower(segmento) ELSE segmento END AS canal,
       CASE WHEN folio % 2503 = 0 THEN concat('$ ', {fmt_hi}) ELSE concat('$ ', {fmt}) END AS importe,
       CASE WHEN folio % 14 = 0 THEN NULL ELSE costo END AS costo,
       CASE WHEN folio % 401 = 0 THEN -cantidad WHEN folio % 4999 = 7 THEN 1370e0 WHEN folio % 4999 = 8 THEN 60e0 ELSE cantidad END AS cantidad,
       CASE WHEN folio % 25 = 0 THEN NULL ELSE estado END AS estado,
       CASE folio % 4 WHEN 0 THEN 'MarÃ­a Solís' WHEN 1 THEN 'Ana Ramírez' WHEN 2 THEN 'Luis Ortega' ELSE 'Jorge Pineda' END AS vendedor,
       estatus, 'Bajío' AS zona, CAST(NULL AS VARCHAR(20)) AS comentario,
       CASE WHEN folio % 3001 = 5 THEN 1 ELSE 1000 + folio % 9000 END AS sku,
       CASE WHEN folio % 97 = 0 THEN 'sin correo' ELSE concat('c', CAST(folio AS VARCHAR(20)), '@ejemplo.com') END AS correo,
       CASE WHEN folio % 3 = 0 THEN 'N/D' ELSE CAST(folio % 40 AS VARCHAR(20)) END AS lote
FROM (SELECT * FROM {ventas_demo} UNION ALL SELECT * FROM {ventas_demo} WHERE folio % 53 = 0) t
"""

_ESTADOS = """
SELECT folio, importe,
       CASE folio % 8 WHEN 0 THEN 'CDMX' WHEN 1 THEN 'Distrito Federal' WHEN 2 THEN 'S.L.P.' WHEN 3 THEN 'San Luis Potosí'
            WHEN 4 THEN 'méxico' WHEN 5 THEN 'Estado de México' WHEN 6 THEN 'coahuila de zaragoza' ELSE 'Monterrey' END AS estado
FROM {ventas_demo}
"""

_SPARK = {
    "days": "datediff(o_orderdate, DATE'1995-01-01')",
    "fdate": "date_format(fecha,'dd/MM/yyyy')",
    "fmt": "format_number(importe,2)",
    "fmt_hi": "format_number(importe*100e0,2)",
}
_DUCK = {
    "days": "date_diff('day', TIMESTAMP '1995-01-01', o_orderdate)",
    "fdate": "strftime(fecha,'%d/%m/%Y')",
    "fmt": "format('{:,.2f}', importe)",
    "fmt_hi": "format('{:,.2f}', importe*100e0)",
    "orders": "orders", "customer": "customer", "nation": "nation", "ventas_demo": "ventas_demo",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ventas_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: table(spark, sf_dir, t) for t in ("orders", "customer", "nation")}
    slots = {t: "{" + t + "}" for t in tables}
    return spark.sql(_DEMO.format(**_SPARK, **slots), **tables)


def ventas_sucias(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _SUCIAS.format(**_SPARK, ventas_demo="{ventas_demo}")
    return spark.sql(sql, ventas_demo=ventas_demo(spark, sf_dir))


def estados(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_ESTADOS.format(ventas_demo="{ventas_demo}"), ventas_demo=ventas_demo(spark, sf_dir))


# common table expressions for the SQL side
SQL_DEMO = "ventas_demo AS (" + _DEMO.format(**_DUCK) + ")"
SQL_SUCIAS = SQL_DEMO + ", ventas_sucias AS (" + _SUCIAS.format(**_DUCK) + ")"
SQL_ESTADOS = SQL_DEMO + ", estados AS (" + _ESTADOS.format(**_DUCK) + ")"
