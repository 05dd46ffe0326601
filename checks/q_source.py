"""Readers and writers. The text files are written by Spark from the given tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import SQL_SUCIAS, table, ventas_sucias
from tabulario.operators import intake as I
from tabulario.operators import profile as P
from tabulario.operators import repair as R
from tabulario.sources import delimited as D
from tabulario.sources import sinks as S


#: What differs from file to file; file p holds the orders whose key leaves p when divided by four.
_SEPARATORS, _CHARSETS = [";", "|", ",", "\t"], ["UTF-8", "ISO-8859-1"]
_P = "o_orderkey % 4"
#: Orders in a text file, about; one task writes a file and sorts its lines, so more orders make more files, not longer ones.
_FILE_ORDERS = 400_000


def _files(spark, sf):
    """The orders as text files of four kinds, each with its own separator, encoding and number of title lines; some notes hold a line break."""
    path = f"{S.scratch(spark)}/csv"
    orders = table(spark, sf, "orders")
    shares = max(1, -(-orders.count() // (4 * _FILE_ORDERS)))  # files of a kind
    df = orders.withColumn("p", F.expr(_P).cast("int")).withColumn(
        "f", (F.col("p") * shares + F.pmod(F.xxhash64("o_orderkey"), F.lit(shares))).cast("int"))
    sep = F.element_at(F.array(*map(F.lit, _SEPARATORS)), F.col("p") + 1)
    note = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit('"uno\n'), F.col("o_orderkey").cast("string"), F.lit('"'))).otherwise(F.lit("dos"))
    fields = [F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "dd/MM/yyyy"), F.concat(F.lit("Región "), F.col("o_orderstatus")),
              F.translate(F.format_number("o_totalprice", 2), ",", ""), note]
    join = lambda parts: F.concat(*[x for i, part in enumerate(parts) for x in ([sep] if i else []) + [part]])
    body = df.select("p", "f", F.lit(9).alias("k"), F.col("o_orderkey").alias("o"), join(fields).alias("line"))
    parts = df.select("p", "f").distinct()
    title = join([F.lit(x) for x in ("Folio", "Fecha", "Región", "Monto", "Nota")])
    heads = parts.select("p", "f", F.explode(F.concat(
        F.transform(F.sequence(F.lit(0), F.col("p")), lambda i: F.struct(i.alias("k"), F.when(i < F.col("p"), "Reporte").otherwise("").alias("line"))),
        F.array(F.struct(F.lit(8).alias("k"), title.alias("line"))))).alias("h")).select("p", "f", "h.k", F.lit(0).cast("long").alias("o"), "h.line")
    lines = body.unionByName(heads).select("p", "f", "k", "o", F.posexplode(F.split("line", "\n")).alias("i", "line"))
    whole = lines.repartitionById(4 * shares, F.col("f")).sortWithinPartitions("p", "k", "o", "i")
    for i, charset in enumerate(_CHARSETS):
        # one directory per file, so that each starts with its own titles
        # one field without quotes is a line as it stands, and only this writer knows other encodings
        plain = {"encoding": charset, "sep": "\u0001", "quote": "", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
        whole.where(F.col("p") % 2 == i).select("p", F.col("line").alias("value")).write.mode("append").options(**plain).partitionBy("p").csv(path)
    return path + "/*"


def _text(spark, path):
    return D.records(spark, path, D.materialize(D.splits(spark, path)))


def _number(file="file"):
    # the files of a kind are alike, so `distinct` leaves a row per kind; one that was read otherwise would add a row
    return F.regexp_extract(file, "p=([0-9])", 1).cast("int").alias("p")


@query("src-01", "SELECT CAST(o_orderkey AS VARCHAR) AS \"Folio\", strftime(o_orderdate, '%d/%m/%Y') AS \"Fecha\", concat('Región ', o_orderstatus) AS \"Región\", format('{:.2f}', o_totalprice) AS \"Monto\", CASE WHEN o_orderkey % 7 = 0 THEN concat('uno', chr(10), o_orderkey) ELSE 'dos' END AS \"Nota\" FROM orders")
def src_01(spark, sf):
    return D.read_delimited(spark, _files(spark, sf)).table


@query("src-02", f"SELECT CAST({_P} AS INTEGER) AS p, [';', '|', ',', chr(9)][CAST({_P} AS INTEGER) + 1] AS separator, COUNT(*) > 0 AS hay FROM orders GROUP BY 1, 2")
def src_02(spark, sf):
    return D.separators(_text(spark, _files(spark, sf))).select(_number(), "separator", (F.col("score") > 0).alias("hay")).distinct()


@query("src-03", f"SELECT CAST({_P} AS INTEGER) AS p, CAST({_P} AS INTEGER) AS header, 5 * 1.5e0 + COUNT(DISTINCT c) * 0.5e0 AS score FROM orders, (VALUES ('Folio'), ('Fecha'), ('Región'), ('Monto'), ('Nota')) v(c) GROUP BY 1, 2")
def src_03(spark, sf):
    text = _text(spark, _files(spark, sf))
    found = D.header_rows(text, D.separators(text).select("file", "separator"))
    return found.select(_number(), "header", "score").distinct()


@query("src-04", f"SELECT CAST({_P} AS INTEGER) AS p, CASE WHEN {_P} % 2 = 0 THEN 'utf-8' ELSE 'cp1252' END AS encoding, COUNT(*) AS n FROM orders GROUP BY 1, 2")
def src_04(spark, sf):
    path = _files(spark, sf)
    loaded = D.read_delimited(spark, path)
    rows_of = table(spark, sf, "orders").groupBy(F.expr(_P).cast("int").alias("p")).agg(F.count("*").alias("n"))
    return loaded.files.select(_number(), "encoding").distinct().join(rows_of, "p")


query("src-06", "WITH v AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS a, CASE WHEN o_orderkey % 25 = 0 THEN NULL ELSE o_orderstatus END AS b FROM orders) SELECT COUNT(*) AS n, COUNT(a) AS a, COUNT(b) AS b FROM v WHERE a IS NOT NULL OR b IS NOT NULL")(
    lambda spark, sf: R.drop_empty_rows(table(spark, sf, "orders").selectExpr(
        "CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS a", "CASE WHEN o_orderkey % 25 = 0 THEN NULL ELSE o_orderstatus END AS b"
    )).agg(F.count("*").alias("n"), F.count("a").alias("a"), F.count("b").alias("b")))

query("src-07", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_shipdate FROM lineitem")(
    lambda spark, sf: I.intake(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")))


@query("snk-01", f"WITH {SQL_SUCIAS} SELECT CAST(folio AS VARCHAR) AS folio, vendedor, CAST(cantidad AS VARCHAR) AS cantidad, 'utf-8' AS codificacion FROM ventas_sucias")
def snk_01(spark, sf):
    path = f"{S.scratch(spark)}/clean"
    S.write_csv(ventas_sucias(spark, sf).select("folio", "vendedor", "cantidad"), path)
    loaded = D.read_delimited(spark, path)
    return loaded.table.withColumn("codificacion", F.lit(loaded.encoding))


@query("snk-02", f"WITH {SQL_SUCIAS} SELECT 'datos' AS tabla, COUNT(*) AS n FROM ventas_sucias UNION ALL SELECT 'perfil', 15 FROM (SELECT COUNT(*) FROM ventas_sucias)")
def snk_02(spark, sf):
    path, df = S.scratch(spark), ventas_sucias(spark, sf)
    S.save_bundle({"datos": df, "perfil": P.profiles_frame(df, P.profile(df, stats=False))}, path)
    back = S.load_bundle(spark, path, ["datos", "perfil"])
    return back["datos"].agg(F.lit("datos").alias("tabla"), F.count("*").alias("n")).unionByName(
        back["perfil"].agg(F.lit("perfil").alias("tabla"), F.count("*").alias("n")))


query("snk-03", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1200")(
    lambda spark, sf: S.preview(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 1200, "o_orderkey")[0])
