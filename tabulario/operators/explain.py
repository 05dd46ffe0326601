"""Readings of series and rankings, and clues about unusual periods: facts, not causes."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulario.functions import dates
from tabulario.operators import quantiles as Q
from tabulario.operators import series as S
from tabulario.operators.intake import col, instant, number

MAX_UNUSUAL = 3


def median_deviation(df: DataFrame, column: str) -> DataFrame:
    """One row: median and median absolute deviation of a column of any size."""
    typed = df.select(number(df, column).alias("v"))
    (m,) = Q.quantiles(typed, "v", [0.5])
    (mad,) = Q.quantiles(typed.select(F.abs(F.col("v") - F.lit(m)).alias("d")), "d", [0.5])
    return df.sparkSession.createDataFrame([(mad, m)], "mad double, mediana double")


def read_series(series: DataFrame, unit: str) -> DataFrame:
    """One row: best and worst period, mean, and where the series goes (8 % between outer thirds)."""
    one = series.agg(
        F.max_by("period", F.struct("value", -F.unix_date("period"))).alias("best"), F.max("value").alias("best_value"),
        F.min_by("period", F.struct("value", F.unix_date("period"))).alias("worst"), F.min("value").alias("worst_value"),
        F.avg("value").alias("mean"), F.sum("value").alias("total"), F.count(F.lit(1)).alias("periods"))
    change = S.thirds(series).select("change").scalar()
    course = F.when(F.col("change").isNull() | (F.abs("change") < 0.08), "estable").when(F.col("change") > 0, "sube").otherwise("baja")
    return one.withColumn("change", change).withColumns({
        "course": course,
        "best_label": dates.period_label(S.label_date(F.col("best"), unit), unit),
        "worst_label": dates.period_label(S.label_date(F.col("worst"), unit), unit),
    })


def unusual_periods(series: DataFrame, strict: bool = False) -> DataFrame:
    """(position, period, value, median, score): at most three periods far from the median.

    The score is 0.6745 |x - median| / MAD, from 3.5; with a MAD of zero, |x - median| / IQR from 2.5.
    `strict` knows only the first, above 3.5, and orders by value. Series under six periods give none.
    """
    # a series has few rows, so plain medians are enough
    spread = series.agg(F.struct(
        F.count("value").alias("n"), F.median("value").alias("m"),
        (F.percentile("value", 0.75) - F.percentile("value", 0.25)).alias("iqr"))).scalar()
    centred = series.where("value is not null").withColumn("_s", spread).withColumn("_d", F.abs(F.col("value") - F.col("_s.m")))
    mad = F.median("_d").over(W.partitionBy())
    scored = centred.withColumn("_mad", mad).where(F.col("_s.n") >= 6)
    by_mad = 0.6745 * F.col("_d") / F.nullif(F.col("_mad"), F.lit(0.0))
    if strict:
        kept = scored.withColumn("score", by_mad).where("score > 3.5")
        order = [F.desc("value"), F.asc("period")]
    else:
        by_iqr = F.col("_d") / F.nullif(F.col("_s.iqr"), F.lit(0.0))
        far = F.when(F.col("_mad") > 0, by_mad >= 3.5).otherwise(by_iqr >= 2.5)
        kept = scored.withColumn("score", F.coalesce(by_mad, by_iqr)).where(far)
        order = [F.desc("score"), F.asc("period")]
    placed = kept.withColumn("position", F.row_number().over(W.orderBy(*order))).where(F.col("position") <= MAX_UNUSUAL)
    return placed.select("position", "period", "value", F.col("_s.m").alias("median"), "score")


def dated(df: DataFrame, date_col: str, unit: str, value_col: str | None) -> DataFrame:
    """The rows with a date, with `_p` (period), `_d` (instant) and `_v` (value, or one per row)."""
    d = instant(df, date_col)
    v = number(df, value_col) if value_col else F.lit(1.0)
    return df.where(d.isNotNull()).withColumns({"_p": dates.period_start(d, unit), "_d": d, "_v": v})


def volume_clue(rows_: DataFrame) -> DataFrame:
    """(period, n, usual, ratio, clue, mean): `volumen` from 1.4 times the usual row count, `tamano` up to 0.7."""
    per = rows_.groupBy(F.col("_p").alias("period")).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"))
    usual = per.agg(F.median("n")).scalar()
    return per.withColumn("usual", usual).withColumn("ratio", F.try_divide("n", "usual")).withColumn(
        "clue", F.when(F.col("ratio") >= 1.4, "volumen").when((F.col("ratio") <= 0.7) & F.col("mean").isNotNull(), "tamano"))


def single_clue(rows_: DataFrame, detail: list[str]) -> DataFrame:
    """(period, largest, share, detail...): the largest single row of each period and its part of the total."""
    tie = F.struct(F.col("_v"), *[F.coalesce(col(c).cast("string"), F.lit("")) for c in detail])
    per = rows_.where("_v is not null").groupBy(F.col("_p").alias("period")).agg(
        F.sum("_v").alias("total"), F.max("_v").alias("largest"),
        *[F.max_by(col(c), tie).alias(c) for c in detail])
    return per.withColumn("share", F.try_divide("largest", "total")).drop("total")


def season_clue(rows_: DataFrame, unit: str) -> DataFrame:
    """(period, share): periods that fall in the strongest month (or weekday) when it passes 1.4 times its even share.

    Months need 500 days and 6 months of data, weekdays 5 different days; other units give nothing.
    """
    if unit not in ("M", "D"):
        return rows_.select(F.col("_p").alias("period"), F.lit(0.0).alias("share")).limit(0)
    part = F.month("_d") if unit == "M" else F.weekday("_d")
    per = rows_.groupBy(part.alias("part")).agg(F.coalesce(F.sum("_v"), F.lit(0.0)).alias("v"), F.min("_d").alias("a"), F.max("_d").alias("b"))
    strongest = per.agg(
        F.max_by("part", F.struct("v", -F.col("part"))).alias("part"), F.max("v").alias("v"), F.sum("v").alias("total"),
        F.count(F.lit(1)).alias("parts"), F.timestamp_diff("DAY", F.min("a"), F.max("b")).alias("days"))
    least, days, even = (6, 500, 1.4 / 12) if unit == "M" else (5, 0, 1.4 / 7)
    s = strongest.select(F.struct("part", F.try_divide("v", "total").alias("share"), "parts", "days").alias("s")).scalar()
    periods = rows_.select(F.col("_p").alias("period")).distinct().withColumn("_s", s)
    at = F.month("period") if unit == "M" else F.weekday("period")
    hit = (at == F.col("_s.part")) & (F.col("_s.share") > even) & (F.col("_s.parts") >= least) & (F.col("_s.days") >= days)
    return periods.where(hit).select("period", F.col("_s.share").alias("share"))


def category_clue(rows_: DataFrame, dimension: str) -> DataFrame:
    """(period, category, share, usual): the leading category of a period when it has 40 % and 1.5 times its usual share.

    Both shares come from one aggregation by period and category.
    """
    both = rows_.where(col(dimension).isNotNull()).groupBy(F.col("_p").alias("period"), col(dimension).alias("category")).agg(
        F.coalesce(F.sum("_v"), F.lit(0.0)).alias("v"))
    overall = both.groupBy("category").agg(F.sum("v").alias("g"))
    whole = overall.agg(F.sum("g")).scalar()
    lead = both.groupBy("period").agg(
        F.sum("v").alias("t"), F.max("v").alias("v"), F.count(F.lit(1)).alias("k"),
        F.max_by("category", F.struct("v", "category")).alias("category"))
    joined = lead.where("k >= 2 and t > 0").join(overall, "category")
    return joined.select("period", "category", (F.col("v") / F.col("t")).alias("share"), (F.col("g") / whole).alias("usual")).where(
        "share >= 0.4 and usual > 0 and share >= usual * 1.5")


def explain_unusual(df: DataFrame, series: DataFrame, date_col: str, value_col: str | None, unit: str,
                    mapping: dict[str, str | None]) -> DataFrame:
    """The unusual periods with every clue about them, one row per period."""
    base = dated(df, date_col, unit, value_col)
    details = [c for c in dict.fromkeys(mapping.get(s) for s in ("cliente", "producto", "segmento")) if c in df.columns]
    odd = unusual_periods(series)
    out = odd.join(volume_clue(base).select("period", "n", "usual", F.col("clue").alias("volume_clue")), "period", "left")
    if value_col:
        one = single_clue(base, details[:2]).where("share >= 0.2").select(
            "period", F.col("largest").alias("single_value"), F.col("share").alias("single_share"),
            F.concat_ws(", ", *[col(c).cast("string") for c in details[:2]]).alias("single_detail"))
        out = out.join(one, "period", "left")
    out = out.join(season_clue(base, unit).withColumnRenamed("share", "season_share"), "period", "left")
    clues = []
    for i, slot in enumerate(("segmento", "producto", "cliente")):
        c = mapping.get(slot)
        if c in df.columns:
            out = out.join(category_clue(base, c).select(
                "period", F.struct(F.lit(c).alias("dimension"), F.col("category").cast("string").alias("category"), "share", "usual").alias(f"_c{i}")),
                "period", "left")
            clues.append(f"_c{i}")
    concentrated = F.coalesce(*clues) if len(clues) > 1 else F.col(clues[0]) if clues else F.lit(None)
    return out.withColumn("concentrated", concentrated).drop(*clues).withColumn(
        "label", dates.period_label(S.label_date(F.col("period"), unit), unit)).orderBy("position")


def read_ranking(totals: DataFrame) -> DataFrame:
    """One row from (k, v): the leader with its share, the share of the two first and of those past the seventh."""
    # all-distributed: totals may have any number of categories
    whole = totals.where("v is not null").agg(F.struct(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))).scalar()
    heads = totals.where("v is not null").orderBy(F.desc("v"), F.asc("k")).limit(7)
    placed = heads.withColumn("p", F.row_number().over(W.orderBy(F.desc("v"), F.asc("k")))).withColumn("_w", whole)
    total = F.first("_w.s")
    return placed.agg(
        F.max(F.when(F.col("p") == 1, F.col("k"))).cast("string").alias("first"), F.max("v").alias("first_value"),
        (F.max("v") / total).alias("first_share"), (F.sum(F.when(F.col("p") <= 2, F.col("v"))) / total).alias("two_share"),
        (1 - F.sum("v") / total).alias("rest_share"), F.greatest(F.first("_w.n") - 7, F.lit(0)).alias("n_rest"))


def unusual_leader(totals: DataFrame) -> DataFrame:
    """One row from (k, v) when the first value is at least three times the median of the others (four values or more)."""
    first = totals.where("v is not null").orderBy(F.desc("v"), F.asc("k")).limit(1)
    n = totals.where("v is not null").count()
    # median of the others: an order statistic of all values, which are the others plus the largest
    rest = Q.order_statistics(totals, [Q.Target("v", 0.5, lambda m: (m - 2) * 0.5)])[0] if n >= 4 else None
    return first.select(
        F.col("k").cast("string").alias("first"), "v", F.lit(rest).cast("double").alias("median_rest"),
        F.try_divide("v", F.lit(rest).cast("double")).alias("times")).where("median_rest > 0 and times >= 3")


