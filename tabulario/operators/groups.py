"""Rankings, shares, concentration, segment tests, histograms and boxes."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulario.functions.dates import from_seconds, seconds
from tabulario.functions.text import as_category, label
from tabulario.operators import quantiles as Q
from tabulario.operators.intake import col, instant, number, present

MAX_CATEGORIES = 8
OTHERS = "Otros"


def ranking(df: DataFrame, dimension: str, metric: str) -> DataFrame:
    """(category, total, n, mean, share) per present category, highest total first."""
    v = number(df, metric)
    per = df.where(present(df, dimension)).groupBy(col(dimension).alias("category")).agg(
        F.coalesce(F.sum(v), F.lit(0.0)).alias("total"), F.count(v).alias("n"), F.avg(v).alias("mean"))
    whole = per.agg(F.sum("total")).scalar()
    return per.withColumn("share", F.try_divide("total", whole)).orderBy(F.desc("total"), "category")


def top_with_others(totals: DataFrame, n: int = MAX_CATEGORIES, others: str = OTHERS) -> DataFrame:
    """(position, label, value) from (k, v): the n - 1 highest and the sum of the rest, so that nothing is lost.

    With n values or fewer all are shown. The rest is added up by a distributed sum; only n candidates
    are ranked in one place.
    """
    kept = totals.where("v is not null")
    heads = kept.orderBy(F.desc("v"), F.asc("k")).limit(n)
    placed = heads.withColumn("position", F.row_number().over(W.orderBy(F.desc("v"), F.asc("k"))))
    whole = kept.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))).scalar()
    placed = placed.withColumn("_w", whole).where((F.col("_w.n") <= n) | (F.col("position") < n))
    shown = placed.select("position", label(F.col("k")).alias("label"), "v", "_w")
    rest = shown.groupBy("_w").agg(F.sum("v").alias("_s"), F.count(F.lit(1)).alias("_n")).where("_w.n > _n").select(
        (F.col("_n") + 1).cast("int").alias("position"),
        F.concat(F.lit(f"{others} ("), F.format_number(F.col("_w.n") - F.col("_n"), 0), F.lit(")")).alias("label"),
        (F.col("_w.s") - F.col("_s")).alias("v"))
    return shown.drop("_w").unionByName(rest).withColumnRenamed("v", "value").orderBy("position")


def pie(totals: DataFrame, n: int = MAX_CATEGORIES) -> DataFrame:
    """(position, label, value, share): slices with negatives counted as zero."""
    floored = totals.withColumn("v", F.greatest(F.col("v"), F.lit(0.0)))
    slices = top_with_others(floored, n)
    return slices.withColumn("share", F.try_divide("value", F.sum("value").over(W.partitionBy())))  # at most n rows


def fold_others(df: DataFrame, dimension: str, top: int = MAX_CATEGORIES) -> DataFrame:
    """The dimension with all but its top - 1 most frequent values renamed; untouched with `top` values or fewer."""
    text = as_category(col(dimension))
    counts = df.groupBy(text.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    heads = [r["_v"] for r in counts.orderBy(F.desc("_n"), "_v").limit(top + 1).collect()]
    folded = text if len(heads) <= top else F.when(text.isin(heads[: top - 1]), text).otherwise(F.lit(OTHERS))
    return df.withColumn(dimension, folded)


def period_breakdown(df: DataFrame, period: Column, dimension: str, metric: str, top: int = MAX_CATEGORIES) -> DataFrame:
    """(period, category, value): totals per period and folded category, in long form."""
    folded = fold_others(df.withColumns({"_p": period, "_m": number(df, metric)}), dimension, top)
    return folded.groupBy(F.col("_p").alias("period"), col(dimension).alias("category")).agg(
        F.coalesce(F.sum("_m"), F.lit(0.0)).alias("value"))


def pivot(breakdown: DataFrame) -> DataFrame:
    """One row per period and one column per category, gaps as zero."""
    categories = sorted(r["category"] for r in breakdown.select("category").distinct().collect())  # folded: a few
    return breakdown.groupBy("period").pivot("category", categories).agg(F.sum("value")).na.fill(0.0).orderBy("period")


def halves(df: DataFrame, date_col: str, dimension: str, metric: str | None, cut: Column | None = None) -> DataFrame:
    """(category, before, after, change, weight): totals up to and after the median date, in one pass.

    What is missing on a side is 0 there; without anything before, no change can be told and it is null.
    """
    d = instant(df, date_col)
    if cut is None:
        (median,) = Q.quantiles(df.select(seconds(d).alias("s")), "s", [0.5])
        cut = from_seconds(F.lit(median))
    v = number(df, metric) if metric else F.lit(1.0)
    both = df.where(present(df, dimension) & d.isNotNull()).groupBy(col(dimension).alias("category")).agg(
        F.coalesce(F.sum(F.when(d <= cut, v)), F.lit(0.0)).alias("before"),
        F.coalesce(F.sum(F.when(d > cut, v)), F.lit(0.0)).alias("after"))
    whole = both.agg(F.sum("before")).scalar()
    change = F.when(F.col("before") > 0, (F.col("after") - F.col("before")) / F.col("before"))
    return both.withColumns({"change": change, "weight": F.try_divide(F.col("before"), whole)})


def concentration(totals: DataFrame, fraction: float = 0.2) -> DataFrame:
    """One row from (k, v): how many values, how many are the top fraction, their share and that of the first.

    Only values with a positive total count.
    """
    positive = totals.where("v > 0")
    first = positive.agg(F.min_by("k", F.struct(-F.col("v"), F.col("k").cast("string"))).cast("string")).scalar()
    return Q.top_k_sum(positive, "v", fraction, Q.rounded_share(fraction)).select(
        "n", "k", F.try_divide("top_sum", "total").alias("share_top"), first.alias("first"),
        F.try_divide("largest", "total").alias("share_first"))


def by_membership(df: DataFrame, column: str, classes: DataFrame, inside: bool = True) -> DataFrame:
    """Rows whose value of `column` is among the values of the one-column frame `classes`, or those whose value is not.

    A missing value is a value like any other.
    """
    listed = classes.toDF("_class").distinct()
    return df.join(listed, col(column).eqNullSafe(F.col("_class")), "left_semi" if inside else "left_anti")


def long_tail(totals: DataFrame, beyond: float = 0.95) -> DataFrame:
    """One row from (k, v): values in all, and those past the given cumulative share when sorted from the largest."""
    placed = Q.descending_prefix(totals.where("v > 0").select("v"), "v")
    # of c equal values those count whose own cumulative share is past the limit
    within = F.floor((F.lit(beyond) * F.col("total") - (F.col("upto") - F.col("v") * F.col("c"))) / F.col("v"))
    tail = F.col("c") - F.least(F.col("c"), F.greatest(F.lit(0), within))
    return placed.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_total"), F.coalesce(F.sum(tail), F.lit(0)).alias("n_tail"))


def group_moments(df: DataFrame, dimension: str, metric: str) -> DataFrame:
    """(category, n, mean, variance, total) per category; a missing category is `nan`."""
    typed = df.select(as_category(col(dimension)).alias("category"), number(df, metric).alias("v")).where("v is not null")
    return typed.groupBy("category").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("variance"), F.sum("v").alias("total"))


def anova(moments: DataFrame, least: int = 5) -> DataFrame:
    """One row from group moments: groups, rows, F statistic and its degrees of freedom, over groups of `least` rows."""
    per = moments.where(F.col("n") >= least)
    grand = per.agg(F.sum("total") / F.sum("n")).scalar()
    sums = per.agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("mean") - grand, 2)).alias("ssb"), F.sum((F.col("n") - 1) * F.col("variance")).alias("ssw"))
    df1, df2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    return sums.select("groups", "n", df1.alias("df1"), df2.alias("df2"),
                       F.try_divide(F.try_divide("ssb", df1.cast("double")), F.try_divide("ssw", df2.cast("double"))).alias("f"))


def group_means(moments: DataFrame) -> DataFrame:
    """(category, mean, n, total, lift) from group moments: the lift is the relative distance from the overall mean."""
    overall = moments.agg(F.sum("total") / F.sum("n")).scalar()
    return moments.select("category", "mean", "n", "total").withColumn(
        "lift", F.try_divide(F.col("mean") - overall, F.abs(overall)))


def dispersion(df: DataFrame, metric: str) -> DataFrame:
    """One row: n, coefficient of variation, median, 90th percentile and the share of the top 1 % of rows."""
    typed = df.select(number(df, metric).alias("v")).where("v is not null")
    (n,) = typed.agg(F.count("v")).head()
    wanted = [Q.quantile("v", 0.5), Q.quantile("v", 0.9), Q.kth_largest("v", 0.01, Q.one_percent)]
    p50, p90, cut = Q.order_statistics(typed, wanted, {"v": n})
    spread = typed.agg(F.struct(F.stddev_samp("v").alias("sd"), F.avg("v").alias("m"))).scalar()
    top = Q.sum_above(typed, "v", 0.01, Q.one_percent, cut).withColumn("_d", spread)
    return top.select(
        "n", F.try_divide(F.col("_d.sd"), F.abs(F.col("_d.m"))).alias("cv"), F.lit(p50).cast("double").alias("p50"),
        F.lit(p90).cast("double").alias("p90"), "k", F.try_divide("top_sum", "total").alias("share_top"))


def bins_for(n: int) -> int:
    return min(50, max(10, int(math.sqrt(n))))


def histogram(df: DataFrame, metric: str, central: bool = False) -> DataFrame:
    """(bin, low, high, n) over equal-width bins, empty ones included; with `central` only values within p1..p99."""
    typed = df.select(number(df, metric).alias("v")).where("v is not null")
    if central:
        typed = central_values(typed, "v")
    n, low, high = typed.agg(F.count("v"), F.min("v"), F.max("v")).head()
    k = bins_for(n)
    width = (high - low) / k if n and high > low else 1.0
    at = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(k - 1))
    counted = typed.groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.range(k).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counted, "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def central_values(df: DataFrame, column: str) -> DataFrame:
    """Rows within the 1st and 99th percentile; all rows when the two are equal."""
    low, high = Q.quantiles(df, column, [0.01, 0.99])
    if low is None or high <= low:
        return df
    return df.where(F.col(column).between(low, high))


def boxes(df: DataFrame, dimension: str, metric: str, top: int = MAX_CATEGORIES) -> DataFrame:
    """(category, n, low, q1, median, q3, high) per folded category, highest median first."""
    typed = fold_others(df.select(col(dimension), number(df, metric).alias("_v")).where("_v is not null"), dimension, top)
    typed = typed.withColumnRenamed(dimension, "category")
    quartiles = Q.grouped_quantiles(typed, ["category"], "_v", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    ends = typed.groupBy("category").agg(F.count("_v").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    return ends.join(quartiles, "category").select("category", "n", "low", "q1", "median", "q3", "high").orderBy(
        F.desc("median"), "category")


def box_view_range(box: DataFrame) -> DataFrame:
    """One row: value range worth showing, 1.8 median IQRs beyond the outermost quartiles."""
    iqr = F.median(F.col("q3") - F.col("q1"))
    return box.agg(F.min("q1").alias("a"), F.max("q3").alias("b"), iqr.alias("i"), F.min("low").alias("lo"), F.max("high").alias("hi")).select(
        F.greatest(F.col("a") - 1.8 * F.col("i"), F.col("lo") - 0.02 * F.abs("lo")).alias("desde"),
        F.least(F.col("b") + 1.8 * F.col("i"), F.col("hi")).alias("hasta"))


def pair_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row about the rows where both are present: n, r, slope, intercept and the mean of each."""
    typed = df.select(number(df, x).alias("x"), number(df, y).alias("y")).na.drop("any")
    return typed.agg(
        F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r"), F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))


def pair_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y) of the rows where both are present."""
    return df.select(number(df, x).alias("x"), number(df, y).alias("y")).na.drop("any")
