"""Period series: totals per day, week, month, quarter or year, without gaps.

The table is reduced to one row per period by one aggregation; everything after that works on
periods, of which there are few however large the table is.
"""
from __future__ import annotations


from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulario.functions import dates
from tabulario.operators import quantiles as Q
from tabulario.operators.intake import instant, number
from tabulario.operators.kpi import Measure, evaluate

UNITS = {"D": "día", "W": "semana", "M": "mes", "Q": "trimestre", "Y": "año"}
INSIGHT_CUTS = [(45, "D"), (200, "W"), (1200, "M")]
BOARD_CUTS = [(60, "D"), (365, "W")]


def choose_unit(span_days: int, board: bool = False) -> str:
    """Period length for a span of days; the board never goes beyond months."""
    for limit, unit in BOARD_CUTS if board else INSIGHT_CUTS:
        if span_days <= limit:
            return unit
    return "M" if board else "Q"


def robust_bounds(df: DataFrame, date_col: str) -> tuple[Column, Column] | None:
    """Q1 - 5 IQR and Q3 + 5 IQR of the dates; None when under 20 dates or without spread."""
    typed = df.select(dates.seconds(instant(df, date_col)).alias("s"))
    if typed.where("s is not null").limit(20).count() < 20:
        return None
    q1, q3 = Q.quantiles(typed, "s", [0.25, 0.75])
    if q3 <= q1:
        return None
    return tuple(dates.from_seconds(F.lit(x)) for x in (q1 - 5 * (q3 - q1), q3 + 5 * (q3 - q1)))


def within_dates(df: DataFrame, date_col: str) -> DataFrame:
    """Rows with a believable date: all present dates, less those far outside the rest."""
    return Scope(df, date_col).kept


def covered(df: DataFrame, date_col: str) -> DataFrame:
    """One row: first and last believable date."""
    scope = Scope(df, date_col)
    d = instant(df, date_col)
    return scope.kept.agg(F.min(d).alias("desde"), F.max(d).alias("hasta"))


def set_aside(df: DataFrame, date_col: str) -> DataFrame:
    """One row: dates present, dates believed and dates set aside."""
    kept = F.count_if(Scope(df, date_col).believed)
    n = F.count(instant(df, date_col))
    return df.agg(n.alias("fechas"), kept.alias("creibles"), (n - kept).alias("descartadas"))


def daily_totals(df: DataFrame, date_col: str, value_col: str | None) -> DataFrame:
    """(day, value, n, last): total, row count and last instant of every day with rows; without `value_col`
    the value is the count."""
    d = instant(df, date_col)
    v = F.coalesce(F.sum(number(df, value_col)), F.lit(0.0)) if value_col else F.count(F.lit(1)).cast("double")
    return df.where(d.isNotNull()).groupBy(d.cast("date").alias("day")).agg(
        v.alias("value"), F.count(F.lit(1)).alias("n"), F.max(d).alias("last"))


def roll_up(daily: DataFrame, unit: str, trim: bool = True, drop_incomplete: bool = True) -> DataFrame:
    """(period, value, n) from daily totals. Empty periods in between are zero; the last one is dropped while it
    is not over; `trim` drops zero periods at both ends."""
    base = daily.groupBy(dates.period_start(F.col("day"), unit).alias("period")).agg(
        F.sum("value").alias("value"), F.sum("n").alias("n"), F.max("last").alias("last"))
    ends = base.agg(F.min("period").alias("lo"), F.max("period").alias("hi"), F.max("last").alias("last"))
    spine = ends.select(F.explode(F.sequence("lo", "hi", dates.period_step(unit))).alias("period"), "hi", "last")
    whole = spine.join(base.select("period", "value", "n"), "period", "left").select(
        "period", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("n", F.lit(0)).alias("n"), "hi", "last")
    if drop_incomplete:
        open_end = dates.period_end(F.col("period"), unit).cast("timestamp_ntz") > F.col("last")
        whole = whole.where(~((F.col("period") == F.col("hi")) & open_end))
    whole = whole.drop("hi", "last")
    return _trimmed(whole) if trim else whole


def period_series(df: DataFrame, date_col: str, value_col: str | None, unit: str, robust: bool = True,
                  trim: bool = True, drop_incomplete: bool = True) -> DataFrame:
    """`roll_up` of the daily totals of a table, by default over its believable dates."""
    kept = within_dates(df, date_col) if robust else df
    return roll_up(daily_totals(kept, date_col, value_col), unit, trim, drop_incomplete)


@dataclass
class Scope:
    """The believable dates of a table: found once, then shared by whatever looks at time."""

    df: DataFrame
    date_col: str

    @cached_property
    def bounds(self) -> tuple[Column, Column] | None:
        return robust_bounds(self.df, self.date_col)

    @property
    def believed(self) -> Column:
        d = instant(self.df, self.date_col)
        return d.isNotNull() if self.bounds is None else d.between(*self.bounds)

    @property
    def kept(self) -> DataFrame:
        return self.df.where(self.believed)

    @cached_property
    def facts(self) -> Row:
        """n (dates present), kept, first and last believable date."""
        d = instant(self.df, self.date_col)
        inside = F.when(self.believed, d)
        return self.df.agg(F.count(d).alias("n"), F.count(inside).alias("kept"), F.min(inside).alias("first"),
                           F.max(inside).alias("last")).head()

    @cached_property
    def spread(self) -> tuple[float, float, float]:
        """1st percentile, median and 99th percentile of the believable dates, in seconds."""
        typed = self.kept.select(dates.seconds(instant(self.df, self.date_col)).alias("s"))
        wanted = [Q.quantile("s", p) for p in (0.01, 0.5, 0.99)]
        return tuple(Q.order_statistics(typed, wanted, {"s": self.facts["kept"]}))

    @property
    def full_days(self) -> int:
        return (self.facts["last"] - self.facts["first"]).days if self.facts["kept"] else 0

    @property
    def span(self) -> int:
        """Whole days from the 1st to the 99th percentile (from first to last under 20 dates), at least 1."""
        if self.facts["kept"] < 20:
            return max(self.full_days, 1)
        return max(int((self.spread[2] - self.spread[0]) // 86400), 1)

    @property
    def median(self) -> Column:
        return dates.from_seconds(F.lit(self.spread[1]))


def _trimmed(series: DataFrame) -> DataFrame:
    nonzero = F.max((F.col("value") != 0).cast("int"))
    seen = nonzero.over(W.orderBy("period").rowsBetween(W.unboundedPreceding, 0))
    coming = nonzero.over(W.orderBy(F.desc("period")).rowsBetween(W.unboundedPreceding, 0))
    some = nonzero.over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return series.withColumns({"_a": seen, "_b": coming, "_c": some}).where(
        "(_a = 1 and _b = 1) or _c = 0").drop("_a", "_b", "_c")


def label_date(period: Column, unit: str) -> Column:
    """The date that names a period: its start, or the Sunday that ends a week."""
    return dates.period_end(period, unit) if unit == "W" else period


def last_change(series: DataFrame) -> DataFrame:
    """One row: the last period with its relative change of value and of row count."""
    order = W.orderBy("period")
    out = series.withColumns({"_v": F.lag("value").over(order), "_n": F.lag("n").over(order)})
    return out.orderBy(F.desc("period")).limit(1).where("_v is not null").select(
        "period", "value", F.col("_v").alias("previous"),
        F.try_divide(F.col("value") - F.col("_v"), F.abs("_v")).alias("delta_value"),
        F.try_divide((F.col("n") - F.col("_n")).cast("double"), F.abs("_n").cast("double")).alias("delta_n"),
    )


def measure_series(df: DataFrame, measure: Measure, date_col: str, unit: str, scope: Scope | None = None) -> DataFrame:
    """(period, value) of any measure, computed inside each period; periods without a value are left out
    and the last one is dropped when there are more than three."""
    kept = (scope or Scope(df, date_col)).kept
    per = evaluate(
        kept.withColumn("_period", dates.period_start(instant(df, date_col), unit)), {"value": measure}, ["_period"]
    ).where("value is not null and not isnan(value)").withColumnRenamed("_period", "period")
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return per.withColumns({"_n": F.count(F.lit(1)).over(everything), "_last": F.max("period").over(everything)}).where(
        "_n <= 3 or period < _last").drop("_n", "_last")


def thirds(series: DataFrame) -> DataFrame:
    """One row: mean of the first and of the last third, and the relative change between them."""
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    placed = series.withColumns({"_i": F.row_number().over(W.orderBy("period")), "_n": F.count(F.lit(1)).over(everything)})
    k = F.greatest(F.lit(1), F.floor(F.col("_n") / 3))
    means = placed.agg(F.avg(F.when(F.col("_i") <= k, F.col("value"))).alias("first_third"),
                       F.avg(F.when(F.col("_i") > F.col("_n") - k, F.col("value"))).alias("last_third"))
    change = F.try_divide(F.col("last_third") - F.col("first_third"), F.abs("first_third"))
    return means.withColumn("change", change)


def last_against_history(series: DataFrame) -> DataFrame:
    """One row: the last value, the mean and deviation of all before it, and its z-score."""
    history = W.orderBy("period").rowsBetween(W.unboundedPreceding, -1)
    out = series.withColumns({
        "mean": F.avg("value").over(history), "sd": F.stddev_samp("value").over(history),
        "previous": F.lag("value").over(W.orderBy("period")), "before": F.count(F.lit(1)).over(history),
    })
    return out.orderBy(F.desc("period")).limit(1).select(
        "period", "value", "previous", "mean", "sd", "before",
        F.try_divide(F.col("value") - F.col("mean"), "sd").alias("z"),
        F.try_divide(F.col("value") - F.col("previous"), F.abs("previous")).alias("change"))


def linear_fit(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """One row: n, slope, intercept, r2, standard error of the slope and its t statistic."""
    fit = df.agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"))
    stderr = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("syy") * (1 - F.col("r2")), (F.col("n") - 2) * F.col("sxx"))))
    return fit.withColumn("stderr", stderr).withColumn("t", F.try_divide("slope", "stderr")).drop("sxx", "syy")


def trend(series: DataFrame) -> DataFrame:
    """`linear_fit` of the value on the position of the period, plus the mean, the last value and the change per period."""
    placed = series.withColumn("_i", (F.row_number().over(W.orderBy("period")) - 1).cast("double"))
    fit = linear_fit(placed, F.col("_i"), F.col("value"))
    more = series.agg(F.struct(F.avg("value").alias("mean"), F.max_by("value", "period").alias("last"))).scalar()
    out = fit.withColumn("_m", more).withColumns({"mean": F.col("_m.mean"), "last": F.col("_m.last")}).drop("_m")
    return out.withColumn("change", F.try_divide("slope", F.abs(F.when(F.col("mean") == 0, 1.0).otherwise(F.col("mean")))))


