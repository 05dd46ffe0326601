"""Monthly forecasts of one or many series by exponential smoothing, checked against repeating the last value."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulario.functions import dates
from tabulario.operators.intake import col, instant, number

SEASON = 12
_RESULT = (
    "serie string, tipo string, month date, value double, mape double, mae double, mape_naive double, "
    "beats boolean, seasonal boolean, months int"
)


def monthly_series(df: DataFrame, date_col: str, value_col: str | None, group_cols: list[str] | None = None) -> DataFrame:
    """(serie, month, value): monthly totals (or row counts) per series; the only pass over the table.

    `serie` is the group's values joined by ` | `. A missing value is written `\\N`, and a bar or backslash inside a value
    is escaped, so different groups never share a name.
    """
    escaped = [F.replace(F.replace(col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")) for c in group_cols or []]
    keys = [F.coalesce(k, F.lit("\\N")) for k in escaped]
    series = F.concat_ws(" | ", *keys) if keys else F.lit("total")
    v = F.coalesce(F.sum(number(df, value_col)), F.lit(0.0)) if value_col else F.count(F.lit(1)).cast("double")
    d = instant(df, date_col)
    return df.where(d.isNotNull()).groupBy(series.alias("serie"), dates.period_start(d, "M").alias("month")).agg(v.alias("value"))


def _smooth(y: np.ndarray, alpha: float, beta: float, gamma: float, seasonal: bool, ahead: int) -> tuple[float, np.ndarray]:
    """Squared one-step error of additive smoothing, and the forecast from its last state."""
    if seasonal:
        first, second = y[:SEASON].mean(), y[SEASON: 2 * SEASON].mean()
        level, slope, cycle = first, (second - first) / SEASON, list(y[:SEASON] - first)
    else:
        level, slope, cycle = y[0], y[1] - y[0], [0.0]
    error = 0.0
    for t, v in enumerate(y):
        s = cycle[t % len(cycle)]
        e = v - (level + slope + s)
        error += e * e
        level, slope = level + slope + alpha * e, slope + alpha * beta * e
        if seasonal:
            cycle[t % SEASON] = s + gamma * (1 - alpha) * e
    steps = np.arange(1, ahead + 1)
    return error, level + slope * steps + np.array([cycle[(len(y) + k - 1) % len(cycle)] for k in steps])


def smoothing_forecast(y: np.ndarray, ahead: int, seasonal: bool) -> np.ndarray:
    """Forecast with the weights of least error: a coarse grid, then halving steps around the best."""
    grid = (0.05, 0.2, 0.5, 0.8)
    seasons = grid if seasonal else (0.0,)
    best = min(((_smooth(y, a, b, g, seasonal, ahead)[0], (a, b, g)) for a in grid for b in (0.01, 0.1, 0.4) for g in seasons))
    step = 0.1
    while step > 0.004:
        around = []
        for i in range(3 if seasonal else 2):
            for sign in (-step, step):
                w = list(best[1])
                w[i] = min(max(w[i] + sign, 0.0), 1.0)
                around.append((_smooth(y, *w, seasonal, ahead)[0], tuple(w)))
        nearest = min(around)
        if nearest[0] < best[0]:
            best = nearest
        else:
            step /= 2
    return _smooth(y, *best[1], seasonal, ahead)[1]


def _mape(real: np.ndarray, guess: np.ndarray) -> float:
    able = np.abs(real) >= 1e-9
    return float(np.mean(np.abs((real[able] - guess[able]) / real[able]))) if able.any() else float("nan")


def holdout(n: int) -> int:
    return max(3, min(6, n // 4))


def forecast(series: DataFrame, horizon: int = 6) -> DataFrame:
    """Held-out and future months of every series of at least 12 months, with the errors of both methods.

    Series run side by side, one group each; a group has one row per month. Rows are of type
    `prueba` (held out) or `futuro`; a shorter series gives one row `corta`.
    """

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        months = pd.to_datetime(pdf["month"])
        y = pd.Series(pdf["value"].to_numpy(), index=months).sort_index()
        y = y.reindex(pd.date_range(y.index[0], y.index[-1], freq="MS"), fill_value=0.0)
        n = len(y)
        columns = [c.split()[0] for c in _RESULT.split(", ")]
        if n < SEASON:
            return pd.DataFrame([(key[0], "corta", None, None, None, None, None, None, None, n)], columns=columns)
        k = holdout(n)
        values = y.to_numpy(dtype=float)
        seasonal = n - k >= 2 * SEASON
        guess = smoothing_forecast(values[:-k], k, seasonal)
        mape, naive = _mape(values[-k:], guess), _mape(values[-k:], np.repeat(values[-k - 1], k))
        mae = float(np.mean(np.abs(values[-k:] - guess)))
        future = smoothing_forecast(values, horizon, seasonal)
        ahead = pd.date_range(y.index[-1] + pd.offsets.MonthBegin(1), periods=horizon, freq="MS")
        out = [(key[0], "prueba", d.date(), float(v), mape, mae, naive, mape < naive, seasonal, n) for d, v in zip(y.index[-k:], guess)]
        out += [(key[0], "futuro", d.date(), float(v), mape, mae, naive, mape < naive, seasonal, n) for d, v in zip(ahead, future)]
        return pd.DataFrame(out, columns=columns)

    return series.groupBy("serie").applyInPandas(one, _RESULT)


def naive_errors(series: DataFrame) -> DataFrame:
    """(serie, months, mape_naive): error of repeating the last training value, in SQL over the monthly totals."""
    from pyspark.sql import Window as W

    ends = series.groupBy("serie").agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    spine = ends.select("serie", F.explode(F.sequence("lo", "hi", dates.period_step("M"))).alias("month"))
    whole = spine.join(series, ["serie", "month"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    everything = W.partitionBy("serie")
    placed = whole.withColumns({"i": F.row_number().over(everything.orderBy("month")), "n": F.count(F.lit(1)).over(everything)})
    k = F.greatest(F.lit(3), F.least(F.lit(6), F.floor(F.col("n") / 4)))
    last = F.max(F.when(F.col("i") == F.col("n") - k, F.col("value"))).over(everything)
    tested = placed.withColumn("_last", last).where((F.col("i") > F.col("n") - k) & (F.col("n") >= SEASON))
    return tested.groupBy("serie").agg(
        F.max("n").alias("months"),
        F.avg(F.when(F.abs("value") >= 1e-9, F.abs((F.col("value") - F.col("_last")) / F.col("value")))).alias("mape_naive"))
