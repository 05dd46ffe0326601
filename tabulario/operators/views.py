"""Data behind the charts: up to six views of a table, views of user KPIs, and the chart kinds the data admit."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulario.functions import fixed
from tabulario.operators import explain as E
from tabulario.operators import geo
from tabulario.operators import groups as G
from tabulario.operators import series as S
from tabulario.operators.intake import col, number, rows
from tabulario.operators.kpi import Kpi, by_category, per_value
from tabulario.operators.choices import date_columns, dimension_columns, metric_columns
from tabulario.operators.profile import Profiles

MAX_VIEWS = 6
MAX_KPI_CATEGORIES = 40
Mapping = dict[str, str | None]


@dataclass
class View:
    """One chart's worth of data. `kind` is the chart that suits it."""

    name: str
    kind: str
    data: DataFrame
    unit: str | None = None


def _date(profiles: Profiles, mapping: Mapping) -> str | None:
    able = date_columns(profiles)
    return mapping.get("fecha") if mapping.get("fecha") in able else (able[0] if able else None)


def _second_metric(profiles: Profiles, mapping: Mapping, metric: str) -> str | None:
    others = [c for c in metric_columns(profiles) if c != metric]
    return mapping.get("cantidad") if mapping.get("cantidad") in others else (others[0] if others else None)


def board_series(df: DataFrame, date_col: str, value_col: str | None) -> tuple[str, DataFrame] | None:
    """Unit and series (value and row count) for the board: its own cuts, no trimming of zeros; None under three periods."""
    scope = S.Scope(df, date_col)
    if scope.facts["kept"] <= 3:
        return None
    unit = S.choose_unit(scope.full_days, board=True)
    series = S.roll_up(S.daily_totals(scope.kept, date_col, value_col), unit, trim=False)
    return (unit, series) if series.limit(3).count() == 3 else None


def board_views(df: DataFrame, profiles: Profiles, mapping: Mapping) -> list[View]:
    """Evolution, volume, two rankings, distribution, boxes and pairs: the first six that the data allow."""
    metrics = metric_columns(profiles)
    if not metrics:
        return []
    metric = mapping.get("ingreso") if mapping.get("ingreso") in metrics else metrics[0]
    views: list[View] = []
    when = _date(profiles, mapping)
    found = board_series(df, when, metric) if when else None
    if found:
        unit, series = found
        views.append(View("tiempo", "line", series.select("period", "value"), unit))
        views.append(View("volumen", "line", series.select("period", F.col("n").cast("double").alias("value")), unit))
    able = dimension_columns(profiles)
    wanted = [mapping.get(s) for s in ("segmento", "producto", "cliente")]
    dims = list(dict.fromkeys([d for d in wanted if d in able] + able))
    for dim in dims[:2]:
        if profiles[dim].n_unique >= 2:
            views.append(View(f"rank_{dim}", "bar", G.ranking(df, dim, metric)))
    n = profiles[metric].stats.get("n", 0)
    if n > 20:
        views.append(View("dist", "hist", G.histogram(df, metric, central=True)))
        if dims and profiles[dims[0]].n_unique > 1:
            views.append(View("caja", "box", G.boxes(df, dims[0], metric)))
    other = _second_metric(profiles, mapping, metric)
    if other and df.where(number(df, metric).isNotNull() & number(df, other).isNotNull()).limit(21).count() > 20:
        views.append(View("disp", "scatter", G.pair_fit(df, other, metric)))
    return views[:MAX_VIEWS]


def kpi_views(df: DataFrame, profiles: Profiles, mapping: Mapping, kpis: list[Kpi]) -> list[View]:
    """One view per KPI: over time when there are dates, else per category."""
    when = _date(profiles, mapping)
    unit, scope = None, S.Scope(df, when) if when else None
    if scope and scope.facts["kept"] > 3:
        unit = S.choose_unit(scope.full_days, board=True)
    able = dimension_columns(profiles)
    dim = next((d for d in [mapping.get("segmento"), mapping.get("producto"), *able]
                if d in able and profiles[d].n_unique <= MAX_KPI_CATEGORIES), None)
    views = []
    for k in kpis:
        if unit:
            series = S.measure_series(df, k.measure, when, unit, scope)
            if series.limit(3).count() == 3:
                views.append(View(k.name, "line", series, unit))
                continue
        if dim:
            per = by_category(df, k.measure, dim)
            if per.limit(2).count() == 2:
                views.append(View(k.name, "bar", per))
    return views


def kpi_outliers(series: DataFrame) -> DataFrame:
    """At most three periods of a KPI series above 3.5 by the median deviation, highest first."""
    return E.unusual_periods(series, strict=True)


def chart_kinds(df: DataFrame, n_periods: int, categories: DataFrame | None, n_values: int, additive: bool = True,
                grouped: bool = False, paired: bool = False, placed: bool = False) -> DataFrame:
    """(kind, ok, reason): which charts the data admit, and what they lack otherwise."""
    n_categories, lowest = 0, None
    if categories is not None:
        n_categories, lowest = categories.agg(F.count("value"), F.min("value")).head()
    dated, named = n_periods >= 3, n_categories >= 2
    if not named:
        slices = "faltan categorías"
    elif not additive:
        slices = "las partes no suman el total"
    elif lowest < 0:
        slices = "hay valores negativos"
    else:
        slices = "demasiadas categorías" if n_categories > 12 else ""
    reasons = {
        "line": "" if dated else "falta una fecha", "area": "" if dated else "falta una fecha",
        "bar": "" if named or dated else "faltan categorías", "pie": slices,
        "hist": "" if n_values >= 20 else "faltan valores sueltos", "box": "" if grouped else "falta un grupo con valores",
        "scatter": "" if paired else "falta otra columna numérica", "mapa": "" if placed else "faltan lugares conocidos",
    }
    return rows(df.sparkSession, [(k, not v, v) for k, v in reasons.items()], "kind string, ok boolean, reason string")


def chosen_kind(kinds: DataFrame, asked: str, recommended: str) -> tuple[str, str]:
    """The chart the user asked for when the data admit it, else the recommended one and why."""
    row = kinds.where(F.col("kind") == asked).head()
    if asked == "auto" or row is None:
        return recommended, ""
    return (asked, "") if row["ok"] else (recommended, row["reason"])


def map_data(df: DataFrame, profiles: Profiles, metric: str | None) -> tuple[str, DataFrame] | None:
    """The geographic column and its totals: countries by column name, else a column of Mexican states."""
    able = dimension_columns(profiles)
    country = next((c for c in able if any(part in c.lower() for part in fixed.COUNTRY_NAMES)), None)
    if country:
        totals = per_value(df, country, metric)
        shown = totals.select(col("k").cast("string").alias("label"), F.col("v").alias("value"))
        return (country, shown.orderBy(F.desc("value"), "label")) if totals.limit(2).count() == 2 else None
    for c in able:
        if geo.recognition(df.select(col(c).alias("v")), "v").head()["es_de_estados"]:
            totals = geo.state_totals(per_value(df, c, metric))
            return (c, totals) if totals.limit(2).count() == 2 else None
    return None
