"""Insight rules: each finding comes from a test or a threshold and carries its figures."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime
from functools import cached_property

from py4j.protocol import Py4JError
from pyspark.errors import (AnalysisException, ArithmeticException, DateTimeException, IllegalArgumentException,
                            NumberFormatException, PySparkException)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulario.functions import fixed
from tabulario.functions.statistics import f_tail, t_two_sided
from tabulario.operators import groups as G
from tabulario.operators import series as S
from tabulario.operators.intake import rows
from tabulario.operators.kpi import per_value
from tabulario.operators.profile import Profiles
from tabulario.operators.quality import correlations
from tabulario.operators.values import shares

INSIGHT = "kind string, code string, subject string, title string, impact double, evidence map<string,double>"
OPPORTUNITY, RISK, FINDING, CONTEXT = "oportunidad", "riesgo", "hallazgo", "contexto"
Mapping = dict[str, str | None]
#: Errors of Spark that lie in a rule and its data; any other one means that the job or the cluster failed.
OF_A_RULE = (AnalysisException, ArithmeticException, DateTimeException, IllegalArgumentException, NumberFormatException)


def _insight(kind: str, code: str, subject: str | None, title: str, impact: float, **evidence: float) -> tuple:
    return (kind, code, subject, title, float(impact), {k: float(v) for k, v in evidence.items() if v is not None})


@dataclass
class Context:
    """What the rules look at. Anything several rules need is found once."""

    df: DataFrame
    mapping: Mapping
    profiles: Profiles
    as_of: date

    def slot(self, name: str) -> str | None:
        c = self.mapping.get(name)
        return c if c in self.df.columns else None

    def dimensions(self, *slots: str) -> list[str]:
        return list(dict.fromkeys(c for c in map(self.slot, slots) if c))

    @cached_property
    def scope(self) -> S.Scope | None:
        return S.Scope(self.df, self.slot("fecha")) if self.slot("fecha") else None

    @cached_property
    def daily(self) -> DataFrame:
        """Totals per believable day: the one pass that every rule about time shares."""
        return S.daily_totals(self.scope.kept, self.slot("fecha"), self.slot("ingreso")).persist()

    def release(self) -> None:
        if "daily" in self.__dict__:
            self.daily.unpersist()


def temporal(c: Context) -> list[tuple]:
    """Dates set aside, stale data, trend and an unusual last period."""
    if c.scope is None or c.scope.facts["kept"] < 10:
        return []
    unit = S.choose_unit(c.scope.span)
    series = S.roll_up(c.daily, unit)
    if series.limit(4).count() < 4:
        return []
    facts, out, income = c.scope.facts, [], c.slot("ingreso")
    if facts["n"] > facts["kept"]:
        out.append(_insight(CONTEXT, "fechas_apartadas", c.slot("fecha"), "Hay fechas que no cuadran con las demás", 0.45,
                            descartadas=facts["n"] - facts["kept"]))
    idle = (c.as_of - facts["last"].date()).days
    if idle > 45:
        out.append(_insight(RISK, "datos_viejos", c.slot("fecha"), "Los datos dejaron de actualizarse", 0.6, dias_sin_datos=idle))
    fit = S.trend(series).head()
    p = t_two_sided(fit["t"], fit["n"] - 2) if fit["t"] is not None else 0.0
    name = S.UNITS[unit]
    if p < 0.05 and abs(fit["change"]) > 0.01:
        up = fit["slope"] > 0
        out.append(_insight(
            OPPORTUNITY if up else RISK, "tendencia", income, f"Cada {name} {'sube' if up else 'baja'} de forma constante",
            min(0.95, 0.55 + abs(fit["change"]) * 2 + fit["r2"] * 0.2), pendiente=fit["slope"], cambio=fit["change"],
            r2=fit["r2"], p=p, periodos=fit["n"], proyeccion=fit["last"] + fit["slope"]))
    else:
        out.append(_insight(CONTEXT, "sin_tendencia", income, f"De un {name} a otro no hay rumbo claro", 0.3, p=p, periodos=fit["n"]))
    end = S.last_against_history(series).head()
    if end["z"] is not None and end["sd"] and abs(end["z"]) >= 2:
        out.append(_insight(RISK if end["z"] < 0 else OPPORTUNITY, "ultimo_periodo", income, f"El {name} más reciente es inusual",
                            min(0.95, 0.6 + abs(end["z"]) * 0.08), z=end["z"], ultimo=end["value"], media=end["mean"],
                            variacion=end["change"]))
    return out


def calendar_shares(daily: DataFrame, part: str) -> DataFrame:
    """(position, name, value, share) per weekday (Monday first) or month, from daily totals; those without rows are zero."""
    names = fixed.WEEKDAYS if part == "weekday" else fixed.MONTHS
    at = F.weekday("day") + 1 if part == "weekday" else F.month("day")
    found = daily.groupBy(at.alias("position")).agg(F.sum("value").alias("value"))
    spine = daily.sparkSession.range(1, len(names) + 1).select(
        F.col("id").cast("int").alias("position"), F.element_at(F.array(*[F.lit(n) for n in names]), F.col("id").cast("int")).alias("name"))
    whole = found.agg(F.sum("value")).scalar()
    return spine.join(found, "position", "left").select(
        "position", "name", F.coalesce("value", F.lit(0.0)).alias("value"),
        F.try_divide(F.coalesce("value", F.lit(0.0)), whole).alias("share"))


def seasonality(c: Context) -> list[tuple]:
    """A weekday above 1.6 times its even share, a month above 1.5 times."""
    if c.scope is None or c.scope.facts["kept"] < 60:
        return []
    out = []
    for part, least, limit, impact, code in (("weekday", 28, 1.6 / 7, 0.6, "dia_semana"), ("month", 365, 1.5 / 12, 0.65, "estacionalidad")):
        if c.scope.span < least:
            continue
        parts = calendar_shares(c.daily, part).orderBy("position").collect()  # 7 or 12 rows
        if sum(r["value"] for r in parts) <= 0:
            continue
        best, worst = max(parts, key=lambda r: r["share"]), min(parts, key=lambda r: r["share"])
        if best["share"] > limit:
            out.append(_insight(FINDING, code, best["name"], f"{best['name'].capitalize()} pesa más que el resto", impact,
                                mejor=best["position"], cuota_mejor=best["share"], peor=worst["position"], cuota_peor=worst["share"]))
    return out


def concentrated(c: Context) -> list[tuple]:
    """The top fifth makes 70 % or more; and a long tail that makes under 5 %."""
    out = []
    for dim in c.dimensions("cliente", "producto", "segmento"):
        if dim in c.profiles and c.profiles[dim].n_unique < 5:
            continue
        totals = per_value(c.df, dim, c.slot("ingreso")).persist()
        try:
            top = G.concentration(totals).head()
            if top["n"] < 5 or top["share_top"] is None:
                continue
            if top["share_top"] >= 0.7:
                alone = top["share_first"] > 0.3
                out.append(_insight(RISK if alone else FINDING, "concentracion", dim, f"Pocos valores de {dim} hacen casi todo",
                                    min(0.9, 0.5 + top["share_top"] * 0.4 + top["share_first"]),
                                    share_top20=top["share_top"], share_top1=top["share_first"], k=top["k"], n=top["n"]))
            tail = G.long_tail(totals).head()
            if tail["n_tail"] >= max(5, tail["n_total"] * 0.3):
                out.append(_insight(OPPORTUNITY, "cola_larga", dim, f"Muchos valores de {dim} aportan casi nada", 0.55,
                                    n_cola=tail["n_tail"], n_total=tail["n_total"]))
        finally:
            totals.unpersist()
    return out


def segments(c: Context) -> list[tuple]:
    """Whether the mean income differs between categories (one-way analysis of variance)."""
    v, out = c.slot("ingreso"), []
    for dim in c.dimensions("segmento", "producto") if v else []:
        if dim in c.profiles and not 1 < c.profiles[dim].n_unique <= 40:
            continue
        moments = G.group_moments(c.df, dim, v).persist()  # at most 41 rows
        try:
            means = G.group_means(moments).orderBy(F.desc("mean"), "category").collect()
            test = G.anova(moments).head()
        finally:
            moments.unpersist()
        if sum(r["n"] for r in means) < 30 or test["groups"] < 2 or test["f"] is None:
            continue
        p = f_tail(test["f"], test["df1"], test["df2"])
        if p >= 0.05:
            out.append(_insight(CONTEXT, "segmento_no_explica", dim, f"{dim} no separa niveles de {v}", 0.25, p=p, f=test["f"]))
            continue
        best, worst = means[0], means[-1]
        out.append(_insight(OPPORTUNITY, "segmento_discrimina", dim, f"{best['category']} rinde distinto en {v}",
                            min(0.9, 0.6 + abs(best["lift"]) * 0.3), p=p, f=test["f"], lift=best["lift"], drop=worst["lift"]))
    return out


def growth(c: Context) -> list[tuple]:
    """The weighty category that fell most and the one that grew most between both halves of the time."""
    dim = c.slot("segmento") or c.slot("producto")
    if c.scope is None or dim is None or c.scope.facts["kept"] < 60:
        return []
    if dim in c.profiles and c.profiles[dim].n_unique > 40:
        return []
    compared = G.halves(c.scope.kept, c.slot("fecha"), dim, c.slot("ingreso"), c.scope.median).where("before > 0").limit(41).collect()
    if not 3 <= len(compared) <= 40:
        return []
    heavy = sorted((r for r in compared if r["weight"] >= 0.05), key=lambda r: (r["change"], str(r["category"])))
    out = []
    if heavy and heavy[0]["change"] < -0.15:
        r = heavy[0]
        out.append(_insight(RISK, "caida_segmento", str(r["category"]), f"{r['category']} retrocede",
                            min(0.92, 0.6 + abs(r["change"]) * 0.3 + r["weight"]), variacion=r["change"], peso=r["weight"],
                            antes=r["before"], despues=r["after"]))
    if heavy and heavy[-1]["change"] > 0.15:
        r = heavy[-1]
        out.append(_insight(OPPORTUNITY, "crecimiento_segmento", str(r["category"]), f"{r['category']} avanza",
                            min(0.88, 0.55 + r["change"] * 0.2 + r["weight"]), variacion=r["change"], peso=r["weight"],
                            antes=r["before"], despues=r["after"]))
    return out


def dispersed(c: Context) -> list[tuple]:
    """Coefficient of variation above 1.2, and a top 1 % of rows above a fifth of the total."""
    v = c.slot("ingreso")
    if v is None:
        return []
    s, out = G.dispersion(c.df, v).head(), []
    if s["n"] < 30 or s["cv"] is None:
        return out
    if s["cv"] > 1.2:
        out.append(_insight(FINDING, "dispersion", v, f"{v} varía demasiado para resumirlo en una media", 0.55,
                            cv=s["cv"], p50=s["p50"], p90=s["p90"]))
    if s["share_top"] is not None and s["share_top"] > 0.2:
        out.append(_insight(RISK, "pocos_registros_dominan", v, "Una centésima de las filas hace gran parte del total", 0.6,
                            share_top1pct=s["share_top"], k=s["k"]))
    return out


def moving_together(c: Context) -> list[tuple]:
    """The three strongest correlations between 0.5 and 0.98, over rows without gaps."""
    columns = [p.name for p in c.profiles.values() if p.semantic == "numerico" and p.role != "identificador" and p.n_unique > 5]
    if len(columns) < 2:
        return []
    strong = correlations(c.df, columns, complete_rows=True).where("n >= 20 and abs(r) >= 0.5 and abs(r) < 0.98")
    return [
        _insight(FINDING, "correlacion", f"{x['a']} / {x['b']}", f"{x['a']} y {x['b']} van a la par", 0.4 + abs(x["r"]) * 0.2, r=x["r"])
        for x in strong.orderBy(F.desc(F.abs("r")), "a", "b").limit(3).collect()
    ]


def unbalanced(c: Context) -> list[tuple]:
    """Categories where one value takes more than 90 % of the rows; a missing value counts as one."""
    out = []
    for p in c.profiles.values():
        if p.semantic in ("categorico", "booleano") and 1 < p.n_unique <= 20:
            # the profile already holds the counts; missing rows may outnumber the most frequent value
            value, n = (p.mode, p.mode_count) if p.mode_count >= p.n_missing else ("nan", p.n_missing)
            if n / p.n > 0.9:
                out.append(_insight(CONTEXT, "desbalance", p.name, f"{p.name} casi siempre es {value}", 0.3, cuota=n / p.n))
    return out


def top_share(df: DataFrame, column: str) -> DataFrame:
    """One row: the most frequent value of a column and its share, missing included."""
    return shares(df, column, missing="nan").orderBy(F.desc("n"), "value").limit(1)


def pending_quality(issues: DataFrame) -> list[tuple]:
    n = issues.where(F.col("severity") == fixed.SEVERITIES[0]).count()
    return [_insight(RISK, "calidad", None, "Quedan problemas graves en los datos", 0.98, n_criticos=n)] if n else []


Rule = Callable[[Context], list[tuple]]
RULES: list[Rule] = [temporal, seasonality, concentrated, segments, growth, dispersed, moving_together, unbalanced]


def frame(df: DataFrame, found: list[tuple]) -> DataFrame:
    return rows(df.sparkSession, found, INSIGHT)


def generate(df: DataFrame, profiles: Profiles, mapping: Mapping, issues: DataFrame | None = None, limit: int = 12,
             as_of: date | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """Insights of every rule, strongest first. A rule that fails leaves a note and stops no other; a failed job is raised."""
    found = pending_quality(issues) if issues is not None else []
    context = Context(df, mapping, profiles, as_of or datetime.now().date())
    try:
        for rule in RULES if rules is None else rules:
            try:
                found += rule(context)
            except Exception as e:  # noqa: BLE001
                if isinstance(e, (PySparkException, Py4JError, OSError)) and not isinstance(e, OF_A_RULE):
                    raise
                found.append(_insight(CONTEXT, "regla_fallida", rule.__name__, f"No se pudo evaluar: {type(e).__name__}", 0.05))
    finally:
        context.release()
    return frame(df, found).orderBy(F.desc("impact"), "code", "subject").limit(limit)


def executive_summary(insights: DataFrame, overview: DataFrame, score: DataFrame) -> DataFrame:
    """One row: size, score, and how many risks and opportunities there are with the two strongest of each."""
    def strongest(kind: str):
        titles = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct((-F.col("impact")).alias("i"), "title"))))
        return F.slice(F.transform(titles, lambda x: x["title"]), 1, 2)

    one = insights.agg(
        F.count_if(F.col("kind") == RISK).alias("n_riesgos"), strongest(RISK).alias("riesgos"),
        F.count_if(F.col("kind") == OPPORTUNITY).alias("n_oportunidades"), strongest(OPPORTUNITY).alias("oportunidades"))
    size = overview.select(F.struct("filas", "columnas").alias("s")).scalar()
    points = score.select("score").scalar()
    full = one.withColumns({"_s": size, "score": points}).select(
        F.col("_s.filas").alias("filas"), F.col("_s.columnas").alias("columnas"), "score", "n_riesgos", "riesgos",
        "n_oportunidades", "oportunidades")
    text = F.concat(
        F.format_string("%,d registros y %d columnas; calidad %d de 100.", "filas", "columnas", "score"),
        F.when(F.size("oportunidades") > 0, F.concat(F.lit(" A favor: "), F.array_join("oportunidades", "; "), F.lit("."))).otherwise(""),
        F.when(F.size("riesgos") > 0, F.concat(F.lit(" Por atender: "), F.array_join("riesgos", "; "), F.lit("."))).otherwise(""))
    return full.withColumn("texto", text)


