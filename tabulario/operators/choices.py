"""Columns chosen from profiles: for lists, charts and the business slots.

The profiles are a DataFrame of one row per column. A choice is a predicate and an order over it; the slots are a table
of such rules, ranked together by one window per slot.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulario.functions import fixed
from tabulario.operators.intake import rows
from tabulario.operators.profile import Profiles

_FRAME = "name string, position int, semantic string, role string, n bigint, n_unique bigint, unique_ratio double, mode string, width double"


def profile_rows(profiles: Profiles) -> DataFrame:
    """One row per column; `width` is the number of whole values from the lowest to the highest, null without statistics."""
    data = [
        (p.name, i, p.semantic, p.role, int(p.n), int(p.n_unique), float(p.unique_ratio), p.mode,
         float(p.stats["max"] - p.stats["min"] + 1) if p.stats and p.semantic == "numerico" else None)
        for i, p in enumerate(profiles.values())
    ]
    return rows(SparkSession.active(), data, _FRAME)


def chosen(profiles: Profiles, predicate: str, *order: str) -> list[str]:
    """Names of the columns that satisfy an SQL predicate, in the given order, then as they stand in the table."""
    found = profile_rows(profiles).where(predicate).orderBy(*[F.expr(o) for o in order], "position")
    return [r["name"] for r in found.select("name").collect()]  # one row per column


def _any_of(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def columns_by(profiles: Profiles, *semantics: str) -> list[str]:
    return chosen(profiles, f"semantic IN ({_any_of(semantics)})")


def columns_by_role(profiles: Profiles, *roles: str) -> list[str]:
    return chosen(profiles, f"role IN ({_any_of(roles)})")


#: Nearly distinct numbers that fill their range are running numbers, unless their role says they are amounts.
RUNNING_NUMBER = (
    "n > 50 AND unique_ratio > 0.99 AND coalesce(role, '') NOT IN ('monetario', 'cantidad', 'porcentaje') "
    "AND coalesce(width > 0 AND width <= 1.2D * n_unique, false)")


def metric_columns(profiles: Profiles) -> list[str]:
    """Numeric columns worth adding up, money and quantities first; running numbers are left out."""
    return chosen(
        profiles, f"semantic = 'numerico' AND coalesce(role, '') <> 'identificador' AND NOT ({RUNNING_NUMBER})",
        "NOT coalesce(role IN ('monetario', 'cantidad'), false)")


def date_columns(profiles: Profiles) -> list[str]:
    return columns_by(profiles, "fecha")


def dimension_columns(profiles: Profiles, max_values: int = 60) -> list[str]:
    """Columns to group by: two to `max_values` categories, fewest first."""
    return chosen(profiles, f"semantic IN ('categorico', 'booleano') AND n_unique BETWEEN 2 AND {max_values}", "n_unique")


def _spot(parts: list[str]) -> str:
    """SQL: place of the first of `parts` that the name contains; as many as there are parts if none is."""
    hits = ", ".join(f"contains(lower(name), {_any_of([p])})" for p in parts)
    return f"coalesce(nullif(array_position(array({hits}), true), 0) - 1, {len(parts)})"


def _named(parts: list[str]) -> str:
    return f"{_spot(parts)} < {len(parts)}"


@dataclass(frozen=True)
class Slot:
    """A business slot: which columns may fill it, which is best (smallest first), and whose column it may not take."""

    name: str
    able: str
    best: str = "0"
    apart_from: tuple[str, ...] = ()


_STATUS = "semantic IN ('categorico', 'booleano') AND n_unique <= 10 AND coalesce(role, '') <> 'geografia'"
_EXACT_STATUS = f"lower(name) IN ({_any_of(fixed.STATUS_EXACT_NAMES)}) AND coalesce({_named(fixed.STATUS_MODES).replace('lower(name)', 'lower(mode)')}, false)"
_MONEY = "role = 'monetario' AND semantic = 'numerico'"

#: In the order of the result; a slot that keeps apart from others is filled after them.
SLOTS = [
    Slot("fecha", "role = 'fecha' AND semantic = 'fecha'"),
    Slot("ingreso", _MONEY, _spot(fixed.INCOME_NAMES), ("costo",)),
    Slot("costo", f"{_MONEY} AND {_named(fixed.COST_NAMES)}", _spot(fixed.COST_NAMES)),
    Slot("cantidad", "role = 'cantidad' AND semantic = 'numerico'"),
    Slot("cliente", f"role IN ('persona', 'identificador') AND {_named(fixed.CLIENT_NAMES)}", "if(role = 'persona', 0, 1)"),
    Slot("producto", _named(fixed.PRODUCT_NAMES)),
    Slot("transaccion", "role = 'identificador' AND unique_ratio >= 0.9"),
    Slot("segmento", "semantic = 'categorico' AND n_unique BETWEEN 2 AND 30", apart_from=("cliente", "producto", "estatus")),
    Slot("estatus", f"{_STATUS} AND ({_named(fixed.STATUS_NAMES)} OR ({_EXACT_STATUS}))", f"if({_named(fixed.STATUS_NAMES)}, 0, 1)"),
]


def suggest_mapping(profiles: Profiles) -> dict[str, str | None]:
    """Column proposed for each business slot; None where no column will do."""
    frame = profile_rows(profiles)
    able = frame.select("name", "position", F.explode(F.filter(F.array(*[
        F.when(F.expr(s.able), F.struct(F.lit(s.name).alias("slot"), F.expr(s.best).cast("int").alias("best"))) for s in SLOTS
    ]), lambda x: x.isNotNull())).alias("s")).select("name", "position", "s.*")
    place = F.row_number().over(W.partitionBy("slot").orderBy("best", "position"))
    kept_apart = {s.name: s.apart_from for s in SLOTS if s.apart_from}
    free = able.where(~F.col("slot").isin(*kept_apart)).withColumn("k", place).where("k = 1").select("slot", "name")
    of = F.create_map(*[x for s, others in kept_apart.items() for x in (F.lit(s), F.array(*map(F.lit, others)))])
    taken = free.select(F.col("slot").alias("_owner"), F.col("name").alias("_taken"))
    apart = able.where(F.col("slot").isin(*kept_apart)).join(
        F.broadcast(taken), (F.col("name") == F.col("_taken")) & F.array_contains(F.element_at(of, F.col("slot")), F.col("_owner")), "left_anti"
    ).withColumn("k", place).where("k = 1").select("slot", "name")
    found = {r["slot"]: r["name"] for r in free.unionByName(apart).collect()}  # at most one row per slot
    return {s.name: found.get(s.name) for s in SLOTS}
