"""Repairs in a fixed order under an audit log.

Order: drop columns, empty rows, broken text, spaces, spellings, to number, to date, impossible
dates, missing values, extremes, repeated rows, column names. Each step is a lazy projection,
filter or join; the figures a step needs (medians, quartiles, canonical spellings) come from one
small job before it.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulario.functions import text
from tabulario.operators import quantiles as Q
from tabulario.operators.copies import without_copies
from tabulario.operators.intake import col, dtype_of, instant, is_number, is_text, number, present, rows
from tabulario.operators.values import value_counts
from tabulario.session import materialize

FIRST_VALID_DATE = "1950-01-01 00:00:00"
LOG = "step int, action string, `column` string, n_affected bigint, detail string"


@dataclass
class Plan:
    """What to repair. Lists hold column names; maps go from column to method."""

    drop_columns: list[str] = field(default_factory=list)
    drop_empty_rows: bool = False
    fix_mojibake: list[str] = field(default_factory=list)
    trim: list[str] = field(default_factory=list)
    normalize_categories: list[str] = field(default_factory=list)
    to_numeric: list[str] = field(default_factory=list)
    to_datetime: list[str] = field(default_factory=list)
    null_dates: list[str] = field(default_factory=list)
    impute: dict[str, str] = field(default_factory=dict)  # mediana media moda cero desconocido ffill eliminar_filas
    clip_outliers: dict[str, str] = field(default_factory=dict)  # iqr or p1p99
    drop_duplicates: bool = False
    snake_case: bool = False

    def is_empty(self) -> bool:
        return self == Plan()


def plan_from_issues(issues: DataFrame, aggressive: bool = False) -> Plan:
    """The plan that the issues ask for. Safe by default: nothing that changes what the data mean."""
    plan = Plan()
    lists = {"trim": plan.trim, "fix_mojibake": plan.fix_mojibake, "normalize_categories": plan.normalize_categories,
             "to_numeric": plan.to_numeric, "to_datetime": plan.to_datetime, "null_dates": plan.null_dates}
    for r in issues.where("fix is not null").select("code", "column", "fix").collect():
        fix, column = r["fix"], r["column"]
        if fix == "drop_duplicates":
            plan.drop_duplicates = True
        elif fix == "drop_empty_rows":
            plan.drop_empty_rows = True
        elif column is None:
            continue
        elif fix in lists:
            lists[fix].append(column)
        elif fix == "drop_column" and (aggressive or r["code"] == "columna_vacia"):
            plan.drop_columns.append(column)
        elif fix == "impute" and aggressive:
            plan.impute[column] = "mediana"
        elif fix == "clip_outliers" and aggressive:
            plan.clip_outliers[column] = "iqr"
    return plan


# --- single repairs ----------------------------------------------------------------------


def _is_empty(df: DataFrame, keep: tuple[str, ...] = ()) -> Column:
    nothing = F.lit(True)
    for c in df.columns:
        if c not in keep:
            nothing = nothing & ~present(df, c)
    return nothing


def drop_empty_rows(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Without the rows where every column (but those in `keep`) is missing."""
    return df.where(~_is_empty(df, keep))


def set_text(df: DataFrame, column: str, f: Callable[[Column], Column]) -> DataFrame:
    return df.withColumn(column, f(col(column))) if is_text(dtype_of(df, column)) else df


def canonical_spellings(df: DataFrame, column: str) -> DataFrame:
    """(key, value, canonical) for spellings that are not the most frequent one of their key; ties to the smallest."""
    counts = value_counts(df, [column]).select("value", "n", text.norm_key(F.col("value")).alias("key"))
    best = counts.groupBy("key").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("canonical"))
    return counts.join(best, "key").where("value <> canonical").select("key", "value", "canonical")


def unify_categories(df: DataFrame, column: str) -> DataFrame:
    """Replace each spelling by the most frequent one of its key.

    The lookup has only spellings that change and is found once. It is left to Spark to broadcast it when its measured
    size allows, and to split a hot value when not.
    """
    lookup = materialize(canonical_spellings(df, column).select(F.col("value").alias("_from"), F.col("canonical").alias("_to")))
    return (
        df.join(lookup, col(column) == F.col("_from"), "left")
        .withColumn(column, F.coalesce("_to", col(column)))
        .select(*[col(c) for c in df.columns])
    )


def void_dates(df: DataFrame, column: str) -> DataFrame:
    """Dates before 1950 become null; so does text that is not a date."""
    d = instant(df, column)
    return df.withColumn(column, F.when(d >= F.lit(FIRST_VALID_DATE).cast("timestamp_ntz"), d))


def fill_value(df: DataFrame, column: str, method: str) -> object:
    """The value that a filling method gives for the column; None when it does not apply."""
    if method == "cero":
        return 0
    if method == "desconocido":
        return "DESCONOCIDO"
    if method == "moda":
        return df.where(present(df, column)).groupBy(col(column).alias("v")).count().agg(
            F.min_by("v", F.struct(-F.col("count"), F.col("v")))).head()[0]
    if not is_number(dtype_of(df, column)):
        return None
    typed = df.select(number(df, column).alias("v"))
    return Q.quantiles(typed, "v", [0.5])[0] if method == "mediana" else typed.agg(F.avg("v")).head()[0]


def _shown(value: object) -> str:
    """A filling value in the log: numbers with two decimals, those that would read as zero in full."""
    return f"{value:.2f}" if isinstance(value, float) and (value == 0 or abs(value) >= 0.005) else str(value)


def fill(df: DataFrame, column: str, value: object) -> DataFrame:
    """Missing cells take `value`; a number goes into a text column as text and the reverse makes the column text."""
    dtype = dtype_of(df, column)
    if isinstance(value, str) and not is_text(dtype):
        kept = F.when(present(df, column), col(column).cast("string"))
        return df.withColumn(column, F.coalesce(kept, F.lit(value)))
    if isinstance(dtype, T.IntegralType) and isinstance(value, float) and value != int(value):
        dtype = T.DoubleType()
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)) and isinstance(value, int):
        return df
    return df.withColumn(column, F.coalesce(F.when(present(df, column), col(column).cast(dtype)), F.lit(value).cast(dtype)))


def carry_forward(df: DataFrame, columns: str | list[str], order_by: str, partition_by: list[str] | None = None) -> DataFrame:
    """Missing cells of `columns` take the previous value in row order, and the first cells the next one.

    Rows are split into ranges of `order_by`, of any type, once for all columns; the windows run inside each range, and
    what enters a range comes from the ranges beside it. Rows that are equal in `order_by` follow a hash of all their
    cells, so a frequent order value is split too.
    """
    columns = [columns] if isinstance(columns, str) else list(dict.fromkeys(columns))
    keys = list(partition_by or [])
    values = [F.when(present(df, c), col(c)) for c in columns]
    ranged = Q.ranges(df.withColumn("_tie", F.xxhash64(*[col(c) for c in df.columns])), col(order_by), "_tie")
    w = W.partitionBy(*keys, "_range").orderBy(order_by, "_tie").rowsBetween(W.unboundedPreceding, 0)
    # reading backwards is linear; a frame that ends at the last row would be quadratic
    back = W.partitionBy(*keys, "_range").orderBy(F.desc(order_by), F.desc("_tie")).rowsBetween(W.unboundedPreceding, 0)
    local = ranged.withColumns({f"_back{i}": F.last(v, True).over(w) for i, v in enumerate(values)}).withColumns(
        {f"_ahead{i}": F.last(v, True).over(back) for i, v in enumerate(values)})
    at = F.struct(F.col(order_by), F.col("_tie"))
    ends = ranged.groupBy(*keys, "_range").agg(*[  # one row per key and range
        a for i, v in enumerate(values) for a in (
            F.max_by(v, F.when(v.isNotNull(), at)).alias(f"_last{i}"), F.min_by(v, F.when(v.isNotNull(), at)).alias(f"_first{i}"))])
    b = W.partitionBy(*keys).orderBy("_range")
    edges = ends.select(*keys, "_range", *[
        a for i in range(len(columns)) for a in (
            F.last(f"_last{i}", True).over(b.rowsBetween(W.unboundedPreceding, -1)).alias(f"_before{i}"),
            F.first(f"_first{i}", True).over(b.rowsBetween(1, W.unboundedFollowing)).alias(f"_after{i}"))])
    return (
        _null_safe(local, edges, [*keys, "_range"])
        .withColumns({c: F.coalesce(f"_back{i}", f"_before{i}", f"_ahead{i}", f"_after{i}") for i, c in enumerate(columns)})
        .select(*[col(c) for c in df.columns])
    )


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which a missing key is a key like any other."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, condition, "left").drop(*[f"_r_{k}" for k in keys])


def clip_bounds(df: DataFrame, column: str, method: str = "iqr") -> tuple[float, float]:
    typed = df.select(number(df, column).alias("v"))
    if method == "p1p99":
        low, high = Q.quantiles(typed, "v", [0.01, 0.99])
        return low, high
    q1, q3 = Q.quantiles(typed, "v", [0.25, 0.75])
    return q1 - 3 * (q3 - q1), q3 + 3 * (q3 - q1)


def clip(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    v = number(df, column)
    return df.withColumn(column, F.when(v < low, F.lit(low)).when(v > high, F.lit(high)).otherwise(v))


def snake_names(columns: list[str]) -> dict[str, str]:
    """Column -> name in lower case without accents; repeats get a numbered suffix."""
    import re
    import unicodedata

    seen: dict[str, int] = {}
    names = {}
    for c in columns:
        plain = "".join(ch for ch in unicodedata.normalize("NFD", c) if unicodedata.category(ch) != "Mn")
        base = re.sub(r"_+", "_", re.sub(r"\W+", "_", plain.lower().strip())).strip("_") or "columna"
        n = seen[base] = seen.get(base, -1) + 1
        names[c] = f"{base}_{n}" if n else base
    return names


def rename_snake_case(df: DataFrame) -> DataFrame:
    return df.toDF(*snake_names(df.columns).values())


# --- the plan ----------------------------------------------------------------------------


@dataclass
class Repaired:
    """The repaired table and its audit log, both frames."""

    table: DataFrame
    log: DataFrame


class _Tracked:
    """A table under repair. Each step may flag the rows it touches; the flags are counted together later."""

    def __init__(self, df: DataFrame, keep: tuple[str, ...]):
        self.df, self.keep = df, keep
        self.log: list[list] = []
        self.pending: dict[str, int] = {}

    def note(self, action: str, column: str | None, n: int | None = None, detail: str = "") -> None:
        self.log.append([len(self.log) + 1, action, column, n, detail])

    def flag(self, test: Column) -> None:
        """The last note counts the rows that pass `test` now, before the step changes them."""
        name = f"_flag{len(self.log)}"
        self.df = self.df.withColumn(name, test)
        self.pending[name] = len(self.log) - 1

    def settle(self, more: dict[str, Column] | None = None) -> dict[str, int]:
        """Count all pending flags, and `more`, in one job."""
        tests = {**{name: F.col(name) for name in self.pending}, **(more or {})}
        found = dict(zip(tests, self.df.agg(*[F.count_if(t) for t in tests.values()]).head())) if tests else {}
        for name, i in self.pending.items():
            self.log[i][3] = found[name]
        self.df = self.df.drop(*self.pending)
        self.pending = {}
        return found

    def has(self, columns: list[str]) -> list[str]:
        return [c for c in columns if c in self.df.columns]


def apply_plan(df: DataFrame, plan: Plan, row_id: str | None = None) -> Repaired:
    """Apply the plan in its fixed order. `row_id` orders the rows for carrying values forward; it is never altered.

    The log's figures come from three jobs at most, plus one per filled or clipped column.
    """
    keep = (row_id,) if row_id else ()
    t = _Tracked(df, keep)
    width = len(df.columns) - len(keep)
    for c in t.has(plan.drop_columns):
        t.df = t.df.drop(c)
        t.note("eliminar_columna", c)
    size = t.df.agg(F.count(F.lit(1)).alias("n"), F.count_if(_is_empty(t.df, keep)).alias("empty")).head()
    start = left = size["n"]
    if plan.drop_empty_rows:
        t.df = drop_empty_rows(t.df, keep)
        left -= size["empty"]
        t.note("eliminar_filas_vacias", None, size["empty"])
    for c in t.has(plan.fix_mojibake):
        t.note("reparar_codificacion", c)
        t.flag(text.has_mojibake(col(c)) if is_text(dtype_of(t.df, c)) else F.lit(False))
        t.df = set_text(t.df, c, text.fix_mojibake)
    for c in t.has(plan.trim):
        t.note("recortar_espacios", c)
        t.flag(text.collapse_spaces(col(c)) != col(c) if is_text(dtype_of(t.df, c)) else F.lit(False))
        t.df = set_text(t.df, c, text.collapse_spaces)
    for c in t.has(plan.normalize_categories):
        t.note("unificar_categorias", c)
        t.df = t.df.withColumn("_before", col(c))
        t.df = unify_categories(t.df, c)
        t.flag(F.col("_before") != col(c))
        t.df = t.df.drop("_before")
    for c in t.has([*plan.to_numeric, *plan.to_datetime]):
        numeric = c in plan.to_numeric
        new = number(t.df, c) if numeric else instant(t.df, c)
        t.note("a_numero" if numeric else "a_fecha", c, detail="valores que quedaron nulos")
        t.flag(present(t.df, c) & new.isNull())
        t.df = t.df.withColumn(c, new)
    for c in t.has(plan.null_dates):
        t.note("vaciar_fechas", c)
        t.flag(instant(t.df, c) < F.lit(FIRST_VALID_DATE).cast("timestamp_ntz"))
        t.df = void_dates(t.df, c)
    fills = {c: m for c, m in plan.impute.items() if c in t.df.columns and m != "nada"}
    missing = t.settle({c: ~present(t.df, c) for c in fills})
    carried: set[str] = set()
    for c, method in fills.items():
        if not missing[c]:
            continue
        if method == "eliminar_filas":
            t.df = t.df.where(present(t.df, c))
            t.note("imputar", c, missing[c], method)
            left -= missing[c]
            missing = t.settle({x: ~present(t.df, x) for x in fills})
            continue
        detail = method
        if method == "ffill":
            if row_id is None:
                raise ValueError("ffill needs row_id: Spark rows have no order of their own")
            if c not in carried:  # with it every later column that no removal of rows comes before
                together = _until_removal(fills, c, missing)
                t.df = carry_forward(t.df, together, row_id)
                carried.update(together)
        else:
            value = fill_value(t.df, c, method)
            if value is None:
                continue
            t.df = fill(t.df, c, value)
            detail = f"{method}={_shown(value)}"
        t.note("imputar", c, missing[c], detail)
    for c, method in plan.clip_outliers.items():
        if c in t.df.columns and is_number(dtype_of(t.df, c)):
            low, high = clip_bounds(t.df, c, method)
            t.note("acotar", c, detail=f"[{low:.6g}, {high:.6g}]")
            t.flag(~number(t.df, c).between(low, high))
            t.df = clip(t.df, c, low, high)
    t.settle()
    if plan.drop_duplicates:
        t.df, n = without_copies(t.df, row_id)
        t.note("eliminar_duplicadas", None, n)
        left -= n
    if plan.snake_case:
        names = snake_names([c for c in t.df.columns if c not in keep])
        t.df = t.df.withColumnsRenamed(names)
        t.note("nombres_snake_case", None, sum(a != b for a, b in names.items()))
    t.note("resultado", None, start - left, f"{start}x{width} -> {left}x{len(t.df.columns) - len(keep)}")
    return Repaired(t.df, rows(df.sparkSession, [tuple(entry) for entry in t.log], LOG))


def _until_removal(fills: dict[str, str], start: str, missing: dict[str, int]) -> list[str]:
    """The columns to carry forward from `start` on, up to the next step that removes rows."""
    order = list(fills)
    together = []
    for c in order[order.index(start):]:
        if fills[c] == "eliminar_filas" and missing[c]:
            break
        if fills[c] == "ffill" and missing[c]:
            together.append(c)
    return together
