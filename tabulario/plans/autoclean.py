"""Diagnose, repair what is safe, diagnose again and propose the business columns."""
from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame

from tabulario.operators.choices import suggest_mapping
from tabulario.operators.profile import Profiles, profile
from tabulario.operators.quality import detect_issues
from tabulario.operators.repair import Plan, apply_plan, plan_from_issues
from tabulario.session import held


@dataclass
class Cleaned:
    """What an automatic cleaning leaves behind; `raw` is never altered."""

    raw: DataFrame
    issues: DataFrame
    plan: Plan
    table: DataFrame
    log: DataFrame | None
    profiles: Profiles
    mapping: dict[str, str | None]


def auto_clean(df: DataFrame, row_id: str | None = None, as_of: date | None = None) -> Cleaned:
    with held(df):  # read by every rule and every repair
        issues = detect_issues(df, None, row_id, as_of)
        plan = plan_from_issues(issues)
        if plan.is_empty():
            clean, log = df, None
        else:
            repaired = apply_plan(df, plan, row_id)
            clean, log = repaired.table, repaired.log
        with held(clean):
            found = profile(clean.drop(row_id) if row_id else clean)
    return Cleaned(df, issues, plan, clean, log, found, suggest_mapping(found))
