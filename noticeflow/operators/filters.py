"""Predicates (Columns) and filters; a null in a predicate's inputs never selects a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.text import normalize_text, strip


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def contains_any(c: Column, keywords: Sequence[str]) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for k in keywords:
        out = out | low.contains(k.lower())
    return out


def worth_detail_fetch(done_for: Column, work_type: Column, excavator: Column, keywords: Sequence[str], contractors: Sequence[str] = ()) -> Column:
    """A cheap test before the costly page step: keywords in done_for or work_type, contractors in excavator."""
    return contains_any(done_for, keywords) | contains_any(work_type, keywords) | contains_any(excavator, contractors)


def active_relevant() -> Column:
    return _yes(F.col("is_relevant")) & (F.col("status") == "active")


def not_cancelled() -> Column:
    return ~_yes(F.col("is_cancelled"))


def expiring_within(days: int, today: Column, expiry: str = "expiration_date") -> Column:
    """No lower bound: what has expired counts too."""
    return _yes(F.col(expiry) <= F.date_add(today, days))


def late() -> Column:
    return _yes(F.col("has_late_utility")) & not_cancelled()


def blocked() -> Column:
    return (F.size(F.coalesce("blocking_utility_codes", F.array().cast("array<string>"))) > 0) & not_cancelled()


def new_since_yesterday(today: Column) -> Column:
    return _yes(F.col("call_date") >= F.date_sub(today, 1)) & not_cancelled()


def cancelled_within(days: int, today: Column) -> Column:
    """By call date: no date of cancellation exists."""
    return _yes(F.col("is_cancelled")) & _yes(F.col("call_date") >= F.date_sub(today, days))


def needs_review() -> Column:
    return _yes(F.col("match_confidence") == "low") & not_cancelled()


def reminder_eligible(target: Column) -> Column:
    return _yes(F.col("is_relevant")) & _yes(F.col("expiration_date") == target) & ~F.col("status").isin("cancelled", "expired")


def list_filter(df: DataFrame, relevant_only: bool = False, status: str | None = None, county: str | None = None) -> DataFrame:
    if relevant_only:
        df = df.where(_yes(F.col("is_relevant")))
    if status:
        df = df.where(F.col("status") == status)
    if county:
        df = df.where(F.col("county").ilike(f"%{county}%"))
    return df


def viewer_filter(df: DataFrame, county: str = "", company: str = "", group: str = "", min_score: float = 0.0, status: str = "") -> DataFrame:
    """Case-insensitive substrings, a least score and a state; an empty filter keeps everything."""
    for column, wanted in (("county", county), ("probable_company", company), ("probable_work_group", group)):
        if wanted:
            df = df.where(F.lower(F.coalesce(F.col(column), F.lit(""))).contains(wanted.lower()))
    if min_score > 0:
        df = df.where(F.col("relevance_score") >= min_score)
    return df.where(F.col("status") == status) if status else df


def contractor_other(name: str) -> Column:
    return ~_yes(F.col("is_relevant")) & _yes(F.col("done_for").ilike(f"%{name}%"))


def missing_detail() -> Column:
    return _yes(F.col("is_relevant")) & F.col("source_html_path").isNull()


def has_coords() -> Column:
    return F.col("latitude").isNotNull() & F.col("longitude").isNotNull()


def open_failures() -> Column:
    return ~_yes(F.col("resolved"))


def enabled_counties(config: DataFrame, name: str = "") -> DataFrame:
    kept = config.where(_yes(F.col("enabled")))
    return kept.where(F.lower("name").contains(name.lower())) if name else kept


def usable_text(c: Column, least: int = 50) -> Column:
    return F.char_length(strip(F.coalesce(c, F.lit("")))) >= least


def domain_allowed(allowed: Column, customer: Column) -> Column:
    """An empty allow-list admits everyone."""
    return (F.size(allowed) == 0) | _yes(F.array_contains(allowed, customer))


def contractor_match(excavator: Column, contractors: Sequence[str]) -> Column:
    return contains_any(normalize_text(excavator), contractors)
