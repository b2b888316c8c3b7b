"""Date and number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow.functions.text import strip

#: Month names, full and short.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
EXPORT_ZONE = "America/Chicago"


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")


def parse_date(c: Column) -> Column:
    """A date found in text: M/D/YYYY, YYYY-MM-DD, M/D/YY (20YY), 'June 1, 2024'; the first form that is a real date wins."""

    def part(pattern: str, *order: int) -> list[Column]:
        return [F.regexp_extract(c, pattern, i) for i in order]

    # fixed values: the forms of a date
    us, iso, short, words = r"(\d{1,2})/(\d{1,2})/(\d{4})", r"(\d{4})-(\d{2})-(\d{2})", r"(\d{1,2})/(\d{1,2})/(\d{2})(?!\d)", r"([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})"
    y2, m2, d2 = part(short, 3, 1, 2)
    y4, name, d4 = part(words, 3, 1, 2)
    names = F.array(*map(F.lit, MONTHS))
    shorts = F.array(*[F.lit(m[:3]) for m in MONTHS])
    low = F.lower(name)
    month = F.greatest(F.array_position(names, low), F.array_position(shorts, low))
    return F.coalesce(_day(*part(us, 3, 1, 2)), _day(*part(iso, 1, 2, 3)), _day(F.concat(F.lit("20"), y2), m2, d2), _day(y4, month.cast("string"), d4))


def parse_date_layered(*candidates: Column) -> Column:
    return F.coalesce(*[parse_date(c) for c in candidates])


def parse_iso_date(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))


def parse_float(c: Column) -> Column:
    plain = strip(c)
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))


def epoch_ms_to_date(c: Column) -> Column:
    """UTC date of epoch milliseconds given as text or number; blank or bad gives null."""
    return F.to_date(F.timestamp_millis(strip(c.cast("string")).try_cast("bigint")))


def local_date(ts: Column, zone: str = EXPORT_ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def target_date(now: Column, lead_days: int = 4, zone: str = EXPORT_ZONE) -> Column:
    return F.date_add(local_date(now, zone), lead_days)


def days_until(day: Column, today: Column) -> Column:
    return F.date_diff(day, today)


def days_until_ceil(day: Column, now: Column) -> Column:
    """Days from now to the start of a day, rounded up."""
    return F.ceil((F.unix_micros(day.cast("timestamp")) - F.unix_micros(now)) / F.lit(86_400_000_000)).cast("int")


def time_ago(ts: Column, now: Column) -> Column:
    seconds = F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 1_000_000)
    minutes, hours, days = (F.floor(seconds / n) for n in (60, 3600, 86400))
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(ts.isNull(), "unknown").when(minutes < 1, "just now").when(minutes < 60, said(minutes, "m")).when(hours < 24, said(hours, "h")).otherwise(said(days, "d"))


def format_day(c: Column) -> Column:
    """'Apr 8, 2026' in the export zone, or a dash without a date; a date is its midnight in UTC."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(c.cast("timestamp"), EXPORT_ZONE), "MMM d, yyyy"), F.lit("—"))


def fmt_date(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))


def fmt_date_or_null(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def fmt_bool(c: Column) -> Column:
    return F.when(c, "TRUE").otherwise("FALSE")


def fmt_size(c: Column) -> Column:
    return (
        F.when(c < 1024, F.format_string("%d B", c.cast("long")))
        .when(c < 1024 * 1024, F.format_string("%.1f KB", F.bround(c / 1024.0, 1)))
        .otherwise(F.format_string("%.1f MB", F.bround(c / (1024.0 * 1024.0), 1)))
    )
