"""States, buckets and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow.functions.text import SPACES, strip

#: Fixed values: (row status, last response) -> state of a utility.
UTILITY_STATES = [
    ("open", None, "pending"),
    ("open", "locate delayed", "delayed"),
    ("open", "cannot locate - contact utility", "not_clear"),
    ("open", "clear - no conflict", "clear"),
    ("closed", "clear - no conflict", "clear"),
    ("closed", "no marking needed", "clear"),
    ("closed", "utility generated ticket - self locate", "clear"),
    ("closed", "located to meter only", "clear"),
    ("closed", "located - facilities marked", "located"),
    ("closed", "locate delayed", "delayed"),
    ("closed", "in conflict", "not_clear"),
    ("closed", "no response", "not_clear"),
]
#: Response -> reason shown for a blocked utility, and the order of reasons.
BLOCKED_REASONS = {
    "locate delayed": "delayed",
    "in conflict": "in conflict",
    "cannot locate - contact utility": "cannot locate",
    "no response": "no response",
}
REASON_ORDER = ["in conflict", "cannot locate", "no response", "delayed", "blocked"]
#: Reserved colours that a name's colour keeps away from.
RESERVED_RGB = [(255, 0, 0), (255, 165, 0), (0, 0, 255), (128, 128, 128), (0, 255, 0), (255, 255, 0), (255, 69, 0), (139, 0, 0), (128, 0, 128), (255, 255, 255), (0, 0, 0)]
RESERVED_DISTANCE = 80.0
FALLBACK_RGB = "6464c8"
#: Labels of failure reasons.
FAILURE_LABELS = {
    "pdf_download_failed": "PDF download failed",
    "pdf_parse_error": "PDF parse error",
    "missing_required_fields": "Missing required fields",
    "html_parse_error": "HTML parse error",
    "unknown": "Unknown error",
}


def tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), SPACES, " "))


def lookup(table: dict[str, str], key: Column, default: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def utility_status(row_status: Column, response: Column) -> Column:
    """State of a utility from its row status and last response; a missing or empty response is a key of its own, one of white space is unknown."""
    key = F.concat_ws("|", F.lower(strip(row_status)), F.when(F.coalesce(response, F.lit("")) == "", "∅").otherwise(tidy(response)))
    return lookup({f"{s}|{r or '∅'}": state for s, r, state in UTILITY_STATES}, key, F.lit("unknown"))


def blocked_reason(response: Column) -> Column:
    return lookup(BLOCKED_REASONS, tidy(F.coalesce(response, F.lit(""))), F.lit("blocked"))


def failure_label(reason: Column) -> Column:
    return lookup(FAILURE_LABELS, reason, reason)


def derive_status(cancelled: Column, expiry: Column, today: Column) -> Column:
    return F.when(cancelled, "cancelled").when(expiry.isNull(), "unknown").when(expiry < today, "expired").otherwise("active")


def display_status(cancelled: Column, expiry: Column, today: Column, soon: int = 7) -> Column:
    return (
        F.when(cancelled, "cancelled").when(expiry.isNull(), "unknown").when(expiry < today, "expired")
        .when(expiry <= F.date_add(today, soon), "expiring_soon").otherwise("active")
    )


URGENCY = ["No expire date", "Expiring ≤ 4 days", "Expiring 5–7 days", "Expiring 8+ days"]
UTILITY_BUCKETS = ["Blocked — conflict/other", "Blocked — delayed", "Has late utilities", "Ready to dig", "Pending utilities"]


def urgency_bucket(days: Column) -> Column:
    return F.when(days.isNull(), URGENCY[0]).when(days <= 4, URGENCY[1]).when(days <= 7, URGENCY[2]).otherwise(URGENCY[3])


def viewer_urgency(days: Column) -> Column:
    return (
        F.when(days.isNull(), "unknown").when(days < 0, "expired").when(days <= 4, "critical").when(days <= 7, "warning")
        .when(days <= 14, "upcoming").otherwise("ok")
    )


def score_band(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").when(score >= 0.3, "low").otherwise("minimal")


def utility_bucket(statuses: Column, late: Column, ready: Column) -> Column:
    """The most severe state of a notice: conflict, delayed, late, ready, else pending."""
    stuck = F.filter(F.coalesce(statuses, F.array()), lambda s: s["status"].isin("delayed", "not_clear"))
    reasons = F.transform(stuck, lambda s: blocked_reason(s["last_response"]))
    return (
        F.when(F.exists(reasons, lambda r: r.isin("in conflict", "cannot locate", "no response")), UTILITY_BUCKETS[0])
        .when(F.array_contains(reasons, "delayed"), UTILITY_BUCKETS[1])
        .when(late, UTILITY_BUCKETS[2]).when(ready, UTILITY_BUCKETS[3]).otherwise(UTILITY_BUCKETS[4])
    )


def is_problem(late: Column, blocking: Column) -> Column:
    return F.coalesce(late, F.lit(False)) | (F.size(F.coalesce(blocking, F.array())) > 0)


def lifecycle_bucket(status: Column, act_end: Column, today: Column, recent_days: int = 30) -> Column:
    """recent (ended in the last days) before started before committed; anything else is active."""
    recent = (act_end >= F.date_sub(today, recent_days)) & (act_end <= today)
    low = F.lower(F.coalesce(status, F.lit("")))
    return F.when(recent, "recent").when(low == "started", "active").when(low == "committed", "committed").otherwise("active")


def confidence(distance: Column) -> Column:
    return F.when(distance <= 25, "high").when(distance <= 75, "medium").when(distance <= 150, "low").otherwise("none")


def stable_color(name: Column, tries: int = 65) -> Column:
    """Colour (bbggrr) of a name: the first seeded MD5 that is far from every reserved colour."""

    def far(code: Column) -> Column:
        rgb = [F.conv(F.substring(code, i, 2), 16, 10).cast("int") for i in (1, 3, 5)]
        apart = [sum((a - b) * (a - b) for a, b in zip(rgb, reserved)) >= RESERVED_DISTANCE**2 for reserved in RESERVED_RGB]
        out = apart[0]
        for more in apart[1:]:
            out = out & more
        return out

    codes = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda seed: F.left(F.md5(F.concat_ws("|", name, seed.cast("string")).cast("binary")), F.lit(6)))
    rgb = F.coalesce(F.try_element_at(F.filter(codes, far), F.lit(1)), F.lit(FALLBACK_RGB))
    return F.concat(F.substring(rgb, 5, 2), F.substring(rgb, 3, 2), F.substring(rgb, 1, 2))


def apply_alpha(color: Column, alpha: float) -> Column:
    """aabbggrr with a new alpha."""
    return F.concat(F.lit(f"{max(0, min(255, round(alpha * 255))):02x}"), F.right(color, F.lit(6)))
