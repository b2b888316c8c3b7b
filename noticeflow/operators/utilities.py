"""Per-notice rollups over an array of utility responses (struct: code, name, facility, row_status, last_response, ..., status)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.dates import days_until
from noticeflow.functions.status import REASON_ORDER, blocked_reason
from noticeflow.functions.text import strip

LATE_AFTER_HOURS = 72


def utility_rollup(df: DataFrame, now: Column, statuses: str = "utility_statuses") -> DataFrame:
    """Mark late utilities and add code lists and flags.

    A pending utility is late 72 hours after the call date began (UTC), unless
    the notice is cancelled or has no call date.  A notice is ready when it has
    utilities and all are clear or located.
    """
    overdue = F.coalesce((now > F.col("call_date").cast("timestamp") + F.expr(f"INTERVAL {LATE_AFTER_HOURS} HOURS")) & ~F.coalesce("is_cancelled", F.lit(False)), F.lit(False))
    given = F.coalesce(F.col(statuses), F.slice(F.col(statuses), 1, 0), F.array().cast(df.schema[statuses].dataType))
    marked = df.withColumn("__overdue", overdue).withColumn(
        statuses, F.transform(given, lambda s: s.withField("is_late", (s["status"] == "pending") & F.col("__overdue")))
    )
    codes = lambda test: F.transform(F.filter(F.col(statuses), test), lambda s: s["code"])
    return marked.withColumns({
        "has_late_utility": F.exists(statuses, lambda s: s["is_late"]),
        "late_utility_codes": codes(lambda s: s["is_late"]),
        "pending_utility_codes": codes(lambda s: s["status"] == "pending"),
        "blocking_utility_codes": codes(lambda s: s["status"].isin("delayed", "not_clear")),
        "is_ready_to_dig": (F.size(statuses) > 0) & F.forall(statuses, lambda s: s["status"].isin("clear", "located")),
    }).drop("__overdue")


def utility_summary(statuses: Column) -> Column:
    """'2 clear, 1 late (B01), 1 in conflict (MWS), 2 pending'; codes that are blank are passed over where codes are named."""
    all_ = F.coalesce(statuses, F.array())
    settled = lambda s: s["status"].isin("clear", "located")
    late = lambda s: ~settled(s) & F.coalesce(s["is_late"], F.lit(False))
    open_ = lambda s: ~settled(s) & ~F.coalesce(s["is_late"], F.lit(False))
    code = lambda s: strip(F.coalesce(s["code"], F.lit("")))

    def named(test, label: str) -> Column:
        found = F.transform(F.filter(all_, lambda s: test(s) & (code(s) != "")), code)
        return F.when(F.size(found) > 0, F.concat(F.size(found).cast("string"), F.lit(f" {label} ("), F.array_join(found, ", "), F.lit(")")))

    def counted(test, label: str) -> Column:
        n = F.size(F.filter(all_, test))
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {label}")))

    stuck = lambda reason: lambda s: open_(s) & s["status"].isin("delayed", "not_clear") & (blocked_reason(s["last_response"]) == reason)
    parts = [counted(settled, "clear"), named(late, "late"), *[named(stuck(r), r) for r in REASON_ORDER], counted(lambda s: open_(s) & (s["status"] == "pending"), "pending")]
    return F.concat_ws(", ", *parts)


def latest_response(history: Column) -> Column:
    """struct(last_response, response_count) of a list of responses in time order."""
    return F.struct(F.try_element_at(history, F.lit(-1)).alias("last_response"), F.size(F.coalesce(history, F.array().cast("array<string>"))).alias("response_count"))


def utility_detail(view: DataFrame, today: Column) -> DataFrame:
    """One row per utility of each notice that is not cancelled."""
    rows = view.where(~F.coalesce("is_cancelled", F.lit(False))).withColumn("u", F.explode("utility_statuses"))
    return rows.select(
        "ticket_number", "call_date", (-days_until(F.col("call_date"), today)).alias("days_since_call"), "county", "excavator_name",
        F.col("location_text").alias("address"), F.col("intersection_text").alias("intersection"), F.lit("").alias("place"), "done_for",
        F.col("u.code").alias("utility_code"), F.col("u.name").alias("utility_name"), F.col("u.facility").alias("facility"), F.col("u.status").alias("status"),
        F.col("u.last_response").alias("last_response"), F.col("u.response_timestamp").alias("response_timestamp"), F.col("u.is_late").alias("is_late"),
        F.col("is_cancelled").alias("ticket_is_cancelled"),
    )
