"""Normalised records, export views, rollups and ordered lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.functions import dates as D
from noticeflow.functions import status as S
from noticeflow.functions import text as T
from noticeflow.operators import filters as P
from noticeflow.operators.utilities import utility_rollup, utility_summary
from noticeflow.scratch import Scratch

#: Columns of the exports, in order.
MASTER_COLUMNS = [
    "ticket_number", "call_date", "legal_start_date", "expire_date", "days_until_expire", "county", "excavator_name", "caller_name", "caller_phone",
    "work_type", "address", "intersection", "place", "done_for", "is_ready_to_dig", "has_late_utility", "late_utility_codes", "blocking_utility_codes",
    "pending_utility_codes", "utility_summary", "is_cancelled", "status", "remarks", "latitude", "longitude",
]
DASHBOARD_COLUMNS = [
    "ticket_number", "county", "state", "call_date", "legal_start_date", "expiration_date", "excavator_name", "caller_name", "work_type", "location_text",
    "remarks", "done_for", "utility_codes", "status", "is_cancelled", "relevance_score", "relevance_reasons", "is_relevant", "probable_company",
    "probable_work_group", "probable_crew", "parsed_at", "updated_at",
]
REVIEW_COLUMNS = [
    "ticket_number", "call_date", "expire_date", "days_until_expire", "county", "excavator_name", "address", "intersection", "latitude", "longitude",
    "candidate_project_name", "distance_m", "done_for", "utility_summary", "remarks",
]
UTILITY_STRUCT = "array<struct<code:string,name:string,facility:string,row_status:string,last_response:string,response_timestamp:string,response_count:int,notes:string,status:string>>"


def _have(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def normalize_tickets(rows: DataFrame, details: DataFrame, now: Column) -> DataFrame:
    """One canonical record per export row; where both have a value the detail page wins.

    `rows` has the raw strings of the export, `details` (at most one row per
    ticket_number) mapped page fields, utility_statuses, utility_codes and
    is_cancelled.  Every record gets rollups, a state as of `now` (UTC) and a
    parse_method of html or row_only.
    """
    page = details.select(F.col("ticket_number").alias("__key"), F.struct(*[F.col(c) for c in details.columns if c != "ticket_number"]).alias("d"))
    fields = set(details.columns)
    joined = rows.join(page, rows["ticket_number"] == page["__key"], "left")
    d = lambda name, kind="string": F.col(f"d.{name}") if name in fields else F.lit(None).cast(kind)
    r = lambda name: _have(rows, name)
    text = lambda page_name, row_name=None: T.clean_str(T.best_str(d(page_name), r(row_name) if row_name else F.lit(None).cast("string")))
    cancelled = F.coalesce(d("is_cancelled", "boolean"), F.lit(False)) | T.looks_cancelled(r("status_raw"))
    out = joined.select(
        T.ticket_key(F.col("ticket_number")).alias("ticket_number"), F.col("county"), _have(rows, "state").alias("state"),
        D.parse_date_layered(d("call_date"), r("call_date_raw")).alias("call_date"),
        D.parse_date_layered(d("legal_start_date"), r("legal_start_date_raw")).alias("legal_start_date"),
        D.parse_date_layered(d("expiration_date"), r("expiration_date_raw")).alias("expiration_date"),
        text("excavator_name", "excavator_name_raw").alias("excavator_name"), text("caller_name").alias("caller_name"), text("caller_phone").alias("caller_phone"),
        text("work_type", "work_type_raw").alias("work_type"), text("location_text").alias("location_text"), text("intersection_text").alias("intersection_text"),
        text("remarks", "remarks_raw").alias("remarks"), text("done_for", "work_done_for_raw").alias("done_for"),
        *[D.parse_float(d(c)).alias(c) for c in ("latitude", "longitude", "secondary_latitude", "secondary_longitude")],
        F.coalesce(d("utility_codes", "array<string>"), F.array().cast("array<string>")).alias("utility_codes"),
        F.coalesce(d("utility_statuses", UTILITY_STRUCT), F.array().cast(UTILITY_STRUCT)).alias("utility_statuses"),
        cancelled.alias("is_cancelled"), now.alias("parsed_at"),
        F.when(F.col("__key").isNotNull(), "html").otherwise("row_only").alias("parse_method"),
    )
    out = utility_rollup(out, now)
    return out.withColumn("status", S.derive_status(F.col("is_cancelled"), F.col("expiration_date"), F.to_date(now)))


def refresh_status(df: DataFrame, today: Column) -> DataFrame:
    return df.withColumn("status", S.derive_status(F.col("is_cancelled"), F.col("expiration_date"), today))


def ticket_view(df: DataFrame, today: Column) -> DataFrame:
    """The flat view that all exports share: days left, shown state, summary; null texts become ''."""
    words = [c for c in ("county", "excavator_name", "caller_name", "caller_phone", "work_type", "done_for", "remarks") if c in df.columns]
    return df.withColumns(
        {c: F.coalesce(c, F.lit("")) for c in words}
        | {
            "expire_date": F.col("expiration_date"),
            "days_until_expire": D.days_until(F.col("expiration_date"), today),
            "address": F.coalesce(_have(df, "location_text"), F.lit("")),
            "intersection": F.coalesce(_have(df, "intersection_text"), F.lit("")),
            "place": F.lit(""),
            "utility_summary": utility_summary(F.col("utility_statuses")),
            "status": S.display_status(F.col("is_cancelled"), F.col("expiration_date"), today),
        }
    )


def master_rows(view: DataFrame) -> DataFrame:
    """25 ordered text columns: ISO dates, TRUE/FALSE, comma-joined lists, six decimals, '' for null."""

    def shown(name: str) -> Column:
        kind = view.schema[name].dataType.typeName()
        c = F.col(name)
        if kind == "date":
            return D.fmt_date(c)
        if kind == "boolean":
            return D.fmt_bool(c)
        if kind == "array":
            return F.coalesce(F.array_join(c, ", "), F.lit(""))
        if kind == "double":
            return F.coalesce(F.format_string("%.6f", c), F.lit("")) if name in ("latitude", "longitude") else F.coalesce(c.cast("string"), F.lit(""))
        return F.coalesce(c.cast("string"), F.lit(""))

    guard = lambda name: F.when(F.col(name).isNull(), F.lit("")).otherwise(shown(name)) if view.schema[name].dataType.typeName() == "double" else shown(name)
    return view.select(*[guard(c).alias(c) for c in MASTER_COLUMNS])


def dashboard_rows(df: DataFrame, contact: bool = False) -> DataFrame:
    """The public projection; the caller's name only on request."""
    return df.select(*[_have(df, c).alias(c) for c in DASHBOARD_COLUMNS if contact or c != "caller_name"])


def review_rows(view: DataFrame) -> DataFrame:
    """Notices with a weak project match, nearest first."""
    rows = view.where(P.needs_review())
    return rows.withColumns({"candidate_project_name": F.col("project_name"), "distance_m": F.format_string("%.1f", F.col("match_distance_m"))}).select(*REVIEW_COLUMNS)


def reparse_update(current: DataFrame, details: DataFrame) -> DataFrame:
    """Update policy for pages parsed again: rollups always, places when not blank, legal start only if missing, coordinates when present."""
    always = ["utility_statuses", "utility_codes", "is_ready_to_dig", "has_late_utility", "late_utility_codes", "pending_utility_codes", "blocking_utility_codes"]
    page = details.select(F.col("ticket_number"), F.struct(*[c for c in details.columns if c != "ticket_number"]).alias("d"))
    joined = current.join(page, "ticket_number", "left")
    seen = F.col("d").isNotNull()
    new = {c: F.when(seen, F.col(f"d.{c}")).otherwise(F.col(c)) for c in always if c in details.columns and c in current.columns}
    for c in ("location_text", "intersection_text"):
        if c in details.columns:
            new[c] = F.coalesce(T.blank_to_null(F.col(f"d.{c}")), F.col(c))
    if "legal_start_date" in details.columns:
        new["legal_start_date"] = F.coalesce("legal_start_date", "d.legal_start_date")
    for c in ("latitude", "longitude", "secondary_latitude", "secondary_longitude"):
        if c in details.columns and c in current.columns:
            new[c] = F.coalesce(f"d.{c}", c)
    return joined.withColumns(new).select(*current.columns)


def package_rows(packages: DataFrame) -> DataFrame:
    """Attribute tables of own projects: project, position, label, value."""
    items = [
        ("Package", "project_name"), ("Owner", "owner"), ("Status", "status"), ("Facility", "facility_type"), ("Project Type", "project_type"),
        ("Est Start", "est_start_date"), ("Est End", "est_end_date"), ("Act Start", "act_start_date"), ("Act End", "act_end_date"), ("Council District", "council_district"),
    ]
    return _attributes(packages, items)


def conflict_rows(features: DataFrame) -> DataFrame:
    """Attribute tables of other owners' features."""
    items = [
        ("Project", "project_name"), ("Owner", "owner"), ("Department", "department"), ("Facility", "facility_type"), ("Type", "project_type"),
        ("Status", "status"), ("Act Start", "act_start_date"), ("Act End", "act_end_date"),
    ]
    return _attributes(features, items)


def _attributes(df: DataFrame, items: list[tuple[str, str]]) -> DataFrame:
    value = lambda c: F.coalesce(_have(df, c).cast("string"), F.lit(""))
    pairs = [F.struct(F.lit(i).alias("pos"), F.lit(label).alias("label"), value(c).alias("value")) for i, (label, c) in enumerate(items, 1)]
    return df.select("project_id", F.inline(F.array(*pairs)))


# -- rollups -----------------------------------------------------------------


def most_frequent(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): the most frequent value that is not blank; of equally frequent ones the one seen first by `order`."""
    counts = df.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))
    return counts.withColumn("place", place).where("place = 1").select(key, value)


def canonical_names(view: DataFrame, order: str = "ticket_number") -> DataFrame:
    """(slug, excavator_name): the usual spelling of each contractor."""
    named = view.withColumn("slug", T.slugify(F.col("excavator_name")))
    return most_frequent(named, "slug", "excavator_name", order)


def contractor_rollup(view: DataFrame, today: Column, order: str = "ticket_number") -> DataFrame:
    """Counts and dates per contractor slug; contractors without an active notice are left out.

    One aggregation to (slug, name, county) is the only pass over the notices;
    it is written once, and everything else, the usual names and counties too,
    works on its few rows.
    """
    active = P.not_cancelled()
    due = lambda n: active & P.expiring_within(n, today)
    base = view.withColumn("slug", T.slugify(F.col("excavator_name"))).groupBy("slug", "excavator_name", "county").agg(
        F.count("*").alias("n"), F.min(order).alias("first"),
        F.count_if(active).alias("active_count"), F.count_if(due(4)).alias("expiring_4d_count"), F.count_if(due(7)).alias("expiring_7d_count"),
        F.count_if(P.late()).alias("late_utilities_count"), F.count_if(P.blocked()).alias("blocked_count"),
        F.count_if(P.cancelled_within(7, today)).alias("cancelled_last_7d_count"),
        F.min(F.when(active, F.col("expiration_date"))).alias("earliest_expire_date"), F.max("call_date").alias("latest_call_date"),
    )
    base = Scratch(view.sparkSession, "contractors").save(base, "base")

    def pick(column: str) -> DataFrame:
        counts = base.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy("slug", column).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        place = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("n"), "first"))
        return counts.withColumn("place", place).where("place = 1").select("slug", column)

    counts = [c for c in base.columns if c.endswith("_count")]
    sums = base.groupBy("slug").agg(*[F.sum(c).alias(c) for c in counts], F.min("earliest_expire_date").alias("earliest_expire_date"), F.max("latest_call_date").alias("latest_call_date"))
    out = sums.where("active_count > 0").join(pick("excavator_name"), "slug", "left").join(pick("county").withColumnRenamed("county", "primary_county"), "slug", "left")
    return out.select("slug", F.coalesce("excavator_name", F.lit("")).alias("excavator_name"), *counts, "earliest_expire_date", "latest_call_date", F.coalesce("primary_county", F.lit("")).alias("primary_county"))


def package_counts(view: DataFrame) -> DataFrame:
    """Tickets per tagged project: total, active, cancelled and by match confidence."""
    tier = lambda t: F.count_if(F.col("match_confidence") == t).alias(t)
    return view.where("coalesce(project_name, '') <> ''").groupBy("project_name").agg(
        F.count("*").alias("total"), F.count_if(P.not_cancelled()).alias("active"), F.count_if(~P.not_cancelled()).alias("cancelled"),
        tier("high"), tier("medium"), tier("low"),
    )


def packages_view(packages: DataFrame, view: DataFrame, today: Column) -> DataFrame:
    """One row per project with its tickets' counts; projects without tickets stay.  Tickets are aggregated before the join."""
    active = P.not_cancelled()
    tagged = view.where("coalesce(project_name, '') <> ''").groupBy("project_name").agg(
        F.count("*").alias("ticket_count_total"), F.count_if(F.col("match_confidence") == "high").alias("ticket_count_high_match"),
        F.count_if(active & F.coalesce("is_ready_to_dig", F.lit(False))).alias("ticket_count_ready_to_dig"),
        F.count_if(P.late()).alias("ticket_count_with_late_utility"), F.count_if(P.blocked()).alias("ticket_count_blocked"),
        F.min(F.when(active, F.col("expiration_date"))).alias("earliest_ticket_expire_date"), F.max(F.when(active, F.col("call_date"))).alias("latest_ticket_call_date"),
    )
    counts = [c for c in tagged.columns if c.startswith("ticket_count")]
    return packages.join(tagged, "project_name", "left").select(
        F.col("project_name").alias("package_name"), F.coalesce("status", F.lit("")).alias("status"), "est_start_date", "est_end_date", "act_start_date", "act_end_date",
        D.days_until(F.coalesce("est_end_date", "act_end_date"), today).alias("days_to_est_end"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], "earliest_ticket_expire_date", "latest_ticket_call_date",
    )


def kpi_summary(tickets: DataFrame, failures: DataFrame, today: Column) -> DataFrame:
    """One row of totals; cancelled and expired count all tickets, relevant or not."""
    soon = P.active_relevant() & P.expiring_within(7, today)
    state = lambda s: F.count_if(F.col("status") == s)
    totals = tickets.agg(
        F.count("*").alias("total"), F.count_if("is_relevant").alias("relevant"), F.count_if(P.active_relevant()).alias("active_relevant"),
        F.count_if(soon).alias("expiring_soon"), state("cancelled").alias("cancelled"), state("expired").alias("expired"),
    )
    return totals.crossJoin(failures.agg(F.count_if(P.open_failures()).alias("open_failures")))  # two single rows


def by_county(tickets: DataFrame, today: Column) -> DataFrame:
    active = F.col("status") == "active"
    return tickets.where("is_relevant").groupBy(F.coalesce(F.nullif("county", F.lit("")), F.lit("Unknown")).alias("county")).agg(
        F.count("*").alias("total"), F.count_if(active).alias("active"), F.count_if(active & P.expiring_within(7, today)).alias("expiring_soon")
    )


def by_work_group(tickets: DataFrame, order: str = "ticket_number") -> DataFrame:
    key = T.fallback_label(F.col("probable_work_group"), F.col("probable_company"))
    company = F.nullif("probable_company", F.lit(""))
    own = F.col("is_relevant")  # a filter on it would be pushed below the scoring, which would then be worked out twice
    found = tickets.groupBy(key.alias("work_group")).agg(
        F.count_if(own).alias("total"), F.count_if(own & (F.col("status") == "active")).alias("active"),
        F.sort_array(F.collect_set(F.when(own, F.nullif("county", F.lit(""))))).alias("counties"), F.min_by(company, F.when(own & company.isNotNull(), F.col(order))).alias("company"),
    )
    return found.where("total > 0")


def bucket_counts(view: DataFrame, bucket: Column, buckets: list[str]) -> DataFrame:
    """Rows per bucket of a fixed axis, empty buckets included."""
    spark = view.sparkSession
    axis = spark.createDataFrame([(i, b) for i, b in enumerate(buckets)], "pos int, bucket string")
    counts = view.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return axis.join(counts, "bucket", "left").select("pos", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def match_stats(matched: DataFrame, n: Column | None = None) -> DataFrame:
    """Matched rows by confidence; `n` gives the tickets of a row if it stands for several."""
    times = F.lit(1) if n is None else n
    count = lambda which: F.coalesce(F.sum(F.when(which, times)), F.lit(0)).cast("long")
    tier = lambda t: F.col("match_confidence") == t
    return matched.agg(
        count(F.lit(True)).alias("total"), *[count(tier(t)).alias(t) for t in ("high", "medium", "low")],
        count(P.has_coords() & tier("none")).alias("none"), count(~P.has_coords()).alias("skipped"),
    )


def table_stats(tickets: DataFrame) -> DataFrame:
    return tickets.agg(F.count("*").alias("tickets"), F.count_if("is_relevant").alias("relevant"), F.min("call_date").alias("first_call"), F.max("call_date").alias("last_call"))


def histogram(df: DataFrame, column: str, missing: str = "(null)") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias(column)).agg(F.count("*").alias("n"))


def targets_by_county(wanted: DataFrame) -> DataFrame:
    return wanted.groupBy("county").agg(F.count_distinct("ticket_number").alias("targets"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.coalesce(F.col(column), F.lit("")) != "").select(column).distinct()


def county_share(counties: DataFrame) -> DataFrame:
    """Percentage of active tickets, half up; 0 without tickets."""
    share = F.floor(F.coalesce(F.try_divide(100.0 * F.col("active"), F.col("total")), F.lit(0.0)) + 0.5).cast("int")
    return counties.withColumn("share", share)


def group_share(groups: DataFrame) -> DataFrame:
    """Each total as a share of the largest (at least 1): the groups are made once, and the largest is one row, joined back."""
    groups = Scratch(groups.sparkSession, "groups").save(groups, "groups")
    top = groups.agg(F.greatest(F.max("total"), F.lit(1)).alias("top"))
    return groups.crossJoin(F.broadcast(top)).withColumn("share", F.col("total") / F.col("top")).drop("top")


def reminder_digest(eligible: DataFrame) -> DataFrame:
    """Tickets to remind of under their group: count, target date and the list in key order."""
    key = T.fallback_label(F.col("probable_work_group"), F.col("probable_company"))
    return eligible.groupBy(key.alias("work_group")).agg(
        F.count("*").alias("tickets"), F.max("expiration_date").alias("target_date"), F.sort_array(F.collect_list("ticket_number")).alias("ticket_numbers")
    )


def reminder_lines(eligible: DataFrame) -> DataFrame:
    """The digest's tickets, a row each under their group: for groups too large for one row."""
    key = T.fallback_label(F.col("probable_work_group"), F.col("probable_company"))
    return eligible.select(key.alias("work_group"), "ticket_number", F.col("expiration_date").alias("target_date"))


def lifecycle_counts(packages: DataFrame, today: Column) -> DataFrame:
    return bucket_counts(packages, S.lifecycle_bucket(F.col("status"), F.col("act_end_date"), today), ["active", "committed", "recent"])


# -- orders and top lists ------------------------------------------------------


def sort_master(view: DataFrame) -> DataFrame:
    return view.orderBy(F.asc_nulls_last("expire_date"), "ticket_number")


def sort_rollup(rollup: DataFrame) -> DataFrame:
    return rollup.orderBy(F.desc("active_count"), "excavator_name")


def sort_packages(packages: DataFrame) -> DataFrame:
    return packages.orderBy(F.asc_nulls_last("days_to_est_end"), "package_name")


def sort_review(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.asc_nulls_last(F.col("distance_m").try_cast("double")), "ticket_number")


def sort_detail(rows: DataFrame) -> DataFrame:
    return rows.orderBy("ticket_number", F.coalesce("utility_code", F.lit("")))


def sort_folders(counts: DataFrame, name: str = "excavator_name") -> DataFrame:
    return counts.orderBy(F.desc("n"), name)


def sort_counties(counties: DataFrame) -> DataFrame:
    """Counties as a viewer lists them: most notices first (equal ones by name)."""
    return counties.orderBy(F.desc("total"), "county")


def sort_groups(groups: DataFrame) -> DataFrame:
    """Work groups as a viewer lists them: most active notices first (equal ones by name)."""
    return groups.orderBy(F.desc("active"), "work_group")


def numbered(ordered: DataFrame) -> DataFrame:
    """The rows of an ordered table with their `position` from 1, without gathering them in one task.

    The table is written once with each row's partition and place in it; only
    the partitions' counts, one row each, are added up.
    """
    scratch = Scratch(ordered.sparkSession, "numbered")
    rows = scratch.save(ordered.withColumns({"__part": F.spark_partition_id(), "__id": F.monotonically_increasing_id()}), "rows")
    counts = rows.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("__part", before.alias("__before")))
    place = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(starts, "__part").withColumn("position", place).drop("__part", "__id", "__before")


def top_active(tickets: DataFrame, n: int = 100) -> DataFrame:
    return tickets.where(P.active_relevant()).orderBy(F.asc_nulls_last("expiration_date"), "ticket_number").limit(n)


def top_expiring(tickets: DataFrame, today: Column, days: int = 7, n: int = 100) -> DataFrame:
    return tickets.where(P.active_relevant() & P.expiring_within(days, today)).orderBy("expiration_date", "ticket_number").limit(n)


def top_recent(df: DataFrame, column: str, key: str, n: int = 50) -> DataFrame:
    """The n latest rows: changes by updated_at, failures by occurred_at."""
    return df.orderBy(F.desc(column), key).limit(n)


def list_tickets(tickets: DataFrame, n: int = 50, **filters) -> DataFrame:
    return P.list_filter(tickets, **filters).orderBy(F.asc_nulls_first("expiration_date"), "ticket_number").limit(n)


def viewer_sort(df: DataFrame, key: str, ascending: bool = True) -> DataFrame:
    """Order by one column as a viewer shows it: null as '', digits by value."""
    shown = T.natural_sort_key(F.col(key).cast("string"))
    # a column of its own: a sort works an expression out again for every comparison
    return df.withColumn("__shown", shown).orderBy(F.asc("__shown") if ascending else F.desc("__shown")).drop("__shown")


def stack_slices(df: DataFrame, slices: dict[str, Column]) -> DataFrame:
    """A row once for every slice whose predicate holds (column slice): one scan for all exports."""
    names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in slices.items()]))
    return df.withColumn("slice", F.explode(names))


def export_slices(today: Column) -> dict[str, Column]:
    due = lambda n: P.not_cancelled() & P.expiring_within(n, today)
    return {
        "relevant_active": P.not_cancelled(), "relevant_expiring_4d": due(4), "relevant_expiring_7d": due(7), "relevant_late_utilities": P.late(),
        "relevant_blocked": P.blocked(), "relevant_new_24h": P.new_since_yesterday(today), "relevant_cancelled_7d": P.cancelled_within(7, today),
    }


# -- dashboard -----------------------------------------------------------------


def dashboard_documents(tickets: DataFrame, history: DataFrame, failures: DataFrame, now: Column, today: Column, window: int = 7, limit: int = 100, latest: int = 50) -> dict[str, DataFrame]:
    """The seven documents of the dashboard, one row each.

    `tickets` is the scored current table, `history` has a row a version of a
    ticket_number, `failures` the quarantined records.  Counts are those of all
    rows; lists are top lists, cut to their limit before they are gathered.  The
    projection that all documents share is made once.
    """
    scratch = Scratch(tickets.sparkSession, "dashboard")
    rows = scratch.save(dashboard_rows(tickets), "rows")
    failures = scratch.save(failures, "failures")
    active = rows.where(P.active_relevant())
    due = active.where(P.expiring_within(window, today))
    order = [F.asc_nulls_last("expiration_date"), F.col("ticket_number")]
    changed = rows.where("is_relevant").join(history.groupBy("ticket_number").agg(F.count("*").alias("__n")).where("__n > 1").select("ticket_number"), "ticket_number", "left_semi")
    fails = failures.where(P.open_failures()).drop("resolved")

    def document(name: str, df: DataFrame, most: int | None, by: list[Column], **more: Column) -> DataFrame:
        total = df.agg(F.count("*").alias("count"))
        top = df.orderBy(*by) if most is None else df.orderBy(*by).limit(most)
        # limited, or one row a county or group: the list is gathered in its order
        listed = top.withColumn("__place", F.monotonically_increasing_id()).agg(F.array_sort(F.collect_list(F.struct("__place", F.struct(*df.columns).alias("row")))).alias("l"))
        return total.crossJoin(listed).select(now.alias("generated_at"), *[v.alias(k) for k, v in more.items()], "count", F.transform("l", lambda x: x["row"]).alias(name))

    kpis = kpi_summary(rows, failures, today).select(
        now.alias("generated_at"), F.col("total").alias("total_tickets"), "relevant", "active_relevant", "expiring_soon", "cancelled", "expired", F.col("open_failures").alias("parse_failures_open"),
    )
    return {
        "tickets_active": document("tickets", active, limit, order),
        "tickets_expiring": document("tickets", due, limit, order, window_days=F.lit(window)),
        "summary": kpis,
        "by_county": document("counties", by_county(rows, today), None, [F.desc("total"), F.col("county")]).drop("count"),
        "by_work_group": document("groups", by_work_group(rows), None, [F.desc("total"), F.col("work_group")]).drop("count"),
        "recent_changes": document("tickets", changed, latest, [F.desc("updated_at"), F.col("ticket_number")]),
        "parse_failures": document("failures", fails, latest, [F.desc("occurred_at"), F.col("ticket_number")]),
    }
