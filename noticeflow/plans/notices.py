"""Queries over notices: filters, scoring, views, rollups and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeflow.functions import dates as D
from noticeflow.functions import status as S
from noticeflow.functions import text as T
from noticeflow.operators import cdc, filters, policy, score, views
from noticeflow.operators import utilities as U
from noticeflow.plans.adapters import (
    PACKAGES_SQL, RULES, TAGS_SQL, TICKETS_SQL, TODAY, UTILITIES_SQL, now, packages, project_tags, table, tickets, today, utility_rows, with_utilities,
)
from noticeflow.plans.registry import ctes, query

iso = lambda c: D.fmt_date(F.col(c)).alias(c)

ANY = "concat_ws(' ', nullif(excavator_name, ''), nullif(caller_name, ''), nullif(work_type, ''), nullif(remarks, ''), nullif(done_for, ''))"
HITS_SQL = f"""
hits AS (
  SELECT *, lower(a) LIKE '%northstar fiber%' AS r1, lower(a) LIKE '%drop bury%' AS r2, regexp_matches(a, '(?i)fiber\\s+install') AS r3, lower(remarks) LIKE '%ftth%' AS r4,
    lower(a) LIKE '%fiber%' AS r5, coalesce(done_for, '') = 'Meridian Cable' AS r6, lower(work_type) LIKE '%urgent%' AS r7, lower(remarks) LIKE '%water main%' AS r8,
    regexp_matches(work_type, '(?i)^5-low$') AS r9
  FROM (SELECT *, {ANY} AS a FROM tickets)
),
raws AS (
  SELECT *, greatest(0, least(1, least(1, 0.0::DOUBLE + if(r1, 1.0::DOUBLE, 0) + if(r2, 0.65::DOUBLE, 0) + if(r3, 0.75::DOUBLE, 0) + if(r4, 0.85::DOUBLE, 0) + if(r5, 0.3::DOUBLE, 0)
     + if(r6, 0.6::DOUBLE, 0) + if(r7, 0.2::DOUBLE, 0)) - (0.0::DOUBLE + if(r8, 0.5::DOUBLE, 0) + if(r9, 0.1::DOUBLE, 0)))) AS raw
  FROM hits
),
lifts AS (
  SELECT *, raw < 0.45::DOUBLE AND lower(excavator_name) IN ('machinery', 'building') AND (lower(work_type) LIKE '%specified%' OR lower(remarks) LIKE '%conduit%') AS lifted FROM raws
),
scored AS (
  SELECT *, CASE WHEN ticket_number IN ('0000000005', '0000000010') THEN 0.0 WHEN ticket_number IN ('0000000007', '0000000077') THEN 1.0
                 ELSE round_even(if(lifted, 0.45::DOUBLE, raw), 4) END::DOUBLE AS relevance_score,
    CASE WHEN ticket_number IN ('0000000005', '0000000010') THEN false WHEN ticket_number IN ('0000000007', '0000000077') THEN true ELSE if(lifted, 0.45::DOUBLE, raw) >= 0.45::DOUBLE END AS is_relevant,
    CASE WHEN is_cancelled THEN 'cancelled' WHEN expiration_date IS NULL THEN 'unknown' WHEN expiration_date < DATE '{TODAY}' THEN 'expired' ELSE 'active' END AS status
  FROM lifts
)"""
REASONS = """concat_ws(';', if(r1, '+northstar_fiber(w=1.00)', NULL), if(r2, '+drop_bury(w=0.65)', NULL), if(r3, '+fiber_install(w=0.75)', NULL), if(r4, '+ftth(w=0.85)', NULL),
    if(r5, '+fiber(w=0.30)', NULL), if(r6, '+meridian(w=0.60)', NULL), if(r7, '+urgent(w=0.20)', NULL), if(r8, '-water(w=-0.50)', NULL), if(r9, '-low(w=-0.10)', NULL),
    if(lifted, '+contractor_rule_match', NULL))"""
TODAY_SQL = f"DATE '{TODAY}'"


def scored(spark, sf):
    """Scored notices with the stored state."""
    t = score.score(tickets(spark, sf), RULES)
    return t.withColumn("status", S.derive_status(F.col("is_cancelled"), F.col("expiration_date"), today()))


def rolled(spark, sf):
    """Notices with utilities and rollups."""
    return U.utility_rollup(with_utilities(tickets(spark, sf), spark, sf), now())


# -- scoring -------------------------------------------------------------------


@query(ctes(TICKETS_SQL, HITS_SQL) + f"""SELECT ticket_number, relevance_score, is_relevant, CASE WHEN ticket_number IN ('0000000005', '0000000010') THEN 'manual_exclude_override'
  WHEN ticket_number IN ('0000000007', '0000000077') THEN 'manual_include_override' ELSE {REASONS} END AS reasons FROM scored""")
def score_rules(spark, sf):
    return score.score(tickets(spark, sf), RULES).select("ticket_number", "relevance_score", "is_relevant", F.array_join("relevance_reasons", ";").alias("reasons"))


@query(ctes(TICKETS_SQL, HITS_SQL) + """SELECT ticket_number, rule_id, weight::DOUBLE AS weight FROM (
  SELECT ticket_number, unnest([r1, r2, r3, r4, r5, r6, r7, r8, r9]) AS fired, unnest(['northstar_fiber', 'drop_bury', 'fiber_install', 'ftth', 'fiber', 'meridian', 'urgent', 'water', 'low']) AS rule_id,
    unnest([1.0, 0.65, 0.75, 0.85, 0.3, 0.6, 0.2, -0.5, -0.1]) AS weight FROM hits) WHERE fired""")
def score_explain(spark, sf):
    return score.explain(tickets(spark, sf), RULES)


_OLD = "CASE WHEN k % 3 = 0 THEN 0.0 WHEN k % 3 = 1 THEN 0.9 ELSE relevance_score END::DOUBLE AS old_score, CASE WHEN k % 3 = 0 THEN false WHEN k % 3 = 1 THEN true ELSE is_relevant END AS was_relevant"


@query(ctes(TICKETS_SQL, HITS_SQL) + f"""SELECT CASE WHEN NOT was_relevant AND is_relevant THEN 'newly_relevant' WHEN was_relevant AND NOT is_relevant THEN 'no_longer_relevant'
  WHEN abs(relevance_score - old_score) > 1e-6 THEN 'score_moved' ELSE 'unchanged' END AS change, count(*) AS tickets FROM (SELECT *, {_OLD} FROM scored) GROUP BY 1""")
def rescore_diff(spark, sf):
    old = score.score(tickets(spark, sf), RULES)
    third = lambda a, b, c: F.when(F.col("k") % 3 == 0, a).when(F.col("k") % 3 == 1, b).otherwise(F.col(c))
    before = old.withColumns({"relevance_score": third(0.0, 0.9, "relevance_score"), "is_relevant": third(False, True, "is_relevant")})
    return score.rescore_diff(score.rescore(before, RULES))


# -- filters -------------------------------------------------------------------


@query(ctes(TICKETS_SQL) + """SELECT ticket_number FROM tickets WHERE lower(coalesce(done_for, '')) LIKE '%northstar%' OR lower(work_type) LIKE '%northstar%'
  OR lower(coalesce(done_for, '')) LIKE '%meridian cable%' OR lower(excavator_name) LIKE '%machinery%'""")
def worth_detail_fetch(spark, sf):
    test = filters.worth_detail_fetch(F.col("done_for"), F.col("work_type"), F.col("excavator_name"), ["NORTHSTAR", "Meridian Cable"], ["machinery"])
    return tickets(spark, sf).where(test).select("ticket_number")


@query(ctes(TICKETS_SQL, HITS_SQL, UTILITIES_SQL, TAGS_SQL) + f"""
, base AS (SELECT s.*, coalesce(r.late, 0) AS late, coalesce(r.blocking, 0) AS blocking, g.match_confidence FROM scored s LEFT JOIN rolled r USING (k) JOIN tagged g USING (k))
SELECT ticket_number, is_relevant AND status = 'active' AS active_relevant, NOT is_cancelled AS not_cancelled, coalesce(expiration_date <= {TODAY_SQL} + 4, false) AS due_4, coalesce(expiration_date <= {TODAY_SQL} + 14, false) AS due_14,
  late > 0 AND NOT is_cancelled AS late, blocking > 0 AND NOT is_cancelled AS blocked, call_date >= {TODAY_SQL} - 1 AND NOT is_cancelled AS fresh, is_cancelled AND call_date >= {TODAY_SQL} - 14 AS cancelled_14,
  match_confidence = 'low' AND NOT is_cancelled AS review, coalesce(is_relevant AND expiration_date = {TODAY_SQL} + 4 AND status NOT IN ('cancelled', 'expired'), false) AS remind,
  coalesce(NOT is_relevant AND done_for ILIKE '%cable%', false) AS other, latitude IS NOT NULL AS has_coords FROM base""")
def predicates(spark, sf):
    t = project_tags(score.score(rolled(spark, sf), RULES)).withColumn("status", S.derive_status(F.col("is_cancelled"), F.col("expiration_date"), today()))
    return t.select(
        "ticket_number", filters.active_relevant().alias("active_relevant"), filters.not_cancelled().alias("not_cancelled"), filters.expiring_within(4, today()).alias("due_4"),
        filters.expiring_within(14, today()).alias("due_14"), filters.late().alias("late"), filters.blocked().alias("blocked"), filters.new_since_yesterday(today()).alias("fresh"),
        filters.cancelled_within(14, today()).alias("cancelled_14"), filters.needs_review().alias("review"), filters.reminder_eligible(F.date_add(today(), 4)).alias("remind"),
        filters.contractor_other("cable").alias("other"), filters.has_coords().alias("has_coords"),
    )


@query(ctes(TICKETS_SQL, HITS_SQL) + "SELECT ticket_number, county, relevance_score FROM scored WHERE lower(county) LIKE '%nation_1%' AND lower(excavator_name) LIKE '%u%' AND relevance_score >= 0.3 AND status = 'expired'")
def viewer_filter(spark, sf):
    t = scored(spark, sf).withColumns({"probable_company": F.col("excavator_name"), "probable_work_group": F.lit(None).cast("string")})
    return filters.viewer_filter(t, county="Nation_1", company="U", min_score=0.3, status="expired").select("ticket_number", "county", "relevance_score")


@query(ctes(TICKETS_SQL, HITS_SQL) + "SELECT ticket_number, strftime(expiration_date, '%Y-%m-%d') AS expiration_date FROM scored WHERE is_relevant AND status = 'active' AND county ILIKE '%nation_2%' ORDER BY scored.expiration_date NULLS FIRST, ticket_number LIMIT 50")
def list_tickets(spark, sf):
    """A top list: the limit is its feature."""
    return views.list_tickets(scored(spark, sf), 50, relevant_only=True, status="active", county="nation_2").select("ticket_number", iso("expiration_date"))


@query("SELECT doc_id, length(trim(text)) >= 50 AS usable, regexp_matches(text, '(?i)\\b(?:cancelled|canceled|void(?:ed)?)\\b') AS is_cancelled FROM documents")
def usable_texts(spark, sf):
    from noticeflow.operators.extract import cancelled_in_text

    return table(spark, sf, "documents").select("doc_id", filters.usable_text(F.col("text")).alias("usable"), cancelled_in_text(F.col("text")).alias("is_cancelled"))


# -- utilities -----------------------------------------------------------------


@query(ctes(TICKETS_SQL, UTILITIES_SQL) + "SELECT row_status, last_response, status, count(*) AS n FROM utilities GROUP BY ALL")
def utility_statuses(spark, sf):
    rows = utility_rows(spark, sf).withColumn("status", S.utility_status(F.col("row_status"), F.col("last_response")))
    return rows.groupBy("row_status", "last_response", "status").agg(F.count("*").alias("n"))


@query(ctes(TICKETS_SQL, UTILITIES_SQL) + """SELECT ticket_number, coalesce(has_late_utility, false) AS has_late_utility, coalesce(is_ready_to_dig, false) AS is_ready_to_dig, coalesce(blocking, 0)::INT AS blocking,
  coalesce(pending, 0)::INT AS pending, coalesce(late, 0)::INT AS late FROM tickets LEFT JOIN rolled USING (k)""")
def utility_rollup(spark, sf):
    n = lambda c: F.size(f"{c}_utility_codes").alias(c)
    return rolled(spark, sf).select("ticket_number", "has_late_utility", "is_ready_to_dig", n("blocking"), n("pending"), n("late"))


_CODES = "string_agg(code, ', ' ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity)"
_REASON = "CASE said WHEN 'locate delayed' THEN 'delayed' WHEN 'in conflict' THEN 'in conflict' WHEN 'cannot locate - contact utility' THEN 'cannot locate' WHEN 'no response' THEN 'no response' ELSE 'blocked' END"


def _part(label: str) -> str:
    return f"(SELECT count(*) || ' {label} (' || {_CODES} || ')' FROM stuck s WHERE s.k = t.k AND reason = '{label}' HAVING count(*) > 0)"


@query(ctes(TICKETS_SQL, UTILITIES_SQL) + f""", kinds AS (
  SELECT *, CASE WHEN status IN ('clear', 'located') THEN 'clear' WHEN is_late THEN 'late' WHEN status = 'pending' THEN 'pending' WHEN status IN ('delayed', 'not_clear') THEN {_REASON} END AS kind FROM marked
), said AS (
  SELECT k, kind, CASE WHEN kind IN ('clear', 'pending') THEN count(*) || ' ' || kind ELSE count(*) || ' ' || kind || ' (' || {_CODES} || ')' END AS part,
    list_position(['clear', 'late', 'in conflict', 'cannot locate', 'no response', 'delayed', 'blocked', 'pending'], kind) AS pos
  FROM kinds WHERE kind IS NOT NULL GROUP BY k, kind
), lines AS (SELECT k, string_agg(part, ', ' ORDER BY pos) AS utility_summary FROM said GROUP BY k)
SELECT ticket_number, coalesce(utility_summary, '') AS utility_summary FROM tickets LEFT JOIN lines USING (k)""")
def utility_summary(spark, sf):
    return rolled(spark, sf).select("ticket_number", U.utility_summary(F.col("utility_statuses")).alias("utility_summary"))


@query(ctes(TICKETS_SQL, UTILITIES_SQL) + f"""SELECT ticket_number, strftime(call_date, '%Y-%m-%d') AS call_date, code AS utility_code, ({TODAY_SQL} - call_date)::INT AS days_since_call, county, excavator_name, '' AS address, '' AS intersection,
  '' AS place, done_for, '' AS utility_name, '' AS facility, status, last_response, is_late, false AS ticket_is_cancelled FROM tickets JOIN marked USING (k) WHERE NOT is_cancelled""")
def utility_detail(spark, sf):
    t = rolled(spark, sf).withColumns({"location_text": F.lit(""), "intersection_text": F.lit("")})
    return U.utility_detail(t, today()).drop("response_timestamp").withColumn("call_date", D.fmt_date_or_null(F.col("call_date")))


_UBUCKET = """CASE WHEN conflict > 0 THEN 'Blocked — conflict/other' WHEN delayed > 0 THEN 'Blocked — delayed' WHEN has_late_utility THEN 'Has late utilities' WHEN is_ready_to_dig THEN 'Ready to dig' ELSE 'Pending utilities' END"""


@query(ctes(TICKETS_SQL, UTILITIES_SQL) + f""", b AS (
  SELECT t.k, {_UBUCKET} AS bucket FROM tickets t LEFT JOIN rolled r USING (k) LEFT JOIN (
    SELECT k, count(*) FILTER ({_REASON} IN ('in conflict', 'cannot locate', 'no response')) AS conflict, count(*) FILTER ({_REASON} = 'delayed') AS delayed FROM utilities WHERE status IN ('delayed', 'not_clear') GROUP BY k) USING (k)
) SELECT pos::INT AS pos, a.bucket, count(b.k) AS n FROM (VALUES (0, 'Blocked — conflict/other'), (1, 'Blocked — delayed'), (2, 'Has late utilities'), (3, 'Ready to dig'), (4, 'Pending utilities')) a(pos, bucket) LEFT JOIN b USING (bucket) GROUP BY ALL""")
def utility_bucket_counts(spark, sf):
    bucket = S.utility_bucket(F.col("utility_statuses"), F.col("has_late_utility"), F.col("is_ready_to_dig"))
    return views.bucket_counts(rolled(spark, sf), bucket, S.UTILITY_BUCKETS)


# -- views and rollups -----------------------------------------------------------


_SHOWN = f"CASE WHEN is_cancelled THEN 'cancelled' WHEN expiration_date IS NULL THEN 'unknown' WHEN expiration_date < {TODAY_SQL} THEN 'expired' WHEN expiration_date <= {TODAY_SQL} + 7 THEN 'expiring_soon' ELSE 'active' END"


_LISTED = "coalesce((SELECT string_agg(code, ', ' ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity) FROM marked m WHERE m.k = t.k AND {}), '')"
_FLAG = "CASE WHEN {} THEN 'TRUE' ELSE 'FALSE' END"


@query(ctes(TICKETS_SQL, UTILITIES_SQL) + f"""SELECT ticket_number, strftime(call_date, '%Y-%m-%d') AS call_date, strftime(legal_start_date, '%Y-%m-%d') AS legal_start_date, coalesce(strftime(expiration_date, '%Y-%m-%d'), '') AS expire_date,
  coalesce((expiration_date - {TODAY_SQL})::VARCHAR, '') AS days_until_expire, county, excavator_name, caller_name, '' AS caller_phone, work_type, '' AS address, '' AS intersection, '' AS place, coalesce(done_for, '') AS done_for,
  {_FLAG.format("is_ready_to_dig")} AS is_ready_to_dig, {_FLAG.format("has_late_utility")} AS has_late_utility, {_LISTED.format("is_late")} AS late_utility_codes, {_LISTED.format("status IN ('delayed', 'not_clear')")} AS blocking_utility_codes,
  {_LISTED.format("status = 'pending'")} AS pending_utility_codes, {_FLAG.format("is_cancelled")} AS is_cancelled, {_SHOWN} AS status, remarks, coalesce(printf('%.6f', latitude), '') AS latitude, coalesce(printf('%.6f', longitude), '') AS longitude
FROM tickets t LEFT JOIN rolled r USING (k)""")
def master_rows(spark, sf):
    """All columns but the summary, which has a query of its own."""
    view = views.ticket_view(rolled(spark, sf).withColumn("caller_phone", F.lit(None).cast("string")), today())
    return views.master_rows(view).drop("utility_summary")


@query(ctes(TICKETS_SQL, HITS_SQL) + f"""SELECT ticket_number, county, strftime(call_date, '%Y-%m-%d') AS call_date, strftime(legal_start_date, '%Y-%m-%d') AS legal_start_date, strftime(expiration_date, '%Y-%m-%d') AS expiration_date, excavator_name, caller_name,
  work_type, remarks, done_for, status, is_cancelled, is_relevant, relevance_score, CASE WHEN ticket_number IN ('0000000005', '0000000010') THEN 'manual_exclude_override' WHEN ticket_number IN ('0000000007', '0000000077') THEN 'manual_include_override'
  ELSE {REASONS} END AS relevance_reasons, 'TN' AS state, county || ' at ' || k AS location_text, CASE WHEN k % 4 <> 0 THEN 'U' || k % 5 || ',NES' END AS utility_codes, upper(excavator_name) AS probable_company,
  CASE WHEN k % 3 = 0 THEN 'GROUP ' || k % 5 END AS probable_work_group, CASE WHEN k % 6 = 1 THEN 'crew ' || k % 7 END AS probable_crew, strftime(call_date, '%Y-%m-%d') || ' 01:00:00' AS parsed_at, CASE WHEN k % 2 = 0 THEN strftime(call_date + 1, '%Y-%m-%d') || ' 00:00:00' END AS updated_at FROM scored""")
def dashboard_rows(spark, sf):
    """The public projection with the caller's name, which it has on request only, and all columns that it takes from a notice."""
    k, day = F.col("k"), F.col("call_date").cast("timestamp")
    full = scored(spark, sf).withColumns({
        "state": F.lit("TN"), "location_text": F.concat_ws(" at ", "county", k.cast("string")), "utility_codes": F.when(k % 4 != 0, F.array(F.concat(F.lit("U"), (k % 5).cast("string")), F.lit("NES"))),
        "probable_company": F.upper("excavator_name"), "probable_work_group": F.when(k % 3 == 0, F.concat(F.lit("GROUP "), (k % 5).cast("string"))),
        "probable_crew": F.when(k % 6 == 1, F.concat(F.lit("crew "), (k % 7).cast("string"))), "parsed_at": day + F.expr("INTERVAL 1 HOUR"), "updated_at": F.when(k % 2 == 0, day + F.expr("INTERVAL 1 DAY")),
    })
    plain = views.dashboard_rows(full)
    if "caller_name" in plain.columns:
        raise ValueError("the caller's name is in the plain projection")
    out = views.dashboard_rows(full, contact=True).withColumns({c: D.fmt_date_or_null(F.col(c)) for c in ("call_date", "legal_start_date", "expiration_date")})
    out = out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("parsed_at", "updated_at")})
    return out.withColumns({"relevance_reasons": F.array_join("relevance_reasons", ";"), "utility_codes": F.array_join("utility_codes", ",")})


@query(ctes(TICKETS_SQL, UTILITIES_SQL, TAGS_SQL) + f"""SELECT ticket_number, strftime(call_date, '%Y-%m-%d') AS call_date, strftime(expiration_date, '%Y-%m-%d') AS expire_date, (expiration_date - {TODAY_SQL})::INT AS days_until_expire, county, excavator_name,
  '' AS address, '' AS intersection, latitude, longitude, project_name AS candidate_project_name, printf('%.1f', match_distance_m) AS distance_m, coalesce(done_for, '') AS done_for, remarks FROM tagged WHERE match_confidence = 'low' AND NOT is_cancelled""")
def review_rows(spark, sf):
    view = views.ticket_view(project_tags(rolled(spark, sf)), today())
    return views.sort_review(views.review_rows(view)).drop("utility_summary").withColumns({c: D.fmt_date_or_null(F.col(c)) for c in ("call_date", "expire_date")})


_ROLLUP_SQL = ctes(TICKETS_SQL, UTILITIES_SQL) + f""", v AS (
  SELECT t.*, regexp_replace(regexp_replace(lower(excavator_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, coalesce(has_late_utility, false) AS late, coalesce(blocking, 0) > 0 AS blocked FROM tickets t LEFT JOIN rolled USING (k)
), names AS (
  SELECT slug, arg_max(excavator_name, (n, -f)) AS excavator_name FROM (SELECT slug, excavator_name, count(*) AS n, min(k) AS f FROM v GROUP BY ALL) GROUP BY slug
), counties AS (
  SELECT slug, county AS primary_county FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY n DESC, f) AS r FROM (SELECT slug, county, count(*) AS n, min(k) AS f FROM v GROUP BY ALL)) WHERE r = 1
)
SELECT slug, excavator_name, count(*) FILTER (NOT is_cancelled) AS active_count, count(*) FILTER (NOT is_cancelled AND expiration_date <= {TODAY_SQL} + 4) AS expiring_4d_count,
  count(*) FILTER (NOT is_cancelled AND expiration_date <= {TODAY_SQL} + 7) AS expiring_7d_count, count(*) FILTER (late AND NOT is_cancelled) AS late_utilities_count, count(*) FILTER (blocked AND NOT is_cancelled) AS blocked_count,
  count(*) FILTER (is_cancelled AND call_date >= {TODAY_SQL} - 7) AS cancelled_last_7d_count, strftime(min(expiration_date) FILTER (NOT is_cancelled), '%Y-%m-%d') AS earliest_expire_date,
  strftime(max(call_date), '%Y-%m-%d') AS latest_call_date, primary_county
FROM (SELECT v.* EXCLUDE (excavator_name), names.excavator_name, primary_county FROM v JOIN names USING (slug) JOIN counties USING (slug)) GROUP BY slug, excavator_name, primary_county HAVING count(*) FILTER (NOT is_cancelled) > 0"""


@query(_ROLLUP_SQL)
def contractor_rollup(spark, sf):
    out = views.contractor_rollup(rolled(spark, sf), today(), "k")
    return views.sort_rollup(out).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("earliest_expire_date", "latest_call_date")})


@query(ctes(TICKETS_SQL, TAGS_SQL) + """SELECT project_name, count(*) AS total, count(*) FILTER (NOT is_cancelled) AS active, count(*) FILTER (is_cancelled) AS cancelled, count(*) FILTER (match_confidence = 'high') AS high,
  count(*) FILTER (match_confidence = 'medium') AS medium, count(*) FILTER (match_confidence = 'low') AS low FROM tagged WHERE project_name IS NOT NULL GROUP BY 1""")
def package_counts(spark, sf):
    return views.package_counts(project_tags(tickets(spark, sf)))


@query(ctes(TICKETS_SQL, UTILITIES_SQL, TAGS_SQL, PACKAGES_SQL) + f""", g AS (
  SELECT project_name, count(*) AS a, count(*) FILTER (match_confidence = 'high') AS b, count(*) FILTER (NOT is_cancelled AND is_ready_to_dig) AS c, count(*) FILTER (NOT is_cancelled AND has_late_utility) AS d,
    count(*) FILTER (NOT is_cancelled AND blocking > 0) AS e, min(expiration_date) FILTER (NOT is_cancelled) AS f, max(call_date) FILTER (NOT is_cancelled) AS h FROM tagged LEFT JOIN rolled USING (k) WHERE project_name IS NOT NULL GROUP BY 1
) SELECT p.project_name AS package_name, coalesce(status, '') AS status, (coalesce(est_end_date, act_end_date) - {TODAY_SQL})::INT AS days_to_est_end, coalesce(a, 0) AS ticket_count_total, coalesce(b, 0) AS ticket_count_high_match,
  coalesce(c, 0) AS ticket_count_ready_to_dig, coalesce(d, 0) AS ticket_count_with_late_utility, coalesce(e, 0) AS ticket_count_blocked, strftime(f, '%Y-%m-%d') AS earliest_ticket_expire_date, strftime(h, '%Y-%m-%d') AS latest_ticket_call_date
FROM packages p LEFT JOIN g USING (project_name)""")
def packages_view(spark, sf):
    out = views.sort_packages(views.packages_view(packages(spark, sf), project_tags(rolled(spark, sf)), today()))
    return out.drop("est_start_date", "est_end_date", "act_start_date", "act_end_date").withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("earliest_ticket_expire_date", "latest_ticket_call_date")})


@query(ctes(TICKETS_SQL, HITS_SQL) + f"""SELECT count(*) AS total, count(*) FILTER (is_relevant) AS relevant, count(*) FILTER (is_relevant AND status = 'active') AS active_relevant,
  count(*) FILTER (is_relevant AND status = 'active' AND expiration_date <= {TODAY_SQL} + 7) AS expiring_soon, count(*) FILTER (status = 'cancelled') AS cancelled, count(*) FILTER (status = 'expired') AS expired,
  (SELECT count(*) FROM events WHERE event_type = 'error' AND value >= 10) AS open_failures FROM scored""")
def kpi_summary(spark, sf):
    failures = table(spark, sf, "events").where("event_type = 'error'").select((F.col("value") < 10).alias("resolved"))
    return views.kpi_summary(scored(spark, sf), failures, today())


@query(ctes(TICKETS_SQL, HITS_SQL) + f"""SELECT county, count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'active' AND expiration_date <= {TODAY_SQL} + 7) AS expiring_soon,
  floor(100.0::DOUBLE * count(*) FILTER (status = 'active') / count(*) + 0.5)::INT AS share FROM scored WHERE is_relevant GROUP BY 1""")
def by_county(spark, sf):
    return views.county_share(views.by_county(scored(spark, sf), today()))


@query(ctes(TICKETS_SQL, HITS_SQL) + """, g AS (SELECT coalesce(CASE WHEN k % 3 = 0 THEN 'GROUP ' || (k % 5) END, nullif(excavator_name, ''), 'Unassigned') AS work_group, * FROM scored WHERE is_relevant),
r AS (SELECT work_group, count(*) AS total, count(*) FILTER (status = 'active') AS active, string_agg(DISTINCT county, ',' ORDER BY county) AS counties, arg_min(excavator_name, ticket_number) AS company FROM g GROUP BY 1)
SELECT *, total::DOUBLE / (SELECT greatest(max(total), 1) FROM r) AS share FROM r""")
def by_work_group(spark, sf):
    t = scored(spark, sf).withColumns({"probable_company": F.col("excavator_name"), "probable_work_group": F.when(F.col("k") % 3 == 0, F.concat(F.lit("GROUP "), (F.col("k") % 5).cast("string")))})
    return views.group_share(views.by_work_group(t)).withColumn("counties", F.array_join("counties", ","))


@query(ctes(TICKETS_SQL) + f"""SELECT pos::INT AS pos, a.bucket, count(t.k) AS n FROM (VALUES (0, 'No expire date'), (1, 'Expiring ≤ 4 days'), (2, 'Expiring 5–7 days'), (3, 'Expiring 8+ days')) a(pos, bucket) LEFT JOIN (
  SELECT k, CASE WHEN expiration_date IS NULL THEN 'No expire date' WHEN expiration_date - {TODAY_SQL} <= 4 THEN 'Expiring ≤ 4 days' WHEN expiration_date - {TODAY_SQL} <= 7 THEN 'Expiring 5–7 days' ELSE 'Expiring 8+ days' END AS bucket FROM tickets) t USING (bucket) GROUP BY ALL""")
def urgency_counts(spark, sf):
    return views.bucket_counts(tickets(spark, sf), S.urgency_bucket(D.days_until(F.col("expiration_date"), today())), S.URGENCY)


@query(ctes(PACKAGES_SQL) + f"""SELECT pos::INT AS pos, a.bucket, count(p.project_id) AS n FROM (VALUES (0, 'active'), (1, 'committed'), (2, 'recent')) a(pos, bucket) LEFT JOIN (
  SELECT project_id, CASE WHEN act_end_date >= {TODAY_SQL} - 30 AND act_end_date <= {TODAY_SQL} THEN 'recent' WHEN lower(coalesce(status, '')) = 'committed' THEN 'committed' ELSE 'active' END AS bucket FROM packages) p USING (bucket) GROUP BY ALL""")
def lifecycle_counts(spark, sf):
    return views.lifecycle_counts(packages(spark, sf), today())


@query(ctes(PACKAGES_SQL) + "SELECT coalesce(status, '(null)') AS status, count(*) AS n FROM packages GROUP BY 1")
def status_histogram(spark, sf):
    return views.histogram(packages(spark, sf), "status")


@query(ctes(TICKETS_SQL, HITS_SQL) + "SELECT count(*) AS tickets, count(*) FILTER (is_relevant) AS relevant, strftime(min(call_date), '%Y-%m-%d') AS first_call, strftime(max(call_date), '%Y-%m-%d') AS last_call FROM scored")
def table_stats(spark, sf):
    return views.table_stats(scored(spark, sf)).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_call", "last_call")})


@query(ctes(TICKETS_SQL) + "SELECT county, count(DISTINCT ticket_number) AS targets FROM tickets WHERE k % 2 = 0 GROUP BY 1")
def targets_by_county(spark, sf):
    wanted = tickets(spark, sf).withColumn("source_html_path", F.when(F.col("k") % 2 == 1, "x")).withColumn("is_relevant", F.lit(True)).where(filters.missing_detail())
    return views.targets_by_county(wanted)


@query(ctes(TICKETS_SQL) + "SELECT DISTINCT done_for FROM tickets WHERE coalesce(done_for, '') <> ''")
def distinct_values(spark, sf):
    return views.distinct_values(tickets(spark, sf), "done_for")


@query(ctes(TICKETS_SQL, HITS_SQL) + f"""SELECT excavator_name AS work_group, count(*) AS tickets, strftime({TODAY_SQL} + 14, '%Y-%m-%d') AS target_date, string_agg(ticket_number, ',' ORDER BY ticket_number) AS ticket_numbers
FROM scored WHERE is_relevant AND expiration_date = {TODAY_SQL} + 14 AND status NOT IN ('cancelled', 'expired') GROUP BY 1""")
def reminder_digest(spark, sf):
    t = scored(spark, sf).withColumns({"probable_company": F.col("excavator_name"), "probable_work_group": F.lit("")})
    target = D.target_date(now(), 14)
    return views.reminder_digest(t.where(filters.reminder_eligible(target))).withColumns({"target_date": F.date_format("target_date", "yyyy-MM-dd"), "ticket_numbers": F.array_join("ticket_numbers", ",")})


@query(ctes(TICKETS_SQL, HITS_SQL) + "SELECT ticket_number, strftime(expiration_date, '%Y-%m-%d') AS expiration_date FROM scored WHERE is_relevant AND status = 'active' ORDER BY scored.expiration_date NULLS LAST, ticket_number LIMIT 100")
def top_active(spark, sf):
    """A top list: the limit is its feature."""
    return views.top_active(scored(spark, sf), 100).select("ticket_number", iso("expiration_date"))


@query(ctes(TICKETS_SQL, HITS_SQL) + f"SELECT ticket_number, strftime(expiration_date, '%Y-%m-%d') AS expiration_date FROM scored WHERE is_relevant AND status = 'active' AND expiration_date <= {TODAY_SQL} + 7 ORDER BY scored.expiration_date, ticket_number LIMIT 100")
def top_expiring(spark, sf):
    """A top list: the limit is its feature."""
    return views.top_expiring(scored(spark, sf), today()).select("ticket_number", iso("expiration_date"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS occurred_at FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50")
def top_failures(spark, sf):
    """A top list: the limit is its feature."""
    rows = table(spark, sf, "events").where("event_type = 'error'")
    return views.top_recent(rows, "ts", "event_id").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("occurred_at"))


_SLICES = f"""SELECT ticket_number, 'relevant_active' AS slice FROM v WHERE NOT is_cancelled
UNION ALL SELECT ticket_number, 'relevant_expiring_4d' FROM v WHERE NOT is_cancelled AND expiration_date <= {TODAY_SQL} + 4 UNION ALL SELECT ticket_number, 'relevant_expiring_7d' FROM v WHERE NOT is_cancelled AND expiration_date <= {TODAY_SQL} + 7
UNION ALL SELECT ticket_number, 'relevant_late_utilities' FROM v WHERE NOT is_cancelled AND has_late_utility UNION ALL SELECT ticket_number, 'relevant_blocked' FROM v WHERE NOT is_cancelled AND blocking > 0
UNION ALL SELECT ticket_number, 'relevant_new_24h' FROM v WHERE NOT is_cancelled AND call_date >= {TODAY_SQL} - 1 UNION ALL SELECT ticket_number, 'relevant_cancelled_7d' FROM v WHERE is_cancelled AND call_date >= {TODAY_SQL} - 7"""


@query(ctes(TICKETS_SQL, UTILITIES_SQL) + f", v AS (SELECT * FROM tickets LEFT JOIN rolled USING (k)) SELECT slice AS name, count(*) AS rows FROM ({_SLICES}) GROUP BY 1")
def export_manifest(spark, sf):
    stacked = views.stack_slices(rolled(spark, sf), views.export_slices(today()))
    return stacked.groupBy(F.col("slice").alias("name")).agg(F.count("*").alias("rows"))


@query(ctes(TICKETS_SQL, UTILITIES_SQL) + f", v AS (SELECT * FROM tickets LEFT JOIN rolled USING (k)) SELECT * FROM ({_SLICES})")
def stacked_slices(spark, sf):
    return views.stack_slices(rolled(spark, sf), views.export_slices(today())).select("ticket_number", "slice")


_PKG_ITEMS = [("Package", "project_name"), ("Owner", "owner"), ("Status", "status"), ("Facility", "NULL"), ("Project Type", "NULL"), ("Est Start", "est_start_date"), ("Est End", "est_end_date"), ("Act Start", "act_start_date"), ("Act End", "act_end_date"), ("Council District", "NULL")]


@query(ctes(PACKAGES_SQL) + " UNION ALL ".join(f"SELECT project_id, {i}::INT AS pos, '{n}' AS label, coalesce({c}::VARCHAR, '') AS value FROM packages" for i, (n, c) in enumerate(_PKG_ITEMS, 1)))
def package_rows(spark, sf):
    return views.package_rows(packages(spark, sf))


@query(ctes(TICKETS_SQL) + "SELECT ticket_number, row_number() OVER (ORDER BY k % 3 > 0, k DESC) AS position FROM tickets")
def viewer_sort(spark, sf):
    """Descending by a label with a number in it (by value: 10 before 9), or none (shown as '')."""
    label = F.when(F.col("k") % 3 == 0, F.concat(F.lit("Ticket "), F.col("k").cast("string")))
    rows = tickets(spark, sf).select("ticket_number", F.coalesce(label, F.concat(F.lit("9-"), F.col("k").cast("string"))).alias("label"))
    return views.numbered(views.viewer_sort(rows, "label", ascending=False)).select("ticket_number", "position")


# -- change capture ------------------------------------------------------------


def _incoming(spark, sf):
    """All notices arrive; the stored state lacks some of them and differs in others."""
    t = tickets(spark, sf).select("ticket_number", "k", "county", "work_type", "done_for")
    return t, t.where("k % 7 <> 0").withColumn("done_for", F.when(F.col("k") % 11 == 0, "moved").otherwise(F.col("done_for")))


_CHANGES = "SELECT t.k, CASE WHEN t.k % 7 = 0 THEN 'new' WHEN t.k % 11 = 0 THEN 'changed' ELSE 'unchanged' END AS change FROM tickets t"


@query(ctes(TICKETS_SQL) + f"SELECT k, change FROM ({_CHANGES})")
def capture_changes(spark, sf):
    incoming, stored = _incoming(spark, sf)
    stored = stored.withColumn("latest_content_hash", cdc.content_hash(stored))
    return cdc.capture_changes(incoming, stored, "ticket_number", now()).select("k", "change")


@query(ctes(TICKETS_SQL) + f"SELECT count(*) AS found, count(*) FILTER (change = 'new') AS new, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'unchanged') AS unchanged, (SELECT count(*) FROM tickets WHERE done_for IS NULL) AS failed FROM ({_CHANGES})")
def run_stats(spark, sf):
    incoming, stored = _incoming(spark, sf)
    stored = stored.withColumn("latest_content_hash", cdc.content_hash(stored))
    failures = policy.quarantine(incoming, {"missing_required_fields": F.col("done_for").isNotNull()}, now())[1]
    return cdc.run_stats(cdc.capture_changes(incoming, stored, "ticket_number", now()), failures)


@query(ctes(TICKETS_SQL) + "SELECT ticket_number, done_for, k % 7 = 0 OR k % 11 = 0 AS touched FROM tickets")
def upsert_current(spark, sf):
    incoming, stored = _incoming(spark, sf)
    stored = stored.withColumn("latest_content_hash", cdc.content_hash(stored)).withColumns({"created_at": F.lit("2001-01-01").cast("timestamp"), "updated_at": F.lit("2001-01-01").cast("timestamp")})
    out = cdc.upsert_current(cdc.capture_changes(incoming, stored, "ticket_number", now()), stored, "ticket_number")
    return out.select("ticket_number", "done_for", (F.col("updated_at") == now()).alias("touched"))


@query(ctes(TICKETS_SQL, HITS_SQL) + f"""SELECT ticket_number FROM scored WHERE is_relevant AND expiration_date = {TODAY_SQL} + 10 AND status NOT IN ('cancelled', 'expired') AND k % 3 <> 0""")
def unsent_reminders(spark, sf):
    t = scored(spark, sf).withColumns({"lead_days": F.lit(10), "dry_run": F.lit(False)})
    eligible = t.where(filters.reminder_eligible(F.date_add(today(), 10)))
    events = cdc.reminder_events(t.where("k % 3 = 0"), now())
    return cdc.unsent_reminders(eligible, events).select("ticket_number")


@query(ctes(TICKETS_SQL) + "SELECT 'found' AS outcome, count(*) AS n FROM tickets WHERE k % 3 = 0 AND k % 2 = 0 UNION ALL SELECT 'not_in_export', count(*) FROM tickets WHERE k % 3 = 0 AND k % 2 = 1")
def not_found_counts(spark, sf):
    t = tickets(spark, sf).select("ticket_number", "k")
    found, missing = cdc.refetch_targets(t.where("k % 2 = 0"), t.where("k % 3 = 0"))
    return found.agg(F.lit("found").alias("outcome"), F.count("*").alias("n")).unionByName(missing.agg(F.lit("not_in_export").alias("outcome"), F.count("*").alias("n")))


@query("SELECT n_name AS county FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_regionkey <> 1")
def counties_without_config(spark, sf):
    config = table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("county"))
    return cdc.missing_from_config(tickets_counties(spark, sf), config)


def tickets_counties(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("n_name").alias("county"))


def _features(spark, sf):
    p = packages(spark, sf).select("project_id", "project_name", "owner", "status", "budget")
    incoming = p.where("project_id % 5 <> 0 AND cast(owner as int) < 18")
    cached = p.where("project_id % 7 <> 0").withColumn("status", F.when(F.col("project_id") % 3 == 0, "old").otherwise(F.col("status")))
    return incoming, cached


@query(ctes(PACKAGES_SQL) + """, i AS (SELECT * FROM packages WHERE project_id % 5 <> 0 AND owner::INT < 18),
c AS (SELECT project_id, owner, CASE WHEN project_id % 3 = 0 THEN 'old' ELSE status END AS status FROM packages WHERE project_id % 7 <> 0)
SELECT project_id, CASE WHEN c.project_id IS NULL THEN 'new' WHEN i.project_id IS NULL AND c.owner IN (SELECT owner FROM i) THEN 'deleted' WHEN i.project_id IS NULL THEN 'kept'
  WHEN i.status IS DISTINCT FROM c.status THEN 'updated' ELSE 'unchanged' END AS action FROM i FULL JOIN c USING (project_id)""")
def sync_owner_scoped(spark, sf):
    return cdc.sync_owner_scoped(*_features(spark, sf)).select("project_id", "action")


@query(ctes(PACKAGES_SQL) + """, i AS (SELECT * FROM packages WHERE project_id % 5 <> 0 AND owner::INT < 18),
c AS (SELECT project_id, owner, CASE WHEN project_id % 3 = 0 THEN 'old' ELSE status END AS status FROM packages WHERE project_id % 7 <> 0),
a AS (SELECT project_id, CASE WHEN c.project_id IS NULL THEN 'new' WHEN i.project_id IS NULL AND c.owner IN (SELECT owner FROM i) THEN 'deleted' WHEN i.project_id IS NULL THEN 'kept'
  WHEN i.status IS DISTINCT FROM c.status THEN 'updated' ELSE 'unchanged' END AS action FROM i FULL JOIN c USING (project_id)) SELECT action, count(*) AS n FROM a WHERE action <> 'kept' GROUP BY 1""")
def sync_stats(spark, sf):
    return cdc.sync_stats(cdc.sync_owner_scoped(*_features(spark, sf)))


# -- scalar functions ------------------------------------------------------------


@query("""SELECT o_orderkey, form, CASE WHEN form = 4 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM (SELECT *, (o_orderkey % 5)::INT AS form FROM orders)""")
def parse_date(spark, sf):
    """Order dates written in four forms, and one that is no date."""
    o = table(spark, sf, "orders").withColumn("form", (F.col("o_orderkey") % 5).cast("int"))
    d = F.col("o_orderdate")
    text = (
        F.when(F.col("form") == 0, F.date_format(d, "M/d/yyyy")).when(F.col("form") == 1, F.concat(F.lit("on "), F.date_format(d, "yyyy-MM-dd"), F.lit(" at 9")))
        .when(F.col("form") == 2, F.date_format(d, "MMMM d, yyyy")).when(F.col("form") == 3, F.date_format(d, "MMM d yyyy")).otherwise("13/45/2001 or 2001-13-01")
    )
    return o.select("o_orderkey", "form", D.fmt_date_or_null(D.parse_date(text)).alias("parsed"))


@query(ctes(TICKETS_SQL) + f"""SELECT ticket_number, (expiration_date - {TODAY_SQL})::INT AS days, CASE WHEN expiration_date IS NULL THEN 'unknown' WHEN expiration_date < {TODAY_SQL} THEN 'expired' WHEN expiration_date - {TODAY_SQL} <= 4 THEN 'critical'
  WHEN expiration_date - {TODAY_SQL} <= 7 THEN 'warning' WHEN expiration_date - {TODAY_SQL} <= 14 THEN 'upcoming' ELSE 'ok' END AS urgency, {_SHOWN} AS shown,
  ceil((epoch(expiration_date::TIMESTAMP) - epoch(TIMESTAMP '2001-08-01 12:00:00')) / 86400.0)::INT AS days_ceil FROM tickets""")
def viewer_states(spark, sf):
    days = D.days_until(F.col("expiration_date"), today())
    return tickets(spark, sf).select(
        "ticket_number", days.alias("days"), S.viewer_urgency(days).alias("urgency"), S.display_status(F.col("is_cancelled"), F.col("expiration_date"), today()).alias("shown"),
        D.days_until_ceil(F.col("expiration_date"), now()).alias("days_ceil"),
    )


@query("""SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS ago
FROM (SELECT event_id, floor(epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(ts))::BIGINT AS s FROM events)""")
def time_ago(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", D.time_ago(F.col("ts").cast("timestamp"), F.lit("2024-02-01 00:00:00").cast("timestamp")).alias("ago"))


@query("""SELECT p_partkey, regexp_replace(lower(p_name || ' & ' || p_type), '[^a-z0-9]+', '-', 'g') AS slug, upper(trim(p_name)) AS key, trim(regexp_replace(regexp_replace(lower(p_name || '/' || p_brand), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS plain,
  sha256(p_name) AS sha, left(sha256(upper(p_name) || '|' || upper(p_type) || '|' || upper(p_brand)), 16) AS group_key, upper(p_name) AS company, p_partkey % 2 = 0 AS two_digits FROM part""")
def text_functions(spark, sf):
    p = table(spark, sf, "part")
    name, kind, brand = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    return p.select(
        "p_partkey", T.slugify(F.concat(name, F.lit(" & "), kind)).alias("slug"), T.ticket_key(name).alias("key"), T.normalize_text(F.concat(name, F.lit("/"), brand)).alias("plain"),
        T.sha256_text(name).alias("sha"), T.group_key(name, kind, brand).alias("group_key"), T.normalize_company(F.concat(F.lit(" "), name, F.lit(" Co., LLC."))).alias("company"),
        T.valid_ticket_number(F.concat(F.when(F.col("p_partkey") % 2 == 0, " 26").otherwise("26-"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))).alias("two_digits"),
    )


@query("""SELECT c_custkey, coalesce(nullif(trim(regexp_replace(c_name || '   ' || c_mktsegment, '\\s+', ' ', 'g')), ''), '') AS clean, CASE WHEN c_acctbal >= 8 THEN 'x' END AS none, printf('%.1f KB', (c_custkey + 1024) / 1024.0::DOUBLE) AS size,
  replace(replace(c_name, '#', '<'), '<', '&lt;') AS escaped, upper(replace(c_name, '#', '_')) AS file_key_source FROM customer""")
def format_functions(spark, sf):
    c = table(spark, sf, "customer")
    name = F.col("c_name")
    return c.select(
        "c_custkey", T.clean_str(F.concat(name, F.lit("   "), F.col("c_mktsegment"))).alias("clean"), F.when(F.col("c_acctbal") >= 8, "x").alias("none"), D.fmt_size(F.col("c_custkey") + 1024).alias("size"),
        T.html_escape(F.replace(name, F.lit("#"), F.lit("<"))).alias("escaped"), T.safe_file_key(F.replace(name, F.lit("#"), F.lit("/"))).alias("file_key_source"),
    )


@query("""WITH n AS (SELECT DISTINCT p_name FROM part), c AS (SELECT p_name, seed, left(md5(p_name || '|' || seed), 6) AS h FROM n, range(65) r(seed)),
rgb AS (SELECT *, ('0x' || h[1:2])::INT AS r, ('0x' || h[3:4])::INT AS g, ('0x' || h[5:6])::INT AS b FROM c),
reserved(x, y, z) AS (VALUES (255, 0, 0), (255, 165, 0), (0, 0, 255), (128, 128, 128), (0, 255, 0), (255, 255, 0), (255, 69, 0), (139, 0, 0), (128, 0, 128), (255, 255, 255), (0, 0, 0)),
far AS (SELECT p_name, seed, h FROM rgb, reserved GROUP BY ALL HAVING min((r - x) ** 2 + (g - y) ** 2 + (b - z) ** 2) >= 6400)
SELECT p_name, '33' || h[5:6] || h[3:4] || h[1:2] AS color FROM (SELECT p_name, arg_min(h, seed) AS h FROM far GROUP BY 1)""")
def name_colors(spark, sf):
    """The stable colour of every distinct name, with a new alpha."""
    return table(spark, sf, "part").select("p_name").distinct().select("p_name", S.apply_alpha(S.stable_color(F.col("p_name")), 0.2).alias("color"))


@query("""SELECT l_orderkey, arg_max(l_shipmode, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) AS last_response, count(*)::INT AS response_count FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1""")
def latest_response(spark, sf):
    """The last entry of each order's history of responses, and its length."""
    li = table(spark, sf, "lineitem")
    entry = F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("said"))
    lists = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entry)).alias("h"))
    return lists.select("l_orderkey", U.latest_response(F.transform("h", lambda x: x["said"])).alias("r")).select("l_orderkey", "r.*")


@query(ctes(TICKETS_SQL, HITS_SQL) + f"""SELECT change, place::INT AS place, ticket_number, old_score, relevance_score FROM (SELECT *, row_number() OVER (PARTITION BY change ORDER BY ticket_number) AS place FROM (
  SELECT *, CASE WHEN NOT was_relevant AND is_relevant THEN 'newly_relevant' WHEN was_relevant AND NOT is_relevant THEN 'no_longer_relevant' WHEN abs(relevance_score - old_score) > 1e-6 THEN 'score_moved' ELSE 'unchanged' END AS change
  FROM (SELECT *, {_OLD} FROM scored))) WHERE place <= 5""")
def rescore_samples(spark, sf):
    """Five samples of each change: the limit is its feature."""
    old = score.score(tickets(spark, sf), RULES)
    third = lambda a, b, c: F.when(F.col("k") % 3 == 0, a).when(F.col("k") % 3 == 1, b).otherwise(F.col(c))
    before = old.withColumns({"relevance_score": third(0.0, 0.9, "relevance_score"), "is_relevant": third(False, True, "is_relevant")})
    return score.rescore_samples(score.rescore(before, RULES))
