"""Queries on sources, sinks, canonical records, orders and documents that need files of their own or compare an order."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from noticeflow.functions import dates as D
from noticeflow.functions import status as S
from noticeflow.functions import text as T
from noticeflow.operators import cdc, filters, policy, score, spatial, views
from noticeflow.operators import utilities as U
from noticeflow.plans.adapters import PACKAGES_SQL, RULES, TAGS_SQL, TICKETS_SQL, TODAY, UTILITIES_SQL, now, packages, project_tags, table, tickets, today
from noticeflow.plans.notices import _CHANGES, _ROLLUP_SQL, HITS_SQL, REASONS, _features, _incoming, rolled, scored
from noticeflow.plans.pages_and_places import _HAV, project_lines
from noticeflow.plans.registry import ctes, query
from noticeflow.scratch import shared_dir
from noticeflow.sources import readers, writers

TODAY_SQL = f"DATE '{TODAY}'"


def folder(spark, label: str) -> str:
    """A new folder in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


# -- sources -------------------------------------------------------------------


def _letters(spark, sf) -> str:
    """One text file a nation: its customers' numbers and segments, a line each."""
    c = table(spark, sf, "customer")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_mktsegment"))), lambda x: F.concat(x["c_custkey"].cast("string"), F.lit(" "), x["c_mktsegment"]))
    path = folder(spark, "letters")
    c.groupBy("c_nationkey").agg(F.array_join(lines, "\n").alias("value")).repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    return path


LETTERS_SQL = "letters AS (SELECT string_agg(c_custkey || ' ' || c_mktsegment, chr(10) ORDER BY c_custkey) || chr(10) AS value FROM customer GROUP BY c_nationkey)"


@query(ctes(LETTERS_SQL) + "SELECT sha256(value) AS sha256, strlen(value) AS bytes FROM letters")
def fingerprint_files(spark, sf):
    return readers.fingerprint_files(spark, f"{_letters(spark, sf)}/*/*.txt").select("sha256", "bytes")


@query(ctes(LETTERS_SQL) + "SELECT value AS text FROM letters")
def text_documents(spark, sf):
    return readers.read_text_documents(spark, _letters(spark, sf)).select("text")


@query(ctes(LETTERS_SQL) + "SELECT value AS html FROM letters UNION ALL SELECT NULL FROM nation")
def page_snapshots(spark, sf):
    """The saved pages, and a page a nation that was never saved: missing, not failed."""
    path = _letters(spark, sf)
    wanted = readers.read_page_snapshots(spark, path).select(F.col("path").alias("source_html_path"))
    never = table(spark, sf, "nation").select(F.concat(F.lit("pages/never-"), F.col("n_nationkey").cast("string"), F.lit(".html")).alias("source_html_path"))
    return readers.read_page_snapshots(spark, path, wanted.unionByName(never), depth=2).select("html")


@query(ctes(PACKAGES_SQL) + """SELECT project_id, project_name, owner, status, strftime(est_start_date, '%Y-%m-%d') AS est_start_date, strftime(act_end_date, '%Y-%m-%d') AS act_end_date FROM packages WHERE owner LIKE '%1%'
UNION ALL SELECT project_id, project_name, owner, status, strftime(est_start_date, '%Y-%m-%d'), strftime(act_end_date, '%Y-%m-%d') FROM packages WHERE owner NOT LIKE '%1%'""")
def features_feed(spark, sf):
    """Projects written as feature collections, a file an owner, and read by owner and by all other owners: two layers, one after the other."""
    ms = lambda c: (F.unix_date(c).cast("long") * 86_400_000).cast("string")
    p = packages(spark, sf)
    props = F.struct(
        F.col("project_id").cast("string").alias("ProjectID"), F.concat(F.lit("  "), "project_name", F.lit("\t")).alias("ProjectName"), F.col("owner").alias("Owner"),
        F.coalesce("status", F.lit("  ")).alias("Status"), ms(F.col("est_start_date")).alias("EstStartDate"), ms(F.col("act_end_date")).alias("ActEndDate"),
    )
    doc = p.groupBy("owner").agg(F.to_json(F.struct(F.collect_list(F.struct(F.lit("{}").alias("geometry"), props.alias("properties"))).alias("features"))).alias("value"))
    path = folder(spark, "features")
    doc.withColumnRenamed("owner", "o").repartition("o").write.partitionBy("o").text(path)
    read = lambda negate: readers.read_features(spark, path, "%1%", negate)
    out = readers.union_layers(read(False), read(True))
    return out.select("project_id", "project_name", "owner", "status", D.fmt_date_or_null(F.col("est_start_date")).alias("est_start_date"), D.fmt_date_or_null(F.col("act_end_date")).alias("act_end_date"))


@query(ctes(TICKETS_SQL, HITS_SQL) + "SELECT ticket_number, relevance_score FROM scored WHERE is_relevant AND status = 'active'")
def stored_tickets(spark, sf):
    path = folder(spark, "tickets")
    scored(spark, sf).select("ticket_number", "relevance_score", "is_relevant", "status").write.parquet(path)
    return readers.load_tickets(spark, path, relevant=True, status="active").select("ticket_number", "relevance_score")


@query(ctes(PACKAGES_SQL) + "SELECT project_id, CASE WHEN project_id % 3 > 0 THEN strftime(est_start_date, '%Y-%m-%d') END AS est_start_date FROM packages")
def stored_features(spark, sf):
    """Dates are stored as text; what is no date is read as null."""
    path = folder(spark, "packages")
    text = F.when(F.col("project_id") % 3 == 0, "soon").otherwise(F.col("est_start_date").cast("string"))
    packages(spark, sf).select("project_id", text.alias("est_start_date")).write.parquet(path)
    return readers.load_features(spark, path).select("project_id", D.fmt_date_or_null(F.col("est_start_date")).alias("est_start_date"))


# -- sinks ---------------------------------------------------------------------


@query(ctes(TICKETS_SQL) + f"SELECT c.k, t.county, t.done_for FROM ({_CHANGES}) c JOIN tickets t USING (k) WHERE change <> 'unchanged'")
def appended_snapshots(spark, sf):
    """The payload of every new version, appended in two batches to the history."""
    incoming, stored = _incoming(spark, sf)
    stored = stored.withColumn("latest_content_hash", cdc.content_hash(stored))
    path = folder(spark, "history")
    for half in (0, 1):
        changes = cdc.capture_changes(incoming.where(F.col("k") % 2 == half), stored, "ticket_number", now())
        writers.append(cdc.snapshots(changes, "ticket_number"), path)
    said = spark.read.parquet(path).select(F.from_json("payload", "k long, county string, done_for string").alias("p"))
    return said.select("p.k", "p.county", "p.done_for")


@query(ctes(TICKETS_SQL) + f"""SELECT 'ok' AS status, count(*) AS found, count(*) FILTER (change = 'new') AS new, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'unchanged') AS unchanged,
  'a note' AS error FROM ({_CHANGES})""")
def audited_run(spark, sf):
    """Counters that are filled while the changes are written, as the run's audit row."""
    incoming, stored = _incoming(spark, sf)
    stored = stored.withColumn("latest_content_hash", cdc.content_hash(stored))
    changes, watch = writers.observed(cdc.capture_changes(incoming, stored, "ticket_number", now()), f"run-{uuid.uuid4().hex[:8]}")
    changes.select("k", "change").write.parquet(folder(spark, "changes"))
    import datetime

    at = datetime.datetime(2001, 8, 1, 12)
    path = folder(spark, "audit")
    writers.append(writers.run_audit(spark, watch, at, at, "ok", "a note"), path)
    return spark.read.parquet(path).select("status", "found", "new", "changed", "unchanged", "error")


@query(ctes(PACKAGES_SQL) + """, i AS (SELECT * FROM packages WHERE project_id % 5 <> 0 AND owner::INT < 18),
c AS (SELECT project_id, owner, CASE WHEN project_id % 3 = 0 THEN 'old' ELSE status END AS status FROM packages WHERE project_id % 7 <> 0)
SELECT project_id, CASE WHEN i.project_id IS NULL THEN c.status ELSE i.status END AS status FROM i FULL JOIN c USING (project_id) WHERE i.project_id IS NOT NULL OR c.owner NOT IN (SELECT owner FROM i)""")
def synced_table(spark, sf):
    """The synchronised features as a new version of their table."""
    path = writers.sync_table(cdc.sync_owner_scoped(*_features(spark, sf)), folder(spark, "synced"), 2)
    return spark.read.parquet(path).select("project_id", "status")


_SHAPES = f"""g AS (SELECT t.*, coalesce(has_late_utility, false) OR coalesce(blocking, 0) > 0 AS caution, CASE WHEN secondary_latitude IS NOT NULL AND {_HAV} > 50 THEN 'line' ELSE 'point' END AS kind,
    coalesce(done_for = 'CITY WATER', false) AS apart FROM tickets t LEFT JOIN rolled USING (k) WHERE latitude IS NOT NULL),
s AS (SELECT 'by county' AS layer, county AS bucket, kind AS shape, 'ff0000ff' AS color, * FROM g WHERE NOT is_cancelled AND NOT apart
  UNION ALL SELECT 'circles', 'dig zone', 'circle', 'ff808080', * FROM g WHERE NOT is_cancelled AND NOT apart AND kind = 'point'
  UNION ALL SELECT 'cancelled_14d', 'cancelled', kind, 'ff808080', * FROM g WHERE is_cancelled AND NOT apart AND call_date >= {TODAY_SQL} - 14
  UNION ALL SELECT 'contractor_other', 'not relevant', kind, 'ff800080', * FROM g WHERE apart)"""


@query(ctes(TICKETS_SQL, UTILITIES_SQL, _SHAPES) + """SELECT layer, bucket, shape, name, color, caution, CASE shape WHEN 'circle' THEN 33 WHEN 'line' THEN 2 ELSE 1 END::INT AS vertices,
  round(CASE shape WHEN 'circle' THEN longitude + 25 / 111320.0::DOUBLE / cos(radians(latitude)) ELSE longitude END, 7) AS x, round(latitude, 7) AS y,
  round(CASE shape WHEN 'circle' THEN longitude + 25 / 111320.0::DOUBLE / cos(radians(latitude)) WHEN 'line' THEN secondary_longitude ELSE longitude END, 7) AS last_x
FROM (SELECT *, ticket_number AS name FROM s)""")
def map_shapes(spark, sf):
    """Every shape of the map, written by layer and read back: its first and last vertex, name, colour and caution."""
    layers = spatial.map_layers(rolled(spark, sf), {"by county": F.col("county")}, today(), {"by county": F.lit("ff0000ff")}, F.col("done_for") == "CITY WATER")
    path = folder(spark, "map")
    writers.write_map_layers(layers, path)
    rows = spark.read.schema(layers.schema).json(path)
    edge = lambda i, axis: F.round(F.element_at("vertices", i)[axis], 7)
    return rows.select("layer", "bucket", "shape", "name", "color", "caution", F.size("vertices").alias("vertices"), edge(1, "x").alias("x"), edge(1, "y").alias("y"), edge(-1, "x").alias("last_x"))


@query(ctes(PACKAGES_SQL, TICKETS_SQL, TAGS_SQL) + f"""SELECT 'packages' AS layer, CASE WHEN act_end_date BETWEEN {TODAY_SQL} - 30 AND {TODAY_SQL} THEN 'recent' WHEN lower(coalesce(status, '')) = 'committed' THEN 'committed' ELSE 'active' END AS bucket,
  project_id, project_name AS name, CASE WHEN act_end_date BETWEEN {TODAY_SQL} - 30 AND {TODAY_SQL} THEN 'ff808080' WHEN lower(coalesce(status, '')) = 'committed' THEN 'ffff0000' ELSE 'ff008000' END AS color, coalesce(n, 0) AS tickets
FROM packages LEFT JOIN (SELECT project_name, count(*) AS n FROM tagged GROUP BY 1) USING (project_name) WHERE owner::INT < 12 AND project_id % 9 <> 0
UNION ALL SELECT 'conflict', owner, project_id, project_name, '66808080', 0 FROM packages WHERE owner::INT >= 12 AND project_id % 9 <> 0""")
def project_layers(spark, sf):
    """Own projects by stage and other owners' as the subdued layer; features without geometry are not drawn."""
    lines = project_lines(spark, sf).select("project_id", F.when(F.col("project_id") % 9 != 0, F.col("geometry")).otherwise('{"type":"Point"}').alias("geometry"))
    features = packages(spark, sf).join(lines, "project_id")
    own = F.col("owner").cast("int") < 12
    a = spatial.package_layers(features.where(own).select("project_id", "project_name", "status", "act_end_date", "geometry"), views.package_counts(project_tags(tickets(spark, sf))), today())
    b = spatial.conflict_layer(features.where(~own)).withColumn("tickets", F.lit(0).cast("long"))
    names = ["layer", "bucket", "project_id", "name", "color", "tickets"]
    return a.select(*names).unionByName(b.select(*names))


_STACKED = f"""v AS (SELECT *, regexp_replace(regexp_replace(lower(caller_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM tickets LEFT JOIN rolled USING (k)),
stacked AS (SELECT slug, 'relevant_active' AS slice FROM v WHERE NOT is_cancelled UNION ALL SELECT slug, 'relevant_expiring_7d' FROM v WHERE NOT is_cancelled AND expiration_date <= {TODAY_SQL} + 7
  UNION ALL SELECT slug, 'relevant_late_utilities' FROM v WHERE NOT is_cancelled AND has_late_utility)"""


@query(ctes(TICKETS_SQL, UTILITIES_SQL, _STACKED) + """SELECT slug, slice, count(*) AS rows FROM stacked GROUP BY ALL
UNION ALL SELECT DISTINCT slug, 'relevant_active', 0 FROM v WHERE slug NOT IN (SELECT slug FROM stacked WHERE slice = 'relevant_active')""")
def slice_counts(spark, sf):
    """The folders of every caller: the active slice always, others where they have rows."""
    view = rolled(spark, sf).withColumn("slug", T.slugify(F.col("caller_name")))
    slices = {k: v for k, v in views.export_slices(today()).items() if k in ("relevant_active", "relevant_expiring_7d", "relevant_late_utilities")}
    return writers.slice_counts(views.stack_slices(view, slices).select("slug", "slice"), view)


@query(ctes(TICKETS_SQL, UTILITIES_SQL, _STACKED.replace("lower(caller_name)", "lower(county || ' ' || is_cancelled)")) + """SELECT slug, slice, count(*) AS rows, min(ticket_number) AS first FROM (
  SELECT slug, 'relevant_active' AS slice, ticket_number FROM v WHERE NOT is_cancelled UNION ALL SELECT slug, 'relevant_cancelled_7d', ticket_number FROM v WHERE is_cancelled AND call_date >= """ + TODAY_SQL + """ - 7) GROUP BY ALL
UNION ALL SELECT DISTINCT slug, 'relevant_active', 0, NULL FROM v WHERE is_cancelled""")
def written_slices(spark, sf):
    """The tree of slices as it is read back from its files: rebuilt over an older one, with a header alone where a folder has no rows."""
    view = rolled(spark, sf).withColumn("slug", T.slugify(F.concat_ws(" ", "county", F.col("is_cancelled").cast("string"))))
    slices = {k: v for k, v in views.export_slices(today()).items() if k in ("relevant_active", "relevant_cancelled_7d")}
    stacked, out = views.stack_slices(view, slices).select("slug", "slice", "ticket_number", "county"), folder(spark, "slices")
    writers.write_slices(stacked.withColumn("slug", F.lit("old")), out)
    writers.write_slices(stacked, out, keys=view)
    lines = spark.read.option("recursiveFileLookup", True).text(out).withColumn("file", F.input_file_name())
    at = lambda name: F.regexp_extract("file", f"{name}=([^/]*)/", 1).alias(name)
    row = F.when(F.col("value") != "ticket_number,county", F.split("value", ",")[0])
    return lines.groupBy(at("slug"), at("slice")).agg(F.count(row).alias("rows"), F.min(row).alias("first"))


@query(ctes(TICKETS_SQL, UTILITIES_SQL, HITS_SQL) + f"""SELECT (SELECT count(*) FROM tickets) AS total_tickets, (SELECT count(*) FROM scored WHERE is_relevant) AS total_relevant,
  (SELECT strftime(min(call_date), '%Y-%m-%d') FROM scored WHERE is_relevant) AS call_date_min, (SELECT strftime(max(call_date), '%Y-%m-%d') FROM scored WHERE is_relevant) AS call_date_max,
  (SELECT 'relevant_active=' || count(*) FILTER (NOT is_cancelled) || ',relevant_cancelled_7d=' || count(*) FILTER (is_cancelled AND call_date >= {TODAY_SQL} - 7) FROM tickets) AS files,
  (SELECT count(DISTINCT county) FROM tickets) AS slice_count, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT lower(replace(county, '_', '-')) AS s FROM tickets)) AS slice_dirs""")
def export_head(spark, sf):
    """The manifest of an export: totals, date range, outputs in order, folders."""
    t = scored(spark, sf)
    slices = views.export_slices(today())
    frames = {name: t.where(slices[name]) for name in ("relevant_active", "relevant_cancelled_7d")}
    out = writers.export_summary(t, frames, t.select(T.slugify(F.col("county")).alias("slug")), now())
    files = F.array_join(F.transform("files", lambda f: F.concat(f["name"], F.lit("="), f["rows"].cast("string"))), ",")
    return out.select(
        "total_tickets", "total_relevant", D.fmt_date_or_null(F.col("call_date_min")).alias("call_date_min"), D.fmt_date_or_null(F.col("call_date_max")).alias("call_date_max"),
        files.alias("files"), "slice_count", F.array_join("slice_dirs", ",").alias("slice_dirs"),
    )


_DOCS = f"""a AS (SELECT * FROM scored WHERE is_relevant AND status = 'active'),
top AS (SELECT * FROM a ORDER BY expiration_date NULLS LAST, ticket_number LIMIT 100),
due AS (SELECT * FROM a WHERE expiration_date <= {TODAY_SQL} + 7), due_top AS (SELECT * FROM due ORDER BY expiration_date, ticket_number LIMIT 100),
c AS (SELECT county AS county, count(*) AS n FROM scored WHERE is_relevant GROUP BY 1), g AS (SELECT excavator_name AS work_group, count(*) AS n FROM scored WHERE is_relevant GROUP BY 1),
again AS (SELECT * FROM scored WHERE is_relevant AND k % 3 = 0), again_top AS (SELECT * FROM again ORDER BY call_date DESC, ticket_number LIMIT 50),
bad AS (SELECT * FROM scored WHERE done_for IS NULL), bad_top AS (SELECT * FROM bad ORDER BY ticket_number LIMIT 50)"""


@query(ctes(TICKETS_SQL, HITS_SQL, _DOCS) + f"""SELECT 'tickets_active' AS name, (SELECT count(*) FROM a) AS count, (SELECT string_agg(ticket_number, ',' ORDER BY expiration_date NULLS LAST, ticket_number) FROM top) AS said
UNION ALL SELECT 'tickets_expiring', (SELECT count(*) FROM due), (SELECT coalesce(string_agg(ticket_number, ',' ORDER BY expiration_date, ticket_number), '') FROM due_top)
UNION ALL SELECT 'by_county', NULL, (SELECT string_agg(county || ':' || n, ',' ORDER BY n DESC, county) FROM c) UNION ALL SELECT 'by_work_group', NULL, (SELECT string_agg(work_group || ':' || n, ',' ORDER BY n DESC, work_group) FROM g)
UNION ALL SELECT 'recent_changes', least((SELECT count(*) FROM again), (SELECT count(*) FROM again)), (SELECT coalesce(string_agg(ticket_number, ',' ORDER BY call_date DESC, ticket_number), '') FROM again_top)
UNION ALL SELECT 'parse_failures', (SELECT count(*) FROM bad), (SELECT coalesce(string_agg(ticket_number, ',' ORDER BY ticket_number), '') FROM bad_top)
UNION ALL SELECT 'summary', count(*), count(*) FILTER (is_relevant) || ',' || count(*) FILTER (is_relevant AND status = 'active') || ',' || count(*) FILTER (is_relevant AND status = 'active' AND expiration_date <= {TODAY_SQL} + 7)
  || ',' || count(*) FILTER (status = 'cancelled') || ',' || count(*) FILTER (status = 'expired') || ',' || count(*) FILTER (done_for IS NULL) FROM scored""")
def dashboard_documents(spark, sf):
    """The seven documents, written as JSON and read back: what they count, and what they list in which order."""
    t = scored(spark, sf).withColumns({
        "updated_at": F.col("call_date").cast("timestamp"), "probable_company": F.col("excavator_name"), "probable_work_group": F.lit(None).cast("string"),
    })
    history = t.select("ticket_number").unionByName(t.where("k % 3 = 0").select("ticket_number"))
    failures = policy.quarantine(t, {"missing_required_fields": F.col("done_for").isNotNull()}, now())[1]
    docs = views.dashboard_documents(t, history, failures, now(), today())
    path = folder(spark, "docs")
    writers.write_json_docs(docs, path)
    joined = lambda items, f: F.array_join(F.transform(items, f), ",")
    number, pair = (lambda x: x["ticket_number"]), (lambda k: lambda x: F.concat(x[k], F.lit(":"), x["total"].cast("string")))
    said = {
        "tickets_active": joined("tickets", number), "tickets_expiring": joined("tickets", number), "recent_changes": joined("tickets", number), "parse_failures": joined("failures", number),
        "by_county": joined("counties", pair("county")), "by_work_group": joined("groups", pair("work_group")),
        "summary": F.concat_ws(",", *[F.col(c).cast("string") for c in ("relevant", "active_relevant", "expiring_soon", "cancelled", "expired", "parse_failures_open")]),
    }
    out = None
    for name, value in said.items():
        rows = spark.read.schema(docs[name].schema).json(f"{path}/{name}")
        count = F.col("total_tickets") if name == "summary" else F.col("count") if "count" in rows.columns else F.lit(None)
        part = rows.select(F.lit(name).alias("name"), count.cast("long").alias("count"), value.alias("said"))
        out = part if out is None else out.unionByName(part)
    return out


# -- records -------------------------------------------------------------------


@query(ctes(TICKETS_SQL) + f"""SELECT ticket_number, strftime(CASE WHEN k % 4 = 0 THEN call_date + 1 ELSE call_date END, '%Y-%m-%d') AS call_date, CASE WHEN k % 4 = 0 AND k % 8 = 0 THEN 'PAGE ' || k ELSE excavator_name END AS excavator_name,
  CASE WHEN k % 4 = 0 THEN 'html' ELSE 'row_only' END AS parse_method, CASE WHEN k % 4 = 0 AND k % 3 <> 0 THEN round(latitude, 6) END AS latitude, is_cancelled OR (k % 4 = 0 AND k % 12 = 0) AS is_cancelled,
  CASE WHEN is_cancelled OR (k % 4 = 0 AND k % 12 = 0) THEN 'cancelled' WHEN expiration_date IS NULL THEN 'unknown' WHEN expiration_date < {TODAY_SQL} THEN 'expired' ELSE 'active' END AS status, nullif(remarks_, '') AS remarks
FROM (SELECT *, trim(regexp_replace(remarks, '\\s+', ' ', 'g')) AS remarks_ FROM tickets)""")
def normalized_tickets(spark, sf):
    """Export rows of all notices and detail pages of every fourth: the page wins where it has a value."""
    t, k = tickets(spark, sf), F.col("k")
    us = lambda c: F.date_format(c, "MM/dd/yyyy")
    rows = t.select(
        F.concat(F.lit(" "), F.lower("ticket_number")).alias("ticket_number"), "county", us(F.col("call_date")).alias("call_date_raw"), us(F.col("expiration_date")).alias("expiration_date_raw"),
        F.concat(F.lit("\t"), "excavator_name").alias("excavator_name_raw"), F.col("work_type").alias("work_type_raw"), F.when(F.col("is_cancelled"), "VOIDED").otherwise("Normal").alias("status_raw"),
        F.col("remarks").alias("remarks_raw"), F.col("done_for").alias("work_done_for_raw"),
    )
    details = t.where("k % 4 = 0").select(
        F.concat(F.lit(" "), F.lower("ticket_number")).alias("ticket_number"), D.fmt_date_or_null(F.date_add("call_date", 1)).alias("call_date"), (k % 12 == 0).alias("is_cancelled"),
        F.when(k % 8 == 0, F.concat(F.lit("PAGE "), k.cast("string"))).otherwise(F.lit(" \n")).alias("excavator_name"),
        F.when(k % 3 == 0, F.lit("north")).otherwise(F.round("latitude", 6).cast("string")).alias("latitude"),
    )
    out = views.normalize_tickets(rows, details, now())
    return out.select("ticket_number", D.fmt_date_or_null(F.col("call_date")).alias("call_date"), "excavator_name", "parse_method", "latitude", "is_cancelled", "status", "remarks")


@query(ctes(TICKETS_SQL) + """SELECT ticket_number, CASE WHEN k % 4 = 0 AND k % 8 = 0 THEN 'new place' ELSE county END AS location_text, CASE WHEN k % 5 = 0 AND k % 4 = 0 THEN strftime(call_date, '%Y-%m-%d') WHEN k % 5 <> 0 THEN strftime(legal_start_date, '%Y-%m-%d') END AS legal_start_date,
  CASE WHEN k % 4 = 0 AND k % 3 = 0 THEN 1.5 ELSE latitude END::DOUBLE AS latitude, k % 4 = 0 AS has_late_utility FROM tickets""")
def reparsed(spark, sf):
    """Pages of every fourth notice parsed again: flags always, places when not blank, legal start only if missing, coordinates when present."""
    t, k = tickets(spark, sf), F.col("k")
    current = t.select("ticket_number", F.col("county").alias("location_text"), F.when(k % 5 != 0, F.col("legal_start_date")).alias("legal_start_date"), "latitude", F.lit(False).alias("has_late_utility"))
    details = t.where("k % 4 = 0").select(
        "ticket_number", F.when(k % 8 == 0, "new place").otherwise(" ").alias("location_text"), F.col("call_date").alias("legal_start_date"), F.when(k % 3 == 0, F.lit(1.5)).alias("latitude"), F.lit(True).alias("has_late_utility")
    )
    return views.reparse_update(current, details).withColumn("legal_start_date", D.fmt_date_or_null(F.col("legal_start_date")))


@query(ctes(TICKETS_SQL, HITS_SQL) + f"SELECT k AS ticket_id, ticket_number FROM scored WHERE is_relevant AND expiration_date = {TODAY_SQL} + 10 AND status NOT IN ('cancelled', 'expired') AND k % 2 = 0")
def stored_reminders(spark, sf):
    """Reminder events with the id of their ticket; events of tickets that are not stored go."""
    t = scored(spark, sf).withColumns({"lead_days": F.lit(10), "dry_run": F.lit(False)})
    events = cdc.reminder_events(t.where(filters.reminder_eligible(F.date_add(today(), 10))), now())
    stored = t.where("k % 2 = 0").select("ticket_number", F.col("k").alias("ticket_id"))
    return cdc.attach_ticket_ids(events, stored).select("ticket_id", "ticket_number")


@query(ctes(TICKETS_SQL, HITS_SQL) + f"SELECT excavator_name AS work_group, ticket_number, strftime(expiration_date, '%Y-%m-%d') AS target_date FROM scored WHERE is_relevant AND expiration_date = {TODAY_SQL} + 14 AND status NOT IN ('cancelled', 'expired')")
def reminder_lines(spark, sf):
    t = scored(spark, sf).withColumns({"probable_company": F.col("excavator_name"), "probable_work_group": F.lit("")})
    out = views.reminder_lines(t.where(filters.reminder_eligible(D.target_date(now(), 14))))
    return out.withColumn("target_date", D.fmt_date_or_null(F.col("target_date")))


@query(ctes(TICKETS_SQL, HITS_SQL) + f"""SELECT ticket_number, relevance_score, is_relevant, CASE WHEN ticket_number IN ('0000000005', '0000000010') THEN 'manual_exclude_override'
  WHEN ticket_number IN ('0000000007', '0000000077') THEN 'manual_include_override' ELSE {REASONS} END AS reasons FROM scored""")
def score_rules_table(spark, sf):
    """The rules stored as a table, read back and applied."""
    path = folder(spark, "rules")
    rows = [(f"{i:02}", r.id, r.pattern, r.weight, r.field, r.kind, r.case_sensitive, r.negative) for i, r in enumerate(RULES.rules)]
    spark.createDataFrame(rows, "n string, id string, pattern string, weight double, field string, kind string, case_sensitive boolean, negative boolean").write.parquet(path)
    stored = spark.read.parquet(path).withColumn("id", F.concat("n", F.lit("|"), "id"))
    found = score.ruleset_from(stored, threshold=RULES.threshold, contractors=RULES.contractors, work_keywords=RULES.work_keywords, include=RULES.include, exclude=RULES.exclude)
    out = score.score(tickets(spark, sf), found)
    plain = F.transform("relevance_reasons", lambda r: F.regexp_replace(r, r"^([+-])\d\d\|", "$1"))
    return out.select("ticket_number", "relevance_score", "is_relevant", F.array_join(plain, ";").alias("reasons"))


@query("SELECT n_name AS name FROM nation WHERE n_regionkey <> 2 AND lower(n_name) LIKE '%n_1%'")
def enabled_counties(spark, sf):
    config = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") != 2, True).alias("enabled"))
    return filters.enabled_counties(config, "N_1").select("name")


@query("SELECT s_suppkey, s_suppkey % 3 = 0 OR s_suppkey % 5 = 0 AS allowed FROM supplier")
def allowed_domains(spark, sf):
    k = F.col("s_suppkey")
    allowed = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("c"), (k % 5).cast("string")), F.lit("x")))
    return table(spark, sf, "supplier").select("s_suppkey", filters.domain_allowed(allowed, F.lit("c0")).alias("allowed"))


@query("""SELECT c_custkey, provider, name FROM (SELECT c_custkey, 'east' AS provider, c_name AS name FROM customer WHERE c_nationkey % 2 = 0 UNION ALL SELECT c_custkey, 'west', NULL FROM customer WHERE c_nationkey % 3 = 0)""")
def provider_projects(spark, sf):
    """Two registered providers, of which one has no names."""
    c = table(spark, sf, "customer")
    policy.register_provider("east", lambda s, customer: c.where("c_nationkey % 2 = 0").select("c_custkey", F.col("c_name").alias("name")))
    policy.register_provider("west", lambda s, customer: c.where("c_nationkey % 3 = 0").select("c_custkey"))
    return policy.list_projects(spark, "any").select("c_custkey", "provider", "name")


@query("""WITH p AS (SELECT *, min(p_partkey) OVER (PARTITION BY p_size) AS leader FROM part), c AS (SELECT leader, p_type, count(*) AS n FROM p GROUP BY ALL),
label AS (SELECT leader, p_type FROM (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY n DESC, p_type) AS r FROM c) WHERE r = 1)
SELECT p.leader, left(sha256(upper(arg_min(p.p_type, p_partkey)) || '|' || upper(arg_min(p_name, p_partkey)) || '|' || upper(arg_min(p_brand, p_partkey))), 16) AS group_key, count(*) AS tickets,
  strftime(min(DATE '2001-01-01' + (p_partkey % 300)::INT), '%Y-%m-%d') AS first_seen, strftime(max(DATE '2001-01-01' + (p_partkey % 300)::INT), '%Y-%m-%d') AS last_seen, min(p_partkey) AS representative, any_value(label.p_type) AS label
FROM p JOIN label ON p.leader = label.leader GROUP BY p.leader""")
def cluster_rows(spark, sf):
    """Clusters that are given (parts of one size) summed up: key, usual company, dates and representative."""
    from noticeflow.operators import cluster

    p = table(spark, sf, "part")
    led = p.join(p.groupBy("p_size").agg(F.min("p_partkey").alias("leader")), "p_size")
    led = led.withColumns({"probable_company": F.col("p_type"), "call_date": F.date_add(F.lit("2001-01-01").cast("date"), (F.col("p_partkey") % 300).cast("int"))})
    out = cluster.cluster_summary(led, T.group_key(F.col("p_type"), F.col("p_name"), F.col("p_brand")), "p_partkey")
    return out.withColumns({c: D.fmt_date_or_null(F.col(c)) for c in ("first_seen", "last_seen")})


_KINDS = [(0, [(0, 0, 3, 1)]), (1, [(0, 0, 3, 1), (5, 5, 6, 7), (6, 7, 8, 8)]), (2, [(0, 0, 4, 0), (4, 0, 4, 4), (4, 4, 0, 0)]), (3, [(0, 0, 4, 0), (4, 0, 4, 4), (4, 4, 0, 0), (1, 1, 2, 1), (2, 1, 1, 2), (1, 2, 1, 1)])]


@query(f"""SELECT s_suppkey AS project_id, x1 + s_suppkey AS x1, y1::DOUBLE AS y1, x2 + s_suppkey AS x2, y2::DOUBLE AS y2 FROM supplier JOIN (VALUES
  {", ".join(str((m, *c)) for m, segments in _KINDS for c in segments)}) k(m, x1, y1, x2, y2) ON s_suppkey % 5 = m""".replace("x1 + s_suppkey", "(x1 + s_suppkey)::DOUBLE").replace("x2 + s_suppkey", "(x2 + s_suppkey)::DOUBLE"))
def segments_of_kinds(spark, sf):
    """Segments of lines, multiple lines, polygons and multiple polygons; points have none."""
    k = F.col("s_suppkey")

    def points(*xy):
        return F.concat(F.lit("["), F.concat_ws(",", *[F.concat(F.lit("["), (k + x).cast("string"), F.lit(f",{y}]")) for x, y in xy]), F.lit("]"))

    wrap = lambda kind, *parts: F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), *parts, F.lit("}"))
    many = lambda *parts: F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
    ring, hole = points((0, 0), (4, 0), (4, 4), (0, 0)), points((1, 1), (2, 1), (1, 2), (1, 1))
    shape = (
        F.when(k % 5 == 0, wrap("LineString", points((0, 0), (3, 1)))).when(k % 5 == 1, wrap("MultiLineString", many(points((0, 0), (3, 1)), points((5, 5), (6, 7), (8, 8)))))
        .when(k % 5 == 2, wrap("Polygon", many(ring))).when(k % 5 == 3, wrap("MultiPolygon", many(many(ring), many(hole)))).otherwise(wrap("Point", F.lit("[1,2]")))
    )
    features = table(spark, sf, "supplier").select(k.alias("project_id"), F.col("s_name").alias("project_name"), shape.alias("geometry"))
    return spatial.segments(features).select("project_id", "x1", "y1", "x2", "y2")


# -- scalar functions ----------------------------------------------------------


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey / 8.0::DOUBLE WHEN 1 THEN -(c_custkey::DOUBLE) END AS number, CASE WHEN c_custkey % 2 = 0 THEN strftime(DATE '1970-01-01' + (c_custkey % 20000)::INT, '%Y-%m-%d') END AS day,
  CASE WHEN c_custkey % 3 = 0 THEN strftime(DATE '2001-01-01' + (c_custkey % 365)::INT, '%Y-%m-%d') END AS iso, CASE WHEN c_custkey % 5 = 0 THEN '—' ELSE strftime(DATE '2000-12-31' + (c_custkey % 365)::INT, '%b ') || (extract(day FROM DATE '2000-12-31' + (c_custkey % 365)::INT)) || strftime(DATE '2000-12-31' + (c_custkey % 365)::INT, ', %Y') END AS shown,
  CASE WHEN c_custkey % 100 >= 80 THEN 'high' WHEN c_custkey % 100 >= 50 THEN 'medium' WHEN c_custkey % 100 >= 30 THEN 'low' ELSE 'minimal' END AS band,
  'Reminder: ' || (c_custkey % 3) || ' relevant ' || CASE WHEN c_custkey % 3 = 1 THEN 'ticket' ELSE 'tickets' END || ' expire in 4 days' AS subject,
  CASE c_custkey % 3 WHEN 0 THEN 'Unknown error' WHEN 1 THEN 'HTML parse error' ELSE c_mktsegment END AS failure, upper(replace(replace(c_name, '#', '_'), 'C', '_')) AS file_key, c_custkey % 4 <> 3 AND (c_custkey % 4 <> 2) AS valid,
  replace(replace(c_name, '#', '&lt;'), 'r', 'r<br>') AS broken FROM customer""")
def more_functions(spark, sf):
    """Numbers, days, labels and keys as texts give them, good ones and bad ones."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    name, say = F.col("c_name"), k.cast("string")
    number = F.when(k % 4 == 0, F.concat(F.lit(" "), (k / 8.0).cast("string"), F.lit("\n"))).when(k % 4 == 1, F.concat(F.lit("-"), say)).when(k % 4 == 2, F.concat(say, F.lit("d"))).otherwise("about 3")
    day = F.when(k % 2 == 0, ((k % 20000) * 86_400_000 + 3_600_000).cast("string")).otherwise("soon")
    date = F.date_add(F.lit("2001-01-01").cast("date"), (k % 365).cast("int"))
    key = F.when(k % 4 == 0, F.lpad(say, 10, "1")).when(k % 4 == 1, F.concat(F.lit(" tn20010801-"), F.lpad(say, 6, "0"))).when(k % 4 == 2, F.lit("12345")).otherwise(F.concat(F.lit("TN"), say))
    return c.select(
        "c_custkey", D.parse_float(number).alias("number"), D.fmt_date_or_null(D.epoch_ms_to_date(day)).alias("day"),
        D.fmt_date_or_null(D.parse_iso_date(F.when(k % 3 == 0, date.cast("string")).when(k % 3 == 1, "2001-02-30").otherwise(F.date_format(date, "MM/dd/yyyy")))).alias("iso"),
        D.format_day(F.when(k % 5 != 0, date)).alias("shown"), S.score_band((k % 100) / 100.0).alias("band"), T.subject_line(k % 3, 4).alias("subject"),
        S.failure_label(F.when(k % 3 == 0, "unknown").when(k % 3 == 1, "html_parse_error").otherwise(F.col("c_mktsegment"))).alias("failure"),
        T.safe_file_key(F.concat(F.lit("\t"), F.translate(name, "#C", "/:"))).alias("file_key"), T.valid_ticket_number(key).alias("valid"),
        T.nl2br(F.replace(F.replace(name, F.lit("#"), F.lit("<")), F.lit("r"), F.lit("r\n"))).alias("broken"),
    )


# -- orders --------------------------------------------------------------------


@query(ctes(TICKETS_SQL) + "SELECT ticket_number, row_number() OVER (ORDER BY expiration_date NULLS LAST, ticket_number) AS position FROM tickets")
def sorted_master(spark, sf):
    view = tickets(spark, sf).select("ticket_number", F.col("expiration_date").alias("expire_date"))
    return views.numbered(views.sort_master(view)).select("ticket_number", "position")


@query(ctes(TICKETS_SQL, UTILITIES_SQL) + "SELECT ticket_number, utility_code, row_number() OVER (ORDER BY ticket_number, coalesce(utility_code, '')) AS position FROM (SELECT DISTINCT ticket_number, code AS utility_code FROM tickets JOIN marked USING (k) WHERE NOT is_cancelled)")
def sorted_detail(spark, sf):
    t = rolled(spark, sf).withColumns({"location_text": F.lit(""), "intersection_text": F.lit("")})
    rows = U.utility_detail(t, today()).select("ticket_number", "utility_code").distinct()
    return views.numbered(views.sort_detail(rows)).select("ticket_number", "utility_code", "position")


@query(ctes(TICKETS_SQL) + "SELECT caller_name, n, row_number() OVER (ORDER BY n DESC, caller_name) AS position FROM (SELECT caller_name, count(*) AS n FROM tickets GROUP BY 1)")
def sorted_folders(spark, sf):
    counts = tickets(spark, sf).groupBy("caller_name").agg(F.count("*").alias("n"))
    return views.numbered(views.sort_folders(counts, "caller_name")).select("caller_name", "n", "position")


@query(ctes(TICKETS_SQL, HITS_SQL) + """SELECT 'county' AS axis, county AS name, row_number() OVER (ORDER BY n DESC, county) AS position FROM (SELECT county, count(*) AS n FROM scored WHERE is_relevant GROUP BY 1)
UNION ALL SELECT 'group', excavator_name, row_number() OVER (ORDER BY n DESC, excavator_name) FROM (SELECT excavator_name, count(*) FILTER (status = 'active') AS n FROM scored WHERE is_relevant GROUP BY 1)""")
def sorted_viewer_groups(spark, sf):
    t = scored(spark, sf).withColumns({"probable_company": F.col("excavator_name"), "probable_work_group": F.lit(None).cast("string")})
    a = views.numbered(views.sort_counties(views.by_county(t, today()))).select(F.lit("county").alias("axis"), F.col("county").alias("name"), "position")
    b = views.numbered(views.sort_groups(views.by_work_group(t))).select(F.lit("group").alias("axis"), F.col("work_group").alias("name"), "position")
    return a.unionByName(b)


@query(ctes(TICKETS_SQL, UTILITIES_SQL, TAGS_SQL) + "SELECT ticket_number, row_number() OVER (ORDER BY match_distance_m, ticket_number) AS position FROM tagged WHERE match_confidence = 'low' AND NOT is_cancelled")
def sorted_review(spark, sf):
    view = views.ticket_view(project_tags(rolled(spark, sf)), today())
    return views.numbered(views.sort_review(views.review_rows(view))).select("ticket_number", "position")


@query(ctes(PACKAGES_SQL) + "SELECT project_name, row_number() OVER (ORDER BY coalesce(est_end_date, act_end_date) NULLS LAST, project_name) AS position FROM packages")
def sorted_packages(spark, sf):
    out = views.sort_packages(views.packages_view(packages(spark, sf), project_tags(rolled(spark, sf)), today()))
    return views.numbered(out).select(F.col("package_name").alias("project_name"), "position")


@query(ctes(_ROLLUP_SQL.removeprefix("WITH ").partition("SELECT slug, excavator_name, count(*) FILTER")[0]) + "SELECT slug, row_number() OVER (ORDER BY active DESC, excavator_name) AS position FROM (SELECT v.slug, any_value(names.excavator_name) AS excavator_name, count(*) FILTER (NOT is_cancelled) AS active FROM v JOIN names USING (slug) GROUP BY v.slug) WHERE active > 0")
def sorted_rollup(spark, sf):
    return views.numbered(views.sort_rollup(views.contractor_rollup(rolled(spark, sf), today(), "k"))).select("slug", "position")
