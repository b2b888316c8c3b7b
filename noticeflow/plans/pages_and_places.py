"""Queries on pages, texts, geometry, sources, policies and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from noticeflow.operators import extract, policy, spatial, views
from noticeflow.plans.adapters import PACKAGES_SQL, TAGS_SQL, TICKETS_SQL, now, packages, project_tags, table, tickets, today
from noticeflow.plans.notices import HITS_SQL, rolled, scored
from noticeflow.plans.registry import ctes, query
from noticeflow.scratch import shared_dir
from noticeflow.sources import readers, writers

# -- geometry ------------------------------------------------------------------

LINES_SQL = """
lines AS (
  SELECT s_suppkey AS project_id, 'P' || s_suppkey AS project_name, (-86.9)::DOUBLE + ((s_suppkey * 37) % 300)::DOUBLE / 1000 AS x1, 36.0::DOUBLE + ((s_suppkey * 53) % 200)::DOUBLE / 1000 AS y1,
    (-86.9)::DOUBLE + ((s_suppkey * 37) % 300 + 1 + s_suppkey % 3)::DOUBLE / 1000 AS x2, 36.0::DOUBLE + ((s_suppkey * 53) % 200 + s_suppkey % 4)::DOUBLE / 1000 AS y2 FROM supplier
)"""


def project_lines(spark, sf):
    """supplier as project lines of one segment, as GeoJSON features."""
    k = F.col("s_suppkey")
    x = lambda e: F.lit(-86.9) + e.cast("double") / 1000
    y = lambda e: F.lit(36.0) + e.cast("double") / 1000
    a, b = (k * 37) % 300, (k * 53) % 200
    pair = lambda p, q: F.concat(F.lit("["), p.cast("string"), F.lit(","), q.cast("string"), F.lit("]"))
    line = F.concat(F.lit('{"type":"LineString","coordinates":['), pair(x(a), y(b)), F.lit(","), pair(x(a + 1 + k % 3), y(b + k % 4)), F.lit("]}"))
    return table(spark, sf, "supplier").select(k.alias("project_id"), F.concat(F.lit("P"), k.cast("string")).alias("project_name"), line.alias("geometry"))


@query(ctes(LINES_SQL) + "SELECT project_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM lines")
def segments(spark, sf):
    s = spatial.segments(project_lines(spark, sf))
    return s.select("project_id", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


def _utm_sql(lon: str, lat: str) -> tuple[str, str]:
    n = spatial.FLATTENING / (2 - spatial.FLATTENING)
    radius = spatial.AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    q = 2 * n**0.5 / (1 + n)
    d = lambda v: f"{v!r}::DOUBLE"
    t = f"sinh(atanh(sin(radians({lat}))) - {d(q)} * atanh({d(q)} * sin(radians({lat}))))"
    away = f"radians({lon} + 87.0::DOUBLE)"
    xi, eta = f"atan2({t}, cos({away}))", f"atanh(sin({away}) / sqrt(1 + {t} * {t}))"
    x = " + ".join([eta, *[f"{d(a)} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(alpha, 1)]])
    y = " + ".join([xi, *[f"{d(a)} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(alpha, 1)]])
    return f"(500000 + {d(spatial.SCALE * radius)} * ({x}))", f"({d(spatial.SCALE * radius)} * ({y}))"


_E, _N = _utm_sql("longitude", "latitude")


@query(ctes(TICKETS_SQL) + f"SELECT ticket_number, round({_E}, 3) AS easting, round({_N}, 3) AS northing FROM tickets")
def utm(spark, sf):
    e, n = spatial.to_utm(F.col("longitude"), F.col("latitude"))
    return tickets(spark, sf).select("ticket_number", F.round(e, 3).alias("easting"), F.round(n, 3).alias("northing"))


_A, _B = _utm_sql("x1", "y1"), _utm_sql("x2", "y2")
NEAREST_SQL = ctes(TICKETS_SQL, LINES_SQL) + f""", p AS (SELECT ticket_number, {_E} AS px, {_N} AS py FROM tickets WHERE latitude IS NOT NULL),
m AS (SELECT project_id, project_name, {_A[0]} AS ax, {_A[1]} AS ay, {_B[0]} - {_A[0]} AS dx, {_B[1]} - {_A[1]} AS dy FROM lines),
d AS (SELECT *, greatest(0, least(1, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) AS t FROM p CROSS JOIN m),
r AS (SELECT ticket_number, project_id, project_name, sqrt((px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2) AS dist FROM d),
b AS (SELECT ticket_number, min(dist) AS dist, arg_min(project_name, (dist, project_id)) AS project_name FROM r GROUP BY 1),
matched AS (SELECT t.*, CASE WHEN dist <= 150 THEN b.project_name END AS project_name, CASE WHEN dist <= 25 THEN 'high' WHEN dist <= 75 THEN 'medium' WHEN dist <= 150 THEN 'low' ELSE 'none' END AS match_confidence, dist
  FROM tickets t LEFT JOIN b USING (ticket_number))
"""


@query(NEAREST_SQL + "SELECT ticket_number, project_name, match_confidence, round_even(dist, 2) AS match_distance_m FROM matched")
def nearest_line(spark, sf):
    lines = spatial.segments(project_lines(spark, sf))
    return spatial.match_projects(tickets(spark, sf), lines).select("ticket_number", "project_name", "match_confidence", "match_distance_m")


@query(NEAREST_SQL + "SELECT count(*) AS total, count(*) FILTER (match_confidence = 'high') AS high, count(*) FILTER (match_confidence = 'medium') AS medium, count(*) FILTER (match_confidence = 'low') AS low, count(*) FILTER (match_confidence = 'none' AND latitude IS NOT NULL) AS none, count(*) FILTER (latitude IS NULL) AS skipped FROM matched")
def match_stats(spark, sf):
    return views.match_stats(spatial.match_places(tickets(spark, sf), spatial.segments(project_lines(spark, sf))), F.col("n"))


_HAV = "2 * 6371000.0::DOUBLE * asin(sqrt(sin(radians(secondary_latitude - latitude) / 2) ** 2 + cos(radians(latitude)) * cos(radians(secondary_latitude)) * sin(radians(secondary_longitude - longitude) / 2) ** 2))"


@query(ctes(TICKETS_SQL) + f"SELECT ticket_number, round({_HAV}, 4) AS meters, round((longitude + secondary_longitude) / 2, 7) AS mid_x, round((latitude + secondary_latitude) / 2, 7) AS mid_y, CASE WHEN latitude IS NULL THEN NULL WHEN secondary_latitude IS NOT NULL AND {_HAV} > 50 THEN 'line' ELSE 'point' END AS kind FROM tickets")
def haversine(spark, sf):
    m = spatial.haversine_m(F.col("latitude"), F.col("longitude"), F.col("secondary_latitude"), F.col("secondary_longitude"))
    middle = lambda axis: F.round(spatial.midpoint()[axis], 7)
    return tickets(spark, sf).select("ticket_number", F.round(m, 4).alias("meters"), middle("x").alias("mid_x"), middle("y").alias("mid_y"), spatial.geometry_kind().alias("kind"))


@query(ctes(TICKETS_SQL) + """SELECT ticket_number, i::INT AS vertex, round(longitude + 25 / 111320.0::DOUBLE / cos(radians(latitude)) * cos(2 * pi() * (i % 32) / 32), 8) AS x, round(latitude + 25 / 111320.0::DOUBLE * sin(2 * pi() * (i % 32) / 32), 8) AS y
FROM tickets, range(33) r(i) WHERE latitude IS NOT NULL""")
def circle_ring(spark, sf):
    t = tickets(spark, sf).where("latitude IS NOT NULL")
    ring = t.select("ticket_number", F.posexplode(spatial.circle(F.col("latitude"), F.col("longitude"))).alias("vertex", "p"))
    return ring.select("ticket_number", "vertex", F.round("p.x", 8).alias("x"), F.round("p.y", 8).alias("y"))


@query(ctes(TICKETS_SQL) + f""", g AS (SELECT *, CASE WHEN secondary_latitude IS NOT NULL AND {_HAV} > 50 THEN 'line' ELSE 'point' END AS kind FROM tickets WHERE latitude IS NOT NULL)
SELECT 'by county' AS layer, county AS bucket, kind AS shape, count(*) AS n FROM g WHERE NOT is_cancelled GROUP BY ALL UNION ALL SELECT 'by contractor', excavator_name, kind, count(*) FROM g WHERE NOT is_cancelled GROUP BY ALL
UNION ALL SELECT 'circles', 'dig zone', 'circle', count(*) FROM g WHERE NOT is_cancelled AND kind = 'point' HAVING count(*) > 0 UNION ALL SELECT 'cancelled_14d', 'cancelled', kind, count(*) FROM g WHERE is_cancelled AND call_date >= DATE '2001-07-18' GROUP BY kind""")
def map_layers(spark, sf):
    axes = {"by county": F.col("county"), "by contractor": F.col("excavator_name")}
    return spatial.map_layers(rolled(spark, sf), axes, today()).groupBy("layer", "bucket", "shape").agg(F.count("*").alias("n"))


@query(ctes(TICKETS_SQL, TAGS_SQL) + "SELECT s_suppkey AS project_id, coalesce(n, 0) AS tickets FROM supplier LEFT JOIN (SELECT project_name, count(*) AS n FROM tagged GROUP BY 1) ON project_name = 'P' || s_suppkey")
def feature_counts(spark, sf):
    counts = views.package_counts(project_tags(tickets(spark, sf)))
    return spatial.feature_layers(project_lines(spark, sf), counts, F.lit("all"), "packages").select("project_id", "tickets")


@query(ctes(PACKAGES_SQL) + " UNION ALL ".join(f"SELECT project_id, {i}::INT AS pos, '{n}' AS label, coalesce({c}::VARCHAR, '') AS value FROM packages" for i, (n, c) in enumerate(
    [("Project", "project_name"), ("Owner", "owner"), ("Department", "NULL"), ("Facility", "NULL"), ("Type", "NULL"), ("Status", "status"), ("Act Start", "act_start_date"), ("Act End", "act_end_date")], 1)))
def conflict_rows(spark, sf):
    return views.conflict_rows(packages(spark, sf))


# -- pages and texts -----------------------------------------------------------


@query("""SELECT page_id, page_id % 3 = 0 OR page_id % 5 = 1 AS is_cancelled, page_id % 3 = 0 AS by_words FROM pages""")
def page_cancel_signals(spark, sf):
    """Pages under a heading that cancels, one that only seems to (avoid), and one that doesn't; the pages' own words for it are taken out."""
    pages = table(spark, sf, "pages")
    k = F.col("page_id")
    head = F.when(k % 3 == 0, "<h2>Ticket CANCELLED</h2>").when(k % 5 == 1, "<td><b>to avoid</b> delay</td>").otherwise("<h1>Normal</h1><p>cancelled</p>")
    body = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?i)cance(?=l)|voi(?=d)", "")
    items = extract.page_items(pages.select("page_id", F.concat(head, body).alias("html")))
    loose, strict = extract.cancelled_page(), extract.cancelled_page(word_boundary=True)
    return items.select("page_id", loose.alias("is_cancelled"), strict.alias("by_words"))


_PAGE = """x AS (SELECT page_id, lpad(page_id::VARCHAR, 10, '0') AS number, page_id % 2 = 0 AS headed, page_id % 4 AS m FROM pages)"""


@query(ctes(_PAGE) + """SELECT page_id, number AS ticket_number, CASE WHEN headed THEN 'Davidson' ELSE 'Knox' END AS county, 'deep & wide' AS remarks, m = 3 AS is_cancelled,
  CASE m WHEN 0 THEN 'ABC,DEF' WHEN 1 THEN 'GFI,NES' ELSE 'MWS' END AS utility_codes, CASE WHEN m = 1 THEN 'pending,located' END AS states, CASE WHEN m = 1 THEN 2 END AS answers,
  CASE WHEN headed THEN 'County not this ' ELSE '' END || 'Ticket #: old Ticket Number: ' || number || ' County: ' || CASE WHEN headed THEN 'Davidson' ELSE 'Knox' END || ' Comments deep & wide ' || CASE m WHEN 0 THEN 'Code Name abc def ABC'
    WHEN 1 THEN 'Response Status Status Open gfi Name Fiber Closed NES Name Locate Delayed Located -  Facilities Marked now Fiber' WHEN 2 THEN 'MWS utility' ELSE 'MWS - notified Void' END AS raw_text FROM x""")
def page_layouts(spark, sf):
    """Every page number in a page of each layout: header or plain rows, code table, response table, codes in the text."""
    k = F.col("page_id")
    number = F.lpad(k.cast("string"), 10, "0")
    row = lambda tag, name, value: F.concat(F.lit(f"<tr><{tag}>{name}:</{tag}><td> "), value, F.lit(" </td></tr>"))
    rows = lambda tag, county: F.concat(F.lit("<table>"), row(tag, "Ticket #", F.lit("old")), row(tag, "Ticket Number", number), row(tag, "County", F.lit(county)), F.lit("</table>"))
    plain = F.lit("<table><tr><td>County</td><td>not this</td></tr></table>")
    layout = F.when(k % 2 == 0, F.concat(plain, rows("th", "Davidson"))).otherwise(rows("td", "Knox"))
    notes = F.lit("<dl><dt>Comments</dt><dd>deep &amp; wide</dd></dl>")
    codes = "<table><tr><th>Code</th><th>Name</th></tr><tr><td>abc</td></tr><tr><td>def</td></tr><tr><td>ABC</td></tr></table>"
    answer = lambda state, code, said: f"<tr><td>{state}</td><td>{code}</td><td>Name<ul>{said}</ul></td><td>Fiber</td></tr>"
    answers = (
        "<div class='x generalInformation'><h3>Response Status</h3><table><tr><th>Status</th></tr>" + answer("Open", "gfi", "")
        + answer("Closed", "NES", "<li><span>Locate Delayed</span></li><li><span>Located -  Facilities Marked</span><b>now</b></li>") + "</table></div>"
    )
    tail = F.when(k % 4 == 0, codes).when(k % 4 == 1, answers).when(k % 4 == 2, "<p>MWS utility</p>").otherwise("<p>MWS - notified</p><span>Void</span>")
    out = extract.page_details(table(spark, sf, "pages").select("page_id", F.concat(layout, notes, tail).alias("html")))
    states = F.array_join(F.transform("utility_statuses", lambda s: s["status"]), ",")
    answers = F.aggregate("utility_statuses", F.lit(0), lambda n, s: n + s["response_count"])
    return out.select("page_id", "ticket_number", "county", "remarks", "is_cancelled", F.array_join("utility_codes", ",").alias("utility_codes"), states.alias("states"), answers.alias("answers"), "raw_text")


@query()
def page_details(spark, sf):
    """Pages as notices: each gets a small ticket table of its own order in front, parsed with the rest of the page."""
    pages = table(spark, sf, "pages")
    head = F.concat(F.lit("<table><tr><th>Ticket Number:</th><td>"), F.col("page_id").cast("string"), F.lit("</td></tr><tr><th>Remarks</th><td>"), F.coalesce("url", F.lit("")), F.lit("</td></tr></table>"))
    out = extract.page_details(pages.select("page_id", F.concat(head, F.coalesce("html", F.lit(""))).alias("html")))
    return out.select("page_id", "ticket_number", "remarks", "is_cancelled", F.array_join("utility_codes", ",").alias("utility_codes"), F.char_length("raw_text").alias("chars"))


@query("""SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 10, '0') AS ticket_number, CASE WHEN o_orderkey % 3 = 0 THEN 'Davidson' ELSE 'hint' END AS county, strftime(o_orderdate, '%Y-%m-%d') AS call_date, o_orderpriority AS work_type,
  o_orderstatus = 'P' AS is_cancelled, NOT true AS positional FROM orders""")
def extract_fields(spark, sf):
    """Orders written as labelled texts and read back."""
    o = table(spark, sf, "orders")
    text = F.concat(
        F.lit("Ticket Number: "), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("\nCounty: Davidson  ")).otherwise(F.lit("")), F.lit("\nCall Date: "),
        F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit("\nType of Work: "), F.col("o_orderpriority"), F.when(F.col("o_orderstatus") == "P", F.lit("\nVOIDED")).otherwise(F.lit("\navoid")),
    )
    out = extract.extract_fields(o.select("o_orderkey", text.alias("text")), county_hint="hint")
    return out.select("o_orderkey", "ticket_number", "county", F.date_format("call_date", "yyyy-MM-dd").alias("call_date"), "work_type", "is_cancelled", "positional")


@query()
def document_fields(spark, sf):
    """Every document through the text extraction."""
    out = extract.extract_fields(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "ticket_number", "county", "work_type", "is_cancelled", F.size("utility_references").alias("mentions"))


@query("""SELECT o_orderkey, k % 3 <> 0 AS positional, CASE WHEN k % 3 = 0 THEN 'A-' || k WHEN k % 3 = 1 THEN 'TN-' || lpad(k::VARCHAR, 9, '0') END AS ticket_number, CASE WHEN k % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS expiration_date,
  CASE WHEN k % 2 = 0 THEN 'Acme Gas|Acme Gas' || chr(10) || 'utility|Metro Water Services' ELSE 'City Electric' END AS mentions, k % 5 = 0 AS is_cancelled FROM (SELECT *, o_orderkey AS k FROM orders)""")
def text_positions(spark, sf):
    """Orders as texts without labels, where number and expiry count by position, with named utilities (a run of words before a colon may span lines); and some with labels, where they don't."""
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "MM/dd/yyyy")
    plain = F.concat(F.lit("seen 01/02/1999 of tn-"), F.lpad(k.cast("string"), 9, "0"), F.lit(" until "), day)
    head = F.when(k % 3 == 0, F.concat(F.lit("Ticket Number: A-"), k.cast("string"), F.lit("\nCounty: Knox\nseen 01/02/1999 and 03/04/1999"))).when(k % 3 == 1, plain).otherwise("once 01/02/1999")
    named = F.when(k % 2 == 0, "\nUtility: Acme Gas\nutility:  ACME GAS \n(Metro Water Services: none)").otherwise("\nUtility: City Electric")
    out = extract.extract_fields(table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.concat(head, named, F.when(k % 5 == 0, "\nit is VOIDED").otherwise("\navoid")).alias("text")))
    return out.select("o_orderkey", "positional", "ticket_number", F.date_format("expiration_date", "yyyy-MM-dd").alias("expiration_date"), F.array_join("utility_references", "|").alias("mentions"), "is_cancelled")


# -- sources, policies, sinks ----------------------------------------------------


@query("""SELECT w::INT AS window, strftime(DATE '2001-08-01' - (w * 30 - 30)::INT, '%Y-%m-%d') AS end_date, strftime(greatest(DATE '2001-08-01' - (w * 30 - 1)::INT, DATE '2001-08-01' - 99), '%Y-%m-%d') AS start_date, n_name AS county
FROM range(1, 5) r(w), nation""")
def fetch_plan(spark, sf):
    counties = table(spark, sf, "nation").select(F.col("n_name").alias("county"))
    plan = readers.fetch_plan(readers.plan_windows(spark, today(), 100), counties)
    return plan.select("window", F.date_format("start_date", "yyyy-MM-dd").alias("start_date"), F.date_format("end_date", "yyyy-MM-dd").alias("end_date"), "county")


@query("SELECT lpad(o_orderkey::VARCHAR, 10, '0') AS ticket_number, 'K' AS county, strftime(o_orderdate, '%m/%d/%Y') AS call_date_raw, 'say \"hi\", ' || o_orderpriority AS remarks_raw FROM orders WHERE o_orderkey % 2 = 0")
def export_round_trip(spark, sf):
    """Orders written as an export and read by header name."""
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex[:12]}"
    o = table(spark, sf, "orders")
    rows = o.select(
        F.concat(F.lit('say "hi", '), F.col("o_orderpriority")).alias("Remarks"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("Number"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).alias("ticketId"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("Creation"),
    )
    writers.write_bundle({"export": rows}, path, single_file=False)
    return readers.read_export_csv(spark, f"{path}/export", "K").select("ticket_number", "county", "call_date_raw", "remarks_raw")


@query(ctes(TICKETS_SQL, TAGS_SQL) + """SELECT ticket_number, CASE WHEN project_name IS NULL THEN '' ELSE 'own:' || project_name || ':' || match_confidence END AS matches, done_for FROM tagged""")
def enrich_tickets(spark, sf):
    t = project_tags(tickets(spark, sf))
    matches = t.where("project_name IS NOT NULL").select("ticket_number", F.lit("own").alias("provider"), F.col("project_name").alias("project_id"), "match_confidence")
    said = F.transform("matches", lambda m: F.concat_ws(":", m["provider"], m["project_id"], m["match_confidence"]))
    return policy.enrich(t, matches).select("ticket_number", F.array_join(said, ",").alias("matches"), "done_for")


@query(ctes(TICKETS_SQL, TAGS_SQL) + """SELECT ticket_number, CASE WHEN project_name IS NULL THEN '' ELSE 'near:' || project_name END || CASE WHEN NOT is_cancelled AND county = 'NATION_3' THEN (CASE WHEN project_name IS NULL THEN '' ELSE ',' END) || 'own:C3' ELSE '' END AS matches FROM tagged""")
def provider_enrichers(spark, sf):
    """Two registered enrichers, attached side by side."""
    policy.register_enricher("near", lambda t, customer: t.where("project_name IS NOT NULL").select("ticket_number", F.col("project_name").alias("project_id")))
    policy.register_enricher("own", lambda t, customer: t.where(F.col("county") == customer).where("NOT is_cancelled").select("ticket_number", F.lit("C3").alias("project_id")))
    out = policy.enrich_all(project_tags(tickets(spark, sf)), "NATION_3")
    said = F.transform("matches", lambda m: F.concat(m["provider"], F.lit(":"), m["project_id"]))
    return out.select("ticket_number", F.array_join(F.array_sort(said), ",").alias("matches"))


@query(ctes(TICKETS_SQL, TAGS_SQL) + """SELECT ticket_number, 'county' AS name, county AS value, 'public' AS classification FROM tagged UNION ALL SELECT ticket_number, 'work_type', work_type, 'public' FROM tagged
UNION ALL SELECT ticket_number, 'project_id', project_name, 'customer_private' FROM tagged WHERE project_name IS NOT NULL""")
def classified_values(spark, sf):
    t = project_tags(tickets(spark, sf))
    matches = t.where("project_name IS NOT NULL").select("ticket_number", F.lit("own").alias("provider"), F.col("project_name").alias("project_id"))
    return policy.classified_values(policy.enrich(t, matches), ["county", "work_type"]).select("ticket_number", "name", "value", "classification")


@query(ctes(TICKETS_SQL) + "SELECT ticket_number, county, work_type, 'caller_name:restricted, done_for:customer_private, raw:restricted' AS blocked, caller_name FROM tickets")
def export_policy(spark, sf):
    """What may leave, what a policy names as blocked, and what a wider policy lets out."""
    t = tickets(spark, sf).select("ticket_number", "county", "work_type", "caller_name", "done_for", F.lit(1).alias("raw"))
    marked = policy.classify(t, {"ticket_number": "public", "county": "public", "work_type": "derived", "caller_name": "restricted", "done_for": "customer_private"})
    try:
        blocked = str(policy.apply_export_policy(marked).columns)
    except policy.BlockedColumns as e:
        blocked = str(e).partition(": ")[2]
    kept = policy.apply_export_policy(marked.drop("caller_name", "done_for", "raw"))
    wide = policy.apply_export_policy(marked.select("ticket_number", "caller_name"), allowed=("public", "restricted"))
    return kept.withColumn("blocked", F.lit(blocked)).join(wide, "ticket_number")


@query(ctes(TICKETS_SQL) + "SELECT ticket_number, reason FROM (SELECT ticket_number, CASE WHEN done_for IS NULL THEN 'missing_required_fields' WHEN expiration_date IS NULL THEN 'html_parse_error' END AS reason FROM tickets) WHERE reason IS NOT NULL")
def quarantined(spark, sf):
    checks = {"missing_required_fields": F.col("done_for").isNotNull(), "html_parse_error": F.col("expiration_date").isNotNull()}
    return policy.quarantine(tickets(spark, sf), checks, now())[1].select("ticket_number", "reason")


@query(ctes(TICKETS_SQL, HITS_SQL) + "SELECT 100 AS shown, count(*) AS count FROM scored WHERE is_relevant")
def json_document(spark, sf):
    """The count is that of all rows; the list is a top list."""
    rows = scored(spark, sf).where("is_relevant").select("ticket_number", "relevance_score")
    doc = writers.json_document(rows, now(), 100, [F.desc("relevance_score"), F.col("ticket_number")])
    return doc.select(F.size("rows").alias("shown"), "count")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 <> 0")
def not_yet_parsed(spark, sf):
    """Documents whose fingerprint is not among those parsed before."""
    from noticeflow.operators.cdc import not_yet_parsed as unparsed

    d = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"))
    return unparsed(d, d.where("doc_id % 6 = 0")).select("doc_id", "sha256")
