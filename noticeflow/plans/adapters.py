"""The driver's tables seen as notices, utilities, versions, features and points; the same views in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.operators.score import Rule, Ruleset

TODAY, NOW = "2001-08-01", "2001-08-01 12:00:00"

RULES = Ruleset(
    rules=[
        Rule("northstar_fiber", "northstar fiber", 1.0),
        Rule("drop_bury", "drop bury", 0.65),
        Rule("fiber_install", r"fiber\s+install", 0.75, kind="regex"),
        Rule("ftth", "ftth", 0.85, field="remarks"),
        Rule("fiber", "fiber", 0.3),
        Rule("meridian", "Meridian Cable", 0.6, field="done_for", kind="exact", case_sensitive=True),
        Rule("urgent", "urgent", 0.2, field="work_type"),
        Rule("water", "water main", 0.5, field="remarks", negative=True),
        Rule("low", "^5-low$", 0.1, field="work_type", kind="regex", negative=True),
    ],
    threshold=0.45,
    contractors=["machinery", "building"],
    work_keywords=["conduit", "specified"],
    include=["0000000007", "0000000077"],
    exclude=["0000000005", "0000000010"],
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def today() -> Column:
    return F.lit(TODAY).cast("date")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def tickets(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """orders (a table, or a stream of them) with customer and nation as notices."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    o = o if orders is None else orders
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    k = F.col("o_orderkey")
    call = F.col("o_orderdate").cast("date")
    tenth = lambda e: e.cast("double") / 10000
    lat = F.when(k % 13 != 0, F.lit(36.0) + tenth(k % 2000))
    lon = F.when(k % 13 != 0, F.lit(-86.9) + tenth((k * 7) % 3000))
    return joined.select(
        k.alias("k"), F.lpad(k.cast("string"), 10, "0").alias("ticket_number"), F.col("n_name").alias("county"), F.col("c_mktsegment").alias("excavator_name"),
        F.col("c_name").alias("caller_name"), F.col("o_orderpriority").alias("work_type"), call.alias("call_date"), F.date_add(call, 3).alias("legal_start_date"),
        F.when(k % 17 != 0, F.date_add(call, (k % 20 + 15).cast("int"))).alias("expiration_date"), (F.col("o_orderstatus") == "P").alias("is_cancelled"),
        F.when(F.col("o_custkey") % 7 == 0, F.concat(F.lit("NORTHSTAR FIBER "), (k % 100).cast("string"))).when(F.col("o_custkey") % 7 == 1, "Meridian Cable")
        .when(F.col("o_custkey") % 7 == 2, "CITY WATER").when(F.col("o_custkey") % 7 == 3, None).otherwise("self").alias("done_for"),
        F.when(k % 5 == 0, "drop bury fiber  install").when(k % 5 == 1, "FTTH conduit").when(k % 5 == 2, "water main").otherwise("").alias("remarks"),
        lat.alias("latitude"), lon.alias("longitude"),
        F.when(k % 3 == 0, lat + 0.001).alias("secondary_latitude"), F.when(k % 3 == 0, lon + tenth(k % 7)).alias("secondary_longitude"),
    )


TICKETS_SQL = """
tickets AS (
  SELECT k, lpad(k::VARCHAR, 10, '0') AS ticket_number, n_name AS county, c_mktsegment AS excavator_name, c_name AS caller_name, o_orderpriority AS work_type,
    call_date, call_date + 3 AS legal_start_date, CASE WHEN k % 17 <> 0 THEN call_date + (k % 20 + 15)::INT END AS expiration_date, o_orderstatus = 'P' AS is_cancelled,
    CASE o_custkey % 7 WHEN 0 THEN 'NORTHSTAR FIBER ' || (k % 100) WHEN 1 THEN 'Meridian Cable' WHEN 2 THEN 'CITY WATER' WHEN 3 THEN NULL ELSE 'self' END AS done_for,
    CASE k % 5 WHEN 0 THEN 'drop bury fiber  install' WHEN 1 THEN 'FTTH conduit' WHEN 2 THEN 'water main' ELSE '' END AS remarks,
    lat AS latitude, lon AS longitude, CASE WHEN k % 3 = 0 THEN lat + 0.001::DOUBLE END AS secondary_latitude,
    CASE WHEN k % 3 = 0 THEN lon + (k % 7)::DOUBLE / 10000 END AS secondary_longitude
  FROM (SELECT *, o_orderkey AS k, o_orderdate::DATE AS call_date, CASE WHEN o_orderkey % 13 <> 0 THEN 36.0::DOUBLE + (o_orderkey % 2000)::DOUBLE / 10000 END AS lat,
          CASE WHEN o_orderkey % 13 <> 0 THEN (-86.9)::DOUBLE + ((o_orderkey * 7) % 3000)::DOUBLE / 10000 END AS lon FROM orders)
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


def utility_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as utility responses, in long form."""
    li = table(spark, sf_dir, "lineitem")
    open_ = F.col("l_linestatus") == "O"
    said = (
        F.when(F.col("l_returnflag") == "A", "Clear - No Conflict").when(F.col("l_returnflag") == "N", F.when(F.col("l_partkey") % 3 == 0, "Locate  Delayed").otherwise("No Response"))
        .when(~open_, F.when(F.col("l_partkey") % 2 == 0, "In Conflict").otherwise("Located - Facilities Marked"))
    )
    return li.select(
        F.col("l_orderkey").alias("k"), "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("code"),
        F.when(open_, "Open").otherwise("Closed").alias("row_status"), said.alias("last_response"),
    )


def with_utilities(t: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices with their utility_statuses in the order of (line, supplier, part, quantity)."""
    from noticeflow.functions.status import utility_status

    rows = utility_rows(spark, sf_dir).withColumn("status", utility_status(F.col("row_status"), F.col("last_response")))
    item = F.struct(
        "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "code", F.lit("").alias("name"), F.lit("").alias("facility"), "row_status", "last_response",
        F.lit(None).cast("string").alias("response_timestamp"), "status",
    )
    lists = rows.groupBy("k").agg(F.array_sort(F.collect_list(item)).alias("utility_statuses"))
    return t.join(lists, "k", "left")


UTILITIES_SQL = """
utilities AS (
  SELECT *, CASE
      WHEN row_status = 'Open' AND last_response IS NULL THEN 'pending'
      WHEN row_status = 'Open' AND said = 'locate delayed' THEN 'delayed'
      WHEN row_status = 'Open' AND said = 'clear - no conflict' THEN 'clear'
      WHEN row_status = 'Closed' AND said = 'clear - no conflict' THEN 'clear'
      WHEN row_status = 'Closed' AND said = 'located - facilities marked' THEN 'located'
      WHEN row_status = 'Closed' AND said = 'locate delayed' THEN 'delayed'
      WHEN row_status = 'Closed' AND said IN ('in conflict', 'no response') THEN 'not_clear' ELSE 'unknown' END AS status
  FROM (SELECT *, lower(regexp_replace(last_response, '\\s+', ' ', 'g')) AS said FROM (
    SELECT l_orderkey AS k, l_linenumber, l_suppkey, l_partkey, l_quantity, 'S' || l_suppkey AS code, CASE l_linestatus WHEN 'O' THEN 'Open' ELSE 'Closed' END AS row_status,
      CASE WHEN l_returnflag = 'A' THEN 'Clear - No Conflict' WHEN l_returnflag = 'N' THEN CASE WHEN l_partkey % 3 = 0 THEN 'Locate  Delayed' ELSE 'No Response' END
           WHEN l_linestatus <> 'O' THEN CASE WHEN l_partkey % 2 = 0 THEN 'In Conflict' ELSE 'Located - Facilities Marked' END END AS last_response
    FROM lineitem))
),
marked AS (
  SELECT u.*, (u.status = 'pending' AND TIMESTAMP '2001-08-01 12:00:00' > t.call_date::TIMESTAMP + INTERVAL 72 HOURS AND NOT t.is_cancelled) AS is_late
  FROM utilities u JOIN tickets t USING (k)
),
rolled AS (
  SELECT k, bool_or(is_late) AS has_late_utility, bool_and(status IN ('clear', 'located')) AS is_ready_to_dig,
    count(*) FILTER (status IN ('delayed', 'not_clear')) AS blocking, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (is_late) AS late
  FROM marked GROUP BY k
)"""


def project_tags(t: DataFrame) -> DataFrame:
    """A project name and a match confidence by key, for operators that need tagged notices."""
    k = F.col("k")
    tier = F.when(k % 4 == 0, "high").when(k % 4 == 1, "medium").when(k % 4 == 2, "low").otherwise("none")
    return t.withColumns({"project_name": F.when(k % 4 != 3, F.concat(F.lit("P"), (k % 120).cast("string"))), "match_confidence": tier, "match_distance_m": (k % 400).cast("double") / 2})


TAGS_SQL = """
tagged AS (
  SELECT *, CASE WHEN k % 4 <> 3 THEN 'P' || (k % 120) END AS project_name, CASE k % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'none' END AS match_confidence,
    (k % 400)::DOUBLE / 2 AS match_distance_m FROM tickets
)"""


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier as projects."""
    k = F.col("s_suppkey")
    day = lambda n: F.date_add(today(), n.cast("int"))
    return table(spark, sf_dir, "supplier").select(
        k.alias("project_id"), F.concat(F.lit("P"), k.cast("string")).alias("project_name"), F.col("s_nationkey").cast("string").alias("owner"),
        F.when(k % 4 == 0, "Started").when(k % 4 == 1, "COMMITTED").when(k % 4 == 2, None).otherwise("Planned").alias("status"),
        day(k % 50 - 40).alias("est_start_date"), F.when(k % 6 != 0, day(k % 90 - 20)).alias("est_end_date"), day(k % 30 - 40).alias("act_start_date"),
        F.when(k % 5 == 0, day(k % 60 - 45)).alias("act_end_date"), F.col("s_acctbal").alias("budget"),
    )


PACKAGES_SQL = """
packages AS (
  SELECT s_suppkey AS project_id, 'P' || s_suppkey AS project_name, s_nationkey::VARCHAR AS owner,
    CASE s_suppkey % 4 WHEN 0 THEN 'Started' WHEN 1 THEN 'COMMITTED' WHEN 2 THEN NULL ELSE 'Planned' END AS status,
    DATE '2001-08-01' + (s_suppkey % 50 - 40)::INT AS est_start_date, CASE WHEN s_suppkey % 6 <> 0 THEN DATE '2001-08-01' + (s_suppkey % 90 - 20)::INT END AS est_end_date,
    DATE '2001-08-01' + (s_suppkey % 30 - 40)::INT AS act_start_date, CASE WHEN s_suppkey % 5 = 0 THEN DATE '2001-08-01' + (s_suppkey % 60 - 45)::INT END AS act_end_date, s_acctbal AS budget
  FROM supplier
)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as versions of users: a content hash of what an event says."""
    e = table(spark, sf_dir, "events")
    said = F.concat_ws("|", "event_type", F.floor(F.col("value") / 20).cast("int").cast("string"))
    return e.select("user_id", "event_id", said.alias("payload"), F.md5(said.cast("binary")).alias("content_hash"))


VERSIONS_SQL = """
versions AS (
  SELECT user_id, event_id, event_type || '|' || floor(value / 20)::INT AS payload, md5(event_type || '|' || floor(value / 20)::INT) AS content_hash FROM events
)"""
