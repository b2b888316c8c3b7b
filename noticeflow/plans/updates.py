"""Queries on tables in versions, ordered changes, audits of runs that fail, and rollups kept up to date."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from noticeflow.operators import cdc, rule_index
from noticeflow.plans.adapters import RULES, TICKETS_SQL, now, table, tickets
from noticeflow.plans.clusters import _HISTORY, _stream
from noticeflow.plans.notices import _CHANGES, HITS_SQL, _incoming
from noticeflow.plans.records import folder
from noticeflow.plans.registry import ctes, query
from noticeflow.sources import writers
from noticeflow.sources.versions import VersionedTable
from noticeflow.streaming import streams

#: What an upsert adds to the columns of a row.
KEPT = "latest_content_hash string, created_at timestamp, updated_at timestamp"


def _earlier():
    return now() - F.expr("INTERVAL 1 DAY")


@query(ctes(TICKETS_SQL) + "SELECT ticket_number, done_for, k % 7 = 0 OR k % 11 = 0 AS touched FROM tickets")
def versioned_upsert(spark, sf):
    """Stored notices as the first version, all others in two batches, of which one comes again."""
    incoming, stored = _incoming(spark, sf)
    kind = f"ticket_number string, k long, county string, work_type string, done_for string, {KEPT}"
    current = VersionedTable(spark, folder(spark, "current"), "ticket_number", kind, buckets=8)
    current.upsert(stored, _earlier())
    for half in (0, 1, 0):
        current.upsert(incoming.where(F.col("k") % 2 == half), now(), "nightly", half)
    return current.read().select("ticket_number", "done_for", (F.col("updated_at") == now()).alias("touched"))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, false AS later FROM orders GROUP BY 1")
def stream_versions(spark, sf):
    """Every customer's last order as a stream into a versioned table, twice: the second time nothing changes."""
    kind = f"o_custkey long, o_orderkey long, o_orderstatus string, {KEPT}"
    root = folder(spark, "stream-versions")
    current = VersionedTable(spark, f"{root}/table", "o_custkey", kind, buckets=8)
    for turn, at in enumerate((_earlier(), now())):
        rows = _stream(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
        streams.stream_into(rows, current, at, ["o_orderkey"], f"{root}/checkpoint-{turn}", f"turn-{turn}").awaitTermination()
    return current.read().select("o_custkey", "o_orderkey", "o_orderstatus", (F.col("updated_at") == now()).alias("later"))


@query(_HISTORY + "SELECT user_id, event_id, content_hash, CASE WHEN version = 1 THEN 'new' ELSE 'changed' END AS change FROM h")
def stream_ordered_changes(spark, sf):
    """Changes of every user in the order of events, against the last state of each in a versioned table."""
    said = F.concat_ws("|", "event_type", F.floor(F.col("value") / 20).cast("int").cast("string"))
    rows = _stream(spark, sf, "events").select("user_id", "event_id", F.md5(said.cast("binary")).alias("said"))
    root = folder(spark, "ordered-changes")
    state = VersionedTable(spark, f"{root}/state", "user_id", f"user_id long, event_id long, said string, {KEPT}", buckets=8)
    streams.stream_ordered_changes(rows, state, f"{root}/out", "said", "event_id", now(), f"{root}/checkpoint", "changes").awaitTermination()
    kind = "user_id long, event_id long, content_hash string, change string"
    return spark.read.schema(kind).option("recursiveFileLookup", True).parquet(f"{root}/out")


@query(ctes(TICKETS_SQL) + f"""SELECT 'failed' AS status, count(*) AS found, count(*) FILTER (change = 'new') AS new, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'unchanged') AS unchanged,
  'ValueError: no such county' AS error FROM ({_CHANGES}) WHERE k % 3 < 2""")
def failed_run(spark, sf):
    """A run over three slices that dies in the last: its audit has the counters of the two before it, and the error."""
    incoming, stored = _incoming(spark, sf)
    stored = stored.withColumn("latest_content_hash", cdc.content_hash(stored))
    path, at = folder(spark, "audits"), datetime.datetime(2001, 8, 1, 12)
    try:
        with writers.AuditedRun(spark, path, "nightly", lambda: at) as run:
            for part in range(3):
                if part == 2:
                    raise ValueError("no such county")
                changes, watch = writers.observed(cdc.capture_changes(incoming.where(F.col("k") % 3 == part), stored, "ticket_number", now()), f"slice-{uuid.uuid4().hex[:8]}")
                changes.select("k", "change").write.parquet(folder(spark, "slice"))
                run.add(watch)
    except ValueError:
        pass  # what the audit is about
    return writers.last_audits(spark.read.schema(writers.AUDIT).parquet(path)).select("status", "found", "new", "changed", "unchanged", "error")


@query(ctes(TICKETS_SQL) + "SELECT county, done_for, count(*) AS rows, count(*) FILTER (k % 3 = 0) AS third FROM tickets GROUP BY ALL")
def maintained_rollup(spark, sf):
    """Counts by county and party, brought up to date from the changed rows alone."""
    incoming, stored = _incoming(spark, sf)
    by, measures = ["county", "done_for"], {"third": F.col("k") % 3 == 0}
    sums = cdc.group_sums(stored, by, measures)
    hashed = stored.withColumn("latest_content_hash", cdc.content_hash(stored))
    changes = cdc.capture_changes(incoming, hashed, "ticket_number", now())
    return cdc.maintained(sums, *cdc.replaced_rows(changes, stored, "ticket_number"), by, measures)


@query(ctes(TICKETS_SQL) + """SELECT county, done_for FROM (SELECT *, row_number() OVER (PARTITION BY county ORDER BY n DESC, done_for NULLS FIRST) AS r
  FROM (SELECT county, done_for, count(*) AS n FROM tickets GROUP BY ALL)) WHERE r = 1""")
def maintained_names(spark, sf):
    """Each county's most frequent party, from the maintained counts."""
    place = F.row_number().over(cdc.Window.partitionBy("county").orderBy(F.desc("rows"), F.col("done_for").asc_nulls_first()))
    return maintained_rollup(spark, sf).withColumn("r", place).where("r = 1").select("county", "done_for")


@query("SELECT user_id, event_type FROM events GROUP BY ALL")
def stream_reminders_in_time(spark, sf):
    """Reminders once a key with a bounded state: a watermark so long that no event of the table is late."""
    rows = _stream(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    root = folder(spark, "reminders")
    once = streams.stream_dedupe_reminders(rows, ["user_id", "event_type"], ("ts", "3650 days")).select("user_id", "event_type")
    once.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/rows").awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{root}/rows")


@query(ctes(TICKETS_SQL, HITS_SQL) + "SELECT ticket_number, relevance_score, is_relevant FROM scored")
def score_indexed(spark, sf):
    """The rules found by the index of their anchors: the same scores."""
    return rule_index.score_many(tickets(spark, sf), RULES).select("ticket_number", "relevance_score", "is_relevant")


@query(ctes(TICKETS_SQL) + "SELECT ticket_number, c_name AS rule_id, -0.25::DOUBLE AS weight FROM tickets JOIN customer ON c_name = caller_name WHERE c_acctbal < 0")
def rules_of_debtors(spark, sf):
    """A rule for every customer in debt, a list that grows with the tables."""
    name = F.col("c_name")
    rules = table(spark, sf, "customer").where("c_acctbal < 0").select(name.alias("id"), name.alias("pattern"), F.lit(0.25).alias("weight"), F.lit("caller_name").alias("field"), F.lit(True).alias("negative"))
    return rule_index.explain_table(tickets(spark, sf), rules)
