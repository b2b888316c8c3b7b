"""Queries on similarity, clusters, versions and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from noticeflow.functions.text import fallback_label, group_key, token_jaccard, tokens
from noticeflow.operators import cdc, cluster, filters, views
from noticeflow.plans.adapters import RULES, VERSIONS_SQL, now, table, tickets, versions
from noticeflow.plans.notices import HITS_SQL, TICKETS_SQL, scored
from noticeflow.plans.registry import ctes, query
from noticeflow.scratch import shared_dir
from noticeflow.streaming import streams


def _parts(spark, sf):
    """part rows as named parties: tokens of name, brand and type."""
    p = table(spark, sf, "part")
    return p.withColumn("words", tokens(F.concat_ws(" ", F.col("p_name"), F.lit("the"), F.col("p_type"), F.lower("p_brand"))))


_WORDS = "list_distinct(list_filter(regexp_extract_all(lower(p_name || ' the ' || p_type || ' ' || p_brand), '[a-z0-9]+'), lambda w: w NOT IN ('the', 'and', 'or', 'of', 'in', 'at', 'to', 'a', 'an', 'for', 'tn')))"
SETS_SQL = f"sets AS (SELECT min(p_partkey) AS o, s FROM (SELECT p_partkey, list_sort({_WORDS}) AS s FROM part) GROUP BY s)"


@query(f"WITH w AS (SELECT p_partkey, {_WORDS} AS s FROM part) SELECT p_partkey, len(s)::INT AS n, list_aggregate(list_sort(s), 'string_agg', ' ') AS words FROM w")
def party_tokens(spark, sf):
    return _parts(spark, sf).select("p_partkey", F.size("words").alias("n"), F.array_join(F.array_sort("words"), " ").alias("words"))


@query(ctes(SETS_SQL) + """SELECT x.o AS a, y.o AS b, round(len(list_intersect(x.s, y.s))::DOUBLE / len(list_distinct(x.s || y.s)), 6) AS jaccard
FROM sets x JOIN sets y ON x.o < y.o WHERE len(list_intersect(x.s, y.s))::DOUBLE / len(list_distinct(x.s || y.s)) >= 0.6""")
def jaccard_pairs(spark, sf):
    """Pairs of distinct token sets; equal sets are one, named by its smallest part."""
    sets = _parts(spark, sf).groupBy(F.array_sort("words").alias("s")).agg(F.min("p_partkey").alias("o"))
    return cluster.jaccard_pairs(sets, "o", "s", 0.6).withColumn("jaccard", F.round("jaccard", 6))


def leaders_sql(sets: str) -> str:
    """CTEs: the sequential loop over `sets` (o, s), a step a leader, and (o, leader) of every set."""
    alike = "(len(s) + len(ls) = 0 OR len(list_intersect(s, ls))::DOUBLE / nullif(len(s) + len(ls) - len(list_intersect(s, ls)), 0) >= 0.6)"
    return f"""steps AS (
  SELECT 0 AS step, o, s, min(o) OVER () AS leader, arg_min(s, o) OVER () AS ls FROM {sets}
  UNION ALL SELECT step + 1, o, s, min(o) OVER (), arg_min(s, o) OVER () FROM steps WHERE NOT {alike}
), led AS (SELECT o, arg_max(s, step) AS s, arg_max(leader, step) AS leader FROM steps GROUP BY o)"""


_LED = "WITH RECURSIVE " + SETS_SQL + ", " + leaders_sql("sets") + f", parts AS (SELECT *, list_sort({_WORDS}) AS s FROM part), clustered AS (SELECT parts.*, leader FROM parts JOIN led USING (s))"


@query(_LED + " SELECT p_partkey, leader FROM clustered")
def leader_cluster(spark, sf):
    """Leaders of the parties, row by row in the SQL."""
    return cluster.leader_cluster(_parts(spark, sf), "p_partkey", "words", 0.6).select("p_partkey", "leader")


_STOP = "('the', 'and', 'or', 'of', 'in', 'at', 'to', 'a', 'an', 'for', 'tn')"
_GROUPS = f"""own AS (
  SELECT ticket_number, upper(excavator_name) AS company, list_sort(list_distinct(list_filter(regexp_extract_all(lower(excavator_name || ' ' || work_type), '[a-z0-9]+'), lambda w: w NOT IN {_STOP}))) AS s
  FROM scored WHERE is_relevant AND status = 'active'
), sets AS (SELECT min(ticket_number) AS o, s FROM own GROUP BY s), {leaders_sql("sets")}, clustered AS (SELECT own.*, leader FROM own JOIN led USING (s)),
labels AS (SELECT leader, company AS label FROM (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY n DESC, company) AS r FROM (SELECT leader, company, count(*) AS n FROM clustered GROUP BY ALL)) WHERE r = 1)"""


@query(ctes(TICKETS_SQL, HITS_SQL, _GROUPS).replace("WITH", "WITH RECURSIVE", 1) + "SELECT ticket_number, leader, company AS probable_company, label AS probable_work_group FROM clustered JOIN labels USING (leader)")
def work_groups(spark, sf):
    """Active relevant notices in groups of like parties."""
    t = scored(spark, sf).where(filters.active_relevant()).withColumns({c: F.lit(None).cast("string") for c in ("probable_company", "probable_work_group", "location_text")})
    return cluster.work_groups(t).select("ticket_number", "leader", "probable_company", "probable_work_group")


_CALLED = "DATE '2001-01-01' + (p_partkey % 300)::INT"


@query(_LED + f""", labels AS (SELECT leader, c AS label FROM (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY n DESC, c) AS r FROM (SELECT leader, upper(p_name) AS c, count(*) AS n FROM clustered GROUP BY ALL)) WHERE r = 1)
SELECT leader, left(sha256(arg_min(upper(p_name || '|' || p_type || '|' || p_brand), p_partkey)), 16) AS group_key, count(*) AS tickets, strftime(min({_CALLED}), '%Y-%m-%d') AS first_seen,
  strftime(max({_CALLED}), '%Y-%m-%d') AS last_seen, min(p_partkey) AS representative, any_value(label) AS label FROM clustered JOIN labels USING (leader) GROUP BY leader""")
def cluster_summary(spark, sf):
    p = _parts(spark, sf).withColumns({"probable_company": F.upper("p_name"), "call_date": F.date_add(F.lit("2001-01-01").cast("date"), (F.col("p_partkey") % 300).cast("int"))})
    led = cluster.leader_cluster(p, "p_partkey", "words", 0.6)
    out = cluster.cluster_summary(led, group_key(F.col("probable_company"), F.col("p_type"), F.col("p_brand")), "p_partkey")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_seen", "last_seen")})


@query("""SELECT p_brand AS slug, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, f) AS r FROM (SELECT p_brand, p_name, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY ALL)) WHERE r = 1""")
def canonical_name(spark, sf):
    return views.most_frequent(table(spark, sf, "part"), "p_brand", "p_name", "p_partkey").withColumnRenamed("p_brand", "slug")


@query("""SELECT p_brand AS leader, coalesce(c, 'Unknown') AS label FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY c IS NULL, n DESC, c) AS r FROM (SELECT p_brand, CASE WHEN p_size > 25 THEN p_type END AS c, count(*) AS n FROM part GROUP BY ALL)) WHERE r = 1""")
def cluster_label(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("leader"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("probable_company"))
    return cluster.cluster_label(p)


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN p_name ELSE 'Unassigned' END AS label FROM part")
def fallback_labels(spark, sf):
    m = F.col("p_size") % 3
    return table(spark, sf, "part").select("p_partkey", fallback_label(F.when(m == 0, F.col("p_brand")).otherwise(""), F.when(m == 1, F.col("p_name"))).alias("label"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS a, [lower(p_type), split_part(p_name, ' ', 1)] AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)), 6) AS jaccard FROM w""")
def token_similarity(spark, sf):
    p = table(spark, sf, "part")
    a = F.split("p_name", " ")
    return p.select("p_partkey", F.round(token_jaccard(F.array_distinct(a), F.array_distinct(F.array(F.lower("p_type"), a[0]))), 6).alias("jaccard"))


@query(ctes(VERSIONS_SQL) + "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(content_hash, event_id) AS content_hash, arg_max(payload, event_id) AS payload FROM versions GROUP BY 1")
def latest_version(spark, sf):
    return cdc.latest_version(versions(spark, sf), "user_id", ["event_id"])


_HISTORY = ctes(VERSIONS_SQL) + """, b AS (SELECT *, lag(content_hash) OVER (PARTITION BY user_id ORDER BY event_id) AS changed_from FROM versions),
h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM b WHERE changed_from IS NULL OR changed_from <> content_hash)
"""


@query(_HISTORY + "SELECT user_id, event_id, payload, content_hash, changed_from, version::INT AS version FROM h")
def version_history(spark, sf):
    return cdc.version_history(versions(spark, sf), "user_id", ["event_id"])


@query(_HISTORY + """, v AS (SELECT user_id FROM h GROUP BY 1 HAVING count(*) > 1)
SELECT c_custkey AS user_id FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT user_id FROM v) ORDER BY c_acctbal DESC, c_custkey LIMIT 50""")
def recent_changes(spark, sf):
    """A top list: the limit is its feature."""
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("is_relevant"), F.col("c_acctbal").alias("updated_at"))
    return cdc.recent_changes(people, cdc.version_history(versions(spark, sf), "user_id", ["event_id"]), "user_id").select("user_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def merge_windows(spark, sf):
    """Overlapping fetch windows: the row fetched last stays."""
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return cdc.merge_windows(e.where("event_id % 3 < 2").unionByName(e.where("event_id % 3 > 0")), "user_id", ["event_id"])


# -- streams -------------------------------------------------------------------


def _stream(spark, sf, name):
    """A table as a stream: its files are what arrives."""
    kind = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(kind).parquet(f"{sf}/{name}*.parquet")


def _drained(frame, out, mode="append"):
    """Run a stream until its input is used up, and read what it wrote."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{out}-{uuid.uuid4().hex[:12]}"
    frame.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{path}/rows")


@query(ctes(TICKETS_SQL, HITS_SQL) + "SELECT ticket_number, relevance_score, is_relevant FROM scored")
def stream_score(spark, sf):
    """Orders arrive as a stream and are scored on the way; customers and nations are tables."""
    rows = tickets(spark, sf, orders=_stream(spark, sf, "orders"))
    return _drained(streams.stream_score(rows, RULES).select("ticket_number", "relevance_score", "is_relevant"), "stream-score")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe_reminders(spark, sf):
    return _drained(streams.stream_dedupe_reminders(_stream(spark, sf, "events").select("user_id", "event_type"), ["user_id", "event_type"]), "stream-dedupe")


@query(_HISTORY + "SELECT user_id, content_hash, CASE WHEN version = 1 THEN 'new' ELSE 'changed' END AS change FROM h")
def stream_changes(spark, sf):
    said = F.concat_ws("|", "event_type", F.floor(F.col("value") / 20).cast("int").cast("string"))
    rows = _stream(spark, sf, "events").select("user_id", "event_id", F.md5(said.cast("binary")).alias("content_hash"))
    provider = "spark.sql.streaming.stateStore.providerClass"  # value state needs this store; the session's own setting comes back
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return _drained(streams.stream_changes(rows, "user_id", "content_hash", "event_id"), "stream-changes")
    finally:
        spark.conf.set(provider, before)


@query("""SELECT o_custkey, max(o_orderkey) AS o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'new' WHEN o_custkey % 3 = 1 THEN 'unchanged' ELSE 'changed' END AS change FROM orders GROUP BY 1
UNION ALL SELECT o_custkey, max(o_orderkey), 'unchanged' FROM orders GROUP BY 1""")
def stream_upsert(spark, sf):
    """Every customer's last order, captured batch by batch against what is stored.

    Two thirds of the customers are stored before, half of these with another
    state; the table then comes once more, when all are stored.
    """
    root = f"{shared_dir(spark)}/stream-upsert-{uuid.uuid4().hex[:12]}"
    kind = "o_custkey long, latest_content_hash string"
    saved = "o_custkey long, o_orderkey long, change string"
    columns = ["o_custkey", "o_orderkey", "o_orderstatus"]
    o = table(spark, sf, "orders").select(*columns)
    last = cdc.latest_version(o, "o_custkey", ["o_orderkey"]).where("o_custkey % 3 > 0").withColumn("o_orderstatus", F.when(F.col("o_custkey") % 3 == 2, "?").otherwise(F.col("o_orderstatus")))
    last.select("o_custkey", cdc.content_hash(last.select(*columns)).alias("latest_content_hash"), F.lit(-1).cast("long").alias("batch")).write.parquet(f"{root}/state/start")

    def load():
        """The hash stored last of each customer."""
        rows = spark.read.schema(f"{kind}, batch long").option("recursiveFileLookup", True).parquet(f"{root}/state")
        return rows.groupBy("o_custkey").agg(F.max_by("latest_content_hash", "batch").alias("latest_content_hash"))

    def save(changes, batch_id):
        done = changes.select("o_custkey", "o_orderkey", "change", F.col("content_hash").alias("latest_content_hash"), F.lit(batch_id).cast("long").alias("batch"))
        done.write.mode("overwrite").parquet(f"{root}/out/turn={turn}/batch={batch_id}")
        spark.read.parquet(f"{root}/out/turn={turn}/batch={batch_id}").select("o_custkey", "latest_content_hash", (F.col("batch") + turn * 1_000_000).alias("batch")).write.mode("overwrite").parquet(f"{root}/state/{turn}-{batch_id}")

    for turn in (0, 1):
        rows = _stream(spark, sf, "orders").select(*columns)
        streams.stream_upsert(rows, load, save, "o_custkey", now(), f"{root}/checkpoint-{turn}", ["o_orderkey"]).awaitTermination()
    return spark.read.schema(saved).option("recursiveFileLookup", True).parquet(f"{root}/out").select("o_custkey", "o_orderkey", "change")
