import os
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from noticeflow.functions import text
from noticeflow.operators import views
from noticeflow.sources import readers, writers

SF = "/root/testdata/sf0.001"


def test_export_csv(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text(' ticketId,Number ,Creation,GoodUntil,TicketType,Remarks\n1,tn5,03/24/2026,04/08/2026,Normal,"a ""b"", c"\n2,,x,y,z,w\n,tn7,a,b,c,d\n4,tn8,,,,\n')
    rows = readers.read_export_csv(spark, str(path), "Davidson").orderBy("ticket_number").collect()
    assert [(r["ticket_number"], r["county"], r["remarks_raw"]) for r in rows] == [("TN5", "Davidson", 'a "b", c'), ("TN8", "Davidson", None)]
    path.write_text("ticketId,Number\n")
    assert readers.read_export_csv(spark, str(path), "x").count() == 0


def test_features(spark, tmp_path):
    path = tmp_path / "f.json"
    path.write_text('{"features":[{"geometry":{"type":"LineString","coordinates":[[1,2],[3,4]]},"properties":{"ProjectID":5,"ProjectName":" A ","Owner":"North","EstEndDate":1712534400000,"Status":""}},{"geometry":null,"properties":{"ProjectID":6,"Owner":null}}]}')
    rows = readers.read_features(spark, str(path)).orderBy("project_id").collect()
    assert (rows[0]["project_name"], str(rows[0]["est_end_date"]), rows[0]["status"]) == ("A", "2024-04-08", None)
    assert readers.read_features(spark, str(path), "NORTH%").count() == 1 and readers.read_features(spark, str(path), "NORTH%", negate=True).count() == 1


def test_windows(spark):
    rows = readers.plan_windows(spark, F.lit("2026-04-24").cast("date"), 45).orderBy("window").collect()
    assert [(str(r["start_date"]), str(r["end_date"])) for r in rows] == [("2026-03-26", "2026-04-24"), ("2026-03-11", "2026-03-25")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], "slug string, slice string, v int")
    writers.write_bundle({"one": df, "none": df.where("false")}, str(tmp_path / "b"))
    assert spark.read.option("header", True).csv(str(tmp_path / "b" / "none")).columns == ["slug", "slice", "v"]
    writers.write_slices(df, str(tmp_path / "s"))
    assert os.path.isdir(tmp_path / "s" / "slug=a" / "slice=x")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "slug string")
    writers.write_slices(df, str(tmp_path / "t"), keys=keys.where("slug <> 'a'"), always="x")
    bare = spark.read.option("header", True).csv(str(tmp_path / "t" / "slug=c" / "slice=x"))
    assert bare.columns == ["v"] and bare.count() == 0 and spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 2
    assert {(r["slug"], r["slice"], r["rows"]) for r in writers.slice_counts(df, keys, always="x").collect()} == {("a", "x", 1), ("b", "x", 1), ("c", "x", 0)}
    assert [r["rows"] for r in writers.manifest({"one": df, "none": df.where("false")}).orderBy("pos").collect()] == [2, 0]
    doc = writers.json_document(df, F.lit("2026-04-24").cast("timestamp"), 1, [F.col("v").desc()]).first()
    assert doc["count"] == 2 and len(doc["rows"]) == 1 and doc["rows"][0]["v"] == 2
    seen, watch = writers.observed(df.withColumn("change", F.lit("new")))
    writers.append(seen, str(tmp_path / "log"))
    assert watch.get["new"] == 2
    assert writers.written_sizes(spark, str(tmp_path / "b")).count() >= 1


@pytest.mark.parametrize("name", ["contractor_rollup", "kpi_summary", "stream_dedupe_reminders", "stream_upsert", "page_details", "fetch_plan", "map_layers"])
def test_queries_run(spark, name):
    import __spark_entry__

    assert __spark_entry__.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["score_rules", "packages_view", "utility_summary", "sync_owner_scoped", "by_work_group", "version_history", "nearest_line"])
def test_queries_match_sql(spark, name):
    import duckdb

    import __spark_entry__

    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine, theirs = __spark_entry__.queries()[name](spark, SF).toPandas(), con.execute(__spark_entry__.oracle_sql()[name]).df()
    said = lambda v: "" if pd.isna(v) else f"{float(v):.6g}" if isinstance(v, (int, float, np.number)) else str(v)
    shown = lambda df: sorted(tuple(map(said, row)) for row in df[sorted(df.columns)].itertuples(index=False))
    assert sorted(mine.columns) == sorted(theirs.columns) and shown(mine) == shown(theirs)


def test_viewer_sort(spark):
    rows = views.viewer_sort(spark.createDataFrame([("a10",), ("a9",), (None,)], "v string"), "v").collect()
    assert [r["v"] for r in rows] == [None, "a9", "a10"]


def test_viewer_sort_works_its_key_out_once(spark):
    """The sort is by a column, not by an expression that every comparison repeats; keys are those of padded runs."""
    odd = ["", "a", "a10b007", "9", "x" + "1234567890" * 2, "0" * 30 + "5-é12\n3", "1" * 18, "1" * 19, "2 " + "7" * 40]
    df = spark.createDataFrame([(v,) for v in odd] + [(None,)], "v string")
    plan = views.viewer_sort(df, "v")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Sort [" in line and "regexp" in line]
    want = {v: "".join(p.rjust(18, "0")[:18] if p.isdigit() else p for p in re.findall(r"[0-9]+|[^0-9]+", (v or "").lower())) for v in [*odd, None]}
    assert {r[0]: r[1] for r in df.select("v", text.natural_sort_key(F.col("v"))).collect()} == want
