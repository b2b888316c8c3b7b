"""Scans: exports, pages, features, documents, tables and fetch plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.functions.dates import epoch_ms_to_date
from noticeflow.functions.text import blank_to_null

#: Export columns -> raw fields.
EXPORT_FIELDS = {
    "call_date_raw": "Creation", "expiration_date_raw": "GoodUntil", "excavator_name_raw": "ExcavatorName", "work_type_raw": "workType",
    "status_raw": "TicketType", "work_done_for_raw": "WorkDoneFor", "remarks_raw": "Remarks",
}
#: Properties of the feature feed.
FEATURE_TEXTS = {
    "project_name": "ProjectName", "facility_type": "FacilityType", "project_type": "ProjectType", "description": "Description", "owner": "Owner",
    "department": "Department", "division": "Division", "status": "Status", "council_district": "CouncilDistrict",
}
FEATURE_DATES = {"est_start_date": "EstStartDate", "est_end_date": "EstEndDate", "act_start_date": "ActStartDate", "act_end_date": "ActEndDate"}


def read_export_csv(spark: SparkSession, path: str, county: str, url: str = "https://example.org/ticket/{}") -> DataFrame:
    """Rows of an export by header name, whatever the column order; rows without id or number, and files without rows, give none."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)
    named = {c.strip(): c for c in raw.columns}
    col = lambda name: blank_to_null(F.col(f"`{named[name]}`")) if name in named else F.lit(None).cast("string")
    rows = raw.select(
        F.upper(col("Number")).alias("ticket_number"), col("ticketId").alias("ticket_id"), F.lit(county).alias("county"), *[col(n).alias(k) for k, n in EXPORT_FIELDS.items()]
    ).where("ticket_number IS NOT NULL AND ticket_id IS NOT NULL")
    before, _, after = url.partition("{}")
    return rows.withColumn("detail_url", F.concat(F.lit(before), "ticket_id", F.lit(after)))


def read_page_snapshots(spark: SparkSession, path: str, wanted: DataFrame | None = None, depth: int = 1) -> DataFrame:
    """(path, html) of saved pages; with `wanted` (column source_html_path) one row per wanted page, html null where the file is missing.

    The last `depth` parts of a path tell pages apart.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))
    if wanted is None:
        return files
    name = lambda c: F.substring_index(c, "/", -depth)
    return wanted.join(files.withColumn("__name", name(F.col("path"))).drop("path"), name(F.col("source_html_path")) == F.col("__name"), "left").drop("__name")


def read_features(spark: SparkSession, path: str, owner_like: str | None = None, negate: bool = False) -> DataFrame:
    """One row per feature of GeoJSON collections: trimmed texts, dates from epoch milliseconds, geometry as GeoJSON text."""
    props = T.StructType([T.StructField(n, T.StringType()) for n in ("ProjectID", *FEATURE_TEXTS.values(), *FEATURE_DATES.values())])
    feature = T.StructType([T.StructField("geometry", T.StringType()), T.StructField("properties", props)])
    schema = T.StructType([T.StructField("features", T.ArrayType(feature))])
    rows = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f"))
    p = lambda n: blank_to_null(F.col(f"f.properties.{n}"))
    out = rows.select(
        p("ProjectID").try_cast("bigint").alias("project_id"), *[p(n).alias(k) for k, n in FEATURE_TEXTS.items()],
        *[epoch_ms_to_date(p(n)).alias(k) for k, n in FEATURE_DATES.items()], F.col("f.geometry").alias("geometry"),
    ).where("project_id IS NOT NULL")
    if owner_like:
        hit = F.upper("owner").like(owner_like.upper())
        out = out.where(F.col("owner").isNull() | ~hit) if negate else out.where(hit)
    return out


def fingerprint_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, sha256, bytes) of stored documents."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def load_tickets(spark: SparkSession, path: str, relevant: bool | None = None, status: str | None = None) -> DataFrame:
    """The current table; both filters reach the Parquet scan."""
    df = spark.read.parquet(path)
    if relevant is not None:
        df = df.where(F.col("is_relevant") == relevant)
    return df.where(F.col("status") == status) if status else df


def load_features(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.withColumns({c: F.col(c).try_cast("date") for c in FEATURE_DATES if c in df.columns})


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def plan_windows(spark: SparkSession, today: Column, days: int, max_window: int = 30) -> DataFrame:
    """Inclusive fetch windows of at most max_window days over the look-back, newest first: window, start_date, end_date."""
    rows = spark.range(-(-days // max_window)).withColumn("today", today)
    end = F.date_sub("today", (F.col("id") * max_window).cast("int"))
    start = F.greatest(F.date_sub(end, max_window - 1), F.date_sub("today", days - 1))
    return rows.select((F.col("id") + 1).cast("int").alias("window"), start.alias("start_date"), end.alias("end_date"))


def fetch_plan(windows: DataFrame, counties: DataFrame) -> DataFrame:
    """Every window for every county: both sides are small configuration."""
    return windows.crossJoin(counties)


def union_layers(*layers: DataFrame) -> DataFrame:
    """The features of several layers, lines and polygons, one after the other (a feature in two layers stays twice)."""
    out = layers[0]
    for more in layers[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
