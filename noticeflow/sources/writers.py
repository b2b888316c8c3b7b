"""Sinks: bundles, slices, JSON documents, versions, events, audits and map layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The files of the CSV bundle, in order.
BUNDLE = [
    "relevant_active", "relevant_expiring_4d", "relevant_expiring_7d", "relevant_late_utilities", "relevant_blocked", "relevant_new_24h",
    "relevant_by_contractor", "relevant_utility_detail", "relevant_cancelled_7d", "unassigned_tickets_for_review", "packages_view",
]


def write_bundle(frames: dict[str, DataFrame], out: str, single_file: bool = True) -> None:
    """One CSV folder per name, each replaced; the header is written even without rows.

    One file per output is what its readers take; outputs too large for one task
    set single_file=False.
    """
    for name, df in frames.items():
        df = df.coalesce(1) if single_file else df
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{out}/{name}")


def write_slices(stacked: DataFrame, out: str, key: str = "slug", keys: DataFrame | None = None, always: str = "relevant_active") -> None:
    """Folders by key and slice from one stacked table; a slice without rows has no folder, and the subtree is rebuilt.

    With `keys` (contractors or projects) each has its active slice: a header
    alone where it has no rows.
    """
    stacked.write.mode("overwrite").partitionBy(key, "slice").option("header", True).csv(out)
    if keys is not None:
        bare = keys.select(key).distinct().join(stacked.where(F.col("slice") == always).select(key), key, "left_anti")
        header = ",".join(c for c in stacked.columns if c not in (key, "slice"))
        bare.select(key, F.lit(always).alias("slice"), F.lit(header).alias("value")).write.mode("append").partitionBy(key, "slice").text(out)


def json_document(df: DataFrame, now: Column, limit: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """One row: generated_at, count of all rows (before the limit) and the rows, at most `limit` of them, in order."""
    total = df.agg(F.count("*").alias("count"))
    top = df.orderBy(*order) if order else df
    top = top.limit(limit) if limit else top
    rows = top.agg(F.collect_list(F.struct(*df.columns)).alias("rows"))
    return total.crossJoin(rows).select(now.alias("generated_at"), "count", "rows")  # two single rows


def write_json_docs(documents: dict[str, DataFrame], out: str) -> None:
    for name, df in documents.items():
        df.coalesce(1).write.mode("overwrite").json(f"{out}/{name}")


def manifest(frames: dict[str, DataFrame]) -> DataFrame:
    """(pos, name, rows) of every output, in their fixed order."""
    parts = [df.agg(F.lit(i).alias("pos"), F.lit(name).alias("name"), F.count("*").alias("rows")) for i, (name, df) in enumerate(frames.items(), 1)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def export_summary(tickets: DataFrame, frames: dict[str, DataFrame], slices: DataFrame, now: Column) -> DataFrame:
    """The manifest's head, one row: totals, call-date range, outputs with their rows in fixed order, slice count and the slice list.

    `slices` has a row a folder (column slug).  The list of outputs has a row an
    output and that of folders one a contractor or project.
    """
    relevant = tickets.where("is_relevant")
    head = tickets.agg(F.count("*").alias("total_tickets"), F.count_if("is_relevant").alias("total_relevant"))
    dates = relevant.agg(F.min("call_date").alias("call_date_min"), F.max("call_date").alias("call_date_max"))
    files = manifest(frames).agg(F.array_sort(F.collect_list(F.struct("pos", "name", "rows"))).alias("files"))
    folders = slices.agg(F.count_distinct("slug").alias("slice_count"), F.array_sort(F.collect_set("slug")).alias("slice_dirs"))
    return head.crossJoin(dates).crossJoin(files).crossJoin(folders).withColumn("generated_at", now)  # single rows


def slice_counts(stacked: DataFrame, keys: DataFrame, key: str = "slug", always: str = "relevant_active") -> DataFrame:
    """(key, slice, rows) of every folder: each key has its active slice, with 0 rows if need be; others only where they have rows."""
    counted = stacked.groupBy(key, "slice").agg(F.count("*").alias("rows"))
    wanted = keys.select(key).distinct().withColumn("slice", F.lit(always))
    return counted.join(wanted, [key, "slice"], "full_outer").select(key, "slice", F.coalesce("rows", F.lit(0)).alias("rows"))


def written_sizes(spark: SparkSession, out: str) -> DataFrame:
    """(name, bytes) of a written bundle, from file metadata."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(out)
    return files.groupBy(F.element_at(F.split("path", "/"), -2).alias("name")).agg(F.sum("length").alias("bytes"))


def append(df: DataFrame, path: str) -> None:
    """Append to a log of snapshots, reminder events, audits or failures."""
    df.write.mode("append").parquet(path)


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Write a table as a new version beside the old ones; readers of an earlier version are not disturbed."""
    path = f"{root}/version={version:08d}"
    df.write.mode("overwrite").parquet(path)
    return path


def observed(changes: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """The table with counters that are filled while it is written: no second pass for the audit."""
    watch = Observation(name)
    kind = lambda c: F.count_if(F.col("change") == c).alias(c)
    return changes.observe(watch, F.count(F.lit(1)).alias("found"), kind("new"), kind("changed"), kind("unchanged")), watch


def run_audit(spark: SparkSession, watch: Observation, started, finished, status: str, error: str | None = None) -> DataFrame:
    """The audit row of a finished run."""
    c = watch.get
    return spark.createDataFrame(
        [(started, finished, status, c["found"], c["new"], c["changed"], c["unchanged"], error)],
        "started_at timestamp, finished_at timestamp, status string, found long, new long, changed long, unchanged long, error string",
    )


AUDIT = "run string, started_at timestamp, finished_at timestamp, status string, found long, new long, changed long, unchanged long, error string"


class AuditedRun:
    """An audit of a run in slices: a row when it starts, one when it ends, also when it dies.

        with AuditedRun(spark, path, "nightly") as run:
            for rows in slices:
                changes, watch = observed(capture_changes(rows, ...))
                ...write changes...
                run.add(watch)

    The last row has the counters of all slices that were finished and, if an
    error ended the run, the error; the error goes on to the caller.  A run
    whose process is killed has its first row alone, by which it is found.
    """

    COUNTERS = ("found", "new", "changed", "unchanged")

    def __init__(self, spark: SparkSession, path: str, run: str, clock=None):
        import datetime

        self.spark, self.path, self.run = spark, path, run
        self.clock = clock or (lambda: datetime.datetime.now(datetime.timezone.utc))
        self.counters = dict.fromkeys(self.COUNTERS, 0)

    def _append(self, finished, status: str, error: str | None) -> None:
        counters = [self.counters[c] if finished else None for c in self.COUNTERS]
        append(self.spark.createDataFrame([(self.run, self.started, finished, status, *counters, error)], AUDIT).coalesce(1), self.path)

    def __enter__(self) -> AuditedRun:
        self.started = self.clock()
        self._append(None, "started", None)
        return self

    def add(self, watch: Observation) -> None:
        """Count a slice whose changes are written."""
        for c in self.COUNTERS:
            self.counters[c] += watch.get[c]

    def __exit__(self, kind, error, trace) -> bool:
        self._append(self.clock(), "ok" if error is None else "failed", None if error is None else f"{kind.__name__}: {error}"[:4000])
        return False


def last_audits(audits: DataFrame) -> DataFrame:
    """One row a run: its end if it has one, else its start (status 'started': running, or lost without a word)."""
    rest = [c for c in audits.columns if c != "run"]
    return audits.groupBy("run").agg(F.max_by(F.struct(*rest), F.struct("started_at", F.col("finished_at").isNotNull(), "finished_at")).alias("r")).select("run", "r.*")


def write_map_layers(layers: DataFrame, out: str) -> None:
    """GeoJSON-like lines by layer."""
    layers.write.mode("overwrite").partitionBy("layer").json(out)


def sync_table(synced: DataFrame, root: str, version: int) -> str:
    """Persist a synchronised feature table as a new version."""
    return write_version(synced.where("action <> 'deleted'").drop("action"), root, version)
