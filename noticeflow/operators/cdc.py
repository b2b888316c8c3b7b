"""Change capture: content hashes, current state, version history, reminders and scoped synchronisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Runtime, group and relevance columns are no part of a record's content.
NOT_CONTENT = (
    "parsed_at", "parse_method", "probable_company", "probable_work_group", "probable_crew", "relevance_score", "relevance_reasons", "is_relevant",
    "raw_text", "created_at", "updated_at", "latest_content_hash",
)


def content_hash(df: DataFrame, exclude: Sequence[str] = NOT_CONTENT) -> Column:
    """SHA-256 over the content columns in name order; null differs from ''."""
    names = sorted(c for c in df.columns if c not in exclude)
    return F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)


def capture_changes(incoming: DataFrame, current: DataFrame, key: str, now: Column, exclude: Sequence[str] = NOT_CONTENT) -> DataFrame:
    """The incoming rows with content_hash and change (new, changed or unchanged) against the stored hash."""
    stored = current.select(F.col(key), F.col("latest_content_hash").alias("__old"))
    hashed = incoming.withColumn("content_hash", content_hash(incoming, exclude)).withColumn("captured_at", now)
    return hashed.join(stored, key, "left").withColumn(
        "change", F.when(F.col("__old").isNull(), "new").when(F.col("__old") != F.col("content_hash"), "changed").otherwise("unchanged")
    ).withColumnRenamed("__old", "changed_from")


def snapshots(changes: DataFrame, key: str) -> DataFrame:
    """Rows to append to the version history: the whole payload of every new version."""
    payload = [c for c in changes.columns if c not in ("content_hash", "captured_at", "change", "changed_from")]
    return changes.where("change <> 'unchanged'").select(key, "content_hash", "captured_at", F.to_json(F.struct(*payload)).alias("payload"))


def upsert_current(changes: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """The next current table: new rows in, changed rows replaced (created_at and groups kept), the rest untouched."""
    keep = [c for c in ("probable_company", "probable_work_group", "probable_crew") if c in current.columns and c in changes.columns]
    before = current.select(key, F.col("created_at").alias("__created"), *[F.col(c).alias(f"__{c}") for c in keep])
    moved = changes.where("change <> 'unchanged'").join(before, key, "left")
    moved = moved.withColumns(
        {"created_at": F.coalesce("__created", "captured_at"), "updated_at": F.col("captured_at"), "latest_content_hash": F.col("content_hash")}
        | {c: F.coalesce(c, f"__{c}") for c in keep}
    ).drop("__created", "content_hash", "captured_at", "change", "changed_from", *[f"__{c}" for c in keep])
    rest = current.join(moved.select(key), key, "left_anti")
    return rest.unionByName(moved, allowMissingColumns=True)


def run_stats(changes: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """One row of counters; with `failures` (quarantined records) their number, too."""
    kind = lambda c: F.count_if(F.col("change") == c).alias(c)
    counted = changes.agg(F.count("*").alias("found"), kind("new"), kind("changed"), kind("unchanged"))
    return counted if failures is None else counted.crossJoin(failures.agg(F.count("*").alias("failed")))  # two single rows


def latest_version(versions: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last version of each key, by one aggregation."""
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v")).select(key, "v.*")


def version_history(versions: DataFrame, key: str, order: Sequence[str], hash_col: str = "content_hash") -> DataFrame:
    """Versions with their number and the hash they changed from; rows that repeat the hash before them are no versions."""
    w = Window.partitionBy(key).orderBy(*order)
    before = versions.withColumn("changed_from", F.lag(hash_col).over(w))
    real = before.where(F.col("changed_from").isNull() | (F.col("changed_from") != F.col(hash_col)))
    return real.withColumn("version", F.row_number().over(w))


def recent_changes(tickets: DataFrame, history: DataFrame, key: str, n: int = 50) -> DataFrame:
    """Relevant tickets with more than one version, latest first."""
    again = history.groupBy(key).agg(F.count("*").alias("versions")).where("versions > 1")
    return tickets.where("is_relevant").join(again, key, "left_semi").orderBy(F.desc("updated_at"), key).limit(n)


def merge_windows(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key from overlapping fetch windows: the last fetched."""
    return latest_version(rows, key, order)


def sync_owner_scoped(incoming: DataFrame, cached: DataFrame, key: str = "project_id", owner: str = "owner") -> DataFrame:
    """Full outer comparison: action is new, updated, unchanged, deleted or kept.

    Only cached rows of an owner that occurs in `incoming` can be deleted; if no
    incoming row has an owner the whole cache is in scope.  A feature cached
    under another owner is an update.
    """
    content = [c for c in incoming.columns if c != key]
    packed = lambda df, name: df.select(F.col(key), F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256).alias(f"{name}_hash"), F.struct(*content).alias(name))
    owners = incoming.where(F.col(owner).isNotNull()).select(F.col(owner).alias("__owner")).distinct()
    any_owner = owners.agg((F.count("*") == 0).alias("__all"))  # one row
    both = packed(incoming, "new").join(packed(cached, "old"), key, "full_outer").crossJoin(F.broadcast(any_owner))
    scoped = both.join(owners.withColumn("__in", F.lit(True)), F.col(f"old.{owner}") == F.col("__owner"), "left")
    action = (
        F.when(F.col("old").isNull(), "new").when(F.col("new").isNull() & (F.coalesce("__in", F.lit(False)) | F.col("__all")), "deleted")
        .when(F.col("new").isNull(), "kept").when(F.col("new_hash") != F.col("old_hash"), "updated").otherwise("unchanged")
    )
    return scoped.select(key, F.coalesce("new", "old").alias("__row"), action.alias("action")).select(key, "__row.*", "action")


def synced_table(synced: DataFrame) -> DataFrame:
    return synced.where("action <> 'deleted'").drop("action")


def sync_stats(synced: DataFrame) -> DataFrame:
    return synced.where("action <> 'kept'").groupBy("action").agg(F.count("*").alias("n"))


REMINDER_KEY = ["ticket_number", "expiration_date", "lead_days", "dry_run"]


def unsent_reminders(eligible: DataFrame, events: DataFrame) -> DataFrame:
    """Eligible tickets whose bucket has no event yet."""
    return eligible.join(events.select(*REMINDER_KEY), REMINDER_KEY, "left_anti")


def reminder_events(sent: DataFrame, now: Column) -> DataFrame:
    return sent.select(*REMINDER_KEY, now.alias("sent_at"))


def refetch_targets(export: DataFrame, wanted: DataFrame, key: str = "ticket_number") -> tuple[DataFrame, DataFrame]:
    """(export rows that are wanted, wanted rows that the export lacks)."""
    return export.join(wanted, key, "left_semi"), wanted.join(export, key, "left_anti")


def missing_from_config(data: DataFrame, config: DataFrame, key: str = "county") -> DataFrame:
    return data.select(key).where(F.col(key).isNotNull()).distinct().join(config, key, "left_anti")


def not_yet_parsed(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Files whose (path, hash) was not parsed before; an unknown hash counts as not parsed."""
    return files.join(parsed.where("sha256 IS NOT NULL").select("path", "sha256"), ["path", "sha256"], "left_anti")


def attach_ticket_ids(events: DataFrame, tickets: DataFrame, key: str = "ticket_number", id_col: str = "ticket_id") -> DataFrame:
    """Events with the surrogate id of their ticket; an event without a ticket is not stored."""
    return events.join(tickets.select(key, id_col), key)


# -- rollups kept up to date -------------------------------------------------------


def replaced_rows(changes: DataFrame, before: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows as they were stored, rows as they came) of what is new or changed: what a rollup has to take out and to put in."""
    moved = changes.where("change <> 'unchanged'")
    return before.join(moved.select(key), key, "left_semi"), moved


def group_sums(rows: DataFrame, by: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """(by..., rows, measures...): sums that can be taken back; a null counts as 0."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), *[F.sum(F.coalesce(m.cast("long"), F.lit(0))).alias(k) for k, m in measures.items()])


def maintained(sums: DataFrame, out: DataFrame, into: DataFrame, by: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """The `group_sums` after rows went out and others came in, from these alone; groups without rows are gone.

    Null group values are groups like others.
    """
    names = ["rows", *measures]
    less = group_sums(out, by, measures).select(*by, *[(-F.col(n)).alias(n) for n in names])
    return sums.unionByName(less).unionByName(group_sums(into, by, measures)).groupBy(*by).agg(*[F.sum(n).alias(n) for n in names]).where("rows > 0")
