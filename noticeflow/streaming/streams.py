"""Streams: upsert, change detection, reminders once, scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.operators.cdc import capture_changes, latest_version
from noticeflow.operators.score import Ruleset, score
from noticeflow.sources.versions import VersionedTable


def stream_upsert(stream: DataFrame, load_current: Callable[[], DataFrame], save: Callable[[DataFrame, int], None], key: str, now: Column, checkpoint: str, order: list[str]):
    """Start a query that captures changes batch by batch.

    `load_current` gives the current table and `save(changes, batch_id)` stores
    the outcome; a batch that comes again after a failure has the same id, so
    that saving under the id is idempotent.  Of several rows of a key in one
    batch the last by `order` counts.
    """
    def batch(rows: DataFrame, batch_id: int) -> None:
        save(capture_changes(latest_version(rows, key, order), load_current(), key, now), batch_id)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_changes(stream: DataFrame, key: str, hash_col: str, order: str) -> DataFrame:
    """(key, content_hash, change): emits a row when a key's hash is new or differs from the last one; state is one hash a key.

    A key's rows of one micro-batch are put in order together, so the source's
    rate limit (maxFilesPerTrigger and the like) bounds what a task holds.
    """
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    key_kind = stream.schema[key].dataType.simpleString()
    schema = f"{key} {key_kind}, content_hash string, change string"

    class LastHash(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.last = handle.getValueState("last", "hash string")

        def handleInputRows(self, key_, rows, timer_values):
            parts = [p for p in rows]
            frame = pd.concat(parts).sort_values(order)
            held = self.last.get()[0] if self.last.exists() else None
            out = []
            for h in frame[hash_col]:
                if h != held:
                    out.append((key_[0], h, "new" if held is None else "changed"))
                    held = h
            self.last.update((held,))
            yield pd.DataFrame(out, columns=[key, "content_hash", "change"])

        def close(self) -> None:
            pass

    return stream.groupBy(key).transformWithStateInPandas(LastHash(), schema, "Append", "none")


def stream_dedupe_reminders(events: DataFrame, keys: list[str], watermark: tuple[str, str] | None = None) -> DataFrame:
    """One reminder per bucket; with a watermark (column, delay) old state is dropped."""
    if watermark:
        return events.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def stream_score(stream: DataFrame, rules: Ruleset, key: str = "ticket_number") -> DataFrame:
    """Scoring is stateless: the same expression on a stream."""
    return score(stream, rules, key)


def stream_into(stream: DataFrame, table: VersionedTable, now: Column, order: list[str], checkpoint: str, name: str):
    """Start a query that upserts each batch into a versioned table: readers see whole batches, and a batch that comes again changes nothing.

    Of several rows of a key in one batch the last by `order` counts.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        table.upsert(latest_version(rows, table.key, order), now, name, batch_id)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ordered_changes(rows: DataFrame, last: DataFrame, key: str, hash_col: str, order: str) -> DataFrame:
    """(key, order, content_hash, change) of a batch's rows whose hash is new for its key or differs from the one before it.

    A key's rows are put in order by an external sort and read one by one, so a
    key of any number of rows takes bounded memory; `last` holds the hash stored
    last of each key.
    """
    first = rows.join(last.select(key, F.col("latest_content_hash").alias("__last")), key, "left")
    before = F.coalesce(F.lag(hash_col).over(Window.partitionBy(key).orderBy(order)), F.col("__last"))
    found = first.withColumn("__before", before).where(~F.col("__before").eqNullSafe(F.col(hash_col)))
    return found.select(key, order, F.col(hash_col).alias("content_hash"), F.when(F.col("__before").isNull(), "new").otherwise("changed").alias("change"))


def stream_ordered_changes(stream: DataFrame, state: VersionedTable, out: str, hash_col: str, order: str, now: Column, checkpoint: str, name: str):
    """Start a query that writes the `ordered_changes` of every batch to `out`, against the last hash a key in a versioned table.

    A batch's rows go to a folder of their own that a batch that comes again
    replaces; its state is committed after it, once, so what it is compared with
    is the same each time.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        done = state.commit_of()["batches"].get(name, -1)
        if done >= batch_id:
            return
        ordered_changes(rows, state.read(), state.key, hash_col, order).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        state.upsert(latest_version(rows.select(state.key, order, hash_col), state.key, [order]), now, name, batch_id)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
