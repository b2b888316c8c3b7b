"""Versioned tables, ordered changes, reminders once, audits of failed runs and maintained rollups."""

import random

import pytest
from pyspark.sql import functions as F

from noticeflow.operators import cdc
from noticeflow.sources import writers
from noticeflow.sources.versions import CommitConflict, VersionedTable
from noticeflow.streaming import streams

KIND = "k long, said string, latest_content_hash string, created_at timestamp, updated_at timestamp"


def rows_of(spark, *rows):
    return spark.createDataFrame(rows, "k long, said string")


def now():
    return F.lit("2001-08-01 12:00:00").cast("timestamp")


def held(current):
    return {r["k"]: r["said"] for r in current.read().collect()}


def test_versions_are_seen_whole(spark, tmp_path):
    current = VersionedTable(spark, f"file://{tmp_path}/t", "k", KIND, buckets=4)
    assert current.read().count() == 0 and current.versions() == []
    assert current.upsert(rows_of(spark, (1, "a"), (2, "b")), now(), "w", 0) == 1
    old = current.commit_of()
    # a writer that dies before its commit leaves files that no reader takes
    commit = current._commit
    current._commit = lambda c: (_ for _ in ()).throw(KeyError("lost"))
    with pytest.raises(KeyError):
        current.upsert(rows_of(spark, (1, "z")), now(), "w", 1)
    current._commit = commit
    assert held(current) == {1: "a", 2: "b"} and current.versions() == [1]
    assert current.upsert(rows_of(spark, (1, "z"), (3, "c")), now(), "w", 1) == 2 and held(current) == {1: "z", 2: "b", 3: "c"}
    # the same batch again, and a batch that changes nothing
    assert current.upsert(rows_of(spark, (1, "q")), now(), "w", 1) == 2 and current.upsert(rows_of(spark, (2, "b")), now()) == 2
    assert {r["k"]: r["said"] for r in current.read(old).collect()} == {1: "a", 2: "b"}
    untouched = set(current.commit_of()["folders"].values()) & set(old["folders"].values())
    assert len(untouched) == len({r[0] for r in rows_of(spark, (2, "b")).select(current.bucket()).collect()} - {r[0] for r in rows_of(spark, (1, ""), (3, "")).select(current.bucket()).collect()})
    current.vacuum(keep=1)
    assert held(current) == {1: "z", 2: "b", 3: "c"} and current.versions() == [2]


def test_writers_that_meet(spark, tmp_path):
    """The one that comes second works out its rows again over the first one's version; neither is lost."""
    one, two = (VersionedTable(spark, f"file://{tmp_path}/t", "k", KIND, buckets=2, tries=2) for _ in "ab")
    commit, met = one._commit, []

    def late(c):
        if not met:
            met.append(two.upsert(rows_of(spark, (1, "two"), (2, "two")), now()))
        return commit(c)

    one._commit = late
    assert one.upsert(rows_of(spark, (1, "one"), (3, "one")), now()) == 2 and met == [1]
    assert held(one) == {1: "one", 2: "two", 3: "one"}
    one._commit = lambda c: False
    with pytest.raises(CommitConflict):
        one.upsert(rows_of(spark, (4, "x")), now())


def test_ordered_changes_of_one_key(spark):
    """200,000 rows of one key and some of others, in no order: against a loop."""
    rnd = random.Random(2)
    rows = [(7, i, rnd.choice("abc")) for i in range(200_000)] + [(k, i, rnd.choice("ab")) for k in (1, 2) for i in range(5)]
    rnd.shuffle(rows)
    last = spark.createDataFrame([(1, "a"), (9, "q")], "k long, latest_content_hash string")
    got = streams.ordered_changes(spark.createDataFrame(rows, "k long, at long, said string"), last, "k", "said", "at").collect()
    want, state = [], {1: "a"}
    for k, i, s in sorted(rows):
        if state.get(k) != s:
            want.append((k, i, s, "changed" if k in state else "new"))
        state[k] = s
    assert sorted(map(tuple, got)) == sorted(want)


def test_reminders_once_with_late_rows(spark, tmp_path):
    """Two runs of one query: a key seen before stays out within the delay, and rows behind the watermark are dropped."""
    kind, root = "k string, at timestamp", f"file://{tmp_path}"

    def run(name, *rows):
        spark.createDataFrame(rows, "k string, at string").select("k", F.col("at").cast("timestamp").alias("at")).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        source = spark.readStream.schema(kind).option("recursiveFileLookup", True).parquet(f"{root}/in")
        once = streams.stream_dedupe_reminders(source, ["k"], ("at", "1 hour"))
        once.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
        return sorted(r["k"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run("a", ("x", "2001-01-01 10:00:00"), ("x", "2001-01-01 10:05:00"), ("y", "2001-01-01 10:10:00")) == ["x", "y"]
    assert run("b", ("x", "2001-01-01 10:20:00"), ("z", "2001-01-01 14:00:00")) == ["x", "y", "z"]  # x is known
    # the watermark stands at 13:00: a row before it is dropped, and x, whose state is gone, comes once more
    assert run("c", ("late", "2001-01-01 09:00:00"), ("x", "2001-01-01 14:30:00")) == ["x", "x", "y", "z"]


def test_audit_of_runs(spark, tmp_path):
    path = f"file://{tmp_path}/audits"
    changes = spark.createDataFrame([("new",), ("new",), ("unchanged",)], "change string")
    with pytest.raises(RuntimeError):
        with writers.AuditedRun(spark, path, "one") as run:
            for k in range(3):
                seen, watch = writers.observed(changes.withColumn("change", F.when(F.lit(k == 2), F.raise_error(F.lit("lost"))).otherwise(F.col("change"))), f"one-{k}")
                try:
                    seen.write.parquet(f"{tmp_path}/out-{k}")
                except Exception as error:
                    raise RuntimeError("slice 2") from error
                run.add(watch)
    with writers.AuditedRun(spark, path, "two") as run:
        pass
    writers.AuditedRun(spark, path, "three").__enter__()  # a process that is killed
    got = {r["run"]: (r["status"], r["found"], r["new"], r["error"]) for r in writers.last_audits(spark.read.parquet(path)).collect()}
    assert got == {"one": ("failed", 6, 4, "RuntimeError: slice 2"), "two": ("ok", 0, 0, None), "three": ("started", None, None, None)}


def test_maintained_sums_equal_full_ones(spark):
    rnd = random.Random(6)
    draw = lambda ids: [(i, rnd.choice(["a", "b", None]), rnd.choice([1, 2, None])) for i in ids]
    kind, by, measures = "k long, g string, v long", ["g"], {"v": F.col("v"), "big": F.col("v") > 1}
    stored, state = spark.createDataFrame(draw(range(60)), kind), None
    sums = cdc.group_sums(stored, by, measures)
    for turn in range(3):
        incoming = spark.createDataFrame(draw(range(40 * turn, 40 * turn + 50)), kind)
        changes = cdc.capture_changes(incoming, stored.withColumn("latest_content_hash", cdc.content_hash(stored)), "k", now())
        sums = cdc.maintained(sums, *cdc.replaced_rows(changes, stored, "k"), by, measures)
        stored = stored.join(incoming, "k", "left_anti").unionByName(incoming)
        stored, sums = (spark.createDataFrame(x.collect(), x.schema) for x in (stored, sums))
        state = cdc.group_sums(stored, by, measures)
        assert sorted(map(str, sums.collect())) == sorted(map(str, state.collect()))


def test_an_empty_table_is_joined_with_nothing(spark, tmp_path):
    """The first version of a table is written without the shuffles of joins."""
    table = VersionedTable(spark, f"file://{tmp_path}/t", "k", "k string, v string, latest_content_hash string, created_at timestamp, updated_at timestamp", buckets=2)
    rows = spark.createDataFrame([("a", "x"), ("b", None)], "k string, v string")
    plan = rows.join(table.read(), "k", "left_anti").join(table.read().select("k", "v"), "k", "left")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    table.upsert(rows, F.lit("2001-08-01 12:00:00").cast("timestamp"))
    assert sorted((r["k"], r["v"]) for r in table.read().collect()) == [("a", "x"), ("b", None)]
