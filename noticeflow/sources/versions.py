"""Tables in versions: commits that readers see whole or not at all, and writers that may meet."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from noticeflow.operators.cdc import capture_changes, upsert_current
from noticeflow.scratch import Scratch


class CommitConflict(RuntimeError):
    """Another writer made the version first, time and again."""


class VersionedTable:
    """A current table by key, in a folder that all writers and readers share.

    Rows lie in `buckets` by the hash of their key.  A version is one small file
    `_commits/<number>.json` that names the folder of every bucket; it is renamed
    into place in one step, which fails if another writer was first, and the
    loser works out its rows again over the new version.  Readers take the last
    commit: what a writer that died has left is in no commit.  A version writes
    only buckets in which a row changes, the others stay where they are.  A
    commit also holds the last batch of every named writer, so that a batch that
    comes again changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, schema: str | StructType, buckets: int = 64, tries: int = 10):
        self.spark, self.root, self.key, self.buckets, self.tries = spark, root.rstrip("/"), key, buckets, tries
        self.schema = spark.createDataFrame([], schema).schema
        self._jvm, self._path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.mkdirs(self._path(f"{self.root}/_commits"))

    def versions(self) -> list[int]:
        names = [f.getPath().getName() for f in self._files.listStatus(self._path(f"{self.root}/_commits"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def commit_of(self, version: int | None = None) -> dict:
        """The commit of a version, by default the last; that of version 0 is empty."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "folders": {}, "batches": {}}
        stream = self._files.open(self._path(f"{self.root}/_commits/{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, commit: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a commit, by default the last; with `buckets` of these alone."""
        folders = (commit or self.commit_of())["folders"]
        paths = [f"{self.root}/{folder}" for b, folder in folders.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema).where("false")  # known to be empty when plans are made: joins with it fall away

    def _commit(self, commit: dict) -> bool:
        """Put a commit in place in one step; False if its version is there."""
        end = self._path(f"{self.root}/_commits/{commit['version']:012d}.json")
        start = self._path(f"{self.root}/_commits/.{uuid.uuid4().hex}")
        out = self._files.create(start, False)
        out.write(json.dumps(commit).encode())
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(start.toUri() if start.toUri().getScheme() else self._files.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._files.makeQualified(start), self._files.makeQualified(end), none)  # never replaces
            return True
        except Exception as error:
            self._files.delete(start, False)
            if "FileAlreadyExistsException" in str(getattr(error, "java_exception", error)):
                return False
            raise

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def upsert(self, rows: DataFrame, now: Column, writer: str | None = None, batch: int | None = None) -> int:
        """Capture the changes that rows (one a key) make, and commit them; the version that holds them."""
        scratch = Scratch(self.spark, "upsert")
        for turn in range(self.tries):
            before = self.commit_of()
            if writer is not None and batch is not None and before["batches"].get(writer, -1) >= batch:
                return before["version"]
            changes = capture_changes(rows, self.read(before), self.key, now).where("change <> 'unchanged'")
            changes = scratch.save(changes, f"changes-{turn}")
            touched = sorted(r[0] for r in changes.select(self.bucket()).distinct().collect())  # at most `buckets`
            folder = f"data-{uuid.uuid4().hex}"
            if touched:
                after = upsert_current(changes, self.read(before, touched), self.key).select(*self.schema.names)
                after.withColumn("__bucket", self.bucket()).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.root}/{folder}")
            folders = before["folders"] | {str(b): f"{folder}/__bucket={b}" for b in touched}
            batches = before["batches"] | ({writer: batch} if writer is not None and batch is not None else {})
            if (not touched and batches == before["batches"]) or self._commit({"version": before["version"] + 1, "folders": folders, "batches": batches}):
                return before["version"] + bool(touched or batches != before["batches"])
            if touched:
                self._files.delete(self._path(f"{self.root}/{folder}"), True)
        raise CommitConflict(f"{self.root}: {self.tries} commits by others")

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the last commits, and folders that none of those names."""
        kept = self.versions()[-keep:]
        named = {folder.split("/")[0] for v in kept for folder in self.commit_of(v)["folders"].values()}
        for v in set(self.versions()) - set(kept):
            self._files.delete(self._path(f"{self.root}/_commits/{v:012d}.json"), False)
        for f in self._files.listStatus(self._path(self.root)):
            if f.getPath().getName().startswith("data-") and f.getPath().getName() not in named:
                self._files.delete(f.getPath(), True)
