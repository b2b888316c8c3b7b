"""Exact deduplication against a persistent digest index (DataFrame functions only).

The index is a Parquet table bucketed and sorted by digest.  A batch is
reduced to one row a digest before anything is shuffled by it, anti-joined with
the index (the index side is read bucket by bucket, without a shuffle) and what
is new is appended, one sorted file a bucket.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.llm.shared import IdFilter, Scratch, shuffle_parts, spread_join, text_or_empty

SPACES = " \t\n\x0b\x0c\r"
#: New digests a bucket of an index that is made, about, and the buckets that Spark allows.
BUCKET_ROWS, MOST_BUCKETS = 1_000_000, 100_000


def text_digest(text_col: str = "text"):
    """The 32 bytes of sha256 of a text without white space; null counts as empty."""
    return F.unhex(F.sha2(F.translate(text_or_empty(text_col), SPACES, "").cast("binary"), 256))


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, chars, digest) of every row; `row` tells repeated rows apart.

    A null text counts as empty.  Other columns, whatever their names, are not read.
    """
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.char_length(text_or_empty(text_col)).cast("long").alias("chars"),
        text_digest(text_col).alias("digest"),
    )


def first_rows(digests: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_row, group_size): of equal texts the row with most code points, then the smallest id (null last), then the first row."""
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("lone"), "doc_id", "row")).alias("best")
    groups = digests.groupBy("digest").agg(best, F.count("*").alias("group_size"))
    return groups.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")


class DigestIndex:
    """Digests seen so far with the row that stays: (digest, keep_id, group_size, batch), in a folder.

    The number of buckets is that of `expected` digests, in steps of powers of
    two and at least the session's shuffle partitions; it is fixed when the
    folder is made, and kept in its name.
    """

    def __init__(self, spark: SparkSession, path: str, expected: int = 0, id_type: str = "bigint"):
        self.spark = spark
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        made = [f.getPath().getName() for f in files.listStatus(root)] if files.exists(root) else []
        made = [int(n.removeprefix("buckets-")) for n in made if n.startswith("buckets-")]
        wanted = max(shuffle_parts(spark), -(-expected // BUCKET_ROWS))
        self.buckets = made[0] if made else min(MOST_BUCKETS, 1 << (wanted - 1).bit_length())
        self.path = f"{path.rstrip('/')}/buckets-{self.buckets}"
        self.name = f"digest_index_{uuid.uuid4().hex[:12]}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id {id_type}, group_size BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        """Forget the catalog entry; the index itself stays at its path."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add the groups (see first_rows) whose digests the index lacks, under the name of their batch.

        What the index has already stays as it is: a later batch never displaces
        it.  So a batch that comes again, also after a driver that was lost on
        the way, adds only what was not added before.
        """
        new = groups.select("digest", "keep_id", "group_size").join(self.table(), "digest", "left_anti").withColumn("batch", F.lit(batch))
        (
            new.repartition(self.buckets, "digest")
            .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", self.path).saveAsTable(self.name)
        )

    def entries(self, groups: DataFrame) -> DataFrame:
        """(digest, keep_id, group_size, batch, keep_row) of the groups' digests; the index is read in place, bucket by bucket."""
        return groups.select("digest", "keep_row").join(self.table(), "digest")


def exact_dedup(docs: DataFrame, index_path: str | None = None, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters of [\\x20\\x09-\\x0D];
    all empty or null texts are one group.  Rows repeated outright form a group
    like others: one of them stays.  An empty table gives an empty result.  With
    an existing `index_path`, texts already indexed lose to the indexed row, and
    group_size is that of the batch in which a text was first seen.  `batch`
    names this batch: the same rows run again under their name give the same
    result, however far the first run came; without a name a batch that is run
    again keeps none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    digests = scratch.save(text_digests(docs, id_col, text_col), "digests")
    groups = scratch.save(first_rows(digests), "groups")
    index = DigestIndex(spark, index_path or scratch.path("index"), groups.count(), docs.schema[id_col].dataType.simpleString())
    batch = batch or uuid.uuid4().hex
    index.append(groups, batch)
    entries = scratch.save(index.entries(groups), "entries")
    first = (F.col("row") == F.col("keep_row")) & F.col("batch").eqNullSafe(F.lit(batch))
    found = spread_join(digests, entries, "digest").select("doc_id", "keep_id", "group_size", first.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    found = scratch.save(found, "found")
    index.close()
    return found


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns without the rows that `exact_dedup` drops.

    Rows go by id and text: null ids and ids with several texts are judged text
    by text, of rows repeated outright one stays, of null and empty texts one
    stays.  Columns of any name pass through; an empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "exact-kept")
    found = exact_dedup(docs, id_col=id_col, text_col=text_col)
    # ids with a row that goes; only their rows are looked at again, and only those are shuffled
    ids = scratch.save(found.where("NOT kept").select("doc_id").distinct(), "ids")
    maybe, sure = IdFilter(ids, scratch).split(docs, id_col)
    keys = ["__nf_id", "__nf_sha"]
    rest = maybe.withColumns({keys[0]: F.col(id_col), keys[1]: F.lower(F.hex(text_digest(text_col)))})
    kept = found.where("kept").select(F.col("doc_id").alias(keys[0]), F.col("text_sha256").alias(keys[1]))
    same = (rest[keys[1]] == kept[keys[1]]) & rest[keys[0]].eqNullSafe(kept[keys[0]])
    stay = rest.join(kept, same, "left_semi")
    # one id with several rows of one text, of which one stays
    again = found.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"), F.max(F.col("kept").cast("int")).alias("k")).where("n > 1 AND k = 1")
    if not again.isEmpty():
        stay = stay.dropDuplicates(keys)
    return sure.unionByName(stay.drop(*keys))
