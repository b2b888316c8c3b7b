"""Token ids in ORC: run-length encoded integers, row indexes and Bloom filters on document ids.

One file per range of doc_id, each holding its documents in ascending order;
column `range` numbers the ranges in ascending order.  A reader takes stripes in
parallel, skips files, stripes and row groups by the statistics of doc_id and
range, and row groups by the Bloom filter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeflow.llm.shared import deal_ranges, give_back, ordered_ranges, shuffle_parts

SCHEMA = "range int, doc_id long, ids array<int>, n_tokens long, range_start long"


def encode_texts(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, ids): the ids of every whole text and the end id; h is a hash of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))

    def work(batches):
        import pyarrow as pa

        from noticeflow.llm.tokens import encoder

        enc = encoder(path)
        for batch in batches:
            for first, last, ids, at in enc.encode_batch(batch.column(2), (end_id,)):
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], batch.column(1)[first:last], lists], ["doc_id", "h", "ids"])
        give_back()

    return rows.mapInArrow(work, "doc_id long, h long, ids array<int>")


def write_token_orc(
    docs: DataFrame, folder: str, path: str, end_id: int, stripe_mb: int = 64, index_stride: int = 10_000, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Tokenise whole texts, append the end id, and write them in ascending doc_id order.

    Texts are encoded where they are read; only their ids move, to ranges of
    doc_id, which are sorted and written by one task each, with nothing behind
    the sort that could change the order.  Null texts count as empty (the end id
    alone); rows that repeat a doc_id, nulls (which come first) included, are
    ordered by a hash of the text and their ids, so that a doc_id of very many
    rows takes several ranges; an empty table gives no rows; ids that are not
    numbers are an error; columns besides id and text are not read.
    """
    number, count = ordered_ranges(docs.select(F.col(id_col).cast("long").alias("doc_id")), shuffle_parts(docs.sparkSession))
    rows = encode_texts(docs, path, end_id, id_col, text_col).withColumn("range", number)
    dealt = deal_ranges(rows, count).sortWithinPartitions("range", "doc_id", F.desc("h"), "ids")
    dealt = dealt.select("range", "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))

    def work(batches):
        import pyarrow as pa

        last, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            of, n = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            starts = np.cumsum(n) - n
            # each range begins at 0; a partition has one as a rule
            for at in np.flatnonzero(np.append(of[0] != last, of[1:] != of[:-1])):
                starts[at:] -= starts[at] if at or of[0] != last else 0
                total = 0 if at == 0 else total
            first = of == of[0]
            starts[first] += total
            total = int(starts[-1] + n[-1])
            last = of[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts)], ["range", "doc_id", "ids", "n_tokens", "range_start"])
        give_back()

    (
        dealt.mapInArrow(work, "range int, doc_id long, ids array<int>, n_tokens long, range_start long").write
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.stripe.size", str(stripe_mb << 20)).option("orc.row.index.stride", str(index_stride)).option("compression", "zstd")
        .orc(folder)
    )


def read_token_orc(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(folder)


def token_spans(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids, from the files."""
    rows = read_token_orc(spark, folder)
    sums = rows.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    starts = F.broadcast(sums.select("range", F.coalesce(before, F.lit(0)).alias("before")))  # at most as many rows as shuffle partitions
    return rows.join(starts, "range").select("doc_id", (F.col("before") + F.col("range_start")).alias("start"), "n_tokens", "ids")


def span_checksums(spans: DataFrame) -> DataFrame:
    """The spans with ids_crc32 of the ids as little-endian unsigned 32-bit integers instead of the ids."""

    def work(batches):
        import zlib

        import pyarrow as pa

        for batch in batches:
            ids = batch.column(3)
            values, at = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), ids.offsets.to_pylist()
            sums = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
        give_back()

    return spans.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def find_tokens(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """Documents by id: the filter reaches the ORC reader, which prunes by statistics and Bloom filter."""
    return read_token_orc(spark, folder).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")
