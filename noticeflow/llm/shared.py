"""Scratch tables in the shared folder, skew-tolerant joins and key ranges."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.scratch import Scratch, shared_dir, spread_join  # noqa: F401


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Bits of an id filter at most (32 MB): its size never grows beyond this with the data.
FILTER_BITS = 1 << 28


class IdFilter:
    """A bounded bitmap of hashed ids: tells rows whose id is surely not in a table from those that may be.

    It is made of Spark's bitmap aggregates, of about 64 bits an id up to
    FILTER_BITS; beyond that it lets more rows through, and stays correct.  Its
    chunks, at most 8192 of 4 KB, are broadcast.
    """

    def __init__(self, ids: DataFrame, scratch: Scratch, name: str = "id-filter"):
        column = ids.columns[0]
        count, bits = ids.count(), 1 << 15
        while bits < 64 * count and bits < FILTER_BITS:
            bits *= 2
        self.bits = bits
        place = ids.select(self._place(column).alias("p"))
        chunks = place.groupBy(F.bitmap_bucket_number("p").alias("__nf_chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__nf_bits"))
        self.chunks = scratch.save(chunks, name)

    def _place(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.bits)) + 1

    def split(self, rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        """(rows that may be in the table, rows that are not)."""
        at = F.bitmap_bit_position(self._place(column))
        marked = rows.withColumns({"__nf_chunk": F.bitmap_bucket_number(self._place(column)), "__nf_at": at})
        joined = marked.join(F.broadcast(self.chunks), "__nf_chunk", "left")
        byte = F.conv(F.hex(F.expr("substring(__nf_bits, cast(__nf_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
        held = F.coalesce(F.getbit(byte, (F.col("__nf_at") % 8).cast("int")) == 1, F.lit(False))
        return joined.where(held).select(*rows.columns), joined.where(~held).select(*rows.columns)


def drop_ids(rows: DataFrame, ids: DataFrame, id_col: str, scratch: Scratch) -> DataFrame:
    """Rows whose id is not in `ids` (one column), by an exact anti-join of the few rows that the filter can't clear.

    The others, with all their texts, are never shuffled.
    """
    gone = ids.toDF("__nf_gone")
    maybe, sure = IdFilter(ids, scratch, "gone-filter").split(rows, id_col)
    return sure.unionByName(maybe.join(gone, maybe[id_col].eqNullSafe(gone["__nf_gone"]), "left_anti"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def range_of(key: str, bounds: list):
    """Range number of a key, ascending: the number of bounds below it; a null key goes to range 0.

    Two short looks, at every STEP-th bound and at those between, in the JVM.
    """
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    below = lambda values: F.size(F.filter(values, lambda b: b < F.col(key)))
    coarse = below(F.array(*map(F.lit, bounds[step - 1 :: step])))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)] + [[bounds[-1]]]
    fine = below(F.element_at(F.array(*[F.array(*map(F.lit, g)) for g in groups]), coarse + 1))
    whole = F.when(coarse * step >= len(bounds), F.lit(len(bounds))).otherwise(coarse * step + fine)
    return F.when(F.col(key).isNull(), F.lit(0)).otherwise(whole)


def ordered_ranges(rows: DataFrame, parts: int) -> tuple[Column, int]:
    """(number of a row's range, how many ranges there are), ascending by doc_id (null lowest), then descending by h.

    A doc_id with more than a range's share of the rows, or no doc_id, is parted
    by the hash h.
    """
    points = F.percentile_approx("doc_id", F.array(*[F.lit(i / parts) for i in range(1, parts)] or [F.lit(0.5)]), 20 * parts)
    found = rows.agg(points.alias("p"), F.count_if(F.col("doc_id").isNull()).alias("lone"), F.count("*").alias("n")).first()
    times = Counter(found["p"] or [])
    bounds = sorted(times)
    # a bound that comes m > 1 times has m ranges of its own besides that of the ids below it
    own = [times[b] if times[b] > 1 else 0 for b in bounds] + [0]
    lone = 1 + found["lone"] * parts // max(1, found["n"])
    base = [lone + i + sum(own[:i]) for i in range(len(own))]
    longs = lambda values: f"array({', '.join(f'{v}L' for v in values)})"
    place = range_of("doc_id", bounds).cast("int")
    at = lambda values: F.element_at(F.expr(longs(values)), place + 1)
    part = lambda m: m - 1 - F.floor(F.least((F.col("h") / F.lit(2.0**64) + 0.5) * m, m - 1))
    hot = (at(own) > 0) & (F.col("doc_id") == at([*bounds, 0]))
    number = F.when(F.col("doc_id").isNull(), part(F.lit(lone))).when(hot, at(base) + 1 + part(at(own))).otherwise(at(base))
    return number.cast("int"), base[-1] + own[-1] + 1


def deal_ranges(rows: DataFrame, parts: int, number: str = "range") -> DataFrame:
    """Shuffle rows so that each of `parts` range numbers has a partition of its own.

    Hashing the numbers themselves would put several into one partition; so each
    is dealt by a key that hashes to its own place.
    """
    spark = rows.sparkSession
    keys = spark.range(64 * parts).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("place")).groupBy("place").agg(F.min("id").alias("id"))
    found = {r["place"]: r["id"] for r in keys.collect()}  # one a partition
    key = F.element_at(F.array(*[F.lit(found.get(i, i)).cast("long") for i in range(parts)]), F.col(number) + 1)
    return rows.withColumn("__nf_key", key).repartition(parts, "__nf_key").drop("__nf_key")


def give_back() -> None:
    """Hand freed memory of this Python worker back to the system: workers outlive their tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
