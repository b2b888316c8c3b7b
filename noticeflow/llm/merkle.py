"""Merkle manifest of a dataset: one tree per group of rows, and one over the groups' roots.

Leaves are numbered by distributed ranges.  At each level, windows over blocks
of nodes give every node its siblings by lag and lead at fixed offsets, masked
by its slot and by the length of its run; the first node of a run hashes them
to the parent.  Each level is an eighth of the one below and is written once.
Proof paths come down again level by level, each joined to the one above by the
number of the run, at most FAN rows a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm.shared import Scratch, shuffle_parts, spread_join

FAN = 8
#: Nodes of a window (whole runs): what one task holds together, whatever the size of a group.
BLOCK = 512
#: The value of a null; others begin with their number of bytes.
NULL = "-"
PATH = "array<struct<left:binary,right:binary>>"


def digest(value: Column) -> Column:
    """The 32 bytes of sha256."""
    return F.unhex(F.sha2(value.cast("binary"), 256))


def as_text(value: Column) -> Column:
    """Digests as lower-case hexadecimal digits."""
    return F.lower(F.hex(value))


def row_digest(*values: str | Column) -> Column:
    """Digest of a row's values: each by its UTF-8 byte count, a colon and the value as text, or NULL."""
    texts = [(F.col(v) if isinstance(v, str) else v).cast("string") for v in values]
    return digest(F.concat(*[F.when(t.isNull(), NULL).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path of siblings lead to."""
    return F.aggregate(path, leaf, lambda node, step: digest(as_text(F.concat(step["left"], node, step["right"]))))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right; in hexadecimal."""
    return F.sha2(F.array_join(F.transform(path, lambda step: as_text(F.concat(step["left"], step["right"]))), "").cast("binary"), 256)


def number_rows(rows: DataFrame, group: str, order: list[str], scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """(rows with idx, from 0 in the order of their group, and n, the group's size; the largest n).

    Ranges of (group, order) are sorted on their own; their counts, at most one
    row a group and range, make the numbers.  Ties in `order` are numbered in
    any order, once: the ranges are written.
    """
    dealt = rows.repartitionByRange(shuffle_parts(rows.sparkSession), group, *order).sortWithinPartitions(group, *order)
    placed = scratch.save(dealt.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), name)
    counts = placed.groupBy(group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    whole = Window.partitionBy(group)
    before = F.sum("__n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(group, "__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(whole).alias("n"))
    starts = scratch.save(starts, f"{name}-starts")
    most = starts.agg(F.max("n")).first()[0] or 0
    numbered = placed.join(starts, [group, "__part"]).withColumn("idx", F.col("__at") + F.col("__shift"))
    return numbered.drop("__part", "__at", "__shift"), most


def with_siblings(nodes: DataFrame, group: str) -> DataFrame:
    """Nodes (group, idx, n, node) with the digests before and after them in their run: left, right."""
    block = Window.partitionBy(group, F.floor(F.col("idx") / BLOCK)).orderBy("idx")
    slot = F.col("idx") % FAN
    run = F.least(F.lit(FAN), F.col("n") - (F.col("idx") - slot))
    none = F.lit(b"")
    left = [F.when(slot >= k, F.lag("node", k).over(block)).otherwise(none) for k in range(FAN - 1, 0, -1)]
    right = [F.when(slot + k < run, F.lead("node", k).over(block)).otherwise(none) for k in range(1, FAN)]
    return nodes.withColumns({"left": F.concat(*left), "right": F.concat(*right)})


def parents(level: DataFrame, group: str) -> DataFrame:
    """The next level, hashed by the first node of each run."""
    up = digest(as_text(F.concat("node", "right"))).alias("node")
    return level.where(F.col("idx") % FAN == 0).select(group, (F.col("idx") / FAN).cast("long").alias("idx"), F.ceil(F.col("n") / FAN).alias("n"), up)


def trees(leaves: DataFrame, group: str, most: int, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(leaves with their path to the root of their group; group and node of the roots).

    `leaves` has group, idx, n and node, and columns that pass through; `most` is
    the largest n.  A lone leaf is the root and has an empty path.
    """
    levels, now = [], leaves
    while most > 1:
        levels.append(scratch.save(with_siblings(now.where("n > 1"), group), f"{name}-{len(levels)}"))
        now, most = parents(levels[-1], group), -(-most // FAN)
    roots = leaves.where("n = 1").select(group, "node")
    for level in levels:
        roots = roots.unionByName(parents(level.where(f"n <= {FAN}"), group).select(group, "node"))
    path = None
    for level in reversed(levels):
        own = level.withColumn("path", F.array(F.struct("left", "right"))).drop("left", "right")
        if path is None:
            path = own
            continue
        above = path.select(group, F.col("idx").alias("__up"), F.col("path").alias("__above"))
        low = own.where(f"n > {FAN}").withColumn("__up", (F.col("idx") / FAN).cast("long")).join(above, [group, "__up"])
        path = own.where(f"n <= {FAN}").unionByName(low.withColumn("path", F.concat("path", "__above")).drop("__up", "__above"))
    lone = leaves.where("n = 1").withColumn("path", F.array().cast(PATH))
    return (lone if path is None else lone.unionByName(path)), roots


def merkle_manifest(docs: DataFrame, columns: list[str], group_col: str = "lang", id_col: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: its id, node (the leaf), path, subroot, root, and the columns of `carry`.

    A leaf is the `row_digest` of `columns`.  Leaves of one value of `group_col`
    (null is a value, the first) ascend by id (null first), rows of one id by
    their digests; every FAN consecutive nodes make their parent until one is
    left, the subroot; subroots, ordered bytewise by the group's value, likewise
    make the root.  `fold(node, path)` leads to the root, for rows of any group.
    Digests are 32 bytes.  Rows repeated outright are leaves of their own; empty
    and very long texts are nothing special; an empty table gives an empty
    result.  Other columns, whatever their names, are not read.  Texts are read
    and hashed once and never shuffled.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    value = F.col(group_col).cast("string")
    group = F.when(value.isNull(), "").otherwise(F.concat(F.lit("="), value))
    found = docs.select(F.col(id_col).alias("__id"), group.alias("__group"), F.monotonically_increasing_id().alias("__row"), row_digest(*columns).alias("node"), *[c.alias(k) for k, c in (carry or {}).items()])
    found = scratch.save(found, "rows")
    leaves, most = number_rows(found, "__group", ["__id", "node", "__row"], scratch, "leaves")
    paths, subroots = trees(leaves.drop("__row"), "__group", most, scratch, "tree")
    # the tree over the groups: one row a group
    subroots = scratch.save(subroots.select(F.lit(0).alias("__all"), "__group", "node"), "subroots")
    tops, count = number_rows(subroots, "__all", ["__group"], scratch, "tops")
    tops, root = trees(tops, "__all", count, scratch, "top")
    root = root.first()
    tops = tops.select("__group", F.col("node").alias("subroot"), F.col("path").alias("__above"))
    both = spread_join(paths, tops, "__group").withColumn("path", F.concat("path", "__above"))
    return both.select(F.col("__id").alias(id_col), "node", "path", "subroot", F.lit(root and bytes(root["node"])).alias("root"), *(carry or {}))
