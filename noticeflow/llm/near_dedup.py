"""Circulant MinHash near-deduplication with banding and exact Jaccard verification.

Two permutations make the whole signature: the first spreads shingles over
[0, BINS), the second is an explicit table that coordinate k reads circularly
shifted by k, so the coordinates of a shingle are one contiguous slice of it.

Plan: equal shingle sets collapse to one representative; representatives that
share a band go through (1) a star round, in which every bucket draws its own
leader, and (2) a block round for buckets whose members are still in several
components: members are dealt into blocks and pairs of blocks compare their full
sets by matrix products, giving out only true links between components.  No
round lists the pairs of a bucket, and no bucket is cut off.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.graph import connected_components
from noticeflow.llm.shared import IdFilter, Scratch, drop_ids, give_back, shuffle_parts, spread_join

BINS = 1 << 22
#: Members and shingles of a block, about; a bucket of b blocks is compared in b * b / 2 pairs of blocks.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: A signature estimate this far below the threshold drops a candidate (over four standard errors at 140 coordinates).
SLACK = 0.13


@lru_cache(1)
def _table(width: int) -> np.ndarray:
    second = np.random.default_rng(7).permutation(BINS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([second[-(width - 1) :], second]), width)


def signature(hashes: np.ndarray, width: int) -> np.ndarray:
    """Circulant MinHash of a non-empty shingle set."""
    table = _table(width)
    at = ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 22)).astype(np.int64)
    best = None
    for i in range(0, len(at), 2048):
        low = table[at[i : i + 2048]].min(axis=0)
        best = low if best is None else np.minimum(best, low)
    return best


def band_plan(percent: int) -> tuple[int, int]:
    """(bands, rows): a pair at the threshold is missed by all bands with a chance of about 1e-5."""
    rows = 6 if percent >= 85 else 5 if percent >= 80 else 4 if percent >= 70 else 3
    share = (percent / 100) ** rows
    return int(np.ceil(np.log(1.2e-5) / np.log(1 - share))), rows


def _row_key(id_col: str, text_col: str):
    """64-bit hash of a row's id and text: the number of a row, also where ids are null or repeat."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def _signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    def work(batches):
        import hashlib

        import pyarrow as pa

        from noticeflow.llm.text_arrays import mix, shingle_sets

        for batch in batches:
            ids, counts, keys, band_keys, short = batch.column(0), [], [], [], []
            for found in shingle_sets(batch.column(1), shingle):
                counts.append(len(found))
                if not len(found):
                    keys.append(None)
                    band_keys.append(None)
                    short.append(None)
                    continue
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                sig = signature(found, bands * rows)
                h = np.zeros(bands, np.uint64)
                for r in range(rows):
                    h = mix(h * np.uint64(3) + sig[r::rows].astype(np.uint64))
                band_keys.append(mix(h + np.arange(1, bands + 1, dtype=np.uint64)).view(np.int64))
                short.append(sig.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column(2), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(band_keys, pa.list_(pa.int64())), pa.array(short, pa.binary())],
                ["doc_id", "row_key", "n_shingles", "set_key", "bands", "sig"],
            )
        give_back()

    schema = "doc_id long, row_key long, n_shingles long, set_key binary, bands array<long>, sig binary"
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _row_key(id_col, text_col).alias("row_key"))
    return texts.mapInArrow(work, schema)


def _sets(docs: DataFrame, wanted: IdFilter, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(rep, items): the full shingle sets of the representatives in `wanted` (column rep), and of a few more.

    Made where the texts are read: a bounded id filter passes over the others, so no text is shuffled.
    """

    def work(batches):
        import pyarrow as pa

        from noticeflow.llm.text_arrays import shingle_sets

        for batch in batches:
            items = [x.tobytes() for x in shingle_sets(batch.column(1), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.binary())], ["rep", "items"])
        give_back()

    texts = docs.select(_row_key(id_col, text_col).alias("rep"), F.col(text_col).alias("text"))
    return wanted.split(texts, "rep")[0].mapInArrow(work, "rep long, items binary")


def _matrix(signatures) -> np.ndarray:
    """Short signatures of an Arrow array, one a row."""
    return np.frombuffer(b"".join(signatures.to_pylist()), np.uint8).reshape(len(signatures), -1)


def _estimates(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow the threshold."""
    left = nodes.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    right = nodes.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    near = spread_join(spread_join(pairs, left, "a"), right, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                same = (_matrix(batch.column(2)) == _matrix(batch.column(3))).mean(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(same >= percent / 100 - SLACK))

    return near.select("a", "b", "sig_a", "sig_b").mapInArrow(work, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on full sets."""
    left = sets.select(F.col("rep").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("items").alias("y"))

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return spread_join(spread_join(pairs, left, "a"), right, "b").select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def _blocks(rows, shingles):
    """Blocks of a bucket: none has many more than BLOCK members or BLOCK_SHINGLES shingles."""
    return F.ceil(F.greatest(rows / F.lit(float(BLOCK)), shingles / F.lit(float(BLOCK_SHINGLES)))).cast("int")


def _merged(members: DataFrame) -> DataFrame:
    """Merge open buckets of one dominant component where that is less work: (bucket, blocks, rep, comp).

    The bands of one large group give many buckets of nearly the same members.
    Their union, once, compares every pair that any of them holds; it is taken
    where its square is less than the sum of theirs.
    """
    counts = members.groupBy("bucket", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("w"))
    main = counts.groupBy("bucket").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.sum("k").cast("double").alias("m"), F.sum("w").alias("w"))
    tagged = spread_join(members, main.select("bucket", "main", _blocks(F.col("m"), F.col("w")).alias("blocks")), "bucket")
    union = tagged.select("main", "rep", "comp", "n").distinct()
    cost = main.groupBy("main").agg(F.sum(F.col("m") * F.col("m")).alias("apart"))
    sizes = union.groupBy("main").agg(F.count("*").cast("double").alias("u"), F.sum("n").alias("w")).join(cost, "main").withColumn("join", F.col("u") * F.col("u") < F.col("apart"))
    whole = spread_join(union, sizes.where("join").select("main", _blocks(F.col("u"), F.col("w")).alias("blocks")), "main")
    whole = whole.select(F.xxhash64("main", F.lit("merged")).alias("bucket"), "blocks", "rep", "comp")
    apart = spread_join(tagged, sizes.where("NOT join").select("main"), "main").select("bucket", "blocks", "rep", "comp")
    return whole.unionByName(apart)


def _block_pairs(members: DataFrame) -> DataFrame:
    """Deal (bucket, blocks, rep, comp) into pairs of blocks: (bucket, rep, comp, i, j, block of the member)."""
    block = F.pmod(F.xxhash64("rep", "bucket"), F.col("blocks").cast("long")).cast("int")
    dealt = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("bucket", "rep", "comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")


def _by_block_pair(rows: DataFrame):
    """Groups of block pairs over all shuffle partitions: their work is the square of their size, so AQE must not put them together by bytes."""
    keys = ["bucket", "i", "j"]
    return rows.repartition(shuffle_parts(rows.sparkSession), *keys).groupBy(*keys)


def _survivors(dealt: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Members of block pairs that some member of another component may match, by size and signature."""
    rows = spread_join(dealt, nodes.select("rep", "n", "sig"), "rep")

    def work(pdf):
        sig, n = np.stack([np.frombuffer(x, np.uint8) for x in pdf["sig"]]), pdf["n"].to_numpy()
        comp, block = pdf["comp"].to_numpy(), pdf["block"].to_numpy()
        own = (pdf["i"] == pdf["j"]).iloc[0]
        hit = np.zeros(len(pdf), bool)
        for k in range(len(pdf)):
            might = (comp != comp[k]) & (100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k]))
            if not own:
                might &= block != block[k]
            at = np.flatnonzero(might)
            hit[k] = len(at) > 0 and bool(((sig[at] == sig[k]).mean(axis=1) >= percent / 100 - SLACK).any())
        return pdf.loc[hit, ["bucket", "i", "j", "rep", "comp", "block"]]

    return _by_block_pair(rows).applyInPandas(work, "bucket long, i int, j int, rep long, comp long, block int")


def _block_links(survivors: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of different components, from full sets, one spanning link per pair of components and block pair."""
    rows = spread_join(survivors, sets, "rep")

    def work(pdf):
        import pandas as pd

        comp, reps = pdf["comp"].to_numpy(), pdf["rep"].to_numpy()
        lists = [np.frombuffer(x, np.uint64) for x in pdf["items"]]
        n = np.array([len(x) for x in lists])
        values, column, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        shared = np.cumsum(times > 1) - 1
        owner = np.repeat(np.arange(len(lists)), n)
        use = times[column] > 1
        owner, column = owner[use], shared[column[use]]
        both = np.zeros((len(lists), len(lists)))
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        width = 4096
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [start, start + width])
            dense = np.zeros((len(lists), width), np.float32)
            dense[owner[a:b], column[a:b] - start] = 1
            both += dense @ dense.T
        both = both.astype(np.int64)
        linked = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (comp[:, None] != comp[None, :])
        x, y = np.nonzero(np.triu(linked))
        out = pd.DataFrame({"a": np.minimum(reps[x], reps[y]), "b": np.maximum(reps[x], reps[y]), "p": np.minimum(comp[x], comp[y]), "q": np.maximum(comp[x], comp[y])})
        return out.drop_duplicates(["p", "q"])[["a", "b"]]

    return _by_block_pair(rows).applyInPandas(work, "a long, b long")


def near_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A & B| >= percent * |A | B| over their sets
    of word shingles; component_id is the smallest doc_id reachable over links.
    Null, empty and wordless texts have an empty set and are linked with nothing;
    a text of fewer words than a shingle is one shingle.  One row of a component
    is kept: one with its smallest doc_id.  Rows that repeat a doc_id with
    different texts are judged apart, and so are rows without a doc_id (a
    component of such rows only has a null component_id); only rows repeated
    outright, id and text, are kept together.  An empty table gives an empty
    result; columns besides id and text are not read.
    """
    return near_rows(docs, shingle, percent, id_col, text_col).drop("row_key")


def near_rows(docs: DataFrame, shingle: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`near_dedup` with the row_key of each row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    bands, rows = band_plan(percent)
    wide = scratch.save(_signatures(docs, id_col, text_col, shingle, bands, rows), "signatures")
    found = scratch.save(wide.select("doc_id", "row_key", "n_shingles", "set_key"), "keys")
    sets_of = found.where("n_shingles > 0")
    first = [F.first(c).alias(c) for c in ("bands", "sig")]
    # a set's row to keep has its smallest id; the row's key is the set's node
    best = F.min(F.struct(F.col("doc_id").isNull().alias("lone"), "doc_id", F.col("row_key").alias("rep"))).alias("best")
    groups = wide.where("n_shingles > 0").groupBy("set_key").agg(best, F.first("n_shingles").alias("n"), *first)
    groups = scratch.save(groups.select("set_key", "best", "best.rep", "n", "bands", "sig"), "groups")
    scratch.drop("signatures")
    nodes = groups.select("rep", "n", "sig")
    entries = groups.select("rep", "n", F.explode("bands").alias("bucket"))

    # star round: each bucket draws a leader, every member is checked against it
    drawn = F.min(F.struct(F.xxhash64("rep", "bucket").alias("h"), "rep")).alias("leader")
    crowded = scratch.save(
        entries.groupBy("bucket").agg(drawn, F.count("*").alias("size")).where("size > 1").select("bucket", F.col("leader.rep").alias("leader")), "buckets"
    )
    members = scratch.save(spread_join(entries, crowded, "bucket"), "members")
    pairs = members.where("rep <> leader").select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
    candidates = scratch.save(_estimates(pairs, nodes, percent), "candidates")
    scratch.drop("buckets")
    ends = candidates.select(F.col("a").alias("rep")).union(candidates.select("b")).distinct()
    sets = scratch.save(_sets(docs, IdFilter(ends, scratch, "ends"), id_col, text_col, shingle), "sets").dropDuplicates(["rep"])
    links = scratch.save(_verified(candidates, sets, percent), "links")
    scratch.drop("sets", "candidates")
    stars = scratch.save(connected_components(links, scratch, "star-cc"), "stars")

    # block round: buckets that still hold several components
    placed = members.join(stars.withColumnRenamed("node", "rep"), "rep", "left").select(
        "bucket", "rep", "n", F.coalesce("component", "rep").alias("comp")
    )
    state = F.min("comp") != F.max("comp")
    mark = F.expr("bit_xor(xxhash64(rep))").alias("content")
    open_buckets = placed.groupBy("bucket").agg(state.alias("open"), mark, F.count("*").alias("m")).where("open")
    # buckets of several bands often hold the same members: one of them is enough
    open_buckets = scratch.save(open_buckets.groupBy("content", "m").agg(F.min("bucket").alias("bucket")).select("bucket"), "open")
    unsettled = scratch.save(spread_join(placed, open_buckets, "bucket"), "unsettled")
    dealt = _block_pairs(_merged(unsettled))
    left = scratch.save(_survivors(dealt, nodes, percent), "survivors")
    more_sets = scratch.save(_sets(docs, IdFilter(left.select("rep").distinct(), scratch, "left"), id_col, text_col, shingle), "more-sets").dropDuplicates(["rep"])
    more = scratch.save(_block_links(left, more_sets, percent), "more-links")
    joined = connected_components(links.unionByName(more), scratch, "all-cc") if not more.isEmpty() else stars

    # of a component, the row with the smallest id stays
    homes = groups.select("set_key", "best", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    homes = scratch.save(homes.select("set_key", "best", F.coalesce("component", "rep").alias("component")), "homes")
    least = homes.groupBy("component").agg(F.min("best").alias("least"))
    label = spread_join(homes.select("set_key", "component"), least, "component")
    label = label.select("set_key", F.col("least.doc_id").alias("component_id"), F.col("least.rep").alias("keep_key"))
    linked = spread_join(sets_of, scratch.save(label, "labels"), "set_key").withColumn("kept", F.col("row_key") == F.col("keep_key"))
    alone = found.where("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "kept": F.lit(True)})
    names = ["doc_id", "row_key", "n_shingles", "component_id", "kept"]
    return linked.select(*names).unionByName(alone.select(*names))


def keep_one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns without the rows that repeat another of their component.

    Rows go by their own key, never by their id, so rows with null or repeated
    ids are judged each by itself; of rows repeated outright one stays.  Rows
    with an empty shingle set (null, empty or wordless texts) all stay.  Columns
    of any name pass through; an empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "near-kept")
    rows = scratch.save(near_rows(docs, shingle, percent, id_col, text_col).select("row_key", "n_shingles", "kept"), "rows")
    keyed = docs.withColumn("__nf_key", _row_key(id_col, text_col))
    stay = drop_ids(keyed, scratch.save(rows.where("NOT kept").select("row_key").distinct(), "gone"), "__nf_key", scratch)
    again = rows.where("kept AND n_shingles > 0").groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").select("row_key")
    again = scratch.save(again, "again")
    if not again.isEmpty():
        maybe, sure = IdFilter(again, scratch, "again-filter").split(stay, "__nf_key")
        repeats = maybe.join(again, maybe["__nf_key"] == again["row_key"], "left_semi").dropDuplicates(["__nf_key"])
        others = maybe.join(again, maybe["__nf_key"] == again["row_key"], "left_anti")
        stay = sure.unionByName(others).unionByName(repeats)
    return stay.drop("__nf_key")
