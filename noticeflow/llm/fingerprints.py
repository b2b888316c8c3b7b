"""Document fingerprints by winnowing.

Every run of GRAM code points is hashed; of each WINDOW consecutive hashes the
least is chosen, the rightmost of equal ones, with its position.  Two texts that
share a passage of GRAM + WINDOW - 1 code points share a chosen hash.  Short
texts keep every run, of several lengths (SHORT_GRAMS), so that they share
hashes with an edit of themselves, too.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.shared import deal_ranges, give_back, ordered_ranges, shuffle_parts

GRAM, WINDOW = 16, 8
#: A text of n < 4 * GRAM code points keeps every run of each of these lengths g with g <= n < 4 * g.  As they double, one
#: of them is at most two thirds and more than a quarter of n: an edit that keeps two thirds of a text shares its runs.
SHORT_GRAMS = (2, 4, 8, GRAM)


def winnow(text: str, gram: int | None = None, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) chosen from a text, by position.

    Without `gram` runs are of GRAM code points, and a text of less than
    4 * GRAM keeps all its runs of SHORT_GRAMS (positions repeat then).  With a
    `gram` all texts have runs of that length, a shorter one is one run, and
    with fewer runs than a window there is one window.  An empty text has none.
    """
    if gram is None and 2 <= len(text) < 4 * GRAM:
        found = [winnow(text, g, 1) for g in SHORT_GRAMS if g <= len(text) < 4 * g]
        hashes, at = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(at, kind="stable")
        return hashes[order], at[order]
    gram = gram or GRAM
    from noticeflow.llm.text_arrays import mix, span_hashes

    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(points):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    gram = min(gram, len(points))
    starts = np.arange(len(points) - gram + 1)
    hashes = span_hashes(mix(points + np.uint64(0x5851F42D4C957F2D)), starts, starts + gram) >> np.uint64(32)
    # the position, counted from the end, breaks ties: the least key is the rightmost least hash
    low = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - starts.astype(np.uint64))
    width, reach = min(window, len(low)), 1
    while reach < width:
        step = min(reach, width - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    chosen = np.unique(low)
    at = (np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.int64)
    order = np.argsort(at)
    return (chosen >> np.uint64(32)).astype(np.uint32)[order], at[order]


def to_string(hashes: np.ndarray) -> str:
    """Distinct hashes, ascending, eight hexadecimal digits each."""
    return np.unique(hashes).astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sorted distinct hash arrays; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - both
    return both / total if total else 1.0


def fingerprint_documents(docs: DataFrame, gram: int | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, fingerprint, hashes, positions.

    hashes and positions are in order of position (a hash may occur again).
    Null counts as empty and has an empty fingerprint; equal texts have equal
    fingerprints; an empty table gives an empty result.
    """

    def work(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                found = [winnow(t, gram, window) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([to_string(h) for h, _ in found], pa.string()),
                        pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())),
                        pa.array([p for _, p in found], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_chars", "fingerprint", "hashes", "positions"],
                )
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, fingerprint string, hashes array<long>, positions array<long>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, schema)


def fingerprint_edits(docs: DataFrame, gram: int | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text with their positions, of its edit with the next document, and their likeness.

    positions are those of the hashes chosen from the text, in ascending order.

    The next document is the one before it by doc_id (the last one's is the
    first); the edit replaces the last floor(n/3) code points by as many first
    ones of the next text.  Texts move once: to ranges of doc_id, each with the
    first document of the following range as a guest.  Rows that repeat a doc_id
    are ordered by a hash of the text, by which a doc_id of very many rows takes
    several ranges, then by text; ids that are not numbers are an error; null texts are empty; a null doc_id comes last; a table
    of one row has itself as the next; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    number, count = ordered_ranges(rows, shuffle_parts(spark))
    placed = rows.withColumn("range", number)
    # the first document of each range, at most one a range
    top = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.bitwise_not("h").alias("below"))).alias("top")
    tops = {r["range"]: (r["top"]["doc_id"], ~r["top"]["below"]) for r in placed.groupBy("range").agg(top).collect()}
    order = sorted(tops, reverse=True)
    guests = [(*tops[r], order[(i - 1) % len(order)]) for i, r in enumerate(order)]
    guests = spark.createDataFrame(guests, "guest_id long, h long, range int")  # at most `count` rows
    first = rows.join(F.broadcast(guests), (rows["h"] == guests["h"]) & rows["doc_id"].eqNullSafe(guests["guest_id"]))
    first = first.groupBy(rows["doc_id"], rows["h"], "range").agg(F.min("text").alias("text"))
    both = placed.withColumn("guest", F.lit(0)).unionByName(first.withColumn("guest", F.lit(1)))
    dealt = deal_ranges(both, count).sortWithinPartitions(F.col("range"), F.col("guest"), F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("text"))

    def work(batches):
        import hashlib

        import pyarrow as pa

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int32())]
        out, held, last = [], 0, None

        def pair(now, after):
            doc_id, text, hashes = now[1:4]
            n = len(text)
            cut = n // 3
            edited = text[: n - cut] + after[2][:cut]
            other = np.unique(winnow(edited, gram, window)[0])
            return (
                doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), to_string(hashes), to_string(other),
                likeness(hashes, other), likeness(hashes, after[3]), now[4],
            )

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for batch in batches:
            for doc_id, text, number in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = text.as_py()
                hashes, at = winnow(text, gram, window)
                now = (number, doc_id, text, np.unique(hashes), at.astype(np.int32))
                if last is not None and last[0] == number:
                    out.append(pair(last, now))
                    held += len(text)
                last = now
                if len(out) >= 500 or held > 2_000_000:
                    yield emit()
                    out, held = [], 0
        if out:
            yield emit()
        give_back()

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>"
    return dealt.select("doc_id", "text", "range").mapInArrow(work, schema)
