"""Best-fit packing by length patterns: non-negative least squares on the length histogram.

The histogram has at most `capacity` entries whatever the corpus holds, so the
plan is made on the driver: few-document patterns that fill a sequence exactly
are enumerated, their repeat counts fitted to the histogram by non-negative
least squares and rounded, and what they leave is packed best-fit in decreasing
length, on counts.  Of several roundings the one with the fewest sequences is taken.  Spark ranks the pieces of each length and looks
their places up in the plan.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm.shared import Scratch, give_back, shuffle_parts

#: Patterns that are fitted at most, chosen evenly from all: several for each length, so that their counts can meet any
#: histogram, while the plan stays small (about 4 MB) whatever the corpus holds.  What they leave is packed best-fit.
MOST_PATTERNS = 20_000


def enumerate_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All patterns of one to three of the given lengths that sum to the capacity: rows of three, 0 for none."""
    have = np.zeros(capacity + 1, bool)
    have[lengths[lengths <= capacity]] = True
    have[0] = False
    big = lengths[:, None]
    small = lengths[None, :]
    rest = capacity - big - small
    ok = (small <= big) & (rest >= 0) & (rest <= small)
    i, j = np.nonzero(ok)
    third = capacity - lengths[i] - lengths[j]
    ok = (third == 0) | have[third]
    triples = np.stack([lengths[i][ok], lengths[j][ok], third[ok]], axis=1)
    if have[capacity]:
        triples = np.concatenate([triples, [[capacity, 0, 0]]])
    return triples


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeat counts x that minimise ||A x - histogram||, by accelerated projected gradient steps."""
    size, n = len(histogram), len(patterns)
    rows, columns = patterns.ravel(), np.repeat(np.arange(n), 3)
    use = rows > 0
    rows, columns = rows[use], columns[use]

    def forward(x):
        return np.bincount(rows, x[columns], size)

    def back(r):
        return np.bincount(columns, r[rows], n)

    v = np.ones(n)
    norm = 1.0
    for _ in range(15):  # the largest eigenvalue of A'A gives the step
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (1.05 * norm)
    x = np.zeros(n)
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(forward(y) - histogram))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, t = new + (t - 1) / after * (new - x), after
        x = new
    return x


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing on counts: sequences (tuples of lengths) and how often each is used."""
    open_: dict[int, Counter] = defaultdict(Counter)  # room left -> sequences with it
    for length in sorted((k for k, c in counts.items() if c), reverse=True):
        left = counts[length]
        while left:
            room = next((r for r in sorted(open_) if r >= length and open_[r]), None)
            if room is None:
                each = capacity // length
                full, more = divmod(left, each)
                if full:
                    open_[capacity - each * length][(length,) * each] += full
                if more:
                    open_[capacity - more * length][(length,) * more] += 1
                left = 0
                continue
            held, n = next(iter(open_[room].items()))
            fit = room // length
            take = min(n, -(-left // fit))
            for placed, m in ((fit, min(take, left // fit)), (left - fit * (take - 1), take - min(take, left // fit))):
                if m:
                    open_[room - placed * length][held + (length,) * placed] += m
                    left -= placed * m
            open_[room][held] -= take
            if not open_[room][held]:
                del open_[room][held]
            if not open_[room]:
                del open_[room]
    total: Counter = Counter()
    for sequences in open_.values():
        total.update(sequences)
    return total


#: How fitted counts become whole: the nearest number but one at least, the nearest, or the whole part of this share of them.
ROUNDINGS = (lambda x: max(1, round(x)), round, int, lambda x: int(0.9 * x), lambda x: int(0.5 * x))


def plan_patterns(histogram: dict[int, int], capacity: int, most: int = MOST_PATTERNS) -> Counter:
    """Sequences (tuples of lengths) and how often each is used; they use up the histogram.

    Every pattern fills its sequence exactly, but taking many of them may leave
    a residue that packs badly.  So the fitted counts are rounded in several
    ways, in descending order and as far as pieces are left, each residue is
    packed best-fit, and the plan with the fewest sequences is taken (of equal
    ones that in which patterns place more).
    """
    whole = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        whole[length] = n
    lengths = np.flatnonzero(whole)
    patterns = enumerate_patterns(lengths, capacity) if len(lengths) else np.zeros((0, 3), np.int64)
    if len(patterns) > most:
        patterns = patterns[np.linspace(0, len(patterns) - 1, most).astype(int)]
    if not len(patterns):
        return best_fit({int(k): int(whole[k]) for k in lengths}, capacity)
    fitted = fit_counts(patterns, whole.astype(float))
    order = [k for k in np.argsort(-fitted, kind="stable").tolist() if fitted[k] > 0]
    shapes = {k: tuple(int(x) for x in patterns[k] if x) for k in order}
    best = None
    for rounding in ROUNDINGS:
        left, plan = whole.tolist(), Counter()
        for k in order:
            wanted = rounding(float(fitted[k]))
            times = min(wanted, *(left[x] // m for x, m in Counter(shapes[k]).items())) if wanted else 0
            if times:
                plan[shapes[k]] += times
                for x in shapes[k]:
                    left[x] -= times
        plan.update(best_fit({k: n for k, n in enumerate(left) if n}, capacity))
        if best is None or sum(plan.values()) < sum(best.values()):
            best = plan
    return best


def slot_table(plan: Counter) -> list[tuple]:
    """(length, low, high, first sequence, pieces a sequence, offset): pieces ranked low..high-1 of a length go here."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for pattern, times in plan.items():
        offset = 0
        for length, m in Counter(pattern).items():
            rows.append((length, used[length], used[length] + m * times, sequence, m, offset))
            used[length] += m * times
            offset += m * length
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int, order: list[str], most: int = MOST_PATTERNS) -> DataFrame:
    """Give every row of `pieces` (column length, 1 to capacity) a sequence_id and an offset; at most `most` patterns are fitted.

    Each length is ranked in parts dealt by the `order` columns, so a length
    that a third of all rows have is no single group.  Other columns pass
    through.  An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    by_length = defaultdict(list)
    for length, *slot in slot_table(plan_patterns(histogram, capacity, most)):
        by_length[length].append(tuple(slot))
    # at most `capacity` rows and three slots a pattern: small enough to send to every executor, whatever the corpus holds
    tables = F.broadcast(spark.createDataFrame(list(by_length.items()), "length long, __slots array<struct<low:long,high:long,first:long,each:long,at:long>>"))
    parts = 4 * shuffle_parts(spark)
    dealt = pieces.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("length", "__part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "__part", F.coalesce(before, F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("length", "__part").orderBy(*order)) - 1
    ranked = dealt.withColumn("__place", place).join(starts, ["length", "__part"]).withColumn("__rank", F.col("__start") + F.col("__place"))
    # the intervals of a length are one array: one lookup a row instead of a range join
    found = ranked.join(tables, "length").withColumn(
        "__slot", F.element_at(F.filter("__slots", lambda s: (s["low"] <= F.col("__rank")) & (F.col("__rank") < s["high"])), 1)
    )
    at = F.col("__rank") - F.col("__slot.low")
    sequence = F.col("__slot.first") + F.floor(at / F.col("__slot.each"))
    offset = F.col("__slot.at") + F.pmod(at, F.col("__slot.each")) * F.col("length")
    return found.withColumns({"sequence_id": sequence.cast("long"), "offset": offset.cast("long")}).select(*pieces.columns, "sequence_id", "offset")


def cut_documents(docs: DataFrame, path: str, end_id: int, capacity: int, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise whole texts and cut longer ones: doc_id, piece, start, length, ids_crc32, ids (null unless asked for).

    A document longer than the capacity is cut into pieces of the capacity, of
    which the first may be shorter.  A null or empty text is its end id alone.
    """

    def work(batches):
        import zlib

        import pyarrow as pa

        from noticeflow.llm.tokens import encoder

        enc = encoder(path)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        for batch in batches:
            for first, last, tokens, at in enc.encode_batch(batch.column(1), (end_id,)):
                n = np.diff(at)
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(last - first), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = (n - 1) % capacity + 1
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                begin = at[doc] + start  # the pieces follow each other in the tokens
                sums = [zlib.crc32(tokens[i : i + k]) for i, k in zip(begin.tolist(), length.tolist())]
                lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(tokens)).astype(np.int32)), pa.array(tokens.view(np.int32)))
                columns = [
                    batch.column(0)[first:last].take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)),
                    pa.array(length.astype(np.int64)), pa.array(sums, pa.int64()), lists if ids else pa.nulls(len(doc), lists.type),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids array<int>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, schema)


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 2048, ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack whole documents; one row per piece (see cut_documents and pack).

    Rows that repeat a doc_id are packed as documents of their own; columns
    besides doc_id and text are not read; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.save(cut_documents(docs, path, end_id, capacity, ids), "pieces")
    # rows of one doc_id and length are told apart by what they hold: equal ones may change places
    return pack(pieces, capacity, ["doc_id", "piece", "start", "ids_crc32"])
