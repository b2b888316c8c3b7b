"""Compression classifier: how much better good than bad example text helps to compress a document.

Two zstandard dictionaries are built from good and from bad labelled text.  A
document is compressed with each; the difference of the two sizes, normalised
by their sum and by the text's length, goes through a logistic calibration that
is fitted on labelled documents the dictionaries have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.shared import Scratch, give_back

#: Labelled rows a class for fitting at most: half for the dictionaries, half for the calibration.
SAMPLE = 2000
#: Bytes of a dictionary at most, and of the pieces by which a text that exceeds its share of them is taken.
DICTIONARY_BYTES, PIECE_BYTES = 1 << 20, 256
LEVEL = 5
RIDGE = 0.02
THRESHOLD = 0.3


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> tuple[DataFrame, float | None]:
    """((doc_id, quality, half, text) of at most `sample` labelled ids a class, the labelled share of good ones).

    Never held-out ids.  Ids are drawn in the order of their hash and dealt to
    half 0 and 1 in turn.  Labels without an id or of other values than 0 and 1,
    and ids with both labels, count for nothing.  A null text is an empty one; of
    several rows with one doc_id the one with the least text is taken.  Without
    usable labels the share is null.
    """
    spark = docs.sparkSession
    usable = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out())
    usable = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").cast("int").alias("other")).where("quality = other").drop("other")
    counts = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    drawn = [usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas() for q in (0, 1)]
    ids = pd.concat([d.assign(half=np.arange(len(d)) % 2) for d in drawn])  # at most 2 * sample rows
    ids = spark.createDataFrame(ids, "doc_id long, quality int, half int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality", "half").agg(F.min("text").alias("text"))
    total = sum(counts.values())
    return scratch.save(rows, "sample"), counts.get(1, 0) / total if total else None


def shares(lengths: list[tuple], most: int = DICTIONARY_BYTES, piece: int = PIECE_BYTES) -> dict:
    """Bytes of a dictionary that each (id, bytes) may have: equal shares, where shorter texts leave theirs to longer ones.

    If there are more texts than pieces, the first by the hash of their id are
    taken; empty ones have none.
    """
    import zlib

    order = sorted(((zlib.crc32(str(i).encode()), i, n) for i, n in lengths if n), key=lambda r: (r[0], r[1]))[: max(1, most // (piece + 1))]
    share, room, left = most, most, len(order)
    for n in sorted(n + 1 for _, _, n in order):  # with its line feed
        share = room // left
        if n > share:
            break
        room, left = room - n, left - 1
    return {i: min(n + 1, share) for _, i, n in order}


def cut_to(raw: bytes, key: int, share: int, piece: int = PIECE_BYTES) -> bytes:
    """A text within its share whole, another by one piece of each of as many equal parts as its share has pieces.

    Where in the part, differs with the key.
    """
    if len(raw) + 1 <= share:
        return raw
    size = max(1, min(piece, share - 1))
    count = max(1, (share - 1) // size)
    part = len(raw) / count
    return b"".join(raw[(at := int(i * part + max(0.0, part - size) * (key * 0.618034 % 1))) : at + size] for i in range(count))


def build_dictionaries(rows: DataFrame, most: int = DICTIONARY_BYTES, piece: int = PIECE_BYTES) -> dict[int, bytes]:
    """A dictionary of at most `most` bytes for each quality of (doc_id, quality, text).

    Texts follow each other by the hash of their id, so that no range of ids is
    nearest to the end.  They are cut where they lie: the driver gets their
    lengths and then the dictionaries' bytes, never a whole long text.
    """
    import zlib

    lengths = rows.select("doc_id", "quality", F.octet_length("text").alias("n")).collect()
    plan = {q: shares([(r["doc_id"], r["n"]) for r in lengths if r["quality"] == q], most, piece) for q in (0, 1)}
    allowed = {i: share for q in plan for i, share in plan[q].items()}

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_pylist()
            cut = [cut_to(t.as_py().encode("utf-8", "surrogatepass"), zlib.crc32(str(i).encode()), allowed[i], piece) if i in allowed else b"" for i, t in zip(ids, batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cut, pa.binary())], ["doc_id", "quality", "raw"])

    pieces = rows.select("doc_id", "quality", "text").mapInArrow(work, "doc_id long, quality int, raw binary").where("octet_length(raw) > 0").collect()
    pieces = sorted(pieces, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    return {q: b"\n".join(bytes(r["raw"]) for r in pieces if r["quality"] == q) for q in (0, 1)}


def compressors(model: dict):
    import zstandard

    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    made = [zstandard.ZstdCompressionDict(model[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT) for k in ("good", "bad")]
    return [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, **plain) for d in made]


def sizes(texts, made) -> np.ndarray:
    """(size with the good dictionary, size with the bad one, bytes) of each text; null is empty."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return np.array([(*(len(c.compress(raw)) for c in made), len(raw)) for raw in raws], float).reshape(-1, 3)


def features(measured: np.ndarray) -> np.ndarray:
    """Terms of the normalised size difference, and the text's length, by which they are judged: a short text can't differ much."""
    good, bad, n = measured.T
    d, e, s = (bad - good) / (bad + good), (bad - good) / (n + 16), np.log1p(n) / 10
    return np.stack([d, e, d * s, e * s, d * d, e * e, d * e, d * s * s, e * s * s, s], axis=1)


def calibrate(x: np.ndarray, y: np.ndarray, share: float) -> dict:
    """Logistic regression by damped Newton steps with a small ridge; the classes weigh as they do among all labels."""
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread == 0] = 1.0
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    loss = lambda w: (weight * (np.logaddexp(0, z @ w) - y * (z @ w))).sum() + RIDGE / 2 * w @ w
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        gradient = z.T @ (weight * (p - y)) + RIDGE * w
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + RIDGE * np.eye(len(w)), gradient)
        scale = 1.0
        while scale > 1e-6 and loss(w - scale * step) > loss(w):
            scale /= 2
        w = w - scale * step
    return {"weights": w, "mean": mean, "spread": spread}


def scores(texts, model: dict, made) -> np.ndarray:
    x = (features(sizes(texts, made)) - model["mean"]) / model["spread"]
    return 1 / (1 + np.exp(-np.clip(model["weights"][0] + x @ model["weights"][1:], -40, 40)))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = DICTIONARY_BYTES) -> dict:
    """Dictionaries from one half of a bounded sample of labelled rows, calibration on the other.

    Without labelled documents of both classes in both halves every score is the
    labelled share of good ones (0.5 without any label).
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows, share = labelled_sample(docs, labels, scratch, sample)
    made = build_dictionaries(rows.where("half = 0"), most)
    model: dict = {"share": 0.5 if share is None else share, "weights": None, "good": made[1], "bad": made[0]}
    if not made[0] or not made[1]:
        return model
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        import pyarrow as pa

        ready = compressors(sent.value)
        for batch in batches:
            good, bad, n = sizes(batch.column(1).to_pylist(), ready).T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(good), pa.array(bad), pa.array(n)], ["quality", "good", "bad", "n"])

    seen = rows.where("half = 1").select("quality", "text").mapInArrow(work, "quality int, good double, bad double, n double").toPandas()  # at most `sample` rows
    scratch.drop("sample")
    seen = seen.sort_values(list(seen.columns))
    y = seen["quality"].to_numpy(float)
    if len(set(y)) < 2:
        return model
    return model | calibrate(features(seen[["good", "bad", "n"]].to_numpy(float)), y, model["share"])


def score_quality(docs: DataFrame, model: dict, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row, from its whole text alone.

    Null texts count as empty; a null doc_id is scored, and not held out;
    repeated rows score alike; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        import pyarrow as pa

        model = sent.value
        made = compressors(model) if model["weights"] is not None else None
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                score = np.full(batch.num_rows, model["share"]) if made is None else scores(batch.column(1).to_pylist(), model, made)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The input's rows and columns without the documents whose score is below the threshold.

    Labels that no classifier can be fitted on, too few or of one class, reject
    nothing.  Rows go by their text alone: a null text is an empty one, a null
    or repeated doc_id is nothing special, an empty table stays empty.
    """
    model = fit_quality(docs, labels)
    if model["weights"] is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(slices: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = compressors(sent.value)  # once a task
        for texts in slices:
            yield pd.Series(scores(texts, sent.value, made))

    return docs.where(score(F.col("text")) >= threshold)
