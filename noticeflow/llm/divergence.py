"""Divergence of sources by their terms, on run-length columns.

The vocabulary of a language is ordered by its terms' counts in all sources, so
that equal counts stand together, and cut into blocks.  Within a block each
source's column of counts is a short list of runs; for a pair of sources the
bounds of both lists are merged, f is computed once a merged run and counted as
often as the run is long.  Sums of blocks are added by Spark.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm.shared import Scratch, give_back, shuffle_parts

SCALE = 1_000_000_000
#: Documents of a language that must hold a term, and ranks given out of a source's terms.
LEAST_DOCS, TOP = 3, 200
#: Terms of a block (a power of two).
BLOCK = 4096
#: Distinct terms that a task holds before it hands out their counts.
HELD = 300_000
#: A-Z are lower-cased, other characters of ASCII part terms, bytes of all others stay.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, in parts that are still to be added up."""

    def work(batches):
        from collections import Counter, defaultdict

        import pyarrow as pa

        names = ["lang", "source", "term", "n", "docs"]
        count, seen, held = defaultdict(Counter), defaultdict(Counter), 0

        def emit():
            for (lang, source), terms in count.items():
                keys, within = list(terms), seen[lang, source]
                columns = [pa.array([lang] * len(keys), pa.string()), pa.array([source] * len(keys), pa.string()), pa.array(keys, pa.string()), pa.array(list(terms.values()), pa.int64()), pa.array([within[k] for k in keys], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                terms = text.as_py().translate(LETTERS).split()
                own, within = count[lang, source], seen[lang, source]
                held -= len(own)
                own.update(terms)
                within.update(set(terms))
                held += len(own)
                if held >= HELD:
                    yield from emit()
                    count.clear()
                    seen.clear()
                    held = 0
        yield from emit()
        give_back()

    lang, source, text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    texts = docs.select(lang, source, text.cast("binary").alias("text"))
    return texts.mapInArrow(work, "lang string, source string, term string, n long, docs long")


def kept_terms(parts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, counts): terms in at least `least` documents, with their (source, n), ascending by source.

    One exchange, by language and term, serves both sums.
    """
    sums = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("counts"))
    return found.where(F.col("docs") >= least).select("lang", "term", "total", F.array_sort("counts").alias("counts"))


def in_blocks(kept: DataFrame) -> DataFrame:
    """The terms ordered by their counts, with their block; a block has at most BLOCK terms of a language."""
    order = ["lang", "counts", "term"]
    dealt = kept.repartitionByRange(shuffle_parts(kept.sparkSession), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the partition's number, and the row's place in it
    return dealt.withColumn("at", at).withColumn("block", F.shiftright("at", BLOCK.bit_length() - 1))


def run_lengths(places: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, counts) of the runs of a column that is 0 but at `places`."""
    column = np.zeros(length, np.int64)
    column[places] = counts
    starts = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
    return starts, column[starts]


def scaled(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """p of each count, in whole numbers of any size."""
    values, where = np.unique(counts, return_inverse=True)
    return np.array([1 + SCALE * (int(c) + 1) // (total + terms) for c in values], np.int64)[where]


def divergence(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], length: int) -> int:
    """Sum of f over a block, from two columns of runs (starts, p): once per run of the merged bounds, times its length."""
    starts = np.union1d(a[0], b[0])
    p = a[1][np.searchsorted(a[0], starts, "right") - 1]
    q = b[1][np.searchsorted(b[0], starts, "right") - 1]
    return int(((p - q) * (p - q) // q * np.diff(starts, append=length)).sum())


def pair_sums(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a language with kept terms.

    Each block of terms meets the few rows of its language's sources; p is below
    2**30 and the sum of a source's p at most SCALE and a term each, so that
    all sums fit 64 bits for up to 10**9 terms.
    """
    columns = terms.select("lang", "block", "at", F.explode("counts").alias("c")).select("lang", "block", "at", "c.source", "c.n")
    sources = terms.groupBy("lang", "block").agg(F.min("at").alias("first"), F.count("*").alias("length")).join(groups, "lang")
    sources = sources.toDF(*sources.columns)  # other columns than those of the same table on the left

    def work(left, right):
        import pandas as pd

        first, length = int(right["first"].iloc[0]), int(right["length"].iloc[0])
        at = {s: (g["at"].to_numpy() - first, g["n"].to_numpy()) for s, g in left.groupby("source")}
        none = np.zeros(0, np.int64)
        runs = {}
        for source, total, vocabulary in zip(right["source"], right["total_n"], right["terms"]):
            starts, counts = run_lengths(*at.get(source, (none, none)), length)
            runs[source] = starts, scaled(counts, int(total), int(vocabulary))
        rows = [(a, b, divergence(runs[a], runs[b], length)) for a in runs for b in runs if a != b]
        out = pd.DataFrame(rows, columns=["source", "item", "value"])
        return out.assign(lang=right["lang"].iloc[0])[["lang", "source", "item", "value"]]

    found = columns.groupBy("lang", "block").cogroup(sources.groupBy("lang", "block")).applyInPandas(work, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of a language lie apart.

    Terms are runs of letters (A-Z lower-cased) and characters beyond ASCII; a
    language keeps those in at least `least` of its documents.  A source's count
    of a term gives p = 1 + floor(SCALE * (count + 1) / (all counts + terms)),
    and f = floor((p - q)**2 / q) compares two.  Part `pair`: for each other
    source of the language the sum of f over all kept terms (0 without any).
    Part `term`: the source's own terms that it has more of than the language,
    the `top` with the largest f.  Ranks go by value, descending, then by item,
    bytewise.  Nulls are empty strings; empty and wordless texts still make
    their source occur; repeated rows count each; an empty table gives no rows.
    Columns besides text, lang and source, whatever their names, are not read.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    parts = scratch.save(kept_terms(count_terms(docs), least), "kept")
    terms = scratch.save(in_blocks(parts), "terms")
    scratch.drop("kept")
    own = terms.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("total_n"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_n"))
    occurring = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    zero = F.lit(0).cast("long")
    groups = occurring.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total_n", "terms", "lang_n"])
    groups = scratch.save(groups.select("lang", "source", "total_n", "terms", "lang_n"), "groups")

    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(pair_sums(terms, groups), ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", zero))
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(place).alias("rank"))

    scale = lambda count, total: F.expr(f"1 + cast({SCALE} as decimal(20, 0)) * ({count} + 1) div ({total} + terms)")
    counts = terms.select("lang", "term", "total", F.explode("counts").alias("c")).select("lang", "term", "total", "c.source", "c.n")
    rated = counts.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), scale("n", "total_n").alias("p"), scale("total", "lang_n").alias("q"))
    rated = rated.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    # Spark keeps the first rows of each group before it exchanges them
    best = rated.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return pairs.unionByName(best)
