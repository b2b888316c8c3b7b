"""Similarity joins on token sets and leader clustering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.functions.text import fallback_label, normalize_company, tokens
from noticeflow.graph import connected_components
from noticeflow.scratch import Scratch, spread_join

DEFAULT_FIELDS = ["excavator_name", "work_type", "location_text"]


#: Rows of a block of a token's list: a token that m rows hold in their prefixes is joined in (m / BLOCK)**2 / 2 pairs of blocks.
BLOCK = 2000
#: Undecided rows that one task settles at most.
LOCAL_ROWS = 4096
#: Edges of a component of undecided rows that one task settles at most.
LOCAL_EDGES = 1 << 20


def plain_set(items: str | Column) -> Column:
    """An array's distinct tokens in ascending order, without nulls; a null array is an empty one."""
    items = F.col(items) if isinstance(items, str) else items
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(items, F.array().cast("array<string>")))))


def _signature(items: str, half: int) -> Column:
    """64 of 128 bits, of which each token of a set sets one: sets differ in at least as many tokens as their bits differ."""
    bit = "cast(pmod(xxhash64(x), 128) as int)"
    return F.expr(f"aggregate({items}, 0L, (a, x) -> a | if({bit} div 64 = {half}, shiftleft(1L, {bit} % 64), 0L))")


def _prefixes(sets: DataFrame, key: str, items: str, threshold: float) -> DataFrame:
    """(k, s, n, p, b0, b1, r, t): for each of a set's rarest tokens t, which p lists, its place r and all of the set, in order of rarity, with its bits."""
    rows = sets.select(F.col(key).alias("k"), plain_set(items).alias("s")).where(F.size("s") > 0)
    flat = rows.select("k", F.explode("s").alias("t"))
    frequency = flat.groupBy("t").agg(F.count("*").alias("f"))
    # one shuffle puts a set together again, with its tokens from rare to common
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("f", "t"))), lambda x: x["t"])
    ranked = spread_join(flat, frequency, "t").groupBy("k").agg(ordered.alias("s")).withColumns({"n": F.size("s"), "b0": _signature("s", 0), "b1": _signature("s", 1)})
    keep = (F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1).cast("int")
    return ranked.withColumn("p", F.slice("s", F.lit(1), keep)).select("*", F.posexplode("p").alias("r", "t"))


def _block_pairs(entries: DataFrame) -> DataFrame:
    """Entries with their block `own` of the token's list, once for each pair (i, j) of blocks it is in; tokens of one entry are left out."""
    blocks = entries.groupBy("t").agg(F.ceil(F.count("*") / F.lit(float(BLOCK))).cast("int").alias("blocks"), F.count("*").alias("m")).where("m > 1").drop("m")
    dealt = spread_join(entries, blocks, "t").withColumn("own", F.pmod(F.xxhash64("k", "t"), F.col("blocks").cast("long")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")


def jaccard_pairs(sets: DataFrame, key: str, items: str, threshold: float) -> DataFrame:
    """(a, b, jaccard) of all pairs a < b of rows whose distinct non-empty token arrays have Jaccard >= threshold > 0.

    Prefix filter: two such sets share one of the rarest n - ceil(t*n) + 1 tokens
    of each, so only those are joined.  Sizes, the places of the shared token and
    the bits in which the sets' signatures differ bound the overlap before sets
    are compared, and a pair is taken at the first token that both prefixes hold,
    so it comes out once.  The list of a token that very many rows hold is dealt
    into blocks, of which every pair meets in a task of its own.  `key` must be
    unique; null tokens are none; rows without tokens are in no pair.
    """
    scratch = Scratch(sets.sparkSession, "jaccard")
    entries = scratch.save(_prefixes(sets, key, items, threshold), "prefixes")
    dealt = _block_pairs(entries)
    a, b = (dealt.select("t", "i", "j", *[F.col(c).alias(f"{c}{x}") for c in ("own", "k", "s", "n", "p", "r", "b0", "b1")]) for x in "ab")
    total = F.col("na") + F.col("nb")
    least = F.ceil(F.lit(threshold / (1 + threshold)) * total - 1e-9)
    apart = F.bit_count(F.expr("b0a ^ b0b")) + F.bit_count(F.expr("b1a ^ b1b"))
    fits = (
        (F.col("ka") < F.col("kb")) & ((F.col("i") == F.col("j")) | (F.col("owna") != F.col("ownb")))
        & (F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb")) >= least)  # the shared token and what follows it
        & (total - apart >= 2 * least)
        & (F.col("t") == F.try_element_at(F.array_intersect("pa", "pb"), F.lit(1)))
    )
    both = F.size(F.array_intersect("sa", "sb"))
    pairs = a.join(b, ["t", "i", "j"]).where(fits)
    return pairs.select(F.col("ka").alias("a"), F.col("kb").alias("b"), (both / (total - both)).alias("jaccard")).where(F.col("jaccard") >= threshold)


def similar_groups(sets: DataFrame, key: str, items: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(pairs of representatives (a, b, jaccard), membership (key, representative)): `jaccard_pairs` without listing equal sets.

    Equal sets have one representative, the smallest key, so a crowd of equal
    rows is as many rows of the membership and no pair; two rows are alike
    exactly if their representatives are the same or a pair.  Rows without
    tokens are in no group.
    """
    scratch = Scratch(sets.sparkSession, "groups")
    keyed = sets.select(F.col(key).alias("k"), plain_set(items).alias("s")).where(F.size("s") > 0)
    nodes = scratch.save(keyed.groupBy("s").agg(F.min("k").alias("representative")), "nodes")
    members = spread_join(keyed, nodes, "s").select(F.col("k").alias(key), "representative")
    return jaccard_pairs(nodes, "representative", "s", threshold), members


def _first_alike(entries: DataFrame, probes: DataFrame, index: DataFrame | None, threshold: float) -> DataFrame:
    """(o, b): for each probe row the earliest row of the index before it that is alike, if any; without an index of the probes.

    `entries` are those of `_prefixes`; the others are tables of o, without rows
    in common.  A row is compared with earlier ones in ascending order until one
    is alike, so a crowd costs a comparison a row and not one a pair; no pair is
    given out but the one found.
    """
    kind = entries.schema["k"].dataType.simpleString()
    sides = [probes.select(F.col("o").alias("k"), F.lit(1).alias("probe"), F.lit(0 if index is not None else 1).alias("index"))]
    if index is not None:
        sides.append(index.select(F.col("o").alias("k"), F.lit(0).alias("probe"), F.lit(1).alias("index")))
    chosen = entries.select("k", "t", "s", "n", "b0", "b1").join(sides[0] if index is None else sides[0].unionByName(sides[1]), "k")
    groups = 8 * int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # of whole lists or pairs of blocks
    dealt = _block_pairs(chosen).withColumn("deal", F.pmod(F.xxhash64("t", "i", "j"), F.lit(groups)))

    def work(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["t", "i", "j", "k"], ignore_index=True)
        change = (pdf[["t", "i", "j"]] != pdf[["t", "i", "j"]].shift()).any(axis=1).to_numpy()
        bounds = np.append(np.flatnonzero(change), len(pdf))
        keys, own, n = pdf["k"].tolist(), pdf["own"].to_numpy(), pdf["n"].to_numpy().astype(float)
        bits = pdf[["b0", "b1"]].to_numpy(np.int64).view(np.uint64)
        probe, known, sets = pdf["probe"].to_numpy() > 0, pdf["index"].to_numpy() > 0, [None] * len(pdf)
        split, out = (pdf["i"] != pdf["j"]).to_numpy(), []

        def tokens_of(k):
            if sets[k] is None:
                sets[k] = set(pdf["s"].iloc[k])
            return sets[k]

        def found(k, earlier):
            start, step = 0, 32
            while start < len(earlier):
                some = earlier[start : start + step]
                apart = np.bitwise_count(bits[some] ^ bits[k]).sum(axis=1)
                for x in some[apart * (1 + threshold) <= (1 - threshold) * (n[some] + n[k]) + 1e-6]:
                    shared = len(tokens_of(x) & tokens_of(k))
                    if shared / (n[x] + n[k] - shared) >= threshold:
                        return x
                start, step = start + step, step * 8
            return None

        for low, high in zip(bounds[:-1], bounds[1:]):
            rows = np.arange(low, high)
            sides = {b: rows[known[low:high] & (own[low:high] != b)] for b in set(own[low:high])} if split[low] else {own[low]: rows[known[low:high]]}
            for k in rows[probe[low:high]]:
                earlier = sides[own[k]]
                x = found(k, earlier[: np.searchsorted(earlier, k)])
                if x is not None:
                    out.append((keys[k], keys[x]))
        return pd.DataFrame({"o": pd.Series([a for a, _ in out], dtype=pdf["k"].dtype), "b": pd.Series([b for _, b in out], dtype=pdf["k"].dtype)})

    hits = dealt.groupBy("deal").applyInPandas(work, f"o {kind}, b {kind}")
    return hits.groupBy("o").agg(F.min("b").alias("b"))


def _elected(undecided: DataFrame, edges: DataFrame, scratch: Scratch, turn: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round: (leaders found, rows still undecided, edges among them).  A row without an earlier undecided neighbour leads."""
    led = scratch.save(undecided.join(edges.select(F.col("b").alias("o")).distinct(), "o", "left_anti"), f"led-{turn}")
    settled = scratch.save(led.unionByName(edges.join(led.withColumnRenamed("o", "a"), "a", "left_semi").select(F.col("b").alias("o"))).distinct(), f"settled-{turn}")
    left = scratch.save(undecided.join(settled, "o", "left_anti"), f"undecided-{turn}")
    live = edges.join(settled.withColumnRenamed("o", "a"), "a", "left_anti").join(settled.withColumnRenamed("o", "b"), "b", "left_anti")
    live = scratch.save(live.select("a", "b"), f"live-{turn}")
    scratch.drop(f"settled-{turn}", f"undecided-{turn - 1}", f"live-{turn - 1}")
    return led, left, live


def _settled_locally(edges: DataFrame) -> DataFrame:
    """(o): the leaders of whole components (comp, a, b), each settled in one task in ascending order."""

    def work(pdf):
        import pandas as pd

        led = set()
        earlier = {}
        for a, b in zip(pdf["a"], pdf["b"]):
            earlier.setdefault(b, []).append(a)
        for o in sorted({*pdf["a"], *pdf["b"]}):
            if not any(a in led for a in earlier.get(o, ())):
                led.add(o)
        return pd.DataFrame({"o": pd.Series(sorted(led), dtype=pdf["a"].dtype)})

    return edges.groupBy("comp").applyInPandas(work, f"o {edges.schema['a'].dataType.simpleString()}")


def leader_cluster(df: DataFrame, order: str, items: str, threshold: float = 0.6) -> DataFrame:
    """Add `leader`: the order value of the row that leads each row's cluster.

    Rows in ascending order join the earliest cluster whose leader has Jaccard
    >= threshold with them, or lead a new one.  The leaders are the first
    maximal independent set of the similarity graph in that order, of which only
    what is needed is looked at: in a round, rows without an earlier undecided
    row like them lead, and those like a new leader are decided, so that a crowd
    of m rows costs m comparisons.  Rounds go on while they decide half of the
    rows; LOCAL_ROWS or fewer are settled by the plain loop in one task, and of
    more the edges are listed, and their components, of which those of at most
    LOCAL_EDGES edges are settled by one task each (so a chain of any such length
    takes no more rounds), go on with rounds of election only where they are
    larger.  All ways give the same leaders.  Equal token sets are one node; null
    tokens are none; rows without tokens, null arrays included, form one
    cluster.  `order` must be unique and not null.
    """
    scratch = Scratch(df.sparkSession, "leaders")
    keyed = df.withColumn("__set", plain_set(items))
    nodes = scratch.save(keyed.groupBy("__set").agg(F.min(order).alias("o")), "nodes")
    entries = scratch.save(_prefixes(nodes, "o", "__set", threshold), "entries")
    leaders = nodes.where(F.size("__set") == 0).select("o")
    left = nodes.where(F.size("__set") > 0).select("o")
    count, turn = left.count(), 0
    while count > LOCAL_ROWS:
        alike = scratch.save(_first_alike(entries, left, None, threshold), f"alike-{turn}")
        led = scratch.save(left.join(alike, "o", "left_anti"), f"first-{turn}")
        leaders = leaders.unionByName(led)
        waiting = alike.join(led.withColumnRenamed("o", "b"), "b", "left_anti").select("o")
        waiting = scratch.save(waiting, f"waiting-{turn}")
        decided = _first_alike(entries, waiting, led, threshold)
        left = scratch.save(waiting.join(decided, "o", "left_anti"), f"left-{turn}")
        before, count, turn = count, left.count(), turn + 1
        if turn > 1 and 2 * count > before:
            break
    rest = nodes.join(left, "o", "left_semi")
    if count > LOCAL_ROWS:
        edges = scratch.save(jaccard_pairs(rest, "o", "__set", threshold).select("a", "b"), "edges")
        leaders = leaders.unionByName(_settled(left, edges, scratch))
    elif count:
        leaders = leaders.unionByName(_in_order(rest, threshold))
    leaders = scratch.save(leaders, "leaders")
    joined = _first_alike(entries, nodes.select("o").join(leaders, "o", "left_anti"), leaders, threshold)
    placed = nodes.join(joined, "o", "left").select("__set", F.coalesce("b", "o").alias("leader"))
    return spread_join(keyed, scratch.save(placed, "placed"), "__set").drop("__set")


def _in_order(rows: DataFrame, threshold: float) -> DataFrame:
    """(o): the leaders among at most LOCAL_ROWS rows (o, __set), by the plain loop in one task."""

    def work(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("o", ignore_index=True)
        sets, bits = [set(s) for s in pdf["__set"]], pdf[["b0", "b1"]].to_numpy(np.int64).view(np.uint64)
        n, led = np.array([len(s) for s in sets], float), np.zeros(len(pdf), bool)
        for k in range(len(pdf)):
            some = np.flatnonzero(led[:k])
            apart = np.bitwise_count(bits[some] ^ bits[k]).sum(axis=1)
            near = some[apart * (1 + threshold) <= (1 - threshold) * (n[some] + n[k]) + 1e-6]
            led[k] = not any(len(sets[x] & sets[k]) / len(sets[x] | sets[k]) >= threshold for x in near)
        return pd.DataFrame({"o": pdf["o"][led]})

    marked = rows.select("o", "__set", _signature("__set", 0).alias("b0"), _signature("__set", 1).alias("b1"), F.lit(0).alias("one"))
    return marked.groupBy("one").applyInPandas(work, f"o {rows.schema['o'].dataType.simpleString()}")


def _settled(undecided: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(o): the leaders among undecided rows, from all edges between them."""
    # rows without any edge lead; only the others are elected
    touched = scratch.save(edges.select(F.col("a").alias("o")).union(edges.select("b")).distinct(), "undecided-0")
    leaders = scratch.save(undecided.join(touched, "o", "left_anti"), "alone")
    left, live, turn = touched, edges, 0
    while not left.isEmpty():
        turn += 1
        led, left, live = _elected(left, live, scratch, turn)
        leaders = leaders.unionByName(led)
        if live.isEmpty():
            continue
        # rows without undecided neighbours lead in the next round; the others are settled by component
        comp = connected_components(live, scratch, f"comp-{turn}")
        held = spread_join(live.withColumnRenamed("a", "node"), comp, "node").select("component", F.col("node").alias("a"), "b")
        held = scratch.save(held.withColumnRenamed("component", "comp"), f"held-{turn}")
        small = held.groupBy("comp").agg(F.count("*").alias("n")).where(F.col("n") <= LOCAL_EDGES).select("comp")
        small = scratch.save(small, f"small-{turn}")
        leaders = leaders.unionByName(scratch.save(_settled_locally(held.join(small, "comp", "left_semi")), f"local-{turn}"))
        inside = comp.join(small, comp["component"] == small["comp"], "left_semi").select(F.col("node").alias("o"))
        left = scratch.save(left.join(inside, "o", "left_anti"), f"outside-{turn}")
        live = scratch.save(held.join(small, "comp", "left_anti").select("a", "b"), f"large-{turn}")
    return leaders


def cluster_label(clustered: DataFrame, company: str = "probable_company") -> DataFrame:
    """(leader, label): the most frequent company of each cluster, of equally frequent ones the smallest, else 'Unknown'."""
    counts = clustered.groupBy("leader", company).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("leader").orderBy(F.col(company).isNull(), F.desc("n"), company))
    return counts.withColumn("place", place).where("place = 1").select("leader", F.coalesce(company, F.lit("Unknown")).alias("label"))


def work_groups(tickets: DataFrame, order: str = "ticket_number", threshold: float = 0.6, fields: list[str] | None = None) -> DataFrame:
    """Fill probable_company where missing and set probable_work_group from the clusters of active relevant tickets; adds leader."""
    own = tickets.withColumn("probable_company", F.coalesce("probable_company", normalize_company(F.col("excavator_name"))))
    words = own.withColumn("__tokens", tokens(*[F.coalesce(F.col(c), F.lit("")) for c in fields or DEFAULT_FIELDS]))
    clustered = leader_cluster(words, order, "__tokens", threshold)
    labels = cluster_label(clustered)
    return spread_join(clustered, labels, "leader").withColumn("probable_work_group", F.col("label")).drop("label", "__tokens")


def cluster_summary(clustered: DataFrame, key: Column, order: str = "ticket_number") -> DataFrame:
    """Per cluster: key, usual company, count, first and last call, representative row."""
    counted = clustered.groupBy("leader").agg(
        F.min_by(key, order).alias("group_key"), F.count("*").alias("tickets"), F.min("call_date").alias("first_seen"), F.max("call_date").alias("last_seen"), F.min(order).alias("representative")
    )
    return counted.join(cluster_label(clustered), "leader")


def group_label(df: DataFrame) -> DataFrame:
    return df.withColumn("group_label", fallback_label(F.col("probable_work_group"), F.col("probable_company")))
