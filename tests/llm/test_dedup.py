import random
import re

import pytest
from pyspark.sql import functions as F

from noticeflow.llm.exact_dedup import DigestIndex, exact_dedup, first_rows, keep_first_copies, text_digests
from noticeflow.graph import connected_components
from noticeflow.llm.near_dedup import band_plan, keep_one_of_each, near_dedup
from noticeflow.llm.shared import IdFilter, Scratch, drop_ids

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], SCHEMA)


def shingles(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return set(zip(*[words[i:] for i in range(k)])) if len(words) >= k else {tuple(words)} if words else set()


def components(texts, k, percent):
    sets = {i: shingles(t, k) for i, t in texts}
    home = {i: i for i in sets}

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                home[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_copies(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 6)))
    texts = [None, "", " \n\t", "one", "ONE", "one two", "Ünï one two three", "a\x00b c d"]
    for group in range(6):
        base = [word() for _ in range(rnd.randint(4, 120))]
        for _ in range(rnd.randint(1, 25)):
            copy = list(base)
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(rnd.choice([" ", "\n"]).join(copy))
    ids = rnd.sample(range(10_000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed,k,percent", [(1, 3, 85), (2, 5, 80), (3, 3, 85)])
def test_near_dedup_equals_brute_force(spark, seed, k, percent):
    texts = near_copies(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup(frame(spark, texts), k, percent).collect()}
    assert got == components(texts, k, percent)


def test_near_dedup_large_group(spark):
    """One group of 700 near copies, of which most are only linked through others, takes several blocks."""
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(700):
        copy = list(base)
        for _ in range(rnd.randint(0, 3)):
            copy[rnd.randrange(60)] = f"x{rnd.randrange(10**6)}"
        texts.append((i, " ".join(copy)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup(frame(spark, texts), 3, 85).collect()}
    assert got == components(texts, 3, 85)


def test_near_dedup_edges(spark):
    assert near_dedup(frame(spark, [])).count() == 0
    odd = frame(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (None, "x y z w v u"), (7, None)]).withColumns({"kept": F.lit(1), "component_id": F.lit("x"), "bucket": F.lit(2)})
    rows = near_dedup(odd).collect()
    assert len(rows) == 4 and sum(r["kept"] for r in rows) == 4
    assert sorted(keep_one_of_each(odd).columns) == sorted(odd.columns)


def test_bands_miss_little():
    for percent in (70, 80, 85, 90):
        bands, rows = band_plan(percent)
        assert (1 - (percent / 100) ** rows) ** bands < 2e-5


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(3, None), (7, 7)]
    home = {}

    def root(i):
        while home.setdefault(i, i) != i:
            i = home[i]
        return i

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            home[y] = x
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: root(i) for i in home}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_id_filter(spark):
    rows = frame(spark, [(i, "x") for i in range(500)] + [(None, "y")])
    gone = spark.createDataFrame([(i,) for i in range(0, 500, 7)] + [(None,)], "doc_id long")
    scratch = Scratch(spark, "t")
    maybe, sure = IdFilter(gone, scratch).split(rows, "doc_id")
    assert maybe.count() + sure.count() == 501 and maybe.join(gone, "doc_id", "left_semi").count() == 72
    assert drop_ids(rows, gone, "doc_id", Scratch(spark, "t")).count() == 501 - 73


def plain_dedup(texts):
    groups = {}
    for i, t in texts:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i))
    return {i: (min(groups[re.sub("[\x20\x09-\x0d]", "", t or "")])[1], len(groups[re.sub("[\x20\x09-\x0d]", "", t or "")])) for i, t in texts}


def test_exact_dedup(spark):
    texts = [(4, "a b"), (2, "ab"), (9, "a  b"), (1, "a b"), (3, None), (5, " \n"), (6, ""), (8, "x" * 200_000), (7, "x" * 200_000 + "\n")]
    rows = {r["doc_id"]: r for r in exact_dedup(frame(spark, texts)).collect()}
    assert {i: (r["keep_id"], r["group_size"]) for i, r in rows.items()} == plain_dedup(texts)
    assert all(r["kept"] == (i == r["keep_id"]) for i, r in rows.items())
    assert exact_dedup(frame(spark, [])).count() == 0


def test_exact_dedup_repeated_rows(spark):
    df = frame(spark, [(1, "a"), (1, "a"), (2, "b"), (None, "c")]).withColumns({"text_sha256": F.lit(0), "keep_id": F.lit(0), "row": F.lit(0)})
    assert sum(r["kept"] for r in exact_dedup(df).collect()) == 3
    kept = keep_first_copies(df)
    assert kept.columns == df.columns and sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "c"), (1, "a"), (2, "b")]


def test_index_persists(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    groups = lambda *texts: first_rows(text_digests(frame(spark, texts)))
    DigestIndex(spark, path).append(groups((1, "a"), (2, "b")), "one")
    again = DigestIndex(spark, path, expected=10**9)
    again.append(groups((3, "b"), (4, "c"), (5, "c ")), "two")
    assert again.table().count() == 3 and again.buckets == 4  # as it was made
    late = {r["doc_id"]: r["keep_id"] for r in exact_dedup(frame(spark, [(6, "c"), (7, "d")]), path).collect()}
    assert late == {6: 5, 7: 7} and DigestIndex(spark, f"{path}-2", expected=10**9).buckets == 1024


def test_index_is_read_in_place(spark, tmp_path):
    """No exchange stands over the index, neither before what is new is found nor after."""
    index = DigestIndex(spark, f"file://{tmp_path}/index")
    groups = first_rows(text_digests(frame(spark, [(i, f"t{i}") for i in range(1000)])))
    index.append(groups, "one")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.entries(groups)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    side = plan[plan.index("Scan ExistingRDD") :]  # what stands behind the groups' own side
    assert "SortMergeJoin" in plan and "Bucketed: true" in side and "Exchange" not in side and "Exchange" in plan


def test_indexed_rows_stay_only_once(spark, tmp_path):
    path, docs = f"file://{tmp_path}/index", frame(spark, [(1, "a"), (2, "b"), (3, "b"), (None, "c")]).coalesce(1)
    rows = lambda df, batch: sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(df, path, batch).collect()), key=str)
    first = rows(docs, "one")
    assert sum(kept for *_, kept in first) == 3
    later = rows(frame(spark, [(7, "a"), (8, "d"), (8, "d")]), "two")
    assert sorted(later) == [(7, 1, 1, False), (8, 8, 2, False), (8, 8, 2, True)]
    # the same batches once more, dealt otherwise, as after a lost driver
    assert rows(docs.repartition(3), "one") == first and rows(frame(spark, [(7, "a"), (8, "d"), (8, "d")]), "two") == later
    assert not any(kept for *_, kept in rows(docs, "three"))


def test_index_takes_up_where_a_batch_broke_off(spark, tmp_path):
    path, texts = f"file://{tmp_path}/index", [(i, f"t{i}") for i in range(1000)]
    DigestIndex(spark, path).append(first_rows(text_digests(frame(spark, texts[:400]))), "one")  # as far as it came
    assert sum(r["kept"] for r in exact_dedup(frame(spark, texts), path, "one").collect()) == 1000


def test_near_dedup_decides_by_row(spark):
    rnd = random.Random(12)
    text = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60))
    one, two, three, four, five = (text() for _ in range(5))
    near = lambda t: t + " more"
    rows = [(1, one), (None, one), (None, two), (5, three), (5, four), (3, near(three)), (8, five), (8, near(five)), (None, None)]
    df = frame(spark, rows + [(9, "x y z u v w"), (9, "x y z u v w")])
    found = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup(df).collect()}
    assert {(1, 1, True), (None, 1, False), (None, None, True), (3, 3, True), (5, 3, False), (5, 5, True)} <= found
    kept = [(r["doc_id"], r["text"]) for r in keep_one_of_each(df).collect()]
    fives = [t for i, t in kept if i == 8]
    assert len(fives) == 1 and fives[0] in (five, near(five))
    assert sorted((i or 0, t or "") for i, t in kept if i != 8) == sorted([(1, one), (0, two), (5, four), (3, near(three)), (0, ""), (9, "x y z u v w")])


def test_ranges(spark):
    """Range numbers equal a binary search, for bounds of any number and keys on and between them."""
    import bisect

    from noticeflow.llm.shared import range_of

    keys = [*range(-3, 120), None]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for bounds in ([], [5], [0, 1], list(range(0, 110, 7)), list(range(0, 100, 4)), list(range(100))):
        got = {r["k"]: r["n"] for r in df.select("k", range_of("k", bounds).alias("n")).collect()}
        assert got == {k: 0 if k is None else bisect.bisect_left(bounds, k) for k in keys}


def test_no_table_is_left_behind(spark):
    before = len(spark.catalog.listTables())
    assert exact_dedup(frame(spark, [(1, "a"), (2, "a")])).count() == 2 and len(spark.catalog.listTables()) == before
