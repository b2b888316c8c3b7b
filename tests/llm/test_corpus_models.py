"""Merkle manifests, the language model and source divergence, against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeflow.llm import merkle, pitman_yor
from noticeflow.llm.divergence import divergence, run_lengths, source_divergence
from noticeflow.llm.queries import queries, table
from noticeflow.llm.shared import Scratch

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, a lone language, and runs that don't fill up."""
    rows = [(i, f"Text {i} of ours and yours", "en", f"s{i % 3}", i) for i in range(70)]
    rows += [(None, "no id", "en", "s1", 1), (None, None, None, None, None), (5, "Text 5 of ours and yours", "en", "s2", 5), (5, "other text", "en", "s2", 5)]
    rows += [(5, "Text 5 of ours and yours", "en", "s2", 5), (900, "", "de", "", 0), (901, "lone Straße", "", "s", 3), (902, "é ü 漢字 É\x00a", "de", None, 2), (903, "x" * 50_000, "de", "s0", 9)]
    return rows + [(1000 + i, f"ours wort{i % 4} Wort{i % 2}", "de", f"s{i % 2}", i) for i in range(12)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).withColumns({"node": F.lit(1), "path": F.lit("p"), "term": F.lit("t"), "row": F.lit(0), "word": F.lit("w")})


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, lower=False):
    i, text, lang, source, n = row
    if lower and text is not None:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def tree(nodes):
    """(root, siblings before and after each node, level by level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            run = nodes[place // 8 * 8 : place // 8 * 8 + 8]
            paths[k].append(("".join(run[: place % 8]), "".join(run[place % 8 + 1 :])))
        nodes, at = [sha(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)], [place // 8 for place in at]
    return nodes[0], paths


def plain_manifest(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inner = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        inner[g] = tree([leaf_of(r) for r in groups[g]])
    root, upper = tree([inner[g][0] for g in order])
    out = []
    for g, above in zip(order, upper):
        for row, path in zip(groups[g], inner[g][1]):
            touched = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            node = leaf_of(row, touched)
            for left, right in path + above:
                node = sha(left, node, right)
            out.append((row[0], leaf_of(row), inner[g][0], root, sha(*[a + b for a, b in path + above]), node, node == root))
    return out


def test_manifest_equals_plain_trees(spark, odd, tmp_path, monkeypatch):
    path = str(tmp_path)
    odd.write.parquet(f"{path}/documents.parquet")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: tuple(map(str, r))
    got = [tuple(r[n] for n in names) for r in queries()["op11_merkle_manifest"](spark, path).collect()]
    assert sorted(got, key=key) == sorted(plain_manifest(odd_rows()), key=key)
    assert {r[-1] for r in got} == {True, False}
    docs = table(spark, SF, "documents")
    got = [tuple(r[n] for n in names) for r in queries()["op11_merkle_manifest"](spark, SF).collect()]
    assert sorted(got) == sorted(plain_manifest([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.collect()]))
    assert merkle.merkle_manifest(odd.where("false"), ["doc_id", "text"]).collect() == []
    one = merkle.merkle_manifest(odd.where("doc_id = 901"), ["doc_id"]).first()
    assert one["path"] == [] and one["root"] == one["node"] == one["subroot"]


@pytest.mark.parametrize("count", [1, 7, 8, 9, 63, 64, 65, 513, 1100])
def test_manifest_sizes(spark, count):
    """Full and partial runs, and windows of several blocks."""
    rows = [(i, f"t{i}", "x", "s", 0) for i in range(count)]
    found = merkle.merkle_manifest(spark.createDataFrame(rows, SCHEMA), ["doc_id", "source", "lang", "n_chars", "text"])
    found = found.select("doc_id", merkle.as_text(F.col("root")).alias("root"), (merkle.fold(F.col("node"), F.col("path")) == F.col("root")).alias("ok")).collect()
    assert {r["root"] for r in found} == {tree([leaf_of(r) for r in rows])[0]} and all(r["ok"] for r in found) and len(found) == count


# -- divergence -------------------------------------------------------------------


def plain_divergence(rows, least=3, top=200):
    terms = [(lang or "", source or "", Counter(t.lower() if t.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""))) for _, text, lang, source, _ in rows]
    out = []
    for lang in {t[0] for t in terms}:
        own = [t for t in terms if t[0] == lang]
        docs = Counter(w for _, _, c in own for w in c)
        kept = sorted(w for w in docs if docs[w] >= least)
        columns = {None: Counter()} | {s: Counter() for _, s, _ in own}
        for _, source, c in own:
            for w in kept:
                columns[source][w] += c[w]
                columns[None][w] += c[w]
        p = {s: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept} for s, c in columns.items()}
        f = lambda a, b, w: (p[a][w] - p[b][w]) ** 2 // p[b][w]  # noqa: B023, E731
        for s in columns:
            if s is None:
                continue
            pairs = [(-sum(f(s, o, w) for w in kept), o.encode(), o) for o in columns if o not in (None, s)]
            words = [(-f(s, None, w), w.encode(), w) for w in kept if columns[s][w] and p[s][w] > p[None][w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(words)[:top])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


def test_divergence_equals_plain_loops(spark, odd):
    names = ["lang", "source", "part", "item", "value", "rank"]
    got = sorted(tuple(r[n] for n in names) for r in source_divergence(odd).collect())
    assert got == plain_divergence(odd_rows()) and {r[2] for r in got} == {"pair", "term"}
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"], 0) for r in table(spark, SF, "documents").collect()]
    got = sorted(tuple(r[n] for n in names) for r in source_divergence(table(spark, SF, "documents"), top=7).collect())
    assert got == plain_divergence(docs, top=7)
    assert source_divergence(odd.where("false")).collect() == []
    assert source_divergence(odd.where("doc_id >= 900 AND doc_id < 904")).select("part", "value").distinct().collect() == [("pair", 0)]


def test_runs_of_columns():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.repeat(rnd.integers(1, 6, 40), rnd.integers(1, 9, 40))[:100] for _ in "ab")
        runs = [run_lengths(np.arange(100), x, 100) for x in (a, b)]
        assert all((np.repeat(v, np.diff(s, append=100)) == x).all() for (s, v), x in zip(runs, (a, b)))
        assert divergence(*runs, 100) == sum((int(p) - int(q)) ** 2 // int(q) for p, q in zip(a, b))


# -- language model ---------------------------------------------------------------


def test_seating_follows_the_restaurant():
    """Tables of four customers after many sweeps, against the exact chances from generalised Stirling numbers."""
    d, other, base, n = 0.6, 3, 0.2, 40_000
    stirling = [1.0]
    for c in range(4):
        stirling = [(stirling[t - 1] if t else 0) + (max(0, c - d * t) * stirling[t] if t < len(stirling) else 0) for t in range(len(stirling) + 1)]
    exact = [stirling[t] * math.prod((pitman_yor.STRENGTH + d * (other + k)) * base for k in range(t)) for t in range(1, 5)]
    customers, others, bases, keys = np.full(n, 4), np.full(n, other), np.full(n, base), np.arange(n, dtype=np.uint64)
    state = pitman_yor.seat(customers, others, bases, np.full(n, d), keys, 0)
    for turn in range(1, 6):
        state = pitman_yor.reseat(*state, customers, others, bases, np.full(n, d), keys, turn)
    found = np.bincount(np.diff(state[0]), minlength=5)[1:] / n
    assert np.abs(found - np.array(exact) / sum(exact)).max() < 0.012
    x = np.array([1e-3, 0.4, 1.0, 7.7, 1e6])
    assert np.allclose(pitman_yor.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)


def plain_base(rows):
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b"\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t, *_ in rows if not held(i) for w in words(t))
    total = sum(counts.values())
    score = lambda t: sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in words(t))
    return sorted((str(i), held(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), total, round(score(t), 6)) for i, t, *_ in rows)


def rounded(found):
    return sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found)


def test_base_scores_equal_plain_counts(spark, odd, monkeypatch):
    found = pitman_yor.language_scores(odd).collect()
    assert rounded(found) == plain_base(odd_rows()) and all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)
    docs = table(spark, SF, "documents")
    plain = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    whole = pitman_yor.language_scores(docs).collect()
    assert rounded(whole) == plain_base(plain)
    held = [r for r in whole if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    # no word is looked up by the tasks themselves, and rows are dealt otherwise: the same scores
    monkeypatch.setattr(pitman_yor, "LOOKUP", pitman_yor.OWN)
    again = pitman_yor.language_scores(docs.repartition(7)).collect()
    close = lambda rows: {r["doc_id"]: r["score"] for r in rows}
    assert rounded(again) == rounded(whole) and all(math.isclose(v, close(again)[i], rel_tol=1e-9) for i, v in close(whole).items())
    assert pitman_yor.language_scores(docs.where("false")).collect() == []
    lone = docs.where(pitman_yor.held_out())
    assert {(r["n_known"], r["base_score"]) for r in pitman_yor.language_scores(lone).collect()} == {(0, 0.0)}


def test_probabilities_sum_to_one(spark):
    texts = table(spark, SF, "documents").select(pitman_yor.raw_text().alias("text"))
    model, rated = pitman_yor.fit_model(texts, Scratch(spark, "test-model"))
    dishes = model.codes.own + 1
    for context in (0, model.codes.end, dishes - 1):
        assert math.isclose(model.probability(np.full(dishes, context), np.arange(dishes)).sum(), 1, rel_tol=1e-9)
    rare = rated.where(F.col("p") < 1).agg(F.sum("p")).first()[0]
    assert math.isclose(rare + model.unseen, 1, rel_tol=1e-9)


def test_pairs_of_rare_words_count(spark, monkeypatch):
    """Every pair of words with a rare one scores by its own exact count, and the chances after a word sum to one."""
    monkeypatch.setattr(pitman_yor, "OWN", 16)
    monkeypatch.setattr(pitman_yor, "LOOKUP", 32)
    rnd = random.Random(5)
    names = [f"w{k}" for k in range(40)]
    texts = [" ".join(rnd.choices(names, [1 / (k + 1) for k in range(40)], k=rnd.randint(0, 12))) for _ in range(150)]
    texts += ["one two"] * 3 + ["two one new", "x" * 50 + " w3 " + "x" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, rated = pitman_yor.fit_model(docs.where(~pitman_yor.held_out()).select(pitman_yor.raw_text().alias("text")), Scratch(spark, "test-pairs"))
    chance = {bytes(r["word"]): r["p"] for r in rated.collect()}
    split = lambda t: [b"\n"] + t.encode().split() + [b"\n"]
    learnt = Counter(p for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2 for p in zip(split(t), split(t)[1:]))
    own = [w for w, k in model.codes.index.items() if k < model.codes.own]
    dish = lambda w: own.index(w) if w in own else len(own)
    above = {(c, d): model.probability(np.array([c]), np.array([d]))[0] for c in range(len(own) + 1) for d in range(len(own) + 1)}
    discount, strength = pitman_yor.PAIR_DISCOUNT, pitman_yor.STRENGTH

    def plain(before, word):
        base = above[dish(before), dish(word)]
        if before in own and word in own:
            return base
        among = [n for (c, w), n in learnt.items() if c == before and not (c in own and w in own)]
        kept, part = (base, 1.0) if before in own else (1.0, base)
        part *= chance.get(word, model.unseen) if word not in own else 1.0
        return kept * ((1 - discount) * learnt[before, word] + (strength + discount * sum(among)) * part) / (strength + sum(among))

    assert 1 < len(own) < len(model.codes.index) < len(chance)
    for before in (own[0], b"one", b"w30", b"never"):
        assert math.isclose(sum(plain(before, w) for w in chance) + plain(before, b"never"), 1, rel_tol=1e-9)
    found = {r["doc_id"]: r["score"] for r in pitman_yor.language_scores(docs.repartition(3)).collect()}
    for i, t in enumerate(texts):
        assert math.isclose(found[i], sum(math.log10(plain(c, w)) for c, w in zip(split(t), split(t)[1:])), rel_tol=1e-6)
