import base64
import hashlib
import json
import random
import re
import time
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noticeflow.llm import fingerprints, packing, quality, token_orc, warc
from noticeflow.llm.license_scan import TEMPLATES, anchors, license_scan, read_templates, template_bigrams, template_words
from noticeflow.llm.piece_bpe import encode_pieces, encoder
from noticeflow.llm.queries import table
from noticeflow.llm.shared import Scratch, ordered_ranges
from noticeflow.llm.spans import SpanIds
from noticeflow.llm.tokens import SegmentEncoder, vocabulary
from noticeflow.llm.url_filter import judge_urls

SF = "/root/testdata/sf0.001"
ODD = list(" \t\n\r\x0b\x0c\x1c\x85\xa0 　▁abcXYZ'éÉßÿ×µ.,;:!?-_019²Ⅷ漢字😀İΣ") + ["<|endoftext|>", "  ", "'s", "The", "word. ", "\x00"]


def fuzz(n, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 30))) for _ in range(n)] + ["", " ", "  ", "\n", "a ", "▁"]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def plain(docs):
    return docs.toPandas().sort_values("doc_id").reset_index(drop=True)


def odd_docs(spark):
    rows = [(3, None), (1, ""), (2, "x y" * 30_000), (2, "x y" * 30_000), (None, "null id")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("range", "length", "ids", "score", "piece", "guest")})


def test_url_components_equal_union_find(spark):
    """Thousands of canonical links and refreshes (chains, cycles, a hub of 20,000), with allow rules inside blocked components."""
    rnd = random.Random(21)
    links, n = [], 0

    def url(i, lang="xx"):
        return f"http://h{i % 97}.net/{lang}/{i}"

    for _ in range(300):  # chains and cycles
        size = rnd.randint(2, 9)
        links += [(n + j, n + j + 1) for j in range(size - 1)] + ([(n + size - 1, n)] if rnd.random() < 0.5 else [])
        n += size
    hub = n
    links += [(hub, hub + 1 + j) if j % 2 else (hub + 1 + j, hub) for j in range(20_000)]
    n = hub + 20_001
    langs = {i: "de" for i in rnd.sample(range(hub), 60)} | {hub + 77: "de"} | {i: "fr" for i in rnd.sample(range(n), 400)}
    name = lambda i: url(i, langs.get(i, "xx")).replace(".net", ".com" if i in langs else ".net")
    tag = lambda k, t: f'<link rel="canonical" href="{t}">' if k % 2 else f'<meta http-equiv="refresh" content="0; url={t}">'
    html = {}
    for k, (a, b) in enumerate(links):
        html.setdefault(a, []).append(tag(k, name(b)))
    pages = [(i, name(i), "".join(html.get(i, []))) for i in range(n)]
    home = list(range(n))

    def root(i):
        while home[i] != i:
            home[i] = home[home[i]]
            i = home[i]
        return i

    for a, b in links:
        home[root(a)] = root(b)
    bad = {root(i) for i, lang in langs.items() if lang == "de"}
    got = {r["page_id"]: r["verdict"] for r in judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = {i: "allow" if langs.get(i) == "fr" else "block" if langs.get(i) == "de" or root(i) in bad else "allow" for i in range(n)}
    assert got == want and sum(v == "block" for v in want.values()) > 19_000 and any(langs.get(i) == "fr" and root(i) in bad for i in range(n))


def test_url_rules_and_aliases(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.Example.org/es/1", '<LINK href="https://c.net/x" rel=canonical>'), (2, "http://C.net/x#z", '<meta http-equiv="refresh" content="0; url=/y">'), (3, "http://c.net/y", None),
         (4, "https://k.com/fr/1", '<link rel="canonical" href="//c.net/y">'), (5, None, "x"), (6, "nothing", None), (7, "http://q.net", ""), (8, "http://example.org/en/12", ""), (8, "http://example.org/en/12", ""),
         (9, "http://notexample.org/es/", ""), (10, "http://com/fr/?a", ""), (11, "http://x.com?u=/de/", ""), (12, "http://h.net/b", '<link rel="canonical" href="http://blocked.com/de/1">')],
        "page_id long, url string, html string",
    ).withColumns({"verdict": F.lit(0), "rule": F.lit(0), "address": F.lit(0)})
    rows = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages).collect()]
    got = {r[0]: r[1:] for r in rows}
    assert len(rows) == 13
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[2][2:] == (None, "block") and got[3][2:] == (None, "block")
    assert got[4][2:] == ("com/fr/", "allow") and got[5] == ("", "", None, "allow") == got[6] and got[7] == ("q.net", "", None, "allow")
    assert got[8][2:] == ("example.org/en/1", "block") and got[9][2:] == ("org/", "allow") and got[10][2:] == ("com/fr/", "allow") and got[11] == ("x.com", "", None, "allow") and got[12][3] == "block"
    assert judge_urls(pages.where("false")).count() == 0
    more = spark.createDataFrame([("http://q.net", "http://z.com/de/")], "a string, b string")
    assert judge_urls(pages.where("page_id = 7"), links=more).first()["verdict"] == "block"


def test_license_scan_equals_brute_force(spark):
    texts = {1: None, 2: "", 3: "Foo\nReleased under the MIT License!\nbar", 4: "\n\n".join([TEMPLATES[1][1].replace("License,", "License,\n"), "tail"]), 5: "released under the mit licence", 6: "x " * 50_000, 7: "word"}
    whole = {name: text for name, text in TEMPLATES if len(text) > 700}
    texts |= {20 + i: "/*\n * " + re.sub(r"(?<=[.:]) ", "\n *\n * ", text.replace("1. ", "- ")) + "\n */\nint main() {}" for i, text in enumerate(whole.values())}
    texts |= {40: "Some words. This work is licensed under the GNU General Public License, version 3. And more of them.", 41: "see (Licensed under CC BY-SA\n4.0.) here", 42: "MIT MIT " * 200}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({"unit": F.lit(1), "words": F.lit(1)})
    want, laid = {}, anchors(TEMPLATES, 0.8)
    for i, t in texts.items():
        words = template_words(t or "")
        at = {(k - place, n) for k, g in enumerate(f"{a} {b}" for a, b in zip(words, words[1:])) for place, n in laid.get(g, ())}
        windows = {" ".join(words[max(s, 0) : max(s + n, 0)]) for s, n in at}
        plain = {*(t or "").split("\n"), *re.split(r"\n[^A-Za-z0-9\n]*\n", t or ""), *re.split(r"[.!?]\s+", t or "")}
        for unit in {" ".join(template_words(u)) for u in plain} | windows:
            grams = set(template_bigrams(unit))
            for name, text in TEMPLATES:
                other = set(template_bigrams(text))
                dice = 2 * len(grams & other) / (len(grams) + len(other))
                if dice >= 0.8:
                    best, units = want.get((i, name), (0, set()))
                    want[i, name] = (max(best, dice), units | {unit})
    want = {k: (best, len(units)) for k, (best, units) in want.items()}
    assert {(r["doc_id"], r["license_id"]): (r["dice"], r["units"]) for r in license_scan(df).collect()} == want and len(want) >= 2
    assert {i for i, _ in want} >= {3, 4, 40, *range(20, 20 + len(whole))}
    assert license_scan(df.where("false")).count() == 0 and license_scan(df, templates=[]).count() == 0


def test_license_scan_of_long_texts(spark, tmp_path):
    """Whole licences in many paragraphs, embedded notices, and work in proportion to a text of very many paragraphs."""
    opening = {name: text for name, text in TEMPLATES if name in ("Apache-2.0", "GPL-3.0", "MPL-2.0", "AGPL-3.0")}
    texts = ["head\n\n" + text.replace(" ", "\n\n") + "\n\nmore\n\n" * 300 for text in opening.values()]
    texts.append("We note that this work is licensed under the GNU General Public License, version 3, or so we hope, and nothing else matters here")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["doc_id"], r["license_id"]) for r in license_scan(df).collect()}
    assert {*enumerate(opening), (len(opening), "GPL-3.0")} <= found
    (tmp_path / "Own-1.0.txt").write_text("one two three four five\n\nsix seven eight nine ten")
    own = read_templates(spark, f"file://{tmp_path}")
    assert [n for n, _ in own] == ["Own-1.0"] and license_scan(df.limit(1).select(F.lit(1).alias("doc_id"), F.lit("a one two three\n\nfour five six seven eight nine ten b").alias("text")), own).first()["dice"] == 1.0
    took = []
    for n in (1, 20_000):
        long = spark.createDataFrame([(1, "a license of ours, short\n\n" * n), (2, "Released under the MIT License.\n\n" * n)], "doc_id long, text string")
        start = time.time()
        assert [(r["doc_id"], r["license_id"], r["units"]) for r in license_scan(long).collect()] == [(2, "MIT", 1)]
        took.append(time.time() - start)
    assert took[1] < took[0] + 20


def ids_of(enc, texts):
    """Ids of each text, from the slices that an encoder gives out."""
    return [ids[a:b].tolist() for _, _, ids, at in enc.encode_batch(pa.array(texts, pa.string())) for a, b in zip(at[:-1], at[1:])]


def test_pieces_equal_the_library(spark, docs, plain):
    path = vocabulary("piece_bpe_32k.model")
    enc, texts = encoder(path), fuzz(4000)
    assert ids_of(enc, texts) == enc.library.encode(texts)
    rows = {r["doc_id"]: r for r in encode_pieces(docs, path).collect()}
    for i, text in zip(plain.doc_id, plain.text):
        ids = enc.library.encode(text, add_bos=True, add_eos=True)
        assert rows[i]["ids"] == ids and rows[i]["n_tokens"] == len(ids) and rows[i]["decoded"] == enc.library.decode(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    odd = encode_pieces(odd_docs(spark), path).collect()
    assert len(odd) == 5 and sorted(r["n_tokens"] for r in odd)[:2] == [2, 2] and encode_pieces(docs.where("false"), path).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_equal_the_library(name, plain):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(name))
    library.encode_special_tokens = True
    texts = fuzz(4000) + plain.text.tolist()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    enc = SegmentEncoder(vocabulary(name))
    assert enc.known and ids_of(enc, texts) == want
    enc.kept = SpanIds(enc._encode, most=300)  # a cache that is too small
    for i in range(0, 2000, 50):
        assert ids_of(enc, texts[i : i + 50]) == want[i : i + 50] and len(enc.kept.count) < 3000


def test_other_vocabularies_are_not_cut(tmp_path):
    built = json.loads(open(vocabulary("byte_bpe_50k.json"), encoding="utf-8").read())
    built["pre_tokenizer"]["use_regex"] = False  # merges may cross words
    (tmp_path / "other.json").write_text(json.dumps(built), encoding="utf-8")
    enc, texts = SegmentEncoder(str(tmp_path / "other.json")), fuzz(300)
    assert not enc.known and ids_of(enc, texts) == [e.ids for e in enc.library.encode_batch(texts, add_special_tokens=False)]


def test_spans_with_equal_hashes_stay_apart(monkeypatch):
    from noticeflow.llm import spans

    monkeypatch.setattr(spans, "mix", lambda x: x & np.uint64(3))
    raw = b"ab cd ef gh ij kl ab ef " + b"x" * 40
    words = [w for w in raw.split(b" ") if w]
    starts = np.array([raw.index(w) if w != words[-2] else 21 for w in words])
    starts[6] = 18
    kept = SpanIds(lambda found: (np.array([int.from_bytes(f[:2], "big") for f in found], np.uint32), np.ones(len(found), np.int64)))
    for _ in range(2):
        ids, count = kept.ids(np.frombuffer(raw, np.uint8), starts, starts + np.array([len(w) for w in words]))
        assert ids.tolist() == [int.from_bytes(w[:2], "big") for w in words] and set(count.tolist()) == {1}


def plain_hash(text):
    """The hash of a run of code points, in whole numbers: a polynomial of scrambled code points, scrambled again, of which the upper half counts."""

    def scramble(x):
        x = ((x ^ (x >> 31)) * 0x7FB5D329728EA185) % 2**64
        x = ((x ^ (x >> 27)) * 0x81DADEF4BC2DD44D) % 2**64
        return x ^ (x >> 33)

    total = sum(scramble((ord(c) + 0x5851F42D4C957F2D) % 2**64) * pow(0x9E3779B97F4A7C15, i, 2**64) for i, c in enumerate(text))
    return scramble(total % 2**64) >> 32


def slow_winnow(text, k, w):
    """(position, hash) of the least hash of each window, of equal ones the rightmost; plain loops and a hash of its own."""
    if not text:
        return []
    k = min(k, len(text))
    hashes = [plain_hash(text[i : i + k]) for i in range(len(text) - k + 1)]
    chosen = set()
    for i in range(max(1, len(hashes) - w + 1)):
        window = hashes[i : i + w]
        at = max(j for j, h in enumerate(window) if h == min(window))
        chosen.add((i + at, window[at]))
    return sorted(chosen)


def slow_fingerprint(text):
    """What a text keeps: short ones every run of 2, 4, 8 and 16 code points (as far as there are under four of them), others 16-grams in windows of 8."""
    if 2 <= len(text) < 64:
        return sorted((i, plain_hash(text[i : i + g])) for g in (2, 4, 8, 16) if g <= len(text) < 4 * g for i in range(len(text) - g + 1))
    return slow_winnow(text, 16, 8)


def test_fingerprints_of_a_query_equal_brute_force(spark, plain):
    """Fingerprints, positions, edits and likenesses of the query's rows, worked out by plain loops."""
    some = plain.sort_values("doc_id", ascending=False).head(40).reset_index(drop=True)
    some.loc[3, "text"], some.loc[7, "text"], some.loc[9, "text"] = None, "", "ab"
    df = spark.createDataFrame([(int(i), t) for i, t in zip(some.doc_id, some.text)], "doc_id long, text string").withColumns({"positions": F.lit("clash"), "range": F.lit(1)})
    rows = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(df).collect()}
    texts = [t or "" for t in some.text]
    text_of = lambda pairs: "".join(f"{h:08x}" for h in sorted({h for _, h in pairs}))

    def alike(a, b):
        a, b = {h for _, h in a}, {h for _, h in b}
        return len(a & b) / len(a | b) if a | b else 1.0

    for k, i in enumerate(some.doc_id):
        text, after, r = texts[k], texts[(k + 1) % len(texts)], rows[i]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        mine, other, following = slow_fingerprint(text), slow_fingerprint(edited), slow_fingerprint(after)
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == text_of(mine) and r["edited_fingerprint"] == text_of(other)
        assert sorted(r["positions"]) == [p for p, _ in mine] == r["positions"]
        assert abs(r["near_edited"] - alike(mine, other)) < 1e-12 and abs(r["near_next"] - alike(mine, following)) < 1e-12


def test_winnow_equals_brute_force():
    rnd = random.Random(1)
    for text in ["", "a", "abcdefg", "a" * 100, "".join(rnd.choice("ab") for _ in range(300)), "".join(rnd.choice("abc😀é ") for _ in range(200))]:
        hashes, at = fingerprints.winnow(text, 5, 8)
        assert list(zip(at.tolist(), hashes.tolist())) == slow_winnow(text, 5, 8)


def test_winnow_guarantee():
    rnd = random.Random(2)
    noise = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    for _ in range(20):
        shared = noise(fingerprints.GRAM + fingerprints.WINDOW - 1)
        a, b = (set(fingerprints.winnow(noise(200) + shared + noise(200))[0].tolist()) for _ in range(2))
        assert a & b


def test_fingerprint_edits(spark, docs, plain):
    rows = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs).collect()}
    down = plain.sort_values("doc_id", ascending=False).reset_index(drop=True)
    after = [*down.text[1:], down.text[0]]
    for i, text, other in zip(down.doc_id, down.text, after):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + other[:cut]
        mine, theirs, third = (np.unique(fingerprints.winnow(t)[0]) for t in (text, edited, other))
        r = rows[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.to_string(mine) and r["edited_fingerprint"] == fingerprints.to_string(theirs)
        assert r["near_edited"] == fingerprints.likeness(mine, theirs) and r["near_next"] == fingerprints.likeness(mine, third)
    odd = fingerprints.fingerprint_edits(odd_docs(spark)).collect()
    assert len(odd) == 5 and fingerprints.fingerprint_edits(docs.where("false")).count() == 0
    lone = fingerprints.fingerprint_edits(docs.where("doc_id = 3")).first()
    assert lone["near_next"] == 1.0
    spans = fingerprints.fingerprint_documents(docs).first()
    assert len(spans["hashes"]) == len(spans["positions"])


def test_fingerprint_ranges_part_hot_ids(spark, docs):
    """A doc_id that a third of the rows have, and a third without one, take several ranges, in order."""
    i = F.col("doc_id")
    rows = docs.withColumn("doc_id", F.when(i % 3 == 0, 100).when(i % 3 == 1, i)).withColumn("h", F.xxhash64("text"))
    number, count = ordered_ranges(rows, 16)
    found = rows.withColumn("range", number).select("doc_id", "h", "range").collect()
    in_order = sorted(found, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"]))
    numbers = [r["range"] for r in in_order]
    assert numbers == sorted(numbers, reverse=True) and 0 <= min(numbers) and max(numbers) < count
    sizes = np.bincount(numbers)
    assert sizes.max() < 40 and len({r["range"] for r in found if r["doc_id"] == 100}) > 3 < len({r["range"] for r in found if r["doc_id"] is None})
    edits = fingerprints.fingerprint_edits(rows).collect()
    assert len(edits) == docs.count()
    following = in_order[1:] + in_order[:1]
    texts = {r["h"]: r["text"] for r in rows.select("h", "text").collect()}
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest() for t, n in ((texts[a["h"]], texts[b["h"]]) for a, b in zip(in_order, following)))
    assert sorted(r["edited_sha256"] for r in edits) == want


def test_winnow_shares_hashes_with_every_edit():
    """Texts of any length share a hash with an edit that keeps two thirds, also if the edit is shorter."""
    rnd = random.Random(5)
    noise = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    for n in [*range(1, 130), 400]:
        for other in ("", noise(n)):
            text = noise(n)
            edited = text[: n - n // 3] + other[: n // 3]
            mine, theirs = (np.unique(fingerprints.winnow(t)[0]) for t in (text, edited))
            assert fingerprints.likeness(mine, theirs) > 0, n


@pytest.mark.parametrize("least", [0, 10])
def test_warc_round_trip(spark, least):
    rows = [(-5, "u\r\nX: 1", None), (7, "u2", ""), (None, None, "abc"), (9, "u", "é" * 700_000), (10, "u", "é" * 700_000), (11, "v", "small"), (12, "v", "small"), (12, "v", "small")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"refers_to": F.lit(1), "payload": F.lit(1)})
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages, least).collect()), key=str)
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        first = min(same) if same else i
        own = len(body) < least or i is None or i == first
        want.append((i or 0, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if own else "revisit", None if own else first))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_repeated_page_ids(spark):
    """A page_id with several payloads: each payload has a response, and a revisit refers to the page that has its own payload."""
    rows = [(3, "a", "AAA"), (5, "b", "AAA"), (5, "b", "BBB"), (5, "b", "CCC"), (6, "c", "CCC"), (6, "c", "BBB"), (7, "d", "AAA"), (7, "d", "AAA")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    first = {t: min(i for i, _, h in rows if h == t) for _, _, t in rows}
    want = sorted(((i, sha(t), "response" if i == first[t] else "revisit", None if i == first[t] else first[t]) for i, _, t in rows), key=str)
    assert sorted(((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()), key=str) == want


def test_warc_chunks(spark):
    from noticeflow.llm.shared import Scratch

    folder = Scratch(spark, "t").path("w")
    body = "0123456789" * 100_000
    archives = warc.write_archives(spark.createDataFrame([(1, "http://a", body)], "page_id long, url string, html string"), folder)
    chunks = warc.read_chunks(archives, folder, chunk=300_000).orderBy("chunk_no").collect()
    assert b"".join(r["data"] for r in chunks) == body.encode() and [r["is_last"] for r in chunks] == [False, False, False, True]
    for r in chunks:
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body.encode()[: r["payload_bytes"]]).digest()).decode()


def test_plans_use_up_the_histogram():
    rnd = random.Random(6)
    for lengths in ([], [2048] * 5, [1] * 5000, [rnd.randint(1, 2048) for _ in range(3000)], [700, 700, 700, 648, 648] * 400, [3] * 2000 + [2047] * 100):
        have = dict(pd.Series(lengths, dtype=int).value_counts())
        plan = packing.plan_patterns(have, 2048)
        used = {}
        for pattern, n in plan.items():
            assert sum(pattern) <= 2048
            for x in pattern:
                used[x] = used.get(x, 0) + n
        assert used == have
        least = -(-sum(lengths) // 2048)
        assert sum(plan.values()) <= max(least * 1.01 + 2, len(lengths) if lengths and min(lengths) > 1024 else 0, sum(packing.best_fit(have, 2048).values()) + 1)


def test_packing(spark, docs, plain):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    ids = {i: np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4") for i, t in zip(plain.doc_id, plain.text)}
    rows = packing.pack_documents(docs, path).toPandas()
    assert rows.length.sum() == sum(map(len, ids.values())) and rows.length.max() <= 2048
    for r in rows.itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and (r.piece == 0 or r.length == 2048)
    by = rows.sort_values(["sequence_id", "offset"])
    assert (by.groupby("sequence_id").length.cumsum() - by.length == by.offset).all() and by.groupby("sequence_id").length.sum().max() <= 2048
    odd = packing.pack_documents(odd_docs(spark), path, ids=True).toPandas()
    assert (odd.groupby(["doc_id", "piece"]).size().loc[[(3, 0), (1, 0)]] == 1).all() and all(len(x) == n for x, n in zip(odd.ids, odd.length))
    assert packing.pack_documents(docs.where("false"), path).count() == 0


def test_token_files(spark, docs, plain):
    from noticeflow.llm.shared import Scratch
    from tokenizers import Tokenizer

    path, folder = vocabulary("word_bpe_49k.json"), Scratch(spark, "t").path("orc")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    token_orc.write_token_orc(docs, folder, path, end_id=1)
    got = token_orc.span_checksums(token_orc.token_spans(spark, folder)).toPandas().sort_values("doc_id").reset_index(drop=True)
    ids = [np.array(library.encode(t, add_special_tokens=False).ids + [1], "<u4") for t in plain.text]
    n = np.array([len(x) for x in ids])
    assert got.doc_id.tolist() == plain.doc_id.tolist() and (got.n_tokens == n).all() and (got.start == n.cumsum() - n).all()
    assert got.ids_crc32.tolist() == [zlib.crc32(x.tobytes()) for x in ids]
    assert token_orc.find_tokens(spark, folder, [int(plain.doc_id[5])]).first()["ids"] == ids[5].tolist()
    other = Scratch(spark, "t").path("orc")
    token_orc.write_token_orc(odd_docs(spark), other, path, end_id=1)
    assert token_orc.read_token_orc(spark, other).count() == 5
    none = Scratch(spark, "t").path("orc")
    token_orc.write_token_orc(docs.where("false"), none, path, end_id=1)
    assert token_orc.token_spans(spark, none).count() == 0


def test_token_files_are_in_order(spark, docs, plain, tmp_path):
    """Every file ascends by doc_id and files don't overlap, also where a doc_id has most of the rows; no sort stands behind the encoder."""
    from pyarrow import orc

    rows = docs.withColumn("doc_id", F.when(F.col("doc_id") % 4 > 0, 7).otherwise(F.col("doc_id")))
    token_orc.write_token_orc(rows, f"file://{tmp_path}/orc", vocabulary("word_bpe_49k.json"), end_id=1)
    files = [orc.ORCFile(str(f)).read().to_pandas() for f in tmp_path.glob("orc/*.orc")]
    files = sorted((t for t in files if len(t)), key=lambda t: t["range"].iloc[0])
    assert len(files) >= 4 and sum(map(len, files)) == len(plain)
    whole = [i for t in files for i in t.doc_id]
    assert whole == sorted(whole) and all((t.range_start == t.n_tokens.cumsum() - t.n_tokens).all() and (t["range"] == t["range"].iloc[0]).all() for t in files)
    assert sum(7 in set(t.doc_id) for t in files) > 1


def test_quality_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.fit_quality(docs, labels)
    rows = quality.score_quality(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert ((rows.score - rows.quality) ** 2).mean() < 0.03
    assert (rows.predicted == rows.quality).mean() > 0.97 and rows.score.between(0, 1).all()
    assert (rows.loc[rows.quality == 1, "predicted"] == 1).mean() > 0.985 and (rows.loc[rows.quality == 0, "predicted"] == 0).mean() > 0.9
    held = {r["doc_id"]: r["held_out"] for r in quality.score_quality(docs, model).select("doc_id", "held_out").collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in held.items())
    odd = quality.score_quality(odd_docs(spark), model).collect()
    assert len(odd) == 5 and all(0 <= r["score"] <= 1 for r in odd)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0.7 * docs.count() < kept.count() < docs.count()


def test_dictionaries_are_made_of_all_texts(spark):
    rows = [(i, i % 2, f"<{i}>" * 900) for i in range(2000)]
    made = quality.build_dictionaries(spark.createDataFrame(rows, "doc_id long, quality int, text string"), most=256 * 1024)
    for q in (0, 1):
        assert all(f"<{i}>".encode() in made[q] for i, own, _ in rows if own == q)
        assert 0.9 * 256 * 1024 < len(made[q]) <= 256 * 1024
    places = "".join(f"({i:05})" for i in range(2800))
    share = quality.shares([(i, len(places)) for i in range(1000)], 256 * 1024)
    assert len(set(share.values())) == 1 and len(share) == 1000
    got = sorted({int(x) for i in range(1000) for x in re.findall(rb"\((\d{5})\)", quality.cut_to(places.encode(), zlib.crc32(str(i).encode()), share[i]))})
    assert got[0] < 50 and got[-1] > 2750 and max(np.diff(got)) < 50
    assert quality.shares([(1, 1), (2, 0), (3, 5000)], 256 * 1024) == {1: 2, 3: 5001} and quality.cut_to(b"b" * 5000, 3, 5001) == b"b" * 5000
    assert quality.shares([]) == {} and quality.build_dictionaries(spark.createDataFrame([], "doc_id long, quality int, text string")) == {0: b"", 1: b""}


def test_scores_equal_brute_force(spark, docs):
    """Each score, worked out again from the two compressed sizes."""
    import math

    import zstandard

    model = quality.fit_quality(docs, table(spark, SF, "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).collect()}

    def size(raw, body):
        held = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw))

    for i, text in list(texts.items())[:60]:
        raw = (text or "").encode()
        good, bad = size(raw, model["good"]), size(raw, model["bad"])
        d, e, s = (bad - good) / (bad + good), (bad - good) / (len(raw) + 16), math.log(1 + len(raw)) / 10
        terms = [d, e, d * s, e * s, d**2, e**2, d * e, d * s**2, e * s**2, s]
        z = model["weights"][0] + sum(w * (t - m) / v for w, t, m, v in zip(model["weights"][1:], terms, model["mean"], model["spread"]))
        assert abs(got[i] - 1 / (1 + math.exp(-max(-40, min(40, z))))) < 1e-9


def test_labels_that_count_for_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)] * 2 + [(None, "x"), (3, None)], "doc_id long, text string").withColumns({"quality": F.lit("clash"), "half": F.lit(1)})
    labels = spark.createDataFrame([(i, q) for i in range(40) for q in {i % 2, (i // 20) % 2}] + [(1, None), (None, 1), (49, 7)], "doc_id long, quality int")
    rows, share = quality.labelled_sample(docs, labels, Scratch(spark, "t"))
    found = {r["doc_id"]: (r["quality"], r["text"]) for r in rows.collect()}
    want = {i: i % 2 for i in range(40) if i % 2 == (i // 20) % 2 and zlib.crc32(str(i).encode()) % 5}
    assert {i: q for i, (q, _) in found.items()} == want and rows.count() == len(want) and abs(share - sum(want.values()) / len(want)) < 1e-9


def test_quality_without_labels(spark, docs):
    none = table(spark, SF, "labels").where("false")
    model = quality.fit_quality(docs, none)
    assert {r["score"] for r in quality.score_quality(docs, model).collect()} == {0.5} and quality.keep_good(docs, none).count() == docs.count()


def test_quality_that_cannot_be_fitted_keeps_all(spark, docs):
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
    for labels in (ids.withColumn("quality", F.lit(0)), ids.withColumn("quality", F.lit(1)), ids.limit(5).withColumn("quality", F.lit(0))):
        assert quality.keep_good(docs, labels).count() == docs.count()
