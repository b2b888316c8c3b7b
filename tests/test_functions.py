from pyspark.sql import functions as F

from noticeflow.functions import dates as D
from noticeflow.functions import status as S
from noticeflow.functions import text as T


def one(spark, value, make, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in value], f"v {kind}").select(make(F.col("v"))).collect()]


def test_parse_date(spark):
    given = ["06/01/2024", "on 2024-06-03", "June 1, 2024", "Jun 16 2024", "04/08/26 AT 9:30 AM", "garbage", "", None, "2024-02-30", "13/45/2024 or 2024-01-02", "Foo 1, 2024"]
    want = ["2024-06-01", "2024-06-03", "2024-06-01", "2024-06-16", "2026-04-08", None, None, None, None, "2024-01-02", None]
    assert [str(d) if d else None for d in one(spark, given, D.parse_date)] == want


def test_slugs_and_companies(spark):
    assert one(spark, ["Café Foo", "   ", "--Prefix Suffix--", None], T.slugify) == ["caf-foo", "unknown", "prefix-suffix", "unknown"]
    assert one(spark, ["Acme Fiber LLC", "Metro Inc.", "Big Corp", "", None], T.normalize_company) == ["ACME FIBER", "METRO", "BIG", None, None]


def test_small_text_functions(spark):
    assert one(spark, [" a  b\n c ", "   ", None], T.clean_str) == ["a b c", None, None]
    assert one(spark, ["2609013001", "TN20240601-100001", "123", None], T.valid_ticket_number) == [True, True, False, False]
    assert one(spark, ["a/b\\c:d"], T.safe_file_key) == ["A_B_C_D"]
    assert one(spark, ['<a & "b">\n'], T.nl2br) == ["&lt;a &amp; &quot;b&quot;&gt;<br>"]
    assert one(spark, ["1.5", " -2 ", "1.0d", "", None], D.parse_float) == [1.5, -2.0, None, None, None]
    assert one(spark, [1, 2], lambda n: T.subject_line(n, 4), "int") == ["Reminder: 1 relevant ticket expire in 4 days", "Reminder: 2 relevant tickets expire in 4 days"]
    assert sorted(["a10", "a9", "A1"], key=lambda s: one(spark, [s], T.natural_sort_key)[0]) == ["A1", "a9", "a10"]


def test_first_seen(spark):
    got = spark.sql("SELECT array('Gas', 'gas', 'Water', 'GAS') AS a").select(T.first_seen_distinct(F.col("a"), True), T.first_seen_distinct(F.col("a"))).first()
    assert got[0] == ["Gas", "Water"] and got[1] == ["Gas", "gas", "Water", "GAS"]


def test_jaccard(spark):
    rows = spark.createDataFrame([(["a", "b"], ["a", "b"]), (["a"], ["b"]), ([], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [round(r[0], 4) for r in rows.select(T.token_jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1.0, 0.3333]


def test_utility_status(spark):
    rows = [("open", None), ("Open ", "Locate  Delayed"), ("closed", "located - facilities marked"), ("closed", None), ("closed", "In Conflict"), ("x", "y")]
    got = spark.createDataFrame(rows, "s string, r string").select(S.utility_status(F.col("s"), F.col("r"))).collect()
    assert [r[0] for r in got] == ["pending", "delayed", "located", "unknown", "not_clear", "unknown"]


def test_states_and_buckets(spark):
    assert one(spark, [None, -3, 4, 7, 8], S.urgency_bucket, "int") == [S.URGENCY[i] for i in (0, 1, 1, 2, 3)]
    assert one(spark, [0.85, 0.5, 0.3, 0.1], S.score_band, "double") == ["high", "medium", "low", "minimal"]
    assert one(spark, [25.0, 75.0, 150.0, 150.1], S.confidence, "double") == ["high", "medium", "low", "none"]
    assert one(spark, ["html_parse_error", "new"], S.failure_label) == ["HTML parse error", "new"]


def test_colors_keep_their_distance(spark):
    import hashlib

    names = [f"name {i}" for i in range(60)]
    got = one(spark, names, S.stable_color)
    for name, color in zip(names, got):
        b, g, r = (int(color[i : i + 2], 16) for i in (0, 2, 4))
        assert all((r - x) ** 2 + (g - y) ** 2 + (b - z) ** 2 >= 6400 for x, y, z in S.RESERVED_RGB)
    for name, color in zip(names, got):
        for seed in range(65):  # the first seed whose colour is far from all reserved ones
            h = hashlib.md5(f"{name}|{seed}".encode()).hexdigest()
            if all(sum((int(h[2 * i : 2 * i + 2], 16) - v) ** 2 for i, v in enumerate(rgb)) >= 6400 for rgb in S.RESERVED_RGB):
                assert color == h[4:6] + h[2:4] + h[:2]
                break
        else:
            raise AssertionError("no seed gives a colour")


def test_white_space_of_any_kind(spark):
    rows = spark.createDataFrame([("\u00a0\t x y \n\u3000",), (" \u2028\n",), (None,)], "v string")
    assert [r[0] for r in rows.select(T.blank_to_null(F.col("v"))).collect()] == ["x y", None, None]
    states = spark.createDataFrame([("Open", None), ("Open", ""), ("Open", " \n"), (" open\t", "Locate  \u00a0 Delayed ")], "s string, r string")
    assert [r[0] for r in states.select(S.utility_status(F.col("s"), F.col("r"))).collect()] == ["pending", "pending", "unknown", "delayed"]


def test_day_arithmetic(spark):
    row = spark.sql("SELECT TIMESTAMP '2024-04-08 12:00:00' AS now, DATE '2024-04-09' AS d").select(
        D.days_until_ceil(F.col("d"), F.col("now")), D.format_day(F.lit("2024-04-08 12:00:00").cast("timestamp")), D.time_ago(F.lit("2024-04-08 10:59:00").cast("timestamp"), F.col("now")),
        D.fmt_size(F.lit(2304)), D.epoch_ms_to_date(F.lit("1712534400000")), D.target_date(F.col("now")),
    ).first()
    assert [str(x) for x in row] == ["1", "Apr 8, 2024", "1h ago", "2.2 KB", "2024-04-08", "2024-04-12"]
