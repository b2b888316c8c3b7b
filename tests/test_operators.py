import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from noticeflow.functions.text import tokens
from noticeflow.operators import cdc, cluster, extract, filters, policy, rule_index, score, spatial, views
from noticeflow.operators import utilities as U
from noticeflow.operators.score import Rule, Ruleset
from noticeflow.plans import pages_and_places

def today():
    return F.lit("2026-04-24").cast("date")


STRUCT = "array<struct<code:string,name:string,facility:string,row_status:string,last_response:string,response_timestamp:string,status:string,is_late:boolean>>"


def u(code, status, late=False, response=None):
    return (code, "", "", "", response, None, status, late)


@pytest.fixture(scope="module")
def view(spark):
    d = lambda s: dt.date(2026, *map(int, s.split("-")))
    rows = [
        ("T1", "NORTH RIDGE CONTRACTORS", d("4-10"), d("4-27"), False, [u("NES", "clear"), u("MWS", "clear")], True, False, [], []),
        ("T2", "DELTA CABLE", d("4-15"), d("4-30"), False, [u("GFI", "pending", True)], False, True, ["GFI"], []),
        ("T3", "NORTH RIDGE CONTRACTORS", d("4-4"), d("5-14"), False, [u("MWS", "delayed", False, "Locate Delayed")], False, False, [], ["MWS"]),
        ("T4", "DTX", d("4-24"), d("5-8"), False, [u("GFI", "pending"), u("NES", "pending")], False, False, [], []),
        ("T5", "DELTA CABLE", d("4-20"), d("5-5"), True, [], False, False, [], []),
        ("T6", "", d("4-10"), d("5-20"), False, [], False, False, [], []),
        ("T7", "NORTH RIDGE CONTRACTORS", d("4-8"), d("4-26"), False, [u("B01", "pending", True), u("MWS", "not_clear", False, "In Conflict")], False, True, ["B01"], ["MWS"]),
        ("T8", "DTX", d("3-20"), d("4-20"), False, [u("NES", "clear")], True, False, [], []),
    ]
    schema = f"ticket_number string, excavator_name string, call_date date, expiration_date date, is_cancelled boolean, utility_statuses {STRUCT}, is_ready_to_dig boolean, has_late_utility boolean, late_utility_codes array<string>, blocking_utility_codes array<string>"
    df = spark.createDataFrame(rows, schema).withColumns({"county": F.lit("Davidson"), "location_text": F.lit(""), "intersection_text": F.lit(""), "done_for": F.lit("")})
    return views.ticket_view(df, today())


def keys(df):
    return sorted(r["ticket_number"] for r in df.collect())


def test_slices(view):
    slices = views.export_slices(today())
    got = {}
    for r in views.stack_slices(view, slices).select("slice", "ticket_number").collect():
        got.setdefault(r["slice"], []).append(r["ticket_number"])
    want = {
        "relevant_active": ["T1", "T2", "T3", "T4", "T6", "T7", "T8"], "relevant_expiring_4d": ["T1", "T7", "T8"], "relevant_expiring_7d": ["T1", "T2", "T7", "T8"],
        "relevant_late_utilities": ["T2", "T7"], "relevant_blocked": ["T3", "T7"], "relevant_new_24h": ["T4"], "relevant_cancelled_7d": ["T5"],
    }
    assert {k: sorted(v) for k, v in got.items()} == want


def test_view_and_summary(view):
    rows = {r["ticket_number"]: r for r in view.collect()}
    assert rows["T8"]["days_until_expire"] == -4 and rows["T8"]["status"] == "expired" and rows["T1"]["status"] == "expiring_soon"
    assert [rows[f"T{i}"]["utility_summary"] for i in (1, 2, 3, 4, 7)] == ["2 clear", "1 late (GFI)", "1 delayed (MWS)", "2 pending", "1 late (B01), 1 in conflict (MWS)"]


def test_utility_detail(view):
    assert U.utility_detail(view, today()).count() == 9


def test_contractor_rollup(view):
    rows = views.sort_rollup(views.contractor_rollup(view, today())).collect()
    first = rows[0]
    assert first["excavator_name"] == "NORTH RIDGE CONTRACTORS"
    assert [first[c] for c in ("active_count", "expiring_4d_count", "expiring_7d_count", "late_utilities_count", "blocked_count")] == [3, 2, 2, 1, 2]
    delta = next(r for r in rows if r["slug"] == "delta-cable")
    assert delta["active_count"] == 1 and delta["cancelled_last_7d_count"] == 1


def test_rollup_of_statuses(spark):
    rows = [("a", dt.date(2026, 4, 20), False, [u("X", "pending")]), ("b", dt.date(2026, 4, 23), False, [u("X", "pending")]), ("c", dt.date(2026, 4, 1), True, [u("X", "pending")]),
            ("d", None, False, [u("X", "pending")]), ("e", None, False, []), ("f", None, False, [u("X", "clear"), u("Y", "located")]), ("g", None, False, [u("X", "delayed"), u("Y", "not_clear")]), ("h", None, None, None)]
    df = spark.createDataFrame(rows, f"k string, call_date date, is_cancelled boolean, utility_statuses {STRUCT}")
    got = {r["k"]: r for r in U.utility_rollup(df, F.lit("2026-04-24 12:00:00").cast("timestamp")).collect()}
    assert [got[k]["has_late_utility"] for k in "abcd"] == [True, False, False, False]
    assert not got["e"]["is_ready_to_dig"] and got["f"]["is_ready_to_dig"] and got["g"]["blocking_utility_codes"] == ["X", "Y"] and got["h"]["is_ready_to_dig"] is False


RULES = Ruleset(
    [Rule("nf", "northstar fiber", 1.0), Rule("fi", r"fiber\s+install", 0.75, kind="regex"), Rule("ftth", "ftth", 0.85), Rule("fiber", "fiber", 0.3), Rule("m", "Meridian Cable", 1.0, "done_for"), Rule("w", "^water/sewer$", 0.5, "work_type", "regex", negative=True)],
    0.45, ["north ridge"], ["conduit", "fiber"], include=["t9"], exclude=["T8"],
)


def test_scores(spark):
    rows = [("T1", None, None, None, None), ("T2", "Acme", "fiber", "", None), ("T3", "A", "x", "FTTH fiber  install", "Northstar Fiber"), ("T4", "a", "Water/Sewer", "fiber install", None), ("T5", "NORTH-RIDGE Inc", "conduit work", "", None),
            ("T6", "North Ridge", "plumbing", "", None), ("T8", "", "", "northstar fiber", None), ("T9", "", "", "", None), ("T10", "", "water/sewer", "", "x")]
    df = spark.createDataFrame(rows, "ticket_number string, excavator_name string, work_type string, remarks string, done_for string")
    got = {r["ticket_number"]: r for r in score.score(df, RULES).collect()}
    assert [got[f"T{i}"]["relevance_score"] for i in (1, 2, 3, 4, 5, 6, 8, 9, 10)] == [0.0, 0.3, 1.0, 0.5, 0.45, 0.0, 0.0, 1.0, 0.0]
    assert [got[f"T{i}"]["is_relevant"] for i in (2, 4, 5, 6, 8, 9)] == [False, True, True, False, False, True]
    assert got["T4"]["relevance_reasons"] == ["+fi(w=0.75)", "+fiber(w=0.30)", "-w(w=-0.50)"] and got["T5"]["relevance_reasons"] == ["+contractor_rule_match"]
    assert score.explain(df, RULES).where("ticket_number = 'T4'").count() == 3
    with pytest.raises(ValueError):
        score.score(df, Ruleset([Rule("x", "a", 1.0, "place")]))


def test_indexed_rules_equal_one_by_one(spark):
    """3,000 rules of all kinds and fields by the index; 120 of them against the expressions of each."""
    rnd = random.Random(11)
    words = ["fiber", "drop bury", "FTTH", "water main", "Ünï", "a", "it's", "main st", "50%", "back\\slash"] + ["w%d x" % i for i in range(40)]
    text = lambda: rnd.choice([None, "", " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6)))])
    rows = [(str(i), text(), text(), text(), [rnd.choice(words)] if i % 3 else None) for i in range(150)]
    df = spark.createDataFrame(rows, "ticket_number string, excavator_name string, work_type string, remarks string, utility_codes array<string>")
    regexes = [r"fiber\s+drop", r"^w1", r"(drop|main) ?st", r"w[0-9]+ x w", r"ma?in st", "bury+", r"w\d{2} x", "50%", r"it's.*fiber", r"x{1,2} drop"]
    rules = []
    for i in range(120):
        kind = rnd.choice(["contains", "exact", "regex"])
        pattern = rnd.choice(regexes) if kind == "regex" else rnd.choice(words) if rnd.random() < 0.7 else f"{rnd.choice(words)} {rnd.choice(words)}"
        rules.append(Rule(f"r{i}", pattern, rnd.choice([0.05, 0.1, 0.3]), rnd.choice(["any", "remarks", "work_type", "utility_codes", "done_for"]), kind, rnd.random() < 0.4, rnd.random() < 0.3))
    given = {"contractors": ["fiber"], "work_keywords": ["main"], "include": ["3"], "exclude": ["4"]}
    want = sorted(map(str, score.score(df, Ruleset(rules, 0.45, **given)).collect()))
    assert sorted(map(str, rule_index.score_many(df, Ruleset(rules, 0.45, **given)).collect())) == want
    fired = sorted((r["ticket_number"], r["rule_id"], r["weight"]) for r in score.explain(df, Ruleset(rules)).collect())
    assert sorted(map(tuple, rule_index.explain_many(df, rules).collect())) == fired and len(fired) > 100
    more = [Rule(f"m{i}", f"no such party {i}", 0.1) for i in range(2880)]
    assert sorted(map(tuple, rule_index.explain_many(df, more + rules).collect())) == fired
    assert [rule_index.fixed_part(Rule("", p, 1.0, kind="regex")) for p in (r"fiber\s+drop", "colou?r bands", "a|bcdef", r"w[0-9]", "(ab)?long part", "((ab)cdef)?gh", "(abc){0,2}defg", r"\\x41bcd", r"\\.{2}abcd")] == ["fiber", "r bands", "", "", "long part", "", "", "", ""]
    with pytest.raises(ValueError):
        rule_index.score_many(df, Ruleset([Rule("x", "a", 1.0, "place")]))


def test_a_filter_on_scores_copies_no_rule(spark):
    df = spark.createDataFrame([("1", "FIBER Co", "conduit", "x")], "ticket_number string, excavator_name string, work_type string, remarks string")
    rules = Ruleset([Rule("a", "needle one", 0.5), Rule("b", "needle two", 0.5, kind="regex")], 0.45, contractors=["fiber"], work_keywords=["conduit"])
    found = score.score(df, rules)
    plan = views.by_county(found.withColumns({"county": F.lit("K"), "status": F.lit("active"), "expiration_date": today()}), today())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("needle one") == 1 and plan.count("needle two") == 1 and plan.count("fiber") == 1
    assert [(r["is_relevant"], r["relevance_score"], r["relevance_reasons"]) for r in found.where("is_relevant").collect()] == [(True, 0.45, ["+contractor_rule_match"])]


def test_text_fields_copy_no_search(spark):
    """Each pattern of a labelled text stands in the plan once, however often what it finds is read."""
    df = spark.createDataFrame([("1", "Call Date: June 1, 2024\r\nCounty: Knox\rUtility: Acme Gas\nutility: ACME GAS")], "id string, text string")
    found = extract.extract_fields(df)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("date\\s*called") == 1 and plan.count("valid\\s*until") == 1 and plan.count("utility[:") == 1
    r = found.first()
    assert (str(r["call_date"]), r["county"], r["utility_references"], found.columns[:2]) == ("2024-06-01", "Knox", ["Acme Gas", "Acme Gas\nutility"], ["id", "text"]) and "__plain" not in found.columns


def test_rules_that_are_a_table(spark):
    """Rules of all kinds and fields as a table, some of them alike, equal the expressions of each; long patterns share no anchor."""
    rnd = random.Random(12)
    words = ["fiber", "drop bury", "FTTH", "water main", "Ünï", "a", "it's", "main st", "50%", "back\\slash", "Customer#000000012", "Customer#000000013"]
    text = lambda: rnd.choice([None, "", "\n".join(rnd.choice(words) for _ in range(rnd.randint(1, 6)))])
    df = spark.createDataFrame([(str(i), text(), text(), [rnd.choice(words)] if i % 3 else None) for i in range(90)], "ticket_number string, work_type string, remarks string, utility_codes array<string>")
    rules = [Rule(f"c{i}", f"CUSTOMER#{i:09d}", 0.25, "remarks", negative=True) for i in range(500)]
    for i in range(60):
        kind = rnd.choice(["contains", "exact", "regex"])
        pattern = rnd.choice([r"fiber\s+drop", r"^w", r"(drop|main) ?st", "50%"]) if kind == "regex" else rnd.choice(words)
        rules.append(Rule(f"r{i % 50}", pattern, rnd.choice([0.05, -0.1]), rnd.choice(["any", "remarks", "utility_codes", "done_for"]), kind, rnd.random() < 0.4, rnd.random() < 0.3))
    kind = "id string, pattern string, weight double, field string, kind string, case_sensitive boolean, negative boolean"
    table = spark.createDataFrame([(r.id, r.pattern, r.weight, r.field, r.kind, r.case_sensitive, r.negative) for r in rules], kind)
    want = sorted((r["ticket_number"], r["rule_id"], r["weight"]) for r in score.explain(df, Ruleset(rules[12:14] + rules[500:])).collect())
    assert sorted(map(tuple, rule_index.explain_table(df, table).collect())) == want and len(want) > 100
    assert rule_index.explain_table(df, table.where("false")).count() == 0 and rule_index.explain_table(df.where("false"), table).count() == 0
    with pytest.raises(ValueError):
        rule_index.explain_table(df, table.withColumn("field", F.lit("place")))


def test_prefilter(spark):
    rows = [("MERIDIAN CABLE CONSTRUCTION", "", ""), ("NORTHSTAR FIBER 6459663", "", ""), ("", "", "NORTH RIDGE CONTRACTORS"), ("", "FIBER INSTL", ""), ("CENTURY COMMUNITIES", "WATER SEWER REPAIR", "RANDOM PLUMBER"), ("JEFF MERIDIAN", None, None)]
    df = spark.createDataFrame(rows, "d string, w string, e string")
    got = df.select(filters.worth_detail_fetch(F.col("d"), F.col("w"), F.col("e"), ["meridian cable", "northstar", "fiber"], ["north ridge"])).collect()
    assert [r[0] for r in got] == [True, True, True, True, False, False]


def test_leader_cluster_equals_the_plain_loop(spark, monkeypatch):
    rnd = random.Random(5)
    for t, local in ((0.5, 0), (0.6, 0), (0.6, 20), (0.5, 4096)):
        monkeypatch.setattr(cluster, "LOCAL_ROWS", local)
        sets = [sorted({rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 5))}) for _ in range(150)]
        want = plain_leaders([set(s) for s in sets], t)
        df = spark.createDataFrame(list(enumerate(sets)), "k long, w array<string>")
        got = {r["k"]: r["leader"] for r in cluster.leader_cluster(df, "k", "w", t).collect()}
        assert [got[i] for i in range(len(sets))] == want


def plain_leaders(sets, t):
    leaders, out = [], []
    for i, s in enumerate(sets):
        home = next((a for a in leaders if (len(s & sets[a]) / len(s | sets[a]) if s | sets[a] else 1.0) >= t), None)
        if home is None:
            leaders.append(i)
        out.append(i if home is None else home)
    return out


def test_leaders_of_a_chain_and_of_a_crowd(spark, monkeypatch):
    """A chain of 2,000 parties, each like the next, takes no more rounds than a short one; 600 alike are one cluster."""
    chain = [{f"w{i + j}" for j in range(9)} for i in range(2000)]
    crowd = [{"common", "party", "name", "of", "all", "the", "same", f"x{i}"} for i in range(600)]
    sets = chain + crowd
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "k long, w array<string>")
    rounds = []
    elected = cluster._elected
    monkeypatch.setattr(cluster, "_elected", lambda *a: rounds.append(1) or elected(*a))
    monkeypatch.setattr(cluster, "BLOCK", 100)
    monkeypatch.setattr(cluster, "LOCAL_ROWS", 0)
    got = {r["k"]: r["leader"] for r in cluster.leader_cluster(df, "k", "w", 0.6).collect()}
    assert [got[i] for i in range(len(sets))] == plain_leaders(sets, 0.6) and len(rounds) <= 3
    monkeypatch.setattr(cluster, "LOCAL_EDGES", 3)  # components too large for one task go on with rounds
    short = [{f"w{i + j}" for j in range(9)} for i in range(30)]
    few = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(short)], "k long, w array<string>")
    got = {r["k"]: r["leader"] for r in cluster.leader_cluster(few, "k", "w", 0.6).collect()}
    assert [got[i] for i in range(30)] == plain_leaders(short, 0.6)


def test_leaders_of_odd_rows(spark):
    """Null arrays, null tokens, tokens with spaces and empty arrays: no row is lost or joined to another's tokens."""
    rows = [(1, ["a", "b"]), (2, ["a b"]), (3, None), (4, []), (5, ["c", None]), (6, ["c"]), (7, ["b", "a", "a"]), (8, [None])]
    df = spark.createDataFrame(rows, "k long, w array<string>").withColumns({"o": F.lit(1), "s": F.lit("s"), "leads": F.lit(0)})
    got = {r["k"]: r["leader"] for r in cluster.leader_cluster(df, "k", "w", 0.6).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5, 7: 1, 8: 3}
    assert cluster.leader_cluster(df.where("false"), "k", "w").count() == 0
    pairs, members = cluster.similar_groups(df, "k", "w", 0.6)
    assert pairs.count() == 0 and {(r["k"], r["representative"]) for r in members.collect()} == {(1, 1), (2, 2), (5, 5), (6, 5), (7, 1)}


def test_leaders_of_a_crowd_without_its_pairs(spark, monkeypatch):
    """20,000 parties alike behind 500 others: no list of pairs is made."""
    sets = [{f"w{i}", f"v{i}", "of"} for i in range(500)] + [{"common", "party", "name", "of", "all", "the", "same", f"x{i}"} for i in range(20_000)]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "k long, w array<string>")
    monkeypatch.setattr(cluster, "jaccard_pairs", None)
    got = {r["k"]: r["leader"] for r in cluster.leader_cluster(df, "k", "w", 0.6).collect()}
    assert got == {i: min(i, 500) for i in range(len(sets))}


def test_jaccard_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 7)
    rnd = random.Random(8)
    sets = [{rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 7))} for _ in range(90)]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "k long, w array<string>")
    for t in (0.3, 0.5, 0.8, 1.0):
        like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(90) for b in range(a) if sets[a] and sets[b]}
        want = {(b, a): round(v, 9) for (a, b), v in like.items() if v >= t}
        rows = cluster.jaccard_pairs(df, "k", "w", t).collect()
        assert {(r["a"], r["b"]): round(r["jaccard"], 9) for r in rows} == want and len(rows) == len(want)
        pairs, members = cluster.similar_groups(df, "k", "w", t)
        home = {r["k"]: r["representative"] for r in members.collect()}
        near = {(r["a"], r["b"]) for r in pairs.collect()}
        alike = lambda a, b: home[a] == home[b] or (min(home[a], home[b]), max(home[a], home[b])) in near  # noqa: B023, E731
        assert {(a, b) for a in home for b in home if a < b and alike(a, b)} == set(want) and set(home) == {k for k in range(90) if sets[k]}


def test_nearest_line_far_long_and_odd(spark):
    """NaN and far points, and a segment of 100 km, against every distance."""
    lines = [(1, "P1", -87.0, 36.0, -86.0, 36.4), (2, "P2", -86.5, 36.1, -86.5, 36.1), (3, "P3", -86.2, 35.9, -86.2, 36.05), (4, "P4", float("nan"), 36.0, -86.0, 36.0)]
    rnd = random.Random(3)
    points = [(i, 35.0 + rnd.random() * 3, -88.0 + rnd.random() * 3) for i in range(60)] + [(100, float("nan"), -86.5), (101, None, -86.5), (102, 36.1, -86.5), (103, 40.0, -80.0)]
    df = spark.createDataFrame(points, "k long, latitude double, longitude double")
    segs = spark.createDataFrame(lines, "project_id long, project_name string, x1 double, y1 double, x2 double, y2 double")
    got = {r["k"]: (r["project_id"], r["distance_m"]) for r in spatial.nearest_line(df, segs, "k").collect()}
    a, b = spatial.to_utm(F.col("x1"), F.col("y1")), spatial.to_utm(F.col("x2"), F.col("y2"))
    p = spatial.to_utm(F.col("longitude"), F.col("latitude"))
    d = spatial.point_segment_m(p[0], p[1], a[0], a[1], b[0], b[1])
    every = df.where("k < 100 OR k > 101").crossJoin(segs.where("project_id < 4")).groupBy("k").agg(F.min(F.struct(d.alias("d"), "project_id")).alias("m")).collect()
    assert {r["k"]: (r["m"]["project_id"], round(r["m"]["d"], 3)) for r in every} == {k: (i, round(v, 3)) for k, (i, v) in got.items()}
    assert spatial.nearest_line(df, segs.where("false"), "k").count() == 0 and spatial.nearest_line(df.where("false"), segs, "k").count() == 0


def test_places_that_rows_share_are_matched_once(spark, monkeypatch):
    """The projection runs on places, not on rows, and the rows of a place, and those of no place, come back whole."""
    seen, saved = [], spatial.Scratch.save
    monkeypatch.setattr(spatial.Scratch, "save", lambda self, df, name: seen.append((name, saved(self, df, name))) or seen[-1][1])
    df = spark.range(600).selectExpr("cast(id as string) AS ticket_number", "if(id % 10 = 0, null, 36 + (id % 3) / 1000D) AS latitude", "if(id % 20 = 0, null, -86.9D) AS longitude")
    lines = spark.createDataFrame([("p%d" % i, "P%d" % i, -86.9 + i / 1e5, 36.0, -86.9 + i / 1e5, 36.001) for i in range(100)], "project_id string, project_name string, x1 double, y1 double, x2 double, y2 double")
    got = spatial.match_projects(df, lines).groupBy("latitude", "project_name", "match_confidence").count().collect()
    assert sorted((r["latitude"] or 0, r["project_name"], r["match_confidence"], r["count"]) for r in got) == [(0, None, "none", 60), (36.0, "P0", "high", 180), (36.001, "P0", "high", 180), (36.002, "P0", "low", 180)]
    assert dict(seen)["points"].count() == 3


def test_match_stats_count_tickets_by_place_first(spark, monkeypatch):
    """The tickets are read once, into a row a place with its count, and the figures are those of the single rows."""
    df = spark.range(900).selectExpr("cast(id as string) AS ticket_number", "if(id % 10 = 0, null, if(id % 7 = 0, double('NaN'), 36 + (id % 3) / 1000D)) AS latitude", "if(id % 20 = 0, null, -86.9D) AS longitude")
    lines = spark.createDataFrame([("p", "P", -86.9, 36.0, -86.9, 36.001)], "project_id string, project_name string, x1 double, y1 double, x2 double, y2 double")
    single = views.match_stats(spatial.match_projects(df, lines))
    for rows, segs in ((df, lines), (df, lines.where("false")), (df.where("false"), lines)):
        assert views.match_stats(spatial.match_places(rows, segs), F.col("n")).collect() == views.match_stats(spatial.match_projects(rows, segs)).collect()
    assert single.first()["total"] == 900 and single.first()["skipped"] == 90
    given, match = [], spatial.match_projects
    monkeypatch.setattr(spatial, "match_projects", lambda tickets, *rest: given.append(tickets) or match(tickets, *rest))
    pages_and_places.match_stats(spark, "/root/testdata/sf0.001")
    assert given[0].count() == given[0].select("longitude", "latitude").distinct().count()


def test_nearest_line_of_far_points_and_dense_lines(spark, monkeypatch):
    """100,000 points, most of them far from all lines, and 3,000 short segments in one spot: cells stay small, the rest is far away."""
    monkeypatch.setattr(spatial, "CELL_SEGMENTS", 16)
    rnd = random.Random(4)
    spot = [(i, f"P{i}", x := -86.5 + rnd.random() * 0.01, y := 36.1 + rnd.random() * 0.01, x + 0.00005, y + 0.00003) for i in range(3000)]
    spot += [(9000 + i, "same", -86.4, 36.2, -86.4001, 36.2001) for i in range(500)] + [(9999, "long", -87.0, 36.3, -85.9, 36.0)]
    segs = spark.createDataFrame(spot, "project_id long, project_name string, x1 double, y1 double, x2 double, y2 double")
    near = F.rand(1) < 0.2
    points = spark.range(100_000).select(F.col("id").alias("k"), F.when(near, 36.1 + F.rand(2) * 0.01).otherwise(34 + F.rand(3)).alias("latitude"), F.when(near, -86.5 + F.rand(4) * 0.01).otherwise(-89 + F.rand(5)).alias("longitude"))
    points = points.unionByName(spark.createDataFrame([(100_001, 36.2, -86.4)], points.schema))
    got = {r["k"]: (r["project_id"], round(r["distance_m"], 4)) for r in spatial.nearest_line(points, segs, "k").collect()}
    assert len(got) == 100_001 and got[100_001] == (9000, got[100_001][1])
    a, b, p = spatial.to_utm(F.col("x1"), F.col("y1")), spatial.to_utm(F.col("x2"), F.col("y2")), spatial.to_utm(F.col("longitude"), F.col("latitude"))
    some = points.where("k % 997 = 0").select("k", F.array(*p).alias("q")).crossJoin(segs.select("project_id", F.array(*a).alias("a"), F.array(*b).alias("b")))
    d = spatial.point_segment_m(*[F.col(c)[i] for c in "qab" for i in (0, 1)])
    for r in some.groupBy("k").agg(F.min(F.struct(d.alias("d"), "project_id")).alias("m")).collect():
        assert got[r["k"]] == (r["m"]["project_id"], round(r["m"]["d"], 4))


def test_work_groups(spark):
    rows = [("1", "Acme Fiber LLC", "fiber", "Main St"), ("2", "Acme Fiber LLC", "fiber", "Main St"), ("3", "Metro Inc.", "water", "Oak")]
    df = spark.createDataFrame(rows, "ticket_number string, excavator_name string, work_type string, location_text string").withColumns({"probable_company": F.lit(None).cast("string"), "probable_work_group": F.lit(None).cast("string")})
    got = {r["ticket_number"]: (r["leader"], r["probable_work_group"]) for r in cluster.work_groups(df).collect()}
    assert got == {"1": ("1", "ACME FIBER"), "2": ("1", "ACME FIBER"), "3": ("3", "METRO")}


def test_tokens(spark):
    assert spark.range(1).select(tokens(F.lit("The Acme of TN"), F.lit("acme-9"))).first()[0] == ["acme", "9"]


def test_matching(spark):
    line = '{"type":"LineString","coordinates":[[-86.730,36.100],[-86.729,36.100]]}'
    far = '{"type":"MultiPolygon","coordinates":[[[[-80.0,36.0],[-80.0,36.1],[-80.1,36.1],[-80.0,36.0]]]]}'
    features = spark.createDataFrame([(7, "P7", line), (9, "P9", far), (10, "bad", "{")], "project_id long, project_name string, geometry string")
    points = [("on", 36.1, -86.7295), ("mid", 36.10045, -86.7295), ("low", 36.1009, -86.7295), ("none", 36.1018, -86.7295), ("lost", None, None), ("away", 36.5, -82.0)]
    df = spark.createDataFrame(points, "ticket_number string, latitude double, longitude double")
    lines = spatial.segments(features)
    assert lines.count() == 4
    got = {r["ticket_number"]: r for r in spatial.match_projects(df, lines).collect()}
    assert [got[k]["match_confidence"] for k in ("on", "mid", "low", "none", "lost", "away")] == ["high", "medium", "low", "none", "none", "none"]
    assert got["low"]["project_name"] == "P7" and got["none"]["project_name"] is None and got["none"]["match_distance_m"] > 150 and got["lost"]["match_distance_m"] is None
    assert got["on"]["match_distance_m"] < 5 and 100_000 < got["away"]["match_distance_m"] < 400_000


def test_nearest_line_equals_brute_force(spark):
    rnd = random.Random(2)
    segs = [(i, f"P{i}", -87 + rnd.random(), 36 + rnd.random(), -87 + rnd.random(), 36 + rnd.random()) for i in range(12)]
    pts = [(i, 36 + rnd.random() * 1.5, -87 + rnd.random() * 1.5) for i in range(60)]
    lines = spark.createDataFrame(segs, "project_id long, project_name string, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame(pts, "k long, latitude double, longitude double")
    got = {r["k"]: (r["project_id"], round(r["distance_m"], 3)) for r in spatial.nearest_line(points, lines, "k").collect()}
    a, b = spatial.to_utm(F.col("x1"), F.col("y1")), spatial.to_utm(F.col("x2"), F.col("y2"))
    p = spatial.to_utm(F.col("longitude"), F.col("latitude"))
    every = points.crossJoin(lines).withColumn("d", spatial.point_segment_m(*p, *a, *b)).groupBy("k").agg(F.min(F.struct("d", "project_id")).alias("m"))
    assert got == {r["k"]: (r["m"]["project_id"], round(r["m"]["d"], 3)) for r in every.collect()}


def test_geometry(spark):
    row = spark.range(1).select(spatial.haversine_m(F.lit(36.0), F.lit(-86.0), F.lit(37.0), F.lit(-86.0)), F.size(spatial.circle(F.lit(36.1), F.lit(-86.7)))).first()
    assert 110_000 < row[0] < 112_000 and row[1] == 33
    x, y = spatial.to_utm(F.lit(-86.730), F.lit(36.1)), spatial.to_utm(F.lit(-86.729), F.lit(36.1))
    assert abs(spark.range(1).select(F.sqrt(F.pow(y[0] - x[0], 2) + F.pow(y[1] - x[1], 2))).first()[0] - 90.01) < 0.05


def test_capture_twice_changes_nothing(spark):
    now = F.lit("2026-04-24 12:00:00").cast("timestamp")
    rows = spark.createDataFrame([("a", 1), ("b", None)], "ticket_number string, v int")
    none = rows.limit(0).withColumns({"latest_content_hash": F.lit(""), "created_at": now, "updated_at": now})
    first = cdc.capture_changes(rows, none, "ticket_number", now)
    assert cdc.run_stats(first).first().asDict() == {"found": 2, "new": 2, "changed": 0, "unchanged": 0} and cdc.snapshots(first, "ticket_number").count() == 2
    current = cdc.upsert_current(first, none, "ticket_number")
    assert cdc.run_stats(cdc.capture_changes(rows, current, "ticket_number", now)).first()["unchanged"] == 2
    moved = rows.withColumn("v", F.lit(3))
    again = cdc.capture_changes(moved, current, "ticket_number", now)
    assert cdc.run_stats(again).first()["changed"] == 2 and cdc.upsert_current(again, current, "ticket_number").count() == 2


def test_sync(spark):
    schema = "project_id long, owner string, status string"
    old = spark.createDataFrame([(1, "A", "x"), (2, "A", "x"), (3, "B", "x")], schema)
    new = spark.createDataFrame([(1, "A", "y"), (4, "A", "x")], schema)
    got = {r["project_id"]: r["action"] for r in cdc.sync_owner_scoped(new, old).collect()}
    assert got == {1: "updated", 2: "deleted", 3: "kept", 4: "new"}
    nobody = spark.createDataFrame([(1, None, "x")], schema)
    assert {r["project_id"]: r["action"] for r in cdc.sync_owner_scoped(nobody, old).collect()} == {1: "updated", 2: "deleted", 3: "deleted"}


def test_policy(spark):
    df = policy.classify(spark.createDataFrame([(1, 2)], "a int, b int"), {"a": "public", "b": "customer_private"})
    with pytest.raises(policy.BlockedColumns, match="b:customer_private"):
        policy.apply_export_policy(df)
    assert policy.apply_export_policy(df, ["public", "customer_private"]).columns == ["a", "b"]


PAGE = """<html><body><h2>Ticket</h2><table><tr><th>Ticket Number:</th><td>TN1</td></tr><tr><th>County</th><td> Davidson </td></tr></table>
<dl><dt>Remarks:</dt><dd>deep &amp; wide</dd></dl><div class="generalInformation"><h3>Response Status As Of</h3><table><tr><th>Status</th></tr>
<tr><td>Open</td><td>gfi</td><td class="name">Google Fiber<ul></ul></td><td>Telecom</td></tr>
<tr><td>Closed</td><td>NES</td><td>Electric<ul><li><b>1/1</b><span>No Response</span></li><li><b>1/2</b><span>Located -  Facilities Marked</span><div>ok</div></li></ul></td><td>Power</td></tr></table></div></body></html>"""
PLAIN = "<table><tr><td>County:</td><td>Knox</td><td>Expire Date:</td><td>04/08/2026</td></tr></table><table><tr><td>Code</td><td>Name</td></tr><tr><td>b01</td><td>x</td></tr><tr><td>B01</td><td>y</td></tr></table><p>void</p><span>VOIDED</span>"


def test_pages(spark):
    df = spark.createDataFrame([(1, PAGE), (2, PLAIN), (3, None), (4, "<p>avoid</p>")], "page_id long, html string")
    items = extract.page_items(df)
    fields = {r["page_id"]: r for r in extract.map_labels(items).collect()}
    assert (fields[1]["ticket_number"], fields[1]["county"], fields[1]["remarks"]) == ("TN1", "Davidson", "deep & wide")
    assert (fields[2]["county"], fields[2]["expiration_date"]) == ("Knox", "04/08/2026")
    got = [(r["code"], r["name"], r["status"], r["response_count"], r["last_response"]) for r in extract.page_responses(items).orderBy("pos").collect()]
    assert got == [("GFI", "Google Fiber", "pending", 0, None), ("NES", "Electric", "located", 2, "Located -  Facilities Marked")]
    assert {r["page_id"]: r["utility_codes"] for r in extract.page_codes(items).collect()} == {1: ["GFI", "NES"], 2: ["B01"], 3: [], 4: []}
    assert {r["page_id"]: r["is_cancelled"] for r in extract.page_flags(items).collect()} == {1: False, 2: True, 3: False, 4: False}


def test_texts(spark):
    text = "Ticket Number: TN20240601-100001\nCounty: Davidson\nCall Date: 06/01/2024\nLegal Start: 06/03/2024\nExpiration: 06/16/2024\nExcavator: Acme Fiber LLC\nWork Type: Drop\nUtility: NES Electric\nMetro Water: yes"
    df = spark.createDataFrame([(1, text), (2, "see TN20240602-100002 from 06/01/2024 to 06/20/2024, voided"), (3, None)], "id long, text string")
    got = {r["id"]: r for r in extract.extract_fields(df, county_hint="Knox").collect()}
    assert [str(got[1][c]) for c in ("ticket_number", "county", "call_date", "legal_start_date", "expiration_date", "excavator_name", "is_cancelled")] == ["TN20240601-100001", "Davidson", "2024-06-01", "2024-06-03", "2024-06-16", "Acme Fiber LLC", "False"]
    assert "NES Electric" in got[1]["utility_references"] and any("Metro Water" in m for m in got[1]["utility_references"])
    assert [str(got[2][c]) for c in ("ticket_number", "county", "call_date", "expiration_date", "is_cancelled")] == ["TN20240602-100002", "Knox", "None", "2024-06-20", "True"]
    assert got[3]["ticket_number"] is None and got[3]["utility_references"] == []


def test_normalize(spark):
    rows = spark.createDataFrame([("a1", "Knox", "03/24/2026", "04/08/2026", "Acme", "x", "Normal", None, None), ("a2", "Knox", None, None, None, None, "Cancelled", None, None)],
        "ticket_number string, county string, call_date_raw string, expiration_date_raw string, excavator_name_raw string, work_type_raw string, status_raw string, work_done_for_raw string, remarks_raw string")
    details = spark.createDataFrame([("a1", "Page Co", "36.5", "junk")], "ticket_number string, excavator_name string, latitude string, longitude string")
    got = {r["ticket_number"]: r for r in views.normalize_tickets(rows, details, F.lit("2026-04-01 00:00:00").cast("timestamp")).collect()}
    assert (got["A1"]["excavator_name"], got["A1"]["latitude"], got["A1"]["longitude"], got["A1"]["status"], got["A1"]["parse_method"]) == ("Page Co", 36.5, None, "active", "html")
    assert (got["A2"]["status"], got["A2"]["parse_method"], got["A2"]["is_ready_to_dig"]) == ("cancelled", "row_only", False)


def test_trade_runs_equal_the_single_pattern(spark):
    """The runs that are found in linear time are those that one pattern with the trades inside finds, on hard texts too."""
    import re

    whole = re.compile(r"([A-Za-z\s&,]+(?:electric|gas|water|sewer|telecom|cable|fiber)[A-Za-z\s&,]*)\s*[:\-]", re.IGNORECASE)
    rnd = random.Random(13)
    bits = ["gas", "Gas", "water", "a", " ", "\n", ":", "-", ",", "&", "1", "fiber", "electric", "x gas y", "sewer:", "(", "cable -", "Metro Water"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(1500)] + ["gas " * 20_000, "gas:" * 5000, "a" * 50_000 + " water:"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r["i"]: r["r"] for r in df.select("i", extract.trade_runs(F.col("t")).alias("r")).collect()}
    for i, t in enumerate(texts):
        if len(t) < 1000:  # the single pattern takes quadratic time on the others
            assert got[i] == whole.findall(t), t
    assert got[1500] == [] and got[1501] == [] and len(got[1502]) == 1


def test_positions_of_an_order(spark):
    df = spark.createDataFrame([(i, (i * 7919) % 1000) for i in range(3000)], "i long, v long")
    got = {r["i"]: r["position"] for r in views.numbered(df.orderBy("v", "i")).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == [i for i, _ in sorted(((i, (i * 7919) % 1000) for i in range(3000)), key=lambda x: (x[1], x[0]))]
    assert sorted(got.values()) == list(range(1, 3001)) and views.numbered(df.where("false").orderBy("v")).count() == 0


def test_rules_from_a_table(spark):
    table = spark.createDataFrame([("b", "fiber", 0.3, None, None), ("a", "^x", 0.2, "remarks", "regex")], "id string, pattern string, weight double, field string, kind string")
    rules = score.ruleset_from(table, threshold=0.1)
    assert rules == Ruleset([Rule("a", "^x", 0.2, "remarks", "regex"), Rule("b", "fiber", 0.3)], threshold=0.1)
