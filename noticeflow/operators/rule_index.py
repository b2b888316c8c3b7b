"""Scoring with thousands of rules: an index of short runs of characters finds the few rules that may fire in a text.

Each rule has an anchor, a run of GRAM characters that every text it fires in
must hold, chosen among those of its pattern as the one that fewest rules share.
The runs of a text that are anchors give its candidate rules; only these are
tested, exactly.  The work of a row grows with its text and its candidates, not
with the number of rules, and no expression is made for a rule.  Rules without
an anchor (short patterns, patterns without a fixed part) are tested on every row.

Rules that are a table of any size (explain_table) stay one: their anchors are
longer, so that long patterns share few, and are joined with the runs of the
distinct texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.operators.score import ANY_FIELDS, ANY_LISTS, Rule, Ruleset, _decided, _reason, any_text
from noticeflow.scratch import Scratch, spread_join

GRAM = 4
#: Lengths of anchors of rules that are a table: the longest that a pattern's fixed part has.
GRAMS = (64, 32, 16, 8, GRAM)


def fixed_part(rule: Rule) -> str:
    """The longest run of lower-cased ASCII that a text must hold for the rule to fire; '' if there is none to be sure of."""
    if rule.kind == "regex":
        # what stands outside groups and is not repeated, in patterns without choices, classes, flags, nested or counted groups
        if re.search(r"\||\(\?|\[|\\[xucQEpPkN0-9]|\\.\{|\)\{|\([^)]*\(", rule.pattern):
            return ""
        runs = re.split(r"\([^)]*\)[?*+]?|\\.[?*+]?|.[?*+{][^A-Za-z ]*|[.^$)(]", rule.pattern)
    else:
        runs = [rule.pattern]
    parts = [p for run in runs for p in re.findall(r"[ -~]+", run)]
    return max(parts, key=len, default="").lower()


def anchors(rules: Sequence[Rule]) -> list[str | None]:
    """The anchor of every rule, or None."""
    grams = [sorted({p[i : i + GRAM] for p in [fixed_part(r)] for i in range(len(p) - GRAM + 1)}) for r in rules]
    shared = Counter(g for own in grams for g in own)
    return [min(own, key=lambda g: (shared[g], g), default=None) for own in grams]


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(values, kind: str = "string") -> str:
    return f"cast(array({', '.join(values)}) as array<{kind}>)"


def _fired_in(rules: list[tuple[int, Rule]], text: str) -> Column:
    """Ascending numbers of the rules on one field that fire in column `text` (its lower-cased form is `text`_low)."""
    found = anchors([r for _, r in rules])
    by: dict[str, list[int]] = {}
    for k, g in enumerate(found):
        if g is not None:
            by.setdefault(g, []).append(k)
    order = sorted(by)
    always = _array([str(k) for k, g in enumerate(found) if g is None], "int")
    candidates = always
    if order:
        grams = f"array_distinct(transform(sequence(1, greatest(char_length({text}_low) - {GRAM - 1}, 1)), i -> substring({text}_low, i, {GRAM})))"
        lists = f"array({', '.join(_array(map(str, by[g]), 'int') for g in order)})"
        keys = _array(map(_quoted, order))
        named = f"filter({grams}, g -> g IN ({', '.join(map(_quoted, order))}))"
        candidates = f"concat({always}, flatten(transform({named}, g -> element_at({lists}, cast(array_position({keys}, g) as int)))))"
    at = lambda values, kind="string": f"element_at({_array(values, kind)}, k + 1)"
    patterns = at(_quoted((f"(?i){r.pattern}" if not r.case_sensitive else r.pattern) if r.kind == "regex" else r.pattern if r.case_sensitive else r.pattern.lower()) for _, r in rules)
    kinds = at(_quoted(r.kind) for _, r in rules)
    given = f"if({at(('true' if r.case_sensitive else 'false' for _, r in rules), 'boolean')}, {text}, {text}_low)"
    test = f"CASE {kinds} WHEN 'contains' THEN contains({given}, {patterns}) WHEN 'exact' THEN {given} = {patterns} ELSE regexp_like({text}, {patterns}) END"
    numbers = at((str(n) for n, _ in rules), "int")
    return F.expr(f"if({text} = '', cast(array() as array<int>), transform(filter(array_distinct({candidates}), k -> {test}), k -> {numbers}))")


def _text_of(df: DataFrame, field: str) -> Column:
    return any_text(df.columns) if field == "any" else F.array_join(field, " ") if field in ANY_LISTS else F.coalesce(F.col(field), F.lit(""))


def with_fired(df: DataFrame, rules: Sequence[Rule], name: str = "__fired") -> DataFrame:
    """Add the ascending numbers (from 0) of the rules that fire; the same rules as `score` finds one by one.

    An unknown field, an unknown kind or a bad pattern is an error before any
    data is read; null and empty texts fire nothing; `rules` are in the caller's
    memory.
    """
    fields: dict[str, list[tuple[int, Rule]]] = {}
    for n, r in enumerate(rules):
        if r.field != "any" and r.field not in (*ANY_FIELDS, *ANY_LISTS):
            raise ValueError(f"rule {r.id}: field {r.field!r} cannot be searched")
        if r.kind not in ("contains", "exact", "regex"):
            raise ValueError(f"rule {r.id}: unknown kind {r.kind!r}")
        if r.kind == "regex":
            re.compile(r.pattern)
        if r.field == "any" or r.field in df.columns:
            fields.setdefault(r.field, []).append((n, r))
    out, made, fired = df, [], []
    for k, (field, own) in enumerate(fields.items()):
        text = _text_of(df, field)
        # a generator works its column out once a row, for whatever reads it
        out = out.select("*", F.explode(F.array(text)).alias(f"__t{k}"))
        out = out.select("*", F.explode(F.array(F.lower(f"__t{k}"))).alias(f"__t{k}_low"))
        fired.append(_fired_in(own, f"__t{k}"))
        made += [f"__t{k}", f"__t{k}_low"]
    numbers = F.array_sort(F.concat(*fired)) if fired else F.array().cast("array<int>")
    return out.select("*", F.explode(F.array(numbers)).alias(name)).drop(*made)


def score_many(df: DataFrame, rules: Ruleset, key: str = "ticket_number") -> DataFrame:
    """`score` for rule sets of any size: the same columns and values."""
    own = list(rules.rules)
    at = lambda values, kind: f"element_at({_array(values, kind)}, k + 1)"
    total = lambda negative: F.expr(f"aggregate(__fired, 0D, (a, k) -> a + {at((f'{abs(r.weight)!r}D' if r.negative == negative else '0D' for r in own), 'double')})")
    side = lambda negative: f"transform(filter(__fired, k -> {at((str(r.negative == negative).lower() for r in own), 'boolean')}), k -> {at((_quoted(_reason(r)) for r in own), 'string')})"
    if not own:
        return _decided(df, rules, key, F.lit(0.0), F.lit(0.0), F.array().cast("array<string>"))
    fired = F.expr(f"concat({side(False)}, {side(True)})")
    return _decided(with_fired(df, own), rules, key, total(False), total(True), fired).drop("__fired")


def explain_many(df: DataFrame, rules: Sequence[Rule], key: str = "ticket_number") -> DataFrame:
    """One row per rule that fires: key, rule_id, weight (negative for negative rules)."""
    own = list(rules)
    at = lambda values, kind: F.expr(f"element_at({_array(values, kind)}, __rule + 1)")
    hit = with_fired(df, own).select(F.col(key), F.explode("__fired").alias("__rule"))
    return hit.select(key, at((_quoted(r.id) for r in own), "string").alias("rule_id"), at((f"{-abs(r.weight) if r.negative else abs(r.weight)!r}D" for r in own), "double").alias("weight"))


def _prepared(tests: DataFrame) -> DataFrame:
    """The tests with the pattern as it is compared, and the runs of their fixed part that may be their anchor."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            patterns, runs = [], []
            for t in batch.select(["pattern", "kind", "case_sensitive"]).to_pylist():
                if t["kind"] == "regex":
                    re.compile(t["pattern"])
                    patterns.append(t["pattern"] if t["case_sensitive"] else f"(?i){t['pattern']}")
                else:
                    patterns.append(t["pattern"] if t["case_sensitive"] else t["pattern"].lower())
                part = fixed_part(Rule("", t["pattern"], 0.0, kind=t["kind"]))
                size = next((g for g in GRAMS if g <= len(part)), 0)
                runs.append(sorted({part[i : i + size] for i in range(len(part) - size + 1)}) if size else [])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("test", "field", "kind", "case_sensitive")), pa.array(patterns, pa.string()), pa.array(runs, pa.list_(pa.string()))], ["test", "field", "kind", "case_sensitive", "given", "runs"])

    return tests.mapInArrow(work, "test long, field string, kind string, case_sensitive boolean, given string, runs array<string>")


def explain_table(df: DataFrame, rules: DataFrame, key: str = "ticket_number") -> DataFrame:
    """`explain_many` for a table of rules of any size (id, pattern, weight; field, kind, case_sensitive and negative where it has them).

    Rules and texts meet in joins: every distinct text and every distinct test is
    looked at once, by the hashes of anchors of up to 64 characters, and what
    meets is tested exactly.  An unknown field or kind is an error before any
    text is read, a bad pattern one while the rules are prepared.
    """
    scratch = Scratch(df.sparkSession, "rules")
    given = lambda c, kind, other: F.coalesce(F.col(c).cast(kind), F.lit(other)) if c in rules.columns else F.lit(other)
    weight = F.abs(F.col("weight").cast("double"))
    test = ["field", "kind", "case_sensitive", "pattern"]
    own = scratch.save(rules.select(
        F.col("id").cast("string").alias("rule_id"), F.when(given("negative", "boolean", False), -weight).otherwise(weight).alias("weight"),
        given("field", "string", "any").alias("field"), given("kind", "string", "contains").alias("kind"), given("case_sensitive", "boolean", False).alias("case_sensitive"), "pattern",
    ), "rules")
    bad = own.where(~F.col("field").isin("any", *ANY_FIELDS, *ANY_LISTS) | ~F.col("kind").isin("contains", "exact", "regex")).first()
    if bad:
        raise ValueError(f"rule {bad['rule_id']}: field {bad['field']!r} cannot be searched, or kind {bad['kind']!r} is unknown")
    fields = [r[0] for r in own.select("field").distinct().collect() if r[0] == "any" or r[0] in df.columns]  # at most one a searchable field
    named = F.array(*[F.struct(F.lit(f).alias("field"), _text_of(df, f).alias("text")) for f in fields]) if fields else F.expr("cast(array() as array<struct<field:string,text:string>>)")
    rows = df.select(F.col(key), F.inline(named)).where("text <> ''")
    texts = scratch.save(rows.select("field", "text").distinct().select(F.monotonically_increasing_id().alias("at"), "field", "text", F.lower("text").alias("low")), "texts")
    named_tests = scratch.save(own.select(*test).distinct().withColumn("test", F.monotonically_increasing_id()), "tests")
    tests = scratch.save(_prepared(named_tests), "prepared")
    # a hash that two runs share makes candidates, not matches
    runs = tests.select("test", "field", F.explode("runs").alias("run")).select("test", F.char_length("run").alias("size"), F.xxhash64("field", "run").alias("run"))
    shared = spread_join(runs, runs.groupBy("run").agg(F.count("*").alias("n")), "run")
    anchor = scratch.save(shared.groupBy("test").agg(F.min_by(F.struct("run", "size"), F.struct("n", "run")).alias("a")).select("test", "a.run", "a.size"), "anchors")
    sizes = [r[0] for r in anchor.select("size").distinct().collect()]  # at most len(GRAMS)
    every = [F.transform(F.regexp_extract_all("low", F.lit(f"(?s)(?=(.{{{n}}}))"), 1), lambda g: F.xxhash64("field", g)) for n in sizes]
    held = texts.select("at", F.explode(F.array_distinct(F.concat(*every))).alias("run")) if every else texts.select("at", F.lit(0).cast("long").alias("run")).limit(0)
    met = spread_join(held, anchor.select("run", "test"), "run").select("at", "test")
    always = tests.where("size(runs) = 0").select("test", "field")
    if not always.isEmpty():
        met = met.unionByName(spread_join(texts.select("at", "field"), always, "field").select("at", "test"))
    both = met.join(tests.drop("runs", "field"), "test").join(texts, "at")
    said = F.when(F.col("case_sensitive"), F.col("text")).otherwise(F.col("low"))
    fires = F.when(F.col("kind") == "contains", F.contains(said, F.col("given"))).when(F.col("kind") == "exact", said == F.col("given")).otherwise(F.regexp_like("text", "given"))
    fired = scratch.save(both.where(fires).select("field", "text", "test"), "fired")
    by = fired.join(named_tests, ["field", "test"]).join(own, test).select("field", "text", "rule_id", "weight")
    spot = F.xxhash64("field", "text")  # a text of very many rows is split by AQE
    return rows.withColumn("__spot", spot).join(by.withColumn("__spot", spot), ["field", "text", "__spot"]).select(key, "rule_id", "weight")
