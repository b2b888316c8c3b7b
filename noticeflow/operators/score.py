"""Relevance scoring: a list of weighted rules becomes one scoring expression, one scan without shuffle."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.text import normalize_text

#: The texts that a rule on field "any" searches, in this order.
ANY_FIELDS = ["excavator_name", "caller_name", "work_type", "location_text", "remarks", "done_for", "raw_text"]
ANY_LISTS = ["utility_codes", "utility_references"]


@dataclass(frozen=True)
class Rule:
    """A weighted match on one field, or on all of them; a negative rule's weight counts by its size."""

    id: str
    pattern: str
    weight: float
    field: str = "any"
    kind: str = "contains"  # contains, exact or regex
    case_sensitive: bool = False
    negative: bool = False


@dataclass(frozen=True)
class Ruleset:
    rules: Sequence[Rule]
    threshold: float = 0.45
    contractors: Sequence[str] = ()
    work_keywords: Sequence[str] = ()
    include: Sequence[str] = field(default=())
    exclude: Sequence[str] = field(default=())


def ruleset_from(table: DataFrame, **options) -> Ruleset:
    """A rule set from a table of rules (id, pattern, weight; field, kind, case_sensitive and negative where it has them), in order of id.

    Rules are configuration: a few rows that become one expression.  Options are
    those of Ruleset: threshold, contractors, work_keywords, include, exclude.
    """
    known = ("id", "pattern", "weight", "field", "kind", "case_sensitive", "negative")
    rows = table.select(*[c for c in known if c in table.columns]).orderBy("id").collect()
    return Ruleset([Rule(**{k: v for k, v in r.asDict().items() if v is not None}) for r in rows], **options)


def any_text(columns: Sequence[str]) -> Column:
    """The searchable texts that the table has, joined by spaces; a match may span two of them."""
    texts = [F.nullif(F.col(c), F.lit("")) for c in ANY_FIELDS if c in columns]
    lists = [F.nullif(F.array_join(c, " "), F.lit("")) for c in ANY_LISTS if c in columns]
    return F.concat_ws(" ", *texts, *lists)


def worked_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are worked out once a row, whatever reads them: filters on them stop at the generator, and nothing is copied below it."""
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.explode(F.array(made)).alias("__made")).select(*df.columns, "__made.*")


def rule_matches(rule: Rule, columns: Sequence[str], searched: Column | None = None) -> Column:
    """Whether a rule fires; an unknown field or a bad pattern is an error before any data is read."""
    if rule.field != "any" and rule.field not in (*ANY_FIELDS, *ANY_LISTS):
        raise ValueError(f"rule {rule.id}: field {rule.field!r} cannot be searched")
    if rule.field == "any":
        text = any_text(columns) if searched is None else searched
    elif rule.field not in columns:
        return F.lit(False)
    else:
        text = F.array_join(rule.field, " ") if rule.field in ANY_LISTS else F.coalesce(F.col(rule.field), F.lit(""))
    pattern = rule.pattern if rule.case_sensitive else rule.pattern.lower()
    given = text if rule.case_sensitive else F.lower(text)
    if rule.kind == "contains":
        hit = given.contains(pattern)
    elif rule.kind == "exact":
        hit = given == pattern
    elif rule.kind == "regex":
        re.compile(rule.pattern)
        hit = text.rlike(rule.pattern if rule.case_sensitive else f"(?i){rule.pattern}")
    else:
        raise ValueError(f"rule {rule.id}: unknown kind {rule.kind!r}")
    return (text != "") & hit


def _with_hits(df: DataFrame, rules: Ruleset) -> tuple[DataFrame, list[tuple[Rule, str]]]:
    """The searched text and each rule's verdict as columns of their own, so that each is computed once a row."""
    base = worked_once(df, {"__any": any_text(df.columns)})
    named = [(r, f"__hit{i}") for i, r in enumerate(rules.rules)]
    return worked_once(base, {name: rule_matches(r, df.columns, F.col("__any")) for r, name in named}) if named else base, named


def _weights(hits: Sequence[tuple[Rule, str]]) -> Column:
    total = F.lit(0.0)
    for rule, name in hits:
        total = total + F.when(F.col(name), F.lit(abs(rule.weight))).otherwise(F.lit(0.0))
    return total


def score(df: DataFrame, rules: Ruleset, key: str = "ticket_number") -> DataFrame:
    """Add relevance_score, is_relevant and relevance_reasons.

    Positive weights add up to at most 1, negative ones are taken off, the rest
    is kept within 0 and 1.  A listed contractor doing listed work is lifted to
    the threshold.  Excluded keys score 0 and included ones 1, whatever the rules say.
    """
    hit, named = _with_hits(df, rules)
    plus, minus = [x for x in named if not x[0].negative], [x for x in named if x[0].negative]
    fired = [F.when(F.col(name), F.lit(_reason(r))) for r, name in plus + minus]
    return _decided(hit, rules, key, _weights(plus), _weights(minus), F.array(*fired)).drop("__any", *[name for _, name in named])


def _reason(r: Rule) -> str:
    return f"{'-' if r.negative else '+'}{r.id}(w={'-' if r.negative else ''}{abs(r.weight):.2f})"


def _decided(hit: DataFrame, rules: Ruleset, key: str, plus: Column, minus: Column, fired: Column) -> DataFrame:
    """Score, verdict and reasons from the weights of the rules that fire, lifts and overrides."""
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(plus, F.lit(1.0)) - minus))
    lift = F.lit(False)
    if rules.contractors and rules.work_keywords:
        hit = hit.withColumns({
            "__who": normalize_text(F.col("excavator_name")),
            "__what": normalize_text(F.concat_ws(" ", *[c for c in ("work_type", "remarks") if c in hit.columns])),
        })
        by = work = F.lit(False)
        for k in rules.contractors:
            by = by | F.col("__who").contains(k.lower())
        for k in rules.work_keywords:
            work = work | F.col("__what").contains(k.lower())
        hit = worked_once(hit, {"__named": by & work})
        lift = F.col("__named")
    out = F.upper(F.col(key).cast("string")).isin([k.upper() for k in rules.exclude]) if rules.exclude else F.lit(False)
    put = F.upper(F.col(key).cast("string")).isin([k.upper() for k in rules.include]) if rules.include else F.lit(False)
    scored = hit.withColumns({"__raw": raw, "__lift": lift, "__out": out, "__put": put}).withColumn("__lifted", (F.col("__raw") < rules.threshold) & F.col("__lift"))
    scored = scored.withColumn("__final", F.when(F.col("__lifted"), F.lit(rules.threshold)).otherwise(F.col("__raw")))
    reasons = F.array_compact(F.concat(fired, F.array(F.when(F.col("__lifted"), F.lit("+contractor_rule_match")))))
    given = lambda excluded, included, other: F.when(F.col("__out"), excluded).when(F.col("__put"), included).otherwise(other)
    done = scored.withColumns({
        "relevance_score": given(F.lit(0.0), F.lit(1.0), F.bround("__final", 4)),
        "is_relevant": given(F.lit(False), F.lit(True), F.col("__final") >= rules.threshold),
        "relevance_reasons": given(F.array(F.lit("manual_exclude_override")), F.array(F.lit("manual_include_override")), reasons),
    })
    return done.drop("__named", "__who", "__what", "__raw", "__lift", "__out", "__put", "__lifted", "__final")


def explain(df: DataFrame, rules: Ruleset, key: str = "ticket_number") -> DataFrame:
    """One row per rule that fires: key, rule_id, weight (negative for negative rules)."""
    hit, named = _with_hits(df, rules)
    fired = [F.when(F.col(name), F.struct(F.lit(r.id).alias("rule_id"), F.lit(-abs(r.weight) if r.negative else abs(r.weight)).alias("weight"))) for r, name in named]
    return hit.select(F.col(key), F.inline(F.array_compact(F.array(*fired))))


def rescore(current: DataFrame, rules: Ruleset, key: str = "ticket_number") -> DataFrame:
    """Score again and tell what moved: adds old_score, was_relevant and change.

    change is newly_relevant, no_longer_relevant, score_moved (by over 1e-6) or unchanged.
    """
    old = current.withColumnsRenamed({"relevance_score": "old_score", "is_relevant": "was_relevant", "relevance_reasons": "old_reasons"})
    new = score(old, rules, key)
    was = F.coalesce("was_relevant", F.lit(False))
    moved = F.abs(F.col("relevance_score") - F.coalesce("old_score", F.lit(0.0))) > 1e-6
    change = (
        F.when(~was & F.col("is_relevant"), "newly_relevant").when(was & ~F.col("is_relevant"), "no_longer_relevant")
        .when(moved, "score_moved").otherwise("unchanged")
    )
    return new.withColumn("change", change)


def rescore_diff(rescored: DataFrame) -> DataFrame:
    return rescored.groupBy("change").agg(F.count("*").alias("tickets"))


def rescore_samples(rescored: DataFrame, n: int = 5, key: str = "ticket_number") -> DataFrame:
    """The n smallest keys of each change, unchanged ones too (a filter on change would compute every score twice)."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("change").orderBy(key))
    return rescored.withColumn("place", place).where(F.col("place") <= n).select("change", "place", key, "old_score", "relevance_score")
