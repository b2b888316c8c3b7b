"""Classified columns, export policies, private matches and their providers."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The classes that may leave by default.
PUBLIC_CLASSES = ("public", "derived")


class BlockedColumns(ValueError):
    """An export asked for columns of classes that may not leave."""


def classify(df: DataFrame, classes: dict[str, str]) -> DataFrame:
    """Record a class in the metadata of columns."""
    return df.select(*[F.col(c).alias(c, metadata={"class": classes[c]}) if c in classes else F.col(c) for c in df.columns])


def apply_export_policy(df: DataFrame, allowed: Iterable[str] = PUBLIC_CLASSES) -> DataFrame:
    """The table itself, or an error naming every blocked column, before anything runs; unmarked columns are restricted."""
    allowed = set(allowed)
    kinds = {f.name: f.metadata.get("class", "restricted") for f in df.schema.fields}
    bad = sorted(f"{name}:{kind}" for name, kind in kinds.items() if kind not in allowed)
    if bad:
        raise BlockedColumns("may not be exported: " + ", ".join(bad))
    return df


def enrich(tickets: DataFrame, matches: DataFrame, key: str = "ticket_number") -> DataFrame:
    """Private matches beside the untouched public row: matches array<struct(provider, project_id, confidence, reasons, ...)>, [] without any."""
    private = matches.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*[c for c in matches.columns if c != key]))).alias("matches"))
    kind = private.schema["matches"].dataType
    return tickets.join(private, key, "left").withColumn("matches", F.coalesce("matches", F.array().cast(kind)))


def classified_values(enriched: DataFrame, public: list[str], domain: str = "public_notice", key: str = "ticket_number") -> DataFrame:
    """Long form with provenance: key, name, value, classification, domain, source."""
    items = [F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in public]
    open_ = enriched.select(key, F.inline(F.array(*items))).withColumns({"classification": F.lit("public"), "domain": F.lit(domain), "source": F.lit("notice")})
    private = enriched.select(key, F.explode("matches").alias("m")).select(
        key, F.lit("project_id").alias("name"), F.col("m.project_id").cast("string").alias("value"), F.lit("customer_private").alias("classification"),
        F.lit("customer_project").alias("domain"), F.col("m.provider").alias("source"),
    )
    return open_.unionByName(private)


Provider = Callable[[SparkSession, str], DataFrame]
Enricher = Callable[[DataFrame, str], DataFrame]
_providers: dict[str, Provider] = {}
_enrichers: dict[str, Enricher] = {}


def register_provider(name: str, provider: Provider) -> None:
    _providers[name] = provider


def register_enricher(name: str, enricher: Enricher) -> None:
    _enrichers[name] = enricher


def list_projects(spark: SparkSession, customer: str) -> DataFrame:
    """The projects of all providers, with the provider's name."""
    frames = [p(spark, customer).withColumn("provider", F.lit(name)) for name, p in sorted(_providers.items())]
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def enrich_all(tickets: DataFrame, customer: str) -> DataFrame:
    """Matches of all registered enrichers, attached to the tickets."""
    frames = [e(tickets, customer).withColumn("provider", F.lit(name)) for name, e in sorted(_enrichers.items())]
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return enrich(tickets, out)


def quarantine(df: DataFrame, checks: dict[str, Column], now: Column, key: str = "ticket_number") -> tuple[DataFrame, DataFrame]:
    """(good rows, failures): a row that fails checks is kept with its first reason instead of ending the run."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    marked = df.withColumn("__reasons", reasons)
    bad = marked.where(F.size("__reasons") > 0)
    failures = bad.select(
        F.col(key), F.col("county") if "county" in df.columns else F.lit(None).cast("string").alias("county"), F.element_at("__reasons", 1).alias("reason"),
        F.array_join("__reasons", ", ").alias("detail"), now.alias("occurred_at"), F.lit(False).alias("resolved"),
    )
    return marked.where(F.size("__reasons") == 0).drop("__reasons"), failures
