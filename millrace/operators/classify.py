"""Source classification: registry rules by host suffix, path and organisation, then fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import (
    AUTHORITY_BY_TYPE,
    FALLBACK_DOMAINS,
    FALLBACK_HOST_PREFIXES,
    FALLBACK_PATH_HINTS,
    PRIMARY_MAX_TIER,
    SOURCE_TIERS,
    UNKNOWN_AUTHORITY,
)
from millrace.functions.urls import url_host, url_path
from millrace.functions.weights import lookup

RULE_KEY = ("domain", "path_pattern", "github_org")


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: F.length(s) > 0)


def host_suffixes(host: Column) -> Column:
    """All domains a host lies in, longest first."""
    labels = F.split(host, r"\.")
    starts = F.sequence(F.lit(1), F.size(labels))
    return F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def path_starts_with(actual: Column, wanted: Column) -> Column:
    """Segment-wise, case-insensitive prefix; ``*`` stands for any one segment."""
    length = F.size(wanted)
    head = F.slice(actual, 1, F.greatest(length, F.lit(1)))
    pairs = F.zip_with(wanted, head, lambda w, h: F.coalesce((w == "*") | (F.lower(w) == F.lower(h)), F.lit(False)))
    return (length == 0) | ((F.size(actual) >= length) & F.forall(pairs, lambda ok: ok))


def tier(source_type: Column) -> Column:
    return lookup(source_type, SOURCE_TIERS, 5)


def is_primary(source_type: Column) -> Column:
    return tier(source_type) <= PRIMARY_MAX_TIER


def authority(source_type: Column) -> Column:
    return lookup(source_type, AUTHORITY_BY_TYPE, AUTHORITY_BY_TYPE.get("unknown", UNKNOWN_AUTHORITY))


def valid_rules(registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rules and the rejected rest (unknown type, or a score outside 0..1)."""
    usable = F.col("source_type").isin(*SOURCE_TIERS) & F.col("authority_score").between(0.0, 1.0)
    usable = F.coalesce(usable, F.lit(False))
    return registry.filter(usable), registry.filter(~usable)


def seed_registry(config: DataFrame, existing: DataFrame) -> DataFrame:
    """Registry after seeding, with ``seed_action`` created / updated / skipped_verified / kept.

    Verified rows are never touched.  Duplicate keys in the (small, hand-written) config are an error.
    """
    doubled = config.groupBy(*RULE_KEY).count().filter("count > 1")
    if not doubled.isEmpty():
        raise ValueError(f"duplicate source rules: {doubled.first().asDict()}")
    values = ("entity_name", "source_type", "authority_score")
    new = config.select(*[F.col(k).alias(f"n_{k}") for k in (*RULE_KEY, *values)])
    old = existing.withColumn("_old", F.lit(True))
    same_key = F.lit(True)
    for k in RULE_KEY:
        same_key = same_key & F.col(k).eqNullSafe(F.col(f"n_{k}"))  # an absent part is not an empty one
    joined = old.join(new, same_key, "full")
    known, given = F.col("_old").isNotNull(), F.col("n_domain").isNotNull()
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(v).eqNullSafe(F.col(f"n_{v}"))
    action = (
        F.when(~known, "created")
        .when(given & F.col("verified"), "skipped_verified")
        .when(given & differs, "updated")
        .otherwise("kept")
    )
    take_new = action.isin("created", "updated")
    return joined.select(
        *[F.when(known, F.col(k)).otherwise(F.col(f"n_{k}")).alias(k) for k in RULE_KEY],
        *[F.when(take_new, F.col(f"n_{v}")).otherwise(F.col(v)).alias(v) for v in values],
        F.coalesce("verified", F.lit(False)).alias("verified"),
        action.alias("seed_action"),
    )


def match_rules(urls: DataFrame, registry: DataFrame) -> DataFrame:
    """Most specific rule per URL: exact host, then path depth, then organisation.

    ``urls``: (url, host, path), one row per distinct URL.  Ties go to the smaller rule key.
    """
    rules = valid_rules(registry)[0].select(
        F.ltrim(F.lower(F.trim("domain")), F.lit(".")).alias("suffix"),
        segments(F.coalesce(F.trim("path_pattern"), F.lit(""))).alias("wanted"),
        F.lower(F.trim("github_org")).alias("org"),
        F.when(
            F.length("path_pattern") > 0, F.size(F.split(F.trim(F.col("path_pattern"), F.lit("/")), "/"))
        ).otherwise(0).alias("depth"),
        *RULE_KEY,
        "entity_name",
        "source_type",
        "authority_score",
    )
    suffixed = urls.select("url", "host", segments(F.col("path")).alias("actual"), F.explode(host_suffixes(F.col("host"))).alias("suffix"))
    has_org = F.length(F.coalesce("org", F.lit(""))) > 0
    org_fits = ~has_org | F.coalesce(F.lower(F.get("actual", F.lit(0))) == F.col("org"), F.lit(False))
    fitting = suffixed.join(rules, "suffix").filter(path_starts_with(F.col("actual"), F.col("wanted")) & org_fits)
    order = F.struct(
        (F.col("host") != F.col("suffix")).alias("inexact"),
        F.negate("depth").alias("depth"),
        (~has_org).alias("no_org"),
        *[F.coalesce(F.col(k), F.lit("")).alias(f"t_{k}") for k in RULE_KEY],
    )
    rule = F.struct("entity_name", F.col("domain").alias("matched_domain"), "source_type", "authority_score")
    return fitting.groupBy("url").agg(F.min_by(rule, order).alias("rule")).select("url", "rule.*")


def fallback_type(host: Column, path: Column) -> Column:
    """Listed domain (longest), company tech blog by host label or path, else unknown."""
    listed = F.create_map(*[F.lit(x) for pair in FALLBACK_DOMAINS.items() for x in pair])
    hits = F.filter(host_suffixes(host), lambda s: F.map_contains_key(listed, s))
    actual = segments(path)
    blog = F.split_part(host, F.lit("."), F.lit(1)).isin(*FALLBACK_HOST_PREFIXES)
    for hint in FALLBACK_PATH_HINTS:
        blog = blog | path_starts_with(actual, F.array(F.lit(hint.strip("/"))))
    by_list = F.when(F.size(hits) > 0, F.element_at(listed, F.get(hits, F.lit(0))))
    guess = F.coalesce(by_list, F.when(blog, F.lit("company_tech_blog")), F.lit("unknown"))
    return F.when(F.length(host) > 0, guess).otherwise("unknown")


def classify_sources(urls: DataFrame, registry: DataFrame) -> DataFrame:
    """Type, authority and primary flag per distinct URL of ``urls`` (url)."""
    parsed = urls.select("url").distinct().select("url", url_host("url").alias("host"), url_path("url").alias("path"))
    matched = match_rules(parsed, registry).filter(F.col("source_type") != "unknown")
    guess = fallback_type(F.col("host"), F.col("path"))
    joined = parsed.join(matched, "url", "left").withColumn("by_rule", F.col("source_type").isNotNull())
    kind = F.coalesce("source_type", guess)
    return joined.select(
        "url",
        "host",
        "entity_name",
        "matched_domain",
        kind.alias("source_type"),
        F.coalesce("authority_score", authority(kind)).alias("source_authority"),
        is_primary(kind).alias("is_primary_source"),
        "by_rule",
    )
