"""Scalar weight formulas as column expressions (whole-stage codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.config import DecaySettings, EngineConfig

SECONDS_PER_DAY = 86400.0


def lookup(key: Column, table: dict, default=None) -> Column:
    """Value of ``key`` in a small literal table."""
    result = F.lit(default)
    for name, value in table.items():
        result = F.when(key == name, F.lit(value)).otherwise(result)
    return result


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def age_days(now: Column, moment: Column) -> Column:
    """Days between two timestamps with microsecond resolution."""
    return (F.unix_micros(now) - F.unix_micros(moment)) / F.lit(1e6 * SECONDS_PER_DAY)


def recency_decay(days: Column, half_life_days: float) -> Column:
    """Halves every ``half_life_days``; the future counts as fresh."""
    return F.when(days <= 0, F.lit(1.0)).otherwise(F.pow(F.lit(0.5), days / F.lit(half_life_days)))


def confidence(has_embedding: Column, has_topics: Column, is_analyzed: Column, cfg: EngineConfig) -> Column:
    """Sum of the signals an article carries, between the floor and one."""
    total = (
        F.when(has_embedding, cfg.confidence_embedding).otherwise(0.0)
        + F.when(has_topics, cfg.confidence_topics).otherwise(0.0)
        + F.when(is_analyzed, cfg.confidence_analyzed).otherwise(0.0)
    )
    return clamp(total, cfg.confidence_floor, 1.0)


def effective_interest(explicit: Column, feedback: Column, decay: Column, conf: Column) -> Column:
    return explicit * feedback * decay * conf


def topic_effective(positive: Column, negative: Column) -> Column:
    """Negative feedback dampens a topic but never turns it against the user."""
    return positive / (F.lit(1.0) + negative)


def source_effective(positive: Column, negative: Column) -> Column:
    """A source can end below zero."""
    return positive - negative


def negative_weight(bad_count: Column, settings: DecaySettings) -> Column:
    """Zero below the threshold, then one step per Bad from the threshold on."""
    steps = bad_count - F.lit(settings.bad_threshold - 1)
    return F.when(bad_count >= settings.bad_threshold, steps * F.lit(settings.decay_step)).otherwise(0.0)


def freshness(now: Column, moment: Column, max_age_days: float) -> Column:
    """Linear from one (now or later) to zero at ``max_age_days``."""
    days = age_days(now, moment)
    return (
        F.when(days <= 0, F.lit(1.0))
        .when(days >= max_age_days, F.lit(0.0))
        .otherwise(F.lit(1.0) - days / F.lit(float(max_age_days)))
    )


def authority_gate(similarity: Column, cfg: EngineConfig) -> Column:
    """Authority counts in full only when the article is of interest."""
    low, floor = cfg.gate_min_similarity, cfg.gate_min_factor
    if low <= 0:
        return F.lit(1.0)
    ramp = F.lit(floor) + F.lit(1.0 - floor) * clamp(similarity / F.lit(low))
    return F.when(similarity >= low, F.lit(1.0)).otherwise(ramp)


def source_preference_factor(preference: Column, cfg: EngineConfig) -> Column:
    return clamp(F.lit(1.0) + F.lit(cfg.source_pref_scale) * preference, cfg.source_pref_min, cfg.source_pref_max)


def bad_similarity_penalty(similarity: Column, cfg: EngineConfig) -> Column:
    """Zero below the threshold, linear up to the maximum at identity; null means nothing to compare."""
    low, top = cfg.bad_min_similarity, cfg.bad_max_penalty
    span = 1.0 - low
    rising = F.lit(top) if span <= 0 else F.lit(top) * clamp((similarity - F.lit(low)) / F.lit(span))
    return F.when(similarity >= low, rising).otherwise(0.0)
