"""Impact scoring as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import SEVERITY


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def severity(event_type: Column) -> Column:
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable((k.lower(), v) for k, v in SEVERITY.items())])
    key = F.lower(F.trim(F.coalesce(event_type, F.lit(""))))
    return F.when(key == "", 0.0).otherwise(F.coalesce(F.try_element_at(table, key), F.lit(0.25)))


def sentiment_modifier(s: Column) -> Column:
    s = clamp(F.coalesce(s, F.lit(0.0)), -1.0, 1.0)
    return F.when(s < 0, 1 + 0.25 * F.abs(s)).otherwise(1 + 0.10 * s)


def market_modifier(abnormal: Column, ratio: Column, volatility: Column) -> Column:
    """1 without any context; the parts of missing values are 0."""
    a = F.abs(abnormal)
    part = F.when(a > 0.015, F.least(F.lit(0.15), (a - 0.015) * 3.0)).when(a < 0.005, -0.10).otherwise(0.0)
    part = F.coalesce(part, F.lit(0.0))
    volume = F.when(ratio > 1.5, F.least(F.lit(0.10), (ratio - 1.5) * 0.05)).when(ratio < 1.0, -0.05).otherwise(0.0)
    wild = F.when(volatility > 2.0, 0.05).when(volatility < 1.0, -0.05).otherwise(0.0)
    return F.round(clamp(1.0 + part + volume + wild, 0.70, 1.30), 4)


def raw_impact(event_type: Column, confidence: Column, credibility: Column, novelty: Column, sentiment: Column, market: Column) -> Column:
    sure = F.round(0.70 + 0.30 * clamp(F.coalesce(confidence, F.lit(0.0)), 0.0, 1.0), 4)
    new = F.round(0.75 + 0.25 * clamp(F.coalesce(novelty, F.lit(1.0)), 0.0, 1.0), 4)
    return severity(event_type) * sure * credibility * new * sentiment_modifier(sentiment) * market


def impact(materiality: Column, raw: Column) -> Column:
    """The gated score, rounded to two places: 1 without an event, up to 2 for what is not material, else up to 10."""
    gated = F.when(materiality == "NO_EVENT", 1.0).when(materiality == "NON_MATERIAL_FINANCIAL_CONTENT", 1 + F.least(F.lit(1.0), raw / 1.2)).otherwise(clamp(1 + 9 * clamp(raw / 1.2, 0.0, 1.0), 1.0, 10.0))
    return F.round(gated, 2)


def tier(score: Column) -> Column:
    return F.when(score >= 8.5, "Critical").when(score >= 7.0, "High").when(score >= 5.0, "Moderate").when(score >= 3.0, "Low").otherwise("Minimal")


def explanation(score: Column, tier_: Column, materiality: Column, event_type: Column, base: Column, confidence: Column, credibility: Column, novelty: Column, sentiment: Column, market: Column) -> Column:
    """Why a score is what it is, in sentences; numbers are rounded half up. The sentences are fixed values."""
    two = lambda c: F.format_string("%.2f", c.cast("double"))
    signed = lambda c: F.format_string("%+.2f", c.cast("double"))
    one = lambda c: F.format_string("%.1f", c.cast("double"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    sure = F.when(confidence >= 0.85, "high").when(confidence >= 0.60, "moderate").otherwise("weak")
    trusted = F.when(credibility >= 0.90, "strong").when(credibility >= 0.60, "moderate").otherwise("unverified")
    first = text(tier_, " Impact (", one(score), "/10) because this is a material ", event_type, " (base severity: ", two(base), ") with ", sure, " event confidence (", two(confidence), ") and ", trusted, " source credibility (", two(credibility), ").")
    mood = F.when(sentiment <= -0.4, text("Downside risk amplified by negative sentiment (", signed(sentiment), ").")).when(sentiment >= 0.4, text("Positive sentiment (", signed(sentiment), "); impact driven by structural transaction/event size."))
    mood = mood.otherwise(text("Sentiment is neutral (", signed(sentiment), "); impact driven primarily by event severity."))
    stale = F.when(novelty < 0.70, text("Dampened by lower novelty (", two(novelty), ") due to repeated/clustered coverage."))
    moved = F.when(market > 1.05, text("Confirmed by elevated market reaction and volatility (market modifier: ", two(market), ").")).when(market < 0.95, "Dampened by muted price/volume reaction.")
    gated = text("Gated: Classified as non-material financial content; score constrained to 1.0–2.0 (impact: ", one(score), "). Event category '", event_type, "' (base severity: ", two(base), ", confidence: ", two(confidence), ") does not meet corporate materiality thresholds.")
    kind = F.upper(F.trim(materiality))
    return F.when(kind == "NO_EVENT", "Gated: Classified as NO_EVENT. Minimal financial significance (impact: 1.0).").when(kind == "NON_MATERIAL_FINANCIAL_CONTENT", gated).otherwise(F.concat_ws(" ", first, mood, stale, moved))
