"""Ordinal evidence from words in a tool's output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions.ordinal import clip_level

# Words and their degradation weight, matched as substrings.
CONFLICT_WEIGHTS = {
    "conflict": 4,
    "disagree": 4,
    "contradict": 4,
    "uncertain": 3,
    "ambiguous": 3,
    "missing": 3,
    "stale": 2,
    "partial": 2,
    "timeout": 3,
    "retry": 2,
    "error": 3,
    "failed": 4,
}
# Reassuring words and their weight.
POSITIVE_WEIGHTS = {
    "found": 0,
    "retrieved": 1,
    "validated": 0,
    "success": 0,
    "confirmed": 0,
    "executed": 1,
}
# Words that count against the tool.
RELIABILITY_TERMS = ("error", "failed", "timeout", "retry")
# Words that call for an update.
GATE_TERMS = (
    "conflict",
    "uncertain",
    "disagree",
    "ambiguous",
    "missing",
    "error",
    "failed",
    "timeout",
)
# Phrases of an unreachable service.
UNAVAILABLE_PHRASES = (
    "connection error",
    "connection refused",
    "actively refused",
    "failed to connect",
    "api connection error",
)


def _weights_found(lowered: Column, weights: dict[str, int]) -> list[Column]:
    return [F.when(lowered.contains(term), F.lit(w)) for term, w in weights.items()]


def _contains_any(lowered: Column, terms: tuple[str, ...]) -> Column:
    hit = lowered.contains(terms[0])
    for term in terms[1:]:
        hit = hit | lowered.contains(term)
    return hit


def conflict_score(lowered: Column, weights: dict[str, int] = CONFLICT_WEIGHTS) -> Column:
    """Largest weight of any word found, 0 if none."""
    return F.coalesce(F.greatest(*_weights_found(lowered, weights), F.lit(0)), F.lit(0))


def positive_score(lowered: Column, weights: dict[str, int] = POSITIVE_WEIGHTS) -> Column:
    """Smallest weight of any word found; 4 (worst) if none."""
    return F.coalesce(F.least(*_weights_found(lowered, weights)), F.lit(4))


def reliability_hit(lowered: Column) -> Column:
    return conflict_score(lowered, {t: CONFLICT_WEIGHTS[t] for t in RELIABILITY_TERMS})


def vagueness_penalty(text: Column) -> Column:
    """1 when the text has no decimal digit of any script, else 0."""
    return F.when(text.rlike(r"\p{Nd}"), F.lit(0)).otherwise(F.lit(1))


def _read(result: Column) -> Column:
    return F.lower(F.coalesce(result, F.lit("None")))


def keyword_evidence(result: Column) -> Column:
    """``struct<task, data, tool>`` levels; a missing result reads as ``none``."""
    lowered = _read(result)
    conflict = conflict_score(lowered)
    return F.struct(
        clip_level(F.greatest(positive_score(lowered), conflict - 1)).alias("task"),
        clip_level(conflict).alias("data"),
        clip_level(reliability_hit(lowered) + vagueness_penalty(lowered)).alias("tool"),
    )


def is_gated(result: Column) -> Column:
    """Does the text deserve an update at all? A missing result reads as ``none``, too."""
    return _contains_any(_read(result), GATE_TERMS)


def is_unavailable(error_class: Column, message: Column) -> Column:
    """Does an error mean that the model service was unreachable?"""
    return _contains_any(F.lower(F.concat_ws(": ", error_class, message)), UNAVAILABLE_PHRASES)
