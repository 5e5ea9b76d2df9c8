"""Score expressions: severities, confidence, cosine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.constants import CONFIDENCE_RANGE, NOISY_OR_CAP, SARIF_LEVEL, SEVERITIES, SEVERITY_WEIGHT, SINGLE_CITATION, TRACKS


def _map(x: Column, values: dict, kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for k, v in reversed(list(values.items())):
        out = F.when(x == k, F.lit(v).cast(kind)).otherwise(out)
    return out


def severity_order(x: Column) -> Column:
    return _map(x, {s: i for i, s in enumerate(SEVERITIES)}, "int")


def severity_weight(x: Column) -> Column:
    return _map(x, SEVERITY_WEIGHT, "double")


def track_order(x: Column) -> Column:
    return _map(x, {t: i for i, t in enumerate(TRACKS)}, "int")


def sarif_level(x: Column) -> Column:
    return _map(x, {k: v[0] for k, v in SARIF_LEVEL.items()}, "string")


def sarif_security_severity(x: Column) -> Column:
    return _map(x, {k: v[1] for k, v in SARIF_LEVEL.items()}, "string")


def parse_severity(x: Column) -> Column:
    """A severity as written in a reply; unknown ones are medium."""
    low = F.lower(F.trim(x))
    return F.when(low == "informational", "info").when(low.isin(*SEVERITIES), low).otherwise("medium")


def clamp_confidence(x: Column, citations: Column) -> Column:
    """Within the allowed range, and less for a single citation."""
    held = F.greatest(F.lit(CONFIDENCE_RANGE[0]), F.least(F.lit(CONFIDENCE_RANGE[1]), x.cast("double")))
    return F.when(citations == 1, held * SINGLE_CITATION).otherwise(held)


def noisy_or(a: Column, b: Column) -> Column:
    return F.least(1 - (1 - a) * (1 - b), F.lit(NOISY_OR_CAP))


def rank_score(severity: Column, confidence: Column) -> Column:
    return severity_weight(severity) * confidence


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for unequal lengths or a zero norm, never NaN."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), F.lit(0.0)).otherwise(_dot(a, b) / F.when(norms == 0, None).otherwise(norms))
