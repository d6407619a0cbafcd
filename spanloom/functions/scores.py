"""Numbers between 0 and 1, what they combine to, and what they are called."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: grades, from the best or worst on; a bound is where the next grade begins -------------------
GRADES: dict[str, list[tuple[float, str]]] = {
    "calibration": [(0.05, "Well calibrated"), (0.10, "Moderately calibrated"), (0.15, "Poorly calibrated"), (float("inf"), "Very poorly calibrated")],
    "gap": [(0.3, "Excellent discrimination"), (0.2, "Good discrimination"), (0.1, "Moderate discrimination"), (0.0, "Weak discrimination"), (float("-inf"), "No discrimination (or reversed)")],
    "agreement": [(0.95, "Excellent agreement"), (0.85, "Good agreement"), (0.70, "Moderate agreement"), (0.50, "Fair agreement"), (float("-inf"), "Poor agreement")],
    "kappa": [(0.0, "Less than chance agreement"), (0.20, "Slight agreement"), (0.40, "Fair agreement"), (0.60, "Moderate agreement"), (0.80, "Substantial agreement"), (float("inf"), "Almost perfect agreement")],
    "outliers": [(0.05, "Very low OOD (well-covered domain)"), (0.15, "Low OOD (mostly covered)"), (0.30, "Moderate OOD (some gaps)"), (0.50, "High OOD (significant gaps)"), (float("inf"), "Very high OOD (major domain shift)")],
    "robustness": [(0.95, "Excellent robustness"), (0.85, "Good robustness"), (0.70, "Moderate robustness"), (0.50, "Poor robustness"), (float("-inf"), "Very poor robustness")],
}
# ---------------------------------------------------------------------------------------------------------------


def grade(value: Column, kind: str) -> Column:
    """The name of a value; null has none. Rising lists name what is below a bound, falling ones what reaches it (`gap`: what
    exceeds it)."""
    bounds = GRADES[kind]
    out = F.lit(None).cast("string")
    rising = bounds[-1][0] == float("inf")
    for at, name in reversed(bounds):
        out = F.when(value < at if rising else value > at if kind == "gap" else value >= at, F.lit(name)).otherwise(out)
    return F.when(value.isNotNull(), F.coalesce(out, F.lit(bounds[-1][1])))


def sigmoid(logit: Column, temperature: float = 1.0) -> Column:
    """1 / (1 + e^-x); a temperature above 0 divides x first."""
    x = logit / temperature if temperature > 0 else logit
    return 1 / (1 + F.exp(-x))


def clamped(value: Column) -> Column:
    """Within [0, 1]; NaN is 0, null stays null."""
    return F.when(F.isnan(value), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def between(a: Column, b: Column, t: Column) -> Column:
    """From a to b by t, which is held within [0, 1]."""
    s = clamped(t)
    return clamped(a * (1 - s) + b * s)


def together(a: Column, b: Column) -> Column:
    """The geometric mean of two confidences."""
    return F.sqrt(a * b)


def half_cosine(cosine: Column, known: Column) -> Column:
    """A cosine brought to [0, 1]; 0 where it is not known (lengths differ, a vector is empty or zero)."""
    return F.when(known, (cosine + 1) / 2).otherwise(F.lit(0.0))


# Notations that a gold label may have for a predicted one, besides itself.
SAME_TYPE = [("PERSON", "PER"), ("PER", "PERSON"), ("LOCATION", "LOC"), ("LOC", "LOCATION"), ("LOCATION", "GPE"), ("GPE", "LOCATION"), ("ORGANIZATION", "ORG"), ("ORG", "ORGANIZATION"), ("DATE", "YEAR"), ("YEAR", "DATE"), ("DATE", "HOURS")]


def types_match(predicted: Column, gold: Column) -> Column:
    """Whether two notations of labels may stand for each other, without case."""
    p, g = F.upper(predicted), F.upper(gold)
    hit = p == g
    for a, b in SAME_TYPE:
        hit = hit | ((p == a) & (g == b))
    return hit


def triggers_match(a: Column, b: Column) -> Column:
    """Whether two trigger words have one stem, or one holds the other's stem of three letters or more."""
    from .text import simple_stem

    x, y = simple_stem(a), simple_stem(b)
    held = lambda s, t: (F.length(s) >= 3) & F.startswith(t, s)
    return (x == y) | held(x, y) | held(y, x)
