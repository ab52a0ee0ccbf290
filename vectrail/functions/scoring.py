"""Vector, context, fusion and gate expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the context score: weight of equal place, time decay and shared entities; half-life in days.
GEO_WEIGHT, TIME_WEIGHT, ENTITY_WEIGHT, HALF_LIFE_DAYS = 0.4, 0.3, 0.3, 30.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, length: Column) -> Column:
    """v over a length that was materialised before (a computed one would be evaluated per element)."""
    return F.transform(v, lambda x: x / length)


def valid_vector(v: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def trust(score: Column, quality_min: float) -> Column:
    """full from quality_min on, low from half of it, else reject (also for null and NaN)."""
    usable = score.isNotNull() & ~F.isnan(score)
    return F.when(usable & (score >= quality_min), "full").when(usable & (score >= 0.5 * quality_min), "low").otherwise("reject")


def days_apart(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(a) - F.unix_micros(b)) / F.lit(86_400e6)


def entity_jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def context_score(q: dict[str, Column], c: dict[str, Column]) -> Column:
    """Weighted mean over the signals that both sides have (ts, geo, entities); 0 if there is none."""
    geo = q["geo"].isNotNull() & c["geo"].isNotNull()
    time = q["ts"].isNotNull() & c["ts"].isNotNull()
    entities = (F.coalesce(F.size(q["entities"]), F.lit(0)) > 0) & (F.coalesce(F.size(c["entities"]), F.lit(0)) > 0)
    zero = F.lit(0.0)
    total = (
        F.when(geo & (q["geo"] == c["geo"]), GEO_WEIGHT).otherwise(zero)
        + F.when(time, TIME_WEIGHT * F.pow(F.lit(0.5), days_apart(q["ts"], c["ts"]) / HALF_LIFE_DAYS)).otherwise(zero)
        + F.when(entities, ENTITY_WEIGHT * entity_jaccard(q["entities"], c["entities"])).otherwise(zero)
    )
    weight = F.when(geo, GEO_WEIGHT).otherwise(zero) + F.when(time, TIME_WEIGHT).otherwise(zero) + F.when(entities, ENTITY_WEIGHT).otherwise(zero)
    return F.when(weight > 0, F.least(F.lit(1.0), F.greatest(zero, total / weight))).otherwise(zero)


def fuse(similarity: Column, context: Column, alpha, beta) -> Column:
    """alpha * similarity + beta * context, clipped to [0, 1]; null where either is null or the similarity isn't finite."""
    raw = F.lit(alpha) * similarity + F.lit(beta) * context
    usable = similarity.isNotNull() & ~F.isnan(similarity) & (F.abs(similarity) < F.lit(float("inf")))
    return F.when(usable & raw.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))


def has_context(c: dict[str, Column]) -> Column:
    """Whether there is a time, a place or an entity; the platform does not count."""
    return c["ts"].isNotNull() | c["geo"].isNotNull() | (F.coalesce(F.size(c["entities"]), F.lit(0)) > 0)


def in_band(score: Column, low: float, high: float) -> Column:
    return F.coalesce(~F.isnan(score) & score.between(low, high), F.lit(False))


def condition_label(name: Column, severity: Column) -> Column:
    """'name severity', the severity with six significant digits and no trailing zeros (1e-07 for small ones)."""
    parts = F.format_string("%.5e", severity.cast("double"))
    exponent = F.regexp_extract(parts, "e(.*)$", 1)
    bare = lambda text: F.regexp_replace(text, r"\.?0+$", "")
    fixed = parts.cast("double").cast("decimal(30,10)").cast("string")
    plain = F.when(exponent.cast("int").between(-4, 5), F.when(fixed.contains("."), bare(fixed)).otherwise(fixed))
    return F.concat_ws(" ", name, F.coalesce(plain, F.concat(bare(F.regexp_extract(parts, "^(.*)e", 1)), F.lit("e"), exponent)))
