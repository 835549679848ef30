"""Numeric, vector and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_int(value: Column, as_text: bool = False) -> Column:
    """Whole-number coercion: numbers truncate, unparsable text becomes null."""
    if as_text:
        whole = F.trim(value)
        return F.when(whole.rlike(r"^[+-]?[0-9]+$"), whole.try_cast("bigint"))
    return F.when(~F.isnan(value.cast("double")), value.try_cast("bigint"))


def safe_double(value: Column) -> Column:
    return value.try_cast("double")


def clamp(value: Column, low: float | int | None = None, high: float | int | None = None) -> Column:
    """Clamp into [low, high]; null stays null."""
    result = value
    if high is not None:
        result = F.when(result > high, F.lit(high)).otherwise(result)
    if low is not None:
        result = F.when(result < low, F.lit(low)).otherwise(result)
    return result


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(vector: Column) -> Column:
    """Unit-length vector; a zero vector is returned unchanged."""
    norm = l2_norm(vector)
    # the divisor is computed once and attached to every element
    divisor = F.array_repeat(F.when(norm == 0, F.lit(1.0)).otherwise(norm), F.size(vector))
    return F.zip_with(vector, divisor, lambda x, d: x / d)


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity; null when either vector has zero length."""
    scale = l2_norm(left) * l2_norm(right)
    return F.when(scale != 0, dot(left, right) / scale)


def duration_minutes(duration: Column) -> Column:
    """Upper play-time bound of a duration bucket; unknown or null has none."""
    # Bucket bounds in minutes.
    return (
        F.when(duration == "short", F.lit(45))
        .when(duration == "medium", F.lit(90))
        .when(duration == "long", F.lit(240))
    )


def centroid_count(
    liked: Column, *, min_samples: int, dynamic: bool = True, scaling: float = 0.5
) -> Column:
    """How many preference centroids a user with ``liked`` items gets."""
    if dynamic:
        wanted = F.floor(liked.cast("double") * F.lit(float(scaling)))
    else:
        wanted = F.floor(liked / F.lit(max(1, min_samples)))
    bounded = F.least(F.greatest(wanted, F.lit(1)), liked)
    return F.when(liked < max(1, min_samples), F.lit(1)).otherwise(bounded).cast("int")


def is_stale(fetched_at: Column, as_of: Column, ttl_seconds: int) -> Column:
    """True when an entry is older than its time to live; a TTL of 0 is always stale."""
    if ttl_seconds <= 0:
        return F.lit(True)
    age = F.unix_micros(as_of) - F.unix_micros(F.coalesce(fetched_at, F.timestamp_seconds(F.lit(0))))
    return age > ttl_seconds * 1_000_000


def run_identifier(moment: Column) -> Column:
    return F.date_format(moment, "yyyyMMdd_HHmmss")


def parquet_version(path: Column) -> Column:
    """Parent folder name of a file unless it is ``processed``, else the file stem."""
    parent = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.when((parent != "") & (parent != "processed"), parent).otherwise(stem)


def influence(value: Column) -> Column:
    """Normalize free-form influence text to positive / neutral / negative."""
    text = F.lower(value)
    return (
        F.when(F.contains(text, F.lit("pos")) | (text == "+"), F.lit("positive"))
        .when(F.contains(text, F.lit("neg")) | (text == "-"), F.lit("negative"))
        .otherwise(F.lit("neutral"))
    )


def influence_of_number(value: Column) -> Column:
    return (
        F.when(value > 0, F.lit("positive")).when(value < 0, F.lit("negative")).otherwise(F.lit("neutral"))
    )


def study_group(identifier: Column, override: Column | None = None) -> Column:
    """Sticky, even split into the two experiment groups; an override wins."""
    even = F.pmod(F.ascii(F.substring(F.md5(identifier.cast("string").cast("binary")), 1, 1)), F.lit(2)) == 0
    assigned = F.when(even, F.lit("features")).otherwise(F.lit("references"))
    return assigned if override is None else F.coalesce(override, assigned)


def known_group(group: Column) -> Column:
    """Unknown stored groups fall back to references."""
    return F.when(group.isin("features", "references"), group).otherwise(F.lit("references"))
