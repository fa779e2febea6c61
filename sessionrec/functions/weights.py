"""Column expressions: weights, decays, penalties, rates and hash draws."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionrec.schema import DAY_MS, HASH_RANGE, POPULARITY_WEIGHTS, TARGET_WEIGHTS, TYPE_CODES


def by_type(weights: Mapping[int, float], type_: Column, other: float) -> Column:
    out = F.lit(other)
    for code, weight in weights.items():
        out = F.when(type_ == code, F.lit(weight)).otherwise(out)
    return out


def event_weight(type_: Column) -> Column:
    """Popularity weight of an event; unknown types weigh 1."""
    return by_type(POPULARITY_WEIGHTS, type_, 1.0)


def target_value(type_: Column) -> Column:
    """Weight of an event as a target; unknown types weigh 1."""
    return by_type(TARGET_WEIGHTS, type_, 1.0)


def encode_type(name: Column, strict: bool = True) -> Column:
    """Code of an event type's name. An unknown name is an error, or null if not strict."""
    out = F.raise_error(F.concat(F.lit("unknown event type: "), F.coalesce(name, F.lit("null")))).cast("tinyint") if strict else F.lit(None).cast("tinyint")
    for known, code in TYPE_CODES.items():
        out = F.when(name == known, F.lit(code).cast("tinyint")).otherwise(out)
    return out


def decode_type(type_: Column) -> Column:
    out = F.lit(None).cast("string")
    for known, code in TYPE_CODES.items():
        out = F.when(type_ == code, F.lit(known)).otherwise(out)
    return out


def decay_rational(dt_seconds: Column, c: float) -> Column:
    return F.lit(float(c)) / (dt_seconds + F.lit(float(c)))


def decay_daily(dt_ms: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + dt_ms.cast("double") / F.lit(float(DAY_MS)))


def degree_penalty(nx: Column, ny: Column, alpha: float) -> Column:
    """Falls with the frequencies of both items; in double, as the product may pass an int's range."""
    return F.lit(1.0) / F.pow(F.greatest(nx.cast("double"), F.lit(1.0)) * F.greatest(ny.cast("double"), F.lit(1.0)), F.lit(float(alpha)))


def smoothed_rate(num: Column, den: Column, prior: Column, strength: float) -> Column:
    return (num + F.lit(float(strength)) * prior) / (den + F.lit(float(strength)))


def hash_draw(*keys: Column, seed: int) -> Column:
    """A number below HASH_RANGE that follows from the keys and the seed alone, by a hash that other engines have too."""
    return F.conv(F.substring(key_hash(*keys, seed=seed), 1, 13), 16, 10).cast("long") % HASH_RANGE


def key_hash(*keys: Column, seed: int) -> Column:
    """md5 of the keys and the seed with slashes between, in hexadecimal; null keys are left out."""
    return F.md5(F.concat_ws("/", *[k.cast("string") for k in keys], F.lit(str(seed))))
