"""Scalar expressions shared by the batch and the streaming operators.

Spark 4 evaluates casts, divisions and array access in ANSI mode; every
expression here yields null on bad input instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from mastline.schemas import SNAPSHOT_TIME_FORMAT

# "1d", "NaN" and padded text parse as doubles in Spark, but are not readings.
NUMERIC_TEXT = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ladder(steps: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """First matching condition wins; a null condition never matches."""
    out: Column | None = None
    for condition, value in steps:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    assert out is not None, "a ladder needs at least one step"
    return out.otherwise(default)


# -- text, time and keys -----------------------------------------------------

def snapshot_time(text: Column | str) -> Column:
    return F.try_to_timestamp(as_col(text), F.lit(SNAPSHOT_TIME_FORMAT))


def numeric_value(text: Column | str) -> Column:
    c = as_col(text)
    return F.when(c.rlike(NUMERIC_TEXT), c.try_cast("double"))


def token_value(text: Column | str) -> Column:
    c = as_col(text)
    return F.when(numeric_value(c).isNull() & c.isNotNull(), c)


def date_key(ts: Column | str) -> Column:
    return F.date_format(as_col(ts), "yyyyMMdd").cast("int")


def time_key(ts: Column | str) -> Column:
    return F.date_format(as_col(ts), "HHmm").cast("int")


def surrogate_key(*parts: Column | str) -> Column:
    cols = [as_col(p) for p in parts]
    return F.md5(cols[0] if len(cols) == 1 else F.concat_ws("|", *[c.cast("string") for c in cols]))


def geo_key(lat: Column | str, lon: Column | str) -> Column:
    """Coordinates at three decimals; null when either side is unknown."""
    la, lo = (F.round(as_col(c), 3).cast("decimal(9,3)").cast("string") for c in (lat, lon))
    return F.concat(la, F.lit("_"), lo)


def query_geo_key(query: Column | str) -> Column:
    """Key of a "lat,lon" text; place names and bad numbers give null."""
    parts = F.split(as_col(query), ",")
    lat, lon = (F.trim(F.get(parts, i)) for i in (0, 1))
    return geo_key(numeric_value(lat), numeric_value(lon))


# -- classifications -----------------------------------------------------------

def temperature_status(c: Column | str) -> Column:
    v = as_col(c)
    return ladder([(v > 40, "CRITICAL"), (v > 37, "HIGH")], "OK")


def humidity_status(c: Column | str) -> Column:
    return ladder([(as_col(c) > 80, "HIGH")], "OK")


def signal_quality(rsrp: Column | str) -> Column:
    v = as_col(rsrp)
    return ladder([(v > -80, "Excellent"), (v > -95, "Good")], "Poor")


def link_severity(utilization: Column | str, loss: Column | str, latency: Column | str) -> Column:
    return ladder(
        [
            (as_col(utilization) > 95, "CRITICAL"),
            (as_col(loss) > 1, "CRITICAL"),
            (as_col(latency) > 50, "WARNING"),
        ],
        "NORMAL",
    )


def link_score(latency: Column | str, jitter: Column | str, loss: Column | str) -> Column:
    return F.lit(100.0) - as_col(latency) * 1.5 - as_col(jitter) * 2 - as_col(loss) * 20


def is_raining(mm: Column | str) -> Column:
    return F.coalesce(as_col(mm) > 0, F.lit(False))


def rain_intensity(mm: Column | str, unknown: str | None = "Heavy") -> Column:
    """Rain class; an unknown amount falls to ``unknown`` (pass None for null)."""
    v = as_col(mm)
    return ladder(
        [
            (v.isNull(), F.lit(unknown)),
            (v == 0, "None"),
            (v < 2.5, "Light"),
            (v < 7.6, "Moderate"),
        ],
        "Heavy",
    )


RISK_FLOORS = {"MEDIUM": 0.30, "HIGH": 0.55, "CRITICAL": 0.75}
RISK_RANK = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}
SEVERITY_RANK = {"CRITICAL": 0, "WARNING": 1, "INFO": 2}


def risk_level(probability: Column | str) -> Column:
    """Band of a probability; null and NaN count as LOW."""
    p = F.nanvl(as_col(probability).cast("double"), F.lit(None).cast("double"))
    bands = sorted(RISK_FLOORS.items(), key=lambda item: -item[1])
    return ladder([(p >= floor, name) for name, floor in bands], "LOW")


def rank_of(label: Column | str, ranks: Mapping[str, int], default: int) -> Column:
    return lookup(label, ranks, default)


def lookup(value: Column | str, mapping: Mapping[str, int], default: int | None = None) -> Column:
    """Constant dictionary lookup as a map literal (no join, no shuffle)."""
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    # Indexing a map literal by null is null, and a missing key is null too.
    found = F.try_element_at(F.create_map(*entries), as_col(value))
    return found if default is None else F.coalesce(found, F.lit(default))


# -- arrays ----------------------------------------------------------------------

def array_mean(array: Column | str, field: str) -> Column:
    """Mean of a struct field; null for an empty array or any null element."""
    arr = as_col(array)
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x[field].cast("double"))
    return F.try_divide(total, F.size(arr))


def first_element(array: Column | str, field: str) -> Column:
    return F.get(as_col(array), 0)[field]
