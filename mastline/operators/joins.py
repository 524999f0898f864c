"""Equi-joins of the serving layer.

No broadcast hints: Spark broadcasts a side when its measured size is below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles, with AQE
splitting skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mastline.functions import scalars as S
from mastline.operators.latest import latest_snapshot

# What a weather row lends to a telemetry row.
WEATHER_FILL = [
    "ran_site_id", "ran_site_name", "weather_temperature_c", "weather_humidity_pct",
    "weather_rainfall_mm", "weather_wind_speed_kmh", "weather_condition",
    "is_raining", "rain_intensity", "weather_location_name",
]
WEATHER_FIELDS = [
    "weather_temperature_c", "weather_humidity_pct", "weather_rainfall_mm", "weather_wind_speed_kmh",
    "weather_condition", "weather_observed_at", "weather_location_name", "weather_region",
    "weather_country", "weather_latitude", "weather_longitude",
]


def assemble_wide(base: DataFrame, parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left-join per-group aggregates. Every input is already partitioned by
    ``keys`` after its own aggregation, so the joins add no shuffle."""
    for part in parts:
        base = base.join(part, list(keys), "left")
    return base


def weather_key(site: str = "ran_site_id", query: str = "location_query") -> Column:
    """A station's identity: its site id, or its location text when blank."""
    site_id = F.trim(F.col(site))
    return F.coalesce(F.when(site_id != "", site_id), F.col(query))


def latest_weather(weather: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    keyed = weather.withColumn("_station", weather_key())
    geo = F.coalesce(S.query_geo_key("location_query"), S.geo_key("weather_latitude", "weather_longitude"))
    return latest_snapshot(keyed, ["_station"], tie=tie).withColumn("_geo", geo)


def join_weather(ran: DataFrame, weather: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """Telemetry with weather by site id, else by rounded coordinates.

    Both weather sides hold one row per key, so the join never multiplies rows.
    """
    current = latest_weather(weather, tie)
    lent = F.struct(*[F.col(c) for c in WEATHER_FILL])
    named = current.where(F.trim("ran_site_id") != "").select(
        F.trim("ran_site_id").alias("_by_site"), lent.alias("_site_wx"))
    newest = F.struct(F.col("ingested_at"), F.col("_station"))
    placed = (
        current.where(F.col("_geo").isNotNull())
        .groupBy(F.col("_geo").alias("_by_geo")).agg(F.max_by(lent, newest).alias("_geo_wx"))
    )
    joined = (
        ran.withColumn("_geo_key", S.geo_key("lat", "lon"))
        .join(named, F.col("site_id") == F.col("_by_site"), "left")
        .join(placed, F.col("_geo_key") == F.col("_by_geo"), "left")
    )
    known = F.col("_site_wx.weather_temperature_c").isNotNull()
    return joined.select(
        *ran.columns,
        *[F.when(known, F.col(f"_site_wx.{c}")).otherwise(F.col(f"_geo_wx.{c}")).alias(c)
          for c in WEATHER_FILL],
    )


def fill_from(primary: DataFrame, fallback_key: str, fallback: DataFrame, key: str,
              columns: Sequence[str], when_missing: str) -> DataFrame:
    """Generic second-chance join: rows whose ``when_missing`` is null take
    ``columns`` from ``fallback``, which holds one row per ``key``."""
    lent = fallback.select(F.col(key).alias("_k"), F.struct(*columns).alias("_lent"))
    missing = F.col(when_missing).isNull()
    joined = primary.join(lent, F.col(fallback_key) == F.col("_k"), "left")
    # The flag is read before any column is replaced.
    replaced = {c: F.when(missing, F.col(f"_lent.{c}")).otherwise(F.col(c)) for c in columns}
    return joined.select(*[replaced[c].alias(c) if c in replaced else F.col(c) for c in primary.columns])


def with_site_metadata(locations: DataFrame, towers: DataFrame) -> DataFrame:
    """Attach tower metadata to locations by region name or by coordinates.

    ``towers`` has an ``ordinal``; a location matching several towers takes the
    first. Values the location brings itself win. Two equi-joins stand in for
    the OR condition, which would otherwise compare every pair.
    """
    fields = [c for c in towers.columns if c != "ordinal"]
    row = F.struct(*[F.col(c) for c in fields])

    def first_per(key: Column) -> DataFrame:
        return towers.groupBy(key.alias("_key")).agg(
            F.min("ordinal").alias("_ord"), F.min_by(row, "ordinal").alias("_tower"))

    by_region = first_per(F.lower("region")).withColumnsRenamed({"_ord": "_o1", "_tower": "_t1", "_key": "_k1"})
    by_query = first_per(F.replace("query", F.lit(" "))).withColumnsRenamed(
        {"_ord": "_o2", "_tower": "_t2", "_key": "_k2"})
    joined = (
        locations
        .join(by_region, F.lower(locations["region"]) == F.col("_k1"), "left")
        .join(by_query, F.replace(locations["query"], F.lit(" ")) == F.col("_k2"), "left")
    )
    tower = F.when(F.col("_o2").isNull() | (F.col("_o1") <= F.col("_o2")), F.col("_t1")).otherwise(F.col("_t2"))
    matched = joined.withColumn("_tower", tower)
    own = [F.coalesce(F.col(c), F.col(f"_tower.{c}")).alias(c) if c in fields else F.col(c)
           for c in locations.columns]
    added = [F.col(f"_tower.{c}").alias(c) for c in fields if c not in locations.columns]
    return matched.select(*own, *added)


def resolve_sites(locations: DataFrame, towers: DataFrame) -> DataFrame:
    """Fill site id and name of locations whose coordinates are a tower's."""
    exact = towers.groupBy(F.col("query").alias("_q")).agg(
        F.min_by(F.struct("site_id", "site_name"), "ordinal").alias("_t"))
    blank = F.coalesce(F.col("site_id"), F.lit("")) == ""
    joined = locations.join(exact, F.col("query") == F.col("_q"), "left")
    hit = blank & F.col("_t").isNotNull()
    swap = {c: F.when(hit, F.col(f"_t.{c}")).otherwise(F.col(c)) for c in ("site_id", "site_name")}
    return joined.select(*[swap[c].alias(c) if c in swap else F.col(c) for c in locations.columns])


def enrich_messages(messages: DataFrame, weather: DataFrame, on: str) -> DataFrame:
    """Messages with the eleven weather fields inserted; ``weather`` has one row
    per ``on``. Fields of the same name in the message are replaced."""
    keep = [c for c in messages.columns if c not in WEATHER_FIELDS]
    return messages.select(*keep).join(weather.select(on, *WEATHER_FIELDS), on, "left")
