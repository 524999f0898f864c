"""Stateless enrichers used on both tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mastline.functions import scalars as S

# Serving-table columns of one cell reading.
CELL_READING = {
    "cell_id": "cell_id", "tech": "technology", "cell_status": "status", "users": "active_users",
    "downlink_mbps": "throughput_downlink_mbps", "rsrp": "rsrp_dbm", "rsrq": "rsrq_db",
    "sinr": "sinr_db", "cqi": "cqi_avg", "ho_success_rate": "handover_success_rate_percent",
}
LINK_READING = {
    "link_id": "link_id", "link_type": "type", "link_status": "status", "latency_ms": "latency_ms",
    "jitter_ms": "jitter_ms", "packet_loss_percent": "packet_loss_percent",
    "throughput_mbps": "throughput_mbps", "utilization_percent": "utilization_percent",
}


def _site(*names: str):
    where = {"lat": "location.latitude", "lon": "location.longitude"}
    return [F.col(f"ran_metadata.{where.get(n, n)}").alias(n) for n in names]


def cell_stream(parsed: DataFrame, stamp: bool = True) -> DataFrame:
    """One row per cell with site, alert and power context."""
    batteries = F.col("power_system.batteries")
    rows = parsed.select(
        "timestamp", "message_id", *_site("site_id", "site_name", "vendor", "lat", "lon"),
        F.col("alert_summary.highest_severity").alias("alert_severity"),
        S.array_mean("radio_units", "temperature_c").alias("avg_ru_temp"),
        S.first_element(batteries, "charge_percent").alias("battery_charge"),
        S.first_element(batteries, "status").alias("battery_status"),
        F.explode("cells").alias("cell"),
    )
    context = [c for c in rows.columns if c != "cell"]
    out = rows.select(*context, *[F.col(f"cell.{s}").alias(n) for n, s in CELL_READING.items()])
    out = out.withColumn("signal_quality", S.signal_quality("rsrp"))
    return out.withColumn("ingested_at", F.current_timestamp()) if stamp else out


def transport_stream(parsed: DataFrame, stamp: bool = True) -> DataFrame:
    """One row per backhaul link with severity and quality score."""
    rows = parsed.select(
        "timestamp", "message_id", *_site("site_id", "site_name"),
        F.explode("transport_links").alias("link"),
    )
    out = rows.select(
        "timestamp", "message_id", "site_id", "site_name",
        *[F.col(f"link.{s}").alias(n) for n, s in LINK_READING.items()],
    ).withColumns({
        "severity": S.link_severity("utilization_percent", "packet_loss_percent", "latency_ms"),
        "link_quality_score": S.link_score("latency_ms", "jitter_ms", "packet_loss_percent"),
    })
    return out.withColumn("ingested_at", F.current_timestamp()) if stamp else out


def link_alert_text(site: str = "site_name", link: str = "link_id"):
    return F.concat(F.lit("Network issue at site "), F.col(site), F.lit(" on link "), F.col(link))


def weather_stream(parsed: DataFrame, compat: bool = True, stamp: bool = True) -> DataFrame:
    """Rain flag and class. An unknown amount is "Heavy" in compat mode, else null."""
    out = parsed.withColumns({
        "is_raining": S.is_raining("weather_rainfall_mm"),
        "rain_intensity": S.rain_intensity("weather_rainfall_mm", "Heavy" if compat else None),
    })
    return out.withColumn("ingested_at", F.current_timestamp()) if stamp else out
