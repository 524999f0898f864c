"""SQL building blocks of the oracle: the derived inputs and small helpers."""

from __future__ import annotations

from mastline_queries import inputs as I

BASE = "message_id, snapshot_time, sequence_number, site_id, site_name, region"

MSG = f"""msg AS (
  SELECT h, site, message_id, CASE WHEN {I.BAD_TIME} THEN NULL ELSE seen_at END AS snapshot_time, sequence_number,
         site_id, site_name, region, CASE WHEN {I.BAD_TIME} THEN 'not a time'
         ELSE strftime(seen_at, '%Y-%m-%dT%H:%M:%SZ') END AS time_text
  FROM (SELECT {I.HASH} AS h, l_suppkey AS site,
               concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                         strftime(l_shipdate, '%Y%m%d'), CAST(floor(l_extendedprice) AS BIGINT)) AS message_id,
               TIMESTAMP '2026-01-01 00:00:00'
                 + to_minutes(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)))
                 + to_seconds(l_linenumber * 7) AS seen_at,
               l_orderkey AS sequence_number, concat('SITE_', l_suppkey) AS site_id,
               s_name AS site_name, r_name AS region
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey))"""

LON = I.LONGITUDE.replace("(site - site % 40) / 40", "(site - site % 40) // 40")


def rnd(x: str, digits: int) -> str:
    """Round half up on the shortest decimal form of a double."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)"


def part(name: str, rename: dict[str, str] | None = None, upper: tuple[str, ...] = ()) -> str:
    """A component table as a union over its slots."""
    make, n = I.PARTS[name]
    rename = rename or {}
    pieces = []
    for i in range(1, n + 1):
        cols = ", ".join(
            (f"upper({e})" if f in upper else e) + f" AS {rename.get(f, f)}" for f, e in make(i).items())
        pieces.append(f"SELECT {BASE}, {cols} FROM msg WHERE {I.PRESENT}")
    return f"{name} AS (" + " UNION ALL ".join(pieces) + ")"


CELLS = part("cells", {"status": "cell_status", "op_state": "cell_op_state"})
RADIOS = part("radio_units", {"rx_signal_strength_dbm": "rx_signal_dbm"})
ANTENNAS = part("antennas")
BASEBANDS = part("baseband_units", {
    "cpu_utilization_percent": "cpu_pct", "memory_utilization_percent": "memory_pct",
    "disk_usage_percent": "disk_pct", "control_plane_latency_ms": "control_latency_ms",
    "user_plane_latency_ms": "user_latency_ms"})
LINKS = part("transport_links", {"type": "link_type"}, ("type",))
RAW_LINKS = part("transport_links", {"type": "link_type"})
BATTERIES = part("batteries", {"charge_percent": "charge_pct"})
RECTIFIERS = part("rectifiers")

_alert_rows = []
for _cond, _fields in I.ALERTS:
    _cols = ", ".join(
        e.format(text="VARCHAR").replace("(h / 6)", "(h // 6)") + f" AS {n}" for n, e in _fields.items())
    _alert_rows.append(f"SELECT {BASE}, {_cols} FROM msg WHERE {_cond}")
_none = " AND ".join(f"NOT ({c})" for c, _ in I.ALERTS)
_nulls = ", ".join(f"NULL AS {n}" for n in I.ALERTS[0][1])
ALERTS = "alerts AS (" + " UNION ALL ".join(_alert_rows) + f" UNION ALL SELECT {BASE}, {_nulls} FROM msg WHERE {_none})"

SENSORS = "environment_sensors AS (" + " UNION ALL ".join(
    [f"SELECT {BASE}, 'TEMPERATURE' AS sensor_type, '{i}' AS sensor_id, {e} AS value, 'C' AS unit, "
     f"CASE WHEN {e} > 40 THEN 'CRITICAL' WHEN {e} > 37 THEN 'HIGH' ELSE 'OK' END AS status FROM msg"
     for i, e in I.TEMPERATURES]
    + [f"SELECT {BASE}, 'HUMIDITY', '{I.HUMIDITY[0]}', {I.HUMIDITY[1]}, 'percent', "
       f"CASE WHEN {I.HUMIDITY[1]} > 80 THEN 'HIGH' ELSE 'OK' END FROM msg"]) + ")"

_a1, _a2 = I.ALERTS[0][0], I.ALERTS[1][0]
SITES = (
    f"site_snapshot AS (SELECT {BASE}, "
    + ", ".join(f"{e} AS {n}" for n, e in I.SITE.items())
    + f", {I.LATITUDE} AS latitude, {LON} AS longitude, "
    f"(CASE WHEN {_a1} THEN 1 ELSE 0 END + CASE WHEN {_a2} THEN 1 ELSE 0 END) AS total_alerts, "
    f"CASE WHEN {_a1} THEN 1 ELSE 0 END AS critical_alerts, "
    f"CASE WHEN {_a2} AND h % 3 <> 0 THEN 1 ELSE 0 END AS warning_alerts, "
    f"CASE WHEN {_a2} AND h % 3 = 0 THEN 1 ELSE 0 END AS info_alerts, "
    f"CASE WHEN {_a1} THEN 'CRITICAL' WHEN {_a2} AND h % 3 <> 0 THEN 'WARNING' WHEN {_a2} THEN 'INFO' "
    "ELSE 'NONE' END AS highest_severity FROM msg)")

WEATHER = f"""wx AS (
  SELECT k, site, ingested_at, strftime(ingested_at, '%Y-%m-%dT%H:%M:%SZ') AS event_timestamp,
         {I.WEATHER['source_system']} AS source_system,
         concat(CAST({I.LATITUDE} AS VARCHAR), ',', CAST({LON} AS VARCHAR)) AS location_query,
         CASE WHEN k % 5 = 0 OR site % 10 = 3 THEN '' ELSE concat('SITE_', site) END AS ran_site_id,
         concat('Tower ', site) AS ran_site_name, concat('Zone ', site % 5) AS ran_region,
         {', '.join(I.WEATHER[c].format(text='VARCHAR') + ' AS ' + c for c in I.WEATHER if c != 'source_system')},
         strftime(ingested_at, '%Y-%m-%d %H:%M') AS weather_observed_at,
         {I.LATITUDE} AS weather_latitude, {LON} AS weather_longitude
  FROM (SELECT o_orderkey AS k, o_custkey % 100 AS site,
               TIMESTAMP '2026-01-01 00:00:00'
                 + to_minutes(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)))
                 + to_seconds(o_orderkey % 60) AS ingested_at FROM orders)),
wxr AS (
  SELECT *, COALESCE(weather_rainfall_mm > 0, FALSE) AS is_raining,
         CASE WHEN weather_rainfall_mm IS NULL THEN 'Heavy' WHEN weather_rainfall_mm = 0 THEN 'None'
              WHEN weather_rainfall_mm < 2.5 THEN 'Light' WHEN weather_rainfall_mm < 7.6 THEN 'Moderate'
              ELSE 'Heavy' END AS rain_intensity FROM wx)"""

SCORES = f"""scores AS (
  SELECT k, TIMESTAMP '2026-01-01 00:00:00'
           + to_hours(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) // 8) AS timestamp,
         concat('SITE_', o_custkey % 100) AS site_id, k % 3 + 1 AS cell_id,
         {I.PROBABILITY} AS probability,
         CASE WHEN (k * 37) % 1024 + (k * 101) % 700 > 900 THEN 1 ELSE 0 END AS label
  FROM (SELECT *, o_orderkey AS k FROM orders))"""


def risk(p: str) -> str:
    return (f"CASE WHEN {p} >= 0.75 THEN 'CRITICAL' WHEN {p} >= 0.55 THEN 'HIGH' "
            f"WHEN {p} >= 0.30 THEN 'MEDIUM' ELSE 'LOW' END")


def bucket(ts: str = "snapshot_time", width: str = "15 minutes") -> str:
    return f"time_bucket(INTERVAL '{width}', {ts})"


def stamp(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def day(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d')"


def mode(name: str, source: str, keys: str, column: str, out: str | None = None) -> str:
    """Most frequent non-null value per key, smallest on ties."""
    return (
        f"{name} AS (SELECT {keys}, min({column}) AS {out or column} FROM ("
        f"SELECT {keys}, {column}, n, max(n) OVER (PARTITION BY {keys}) AS top FROM ("
        f"SELECT {keys}, {column}, count(*) AS n FROM {source} WHERE {column} IS NOT NULL "
        f"GROUP BY {keys}, {column})) WHERE n = top GROUP BY {keys})")


def query(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
