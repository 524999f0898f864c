"""Declarative alert rules, compiled into one array per row.

A rule is (condition, severity, category, ...). All rules of a row become one
array of structs; rules that do not fire leave nulls, which are filtered before
the explode. Each source is scanned once and nothing is shuffled to fire rules.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mastline.functions import scalars as S

# ---------------------------------------------------------------------------
# Snapshot alerts. Categories, codes, texts and thresholds.
# ---------------------------------------------------------------------------
PARTS = [
    # array path, category, component type, id field
    ("radio_units", "radio", "radio_unit", "ru_id"),
    ("antennas", "radio", "antenna", "antenna_id"),
    ("cells", "radio", "cell", "cell_id"),
    ("baseband_units", "core", "baseband_unit", "bbu_id"),
    ("transport_links", "transport", "transport_link", "link_id"),
    ("power_system.rectifiers", "power", "rectifier", "rectifier_id"),
    ("power_system.batteries", "power", "battery", "battery_id"),
]
LIMITS = {
    "fuel": 20, "battery": 20, "ru_temperature": 60, "prb": 90, "sinr": 0, "handover": 90,
}


def _alert(severity, category, kind, component, code, message, value) -> Column:
    def text(x):
        return (x if isinstance(x, Column) else F.lit(x)).cast("string")
    component = text(component)
    site = F.col("ran_metadata.site_id")
    alert_id = F.concat_ws("-", site, F.col("sequence_number").cast("string"), F.lit(code), component)
    return F.struct(
        alert_id.alias("alert_id"), text(severity).alias("severity"), text(category).alias("category"),
        text(kind).alias("component_type"), component.alias("component_id"), text(code).alias("code"),
        text(message).alias("message"), text(value).alias("value"),
    )


def _state_alert(category: str, kind: str, id_field: str):
    # Lambdas are interpreted, node by node: each level has its own texts, and none is worked out twice.
    def one(item: Column) -> Column:
        state = item["op_state"]
        down = (state.eqNullSafe("FAILED")) | (item["status"].eqNullSafe("DOWN"))
        name = F.coalesce(item[id_field], F.lit("unknown"))
        return S.ladder([
            (fires, _alert(severity, category, kind, name, f"COMPONENT_{level}",
                           F.concat(F.lit(f"{kind} "), name, F.lit(f" is {level.lower()}")), state))
            for fires, severity, level in [
                (down, "CRITICAL", "DOWN"), (state == "DEGRADED", "WARNING", "DEGRADED"),
                (state == "RECOVERING", "INFO", "RECOVERING")]])
    return one


def _kpi_alerts(limits) -> list[tuple[str, object]]:
    def low_battery(b):
        return F.when(b["charge_percent"] < limits["battery"], _alert(
            "WARNING", "power", "battery", b["battery_id"], "LOW_BATTERY_CHARGE",
            "Battery charge is below 20 percent", b["charge_percent"]))

    def hot_radio(r):
        return F.when(r["temperature_c"] >= limits["ru_temperature"], _alert(
            "WARNING", "radio", "radio_unit", r["ru_id"], "RU_HIGH_TEMPERATURE",
            "Radio unit temperature is high", r["temperature_c"]))

    def congested(c):
        return F.when(c["prb_utilization_percent"] >= limits["prb"], _alert(
            "WARNING", "radio", "cell", c["cell_id"], "CELL_CONGESTION",
            "Cell PRB utilization is above 90 percent", c["prb_utilization_percent"]))

    def noisy(c):
        return F.when(c["sinr_db"] < limits["sinr"], _alert(
            "WARNING", "radio", "cell", c["cell_id"], "LOW_SINR",
            "Cell SINR is below 0 dB", c["sinr_db"]))

    def lossy(c):
        rate = c["handover_success_rate_percent"]
        return F.when(rate < limits["handover"], _alert(
            "WARNING", "mobility", "cell", c["cell_id"], "LOW_HANDOVER_SUCCESS",
            "Cell handover success rate is below 90 percent", rate))

    return [("power_system.batteries", low_battery), ("radio_units", hot_radio),
            ("cells", congested), ("cells", noisy), ("cells", lossy)]


def _site_alerts(limits) -> list[Column]:
    env, power = F.col("environment"), F.col("power_system")
    generator = power["generator"]
    fuel = generator["fuel_level_percent"]
    rules = [
        (env["status"] == "DOWN", "WARNING", "environment", "environment", "ENV",
         "ENVIRONMENT_SENSOR_DOWN", "Environment sensors are down", env["op_state"]),
        (env["door_status"] == "OPEN", "WARNING", "security", "door", "SHELTER_DOOR",
         "SHELTER_DOOR_OPEN", "Shelter door is open", env["door_status"]),
        (env["smoke_detected"], "CRITICAL", "environment", "smoke_sensor", "SMOKE",
         "SMOKE_DETECTED", "Smoke detected in tower shelter", F.lit(True)),
        (power["status"] == "DOWN", "CRITICAL", "power", "power_system", "POWER",
         "SITE_POWER_DOWN", "Site power system is down", power["status"]),
        (generator["status"] == "ON", "INFO", "power", "generator", "GENERATOR",
         "GENERATOR_RUNNING", "Generator is running", fuel),
        (fuel < limits["fuel"], "WARNING", "power", "generator", "GENERATOR",
         "LOW_GENERATOR_FUEL", "Generator fuel is below 20 percent", fuel),
    ]
    return [F.when(cond, _alert(*rest)) for cond, *rest in rules]


def derive_alerts(raw: DataFrame, limits: dict[str, float] = LIMITS) -> Column:
    """The alerts of one snapshot as a sorted array expression.

    Sorting is within the row: by severity, category, component, code.
    """
    empty = F.array().cast("array<struct<alert_id:string,severity:string,category:string,"
                           "component_type:string,component_id:string,code:string,"
                           "message:string,value:string>>")

    def burst(path: str, make) -> Column:
        return F.coalesce(F.transform(F.col(path), make), empty)

    fired = F.concat(
        *[burst(path, _state_alert(cat, kind, id_field)) for path, cat, kind, id_field in PARTS],
        F.array(*_site_alerts(limits)),
        *[burst(path, rule) for path, rule in _kpi_alerts(limits)],
    )
    live = F.filter(fired, lambda a: a.isNotNull())
    keyed = F.transform(live, lambda a: F.struct(
        S.rank_of(a["severity"], S.SEVERITY_RANK, 9).alias("r"), a["category"].alias("c"),
        a["component_id"].alias("i"), a["code"].alias("k"), a.alias("alert")))
    # No null is left, so the built-in order does; a comparing lambda is interpreted.
    return F.sort_array(keyed)["alert"]


def summarize(alerts: Column) -> Column:
    """Counts per severity and the highest one, as a struct."""
    def count(level: str) -> Column:
        return F.size(F.filter(alerts, lambda a: a["severity"] == level))

    highest = S.ladder(
        [(count("CRITICAL") > 0, "CRITICAL"), (count("WARNING") > 0, "WARNING"), (F.size(alerts) > 0, "INFO")],
        "NONE")
    return F.struct(
        F.size(alerts).alias("total"), count("CRITICAL").alias("critical"),
        count("WARNING").alias("warning"), count("INFO").alias("info"),
        highest.alias("highest_severity"))


def with_derived_alerts(raw: DataFrame) -> DataFrame:
    """Snapshots with ``alerts`` and ``alert_summary`` recomputed."""
    staged = raw.drop("alerts", "alert_summary").withColumn("alerts", derive_alerts(raw))
    return staged.withColumn("alert_summary", summarize(F.col("alerts")))


def alert_counts(alerts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per-group alert totals over the flat alert table."""
    sev = F.col("severity")
    return alerts.groupBy(*keys).agg(
        F.count("alert_id").alias("total"),
        F.count_if(sev == "CRITICAL").alias("critical"),
        F.count_if(sev == "WARNING").alias("warning"),
        F.count_if(sev == "INFO").alias("info"),
        F.coalesce(F.min_by("severity", F.when(sev.isNotNull(), S.rank_of(sev, S.SEVERITY_RANK, 9))),
                   F.lit("NONE")).alias("highest_severity"),
    )


# ---------------------------------------------------------------------------
# Live alert feed
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Rule:
    condition: Column
    severity: str
    category: str
    message: Column


def _text(pattern: str, *cols: Column) -> Column:
    """printf text; unknown names show as "?" and unknown numbers as 0."""
    return F.format_string(pattern, *cols)


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def _site() -> Column:
    return F.coalesce("site_name", F.lit("Unknown"))


def _bad_battery() -> Column:
    return F.coalesce(F.upper("battery_status").isin("DOWN", "FAILED"), F.lit(False))


def _not_up() -> Column:
    return F.coalesce(F.col("cell_status") != "UP", F.lit(True))


# Dashboard alerts and diagnoses. Texts, categories and thresholds.
def cell_rules(handover: float = 93, battery: float = 20) -> list[Rule]:
    cell = F.coalesce("cell_id", F.lit("?"))
    return [
        Rule(F.col("alert_severity") == "CRITICAL", "CRITICAL", "Network",
             _text("Critical alert at %s — highest severity on cell %s", _site(), cell)),
        Rule(_bad_battery(), "CRITICAL", "Power",
             _text("Damaged battery at %s — battery status: %s", _site(), F.col("battery_status"))),
        Rule(~_bad_battery() & (F.col("battery_charge") < battery), "WARNING", "Power",
             _text("Low battery at %s — charge %.0f%%", _site(), F.col("battery_charge"))),
        Rule(_not_up(), "CRITICAL", "Radio",
             _text("Cell %s is DOWN at %s — check RU/antenna/backhaul", cell, _site())),
        Rule(~_not_up() & (F.col("signal_quality") == "Poor"), "WARNING", "Signal",
             _text("Poor signal on %s at %s — RSRP %.1f dBm", cell, _site(), _n("rsrp"))),
        Rule(F.col("ho_success_rate") < handover, "WARNING", "Mobility",
             _text("Low handover success on %s at %s — HSR %.1f%%", cell, _site(), F.col("ho_success_rate"))),
    ]


def link_rules() -> list[Rule]:
    link = F.coalesce("link_id", F.lit("?"))
    return [
        Rule(F.col("severity") == "CRITICAL", "CRITICAL", "Transport",
             _text("Backhaul CRITICAL on link %s at %s — latency %.1fms, loss %.2f%%",
                   link, _site(), _n("latency_ms"), _n("packet_loss_percent"))),
        Rule(F.col("severity") == "WARNING", "WARNING", "Transport",
             _text("Backhaul degradation on %s at %s — utilization %.1f%%", link, _site(),
                   _n("utilization_percent"))),
    ]


def weather_rules(downlink: float = 100) -> list[Rule]:
    known = F.col("weather_temperature_c").isNotNull()
    return [
        Rule(known & F.col("rain_intensity").isin("Moderate", "Heavy") & (F.col("signal_quality") == "Poor"),
             "WARNING", "Weather",
             _text("Heavy rainfall (%s) may be affecting %s at %s — SINR %.1f dB",
                   F.col("rain_intensity"), F.col("cell_id"), _site(), _n("sinr"))),
        Rule(known & F.col("is_raining") & (F.col("downlink_mbps") < downlink), "WARNING", "Weather",
             _text("Throughput drop during rain at %s — downlink %.0f Mbps", _site(), F.col("downlink_mbps"))),
    ]


def fire(df: DataFrame, rules: Sequence[Rule], source: int, order: Sequence[str]) -> DataFrame:
    """Rows of ``df`` to alerts, each with its place in the reading order."""
    built = [
        F.when(r.condition, F.struct(
            F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"),
            _site().alias("site"), r.message.alias("message"), F.col("ingested_at").alias("time"),
            F.struct(F.lit(source).alias("s"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(order)],
                     F.lit(i).alias("r")).alias("place")))
        for i, r in enumerate(rules)
    ]
    live = F.filter(F.array(*built), lambda a: a.isNotNull())
    return df.select(F.explode(live).alias("a")).select("a.*")


def alert_feed(cells: DataFrame, links: DataFrame, cells_weather: DataFrame | None = None) -> DataFrame:
    """Alerts of the latest rows; of equal (severity, site, message) the first
    stays. The reading order is cells, links, weather, each by its key."""
    parts = [fire(cells, cell_rules(), 0, ["site_id", "cell_id"]),
             fire(links, link_rules(), 1, ["site_id", "link_id"])]
    if cells_weather is not None:
        parts.append(fire(cells_weather, weather_rules(), 2, ["site_id", "cell_id"]))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    first = F.min_by(F.struct("category", "time"), F.col("place"))
    return (
        every.groupBy("severity", "site", "message").agg(first.alias("_f"))
        .select("severity", F.col("_f.category").alias("category"), "site", "message",
                F.col("_f.time").alias("time"))
    )


def severity_order(severity: str = "severity", time: str = "time") -> list[Column]:
    return [S.rank_of(severity, S.SEVERITY_RANK, 9).asc(),
            F.coalesce(F.col(time).cast("string"), F.lit("")).asc()]


def top_alerts(feed: DataFrame, k: int = 8) -> DataFrame:
    """The first ``k`` alerts by severity, then time (a top-k report)."""
    return feed.orderBy(*severity_order(), "site", "message").limit(k)


# The texts and thresholds of the diagnosis, in order.
def diagnose_cell(handover: float = 93) -> Column:
    """Most likely cause of a cell's state, first match wins."""
    return S.ladder(
        [
            (_not_up(), F.lit("Cell radio unit or sector reported DOWN — possible hardware or power fault.")),
            (F.col("signal_quality") == "Poor", _text(
                "Weak RF coverage — RSRP %.1f dBm, possible interference or weather fade.", _n("rsrp"))),
            (F.col("ho_success_rate") < handover, _text(
                "Mobility issues — handover success %.1f%% below threshold.", F.col("ho_success_rate"))),
            (_bad_battery(), F.lit("Site power/battery fault may be impacting cell availability.")),
        ],
        F.lit("No major fault detected — cell operating within normal parameters."),
    )
