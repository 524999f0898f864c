"""Column layouts as the SQL twins see them.

Written out here and not read from the library, so that a wrong mapping there
shows as a difference instead of being wrong on both sides. Fixed values.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Part:
    table: str
    component: str | None = None
    slots: int = 0
    where: tuple[str, str] | None = None
    first: dict[str, str] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    means: dict[str, tuple[str, int]] = field(default_factory=dict)
    whole: tuple[str, ...] = ()
    surplus: str | None = None


SITE = Part(
    table="site_snapshot",
    first={
        "generator_status": "gen_status", "door_status": "door_status", "smoke_detected": "smoke_detected",
    },
    modes={
        "env_status": "env_status", "env_opState": "env_op_state",
    },
    means={
        "gen_fuel_level_percent": ("fuel_level_pct", 2), "gen_runtime_hours": ("runtime_hours", 2),
    },
)
RADIO = Part(
    table="radio_units", component="ru_id", slots=3, surplus="RU_surplus",
    first={
        "RU{slot}_Sk": "ru_id", "RU{slot}_sector_key": "sector_id",
    },
    modes={
        "RU{slot}_status": "status", "RU{slot}_op_state": "op_state",
    },
    means={
        "RU{slot}_temperature_c": ("temperature_c", 2), "RU{slot}_tx_power_watts": ("tx_power_watts", 2),
        "RU{slot}_rx_signal_strength_dbm": ("rx_signal_dbm", 2), "RU{slot}_vswr": ("vswr", 2),
        "RU{slot}_current_ampere": ("current_ampere", 2), "RU{slot}_voltage_volt": ("voltage_volt", 2),
        "RU{slot}_packet_error_rate": ("packet_error_rate", 4), "RU{slot}_throughput_mbps": ("throughput_mbps", 2),
    },
)
BASEBAND = Part(
    table="baseband_units", whole=("BBU_active_users",),
    first={
        "BBU_Sk": "bbu_id",
    },
    modes={
        "BBU_status": "status", "BBU_op_state": "op_state",
    },
    means={
        "BBU_cpu_utilization_percent": ("cpu_pct", 2), "BBU_memory_utilization_percent": ("memory_pct", 2),
        "BBU_disk_usage_percent": ("disk_pct", 2), "BBU_process_latency_ms": ("process_latency_ms", 2),
        "BBU_active_users": ("active_users", 0), "BBU_control_plane_latency_ms": ("control_latency_ms", 2),
    },
)
ANTENNA = Part(
    table="antennas", component="antenna_id", slots=3, surplus="antenna_surplus",
    first={
        "antenna{slot}_Sk": "antenna_id", "antenna{slot}_sector_key": "sector_id",
    },
    modes={
        "antenna{slot}_status": "status", "antenna{slot}_opState": "op_state",
    },
    means={
        "antenna{slot}_rssi_dbm": ("rssi_dbm", 2), "antenna{slot}_snr_db": ("snr_db", 2),
    },
)
LINK = Part(
    table="transport_links", component="link_id", slots=2, surplus="link_surplus",
    first={
        "link{slot}_Sk": "link_id",
    },
    modes={
        "link{slot}_status": "status", "link{slot}_opState": "op_state",
    },
    means={
        "link{slot}_latency_ms": ("latency_ms", 2), "link{slot}_jitter_ms": ("jitter_ms", 2),
        "link{slot}_packet_loss_percent": ("packet_loss_percent", 4),
        "link{slot}_throughput_mbps": ("throughput_mbps", 2),
        "link{slot}_utilization_percent": ("utilization_percent", 2),
    },
)
RECTIFIER = Part(
    table="rectifiers", component="rectifier_id", slots=2, surplus="rect_surplus",
    first={
        "rect{slot}_sk": "rectifier_id",
    },
    modes={
        "rect{slot}_status": "status",
    },
    means={
        "rect{slot}_output_voltage_volt": ("output_voltage_volt", 2),
        "rect{slot}_current_ampere": ("current_ampere", 2),
    },
)
BATTERY = Part(
    table="batteries", component="battery_id", slots=2, surplus="battery_surplus",
    first={
        "battery{slot}_sk": "battery_id",
    },
    modes={
        "battery{slot}_status": "status", "battery{slot}_opState": "op_state",
    },
    means={
        "battery{slot}_charge_percent": ("charge_pct", 2), "battery{slot}_temperature_c": ("temperature_c", 2),
    },
)
TEMPERATURE = Part(
    table="environment_sensors", component="sensor_id", slots=2, where=("sensor_type", "TEMPERATURE"),
    surplus="temp_sensor_surplus",
    first={
        "temp_sensor{slot}_Sk": "sensor_id",
    },
    means={
        "temp_sensor{slot}_value_c": ("value", 2),
    },
)
HUMIDITY = Part(
    table="environment_sensors", where=("sensor_type", "HUMIDITY"),
    means={
        "Humd_sensor_value_percent": ("value", 2),
    },
)
JOINED = [RADIO, BASEBAND, ANTENNA, LINK, RECTIFIER, BATTERY, TEMPERATURE, HUMIDITY]
CELL_MEANS = [
    "prb_utilization_percent", "throughput_downlink_mbps", "throughput_uplink_mbps", "rsrp_dbm", "rsrq_db",
    "sinr_db", "cqi_avg", "spectral_efficiency_bps_per_hz", "bler_downlink_percent", "bler_uplink_percent",
    "harq_retransmission_rate_percent", "latency_downlink_ms", "latency_uplink_ms", "rrc_success_rate_percent",
    "erab_setup_success_rate_percent", "call_drop_rate_percent", "abnormal_release_rate_percent",
]
METRICS = [
    "status", "op_state", "active_users", "connected_users", "prb_utilization_percent", "throughput_downlink_mbps",
    "throughput_uplink_mbps", "spectral_efficiency_bps_per_hz", "rsrp_dbm", "rsrq_db", "sinr_db", "cqi_avg",
    "bler_downlink_percent", "bler_uplink_percent", "harq_retransmission_rate_percent", "latency_downlink_ms",
    "latency_uplink_ms", "handover_attempts", "handover_success_rate_percent", "handover_failures",
    "rrc_connection_attempts", "rrc_success_rate_percent", "erab_setup_success_rate_percent",
    "call_drop_rate_percent", "abnormal_release_rate_percent", "technology", "bandwidth_mhz",
]
COUNTERS = [
    "handover_attempts", "handover_failures", "rrc_connection_attempts",
]
HEADCOUNTS = [
    "active_users", "connected_users",
]
CATEGORIES = [
    "status", "op_state", "technology",
]
ROLL_KPIS = [
    "prb_utilization_percent", "throughput_downlink_mbps", "throughput_uplink_mbps", "sinr_db", "rsrp_dbm",
    "rsrq_db", "cqi_avg", "bler_downlink_percent", "bler_uplink_percent", "harq_retransmission_rate_percent",
    "latency_downlink_ms", "latency_uplink_ms", "call_drop_rate_percent", "handover_success_rate_percent",
]
LAG_KPIS = [
    "prb_utilization_percent", "sinr_db", "rsrp_dbm", "bler_downlink_percent", "call_drop_rate_percent",
]
DELTA_KPIS = [
    "prb_utilization_percent", "sinr_db", "bler_downlink_percent",
]
ROLL_WINDOWS = [3, 6, 12, 24]
LAG_STEPS = [1, 3, 6, 12]
DELTA_STEPS = [1, 3]
STATUS_CODES = {
    "UP": 1, "ACTIVE": 1, "ON": 1, "OK": 1, "OPERATIONAL": 1, "NORMAL": 1, "DOWN": 0, "INACTIVE": 0, "OFF": 0,
    "FAILED": 0, "FAULT": 0, "DEGRADED": 2, "WARNING": 2, "PARTIAL": 2, "STANDBY": 3, "IDLE": 3,
}
TECHNOLOGY_CODES = {
    "2G": 0, "3G": 1, "4G": 2, "5G": 3, "NR": 3,
}
