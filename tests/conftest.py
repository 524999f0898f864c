import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mastline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s



def message(**changes):
    """A small snapshot: one site, healthy but for its first battery."""
    up = {"status": "UP", "op_state": "HEALTHY"}
    body = {
        "message_id": "m-1", "timestamp": "2026-05-20T12:45:18Z", "sequence_number": 1,
        "ran_metadata": {"site_id": "SITE_001", "site_name": "AL_TOWER_01", "region": "Alexandria",
                         "vendor": "Ericsson", "technology": ["4G", "5G"],
                         "location": {"latitude": 31.2001, "longitude": 29.9187}},
        "radio_units": [
            {"ru_id": f"RU_{i}", "sector_id": f"S{i}", **up, "temperature_c": t, "packet_error_rate": 0.01}
            for i, t in ((1, 35.5), (2, 33.0), (3, 35.4))],
        "antennas": [{"antenna_id": f"ANT_{i}", "sector_id": f"S{i}", **up} for i in (1, 2, 3)],
        "baseband_units": [{"bbu_id": "BBU_MAIN", **up, "active_users": 240}],
        "cells": [
            {"cell_id": f"CELL_{i}", "sector_id": f"S{i}", "technology": tech, **up, "active_users": 80,
             "connected_users": users, "throughput_downlink_mbps": dl, "throughput_uplink_mbps": ul,
             "rsrp_dbm": rsrp, "sinr_db": sinr, "prb_utilization_percent": 20.0, "handover_attempts": att,
             "handover_failures": fail, "handover_success_rate_percent": 96.3}
            for i, tech, users, dl, ul, rsrp, sinr, att, fail in (
                (1, "4G", 96, 130.0, 115.92, -83.76, 16.87, 159, 5),
                (2, "5G", 90, 160.0, 117.96, -83.39, 18.36, 97, 3),
                (3, "5G", 100, 160.0, 124.21, -79.85, 18.63, 77, 2))],
        "transport_links": [
            {"link_id": "BH_1", "type": "fiber", **up, "latency_ms": 1, "jitter_ms": 0.03,
             "packet_loss_percent": 0.0, "utilization_percent": 5.61},
            {"link_id": "BH_2", "type": "microwave", **up, "latency_ms": 3.07, "jitter_ms": 1.02,
             "packet_loss_percent": 0.02, "utilization_percent": 20.67}],
        "power_system": {
            "status": "UP",
            "rectifiers": [{"rectifier_id": f"REC_{i}", **up} for i in (1, 2)],
            "batteries": [
                {"battery_id": "BAT_1", "status": "DOWN", "op_state": "FAILED"},
                {"battery_id": "BAT_2", **up, "charge_percent": 90.5}],
            "generator": {"status": "OFF", "fuel_level_percent": 80.0, "runtime_hours": 0.0}},
        "environment": {
            **up, "temperature_sensors": [{"sensor_id": "TEMP_1", "value_c": 34.5}, {"sensor_id": "TEMP_2", "value_c": 32.9}],
            "humidity_sensors": [{"sensor_id": "HUM_1", "value_percent": 56.1}],
            "door_status": "CLOSED", "smoke_detected": False},
        "alerts": [{"alert_id": "SITE_001-1-COMPONENT_DOWN-BAT_1", "severity": "CRITICAL", "category": "power",
                    "component_type": "battery", "component_id": "BAT_1", "code": "COMPONENT_DOWN",
                    "message": "battery BAT_1 is down", "value": "FAILED"}],
        "alert_summary": {"total": 1, "critical": 1, "warning": 0, "info": 0, "highest_severity": "CRITICAL"},
    }
    body.update(changes)
    return body


@pytest.fixture()
def land(tmp_path):
    """Write messages as JSON lines; returns the folder."""
    def write(*messages, name="a.json"):
        folder = tmp_path / "raw"
        folder.mkdir(exist_ok=True)
        (folder / name).write_text("".join(json.dumps(m) + "\n" for m in messages))
        return str(folder)
    return write
