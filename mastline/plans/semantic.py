"""Semantic layer: business names to joins and aggregates.

A model is tables (dimensions, measures with a default aggregation) and
many-to-one relationships. ``SemanticModel.query`` resolves names, walks the
relationships from the measures' table to the dimensions' tables, and builds
one DataFrame plan; only many-to-one steps are allowed, so a join never
multiplies fact rows. Facts are aggregated by their foreign keys before they are
joined, so what a join moves is the size of the dimensions. Measures of several facts are aggregated apart and
joined on the shared dimensions.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


AGGREGATES = {
    "avg": F.avg, "sum": F.sum, "max": F.max, "count": F.count, "count_distinct": F.count_distinct,
}
#: Aggregates that combine: columns of a partial row, and the whole from partial rows.
PARTIAL = {
    "avg": lambda c, g: [F.sum(c).alias(f"s__{g}"), F.count(c).alias(f"n__{g}")],
    "sum": lambda c, g: [F.sum(c).alias(f"s__{g}")],
    "max": lambda c, g: [F.max(c).alias(f"s__{g}")],
    "count": lambda c, g: [F.count(c).alias(f"n__{g}")],
}
FINAL = {
    "avg": lambda g: F.try_divide(F.sum(f"s__{g}"), F.sum(f"n__{g}")),
    "sum": lambda g: F.sum(f"s__{g}"),
    "max": lambda g: F.max(f"s__{g}"),
    "count": lambda g: F.coalesce(F.sum(f"n__{g}"), F.lit(0).cast("long")),
}
# Endings a business name usually leaves out.
UNIT_ENDINGS = ("_dbm", "_db", "_percent", "_mbps", "_ms", "_c", "_volt", "_gb", "_mhz", "_degree", "_id", "_avg")


@dataclass(frozen=True)
class Measure:
    column: str | None
    agg: str


@dataclass(frozen=True)
class LogicalTable:
    """``dimensions`` and ``measures`` map logical names to physical columns."""

    source: str
    key: str | None
    dimensions: Mapping[str, str]
    measures: Mapping[str, Measure] = field(default_factory=dict)


@dataclass(frozen=True)
class Relationship:
    left: str
    left_column: str
    right: str
    right_column: str


class UnknownName(KeyError):
    """A business name that no table, or more than one, defines."""


# ---------------------------------------------------------------------------
# The telemetry model, in its own order.
# ---------------------------------------------------------------------------
TABLES = {
    "site": LogicalTable(
        "dim_site", "site_sk",
        {
            "site_sk": "site_sk", "site_id": "site_id", "site_name": "site_name", "region": "region",
            "vendor": "vendor", "latitude": "latitude", "longitude": "longitude",
        },
        {
            "site_count": Measure("site_sk", "count_distinct"),
        }),
    "cell": LogicalTable(
        "dim_cell", "cell_sk",
        {
            "cell_sk": "cell_sk", "cell_id": "cell_id", "site_id": "site_id", "sector_id": "sector_id",
            "technology": "technology", "bandwidth_mhz": "bandwidth_mhz",
            "carrier_frequency_mhz": "carrier_frequency_mhz",
        },
        {
            "cell_count": Measure("cell_sk", "count_distinct"),
        }),
    "radio_unit": LogicalTable(
        "dim_RU", "RU_sk",
        {
            "ru_sk": "RU_sk", "ru_id": "ru_id", "sector_id": "sector_id",
        },
        {
            "ru_count": Measure("RU_sk", "count_distinct"),
        }),
    "antenna": LogicalTable(
        "dim_Antenna", "antenna_sk",
        {
            "antenna_sk": "antenna_sk", "antenna_id": "antenna_id", "sector_id": "sector_id",
            "mimo_layers": "mimo_layers", "azimuth_degree": "azimuth_degree", "tilt_degree": "tilt_degree",
        },
        {
            "antenna_count": Measure("antenna_sk", "count_distinct"),
        }),
    "link": LogicalTable(
        "dim_Link", "link_sk",
        {
            "link_sk": "link_sk", "link_id": "link_id", "link_type": "link_type",
        },
        {
            "link_count": Measure("link_sk", "count_distinct"),
        }),
    "date": LogicalTable(
        "dim_date", "date_sk",
        {
            "date_sk": "date_sk", "year": "Year", "month": "Month", "month_name": "MonthName",
            "quarter": "quarter", "quarter_name": "quarterName", "day_of_month": "DayOfMonth",
            "day_of_week": "DayOfWeek", "week_of_year": "WeekOfYear", "full_date": "Date",
        },
    ),
    "time_of_day": LogicalTable(
        "dim_time", "time_key",
        {
            "time_pk": "time_key", "hour": "hour", "minute": "minute", "time_label": "time_label",
            "day_part": "day_part", "business_hours": "business_hours",
        },
    ),
    "cell_performance": LogicalTable(
        "Fact_Cells", None,
        {
            "cell_key": "cell_key", "ran_key": "RAN_key", "date_key": "date_key", "time_key": "time_key",
            "cell_status": "cell_status", "op_state": "op_state", "congestion_flag": "congestion_flag",
            "snapshot_ts": "timestamp",
        },
        {
            "site_count": Measure("RAN_key", "count_distinct"),
            "cell_count": Measure("cell_key", "count_distinct"),
            "prb_utilization_percent": Measure("prb_utilization_percent", "avg"),
            "throughput_downlink_mbps": Measure("throughput_downlink_mbps", "avg"),
            "throughput_uplink_mbps": Measure("throughput_uplink_mbps", "avg"),
            "rsrp_dbm": Measure("rsrp_dbm", "avg"),
            "rsrq_db": Measure("rsrq_db", "avg"),
            "sinr_db": Measure("sinr_db", "avg"),
            "cqi_avg": Measure("cqi_avg", "avg"),
            "spectral_efficiency_bps_per_hz": Measure("spectral_efficiency_bps_per_hz", "avg"),
            "bler_downlink_percent": Measure("bler_downlink_percent", "avg"),
            "bler_uplink_percent": Measure("bler_uplink_percent", "avg"),
            "harq_retransmission_rate_percent": Measure("harq_retransmission_rate_percent", "avg"),
            "latency_downlink_ms": Measure("latency_downlink_ms", "avg"),
            "latency_uplink_ms": Measure("latency_uplink_ms", "avg"),
            "rrc_success_rate_percent": Measure("rrc_success_rate_percent", "avg"),
            "erab_setup_success_rate_percent": Measure("erab_setup_success_rate_percent", "avg"),
            "call_drop_rate_percent": Measure("call_drop_rate_percent", "avg"),
            "abnormal_release_rate_percent": Measure("abnormal_release_rate_percent", "avg"),
            "handover_success_rate_percent": Measure("handover_success_rate_percent", "avg"),
            "connected_users": Measure("connected_users", "avg"),
            "active_users": Measure("active_users", "avg"),
            "traffic_volume_gb": Measure("traffic_volume_gb", "sum"),
            "rrc_connection_attempts": Measure("rrc_connection_attempts", "sum"),
            "handover_attempts": Measure("handover_attempts", "sum"),
            "handover_failures": Measure("handover_failures", "sum"),
            "peak_users": Measure("peak_users", "max"),
            "snapshot_count": Measure(None, "count"),
        }),
    "equipment_health": LogicalTable(
        "Fact_RAN", None,
        {
            "site_id": "site_id", "ran_key": "RAN_key", "date_key": "date_key", "time_key": "time_key",
            "power_status": "power_status", "env_status": "env_status", "smoke_detected": "smoke_detected",
            "door_status": "door_status", "generator_status": "generator_status", "snapshot_ts": "timestamp",
        },
        {
            "bbu_cpu_utilization_percent": Measure("BBU_cpu_utilization_percent", "avg"),
            "bbu_memory_utilization_percent": Measure("BBU_memory_utilization_percent", "avg"),
            "battery1_charge_percent": Measure("battery1_charge_percent", "avg"),
            "rect1_output_voltage_volt": Measure("rect1_output_voltage_volt", "avg"),
            "ru1_temperature_c": Measure("RU1_temperature_c", "avg"),
            "ru2_temperature_c": Measure("RU2_temperature_c", "avg"),
            "ru3_temperature_c": Measure("RU3_temperature_c", "avg"),
            "ru1_vswr": Measure("RU1_vswr", "avg"),
            "ru2_vswr": Measure("RU2_vswr", "avg"),
            "ru3_vswr": Measure("RU3_vswr", "avg"),
            "temp_sensor1_value_c": Measure("temp_sensor1_value_c", "avg"),
            "humidity_percent": Measure("Humd_sensor_value_percent", "avg"),
            "gen_fuel_level_percent": Measure("gen_fuel_level_percent", "avg"),
            "link1_latency_ms": Measure("link1_latency_ms", "avg"),
            "link1_packet_loss_percent": Measure("link1_packet_loss_percent", "avg"),
            "snapshot_count": Measure(None, "count"),
        }),
    "alarm": LogicalTable(
        "Fact_Alarms", None,
        {
            "site_key": "site_key", "component_key": "component_key", "severity": "severity",
            "alarm_category": "alarm_category", "alarm_msg": "alarm_msg", "date_key": "date_key",
            "time_key": "time_key", "alarm_ts": "snapshot_time",
        },
        {
            "alarm_count": Measure(None, "count"),
        }),
    "ml_predictions": LogicalTable(
        "Fact_ML_Predictions", None,
        {
            "site_id": "site_id", "cell_id": "cell_id", "predicted_failure": "predicted_failure",
            "risk_level": "risk_level", "prediction_date": "prediction_date", "observation_ts": "timestamp_col",
        },
        {
            "failure_probability": Measure("failure_probability", "avg"),
            "prediction_count": Measure(None, "count"),
        }),
}
RELATIONSHIPS = [
    Relationship("cell_performance", "ran_key", "site", "site_sk"),
    Relationship("cell_performance", "cell_key", "cell", "cell_sk"),
    Relationship("cell_performance", "date_key", "date", "date_sk"),
    Relationship("cell_performance", "time_key", "time_of_day", "time_pk"),
    Relationship("cell", "site_id", "site", "site_id"),
    Relationship("equipment_health", "site_id", "site", "site_id"),
    Relationship("equipment_health", "date_key", "date", "date_sk"),
    Relationship("equipment_health", "time_key", "time_of_day", "time_pk"),
    Relationship("alarm", "site_key", "site", "site_sk"),
    Relationship("alarm", "date_key", "date", "date_sk"),
    Relationship("alarm", "time_key", "time_of_day", "time_pk"),
    Relationship("ml_predictions", "site_id", "site", "site_id"),
    Relationship("ml_predictions", "prediction_date", "date", "full_date"),
]
# Business names, English then Arabic, in model order. Names that
# the naming rules yield (spaces for underscores, no unit) are not repeated;
# further ones are a parameter of the model.
SYNONYMS = {
    "site.site_id": ["site code", "معرف الموقع"],
    "site.site_name": ["tower", "tower name", "site", "البرج", "اسم البرج", "الموقع"],
    "site.region": ["governorate", "province", "city", "area", "المحافظة", "المنطقة", "المدينة"],
    "site.vendor": ["manufacturer", "المورد", "الشركة المصنعة"],
    "site.latitude": ["lat"],
    "site.longitude": ["lon", "lng"],
    "site.site_count": ["number of sites", "total sites", "how many sites", "عدد المواقع"],
    "cell.cell_id": ["الخلية"],
    "cell.sector_id": ["القطاع"],
    "cell.technology": ["radio tech", "generation", "4g", "5g", "التقنية", "الجيل"],
    "cell.bandwidth_mhz": ["عرض النطاق"],
    "cell.carrier_frequency_mhz": ["frequency", "carrier", "التردد"],
    "cell.cell_count": ["number of cells", "total cells", "how many cells", "عدد الخلايا"],
    "radio_unit.ru_id": ["radio unit", "وحدة الراديو"],
    "radio_unit.ru_count": ["number of radio units", "total radio units", "عدد وحدات الراديو"],
    "antenna.antenna_id": ["الهوائي"],
    "antenna.mimo_layers": ["mimo", "layers"],
    "antenna.azimuth_degree": ["bearing", "زاوية السمت"],
    "antenna.tilt_degree": ["downtilt", "الإمالة"],
    "antenna.antenna_count": ["number of antennas", "total antennas", "عدد الهوائيات"],
    "link.link_type": ["transport", "backhaul", "النقل", "نوع الوصلة"],
    "link.link_count": ["number of links", "total links", "عدد الروابط"],
    "date.year": ["السنة"],
    "date.month_name": ["month", "الشهر"],
    "date.quarter": ["الربع"],
    "date.quarter_name": ["quarter", "اسم الربع"],
    "date.day_of_month": ["day", "اليوم"],
    "date.day_of_week": ["weekday", "يوم الأسبوع"],
    "date.week_of_year": ["week", "الأسبوع"],
    "date.full_date": ["date", "day", "calendar date", "التاريخ", "اليوم"],
    "time_of_day.hour": ["hour of day", "الساعة"],
    "time_of_day.time_label": ["time", "clock time", "الوقت"],
    "time_of_day.day_part": ["part of day", "morning afternoon evening", "فترة اليوم"],
    "time_of_day.business_hours": ["working hours", "ساعات العمل"],
    "cell_performance.ran_key": ["ran node", "node", "العقدة"],
    "cell_performance.cell_status": ["status", "حالة الخلية"],
    "cell_performance.op_state": ["operational state", "الحالة التشغيلية"],
    "cell_performance.congestion_flag": ["congested", "congestion", "الازدحام"],
    "cell_performance.snapshot_ts": ["time", "snapshot time", "الوقت"],
    "cell_performance.site_count": ["number of sites", "total sites", "how many sites", "عدد المواقع", "sites"],
    "cell_performance.cell_count": ["number of cells", "total cells", "how many cells", "عدد الخلايا", "cells"],
    "cell_performance.rsrp_dbm": ["signal strength", "قوة الإشارة"],
    "cell_performance.rsrq_db": ["signal quality", "جودة الإشارة"],
    "cell_performance.sinr_db": ["signal to noise", "نسبة الإشارة للضوضاء"],
    "cell_performance.cqi_avg": ["channel quality", "جودة القناة"],
    "cell_performance.spectral_efficiency_bps_per_hz": ["spectral efficiency", "الكفاءة الطيفية"],
    "cell_performance.prb_utilization_percent": ["load", "الحمل", "استخدام الموارد"],
    "cell_performance.throughput_downlink_mbps": ["downlink throughput", "download speed", "سرعة التنزيل"],
    "cell_performance.throughput_uplink_mbps": ["uplink throughput", "upload speed", "سرعة الرفع"],
    "cell_performance.traffic_volume_gb": ["traffic", "data volume", "حجم البيانات"],
    "cell_performance.latency_downlink_ms": ["downlink latency", "زمن الاستجابة للتنزيل"],
    "cell_performance.latency_uplink_ms": ["uplink latency", "زمن الاستجابة للرفع"],
    "cell_performance.rrc_connection_attempts": ["rrc attempts", "connection attempts", "محاولات الاتصال"],
    "cell_performance.rrc_success_rate_percent": ["rrc success", "connection success", "نسبة نجاح الاتصال"],
    "cell_performance.erab_setup_success_rate_percent": ["erab success", "bearer setup success", "نجاح إعداد الحامل"],
    "cell_performance.call_drop_rate_percent": ["drop rate", "dropped calls", "معدل انقطاع المكالمات"],
    "cell_performance.abnormal_release_rate_percent": ["abnormal release", "معدل الإنهاء غير الطبيعي"],
    "cell_performance.bler_downlink_percent": ["downlink block error rate", "معدل خطأ الكتلة للتنزيل"],
    "cell_performance.bler_uplink_percent": ["uplink block error rate", "معدل خطأ الكتلة للرفع"],
    "cell_performance.harq_retransmission_rate_percent": ["harq", "retransmission rate", "معدل إعادة الإرسال"],
    "cell_performance.handover_attempts": ["محاولات التسليم"],
    "cell_performance.handover_failures": ["فشل التسليم"],
    "cell_performance.handover_success_rate_percent": ["handover success", "نسبة نجاح التسليم"],
    "cell_performance.connected_users": ["users", "subscribers", "المستخدمون"],
    "cell_performance.active_users": ["المستخدمون النشطون"],
    "cell_performance.peak_users": ["max users", "ذروة المستخدمين"],
    "cell_performance.snapshot_count": ["records", "number of snapshots", "عدد القياسات"],
    "equipment_health.site_id": ["tower", "البرج", "الموقع"],
    "equipment_health.ran_key": ["ran node", "site node", "tower node", "node", "عقدة الشبكة"],
    "equipment_health.power_status": ["power", "حالة الطاقة"],
    "equipment_health.env_status": ["environment status", "حالة البيئة"],
    "equipment_health.smoke_detected": ["smoke", "fire alarm", "كشف الدخان"],
    "equipment_health.door_status": ["door", "حالة الباب"],
    "equipment_health.generator_status": ["generator", "المولد"],
    "equipment_health.snapshot_ts": ["time", "snapshot time", "الوقت"],
    "equipment_health.bbu_cpu_utilization_percent": ["bbu cpu", "cpu utilization", "استخدام المعالج"],
    "equipment_health.bbu_memory_utilization_percent": ["bbu memory", "memory utilization", "استخدام الذاكرة"],
    "equipment_health.battery1_charge_percent": ["battery charge", "battery level", "شحن البطارية"],
    "equipment_health.rect1_output_voltage_volt": ["rectifier voltage", "جهد المقوم"],
    "equipment_health.ru1_temperature_c": ["radio unit 1 temperature", "حرارة وحدة الراديو 1"],
    "equipment_health.ru2_temperature_c": ["radio unit 2 temperature", "حرارة وحدة الراديو 2"],
    "equipment_health.ru3_temperature_c": ["radio unit 3 temperature", "حرارة وحدة الراديو 3"],
    "equipment_health.ru1_vswr": ["standing wave ratio"],
    "equipment_health.temp_sensor1_value_c": ["site temperature", "ambient temperature", "درجة الحرارة"],
    "equipment_health.humidity_percent": ["الرطوبة"],
    "equipment_health.gen_fuel_level_percent": ["generator fuel", "fuel level", "مستوى الوقود"],
    "equipment_health.link1_latency_ms": ["backhaul latency", "transport latency", "زمن الاستجابة"],
    "equipment_health.link1_packet_loss_percent": ["packet loss", "فقد الحزم"],
    "equipment_health.snapshot_count": ["records", "عدد القياسات"],
    "alarm.site_key": ["tower key"],
    "alarm.component_key": ["component", "المكون"],
    "alarm.severity": ["alarm severity", "priority", "الخطورة", "الأولوية"],
    "alarm.alarm_category": ["category", "alarm type", "نوع الإنذار", "فئة الإنذار"],
    "alarm.alarm_msg": ["message", "description", "رسالة الإنذار"],
    "alarm.alarm_ts": ["alarm time", "raised at", "وقت الإنذار"],
    "alarm.alarm_count": ["number of alarms", "alarms", "count", "عدد الإنذارات"],
    "ml_predictions.site_id": ["tower", "البرج", "الموقع"],
    "ml_predictions.cell_id": ["الخلية"],
    "ml_predictions.predicted_failure": ["failure flag", "will fail", "توقع فشل"],
    "ml_predictions.risk_level": ["risk", "risk category", "مستوى الخطر"],
    "ml_predictions.prediction_date": ["prediction day", "forecast date", "تاريخ التوقع"],
    "ml_predictions.observation_ts": ["observation time", "kpi timestamp", "وقت القياس"],
    "ml_predictions.failure_probability": ["failure prob", "failure risk", "probability", "احتمال الفشل"],
    "ml_predictions.prediction_count": ["predictions", "number of predictions", "عدد التوقعات"],
}


class SemanticModel:
    def __init__(self, tables: Mapping[str, LogicalTable] = TABLES,
                 relationships: Sequence[Relationship] = RELATIONSHIPS,
                 synonyms: Mapping[str, Sequence[str]] = SYNONYMS):
        self.tables = dict(tables)
        self.relationships = list(relationships)
        # Name -> readings and how directly each is meant: by its own name (0),
        # as a business name (1), or by the naming rules (2).
        self._names: dict[str, dict[str, int]] = {}

        def add(name: str, full: str, rank: int) -> None:
            known = self._names.setdefault(name.casefold(), {})
            known[full] = min(rank, known.get(full, rank))

        for table, spec in self.tables.items():
            for logical in [*spec.dimensions, *spec.measures]:
                full = f"{table}.{logical}"
                for name in self._spoken(table, logical):
                    add(name, full, 0 if name in (full.casefold(), logical.casefold()) else 2)
        for full, names in synonyms.items():
            for name in names:
                add(name, full, 1)

    @staticmethod
    def _spoken(table: str, logical: str) -> set[str]:
        """A name itself, with spaces, and without its unit."""
        forms = {f"{table}.{logical}", logical, logical.replace("_", " ")}
        for ending in UNIT_ENDINGS:
            if logical.endswith(ending):
                short = logical[: -len(ending)]
                forms |= {short, short.replace("_", " ")}
        return {f.casefold() for f in forms}

    # -- names -----------------------------------------------------------------
    def candidates(self, name: str) -> dict[str, int]:
        found = self._names.get(name.strip().casefold())
        if not found:
            raise UnknownName(f"unknown name: {name}")
        return found

    @staticmethod
    def _only(name: str, ranked: list[tuple]) -> tuple[str, str]:
        """The reading that ranks first; two that rank alike are an error."""
        ranked.sort()
        if len(ranked) > 1 and ranked[0][:-2] == ranked[1][:-2]:
            raise UnknownName(f"{name} is ambiguous: " + ", ".join(f"{r[-2]}.{r[-1]}" for r in ranked if r[:-2] == ranked[0][:-2]))
        return ranked[0][-2], ranked[0][-1]

    def resolve_measure(self, name: str, by: Sequence[str] = (), tables: Sequence[str] = ()) -> tuple[str, str]:
        """The table is one of ``tables`` (those already asked for) if it can be,
        else the one nearest to the dimensions ``by``."""
        ranked = []
        for option, rank in self.candidates(name).items():
            table, logical = option.split(".")
            if logical not in self.tables[table].measures:
                continue
            steps = 0
            try:
                for d in by:
                    steps += len(self.path(table, self.resolve_dimension(d, table)[0]))
            except UnknownName:
                continue
            ranked.append((table not in tables, steps, rank, table, logical))
        if not ranked:
            raise UnknownName(f"not a measure of a table that has {', '.join(by) or 'any'}: {name}")
        return self._only(name, ranked)

    def resolve_dimension(self, name: str, base: str) -> tuple[str, str]:
        """The reading of ``name`` closest to ``base`` along relationships."""
        ranked = []
        for option, rank in self.candidates(name).items():
            table, logical = option.split(".")
            path = self.path(base, table) if logical in self.tables[table].dimensions else None
            if path is not None:
                ranked.append((len(path), rank, table, logical))
        if not ranked:
            raise UnknownName(f"{name} cannot be reached from {base} by many-to-one joins")
        return self._only(name, ranked)

    def path(self, start: str, goal: str) -> list[Relationship] | None:
        """Shortest chain of many-to-one steps."""
        queue: deque[tuple[str, list[Relationship]]] = deque([(start, [])])
        seen = {start}
        while queue:
            table, taken = queue.popleft()
            if table == goal:
                return taken
            for r in self.relationships:
                if r.left == table and r.right not in seen:
                    seen.add(r.right)
                    queue.append((r.right, [*taken, r]))
        return None

    # -- plans -----------------------------------------------------------------
    def query(self, frames: Mapping[str, DataFrame], measures: Sequence[str], by: Sequence[str] = (),
              where: Mapping[str, object] | None = None, order_by: str | None = None,
              limit: int | None = None, inner: bool = False) -> DataFrame:
        """Aggregate ``measures`` per ``by`` (business names throughout).

        ``where`` maps a dimension to a value, a list of values, or a function
        from its column to a condition. Output columns bear the logical names.
        ``inner`` drops facts without a dimension row.
        """
        per_fact: dict[str, list[str]] = {}
        asked = [*by, *(where or {})]
        for m in measures:
            table, logical = self.resolve_measure(m, asked, list(per_fact))
            per_fact.setdefault(table, []).append(logical)
        parts = [
            self._aggregate(frames, table, logicals, by, where or {}, inner)
            for table, logicals in per_fact.items()
        ]
        out, keys = parts[0]
        for part, other in parts[1:]:
            if other != keys:
                raise UnknownName("the measures share no reading of the dimensions")
            out = self._merge(out, part, keys)
        order = [F.desc(order_by if order_by in out.columns else self.resolve_measure(order_by, asked, list(per_fact))[1])] \
            if order_by else []
        if order or limit is not None:
            out = out.orderBy(*order, *keys)
        return out.limit(limit) if limit is not None else out

    @staticmethod
    def _merge(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
        if not keys:
            # Both sides are single rows: attach the second as scalar values.
            row = right.select(F.struct(*right.columns).alias("r")).scalar()
            return left.withColumn("_r", row).select("*", "_r.*").drop("_r")
        r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
        cond: Column | None = None
        for k in keys:
            one = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
            cond = one if cond is None else cond & one
        joined = left.join(r, cond, "full")
        merged = [F.coalesce(k, f"_r_{k}").alias(k) for k in keys]
        rest = [c for c in joined.columns if c not in keys and c not in {f"_r_{k}" for k in keys}]
        return joined.select(*merged, *rest)

    def _aggregate(self, frames, base: str, logicals: Sequence[str], by: Sequence[str],
                   where: Mapping[str, object], inner: bool) -> tuple[DataFrame, list[str]]:
        dims = [self.resolve_dimension(d, base) for d in by]
        filters = [(self.resolve_dimension(d, base), v) for d, v in where.items()]
        used = [*dims, *[d for d, _ in filters]]
        steps: list[Relationship] = []
        for table, _ in used:
            for r in self.path(base, table) or []:
                if r not in steps:
                    steps.append(r)
        needed: dict[str, set[str]] = {base: set()}
        for r in steps:
            needed.setdefault(r.left, set()).add(r.left_column)
            needed.setdefault(r.right, set()).add(r.right_column)
        for table, logical in used:
            needed.setdefault(table, set()).add(logical)

        def name(table: str, logical: str) -> str:
            return f"{table}__{logical}"

        def columns(table: str) -> list[Column]:
            return [F.col(self.tables[table].dimensions[c]).alias(name(table, c)) for c in sorted(needed[table])]

        def wanted(plan: DataFrame, here: Callable[[str], bool]) -> DataFrame:
            for (table, logical), value in filters:
                if here(table):
                    c = F.col(name(table, logical))
                    met = value(c) if callable(value) else c.isin(list(value)) if isinstance(value, (list, tuple, set)) else c == value
                    plan = plan.where(met)
            return plan

        keys: list[str] = []
        grouping = []
        for table, logical in dims:
            label = logical if logical not in keys else name(table, logical)
            keys.append(label)
            grouping.append(F.col(name(table, logical)).alias(label))

        def finished(facts: DataFrame, aggs: Sequence[Column]) -> DataFrame:
            """Joins and filters of the dimensions, then the last aggregate."""
            plan = facts
            for r in steps:
                left, right = name(r.left, r.left_column), name(r.right, r.right_column)
                other = frames[self.tables[r.right].source].select(*columns(r.right)).where(F.col(right).isNotNull())
                plan = plan.join(other, F.col(left) == F.col(right), "inner" if inner else "left")
            return wanted(plan, lambda table: table != base).groupBy(*grouping).agg(*aggs)

        spec = self.tables[base]
        facts = frames[spec.source]
        own = [name(base, c) for c in sorted(needed[base])]
        source = {g: F.lit(1) if spec.measures[g].column is None else F.col(f"m__{g}") for g in logicals}
        read = wanted(facts.select(*columns(base), *[F.col(m.column).alias(f"m__{g}") for g, m in spec.measures.items() if g in logicals and m.column]),
                      lambda table: table == base)
        if not steps:
            return read.groupBy(*grouping).agg(*[AGGREGATES[spec.measures[g].agg](source[g]).alias(g) for g in logicals]), keys
        # Facts shrink to their foreign keys before they meet a dimension: partial
        # sums and counts in one pass, and distinct values apart from those.
        plain = [g for g in logicals if spec.measures[g].agg != "count_distinct"]
        parts = []
        if plain:
            partial = [a for g in plain for a in PARTIAL[spec.measures[g].agg](source[g], g)]
            parts.append(finished(read.groupBy(*own).agg(*partial), [FINAL[spec.measures[g].agg](g).alias(g) for g in plain]))
        for g in logicals:
            if g not in plain:
                parts.append(finished(read.select(*own, source[g].alias(f"d__{g}")).distinct(), [F.count_distinct(f"d__{g}").alias(g)]))
        out = parts[0]
        for part in parts[1:]:
            out = self._merge(out, part, keys)
        return out.select(*keys, *logicals), keys


# ---------------------------------------------------------------------------
# Ready-made questions
# ---------------------------------------------------------------------------
def _ask(model, frames, measure: str, name: str, by: Sequence[str], **options) -> DataFrame:
    """One measure, highest first, under the question's own column name."""
    _, logical = model.resolve_measure(measure)
    out = model.query(frames, [measure], by, order_by=logical, inner=True, **options)
    return out.withColumnRenamed(logical, name)


def alarms_by_region(model, frames):
    return _ask(model, frames, "alarm_count", "total_alarms", ["region"])


def avg_sinr_by_site(model, frames):
    return _ask(model, frames, "sinr", "avg_sinr_db", ["site_name", "region"])


def top_cells_call_drop(model, frames, k: int = 3):
    return _ask(model, frames, "drop rate", "avg_drop_rate", ["cell.cell_id"], limit=k)


def top_cells_call_drop_ar(model, frames, k: int = 3):
    return _ask(model, frames, "معدل انقطاع المكالمات", "avg_drop_rate", ["الخلية"], limit=k)


def failure_prob_by_region(model, frames):
    return _ask(model, frames, "failure_probability", "avg_failure_prob", ["region"])


def throughput_by_technology(model, frames):
    return _ask(model, frames, "downlink throughput", "avg_dl_mbps", ["technology"])


def call_drop_by_technology(model, frames):
    return _ask(model, frames, "drop rate", "avg_drop_rate", ["technology"])


def critical_alarms_on(model, frames, day_key: int):
    return model.query(frames, ["alarms"], ["site_name"],
                       {"alarm.severity": "CRITICAL", "alarm.date_key": day_key}, order_by="alarm_count")


def experience_measures(fact_cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Report-page ratios, weighted by attempts where attempts exist."""
    rate, attempts = F.col("rrc_success_rate_percent"), F.col("rrc_connection_attempts")
    weighted = F.when(rate.isNotNull(), attempts)
    return fact_cells.groupBy(*keys).agg(
        F.avg("call_drop_rate_percent").alias("call_drop_rate_pct"),
        F.avg(rate).alias("rrc_setup_success_pct"),
        F.try_divide(F.sum(rate * attempts), F.sum(weighted)).alias("volume_weighted_rrc_rate"),
        ((1 - F.try_divide(F.sum("handover_failures"), F.sum("handover_attempts"))) * 100)
        .alias("handover_success_pct"),
        F.sum("handover_attempts").alias("total_handover_attempts"),
        F.avg("latency_downlink_ms").alias("avg_latency_dl"),
        F.avg("latency_uplink_ms").alias("avg_latency_ul"),
        F.avg("spectral_efficiency_bps_per_hz").alias("spectral_efficiency"),
        F.avg("sinr_db").alias("avg_sinr"), F.avg("bler_downlink_percent").alias("bler_dl_pct"),
        F.max("prb_utilization_percent").alias("peak_prb_utilization"),
        F.avg("prb_utilization_percent").alias("prb_utilization_pct"))
