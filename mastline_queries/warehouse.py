"""Silver tables, dimensions, facts and semantic questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from mastline.functions import scalars as S
from mastline.operators import normalize as N
from mastline.operators import predictions as P
from mastline.operators.state import SeriesState
from mastline.plans import features, gold, semantic
from mastline_queries import layout
from mastline_queries import inputs as I
from mastline_queries import sqltext as Q
from mastline_queries import staging as ST
from mastline_queries.registry import register

# ---------------------------------------------------------------------------
# Silver
# ---------------------------------------------------------------------------
BASE_OUT = f"message_id, 'lineitem' AS source_file, {Q.stamp('snapshot_time')} AS snapshot_time, " \
           "sequence_number, site_id, site_name, region"


def silver_sql(name: str, ctes: list[str], drop: str = "") -> str:
    extra = f", {drop}" if drop else ""
    return Q.query(Q.MSG, *ctes, select=(
        f"SELECT {BASE_OUT}, * EXCLUDE ({Q.BASE}{extra}) FROM {name}"))


for _name, _cte in {
    "cells": Q.CELLS, "radio_units": Q.RADIOS, "antennas": Q.ANTENNAS, "baseband_units": Q.BASEBANDS,
    "transport_links": Q.LINKS, "batteries": Q.BATTERIES, "rectifiers": Q.RECTIFIERS,
}.items():
    @register(f"silver_{_name}", silver_sql(_name, [_cte]))
    def _component(spark, sf, name=_name):
        return N.explode_component(ST.raw(spark, sf), N.COMPONENTS[name])


@register("silver_environment_sensors", silver_sql("environment_sensors", [Q.SENSORS]))
def silver_sensors(spark, sf):
    return N.environment_sensors(ST.raw(spark, sf))


@register("silver_site_snapshot", Q.query(Q.MSG, Q.SITES, select=(
    f"SELECT {BASE_OUT}, * EXCLUDE ({Q.BASE}), '4G,5G' AS technologies FROM site_snapshot")))
def silver_sites(spark, sf):
    return N.site_snapshot(ST.raw(spark, sf))


NUMBER = r"'^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$'"


@register("silver_alerts", Q.query(Q.MSG, Q.ALERTS, select=f"""
SELECT {BASE_OUT}, alert_id, severity, category, component_type, component_id, code, message,
       CASE WHEN regexp_matches(value, {NUMBER}) THEN CAST(value AS DOUBLE) END AS alert_value_num,
       CASE WHEN NOT regexp_matches(value, {NUMBER}) THEN value END AS alert_value_str FROM alerts"""
                                   .replace("CAST(value AS DOUBLE)", "TRY_CAST(value AS DOUBLE)")))
def silver_alerts(spark, sf):
    return N.alerts(ST.raw(spark, sf))


@register("quarantined_snapshots", Q.query(Q.MSG, select=(
    "SELECT region, CAST(count(*) AS BIGINT) AS total FROM msg WHERE snapshot_time IS NULL GROUP BY region")))
def quarantined(spark, sf):
    bad = N.quarantine(ST.raw(spark, sf))[1]
    return bad.groupBy(F.col("ran_metadata.region").alias("region")).agg(F.count("*").alias("total"))


# ---------------------------------------------------------------------------
# Dimensions
# ---------------------------------------------------------------------------
def newest(source: str, keys: str, attributes: list[str]) -> str:
    return (
        f"newest AS (SELECT {keys}, {', '.join(attributes)} FROM (SELECT *, row_number() OVER ("
        f"PARTITION BY {keys} ORDER BY snapshot_time DESC NULLS LAST, sequence_number DESC, message_id DESC) AS rn "
        f"FROM {source}) WHERE rn = 1)")


@register("dim_site", Q.query(Q.MSG, Q.SITES, newest(
    "site_snapshot", "site_id", ["site_name", "region", "vendor", "latitude", "longitude"]),
    select="SELECT md5(site_id) AS site_sk, * FROM newest"))
def dim_site(spark, sf):
    return gold.dim_site(ST.silver(spark, sf, "site_snapshot"))


@register("dim_cell", Q.query(Q.MSG, Q.CELLS, newest(
    "cells", "site_id, cell_id", ["technology", "bandwidth_mhz", "carrier_frequency_mhz", "sector_id"]),
    select="SELECT md5(concat_ws('|', site_id, cell_id)) AS cell_sk, * FROM newest"))
def dim_cell(spark, sf):
    return gold.dim_cell(ST.silver(spark, sf, "cells"))


@register("dim_radio_unit", Q.query(Q.MSG, Q.RADIOS, newest("radio_units", "site_id, ru_id", ["sector_id"]),
          select="SELECT md5(concat_ws('|', site_id, ru_id)) AS \"RU_sk\", * FROM newest"))
def dim_radio_unit(spark, sf):
    return gold.dim_radio_unit(ST.silver(spark, sf, "radio_units"))


@register("dim_antenna", Q.query(Q.MSG, Q.ANTENNAS, newest(
    "antennas", "site_id, antenna_id", ["sector_id", "mimo_layers", "azimuth_degree", "tilt_degree"]),
    select="SELECT md5(concat_ws('|', site_id, antenna_id)) AS antenna_sk, * FROM newest"))
def dim_antenna(spark, sf):
    return gold.dim_antenna(ST.silver(spark, sf, "antennas"))


@register("dim_antenna_variants", Q.query(Q.MSG, Q.ANTENNAS, select="""
SELECT DISTINCT md5(concat_ws('|', site_id, antenna_id)) AS antenna_sk, site_id, antenna_id, sector_id,
       mimo_layers, azimuth_degree, tilt_degree FROM antennas"""))
def dim_antenna_variants(spark, sf):
    return gold.build_dimension(
        ST.silver(spark, sf, "antennas"), ["site_id", "antenna_id"],
        ["sector_id", "mimo_layers", "azimuth_degree", "tilt_degree"], "antenna_sk", latest=False)


HISTORY = """r AS (SELECT *, row_number() OVER (PARTITION BY site_id, antenna_id, snapshot_time ORDER BY sequence_number DESC, message_id DESC) AS rn
  FROM antennas WHERE snapshot_time IS NOT NULL),
c AS (SELECT *, row(sector_id, mimo_layers, azimuth_degree, tilt_degree) AS a,
  lag(row(sector_id, mimo_layers, azimuth_degree, tilt_degree)) OVER (PARTITION BY site_id, antenna_id ORDER BY snapshot_time) AS b FROM r WHERE rn = 1),
history AS (SELECT site_id, antenna_id, sector_id, mimo_layers, azimuth_degree, tilt_degree, snapshot_time AS valid_from,
  lead(snapshot_time) OVER (PARTITION BY site_id, antenna_id ORDER BY snapshot_time) AS valid_to FROM c WHERE b IS DISTINCT FROM a)"""


@register("dim_antenna_history", Q.query(Q.MSG, Q.ANTENNAS, HISTORY, select=f"""
SELECT md5(concat_ws('|', site_id, antenna_id, strftime(valid_from, '%Y-%m-%d %H:%M:%S.%f'))) AS antenna_version_sk, site_id, antenna_id, sector_id,
  mimo_layers, azimuth_degree, tilt_degree, {Q.stamp('valid_from')} AS valid_from, {Q.stamp('valid_to')} AS valid_to, valid_to IS NULL AS is_current
FROM history"""))
def dim_antenna_history(spark, sf):
    return gold.dim_antenna_history(ST.silver(spark, sf, "antennas"))


@register("fact_antenna_versions", Q.query(Q.MSG, Q.ANTENNAS, HISTORY, select="""
SELECT f.site_id, h.tilt_degree, count(*) AS readings, sum(f.rssi_dbm) AS rssi, sum(f.tilt_degree - h.tilt_degree) AS drift
FROM antennas f LEFT JOIN history h ON f.site_id = h.site_id AND f.antenna_id = h.antenna_id AND f.snapshot_time >= h.valid_from
  AND (h.valid_to IS NULL OR f.snapshot_time < h.valid_to) GROUP BY ALL"""))
def fact_antenna_versions(spark, sf):
    """Antenna readings by the tilt that was valid at their time."""
    antennas = ST.silver(spark, sf, "antennas")
    history = gold.dim_antenna_history(antennas).withColumnRenamed("tilt_degree", "valid_tilt")
    dated = gold.join_version(antennas, history, ["site_id", "antenna_id"], "snapshot_time", ["antenna_version_sk", "valid_tilt"])
    return dated.groupBy("site_id", F.col("valid_tilt").alias("tilt_degree")).agg(
        F.count("*").alias("readings"), F.sum("rssi_dbm").alias("rssi"), F.sum(F.col("tilt_degree") - F.col("valid_tilt")).alias("drift"))


@register("dim_link", Q.query(Q.MSG, Q.LINKS, newest("transport_links", "site_id, link_id", ["link_type"]),
          select="SELECT md5(concat_ws('|', site_id, link_id)) AS link_sk, * FROM newest"))
def dim_link(spark, sf):
    return gold.dim_link(ST.silver(spark, sf, "transport_links"))


@register("dim_date", """
WITH d AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM (
  SELECT CAST(CAST(min(o_orderdate) AS DATE) AS TIMESTAMP) AS lo,
         CAST(CAST(max(o_orderdate) AS DATE) AS TIMESTAMP) AS hi FROM orders))
SELECT CAST(strftime(d, '%Y%m%d') AS BIGINT) AS date_sk, strftime(d, '%Y-%m-%d') AS "Date",
  dayname(d) AS "DaySuffix", CAST(year(d) AS BIGINT) AS "Year", left(dayname(d), 3) AS "DayOfWeek",
  CAST(day(d) AS BIGINT) AS "DayOfMonth", CAST(weekofyear(d) AS BIGINT) AS "WeekOfYear",
  CAST(ceil(day(d) / 7.0) AS BIGINT) AS "WeekOfMonth", CAST(month(d) AS BIGINT) AS "Month",
  monthname(d) AS "MonthName", CAST(quarter(d) AS BIGINT) AS quarter,
  concat('Q', quarter(d)) AS "quarterName", strftime(d, '%Y-%m-%d') AS "standardDate" FROM d""")
def dim_date(spark, sf):
    return gold.dim_date_spanning(I.table(spark, sf, "orders"), "o_orderdate")


@register("dim_time", """
WITH s AS (SELECT CAST(floor((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 30) AS BIGINT) * 30 AS s
           FROM events GROUP BY 1),
p AS (SELECT s, s // 3600 AS h, (s // 60) % 60 AS m, s % 60 AS sec FROM s)
SELECT h * 10000 + m * 100 + sec AS datetime_sk, printf('%02d:%02d:%02d', h, m, sec) AS time_label,
  h AS hour, m AS minute, sec AS second,
  CASE WHEN h < 6 THEN 'Night' WHEN h < 12 THEN 'Morning' WHEN h < 18 THEN 'Afternoon' ELSE 'Evening' END AS day_part,
  CASE WHEN h >= 8 AND h < 18 THEN 'Business Hours' ELSE 'Off Hours' END AS business_hours,
  s // 30 AS slot_30s_index, CASE WHEN sec = 0 THEN h * 100 + m END AS time_key FROM p""")
def dim_time(spark, sf):
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    used = I.table(spark, sf, "events").select((F.floor(second / 30) * 30).alias("sec")).distinct()
    return gold.clock_slots(used)


# ---------------------------------------------------------------------------
# Facts
# ---------------------------------------------------------------------------
BUCKETED = "SELECT *, {b} AS b FROM {t} WHERE snapshot_time IS NOT NULL"


def part_ctes(p: layout.Part, tag: str) -> list[str]:
    """SQL of one part of the wide fact, in the window style."""
    where = f" AND {p.where[0]} = '{p.where[1]}'" if p.where else ""
    ctes = [f"{tag}_b AS ({BUCKETED.format(b=Q.bucket(), t=p.table)}{where})"]
    keys = "site_id, b" + (f", {p.component}" if p.slots else "")
    aggs, joins = [], []
    for pattern, source in p.first.items():
        aggs.append((pattern, f"max({source})"))
    for n, (pattern, source) in enumerate(p.modes.items()):
        ctes.append(Q.mode(f"{tag}_m{n}", f"{tag}_b", keys, source))
        joins.append(f"LEFT JOIN {tag}_m{n} USING ({keys})")
        aggs.append((pattern, f"max({tag}_m{n}.{source})"))
    for pattern, (source, digits) in p.means.items():
        mean = Q.rnd(f"avg({tag}_b.{source})", digits)
        aggs.append((pattern, f"CAST({mean} AS INT)" if pattern in p.whole else mean))
    cols = ", ".join(f"{e} AS c{i}" for i, (_, e) in enumerate(aggs))
    ctes.append(f"{tag}_c AS (SELECT {keys}, {cols} FROM {tag}_b {' '.join(joins)} GROUP BY {keys})")
    if not p.slots:
        out = ", ".join(f"c{i} AS \"{n}\"" for i, (n, _) in enumerate(aggs))
        ctes.append(f"{tag} AS (SELECT site_id, b, {out} FROM {tag}_c)")
    else:
        ctes.append(f"{tag}_r AS (SELECT *, dense_rank() OVER (PARTITION BY site_id, b ORDER BY {p.component}) AS slot "
                    f"FROM {tag}_c)")
        out = ", ".join(
            f"max(CASE WHEN slot = {s} THEN c{i} END) AS \"{n.format(slot=s)}\""
            for s in range(1, p.slots + 1) for i, (n, _) in enumerate(aggs))
        out += f", greatest(max(slot) - {p.slots}, 0) AS \"{p.surplus}\""
        ctes.append(f"{tag} AS (SELECT site_id, b, {out} FROM {tag}_r GROUP BY site_id, b)")
    return ctes


INPUT_CTES = [Q.MSG, Q.SITES, Q.SENSORS, Q.RADIOS, Q.BASEBANDS, Q.ANTENNAS, Q.LINKS, Q.RECTIFIERS, Q.BATTERIES]


def fact_ran_ctes() -> list[str]:
    out = part_ctes(layout.SITE, "p")
    for i, p in enumerate(layout.JOINED):
        out += part_ctes(p, f"q{i}")
    joins = " ".join(f"LEFT JOIN q{i} USING (site_id, b)" for i in range(len(layout.JOINED)))
    surplus = ", ".join(f'coalesce("{c}", 0) AS "{c}"' for c in (p.surplus for p in layout.JOINED if p.surplus))
    out.append(
        f"fact_ran AS (SELECT md5(concat_ws('|', site_id, {Q.stamp('b')})) AS \"RAN_sk\", "
        f"CAST(strftime(b, '%Y%m%d') AS BIGINT) AS date_key, {Q.stamp('b')} AS timestamp, "
        f"CAST(strftime(b, '%H%M') AS BIGINT) AS time_key, {Q.day('b')} AS gold_date, md5(site_id) AS \"RAN_key\", "
        f"COALESCE(rect1_status, rect2_status) AS power_status, * EXCLUDE (b) REPLACE ({surplus}) FROM p {joins})")
    return out


@register("fact_ran_surplus", Q.query(*INPUT_CTES, *[c for i, p in enumerate(layout.JOINED) if p.slots for c in part_ctes(p, f"q{i}")], select=" UNION ALL ".join(
    f"SELECT '{p.surplus}' AS part, site_id, {Q.stamp('b')} AS timestamp, {p.component} AS component, CAST(slot AS BIGINT) AS slot FROM q{i}_r WHERE slot > {p.slots}"
    for i, p in enumerate(layout.JOINED) if p.slots)))
def fact_ran_surplus(spark, sf):
    return gold.surplus_components(ST.all_silver(spark, sf)).drop("readings")


@register("fact_ran", Q.query(*INPUT_CTES, *fact_ran_ctes(), select="SELECT * FROM fact_ran"))
def fact_ran(spark, sf):
    return gold.fact_ran(ST.all_silver(spark, sf))


def fact_cells_ctes() -> list[str]:
    keys = "site_id, cell_id, b"
    means = ", ".join(
        Q.rnd(f"avg({c})", 3 if c == "spectral_efficiency_bps_per_hz" else 2) + f" AS {c}"
        for c in layout.CELL_MEANS)
    return [
        f"cb AS ({BUCKETED.format(b=Q.bucket(), t='cells')})",
        Q.mode("ms", "cb", keys, "cell_status"), Q.mode("mo", "cb", keys, "cell_op_state", "op_state"),
        f"""ck AS (SELECT {keys}, sector_id AS sector_bk, technology,
          arg_min(message_id, (snapshot_time, message_id)) AS "RAN_msg_Sk",
          CAST(trunc(avg(connected_users)) AS BIGINT) AS connected_users,
          CAST(trunc(avg(active_users)) AS BIGINT) AS active_users,
          CAST(max(connected_users) AS BIGINT) AS peak_users, {means},
          CAST(sum(handover_attempts) AS BIGINT) AS handover_attempts,
          CAST(sum(handover_failures) AS BIGINT) AS handover_failures,
          CAST(sum(rrc_connection_attempts) AS BIGINT) AS rrc_connection_attempts,
          CAST(max(CASE WHEN prb_utilization_percent > 80 THEN 1 ELSE 0 END) AS BIGINT) AS congestion_flag
          FROM cb GROUP BY {keys}, sector_id, technology)""",
        f"""fact_cells AS (SELECT * EXCLUDE (b, site_id, cell_id, technology),
          CAST(strftime(b, '%Y%m%d') AS BIGINT) AS date_key, {Q.stamp('b')} AS timestamp,
          CAST(strftime(b, '%H%M') AS BIGINT) AS time_key, {Q.day('b')} AS gold_date,
          md5(concat_ws('|', site_id, cell_id)) AS cell_key, md5(site_id) AS "RAN_key",
          {Q.rnd('(throughput_downlink_mbps + throughput_uplink_mbps) * 900 / 8 / 1024', 3)} AS traffic_volume_gb,
          CASE WHEN handover_attempts > 0 THEN
            {Q.rnd('(1 - handover_failures / handover_attempts) * 100', 2)} END AS handover_success_rate_percent
          FROM ck LEFT JOIN ms USING ({keys}) LEFT JOIN mo USING ({keys}))""",
    ]


@register("fact_cells", Q.query(Q.MSG, Q.CELLS, *fact_cells_ctes(), select="SELECT * FROM fact_cells"))
def fact_cells(spark, sf):
    return gold.fact_cells(ST.silver(spark, sf, "cells"))


FACT_ALARMS = f"""fact_alarms AS (SELECT message_id, md5(site_id) AS site_key,
  CAST(strftime(snapshot_time, '%Y%m%d') AS BIGINT) AS date_key,
  CAST(strftime(snapshot_time, '%H%M') AS BIGINT) AS time_key, category AS alarm_category,
  component_id AS component_key, severity, message AS alarm_msg, {Q.stamp('snapshot_time')} AS snapshot_time,
  {Q.day('snapshot_time')} AS gold_date, md5(concat_ws('|', message_id, alert_id)) AS alarm_sk
  FROM alerts WHERE alert_id IS NOT NULL)"""


@register("fact_alarms", Q.query(Q.MSG, Q.ALERTS, FACT_ALARMS, select="SELECT * FROM fact_alarms"))
def fact_alarms(spark, sf):
    return gold.fact_alarms(ST.silver(spark, sf, "alerts"))


# ---------------------------------------------------------------------------
# Semantic questions
# ---------------------------------------------------------------------------
def frames(spark, sf):
    """The star schema for questions: they read few columns of the cell fact, once."""
    return ST.star(spark, sf, plans=["Fact_Cells"])


PREDICTIONS = f"""pred AS (SELECT timestamp, site_id, concat('CELL_', cell_id) AS cell_id,
  {Q.rnd('probability', 4)} AS failure_probability,
  CAST(CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS BIGINT) AS predicted_failure,
  {Q.risk('probability')} AS risk_level, CAST(timestamp AS DATE) AS prediction_date FROM scores)"""
SITE_DIM = [Q.SITES, newest("site_snapshot", "site_id", ["site_name", "region"])]
MODEL = semantic.SemanticModel()


def rounded(df, *columns, digits=10):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@register("sem_alarms_by_region", Q.query(Q.MSG, Q.ALERTS, *SITE_DIM, select="""
SELECT n.region, count(*) AS total_alarms FROM alerts a JOIN newest n USING (site_id)
WHERE a.alert_id IS NOT NULL GROUP BY n.region"""))
def sem_alarms_by_region(spark, sf):
    return semantic.alarms_by_region(MODEL, frames(spark, sf))


@register("sem_avg_sinr_by_site", Q.query(Q.MSG, Q.CELLS, *SITE_DIM, *fact_cells_ctes(), select=f"""
SELECT site_name, n.region, {Q.rnd('avg(sinr_db)', 10)} AS avg_sinr_db
FROM fact_cells f JOIN newest n ON f."RAN_key" = md5(n.site_id) GROUP BY site_name, n.region"""))
def sem_avg_sinr(spark, sf):
    return rounded(semantic.avg_sinr_by_site(MODEL, frames(spark, sf)), "avg_sinr_db")


CELL_DIM = newest("cells", "site_id, cell_id", ["technology"]).replace("newest AS", "cdim AS")
TOP_DROP = Q.query(Q.MSG, Q.CELLS, CELL_DIM, *fact_cells_ctes(), select=f"""
SELECT c.cell_id, {Q.rnd('avg(call_drop_rate_percent)', 10)} AS avg_drop_rate
FROM fact_cells f JOIN cdim c ON f.cell_key = md5(concat_ws('|', c.site_id, c.cell_id))
GROUP BY c.cell_id ORDER BY avg_drop_rate DESC, c.cell_id LIMIT 3""")


@register("sem_top_cells_call_drop", TOP_DROP)
def sem_top_cells(spark, sf):
    return rounded(semantic.top_cells_call_drop(MODEL, frames(spark, sf)), "avg_drop_rate")


@register("sem_top_cells_call_drop_ar", TOP_DROP)
def sem_top_cells_ar(spark, sf):
    return rounded(semantic.top_cells_call_drop_ar(MODEL, frames(spark, sf)), "avg_drop_rate")


def by_technology(measure: str, alias: str) -> str:
    return Q.query(Q.MSG, Q.CELLS, CELL_DIM, *fact_cells_ctes(), select=f"""
SELECT c.technology, {Q.rnd(f'avg({measure})', 10)} AS {alias}
FROM fact_cells f JOIN cdim c ON f.cell_key = md5(concat_ws('|', c.site_id, c.cell_id)) GROUP BY c.technology""")


@register("sem_throughput_by_technology", by_technology("throughput_downlink_mbps", "avg_dl_mbps"))
def sem_throughput(spark, sf):
    return rounded(semantic.throughput_by_technology(MODEL, frames(spark, sf)), "avg_dl_mbps")


@register("sem_call_drop_by_technology", by_technology("call_drop_rate_percent", "avg_drop_rate"))
def sem_call_drop(spark, sf):
    return rounded(semantic.call_drop_by_technology(MODEL, frames(spark, sf)), "avg_drop_rate")


@register("sem_failure_prob_by_region", Q.query(Q.MSG, *SITE_DIM, Q.SCORES, PREDICTIONS, select=f"""
SELECT region, {Q.rnd('avg(failure_probability)', 10)} AS avg_failure_prob
FROM pred JOIN newest USING (site_id) GROUP BY region"""))
def sem_failure_prob(spark, sf):
    return rounded(semantic.failure_prob_by_region(MODEL, frames(spark, sf)), "avg_failure_prob")


@register("sem_high_risk_towers", Q.query(Q.MSG, *SITE_DIM, Q.SCORES, PREDICTIONS, select=f"""
SELECT p.site_id, site_name, region, {Q.rnd('avg(failure_probability)', 10)} AS avg_failure_prob,
  CASE WHEN max(CASE WHEN risk_level = 'CRITICAL' THEN 1 ELSE 0 END) = 1 THEN 'CRITICAL' ELSE 'HIGH' END AS max_risk
FROM pred p JOIN newest USING (site_id)
WHERE risk_level IN ('HIGH', 'CRITICAL') AND prediction_date >= (SELECT max(prediction_date) FROM pred) - 7
GROUP BY p.site_id, site_name, region"""))
def sem_high_risk(spark, sf):
    pred = ST.predictions(spark, sf)
    sites = gold.dim_site(ST.silver(spark, sf, "site_snapshot"))
    as_of = pred.agg(F.max("prediction_date")).scalar()
    return rounded(P.high_risk_sites(pred, sites, as_of), "avg_failure_prob")


@register("sem_inventory_counts", Q.query(Q.MSG, Q.SITES, Q.CELLS, Q.RADIOS, Q.ANTENNAS, Q.LINKS, select="""
SELECT (SELECT count(DISTINCT site_id) FROM site_snapshot) AS site_count,
  (SELECT count(DISTINCT (site_id, cell_id)) FROM cells) AS cell_count,
  (SELECT count(DISTINCT (site_id, ru_id)) FROM radio_units) AS ru_count,
  (SELECT count(DISTINCT (site_id, antenna_id)) FROM antennas) AS antenna_count,
  (SELECT count(DISTINCT (site_id, link_id)) FROM transport_links) AS link_count"""))
def sem_inventory(spark, sf):
    return MODEL.query(frames(spark, sf), [
        "site.site_count", "cell.cell_count", "ru_count", "antenna_count", "link_count"])


@register("sem_equipment_by_region_hour", Q.query(*INPUT_CTES, *fact_ran_ctes(), SITE_DIM[1], select=f"""
SELECT n.region, time_key // 100 AS hour, {Q.rnd('avg("BBU_cpu_utilization_percent")', 10)} AS bbu_cpu_utilization_percent,
  {Q.rnd('avg("RU1_temperature_c")', 10)} AS ru1_temperature_c, {Q.rnd('avg("Humd_sensor_value_percent")', 10)} AS humidity_percent,
  count(*) AS snapshot_count
FROM fact_ran f LEFT JOIN newest n USING (site_id) GROUP BY n.region, 2"""))
def sem_equipment(spark, sf):
    out = MODEL.query(frames(spark, sf), [
        "bbu cpu", "ru1 temperature", "equipment_health.humidity_percent", "equipment_health.snapshot_count"],
        ["site.region", "hour of day"])
    return rounded(out, "bbu_cpu_utilization_percent", "ru1_temperature_c", "humidity_percent")


@register("sem_two_facts_by_region", Q.query(Q.MSG, Q.ALERTS, Q.CELLS, *SITE_DIM, *fact_cells_ctes(), FACT_ALARMS, select=f"""
SELECT region, alarm_count, traffic_volume_gb FROM
 (SELECT region, count(*) AS alarm_count FROM fact_alarms a JOIN newest n ON a.site_key = md5(n.site_id) GROUP BY region)
 FULL JOIN
 (SELECT region, {Q.rnd('sum(traffic_volume_gb)', 3)} AS traffic_volume_gb
  FROM fact_cells f JOIN newest n ON f."RAN_key" = md5(n.site_id) GROUP BY region) USING (region)"""))
def sem_two_facts(spark, sf):
    out = MODEL.query(frames(spark, sf), ["number of alarms", "traffic"], ["site.region"], inner=True)
    return rounded(out, "traffic_volume_gb", digits=3)


@register("sem_critical_alarms_latest_day", Q.query(Q.MSG, Q.ALERTS, *SITE_DIM, FACT_ALARMS, select="""
SELECT site_name, count(*) AS alarm_count FROM fact_alarms a JOIN newest n ON a.site_key = md5(n.site_id)
WHERE severity = 'CRITICAL' AND date_key = (SELECT max(date_key) FROM fact_alarms) GROUP BY site_name"""))
def sem_critical_today(spark, sf):
    tables = frames(spark, sf)
    today = tables["Fact_Alarms"].agg(F.max("date_key")).scalar()
    return semantic.critical_alarms_on(MODEL, tables, today)


@register("sem_report_measures", Q.query(Q.MSG, Q.CELLS, *fact_cells_ctes(), select=f"""
SELECT gold_date, {Q.rnd('avg(call_drop_rate_percent)', 10)} AS call_drop_rate_pct,
  {Q.rnd('avg(rrc_success_rate_percent)', 10)} AS rrc_setup_success_pct,
  {Q.rnd('sum(rrc_success_rate_percent * rrc_connection_attempts) / sum(CASE WHEN rrc_success_rate_percent IS NOT NULL THEN rrc_connection_attempts END)', 10)} AS volume_weighted_rrc_rate,
  {Q.rnd('(1 - sum(handover_failures) / sum(handover_attempts)) * 100', 10)} AS handover_success_pct,
  CAST(sum(handover_attempts) AS BIGINT) AS total_handover_attempts,
  {Q.rnd('avg(latency_downlink_ms)', 10)} AS avg_latency_dl, {Q.rnd('avg(latency_uplink_ms)', 10)} AS avg_latency_ul,
  {Q.rnd('avg(spectral_efficiency_bps_per_hz)', 10)} AS spectral_efficiency, {Q.rnd('avg(sinr_db)', 10)} AS avg_sinr,
  {Q.rnd('avg(bler_downlink_percent)', 10)} AS bler_dl_pct, max(prb_utilization_percent) AS peak_prb_utilization,
  {Q.rnd('avg(prb_utilization_percent)', 10)} AS prb_utilization_pct FROM fact_cells GROUP BY gold_date"""))
def sem_report(spark, sf):
    out = semantic.experience_measures(ST.star(spark, sf)["Fact_Cells"], ["gold_date"])
    doubles = [f.name for f in out.schema.fields if f.dataType.simpleString() == "double"]
    return rounded(out, *[c for c in doubles if c != "peak_prb_utilization"])


@register("noc_daily_summary", Q.query(Q.MSG, Q.ALERTS, FACT_ALARMS, Q.SCORES, PREDICTIONS, select=f"""
SELECT d.*, r.*, CASE WHEN critical_alarms >= 100 THEN 'Network under stress — immediate NOC attention required.'
    WHEN critical_alarms > 0 THEN 'Critical alarms present — monitor closely.'
    ELSE 'Network operating normally.' END AS headline
FROM (SELECT gold_date AS summary_date, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_alarms,
        count(*) AS total_alarms FROM fact_alarms
      WHERE gold_date = (SELECT max(gold_date) FROM fact_alarms) GROUP BY gold_date) d,
 (SELECT {Q.rnd('sum(s) / sum(n) * 100', 1)} AS avg_failure_risk_pct, count(*) FILTER (WHERE high) AS high_risk_sites,
    arg_min(site_id, (-s / n, site_id)) AS worst_site
  FROM (SELECT site_id, sum(probability) AS s, count(*) AS n, bool_or(risk_level IN ('HIGH', 'CRITICAL')) AS high
        FROM (SELECT site_id, {Q.rnd('probability', 4)} AS rp, probability, {Q.risk('probability')} AS risk_level,
              CAST(timestamp AS DATE) AS pd FROM scores)
        WHERE pd = (SELECT max(CAST(timestamp AS DATE)) FROM scores) GROUP BY site_id)) r"""))
def noc_summary(spark, sf):
    # Exact binary fractions keep the mean independent of summation order.
    pred = I.scores(spark, sf).select(
        "site_id", F.col("probability").alias("failure_probability"), S.risk_level("probability").alias("risk_level"),
        F.to_date("timestamp").alias("prediction_date"))
    out = P.daily_summary(ST.star(spark, sf)["Fact_Alarms"], pred)
    return out.drop("summary_text", "generated_at")


@register("prediction_output", Q.query(Q.SCORES, PREDICTIONS, select=(
    f"SELECT {Q.stamp('timestamp')} AS timestamp, * EXCLUDE (timestamp, prediction_date) FROM pred")))
def prediction_output(spark, sf):
    return P.prediction_output(I.scores(spark, sf))


@register("prediction_summary", Q.query(Q.SCORES, PREDICTIONS, select=f"""
SELECT CASE WHEN grouping(cell_id) = 0 THEN 'cell' WHEN grouping(risk_level) = 0 THEN 'risk' ELSE 'all' END AS scope,
  COALESCE(cell_id, risk_level, 'total') AS label, count(*) AS rows, CAST(sum(predicted_failure) AS BIGINT) AS failures,
  {Q.rnd('sum(predicted_failure) * 100.0 / count(*)', 1)} AS failure_pct
FROM pred GROUP BY GROUPING SETS ((), (cell_id), (risk_level))"""))
def prediction_summary(spark, sf):
    return P.prediction_summary(P.prediction_output(I.scores(spark, sf)))


@register("prediction_freshness", Q.query(Q.SCORES, PREDICTIONS, select=(
    f"SELECT {Q.day('prediction_date')} AS prediction_date, count(*) AS total FROM pred GROUP BY 1")))
def prediction_freshness(spark, sf):
    return ST.predictions(spark, sf).groupBy("prediction_date").agg(F.count("*").alias("total"))


@register("latest_partition_rows", Q.query(Q.MSG, Q.CELLS, *fact_cells_ctes(), select="""
SELECT gold_date, count(*) AS total FROM fact_cells WHERE gold_date = (SELECT max(gold_date) FROM fact_cells)
GROUP BY gold_date"""))
def latest_partition_rows(spark, sf):
    from mastline.sources.files import latest_partition

    return latest_partition(ST.star(spark, sf)["Fact_Cells"]).groupBy("gold_date").agg(F.count("*").alias("total"))


# ---------------------------------------------------------------------------
# Model input
# ---------------------------------------------------------------------------
HOURLY_KEYS = "site_id, cell_id, hour_ts"


def hourly_ctes() -> list[str]:
    cols = []
    for m in layout.METRICS:
        if m in ("status", "op_state"):
            continue
        if m in ("technology", "bandwidth_mhz"):
            cols.append(f"arg_min({m}, (snapshot_time, {m})) AS {m}")
        elif m in layout.COUNTERS:
            cols.append(f"CAST(sum({m}) AS BIGINT) AS {m}")
        elif m in layout.HEADCOUNTS:
            cols.append(f"CAST({Q.rnd(f'avg({m})', 0)} AS BIGINT) AS {m}")
        else:
            cols.append(f"{Q.rnd(f'avg({m})', 4)} AS {m}")
    return [
        "ch AS (SELECT *, date_trunc('hour', snapshot_time) AS hour_ts FROM cells)",
        Q.mode("hs", "ch", HOURLY_KEYS, "cell_status", "status"),
        Q.mode("ho", "ch", HOURLY_KEYS, "cell_op_state", "op_state"),
        f"hk AS (SELECT {HOURLY_KEYS}, {', '.join(cols)} FROM ch GROUP BY {HOURLY_KEYS})",
        "hourly AS (SELECT hk.*, hs.status, ho.op_state FROM hk "
        + " ".join(f"LEFT JOIN {t} ON hk.site_id = {t}.site_id AND hk.cell_id = {t}.cell_id AND hk.hour_ts IS NOT DISTINCT FROM {t}.hour_ts"
                   for t in ("hs", "ho")) + ")",
    ]


def timed_cells(spark, sf):
    """All cells; those without a readable time stay, under a null hour."""
    return ST.silver(spark, sf, "cells")


@register("hourly_cells", Q.query(Q.MSG, Q.CELLS, *hourly_ctes(), select=(
    f"SELECT * EXCLUDE (hour_ts), {Q.stamp('hour_ts')} AS hour_ts FROM hourly")))
def hourly_cells(spark, sf):
    return features.hourly_cells(timed_cells(spark, sf))


def wide_ctes() -> list[str]:
    cols = ", ".join(
        f"max(CASE WHEN slot = {i} THEN {m} END) AS cell_{i}_{m}" for i in (1, 2, 3) for m in layout.METRICS)
    cols += ", greatest(max(slot) - 3, 0) AS cell_surplus"
    return [*hourly_ctes(),
            "slotted AS (SELECT *, dense_rank() OVER (PARTITION BY site_id, hour_ts ORDER BY cell_id) AS slot FROM hourly)",
            f"wide AS (SELECT site_id, hour_ts, {cols} FROM slotted GROUP BY site_id, hour_ts)"]


@register("hourly_wide", Q.query(Q.MSG, Q.CELLS, *wide_ctes(), select=(
    f"SELECT * EXCLUDE (hour_ts), {Q.stamp('hour_ts')} AS timestamp, {Q.day('hour_ts')} AS gold_date FROM wide")))
def hourly_wide(spark, sf):
    return features.hourly_wide(timed_cells(spark, sf))


LONG = ["long AS (" + " UNION ALL ".join(
    "SELECT site_id, hour_ts AS timestamp, " + f"{i} AS cell_id, "
    + ", ".join(f"cell_{i}_{m} AS {m}" for m in layout.METRICS) + " FROM wide" for i in (1, 2, 3))
    + " UNION ALL SELECT site_id, hour_ts AS timestamp, slot AS cell_id, " + ", ".join(layout.METRICS) + " FROM slotted WHERE slot > 3)"]


@register("wide_to_long", Q.query(Q.MSG, Q.CELLS, *wide_ctes(), *LONG, select=(
    f"SELECT * EXCLUDE (timestamp), {Q.stamp('timestamp')} AS timestamp FROM long")))
def wide_to_long(spark, sf):
    return features.all_cells(ST.wide(spark, sf), ST.surplus_cells(spark, sf))


def feature_select(backfill: bool = True) -> list[str]:
    code = "CASE " + " ".join(f"WHEN {{c}} = '{k}' THEN {v}" for k, v in layout.STATUS_CODES.items()) + " ELSE 0 END"
    tech = "CASE " + " ".join(f"WHEN technology = '{k}' THEN {v}" for k, v in layout.TECHNOLOGY_CODES.items()) + " ELSE 2 END"
    part = "PARTITION BY site_id, cell_id ORDER BY timestamp NULLS FIRST"
    cols = [f"{code.format(c=c)} AS {c}" for c in ("status", "op_state")] + [f"{tech} AS technology"]
    cols += ["hour(timestamp) AS hour_of_day", "isodow(timestamp) - 1 AS day_of_week",
             "day(timestamp) AS day_of_month", "month(timestamp) AS month",
             "CASE WHEN isodow(timestamp) >= 6 THEN 1 ELSE 0 END AS is_weekend",
             "CASE WHEN hour(timestamp) >= 22 OR hour(timestamp) < 6 THEN 1 ELSE 0 END AS is_night"]
    for n in layout.ROLL_WINDOWS:
        over = f"OVER ({part} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        for k in layout.ROLL_KPIS:
            cols += [Q.rnd(f"avg({k}) {over}", 8) + f" AS {k}_roll{n}_mean",
                     Q.rnd(f"COALESCE(stddev_samp({k}) {over}, 0)", 8) + f" AS {k}_roll{n}_std",
                     f"max({k}) {over} AS {k}_roll{n}_max", f"min({k}) {over} AS {k}_roll{n}_min"]
    lags, filled = [], []
    for k in layout.LAG_KPIS:
        for s in layout.LAG_STEPS:
            lags.append(f"lag({k}, {s}) OVER ({part}) AS {k}_lag{s}")
            filled.append(f"{k}_lag{s}" if not backfill else
                Q.rnd(f"COALESCE(first_value({k}_lag{s} IGNORE NULLS) OVER ({part} ROWS BETWEEN CURRENT ROW AND "
                      f"UNBOUNDED FOLLOWING), avg({k}) OVER (PARTITION BY site_id, cell_id))", 8)
                + f" AS {k}_lag{s}")
    for k in layout.DELTA_KPIS:
        for s in layout.DELTA_STEPS:
            cols.append(Q.rnd(f"COALESCE({k} - lag({k}, {s}) OVER ({part}), 0)", 8) + f" AS {k}_delta{s}")
    kept = [x for x in layout.METRICS if x not in layout.CATEGORIES]
    return [
        f"lagged AS (SELECT *, {', '.join(lags)} FROM long)",
        f"feat AS (SELECT site_id, timestamp, cell_id, {', '.join(kept)}, {', '.join(cols)}, {', '.join(filled)} FROM lagged)",
    ]


@register("model_features_by_load", Q.query(Q.MSG, Q.CELLS, *wide_ctes(), *LONG, *feature_select(backfill=False), select=(
    f"SELECT * EXCLUDE (timestamp), {Q.stamp('timestamp')} AS timestamp FROM feat")))
def model_features_by_load(spark, sf):
    """Features of four loads in time order, each from its own rows and the last 24 of every cell; no lag looks ahead."""
    def build(path: str) -> None:
        rows = wide_to_long(spark, sf)
        seconds = F.unix_seconds("timestamp")
        low, high = rows.agg(F.min(seconds), F.max(seconds)).first()
        due = F.coalesce(F.floor((seconds - low) * 4 / (high - low + 1)), F.lit(0))  # rows without a time come first
        state = SeriesState(spark, f"{path}/state", ["site_id", "cell_id"], "timestamp")
        for load in (0, 1, 2, 2, 3):  # the third load comes twice
            made = state.advance(rows.where(due == load), load, lambda both: features.build_features(both, backfill=False))
            made.write.mode("overwrite").parquet(f"{path}/features/load={load}")

    out = spark.read.parquet(f"{ST._once(spark, sf, 'features-by-load', build)}/features").drop("load")
    soft = [c for c in out.columns if c.endswith(("_mean", "_std")) or "_delta" in c]
    return out.withColumns({c: F.round(c, 8) for c in soft})


@register("model_features", Q.query(Q.MSG, Q.CELLS, *wide_ctes(), *LONG, *feature_select(), select=(
    f"SELECT * EXCLUDE (timestamp), {Q.stamp('timestamp')} AS timestamp FROM feat")))
def model_features(spark, sf):
    out = features.build_features(wide_to_long(spark, sf))
    soft = [c for c in out.columns if c.endswith(("_mean", "_std")) or "_lag" in c or "_delta" in c]
    return out.withColumns({c: F.round(c, 8) for c in soft})


EDGE = 0.0001234  # no feature's step or mean falls next to it


def aligned_select() -> str:
    """Per cell number: how many values of each manifest feature are positive and negative, and their mean; absent ones are 0."""
    made = set(layout.METRICS) | {"hour_of_day", "day_of_week", "day_of_month", "month", "is_weekend", "is_night"}
    m = features.Manifest()
    made |= {f"{k}_roll{n}_{x}" for k in layout.ROLL_KPIS for n in layout.ROLL_WINDOWS for x in ("mean", "std", "max", "min")}
    made |= {f"{k}_lag{n}" for k in layout.LAG_KPIS for n in layout.LAG_STEPS} | {f"{k}_delta{n}" for k in layout.DELTA_KPIS for n in layout.DELTA_STEPS}
    cols = []
    for c in m.feature_columns:
        for sign, test in (("pos", f"> {EDGE}"), ("neg", f"< -{EDGE}")):
            cols.append((f"count(*) FILTER (WHERE {c} {test})" if c in made else "0") + f" AS {c}_{sign}" if c != "cell_id" else "")
        if c != "cell_id":
            cols.append((Q.rnd(f"avg(COALESCE({c}, 0))", 2) if c in made else "CAST(0 AS DOUBLE)") + f" AS {c}_avg")
    return "SELECT cell_id AS key_cell_id, " + ", ".join(filter(None, cols)) + " FROM feat GROUP BY cell_id"


@register("aligned_feature_totals", Q.query(Q.MSG, Q.CELLS, *wide_ctes(), *LONG, *feature_select(), select=aligned_select()))
def aligned(spark, sf):
    rows = features.align_features(features.build_features(wide_to_long(spark, sf)))
    names = [c for c in features.Manifest().feature_columns if c != "cell_id"]
    return rows.groupBy("key_cell_id").agg(*[x for c in names for x in (
        F.count_if(F.col(c) > EDGE).alias(f"{c}_pos"), F.count_if(F.col(c) < -EDGE).alias(f"{c}_neg"), F.round(F.avg(c), 2).alias(f"{c}_avg"))])
