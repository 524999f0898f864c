"""Operators run directly on the driver tables, streams, and the model."""

from __future__ import annotations

from pyspark.sql import functions as F

from mastline.functions import scalars as S
from mastline.operators import joins, slots, timebuckets, timeseries
from mastline.operators.blocks import chunk_of
from mastline.operators.ledger import RunLedger
from mastline.plans import features, training
from mastline.session import scratch_path
from mastline.sources import brokers, files, sinks
from mastline.streaming import jobs
from mastline_queries import inputs as I
from mastline_queries import sqltext as Q
from mastline_queries import staging as ST
from mastline_queries import warehouse as W
from mastline_queries.registry import register


def events(spark, sf):
    return I.table(spark, sf, "events")


# -- parsing and keys ------------------------------------------------------------
@register("flat_json", """
WITH t AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CASE event_id % 5 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN '1d' WHEN 2 THEN 'true'
    WHEN 3 THEN NULL ELSE event_type END AS raw FROM events)
SELECT event_id, k, CASE WHEN event_id % 5 = 0 THEN CAST(raw AS DOUBLE) END AS num,
  CASE WHEN event_id % 5 <> 0 THEN raw END AS token FROM t""")
def flat_json(spark, sf):
    e = events(spark, sf).select("event_id", "event_type", F.col("props").cast("binary").alias("value"))
    parsed = brokers.parse_json_value(e, "k bigint", keep=("event_id", "event_type"))
    i = F.col("event_id") % 5
    text = S.ladder([
        (i == 0, F.col("event_id").cast("string")), (i == 1, F.lit("1d")), (i == 2, F.lit("true")),
        (i == 3, F.lit(None).cast("string"))], F.col("event_type"))
    mixed = parsed.withColumn("raw", text)
    return mixed.select(
        "event_id", "k", S.numeric_value("raw").alias("num"), S.token_value("raw").alias("token"))


@register("date_time_keys", """
SELECT event_id, CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS date_key, CAST(strftime(ts, '%H%M') AS BIGINT) AS time_key,
  md5(concat_ws('|', user_id, event_type)) AS sk FROM events""")
def date_time_keys(spark, sf):
    return events(spark, sf).select(
        "event_id", S.date_key("ts").alias("date_key"), S.time_key("ts").alias("time_key"),
        S.surrogate_key("user_id", "event_type").alias("sk"))


# -- buckets ---------------------------------------------------------------------
@register("bucket_mode", Q.query(
    "b AS (SELECT user_id, time_bucket(INTERVAL '6 hours', ts) AS bucket_start, event_type FROM events)",
    Q.mode("m", "b", "user_id, bucket_start", "event_type", "top_type"),
    select=f"SELECT user_id, {Q.stamp('bucket_start')} AS bucket_start, top_type FROM m"))
def bucket_mode(spark, sf):
    rows = timebuckets.time_bucket(events(spark, sf), "ts", "6 hours", day=None)
    return timebuckets.mode_in_group(rows, ["user_id", "bucket_start"], "event_type", "top_type")


@register("last_in_bucket", f"""
SELECT user_id, {Q.stamp("time_bucket(INTERVAL '15 minutes', ts)")} AS bucket_start,
  arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1, 2""")
def last_in_bucket(spark, sf):
    rows = timebuckets.time_bucket(events(spark, sf), "ts", day=None)
    return timebuckets.last_in_bucket(
        rows, ["user_id"], "bucket_start", "event_type", ["ts", "event_id"], "last_type")


@register("slot_pivot", """
WITH c AS (SELECT l_orderkey, l_partkey, sum(l_quantity) AS q, max(l_returnflag) AS f FROM lineitem GROUP BY ALL),
r AS (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS slot FROM c)
SELECT l_orderkey, max(CASE WHEN slot = 1 THEN q END) AS part1_qty, max(CASE WHEN slot = 1 THEN f END) AS part1_flag,
  max(CASE WHEN slot = 2 THEN q END) AS part2_qty, max(CASE WHEN slot = 2 THEN f END) AS part2_flag,
  max(CASE WHEN slot = 3 THEN q END) AS part3_qty, max(CASE WHEN slot = 3 THEN f END) AS part3_flag,
  greatest(max(slot) - 3, 0) AS part_surplus
FROM r GROUP BY l_orderkey""")
def slot_pivot(spark, sf):
    return slots.slot_pivot(order_parts(spark, sf), ["l_orderkey"], "l_partkey", 3,
                            {"part{slot}_qty": "q", "part{slot}_flag": "f"}, "part_surplus")


def order_parts(spark, sf):
    return I.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(
        F.sum("l_quantity").alias("q"), F.max("l_returnflag").alias("f"))


@register("slot_surplus", """
WITH c AS (SELECT l_orderkey, l_partkey, sum(l_quantity) AS q, max(l_returnflag) AS f FROM lineitem GROUP BY ALL)
SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS slot FROM c) WHERE slot > 3""")
def slot_surplus(spark, sf):
    return slots.surplus_rows(order_parts(spark, sf), ["l_orderkey"], "l_partkey", 3)


@register("wide_fact_join", f"""
WITH e AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type, value FROM events),
a AS (SELECT user_id, d, count(*) AS events FROM e GROUP BY ALL),
p AS (SELECT user_id, d, {Q.rnd('max(value)', 2)} AS top_purchase FROM e WHERE event_type = 'purchase' GROUP BY ALL),
x AS (SELECT user_id, d, count(*) AS errors FROM e WHERE event_type = 'error' GROUP BY ALL)
SELECT user_id, {Q.day('d')} AS d, events, top_purchase, errors
FROM a LEFT JOIN p USING (user_id, d) LEFT JOIN x USING (user_id, d)""")
def wide_fact_join(spark, sf):
    e = events(spark, sf).withColumn("d", F.to_date("ts"))
    keys = ["user_id", "d"]
    base = e.groupBy(*keys).agg(F.count("*").alias("events"))
    bought = e.where(F.col("event_type") == "purchase").groupBy(*keys).agg(
        F.round(F.max("value"), 2).alias("top_purchase"))
    failed = e.where(F.col("event_type") == "error").groupBy(*keys).agg(F.count("*").alias("errors"))
    return joins.assemble_wide(base, [bought, failed], keys)


# -- series ----------------------------------------------------------------------
SERIES = "PARTITION BY user_id ORDER BY ts, event_id"


def cents(spark, sf):
    """Event values as whole cents, with one in eleven missing."""
    cent = F.round(F.col("value") * 100).cast("double")
    return events(spark, sf).select(
        "event_id", "user_id", "ts", F.when(F.col("event_id") % 11 != 0, cent).alias("value"))


CENTS = ("c AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 11 <> 0 THEN round(value * 100) END AS value "
         "FROM events)")
BLOCK = 64


@register("roll_features", Q.query(CENTS, select="SELECT event_id, " + ", ".join(
    f"{Q.rnd(x, 6)} AS value_roll{n}_{s}" for n in (3, 12) for s, x in [
        ("mean", f"avg(value) OVER w{n}"), ("std", f"COALESCE(stddev_samp(value) OVER w{n}, 0)"),
        ("max", f"max(value) OVER w{n}"), ("min", f"min(value) OVER w{n}")])
    + " FROM c WINDOW " + ", ".join(f"w{n} AS ({SERIES} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (3, 12))))
def roll_features(spark, sf):
    out = timeseries.add_series_features(
        cents(spark, sf), ["user_id"], ["ts", "event_id"], roll=["value"], roll_sizes=(3, 12),
        block_rows=BLOCK, chunk=chunk_of("ts", "day"))
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in out.columns if "_roll" in c])


@register("lag_backfill", Q.query(
    CENTS, "l AS (SELECT *, " + ", ".join(f"lag(value, {k}) OVER ({SERIES}) AS l{k}" for k in (1, 6)) + " FROM c)",
    select="SELECT event_id, " + ", ".join(Q.rnd(
        f"COALESCE(first_value(l{k} IGNORE NULLS) OVER ({SERIES} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), "
        "avg(value) OVER (PARTITION BY user_id))", 6) + f" AS value_lag{k}" for k in (1, 6)) + " FROM l"))
def lag_backfill(spark, sf):
    out = timeseries.add_series_features(
        cents(spark, sf), ["user_id"], ["ts", "event_id"], lag=["value"], lag_steps=(1, 6), block_rows=BLOCK)
    return out.select("event_id", *[F.round(f"value_lag{k}", 6).alias(f"value_lag{k}") for k in (1, 6)])


@register("deltas", Q.query(CENTS, select="SELECT event_id, " + ", ".join(
    f"COALESCE(value - lag(value, {k}) OVER ({SERIES}), 0) AS value_delta{k}" for k in (1, 3)) + " FROM c"))
def deltas(spark, sf):
    out = timeseries.add_series_features(
        cents(spark, sf), ["user_id"], ["ts", "event_id"], delta=["value"], block_rows=BLOCK)
    return out.select("event_id", "value_delta1", "value_delta3")


@register("asof_join", f"""
SELECT p.event_id, v.event_id AS view_id, v.value AS view_value, {Q.stamp('v.ts')} AS matched_ts
FROM (SELECT *, CASE WHEN event_id % 13 <> 0 THEN user_id END AS u FROM events WHERE event_type = 'purchase' AND event_id % 13 <> 0) p
ASOF LEFT JOIN (SELECT *, CASE WHEN event_id % 13 <> 0 THEN user_id END AS u FROM events WHERE event_type = 'view') v ON p.u = v.u AND p.ts >= v.ts
UNION ALL SELECT event_id, NULL, NULL, NULL FROM events WHERE event_type = 'purchase' AND event_id % 13 = 0""")
def asof_join(spark, sf):
    """One key in thirteen is missing on both sides; missing keys match nothing."""
    e = events(spark, sf).withColumn("user_id", F.when(F.col("event_id") % 13 != 0, F.col("user_id")))
    bought = e.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    seen = e.where(F.col("event_type") == "view").select(
        "user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    out = timeseries.asof_join(bought, seen, ["user_id"], "ts", "view_ts", ["view_id", "view_value"])
    return out.drop("user_id", "ts")


@register("asof_weather", Q.query(Q.MSG, Q.WEATHER, """
w AS (SELECT ran_site_id, ingested_at, max(k) AS k FROM wx WHERE ran_site_id <> '' GROUP BY ALL)""", select="""
SELECT m.message_id, w.k FROM (SELECT * FROM msg WHERE snapshot_time IS NOT NULL) m
ASOF LEFT JOIN w ON m.site_id = w.ran_site_id AND m.snapshot_time >= w.ingested_at
UNION ALL SELECT message_id, NULL FROM msg WHERE snapshot_time IS NULL"""))
def asof_weather(spark, sf):
    left = ST.silver(spark, sf, "site_snapshot").select("message_id", "site_id", "snapshot_time")
    right = I.weather(spark, sf).where(F.col("ran_site_id") != "").select(
        F.col("ran_site_id").alias("site_id"), F.col("ingested_at").cast("timestamp").alias("at"), "k")
    out = timeseries.asof_join(left, right, ["site_id"], "snapshot_time", "at", ["k"], tie=["k"])
    return out.select("message_id", "k")


@register("sequence_gaps", """
WITH s AS (SELECT DISTINCT o_custkey, o_orderkey FROM orders),
p AS (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM s)
SELECT o_custkey, prev + 1 AS first_missing, o_orderkey - 1 AS last_missing, o_orderkey - prev - 1 AS missing
FROM p WHERE o_orderkey - prev > 1""")
def sequence_gaps(spark, sf):
    return timeseries.sequence_gaps(I.table(spark, sf, "orders"), "o_custkey", "o_orderkey", block=2000)


# -- files, landing, sinks -------------------------------------------------------
@register("new_files", """
SELECT DISTINCT concat('f-', o_custkey) AS source_file FROM orders
WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def new_files(spark, sf):
    o = I.table(spark, sf, "orders").withColumn("source_file", F.concat(F.lit("f-"), "o_custkey"))
    return files.new_files(o, o.where(F.col("o_orderstatus") == "F"))


@register("incremental_silver", Q.query(Q.MSG, Q.CELLS, select="""
SELECT site_id, count(*) AS rows, count(DISTINCT message_id) AS messages, CAST(sum(active_users) AS BIGINT) AS active_users,
  sum(CASE WHEN message_id IS NULL THEN NULL ELSE sequence_number % 2 END) AS second_load FROM cells GROUP BY site_id"""))
def incremental_silver(spark, sf):
    """Snapshots as packed JSON files that arrive in two parts; each load reads only the new part."""
    root = scratch_path(spark, "incremental")
    odd = F.col("sequence_number") % 2
    for part in (0, 1):
        ST.whole(spark, sf).drop("source_file").where(odd == part).write.json(f"{root}/landed/part={part}", compression="gzip")
        jobs.load_new_snapshots(spark, f"{root}/landed", f"{root}/silver", f"{root}/log", f"{root}/manifest")
    cells = files.read_table(spark, f"{root}/silver", "cells")
    return cells.groupBy("site_id").agg(
        F.count("*").alias("rows"), F.count_distinct("message_id").alias("messages"), F.sum("active_users").alias("active_users"),
        F.sum(F.when(F.col("load") > 0, 1).otherwise(0)).alias("second_load"))


@register("registered_views", """
SELECT n_regionkey, count(*) AS nations, min(n_name) AS first_name FROM nation GROUP BY n_regionkey""")
def registered_views(spark, sf):
    root = scratch_path(spark, "views")
    I.table(spark, sf, "nation").write.parquet(f"{root}/nation_view")
    files.register_tables(spark, root, ["nation_view"])
    return spark.sql("SELECT n_regionkey, count(*) AS nations, min(n_name) AS first_name FROM nation_view GROUP BY n_regionkey")


@register("snapshot_files", Q.query(Q.MSG, select="""
SELECT site_id, count(*) AS rows, count(DISTINCT message_id) AS messages, 0 AS unseen_files FROM msg GROUP BY site_id"""))
def snapshot_files(spark, sf):
    """Packed JSON snapshots in two deliveries, each read by its new files; the manifest then leaves nothing unseen."""
    root = scratch_path(spark, "snapshot-files")
    own = ST.whole(spark, sf).drop("source_file")
    for part in (0, 1):
        own.where(F.pmod(F.xxhash64("message_id"), F.lit(2)) == part).write.json(f"{root}/landed/part={part}", compression="gzip")
        rows, todo = files.read_new_snapshots(spark, f"{root}/landed", f"{root}/manifest")
        rows.select("message_id", "ran_metadata.site_id", "source_file").write.parquet(f"{root}/read/delivery={part}")
        files.write_manifest(todo, f"{root}/manifest")
    left = files.new_files(files.list_files(spark, f"{root}/landed"), files.read_manifest(spark, f"{root}/manifest"))
    return files.read_table(spark, root, "read").groupBy("site_id").agg(
        F.count("*").alias("rows"), F.count_distinct("message_id").alias("messages")).withColumn("unseen_files", left.agg(F.count("*")).scalar())


@register("backfill_landing", """
WITH m AS (SELECT ts, hour(ts) * 60 + minute(ts) AS m FROM events)
SELECT strftime(ts, '%Y-%m-%d') AS day, m < 720 OR m >= 735 AS inside, count(*) AS total FROM m GROUP BY ALL""")
def backfill_landing(spark, sf):
    """Chunks landed twice: what is there is kept, and rows outside the windows stand apart."""
    root = scratch_path(spark, "backfill")
    chunks = sinks.backfill_chunks(events(spark, sf).select("event_id", "ts"), "ts", "ran_telemetry")
    for _ in range(2):
        sinks.write_backfill(chunks, root, "ts")
    layout = ", ".join(f"{c} string" for c in sinks.HOUR_LAYOUT)
    inside = spark.read.schema(f"event_id long, {layout}").json(root).select(F.concat_ws("-", *sinks.HOUR_LAYOUT[:3]).alias("day"), F.lit(True).alias("inside"))
    outside = spark.read.schema("event_id long, day string").json(f"{root}/{sinks.OUTSIDE}").select("day", F.lit(False).alias("inside"))
    return inside.unionByName(outside).groupBy("day", "inside").agg(F.count("*").alias("total"))


@register("catalog_tables", """
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS ids, (SELECT count(*) FROM events) AS known_rows
FROM events WHERE ts >= (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY 1""")
def catalog_tables(spark, sf):
    """A catalog table over two loads: the newest day is found and counted by the catalog."""
    root = scratch_path(spark, "catalog")
    rows = events(spark, sf).select("event_id", "ts", F.to_date("ts").alias("day"))
    newest = rows.agg(F.max("day").alias("day")).scalar()
    rows.where(F.col("day") < newest).hint("rebalance", "day").write.partitionBy("day").parquet(f"{root}/event_days")
    table = files.create_tables(spark, root, {"event_days": ["day"]}, f"serving_{root.rsplit('-', 1)[1]}")[0]
    rows.where(F.col("day") == newest).hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(f"{root}/event_days")
    files.refresh_loaded(spark, table, True)
    last = files.latest_partition(spark.table(table), "day")
    return last.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("events"), F.sum("event_id").alias("ids")).withColumn("known_rows", F.lit(files.known_rows(spark, table)).cast("long"))


@register("run_ledger", Q.query(Q.MSG, Q.CELLS, Q.RAW_LINKS, Q.ALERTS, select=" UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", sequence_number % 2 AS load, count(*) AS rows_in, count(snapshot_time) AS rows_out, "
    f"count(*) - count(snapshot_time) AS rows_quarantined FROM {t} GROUP BY 2" for t in ("cells", "transport_links", "alerts"))))
def run_ledger(spark, sf):
    """Two loads of three tables; readings without a time are set apart, and every row is accounted for."""
    root = scratch_path(spark, "run-ledger")
    ledger = RunLedger(spark, f"{root}/ledger")
    for load in (0, 1):
        own = {t: ST.silver(spark, sf, t).where(F.col("sequence_number") % 2 == load) for t in ("cells", "transport_links", "alerts")}
        ledger.write({t: (rows, F.col("snapshot_time").isNull()) for t, rows in own.items()}, f"{root}/silver", load)
    return ledger.read().drop("recorded_at")


@register("partition_rows", Q.query(Q.MSG, Q.CELLS, *W.fact_cells_ctes(), select="""
SELECT cell_key, count(*) AS total FROM fact_cells WHERE gold_date = DATE '2026-01-01' GROUP BY cell_key"""))
def partition_rows(spark, sf):
    root = scratch_path(spark, "partitions")
    sinks.write_gold(W.frames(spark, sf)["Fact_Cells"], root, ["gold_date"])
    return files.read_partition(spark, root, "2026-01-01").groupBy("cell_key").agg(F.count("*").alias("total"))


@register("landing_layout", """
SELECT strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, strftime(ts, '%H') AS hour,
  count(*) AS total FROM events GROUP BY ALL""")
def landing_layout(spark, sf):
    rows = sinks.hour_partitions(events(spark, sf), "ts")
    return rows.groupBy(*sinks.HOUR_LAYOUT).agg(F.count("*").alias("total"))


@register("backfill_chunks", """
WITH m AS (SELECT ts, hour(ts) * 60 + minute(ts) AS m FROM events),
c AS (SELECT CASE WHEN m < 720 OR m >= 735 THEN date_trunc('day', ts) + CASE WHEN m < 720 THEN INTERVAL 0 MINUTE ELSE INTERVAL 735 MINUTE END END AS s
  FROM m)
SELECT CASE WHEN s IS NULL THEN 'ran_telemetry/outside_windows' ELSE concat('ran_telemetry/year=', strftime(s, '%Y'), '/month=', strftime(s, '%m'), '/day=', strftime(s, '%d'),
  '/hour=', strftime(s, '%H'), '/ran_telemetry_', strftime(s, '%Y%m%d'), '_',
  CASE WHEN minute(s) = 0 THEN strftime(s, '%H') ELSE strftime(s, '%H%M') END, '.json') END AS chunk_key, count(*) AS total
FROM c GROUP BY 1""")
def backfill_chunks(spark, sf):
    rows = sinks.backfill_chunks(events(spark, sf), "ts", "ran_telemetry")
    return rows.groupBy("chunk_key").agg(F.count("*").alias("total"))


@register("prediction_csv_round_trip", Q.query(Q.SCORES, W.PREDICTIONS, select=f"""
SELECT {Q.stamp('timestamp')} AS timestamp_col, site_id, cell_id, failure_probability, predicted_failure, risk_level,
  '2026-01-02' AS prediction_date FROM pred"""))
def csv_round_trip(spark, sf):
    done = ST.predictions(spark, sf).withColumnRenamed("timestamp_col", "timestamp")
    root = scratch_path(spark, "predictions")
    sinks.write_predictions(done, f"{root}/2026-01-02_predictions.csv")
    return files.read_predictions(spark, root)


@register("keyed_messages", """
SELECT CAST(c_nationkey AS VARCHAR) AS key, count(*) AS total, sum(c_custkey) AS custkeys FROM customer GROUP BY 1""")
def keyed_messages(spark, sf):
    sent = brokers.keyed_messages(I.table(spark, sf, "customer"), "c_nationkey")
    back = sent.select("key", F.from_json("value", "c_custkey bigint").alias("v"))
    return back.groupBy("key").agg(F.count("*").alias("total"), F.sum("v.c_custkey").alias("custkeys"))


# -- streams ---------------------------------------------------------------------
def event_stream(spark, sf):
    schema = events(spark, sf).schema
    # A pattern, as a stream takes a single file only by one.
    return spark.readStream.schema(schema).parquet(f"{sf.rstrip('/')}/events.parque?").withColumn(
        "ts", F.col("ts").cast("timestamp"))


def drain(spark, stream, label):
    """Run a stream to its end and read what its file sink holds."""
    out = scratch_path(spark, label)
    jobs.run_to_files(stream, f"{out}/data", f"{out}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


@register("stream_bucket_agg", f"""
WITH b AS (SELECT time_bucket(INTERVAL '15 minutes', ts) AS s, event_type, count(*) AS n, max(value) AS top
  FROM events GROUP BY ALL)
SELECT {Q.stamp('s')} AS bucket_start, event_type, n, top FROM b""")
def stream_bucket_agg(spark, sf):
    measures = {"n": (F.count("*"), F.sum), "top": (F.max("value"), F.max)}
    out = scratch_path(spark, "stream-buckets")
    jobs.run_bucket_partials(event_stream(spark, sf), ["event_type"], measures, f"{out}/data", f"{out}/checkpoint", ts="ts")
    return jobs.merged_buckets(spark, f"{out}/data", ["event_type"], measures)


@register("stream_dedup", """
SELECT event_id % 1000 AS dedup_key, count(*) AS total FROM (SELECT DISTINCT event_id FROM events) GROUP BY 1""")
def stream_dedup(spark, sf):
    doubled = event_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    out = scratch_path(spark, "stream-dedup")
    for attempt in ("first", "replay"):  # the second stream has lost its checkpoint and sends every row again
        jobs.run_distinct(doubled, ["event_id"], f"{out}/data", f"{out}/{attempt}")
    once = spark.read.parquet(f"{out}/data")
    return once.groupBy((F.col("event_id") % 1000).alias("dedup_key")).agg(F.count("*").alias("total"))


def hashed_stream(spark, sf):
    """Events under md5 ids, in twelve files that each repeat rows of the one before."""
    def build(path: str) -> None:
        rows = events(spark, sf).select(F.md5(F.col("event_id").cast("string")).alias("id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value",
                                        F.pmod(F.xxhash64("event_id"), F.lit(11)).cast("int").alias("part"))
        again = rows.where(F.col("value") > 50).withColumn("part", F.col("part") + 1)
        rows.unionByName(again).repartition(12, "part").sortWithinPartitions("part").write.partitionBy("part").parquet(path)

    path = ST._once(spark, sf, "hashed-events", build)
    return spark.readStream.schema("id string, ts timestamp, event_type string, value double, part int").option("maxFilesPerTrigger", 1).parquet(path)


@register("stream_dedup_hashed", """
SELECT event_type, count(*) AS total, count(DISTINCT event_id) AS ids FROM events GROUP BY 1""")
def stream_dedup_hashed(spark, sf):
    """Many batches of hashed ids: a batch opens the key files whose filter may hold its keys."""
    out = scratch_path(spark, "stream-hashed")
    jobs.run_distinct(hashed_stream(spark, sf), ["id"], f"{out}/data", f"{out}/checkpoint", buckets=8)
    once = spark.read.parquet(f"{out}/data")
    return once.groupBy("event_type").agg(F.count("*").alias("total"), F.count_distinct("id").alias("ids"))


@register("stream_bucket_levels", f"""
WITH e AS (SELECT * FROM events UNION ALL SELECT * FROM events WHERE value > 50),
b AS (SELECT time_bucket(INTERVAL '15 minutes', ts) AS s, event_type, count(*) AS n, max(value) AS top FROM e GROUP BY ALL)
SELECT {Q.stamp('s')} AS bucket_start, event_type, n, top FROM b""")
def stream_bucket_levels(spark, sf):
    """Many batches of partial buckets, merged into levels on the way."""
    measures = {"n": (F.count("*"), F.sum), "top": (F.max("value"), F.max)}
    out = scratch_path(spark, "stream-levels")
    jobs.run_bucket_partials(hashed_stream(spark, sf), ["event_type"], measures, f"{out}/data", f"{out}/checkpoint", ts="ts")
    return jobs.merged_buckets(spark, f"{out}/data", ["event_type"], measures)


@register("stream_raw_landing", """
SELECT event_type AS message_key, count(*) AS total, CAST(sum(event_id) AS BIGINT) AS offsets FROM events GROUP BY 1""")
def stream_raw_landing(spark, sf):
    sent = event_stream(spark, sf).select(
        F.lit("ran_telemetry").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"),
        F.col("event_type").cast("binary").alias("key"), F.col("props").cast("binary").alias("value"),
        F.col("ts").alias("timestamp"))
    out = scratch_path(spark, "stream-landing")
    for attempt in ("first", "replay"):
        # The second run has lost its checkpoint and sends every row again.
        query = jobs.start_raw_landing(sent, f"{out}/data", f"{out}/{attempt}", {"availableNow": True})
        query.awaitTermination()
    landed = spark.read.parquet(f"{out}/data")
    return landed.groupBy("message_key").agg(
        F.count("*").alias("total"), F.sum("kafka_offset").alias("offsets"))


# -- model -----------------------------------------------------------------------
CURVE = """bins AS (SELECT probability AS threshold, sum(label) AS pos, count(*) AS n FROM scores GROUP BY 1),
cum AS (SELECT threshold, sum(pos) OVER o AS tp, sum(n) OVER o - sum(pos) OVER o AS fp,
  (SELECT sum(pos) FROM bins) AS p, (SELECT sum(n) - sum(pos) FROM bins) AS q FROM bins
  WINDOW o AS (ORDER BY threshold DESC)),
points AS (SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fp AS DOUBLE) / CAST(q AS DOUBLE) AS fpr,
  CAST(tp AS DOUBLE) / CAST(p AS DOUBLE) AS tpr, CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) AS precision FROM cum)
"""


@register("roc_pr_points", Q.query(Q.SCORES, CURVE, select="SELECT * FROM points"))
def roc_pr_points(spark, sf):
    return training.curve_points(I.scores(spark, sf), "probability")


@register("auc_and_ap", Q.query(Q.SCORES, CURVE, """
s AS (SELECT *, COALESCE(lag(fpr) OVER o, 0) AS x0, COALESCE(lag(tpr) OVER o, 0) AS y0 FROM points
  WINDOW o AS (ORDER BY threshold DESC))""", select=f"""
SELECT {Q.rnd('sum((fpr - x0) * (tpr + y0) / 2)', 9)} AS auc, {Q.rnd('sum((tpr - y0) * precision)', 9)} AS average_precision
FROM s"""))
def auc_and_ap(spark, sf):
    areas = training.area_metrics(I.scores(spark, sf), "probability")
    return areas.select(*[F.round(c, 9).alias(c) for c in areas.columns])


@register("confusion_matrix", Q.query(Q.SCORES, select="""
SELECT label AS actual, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS predicted, count(*) AS rows
FROM scores GROUP BY ALL"""))
def confusion_matrix(spark, sf):
    return training.confusion(I.scores(spark, sf), 0.5, "probability")


@register("class_report", Q.query(Q.SCORES, """
m AS (SELECT label AS a, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS p FROM scores),
r AS (SELECT c AS class, count(*) FILTER (WHERE a = c AND p = c) AS hit, count(*) FILTER (WHERE p = c) AS called,
  count(*) FILTER (WHERE a = c) AS support FROM m, (VALUES (0), (1)) v(c) GROUP BY c)""", select=f"""
SELECT class, hit / called AS precision, hit / support AS recall,
  {Q.rnd('2 * (hit / called) * (hit / support) / (hit / called + hit / support)', 9)} AS f1, support FROM r"""))
def class_report(spark, sf):
    out = training.class_report(training.confusion(I.scores(spark, sf), 0.5, "probability"))
    return out.withColumn("f1", F.round("f1", 9))


@register("score_histogram", Q.query(Q.SCORES, select="""
SELECT class, bin, rows, rows * 50 / sum(rows) OVER (PARTITION BY class) AS density FROM (
  SELECT label AS class, least(CAST(floor(probability * 50) AS BIGINT), 49) AS bin, count(*) AS rows FROM scores GROUP BY ALL)"""))
def score_histogram(spark, sf):
    return training.score_histogram(I.scores(spark, sf), "probability")


@register("time_folds", Q.query(Q.SCORES, """
c AS (SELECT timestamp AS t, count(*) AS n FROM scores GROUP BY 1),
r AS (SELECT t, sum(n) OVER (ORDER BY t) AS seen, (SELECT sum(n) FROM c) AS total FROM c),
k AS (SELECT i, min(t) AS cut FROM r, (VALUES (1), (2), (3), (4), (5)) v(i) WHERE seen * 6 >= total * i GROUP BY i),
f AS (SELECT timestamp, (SELECT count(*) FROM k WHERE cut < timestamp) AS fold FROM scores)""", select=f"""
SELECT fold, count(*) AS rows, {Q.stamp('min(timestamp)')} AS first, {Q.stamp('max(timestamp)')} AS last FROM f GROUP BY fold"""))
def time_folds(spark, sf):
    return training.time_folds(I.scores(spark, sf)).groupBy("fold").agg(
        F.count("*").alias("rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


@register("encode_temporal", """
SELECT event_id, CASE event_type WHEN 'error' THEN 0 ELSE 0 END AS event_code, hour(ts) AS hour_of_day,
  isodow(ts) - 1 AS day_of_week, day(ts) AS day_of_month, month(ts) AS month,
  CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN hour(ts) >= 22 OR hour(ts) < 6 THEN 1 ELSE 0 END AS is_night,
  CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS label FROM events""")
def encode_temporal(spark, sf):
    return events(spark, sf).select(
        "event_id", S.lookup("event_type", features.STATUS_CODES, 0).alias("event_code"),
        *[c.alias(n) for n, c in features.temporal_columns("ts").items()],
        features.label("event_type", "view").alias("label"))


@register("order_status_codes", """
SELECT o_orderkey, CASE CASE o_orderstatus WHEN 'O' THEN 'UP' WHEN 'F' THEN 'FAILED' ELSE 'DEGRADED' END
  WHEN 'UP' THEN 1 WHEN 'DEGRADED' THEN 2 ELSE 0 END AS status,
  CASE o_orderstatus WHEN 'O' THEN 3 WHEN 'F' THEN 1 ELSE 2 END AS technology FROM orders""")
def order_status_codes(spark, sf):
    o = F.col("o_orderstatus")
    words = I.table(spark, sf, "orders").select(
        "o_orderkey",
        S.ladder([(o == "O", "UP"), (o == "F", "FAILED")], "DEGRADED").alias("status"),
        S.ladder([(o == "O", "5G"), (o == "F", "3G")], "6G").alias("technology"))
    return features.encode_categories(words)


@register("predict_with_function", Q.query(Q.MSG, Q.CELLS, *W.wide_ctes(), *W.LONG, select=f"""
SELECT {Q.stamp('timestamp')} AS timestamp, site_id, concat('CELL_', cell_id) AS cell_id,
  {Q.rnd('p', 4)} AS failure_probability, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS predicted_failure,
  {Q.risk('p')} AS risk_level
FROM (SELECT *, floor(COALESCE(prb_utilization_percent, 0)) / 128 AS p FROM long)"""))
def predict_with_function(spark, sf):
    import numpy as np

    def scorer(x):
        return np.floor(x["prb_utilization_percent"].astype("float64")) / 128

    return training.predict(
        ST.wide(spark, sf), lambda rows: training.score_with_function(rows, scorer), surplus=ST.surplus_cells(spark, sf))


def labelled_wide(spark, sf):
    """Hourly rows labelled by load: a site-hour is congested when any of its cells is."""
    hot = F.greatest(*[F.coalesce(f"cell_{i}_prb_utilization_percent", F.lit(0.0)) for i in (1, 2, 3)]) > 80
    beyond = ST.surplus_cells(spark, sf).groupBy("site_id", "timestamp").agg(F.max("prb_utilization_percent").alias("_beyond"))
    w = ST.wide(spark, sf)
    same = w["site_id"].eqNullSafe(beyond["site_id"]) & w["timestamp"].eqNullSafe(beyond["timestamp"])
    joined = w.join(beyond, same, "left").select(w["*"], "_beyond")
    return joined.withColumn("scenario_label", F.when(hot | (F.coalesce("_beyond", F.lit(0.0)) > 80), "CONGESTED").otherwise("NORMAL")).drop("_beyond")


def training_table(spark, sf):
    def build(path: str) -> None:
        training.training_frame(labelled_wide(spark, sf), surplus=ST.surplus_cells(spark, sf)).write.parquet(path)
    return spark.read.parquet(ST._once(spark, sf, "training-frame", build))


FOLDS, SMALL = 2, training.BoostSettings(max_trees=3, depth=3, min_final_trees=3)


def trained(spark, sf):
    """Artefacts of the small model and its fold metrics, trained once: (model, manifest, folds)."""
    def build(path: str) -> None:
        model, folds = training.train(training_table(spark, sf), settings=SMALL, splits=FOLDS)
        training.save_artefacts(model, training.Manifest(), f"{path}/artefacts")
        spark.createDataFrame([(f["fold"], f["auc"], f["ap"], f["trees"]) for f in folds], "fold int, auc double, average_precision double, trees int").write.parquet(
            f"{path}/folds")
    path = ST._once(spark, sf, "trained", build)
    return (*training.load_artefacts(f"{path}/artefacts"), spark.read.parquet(f"{path}/folds"))


@register("train_evaluate")
def train_evaluate(spark, sf):
    """Boosted trees on the hourly table, few and shallow; labels follow load."""
    model, _, folds = trained(spark, sf)
    scored = training.add_probability(model.transform(training_table(spark, sf).withColumn("weight", F.lit(1.0))))
    areas = training.area_metrics(scored).withColumn("stage", F.lit("all"))
    return areas.select("stage", "auc", "average_precision").unionByName(
        folds.select(F.concat(F.lit("fold "), "fold").alias("stage"), "auc", "average_precision"))


@register("train_importances")
def train_importances(spark, sf):
    """The features that the trained trees rest on; at most thirty."""
    model, manifest, _ = trained(spark, sf)
    return training.importance_rows(spark, model, manifest)


HOT = "max(COALESCE(prb_utilization_percent, 0)) OVER (PARTITION BY site_id, timestamp) > 80"


@register("training_frame_folds", Q.query(Q.MSG, Q.CELLS, *W.wide_ctes(), *W.LONG, select=f"""
SELECT fold, count(*) AS rows, CAST(sum(label) AS BIGINT) AS failures, {Q.stamp('max(timestamp)')} AS last_time FROM (
  SELECT *, CASE WHEN timestamp IS NULL THEN 0 ELSE CAST(coalesce(floor(3 * before / total), 0) AS BIGINT) END AS fold FROM (
    SELECT timestamp, CASE WHEN {HOT} THEN 1 ELSE 0 END AS label, count(timestamp) OVER () AS total,
      count(timestamp) OVER (ORDER BY timestamp NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        - count(timestamp) OVER (PARTITION BY timestamp) AS before FROM long)) GROUP BY fold"""))
def training_frame_folds(spark, sf):
    """Rows, failures and last time of each fold of the training table; every cell of a site-hour takes part."""
    folded = training.time_folds(training_table(spark, sf), splits=FOLDS)
    return folded.groupBy("fold").agg(F.count("*").alias("rows"), F.sum("label").cast("long").alias("failures"), F.max("timestamp").alias("last_time"))


@register("artefact_round_trip", Q.query(Q.MSG, Q.CELLS, *W.wide_ctes(), *W.LONG, select="""
SELECT count(*) AS rows, count(*) AS equal_scores, 284 AS n_features FROM long"""))
def artefact_round_trip(spark, sf):
    """A stored model and manifest, loaded twice, give every row the same score."""
    first, manifest, _ = trained(spark, sf)
    second, again, _ = trained(spark, sf)
    rows = training_table(spark, sf).withColumn("weight", F.lit(1.0))
    rows = training.score_with_model(rows, first).drop("features", "rawPrediction", "probability", "prediction")
    both = training.add_probability(second.transform(rows), "second_score")
    return both.agg(F.count("*").alias("rows"), F.count_if(F.col("failure_score") == F.col("second_score")).alias("equal_scores")).withColumn(
        "n_features", F.lit(len(again.feature_columns) if again == manifest else -1))
