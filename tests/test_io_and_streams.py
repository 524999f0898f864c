"""Files, sinks and streaming jobs on a local file system."""

import json

import pytest
from conftest import message
from pyspark.sql import functions as F

from mastline.operators import enrich
from mastline.operators import normalize as N
from mastline.schemas import LIVE_SNAPSHOT_DDL, live_weather_columns
from mastline.sources import brokers, files, sinks
from mastline.streaming import jobs

NOW = {"availableNow": True}


def test_only_new_files_are_read(spark, land, tmp_path):
    manifest = str(tmp_path / "manifest")
    folder = land(message(), name="a.json")
    rows, todo = files.read_new_snapshots(spark, folder, manifest)
    assert rows.count() == 1
    files.write_manifest(todo, manifest)
    land(message(message_id="m-2"), name="b.json")
    rows, todo = files.read_new_snapshots(spark, folder, manifest)
    assert [f.rsplit("/", 1)[1] for f in rows.inputFiles()] == ["b.json"]  # the old file is not opened
    assert [r["message_id"] for r in rows.collect()] == ["m-2"]
    files.write_manifest(todo, manifest)
    assert files.read_new_snapshots(spark, folder, manifest)[1].isEmpty()


def test_silver_and_gold_layout(spark, land, tmp_path):
    silver = N.normalize_snapshots(files.read_snapshots(spark, land(message())))
    sinks.write_silver(silver, str(tmp_path / "silver"))
    back = files.read_table(spark, str(tmp_path / "silver"), "cells")
    assert back.where("region = 'Alexandria'").count() == 3
    out = str(tmp_path / "fact")
    days = spark.createDataFrame([("2026-01-01", 1), ("2026-01-02", 2)], "d string, v int").select(
        F.to_date("d").alias("gold_date"), "v")
    sinks.write_gold(days, out, ["gold_date"])
    sinks.write_gold(days.where("v = 2").withColumn("v", F.lit(9)), out, ["gold_date"], dynamic=True)
    table = spark.read.parquet(out)
    assert sorted(r["v"] for r in table.collect()) == [1, 9]
    assert [r["v"] for r in files.latest_partition(table).collect()] == [9]
    assert files.latest_partition(table, lookback_days=1).count() == 2
    assert [r["v"] for r in files.read_partition(spark, out, "2026-01-01").collect()] == [1]
    files.register_tables(spark, str(tmp_path / "silver"), ["cells"])
    assert spark.table("cells").count() == 3


def test_catalog_tables_know_partitions_and_rows(spark, tmp_path):
    days = spark.createDataFrame([(f"2026-01-0{1 + k % 3}", k) for k in range(90)], "d string, v int").select(F.to_date("d").alias("gold_date"), "v")
    sinks.write_gold(days.where("v < 60"), str(tmp_path / "fact"), ["gold_date"])
    table = files.create_tables(spark, str(tmp_path), {"fact": ["gold_date"]}, "serving_test")[0]
    more = days.where("v >= 60").withColumn("gold_date", F.lit("2026-01-04").cast("date"))
    sinks.write_gold(more, str(tmp_path / "fact"), ["gold_date"], dynamic=True)
    assert spark.table(table).count() == 60  # not before the refresh
    files.refresh_loaded(spark, table, True)
    assert spark.table(table).count() == 90
    one = spark.table(table).where("gold_date = date '2026-01-04'")
    plan = one._jdf.queryExecution()
    assert "PartitionFilters: [isnotnull(gold_date" in plan.executedPlan().toString()
    assert files.known_rows(spark, table) == 90
    assert spark.table(table)._jdf.queryExecution().optimizedPlan().stats().rowCount().get() == 90
    assert one.count() == 30 and len(one.inputFiles()) == 1
    assert files.create_tables(spark, str(tmp_path), {"fact": ["gold_date"]}, "serving_test") == [table]


def test_the_ledger_counts_what_is_written(spark, tmp_path):
    from mastline.operators.ledger import RunLedger

    ledger, base = RunLedger(spark, str(tmp_path / "ledger")), str(tmp_path / "silver")
    rows = spark.range(10).withColumn("at", F.when(F.col("id") % 4 > 0, F.lit(1)))
    for load, part in enumerate((rows, rows.where("id < 3"), rows.limit(0))):
        for _ in range(2):  # a retry changes nothing
            ledger.write({"a": (part, F.col("at").isNull()), "b": (part, None)}, base, load)
    got = {(r.table, r.load): (r.rows_in, r.rows_out, r.rows_quarantined) for r in ledger.read().collect()}
    assert got == {("a", 0): (10, 7, 3), ("b", 0): (10, 10, 0), ("a", 1): (3, 2, 1), ("b", 1): (3, 3, 0), ("a", 2): (0, 0, 0), ("b", 2): (0, 0, 0)}
    assert spark.read.parquet(f"{base}/a").count() == 9 and spark.read.parquet(f"{base}/_quarantine/a").count() == 4


def test_streams_report_their_counts(spark, tmp_path):
    import time

    from mastline.operators.ledger import StreamCounts

    seen = StreamCounts()
    spark.streams.addListener(seen)
    try:
        for part in range(2):
            spark.range(5 + part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        jobs.run_to_files(stream.observe("landed", F.count(F.lit(1)).alias("rows")), str(tmp_path / "out"), str(tmp_path / "log"))
        for _ in range(100):
            if len(seen.rows) >= 2:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    assert sorted(values["rows"] for _, _, name, values in seen.rows if name == "landed") == [5, 6]


def test_predictions_round_trip_and_null_tokens(spark, tmp_path):
    (tmp_path / "2026-05-20_predictions.csv").write_text(
        'TIMESTAMP,SITE_ID,CELL_ID,FAILURE_PROBABILITY,PREDICTED_FAILURE,RISK_LEVEL\n'
        '2026-05-20 01:00:00,"SITE_1",CELL_1,0.5,1,HIGH\nnull,NULL,,,,LOW\n')
    rows = files.read_predictions(spark, str(tmp_path)).orderBy("risk_level").collect()
    assert rows[0]["failure_probability"] == 0.5 and str(rows[0]["prediction_date"]) == "2026-05-20"
    assert rows[1]["site_id"] is None and rows[1]["timestamp_col"] is None and rows[1]["cell_id"] is None


def test_backfill_windows_and_skip(spark, tmp_path):
    assert sinks.parse_windows("00:00-12:00,12:15-00:00") == [(0, 720), (735, 1440)]
    df = spark.createDataFrame([("2026-01-01 00:10:00",), ("2026-01-01 12:05:00",), ("2026-01-01 12:30:00",)], "t string").select(
        F.to_timestamp("t").alias("t"))
    chunks = sinks.backfill_chunks(df, "t", "ran_telemetry")
    keys = sorted(r["chunk_key"] for r in chunks.collect())
    assert keys == [
        "ran_telemetry/outside_windows",  # kept under a key of their own
        "ran_telemetry/year=2026/month=01/day=01/hour=00/ran_telemetry_20260101_00.json",
        "ran_telemetry/year=2026/month=01/day=01/hour=12/ran_telemetry_20260101_1215.json"]
    out = str(tmp_path / "landing")
    for _ in range(2):
        sinks.write_backfill(chunks, out, "t")
    assert spark.read.json(out).count() == 2
    assert spark.read.json(f"{out}/{sinks.OUTSIDE}").count() == 1
    later = chunks.withColumn("t", F.col("t") + F.expr("interval 1 day")).withColumn("chunk_start", F.col("chunk_start") + F.expr("interval 1 day"))
    sinks.write_backfill(chunks.unionByName(later), out, "t")
    assert spark.read.json(out).count() == 4 and spark.read.json(f"{out}/{sinks.OUTSIDE}").count() == 2
    sinks.write_backfill(later, out, "t", overwrite=True)
    assert spark.read.json(out).count() == 4
    assert sorted(sinks.landed_folders(spark, out, sinks.HOUR_LAYOUT))[0] == ("2026", "01", "01", "00")


def test_options():
    opts = brokers.kafka_read_options("b:1", "ran_telemetry", 1000)
    assert opts["startingOffsets"] == "earliest" and opts["failOnDataLoss"] == "false"
    assert opts["maxOffsetsPerTrigger"] == "1000" and "maxOffsetsPerTrigger" not in brokers.kafka_read_options("b", "t")
    assert brokers.jdbc_options("h", 5432, "d", "u", "p", "t")["url"] == "jdbc:postgresql://h:5432/d"
    assert len(live_weather_columns()) == 21


def topic(spark, tmp_path, *messages):
    """A file stream with the columns of a broker topic."""
    folder = tmp_path / "topic"
    rows = [("ran_telemetry", 0, i, None, json.dumps(m).encode(), "2026-05-20 12:45:18") for i, m in enumerate(messages)]
    df = spark.createDataFrame(rows, "topic string, partition int, offset long, key binary, value binary, timestamp string")
    df.withColumn("timestamp", F.to_timestamp("timestamp")).write.parquet(str(folder))
    return spark.readStream.schema(spark.read.parquet(str(folder)).schema).parquet(str(folder))


def test_stream_equals_batch(spark, tmp_path, land):
    stream = topic(spark, tmp_path, message(), message(message_id="m-2"))
    out = {}

    def write(table):
        return lambda batch: out.setdefault(table, []).extend(batch.drop("ingested_at").collect())
    points = {t: str(tmp_path / t) for t in ("processed_ran_metrics", "transport_metrics")}
    for q in jobs.start_telemetry(stream, points, write, NOW):
        q.awaitTermination()
    raw = files.read_snapshots(spark, land(message(), message(message_id="m-2")))
    assert sorted(out["processed_ran_metrics"]) == sorted(enrich.cell_stream(raw, stamp=False).collect())
    assert len(out["transport_metrics"]) == 4


def test_malformed_messages_are_null_not_fatal(spark):
    bad = spark.createDataFrame([(b"{not json",)], "value binary")
    assert enrich.cell_stream(brokers.parse_json_value(bad, LIVE_SNAPSHOT_DDL)).count() == 0


def test_replayed_batches_add_nothing(spark, tmp_path):
    stream = topic(spark, tmp_path, message(), message(message_id="m-2"))
    for attempt in ("a", "b"):
        jobs.start_raw_landing(stream, str(tmp_path / "events"), str(tmp_path / attempt), NOW).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "events")).count() == 2


def test_landing_by_hour(spark, tmp_path):
    stream = topic(spark, tmp_path, message())
    jobs.start_json_landing(stream, str(tmp_path / "land"), str(tmp_path / "cp"), NOW).awaitTermination()
    back = spark.read.text(str(tmp_path / "land"))
    assert {"year", "month", "day", "hour"} <= set(back.columns)
    assert json.loads(back.first()["value"])["message_id"] == "m-1"


def test_batch_writer_skips_empty(spark):
    seen = []
    run = jobs.batch_writer(seen.append)
    run(spark.range(0), 0)
    run(spark.range(2), 1)
    assert len(seen) == 1


def test_row_counts_come_with_the_write(spark):
    from mastline.operators import stats

    df, seen = stats.observed(spark.range(7), "rows-written")
    df.write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == 7


@pytest.mark.parametrize("name", ["fact_cells", "bucket_mode", "roll_features", "prediction_summary"])
def test_registered_queries_match_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "customer", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    cols = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = sorted(repr([float(r[i]) if isinstance(r[i], (int, float)) else r[i] for i in at]) for r in cur.fetchall())
    df = entry.queries()[name](spark, sf)
    assert sorted(df.columns) == cols
    got = sorted(repr([float(r[c]) if isinstance(r[c], (int, float)) else r[c] for c in cols]) for r in df.collect())
    assert got == want
