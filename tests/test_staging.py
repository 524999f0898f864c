"""What queries over the driver tables write on their way."""

from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mastline.operators import blocks
from mastline.plans import features, gold
from mastline_queries import catalog, inputs, staging  # noqa: F401
from mastline_queries.registry import SPARK


@pytest.fixture()
def tables(spark, tmp_path):
    """Twelve order lines of three suppliers."""
    lines = [(o, o * 3, o % 3, n, datetime(1995, 1, 2 + o), 10.5) for o in range(6) for n in (1, 2)]
    spark.createDataFrame(
        lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp, l_extendedprice double",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(s, f"S{s}", 0) for s in range(3)], "s_suppkey long, s_name string, s_nationkey long").write.parquet(
        f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, 0)], "n_nationkey long, n_regionkey long").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(0, "R")], "r_regionkey long, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    return str(tmp_path)


def test_a_dimension_writes_no_snapshots(spark, tables):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("*"))
    rows = gold.dim_antenna(staging.silver(spark, tables, "antennas")).collect()
    assert {r.site_id for r in rows} == {"SITE_0", "SITE_1", "SITE_2"} and len(rows) == 9
    assert set(shared.glob("*")) == before


def test_a_question_writes_only_its_own_fact(spark, tables):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("*"))
    star = staging.star(spark, tables)
    assert star["Fact_Alarms"].count() == star["Fact_Alarms"].count()
    assert [p.name.rsplit("-", 1)[0][:16] for p in set(shared.glob("*")) - before] == ["gold-Fact_Alarms"]


def test_cell_tables_are_shuffled_once_by_site(spark, tables):
    for made in (gold.fact_cells, features.hourly_wide):
        df = made(staging.silver(spark, tables, "cells"))
        plan = df._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert moved and not [line for line in moved if "bucket_start" in line or "hour_ts" in line or "_key" in line]


def test_arrays_are_not_worked_out_to_filter_lines(spark, tables):
    for name in ("cells", "radio_units", "batteries", "transport_links"):
        plan = staging.silver(spark, tables, name)._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "Filter" in line and "size(" in line]


def test_readings_of_versions_stay_with_their_site(spark, tables, monkeypatch):
    cuts = []
    monkeypatch.setattr(gold, "range_cut", lambda df, *more: cuts.append(df) or blocks.range_cut(df, *more))
    assert gold.dim_antenna_history(staging.silver(spark, tables, "antennas")).count() >= 9
    plan = cuts[0]._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not [line for line in moved if "antenna_id" in line]


def test_lines_without_a_site_make_no_snapshot(spark, tables, tmp_path):
    other = tmp_path / "nulls"
    lines = spark.read.parquet(f"{tables}/lineitem.parquet")
    lines.unionByName(lines.limit(3).withColumn("l_suppkey", F.lit(None).cast("long"))).write.parquet(f"{other}/lineitem.parquet")
    supplier = spark.read.parquet(f"{tables}/supplier.parquet")
    supplier.unionByName(supplier.limit(1).withColumn("s_suppkey", F.lit(None).cast("long"))).write.parquet(f"{other}/supplier.parquet")
    for name in ("nation", "region"):
        spark.read.parquet(f"{tables}/{name}.parquet").write.parquet(f"{other}/{name}.parquet")
    assert inputs.messages(spark, str(other)).count() == lines.count() == 12


def test_a_question_about_cells_writes_no_cell_fact(spark, tables):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("*"))
    rows = SPARK["sem_avg_sinr_by_site"](spark, tables).collect()
    assert {(r.site_name, r.region) for r in rows} == {("S0", "R"), ("S1", "R"), ("S2", "R")}
    assert [p.name.rsplit("-", 1)[0] for p in set(shared.glob("*")) - before] == ["gold-dim_site"]


def test_partitions_are_written_once(spark, tables):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("*"))
    rows = SPARK["partition_rows"](spark, tables).collect()
    assert len(rows) == 9 and all(r.total >= 1 for r in rows)
    assert [p.name.rsplit("-", 1)[0] for p in set(shared.glob("*")) - before] == ["partitions"]


def test_whole_snapshots_are_read_once_and_not_written(spark, tables):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("*"))
    counts = {name: SPARK[name](spark, tables).count() for name in ("cell_stream", "transport_stream", "derived_alert_summary")}
    assert counts == {"cell_stream": 33, "transport_stream": 22, "derived_alert_summary": 12}  # one snapshot has no components
    assert SPARK["derived_alerts"](spark, tables).count() > 0
    assert set(shared.glob("*")) == before


@pytest.mark.parametrize("name", ["snapshot_files", "incremental_silver"])
def test_landed_snapshots_are_packed_and_leave_no_copy(spark, tables, name):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("*"))
    rows = SPARK[name](spark, tables).collect()
    assert sum(r.messages for r in rows) == (11 if name == "incremental_silver" else 12) and len(rows) == 3  # one has no cells
    made = set(shared.glob("*")) - before
    assert [p.name.rsplit("-", 1)[0] for p in made] == ["incremental" if name == "incremental_silver" else name.replace("_", "-")]
    landed = [p for p in made.pop().glob("landed/**/*") if p.is_file() and p.name.startswith("part-")]
    assert landed and all(p.name.endswith(".json.gz") for p in landed)
