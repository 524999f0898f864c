"""Nothing is lost: late stream rows, components beyond the slots, null times; and no name is guessed."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mastline.operators import slots, stats
from mastline.plans import features, semantic, training
from mastline.streaming import jobs

T0 = dt.datetime(2026, 1, 1)


@pytest.fixture()
def out_of_order(spark, tmp_path):
    """Six files, newest first, each with rows of all keys and some repeats."""
    rows = [(k, T0 + dt.timedelta(minutes=7 * k), "abc"[k % 3]) for k in range(120)]
    for part in range(6):
        own = rows[100 - 20 * part:120 - 20 * part] + rows[:3]
        spark.createDataFrame(own, "id long, ts timestamp, kind string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), rows


def test_distinct_rows_survive_lateness(spark, tmp_path, out_of_order):
    stream, rows = out_of_order
    jobs.run_distinct(stream, ["id"], str(tmp_path / "out"), str(tmp_path / "log"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [r[0] for r in rows]


def test_buckets_are_complete(spark, tmp_path, out_of_order):
    stream, _ = out_of_order
    measures = {"n": (F.count("*"), F.sum), "top": (F.max("id"), F.max)}
    jobs.run_bucket_partials(stream, ["kind"], measures, str(tmp_path / "out"), str(tmp_path / "log"), ts="ts")
    got = jobs.merged_buckets(spark, str(tmp_path / "out"), ["kind"], measures)
    whole = spark.read.parquet(str(tmp_path / "in")).groupBy(F.window("ts", "15 minutes").start.alias("bucket_start"), "kind").agg(
        F.count("*").alias("n"), F.max("id").alias("top"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def test_components_beyond_the_slots_are_kept(spark):
    df = spark.createDataFrame([("s", f"c{k}", float(k)) for k in range(5)], "site string, cell string, v double")
    wide = slots.slot_pivot(df, ["site"], "cell", 3, {"v{slot}": "v"}, "surplus").first()
    rest = slots.surplus_rows(df, ["site"], "cell", 3).collect()
    assert (wide.v1, wide.v3, wide.surplus) == (0.0, 2.0, 2) and sorted(r.cell for r in rest) == ["c3", "c4"]


def test_every_cell_and_null_hour_reaches_the_features(spark):
    rows = spark.range(5).select(F.lit("S").alias("site_id"), F.concat(F.lit("C"), "id").alias("cell_id"), F.lit(None).cast("timestamp").alias("hour_ts"))
    hourly = rows.withColumns({m: F.lit("UP") if m in features.CATEGORIES else F.lit(1.0) for m in features.METRICS})
    wide = features.widen(hourly)
    assert wide.first().cell_surplus == 2
    long = features.all_cells(wide, features.surplus_cells(hourly))
    assert sorted(r.cell_id for r in long.collect()) == [1, 2, 3, 4, 5]
    assert features.build_features(long).count() == 5


def test_every_cell_is_trained_on_and_predicted(spark):
    rows = spark.range(5).select(F.lit("S").alias("site_id"), F.concat(F.lit("C"), "id").alias("cell_id"), F.lit(T0).alias("hour_ts"))
    hourly = rows.withColumns({m: F.lit("UP") if m in features.CATEGORIES else F.lit(1.0) for m in features.METRICS})
    wide, surplus = features.widen(hourly), features.surplus_cells(hourly)
    got = training.predict(wide, lambda df: df.withColumn("failure_score", F.lit(0.75)), surplus=surplus).collect()
    assert sorted(r.cell_id for r in got) == [f"CELL_{k}" for k in range(1, 6)]
    for name, value in (("NORMAL", 0.0), ("CONGESTED", 1.0)):
        frame = training.training_frame(wide.withColumn("scenario_label", F.lit(name)), surplus=surplus).collect()
        assert sorted((r.key_cell_id, r.label) for r in frame) == [(k, value) for k in range(1, 6)]


def test_curves_folds_and_quantiles_are_exact(spark):
    rng = random.Random(3)
    rows = [(rng.random() ** 4, rng.randint(0, 1), T0 + dt.timedelta(hours=rng.randint(0, 900))) for _ in range(500)]
    df = spark.createDataFrame(rows, "probability double, label int, timestamp timestamp")
    pos, neg = [p for p, y, _ in rows if y], [p for p, y, _ in rows if not y]
    auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
    assert training.area_metrics(df, "probability").first().auc == pytest.approx(auc, abs=1e-12)
    assert training.curve_points(df, "probability").count() == len({p for p, _, _ in rows})
    times = sorted(t for _, _, t in rows)
    cuts = [times[-(-len(rows) * i // 6) - 1] for i in range(1, 6)]
    expect = sorted((t, sum(c < t for c in cuts)) for t in times)
    assert sorted((r.timestamp, r.fold) for r in training.time_folds(df).collect()) == expect
    got = stats.quantiles(df, ["label"], "probability", {"q": 0.3}).collect()
    for r in got:
        v = sorted(p for p, y, _ in rows if y == r.label)
        k = (len(v) - 1) * 0.3
        assert r.q == pytest.approx(v[int(k)] + (v[int(k) + 1] - v[int(k)]) * (k - int(k)))


def test_every_business_name_resolves():
    model = semantic.SemanticModel()
    for full, names in semantic.SYNONYMS.items():
        for name in names:
            assert full in model.candidates(name), (full, name)
    for table, spec in model.tables.items():
        for logical in [*spec.dimensions, *spec.measures]:
            assert f"{table}.{logical}" in model.candidates(logical)


def test_ambiguous_names_are_errors():
    model = semantic.SemanticModel()
    with pytest.raises(semantic.UnknownName, match="ambiguous"):
        model.resolve_measure("snapshot_count")
    assert model.resolve_measure("snapshot_count", by=["power"]) == ("equipment_health", "snapshot_count")
    assert model.resolve_measure("records", tables=["cell_performance"]) == ("cell_performance", "snapshot_count")
    assert model.resolve_dimension("status", "cell_performance") == ("cell_performance", "cell_status")
    assert model.resolve_dimension("الازدحام", "cell_performance") == ("cell_performance", "congestion_flag")
    with pytest.raises(semantic.UnknownName):
        model.resolve_measure("no such thing")
