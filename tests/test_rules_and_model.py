"""Scalar edges, risk bands, joins, semantic layer."""

import pytest
from pyspark.sql import functions as F

from mastline.functions import scalars as S
from mastline.operators import joins, predictions
from mastline.plans import features, semantic


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr("v")).collect()]


@pytest.mark.parametrize("values,expr,want", [
    ([0.2999, 0.30, 0.55, 0.75, float("nan"), None], S.risk_level, ["LOW", "MEDIUM", "HIGH", "CRITICAL", "LOW", "LOW"]),
    ([37.0, 37.1, 40.0, 40.1, None], S.temperature_status, ["OK", "HIGH", "HIGH", "CRITICAL", "OK"]),
    ([80.0, 80.1, None], S.humidity_status, ["OK", "HIGH", "OK"]),
    ([-79.9, -80.0, -95.0, None], S.signal_quality, ["Excellent", "Good", "Poor", "Poor"]),
    ([None, 0.0, 0.1, 2.5, 7.6], S.rain_intensity, ["Heavy", "None", "Light", "Moderate", "Heavy"]),
    ([None, 0.0, 0.1], S.is_raining, [False, False, True]),
])
def test_bands(spark, values, expr, want):
    assert column(spark, values, "double", expr) == want


def test_unknown_rain_can_be_null(spark):
    assert column(spark, [None, 1.0], "double", lambda c: S.rain_intensity(c, None)) == [None, "Light"]


def test_geo_key_of_query_text(spark):
    got = column(spark, ["31.2001,29.9187", "Cairo", "1.0,x", None], "string", S.query_geo_key)
    assert got == ["31.200_29.919", None, None, None]


def test_codes_default(spark):
    assert column(spark, ["UP", "HEALTHY", None], "string", lambda c: S.lookup(c, features.STATUS_CODES, 0)) == [1, 0, 0]
    assert column(spark, ["5G", "6G"], "string", lambda c: S.lookup(c, features.TECHNOLOGY_CODES, 2)) == [3, 2]


def test_label_counts_unknown_as_failure(spark):
    assert column(spark, ["NORMAL", "X", None], "string", lambda c: features.label(c)) == [0, 1, 1]


def test_manifest_round_trip():
    m = features.Manifest(threshold=0.4)
    assert features.Manifest.from_json(m.to_json()) == m


def test_weather_falls_back_to_coordinates(spark):
    ran = spark.createDataFrame(
        [("SITE_001", "C", 31.2001, 29.9187), ("SITE_002", "C", 1.0, 1.0), ("SITE_003", "C", 9.0, 9.0)],
        "site_id string, cell_id string, lat double, lon double")
    blank = {c: None for c in joins.WEATHER_FILL}
    rows = [
        {**blank, "ran_site_id": " ", "location_query": "31.2001,29.9187", "weather_temperature_c": 20.0},
        {**blank, "ran_site_id": "SITE_002", "location_query": "x", "weather_temperature_c": 30.0}]
    kinds = {"weather_temperature_c": "double", "weather_humidity_pct": "int", "weather_rainfall_mm": "double",
             "weather_wind_speed_kmh": "double", "is_raining": "boolean"}
    ddl = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in [*joins.WEATHER_FILL, "location_query"])
    wx = spark.createDataFrame([[r.get(c) for c in [*joins.WEATHER_FILL, "location_query"]] for r in rows], ddl)
    wx = wx.withColumns({"ingested_at": F.current_timestamp(), "weather_latitude": F.lit(None).cast("double"),
                         "weather_longitude": F.lit(None).cast("double")})
    got = {r["site_id"]: r["weather_temperature_c"] for r in joins.join_weather(ran, wx).collect()}
    assert got == {"SITE_001": 20.0, "SITE_002": 30.0, "SITE_003": None}


def test_worst_risk_goes_by_rank(spark):
    df = spark.createDataFrame([("HIGH",), ("CRITICAL",), ("LOW",)], "risk_level string")
    assert df.agg(predictions.worst_risk()).first()[0] == "CRITICAL"


def test_prediction_summary_levels(spark):
    df = spark.createDataFrame([("CELL_1", 1, "HIGH"), ("CELL_1", 0, "LOW"), ("CELL_2", 0, "LOW")],
                               "cell_id string, predicted_failure int, risk_level string")
    got = {(r["scope"], r["label"]): (r["rows"], r["failures"], r["failure_pct"])
           for r in predictions.prediction_summary(df).collect()}
    assert got[("all", "total")] == (3, 1, 33.3) and got[("cell", "CELL_1")] == (2, 1, 50.0)
    assert got[("risk", "LOW")] == (2, 0, 0.0) and len(got) == 5


MODEL = semantic.SemanticModel()


def test_names_resolve_in_both_languages():
    assert MODEL.resolve_measure("sinr") == ("cell_performance", "sinr_db")
    assert MODEL.resolve_measure("معدل انقطاع المكالمات") == ("cell_performance", "call_drop_rate_percent")
    assert MODEL.resolve_dimension("المحافظة", "alarm") == ("site", "region")
    with pytest.raises(semantic.UnknownName):
        MODEL.resolve_measure("colour")


def test_paths_are_many_to_one_only():
    assert [r.right for r in MODEL.path("cell_performance", "site")] == ["site"]
    assert MODEL.path("site", "alarm") is None and MODEL.path("alarm", "cell") is None
    with pytest.raises(semantic.UnknownName):
        MODEL.resolve_dimension("technology", "alarm")


def test_model_size():
    assert len(semantic.TABLES) == 11 and len(semantic.RELATIONSHIPS) == 13
    kinds = [m.agg for t in semantic.TABLES.values() for m in t.measures.values()]
    assert {k: kinds.count(k) for k in set(kinds)} == {"avg": 36, "count_distinct": 7, "sum": 4, "count": 4, "max": 1}


def test_facts_shrink_before_they_meet_a_dimension(spark):
    spec = MODEL.tables["cell_performance"]
    facts = spark.createDataFrame([(k % 4 if k % 7 else None, k % 2, float(k)) for k in range(60)], "RAN_key int, cell_key int, sinr_db double")
    rest = {*spec.dimensions.values(), *[m.column for m in spec.measures.values() if m.column]} - set(facts.columns)
    facts = facts.select("*", *[F.lit(None).cast("double").alias(c) for c in sorted(rest)])
    site = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y")], "site_sk int, region string")
    frames = {spec.source: facts, "dim_site": site}
    joined = facts.join(site, facts.RAN_key == site.site_sk, "left")
    for inner in (False, True):
        out = MODEL.query(frames, ["sinr", "cell_performance.cell_count"], ["site.region"], inner=inner)
        kept = joined.where("site_sk is not null") if inner else joined
        want = kept.groupBy("region").agg(F.avg("sinr_db").alias("v"), F.count_distinct("cell_key").alias("c")).collect()
        assert {(r[0], r[1], r[2]) for r in out.collect()} == {(r.region, r.v, r.c) for r in want}
    plan = MODEL.query(frames, ["sinr"], ["site.region"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate ") == 2 and plan.index("Join ") < plan.rindex("Aggregate ")  # one of them below the join


def test_folds_train_side_by_side_on_one_table(spark):
    from mastline.plans import training

    manifest = features.Manifest()
    signal = (F.col("id") * 37) % 101
    frame = spark.range(400).select(
        F.timestamp_seconds(F.col("id") * 3600).alias("timestamp"), F.when(signal > 60, 1.0).otherwise(0.0).alias("label"),
        *[(signal.cast("float") if c == "prb_utilization_percent" else F.lit(0.0).cast("float")).alias(c) for c in manifest.feature_columns])
    small = training.BoostSettings(max_trees=3, depth=2, min_rows=5, min_final_trees=2, feature_sample=1.0)
    model, folds = training.train(frame, manifest, small, splits=2)
    assert [f["fold"] for f in folds] == [1, 2] and all(f["auc"] > 0.95 for f in folds)
    assert training.top_importances(model, manifest)[0][0] == "prb_utilization_percent"
    assert len(training.importance_rows(spark, model, manifest).collect()) == 30
    scored = training.score_with_model(frame.withColumn("weight", F.lit(1.0)), model)
    assert scored.where((F.col("failure_score") > 0.5) != (F.col("label") == 1)).count() < 20


def test_folds_are_floats_on_disk_and_kept_nowhere_else(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from mastline.plans import training

    manifest = features.Manifest()
    signal = (F.col("id") * 37) % 101
    frame = spark.range(200).select(
        F.timestamp_seconds(F.col("id") * 3600).alias("timestamp"), F.when(signal > 60, 1.0).otherwise(0.0).alias("label"),
        *[(signal.cast("float") if c == "sinr_db" else F.lit(0.1).cast("float")).alias(c) for c in manifest.feature_columns])
    asked = []
    monkeypatch.setattr(training, "scratch_path", lambda spark, label: f"{tmp_path}/{label}")
    monkeypatch.setattr(DataFrame, "persist", lambda self, *a: asked.append(self) or self)
    small = training.BoostSettings(max_trees=1, depth=1, min_rows=5, min_final_trees=1, feature_sample=1.0)
    training.train(frame, manifest, small, splits=1)
    folds = spark.read.parquet(f"{tmp_path}/folds")
    assert not asked and folds.schema["features"].dataType.simpleString() == "array<float>"
    tenth = manifest.feature_columns.index("rsrp_dbm")
    assert folds.count() == 200 and folds.select(F.col("features")[tenth] == F.lit(0.1).cast("float")).distinct().collect() == [(True,)]
