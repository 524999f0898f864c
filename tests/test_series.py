"""Windows, as-of join, gaps and latest state against brute force."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mastline.operators import blocks, latest, slots, stats, timebuckets, timeseries
from mastline.operators.blocks import chunk_of
from mastline.plans import features, training

T0 = dt.datetime(2026, 1, 1)


def series(seed=1, keys=3, n=90):
    rng = random.Random(seed)
    rows = []
    for k in range(keys):
        size = n * 5 if k == 0 else n  # one key holds most rows
        for i in range(size):
            v = None if rng.random() < 0.2 else float(rng.randint(0, 400)) / 4
            rows.append((k, T0 + dt.timedelta(minutes=17 * i), v))
    rows += [(9, T0 + dt.timedelta(hours=i), None) for i in range(4)]
    return pd.DataFrame(rows, columns=["k", "t", "v"])


def expected(pdf):
    g = pdf.sort_values(["k", "t"]).groupby("k")["v"]
    out = pdf.sort_values(["k", "t"]).copy()
    for n in (3, 12):
        out[f"v_roll{n}_mean"] = g.transform(lambda x, n=n: x.rolling(n, min_periods=1).mean())
        out[f"v_roll{n}_std"] = g.transform(lambda x, n=n: x.rolling(n, min_periods=1).std().fillna(0))
        out[f"v_roll{n}_max"] = g.transform(lambda x, n=n: x.rolling(n, min_periods=1).max())
        out[f"v_roll{n}_min"] = g.transform(lambda x, n=n: x.rolling(n, min_periods=1).min())
    for n in (1, 6):
        out[f"v_lag{n}"] = g.transform(lambda x, n=n: x.shift(n).bfill().fillna(x.mean()))
    out["v_delta1"] = g.transform(lambda x: x.diff(1).fillna(0))
    return out.set_index(["k", "t"])


@pytest.mark.parametrize("block,chunk", [(None, None), (12, "hour"), (40, "hour"), (12, None), (40, None)])
def test_features_match_pandas(spark, block, chunk):
    pdf = series()
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    got = timeseries.add_series_features(
        df, ["k"], ["t"], roll=["v"], roll_sizes=(3, 12), lag=["v"], lag_steps=(1, 6), delta=["v"], delta_steps=(1,),
        block_rows=block, chunk=chunk_of("t", chunk) if chunk else None).toPandas().set_index(["k", "t"])
    want = expected(pdf)
    assert len(got) == len(want)
    for c in want.columns:
        pd.testing.assert_series_equal(
            got[c].sort_index().astype("float64"), want[c].sort_index().astype("float64"), check_names=False, atol=1e-9)


def test_blocks_must_hold_the_look_back(spark):
    df = spark.createDataFrame([(1, T0, 1.0)], "k int, t timestamp, v double")
    with pytest.raises(ValueError):
        timeseries.add_series_features(df, ["k"], ["t"], roll=["v"], roll_sizes=(24,), block_rows=5)


def test_tiny_series(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 5.0, 7.0, None])], "k int, t int, v double")
    rows = timeseries.add_series_features(
        df, ["k"], ["t"], roll=["v"], roll_sizes=(3,), lag=["v"], lag_steps=(1,), delta=["v"], delta_steps=(1,)
    ).orderBy("t").collect()
    assert [r["v_roll3_mean"] for r in rows] == [None, 5, 6, 6]
    assert [r["v_lag1"] for r in rows] == [5, 5, 5, 7]
    assert [r["v_delta1"] for r in rows] == [0, 0, 2, 0]


def test_all_features_share_one_shuffle_and_sort(spark):
    wide = spark.createDataFrame([("S", T0)], "site_id string, timestamp timestamp")
    for m in features.METRICS:
        text = m in features.CATEGORIES
        wide = wide.withColumn(f"cell_1_{m}", F.lit("UP" if text else 1.0))
    built = features.build_features(features.wide_to_long(wide, n_cells=1))
    plan = built._jdf.queryExecution().executedPlan().toString()
    # One sort for the backward frames, one descending for the lag fill.
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 2
    assert len(features.align_features(built).columns) == 284 + 3
    assert len(features.Manifest().feature_columns) == 284


@pytest.mark.parametrize("ranges", [None, 1, 23])
def test_asof_join_matches_merge_asof(spark, ranges):
    rng = random.Random(5)
    left = pd.DataFrame([(k, T0 + dt.timedelta(minutes=rng.randint(0, 5000)), i)
                         for i, k in enumerate([rng.choice("aab") for _ in range(300)])], columns=["k", "t", "i"])
    right = pd.DataFrame([(rng.choice("ab"), T0 + dt.timedelta(minutes=m), float(m)) for m in range(300, 5000, 37)],
                         columns=["k", "rt", "w"])
    got = timeseries.asof_join(
        spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", "rt", ["w"], ranges=ranges)
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("rt"), left_on="t", right_on="rt", by="k")
    mine = {r["i"]: r["w"] for r in got.collect()}
    assert len(mine) == 300
    for i, w in zip(want["i"], want["w"]):
        assert mine[i] == (None if pd.isna(w) else w)


def test_sequence_gaps_across_blocks(spark):
    df = spark.createDataFrame([("a", s) for s in (1, 2, 2, 5, 9, 10, 31)] + [("b", 7)], "k string, s long")
    for block in (3, 10, 1000):
        rows = timeseries.sequence_gaps(df, "k", "s", block).orderBy("first_missing").collect()
        assert [(r[1], r[2], r[3]) for r in rows] == [(3, 4, 2), (6, 8, 3), (11, 30, 20)]


def test_latest_snapshot_modes(spark):
    rows = [(1, T0, 1.0, "x"), (1, T0 + dt.timedelta(hours=1), None, "y"), (None, T0, 2.0, "z"), (2, None, 3.0, None),
            (2, T0, 4.0, "w")]
    df = spark.createDataFrame(rows, "k int, ingested_at timestamp, v double, s string")
    per = {r["k"]: r for r in latest.latest_snapshot(df, ["k"]).collect()}
    assert per[1]["v"] == 1.0 and per[1]["s"] == "y" and set(per) == {1, 2}
    assert per[2]["v"] == 3.0 and per[2]["s"] == "w"
    whole = {r["k"]: r for r in latest.latest_snapshot(df, ["k"], mode="whole_row").collect()}
    assert whole[1]["v"] is None and whole[1]["s"] == "y"


def test_last_span_uses_the_data_clock(spark):
    df = spark.createDataFrame([(T0 + dt.timedelta(minutes=m),) for m in (0, 59, 60, 119, 120)], "ingested_at timestamp")
    assert latest.last_span(df).count() == 3
    nothing = df.select(F.lit(None).cast("timestamp").alias("ingested_at"))
    assert latest.last_span(nothing).count() == 5


def test_mode_is_smallest_on_ties_and_skips_nulls(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (1, None), (1, None), (2, None)], "k int, v string")
    got = {r["k"]: r["m"] for r in timebuckets.mode_in_group(df, ["k"], "v", "m").collect()}
    assert got == {1: "a", 2: None}


def test_slot_pivot_drops_surplus_before_the_shuffle(spark):
    df = spark.createDataFrame([("s", f"c{i}", float(i)) for i in range(5)], "g string, c string, v double")
    out = slots.slot_pivot(df, ["g"], "c", 2, {"v{slot}": "v"})
    assert out.first().asDict() == {"g": "s", "v1": 0.0, "v2": 1.0}
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_quantiles_match_numpy(spark):
    rng = random.Random(3)
    pdf = pd.DataFrame([(rng.choice("ab"), float(rng.randint(0, 60))) for _ in range(501)], columns=["g", "v"])
    for width in (None, 7.0):
        got = {r["g"]: r for r in stats.box_stats(spark.createDataFrame(pdf), ["g"], "v", width).collect()}
        for g, part in pdf.groupby("g"):
            for name, q in (("low", 0), ("q1", .25), ("median", .5), ("q3", .75), ("high", 1)):
                assert got[g][name] == pytest.approx(part["v"].quantile(q))


def test_trend_with_constant_x_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 0.0, 1.0), ("b", 1.0, 3.0)], "g string, x double, y double")
    got = {r["g"]: r for r in stats.linear_trend(df, ["g"], "x", "y").collect()}
    assert got["a"]["slope"] is None and got["b"]["slope"] == pytest.approx(2.0) and got["b"]["intercept"] == pytest.approx(1.0)


def test_time_folds_never_split_a_moment(spark):
    df = spark.createDataFrame([(T0 + dt.timedelta(hours=i // 4),) for i in range(240)], "timestamp timestamp")
    rows = training.time_folds(df).groupBy("timestamp").agg(F.count_distinct("fold").alias("n"), F.min("fold").alias("f"))
    assert rows.agg(F.max("n")).first()[0] == 1
    ordered = [r["f"] for r in rows.orderBy("timestamp").collect()]
    assert ordered == sorted(ordered) and set(ordered) == set(range(6))


def test_predict_keeps_history_but_returns_the_target_day(spark):
    rows = [("S", T0 + dt.timedelta(hours=h)) for h in range(30)]
    wide = spark.createDataFrame(rows, "site_id string, timestamp timestamp")
    for m in features.METRICS:
        wide = wide.withColumn(f"cell_1_{m}", F.lit("UP") if m in features.CATEGORIES else F.hour("timestamp") * 1.0)
    score = lambda x: x["prb_utilization_percent_roll24_min"].astype("float64") / 10
    out = training.predict(wide, lambda r: training.score_with_function(r, score), features.Manifest(n_cells=1),
                           target_date="2026-01-02").collect()
    assert len(out) == 6 and {r["cell_id"] for r in out} == {"CELL_1"}


def test_lag_fill_is_linear_and_asof_ignores_null_keys(spark):
    rows = [(1, i, float(i) if i % 3 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "k int, t int, v double")
    for block in (None, 512):
        out = timeseries.add_series_features(df, ["k"], ["t"], lag=["v"], lag_steps=(1,), block_rows=block, chunk=(F.col("t") / 1000).cast("int"))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "unboundedfollowing$()))" not in plan.replace(" ", "").replace("unboundedpreceding$(),unboundedfollowing$()", "").lower()
        got = {r.t: r.v_lag1 for r in out.collect()}
        expect = {i: next(v for _, _, v in rows[max(i - 1, 0):] if v is not None) for i in range(3990)}
        assert {i: got[i] for i in expect} == expect
    left = spark.createDataFrame([(1, 5, "a"), (None, 5, "b"), (1, None, "c")], "k int, t int, id string").withColumn("t", F.timestamp_seconds("t"))
    right = spark.createDataFrame([(1, 4, 70), (None, 4, 77)], "k int, u int, v int").withColumn("u", F.timestamp_seconds("u"))
    out = timeseries.asof_join(left, right, ["k"], "t", "u", ["v"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4
    assert {r.id: r.v for r in out.collect()} == {"a": 70, "b": None, "c": None}


def test_a_key_that_is_hot_in_one_hour_runs_in_many_tasks(spark):
    """A million rows of one key in one hour, many at one instant: no range holds more than its share."""
    n = 1_000_000
    at = F.timestamp_seconds(F.lit(1_780_000_000) + F.col("id") % 3000)
    left = spark.range(n).select(F.lit("hot").alias("k"), at.alias("t"), F.col("id").alias("i"))
    right = spark.range(600).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.lit(1_780_000_000) + F.col("id") * 5).alias("u"), F.col("id").alias("w"))
    ranges = 16
    got = timeseries.asof_join(left, right, ["k"], "t", "u", ["w"], ranges=ranges)
    bad = got.where(~F.col("w").eqNullSafe(F.floor((F.col("i") % 3000) / 5)))
    assert got.count() == n and bad.count() == 0
    cut = blocks.range_cut(left, ["k", "t", "i"], ranges)
    sizes = [r["count"] for r in cut.groupBy(blocks.RANGE).count().collect()]
    assert len(sizes) == ranges and max(sizes) < 3 * n / ranges
    still = left.withColumn("t", F.lit(T0))  # one instant
    sizes = [r["count"] for r in blocks.range_cut(still, ["k", "t", "i"], ranges).groupBy(blocks.RANGE).count().collect()]
    assert len(sizes) == ranges and max(sizes) < 3 * n / ranges


def test_asof_ties_and_nulls(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", None, 3), (None, 5, 4), ("b", 1, 5)], "k string, t int, i int")
    right = spark.createDataFrame([("a", 5, 7, "x"), ("a", 5, 9, "y"), ("a", 5, 8, "z"), (None, 1, 1, "n"), ("b", 2, 1, "late")], "k string, u int, o int, w string")
    for ranges in (1, 7):
        got = {r.i: r.w for r in timeseries.asof_join(left, right, ["k"], "t", "u", ["w"], tie=["o"], ranges=ranges).collect()}
        assert got == {1: "y", 2: "y", 3: None, 4: None, 5: None}
