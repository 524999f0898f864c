"""Maintained states, levels of runs, the key store, and dated versions."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from mastline.operators import latest, state
from mastline.plans import features, gold
from mastline.sources.runs import Folder, RunNumbers, Runs
from mastline.streaming import jobs
from mastline.streaming.keystore import KeyStore

T0 = dt.datetime(2026, 1, 1)
LIVE = "k int, ingested_at timestamp, m string, v double, s string"


def loads(seed=4):
    """Three loads of readings with nulls, late rows, ties and rows without a time or key."""
    rng, out = random.Random(seed), []
    for load in range(3):
        rows = []
        for i in range(60):
            late = rng.random() < 0.2
            at = T0 + dt.timedelta(minutes=100 * (0 if late else load) + rng.randint(0, 90))
            rows.append((rng.choice([1, 2, 3, None]) if i % 9 else 10 + load, None if i % 17 == 5 else at, f"{load}-{i:03d}",
                         None if rng.random() < 0.3 else float(rng.randint(0, 50)), rng.choice(["a", "b", None])))
        out.append(rows)
    return out


# -- latest state ------------------------------------------------------------------
def test_state_equals_the_whole_history(spark, tmp_path):
    kept = state.LatestState(spark, str(tmp_path / "state"), ["k"], tie=["m"])
    log = state.LoadLog(spark, str(tmp_path / "rows"))
    parts = loads()
    keys = 0
    for load, rows in enumerate(parts):
        log.land(spark.createDataFrame(rows, LIVE), load)
        before = keys
        for _ in range(2):  # a retry starts from the same version
            read = kept.update(log.rows(load), load)
            keys = read["keys"]
            # What is read: this load and the state, not the history.
            assert read == {"load": len(rows), "state": before, "keys": kept.read().count()}
        history = spark.createDataFrame([r for p in parts[:load + 1] for r in p], LIVE)
        want = latest.latest_snapshot(history, ["k"], tie=["m"])
        assert sorted(map(str, kept.read().collect())) == sorted(map(str, want.collect()))
    assert kept.versions() == [0, 1, 2]
    kept.update(log.rows(1), 1)  # an old load comes again: its version stays what it was
    early = spark.createDataFrame(parts[0] + parts[1], LIVE)
    assert sorted(map(str, kept.read(1).collect())) == sorted(map(str, latest.latest_snapshot(early, ["k"], tie=["m"]).collect()))


def test_old_versions_go_and_unfinished_ones_do_not_count(spark, tmp_path):
    kept = state.LatestState(spark, str(tmp_path), ["k"], tie=["m"])
    rows = spark.createDataFrame(loads()[0], LIVE)
    for load in range(6):
        kept.update(rows.limit(0) if load else rows, load)
    assert kept.versions() == [2, 3, 4, 5] and kept.read().count() > 0
    Folder(spark, str(tmp_path / "version=5")).remove("_SUCCESS")
    assert kept.versions()[-1] == 4


def test_a_span_is_read_from_the_loads_it_reaches(spark, tmp_path):
    log = state.LoadLog(spark, str(tmp_path))
    rows = [(1, T0 + dt.timedelta(minutes=10 * i), str(i), 1.0, None) for i in range(60)]
    for load in range(6):
        log.land(spark.createDataFrame(rows[10 * load:10 * load + 10] + [(2, None, "n", 1.0, None)], LIVE), load)
    near = log.last_span("1 hour")
    assert {f.split("/load=")[1][0] for f in near.inputFiles()} == {"5"}
    whole = latest.last_span(spark.createDataFrame(rows, LIVE))
    assert sorted(r.m for r in near.collect()) == sorted(r.m for r in whole.collect())
    undated = state.LoadLog(spark, str(tmp_path / "undated"))
    undated.land(spark.createDataFrame([(1, None, "x", 1.0, None)], LIVE), 0)
    assert undated.last_span().count() == 1


def test_features_by_load_equal_those_of_the_series(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for cell in (1, 2):
        for hour in range(70 if cell == 1 else 11):
            if rng.random() < 0.9:
                rows.append(("S", cell, T0 + dt.timedelta(hours=hour), float(rng.randint(0, 400)) / 4))
    base = spark.createDataFrame(rows, "site_id string, cell_id int, timestamp timestamp, v double")
    long = base.select("site_id", "cell_id", "timestamp", *[
        (F.lit("UP") if m in features.CATEGORIES else F.col("v")).alias(m) for m in features.METRICS])
    whole = {(r.cell_id, r.timestamp): r for r in features.build_features(long, backfill=False).collect()}
    carried = state.SeriesState(spark, str(tmp_path), ["site_id", "cell_id"], "timestamp")
    seen = 0
    for load, (a, b) in enumerate([(0, 20), (20, 21), (21, 45), (45, 70)]):
        part = long.where((F.col("timestamp") >= T0 + dt.timedelta(hours=a)) & (F.col("timestamp") < T0 + dt.timedelta(hours=b)))
        for _ in range(2):
            made = carried.advance(part, load, lambda both: features.build_features(both, backfill=False)).collect()
        for r in made:
            seen += 1
            for c, v in r.asDict().items():
                w = whole[r.cell_id, r.timestamp][c]
                assert v == w or abs(v - w) < 1e-9, (c, v, w)
        assert spark.read.parquet(f"{tmp_path}/version={load}").groupBy("cell_id").count().agg(F.max("count")).first()[0] <= 24
    assert seen == len(whole)


# -- levels of runs ------------------------------------------------------------------
def test_a_hundred_batches_leave_few_runs(spark, tmp_path):
    keys, measures, path = ["kind"], {"n": (F.count("*"), F.sum), "top": (F.max("id"), F.max)}, str(tmp_path)
    land = jobs.bucket_writer(keys, measures, path, ts="ts")
    rows = [(k, T0 + dt.timedelta(minutes=k % 40), "ab"[k % 2]) for k in range(300)]
    for batch in range(100):
        land(spark.createDataFrame(rows[3 * batch:3 * batch + 3], "id long, ts timestamp, kind string").coalesce(1), batch)
    jobs.compact_buckets(spark, path, keys, measures)
    runs = Runs(spark, path)
    assert len(runs.visible()) <= 3 * 4 and runs.visible()[0][0] == 0 and runs.visible()[-1][1] == 99
    assert all(a[1] + 1 == b[0] for a, b in zip(runs.visible(), runs.visible()[1:]))
    merged = jobs.merged_buckets(spark, path, keys, measures)
    assert len(merged.inputFiles()) <= 4 * len(runs.visible())
    whole = spark.createDataFrame(rows, "id long, ts timestamp, kind string").groupBy(
        F.window("ts", "15 minutes").start.alias("bucket_start"), "kind").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))


def test_a_failed_merge_is_not_seen_and_comes_again(spark, tmp_path):
    runs = Runs(spark, str(tmp_path), fan=3)
    for n in range(9):
        runs.write(spark.range(n, n + 1).coalesce(1), n)

    def broken(parts, run):
        runs.write(spark.range(99), run)
        Folder(spark, runs.at(run)).remove("_SUCCESS")
        raise OSError("lost")

    with pytest.raises(OSError):
        runs.compact(broken)
    assert runs.visible() == [(n, n) for n in range(9)]
    assert sorted(r.id for r in runs.read("id long").collect()) == list(range(9))

    def merge(parts, run):
        before = runs.read("id long")  # a reader at this moment
        runs.write(runs.read("id long", parts).coalesce(1), run)
        assert sorted(r.id for r in before.collect()) == list(range(9))

    assert runs.compact(merge) == [(0, 2), (3, 5), (6, 8), (0, 8)]
    assert runs.visible() == [(0, 8)] and sorted(r.id for r in runs.read("id long").collect()) == list(range(9))
    runs.vacuum()
    assert runs.complete() == [(0, 8)]
    runs.write(spark.range(5, 6), 5)  # a load that comes again after its merge is covered
    assert runs.visible() == [(0, 8)] and runs.read("id long").count() == 9
    assert Runs(spark, str(tmp_path / "none")).read("id long").collect() == []


def test_numbers_of_loads_that_come_again(spark, tmp_path):
    numbers = RunNumbers(spark, str(tmp_path / "log"))
    assert [numbers.number(t) for t in ("a-0", "a-1", "a-0", "b-0", "a-1")] == [0, 1, 0, 2, 1]


# -- key store -----------------------------------------------------------------------
def md5(k):
    return hashlib.md5(str(k).encode()).hexdigest()


def test_a_batch_opens_only_files_that_may_hold_its_keys(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path), ["id"], buckets=16)
    frame = lambda ks: spark.createDataFrame([(md5(k),) for k in ks], "id string")
    for load in range(3):
        new = store.claim(frame(range(1000 * load, 1000 * load + 1000)), load)
        assert new.count() == 1000
        store.release()
    # Ten keys of the first load among new ones: their files, and few by false alarm.
    old = [7, 70, 700]
    new = store.claim(frame([*old, *range(9000, 9040)]), 3)
    assert new.count() == 40 and not {md5(k) for k in old} & {r.id for r in new.collect()}
    store.release()
    needed = {((0, 0), r.b) for r in frame(old).select(F.pmod(F.xxhash64("id"), F.lit(16)).alias("b")).collect()}
    assert needed <= set(store.opened) and len(store.opened) <= len(needed) + 8 < 3 * 16
    assert store.claim(frame(range(5000, 5005)), 4).count() == 5 and len(store.opened) <= 2
    store.release()


def test_null_keys_and_repeated_loads(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path), ["a", "b"], buckets=4, fan=2)
    frame = lambda rows: spark.createDataFrame(rows, "a string, b int")
    first, second = [("x", 1), ("x", None), (None, None)], [("x", 1), (None, None), (None, 1), ("x", None)]
    for _ in range(2):
        assert store.claim(frame(first), 0).count() == 3
        store.release()
    for _ in range(2):
        assert [tuple(r) for r in store.claim(frame(second), 1).collect()] == [(None, 1)]
        store.release()
    assert store.compact(frame(first), before=2) == [(0, 1)]
    assert [tuple(r) for r in store.claim(frame([("x", None), ("new", 2)]), 2).collect()] == [("new", 2)]
    store.release()


def test_distinct_rows_of_a_stream_of_hashed_ids(spark, tmp_path):
    for part in range(6):
        rows = [(md5(k), k) for k in (*range(50 * part, 50 * part + 50), *range(0, 40, 3))]
        spark.createDataFrame(rows, "id string, k int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, k int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for attempt in ("log", "log", "fresh"):  # the same stream again, then one that lost its checkpoint
        jobs.run_distinct(stream, ["id"], str(tmp_path / "out"), str(tmp_path / attempt), buckets=4)
        assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(300))


# -- dated versions --------------------------------------------------------------------
def brute_history(rows):
    out = {}
    last = {}
    for k, at, seq, m, a in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1], r[2], r[3])):
        last[k, at] = a
    for (k, at), a in sorted(last.items()):
        if k not in out or out[k][-1][1] != a:
            out.setdefault(k, []).append((at, a))
    return {(k, a, at, nxt) for k, v in out.items() for (at, a), nxt in zip(v, [x[0] for x in v[1:]] + [None])}


@pytest.mark.parametrize("ranges", [1, 9])
def test_versions_and_the_facts_of_their_time(spark, ranges):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([T0 + dt.timedelta(minutes=rng.randint(0, 200))] * 9 + [None]), i, f"m{i}",
             rng.choice([1, 1, 1, 2, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, snapshot_time timestamp, sequence_number int, message_id string, tilt int")
    history = gold.dimension_history(df, ["k"], ["tilt"], "sk", ranges=ranges)
    got = history.collect()
    want = brute_history(rows)
    assert {(r.k, r.tilt, r.valid_from, r.valid_to) for r in got} == want and len(got) == len(want) == len({r.sk for r in got})
    assert {r.k for r in got if r.is_current} == {"a", "b"} and sum(r.is_current for r in got) == 2
    fact = spark.createDataFrame([(k, T0 + dt.timedelta(minutes=m), i) for i, (k, m) in enumerate(
        [(k, m) for k in ("a", "b", "z", None) for m in range(-5, 220, 7)])] + [("a", None, 999)], "k string, at timestamp, i int")
    dated = {r.i: r.tilt for r in gold.join_version(fact, history, ["k"], "at", ["tilt"], ranges=ranges).collect()}
    assert len(dated) == fact.count()
    for r in fact.collect():
        valid = [v for k, v, a, b in want if r.at is not None and k == r.k and a <= r.at and (b is None or r.at < b)]
        assert dated[r.i] == (valid[0] if valid else None) and len(valid) <= 1


@pytest.mark.parametrize("ranges", [2, 7])
def test_a_value_may_hold_over_whole_ranges(spark, ranges):
    # One key holds a value over whole ranges; the other changes at every reading.
    rows = [(k, T0 + dt.timedelta(minutes=i), 0, f"m{i}", i % 2 if k == "b" else i // 70) for i in range(200) for k in "ab"]
    df = spark.createDataFrame(rows, "k string, snapshot_time timestamp, sequence_number int, message_id string, tilt int")
    history = gold.dimension_history(df, ["k"], ["tilt"], "sk", ranges=ranges)
    got = history.collect()
    assert {(r.k, r.tilt, r.valid_from, r.valid_to) for r in got} == brute_history(rows) and len(got) == 203


def test_readings_are_compared_once_not_once_a_column(spark):
    rows = spark.createDataFrame(
        [("a", dt.datetime(2026, 1, 1, h), 10 * h if h < 3 else None, "x" if h == 1 else None) for h in range(5)] + [("b", None, 7, None)],
        "k string, ingested_at timestamp, v int, w string")
    newest = latest.newest_by_pattern(rows, ["k"], F.struct(F.col("ingested_at").isNull(), F.col("ingested_at")))
    assert {(r.k, r._row.v, r._row.w) for r in newest.collect()} == {("a", 10, "x"), ("a", 20, None), ("a", None, None), ("b", 7, None)}
    plan = latest.latest_snapshot(rows, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    nearest = [line for line in plan.splitlines() if "Aggregate" in line][-1]
    assert nearest.count("max_by") == 1
    got = {r.k: (r.ingested_at, r.v, r.w) for r in latest.latest_snapshot(rows, ["k"]).collect()}
    assert got == {"a": (dt.datetime(2026, 1, 1, 4), 20, "x"), "b": (None, 7, None)}
