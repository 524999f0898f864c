"""Table, CSV and landing-zone writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_silver(tables: Mapping[str, DataFrame], base: str, load: int | None = None, laid: bool = False) -> None:
    """Write every normalized table, one folder per region value.

    A rebalance brings a region's rows together, so files are few, and splits
    large regions again; ``laid`` says that files hold one region each already,
    and spares ten shuffles. With the number of a ``load``, rows go to that load's
    own folder, which a retry overwrites; without one they are appended.
    """
    for name, frame in tables.items():
        path = f"{base.rstrip('/')}/{name}" + ("" if load is None else f"/load={load}")
        (frame if laid else frame.hint("rebalance", "region")).write.mode("append" if load is None else "overwrite").partitionBy("region").parquet(path)


def write_gold(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    dynamic: bool = False,
    sort_within: Sequence[str] = (),
) -> None:
    """Overwrite a dimension or fact; ``dynamic`` replaces only touched partitions.

    A rebalance brings a partition's rows together, so files are few, and splits
    a date that holds a third of all rows. Sorting inside tasks keeps one open
    file per task.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if partition_by or sort_within:
        df = df.sortWithinPartitions(*partition_by, *sort_within)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if dynamic:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def prediction_rows(predictions: DataFrame) -> DataFrame:
    """Upper-case header and column order of the prediction file."""
    order = ["timestamp", "site_id", "cell_id", "failure_probability", "predicted_failure", "risk_level"]
    return predictions.select(*[F.col(c).alias(c.upper()) for c in order])


def write_predictions(predictions: DataFrame, folder: str) -> None:
    """Header CSV, nulls empty, one folder per day named ``<date>_predictions.csv``.

    Spark writes a folder of part files under that name rather than funnelling
    the day through a single task.
    """
    (
        prediction_rows(predictions)
        .write.mode("overwrite")
        .option("header", "true").option("nullValue", "").option("emptyValue", "")
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(folder)
    )


def hour_partitions(df: DataFrame, ts: str) -> DataFrame:
    """Add zero-padded year/month/day/hour columns for a landing layout."""
    parts = {"year": "yyyy", "month": "MM", "day": "dd", "hour": "HH"}
    return df.withColumns({name: F.date_format(ts, fmt) for name, fmt in parts.items()})


HOUR_LAYOUT = ["year", "month", "day", "hour"]


def parse_windows(text: str) -> list[tuple[int, int]]:
    """"00:00-12:00,12:15-00:00" to minute offsets; an end at or before its
    start runs into the next day."""
    def minutes(clock: str) -> int:
        hours, mins = clock.strip().split(":")
        return int(hours) * 60 + int(mins)

    out = []
    for part in text.split(","):
        start, stop = (minutes(c) for c in part.split("-"))
        out.append((start, stop if stop > start else stop + 24 * 60))
    if not out:
        raise ValueError("at least one window is needed")
    return out


def backfill_chunks(
    df: DataFrame, ts: str, topic: str, windows: str = "00:00-12:00,12:15-00:00",
) -> DataFrame:
    """Assign each row to its day's chunk and derive the chunk's file key.

    Rows outside every window keep ``chunk_start`` null and share the key
    ``<topic>/outside_windows``. A window end is exclusive.
    """
    minute = F.hour(ts) * 60 + F.minute(ts)
    spans = parse_windows(windows)
    start = None
    for lo, hi in spans:
        # A span past midnight also owns the early minutes of the next day.
        here = (minute >= lo) & (minute < min(hi, 1440))
        start = F.when(here, F.lit(lo)) if start is None else start.when(here, F.lit(lo))
        if hi > 1440:
            start = start.when(minute < hi - 1440, F.lit(lo - 1440))
    day = F.date_trunc("day", F.col(ts))
    framed = df.withColumn("_start", start).withColumn(
        "chunk_start", day + F.make_dt_interval(mins=F.col("_start"))
    ).drop("_start")
    clock = F.when(F.minute("chunk_start") == 0, F.date_format("chunk_start", "HH")).otherwise(
        F.date_format("chunk_start", "HHmm"))
    suffix = F.lit("") if len(spans) == 1 else F.concat(F.lit("_"), clock)
    key = F.concat(
        F.lit(f"{topic}/year="), F.date_format("chunk_start", "yyyy"),
        F.lit("/month="), F.date_format("chunk_start", "MM"),
        F.lit("/day="), F.date_format("chunk_start", "dd"),
        F.lit("/hour="), F.date_format("chunk_start", "HH"),
        F.lit(f"/{topic}_"), F.date_format("chunk_start", "yyyyMMdd"), suffix, F.lit(".json"),
    )
    return framed.withColumn("chunk_key", F.coalesce(key, F.lit(f"{topic}/outside_windows")))


OUTSIDE = "_outside_windows"


def landed_folders(spark: SparkSession, path: str, layout: Sequence[str]) -> list[tuple[str, ...]]:
    """Partition values below ``path``, from folder names alone; no file is opened."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "".join(f"/{c}=*" for c in layout))
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return [tuple(part.split("=", 1)[1] for part in s.getPath().toString().split("/")[-len(layout):]) for s in found]


def write_backfill(df: DataFrame, path: str, ts: str, overwrite: bool = False) -> None:
    """Land chunks as JSON by hour; hours already present are kept unless ``overwrite``.

    Rows outside the windows have no hour to go to. They are landed by day of
    ``ts`` below ``path/_outside_windows``, which readers of ``path`` do not see,
    under the same rule. What is present is known from folder names.
    """
    spark = df.sparkSession
    inside = hour_partitions(df.where(F.col("chunk_start").isNotNull()), "chunk_start").drop("chunk_start", "chunk_key")
    outside = df.where(F.col("chunk_start").isNull()).drop("chunk_start", "chunk_key")
    outside = outside.withColumn("day", F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit("unknown")))
    for rows, where, layout in ((inside, path, HOUR_LAYOUT), (outside, f"{path.rstrip('/')}/{OUTSIDE}", ["day"])):
        if overwrite:
            rows.write.partitionBy(*layout).mode("overwrite").option("partitionOverwriteMode", "dynamic").json(where)
            continue
        present = landed_folders(spark, where, layout)
        if present:
            rows = rows.join(spark.createDataFrame(present, ", ".join(f"{c} string" for c in layout)), list(layout), "left_anti")
        rows.write.partitionBy(*layout).mode("append").json(where)
