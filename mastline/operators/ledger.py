"""A ledger of runs: rows in, out and quarantined, per table and load.

Counts come with the writes, as observed metrics, so no row is read twice for
them. Rows that a table cannot use go to a folder of their own instead of being
dropped. A load that is repeated replaces its rows and its lines.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

LEDGER = "table string, rows_in long, rows_out long, rows_quarantined long, recorded_at timestamp"


class RunLedger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, tables: Mapping[str, tuple[DataFrame, Column | None]], base: str, load: int) -> None:
        """Write each table to ``base/<table>/load=<load>`` and its line to the
        ledger. A table comes with the condition of its unusable rows (null counts
        as usable); those go to ``base/_quarantine/<table>/load=<load>``."""
        lines = []
        for name, (rows, bad) in tables.items():
            unfit = F.lit(False) if bad is None else F.coalesce(bad, F.lit(False))
            seen = Observation(f"{name}-{load}")
            counted = rows.withColumn("_unfit", unfit).observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("_unfit").alias("unfit"))
            counted.where("not _unfit").drop("_unfit").write.mode("overwrite").parquet(f"{base}/{name}/load={load}")
            total, unfit_rows = seen.get["rows"], seen.get["unfit"]
            if bad is not None:
                rows.where(unfit).write.mode("overwrite").parquet(f"{base}/_quarantine/{name}/load={load}")
            lines.append((name, total, total - unfit_rows, unfit_rows))
        ledger = self.spark.createDataFrame(lines, LEDGER.rsplit(",", 1)[0]).withColumn("recorded_at", F.current_timestamp())
        ledger.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/load={load}")

    def read(self) -> DataFrame:
        """One line per table and load."""
        return self.spark.read.schema(f"{LEDGER}, load int").parquet(self.path)


class StreamCounts(StreamingQueryListener):
    """Observed metrics of streams as (query, batch, metric, values), batch by batch.

    Metrics are named with ``df.observe(name, ...)`` and reach the driver with
    each batch's progress; there is one small row per batch and name.
    """

    def __init__(self):
        self.rows: list[tuple[str, int, str, dict]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows += [(p.name or str(p.id), p.batchId, name, row.asDict()) for name, row in p.observedMetrics.items()]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
