"""Keys seen so far, in hash buckets, with a Bloom filter in front of every file.

A load's keys go to one file per bucket. A batch probes the filters first, which
are small, and opens only the files that may hold one of its keys: with hashed
ids too, whose smallest and largest value say nothing. A filter is a table of
64-bit words; a key sets four bits of one word, so a probe is one equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mastline.sources.runs import Folder, Run, Runs

BITS_PER_KEY = 12
FILTER = "_bucket int, word long, bits long"


def _mask(h: Column) -> Column:
    """Four bits of a word, from 24 bits of a second hash."""
    mixed = F.xxhash64(h, F.lit(2))
    places = [F.shiftrightunsigned(mixed, 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int") for k in range(4)]
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), place) for place in places]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


class KeyStore:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64, fan: int = 4):
        self.spark, self.keys, self.buckets = spark, list(keys), buckets
        self.runs, self.filters = Runs(spark, f"{path}/keys", fan), f"{path}/filters"
        #: (run, bucket) of the files that the last batch opened.
        self.opened: list[tuple[Run, int]] = []

    # -- filters ---------------------------------------------------------------------
    def _words(self, run: Run) -> int:
        """Words of each of a run's filters, as its folder says."""
        return next(int(n[6:]) for n in Folder(self.spark, f"{self.filters}/run={run[0]}-{run[1]}").names() if n.startswith("words="))

    def _word(self, words: Column) -> Column:
        return F.pmod(F.xxhash64("_h", F.lit(1)), words)

    def _write(self, keys: DataFrame, run: Run) -> None:
        """Filters first: a run counts when its keys are there, and then it has both."""
        words = max(1, -(-keys.count() * BITS_PER_KEY // 64 // self.buckets))
        rows = keys.select("_bucket", self._word(F.lit(words)).alias("word"), _mask(F.col("_h")).alias("bits")).groupBy("_bucket", "word").agg(
            F.bit_or("bits").alias("bits"))
        folder = f"{self.filters}/run={run[0]}-{run[1]}"
        Folder(self.spark, self.filters).remove(f"run={run[0]}-{run[1]}")
        rows.write.parquet(f"{folder}/words={words}")
        self.runs.write(keys.hint("rebalance", "_bucket"), run, ["_bucket"])

    def _candidates(self, hashed: DataFrame, runs: list[Run]) -> list[tuple[Run, int]]:
        """Files whose filter may hold a key of the batch: at most one per run and bucket."""
        sized = [(f"{r[0]}-{r[1]}", self._words(r)) for r in runs]
        probes = hashed.select("_bucket", "_h", F.explode(F.array(*(F.struct(F.lit(r).alias("run"), F.lit(w).cast("long").alias("words")) for r, w in sized))).alias("_r"))
        probes = probes.select("_bucket", "_r.run", self._word(F.col("_r.words")).alias("word"), _mask(F.col("_h")).alias("mask"))
        tables = [self.spark.read.schema(FILTER).parquet(f"{self.filters}/run={r}/words={w}").withColumn("run", F.lit(r)) for r, w in sized]
        may = probes.join(reduce(DataFrame.unionByName, tables), ["run", "_bucket", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
        found = [(tuple(map(int, r.run.split("-"))), r["_bucket"]) for r in may.select("run", "_bucket").distinct().collect()]
        return sorted(found)

    # -- batches ---------------------------------------------------------------------
    def claim(self, fresh: DataFrame, number: int) -> DataFrame:
        """The rows of load ``number`` whose key no earlier load has; their keys are
        stored. ``fresh`` has each key once; null parts of a key are values. A load
        that comes again gets the same rows, since it sees earlier loads only."""
        h = F.xxhash64(*self.keys)
        hashed = fresh.withColumn("_h", h).withColumn("_bucket", F.pmod(h, F.lit(self.buckets)).cast("int"))
        runs = self.runs.visible(before=number)
        self.opened = self._candidates(hashed, runs) if runs else []
        out = hashed
        if self.opened:
            known = [self.spark.read.schema(self._schema(fresh)).parquet(f"{self.runs.at(r)}/_bucket={b}") for r, b in self.opened]
            seen = reduce(DataFrame.unionByName, known).withColumnsRenamed({k: f"_seen_{i}" for i, k in enumerate(self.keys)} | {"_h": "_seen_h"})
            same = F.col("_h") == F.col("_seen_h")
            for i, k in enumerate(self.keys):
                same &= F.col(f"`{k}`").eqNullSafe(F.col(f"_seen_{i}"))
            out = hashed.join(seen, same, "left_anti")
        out = out.persist()
        try:
            self._write(out.select("_bucket", "_h", *self.keys), (number, number))
            return out.drop("_h", "_bucket")
        finally:
            self._held = out  # still read by the caller; ``release`` lets it go

    def release(self) -> None:
        self._held.unpersist()

    def _schema(self, df: DataFrame) -> T.StructType:
        return T.StructType([T.StructField("_h", T.LongType()), *(df.schema[k] for k in self.keys)])

    def compact(self, like: DataFrame, before: int | None = None) -> list[Run]:
        """Merge files of one size; the keys of two loads never meet, so a merge is a union."""
        schema = T.StructType([*self._schema(like).fields, T.StructField("_bucket", T.IntegerType())])

        def merge(parts: list[Run], run: Run) -> None:
            self._write(self.runs.read(schema, parts).select("_bucket", "_h", *self.keys), run)

        return self.runs.compact(merge, before)
