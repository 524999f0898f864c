"""Mixing sources to target weights, on built-in functions only.

Targets come from a table with one row per source; a document is then repeated
floor(rate) times, plus once more with the probability of the fraction,
decided by a hash of seed and id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mastline.llm.tables import WORD, cut

WEIGHTS = (5, 2, 1)
SHARE, LIMIT, SEED = 1.5, 2.0, "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """_source, _null, source_size, target per source of ``sized`` (source, size).

    Sources in code point order, null last, take the weights in turn and share
    ``share`` times all sizes; none gets more than ``limit`` times its own. The
    excess shared out again and again ends at target = min(limit, level *
    weight); the level is the largest one that any set of capped sources, taken
    by limit over weight, leaves to the others.
    """
    total = sized.groupBy(F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_null")).agg(
        F.sum("size").alias("source_size"))
    # One row per source from here on: the windows see the aggregate, never documents.
    place = F.row_number().over(Window.orderBy("_null", "_source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    rows = total.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    order = Window.orderBy(F.col("cap") / F.col("w"), "_null", "_source")
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - capped) / open_weight)
    level = F.max("level").over(everything)
    return rows.select("_source", "_null", "source_size", F.least(F.col("cap"), level * F.col("w")).alias("target"))


def unit_hash(seed: str, key: Column) -> Column:
    """A number in [0, 1) from 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def copies(sized: DataFrame, seed: str = SEED, **targets) -> DataFrame:
    """``sized`` (with doc_id, source, size) plus source_size, target and copies.

    Sources of size 0, and so all their documents, get no copies. Rows that
    repeat a doc_id get the same number. The table of sources is broadcast
    only if its measured size allows; otherwise Spark splits the hot source.
    """
    goal = source_targets(sized, **targets)
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    # The number is null-free, so the join needs plain equality only.
    keyed = sized.withColumn("_source", F.coalesce("source", F.lit(""))).withColumn("_null", F.col("source").isNull())
    extra = F.when(unit_hash(seed, F.col("doc_id")) < rate - F.floor(rate), 1).otherwise(0)
    return keyed.join(goal, ["_source", "_null"]).withColumn("copies", (F.floor(rate) + extra).cast("long")).drop("_source", "_null")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of ``docs``.
    Null texts have size 0. The texts are read once; sizes are written out."""
    sized = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "sizes")
    return copies(sized).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixed corpus: columns of ``docs``, each row as often as its copies say."""
    names = docs.columns
    sized = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), "doc_id",
                        F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    taken = copies(sized, seed).where("copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(
        *(F.col("row").getField(c).alias(c) for c in names))
