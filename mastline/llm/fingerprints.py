"""Document fingerprints by locally consistent parsing.

A text is cut into phrases by deterministic coin tossing: labels shrink to a
few values while neighbours stay different, and local maxima of the labels
start phrases. A phrase is named by a hash of its symbols; the names are the
symbols of the next level. Where a phrase starts depends on a few symbols
around it only, so equal substrings share their interior phrases at any offset.
The fingerprint is a bottom-k sketch of the phrase names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mastline.llm.tables import cut
from mastline.llm.textarrays import _power_tables, lean, mix64, U64

#: Levels whose names enter the sketch; phrases of level 2 have about 9 bytes, of level 3 about 27.
LEVELS = (2, 3)
SKETCH = 64
#: Neighbouring documents are looked up inside ranges of ids with about so many rows each,
#: and of at most so many ranges; beyond, ranges hold more rows.
RANGE, MAX_RANGES = 256, 4096


def _toss_table(size: int) -> np.ndarray:
    """Next label for each (label, label before): place and value of the lowest differing bit."""
    a, b = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    low = (a ^ b) & -(a ^ b)
    place = np.where(low > 0, np.log2(np.maximum(low, 1)).astype(np.int64), 0)
    return (2 * place + ((a >> place) & 1)).astype(np.uint8).ravel()


_TOSS = _toss_table(128)


def _labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6; neighbours with different symbols get different labels."""
    diff = x.copy()
    diff[1:] ^= x[:-1]
    low = diff & (~diff + U64(1))
    place = np.log2(np.maximum(low, U64(1)).astype(np.float64)).astype(np.uint8)
    label = (2 * place + ((x >> place.astype(U64)) & U64(1)).astype(np.uint8)).astype(np.uint8)
    label[first] = (x[first] & U64(1)).astype(np.uint8)
    for _ in range(3):  # 128 -> 14 -> 8 -> 6 values
        below = np.empty_like(label)
        below[1:] = label[:-1]
        new = _TOSS[label.astype(np.int32) * 128 + np.concatenate((label[:1], below[1:]))]
        new[first] = label[first] & 1
        label = new
    return label


def _names(x: np.ndarray, start: np.ndarray, level: int) -> np.ndarray:
    powers, inverses = _power_tables(len(x) + 1)
    total = np.zeros(len(x) + 1, U64)
    np.cumsum(x * powers[:len(x)], out=total[1:])
    end = np.append(start[1:], len(x))
    return mix64((total[end] - total[start]) * inverses[start] + U64(level * 0xC2B2AE3D27D4EB4F % (1 << 64)) + (end - start).astype(U64))


def _level(x: np.ndarray, off: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of the next level, and its n + 1 text offsets."""
    if not len(x):
        return x, np.zeros(len(off), np.int64)
    edge = np.zeros(len(x) + 1, bool)
    edge[off] = True
    # Runs of one symbol become one symbol, so neighbours differ.
    start = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])) | edge[:-1])
    y = _names(x, start, 2 * level)
    off = np.searchsorted(start, off)
    edge = np.zeros(len(y) + 1, bool)
    edge[off] = True
    label = _labels(y, np.flatnonzero(edge[:-1]))
    peak = np.zeros(len(y), bool)
    peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    peak[off[1:][off[1:] > 0] - 1] = False  # a text's last symbol has no right neighbour
    begin = np.flatnonzero(peak | edge[:-1])
    return _names(y, begin, 2 * level + 1), np.searchsorted(begin, off)


def sketches(texts: list[bytes]) -> list[np.ndarray]:
    """Bottom-k sketch of each text: its smallest distinct names, sorted; an empty text has none."""
    off = np.cumsum([0, *map(len, texts)])
    x = mix64(np.frombuffer(b"".join(texts), np.uint8).astype(U64) + U64(1))
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for level in range(1, max(LEVELS) + 1):
        x, off = _level(x, off, level)
        if level in LEVELS:
            short = (x >> U64(32)).astype(np.uint32)
            for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                found[k].append(np.unique(short[a:b])[:SKETCH])
    return [np.unique(np.concatenate(f))[:SKETCH] for f in found]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimate of the Jaccard similarity of two texts' phrases; two empty texts are alike."""
    both = np.union1d(a, b)[:SKETCH]
    if not len(both):
        return 1.0
    return len(np.intersect1d(both, np.intersect1d(a, b))) / len(both)


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def _edited(text: str, following: str) -> str:
    """The last third replaced by the start of the following document."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


@lean
def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, ids descending, each range's guest (the first row of the next range) last."""
    held: list[tuple] = []
    size = 0

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        # A row's successor in its range; guests have none and are no documents here.
        own = [k for k in range(len(rows)) if not rows[k][1]]
        next_text = {k: rows[k + 1][3] for k in own if k + 1 < len(rows) and rows[k + 1][0] == rows[k][0]}
        edited = [_edited(rows[k][3], next_text.get(k, "")).encode() for k in own if k in next_text]
        ready = [k for k in own if k in next_text]
        plain = sketches([r[3].encode() for r in rows])
        changed = sketches(edited)
        return pa.RecordBatch.from_arrays([
            pa.array([rows[k][2] for k in ready], pa.int64()), pa.array([len(rows[k][3]) for k in ready], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()), pa.array([as_text(plain[k]) for k in ready], pa.string()),
            pa.array([as_text(c) for c in changed], pa.string()),
            pa.array([likeness(plain[k], c) for k, c in zip(ready, changed)], pa.float64()),
            pa.array([likeness(plain[k], plain[k + 1]) for k in ready], pa.float64())],
            names=[f.split()[0] for f in OUT.split(", ")])

    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            for row in zip(*(batch.column(c).slice(lo, 256).to_pylist() for c in range(4))):
                # Of several guests with one id, only the first stands for it.
                if row[1] and held and held[-1][1] and held[-1][0] == row[0]:
                    continue
                held.append(row)
                size += len(row[3])
                if size > 1 << 20:
                    yield flush(held)
                    held, size = held[-1:], 0  # the last row still waits for its successor
    if held:
        yield flush(held)


def _ranged(rows: DataFrame) -> DataFrame:
    """``rows`` with ``part``, the number of the range that ``rank`` lies in."""
    from pyspark.ml.feature import Bucketizer

    parts = min(MAX_RANGES, rows.count() // RANGE + 1)
    cuts = []
    if parts > 1:
        cuts = rows.agg(F.percentile_approx("rank", [k / parts for k in range(1, parts)], 4 * parts).alias("cuts")).first()["cuts"]
    splits = [float("-inf"), *sorted({float(c) for c in cuts}), float("inf")]
    if len(splits) == 2:
        return rows.withColumn("part", F.lit(0))
    return Bucketizer(splits=splits, inputCol="_rank", outputCol="_part").transform(rows.withColumn("_rank", F.col("rank").cast("double"))).withColumn(
        "part", F.col("_part").cast("int")).drop("_rank", "_part")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited_sha256, both fingerprints, and their likeness.

    The edited text replaces the last floor(n_chars / 3) code points by the
    first as many of the next document in descending doc_id (after the last:
    the first). Null texts are empty; a null doc_id ranks below all others.
    Rows that repeat a doc_id follow each other in the order of a hash of their
    text. A lone document is its own next one. Other columns play no part.

    Texts are shuffled once, by ranges of ids that are cut at quantiles, so that ids
    may be dense, sparse or hashed. What a range needs from the next one is a single
    guest; at most ``MAX_RANGES`` cuts reach the driver, and as many guests are
    broadcast.
    """
    lowest = F.lit(-(1 << 62))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = _ranged(rows.withColumn("rank", F.coalesce("doc_id", lowest)))
    tops = cut(rows.groupBy("part").agg(F.max("rank").alias("rank")), "ranges")
    every = Window.partitionBy()
    guests = F.broadcast(tops.select("rank", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(every)).alias("host")))
    own = rows.select("part", F.lit(0).alias("guest"), "doc_id", "text", "rank")
    moved = rows.drop("part").join(guests, "rank").select(F.col("host").alias("part"), F.lit(1).alias("guest"), "doc_id", "text", "rank")
    placed = own.unionByName(moved).withColumn("tie", F.xxhash64("text")).repartition("part").sortWithinPartitions(
        "part", "guest", F.desc("rank"), "tie")
    return placed.select("part", "guest", "doc_id", "text").mapInArrow(_compare, OUT)
