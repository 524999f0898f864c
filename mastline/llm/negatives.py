"""Hard negatives of anchor vectors from a table in blocks with zone maps.

Candidates are written in the order of a Hilbert curve and cut into blocks; the
first row of a block carries its zone map, the least and greatest entry of every
dimension. For an anchor, interval arithmetic turns a zone map into bounds of all
scores in the block, so that only blocks that can hold rows of one of the
anchor's score windows are read for it. Anchors that are near on the curve form a
part; the blocks a part needs stream past it once, and each anchor keeps its best
rows so far, which rules out more of the blocks to come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mastline.llm.tables import cut
from mastline.llm.textarrays import lean
from mastline.llm.vectors import dimension, pack, rows_of, unpack, whole

POSITIVES, NEGATIVES = 5, 10
ANCHOR_EVERY, MOVED_EVERY, LABELS = 100, 7, 10
LOWEST, HIGHEST = 30, 90  # percent of the positive's score
#: Rows of a block, anchors of a part (bounds a task's memory), anchors scored at once.
BLOCK_ROWS, PART_ANCHORS, SLICE = 4096, 32_768, 64
#: The curve runs through this many dimensions of largest variance, with 2**BITS cells each.
CURVE_DIMS, BITS = 15, 4
#: Rows that are worth a task of their own, and rows of a build partition.
RANGE_ROWS, BUILD_ROWS = 1 << 14, 1 << 18
FAR = 1 << 62


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of whole numbers below 2**bits."""
    x = cells.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        q, p = 1 << level, (1 << level) - 1
        for i in range(len(x)):
            swap = np.where(x[i] & q, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(x[i] & q, p, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(len(x)):
            key = key << 1 | (x[i] >> level) & 1
    return key


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows, in the narrowest type that holds them."""
    reach = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    kind = np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64
    return a.astype(kind) @ b.astype(kind).T


def score_bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that a row between ``low`` and ``high`` can have, per anchor and zone.
    Bounds give way by more than a rounding error."""
    up, down = np.maximum(a, 0).astype(float), np.minimum(a, 0).astype(float)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    return least - 1e-12 * np.abs(least), most + 1e-12 * np.abs(most)


# -- the block table ---------------------------------------------------------------
def numbered(rows: DataFrame, dim: int, bound: int) -> DataFrame:
    """(vec_id, label, x, key) of the rows that take part; x in bytes, key on the curve."""
    @lean
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, np.zeros(dim), np.zeros(dim)
        for batch in rows_of(batches, BLOCK_ROWS):
            _, x = whole(batch.column(0), dim, bound)
            n, s, ss = n + len(x), s + x.sum(axis=0, dtype=float), ss + (x.astype(float) ** 2).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(np.full(dim, n)), pa.array(s), pa.array(ss)], names=["i", "n", "s", "ss"])

    found = rows.select("embedding").mapInArrow(moments, "i long, n long, s double, ss double").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).orderBy("i").collect()
    mean = np.array([r.s / r.n for r in found])
    spread = np.sqrt(np.maximum(np.array([r.ss / r.n for r in found]) - mean ** 2, 0))
    dims = np.argsort(-spread, kind="stable")[:CURVE_DIMS]
    cell = np.maximum(4 * spread[dims] / (1 << BITS), 1e-9)  # two deviations to either side

    @lean
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, BLOCK_ROWS):
            at, x = whole(batch.column(2), dim, bound)
            cells = np.clip(np.floor((x[:, dims] - mean[dims]) / cell) + (1 << BITS - 1), 0, (1 << BITS) - 1)
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pack(x), pa.array(hilbert_key(cells))],
                                             names=["vec_id", "label", "x", "key"])

    return rows.mapInArrow(keyed, "vec_id long, label long, x binary, key long")


BLOCKS = ("block long, vec_id long, label long, x binary, candidate boolean, anchor boolean, floor long, low binary, high binary, labels array<long>")


def _build(batches: Iterator[pa.RecordBatch], dim: int, positives: int, alike: int, size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows that come in the order of the curve, then of vec_id.

    Repeated rows are one. Of rows alike in vector and label, a block needs the
    first ``alike`` only: all have the same score for any anchor, and the smaller
    vec_id comes first. An anchor's ``floor`` is the score of its last positive
    among its own block's rows: the true one is no lower.
    """
    first_block = TaskContext.get().partitionId() << 32
    rows: list[tuple] = []
    seen: dict[tuple, int] = {}
    before, n_kept, n_blocks = None, 0, 0

    def block() -> pa.RecordBatch:
        ids, labels, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), unpack(pa.array([r[2] for r in rows], pa.binary()), dim)
        keep, anchor = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
        floor: list[int | None] = [None] * len(rows)
        for lo in range(0, int(anchor.sum()), SLICE):
            at = np.flatnonzero(anchor)[lo:lo + SLICE]
            score = product(x[at], x[keep]).astype(np.int64)
            score[(labels[at][:, None] != labels[keep]) | (ids[at][:, None] == ids[keep])] = -FAR
            if score.shape[1] >= positives:
                last = np.partition(score, -positives, axis=1)[:, -positives]
                for k, v in zip(at.tolist(), last.tolist()):
                    floor[k] = v if v > -FAR else None
        zone = [None] * (len(rows) - 1)
        some = bool(keep.any())
        low, high = ((x[keep].min(axis=0), x[keep].max(axis=0)) if some else (np.ones(dim, np.int64), np.zeros(dim, np.int64)))
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(rows), first_block + n_blocks)), pa.array(ids), pa.array(labels), pa.array([r[2] for r in rows], pa.binary()),
            pa.array(keep), pa.array(anchor), pa.array(floor, pa.int64()), pa.array([low.astype("<i8").tobytes(), *zone], pa.binary()),
            pa.array([high.astype("<i8").tobytes(), *zone], pa.binary()), pa.array([np.unique(labels[keep]), *zone], pa.list_(pa.int64()))],
            names=[f.split()[0] for f in BLOCKS.split(", ")])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if row == before:
                continue
            before = row
            times = seen.get(row[1:], 0)
            seen[row[1:]] = times + 1
            keep, anchor = times < alike, row[0] % ANCHOR_EVERY == 0
            if keep or anchor:
                rows.append((*row, keep, anchor))
                n_kept += keep
            if n_kept == size or len(rows) == 2 * size:
                yield block()
                rows, seen, n_kept, n_blocks = [], {}, 0, n_blocks + 1
    if rows:
        yield block()


def blocks(rows: DataFrame, dim: int, bound: int, positives: int = POSITIVES, negatives: int = NEGATIVES, size: int = BLOCK_ROWS) -> DataFrame:
    """The block table, written once; equal keys are dealt by vec_id, so a vector
    that a third of all rows have fills many partitions."""
    keyed = numbered(rows, dim, bound)
    partitions = max(1, -(-rows.count() // BUILD_ROWS))
    ordered = keyed.repartitionByRange(partitions, "key", "vec_id").sortWithinPartitions("key", "vec_id", "label", "x").drop("key")
    return cut(ordered.mapInArrow(lean(lambda b: _build(b, dim, positives, max(negatives, positives + 1), size)), BLOCKS), "blocks")


# -- anchors meet zones and blocks -----------------------------------------------------
class Held:
    """The anchors of a part: entries, labels and score windows, padded by windows that nothing meets."""

    def __init__(self, table: pa.Table, dim: int, same: bool):
        self.id, self.label = (table.column(c).to_numpy() for c in ("vec_id", "label"))
        self.x, self.same = unpack(table.column("x"), dim), same
        lows, highs = table.column("low").to_pylist(), table.column("high").to_pylist()
        width = max(map(len, lows))
        self.low, self.high = np.ones((len(lows), width), np.int64), np.zeros((len(lows), width), np.int64)
        for k, (a, b) in enumerate(zip(lows, highs)):
            self.low[k, :len(a)], self.high[k, :len(b)] = a, b


class Needs:
    """Which zones hold rows that an anchor's windows may ask for."""

    def __init__(self, held: Held, unit: int, ranges: int):
        self.held, self.part, self.found = held, unit // ranges, []

    def feed(self, batch: pa.RecordBatch) -> None:
        held, dim = self.held, self.held.x.shape[1]
        for lo in range(0, batch.num_rows, 256):
            zones = batch.slice(lo, 256)
            low, high = unpack(zones.column("zone_low"), dim), unpack(zones.column("zone_high"), dim)
            labels = [np.array(v) for v in zones.column("labels").to_pylist()]
            every = np.unique(held.label)
            has = np.array([np.isin(every, v) if held.same else (len(v) > 1) | ((len(v) == 1) & ~np.isin(every, v)) for v in labels])
            need = np.zeros(zones.num_rows, bool)
            for k in range(0, len(held.id), SLICE):
                least, most = score_bounds(held.x[k:k + SLICE], low, high)
                meets = has[:, np.searchsorted(every, held.label[k:k + SLICE])].T
                hit = np.zeros_like(meets)
                for a, b in zip(held.low[k:k + SLICE].T, held.high[k:k + SLICE].T):
                    hit |= (most >= a[:, None]) & (least <= b[:, None]) & (a <= b)[:, None]
                need |= (hit & meets).any(axis=0)
            self.found.append(zones.column("block").to_numpy()[need])

    def finish(self) -> pa.RecordBatch:
        found = np.concatenate(self.found)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), self.part)), pa.array(found)], names=["part", "block"])


class Best:
    """The first ``keep`` rows of every window, over the blocks that stream past."""

    def __init__(self, held: Held, keep: int):
        self.held, self.keep = held, keep
        self.bar = held.low.copy()  # a row of a lower score is not among the first
        shape = (*held.low.shape, keep)
        self.score, self.row, self.filled = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, bool)
        self.wait: list[pa.RecordBatch] = []

    def feed(self, batch: pa.RecordBatch) -> None:
        block = batch.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for a, b in zip(edges, edges[1:]):
            if self.wait and self.wait[0].column("block")[0].as_py() != int(block[a]):
                self.flush()
            self.wait.append(batch.slice(a, b - a))

    def flush(self) -> None:
        held, rows = self.held, pa.Table.from_batches(self.wait)
        self.wait = []
        x, ids, labels = unpack(rows.column("x"), held.x.shape[1]), rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        least, most = score_bounds(held.x, x.min(axis=0)[None], x.max(axis=0)[None])
        open_ = np.flatnonzero(((most >= self.bar) & (least <= held.high) & (self.bar <= held.high)).any(axis=1))
        for lo in range(0, len(open_), SLICE):
            at = open_[lo:lo + SLICE]
            score = product(held.x[at], x)
            meets = (held.label[at][:, None] == labels) == held.same
            meets &= held.id[at][:, None] != ids
            hits = []
            for w in range(held.low.shape[1]):
                # Bounds beyond the scores' type are beyond all scores too.
                a, c = np.nonzero(meets & (score >= self.bar[at, w].astype(score.dtype)[:, None]) & (score <= held.high[at, w].astype(score.dtype)[:, None]))
                hits.append((a * held.low.shape[1] + w, score[a, c].astype(np.int64), ids[c]))
            self.merge(at, *(np.concatenate(h) for h in zip(*hits)))

    def merge(self, at: np.ndarray, place: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        width, keep = self.held.low.shape[1], self.keep
        some = np.unique(place)
        if not len(some):
            return
        anchor, window = at[some // width], some % width
        old = self.filled[anchor, window]
        place = np.concatenate((place, np.repeat(some, old.sum(axis=1))))
        score = np.concatenate((score, self.score[anchor, window][old]))
        row = np.concatenate((row, self.row[anchor, window][old]))
        order = np.lexsort((row, -score, place))
        place, score, row = place[order], score[order], row[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        place, score, row, rank = (v[rank < keep] for v in (place, score, row, rank))
        anchor_of, window_of = at[place // width], place % width
        self.score[anchor_of, window_of, rank], self.row[anchor_of, window_of, rank], self.filled[anchor_of, window_of, rank] = score, row, True
        full = rank == keep - 1
        self.bar[anchor_of[full], window_of[full]] = np.maximum(self.bar[anchor_of[full], window_of[full]], score[full])

    def finish(self) -> pa.RecordBatch:
        if self.wait:
            self.flush()
        a, w, r = np.nonzero(self.filled)
        return pa.RecordBatch.from_arrays([pa.array(self.held.id[a]), pa.array(w.astype(np.int32)), pa.array(self.row[a, w, r]), pa.array(self.score[a, w, r])],
                                          names=["anchor_id", "window", "row_id", "score"])


@lean
def _meet(batches: Iterator[pa.RecordBatch], dim: int, same: bool, make: Callable) -> Iterator[pa.RecordBatch]:
    """Rows come by unit: its anchors first (kind 0), then what streams past them (kind 1)."""
    unit, held, state = None, [], None
    for batch in batches:
        units, kinds = batch.column("unit").to_numpy(), batch.column("kind").to_numpy()
        edges = [0, *(np.flatnonzero((units[1:] != units[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(units)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if units[a] != unit:
                if state is not None:
                    yield state.finish()
                unit, held, state = int(units[a]), [], None
            if kinds[a] == 0:
                held.append(batch.slice(a, b - a))
            elif held:
                if state is None:
                    state = make(Held(pa.Table.from_batches(held), dim, same), unit)
                state.feed(batch.slice(a, b - a))
    if state is not None:
        yield state.finish()


def _stream(anchors: DataFrame, stream: DataFrame, units: int, ranges: int, dim: int, same: bool, make: Callable, schema: str) -> DataFrame:
    """Every anchor goes to all ranges of its part; ``stream`` rows have their part and block."""
    left = anchors.withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1)))).withColumn("unit", F.col("part") * ranges + F.col("unit"))
    right = stream.withColumn("unit", F.col("part") * ranges + F.pmod(F.xxhash64("block"), F.lit(ranges)))
    both = left.withColumn("kind", F.lit(0)).unionByName(right.withColumn("kind", F.lit(1)), allowMissingColumns=True).drop("part")
    dealt = both.repartition(min(2 * units, 20_000), "unit").sortWithinPartitions("unit", "kind", "block")
    return dealt.mapInArrow(lambda b: _meet(b, dim, same, make), schema)


def needed(table: DataFrame, anchors: DataFrame, parts: int, rows: int, dim: int, same: bool) -> DataFrame:
    """(part, block): the blocks that the windows of a part's anchors must read; of the block table only the zone maps are read."""
    zones = table.where("low is not null").select("block", F.col("low").alias("zone_low"), F.col("high").alias("zone_high"), "labels").where(F.size("labels") > 0)
    ranges = max(1, min(-(-rows // (RANGE_ROWS * 64)), 2 * table.sparkSession.sparkContext.defaultParallelism))
    dealt = zones.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return _stream(anchors, dealt, parts * ranges, ranges, dim, same, lambda held, unit: Needs(held, unit, ranges), "part long, block long")


def first_rows(table: DataFrame, anchors: DataFrame, parts: int, rows: int, dim: int, same: bool, keep: int) -> DataFrame:
    """(anchor_id, window, row_id, score, rank): the first ``keep`` rows of each anchor's windows
    among the rows of the same label (or of all others), higher scores first, then smaller ids."""
    needs = cut(needed(table, anchors, parts, rows, dim, same), "needs")
    ranges = max(1, min(-(-rows // RANGE_ROWS), 2 * table.sparkSession.sparkContext.defaultParallelism))
    read = table.where("candidate").select("block", "vec_id", "label", "x").join(needs, "block")
    found = _stream(anchors, read, parts * ranges, ranges, dim, same, lambda held, unit: Best(held, keep), "anchor_id long, window int, row_id long, score long")
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def mine(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by 100. A positive is one of an
    anchor's first rows of its label; a negative, one of the first rows of other
    labels that score between 30 and 90 percent of the positive. Higher inner
    products come first, ties by smaller vec_id.

    Rows with a null vec_id, label, vector, or a null or non-finite entry take no
    part, nor do vectors of another length than the most common one. Entries
    become floor(256 * x), held within a bound that keeps 90 times a score within
    64 bits (beyond 100,000 for 64 dimensions). Repeated rows are one row; of
    different rows with one vec_id, the first by label and vector is the anchor,
    all are candidates, and none is a positive or negative of its own id. Other
    columns play no part, whatever their names.
    """
    label = F.col("label").cast("long")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"),
                       F.when(F.col("vec_id") % MOVED_EVERY == 0, (label + 1) % LABELS).otherwise(label).alias("label"),
                       F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and label is not null")
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    dim = dimension(rows)
    if not dim:
        return rows.sparkSession.createDataFrame([], out)
    table = blocks(rows, dim, isqrt((1 << 56) // dim), positives, negatives, block_rows)
    n = table.where("candidate").count()
    anchors = table.where("anchor").groupBy("vec_id").agg(F.min_by(F.struct("label", "x", "block", "floor"), F.struct("label", "x")).alias("a")).select("vec_id", "a.*")
    total = anchors.agg(F.count("*"), F.max(F.shiftright("block", 32))).first()
    if not total[0]:
        return rows.sparkSession.createDataFrame([], out)
    # Parts follow the curve; a part that many anchors share is dealt by id.
    coarse, last = -(-total[0] // PART_ANCHORS), total[1] + 1
    anchors = anchors.withColumn("coarse", F.expr(f"cast(shiftright(block, 32) * {coarse} div {last} as long)"))
    fine = -(-anchors.groupBy("coarse").count().agg(F.max("count")).first()[0] // PART_ANCHORS)
    anchors = cut(anchors.withColumn("part", F.col("coarse") * fine + F.pmod(F.xxhash64("vec_id"), F.lit(fine))), "anchors")
    parts = coarse * fine

    unbounded = F.array(F.coalesce("floor", F.lit(-FAR)))
    first = anchors.select("part", "vec_id", "label", "x", unbounded.alias("low"), F.array(F.lit(FAR)).alias("high"))
    found = cut(first_rows(table, first, parts, n, dim, True, positives).select(
        "anchor_id", F.col("rank").alias("window"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    windows = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("window", "positive_score"))).alias("p"))
    s = "v.positive_score"
    second = anchors.join(windows, "vec_id").select(
        "part", "vec_id", "label", "x", F.expr(f"transform(p, v -> -((-{LOWEST} * {s} - pmod(-{LOWEST} * {s}, 100)) div 100))").alias("low"),
        F.expr(f"transform(p, v -> ({HIGHEST} * {s} - pmod({HIGHEST} * {s}, 100)) div 100)").alias("high"))
    best = first_rows(table, cut(second, "windows"), parts, n, dim, False, negatives).withColumn("window", F.col("window") + 1)
    return best.join(found, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
