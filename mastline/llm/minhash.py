"""Near-duplicate documents by circulant MinHash, banding and exact verification.

One permutation scrambles the shingles, a second one is shifted circularly to
give every coordinate of the signature; no further hash functions are needed.
With 32 bands of 4 coordinates, two texts at the threshold of 0.75 share no
band with probability (1 - 0.75**4)**32, about 5 in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mastline.llm.components import connected
from mastline.llm.tables import cut
from mastline.llm.textarrays import buffers, lean, mix64, pieces, shingle_sets, U64

WIDTH, THRESHOLD = 5, 75  # words of a shingle, percent
BANDS, ROWS = 32, 4
_SHIFTS = np.arange(BANDS * ROWS, dtype=np.uint32)[:, None]
_BLOCK = 2048
#: Bits of a parity sketch, and members of a bucket that are compared in one task.
SKETCH_BITS, BLOCK_MEMBERS = 2048, 1024


def _permute(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit universe, in place."""
    y = np.empty_like(x)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        np.right_shift(x, np.uint32(shift), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=y)
    np.bitwise_xor(x, y, out=x)
    return x


def signature(shingles: np.ndarray) -> np.ndarray:
    """Coordinate k: least value, over the set, of the second permutation shifted by k."""
    first = (mix64(shingles) >> U64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(first), _BLOCK):
        np.minimum(least, _permute(first[None, lo:lo + _BLOCK] - _SHIFTS).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(U64)
    key = np.arange(1, BANDS + 1, dtype=U64)
    for k in range(ROWS):
        key = mix64(key ^ (rows[:, k] + U64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))))
    return key


@lean
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = buffers(batch.column(1))
        size, digest, bands = [], [], []
        for lo, hi in pieces(off):
            for s in shingle_sets(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], WIDTH):
                size.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(band_keys(signature(s)).view(np.int64) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "digest", "bands"])


def parity_sketch(shingles: np.ndarray) -> bytes:
    """One bit per hashed cell: whether the set has an odd number of shingles in it.
    Two sketches differ in at most as many bits as the sets in shingles."""
    cell = (mix64(shingles) % U64(SKETCH_BITS)).astype(np.int64)
    return np.packbits(np.bincount(cell, minlength=SKETCH_BITS) & 1).tobytes()


@lean
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = buffers(batch.column(1))
        for lo, hi in pieces(off):
            found = shingle_sets(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], WIDTH)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array([s.tobytes() for s in found], pa.binary()),
                 pa.array([parity_sketch(s) for s in found], pa.binary()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary())], names=["node", "shingles", "sketch", "digest"])


def _possible(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block that sizes and sketches allow to reach the threshold and
    that no chain of links joins yet. A block holds one part of a bucket, or two
    parts that meet each other."""
    node, n, c, own = (table.column(k).to_numpy() for k in ("node", "n", "c", "own"))
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), U64).reshape(len(node), -1)
    within = len(np.unique(own)) == 1 and table.column("i")[0] == table.column("j")[0]
    left, right = [], []
    for x in range(len(node) - 1):
        m = n[x + 1:]
        y = np.flatnonzero((c[x + 1:] != c[x]) & (m * 100 >= n[x] * THRESHOLD) & (n[x] * 100 >= m * THRESHOLD) & (within | (own[x + 1:] != own[x]))) + x + 1
        if not len(y):
            continue
        total = n[x] + n[y]
        apart = total - 2 * -(-total * THRESHOLD // (100 + THRESHOLD))
        y = y[np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64) <= apart]
        left.append(np.full(len(y), node[x]))
        right.append(node[y])
    none = [np.zeros(0, np.int64)]
    a, b = np.concatenate(left or none), np.concatenate(right or none)
    return np.minimum(a, b), np.maximum(a, b)


@lean
def _possible_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; a block is compared when its last row is there."""
    held: pa.Table | None = None

    def compare(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        found = [_possible(table.slice(a, b - a)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if b - a > 1]
        none = [np.zeros(0, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found] or none)) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        keys = [table.column(k).to_numpy() for k in ("h", "i", "j")]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        if len(change):
            yield compare(table, np.concatenate(([0], change)))
            table = table.slice(int(change[-1]))
        held = table
    if held is not None and held.num_rows:
        yield compare(held, np.array([0, held.num_rows]))


@lean
def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            x, y = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
            common = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
            keep[k] = 100 * common >= THRESHOLD * (len(x) + len(y) - common)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, band keys); no shuffle."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _sign, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(_similar, "a long, b long").distinct()


def _pairs(left: DataFrame) -> DataFrame:
    close = F.col("n") * THRESHOLD <= F.col("m") * 100
    close &= F.col("m") * THRESHOLD <= F.col("n") * 100
    return left.where(close & (F.col("x") != F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _rest(open_rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of members that are in one bucket but not yet connected
    and that may be similar. Large buckets are split into parts, and every two
    parts meet in a task of their own, so no task holds more than two parts."""
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = open_rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "c", "sketch")
    return dealt.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(_possible_pairs, "a long, b long").distinct()


def links(docs: DataFrame, signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, representative) of equal sets, and verified links between representatives.

    A bucket is not expanded into all its pairs. Its members are first verified
    against one lead, the member met in most buckets. Members that no chain of
    links joins to each other meet next: sizes and parity sketches, which bound
    the similarity from above, discard most of these pairs inside the task, and
    the rest is verified. Every pair of a bucket is thus connected, verified or
    proven too unlike, so no component is lost.
    """
    known = signed.where("n_shingles > 0 and doc_id is not null")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("node"))
    member = known.select("doc_id", "digest").join(classes, "digest").select("doc_id", "node").distinct()
    keys = known.join(classes, "digest").where("doc_id = node").select(
        "node", F.xxhash64("digest").alias("own_set"), F.col("n_shingles").alias("n"), F.explode("bands").alias("h"))
    full = keys.groupBy("h").agg(F.count("*").alias("size")).where("size > 1")
    rows = cut(keys.join(full, "h").distinct(), "buckets")

    nodes = rows.select("node").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    sets = texts.join(nodes, "node", "left_semi").select("node", "text").mapInArrow(_sets, "node long, shingles binary, sketch binary, digest binary")
    sets = cut(sets.select("node", "shingles", "sketch", F.xxhash64("digest").alias("own_set")).distinct(), "sets")

    degree = rows.groupBy("node").agg(F.sum("size").alias("degree"))
    lead = rows.join(degree, "node").groupBy("h").agg(
        F.max(F.struct("degree", (-F.col("node")).alias("order"), "n")).alias("lead")).select("h", (-F.col("lead.order")).alias("y"), F.col("lead.n").alias("m"))
    star = _pairs(rows.select("h", F.col("node").alias("x"), "n").join(lead, "h"))
    # Ids that stand for several sets join those sets' classes.
    repeated = member.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1")
    same = member.join(repeated, "doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = cut(_verified(star, sets).unionByName(same), "links")

    placed = rows.join(connected(found), "node", "left").select("h", "node", "own_set", "n", F.coalesce("component", "node").alias("c"))
    open_buckets = placed.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("size")).where("low <> high").select(
        "h", F.ceil(F.col("size") / BLOCK_MEMBERS).cast("int").alias("parts"))
    # An id with several texts has a sketch for each. Should two of them share the hash,
    # both sketches are tried, which costs a comparison and loses no pair.
    sketches = sets.select("node", "own_set", "sketch")
    open_rows = cut(placed.join(open_buckets, "h").join(sketches, ["node", "own_set"]).drop("own_set"), "open")
    more = cut(_verified(_rest(open_rows).join(star, ["a", "b"], "left_anti"), sets), "links")
    return member, found.unionByName(more)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    Documents link at 100 * intersection >= 75 * union of their distinct
    lower-cased five-word shingles (fewer words: the whole sequence). Null,
    empty and blank texts have no shingles and stay alone. Rows with a null
    doc_id are kept and belong to no component (component_id null). Rows that
    repeat a doc_id are one document whose links add up.
    """
    signed = cut(signatures(docs), "signatures")
    member, found = links(docs, signed)
    placed = member.join(connected(found), "node", "left").groupBy("doc_id").agg(
        F.min(F.coalesce("component", "node")).alias("component_id"))
    return signed.select("doc_id", "n_shingles").join(placed, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near copies of a smaller doc_id; columns as given.
    Of rows that repeat doc_id and text, one stays (the first by a hash of the row)."""
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    marks = near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(
        F.bool_or("kept").alias("kept"), F.count("*").alias("k")).where("k > 1 or not kept")
    single = packed.join(marks, "doc_id", "left_anti").select("row")
    repeated = packed.join(marks.where("kept"), "doc_id", "left_semi").groupBy("doc_id", "text").agg(
        F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return single.unionByName(repeated).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
