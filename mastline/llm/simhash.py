"""Near-duplicate documents by SimHash and meet-in-the-middle ball hashing.

Two fingerprints that differ in at most two bits have a common neighbour at
distance one or less from both. So every distinct fingerprint is sent to itself
and to its 64 neighbours; those that meet at one place are a bounded set (the
place and its neighbours, 65 at most), kept as one bit mask. Nothing is searched,
and no group grows with the data.
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
from mastline.llm.textarrays import buffers, lean

WIDTH, SEED = 3, 42
RADIUS = 2
#: Bytes of a text that are split into words at once, and shingles that are counted at once.
PIECE, BLOCK = 1 << 22, 1 << 16
#: A fingerprint is hot when more than one row in so many has it; so many are hot at most.
HOT = 400


def _words(raw: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words of a text in lists of bounded size; no word is cut.
    ``bytes.split`` parts at exactly the six ASCII spaces, ``bytes.lower`` changes A-Z only."""
    if len(raw) <= PIECE:
        yield raw.lower().split()
        return
    tail = b""
    for lo in range(0, len(raw), PIECE):
        words = (tail + raw[lo:lo + PIECE].lower()).split()
        open_end = lo + PIECE < len(raw) and raw[lo + PIECE - 1:lo + PIECE].strip() and words
        tail = words.pop() if open_end else b""
        yield words
    if tail:
        yield [tail]


def _hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of every ``WIDTH`` neighbouring words, joined by single spaces."""
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    spans = zip(start[:len(words) - WIDTH + 1].tolist(), end[WIDTH - 1:].tolist())
    return np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(raw: bytes) -> int:
    """A bit is set where over half of the text's shingle hashes have it; 0 without words."""
    ones, n, rest = np.zeros(64, np.int64), 0, []
    for words in _words(raw):
        words = rest + words
        if len(words) >= WIDTH:
            for lo in range(0, len(words) - WIDTH + 1, BLOCK):
                h = _hashes(words[lo:lo + BLOCK + WIDTH - 1])
                n += len(h)
                ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            words = words[1 - WIDTH:]
        rest = words
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(rest), SEED) if rest else 0
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


@lean
def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = buffers(batch.column(1))
        found = [fingerprint(data[a:b].tobytes()) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "bits"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, bits): one row per row of ``docs``, the fingerprint as a signed long; no shuffle."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _fingerprint_batches, "doc_id long, bits long")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) with a < b for the distinct fingerprints ``bits``: of those that meet
    at a place, each is linked to the smallest. Every two fingerprints within
    ``RADIUS`` bits meet, so chains of links join all that chains of pairs join.

    The variants are combined before the shuffle; a place keeps 65 bits, whatever
    the number of documents.
    """
    # A row grows 65-fold: the narrow ones are spread first. A given number of
    # partitions is not coalesced, as their narrow size would suggest.
    distinct = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bits")
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)))
    variants = distinct.select("bits", F.explode(flips).alias("flip")).select(F.col("bits").bitwiseXOR(F.col("flip")).alias("place"), "flip")
    met = variants.groupBy("place").agg(F.bit_or("flip").alias("flips"), F.max(F.col("flip") == 0).alias("own")).where(
        F.bit_count("flips") + F.col("own").cast("int") > 1)
    members = F.filter(flips, lambda f: F.when(f == 0, F.col("own")).otherwise(F.col("flips").bitwiseAND(f) != 0))
    group = met.select(F.transform(members, lambda f: F.col("place").bitwiseXOR(f)).alias("group"))
    pairs = group.select(F.array_min("group").alias("a"), F.explode("group").alias("b")).where("a < b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of ``docs``.

    Null, empty and blank texts have the fingerprint zero and link like others.
    A text of one or two words has its whole sequence as its only shingle. Rows
    with a null doc_id have a fingerprint, link with nothing, and their
    component_id is null. Rows that repeat a doc_id are one document whose links
    add up. Other columns play no part, whatever their names.
    """
    rows = cut(fingerprints(docs), "fingerprints")
    known = rows.where("doc_id is not null")
    classes = cut(known.groupBy("bits").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")), "classes")
    repeated = known.groupBy("doc_id").agg(F.min("bits").alias("a"), F.max("bits").alias("high")).where("a < high").select("doc_id", "a")
    same = known.join(repeated, "doc_id").where("bits > a").select("a", F.col("bits").alias("b"))
    parts = connected(cut(links(classes.select("bits")).unionByName(same), "links"))
    placed = classes.join(parts.withColumnRenamed("node", "bits"), "bits", "left").select(
        "bits", "first", "size", F.coalesce("component", "bits").alias("component"))
    lowest = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    placed = cut(placed.join(lowest, "component").select("bits", "size", "component_id"), "components")
    # A fingerprint that many rows share would put them all into one task of a join.
    total = rows.count()
    hot = placed.where(F.col("size") * HOT > total).select("bits", F.col("component_id").alias("hot_id"))  # fewer than HOT rows
    marked = rows.join(F.broadcast(hot), "bits", "left")
    settled = marked.where("hot_id is not null").withColumnRenamed("hot_id", "component_id")
    rest = marked.where("hot_id is null").join(placed.select("bits", "component_id"), "bits", "left").select("bits", "doc_id", "component_id")
    return settled.select("bits", "doc_id", "component_id").unionByName(rest).select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
