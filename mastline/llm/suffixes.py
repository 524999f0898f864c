"""Removing byte strings that an earlier document already has.

The index is a logarithmic family of sorted suffix arrays. It is sparse: only
suffixes at anchors are kept, where an anchor is the smallest-hashed 20-gram
of some 50-byte window. Equal windows have equal anchors at equal offsets, so
no repeat is missed, and one suffix in about sixteen is sorted. Arrays are
ordered by fingerprints of the suffixes' heads: a long match is an equality of
50 bytes, so any fixed order serves.

The suffix space is cut into shards by fingerprint. A shard takes its suffixes
in document order, batch by batch: a batch is sorted, merge-scanned against the
levels at hand, and becomes a level; levels of equal size merge, so a suffix is
merged a logarithmic number of times. A first pass finds anchors that a smaller
document shares; a second pass compares the windows around these only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mastline.llm.tables import cut
from mastline.llm.textarrays import _power_tables, buffers, lean, mix64, pieces, U64

LENGTH, GRAM = 50, 20
REACH = LENGTH - GRAM  # bytes that a window can have before its anchor
BATCH = 1 << 18
COPY = -1  # in place of a start: the whole text is a copy
#: Anchors with their surroundings per shard of the second pass.
SHARD_ANCHORS = 150_000


class LevelFamily:
    """Sorted levels of (key, first document); every level is at least twice the next."""

    def __init__(self):
        self.levels: list[dict[str, np.ndarray]] = []

    def add(self, keys: np.ndarray, docs: np.ndarray, extra: np.ndarray, matched: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Add a batch whose documents are not smaller than earlier ones, and
        are whole. Returns which rows have their key in a smaller document, and
        the rows of first documents that were matched for the first time;
        ``matched`` marks rows known to be matched already."""
        if not len(keys):
            return matched.copy(), {"key": keys, "doc": docs, "extra": extra}
        order = np.argsort(keys)
        k, d, x, known_match = keys[order], docs[order], extra[order], matched[order]
        head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        least = np.minimum.reduceat(d, head)
        run = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(k))))
        known = np.zeros(len(head), bool)
        sources = []
        for level in self.levels:
            lo = np.searchsorted(level["key"], k[head])
            hit = lo < len(level["key"])
            hit[hit] = level["key"][lo[hit]] == k[head][hit]
            known |= hit
            if hit.any():
                hi = np.searchsorted(level["key"], k[head][hit], "right")
                at = np.repeat(lo[hit] - np.cumsum(np.concatenate(([0], (hi - lo[hit])[:-1]))), hi - lo[hit]) + np.arange((hi - lo[hit]).sum())
                at = at[~level["sent"][at]]
                level["sent"][at] = True
                sources.append({c: level[c][at] for c in ("key", "doc", "extra")})
        later = known[run] | (d > least[run])
        first = ~later
        hit_runs = np.zeros(len(head), bool)
        hit_runs[run[later | known_match]] = True
        send = first & hit_runs[run]
        sources.append({"key": k[send], "doc": d[send], "extra": x[send]})
        self._push({"key": k[first], "doc": d[first], "extra": x[first], "sent": send[first].copy()})
        out = np.zeros(len(k), bool)
        out[order] = later
        return out, {c: np.concatenate([s[c] for s in sources]) for c in ("key", "doc", "extra")}

    def _push(self, level: dict[str, np.ndarray]) -> None:
        if not len(level["key"]):
            return
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2]["key"]) < 2 * len(self.levels[-1]["key"]):
            a, b = self.levels.pop(-2), self.levels.pop()
            key = np.concatenate((a["key"], b["key"]))
            order = np.argsort(key, kind="stable")  # merges two sorted runs
            self.levels.append({"key": key[order], **{c: np.concatenate((a[c], b[c]))[order] for c in ("doc", "extra", "sent")}})


def _gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Fingerprint of every ``width`` bytes of ``data``."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    powers, inverses = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers[:len(data)], out=total[1:])
    return mix64((total[width:] - total[:n]) * inverses[:n])


def _anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: places and fingerprints of its anchors, and the first window
    of each (one more entry ends the last). Windows of an anchor are consecutive;
    of equal fingerprints the leftmost is the anchor."""
    h = _gram_hashes(data, GRAM)
    windows = len(data) - LENGTH + 1
    if windows <= 0:
        return np.zeros(0, np.int64), h[:0], np.zeros(1, np.int64)
    low, at, width = h, np.arange(len(h), dtype=np.int32), 1

    def smaller(shift: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        left = low[:n] <= low[shift:shift + n]
        return np.where(left, low[:n], low[shift:shift + n]), np.where(left, at[:n], at[shift:shift + n])

    span = LENGTH - GRAM + 1
    while 2 * width <= span:
        low, at = smaller(width, len(low) - width)
        width *= 2
    low, at = smaller(span - width, windows)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    place = at[first].astype(np.int64)
    return place, h[place], np.append(first, windows)


#: What a batch knows of a row before the shuffle: nothing, that a larger document
#: of the batch has its key too, or that a smaller one has. Rows of the last kind
#: are settled; so a hot key sends one document per batch to its shard.
UNKNOWN, MATCHED, LATER = 0, 1, 2


def _settle(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    k, d = keys[order], docs[order]
    head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    if not len(k):
        return np.zeros(0, np.int8)
    size = np.diff(np.append(head, len(k)))
    later = d > np.repeat(np.minimum.reduceat(d, head), size)
    any_later = np.repeat(np.logical_or.reduceat(later, head), size)
    state = np.empty(len(k), np.int8)
    state[order] = np.where(later, LATER, np.where(any_later, MATCHED, UNKNOWN))
    return state


@lean
def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = buffers(batch.column(1))
        doc = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi in pieces(off, 1 << 23):
            found = [_anchors(data[off[k]:off[k + 1]]) for k in range(lo, hi)]
            h, docs = np.concatenate([h for _, h, _ in found]), np.repeat(doc[lo:hi], [len(h) for _, h, _ in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(docs), pa.array(np.concatenate([at for at, _, _ in found])), pa.array(_settle(h, docs))],
                names=["h", "doc_id", "at", "state"])


def _whole_documents(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that end with a document's last row."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held)
            doc = table.column("doc_id").to_numpy()
            end = int(np.searchsorted(doc, doc[-1]))
            if end:
                yield table.slice(0, end)
                held, count = table.slice(end).combine_chunks().to_batches(), len(doc) - end
    if count:
        yield pa.Table.from_batches(held)


@lean
def _shared_anchors(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """A batch without open rows adds nothing to the family."""
    family = LevelFamily()
    for table in _whole_documents(batches, rows):
        h, doc, at, state = (table.column(c).to_numpy() for c in ("h", "doc_id", "at", "state"))
        settled, open_ = state == LATER, state != LATER
        later, first = family.add(h[open_].view(U64), doc[open_], at[open_], state[open_] == MATCHED)
        shared = settled.copy()
        shared[open_] = later
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((doc[shared], first["doc"]))), pa.array(np.concatenate((at[shared], first["extra"])))], names=["doc_id", "at"])


@lean
def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per shared anchor of a text: the bytes of its windows."""
    for batch in batches:
        data, off = buffers(batch.column(2))
        for lo, hi in pieces(off, 1 << 20):
            h, doc, text, start, around = [], [], [], [], []
            for k in range(lo, hi):
                own = data[off[k]:off[k + 1]]
                place, mark, window = _anchors(own)
                where = np.searchsorted(place, at := batch.column(3)[k].values.to_numpy())
                # Rows that repeat an id may lack another row's anchors; one at
                # the same place by chance costs a comparison and changes nothing.
                here = where < len(place)
                here[here] = place[where[here]] == at[here]
                where = where[here]
                raw = own.tobytes()
                start.append(window[where])
                around += [raw[a:b + LENGTH - 1] for a, b in zip(window[where].tolist(), window[where + 1].tolist())]
                h.append(mark[where].view(np.int64))
                doc += [batch.column(0)[k].as_py()] * len(where)
                text += [batch.column(1)[k].as_py()] * len(where)
            # Equal surroundings in a smaller document of the batch settle all windows at once.
            key = np.array([xxhash.xxh3_64_intdigest(a) for a in around], U64)
            later = _settle(key, np.array(doc, np.int64)) == LATER
            mask = np.array([(1 << (len(a) - LENGTH + 1)) - 1 for a in around], np.int64) * later
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(h)), pa.array(doc, pa.int64()), pa.array(text, pa.int64()), pa.array(np.concatenate(start)),
                 pa.array([None if gone else a for a, gone in zip(around, later.tolist())], pa.binary()), pa.array(mask)],
                names=["h", "doc_id", "text_key", "start", "around", "mask"])


@lean
def _matching_windows(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Bit k: the k-th window of the anchor is in a smaller document."""
    family = LevelFamily()
    for table in _whole_documents(batches, rows):
        doc = table.column("doc_id").to_numpy()
        data, off = buffers(table.column("around"))
        data = data[off[0]:off[-1]]
        off = off - off[0]
        count = np.maximum(np.diff(off) - LENGTH + 1, 0)  # settled rows have no bytes left
        row = np.repeat(np.arange(len(doc)), count)
        bit = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        later, _ = family.add(_gram_hashes(data, LENGTH)[off[row] + bit], doc[row], np.zeros(len(row), np.int8), np.zeros(len(row), bool))
        mask = table.column("mask").to_numpy() + np.bincount(row[later], weights=np.exp2(bit[later]), minlength=len(doc)).astype(np.int64)  # distinct bits: a sum is their union
        hit = mask != 0
        if hit.any():
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(table.column(c).to_numpy()[hit]) for c in ("doc_id", "text_key", "start")), pa.array(mask[hit])],
                names=["doc_id", "text_key", "start", "mask"])


def _runs(n: int, start: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered runs of a text of n bytes."""
    edge = np.zeros(n + 1, np.int64)
    for k in range(REACH + 1):
        at = start[(mask >> k) & 1 == 1] + k
        np.add.at(edge, at, 1)
        np.subtract.at(edge, at + LENGTH, 1)
    inside = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False]))
    return np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])


@lean
def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = buffers(batch.column(1))
        removed, spans, digest, listed = [], [], [], []
        for k in range(batch.num_rows):
            own, hits = data[off[k]:off[k + 1]], batch.column(2)[k]
            start = end = np.zeros(0, np.int64)
            if hits.is_valid:
                at, mask = hits.values.field("start").to_numpy(), hits.values.field("mask").to_numpy()
                if (at == COPY).any():
                    start, end = (np.array([0]), np.array([len(own)])) if len(own) >= LENGTH else (start, end)
                else:
                    start, end = _runs(len(own), at, mask)
            raw, kept, before = own.tobytes(), [], 0
            for a, b in zip(start.tolist(), end.tolist()):
                kept.append(raw[before:a])
                before = b
            kept.append(raw[before:])
            removed.append(int((end - start).sum()))
            spans.append(len(start))
            digest.append(hashlib.sha256(b"".join(kept)).hexdigest())
            listed.append(",".join(f"{a}:{b}" for a, b in zip(start.tolist(), end.tolist())))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()),
             pa.array(listed, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text_key", F.xxhash64("text")).withColumn("text_key2", F.xxhash64(F.lit(7), "text"))


def later_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text_key2) of texts that a smaller doc_id has in full."""
    keys = _keyed(docs).select("doc_id", "text_key", "text_key2")
    low = keys.groupBy("text_key", "text_key2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    return keys.join(low, ["text_key", "text_key2"]).where("doc_id > low").select("doc_id", "text_key", "text_key2").distinct()


def repeated_windows(docs: DataFrame, batch: int = BATCH) -> DataFrame:
    """(doc_id, text_key, start, mask): first window of an anchor, and which of its
    windows a smaller doc_id has too. Memory is bounded by the size of a shard."""
    anchors = docs.mapInArrow(_anchor_batches, "h long, doc_id long, at long, state byte")
    shard = F.when(F.col("state") == LATER, F.xxhash64("doc_id", "at")).otherwise(F.col("h"))
    sharded = anchors.repartition(shard).sortWithinPartitions("doc_id")  # an expression, so no further column is shuffled
    shared = cut(sharded.mapInArrow(lambda rows: _shared_anchors(rows, batch), "doc_id long, at long"), "anchors")
    shards = max(1, -(-shared.count() // SHARD_ANCHORS))
    places = shared.groupBy("doc_id").agg(F.collect_list("at").alias("places"))
    around = docs.withColumn("text_key", F.xxhash64("text")).join(places, "doc_id").select("doc_id", "text_key", "text", "places").mapInArrow(
        _surroundings, "h long, doc_id long, text_key long, start long, around binary, mask long")
    shard = F.when(F.col("around").isNull(), F.xxhash64("doc_id", "start")).otherwise(F.col("h"))
    sharded = around.repartition(shards, shard).sortWithinPartitions("doc_id")
    return cut(sharded.mapInArrow(lambda rows: _matching_windows(rows, max(1, batch // 16)), "doc_id long, text_key long, start long, mask long"), "windows")


def remove_repeats(docs: DataFrame, batch: int = BATCH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte offsets): one row per row of ``docs``.

    Every byte of a 50-byte string that also starts in a document with a
    smaller doc_id is removed; strings are judged on the input. Null texts are
    empty. Rows with a null doc_id are neither searched nor changed; rows that
    repeat a doc_id are one document and do not remove each other's bytes.
    Other columns play no part. Full copies of an earlier text are found by
    digest and need no index; what they hold, the earlier text holds.

    Tables that grow with the input are joined by merging at any size.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.where("doc_id is not null and text is not null")
    copies = cut(later_copies(known), "copies")
    index = _keyed(known).join(copies.hint("merge"), ["doc_id", "text_key", "text_key2"], "left_anti").select("doc_id", "text")
    marks = copies.select("doc_id", "text_key", F.lit(COPY).cast("long").alias("start"), F.lit(0).cast("long").alias("mask"))
    hits = repeated_windows(index, batch).unionByName(marks).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "mask")).alias("hits"))
    return docs.withColumn("text_key", F.xxhash64("text")).join(hits.hint("merge"), ["doc_id", "text_key"], "left").select("doc_id", "text", "hits").mapInArrow(
        _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string")
