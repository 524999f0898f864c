"""Substring de-duplication by hashing lines and runs of words.

Units are long lines, and runs of words between cut words. A cut word is one
whose hash says so, so the same passage is cut at the same words wherever it
stands: inside a longer line, over many short ones, or wrapped anew. A unit's
digest is taken of its lower-cased words; the earliest occurrence in
(doc_id, first word) keeps a digest, and all others are removed, with their
places in the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mastline.llm.tables import WORD, cut
from mastline.llm.textarrays import lean
from mastline.llm.vectors import rows_of

#: Units of fewer words (headings, greetings, license notes) repeat in clean text and are left alone.
MIN_WORDS = 15
#: First hexadecimal digits of a cut word's md5: three words in sixteen.
CUTS = "012"
#: Entries of the per-worker memo of cut words; it is emptied when full.
MEMO_ENTRIES = 500_000
_WORDS = re.compile(WORD)
_LINE, _RUN = b"L", b"W"


class _CutWords(dict):
    """Lower-cased word -> (its bytes, whether it is a cut word)."""

    def __missing__(self, word: str) -> tuple[bytes, bool]:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        raw = word.encode("utf-8", "surrogatepass")
        self[word] = found = (raw, hashlib.md5(raw).hexdigest()[0] in CUTS)
        return found


_known = _CutWords()


def text_units(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(first word, last word, digest) of a text's units.

    A line of ``min_words`` or more is a unit. A run starts at the first word or
    behind a cut word, and ends at the first cut word, or last word of the text,
    that gives it ``min_words``; line ends do not matter to it.
    """
    found = [_known[w] for w in _WORDS.findall(text.lower())]
    n = len(found)
    if n < min_words:
        return
    joined = b" ".join(raw for raw, _ in found)
    end = list(accumulate((len(raw) + 1 for raw, _ in found)))  # one behind the space that follows

    def unit(kind: bytes, a: int, b: int) -> tuple[int, int, bytes]:
        return a, b, xxhash.xxh3_128_digest(kind + joined[end[a - 1] if a else 0:end[b] - 1])

    at = 0
    for line in text.lower().split("\n"):
        size = sum(1 for _ in _WORDS.finditer(line))
        if size >= min_words:
            yield unit(_LINE, at, at + size - 1)
        at += size
    ends = [k for k, (_, is_cut) in enumerate(found) if is_cut]
    if not ends or ends[-1] != n - 1:
        ends.append(n - 1)
    e = 0
    for a in [0, *(k + 1 for k in ends[:-1])]:
        while e < len(ends) and ends[e] < a + min_words - 1:
            e += 1
        if e == len(ends):
            return
        yield unit(_RUN, a, ends[e])


#: What a batch knows of a unit before the shuffle: nothing, or that the batch has it earlier.
UNKNOWN, LATER = 0, 1
KEY = np.dtype([("a", "<u8"), ("b", "<u8")])
#: Documents whose units are compared before the shuffle.
BATCH = 2500
UNITS = "doc_id long, text_key long, first int, last int, digest binary, state byte"


@lean
def _units(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """A unit that its batch has at an earlier place is settled and gives its digest
    up, so a passage that is everywhere sends one digest per batch to its task."""
    for batch in rows_of(batches, BATCH):
        row, first, last, digest = [], [], [], []
        texts = batch.column(1)
        for k in range(batch.num_rows):
            for a, b, d in text_units(texts[k].as_py() or "", min_words):
                row.append(k)
                first.append(a)
                last.append(b)
                digest.append(d)
        doc = batch.column(0).to_numpy()[row] if row else np.zeros(0, np.int64)
        at = np.array(first, np.int32)
        key = np.frombuffer(b"".join(digest), KEY) if digest else np.zeros(0, KEY)
        order = np.lexsort((at, doc, key["b"], key["a"]))
        new = np.ones(len(order), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
        later = np.zeros(len(order), bool)
        later[order] = (doc[order] != doc[lead]) | (at[order] != at[lead])
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc), batch.column(2).take(pa.array(row, pa.int64())), pa.array(at), pa.array(last, pa.int32()),
             pa.array([None if gone else d for d, gone in zip(digest, later.tolist())], pa.binary()), pa.array(later.astype(np.int8))],
            names=[f.split()[0] for f in UNITS.split(", ")])


def units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, first, last, digest, state): first and last word of every unit, counted from 0."""
    return _rows(docs).where("doc_id is not null").mapInArrow(lambda batches: _units(batches, min_words), UNITS)


def _rows(docs: DataFrame) -> DataFrame:
    """``text_key`` tells the texts of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))


@lean
def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by digest and place: all but those at the first place of their
    digest. Settled rows have no digest and come first."""
    before, place = None, None
    for batch in batches:
        digest, doc, first = batch.column(4), batch.column(0).to_numpy(), batch.column(2).to_numpy()
        gone = batch.column(5).to_numpy() == LATER
        open_ = np.flatnonzero(~gone)
        if len(open_):
            key = np.frombuffer(b"".join(digest.take(pa.array(open_)).to_pylist()), KEY)
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = before is None or key[0] != before
            lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))  # -1: the run began in an earlier batch
            d, f = doc[open_], first[open_]
            lead_doc = np.where(lead >= 0, d[lead], place[0] if place else 0)
            lead_first = np.where(lead >= 0, f[lead], place[1] if place else 0)
            gone[open_] = (d != lead_doc) | (f != lead_first)
            before, place = key[-1].copy(), (int(lead_doc[-1]), int(lead_first[-1]))
        yield batch.filter(pa.array(gone)).select(["doc_id", "text_key", "first", "last"])


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, first, last) of every unit that occurs earlier.

    Units are shuffled once, by digest, and stream past in the order of their
    places; memory does not depend on how often a digest occurs.
    """
    found = units(docs, min_words)
    shard = F.when(F.col("digest").isNull(), F.xxhash64("doc_id", "first")).otherwise(F.xxhash64("digest"))
    return cut(found.repartition(shard).sortWithinPartitions("digest", "doc_id", "first").mapInArrow(_later, "doc_id long, text_key long, first int, last int"), "repeats")


@lean
def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, digest, removed, gone_spans, spans = [], [], [], [], []
        for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            text, parts, at, n = text or "", [], 0, 0
            runs: list[list[int]] = []
            for a, b in sorted({(g["first"], g["last"]) for g in gone or ()}):
                if runs and a <= runs[-1][1] + 1:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            bounds = [m.span() for m in _WORDS.finditer(text)] if runs else []
            places = [(bounds[a][0], bounds[b][1]) for a, b in runs]
            for start, end in places:
                parts.append(text[at:start])
                n += end - start
                at = end
            parts.append(text[at:])
            kept.append("".join(parts))
            digest.append(hashlib.sha256(kept[-1].encode("utf-8", "surrogatepass")).hexdigest())
            removed.append(n)
            gone_spans.append(len(places))
            spans.append(",".join(f"{a}:{b}" for a, b in places))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(removed, pa.int64()), pa.array(gone_spans, pa.int64()), pa.array(spans, pa.string()), pa.array(kept, pa.string()),
             pa.array(digest, pa.string())], names=["doc_id", "n_removed", "n_spans", "spans", "kept_text", "kept_sha256"])


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_removed (code points), n_spans, spans (start:end in the original,
    end exclusive), kept_text, kept_sha256: one row per row of ``docs``.

    Neighbouring words of removed units are one span; the white space around a
    span stays. Null texts are empty. Rows with a null doc_id are neither searched
    nor changed; rows that repeat a doc_id count as one document, so equal units at
    equal words do not remove each other. Other columns play no part.
    """
    gone = repeats(docs, min_words).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "last")).alias("gone"))
    return _rows(docs).join(gone, ["doc_id", "text_key"], "left").select("doc_id", "text", "gone").mapInArrow(
        _without, "doc_id long, n_removed long, n_spans long, spans string, kept_text string, kept_sha256 string")
