"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements
and one failure bit per rule; a policy is a mask with a version, so another
verdict, or the effect of leaving a rule out, needs no text any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mastline.llm.textarrays import buffers, lean, per_text, pieces, span_hashes, window_hashes, word_bounds

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_other", "n_unspaced")

#: Bit k of the mask is rule k; the order is part of the stored format.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)"),
    ("shouting", "2 * n_upper > n_letters"),
    ("exclamation", "3 * n_marks > n_words"),
    # The same for any script: two characters written without spaces count as a
    # word, and case is a share of all letters. Other texts get the same verdicts.
    ("few_words_any_script", "2 * n_words + n_unspaced < 100"),
    ("symbols_any_script", "20 * n_symbols > 3 * (2 * n_words + n_unspaced)"),
    ("word_length_any_script", "n_words > 0 and (word_chars + n_unspaced < 2 * n_words or 2 * word_chars > 15 * (2 * n_words + n_unspaced))"),
    ("shouting_any_script", "2 * n_upper > n_letters + n_other"),
    ("exclamation_any_script", "6 * n_marks > 2 * n_words + n_unspaced"),
)
#: Version -> rules that reject. A published version never changes.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "duplicate_lines", "word_length", "shouting", "exclamation"),
    "v2": ("few_words_any_script", "repeated_words", "symbols_any_script", "duplicate_lines", "word_length_any_script", "shouting_any_script",
           "exclamation_any_script"),
    # v2 with the base rules as they stand: every policy in use rejects what they reject.
    "v3": ("few_words", "repeated_words", "symbols_any_script", "duplicate_lines", "word_length_any_script", "shouting_any_script",
           "exclamation_any_script"),
}
CURRENT = "v3"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!")] = True
#: First two bytes of characters of scripts without word spacing: Thai, Lao and Tibetan, Burmese, Khmer, Chinese and
#: Japanese with their marks and wide forms; supplementary ideographs.
_UNSPACED = np.zeros(1 << 16, bool)
for _lead, _next in ((0xE0, range(0xB8, 0xC0)), (0xE1, (0x80, 0x81, 0x82, 0x9E, 0x9F)), *((b, range(0x80, 0xC0)) for b in range(0xE3, 0xEA)),
                     (0xEF, (0xA4, 0xA5, 0xA6, 0xA7, 0xA8, 0xA9, 0xAA, 0xAB, 0xBC, 0xBD, 0xBE)), (0xF0, range(0xA0, 0xB4))):
    _UNSPACED[[_lead << 8 | b for b in _next]] = True


def _unspaced(data: np.ndarray) -> np.ndarray:
    """Whether a character of a script without word spacing starts at each byte."""
    pair = data.astype(np.uint16) << 8
    pair[:-1] |= data[1:]
    return _UNSPACED[pair]


def _measure(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    n = len(off) - 1
    start, end, first = word_bounds(data, off)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] += 1
    np.subtract.at(inside, end, 1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    out = {
        "n_words": np.diff(first),
        "word_chars": per_text(inside & ((data & 0xC0) != 0x80), off),
        "n_symbols": per_text(_SYMBOL[data], off),
        "n_upper": per_text(_UPPER[data], off),
        "n_letters": per_text(_LETTER[data], off),
        "n_marks": per_text(_MARK[data], off),
        "n_other": per_text(data >= 0xC0, off),
        "n_unspaced": per_text(_unspaced(data), off),
    }
    # Lines: a text starts one, and so does every byte behind a newline.
    newline = np.flatnonzero(data == 10)
    doc_of_newline = np.searchsorted(off, newline, "right") - 1
    line_start = np.concatenate((off[:-1], newline + 1))
    line_end = np.concatenate((newline, off[1:]))
    line_doc = np.concatenate((np.arange(n), doc_of_newline))
    line_start, line_doc = line_start[(k := np.lexsort((line_start, line_doc)))], line_doc[k]
    end_doc = np.concatenate((doc_of_newline, np.arange(n)))
    line_end = line_end[np.lexsort((line_end, end_doc))]
    worded = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end, line_doc = line_start[worded], line_end[worded], line_doc[worded]
    h = span_hashes(data, line_start, line_end)
    order = np.lexsort((h, line_doc))
    same = (h[order][1:] == h[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = np.bincount(line_doc[order][1:][same], minlength=n)
    # Words inside a three-word window that its text has twice.
    words = span_hashes(data, start, end)
    covered = np.zeros(len(words), bool)
    if len(words) >= 3:
        doc = np.repeat(np.arange(n), np.diff(first))
        at = np.flatnonzero(doc[2:] == doc[:-2])
        key = window_hashes(words, 3)[at] + doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            covered[at[twice] + k] = True
    out["n_repeat_words"] = per_text(covered, first)
    return out


@lean
def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = buffers(batch.column(batch.schema.names.index("text")))
        parts = []
        for lo, hi in pieces(off):
            parts.append(_measure(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]))
        keep = [batch.column(k) for k, name in enumerate(batch.schema.names) if name != "text"]
        names = [name for name in batch.schema.names if name != "text"]
        values = [pa.array(np.concatenate([p[m] for p in parts]) if parts else [], pa.int64()) for m in MEASURES]
        yield pa.RecordBatch.from_arrays([*keep, *values], names=[*names, *MEASURES])


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and every measurement of ``text``, one row per document; no shuffle.

    Null and empty texts measure 0 throughout. Repeated rows stay repeated, and
    other columns of ``docs`` play no part, whatever their names.
    """
    fields = [docs.schema[c] for c in keep]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{m} long" for m in MEASURES)])
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string").alias("text")).mapInArrow(_measure_batches, ddl)


def failure_bits() -> Column:
    bits = F.lit(0).cast("long")
    for k, (_, rule) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return bits


def policy_mask(version: str) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(r) for r in POLICIES[version])


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measurements plus ``fail_bits``, one bit for each of ``RULES``; rows and nulls as in ``measure``."""
    return measure(docs, keep).withColumn("fail_bits", failure_bits())


def passes(version: str = CURRENT) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy_mask(version))) == 0


def ablations(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone (they
    would be kept without it), and the policy's rejects. One aggregate over the masks."""
    mask = policy_mask(version)
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask))
    aggs = [F.count(F.when(bits != 0, 1)).alias("rejected")]
    for name in POLICIES[version]:
        bit = 1 << [r for r, _ in RULES].index(name)
        aggs += [F.count(F.when(bits.bitwiseAND(F.lit(bit)) != 0, 1)).alias(f"{name}_fails"),
                 F.count(F.when(bits == bit, 1)).alias(f"{name}_alone")]
    total = rows.agg(*aggs)
    stack = ", ".join(f"'{n}', {n}_fails, {n}_alone" for n in POLICIES[version])
    return total.selectExpr(f"stack({len(POLICIES[version])}, {stack}) as (rule, fails, fails_alone)", "rejected")


def filter_documents(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The documents a policy keeps, with their columns; texts are not shuffled.

    Null, empty and blank texts have no words and are rejected by the base
    rules. Repeated rows are judged one by one; a null doc_id changes nothing.
    """
    names = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("text"))
    kept = ledger(packed, ("row",)).where(passes(version))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in names))
