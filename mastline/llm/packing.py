"""Packing token sequences into as few fixed-length rows as possible.

Tokenising runs once over the texts; what is packed afterwards are lengths.
Pieces are dealt to shards of bounded size; each shard is packed by best fit
and then improved by a local search, so the number of sequences exceeds that
of one global packing by less than one per shard.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mastline.llm.tables import cut
from mastline.llm.textarrays import lean

CAPACITY = 4096
#: Pieces per shard: bounds the memory of one task, whatever the input's size.
SHARD_PIECES = 20_000
END_ID = 1
#: Entries of the per-worker memo of encoded words; it is emptied when full.
MEMO_ENTRIES = 400_000

#: Latin-1 letters; their normal form is their lower case.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: Marks that form a token of their own behind letters.
_TAIL = b".,!?;:"
#: The vocabulary is over bytes: those without a visible Latin-1 character stand at 256 and on, in order.
_BYTE_SYMBOL = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder(dict):
    """Word -> its ids as little-endian 32-bit bytes, filled as words appear.

    The vocabulary's pre-tokeniser never joins what white space separates, so a
    text's ids are its words' ids in order. Letters are one token of the
    pre-tokeniser and go to the model at once, as does one mark behind them;
    every other word goes through the whole tokeniser.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.raw = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.tails = {k: self._whole(bytes([k])) for k in _TAIL}

    def _whole(self, word: bytes) -> bytes:
        return b"".join([self.raw[k] for k in self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids])

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > 200:
            return self._whole(word)
        if word.isalpha():
            ids = b"".join([self.raw[t.id] for t in self.tokenize(word.lower().decode())])
        elif word[-1] in self.tails and len(word) > 1 and _LETTERS.fullmatch(word[:-1].decode("utf-8", "replace")):
            ids = self[word[:-1]] + self.tails[word[-1]]
        elif _LETTERS.fullmatch(text := word.decode("utf-8", "replace")):
            ids = b"".join([self.raw[t.id] for t in self.tokenize(text.lower().encode().decode("latin-1").translate(_BYTE_SYMBOL))])
        else:
            ids = self._whole(word)
        self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """Ids of a UTF-8 text. ASCII is lowered first, as the vocabulary does,
        unless a special token's name may be in the text."""
        if len(self) > MEMO_ENTRIES:
            self.clear()
        return b"".join(map(self.__getitem__, (text if b"<|" in text else text.lower()).split()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's tokens.

    A document is its text's ids and then ``END_ID``; a null text is empty.
    Repeated rows give repeated pieces.
    """
    path = path or vocabulary()
    end = np.array([END_ID], "<u4").tobytes()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
                row, piece, start, length, crc = [], [], [], [], []
                for k, text in enumerate(texts):
                    ids = words.encode(text)
                    ids += end
                    for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at:at + 4 * capacity]
                        row.append(k)
                        piece.append(p)
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class _Bins:
    """Open bins ordered by room left; each holds the indexes of its pieces."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity, self.items, self.fill = lengths, capacity, [], []

    def best_fit(self, order: list[int]) -> None:
        rooms: list[int] = []  # sorted rooms that occur
        by_room: dict[int, list[int]] = {}

        def put(room: int, b: int) -> None:
            if room:
                if not by_room.setdefault(room, []):
                    insort(rooms, room)
                by_room[room].append(b)

        for k in order:
            need = self.lengths[k]
            at = bisect_left(rooms, need)
            if at == len(rooms):
                b = len(self.items)
                self.items.append([])
                self.fill.append(0)
            else:
                b = by_room[rooms[at]].pop()
                if not by_room[rooms[at]]:
                    rooms.pop(at)
            self.items[b].append(k)
            self.fill[b] += need
            put(self.capacity - self.fill[b], b)

    def _offers(self, a: int) -> dict[int, list[int]]:
        """Size -> one or two pieces of bin ``a``; two may be of one length."""
        by_size: dict[int, list[int]] = {}
        for k in self.items[a]:
            held = by_size.setdefault(self.lengths[k], [])
            if len(held) < 2:
                held.append(k)
        offers = {size: held[:1] for size, held in by_size.items()}
        sizes = sorted(by_size)
        for i, x in enumerate(sizes):
            for y in sizes[i:]:
                if x != y or len(by_size[x]) == 2:
                    offers.setdefault(x + y, [by_size[x][0], by_size[y][-1]])
        return offers

    def _improve(self, a: int, index: "_Takers") -> bool:
        """Make a fuller bin fuller at the cost of ``a``: by the move, one-for-one or
        two-for-one exchange that raises the sum of squared fills most."""
        best, change = 0, None
        for size, pieces in self._offers(a).items():
            raised, b, back = index.best(size, self.fill[a], a)
            if raised > best:
                best, change = raised, (pieces, b, back)
        if change is None:
            return False
        pieces, b, back = change
        gain = sum(self.lengths[k] for k in pieces)
        for k in pieces:
            self.items[a].remove(k)
            self.items[b].append(k)
        if back >= 0:
            gain -= self.lengths[back]
            self.items[b].remove(back)
            self.items[a].append(back)
        self.fill[a] -= gain
        self.fill[b] += gain
        index.put(a)
        index.put(b)
        return True

    def fewest(self) -> int:
        """No packing has fewer bins: by the sum of lengths, and by how many pieces
        of a size or longer fit into one bin."""
        sizes = np.sort(np.array(self.lengths, np.int64))
        longer = np.arange(len(sizes), 0, -1)
        return max(-(-int(sizes.sum()) // self.capacity), int((-(-longer // (self.capacity // sizes))).max(initial=0)))

    def search(self) -> None:
        """Raise the sum of squared fills, emptying the least filled bins, until no
        packing can have fewer bins or no exchange of any two underfull bins helps.
        Every exchange raises the sum, so the search ends."""
        fewest, moved = self.fewest(), True
        while moved and sum(map(bool, self.items)) > fewest:
            moved = False
            open_bins = sorted((b for b in range(len(self.items)) if 0 < self.fill[b] < self.capacity), key=lambda b: self.fill[b])
            index = _Takers(self, open_bins)
            for a in open_bins:
                while 0 < self.fill[a] < self.capacity and self._improve(a, index):
                    moved = True


class _Takers:
    """What underfull bins can take: for each size that a bin holds, and for none,
    the largest size that fits once such a piece is given back."""

    def __init__(self, bins: _Bins, members: list[int]):
        self.bins, self.at, self.used = bins, {}, 0
        self.most, self.given, self.fill, self.bin, self.piece = np.zeros((5, 1024), np.int64)
        for b in members:
            self.put(b)

    def put(self, b: int) -> None:
        """Enter bin ``b``, or what it holds now; a full or empty bin takes nothing."""
        bins = self.bins
        if b in self.at:
            self.most[slice(*self.at.pop(b))] = -1
        room = bins.capacity - bins.fill[b]
        if not room or not bins.items[b]:
            return
        kept = {0: -1, **{bins.lengths[k]: k for k in bins.items[b]}}
        if self.used + len(kept) > len(self.most):
            self._grow(len(kept))
        place = slice(self.used, self.used + len(kept))
        self.given[place], self.piece[place] = list(kept), list(kept.values())
        self.most[place], self.fill[place], self.bin[place] = self.given[place] + room, bins.fill[b], b
        self.at[b] = (place.start, place.stop)
        self.used = place.stop

    def _grow(self, more: int) -> None:
        """Leave out what is outdated, with room for twice what is left."""
        live = np.flatnonzero(self.most[:self.used] >= 0)
        wide = np.full((5, 2 * (len(live) + more) + 1024), -1, np.int64)
        for row, column in zip(wide, (self.most, self.given, self.fill, self.bin, self.piece)):
            row[:len(live)] = column[live]
        self.most, self.given, self.fill, self.bin, self.piece = wide
        self.used = len(live)
        starts = np.flatnonzero(np.concatenate(([True], self.bin[1:self.used] != self.bin[:self.used - 1]))) if self.used else []
        self.at = {int(self.bin[i]): (int(i), int(j)) for i, j in zip(starts, [*starts[1:], self.used])}

    def best(self, size: int, fill: int, a: int) -> tuple[int, int, int]:
        """(half the rise of the sum, bin, piece given back or -1) where a piece or two
        of ``size`` from bin ``a``, filled to ``fill``, do most good; rise 0: nowhere."""
        n = self.used
        ok = np.flatnonzero((self.most[:n] >= size) & (self.given[:n] < size) & (self.fill[:n] >= fill) & (self.bin[:n] != a))
        if not len(ok):
            return 0, -1, -1
        gain = size - self.given[ok]
        rise = gain * (self.fill[ok] - fill + gain)
        k = int(rise.argmax())
        return int(rise[k]), int(self.bin[ok[k]]), int(self.piece[ok[k]])


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, offset) of every piece: best fit, longest first, then local search."""
    bins = _Bins(lengths, capacity)
    bins.best_fit(sorted(range(len(lengths)), key=lambda k: -lengths[k]))
    bins.search()
    out = [(0, 0)] * len(lengths)
    number = 0
    for items in bins.items:
        at = 0
        for k in items:
            out[k] = (number, at)
            at += lengths[k]
        number += bool(items)
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` (with ``doc_id``, ``piece``, ``length``) plus ``sequence_id`` and ``offset``.

    The shard of a piece is a hash of its values and its place in the table, so
    hot documents, lengths and rows that repeat spread out; ``pieces`` must be a
    written table, which reads alike each time. Of equal lengths a smaller
    (doc_id, piece) is placed first; a null doc_id ranks last. Lengths must lie in
    1..capacity. An empty table gives an empty one.
    """
    shards = max(1, -(-pieces.count() // shard_pieces))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def run(key, table):
        order = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("length", "ascending")])
        placed = pack_lengths(order.column("length").to_pylist(), capacity)
        shard = key[0].as_py()
        order = order.drop_columns(["_shard"])
        return order.append_column("sequence_id", pa.array([(shard << 32) + b for b, _ in placed], pa.int64())).append_column(
            "offset", pa.array([o for _, o in placed], pa.int64()))

    spread = pieces.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))
    return spread.groupBy("_shard").applyInArrow(run, fields + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut what exceeds ``capacity``, and pack. The pieces are written
    to the shared folder once: they are counted and then packed."""
    return pack(cut(token_pieces(docs, path, capacity), "pieces"), capacity)
