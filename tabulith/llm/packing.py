"""Bounded-space online packing of token ids into training sequences.

Every partition keeps a fixed number of open windows. A document's ids go into the
open window they fit best; when they fit none and all windows are open, the fullest
one is filled up with the head of the document, emitted, and the rest tried again.
What is left open in the partitions is merged at the end in rounds: a round repacks
the leftovers of a fixed number of neighbours, so no task sees more than that many
partitions' windows. Only piece records move, never ids.

Edge cases: a null or empty text is just the end id; a document longer than a
window is cut; a document that comes twice is packed twice; an empty table gives no
pieces.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm.joins import union_all
from tabulith.llm.words import arrow, batch, id_and_text, pieces, release_memory
from tabulith.session import cut_lineage

CAPACITY = 4096
WINDOWS = 24
END_ID = 2
#: Partitions, then groups, whose leftovers one merging task repacks.
FAN_IN = 32
#: Words, and so memory, that a worker remembers at most (twice, in two generations): for the next tasks too, or in one task only.
MEMORY, TASK_MEMORY = 300_000, 120_000

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
PIECES = f"{SCHEMA}, part bigint, open boolean"

#: Fixed values of the vocabulary's word pattern, for words of printable ASCII.
ASCII_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_PRINTABLE = re.compile(rb"[!-~]+")


class WordIds:
    """Ids of texts, word by word: no token of this vocabulary crosses white space.

    Words of printable ASCII are cut by the vocabulary's own pattern and looked up in
    its model; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.memory = memory
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}

    def _stem(self, piece: bytes) -> bytes:
        ids = self.stems.get(piece)
        if ids is None:
            found = [t.id for t in self.model.tokenize(piece.decode())]
            ids = self.stems[piece] = struct.pack(f"<{len(found)}I", *found)
        return ids

    def _learn(self, words: set[bytes]) -> None:
        hard = []
        for w in words:
            out = self.old.get(w)
            if out is None:
                if w.isalpha():  # letters A-Z only: one piece
                    out = self._stem(w.lower())
                elif _PRINTABLE.fullmatch(w) and b"<|" not in w:
                    out = b"".join(map(self._stem, ASCII_PIECES.findall(w.lower())))
                else:
                    hard.append(w)
                    continue
            self.young[w] = out
        if hard:
            for w, e in zip(hard, self.tokenizer.encode_batch_fast([w.decode() for w in hard], add_special_tokens=False), strict=True):
                self.young[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian ids of each text."""
        split = [t.split() for t in texts]
        if len(self.young) > self.memory:
            self.old, self.young = self.young, {}
        if len(self.stems) > self.memory:
            self.stems = {}
        self._learn(set().union(*split) - self.young.keys())
        get = self.young.__getitem__
        return [b"".join(map(get, words)) for words in split]


_encoders: dict[str, WordIds] = {}


def forget_encoders() -> None:
    """Give words, vocabularies and freed memory back to the system; the worker may go on with other work."""
    _encoders.clear()
    gc.collect()
    release_memory()


def encoder(path: str, memory: int = MEMORY) -> WordIds:
    """One per worker process, so that the vocabulary is read once."""
    if path not in _encoders:
        _encoders[path] = WordIds(path, memory)
    return _encoders[path]


class Packer:
    """The open windows of one task and the finished pieces."""

    def __init__(self, first_sequence: int, capacity: int, windows: int):
        self.next, self.capacity, self.limit = first_sequence, capacity, windows
        self.filled: dict[int, int] = {}
        self.held: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []

    def _open(self) -> int:
        self.next += 1
        self.filled[self.next - 1], self.held[self.next - 1] = 0, []
        return self.next - 1

    def _put(self, window: int, piece: tuple, length: int) -> None:
        self.held[window].append((*piece, window, self.filled[window]))
        self.filled[window] += length
        if self.filled[window] == self.capacity:
            self.emit(window)

    def emit(self, window: int) -> None:
        self.done += self.held.pop(window)
        del self.filled[window]

    def best(self, length: int) -> int | None:
        fits = [(self.capacity - f, w) for w, f in self.filled.items() if self.capacity - f >= length]
        return min(fits)[1] if fits else None

    def add(self, doc, ids: bytes) -> None:
        """Place a document; its pieces are cut only where a window is full."""
        total, start = len(ids) // 4, 0
        while start < total:
            length = min(total - start, self.capacity)
            window = self.best(length)
            if window is None:
                if len(self.filled) < self.limit:
                    window = self._open()
                else:
                    window = max(self.filled, key=lambda w: (self.filled[w], -w))
                    length = min(length, self.capacity - self.filled[window])
            part = ids[4 * start : 4 * (start + length)]
            self._put(window, (doc, start, length, zlib.crc32(part), total), length)
            start += length

    def add_whole(self, piece: tuple) -> None:
        """Place a piece that cannot be cut; the fullest window goes when it fits none."""
        window = self.best(piece[2])
        if window is None:
            if len(self.filled) >= self.limit:
                self.emit(max(self.filled, key=lambda w: (self.filled[w], -w)))
            window = self._open()
        self._put(window, piece, piece[2])

    def take(self) -> list[tuple]:
        out, self.done = self.done, []
        return out

    def left(self) -> list[tuple]:
        return [p for w in sorted(self.held) for p in self.held[w]]


def _rows(found: list[tuple], part: int, is_open: bool):
    columns = list(zip(*found, strict=True)) if found else [()] * 7
    return batch(arrow(PIECES), *columns, np.full(len(found), part), np.full(len(found), is_open))


def merger(level: int, last: bool, capacity: int, windows: int):
    """Repacks the leftover pieces of some neighbouring partitions, the longest first."""

    def merge(key, table):
        number = key[0].as_py()
        packer = Packer((level << 60) + (number << 32), capacity, windows)
        found = [tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")) for r in table.to_pylist()]
        for p in sorted(found, key=lambda p: (-p[2], p[0] is None, p[0] or 0, p[1])):
            packer.add_whole(p)
        return pa.Table.from_batches([_rows(packer.take(), number, False), _rows(packer.left(), number, not last)])

    return merge


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, windows: int = WINDOWS, end_id: int = END_ID, fan_in: int = FAN_IN, keep_words: bool = True) -> DataFrame:
    """One row per piece: where its ids come from and where they stand in which sequence.

    Workers keep a bounded number of words for their next task; a caller whose workers
    go on with other work has them, and the vocabulary, given back after each task
    (``keep_words`` False).
    """
    end = struct.pack("<I", end_id)

    def run(batches):
        part = TaskContext.get().partitionId()
        words, packer = encoder(tokenizer, MEMORY if keep_words else TASK_MEMORY), Packer(part << 32, capacity, windows)
        for rows, data, at in pieces(batches):
            raw = data.tobytes()
            ids = words.encode([raw[at[i] : at[i + 1]] for i in range(len(at) - 1)])
            for doc, one in zip(rows.column("doc_id").to_pylist(), ids, strict=True):
                packer.add(doc, one + end)
            yield _rows(packer.take(), part, False)
        yield _rows(packer.left(), part, True)
        if not keep_words:
            del words, packer
            forget_encoders()

    packed = cut_lineage(id_and_text(docs).mapInArrow(run, PIECES))
    whole = [packed.filter("not open")]
    left, groups = packed.filter("open"), (packed.agg(F.max("part")).first()[0] or 0) + 1
    level = 0
    while True:
        level, last = level + 1, groups <= fan_in
        left = left.withColumn("part", F.floor(F.col("part") / fan_in).cast("long")).groupBy("part").applyInArrow(merger(level, last, capacity, windows), PIECES)
        if last:
            break
        left = cut_lineage(left)
        whole.append(left.filter("not open"))
        left, groups = left.filter("open"), -(-groups // fan_in)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return union_all([w.select(*names) for w in [*whole, left]])
