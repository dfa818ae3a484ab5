"""Words, windows and 64-bit hashes of Arrow text columns, by whole-array numpy steps.

A text is its UTF-8 bytes. Hashes are polynomials modulo 2**64 over mixed byte
values, mixed again at the end; equal strings have equal hashes on every worker.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U = np.uint64
#: Bytes of text worked on at once; one longer text is a piece of its own.
PIECE = 2 << 20
#: Bytes whose running sums are held at once: each takes eight bytes, and as much for either power.
STEP = 1 << 18

#: White space between words, and ASCII that is no letter or digit.
SPACE = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x632BE59BD9B4E019))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = {"n": 0}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    if _powers["n"] < n:
        size = max(2 * STEP, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            up, down = (np.cumprod(np.concatenate([[U(1)], np.full(size - 1, b, U)]), dtype=U) for b in (_BASE, _INVERSE))
        if size > 4 * PIECE:
            return up[:n], down[:n]
        _powers.update(n=size, up=up, down=down)
    return _powers["up"][:n], _powers["down"][:n]


def table(separators: bytes) -> np.ndarray:
    """Per byte value: does it belong to a word?"""
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    return inside


IN_WORD, IN_ALNUM = table(SPACE), table(NOT_ALNUM)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and its n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``limit`` bytes of text: the rows, the bytes, the offsets."""
    for batch in batches:
        data, at = text_bytes(batch.column(text))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(row, end - row), data[at[row] : at[end]], at[row : end + 1] - at[row]
            row = end
        del data, at, batch
    release_memory()


def gathered(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches as one while their texts take ``limit`` bytes at most, however few rows come at once."""
    held, size = [], 0
    for one in batches:
        more = one.column(text).nbytes
        if held and size + more > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(one)
        size += more
    if held:
        yield pa.concat_batches(held)


def release_memory() -> None:
    """Give what a worker has freed back to the system: it stays alive after its task, beside the executor's heap."""
    _powers.clear()
    _powers["n"] = 0
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def released(run):
    """The function of a task, with what it has freed given back at its end."""

    def whole(batches):
        yield from run(batches)
        release_memory()

    return whole


class Words:
    """The words of a run of texts: where they start and end, and which words each text has."""

    def __init__(self, data: np.ndarray, at: np.ndarray, inside: np.ndarray, lower: bool = False):
        self.data = lowered(data) if lower else data
        self.at = at
        n = len(data)
        word = inside[self.data]
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        self.starts = np.flatnonzero(word & (~before | edge[:n]))
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        #: words of text i are first[i] to first[i + 1]
        self.first = np.searchsorted(self.starts, at)
        self.counts = np.diff(self.first)

    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte span; spans of other lengths differ too."""
    out = np.empty(len(starts), U)
    ordered = bool((starts[1:] >= starts[:-1]).all())
    i = 0
    while i < len(starts):  # spans that start within STEP bytes
        j = int(np.searchsorted(starts, starts[i] + STEP)) if ordered else len(starts)
        low, high = int(starts[i:j].min()), int(ends[i:j].max())
        up, down = powers(high - low + 1)
        sums = np.zeros(high - low + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[data[low:high]] * up[: high - low], out=sums[1:])
            out[i:j] = mix((sums[ends[i:j] - low] - sums[starts[i:j] - low]) * down[starts[i:j] - low] + (ends[i:j] - starts[i:j]).astype(U) * U(0xD6E8FEB86659FD93))
        i = j
    return out


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` neighbouring word hashes (across texts too; mask those with ``in_text``)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * U(0xA24BAED4963EE407) + words[i : i + n]
    return mix(out + U(k))


def in_text(counts: np.ndarray, k: int) -> np.ndarray:
    """Indices of words that start a window of ``k`` words within their text."""
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    full = np.maximum(counts - k + 1, 0)
    starts = np.repeat(first - np.concatenate([[0], np.cumsum(full)])[:-1], full)
    return np.arange(len(starts)) + starts


def spread_over(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of ``n`` places a run of ``length`` from any of ``starts`` covers."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, n), -1)
    return np.cumsum(step[:n]) > 0


def documents(spark, folder: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_and_text(docs: DataFrame, *more: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the columns the operators read, with their types made sure of (a table may have void columns)."""
    return docs.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`").cast("string").alias(text), *more)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def arrow(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string, for building batches (workers have no session to parse it)."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in kinds.items()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary column whose row i is the bytes of ``values[cuts[i]:cuts[i + 1]]``."""
    size = values.dtype.itemsize
    raw = np.ascontiguousarray(values)
    base = int(cuts[0])
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(((cuts - base) * size).astype(np.int32)), pa.py_buffer(raw[base : int(cuts[-1])].tobytes())])
