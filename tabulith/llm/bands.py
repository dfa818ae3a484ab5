"""Quality rules by compression bands, with word and line counts beside them.

A text's zstandard ratio (compressed bytes over bytes) falls when it repeats itself
and rises when it is noise. Both limits depend on how long the text is, as short
texts compress worse. The same limits judge every fixed chunk of a long text, so a
repetitive or random part cannot hide in the average.

The lower limits are set by what repetition looks like: a passage that comes three
times or more is at 0.18 or less in texts of 2 KB and up (short ones repeat shorter
passages), while clean prose stays above 0.3 at any length, as the window of the
compressor ends at 2 MB.

Edge cases: a null or empty text has no words, ratio 0 and fails the base rule; a
text shorter than ``BANDS[0]`` has no limits; columns other than id and text are
not read; a repeated row is judged like the first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tabulith.llm.words import IN_WORD, Words, arrow, batch, id_and_text, in_text, mix, pieces, span_hashes, spread_over, window_hashes

#: (bytes at least, ratio at least, ratio at most), by the length of what is compressed.
BANDS = (
    (128, 0.30, 1.00), (256, 0.25, 0.92), (512, 0.22, 0.82), (1024, 0.20, 0.74), (2048, 0.20, 0.69),
    (4096, 0.20, 0.65), (8192, 0.18, 0.61), (16384, 0.15, 0.59),
)
CHUNK = 4096
#: A text goes when more than this share of its chunks is outside their band.
BAD_CHUNKS = 0.25
LEVEL = 3
WINDOW = 5
SYMBOLS = b"#*$%&|<>"

COUNTS = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
SCHEMA = f"{COUNTS}, base_failed boolean, ratio double, n_chunks bigint, n_bad_chunks bigint, kept boolean"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _sum(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64 if flags.dtype != bool else np.int32)
    np.cumsum(flags, out=total[1:])
    return (total[at[1:]] - total[at[:-1]]).astype(np.int64)


def _again(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more in their owner, and which of those are not the first."""
    own = mix(keys ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    equal = own[order][1:] == own[order][:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order[1:][equal]] = True
    later[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    return twice, later


def text_counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Per text: words, their code points, symbols, repeated lines, words in repeated windows."""
    words = Words(data, at, IN_WORD)
    out = {"n_words": words.counts}
    head = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data & 0xC0) != 0x80, out=head[1:])
    per_word = head[words.ends] - head[words.starts]
    del head
    out["word_chars"] = _sum(per_word, words.first)
    out["n_symbols"] = _sum(_SYMBOL[data], at)

    owner = np.repeat(np.arange(len(at) - 1), np.maximum(words.counts - WINDOW + 1, 0))
    starts = in_text(words.counts, WINDOW)
    windows = window_hashes(words.hashes(), WINDOW)
    twice, _ = _again(windows[starts], owner)
    out["n_repeat_words"] = _sum(spread_over(len(words.starts), starts[twice], WINDOW), words.first)

    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([breaks, at[1:]]), kind="stable")
    used = np.searchsorted(words.starts, end) > np.searchsorted(words.starts, begin)
    begin, end = begin[used], end[used]
    line_owner = np.searchsorted(at, begin, "right") - 1
    _, later = _again(span_hashes(data, begin, end), line_owner)
    out["n_dup_lines"] = np.bincount(line_owner[later], minlength=len(at) - 1)
    return out


def limits(size: int, bands=BANDS) -> tuple[float, float]:
    low, high = 0.0, float("inf")
    for least, lo, hi in bands:
        if size >= least:
            low, high = lo, hi
    return low, high


def in_band(ratio: float, size: int, bands=BANDS) -> bool:
    low, high = limits(size, bands)
    return low <= ratio <= high


def judge(data: np.ndarray, at: np.ndarray, bands=BANDS, chunk: int = CHUNK, bad_chunks: float = BAD_CHUNKS, level: int = LEVEL) -> dict[str, np.ndarray]:
    """Per text: the whole ratio, its chunks, those outside their band, and whether the bands keep it."""
    press = zstandard.ZstdCompressor(level=level)
    n = len(at) - 1
    ratio, chunks, bad, good = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    view = memoryview(data)
    for i in range(n):
        a, b = int(at[i]), int(at[i + 1])
        if a == b:
            continue
        ratio[i] = len(press.compress(view[a:b])) / (b - a)
        good[i] = in_band(ratio[i], b - a, bands)
        if b - a > chunk:
            cuts = [(x, min(x + chunk, b)) for x in range(a, b, chunk)]
            chunks[i] = len(cuts)
            bad[i] = sum(not in_band(len(press.compress(view[x:y])) / (y - x), y - x, bands) for x, y in cuts)
            good[i] &= bad[i] <= bad_chunks * len(cuts)
    return {"ratio": ratio, "n_chunks": chunks, "n_bad_chunks": bad, "in_bands": good}


def verdicts(data: np.ndarray, at: np.ndarray, **options) -> dict[str, np.ndarray]:
    found = text_counts(data, at) | judge(data, at, **options)
    found["base_failed"] = (found["n_words"] < 10) | (100 * found["n_repeat_words"] > 20 * found["n_words"])
    found["kept"] = ~found["base_failed"] & found["in_bands"]
    return found


def compression_bands(docs: DataFrame, **options) -> DataFrame:
    """The counts, ratios and verdict of every document."""
    schema = arrow(SCHEMA)

    def run(batches):
        for rows, data, at in pieces(batches):
            found = verdicts(data, at, **options)
            yield batch(schema, rows.column("doc_id"), *(found[f.name] for f in list(schema)[1:]))

    return id_and_text(docs).mapInArrow(run, SCHEMA)


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns and no shuffle."""

    def run(batches):
        for rows, data, at in pieces(batches):
            yield rows.filter(pa.array(verdicts(data, at, **options)["kept"]))

    return docs.mapInArrow(run, docs.schema)
