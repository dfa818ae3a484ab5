"""Benchmark decontamination over a distributed positional inverted index.

The corpus is indexed in segments of some megabytes. A segment stores, for every
term of the test items, the sorted places where the corpus has it; documents are a
gap apart, so no match crosses two of them. Segments are a written table, so a lost
executor re-reads them. A search takes the windows of the test items, starts from
the places of each window's rarest term over the whole corpus, and keeps the starts
that the next rarer terms confirm at their own offset. ``slop`` above 0 also accepts
a term that many places off its offset (proximity).

Test items enter in blocks of a fixed number of words; each block is one index and
one search, so neither the broadcast nor a task grows with the number of items.

Edge cases: a null or empty text has no words and is never hit; an item of fewer
words than a window is one window, one without words none; a null item id is
reported as the empty string; equal items are reported each by its id; a document
that comes twice is answered twice.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm.joins import union_all
from tabulith.llm.words import IN_ALNUM, U, Words, arrow, batch, binaries, gathered, id_and_text, pieces
from tabulith.session import cut_lineage

WINDOW = 10
#: Words of test items in one block, and bytes of text in one segment.
BLOCK_WORDS = 200_000
SEGMENT = 4 << 20
GAP = 64

SEGMENTS = "docs binary, words binary, postings binary, cuts binary"
HITS = "doc_id bigint, n_words bigint, hits binary, items array<string>"
RESULT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


class Test:
    """The distinct windows of a block of test items as rows of term numbers."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        texts = [(t or "").encode() for _, t in items]
        data = np.frombuffer(b"".join(texts), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        words = Words(data, at, IN_ALNUM, lower=True)
        hashes = words.hashes()
        self.terms, number = np.unique(hashes, return_inverse=True)
        owners: dict[bytes, list[str]] = {}
        for i, (name, _) in enumerate(items):
            own = number[words.first[i] : words.first[i + 1]].astype(np.int32)
            size = min(window, len(own))
            for j in range(len(own) - size + 1 if size else 0):
                owners.setdefault(own[j : j + size].tobytes(), []).append(name or "")
        self.lengths = np.array([len(k) // 4 for k in owners], np.int64)
        self.windows = np.full((len(owners), window), -1, np.int32)
        for i, k in enumerate(owners):
            self.windows[i, : len(k) // 4] = np.frombuffer(k, np.int32)
        self.owners = [sorted(set(v)) for v in owners.values()]

    def by_rarity(self, counts: np.ndarray) -> np.ndarray:
        """Offsets of each window's terms, the rarest first; places that a short window lacks come last."""
        weight = np.where(self.windows >= 0, counts[self.windows], np.iinfo(np.int64).max)
        return np.argsort(weight, axis=1, kind="stable")


def build_segments(docs: DataFrame, test, segment: int = SEGMENT) -> DataFrame:
    """The index: one row per run of documents, with the places of every test term in it."""
    schema = arrow(SEGMENTS)

    def run(batches):
        terms = test.value.terms
        for rows, data, at in pieces(gathered(batches, limit=segment), limit=segment):
            words = Words(data, at, IN_ALNUM, lower=True)
            hashes = words.hashes()
            slot = np.minimum(np.searchsorted(terms, hashes), max(len(terms) - 1, 0)) if len(terms) else np.zeros(len(hashes), np.int64)
            known = np.flatnonzero(terms[slot] == hashes) if len(terms) else np.zeros(0, np.int64)
            place = known + words.texts()[known] * GAP
            order = np.argsort(slot[known], kind="stable")
            cuts = np.searchsorted(slot[known][order], np.arange(len(terms) + 1))
            ids = np.array(rows.column("doc_id").to_pylist(), object)
            named = np.array([i is not None for i in ids], bool)
            docs_out = np.stack([np.where(named, ids, 0).astype(np.int64), named.astype(np.int64)], 1).ravel()
            one = lambda x: binaries(x, np.array([0, len(x)]))
            yield batch(schema, one(docs_out), one(words.counts.astype(np.int32)), one(place[order].astype(np.int32)), one(cuts.astype(np.int32)))

    return id_and_text(docs).mapInArrow(run, SEGMENTS)


def term_counts(segments: DataFrame, n_terms: int) -> np.ndarray:
    """How often the corpus has each term: one row per term and task reaches the sum."""

    def run(batches):
        total = np.zeros(n_terms, np.int64)
        for rows in batches:
            for cuts in rows.column("cuts"):
                total += np.diff(np.frombuffer(cuts.as_buffer(), np.int32))
        yield batch(arrow("term bigint, n bigint"), np.arange(n_terms), total)

    counts = np.zeros(n_terms, np.int64)
    for term, n in segments.select("cuts").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect():
        counts[term] = n
    return counts


def find(test: Test, order: np.ndarray, postings: np.ndarray, cuts: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of every match in one segment, by intersecting offset-adjusted lists."""
    everywhere = np.arange(len(test.windows))
    rare = test.windows[everywhere, order[:, 0]]
    counts = cuts[rare + 1] - cuts[rare]
    window = np.repeat(everywhere, counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = postings[cuts[rare][window] + within].astype(np.int64) - order[window, 0]
    # One sorted array of (term, place) makes every list of the segment searchable at once.
    base = np.int64(slop + GAP)
    keys = (np.repeat(np.arange(len(cuts) - 1, dtype=np.int64), np.diff(cuts)) << 33) + postings + base
    for j in range(1, test.windows.shape[1]):
        if not len(window):
            break
        offset = order[window, j]
        term = test.windows[window, offset]
        wanted = (term.astype(np.int64) << 33) + start + offset + base
        near = np.searchsorted(keys, wanted - slop)
        there = near < len(keys)
        there[there] = keys[near[there]] <= wanted[there] + slop
        good = there | (term < 0)
        window, start = window[good], start[good]
    return window, start


def search(segments: DataFrame, test, order, slop: int = 0, summed: bool = False) -> DataFrame:
    """Per document: its words, the runs of words that are hit, the items that hit them.

    ``summed``: the result per document instead, by the same worker; a step of its own
    would keep a second worker alive beside each.
    """

    def run(batches):
        schema = arrow(HITS)
        t, by = test.value, order.value
        for rows in batches:
            for r in rows.to_pylist():
                ids = np.frombuffer(r["docs"], np.int64).reshape(-1, 2)
                counts = np.frombuffer(r["words"], np.int32).astype(np.int64)
                first = np.concatenate([[0], np.cumsum(counts)])
                window, start = find(t, by, np.frombuffer(r["postings"], np.int32).astype(np.int64), np.frombuffer(r["cuts"], np.int32).astype(np.int64), slop)
                # The rarest term is certainly in the document; with slop the start may lie before it.
                doc = np.searchsorted(first[:-1] + np.arange(len(counts)) * GAP, start + by[window, 0], "right") - 1
                local = np.maximum(start - doc * GAP - first[doc], 0)
                hits, items = [b""] * len(counts), [[]] * len(counts)
                for d in np.unique(doc):
                    mine = doc == d
                    hits[d] = np.stack([local[mine], np.minimum(local[mine] + t.lengths[window[mine]], counts[d])], 1).astype(np.int32).tobytes()
                    items[d] = sorted({name for w in np.unique(window[mine]) for name in t.owners[w]})
                yield batch(schema, [i if k else None for i, k in ids.tolist()], counts, hits, items)

    if summed:
        return segments.mapInArrow(lambda batches: _summary(run(batches)), RESULT)
    return segments.mapInArrow(run, HITS)


def _covered(hits: list[bytes], n: int) -> int:
    spans = np.concatenate([np.frombuffer(h, np.int32).reshape(-1, 2) for h in hits]) if hits else np.zeros((0, 2), np.int32)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, spans[:, 0], 1)
    np.add.at(step, spans[:, 1], -1)
    return int((np.cumsum(step[:n]) > 0).sum())


def _summary(batches):
    schema = arrow(RESULT)
    for rows in batches:
        out = []
        for r in rows.to_pylist():
            hits = r["hits"] if isinstance(r["hits"], list) else [r["hits"]]
            items = sorted(set(r["items"]))
            n = _covered([h for h in hits if h], r["n_words"])
            out.append((r["doc_id"], r["n_words"], n, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n > 0))
        yield batch(schema, *(list(zip(*out, strict=True)) or [()] * len(schema)))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, slop: int = 0, segment: int = SEGMENT) -> DataFrame:
    """Per document: words, words inside any occurrence of a test window, and the items they come from."""
    spark = docs.sparkSession
    tests = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    letters = tests.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(letters / (6 * block_words)))
    found = []
    rows = id_and_text(docs)
    if blocks > 1:  # each pass has to give the same row the same key
        rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    for b in range(blocks):
        part = tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        test = Test([tuple(r) for r in part.collect()], window)
        sent = spark.sparkContext.broadcast(test)
        source = rows if blocks == 1 else rows.select(F.col("row").alias("doc_id"), "text")
        segments = cut_lineage(build_segments(source, sent, segment))
        counts = term_counts(segments, len(test.terms))
        order = spark.sparkContext.broadcast(test.by_rarity(counts))
        found.append(search(segments, sent, order, slop, summed=blocks == 1))
    if blocks == 1:
        return found[0]
    every = union_all(found).groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.collect_list("hits").alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
    result = every.mapInArrow(_summary, RESULT).withColumnRenamed("doc_id", "row")
    return rows.select("row", "doc_id").join(result, "row").drop("row")
