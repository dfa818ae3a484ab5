"""Ranked lexical search: best-first document intervals bounded by range-maximum sparse tables.

The corpus is indexed in segments of some megabytes, a written table: per term of the
queries its postings in the order of the documents, with term frequencies, and the
length of every document. Collection figures (documents, length, document
frequencies) are summed over the segments before any score is taken.

A search turns postings into impacts and lays a sparse table over them: for every
power of two the place of the largest impact in the window that starts there. As a
range within a list never leaves it, one table serves all lists, and two look-ups
give the largest impact of a term in any interval of documents. The sum of these
over a query's terms bounds every score in the interval. The interval with the
highest bound is taken first and split at its document of the largest single impact,
which is scored exactly; both sides get bounds of their own. Intervals whose bound
cannot enter the best ``k`` are never opened; short ones are scored posting by posting.
Intervals of all queries are worked on together, ``WIDTH`` of each query at a time.
The best of one segment bound the next of the same task.

A task returns at most ``k`` rows a query; those are cut to ``k`` once more by salted
groups before the last cut, so no group grows with the corpus. Queries enter in
blocks of a fixed number of words, each block is one index and one search.

Edge cases: a null or empty text has no terms, counts in no figure and is never
found; a query without terms has no rows; a query whose terms no document holds has
none either; documents of equal score come by ascending id, a null id last; a
document or query that comes twice is answered twice; documents with score 0 (terms
that nearly all documents hold) are left out; an empty corpus or query table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulith.llm.joins import union_all
from tabulith.llm.words import IN_ALNUM, Words, arrow, batch, binaries, id_and_text, pieces
from tabulith.session import cut_lineage

K = 50
#: Words of queries in one block, bytes of text in one segment, postings up to which an interval is scored outright, intervals of a query opened at once.
BLOCK_WORDS, SEGMENT, SHORT, WIDTH, SALTS = 200_000, 2 << 20, 96, 8, 64

SEGMENTS = "docs binary, lengths binary, postings binary, counts binary, cuts binary"
FOUND = "number int, doc_id bigint, score bigint, salt int"


class Queries:
    """The distinct terms of a block of queries, and which terms each query has."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        words = Words(data, np.concatenate([[0], np.cumsum([len(t) for t in raw], dtype=np.int64)]), IN_ALNUM, lower=True)
        self.terms, number = np.unique(words.hashes(), return_inverse=True)
        pairs = np.unique(words.texts() * np.int64(max(1, len(self.terms))) + number) if len(number) else np.zeros(0, np.int64)
        self.query, self.term = pairs // max(1, len(self.terms)), pairs % max(1, len(self.terms))
        self.n = len(texts)


def build_segments(docs: DataFrame, queries, segment: int = SEGMENT) -> DataFrame:
    """The index: one row per run of documents, postings of the queries' terms in the order of the ids."""
    schema = arrow(SEGMENTS)

    def run(batches):
        terms = queries.value.terms
        one = lambda x: binaries(x, np.array([0, len(x)]))
        for rows, data, at in pieces(batches, limit=segment):
            words = Words(data, at, IN_ALNUM, lower=True)
            ids = rows.column("doc_id")
            named = np.asarray(ids.is_valid())
            values = np.asarray(ids.fill_null(0))
            order = np.lexsort((values, ~named))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            hashes = words.hashes()
            slot = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
            known = np.flatnonzero(terms[slot] == hashes)
            pairs, counts = np.unique(slot[known] * len(order) + rank[words.texts()[known]], return_counts=True)
            cuts = np.searchsorted(pairs // len(order), np.arange(len(terms) + 1))
            named_ids = np.stack([values[order], named[order].astype(np.int64)], 1).ravel()
            yield batch(
                schema, one(named_ids), one(words.counts[order].astype(np.int64)), one((pairs % len(order)).astype(np.int32)), one(counts.astype(np.int32)), one(cuts.astype(np.int32))
            )

    return id_and_text(docs).mapInArrow(run, SEGMENTS)


def collection(segments: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and how many documents hold each term of the queries."""

    def run(batches):
        total = np.zeros(n_terms + 2, np.int64)
        for rows in batches:
            for cuts, lengths in zip(rows.column("cuts"), rows.column("lengths"), strict=True):
                n = np.frombuffer(lengths.as_buffer(), np.int64)
                total[:2] += (n > 0).sum(), n.sum()
                total[2:] += np.diff(np.frombuffer(cuts.as_buffer(), np.int32))
        yield batch(arrow("term bigint, n bigint"), np.arange(-2, n_terms), total)

    sums = np.zeros(n_terms + 2, np.int64)
    for term, n in segments.select("cuts", "lengths").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect():
        sums[term + 2] = n
    return int(sums[0]), int(sums[1]), sums[2:]


def weights(documents: int, held: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in held], np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, length: np.ndarray, documents: int, total: int) -> np.ndarray:
    m = 100 - 50 + (50 * length * documents) // total
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Maxima:
    """A sparse table: row k has, for each place, the place of the largest value among the 2**k from there."""

    def __init__(self, values: np.ndarray, longest: int):
        self.values = values
        levels = max(1, int(longest).bit_length())
        self.places = np.zeros((levels, len(values)), np.int32)
        self.places[0] = np.arange(len(values))
        for k in range(1, levels):
            half, n = 1 << (k - 1), len(values) - (1 << k) + 1
            if n <= 0:
                break
            left, right = self.places[k - 1, :n], self.places[k - 1, half : half + n]
            self.places[k, :n] = np.where(values[left] >= values[right], left, right)

    def place(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of each range the place of its largest value, from the two windows that cover it."""
        k = np.frexp((end - start).astype(np.float64))[1] - 1
        left, right = self.places[k, start], self.places[k, end - (np.int64(1) << k)]
        return np.where(self.values[left] >= self.values[right], left, right)


class Best:
    """The best ``k`` documents of every query so far."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]  # query, score, no id, id
        self.score, self.unnamed, self.id = np.zeros(n, np.int64), np.full(n, 2), np.zeros(n, np.int64)

    def add(self, *new: np.ndarray) -> None:
        query, score, unnamed, ids = (np.concatenate([a, b]) for a, b in zip(self.rows, new, strict=True))
        order = np.lexsort((ids, unnamed, -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        order = order[rank < self.k]
        self.rows = [np.concatenate([a, b])[order] for a, b in zip(self.rows, new, strict=True)]
        last = np.flatnonzero(rank[rank < self.k] == self.k - 1)
        of = self.rows[0][last]
        self.score[of], self.unnamed[of], self.id[of] = (x[last] for x in self.rows[1:])

    def may_enter(self, query, bound, unnamed, ids) -> np.ndarray:
        """Whether a document with that score, or else that id, would still be among the best."""
        tie = (unnamed < self.unnamed[query]) | (unnamed == self.unnamed[query]) & (ids < self.id[query])
        return (bound > self.score[query]) | (bound == self.score[query]) & tie & (bound > 0)


class Segment:
    def __init__(self, row: dict, weight: np.ndarray, documents: int, total: int):
        named = np.frombuffer(row["docs"], np.int64).reshape(-1, 2)
        self.ids, self.unnamed = named[:, 0], 1 - named[:, 1]
        lengths = np.frombuffer(row["lengths"], np.int64)
        self.docs = np.frombuffer(row["postings"], np.int32).astype(np.int64)
        self.cuts = np.frombuffer(row["cuts"], np.int32).astype(np.int64)
        sizes = np.diff(self.cuts)
        term = np.repeat(np.arange(len(sizes)), sizes)
        self.keys = (term << 32) + self.docs
        self.impact = impacts(weight[term], np.frombuffer(row["counts"], np.int32).astype(np.int64), lengths[self.docs], documents, total)
        self.maxima = Maxima(self.impact, sizes.max(initial=0))

    def intervals(self, query, owner, term, start, end) -> list[np.ndarray]:
        """Intervals (query, bound, first document) and their non-empty lists (owner, term, start, end, place of the maximum)."""
        place = self.maxima.place(start, end)
        bound, first = np.zeros(len(query), np.int64), np.full(len(query), len(self.ids))
        np.add.at(bound, owner, self.impact[place])
        np.minimum.at(first, owner, self.docs[start])
        return [query, bound, first, owner, term, start, end, place]

    def search(self, queries: Queries, best: Best) -> None:
        some = self.cuts[queries.term + 1] > self.cuts[queries.term]
        if not some.any():
            return
        at, owner = np.unique(queries.query[some], return_inverse=True)
        term = queries.term[some]
        query, bound, first, owner, term, start, end, place = self.intervals(at, owner, term, self.cuts[term], self.cuts[term + 1])
        while len(query):
            alive = best.may_enter(query, bound, self.unnamed[first], self.ids[first])
            order = np.lexsort((first, -bound, query))
            order = order[alive[order]]
            if not len(order):
                return
            turn = np.arange(len(order)) - np.searchsorted(query[order], query[order])
            step = np.full(len(query), 2)  # 0: opened now, 1: waits, 2: out of the running
            step[order] = np.where(turn < WIDTH, 0, 1)
            now, wait = step[owner] == 0, step[owner] == 1
            opened = self.open(query, owner[now], term[now], start[now], end[now], place[now], best)
            kept = np.flatnonzero(step == 1)
            number = np.cumsum(step == 1) - 1
            more = opened[0]
            waiting = [query[kept], bound[kept], first[kept], number[owner[wait]], term[wait], start[wait], end[wait], place[wait]]
            opened[3] = opened[3] + len(kept)
            query, bound, first, owner, term, start, end, place = (np.concatenate([a, b]) for a, b in zip(waiting, [more, *opened[1:]], strict=True))

    def open(self, query, owner, term, start, end, place, best: Best) -> list[np.ndarray]:
        """Score short intervals whole; split the others at the document of the largest impact."""
        sort = np.argsort(owner, kind="stable")
        owner, term, start, end, place = owner[sort], term[sort], start[sort], end[sort], place[sort]
        mine, at, group = np.unique(owner, return_index=True, return_inverse=True)
        query = query[mine]
        short = np.add.reduceat(end - start, at) <= SHORT
        own = short[group]
        self.score(query, group[own], start[own], end[own], best)
        if short.all():
            return [np.zeros(0, np.int64)] * 8
        number = np.cumsum(~short) - 1
        query, group, term, start, end, place = query[~short], number[group[~own]], term[~own], start[~own], end[~own], place[~own]
        value = self.impact[place]
        at = np.searchsorted(group, np.arange(len(query)))
        top = np.flatnonzero(value == np.maximum.reduceat(value, at)[group])
        top = top[np.unique(group[top], return_index=True)[1]]
        split = self.docs[place[top]]
        here = np.searchsorted(self.keys, (term << 32) + split[group])
        inside = np.minimum(here, len(self.docs) - 1)
        holds = (here < end) & (self.docs[inside] == split[group]) & (here >= start)
        score = np.add.reduceat(np.where(holds, self.impact[inside], 0), at)
        self.offer(query, split, score, best)
        left, right = here > start, here + holds < end
        owners = np.concatenate([2 * group[left], 2 * group[right] + 1])
        sides, owners = np.unique(owners, return_inverse=True)
        return self.intervals(
            query[sides // 2], owners, np.concatenate([term[left], term[right]]), np.concatenate([start[left], (here + holds)[right]]), np.concatenate([here[left], end[right]])
        )

    def score(self, query, group, start, end, best: Best) -> None:
        """Every document of the postings' ranges."""
        size = end - start
        if not len(size):
            return
        which = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        key = (np.repeat(group, size) << 32) + self.docs[which]
        found, at = np.unique(key, return_inverse=True)
        score = np.zeros(len(found), np.int64)
        np.add.at(score, at, self.impact[which])
        self.offer(query[found >> 32], found & 0xFFFFFFFF, score, best)

    def offer(self, query, doc, score, best: Best) -> None:
        good = best.may_enter(query, score, self.unnamed[doc], self.ids[doc])
        best.add(query[good], score[good], self.unnamed[doc[good]], self.ids[doc[good]])


def search(segments: DataFrame, queries, figures, k: int) -> DataFrame:
    """At most ``k`` rows a query and task."""
    schema = arrow(FOUND)

    def run(batches):
        block, (weight, documents, total) = queries.value, figures.value
        best, salt = Best(block.n, k), 0
        for rows in batches:
            for i in range(rows.num_rows):
                row = rows.slice(i, 1).to_pylist()[0]
                salt = (salt * 31 + len(row["postings"]) + len(row["docs"])) % SALTS
                Segment(row, weight, documents, total).search(block, best)
        query, score, unnamed, ids = best.rows
        for i in range(0, len(query), 8192):
            part = slice(i, i + 8192)
            named = [None if u else x for u, x in zip(unnamed[part].tolist(), ids[part].tolist(), strict=True)]
            yield batch(schema, query[part].astype(np.int32), named, score[part], np.full(len(named), salt, np.int32))

    return segments.mapInArrow(run, FOUND)


def _cut(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, block_words: int = BLOCK_WORDS, segment: int = SEGMENT) -> DataFrame:
    """The ``k`` best documents of every item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType
    kind = "long" if kind.typeName() == "void" else kind
    asked = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    letters = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(letters / (6 * block_words)))
    results = []
    for b in range(blocks):
        part = [tuple(r) for r in asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        block = Queries([text for _, text in part])
        if not len(block.terms):
            continue
        sent = spark.sparkContext.broadcast(block)
        segments = cut_lineage(build_segments(docs, sent, segment))
        documents, total, held = collection(segments, len(block.terms))
        figures = spark.sparkContext.broadcast((weights(documents, held), documents, total))
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(part)], "number int, item_id string")
        best = _cut(_cut(search(segments, sent, figures, k), ["number", "salt"], k), ["number"], k)
        results.append(best.join(F.broadcast(names), "number").select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score"))
    if not results:
        return spark.createDataFrame([], "item_id string, rank int, doc_id long, score long").withColumn("item_id", F.col("item_id").cast(kind))
    return union_all(results)
