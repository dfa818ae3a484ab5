"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier over the words of a text and the beginnings of its words (presence,
hashed) is trained from confirmed toxic documents and unlabelled ones. The risk is
class-prior corrected: prior * R+(P) + max(0, R-(U) - prior * R-(P)); where the second
part would fall below zero, the step goes back up its gradient, so that the
classifier cannot profit from unlabelled toxic texts. Labels are read from the
training fold only: to find the confirmed toxic documents and the prior, the toxic
share of its labelled rows. The unlabelled texts are those labelled rows with their
labels put away; where every label is toxic, they are the fold's other documents, and
the prior is a parameter (``PRIOR`` unless given).

The training sample is bounded (``POSITIVE`` and ``UNLABELLED`` rows, by a hash of
their id); scoring covers every document, in the tasks that read them.

Edge cases: a null or empty text scores as a text without features; a document without
id is held out of training and scored; without toxic training rows every score is 0;
labels without a document in the training fold and repeated labels are ignored (a
document is toxic if any of its labels says so); repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm.joins import by_ids
from tabulith.llm.words import IN_ALNUM, U, Words, arrow, batch, id_and_text, pieces, span_hashes
from tabulith.session import cut_lineage

#: Rows trained on at most.
POSITIVE, UNLABELLED = 4000, 8000
BITS = 20
#: Beginnings of words, in bytes, besides the whole word.
STEMS = (4, 5, 6)
#: Features kept, the toxic training documents that must have one, and the standard errors that it must stand out by.
FEATURES, SUPPORT, STRENGTH = 4096, 3, 3.0
STEPS, RATE, RIDGE = 400, 0.05, 2e-4
#: The toxic share that is taken where all labels are toxic and none is given.
PRIOR = 0.05
FOLD = "crc32(cast(doc_id as string)) % 5 = 0"

SAMPLE = "doc_id bigint, features binary"
RESULT = "doc_id bigint, held_out boolean, score double, predicted int"


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every occurrence: whole words and their beginnings."""
    words = Words(data, at, IN_ALNUM, lower=True)
    size = words.ends - words.starts
    texts, out_text, out = words.texts(), [], []
    mask = U((1 << BITS) - 1)
    for n in (None, *STEMS):
        mine = slice(None) if n is None else size > n
        begin = words.starts[mine]
        hashes = span_hashes(words.data, begin, words.ends[mine] if n is None else begin + n)
        # A beginning is not the same feature as the word that is spelled like it.
        out.append(((hashes + U(0 if n is None else 1)) >> U(64 - BITS)) & mask)
        out_text.append(texts[mine])
    return np.concatenate(out_text), np.concatenate(out).astype(np.int64)


def sample_features(docs: DataFrame) -> DataFrame:
    schema = arrow(SAMPLE)

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for rows, data, at in pieces(batches):
            text, feature = features(data, at)
            pair = np.unique((text << BITS) | feature)
            cuts = np.searchsorted(pair >> BITS, np.arange(len(at)))
            own = (pair & ((1 << BITS) - 1)).astype(np.uint32)
            yield batch(schema, rows.column("doc_id"), [press.compress(np.diff(own[a:b], prepend=np.uint32(0)).tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    return docs.mapInArrow(run, SAMPLE)


class Sets:
    """Feature sets of texts, as two flat arrays."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        self.text = np.repeat(np.arange(self.n), [len(s) for s in sets])
        self.feature = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)

    def counts(self) -> np.ndarray:
        return np.bincount(self.feature, minlength=1 << BITS)

    def only(self, slot: np.ndarray) -> Sets:
        """Renamed to ``slot`` and without features that have none."""
        kept = slot[self.feature] >= 0
        self.text, self.feature = self.text[kept], slot[self.feature[kept]]
        return self

    def margins(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return bias + np.bincount(self.text, weights=weights[self.feature], minlength=self.n)

    def back(self, of_text: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.feature, weights=of_text[self.text], minlength=size)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def chosen_features(positive: Sets, unlabelled: Sets, prior: float, most: int = FEATURES, support: int = SUPPORT, least: float = STRENGTH) -> np.ndarray:
    """The features whose share among toxic texts differs most from that among the others."""
    p, u = positive.counts(), unlabelled.counts()
    share_p, share_u = p / max(positive.n, 1), u / max(unlabelled.n, 1)
    other = np.clip((share_u - prior * share_p) / max(1 - prior, 1e-9), 0, 1)
    spread = share_p * (1 - share_p) / max(positive.n, 1) + other * (1 - other) / max(unlabelled.n, 1) + 1e-9
    strength = np.where((p >= support) | (u >= 20 * support), np.abs(share_p - other) / np.sqrt(spread), 0)
    best = np.argsort(-strength, kind="stable")[:most]
    return np.sort(best[strength[best] > least])


def train(positive: Sets, unlabelled: Sets, prior: float, size: int, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk with the logistic loss."""
    theta = np.zeros(size + 1)
    theta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros(size + 1), np.zeros(size + 1)

    def gradient(sets: Sets, slope: np.ndarray) -> np.ndarray:
        return np.append(sets.back(slope, size), slope.sum()) / sets.n

    for step in range(1, steps + 1):
        at_p, at_u = _sigmoid(positive.margins(theta[:-1], theta[-1])), _sigmoid(unlabelled.margins(theta[:-1], theta[-1]))
        negative = -np.log(np.maximum(1 - at_u, 1e-12)).mean() + prior * np.log(np.maximum(1 - at_p, 1e-12)).mean()
        rest = gradient(unlabelled, at_u) - prior * gradient(positive, at_p)
        g = prior * gradient(positive, at_p - 1) + rest if negative >= 0 else -rest
        g[:-1] += ridge * theta[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta -= rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def learn(
    docs: DataFrame, labels: DataFrame, fold: str = FOLD, most_positive: int = POSITIVE, most_unlabelled: int = UNLABELLED, prior: float | None = None
) -> tuple[np.ndarray, float] | None:
    """A weight for every hashed feature and the bias; None without toxic rows."""
    ids = id_and_text(docs).select("doc_id").filter(f"doc_id is not null and not ({fold})")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic is not null")
    known = cut_lineage(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(ids, "doc_id", "left_semi"))
    total, toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    if not toxic:
        return None
    others = known
    if toxic == total:  # confirmed rows only: unlabelled texts come from the fold's other documents
        others = ids.distinct().join(known.select("doc_id"), "doc_id", "left_anti")
    prior = prior or (toxic / total if toxic < total else PRIOR)
    order = F.xxhash64("doc_id", F.lit(7))
    positive = known.filter("toxic = 1").orderBy(order, "doc_id").limit(most_positive).select("doc_id", F.lit(1).alias("positive"))
    unlabelled = others.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(most_unlabelled).select("doc_id", F.lit(0).alias("positive"))
    picked = cut_lineage(positive.unionByName(unlabelled))
    texts = by_ids(id_and_text(docs), cut_lineage(picked.select("doc_id").distinct()), "left_semi")
    unpress = zstandard.ZstdDecompressor()
    sets = {r.doc_id: np.cumsum(np.frombuffer(unpress.decompress(r.features), np.uint32), dtype=np.uint32) for r in sample_features(texts).collect()}
    p, u = [], []
    for r in sorted(picked.collect()):
        if r.doc_id in sets:
            (p if r.positive else u).append(sets[r.doc_id])
    if not p or not u:
        return None
    p, u = Sets(p), Sets(u)
    chosen = chosen_features(p, u, prior)
    slot = np.full(1 << BITS, -1)
    slot[chosen] = np.arange(len(chosen))
    weights, bias = train(p.only(slot), u.only(slot), prior, len(chosen))
    table = np.zeros(1 << BITS, np.float32)
    table[chosen] = weights
    return table, bias


def toxicity(docs: DataFrame, labels: DataFrame, fold: str = FOLD, **bounds) -> DataFrame:
    """Score every document."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, fold, **bounds))
    schema = arrow(RESULT)

    def run(batches):
        for rows, data, at in pieces(batches):
            score = np.zeros(rows.num_rows)
            if model.value is not None:
                table, bias = model.value
                text, feature = features(data, at)
                used = table[feature] != 0
                pair = np.unique((text[used] << BITS) | feature[used])
                score = _sigmoid(bias + np.bincount(pair >> BITS, weights=table[pair & ((1 << BITS) - 1)], minlength=rows.num_rows))
            yield batch(schema, rows.column("doc_id"), rows.column("held_out"), score, (score >= 0.5).astype(np.int32))

    return id_and_text(docs).withColumn("held_out", F.coalesce(F.expr(fold), F.lit(True))).mapInArrow(run, RESULT)
