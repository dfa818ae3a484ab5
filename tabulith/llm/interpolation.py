"""Language-model scores by deleted interpolation.

p(w | v) mixes three estimates: the bigram share c(v, w) / c(v), the word share
c(w) / N and the uniform 1 / (V + 1). The three weights depend on how often the
context was seen (one set per octave of c(v)) and are learned by expectation
maximisation on counts that were held out of the estimates. Every context keeps its own
counts, however rare (a caller may fold those below ``1 / head`` of all tokens into one class).

Three passes over the texts, each sending packed and locally added counts to
buckets of words: (1) word counts; (2) pair counts of the training texts, from which the
held-out evidence is gathered on a fixed grid; (3) pairs of all texts, whose terms are
added up per document. Words above ``1 / HEAD`` of all tokens (so at most HEAD) are
known everywhere; their pairs are dealt out by pair, not by word. Pairs above
``1 / HOT`` of all tokens (at most HOT) are scored where they are read and never sent.
Where the context is no frequent word, a pair's counts go on from the bucket of its word to
the bucket of its context, whose count is the sum over its pairs.

Edge cases: a null or empty text is the end token alone; without training text every
score is that of the uniform estimate over nothing seen, 0; a document without id
is neither trained on nor held out (``held_out`` false); repeated rows count as often
as they come.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm.words import IN_WORD, U, Words, arrow, batch, id_and_text, mix, pieces
from tabulith.session import cut_lineage, scratch

#: Frequent words are those with N / HEAD occurrences, hot pairs those with N / HOT.
HEAD, HOT = 1 << 18, 1 << 12
#: Words with fewer occurrences cannot be frequent and are not listed.
LISTED = 8
#: Steps of the evidence grid per octave, and its lowest octave.
STEPS, LOWEST = 4, 48
ROUNDS = 60
PIECE = 2 << 20
PER_PARTITION = 4

START, RARE = 0, 1
#: Contexts from here on are hashes of words that are not known everywhere, those below are places in ``Head.contexts``.
OWN = U(1 << 63)
#: Scores sent on to the buckets of their contexts at once.
SENT = 1 << 20
END = int(mix(np.array([0x656E64], U))[0])

EVIDENCE = "kind bigint, a bigint, b bigint, c bigint, n bigint"
PACKED = "bucket bigint, piece bigint, payload binary"
RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones and so on: they compress better."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize * (1 if a.dtype.kind != "f" else -1), len(a)))], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(_planes(a) for a in arrays))


def _unpack(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, place, out = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(-1, 2), 8 + 16 * n, []
    for size, length in head.tolist():
        kind = np.dtype(f"f{-size}") if size < 0 else np.dtype(f"u{size}")
        planes = np.frombuffer(raw, np.uint8, length * kind.itemsize, place).reshape(kind.itemsize, length)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(length))
        place += length * kind.itemsize
    return out


def token_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of each text, its end included, and the token that starts each text."""
    words = Words(data, at, IN_WORD, lower=True)
    n = len(words.counts)
    first = words.first + np.arange(n + 1)
    out = np.empty(first[-1], U)
    out[np.arange(len(words.starts)) + words.texts()] = words.hashes()
    out[first[1:] - 1] = U(END)
    return out, first


def _added(key: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys with the sums of their weights."""
    order = np.argsort(key)
    key = key[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[heads], *(np.add.reduceat(w[order], heads) if len(heads) else w[:0] for w in weights)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((mix(hashes) >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)


class Head:
    """What every task knows: frequent words with their counts, and the totals."""

    def __init__(self, rows: list, totals: dict, folded: bool):
        rows = sorted((int(U(np.int64(h).view(U))), e, n) for h, e, n in rows)
        self.words = np.array([r[0] for r in rows], U)
        self.counts = {"est": np.array([r[1] for r in rows], np.int64), "all": np.array([r[2] for r in rows], np.int64)}
        self.totals, self.folded = totals, folded
        words = self.words != U(END)
        #: occurrences as a context of: text starts, the class of rare words, each frequent word
        self.contexts = {k: np.concatenate([[totals[f"docs_{k}"]], [max(0, totals[f"n_{k}"] - totals[f"docs_{k}"] - int(c[words].sum()))], c]) for k, c in self.counts.items()}

    def slot(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.words):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return at, self.words[at] == hashes

    def short(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Frequent words as steps from place to place, and the hashes of the others; both come in order, frequent ones first."""
        at, known = self.slot(words)
        return np.diff(at[known], prepend=0).astype(np.uint32), words[~known]

    def long(self, steps: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The words of ``short``."""
        return np.concatenate([self.words[np.cumsum(steps, dtype=np.int64)], others])

    def context_ids(self, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        at, known = self.slot(tokens)
        out = np.empty(len(tokens), U)
        out[1:] = np.where(known, (at + 2).astype(U), U(RARE) if self.folded else tokens | OWN)[:-1]
        out[first[:-1]] = START
        return out

    def octave(self, which: str) -> np.ndarray:
        """The weight set of each context."""
        return np.where(np.arange(len(self.contexts[which])) == RARE, 0, _octave(self.contexts[which]))

    def word_counts(self, words: np.ndarray, own: np.ndarray, which: str) -> np.ndarray:
        """Counts of words: the known ones of frequent words, else ``own``."""
        at, known = self.slot(words)
        return np.where(known, self.counts[which][at] if len(self.words) else 0, own)


def _octave(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log2(np.maximum(counts, 1)).astype(np.int64)


def _split(contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts as short places, and the hashes of those that have none."""
    own = contexts >= OWN
    return np.where(own, U(RARE), contexts).astype(np.uint32), contexts[own]


def _joined(places: np.ndarray, own: np.ndarray) -> np.ndarray:
    out = places.astype(U)
    if len(own):  # then no context is in the class of rare ones
        out[places == RARE] = own
    return out


def _by_bucket(buckets: np.ndarray):
    """(bucket, its places) of each bucket."""
    order = np.argsort(buckets, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], buckets[order][1:] != buckets[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    ends = np.append(heads, len(order))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield int(buckets[order[a]]), order[a:b]


def _training(doc_ids) -> np.ndarray:
    return np.array(doc_ids.fill_null(False))


def word_counts(rows: DataFrame, buckets: int, parts: int) -> DataFrame:
    """Listed words with their estimate and training counts, and rows of totals (word null)."""

    def count(batches):
        for part, data, at in pieces(batches, limit=PIECE):
            tokens, first = token_hashes(data, at)
            trained, held = _training(part.column("trained")), _training(part.column("held"))
            kind = np.repeat(trained.astype(np.int64) + held, np.diff(first))  # 0 not trained on, 1 estimate, 2 held out
            tokens, kind = tokens[kind > 0], kind[kind > 0]
            words, est, every = _added(tokens, (kind == 1).astype(np.int64), np.ones(len(tokens), np.int64))
            where = _bucket(words, buckets)
            order = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts))
            yield batch(arrow(PACKED), full, np.zeros(len(full)), [_pack(*(x[order[cuts[b] : cuts[b + 1]]].astype(k) for x, k in ((words, U), (est, np.uint32), (every, np.uint32)))) for b in full])

    def add(batches):
        got = [_unpack(r) for rows in batches for r in rows.column("payload").to_pylist()]
        if not got:
            return
        words, est, every = _added(np.concatenate([g[0] for g in got]), *(np.concatenate([g[i] for g in got]).astype(np.int64) for i in (1, 2)))
        ends = words == U(END)
        schema = arrow("word bigint, est bigint, every bigint, v_est bigint, v_all bigint, docs_est bigint, docs_all bigint")
        yield batch(schema, [None], [int(est.sum())], [int(every.sum())], [int((est > 0).sum())], [len(words)], [int(est[ends].sum())], [int(every[ends].sum())])
        listed = (every >= LISTED) | ends
        none = [None] * int(listed.sum())
        yield batch(schema, words[listed].view(np.int64), est[listed], every[listed], none, none, none, none)

    ddl = "word bigint, est bigint, every bigint, v_est bigint, v_all bigint, docs_est bigint, docs_all bigint"
    return rows.mapInArrow(count, PACKED).repartition(parts, "bucket").mapInArrow(add, ddl)


def learn_head(rows: DataFrame, buckets: int, parts: int, head: int = HEAD, folded: bool = False) -> Head:
    counted = cut_lineage(word_counts(rows, buckets, parts))
    t = counted.filter("word is null").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counted.columns[1:])).first()
    totals = {"n_est": t.est, "n_all": t.every, "v_est": t.v_est, "v_all": t.v_all, "docs_est": t.docs_est, "docs_all": t.docs_all}
    frequent = counted.filter(F.col("word").isNotNull() & (F.col("every") * head >= t.every)).select("word", "est", "every")
    return Head([tuple(r) for r in frequent.collect()], totals, folded)


def _pair_bucket(head: Head, words: np.ndarray, contexts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a frequent word are dealt out by pair, others by word; which pairs are those of other words."""
    _, known = head.slot(words)
    return _bucket(np.where(known, words ^ mix(contexts.astype(U) + U(1)), words), buckets), ~known


def _pair_key(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(words * U(0x9E3779B97F4A7C15) + contexts.astype(U))


def pair_counts(rows: DataFrame, head, buckets: int, parts: int, most_hot: int = HOT) -> DataFrame:
    """Evidence on the grid (kind 0: octave, bigram and word steps, held-out count), hot pairs (kind 1) and counts for the bucket a of their contexts (kind 2)."""
    ddl = f"{EVIDENCE}, payload binary"

    def count(batches):
        h = head.value
        for part, data, at in pieces(batches, limit=PIECE):
            tokens, first = token_hashes(data, at)
            contexts = h.context_ids(tokens, first)
            trained, held = _training(part.column("trained")), _training(part.column("held"))
            kind = np.repeat(trained.astype(np.int64) + held, np.diff(first))
            keep = kind > 0
            tokens, contexts, kind = tokens[keep], contexts[keep], kind[keep]
            key = _pair_key(tokens, contexts)
            order = np.argsort(key)
            heads = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.zeros(0, np.int64)
            est, out = (np.add.reduceat((kind[order] == k).astype(np.int64), heads) if len(heads) else heads for k in (1, 2))
            tokens, contexts = tokens[order][heads], contexts[order][heads]
            where, other = _pair_bucket(h, tokens, contexts, buckets)
            order = np.lexsort((contexts, tokens, 2 * where + other))
            tokens, contexts, est, out = tokens[order], contexts[order], est[order].astype(np.uint32), out[order].astype(np.uint32)
            cuts = np.searchsorted(where[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts))
            payloads = []
            for b in full:
                mine = slice(cuts[b], cuts[b + 1])
                words, runs = _runs(tokens[mine])
                payloads.append(_pack(*h.short(words), runs, *_split(contexts[mine]), est[mine], out[mine]))
            yield batch(arrow(PACKED), full, np.zeros(len(full)), payloads)

    def evidence(batches):
        held: dict[int, list] = {}
        for rows in batches:
            for bucket, raw in zip(*(rows.column(c).to_pylist() for c in ("bucket", "payload")), strict=True):
                held.setdefault(bucket, []).append(raw)
        for bucket in list(held):
            yield from of_bucket([_unpack(raw) for raw in held.pop(bucket)])

    def of_bucket(got):
        h = head.value
        words = np.concatenate([np.repeat(h.long(g[0], g[1]), g[2]) for g in got])
        contexts = np.concatenate([_joined(g[3], g[4]) for g in got])
        est, out = (np.concatenate([g[i] for g in got]) for i in (5, 6))
        key = _pair_key(words, contexts)
        order = np.argsort(key)
        heads = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        words, contexts = words[order][heads], contexts[order][heads]
        est, out = (np.add.reduceat(x[order].astype(np.int64), heads) for x in (est, out))
        total, n_est = h.totals["n_all"], max(h.totals["n_est"], 1)
        own = contexts >= OWN
        hot = ((est + out) * most_hot >= total) & h.slot(words)[1] & ~own
        schema = arrow(ddl)
        yield batch(schema, np.ones(hot.sum()), words[hot].view(np.int64), contexts[hot].astype(np.int64), np.zeros(hot.sum()), (est + out)[hot], [None] * int(hot.sum()))
        distinct, slot = np.unique(words, return_inverse=True)
        local = np.bincount(slot, weights=est, minlength=len(distinct)).astype(np.int64)
        step = _step(h.word_counts(distinct, local, "est")[slot] / n_est)
        held = (out > 0) & ~own
        places = contexts[held].astype(np.int64)
        cells, weight = _cells(h.octave("est")[places], est[held] / np.maximum(h.contexts["est"][places], 1), step[held], out[held])
        yield batch(schema, np.zeros(len(cells)), cells[:, 0], cells[:, 1], cells[:, 2], weight, [None] * len(cells))
        # Of an unknown context each pair with held-out counts goes on, and the sum of all its pairs here.
        held, (of, add) = (out > 0) & own, _added(contexts[own], est[own])
        pairs = dict(_by_bucket(_bucket(contexts[held], buckets)))
        for b, mine in _by_bucket(_bucket(of, buckets)):
            its = np.flatnonzero(held)[pairs.get(b, np.zeros(0, np.int64))]
            payload = _pack(of[mine], add[mine].astype(U), contexts[its], est[its].astype(U), step[its].astype(np.uint32), out[its].astype(U))
            yield batch(schema, [2], [b], [0], [0], [0], [payload])

    return rows.filter("trained").mapInArrow(count, PACKED).repartition(parts, "bucket").mapInArrow(evidence, ddl)


def own_evidence(sent: DataFrame, parts: int) -> DataFrame:
    """Evidence on the grid from the contexts that are not known everywhere."""

    def cells_of(batches):
        held: dict[int, list] = {}
        for rows in batches:
            for bucket, raw in zip(*(rows.column(c).to_pylist() for c in ("a", "payload")), strict=True):
                held.setdefault(bucket, []).append(raw)
        for bucket in list(held):
            got = [_unpack(raw) for raw in held.pop(bucket)]
            of, add, contexts, est, step, out = (np.concatenate([g[i] for g in got]) for i in range(6))
            of, add = _added(of, add.astype(np.int64))
            counts = add[np.searchsorted(of, contexts)]
            cells, weight = _cells(_octave(counts), est / np.maximum(counts, 1), step.astype(np.int64), out.astype(np.int64))
            yield batch(arrow(EVIDENCE), np.zeros(len(cells)), cells[:, 0], cells[:, 1], cells[:, 2], weight)

    return sent.repartition(parts, "a").mapInArrow(cells_of, EVIDENCE)


def _cells(octave: np.ndarray, pair_share: np.ndarray, step: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells of the grid with their held-out counts."""
    cells, slot = np.unique(np.stack([octave, _step(pair_share), step], 1), axis=0, return_inverse=True)
    return cells, np.bincount(slot.ravel(), weights=out, minlength=len(cells)).astype(np.int64)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[heads], np.diff(np.append(heads, len(values))).astype(np.uint32)


def _step(share: np.ndarray) -> np.ndarray:
    """Grid step of a share: 0 for none, else by quarter octaves."""
    return np.where(share > 0, 1 + np.clip(np.rint((np.log2(np.maximum(share, 1e-30)) + LOWEST) * STEPS), 0, LOWEST * STEPS), 0).astype(np.int64)


def _share(step: np.ndarray) -> np.ndarray:
    return np.where(step > 0, 2.0 ** ((step - 1) / STEPS - LOWEST), 0.0)


def mixture_weights(cells: np.ndarray, uniform: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of bigram, word and uniform estimate for each octave, by expectation maximisation.

    ``cells`` has rows (octave, bigram step, word step, held-out count). An octave
    without evidence takes the weights of all together.
    """
    size = 66
    out = np.tile([1 / 3, 1 / 3, 1 / 3], (size, 1))
    if not len(cells):
        out[:] = [0.0, 0.0, 1.0]
        return out

    def fit(rows: np.ndarray) -> np.ndarray:
        parts = np.stack([_share(rows[:, 1]), _share(rows[:, 2]), np.full(len(rows), uniform)], 1)
        weight, mix_of = rows[:, 3] / rows[:, 3].sum(), np.full(3, 1 / 3)
        for _ in range(rounds):
            joint = parts * mix_of
            mix_of = (weight[:, None] * joint / joint.sum(1, keepdims=True)).sum(0)
            mix_of = np.maximum(mix_of, 1e-6)
            mix_of /= mix_of.sum()
        return mix_of

    out[:] = fit(cells)
    for octave in np.unique(cells[:, 0]):
        out[octave] = fit(cells[cells[:, 0] == octave])
    return out


class Model:
    """Head, weights and hot pairs: all a term needs besides the counts of rarer words and pairs."""

    def __init__(self, head: Head, weights: np.ndarray, hot: list):
        self.head, self.weights = head, weights
        hot = sorted((int(_pair_key(np.array([np.int64(w)]).view(U), np.array([c]))[0]), n) for w, c, n in hot)
        self.hot_keys, self.hot_counts = np.array([k for k, _ in hot], U), np.array([n for _, n in hot], np.int64)

    def base(self, single: np.ndarray) -> np.ndarray:
        t = self.head.totals
        return np.log10((single + 1) / (t["n_all"] + t["v_all"] + 1))

    def mixture(self, octave: np.ndarray, counts: np.ndarray, pair: np.ndarray, single: np.ndarray) -> np.ndarray:
        """log10 of the mixture for pairs whose context has these counts."""
        t, mine = self.head.totals, self.weights[octave]
        p = mine[:, 0] * pair / np.maximum(counts, 1) + mine[:, 1] * single / max(t["n_all"], 1) + mine[:, 2] / (t["v_all"] + 1)
        return np.log10(np.maximum(p, 1e-300))

    def terms(self, contexts: np.ndarray, pair: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the base and of the mixture for pairs with known counts; 0 for the mixture of contexts with none."""
        score, at = np.zeros(len(contexts)), np.flatnonzero(contexts < OWN)
        places = contexts[at].astype(np.int64)
        score[at] = self.mixture(self.head.octave("all")[places], self.head.contexts["all"][places], pair[at], single[at])
        return self.base(single), score


def partial_scores(rows: DataFrame, model, buckets: int, parts: int) -> DataFrame:
    """Per piece: rows with its documents (bucket -1), rows of sums over its documents (-2), and counts for the buckets of their contexts."""

    def send(batches):
        m = model.value
        number = TaskContext.get().partitionId() << 32
        for part, data, at in pieces(batches, limit=PIECE):
            tokens, first = token_hashes(data, at)
            contexts = m.head.context_ids(tokens, first)
            docs = part.num_rows
            trained = _training(part.column("trained"))
            doc = np.repeat(np.arange(docs, dtype=np.int64), np.diff(first))
            key = _pair_key(tokens, contexts)
            slot = np.minimum(np.searchsorted(m.hot_keys, key), max(len(m.hot_keys) - 1, 0)) if len(m.hot_keys) else np.zeros(len(key), np.int64)
            hot = m.hot_keys[slot] == key if len(m.hot_keys) else np.zeros(len(key), bool)
            base, score = m.terms(contexts[hot], m.hot_counts[slot[hot]], m.head.word_counts(tokens[hot], np.zeros(hot.sum(), np.int64), "all")) if hot.any() else (np.zeros(0), np.zeros(0))
            ids = part.column("doc_id").to_pylist()
            info = _pack(
                np.array([i or 0 for i in ids], np.int64).view(U), np.array([i is not None for i in ids], np.uint8), np.array(part.column("out").fill_null(False)).astype(np.uint8), np.diff(first).astype(np.uint32),
                np.bincount(doc[hot], minlength=docs).astype(np.uint32), np.bincount(doc[hot], weights=base, minlength=docs), np.bincount(doc[hot], weights=score, minlength=docs),
            )
            tokens, contexts, doc, key = tokens[~hot], contexts[~hot], doc[~hot], key[~hot]
            where, other = _pair_bucket(m.head, tokens, contexts, buckets)
            order = np.lexsort((doc, contexts, tokens, 2 * where + other))
            tokens, contexts, doc, where = tokens[order], contexts[order], doc[order], where[order]
            cuts = np.searchsorted(where, np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts))
            payloads = []
            for b in full:
                mine = slice(cuts[b], cuts[b + 1])
                words, runs = _runs(tokens[mine])
                # A pair's tokens are neighbours: contexts as runs within the word's run.
                edge = np.concatenate([[True], (tokens[mine][1:] != tokens[mine][:-1]) | (contexts[mine][1:] != contexts[mine][:-1])])
                heads = np.flatnonzero(edge)
                payloads.append(_pack(*m.head.short(words), runs, *_split(contexts[mine][heads]), np.diff(np.append(heads, len(edge))).astype(np.uint32), doc[mine].astype(np.uint32), np.packbits(trained), np.array([docs], np.uint32)))
            yield batch(arrow(PACKED), np.append(full, number % buckets), np.full(len(full) + 1, number), [*payloads, b"i" + info])
            number += 1

    def score(batches):
        m = model.value
        held: dict[int, list] = {}
        for rows in batches:
            for bucket, piece, raw in zip(*(rows.column(c).to_pylist() for c in ("bucket", "piece", "payload")), strict=True):
                if raw[:1] == b"i":
                    yield batch(arrow(PACKED), [-1], [piece], [raw[1:]])
                else:
                    held.setdefault(bucket, []).append((piece, raw))
        sums: dict[int, list] = {}
        own: list[tuple] = []
        for bucket in list(held):  # one bucket's tokens at a time
            got = [(piece, _unpack(raw)) for piece, raw in held.pop(bucket)]
            words = np.concatenate([np.repeat(m.head.long(g[0], g[1]), g[2]) for _, g in got])
            contexts = np.concatenate([np.repeat(_joined(g[3], g[4]), g[5]) for _, g in got])
            trained = np.concatenate([np.unpackbits(g[7])[: int(g[8][0])][g[6]] for _, g in got])
            distinct, slot = np.unique(words, return_inverse=True)
            single = m.head.word_counts(distinct, np.bincount(slot, weights=trained, minlength=len(distinct)).astype(np.int64), "all")[slot]
            _, slot = np.unique(_pair_key(words, contexts), return_inverse=True)
            pair = np.bincount(slot, weights=trained)[slot]
            base, p = m.terms(contexts, pair, single)
            far = np.flatnonzero(contexts >= OWN)
            if len(far):
                number, docs_of = np.repeat([piece for piece, _ in got], [len(g[6]) for _, g in got])[far], np.repeat([int(g[8][0]) for _, g in got], [len(g[6]) for _, g in got])[far]
                own.append((contexts[far], pair[far].astype(U), single[far].astype(U), trained[far].astype(np.uint8), number.astype(U), docs_of.astype(np.uint32), np.concatenate([g[6] for _, g in got])[far].astype(np.uint32)))
                if sum(len(x[0]) for x in own) > SENT:
                    yield from send_on(own)
                    own = []
            end = 0
            for piece, g in got:
                begin, end, docs = end, end + len(g[6]), int(g[8][0])
                doc, known = g[6].astype(np.int64), single[begin:end] > 0
                mine = [np.bincount(doc[known], minlength=docs), np.bincount(doc, weights=base[begin:end], minlength=docs), np.bincount(doc, weights=p[begin:end], minlength=docs)]
                sums[piece] = [x + y for x, y in zip(sums[piece], mine, strict=True)] if piece in sums else mine
        yield from send_on(own)
        for piece, (known, base, p) in sums.items():
            yield batch(arrow(PACKED), [-2], [piece], [_pack(known.astype(np.uint32), base, p)])

    def send_on(own):
        if not own:
            return
        columns = [np.concatenate([x[i] for x in own]) for i in range(7)]
        order = np.lexsort((columns[6], columns[4], columns[0]))  # by context, piece, document: they compress better
        columns = [c[order] for c in columns]
        for b, mine in _by_bucket(_bucket(columns[0], buckets)):
            contexts, pair, single, trained, number, docs_of, doc = (c[mine] for c in columns)
            of, runs = _runs(contexts)
            pieces_, slot = np.unique(number, return_inverse=True)
            docs = np.zeros(len(pieces_), np.uint32)
            docs[slot] = docs_of
            yield batch(arrow(PACKED), [b], [0], [_pack(of, runs, pair.astype(np.uint32), single, np.packbits(trained), slot.astype(np.uint32), doc, pieces_, docs)])

    return rows.mapInArrow(send, PACKED).repartition(parts, "bucket").mapInArrow(score, PACKED)


def own_scores(partial: DataFrame, model, parts: int) -> DataFrame:
    """Scores of the contexts that are not known everywhere, as sums; the sums that are there already are added up per piece."""

    def score(batches):
        m = model.value
        held: dict[int, list] = {}
        sums: dict[int, list] = {}
        for rows in batches:
            for bucket, piece, raw in zip(*(rows.column(c).to_pylist() for c in ("bucket", "piece", "payload")), strict=True):
                if bucket == -1:
                    yield batch(arrow(PACKED), [-1], [piece], [raw])
                elif bucket == -2:
                    got = _unpack(raw)
                    sums[piece] = [a + b for a, b in zip(sums[piece], got, strict=True)] if piece in sums else got
                else:
                    held.setdefault(bucket, []).append(raw)
        for bucket in list(held):
            got = [_unpack(raw) for raw in held.pop(bucket)]
            contexts = np.concatenate([np.repeat(g[0], g[1]) for g in got])
            trained = np.concatenate([np.unpackbits(g[4])[: len(g[2])] for g in got])
            pair, single = (np.concatenate([g[i] for g in got]) for i in (2, 3))
            distinct, slot = np.unique(contexts, return_inverse=True)
            counts = np.bincount(slot, weights=trained, minlength=len(distinct)).astype(np.int64)[slot]
            p = m.mixture(_octave(counts), counts, pair.astype(np.int64), single.astype(np.int64))
            number = np.concatenate([g[7][g[5]] for g in got])
            docs, doc = np.concatenate([g[8][g[5]] for g in got]), np.concatenate([g[6] for g in got]).astype(np.int64)
            for piece, mine in _by_bucket(number.view(np.int64)):
                n = int(docs[mine[0]])
                own = [np.zeros(n, np.uint32), np.zeros(n), np.bincount(doc[mine], weights=p[mine], minlength=n)]
                sums[piece] = [a + b for a, b in zip(sums[piece], own, strict=True)] if piece in sums else own
        for piece, own in sums.items():
            yield batch(arrow(PACKED), [-2], [piece], [_pack(own[0].astype(np.uint32), *own[1:])])

    place = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.col("piece"))
    return partial.repartition(parts, place).mapInArrow(score, PACKED)


def lm_scores(docs: DataFrame, out: str = "crc32(cast(doc_id as string)) % 7 = 2", held: str = "crc32(cast(doc_id as string)) % 7 = 3", head: int | None = None, known: int = HEAD) -> DataFrame:
    """Score every document; ``out`` marks documents that nothing is learned from, ``held`` those that the weights are learned from.

    With ``head``, contexts below ``1 / head`` of all tokens are one class; without it, each has its own counts, and words
    above ``1 / known`` are those known everywhere.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs).select("doc_id", "text", F.expr(out).alias("out"), F.expr(f"doc_id is not null and not ({out})").alias("trained"), F.expr(f"doc_id is not null and not ({out}) and ({held})").alias("held"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = PER_PARTITION * parts
    folded, size = head is not None, head or known
    # The counts serve the model alone: their tables are gone before the scores are shuffled.
    with scratch(spark):
        words = learn_head(rows, buckets, parts, size, folded)
        sent = spark.sparkContext.broadcast(words)
        # The word of a hot pair has to be a frequent one.
        found = cut_lineage(pair_counts(rows, sent, buckets, parts, min(HOT, size)))
        evidence = found.filter("kind = 0").select("a", "b", "c", "n")
        if not folded:
            evidence = evidence.union(own_evidence(found.filter("kind = 2").select("a", "payload"), parts).select("a", "b", "c", "n"))
        cells = np.array([tuple(r) for r in evidence.groupBy("a", "b", "c").agg(F.sum("n").alias("n")).collect()], np.int64).reshape(-1, 4)
        hot = [tuple(r) for r in found.filter("kind = 1").select("a", "b", "n").collect()]
    model = Model(words, mixture_weights(cells, 1 / (words.totals["v_est"] + 1)), hot)
    total = words.totals["n_all"]
    shared = spark.sparkContext.broadcast(model)
    partial = partial_scores(rows, shared, buckets, parts)
    if not folded:
        partial = own_scores(partial, shared, parts)

    def finish(batches):
        sums: dict[int, list] = {}
        info: dict[int, list] = {}
        for part in batches:
            for bucket, piece, raw in zip(*(part.column(c).to_pylist() for c in ("bucket", "piece", "payload")), strict=True):
                got = _unpack(raw)
                if bucket == -1:
                    info[piece] = got
                elif piece in sums:
                    sums[piece] = [a + b for a, b in zip(sums[piece], got, strict=True)]
                else:
                    sums[piece] = got
        for piece, (ids, named, out_of, tokens, *own) in info.items():
            known_n, base, score = ([a + b for a, b in zip(own, sums[piece], strict=True)] if piece in sums else own)
            yield batch(arrow(RESULT), [int(i) if k else None for i, k in zip(ids.view(np.int64), named, strict=True)], out_of.astype(bool), tokens.astype(np.int64), known_n.astype(np.int64), np.full(len(ids), total), base, score)

    return partial.repartition(parts, "piece").mapInArrow(finish, RESULT)
