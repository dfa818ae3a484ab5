"""Near-duplicates by HyperMinHash signatures, banding, estimation and exact confirmation.

A document is the set of its distinct word shingles. Its signature has one register
per hash bucket: the bucket's smallest hash as a leading-zero count and the mantissa
bits that follow. Bands of registers bring candidates together; the share of equal
registers, corrected for the collisions that short registers have by chance, drops
those that are clearly different; the full sets confirm the rest. With 48 bands of 6
registers a pair at similarity 0.8 shares no band with a probability of 5e-7, at 0.85 of 2e-10.

Equal sets are collapsed before anything is paired. Members of a band's bucket are
compared with the bucket's smallest member first (as many pairs as members). When those
links have been followed, members that share a bucket with a set of another component
and could be similar to it are compared across components by exact prefix filtering. So a large
group of copies or near copies costs pairs in proportion to its size, and no link
between different components is passed over.

Edge cases: a text without words is an empty set and linked with nothing; a text
shorter than a shingle is one shingle; a document without an id keeps its own row
(component null, kept); rows with equal ids and texts are answered one by one, each
with the same result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabulith.llm.joins import by_ids, components, union_all
from tabulith.llm.words import IN_WORD, U, Words, arrow, batch, id_and_text, mix, pieces, release_memory, window_hashes
from tabulith.session import cut_lineage

SHINGLE = 5
#: Similarity as a percentage: links have 100 * intersection >= PERCENT * union.
PERCENT = 80
BANDS, ROWS, MANTISSA = 48, 6, 10
#: Estimates this far below the threshold are dropped (six standard errors at 288 registers).
MARGIN = 0.15
#: Registers are 16 bits: the exponent of the smallest value of 32 bits, then the mantissa.
EMPTY = 0xFFFF

#: Registers whose last bit goes into the sketch, and how many of the bits may differ: at the threshold
#: a tenth of them does, 26 with a standard error of 5.
SKETCH, DIFFERENT = 256, 56

SIGNATURES = "doc_id bigint, n_shingles bigint, set_hash binary, signature binary, s0 bigint, s1 bigint, s2 bigint, s3 bigint"
SETS = "doc_id bigint, shingles binary"
PAIR = "a bigint, b bigint"


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(data, at, IN_WORD, lower=True)
    hashes = words.hashes()
    windows = window_hashes(hashes, k)
    out = []
    for i, n in enumerate(words.counts):
        first = words.first[i]
        if n >= k:
            out.append(np.unique(windows[first : first + n - k + 1]))
        else:  # the whole sequence, told apart from longer shingles by its length
            out.append(window_hashes(hashes[first : first + n], n) if n else np.zeros(0, U))
    return out


def signature(shingles: np.ndarray, registers: int, mantissa: int = MANTISSA) -> np.ndarray:
    """Registers of one set: per bucket the compressed smallest value, or EMPTY."""
    out = np.full(registers, EMPTY, np.uint16)
    if len(shingles):
        scaled = (shingles >> U(32)) * U(registers)
        bucket = (scaled >> U(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        value = ((scaled[first] & U(0xFFFFFFFF)) + U(1)).astype(np.float64)
        bits = value.view(U) >> U(52 - mantissa)
        out[bucket[first]] = (bits - U(1023 << mantissa)).astype(np.uint16)
    return out


def sketch(registers: np.ndarray) -> list[int]:
    """The last bits of the first registers as four 64-bit numbers; EMPTY counts as 0."""
    bits = np.zeros(SKETCH, np.uint8)
    used = registers[:SKETCH]
    bits[: len(used)] = np.where(used == EMPTY, 0, used & 1)
    return np.packbits(bits).view(np.int64).tolist()


def collision_table(registers: int, mantissa: int = MANTISSA, steps: int = 48) -> np.ndarray:
    """Chance that filled registers of two unrelated sets agree, by the log2 sizes of the sets (halves).

    The smallest of n' = n / registers values falls into a register's interval with the
    difference of two powers; coarse intervals are summed and shared out over the mantissa.
    """
    edges = np.concatenate([2.0 ** np.arange(-32, 0)[:, None] * (1 + np.arange(16) / 16), [[1.0] * 16]]).ravel()[: 32 * 16 + 1]
    sizes = 2.0 ** (np.arange(steps) / 2) / registers
    above = (1 - edges)[None, :] ** np.maximum(sizes, 1)[:, None]
    mass = above[:, :-1] - above[:, 1:]
    return (mass @ mass.T) / 2.0 ** (mantissa - 4)


def estimates(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of rows of signatures."""
    filled = (left != EMPTY) | (right != EMPTY)
    both = (left != EMPTY) & (right != EMPTY)
    same = ((left == right) & both).sum(1)
    size = lambda n: np.minimum((2 * np.log2(np.maximum(n, 1))).round().astype(int), len(table) - 1)
    chance = table[size(n_left), size(n_right)] * both.sum(1)
    total = np.maximum(filled.sum(1), 1)
    return (same - chance) / np.maximum(total - chance, 1e-9)


def signatures(docs: DataFrame, k: int, registers: int) -> DataFrame:
    schema = arrow(SIGNATURES)

    def run(batches):
        for rows, data, at in pieces(batches):
            sets = shingle_sets(data, at, k)
            signed = [signature(s, registers) if len(s) else None for s in sets]
            sketches = [[None] * 4 if s is None else sketch(s) for s in signed]
            yield batch(
                schema, rows.column("doc_id"), [len(s) for s in sets], [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                [None if s is None else s.tobytes() for s in signed], *([x[i] for x in sketches] for i in range(4)),
            )

    return id_and_text(docs).mapInArrow(run, SIGNATURES)


def band_rows(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """(band key, id) for every band with a filled register."""
    schema = arrow("key bigint, id bigint")

    def run(batches):
        with np.errstate(over="ignore"):
            weights = mix(np.arange(1, rows + 1, dtype=U))
            for part in batches:
                if not part.num_rows:
                    continue
                registers = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(part.num_rows, bands, rows)
                keys = mix(mix((registers.astype(U) + U(1)) * weights).sum(2, dtype=U) + np.arange(bands, dtype=U) * U(0x9E3779B97F4A7C15))
                filled = (registers != EMPTY).any(2)
                ids = np.repeat(np.array(part.column("doc_id")), bands).reshape(-1, bands)
                yield batch(schema, keys[filled].view(np.int64), ids[filled])

    return reps.select("doc_id", "signature").mapInArrow(run, "key bigint, id bigint")


def alike(pairs: DataFrame, reps: DataFrame, percent: int, registers: int, margin: float) -> DataFrame:
    """Pairs whose sizes and estimates allow the threshold."""
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    schema = arrow(PAIR)

    def run(batches):
        table = collision_table(registers)
        for part in batches:
            if not part.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, registers) for c in ("s_a", "s_b"))
            good = estimates(left, right, np.array(part.column("n_a")), np.array(part.column("n_b")), table) >= percent / 100 - margin
            yield batch(schema, np.array(part.column("a"))[good], np.array(part.column("b"))[good])
            del part, left, right, good
        release_memory()

    return sized.mapInArrow(run, PAIR)


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    schema = arrow(SETS)

    def run(batches):
        for rows, data, at in pieces(batches):
            yield batch(schema, rows.column("doc_id"), [s.tobytes() for s in shingle_sets(data, at, k)])

    return docs.mapInArrow(run, SETS)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that meet the threshold on their full sets."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("s_a")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("s_b")), "b")
    schema = arrow(PAIR)

    def run(batches):
        for part in batches:
            a, b = np.array(part.column("a")), np.array(part.column("b"))
            good = np.zeros(len(a), bool)
            for i in range(len(a)):
                left, right = (np.frombuffer(part.column(c)[i].as_buffer(), U) for c in ("s_a", "s_b"))
                if len(left) > len(right):
                    left, right = right, left
                slot = np.searchsorted(right, left)
                shared = int((right[np.minimum(slot, len(right) - 1)] == left).sum())
                good[i] = 100 * shared >= percent * (len(left) + len(right) - shared)
            yield batch(schema, a[good], b[good])
            del part, a, b, good
        release_memory()

    return both.mapInArrow(run, PAIR)


def undecided(shared: DataFrame, found: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Ids that share a bucket with a set of another component which could meet the threshold.

    Sizes and sketches are compared inside semi joins: they give each member once,
    however many partners it has. Only members outside a bucket's most frequent
    component meet all others, so a large family of one component is never compared
    with itself; its members meet the few strangers from their side.
    """
    labelled = cut_lineage(labels(shared.select("key", "id"), found, "id"))
    held = labelled.groupBy("key", "component").count()
    mixed = held.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count("*").alias("components")).filter("components > 1").select("key", "main")
    bits = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").cast("int").alias("n"), "s0", "s1", "s2", "s3")
    left = cut_lineage(labelled.join(mixed, "key").join(bits, "id"))
    differ = " + ".join(f"bit_count(a.s{i} ^ b.s{i})" for i in range(4))
    close = F.expr(f"a.key = b.key and a.component <> b.component and 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) and {differ} <= {DIFFERENT}")
    strangers, family = left.filter("component <> main"), left.filter("component = main")
    met = [strangers.alias("a").join(left.alias("b"), close, "left_semi"), family.alias("a").join(strangers.alias("b"), close, "left_semi")]
    return union_all([m.select(F.col("id").alias("doc_id")) for m in met]).distinct()


def labels(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``rows`` with the component of ``key``; what has no link is its own component."""
    return rows.join(found.withColumnRenamed("node", key), key, "left").withColumn("component", F.coalesce("component", key))


def across(sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that may meet the threshold, by exact prefix filtering.

    With shingles in order of their frequency, two sets at the threshold share one
    among the first few of each: the smaller set's first n - ceil(2t / (1 + t) n) + 1,
    the larger set's first n - ceil(t n) + 1. What a large family has in common is
    frequent and comes last, so members that differ too much never meet or meet too
    late. A shingle's most frequent component is only paired with the others.
    """
    def explode(batches):
        for rows in batches:
            for i, raw in zip(rows.column("doc_id").to_pylist(), rows.column("shingles"), strict=True):
                own = np.frombuffer(raw.as_buffer(), np.int64)
                yield batch(arrow("id bigint, n bigint, shingle bigint"), np.full(len(own), i), np.full(len(own), len(own)), own)
            del rows
        release_memory()

    tokens = sets.mapInArrow(explode, "id bigint, n bigint, shingle bigint").distinct()
    common = tokens.groupBy("shingle").count().filter("count > 1")
    # Shingles of one set only come first and match nothing: their number is all that is needed of them.
    kept = labels(tokens.join(common, "shingle"), found, "id")
    w = W.partitionBy("id", "n")
    placed = kept.withColumn("place", F.col("n") - F.count("*").over(w) + F.row_number().over(w.orderBy("count", "shingle")))
    probe, index = (F.col("n") - F.ceil(F.lit(x) * F.col("n") / y) + 1 for x, y in ((percent, 100), (2 * percent, 100 + percent)))
    first = cut_lineage(placed.filter(F.col("place") <= probe).select("shingle", "id", "n", "place", "component", (F.col("place") <= index).alias("indexed")))
    groups = first.groupBy("shingle", "component").count().groupBy("shingle").agg(F.max_by("component", "count").alias("main"), F.count("*").alias("components")).filter("components > 1")
    mixed = first.join(groups.select("shingle", "main"), "shingle")
    other, every = mixed.filter("component <> main").alias("a"), mixed.alias("b")
    smaller = "(a.n < b.n or (a.n = b.n and a.id < b.id))"
    # At the first shingle that two sets share, all they can share is what follows it in both.
    enough = f"(1 + least(a.n - a.place, b.n - b.place)) * (100 + {percent}) >= {percent} * (a.n + b.n)"
    meet = F.expr(f"a.shingle = b.shingle and a.component <> b.component and {enough} and if({smaller}, a.indexed, b.indexed)")
    return other.join(every, meet).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, margin: float = MARGIN) -> DataFrame:
    """Per document: set size, the smallest id it is linked with through any chain, and whether it is that one."""
    registers = bands * rows
    texts = id_and_text(docs)
    signed = cut_lineage(signatures(texts, shingle, registers))
    named = signed.filter("doc_id is not null and set_hash is not null")
    # One representative per set; its copies follow it whatever happens.
    reps = cut_lineage(named.groupBy("set_hash").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), *(F.first(c).alias(c) for c in ("signature", "s0", "s1", "s2", "s3"))))

    placed = band_rows(reps, bands, rows)
    heads = placed.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("n")).filter("n > 1")
    shared = cut_lineage(placed.join(heads, "key").select("key", "id", "head"))

    def sets_of(ids: DataFrame) -> DataFrame:
        return cut_lineage(full_sets(by_ids(texts, cut_lineage(ids), "left_semi"), shingle).distinct())

    stars = shared.filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    tried = cut_lineage(alike(stars, reps, percent, registers, margin))
    ends = tried.select(F.col("a").alias("doc_id")).unionByName(tried.select(F.col("b").alias("doc_id"))).distinct()
    first = cut_lineage(confirmed(tried, sets_of(ends), percent))
    known = cut_lineage(components(first))
    sets = sets_of(undecided(shared, known, reps, percent))
    pairs = across(sets, known, percent).join(tried, ["a", "b"], "left_anti")
    second = cut_lineage(confirmed(cut_lineage(alike(pairs, reps, percent, registers, margin)), sets, percent))
    found = components(first.unionByName(second))

    named_sets = reps.select("set_hash", F.col("doc_id").alias("node")).join(found, "node", "left").select("set_hash", F.coalesce("component", "node").alias("component_id"))
    answered = signed.select("doc_id", "n_shingles", "set_hash").join(named_sets, "set_hash", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return answered.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))
