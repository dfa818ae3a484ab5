"""Ranked search, the Merkle manifest and the vector index against brute force and their SQL twins."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulith.llm import merkle, multi_index, queries, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.mark.parametrize("name", ["op11_range_maximum_search", "op12_merkle_manifest", "op13_multi_index_vectors"])
def test_twin(spark, data, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    twin = con.execute(queries.ORACLES[name])
    names = [c[0] for c in twin.description]
    rows = queries.QUERIES[name](spark, data)
    assert rows.columns == names
    got = sorted(map(tuple, rows.collect()))
    assert got and got == sorted(twin.fetchall())


# --- ranked search -----------------------------------------------------------


def expected_ranks(docs, items, k):
    texts = [(r.doc_id, Counter(t.translate(LOWER) for t in TERM.findall(r.text or ""))) for r in docs.collect()]
    texts = [(i, c, sum(c.values())) for i, c in texts if c]
    n, total = len(texts), sum(size for _, _, size in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for t, f in df.items()}
    out = Counter()
    for item in items.collect():
        terms = {t.translate(LOWER) for t in TERM.findall(item.text or "")}
        scores = [(sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 20 * (50 + 50 * size * n // total))) for t in terms if t in c), i) for i, c, size in texts]
        best = sorted((x for x in scores if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out.update((item.item_id, r + 1, i, score) for r, (score, i) in enumerate(best))
    return out


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        (1, "The river of DATA, stone!"), (1, "The river of DATA, stone!"), (2, "straße naïve River's"), (3, None), (4, " ... "), (5, "word"), (None, "é changed"),
        (6, "nowhere-to-be-found"), (7, "a b c d e f g h i j license text under one id word one two"),
    ]
    return spark.createDataFrame(rows, "item_id long, text string").withColumns({c: F.lit(1) for c in ("doc_id", "rank", "number", "salt")})


@pytest.mark.parametrize("segment", [1 << 10, 4 << 20])
@pytest.mark.parametrize("k", [1, 3, 50])
def test_ranked(odd, items, monkeypatch, segment, k):
    monkeypatch.setattr(ranked, "SHORT", 2)
    monkeypatch.setattr(ranked, "WIDTH", 1)
    found = ranked.ranked_search(odd.repartition(3, "doc_id"), items, k=k, segment=segment, block_words=4 if k == 3 else 200_000)
    assert Counter(map(tuple, found.collect())) == expected_ranks(odd, items, k)


def test_ranked_documents(docs, spark, data):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    many = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10_000))
    found = ranked.ranked_search(many, items, k=20, segment=1 << 16)
    assert Counter(map(tuple, found.collect())) == expected_ranks(many, items, 20)


def test_ranked_empty(odd, empty, items):
    assert ranked.ranked_search(empty, items).collect() == []
    assert ranked.ranked_search(odd, items.limit(0)).collect() == []
    assert ranked.ranked_search(odd.filter("doc_id = 8"), items).collect() == []


def test_search_opens_few_intervals():
    """Intervals below the threshold stay closed: most postings of a long list are never scored."""
    n = 50_000
    rng = np.random.default_rng(3)
    tf = np.where(rng.random(n) < 0.001, 50, 1).astype(np.int32)
    row = {
        "docs": np.stack([np.arange(n), np.ones(n, np.int64)], 1).ravel().tobytes(), "lengths": np.full(n, 100, np.int64).tobytes(),
        "postings": np.arange(n, dtype=np.int32).tobytes(), "counts": tf.tobytes(), "cuts": np.array([0, n], np.int32).tobytes(),
    }
    block, best = ranked.Queries(["word"]), ranked.Best(1, 10)
    seen = []
    segment = ranked.Segment(row, np.array([700]), n, 100 * n)
    offer = segment.offer
    segment.offer = lambda query, doc, score, best: (seen.extend(doc.tolist()), offer(query, doc, score, best))
    segment.search(block, best)
    want = sorted(range(n), key=lambda i: (-segment.impact[i], i))[:10]
    assert best.rows[3].tolist() == want and len(seen) < n // 10


# --- Merkle manifest ---------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def expected_manifest(rows, arity=16):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: digest(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, text)))

    def build(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([digest(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            start = i - i % arity
            yield level[start:i], level[i + 1 : start + arity]
            i //= arity

    trees = {}
    for r in rows:
        trees.setdefault(r.source, []).append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        trees[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        built[s] = build([leaf(r, r.text) for r in trees[s]])
    top = build([built[s][-1][0] for s in order])
    out = Counter()
    for j, s in enumerate(order):
        for i, r in enumerate(trees[s]):
            steps = [*path(built[s], i), *path(top, j)]
            bad = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
            node = leaf(r, r.text if r.text is None or not bad else r.text.translate(LOWER))
            for before, after in steps:
                node = digest(*before, node, *after)
            proof = digest(*[x for before, after in steps for x in before + after])
            out[(r.doc_id, leaf(r, r.text), built[s][-1][0], top[-1][0], proof, node, node == top[-1][0])] += 1
    return out


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_manifest(spark, docs, odd, arity):
    for frame in (docs.withColumn("source", F.lit("one")), odd.withColumn("source", F.col("text")), docs.limit(1)):
        assert Counter(map(tuple, merkle.manifest(frame, arity).collect())) == expected_manifest(frame.collect(), arity)


@pytest.mark.parametrize("n", [16, 17, 33, 257, 273])
def test_lone_nodes(spark, n):
    """Runs of one, at the leaves and above."""
    frame = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(None).alias("lang"), F.lit(1).alias("n_chars"), F.lit("A text").alias("text"))
    assert Counter(map(tuple, merkle.manifest(frame).collect())) == expected_manifest(frame.collect())


def test_manifest_empty_and_void(spark, empty):
    assert merkle.manifest(empty).collect() == []
    void = spark.range(40).select(F.col("id").alias("doc_id"), *[F.lit(None).alias(c) for c in ("text", "lang", "source", "n_chars")])
    assert Counter(map(tuple, merkle.manifest(void).collect())) == expected_manifest(void.collect())


# --- vector index ------------------------------------------------------------


def expected_links(rows, cosine=0.95):
    units = []
    for r in rows:
        x = np.array([np.nan if c is None else c for c in r.embedding] if r.embedding is not None else [], float)
        good = len(x) and np.isfinite(x).all() and np.abs(x).max() > 0
        x = x / np.abs(x).max() if good else None
        units.append(x / np.linalg.norm(x) if good else None)
    near = [[j for j, y in enumerate(units) if j != i and x is not None and y is not None and len(x) == len(y) and x @ y >= cosine] for i, x in enumerate(units)]
    out = Counter()
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j].vec_id for j in seen if rows[j].vec_id is not None), default=None)
        out[(r.vec_id, len(near[i]), least, least is not None and r.vec_id == least)] += 1
    return out


def grouped(seed, sizes, spread, background, dims=24):
    rng = np.random.default_rng(seed)
    parts = [rng.standard_normal((background, dims))]
    for n, s in zip(sizes, spread, strict=True):
        parts.append(rng.standard_normal(dims) + s * rng.standard_normal((n, dims)))
    rows = np.concatenate(parts).astype(np.float32)
    return rows[rng.permutation(len(rows))]


@pytest.mark.parametrize("settings", [{}, {"occupancy": 16, "block": 8, "hot": 24}, {"occupancy": 64, "block": 16, "hot": 10**9}])
def test_vectors(spark, settings):
    """Groups tighter than the angle, as wide as it and wider, over several cells, blocks and cores."""
    rows = grouped(5, [200, 90, 60, 2, 3], [0.02, 0.2, 0.28, 0.1, 0.01], 300)
    frame = spark.createDataFrame([(int(i) * 3, x.tolist()) for i, x in enumerate(rows)], "vec_id long, embedding array<float>")
    want = expected_links(frame.collect())
    got = {r[0]: r for r in map(tuple, multi_index.near_duplicate_vectors(frame, recall=1.0, **settings).collect())}
    found, truth = sum(r[1] for r in got.values()), sum(r[1] for r in want)
    assert len(got) == len(rows) and truth > 10_000
    assert all(got[i][1] <= n for i, n, _, _ in want)
    assert found >= 0.995 * truth
    if not settings:
        assert Counter(got.values()) == want


def test_recall_at_the_threshold(spark):
    """Pairs at a cosine just above the limit, many cells: the share that the index finds, against brute force."""
    rng = np.random.default_rng(11)
    base = rng.standard_normal((1500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    aside = rng.standard_normal(base.shape)
    aside -= (aside * base).sum(1)[:, None] * base
    aside /= np.linalg.norm(aside, axis=1)[:, None]
    pairs = np.concatenate([base, 0.9505 * base + math.sqrt(1 - 0.9505**2) * aside])
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(pairs)], "vec_id long, embedding array<double>")
    got = multi_index.near_duplicate_vectors(frame, occupancy=12).collect()
    dots = pairs / np.linalg.norm(pairs, axis=1)[:, None]
    truth = int(((dots @ dots.T) >= 0.95).sum()) - len(pairs)
    assert truth >= 2900 and sum(r.n_links for r in got) >= 0.97 * truth


def test_vectors_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]),
        (None, [0.0, 1.0]), (None, [0.01, 1.0]), (None, None), (10, [-1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [1.0, 0.001, 0.0]), (13, [1e-300, 1e-300]), (14, [1e300, 1e300]), (15, [3.0]), (16, [4.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("row", "id", "digest", "size", "unit", "n", "cell", "core", "label")})
    assert Counter(map(tuple, multi_index.near_duplicate_vectors(frame).collect())) == expected_links(frame.collect())
    assert multi_index.near_duplicate_vectors(frame.limit(0)).collect() == []
    assert len(multi_index.near_duplicate_vectors(frame.filter("vec_id in (4, 5)")).collect()) == 2
