"""Near-duplicates, repeated passages and benchmark passages against brute force."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulith.llm import induced, minhash, positions, repeats
from tabulith.llm.joins import components

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def expected_groups(rows, k, percent=80):
    sets = sorted({(i, frozenset(shingles(t, k))) for i, t in rows if i is not None}, key=lambda x: x[0])
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (a, s) in enumerate(sets):
        for b, t in sets[x + 1 :]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in parent}


def check_groups(frame, k, drop=()):
    rows = [(r.doc_id, r.text) for r in frame.collect() if r.doc_id not in drop]
    groups = expected_groups(rows, k)
    want = Counter((i, len(shingles(t, k)), None if i is None else groups[i], i is None or groups[i] == i) for i, t in rows)
    found = minhash.near_duplicates(frame, shingle=k).collect()
    assert Counter(tuple(r) for r in found if r.doc_id not in drop) == want


def test_near_duplicates(docs, odd, empty):
    check_groups(docs, 2)
    check_groups(odd, 2, drop={18})  # two texts under one id: see the module
    check_groups(odd, 5, drop={18})
    assert minhash.near_duplicates(empty).collect() == []


def test_family_of_near_copies(spark):
    """Members that differ from the smallest one but not from each other, and a hot passage that links nobody."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(9000)}" for _ in range(220)]
    passage = " ".join(f"hot{i}" for i in range(40))
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(1, 14)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, passage + " " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(4, 16)))) for i in range(150)]
    check_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2)


def test_suffix_dedup_holds_little_at_once():
    """What a worker holds is a small multiple of its bytes: it lies beside the executor's heap."""
    rng = np.random.default_rng(3)
    data = rng.integers(97, 107, 2 << 20).astype(np.uint8)
    at = np.append(np.arange(0, len(data), 2000), len(data))
    cuts = np.append(np.arange(0, 1 << 20, 90), 1 << 20)
    whole = repeats.anchors(data, at, 50, 20, step=len(data))
    for limit, run in ((48, lambda: repeats.anchors(data, at, 50, 20)), (90, lambda: repeats._repeated(data[: 1 << 20], cuts, np.arange(len(cuts) - 1), 50))):
        tracemalloc.start()
        found = run()
        peak = tracemalloc.get_traced_memory()[1] >> 20
        tracemalloc.stop()
        assert peak < limit
        if limit == 48:
            assert all((a == b).all() for a, b in zip(found, whole, strict=True))


@pytest.mark.parametrize("step", [1, 37, 90, 1 << 18])
def test_anchors_in_steps(step):
    """A window's anchor is the least hash in it, whatever the steps; neighbours with one anchor are one run."""
    rng = np.random.default_rng(step)
    texts = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (0, 49, 50, 51, 0, 300, 77)] + [b"a" * 200, b""]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    names = {}
    value, owner, start, count = repeats.anchors(data, at, 50, 20, step)
    windows = [(int(o), int(s) + k) for o, s, n in zip(owner, start, count) for k in range(n)]
    assert windows == [(i, int(at[i]) + k) for i, t in enumerate(texts) for k in range(len(t) - 49)]
    assert not ((value[1:] == value[:-1]) & (owner[1:] == owner[:-1])).any()
    for v, o, s, n in zip(value, owner, start, count):
        for k in range(n):
            window = data[s + k : s + k + 50].tobytes()
            assert names.setdefault(window, v) == v and s + k + 50 <= at[o + 1]


def test_signature_estimates():
    rng = np.random.default_rng(1)
    table, registers = minhash.collision_table(288), 288
    for share in (0.2, 0.5, 0.8, 0.95):
        found = []
        for _ in range(30):
            n = 3000
            both = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
            sides = [np.unique(np.concatenate([both, rng.integers(0, 2**63, (n - len(both)) // 2, dtype=np.uint64)]) * np.uint64(2)) for _ in range(2)]
            left, right = (minhash.signature(s, registers)[None] for s in sides)
            found.append(minhash.estimates(left, right, np.array([len(sides[0])]), np.array([len(sides[1])]), table)[0])
        assert abs(np.mean(found) - share) < 0.02


def test_components(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(500, 501), (501, 500), (700, 700)], "a long, b long"))
    found = {r.node: r.component for r in components(chain).collect()}
    assert found == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}
    assert components(chain.limit(0)).collect() == []


def test_induced_sorting(monkeypatch):
    rng = random.Random(3)
    for _ in range(60):
        letters, cap = rng.choice([b"ab", b"abc", b"\x00\xff", bytes(range(256))]), rng.choice([3, 10, 50])
        strings = [bytes(rng.choice(letters) for _ in range(rng.randint(1, rng.choice([5, 40, 200])))) for _ in range(rng.randint(1, 8))]
        strings += [strings[0] + b"x", strings[-1][1:] or b"q", strings[0]]
        data = np.frombuffer(b"".join(strings), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
        monkeypatch.setattr(induced, "STEP", rng.choice([7, 1 << 20]))
        owner, place, common = induced.sorted_suffixes(data, at, cap, budget=rng.choice([5, 1 << 20]))  # 5: queues on disk
        found = [strings[o][p : p + cap] for o, p in zip(owner, place)]
        assert found == sorted(s[i : i + cap] for s in strings for i in range(len(s)))
        for a, b, n in zip(found, found[1:], common[1:]):
            assert a[:n] == b[:n] and (a[n : n + 1] != b[n : n + 1] or n in (len(a), len(b)))


def expected_removal(rows, length=50):
    first = {}
    for i, raw in rows:
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, raw in rows:
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < i:
                gone[p : p + length] = b"\x01" * length
        left = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for p in range(len(gone)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("options", [{}, {"split_above": 2, "shard_bytes": 20_000}])
def test_suffix_dedup(docs, odd, options):
    for frame in (docs, odd):
        rows = [(r.doc_id, (r.text or "").encode()) for r in frame.collect()]
        want = expected_removal([x for x in rows if x[0] is not None])
        want += Counter((None, len(t), 0, 0, hashlib.sha256(t).hexdigest()) for i, t in rows if i is None)
        assert Counter(tuple(r) for r in repeats.suffix_dedup(frame, **options).collect()) == want


def test_anchors_are_dealt_evenly(spark):
    """Least hashes are small numbers: by their size alone most of them would meet in the first bucket."""
    rows = [(i, " ".join(str(random.Random(i * 1000 + j).random()) for j in range(60))) for i in range(40)]
    blocks = repeats.pack_blocks(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    sizes = Counter()
    for r in repeats.anchor_entries(blocks, 8, repeats.LENGTH, repeats.GRAM).collect():
        sizes[r.bucket] += len(r.anchors)
    assert len(sizes) == 8 and max(sizes.values()) < 1.5 * sum(sizes.values()) / 8


def test_few_rows_at_once_make_no_small_blocks(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    frame = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string").coalesce(1)
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "3")
        assert repeats.pack_blocks(frame).count() == 1
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_without_repeats(odd, empty):
    assert repeats.suffix_dedup(empty).collect() == []
    rows = repeats.without_repeats(odd)
    assert rows.columns == odd.columns
    left = {r.doc_id: r for r in rows.filter("doc_id is not null").collect()}
    assert 2 not in left and left[1].text == odd.filter("doc_id = 1").first().text
    assert left[3].n_chars == len(left[3].text) < len(odd.filter("doc_id = 3").first().text)
    assert left[6].text == "" and rows.filter("doc_id is null").count() == 2
    assert repeats.without_repeats(empty).collect() == []


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def expected_hits(rows, items, window=10):
    windows = {}
    for name, text in items:
        w = alnum(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(name or "")
    sizes, out = {len(k) for k in windows}, []
    for i, text in rows:
        w, hit, names = alnum(text), set(), set()
        for size in sizes:
            for p in range(len(w) - size + 1):
                found = windows.get(tuple(w[p : p + size]))
                if found:
                    hit.update(range(p, p + size))
                    names |= found
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("block_words", [200_000, 60])
def test_decontamination(spark, data, docs, odd, block_words):
    bench = spark.read.parquet(f"{data}/benchmark.parquet").select(F.col("item_id").cast("string"), "text")
    extra = spark.createDataFrame([("q1", "Word"), ("q2", ""), (None, None), ("q3", "a b c d e f g h i j"), ("q4", "a, B; c d e f g h i J k"), (None, "one one two")], bench.schema)
    items = bench.union(extra)
    for frame in (docs.limit(40), odd):
        frame = frame.cache()
        want = expected_hits([(r.doc_id, r.text) for r in frame.collect()], [tuple(r) for r in items.collect()])
        found = positions.decontaminate(frame, items, block_words=block_words, segment=1 << 16)
        assert Counter(tuple(r) for r in found.collect()) == want
    assert not any(r.contaminated for r in positions.decontaminate(odd, items.limit(0)).collect())
    assert positions.decontaminate(odd.limit(0), items).collect() == []


def test_one_worker_answers(spark):
    """The search and its summary are one step, so that a task needs one worker."""
    items = spark.createDataFrame([("q", "alpha beta")], "item_id string, text string")
    found = positions.decontaminate(spark.createDataFrame([(1, "x alpha beta")], "doc_id long, text string"), items)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert [tuple(r)[:4] for r in found.collect()] == [(1, 3, 2, 1)]


def test_proximity(spark):
    items = spark.createDataFrame([("q", "alpha beta gamma delta")], "item_id string, text string")
    frame = spark.createDataFrame([(1, "x alpha beta gamma delta"), (2, "alpha beta new gamma delta"), (3, "gamma alpha"), (4, "beta gamma delta alpha")], "doc_id long, text string")
    exact = {r.doc_id: r.contaminated for r in positions.decontaminate(frame, items).collect()}
    near = {r.doc_id: r.contaminated for r in positions.decontaminate(frame, items, slop=1).collect()}
    assert exact == {1: True, 2: False, 3: False, 4: False} and near == {1: True, 2: True, 3: False, 4: False}
