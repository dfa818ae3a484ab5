"""Language-model scores, toxicity, licenses and archives against brute force and held-out rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulith.llm import interpolation, licenses, toxicity, warc

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER)), 0]


def fold(i, k):
    return None if i is None else zlib.crc32(str(i).encode()) % k


def check_lm(frame, head):
    rows = [(r.doc_id, tokens(r.text)) for r in frame.collect()]
    train = [t for i, t in rows if i is not None and fold(i, 7) != 2]
    single = Counter(w for t in train for w in t)
    n, v = sum(single.values()), len(single)
    pair = Counter(x for t in train for x in zip([None, *t], t))
    found = interpolation.lm_scores(frame, head=head)
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found.collect())
    want = Counter((i, fold(i, 7) == 2, len(t), sum(single[w] > 0 for w in t), n, round(sum(math.log10((single[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in rows)
    assert got == want
    return rows, single, pair, n, v, found


def test_counts_and_base(docs, odd, empty):
    check_lm(docs, 1 << 18)
    check_lm(odd, 1 << 6)
    assert interpolation.lm_scores(empty).collect() == []


def test_mixture(docs, monkeypatch):
    """The score is the mixture of the three estimates with the weights that were learned; rare contexts are one class."""
    seen = {}
    monkeypatch.setattr(interpolation, "mixture_weights", lambda cells, uniform, f=interpolation.mixture_weights: seen.setdefault("w", f(cells, uniform)))
    head = 300
    rows, single, pair, n, v, found = check_lm(docs, head)
    frequent = {w for w, c in single.items() if c * head >= n and w != 0}
    context = lambda w: w if w is None or w in frequent else "rare"
    train = [t for i, t in rows if fold(i, 7) != 2]
    pairs, contexts = Counter(), Counter()
    for t in train:
        for a, b in zip([None, *t], t):
            pairs[context(a), b] += 1
            contexts[context(a)] += 1
    scores = {r.doc_id: r.score for r in found.collect()}
    for i, t in rows[:60]:
        total = 0.0
        for a, b in zip([None, *t], t):
            c = context(a)
            w = seen["w"][0 if c == "rare" else 1 + int(math.log2(max(contexts[c], 1)))]
            total += math.log10(w[0] * pairs[c, b] / max(contexts[c], 1) + w[1] * single[b] / n + w[2] / (v + 1))
        assert total == pytest.approx(scores[i], rel=1e-6)
    held = found.filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


@pytest.mark.parametrize("known", [300, 1 << 18])
def test_every_context_has_its_own_counts(docs, monkeypatch, known):
    seen = {}
    monkeypatch.setattr(interpolation, "mixture_weights", lambda cells, uniform, f=interpolation.mixture_weights: seen.update(cells=cells) or seen.setdefault("w", f(cells, uniform)))
    scores = {r.doc_id: r.score for r in interpolation.lm_scores(docs, known=known).collect()}
    rows = [(r.doc_id, tokens(r.text)) for r in docs.collect()]
    train = [(i, t) for i, t in rows if fold(i, 7) != 2]
    single, pairs, contexts, octaves = Counter(w for _, t in train for w in t), Counter(), Counter(), Counter()
    for _, t in train:
        pairs.update(zip([None, *t], t))
        contexts.update([None, *t[:-1]])
    estimate = Counter(v for i, t in train if fold(i, 7) != 3 for v in [None, *t[:-1]])
    for i, t in train:
        if fold(i, 7) == 3:
            octaves.update(1 + int(math.log2(max(estimate[v], 1))) for v in [None, *t[:-1]])
    n, v = sum(single.values()), len(single)
    assert octaves == Counter({o: int(seen["cells"][seen["cells"][:, 0] == o, 3].sum()) for o in set(seen["cells"][:, 0].tolist())})
    for i, t in rows[:60]:
        total = 0.0
        for a, b in zip([None, *t], t):
            w = seen["w"][1 + int(math.log2(max(contexts[a], 1)))]
            total += math.log10(w[0] * pairs[a, b] / max(contexts[a], 1) + w[1] * single[b] / n + w[2] / (v + 1))
        assert total == pytest.approx(scores[i], rel=1e-6)


def test_frequent_words_travel_as_places():
    """Words that every task knows are sent as steps between their places, the others as hashes."""
    rng = np.random.default_rng(5)
    every = rng.integers(1, 1 << 63, 5000).astype(np.uint64)
    head = interpolation.Head([(int(w.view(np.int64)), 3, 4) for w in every[:4000]], {k: 10**6 for k in ("n_est", "n_all", "docs_est", "docs_all")}, False)
    for words in (np.unique(rng.choice(every, 900)), every[:0], np.sort(every[4000:]), np.sort(every[:4000])):
        where, other = interpolation._pair_bucket(head, words, np.zeros(len(words), np.uint64), 1)
        words = words[np.lexsort((words, 2 * where + other))]
        steps, rest = interpolation._unpack(interpolation._pack(*head.short(words)))
        assert (head.long(steps, rest) == words).all() and len(rest) == other.sum()
    assert len(interpolation._pack(*head.short(words))) < 2 * len(words)
    nothing = interpolation.Head([], {k: 0 for k in ("n_est", "n_all", "docs_est", "docs_all")}, False)
    assert (nothing.long(*nothing.short(words)) == words).all()


def test_weights_are_learned():
    # In octave 3 the pair share explains the held-out counts, in octave 5 the word share does.
    step = interpolation._step
    cells = np.array([[3, step(np.array(0.9)), step(np.array(0.001)), 100], [5, 0, step(np.array(0.05)), 100]], np.int64)
    weights = interpolation.mixture_weights(cells, 1e-6)
    assert weights[3][0] > 0.9 and weights[5][1] > 0.9 and np.allclose(weights.sum(1), 1)


def test_toxicity(spark, docs, odd, empty, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (fold(r.doc_id, 5) == 0) for r in found)
    # Labels of the held-out fold change nothing.
    turned = labels.withColumn("toxic", F.expr(f"if({toxicity.FOLD}, 1 - toxic, toxic)"))
    assert [tuple(r) for r in toxicity.toxicity(docs, turned).collect()] == [tuple(r) for r in found]
    assert len(toxicity.toxicity(odd, labels).collect()) == odd.count()
    assert {r.score for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(empty, labels).collect() == []


def test_toxicity_held_out(spark):
    import os

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no larger table")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    documents = spark.read.parquet(f"{folder}/documents.parquet").join(F.broadcast(labels.select("doc_id")), "doc_id", "left_semi")
    rows = toxicity.toxicity(documents, labels).filter("held_out").join(labels, "doc_id").toPandas()
    toxic = rows.toxic == 1
    assert rows.predicted[toxic].mean() > 0.75 and rows.predicted[~toxic].mean() < 0.02


def test_non_negative_risk():
    """With a prior of a half, unlabelled toxic texts do not end up as clean ones."""
    rng = np.random.default_rng(0)
    make = lambda toxic: np.unique(np.append(rng.integers(10, 60, 5), rng.integers(0, 5, 2) if toxic else rng.integers(5, 10, 2))).astype(np.uint32)
    positive, unlabelled = toxicity.Sets([make(True) for _ in range(300)]), toxicity.Sets([make(i % 2 == 0) for i in range(600)])
    weights, bias = toxicity.train(positive, unlabelled, 0.5, 60)
    scores = unlabelled.margins(weights, bias)
    assert (scores[::2] > 0).mean() > 0.95 and (scores[1::2] < 0).mean() > 0.9


def test_licenses(spark, docs, odd, empty):
    extra = spark.createDataFrame(
        [
            (900, "cc by nc cc by nc under the MIT license, apache license version 2"), (901, "apache license version 20"),
            (902, "Intro. This work is licensed under the GNU General Public License, version 3. End"),
            (903, "a permission is hereby granted free of charge to any person who is obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
            (904, "all rights are reserved"), (None, "All rights reserved."), (905, "under-the-MIT_license " * 3), (905, "under-the-MIT_license " * 3),
        ],
        "doc_id long, text string",
    )
    frame = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(extra)
    found, want = licenses.license_labels(frame).collect(), Counter()
    for r in frame.collect():
        w, places, names = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate(UPPER)), [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            hits = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            places += hits
            names |= {label} if hits else set()
        want[(r.doc_id, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(names)))] += 1
    assert Counter(tuple(r)[:6] for r in found) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in found)
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by_id[902].labels == "gpl-3" and by_id[903].labels == "mit" and 0.6 <= by_id[903].score < 1 and by_id[904].labels == ""
    assert licenses.license_labels(empty).collect() == []


def test_relatives_are_not_the_license(spark):
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation, either version {}"
    cc = "This work is licensed under a Creative Commons {} 4.0 International License"
    mit = licenses.TEMPLATES["mit"][1]
    half = mit.split(", to any person ")
    cases = [
        (gpl.format("General Public", 3), "gpl-3"), (gpl.format("General Public", 2), ""), (gpl.format("Lesser General Public", 3), ""), (gpl.format("Affero General Public", 3), ""),
        ("This work is licensed under the GNU General Public License, version 2.", ""), (cc.format("Attribution-NonCommercial"), "cc-by-nc"), (cc.format("Attribution"), ""),
        (cc.format("Attribution-ShareAlike"), ""), (cc.format("Attribution-NonCommercial-ShareAlike"), ""), (mit, "mit"), (mit.replace("deal in", "deal with"), ""),
        ("x y z " + mit.replace("Permission", "Leave").replace("files, to", 'files (the "Software"), to') + ", including", "mit"), (half[1] + " " + half[0], ""), ("All rights reserved. " * 2000, "all-rights-reserved"),
    ]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.license_labels(frame).collect()} == {i: want for i, (_, want) in enumerate(cases)}


def test_license_plan_is_native(docs):
    plan = licenses.license_labels(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


PAGES = "page_id long, url string, html string, key string"


@pytest.fixture(scope="module")
def odd_pages(spark):
    long = "<p>é" + "x" * 200
    return spark.createDataFrame(
        [
            (1, "http://www.b.example.com/x?y=1", long, "k"), (2, "https://a.example.com:8080/ü a\r\nb", long, None), (3, None, None, None), (4, "not a url", "", None), (5, "http://[bad", "short", None),
            (6, "http://b.example.com/x?y=1", "short", None), (7, "http://b.example.com", "\r\n\r\n" * 60, None), (None, "http://n.example.com", long, None), (1, "http://again.example.com", long, None), (8, "http://b.example.com/z", long, None),
        ],
        PAGES,
    )


def check_archive(pages, **options):
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for i, raw in rows:
        if i is not None and len(raw) >= 100:
            first[raw] = min(first.get(raw, i), i)
    want = Counter()
    for i, raw in rows:
        again = i is not None and first.get(raw, i) < i
        want[(i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[raw] if again else None)] += 1
    index = warc.archive(pages, **options)
    assert Counter(tuple(r)[:5] for r in index.records().collect()) == want
    return index


def test_archives(spark, data, odd_pages):
    index = check_archive(spark.read.parquet(f"{data}/pages.parquet"), block=7)
    assert index.directory.count() > 5
    check_archive(odd_pages)
    check_archive(odd_pages.limit(0))


def test_look_up(spark, odd_pages):
    index = check_archive(odd_pages, block=2)
    urls = spark.createDataFrame([("https://b.example.com/x?y=1",), ("http://www.b.example.com/",), ("http://missing.example.com",), ("not a url",)], "url string")
    assert sorted(r.page_id for r in index.find(urls).collect()) == [1, 4, 6, 7]


def test_capture_keys():
    assert warc.capture_key("http://www.a.example.com/x?y") == "com,example,a)/x?y"
    assert warc.capture_key("http://A.example.com:80") == "com,example,a)/" and warc.capture_key(None) == ""


def test_records_round_trip():
    raw = warc.record(7, "http://x/\r\ny", b"a\r\n\r\nb", "0" * 64, None)
    headers, payload = warc.parse(raw)
    assert payload == b"a\r\n\r\nb" and headers["WARC-Target-URI"] == "http://x/%0D%0Ay" and headers["WARC-Type"] == "response"


def test_labels_without_a_document_change_nothing(spark, docs, data):
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "toxic")
    orphans = spark.range(10**6, 10**6 + 4000).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    again = labels.unionByName(labels).unionByName(orphans).unionByName(labels.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted(toxicity.toxicity(docs, labels).collect()) == sorted(toxicity.toxicity(docs, again).collect())


def test_confirmed_rows_alone_train_a_model(spark, data):
    docs = spark.read.parquet(f"{data}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{data}/../sf0.01/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.toxicity(docs, labels.filter("toxic = 1")).join(labels, "doc_id").toPandas()
    toxic, clean = scored[scored.toxic == 1], scored[scored.toxic == 0]
    assert toxic.score.median() > clean.score.quantile(0.95)
    assert {r.score for r in toxicity.toxicity(docs.limit(20), labels.filter("toxic = 0")).collect()} == {0.0}


def test_risk_gradient_against_dense_numpy():
    """The sparse steps are those of a dense matrix, step by step, where the risk is positive and where it is clipped."""
    rng = np.random.default_rng(5)
    rows = [np.flatnonzero(rng.random(12) < 0.3) for _ in range(30)]
    pos, unl = toxicity.Sets(rows[:8]), toxicity.Sets(rows)
    dense = np.array([np.isin(np.arange(12), r) for r in rows], float)
    for prior in (0.05, 0.9):
        weights, bias = toxicity.train(pos, unl, prior, 12, steps=60)
        theta, m, v = np.append(np.zeros(12), np.log(prior / (1 - prior))), np.zeros(13), np.zeros(13)
        x = np.hstack([dense, np.ones((30, 1))])
        clipped = 0
        for t in range(1, 61):
            p, u = 1 / (1 + np.exp(-x[:8] @ theta)), 1 / (1 + np.exp(-x @ theta))
            rest = x.T @ u / 30 - prior * x[:8].T @ p / 8
            risk = -np.log(1 - u).mean() + prior * np.log(1 - p).mean()
            clipped += risk < 0
            g = prior * x[:8].T @ (p - 1) / 8 + rest if risk >= 0 else -rest
            g[:-1] += toxicity.RIDGE * theta[:-1]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta -= toxicity.RATE * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        assert np.allclose(np.append(weights, bias), theta, atol=1e-9)
    assert clipped
