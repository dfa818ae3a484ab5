"""The pipeline's stages and its result against their brute-force versions."""

import os

import corpus_pipeline as pipeline
from test_counts import expected_counts, expected_verdict
from test_duplicates import expected_groups, expected_hits
from tabulith.session import cut_lineage


def removed(rows, length=50):
    first = {}
    for i, raw in rows:
        for p in range(len(raw) - length + 1):
            first[raw[p : p + length]] = min(first.get(raw[p : p + length], i), i)
    out = {}
    for i, raw in rows:
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < i:
                gone[p : p + length] = b"\x01" * length
        left = bytes(b for b, g in zip(raw, gone) if not g)
        if left or not raw:
            out[i] = left.decode("utf-8", "ignore")
    return out


def test_stages(spark, data, monkeypatch):
    """``run`` once, with what it writes between its stages kept for comparison."""
    docs = pipeline.documents(spark, data)
    texts, columns, written = {r.doc_id: r.text or "" for r in docs.collect()}, docs.columns, []

    def keep(df, cut=pipeline.cut_lineage):
        out = cut(df)
        if out.columns == columns:
            written.append({r.doc_id: r.text for r in out.collect()})
        return out

    monkeypatch.setattr(pipeline, "cut_lineage", keep)
    packed = pipeline.run(spark, data).select("doc_id", "length", "doc_tokens").collect()
    counts = {i: expected_counts(t) for i, t in texts.items()}
    texts = {i: t for i, t in texts.items() if counts[i][0] >= 10 and 100 * counts[i][4] <= 20 * counts[i][0] and expected_verdict(t)}
    assert written[0] == texts
    groups = expected_groups(list(texts.items()), 5)
    texts = {i: t for i, t in texts.items() if groups[i] == i}
    assert written[1] == texts
    texts = removed([(i, t.encode()) for i, t in texts.items()])
    assert written[2] == texts
    items = [(str(r.item_id), r.text) for r in pipeline.documents(spark, data, "benchmark").collect()]
    texts = {r[0]: texts[r[0]] for r in expected_hits(list(texts.items()), items) if not r[5]}
    assert written[3] == texts
    sizes = {}
    for r in packed:
        sizes[r.doc_id, r.doc_tokens] = sizes.get((r.doc_id, r.doc_tokens), 0) + r.length
    assert all(total == n for (_, n), total in sizes.items()) and {i for i, _ in sizes} == set(texts)


def test_odd_documents(spark, data, odd):
    assert pipeline.quality(spark, odd, data).columns == odd.columns
    docs, ids = odd, []
    for _, stage in pipeline.STAGES[1:-1]:
        docs = cut_lineage(stage(spark, docs, data))
        assert docs.columns == odd.columns
        ids.append([r.doc_id for r in docs.select("doc_id").collect()])
    # Copies and near copies of 1 go, a repeated row stays once, rows without id are not compared.
    assert {1, 13} <= set(ids[0]) and not {2, 3} & set(ids[0]) and ids[0].count(13) == 1 and ids[0].count(None) == 2
    assert len(pipeline.packing(spark, docs, data).collect()) >= len(set(ids[-1]))


def test_queries_are_registered():
    from tabulith.llm.queries import QUERIES

    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} and os.path.exists(pipeline.__file__)


def test_words_of_letters_are_one_piece(monkeypatch):
    """They are looked up without being cut by the vocabulary's pattern."""
    import struct

    import public_tokenizers
    from tokenizers import Tokenizer

    from tabulith.llm import packing

    class Cut:
        @staticmethod
        def findall(word):
            assert not word.isalpha()
            return pattern.findall(word)

    pattern, path = packing.ASCII_PIECES, public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "ASCII_PIECES", Cut)
    texts = ["Hello WORLD hello", "don't WE'RE x's 12a3 a-b", "É naïve <|endoftext|> a<|b", ""]
    whole = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert packing.WordIds(path).encode([t.encode() for t in texts]) == [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in whole]


def test_rows_go_to_workers_by_a_few_megabytes(spark, data, odd):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        pipeline.quality(spark, odd, data)
        assert spark.conf.get(key) == "4m"
        spark.conf.set(key, "1m")
        pipeline.suffix_repeats(spark, odd.limit(0), data)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_few_rows_go_to_workers_at_once(spark, data, odd):
    keys = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Bytes", "Records")]
    before = [spark.conf.get(k, None) for k in keys]
    try:
        for k in keys:
            spark.conf.unset(k)
        pipeline.quality(spark, odd, data)
        assert int(spark.conf.get(keys[1])) == 500
        spark.conf.set(keys[1], "7")
        pipeline.suffix_repeats(spark, odd.limit(0), data)
        assert spark.conf.get(keys[1]) == "7"
    finally:
        for k, x in zip(keys, before):
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)


def test_a_model_leaves_no_tables_of_counts(spark, tmp_path, monkeypatch):
    from tabulith import session
    from tabulith.llm.interpolation import lm_scores

    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    scored = lm_scores(spark.createDataFrame([(i, f"one two {i % 3} two one") for i in range(40)], "doc_id long, text string"))
    assert not [p for p in os.listdir(tmp_path) if p.startswith("tabulith-")]
    assert scored.count() == 40
