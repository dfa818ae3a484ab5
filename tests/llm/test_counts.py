"""Quality bands, token cache and packing against brute force."""

import random
import re
import struct
import zlib
from collections import Counter

import pyarrow as pa
import numpy as np
import pytest
import public_tokenizers
import zstandard
from tokenizers import Tokenizer

from tabulith.llm import bands, packing, token_cache

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def expected_counts(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def expected_verdict(text):
    raw, press = text.encode(), zstandard.ZstdCompressor(level=3)
    ok = lambda b: bands.in_band(len(press.compress(b)) / len(b), len(b))
    parts = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
    return not raw or (ok(raw) and (len(parts) < 2 or sum(not ok(p) for p in parts) <= 0.25 * len(parts)))


def check_bands(frame):
    found = bands.compression_bands(frame).collect()
    texts = Counter((r.doc_id, r.text or "") for r in frame.collect())
    want = Counter()
    for (i, t), n in texts.items():
        counts = expected_counts(t)
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        want[(i, *counts, failed, not failed and expected_verdict(t))] += n
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in found) == want


def test_bands(docs, odd, empty):
    check_bands(docs)
    check_bands(odd)
    assert bands.compression_bands(empty).collect() == []


def test_bands_keep_good_and_drop_bad(spark, data, docs):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    kept = bands.compression_bands(docs).join(labels, "doc_id").filter("not base_failed").toPandas()
    assert kept[kept.quality == 1].kept.all()
    noise = "".join(random.Random(1).choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/= ") for _ in range(9000))
    mixed = docs.filter("doc_id = 0").first().text
    frame = spark.createDataFrame([(1, noise), (2, "ab cd " * 3000 + noise)], "doc_id long, text string")
    assert not any(r.kept for r in bands.compression_bands(frame).collect()) and mixed is not None


def test_bands_keep_long_clean_texts(docs):
    """A ratio that falls with length alone drops no text; a passage over and over is dropped at any length."""
    for lang in ("en", "de", "fr", "es"):
        text = "\n".join(dict.fromkeys(r.text for r in docs.filter(f"lang = '{lang}' and length(text) > 400").orderBy("doc_id").collect())).encode()
        for size in (1 << 15, 1 << 17, 1 << 19, 1 << 20):
            part = text[:size]
            found = bands.judge(np.frombuffer(part, np.uint8), np.array([0, len(part)]))
            assert found["in_bands"][0], (lang, size, found)
    for unit, size in ((20, 128), (40, 256), (60, 512), (200, 2048), (600, 4096), (2000, 1 << 14), (2000, 1 << 20)):
        again = (text[:unit] * (size // unit + 1))[:size]
        assert not bands.judge(np.frombuffer(again, np.uint8), np.array([0, size]))["in_bands"][0], (unit, size)


def test_kept_documents(odd):
    kept = {r.doc_id for r in bands.compression_bands(odd).collect() if r.kept}
    rows = bands.kept_documents(odd)
    assert rows.columns == odd.columns and {r.doc_id for r in rows.collect()} == kept


PARTS = ["a", "B", "é", "ß", " ", "  ", "\n", " \n", "\t", "'s", "'t", "22", "<|endoftext|>", "!", "\x1c", " \x1c", "　", "́", "中", "\x85", "\x0b", "ΑΣ", "İ", "\x00", "ﬁ", "😀", " the", "</w>", "|", "<"]


def test_word_by_word_equals_the_tokenizers():
    one, two = Tokenizer.from_file(BYTE_BPE), Tokenizer.from_file(WORD_BPE)
    counts, ids = token_cache.WordCounts(BYTE_BPE, memory=40), packing.WordIds(WORD_BPE, memory=40)
    rng = random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(14)))
        assert counts.count([text]) == [len(one.encode(text, add_special_tokens=False).ids)], repr(text)
        raw = ids.encode([text.encode()])[0]
        assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == two.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.fixture(scope="module")
def byte_counts():
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_token_counts(docs, odd, empty, byte_counts):
    for frame in (docs, odd):
        found = token_cache.count_tokens(frame, BYTE_BPE).collect()
        want = Counter((r.doc_id, len((r.text or "").encode()), byte_counts(r.text), byte_counts(r.text) > 512) for r in frame.collect())
        assert Counter(tuple(r) for r in found) == want
    assert token_cache.count_tokens(empty, BYTE_BPE).collect() == []


def test_only_misses_are_encoded(spark, odd, tmp_path, byte_counts):
    cache = f"file://{tmp_path}/cache"
    token_cache.count_tokens(odd, BYTE_BPE, cache).collect()
    stored = spark.read.parquet(cache)
    assert stored.count() == len({r.text or "" for r in odd.collect()}) == stored.select("content").distinct().count()
    # A planted wrong count shows that a stored content is not encoded again; another tokenizer has its own counts.
    more = odd.select("doc_id", "text").union(spark.createDataFrame([(99, "a new text")], "doc_id long, text string"))
    token_cache.count_tokens(more, BYTE_BPE, cache).collect()
    assert spark.read.parquet(cache).count() == stored.count() + 1
    other = {r.doc_id: r.n_tokens for r in token_cache.count_tokens(more, WORD_BPE, cache).collect()}
    assert other[99] == len(Tokenizer.from_file(WORD_BPE).encode("a new text").ids)
    assert {r.doc_id: r.n_tokens for r in token_cache.count_tokens(more, BYTE_BPE, cache).collect()}[99] == byte_counts("a new text")


def check_packing(frame, **options):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    capacity = options.get("capacity", 4096)
    found = packing.pack(frame, WORD_BPE, **options).toPandas()
    want = Counter()
    for r in frame.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[(r.doc_id, len(ids))] += len(ids)
        for p in found[(found.doc_id == r.doc_id) & (found.doc_tokens == len(ids))].itertuples():
            if p.start + p.length <= len(ids) and zlib.crc32(struct.pack(f"<{p.length}I", *ids[p.start : p.start + p.length])) != p.ids_crc32:
                others = [x for x in frame.collect() if x.doc_id == r.doc_id and x.text != r.text]
                assert others, "a piece has other ids than its document"
    got = Counter()
    for p in found.itertuples():
        got[(None if np.isnan(p.doc_id) else int(p.doc_id), int(p.doc_tokens))] += int(p.length)
    assert got == want
    for _, g in found.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= capacity
    return found


def test_packing(docs, odd, empty):
    found = check_packing(docs)
    assert found.length.sum() > 0.9 * 4096 * found.sequence_id.nunique()
    check_packing(odd)
    check_packing(docs.repartition(40), capacity=256, windows=3, fan_in=3)
    assert packing.pack(empty, WORD_BPE).collect() == []


def test_packer_is_bounded():
    packer, rng = packing.Packer(0, 100, 4), random.Random(2)
    for d in range(500):
        packer.add(d, b"\x01\x00\x00\x00" * rng.randrange(1, 250))
        assert len(packer.filled) <= 4
    filled = Counter()
    for piece in packer.done:
        filled[piece[5]] += piece[2]
    assert set(filled.values()) == {100}  # an emitted window was filled up


def test_arrow_slices():
    from tabulith.llm.words import text_bytes

    column = pa.array(["ab", None, "", "cde"]).slice(1)
    data, at = text_bytes(column)
    assert data.tobytes() == b"cde" and at.tolist() == [0, 0, 0, 3]
