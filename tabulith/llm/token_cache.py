"""Token counts through a digest cache.

The cache is a table of (content digest, tokenizer digest, tokens). A count joins the
digests of the contents to it, encodes one document of every distinct content that
is missing, and appends those counts. Content is the text with null read as empty;
nothing else may be normalised without changing what the tokenizer sees. The
tokenizer digest covers the vocabulary file, the library and its version, so another
vocabulary never answers.

Within a worker, words met before are not encoded again: the byte-level pattern never
puts both sides of a single space between two printing characters into one token, so
a text's count is the sum over its words, each with the space before it.

Edge cases: a null or empty text has no tokens; repeated contents are encoded once and
answered for every row; a row without id is answered too; appends of a repeated job
are harmless, as equal contents have equal counts; an empty table gives an empty
result and leaves the cache as it is.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm.joins import by_ids
from tabulith.llm.words import arrow, batch, id_and_text, pieces
from tabulith.session import cut_lineage, shared_folder

LIMIT = 512
#: Words a worker remembers at most (twice, in two generations).
MEMORY = 250_000
CACHE = "content binary, tokenizer string, n_tokens bigint"

_WHITE_PAIR = re.compile(r"\s\s")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def tokenizer_digest(path: str) -> str:
    import tokenizers

    with open(path, "rb") as file:
        return hashlib.sha256(b"%s %s\n" % (b"tokenizers", tokenizers.__version__.encode()) + file.read()).hexdigest()


def words_of(text: str) -> list[str]:
    """Parts whose tokens add up to those of the text; all but the first stand for a space and the part."""
    if not text or text[0].isspace() or text[-1].isspace() or _WHITE_PAIR.search(text):
        return _BETWEEN.split(text) if text else []
    return text.split(" ")


class WordCounts:
    """Tokens of texts, word by word."""

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.memory = Tokenizer.from_file(path), memory
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        split = [words_of(t) for t in texts]
        heads = [w[0] for w in split if w]
        if len(self.young) > self.memory:
            self.old, self.young = self.young, {}
        # A word after a space is kept under its own name, a first word under its name and a line end.
        fresh = set().union(*(w[1:] for w in split)) - self.young.keys()
        found = fresh & self.old.keys()
        self.young.update((w, self.old[w]) for w in found)
        self._learn([w for w in fresh if w not in found], " ", "")
        self._learn([w for w in set(heads) if f"{w}\n" not in self.young], "", "\n")
        get = self.young.__getitem__
        return [get(f"{w[0]}\n") + sum(map(get, w[1:])) if w else 0 for w in split]

    def _learn(self, words: list[str], before: str, mark: str) -> None:
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([before + w for w in part], add_special_tokens=False), strict=True):
                self.young[w + mark] = len(e)


_counters: dict[str, WordCounts] = {}


def counter(path: str) -> WordCounts:
    if path not in _counters:
        _counters[path] = WordCounts(path)
    return _counters[path]


def encode_counts(texts: DataFrame, path: str, version: str) -> DataFrame:
    """(content, tokenizer, n_tokens) of every row of (content, text)."""
    schema = arrow(CACHE)

    def run(batches):
        count = counter(path).count
        for rows, data, at in pieces(batches):
            raw = data.tobytes()
            n = count([raw[at[i] : at[i + 1]].decode() for i in range(len(at) - 1)])
            yield batch(schema, rows.column("content"), [version] * len(n), n)

    return texts.mapInArrow(run, CACHE)


def _stored(spark, cache: str, version: str) -> DataFrame:
    """Counts of this tokenizer; an empty cache has no folder yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == version)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per document: bytes, tokens and whether they exceed ``limit``.

    ``cache`` is a folder every executor reaches; None takes a new one in the shared folder.
    """
    spark = docs.sparkSession
    cache = cache or f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}"
    version = tokenizer_digest(tokenizer)
    texts = id_and_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    content = F.unhex(F.sha2("text", 256))
    digests = cut_lineage(texts.select("doc_id", content.alias("content"), F.octet_length("text").cast("long").alias("n_bytes")))

    stored = _stored(spark, cache, version)
    missing = digests.groupBy("content").agg(F.min("doc_id").alias("doc_id")).join(stored.select("content").distinct(), "content", "left_anti")
    wanted = cut_lineage(missing)
    # One document per missing content, by its id; contents that only rows without id have come along.
    named = by_ids(texts, wanted.filter("doc_id is not null").select("doc_id").distinct(), "left_semi")
    nameless = texts.filter("doc_id is null").dropDuplicates(["text"])
    encoded = cut_lineage(encode_counts(named.unionByName(nameless).select(content.alias("content"), "text"), tokenizer, version))
    encoded.join(wanted.select("content"), "content", "left_semi").dropDuplicates(["content"]).write.mode("append").parquet(cache)

    counts = _stored(spark, cache, version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    joined = digests.join(counts, "content").select("doc_id", "n_bytes", "n_tokens")
    return joined.withColumn("over_limit", F.col("n_tokens") > limit)
