"""Exact removal of repeated passages with suffix arrays built by external induced sorting.

A byte goes when a string of ``length`` bytes that covers it also starts in a document
with a smaller id. Steps, all on blocks of documents that are a written table:

1. Exact copies of a document with a smaller id are settled by their digest.
2. Every window of ``length`` bytes has an anchor: the least hash of the shorter strings
   in it. Equal windows have equal anchors, so a window whose anchor no other document
   has is no repeat. A block sends each anchor once, with its number of documents.
3. Windows with a shared anchor travel as passages (neighbouring windows with one anchor
   share a passage) to the anchor's shard; an anchor of more than ``split_above``
   documents is dealt out by whole windows instead, so no shard holds all of it. Equal
   passages of one block travel once.
4. A shard sorts the suffixes of its passages (``induced``); neighbours that share
   ``length`` bytes are one string, whose smallest document is the one that keeps it.
5. The runs to remove go back to their blocks.

Hash collisions in 2 and 3 only bring more passages to the sort; the sort compares bytes.

Edge cases: a null text is empty; texts shorter than ``length`` lose nothing; a document
without id keeps everything and takes nothing from others; rows with one id and one
text are the same document, rows with one id and other texts take nothing from each
other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm.induced import sorted_suffixes
from tabulith.llm.joins import by_ids
from tabulith.llm.words import _BYTE, STEP, U, arrow, batch, gathered, in_text, mix, pieces, powers, released, span_hashes
from tabulith.session import cut_lineage

LENGTH = 50
#: Bytes of the strings whose least hash is a window's anchor.
GRAM = 20
#: Documents that share an anchor before its windows are dealt out one by one.
SPLIT_ABOVE = 20_000
#: Bytes of passages sorted as one suffix array; a shard of a task is cut at anchors.
SHARD = 1 << 20
#: Shards for each shuffle partition, so that hashing them deals evenly.
PER_PARTITION = 4
#: Buckets of anchors for each shuffle partition; every block sends a row to each bucket.
BUCKETS = 2

BLOCKS = "block bigint, ids binary, cuts binary, data binary, rest binary"
ENTRIES = "bucket bigint, block bigint, anchors binary, docs binary"
SHARED = "block bigint, anchors binary, hot binary"
PASSAGES = "shard bigint, block bigint, payload binary"
REMOVED = "block bigint, spans binary"
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def anchors(data: np.ndarray, at: np.ndarray, length: int, gram: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one anchor: anchor, text, first byte, number of windows.

    Windows are looked at in runs of ``step`` first bytes, so that only the bytes themselves are held for all of them.
    """
    found = []
    for low in range(0, len(data), step):
        high = min(low + step + length - 1, len(data))
        a, b = int(np.searchsorted(at, low, "right")) - 1, int(np.searchsorted(at, high))
        value, owner, start, count = _anchors(data[low:high], np.clip(at[a : b + 1], low, high) - low, length, gram)
        found.append((value, owner + a, start + low, count))
    if not found:
        return np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(3))
    value, owner, start, count = (np.concatenate(x) for x in zip(*found, strict=True))
    # A run may go on in the next step.
    head = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])])) if len(value) else start
    return value[head], owner[head], start[head], np.add.reduceat(count, head) if len(head) else count


def _anchors(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.diff(at)
    starts = in_text(sizes, length)
    if not len(starts):
        return np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(3))
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
        least = mix((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])
    reach, width = 1, length - gram + 1
    while reach < width:  # least of `reach` neighbours, doubled until it is that of a window
        step = min(reach, width - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    owner = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
    value = least[starts]
    head = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]))
    return value[head], owner[head], starts[head], np.diff(np.append(head, len(value)))


def pack_blocks(rows: DataFrame) -> DataFrame:
    """Some megabytes of documents a row; columns besides the text ride along as they are."""
    schema = arrow(BLOCKS)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        press = zstandard.ZstdCompressor(level=1)
        for rows, data, at in pieces(gathered(batches)):
            ids = np.array(rows.column("doc_id"))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema.remove(rows.schema.get_field_index("text"))) as out:
                out.write_batch(rows.drop_columns(["text"]))
            rest = press.compress(sink.getvalue().to_pybytes())
            yield batch(schema, [number], [ids.astype(np.int64).tobytes()], [at.astype(np.int32).tobytes()], [press.compress(data.tobytes())], [rest])
            number += 1

    return rows.mapInArrow(run, BLOCKS)


def _block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"]) or b"", np.uint8)
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["cuts"], np.int32).astype(np.int64), data


def _six(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(U).ravel()


def anchor_entries(blocks: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """Per block and bucket: its distinct anchors (their upper six bytes) and how many documents have each."""
    schema = arrow(ENTRIES)

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for rows in batches:
            for row in rows.to_pylist():
                _, at, data = _block(row)
                value, owner, _, _ = anchors(data, at, length, gram)
                value = (value >> U(16)) << U(16)
                order = np.argsort(value, kind="stable")  # texts stay in order within an anchor
                value, owner = value[order], owner[order]
                new = np.concatenate([[True], value[1:] != value[:-1]]) if len(value) else np.zeros(0, bool)
                other = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(value) else np.zeros(0, bool)
                heads = np.flatnonzero(new)
                docs = np.add.reduceat((new | other).astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64)
                distinct = value[heads]
                # Anchors are least hashes and so crowd at the low end: mixed again, they are dealt evenly.
                bucket = ((mix(distinct) >> U(32)) * U(buckets)) >> U(32)
                order = np.argsort(bucket, kind="stable")
                bucket, distinct, docs = bucket[order], distinct[order], docs[order]
                cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cuts))
                yield batch(
                    schema, full, np.full(len(full), row["block"]), [_six(distinct[cuts[b] : cuts[b + 1]]) for b in full],
                    [press.compress(docs[cuts[b] : cuts[b + 1]].astype(np.uint32).tobytes()) for b in full],
                )

    return blocks.mapInArrow(released(run), ENTRIES)


def shared_anchors(entries: DataFrame, split_above: int) -> DataFrame:
    """Per block: its anchors that two or more documents of the table have, and which are hot."""
    schema = arrow(SHARED)

    def run(batches):
        held: dict[int, list] = {}
        for rows in batches:
            for r in rows.to_pylist():
                held.setdefault(r["bucket"], []).append(r)
        for bucket in list(held):  # an anchor is in one bucket only
            yield from of_bucket(held.pop(bucket))

    def of_bucket(got):
        unpress = zstandard.ZstdDecompressor()
        values = [_from_six(r["anchors"]) for r in got]
        counts = [np.frombuffer(unpress.decompress(r["docs"]), np.uint32) for r in got]
        every, weight = np.concatenate(values), np.concatenate(counts).astype(np.int64)
        order = np.argsort(every)
        every, weight = every[order], weight[order]
        heads = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        total = np.add.reduceat(weight, heads)
        distinct, total = every[heads][total > 1], total[total > 1]
        if not len(distinct):
            return
        for r, value in zip(got, values, strict=True):
            slot = np.minimum(np.searchsorted(distinct, value), len(distinct) - 1)
            mine = distinct[slot] == value
            if mine.any():
                yield batch(schema, [r["block"]], [_six(value[mine])], [np.packbits(total[slot[mine]] > split_above).tobytes()])

    return entries.mapInArrow(released(run), SHARED)


def _payload(*arrays: np.ndarray, data: np.ndarray) -> bytes:
    head = np.array([len(a) for a in arrays], np.int32).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays) + data.tobytes())


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    sizes, out, place = np.frombuffer(raw, np.int32, 4), [], 16
    for size, kind in zip(sizes.tolist(), (np.int64, np.int32, np.int32, np.int64), strict=True):
        out.append(np.frombuffer(raw, kind, size, place))
        place += size * np.dtype(kind).itemsize
    return *out, np.frombuffer(raw, np.uint8, offset=place)


def copies_of_smaller(data, start, size, whole, doc, order) -> np.ndarray:
    """In ``order`` (equal hashes together, the smallest document first): is it a copy of a smaller document's passage?"""
    first = np.ones(len(order), bool)
    first[1:] = whole[order[1:]] != whole[order[:-1]]
    lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    out = np.zeros(len(order), bool)
    for i in np.flatnonzero(~first & (doc[order] > doc[lead])):  # the same bytes, not only the same hash
        a, b = order[i], lead[i]
        out[i] = size[a] == size[b] and data[start[a] : start[a] + size[a]].tobytes() == data[start[b] : start[b] + size[b]].tobytes()
    return out


def passages(blocks: DataFrame, shared: DataFrame, shards: int, length: int, gram: int) -> DataFrame:
    """Per block and shard: the passages whose windows may be repeats, and runs settled within the block.

    A payload holds, for every passage, its smallest document, its place and size in
    the block, and its bytes. Passages equal to one of a smaller document of the block
    need no shard: they go (shard -1, spans as in REMOVED).
    """
    schema = arrow(PASSAGES)
    grouped = shared.groupBy("block").agg(F.collect_list("anchors").alias("anchors"), F.collect_list("hot").alias("hot"))

    def run(batches):
        for rows in batches:
            for row in rows.to_pylist():
                ids, at, data = _block(row)
                value, owner, start, count = anchors(data, at, length, gram)
                known = [_from_six(a) for a in row["anchors"]]
                hot = np.concatenate([np.unpackbits(np.frombuffer(h, np.uint8))[: len(a)] for h, a in zip(row["hot"], known, strict=True)]).astype(bool)
                known = np.concatenate(known)
                order = np.argsort(known)
                known, hot = known[order], hot[order]
                upper = (value >> U(16)) << U(16)
                slot = np.minimum(np.searchsorted(known, upper), len(known) - 1)
                mine = known[slot] == upper
                upper, owner, start, count, hot = upper[mine], owner[mine], start[mine], count[mine], hot[slot[mine]]
                if hot.any():  # a hot anchor's windows go one by one
                    n = np.where(hot, count, 1)
                    place = np.repeat(np.arange(len(n)), n)
                    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    upper, owner, start, count, hot = upper[place], owner[place], start[place] + step, np.where(hot, 1, count)[place], hot[place]
                size = count + length - 1
                whole = span_hashes(data, start, start + size)
                key = np.where(hot, whole, upper)
                shard = (((mix(key) >> U(32)) * U(shards)) >> U(32)).astype(np.int64)
                doc = ids[owner]
                order = np.lexsort((doc, whole, shard))
                copied = copies_of_smaller(data, start, size, whole, doc, order)
                settled = order[copied]
                if len(settled):
                    spans = np.stack([start[settled], start[settled] + size[settled]], 1).astype(np.int32)
                    yield batch(schema, [-1], [row["block"]], [spans.tobytes()])
                sent = order[~copied]
                cuts = np.searchsorted(shard[sent], np.arange(shards + 1))
                for s in np.flatnonzero(np.diff(cuts)):
                    part = sent[cuts[s] : cuts[s + 1]]
                    take = in_text(size[part], 1)
                    begin = np.concatenate([[0], np.cumsum(size[part])])[:-1]
                    bytes_at = take - np.repeat(begin, size[part]) + np.repeat(start[part], size[part])
                    yield batch(schema, [s], [row["block"]], [_payload(doc[part], start[part].astype(np.int32), size[part].astype(np.int32), key[part].view(np.int64), data=data[bytes_at])])

    return blocks.join(grouped, "block").mapInArrow(released(run), PASSAGES)


def _repeated(data, at, doc, length):
    """Per passage, the places of windows that a smaller document has too: (passage, first byte)."""
    owner, place, common = sorted_suffixes(data, at, length)
    full = np.diff(at)[owner] - place >= length
    head = np.concatenate([[True], common[1:] < length])
    group = np.cumsum(head, dtype=owner.dtype)[full]
    owner, place = owner[full], place[full]
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    if not len(heads):
        return owner, place
    least = np.repeat(np.minimum.reduceat(doc[owner], heads), np.diff(np.append(heads, len(group))))
    gone = doc[owner] > least
    return owner[gone], place[gone]


def removed_runs(moved: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """Per block: the byte runs that a smaller document has too."""
    schema = arrow(REMOVED)

    def runs_of(where, first, end):
        by = np.argsort(where, kind="stable")
        where, spans = where[by], np.stack([first[by], end[by]], 1).astype(np.int32)
        cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        yield batch(schema, where[cuts], [s.tobytes() for s in np.split(spans, cuts[1:])])

    def run(batches):
        got: dict[str, list] = {"block": [], "doc": [], "start": [], "size": [], "key": [], "data": []}
        for rows in batches:
            for block, raw in zip(rows.column("block").to_pylist(), rows.column("payload").to_pylist(), strict=True):
                doc, start, size, key, data = _unpacked(raw)
                for name, x in zip(got, (np.full(len(doc), block), doc, start, size, key, data), strict=True):
                    got[name].append(x)
        if not got["doc"]:
            return
        block, doc, start, size, key, data = (np.concatenate(got.pop(name)) for name in list(got))
        size = size.astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        order = np.argsort(key, kind="stable")
        filled = np.cumsum(size[order])
        fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        i = 0
        while i < len(order):  # as many whole keys as fill a suffix array
            far = int(np.searchsorted(filled, (filled[i - 1] if i else 0) + shard_bytes, "right"))
            later = np.flatnonzero(fresh[max(far, i + 1) :])
            j = max(far, i + 1) + int(later[0]) if len(later) else len(order)
            part = order[i:j]
            at = np.concatenate([[0], np.cumsum(size[part])])
            own = np.arange(at[-1]) - np.repeat(at[:-1], size[part]) + np.repeat(begin[part], size[part])
            text = data[own]
            # What equals a passage of a smaller document goes whole; only distinct passages are sorted.
            whole = span_hashes(text, at[:-1], at[1:])
            order_in = np.lexsort((doc[part], whole))
            copied = np.sort(order_in[copies_of_smaller(text, at[:-1], size[part], whole, doc[part], order_in)])
            if len(copied):
                yield from runs_of(block[part][copied], start[part][copied], start[part][copied] + size[part][copied])
                left = np.ones(len(part), bool)
                left[copied] = False
                text, part = text[np.repeat(left, size[part])], part[left]
                at = np.concatenate([[0], np.cumsum(size[part])])
            passage, place = _repeated(text, at, doc[part], length)
            which = np.lexsort((place, passage))
            passage, first = passage[which], place[which] + start[part][passage[which]]
            if len(passage):
                edge = np.concatenate([[True], (passage[1:] != passage[:-1]) | (first[1:] != first[:-1] + 1)])
                heads = np.flatnonzero(edge)
                tails = np.append(heads[1:] - 1, len(first) - 1)
                yield from runs_of(block[part][passage[heads]], first[heads], first[tails] + length)
            i = j

    return moved.select("block", "payload").mapInArrow(released(run), REMOVED)


def _apply(spans: list[bytes], at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes of a block stay; per text the bytes and the runs that go."""
    step = np.zeros(n + 1, np.int32)
    for raw in spans or []:
        s = np.frombuffer(raw, np.int32).reshape(-1, 2)
        np.add.at(step, s[:, 0], 1)
        np.add.at(step, s[:, 1], -1)
    gone = np.cumsum(step[:n]) > 0
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    edges = at[:-1][at[:-1] < n]
    begins[edges] = gone[edges]
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[at])
    return ~gone, total(gone), total(begins)


def _kept_bytes(row: dict) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Of each text of a block: what stays; bytes before, bytes and runs gone."""
    _, at, data = _block(row)
    stays, removed, runs = _apply(row["spans"], at, len(data))
    left = [data[a:b][stays[a:b]].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    return left, np.diff(at), removed, runs


def _judged(docs: DataFrame, length: int, gram: int, split_above: int, shard_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Blocks with the runs to remove, and the rows that are not in blocks: whole copies and rows without id."""
    spark = docs.sparkSession
    typed = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.coalesce(F.col("text").cast("string"), F.lit(""))})
    keys = cut_lineage(typed.select("doc_id", F.xxhash64("text").alias("digest"), F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")))
    named = keys.filter("doc_id is not null")
    firsts = named.filter(F.col("n_bytes") >= length).groupBy("sha").agg(F.min("doc_id").alias("first"))
    copies = cut_lineage(named.join(firsts, "sha").filter("doc_id > first").select("doc_id", "digest", "n_bytes", F.lit(None).cast("string").alias("sha")))
    aside = copies.unionByName(keys.filter("doc_id is null").select("doc_id", "digest", "n_bytes", "sha"))

    own = typed.filter("doc_id is not null").withColumn("__digest", F.xxhash64("text"))
    own = by_ids(own, copies.select("doc_id", F.col("digest").alias("__digest")).distinct(), "left_anti", ["doc_id", "__digest"]).drop("__digest")
    blocks = cut_lineage(pack_blocks(own))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = anchor_entries(blocks, BUCKETS * parts, length, gram).repartition(parts, "bucket")
    shared = cut_lineage(shared_anchors(entries, split_above))
    moved = cut_lineage(passages(blocks, shared, PER_PARTITION * parts, length, gram))
    found = removed_runs(moved.filter("shard >= 0").repartition(parts, "shard"), length, shard_bytes)
    gone = cut_lineage(found.unionByName(moved.filter("shard < 0").select("block", F.col("payload").alias("spans"))))
    return blocks.join(gone.groupBy("block").agg(F.collect_list("spans").alias("spans")), "block", "left"), aside


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, split_above: int = SPLIT_ABOVE, shard_bytes: int = SHARD) -> DataFrame:
    """Per document: bytes, bytes and runs removed, digest of what is left."""
    blocks, aside = _judged(docs.select("doc_id", "text"), length, gram, split_above, shard_bytes)
    schema = arrow(RESULT)

    def run(batches):
        for rows in batches:
            for row in rows.to_pylist():
                left, before, removed, runs = _kept_bytes(row)
                yield batch(schema, np.frombuffer(row["ids"], np.int64), before, removed, runs, [hashlib.sha256(x).hexdigest() for x in left])

    # A whole copy has no digest of its own left: all its bytes go.
    whole = F.col("sha").isNull()
    rest = aside.select("doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(0).alias("n_removed"), whole.cast("long").alias("n_spans"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("kept_sha256"))
    return blocks.mapInArrow(released(run), RESULT).unionByName(rest)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, split_above: int = SPLIT_ABOVE, shard_bytes: int = SHARD) -> DataFrame:
    """The documents with repeated passages cut out, in their own columns.

    Documents of which nothing is left go. ``n_chars`` follows the text where there is
    such a column. Bytes of a character cut in two are dropped with the passage.
    """
    blocks, _ = _judged(docs, length, gram, split_above, shard_bytes)
    names = docs.columns

    def run(batches):
        for rows in batches:
            for row in rows.to_pylist():
                left, before, _, _ = _kept_bytes(row)
                texts = pa.array([x.decode("utf-8", "ignore") for x in left], pa.string())
                with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(row["rest"])) as stream:
                    whole = stream.read_all().combine_chunks().to_batches()[0]
                columns = {n: whole.column(n) for n in whole.schema.names} | {"text": texts}
                if "n_chars" in columns:
                    columns["n_chars"] = pc.utf8_length(texts).cast(columns["n_chars"].type)
                kept = pa.array([bool(x) or not b for x, b in zip(left, before.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names).filter(kept)

    typed = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    return blocks.mapInArrow(released(run), typed.schema).unionByName(typed.filter("doc_id is null"))
