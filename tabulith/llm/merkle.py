"""Merkle manifest of a dataset: a tree per source, a tree over the sources, a proof per document.

A leaf is the hash of a document's fields. Leaves of a source stand in the order of
their ids; while several nodes remain, every ``ARITY`` consecutive ones become the
hash of their digests. What remains is the source's subroot; subroots, in the order
of their sources, likewise give the root.

A level is one self-join: each node asks for its siblings by their computed places
(for two children a place is XORed with 1, else the slot is shifted within the run),
and the rows in slot zero, who then know their whole run, emit the parents. Both
sides lie by run, so that the join and the gathering of a node's siblings need no
other exchange than that of the nodes themselves. All trees go up together; a finished tree stays behind. Levels
above the leaves are tables in the shared folder. Paths are then handed down from the
top: a parent's path is read once by each of its children, so a leaf is joined to
its siblings and to one row of its parent, and is folded up to the root in place.

Places come from a sort by range: a task numbers its rows of each source, and what
earlier tasks hold of the source that a task starts with is added, one row per task.
No source, however large, is ordered in one task.

Edge cases: a null in any field hashes as ``-``; null sources are one tree, the first;
null ids come first in their source; equal ids stand in the order of their leaves,
and repeated rows are leaves each (equal ones are interchangeable); the empty text is
a value of length 0; a lone leaf is its source's subroot and a lone subroot the root,
so one document's proof is the hash of the empty string; an empty table gives an
empty manifest; other columns of the table are not read.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulith.llm.joins import union_all
from tabulith.session import cut_lineage

ARITY = 16
#: The fields of a document, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon, the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(fields[f]) for f in FIELDS]), 256))


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _numbered(batches):
    """Adds the task and the place of a row among the task's rows of its tree; rows come sorted by tree."""
    part = TaskContext.get().partitionId()
    tree, place = None, 0
    for rows in batches:
        if not rows.num_rows:
            continue
        trees = rows.column("tree")
        first = np.ones(rows.num_rows, bool)
        first[1:] = pc.not_equal(trees.slice(1), trees.slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False)
        first[0] = trees[0].as_py() != tree
        starts = np.flatnonzero(first)
        at = np.arange(rows.num_rows)
        places = at + place
        if len(starts):
            since = np.searchsorted(starts, at, "right") - 1
            places = np.where(since >= 0, at - starts[np.maximum(since, 0)], places)
        tree, place = trees[rows.num_rows - 1].as_py(), int(places[-1]) + 1
        for i in range(0, rows.num_rows, 4096):
            yield pa.RecordBatch.from_arrays(
                [*rows.slice(i, 4096).columns, pa.array(np.full(min(4096, rows.num_rows - i), part), pa.int32()), pa.array(places[i : i + 4096], pa.int64())],
                names=[*rows.schema.names, "part", "place"],
            )


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with a ``tree``) and ``place``, their place from 0 in their tree by ``order``, and ``n``, the tree's rows."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sort = ["tree", *[F.col(c).asc_nulls_first() for c in order]]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = cut_lineage(rows.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).mapInArrow(_numbered, f"{kinds}, part int, place bigint"))
    held = cut_lineage(placed.groupBy("part", "tree").agg(F.count("*").alias("held")))
    # Only a task's first tree can have rows in earlier tasks, and only its last one in later ones: two rows a task.
    ends = held.groupBy("part").agg(F.min("tree").alias("first"), F.max("tree").alias("last"))
    edge = held.join(ends, "part").filter("tree = first or tree = last")
    earlier = F.sum("held").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = edge.withColumn("before", earlier).filter("tree = first and before > 0").select("part", "tree", "before")
    totals = held.groupBy("tree").agg(F.sum("held").alias("n"))
    shifts = held.join(totals, "tree").join(offsets, ["part", "tree"], "left").select("part", "tree", "n", F.coalesce("before", F.lit(0)).alias("before"))
    return placed.join(cut_lineage(shifts), ["part", "tree"]).withColumn("place", F.col("place") + F.col("before")).drop("part", "before")


def _siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes with the digests left and right of them in their run, by one equijoin on the run that their place computes to.

    Which of the run's places are siblings is the second half of the computed index
    (the slot shifted by 1 to ``arity`` - 1, XOR 1 for two children). It is tested
    inside the join: as a join key of its own it would cost every digest a further
    exchange for each sibling.
    """
    by_run = nodes.withColumn("run", F.floor(F.col("place") / arity)).repartition("tree", "run")
    own = by_run.select("*")
    other = by_run.select(F.col("tree").alias("_tree"), F.col("run").alias("_run"), F.col("place").alias("asked"), F.col("digest").alias("other"))
    shift = F.col("asked").bitwiseXOR(F.col("place")) == 1 if arity == 2 else F.pmod(F.col("asked") - F.col("place"), F.lit(arity)) > 0
    met = own.join(other, (F.col("tree") == F.col("_tree")) & (F.col("run") == F.col("_run")) & shift, "left")
    keep = [c for c in nodes.columns if c not in ("tree", "place")]
    gathered = met.groupBy("tree", "run", "place").agg(*[F.first(c).alias(c) for c in keep], F.sort_array(F.collect_list(F.struct("asked", "other"))).alias("run_of"))
    side = lambda test: F.transform(F.filter("run_of", test), lambda x: x["other"])
    return gathered.select(
        "tree", "run", "place", *keep, side(lambda x: x["asked"] < F.col("place")).alias("before"), side(lambda x: x["asked"] > F.col("place")).alias("after")
    )


def _joined(digests: Column) -> Column:
    return F.array_join(F.transform(digests, _hex), "")


def _parents(linked: DataFrame, arity: int) -> DataFrame:
    """The row in slot zero knows its run: it becomes the parent."""
    return linked.filter(F.pmod("place", F.lit(arity)) == 0).select(
        "tree", F.col("run").alias("place"), F.ceil(F.col("n") / arity).alias("n"), F.unhex(F.sha2(F.concat(_hex(F.col("digest")), _joined(F.col("after"))), 256)).alias("digest")
    )


def _levels(leaves: DataFrame, arity: int) -> list[DataFrame]:
    """All levels above ``leaves`` (tree, place, n, digest), each a written table; a tree with one node goes no further."""
    top, levels, nodes = leaves.agg(F.max("n")).first()[0] or 1, [], leaves
    while top > 1:
        above = _siblings_above(nodes, arity)
        levels.append(above)
        nodes, top = above, -(-top // arity)
    return levels


def _siblings_above(nodes: DataFrame, arity: int) -> DataFrame:
    return cut_lineage(_parents(_siblings(nodes.filter("n > 1").select("tree", "place", "n", "digest"), arity), arity))


def _paths(levels: list[DataFrame], ends: DataFrame, arity: int) -> DataFrame:
    """Of the lowest of ``levels``, and of lone leaves: (tree, place, path, ...); ``ends`` (tree, path, ...) is where a tree's path goes on."""
    carried = [c for c in ends.columns if c not in ("tree", "path")]
    above = None
    for nodes in reversed(levels):
        done = nodes.filter("n = 1").select("tree", "place").join(ends, "tree")
        if above is not None:
            linked = _siblings(nodes.filter("n > 1"), arity)
            up = above.withColumnRenamed("place", "run")
            climbing = linked.join(up, ["tree", "run"]).withColumn("path", F.concat(F.array(F.struct("before", "after")), F.col("path")))
            done = done.unionByName(climbing.select("tree", "place", "path", *carried))
        above = cut_lineage(done)
    return above


PATH = "array<struct<before:array<binary>,after:array<binary>>>"


def manifest(docs: DataFrame, arity: int = ARITY, tampered: Column | None = None) -> DataFrame:
    """Per document: its leaf, subroot and root, the hash of its proof, and the root refolded from the row as it is found.

    ``tampered`` tells whose text is found with its A-Z lower-cased; by default the
    documents whose unsigned crc32 of the decimal id is a multiple of 5.
    """
    fields = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}
    read = docs.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in fields.items()])
    now = {c: F.col(c) for c in FIELDS}
    bad = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0 if tampered is None else tampered, F.lit(False))
    digests = read.select(
        F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")).alias("tree"),
        "doc_id", leaf(now).alias("digest"), F.when(bad, leaf({**now, "text": lowered(F.col("text"))})).alias("found"),
    )
    leaves = cut_lineage(numbered(digests, ["doc_id", "digest"]))
    levels = _levels(leaves, arity)
    tree = ["tree", "digest"]
    subroots = union_all([x.filter("n = 1").select(*tree) for x in [leaves, *levels]])
    tops = cut_lineage(numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), ["source"]))
    upper = _levels(tops, arity)
    root = union_all([x.filter("n = 1").select(*tree) for x in [tops, *upper]])
    end = root.select("tree", F.lit(None).cast(PATH).alias("path"), F.col("digest").alias("root")).withColumn("path", F.coalesce("path", F.array().cast(PATH)))
    ends = cut_lineage(_folded(tops, _paths(upper, end, arity) if upper else None, end, arity).select(F.col("source").alias("tree"), F.col("digest").alias("subroot"), "path", "root"))
    proven = _folded(leaves, _paths(levels, ends, arity) if levels else None, ends, arity)
    fold = F.aggregate(
        "path", F.coalesce("found", "digest"), lambda node, x: F.unhex(F.sha2(F.concat(_joined(x["before"]), _hex(node), _joined(x["after"])), 256))
    )
    siblings = F.array_join(F.transform("path", lambda x: F.concat(_joined(x["before"]), _joined(x["after"]))), "")
    out = proven.select("doc_id", "digest", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold.alias("folded"))
    return out.select(
        "doc_id", _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"), "proof_sha256",
        _hex(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


def _folded(leaves: DataFrame, above: DataFrame | None, ends: DataFrame, arity: int) -> DataFrame:
    """Leaves with their whole path: their own siblings, then their parent's path; a lone leaf goes on with ``ends``."""
    lone = leaves.filter("n = 1").join(ends, "tree")
    if above is None:
        return lone
    linked = _siblings(leaves.filter("n > 1"), arity)
    climbing = linked.join(above.withColumnRenamed("place", "run"), ["tree", "run"]).withColumn("path", F.concat(F.array(F.struct("before", "after")), F.col("path")))
    return lone.unionByName(climbing.select(*lone.columns))
