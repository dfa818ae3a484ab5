"""Near-duplicate embeddings by an inverted multi-index.

Unit vectors are cut into two halves, each half has its own codebook, and a pair of
codewords names a cell of the product grid. A vector looks for its partners in the
cells nearest to it: with its distances to the codewords of both halves in order,
the multi-sequence traversal takes pairs of codewords by rising sum of squared
distances and stops where that sum is ``slack`` above the vector's own cell. The
slack is what ``recall`` of simulated pairs need that lie exactly at the wanted
cosine. Every candidate is then verified in double precision, so no link is wrong;
``recall_of`` measures against brute force what share of the links is found.

The codebooks are fitted on a documented sample (``SAMPLE`` vectors); every vector
is in the index. Work is split so that no cell is too large for a task: residents of
a cell lie in blocks of about ``BLOCK`` vectors, and a visitor is sent to each block
of a cell it visits. One block's residents are held, its visitors stream past.
Equal vectors are one class from the start. Dense groups of near copies (found in
the ``CORES`` fullest cells above ``HOT`` vectors) become cores: vectors within half
the angle of a pivot are all linked with each other, by the triangle inequality, so
nothing in a core is compared; the other vectors meet a core only if they are near
enough to its pivot. Cells beyond those are compared block by block, which is exact.

Edge cases: a vector that is null, empty, zero or holds a null, NaN or infinite
component links with nothing and is answered with 0 links, itself as component and
kept; vectors of other lengths are never linked; a null id is answered with a null
component (the smallest non-null id, where it has links) and is not kept; a repeated
id counts as one vector per row; an empty table gives an empty result; other columns
of the table are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm.joins import components, union_all
from tabulith.llm.words import arrow, batch
from tabulith.session import cut_lineage

COSINE, RECALL = 0.95, 0.999
#: Vectors the codebooks and the slack are fitted on; vectors of a cell on average; vectors of a block.
SAMPLE, OCCUPANCY, BLOCK = 16_384, 256, 512
#: At most so many pivots, taken from cells with more vectors than HOT.
CORES, HOT = 256, 512
#: Rows that are compared with the codebooks at once.
STEP = 2048

VECTORS = "row bigint, vec_id bigint, digest binary, size int, unit binary"
VISITS = "id bigint, n bigint, unit binary, own bigint, cell bigint, core bigint"
LINKS = "id bigint, n bigint, root bigint"


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)


def unit_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector with a number of its own, a digest and the unit vector; both null where there is none."""
    schema = arrow(VECTORS)

    def run(batches):
        for rows in batches:
            column = rows.column("v")
            digests, sizes, units = [], [], []
            for v in column:
                x = np.array([np.nan if c is None else c for c in v.as_py()] if v.is_valid else [], np.float64)
                top = np.abs(x).max() if len(x) else 0.0
                if not np.isfinite(top) or top == 0.0 or not np.isfinite(x).all():
                    digests.append(None), sizes.append(0), units.append(None)
                    continue
                x = x / top  # neither the squares of tiny nor of huge components may leave the range
                raw = (x / math.sqrt(float(x @ x)) + 0.0).tobytes()
                digests.append(hashlib.blake2b(raw, digest_size=16).digest()), sizes.append(len(x)), units.append(raw)
            yield batch(schema, rows.column("row"), rows.column("vec_id"), digests, sizes, units)

    kept = table.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return kept.mapInArrow(run, VECTORS)


def _nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances to the codewords, less the square of the point itself."""
    return (book * book).sum(1) - 2 * points @ book.T


def _codebook(points: np.ndarray, words: int, rng, rounds: int = 12) -> np.ndarray:
    book = points[rng.choice(len(points), words, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([_nearest(points[i : i + STEP], book).argmin(1) for i in range(0, len(points), STEP)])
        sums = np.zeros_like(book)
        np.add.at(sums, own, points)
        counts = np.bincount(own, minlength=words)[:, None]
        book = np.where(counts > 0, sums / np.maximum(counts, 1), book)
    return book


class Grid:
    """Two codebooks, the slack of the traversal, and the pivots of dense groups."""

    def __init__(self, sample: np.ndarray, words: int, cosine: float, recall: float, seed: int = 13):
        rng = np.random.default_rng(seed)
        self.cosine, self.size = cosine, sample.shape[1]
        self.cut = self.size // 2
        self.words = max(1, min(words, len(sample)))
        self.books = [_codebook(half, self.words, rng) for half in (sample[:, : self.cut], sample[:, self.cut :])]
        self.slack = self._slack(sample, recall, rng)
        self.pivots = np.zeros((0, self.size))
        # Half of the largest angle of a link, a little less so that rounding never certifies a pair that is no link.
        self.angle = math.acos(min(1.0, max(-1.0, cosine)))
        self.half = self.angle / 2 - 1e-7

    def _slack(self, sample: np.ndarray, recall: float, rng) -> float:
        aside = rng.standard_normal(sample.shape)
        aside -= (aside * sample).sum(1)[:, None] * sample
        aside /= np.maximum(np.linalg.norm(aside, axis=1), 1e-300)[:, None]
        other = self.cosine * sample + math.sqrt(max(0.0, 1 - self.cosine**2)) * aside
        first, second = self.excess(sample)
        cells = self.cell(other)
        at = np.arange(len(sample))
        return float(np.quantile(first[at, cells // self.words] + second[at, cells % self.words], recall)) + 1e-12

    def excess(self, units: np.ndarray) -> list[np.ndarray]:
        """Per half: how much farther each codeword is than the nearest one (squared)."""
        far = [_nearest(half, book) for half, book in zip((units[:, : self.cut], units[:, self.cut :]), self.books, strict=True)]
        return [d - d.min(1, keepdims=True) for d in far]

    def cell(self, units: np.ndarray) -> np.ndarray:
        first, second = self.excess(units)
        return first.argmin(1) * np.int64(self.words) + second.argmin(1)

    def traverse(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, cell) of the multi-sequence traversal: all pairs of codewords up to the slack, along both sorted lists."""
        first, second = self.excess(units)
        by1, by2 = np.argsort(first, 1, kind="stable"), np.argsort(second, 1, kind="stable")
        near1, near2 = np.take_along_axis(first, by1, 1), np.take_along_axis(second, by2, 1)
        who, cells = [], []
        for rank in range(self.words):
            left = np.flatnonzero(near1[:, rank] <= self.slack)
            if not len(left):
                break
            reach = near2[left] <= (self.slack - near1[left, rank])[:, None]  # sorted, so a prefix of the second list
            row, column = np.nonzero(reach)
            who.append(left[row])
            cells.append(by1[left[row], rank] * np.int64(self.words) + by2[left[row], column])
        return np.concatenate(who), np.concatenate(cells)

    def angles(self, units: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(units @ self.pivots.T, -1, 1))

    def core(self, angles: np.ndarray) -> np.ndarray:
        """The core each vector belongs to, -1 for none."""
        if not angles.shape[1]:
            return np.full(len(angles), -1, np.int64)
        best = angles.argmin(1)
        return np.where(angles[np.arange(len(best)), best] <= self.half, best, -1)


def fit(vectors: DataFrame, size: int, n: int, cosine: float = COSINE, recall: float = RECALL, occupancy: int = OCCUPANCY) -> Grid:
    """Codebooks from ``SAMPLE`` distinct vectors, chosen by a hash of their content."""
    rows = vectors.filter(F.col("size") == size).select("digest", "unit").orderBy(F.xxhash64("digest")).limit(SAMPLE).collect()
    sample = np.frombuffer(b"".join({bytes(r.digest): bytes(r.unit) for r in rows}.values()), np.float64).reshape(-1, size)
    return Grid(sample, max(1, round(math.sqrt(n / occupancy))), cosine, recall)


def pivots(indexed: DataFrame, grid: Grid, hot: int = HOT, cores: int = CORES) -> np.ndarray:
    """The middle of the densest group of each of the fullest cells, from a bounded sample of each cell's vectors."""
    full = indexed.groupBy("cell").count().filter(F.col("count") > hot).orderBy(F.desc("count"), "cell").limit(cores).collect()
    if not full:
        return np.zeros((0, grid.size))
    counts = {r["cell"]: r["count"] for r in full}
    # 128 vectors of a cell on average, and never more than 256 reach the driver's share of one.
    parts = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, max(1, n // 128))])
    picked = indexed.filter(F.col("cell").isin(list(counts))).withColumn("turn", F.pmod(F.xxhash64("id", F.lit(7)), parts[F.col("cell")]))

    def middles(key, rows):
        units = _matrix(rows.column("unit").slice(0, 256), grid.size)
        dots = units @ units.T
        near = dots >= math.cos(grid.half)
        best = int(near.sum(1).argmax())
        dense = int(near[best].sum()) * 8 >= len(units) and near[best].sum() > 1
        mean = units[near[best]].mean(0)
        raw = (mean / np.linalg.norm(mean)).tobytes()
        return pa.table({"cell": pa.array([key[0].as_py()] if dense else [], pa.int64()), "pivot": pa.array([raw] if dense else [], pa.binary())})

    found = picked.filter("turn = 0").select("cell", "unit").groupBy("cell").applyInArrow(middles, "cell bigint, pivot binary").orderBy("cell").collect()
    chosen: list[np.ndarray] = []
    for r in found:  # at most one a cell
        x = np.frombuffer(r.pivot, np.float64)
        if all(float(x @ c) < math.cos(grid.half / 2) for c in chosen):
            chosen.append(x)
    return np.array(chosen).reshape(-1, grid.size)


def _residents(indexed: DataFrame, sent) -> DataFrame:
    schema = arrow("id bigint, n bigint, unit binary, cell bigint, core bigint")

    def run(batches):
        grid = sent.value
        for rows in batches:
            for i in range(0, rows.num_rows, STEP):
                part = rows.slice(i, STEP)
                core = grid.core(grid.angles(_matrix(part.column("unit"), grid.size)))
                yield batch(schema, part.column("id"), part.column("n"), part.column("unit"), part.column("cell"), core)

    return indexed.select("id", "n", "unit", "cell").mapInArrow(run, "id bigint, n bigint, unit binary, cell bigint, core bigint")


def _visits(indexed: DataFrame, sent) -> DataFrame:
    """Where each vector has to look. Of two cells the smaller one's vectors visit the larger one; a core is only visited."""
    schema = arrow(VISITS)

    def run(batches):
        grid = sent.value
        for rows in batches:
            for i in range(0, rows.num_rows, STEP):
                part = rows.slice(i, STEP)
                units = _matrix(part.column("unit"), grid.size)
                own = part.column("cell").to_numpy()
                angles = grid.angles(units)
                core = grid.core(angles)
                who, cells = grid.traverse(units)
                plain = (cells >= own[who]) & (core[who] < 0)
                at, to, into = [who[plain]], [cells[plain]], [np.full(plain.sum(), -1)]
                for c in range(len(grid.pivots)):
                    near = (angles[:, c] <= grid.angle + grid.half + 1e-6) & (core < c)  # outside every core, or in an earlier one
                    mine = near[who]
                    at.append(who[mine]), to.append(cells[mine]), into.append(np.full(mine.sum(), c))
                at, to, into = np.concatenate(at), np.concatenate(to), np.concatenate(into)
                for j in range(0, len(at), 4 * STEP):
                    k = slice(j, j + 4 * STEP)
                    yield batch(schema, part.column("id").take(at[k]), part.column("n").take(at[k]), part.column("unit").take(at[k]), own[at[k]], to[k], into[k])

    return indexed.select("id", "n", "unit", "cell").mapInArrow(run, VISITS)


class _Block:
    """The residents of one block; visitors stream past, links are summed and joined to trees."""

    def __init__(self, cosine: float, size: int):
        self.cosine, self.size = cosine, size
        self.parts, self.ids, self.weights, self.closed = [], [], [], False

    def add(self, ids, weights, units):
        self.ids.append(ids), self.weights.append(weights), self.parts.append(units)

    def close(self):
        empty = [np.zeros(0, np.int64)]
        self.ids, self.weights = np.concatenate(self.ids or empty), np.concatenate(self.weights or empty)
        self.units = np.concatenate(self.parts) if self.parts else np.zeros((0, self.size))
        self.found, self.tree, self.closed = np.zeros(len(self.ids), np.int64), np.arange(len(self.ids)), True

    def root(self, i: int) -> int:
        while self.tree[i] != i:
            self.tree[i] = self.tree[self.tree[i]]
            i = self.tree[i]
        return int(i)

    def meet(self, ids, weights, units, inside: bool):
        """Verified links of some visitors: their counts and one resident each; the residents' own counts stay here."""
        close = units @ self.units.T >= self.cosine
        if inside:  # residents and visitors are the same vectors: a pair counts once, from its smaller id
            close &= ids[:, None] < self.ids[None, :]
        linked = np.flatnonzero(close.any(1))
        close = close[linked]
        self.found += close.T.astype(np.int64) @ weights[linked]
        for row in close:
            first, *others = np.flatnonzero(row)
            first = self.root(first)
            for p in others:
                if self.tree[p] != first:
                    other = self.root(p)
                    first, other = min(first, other), max(first, other)
                    self.tree[other] = first
        return ids[linked], close.astype(np.int64) @ self.weights, self.ids[close.argmax(1)]

    def rest(self):
        linked = np.flatnonzero(self.found)
        return self.ids[linked], self.found[linked], self.ids[[self.root(i) for i in linked]] if len(linked) else self.ids[:0]


def _compare(sent):
    """Rows come sorted by block, its residents first."""
    schema = arrow(LINKS)

    def run(batches):
        grid = sent.value
        at, block = None, None
        for rows in batches:
            if not rows.num_rows:
                continue
            keys = np.stack([rows.column(c).to_numpy() for c in ("cell", "core", "block", "kind")], 1)
            ids, weights, own = (rows.column(c).to_numpy() for c in ("id", "n", "own"))
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if tuple(keys[a, :3]) != at:
                    if block is not None and block.closed:
                        yield batch(schema, *block.rest())
                    at, block = tuple(keys[a, :3]), _Block(grid.cosine, grid.size)
                for i in range(a, b, STEP):
                    j = min(b, i + STEP)
                    units = _matrix(rows.column("unit").slice(i, j - i), grid.size)
                    if keys[a, 3] == 0:
                        block.add(ids[i:j], weights[i:j], units)
                        continue
                    if not block.closed:
                        block.close()
                    if len(block.ids):
                        home = (own[i:j] == at[0]) & (at[1] < 0)
                        for inside in (False, True):
                            some = home == inside
                            if some.any():
                                yield batch(schema, *block.meet(ids[i:j][some], weights[i:j][some], units[some], inside))
        if block is not None and block.closed:
            yield batch(schema, *block.rest())

    return run


def _links(indexed: DataFrame, grid: Grid, block: int) -> DataFrame:
    """(id, n, root): verified or certified links of a vector, to be summed, and a vector of the same component."""
    spark = indexed.sparkSession
    sent = spark.sparkContext.broadcast(grid)
    home = _residents(indexed, sent)
    sizes = cut_lineage(home.groupBy("cell", "core").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    residents = home.join(sizes, ["cell", "core"]).select(
        "cell", "core", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.lit(0).alias("kind"), F.col("cell").alias("own"), "id", "n", "unit"
    )
    visitors = _visits(indexed, sent).join(sizes, ["cell", "core"]).select(
        "cell", "core", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "own", "id", "n", "unit"
    )
    met = residents.unionByName(visitors).repartition("cell", "core", "block").sortWithinPartitions("cell", "core", "block", "kind")
    found = met.mapInArrow(_compare(sent), LINKS)
    if not len(grid.pivots):
        return found
    inside = home.filter("core >= 0")
    cores = inside.groupBy("core").agg(F.sum("n").alias("all"), F.min("id").alias("root"))  # at most CORES rows
    certified = inside.select("core", "id", "n").join(F.broadcast(cores), "core").select("id", (F.col("all") - F.col("n")).alias("n"), "root")
    return found.unionByName(certified)


def near_duplicate_vectors(
    table: DataFrame, cosine: float = COSINE, recall: float = RECALL, occupancy: int = OCCUPANCY, block: int = BLOCK, hot: int = HOT, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Per vector: vec_id, n_links (other vectors linked directly), component_id, kept (the smallest id of its component)."""
    vectors = cut_lineage(unit_vectors(table, key, vector))
    good = vectors.filter("digest is not null")
    classes = cut_lineage(good.groupBy("size", "digest").agg(F.count("*").alias("n"), F.min("row").alias("id"), F.min("vec_id").alias("least")))
    found = []
    for size, n in classes.groupBy("size").count().orderBy("size").collect():
        grid = fit(good, size, n, cosine, recall, occupancy)
        sent = table.sparkSession.sparkContext.broadcast(grid)
        one = vectors.select(F.col("row").alias("id"), "unit").join(classes.filter(F.col("size") == size).select("id", "n"), "id")
        indexed = cut_lineage(_cells(one, sent))
        grid.pivots = pivots(indexed, grid, hot)
        found.append(cut_lineage(_links(indexed, grid, block)))
    if not found:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    links = union_all(found)
    counts = links.groupBy("id").agg(F.sum("n").alias("n_links"))
    groups = components(links.select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("id"), "component")
    known = cut_lineage(classes.join(counts, "id", "left").join(groups, "id", "left"))
    smallest = known.filter("component is not null").groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(smallest, "component", "left").select(
        "size", "digest", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")
    )
    linked = vectors.select("vec_id", "size", "digest").join(known, ["size", "digest"], "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return linked.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )


def _cells(classes: DataFrame, sent) -> DataFrame:
    schema = arrow("id bigint, n bigint, unit binary, cell bigint")

    def run(batches):
        grid = sent.value
        for rows in batches:
            for i in range(0, rows.num_rows, STEP):
                part = rows.slice(i, STEP)
                yield batch(schema, part.column("id"), part.column("n"), part.column("unit"), grid.cell(_matrix(part.column("unit"), grid.size)))

    return classes.select("id", "n", "unit").mapInArrow(run, "id bigint, n bigint, unit binary, cell bigint")
