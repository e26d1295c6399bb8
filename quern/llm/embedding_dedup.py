"""Embedding near-dedup with an inverted multi-index.

Independent codebooks on the two halves of the normalised vectors give a product grid of cells. A
vector visits cells in the order of a multi-sequence traversal: by rising lower bound of the distance
from it to any vector of the cell (the distances to the bisectors between its own centroids and the
cell's, squared and added), until the bound that covers the target recall. Visited vectors of the same
label are verified by cosine in double precision.

For a target recall below 1 the bound is calibrated on the sampled pairs above the threshold (SLACK times
what they need, and FLOOR of what the threshold implies at least); for 1 it is what the threshold
implies, and no pair is missed. A cell is worked on in blocks of BLOCK vectors against parts of ASKING
vectors that visit it, as matrix products that give counts and spanning forests, never pairs; so a hot cell
or label is many tasks, and each holds a bounded number of vectors. A pair found from one side counts for both.

Equal vectors form one class, compared once and counted with its size. Each vector length has an index of
its own, for the LENGTHS most frequent ones; the codebooks come from a bounded sample of it (SAMPLE classes,
those with the smallest hashes). Every row is indexed: vectors of any further length share one cell a label
and length, whose blocks are all compared.

Defined cases. Vectors that are null, zero, or hold null or
non-finite components, and rows whose label is null, link with nothing (n_links 0, their own
component). Vectors of different lengths don't link. Rows with a null vec_id link with nothing and get null component_id and kept. Repeated
rows link with each other. Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components, forest
from .shared import Scratch, map_arrow, partitions, small_batches

THRESHOLD, RECALL = 0.98, 0.999
SAMPLE, ROUNDS, BLOCK, ASKING = 4096, 12, 512, 512
#: Classes of a label that a cell holds on average; codebooks have between 4 and 1024 centroids.
PER_CELL = 256
SLACK, FLOOR = 4.0, 0.1
#: Vector lengths that get an index, and the cells that an index can have at most.
LENGTHS, CELLS = 16, 1 << 20


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(ROUNDS):
        own = squared(x, centres).argmin(axis=1)
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None], 0)


class MultiIndex:
    """Two codebooks, and the bound up to which cells are visited."""

    def __init__(self, sample: np.ndarray, k: int, threshold: float = THRESHOLD, recall: float = RECALL):
        self.half = sample.shape[1] // 2
        self.books = [kmeans(x, k, s) for s, x in enumerate((sample[:, : self.half], sample[:, self.half :]))]
        self.apart = [np.sqrt(np.maximum(squared(c, c), 1e-24)) for c in self.books]
        self.bound = 2 - 2 * threshold + 1e-9
        near = sample @ sample.T >= threshold
        i, j = np.nonzero(np.triu(near, 1))
        if recall < 1 and len(i) >= 50:
            own, low = self.bounds(sample)
            seen = low[0][i, own[0][j]] + low[1][i, own[1][j]]
            self.bound = min(self.bound, max(FLOOR * self.bound, SLACK * float(np.quantile(seen, recall))))

    def bounds(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Own centroid in each half; squared lower bounds of the distance to vectors of each other centroid."""
        own, low = [], []
        for h, part in enumerate((x[:, : self.half], x[:, self.half :])):
            d = squared(part, self.books[h])
            a = d.argmin(axis=1)
            gap = (d - d[np.arange(len(d)), a][:, None]) / (2 * self.apart[h][a])
            gap[np.arange(len(d)), a] = 0
            own.append(a)
            low.append(gap * gap)
        return own, low

    def visits(self, low: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(vector, cell) in the order of the traversal of each vector: by rising bound, up to the limit."""
        order = [np.argsort(x, axis=1, kind="stable") for x in low]
        rise = [np.take_along_axis(x, o, axis=1) for x, o in zip(low, order, strict=True)]
        reach = [(r <= self.bound).sum(axis=1) for r in rise]
        rows, cells = [], []
        a, b = int(reach[0].max()), int(reach[1].max())
        for i in range(a):  # a step along one sequence; the other advances while the sum allows
            live = np.flatnonzero(reach[0] > i)
            ok = rise[0][live, i][:, None] + rise[1][live, :b] <= self.bound
            v, j = np.nonzero(ok)
            rows.append(live[v])
            cells.append(order[0][live[v], i] * len(self.books[1]) + order[1][live[v], j])
        return np.concatenate(rows), np.concatenate(cells)


def _classes(single: bool):
    """A class for each sound vector: its label and bytes, in the column's own precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield from _rows(batch, single)

    return run


def vectors_of(data, single: bool) -> np.ndarray:
    """Vectors of one length, from their bytes."""
    return unit(np.stack([np.frombuffer(x if isinstance(x, bytes) else x.as_py(), np.float32 if single else np.float64) for x in data]))


def _rows(batch: pa.RecordBatch, single: bool) -> Iterator[dict]:
    """Whole columns at a time: which lists hold finite numbers only, and not only zeros; the sound ones' bytes."""
    if not batch.num_rows:
        return
    lists = batch.column(2)
    lists = lists.cast(pa.large_list(pa.float64())) if not pa.types.is_large_list(lists.type) else lists
    start = lists.offsets.to_numpy()
    size = np.diff(start)
    flat = lists.values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad, some = (np.concatenate([[0], np.cumsum(x)]) for x in (~np.isfinite(flat), flat != 0))
    ok = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[start[1:]] == bad[start[:-1]]) & (some[start[1:]] > some[start[:-1]])
    ok &= batch.column(0).is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        raw = np.ascontiguousarray(flat.astype(np.float32) if single else flat).view(np.uint8).tobytes()
    width = 4 if single else 8
    labels = batch.column(1).fill_null(0).to_numpy()
    data = [raw[a * width : (a + n) * width] if good else None for a, n, good in zip(start[:-1].tolist(), size.tolist(), ok.tolist(), strict=True)]
    cls = [None if x is None else xxhash.xxh3_64_intdigest(x, seed=int(label) & (2**64 - 1)) - (1 << 63) for x, label in zip(data, labels.tolist(), strict=True)]
    yield {"vec_id": batch.column(0), "label": batch.column(1), "cls": cls, "data": data}


def _place(index, single: bool):
    """A row per class in its own cell (ask false), and one for each cell that it visits (ask true)."""

    def rows(part: pa.RecordBatch, at: pa.Array, cell: np.ndarray, ask: bool) -> dict:
        cls, label, data, n = (c.take(at) for c in part.columns)
        return {"label": label, "cell": cell, "cls": cls, "n": n, "data": data, "ask": np.full(len(cell), ask)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        indexes: dict[int, tuple[int, MultiIndex]] = index.value
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                chunk = batch.slice(a, 2048)
                sizes = pa.compute.binary_length(chunk.column(2)).to_numpy()
                for size in np.unique(sizes).tolist():
                    part = chunk.filter(pa.array(sizes == size))
                    every = pa.array(np.arange(part.num_rows))
                    if size not in indexes:
                        cell = np.full(part.num_rows, -size, np.int64)
                        yield rows(part, every, cell, False)
                        yield rows(part, every, cell, True)
                        continue
                    rank, m = indexes[size]
                    own, low = m.bounds(vectors_of(part.column(2), single))
                    row, cell = m.visits(low)
                    yield rows(part, every, rank * CELLS + own[0] * len(m.books[1]) + own[1], False)
                    yield rows(part, pa.array(row), rank * CELLS + cell, True)

    return run


def _verify(index, threshold: float, single: bool):
    """Of each (label, cell, block, part): links counted for both sides, and a forest of them. Rows come sorted by that key."""

    def work(x: pa.Table) -> Iterator[dict]:
        ask = x["ask"].to_numpy()
        cls, n = x["cls"].to_numpy(), x["n"].to_numpy()
        points, asking = np.flatnonzero(~ask), np.flatnonzero(ask)
        if not len(points) or not len(asking):
            return
        vectors = vectors_of(x["data"], single)
        _, m = index.value.get(len(x["data"][0].as_py()), (0, None))
        own, low = m.bounds(vectors) if m else (None, None)
        counts = np.zeros(len(cls), np.int64)
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        for a in range(0, len(asking), BLOCK):
            q = asking[a : a + BLOCK]
            i, j = np.nonzero(vectors[q] @ vectors[points].T >= threshold)
            i, j = q[i], points[j]
            other = cls[i] != cls[j]
            i, j = i[other], j[other]
            np.add.at(counts, i, n[j])
            if m:
                # where the point doesn't visit the asker's cell, nobody else counts this link for it
                back = low[0][j, own[0][i]] + low[1][j, own[1][i]] > m.bound
                np.add.at(counts, j[back], n[i][back])
            if len(i):
                edges.append(forest(cls[i], cls[j]))
        some = np.flatnonzero(counts)
        none = pa.nulls(len(some), pa.int64())
        yield {"cls": cls[some], "links": counts[some], "a": none, "b": none}
        for v, to in edges:
            none = pa.nulls(len(v), pa.int64())
            yield {"cls": none, "links": none, "a": v, "b": to}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([c.to_numpy() for c in batch.columns[:4]])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            bounds = [0, *cut.tolist(), batch.num_rows]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                now = tuple(key[:, a])
                if now != last and held:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                last = now
                held.append(batch.slice(a, b - a))
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def fit(classes: DataFrame, threshold: float, recall: float, single: bool) -> dict[int, tuple[int, MultiIndex]]:
    """(rank, index) of each of the most frequent sizes of vectors in bytes. The driver gets at most SAMPLE vectors of each."""
    size = F.octet_length("data")
    usual = classes.groupBy(size.alias("size")).count().orderBy(F.desc("count"), "size").limit(LENGTHS).collect()
    out = {}
    for rank, u in enumerate(usual):
        part = classes.filter(size == u["size"]).select("data", "label", F.pmod(F.xxhash64("cls"), F.lit(1 << 32)).alias("h"))
        rows = part.filter(F.col("h") < int((1 << 32) * min(1.0, (2 * SAMPLE + 100) / u["count"]))).orderBy("h").limit(SAMPLE).collect()
        if not rows:
            continue
        sample = vectors_of([bytes(r.data) for r in rows], single)
        labels = len({r.label for r in rows})
        k = int(np.clip(2 ** round(np.log2(max(1, u["count"] / labels / PER_CELL)) / 2), 4, int(CELLS**0.5)))
        out[u["size"]] = rank, MultiIndex(sample, k, threshold, recall)
    return out


def dedup(embeddings: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    spark = embeddings.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "embedding_dedup")
    single = dict(embeddings.dtypes)["embedding"] == "array<float>"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = scratch.table(map_arrow(rows, _classes(single), "vec_id long, label long, cls long, data binary"), "rows")
    classes = rows.filter("cls is not null").groupBy("cls").agg(F.first("label").alias("label"), F.first("data").alias("data"), F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = scratch.table(classes, "classes")
    index = fit(classes, threshold, recall, single)
    own = rows.select("vec_id", "cls")
    alone = own.filter("cls is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), (F.col("vec_id") == F.col("vec_id")).alias("kept"))
    if not index:
        return alone
    shared = spark.sparkContext.broadcast(index)
    placed = scratch.table(map_arrow(classes.select("cls", "label", "data", "n"), _place(shared, single), "label long, cell long, cls long, n long, data binary, ask boolean"), "placed")
    several = lambda of, size: F.ceil(F.count(F.when(of, 1)) / size).cast("int")
    blocks = placed.groupBy("label", "cell").agg(several(~F.col("ask"), BLOCK).alias("blocks"), several(F.col("ask"), ASKING).alias("parts")).filter("blocks > 0 and parts > 0")
    dealt = placed.join(scratch.table(blocks, "blocks"), ["label", "cell"])
    # a point is in one block and meets all parts of the askers, an asker is in one part and meets all blocks
    one = lambda n, salt: F.array(F.pmod(F.xxhash64("cls", F.lit(salt)), F.col(n).cast("long")).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = dealt.select("label", "cell", F.when(F.col("ask"), every("blocks")).otherwise(one("blocks", 1)).alias("in_blocks"), F.when(F.col("ask"), one("parts", 2)).otherwise(every("parts")).alias("in_parts"), "cls", "n", "data", "ask")
    dealt = dealt.select("label", "cell", F.explode("in_blocks").alias("block"), "in_parts", "cls", "n", "data", "ask").select("label", "cell", "block", F.explode("in_parts").alias("part"), "cls", "n", "data", "ask")
    dealt = dealt.repartition(partitions(spark), "label", "cell", "block", "part").sortWithinPartitions("label", "cell", "block", "part")
    found = scratch.table(map_arrow(dealt, _verify(shared, threshold, single), "cls long, links long, a long, b long"), "found")
    scratch.drop("placed")
    comp = components(found.filter("a is not null").select("a", "b"), scratch, "comp")
    links = found.filter("cls is not null").groupBy("cls").agg(F.sum("links").alias("links"))
    per = classes.select("cls", "first", "n").join(links, "cls", "left").join(comp, F.col("cls") == F.col("v"), "left")
    per = scratch.table(per.select("cls", "first", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("m", "cls").alias("comp")), "per")
    low = per.groupBy("comp").agg(F.min("first").alias("component_id"))
    per = scratch.table(per.join(low, "comp").select("cls", "n_links", "component_id"), "results")
    linked = own.filter("cls is not null").join(per, "cls").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.union(alone)


#: All pairs of a label, and their components.
OP8_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= {THRESHOLD}),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
n AS (SELECT a, count(*) AS n FROM e GROUP BY 1),
r AS (SELECT DISTINCT a AS v, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON r.v = e.a WHERE r.c < e.b),
t AS (SELECT v, min(c) AS c FROM r GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(t.c, vec_id) AS component_id, vec_id = coalesce(t.c, vec_id) AS kept
FROM v LEFT JOIN n ON vec_id = n.a LEFT JOIN t ON vec_id = t.v
"""


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
