"""Vectors in cells: cosine search and similarity joins that are exact and leave out what cannot match.

K-means over all vectors (brought to unit length) gives cells with a centre and a
radius. Of a query q and a member x of a cell with centre c and radius r,
q.x <= q.c + r and, as |q - x| >= |q - c| - r and |x| <= 1, q.x <= 1 - (|q - c| - r)^2 / 2.

A search takes the nearest cells first; the k-th best score there is a bar, and
only cells whose bound reaches it are searched besides. With a limit only the nearest
cells are searched, and neighbours may be missed.

A join compares a vector with the members of another cell where one may be similar enough: by
these bounds, and because a member of that cell lies beyond the plane halfway between both
centres. Equal vectors are one. No vector is copied and no pair is listed: blocks of cells are
read where they lie and compared as matrices, in single precision first, and only counts go on. So a
join takes disk in proportion to the vectors, however they are spread, and time by their square at worst.

How much is left out depends on the vectors: much where they form groups, little where
they have none. The result is the same. Centres are held by every task, at most max_cells of them.

Defined results: null embeddings are in no cell, find nothing, are not found, and have no links.
A zero vector has cosine 0 with all others and itself. Ties go by position. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.retrieval import PLACES, SLACK, small, top_k
from lodestone.session import drop_stash, shared_path, ship_package, shuffles_dropped, stash


@dataclass(frozen=True)
class Settings:
    """members: of a cell, on average; max_cells: more members above so many cells; block: vectors in a matrix; probe: cells searched first."""

    members: int = 256
    max_cells: int = 4096
    rounds: int = 5
    block: int = 1024
    probe: int = 4


@dataclass(frozen=True)
class Centres:
    """points: a centre a row; radii: of the cells, negative where one is empty."""

    points: np.ndarray
    radii: np.ndarray

    def bounds(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of unit rows to the centres, and bounds of their scores with the cells' members."""
        dots = rows @ self.points.T
        apart = np.sqrt(np.maximum((rows * rows).sum(1)[:, None] - 2 * dots + (self.points * self.points).sum(1)[None, :], 0.0))
        most = np.minimum(dots + self.radii, 1 - np.maximum(apart - self.radii, 0.0) ** 2 / 2)
        return apart, np.where(self.radii < 0, -2.0, most)


@dataclass(frozen=True)
class Index:
    """blocks: cell, n, chunk_id and position arrays and a matrix `held` of at most block vectors of one cell."""

    centres: Centres
    blocks: DataFrame
    settings: Settings


def unit(rows: DataFrame) -> DataFrame:
    """Embeddings as unit vectors of doubles, zero ones as they are; null ones are left out."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = rows.where(F.col("embedding").isNotNull()).withColumn("embedding", x)
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v))
    return rows.withColumn("_l", length).withColumn("embedding", F.when(F.col("_l") > 0, F.transform("embedding", lambda v: v / F.col("_l"))).otherwise(F.col("embedding"))).drop("_l")


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_list()).astype(float) if len(values) else np.zeros((0, 0))


#: Numbers of a matrix with a row for each vector and a column for each cell; a task holds some ten of these.
CELL_NUMBERS = 1 << 20


def few(batches: Iterator[pd.DataFrame], cells: int) -> Iterator[pd.DataFrame]:
    """Batches of so few rows that a number for each row and cell takes the same room however many cells there are."""
    rows = max(1, CELL_NUMBERS // max(1, cells))
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]


def few_pairs(chosen: np.ndarray, pairs: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows and cells of what is chosen, so few at a time that the rows' vectors can be repeated."""
    i, j = np.nonzero(chosen)
    for at in range(0, len(i), pairs):
        yield i[at : at + pairs], j[at : at + pairs]


def centres(vectors: DataFrame, settings: Settings = Settings()) -> tuple[Centres, DataFrame]:
    """K-means over all unit vectors, and the vectors with their cell (the nearest centre's)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    ship_package(vectors.sparkSession)
    if not n:
        return Centres(np.zeros((0, 0)), np.zeros(0)), vectors.withColumn("cell", F.lit(0))
    k = max(2, min(settings.max_cells, n // settings.members))
    made = KMeans(k=k, maxIter=settings.rounds, seed=1).fit(vectors.select(array_to_vector("embedding").alias("features")))
    points = np.array(made.clusterCenters(), float)
    bare = Centres(points, np.zeros(len(points)))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in few(batches, len(points)):
            apart, _ = bare.bounds(_matrix(batch["embedding"]))
            cell = apart.argmin(1)
            yield batch.assign(cell=cell.astype(np.int32), apart=apart[np.arange(len(batch)), cell])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    told = stash(vectors.mapInPandas(nearest, schema + ", cell int, apart double"), "cells")
    radii = np.full(len(points), -1.0)
    for r in told.groupBy("cell").agg(F.max("apart").alias("r")).collect():  # a row for each cell
        radii[r["cell"]] = r["r"] + SLACK
    return Centres(points, radii), told.drop("apart")


def packed(rows: DataFrame, names: list[str], matrix: str, block: int) -> DataFrame:
    """cell, n, arrays of the named columns and a matrix of at most some `block` rows of one cell."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("parts"))
    dealt = rows.join(small(sizes), "cell").withColumn("part", F.pmod(F.xxhash64(*names, F.monotonically_increasing_id()), F.col("parts")).cast("int"))
    kinds = {n: rows.schema[n].dataType.simpleString() for n in names}

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        made = {n: [group[n].to_list()] for n in names}
        return pd.DataFrame({"cell": [first["cell"]], "part": [first["part"]], "n": [len(group)], **made, matrix: [_matrix(group["embedding"]).tobytes()]})

    schema = "cell int, part int, n long, " + ", ".join(f"{n} array<{kinds[n]}>" for n in names) + f", {matrix} binary"
    return dealt.select("cell", "part", *names, "embedding").groupBy("cell", "part").applyInPandas(pack, schema)


def build(vectors: DataFrame, settings: Settings = Settings()) -> Index:
    """The cells of vectors (chunk_id, position, embedding), written to the shared folder."""
    points, told = centres(unit(vectors.select("chunk_id", "position", "embedding")), settings)
    return Index(points, stash(packed(told, ["chunk_id", "position"], "held", settings.block), "cell-blocks"), settings)


def _near_cells(index: Index, queries: DataFrame, first: int | None) -> DataFrame:
    """query_id, embedding and cell: the `first` nearest cells, or (None) all others whose bound reaches the query's bar."""
    points, probe = index.centres, index.settings.probe

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not len(points.radii):
            return
        for batch in few(batches, len(points.radii)):
            apart, most = points.bounds(_matrix(batch["embedding"]))
            apart = np.where(points.radii < 0, np.inf, apart)
            place = apart.argsort(1, kind="stable").argsort(1, kind="stable")
            if first is None:
                bar = batch["bar"].fillna(-2.0).to_numpy(float)
                chosen = (place >= probe) & (most >= bar[:, None] - 2 * SLACK)
            else:
                chosen = place < first
            ids, asked = batch["query_id"].to_numpy(), batch["embedding"].to_numpy()
            for i, j in few_pairs(chosen & (points.radii >= 0)):
                yield pd.DataFrame({"query_id": ids[i], "embedding": asked[i], "cell": j.astype(np.int32)})

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.mapInPandas(rows, f"query_id {kind}, embedding array<double>, cell int")


def _best(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, position and score of at least the k best members of each asked cell."""
    block = index.settings.block
    kinds = [(n, asked.schema[n].dataType.simpleString()) for n in ("query_id",)]
    kinds += [(n, index.blocks.schema[n].dataType.elementType.simpleString()) for n in ("chunk_id", "position")]
    met = packed(asked, ["query_id"], "asked", block).drop("part", "n").join(index.blocks.drop("part", "n"), "cell")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q, a, c, p, b in zip(batch["query_id"], batch["asked"], batch["chunk_id"], batch["position"], batch["held"]):
                scores = np.frombuffer(a).reshape(len(q), -1) @ np.frombuffer(b).reshape(len(c), -1).T
                near = np.round(scores, PLACES)
                bar = np.partition(near, -k, axis=1)[:, -k] if len(c) > k else np.full(len(q), -np.inf)
                i, j = np.nonzero(near >= bar[:, None])
                yield pd.DataFrame({"query_id": q[i], "chunk_id": c[j], "position": p[j], "score": scores[i, j]})

    return met.mapInPandas(rows, ", ".join(f"{n} {t}" for n, t in kinds) + ", score double")


def _searched(index: Index, queries: DataFrame, k: int, limit: int | None) -> tuple[DataFrame, DataFrame]:
    """Scores that hold the k best of each query, and the cells that were searched for it."""
    asked = stash(unit(queries.select("query_id", "embedding")), "asked")
    near = stash(_near_cells(index, asked, limit or index.settings.probe), "near-cells")
    found = stash(top_k(_best(index, near, k), k), "near-best")
    if limit is not None:
        return found, near
    bars = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
    more = stash(_near_cells(index, asked.join(bars, "query_id", "left"), None), "more-cells")
    return found.drop("rank").unionByName(_best(index, more, k)), near.unionByName(more)


def search(index: Index, queries: DataFrame, k: int = 5, limit: int | None = None) -> DataFrame:
    """The k best members for each query (query_id, embedding): query_id, chunk_id, score, rank. limit: only so many nearest cells are searched."""
    return top_k(_searched(index, queries, k, limit)[0], k).select("query_id", "chunk_id", "score", "rank")


def compared(index: Index, queries: DataFrame, k: int = 5, limit: int | None = None) -> DataFrame:
    """query_id, the cells that a search meets and the vectors that it compares."""
    sizes = index.blocks.groupBy("cell").agg(F.sum("n").alias("n"))
    met = _searched(index, queries, k, limit)[1].join(sizes, "cell")
    return met.groupBy("query_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("vectors"))


#: Blocks that a task compares with all others at a time.
TASK_BLOCKS = 16
#: What products in single precision may be off.
ROUGH = 1e-4


def _linked(folder: str, points: Centres, threshold: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """From the names of some blocks in a folder: id, near and least of what their members, and those of other blocks, have in the pairs of both.

    A task holds its blocks and reads all others one after the other. Of two blocks one meets the other, of either half the others.
    """
    far = np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK

    def able(x: np.ndarray, own: np.ndarray, home: np.ndarray, cell: int) -> np.ndarray:
        """Which rows may be similar to a member of the cell, which lies on the cell's side of the plane halfway between both centres."""
        centre, radius = points.points[cell], points.radii[cell]
        apart = np.sqrt(np.maximum((x * x).sum(1) - 2 * (x @ centre) + centre @ centre, 0.0))
        gap = np.sqrt(((points.points - centre) ** 2).sum(1))[home]
        return (np.maximum(apart - radius, 0.0) <= far) & (apart**2 - own**2 <= 2 * far * gap + SLACK)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = [(int(c), int(p)) for batch in batches for c, p in zip(batch["cell"], batch["part"])]
        for at in range(0, len(mine), TASK_BLOCKS):
            yield from group(set(mine[at : at + TASK_BLOCKS]))

    def blocks() -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray, np.ndarray]]:
        import pyarrow.dataset as ds
        from pyarrow.fs import FileSelector, FileSystem

        fs, base = FileSystem.from_uri(folder)
        files = sorted(f.path for f in fs.get_file_info(FileSelector(base)) if f.path.endswith(".parquet"))
        held = ds.dataset(files, filesystem=fs, format="parquet")
        for batch in held.to_batches(columns=["cell", "part", "id", "copies", "x"], batch_size=8, batch_readahead=1, fragment_readahead=1, use_threads=False):
            for i in range(batch.num_rows):
                ids = batch.column(2)[i].values.to_numpy(zero_copy_only=False)
                matrix = np.frombuffer(batch.column(4)[i].as_buffer()).reshape(len(ids), -1)
                yield (batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), ids, batch.column(3)[i].values.to_numpy(), matrix

    def group(chosen: set[tuple[int, int]]) -> Iterator[pd.DataFrame]:
        names, ids, copies, parts = zip(*((n, i.copy(), c.copy(), x.copy()) for n, i, c, x in blocks() if n in chosen))
        size = [len(i) for i in ids]
        x, a, m = np.concatenate(parts), np.concatenate(ids), np.concatenate(copies)
        home, which = np.repeat([n[0] for n in names], size), np.repeat(np.arange(len(names)), size)
        own = np.sqrt(((x - points.points[home]) ** 2).sum(1))
        rough = x.astype(np.float32)
        for name, b, n, y in blocks():
            meets = np.array([o == name or (o < name) == (sum(o) % 2 == sum(name) % 2) for o in names])
            some = np.flatnonzero(meets[which] & able(x, own, home, name[0]))
            if not len(some):
                continue
            maybe = rough[some] @ y.astype(np.float32).T >= threshold - ROUGH
            if not maybe.any():
                continue
            for i, j in few_pairs(maybe):
                i = some[i]
                near = np.round(np.einsum("ij,ij->i", x[i], y[j]), PLACES) >= threshold
                within = np.array([o == name for o in names])[which[i]]
                near &= ~within | (a[i] != b[j])
                i, j, within = i[near], j[near], within[near]
                back = ~within  # inside of a block each pair comes both ways
                told = pd.DataFrame({"id": np.concatenate([a[i], b[j[back]]]), "near": np.concatenate([n[j], m[i[back]]]), "least": np.concatenate([b[j], a[i[back]]])})
                if len(told):
                    yield told.groupby("id", as_index=False).agg({"near": "sum", "least": "min"})

    return rows


def links(vectors: DataFrame, threshold: float = 0.95, settings: Settings = Settings()) -> DataFrame:
    """Every vector (id, embedding) with how many others have at least this cosine with it, and the least id among these and itself."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0, and 1 at most")
    spark = vectors.sparkSession
    rows = stash(unit(vectors.select("id", "embedding")), "vectors")
    some = F.exists("embedding", lambda v: v != 0)
    alike = stash(rows.where(some).groupBy("embedding").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "distinct-vectors")
    points, homes = centres(alike, settings)
    kind = vectors.schema["id"].dataType.simpleString()
    folder = shared_path(spark, "cell-blocks")
    with shuffles_dropped(spark):  # small row groups, as tasks hold one at a time
        packed(homes, ["id", "copies"], "x", settings.block).write.option("parquet.block.size", 8 << 20).parquet(folder)
    if len(points.radii):  # else the homes are the distinct vectors themselves
        drop_stash(homes)
    names = spark.read.parquet(folder).select("cell", "part")
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-names.count() // TASK_BLOCKS))
    found = names.repartition(tasks).mapInPandas(_linked(folder, points, threshold), f"id {kind}, near long, least {kind}")
    sums = stash(found.groupBy("id").agg(F.sum("near").alias("near"), F.min("least").alias("least")), "links")
    told = alike.join(sums, "id", "left").select(
        "embedding", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_near"), F.least("id", "least").alias("least_near")
    )
    found = rows.join(told, "embedding").select("id", "n_near", "least_near")
    out = vectors.select("id").join(found.dropDuplicates(["id"]), "id", "left")
    return out.select("id", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce("least_near", "id").alias("least_near"))
