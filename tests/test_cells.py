"""Cells against all vectors."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.operators import cells, retrieval

HELD = "chunk_id long, position long, embedding array<double>"
SETTINGS = cells.Settings(members=25, block=64, probe=2)


def grouped(rng, n, groups=20, spread=0.15, size=16):
    x = rng.normal(size=(groups, size))[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, size))
    return x * rng.uniform(0.5, 2, (n, 1))


def held(spark, x):
    rows = [(i, i, v.tolist()) for i, v in enumerate(x)] + [(9000, 9000, None), (9001, 9001, [0.0] * x.shape[1])]
    return spark.createDataFrame(rows, HELD).repartition(3)


@pytest.mark.parametrize("spread", [0.15, 3.0])
def test_search_is_exact(spark, spread):
    x = grouped(np.random.default_rng(3), 500, spread=spread)
    x[7] = x[3]
    vectors = held(spark, x)
    asked = vectors.where("chunk_id % 20 = 0 or chunk_id > 8000").select(F.col("chunk_id").alias("query_id"), "embedding")
    index = cells.build(vectors, SETTINGS)
    tell = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 8)) for r in df.collect())
    want = tell(retrieval.dense(vectors, asked, 5))
    assert tell(cells.search(index, asked, 5)) == want
    if spread < 1:
        met = cells.compared(index, asked.where("query_id < 8000"), 5).agg(F.avg("vectors")).first()[0]
        assert met < 0.5 * 501
        some = tell(cells.search(index, asked, 5, limit=3))
        assert len({t[:3] for t in some} & {t[:3] for t in want}) >= 0.9 * len(want)


def test_links_of_all_vectors(spark):
    rng = np.random.default_rng(5)
    x = grouped(rng, 300, spread=0.3)
    x[200:230] = x[100:130] * 3  # copies in direction
    x[250:260] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 16), (502, [0.0] * 16)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    got = {r["id"]: (r["n_near"], r["least_near"]) for r in cells.links(df, 0.95, SETTINGS).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round(u @ u.T, 9) >= 0.95
    want = {i: (int(near[i].sum()) - 1, int(np.flatnonzero(near[i]).min())) for i in range(300)}
    assert got == want | {i: (0, i) for i in (500, 501, 502)}
    assert sum(n > 0 for n, _ in want.values()) > 100 and any(n == 0 for n, _ in want.values())


def test_links_of_evenly_spread_vectors_copy_none(spark, monkeypatch):
    """Nearly every cell is near enough to nearly every vector here; each is written once all the same."""
    x = np.random.default_rng(8).normal(size=(600, 16))
    x[:40] = x[40:80] + 0.05
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(3)
    written, folders, stash, path = [], [], cells.stash, cells.shared_path

    def counted(rows, label):
        made = stash(rows, label)
        written.append(made.count())
        return made

    monkeypatch.setattr(cells, "stash", counted)
    monkeypatch.setattr(cells, "shared_path", lambda s, label: folders.append(path(s, label)) or folders[-1], raising=False)
    got = {r["id"]: (r["n_near"], r["least_near"]) for r in cells.links(df, 0.95, SETTINGS).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round(u @ u.T, 9) >= 0.95
    assert got == {i: (int(near[i].sum()) - 1, int(np.flatnonzero(near[i]).min())) for i in range(600)}
    assert max(written) <= 600
    assert [spark.read.parquet(f).agg(F.sum("n")).first()[0] for f in folders] == [600]


def test_no_vectors(spark):
    none = spark.createDataFrame([], HELD)
    assert cells.search(cells.build(none), none.select(F.col("chunk_id").alias("query_id"), "embedding"), 3).count() == 0
    assert cells.links(none.select(F.col("chunk_id").alias("id"), "embedding")).count() == 0


def test_memory_does_not_grow_with_cells():
    """A task compares few rows at a time with many cells, and the same rows come out."""
    x = np.random.default_rng(1).normal(size=(4096, 4))
    points = cells.Centres(x, np.ones(len(x)))
    rows = pd.DataFrame({"row": range(10_000), "embedding": list(np.tile(x, (3, 1))[:10_000])})
    seen = []
    for part in cells.few(iter([rows, rows.iloc[:0]]), len(x)):
        apart, most = points.bounds(cells._matrix(part["embedding"]))
        assert apart.size == most.size <= cells.CELL_NUMBERS
        seen += part["row"].tolist()
    assert seen == list(range(10_000))
    assert [len(p) for p in cells.few(iter([rows]), 2)] == [10_000]
    chosen = x[:40] @ x.T > 0
    told = list(cells.few_pairs(chosen, 500))
    assert max(len(i) for i, _ in told) == 500
    assert np.array_equal(np.concatenate([np.stack(t) for t in told], 1), np.stack(np.nonzero(chosen)))
