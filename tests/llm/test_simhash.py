import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import simhash as S


def model_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(alphabet="aBÉ é\t\n\x0b\x1c x", max_size=60))
def test_fingerprint(text):
    assert S.fingerprint(text, 3) == model_fingerprint(text)


def groups(fps, radius):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def random_fps(n, seed, bits=64, spread=3):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            x = out[int(rng.integers(len(out)))]
            for b in rng.choice(64, int(rng.integers(1, spread + 1)), replace=False):
                x ^= 1 << int(b)
        else:
            x = int(rng.integers(0, 1 << bits, dtype=np.uint64))
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("radius,hot", [(0, 40_000), (2, 40_000), (2, 4), (3, 9), (5, 40_000)])
def test_links_are_all_pairs_within_the_radius(spark, radius, hot):
    fps = random_fps(250, radius, bits=64 if hot > 9 else 12)
    df = spark.createDataFrame([(S._signed(x), i) for i, x in enumerate(fps)], "fp long, first long")
    n, together = S.bit_statistics(df)
    assert n == len(fps) and together[63, 63] == sum(x & 1 for x in fps)
    parts = S.allot(n, together, radius)
    got = S.links(df, parts, radius, S.Settings(hot_pairs=hot)).distinct().collect()
    want = {tuple(sorted((S._signed(x), S._signed(y)))) for i, x in enumerate(fps) for y in fps[:i] if bin(x ^ y).count("1") <= radius}
    assert {tuple(r) for r in got} == want


@pytest.mark.parametrize("m,sum_of", [(1, 4), (2, 3), (3, 2), (5, 0)])
def test_thresholds_keep_the_pigeonhole_sum(m, sum_of):
    together = np.full((64, 64), 25.0) + np.eye(64) * 25
    parts = S.allot(100, together, 4)
    masks = [p.mask for p in parts]
    assert all(a & b == 0 for i, a in enumerate(masks) for b in masks[:i])
    groups_used = S.group_bits(100, together, m)
    assert sorted(b for g in groups_used for b in g) == list(range(64))
    assert sum_of == 4 - m + 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, j) for j in range(101, 140)] + [(-5, -3), (-3, -1)] + [(200, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    roots = {}
    for r in S.components(df).collect():
        roots.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, roots.values())) == [[-5, -3, -1], list(range(41)), list(range(100, 140))]


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(8)
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(i, base if i % 4 else " ".join(rng.permutation(base.split()))) for i in range(40)]
    rows += [(100 + i, base + f" tail{i}") for i in range(30)] + [(300, None), (301, ""), (299, " \n"), (None, base), (5, base), (400, "x " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as fp")
    got = S.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = [model_fingerprint(t) for _, t in rows]
    root = groups(fps, 2)
    low = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    want = sorted(((-1 if i is None else i), f, low.get(r)) for (i, _), f, r in zip(rows, fps, root))
    assert sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["fp"] % (1 << 64), r["component_id"]) for r in got) == want
    kept = S.deduplicated(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(low.values())) and kept[0].asDict().keys() == set(docs.columns)
    assert S.near_duplicates(docs.limit(0)).count() == 0
    assert S.near_duplicates(docs.limit(1)).count() == 1
