"""The prefix trie against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def base(c):
    return c - (c % 100 if c >= 0 else -(-c % 100))


def shared(c):
    return zlib.crc32(str(c).encode()) % 6


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def plain(rows, families):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own.setdefault(c, []).append((t is not None, t or 0, digest(r, x), r, x))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    convs = {c: own.get(base(c), [])[: shared(c)] + t[shared(c) :] if families else t for c, t in own.items()}
    nodes, kids = {}, {}
    for c, t in convs.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    for n in nodes:
        if n:
            kids.setdefault(n[:-1], []).append(n)
    leaves, saved, out = {}, {}, []
    for n in sorted(nodes, key=len, reverse=True):
        below = kids.get(n, [])
        leaves[n] = sum(leaves[k] for k in below) if below else 1
        saved[n] = (len(nodes[n]) - 1) * (len(n[-1][1]) if n else 0) + sum(saved[k] for k in below)
    for n, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(n))
        parent = min(nodes[n[:-1]]) if n else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members), len(n), parent, len(members), len(kids.get(n, [])), leaves[n], saved[n], sha))
    return sorted(out, key=str)


def check(spark, rows, families=True, schema=SCHEMA):
    c = F.col("conv_id")
    args = (c - c % 100, F.crc32(c.cast("string").cast("binary")) % 6) if families else ()
    df = spark.createDataFrame(rows, schema)
    got = sorted((tuple(r) for r in trie.nodes(df, *args).collect()), key=str)
    assert got == plain([r[:4] for r in rows], families)


@pytest.mark.parametrize("seed,families", [(1, True), (2, True), (3, False)])
def test_random_conversations(spark, seed, families):
    rng = random.Random(seed)
    ids = [None, *range(-5, 30), 100, 101, 205, 333]
    rows = [(rng.choice(ids), rng.choice([None, *range(9)]), rng.choice(["u", "a", None]), rng.choice(["", "x", "yé😀", None])) for _ in range(300)]
    check(spark, rows, families)


def test_long_conversations_that_part_late(spark):
    turn = lambda c, i: (c, i, "u", "same" if i < 130 - c else f"{c}")
    check(spark, [turn(c, i) for c in range(4) for i in range(140)], families=False)


def test_copies_prefixes_and_turnless(spark):
    rows = [(c, t, "u", f"t{t}") for c in range(200, 260) for t in range(4)] + [(c, t, "u", f"t{t}") for c in range(60) for t in range(2)]
    check(spark, [*rows, (305, 0, None, None), (9_999_999_999, 0, "u", "x" * 50_000), (200, 0, "u", "t0"), (200, 0, "u", "t0")])


def test_empty_table_and_clashing_columns(spark):
    check(spark, [])
    check(spark, [(1, 0, "u", "a", 5, "k", 1), (2, 0, "u", "a", 6, "k", 2)], False, SCHEMA + ", i long, name string, turns long")


def test_ids_of_a_node_go_through_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 7)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"node": ["a"] * 20 + ["b"] * 7, "conv_id": list(range(27))})
    chunks = list(trie._chunks(iter([batch.slice(0, 11), batch.slice(11)])))
    assert [c.column(2).to_pylist()[0].count(",") + 1 for c in chunks] == [7, 7, 6, 7]
    got = {n: s for b in trie._digests(iter(chunks)) for n, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    want = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {"a": want(range(20)), "b": want(range(20, 27))}
