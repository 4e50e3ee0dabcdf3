import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import packing as P

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Don't we'll I'M '' 's!'s ''s", "", " \n\t ", "Héllo wörld’s “quote” ÀÉß ½² ªµº ×÷ 3.14", "日本語 İstanbul ΣΑΣ ﬁ é",
    "<|endoftext|> x <|startoftext|>", "y" * 300 + " " + "'" * 90, "a\x85b\x1cc​d", "ɏ Ⱥ ẞ ŉ ǅ", "plain words here",
]


def test_encoder_is_the_tokenizer():
    encoder = P.Encoder(PATH, 4)
    want = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(TEXTS, add_special_tokens=False)]
    assert [encoder.ids(t) for t in TEXTS] == want == [encoder.ids(t) for t in TEXTS]
    assert encoder.ids(None) == b""


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB'sté½ .!\n<|>’-1", max_size=40))
def test_encoder_on_random_texts(text):
    encoder = P.encoder(PATH, 1000)
    assert encoder.ids(text) == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def successors(items):
    """Pieces by decreasing length, each to the nearest free gap after it."""
    taken, pairs = set(), []
    for at in reversed([i for i, kind in enumerate(items) if kind == P.PIECE]):
        fit = next((j for j in range(at, len(items)) if items[j] == P.GAP and j not in taken), None)
        if fit is not None:
            taken.add(fit)
            pairs.append((at, fit))
    return pairs


KINDS = st.lists(st.sampled_from([P.PIECE, P.GAP]), max_size=40)


@settings(max_examples=300, deadline=None)
@given(KINDS)
def test_match_is_best_fit_by_rank(items):
    pairs, pieces, gaps = P.match(items)
    assert sorted(pairs) == sorted(successors(items))
    assert sorted([*pieces, *(a for a, _ in pairs)]) == [i for i, k in enumerate(items) if k == P.PIECE]
    assert sorted([*gaps, *(b for _, b in pairs)]) == [i for i, k in enumerate(items) if k == P.GAP]


@settings(max_examples=300, deadline=None)
@given(st.lists(KINDS, max_size=8))
def test_ranges_match_as_if_they_were_one(ranges):
    want, whole = sorted(successors([k for r in ranges for k in r])), []
    found, left, first = [], [], 0
    places = {}
    for part, items in enumerate(ranges):
        pairs, pieces, gaps = P.match(items)
        found += [(a + first, b + first) for a, b in pairs]
        left.append((part, len(pieces), len(gaps)))
        places[part] = ([x + first for x in pieces], [x + first for x in gaps])
        first += len(items)
    for of, at, part, place, n in P.meet(left):
        found += [(places[of][0][at - i], places[part][1][place + i]) for i in range(n)]
    assert sorted(found) == want


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for length in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= length]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - length)
        else:
            gaps.append(capacity - length)
    return len(gaps)


def test_bands_cover_all_lengths():
    for capacity in (1, 2, 3, 7, 40, 4096):
        inside = [n for low, high in P.bands(capacity) for n in range(low + 1, high + 1)]
        assert sorted(inside) == list(range(1, max(1, capacity // 2) + 1)) or capacity == 1


@pytest.mark.parametrize("seed,capacity,range_rows", [(0, 100, 50_000), (1, 100, 40), (2, 37, 25), (3, 4096, 60), (4, 2, 30), (5, 1, 30)])
def test_supersteps_against_best_fit_decreasing(spark, seed, capacity, range_rows):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(capacity, 1 + rng.integers(0, capacity, 400) ** 2 // capacity).tolist() + [capacity // 3 + 1] * 60
    made = spark.createDataFrame([(i, i, n) for i, n in enumerate(lengths)], "id long, doc_id long, length long").repartition(3)
    got = P.assign(made, P.Settings(PATH, capacity=capacity, range_rows=range_rows)).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == list(enumerate(lengths))
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    parts = 1 + len(lengths) // range_rows
    assert len(by) <= best_fit_decreasing(lengths, capacity) + (2 if parts == 1 else 2 + parts)


def test_pack(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (51, "word " * 9000), (52, "word " * 9000), (52, "x"), (52, "x"), (None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as piece", "1 as length")
    settings_ = P.Settings(PATH, capacity=256)
    got = P.pack(docs, settings_).collect()
    encoder = P.Encoder(PATH, 100)
    want = Counter()
    for i, t in rows:
        ids = encoder.ids(t) + (1).to_bytes(4, "little")
        for k in range(0, len(ids), 1024):
            want[(i, k // 1024, k // 4, len(ids[k : k + 1024]) // 4, zlib.crc32(ids[k : k + 1024]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert dict(P.pack(docs, settings_).dtypes)["length"] == "bigint"
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= -(-sum(r["length"] for r in got) // 256) + 1
    assert P.pack(docs.limit(0), settings_).count() == 0
    kept = P.pieces(docs.where("doc_id = 9"), settings_, keep_ids=True).first()
    assert bytes(kept["ids"]) == encoder.ids(TEXTS[9]) + (1).to_bytes(4, "little")


def test_one_length_may_hold_all_rows(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same words").alias("text"))
    got = P.pack(docs, P.Settings(PATH, capacity=64)).collect()
    n = got[0]["length"]
    assert len({r["sequence_id"] for r in got}) == -(-3000 // (64 // n))
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 3000
