"""The registered queries on a small folder of tables, against plain Python."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from lodestone.llm import packing
from lodestone.llm.registry import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    at = tmp_path_factory.mktemp("tables")
    words = {"en": "the and of that with from this have", "fr": "le des est une que dans pour avec", "de": "der und das nicht ist mit für auf"}
    rows = []
    for i in range(150):
        lang = list(words)[i % 3]
        rows.append((i, " ".join(rng.choice(words[lang].split(), int(rng.integers(1, 60)))), lang, f"s{i % 4 if i % 3 else 0}", 1))
    base = " ".join(f"w{j}" for j in range(300))
    rows += [(200, None, None, None, None), (201, "", "en", "s0", 0), (202, base, "en", "s1", 1), (203, base, "en", "s1", 1)]
    rows += [(204, base.replace("w7 ", "x "), "en", "s2", 1), (205, "Two\twords", "en", "s2", 1), (206, "word " * 5000, "en", "s3", 1), (207, "é ÀB\n" * 40, None, "s3", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(i % 5 > 0), int(i % 7 == 0)) for i in range(150)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    pages = [(i, f"http://h/{i}", "<p>same</p>" if i % 4 == 0 else f"<p>ä{i}</p>" if i % 5 else None) for i in range(30)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return str(at), rows, pages


def run(spark, folder, name):
    return [r.asDict() for r in QUERIES[name](spark, folder[0]).collect()]


def test_op1(spark, folder):
    got = {r["doc_id"]: r for r in run(spark, folder, "op1_language_id")}
    texts = {r[0]: r[1] for r in folder[1]}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert (r["lang_pred"] == "und") == (not texts[i] or not any(c.isalpha() for c in texts[i])) and 0 <= r["score"] <= 1


def test_op2(spark, folder):
    got = {r["doc_id"]: r for r in run(spark, folder, "op2_ogg")}
    for i, text, *_ in folder[1]:
        raw = (text or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["whole"]
    assert got[202]["media_sha256"] == got[203]["media_sha256"] and got[202]["feature"] == got[203]["feature"]


@pytest.mark.parametrize("name,low,high", [("op3_toxicity", 0, 3), ("op5_quality", 0, 2)])
def test_op3_op5(spark, folder, name, low, high):
    got = run(spark, folder, name)
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in folder[1])
    expected = "expected_severity" if name == "op3_toxicity" else "expected_grade"
    p, flag = ("p_toxic", "rejected") if name == "op3_toxicity" else ("p_selected", "selected")
    assert all(low <= r[expected] <= high and 0 <= r[p] <= 1 and isinstance(r[flag], bool) for r in got)


def test_op4(spark, folder):
    got = {r["doc_id"]: r for r in run(spark, folder, "op4_hash_tree")}
    by = {}
    for i, text, *_ in folder[1]:
        r, raw = got[i], (text or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(by) > 10


def test_op6(spark, folder):
    got = {r["page_id"]: r for r in run(spark, folder, "op6_warc")}
    latest = {}
    for i, _, html in folder[2]:
        latest[html or ""] = max(i, latest.get(html or "", -1))
    for i, url, html in folder[2]:
        raw = (html or "").encode()
        first = latest[html or ""]
        want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == first else "revisit", None if i == first else first)
        assert tuple(got[i][c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to")) == want and got[i]["valid"]
    assert len(got) == len(folder[2])


def test_op7(spark, folder):
    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        if not words:
            return 0
        parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    marks = {r[0]: fingerprint(r[1]) for r in folder[1]}
    root = {i: i for i in marks}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in marks:
        for j in marks:
            if bin(marks[i] ^ marks[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, folder, "op7_simhash")}
    assert got == {i: (f"{m:016x}", find(i)) for i, m in marks.items()}


def test_op8(spark, folder):
    got = run(spark, folder, "op8_packing")
    encode, want = packing.Encoder(PATH, 100).ids, {}
    for i, text, *_ in folder[1]:
        ids = encode(text) + (1).to_bytes(4, "little")
        for k in range(0, len(ids), 4 * 4096):
            part = ids[k : k + 4 * 4096]
            want[i, k // (4 * 4096)] = (k // 4, len(part) // 4, zlib.crc32(part))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 4096
    assert len(by) == -(-sum(r["length"] for r in got) // 4096)


def test_op9(spark, folder):
    got = run(spark, folder, "op9_pfair")
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in folder[1])
    assert sorted(r["position"] for r in got) == list(range(len(got))) and all(r["in_mix"] for r in got)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)


def test_op10(spark, folder):
    docs = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t, *_ in folder[1]}
    mean = sum(map(len, docs.values())) / len(docs)
    df = {}
    for words in docs.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    want = {}
    for q in (i for i in docs if i % 50 == 0):
        scores = []
        for i, words in docs.items():
            s = 0.0
            for w in set(docs[q]) & set(words):
                tf = words.count(w)
                idf = np.log1p((len(docs) - df[w] + 0.5) / (df[w] + 0.5))
                s += docs[q].count(w) * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
            if s > 0:
                scores.append((-round(s, 6), i))
        for rank, (s, i) in enumerate(sorted(scores)[:10], 1):
            want[q, rank] = (i, -s)
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in run(spark, folder, "op10_bm25_wand")}
    assert got.keys() == want.keys()
    assert all(got[k][1] == pytest.approx(want[k][1], abs=2e-6) for k in want)
