import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import chunking

LINES = st.lists(st.sampled_from(["# A", "## B", "### C", "###### F ", "text one", "", "  ", "#no", "####### seven", "x # y", "#", " "]), max_size=12)


def docs(spark, texts):
    return spark.createDataFrame([(f"d{i:04d}", "md", t) for i, t in enumerate(texts)], "source string, file_type string, text string")


def model_sections(text):
    """Sections as the rules say, in plain Python."""
    found = list(re.finditer(r"^(#{1,6})\s+(.+)$", text, re.M))
    cuts = [m.start() for m in found] + [len(text)]
    out = [(None, None, [], text[: cuts[0]].strip())]
    path, last = [], 0
    for m, end in zip(found, cuts[1:]):
        level = len(m[1])
        if level <= last:
            path = path[: level - 1]
        path = [*path, m[2]]
        last = level
        out.append((m[2], level, path, text[m.end() : end].strip()))
    return [s for s in out if s[3]]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(LINES.map("\n".join), min_size=30, max_size=60))
def test_sections(spark, texts):
    rows = docs(spark, texts).select("source", chunking.sections(F.col("text")).alias("s")).orderBy("source").collect()
    got = [[(s["heading"], s["level"], list(s["path"]), s["text"]) for s in r["s"]] for r in rows]
    assert got == [model_sections(t) for t in texts]


def test_signs_inside_texts(spark):
    text = " intro\n# h\nbody 0"
    assert [tuple(s[:2]) + (s["text"],) for s in docs(spark, [text]).select(chunking.sections(F.col("text"))).first()[0]] == [
        (None, None, " intro"),
        ("h", 1, "body 0"),
    ]


def model_windows(text, size, overlap):
    out, at = [], 0
    while text:
        out.append((text[at : at + size], at, min(at + size, len(text))))
        if out[-1][2] == len(text):
            break
        at += size - overlap
    return out


@pytest.mark.parametrize("size,overlap", [(10, 3), (7, 0), (5, 4)])
def test_windows(spark, size, overlap):
    texts = ["", "a", "x" * size, "y" * (size + 1), "🙂é" * 9, "0123456789" * 5]
    rows = docs(spark, texts).select("source", chunking.windows(F.col("text"), size, overlap).alias("w")).orderBy("source").collect()
    assert [[tuple(w) for w in r["w"]] for r in rows] == [model_windows(t, size, overlap) for t in texts]


@pytest.mark.parametrize("size,overlap", [(0, 0), (5, 5), (5, -1)])
def test_window_checks(spark, size, overlap):
    with pytest.raises(ValueError):
        chunking.fixed(docs(spark, ["x"]), size, overlap)


def model_paragraphs(text):
    held, out = [], []
    for p in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if not p:
            continue
        if re.fullmatch(r"#{1,6}\s+.+", p):
            held.append(p)
        else:
            out.append("\n\n".join(["\n".join(held), p]) if held else p)
            held = []
    return out + (["\n".join(held)] if held else [])


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["# A", "## B", "text", "two words", "", "  ", "\t"]), max_size=12).map("\n\n".join), min_size=30, max_size=60))
def test_paragraphs(spark, texts):
    rows = docs(spark, texts).select("source", chunking.paragraphs(F.col("text")).alias("p")).orderBy("source").collect()
    assert [list(r["p"]) for r in rows] == [model_paragraphs(t) for t in texts]


def model_semantic(text, threshold, least, most):
    words = lambda p: set(re.findall(r"\b[\w\-]+\b", p.lower()))
    parts = model_paragraphs(text)
    out, current, first = [], None, 0
    for i, p in enumerate(parts):
        if current is None:
            current = p
            continue
        a, b = words(parts[i - 1]), words(p)
        like = len(a & b) / len(a | b) if a | b else 0.0
        if (len(current) >= least and like < threshold) or len(current) + 2 + len(p) > most:
            out.append((current, first, i - 1))
            current, first = p, i
        else:
            current += "\n\n" + p
    return out + ([(current, first, len(parts) - 1)] if parts else [])


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["a b c", "a b d", "x y", "lorem ipsum dolor sit", "# H"]), max_size=9).map("\n\n".join), min_size=20, max_size=40))
def test_semantic(spark, texts):
    rows = chunking.semantic(docs(spark, texts), 0.4, 6, 30)
    got = {}
    for r in rows.orderBy("source", "chunk_index").collect():
        got.setdefault(r["source"], []).append((r["text"], r["metadata"]["start_paragraph"], r["metadata"]["end_paragraph"]))
    assert got == {f"d{i:04d}": m for i, t in enumerate(texts) if (m := model_semantic(t, 0.4, 6, 30))}


def test_structure_numbers_chunks_through_a_document(spark):
    text = "intro\n# A\n" + "x" * 25 + "\n## B\nshort"
    rows = chunking.structure(docs(spark, [text]), 10, 2).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert [r["metadata"]["section_part"] for r in rows] == [None, 0, 1, 2, None]
    assert rows[-1]["metadata"]["heading_path"] == ["A", "B"]

