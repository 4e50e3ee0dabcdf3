"""Chunkers: documents (text, source, file_type, ...) to chunks.

All run as built-in expressions. A document's sections and paragraphs are folds
over its own arrays; nothing is shuffled but the chunk index of a document's
structure chunks, which is counted inside its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.identity import chunk_id
from lodestone import schemas
from lodestone.schemas import METADATA

#: Signs that mark headings inside a text; private-use characters of the text itself are kept apart.
_START, _LEVEL, _END, _ESCAPE = "\ue000", "\ue001", "\ue002", "\ue003"


def _check_window(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("the chunk size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and less than the chunk size")


def windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of a text: array of (text, start, end); the last one ends with the text."""
    _check_window(size, overlap)
    step, length = size - overlap, F.length(text)
    count = F.when(length == 0, 0).when(length <= size, 1).otherwise(F.ceil((length - size) / step) + 1).cast("int")
    starts = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: k * step))
    return F.transform(
        F.coalesce(starts, F.array().cast("array<int>")),
        lambda s: F.struct(
            F.substring(text, s + 1, F.lit(size)).alias("text"),
            s.alias("start"),
            F.least(s + size, length).alias("end"),
        ),
    )


def metadata(**fields: Column) -> Column:
    """The full metadata struct; what is not given is null."""
    kinds = [part.split(":", 1) for part in METADATA[7:-1].split(",")]
    return F.struct(*[(fields[n] if n in fields else F.lit(None)).cast(k).alias(n) for n, k in kinds])


def chunk_rows(df: DataFrame, strategy: str, extra: list[str] | None = None) -> DataFrame:
    """Chunks from rows with text, source, file_type, chunk_index and metadata."""
    return df.select(
        *(extra or []),
        chunk_id("source", "chunk_index", "text").alias("chunk_id"),
        "text",
        "source",
        "file_type",
        F.col("chunk_index").cast("int").alias("chunk_index"),
        F.lit(strategy).alias("chunking_strategy"),
        "metadata",
    )


def _page(df: DataFrame) -> dict[str, Column]:
    return (
        {"page_number": F.col("metadata.page_number"), "page_count": F.col("metadata.page_count")}
        if "metadata" in df.columns
        else {}
    )


def fixed(docs: DataFrame, size: int = 1000, overlap: int = 150) -> DataFrame:
    """Overlapping windows of a fixed number of characters."""
    page = _page(docs)
    rows = docs.select(
        "source", "file_type", *[c.alias(f"_{n}") for n, c in page.items()],
        F.posexplode(windows(F.col("text"), size, overlap)).alias("chunk_index", "w"),
    )
    meta = metadata(start_char=F.col("w.start"), end_char=F.col("w.end"), **{n: F.col(f"_{n}") for n in page})
    return chunk_rows(rows.select("source", "file_type", "chunk_index", F.col("w.text").alias("text"), meta.alias("metadata")), "fixed")


def _escaped(text: Column) -> Column:
    for sign, mark in ((_ESCAPE, "3"), (_START, "0"), (_LEVEL, "1"), (_END, "2")):
        text = F.replace(text, F.lit(sign), F.lit(_ESCAPE + mark))
    return text


def _restored(text: Column) -> Column:
    for sign, mark in ((_START, "0"), (_LEVEL, "1"), (_END, "2"), (_ESCAPE, "3")):
        text = F.replace(text, F.lit(_ESCAPE + mark), F.lit(sign))
    return text


SECTION = "struct<heading:string,level:int,path:array<string>,text:string>"


def sections(text: Column) -> Column:
    """Sections of a Markdown text: heading, level, heading path and stripped body.

    Text before the first heading is a section without heading; sections with an
    empty body are left out but count for the paths of those that follow. A
    deeper heading goes below the one before; any other first leaves as many
    entries as its level less one.
    """
    marked = F.regexp_replace(_escaped(text), rf"(?md)^(#{{1,6}}){T.W}+(.+)$", f"{_START}$1{_LEVEL}$2{_END}")
    parts = F.split(marked, _START, -1)
    level = lambda p: F.length(F.substring_index(p, _LEVEL, 1))
    heading = lambda p: _restored(F.substring_index(F.substring_index(p, _END, 1), _LEVEL, -1))
    body = lambda p: T.strip(_restored(F.regexp_replace(p, rf"(?s)\A[^{_END}]*{_END}", "")))
    first = F.struct(
        F.lit(None).cast("string").alias("heading"),
        F.lit(None).cast("int").alias("level"),
        F.array().cast("array<string>").alias("path"),
        T.strip(_restored(F.get(parts, F.lit(0)))).alias("text"),
    )
    none = F.struct(
        F.lit(0).alias("last"), F.array().cast("array<string>").alias("path"), F.array().cast(f"array<{SECTION}>").alias("out")
    )

    def step(state: Column, part: Column) -> Column:
        above = F.when(level(part) > state["last"], state["path"]).otherwise(
            F.slice(state["path"], F.lit(1), F.greatest(level(part) - 1, F.lit(0)))
        )
        path = F.concat(above, F.array(heading(part)))
        made = F.struct(heading(part).alias("heading"), level(part).alias("level"), path.alias("path"), body(part).alias("text"))
        return F.struct(
            level(part).alias("last"), path.alias("path"), F.concat(state["out"], F.array(made.cast(SECTION))).alias("out")
        )

    rest = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), none, step, lambda s: s["out"])
    return F.filter(F.concat(F.array(first.cast(SECTION)), rest), lambda s: s["text"] != "")


def structure(docs: DataFrame, max_chars: int = 2000, overlap: int = 200) -> DataFrame:
    """Chunks of Markdown sections; a section longer than max_chars gives windows."""
    _check_window(max_chars, overlap)
    page = _page(docs)

    def pieces(s: Column) -> Column:
        short = F.array(
            F.struct(
                s["text"].alias("text"), s.alias("s"),
                F.lit(None).cast("int").alias("part"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"),
            )
        )
        long = F.transform(
            windows(s["text"], max_chars, overlap),
            lambda w, i: F.struct(w["text"].alias("text"), s.alias("s"), i.alias("part"), w["start"].alias("start"), w["end"].alias("end")),
        )
        return F.when(F.length(s["text"]) <= max_chars, short).otherwise(long)

    rows = docs.select(
        "source", "file_type", *[c.alias(f"_{n}") for n, c in page.items()],
        F.posexplode(F.flatten(F.transform(sections(F.col("text")), pieces))).alias("chunk_index", "p"),
    )
    meta = metadata(
        heading=F.col("p.s.heading"), heading_level=F.col("p.s.level"), heading_path=F.col("p.s.path"),
        section_part=F.col("p.part"), start_char_in_section=F.col("p.start"), end_char_in_section=F.col("p.end"),
        **{n: F.col(f"_{n}") for n in page},
    )
    return chunk_rows(
        rows.select("source", "file_type", "chunk_index", F.col("p.text").alias("text"), meta.alias("metadata")), "structure"
    )


def paragraphs(text: Column) -> Column:
    """Paragraphs: split at blank lines, stripped; headings go with the paragraph below them."""
    parts = F.filter(F.transform(F.split(text, rf"\n{T.W}*\n"), T.strip), lambda p: p != "")
    is_heading = lambda p: p.rlike(rf"(?d)\A#{{1,6}}{T.W}+.+\z")
    none = F.struct(F.array().cast("array<string>").alias("held"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, p: Column) -> Column:
        joined = F.when(F.size(state["held"]) > 0, F.concat(F.array_join(state["held"], "\n"), F.lit("\n\n"), p)).otherwise(p)
        return F.when(
            is_heading(p), F.struct(F.concat(state["held"], F.array(p)).alias("held"), state["out"].alias("out"))
        ).otherwise(
            F.struct(F.array().cast("array<string>").alias("held"), F.concat(state["out"], F.array(joined)).alias("out"))
        )

    return F.aggregate(
        parts, none, step,
        lambda s: F.when(F.size(s["held"]) > 0, F.concat(s["out"], F.array(F.array_join(s["held"], "\n")))).otherwise(s["out"]),
    )


def jaccard(x: Column, y: Column) -> Column:
    """Similarity of two sets of words; the stand-in where no embedder is given."""
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


def let(value: Column, body) -> Column:
    """body of a value that is computed once; a column used twice would be computed twice."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def neighbours(values: Column, similarity) -> Column:
    """The similarity of each element to the one before it; null for the first."""

    def pairs(v: Column) -> Column:
        n = F.greatest(F.size(v) - 1, F.lit(0))
        first = F.array(F.lit(None).cast("double"))
        return F.concat(first, F.zip_with(F.slice(v, F.lit(1), n), F.slice(v, F.lit(2), n), similarity))

    return let(values, pairs)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def semantic(
    docs: DataFrame, threshold: float = 0.55, min_chars: int = 300, max_chars: int = 2000, embed=None
) -> DataFrame:
    """Runs of paragraphs, broken where neighbours are unlike or the chunk would grow too long.

    embed: a function from an array<string> column to array<array<float>>, unit
    vectors; without one, neighbours are compared by their words.
    """
    if not -1.0 <= threshold <= 1.0:
        raise ValueError("the similarity threshold must lie between -1 and 1")
    if min_chars <= 0 or max_chars <= 0 or min_chars > max_chars:
        raise ValueError("chunk lengths must be positive, the least not above the most")
    page = _page(docs)
    docs = docs.select(
        "source", "file_type", *[c.alias(f"_{n}") for n, c in page.items()], paragraphs(F.col("text")).alias("p")
    )
    piece = "struct<text:string,first:int,last:int>"
    none = F.struct(
        F.lit(None).cast("string").alias("text"), F.lit(0).alias("first"), F.lit(0).alias("i"),
        F.array().cast(f"array<{piece}>").alias("out"),
    )

    def closed(s: Column) -> Column:
        made = F.struct(s["text"].alias("text"), s["first"].alias("first"), (s["i"] - 1).alias("last")).cast(piece)
        return F.when(s["text"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(made)))

    def step(s: Column, x: Column) -> Column:
        p, similar = x["p"], x["like"]
        cut = ((F.length(s["text"]) >= min_chars) & (similar < threshold)) | (F.length(s["text"]) + 2 + F.length(p) > max_chars)
        grown = F.struct(
            F.concat(s["text"], F.lit("\n\n"), p).alias("text"), s["first"].alias("first"), (s["i"] + 1).alias("i"), s["out"].alias("out")
        )
        new = F.struct(p.alias("text"), s["i"].alias("first"), (s["i"] + 1).alias("i"), closed(s).alias("out"))
        begun = F.struct(p.alias("text"), F.lit(0).alias("first"), F.lit(1).alias("i"), s["out"].alias("out"))
        return F.when(s["text"].isNull(), begun).when(cut, new).otherwise(grown)

    def folded(p: Column, like: Column) -> Column:
        pairs = F.zip_with(p, like, lambda a, b: F.struct(a.alias("p"), b.alias("like")))
        return F.aggregate(pairs, none, step, closed)

    if embed is None:
        words = lambda p: F.transform(p, lambda x: F.array_distinct(T.tokens(x)))
        chunks = let(F.col("p"), lambda p: folded(p, neighbours(words(p), jaccard)))
    else:
        docs = docs.withColumn("_e", embed(F.col("p")))
        chunks = let(F.struct("p", "_e"), lambda s: folded(s["p"], neighbours(s["_e"], dot)))
    rows = docs.select("source", "file_type", *[f"_{n}" for n in page], F.posexplode(chunks).alias("chunk_index", "c"))
    meta = metadata(
        start_paragraph=F.col("c.first"), end_paragraph=F.col("c.last"), similarity_threshold=F.lit(threshold),
        **{n: F.col(f"_{n}") for n in page},
    )
    return chunk_rows(
        rows.select("source", "file_type", "chunk_index", F.col("c.text").alias("text"), meta.alias("metadata")), "semantic"
    )


def whole(docs: DataFrame) -> DataFrame:
    """A document as one chunk."""
    rows = docs.select("source", "file_type", F.lit(0).alias("chunk_index"), "text", metadata().alias("metadata"))
    return chunk_rows(rows, "document")


def route(docs: DataFrame, embed=None) -> DataFrame:
    """Markdown by structure, everything else by paragraphs."""
    markdown = F.col("file_type") == "md"
    out = structure(docs.where(markdown)).unionByName(semantic(docs.where(~markdown | F.col("file_type").isNull()), embed=embed))
    return out.select(*schemas.of("CHUNK").fieldNames())
