"""Lexical, dense and hybrid retrieval, for whole batches of queries.

Every operator takes queries (query_id, text or embedding) and gives a ranking:
query_id, chunk_id, score, rank. Ranks follow the score, then the corpus
position, so ties fall as in a stable sort.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.session import drop_stash, ship_package, stash

PLACES = 9


@dataclass(frozen=True)
class Bm25:
    """BM25 with a floor for words in more than half of the documents."""

    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


#: Chunks that share a block of postings, on average.
BLOCK_CHUNKS = 256
#: Blocks that one task takes where postings are dealt out by their block.
TASK_BLOCKS = 8
#: Blocks with found chunks, counted for each query, that are broadcast.
FEW = 300_000
#: Words whose bounds add up to less than this share of the bar are opened for candidates only.
SHARE = 0.5
#: What sums of doubles may be off.
SLACK = 1e-7


@dataclass(frozen=True)
class LexicalIndex:
    """Inverted lists, cut into blocks by a hash of the chunk.

    blocks: segment, term, block, max_tf, min_dl and list, an array of (chunk_id,
    position, tf, dl). terms: term, df, idf, max_tf, min_dl. stats: n, avgdl. corpus:
    segment, block, chunk_id, position, dl. removed: (segment, chunk_id) of chunks
    that are in the lists and count no more.
    """

    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame
    corpus: DataFrame
    params: Bm25
    removed: DataFrame | None = None

    @property
    def postings(self) -> DataFrame:
        """segment, block, term, chunk_id, position, tf, dl of every chunk that counts."""
        return self.counting(self.blocks.select("segment", "block", "term", F.inline("list")))

    def counting(self, rows: DataFrame) -> DataFrame:
        """Rows (segment, chunk_id, ...) without those of removed chunks."""
        return rows if self.removed is None else rows.join(self.removed, ["segment", "chunk_id"], "left_anti")


def posting_blocks(chunks: DataFrame, segment: str = "", position: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The blocks and the corpus rows of chunks (chunk_id, text); a block is of so many chunks whatever their number.

    Chunks without words have a corpus row. position: the corpus order, by default the id.
    """
    order = (F.col("chunk_id") if position is None else position).alias("position")
    n = chunks.count()
    rows = chunks.select(F.lit(segment).alias("segment"), _block(n).alias("block"), "chunk_id", order, F.coalesce("text", F.lit("")).alias("_w"))
    sized = lambda df: df.withColumn("_w", T.tokens("_w")).withColumn("dl", F.size("_w").cast("long"))
    dealt = sized(rows.repartition(_tasks(n), "block"))  # texts move once; their postings, many times as large, stay where their block is
    counted = dealt.select("*", F.explode("_w").alias("term")).groupBy("segment", "term", "block", "chunk_id", "position", "dl").agg(
        F.count(F.lit(1)).alias("tf")
    )
    return _blocks(counted), sized(rows).select("segment", "block", "chunk_id", "position", "dl")


def _tasks(chunks: int) -> int:
    """How many tasks take the blocks of so many chunks."""
    return max(1, chunks // (BLOCK_CHUNKS * TASK_BLOCKS))


def _block(chunks: int) -> Column:
    """The block of a chunk among so many."""
    return F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, chunks // BLOCK_CHUNKS)))


def _blocks(postings: DataFrame) -> DataFrame:
    return postings.groupBy("segment", "term", "block").agg(
        F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.collect_list(F.struct("chunk_id", "position", "tf", "dl")).alias("list")
    )


def blocks_again(blocks: DataFrame, corpus: DataFrame, segment: str, gone: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Blocks and corpus rows of one segment, from those of others, without chunks that are gone (segment, chunk_id); no text is read.

    Lists stay where they are, in blocks of other numbers. Only segments that do not half fill their
    blocks have their postings dealt out again.
    """
    alive = corpus if gone is None else corpus.join(small(gone), ["segment", "chunk_id"], "left_anti")
    held = corpus.groupBy("segment").agg((F.max("block") + 1).alias("blocks"))
    found = held.join(alive.groupBy("segment").agg(F.count(F.lit(1)).alias("n")), "segment", "left").collect()  # one row a segment
    full = {r["segment"]: r["blocks"] for r in found if (r["n"] or 0) >= BLOCK_CHUNKS * max(1.0, r["blocks"] / 2)}
    first, base = {}, 0
    for name, n in sorted(full.items()):
        first[name], base = base, base + n
    loose = sum(r["n"] or 0 for r in found if r["segment"] not in full)
    dealt = _block(loose) + F.lit(base)
    kept = F.col("segment").isin(list(full))
    moved = F.element_at(F.create_map(*[F.lit(x) for pair in first.items() for x in pair]), F.col("segment")) + F.col("block") if full else dealt
    corpus_rows = alive.withColumn("block", F.when(kept, moved).otherwise(dealt)).withColumn("segment", F.lit(segment))
    postings = blocks.where(~kept).select("segment", "block", "term", F.inline("list"))
    if gone is not None:
        postings = postings.join(small(gone), ["segment", "chunk_id"], "left_anti")
    made = []
    if loose:
        made.append(_blocks(postings.withColumn("segment", F.lit(segment)).withColumn("block", dealt)))
    if full:
        made.append(_without(blocks.where(kept), corpus, gone).withColumn("block", moved).withColumn("segment", F.lit(segment)))
    return reduce(DataFrame.unionByName, made or [blocks.limit(0)]), corpus_rows


def _without(blocks: DataFrame, corpus: DataFrame, gone: DataFrame | None) -> DataFrame:
    """Blocks whose lists have no chunk that is gone."""
    if gone is None:
        return blocks
    chunks = corpus.join(small(gone), ["segment", "chunk_id"], "left_semi").groupBy("segment", "block").agg(F.collect_set("chunk_id").alias("_gone"))
    some = blocks.join(small(stash(chunks, "gone"), 20_000), ["segment", "block"], "left")  # of some 256 chunks at most each
    left = F.filter("list", lambda p: ~F.array_contains("_gone", p["chunk_id"]))
    cut = lambda new, old: F.when(F.col("_gone").isNull(), F.col(old)).otherwise(new)
    some = some.withColumn("list", cut(left, "list")).where(F.size("list") > 0)
    most, least = F.array_max(F.transform("list", lambda p: p["tf"])), F.array_min(F.transform("list", lambda p: p["dl"]))
    return some.withColumns({"max_tf": cut(most, "max_tf"), "min_dl": cut(least, "min_dl")}).select(*blocks.columns)


def frequencies(blocks: DataFrame) -> DataFrame:
    """segment, term, df, max_tf and min_dl from blocks."""
    return blocks.groupBy("segment", "term").agg(
        F.sum(F.size("list")).alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl")
    )


def by_term(rows: DataFrame, df: Column) -> DataFrame:
    """term, df, max_tf and min_dl of blocks or frequencies, of all segments together."""
    return rows.groupBy("term").agg(F.sum(df).alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"))


def sizes(corpus: DataFrame) -> DataFrame:
    """segment, its number n of chunks and of their words."""
    return corpus.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("words"))


def totals(sized: DataFrame) -> DataFrame:
    """n and avgdl of all segments."""
    return sized.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum("words") / F.nullif(F.sum("n"), F.lit(0))).alias("avgdl"))


def merged(blocks: DataFrame, counts: DataFrame, sized: DataFrame, corpus: DataFrame, params: Bm25, removed: DataFrame | None = None) -> LexicalIndex:
    """The index of all segments from their blocks, frequencies and sizes; counts may be corrected by negative ones."""
    stats = totals(sized)
    df = by_term(counts, F.col("df"))
    return LexicalIndex(blocks, inverse_frequencies(df.where("df > 0"), stats, params), stats, corpus, params, removed)


def lexical_index(chunks: DataFrame, params: Bm25 = Bm25(), position: Column | None = None) -> LexicalIndex:
    """The index of chunks (chunk_id, text), with its blocks and frequencies written to the shared folder."""
    blocks, corpus = posting_blocks(chunks, "", position)
    blocks, stats = stash(blocks, "blocks"), totals(sizes(corpus))
    counted = stash(by_term(blocks, F.size("list")), "frequencies")  # of one segment: by term at once, in one shuffle
    return LexicalIndex(blocks, inverse_frequencies(counted, stats, params), stats, corpus, params)


def written(index: LexicalIndex) -> LexicalIndex:
    """The index with its terms, statistics and corpus as tables in the shared folder too: what asks it later computes nothing of it again."""
    terms, stats, corpus = (stash(df, f"index-{n}") for n, df in (("terms", index.terms), ("stats", index.stats), ("corpus", index.corpus)))
    return replace(index, terms=terms, stats=stats, corpus=corpus)


def inverse_frequencies(df: DataFrame, stats: DataFrame, params: Bm25 = Bm25()) -> DataFrame:
    """Terms with their df, and with idf; a negative idf becomes epsilon times the mean of all raw ones."""
    raw = F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    counted = df.crossJoin(F.broadcast(stats.select("n"))).withColumn("raw", raw).drop("n")
    mean = counted.agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, F.lit(params.epsilon) * F.col("mean")).otherwise(F.col("raw"))
    return counted.crossJoin(F.broadcast(mean)).withColumn("idf", idf).drop("raw", "mean")


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df, to be broadcast if it has at most so many rows; otherwise joined by its keys."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def top_k(scored: DataFrame, k: int, tie: str = "position", query: str = "query_id") -> DataFrame:
    """rank, and only the first k ranks of each query."""
    order = [F.desc(F.round("score", PLACES)), F.col(tie).asc_nulls_last()]
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def _asked(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """query_id, term, df, weight (idf times the word's repeats in the query), bound and avgdl of the queries' words that the index has, written.

    bound: no chunk gets more from the word; 0 for words of negative weight.
    """
    words = queries.select("query_id", F.explode(T.tokens(F.coalesce("text", F.lit("")))).alias("term"))
    words = stash(words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")), "asked")
    known = index.terms.join(small(words), "term").crossJoin(F.broadcast(index.stats.select("avgdl")))
    known = known.withColumn("weight", F.col("qtf") * F.col("idf"))
    most = F.col("weight") * _impact(index.params, F.col("max_tf"), F.col("min_dl"))
    return stash(known.select("query_id", "term", "df", "weight", F.greatest(most, F.lit(0.0)).alias("bound"), "avgdl"), "asked")


def _impact(p: Bm25, tf: Column, dl: Column) -> Column:
    """What a word of weight 1 gives a chunk; more with tf, less with dl."""
    return tf * (p.k1 + 1) / (tf + F.lit(p.k1) * (F.lit(1 - p.b) + F.lit(p.b) * dl / F.col("avgdl")))


def bm25_scores(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id, position and score of every chunk that shares a word with a query; repeated words count again."""
    hits = index.postings.join(small(_asked(index, queries)), "term")
    part = F.col("weight") * _impact(index.params, F.col("tf"), F.col("dl"))
    return hits.groupBy("query_id", "chunk_id", "position").agg(F.sum(part).alias("score"))


@dataclass(frozen=True)
class Pruned:
    """What a pruned search opened. scores: query_id, chunk_id, position, score of all that may be among the k best; opened: a row for each block and query that opened it, with n postings."""

    words: DataFrame
    scores: DataFrame
    opened: DataFrame


def bm25_pruned(index: LexicalIndex, queries: DataFrame, k: int, where: DataFrame | None = None, first: int = 64) -> Pruned:
    """Exact scores of the k best chunks of each query, and of some others, without scoring all that share a word.

    1. The rarest words of a query, with some first * k postings, find k leaders; their
    whole scores give a bar that k chunks reach. 2. Words whose bounds add up to less
    than the bar can't bring a chunk there alone: only the lists of the other words
    are opened, without blocks whose own bound doesn't reach the bar together with all other words.
    With the whole bar nearly every chunk that shares a word stays a candidate, so it is a SHARE of it.
    3. The k-th best of what the candidates have by then is a higher bar; those that still
    can reach it are completed. To complete is to open,
    of the remaining words' lists, only the blocks that hold one of the chunks.
    """
    words = _asked(index, queries)
    allowed = None if where is None else where.select("chunk_id").distinct()
    part = F.col("weight") * _impact(index.params, F.col("tf"), F.col("dl"))
    by, each = Window.partitionBy("query_id"), ["query_id", "segment", "block"]

    n = index.stats.first()["n"]

    def opened(asked: DataFrame) -> DataFrame:
        """The lists of asked words, for each query. They are dealt out by block before queries multiply them, so sums by chunk need no further shuffle."""
        terms = small(asked.select("term").distinct())
        return index.blocks.join(terms, "term", "left_semi").repartition(_tasks(n), "segment", "block").join(small(asked), "term")

    def hits(lists: DataFrame, *columns: str) -> DataFrame:
        rows = index.counting(lists.select(*each, "weight", "avgdl", *columns, F.inline("list")))
        return rows if allowed is None else rows.join(allowed, "chunk_id", "left_semi")

    def completed(found: DataFrame, rest: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Scores of found chunks with what the rest of the words gives them, and the lists that tell it."""
        rest = rest.select("query_id", "term", "weight", "avgdl")
        held = stash(found.groupBy(*each).agg(F.collect_set("chunk_id").alias("wanted")), "wanted")  # of one block
        if held.limit(FEW + 1).count() <= FEW:  # then no list moves
            lists = index.blocks.join(small(rest), "term").join(F.broadcast(held), each)
        else:
            lists = index.blocks.join(stash(held.join(small(rest), "query_id"), "wanted"), ["segment", "block", "term"])
        told = lists.select("query_id", "weight", "avgdl", F.inline(F.filter("list", lambda p: F.array_contains("wanted", p["chunk_id"]))))
        scores = found.select("query_id", "chunk_id", "position", "score").unionByName(
            told.select("query_id", "chunk_id", "position", part.alias("score"))
        )
        return scores.groupBy("query_id", "chunk_id", "position").agg(F.sum("score").alias("score")), lists

    before = F.coalesce(F.sum("df").over(by.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    words = words.withColumn("rare", before < first * k)
    begun = opened(words.where("rare"))
    partial = hits(begun).groupBy(*each, "chunk_id", "position").agg(F.sum(part).alias("score"))
    place = F.row_number().over(by.orderBy(F.desc("score")))
    leaders = stash(partial.withColumn("place", place).where(F.col("place") <= k), "leaders")
    whole, checked = completed(leaders, words.where("not rare"))
    bars = whole.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("bar")).where(F.col("n") == k)
    words = words.join(stash(bars.select("query_id", "bar"), "bars"), "query_id", "left")
    upto = F.sum("bound").over(by.orderBy("bound", "term"))
    words = words.withColumn("open", F.coalesce(upto >= F.lit(SHARE) * F.col("bar") - SLACK, F.lit(True)))
    words = words.withColumn("others", F.sum("bound").over(by) - F.col("bound"))
    closed = lambda of: F.sum(F.when(F.col("open"), 0.0).otherwise(of)).over(by)
    least = F.least(F.col("weight"), F.lit(0.0)) * (index.params.k1 + 1)  # no chunk gets less from a word
    words = stash(words.withColumn("rest", closed(F.col("bound"))).withColumn("least", closed(least)), "asked")

    most = F.greatest(F.col("weight") * _impact(index.params, F.col("max_tf"), F.col("min_dl")), F.lit(0.0))
    reaches = lambda bound: F.coalesce(bound >= F.col("bar") - SLACK, F.lit(True))
    lists = opened(words.where("open")).where(reaches(most + F.col("others")))
    found = hits(lists, "bar", "rest", "least").groupBy(*each, "chunk_id", "position").agg(
        F.sum(part).alias("score"), *[F.first(c).alias(c) for c in ("bar", "rest", "least")]
    )
    first_found = stash(found.where(reaches(F.col("score") + F.col("rest"))).drop("bar"), "candidates")
    low = first_found.select("query_id", (F.col("score") + F.col("least")).alias("low"))
    kth = low.withColumn("place", F.row_number().over(by.orderBy(F.desc("low")))).where(F.col("place") <= k)
    higher = kth.where(F.col("place") == k).select("query_id", F.col("low").alias("bar"))  # k chunks have so much
    found = first_found.join(F.broadcast(stash(higher, "bars")), "query_id", "left").where(reaches(F.col("score") + F.col("rest")))
    found = stash(found.drop("bar", "rest", "least"), "candidates-left")
    drop_stash(first_found)
    scores, more = completed(found, words.where("not open"))
    met = [df.select("query_id", F.size("list").alias("n")) for df in (begun, checked, lists, more)]
    return Pruned(words, scores, reduce(DataFrame.unionByName, met))


def postings_opened(index: LexicalIndex, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, the postings that its words have, and those that a search for k chunks opens."""
    search = bm25_pruned(index, queries, k)
    listed = search.words.groupBy("query_id").agg(F.sum("df").alias("listed"))
    return listed.join(search.opened.groupBy("query_id").agg(F.sum("n").alias("opened")), "query_id")


def bm25(index: LexicalIndex, queries: DataFrame, k: int = 5, where: DataFrame | None = None, fill_zero: bool = False) -> DataFrame:
    """The k best chunks of each query. where: chunk_ids that may be returned (statistics stay those of the corpus).

    fill_zero: queries with fewer than k matches get chunks of score 0 in corpus
    order, as far as there are any.
    """
    scored = top_k(bm25_pruned(index, queries, k, where).scores, k)
    if fill_zero:
        corpus = index.counting(index.corpus)
        if where is not None:
            corpus = corpus.join(where.select("chunk_id").distinct(), "chunk_id", "left_semi")
        scored = top_k(_filled(index, scored.drop("rank"), queries, corpus, k), k)
    return scored.select("query_id", "chunk_id", "score", "rank")


def _filled(index: LexicalIndex, best: DataFrame, queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """The best matches, and zeros for enough chunks from the corpus' start.

    With fewer than k positive matches at least k of the first 2k positions are
    without one, or the corpus is smaller. What these chunks score is computed for them alone.
    """
    first = F.broadcast(stash(corpus.select("segment", "block", "chunk_id", "position").orderBy("position").limit(2 * k), "first"))
    near = replace(index, blocks=index.blocks.join(first.select("segment", "block").distinct(), ["segment", "block"], "left_semi"))
    scored = bm25_scores(near, queries).join(first.select("chunk_id"), "chunk_id", "left_semi").where("score <> 0")
    zeros = queries.select("query_id").distinct().crossJoin(first.select("chunk_id", "position")).withColumn("score", F.lit(0.0))
    zeros = zeros.join(scored.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return best.where("score <> 0").unionByName(zeros.select(*best.columns))


def _packed(rows: DataFrame, names: list[str], size: int) -> DataFrame:
    """Rows in blocks: an array of each named column and the embeddings, brought to unit length, as one matrix of doubles.

    Rows without an embedding are left out; a zero vector stays one, so its cosine with any other is 0.
    """
    kinds = {n: rows.schema[n].dataType.simpleString() for n in names}

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.iloc[at : at + size]
                matrix = np.array(part["embedding"].to_list(), float)
                length = np.sqrt((matrix * matrix).sum(1, keepdims=True))
                matrix = matrix / np.where(length > 0, length, 1.0)
                yield pd.DataFrame({**{n: [part[n].to_list()] for n in names}, "matrix": [matrix.tobytes()]})

    return rows.where(F.col("embedding").isNotNull()).select(*names, "embedding").mapInPandas(
        pack, ", ".join(f"{n} array<{kinds[n]}>" for n in names) + ", matrix binary"
    )


def dense(vectors: DataFrame, queries: DataFrame, k: int = 5, where: Column | None = None, block: int = 1024) -> DataFrame:
    """Exact cosine top-k of vectors of any length; `where` filters the vectors first.

    queries: query_id and embedding, a stated set; vectors: chunk_id, position
    and embedding. Blocks of queries meet blocks of vectors in one matrix product
    each, and only the k best of a block go on. Null embeddings find nothing and
    are not found.
    """
    ship_package(vectors.sparkSession)
    if where is not None:
        vectors = vectors.where(where)
    kinds = [(n, f.schema[n].dataType.simpleString()) for f, n in ((queries, "query_id"), (vectors, "chunk_id"), (vectors, "position"))]
    asked = _packed(queries, ["query_id"], block)
    held = _packed(vectors, ["chunk_id", "position"], block).withColumnRenamed("matrix", "held")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q, a, c, p, b in zip(batch["query_id"], batch["matrix"], batch["chunk_id"], batch["position"], batch["held"]):
                scores = np.frombuffer(a).reshape(len(q), -1) @ np.frombuffer(b).reshape(len(c), -1).T
                near = np.round(scores, PLACES)
                bar = np.partition(near, -k, axis=1)[:, -k] if len(c) > k else np.full(len(q), -np.inf)
                i, j = np.nonzero(near >= bar[:, None])
                yield pd.DataFrame({"query_id": q[i], "chunk_id": c[j], "position": p[j], "score": scores[i, j]})

    schema = ", ".join(f"{n} {t}" for n, t in kinds) + ", score double"
    if queries.limit(20 * block + 1).count() <= 20 * block:
        asked = F.broadcast(asked)  # at most twenty matrices
    return top_k(held.crossJoin(asked).mapInPandas(best, schema), k).select("query_id", "chunk_id", "score", "rank")


def rrf(rankings: dict[str, DataFrame], k: int = 60, top: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of named rankings.

    Ranks count anew in each ranking's order. Ties go to the chunk that the first
    named retriever saw first, then the second's, and so on. sources holds each
    retriever's rank and score.
    """
    if k < 0:
        raise ValueError("the smoothing constant must not be negative")
    rows = None
    for i, (name, ranking) in enumerate(rankings.items()):
        again = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
        part = ranking.select(
            "query_id", "chunk_id", again.alias("_rank"), F.col("score").cast("double").alias("_score"),
            F.lit(name).alias("_name"), F.lit(i).alias("_i"),
        )
        rows = part if rows is None else rows.unionByName(part)
    seen = F.min(F.struct("_i", "_rank"))
    sources = F.map_from_entries(
        F.array_sort(F.collect_list(F.struct("_name", F.struct(F.col("_rank").alias("rank"), F.col("_score").alias("score")))))
    )
    fused = rows.groupBy("query_id", "chunk_id").agg(
        F.sum(F.lit(1.0) / (F.lit(k) + F.col("_rank"))).alias("score"), seen.alias("_seen"), sources.alias("sources")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "_seen")
    ranked = fused.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("query_id", "chunk_id", "score", "rank", "sources")


def hybrid(lexical: DataFrame, vector: DataFrame, k: int = 60, top: int = 5) -> DataFrame:
    """Dense and lexical candidates fused; dense is seen first."""
    return rrf({"dense": vector, "bm25": lexical}, k, top)


def near_duplicate(vectors: DataFrame, new: DataFrame, threshold: float = 0.95, itself: Column | None = None) -> DataFrame:
    """query_id and is_duplicate for new vectors: whether any stored one is as similar as the threshold.

    itself: what tells that a stored vector (chunk_id) is the new one (query_id) itself, where it is stored already.
    """
    found = dense(vectors, new, 1 if itself is None else 2)
    best = (found if itself is None else found.where(~itself)).groupBy("query_id").agg(F.max("score").alias("score"))
    return new.select("query_id").join(best, "query_id", "left").select(
        "query_id", F.coalesce(F.col("score") >= threshold, F.lit(False)).alias("is_duplicate")
    )
