"""Context, prompts, generation and citations of answers, a row for each query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.clients import Client, replies
from lodestone.functions import text as T
from lodestone.operators.rerank import reject_blank

NO_EVIDENCE = "[NO EVIDENCE PROVIDED]"
INSUFFICIENT = "The available evidence is insufficient to answer this question."
#: What a generator is told; the later steps read references as [n] and know the sentence for no answer.
SYSTEM_PROMPT = (
    "You write answers that a program checks. Each sentence ends with the number of the block it rests on, as [2]. "
    f'What no block says is not written; if nothing is left to write, the whole answer is: "{INSUFFICIENT}"'
)
BLOCK = (
    "struct<reference:int,chunk_id:string,text:string,source:string,file_type:string,page_number:int,"
    "heading_path:array<string>>"
)


def context_blocks(reranked: DataFrame, k: int = 5) -> DataFrame:
    """query_id, reference and block of the first k chunks (chunk_id, text, final_rank; source, file_type and metadata if there)."""
    if k <= 0:
        raise ValueError("the context must hold at least one chunk")
    has = lambda name: F.col(name) if name.split(".")[0] in reranked.columns else F.lit(None)
    block = F.struct(
        F.col("final_rank").cast("int"), F.col("chunk_id").cast("string"), F.col("text"), has("source").cast("string"),
        has("file_type").cast("string"), has("metadata.page_number").cast("int"),
        has("metadata.heading_path").cast("array<string>"),
    ).cast(BLOCK)
    return reranked.where(F.col("final_rank") <= k).select(
        "query_id", F.col("final_rank").cast("int").alias("reference"), block.alias("block")
    )


def rendered(block: Column) -> Column:
    """A block as lines between [r] and [/r], what is unknown left out."""
    number = block["reference"].cast("string")
    lines = F.array_compact(
        F.array(
            F.concat(F.lit("["), number, F.lit("]")),
            F.when(block["source"] != "", F.concat(F.lit("Source: "), block["source"])),
            F.when(block["page_number"].isNotNull(), F.concat(F.lit("Page: "), block["page_number"].cast("string"))),
            F.when(F.size(block["heading_path"]) > 0, F.concat(F.lit("Section: "), F.array_join(block["heading_path"], " > "))),
            F.lit(""),
            T.strip(block["text"]),
            F.concat(F.lit("[/"), number, F.lit("]")),
        )
    )
    return F.array_join(lines, "\n")


def contexts(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, blocks and context text of every query; without evidence, empty ones."""
    made = blocks.groupBy("query_id").agg(F.array_sort(F.collect_list("block")).alias("blocks"))
    out = queries.select("query_id").join(made, "query_id", "left")
    out = out.withColumn("blocks", F.coalesce("blocks", F.array().cast(f"array<{BLOCK}>")))
    return out.withColumn("context", F.array_join(F.transform("blocks", rendered), "\n\n"))


def prompts(contexts: DataFrame, queries: DataFrame) -> DataFrame:
    """system_prompt and user_prompt of every query; a blank question is an error."""
    asked = reject_blank(queries.select("query_id", F.col("text").alias("question")))
    evidence = F.when(T.strip("context") != "", F.col("context")).otherwise(F.lit(NO_EVIDENCE))
    user = F.concat(  # fixed values: the published form of the prompt
        F.lit("Question:\n"), T.strip("question"), F.lit("\n\nEvidence:\n"), evidence,
        F.lit("\n\nAnswer the question according to the system instructions."),
    )
    return contexts.join(asked, "query_id").select(
        "query_id", "question", "blocks", "context", F.lit(SYSTEM_PROMPT).alias("system_prompt"), user.alias("user_prompt")
    )


def extractive(row: Column | None = None) -> Column:
    """The stand-in generator: the first sentence of each block, with its reference."""
    first = lambda b: F.regexp_replace(F.coalesce(F.get(T.sentences(b["text"]), F.lit(0)), F.lit("")), r"[.!?]+\z", "")
    cited = F.transform(
        F.filter("blocks", lambda b: first(b) != ""),
        lambda b: F.concat(first(b), F.lit(" ["), b["reference"].cast("string"), F.lit("].")),
    )
    return F.when(F.size(cited) > 0, F.array_join(cited, " ")).otherwise(F.lit(INSUFFICIENT))


def generate(prompts: DataFrame, generator: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """answer, model, token counts and latency of every prompt.

    generator: takes the prompts and adds answer, model, prompt_tokens,
    completion_tokens and latency_ms (say, by mapInPandas against a server).
    """
    if generator is not None:
        return generator(prompts)
    none = F.lit(None)
    return prompts.withColumns(
        {
            "answer": extractive(),
            "model": F.lit("extractive"),
            "prompt_tokens": none.cast("int"),
            "completion_tokens": none.cast("int"),
            "latency_ms": F.lit(0.0),
        }
    )


def generator(client: Client) -> Callable[[DataFrame], DataFrame]:
    """A generator that asks a model: answer, model, token counts and latency of every prompt."""

    def made(prompts: DataFrame) -> DataFrame:
        found = replies(prompts, client, F.col("system_prompt"), F.col("user_prompt"))
        return found.drop("total_tokens").withColumnsRenamed(
            {"reply": "answer", "reply_model": "model", "input_tokens": "prompt_tokens", "output_tokens": "completion_tokens"}
        )

    return made


def cited(answers: DataFrame) -> DataFrame:
    """citations (reference and chunk) and unresolved references of answers with blocks."""
    known = F.transform("blocks", lambda b: b["reference"])
    refs = T.references(F.coalesce("answer", F.lit("")))
    block = lambda r: F.get(F.filter("blocks", lambda b: b["reference"] == r), F.lit(0))
    resolved = F.transform(
        F.filter(refs, lambda r: F.array_contains(known, r)),
        lambda r: F.struct(r.alias("reference"), block(r)["chunk_id"].alias("chunk_id")),
    )
    unresolved = F.filter(refs, lambda r: ~F.array_contains(known, r))
    return answers.withColumns({"citations": resolved, "unresolved_references": unresolved})
