"""JSON, JSON-lines and TSV sources with explicit schemas and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestone import schemas
from lodestone.functions import text as T
from lodestone.functions.identity import chunk_id

UNANSWERABLE = ("unanswerable_clear", "unanswerable_weak_evidence")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def json_lines(spark: SparkSession, path: str, schema: StructType, missing_ok: bool = False) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, a broken line is an error that shows it (`broken_line` finds its number)."""
    if not exists(spark, path):
        if missing_ok:
            return spark.createDataFrame([], schema)
        raise FileNotFoundError(path)
    lines = spark.read.text(path).where(T.strip("value") != "")
    wide = StructType([*schema.fields, StructField("_bad", StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    rows = lines.select(F.from_json("value", wide, options).alias("r")).select("r.*")
    checked = F.when(F.col("_bad").isNotNull(), F.raise_error(F.concat(F.lit("invalid JSON line: "), F.col("_bad"))))
    first = schema.fieldNames()[0]
    return rows.withColumn(first, F.coalesce(checked.cast(schema[first].dataType), F.col(first))).select(*schema.fieldNames())


def broken_line(spark: SparkSession, path: str, schema: StructType) -> tuple[int, str] | None:
    """The 1-based number of the first line that is neither blank nor JSON of the schema, and the line."""
    wide = StructType([*schema.fields, StructField("_bad", StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    lines = spark.read.text(path).withColumn("_bad", F.from_json("value", wide, options)["_bad"])
    if lines.where((T.strip("value") != "") & F.col("_bad").isNotNull()).isEmpty():
        return None
    numbered = spark.read.text(path).rdd.zipWithIndex().map(lambda x: (x[1] + 1, x[0][0])).toDF("n long, value string")
    bad = numbered.withColumn("_bad", F.from_json("value", wide, options)["_bad"])
    first = bad.where((T.strip("value") != "") & F.col("_bad").isNotNull()).orderBy("n").first()
    return first["n"], first["value"]


def json_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of a file that holds one JSON array."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def chunk_store(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a JSON-lines store (none if there is no file); a stored id that is not the chunk's own is an error."""
    schema = schemas.of("CHUNK")
    if exists(spark, path) and (bad := broken_line(spark, path, schema)):
        raise ValueError(f"{path}, line {bad[0]}: invalid JSON: {bad[1][:200]}")
    return checked_chunks(json_lines(spark, path, schema, missing_ok=True))


def checked_chunks(rows: DataFrame) -> DataFrame:
    """Chunks whose stored id, where there is one, is the id that their content gives."""
    own = chunk_id("source", "chunk_index", "text")
    wrong = F.col("chunk_id").isNotNull() & (F.col("chunk_id") != own)
    message = F.concat(F.lit("chunk id does not match its content: "), F.col("chunk_id"))
    return rows.withColumn("chunk_id", F.when(wrong, F.raise_error(message).cast("string")).otherwise(own))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a registry file {"documents": [...]}; none if there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.of("REGISTRY_ROW"))
    return json_array(spark, path, schemas.of("REGISTRY_FILE")).select(F.inline("documents"))


def retrieval_cases(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, schemas.of("RETRIEVAL_CASE"))


def golden_violations(cases: DataFrame) -> DataFrame:
    """id and rule of every broken rule of a golden data set."""
    blank = lambda c: F.coalesce(T.strip(c), F.lit("")) == ""
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    answerable = F.coalesce(F.col("answerable"), F.lit(False))
    rules = F.array_compact(
        F.array(
            F.when(blank("question"), F.lit("blank question")),
            F.when(answerable & blank("reference_answer"), F.lit("answerable without reference answer")),
            F.when(answerable & empty("required_facts"), F.lit("answerable without required facts")),
            F.when(answerable & empty("evidence_spans"), F.lit("answerable without evidence spans")),
            F.when(
                ~answerable & ~F.coalesce(F.col("answerability_type").isin(*UNANSWERABLE), F.lit(False)),
                F.lit("unknown answerability type"),
            ),
        )
    )
    each = cases.select("id", F.explode(rules).alias("rule"))
    twice = cases.groupBy("id").count().where("count > 1").select("id", F.lit("id is not unique").alias("rule"))
    return each.unionByName(twice)


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    """A golden data set that breaks no rule; ValueError tells which it breaks."""
    cases = json_array(spark, path, schemas.of("GOLDEN_CASE"))
    if cases.isEmpty():
        raise ValueError("the golden data set is empty")
    if broken := golden_violations(cases).orderBy("id", "rule").limit(20).collect():
        raise ValueError("; ".join(f"{r['id']}: {r['rule']}" for r in broken))
    return cases


def beir_corpus(rows: DataFrame) -> DataFrame:
    """doc_id, title, body and retrieval text of a corpus with _id, title and text."""
    title, body = (T.strip(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "text"))
    text = F.concat_ws("\n\n", F.nullif(title, F.lit("")), F.nullif(body, F.lit("")))
    return rows.select(F.col("_id").alias("doc_id"), title.alias("title"), body.alias("body"), text.alias("text"))


def beir_queries(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("_id").alias("query_id"), T.strip("text").alias("text"))


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id and score of a judgment TSV; of repeated pairs the last counts."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    names = {c.replace("-", "_"): c for c in raw.columns}
    if missing := {"query_id", "corpus_id", "score"} - names.keys():
        raise ValueError(f"judgments lack the columns {sorted(missing)}")
    rows = raw.select(
        F.col(f"`{names['query_id']}`").alias("query_id"),
        F.col(f"`{names['corpus_id']}`").alias("doc_id"),
        F.col(names["score"]).cast("int").alias("score"),
        F.monotonically_increasing_id().alias("_line"),
    )
    return last_judgments(rows, "_line")


def last_judgments(rows: DataFrame, order: str) -> DataFrame:
    latest = Window.partitionBy("query_id", "doc_id").orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1").select("query_id", "doc_id", "score")


def missing_references(qrels: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """kind and id of judged queries and documents that are not there."""
    q = qrels.join(queries, "query_id", "left_anti").select(F.lit("query").alias("kind"), F.col("query_id").alias("id"))
    d = qrels.join(corpus, "doc_id", "left_anti").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"))
    return q.unionByName(d).distinct()


def check_benchmark(qrels: DataFrame, queries: DataFrame, corpus: DataFrame) -> None:
    """An error if judgments name queries or documents that are not there; it tells how many and the first."""
    missing = missing_references(qrels, queries, corpus).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    if found := sorted(missing.collect()):
        raise RuntimeError("; ".join(f"{r['n']} judged {r['kind']} id(s) are missing, the first {r['first']!r}" for r in found))


def case_results(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.of("CASE_RESULT"))


def completed_cases(spark: SparkSession, path: str) -> DataFrame:
    """Ids of cases in a result log; none if there is no log."""
    rows = json_lines(spark, path, schemas.of("CASE_RESULT"), missing_ok=True)
    return rows.where(F.coalesce(F.col("case_id"), F.lit("")) != "").select("case_id").distinct()
