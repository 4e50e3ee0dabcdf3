"""What the operators share: tables, stashes, distributed ranking, columns made in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.session import drop_stash, shared_path, ship_package, stash

__all__ = ["FORGET", "checked_broadcast", "cut", "drop_stash", "fresh", "map_column", "rank_buckets", "ranked", "row_order", "shared_path", "ship_package", "slices", "stash", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checked_broadcast(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A narrow written table, to be broadcast if it has at most so many rows (some 16 bytes each); else joined by its keys."""
    return F.broadcast(df) if df.count() <= rows else df


def row_order(df: DataFrame) -> Column:
    """A number that grows in the order in which a table's rows were written: by part file, then row. Rows of no file go as they come."""
    try:
        df.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return F.monotonically_increasing_id()
    part = F.regexp_extract("_metadata.file_name", "^part-([0-9]+)", 1).try_cast("long")
    return F.coalesce(part, F.lit(0)) * F.lit(1 << 40) + F.col("_metadata.row_index")


def rank_buckets(rows: int, per_bucket: int = 20_000) -> int:
    """How many parts a key is ranked in: so many that a key with all rows fits."""
    return 16 + rows // per_bucket


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, buckets: int) -> DataFrame:
    """Add `name`: a gapless number from 0 within each key.

    A key may hold any share of the rows, and any number of them may be equal:
    rows are numbered where they lie and written, each key is split into
    `buckets` parts by a hash of `order` and that number, parts are counted
    (partial sums before the shuffle), and a row's number is the count before
    its part plus its rank in the part. Keys must not be null.
    """
    row, part, n, first = (fresh(c, df.columns) for c in ("_row", "_part", "_n", "_before"))
    df = stash(df.withColumn(row, F.monotonically_increasing_id()), "ranked")
    df = df.withColumn(part, F.pmod(F.xxhash64(*order, F.col(row)), F.lit(buckets)).cast("int"))
    by = [*keys, part]
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*by).agg(F.count(F.lit(1)).alias(n)).select(*by, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    within = Window.partitionBy(*by).orderBy(*order, row)
    numbered = df.join(offsets, by).withColumn(name, F.col(first) + F.row_number().over(within) - F.lit(1))
    return numbered.drop(row, part, first)


def fresh(name: str, taken: Sequence[str]) -> str:
    """The name, with underscores before it while a column is called so."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


#: What frees the large memories that an operator keeps in a Python worker from task to task.
FORGET: list[Callable[[], None]] = []


def cut(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows and, above one row, so many bytes, so that few texts are held as strings at a time."""
    for batch in batches:
        each = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
                each += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, at = np.cumsum(each), 0
        while at < batch.num_rows:
            before = int(upto[at - 1]) if at else 0
            to = max(at + 1, min(at + rows, int(np.searchsorted(upto, before + size, side="right"))))
            yield batch.slice(at, to - at)
            at = to


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches cut small. Workers serve one operator after the other: what another one remembers is freed first."""
    for forget in FORGET:
        forget()
    pa.default_memory_pool().release_unused()
    yield from cut(batches, rows)


def map_column(df: DataFrame, column: str, keep: Sequence[str], made: str, start: Callable[[], Callable]) -> DataFrame:
    """Add columns computed from one column; the kept ones pass through untouched.

    made: the new columns as DDL. start() runs once in each task and gives a
    function from a list of values to a list of lists, one for each new column.
    """
    ship_package(df.sparkSession)
    schema = StructType(df.select(*keep).schema.fields + StructType.fromDDL(made).fields)
    names = schema.fieldNames()
    at = next((i for i, c in enumerate(keep) if c == column), len(keep))  # a kept column goes to Python once
    inputs = df.select(*keep, *[F.col(column).alias("\u0000in")] * (at == len(keep)))
    n = len(keep)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        work = start()
        kinds = [to_arrow_type(f.dataType) for f in schema.fields[n:]]
        for batch in slices(batches):
            found = work(batch.column(at).to_pylist())
            arrays = [pa.array(x, k) for x, k in zip(found, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n)] + arrays, names)

    return inputs.mapInArrow(rows, schema)
