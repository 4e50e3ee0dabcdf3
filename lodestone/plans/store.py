"""Versioned tables in a folder, committed together.

A commit writes new versions beside the old ones and then puts the next numbered
pointer file beside the last, which fails if that number is there already. So
readers, who take the highest number, see all of a commit or none of it; of two
commits that began from the same state one fails; and a failed one leaves nothing
behind that is read. No path is written while it is read.

A table is one version, or several parts, each with a label.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.session import shuffles_dropped

POINTER = "pointer-"


class CommitConflict(RuntimeError):
    """Another commit came first."""


class Store:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the last commit, 0 before the first."""
        fs, at = self._fs(), self._path()
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return max((int(n[len(POINTER) :]) for n in names if n.startswith(POINTER)), default=0)

    def current(self) -> dict[str, list[str]]:
        """Paths of the tables' current versions: of a whole table, or of its parts."""
        return self._state(self.version())

    def _state(self, version: int) -> dict[str, list[str]]:
        if not version:
            return {}
        fs, at = self._fs(), self._path(f"{POINTER}{version:012d}")
        stream = fs.open(at)
        try:
            data = self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, fs.getFileStatus(at).getLen())
        finally:
            stream.close()
        return json.loads(bytes(data).decode())

    def _publish(self, version: int, paths: dict[str, list[str]]) -> None:
        """The pointer of this number, written whole and then moved to a place that must be free."""
        jvm, fs = self.spark._jvm, self._fs()
        new, at = self._path(f".{uuid.uuid4().hex}"), self._path(f"{POINTER}{version:012d}")
        stream = fs.create(new, False)
        try:
            stream.write(bytearray(json.dumps(paths, sort_keys=True).encode()))
        finally:
            stream.close()
        try:
            if fs.getUri().getScheme() == "file":  # a local move would overwrite; a link does not
                local = [jvm.java.nio.file.Path.of(jvm.java.net.URI.create(f"file://{p.toUri().getPath()}")) for p in (at, new)]
                jvm.java.nio.file.Files.createLink(*local)
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(new, at, none)
        except Py4JJavaError as e:
            if fs.exists(at):
                raise CommitConflict(f"{self.folder} was changed by another commit") from e
            raise
        finally:
            if fs.exists(new):
                fs.delete(new, False)

    def put(self, name: str, df: DataFrame, label: str) -> DataFrame:
        """Write a part where it will lie, and read it; nobody else does before a commit has it among its `ready` ones."""
        path = f"{self.folder}/{name}/{label}"
        with shuffles_dropped(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def commit(
        self, tables: dict[str, DataFrame], added: dict[str, DataFrame] | None = None, label: str | None = None,
        without: Iterable[str] = (), base: int | None = None, also: dict[str, DataFrame] | None = None, ready: Iterable[str] = (),
    ) -> None:
        """Write new versions of these tables and parts that are added to others; the rest stays as it is.

        label: of the added parts. also: added parts with labels of their own.
        ready: tables whose part with the label was `put` there.
        without: labels whose parts go, in all tables.
        base: the version that what is written was computed from, by default the
        current one. If another commit came since, this one is an error and changes nothing.
        """
        base = self.version() if base is None else base
        gone = set(without)
        paths = {name: [p for p in parts if p.rpartition("/")[2] not in gone] for name, parts in self._state(base).items()}

        def write(name: str, df: DataFrame, as_name: str) -> str:
            self.put(name, df, as_name)
            return f"{self.folder}/{name}/{as_name}"

        for name, df in tables.items():
            paths[name] = [write(name, df, uuid.uuid4().hex)]
        for name in ready:
            paths[name] = [*paths.get(name, []), f"{self.folder}/{name}/{label}"]
        for parts, named in ((added or {}, label), (also or {}, None)):
            for name, df in parts.items():
                paths[name] = [*paths.get(name, []), write(name, df, named or uuid.uuid4().hex)]
        if self.version() != base:
            raise CommitConflict(f"{self.folder} was changed by another commit")
        self._publish(base + 1, {name: parts for name, parts in paths.items() if parts})

    def create(self, name: str, schema: StructType, dimension: int | None = None) -> None:
        """An empty table, if there is none; one of another dimension is an error."""
        have = self.current()
        if name not in have:
            self.commit({name: self.spark.createDataFrame([], schema)})
        elif dimension is not None:
            first = self.read(name).select(F.size("embedding").alias("n")).first()
            if first is not None and first["n"] != dimension:
                raise ValueError(f"{name} holds vectors of {first['n']} dimensions, not {dimension}")

    def reset(self, name: str, schema: StructType) -> None:
        """Put an empty table in the place of what there is."""
        self.commit({name: self.spark.createDataFrame([], schema)})

    def clean(self) -> int:
        """Delete versions that the last pointer does not name, and older pointers; how many versions there were. No reader may be at work on them."""
        fs, at, version = self._fs(), self._path(), self.version()
        kept = {path.rpartition("/")[2] for paths in self.current().values() for path in paths}
        gone = 0
        if not fs.exists(at):
            return 0
        for table in fs.listStatus(at):
            name = table.getPath().getName()
            if table.isDirectory():
                for part in fs.listStatus(table.getPath()):
                    if part.getPath().getName() not in kept:
                        gone += bool(fs.delete(part.getPath(), True))
            elif name.startswith(POINTER) and int(name[len(POINTER) :]) < version:
                fs.delete(table.getPath(), False)
        return gone

    def read(self, name: str, schema: StructType | None = None, labels: Iterable[str] | None = None) -> DataFrame:
        """A table's current version, or the parts with these labels; with a schema, none yet is an empty one."""
        paths = self.current().get(name, [])
        if labels is not None:
            only = set(labels)
            paths = [p for p in paths if p.rpartition("/")[2] in only]
        if not paths:
            if schema is None:
                raise FileNotFoundError(f"{self.folder} has no table {name}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths) if schema else self.spark.read.parquet(*paths)

    def labels(self, name: str) -> list[str]:
        """The labels of a table's parts, oldest first."""
        return [p.rpartition("/")[2] for p in self.current().get(name, [])]

    def parts(self, name: str) -> int:
        """How many parts a table has."""
        return len(self.current().get(name, []))

    def compact(self, names: list[str] | None = None) -> None:
        """Write tables of several parts anew, as one."""
        many = [n for n, paths in self.current().items() if len(paths) > 1 and (names is None or n in names)]
        if many:
            self.commit({n: self.read(n) for n in many})


def merge_existing_wins(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Old rows, and those new ones whose key is new."""
    return old.unionByName(new.join(old.select(key), key, "left_anti").dropDuplicates([key]))


def merge_new_wins(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """New rows, and those old ones that no new one replaces."""
    return old.join(new.select(key), key, "left_anti").unionByName(new.dropDuplicates([key]))


def checked_vectors(vectors: DataFrame, dimension: int) -> DataFrame:
    """Vectors, with an error if one has not the collection's dimension."""
    wrong = F.size("embedding") != dimension
    message = F.concat(F.lit(f"expected {dimension} dimensions for chunk "), F.col("chunk_id"))
    failed = F.raise_error(message).cast(vectors.schema["embedding"].dataType)
    return vectors.withColumn("embedding", F.when(wrong, failed).otherwise(F.col("embedding")))


def complete(vectors: DataFrame, chunks: DataFrame) -> bool:
    """Whether a vector table has a row for every chunk and no other, so that it can be used again."""
    return vectors.count() == chunks.count() and chunks.join(vectors, "chunk_id", "left_anti").isEmpty()


def vector_index(store: Store, chunks: DataFrame, make, rebuild: bool = False) -> bool:
    """Use the stored vectors again if they are those of the chunks, else build them; whether they were built.

    make: chunks to rows of vectors. What was built must have a row for every chunk.
    """
    if not rebuild and "vectors" in store.current() and complete(store.read("vectors"), chunks):
        return False
    store.commit({"vectors": make(chunks)})
    built, wanted = store.read("vectors").count(), chunks.count()
    if built != wanted:
        raise RuntimeError(f"{built} vectors were written for {wanted} chunks")
    return True


def append_results(results: DataFrame, path: str) -> None:
    """Add rows to a JSON-lines result log."""
    results.write.mode("append").json(path)
