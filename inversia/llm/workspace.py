"""Tables written once to the shared folder, and Arrow batches of texts."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inversia.session import scratch_path

FOLDS = 5
#: Long rows (texts, lists of features) that a task opens at once while a model is fitted.
LONG_ROWS = 256


class Workspace:
    """One run's folder below ``spark.checkpoint.dir``.

    ``keep`` writes a table there and returns it as read back, so that a lost executor costs one
    task and not the lineage; ``drop`` and ``clear`` remove what nothing will read again. Tables that a
    returned DataFrame still reads stay until the owner of the checkpoint folder clears it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self._made = spark, scratch_path(spark, name), 0
        self._paths: dict[int, str] = {}
        self._written: list[str] = []

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        self._made += 1
        path = f"{self.root}/{self._made:03d}-{label}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = path
        self._written.append(path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        self._remove([self._paths.pop(id(table)) for table in tables])

    def clear(self, *still_read: DataFrame) -> None:
        """Remove all tables but those that are still read."""
        stay = {self._paths[id(table)] for table in still_read}
        self._remove([path for path in self._written if path not in stay])

    def _remove(self, paths: list[str]) -> None:
        for name in paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self._written = [path for path in self._written if path not in paths]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@contextmanager
def few_at_once(spark: SparkSession, rows: int = LONG_ROWS) -> Iterator[None]:
    """Jobs run within read Parquet and send rows to Python so many at a time. Spark's own thousands
    are many megabytes of long rows, held by reader, Arrow and Python at once."""
    sizes = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {name: spark.conf.get(name) for name in sizes}
    try:
        for name in sizes:
            spark.conf.set(name, str(rows))
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def bytes_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 of every text of an Arrow column."""
    return column.cast(pa.large_binary()).to_pylist()


def per_batch(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """Arrow batches through ``make()``'s function; ``make`` runs once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            yield work(batch)

    return df.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """One fold in five, by the CRC-32 of the id as text; null ids are never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def held_out_id(doc_id: int | None) -> bool:
    """The same for a Python value."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def words(text: Column) -> Column:
    """Runs of anything but space and U+0009 to U+000D, as an array; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def word_count(text: Column) -> Column:
    """Number of such runs, as a long."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")
