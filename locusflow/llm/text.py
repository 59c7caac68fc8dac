"""Column helpers the text operators share."""

from __future__ import annotations

import ctypes
import string
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from locusflow.llm.words import slices
from locusflow.operators.durable import durable

#: Characters of text whose results are held at once.
PART_CHARS = 1_000_000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def bucket(key: Column, of: int) -> Column:
    """crc32 of the key written as text, modulo ``of``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(of)).cast("int")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Hand memory this worker has freed back to the system; Spark keeps workers for the stages that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def with_columns(documents: DataFrame, compute: Callable, columns: dict[str, T.DataType]) -> DataFrame:
    """All rows and columns, and ``columns`` computed from batches of texts.

    ``compute`` is called once a task and returns a function from a list of texts to one
    list for each new column; it gets a few texts at a time, PART_CHARS characters or one text. Columns of the same names are replaced; all others pass
    through as they are.
    """
    kept = documents.drop(*columns)
    schema = T.StructType([*kept.schema.fields, *(T.StructField(c, t) for c, t in columns.items())])
    arrow = {c: to_arrow_type(t) for c, t in columns.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = compute()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts, PART_CHARS):
                found = work(texts[a:b])
                added = [pa.array(values, type=arrow[c]) for c, values in zip(columns, found)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, *added], names=[*batch.schema.names, *columns]
                )
                del found, added
            del batch, texts
        del work
        give_back()

    return kept.mapInArrow(run, schema)


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Written as Parquet in the shared checkpoint folder and read again."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        durable(spark.range(1))  # sets the folder
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.parquet(path)
