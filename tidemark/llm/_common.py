"""Helpers shared by the corpus operators: folders, saved tables, row streams."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._files import opened


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the operators' unit of parallelism."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    It is the one in ``spark.checkpoint.dir``. Only where that is unset, as in
    local tests, a temporary folder is made and set as checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: what follows reads files and survives lost executors.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Remove the files of a :func:`saved` table that nothing reads any more."""
    for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
        system, name = opened(folder)
        system.delete_dir(name)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as make it no column's."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def row_key(docs: DataFrame, id_col: str, text_col: str, *others: str) -> Column:
    """A key of rows whose ids may be null or repeat: ordered by id, null last; equal just for equal ids, texts (null: empty) and ``others``."""
    sha = F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")).cast("binary"), 256))
    return F.struct(docs[id_col].isNull().alias("missing"), docs[id_col].alias("id"), sha.alias("sha"), *[docs[c].alias(c) for c in others])


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, one batch in memory at a time."""
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def batched(items: Iterator[tuple], schema: pa.Schema, limit: int = 2048) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``limit`` tuples."""
    held: list[tuple] = []
    for item in items:
        held.append(item)
        if len(held) >= limit:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
