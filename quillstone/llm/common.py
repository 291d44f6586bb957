"""What the operators share: table reads, shared-folder tables and Arrow text access."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quillstone.sources.stored import drop_shared_tables, drop_table, shared_folder, shared_result, shared_table  # noqa: F401

#: Arrow batches are cut by Spark at this many bytes, so that very long texts stay within a worker's memory.
BATCH_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Have Arrow batches cut at BATCH_BYTES; a smaller bound that the session was given stays, as does a larger one."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


def col(name: str) -> Column:
    """The column of that name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(columns: Sequence[str], name: str) -> str:
    """A name like `name` that no column has."""
    while name in columns:
        name += "_"
    return name


def map_column(rows: DataFrame, keep: Sequence[str], source: Column, added: Sequence[StructField], make: Callable[[pa.Array], Sequence[pa.Array]]) -> DataFrame:
    """`keep` and the columns `added`, which `make` returns for each Arrow batch of `source`.

    Columns travel under private names, so no name of the input clashes; a kept column of an added name gives way.
    """
    bound_batches(rows.sparkSession)
    keep = [c for c in keep if c not in {f.name for f in added}]
    private = rows.select(*(col(c).alias(f"__k{n}") for n, c in enumerate(keep)), source.alias("__source"))
    schema = StructType([*(StructField(c, private.schema[n].dataType) for n, c in enumerate(keep)), *added])
    names, n = schema.names, len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(n)), *make(b.column(n))], names)

    return private.mapInArrow(run, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column without copying texts; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    if column.null_count:
        sizes = np.diff(at) * column.is_valid().to_numpy(zero_copy_only=False)
        if sizes.sum() != at[-1] - at[0]:
            column = pa.array(column.fill_null(""))
            return utf8(column)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes; a longer row is a run of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end
