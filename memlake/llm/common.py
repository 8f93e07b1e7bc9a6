"""Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

#: Stands for a null id inside the kernels; it sorts after every other id.
NULL_ID = np.iinfo(np.int64).max


def staged(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends here.

    parts, where given, bounds its files and the tasks that write them.
    """
    df = df.coalesce(parts) if parts else df
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> Column:
    """The column of that name, whatever it holds: dots and backticks too."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_rows(df: DataFrame, f: Callable, schema) -> DataFrame:
    """df.mapInArrow(f, schema) for columns of any names, which f finds in its record batches."""
    names = df.columns
    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(lambda it: f(b.rename_columns(names) for b in it), schema)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size of what df reads: of file scans, the size of the files; sources of unknown size count as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def partitions_for(df: DataFrame, each: int) -> int:
    """Enough partitions for parts of about `each` bytes of df's plan, and no fewer than spark.sql.shuffle.partitions."""
    return min(1 << 17, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-plan_bytes(df) // each)))


def ids(column: pa.Array) -> np.ndarray:
    """A long column as int64, with NULL_ID for null."""
    return column.cast(pa.int64()).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)


def longs(values: np.ndarray) -> pa.Array:
    """The reverse of ids()."""
    values = np.asarray(values, np.int64)
    return pa.array(values, pa.int64(), mask=values == NULL_ID)


def batches(columns: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One record batch, or none where it would be empty."""
    if len(columns[0]):
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
