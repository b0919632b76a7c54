"""What the training-data operators share: column picking, table reading and stored steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from swelter.session import cut_lineage, ship_package

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, whatever else the table holds.

    An exact spelling wins over one that differs in case, the first of equal names over the
    others, so extra columns can clash with nothing an operator adds.
    """
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    out = []
    for name in names:
        at = [i for i, c in enumerate(df.columns) if c == name] or [
            i for i, c in enumerate(df.columns) if c.lower() == name.lower()
        ]
        if not at:
            raise ValueError(f"the table has no column {name}: {df.columns}")
        out.append(plain[f"_{at[0]}"].alias(name))
    return plain.select(*out)


def store(df: DataFrame) -> DataFrame:
    """Write a step to the shared checkpoint folder and read it back."""
    return cut_lineage(df)


def words(text: Column) -> Column:
    """The words of a text; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def map_text(
    df: DataFrame, fn: Callable[..., list], out: str, inputs: tuple[str, ...] = ("text",), keep_inputs: bool = False
) -> DataFrame:
    """``fn`` over the ``inputs`` columns in Arrow batches; the other columns pass through untouched.

    ``fn`` gets a list of values (None for NULL) per input and gives one list or array for
    every field of the schema ``out``. Tasks hold one batch at a time.
    """
    ship_package(df.sparkSession)
    kept = [c for c in df.columns if keep_inputs or c not in inputs]
    added = StructType.fromDDL(out)
    schema = StructType([df.schema[c] for c in kept] + added.fields)
    names = [f.name for f in schema.fields]
    types = to_arrow_schema(added).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(*[batch.column(c).to_pylist() for c in inputs])
            made = [a.cast(t) if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(made, types)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + made, names=names)

    return df.mapInArrow(run, schema)


#: Characters or list values of a slice of a batch; a longer row is a slice of its own.
SLICE = 1 << 20


def slices(batch: pa.RecordBatch, column: pa.Array, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` characters or values of the column."""
    if pa.types.is_list(column.type):
        sizes = column.value_lengths()
    elif pa.types.is_string(column.type):
        sizes = pc.binary_length(column)
    else:
        yield batch
        return
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < batch.num_rows:
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def map_arrays(
    df: DataFrame, fn: Callable[..., list[pa.Array]], out: str, inputs: tuple[str, ...], keep_inputs: bool = False, most: int = SLICE
) -> DataFrame:
    """As ``map_text``, but ``fn`` gets and gives Arrow arrays, for columns of long lists. It is
    called for slices of a batch of about ``most`` characters or values of the first input."""
    ship_package(df.sparkSession)
    kept = [c for c in df.columns if keep_inputs or c not in inputs]
    added = StructType.fromDDL(out)
    schema = StructType([df.schema[c] for c in kept] + added.fields)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.column(inputs[0]), most):
                made = fn(*[part.column(c) for c in inputs])
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + made, names=names)

    return df.mapInArrow(run, schema)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column in one array, and the number of values of every row (0 for NULL)."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), sizes


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """The other way round."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
