"""Tabular inputs and outputs: admission files, centroid files, result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swelter.functions.dates import parse_date_safe, strip
from swelter.operators.zips import last_per_zip, zip_centroids

TEXT_COLUMNS = ("zip5", "ADMIT_DATE", "DISCHARGE_DATE")


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Drop the index columns that spreadsheet exports leave behind."""
    return df.drop(*[F.col(f"`{c}`") for c in df.columns if c.strip().lower().startswith("unnamed:")])


#: As spreadsheets and pandas write them: doubled quotes, line breaks inside quotes.
CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True}


def header_schema(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file from its first record."""
    return spark.read.options(**CSV).csv(path).columns


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV with every column as text: no inference pass, leading zeros survive. Quoted fields may
    hold separators, quotes and line breaks, so a file is read by one task."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header_schema(spark, path)])
    return spark.read.options(**CSV).schema(schema).csv(path)


def with_row_id(df: DataFrame) -> DataFrame:
    """Number the rows of whole files in order of file name and place: file number times 2^40 plus place.

    Read the result back from a table before use, so that all later steps see the same numbers.
    Tables that are not read from files are numbered as they come.
    """
    if not df.inputFiles():
        return df.withColumn("row_id", F.monotonically_increasing_id())
    named = df.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    # one row per input file
    files = named.groupBy("_file").agg(F.min("_at").alias("_first"))
    files = files.withColumn("_n", F.row_number().over(Window.orderBy("_file")) - 1)
    out = named.join(files, "_file").withColumn("row_id", F.col("_n") * (1 << 40) + F.col("_at") - F.col("_first"))
    return out.drop("_file", "_at", "_first", "_n")


#: Columns that the exposure steps add; columns of the same name step aside until the output.
HELPERS = ("row_id", "zip", "admit_ts", "discharge_ts", "admit", "pct", "day", "d")
ASIDE = "given_"


def step_aside(df: DataFrame) -> DataFrame:
    """Rename columns that would collide with a helper, whatever their case, to ``given_<name>``."""
    taken = {c.lower() for c in df.columns}
    clash = [c for c in df.columns if c.lower() in HELPERS and f"{ASIDE}{c}".lower() not in taken]
    lost = [c for c in df.columns if c.lower() in HELPERS and c not in clash]
    if lost:
        raise ValueError(f"columns {lost} cannot be kept: {ASIDE}<name> is taken too")
    return df.toDF(*[f"{ASIDE}{c}" if c in clash else c for c in df.columns])


def given_name(column: str) -> str:
    """Name that a column had in the file."""
    plain = column.removeprefix(ASIDE)
    return plain if plain.lower() in HELPERS else column


def prepare_patients(raw: DataFrame) -> DataFrame:
    """Add ``row_id, zip, admit_ts, discharge_ts, admit``; unknown dates are NULL.

    Columns of the file that have such a name, ``row_id`` included, are kept under another one.
    """
    if "zip5" not in raw.columns:
        raise KeyError("the admission table must have a zip5 column")
    df = with_row_id(step_aside(drop_unnamed(raw)))

    def when(name: str):
        return parse_date_safe(F.col(name).cast("string")) if name in df.columns else F.lit(None).cast("timestamp_ntz")

    zip5 = strip(F.col("zip5").cast("string"))
    return df.withColumns(
        {"zip5": zip5, "zip": zip5, "admit_ts": when("ADMIT_DATE"), "discharge_ts": when("DISCHARGE_DATE")}
    ).withColumn("admit", F.col("admit_ts").cast("date"))


def read_patients(spark: SparkSession, path: str) -> DataFrame:
    """Admissions from CSV (or Parquet when the path says so)."""
    raw = spark.read.parquet(path) if path.rstrip("/").endswith("parquet") else read_csv_text(spark, path)
    return prepare_patients(raw)


def read_zip_centroids(spark: SparkSession, path: str) -> DataFrame:
    """One centroid per ZIP from a CSV whose headers are recognised; the last row wins."""
    return last_per_zip(zip_centroids(with_row_id(read_csv_text(spark, path))), "row_id").drop("row_id")


def column_listing(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def rebalanced(df: DataFrame, by: Sequence[str], sort: Sequence[str] = ()) -> DataFrame:
    """Bring the rows of an output folder together before a write, so that tasks do not each
    open a file in every folder. Adaptive execution splits folders that are too big for one
    task and merges small ones."""
    return df.hint("rebalance", *by).sortWithinPartitions(*by, *sort)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], sort: Sequence[str] = ()) -> None:
    """Replace exactly the partitions present in ``df``; others stay (dynamic overwrite)."""
    if not by:
        df.coalesce(1).write.mode("overwrite").parquet(path)
        return
    out = rebalanced(df, by, sort).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """CSV folder with headers; ``order`` gives the global row order."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')
