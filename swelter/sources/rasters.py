"""Daily rasters and daily caches as tables, one task per file, row blocks out.

A file that cannot be read does not stop the job: it yields one row with the ``error`` text
and no cells, so a bad day is simply missing and can be listed.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import date, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swelter.functions.dates import DATE_TOKEN
from swelter.functions.numeric import RASTER_NODATA
from swelter.session import ship_package

BLOCK_ROWS = 64
PAIR_DDL = "path string, d date, r int, c int, t float, td float, error string, kind string, as_of timestamp"
CACHE_DDL = "path string, d date, r int, c int, hi float, t2 float, error string"


def day_of(path: str) -> date:
    found = re.findall(DATE_TOKEN, path.rsplit("/", 1)[-1])
    if not found:
        raise ValueError("no date in the file name")
    return datetime.strptime(found[-1], "%Y%m%d").date()


def bil_header(text: str) -> dict[str, str]:
    pairs = (line.split(None, 1) for line in text.splitlines() if line.strip())
    return {p[0].upper(): p[1].strip() for p in pairs if len(p) == 2}


def decode_bil(header: dict[str, str], body: bytes) -> np.ndarray:
    """First band of a BIL raster as float64 with missing cells as NaN."""
    rows, cols = int(header["NROWS"]), int(header["NCOLS"])
    bits, bands = int(header.get("NBITS", 8)), int(header.get("NBANDS", 1))
    kind = {"FLOAT": "f", "SIGNEDINT": "i"}.get(header.get("PIXELTYPE", "UNSIGNEDINT").upper(), "u")
    order = ">" if header.get("BYTEORDER", "I").upper().startswith("M") else "<"
    img = np.frombuffer(body, dtype=f"{order}{kind}{bits // 8}", count=rows * cols * bands).reshape(rows, bands, cols)
    out = img[:, 0, :].astype(np.float64)
    out[out == float(header.get("NODATA", RASTER_NODATA))] = np.nan
    out[out == RASTER_NODATA] = np.nan
    return out


def decode_archive(body: bytes) -> np.ndarray:
    """First ``.bil`` of a zip in name order."""
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        hits = sorted(n for n in z.namelist() if n.lower().endswith(".bil"))
        if not hits:
            raise FileNotFoundError("no .bil raster in the archive")
        return decode_bil(bil_header(z.read(hits[0][:-4] + ".hdr").decode("ascii", "ignore")), z.read(hits[0]))


def decode_raster(path: str, body: bytes, header: bytes | None = None) -> np.ndarray:
    """A zip archive, or a loose ``.bil`` with the header that lies beside it."""
    if path.lower().endswith(".zip"):
        return decode_archive(body)
    if header is None:
        raise FileNotFoundError("no .hdr beside the .bil")
    return decode_bil(bil_header(header.decode("ascii", "ignore")), body)


def decode_cache(path: str, body: bytes, tvar: str) -> tuple[np.ndarray, np.ndarray]:
    """Heat index and temperature of a daily cache; the variable tag must match."""
    with np.load(io.BytesIO(body), allow_pickle=False) as data:
        absent = {"HI", "T2", "tvar"} - set(data.files)
        if absent:
            raise KeyError(f"missing {sorted(absent)}")
        check_tag(str(np.asarray(data["tvar"]).item()), tvar)
        return np.asarray(data["HI"], np.float32), np.asarray(data["T2"], np.float32)


def check_tag(found: str, wanted: str) -> None:
    if found != wanted:
        raise ValueError(f"cache holds {found!r}, not {wanted!r}")


def _blocks(path: str, day: date, arrays: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    rows, cols = next(iter(arrays.values())).shape
    for top in range(0, rows, BLOCK_ROWS):
        part = {n: a[top : top + BLOCK_ROWS].astype(np.float32) for n, a in arrays.items()}
        r, c = np.indices(next(iter(part.values())).shape, dtype=np.int32)
        n = r.size
        yield pa.RecordBatch.from_pydict(
            {
                "path": pa.array([path] * n, pa.string()),
                "d": pa.array([day] * n, pa.date32()),
                "r": pa.array(r.ravel() + np.int32(top)),
                "c": pa.array(c.ravel()),
                **{k: pa.array(v.ravel(), from_pandas=True) for k, v in part.items()},
                "error": pa.nulls(n, pa.string()),
            }
        )


def list_files(spark: SparkSession, path: str, glob: str, kind: str) -> DataFrame:
    """(kind, path, length, modified, d) of the files of a folder; none of them is opened."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return found.select(F.lit(kind).alias("kind"), "path", "length", F.col("modificationTime").alias("modified")).withColumn("d", path_day())


def paths_of(files: DataFrame) -> list[str]:
    """The names of some files; one per day and kind at most, so bounded by the calendar."""
    return [x.path for x in files.select("path").distinct().collect()]


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Path, content and, for loose .bil files, the content of the .hdr with the same name."""
    ship_package(spark)
    load = lambda names: spark.read.format("binaryFile").load(names).select("path", "content")
    loose = [p for p in paths if p.lower().endswith(".bil")]
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    beside = [p[:-4] + ".hdr" for p in loose]
    held = []
    for folder in sorted({p.rpartition("/")[0] for p in beside}):
        held += [x.path for x in spark.read.format("binaryFile").option("pathGlobFilter", "*.hdr").load(folder).select("path").collect()]
    wanted = sorted(set(beside) & set(held))
    if not wanted:
        return load(paths).withColumn("header", F.lit(None).cast("binary"))
    headers = load(wanted).select(stem.alias("stem"), F.col("content").alias("header"))
    return load(paths).withColumn("stem", stem).join(headers, "stem", "left").select("path", "content", "header")


def _failed(path: str, exc: Exception, kind: str | None, names: tuple[str, ...]) -> pa.RecordBatch:
    given = {} if kind is None else {"kind": pa.array([kind])}
    return pa.RecordBatch.from_pydict(
        {
            "path": pa.array([path]), "d": pa.nulls(1, pa.date32()), "r": pa.nulls(1, pa.int32()), "c": pa.nulls(1, pa.int32()),
            **{n: pa.nulls(1, pa.float32()) for n in names}, "error": pa.array([f"{type(exc).__name__}: {exc}"]), **given,
        }
    )


def read_daily_cache(spark: SparkSession, paths: list[str], tvar: str) -> DataFrame:
    """``(path, d, r, c, hi, t2, error)`` from daily caches of an earlier installation."""

    def run(batches):
        for batch in batches:
            for path, body in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    yield from _blocks(path, day_of(path), dict(zip(("hi", "t2"), decode_cache(path, body.as_py(), tvar))))
                except Exception as exc:  # noqa: BLE001  reported as a row
                    yield _failed(path, exc, None, ("hi", "t2"))

    return _files(spark, paths).select("path", "content").mapInArrow(run, CACHE_DDL)


def read_pairs(spark: SparkSession, pairs: DataFrame, glob: str = "*.zip") -> DataFrame:
    """``(path, d, r, c, t, td, error, kind, as_of)``: both rasters of a day, decoded in one task.

    ``pairs``: d, t_path, td_path and the times of the files; a day that lacks one of the two
    gives nothing. The files themselves are brought together by day, never their cells. A file
    that cannot be read gives a row with its kind and error.
    """
    paths = paths_of(pairs.select("t_path").unionByName(pairs.select(F.col("td_path").alias("t_path"))).where("t_path is not null").select(F.col("t_path").alias("path")))
    files = _files(spark, paths) if paths else spark.createDataFrame([], "path string, content binary, header binary")
    side = lambda k: files.toDF(f"{k}_path", f"{k}_body", f"{k}_header")
    both = pairs.join(side("t"), "t_path", "left").join(side("td"), "td_path", "left")
    columns = [f"{k}_{x}" for k in ("t", "td") for x in ("path", "body", "header", "modified")]

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                x = {c: batch.column(c)[row].as_py() for c in columns}
                images = {}
                for kind in ("t", "td"):
                    path = x[f"{kind}_path"]
                    if path is None:
                        continue
                    try:
                        images[kind] = decode_raster(path, x[f"{kind}_body"], x[f"{kind}_header"])
                    except Exception as exc:  # noqa: BLE001  reported as a row
                        yield _with_time(_failed(path, exc, kind, ("t", "td")), None)
                if len(images) < 2:
                    continue
                shape = [min(n) for n in zip(*(i.shape for i in images.values()))]
                parts = {k: i[: shape[0], : shape[1]] for k, i in images.items()}
                when = max(x["t_modified"], x["td_modified"])
                for block in _blocks(x["t_path"], day_of(x["t_path"]), parts):
                    named = pa.RecordBatch.from_arrays([*block.columns, pa.nulls(block.num_rows, pa.string())], names=[*block.schema.names, "kind"])
                    yield _with_time(named, when)

    return both.select(*columns).mapInArrow(run, PAIR_DDL)


def _with_time(batch: pa.RecordBatch, when: datetime | None) -> pa.RecordBatch:
    times = pa.array([when] * batch.num_rows, pa.timestamp("us", "UTC"))
    return pa.RecordBatch.from_arrays([*batch.columns, times], names=[*batch.schema.names, "as_of"])


def path_day() -> Column:
    """Day in the name of the file, also of one that could not be read."""
    name = F.regexp_extract(F.col("path"), "[^/]*$", 0)
    token = F.element_at(F.regexp_extract_all(name, F.lit(DATE_TOKEN), F.lit(1)), -1)
    return F.when(F.regexp_like(name, F.lit(DATE_TOKEN)), F.try_to_timestamp(token, F.lit("yyyyMMdd")).cast("date"))


def good_cells(df: DataFrame) -> DataFrame:
    return df.where("error is null").drop("path", "error", "kind")


def failures(df: DataFrame) -> DataFrame:
    return df.where("error is not null").select("path", "error")


def header_axes(header: dict[str, str]) -> tuple[tuple[int, float, float], tuple[int, float, float]]:
    """(n, outer edge, step) of rows and columns from a BIL header with cell centres."""
    dx, dy = float(header["XDIM"]), float(header["YDIM"])
    rows = (int(header["NROWS"]), float(header["ULYMAP"]) + dy / 2.0, -dy)
    cols = (int(header["NCOLS"]), float(header["ULXMAP"]) - dx / 2.0, dx)
    return rows, cols


def sample_header(spark: SparkSession, folder: str, glob: str) -> dict[str, str]:
    """Header of the first raster in name order that has one; files are small and tried one by one."""
    for path in sorted(paths_of(list_files(spark, folder, glob, "t"))):
        found = _files(spark, [path]).first()
        if found.header is not None:
            return bil_header(bytes(found.header).decode("ascii", "ignore"))
        try:
            with zipfile.ZipFile(io.BytesIO(bytes(found.content))) as z:
                name = next(n for n in sorted(z.namelist()) if n.lower().endswith(".hdr"))
                return bil_header(z.read(name).decode("ascii", "ignore"))
        except (zipfile.BadZipFile, StopIteration):
            continue
    raise ValueError(f"no raster with a header in {folder}")
