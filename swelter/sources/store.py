"""Where a project keeps its tables: one folder per table, Parquet, partitioned by what jobs filter on.

Everything is kept apart by the temperature variable it was built from (``tvar``), so thresholds
of one variable can never be applied to another.

A table is what its pointer names: a small file that lists, for every partition, the folders with
its rows. A write puts its rows into new folders (``_v=<version>`` in the partition) and then
replaces the pointer, so a run that dies at any place leaves the table as it was, and a reader never
sees half a write. What a pointer no longer names is removed by the write after the next one, when
plans made from it have ended. One writer at a time per table.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swelter.params import GridShape
from swelter.session import delete_path
from swelter.sources.tables import rebalanced

PARTITIONS = {
    "cell_day": ["year", "month"],
    "threshold": ["measure", "pct", "month"],
    "mag": ["measure", "pct", "year", "month"],
    "mag_calendar": ["measure", "pct"],
    "calendar": [],
    "source_file": [],
    "axis_row": [],
    "axis_col": [],
    "seg_day": ["measure", "pct", "year"],
    "seg_cluster": ["measure", "pct", "year"],
    "seg_run": ["measure", "pct", "year"],
    "seg_calendar": ["measure", "pct"],
    "event_merge": ["measure", "pct"],
    "hw_day": ["measure", "pct"],
    "excd": ["measure", "pct", "year"],
    "cluster_event": ["measure", "pct"],
    "event_summary": ["measure", "pct"],
    "exposure": ["pct"],
}
SORT = {"cell_day": ["d", "r", "c"], "mag": ["r", "c", "d"], "threshold": ["r", "c"], "excd": ["r", "c", "d"]}
VERSION = "_v"
#: Folders of one partition at which an addition rewrites it as one.
MOST_FOLDERS = 16


def _with_parts(df: DataFrame, by: list[str]) -> DataFrame:
    for part, source in (("year", F.year), ("month", F.month)):
        if part in by and part not in df.columns:
            df = df.withColumn(part, source("d"))
    return df


def of_series(series: Sequence[tuple[str, float]]) -> Callable[[str], bool]:
    """Whether a partition belongs to one of the (measure, percentile) series."""
    heads = tuple(f"measure={m}/pct={float(p)}" for m, p in series)
    return lambda part: part.startswith(tuple(f"{h}/" for h in heads)) or part in heads


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str
    tvar: str = "tmax"

    def path(self, name: str) -> str:
        return f"{self.root}/tvar={self.tvar}/{name}"

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    # --- tables ---

    def pointer(self, name: str) -> dict | None:
        """schema, parts (partition: versions, the oldest first) and old (folders of the pointer before)."""
        found = self.load_manifest(f"table_{name}")
        if found is None:
            fs, target = self._fs(self.path(name))
            if fs.exists(target) and not self._folders(name):
                raise ValueError(f"{self.path(name)} has no pointer: it was written by an older version; build it again in a new folder")
        return found

    def exists(self, name: str) -> bool:
        return self.pointer(name) is not None

    def read(self, name: str, keep: Callable[[str], bool] | None = None) -> DataFrame:
        """The rows that the pointer names; ``keep`` picks partitions by their path."""
        found = self.pointer(name)
        if found is None:
            raise FileNotFoundError(self.path(name))
        schema = T.StructType.fromJson(found["schema"])
        paths = [
            "/".join(x for x in (self.path(name), part, f"{VERSION}={v}") if x)
            for part, versions in sorted(found["parts"].items()) if keep is None or keep(part) for v in versions
        ]
        if not paths:
            return self.spark.createDataFrame([], schema)
        whole = T.StructType([*schema.fields, T.StructField(VERSION, T.StringType())])
        df = self.spark.read.schema(whole).option("basePath", self.path(name)).parquet(*paths)
        return df.select(*[f.name for f in schema.fields])

    def write(self, name: str, df: DataFrame, drop: Callable[[str], bool] | None = None) -> None:
        """Replace the partitions that ``df`` contains and those that ``drop`` picks, in one step."""
        self._commit(name, df, drop or (lambda part: False), add=False)

    def replace(self, name: str, df: DataFrame) -> None:
        """Replace the whole table."""
        self._commit(name, df, lambda part: True, add=False)

    def replace_series(self, name: str, df: DataFrame, series: Sequence[tuple[str, float]]) -> None:
        """Replace all rows of these (measure, percentile) series, also by none."""
        self.write(name, df, of_series(series))

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows that are not there yet."""
        crowded = self._commit(name, df, lambda part: False, add=True)
        if crowded:
            self.write(name, self.read(name, crowded.__contains__))

    def _folders(self, name: str) -> list[str]:
        """All folders of rows below a table, named or not, relative to it."""
        fs, base = self._fs(self.path(name))
        pattern = "/".join([self.path(name), *["*"] * len(PARTITIONS[name]), f"{VERSION}=*"])
        head = len(str(fs.makeQualified(base))) + 1
        return [str(fs.makeQualified(x.getPath()))[head:] for x in fs.globStatus(self._fs(pattern)[1]) or []]

    def _commit(self, name: str, df: DataFrame, drop: Callable[[str], bool], add: bool) -> list[str]:
        """Write the rows, then the pointer, then remove what neither it nor the one before names.
        Returns the partitions with too many folders."""
        by = PARTITIONS[name]
        df = _with_parts(df, by)
        held = self.pointer(name) or {"parts": {}, "old": []}
        version = f"{time.time_ns():020d}x{uuid.uuid4().hex[:8]}"
        out = rebalanced(df, by, SORT.get(name, ())) if by else df.coalesce(1)
        out.withColumn(VERSION, F.lit(version)).write.mode("append").partitionBy(*by, VERSION).parquet(self.path(name))

        folders = self._folders(name)
        mine = [f.rpartition("/")[0] for f in folders if f.endswith(f"{VERSION}={version}")]
        parts = {p: v for p, v in held["parts"].items() if not drop(p)}
        for part in mine:
            parts[part] = [*(parts.get(part, []) if add else []), version]
        fields = [f for f in df.schema if f.name not in by] + [df.schema[p] for p in by]
        schema = json.loads(T.StructType([T.StructField(f.name, f.dataType) for f in fields]).json())
        named = lambda parts: {"/".join(x for x in (p, f"{VERSION}={v}") if x) for p, vs in parts.items() for v in vs}
        live = named(parts)
        self.save_manifest(f"table_{name}", {"schema": schema, "parts": parts, "old": sorted(named(held["parts"]) - live)})
        for folder in set(folders) - live - named(held["parts"]):
            delete_path(self.spark, f"{self.path(name)}/{folder}")
        return [p for p in mine if len(parts[p]) > MOST_FOLDERS]

    def write_axes(self, rows: DataFrame, cols: DataFrame) -> None:
        for name, axis in (("axis_row", rows), ("axis_col", cols)):
            self.replace(name, axis)
    def axes(self) -> tuple[DataFrame, DataFrame]:
        return self.read("axis_row"), self.read("axis_col")

    def shape(self) -> GridShape:
        rows, cols = self.axes()
        return GridShape(rows.count(), cols.count())

    # --- manifests: which parameters a product was made with ---

    def _manifest(self, name: str) -> str:
        return self.path(f"_manifest/{name}")

    def _versions(self, name: str) -> list[str]:
        """Files of a manifest, the newest first."""
        fs, target = self._fs(self._manifest(name))
        found = [str(x.getPath()) for x in fs.listStatus(target)] if fs.exists(target) else []
        return sorted((p for p in found if p.endswith(".json")), reverse=True)

    def save_manifest(self, name: str, params: dict) -> None:
        """A new version beside the old one, which goes only when the new one is complete."""
        old = self._versions(name)
        base = f"{self._manifest(name)}/{time.time_ns():020d}"
        fs, part = self._fs(f"{base}.part")
        out = fs.create(part)
        out.write(bytearray(json.dumps(params, sort_keys=True, default=str).encode()))
        out.close()
        fs.rename(part, self._fs(f"{base}.json")[1])
        for path in old:
            delete_path(self.spark, path)

    def load_manifest(self, name: str) -> dict | None:
        """Parameters of the stored product, or None when there are none or they are unreadable."""
        for path in self._versions(name)[:1]:
            fs, target = self._fs(path)
            stream = fs.open(target)
            try:
                return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except (ValueError, Py4JJavaError):
                return None
            finally:
                stream.close()
        return None

    def drop_manifest(self, name: str) -> None:
        delete_path(self.spark, self._manifest(name))

    def is_current(self, name: str, params: dict) -> bool:
        return self.load_manifest(name) == json.loads(json.dumps(params, default=str))
