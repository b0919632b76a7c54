"""Pick up new day files and add their exceedances to the store.

The file stream's checkpoint remembers which files were taken, so a restarted or repeated run
handles only files that arrived since: the streaming counterpart of skipping cached days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from swelter.plans.build import CELLS, add_cells, build
from swelter.session import temporary_steps
from swelter.sources.store import Store

DAY_FILE_DDL = "d date, r int, c int, hi float, t2 float"


def watch_cell_days(
    store: Store, path: str, checkpoint: str, pcts: Sequence[float] = (80, 90, 95), max_files: int | None = None
) -> StreamingQuery:
    """Take all Parquet day files now in ``path``, then build once, and return the ended stream.

    Cells that are stored as they come change nothing, so a batch may be replayed after a failure,
    and a day may be spread over files and batches: the size of a batch does not change the
    result. Of different values for a cell those of the later file stay.
    """
    reader = store.spark.readStream.schema(DAY_FILE_DDL)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def take(batch: DataFrame, _epoch: int) -> None:
        with temporary_steps(store.spark):
            add_cells(store, batch)

    stream = (
        reader.parquet(path).select(*CELLS, F.col("_metadata.file_modification_time").alias("as_of"))
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    if store.exists("cell_day"):
        build(store, pcts)
    return stream
