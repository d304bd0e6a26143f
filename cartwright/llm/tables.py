"""Reading the tables and walking Arrow batches in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cartwright.session import use_local_folder

#: Rows of text handled at once inside a task.
ROWS = 256
#: Bytes of text handled at once inside a task; a longer single text is one piece.
BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_local_folder(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(
    batches: Iterator[pa.RecordBatch], rows: int = ROWS, size: int = BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and about ``size`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        each = max(1, batch.nbytes // batch.num_rows)
        step = max(1, min(rows, size // each))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
