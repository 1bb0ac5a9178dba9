"""Row chunks given to a function, in partitions or as a stream of files; presets for both."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class Preset:
    chunk_rows: int
    memory_mb: int
    threads: int | None


# Chunk rows, megabytes and threads of the presets (fixed values); no number of threads means all.
PRESETS = {"default": Preset(1000, 512, None), "small": Preset(500, 256, 4), "minimal": Preset(100, 128, 1), "large": Preset(2000, 1024, None)}
# The same for page-wise documents: megabytes from which a file is streamed.
PDF_PRESETS = {"small": 128, "large": 512, "layout_critical": 1024}


def apply_preset(spark: SparkSession, preset: Preset) -> None:
    """Batches of the chunk's size for the Python workers of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(preset.chunk_rows))


def each_chunk(df: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str, fail_fast: bool = True, failed: Callable[[pd.DataFrame, Exception], pd.DataFrame] | None = None) -> DataFrame:
    """`work` on each batch of rows.  With `fail_fast` its first error fails the query.  Otherwise `failed` makes the rows that
    stand for a batch whose work fails; without it such a batch is left out, as a row of its error cannot have the schema."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield work(batch)
            except Exception as e:
                if fail_fast and failed is None:
                    raise
                if failed is not None:
                    yield failed(batch, e)

    return df.mapInPandas(run, schema)


def folder_stream(spark: SparkSession, folder: str, schema: T.StructType, files: int = 10) -> DataFrame:
    """New Parquet files of a folder as a stream, `files` of them a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
