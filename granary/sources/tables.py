"""Tables of a folder, dealt out where their files are too few for the machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


DEALT_BYTES = 16 << 20  # of a table's files that a part holds at most when it is dealt out


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of few files has fewer scan tasks than there are cores, and work on long texts would wait for one of them: such
    a one is dealt out anew by its first column (round robin would sort it), in parts of a bounded size. Tables of at least a
    file for each core are left as they are."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(cores, -(-size // DEALT_BYTES)), df.columns[0])
