"""Resumable extraction: samples of a manifest are processed once, however often a run stops.

The manifest is a stream of files, taken a batch at a time. A batch's rows are written under
its number and then its samples are entered in a ledger under the same number. A run that
stops in between leaves rows the ledger does not know; the batch is taken again, overwrites
them, and only rows of batches in the ledger are read. Samples in the ledger are never
processed again, and manifest files that arrive later are all a later run takes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ledger(spark: SparkSession, folder: str, sample: str, kind: T.DataType) -> DataFrame:
    """Finished samples and the batch each was finished in."""
    schema = T.StructType([T.StructField(sample, kind), T.StructField("batch", T.LongType())])
    try:
        return spark.read.schema(schema).parquet(f"{folder}/ledger")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def extract(
    manifest: DataFrame,
    folder: str,
    process: Callable[[DataFrame], DataFrame],
    sample: str = "sample_id",
) -> None:
    """Process what the manifest stream holds and previous runs have not finished.

    ``process`` maps a batch of the manifest to its output rows. A sample that is listed twice,
    in one batch or in two, is an error and stops the run.
    """
    spark, kind = manifest.sparkSession, manifest.schema[sample].dataType

    def finish(batch: DataFrame, number: int) -> None:
        names = batch.select(sample)
        finished = ledger(spark, folder, sample, kind).where(F.col("batch") != number)
        twice = names.groupBy(sample).count().where("count > 1").select(sample)
        again = twice.unionByName(names.join(finished, sample, "left_semi")).first()
        if again is not None:
            raise ValueError(f"sample {again[0]!r} is listed more than once")
        process(batch).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        names.write.mode("overwrite").parquet(f"{folder}/ledger/batch={number}")

    writer = manifest.writeStream.foreachBatch(finish).option("checkpointLocation", f"{folder}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()


def extracted(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Output rows of all finished batches."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/rows")
    # One row for each batch.
    done = spark.read.parquet(f"{folder}/ledger").select(F.col("batch").cast("bigint").alias("_done")).distinct()
    return rows.join(done, F.col("batch") == F.col("_done"), "left_semi").drop("batch")
