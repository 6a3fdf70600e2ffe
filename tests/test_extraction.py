"""Extraction that is stopped and run again."""

import pytest
from pyspark.errors import StreamingQueryException

from wakeline.streaming import extraction


def manifest(spark, folder, *files):
    for rows in files:
        spark.createDataFrame([(r,) for r in rows], "sample_id string").coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return spark.readStream.schema("sample_id string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/manifest")


def test_a_stopped_run_goes_on_where_it_was(spark, tmp_path):
    stream = manifest(spark, tmp_path, ["a", "b"], ["c"], ["d", "e"])
    taken, limit = [], [2]

    def process(batch):
        names = sorted(r.sample_id for r in batch.collect())
        if len(taken) == limit[0]:
            raise RuntimeError("power is out")
        taken.append(names)
        return batch.selectExpr("sample_id", "length(sample_id) AS n")

    with pytest.raises(StreamingQueryException):
        extraction.extract(stream, f"{tmp_path}/run", process)
    schema = spark.createDataFrame([], "sample_id string, n int").schema
    assert extraction.extracted(spark, f"{tmp_path}/run", schema).count() == sum(map(len, taken)) == 3
    # Rows without an entry in the ledger are those of an unfinished batch.
    spark.createDataFrame([("stray", 5)], schema).write.parquet(f"{tmp_path}/run/rows/batch=77")
    limit[0] = 99
    extraction.extract(stream, f"{tmp_path}/run", process)
    rows = extraction.extracted(spark, f"{tmp_path}/run", schema).collect()
    assert sorted(r.sample_id for r in rows) == ["a", "b", "c", "d", "e"]
    assert sorted(sum(taken, [])) == ["a", "b", "c", "d", "e"]
    # A file that arrives later is all the next run takes.
    extraction.extract(manifest(spark, tmp_path, ["f"]), f"{tmp_path}/run", process)
    assert taken[-1] == ["f"] and extraction.extracted(spark, f"{tmp_path}/run", schema).count() == 6


@pytest.mark.parametrize("files", [(["a", "a"],), (["a"], ["b"], ["a"])])
def test_samples_listed_twice_are_an_error(spark, tmp_path, files):
    stream = manifest(spark, tmp_path, *files)
    with pytest.raises(StreamingQueryException, match="listed more than once"):
        extraction.extract(stream, f"{tmp_path}/run", lambda batch: batch)
