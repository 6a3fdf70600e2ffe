"""Live frames from an append-only log of Parquet files, as a Spark data source.

Cameras (or a replayed recording) append batches of frames to numbered folders of a log in
shared storage; the files of a folder are in time order. The source releases whole files in
the order of their paths. Its offset is the last path released, so a replayed batch reads the
files it read before, and no offset grows with the log. ``framesPerTrigger`` bounds what one
trigger releases (a file at the least).

Spark does not tell a Python source where a restarted query stands before it asks for the
latest offset. The source therefore notes what it releases, before it says so, under
``progress``: a restart goes on from there and never back.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from wakeline.streaming.monitor import INPUT

#: Spark numbers the files of a write with five digits; more would not sort by name.
MOST_FILES = 99_999
_DONE = "_SUCCESS"


def append_frames(frames: DataFrame, log: str, number: int, files: int = 8, ts: str = "ts") -> None:
    """Append a batch of frames as folder ``number`` of a log, cut by time into ``files``."""
    if not 0 < files <= MOST_FILES:
        raise ValueError(f"a folder of a log holds 1 to {MOST_FILES} files, not {files}")
    placed = frames.repartitionByRange(files, ts).sortWithinPartitions(ts)
    placed.write.mode("errorifexists").parquet(f"{log}/{number:012d}")


class FramePart(InputPartition):
    """One row group of a file of the log."""

    def __init__(self, path: str, group: int):
        super().__init__((path, group))


class CameraLogReader(DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: Mapping[str, str]):
        self.schema = schema
        self.log = options["path"].rstrip("/")
        self.most = int(options.get("framesPerTrigger", 0))
        self.progress = options.get("progress")
        if self.most and not self.progress:
            raise ValueError("framesPerTrigger needs a progress file")
        self.after: str | None = None

    def _released(self) -> str:
        if not self.progress:
            return ""
        files, path = fs.FileSystem.from_uri(self.progress)
        if files.get_file_info(path).type != fs.FileType.File:
            return ""
        with files.open_input_stream(path) as f:
            return json.loads(f.read())["after"]

    def _note(self, after: str) -> None:
        if self.progress:
            files, path = fs.FileSystem.from_uri(self.progress)
            files.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with files.open_output_stream(f"{path}.next") as f:
                f.write(json.dumps({"after": after}).encode())
            files.move(f"{path}.next", path)

    def _files(self, after: str) -> tuple[fs.FileSystem, str, list[str]]:
        """Files later than ``after`` in folders that are complete, by their paths in the log.

        A folder is not passed before it is complete, nor are those behind it.
        """
        files, root = fs.FileSystem.from_uri(self.log)
        found: list[str] = []
        folders = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        for folder in sorted(i.path for i in folders if i.type == fs.FileType.Directory):
            name = folder.rsplit("/", 1)[1]
            if name < after.split("/", 1)[0]:
                continue
            inside = [i.path.rsplit("/", 1)[1] for i in files.get_file_info(fs.FileSelector(folder))]
            if _DONE not in inside:
                break
            found += sorted(f"{name}/{f}" for f in inside if f.endswith(".parquet") and f"{name}/{f}" > after)
        return files, root, found

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        if self.after is None:
            self.after = self._released()
        files, root, waiting = self._files(self.after)
        frames, before = 0, self.after
        for path in waiting:
            if self.most:
                rows = pq.read_metadata(f"{root}/{path}", filesystem=files).num_rows
                if frames and frames + rows > self.most:
                    break
                frames += rows
            self.after = path
        if self.after != before:
            self._note(self.after)
        return {"after": self.after}

    def partitions(self, start: dict, end: dict) -> list[FramePart]:
        self.after = max(self.after or "", end["after"])
        if start["after"] == end["after"]:
            return []
        files, root, paths = self._files(start["after"])
        if end["after"] not in paths:
            raise FileNotFoundError(f"{self.log}/{end['after']} was released, but the log no longer has it")
        return [
            FramePart(path, group)
            for path in paths
            if path <= end["after"]
            for group in range(pq.read_metadata(f"{root}/{path}", filesystem=files).num_row_groups)
        ]

    def read(self, partition: FramePart) -> Iterator[pa.RecordBatch]:
        path, group = partition.value
        files, root = fs.FileSystem.from_uri(self.log)
        schema = to_arrow_schema(self.schema)
        with pq.ParquetFile(f"{root}/{path}", filesystem=files, coerce_int96_timestamp_unit="us") as f:
            for batch in f.iter_batches(row_groups=[group], columns=schema.names):
                columns = [_as(batch.column(field.name), field.type) for field in schema]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _as(column: pa.Array, kind: pa.DataType) -> pa.Array:
    if pa.types.is_timestamp(column.type) and column.type.tz is None:
        column = column.cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC"))
    return column.cast(kind)


class CameraLog(DataSource):
    """Format ``camera_log``."""

    @classmethod
    def name(cls) -> str:
        return "camera_log"

    def schema(self) -> T.StructType:
        return INPUT

    def streamReader(self, schema: T.StructType) -> CameraLogReader:
        return CameraLogReader(schema, self.options)


def camera_log_stream(spark: SparkSession, log: str, frames_per_trigger: int | None = None, progress: str | None = None) -> DataFrame:
    """Frames of a log as a stream. ``log`` and ``progress`` are URIs or absolute paths that
    driver and executors can open; a rate limit needs a ``progress`` file of the query's own.

    Needs a trigger that goes on (processing time): Spark asks a Python source for one offset
    only under ``availableNow``.
    """
    spark.dataSource.register(CameraLog)
    reader = spark.readStream.format("camera_log").option("path", log)
    if frames_per_trigger is not None:
        if frames_per_trigger < 1:
            raise ValueError("a trigger must let frames through")
        reader = reader.option("framesPerTrigger", str(frames_per_trigger))
    if progress is not None:
        reader = reader.option("progress", progress)
    return reader.load().select([F.col(f.name) for f in INPUT.fields])
