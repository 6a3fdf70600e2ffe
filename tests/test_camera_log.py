import datetime as dt
import json
import tempfile

import pytest
from pyspark.errors import StreamingQueryException

from wakeline.streaming import camera_log
from wakeline.streaming.monitor import INPUT

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def frames(spark, first, n):
    rows = [
        (f"s{i % 3}", START + dt.timedelta(milliseconds=i), i, i % 4 > 0, [i / 7, None], None if i % 2 else [0.5, 0.5], "front", 0.01)
        for i in range(first, first + n)
    ]
    return spark.createDataFrame(rows, INPUT), rows


def reader(log, **options):
    return camera_log.CameraLogReader(INPUT, {"path": log, **options})


def run(spark, folder, seen, most, fail_at=None):
    def keep(batch, number):
        rows = sorted(tuple(r) for r in batch.select("frame", "session", "has_face", "features", "probabilities").collect())
        seen.setdefault(number, []).append(rows)
        if number == fail_at:
            raise RuntimeError("stopped")

    stream = camera_log.camera_log_stream(spark, f"{folder}/log", most, f"{folder}/state/progress")
    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_stream_resumes_replays_and_keeps_its_rate(spark):
    folder = tempfile.mkdtemp(prefix="camera-")
    table, rows = frames(spark, 0, 90)
    camera_log.append_frames(table, f"{folder}/log", 0, files=6)
    seen = {}
    with pytest.raises(StreamingQueryException):
        run(spark, folder, seen, 40, fail_at=1)
    failed = max(seen)
    more, later = frames(spark, 90, 30)
    camera_log.append_frames(more, f"{folder}/log", 1, files=2)
    run(spark, folder, seen, 40)
    assert seen[failed][0] == seen[failed][-1] and len(seen[failed]) == 2  # replayed as it was
    assert all(len(again[-1]) <= 80 for again in seen.values()) and len(seen) >= 3
    got = [r for number in sorted(seen) for r in seen[number][-1]]
    assert got == sorted((r[2], r[0], r[3], r[4], r[5]) for r in rows + later)
    run(spark, folder, seen, 40)
    assert [r for number in sorted(seen) for r in seen[number][-1]] == got


def test_offsets_move_by_whole_files_and_never_back(spark):
    folder = tempfile.mkdtemp(prefix="camera-")
    log, progress = f"{folder}/log", f"{folder}/progress"
    empty = reader(log)
    assert empty.latestOffset() == empty.initialOffset() == {"after": ""}
    camera_log.append_frames(frames(spark, 0, 60)[0], log, 0, files=3)
    one = reader(log, framesPerTrigger="1", progress=progress)
    offsets = [one.initialOffset(), *(one.latestOffset() for _ in range(5))]
    names = [o["after"] for o in offsets]
    assert names == sorted(names) and len(set(names)) == 4 and names[-1] == names[-2]
    for a, b in zip(offsets[:3], offsets[1:]):
        assert len(one.partitions(a, b)) == 1
    assert one.partitions(offsets[3], offsets[4]) == []
    assert sum(b.num_rows for p in one.partitions(offsets[0], offsets[3]) for b in one.read(p)) == 60
    assert json.load(open(progress)) == offsets[-1]
    assert reader(log, framesPerTrigger="1", progress=progress).latestOffset() == offsets[-1]
    assert reader(log).latestOffset() == offsets[-1]


def test_folders_wait_until_they_are_complete(spark):
    folder = tempfile.mkdtemp(prefix="camera-")
    for number in range(2):
        camera_log.append_frames(frames(spark, 10 * number, 10)[0], folder, number, files=1)
    log = reader(folder)
    mark = f"{folder}/{0:012d}/_SUCCESS"
    import os

    os.rename(mark, f"{mark}.later")
    assert log.latestOffset() == {"after": ""}
    os.rename(f"{mark}.later", mark)
    assert log.latestOffset()["after"].startswith(f"{1:012d}/")
    with pytest.raises(FileNotFoundError):
        log.partitions({"after": ""}, {"after": f"{5:012d}/part"})


def test_parameters(spark):
    with pytest.raises(ValueError):
        reader("/nowhere", framesPerTrigger="5")
    with pytest.raises(ValueError):
        camera_log.camera_log_stream(spark, "/nowhere", 0)
    with pytest.raises(ValueError):
        camera_log.append_frames(frames(spark, 0, 1)[0], "/nowhere", 0, files=0)
