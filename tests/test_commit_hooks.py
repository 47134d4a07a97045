"""A sink that commits as a whole, and a source that replays from offsets."""

import json
import os
from collections import Counter

import pytest

from tidespan.sources import clip_sink
from tidespan.streaming import hooks

ROWS = "video string, clip string, start double, end double, content binary"


def test_clips_are_committed_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "out")
    clip_sink.register(spark)
    good = spark.createDataFrame([("v", f"c{i}.mp4", float(i), i + 1.0, bytearray([i]) * (2000 if i != 3 else 10)) for i in range(8)], ROWS).repartition(3)
    put = lambda df, job: df.write.format("clips").mode("append").option("job", job).save(path)
    put(good, "one")
    got = clip_sink.committed(spark, path).collect()
    assert sorted((r.job, r.start, r.bytes) for r in got) == [("one", float(i), 2000) for i in range(8) if i != 3]  # one is too small
    for r in got:
        with open(f"{path}/{r.clip}", "rb") as f:
            assert f.read() == bytes([int(r.start)]) * 2000
    put(good, "one")  # the same job again
    assert clip_sink.committed(spark, path).count() == 7
    bad = good.union(spark.createDataFrame([("v", "x.mp4", 9.0, 10.0, None)], ROWS))
    with pytest.raises(Exception, match="without content"):
        put(bad, "two")
    assert os.listdir(f"{path}/manifests") == ["one.json"] and clip_sink.committed(spark, path).count() == 7
    put(good.where("false"), "none")
    put(good.limit(1), "three")
    assert Counter(r.job for r in clip_sink.committed(spark, path).collect()) == {"one": 7, "three": 1}
    with pytest.raises(Exception, match="only appended"):
        good.write.format("clips").mode("overwrite").save(path)


def test_attempts_that_fail_or_run_twice_are_not_in_the_manifest(spark, tmp_path):
    writer = clip_sink.ClipWriter({"path": str(tmp_path), "job": "j", "least_bytes": "1"})
    rows = [{"video": "v", "clip": f"{i}", "start": 0.0, "end": 1.0, "content": b"abc"} for i in range(3)]

    def dies():
        yield rows[0]
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(dies())
    writer.write(iter(rows))  # a speculative copy that loses
    writer.commit([writer.write(iter(rows)), writer.write(iter([]))])
    assert len(os.listdir(tmp_path / "clips")) == 4
    assert sorted(r.clip[-1] for r in clip_sink.committed(spark, str(tmp_path)).collect()) == ["0", "1", "2"]
    lost = writer.write(iter(rows))
    writer.abort([lost, None])
    assert lost.folder not in os.listdir(tmp_path / "clips")


def call(i, kind="analysis", **more):
    return json.dumps({"kind": kind, "job_id": f"j{i}", "status": "done", "progress": i / 2, "payload": {"i": i}, "received_at": f"2024-05-01T00:00:{i % 60:02d}Z", **more}) + "\n"


def test_no_call_is_lost_or_doubled_over_restarts(spark, tmp_path):
    hooks.register(spark)
    at = tmp_path / "in"
    at.mkdir()

    def run():
        stream = spark.readStream.format("hooks").options(path=str(at), kinds="analysis,upload", part_bytes="300").load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return Counter(r.job_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) if os.path.exists(tmp_path / "out") else Counter()

    run()  # nothing there yet
    (at / "a.jsonl").write_text("".join(call(i) for i in range(20)) + "{broken\n[1]\n\n" + call(99, "other"))
    assert run() == Counter({f"j{i}": 1 for i in range(20)})
    assert run() == Counter({f"j{i}": 1 for i in range(20)})
    half = call(20, "upload", payload="x" * 5000)
    with open(at / "a.jsonl", "a") as f:
        f.write(half[:40])  # a line that is being written
    (at / "b.jsonl").write_text("".join(call(i) for i in range(30, 45)))
    assert run() == Counter({f"j{i}": 1 for i in [*range(20), *range(30, 45)]})
    with open(at / "a.jsonl", "a") as f:
        f.write(half[40:] + call(21))
    assert run() == Counter({f"j{i}": 1 for i in [*range(22), *range(30, 45)]})
    row = spark.read.parquet(str(tmp_path / "out")).where("job_id = 'j5'").first()
    assert (row.kind, row.progress, row.payload, row.received_at.second) == ("analysis", 2.5, '{"i": 5}', 5)


def test_a_batch_reads_the_same_however_it_is_cut(tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(call(i) for i in range(50)))
    whole = None
    for part in (7, 100, 10_000):
        reader = hooks.HookReader({"path": str(tmp_path), "part_bytes": str(part)})
        end = reader.latestOffset()
        got = [x for p in reader.partitions({}, end) for x in reader.read(p)]
        assert len(got) == 50 and (whole is None or got == whole)
        whole = got
