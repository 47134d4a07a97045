"""Headers of MP4 files made byte by byte, and the streams that had no test."""

import struct

import pytest
from pyspark.sql import functions as F

from tidespan.sources import probe
from tidespan.streaming import streams


def box(name, *content, large=False):
    raw = b"".join(content)
    return struct.pack(">I4sQ", 1, name, 16 + len(raw)) + raw if large else struct.pack(">I4s", 8 + len(raw), name) + raw


def clock(name, rate, length, wide=False):
    return box(name, struct.pack(">IQQIQ", 1 << 24, 0, 0, rate, length) if wide else struct.pack(">IIIII", 0, 0, 0, rate, length), bytes(80))


def track(kind, rate, length, runs, width=0, height=0):
    stts = box(b"stts", struct.pack(">II", 0, len(runs)), *(struct.pack(">II", *r) for r in runs))
    hdlr = box(b"hdlr", bytes(8), kind, bytes(12))
    return box(b"trak", box(b"tkhd", bytes(76), struct.pack(">II", width << 16, height << 16)), box(b"mdia", clock(b"mdhd", rate, length), hdlr, box(b"minf", box(b"stbl", stts))))


def movie(*tracks, rate=1000, length=12_500, wide=False):
    return box(b"moov", clock(b"mvhd", rate, length, wide), *tracks)


def test_headers_wherever_they_are(spark, tmp_path):
    video, sound = track(b"vide", 30_000, 375_375, [(300, 1001), (75, 1001)], 1920, 1080), track(b"soun", 48_000, 600_000, [(586, 1024)])
    files = {
        "end": box(b"ftyp", b"isom") + box(b"mdat", bytes(50_000), large=True) + movie(sound, video),
        "start": movie(video, wide=True) + box(b"mdat", bytes(1000)),
        "last": box(b"free") + struct.pack(">I4s", 0, b"moov") + movie(sound)[8:],  # a box up to the end of the file
        "cut": (box(b"mdat", bytes(100)) + movie(video))[:-40],
        "none": b"",
        "other": bytes(range(200)),
        "still": movie(rate=0),
    }
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    rows = [(name, str(tmp_path / name)) for name in [*files, "missing"]] + [("null", None)]
    got = {r.duration_name: (r.duration, r.fps and round(r.fps, 3), r.width, r.height) for r in probe.durations(spark.createDataFrame(rows, "duration_name string, path string")).collect()}
    want = (12.5, 29.97, 1920, 1080)
    nothing = (None,) * 4
    assert got == {"end": want, "start": want, "last": (12.5, None, None, None), "cut": nothing, "none": nothing, "other": nothing, "still": nothing, "missing": nothing, "null": nothing}
    assert probe.durations(spark.createDataFrame([], "path string, fps int")).count() == 0


def test_a_large_file_costs_a_few_reads():
    raw = box(b"mdat", bytes(3_000_000)) + movie(track(b"vide", 600, 6000, [(240, 25)], 8, 8))
    read = []

    def at(n, i):
        read.append(n)
        return raw[i : i + n]

    assert probe.header(at, len(raw)) == {"duration": 12.5, "fps": 24.0, "width": 8, "height": 8} and sum(read) < 2000


def test_job_loop_and_stream_limiter(spark, tmp_path):
    d = spark.createDataFrame([("u", t) for t in (0, 1, 2, 10, 11, 12)], "u string, t long")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    streams.job_loop(stream, lambda batch, i: seen.extend(r.t for r in batch.collect()), str(tmp_path / "a")).awaitTermination()
    streams.job_loop(stream, lambda batch, i: seen.extend(r.t for r in batch.collect()), str(tmp_path / "a")).awaitTermination()  # nothing new
    assert sorted(seen) == [0, 1, 2, 10, 11, 12]
    q = streams.rate_limited_stream(stream, "u", "t", 2, 10).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.allowed for r in spark.table("limited").orderBy("t").collect()] == [True, True, False, False, True, True]
