"""Clip sinks as plans: which clips to cut, the command of each, what came of it, and the ordered lists that join them.

Plans are ordinary rows, so they can be written, checked or run anywhere; ``cut`` runs them where the rows are.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import intervals, select

#: Seconds of output, bytes below which a clip counts as failed, clips of a batch, frame rate and size of clips to be joined.
MOST_SECONDS = 120.0
LEAST_BYTES = 1000
BATCH = 5
FPS, WIDTH, HEIGHT = 30, 1920, 1080


def plan(segments: DataFrame, key: str, source: str, folder: str, most=MOST_SECONDS, duration: str | None = None, tie: list[str] | None = None) -> DataFrame:
    """Segments in order of start, bounded by ``duration`` and by ``most`` in all: adds ordinal (from 0), batch, seconds, clip and timeout."""
    x = intervals.clamp(segments, duration) if duration else segments
    x = intervals.cap_total(x, key, most, tie=tie)
    w = Window.partitionBy(key).orderBy("start", *(tie or ["end"]))
    x = x.withColumn("ordinal", F.row_number().over(w) - 1).withColumn("batch", F.floor(F.col("ordinal") / BATCH).cast("int"))
    seconds = F.col("end") - F.col("start")
    stem = F.regexp_replace(F.element_at(F.split(source, r"[/\\]"), -1), r"\.[^.]*$", "")
    clip = F.concat_ws("/", F.lit(folder), F.concat(stem, F.lit("_clips")), scalar.clip_name("clip_", F.col("ordinal")))
    return x.withColumn("seconds", seconds).withColumn("clip", clip).withColumn("timeout", scalar.extraction_timeout(seconds))


def _args(*parts) -> Column:
    return F.array(*(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))


def copy_args(source: Column, start: Column, end: Column, clip: Column) -> Column:
    """Cut without encoding; a missing start is 0."""
    return _args("-ss", F.coalesce(start, F.lit(0.0)), "-to", end, "-i", source, "-c", "copy", "-avoid_negative_ts", "make_zero", "-y", clip)


#: The encoder's options of a first attempt, of a second one, and of joined clips.
FIRST = ("-c:v", "libx264", "-preset", "ultrafast", "-tune", "fastdecode", "-crf", "28", "-c:a", "aac", "-b:a", "96k", "-avoid_negative_ts", "make_zero")
SECOND = ("-c:v", "libx264", "-preset", "veryfast", "-crf", "28", "-c:a", "aac", "-b:a", "96k", "-avoid_negative_ts", "make_zero")
JOINED = ("-c:v", "libx264", "-preset", "fast", "-crf", "23", "-c:a", "aac", "-b:a", "128k", "-avoid_negative_ts", "make_zero")


def encode_args(source: Column, start: Column, end: Column, clip: Column, options: tuple[str, ...] = FIRST) -> Column:
    """Cut and encode; ``SECOND`` are the options of another attempt."""
    begin = F.coalesce(start, F.lit(0.0))
    return _args("-i", source, "-ss", begin, "-t", end - begin, *options, "-y", clip)


def second_timeout(seconds: Column) -> Column:
    """Of the second attempt: three times the length, two minutes at least."""
    return F.greatest(F.lit(120), F.floor(seconds * 3).cast("int"))


def list_args(listing: Column, output: Column) -> Column:
    """Join the clips of a concat list without encoding."""
    return _args("-f", "concat", "-safe", 0, "-i", listing, "-c", "copy", "-y", output)


def graph_args(clips: Column, output: Column) -> Column:
    """Join clips by a filter graph, for those that a list can't join: each starts at 0, pictures and sound are joined apart."""
    at = F.sequence(F.lit(0), F.size(clips) - 1)
    each = lambda form: F.transform(at, lambda i: F.format_string(form, *[i] * form.count("%d")))
    parts = F.array_join(each("[%d:v]setpts=PTS-STARTPTS[v%d];[%d:a]asetpts=PTS-STARTPTS[a%d]"), ";")
    joined = lambda kind, tail: F.concat(F.array_join(each(f"[{kind}%d]"), ""), F.format_string(tail, F.size(clips)))
    graph = F.concat_ws(";", parts, joined("v", "concat=n=%d:v=1:a=0[outv]"), joined("a", "concat=n=%d:v=0:a=1[outa]"))
    inputs = F.flatten(F.transform(clips, lambda c: F.array(F.lit("-i"), c)))
    return F.concat(inputs, _args("-filter_complex", graph, "-map", "[outv]", "-map", "[outa]", *JOINED, "-y", output))


#: Fixed value: the filter that brings clips to one rate and shape.
UNIFORM = "fps={fps},scale={width}:{height}:force_original_aspect_ratio=decrease,pad={width}:{height}:(ow-iw)/2:(oh-ih)/2"


def uniform_args(source: Column, clip: Column, fps: int = FPS, width: int = WIDTH, height: int = HEIGHT) -> Column:
    """One frame rate and size for clips to be joined, bars where the shape differs."""
    return _args("-i", source, "-vf", UNIFORM.format(fps=fps, width=width, height=height), "-c:v", "libx264", "-c:a", "aac", "-y", clip)


def still_args(source: Column, at: Column, image: Column) -> Column:
    return _args("-ss", at, "-i", source, "-frames:v", 1, "-y", image)


def run_command(args: list[str], timeout: float) -> int:
    """Runs the encoder; the size of its output (the last argument)."""
    subprocess.run(["ffmpeg", *args], capture_output=True, check=True, timeout=timeout)
    return os.path.getsize(args[-1])


def cut(planned: DataFrame, attempts: dict[str, Column], run: Callable[[list[str], float], int] = run_command, least: int = LEAST_BYTES) -> DataFrame:
    """Adds done (the name of the first attempt that made more than ``least`` bytes, null if all failed) and bytes.

    Rows run where they are, one after the other in each task; a task that is repeated overwrites its clips.  Clips go to a folder that all executors share.
    """
    names = list(attempts)
    x = planned.select("*", F.array(*attempts.values()).alias("__args"))
    schema = planned.select("*", F.lit(None).cast("string").alias("done"), F.lit(None).cast("long").alias("bytes")).schema

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done, size = [], []
            for args, timeout in zip(b.pop("__args"), b["timeout"]):
                got = (None, None)
                for name, a in zip(names, args):
                    try:
                        n = run(list(a), float(timeout))
                    except (OSError, subprocess.SubprocessError):
                        continue
                    if n > least:
                        got = (name, n)
                        break
                done.append(got[0])
                size.append(got[1])
            yield b.assign(done=pd.Series(done, b.index, "object"), bytes=pd.array(size, "Int64"))

    return x.mapInPandas(work, schema)


def outcomes(cut_rows: DataFrame, key: str) -> DataFrame:
    """Clips made and failed, seconds and megabytes of each key."""
    ok = F.col("done").isNotNull()
    return cut_rows.groupBy(key).agg(F.count_if(ok).alias("made"), F.count_if(~ok).alias("failed"), F.sum(F.when(ok, F.col("seconds"))).alias("seconds"), (F.sum("bytes") / (1024 * 1024)).alias("megabytes"))


def join_list(cut_rows: DataFrame, key: str) -> DataFrame:
    """The lines of each key's concat list, in order, of the clips that were made."""
    x = cut_rows.where(F.col("done").isNotNull()).withColumn("line", scalar.concat_entry(F.col("clip")))
    return select.ordered_manifest(x, key, "ordinal", "line", "lines")
