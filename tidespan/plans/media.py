"""Queries of whole chains: frames to movement segments, candidates to seeds, models by batch, clips and jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models, scalar
from ..operators import jobs
from ..sources import clip_sink, clips, frames, scratch, tables
from . import pipelines

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _byte(i):
    return F.floor(F.abs(F.get("embedding", i).cast("double")) * 1000).cast("int") % 256


BYTES = "list_transform(embedding, lambda x: cast(floor(abs(cast(x as double)) * 1000) as integer) % 256)"

#: Vectors of a video; what must change in a cell and the share of cells of a frame.
CLIP, CHANGE, SHARE = 60, 6, 0.3
#: Of two cells in a row, the weights of a cell and of its neighbour in a blur of fifteen taps.
_TAPS = [2.718281828459045 ** (-((i - 7) ** 2) / (2 * 2.6**2)) for i in range(15)]
SAME, OTHER = (sum(_TAPS[i] for i in range(15) if (i - 7) % 2 == k) / sum(_TAPS) for k in (0, 1))


@query(f"""with b as (select vec_id, vec_id // {CLIP} as video, vec_id % {CLIP} as i, {BYTES} as p from embeddings where len(embedding) = 64),
 g as (select *, list_transform(range(0, 64), lambda j: cast(round(p[j + 1] * 0.114::double + p[(j + 1) % 64 + 1] * 0.587::double + p[(j + 2) % 64 + 1] * 0.299::double) as integer)) as g from b),
 q as (select video, i, list_transform([9, 13, 41, 45], lambda a: cast(round((g[a + 1] + g[a + 2] + g[a + 9] + g[a + 10]) / 4.0::double) as integer)) as q from g),
 h as (select video, i, [{SAME}::double * q[1] + {OTHER}::double * q[3], {SAME}::double * q[2] + {OTHER}::double * q[4], {SAME}::double * q[3] + {OTHER}::double * q[1], {SAME}::double * q[4] + {OTHER}::double * q[2]] as h from q),
 s as (select video, i, list_transform([h[1] * {SAME}::double + h[2] * {OTHER}::double, h[2] * {SAME}::double + h[1] * {OTHER}::double, h[3] * {SAME}::double + h[4] * {OTHER}::double, h[4] * {SAME}::double + h[3] * {OTHER}::double], lambda x: cast(round_even(x, 0) as integer)) as c from h),
 d as (select *, lag(c) over (partition by video order by i) as o from s), m as (select video, i, len(list_filter([1, 2, 3, 4], lambda k: abs(c[k] - o[k]) > {CHANGE})) / 4.0::double > {SHARE} as moving from d where o is not null),
 l as (select video, max(i) as last_i from m group by video), x as (select *, case when i - lag(i) over (partition by video order by i) > 3 then 1 else 0 end as n from m where moving),
 y as (select *, sum(n) over (partition by video order by i rows unbounded preceding) as r from x), z as (select video, min(i) as f, max(i) as l from y group by video, r),
 v as (select video, count(*) * 3 as total, count(*) * 3 / 30.0::double as duration from b group by video),
 p as (select video, greatest(0, f * 3 / 30.0::double - 0.5) as s, least(duration, case when l + 3 <= last_i then (l + 3) * 3 else total end / 30.0::double + 2.0) as e from z join l using (video) join v using (video)),
 w as (select *, case when s <= max(e) over (partition by video order by s, e rows between unbounded preceding and 1 preceding) + 0.2 then 0 else 1 end as n from p where e - s >= 0.3),
 u as (select *, sum(n) over (partition by video order by s, e rows unbounded preceding) as r from w) select video, min(s) as start, max(e) as "end" from u group by video, r""")
def movement_segments(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as frames of eight by eight colored pixels, from pixels to segments."""
    e = tables.read(spark, d, "embeddings").where(F.size("embedding") == 64)
    pixels = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.array(_byte(j), _byte((j + 1) % 64), _byte((j + 2) % 64)))
    frames = e.select(F.expr(f"vec_id div {CLIP}").alias("video_id"), (F.col("vec_id") % CLIP).alias("sample_idx"), pixels.alias("pixels"))
    videos = frames.groupBy("video_id").agg((F.count("*") * 3).alias("total_frames"))
    return pipelines.movement(frames, videos, 8, change=CHANGE, share=SHARE).withColumnRenamed("video_id", "video")


#: Hints of the player that is looked for: a number, and the colors (blue, green, red) of helmet and shirt.
JERSEY, HELMET, SHIRT = "17", (40, 90, 200), (180, 60, 30)


def _distance(c: str, hint: tuple[int, int, int]) -> str:
    """SQL of the color distance of a list (blue, green, red) from a fixed color."""
    b, g, r = (x / 255.0 for x in hint)
    top, low = max(r, g, b), min(r, g, b)
    d = top - low
    hue = (0.0 if d == 0 else (g - b) / d if top == r else 2.0 + (b - r) / d if top == g else 4.0 + (r - g) / d) / 6.0
    x, y, z = (f"({c}[{i}] / 255.0::double)" for i in (3, 2, 1))
    high, range_ = f"greatest({x}, {y}, {z})", f"(greatest({x}, {y}, {z}) - least({x}, {y}, {z}))"
    own = f"(case when {range_} = 0 then 0 when {high} = {x} then ({y} - {z}) / {range_} when {high} = {y} then 2.0 + ({z} - {x}) / {range_} else 4.0 + ({x} - {y}) / {range_} end / 6.0)"
    own = f"({own} - floor({own}))"
    gap = f"abs({own} - {hue - hue // 1}::double)"
    return f"sqrt(power(least({gap}, 1 - {gap}) * 2, 2) + power(case when {high} = 0 then 0 else {range_} / {high} end - {d / top}::double, 2) + power({high} - {top}::double, 2))"


@query(f"""with e as (select vec_id // 120 as video, vec_id % 120 // 4 as frame, vec_id % 4 as box, {BYTES} as p, list_transform(embedding, lambda x: abs(cast(x as double))) as a, vec_id from embeddings where len(embedding) >= 32),
 c as (select *, p[23] as x1, p[24] as y1, p[23] + 10 + p[25] % 60 as x2, p[24] + 30 + p[26] % 90 as y2, [p[1], p[2], p[3]] as helmet, [p[4], p[5], p[6]] as torso from e),
 s as (select *, vec_id % 23 = 17 as hit, coalesce(case when vec_id % 5 > 0 then 1 - {_distance("helmet", HELMET)} end >= 1 - 0.28::double, false) as sure, 1 - {_distance("torso", SHIRT)} as shirt,
  1 - least(1.0, sqrt(power((0.5 * (x1 + x2) - 400 / 2) / 400, 2) + power((0.5 * (y1 + y2) - 300 / 2) / 300, 2))) as center, (x2 - x1) * (y2 - y1) / 120000.0::double as area from c where x2 - x1 >= 20 and y2 - y1 >= 40),
 b as (select video, frame, box, a[7:22] as h, hit or sure or shirt >= 0.6 as locks, case when hit then 2.0::double else 0 end + case when sure then 1.0::double else 0 end + 0.8::double * shirt + 0.3::double * center + 0.2::double * area as base from s),
 f as (select *, row_number() over (partition by video, frame order by base desc, box) as r from b),
 t as (select video, frame, box as spot, h from f where locks union all select video, frame, 2147483647, h from f where r = 1 and base >= 0.45),
 l as (select video, frame as lf, spot as lb, h as g from t qualify row_number() over (partition by video order by frame, spot) = 1),
 m as (select *, list_sum(list_transform(list_zip(h, g), lambda z: sqrt(z[1] * z[2]))) / sqrt(list_sum(h) * list_sum(g)) as shared from b left join l using (video)),
 o as (select video, frame, box, base + case when frame > lf or (frame = lf and box >= lb) then 0.6::double * greatest(0, 1 - sqrt(greatest(0, 1 - shared))) else 0 end as score from m)
 select video, frame, box, round(score, 6) as score from o qualify row_number() over (partition by video, frame order by score desc, box) = 1 and score >= 0.45""")
def seeds_of_frames(spark: SparkSession, d: str) -> DataFrame:
    """Four candidates a frame: number, colors and place score them, a reference is locked, the best accepted one of each frame is a seed."""
    e = tables.read(spark, d, "embeddings").where(F.size("embedding") >= 32)
    three = lambda i: F.array(_byte(i), _byte(i + 1), _byte(i + 2))
    v = F.col("vec_id")
    x1, y1 = _byte(22), _byte(23)
    c = e.select(
        F.expr("vec_id div 120").alias("video_id"), F.expr("vec_id % 120 div 4").alias("frame"), (v % 4).alias("box"), x1.alias("x1"), y1.alias("y1"), (x1 + 10 + _byte(24) % 60).alias("x2"), (y1 + 30 + _byte(25) % 90).alias("y2"),
        F.lit(400).alias("width"), F.lit(300).alias("height"), F.when(v % 23 == 17, "no 1 7").otherwise("no 3").alias("text"), F.when(v % 5 > 0, three(0)).alias("helmet"), F.lit(None).cast("array<int>").alias("glove_left"), three(3).alias("torso"),
        F.transform(F.slice("embedding", 7, 16), lambda x: F.abs(x.cast("double"))).alias("vector"),
    )
    return pipelines.seeds(c, JERSEY, helmet=HELMET, shirt=SHIRT).select(F.col("video_id").alias("video"), "frame", "box", F.round("score", 6).alias("score"))


@query("""select conv_id, arg_max(role, turn) as role, arg_max(length(text), turn) filter (length(text) % 3 = 0) as size, max(turn) as updated_at from conversations group by conv_id""")
def compacted_status(spark: SparkSession, d: str) -> DataFrame:
    """The last state of each conversation from two snapshots of its first turns and the tail after them."""
    c = tables.read(spark, d, "conversations").select("conv_id", "turn", "role", F.when(F.length("text") % 3 == 0, F.length("text").cast("long")).alias("size"))
    part = lambda where: jobs.snapshot(c.where(where), "conv_id", ["turn"], ["role", "size"])
    old = jobs.merged(part("turn < 2"), part("turn between 1 and 3"), "conv_id")  # turns that both hold do no harm
    return jobs.state_of(jobs.merged(old, part("turn > 3"), "conv_id"), "conv_id")


@query("""with l as (select conv_id, turn, case turn % 7 when 0 then 'downloading' when 1 then 'detecting' when 2 then 'tracking' when 3 then 'selecting' when 4 then 'compiling' when 5 then 'done' else 'other' end as stage from conversations)
 select conv_id, turn, stage, case stage when 'downloading' then 5 when 'detecting' then 40 when 'tracking' then 60 when 'selecting' then 75 when 'compiling' then 90 when 'done' then 100 end as progress from l""")
def job_stages(spark: SparkSession, d: str) -> DataFrame:
    """The progress at which each stage of a job starts; none for a stage that isn't known."""
    stage = F.element_at(F.array(*map(F.lit, ("downloading", "detecting", "tracking", "selecting", "compiling", "done", "other"))), (F.col("turn") % 7 + 1).cast("int"))
    return tables.read(spark, d, "conversations").select("conv_id", "turn", stage.alias("stage"), jobs.stage_progress(stage).alias("progress"))


@query("""select 'conv-' || conv_id as id, 'queued' as status, 'queued' as stage, 'Job queued' as message, 0.0::double as download_percent, 0.0::double as progress, null::varchar as output_url, null::varchar as output_path, text as request_json,
 null::varchar as result_json, null::varchar as error, conv_id * 60.0::double as created_at, conv_id * 60.0::double as updated_at from conversations where turn = 0""")
def job_rows(spark: SparkSession, d: str) -> DataFrame:
    """New jobs with all fields of the job table."""
    c = tables.read(spark, d, "conversations").where("turn = 0").select(F.concat(F.lit("conv-"), F.col("conv_id")).alias("id"), "text", (F.col("conv_id") * 60.0).alias("at"))
    return jobs.as_rows(jobs.created(c, "id", "text", "at"), tables.JOB)


@query("""with b as (select vec_id, """ + BYTES + """ as p from embeddings where len(embedding) >= 8), k as (select *, p[1] % 4 as n from b),
 x as (select vec_id, unnest(range(0, n)) as box, p from k where p[2] % 9 <> 0) select vec_id, box, cast(p[box + 1] as double) as x1, cast(p[box + 2] as double) as y1, p[box + 1] + 20.0::double as x2, p[box + 2] + 50.0::double as y2, p[box + 3] / 255.0::double as conf,
 case when p[4] % 7 = 0 and vec_id % 3 = 0 then [] when vec_id % 3 = 0 then ['no ' || p[4], 'x'] else [] end as texts, case when p[5] % 11 = 0 then 0.0::double else p[6] / 255.0::double end as score from x""")
def model_calls(spark: SparkSession, d: str) -> DataFrame:
    """A detector, a reader and a remote scorer, each a rule that fails on some rows, called by batch: what fails has no boxes, no texts and the score 0."""

    def detector():
        def detect(frames):
            if any(f[1] % 9 == 0 for f in frames):
                raise RuntimeError("out of memory")
            return [[(float(f[i]), float(f[i + 1]), f[i] + 20.0, f[i + 1] + 50.0, 0, f[i + 2] / 255.0) for i in range(int(f[0]) % 4)] for f in frames]

        return detect

    def reader():
        def read(crop):
            if crop[3] % 7 == 0:
                raise ValueError("nothing to read")
            return [f"no {crop[3]}", "x"]

        return read

    def scorer():
        def call(x):
            if x[4] % 11 == 0:
                raise TimeoutError
            return '{"score": %r}' % (x[5] / 255.0)

        return call

    e = tables.read(spark, d, "embeddings").where(F.size("embedding") >= 8).select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: F.floor(F.abs(x.cast("double")) * 1000).cast("int") % 256).alias("frame"))
    x = models.scored(models.read_texts(models.detections(e, detector, "frame"), reader, "frame", 3, "vec_id"), scorer, "frame")
    b = x.select("vec_id", F.posexplode("boxes").alias("box", "b"), "texts", F.coalesce(scalar.score_json(F.col("answer")), F.lit(0.0)).alias("score"))
    return b.select("vec_id", "box", "b.x1", "b.y1", "b.x2", "b.y2", "b.conf", "texts", "score")


@query("""select doc_id, to_base64(encode(text)) as payload from documents where text is not null""")
def frame_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Contents in base64, as they are sent to a scorer."""
    x = tables.read(spark, d, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return tables.encoded(x, "content", "payload").select("doc_id", F.regexp_replace("payload", "[\r\n]", "").alias("payload"))


@query("""select doc_id, ['-i', 'in/' || source || '.mp4', '-vf', 'fps=30,scale=1920:1080:force_original_aspect_ratio=decrease,pad=1920:1080:(ow-iw)/2:(oh-ih)/2', '-c:v', 'libx264', '-c:a', 'aac', '-y', 'c' || doc_id || '.mp4'] as uniform,
 ['-ss', n_chars / 10.0::double || '', '-i', 'in/' || source || '.mp4', '-frames:v', '1', '-y', 's' || doc_id || '.jpg'] as still, ['-f', 'concat', '-safe', '0', '-i', 'l' || doc_id || '.txt', '-c', 'copy', '-y', 'o' || doc_id || '.mp4'] as listed from documents""")
def clip_tools(spark: SparkSession, d: str) -> DataFrame:
    """The encoder's arguments for clips of one shape, for stills and for a join by a list."""
    name = lambda a, c, b: F.concat(F.lit(a), F.col(c), F.lit(b))
    source, x = name("in/", "source", ".mp4"), tables.read(spark, d, "documents")
    return x.select("doc_id", clips.uniform_args(source, name("c", "doc_id", ".mp4")).alias("uniform"), clips.still_args(source, F.col("n_chars") / 10.0, name("s", "doc_id", ".jpg")).alias("still"), clips.list_args(name("l", "doc_id", ".txt"), name("o", "doc_id", ".mp4")).alias("listed"))


@query("""select doc_id, 'yolov8x.pt' as detector, n_chars % 100 / 100.0::double as confidence, [0] as classes, true as tracking, false as hands, 'cosine' as face_metric, 0.6::double as most_distance, 0.3::double as least_confidence from documents""")
def model_configs(spark: SparkSession, d: str) -> DataFrame:
    """The models' settings of requests with different confidence thresholds."""
    x = tables.read(spark, d, "documents").select("doc_id", models.model_settings(F.col("n_chars") % 100 / 100.0).alias("m"))
    return x.select("doc_id", F.col("m.detector.model").alias("detector"), "m.detector.confidence", "m.detector.classes", "m.detector.tracking", "m.landmarks.hands", F.col("m.face.distance_metric").alias("face_metric"), F.col("m.appearance.max_dist").alias("most_distance"), F.col("m.appearance.min_confidence").alias("least_confidence"))


#: Vectors of a raw video of frames of eight by eight bytes, and how many evenly spaced frames of it are read.
RAW, READ = 48, 5


@query(f"""with b as (select vec_id // {RAW} as video, row_number() over (partition by vec_id // {RAW} order by vec_id) - 1 as i, count(*) over (partition by vec_id // {RAW}) as n, {BYTES} as p from embeddings where len(embedding) = 64)
 select 'v' || video as video, cast(i as bigint) as frame_idx, i / 30.0::double as t_sec, upper(array_to_string(list_transform(p, lambda x: printf('%02x', x)), '')) as pixels from b
 where i in (select unnest(list_transform(range(0, {READ}), lambda j: least(n - 1, cast(floor(j * n / {READ}.0::double + n / {2 * READ}.0::double) as bigint)))))""")
def frames_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Vectors are put together to raw videos, written by the sink with a commit, and evenly spaced frames of each are read again."""
    e = tables.read(spark, d, "embeddings").where(F.size("embedding") == 64)
    hexed = F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex((F.floor(F.abs(x.cast("double")) * 1000) % 256).cast("long")), 2, "0")), "")
    v = e.select(F.concat(F.lit("v"), F.expr(f"vec_id div {RAW}")).alias("video"), "vec_id", hexed.alias("x")).groupBy("video").agg(F.array_sort(F.collect_list(F.struct("vec_id", "x"))).alias("f"))
    rows = v.select("video", F.concat("video", F.lit(".raw")).alias("clip"), F.lit(0.0).alias("start"), (F.size("f") / 30.0).alias("end"), F.unhex(F.array_join("f.x", "")).alias("content"))
    clip_sink.register(spark)
    path = f"{scratch.folder(spark)}/raw-{uuid.uuid4().hex}"
    rows.write.format("clips").mode("append").options(path=path, least_bytes="1").save()
    at = F.regexp_extract("video", r"-(v[0-9]+)\.raw$", 1)
    return frames.scan(spark, f"{path}/clips/*/*.raw", 8, 8, count=READ).distinct().select(at.alias("video"), "frame_idx", "t_sec", F.hex("pixels").alias("pixels"))


@query("""with s as (select conv_id, turn as i, length(text) % 5 > 1 as moving from conversations), v as (select conv_id, max(i) as last_i, count(*) * 3 as total, count(*) * 3 / 30.0::double as duration from s group by conv_id),
 m as (select *, case when i - lag(i) over (partition by conv_id order by i) > 5 then 1 else 0 end as b from s where moving), g as (select *, sum(b) over (partition by conv_id order by i rows unbounded preceding) as g from m),
 q as (select conv_id, min(i) as f, max(i) as l from g group by conv_id, g), p as (select conv_id, greatest(0, f * 3 / 30.0::double - 0.8) as s, least(duration, case when l + 5 <= last_i then (l + 5) * 3 else total end / 30.0::double + 2.5) as e from q join v using (conv_id)),
 x as (select *, case when s <= max(e) over (partition by conv_id order by s, e rows between unbounded preceding and 1 preceding) + 0.2 then 0 else 1 end as b from p where e - s >= 0.4),
 y as (select *, sum(b) over (partition by conv_id order by s, e rows unbounded preceding) as g from x) select conv_id, min(s) as start, max(e) as "end" from y group by conv_id, g""")
def practice_detailed(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as bowling practice, their turns as samples, in detailed mode: runs close after half a second of stillness."""
    s = tables.read(spark, d, "conversations").select("conv_id", F.col("turn").alias("sample_idx"), (F.length("text") % 5 > 1).alias("moving"))
    videos = s.groupBy("conv_id").agg((F.count("*") * 3).alias("total_frames"))
    return pipelines.practice(s, videos, "conv_id", batting=False, mode="detailed")
