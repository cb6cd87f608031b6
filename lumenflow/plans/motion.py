"""Queries of the motion operators over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import LIBRARY, Config
from ..functions.background import final_background, running_background
from ..functions.draw import box, gray, resized_width, track_colour
from ..operators import assign, debug, intervals, pixels as P, segment, tracker, video
from ..sources.frames import moving_spot
from .adapters import PIXELS, POINTS, SERIES, SIGNALS, pixels, points, read, series, signals

SMALL, LARGE = 0.1, 0.02
CHANGE, DIFF, ON, RADIUS = 10, 25, 140, 20.0
D = "::DOUBLE"
REGISTRY: dict = {}


def query(sql: str | None):
    def add(f):
        REGISTRY[f.__name__.rstrip("_")] = (f, sql)
        return f

    return add


def _step(acc: str, v: str, small=SMALL, large=LARGE) -> str:
    return f"{acc} + ({v} - {acc}) * CASE WHEN abs({v} - {acc}) <= {CHANGE} THEN {small}{D} ELSE {large}{D} END"


_RUN = f"list_reduce(list_transform(vs, lambda v: [v]), lambda a, b: list_append(a, {_step('a[-1]', 'b[1]')}))"


@query(f"""WITH {SERIES}, bg AS (SELECT stream, vs, {_RUN} AS bg FROM ser),
d AS (SELECT stream, unnest(vs) AS v, unnest(bg) AS b FROM bg)
SELECT stream, count(*)::BIGINT AS frames, count(*) FILTER (abs(v - b) > {DIFF})::BIGINT AS detections, round(max(abs(v - b)), 6) AS largest FROM d GROUP BY stream""")
def signal_detections(spark, sf_dir):
    s = series(spark, sf_dir).withColumn("bg", running_background(F.col("vs"), SMALL, LARGE, CHANGE))
    d = s.select("stream", F.explode(F.zip_with("vs", "bg", lambda v, b: F.abs(v - b))).alias("d"))
    return d.groupBy("stream").agg(F.count("*").alias("frames"), F.count_if(F.col("d") > DIFF).alias("detections"), F.round(F.max("d"), 6).alias("largest"))


@query(f"WITH {SERIES} SELECT stream, round(list_reduce(vs, lambda a, b: a + (b - a) * 0.1{D}), 6) AS background FROM ser")
def ema_background(spark, sf_dir):
    return series(spark, sf_dir).select("stream", F.round(final_background(F.col("vs"), SMALL, SMALL, CHANGE), 6).alias("background"))


@query(f"WITH {SERIES} SELECT stream, round(list_reduce(vs, lambda a, b: {_step('a', 'b')}), 6) AS background FROM ser")
def adaptive_ema_background(spark, sf_dir):
    return series(spark, sf_dir).select("stream", F.round(final_background(F.col("vs"), SMALL, LARGE, CHANGE), 6).alias("background"))


@query(f"WITH {PIXELS} SELECT stream, frame, y, x, ((g * 3735 + (g * 7 % 256) * 19235 + (g * 13 % 256) * 9798 + 16384) >> 15)::INT AS gray FROM px")
def gray_fixed_point(spark, sf_dir):
    g = F.col("g")
    return pixels(spark, sf_dir).select("stream", "frame", "y", "x", gray(g, g * 7 % 256, g * 13 % 256).alias("gray"))


@query(f"WITH {PIXELS} SELECT stream, frame, y, x, CASE WHEN y >= 4 AND x >= 4 THEN 0 ELSE g END AS g FROM px")
def mask_rect(spark, sf_dir):
    return P.mask_rect(pixels(spark, sf_dir), 8, 8, (0.5, 0.5, 1, 1))


@query(f"WITH {PIXELS} SELECT stream, frame, (y // 2)::INT AS y, (x // 2)::INT AS x, round_even(avg(g), 0)::INT AS g FROM px GROUP BY 1, 2, 3, 4")
def resize_area_2x(spark, sf_dir):
    return P.shrink(pixels(spark, sf_dir), 2)


@query("SELECT p_partkey AS id, greatest(1, round_even(p_size * (16.0::DOUBLE / 10), 0))::INT AS width FROM part")
def resized_width_(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), resized_width(F.col("p_size"), F.lit(10), 16).alias("width"))


def _background(name: str, rate: str) -> str:
    """SQL of the distance to a background that is updated first, in single precision, and cut to whole numbers."""
    b = f"list_reduce(list_transform(gs, lambda v: [v::FLOAT]), lambda a, b: list_append(a, ((1::FLOAT - {rate}) * a[-1] + {rate} * b[1])::FLOAT))"
    return f"""s_{name} AS (SELECT stream, y, x, list(frame ORDER BY frame) AS fs, list(g ORDER BY frame) AS gs FROM px GROUP BY 1, 2, 3),
b_{name} AS (SELECT *, {b} AS bs FROM s_{name}),
{name} AS (SELECT stream, fs[k] AS frame, y, x, gs[k] AS g, CASE WHEN k = 1 THEN 0 ELSE abs(gs[k] - trunc(bs[k])::INT) END::INT AS d FROM b_{name}, unnest(range(1, len(fs) + 1)) t(k))"""


_DIFF = _background("df", f"(CASE WHEN abs(b[1] - a[-1]) <= {CHANGE} THEN {SMALL}::FLOAT ELSE ({SMALL}::DOUBLE * 0.2::DOUBLE)::FLOAT END)")


@query(f"WITH {PIXELS}, {_DIFF} SELECT stream, frame, sum(d)::BIGINT AS moved, max(d)::INT AS largest FROM df GROUP BY 1, 2")
def background_diff(spark, sf_dir):
    return P.background_differences(pixels(spark, sf_dir), LIBRARY).groupBy("stream", "frame").agg(F.sum("d").alias("moved"), F.max("d").alias("largest"))


@query(f"WITH {PIXELS}, {_background('df', '0.3::FLOAT')} SELECT stream, frame, y, x, g, d FROM df")
def background_diff_plain(spark, sf_dir):
    return P.background_differences(pixels(spark, sf_dir), Config(alpha=0.3, adaptive=False))


@query(f"WITH {PIXELS} SELECT stream, min(frame) AS frame, 0::BIGINT AS moved FROM px GROUP BY 1")
def first_frame_no_diff(spark, sf_dir):
    d = P.background_differences(pixels(spark, sf_dir), LIBRARY).groupBy("stream", "frame").agg(F.sum("d").alias("moved"))
    return d.groupBy("stream").agg(F.min(F.struct("frame", "moved")).alias("f")).select("stream", "f.*")


@query(f"WITH {PIXELS} SELECT stream, frame, count(*)::BIGINT AS pixels FROM px WHERE g > {ON} GROUP BY 1, 2")
def threshold(spark, sf_dir):
    return P.threshold(pixels(spark, sf_dir), ON).groupBy("stream", "frame").agg(F.count("*").alias("pixels"))


def _morph_sql(k: int, steps: str) -> str:
    off = ", ".join(map(str, P.ellipse(k)))
    ctes, last = [PIXELS, f"o(dy, dx) AS (VALUES {off})"], "px"
    for i, s in enumerate(steps):
        agg = "max" if s == "d" else "min"
        ctes.append(f"m{i} AS (SELECT p.stream, p.frame, p.y, p.x, {agg}(q.g)::INT AS g FROM {last} p, o JOIN {last} q ON q.stream = p.stream AND q.frame = p.frame AND q.y = p.y + o.dy AND q.x = p.x + o.dx GROUP BY 1, 2, 3, 4)")
        last = f"m{i}"
    return f"WITH {', '.join(ctes)} SELECT * FROM {last}"


@query(_morph_sql(5, "d"))
def dilate(spark, sf_dir):
    return P.dilate(pixels(spark, sf_dir), 5)


@query(_morph_sql(5, "e"))
def erode(spark, sf_dir):
    return P.erode(pixels(spark, sf_dir), 5)


@query(_morph_sql(3, "ed"))
def opening(spark, sf_dir):
    return P.opening(pixels(spark, sf_dir), 3)


@query(_morph_sql(3, "de"))
def closing(spark, sf_dir):
    return P.closing(pixels(spark, sf_dir), 3)


@query(_morph_sql(3, "dd"))
def double_dilate(spark, sf_dir):
    return P.dilate(pixels(spark, sf_dir), 3, 2)


_BLOBS = f"""WITH RECURSIVE {PIXELS}, p AS (SELECT *, (y * 8 + x)::BIGINT AS pos FROM px WHERE g > {ON}),
fr AS (SELECT DISTINCT stream, frame FROM p), ring AS (SELECT stream, frame, a.y::INT AS y, c.x::INT AS x FROM fr, range(-1, 9) a(y), range(-1, 9) c(x)),
off_ AS (SELECT ring.* FROM ring LEFT JOIN p USING (stream, frame, y, x) WHERE p.g IS NULL),
o AS (SELECT stream, frame, y, x FROM off_ WHERE y = -1 AND x = -1 UNION SELECT n.stream, n.frame, n.y, n.x FROM o JOIN off_ n ON n.stream = o.stream AND n.frame = o.frame AND abs(n.y - o.y) + abs(n.x - o.x) = 1),
fl AS (SELECT ring.stream, ring.frame, ring.y, ring.x, p.g, (ring.y * 8 + ring.x)::BIGINT AS pos FROM ring LEFT JOIN o USING (stream, frame, y, x) LEFT JOIN p USING (stream, frame, y, x) WHERE o.y IS NULL),
r AS (SELECT stream, frame, pos, y, x, pos AS root FROM fl UNION SELECT fl.stream, fl.frame, fl.pos, fl.y, fl.x, r.root FROM r JOIN fl ON fl.stream = r.stream AND fl.frame = r.frame AND abs(fl.y - r.y) <= 1 AND abs(fl.x - r.x) <= 1),
b AS (SELECT fl.stream, fl.frame, fl.y, fl.x, fl.g, m.blob FROM fl JOIN (SELECT stream, frame, pos, min(root) AS blob FROM r GROUP BY 1, 2, 3) m USING (stream, frame, pos))"""


def _blobs(spark, sf_dir):
    return segment.components(P.threshold(pixels(spark, sf_dir), ON), 8)


@query(_BLOBS + " SELECT stream, frame, y, x, g, blob FROM b")
def components(spark, sf_dir):
    return _blobs(spark, sf_dir)


@query(_BLOBS + " SELECT stream, frame, blob, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, count(*)::BIGINT AS pixels FROM b GROUP BY 1, 2, 3")
def blob_bbox(spark, sf_dir):
    return segment.boxes(_blobs(spark, sf_dir))


@query(_BLOBS + """, q AS (SELECT stream, frame, blob, y - a AS y, x - c AS x, count(*) AS n FROM b, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(a, c) GROUP BY 1, 2, 3, 4, 5)
SELECT stream, frame, blob, sum(CASE n WHEN 4 THEN 1.0::DOUBLE WHEN 3 THEN 0.5::DOUBLE ELSE 0 END) AS area FROM q GROUP BY 1, 2, 3""")
def blob_area_quads(spark, sf_dir):
    return segment.areas(_blobs(spark, sf_dir))


@query(_BLOBS + " SELECT stream, frame, blob, x, y, g FROM b WHERE g IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stream, frame, blob ORDER BY g DESC, y, x) = 1")
def blob_peak(spark, sf_dir):
    return segment.peaks(_blobs(spark, sf_dir))


@query(_BLOBS + """, q AS (SELECT stream, frame, blob, b.y - o.a AS wy, b.x - o.c AS wx, count(*) AS n, avg(b.y) AS my, avg(b.x) AS mx FROM b, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(a, c) GROUP BY 1, 2, 3, 4, 5),
w AS (SELECT *, CASE n WHEN 4 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS m FROM q WHERE n >= 3)
SELECT stream, frame, blob, round(sum(m * mx) / sum(m), 6) AS cx, round(sum(m * my) / sum(m), 6) AS cy FROM w GROUP BY 1, 2, 3""")
def blob_centroid(spark, sf_dir):
    return segment.centroids(_blobs(spark, sf_dir)).withColumn("cx", F.round("cx", 6)).withColumn("cy", F.round("cy", 6))


_PAIRS = f"""{POINTS}, pr AS (SELECT a.stream, b.frame, a.i AS track, b.i, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS dist_sq
FROM pts a JOIN pts b ON a.stream = b.stream AND b.frame = a.frame + 1 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 400)"""


def _sides(spark, sf_dir):
    """The points of the frame before as tracks, and the points."""
    p = points(spark, sf_dir)
    return p.select("stream", (F.col("frame") + 1).alias("frame"), F.col("i").alias("track"), F.col("x").alias("tx"), F.col("y").alias("ty")), p


@query(f"WITH {_PAIRS} SELECT stream, frame, track, i, round(dist_sq, 6) AS dist_sq FROM pr")
def candidate_pairs(spark, sf_dir):
    return assign.candidate_pairs(*_sides(spark, sf_dir), RADIUS, 6)


_GREEDY = f"""WITH RECURSIVE {_PAIRS}, rk AS (SELECT *, row_number() OVER (PARTITION BY stream, frame ORDER BY dist_sq, track, i) AS k FROM pr),
f AS (SELECT stream, frame, 0::BIGINT AS k, []::BIGINT[] AS t, []::BIGINT[] AS d, NULL::BIGINT AS track, NULL::BIGINT AS i, false AS ok FROM (SELECT DISTINCT stream, frame FROM pr)
UNION ALL SELECT rk.stream, rk.frame, rk.k,
  CASE WHEN NOT list_contains(t, rk.track) AND NOT list_contains(d, rk.i) THEN list_append(t, rk.track) ELSE t END,
  CASE WHEN NOT list_contains(t, rk.track) AND NOT list_contains(d, rk.i) THEN list_append(d, rk.i) ELSE d END,
  rk.track, rk.i, NOT list_contains(t, rk.track) AND NOT list_contains(d, rk.i)
  FROM f JOIN rk ON rk.stream = f.stream AND rk.frame = f.frame AND rk.k = f.k + 1)"""


@query(_GREEDY + " SELECT stream, frame, track, i FROM f WHERE ok")
def greedy_assignment(spark, sf_dir):
    return assign.greedy_points(*_sides(spark, sf_dir), RADIUS)


@query(_GREEDY + " SELECT p.stream, p.frame, p.i FROM pts p WHERE NOT EXISTS (SELECT 1 FROM f WHERE ok AND f.stream = p.stream AND f.frame = p.frame AND f.i = p.i)")
def unassigned_detections(spark, sf_dir):
    return assign.unassigned(points(spark, sf_dir), assign.greedy_points(*_sides(spark, sf_dir), RADIUS)).select("stream", "frame", "i")


_RUNS = f"""{SIGNALS}, h AS (SELECT stream, frame, v > 50 AS hit, CASE WHEN lag(v > 50) OVER w IS DISTINCT FROM (v > 50) THEN 1 ELSE 0 END AS c FROM sig WINDOW w AS (PARTITION BY stream ORDER BY frame)),
g AS (SELECT *, sum(c) OVER (PARTITION BY stream ORDER BY frame) AS island FROM h), n AS (SELECT *, row_number() OVER (PARTITION BY stream, island ORDER BY frame) AS n FROM g),
runs AS (SELECT stream, frame, CASE WHEN hit THEN n ELSE 0 END::BIGINT AS hits, CASE WHEN hit THEN 0 ELSE n END::BIGINT AS misses FROM n)"""


def _runs(spark, sf_dir):
    return assign.runs(signals(spark, sf_dir).select("stream", "frame", (F.col("v") > 50).alias("hit")))


@query(f"WITH {_RUNS} SELECT * FROM runs")
def consecutive_runs(spark, sf_dir):
    return _runs(spark, sf_dir)


@query(f"WITH {_RUNS} SELECT stream, min(frame) AS frame FROM runs WHERE misses > {2 * LIBRARY.max_missed} GROUP BY 1")
def expired_tracks(spark, sf_dir):
    return _runs(spark, sf_dir).where(F.col("misses") > 2 * LIBRARY.max_missed).groupBy("stream").agg(F.min("frame").alias("frame"))


@query(f"WITH {POINTS} SELECT stream, round(greatest(max(x) - min(x), max(y) - min(y)), 6) AS span FROM pts GROUP BY 1")
def trajectory_span(spark, sf_dir):
    return assign.spans(points(spark, sf_dir)).withColumn("span", F.round("span", 6))


@query(f"""WITH {POINTS}
SELECT s.stream, e.i AS old, s.i AS track, e.frame AS ended, s.frame AS began, round((s.x - e.x) * (s.x - e.x) + (s.y - e.y) * (s.y - e.y), 6) AS dist_sq
FROM pts e JOIN pts s ON s.stream = e.stream AND s.frame BETWEEN e.frame + 1 AND e.frame + 2 AND e.i != s.i AND (s.x - e.x) * (s.x - e.x) + (s.y - e.y) * (s.y - e.y) <= 100""")
def merge_candidates(spark, sf_dir):
    p = points(spark, sf_dir).withColumnRenamed("i", "track")
    return assign.merge_candidates(p, p, 2, 100.0, 6)


@query(f"WITH {SIGNALS} SELECT stream, frame FROM sig WHERE NOT v > 50")
def null_events(spark, sf_dir):
    s = signals(spark, sf_dir)
    return debug.null_events(s, s.where("v > 50"))


@query("SELECT event_type AS stream, count(DISTINCT user_id)::BIGINT AS tracks FROM events GROUP BY 1")
def track_count_distinct(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stream")).agg(F.countDistinct("user_id").alias("tracks"))


@query("SELECT event_type AS stream, count(*) FILTER (value > 50)::BIGINT AS detections FROM events GROUP BY 1")
def detection_count(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stream")).agg(F.count_if(F.col("value") > 50).alias("detections"))


@query(f"WITH {POINTS} SELECT stream, string_agg(frame || ':' || floor(x)::BIGINT || ',' || floor(y)::BIGINT, ' ' ORDER BY frame, i) AS path FROM pts GROUP BY 1")
def trajectories(spark, sf_dir):
    return debug.trajectories(points(spark, sf_dir))


#: The buffer holds each point at its frame, as the track of its user; late ones say the same of the frame before.
_BUFFER = f"{POINTS}, u AS (SELECT pts.*, user_id AS track FROM pts JOIN events ON event_id = i), bf AS (SELECT stream, frame, track, max(x) AS x, max(y) AS y FROM u GROUP BY 1, 2, 3), lt AS (SELECT stream, frame - 1 AS frame, track, min(x) AS x, min(y) AS y FROM u GROUP BY 1, 2, 3)"


@query(f"WITH {_BUFFER} SELECT coalesce(l.stream, b.stream) AS stream, coalesce(l.frame, b.frame) AS frame, coalesce(l.track, b.track) AS track, coalesce(l.x, b.x) AS x, coalesce(l.y, b.y) AS y FROM bf b FULL JOIN (SELECT * FROM lt WHERE EXISTS (SELECT 1 FROM bf WHERE bf.stream = lt.stream AND bf.frame = lt.frame)) l ON l.stream = b.stream AND l.frame = b.frame AND l.track = b.track")
def buffer_patch(spark, sf_dir):
    p = points(spark, sf_dir, F.col("user_id").alias("track"))
    held = p.groupBy("stream", "frame", "track").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    late = p.groupBy("stream", (F.col("frame") - 1).alias("frame"), "track").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    return debug.patched(held, late)


_LATE = f"{POINTS}, ev AS (SELECT stream, frame + i % 4 AS emit_frame, i AS emit_seq, frame AS frame_number, i % 10 AS track_id, x, y FROM pts)"


def _late(spark, sf_dir):
    i = F.col("i")
    return points(spark, sf_dir).select("stream", (F.col("frame") + i % 4).alias("emit_frame"), i.alias("emit_seq"), F.col("frame").alias("frame_number"), (i % 10).alias("track_id"), "x", "y")


@query(f"WITH {_LATE} SELECT stream, frame_number AS frame, track_id AS track, x, y FROM ev WHERE emit_frame - frame_number < 3 QUALIFY row_number() OVER (PARTITION BY stream, frame_number, track_id ORDER BY emit_frame DESC, emit_seq DESC) = 1")
def buffered_view(spark, sf_dir):
    return debug.shown(_late(spark, sf_dir), 3)


@query(f"WITH {_LATE}, s AS (SELECT stream, track_id AS track, lag(trunc(x)::INT) OVER w AS x1, lag(trunc(y)::INT) OVER w AS y1, trunc(x)::INT AS x2, trunc(y)::INT AS y2, emit_frame - 3 AS visible_from FROM ev WHERE emit_frame = frame_number WINDOW w AS (PARTITION BY stream, track_id ORDER BY emit_frame, emit_seq)) SELECT * FROM s WHERE x1 IS NOT NULL")
def visible_segments(spark, sf_dir):
    return debug.visible_segments(_late(spark, sf_dir), 3)


@query("SELECT user_id AS track, c[1] AS b, c[2] AS g, c[3] AS r FROM (SELECT DISTINCT user_id, [[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 0], [255, 0, 255], [0, 255, 255], [128, 0, 255], [255, 128, 0]][user_id % 8 + 1] AS c FROM events)")
def track_colour_(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("track")).distinct().select("track", track_colour(F.col("track")).alias("c")).select("track", "c.*")


@query(f"WITH {POINTS} SELECT i, trunc(x)::INT - 50 AS x1, trunc(y)::INT - 50 AS y1, trunc(x)::INT + 50 AS x2, trunc(y)::INT + 50 AS y2 FROM pts")
def track_boxes(spark, sf_dir):
    return points(spark, sf_dir).select("i", box(F.col("x"), F.col("y"), 50).alias("c")).select("i", "c.*")


@query(f"WITH {POINTS}, s AS (SELECT stream, frame, i, trunc(x)::INT AS x1, trunc(y)::INT AS y1, lead(trunc(x)::INT) OVER w AS x2, lead(trunc(y)::INT) OVER w AS y2 FROM pts WINDOW w AS (PARTITION BY stream ORDER BY frame, i)) SELECT * FROM s WHERE x2 IS NOT NULL")
def polyline_segments(spark, sf_dir):
    return debug.segments(points(spark, sf_dir))


@query(f"WITH {POINTS} SELECT i, 'frame ' || frame || ' track ' || i % 10 AS line FROM pts")
def track_lines(spark, sf_dir):
    return points(spark, sf_dir).select("i", F.format_string("frame %d track %d", "frame", F.col("i") % 10).alias("line"))


@query(f"WITH {PIXELS}, {_DIFF} SELECT stream, frame, y, x, g FROM px UNION ALL SELECT stream, frame, y + 8, x, d FROM df")
def two_panel_stack(spark, sf_dir):
    p = pixels(spark, sf_dir)
    return debug.stacked(p, P.background_differences(p, LIBRARY).select("stream", "frame", "y", "x", F.col("d").alias("g")), 8)


@query("SELECT radius, noise, 'test_r' || radius || '_n' || noise AS stream FROM (VALUES (1), (5), (10)) a(radius), (VALUES (0), (25), (50)) b(noise)")
def grid_spec(spark, sf_dir):
    r, n = (spark.sql(f"SELECT * FROM VALUES {v} AS t({c})") for v, c in (("(1), (5), (10)", "radius"), ("(0), (25), (50)", "noise")))
    return r.crossJoin(n).select("radius", "noise", F.concat(F.lit("test_r"), "radius", F.lit("_n"), "noise").alias("stream"))


@query("SELECT i AS frame, trunc(640 / 3.0::DOUBLE + (i / 29.0::DOUBLE) * (640 * 2 / 3.0::DOUBLE - 640 / 3.0::DOUBLE))::INT AS x, 240 AS y FROM range(30) t(i)")
def lerp_path(spark, sf_dir):
    return spark.range(30).select(F.col("id").alias("frame"), F.expr("CAST(640 / 3.0D + (id / 29.0D) * (640 * 2 / 3.0D - 640 / 3.0D) AS INT)").alias("x"), F.lit(240).alias("y"))


_CLIPS = """v AS (SELECT DISTINCT 'v' || c_custkey || '.mkv' AS file, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 90 + 5.0::DOUBLE END AS duration_s FROM customer WHERE c_custkey % 5 != 0),
m AS (SELECT 'v' || o_custkey || '.mkv' AS file, greatest(0.0::DOUBLE, o_orderkey % 60 - 1.5::DOUBLE) AS s, (o_orderkey * 7) % 80 + 1.5::DOUBLE AS e FROM orders),
j AS (SELECT m.*, v.file IS NOT NULL AS there, duration_s, least(e, duration_s) AS z FROM m LEFT JOIN v USING (file)),
c AS (SELECT file, s AS start_s, z AS end_s, CASE WHEN e <= s THEN 'empty_range' WHEN NOT there THEN 'missing_video' WHEN s >= duration_s THEN 'start_after_end_of_video' WHEN z <= s THEN 'empty_after_clamp' ELSE 'ok' END AS status FROM j)"""


def _clips(spark, sf_dir):
    c = read(spark, sf_dir, "customer").where("c_custkey % 5 != 0")
    v = c.select(F.concat(F.lit("v"), "c_custkey", F.lit(".mkv")).alias("file"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey") % 90 + 5.0).alias("duration_s")).distinct()
    m = read(spark, sf_dir, "orders").select(F.concat(F.lit("v"), "o_custkey", F.lit(".mkv")).alias("file"), (F.col("o_orderkey") % 60).cast("string").alias("begin_s"), (F.col("o_orderkey") * 7 % 80).cast("string").alias("end_s"))
    return intervals.clip_plan(m, v, 1.5)


@query(f"WITH {_CLIPS} SELECT file, start_s, end_s, replace(file, '.mkv', '') || '_clip_' || format('{{:.3f}}', start_s) || '_' || format('{{:.3f}}', end_s) || '.mkv' AS clip_name FROM c WHERE status = 'ok'")
def clip_plan(spark, sf_dir):
    return _clips(spark, sf_dir).where("status = 'ok'").drop("status")


@query(f"WITH {_CLIPS} SELECT status, count(*)::BIGINT AS clips FROM c WHERE status != 'ok' GROUP BY 1")
def clip_plan_rejects(spark, sf_dir):
    return _clips(spark, sf_dir).where("status != 'ok'").groupBy("status").agg(F.count("*").alias("clips"))


@query(None)
def track_events_batch(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("area", F.lit(1.0))
    return tracker.track(p, Config(max_distance=10.0, min_distance=0.5), size=400.0)


@query(None)
def grid_video_events(spark, sf_dir):
    """The nine synthetic videos of 110 frames of 480 x 640 through the dense detector."""
    f = moving_spot(grid_spec(spark, sf_dir), 480, 640)
    e = video.detect(f, Config(alpha=0.3, min_area=50, max_distance=200.0))
    return e.groupBy("stream").agg(F.count("x").alias("events"), F.countDistinct("track_id").alias("tracks"))
