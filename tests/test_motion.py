import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenflow import plans
from lumenflow.config import COMMAND_LINE, COMMAND_LINE_VIEW, LIBRARY, LIBRARY_VIEW, Config
from lumenflow.operators import assign as assign_ops, debug, intervals, nearest, pixels as P, raster, segment, tracker, video
from lumenflow.operators.tracker import State, Track, assign, step
from lumenflow.sources.frames import NpyFrames, check_video_path, moving_spot
from lumenflow.sources import video as vs
from lumenflow.streaming.tracking import detect_stream, track_stream

SQL = plans.oracle_sql()
SCENE = Config(alpha=0.3, min_area=10, kernel=3, max_distance=50.0, min_distance=2.0, max_missed=3, min_span_ratio=0.0)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(plans.queries()[name], SQL[name])


def scene(centres):
    for c in centres:
        a = np.zeros((200, 200), np.uint8)
        if c:
            a[c[1] - 5 : c[1] + 6, c[0] - 5 : c[0] + 6] = 255
        yield a


def run_scene(centres):
    bg, state, out = raster.Background(SCENE), State(), []
    for f, a in enumerate(scene(centres)):
        out += step(state, f, raster.detections(bg.diff(a), SCENE), SCENE, 200.0)
    return [e for e in out if e[1] is not None]


def test_gap_keeps_one_track():
    e = run_scene([(50 + 4 * i, 50) for i in range(5)] + [None] * 3 + [(74 + 4 * i, 50) for i in range(5)])
    assert len({x[1] for x in e}) == 1 and len(e) >= 8


def test_far_apart_gives_two_tracks():
    e = run_scene([(50 + 4 * i, 50) for i in range(5)] + [None] * 5 + [(150 + 4 * i, 150) for i in range(5)])
    assert len({x[1] for x in e}) == 2


@pytest.mark.parametrize("noise", [0, 25, 50])
@pytest.mark.parametrize("radius", [1, 5, 10])
def test_grid_cell(radius, noise):
    c = Config(alpha=0.3, min_area=50, max_distance=200.0)
    rng, bg, state, n = np.random.default_rng(radius), raster.Background(c), State(), 0
    yy, xx = np.mgrid[:480, :640]
    for f in range(36):
        a = rng.integers(0, noise, (480, 640)).astype(np.uint8) if noise else np.zeros((480, 640), np.uint8)
        if 3 <= f < 33:
            a[(xx - int(213 + (f - 3) / 29 * 213)) ** 2 + (yy - 240) ** 2 <= radius**2] = 255
        n += sum(e[1] is not None for e in step(state, f, raster.detections(bg.diff(a), c), c, 640.0))
    assert n >= 10


def test_grid_query_has_all_frames(spark, monkeypatch):
    seen, detect = [], video.detect
    monkeypatch.setattr(video, "detect", lambda f, *a, **k: seen.append(f) or detect(f, *a, **k))
    events = plans.queries()["grid_video_events"](spark, "").collect()
    assert {r.stream: r["count"] for r in seen[0].groupBy("stream").count().collect()} == {r.stream: 110 for r in events}
    assert len(events) == 9 and all(r.events >= 10 for r in events)


def test_first_frame_and_alpha_one_have_no_difference():
    g = np.full((4, 4), 200, np.uint8)
    assert not raster.Background(LIBRARY).diff(g).any()
    b = raster.Background(Config(alpha=1.0, adaptive=False))
    b.diff(np.zeros_like(g))
    assert not b.diff(g).any()


def test_background_is_updated_before_the_difference():
    b = raster.Background(Config(alpha=0.5, adaptive=False))
    b.diff(np.zeros((1, 1), np.uint8))
    assert b.diff(np.full((1, 1), 101, np.uint8))[0, 0] == 101 - 50  # 50.5 is cut


def test_rates():
    assert LIBRARY.rates == (0.1, 0.1 * 0.2)
    assert Config(alpha_small=0.1, alpha_large=3.0).rates == (1.0, 0.1)
    assert COMMAND_LINE.min_consecutive == 6


def test_still_point_is_a_miss_and_stays_taken():
    s = State([Track(1, 0.0, 0.0)], 2)
    assert step(s, 1, [(1.0, 0.0, 9.0)], Config(min_distance=5.0)) == [(1, None, None, None)]
    assert s.tracks[0].misses == 1 and s.tracks[0].x == 0.0 and len(s.tracks) == 1


def test_confirmation_replays_pending_frames_over_gaps():
    c = Config(min_consecutive=2, min_distance=0.0, min_span_ratio=0.0)
    s = State()
    assert step(s, 0, [(0.0, 0.0, 1.0)], c) == [(0, None, None, None)]
    step(s, 1, [], c)
    step(s, 2, [(1.0, 0.0, 1.0)], c)
    assert [e[0] for e in step(s, 3, [(2.0, 0.0, 1.0)], c)] == [0, 2, 3]


def test_span_check_keeps_collecting():
    c = Config(min_consecutive=2, min_distance=0.0, min_span_ratio=0.5)
    s = State()
    for f in range(3):
        assert step(s, f, [(f * 2.0, 0.0, 1.0)], c, 10.0) == [(f, None, None, None)]
    assert len(step(s, 3, [(6.0, 0.0, 1.0)], c, 10.0)) == 4


@pytest.mark.parametrize("scan,merged", [("first_eligible", True), ("first_track", False)])
def test_merge_radius_and_scan(scan, merged):
    c = Config(min_consecutive=1, max_distance=25.0, merge_scan=scan, min_distance=0.0)
    other, lost = Track(1, 500.0, 0.0, confirmed=False), Track(2, 0.0, 0.0, confirmed=True, misses=1)
    new = Track(3, 4.0, 0.0, pending=[(5, 4.0, 0.0)])
    s = State([other, lost, new], 4)
    assert (tracker._merge_target(s.tracks, new, c) is lost) == merged
    new.pending = [(5, 6.0, 0.0)]  # 36 is beyond the unsquared radius of 25
    assert tracker._merge_target(s.tracks, new, c) is None


def test_expiry_and_greedy_ties():
    c = Config(max_missed=1)
    s = State([Track(1, 0.0, 0.0)], 2)
    for f in range(3):
        step(s, f, [], c)
    assert not s.tracks
    assert assign([Track(1, 0, 0), Track(2, 2, 0)], [(1, 0, 0), (1, 0, 0)], 10) == {0: 0, 1: 1}


def test_area_and_holes():
    box = np.ones((4, 6), bool)
    assert raster.polygon_area(box) == 15
    assert raster.polygon_area(np.ones((1, 9), bool)) == 0
    d = np.zeros((12, 12), np.uint8)
    d[1:11, 1:11] = 200
    d[3:9, 3:9] = 0
    d[5:7, 5:7] = 220  # nested in the hole: no blob of its own, but its pixels count for the peak
    got = raster.detections(d, Config(kernel=1))
    assert got == [(5.0, 5.0, 81.0)]


def test_palette():
    from lumenflow.functions.draw import PALETTE

    assert PALETTE == ((255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0), (255, 0, 255), (0, 255, 255), (128, 0, 255), (255, 128, 0))


def test_centroid_without_a_peak():
    assert raster.polygon_centroid(np.ones((3, 5), bool)) == (2.0, 1.0)
    corner = np.ones((2, 2), bool)
    corner[1, 1] = False
    assert np.allclose(raster.polygon_centroid(corner), (1 / 3, 1 / 3))
    got = raster.detections(np.zeros((6, 6), np.uint8), Config(kernel=1, diff_threshold=-1))
    assert got == [(2.5, 2.5, 25.0)]  # all is above the threshold, nothing above 0


def brute_greedy(pairs):
    out, tracks, points = [], set(), set()
    for s, f, d, t, i in sorted(pairs):
        if (s, f, t) not in tracks and (s, f, i) not in points:
            tracks.add((s, f, t))
            points.add((s, f, i))
            out.append((s, f, t, i))
    return sorted(out)


@pytest.mark.parametrize("rounds", [0, 1, 9])
def test_greedy_rounds_chains_and_ties(spark, rounds):
    rng = np.random.default_rng(5)
    pairs = [("a", int(rng.integers(0, 3)), float(rng.integers(0, 6)), t, i) for t in range(12) for i in range(12) if rng.random() < 0.5]
    for k in range(20):  # a chain: each pair bars the next one
        pairs.append(("chain", 0, float(k), (k + 1) // 2, k // 2))
    df = spark.createDataFrame(pairs, "stream string, frame int, dist_sq double, track int, i int")
    assert sorted((r.stream, r.frame, r.track, r.i) for r in assign_ops.greedy(df, rounds).collect()) == brute_greedy(pairs)


def brute_tracker(rows, c, size):
    """The tracker's rules once more, written out plainly: all pairs, one dict a track."""
    out = []
    for stream in sorted({r[0] for r in rows}):
        mine, tracks, born = [r for r in rows if r[0] == stream], [], 0
        for frame in range(min(r[1] for r in mine), max(r[1] for r in mine) + 1):
            here = sorted([r[2:] for r in mine if r[1] == frame], key=lambda p: (p[1], p[0]))
            near, events, used = {}, [], set()
            for d, t, j in sorted(((t["x"] - p[0]) ** 2 + (t["y"] - p[1]) ** 2, k, j) for k, t in enumerate(tracks) for j, p in enumerate(here)):
                if d <= c.max_distance**2 and t not in near and j not in used:
                    near[t] = j
                    used.add(j)
            for k, t in enumerate(list(tracks)):
                p = here[near[k]] if k in near else None
                if p is None or ((t["x"] - p[0]) ** 2 + (t["y"] - p[1]) ** 2) ** 0.5 < c.min_distance:
                    t["hits"], t["lost"] = 0, t["lost"] + 1
                    continue
                t.update(x=p[0], y=p[1], hits=t["hits"] + 1, lost=0)
                if t["sure"]:
                    events.append((frame, t["id"], *p[:2]))
                    continue
                t["wait"].append((frame, *p[:2]))
                wide = max(max(q[a] for q in t["wait"]) - min(q[a] for q in t["wait"]) for a in (1, 2))
                if t["hits"] >= c.min_consecutive and (len(t["wait"]) < 2 or wide >= c.min_span_ratio * size):
                    first = t["wait"][0]
                    old = [o for o in tracks if o is not t and o["sure"] and 1 <= o["lost"] <= c.max_missed and (o["x"] - first[1]) ** 2 + (o["y"] - first[2]) ** 2 <= c.max_distance]
                    if old:
                        t["id"] = old[0]["id"]
                        tracks.remove(t)
                        tracks[tracks.index(old[0])] = t
                    t["sure"] = True
                    events += [(q[0], t["id"], *q[1:]) for q in t["wait"]]
            tracks = [t for t in tracks if t["lost"] <= 2 * c.max_missed]
            for j, p in enumerate(here):
                if j not in used:
                    born += 1
                    tracks.append(dict(id=born, x=p[0], y=p[1], hits=1, lost=0, sure=False, wait=[(frame, *p[:2])]))
            out += [(stream, frame, n, *e) for n, e in enumerate(events or [(frame, None, None, None)])]
    return out


def test_tracker_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(s, int(f), float(x), float(y), 1.0) for s in "ab" for f in list(range(30)) + [34] for x, y in rng.integers(0, 40, (int(rng.integers(0, 14)), 2))]
    c = Config(max_distance=9.0, min_distance=0.5, min_consecutive=2, min_span_ratio=0.01)
    df = spark.createDataFrame(rows + [("a", 3, None, 1.0, 1.0)], "stream string, frame long, x double, y double, area double").repartition(3)
    got = sorted(map(tuple, tracker.track(df, c, size=40.0).collect()), key=lambda r: r[:3])
    assert got == brute_tracker(rows, c, 40.0) and len({r[4] for r in got}) > 5
    assert tracker.track(df.limit(0), c).count() == 0


@pytest.mark.parametrize("batch,kind", [(10000, "int"), (7, "string")])
def test_greedy_points_equals_greedy_of_pairs(spark, batch, kind, monkeypatch):
    monkeypatch.setattr(assign_ops, "stash", None)  # no pairs are written
    rng = np.random.default_rng(9)
    rows = [(str(s), int(f), int(n) if n % 11 else None, float(x), float(y)) for s in rng.integers(0, 2, 2) for f in range(3) for n, (x, y) in enumerate(np.tile(rng.integers(0, 9, (15, 2)), (2, 1)))]
    rows += [(None, 1, 7, 1.0, 1.0), ("1", None, 7, 1.0, 1.0), ("1", 1, 98, float("nan"), 1.0), ("1", 1, 99, None, 1.0)]
    p = spark.createDataFrame(rows, "stream string, frame int, i int, x double, y double").withColumn("i", F.col("i").cast(kind))
    t = p.select("stream", (F.col("frame") + 1).alias("frame"), F.col("i").alias("track"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    pairs = [(r.stream, r.frame, r.dist_sq, r.track, r.i) for r in assign_ops.candidate_pairs(t, p, 3.0).dropna().collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = assign_ops.greedy_points(t, p, 3.0)
        assert sorted(map(tuple, got.collect())) == brute_greedy(pairs) and len(pairs) > 300
        assert got.schema["track"].dataType == p.schema["i"].dataType
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("query", ["greedy_assignment", "unassigned_detections"])
def test_matching_writes_no_pairs(spark, query, monkeypatch):
    def none(*_):
        raise AssertionError("pairs are written")

    monkeypatch.setattr(assign_ops, "stash", none)
    assert plans.queries()[query](spark, "/root/testdata/sf0.001").count() > 0


def test_pairs_join_each_place_once(spark):
    rng = np.random.default_rng(8)
    rows = [(None if n == 5 else n, float(x), float(y)) for n, (x, y) in enumerate(np.tile(rng.integers(0, 9, (20, 2)), (4, 1)) * 0.7)]
    rows += [(90, None, 1.0), (91, float("nan"), 1.0), (92, -0.0, 0.0)]
    p = spark.createDataFrame([("s", 1, *r) for r in rows], "stream string, frame int, i int, x double, y double")
    t = p.toDF("stream", "frame", "track", "tx", "ty")
    got = assign_ops.candidate_pairs(t, p, 2.0, 3)
    want = [("s", 1, a, b, round((u - x) ** 2 + (v - y) ** 2, 3)) for a, u, v in rows for b, x, y in rows if None not in (u, x) and (u - x) ** 2 + (v - y) ** 2 <= 4.0]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("explode(is") < plan.index("explode(tracks") < plan.index("Join")  # copies are spread out after the join


def test_merge_candidates_join_each_place_once(spark):
    rng = np.random.default_rng(10)
    rows = [("s", int(f), n if n % 9 else None, float(x), float(y)) for n, (f, x, y) in enumerate(np.tile(rng.integers(0, 7, (25, 3)), (3, 1)))] + [("s", 3, 90, None, 1.0), ("s", 4, 91, 1.0, float("nan"))]
    p = spark.createDataFrame(rows, "stream string, frame int, track int, x double, y double")
    got = assign_ops.merge_candidates(p, p, 2, 4.0, 6)
    want = [("s", a, b, f, g, (x - u) ** 2 + (y - v) ** 2) for _, f, a, u, v in rows for _, g, b, x, y in rows if None not in (a, b, u, x) and a != b and 1 <= g - f <= 2 and (x - u) ** 2 + (y - v) ** 2 <= 4.0]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("explode(tracks") < plan.index("explode(olds") < plan.index("Join")


@pytest.mark.parametrize("pairs,chunk", [(1 << 21, 1 << 18), (40, 7), (3, 7)])
def test_nearest_first_equals_brute_force(monkeypatch, pairs, chunk):
    monkeypatch.setattr(nearest, "PAIRS", pairs)
    monkeypatch.setattr(nearest, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    for k in range(150):
        unit, radius, span = ((1.0, 0.01, 0.37)[k % 3], (0.0, 1.0, 5.0, 100.0)[k % 4], (3, 8, 40)[k % 5 % 3])
        (tx, ty, t), (px, py, p) = ((*(rng.integers(-span, span, n) * unit for _ in range(2)), rng.integers(0, n, n) if k % 7 == 0 else rng.permutation(n)) for n in (26, 31))
        tx[0], py[1] = np.inf, np.nan
        want = brute_greedy([("", 0, (a - u) * (a - u) + (b - v) * (b - v), int(i), int(j)) for a, b, i in zip(tx, ty, t) for u, v, j in zip(px, py, p) if (a - u) * (a - u) + (b - v) * (b - v) <= radius * radius])
        assert sorted(nearest.nearest_first(tx, ty, t, px, py, p, radius)) == [r[2:] for r in want]


@pytest.mark.parametrize("copies", [1, 60])
def test_crowded_frame_in_little_memory(copies):
    rng = np.random.default_rng(6)
    at = np.tile(rng.random((3000 // copies, 2)) * 10, (copies, 1)).tolist()
    tracks = [Track(i, x, y) for i, (x, y) in enumerate(at)]
    tracemalloc.start()
    got = assign(tracks, [(x + 0.001, y, 1.0) for x, y in at], 10.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) > 2900 and peak < 250e6  # all 8 million pairs with their distance, as lists, take 800 MB


def test_crowd_of_takeovers_is_quick():
    c = Config(max_distance=9.0, min_consecutive=1, min_distance=0.0, min_span_ratio=0.0)
    lost = [Track(i, 10.0 * i, 0.0, confirmed=True, misses=1) for i in range(3000)]
    new = [Track(3000 + i, 10.0 * i, 5.0, pending=[(0, 10.0 * i, 1.0)]) for i in range(3000)]
    s, began = State(lost + new, 6000), time.process_time()
    events = step(s, 1, [(10.0 * i, 6.0, 1.0) for i in range(3000)], c)
    assert time.process_time() - began < 2.0
    assert [t.track_id for t in s.tracks] == list(range(3000)) and {e[1] for e in events} == set(range(3000))


@pytest.mark.parametrize("config", [LIBRARY, Config(alpha=0.3, adaptive=False)])
def test_background_relation_equals_dense(spark, config):
    rng = np.random.default_rng(1)
    video = rng.integers(0, 256, (2, 25, 5, 6)).astype(np.uint8)
    px = spark.createDataFrame([(s, f, y, x, int(video[s, f, y, x])) for s in range(2) for f in range(25) for y in range(5) for x in range(6)], "stream int, frame int, y int, x int, g int")
    got = {(r.stream, r.frame, r.y, r.x): r.d for r in P.background_differences(px.repartition(3), config).collect()}
    for s in range(2):
        bg = raster.Background(config)
        for f in range(25):
            d = bg.diff(video[s, f])
            assert all(got[s, f, y, x] == d[y, x] for y in range(5) for x in range(6))


def test_background_waits_for_missing_pixels(spark):
    px = spark.createDataFrame([(None, 0, 0, 0, 10), (None, 1, 0, 1, 50), (None, 2, 0, 0, 110), (None, 2, 0, 1, 50)], "stream int, frame int, y int, x int, g int").coalesce(1)
    got = {(r.frame, r.x): r.d for r in P.background_differences(px, Config(alpha=0.5, adaptive=False)).collect()}
    assert got == {(0, 0): 0, (1, 1): 0, (2, 0): 50, (2, 1): 0}


def test_blob_relation_equals_dense(spark, monkeypatch):
    rng = np.random.default_rng(4)
    video = np.where(rng.random((40, 9, 11)) < 0.55, rng.integers(100, 255, (40, 9, 11)), 0).astype(np.uint8)
    video[0] = 0
    video[1, 1:8, 1:8], video[1, 2:7, 2:7], video[1, 4, 4] = 200, 0, 220  # a ring around a blob
    on = spark.createDataFrame([(int(f) // 10, int(f), int(y), int(x), int(video[f, y, x])) for f, y, x in zip(*np.nonzero(video > 90))], "stream int, frame int, y int, x int, g int")
    for cells in (1, 1 << 22):
        monkeypatch.setattr(segment, "CELLS", cells)
        b = segment.components(on, 11)
        areas, peaks = segment.areas(b), segment.peaks(b)
        got = {}
        for r in peaks.join(areas, segment.BLOB).collect():
            got.setdefault(r.frame, []).append((r.blob, (float(r.x), float(r.y), r.area)))
        for f in range(40):
            assert [x for _, x in sorted(got.get(f, []))] == raster.detections(video[f], Config(kernel=1, diff_threshold=90, min_area=0))


def test_pixel_relation_equals_dense(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 255, (9, 11)).astype(np.uint8)
    px = spark.createDataFrame([(0, 0, y, x, int(a[y, x])) for y in range(9) for x in range(11)], "stream int, frame int, y int, x int, g int")
    for k in (3, 5, 7):
        want = raster.clean(a, k)
        assert {(r.y, r.x): r.g for r in P.clean(px, k).collect()} == {(y, x): int(want[y, x]) for y in range(9) for x in range(11)}


def test_batch_video_and_npy_source(spark, tmp_path):
    f = moving_spot(spark.createDataFrame([("s", 5, 0)], "stream string, radius int, noise int"), 120, 160, blank=4, motion=12)
    e = video.detect(f, Config(alpha=0.3, min_area=20, max_distance=60.0))
    assert e.where("track_id IS NOT NULL").count() >= 8
    np.save(tmp_path / "s.npy", np.stack([np.frombuffer(r.data, np.uint8).reshape(r.height, r.width) for r in f.orderBy("frame").collect()]))
    spark.dataSource.register(NpyFrames)
    back = spark.read.format("npy_frames").option("frames_per_task", 5).load(str(tmp_path))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, f.collect()))
    with pytest.raises(ValueError):
        check_video_path(str(tmp_path / "s.npy"))


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(s, f, [(float(10 * i + 2 * f), float(30 * i), 1.0) for i in range(3) if rng.random() < 0.8]) for s in ("a", "b") for f in range(20)]
    schema = "stream string, frame long, points array<struct<x:double,y:double,area:double>>"
    c = Config(max_distance=15.0, min_distance=1.0, min_span_ratio=0.0)
    flat = spark.createDataFrame(rows, schema)
    points = flat.select("stream", "frame", F.inline("points"))
    want = sorted(map(repr, tracker.track(points, c, flat).collect()))
    order = rng.permutation(len(rows))
    for n, part in enumerate(np.array_split(order, 4)):  # out of order over the micro-batches
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    name = f"events_{int(time.time())}"
    q = track_stream(src, c).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(repr, spark.table(name).collect())) == want


def test_resize():
    a = np.arange(48, dtype=np.uint8).reshape(6, 8)
    assert raster.resize(a, None) is a and raster.resize(a, 6) is a
    assert (raster.resize(a, 3) == np.rint(a.reshape(3, 2, 4, 2).mean((1, 3)))).all()
    assert raster.resize(a, 4).shape == (4, 5) and raster.resize(a, 1).shape == (1, 1)
    assert raster.resize(np.dstack([a] * 3), 9).shape == (9, 12, 3)
    flat = np.full((5, 7, 3), 77, np.uint8)
    assert (raster.resize(flat, 11) == 77).all() and (raster.resize(flat, 2) == 77).all()
    assert raster.resize(np.array([[0, 100]], np.uint8), 2).tolist() == [[0, 25, 75, 100]] * 2
    with pytest.raises(ValueError):
        raster.resize(a, 0)


def test_mask_and_height_of_videos(spark):
    f = moving_spot(spark.createDataFrame([("s", 5, 0)], "stream string, radius int, noise int"), 120, 160, blank=4, motion=12)
    c = Config(alpha=0.3, min_area=5, max_distance=60.0, min_distance=1.0)
    half = video.detect(f, c, target_height=60).where("track_id IS NOT NULL")
    assert half.count() >= 8 and half.agg(F.max("y")).first()[0] < 60
    assert not video.detect(f, c, mask=(0, 0, 1, 1)).where("track_id IS NOT NULL").count()
    with pytest.raises(ValueError):
        video.detect(f, c, target_height=0)


def test_dense_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    f = moving_spot(spark.createDataFrame([("a", 5, 0), ("b", 4, 9)], "stream string, radius int, noise int"), 60, 80, blank=3, motion=10)
    c = Config(alpha=0.3, min_area=10, max_distance=60.0, min_distance=1.0)
    want = sorted(map(repr, video.detect(f, c, target_height=48).collect()))
    rows = f.orderBy("frame").collect()
    images = {s: np.stack([video.image_of(r) for r in rows if r.stream == s]) for s in "ab"}
    spark.dataSource.register(NpyFrames)
    name = f"dense_{int(time.time())}"

    def go_on():
        src = spark.readStream.format("npy_frames").option("frames_per_task", 4).load(str(tmp_path / "in"))
        sink = detect_stream(src, c, target_height=48).writeStream.format("parquet").option("path", str(tmp_path / name))
        assert (q := sink.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()).awaitTermination(120)
        assert q.exception() is None

    np.save(tmp_path / "in/a.npy", images["a"][:5])
    go_on()
    np.save(tmp_path / "in/a.npy", images["a"])  # grown
    np.save(tmp_path / "in/b.npy", images["b"])
    go_on()
    assert sorted(map(repr, spark.read.parquet(str(tmp_path / name)).collect())) == want


def test_clip_rules(spark):
    assert intervals.range_columns(["file", "begin_s", "end_s", "Start2", "stop2"]) == ("Start2", "stop2")
    with pytest.raises(ValueError):
        intervals.range_columns(["file", "from"])
    meta = spark.createDataFrame([("a.mp4", "1", "5"), ("a.mp4", "", "2"), ("b.mkv", "1", "3"), ("a.mp4", "5", "4"), ("a.mp4", "20", "30"), ("c", "0", "2")], "file string, start string, end string")
    vids = spark.createDataFrame([("a.mp4", 4.5), ("c", None)], "file string, duration_s double")
    got = {(r.file, r.start_s): (r.end_s, r.status, r.clip_name) for r in intervals.clip_plan(meta, vids).collect()}
    assert got[("a.mp4", 1.0)] == (4.5, "ok", "a_clip_1.000_4.500.mp4")
    assert got[("c", 0.0)][2] == "c_clip_0.000_2.000.mkv"
    assert {v[1] for v in got.values()} == {"ok", "missing_video", "empty_range", "start_after_end_of_video"}
    with pytest.raises(Exception, match="not a number"):
        intervals.clip_plan(spark.createDataFrame([("a.mp4", "x", "5")], "file string, start string, end string"), vids).collect()


def test_clip_metadata_and_outcomes(spark, tmp_path):
    vids = spark.createDataFrame([("a.mp4", 9.0)], "file string, duration_s double")
    (tmp_path / "m.csv").write_text('file,begin_s,end_s\na.mp4,1,"2"\n,1,2\na.mp4,,2\n', encoding="utf-8")
    code, plan = intervals.clips_command(spark, str(tmp_path / "m.csv"), vids)
    assert code == 0 and [r.clip_name for r in plan.collect()] == ["a_clip_1.000_2.000.mp4"]
    (tmp_path / "none.csv").write_text("")
    assert intervals.clips_command(spark, str(tmp_path / "none.csv"), vids) == (2, None)
    assert intervals.clips_command(spark, str(tmp_path / "missing.csv"), vids) == (2, None)
    cases = {(False, True, None, None, None): "copy_failed", (True, False, None, None, None): "removed_no_frames", (True, True, True, None, None): "copied",
             (True, True, False, False, None): "removed_reencode_failed", (True, True, False, True, True): "reencoded", (True, True, False, True, False): "removed_no_frames"}
    d = spark.createDataFrame(list(cases), "a boolean, b boolean, c boolean, d boolean, e boolean")
    got = d.select("*", intervals.clip_outcome(*(F.col(c) for c in "abcde")).alias("o")).collect()
    assert {tuple(r)[:5]: r.o for r in got} == cases


def test_video_sources_masks_and_cameras(spark, tmp_path):
    images = np.random.default_rng(0).integers(1, 255, (7, 6, 8, 3)).astype(np.uint8)
    (tmp_path / "v").mkdir()
    np.save(tmp_path / "x.npy", images)
    (tmp_path / "x.npy").rename(tmp_path / "v" / "x.mp4")
    opener = "lumenflow.sources.video:NpyCapture"
    got = list(vs.stream_frames(vs.FileSource(str(tmp_path / "v/x.mp4"), opener), mask=(0.5, 0.5, 1, 1)))
    assert [n for n, _ in got] == list(range(7)) and not got[3][1][3:, 4:].any() and (got[3][1][:3] == images[3, :3]).all()
    assert [i.shape for _, i in vs.stream_frames_from_file(str(tmp_path / "v/x.mp4"), target_height=3, opener=opener)] == [(3, 4, 3)] * 7
    assert vs.decodable(vs.FileSource(str(tmp_path / "v/x.mp4"), opener)) and not vs.decodable(Empty())
    assert not list(vs.stream_frames(Empty(), mask=(0, 0, 1, 1)))
    with pytest.raises(ValueError):
        vs.stream_frames(Empty(), target_height=0)
    spark.dataSource.register(vs.VideoFrames)
    df = spark.read.format("video_frames").option("opener", opener).option("target_height", 3).load(str(tmp_path / "v"))
    assert sorted((r.stream, r.frame, r.height, r.channels) for r in df.collect()) == [("x", i, 3, 3) for i in range(7)]
    camera = vs._Camera({"opener": "tests.test_motion:camera", "frames_per_batch": "2"})
    rows, end = camera.read(camera.initialOffset())
    assert [r[1] for r in rows] == [0, 1] and end == {"frame": 2} and len(list(camera.readBetweenOffsets({"frame": 0}, end))) == 2
    camera.commit(end)
    rows, end = camera.read(end)
    assert [r[1] for r in rows] == [2] and list(camera.read(end)[0]) == []


class Empty:
    def open(self):
        return self

    def read(self):
        return False, None

    def release(self):
        pass


class camera(Empty):
    def __init__(self, index):
        self.left = 3

    def read(self):
        self.left -= 1
        return self.left >= 0, np.zeros((2, 2), np.uint8)


def test_debug_panels_sink_and_draw_list(spark):
    f = moving_spot(spark.createDataFrame([("s", 5, 0)], "stream string, radius int, noise int"), 60, 80, blank=4, motion=12)
    c = Config(alpha=0.3, min_area=5, max_distance=60.0, min_distance=1.0)
    view = {r.frame: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3) for r in video.panels(f, c).collect()}
    image, bg = {r.frame: video.image_of(r) for r in f.collect()}, raster.Background(c)
    for k in range(20):
        want = np.vstack([image[k], bg.diff(image[k])])
        assert (view[k] == want[..., None]).all()
    seen = []

    class Sink(video.NullSink):
        def emit(self, frame, image, diff, events):
            seen.append((frame, len(events)))

    d = video.Detector(c, sink=Sink())
    n = [len(d.advance(k, image[k])) for k in range(20)]
    assert seen == list(enumerate(n))
    events = video.detect(f, c, sink=lambda stream: video.NullSink())
    drawn = debug.draw_list(events, 0, 10).collect()
    live = {(r.frame_number, r.track_id): (r.x, r.y) for r in events.collect() if r.track_id is not None and r.emit_frame == r.frame_number}
    boxes = {(r.frame, r.track): r for r in drawn if r.kind == "box"}
    assert set(boxes) == set(live) and all(r.x2 - r.x1 == 20 and r.x1 + 10 == int(live[k][0]) for k, r in boxes.items())
    assert sum(r.kind == "line" for r in drawn) == len(live) - len({t for _, t in live})


def test_presets():
    v = COMMAND_LINE_VIEW
    assert (v.target_height, v.mask, v.fps, v.box, v.buffer) == (1080, (0.8, 0.8, 1, 1), 30, 50, 6) and LIBRARY_VIEW.buffer == 0


def test_output_names(tmp_path):
    assert debug.output_name("", "/v/a.mkv", "mp4") == "/v/a_filtered.mp4"
    assert debug.output_name("/o/x.mp4", "/v/a.mkv", "gif") == "/o/a_filtered.gif"
    assert debug.output_name("/o/dir", "/v/a.mkv", "gif") == "/o/dir/a_filtered.gif"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
