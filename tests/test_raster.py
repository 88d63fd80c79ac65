"""Raster operators on small hand-made frames, and the registry's queries against their SQL."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import colour as C
from rasterloom.operators import clustering, cuts, export, grid, histogram, palette, pitch, ramps, stencil
from rasterloom.plans import pipelines, registry

SF = "/root/testdata/sf0.001"
PIXEL = "frame int, y int, x int, r int, g int, b int, a int"


def frame(spark, rows, number=0):
    """rows: lists of (r, g, b, a), or None for transparent."""
    return spark.createDataFrame([(number, y, x, *(p or (0, 0, 0, 0))) for y, row in enumerate(rows) for x, p in enumerate(row)], PIXEL)


RED, BLUE, WHITE = (255, 0, 0, 255), (0, 0, 255, 255), (250, 250, 250, 255)


def test_votes_tie_by_text_not_number(spark):
    px = frame(spark, [[(9, 0, 0, 255), (10, 0, 0, 255)], [(9, 0, 0, 255), (10, 0, 0, 255)]])
    voted = grid.vote(grid.cells(px, 2).drop("y", "x"), ["frame", "ty", "tx"]).first()
    assert (voted.r, voted.a) == (10, 255)


def test_opaque_vote_needs_its_share(spark):
    px = frame(spark, [[RED, None, None, None]] + [[None] * 4] * 3)
    cells = grid.cells(px, 4).drop("y", "x")
    assert grid.vote(cells, ["frame", "ty", "tx"], 0.30).first().a == 0
    assert grid.vote(cells, ["frame", "ty", "tx"], 0.05).first().r == 255


def test_runs_pool_rows_and_columns(spark):
    px = frame(spark, [[RED, RED, BLUE], [None, RED, BLUE]])
    found = {r.len: r.cnt for r in histogram.runs(px).collect()}
    assert found == {1: 4, 2: 3}  # rows: 2, 1, 1, 1; columns: 1, 2, 2


def test_profiles_of_a_step(spark):
    px = frame(spark, [[(0, 0, 0, 255)] * 2 + [(100, 100, 100, 255)] * 2] * 4)
    found = {(r.axis, r.pos): round(r.value, 6) for r in histogram.profiles(px).collect()}
    assert found["x", 1] == found["x", 2] == 400.0 and found["x", 0] == found["y", 1] == 0.0


def test_constant_series_correlates_as_zero(spark):
    series = spark.createDataFrame([(1, [5.0] * 10), (2, [0.0, 1.0] * 6)], "k int, values array<double>")
    found = {(r.k, r.period): r.r for r in pitch.autocorrelation(series, ["k"], 4).collect()}
    assert found[1, 2] == 0.0 and found[2, 2] == pytest.approx(1.0) and found[2, 3] == pytest.approx(-1.0)


def test_no_clear_pitch_is_a_status(spark):
    empty = spark.createDataFrame([], "frame int, base_pitch double, pitch double, clear boolean")
    assert pitch.common(empty).first().status == "no clear pitch"
    apart = spark.createDataFrame([(0, 2.0, 2.0, True), (1, 8.0, 8.0, True)], empty.schema)
    assert pitch.common(apart).first().status == "frames disagree"


def test_repair_fills_and_clears(spark):
    ring = [[RED] * 3, [RED, None, RED], [RED] * 3]
    assert stencil.repair(frame(spark, ring)).filter("y = 1 and x = 1").first().r == 255
    alone = [[None] * 3, [None, BLUE, None], [None] * 3]
    assert stencil.repair(frame(spark, alone)).filter("a > 0").count() == 0


def test_snap_takes_near_greys_only(spark):
    out = {(r.y, r.x): (r.r, r.g, r.b, r.a) for r in stencil.snap_neutral(frame(spark, [[(101, 100, 99, 40), (110, 100, 99, 255)]])).collect()}
    assert out[0, 0] == (100, 100, 100, 40) and out[0, 1] == (110, 100, 99, 255)


def test_outline_and_scale(spark):
    px = frame(spark, [[None] * 3, [None, RED, None], [None] * 3])
    assert stencil.outline(px, "4way").filter("r = 255 and g = 255").count() == 4
    assert stencil.outline(px, "square").filter("r = 255 and g = 255").count() == 8
    assert stencil.upscale(px, 10).filter("a > 0").count() == 100


def test_crop_and_regions(spark):
    px = frame(spark, [[None, RED], [None, None]])
    none = spark.createDataFrame([], "idx int, name string, bx int, by int, bw int, bh int")
    assert [tuple(r) for r in export.regions(none, 2, 2).collect()] == [("sprite", 0, 0, 2, 2)]
    two = spark.createDataFrame([(1, "", 1, 0, 1, 1), (2, "low", 0, 1, 2, 1)], none.schema)
    regions = export.regions(two, 2, 2)
    assert [r.label for r in export.nonempty(regions, px).collect()] == ["slice #1"]
    assert stencil.crop(px, regions).filter("label = 'slice #1'").first().x == 0
    with pytest.raises(Exception, match="outside the image"):
        export.regions(spark.createDataFrame([(1, "far", 1, 1, 5, 5)], none.schema), 2, 2).collect()


def test_names_continue_numbers(spark):
    names = spark.createDataFrame([("Goblin007", 1), ("Goblin007", 2), ("Goblin", 1), ("n99", 2), ("n99", 3)], "base string, i int")
    assert [r[0] for r in names.select(export.frame_name(F.col("base"), F.col("i"))).collect()] == ["Goblin007", "Goblin008", "Goblin001", "n100", "n101"]
    paths = spark.createDataFrame([("a/b/",), ("C:\\x\\y",), ("C:",), ("",)], "p string")
    assert [r[0] for r in paths.select(export.last_component(F.col("p"))).collect()] == ["b", "y", None, None]


def test_colour_conversions(spark):
    one = spark.createDataFrame([(255, 255, 255), (0, 0, 0), (255, 0, 0)], "r int, g int, b int")
    light, a, b = C.oklab(F.col("r"), F.col("g"), F.col("b"))
    white, black, red = one.select(light, C.chroma(a, b), C.hue(a, b)).collect()
    assert white[0] == pytest.approx(1, abs=1e-6) and white[1] < 1e-4 and black[0] == 0
    assert red[0] == pytest.approx(0.627955, abs=1e-5) and red[2] == pytest.approx(29.2339, abs=1e-2)


def test_circular_mean_crosses_zero(spark):
    hues = spark.createDataFrame([(350.0, 1), (10.0, 1)], "h double, w int")
    mean = hues.agg(palette.circular_mean("h", "w")).first()[0]
    assert min(mean % 360, 360 - mean % 360) < 1e-9
    assert hues.agg(palette.nearest_rank("h", 0.95)).first()[0] == 350.0
    assert hues.agg(pitch.lower_median("h")).first()[0] == 10.0


def test_minstd_is_the_published_generator():
    rng = clustering.Minstd(42)
    for _ in range(3):
        rng.fraction()
    assert rng.state == 1579310009


def test_kmeans_separates_two_groups(spark):
    rows = [(0, 10 + i, 10, 10, 5, i) for i in range(3)] + [(0, 200 + i, 10, 10, 5, 10 + i) for i in range(3)]
    hist = spark.createDataFrame(rows, "frame int, r int, g int, b int, n long, first_pos int")
    assert {r.r for r in clustering.quantised(hist, 2).collect()} == {11, 201}


def test_hue_clusters_and_elbow():
    import numpy as np

    hues, weights = np.array([5.0, 355.0, 120.0, 125.0, 240.0, 244.0]), np.ones(6)
    _, near = clustering.kmeans_hue(hues, weights, 3)
    assert near[0] == near[1] and near[2] == near[3] and near[4] == near[5] and len(set(near)) == 3
    assert clustering.elbow(hues, weights) == 2 and clustering.elbow(hues[:1], weights[:1]) == 1


def test_cut_lists():
    import numpy as np

    profile = np.zeros(32)
    profile[[4, 8, 13, 16, 20, 24, 28]] = 10
    assert cuts.snapped(profile, 4.0) == [0, 4, 8, 13, 16, 20, 24, 28, 32]
    assert cuts.regularised(profile, 8, 4.0) == [0, 4, 8, 13, 16, 20, 24, 28, 32]
    assert cuts.uniform(10, 3) == [0, 3, 6, 10] and cuts.uniform(0, 3) == [0]
    assert cuts.elastic([5, 9], 4, 20, 5) == [0, 5, 9, 15, 20] and cuts.elastic([], 4, 20, 5) == [0, 5, 10, 15, 20]
    assert cuts.segments(0, 19, [5, 15], 5.0) == [(0, 5), (5, 10), (10, 15), (15, 20)]
    assert cuts.anchored([], [], (0, 9, 0, 9), 10, 10, 2, 2) is None
    row_parts, column_parts, top, left = cuts.anchored([5], [5], (0, 9, 0, 9), 10, 10, 2, 2)
    assert row_parts == column_parts == [(0, 5), (5, 10)] and (top, left) == (0, 0)


def test_stop_budget_meets_target():
    stops = ramps.stop_budget(24, [0.5, 0.2, 0.9], 3, True, True, False)
    assert sum(stops) - 2 + 3 + 1 == 24 and ramps.stop_budget(8, [], 3, True, True, False) == []


def test_downscale_inverts_upscale(spark):
    import random

    rng = random.Random(3)
    small = [[(rng.randrange(256), rng.randrange(256), rng.randrange(256), 255) if rng.random() < 0.9 else None for _ in range(12)] for _ in range(12)]
    px = frame(spark, small)
    back, status = pipelines.downscale(stencil.upscale(px, 4))
    assert status == "ok"
    assert stencil.difference(px, back).first().asDict() == {"frame": 0, "compared": 144, "mismatched": 0}


def test_downscale_of_nothing_is_a_no_op(spark):
    clear = frame(spark, [[None] * 6] * 6)
    same, status = pipelines.downscale(clear)
    assert status == "no clear pitch" and same.count() == 36


def test_compress_keeps_alpha_and_place(spark):
    px = frame(spark, [[(40 * x, 20 * y, 200, 255 if x else 128) for x in range(6)] for y in range(6)])
    out, made = pipelines.compress(px, pipelines.Compress(clusters=2))
    rows = {(r.y, r.x): r for r in out.collect()}
    assert len(rows) == 36 and rows[0, 0].a == 128
    assert {(r.r, r.g, r.b) for r in rows.values()} <= {(r.r, r.g, r.b) for r in made.collect()}


def test_layers_need_visible_parents(spark):
    layers = spark.createDataFrame([(1, None, "group", False), (2, 1, "image", True), (3, None, "image", True)], "id long, parent_id long, kind string, visible boolean")
    assert [r.id for r in export.visible_layers(spark, "v", layers).collect()] == [3]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


def _key(row):
    return tuple((v is None, "" if v is None else round(v, 5) if isinstance(v, float) and math.isfinite(v) else v) for v in row)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, tables, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = tables.sql(registry.ORACLE_SQL[name])
    assert sorted(expected.columns) == columns
    places = [expected.columns.index(c) for c in columns]
    got = sorted(_key(tuple(r[c] for c in columns)) for r in df.collect())
    assert got == sorted(_key(tuple(r[i] for i in places)) for r in expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0
