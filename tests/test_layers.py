"""Layers, reports, files and options on small tables; the registered queries hold them against SQL."""

import pytest
from pyspark.sql import functions as F

from rasterloom.functions import options
from rasterloom.operators import cuts, grid, layers, ramps, reports
from rasterloom.plans import pipelines
from rasterloom.sources import images, pdn, writers

PX = "frame int, y int, x int, r int, g int, b int, a int"


def test_composite_lays_by_order_and_opacity(spark):
    rows = [(1, 128, 0, 0, 0, 255, 0, 0, 255), (0, 255, 0, 0, 0, 0, 0, 255, 255), (1, 255, 0, 0, 1, 9, 9, 9, 0), (0, 255, 0, 0, 1, 7, 7, 7, 0), (1, 255, 0, 0, 2, 10, 20, 30, 102)]
    got = {r.x: tuple(r)[3:] for r in layers.composite(spark.createDataFrame(rows, "z int, opacity int, " + PX)).collect()}
    assert got == {0: (128, 0, 127, 255), 1: (0, 0, 0, 0), 2: (10, 20, 30, 102)}


def test_layers_that_dont_show_are_an_error(spark):
    held = spark.createDataFrame([(1, None, "group", False, False), (2, 1, "image", True, False), (3, None, "image", True, True)], "id long, parent_id long, kind string, visible boolean, is_background boolean")
    with pytest.raises(Exception, match="no visible layer"):
        layers.working_layers(held).collect()
    assert {r.id for r in layers.working_layers(held.withColumn("visible", F.lit(True))).collect()} == {1, 2}


def test_palette_of_many_colours_is_reduced(spark):
    many = spark.range(300).selectExpr("0 as frame", "0 as y", "cast(id as int) as x", "cast(id % 256 as int) as r", "cast(id div 2 as int) as g", "0 as b", "255 as a")
    few = layers.reduced_palette(many, 16).collect()
    assert len(few) <= 16 and sum(r.n for r in few) == 300 and layers.reduced_palette(many).count() <= 256


def test_names_and_summary(spark):
    names = spark.createDataFrame([("Ink",), ("Ink 2",), ("Ink 4",), ("Inkwell",)], "name string")
    assert [r.name for r in layers.free_names(names, spark.createDataFrame([("Ink",)], "base string")).collect()] == ["Ink 3"]
    assert [r.name for r in layers.free_names(names, spark.createDataFrame([("Wash",)], "base string")).collect()] == ["Wash"]
    regions = spark.createDataFrame([("a",), ("b",)], "label string")
    out = spark.createDataFrame([("a", 0), ("a", 1), ("a", 1)], "label string, frame int")
    assert layers.summary(out, regions, regions.limit(1)).first().message == "2 images of 1 regions; background layers ignored; 1 empty regions left out"
    read = spark.createDataFrame([("f", 2, "Ink", "later", None), ("f", 1, "Wash", "first", None), ("g", None, None, None, "broken"), ("h", 1, "x", None, None)], "file string, idx int, name string, warning string, error string")
    assert {r.file: r.message for r in layers.warnings(read).collect()} == {"f": "Wash: first\nInk: later", "g": "broken"}


def test_files_come_back(spark, tmp_path):
    px = spark.createDataFrame([(f, y, x, 10 * x, 20 * y, f, 255 if x else 0) for f in range(2) for y in range(3) for x in range(2)], PX)
    writers.save(writers.images(px), f"file://{tmp_path}/png")
    assert sorted(map(tuple, images.read_pixels(spark, f"file://{tmp_path}/png").collect())) == sorted(map(tuple, px.collect()))
    held = px.selectExpr("*", "0 as z", "repeat('name ', 40) as layer", "true as visible", "true as is_background", "200 as opacity", "2 as blend")
    writers.save(writers.documents(held), f"file://{tmp_path}/pdn")
    read = pdn.read_layers(spark, f"file://{tmp_path}/pdn")
    assert [(r.name, r.opacity, r.blend_id, r.error) for r in read.collect()] == [("name " * 40, 200, 2, None)] * 2
    writers.import_layers(read, pdn.layer_pixels(read), f"file://{tmp_path}/out")
    kept = spark.read.parquet(f"file://{tmp_path}/out/layers").collect()
    assert not any(r.is_background for r in kept) and spark.read.parquet(f"file://{tmp_path}/out/pixels").count() == 12


def test_comparison_of_other_sizes(spark):
    def block(w, h, r=1):
        return spark.createDataFrame([(0, y, x, r, 0, 0, 255) for y in range(h) for x in range(w)], PX)

    status = lambda a, b: tuple(reports.compared(a, b).first())[1:]
    assert status(block(5, 5), block(5, 5)) == (25, 0, "equal") and status(block(5, 5), block(3, 5)) == (15, 0, "equal")
    assert status(block(5, 5), block(2, 5)) == (0, 0, "size") and status(block(5, 5), block(5, 5, 2)) == (25, 25, "different")
    assert reports.compared(block(2, 2), block(2, 2).filter("false")).first().status == "size"
    assert [(r.y, r.x) for r in reports.first_mismatches(block(5, 5), block(5, 5, 2), 3).orderBy("y", "x").collect()] == [(0, 0), (0, 1), (0, 2)]


def test_option_columns_refuse_other_words(spark):
    rows = spark.createDataFrame([("maybe",)], "v string")
    for column in (options.boolean_column(F.col("v"), True), options.outline_column(F.col("v"))):
        with pytest.raises(Exception, match="not a"):
            rows.select(column).collect()
    odd = spark.createDataFrame([("\t x\n", "a\\b\\c.d.png"), (None, None)], "v string, p string")
    assert [tuple(r) for r in odd.select(options.export_name(F.col("v"), F.lit("t")), options.default_name(F.col("p")), options.joined_path(F.col("v"), F.lit("n"))).collect()] == [("x", "c.d", "\t x\n/n"), ("t", "sprite", "n")]


def test_cells_of_the_test_tools(spark):
    rows = spark.createDataFrame([(10, 4), (9, 3), (11, 3)], "span int, n int").select(grid.spread_widths(F.col("span"), F.col("n")).alias("w"))
    assert [r.w for r in rows.collect()] == [[3, 2, 3, 2], [3, 3, 3], [4, 4, 3]]
    assert [tuple(c) for c in rows.select(grid.boundaries(F.lit(2), F.col("w")).alias("b")).first().b] == [(2, 5), (5, 7), (7, 10), (10, 12)]
    tie = spark.createDataFrame([(0, 0, x, r, 0, 0, 255) for x, r in enumerate((10, 9, 9, 10))], PX).withColumn("c", F.lit(0))
    assert grid.first_seen_vote(tie, ["c"]).first().r == 10 and grid.transitions(tie, 1).count() == 0 and grid.transitions(tie).count() == 2
    assert cuts.uniform(7, 3) == [0, 2, 4, 7]


def test_styles_share_ends(spark):
    entries = spark.createDataFrame([(i, c, 40 + 9 * i, 200 - 11 * i, 30 * c, 0.2 + 0.06 * i, 0.05 * c + 0.02, 0.04 - 0.01 * c, 0.05 + 0.02 * c, 90.0 * c + i, 10) for i in range(9) for c in range(2)],
                                    "key int, cluster int, r int, g int, b int, lab_l double, lab_a double, lab_b double, chroma double, hue double, w int")
    wide, own = ramps.Style(preserve_contrast=False, shared_highlight=True), ramps.Style()
    assert wide.light_end and not own.light_end and not ramps.Style(shared_highlight=True).light_end
    made = ramps.shared_end(ramps.chromatic(entries, None, wide), True).collect()
    last = {r.ramp: (r.r, r.g, r.b) for r in made if r.stop == r.n}
    assert len(last) == 2 and len(set(last.values())) == 1
    brighter = {r.ramp: r.lightness for r in ramps.chromatic(entries, None, wide).collect() if r.stop == r.n}
    assert all(brighter[r.ramp] > r.lightness for r in ramps.chromatic(entries, None, own).collect() if r.stop == r.n)


def test_compress_takes_a_style(spark):
    px = spark.createDataFrame([(0, y, x, 20 * x, 240 - 25 * y, 12 * (x + y), 255) for y in range(9) for x in range(12)], PX)
    plain, pal = pipelines.compress(px, pipelines.Compress(target=16))
    styled, other = pipelines.compress(px, pipelines.Compress(target=16, style=ramps.Style(strength=1.0, preserve_contrast=False, shared_highlight=True)))
    assert plain.count() == styled.count() == 108 and pal.filter("kind = 'shared'").count() == 1 and other.filter("kind = 'shared'").count() == 2
    assert {tuple(r) for r in styled.select("r", "g", "b").collect()} <= {tuple(r) for r in other.select("r", "g", "b").collect()}
