import pytest
from pyspark.sql import functions as F

from rasterloom.functions import options
from rasterloom.operators import ramps


def test_grammars():
    assert options.boolean("TRUE", False) and not options.boolean("", False) and options.boolean(None, True)
    with pytest.raises(ValueError):
        options.boolean("yes", False)
    assert options.boolean("on", False, options.WIDE) and not options.boolean("n", True, options.WIDE)
    assert options.lenient_boolean("yes", False) and not options.lenient_boolean("maybe", True)
    assert options.integer("7.9") == 7 and options.integer("") is None and options.number("", 2.5) == 2.5
    assert options.outline_kind("Square") == "8-way" and options.outline_kind("") == "4-way"
    with pytest.raises(ValueError):
        options.outline_kind("round")


def test_names(spark):
    assert options.identifier("Layer+properties") == "Layer_properties" and options.identifier("12_end") == "end_" and options.identifier("9") == "_"
    rows = spark.createDataFrame([("  a ", "t"), ("", "t"), (None, "t")], "v string, t string")
    assert [r[0] for r in rows.select(options.export_name(F.col("v"), F.col("t"))).collect()] == ["a", "t", "t"]
    files = spark.createDataFrame([("x.ASE",), ("y.aseprite",), ("z.png",)], "f string")
    assert [r[0] for r in files.select(options.base_name(F.col("f"))).collect()] == ["x", "y", "z.png"]


def test_accents_take_near_entries():
    at = lambda key, light, r, verbatim=False: {"key": key, "verbatim": verbatim, "r": r, "g": 0, "b": 0, "lab_l": light, "lab_a": 0.0, "lab_b": 0.0}
    held = [at(None, 0.5, 100)]
    new, found = ramps.merged_accents(held, [at(1, 0.9, 100), at(2, 0.52, 7), at(3, 0.52, 8, True), at(4, 0.8, 9), at(5, 0.81, 10)])
    assert [e["key"] for e in new] == [3, 4] and found[1] is held[0] and found[2] is held[0] and found[5]["key"] == 4
