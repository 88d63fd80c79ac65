"""Paint.NET documents as tables: one row per layer, and pixels.

Files come through Spark's binaryFile source, so any store that Spark reads will do; each is parsed in one task. The
object graph is the published .NET Remoting binary format; pixel buffers follow it as numbered chunks, gzip or raw.
A layer that can't be used becomes a warning; a file that can't be read is one row with an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: struct codes of primitive types by number
PRIMITIVES = {
    1: "?",
    2: "B",
    6: "<d",
    7: "<h",
    8: "<i",
    9: "<q",
    10: "b",
    11: "<f",
    14: "<H",
    15: "<I",
    16: "<Q",
}


class Reader:
    """Bytes with a place."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError(f"unexpected end of file at byte {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def unpack(self, code: str):
        return struct.unpack(code, self.take(struct.calcsize(code)))[0]

    def text(self) -> str:
        size = shift = 0
        for _ in range(5):
            byte = self.unpack("B")
            size |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return self.take(size).decode("utf-8", "replace")
        raise ValueError("a string's length takes more than 5 bytes")


class Reference:
    def __init__(self, target: int):
        self.target = target


class Nulls:
    def __init__(self, count: int):
        self.count = count


LIBRARY = object()


class Graph:
    """The objects of one stream; instances are dicts with their class under ''."""

    def __init__(self, reader: Reader):
        self.r, self.objects, self.classes, self.deferred = reader, {}, {}, []
        if reader.unpack("B") != 0:
            raise ValueError("the object graph has no header")
        self.root, *_ = struct.unpack("<iiii", reader.take(16))
        while self.record(top=True) is not None:
            pass
        for value in list(self.objects.values()):
            self._resolve(value)

    def _resolve(self, value) -> None:
        items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
        for k, v in list(items):
            if isinstance(v, Reference):
                if v.target not in self.objects:
                    raise ValueError(f"object {v.target} is missing")
                value[k] = self.objects[v.target]
            elif isinstance(v, list):
                self._resolve(v)

    def primitive(self, kind: int):
        if kind in PRIMITIVES:
            return self.r.unpack(PRIMITIVES[kind])
        if kind == 17:
            return None
        if kind == 18:
            return self.r.text()
        if kind == 3:  # one character in UTF-8, without a length
            first = self.r.take(1)
            return (first + self.r.take((first[0] >= 0xC0) + (first[0] >= 0xE0) + (first[0] >= 0xF0))).decode("utf-8", "replace")
        raise ValueError(f"primitive type {kind} isn't supported")

    def _type(self, kind: int):
        if kind in (0, 7):
            return self.r.unpack("B")
        if kind == 3:
            return self.r.text()
        if kind == 4:
            return self.r.text(), self.r.unpack("<i")
        return None

    def _class(self, typed: bool, library: bool):
        number, name = self.r.unpack("<i"), self.r.text()
        fields = [self.r.text() for _ in range(self.r.unpack("<i"))]
        kinds = [self.r.unpack("B") for _ in fields] if typed else [2] * len(fields)
        kinds = [(k, self._type(k)) for k in kinds] if typed else [(2, None)] * len(fields)
        if library:
            self.r.unpack("<i")
        self.classes[number] = name, fields, kinds
        return number, self.classes[number]

    def _values(self, kinds: list) -> list:
        out: list = []
        while len(out) < len(kinds):
            kind, info = kinds[len(out)]
            value = self.primitive(info) if kind == 0 else self.record()
            if value is LIBRARY:
                continue
            out += [None] * value.count if isinstance(value, Nulls) else [value]
        return out[: len(kinds)]

    def _instance(self, number: int, shape) -> dict:
        name, fields, kinds = shape
        value = dict(zip(fields, self._values(kinds)))
        value[""] = name
        self.objects[number] = value
        if name == "PaintDotNet.MemoryBlock" and value.get("deferred"):
            self.deferred.append(value)
        return value

    def _filled(self, number: int, value):
        self.objects[number] = value
        return value

    def _array(self) -> list | bytes:
        number, shape = self.r.unpack("<i"), self.r.unpack("B")
        sizes = [self.r.unpack("<i") for _ in range(self.r.unpack("<i"))]
        if shape >= 3:
            self.r.take(4 * len(sizes))  # lower bounds
        kind = self.r.unpack("B")
        info, n = self._type(kind), 1
        for s in sizes:
            n *= s
        flat = self.r.take(n) if (kind, info) == (0, 2) else self._values([(kind, info)] * n)
        for s in reversed(sizes[1:]):
            flat = [flat[i : i + s] for i in range(0, len(flat), s)]
        return self._filled(number, flat)

    def record(self, top: bool = False):
        kind = self.r.unpack("B")
        if kind == 11 and top:
            return None
        if kind == 1:
            number, known = self.r.unpack("<i"), self.r.unpack("<i")
            return self._instance(number, self.classes[known])
        if kind in (2, 3, 4, 5):
            return self._instance(*self._class(kind >= 4, kind in (3, 5)))
        if kind == 6:
            number = self.r.unpack("<i")
            return self._filled(number, self.r.text())
        if kind == 7:
            return self._array()
        if kind == 8:
            return self.primitive(self.r.unpack("B"))
        if kind == 9:
            return Reference(self.r.unpack("<i"))
        if kind == 10:
            return Nulls(1)
        if kind == 12:
            self.r.take(4)
            self.r.text()
            return LIBRARY
        if kind in (13, 14):
            return Nulls(self.r.unpack("B" if kind == 13 else "<i"))
        if kind in (15, 16, 17):
            number, n = self.r.unpack("<i"), self.r.unpack("<i")
            if kind == 15:
                info = self.r.unpack("B")
                return self._filled(number, self.r.take(n) if info == 2 else [self.primitive(info) for _ in range(n)])
            return self._filled(number, self._values([(1 if kind == 17 else 2, None)] * n))
        raise ValueError(f"record type {kind} isn't known")


def pixel_block(r: Reader, block: dict) -> bytes:
    """The bytes of a deferred block from its chunks, which may come in any order."""
    if block.get("hasParent"):
        raise ValueError("a pixel block with a parent isn't supported")
    size = block.get("length64", block.get("length"))
    if not isinstance(size, int) or size < 0:
        raise ValueError("a pixel block has no valid length")
    if not size:
        return b""
    form, step = r.unpack("B"), r.unpack(">I")
    if not step:
        raise ValueError("a pixel block's chunks are empty")
    if form not in (0, 1):
        raise ValueError(f"chunk format {form} isn't supported")
    chunks: dict[int, bytes] = {}
    n = -(-size // step)
    for _ in range(n):
        number, stored = r.unpack(">I"), r.unpack(">I")
        if number >= n or number in chunks:
            raise ValueError(f"chunk number {number} is {'repeated' if number in chunks else 'out of range'}")
        data = r.take(stored)
        chunks[number] = data = zlib.decompress(data, 31) if form == 0 else data
        if len(data) != min(step, size - number * step):
            raise ValueError(f"chunk {number} has an unexpected size")
    return b"".join(chunks[i] for i in range(n))


def _blend(layer: dict) -> tuple[int | None, str | None]:
    mode = (layer.get("Layer+properties") or {}).get("blendMode")
    if isinstance(mode, dict) and isinstance(mode.get("value__"), int):
        return mode["value__"], None
    op = (layer.get("properties") or {}).get("blendOp")
    return None, op[""].split("+")[-1].split(".")[-1] if isinstance(op, dict) else None


def parse(data: bytes) -> tuple[int, int, list[dict]]:
    """width, height and layers of a document; a layer that can't be used has a warning instead of pixels."""
    r = Reader(data)
    if r.take(4) != b"PDN3":
        raise ValueError("not a Paint.NET document")
    r.take(int.from_bytes(r.take(3), "little"))  # the XML header
    if r.take(2) != b"\0\1":
        raise ValueError("only deferred documents are supported")
    graph = Graph(r)
    for block in graph.deferred:
        block["raw"] = pixel_block(r, block)
    document = graph.objects.get(graph.root)
    width, height = (document or {}).get("width"), (document or {}).get("height")
    if not isinstance(width, int) or not isinstance(height, int) or width < 1 or height < 1:
        raise ValueError("the document has no valid size")
    held = document.get("layers") or {}
    items, n = held.get("ArrayList+_items"), held.get("ArrayList+_size")
    if not isinstance(items, list) or not isinstance(n, int):
        raise ValueError("the document's layers can't be read")
    layers = []
    for i, layer in enumerate(items[:n], 1):
        row = {"idx": i, "name": f"Layer {i}", "visible": None, "is_background": None, "opacity": None, "blend_id": None, "blend_class": None, "stride": None, "raw": None, "warning": None}
        layers.append(row)
        props = layer.get("Layer+properties") if isinstance(layer, dict) else None
        surface = layer.get("surface") if isinstance(layer, dict) else None
        scan = surface.get("scan0") if isinstance(surface, dict) else None
        if not isinstance(layer, dict):
            row["warning"] = "layer without metadata"
        elif layer[""] != "PaintDotNet.BitmapLayer":
            row["warning"] = f"layer type {layer['']} isn't supported"
        elif not isinstance(props, dict) or not isinstance(scan, dict):
            row["warning"] = "bitmap metadata is missing"
        elif (layer.get("Layer+width"), layer.get("Layer+height")) != (width, height):
            row["warning"] = "the layer's size isn't the document's"
        elif not isinstance(scan.get("raw"), bytes):
            row["warning"] = "no pixel buffer"
        else:
            opacity = props.get("opacity")
            blend_id, blend_class = _blend(layer)
            row.update(name=props.get("name") or row["name"], visible=props.get("visible") is not False, is_background=props.get("isBackground") is True, opacity=max(0, min(255, opacity if isinstance(opacity, int) else 255)),
                       blend_id=blend_id, blend_class=blend_class, stride=surface.get("stride") or 0, raw=scan["raw"])
    return width, height, layers


LAYERS = "file string, width int, height int, idx int, name string, visible boolean, is_background boolean, opacity int, blend_id int, blend_class string, stride int, raw binary, warning string, error string"
_NAMES = [c.split()[0] for c in LAYERS.split(", ")]


def read_layers(spark: SparkSession, path: str) -> DataFrame:
    """One row per layer of the documents under path (a file, a folder or a pattern)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"]):
                try:
                    width, height, layers = parse(bytes(content))
                    rows = [{"file": file, "width": width, "height": height, **layer} for layer in layers]
                except (ValueError, KeyError, struct.error, zlib.error) as e:
                    rows = [{"file": file, "error": str(e)}]
                out = pd.DataFrame(rows, columns=_NAMES, dtype=object)
                out = out.where(out.notna(), None)
                for c in ("width", "height", "idx", "opacity", "blend_id", "stride"):
                    out[c] = out[c].astype("Int32")
                yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, LAYERS)


def layer_pixels(layers: DataFrame) -> DataFrame:
    """file, idx, y, x, r, g, b, a of layers with a buffer: rows of `stride` bytes in the order B, G, R, A."""
    held = layers.filter("raw is not null")
    short = (F.col("stride") < F.col("width") * 4) | (F.octet_length("raw") < F.col("stride") * (F.col("height") - 1) + F.col("width") * 4)
    rows = held.withColumn("raw", F.when(short, F.raise_error(F.lit("pixel buffer too short"))).otherwise(F.col("raw")))
    line = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("line", F.substring(F.col("raw"), F.col("y") * F.col("stride") + 1, F.col("width") * 4)).drop("raw")
    place = line.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    byte = lambda i: F.conv(F.hex(F.substring(F.col("line"), F.col("x") * 4 + i + 1, F.lit(1))), 16, 10).cast("int")
    return place.select("file", "idx", "y", "x", byte(2).alias("r"), byte(1).alias("g"), byte(0).alias("b"), byte(3).alias("a"))
