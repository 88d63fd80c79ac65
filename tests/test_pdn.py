"""Paint.NET files written here byte by byte and read as tables."""

import gzip
import struct

from rasterloom.sources import pdn


def _text(s):
    data = s.encode()
    assert len(data) < 128
    return bytes([len(data)]) + data


def _class(number, name, fields, values, library=2):
    """A class with typed fields: (name, kind, extra bytes); values are encoded already."""
    out = b"\5" + struct.pack("<i", number) + _text(name) + struct.pack("<i", len(fields)) + b"".join(_text(f[0]) for f in fields)
    return out + bytes(f[1] for f in fields) + b"".join(f[2] for f in fields) + struct.pack("<i", library) + b"".join(values)


INT, BOOL, BYTE, OBJECT = (0, b"\x08"), (0, b"\1"), (0, b"\2"), (2, b"")


def _ref(n):
    return b"\x09" + struct.pack("<i", n)


def document(width=2, height=1, pixels=b"\1\2\3\4\5\6\7\x08", chunks=None, form=0, layer_width=None, kind="PaintDotNet.BitmapLayer", blend=5, magic=b"PDN3"):
    graph = b"\0" + struct.pack("<iiii", 1, -1, 1, 0) + b"\x0c" + struct.pack("<i", 2) + _text("PaintDotNet.Data")
    graph += _class(1, "PaintDotNet.Document", [("width", *INT), ("height", *INT), ("layers", *OBJECT)], [struct.pack("<i", width), struct.pack("<i", height), _ref(3)])
    graph += _class(3, "PaintDotNet.LayerList", [("ArrayList+_items", *OBJECT), ("ArrayList+_size", *INT)], [_ref(4), struct.pack("<i", 1)])
    graph += b"\x10" + struct.pack("<ii", 4, 4) + _ref(5) + b"\x0d\x03"
    graph += _class(5, kind, [("Layer+properties", *OBJECT), ("surface", *OBJECT), ("Layer+width", *INT), ("Layer+height", *INT)], [_ref(6), _ref(7), struct.pack("<i", layer_width or width), struct.pack("<i", height)])
    graph += _class(6, "PaintDotNet.Layer+LayerProperties", [("name", 1, b""), ("visible", *BOOL), ("isBackground", *BOOL), ("opacity", *BYTE), ("blendMode", *OBJECT)],
                    [b"\6" + struct.pack("<i", 9) + _text("Ink"), b"\1", b"\0", b"\x80", _ref(10)])
    graph += _class(10, "PaintDotNet.LayerBlendMode", [("value__", *INT)], [struct.pack("<i", blend)])
    graph += _class(7, "PaintDotNet.Surface", [("scan0", *OBJECT), ("stride", *INT)], [_ref(8), struct.pack("<i", width * 4)])
    graph += _class(8, "PaintDotNet.MemoryBlock", [("length64", 0, b"\x09"), ("hasParent", *BOOL), ("deferred", *BOOL)], [struct.pack("<q", len(pixels)), b"\0", b"\1"])
    step = 4
    parts = [pixels[i : i + step] for i in range(0, len(pixels), step)]
    body = bytes([form]) + struct.pack(">I", step)
    for i in chunks or range(len(parts)):
        data = gzip.compress(parts[i]) if form == 0 else parts[i]
        body += struct.pack(">II", i, len(data)) + data
    header = b"<pdnImage/>"
    return magic + len(header).to_bytes(3, "little") + header + b"\0\1" + graph + b"\x0b" + body


def test_layers_and_pixels(spark, tmp_path):
    (tmp_path / "a.pdn").write_bytes(document())
    (tmp_path / "b.pdn").write_bytes(document(chunks=[1, 0], form=1))
    layers = pdn.read_layers(spark, f"file://{tmp_path}/*.pdn")
    rows = layers.orderBy("file").collect()
    assert [(r.name, r.visible, r.is_background, r.opacity, r.blend_id, r.stride, r.error, r.warning) for r in rows] == [("Ink", True, False, 128, 5, 8, None, None)] * 2
    pixels = sorted(tuple(r)[2:] for r in pdn.layer_pixels(layers).filter("file like '%a.pdn'").collect())
    assert pixels == [(0, 0, 3, 2, 1, 4), (0, 1, 7, 6, 5, 8)]
    assert pdn.layer_pixels(layers).count() == 4


def test_bad_files_and_layers(spark, tmp_path):
    for name, data in {
        "magic": document(magic=b"PDN2"), "repeat": document(chunks=[0, 0]), "cut": document()[:-3], "size": document(layer_width=3), "kind": document(kind="PaintDotNet.OtherLayer"),
    }.items():
        (tmp_path / name).write_bytes(data)
    found = {r.file.rsplit("/", 1)[1]: (r.error, r.warning) for r in pdn.read_layers(spark, f"file://{tmp_path}").collect()}
    assert found["magic"][0] == "not a Paint.NET document" and "repeated" in found["repeat"][0] and "end of file" in found["cut"][0]
    assert "size" in found["size"][1] and "isn't supported" in found["kind"][1]
