"""Manifests, textures and videos written here and read back."""

import struct
import zlib

import numpy as np
import pytest

from quillspan.operators import files
from quillspan.sources import content, media

KEYS = [bytes([i]) * 16 for i in range(1, 6)]
#: Blocks of (content flags, locale flags, ids with their keys).
BLOCKS = [(0, 0x2, [(5, 0), (6, 1), (90, 2)]), (0x80, 0x2, [(7, 3)]), (content.NO_NAME_HASH, 0x22, [(2, 4), (5, 3)])]


def root(form):
    out = {"plain": b"", "old": b"TSFM" + struct.pack("<II", 9, 5)}.get(form, b"TSFM" + struct.pack("<IIIII", 0x18, int(form[1]) if form[0] == "v" else 0, 9, 5, 0))
    for flags, locale, entries in BLOCKS:
        out += struct.pack("<I", len(entries))
        out += struct.pack("<IIIB", locale, flags & 0xFFFFFF, flags & 0xFF000000, 0) if form == "v2" else struct.pack("<II", flags, locale)
        before = -1
        for i, _ in entries:
            out += struct.pack("<i", i - before - 1)
            before = i
        for _, k in entries:
            out += KEYS[k] + (bytes(8) if form == "plain" else b"")
        if form != "plain" and not flags & content.NO_NAME_HASH:
            out += bytes(8 * len(entries))
    return out


def encoding():
    head = b"EN\x01\x10\x10" + struct.pack(">HHII", 1, 1, 2, 0) + b"\0" + struct.pack(">I", 3)
    pages = [b"", b""]
    for i, k in enumerate(KEYS):
        pages[i // 3] += bytes([1 + i % 2]) + (2**33 + i).to_bytes(5) + k + bytes([100 + i]) * 16 + bytes(16) * (i % 2)
    return head + b"n\0\0" + bytes(2 * 32) + b"".join(p.ljust(1024, b"\0") for p in pages)


def index():
    entry = lambda i: bytes([100 + i]) * 16 + struct.pack(">II", 10 + i, 1000 * i)
    return entry(0) + bytes(16) + entry(2) + struct.pack("<I", 2) + bytes(8)


@pytest.mark.parametrize("form", ["plain", "old", "v1", "v2"])
def test_roots(form):
    rows = [r for b in content.root_blocks(root(form)) for r in b.to_pylist()]
    assert [(r["file_data_id"], r["ckey"], r["locale_flags"], r["content_flags"], r["ord"]) for r in rows] == [(i, KEYS[k].hex(), locale, flags, o) for o, (i, k, locale, flags) in enumerate((i, k, loc, fl) for fl, loc, e in BLOCKS for i, k in e)]


def test_resolved(spark, tmp_path):
    for name, data in (("root", root("v2")), ("encoding", encoding()), ("abc.index", index())):
        (tmp_path / name).write_bytes(data)
    at = lambda name: str(tmp_path / name)
    got = files.resolved(content.read_root(spark, at("root")), content.read_encoding(spark, at("encoding")), content.read_indexes(spark, at("abc.index")), files.LOCALE_BITS["enUS"])
    rows = {r.file_data_id: (r.ckey, r["size"], r.archive, r.length, r.offset) for r in got.collect()}
    assert rows == {5: (KEYS[0].hex(), 2**33, "abc", 10, 0), 6: (KEYS[1].hex(), 2**33 + 1, None, None, None), 90: (KEYS[2].hex(), 2**33 + 2, "abc", 12, 2000), 2: (KEYS[4].hex(), 2**33 + 4, None, None, None)}


def test_damaged_manifests():
    for parse, good in ((content.root_blocks, root("v1")), (content.encoding_pages, encoding())):
        with pytest.raises(ValueError):
            list(parse(good[:-1] if parse is content.root_blocks else good[:30]))
    assert list(content.index_entries(b"")) == []


def blp(stored, raw, depth=8, coded=0, size=(4, 4), palette=b""):
    at = 148 + len(palette)
    return b"BLP2" + struct.pack("<I", 1) + bytes([stored, depth, coded, 0]) + struct.pack("<II", *size) + struct.pack("<16I", at, *[0] * 15) + struct.pack("<16I", len(raw), *[0] * 15) + palette + raw


def test_textures():
    palette = bytes(x for i in range(256) for x in (i, i // 2, i // 4, 255 - i))
    got = media.texture(blp(1, bytes(range(0, 160, 10)), palette=palette))
    assert got[1, 1].tolist() == [12, 25, 50, 205] and got.shape == (4, 4, 4)
    assert media.texture(blp(3, bytes([1, 2, 3, 4]) * 2, size=(3, 1)))[0].tolist() == [[3, 2, 1, 4], [3, 2, 1, 4], [0, 0, 0, 255]]
    red, blue = 31 << 11, 31
    choices = sum((i % 4) << (2 * i) for i in range(16))
    opaque = media.texture(blp(2, struct.pack("<HHI", red, blue, choices), depth=0))
    assert opaque[0].tolist() == [[255, 0, 0, 255], [0, 0, 255, 255], [170, 0, 85, 255], [85, 0, 170, 255]]
    cut = media.texture(blp(2, struct.pack("<HHI", blue, red, choices), depth=1))
    assert cut[2].tolist() == [[0, 0, 255, 255], [255, 0, 0, 255], [127, 0, 127, 255], [0, 0, 0, 0]]
    explicit = media.texture(blp(2, bytes([0x10, 0x32, 0x54, 0x76, 0x98, 0xBA, 0xDC, 0xFE]) + struct.pack("<HHI", red, blue, choices)))
    assert explicit[:, :, 3].ravel().tolist() == [17 * i for i in range(16)]
    levels = sum((i % 8) << (3 * i) for i in range(16)).to_bytes(6, "little")
    smooth = media.texture(blp(2, bytes([210, 70]) + levels + struct.pack("<HHI", red, blue, choices), coded=7))
    assert smooth[:, :, 3].ravel().tolist() == [210, 70, 190, 170, 150, 130, 110, 90] * 2
    six = media.texture(blp(2, bytes([10, 110]) + levels + struct.pack("<HHI", red, blue, choices), coded=7))
    assert six[:2, :, 3].ravel().tolist() == [10, 110, 30, 50, 70, 90, 0, 255]


def test_png_export(spark):
    raw = blp(3, bytes(range(64)))
    got = {r.path: r for r in media.textures_as_png(spark.createDataFrame([("a", bytearray(raw)), ("b", bytearray(b"no"))], "path string, content binary")).collect()}
    assert got["b"].png is None and got["b"].error == "no texture"
    image = bytes(got["a"].png)
    assert image[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", image[16:24]) == (4, 4)
    lines = np.frombuffer(zlib.decompress(image[41 : 41 + struct.unpack(">I", image[33:37])[0]]), np.uint8).reshape(4, 17)
    assert (lines[:, 1:].reshape(4, 4, 4) == media.texture(raw)).all()


def chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def test_video(spark):
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", struct.pack("<I", 40_000) + bytes(52)) + chunk(b"LIST", b"strl" + chunk(b"strf", struct.pack("<III", 40, 640, 360) + bytes(28))))
    movie = chunk(b"LIST", b"movi" + chunk(b"00dc", b"abc") + chunk(b"01wb", b"sound") + chunk(b"00db", b"defg"))
    data = b"RIFF" + struct.pack("<I", 4 + len(head + movie)) + b"AVI " + head + movie
    info, _ = media.video_frames(data)
    assert info == {"width": 640, "height": 360, "frame_rate": 25.0}
    rows = media.frames(spark.createDataFrame([("v", bytearray(data)), ("x", None)], "path string, content binary")).collect()
    assert [tuple(r) for r in rows if r.path == "v"] == [("v", 0, "key", 0.0, 40_000.0, 3, None), ("v", 1, "key", 40_000.0, 40_000.0, 4, None)]
    assert [r.error for r in rows if r.path == "x"] == ["no video"]
