import hashlib
import struct
import zlib

import pytest

from quillspan.sources import containers, dbd

TEXT = """COLUMNS
int ID
int<Other::ID> OtherID
float Scale
locstring Name_lang // shown
int Flags?

LAYOUT 0A1B2C3D
BUILD 1.7.0.4671-1.8.0.4714
COMMENT old
$id$ID<32>
Scale
Name_lang
Flags<u16>[2]

LAYOUT FFFFFFFF, 12345678
BUILD 9.2.5.44170, 9.2.7.1
$noninline,id$ID<32>
$noninline,relation$OtherID<32>
Flags<u64>
"""


def test_definitions():
    d = dbd.parse(TEXT)
    assert len(d.versions) == 2
    old, new = d.versions
    assert d.select(build="1.7.10.1") is old and d.select(build="1.8.0.4715") is None
    assert d.select(layout="12345678") is new and d.select(build="9.2.7.1") is new
    assert d.schema(old).simpleString() == "struct<ID:int,Scale:float,Name_lang:string,Flags:array<int>>"
    s = d.schema(new)
    assert s.simpleString() == "struct<ID:bigint,OtherID:bigint,Flags:decimal(20,0)>"
    assert s["ID"].metadata == {"role": "id"} and s["OtherID"].metadata == {"role": "relation"} and not s["ID"].nullable


def container(*blocks):
    head = b"".join(struct.pack(">II16s", len(b), n, hashlib.md5(b).digest()) for b, n in blocks)
    return b"BLTE" + struct.pack(">I", 12 + len(head)) + b"\x0f" + len(blocks).to_bytes(3) + head + b"".join(b for b, _ in blocks)


def test_containers(spark):
    inner = container((b"Nabc", 3))
    data = container((b"N" + b"x" * 5, 5), (b"Z" + zlib.compress(b"y" * 100), 100), (b"F" + inner, 3))
    want = b"xxxxx" + b"y" * 100 + b"abc"
    assert containers.decode(data) == want and containers.decode(b"BLTE\0\0\0\0Nq") == b"q"
    for bad in (b"", b"nope", data[:-1], data[:-1] + b"?"):
        with pytest.raises(ValueError):
            containers.decode(bad)
    df = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"zz")), ("c", None)], "path string, content binary")
    got = {r.path: r for r in containers.decoded(df).collect()}
    assert bytes(got["a"].content) == want and got["b"].error and got["c"].content is None
