"""Round trips: files are written here byte by byte and read back."""

import hashlib
import struct

import pytest

from quillspan.sources import cipher, containers, dbd, logfile, tables

TEXT = """COLUMNS
int ID
int<Parent::ID> ParentID
int Small
int Packed
int Signed
int Common
float Scale
int Pair
int Big
string Name

LAYOUT 0BADF00D
BUILD 1.0.0.1
$noninline,id$ID<32>
$noninline,relation$ParentID<32>
Small<8>
Packed<u16>
Signed<32>
Common<32>
Scale
Pair<32>[2]
Big<u64>
Name

LAYOUT 0000BEEF
BUILD 1.0.0.2
$noninline,id$ID<32>
Name
Small<16>[2]
"""
#: Small, 10 bits of Packed, 6 of Signed, an index each for Scale and Pair; then Big and Name.
ROWS = {
    1: [(5, -3, 700, -7, 0, 1, 2**63 + 1, "one"), (6, 100, 3, 31, 1, 0, 7, "")],
    2: [(9, -128, 1023, -32, 1, 1, 0, "zwei ü")],
}
SCALES, PAIRS, COMMON = [1.5, -2.0], [[10, -11], [20, 21]], {6: 99}


def storage(bit, size, kind=0, extra=0, a=0, b=0, c=0):
    return struct.pack("<HHIIIII", bit, size, extra, kind, a, b, c)


def header(version, layout, records, record_size, flags, infos, pallet, common, sections):
    magic = f"WDC{version}".encode() + (bytes(132) if version == 5 else b"")
    head = struct.pack("<IIIIIIIIIHHIIIIIII", records, len(infos), record_size, 0, 1, layout, 0, 0, 0, flags, 0, len(infos), 0, 0, 24 * len(infos), len(common), len(pallet), sections)
    return magic + head


def dense(version, locked=False):
    infos = [storage(0, 8), storage(8, 10, 1), storage(18, 6, 5), storage(0, 0, 2, 8, 42), storage(24, 1, 3, 8), storage(25, 1, 4, 16, c=2), storage(32, 64), storage(96, 32)]
    size, total = 16, sum(map(len, ROWS.values()))
    pallet = struct.pack("<2f", *SCALES) + struct.pack("<4i", *[x for p in PAIRS for x in p])
    common = b"".join(struct.pack("<II", *x) for x in COMMON.items())
    names, place, texts = {}, 0, []
    for rows in ROWS.values():
        block = b"\0"
        for r in rows:
            if r[-1]:
                names[r[-1]] = place + len(block)
                block += r[-1].encode() + b"\0"
        texts.append(block)
        place += len(block)
    bodies, at = [], 0
    for k, rows in enumerate(ROWS.values()):
        body = b""
        for _, small, packed, signed, scale, pair, big, name in rows:
            bits = (small & 255) | packed << 8 | (signed & 63) << 18 | scale << 24 | pair << 25
            ref = names[name] + total * size - (at + 12) if name else 0
            body += struct.pack("<IQI", bits, big, ref)
            at += size
        bodies.append(bytes(len(body)) if locked and k == 1 else body)
    heads, parts = b"", b""
    for k, (rows, body, text) in enumerate(zip(ROWS.values(), bodies, texts, strict=True)):
        relations = struct.pack("<III", 1, 0, 0) + struct.pack("<II", 77, 0) if k == 0 else b""
        copies = [(50, 5), (51, 404)] if k == 0 else []
        heads += struct.pack("<QIIIIIIII", 123 if k == 1 else 0, 0, len(rows), len(text), 0, 4 * len(rows), len(relations), 0, len(copies))
        parts += body + text + b"".join(struct.pack("<I", r[0]) for r in rows) + b"".join(struct.pack("<II", *c) for c in copies) + relations
    extra = struct.pack("<II", 1, 9) if version > 3 else b""
    return header(version, 0x0BADF00D, total, size, 0, infos, pallet, common, 2) + heads + bytes(4 * len(infos)) + b"".join(infos) + pallet + common + extra + parts


def sparse():
    infos = [storage(0, 32), storage(32, 32)]
    rows = {3: ("abc", 1, -2), 8: ("", 30, 40)}
    fixed = header(3, 0xBEEF, 2, 0, 1, infos, b"", b"", 1)
    begin = len(fixed) + 40 + 8 + 48
    body, spans = b"", b""
    for name, *small in rows.values():
        record = name.encode() + b"\0" + struct.pack("<2h", *small)
        spans += struct.pack("<IH", begin + len(body), len(record))
        body += record
    head = struct.pack("<QIIIIIIII", 0, begin, 2, 0, begin + len(body), 8, 0, 2, 0)
    ids = struct.pack("<2I", *rows)
    return fixed + head + bytes(8) + b"".join(infos) + body + ids + spans + ids


def expected(ids):
    for rows in ROWS.values():
        for i, small, packed, signed, scale, pair, big, name in rows:
            for out in [i] + ([50] if i == 5 else []):
                if i in ids:
                    yield (out, 77 if i == 5 else 0, small, packed, signed, COMMON.get(i, 42), SCALES[scale], PAIRS[pair], big, name)


@pytest.mark.parametrize("version", [3, 4, 5])
def test_dense_tables(spark, tmp_path, version):
    (tmp_path / "t.db2").write_bytes(dense(version))
    df = tables.read_table(spark, str(tmp_path), dbd.parse(TEXT))
    got = [tuple(r[:-2]) + (int(r[-2]), r[-1]) for r in df.collect()]
    assert sorted(got) == sorted(expected({5, 6, 9}))
    assert df.schema["ID"].metadata == {"role": "id"} and df.schema["ParentID"].metadata == {"role": "relation"}


def test_locked_section_is_left_out(spark, tmp_path):
    (tmp_path / "t.db2").write_bytes(dense(4, locked=True))
    assert {r.ID for r in tables.read_table(spark, str(tmp_path), dbd.parse(TEXT)).collect()} == {5, 6, 50}


def test_sparse_table(spark, tmp_path):
    (tmp_path / "t.db2").write_bytes(sparse())
    got = tables.read_table(spark, str(tmp_path), dbd.parse(TEXT), "1.0.0.2").collect()
    assert sorted(map(tuple, got)) == [(3, "abc", [1, -2]), (8, "", [30, 40])]


def test_damaged_tables():
    good = dense(3)
    for bad in (b"", b"WDC9" + good[4:], good[:100], good[:-30]):
        with pytest.raises(ValueError):
            tables.parse(bad)


def test_stream_cipher():
    """The first published vector for keys of 128 bits."""
    key = bytes([0x80] + [0] * 15)
    assert cipher.salsa20(key, bytes(8), bytes(16)).hex() == "4dfa5e481da23ea09a31022050859936"
    assert cipher.salsa20(key, b"1234", cipher.salsa20(key, b"1234", b"a" * 1000)) == b"a" * 1000


def test_enciphered_blocks():
    name, key = "00112233445566aa", "0f" * 16
    keys = cipher.parsed_keys(f"{name.upper()} {key}\nshort 1\n")
    assert keys == cipher.parsed_keys(f'{{"{name}": "{key}", "x": "y"}}') == {name: bytes.fromhex(key)}
    blocks = []
    for i in range(2):
        inner = b"N" + b"secret%d" % i
        nonce = bytes([1 ^ i, 2, 3, 4])
        blocks.append(b"E\x08" + bytes.fromhex(name)[::-1] + b"\x04" + bytes([1, 2, 3, 4]) + b"S" + cipher.salsa20(keys[name], nonce, inner))
    blocks.append(b"Nplain")
    entries = b"".join(struct.pack(">II", len(b), n) + hashlib.md5(b).digest() for b, n in zip(blocks, (7, 7, 5), strict=True))
    data = b"BLTE" + struct.pack(">I", 12 + len(entries)) + b"\x0f" + (3).to_bytes(3) + entries + b"".join(blocks)
    assert containers.decode(data, keys=keys) == b"secret0secret1plain"
    assert containers.decode(data, partial=True) == bytes(14) + b"plain"
    with pytest.raises(containers.MissingKey, match=name):
        containers.decode(data)


LOGS = {
    1: ("<4siiIIB3x", lambda p, t, r, n, s: (p, n, t, r, s)),
    4: ("<4s4xiiIIB3x", lambda p, t, r, n, s: (p, n, t, r, s)),
    7: ("<4siIIiB3x", lambda p, t, r, n, s: (p, t, r, n, s)),
    8: ("<4siIIIiB3x", lambda p, t, r, n, s: (p, 900, t, r, n, s)),
    9: ("<4sIiIIIiB3x", lambda p, t, r, n, s: (4, p, 900, t, r, n, s)),
}


def log(version, layout):
    form, order = LOGS[layout]
    head = struct.pack("<4sIi", b"XFTH", version, 4711) + bytes(32 if version >= 5 else 0)
    return head + b"".join(struct.pack(form, b"XFTH", *order(p, 5, r, len(raw), s)) + raw for p, r, s, raw in ((10, 1, 1, b"abc"), (11, 2, 0, b""), (11, 3, 1, b"XFTHzz")))


@pytest.mark.parametrize(("version", "layout"), [(1, 1), (3, 4), (7, 7), (8, 8), (8, 7), (9, 9)])
def test_change_log(spark, tmp_path, version, layout):
    (tmp_path / "log.bin").write_bytes(log(version, layout))
    got = logfile.read_log(spark, str(tmp_path), rows=2).orderBy("record_id").collect()
    assert [(r.build, r.push_id, r.table_hash, r.record_id, r.status, bytes(r.raw_data)) for r in got] == [(4711, 10, 5, 1, 1, b"abc"), (4711, 11, 5, 2, 0, b""), (4711, 11, 5, 3, 1, b"XFTHzz")]
    assert {r.unique_id for r in got} == ({900} if layout > 7 else {None}) and {r.region_id for r in got} == ({4} if layout == 9 else {None})


def test_damaged_change_logs():
    good = log(9, 9)
    for bad in (b"", b"XFTH", b"YFTH" + good[4:], good[:4] + b"\x0a" + good[5:], good[:-1], good + b"x"):
        with pytest.raises(logfile.CorruptLog):
            list(logfile.records(bad)[1])
