"""Block containers: raw, compressed, nested and enciphered blocks behind a checked header, decoded in Arrow batches."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .cipher import Keys, salsa20


class MissingKey(ValueError):
    """A block's key is not on the ring."""


def deciphered(body: bytes, index: int, keys: Keys) -> bytes:
    """The block inside an enciphered one: key name and nonce with their lengths, the cipher's letter, the text."""
    try:
        named, body = body[1 : 1 + body[0]], body[1 + body[0] :]
        nonce, body = body[1 : 1 + body[0]], body[1 + body[0] :]
        letter, body = body[0], body[1:]
    except IndexError:
        raise ValueError("enciphered block is cut short") from None
    if len(named) != 8 or len(nonce) not in (4, 8) or letter != ord("S"):
        raise ValueError("enciphered block of an unknown form")
    name = named[::-1].hex()
    if name not in keys:
        raise MissingKey(f"no key {name}")
    number = int.from_bytes(nonce[:4], "little") ^ (index & 0xFFFFFFFF)
    return salsa20(keys[name], number.to_bytes(4, "little") + nonce[4:], body)


def decode_block(block: bytes, index: int = 0, keys: Keys | None = None) -> bytes:
    """One block by its mode: N raw, Z deflated, F a container of its own, E enciphered."""
    mode, body = block[:1], block[1:]
    if mode == b"N":
        return body
    if mode == b"Z":
        return zlib.decompress(body)
    if mode == b"F":
        return decode(body, keys=keys)
    if mode == b"E":
        return decode_block(deciphered(body, index, keys or {}), index, keys)
    raise ValueError(f"block mode {mode!r}")


def decode(data: bytes, verify: bool = True, keys: Keys | None = None, partial: bool = False) -> bytes:
    """The content of a container; ValueError if it is cut short, a block's digest is wrong or a key is missing.

    With `partial`, blocks without a key become zero bytes.
    """
    if data[:4] != b"BLTE" or len(data) < 8:
        raise ValueError("no container")
    (size,) = struct.unpack(">I", data[4:8])
    if not size:
        return decode_block(data[8:], 0, keys)
    count = int.from_bytes(data[9:12])
    at, out = size, []
    for i in range(count):
        packed, plain, digest = struct.unpack(">II16s", data[12 + 24 * i : 36 + 24 * i])
        block = data[at : at + packed]
        if len(block) != packed or verify and hashlib.md5(block, usedforsecurity=False).digest() != digest:
            raise ValueError(f"block {i} is damaged")
        try:
            content = decode_block(block, i, keys)
        except MissingKey:
            if not partial:
                raise
            content = bytes(plain)
        if len(content) != plain:
            raise ValueError(f"block {i} has {len(content)} bytes, not {plain}")
        out.append(content)
        at += packed
    return b"".join(out)


def decoded(files: DataFrame, keys: Keys | None = None, partial: bool = False) -> DataFrame:
    """(path, content, error) of files(path, content), as Spark's `binaryFile` source reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, errors = [], []
            for data in batch.column("content"):
                try:
                    contents.append(decode(data.as_py() or b"", True, keys, partial))
                    errors.append(None)
                except (ValueError, zlib.error, struct.error) as e:
                    contents.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(contents, pa.binary()), pa.array(errors, pa.string())], ["path", "content", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary, error string")
