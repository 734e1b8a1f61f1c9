"""Textures as PNG images and videos as rows of frames, in Arrow batches over `binaryFile` rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: How a texture's pixels may be stored, and the alpha code of interpolated alpha.
PALETTE, BLOCKS, BGRA, INTERPOLATED = 1, 2, 3, 7


def _expand565(c: np.ndarray) -> np.ndarray:
    r, g, b = c >> 11 & 31, c >> 5 & 63, c & 31
    return np.stack([r << 3 | r >> 2, g << 2 | g >> 4, b << 3 | b >> 2], -1).astype(np.int64)


def _alphas(blocks: np.ndarray, interpolated: bool) -> np.ndarray:
    """(block, 16) alpha values of the first eight bytes of each block."""
    if not interpolated:
        return np.stack([blocks[:, :8] & 15, blocks[:, :8] >> 4], -1).reshape(len(blocks), 16) * 17
    a, b = blocks[:, :1].astype(np.int64), blocks[:, 1:2].astype(np.int64)
    k = np.arange(1, 7)
    eight = ((7 - k) * a + k * b) // 7
    six = np.concatenate([((5 - k[:4]) * a + k[:4] * b) // 5, np.zeros_like(a), np.full_like(a, 255)], 1)
    levels = np.concatenate([a, b, np.where(a > b, eight, six)], 1)
    padded = np.concatenate([blocks[:, 2:8], np.zeros((len(blocks), 2), np.uint8)], 1)
    bits = np.ascontiguousarray(padded).view("<u8") >> (3 * np.arange(16, dtype=np.uint64))
    return np.take_along_axis(levels, (bits & np.uint64(7)).astype(np.int64), 1)


def block_pixels(raw: bytes, width: int, height: int, alpha: str | None) -> np.ndarray:
    """RGBA of 4 x 4 blocks of two end colours and 2-bit choices; alpha: None, `explicit` or `interpolated`."""
    across, down, size = -(-width // 4), -(-height // 4), 16 if alpha else 8
    count = min(across * down, len(raw) // size)
    if count < across * down and len(raw) % size:
        raise ValueError("texture block is cut short")
    blocks = np.zeros((across * down, size), np.uint8)
    blocks[:count] = np.frombuffer(raw, np.uint8, count * size).reshape(count, size)
    colour = np.ascontiguousarray(blocks[:, -8:])
    ends = colour[:, :4].copy().view("<u2").astype(np.int64)
    first, second = _expand565(ends[:, 0]), _expand565(ends[:, 1])
    third, fourth = (2 * first + second) // 3, (first + 2 * second) // 3
    opacity = np.full((len(blocks), 4), 255)
    if not alpha:
        cut = ends[:, 0] <= ends[:, 1]
        third = np.where(cut[:, None], (first + second) // 2, third)
        fourth = np.where(cut[:, None], 0, fourth)
        opacity[cut, 3] = 0
    choices = np.concatenate([np.stack([first, second, third, fourth], 1), opacity[:, :, None]], 2)
    bits = colour[:, 4:].copy().view("<u4") >> (2 * np.arange(16, dtype=np.uint32)) & 3
    pixels = np.take_along_axis(choices, bits.astype(np.int64)[:, :, None], 1)
    if alpha:
        pixels[:, :, 3] = _alphas(blocks, alpha == "interpolated")
    pixels[count:] = 0
    return pixels.astype(np.uint8).reshape(down, across, 4, 4, 4).swapaxes(1, 2).reshape(4 * down, 4 * across, 4)[:height, :width]


def texture(data: bytes, level: int = 0) -> np.ndarray:
    """(height, width, RGBA) of one size of a texture."""
    if len(data) < 148 or data[:4] != b"BLP2":
        raise ValueError("no texture")
    stored, depth, coded = data[8:11]
    width, height = (max(x >> level, 1) for x in struct.unpack_from("<II", data, 12))
    at, sizes = struct.unpack_from("<16I", data, 20), struct.unpack_from("<16I", data, 84)
    if not 0 <= level < sum(a > 0 for a in at):
        raise ValueError(f"no level {level}")
    if at[level] + sizes[level] > len(data):
        raise ValueError("level leaves the file")
    raw = data[at[level] : at[level] + sizes[level]]
    if stored == BLOCKS:
        return block_pixels(raw, width, height, None if depth <= 1 else "interpolated" if coded == INTERPOLATED else "explicit")
    out = np.zeros((height * width, 4), np.uint8)
    if stored == PALETTE:
        table = np.zeros(1024, np.uint8)
        have = np.frombuffer(data[148:1172], np.uint8)
        table[: len(have)] = have
        chosen = np.frombuffer(raw, np.uint8)[: len(out)]
        out[: len(chosen)] = table.reshape(256, 4)[chosen][:, [2, 1, 0, 3]]
    elif stored == BGRA:
        got = np.frombuffer(raw, np.uint8, len(raw) // 4 * 4).reshape(-1, 4)[: len(out)]
        out[:, 3] = 255
        out[: len(got)] = got[:, [2, 1, 0, 3]]
    return out.reshape(height, width, 4)


def png(pixels: np.ndarray) -> bytes:
    """The image file of (height, width, RGBA)."""
    height, width, _ = pixels.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], 1).tobytes()
    parts = ((b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)), (b"IDAT", zlib.compress(lines)), (b"IEND", b""))
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in parts)


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, begin, size) of the chunks of a RIFF file's part; lists are entered after they are given themselves."""
    while at + 8 <= end:
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        yield name, at + 8, size
        if name == b"LIST" and at + 12 <= end:
            yield data[at + 8 : at + 12] + b"*", at + 12, size - 4
            yield from chunks(data, at + 12, min(at + 8 + size, end))
        at += 8 + size + size % 2


def video_frames(data: bytes) -> tuple[dict, list[dict]]:
    """(width, height, frame rate) and a row a frame: type, timestamp and duration in microseconds, size."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no video")
    head: dict = {"width": 0, "height": 0, "frame_rate": 0.0}
    step, movie = 0.0, None
    for name, at, size in chunks(data, 12, len(data)):
        if name == b"avih" and (each := int.from_bytes(data[at : at + 4], "little")):
            head["frame_rate"] = 1e6 / each
            step = float(int(1e6 / head["frame_rate"]))
        elif name == b"strf" and size >= 40:
            head["width"], head["height"] = struct.unpack_from("<II", data, at + 4)
        elif name in (b"movi", b"movi*") and movie is None:
            movie = (at, min(at + size, len(data)))
    if movie is None:
        raise ValueError("video has no frames part")
    sizes, at = [], movie[0]
    while at + 8 <= movie[1]:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] in (b"00dc", b"00db"):
            sizes.append(size)
        at += 8 + size + size % 2
    return head, [{"type": "key", "timestamp": i * step, "duration": step, "size": n} for i, n in enumerate(sizes)]


def textures_as_png(files: DataFrame, level: int = 0) -> DataFrame:
    """(path, png, width, height, error) of files(path, content)."""
    schema = pa.schema([("path", pa.string()), ("png", pa.binary()), ("width", pa.int32()), ("height", pa.int32()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                row = dict.fromkeys(schema.names) | {"path": path}
                try:
                    pixels = texture(data.as_py() or b"", level)
                    row |= {"png": png(pixels), "width": pixels.shape[1], "height": pixels.shape[0]}
                except ValueError as e:
                    row["error"] = str(e)
                yield pa.RecordBatch.from_pylist([row], schema)

    return files.select("path", "content").mapInArrow(run, "path string, png binary, width int, height int, error string")


def frames(files: DataFrame, rows: int = 10_000) -> DataFrame:
    """(path, frame, type, timestamp, duration, size, error): a row a frame of files(path, content), or one with the error."""
    schema = pa.schema([("path", pa.string()), ("frame", pa.int64()), ("type", pa.string()), ("timestamp", pa.float64()), ("duration", pa.float64()), ("size", pa.int64()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    found = [{"path": path, "frame": i, "error": None} | f for i, f in enumerate(video_frames(data.as_py() or b"")[1])]
                except ValueError as e:
                    found = [dict.fromkeys(schema.names) | {"path": path, "error": str(e)}]
                for k in range(0, len(found), rows):
                    yield pa.RecordBatch.from_pylist(found[k : k + rows], schema)

    return files.select("path", "content").mapInArrow(run, "path string, frame long, type string, timestamp double, duration double, size long, error string")
